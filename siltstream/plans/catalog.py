"""The operators bound to tables: a query and the SQL that it is compared with, by name.

Times are whole microseconds since 1970, so that both sides mean the same. Floats are rounded to
the places that each query states, in both; nothing is rounded to make a difference vanish.
What disorder, gaps or values out of range a table lacks is made from it by a fixed rule, the same in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import census, clocks, compare, findings, islands, joins, merge, selection, splits, timeline
from ..streaming import run, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with t (microseconds) and cents (value as whole cents)."""
    return table(spark, sf_dir, "events").withColumn("t", F.expr("cast(cast(cast(ts - timestamp_ntz'1970-01-01 00:00:00' AS interval second) AS decimal(20, 6)) * 1000000 AS long)")).withColumn("cents", F.round(F.col("value") * 100).cast("long"))


E = "e AS (SELECT *, epoch_us(ts) AS t, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
SEVERITY = {"error": "error", "purchase": "warning", "signup": "info", "view": "info", "click": "info"}


def severities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(SEVERITY.items()), "event_type string, severity string")


SEV = "s(event_type, severity) AS (VALUES ('error', 'error'), ('purchase', 'warning'), ('signup', 'info'), ('view', 'info'), ('click', 'info'))"
RANK = "CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 1 WHEN 'error' THEN 2 WHEN 'fatal' THEN 3 END"


# -- findings


@query(f"""WITH {E} SELECT event_type, count(*) AS count, CAST(sum(cents) AS BIGINT) AS magnitude, min(t) AS first_t, arg_min(event_id, t) AS first_event_id,
 max(t) AS last_t, arg_max(event_id, t) AS last_event_id FROM e GROUP BY event_type""")
def tally_by_rule(spark, d):
    return findings.tally(events(spark, d), "event_type", ["t", "event_id"], F.col("cents"))


@query(f"""WITH {E} SELECT event_type, event_id, t, listed FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) AS INT) AS listed FROM e) WHERE listed <= 20""")
def tally_first_n(spark, d):
    return findings.exemplars(events(spark, d), "event_type", ["t", "event_id"]).select("event_type", "event_id", "t", "listed")


@query("SELECT event_type, count(*) AS count, least(count(*), 20) AS listed, count(*) - least(count(*), 20) AS suppressed FROM events GROUP BY event_type")
def tally_suppressed(spark, d):
    return findings.suppressed(findings.tally(events(spark, d), "event_type", ["t"], F.col("cents"))).select("event_type", "count", "listed", "suppressed")


@query(f"""WITH {SEV}, r AS (SELECT max({RANK}) AS k FROM (SELECT DISTINCT event_type FROM events) JOIN s USING (event_type))
SELECT CASE k WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' WHEN 3 THEN 'fatal' END AS worst, k < 3 AS passes FROM r""")
def verdict(spark, d):
    tallied = findings.tally(events(spark, d), "event_type", ["t"], F.col("cents"))
    return findings.verdict(findings.with_catalog(tallied, severities(spark), "event_type"), "fatal")


@query(f"""WITH {SEV} SELECT count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'warning') AS warning,
 count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'fatal') AS fatal FROM events JOIN s USING (event_type)""")
def severity_counts(spark, d):
    tallied = findings.tally(events(spark, d), "event_type", ["t"], F.col("cents"))
    return findings.at_severity(findings.with_catalog(tallied, severities(spark), "event_type"))


@query(f"""WITH {E} SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN cents ELSE 0 END) AS BIGINT) AS error,
 CAST(sum(CASE WHEN event_type = 'purchase' THEN cents ELSE 0 END) AS BIGINT) AS purchase,
 sum(CASE WHEN event_type = 'error' THEN cents ELSE 0 END) = 0 AND sum(CASE WHEN event_type = 'purchase' THEN cents ELSE 0 END) = 0 AS is_clean FROM e GROUP BY user_id""")
def legacy_counters(spark, d):
    return findings.wide_counters(events(spark, d), "event_type", ["error", "purchase"], F.col("cents"), ["user_id"])


@query("""SELECT user_id, CASE max(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END) WHEN 2 THEN 7 WHEN 1 THEN 4 ELSE 0 END AS exit_code
 FROM events GROUP BY user_id""")
def exit_precedence(spark, d):
    codes = events(spark, d).select("user_id", F.when(F.col("event_type") == "error", 7).when(F.col("event_type") == "purchase", 4).otherwise(0).alias("code"))
    return findings.combined_exit_code(codes, "code", ["user_id"])


@query("""WITH a AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 50 <> 0 GROUP BY user_id)
SELECT user_id, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b FROM a FULL JOIN b USING (user_id) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def counter_cross_check(spark, d):
    e = events(spark, d)
    count = lambda x: x.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return findings.disagreements(count(e), count(e.where("event_id % 50 <> 0")), "user_id", "n", "n")


# -- censuses


@query("""WITH d AS (SELECT unnest(range(1, 10)) AS value UNION ALL SELECT NULL), c AS (SELECT CASE WHEN l_linenumber BETWEEN 1 AND 9 THEN l_linenumber END AS v, count(*) AS n FROM lineitem GROUP BY 1)
SELECT value, coalesce(n, 0) AS n FROM d LEFT JOIN c ON value IS NOT DISTINCT FROM v""")
def census_values(spark, d):
    return census.value_counts(table(spark, d, "lineitem"), "l_linenumber", 1, 9)


@query("""WITH d AS (SELECT unnest(range(1, 41)) AS value UNION ALL SELECT NULL), c AS (SELECT CASE WHEN p_size BETWEEN 1 AND 40 THEN p_size END AS v, count(*) AS n FROM part GROUP BY 1)
SELECT value, coalesce(n, 0) AS n FROM d LEFT JOIN c ON value IS NOT DISTINCT FROM v""")
def value_outside(spark, d):
    return census.value_counts(table(spark, d, "part"), "p_size", 1, 40)


@query("SELECT CAST(count(*) FILTER (p_size <> 7) AS BIGINT) AS others, count(*) AS total FROM part")
def census_other_than(spark, d):
    return census.other_than(census.value_counts(table(spark, d, "part"), "p_size", 1, 40), 7)


@query("""WITH p AS (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT p_brand, CAST(sum(n) AS BIGINT) AS total, count(*) AS streams FROM p GROUP BY p_brand""")
def census_library(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return census.library_census(rows, "l_suppkey", ["p_brand"], F.lit(1))


@query("""WITH c AS (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2), n AS (SELECT l_partkey, count(*) AS k FROM c GROUP BY 1)
SELECT p_partkey, coalesce(k, 0) AS streams FROM part LEFT JOIN n ON p_partkey = l_partkey WHERE coalesce(k, 0) <= 20""")
def census_never_rare(spark, d):
    few = census.rare(table(spark, d, "lineitem"), "l_suppkey", ["l_partkey"], 20).select(F.col("l_partkey").alias("p_partkey"), "streams")
    used = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    unused = joins.remaining(table(spark, d, "part").select("p_partkey"), used, ["p_partkey"]).withColumn("streams", F.lit(0).cast("long"))
    return few.unionByName(unused)


@query("""SELECT CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS event_type, CASE WHEN grouping(m) = 1 THEN 'all' ELSE CAST(m AS VARCHAR) END AS m, count(*) AS n
 FROM (SELECT event_type, user_id % 4 AS m FROM events) GROUP BY ROLLUP (event_type, m)""")
def census_rollup(spark, d):
    rows = events(spark, d).select("event_type", (F.col("user_id") % 4).alias("m"))
    return census.part_and_whole(rows, ["event_type", "m"], F.count(F.lit(1)))


@query("SELECT count(DISTINCT regexp_replace(props, '[0-9]+', '0', 'g')) AS schemas, count(DISTINCT regexp_replace(props, '[0-9]+', '0', 'g')) <= 1 AS homogeneous FROM events")
def census_one_schema(spark, d):
    return census.one_schema(events(spark, d).withColumn("s", compare.masked(F.col("props"), [("[0-9]+", "0")])), "s")


@query("SELECT regexp_extract(c_name, '[0-9]([0-9])$', 1) AS digit, count(*) AS n FROM customer WHERE regexp_extract(c_name, '[0-9]([0-9])$', 1) NOT IN ('', '7') GROUP BY 1")
def projection_tally(spark, d):
    digit = F.regexp_extract("c_name", "[0-9]([0-9])$", 1)
    return census.projection_tally(table(spark, d, "customer"), F.when(~digit.isin("", "7"), digit), "digit")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) WHERE k = 1""")
def mode_per_stream(spark, d):
    return census.mode_of(events(spark, d), "event_type", ["user_id"])


@query("""SELECT c_mktsegment, CASE WHEN c_custkey % 11 = 0 THEN 'missing' WHEN abs(c_acctbal - round(c_acctbal)) <= 0.25 THEN 'match' ELSE 'apart' END AS kind, count(*) AS n FROM customer GROUP BY 1, 2""")
def match_apart(spark, d):
    b = F.when(F.col("c_custkey") % 11 != 0, -F.round("c_acctbal"))
    return census.match_apart(table(spark, d, "customer"), F.col("c_acctbal"), b, 0.25, ["c_mktsegment"])


@query("""WITH p AS (SELECT DISTINCT c_mktsegment, c_nationkey, c_custkey FROM customer)
SELECT c_mktsegment, c_nationkey, count(*) AS n, CASE WHEN count(*) <= 11 THEN array_to_string(list_sort(list(c_custkey)), ',') END AS items FROM p GROUP BY 1, 2""")
def k_suppress(spark, d):
    return census.publishable(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], "c_custkey", 11).withColumn("items", F.array_join("items", ","))


@query("""WITH m AS (SELECT o_orderpriority, median(o_totalprice) AS median FROM orders GROUP BY 1)
SELECT o_orderpriority, round(m.median, 4) AS median, round(median(abs(o_totalprice - m.median)), 4) AS mad FROM orders JOIN m USING (o_orderpriority) GROUP BY 1, m.median""")
def mad(spark, d):
    out = census.median_mad(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"])
    return out.select("o_orderpriority", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"))


@query(f"""WITH {E} SELECT user_id, cents AS peak, event_id AS peak_event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cents DESC, event_id) AS k FROM e) WHERE k = 1""")
def peak_first(spark, d):
    return census.peak_first(events(spark, d), "cents", ["event_id"], ["user_id"])


@query("""SELECT s_suppkey, 'balance' AS counter, CAST(round(s_acctbal) AS BIGINT) AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey FROM supplier""")
def unpivot_census(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("nation"), F.round("s_acctbal").cast("long").alias("balance"))
    return census.unpivot_leaves(rows, ["s_suppkey"], ["nation", "balance"])


@query("SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders QUALIFY rank <= 25")
def ranked_top(spark, d):
    return census.ranked(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, ["o_orderkey"])


# -- regions

ERRORS = "event_type = 'error'"


@query("""WITH f AS (SELECT user_id, event_id, event_type = 'error' AS f, coalesce(lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id), false) AS p FROM events),
g AS (SELECT *, sum(CASE WHEN f AND NOT p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_id) AS first_event_id, max(event_id) AS last_event_id, count(*) AS length FROM g WHERE f GROUP BY 1, 2""")
def concealment_runs(spark, d):
    return islands.runs(events(spark, d), ["user_id"], ["event_id"], F.expr(ERRORS))


@query("""WITH u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS unit, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT *, CASE WHEN unit - lag(unit) OVER (PARTITION BY user_id ORDER BY unit) <= 1 THEN 0 ELSE 1 END AS o FROM u WHERE event_type = 'error'),
g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY unit) AS region FROM f)
SELECT user_id, CAST(region AS BIGINT) AS region, min(unit) AS first_unit, max(unit) AS last_unit, count(*) AS faults, CASE WHEN max(unit) < max(n) THEN max(unit) + 1 END AS entry_unit FROM g GROUP BY 1, 2""")
def gap_islands(spark, d):
    from pyspark.sql import Window

    units = events(spark, d).withColumn("unit", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    return islands.merged_regions(units.where(ERRORS), ["user_id"], "unit", F.col("n"))


UNTIL = """WITH m AS (SELECT user_id, event_id, event_type = 'error' AS f, event_type = 'signup' AS r FROM events),
g AS (SELECT *, sum(CASE WHEN r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g,
 min(CASE WHEN r THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx, max(event_id) OVER (PARTITION BY user_id) AS e FROM m)"""


@query(UNTIL + """ SELECT user_id, min(event_id) AS first_unit, CASE WHEN any_value(nx) IS NULL THEN max(e) ELSE greatest(max(event_id), any_value(nx) - 1) END AS last_unit, any_value(nx) AS entry_unit, count(*) AS faults
 FROM g WHERE f GROUP BY user_id, g""")
def damage_until_restart(spark, d):
    return islands.until_restart(events(spark, d), ["user_id"], "event_id", F.expr(ERRORS), F.expr("event_type = 'signup'"))


@query(UNTIL + """ SELECT user_id, min(event_id) AS first_unit, CASE WHEN any_value(nx) IS NULL THEN max(e) ELSE greatest(max(event_id), any_value(nx) - 1) END AS last_unit, any_value(nx) AS entry_unit, CAST(1 AS BIGINT) AS parts
 FROM g WHERE f GROUP BY user_id, g""")
def damage_by_parts(spark, d):
    masks = events(spark, d).select("user_id", F.col("event_id"), F.when(F.expr(ERRORS), 1).otherwise(0).alias("damaged"), F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("restarted"))
    return islands.until_all_restart(masks, "user_id", "event_id", "damaged", "restarted")


@query("""WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'error')
SELECT user_id, event_id, greatest(n - 5, 0) AS overflow FROM f WHERE k <= 5""")
def regions_capped(spark, d):
    return islands.capped(events(spark, d).where(ERRORS).select("user_id", "event_id"), ["user_id"], ["event_id"], 5)


# -- clocks

CLOCK = "c AS (SELECT event_id, user_id, CAST((event_id * 100 + (event_id * 7919) % 400) % 65536 AS BIGINT) AS clock FROM events)"


def clocked(spark, d):
    return events(spark, d).select("event_id", "user_id", ((F.col("event_id") * 100 + (F.col("event_id") * 7919) % 400) % 65536).alias("clock"), F.col("user_id").alias("stream"))


@query("WITH " + CLOCK.replace("SELECT event_id,", "SELECT user_id AS stream, event_id,") + """, s AS (SELECT *, CASE WHEN clock + 32768 < lag(clock) OVER (PARTITION BY stream ORDER BY event_id) THEN 65536 ELSE 0 END AS s FROM c)
SELECT stream, event_id, CAST(clock + sum(s) OVER (PARTITION BY stream ORDER BY event_id) AS BIGINT) AS unwrapped FROM s""")
def clock_unwrap(spark, d):
    return clocks.unwrap(clocked(spark, d), ["stream"], ["event_id"], "clock").select("stream", "event_id", "unwrapped")


@query("WITH " + CLOCK.replace("SELECT event_id,", "SELECT user_id AS stream, event_id,") + """, i AS (SELECT *, ((clock - lag(clock) OVER (PARTITION BY stream ORDER BY event_id)) % 65536 + 65536) % 65536 AS interval FROM c)
SELECT stream, event_id, interval, coalesce(interval < 900 OR interval > 9000, false) AS jump FROM i""")
def interval_jump(spark, d):
    return clocks.interval_jumps(clocked(spark, d), ["stream"], ["event_id"], "clock", F.lit(900), F.lit(9000)).select("stream", "event_id", "interval", "jump")


@query(f"""WITH {E}, x AS (SELECT user_id, event_id AS unit, t AS t, 1 AS k, cents AS d FROM e UNION ALL SELECT user_id, event_id, t + 86400000000, 0, -cents FROM e)
SELECT user_id, unit, t, held FROM (SELECT *, CAST(sum(d) OVER (PARTITION BY user_id ORDER BY t, k, unit ROWS UNBOUNDED PRECEDING) AS BIGINT) AS held FROM x) WHERE k = 1""")
def occupancy(spark, d):
    return clocks.occupancy(events(spark, d), ["user_id"], F.col("t"), F.col("t") + 86_400_000_000, F.col("cents"), "event_id")


@query("""WITH c AS (SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 1), p AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM c)
SELECT conv_id, turn, b + 1 AS expected, CASE WHEN turn = 0 THEN 'restart' ELSE 'gap' END AS kind FROM p WHERE b IS NOT NULL AND turn <> b + 1""")
def seq_gaps(spark, d):
    rows = table(spark, d, "conversations").where("turn % 3 <> 1").select("conv_id", "turn")
    return clocks.sequence_gaps(rows, ["conv_id"], ["turn"], "turn")


@query("""WITH s AS (SELECT event_id, user_id, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_sync FROM events)
SELECT event_id, last_sync, event_id - last_sync AS since FROM s""")
def sync_spacing(spark, d):
    return clocks.sync_spacing(events(spark, d), ["user_id"], "event_id", F.expr("event_type = 'signup'")).select("event_id", "last_sync", "since")


# -- timelines

CONFIG_LAG = """WITH p AS (SELECT user_id, event_id, event_type, props, row_number() OVER w AS k, lag(event_type) OVER w AS pt, lag(props) OVER w AS pp FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


@query("""WITH f AS (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS ft FROM events)
SELECT user_id, event_id, 'event_type' AS changed FROM f WHERE event_type IS DISTINCT FROM ft""")
def config_change_first(spark, d):
    return timeline.against_first(events(spark, d), ["user_id"], ["event_id"], ["event_type"]).select("user_id", "event_id", "changed")


@query(CONFIG_LAG + " SELECT user_id, event_id, CASE WHEN event_type IS DISTINCT FROM pt THEN 'event_type' ELSE 'props' END AS changed FROM p WHERE k > 1 AND (event_type IS DISTINCT FROM pt OR props IS DISTINCT FROM pp)")
def config_change_prev(spark, d):
    return timeline.against_previous(events(spark, d), ["user_id"], ["event_id"], ["event_type", "props"]).select("user_id", "event_id", "changed")


@query(CONFIG_LAG + " SELECT user_id, event_id, event_type, pt AS previous_event_type FROM p WHERE k = 1 OR event_type IS DISTINCT FROM pt")
def timeline_changes(spark, d):
    return timeline.changes(events(spark, d), ["user_id"], ["event_id"], ["event_type"]).select("user_id", "event_id", "event_type", "previous_event_type")


@query(CONFIG_LAG + " SELECT user_id, event_id, event_type FROM p WHERE k = 1 OR event_type IS DISTINCT FROM pt OR (props IS DISTINCT FROM pp AND event_id % 2 = 0)")
def timeline_restate(spark, d):
    return timeline.changes(events(spark, d), ["user_id"], ["event_id"], ["event_type"], ["props"], F.col("event_id") % 2 != 0).select("user_id", "event_id", "event_type")


@query("""WITH m AS (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN event_id - 500 ELSE event_id END AS pos FROM events), p AS (SELECT *, lag(pos) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM m)
SELECT user_id, event_id, pos, before FROM p WHERE pos < before""")
def out_of_order(spark, d):
    moved = events(spark, d).select("user_id", "event_id", F.when(F.col("event_id") % 7 == 0, F.col("event_id") - 500).otherwise(F.col("event_id")).alias("pos"))
    return timeline.out_of_order(moved, ["user_id"], ["event_id"], "pos")


@query("""SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS state FROM events""")
def forward_fill(spark, d):
    sparse = events(spark, d).select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("state"))
    return timeline.forward_fill(sparse, ["user_id"], ["event_id"], ["state"]).select("event_id", "state")


@query(CONFIG_LAG + " SELECT event_id, CASE WHEN event_type = pt THEN NULL ELSE event_type END AS event_type FROM p")
def delta_encode(spark, d):
    return timeline.delta_encode(events(spark, d), ["user_id"], ["event_id"], ["event_type"]).select("event_id", "event_type")


@query("""WITH e AS (SELECT user_id, event_id // 20 AS pos, event_id, event_type FROM events), z AS (SELECT max(pos) + 1 AS z FROM e),
k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, pos ORDER BY event_id DESC) = 1),
n AS (SELECT *, row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w AS new FROM k WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
t AS (SELECT * FROM n QUALIFY max(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) = 1)
SELECT user_id, pos AS start, event_type, coalesce(lead(pos) OVER (PARTITION BY user_id ORDER BY pos), z) - pos AS duration FROM t, z""")
def block_duration(spark, d):
    rows = events(spark, d).select("user_id", F.floor(F.col("event_id") / 20).alias("pos"), "event_id", "event_type")
    rows = rows.crossJoin(F.broadcast(rows.agg((F.max("pos") + 1).alias("end"))))  # one row
    return timeline.blocks(rows, ["user_id"], "pos", ["event_id"], F.col("end"), ["event_type"]).select("user_id", "start", "event_type", "duration")


@query("""WITH b AS (SELECT user_id, event_id AS start, 60 AS duration, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next_start FROM events)
SELECT user_id, start, next_start FROM b WHERE next_start <> start + duration""")
def tiling_faults(spark, d):
    rows = events(spark, d).select("user_id", F.col("event_id").alias("start"), F.lit(60).alias("duration"))
    return timeline.tiling_faults(rows, ["user_id"], "start", "duration").select("user_id", "start", "next_start")


@query(f"""WITH {E}, p AS (SELECT user_id, event_id, t - lag(t) OVER w AS gap, abs(cents - lag(cents) OVER w) AS distance FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, gap, CAST(distance AS BIGINT) AS distance FROM p WHERE gap IS NOT NULL""")
def displacements(spark, d):
    rows = timeline.displacements(events(spark, d).select("user_id", "event_id", "t", "cents"), ["user_id"], "t", ["cents"])
    return rows.select("event_id", "gap", F.round("distance").cast("long").alias("distance"))


@query("""WITH v AS (SELECT user_id, event_id AS t, CAST(round(value * 100) AS DOUBLE) AS v FROM events), q AS (SELECT user_id, event_id + 5 AS probe FROM events),
a AS (SELECT q.user_id, probe, v.t AS ta, v.v AS va FROM q ASOF LEFT JOIN v ON q.user_id = v.user_id AND q.probe >= v.t),
b AS (SELECT a.*, v.t AS tb, v.v AS vb FROM a ASOF LEFT JOIN v ON a.user_id = v.user_id AND a.probe <= v.t)
SELECT user_id, probe, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR tb = ta THEN va ELSE va + (vb - va) * (probe - ta) / (tb - ta) END, 6) AS value FROM b""")
def trajectory_value(spark, d):
    e = events(spark, d).select("user_id", "event_id", F.col("cents").cast("double").alias("v"))
    probes = e.select("user_id", (F.col("event_id") + 5).alias("probe"))
    return timeline.value_at(e, probes, "user_id", "event_id", "v", "probe").withColumn("value", F.round("value", 6))


# -- comparisons

COPY = "b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 17 <> 0 UNION ALL SELECT -1 - o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 19 = 0)"


def order_pairs(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    changed = orders.where("o_orderkey % 17 <> 0").withColumn("v", F.when(F.col("o_orderkey") % 13 == 0, F.col("v") + 1).otherwise(F.col("v")))
    copy = changed.unionByName(orders.where("o_orderkey % 19 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey")))
    return compare.positional(orders, copy, ["o_orderkey"], "v", "v")


@query(f"""WITH {COPY} SELECT count(*) FILTER (a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL) AS compared, count(*) FILTER (a.o_totalprice <> b.v) AS mismatches,
 count(*) FILTER (b.o_orderkey IS NULL) AS only_a, count(*) FILTER (a.o_orderkey IS NULL) AS only_b, false AS equal FROM orders a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def compare_full_outer(spark, d):
    return compare.mismatch_report(order_pairs(spark, d))


@query(f"""WITH {COPY} SELECT a.o_orderkey, abs(a.o_totalprice - b.v) AS error FROM orders a JOIN b ON a.o_orderkey = b.o_orderkey WHERE abs(a.o_totalprice - b.v) > 0 ORDER BY error DESC, 1 LIMIT 30""")
def worst_n(spark, d):
    return compare.worst(order_pairs(spark, d), ["o_orderkey"], 30).select("o_orderkey", "error")


@query(f"""WITH {COPY} SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey FROM orders a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_totalprice IS DISTINCT FROM b.v ORDER BY 1 LIMIT 40""")
def first_mismatches(spark, d):
    return compare.first_mismatches(order_pairs(spark, d), ["o_orderkey"], 40).select("o_orderkey")


@query("""SELECT l_returnflag, count(*) AS n, round(max(abs(a - b)), 6) AS max_error, round(sqrt(sum((a - b) * (a - b)) / count(*)), 4) AS rms, round(10 * log10(sum(a * a) / sum((a - b) * (a - b))), 4) AS snr_db,
 round(sum(a * b) / sum(b * b), 8) AS gain, count(*) FILTER (abs(a - b) > 1) AS over_0, count(*) FILTER (abs(a - b) > 100) AS over_1
 FROM (SELECT l_returnflag, l_extendedprice AS a, l_extendedprice * (1 - l_discount) AS b FROM lineitem) GROUP BY 1""")
def compare_stats(spark, d):
    pairs = table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("b"))
    out = compare.error_statistics(pairs, ["l_returnflag"], (1, 100))
    return out.select("l_returnflag", "n", F.round("max_error", 6).alias("max_error"), F.round("rms", 4).alias("rms"), F.round("snr_db", 4).alias("snr_db"), F.round("gain", 8).alias("gain"), "over_0", "over_1")


@query("""WITH w AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), h AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT coalesce(w.o_custkey, h.o_custkey) AS o_custkey, coalesce(w.n, 0) AS whole, coalesce(h.n, 0) AS head FROM w FULL JOIN h ON w.o_custkey = h.o_custkey""")
def head_vs_whole(spark, d):
    orders = table(spark, d, "orders")
    count = lambda x: x.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return compare.side_by_side(count(orders), count(orders.where("o_orderdate < timestamp_ntz '1996-01-01 00:00:00'")), "o_custkey", "n")


@query("""WITH h AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT c_custkey, c_mktsegment, s AS head_o_orderstatus FROM customer LEFT JOIN h ON c_custkey = o_custkey""")
def left_with_last_head(spark, d):
    heads = table(spark, d, "orders").where("o_orderdate < timestamp_ntz '1996-01-01 00:00:00'").withColumnRenamed("o_custkey", "c_custkey")
    return compare.with_last_head(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), heads, ["c_custkey"], "o_orderkey", "o_orderstatus")


@query("""SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')""")
def beyond_head(spark, d):
    orders = table(spark, d, "orders")
    return compare.beyond(orders, orders.where("o_orderdate < timestamp_ntz '1996-01-01 00:00:00'"), ["o_custkey"])


@query("SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events")
def flatten_json(spark, d):
    return compare.json_leaves(events(spark, d), ["event_id"], "props")


@query("""SELECT event_id, 'k' AS path, 'changed' AS kind, json_extract_string(props, '$.k') AS a, '0' AS b FROM events WHERE event_id % 10 = 0 AND json_extract_string(props, '$.k') <> '0'
 UNION ALL SELECT event_id, 'k', 'dropped', json_extract_string(props, '$.k'), NULL FROM events WHERE event_id % 10 = 1
 UNION ALL SELECT event_id, 'x', 'added', NULL, '1' FROM events WHERE event_id % 10 IN (1, 2)""")
def json_diff(spark, d):
    e = events(spark, d).select("event_id", "props")
    rest = F.col("event_id") % 10
    new = F.when(rest == 0, F.lit('{"k": 0}')).when(rest == 1, F.lit('{"x": 1}')).when(rest == 2, F.concat(F.expr("substr(props, 1, length(props) - 1)"), F.lit(', "x": 1}'))).otherwise(F.col("props"))
    return compare.structural_diff(compare.json_leaves(e, ["event_id"], "props"), compare.json_leaves(e.withColumn("props", new), ["event_id"], "props"), ["event_id"])


@query("""WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, unnest(l) AS v, generate_subscripts(l, 1) - 1 AS line FROM a)
SELECT doc_id, CAST(line AS INT) AS line, md5(v) AS a FROM x WHERE (doc_id + line) % 11 = 0 AND v <> upper(v)""")
def text_line_diff(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    changed = docs.withColumn("text", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when((F.col("doc_id") + i) % 11 == 0, F.upper(x)).otherwise(x)), "\n"))
    return compare.line_diff(docs, changed, "doc_id", "text").select("doc_id", "line", F.md5(F.col("a").cast("binary")).alias("a"))


@query("""SELECT l_returnflag, bit_xor(l_orderkey) AS xor, bit_or(l_orderkey) AS "or",
 xor(xor(bit_xor(l_orderkey), bit_xor(l_orderkey) >> 16), xor(bit_xor(l_orderkey), bit_xor(l_orderkey) >> 16) >> 8) & 255 AS fold FROM lineitem GROUP BY 1""")
def bit_reduce(spark, d):
    return compare.bit_sums(table(spark, d, "lineitem"), F.col("l_orderkey"), ["l_returnflag"])


@query("""WITH v AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) - 20000000 AS v FROM orders)
SELECT o_orderkey, greatest(least(v, 8388607), -8388608) AS held, v > 8388607 OR v < -8388608 AS clipped FROM v""")
def clamp_flag(spark, d):
    v = F.round(F.col("o_totalprice") * 100).cast("long") - 20_000_000
    held, clipped = compare.saturate(v)
    return table(spark, d, "orders").select("o_orderkey", held.alias("held"), clipped.alias("clipped"))


# -- joins


@query(f"""WITH {E}, s AS (SELECT * FROM e WHERE event_type = 'signup') SELECT e.event_id, s.event_id AS state_id, s.t AS matched_at FROM e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.t >= s.t""")
def asof_state(spark, d):
    e = events(spark, d).select("user_id", "event_id", "t", "event_type")
    signups = e.where("event_type = 'signup'").select("user_id", F.col("t").alias("s_t"), F.col("event_id").alias("state_id"))
    return joins.asof(e, signups, ["user_id"], "t", "s_t", ["state_id"]).select("event_id", "state_id", "matched_at")


@query("""WITH p AS (SELECT a.event_id, b.event_id AS other, abs(a.event_id - b.event_id) AS apart FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND abs(a.event_id - b.event_id) <= 400 WHERE a.event_type = 'click')
SELECT event_id, other, apart FROM p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY apart, other) = 1""")
def nearest_event(spark, d):
    e = events(spark, d).select("user_id", "event_id", "event_type")
    other = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("other"))
    return joins.nearest(e.where("event_type = 'click'"), other, ["user_id"], "event_id", "other", 400, ["event_id"], ["other"]).select("event_id", "other", "apart")


@query("""WITH a AS (SELECT user_id, event_id AS t, value AS v FROM events), b AS (SELECT user_id, CASE WHEN event_id % 11 = 0 THEN event_id + 3 ELSE event_id END AS t, CASE WHEN event_id % 23 = 0 THEN value + 1 ELSE value END AS v FROM events WHERE event_id % 29 <> 0),
x AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.t, b.t) AS t, a.v AS a, b.v AS b FROM a FULL JOIN b ON a.user_id = b.user_id AND a.t = b.t),
l AS (SELECT * FROM x WHERE b IS NULL), r AS (SELECT * FROM x WHERE a IS NULL)
SELECT user_id, t AS at, CASE WHEN abs(a - b) <= 0.001 THEN 'matched' ELSE 'value_mismatch' END AS kind FROM x WHERE a IS NOT NULL AND b IS NOT NULL
UNION ALL SELECT user_id, t, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.user_id = l.user_id AND abs(r.t - l.t) <= 5) THEN 'time_mismatch' ELSE 'missing' END FROM l
UNION ALL SELECT user_id, t, 'extra' FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE r.user_id = l.user_id AND abs(r.t - l.t) <= 5)""")
def band_reconcile(spark, d):
    a = events(spark, d).select("user_id", "event_id", "value")
    i = F.col("event_id")
    b = a.where("event_id % 29 <> 0").select("user_id", F.when(i % 11 == 0, i + 3).otherwise(i).alias("moved"), F.when(i % 23 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("value")).withColumnRenamed("moved", "event_id")
    return joins.reconcile(a, b, ["user_id"], "event_id", "value", 5, 0.001)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)")
def dangling_references(spark, d):
    return joins.dangling(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").where("c_custkey % 5 <> 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_resume(spark, d):
    return joins.remaining(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT c_custkey, n_regionkey AS key FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def reference_chain(spark, d):
    start = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("key"))
    return joins.chain(start, [(table(spark, d, "nation"), "n_nationkey", "n_regionkey")], "key")


@query("""WITH p AS (SELECT a.vec_id AS q, b.vec_id AS best, CAST(round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) * 1e6) AS BIGINT) AS score
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, best) AS k, score - lead(score) OVER (PARTITION BY q ORDER BY score DESC, best) AS margin FROM p)
SELECT q, best, score, margin FROM k WHERE k = 1""")
def pair_best_margin(spark, d):
    """Queries (vec_id divisible by 100) against all vectors; the query side is broadcast only if it is small, else Spark joins in blocks."""
    vectors = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    queries = findings.small(vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("v").alias("u")))
    dot = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = vectors.join(queries, F.col("q") != F.col("vec_id")).select("q", F.col("vec_id").alias("best"), F.round(dot * 1e6).cast("long").alias("score"))
    return compare.best_of(scored, ["q"], "score", ["best"])


# -- merges


@query("""WITH g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, g, role ORDER BY turn) AS k FROM g WHERE g > 0)
SELECT conv_id, CAST(g AS BIGINT) AS "group", count(*) FILTER (k = 1) AS n, string_agg(role, ',' ORDER BY turn) FILTER (k = 1) AS parts, count(*) FILTER (k > 1) AS dropped FROM k GROUP BY 1, 2""")
def group_merge(spark, d):
    out = merge.grouped(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user", "role")
    return out.withColumn("parts", F.array_join("parts", ","))


@query("""WITH g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations) SELECT conv_id, count(*) AS orphans FROM g WHERE g = 0 GROUP BY 1""")
def orphan_records(spark, d):
    return merge.orphans(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user")


LAYOUT = "p AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {LAYOUT}, s AS (SELECT l_orderkey, l_partkey % 5 AS location, min(l_linenumber) AS f, arg_max(l_partkey, l_linenumber) AS source FROM p GROUP BY 1, 2)
SELECT l_orderkey, location, source, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY f) - 1 AS INT) AS channel FROM s QUALIFY channel < 3""")
def layout_merge(spark, d):
    parts = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).withColumn("location", F.col("l_partkey") % 5)
    return merge.merged_layout(parts, ["l_orderkey"], ["l_linenumber"], "location", "l_partkey", 3)


@query("""WITH k AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn % 3 <> 1), s AS (SELECT conv_id, unnest(range(min(turn), max(turn) + 1)) AS turn FROM k GROUP BY 1)
SELECT conv_id, turn FROM s WHERE (conv_id, turn) NOT IN (SELECT conv_id, turn FROM k)""")
def missing_groups(spark, d):
    return merge.missing_groups(table(spark, d, "conversations").where("turn % 3 <> 1").select("conv_id", "turn"), ["conv_id"], "turn")


@query("SELECT p_partkey, list_reduce(list_filter([0,1,2,3,4,5], lambda i: ((p_size >> i) & 1) = 1)::VARCHAR[], lambda a, b: a || ',' || b) AS bits FROM part WHERE p_size > 0")
def mask_layout(spark, d):
    return table(spark, d, "part").where("p_size > 0").select("p_partkey", F.array_join(merge.from_mask(F.col("p_size").cast("int"), 6), ",").alias("bits"))


# -- splits

SPLIT_ROWS = """r AS (SELECT quality = 0 AS y, CAST(toxic AS VARCHAR) AS toxic, lang, CASE WHEN text = upper(text) THEN 'upper' ELSE 'mixed' END AS letters, CASE WHEN regexp_matches(text, '[#*$%&|<>]{3}') THEN 'yes' ELSE 'no' END AS symbols FROM labels JOIN documents USING (doc_id)),
u AS (SELECT y, unnest(['toxic', 'lang', 'letters', 'symbols']) AS field, unnest([toxic, lang, letters, symbols]) AS value FROM r)"""
FIELDS = ["toxic", "lang", "letters", "symbols"]


def split_rows(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id")
    return rows.select((F.col("quality") == 0).alias("y"), "toxic", "lang", F.when(F.col("text") == F.upper("text"), "upper").otherwise("mixed").alias("letters"), F.when(F.col("text").rlike(r"[#*$%&|<>]{3}"), "yes").otherwise("no").alias("symbols"))


@query(f"""WITH {SPLIT_ROWS} SELECT field, value, count(*) FILTER (y) AS yes, count(*) FILTER (NOT y) AS no FROM u GROUP BY 1, 2""")
def split_values(spark, d):
    return splits.field_values(split_rows(spark, d), F.col("y"), FIELDS)


@query(f"""WITH {SPLIT_ROWS}, c AS (SELECT field, value, count(*) FILTER (y) AS yes, count(*) FILTER (NOT y) AS no FROM u GROUP BY 1, 2),
f AS (SELECT field, count(*) AS distinct_values, CAST(sum(least(yes, no)) AS BIGINT) AS overlap, CAST(sum(yes) AS BIGINT) AS yes, CAST(sum(no) AS BIGINT) AS no FROM c GROUP BY 1)
SELECT *, CASE WHEN distinct_values > greatest(4, (yes + no) // 2) THEN 'continuous' WHEN yes = 0 OR no = 0 THEN 'none' WHEN overlap = 0 THEN 'exact'
 WHEN overlap <= greatest(2, (yes + no) // 10) AND least(yes, no) >= 10 THEN 'near' ELSE 'none' END AS kind FROM f""")
def split_fields(spark, d):
    return splits.splits(split_rows(spark, d), F.col("y"), FIELDS)


@query(f"""WITH {SPLIT_ROWS}, n AS (SELECT row_number() OVER () AS i, * FROM r), w AS (SELECT i, y, unnest(['toxic', 'lang', 'letters', 'symbols']) AS field, unnest([1, 2, 3, 4]) AS k, unnest([toxic, lang, letters, symbols]) AS value FROM n),
c AS (SELECT a.field AS field_a, b.field AS field_b, a.value AS va, b.value AS vb, count(*) FILTER (a.y) AS yes, count(*) FILTER (NOT a.y) AS no FROM w a JOIN w b ON a.i = b.i AND a.k < b.k GROUP BY 1, 2, 3, 4)
SELECT field_a, field_b, CAST(sum(least(yes, no)) AS BIGINT) AS overlap FROM c GROUP BY 1, 2""")
def split_pairs(spark, d):
    return splits.pair_splits(split_rows(spark, d), F.col("y"), FIELDS)


# -- selection


@query("""WITH b AS (SELECT user_id, min(event_id) AS b FROM events WHERE event_type = 'signup' AND event_id + 1 > 300.5 GROUP BY 1) SELECT user_id, event_id FROM events JOIN b USING (user_id) WHERE event_id >= b""")
def start_at_sync(spark, d):
    return selection.from_sync(events(spark, d), ["user_id"], "event_id", F.expr("event_type = 'signup'"), F.lit(300.5)).select("user_id", "event_id")


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type = 'click' AND CAST(user_id AS VARCHAR) = '7'")
def clause_filter(spark, d):
    return selection.clauses(events(spark, d), ["event_type=click", "user_id=7"]).select("event_id", "event_type", "user_id")


@query(f"""WITH {SEV} SELECT event_id FROM events JOIN s USING (event_type) WHERE severity IN ('warning', 'error', 'fatal')""")
def severity_filter(spark, d):
    return selection.at_least(findings.with_catalog(events(spark, d), severities(spark), "event_type"), "severity", "warning").select("event_id")


@query(f"""WITH {E}, n AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 40 ELSE 0 END AS s, 100 + cents % 7 AS n FROM e)
SELECT event_id, CAST(sum(s + n) OVER w - n AS BIGINT) AS begins, CAST(sum(s + n) OVER w AS BIGINT) AS ends FROM n WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def output_position(spark, d):
    silence = F.when(F.expr(ERRORS), 40).otherwise(0)
    return selection.output_positions(events(spark, d), ["user_id"], ["event_id"], silence, 100 + F.col("cents") % 7).select("event_id", "begins", "ends")


@query(f"""WITH {E} SELECT event_id, round(avg(CASE WHEN event_type <> 'error' THEN cents END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS average FROM e""")
def clean_average(spark, d):
    out = selection.clean_average(events(spark, d), ["user_id"], ["event_id"], F.expr("event_type <> 'error'"), F.col("cents"))
    return out.select("event_id", F.round("average", 6).alias("average"))


@query("SELECT CASE WHEN a IS NULL THEN b ELSE a END AS o_custkey, CASE WHEN b IS NULL THEN 'a' ELSE 'b' END AS side FROM (SELECT DISTINCT o_custkey AS a FROM orders WHERE o_orderkey % 3 = 0) FULL JOIN (SELECT DISTINCT o_custkey AS b FROM orders WHERE o_orderkey % 3 <> 0) ON a = b WHERE a IS NULL OR b IS NULL")
def set_difference(spark, d):
    orders = table(spark, d, "orders")
    return selection.file_set_diff(orders.where("o_orderkey % 3 = 0"), orders.where("o_orderkey % 3 <> 0"), "o_custkey")


@query("""WITH x AS (SELECT user_id % 3 AS t, event_id // 10 AS p, value AS v FROM events WHERE event_id % 2 = 0), y AS (SELECT user_id % 3 AS t, event_id // 10 AS p, value AS v FROM events WHERE event_id % 2 = 1)
SELECT x.t AS track_a, y.t AS track_b, round(sqrt(avg((x.v - y.v) * (x.v - y.v))), 6) AS rms FROM x JOIN y USING (p) GROUP BY 1, 2""")
def distance_table(spark, d):
    rows = events(spark, d).select("event_id", (F.col("user_id") % 3).alias("t"), F.floor(F.col("event_id") / 10).alias("p"), "value")
    return selection.distance_table(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "p", "t", "value").withColumn("rms", F.round("rms", 6))


@query(f"""WITH {E}, d AS (SELECT user_id, event_id, abs(cents - (cents // 50) * 50) AS d FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM d)
SELECT user_id, max(n) AS n, max(d) AS max_loss, round(avg(d), 6) AS mean_loss, min(CASE WHEN k >= ceil(n * 95 / 100) THEN d END) AS p95, count(*) FILTER (d > 30) AS over FROM k GROUP BY 1""")
def trajectory_loss(spark, d):
    e = events(spark, d)
    out = selection.trajectory_loss(e, e.withColumn("cents", F.floor(F.col("cents") / 50) * 50), "user_id", "cents", "event_id", 30)
    return out.withColumn("mean_loss", F.round("mean_loss", 6))


# -- streams: the table is read as a stream of files, and all that there is now is run


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(f"{sf_dir}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)  # a stream reads folders


@query(f"""WITH {E} SELECT event_type, count(*) AS count, CAST(sum(cents) AS BIGINT) AS magnitude FROM e GROUP BY event_type""")
def stream_tally(spark, d):
    rows = stream_of(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return run.available_now(streams.running_tally(rows, "event_type", F.col("cents")), "tally", "complete")


@query(CONFIG_LAG + " SELECT user_id, event_id, event_type, pt AS previous_event_type FROM p WHERE k = 1 OR event_type IS DISTINCT FROM pt")
def stream_changes(spark, d):
    return run.available_now(streams.change_stream(stream_of(spark, d, "events"), "user_id", "event_id", "event_type"), "changes")


@query("""WITH g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS all_g FROM conversations)
SELECT conv_id, CAST(g AS BIGINT) AS "group", min(turn) AS first, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS kinds FROM g WHERE g > 0 AND g < all_g GROUP BY 1, 2""")
def stream_groups(spark, d):
    return run.available_now(streams.group_stream(stream_of(spark, d, "conversations"), "conv_id", "turn", "role", "user"), "groups")


@query(UNTIL + """ SELECT user_id, min(event_id) AS first_unit, greatest(max(event_id), any_value(nx) - 1) AS last_unit, any_value(nx) AS entry_unit, CAST(1 AS BIGINT) AS parts
 FROM g WHERE f GROUP BY user_id, g HAVING any_value(nx) IS NOT NULL""")
def stream_regions(spark, d):
    masks = stream_of(spark, d, "events").select("user_id", "event_id", F.when(F.expr(ERRORS), 1).otherwise(0).alias("damaged"), F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("restarted"))
    return run.available_now(streams.region_stream(masks, "user_id", "event_id", "damaged", "restarted"), "regions")


from . import reporting  # noqa: E402, F401  its queries join these
from . import parsing  # noqa: E402, F401
