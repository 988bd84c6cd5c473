"""Whole-stream reports and the operators around them, bound to tables beside their SQL (see catalog)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings, reports
from .catalog import E, RANK, SEV, events, query, severities, table

UNIT = "u AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS unit FROM e)"


def units(spark, d) -> DataFrame:
    """events numbered by user: each user is a stream."""
    from pyspark.sql import Window

    return events(spark, d).withColumn("unit", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long"))


TOTALS = """SELECT user_id, count(*) AS units, CAST(sum(cents) AS BIGINT) AS bytes, max(cents) AS max_bytes, arg_min(event_id, struct_pack(a := -cents, b := event_id)) AS max_at,
 count(*) FILTER (event_type = 'signup') AS syncs, count(*) FILTER (cents > 4000) AS gaps, CAST(sum(CASE WHEN cents > 4000 THEN cents ELSE 0 END) AS BIGINT) AS gap_bytes, min(event_id) AS first_unit, max(event_id) AS last_unit,
 round(count(*) * 40 / 48000.0, 9) AS seconds, round(sum(cents) * 8.0 / (count(*) * 40 / 48000.0), 6) AS bits_per_second FROM e GROUP BY user_id"""


def totals(spark, d) -> DataFrame:
    gap = F.when(F.col("cents") > 4000, F.col("cents"))
    return reports.stream_totals(events(spark, d), ["user_id"], "event_id", "cents", gap, F.col("event_type") == "signup", 40, 48_000).withColumn("seconds", F.round("seconds", 9)).withColumn("bits_per_second", F.round("bits_per_second", 6))


@query(f"WITH {E} {TOTALS}")
def stream_totals(spark, d):
    return totals(spark, d)


@query(f"""WITH {E}, {SEV}, t AS ({TOTALS}), f AS (SELECT user_id, severity FROM e JOIN s USING (event_type)),
c AS (SELECT user_id, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'fatal') AS fatal, max({RANK}) AS k FROM f GROUP BY user_id)
SELECT t.*, coalesce(info, 0) AS info, coalesce(warning, 0) AS warning, coalesce(error, 0) AS error, coalesce(fatal, 0) AS fatal, CASE k WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' END AS worst,
 CASE WHEN k >= 2 THEN 7 WHEN gaps > 0 THEN 4 ELSE 0 END AS exit_code FROM t LEFT JOIN c USING (user_id)""")
def stream_report(spark, d):
    found = findings.with_catalog(events(spark, d).select("user_id", "event_type"), severities(spark), "event_type")
    return reports.stream_report(totals(spark, d), found, ["user_id"], lossy=F.col("gaps") > 0)


@query(f"WITH {E} SELECT user_id, event_type, count(*) AS segments, CAST(sum(cents) AS BIGINT) AS bytes, min(cents) AS least, max(cents) AS most, count(*) FILTER (cents > 4000) AS faulty FROM e GROUP BY user_id, event_type")
def part_totals(spark, d):
    return reports.part_totals(events(spark, d), ["user_id"], "event_type", "cents", F.col("cents") > 4000)


@query(f"""WITH {E} SELECT user_id, event_id, source FROM (SELECT user_id, event_id, 'type' AS source FROM e WHERE event_type = 'error' UNION ALL SELECT user_id, event_id, 'value' FROM e WHERE cents > 4000)""")
def findings_of_passes(spark, d):
    e = events(spark, d)
    return reports.findings_of({"type": e.where("event_type = 'error'"), "value": e.where("cents > 4000")}, ["user_id", "event_id"])


@query(f"WITH {E} SELECT event_type, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(event_id) AS BIGINT) AS event_id, grouping(event_type) = 1 AS whole FROM e GROUP BY ROLLUP (event_type)")
def by_presentation(spark, d):
    return reports.by_presentation(events(spark, d), "event_type", ["cents", "event_id"])


@query("""SELECT l_returnflag, count(*) AS frames, CAST(sum(l_partkey) AS BIGINT) AS bytes, CAST(sum(l_linenumber * 256) AS BIGINT) AS samples, round(sum(l_linenumber * 256.0 / (32000 + l_orderkey % 3 * 8000)), 6) AS seconds,
 count(DISTINCT 32000 + l_orderkey % 3 * 8000) AS rates FROM lineitem GROUP BY l_returnflag""")
def pass_totals(spark, d):
    frames = table(spark, d, "lineitem").withColumn("rate", 32_000 + F.col("l_orderkey") % 3 * 8000)
    return reports.pass_totals(frames, "l_returnflag", "l_partkey", "rate", "l_linenumber").withColumn("seconds", F.round("seconds", 6))


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS clean, count(*) FILTER (o_orderstatus <> 'F') AS failed FROM orders GROUP BY ROLLUP (o_orderpriority)")
def sweep_summary(spark, d):
    return reports.sweep_summary(table(spark, d, "orders"), F.col("o_orderstatus") == "F", "o_orderpriority")


CODES = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 4 ELSE 7 END"


@query(f"SELECT {CODES} AS code, count(*) AS streams FROM orders GROUP BY 1")
def exit_distribution(spark, d):
    return reports.exit_distribution(table(spark, d, "orders").select(F.expr(CODES).alias("code")), "code")


@query("""WITH n AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events)
SELECT event_type, count(*) AS count, string_agg(event_id, ',' ORDER BY k) FILTER (k <= 3) AS examples FROM n GROUP BY event_type""")
def loss_ledger(spark, d):
    return reports.note_losses(events(spark, d), "event_type", ["event_id"]).withColumn("examples", F.array_join(F.transform("examples", lambda e: e["event_id"].cast("string")), ","))


@query("""WITH n AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY user_id % 10, event_id) AS k FROM events)
SELECT event_type, count(*) AS count, string_agg(event_id, ',' ORDER BY k) FILTER (k <= 3) AS examples FROM n GROUP BY event_type""")
def merged_ledgers(spark, d):
    parts = reports.note_losses(events(spark, d).withColumn("part", F.col("user_id") % 10), "event_type", ["event_id"], ["part"])
    return reports.merge_ledgers(parts, "event_type", "part").withColumn("examples", F.array_join(F.transform("examples", lambda e: e["event_id"].cast("string")), ","))


@query("""SELECT 'payload' AS grain, 'p_brand' AS field, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand
 UNION ALL SELECT 'payload', 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size
 UNION ALL SELECT 'element', 'words', w, count(*) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w""")
def payload_tally(spark, d):
    payloads = table(spark, d, "part").withColumn("words", F.split("p_name", " "))
    return reports.payload_tally(payloads, {"payload": ["p_brand", "p_size"], "element": ["words"]})


@query("SELECT l_linenumber, count(*) AS payloads, min(l_partkey) AS min_l_partkey, max(l_partkey) AS max_l_partkey, min(l_suppkey) AS min_l_suppkey, max(l_suppkey) AS max_l_suppkey FROM lineitem GROUP BY l_linenumber")
def id_ranges(spark, d):
    return reports.id_ranges(table(spark, d, "lineitem"), "l_linenumber", ["l_partkey", "l_suppkey"])


@query("""WITH n AS (SELECT o_custkey, o_orderstatus AS s, o_orderpriority AS p, lag(o_orderstatus) OVER w AS ls, lag(o_orderpriority) OVER w AS lp, row_number() OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, count(*) AS declarations, count(DISTINCT s || '/' || p) AS kinds, count(*) FILTER (k > 1 AND (s <> ls OR p <> lp)) AS changes FROM n GROUP BY o_custkey""")
def declaration_changes(spark, d):
    return reports.declaration_changes(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 25")
def first_containers(spark, d):
    return reports.first_records(events(spark, d).select("event_id", "user_id", "event_type"), ["event_id"], 25)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 4")
def first_payloads(spark, d):
    return reports.first_records(events(spark, d).select("user_id", "event_id"), ["event_id"], 4, ["user_id"])


@query("""SELECT l_orderkey, l_linenumber, epoch(o_orderdate)::BIGINT + l_suppkey % 64 + coalesce(CASE WHEN l_returnflag <> 'R' THEN l_partkey % 1536 END, 0) + l_linenumber * 32 AS position
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def payload_positions(spark, d):
    payloads = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("block"), F.when(F.col("l_returnflag") != "R", F.col("l_partkey") % 1536).alias("container"), (F.col("l_suppkey") % 64).alias("sample_offset"))
    starts = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.expr("cast(cast(cast(o_orderdate - timestamp_ntz'1970-01-01 00:00:00' AS interval second) AS decimal(20, 6)) AS long)").alias("base"))
    return reports.payload_positions(payloads, starts, ["unit"], "base", "container", 32).select(F.col("unit").alias("l_orderkey"), F.col("block").alias("l_linenumber"), "position")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber = 2")
def one_presentation(spark, d):
    return reports.one_presentation(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), 2, "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber = 1")
def one_programme(spark, d):
    return reports.one_programme(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), 1, "l_linenumber")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS l FROM events) WHERE l IS NULL OR l <> event_type""")
def without_duplicates(spark, d):
    return reports.without_duplicates(events(spark, d).select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], ["event_type"])


@query(f"WITH {E}, {UNIT} SELECT user_id, event_id FROM u WHERE unit = 3")
def one_unit(spark, d):
    return reports.one_unit(units(spark, d), 3).select("user_id", "event_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1")
def one_part(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_linenumber").alias("part"), "l_partkey")
    return reports.one_part(rows, 7, 1).select(F.col("group").alias("l_orderkey"), F.col("part").alias("l_linenumber"), "l_partkey")


def _kind(k: int) -> str:
    later = " ".join(f"WHEN m{i} >> {i} <> 0 AND (m{i} >> {k}) & 1 = 1 THEN 'downmix of {i}'" for i in range(k + 1, 4))
    earlier = " ".join(f"WHEN m{k} >> {i} <> 0 THEN 'copy of {i}'" for i in reversed(range(k)))
    return f"CASE WHEN m{k} >> {k} <> 0 THEN {f'CASE {later} ELSE {chr(39)}independent{chr(39)} END' if later else chr(39) + 'independent' + chr(39)} ELSE {f'CASE {earlier} ELSE {chr(39)}invalid{chr(39)} END' if earlier else chr(39) + 'invalid' + chr(39)} END AS kind_{k}"


@query(f"WITH m AS (SELECT p_partkey, p_size % 2 AS m0, p_partkey % 4 AS m1, p_partkey % 8 AS m2, (p_partkey // 8) % 16 AS m3 FROM part) SELECT p_partkey, {', '.join(map(_kind, range(4)))} FROM m")
def presentation_kinds(spark, d):
    masks = table(spark, d, "part").select("p_partkey", *(F.expr(x).cast("int").alias(f"m{k}") for k, x in enumerate(("p_size % 2", "p_partkey % 4", "p_partkey % 8", "p_partkey div 8 % 16"))))
    return reports.presentation_kinds(masks).drop("m0", "m1", "m2", "m3")


@query("""SELECT l_orderkey, coalesce(bit_or(CASE WHEN l_returnflag = 'R' THEN l_partkey % 16 END), 0) AS needed, (coalesce(bit_or(CASE WHEN l_returnflag = 'R' THEN l_partkey % 16 END), 0) >> 2) & 1 = 1 AS reads_2 FROM lineitem GROUP BY l_orderkey""")
def needed_parts(spark, d):
    rows = table(spark, d, "lineitem").withColumn("mask", F.col("l_partkey") % 16)
    return reports.needed_parts(rows, F.col("l_returnflag") == "R", "mask", ["l_orderkey"]).withColumn("reads_2", reports.reads_part(F.col("needed"), F.lit(2)))


@query("""WITH a AS (SELECT l_orderkey, max(l_partkey) FILTER (l_linenumber = 1) AS x, max(l_partkey) FILTER (l_linenumber = 2) AS y FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey),
b AS (SELECT l_orderkey, max(l_suppkey) FILTER (l_linenumber = 2) AS y, max(l_suppkey) FILTER (l_linenumber = 3) AS z FROM lineitem WHERE l_returnflag <> 'A' GROUP BY l_orderkey)
SELECT l_orderkey, a.x, coalesce(b.y, a.y) AS y, b.z FROM a FULL JOIN b USING (l_orderkey)""")
def channel_union(spark, d):
    rows = table(spark, d, "lineitem")
    a = rows.where("l_returnflag <> 'N'").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linenumber") == 1, F.col("l_partkey"))).alias("x"), F.max(F.when(F.col("l_linenumber") == 2, F.col("l_partkey"))).alias("y"))
    b = rows.where("l_returnflag <> 'A'").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linenumber") == 2, F.col("l_suppkey"))).alias("y"), F.max(F.when(F.col("l_linenumber") == 3, F.col("l_suppkey"))).alias("z"))
    return reports.channel_union([a, b], ["l_orderkey"], [["x", "y"], ["y", "z"]])


@query("""SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 2 THEN 2 WHEN count(*) FILTER (o_orderpriority LIKE '1%') > 0 THEN 7 WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN 4 ELSE 0 END AS exit_code FROM orders GROUP BY o_custkey""")
def member_exit_codes(spark, d):
    members = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("u"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    return reports.member_exit_codes(members, F.col("p") > 2, F.col("u") > 0, F.col("o") > 0, "o_custkey").select("o_custkey", "exit_code")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN count(*) OVER (PARTITION BY l_orderkey) > 1 THEN 'order' || l_orderkey || '.p' || l_linenumber || '.wav' ELSE 'order' || l_orderkey || '.wav' END AS name FROM lineitem""")
def output_names(spark, d):
    from pyspark.sql import Window

    several = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")) > 1
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reports.output_name(F.concat(F.lit("order"), F.col("l_orderkey").cast("string")), "p", F.col("l_linenumber"), "wav", several).alias("name"))


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def demux(spark, d):
    parts = reports.demux(events(spark, d), "event_type", ["click", "view"])
    out = [x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")) for x in parts.values()]
    return out[0].unionByName(out[1])


# -- ordered

# input steps by 40 and now and then more; a restart header at views, its output behind the input by a delay that now and then changes
CLOCKS = f"""{E}, {UNIT}, c AS (SELECT user_id, unit, CAST((unit * 40 + CASE WHEN event_id % 17 = 0 THEN 9 ELSE 0 END) % 65536 AS BIGINT) AS input,
 CASE WHEN event_type = 'view' THEN CAST((unit * 40 + 540 + CASE WHEN event_id % 5 = 0 THEN 12 ELSE 0 END) % 65536 AS BIGINT) END AS output, CAST(cents % 500 AS BIGINT) AS words, CASE WHEN event_id % 11 = 0 THEN 3000 ELSE 2800 END AS peak, CAST(event_id % 30 AS BIGINT) AS fifo, event_id % 13 = 0 AS input_jump FROM u)"""


def clocked_units(spark, d) -> DataFrame:
    u = units(spark, d)
    return u.select(
        "user_id", "unit", ((F.col("unit") * 40 + F.when(F.col("event_id") % 17 == 0, 9).otherwise(0)) % 65536).alias("input"),
        F.when(F.col("event_type") == "view", (F.col("unit") * 40 + 540 + F.when(F.col("event_id") % 5 == 0, 12).otherwise(0)) % 65536).alias("output"),
        (F.col("cents") % 500).alias("words"), F.when(F.col("event_id") % 11 == 0, 3000).otherwise(2800).alias("peak"), (F.col("event_id") % 30).alias("fifo"), (F.col("event_id") % 13 == 0).alias("input_jump"),
    )


def _mod(x: str) -> str:
    return f"((({x}) % 65536 + 65536) % 65536)"


@query(f"""WITH {CLOCKS},
l AS (SELECT *, lag(input) OVER w AS li, lag(words) OVER w AS lw, lag(peak) OVER w AS lp, lag(fifo) OVER w AS lf, max(CASE WHEN output IS NOT NULL THEN unit END) OVER (PARTITION BY user_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ru FROM c WINDOW w AS (PARTITION BY user_id ORDER BY unit)),
r AS (SELECT l.*, c.output AS ro, c.input AS ri FROM l LEFT JOIN c ON c.user_id = l.user_id AND c.unit = l.ru WHERE l.output IS NOT NULL),
a AS (SELECT *, coalesce(output = ro, false) AS duplicate, {_mod("output - (ro + (unit - ru) * 40)")} AS output_delta, {_mod("output - 40 - input")} AS advance, coalesce({_mod("ro - 40 - ri + (unit - 1 - ru) * 40 - li + ri")}, {_mod("output - 40 - input")}) AS prev_advance FROM r),
j AS (SELECT *, li IS NOT NULL AND (coalesce(output_delta <> 0, false) OR input_jump OR peak <> lp) AS judged, {_mod("40 + prev_advance - advance")} AS iv FROM a),
k AS (SELECT *, CASE WHEN judged THEN iv <> 0 AND advance <= prev_advance + 30 END AS advance_step, CASE WHEN judged THEN iv <> 0 AND prev_advance + 40 - lf >= 0 AND advance <= prev_advance + 40 - lf END AS fifo_duration,
 CASE WHEN judged THEN iv <> 0 AND advance <= 510 - 40 END AS within_75ms, CASE WHEN judged THEN iv <> 0 AND lw * 256 <= lp * iv END AS data_rate FROM j)
SELECT user_id, unit, duplicate, output_delta, advance, prev_advance, judged, advance_step, fifo_duration, within_75ms, data_rate, advance_step AND fifo_duration AND within_75ms AND data_rate AS valid FROM k""")
def restart_judgement(spark, d):
    return reports.restart_judgement(clocked_units(spark, d), ["user_id"], "unit", 40, 510, "fifo")


@query(f"""WITH {CLOCKS}, s AS (SELECT *, CASE WHEN input + 32768 < lag(input) OVER (PARTITION BY user_id ORDER BY unit) THEN 65536 ELSE 0 END AS s FROM c), t AS (SELECT *, input + CAST(sum(s) OVER (PARTITION BY user_id ORDER BY unit) AS BIGINT) AS t FROM s),
o AS (SELECT *, t - t % 65536 + output AS p, max(CASE WHEN output IS NOT NULL THEN unit END) OVER (PARTITION BY user_id ORDER BY unit) AS ru FROM t), q AS (SELECT *, p + CASE WHEN p + 32768 < t THEN 65536 WHEN p > t + 32768 THEN -65536 ELSE 0 END AS placed FROM o)
SELECT q.user_id, q.unit, r.placed + (q.unit - r.unit) * 40 - q.t AS delay FROM q LEFT JOIN q r ON r.user_id = q.user_id AND r.unit = q.ru""")
def trace_delays(spark, d):
    return reports.trace_delays(clocked_units(spark, d), ["user_id"], "unit", 40)


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'audio' WHEN 'purchase' THEN 'stream' WHEN 'view' THEN 'metadata' ELSE 'none' END AS scope,
 CASE event_type WHEN 'error' THEN CASE WHEN event_id % 6 < 5 THEN 1 << CAST(event_id % 6 AS INT) ELSE (1 << CAST(user_id % 4 + 1 AS INT)) - 1 END WHEN 'purchase' THEN (1 << CAST(user_id % 4 + 1 AS INT)) - 1 ELSE 0 END AS mask FROM events""")
def damage_scope(spark, d):
    scopes = spark.createDataFrame([("error", "audio"), ("purchase", "stream"), ("view", "metadata")], "event_type string, scope string")
    found = events(spark, d).withColumn("part", F.when(F.col("event_id") % 6 < 5, F.col("event_id") % 6))
    return reports.damage_scope(found, scopes, "event_type", "part", F.col("user_id") % 4 + 1).select("event_id", "scope", "mask")


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS s, l_orderkey // 50 AS g, l_linenumber AS k FROM lineitem WHERE l_linenumber <= 3), a AS (SELECT s, unnest(range(min(g), max(g) + 1)) AS g FROM p GROUP BY s), w AS (SELECT s, g, k FROM a, (VALUES (1), (2), (3)) v(k)),
l AS (SELECT s, k, max(g) AS last FROM p GROUP BY s, k)
SELECT w.s, w.g, w.k, coalesce(last > w.g, false) AS blocks FROM w LEFT JOIN p USING (s, g, k) LEFT JOIN l ON l.s = w.s AND l.k = w.k WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.s = w.s AND q.g = w.g AND q.k = w.k)""")
def stalled_groups(spark, d):
    parts = table(spark, d, "lineitem").where("l_linenumber <= 3").select(F.col("l_suppkey").alias("s"), F.expr("l_orderkey div 50").alias("g"), F.col("l_linenumber").alias("k"))
    return reports.stalled_groups(parts, ["s"], "g", "k", [1, 2, 3])


LAYOUT = "o AS (SELECT o_custkey, o_orderkey, o_orderkey // 3000 AS layout FROM orders)"


def layouts(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.expr("o_orderkey div 3000").alias("layout"))


@query(f"WITH {LAYOUT}, c AS (SELECT *, lag(layout) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <> layout AS c FROM o), p AS (SELECT *, count(*) FILTER (c) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS piece FROM c) SELECT o_custkey, o_orderkey, layout FROM p WHERE piece = 0")
def layout_stop(spark, d):
    return reports.layout_policy(layouts(spark, d), ["o_custkey"], ["o_orderkey"], "layout", "stop")


@query(f"WITH {LAYOUT} SELECT *, layout = first(layout) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS fits FROM o")
def layout_fixed(spark, d):
    return reports.layout_policy(layouts(spark, d), ["o_custkey"], ["o_orderkey"], "layout", "fixed")


@query(f"WITH {LAYOUT}, c AS (SELECT *, lag(layout) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <> layout AS c FROM o) SELECT o_custkey, o_orderkey, layout, count(*) FILTER (c) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS piece FROM c")
def layout_split(spark, d):
    return reports.layout_policy(layouts(spark, d), ["o_custkey"], ["o_orderkey"], "layout", "split")


@query("""WITH g AS (SELECT user_id, event_id, count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM events), a AS (SELECT user_id, grp, min(event_id) AS first_event_id, count(*) AS n FROM g WHERE grp > 0 GROUP BY user_id, grp)
SELECT user_id, grp AS "group", first_event_id, n, CASE WHEN grp = max(grp) OVER (PARTITION BY user_id) THEN 'end' ELSE 'successor' END AS released FROM a""")
def released_groups(spark, d):
    return reports.groups_with_release(events(spark, d), ["user_id"], ["event_id"], "event_type", "view")


# -- comparisons




def trees(spark, d) -> tuple[DataFrame, DataFrame]:
    e = events(spark, d).withColumn("r", F.col("event_id") % 7)
    text = lambda k, more, kind: F.concat(F.lit('{"a": {"k": '), k, F.lit(', "l": [1, 2'), more, F.lit("]}, "), kind, F.lit('"seconds": '), F.col("event_id").cast("string"), F.lit("}"))
    old = e.withColumn("json", text(F.col("user_id").cast("string"), F.lit(""), F.concat(F.lit('"t": "'), "event_type", F.lit('", '))))
    new = e.withColumn(
        "json",
        F.regexp_replace(
            text(
                F.when(F.col("r") == 1, F.lit('"x"')).when(F.col("r") == 2, (F.col("user_id") + 1).cast("string")).otherwise(F.col("user_id").cast("string")),
                F.when(F.col("r") == 3, F.lit(", 3")).otherwise(F.lit("")),
                F.when(F.col("r") == 4, F.lit("")).when(F.col("r") == 5, F.concat(F.lit('"n": {"deep": 1}, "t": "'), "event_type", F.lit('", '))).otherwise(F.concat(F.lit('"t": "'), "event_type", F.lit('", '))),
            ),
            '"seconds": ',
            '"seconds": 1',
        ),
    )
    return tuple(reports.json_tree(x, ["event_id"], "json") for x in (old, new))


CHANGED = """SELECT event_id, '$.a.k' AS path, 'type' AS kind, CAST(user_id AS VARCHAR) AS a, 'x' AS b FROM events WHERE event_id % 7 = 1
 UNION ALL SELECT event_id, '$.a.k', 'changed', CAST(user_id AS VARCHAR), CAST(user_id + 1 AS VARCHAR) FROM events WHERE event_id % 7 = 2
 UNION ALL SELECT event_id, '$.a.l', 'length', '2', '3' FROM events WHERE event_id % 7 = 3
 UNION ALL SELECT event_id, '$.t', 'removed', event_type, NULL FROM events WHERE event_id % 7 = 4"""


@query(CHANGED + " UNION ALL SELECT event_id, '$.n', 'added', NULL, '' FROM events WHERE event_id % 7 = 5")
def tree_diff(spark, d):
    return reports.tree_diff(*trees(spark, d), ["event_id"], ["seconds"])


@query(CHANGED)
def old_and_new(spark, d):
    return reports.tree_diff(*trees(spark, d), ["event_id"], ["seconds"], additions=False)


@query("""WITH b AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 9 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 20 <> 0)
SELECT p.p_partkey, b.p_partkey IS NOT NULL AND p.p_brand = b.p_brand AS agree_p_brand, b.p_partkey IS NOT NULL AND p.p_size = b.p_size AS agree_p_size, b.p_partkey IS NOT NULL AND p.p_brand = b.p_brand AND p.p_size = b.p_size AS agrees FROM part p LEFT JOIN b USING (p_partkey)""")
def field_agreement(spark, d):
    a = table(spark, d, "part")
    b = a.where("p_partkey % 20 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 9 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return reports.field_agreement(a, b, "p_partkey", ["p_brand", "p_size"])


@query("""WITH a AS (SELECT l_orderkey AS scene, CASE WHEN l_linenumber = 1 THEN l_returnflag END AS label, l_linenumber AS ordinal, l_partkey AS track FROM lineitem), b AS (SELECT l_orderkey AS scene, CASE WHEN l_linenumber = 1 THEN l_returnflag END AS label, l_linenumber AS ordinal, l_suppkey AS track FROM lineitem WHERE l_quantity > 10),
x AS (SELECT scene, CASE WHEN label IS NULL THEN 'object' ELSE 'bed' END AS role, coalesce(label, 'obj' || ordinal) AS name, track FROM a), y AS (SELECT scene, CASE WHEN label IS NULL THEN 'object' ELSE 'bed' END AS role, coalesce(label, 'obj' || ordinal) AS name, track FROM b)
SELECT scene, role, name, x.track AS track_a, y.track AS track_b FROM x LEFT JOIN y USING (scene, role, name)""")
def declared_pairs(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scene"), F.when(F.col("l_linenumber") == 1, F.col("l_returnflag")).alias("label"), F.col("l_linenumber").alias("ordinal"), "l_partkey", "l_suppkey", "l_quantity")
    return reports.declared_pairs(rows.withColumn("track", F.col("l_partkey")), rows.where("l_quantity > 10").withColumn("track", F.col("l_suppkey")), "label", "ordinal", "track", "scene")


@query("""WITH p AS (SELECT o_orderpriority, round(o_totalprice / 1000, 0) * 1000 AS a, o_totalprice AS b FROM orders) SELECT o_orderpriority, round(20 * log10(sqrt(avg(b * b)) / sqrt(avg((a - b) * (a - b)))), 2) AS sdr_db FROM p GROUP BY o_orderpriority""")
def distortion_ratio(spark, d):
    pairs = table(spark, d, "orders").select("o_orderpriority", (F.round(F.col("o_totalprice") / 1000) * 1000).alias("a"), F.col("o_totalprice").alias("b"))
    return reports.distortion_ratio(pairs, ["o_orderpriority"])


@query("""WITH a AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY user_id), b AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type IN ('error', 'view') AND event_id % 3 <> 0) AS bad FROM events WHERE event_id % 40 <> 0 GROUP BY user_id)
SELECT user_id, 'n' AS field, CAST(a.n AS DOUBLE) AS a, CAST(b.n AS DOUBLE) AS b FROM a FULL JOIN b USING (user_id) WHERE a.n IS DISTINCT FROM b.n UNION ALL SELECT user_id, 'bad', CAST(a.bad AS DOUBLE), CAST(b.bad AS DOUBLE) FROM a FULL JOIN b USING (user_id) WHERE coalesce(a.bad > b.bad, true)""")
def parity_faults(spark, d):
    e = events(spark, d)
    a = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    b = e.where("event_id % 40 <> 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type").isin("error", "view") & (F.col("event_id") % 3 != 0)).alias("bad"))
    return reports.parity_faults(a, b, "user_id", ["n"], ["bad"])


@query("""WITH s AS (SELECT p_brand, count(*) FILTER (p_size = 7) AS yes, count(*) FILTER (p_size <> 7) AS no FROM part GROUP BY p_brand), k AS (SELECT *, least(yes, no) AS k, yes + no AS n FROM s)
SELECT p_brand, yes, no, CASE WHEN k < 10 THEN CAST(round(list_aggregate(list_prepend(1.0::DOUBLE, list_transform(range(1, k + 1), lambda i: (n - i + 1)::DOUBLE / i)), 'product')) AS BIGINT) END AS ways FROM k""")
def small_side(spark, d):
    sides = table(spark, d, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") == 7).alias("yes"), F.count_if(F.col("p_size") != 7).alias("no"))
    return reports.small_side(sides).withColumn("ways", F.col("ways").cast("long"))


# -- catalogs, text, scalars


@query("""SELECT event_type, count(*) AS count, CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN 1 WHEN 'click' THEN 2 END AS position FROM events GROUP BY event_type""")
def in_catalog_order(spark, d):
    catalog = spark.createDataFrame([("view", 0), ("error", 1), ("click", 2)], "event_type string, position int")
    return reports.in_catalog_order(events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("count")), catalog, "event_type", "position")


@query("""SELECT 0 AS line, '| n_nationkey | n_name |' AS text UNION ALL SELECT 1, '|---|---|' UNION ALL SELECT CAST(row_number() OVER (ORDER BY n_nationkey) + 1 AS INT), '| ' || n_nationkey || ' | ' || n_name || ' |' FROM nation""")
def catalog_markdown(spark, d):
    return reports.catalog_markdown(table(spark, d, "nation"), "n_nationkey", ["n_nationkey", "n_name"])


@query("""WITH r AS (SELECT o_orderkey, ['status: ' || o_orderstatus, CASE WHEN o_custkey % 2 = 0 THEN 'customer: ' || o_custkey END] AS l FROM orders), f AS (SELECT o_orderkey, list_filter(l, lambda x: x IS NOT NULL) AS l FROM r)
SELECT o_orderkey, CAST(generate_subscripts(l, 1) - 1 AS INT) AS line, unnest(l) AS text FROM f""")
def text_report(spark, d):
    report = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("customer"))
    return reports.text_report(report, "o_orderkey", ["status", "customer"])


@query("""SELECT p_partkey, CASE p_size % 8 WHEN 1 THEN 'no back' WHEN 2 THEN 'no sides' WHEN 3 THEN 'center back' WHEN 4 THEN 'screen only' WHEN 5 THEN 'surround only' ELSE 'all' END AS zones, CASE p_partkey % 5 WHEN 0 THEN 'normal' WHEN 1 THEN 'warping' WHEN 2 THEN 'ProLogicIIx' WHEN 3 THEN 'LoRo' END AS warp,
 CASE p_size % 6 WHEN 0 THEN 'L' WHEN 1 THEN 'Lrs' WHEN 2 THEN 'LFE' WHEN 3 THEN 'Rrs' WHEN 4 THEN 'Vhc' END AS channel, ((p_size % 32 - 15) * 16 + p_partkey % 16) * 4 AS snr, round((p_size / 50.0 - 0.5) * 2, 9) AS x, round((0.5 - p_partkey % 100 / 100.0) * 2, 9) AS y FROM part""")
def names_and_offsets(spark, d):
    spelled = F.element_at(F.array(*(F.lit(x) for x in ("L", "Lb", "LFE", "Rb", "Vhc", "front"))), F.col("p_size") % 6 + 1)
    x, y, _ = reports.room_position(F.col("p_size") / 50.0, F.col("p_partkey") % 100 / 100.0, F.lit(0.0))
    return table(spark, d, "part").select("p_partkey", reports.zones_name(F.col("p_size") % 8).alias("zones"), reports.warp_name((F.col("p_partkey") % 5).cast("int")).alias("warp"), reports.channel_name(spelled).alias("channel"), reports.snr_offset(F.col("p_size") % 32, F.col("p_partkey") % 16).alias("snr"), F.round(x, 9).alias("x"), F.round(y, 9).alias("y"))


FACTS = "f AS (SELECT p_partkey, p_partkey % 3 <> 0 AS fba, CASE p_size % 6 WHEN 0 THEN 44100 WHEN 1 THEN 48000 WHEN 2 THEN 88200 WHEN 3 THEN 96000 WHEN 4 THEN 176400 ELSE 192000 END AS rate, p_partkey % 9 AS channels, p_partkey % 2 = 0 AS both_, p_partkey % 5 <> 0 AS marked, p_partkey * 8000 AS peak, p_partkey % 7 = 0 AS late FROM part)"


@query(f"""WITH {FACTS}, w AS (SELECT p_partkey, rate,
 list_filter([CASE WHEN NOT fba THEN 'syntax' END, CASE WHEN rate NOT IN (48000, 96000, 192000) THEN 'rate' END, CASE WHEN rate = 192000 AND channels > 6 THEN 'channels' END, CASE WHEN fba AND late THEN 'delivery' END], lambda x: x IS NOT NULL) AS b,
 list_filter([CASE WHEN rate IN (176400, 192000) AND channels > 2 THEN 'channels' END, CASE WHEN NOT fba AND NOT both_ THEN 'presentations' END, CASE WHEN fba AND late THEN 'delivery' END], lambda x: x IS NOT NULL) AS h,
 list_filter([CASE WHEN fba THEN 'syntax' END, CASE WHEN NOT fba AND NOT marked THEN 'mark' END, CASE WHEN NOT fba AND rate IN (176400, 192000) AND channels > 2 THEN 'channels' END, CASE WHEN NOT fba AND peak > 9600000 THEN 'peak' END], lambda x: x IS NOT NULL) AS v FROM f)
SELECT p_partkey, array_to_string(b, ',') AS not_blu_ray, array_to_string(h, ',') AS not_hd_dvd, array_to_string(v, ',') AS not_dvd_audio, CASE WHEN len(b) > 0 THEN 'no' ELSE 'yes' END AS fits_blu_ray,
 CASE WHEN len(h) > 0 THEN 'no' WHEN rate % 44100 = 0 THEN 'unjudged' ELSE 'yes' END AS fits_hd_dvd, CASE WHEN len(v) > 0 THEN 'no' ELSE 'yes' END AS fits_dvd_audio FROM w""")
def disc_fit(spark, d):
    rate = F.element_at(F.array(*(F.lit(x) for x in (44_100, 48_000, 88_200, 96_000, 176_400, 192_000))), F.col("p_size") % 6 + 1)
    key = F.col("p_partkey")
    facts = table(spark, d, "part").select("p_partkey", (key % 3 != 0).alias("fba"), rate.alias("rate"), (key % 9).alias("channels"), (key % 2 == 0).alias("both"), (key % 5 != 0).alias("marked"), (key * 8000).alias("peak"), (key % 7 == 0).alias("late"))
    out = reports.disc_fit(facts)
    return out.select("p_partkey", *(F.array_join(f"not_{x}", ",").alias(f"not_{x}") for x in ("blu_ray", "hd_dvd", "dvd_audio")), "fits_blu_ray", "fits_hd_dvd", "fits_dvd_audio")
