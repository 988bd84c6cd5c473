"""Quality rules: a decision list learned from labelled statistics, run as one conditional expression.

Statistics of every text are DataFrame functions over the whole text. The list is learned on
the driver from at most LABELLED labelled rows (those with the least hashes of their keys) by
sequential covering: a rule grows by the threshold condition of the greatest gain until it
covers no good row, is pruned from its end on rows that it didn't grow on, and is accepted if
its precision there holds; the rows that it covers go, and the next rule grows. The accepted
rules, in order, become CASE WHEN branches; the first that holds names the verdict.

Defined results: a null or empty text has no words and fails the base rule. A row whose key is null, or whose
label is null, teaches nothing; of several labels for a key each counts. Without labels of both kinds
the list is empty and the base rule alone decides. One row out for one row in, repeated keys too. A text of any
length is counted whole, in memory that grows with its own length. Of conditions with equal gains the first holds (by
feature, then above before below, then threshold); of prunings worth the same the shortest. An empty table gives an
empty one. Other columns are not read, whatever their names. Word windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import through_table

#: The most labelled rows that a list is learned from.
LABELLED = 20_000
SEPARATORS = r"[\x09-\x0D\x20]+"
WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with BASE and the further counts that rules may use (n_upper, n_marks, n_digits, n_lines, n_chars, n_echoes: words equal to the word before, n_distinct_words), all long. Write the result before filtering on it (as judge does): Spark would move the filter, and with it the arrays, below."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(F.col("_t"), SEPARATORS), lambda w: w != "")
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.trim(F.translate(x, "\t\v\f\r", "    ")) != "")
    step1 = docs.withColumn("_t", t).withColumn("_w", words).withColumn("_l", lines)
    step2 = step1.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
        F.length(F.regexp_replace("_t", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_t", r"[^!?]+", "")).cast("long").alias("n_marks"),
        F.length(F.regexp_replace("_t", r"[^0-9]+", "")).cast("long").alias("n_digits"),
        F.size("_l").cast("long").alias("n_lines"),
        F.length("_t").cast("long").alias("n_chars"),
    )
    at = F.when(F.size("_h") >= WINDOW, F.sequence(F.lit(0), F.size("_h") - WINDOW)).otherwise(F.array().cast("array<int>"))
    step3 = step2.withColumn("_v", F.transform(at, lambda i: F.xxhash64(*(F.get("_h", i + k) for k in range(WINDOW)))))
    step3 = step3.withColumn("n_echoes", F.size(F.filter("_h", lambda h, i: h.eqNullSafe(F.get("_h", i - 1)))).cast("long")).withColumn("n_distinct_words", F.size(F.array_distinct("_h")).cast("long")).drop("_h")
    # the windows in order of their hashes; those beside an equal one occur twice or more
    step4 = step3.withColumn("_s", F.when(F.size("_v") == F.size(F.array_distinct("_v")), F.array().cast("array<struct<v:bigint,i:int>>")).otherwise(F.sort_array(F.transform("_v", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))))
    again = F.filter("_s", lambda s, k: s["v"].eqNullSafe(F.get("_s", k - 1)["v"]) | s["v"].eqNullSafe(F.get("_s", k + 1)["v"]))
    step5 = step4.withColumn("_p", F.sort_array(F.transform(again, lambda s: s["i"]))).drop("_s", "_v")
    covered = F.aggregate(F.transform("_p", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - i, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return step5.withColumn("n_repeat_words", covered).drop("_p")


def failed_base() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


#: What rules compare, as SQL over the counts; each is a share or a mean, so a text's length alone decides nothing.
FEATURES = {
    "symbols per character": "n_symbols / greatest(word_chars, 1)",
    "capitals per character": "n_upper / greatest(word_chars, 1)",
    "exclamations per word": "n_marks / greatest(n_words, 1)",
    "digits per character": "n_digits / greatest(word_chars, 1)",
    "repeated lines per line": "n_dup_lines / greatest(n_lines, 1)",
    "repeated words per word": "n_repeat_words / greatest(n_words, 1)",
    "echoed words per word": "n_echoes / greatest(n_words, 1)",
    "distinct words per word": "n_distinct_words / greatest(n_words, 1)",
    "characters per word": "word_chars / greatest(n_words, 1)",
    "words per line": "n_words / greatest(n_lines, 1)",
    "words": "cast(n_words as double)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.above else '<'} {self.threshold!r}D"

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.4g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    n = len(next(iter(x.values())))
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: dict[str, np.ndarray]) -> Rule:
    """Adds the condition of the greatest information gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        best, gain = None, 1e-9
        for f, thresholds in cuts.items():
            v, b = x[f][inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], np.concatenate([[0], np.cumsum(b[order])])
            k = np.searchsorted(v, thresholds)
            for above in (True, False):
                pos = b[-1] - b[k] if above else b[k]
                all_ = len(v) - k if above else k
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pos > 0, pos * (np.log2(pos / np.maximum(all_, 1)) - np.log2(p / (p + n))), 0)
                j = int(np.argmax(g))
                if g[j] > gain:
                    best, gain = Condition(f, above, float(thresholds[j])), float(g[j])
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most on these rows: (p - n) / (p + n); the shortest of equals."""
    def worth(r):
        c = _covers(r, x)
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, *, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.95, at_least: int = 5) -> list[Rule]:
    """The decision list of the rows x (a column for each feature), of which `bad` are to be rejected; rows of fold 0 prune, the others grow."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    cuts = {}
    for f, v in x.items():
        d = np.unique(v)
        middle = (d[1:] + d[:-1]) / 2
        cuts[f] = middle if len(middle) <= 200 else np.unique(np.quantile(middle, np.linspace(0, 1, 200)))
    cuts = {f: c for f, c in cuts.items() if len(c)}
    while len(rules) < most_rules:
        grow, prune = left & (fold != 0), left & (fold == 0)
        if (grow & bad).sum() < at_least or not (prune & bad).any():
            break
        of = lambda rows: {f: v[rows] for f, v in x.items()}
        rule = _grow(of(grow), bad[grow], most_conditions, cuts)
        if not rule:
            break
        rule = _prune(rule, of(prune), bad[prune])
        hit = _covers(rule, of(prune))
        p, n = int((hit & bad[prune]).sum()), int((hit & ~bad[prune]).sum())
        if not p or p / (p + n) < precision:
            break
        rules.append(rule)
        left &= ~_covers(rule, x)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = F.expr(" AND ".join(c.sql() for c in rule))
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def sample_labels(labels: DataFrame, key: str = "doc_id", label: str = "quality", most: int = LABELLED) -> DataFrame:
    """_k and _y of at most `most` labelled rows, those with the least hashes of their keys."""
    return labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where("_k is not null and _y is not null").orderBy(F.xxhash64(F.lit(1), "_k"), "_k", "_y").limit(most)


def where_kept(counted: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of with_statistics that neither fail the base rule nor meet a learned one. The row number keeps Spark from moving the test below the statistics, where it would work them out again for every condition."""
    return counted.withColumn("_row", F.monotonically_increasing_id()).where((F.col("_row") >= 0) & ~failed_base() & verdict(rules).isNull()).drop("_row")


def fit_rules(counted: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", most: int = LABELLED) -> list[Rule]:
    """Learns which rows have label 0. counted: with_statistics, written; it may hold the rows of sample_labels alone. labels: key and label."""
    picked = sample_labels(labels, key, label, most)
    features = [F.expr(e).cast("double").alias(f"f{i}") for i, e in enumerate(FEATURES.values())]
    joined = counted.where(~failed_base()).join(F.broadcast(picked), F.col(key) == F.col("_k"))  # `most` rows of two numbers at most
    rows = joined.select("_k", "_y", F.pmod(F.xxhash64(F.lit(2), "_k"), F.lit(3)).alias("fold"), *features).orderBy("_k", "_y").limit(2 * most).collect()
    if not rows:
        return []
    x = {f: np.array([r[f"f{i}"] for r in rows]) for i, f in enumerate(FEATURES)}
    bad = np.array([r["_y"] == 0 for r in rows])
    if bad.all() or not bad.any():
        return []
    return learn(x, bad, np.array([r["fold"] for r in rows]))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts of each row, base_failed, kept, and rule: the number of the learned rule that rejects it."""
    counted = through_table(with_statistics(docs.select(F.col(key), F.col(text).alias("_text")), "_text").drop("_text"), "rules")
    rules = fit_rules(counted, labels, key)
    return (
        counted.withColumn("base_failed", failed_base())
        .withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, labels).select("doc_id", *BASE, "base_failed", "kept", "rule")
