"""Line dedup: of lines that are equal, or one word apart, the earliest in the corpus stays.

A line counts if it has a word (MIN_WORDS = 1; in lower case, A to Z); one of NEAR_WORDS or more
is also a copy of an earlier line that one inserted, deleted or changed word makes of it.

1. Every line becomes a row of hashes. Equal lines are grouped; each keeps its earliest place.
2. Lines that one word edit separates share either their first or their last half (of the
   longer's length less one, rounded down). Lines that share no half with another go no further;
   this drops nothing that could match.
3. The others emit their deletion neighbourhood: the hash of the line and of it without each
   word, with the deleted word's number. Two lines with the same variant at the same number
   differ in that word alone; a line that is another's variant lacks one word of it. So the
   earliest of each group is enough to tell, for every line in it, whether an earlier one is
   near: a group's rows are reduced by a minimum, never paired.
4. The lines of each pair so found are compared word by word before one goes.

Order is (key, hash of key and text, line number), null keys first. Rows with one key and text
are one document here: what goes from one goes from the other.

Not done: a bound that grows with a line's length. Long lines two or more edits apart both stay.

Defined results: a null or empty text has no lines that count, and stays; so do blank lines. A line that stays keeps its bytes.
A text of any length is done whole, in memory that grows with its own length. Where lines go, the rest is joined as it stood. Columns of the documents are kept, whatever their
names but for those that begin with "_ld_". An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import LOWER, U64, Words, chunks, mix64, powers, sequence_hashes, sequence_sums, small_batches
from ._shared import HashArrays, begin_stage, shard_column, shards_for, shared_folder, sizes_of, text_bytes, through_table, write_shard

MIN_WORDS, NEAR_WORDS = 1, 5
#: Bytes of text that are worked on at once.
CHUNK = 1 << 20
_LENGTH = U64(0x632BE59BD9B4E019)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lines(data: np.ndarray, offsets: np.ndarray):
    """Of a chunk's lines that count: the words' hashes and their sums; first and last word, text, and number in the text."""
    words = Words(LOWER[data], offsets, breaks=10)
    hashes = words.hashes()
    text = np.repeat(np.arange(len(words.per_text)), words.per_text)
    number = np.arange(len(text)) - np.repeat(np.cumsum(words.per_text) - words.per_text, words.per_text)
    long = np.flatnonzero(words.counts >= MIN_WORDS)
    return hashes, sequence_sums(hashes), words.bounds[long], words.bounds[long + 1], text[long], number[long]


def _halves(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Four keys for each line; two lines that one word edit separates share one of them."""
    n = b - a
    out = []
    for longer in (n, n + 1):
        c = (longer - 1) // 2
        for side, (s, e) in enumerate(((a, a + c), (b - c, b))):
            out.append(mix64(sequence_hashes(sums, s, e) ^ (U64(2) * longer.astype(U64) + U64(side)) * U64(0x9E3779B97F4A7C15)))
    return np.stack(out, 1)


def _place(row_hash: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mix64(row_hash.astype(np.int64).view(U64) + number.astype(U64) * U64(0x9E3779B97F4A7C15))


def line_table(docs: DataFrame) -> DataFrame:
    """_ld_row (hash of key and text), _ld_key, number, line (hash), near (whether long enough), halves. docs: _ld_text, _ld_key, _ld_row."""
    kind = docs.schema["_ld_key"].dataType.simpleString()

    def made(batches):
        begin_stage("lines")
        for batch in small_batches(batches, CHUNK):
            rows = np.asarray(batch.column(2))
            for first, data, offsets in chunks(batch.column(0)):
                _, sums, a, b, text, number = _lines(data, offsets)
                near = b - a >= NEAR_WORDS - 1
                halves = _halves(sums, a[near], b[near]).reshape(-1)
                cuts = np.concatenate([[0], np.cumsum(near * 4)]).astype(np.int32)
                at = pa.array(first + text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(at), pa.array(rows[first + text]), pa.array(number.astype(np.int32)), _signed(sequence_hashes(sums, a, b)), pa.ListArray.from_arrays(pa.array(cuts), _signed(halves))],
                    ["key", "row", "number", "line", "halves"],
                )

    return docs.select("_ld_text", "_ld_key", "_ld_row").mapInArrow(made, f"key {kind}, row long, number int, line long, halves array<long>")


def _variants(docs: DataFrame, uri: str, sizes: list[int]) -> DataFrame:
    """For the chosen lines, at their earliest places: variant, slot (-1: the line itself, with its words), key, row, number, line."""
    kind = docs.schema["_ld_key"].dataType.simpleString()

    def made(batches):
        begin_stage(uri)
        chosen = HashArrays.at(uri, sizes, {"place": "u8"})
        for batch in small_batches(batches, CHUNK):
            rows = np.asarray(batch.column(2))
            for first, data, offsets in chunks(batch.column(0)):
                hashes, sums, a, b, text, number = _lines(data, offsets)
                line = sequence_hashes(sums, a, b)
                distinct, back = np.unique(line, return_inverse=True)
                found, place = chosen.find(distinct, "place")
                on = np.flatnonzero(found[back] & (place[back] == _place(rows[first + text], number)))
                if not len(on):
                    continue
                a, b, text, number, line = a[on], b[on], text[on], number[on], line[on]
                n = b - a
                cuts = np.where(n >= NEAR_WORDS, n, 0)  # a line of one word fewer can only lack a word of a longer one
                who = np.repeat(np.arange(len(n)), cuts)
                slot = np.arange(len(who)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                r = powers(len(sums) + 1, True)
                s, cut, e = a[who], a[who] + slot, b[who]
                left = (sums[cut] - sums[s]) * r[s] + (sums[e] - sums[cut + 1]) * r[s + 1]
                variant = mix64(left + (n[who] - 1).astype(U64) * _LENGTH)
                who = np.concatenate([np.arange(len(n)), who])
                slot = np.concatenate([np.full(len(n), -1), slot])
                variant = np.concatenate([line, variant])
                raw = [hashes[x:y].tobytes() for x, y in zip(a, b, strict=True)] + [None] * (len(who) - len(n))
                yield pa.RecordBatch.from_arrays(
                    [_signed(variant), pa.array(slot.astype(np.int32)), batch.column(1).take(pa.array(first + text[who])), pa.array(rows[first + text[who]]), pa.array(number[who].astype(np.int32)), _signed(line[who]), pa.array(raw, pa.binary())],
                    ["variant", "slot", "key", "row", "number", "line", "words"],
                )

    return docs.select("_ld_text", "_ld_key", "_ld_row").mapInArrow(made, f"variant long, slot int, key {kind}, row long, number int, line long, words binary")


def word_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Levenshtein's distance of two sequences, or most + 1 if it is greater: only the cells within `most` of the diagonal are worked out."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before = {j: j for j in range(min(most, len(b)) + 1)}
    for i in range(1, len(a) + 1):
        now: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                now[j] = i
                continue
            now[j] = min(before.get(j - 1, most + 1) + (a[i - 1] != b[j - 1]), before.get(j, most + 1) + 1, now.get(j - 1, most + 1) + 1)
        before = now
    return min(before.get(len(b), most + 1), most + 1)


def _verified(pairs: DataFrame) -> DataFrame:
    """The lines (and those that they copy) of pairs whose words are one edit apart."""

    def kept(batches):
        for batch in batches:
            ok = [word_distance(np.frombuffer(x, U64), np.frombuffer(y, U64), 1) <= 1 for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            on = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(on), batch.column(1).take(on)], ["line", "of"])

    return pairs.select("line", "of", "words", "of_words").mapInArrow(kept, "line long, of long")


def find_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each line that goes: key, row, number, near (false: an equal line is earlier)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(text).cast("string").alias("_ld_text"), F.col(key).alias("_ld_key"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("_ld_row"))
    lines = through_table(line_table(docs), "lines")
    place = F.struct("key", "row", "number")
    firsts = through_table(lines.groupBy("line").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("halves").alias("halves")), "firsts")

    halves = firsts.select("line", F.explode("halves").alias("half"))
    shared = through_table(halves.groupBy("half").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a < b").select("half"), "halves")
    chosen = halves.join(shared, "half", "left_semi").select("line").distinct().join(firsts.select("line", "first"), "line")

    uri, shards = shared_folder(spark, "chosen-lines"), shards_for(spark, text_bytes(docs, "_ld_text"))

    def store(group, table):
        keys = np.asarray(table["line"]).view(U64)
        order = np.argsort(keys)
        places = _place(np.asarray(table["row"]), np.asarray(table["number"]))
        write_shard(uri, group[0].as_py(), key=keys[order], place=places[order])
        return pa.table({"shard": pa.array([group[0].as_py()], pa.int32()), "n": pa.array([len(keys)], pa.int64())})

    rows = chosen.select(shard_column(F.col("line"), shards).alias("shard"), "line", "first.row", "first.number").groupBy("shard").applyInArrow(store, "shard int, n long").collect()  # a row for each shard
    variants = through_table(_variants(docs, uri, sizes_of(rows, shards)), "variants")
    own = variants.where("slot = -1").select("line", place.alias("at"), "words")
    less = variants.where("slot >= 0").select("variant", "slot", "line", place.alias("at"))
    earliest = F.min(F.struct("at", "line")).alias("e")
    # one word changed: the same variant at the same slot
    classes = through_table(less.groupBy("variant", "slot").agg(earliest, F.max("line").alias("m"), F.min("line").alias("n")).where("m <> n").select("variant", "slot", "e"), "classes")
    changed = less.join(classes, ["variant", "slot"]).where("e.line <> line").select("line", F.col("e.at").alias("of_at"), F.col("e.line").alias("of"))
    # one word fewer in the other: its own hash is this line's variant
    own_at = own.select(F.col("line").alias("variant"), F.col("line").alias("of"), F.col("at").alias("of_at"))
    fewer = less.join(own_at, "variant").where("of_at < at").select("line", "of_at", "of")
    # one word more in the other: the earliest of those whose variant is this line
    more = less.groupBy("variant").agg(earliest).join(own.select(F.col("line").alias("variant"), "line", "at"), "variant").where("e.at < at").select("line", F.col("e.at").alias("of_at"), F.col("e.line").alias("of"))
    pairs = changed.unionByName(fewer).unionByName(more).distinct()
    worded = own.select("line", "words")
    pairs = pairs.join(worded, "line").join(worded.select(F.col("line").alias("of"), F.col("words").alias("of_words")), "of")
    near = _verified(pairs).groupBy("line").agg(F.lit(True).alias("near"))

    flagged = through_table(firsts.join(near, "line", "left").where("near or first <> last").select("line", "first", F.coalesce("near", F.lit(False)).alias("near")), "flagged")
    return lines.drop("halves").join(flagged, "line").where(F.col("near") | (place != F.col("first"))).select("key", "row", "number", (F.col("near") & (place == F.col("first"))).alias("near"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, the text without the lines that go, and _ld_lines, _ld_equal, _ld_near: how many lines the text had, and how many went as equal or near."""
    # of rows that repeat key and text each names the same lines: a set, so that they count once, and no list grows with their number
    gone = find_copies(docs, key, text).groupBy("row").agg(F.collect_set(F.struct("number", "near")).alias("_ld_set"))
    gone = gone.select("row", F.col("_ld_set.number").alias("_ld_gone"), F.size(F.filter("_ld_set", lambda x: ~x["near"])).alias("_ld_equal"), F.size(F.filter("_ld_set", lambda x: x["near"])).alias("_ld_near"))
    marked = docs.withColumn("_ld_row", F.xxhash64(F.col(key).cast("string"), F.col(text).cast("string")))
    joined = marked.join(gone.withColumnRenamed("row", "_ld_row"), "_ld_row", "left")
    split = F.split(F.col(text).cast("string"), "\n")
    left = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("_ld_gone", i)), "\n")
    return (
        joined.withColumn("_ld_lines", F.coalesce(F.size(split), F.lit(0)).cast("long"))
        .withColumn(text, F.when(F.col("_ld_gone").isNull(), F.col(text)).otherwise(left))
        .select(*docs.columns, "_ld_lines", F.coalesce("_ld_equal", F.lit(0)).cast("long").alias("_ld_equal"), F.coalesce("_ld_near", F.lit(0)).cast("long").alias("_ld_near"))
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_equal").alias("n_equal"), F.col("_ld_near").alias("n_near"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


#: Words joined by a space stand for a line; `slot` is the place of the word that a variant lacks.
OP4_SQL = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS number FROM documents),
split_ AS (SELECT *, list_filter(regexp_split_to_array(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM pieces),
lines AS (SELECT *, len(w) AS n, array_to_string(w, ' ') AS line, row_number() OVER (ORDER BY doc_id, number) AS place FROM split_),
firsts AS (SELECT line, any_value(w) AS w, any_value(n) AS n, min(place) AS first FROM lines WHERE n > 0 GROUP BY line),
variants AS (SELECT line, n, first, slot, array_to_string(list_concat(w[1 : slot - 1], w[slot + 1 : n]), ' ') AS v FROM (SELECT *, unnest(range(1, n + 1)) AS slot FROM firsts WHERE n >= 5)),
changed AS (SELECT v, slot, min(first) AS e FROM variants GROUP BY v, slot),
near AS (
  SELECT line FROM variants JOIN changed USING (v, slot) WHERE e < first
  UNION SELECT a.line FROM variants a JOIN firsts b ON a.v = b.line WHERE b.first < a.first
  UNION SELECT b.line FROM variants a JOIN firsts b ON a.v = b.line WHERE a.first < b.first),
judged AS (SELECT l.*, l.n > 0 AND l.place > f.first AS is_equal, l.place = f.first AND l.line IN (SELECT line FROM near) AS is_near FROM lines l LEFT JOIN firsts f USING (line))
SELECT doc_id, any_value(n_lines) AS n_lines, count(*) FILTER (is_equal) AS n_equal, count(*) FILTER (is_near) AS n_near,
  md5(coalesce(string_agg(raw, chr(10) ORDER BY number) FILTER (NOT coalesce(is_equal, false) AND NOT coalesce(is_near, false)), '')) AS text_md5 FROM judged GROUP BY doc_id
"""
