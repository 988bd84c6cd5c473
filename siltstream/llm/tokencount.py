"""Token counts by a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton finds every piece that ends at each byte; dynamic programming
carries the best score and its number of pieces. The rules are those of the public unigram
encoder: one mark before the text, ties go to the piece that began first (so to the longest
last piece), a character that is no piece costs the least score less 10 and counts as its
bytes. Scores are the vocabulary file's own.

The text is cut where no piece can reach across, and each distinct run of a chunk is
counted once; sums of runs are sums of texts, so nothing is lost by the cut. Sums are kept in 64 bits,
by which counts are the installed public encoder's for texts of any length (the tests hold whole documents against it).

Defined results: a null text or an empty one has 0 tokens and score 0; a text of any length
is done whole, in memory that grows with its own length only. Repeated rows and keys, and null keys, stay as
they are: one row out for one row in. An empty table gives an empty one. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import chunks, small_batches, span_hashes
from ._pieces import Vocabulary, automaton, marked, shared_automaton
from ._shared import begin_stage

#: The vocabulary's place; no file of it is in this repository.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_tokens and token_score for each row of docs."""
    kind = docs.schema[key].dataType.simpleString()
    uri = shared_automaton(docs.sparkSession, vocabulary)

    def counted(batches):
        begin_stage(uri)
        machine = automaton(uri)
        for batch in small_batches(batches):
            texts = marked(batch.column(0))
            for first, data, offsets in chunks(texts):
                start, end, bounds = machine.units(data, offsets)
                _, at, back = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
                score, count = machine.best(data, start[at], end[at])
                sums = [np.concatenate([[0], np.cumsum(x[back])]) for x in (count, score)]
                rows = batch.column(1).slice(first, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([rows, *(pa.array(x[bounds[1:]] - x[bounds[:-1]]) for x in sums)], [key, "n_tokens", "token_score"])

    return docs.select(F.col(text).cast("string").alias("_text"), F.col(key)).mapInArrow(counted, f"`{key}` {kind}, n_tokens long, token_score double")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), Vocabulary.read(PIECES))
