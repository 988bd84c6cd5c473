import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lower_words(text):
    return words((text or "").translate(LOWER))


#: Texts at the edges: null, empty, blank, one word, control and other white space, ties, very long.
ODD = [None, "", " \t\n\v\f\r ", "a", "A a A a", "é ß", "x y z", "\x00 \x01", "<|im_end|>", "q " * 6_000, "z" * 9_000, "same line of six words here\nsame line of six words here", "😀 日本語テキスト ▁"]


def odd_documents(spark):
    """ODD, each twice under one key and once under another, and rows without a key; with columns that clash with the operators' own names."""
    rows = []
    for i, t in enumerate(ODD):
        rows += [(i, t, "en", i), (i, t, "en", i), (1000 + i, t, None, None), (None, t, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").selectExpr(
        "*", "1 AS n_words", "2 AS score", "3 AS shard", "4 AS slot", "5 AS n_shingles", "'k' AS key", "6 AS n", "7 AS component", "8 AS sample", "9 AS kept", "10 AS line", "11 AS row", "12 AS item_id", "13 AS edits"
    )


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
