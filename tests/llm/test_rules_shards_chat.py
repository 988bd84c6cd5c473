import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from common import empty_documents, odd_documents, words
from pyspark.sql import functions as F

from siltstream.llm import chat, decontam, rules, sharding
from siltstream.llm._shared import through_table


# -- quality rules


def plain_statistics(text):
    text = text or ""
    w = words(text)
    at = {}
    for k in range(len(w) - 7):
        at.setdefault(tuple(w[k : k + 8]), []).append(k)
    covered = {x for ks in at.values() if len(ks) > 1 for k in ks for x in range(k, k + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, sf_dir):
    r = random.Random(2)
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10_000 + i, " ".join(r.choice("ab") for _ in range(r.randrange(60))) + r.choice(["", "\n\nx y\nx y\n \v\n \v", "   "])) for i in range(100)]
    got = through_table(rules.with_statistics(spark.createDataFrame(docs, "doc_id long, text string")), "test")
    found = {x.doc_id: tuple(x[c] for c in rules.BASE) for x in got.collect()}
    for i, t in docs:
        assert found[i] == plain_statistics(t), t


def test_a_list_is_learned_and_spares_the_good():
    r = np.random.default_rng(1)
    n = 3000
    x = {f: r.random(n) for f in rules.FEATURES}
    a, b = list(rules.FEATURES)[:2]
    bad = (x[a] > 0.8) & (x[b] < 0.5) | (x[b] > 0.97)
    found = rules.learn(x, bad, np.arange(n) % 3)
    hit = np.zeros(n, bool)
    for rule in found:
        hit |= rules._covers(rule, x)
    assert (hit & bad).sum() > 0.95 * bad.sum() and (hit & ~bad).sum() < 0.01 * n
    assert {c.feature for rule in found for c in rule} <= {a, b}
    assert not rules.learn(x, r.random(n) < 0.2, np.arange(n) % 3)  # nothing to be learned: no rule


def plain_list(rows, most_rules=12, most_conditions=4, precision=0.95, at_least=5):
    """The decision list of rows (values by feature, bad, fold), row by row: [[(feature, above, threshold)]]."""
    cuts = {}
    for f in rows[0][0]:
        d = sorted({x[f] for x, _, _ in rows})
        middle = [(a + b) / 2 for a, b in zip(d, d[1:])]
        cuts[f] = middle if len(middle) <= 200 else sorted(set(np.quantile(middle, np.linspace(0, 1, 200)).tolist()))

    def holds(c, x):
        return x[c[0]] >= c[2] if c[1] else x[c[0]] < c[2]

    def counts(rule, some):
        hit = [bad for x, bad, _ in some if all(holds(c, x) for c in rule)]
        return sum(hit), len(hit) - sum(hit)

    out, left = [], list(rows)
    while len(out) < most_rules:
        grow, prune = [r for r in left if r[2] != 0], [r for r in left if r[2] == 0]
        if sum(r[1] for r in grow) < at_least or not any(r[1] for r in prune):
            break
        rule, inside = [], grow
        while len(rule) < most_conditions:
            p = sum(r[1] for r in inside)
            n = len(inside) - p
            if not p or not n:
                break
            best, gain = None, 1e-9
            for f, thresholds in cuts.items():
                for above in (True, False):
                    for t in thresholds:
                        pos, neg = counts([(f, above, t)], inside)
                        g = pos * (np.log2(pos / (pos + neg)) - np.log2(p / (p + n))) if pos else 0
                        if g > gain + 1e-9:
                            best, gain = (f, above, t), g
            if best is None:
                break
            rule.append(best)
            inside = [r for r in inside if holds(best, r[0])]
        if not rule:
            break

        def worth(k):
            p, n = counts(rule[:k], prune)
            return ((p - n) / (p + n) if p + n else -1.0, -k)

        rule = rule[: max(range(1, len(rule) + 1), key=worth)]
        p, n = counts(rule, prune)
        if not p or p / (p + n) < precision:
            break
        out.append(rule)
        left = [r for r in left if not all(holds(c, r[0]) for c in rule)]
    return out


def test_the_list_is_a_plain_learners():
    learned = 0
    for seed in range(8):
        r = random.Random(seed)
        names = list(rules.FEATURES)[:3]
        rows = []
        for i in range(150):
            x = {f: r.randrange(12) / 4 for f in names}
            bad = (x[names[0]] > 1.5 and x[names[1]] < 1.5) or x[names[2]] > 2.4
            rows.append((x, bool(bad) != (r.random() < 0.03), i % 3))
        got = rules.learn({f: np.array([x[f] for x, _, _ in rows]) for f in names}, np.array([b for _, b, _ in rows]), np.array([k for _, _, k in rows]))
        assert [[(c.feature, c.above, c.threshold) for c in rule] for rule in got] == plain_list(rows)
        learned += len(got)
    assert learned > 8


def test_verdicts_of_the_table_are_plain(spark, sf_dir):
    """Every row's verdict, from its text and the list alone."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    counted = through_table(rules.with_statistics(docs.select("doc_id", "text")).drop("text"), "test")
    found = rules.fit_rules(counted, labels)
    assert found
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}

    def plain_values(text):
        n_words, word_chars, n_symbols, n_dup, n_repeat = plain_statistics(text)
        w, lines = words(text), [x for x in text.split("\n") if words(x)]
        chars, n = max(word_chars, 1), max(n_words, 1)
        return dict(zip(rules.FEATURES, (
            n_symbols / chars, sum("A" <= c <= "Z" for c in text) / chars, sum(c in "!?" for c in text) / n, sum("0" <= c <= "9" for c in text) / chars, n_dup / max(len(lines), 1), n_repeat / n,
            sum(a == b for a, b in zip(w, w[1:])) / n, len(set(w)) / n, word_chars / n, n_words / max(len(lines), 1), float(n_words),
        ), strict=True)), n_words < 20 or 100 * n_repeat > 30 * n_words

    expected = {}
    for i, t in texts.items():
        x, failed = plain_values(t)
        hit = next((k for k, rule in enumerate(found, 1) if all(x[c.feature] >= c.threshold if c.above else x[c.feature] < c.threshold for c in rule)), None)
        expected[i] = (failed, not failed and hit is None, None if failed else hit)
    assert {r.doc_id: (r.base_failed, r.kept, r.rule) for r in rules.op5_quality_rules(spark, sf_dir).collect()} == expected


def test_verdicts_follow_the_list(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest tables have too few labels to learn from
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = rules.op5_quality_rules(spark, sf_dir)
    assert got.count() == docs.count()
    judged = got.join(labels, "doc_id")
    assert judged.where("quality = 1 and not base_failed and not kept").count() == 0
    assert judged.where("quality = 0 and kept").count() <= 0.1 * judged.where("quality = 0").count()
    assert got.where("base_failed <> (n_words < 20 or 100 * n_repeat_words > 30 * n_words) or (base_failed and kept)").count() == 0


def test_judging_odd_and_empty_tables(spark):
    df = odd_documents(spark)
    labels = spark.createDataFrame([(1, 0, None), (None, 1, 0), (5, None, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = rules.judge(df, labels)
    assert got.count() == df.count() and got.where("kept is null or base_failed is null").count() == 0
    assert rules.judge(empty_documents(spark), labels).count() == 0
    assert rules.judge(df, labels.limit(0)).where("kept and base_failed").count() == 0


# -- sharding


def test_shards(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "cast(id as string) AS text")
    got = sharding.shard_documents(df).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(8)]
    assert min(sizes) > 400 and max(sizes) < 600
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    moved = [r for r in got if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {8} and 300 < len(moved) < 600
    assert all(r.size == len(str(r.doc_id)) + 1 and r.text_crc32 == zlib.crc32(str(r.doc_id).encode()) for r in got)
    # the draws, by hand
    for r in got[:200]:
        draw = [int(hashlib.md5(f"{r.doc_id}:{s}".encode()).hexdigest()[:13], 16) for s in range(8)]
        assert r.shard == draw.index(max(draw))


def test_weighted_and_closed_shards(spark):
    df = spark.range(6000)
    share = lambda w: {r.s: r.n for r in df.select(sharding.shard_for(F.col("id"), w).alias("s")).groupBy("s").agg(F.count("*").alias("n")).collect()}
    a, b = share([1, 2, 3]), share([1, 0, 3])
    assert abs(a[1] - 2000) < 200 and abs(a[2] - 3000) < 200
    assert b[0] >= a[0] and b[2] >= a[2] and 1 not in b
    with pytest.raises(ValueError):
        sharding.shard_for(F.col("id"), [0, -1])


def test_rows_that_repeat_a_thousandfold(spark):
    """Without a key, or equal in all: each gets a slot of its own."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    got = sharding.shard_documents(df)
    assert got.count() == 6000 and got.where("doc_id is null").select("shard").distinct().count() == 1
    slots = got.groupBy("shard").agg(F.count_distinct("slot").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.count(F.lit(1)).alias("c")).collect()
    assert all((x.n, x.a, x.b) == (x.c, 0, x.c - 1) for x in slots)


def test_sharding_odd_and_empty_tables(spark):
    df = odd_documents(spark)
    got = sharding.shard_documents(df).collect()
    assert len(got) == df.count()
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 0} == {(1, 0)}
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    for s in range(8):
        n = sum(r.shard == s for r in got)
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert sharding.shard_documents(empty_documents(spark)).count() == 0


# -- chat


def plain_digest(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    mine = "".join(t or "" for r, t in turns if r == "assistant")
    return hashlib.sha256(said.encode()).hexdigest(), len(mine), hashlib.sha256(mine.encode()).hexdigest()


def test_conversations_are_read_back(spark):
    r = random.Random(3)
    bits = ["<|im_end|>", "<|im_start|>", "<", "|", ">", "\\", "\n", "assistant", "<|nl|>", "<\\|", "é", " "]
    rows, by = [], {}
    for c in range(80):
        for t in range(r.randrange(1, 8)):
            role = r.choice(["user", "assistant", "system", "a\nb", "<|x|>", None])
            text = r.choice([None, "".join(r.choice(bits) for _ in range(r.randrange(12)))])
            rows.append((c if c else None, t, role, text))
            by.setdefault(c if c else None, []).append((role, text))
    r.shuffle(rows)
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit(-1)))
    for x in got.collect():
        turns = by[x.conv_id]
        assert x.n_turns == len(turns) and (x.turns_sha256, x.loss_chars, x.loss_sha256) == plain_digest(turns)
        whole, spans = chat.render(chat.CHATML, [{"role": a or "", "text": b or ""} for a, b in turns])
        assert x.formatted_chars == len(whole)
        assert chat.unescape("".join(whole[a:b] for a, b in spans)) == "".join(b or "" for a, b in turns if a == "assistant")
    assert got.count() == len(by)
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_conversations_with_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got = chat.op3_chat_formatting(spark, sf_dir).toPandas().sort_values("conv_id").reset_index(drop=True)
    expected = duckdb.sql(chat.OP3_SQL).df().sort_values("conv_id").reset_index(drop=True)[list(got.columns)]
    assert got.equals(expected) and got.conv_id[0] == -1


def test_ties_and_long_conversations_stream(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, None, "z"), (1, None, "user", "first")] + [(2, i, "assistant", "x" * 50) for i in range(30_000)]
    got = {x.conv_id: x for x in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].turns_sha256 == plain_digest([("user", "first"), (None, "z"), ("user", "a"), ("user", "b")])[0]
    assert got[2].loss_chars == 1_500_000


def test_templates():
    run = lambda t, m=(): chat.render(t, list(m))[0]
    assert run("{% set a = 'x' %}{{ a + 'y' | upper }}{{ 1 + 2 }}{{ none }}") == "xY3"
    assert run("{% for m in messages %}{% if loop.first %}[{% elif m.text == 'b' %};{% else %},{% endif %}{{ m['text'] }}{% endfor %}", [{"text": x} for x in "abc"]) == "[a;b,c"
    assert run("{% if not (true and false) or 1 > 2 %}yes{% endif %}{# no #}") == "yes"
    folded = chat.fold(chat.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}{% if false %}e{% endif %}"))
    assert folded == [chat.Text("abCd")]
    assert run("{{ messages.__class__ }}{{ x.y.z }}") == ""
    for bad in ("{{ open('x') }}", "{{ a | system }}", "{% for x %}{% endfor %}", "{% if a %}", "{{ 1 + }}", "{% endfor %}", "{{ a[0] }}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


# -- decontamination


def plain_distance(pattern, text):
    """Least edit distance of the pattern to any part of text."""
    d = np.zeros(len(text) + 1, int)
    for i, x in enumerate(pattern, 1):
        p, d = d, np.full(len(text) + 1, i)
        for j, y in enumerate(text, 1):
            d[j] = min(p[j - 1] + (x != y), p[j] + 1, d[j - 1] + 1)
    return int(d.min())


def plain_match(pattern, text):
    """The least edits within the budget, or None; of a pattern too short to have one: 0 where it stands between no letters or digits."""
    if len(pattern) >= 10:
        e = plain_distance(pattern, text)
        return e if e <= len(pattern) // 10 else None
    ends = (k + len(pattern) for k in range(len(text)) if text.startswith(pattern, k) and not text[:k][-1:].isalnum())
    return 0 if any(not text[e : e + 1].isalnum() for e in ends) else None


def edited(r, text, n):
    for _ in range(n):
        k, c = r.randrange(len(text) + 1), r.random()
        text = text[:k] + (r.choice("abcd ") if c < 0.7 else "") + text[k + (c < 0.4 or c >= 0.7) :]
    return text


def test_matches_are_those_within_the_budget(spark):
    r = random.Random(4)
    items = [(i, "".join(r.choice("abcd ") for _ in range(r.choice([2, 3, 9, 10, 19, 25, 40, 63])))) for i in range(14)] + [(20, None), (21, "")]
    docs = []
    for i in range(90):
        t = "".join(r.choice("abcd ") for _ in range(r.randrange(60)))
        for _ in range(r.randrange(3)):
            _, item = r.choice(items[:14])
            t += edited(r, item or "a", r.choice([0, 1, 2, 4, 6, 8])).replace(" ", r.choice([" ", "\n ", "  "]))
            t += "".join(r.choice("abcd ") for _ in range(r.randrange(20)))
        docs.append((i, t.upper() if i % 5 == 0 else t))
    expected = {}
    for i, t in docs:
        for k, p in items:
            p = decontam.normal(p)
            if p and (e := plain_match(p, decontam.normal(t))) is not None:
                expected[i, k] = e
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (decontam.BLOCK, 60):  # in one block of items, and in several
        got = decontam.find_items(*frames, most=most).collect()
        assert {(x.doc_id, x.item_id): x.edits for x in got} == expected and len(got) == len(expected)
    assert 10 < len(expected) and len(set(expected.values())) > 2
    assert any(len(decontam.normal(dict(items)[k])) < 10 for _, k in expected)


def test_short_items_are_found_whole(spark):
    items = spark.createDataFrame([(1, "What is 2 + 2? Four."), (2, "a"), (3, "日本語")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "So: what is  2 + 2?\nFOUR."), (2, "cat bar"), (3, "(a)"), (4, "x 日本語。"), (5, "日本語学")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_items(docs, items).collect()} == {(1, 1), (3, 2), (4, 3)}


def test_decontamination_of_odd_and_empty_tables(spark):
    df = odd_documents(spark)
    items = spark.createDataFrame([(1, "z" * 300), (1, "z" * 300), (None, "q " * 40), (3, None)], "item_id long, text string").selectExpr("*", "1 AS doc_id")
    got = decontam.find_items(df, items).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(10, 1), (1010, 1), (None, 1), (9, None), (1009, None), (None, None)}
    assert decontam.find_items(empty_documents(spark), items).count() == 0
    assert decontam.find_items(df, items.limit(0)).count() == 0
