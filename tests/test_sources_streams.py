import io
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstream.functions import dsp, scalars
from siltstream.operators import clocks, compare, findings, islands, joins, merge, selection, timeline
from siltstream.sources import lossless, media, reports, scenes
from siltstream.streaming import streams


def frame(r, extended=False, number=0, kind=0):
    if extended:
        words = r.randrange(8, 60)
        head = bytes([kind << 6 | number << 3 | words >> 8, words & 255, 0 << 6 | 3 << 4, 16 << 3])
        size = 2 * (words + 1)
    else:
        code = r.randrange(8)
        head = bytes([0, 0, 0 << 6 | code, 8 << 3])
        size = 2 * (media.KILOBITS[code >> 1] * 2)
    body = bytes(r.randrange(1, 11) for _ in range(size - 6))  # no sync word inside
    return media.SYNC + head + body


def test_framing_resyncs_and_reports_gaps():
    r = random.Random(1)
    parts, data, expected = [], b"", []
    for i in range(40):
        if i in (0, 7, 20):
            junk = bytes(r.randrange(20, 90) for _ in range(r.randrange(1, 30))) + (media.SYNC + b"\x01\x02" if i == 7 else b"")
            # no sync word follows the frame before, so it doesn't count
            lost = expected.pop() if expected else ("", 0, 0)
            del parts[-1:]
            expected.append(("gap", lost[1], lost[2] + len(junk)))
            data += junk
        f = frame(r, i % 3 == 0, i % 4, i % 2)
        expected.append(("frame", len(data), len(f)))
        data += f
        parts.append(f)
    data += media.SYNC + b"\x00"
    rows = list(media.frame_rows("x", io.BytesIO(data)))
    got = [(x[3], x[2], len(x[4]) if x[4] is not None else x[10]) for x in rows]
    assert got[:-1] == expected and rows[-1][3] == "gap" and rows[-1][10] is None
    assert [x[4] for x in rows if x[3] == "frame"] == parts
    for block in (1, 7, 1000):  # the same however the bytes come
        assert list(media.frames(io.BytesIO(data), block)) == list(media.frames(io.BytesIO(data)))
    assert list(media.frames(io.BytesIO(b""))) == [] and list(media.frames(io.BytesIO(b"abc"))) == [(0, b"", None)]


def test_frame_sizes_of_the_standard():
    assert media.frame_header(media.SYNC + bytes([0, 0, 0b01_000001, 8 << 3])).size == 2 * 70
    assert media.frame_header(media.SYNC + bytes([0, 0, 0b01_000000, 8 << 3])).size == 2 * 69
    assert media.frame_header(media.SYNC + bytes([0, 0, 0b00_100100, 8 << 3])).size == 2 * 1280
    assert media.frame_header(media.SYNC + bytes([0, 0, 0b11_000000, 8 << 3])) is None


def test_frame_source(spark, tmp_path):
    r = random.Random(2)
    for name in ("a.ac3", "b.ec3", "c.txt"):
        (tmp_path / name).write_bytes(b"".join(frame(r, name[0] == "b", kind=i % 2) for i in range(9)))
    spark.dataSource.register(media.FrameSource)
    got = spark.read.format("ac3family").option("suffixes", ".ac3,.ec3").load(str(tmp_path))
    assert got.groupBy(F.right("path", F.lit(5)).alias("p")).count().orderBy("p").collect() == [("a.ac3", 9), ("b.ec3", 9)]
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.ec3")
    same = media.frames_of(files)
    keep = ["unit", "offset", "kind", "bytes"]
    assert same.select(keep).orderBy("unit").collect() == got.where("path like '%ec3'").select(keep).orderBy("unit").collect()
    grouped = merge.groups(same, ["path"], ["unit"], F.col("stream_type") == 0)
    assert grouped.agg(F.max("group")).first()[0] == 5


def test_checksums_are_repaired(spark):
    r = random.Random(8)
    frames = [frame(r, k % 2 == 0) for k in range(6)]
    for f in frames:
        fixed = media.repaired(f)
        assert media.checksums_hold(fixed) == (True, True) and media.repaired(fixed) == fixed
        changed = [k for k, (a, b) in enumerate(zip(f, fixed, strict=True)) if a != b]
        assert set(changed) <= {2, 3, len(f) - 2, len(f) - 1}
    df = spark.createDataFrame([(f,) for f in [*frames, b"none", None, media.repaired(frames[0])]], "bytes binary")
    got = media.repaired_frames(df).collect()
    assert [x.changed for x in got[6:]] == [False, False, False] and all(media.checksums_hold(bytes(x.bytes))[1] for x in got[:6])


def test_pcm_and_containers(spark, tmp_path):
    r = np.random.default_rng(1)
    v = r.integers(-(1 << 23), 1 << 23, 600).astype(np.int32)
    assert (media.decode_pcm(media.encode_pcm(v, 24), "s24le") == v).all() and (media.decode_pcm(media.encode_pcm(v, 32), "s32le") == v).all()
    assert (media.decode_pcm(media.encode_pcm(v, 16), "s16le") == v >> 8 << 8).all()
    assert media.decode_pcm(b"\xff\xff\xfe\x00", "s24be").tolist() == [-2]
    df = spark.createDataFrame([(i // 3, i % 3, int(x)) for i, x in enumerate(v) if i // 3 != 50], "position long, channel int, sample int")
    path = tmp_path / "x.wav"
    assert media.write_audio(df, lambda: open(path, "wb"), 3, 48_000) == 200
    data = path.read_bytes()
    chunks = {n: (o, s) for n, o, s in media.riff_chunks(data)}
    o, s = chunks["data"]
    expected = v.copy()
    expected[150:153] = 0
    assert (media.decode_pcm(data[o : o + s], "s24le") == expected).all() and len(data) == struct.unpack_from("<I", data, 4)[0] + 8
    back = media.read_pcm(spark, str(path), "s24le", 3, o)
    pairs = compare.positional(df, back.select("position", "channel", "sample"), ["position", "channel"], "sample", "sample")
    assert compare.mismatch_report(pairs).first().asDict() == {"compared": 597, "mismatches": 0, "only_a": 0, "only_b": 3, "equal": False}
    media.write_audio(df, lambda: open(tmp_path / "x.caf", "wb"), 3, 48_000, container="caf")
    assert [r.id for r in media.chunk_table(spark, str(tmp_path)).orderBy("path", "number").collect()] == ["desc", "data", "fmt ", "data"]
    large = media.wave_header(16, 48_000, 24, 1 << 31)
    assert large[:4] == b"RF64" and media.riff_chunks(large)[-1][2] == (1 << 31) * 48
    assert media.wave_header(2, 48_000, 16, None)[4:8] == b"\xff" * 4


def access_unit(r, timing, substreams, major):
    """A well-formed unit: header, perhaps a major sync, directory, body."""
    body = bytes(r.randrange(128) for _ in range(2 * r.randrange(4, 30)))
    sync = b""
    if major:
        info = bytearray(lossless.SYNCS[0] + bytes(r.randrange(100) for _ in range(22)))
        info[8:10], info[16], info[25] = b"\xb7\x52", substreams << 4, 0
        sync = bytes(info) + scalars.crc16_after_shift(bytes(info)).to_bytes(2, "big")
    directory = b"".join((k + 1).to_bytes(2, "big") for k in range(substreams))
    words = (4 + len(sync) + len(directory) + len(body)) // 2
    head = bytearray([words >> 8, words & 255, timing >> 8, timing & 255])
    x = 0
    for b in bytes(head) + directory:
        x ^= b
    head[0] |= ((x ^ x >> 4) & 15 ^ 15) << 4
    return bytes(head) + sync + directory + body


def test_access_units_are_framed_and_resynced(spark):
    r = random.Random(6)
    units = [access_unit(r, i * 40, 2, i % 8 == 0) for i in range(32)]
    data = b"junk!" + b"".join(units[:5]) + bytes([units[5][0], units[5][1], units[5][2], units[5][3] ^ 1]) + units[5][4:] + b"".join(units[6:])
    got = list(lossless.units(io.BytesIO(data)))
    kept = units[:5] + units[8:]  # the sixth's parity fails; the next major sync is the ninth's
    assert [u.data for u in got if not u.gap_only] == kept
    first, ninth = got[0], next(u for u in got if u.data == units[8])
    assert first.gap == 5 and first.major_sync and first.timing == 0
    assert ninth.resynced and ninth.gap == sum(map(len, units[5:8]))
    for block in (1, 64, 5000):
        assert [(u.offset, u.data, u.gap) for u in lossless.units(io.BytesIO(data), block)] == [(u.offset, u.data, u.gap) for u in got]
    broken = bytearray(units[0] + units[1])
    broken[4 + 12] ^= 1  # the sync's checksum fails, and no other follows
    (only,) = lossless.units(io.BytesIO(bytes(broken)))
    assert only.gap_only and only.gap == len(broken) and only.crc_failures == 1
    files = spark.createDataFrame([("x", data), ("y", b"")], "path string, content binary")
    table = lossless.units_of(files)
    assert table.where("kind = 'unit'").count() == len(kept)
    spaced = clocks.unwrap(table.where("kind = 'unit'"), ["path"], ["unit"], "timing")
    assert spaced.agg(F.max("unwrapped")).first()[0] == 31 * 40


def test_signal_functions():
    g = np.random.default_rng(2)
    x = g.integers(-1000, 1000, 300)
    coefficients = [5, -3, 1]
    residual = dsp.predict_residual(x, coefficients, 2)
    assert (dsp.predict_restore(residual, coefficients, 2) == x).all()
    n = 64
    window = np.sin(np.pi * (np.arange(2 * n) + 0.5) / (2 * n))
    signal = g.normal(size=n * 10)
    out = dsp.overlap_add([dsp.imdct(dsp.mdct(signal[a : a + 2 * n] * window)) * window for a in range(0, len(signal) - n, n)])
    assert np.allclose(out[n:-n], signal[n : len(out) - n])
    noise = g.normal(size=500)
    assert dsp.best_lag(noise[20:], noise, 40) == 20
    matrix = dsp.interpolated_matrices(np.zeros((2, 3)), np.ones((2, 3)), 4)
    assert np.allclose(matrix[:, 0, 0], [0.25, 0.5, 0.75, 1.0])
    mixed = dsp.mix(np.ones((4, 3, 5)), matrix)
    assert mixed.shape == (4, 2, 5) and np.allclose(mixed[-1], 3)
    assert (dsp.band_map(np.array([0, 2, 5]), 8) == [0, 0, 1, 1, 1, 2, 2, 2]).all()
    assert dsp.rematrix(np.array([[100, -7], [3, 9]]), np.array([[1 << 14, 1 << 13], [0, 1 << 14]]), 14).tolist() == [[96, -7], [7, 9]]


def test_signals_by_stream(spark):
    rows = [(s, t, [float(t == 0)] * 4) for s in (1, 2) for t in range(3)]
    df = spark.createDataFrame(rows, "s long, t long, c array<double>")
    got = dsp.transform_streams(df, "s", "t", "c")
    assert got.groupBy("s").agg(F.sum(F.size("samples"))).orderBy("s").collect() == [(1, 12), (2, 12)]


def test_reports(spark, tmp_path):
    (tmp_path / "m.txt").write_text("- ID: 1\n  pos: 0\n  x: 1.5\n- ID: 2\n  pos: 0\n- ID: 1\n  pos: 5\n")
    got = reports.read_key_values(spark, str(tmp_path / "m.txt"))
    assert [(r.event, r.id, r.key, r.value) for r in got.where("key <> 'ID'").orderBy("event", "key").collect()] == [(1, "1", "pos", "0"), (1, "1", "x", "1.5"), (2, "2", "pos", "0"), (3, "1", "pos", "5")]
    events = spark.createDataFrame([(1, 0, 5, "a"), (1, 1, 5, "b"), (2, 2, 7, None), (1, 3, 6, "b")], "e int, t int, pos int, name string")
    reports.write_key_values(events, "e", ["t"], ["pos", "name"], str(tmp_path / "kv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "kv").glob("part-*")))
    assert text == "- ID: 1\n  pos: 5\n  name: a\n- ID: 1\n  name: b\n- ID: 2\n  pos: 7\n- ID: 1\n  pos: 6\n"
    todo, path = spark.range(10).withColumnRenamed("id", "k"), str(tmp_path / "out")
    work = lambda df: df.withColumn("v", F.col("k") * 2)
    assert reports.collect_resumed(todo.where("k < 4"), path, ["k"], work) == 4
    assert reports.collect_resumed(todo, path, ["k"], work) == 6
    assert reports.collect_resumed(todo, path, ["k"], work) == 0
    assert reports.read_json_lines(spark, path).count() == 10


def test_scenes(spark, tmp_path):
    block = '<audioBlockFormat audioBlockFormatID="AB_0003100{c}_0000000{b}" rtime="00:00:0{b}.50000" duration="00:00:01.00000"><position coordinate="X">-0.5</position><position coordinate="Y">1</position>{g}</audioBlockFormat>'
    blocks = "".join(block.format(c=c, b=b, g="<gain>0.5</gain>" if b == 2 else "") for c in (1, 2) for b in (1, 2))
    (tmp_path / "s.xml").write_text(f'<root><audioObject audioObjectID="AO_1001" name="a"><ref>AC_1</ref><ref>AC_9</ref></audioObject>{blocks}</root>')
    got = scenes.read_blocks(spark, str(tmp_path / "s.xml"), 48_000).orderBy("channel", "block").collect()
    assert [(r.channel, r.block, r.start, r.duration, r.x, r.y, r.z, r.gain) for r in got][:2] == [("00031001", 1, 72_000, 48_000, -0.5, 1.0, None, 1.0), ("00031001", 2, 120_000, 48_000, -0.5, 1.0, None, 0.5)]
    assert len(got) == 4 and timeline.tiling_faults(scenes.read_blocks(spark, str(tmp_path / "s.xml"), 48_000), ["channel"], "start", "duration").count() == 0
    (o,) = scenes.read_elements(spark, str(tmp_path / "s.xml"), "audioObject", ["audioObjectID", "name"], ["ref"]).collect()
    assert (o.audioObjectID, o.name, o.ref) == ("AO_1001", "a", ["AC_1", "AC_9"])
    (tmp_path / "d.txt").write_text("object 3: x=1 gain=-0.5\nnothing\nbed: mask=7")
    assert [(r.line, r.item, r.field, r.value) for r in scenes.read_dump(spark, str(tmp_path / "d.txt")).orderBy("line", "field").collect()] == [(0, "object 3", "gain", "-0.5"), (0, "object 3", "x", "1"), (2, "bed", "mask", "7")]


def test_scalars(spark):
    data = [(b"123456789",), (b"",), (None,)]
    df = spark.createDataFrame(data, "b binary")
    assert scalars.crc(b"123456789", 0x1021, 16) == 0x31C3
    assert [r[0] for r in df.select(scalars.crc_column(F.col("b"), 0x1021, 16)).collect()] == [0x31C3, 0, None]
    assert [r[0] for r in df.select(scalars.parity_column(F.col("b"))).collect()] == [0x31, 0, None]
    m = b"some bytes"
    assert scalars.crc16_after_shift(m + struct.pack(">H", scalars.crc(m, scalars.CRC16_MLP, 16))) == 0
    row = spark.range(1).select(
        scalars.timecode_samples(F.lit("01:00:02.5"), 48_000).alias("a"), scalars.timecode_samples(F.lit("1:2"), 48_000).alias("b"), scalars.timecode_text(F.lit(172_920_000), 48_000).alias("c"), scalars.duration_text(F.lit(3723.4567)).alias("d"),
        scalars.hex_dump(F.lit(b"\x0b\x77")).alias("e"), scalars.decibels(F.lit(0.0)).alias("f"), scalars.gain(F.lit(-20.0)).alias("g"), scalars.nibble_parity(F.lit(0xA5)).alias("h"), scalars.average_bit_rate(F.lit(1000), F.lit(0.0)).alias("i"), scalars.wrapped_difference(F.lit(5), F.lit(65_530)).alias("j"), clocks.ceil_div(F.lit(7), F.lit(2)).alias("k"), scalars.peak_bit_rate(F.lit(3), F.lit(48_000)).alias("l"),
    ).first()
    assert row[:5] == (172_920_000, None, "01:00:02.50000", "1:02:03.457", "0b 77")
    assert row.f == float("-inf") and math.isclose(row.g, 0.1) and (row.h, row.i, row.j, row.k, row.l) == (15, None, 11, 4, 9000)


def test_catalog_and_counts(spark):
    catalog = spark.createDataFrame([("a", "error", ["x"]), ("a", "info", None), ("b", "bad", None), ("c", "fatal", None)], "rule string, severity string, provenance array<string>")
    assert {tuple(r) for r in findings.catalog_faults(catalog).collect()} == {("a", "id used twice"), ("b", "unknown severity"), ("c", "error without provenance")}
    none = catalog.limit(0).withColumn("count", F.lit(0))
    assert findings.verdict(none, "info").first() == (None, True)
    assert findings.at_severity(none).first() == (0, 0, 0, 0)
    some = spark.createDataFrame([("a", i) for i in range(7)], "rule string, at int")
    assert findings.exemplars(some, "rule", ["at"], 0).count() == 7 and findings.exemplars(some, "rule", ["at"], 3).count() == 3


def test_greedy_pairs_and_titles(spark):
    rows = [(1, "a", "x", 0.9), (1, "a", "y", 0.8), (1, "b", "x", 0.85), (1, "b", "y", 0.1), (2, "a", "x", 0.5), (2, "b", "x", 0.5)]
    got = selection.greedy_pairs(spark.createDataFrame(rows, "s int, l string, r string, v double"), "s", "l", "r", "v")
    assert {tuple(r)[:3] for r in got.collect()} == {(1, "a", "x"), (1, "b", "y"), (2, "a", "x")}
    names = ["/m/Some.Title.1999.rest.mkv", "2001 A Title (1968).mkv", "No year.ec3", "1984.mkv"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(*selection.title_and_year(F.col("n")))
    assert [tuple(r) for r in df.collect()] == [("Some Title", 1999), ("2001 A Title", 1968), ("No year", None), ("1984", None)]
    with pytest.raises(ValueError):
        selection.clauses(df, ["nothing"])


def test_titles_before_a_known_release(spark):
    names = ["Room.1984.part.mkv", "Room.1984.1999.1080p.x.mkv", "Room 1984 (1999) [WEB] x.mkv", "Room (1999).mkv", "Room.1999.mkv", "Room.1999.1080person.mkv", "2012.2009.WEB.mkv"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(*selection.title_and_year(F.col("n"), r"\[?(?:\d{3,4}p|WEB)\]?"))
    assert [tuple(r) for r in df.collect()] == [("Room 1984 part", None), ("Room 1984", 1999), ("Room 1984", 1999), ("Room", 1999), ("Room", 1999), ("Room 1999 1080person", None), ("2012", 2009)]


def test_sequences_wrap(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate([5, 6, 1023, 1, 2, 0, 1, 3])], "at int, n int").withColumn("s", F.lit(1))
    got = clocks.sequence_gaps(rows, ["s"], ["at"], "n", wrap_after=1023).orderBy("at").collect()
    assert [(r.at, r.kind) for r in got] == [(2, "gap"), (5, "restart"), (7, "gap")]


def test_parts_close_one_by_one(spark):
    rows = [(1, 0, 0, 0), (1, 1, 3, 0), (1, 2, 0, 1), (1, 3, 0, 4), (1, 4, 1, 2), (1, 5, 0, 1), (1, 6, 2, 0), (1, 7, 0, 0)]
    df = spark.createDataFrame(rows, "s int, unit long, damaged int, restarted int")
    got = [tuple(r) for r in islands.until_all_restart(df, "s", "unit", "damaged", "restarted").orderBy("first_unit").collect()]
    assert got == [(1, 1, 3, 4, 3), (1, 4, 4, 5, 1), (1, 6, 7, None, 2)]


def test_delta_and_fill_are_inverse(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(i % 3, i, r.randrange(3)) for i in range(90)], "e int, t int, v int")
    sparse = timeline.delta_encode(df, ["e"], ["t"], ["v"])
    assert sparse.where("v is null").count() > 10
    assert sorted(timeline.forward_fill(sparse, ["e"], ["t"], ["v"]).collect()) == sorted(df.collect())


def test_reconcile_accounts_for_every_state(spark):
    r = random.Random(4)
    a = [(1, t, 1.0) for t in r.sample(range(1000), 150)]
    b = [(1, t + r.choice([0, 0, 2, 50]), r.choice([1.0, 2.0])) for _, t, _ in a[20:]]
    b = list({t: (s, t, v) for s, t, v in b}.values())
    got = joins.reconcile(*(spark.createDataFrame(x, "k int, t long, v double") for x in (a, b)), ["k"], "t", "v", 5, 0.0)
    kinds = {x.kind: x["count"] for x in got.groupBy("kind").count().collect()}
    assert kinds["matched"] + kinds["value_mismatch"] + kinds["time_mismatch"] + kinds["missing"] == len(a)


@pytest.fixture
def batches(spark, tmp_path):
    """A stream of rows, cut into files as asked."""

    def make(rows, schema, cuts):
        folder = tmp_path / f"in{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        edges = [0, *cuts, len(rows)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(f"{folder}/{k:03d}")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))

    return make


def run(spark, df, mode="append"):
    name = f"out{zlib.crc32(str(id(df)).encode())}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams_dont_depend_on_cuts(spark, batches):
    r = random.Random(5)
    rows = [(i % 3, i, r.choice("abc"), r.choice([0, 0, 1, 2, 3]), r.choice([0, 1, 2, 3])) for i in range(60)]
    schema = "s long, t long, kind string, damaged int, restarted int"
    whole = spark.createDataFrame(rows, schema)
    for cuts in ([30], [7, 8, 41]):
        changes = run(spark, streams.change_stream(batches(rows, schema, cuts), "s", "t", "kind"))
        expected = timeline.changes(whole, ["s"], ["t"], ["kind"]).select("s", "t", "kind", "previous_kind")
        assert sorted(map(str, changes.collect())) == sorted(map(str, expected.collect()))
    groups = run(spark, streams.group_stream(batches(rows, schema, [20, 40]), "s", "t", "kind", "a"))
    numbered = merge.groups(whole, ["s"], ["t"], F.col("kind") == "a").where("group > 0").groupBy("s", "group").agg(F.min("t").alias("first"), F.count("*").alias("n"))
    last = numbered.groupBy("s").agg(F.max("group").alias("last"))
    closed = numbered.join(last, "s").where("group < last").select("s", "group", "first", "n")
    assert sorted(map(tuple, groups.select("s", "group", "first", "n").collect())) == sorted(map(tuple, closed.collect()))
    regions = run(spark, streams.region_stream(batches(rows, schema, [11]), "s", "t", "damaged", "restarted"))
    batch = islands.until_all_restart(whole, "s", "t", "damaged", "restarted").where("entry_unit is not null")
    assert sorted(map(tuple, regions.collect())) == sorted(map(tuple, batch.collect()))
    tally = run(spark, streams.running_tally(batches(rows, schema, [13]), "kind", F.col("damaged")), "complete")
    assert sorted(map(tuple, tally.collect())) == sorted(map(tuple, whole.groupBy("kind").agg(F.count("*"), F.sum("damaged")).collect()))
