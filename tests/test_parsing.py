"""Bits, containers, headers, object audio, and what reports and streams do at their edges."""

import io
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_sources_streams import access_unit

from siltstream.functions import scalars
from siltstream.operators import reports
from siltstream.sources import containers, lossless, media, objects, scenes
from siltstream.sources.bits import BitReader, BitWriter
from siltstream.streaming import run, streams


@given(st.lists(st.tuples(st.integers(0, 2**40 - 1), st.integers(40, 50)), max_size=8), st.integers(0, 10**9), st.integers(1, 12))
def test_bits_come_back(fields, value, n):
    w = BitWriter()
    for v, bits in fields:
        w.write(v, bits)
    r = BitReader(w.variable(value, n).bytes())
    assert [r.read(bits) for _, bits in fields] == [v for v, _ in fields] and r.variable(n) == value
    with pytest.raises(EOFError):
        r.read(64)


def test_signed_bits():
    assert [BitReader(bytes([x])).signed(8) for x in (0, 127, 128, 255)] == [0, 127, -128, -1]
    assert BitReader(b"\xf0").signed(4) == -1 and BitReader(b"").signed(0) == 0


optional = lambda s: st.none() | s
payloads = st.builds(
    containers.Payload, id=st.integers(1, 200), data=st.binary(max_size=300), sample_offset=optional(st.integers(0, 2047)), duration=optional(st.integers(0, 10**6)), group=optional(st.integers(0, 500)), codec=optional(st.integers(0, 255))
)


@settings(deadline=None)
@given(st.builds(containers.Container, version=st.integers(0, 40), key=st.integers(0, 60), payloads=st.lists(payloads, max_size=4)), st.binary(max_size=6), st.binary(max_size=6))
def test_containers_come_back(container, before, after):
    data = containers.write_container(container)
    found = list(containers.walk(data))
    assert found[0] == (0, container, None)
    inside = [c for at, c, _ in containers.walk(before + data + after) if at == len(before) and c]
    assert inside == [container] or containers.SYNC[0] in before


def test_containers_that_cannot_be_read(spark):
    whole = containers.write_container(containers.Container(payloads=[containers.Payload(3, b"abc", priority=4, allowed=1, discard=False, sample_offset=7)]))
    assert next(containers.walk(whole))[1].payloads[0].priority == 4
    shifted = bytes([*whole[:3], whole[3] + 1, *whole[4:], 0])
    rows = [("cut", whole[:-1]), ("long", shifted), ("none", b"xyz"), ("null", None), ("two", whole + b"\0" + whole), ("empty", containers.write_container(containers.Container()))]
    got = containers.containers_of(spark.createDataFrame(rows, "name string, content binary"), ["name"], "content").collect()
    said = {(r.name, r.at, r.error is None, r.payload_id) for r in got}
    assert {("cut", 0, False, None), ("long", 0, False, None), ("two", 0, True, 3), ("two", len(whole) + 1, True, 3), ("empty", 0, True, None)} <= said
    assert not {r.name for r in got} & {"none", "null"}


def test_directories_and_configurations():
    unit = bytes(4) + bytes.fromhex("c005 1e00 2007".replace(" ", ""))
    first, second = lossless.directory(unit, 0, 2)
    assert (first.end, first.extra_word, first.restart, first.crc, first.gain) == (10, True, False, False, 0x1E00 >> 7)
    assert (second.end, second.extra_word, second.restart, second.crc) == (14, False, True, True)
    with pytest.raises(EOFError):
        lossless.directory(unit, 0, 3)
    with pytest.raises(ValueError):
        lossless.stream_config(lossless.SYNCS[0] + b"\xf0" + bytes(20))


def test_restart_headers_come_back():
    r = random.Random(3)
    for _ in range(50):
        n = r.randrange(1, 8)
        last = r.randrange(n)
        order = list(range(n))
        r.shuffle(order)
        h = lossless.RestartHeader(r.randrange(2), r.randrange(1 << 16), r.randrange(last + 1), last, n - 1, r.randrange(16), r.randrange(1 << 23), r.randrange(16), r.randrange(32), r.randrange(32), r.choice([None, 200]), order)
        assert lossless.restart_header(BitReader(lossless.write_restart(h))) == h
    with pytest.raises(ValueError):
        lossless.restart_header(BitReader(bytes(30)))
    with pytest.raises(ValueError):
        lossless.restart_header(BitReader(lossless.write_restart(lossless.RestartHeader(0, 0, 0, 1, 1, 0, 0, 0, 0, 0, None, [0, 0]))))


def test_units_are_repaired():
    r = random.Random(5)
    for major in (True, False):
        unit = access_unit(r, 400, 2, major)
        assert lossless.repaired(unit, 2) == (unit, False, False)
        broken = bytearray(unit)
        broken[0] ^= 0x30
        if major:
            broken[4 + 20] ^= 9
        fixed, wrong_sum, wrong_parity = lossless.repaired(bytes(broken), 2)
        assert wrong_parity and wrong_sum == major
        sync = lossless.major_sync(fixed[4:])
        assert bool(sync) == major and lossless._parity(fixed, sync[0] if sync else 0, 2)


def test_checksums_of_many_are_those_of_each():
    r = random.Random(7)
    values = [None, b"", *(bytes(r.randrange(256) for _ in range(r.randrange(60))) for _ in range(40))]
    for polynomial, bits, start in ((0x8005, 16, 0), (0x63, 8, 0x3C), (0x002D, 16, 0xFFFF)):
        assert scalars.crcs(values, polynomial, bits, start) == [None if v is None else scalars.crc(v, polynomial, bits, start) for v in values]


def test_caf_tracks(tmp_path):
    samples = np.array([[1, -2, 3], [-(1 << 23), (1 << 23) - 1, 0]], np.int32)
    for bits in (16, 24, 32):
        data = media.caf_header(3, 48_000, bits, samples.size * bits // 8) + media.encode_pcm(samples.reshape(-1), bits)
        f = objects.caf_format(data)
        assert (f.channels, f.frames, f.bits, f.rate) == (3, 2, bits, 48_000.0)
        for c in range(3):
            expected = samples[:, c] >> 8 << 8 if bits == 16 else samples[:, c]
            assert objects.caf_track(data, c).tolist() == expected.tolist()
    with pytest.raises(IndexError):
        objects.caf_track(data, 3)
    with pytest.raises(ValueError):
        objects.caf_format(b"caff")


def test_chna(spark):
    uids = [objects.Uid(1, "ATU_00000001", "AT_00031001_01", "AP_00031001"), objects.Uid(2, "ATU_00000002", "AT_00031002_01", "AP_00031002")]
    body = objects.write_chna(uids)
    assert objects.read_chna(body) == uids
    with pytest.raises(ValueError):
        objects.read_chna(body[:-1])
    with pytest.raises(ValueError):
        objects.read_chna(b"\x05" + body[1:])
    riff = b"RIFF" + (4 + 8 + len(body)).to_bytes(4, "little") + b"WAVE" + b"chna" + len(body).to_bytes(4, "little") + body
    got = objects.chna_of(spark.createDataFrame([("x", riff), ("y", None)], "path string, content binary")).collect()
    assert [(r.path, r.track, r.uid) for r in got] == [("x", 1, "ATU_00000001"), ("x", 2, "ATU_00000002")]


def test_scenes_are_written_and_read(spark, tmp_path):
    rows = [("00031001", 1, 0, 480, -0.5, 1.0, 0.25, 1.0), ("00031001", 2, 480, 960, 0.0, -1.0, 0.0, 0.5), ("00031002", 1, 0, 1440, 0.125, 0.0, 1.0, 1.0)]
    blocks = spark.createDataFrame(rows, "channel string, block long, start long, duration long, x double, y double, z double, gain double")
    with open(tmp_path / "s.xml", "w") as out:
        assert objects.write_adm(blocks, 48_000, out, 'a "b"') == 3
    got = scenes.read_blocks(spark, str(tmp_path / "s.xml"), 48_000).orderBy("channel", "block").collect()
    assert [tuple(r) for r in got] == rows
    events = spark.createDataFrame([(10, 0, "0.5", None), (10, 96, None, "-3"), (11, 0, "1", "0")], "id int, pos long, x string, gain string")
    objects.write_event_set(events, "id", "pos", ["x", "gain"], str(tmp_path), "s", 48_000)
    lines = [r.value for r in spark.read.text(str(tmp_path / "s.atmos.metadata")).collect()]
    assert sorted(lines) == sorted(["  - ID: 10", "    samplePos: 0", "    x: 0.5", "  - ID: 11", "    samplePos: 0", "    x: 1", "    gain: 0", "  - ID: 10", "    samplePos: 96", "    gain: -3"])
    assert "      - ID: 11" in [r.value for r in spark.read.text(str(tmp_path / "s.atmos")).collect()]


def test_changes_of_beds_are_losses(spark):
    rows = [(1, 0, True, "a"), (1, 5, True, "a"), (1, 9, True, "b"), (1, 12, True, "a"), (10, 3, False, "x"), (10, 4, False, "y")]
    kept, losses = objects.split_events(spark.createDataFrame(rows, "id int, pos int, bed boolean, state string"), "id", ["pos"], "bed", ["state"])
    assert {tuple(r) for r in losses.collect()} == {(1, 2)} and kept.count() == 2


def test_standard_input_and_samples_in_memory(spark):
    (row,) = media.open_stream(spark, "-", io.BytesIO(b"abc")).collect()
    assert (row.path, bytes(row.content), row.length) == ("-", b"abc", 3)
    samples = spark.createDataFrame([(0, 0, 5), (2, 1, -7)], "position long, channel int, sample int")
    assert media.memory_pcm(samples, 2).tolist() == [[5, 0], [0, 0], [0, -7]]
    with pytest.raises(ValueError):
        media.memory_pcm(samples, 2, 5)


def test_codecs():
    assert media.codec_of(bytes(4) + lossless.SYNCS[0]) == "truehd" and media.codec_of(bytes(4) + lossless.SYNCS[1]) == "mlp"
    assert media.codec_of(b"") is None and not media.is_family(None) and media.is_family("ac3")
    ac3 = bytes.fromhex("0b770000 14 40 ff 00".replace(" ", "")) + bytes(24)  # mode 7
    info = media.stream_information(ac3)
    assert (info.identification, info.mode, info.channels) == (8, 7, 5 + info.lfe)
    with pytest.raises(EOFError):
        media.stream_information(ac3[:7])


def test_a_programme_that_is_not_there(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "programme int, x string")
    assert [r.x for r in reports.one_programme(df, 2).collect()] == ["b"]
    with pytest.raises(Exception, match="there is no programme 3"):
        reports.one_programme(df, 3).collect()
    with pytest.raises(ValueError):
        reports.layout_policy(df, ["programme"], ["x"], "x", "other")


def test_trees_of_any_depth(spark):
    deep = "[" * 400 + "1" + "]" * 400
    df = spark.createDataFrame([(1, deep), (2, None), (3, "no json"), (4, '{"a": null, "b": [true, 2.5, "x"]}')], "k int, j string")
    got = reports.json_tree(df, ["k"], "j")
    assert got.where("k = 1").count() == 401 and got.where("k = 2").count() == 0
    assert {(r.path, r.type, r.value) for r in got.where("k in (3, 4)").collect()} == {("$", "string", "no json"), ("$", "object", ""), ("$.a", "null", "null"), ("$.b", "array", "3"), ("$.b[0]", "boolean", "true"), ("$.b[1]", "number", "2.5"), ("$.b[2]", "string", "x")}


def test_members_of_one_pass(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "t int, member int")
    got = reports.write_members(df, "member", ["t"], str(tmp_path / "m"))
    assert [tuple(r) for r in got.collect()] == [(0, 10), (1, 10), (2, 10)]
    assert [r.t for r in spark.read.parquet(str(tmp_path / "m/member=1")).collect()] == list(range(1, 30, 3))


def test_names(spark):
    (r,) = spark.range(1).select(reports.warp_name(F.lit(2)).alias("a"), reports.warp_name(F.lit(9)).alias("b"), reports.zones_name(F.lit(9)).alias("c"), reports.channel_name(F.lit("Rb")).alias("d")).collect()
    assert tuple(r) == ("ProLogicIIx", None, "all", "Rrs")


def test_streams_let_go_of_what_is_open_at_their_end(spark, tmp_path):
    rows = [("s", 0, "x", 0, 0, False), ("s", 1, "a", 1, 0, False), ("s", 2, "b", 0, 0, False), ("s", 3, "a", 0, 1, False), ("s", 4, "b", 2, 0, False), ("s", 5, "end", 0, 0, True)]
    schema = "s string, t long, kind string, damaged int, restarted int, over boolean"
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    listener = run.Progress(lambda name, n: seen.append(n))
    spark.streams.addListener(listener)
    groups = run.available_now(streams.group_stream(source, "s", "t", "kind", "a", "end"), "groups").orderBy("group").collect()
    assert [(r.group, r.first, r.n, r.kinds) for r in groups] == [(1, 1, 2, "a,b"), (2, 3, 2, "a,b")]
    regions = run.available_now(streams.region_stream(source, "s", "t", "damaged", "restarted", "over"), "regions").orderBy("first_unit").collect()
    assert [(r.first_unit, r.last_unit, r.entry_unit, r.parts) for r in regions] == [(1, 2, 3, 1), (4, 5, None, 2)]
    spark.streams.removeListener(listener)


def test_filters_are_read_within_their_ranges():
    w = BitWriter().write(2, 4).write(9, 4).write(5, 5).write(1, 3).write(0b11111, 5).write(0b01111, 5).write(1, 1).write(4, 4).write(2, 4).write(0b1000, 4).write(0b0111, 4)
    f = lossless.read_filter(BitReader(w.bytes()), 4, True)
    assert (f.order, f.shift, f.coefficients, f.state) == (2, 9, [-2, 30], [-32, 28])
    assert lossless.read_filter(BitReader(b"\0"), 8, False).order == 0
    for bits in ([(9, 4)], [(1, 4), (0, 4), (0, 5), (0, 3)], [(1, 4), (0, 4), (16, 5), (1, 3)], [(1, 4), (0, 4), (1, 5), (0, 3), (0, 1), (1, 1)]):
        w = BitWriter()
        for v, n in bits:
            w.write(v, n)
        with pytest.raises(ValueError):
            lossless.read_filter(BitReader(w.write(0, 30).bytes()), 8, False)


def test_dither_and_fades():
    from siltstream.functions import dsp

    a, b, seed = dsp.dither(0x123456, 40, 3)
    x, y, middle = dsp.dither(0x123456, 15, 3)
    z, _, end = dsp.dither(middle, 25, 3)
    assert np.concatenate([x, z]).tolist() == a.tolist() and end == seed and (a % 8 == 0).all() and a.min() < 0 < a.max() and len(b) == 40
    faded = dsp.cross_faded(np.zeros(8), 2, np.full(5, 6.0), 2)
    assert faded.tolist() == [0, 0, 2, 4, 6, 4, 2, 0]
    assert dsp.cross_faded(np.zeros(3), -4, np.ones(2), 1).tolist() == [0, 0, 0] and dsp.cross_faded(np.zeros(3), 2, np.full(3, 4.0), 0).tolist() == [0, 0, 4]


def test_stalled_groups_writes_the_missing_out_last(spark):
    r = random.Random(5)
    rows = [(s, g, r.randrange(1, 5)) for s, groups in (("a", range(-2100, 2100, 7)), ("b", [0, 1023, 1024, 5000]), ("c", [2047]), (None, [3, 5])) for g in groups for _ in range(2)]
    rows += [("d", None, 1), ("e", 4, None), ("e", 6, 1), ("e", 7, 9)]
    got = reports.stalled_groups(spark.createDataFrame(rows, "s string, g long, k int"), ["s"], "g", "k", [1, 2, 3])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # what is missing is not shuffled
    expected = []
    for s in [*"abcde", None]:
        there = {(g, k) for t, g, k in rows if t == s and g is not None}
        groups, found = [g for g, _ in there], there if s else set()  # nothing can be found in a null stream
        last = {k: max((g for g, j in found if j == k), default=None) for k in (1, 2, 3)}
        for g in range(min(groups), max(groups) + 1) if groups else []:
            expected += [(s, g, k, last[k] is not None and last[k] > g) for k in (1, 2, 3) if (g, k) not in found]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    assert len(expected) > 15_000
