"""Small inputs with results worked out by hand."""

import struct

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.functions import codec, timeutil, wire
from tideline.functions import labels as L
from tideline.operators import catalog, groups, intervals, merge, scan
from tideline.operators.ids import dense_ids
from tideline.operators.matchers import Eq, Not, Re

# Four sources of samples, and what merging them gives.
SOURCES = [
    [(1, 1.1), (3, 1.1), (5, 1.1), (7, 1.1), (9, 1.1)],
    [(2, 2.1), (4, 2.1), (6, 2.1), (8, 2.1), (10, 2.1)],
    [(3, 3.1), (4, 3.1)],
    [(8, 4.1), (9, 4.1)],
]
MERGED = [1.1, 2.1, 3.1, 3.1, 1.1, 2.1, 1.1, 4.1, 4.1, 2.1]


def test_later_source_wins(spark):
    frames = [spark.createDataFrame([(7, t, v) for t, v in points], "series_id bigint, t bigint, v double") for points in SOURCES]
    whole = merge.merge_sources(frames, ["series_id", "t"])
    assert rows(whole, "t", "v") == list(zip(range(1, 11), MERGED, strict=True))
    assert rows(scan.seek(whole, 8), "t", "v") == [(8, 4.1)]
    assert rows(scan.seek(whole, 11)) == []


def test_out_of_order_series(spark):
    points = [(0, 0.0), (1000, 1.1), (2000, 1.1), (3000, 1.1), (5000, 1.1), (3000, 2.1), (4000, 3.1)]
    df = spark.createDataFrame([(1, t, v, i) for i, (t, v) in enumerate(points)], "series_id bigint, t bigint, v double, seq bigint")
    assert rows(merge.last_write_wins(df, ["series_id", "t"], ["seq"]), "t", "v") == [(0, 0.0), (1000, 1.1), (2000, 1.1), (3000, 2.1), (4000, 3.1), (5000, 1.1)]


def test_group_out_of_order_and_partial(spark):
    inserts = [([0], 0, [1.1]), ([1], 1, [1.1]), ([], 2, [2.2, 2.2]), ([], 5, [3.2, 3.2]), ([0], 2, [3.3]), ([1], 4, [3.3])]
    df = spark.createDataFrame([("g", s, t, v, i) for i, (s, t, v) in enumerate(inserts)], "group_key string, slots array<int>, t bigint, v array<double>, seq bigint")
    now = groups.current(groups.long_form(df))
    assert rows(now.where("slot = 0"), "t", "v") == [(0, 1.1), (2, 3.3), (5, 3.2)]
    assert rows(now.where("slot = 1"), "t", "v") == [(1, 1.1), (2, 2.2), (4, 3.3), (5, 3.2)]
    assert rows(groups.wide(now, ["group_key"], [0, 1]), "t", "s0", "s1")[:2] == [(0, 1.1, None), (1, None, 1.1)]


# Slots and times of overlapping chunks of a group; values are the row of the slot and a digit of the chunk.
GROUP_CHUNKS = [
    ([1, 3, 5, 7, 9], [0, 40, 80, 100], 0.1),
    ([1, 2, 6, 7, 9], [50, 80, 100, 150], 0.2),
    ([3, 4, 5, 8, 9], [100, 120, 150, 200], 0.3),
    ([3, 4, 5, 8, 9], [300, 340, 370, 400], 0.4),
]


def _chunk_rows(spark, chunks):
    data = [("g", slot, t, k + 1 + digit, seq) for seq, (slots, times, digit) in chunks for k, slot in enumerate(slots) for t in times]
    return spark.createDataFrame(data, "group_key string, slot int, t bigint, v double, seq bigint")


def test_overlapping_groups_merge_and_later_ones_are_appended(spark):
    chunks = list(enumerate(GROUP_CHUNKS))
    merged = groups.current(_chunk_rows(spark, chunks[:3]), overwrite_with_null=False)
    slots = [1, 2, 3, 4, 5, 6, 7, 8, 9]
    wide = groups.wide(merged, ["group_key"], slots).orderBy("t").collect()
    assert [r.t for r in wide] == [0, 40, 50, 80, 100, 120, 150, 200]
    assert [r.s1 for r in wide] == [1.1, 1.1, 1.2, 1.2, 1.2, None, 1.2, None]
    assert [r.s9 for r in wide] == [5.1, 5.1, 5.2, 5.2, 5.3, 5.3, 5.3, 5.3]
    whole = groups.concat(merged, _chunk_rows(spark, chunks[3:]))
    by_slot = {}
    for r in whole.orderBy("t").collect():
        by_slot.setdefault(r.slot, []).append(r.v)
    assert set(by_slot) == set(slots) and all(len(v) == 12 for v in by_slot.values())
    assert by_slot[3][-5:] == [1.3 if wide[-1].s3 is not None else None, 1.4, 1.4, 1.4, 1.4]
    assert all(by_slot[s][-4:] == [None] * 4 for s in (1, 2, 6, 7))


def test_malformed_group_inserts_are_an_error(spark):
    shape = "group_key string, slots array<int>, t bigint, v array<double>, seq bigint"
    good, bad = ("g", [0, 1], 1, [5.0, 6.0], 1), ("g", [0, 1], 1, [7.0], 2)
    df = spark.createDataFrame([good, bad, ("g", None, 2, [1.0], 3), ("g", [0], 3, None, 4)], shape)
    assert sorted(r.seq for r in groups.malformed(df).collect()) == [2, 4]
    with pytest.raises(Exception, match="differ in number"):
        groups.long_form(df).collect()
    kept = groups.long_form(df.join(groups.malformed(df), "seq", "left_anti"))
    assert rows(groups.current(kept), "slot", "t", "v") == [(0, 1, 5.0), (0, 2, 1.0), (1, 1, 6.0)]


def test_ties_take_one_whole_row(spark):
    data = [(1, 5, 2.0, 3, 1), (1, 5, 1.0, 9, 1), (1, 5, None, 7, 1), (1, 6, 4.0, 1, None), (1, 6, 3.0, 1, 0)]
    for order in (data, data[::-1]):
        df = spark.createDataFrame(order, "series_id bigint, t bigint, v double, w bigint, seq bigint")
        assert rows(merge.last_write_wins(df, ["series_id", "t"], ["seq"], ["v", "w"]), "t", "v", "w") == [(5, 2.0, 3), (6, 3.0, 1)]


def test_selections_merged_by_labels(spark):
    shape = "labels map<string,string>, t bigint, v double"
    a = spark.createDataFrame([({"x": "1", "y": "2"}, 1, 1.0), ({"x": "1", "y": "2"}, 2, 1.0)], shape)
    b = spark.createDataFrame([({"y": "2", "x": "1"}, 2, 9.0), ({"x": "3"}, 2, 5.0)], shape)
    got = merge.merge_by_labels([a, b]).select(L.text(L.from_key(F.col("label_key"))).alias("l"), "t", "v")
    assert rows(got) == [("{x=1,y=2}", 1, 1.0), ("{x=1,y=2}", 2, 9.0), ("{x=3}", 2, 5.0)]


def test_label_filter_lies_below_every_exchange(spark, series):
    samples = spark.createDataFrame([(1, 1, 1.0, 1)], "series_id bigint, t bigint, v double, seq bigint")
    plan = scan.select(series, samples, [Eq("x", "1")])._jdf.queryExecution().optimizedPlan().toString().splitlines()
    filters = [i for i, line in enumerate(plan) if "Filter" in line and "labels" in line]
    aggregates = [i for i, line in enumerate(plan) if "Aggregate" in line and "labels" in line]
    assert filters and all(any(f > a for f in filters) for a in aggregates)


def test_newer_null_keeps_older_value_on_demand(spark):
    df = spark.createDataFrame([("g", 0, 1, 5.0, 1), ("g", 0, 1, None, 2)], "group_key string, slot int, t bigint, v double, seq bigint")
    assert rows(groups.current(df), "v") == [(None,)]
    assert rows(groups.current(df, overwrite_with_null=False), "v") == [(5.0,)]
    assert rows(groups.non_null(groups.current(df))) == []


def test_slots_by_first_arrival(spark):
    named = spark.createDataFrame([("g", "b", 1, 0), ("g", "c", 1, 1), ("g", "a", 2, 0), ("g", "b", 3, 0)], "group_key string, label_key string, seq bigint, pos int")
    assert rows(groups.assign_slots(named), "label_key", "slot") == [("a", 2), ("b", 0), ("c", 1)]


def test_inclusive_range_and_negative_start(spark):
    df = spark.createDataFrame([(1, t, float(t), t // 2000 * 2000) for t in range(0, 5000, 1000)], "series_id bigint, t bigint, v double, p_start bigint")
    assert [r[1] for r in rows(scan.in_range(df, 1000, 3000, 2000))] == [1000, 2000, 3000]
    assert [r[1] for r in rows(scan.in_range(df, -5, 0))] == [0]


@pytest.fixture
def series(spark):
    return spark.createDataFrame([(1, {"x": "1"}), (2, {}), (3, {"x": "host_1"}), (4, {"x": "host_12"}), (5, {"x": "1\n"})], "series_id bigint, labels map<string,string>")


@pytest.mark.parametrize(
    ("matchers", "ids"),
    [
        ([Eq("x", "1")], [1]),
        ([Not(Eq("x", "1"))], [2, 3, 4, 5]),
        ([Re("x", "(?s).*")], [1, 2, 3, 4, 5]),
        ([Re("x", "host_1")], [3]),
        ([Re("x", "1")], [1]),
        ([Eq("x", "")], [2]),
        ([Re("x", "(")], []),
        ([Not(Re("x", "("))], [1, 2, 3, 4, 5]),
        ([Not(Eq("x", "")), Not(Eq("x", "1"))], [3, 4, 5]),
    ],
)
def test_matchers(series, matchers, ids):
    assert [r[0] for r in rows(scan.resolve(series, matchers), "series_id")] == ids


def test_no_matcher_is_an_error(series):
    with pytest.raises(ValueError):
        scan.resolve(series, [])


def test_group_or_member_label_matches(spark):
    df = spark.createDataFrame([({"group": "g1"}, {"group": "all", "a": "b"}), ({"group": "g2"}, {"c": "d"})], "group_labels map<string,string>, labels map<string,string>")
    assert groups.select_members(df, [Eq("group", "all")]).count() == 1
    assert groups.select_members(df, [Eq("group", "g1"), Eq("a", "b")]).first().full_labels == {"group": "all", "a": "b"}
    assert groups.select_members(df, [Eq("group", "g2"), Eq("a", "b")]).count() == 0


def test_interval_add(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 4, 6), (1, 8, 9), (1, 2, 2), (2, 5, 5)], "series_id bigint, min_t bigint, max_t bigint")
    assert rows(intervals.coalesce_intervals(df)) == [(1, 1, 6), (1, 8, 9), (2, 5, 5)]


def test_delete_keeps_other_rows(spark):
    df = spark.createDataFrame([(1, t, 0.0) for t in range(1, 11)] + [(2, 4, 0.0)], "series_id bigint, t bigint, v double")
    tombs = spark.createDataFrame([(1, 3, 5)], "series_id bigint, min_t bigint, max_t bigint")
    assert [r[1] for r in rows(intervals.delete(df, tombs).where("series_id = 1"))] == [1, 2, 6, 7, 8, 9, 10]
    assert intervals.delete(df, tombs.where("false")).count() == 11


def test_partition_overlap(spark):
    df = spark.createDataFrame([(0, 100), (100, 100), (200, 100)], "time_boundary bigint, time_interval bigint")
    for low, high, want in [(100, 200, [100, 200]), (50, 250, [0, 100, 200]), (-1, 350, [0, 100, 200]), (101, 199, [100])]:
        assert [r[0] for r in rows(intervals.overlapping_partitions(df, low, high))] == want


def test_partition_floor(spark):
    df = spark.createDataFrame([(1_799_999,), (1_800_000,), (-5,)], "t bigint").select("t", timeutil.partition_floor("t", 1_800_000).alias("f"))
    assert dict(map(tuple, df.collect())) == {1_799_999: 0, 1_800_000: 1_800_000, -5: 0}
    assert timeutil.block_ranges(2, 3, 5) == [2, 10, 50] and timeutil.backoff(4, 1, 6) == 6


def test_label_functions(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1", "__name__": "m"},)], "m map<string,string>")
    m = F.col("m")
    got = df.select(L.text(m).alias("text"), L.text(L.add(m, "c", "3")).alias("added"), L.text(L.add(m, "a", "9")).alias("kept"), L.text(L.drop(m, "b")).alias("dropped"), L.text(L.without(m, ["b"])).alias("without"), L.text(L.only(m, ["b"])).alias("only"), L.text(L.from_flat(F.array(*[F.lit(x) for x in ("z", "1", "y", "2", "z", "3")]))).alias("flat"), L.text(L.from_flat(F.array(F.lit("odd")))).alias("odd")).first()
    assert tuple(got) == ("{__name__=m,a=1,b=2}", "{__name__=m,a=1,b=2,c=3}", "{__name__=m,a=1,b=2}", "{__name__=m,a=1}", "{a=1}", "{b=2}", "{y=2,z=1}", "{}")


def test_label_order(spark):
    df = spark.createDataFrame([({"a": "2"},), ({"a": "1", "b": "2"},), ({"a": "1"},)], "m map<string,string>")
    assert [r.m for r in df.orderBy(L.label_key(F.col("m"))).collect()] == [{"a": "1"}, {"a": "1", "b": "2"}, {"a": "2"}]


def test_postings(spark):
    ids = spark.createDataFrame([(i, {f"label_{j}": f"value_{i}" for j in range(3)}) for i in range(50)], "series_id bigint, labels map<string,string>")
    index = catalog.postings(ids)
    assert rows(catalog.lookup(index, "label_1", "value_7")) == [(7,)] and catalog.all_ids(ids).count() == 50
    assert catalog.expand(catalog.intersect([catalog.lookup(index, "label_0", "value_3"), catalog.lookup(index, "label_2", "value_3")])) == [3]
    assert [r[0] for r in rows(catalog.label_names(ids))] == ["label_0", "label_1", "label_2"]


def test_wire(spark):
    matchers, mint, maxt, metric = wire.parse_query('{"matchers":{"label1":"l1","label2":"l2"},"mint":1625387863000,"maxt":1625387963000}')
    assert matchers == [Eq("label1", "l1"), Eq("label2", "l2")] and (mint, maxt, metric) == (1625387863000, 1625387963000, True)
    lines = spark.createDataFrame([('{"type":1,"id":9223372036854775819,"slots":[0,1],"t":5,"v":[1.5,null]}',), ("no json",)], "value string")
    parsed = wire.parse_inserts(lines).collect()
    assert str(parsed[0].id) == "9223372036854775819" and parsed[0].v == [1.5, None] and parsed[1].t is None
    assert wire.parse_inserts(lines).where(wire.is_group()).count() == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**40), 2**40), st.one_of(st.none(), st.floats(allow_nan=False))), max_size=40))
def test_codec_round_trip(points):
    ts, vs = [t for t, _ in points], [v for _, v in points]
    back = codec.decode(codec.encode(ts, vs))
    assert back[0] == ts and [None if v is None else codec._raw(v) for v in back[1]] == [None if v is None else codec._raw(v) for v in vs]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**40), 2**40), max_size=20), st.integers(0, 4), st.data())
def test_group_codec_round_trip(ts, n, data):
    value = st.one_of(st.none(), st.floats(allow_nan=False))
    columns = [data.draw(st.lists(value, min_size=len(ts), max_size=len(ts))) for _ in range(n)]
    assert codec.decode_group(codec.encode_group(ts, columns)) == (ts, columns)


def test_codec_costs_the_same_at_any_length():
    import time

    took = []
    for n in (4_000, 32_000):
        ts, vs = [i * 1000 + i % 7 for i in range(n)], [float(i * i % 1013) / 7 for i in range(n)]
        began = time.perf_counter()
        assert codec.decode(codec.encode(ts, vs)) == (ts, vs)
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0]


def test_random_labels():
    from tideline.functions.labels import random_labels

    some = random_labels(10, 3)
    assert some == random_labels(10, 3) != random_labels(10, 4) and list(some) == sorted(some) and 1 <= len(some) <= 10
    assert all(1 <= len(x) <= 25 and x.isascii() and x.islower() for pair in some.items() for x in pair)
    assert random_labels(0, 1) == {}


def test_dense_ids(spark):
    df = spark.createDataFrame([(x,) for x in (5, 3, 9, 1, 7)], "k bigint")
    assert rows(dense_ids(df, ["k"], "id", 10)) == [(1, 11), (3, 12), (5, 13), (7, 14), (9, 15)]
    assert dense_ids(df.where("false"), ["k"], "id").count() == 0


def test_encodings(spark):
    from tideline.functions import encoding as E

    numbers = [0, 1, -1, 127, 128, 16383, 16384, 2**62, -(2**62), 2**63 - 1, -(2**63), 255]
    df = spark.createDataFrame([(x,) for x in numbers], "x bigint")
    got = df.select("x", E.from_big_endian(E.big_endian(F.col("x"))).alias("b"), E.from_zigzag(E.zigzag(F.col("x"))).alias("z"), E.varint_size(F.col("x")).alias("n"), F.hex(E.big_endian(F.col("x"))).alias("h"), E.checksum(F.lit(b"123456789")).alias("c")).collect()
    for r in got:
        size = 1
        while r.x >= 1 << (7 * size):
            size += 1
        assert r.b == r.z == r.x and r.n == (10 if r.x < 0 else size) and r.h == f"{r.x & (2**64 - 1):016X}" and r.c == 0xCBF43926


def test_replay(spark):
    log = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (3, None)], "series_id bigint, seq bigint")
    marks = spark.createDataFrame([(1, 1), (1, 2), (3, 9)], "series_id bigint, seq bigint")
    assert rows(merge.replay(log, marks)) == [(1, 3), (2, 1), (3, None)]


def test_adapted_width(spark):
    sizes = [100, 200, 250, 260, 1000, 100_000, 60, 124, 126, 0, None]
    want = []
    for size in sizes:
        width = 7_200_000
        if size and size > 250:
            while width > 7_200_000 * 250 / size and width > 450_000:
                width //= 2
        elif size:
            while width * 2 < 7_200_000 * 250 / size:
                width *= 2
        want.append(width)
    df = spark.createDataFrame(list(enumerate(sizes)), "i int, size bigint").select("i", timeutil.adapted_width(F.lit(7_200_000), F.col("size"), 250).alias("w"))
    assert [r.w for r in df.orderBy("i").collect()] == want


def test_binary_bodies():
    from tideline.functions import proto

    # Bodies written out by the rules of the wire format.
    tag = bytes([0x0A, 1]) + b"a" + bytes([0x12, 1]) + b"b"
    assert proto.encode("Tag", {"name": "a", "value": "b"}) == tag
    sample = bytes([0x08, 1, 0x10]) + b"\xff" * 9 + bytes([1]) + bytes([0x1A, 2, 0, 3]) + bytes([0x22, 8, 0x0A, 6]) + tag + bytes([0x30, 0x96, 1]) + bytes([0x3A, 8]) + struct.pack("<d", 1.5)
    fields = {"type": 1, "id": 2**64 - 1, "slots": [0, 3], "lset": {"tags": [{"name": "a", "value": "b"}]}, "t": 150, "v": [1.5]}
    assert proto.encode("InsertSample", fields) == sample
    assert proto.decode("InsertSample", sample) == fields | {"lsets": []}
    unpacked = bytes([0x18, 0, 0x18, 3, 0x39]) + struct.pack("<d", 1.5) + bytes([0x98, 0x06, 7]) + bytes([0x30]) + b"\xff" * 9 + bytes([1])
    got = proto.decode("InsertSample", unpacked)
    assert got["slots"] == [0, 3] and got["v"] == [1.5] and got["t"] == -1 and got["lset"] is None
    for broken in (b"\x0a\x05a", b"\x0b", b"\x32\x00"):
        with pytest.raises((ValueError, IndexError)):
            proto.decode("InsertSample", broken)
    assert proto.decode("QueryRequest", proto.encode("QueryRequest", {"return_metric": 1, "mint": -5, "maxt": 2**62})) == {"return_metric": 1, "lset": None, "mint": -5, "maxt": 2**62}


VALUES = st.fixed_dictionaries({"id": st.integers(0, 2**64 - 1), "slots": st.lists(st.integers(0, 2**32 - 1), max_size=4), "t": st.integers(-(2**63), 2**63 - 1), "v": st.lists(st.floats(allow_nan=False), max_size=4)})


@settings(max_examples=80, deadline=None)
@given(st.lists(VALUES, max_size=4))
def test_binary_bodies_round_trip(samples):
    from tideline.functions import proto

    back = proto.decode("InsertSamples", proto.encode("InsertSamples", {"samples": samples}))["samples"]
    assert [{k: s[k] for k in ("id", "slots", "t", "v")} for s in back] == samples
