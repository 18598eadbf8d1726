"""The training-data operators against brute force, exact round trips and known errors."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.llm import distinct, mixing, packing, percentiles, queries, runs, splitting, tokens
from tideline.operators import blocks

ENCODING = tokens.TokenCounter.of(tokens.VOCABULARY).encoding


def size(text):
    return len(ENCODING.encode_ordinary(text))


# Distinct counts


def test_distinct_is_within_its_error(spark):
    data = spark.range(200_000).select(F.col("id"), F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 8, None).otherwise("cold").alias("k"), F.lit(1).alias("register"))
    got = {r.k: r.estimate for r in distinct.distinct_counts(data.union(data), ["k"], "id", 12).collect()}
    for k, n in (("hot", 140_000), ("cold", 40_000), (None, 20_000)):
        assert abs(got[k] / n - 1) < 4 * distinct.relative_error(12)


def test_distinct_error_is_as_stated(spark):
    data = spark.range(400 * 3000).select((F.col("id") % 400).alias("k"), "id")
    got = np.array([r.estimate for r in distinct.distinct_counts(data, ["k"], "id", 8).collect()]) / 3000 - 1
    assert abs(got.mean()) < 0.01 and 0.85 < got.std() / distinct.relative_error(8) < 1.15


@pytest.mark.parametrize("n", [1, 2, 10, 100])
def test_small_counts_are_nearly_exact(spark, n):
    got = distinct.distinct_counts(spark.range(n), [], "id", 12).first()
    assert abs(got.estimate - n) <= max(0, n // 50)


def test_parts_merge_without_loss(spark):
    data = spark.range(5000).select((F.col("id") % 3).alias("k"), "id")
    whole = distinct.registers(data, ["k"], "id", 6)
    parts = [distinct.registers(data.where(F.col("id") % 7 == i), ["k"], "id", 6) for i in range(7)]
    stored = [distinct.unpack(distinct.pack(p, ["k"]), ["k"]) for p in parts]
    union = stored[0]
    for p in stored[1:]:
        union = union.unionByName(p)
    assert rows(distinct.merge(union, ["k"])) == rows(whole.select("k", "register", "ranks"))


def test_combinations_equal_direct_counts(spark):
    data = spark.createDataFrame([(i, "ab"[i % 2], None if i % 3 else "x") for i in range(3000)], "id bigint, a string, b string")
    got = {(r.level, r.a, r.b): r.estimate for r in distinct.combinations(distinct.registers(data, ["a", "b"], "id", 10), ["a", "b"], 10).collect()}
    for level, keys in ((0, ["a", "b"]), (1, ["a"]), (2, ["b"])):
        for r in distinct.distinct_counts(data, keys, "id", 10).collect():
            assert got[level, r.a if "a" in keys else None, r.b if "b" in keys else None] == r.estimate
    assert len(got) == 4 + 2 + 2 + 1


def test_error_bounds_hold(spark):
    data = spark.range(3000 * 40).select((F.col("id") % 3000).alias("k"), "id").where("id div 3000 < k div 75")
    counts = distinct.distinct_counts(data, ["k"], "id", 10).withColumn("bound", distinct.error_bound(F.col("estimate"), 10))
    exact = {r.k: r.n for r in data.groupBy("k").agg(F.count("id").alias("n")).collect()}
    outside = [r for r in counts.collect() if abs(r.estimate - exact[r.k]) > r.bound]
    assert len(exact) > 2900 and len(outside) <= 3


def test_distinct_of_nothing(spark):
    data = spark.createDataFrame([(None, "k")], "id bigint, k string")
    assert distinct.distinct_counts(data, ["k"], "id").count() == 0


# Percentiles


@pytest.mark.parametrize(("gather", "held", "long"), [(1, 1000, 1000), (30, 1000, 8), (10_000, 1000, 1000), (20, 0, 8)])
def test_percentiles_are_exact(spark, monkeypatch, gather, held, long):
    for name, value in (("GATHER", gather), ("HELD", held), ("LONG", long), ("REWRITE", 2)):
        monkeypatch.setattr(percentiles, name, value)
    rnd = random.Random(5)
    members = [(s, n, v) for s in range(12) for n, v in (("all", "yes"), ("mod", str(s % 3)), ("none", None), ("own", f"s{s}"))] + [(0, "all", "yes"), (None, "all", "yes"), (99, "all", "yes")]
    values = [1.0, 1.0, 2.0, -0.5, float("inf"), float("-inf")]
    data = [(s, c, rnd.choice([*values, rnd.gauss(0, 1), None, float("nan")])) for s in range(12) for c in range(3) for _ in range(rnd.choice([0, 1, 20]))]
    frame = spark.createDataFrame([(*r, 1) for r in data], "series_id bigint, chunk bigint, v double, n int")
    first, rest = (percentiles.blocks(frame.where(w), ["series_id", "chunk"]) for w in ("chunk = 0", "chunk > 0"))
    tags = spark.createDataFrame([(*r, 0) for r in members], "series_id bigint, name string, value string, gid int")
    got = {(r.name, r.value): r for r in percentiles.group_percentiles(first.unionByName(rest), tags, "series_id", ["name", "value"], (0.0, 0.25, 0.5, 0.99, 1.0)).collect()}
    want = {}
    for s, n, v in {m for m in members if m[0] is not None}:
        want.setdefault((n, v), []).extend(x for k, _, x in data if k == s and x is not None and not math.isnan(x))
    want = {k: sorted(v) for k, v in want.items() if v}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k].n == len(v)
        for q, name in ((0.0, "p0"), (0.25, "p25"), (0.5, "p50"), (0.99, "p99"), (1.0, "p100")):
            assert got[k][name] == v[max(math.ceil(round(q * len(v), 9)), 1) - 1], (k, q)


def test_percentiles_of_nothing(spark):
    frame = spark.createDataFrame([], "series_id bigint, chunk bigint, v double")
    tags = spark.createDataFrame([(1, "a", "b")], "series_id bigint, name string, value string")
    assert percentiles.group_percentiles(percentiles.blocks(frame, ["series_id", "chunk"]), tags, "series_id", ["name", "value"], (0.5,)).count() == 0


# Runs


def _least_cost(v, cost, penalty):
    best = [-penalty]
    for i in range(1, len(v) + 1):
        best.append(min(best[s] + cost(v[s:i]) + penalty for s in range(i)))
    return best[-1]


def _cost_of(v, cut, cost, penalty):
    at = [i for i, c in enumerate(cut) if c] + [len(v)]
    return sum(cost(v[a:b]) for a, b in itertools.pairwise(at)) + penalty * (len(at) - 2)


def _steps(x):
    return sum(abs(b - a) for a, b in itertools.pairwise(x))


def _spread(x):
    return sum((y - sum(x) / len(x)) ** 2 for y in x)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-8, 8), min_size=1, max_size=24), st.integers(0, 12), st.sampled_from([(1.0, 0.0), (0.0, 1.0), (0.5, 0.5)]))
def test_segmentations_are_optimal(values, penalty, weights):
    v = np.array(values, dtype=float)
    first = np.arange(len(v)) == 0
    step, level = weights
    cost = lambda x: step * _steps(x) + level * _spread(x)
    cut = runs.cheapest_cuts(v, first, np.full(len(v), float(penalty)), step, level)
    least = _least_cost(v.tolist(), cost, penalty)
    assert _cost_of(v.tolist(), cut, cost, penalty) == pytest.approx(least, abs=1e-6)
    forced = runs.forced_cuts(v, first, np.full(len(v), float(penalty)), step, level)
    cut = runs.cheapest_cuts(v, forced, np.full(len(v), float(penalty)), step, level)
    assert _cost_of(v.tolist(), cut, cost, penalty) == pytest.approx(least, abs=1e-6)


def test_segmentation_of_noise_is_not_quadratic():
    v = np.random.default_rng(1).normal(0, 1, 8000)
    first = np.arange(len(v)) == 0
    took = []
    for n in (2000, 8000):
        began = time.perf_counter()
        runs.cheapest_cuts(v[:n], first[:n], np.full(n, 1e4), 0.0, 1.0)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]


def _blocked(spark, data, rows):
    """Blocks with ``tol`` of ``(series, t, v, tol)``."""
    frame = spark.createDataFrame([(s, t, v, 0, "x") for s, t, v, _ in data], "series_id bigint, t bigint, v double, seq bigint, n string")
    tols = spark.createDataFrame(list({(s, tol) for s, _, _, tol in data if s is not None}), "series_id bigint, tol double")
    return blocks.blocks(frame, tols, ["tol"], rows, min(rows, blocks.MARGIN))


@pytest.mark.parametrize("block", [1, 3, 1000])
@pytest.mark.parametrize("least", [1, 3])
def test_runs_do_not_depend_on_blocks(spark, block, least):
    rnd, data, want = random.Random(6), [], []
    for s in range(4):
        v, tol = [rnd.choice([1.0, 1.0, 1.05, 2.0, float("inf")]) for _ in range(120)], [0.1, 0.0, None, 0.04][s]
        data += [(s, i * 10, x, tol) for i, x in enumerate(v)]
        start = 0
        for i in range(1, 121):
            if i == 120 or not (v[i] == v[i - 1] or abs(v[i] - v[i - 1]) <= (tol or 0)):
                if i - start >= least:
                    want.append((s, start * 10, (i - 1) * 10, i - start, (i - 1 - start) * 10))
                start = i
    junk = [(None, 5, 1.0, 0.1), (0, None, 1.0, 0.1), (0, 5, None, 0.1), (0, 5, float("nan"), 0.1)]
    assert rows(runs.collapse(_blocked(spark, data + junk, block), least), "series_id", "t_start", "t_end", "n", "duration_ms") == sorted(want)
    assert runs.collapse(_blocked(spark, data, block).where("false"), least).count() == 0


def test_levels(spark):
    v = [0.0, 0.4, -0.3, 0.1, 9.0, 9.3, 8.8, 0.2]
    blocked = _blocked(spark, [(1, i, x, 2.0) for i, x in enumerate(v)], 100)
    assert rows(runs.collapse(blocked, step=0.0, level=1.0), "t_start", "n") == [(0, 4), (4, 3), (7, 1)]


@pytest.mark.parametrize("block", [1, 2, 5, 24, 1000])
def test_levels_do_not_depend_on_blocks(spark, block):
    rng, data, want = np.random.default_rng(8), [], []
    for s, tol in enumerate([0.3, 1.0, 4.0, 0.0]):
        v = np.cumsum(rng.normal(0, 0.6, 240)) + rng.normal(0, 0.4, 240)
        v[60:90] = v[60]
        v[[100, 101, 170]] = float("inf")
        data += [(s, i, float(x), tol) for i, x in enumerate(v)]
        first = (np.arange(240) == 0) | ~np.isfinite(v) | np.append(False, ~np.isfinite(v[:-1]))
        at = np.flatnonzero(runs.cheapest_cuts(v, first, np.full(240, tol), 0.0, 1.0))
        want += [(s, int(a), int(b - a)) for a, b in itertools.pairwise([*at, 240]) if b - a >= 2]
    assert rows(runs.collapse(_blocked(spark, data, block), 2, 0.0, 1.0), "series_id", "t_start", "n") == want


# Packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_best_fit(sizes):
    bins = packing.best_fit(np.array(sizes), 50)
    used = np.bincount(bins, weights=sizes)
    assert used.max() <= 50
    assert np.sort(used)[:2].sum() > 50 if len(used) > 1 else True  # two bins that fit together would be one


@pytest.mark.parametrize("task", [40_000, 20])
def test_packing(spark, monkeypatch, task):
    monkeypatch.setattr(packing, "TASK_ITEMS", task)
    rnd = random.Random(7)
    data = [(i, rnd.choice([1, 30, 99, 100, 101, 250, 900, rnd.randrange(1, 100), 0, None]), "x") for i in range(600)] + [(None, 5, "x")]
    frame = spark.createDataFrame(data, "doc bigint, tokens bigint, used string")
    got = packing.pack(frame, "doc", "tokens", 100).collect()
    placed, used = {}, {}
    for r in got:
        assert (r.id, r.part) not in placed and r.size > 0
        placed[r.id, r.part] = r.size
        used[r.container] = used.get(r.container, 0) + r.size
    assert all(u <= 100 for u in used.values()) and {r.container: r.used for r in got} == used
    for i, n, _ in data:
        parts = [placed[k] for k in placed if k[0] == i]
        assert sum(parts) == (n or 0 if i is not None else 0)
        assert len(parts) == (-(-(n or 0) // 100) if i is not None else 0)
    total = sum(used.values())
    assert len(used) <= 1.12 * total / 100 + 1
    again = {(r.id, r.part): r.container for r in packing.pack(frame, "doc", "tokens", 100).collect()}
    assert again == {(r.id, r.part): r.container for r in got}


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_least_containers(spark, sizes):
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= 20:
                place(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    least = packing.least_containers(spark.createDataFrame([(x,) for x in sizes], "size bigint"), "size", 20).first().least
    assert -(-sum(sizes) // 20) <= least <= best[0]


def test_packing_nothing_and_what_cannot_be_combined(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ITEMS", 10)
    frame = spark.createDataFrame([(i, 60) for i in range(100)], "doc bigint, tokens bigint")
    assert packing.pack(frame, "doc", "tokens", 100).select("container").distinct().count() == 100
    assert packing.pack(frame.where("false"), "doc", "tokens", 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(frame, "doc", "tokens", 0)


# Mixing


def test_mixing(spark):
    rnd = random.Random(8)
    data = [(i, "big" if i % 10 < 6 else "mid" if i % 10 < 9 else "small" if i % 20 == 9 else None, rnd.choice([0, None, rnd.randrange(1, 400), rnd.randrange(1, 400)]), "x") for i in range(4000)]
    docs = spark.createDataFrame(data, "doc bigint, source string, tokens bigint, copies string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("absent", 0.1, 5)], "source string, target_share double, max_repeats int")
    selection = mixing.mix(docs, targets, "doc", "source", "tokens")
    got = selection.collect()
    assert len({r.doc for r in got}) == len(got) and rows(selection) == rows(mixing.mix(docs, targets, "doc", "source", "tokens"))
    allowed = {"big": 1, "mid": 2, "small": 3}
    assert all(1 <= r.copies <= allowed[r.source] for r in got)
    own = {s: sum(n or 0 for _, x, n, _ in data if x == s) for s in allowed}
    total = min(own[s] * allowed[s] / w for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2)))
    for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(sum(r.tokens * r.copies for r in got if r.source == s) - w * total) <= 400
    report = {r.source: r for r in mixing.shares(selection, targets, "source", "tokens").collect()}
    assert report["absent"].documents == 0 and sum(r.actual_share for r in report.values()) == pytest.approx(1)
    assert report["big"].actual_share == pytest.approx(0.5, abs=0.01)


def test_inclusion_meets_the_target():
    classes = {0: (100, 100), 8: (50, 200), 20: (3, 96)}
    for target in (10.0, 150.0, 390.0):
        p = mixing.inclusion(classes, target, 0.5)
        assert sum(p[k] * n for k, (_, n) in classes.items()) == pytest.approx(target, rel=1e-6) and p[0] <= p[8] <= p[20] <= 1
    assert set(mixing.inclusion(classes, 1000, 0.5).values()) == {1.0}


def test_mixing_nothing(spark):
    docs = spark.createDataFrame([], "doc bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    selection = mixing.mix(docs, targets, "doc", "source", "tokens")
    assert selection.count() == 0
    assert rows(mixing.shares(selection, targets, "source", "tokens"), "actual_share") == [(0.0,)]


# Tokens and splitting

TEXTS = st.lists(st.sampled_from([*"ab Z9.,'\n\t\r\xa0　\x00é部（45）。、请求项1", "'s", "  ", "\n\n\n", "　\n"]), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_units_add_up(text):
    parts = tokens.units(text)
    counter = tokens.TokenCounter.of(tokens.VOCABULARY)
    assert "".join(parts) == text and counter.count(text) == size(text)
    for i in range(1, len(parts)):
        assert size("".join(parts[:i])) + size("".join(parts[i:])) == size(text)


def test_with_tokens(spark):
    frame = spark.createDataFrame([(1, "a b", 0), (2, None, 0), (3, "", 0), (4, "   ", 0), (5, "x" * 200_000, 0)], "doc_id bigint, text string, extra int")
    assert rows(tokens.with_tokens(frame, ["doc_id", "extra"]), "doc_id", "tokens") == [(1, 2), (2, 0), (3, 0), (4, size("   ")), (5, size("x" * 200_000))]


def _texts():
    rnd = random.Random(9)
    words = ["membrane", "the", "carrier", "(10)", "5.3", "plate,", "seals.", "Wherein\n", "\n\n[0003]", "\n2.", "\n3. The"]
    long = " ".join(rnd.choice(words) for _ in range(3000))
    zh = "".join(rnd.choice("光学承载板环形压力室磁性接触弹簧，。；") for _ in range(4000))
    return [long, zh, "x" * 3000, "\n" * 3000, "short", "", None, "部" * 2000, " ".join(["a1b2c3d4" * 40] * 20), long + zh + "\x00" + long]


@pytest.mark.parametrize(("limit", "overlap"), [(256, 32), (64, 0), (100, 20)])
def test_pieces(spark, limit, overlap):
    texts = _texts()
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")
    got = {}
    for r in splitting.split_oversized(frame, "doc_id", limit, overlap).orderBy("doc_id", "piece_no").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {i for i, t in enumerate(texts) if t and size(t) > limit}
    for i, pieces in got.items():
        text = texts[i]
        assert [p.piece_no for p in pieces] == list(range(len(pieces)))
        assert pieces[0].start_char == 0 and pieces[-1].end_char == len(text)
        for p in pieces:
            assert p.piece == text[p.start_char : p.end_char] and 0 < size(p.piece) == p.n_tokens <= limit
        for a, b in itertools.pairwise(pieces):
            assert a.start_char < b.start_char <= a.end_char < b.end_char
            again = size(text[b.start_char : a.end_char])
            assert overlap <= again <= overlap + 40


@pytest.mark.parametrize("limit", [40, 64, 300])
def test_pieces_of_runs_keep_to_the_limit(spark, limit):
    """Letters whose tokens do not add up: pieces of them are counted as they are."""
    rnd = random.Random(12)
    texts = ["".join(rnd.choice("acgtn") for _ in range(3000)) for _ in range(30)] + [" ".join("".join(rnd.choice("acgnt") for _ in range(rnd.randrange(1, 400))) for _ in range(20)) for _ in range(10)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = splitting.split_oversized(frame, "doc_id", limit, 8).collect()
    assert {r.doc_id for r in got} == {i for i, t in enumerate(texts) if size(t) > limit}
    for r in got:
        assert r.n_tokens == size(r.piece) <= limit and texts[r.doc_id][r.start_char : r.end_char] == r.piece
    for i, text in enumerate(texts):
        own = sorted((r.piece_no, r.start_char, r.end_char) for r in got if r.doc_id == i)
        assert own[0][1] == 0 and own[-1][2] == len(text) and all(b[1] < a[2] for a, b in itertools.pairwise(own))


def test_cuts_come_at_claims_and_lines(spark):
    text = "\n".join(f"{k}. Claim number {k} of the device, wherein the plate seals. It also turns." for k in range(1, 60))
    frame = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    pieces = splitting.split_oversized(frame, "doc_id", 200, 20).orderBy("piece_no").collect()
    assert all(text[p.end_char] == "\n" for p in pieces[:-1]) and len(pieces) > 4


def test_pointer_doubling_equals_one_cut_after_the_other():
    rng = np.random.default_rng(1)
    counts = [rng.integers(1, 9, n) for n in (1, 5, 300, 77)]
    levels = np.concatenate([np.append(rng.integers(0, 4, len(c)), 3) for c in counts]).astype(np.int8)
    lengths = np.array([len(c) + 1 for c in counts])
    end = np.cumsum(lengths) - 1
    first = end - lengths + 1
    cum = np.concatenate(([0], np.cumsum(np.concatenate([np.append(c, 51) for c in counts]))[:-1]))
    starts, stops = splitting.greedy_pieces(cum, cum.astype(float), levels, first, end, 50, 10)
    want = []
    for a, z in zip(first, end, strict=True):
        while True:
            far = max(j for j in range(a, z + 1) if cum[j] - cum[a] <= 50)
            stop = far
            if far < z:
                for level in (3, 2, 1):
                    fit = [j for j in range(a + 1, far + 1) if levels[j] >= level]
                    if fit and cum[fit[-1]] - cum[a] >= 25:
                        stop = fit[-1]
                        break
            want.append((a, stop))
            if stop == z:
                break
            a = max(max(j for j in range(a, stop + 1) if cum[j] <= cum[stop] - 10), a + 1)
    assert list(zip(starts, stops, strict=True)) == want


def test_overlap_must_leave_room(spark):
    with pytest.raises(ValueError):
        splitting.split_oversized(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", 10, 5)


def test_combinations_keep_untagged_series_and_pairs_cover_names(spark, tmp_path):
    day = 86_400_000
    spark.createDataFrame([(s, day, 1.0, s) for s in range(1, 6)], "series_id bigint, t bigint, v double, seq bigint").write.parquet(f"{tmp_path}/samples_in.parquet")
    tags = [("region", "r", 1), ("region", "r", 2), ("os", "x", 1), ("os", "x", 2), ("os", None, 3), ("arch", "a", 3), ("hostname", "h", 4)]
    spark.createDataFrame(tags, "name string, value string, series_id bigint").write.parquet(f"{tmp_path}/series_tags.parquet")
    total = queries.p1_combinations(spark, str(tmp_path)).where("level = 7").collect()
    assert [round(r.estimate) for r in total] == [5]
    pairs = queries.p1_pairs(spark, str(tmp_path))
    assert {(r.name_a, r.value_a, r.name_b, r.value_b, round(r.estimate)) for r in pairs.collect()} == {("os", "x", "region", "r", 2), ("arch", "a", "os", None, 1)}
