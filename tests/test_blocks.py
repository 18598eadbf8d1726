"""Blocks against a dictionary, over partitions of every size."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.operators import blocks as B

SHAPE = "series_id bigint, t bigint, v double, seq bigint, part string, n string"


def _want(data):
    best = {}
    for s, t, v, q in data:
        if s is None or t is None:
            continue
        rank = (B.NO_SEQ if q is None else q, v is not None, v is not None and math.isnan(v), 0 if v is None or math.isnan(v) else v)
        if (s, t) not in best or rank > best[s, t][0]:
            best[s, t] = (rank, v)
    out = {}
    for (s, t), (_, v) in sorted(best.items()):
        if v is not None and not math.isnan(v):
            out.setdefault(s, []).append((t, v))
    return out


def _check(found, data, known, rows, margin):
    want, got = _want(data), {}
    for r in sorted(found, key=lambda r: r.part):
        got.setdefault(r.series_id, []).append(r)
        assert 1 <= r.n <= rows + margin
        assert (r.low, r.high) == known.get(r.series_id, (None, None))
    assert set(got) == set(want)
    for s, own in got.items():
        at = 0
        for r in own:
            a, b = max(0, at - margin), min(len(want[s]), at + r.n + margin)
            assert list(zip(r.ts, r.vs, strict=True)) == want[s][a:b] and r.lead == at - a
            at += r.n
        assert at == len(want[s])


def _data(seed, n):
    rnd, out = random.Random(seed), []
    for i in range(n):
        v = rnd.choice([float(i), 1.0, None, float("nan"), float("inf")]) if i % 3 else float(i)
        out.append((rnd.choice([1, 1, 1, 1, 2, 3, i % 9, None]), rnd.choice([rnd.randrange(-50, 400), 7, 7, None]), v, rnd.choice([i, i, 5, None])))
    return out + out[: n // 8]


@pytest.mark.parametrize(("partitions", "rows", "margin"), [(1, 5, 2), (3, 4, 4), (40, 3, 2), (40, 100, 16)])
def test_blocks(spark, monkeypatch, partitions, rows, margin):
    monkeypatch.setattr(B, "BUFFER", 64)
    monkeypatch.setattr(B, "cut_lineage", lambda df: df.checkpoint())
    data, known = _data(partitions, 900), {1: (0.5, None), 2: (1.0, 2.0), 4: (None, None), 88: (1.0, 1.0)}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = spark.createDataFrame([(*r, "x", "y") for r in data], SHAPE).repartition(4)
        attributes = spark.createDataFrame([(s, *x) for s, x in known.items()] + [(None, 1.0, 1.0)], "series_id bigint, low double, high double")
        _check(B.blocks(frame, attributes, ["low", "high"], rows, margin).collect(), data, known, rows, margin)
        plain = B.blocks(frame, rows=rows, margin=margin)
        exploded = sorted((r.series_id, r.t, r.v) for r in B.explode(plain).collect())
        assert exploded == sorted((s, t, v) for s, own in _want(data).items() for t, v in own)
        assert B.blocks(frame.where("false"), attributes, ["low", "high"], rows, margin).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_partitions_cut_anywhere():
    """The same, with sorted rows cut into partitions at random places, between versions of one point too."""
    for seed in range(60):
        rnd = random.Random(seed)
        data = [r for r in _data(seed, rnd.choice([5, 40, 200])) if r[0] is not None and r[1] is not None]
        known = {s: (float(s), None) for s in (1, 2, 5, 77)}
        key = lambda r: (r[0], r[1] is not None, r[1] or 0, B.NO_SEQ if r[3] is None else r[3], r[2] is not None, r[2] is not None and math.isnan(r[2]), 0 if r[2] is None or math.isnan(r[2]) else r[2])
        rows = sorted([*data, *[(s, None, x, k) for s, pair in known.items() for k, x in enumerate(pair)]], key=key)
        places = sorted(i for i in rnd.sample(range(len(rows) + 1), min(len(rows), rnd.choice([0, 2, 30]))) if not (0 < i < len(rows) and rows[i - 1][1] is None and rows[i][1] is None and rows[i - 1][0] == rows[i][0]))
        margin = rnd.choice([1, 2, 5])
        size = margin + rnd.choice([0, 1, 20])
        found, notes = [], []
        for pid, (a, b) in enumerate(zip([0, *places], [*places, len(rows)], strict=True)):
            packer, out = B._Packer(2, size, margin, pid), []
            steps = sorted({a, b, *rnd.sample(range(a, b + 1), min(b - a, 3))})
            for x, y in zip(steps, steps[1:], strict=False):
                own = rows[x:y]
                columns = [np.array([r[0] for r in own], np.int64), np.array([r[1] or 0 for r in own], np.int64), np.array([B.NO_SEQ if r[3] is None else r[3] for r in own], np.int64), np.array([np.nan if r[2] is None else r[2] for r in own], float), np.array([r[1] is None for r in own], dtype=bool)]
                out.append(packer.take(*columns, y == b))
            if b > a:
                edge = packer.edge()
                notes.append(B.pickle.loads(edge.column("edge")[0].as_py()))
                found += [r for batch in out if batch is not None for r in pa.Table.from_batches([batch]).to_pylist()]
        for f in B._fixes(notes, margin):
            fix = dict(zip([c.split()[0] for c in B.FIXES.split(", ")], f, strict=True))
            for r in found:
                if (r["pid"], r["series_id"]) != (fix["pid"], fix["series_id"]):
                    continue
                r["attributes"] = r["attributes"] or fix["x_attributes"]
                if r["part"] == fix["last_part"]:
                    cut = len(r["ts"]) - bool(fix["superseded"])
                    r["n"] -= bool(fix["superseded"])
                    r["ts"], r["vs"] = r["ts"][:cut] + fix["after_t"], r["vs"][:cut] + fix["after_v"]
                if r["part"] == fix["first_part"]:
                    r["lead"] += len(fix["before_t"])
                    r["ts"], r["vs"] = fix["before_t"] + r["ts"], fix["before_v"] + r["vs"]
        whole = [type("Row", (), r | dict(zip(("low", "high"), r["attributes"] or (None, None), strict=True))) for r in found if r["n"]]
        _check(whole, data, known, size, margin)
