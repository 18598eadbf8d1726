"""Implausible readings: phase-space spikes, frozen stretches and broken limits, judged per series.

Every series has its own scales: of the value (its distance from the level of the readings around), of the first
and of the second difference, and the share of readings that change. A series that fits into one block is
measured and judged in one pass over the blocks. A longer one is measured block by block; what the blocks
of a task say of it becomes one row of bounded size, these rows are joined to the scales of the series, and its
blocks alone are passed over again. Both passes handle many series in one vectorised batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.batches import starts
from tideline.operators.blocks import BLOCK_ROWS, Flat, blocks, grouped
from tideline.operators.readings import series_limits
from tideline.session import cut_lineage

SIDE = 6  # readings on each side that make the level
LONGEST = 3  # readings of a spike, by its definition
STUCK = 10  # readings of a frozen stretch, by its definition
MARGIN = 16  # readings around a block that it needs: SIDE + LONGEST and STUCK - 1 fit into it
BLOCK = 400_000  # readings whose levels are worked out together
USUAL = 0.95  # quantile of the deviations that counts as usual; the LONGEST greatest never do
POINTS = 256  # order statistics that stand for a distribution where it is put together from parts
LIMITS = ("min_value", "max_value", "same_tol")
AXES = ("s0", "s1", "s2")
FIRST_PASS = "kind int, series_id long, t long, v double, out_of_bounds boolean, spike boolean, stuck boolean, off double, n long, same double, moved double, s1 double, w0 double, values array<array<double>>, counts array<long>"
FLAGS = "series_id long, t long, v double, out_of_bounds boolean, spike boolean, stuck boolean"
FLAG, SCALES, PART = 0, 1, 2  # kinds of rows of the first pass


@dataclass(frozen=True)
class Factors:
    """What counts as far beyond the usual; see :func:`implausible`."""

    spike: float = 7.0  # usual steps
    usual: float = 3.0  # usual deviations
    burst: float = 5.0  # usual deviations, in a series with bursts of its own
    bursty: float = 6.0  # usual deviation over usual step from which a series has such bursts
    lively: float = 0.7  # share of readings that differ from the one before, frozen runs left out
    known: int = 28  # readings from which a series is judged by its own scales alone


def _shifted(v: np.ndarray, seg: np.ndarray, k: int) -> np.ndarray:
    """``v`` of the reading ``k`` places before (``k`` < 0: after) in the same segment, else NaN."""
    out = np.full(len(v), np.nan)
    if abs(k) < len(v):
        a, b = (slice(k, None), slice(None, -k)) if k > 0 else (slice(None, k), slice(-k, None))
        out[a] = np.where(seg[a] == seg[b], v[b], np.nan)
    return out


def _row_median(columns: list[np.ndarray]) -> np.ndarray:
    """Median of each row, NaN ignored; NaN where nothing is left."""
    m = np.sort(np.stack(columns, axis=1), axis=1)
    n = (~np.isnan(m)).sum(axis=1)
    i = np.arange(len(m))
    low, high = m[i, np.maximum((n - 1) // 2, 0)], m[i, n // 2]
    return np.where(n > 0, (low + high) / 2, np.nan)


def _deviation(v: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each reading lies off the band between the levels before and after it, and the nearer level.

    The level of a side is the median of its ``SIDE`` nearest readings. A reading between both levels has
    no deviation, so trends, counters, restarts and new levels that stay have none. With one side only
    (ends of a series), nothing can be said to have come back: no deviation.
    """
    parts = []
    for a in range(0, len(v), BLOCK):  # the columns of the medians need memory: a block at a time, with what its edges need
        low = max(0, a - SIDE)
        own = slice(low, a + BLOCK + SIDE)
        parts.append([x[a - low : a - low + BLOCK] for x in _band(v[own], seg[own])])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _band(v: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before = _row_median([_shifted(v, seg, k) for k in range(1, SIDE + 1)])
    after = _row_median([_shifted(v, seg, -k) for k in range(1, SIDE + 1)])
    low, high = np.fmin(before, after), np.fmax(before, after)
    with np.errstate(invalid="ignore"):
        off = np.where(v > high, v - high, np.where(v < low, v - low, 0.0))
        level = np.where(v > high, high, np.where(v < low, low, v))
    one = np.isnan(before) | np.isnan(after)
    return np.where(one | np.isnan(off), 0.0, off), np.where(one, v, level)


def _sorted_per(x: np.ndarray, seg: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The non-NaN ``x`` of each of ``k`` segments in order, where each segment begins, and how many it has."""
    ok = ~np.isnan(x)
    x, s = x[ok], seg[ok]
    n = np.bincount(s, minlength=k)
    return x[np.lexsort((x, s))], np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64), n


def _at_rank(x: np.ndarray, at: np.ndarray, n: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The value of the given rank (from 0, cut to what there is) of each segment; NaN where it has none."""
    out = np.full(len(n), np.nan)
    has = n > 0
    out[has] = x[(at + np.clip(np.floor(rank), 0, np.maximum(n - 1, 0)).astype(np.int64))[has]]
    return out


def _usual_rank(n: np.ndarray | float):
    return np.minimum(n * USUAL, n - 1.5 - LONGEST)


def _stuck_runs(v: np.ndarray, tol: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each reading, whether it repeats the one before, and the length of its run of repeats."""
    same = np.zeros(len(v), dtype=bool)
    with np.errstate(invalid="ignore"):
        same[1:] = np.abs(v[1:] - v[:-1]) <= tol[1:]
    same &= ~first
    run = np.cumsum(~same) - 1
    return same, np.bincount(run)[run]


def _clean(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which readings break a limit, and the values with those and the infinite ones taken out (NaN)."""
    with np.errstate(invalid="ignore"):
        bad = (v < low) | (v > high)
    return bad, np.where(bad | np.isinf(v), np.nan, v)


class _Measured:
    """Blocks with what their readings say of themselves: which break a limit, deviation, differences, repeats."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        f = self.blocks = Flat(batch)
        low, high, tol = (f.spread(c) for c in LIMITS)
        self.bad, self.w = _clean(f.v, low, high)
        self.off, self.level = _deviation(self.w, f.seg)
        self.tol = tol
        self.same, self.run = _stuck_runs(f.v, np.nan_to_num(tol, nan=0.0), f.first)

    def distributions(self) -> list[np.ndarray]:
        """Of the blocks' own readings: deviations and both differences, each where it is not 0, and all deviations."""
        f, w = self.blocks, self.w
        before = _shifted(w, f.seg, 1)
        d1, d2 = np.abs(w - before), np.abs(_shifted(w, f.seg, -1) - 2 * w + before)
        off = np.abs(self.off)
        return [np.where(f.own & (x > 0), x, np.nan) for x in (off, d1, d2)] + [np.where(f.own, off, np.nan)]

    def changes(self) -> tuple[np.ndarray, np.ndarray]:
        """Per block, readings that repeat the one before outside frozen runs, and those that do not repeat it."""
        f = self.blocks
        k = len(f.size)
        same = np.bincount(f.seg[f.own & self.same & (self.run < STUCK)], minlength=k)
        return same.astype(float), np.bincount(f.seg[f.own & ~self.same & ~f.first], minlength=k).astype(float)

    def flags(self, scales: list[np.ndarray], factors: Factors) -> tuple[np.ndarray, ...]:
        """Masks of readings: out of bounds, spike, stuck; and their deviations. ``scales`` are per block: n, s0, s1, s2, w0, same, moved."""
        f = self.blocks
        n, s0, s1, s2, w0, same, moved = (x[f.seg] for x in scales)
        spike, off = _spikes(self, n, (s0, s1, s2), w0, factors)
        stuck = (self.run >= STUCK) & (moved >= n / 2) & (moved >= factors.lively * (moved + same)) & ~np.isnan(self.tol)
        return self.bad & f.own, spike & f.own, stuck & f.own, off


def _outside(u: np.ndarray, off: np.ndarray, seg: np.ndarray, axes: list[np.ndarray]) -> np.ndarray:
    """Readings outside the ellipsoid whose half axes are ``axes``, over deviation, first and second difference."""
    before, after = _shifted(u, seg, 1), _shifted(u, seg, -1)
    d1 = np.fmax(np.abs(u - before), np.abs(u - after))
    d2 = np.abs(after - 2 * u + before)
    radius = sum(np.nan_to_num((x / a) ** 2, nan=0.0, posinf=np.inf) for x, a in zip((off, d1, d2), axes, strict=True))
    return (radius > 1) & (off != 0)


def _spikes(m: _Measured, n: np.ndarray, scales: tuple[np.ndarray, ...], w0: np.ndarray, factors: Factors) -> tuple[np.ndarray, np.ndarray]:
    """Phase-space thresholding with replacement until nothing new is flagged, then the exact check of every flagged run.

    Each round looks only at the blocks in which the round before flagged something, as nothing else can change.
    """
    seg, v = m.blocks.seg, m.blocks.v
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        reach = np.sqrt(2 * np.log(np.maximum(n, 3)))  # universal threshold, in units of each axis
        axes = [1.483 * reach * s for s in scales]
        flagged = _outside(m.w, m.off, seg, axes)
        final_off = m.off.copy()
        u, level, new = m.w.copy(), m.level.copy(), flagged
        while new.any():
            u[new] = level[new]
            changed = np.zeros(int(seg[-1]) + 1, dtype=bool)
            changed[seg[new]] = True
            at = np.flatnonzero(changed[seg])
            off_at, level_at = _deviation(u[at], seg[at])
            out = _outside(u[at], off_at, seg[at], [a[at] for a in axes]) & ~flagged[at]
            level[at] = level_at
            rest = ~flagged[at]
            final_off[at[rest]] = off_at[rest]
            new = np.zeros(len(u), dtype=bool)
            new[at[out]] = True
            flagged = flagged | new
        # Exact check: far beyond what is usual for the series, for at most LONGEST readings, and back again.
        usual = np.nan_to_num(w0)
        scale = np.fmax(factors.spike * scales[1], np.where(usual > factors.bursty * scales[1], factors.burst, factors.usual) * usual)
        far = flagged & (np.abs(final_off) > scale)
        far |= np.isinf(v) & ~m.bad
    odd = far | m.bad
    run = np.cumsum(starts([odd, seg])) - 1
    length = np.bincount(run)
    at = np.flatnonzero(starts([odd, seg]))
    end = at + length - 1
    inner = (at > 0) & (end < len(v) - 1)
    inner &= (seg[np.maximum(at - 1, 0)] == seg[at]) & (seg[np.minimum(end + 1, len(v) - 1)] == seg[at])
    return far & (inner & (length <= LONGEST))[run], final_off


def _merged(parts: list[list[tuple[np.ndarray, int]]]) -> list[tuple[np.ndarray, int]]:
    """Distributions of parts, each as order statistics and a count, put together; again at most ``POINTS`` of each."""
    out = []
    for own in zip(*parts, strict=True):
        x = np.concatenate([p for p, _ in own])
        w = np.concatenate([np.full(len(p), c / max(len(p), 1)) for p, c in own])
        order = np.argsort(x, kind="stable")
        x, cum = x[order], np.cumsum(w[order])
        if len(x) > POINTS:
            x = x[np.minimum(np.searchsorted(cum, (np.arange(POINTS) + 0.5) / POINTS * cum[-1]), len(x) - 1)]
        out.append((x, sum(c for _, c in own)))
    return out


class _Part:
    """What the blocks of one task say of a series of several blocks."""

    def __init__(self, sid: int) -> None:
        self.sid, self.n, self.same, self.moved, self.parts = sid, 0, 0.0, 0.0, []

    def add(self, n: int, same: float, moved: float, distributions: list[tuple[np.ndarray, int]]) -> None:
        self.n, self.same, self.moved = self.n + n, self.same + same, self.moved + moved
        self.parts.append(distributions)
        if len(self.parts) == 16:
            self.parts = [_merged(self.parts)]

    def row(self) -> dict:
        points = _merged(self.parts)
        return {"kind": PART, "series_id": self.sid, "n": self.n, "same": self.same, "moved": self.moved, "values": [x.tolist() for x, _ in points], "counts": [c for _, c in points]}


def _rows(count: int, **columns) -> pa.RecordBatch:
    """Rows of the first pass; columns not given are NULL."""
    schema = pa.schema([("kind", pa.int32()), ("series_id", pa.int64()), ("t", pa.int64()), ("v", pa.float64()), *[(c, pa.bool_()) for c in ("out_of_bounds", "spike", "stuck")], ("off", pa.float64()), ("n", pa.int64()), *[(c, pa.float64()) for c in ("same", "moved", "s1", "w0")], ("values", pa.list_(pa.list_(pa.float64()))), ("counts", pa.list_(pa.int64()))])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in schema], schema=schema)


def _first_pass(factors: Factors):
    """Flags of series of one block, their scales if they are long enough, and a row per task of each longer series."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in grouped(batches):
            m = _Measured(batch)
            f = m.blocks
            k = len(f.size)
            alone = f.size == f.n
            same, moved = m.changes()
            ordered = [_sorted_per(x, f.seg, k) for x in m.distributions()]
            s0, s1, s2 = (_at_rank(x, at, c, c * 0.5) for x, at, c in ordered[:3])
            n = f.n.astype(float)
            w0 = _at_rank(*ordered[3], _usual_rank(n))
            bad, spike, stuck, off = m.flags([n, s0, s1, s2, w0, same, moved], factors)
            keep = (bad | spike | stuck) & alone[f.seg]
            sid = f.column("series_id")
            yield _rows(int(keep.sum()), kind=np.full(int(keep.sum()), FLAG), series_id=sid[f.seg[keep]], t=f.t[keep], v=f.v[keep], out_of_bounds=bad[keep], spike=spike[keep], stuck=stuck[keep], off=np.abs(off[keep]), n=f.n[f.seg[keep]])
            own = alone & (f.n >= factors.known)
            yield _rows(int(own.sum()), kind=np.full(int(own.sum()), SCALES), series_id=sid[own], n=f.n[own], s1=s1[own], w0=w0[own])
            for i in np.flatnonzero(~alone):
                if part is None or part.sid != sid[i]:
                    if part is not None:
                        yield pa.RecordBatch.from_pylist([part.row()], schema=_rows(0).schema)
                    part = _Part(int(sid[i]))
                part.add(int(f.n[i]), same[i], moved[i], _merged([[(x[at[i] : at[i] + c[i]], int(c[i])) for x, at, c in ordered]]))
        if part is not None:
            yield pa.RecordBatch.from_pylist([part.row()], schema=_rows(0).schema)

    return judge


def _second_pass(factors: Factors):
    """Flags of blocks by the scales of their whole series."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches):
            m = _Measured(batch)
            f = m.blocks
            bad, spike, stuck, _ = m.flags([f.column(c).astype(float) for c in ("series_n", *AXES, "w0", "same", "moved")], factors)
            keep = bad | spike | stuck
            arrays = [f.column("series_id")[f.seg[keep]], f.t[keep], f.v[keep], bad[keep], spike[keep], stuck[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], [c.split()[0] for c in FLAGS.split(", ")])

    return judge


def _weighted_quantile(k: int, rank: str) -> str:
    """SQL for the least point of the ``k``-th distribution up to which the weights come to more than ``rank``."""
    points = f"array_sort(flatten(transform(rows, r -> transform(r.values[{k}], x -> named_struct('x', x, 'w', r.counts[{k}] / size(r.values[{k}]))))))"
    step = "(a, p) -> named_struct('w', a.w + p.w, 'x', if(a.w <= a.r, p.x, a.x), 'r', a.r)"
    return f"aggregate({points}, named_struct('w', 0D, 'x', cast(null as double), 'r', cast({rank} as double)), {step}).x"


def series_scales(parts: DataFrame) -> DataFrame:
    """``(series_id, series_n, s0, s1, s2, w0, same, moved)`` of series of several blocks, from a row per series and task.

    Each row has at most ``POINTS`` order statistics of each distribution, so what is gathered for a series is
    bounded by the number of tasks, not by its readings.
    """
    pooled = parts.groupBy("series_id").agg(F.sum("n").alias("series_n"), F.sum("same").alias("same"), F.sum("moved").alias("moved"), F.collect_list(F.struct("values", "counts")).alias("rows"))
    total = lambda k: f"aggregate(rows, 0L, (a, r) -> a + r.counts[{k}])"
    axes = [F.expr(_weighted_quantile(k, f"{total(k)} * 0.5D")).alias(name) for k, name in enumerate(AXES)]
    w0 = F.expr(_weighted_quantile(3, f"least(series_n * {USUAL}D, series_n - 1.5D - {LONGEST})")).alias("w0")
    return pooled.select("series_id", "series_n", *axes, w0, "same", "moved")


def implausible(samples: DataFrame, series: DataFrame, metric_ref: DataFrame, factors: Factors = Factors(), rows: int = BLOCK_ROWS) -> DataFrame:  # noqa: B008
    """``(series_id, t, v, out_of_bounds, spike, stuck)`` of every reading that is implausible for its series.

    ``samples`` are raw inserts, ``series`` registrations and ``metric_ref`` the limits of the metrics; NULL limits do not
    bind and without ``same_tol`` nothing is stuck. A *spike* is a run of one to three readings outside
    the robust ellipsoid over value, first and second difference (flagged readings are replaced by the level and
    the rest looked at again, until nothing new is flagged), off the level on both sides by more
    than ``factors.spike`` times the usual step and ``factors.usual`` times the deviation that one reading in
    twenty has anyway (``factors.burst`` times in a series with bursts of its own, so those stay). A series of fewer than
    ``factors.known`` readings says little of its own scales: its spikes must also be that far off by the median scales
    of the longer series of its metric, and without such series it has none. *Stuck* is a
    run of ten readings or more that all repeat, in a series of which at least half of all readings, and the
    share ``factors.lively`` of those outside such runs, differ from the one before. Infinite values within the limits
    count as spikes. Rows with a NULL series or time, or whose last version is NULL or NaN, are left out. An empty input
    gives an empty result. ``rows`` bounds the readings of a block.
    """
    limits = series_limits(series, metric_ref)
    blocked = blocks(samples, limits, LIMITS, rows, MARGIN)
    first = cut_lineage(blocked.mapInArrow(_first_pass(factors), FIRST_PASS))  # flags, scales and parts: few rows, read four times
    flags = first.where(f"kind = {FLAG}")
    names = [c.split()[0] for c in FLAGS.split(", ")]
    # Spikes of short series, and the scales of their metrics.
    metric = limits.select("series_id", F.coalesce("metric_name", F.lit("")).alias("metric_name"))
    middle = lambda c: F.percentile_approx(c, 0.5, 10_000).alias(f"metric_{c}")
    scaled = first.where(f"kind = {SCALES}").join(metric, "series_id", "left").withColumn("metric_name", F.coalesce("metric_name", F.lit("")))
    usual = scaled.groupBy("metric_name").agg(middle("s1"), middle("w0"))
    short = f"spike AND n < {factors.known} AND abs(v) < double('infinity')"
    far = F.col("off") > F.greatest(F.col("metric_s1") * factors.spike, F.col("metric_w0") * F.when(F.col("metric_w0") > factors.bursty * F.col("metric_s1"), factors.burst).otherwise(factors.usual))
    candidates = flags.where(short).join(metric, "series_id", "left").withColumn("metric_name", F.coalesce("metric_name", F.lit("")))
    judged = candidates.join(usual, "metric_name", "left").withColumn("spike", F.coalesce(far, F.lit(False))).where("spike OR out_of_bounds OR stuck")
    # Series of several blocks: their scales go to the blocks by part, so that a hot series stays spread.
    several = blocked.where("size(ts) > n")
    scales = series_scales(first.where(f"kind = {PART}"))
    per_block = several.select("part", "series_id").join(scales, "series_id").drop("series_id")
    again = several.join(per_block, "part").mapInArrow(_second_pass(factors), FLAGS)
    return flags.where(f"NOT ({short})").select(*names).unionByName(judged.select(*names)).unionByName(again)
