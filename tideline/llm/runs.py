"""Runs of near-identical consecutive events, by optimal segmentation with pruned dynamic programming."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.batches import starts, whole_groups
from tideline.operators.blocks import Flat, grouped
from tideline.session import cut_lineage

PIECES = "series_id long, t_start long, t_end long, n long, v_sum double, tol double, opens boolean, closes boolean, froms array<long>, tos array<long>, levels array<double>, weights array<long>"
RUNS = "series_id long, t_start long, t_end long, n long, v_sum double"


def forced_cuts(v: np.ndarray, first: np.ndarray, penalty: np.ndarray, step: float, level: float) -> np.ndarray:
    """Mask of places where every cheapest segmentation begins a run, whatever comes before or after.

    A run that holds both readings of a difference d costs ``step`` d for it and ``level`` d^2/2 at least for the
    distances of these two from their mean. To set both readings apart takes three boundaries more, so no
    cheapest segmentation holds them together if that is more than three penalties. Where levels count,
    infinite values are runs of their own. What lies between two such places can be segmented for itself.
    """
    cut = first.copy()
    with np.errstate(invalid="ignore", over="ignore"):
        d = np.where(v[1:] == v[:-1], 0.0, np.abs(v[1:] - v[:-1]))
        cut[1:] |= ~(step * d + (level * d * d / 2 if level else 0.0) <= 3 * penalty[1:])
    if level:
        cut[1:] |= ~np.isfinite(v[1:]) | ~np.isfinite(v[:-1])
    return cut


def _cheapest(values: list[float], weights: list[int], penalty: float, step: float, level: float) -> list[int]:
    """First places of the runs of the cheapest segmentation of one stretch.

    F(i), the least cost of the events up to i, is the least over all last boundaries s of F(s) + penalty +
    the dissimilarity of s..i. A candidate s costs, as a function of the level m its run will turn out to have,
    base + level * (spread + n (mean - m)^2). What further events add is the same function of m for all
    candidates, so on any part of the axis the dearer of two can never win again: each candidate keeps the part
    of the axis on which it is the cheapest, and is pruned for good once it has none. A new candidate costs the
    same at every m and takes the parts where the others cost more; of equal costs the one with fewer boundaries
    stays. Where levels do not count, costs do not depend on m and one comparison is left of this. Costs are kept
    relative to the least, so they do not grow.
    """
    inf = math.inf
    best = [0]
    first = [0, 0.0, weights[0], values[0], 0.0]  # start, base, weight, mean, spread
    alive = [first]
    axis = [(-inf, inf, first)]
    previous = values[0]
    for i in range(1, len(values)):
        x, w = values[i], weights[i]
        if step:
            d = 0.0 if x == previous else step * abs(x - previous)
            for c in alive:
                c[1] += d
        previous = x
        fresh = [i, penalty, 0, 0.0, 0.0]
        if level:
            parts = []
            for low, high, c in axis:
                room = penalty - c[1] - level * c[4]
                a, b = 1.0, 0.0
                if room >= 0:
                    reach = math.sqrt(room / (level * c[2]))
                    a, b = max(low, c[3] - reach), min(high, c[3] + reach)
                if a > b:
                    a = b = None
                if a is None or low < a:
                    if parts and parts[-1][2] is fresh:
                        parts[-1] = (parts[-1][0], high if a is None else a, fresh)
                    else:
                        parts.append((low, high if a is None else a, fresh))
                if a is not None:
                    parts.append((a, b, c))
                    if b < high:
                        parts.append((b, high, fresh))
            axis = parts
            alive = list({id(c): c for _, _, c in axis}.values())
            least, start = None, 0
            for c in alive:
                n = c[2] + w
                delta = x - c[3]
                c[3] += delta * w / n
                c[4] += w * delta * (x - c[3])
                c[2] = n
                cost = c[1] + level * c[4]
                if least is None or cost < least or (cost == least and c[0] < start):
                    least, start = cost, c[0]
            for c in alive:
                c[1] -= least
        else:
            if alive[0][1] > penalty:
                alive = [fresh]
            start = alive[0][0]
            alive[0][1] = 0.0
        best.append(start)
    out, i = [], len(values) - 1
    while i >= 0:
        out.append(best[i])
        i = best[i] - 1
    return out


def cheapest_cuts(v: np.ndarray, begins: np.ndarray, penalty: np.ndarray, step: float = 1.0, level: float = 0.0, weight: np.ndarray | None = None) -> np.ndarray:
    """Mask of the places that begin a run in the cheapest segmentation of each stretch; ``begins`` marks the stretches.

    The cost of a segmentation is the dissimilarity within its runs plus ``penalty`` for every boundary. The
    dissimilarity of a run is ``step`` times the differences of consecutive values and ``level`` times the squared
    distances from the mean. Equal neighbours are one event with a ``weight``: no cheapest segmentation needs a
    cut between them. Stretches of one event are done; the others go through the dynamic program.
    """
    cut = begins.copy()
    point = begins.copy()
    point[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(point)
    if not len(at):
        return cut
    weight = np.ones(len(v), np.int64) if weight is None else weight
    w, x = np.add.reduceat(weight, at), v[at]
    begin = np.flatnonzero(begins[at])
    end = np.append(begin[1:], len(at))
    for a, b in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
        cut[at[a + np.array(_cheapest(x[a:b].tolist(), w[a:b].tolist(), float(penalty[at[a]]), step, level))]] = True
    return cut


def _segments(min_run: int, step: float, level: float):
    """Runs of each block, and what is open at its edges.

    A block is segmented with one reading of either neighbour. Where only steps count, the costs add up
    over consecutive readings, so this decides the cuts at its edges as well. Where levels count, only a stretch between
    forced cuts is settled; one that reaches a neighbour is handed on, equal readings as one point.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches):
            f = Flat(batch)
            place = np.arange(len(f.t)) - f.at[f.seg]
            near = (place >= f.lead[f.seg] - 1) & (place <= (f.lead + f.n)[f.seg])
            seg, t, v, own, place = f.seg[near], f.t[near], f.v[near], f.own[near], place[near]
            tol = np.nan_to_num(f.column("tol"), nan=0.0)[seg]
            cut = forced_cuts(v, starts([seg]), tol, step, level)
            stretch = np.cumsum(cut) - 1
            unsettled = np.zeros(len(v), dtype=bool)
            if level:
                reaches = np.bincount(stretch, weights=~own) > 0
                unsettled = reaches[stretch]
            if not unsettled.all():
                settled = ~unsettled
                cut[settled] = cheapest_cuts(v[settled], cut[settled], tol[settled], step, level)
            after = np.flatnonzero(~own & (place >= (f.lead + f.n)[seg]))
            goes_on = np.zeros(len(f.size), dtype=bool)
            goes_on[seg[after]] = ~cut[after]
            cut, unsettled, seg, t, v, tol = (x[own] for x in (cut, unsettled, seg, t, v, tol))
            first = starts([seg])
            opened = first & ~cut
            begins = cut | first
            at = np.flatnonzero(begins)
            end = np.append(at[1:], len(v)) - 1
            opens, closes = opened[at], np.append(first[1:], True)[end] & goes_on[seg[end]]
            n = end - at + 1
            keep = (n >= min_run) | opens | closes
            sid = f.column("series_id")[seg]
            # Points of the unsettled pieces, for the dynamic program over the whole stretch.
            handed = unsettled & (opens | closes)[np.cumsum(begins) - 1]
            point = begins.copy()
            point[1:] |= v[1:] != v[:-1]
            mine = np.flatnonzero(point & handed)
            last = np.append(np.flatnonzero(point)[1:], len(v))[(np.cumsum(point) - 1)[mine]] - 1
            counts = np.bincount((np.cumsum(keep) - 1)[(np.cumsum(begins) - 1)[mine]], minlength=int(keep.sum()))
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            with np.errstate(invalid="ignore"):
                columns = [sid[at], t[at], t[end], n, np.add.reduceat(v, at) if len(at) else v, tol[at], opens, closes]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (t[mine], t[last], v[mine], last - mine + 1)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[keep]) for c in columns), *lists], [p.split()[0] for p in PIECES.split(", ")])

    return segments


def _stretches(min_run: int, step: float, level: float):
    """Runs of each stretch that pieces of several blocks make up."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["series_id", "stretch"], 50_000):
            sid, stretch, tol = (table.column(c).to_numpy() for c in ("series_id", "stretch", "tol"))
            lists = [table.column(c).combine_chunks() for c in ("froms", "tos", "levels", "weights")]
            size = lists[0].value_lengths().to_numpy()
            t_from, t_to, v, w = (c.flatten().to_numpy() for c in lists)
            of = np.repeat(np.arange(len(size)), size)
            cut = cheapest_cuts(v, starts([sid[of], stretch[of]]), tol[of], step, level, w)
            at = np.flatnonzero(cut)
            end = np.append(at[1:], len(v)) - 1
            n = np.add.reduceat(w, at)
            keep = n >= min_run
            columns = [sid[of][at], t_from[at], t_to[end], n, np.add.reduceat(v * w, at)]
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], [p.split()[0] for p in RUNS.split(", ")])

    return stretches


def collapse(blocked: DataFrame, min_run: int = 1, step: float = 1.0, level: float = 0.0) -> DataFrame:
    """``(series_id, t_start, t_end, n, duration_ms, v_mean)`` of every run of at least ``min_run`` readings.

    ``blocked`` are blocks with ``tol``, the penalty of a boundary in the series; a NULL ``tol`` counts as 0. The runs
    are those of the cheapest segmentation of each series (:func:`cheapest_cuts`). With ``step`` 1 and
    ``level`` 0 consecutive readings that differ by no more than ``tol`` share a run; with ``level`` 1 and ``step`` 0, a run stays
    near its mean, and ``tol`` is in squared units of the values. Time gaps do not end a run.

    Each block is segmented by itself, its edges with the help of its margins, so a series with any share of
    the rows is spread over as many tasks as its blocks. Where only steps count, what is left is to join
    the runs that go on in the next block, a row or two per block of such a series. Where levels count, what lies
    outside the :func:`forced_cuts` of a block is segmented together with what meets it from the
    neighbouring blocks, one task a stretch. So the cuts are those of the whole series, whatever the size
    of the blocks. A stretch holds equal neighbours as one point; one without any forced cut over many blocks is still one task.
    """
    if min_run < 1:
        raise ValueError("min_run must be at least 1")
    pieces = cut_lineage(blocked.mapInArrow(_segments(min_run, step, level), PIECES))  # read twice below
    result = lambda df: df.select("series_id", "t_start", "t_end", "n", (F.col("t_end") - F.col("t_start")).alias("duration_ms"), (F.col("v_sum") / F.col("n")).alias("v_mean"))
    inner = pieces.where(f"NOT opens AND NOT closes AND n >= {min_run}")
    order = Window.partitionBy("series_id").orderBy("t_start")
    edge = pieces.where("opens OR closes").withColumn("run", F.sum(F.when(F.col("opens"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if level:
        stretched = edge.select("series_id", F.col("run").alias("stretch"), "t_start", "tol", "froms", "tos", "levels", "weights")
        ordered = stretched.repartition("series_id", "stretch").sortWithinPartitions("series_id", "stretch", "t_start")
        return result(inner).unionByName(result(ordered.mapInArrow(_stretches(min_run, step, level), RUNS)))
    joined = edge.groupBy("series_id", "run").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.sum("n").alias("n"), F.sum("v_sum").alias("v_sum"))
    return result(inner).unionByName(result(joined.where(f"n >= {min_run}")))
