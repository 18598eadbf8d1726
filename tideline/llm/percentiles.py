"""Exact percentiles of large groups by distributed multi-select over sorted partial blocks.

The partial result of a day (or file) is its *blocks*: sorted values of one source. Blocks of more days are combined by
union. Groups overlap (a source has many tags), so values are never copied per group: a block knows the
groups it belongs to.

A group with many values is searched in rounds. Every task proposes, per group and percentile, the
local median of what is still in question; the weighted median of the proposals is the pivot; all tasks
count the values below, at and above it; the ranges that the wanted rank rules out are discarded, and every
few rounds the blocks are written again with only the values that are still in question. The same
pass that counts also gathers the local medians on either side, so a round is one pass. Once few values of a group are
left they are gathered and the wanted one is taken. Small groups are gathered at once.

What is open of each group and percentile (range, rank, pivot) is a table. Up to ``HELD`` rows of it are sent to the tasks
with their code; a larger one is joined to the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tideline.operators.ids import dense_ids
from tideline.session import cut_lineage, written

GATHER = 4_096  # values of a group that are put in order in one task
HELD = 60_000  # open percentiles whose ranges and pivots (some 50 bytes each) are sent to all tasks
REWRITE = 3  # rounds after which the blocks are written again without the values that are ruled out
LONG = 2_048  # values from which a block is searched by bisection
SALTS = 16  # over which the memberships of a large group are spread
PACKED = "part long, data array<double>, gids array<bigint>"
PROPOSALS = "k long, below long, same long, low_median double, low_n long, high_median double, high_n long"

Asked = dict[int, list[tuple[int, float, float, float]]]  # group to (k, low, high, pivot); bounds exclusive, NaN for none


def blocks(readings: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """``keys, data, n``: the sorted values of each ``keys``, a partial result that may be kept and combined.

    ``keys`` are the source and a span of time short enough for its values to fit into a row. NULL and NaN
    are no values. Where one source may have any number of values, :func:`from_blocks` bounds the rows.
    """
    valid = readings.where(F.col(value).isNotNull() & ~F.isnan(value))
    return valid.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(value) + F.lit(0.0))).alias("data"), F.count(F.lit(1)).alias("n"))


def from_blocks(blocked: DataFrame) -> DataFrame:
    """``series_id, data, n``: the same from blocks of readings, which are of bounded size."""
    own = F.transform(F.slice("vs", F.col("lead") + 1, F.col("n")), lambda x: x + F.lit(0.0))
    return blocked.select("series_id", F.sort_array(own).alias("data"), F.col("n").cast("bigint").alias("n"))


def _nearest_rank(n: str, q: float):
    return F.greatest(F.ceil(F.round(F.col(n) * q, 9)), F.lit(1))


def _weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    cum = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(cum, cum[-1] / 2)])


def _asked_of(batch: pa.RecordBatch) -> Asked:
    """What is asked of the groups of a batch, from its column."""
    asks = batch.column("asks").flatten()
    gid, k, low, high, pivot = (asks.field(i).to_numpy(zero_copy_only=False) for i in range(5))
    _, one = np.unique(k, return_index=True)
    out: Asked = {}
    for i in one.tolist():
        out.setdefault(int(gid[i]), []).append((int(k[i]), low[i], high[i], pivot[i]))
    return out


class _Batch:
    """Blocks of an Arrow batch and the groups they belong to."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        data, gids = batch.column("data"), batch.column("gids")
        self.values = data.flatten().to_numpy()
        self.size = data.value_lengths().to_numpy().astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.int64)
        self.row = np.repeat(np.arange(len(self.size)), gids.value_lengths().to_numpy())
        self.gid = gids.flatten().to_numpy()

    def groups(self) -> Iterator[tuple[int, np.ndarray, list[slice]]]:
        """Each group with the places of the values in its short blocks, and its long blocks."""
        order = np.argsort(self.gid, kind="stable")
        gid, row = self.gid[order], self.row[order]
        cut = np.flatnonzero(np.append(True, gid[1:] != gid[:-1])) if len(gid) else np.array([], dtype=np.int64)
        for a, b in zip(cut, np.append(cut[1:], len(gid)), strict=True):
            own = row[a:b]
            short = own[self.size[own] < LONG]
            n = self.size[short]
            places = np.repeat(self.at[short] - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield int(gid[a]), places, [slice(self.at[r], self.at[r] + self.size[r]) for r in own[self.size[own] >= LONG]]


def _between(x: np.ndarray, low: float, high: float) -> np.ndarray:
    mask = np.ones(len(x), dtype=bool) if np.isnan(low) else x > low
    return mask if np.isnan(high) else mask & (x < high)


def _inside(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """The part of the sorted ``x`` between the bounds."""
    a = 0 if np.isnan(low) else int(np.searchsorted(x, low, side="right"))
    return x[a : len(x) if np.isnan(high) else max(a, int(np.searchsorted(x, high, side="left")))]


def _middle(x: np.ndarray) -> float:
    return float(np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2])


def _count(asked: Asked | None):
    """One round in one task: three-way counts against the pivots and local medians on either side."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}  # k to values below, at the pivot, and (median, count) on either side

        def note(k: int, less: tuple[float, int] | None, same: int, more: tuple[float, int] | None) -> None:
            own = sums.setdefault(k, [0, 0, [], []])
            own[1] += same
            for side, got in ((2, less), (3, more)):
                if got is None:
                    continue
                own[0] += got[1] if side == 2 else 0
                own[side].append(got)
                if len(own[side]) == 512:
                    m, n = np.array(own[side]).T
                    own[side] = [(_weighted_median(m, n), int(n.sum()))]

        for batch in batches:
            blocks_, open_ = _Batch(batch), _asked_of(batch) if asked is None else asked
            for gid, places, long in blocks_.groups():
                questions = open_.get(gid, ())
                x = blocks_.values[places] if questions and len(places) else None
                for k, low, high, pivot in questions:
                    if x is not None:
                        own = x[_between(x, low, high)]
                        less = own if np.isnan(pivot) else own[own < pivot]
                        more = own[own > pivot]
                        note(k, (_middle(less), len(less)) if len(less) else None, len(own) - len(less) - len(more), (_middle(more), len(more)) if len(more) else None)
                    for place in long:
                        own = _inside(blocks_.values[place], low, high)
                        a, b = (len(own), len(own)) if np.isnan(pivot) else (int(np.searchsorted(own, pivot, side="left")), int(np.searchsorted(own, pivot, side="right")))
                        note(k, (float(own[(a - 1) // 2]), a) if a else None, b - a, (float(own[(b + len(own) - 1) // 2]), len(own) - b) if b < len(own) else None)
        if sums:
            pick = lambda side: [_weighted_median(*np.array(s[side]).T) if s[side] else None for s in sums.values()]
            total = lambda side: [sum(n for _, n in s[side]) for s in sums.values()]
            columns = [list(sums), [s[0] for s in sums.values()], [s[1] for s in sums.values()], pick(2), total(2), pick(3), total(3)]
            kinds = [pa.float64() if "double" in c else pa.int64() for c in PROPOSALS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in PROPOSALS.split(", ")])

    return count


def _narrow(asked: Asked | None):
    """Blocks with only the values that are still in question for one of their groups; blocks without any are left out."""

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks_, open_ = _Batch(batch), _asked_of(batch) if asked is None else asked
            keep = np.zeros(len(blocks_.values), dtype=bool)
            for gid, places, long in blocks_.groups():
                for _, low, high, _ in open_.get(gid, ()):
                    keep[places] |= _between(blocks_.values[places], low, high)
                    for place in long:
                        keep[place] |= _between(blocks_.values[place], low, high)
            left = np.add.reduceat(np.append(keep, False), blocks_.at) * (blocks_.size > 0) if len(blocks_.at) else np.array([], np.int64)
            rows = np.flatnonzero(left)
            data = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(left[rows]))), pa.int32()), pa.array(blocks_.values[keep]))
            yield pa.RecordBatch.from_arrays([batch.column("part").take(pa.array(rows)), data, batch.column("gids").take(pa.array(rows))], ["part", "data", "gids"])

    return narrow


def _remaining(asked: Asked | None):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks_, open_ = _Batch(batch), _asked_of(batch) if asked is None else asked
            ks, lists = [], []
            for gid, places, long in blocks_.groups():
                for k, low, high, _ in open_.get(gid, ()):
                    x = blocks_.values[places]
                    for own in (x[_between(x, low, high)], *(_inside(blocks_.values[place], low, high) for place in long)):
                        if len(own):
                            ks.append(k)
                            lists.append(own)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in lists]))), pa.int32())
            flat = pa.array(np.concatenate(lists) if lists else np.array([], np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["k", "data"])

    return gather


def _ask(packed: DataFrame, open_: DataFrame | list[Row], function: Callable, schema: str) -> DataFrame:
    """``function`` over the blocks, knowing the open rows: with its code if they are a list, else joined to the blocks."""
    columns = ["gid", "k", "low", "high", "pivot"]
    if isinstance(open_, list):
        asked: Asked = {}
        nan = lambda x: float("nan") if x is None else x
        for r in open_:
            asked.setdefault(r.gid, []).append((r.k, nan(r.low), nan(r.high), nan(r.pivot)))
        return packed.mapInArrow(function(asked), schema)
    # A large group has many blocks: its open rows are repeated over salts, so that no task gets all of them.
    salted = open_.select(*columns, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    of_block = packed.select("part", F.explode("gids").alias("gid"), F.pmod(F.xxhash64("part"), F.lit(SALTS)).cast("int").alias("salt"))
    asks = of_block.join(salted, ["gid", "salt"]).groupBy("part").agg(F.collect_list(F.struct(*columns)).alias("asks"))
    return packed.join(asks, "part").mapInArrow(function(None), schema)


def _median_of(side: str) -> str:
    """SQL for the weighted median of an array of ``x, w``."""
    total = f"aggregate({side}, 0D, (a, p) -> a + p.w)"
    step = "(a, p) -> named_struct('w', a.w + p.w, 'x', if(a.w < a.r, p.x, a.x), 'r', a.r)"
    return f"aggregate(array_sort({side}), named_struct('w', 0D, 'x', cast(null as double), 'r', {total} / 2), {step}).x"


def multi_select(packed: DataFrame, sizes: DataFrame, percentiles: Sequence[float]) -> DataFrame:
    """``(gid, q, x)``: the value ``x`` at the ``q``-th of the ``percentiles`` (nearest rank) of every group, searched in rounds.

    ``packed`` has ``part`` (unique), ``data``, sorted values, and ``gids``, the groups they belong to; ``sizes`` has
    ``gid, n``, the values of each group. A group leaves the rounds when its pivot is the answer or at most
    ``GATHER`` values are left, of which the wanted is then taken. Every round rules out the pivot at least, and
    as a rule half of the values.
    """
    wide = len(percentiles)
    null = F.lit(None).cast("double")
    ranks = F.array(*[F.struct(F.lit(i).alias("q"), _nearest_rank("n", p).alias("rank")) for i, p in enumerate(percentiles)])
    state = sizes.select("gid", "n", F.inline(ranks)).select("gid", (F.col("gid") * wide + F.col("q")).alias("k"), "q", null.alias("low"), null.alias("high"), "rank", "n", null.alias("pivot"), null.alias("x"))
    few = state.limit(HELD + 1).count() <= HELD
    search = _search_few if few else _search_many
    state, packed = search(packed, state)
    rest = _ask(packed, state.where("x IS NULL").collect() if few else state.where("x IS NULL"), _remaining, "k long, data array<double>")
    ordered = rest.groupBy("k").agg(F.sort_array(F.flatten(F.collect_list("data"))).alias("data"))
    last = state.join(ordered, "k", "left")
    return last.select("gid", "q", F.coalesce("x", F.try_element_at("data", F.col("rank").cast("int"))).alias("x"))


def _proposed(packed: DataFrame, open_: DataFrame | list[Row]) -> DataFrame:
    """``k, below, same, low_pivot, high_pivot``: the counts of a round, and the weighted medians of what was proposed on either side."""
    side = lambda s: F.collect_list(F.when(F.col(f"{s}_n") > 0, F.struct(F.col(f"{s}_median").alias("x"), F.col(f"{s}_n").cast("double").alias("w")))).alias(s)
    both = _ask(packed, open_, _count, PROPOSALS).groupBy("k").agg(F.sum("below").alias("below"), F.sum("same").alias("same"), side("low"), side("high"))
    return both.select("k", "below", "same", F.expr(_median_of("low")).alias("low_pivot"), F.expr(_median_of("high")).alias("high_pivot"))


def _narrowed(state: DataFrame) -> DataFrame:
    """Open rows with their counts, after the part of the range was discarded in which the wanted rank is not.

    Rows without counts stay as they are. In its first round a row has no pivot yet and only gets one.
    """
    passed = F.col("below") + F.col("same")
    under = (F.col("rank") <= F.col("below")) | F.col("pivot").isNull()
    hit = ~under & (F.col("rank") <= passed)
    pick = lambda as_it_was, less, equal, more: F.when(F.col("below").isNull(), as_it_was).when(hit, equal).when(under, less).otherwise(more)
    low, high, rank, n, pivot, x = (F.col(c) for c in ("low", "high", "rank", "n", "pivot", "x"))
    return state.select(
        "gid", "k", "q",
        pick(low, low, low, pivot).alias("low"),
        pick(high, F.coalesce("pivot", "high"), high, high).alias("high"),
        pick(rank, rank, rank, rank - passed).alias("rank"),
        pick(n, F.col("below"), n, n - passed).alias("n"),
        pick(pivot, F.col("low_pivot"), pivot, F.col("high_pivot")).alias("pivot"),
        pick(x, x, pivot, x).alias("x"),
    )


def _search_few(packed: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rounds, with what is open held between them: at most ``HELD`` rows. One job a round."""
    spark, schema = packed.sparkSession, state.schema
    held, rounds = state.collect(), 0
    while True:
        searched = [r for r in held if r.x is None and (r.n > GATHER or not rounds)]
        if not searched:
            return spark.createDataFrame(held, schema), packed
        if rounds and rounds % REWRITE == 0:
            packed = cut_lineage(_ask(packed, [r for r in held if r.x is None], _narrow, PACKED))
        now = _proposed(packed, searched).join(F.broadcast(spark.createDataFrame(searched, schema)), "k")
        new = {r.k: r for r in _narrowed(now).collect()}
        held, rounds = [new.get(r.k, r) for r in held], rounds + 1


def _search_many(packed: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rounds, with what is open as a table that is joined to the blocks, whatever its size."""
    state, rounds = cut_lineage(state), 0
    while True:
        open_ = state.where("x IS NULL")
        searched = open_ if not rounds else open_.where(F.col("n") > GATHER)
        if searched.isEmpty():
            return state, packed
        if rounds and rounds % REWRITE == 0:
            packed = cut_lineage(_ask(packed, open_, _narrow, PACKED))
        state = cut_lineage(_narrowed(state.join(_proposed(packed, searched), "k", "left")))
        rounds += 1


def group_percentiles(parts: DataFrame, members: DataFrame, source: str, keys: Sequence[str], percentiles: Sequence[float]) -> DataFrame:
    """``keys, n`` and ``p<100 q>`` for each percentile ``q``: the value of nearest rank, ceil(q n), of each group.

    ``parts`` are blocks (``source, data, n``), of any number of days or files; ``members`` has ``source, keys``,
    repeated rows counting once. NULL is a key like any other. The result is exact: its rank error is 0.

    Groups of more than ``GATHER`` values, however many, go through :func:`multi_select`. The other groups are gathered, as
    sorted blocks, and ordered group by group; a source of more values than that has no such group, so its
    blocks take no part. Memberships of large groups are spread over salts before they are joined, and blocks meet
    their groups by block, not by source.
    """
    parts = cut_lineage(parts.where(F.col(source).isNotNull()).select(source, "data", "n").withColumn("part", F.monotonically_increasing_id()))
    per_source = parts.groupBy(source).agg(F.sum("n").alias("n"))
    tags = members.where(F.col(source).isNotNull()).groupBy(source).agg(F.collect_set(F.struct(*keys)).alias("_tags"))
    # Names and values recur, so a table in columns is small; it is read three times.
    membership = written(tags.join(per_source, source)).select(source, F.col("n").alias("_n"), F.inline("_tags"))
    totals = written(membership.groupBy(*keys).agg(F.sum("_n").alias("n")))
    large = cut_lineage(dense_ids(totals.where(F.col("n") > GATHER), [*keys, "n"], "gid"))
    spread = large.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "gid", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64(F.col(source)), F.lit(SALTS)).cast("int")
    match = [membership[k].eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)] + [salt == F.col("_salt")]
    names = [f"p{100 * q:g}".replace(".", "_") for q in percentiles]
    few = membership.drop("_n").join(spread, match, "left_anti")
    ordered = few.join(parts.where(F.col("n") <= GATHER), source).groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("data"))).alias("data"))
    ordered = ordered.withColumn("n", F.size("data").cast("bigint"))
    result = ordered.select(*keys, "n", *[F.element_at("data", _nearest_rank("n", q).cast("int")).alias(name) for q, name in zip(percentiles, names, strict=True)])
    groups = membership.join(spread, match).groupBy(source).agg(F.collect_set("gid").alias("gids"))
    of_part = parts.select("part", source).join(groups, source).select("part", "gids")
    packed = cut_lineage(parts.select("part", "data").join(of_part, "part").select("part", "data", "gids"))
    found = multi_select(packed, large.select("gid", "n"), percentiles)
    wide = found.groupBy("gid").agg(*[F.max(F.when(F.col("q") == i, F.col("x"))).alias(name) for i, name in enumerate(names)])
    return result.unionByName(large.join(wide, "gid").select(*keys, "n", *names))
