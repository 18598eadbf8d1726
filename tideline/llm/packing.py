"""Items into containers of fixed capacity by hierarchical residual packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import cut_lineage

TASK_ITEMS = 40_000  # items a task packs together
FAN_IN = 4  # tasks whose underfull bins meet in one task of the next round
FULL = 0.98  # fill from which a bin is emitted at once

BINS = "used long, members array<struct<id:long,part:int,size:long>>, done boolean"


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size: best fit in decreasing order. Open bins are kept by residual, found by bit tricks."""
    by_residual: dict[int, list[int]] = {}
    mask, bins = 0, 0
    out = np.empty(len(sizes), dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = mask >> size
        if fitting:
            residual = size + (fitting & -fitting).bit_length() - 1
            stack = by_residual[residual]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << residual)
        else:
            residual, b = capacity, bins
            bins += 1
        out[i] = b
        left = residual - size
        by_residual.setdefault(left, []).append(b)
        mask |= 1 << left
    return out


def _pack(capacity: int, last: bool):
    """One round in one task: its bins, each an item of the next round unless it is done."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        # Rows arrive in shuffle order; a fixed order makes a repeated task give the same bins.
        table = table.take(pa.array(np.lexsort((table.column("part").to_numpy(), table.column("id").to_numpy()))))
        used = table.column("used").to_numpy()
        bin_of = best_fit(used, capacity)
        order = np.argsort(bin_of, kind="stable")
        k = int(bin_of.max()) + 1
        total = np.bincount(bin_of, weights=used, minlength=k).astype(np.int64)
        members = table.column("members").chunk(0).take(pa.array(order))
        per_row = np.diff(members.offsets.to_numpy())
        per_bin = np.bincount(bin_of[order], weights=per_row, minlength=k).astype(np.int64)
        offsets = pa.array(np.concatenate(([0], np.cumsum(per_bin))), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, members.flatten())
        done = total >= FULL * capacity if not last else np.ones(k, dtype=bool)
        batch = pa.RecordBatch.from_arrays([pa.array(total), lists, pa.array(done)], ["used", "members", "done"])
        yield from (batch.slice(i, 10_000) for i in range(0, k, 10_000))

    return pack


def cut_to_capacity(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``(id, part, size)``: an item over the capacity in parts of the capacity and a last, smaller one; others whole."""
    parts = F.sequence(F.lit(0), F.expr(f"cast((`{size}` - 1) div {capacity} as int)"))
    cut = items.where(F.col(key).isNotNull() & (F.col(size) > 0)).select(F.col(key).cast("bigint").alias("id"), F.col(size).cast("bigint").alias("whole"), F.explode(parts).alias("part"))
    return cut.select("id", "part", F.least(F.lit(capacity).cast("bigint"), F.col("whole") - F.col("part").cast("bigint") * capacity).alias("size"))


def least_containers(parts: DataFrame, size: str, capacity: int, steps: int = 32) -> DataFrame:
    """``least``: so many containers at least do the given parts (of at most ``capacity``) need, by volume and by large parts.

    For a threshold k up to half the capacity: parts over capacity - k leave no room for any part of k or more; parts over half
    the capacity are alone among their like; what parts between k and half the capacity need beyond the room that the latter leave
    takes containers of its own. The best of ``steps`` thresholds counts; k = 0 is the volume alone.
    """
    s, half = F.col(size), capacity // 2
    bounds = []
    for k in sorted({half * i // steps for i in range(steps + 1)}):
        huge, large, middle = s > capacity - k, (s > half) & (s <= capacity - k), (s >= k) & (s <= half)
        room = F.count_if(large) * capacity - F.coalesce(F.sum(F.when(large, s)), F.lit(0))
        beyond = F.greatest(F.coalesce(F.sum(F.when(middle, s)), F.lit(0)) - room, F.lit(0))
        bounds.append(F.count_if(huge) + F.count_if(large) + F.ceil(beyond / capacity))
    return parts.agg(F.greatest(*bounds).alias("least"))


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``(container, id, part, size, used)``: every item in a container of ``capacity``, with little left over.

    Items are distributed by a hash of their key. Each task packs its own by best fit in decreasing order and
    emits the bins that are at least ``FULL``. The underfull bins are the items of the next round, in which
    ``FAN_IN`` tasks' worth of them meet in one task, and so on up the tree, until one task holds the rest. A task
    never gets more than about ``TASK_ITEMS`` bins, so no step gathers an unbounded set; where that bound keeps the tree from
    narrowing, it ends after a round that joined fewer than one bin in 30: each bin was then tried against ``TASK_ITEMS``
    others, so what is left (bins over half full, as a rule) does not fit together. Bins carry their members, at most
    ``capacity`` as each has a size of 1 or more.

    An item is split only if it alone exceeds the capacity, into parts of the capacity and a remainder. Items
    of size 0, NULL size or NULL key take no space and are in no container. ``container`` is the
    ``id-part`` of one of its members, so unique. Repeated keys must be made unique by the caller.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    parts = cut_to_capacity(items, key, size, capacity)
    one = F.array(F.struct("id", "part", "size"))
    level = parts.select("id", "part", F.col("size").alias("used"), one.alias("members"))
    emitted: list[DataFrame] = []
    count = cut = None
    while True:
        if count is None:
            level = cut_lineage(level)
            count = level.count()
        tasks = max(1, -(-count // TASK_ITEMS), -(-cut // FAN_IN) if cut else 0)
        last = tasks == 1
        spread = F.pmod(F.xxhash64("id", "part", F.lit(len(emitted))), F.lit(tasks)).cast("int")
        placed = level.withColumn("task", spread)
        # By number, not by its hash: every task gets its own share of the items and no other.
        placed = placed.repartitionById(tasks, "task") if tasks > 1 else placed.coalesce(1)
        bins = cut_lineage(placed.drop("task").mapInArrow(_pack(capacity, last), BINS))
        emitted.append(bins.where("done"))
        if last:
            break
        rest = bins.where("NOT done")
        left = rest.count()
        bound = -(-left // TASK_ITEMS) > -(-tasks // FAN_IN)
        if bound and left * 30 > count * 29:
            emitted.append(rest)
            break
        level = rest.select(F.col("members")[0]["id"].alias("id"), F.col("members")[0]["part"].alias("part"), "used", "members")
        count, cut = left, tasks
        if not left:
            break
    out = emitted[0]
    for more in emitted[1:]:
        out = out.unionByName(more)
    head = F.concat_ws("-", F.col("members")[0]["id"], F.col("members")[0]["part"])
    return out.select(head.alias("container"), "used", F.explode("members").alias("m")).select("container", "m.id", "m.part", "m.size", "used")
