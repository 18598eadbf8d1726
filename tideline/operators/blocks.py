"""Blocks: the readings of a series in order of time, in rows of bounded size whatever share of all rows it has.

Raw rows are range-partitioned by series, time, version and the task they come from. So partitions are even by
rows: a series with most of the rows, even a single point with most of them, is spread over as many partitions
as its rows need, and a series never meets another's rows out of order. Each partition is sorted
and streamed once: versions become readings, readings become blocks of at most ``BLOCK_ROWS``, and each block
carries ``MARGIN`` readings of what comes before and after it, so that what looks at neighbours needs no further
exchange. Attributes of a series (limits of its metric, say) travel as rows in front of its readings: a merge
join in the same exchange, in which the hot side is split as well.

What crosses partitions (margins, attributes, a point with versions on both sides) is one small row per
partition, so its size is bounded by the number of partitions; it is put right on the driver and sent back
as a broadcast of at most two rows per partition.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.batches import starts
from tideline.session import cut_lineage

BLOCK_ROWS = 32_768  # readings of a block, up to a margin more for the last one of a series or partition
MARGIN = 16  # readings of either neighbour that a block carries
BUFFER = 200_000  # rows that are worked on together
NO_SEQ = -(2**63)

SCHEMA = "part long, pid int, series_id long, attributes array<double>, lead int, n int, ts array<long>, vs array<double>, edge binary"
FIXES = "pid int, series_id long, x_attributes array<double>, first_part long, before_t array<long>, before_v array<double>, last_part long, after_t array<long>, after_v array<double>, superseded boolean"


def _concat(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [np.concatenate((x, y)) for x, y in zip(a, b, strict=True)]


class _Packer:
    """Blocks out of the sorted rows of one partition, a buffer at a time."""

    def __init__(self, width: int, rows: int, margin: int, pid: int) -> None:
        self.width, self.rows, self.margin, self.pid = width, rows, margin, pid
        self.held: list[np.ndarray] = [np.array([], np.int64), np.array([], np.int64), np.array([], np.float64)]
        self.lead = 0  # rows at the front of what is held that are in a block already
        self.known = np.array([], np.int64), np.zeros((0, width))  # series with attributes that may have readings to come, and these
        self.count = 0
        self.first = self.last = None  # series at both ends of the partition
        self.first_known = False
        self.raw_first = self.raw_last = None
        self.head: list[tuple[int, float]] = []
        self.first_part = self.last_block = None

    def take(self, sid: np.ndarray, t: np.ndarray, seq: np.ndarray, v: np.ndarray, attribute: np.ndarray, final: bool) -> pa.RecordBatch | None:
        """Blocks of what is complete once these rows, sorted as the partition is, have been added."""
        owners, values = self._attributes(sid[attribute], seq[attribute], v[attribute])
        if len(sid) and self.first is None:
            self.first, self.first_known = int(sid[0]), bool(attribute[0])
        if len(sid):
            self.last = int(sid[-1])
        rows = _concat(self.held, [x[~attribute] for x in (sid, t, v)])
        if len(rows[0]) and self.raw_first is None and rows[0][0] == self.first:
            self.raw_first = int(rows[1][0])
        # The last version of each point; the last row may still be overwritten by what follows.
        keep = np.append(starts(rows[:2])[1:], len(rows[0]) > 0) if len(rows[0]) else np.array([], dtype=bool)
        sid, t, v = (x[keep] for x in rows)
        pending = [x[len(x) :] for x in (sid, t, v)]
        if not final and len(sid):
            pending = [x[-1:] for x in (sid, t, v)]
            sid, t, v = sid[:-1], t[:-1], v[:-1]
        elif final and len(sid) and sid[-1] == self.last:
            self.raw_last = int(t[-1])
        valid = ~np.isnan(v)
        sid, t, v = sid[valid], t[valid], v[valid]
        self._note_head(sid, t, v)
        batch, rest, self.lead = self._cut(sid, t, v, pending[0], owners, values, final)
        self.held = _concat(rest, pending)
        still = owners >= (self.held[0][0] if len(self.held[0]) else self.last if self.last is not None else 0)
        self.known = owners[still], values[still]
        if final:
            own = sid == self.last
            # One more than a margin, as the last one may turn out to be superseded.
            self.tail = list(zip(t[own][-self.margin - 1 :].tolist(), v[own][-self.margin - 1 :].tolist(), strict=True))
            self.last_known = values[-1] if len(owners) and owners[-1] == self.last else None
        return batch

    def _attributes(self, sid: np.ndarray, k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The series known so far in this buffer, in order, and a row of attributes of each (NaN for none)."""
        owners = np.union1d(self.known[0], sid)
        values = np.full((len(owners), self.width), np.nan)
        values[np.searchsorted(owners, self.known[0])] = self.known[1]
        values[np.searchsorted(owners, sid), k] = v
        return owners, values

    def _note_head(self, sid: np.ndarray, t: np.ndarray, v: np.ndarray) -> None:
        if len(self.head) < self.margin and len(sid) and sid[0] == self.first:
            own = sid == self.first
            fresh = list(zip(t[own].tolist(), v[own].tolist(), strict=True))
            self.head = (self.head + [p for p in fresh if not self.head or p[0] > self.head[-1][0]])[: self.margin]

    def _cut(self, sid, t, v, pending, owners, values, final):
        first = starts([sid])
        a = np.flatnonzero(first)
        b = np.append(a[1:], len(sid))
        begin = a.copy()
        if self.lead and len(a):
            begin[0] += self.lead
        # Of the series that may go on only blocks whose margin is there are complete.
        stop, keep_from, lead = b.copy(), len(sid), 0
        if not final and len(a) and len(pending) and sid[-1] == pending[0]:
            whole = max(0, (b[-1] - begin[-1] - self.margin - 1) // self.rows) * self.rows
            stop[-1] = begin[-1] + whole
            keep_from = max(a[-1], stop[-1] - self.margin - 1)
            lead = int(stop[-1] - keep_from)
        # No block of several is as short as a margin, so a margin never reaches beyond the next block.
        per = np.where(stop > begin, np.maximum(1, -(-(stop - begin - self.margin) // self.rows)), 0)
        if not final and lead + keep_from < len(sid):
            per[-1] = (stop[-1] - begin[-1]) // self.rows
        owner = np.repeat(np.arange(len(a)), per)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        bs = begin[owner] + number * self.rows
        be = np.where(number == per[owner] - 1, stop[owner], bs + self.rows)
        low, high = np.maximum(a[owner], bs - self.margin), np.minimum(b[owner], be + self.margin)
        batch = None
        if len(bs):
            size = high - low
            offsets = np.concatenate(([0], np.cumsum(size)))
            index = np.repeat(low - offsets[:-1], size) + np.arange(offsets[-1])
            parts = (np.int64(self.pid) << 32) + self.count + np.arange(len(bs))
            self.count += len(bs)
            series = sid[bs]
            if self.first_part is None and series[0] == self.first:
                self.first_part = int(parts[0])
            self.last_block = int(series[-1]), int(parts[-1])
            batch = self._batch(parts, series, *self._known_of(series, owners, values), bs - low, be - bs, offsets, t[index], v[index])
        return batch, [x[keep_from:] for x in (sid, t, v)], lead

    def _known_of(self, series, owners, values):
        if not len(owners):
            return np.zeros(len(series), dtype=bool), np.full((len(series), self.width), np.nan)
        at = np.minimum(np.searchsorted(owners, series), len(owners) - 1)
        return owners[at] == series, values[at]

    def _batch(self, parts, series, known, values, lead, n, offsets, t, v, edge: bytes | None = None):
        k = len(parts)
        flat = pa.array(values.ravel(), from_pandas=True)
        attributes = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * self.width, pa.int32()), flat, mask=pa.array(~known))
        offsets = pa.array(offsets, pa.int32())
        columns = [pa.array(parts), pa.array(np.full(k, self.pid, np.int32)), pa.array(series), attributes, pa.array(lead.astype(np.int32)), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(t)), pa.ListArray.from_arrays(offsets, pa.array(v)), pa.array([edge] * k, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    def edge(self) -> pa.RecordBatch:
        """The row that tells the neighbouring partitions what they need."""
        last_part = self.last_block[1] if self.last_block and self.last_block[0] == self.last else None
        last_valid = bool(self.tail) and self.raw_last is not None and self.tail[-1][0] == self.raw_last
        note = {"pid": self.pid, "first": self.first, "last": self.last, "first_known": self.first_known, "last_known": None if self.last_known is None else [None if x != x else x for x in self.last_known.tolist()], "raw_first": self.raw_first, "raw_last": self.raw_last, "last_valid": last_valid, "head": self.head, "tail": self.tail, "first_part": self.first_part, "last_part": last_part}
        zero = np.zeros(1, np.int64)
        return self._batch(zero - 1, zero, np.zeros(1, dtype=bool), np.full((1, self.width), np.nan), zero, zero, np.zeros(2, np.int64), zero[:0], np.array([], np.float64), pickle.dumps(note))


def _pack(width: int, rows: int, margin: int, buffer: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(width, rows, margin, TaskContext.get().partitionId())

        def arrays(held: list[pa.RecordBatch]) -> list[np.ndarray]:
            whole = pa.Table.from_batches(held)
            t = whole.column("t").combine_chunks()
            return [whole.column("series_id").to_numpy(), t.fill_null(0).to_numpy(zero_copy_only=False), whole.column("seq").to_numpy(), whole.column("v").to_numpy(), t.is_null().to_numpy(zero_copy_only=False)]

        held, count, any_rows = [], 0, False
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= buffer:
                any_rows = True
                out = packer.take(*arrays(held), False)
                held, count = [], 0
                if out is not None:
                    yield out
        if any_rows or count:
            none = pa.RecordBatch.from_pydict({"series_id": pa.array([], pa.int64()), "t": pa.array([], pa.int64()), "seq": pa.array([], pa.int64()), "v": pa.array([], pa.float64())})
            out = packer.take(*arrays(held or [none]), True)
            if out is not None:
                yield out
            yield packer.edge()

    return pack


def _fixes(edges: list[dict], margin: int) -> list[tuple]:
    """What the blocks at the edges of partitions still need, from the notes of all partitions in order."""
    fixes: dict[tuple[int, int], dict] = {}
    at = lambda pid, sid: fixes.setdefault((pid, sid), {"attributes": None, "first": None, "before": [], "last": None, "after": [], "drop": False})
    run = None  # the series that may go on: attributes, last readings, last point, its block
    for e in edges:
        goes_on = run is not None and run["sid"] == e["first"]
        if goes_on:
            if e["raw_first"] is not None and e["raw_first"] == run["raw"] and run["valid"]:
                at(*run["block"])["drop"] = True
                at(*run["block"])["last"] = run["part"]
                run["tail"].pop()
                run["valid"] = False
            own = at(e["pid"], e["first"])
            own["attributes"] = None if e["first_known"] else run["attributes"]
            own["first"], own["before"] = e["first_part"], run["tail"][-margin:]
        same = goes_on and e["last"] == e["first"]
        tail = (run["tail"] + e["tail"])[-margin - 1 :] if same else list(e["tail"])
        new = {"sid": e["last"], "attributes": e["last_known"], "tail": tail, "raw": e["raw_last"], "valid": e["last_valid"], "block": (e["pid"], e["last"]), "part": e["last_part"]}
        if same:
            new["attributes"] = run["attributes"] if e["last_known"] is None else e["last_known"]
            if e["raw_last"] is None:
                new |= {k: run[k] for k in ("raw", "valid")}
            if e["last_part"] is None:
                new |= {k: run[k] for k in ("block", "part")}
        run = new
    following = None  # the series that came before: its first readings
    for e in reversed(edges):
        goes_on = following is not None and following["sid"] == e["last"]
        if goes_on and e["last_part"] is not None:
            own = at(e["pid"], e["last"])
            own["last"], own["after"] = e["last_part"], following["head"][:margin]
        head = list(e["head"])
        single = e["first"] == e["last"]
        if single and head and head[-1][0] == e["raw_last"] and fixes.get((e["pid"], e["first"]), {}).get("drop"):
            head.pop()
        if single and goes_on and len(head) < margin:
            head = (head + following["head"])[:margin]
        following = {"sid": e["first"], "head": head}
    split = lambda points: ([t for t, _ in points], [v for _, v in points])
    return [(*key, f["attributes"], f["first"], *split(f["before"]), f["last"], *split(f["after"]), f["drop"]) for key, f in sorted(fixes.items())]


def blocks(samples: DataFrame, attributes: DataFrame | None = None, names: Sequence[str] = (), rows: int = BLOCK_ROWS, margin: int = MARGIN) -> DataFrame:
    """``(part, series_id, <names>, lead, n, ts, vs)``: the valid readings of raw inserts in blocks, materialised.

    A block holds ``n`` readings, at most ``rows`` and a margin, in order of time; ``ts`` and ``vs`` hold them after ``lead`` readings
    that come before the block and followed by some that come after it, up to ``margin`` each, fewer only
    at the ends of the series. ``part`` is unique and grows with time within a series. ``attributes`` has one row
    per series, ``series_id`` and numbers ``names``; a series without one has NULL (NaN counts as NULL).

    Of the rows of one ``(series_id, t)`` the highest ``seq`` counts (equal ``seq``: the greatest value, NULL
    below all, NULL ``seq`` lowest). If that version's ``v`` is NULL or NaN the point has no reading. Rows with a NULL
    ``series_id`` or ``t`` are no readings. Other columns are ignored; an empty input gives an empty result.
    """
    if not 1 <= margin <= rows:
        raise ValueError("margin must be at least 1 and at most rows")
    raw = samples.where("series_id IS NOT NULL AND t IS NOT NULL").select("series_id", "t", F.coalesce("seq", F.lit(NO_SEQ)).alias("seq"), "v").withColumn("task", F.spark_partition_id())
    if attributes is not None:
        own = attributes.where("series_id IS NOT NULL")
        for k, name in enumerate(names):
            row = own.select("series_id", F.lit(None).cast("bigint").alias("t"), F.lit(k).cast("bigint").alias("seq"), F.col(name).cast("double").alias("v"), F.lit(0).alias("task"))
            raw = raw.unionByName(row)
    # The attributes of a series have one key, so they stay together.
    placed = raw.repartitionByRange("series_id", "t", F.when(F.col("t").isNotNull(), F.col("seq")), "task").drop("task").sortWithinPartitions("series_id", "t", "seq", "v")
    packed = cut_lineage(placed.mapInArrow(_pack(max(len(names), 1), rows, margin, BUFFER), SCHEMA))
    # One note per partition: as many as there are partitions, whatever the data.
    notes = sorted((pickle.loads(r.edge) for r in packed.where("edge IS NOT NULL").select("edge").collect()), key=lambda e: e["pid"])
    fixes = _fixes(notes, margin)
    whole = packed.where("edge IS NULL").drop("edge")
    if fixes:
        fixed = whole.join(F.broadcast(packed.sparkSession.createDataFrame(fixes, FIXES)), ["pid", "series_id"], "left")
        none_t, none_v = F.array().cast("array<long>"), F.array().cast("array<double>")
        at_start, at_end = F.coalesce(F.col("part") == F.col("first_part"), F.lit(False)), F.coalesce(F.col("part") == F.col("last_part"), F.lit(False))
        less = F.when(at_end & F.col("superseded"), 1).otherwise(0)
        joined = lambda own, before, after, none: F.when(at_start | at_end, F.concat(F.when(at_start, F.col(before)).otherwise(none), F.slice(own, F.lit(1), F.size(own) - less), F.when(at_end, F.col(after)).otherwise(none))).otherwise(F.col(own))
        whole = fixed.select(
            "part", "series_id", F.coalesce("attributes", "x_attributes").alias("attributes"),
            (F.col("lead") + F.when(at_start, F.size("before_t")).otherwise(0)).alias("lead"), (F.col("n") - less).alias("n"),
            joined("ts", "before_t", "after_t", none_t).alias("ts"), joined("vs", "before_v", "after_v", none_v).alias("vs"),
        ).where("n > 0")
    named = [F.get("attributes", F.lit(k)).alias(name) for k, name in enumerate(names)]
    return whole.select("part", "series_id", *named, "lead", "n", "ts", "vs")


class Flat:
    """The blocks of an Arrow batch as flat arrays: margins included, ``own`` telling the blocks' own readings."""

    def __init__(self, batch: pa.RecordBatch | pa.Table) -> None:
        if isinstance(batch, pa.Table):
            batch = batch.combine_chunks().to_batches()[0]
        ts, vs = batch.column("ts"), batch.column("vs")
        self.size = ts.value_lengths().to_numpy().astype(np.int64)
        self.t, self.v = ts.flatten().to_numpy(), vs.flatten().to_numpy()
        self.lead, self.n = batch.column("lead").to_numpy().astype(np.int64), batch.column("n").to_numpy().astype(np.int64)
        self.seg = np.repeat(np.arange(len(self.size)), self.size)
        self.at = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.int64)
        self.first = np.zeros(len(self.t), dtype=bool)
        self.first[self.at] = True
        place = np.arange(len(self.t)) - self.at[self.seg]
        self.own = (place >= self.lead[self.seg]) & (place < (self.lead + self.n)[self.seg])
        self.batch = batch

    def column(self, name: str) -> np.ndarray:
        """A column of the blocks; NULL numbers are NaN."""
        return self.batch.column(name).to_numpy(zero_copy_only=False)

    def spread(self, name: str) -> np.ndarray:
        """A column of the blocks, repeated for each reading."""
        return self.column(name)[self.seg]


def explode(blocked: DataFrame, *keep: str) -> DataFrame:
    """The readings of blocks as rows: ``series_id, t, v`` and the given columns of the blocks."""
    own = blocked.select("series_id", *keep, F.slice("ts", F.col("lead") + 1, F.col("n")).alias("t"), F.slice("vs", F.col("lead") + 1, F.col("n")).alias("v"))
    return own.select("series_id", *keep, F.explode(F.arrays_zip("t", "v")).alias("r")).select("series_id", "r.t", "r.v", *keep)


def grouped(batches: Iterator[pa.RecordBatch], readings: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Batches of blocks cut into batches of about ``readings`` readings, at least one block each."""
    for batch in batches:
        ends = np.cumsum(batch.column("ts").value_lengths().to_numpy().astype(np.int64))
        a = 0
        while a < batch.num_rows:
            base = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, base + readings, side="right")))
            yield batch.slice(a, b - a)
            a = b
