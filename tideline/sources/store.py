"""A store of labelled series: Parquet partitioned by time, append with late data, merge on read, compaction, retention.

Layout under a root: ``samples/p_start=<ms>/`` (``series_id, t, v, seq, batch``), ``series/`` (``series_id, labels,
label_key, batch``), ``members/`` (``group_key, slot, series_id``), ``tombs/`` (``series_id, min_t, max_t``) and ``commits/``, an empty file
per committed batch of a writer. Samples are only ever appended; versions are merged when read, or by :meth:`compact`.

Every write of samples goes to ``staging/`` first. Its files are then moved to their partitions under names that begin with
the writer and batch, files of an earlier attempt at the same batch are removed, and the batch is committed last;
so a batch that is delivered again, committed or half done, is there once. New files replace old ones by being added before
the old ones go: at any moment every version is stored at least once, and a version stored twice is read as one. Writers have
names and their own batch numbers; they may append at the same time, but series are registered, and partitions compacted or
purged, by one process at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import labels as L
from tideline.functions import timeutil
from tideline.operators import groups, intervals, scan
from tideline.operators.ids import dense_ids
from tideline.operators.matchers import Matcher
from tideline.operators.merge import last_write_wins
from tideline.session import cut_lineage

SAMPLES = "series_id bigint, t bigint, v double, seq bigint, batch bigint, p_start bigint"
SERIES = "series_id bigint, labels map<string,string>, label_key array<struct<key:string,value:string>>, batch bigint"
TOMBS = "series_id bigint, min_t bigint, max_t bigint"
MEMBERS = "group_key string, slot int, series_id bigint"
TWO_HOURS = 7_200_000


class Store:
    """The store under ``root``, with time partitions of ``width`` milliseconds.

    With ``compact_at`` an append also merges the partitions it touched that have so many patches by then.
    """

    def __init__(self, spark: SparkSession, root: str, width: int = TWO_HOURS, compact_at: int | None = None) -> None:
        self.spark, self.root, self.width, self.compact_at = spark, root.rstrip("/"), width, compact_at

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _exists(self, name: str) -> bool:
        return self._files().exists(self._hadoop(name))

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self._exists(name):
            if not self._exists(f"{name}-old"):
                return self.spark.createDataFrame([], schema)
            name = f"{name}-old"  # a replacement was interrupted
        return self.spark.read.schema(schema).parquet(self._path(name))

    def samples(self) -> DataFrame:
        """All stored versions, partition column included, so that ranges of ``p_start`` prune directories."""
        return self._read("samples", SAMPLES)

    def series(self) -> DataFrame:
        return self._read("series", SERIES)

    def tombs(self) -> DataFrame:
        return self._read("tombs", TOMBS)

    def _files(self):
        """The file system of the store."""
        return self._hadoop("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _listed(self, name: str) -> list[str]:
        """The names under a folder of the store; none if it is not there."""
        return [s.getPath().getName() for s in self._files().listStatus(self._hadoop(name))] if self._exists(name) else []

    @staticmethod
    def _commit_name(batch: int, writer: str) -> str:
        name = quote(writer, safe="")
        return f"w-{name if len(name) <= 80 else hashlib.sha256(name.encode()).hexdigest()}.{batch}"

    def committed(self, batch: int, writer: str = "main") -> bool:
        """Whether the batch of that number of that writer is stored; other writers have numbers of their own."""
        return self._exists(f"commits/{self._commit_name(batch, writer)}")

    def commits(self) -> list[tuple[str, int]]:
        """Writer and number of every committed batch; a long name of a writer as its hash."""
        names = [n[2:].rpartition(".") for n in self._listed("commits") if n.startswith("w-")]
        return sorted((unquote(writer), int(batch)) for writer, _, batch in names)

    def _put(self, rows: DataFrame, key: str) -> dict[str, set[str]]:
        """Write rows beside the partitions and move the files in; the names of the files by partition.

        Rows are range-partitioned by series and time within their partition, so files are even and a hot series is in many.
        """
        staging = f"staging/{key}"
        placed = rows.select("series_id", "t", "v", "seq", "batch", "p_start").repartitionByRange("p_start", "series_id", "t").sortWithinPartitions("p_start", "series_id", "t")
        placed.write.mode("overwrite").partitionBy("p_start").parquet(self._path(staging))
        files, moved = self._files(), {}
        for part in self._listed(staging):
            if not part.startswith("p_start="):
                continue
            files.mkdirs(self._hadoop(f"samples/{part}"))
            for k, name in enumerate(sorted(n for n in self._listed(f"{staging}/{part}") if n.endswith(".parquet"))):
                target = f"{key}-{k}.parquet"
                files.delete(self._hadoop(f"samples/{part}/{target}"), False)
                if not files.rename(self._hadoop(f"{staging}/{part}/{name}"), self._hadoop(f"samples/{part}/{target}")):
                    raise OSError(f"could not move {name} into {part}")
                moved.setdefault(part, set()).add(target)
            for name in self._listed(f"samples/{part}"):
                if name.startswith(f"{key}-") and name not in moved.get(part, set()):
                    files.delete(self._hadoop(f"samples/{part}/{name}"), False)
        files.delete(self._hadoop(staging), True)
        return moved

    def _replace(self, name: str, rows: DataFrame) -> None:
        """A small table written beside the old one, which gives its place up only then; a crash leaves one of them."""
        files, fresh, old = self._files(), f"{name}-new", f"{name}-old"
        rows.write.mode("overwrite").parquet(self._path(fresh))
        files.delete(self._hadoop(old), True)
        if self._exists(name):
            files.rename(self._hadoop(name), self._hadoop(old))
        files.rename(self._hadoop(fresh), self._hadoop(name))
        files.delete(self._hadoop(old), True)

    def register(self, labelled: DataFrame, batch: int) -> DataFrame:
        """Get or create: ``labelled`` (``labels``, ``seq``, ...) with the ``series_id`` of its label set.

        New label sets get the next ids in order of first arrival. Created series stay, whatever becomes of
        the samples.
        """
        keyed = labelled.withColumn("label_key", L.label_key(F.col("labels")))
        known = self.series()
        fresh = keyed.groupBy("label_key").agg(F.min("seq").alias("first_seq")).join(known.select("label_key"), "label_key", "left_anti")
        top = known.agg(F.max("series_id")).first()[0] or 0
        created = dense_ids(fresh, ["first_seq", "label_key"], "series_id", top)
        created = cut_lineage(created.select("series_id", L.from_key(F.col("label_key")).alias("labels"), "label_key", F.lit(batch).cast("bigint").alias("batch")))
        created.write.mode("append").parquet(self._path("series"))
        every = known.select("series_id", "label_key").unionByName(created.select("series_id", "label_key"))
        return keyed.join(every, "label_key").drop("label_key")

    def append(self, samples: DataFrame, batch: int, writer: str = "main") -> bool:
        """Add samples ``series_id, t, v, seq`` as one batch of a writer; False if that very batch is there already.

        Batches of one writer may come in any order. Rows with a NULL series or time are an error.
        """
        if self.committed(batch, writer):
            return False
        rows = scan.with_partition(samples.select("series_id", "t", "v", "seq"), self.width).withColumn("batch", F.lit(batch).cast("bigint"))
        checked = rows.withColumn("p_start", F.when(F.col("series_id").isNotNull() & F.col("t").isNotNull(), F.col("p_start")).otherwise(F.raise_error(F.lit("a sample needs a series and a time"))))
        touched = self._put(checked, self._commit_name(batch, writer))
        self._files().create(self._hadoop(f"commits/{self._commit_name(batch, writer)}"), True).close()
        if self.compact_at:
            self.compact(self.compact_at, only={int(p.split("=")[1]) for p in touched})
        return True

    def add(self, labelled: DataFrame, batch: int, writer: str = "main") -> DataFrame:
        """Samples by labels (``labels, t, v, seq``): registers new series, appends, and returns the ids.

        Series come before samples, as they stay whatever becomes of these.
        """
        known = self.register(labelled, batch)
        self.append(known, batch, writer)
        return known.select("series_id", "labels").dropDuplicates(["series_id"])

    def members(self) -> DataFrame:
        """``(group_key, slot, series_id)`` of the group members known so far."""
        return self._read("members", MEMBERS)

    def add_groups(self, inserts: DataFrame, batch: int, writer: str = "main") -> DataFrame:
        """Group inserts (``group_labels, lsets, slots, t, v, seq``); returns values of slots that no insert ever named.

        A member is a series with the labels of its group and its own; the first insert that names a slot
        gives it its labels, later ones go by slot alone. Slots that an insert does not mention keep their value.
        """
        rows = inserts.withColumn("group_key", L.text(F.col("group_labels")))
        own = rows.groupBy("group_key").agg(F.any_value("group_labels").alias("group_labels"), F.min("seq").alias("seq"))
        named = groups.members(rows).join(self.members(), ["group_key", "slot"], "left_anti").join(own, "group_key")
        fresh = named.select("group_key", "slot", L.merged(F.col("group_labels"), F.col("labels")).alias("labels"), "seq")
        created = cut_lineage(self.register(fresh, batch).select("group_key", "slot", "series_id"))
        created.write.mode("append").parquet(self._path("members"))
        values = groups.long_form(rows)
        self.append(values.join(self.members(), ["group_key", "slot"]), batch, writer)
        return values.join(self.members(), ["group_key", "slot"], "left_anti")

    def add_fast(self, samples: DataFrame, batch: int, writer: str = "main") -> DataFrame:
        """Samples by id; returns those of unknown series, which are not stored."""
        ids = self.series().select("series_id")
        self.append(samples.join(ids, "series_id", "left_semi"), batch, writer)
        return samples.join(ids, "series_id", "left_anti")

    def rollback(self, labelled: DataFrame, batch: int) -> None:
        """Drop buffered samples: only the series they created are kept."""
        self.register(labelled, batch)

    def delete(self, tombs: DataFrame) -> None:
        """Delete intervals ``series_id, min_t, max_t``, both ends included."""
        tombs.select("series_id", "min_t", "max_t").write.mode("append").parquet(self._path("tombs"))

    def delete_matching(self, matchers: Sequence[Matcher], mint: int, maxt: int) -> None:
        """Delete the samples of the matching series in the inclusive range; series registered later are not concerned."""
        chosen = scan.resolve(self.series(), matchers).select("series_id").distinct()
        self.delete(chosen.select("series_id", F.lit(mint).cast("bigint").alias("min_t"), F.lit(maxt).cast("bigint").alias("max_t")))

    def query(self, matchers: Sequence[Matcher], mint: int = 0, maxt: int = scan.MAX_T, at: int | None = None) -> DataFrame:
        """Valid samples of the matching series, without deleted ones; ``at`` limits the sequence numbers seen."""
        rows = scan.select(self.series(), self.samples(), matchers, mint, maxt, self.width, at)
        return intervals.delete(rows, self.tombs()) if self._exists("tombs") else rows

    def patches(self) -> dict[int, set[str]]:
        """The batches of each partition that lie beside its merged base files, if it has any."""
        parts = [p for p in self._listed("samples") if p.startswith("p_start=")]
        return {int(p.split("=")[1]): {n.rpartition("-")[0] for n in self._listed(f"samples/{p}") if n.startswith("w-")} for p in parts}

    def head(self) -> DataFrame:
        """The versions that no compaction has taken in yet, as stored."""
        return self.samples().where(F.startswith(F.col("_metadata.file_name"), F.lit("w-")))

    def compact(self, min_patches: int = 3, snapshot: int | None = None, between: tuple[int, int] | None = None, only: set[int] | None = None) -> list[int]:
        """Merge the base and patches of partitions that have patches of at least ``min_patches`` batches; their numbers are returned.

        ``snapshot`` is the oldest sequence number that reads still ask for: versions after it are kept, and the
        newest up to it. ``between`` limits the work to partitions that begin in that inclusive range, ``only`` to those named. The merged files are written
        beside the old ones, moved in, and only then do the old ones go. The list of partitions and files is metadata.
        """
        wanted = lambda s: (between is None or between[0] <= s <= between[1]) and (only is None or s in only)
        starts = [s for s, batches in self.patches().items() if len(batches) >= min_patches and wanted(s)]
        due = {s: [n for n in self._listed(f"samples/p_start={s}") if n.endswith(".parquet")] for s in starts}
        if due:
            old = self.samples().where(F.col("p_start").isin(list(due)))
            kept = F.when(F.col("seq") > snapshot, F.col("seq")) if snapshot is not None else F.lit(None).cast("bigint")
            merged = last_write_wins(old.withColumn("kept", kept), ["p_start", "series_id", "t", "kept"], ["seq"], ["v", "seq", "batch"])
            self._put(merged, f"compact-{uuid.uuid4().hex}")
            for s, names in due.items():
                for name in names:
                    self._files().delete(self._hadoop(f"samples/p_start={s}/{name}"), False)
        return sorted(due)

    def purge(self, ts: int) -> None:
        """Retention: partitions that end at or before ``ts`` are dropped, and series without a later sample.

        Whole partitions only, so samples up to a partition's width older than ``ts`` may stay. Labels of
        purged series leave the catalog with them.
        """
        keep = self.samples().select("series_id", "t").groupBy("series_id").agg(F.max("t").alias("max_t"))
        self._replace("series", self.series().join(intervals.purge_series(keep, ts), "series_id", "left_semi"))
        for name in self._listed("samples"):
            if name.startswith("p_start=") and int(name.split("=")[1]) + self.width <= ts:
                self._files().delete(self._hadoop(f"samples/{name}"), True)

    def suggested_width(self, budget: int) -> int:
        """The width at which the partitions that are not merged yet would come to ``budget`` bytes; for a store to be opened anew."""
        sizes = self.properties().join(self.head().select("p_start").distinct(), "p_start", "left_semi")
        row = sizes.agg(F.sum("bytes").alias("bytes")).select(timeutil.adapted_width(F.lit(self.width), F.col("bytes"), budget).alias("width")).first()
        return row.width

    def properties(self) -> DataFrame:
        """``(p_start, files, batches, samples, bytes)`` of each partition."""
        rows = self.samples().select("p_start", "batch", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
        per_file = rows.groupBy("p_start", "file", "size").agg(F.count(F.lit(1)).alias("n"), F.max("batch").alias("batch"))
        return per_file.groupBy("p_start").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("batch").alias("batches"), F.sum("n").alias("samples"), F.sum("size").alias("bytes"))
