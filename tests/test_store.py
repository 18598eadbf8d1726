"""The store against a dictionary in which the last write wins."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tideline.operators import catalog, scan
from tideline.operators.matchers import Eq, Re
from tideline.plans import core
from tideline.sources import loaders
from tideline.sources.store import Store
from tideline.streaming import ingest

LABELLED = "labels map<string,string>, t bigint, v double, seq bigint"


def _labels(i):
    return {"host": f"h{i}", "all": "yes"}


def test_random_writes_equal_a_dictionary(spark, tmp_path):
    store, want, rnd, seq = Store(spark, str(tmp_path), 1000), {}, random.Random(3), 0
    for batch in range(4):
        data = []
        for _ in range(60):
            i, t, v = rnd.randrange(4), rnd.randrange(0, 5000, 50), rnd.random()
            data.append((_labels(i), t, v, seq))
            want[i, t] = v
            seq += 1
        frame = spark.createDataFrame(data, LABELLED)
        store.add(frame, batch)
        if batch == 1:
            store.add(frame, batch)  # delivered again: nothing changes
            assert store.samples().count() == 120
        if batch == 2:
            assert store.compact(2)
    got = store.query([Eq("all", "yes")]).select(F.col("labels")["host"].alias("h"), "t", "v")
    assert rows(got) == sorted((f"h{i}", t, v) for (i, t), v in want.items())
    assert store.series().count() == store.series().select("series_id").distinct().count() == 4
    part = store.query([Re("host", "h[01]")], 1000, 1999)
    assert rows(part, "t", "v") == sorted((t, v) for (i, t), v in want.items() if i < 2 and 1000 <= t <= 1999)
    assert "p_start" in part._jdf.queryExecution().toString()


def test_snapshot_delete_unknown_rollback_purge(spark, tmp_path):
    store = Store(spark, str(tmp_path), 1000)
    store.add(spark.createDataFrame([(_labels(0), t, 1.0, t) for t in range(0, 5000, 100)] + [(_labels(1), 100, 1.0, 9000)], LABELLED), 0)
    sid = {r.labels["host"]: r.series_id for r in store.series().collect()}
    left = store.add_fast(spark.createDataFrame([(sid["h0"], 100, 2.0, 10_000), (999, 5, 1.0, 10_001)], "series_id bigint, t bigint, v double, seq bigint"), 1)
    assert [r.series_id for r in left.collect()] == [999]
    assert rows(store.query([Eq("host", "h0")], 100, 100), "v") == [(2.0,)]
    assert rows(store.query([Eq("host", "h0")], 100, 100, at=9_999), "v") == [(1.0,)]
    store.rollback(spark.createDataFrame([(_labels(7), 1, 1.0, 1)], LABELLED), 2)
    assert store.series().count() == 3 and store.samples().count() == 52
    store.delete(spark.createDataFrame([(sid["h0"], 4000, 4500)], "series_id bigint, min_t bigint, max_t bigint"))
    assert store.query([Eq("host", "h0")], 4000).count() == 4
    assert {r.p_start: r.samples for r in store.properties().collect()}[1000] == 10
    store.purge(2500)
    assert rows(store.query([Eq("all", "yes")]).agg(F.min("t")), "min(t)") == [(2000,)]
    assert {r.labels["host"] for r in store.series().collect()} == {"h0"}


def test_stream_equals_batch_with_late_data(spark, tmp_path):
    parts = [[(_labels(i), t, float(t), t) for i in range(2) for t in range(a, a + 300, 100)] for a in (0, 300)]
    parts.append([(_labels(0), t, -1.0, 10_000 + t) for t in range(0, 600, 200)])  # late rewrites
    for k, part in enumerate(parts):
        spark.createDataFrame(part, LABELLED).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = ingest.file_stream(spark, f"{tmp_path}/in/*", LABELLED)
    store = Store(spark, f"{tmp_path}/store", 1000)
    for _ in range(2):  # a second start finds nothing new
        ingest.into_store(stream, store, f"{tmp_path}/check", by_labels=True).awaitTermination()
    got = rows(store.query([Eq("host", "h0")]), "t", "v")
    assert got == [(t, -1.0 if t % 200 == 0 else float(t)) for t in range(0, 600, 100)]
    assert store.samples().count() == 15


def test_windowed_stream(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:10", 1.0), (1, "2024-01-01 00:00:50", 5.0), (1, "2024-01-01 01:00:00", 2.0)], "series_id bigint, ts string, v double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ingest.file_stream(spark, f"{tmp_path}/in", "series_id bigint, ts timestamp, v double")
    query = ingest.windowed(stream, "1 minute", "10 minutes").writeStream.outputMode("append").format("memory").queryName("live").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.sql("SELECT max_v, n FROM live")) == [(5.0, 2)]


def test_loaders(spark, tmp_path):
    (tmp_path / "hosts").write_text("cpu,hostname=host_1,region=eu,region=us,broken\n\nx\n")
    got = [r.labels for r in loaders.devops_lines(spark, str(tmp_path / "hosts"), ["m1", "m2"]).collect()]
    assert sorted(x["__name__"] for x in got) == ["m1", "m2"] and got[0]["region"] == "eu" and got[0]["hostname"] == "host_1"
    (tmp_path / "json").write_text('{"a": "b"}\nno\n')
    assert [r.labels for r in loaders.json_labels(spark, str(tmp_path / "json")).collect()] == [{"a": "b"}]
    (tmp_path / "csv").write_text("1,2.5,x\n")
    assert loaders.csv_matrix(spark, str(tmp_path / "csv")).first()["values"] == [1.0, 2.5, None]
    (tmp_path / "meta.json").write_text('{"ulid": "u",\n "minTime": 1, "maxTime": 9, "stats": {"numSamples": 4}}')
    assert tuple(loaders.block_meta(spark, str(tmp_path / "meta.json")).first())[:4] == ("u", 1, 9, 4)
    hosts = loaders.devops_hosts(spark, 3)
    assert hosts.count() == 3 and hosts.first().labels["hostname"] == "host_100000"
    assert loaders.regular_samples(spark.createDataFrame([(1,)], "series_id bigint"), 0, 1000, 5).count() == 5


def test_groups_in_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path), 1000)
    shape = "group_labels map<string,string>, lsets array<map<string,string>>, slots array<int>, t bigint, v array<double>, seq bigint"
    g = {"group": "g"}
    named = [(g, [{"m": "a"}, {"m": "b"}], [0, 1], 0, [1.5, 2.5], 1), (g, [], [], 10, [1.6, None], 2)]
    assert store.add_groups(spark.createDataFrame(named, shape), 0).count() == 0
    later = [(g, [], [1], 0, [9.0], 3), (g, [{"m": "c"}], [2], 20, [4.0], 4), (g, [], [7], 20, [5.0], 5), ({}, [], [0], 1, [1.0], 6)]
    unknown = store.add_groups(spark.createDataFrame(later, shape), 1)
    assert sorted(r.slot for r in unknown.collect()) == [0, 7]
    got = store.query([Eq("group", "g")]).where("v IS NOT NULL").select(F.col("labels")["m"].alias("m"), "t", "v")
    assert rows(got) == [("a", 0, 1.5), ("a", 10, 1.6), ("b", 0, 9.0), ("c", 20, 4.0)]
    assert store.series().count() == 3 and store.members().count() == 3


def test_late_append_takes_all_samples_in_order_of_arrival(spark):
    data = "/root/testdata/sf0.001"
    store, raw = core._late_store(spark, data), core.samples(spark, data)
    kept = store.samples().select("series_id", "t", "seq", "batch", "p_start")
    assert kept.select("series_id", "t").distinct().count() == raw.select("series_id", "t").distinct().count()
    last = raw.groupBy("series_id", "t").agg(F.max("seq").alias("seq"))
    assert kept.select("series_id", "t", "seq").exceptAll(last).count() == 0  # versions are merged
    spans = sorted(tuple(r) for r in kept.groupBy("batch").agg(F.min("seq"), F.max("seq")).collect())
    assert [s[0] for s in spans] == [0, 1, 2, 3] and all(a[2] < b[1] for a, b in zip(spans, spans[1:], strict=False))


def test_batches_belong_to_writers_and_are_there_once(spark, tmp_path):
    store = Store(spark, str(tmp_path), 1000)
    shape = "series_id bigint, t bigint, v double, seq bigint"
    rows_of = lambda k: spark.createDataFrame([(1, t, float(k), k) for t in range(0, 3000, 500)], shape)
    assert store.append(rows_of(1), 3, "a") and store.append(rows_of(2), 0, "b/ä") and store.append(rows_of(3), 1, "a")
    assert not store.append(rows_of(9), 3, "a") and not store.append(rows_of(9), 0, "b/ä")
    assert store.commits() == [("a", 1), ("a", 3), ("b/ä", 0)] and store.samples().count() == 18
    # A batch whose files were moved but not committed, with more files than the next attempt has.
    name = store._commit_name(7, "a")
    store._put(scan.with_partition(rows_of(5), 1000).withColumn("batch", F.lit(7).cast("bigint")), name)
    (tmp_path / "samples" / "p_start=0" / f"{name}-99.parquet").write_bytes(next((tmp_path / "samples" / "p_start=0").glob(f"{name}-0.parquet")).read_bytes())
    assert store.append(rows_of(5), 7, "a") and store.samples().where("batch = 7").count() == 6
    assert not (tmp_path / "staging").exists() or not any((tmp_path / "staging").iterdir())
    with pytest.raises(Exception, match="a sample needs a series and a time"):
        store.append(spark.createDataFrame([(None, 1, 1.0, 1)], shape), 8)
    assert not store.committed(8)


def test_compaction_keeps_what_snapshots_need(spark, tmp_path):
    store = Store(spark, str(tmp_path), 1000)
    shape = "series_id bigint, t bigint, v double, seq bigint"
    for seq in (1, 2, 3, 4):
        store.append(spark.createDataFrame([(1, t, float(seq), seq) for t in (0, 1500)], shape), seq)
    assert store.compact(2, between=(1000, 1000)) == [1000]
    assert store.samples().where("p_start = 1000").count() == 1 and store.samples().where("p_start = 0").count() == 4
    assert store.compact(2, snapshot=2) == [0]
    assert rows(store.samples().where("p_start = 0"), "seq") == [(2,), (3,), (4,)]
    assert catalog.approximate_size(store.samples(), 0, 5).first().files == 2
    store.append(spark.createDataFrame([(1, 5, 9.0, 9)], shape), 9)
    assert rows(store.head(), "seq") == [(9,)] and store.suggested_width(10**9) > store.width >= store.suggested_width(1)


def test_interrupted_replacement_of_a_table_is_read(spark, tmp_path):
    store = Store(spark, str(tmp_path), 1000)
    store.add(spark.createDataFrame([(_labels(0), 0, 1.0, 0)], LABELLED), 0)
    (tmp_path / "series").rename(tmp_path / "series-old")
    assert store.series().count() == 1
    store._replace("series", store.series())
    assert store.series().count() == 1 and sorted(p.name for p in tmp_path.glob("series*")) == ["series"]


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace as N

    from tideline import session

    none = N(isDefined=lambda: False)
    context = N(_jsc=N(sc=lambda: N(getCheckpointDir=lambda: none)), getConf=lambda: N(get=lambda _: None), master="spark://host:7077")
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(N(sparkContext=context))
