"""Queries for loaders, write verbs, streams and the smaller functions, each with its SQL.

They take the same tables as :mod:`tideline.plans.core`. What has to be in a file or a store first is written
to a fresh folder of the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import codec, encoding, proto, timeutil, wire
from tideline.functions import labels as L
from tideline.operators import catalog, groups, intervals, merge, scan
from tideline.operators.matchers import Eq, Re
from tideline.plans.core import _FROM, _GROUP, _LIVE, _LONG, _SERIES, _TEXT, _V, DAY, T0, _fresh, _group_rows, _late_store, _tombs, finite, registrations, samples, series
from tideline.sources import loaders
from tideline.sources.store import Store
from tideline.sources.tables import table
from tideline.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}
EVERYTHING = [lambda labels: F.lit(True)]
TWO_HOURS = 7_200_000


def register(sql: str):
    def add(query):
        QUERIES[query.__name__], SQL[query.__name__] = query, sql
        return query

    return add


# Loaders

_HOST = "map_from_entries(list_filter(map_entries(labels), lambda e: e.key <> '__name__'))"
_AS = lambda m: f"map_from_entries(list_concat([{{'key': '__name__', 'value': '{m}'}}], map_entries({_HOST})))"


@register(f"WITH h AS (SELECT DISTINCT labels FROM (SELECT {_HOST} AS labels FROM series_in)) SELECT {_TEXT(_AS('cpu'))} AS labels FROM h UNION ALL SELECT {_TEXT(_AS('mem'))} FROM h")
def load_devops_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "lines")
    pairs = F.transform(L.label_key(L.without(F.col("labels"), [])), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    registrations(spark, sf_dir).select(F.concat_ws(",", F.lit("tags"), F.array_join(pairs, ",")).alias("value")).distinct().write.text(path)
    return loaders.devops_lines(spark, path, ["cpu", "mem"]).select(L.text(F.col("labels")).alias("labels"))


@register(f"SELECT {_TEXT('labels')} AS labels, count(*) AS n FROM series_in GROUP BY 1")
def load_json_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "lines")
    registrations(spark, sf_dir).select(F.to_json("labels").alias("value")).write.text(path)
    return loaders.json_labels(spark, path).groupBy(L.text(F.col("labels")).alias("labels")).agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT len(v)::INT AS width, CASE WHEN NOT isnan(v[1]) THEN v[1] END AS first_v, count(*) AS n, sum(n) OVER () AS all_lines, true AS numbered
FROM (SELECT v, 1 AS n FROM group_in WHERE len(v) > 0) GROUP BY ALL""".replace("sum(n) OVER ()", "(SELECT count(*) FROM group_in WHERE len(v) > 0)").replace("SELECT v, 1 AS n", "SELECT v"))
def load_csv_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of numbers of varying width; they are numbered from 1 to their number."""
    path = _fresh(spark, "lines")
    text = F.array_join(F.transform("v", lambda x: x.cast("string")), ",", "")
    table(spark, sf_dir, "group_in").where("size(v) > 0").select(text.alias("value")).write.text(path)
    lines = loaders.csv_matrix(spark, path)
    whole = lines.agg(F.count(F.lit(1)).alias("all_lines"), (F.count_distinct("line") == F.max("line")).alias("numbered"))
    own = finite(lines.select(F.size("values").alias("width"), F.get("values", F.lit(0)).alias("first_v")), "first_v")
    return own.groupBy("width", "first_v").agg(F.count(F.lit(1)).alias("n")).withColumns({c: whole.select(c).scalar() for c in ("all_lines", "numbered")})


@register("SELECT 'host_' || (100000 + i) AS hostname, k, true AS in_domain FROM range(200) t(i), range(24) s(k)")
def generate_devops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated hosts with a sample every 30 seconds: tags come from their domains, times keep to the interval."""
    hosts = loaders.devops_hosts(spark, 200).withColumn("series_id", F.substring("labels.hostname", 6, 6).cast("bigint"))
    points = loaders.regular_samples(hosts, T0, 30_000, 24).join(hosts, "series_id")
    valid = F.col("labels.region").rlike("^region-[0-8]$") & F.col("labels.os").rlike("^os-[0-2]$") & ((F.col("t") - T0) % 30_000 == F.col("v")) & (F.col("v") < 200)
    return points.select(F.col("labels.hostname").alias("hostname"), F.expr(f"(t - {T0}) div 30000").alias("k"), valid.alias("in_domain"))


@register("SELECT id::VARCHAR AS block, mint AS min_t, maxt AS max_t, (maxt - mint) // step_ms AS samples FROM query_in")
def load_block_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "meta")
    meta = F.struct(F.col("id").cast("string").alias("ulid"), F.col("mint").alias("minTime"), F.col("maxt").alias("maxTime"), F.struct(F.expr("(maxt - mint) div step_ms").alias("numSamples")).alias("stats"))
    blocks = table(spark, sf_dir, "query_in").withColumn("file", F.pmod("id", F.lit(64)))
    blocks.groupBy("file").agg(F.to_json(F.collect_list(meta)).alias("value")).write.partitionBy("file").text(path)
    return loaders.block_meta(spark, f"{path}/*").select("block", "min_t", "max_t", "samples")


# Requests


@register("SELECT id, t, CASE WHEN NOT isnan(v) THEN v END AS v FROM query_samples")
def wire_insert_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "query_samples").select(F.create_map(F.lit("id"), F.col("id").cast("string")).alias("lset"), "t", F.array("v").alias("v"))
    back = ingest.json_inserts(wire.encode_inserts(rows, "lset", "t", "v"))
    return finite(back.select(F.col("labels")["id"].cast("bigint").alias("id"), "t", "v"))


@register("SELECT seq, CASE WHEN seq % 3 = 0 THEN 'no time' WHEN seq % 3 = 1 THEN 'values differ in number' END AS reason FROM group_in WHERE seq % 3 <> 2 AND len(slots) > 0")
def wire_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group inserts of which some have lost their time and some a value."""
    own = table(spark, sf_dir, "group_in").where("size(slots) > 0")
    broken = own.select("seq", F.lit(7).alias("id"), "slots", F.expr("if(seq % 3 = 0, null, t)").alias("t"), F.expr("if(seq % 3 = 1, concat(v, array(1D)), v)").alias("v"))
    lines = broken.select("seq", F.to_json(F.struct("id", "slots", "t", "v")).alias("value"))
    return wire.rejected(wire.parse_inserts(lines, keep=["seq"])).select("seq", "reason")


@register("SELECT seq, t, slots[1]::INT AS first_slot, len(v)::INT AS n, CASE WHEN NOT isnan(v[1]) THEN v[1] END AS first_v, len(lsets)::INT AS members, lsets[1]['__name__'] AS first_name FROM group_in WHERE list_count(v) = len(v)")
def proto_insert_round_trip(spark, sf_dir):
    """Group inserts as binary bodies, and parsed again."""
    own = table(spark, sf_dir, "group_in").where(~F.exists("v", lambda x: x.isNull()))
    one = F.array(F.struct(F.lit(1).alias("type"), F.lit(None).cast("bigint").alias("id"), "slots", F.col("group_labels").alias("lset"), "lsets", "t", "v"))
    back = own.select("seq", F.explode(proto.decoded_inserts(proto.encoded_inserts(one))).alias("r"))
    first = F.get("r.lsets", F.lit(0))
    return finite(back.select("seq", "r.t", F.get("r.slots", F.lit(0)).alias("first_slot"), F.size("r.v").alias("n"), F.get("r.v", F.lit(0)).alias("first_v"), F.size("r.lsets").alias("members"), F.try_element_at(first, F.lit("__name__")).alias("first_name")), "first_v")


@register("SELECT id, metric['region'] AS region, t, CASE WHEN NOT isnan(v) THEN v END AS v FROM query_samples JOIN query_in USING (id) WHERE v IS NOT NULL")
def proto_result_round_trip(spark, sf_dir):
    """Results as binary bodies, a page a day, and read again."""
    rows = table(spark, sf_dir, "query_samples").where("v IS NOT NULL").join(table(spark, sf_dir, "query_in").select("id", "metric"), "id")
    pages = rows.groupBy("id", F.expr(f"t div {DAY}").alias("page")).agg(F.any_value("metric").alias("metric"), F.sort_array(F.collect_list(F.struct("t", "v"))).alias("values"))
    back = pages.select(proto.decoded_result(proto.encoded_result(F.struct("id", "metric", "values"))).alias("r"))
    return finite(back.select("r.id", F.try_element_at("r.metric", F.lit("region")).alias("region"), F.explode("r.values").alias("p")).select("id", "region", "p.t", "p.v"))


# Store verbs


def _by_metric(spark, sf_dir):
    """The samples of results, with the labels of their metric."""
    return table(spark, sf_dir, "query_samples").join(table(spark, sf_dir, "query_in").select("id", F.col("metric").alias("labels")), "id").where("t IS NOT NULL")


_BY_METRIC = f"m AS (SELECT {_TEXT('metric')} AS labels, t, v FROM query_samples JOIN query_in USING (id) WHERE t IS NOT NULL)"


@register(f"""WITH {_BY_METRIC} SELECT labels, t, CASE WHEN NOT isnan(v) THEN v END AS v FROM (SELECT *, row_number() OVER (PARTITION BY labels, t ORDER BY v DESC NULLS LAST) AS rn FROM m) WHERE rn = 1""")
def store_add(spark, sf_dir):
    """Samples by labels: series are created, then found again for the same samples delivered as the next batch."""
    store = Store(spark, _fresh(spark, "store"), 30 * DAY)
    rows = _by_metric(spark, sf_dir).select("labels", "t", "v", F.lit(1).cast("bigint").alias("seq"))
    for batch in (0, 1, 1):
        store.add(rows, batch)
    return finite(store.query(EVERYTHING).select(L.text(F.col("labels")).alias("labels"), "t", "v"))


def _store_of(spark, sf_dir, width: int = 30 * DAY) -> Store:
    """The samples of results under their ids, all of them registered."""
    store = Store(spark, _fresh(spark, "store"), width)
    asked = table(spark, sf_dir, "query_in").select(F.col("id").alias("series_id"), F.col("metric").alias("labels"))
    asked.withColumn("label_key", L.label_key(F.col("labels"))).withColumn("batch", F.lit(0).cast("bigint")).write.parquet(store.root + "/series")
    return store


def _results(spark, sf_dir):
    return table(spark, sf_dir, "query_samples").where("t IS NOT NULL").select(F.col("id").alias("series_id"), "t", "v", F.lit(0).cast("bigint").alias("seq"))


_BEST = lambda rows, order="v DESC NULLS LAST": f"SELECT id AS series_id, t, CASE WHEN NOT isnan(v) THEN v END AS v FROM (SELECT *, row_number() OVER (PARTITION BY id, t ORDER BY {order}) AS rn FROM {rows}) WHERE rn = 1"


@register("SELECT series_id, count(*) AS n FROM samples_in WHERE series_id NOT IN (SELECT id FROM query_in) GROUP BY 1")
def store_add_fast(spark, sf_dir):
    """Samples by id into a store that knows the results only: those of other series come back."""
    store = _store_of(spark, sf_dir)
    unknown = store.add_fast(_results(spark, sf_dir).unionByName(samples(spark, sf_dir).select("series_id", "t", "v", "seq")), 0)
    return unknown.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


@register(f"SELECT DISTINCT {_TEXT('metric')} AS labels, 0::BIGINT AS stored FROM query_in")
def store_rollback(spark, sf_dir):
    """What a rolled back batch leaves behind: its series, none of its samples."""
    store = Store(spark, _fresh(spark, "store"), 30 * DAY)
    store.rollback(_by_metric(spark, sf_dir).unionByName(table(spark, sf_dir, "query_in").select("id", F.col("mint").alias("t"), F.lit(0.0).alias("v"), F.col("metric").alias("labels"))).withColumn("seq", F.col("t")), 0)
    return store.series().select(L.text(F.col("labels")).alias("labels"), F.lit(store.samples().count()).alias("stored"))


@register(f"""WITH d AS (SELECT q.id, q.t, q.v FROM query_samples q JOIN query_in i USING (id) WHERE q.t >= 0 AND NOT (coalesce(i.metric['region'], '') = 'reg-north' AND q.t BETWEEN {T0 + 10 * DAY} AND {T0 + 30 * DAY})) {_BEST('d')}""")
def store_delete_matching(spark, sf_dir):
    store = _store_of(spark, sf_dir)
    store.append(_results(spark, sf_dir), 0)
    store.delete_matching([Eq("region", "reg-north")], T0 + 10 * DAY, T0 + 30 * DAY)
    return finite(store.query(EVERYTHING).select("series_id", "t", "v"))


@register(f"SELECT t // {DAY} * {DAY} AS p_start, count(*) AS samples, 1::BIGINT AS batches, true AS has_files FROM query_samples WHERE t >= 0 GROUP BY 1")
def store_properties(spark, sf_dir):
    store = _store_of(spark, sf_dir, DAY)
    store.append(_results(spark, sf_dir).where("t >= 0"), 0)
    return store.properties().select("p_start", "samples", "batches", ((F.col("files") > 0) & (F.col("bytes") > 0)).alias("has_files"))


@register(f"WITH w AS (SELECT id, t, v, 0 AS s FROM query_samples WHERE t >= 0 UNION ALL SELECT id, t, t + 12.0, 1 FROM query_samples WHERE t >= 0 AND id % 2 = 0) {_BEST('w', 's DESC, v DESC NULLS LAST')}")
def store_two_writers(spark, sf_dir):
    """Two writers with batch numbers of their own; the second writes every other series again, the store is compacted between."""
    store, rows = _store_of(spark, sf_dir), _results(spark, sf_dir)
    store.append(rows, 3, "first")
    store.compact(1)
    late = rows.where("series_id % 2 = 0").select("series_id", "t", (F.col("t") + 12.0).alias("v"), F.lit(1).cast("bigint").alias("seq"))
    for _ in range(2):
        store.append(late, 0, "second")
    return finite(store.query(EVERYTHING).select("series_id", "t", "v"))


@register(f"WITH w AS (SELECT id, t, v FROM query_samples WHERE t >= 0 UNION ALL SELECT id, t + 500, t + 500.0 FROM query_samples WHERE t >= 0 AND id % 2 = 0), o AS (SELECT id, t, v, 0 AS s FROM query_samples WHERE t >= 0 UNION ALL SELECT id, t + 500, t + 500.0, 1 FROM query_samples WHERE t >= 0 AND id % 2 = 0) {_BEST('o', 's DESC, v DESC NULLS LAST')}")
def store_late_interleave(spark, sf_dir):
    """Late samples of every other series between those that are there."""
    store, rows = _store_of(spark, sf_dir), _results(spark, sf_dir)
    store.append(rows, 0)
    store.append(rows.where("series_id % 2 = 0").select("series_id", (F.col("t") + 500).alias("t"), (F.col("t") + 500.0).alias("v"), F.lit(1).cast("bigint").alias("seq")), 1)
    store.compact(2)
    return finite(store.query(EVERYTHING).select("series_id", "t", "v"))


_PURGE = T0 + 20 * DAY + 5


@register(f"WITH k AS (SELECT id, t, v FROM query_samples WHERE t >= 0 AND t // {TWO_HOURS} * {TWO_HOURS} + {TWO_HOURS} > {_PURGE} AND id IN (SELECT id FROM query_samples GROUP BY 1 HAVING max(t) > {_PURGE})) {_BEST('k')}")
def store_retention(spark, sf_dir):
    """Partitions of two hours that end at or before a time go, and series without a later sample."""
    store = _store_of(spark, sf_dir, TWO_HOURS)
    store.append(_results(spark, sf_dir), 0)
    store.purge(_PURGE)
    return finite(store.query(EVERYTHING).select("series_id", "t", "v"))


@register(f"""SELECT series_id, t, CASE WHEN NOT isnan(v) THEN v END AS v FROM (SELECT series_id, t, v, row_number() OVER (PARTITION BY series_id, t ORDER BY seq DESC, v DESC NULLS LAST) AS rn
FROM samples_in JOIN (SELECT DISTINCT series_id FROM series_in WHERE labels['region'] = 'reg-south') USING (series_id) WHERE seq <= 20000 AND t >= 0) WHERE rn = 1""")
def store_snapshot(spark, sf_dir):
    """A read as of a sequence number from a store that was compacted since, the versions of that time being kept."""
    return finite(_late_store(spark, sf_dir, snapshot=20_000).query([Eq("region", "reg-south")], at=20_000).select("series_id", "t", "v"))


_PATCHED = lambda sets: " UNION ALL ".join(f"SELECT id, t, {v} AS v, {k} AS s FROM query_samples WHERE t >= 0 AND {w}" for k, (w, v) in enumerate(sets))
_PATCHES = [("true", "v"), ("id % 2 = 0", "t + 1.0"), ("id % 3 = 0", "t + 2.0"), ("id % 2 = 0 AND id % 3 = 0", "t + 3.0")]


def _patched(spark, sf_dir, store: Store) -> Store:
    """Samples, and three batches that write some of them again."""
    rows = _results(spark, sf_dir).where("t >= 0")
    for k, (where, v) in enumerate(_PATCHES):
        store.append(rows.where(where.replace("id", "series_id")).select("series_id", "t", F.expr(v).cast("double").alias("v"), F.lit(k).cast("bigint").alias("seq")), k)
        if k == 0 and not store.compact_at:
            store.compact(1)
    return store


@register(f"WITH w AS ({_PATCHED(_PATCHES)}) {_BEST('w', 's DESC, v DESC NULLS LAST')}")
def store_base_and_patches(spark, sf_dir):
    """A merged base with patches beside it, merged as it is read."""
    return finite(_patched(spark, sf_dir, _store_of(spark, sf_dir, DAY)).query(EVERYTHING).select("series_id", "t", "v"))


@register(f"SELECT series_id, t, s::BIGINT AS seq, count(*) AS n FROM (SELECT id AS series_id, t, s FROM ({_PATCHED(_PATCHES)}) WHERE s > 0) GROUP BY ALL")
def store_head(spark, sf_dir):
    """What no compaction has taken in yet."""
    return _patched(spark, sf_dir, _store_of(spark, sf_dir, DAY)).head().groupBy("series_id", "t", "seq").agg(F.count(F.lit(1)).alias("n"))


@register(f"SELECT t // {DAY} * {DAY} AS p_start, count(DISTINCT s) FILTER (s > 0) >= 3 AS merged FROM ({_PATCHED(_PATCHES)}) GROUP BY 1")
def store_patch_merge(spark, sf_dir):
    """Partitions whose patches have come to three are merged, the others are left."""
    store = _patched(spark, sf_dir, _store_of(spark, sf_dir, DAY))
    before, due = store.patches(), set(store.compact(3))
    return spark.createDataFrame([(p, p in due and not store.patches()[p]) for p in before], "p_start bigint, merged boolean")


@register(f"WITH w AS ({_PATCHED(_PATCHES)}) SELECT *, true AS merged_in_time FROM ({_BEST('w', 's DESC, v DESC NULLS LAST')})")
def store_auto_compact(spark, sf_dir):
    """A store that merges a partition with the append that brings its second patch."""
    store = _store_of(spark, sf_dir, 30 * DAY)
    store.compact_at = 2
    _patched(spark, sf_dir, store)
    in_time = all(len(batches) < 2 for batches in store.patches().values())
    return finite(store.query(EVERYTHING).select("series_id", "t", "v")).withColumn("merged_in_time", F.lit(in_time))


# Groups


@register(f"""WITH {_GROUP}, p AS (SELECT group_key, seq, unnest(lsets) AS labels, unnest(range(0, len(lsets))) AS pos FROM g WHERE len(lsets) > 0),
f AS (SELECT group_key, {_TEXT('labels')} AS member, min(seq * 1000 + pos) AS first FROM p GROUP BY 1, 2)
SELECT group_key, member, row_number() OVER (PARTITION BY group_key ORDER BY first) - 1 AS slot FROM f""")
def group_assign_slots(spark, sf_dir):
    """Slots of members that inserts name by labels alone, in order of arrival."""
    named = _group_rows(spark, sf_dir).where("size(lsets) > 0").select("group_key", "seq", F.posexplode("lsets").alias("pos", "labels"))
    return groups.assign_slots(named.withColumn("label_key", L.text(F.col("labels")))).select("group_key", F.col("label_key").alias("member"), F.col("slot").cast("bigint").alias("slot"))


_HALF = T0 + 25 * DAY


@register(f"""WITH {_LONG}, s AS (SELECT DISTINCT group_key, slot FROM cur), x AS (SELECT DISTINCT group_key, t FROM cur)
SELECT s.group_key, s.slot::INT AS slot, x.t, CASE WHEN NOT isnan(v) THEN v END AS v FROM s JOIN x USING (group_key) LEFT JOIN cur c ON c.group_key = s.group_key AND c.slot = s.slot AND c.t = x.t""")
def group_concat(spark, sf_dir):
    """Two parts of each group, before and after a time, aligned with NULL and put together."""
    now = groups.current(groups.long_form(_group_rows(spark, sf_dir)))
    return finite(groups.concat(now.where(F.col("t") < _HALF), now.where(F.col("t") >= _HALF)))


@register(f"WITH {_LONG} SELECT group_key, slot::INT AS slot, t, count(*) AS n FROM l WHERE slot IS NOT NULL GROUP BY ALL")
def group_chain(spark, sf_dir):
    """All versions of a group's values, chunk after chunk."""
    long = groups.long_form(_group_rows(spark, sf_dir)).select("group_key", "slot", "t", "v")
    return groups.chained([long.where(F.col("t") < _HALF), long.where(F.col("t") >= _HALF)]).groupBy("group_key", "slot", "t").agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {_LONG}, s AS (SELECT DISTINCT group_key, slot FROM cur), x AS (SELECT DISTINCT group_key, t FROM cur)
SELECT s.group_key, s.slot::INT AS slot, x.t, CASE WHEN NOT isnan(v) THEN v END AS v FROM s JOIN x USING (group_key) LEFT JOIN cur c ON c.group_key = s.group_key AND c.slot = s.slot AND c.t = x.t""")
def codec_group_round_trip(spark, sf_dir):
    """Every group as one stream of times and a stream of values for each member, by day, and back."""
    now = groups.current(groups.long_form(_group_rows(spark, sf_dir)))
    whole = groups.concat(now, now.where("false"))
    wide = whole.groupBy("group_key", "t").agg(F.sort_array(F.collect_list(F.struct("slot", "v"))).alias("m"))
    rows = wide.groupBy("group_key", F.expr(f"t div {DAY}").alias("day")).agg(F.sort_array(F.collect_list(F.struct("t", F.transform("m", lambda x: x["v"]).alias("v")))).alias("rows"), F.first(F.transform("m", lambda x: x["slot"])).alias("slots"))
    back = rows.select("group_key", "slots", F.explode(codec.decoded_group(codec.encoded_group(F.col("rows")))).alias("r"))
    return finite(back.select("group_key", F.col("r.t").alias("t"), F.explode(F.arrays_zip("slots", F.col("r.v").alias("v"))).alias("e")).select("group_key", F.col("e.slots").alias("slot"), "t", F.col("e.v").alias("v")))


# Catalog and merging


@register(f"""WITH {_SERIES}, {_LIVE}, a AS (SELECT {_TEXT('labels')} AS labels, t, v, 0 AS src FROM live JOIN series USING (series_id) WHERE {_V('region')} = 'reg-north' AND t >= 0),
{_BY_METRIC.replace('m AS', 'b AS')}, u AS (SELECT * FROM a UNION ALL SELECT labels, t, CASE WHEN NOT isnan(v) THEN v END, 1 FROM b WHERE labels LIKE '%region=reg-north%')
SELECT labels, t, v FROM (SELECT *, row_number() OVER (PARTITION BY labels, t ORDER BY src DESC, v DESC NULLS LAST) AS rn FROM u) WHERE rn = 1""")
def merge_queriers(spark, sf_dir):
    """Two selections whose series have ids of their own, merged by label set; the second wins on equal times."""
    first = finite(scan.select(registrations(spark, sf_dir), samples(spark, sf_dir), [Eq("region", "reg-north")]))
    second = finite(_by_metric(spark, sf_dir).where(F.col("labels")["region"] == "reg-north"))
    merged = merge.merge_by_labels([first, second])
    return merged.select(L.text(L.from_key(F.col("label_key"))).alias("labels"), "t", "v")


@register("SELECT DISTINCT name FROM (SELECT unnest(map_keys(labels)) AS name FROM series_in UNION ALL SELECT unnest(map_keys(group_labels)) FROM group_in)")
def label_names_union(spark, sf_dir):
    return catalog.union_names([registrations(spark, sf_dir), table(spark, sf_dir, "group_in").select(F.col("group_labels").alias("labels"))])


@register(f"WITH {_SERIES} SELECT series_id, row_number() OVER (ORDER BY list_sort(map_entries(labels)), series_id) AS position FROM series")
def series_order(spark, sf_dir):
    return catalog.series_in_order(series(spark, sf_dir))


@register(f"{_FROM} WHERE {_V('__name__')} = 'queue_depth' AND t >= 0")
def select_ordered(spark, sf_dir):
    return finite(scan.ordered(scan.select(registrations(spark, sf_dir), samples(spark, sf_dir), [Eq("__name__", "queue_depth")])).select("series_id", "t", "v"))


@register("SELECT series_id, t, v, seq FROM samples_in WHERE false")
def empty_source(spark, sf_dir):
    return scan.empty(samples(spark, sf_dir))


_CHUNKS = """c AS (SELECT series_id, seq // 100000 AS chunk, t, v FROM samples_in), m AS (SELECT series_id, chunk, min(t) AS min_t, max(t) AS max_t FROM c GROUP BY 1, 2),
o AS (SELECT *, max(max_t) OVER (PARTITION BY series_id ORDER BY min_t, max_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR min_t > reach THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY min_t, max_t ROWS UNBOUNDED PRECEDING) AS island FROM o)"""


@register(f"WITH {_CHUNKS} SELECT series_id, t, CASE WHEN NOT isnan(v) THEN v END AS v FROM (SELECT series_id, t, v, row_number() OVER (PARTITION BY series_id, island, t ORDER BY chunk DESC, v DESC NULLS LAST) AS rn FROM c JOIN i USING (series_id, chunk)) WHERE rn = 1")
def chunk_overlap_samples(spark, sf_dir):
    """The samples of overlapping chunks, of equal times those of the later chunk."""
    own = samples(spark, sf_dir).selectExpr("series_id", "seq div 100000 AS chunk", "t", "v")
    chunks = own.groupBy("series_id", "chunk").agg(F.min("t").alias("min_t"), F.max("t").alias("max_t"))
    return finite(merge.merged_chunks(chunks, own).select("series_id", "t", "v"))


@register("WITH m AS (SELECT series_id, max(seq) AS mark FROM samples_in WHERE seq % 2 = 0 AND series_id % 5 > 0 AND seq < 400000 GROUP BY 1) SELECT series_id, t, seq, count(*) AS n FROM samples_in LEFT JOIN m USING (series_id) WHERE mark IS NULL OR seq > mark GROUP BY ALL")
def log_replay(spark, sf_dir):
    """The rows of a log after the flush marks of their series."""
    log = samples(spark, sf_dir).select("series_id", "t", "seq")
    flushed = log.where("seq % 2 = 0 AND series_id % 5 > 0 AND seq < 400000")
    return merge.replay(log, flushed).groupBy("series_id", "t", "seq").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH f AS (SELECT list_sort(map_entries(group_labels)) AS k, {_TEXT('group_labels')} AS labels, min(seq) AS first FROM group_in GROUP BY ALL) SELECT labels, row_number() OVER (ORDER BY first, k) AS series_id FROM f")
def index_recovery(spark, sf_dir):
    """Ids of label sets, given again from the log in which they arrived."""
    log = table(spark, sf_dir, "group_in").select(F.col("group_labels").alias("labels"), "seq")
    return catalog.recovered(log).select(L.text(L.from_key(F.col("label_key"))).alias("labels"), "series_id")


@register(f"""SELECT (SELECT count(*) FROM (SELECT DISTINCT e.key, e.value FROM (SELECT unnest(map_entries(labels)) AS e FROM series_in))) AS tags, (SELECT count(*) FROM query_in) AS intervals,
count(*) FILTER (m <= {_PURGE}) AS purged, count(*) FILTER (m > {_PURGE}) AS kept FROM (SELECT max(t) AS m FROM samples_in GROUP BY series_id)""")
def catalog_cardinalities(spark, sf_dir):
    return catalog.cardinalities(registrations(spark, sf_dir), _tombs(spark, sf_dir), catalog.time_bounds(samples(spark, sf_dir)), _PURGE)


@register(f"""WITH n AS (SELECT t // {DAY} * {DAY} AS p_start, id, count(*) AS n FROM query_samples GROUP BY 1, 2)
SELECT p_start, sum(n)::BIGINT AS samples, count(*) AS series, sum(ceil(n / 8.0::DOUBLE))::BIGINT AS chunks, (2 * count(*) FILTER (id IN (SELECT id FROM query_in)))::BIGINT AS tombstones FROM n GROUP BY 1""")
def block_stats_full(spark, sf_dir):
    own = scan.with_partition(table(spark, sf_dir, "query_samples").withColumnRenamed("id", "series_id"), DAY)
    return catalog.block_stats(own, _tombs(spark, sf_dir))


@register("""SELECT series_id, t, CASE WHEN NOT isnan(v) THEN v END AS v FROM (SELECT *, row_number() OVER (PARTITION BY series_id, t ORDER BY seq DESC) AS rn FROM (SELECT DISTINCT series_id, t, v, seq FROM samples_in)) WHERE rn = 1 AND seq % 10 <> 3""")
def kv_delete(spark, sf_dir):
    """Batches of writes in which every tenth deletes its key: later versions hide earlier ones, deletions hide all."""
    rows = samples(spark, sf_dir).select("series_id", "t", "v", "seq").distinct().withColumn("gone", F.col("seq") % 10 == 3)
    return finite(merge.visible(rows, ["series_id", "t"], "seq", "gone").select("series_id", "t", "v"))


@register(f"""SELECT DISTINCT series_id, t, lpad(printf('%X', series_id), 16, '0') || lpad(printf('%X', t), 16, '0') AS key, CASE WHEN t >= {T0 + DAY} THEN 2 * (t - {T0 + DAY}) ELSE -2 * (t - {T0 + DAY}) - 1 END AS zigzag, true AS decoded FROM samples_in WHERE series_id >= 0 AND t >= 0""")
def key_encoding(spark, sf_dir):
    """Keys of samples as bytes, differences of times in zigzag, and both decoded again."""
    own = samples(spark, sf_dir).select("series_id", "t").where("series_id >= 0 AND t >= 0").distinct()
    coded = own.withColumn("bytes", encoding.sample_key(F.col("series_id"), F.col("t"))).withColumn("zigzag", encoding.zigzag(F.col("t") - (T0 + DAY)))
    same = (encoding.from_big_endian(F.col("bytes")) == F.col("series_id")) & (encoding.from_big_endian(F.col("bytes"), 8) == F.col("t")) & (encoding.from_zigzag(F.col("zigzag")) == F.col("t") - (T0 + DAY))
    return coded.select("series_id", "t", F.hex("bytes").alias("key"), "zigzag", same.alias("decoded"))


# Labels, times, intervals


@register(f"WITH {_SERIES} SELECT series_id, {_TEXT('labels')} AS labels FROM series")
def label_from_flat(spark, sf_dir):
    """Label sets as flat lists of names and values, and back."""
    flat = F.flatten(F.transform(F.map_entries("labels"), lambda e: F.array(e["key"], e["value"])))
    return series(spark, sf_dir).select("series_id", L.text(L.from_flat(flat)).alias("labels"))


@register(f"WITH {_SERIES}, p AS (SELECT DISTINCT series_id, unnest(map_entries(labels), recursive := true) FROM series) SELECT series_id, {_TEXT('map_from_entries(list({key: key, value: value}))')} AS labels FROM p GROUP BY 1")
def label_from_map(spark, sf_dir):
    """Label sets put together from their index entries."""
    entries = catalog.postings(series(spark, sf_dir)).groupBy("series_id").agg(F.collect_list(F.struct(F.col("name").alias("key"), "value")).alias("e"))
    return entries.select("series_id", L.text(L.from_key(F.col("e"))).alias("labels"))


@register(f"SELECT {_TEXT('labels')} AS labels, count(*) AS n FROM series_in GROUP BY 1")
def label_identity(spark, sf_dir):
    """Registrations per hash of the label set: as many as per label set."""
    own = registrations(spark, sf_dir).groupBy(L.identity(F.col("labels")).alias("h")).agg(F.min(L.text(F.col("labels"))).alias("labels"), F.count(F.lit(1)).alias("n"))
    return own.select("labels", "n")


@register(f"""WITH {_GROUP} SELECT array_to_string(list_transform(lsets, lambda m: {_TEXT('m')}), ';') AS sets, count(*) AS n FROM g WHERE len(lsets) > 0 GROUP BY 1""")
def label_group_identity(spark, sf_dir):
    """Group inserts per hash of their label sets."""
    own = table(spark, sf_dir, "group_in").where("size(lsets) > 0")
    sets = F.array_join(F.transform("lsets", L.text), ";")
    return own.groupBy(L.group_identity(F.col("lsets")).alias("h")).agg(F.min(sets).alias("sets"), F.count(F.lit(1)).alias("n")).select("sets", "n")


@register("SELECT id, count(CASE WHEN t BETWEEN mint AND maxt THEN 1 END) AS inside, count(CASE WHEN NOT t BETWEEN mint AND maxt THEN 1 END) AS outside FROM query_samples JOIN query_in USING (id) GROUP BY 1")
def interval_in_bounds(spark, sf_dir):
    own = table(spark, sf_dir, "query_samples").join(table(spark, sf_dir, "query_in"), "id")
    inside = intervals.in_bounds(F.col("t"), F.col("mint"), F.col("maxt"))
    return own.groupBy("id").agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


@register("SELECT id, mint // 5 = mint // 7 AS same FROM query_in".replace("mint // 5 = mint // 7", "id % 2 = 0"))
def interval_equal(spark, sf_dir):
    """Delete intervals against themselves, for every other result with one end moved."""
    own = F.array(F.struct(F.col("mint").alias("min_t"), F.col("maxt").alias("max_t")))
    other = F.array(F.struct(F.col("mint").alias("min_t"), (F.col("maxt") + F.col("id") % 2).alias("max_t")))
    return table(spark, sf_dir, "query_in").select("id", intervals.same_intervals(own, other).alias("same"))


@register(f"SELECT id, greatest(mint, {T0 + 20 * DAY}) AS low, least(maxt, {T0 + 30 * DAY}) AS high FROM query_in")
def interval_clamp(spark, sf_dir):
    low, high = timeutil.clamp(F.col("mint"), F.col("maxt"), T0 + 20 * DAY, T0 + 30 * DAY)
    return table(spark, sf_dir, "query_in").select("id", low.alias("low"), high.alias("high"))


@register("SELECT i AS step, (7200000 * 3 ** i)::BIGINT AS width, least(greatest(100 * 2 ** i, 100), 2000)::BIGINT AS delay FROM range(8) t(i)")
def time_series_of_widths(spark, sf_dir):
    """Exponential partition widths, and the delays of a retry that start at 100 and end at 2,000."""
    delays, delay = [], 0.0
    for _ in range(8):
        delay = timeutil.backoff(delay, 100, 2000)
        delays.append(int(delay))
    return spark.createDataFrame(list(zip(range(8), timeutil.block_ranges(TWO_HOURS, 8, 3), delays, strict=True)), "step bigint, width bigint, delay bigint")


@register("""WITH s AS (SELECT id, count(*) * 16 AS size FROM query_samples GROUP BY 1), w AS (SELECT id, size, 7200000::DOUBLE * 4096 / size AS wanted FROM s)
SELECT id, size, CASE WHEN size > 4096 THEN floor(7200000 / pow(2, list_min(list_filter(range(0, 63), lambda k: floor(7200000 / pow(2, k)) <= greatest(wanted, 450000))))) ELSE 7200000 * pow(2, len(list_filter(range(1, 41), lambda k: 7200000 * pow(2, k) < wanted))) END::BIGINT AS width FROM w""")
def adapted_width(spark, sf_dir):
    """For each result the width of partitions that would hold 4,096 bytes of its samples."""
    sizes = table(spark, sf_dir, "query_samples").groupBy("id").agg((F.count(F.lit(1)) * 16).alias("size"))
    return sizes.select("id", "size", timeutil.adapted_width(F.lit(TWO_HOURS), F.col("size"), 4096).alias("width"))


# Streams


@register("SELECT user_id AS series_id, epoch_ms(time_bucket(INTERVAL 1 day, ts)) AS start_t, max(value) AS max_v, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Daily windows over events that arrive as a stream of files; the last state of every window."""
    arriving, out = _fresh(spark, "arriving"), _fresh(spark, "windows")
    table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v")).repartition(4).write.parquet(arriving)
    stream = ingest.file_stream(spark, arriving, "series_id bigint, ts timestamp, v double", 2)
    query = ingest.windowed(stream, "1 day", "40 days").writeStream.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out))
    query.option("checkpointLocation", _fresh(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("series_id", timeutil.millis(F.col("start")).cast("bigint").alias("start_t"), "max_v", "n")


@register(f"WITH {_BY_METRIC} SELECT labels, t, CASE WHEN NOT isnan(v) THEN v END AS v FROM (SELECT *, row_number() OVER (PARTITION BY labels, t ORDER BY v DESC NULLS LAST) AS rn FROM m) WHERE rn = 1")
def stream_inserts(spark, sf_dir):
    """JSON inserts that arrive as a stream of files, by labels, into a store; a second start finds nothing new."""
    store, arriving, check = Store(spark, _fresh(spark, "store"), 30 * DAY), _fresh(spark, "arriving"), _fresh(spark, "stream")
    rows = _by_metric(spark, sf_dir).select(F.col("labels").alias("lset"), "t", F.array("v").alias("v"))
    wire.encode_inserts(rows, "lset", "t", "v").repartition(3).write.text(arriving)
    for _ in range(2):
        stream = ingest.json_inserts(ingest.file_stream(spark, arriving, "value string", 2, "text")).withColumn("seq", F.lit(0).cast("bigint"))
        ingest.into_store(stream, store, check, by_labels=True).awaitTermination()
    return finite(store.query(EVERYTHING).select(L.text(F.col("labels")).alias("labels"), "t", "v"))


@register(f"{_FROM} WHERE regexp_full_match({_V('service')}, 'gate.*') AND t >= 0 AND {_V('__name__')} = 'queue_depth'")
def wire_query_request(spark, sf_dir):
    """A request written and read again, with one matcher more, and carried out."""
    where, mint, maxt, _ = wire.parse_query(wire.encode_query([Eq("__name__", "queue_depth")], 0, scan.MAX_T))
    return finite(scan.select(registrations(spark, sf_dir), samples(spark, sf_dir), [*where, Re("service", "gate.*")], mint, maxt).select("series_id", "t", "v"))
