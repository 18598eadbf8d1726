"""Queries for the engine's own operators over the test tables, each with its SQL where SQL can express it.

Series come from ``series_in``, samples from ``samples_in``, groups from ``group_in``, index entries from
``series_tags``. The last write wins: of the rows of one ``(series_id, t)`` the highest ``seq``, of equal ``seq`` the
greatest value. The benchmark shapes keep their names (metrics-hosts-hours), an hour scaled to a day, as the
test series are sparse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import codec, timeutil, wire
from tideline.functions import labels as L
from tideline.operators import aggregate, catalog, groups, intervals, merge, scan
from tideline.operators.ids import dense_ids
from tideline.operators.matchers import Eq, Not, Re
from tideline.plans.rounding import digits, digits_sql
from tideline.session import checkpoint_dir
from tideline.sources.store import Store
from tideline.sources.tables import table
from tideline.streaming import ingest

DAY = 86_400_000
T0 = 1_357_344_000_000  # first midnight of the test data
HOSTS = ["node-shared", "node-000542", "node-000650", "node-000664", "node-001088", "node-002704", "node-003652", "node-007481"]
METRICS = ["cpu_busy_pct", "cpu_wait_pct", "mem_fill_pct", "disk_fill_pct", "cache_hit_pct"]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Add a query under its name, with its SQL."""

    def add(query):
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return add


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series_id, labels``, repeated registrations once."""
    return table(spark, sf_dir, "series_in").groupBy("series_id").agg(F.any_value("labels", True).alias("labels"))


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series_id, labels`` as registered, repeats included; selections filter them before they make them unique."""
    return table(spark, sf_dir, "series_in")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "samples_in")


def finite(df: DataFrame, column: str = "v") -> DataFrame:
    """NaN shown as NULL, so that both engines print it alike."""
    return df.withColumn(column, F.when(~F.isnan(column), F.col(column)))


_SERIES = "series AS (SELECT series_id, any_value(labels) AS labels FROM series_in GROUP BY 1)"
_LIVE = """live AS (SELECT series_id, t, CASE WHEN NOT isnan(v) THEN v END AS v FROM (
  SELECT series_id, t, v, row_number() OVER (PARTITION BY series_id, t ORDER BY seq DESC, v DESC NULLS LAST) AS rn FROM samples_in) WHERE rn = 1)"""
_FROM = f"WITH {_SERIES}, {_LIVE} SELECT series_id, t, v FROM live JOIN series USING (series_id)"
_V = lambda n: f"coalesce(labels['{n}'], '')"
_TEXT = lambda m: f"'{{' || array_to_string(list_transform(list_sort(map_entries({m})), lambda e: e.key || '=' || e.value), ',') || '}}'"


def _select(spark, sf_dir, matchers, a=0, b=60 * DAY, at=None) -> DataFrame:
    return finite(scan.select(registrations(spark, sf_dir), samples(spark, sf_dir), matchers, T0 + a, T0 + b, at=at).select("series_id", "t", "v"))


_RANGE = lambda a, b: f"t BETWEEN {T0 + a} AND {T0 + b}"

# Selections


@register(f"{_FROM} WHERE {_V('__name__')} = 'cpu_busy_pct' AND {_RANGE(5 * DAY, 12 * DAY)}")
def select_eq_range(spark, sf_dir):
    return _select(spark, sf_dir, [Eq("__name__", "cpu_busy_pct")], 5 * DAY, 12 * DAY)


@register(f"{_FROM} WHERE {_V('region')} = 'reg-north' AND {_V('service')} = 'gateway' AND {_V('team')} = 'mill'")
def select_multi_eq(spark, sf_dir):
    return _select(spark, sf_dir, [Eq("region", "reg-north"), Eq("service", "gateway"), Eq("team", "mill")])


@register(f"{_FROM} WHERE regexp_full_match({_V('hostname')}, 'node-00[0-4].*|node-shared') AND {_V('__name__')} = 'mem_fill_pct'")
def select_regex(spark, sf_dir):
    return _select(spark, sf_dir, [Re("hostname", "node-00[0-4].*|node-shared"), Eq("__name__", "mem_fill_pct")])


@register(f"{_FROM} WHERE {_V('region')} <> 'reg-north' AND {_V('__name__')} = 'fan_speed_rpm'")
def select_not(spark, sf_dir):
    return _select(spark, sf_dir, [Not(Eq("region", "reg-north")), Eq("__name__", "fan_speed_rpm")])


@register(f"{_FROM} WHERE NOT regexp_full_match({_V('os')}, 'lynxos[0-9]+') AND {_V('__name__')} = 'heap_used_mb'")
def select_not_regex(spark, sf_dir):
    return _select(spark, sf_dir, [Not(Re("os", "lynxos[0-9]+")), Eq("__name__", "heap_used_mb")])


@register(f"{_FROM} WHERE {_V('rack')} = ''")
def select_unset_label(spark, sf_dir):
    return _select(spark, sf_dir, [Eq("rack", "")])


@register(f"{_FROM} WHERE false")
def select_invalid_regex(spark, sf_dir):
    return _select(spark, sf_dir, [Re("os", "lynx(os")])


@register(f"{_FROM} WHERE {_V('service')} = 'no such service'")
def select_no_match(spark, sf_dir):
    return _select(spark, sf_dir, [Eq("service", "no such service")])


@register(f"WITH {_SERIES}, {_LIVE} SELECT series_id, {_TEXT('labels')} AS labels, t, v FROM live JOIN series USING (series_id) WHERE {_RANGE(0, DAY)}")
def select_all_with_labels(spark, sf_dir):
    rows = scan.select_all(registrations(spark, sf_dir), samples(spark, sf_dir), T0, T0 + DAY)
    return finite(rows.select("series_id", L.text(F.col("labels")).alias("labels"), "t", "v"))


# Postings and catalog


def _postings(spark, sf_dir):
    return catalog.postings(registrations(spark, sf_dir))


_IDS = lambda n, v: f"SELECT DISTINCT series_id FROM series_in WHERE labels['{n}'] = '{v}'"


@register(f"{_IDS('region', 'reg-north')} INTERSECT {_IDS('os', 'lynxos7')} INTERSECT {_IDS('team', 'harbor')}")
def postings_intersect(spark, sf_dir):
    index = _postings(spark, sf_dir)
    return catalog.intersect([catalog.lookup(index, *p) for p in (("region", "reg-north"), ("os", "lynxos7"), ("team", "harbor"))])


@register(f"{_IDS('region', 'reg-east')} UNION {_IDS('region', 'reg-west')} UNION {_IDS('team', 'ferry')}")
def postings_union(spark, sf_dir):
    index = _postings(spark, sf_dir)
    return catalog.union([catalog.lookup(index, *p) for p in (("region", "reg-east"), ("region", "reg-west"), ("team", "ferry"))])


@register(f"SELECT DISTINCT series_id FROM series_in EXCEPT {_IDS('service_environment', 'production')}")
def postings_subtract(spark, sf_dir):
    return catalog.subtract(catalog.all_ids(registrations(spark, sf_dir)), catalog.lookup(_postings(spark, sf_dir), "service_environment", "production"))


@register("SELECT DISTINCT series_id FROM series_in")
def postings_all(spark, sf_dir):
    return catalog.all_ids(registrations(spark, sf_dir))


@register(_IDS("datacenter", "dc-n1"))
def postings_lookup(spark, sf_dir):
    return catalog.lookup(_postings(spark, sf_dir), "datacenter", "dc-n1")


@register("WITH p AS (SELECT DISTINCT series_id, unnest(map_entries(labels), recursive := true) FROM series_in) SELECT key AS name, value, series_id FROM p WHERE series_id NOT IN (SELECT series_id FROM series_in WHERE labels['arch'] = 'w32')")
def postings_delete(spark, sf_dir):
    index = _postings(spark, sf_dir)
    return catalog.delete_ids(index, catalog.lookup(index, "arch", "w32"))


@register("WITH p AS (SELECT DISTINCT series_id, unnest(map_entries(labels), recursive := true) FROM series_in) SELECT key AS name, value, count(*) AS ids, min(series_id) AS first_id, max(series_id) AS last_id FROM p GROUP BY 1, 2")
def postings_entries(spark, sf_dir):
    return catalog.index_entries(_postings(spark, sf_dir))


@register("SELECT DISTINCT unnest(map_keys(labels)) AS name FROM series_in")
def label_names(spark, sf_dir):
    return catalog.label_names(registrations(spark, sf_dir))


@register("SELECT DISTINCT labels['service_version'] AS value FROM series_in WHERE labels['service_version'] IS NOT NULL")
def label_values(spark, sf_dir):
    return catalog.label_values(registrations(spark, sf_dir), "service_version")


@register("SELECT DISTINCT symbol FROM (SELECT unnest(list_concat(map_keys(labels), map_values(labels))) AS symbol FROM series_in) WHERE symbol IS NOT NULL")
def symbols(spark, sf_dir):
    return catalog.symbols(registrations(spark, sf_dir))


@register("WITH p AS (SELECT unnest(map_entries(labels), recursive := true) FROM series_in) SELECT DISTINCT key AS name, value FROM p")
def label_pairs_sorted(spark, sf_dir):
    return catalog.label_pairs(registrations(spark, sf_dir))


@register("SELECT DISTINCT labels['region'] AS region, labels['datacenter'] AS datacenter FROM series_in WHERE labels['region'] IS NOT NULL AND labels['datacenter'] IS NOT NULL")
def label_tuple_values(spark, sf_dir):
    return catalog.tuple_values(registrations(spark, sf_dir), ["region", "datacenter"])


@register("SELECT DISTINCT value FROM (SELECT labels['os'] AS value FROM series_in UNION SELECT metric['os'] FROM query_in) WHERE value IS NOT NULL")
def label_values_union(spark, sf_dir):
    other = table(spark, sf_dir, "query_in").select(F.col("metric").alias("labels"))
    return catalog.union_values([registrations(spark, sf_dir), other], "os")


# Merging


@register(f"WITH {_LIVE} SELECT * FROM live")
def merge_lww(spark, sf_dir):
    return finite(merge.last_write_wins(samples(spark, sf_dir), ["series_id", "t"], ["seq"]))


@register("""SELECT l_suppkey, l_returnflag, l_linestatus, l_shipdate, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus, l_shipdate
ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1""")
def merge_lww_lineitem(spark, sf_dir):
    return merge.last_write_wins(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate"], ["l_orderkey", "l_linenumber", "l_extendedprice"], ["l_extendedprice"])


@register("SELECT id AS series_id, t, CASE WHEN NOT isnan(v) THEN v END AS v FROM query_samples UNION ALL SELECT series_id, t, CASE WHEN NOT isnan(v) THEN v END FROM samples_in")
def chain_no_dedup(spark, sf_dir):
    first = table(spark, sf_dir, "query_samples").select(F.col("id").alias("series_id"), "t", "v")
    return finite(merge.chain([first, samples(spark, sf_dir).select("series_id", "t", "v")]))


@register("""WITH s AS (SELECT series_id, t, v, CASE WHEN seq % 3 = 0 THEN 2 WHEN seq % 3 = 1 THEN 0 ELSE 1 END AS src FROM samples_in WHERE v IS NOT NULL AND NOT isnan(v))
SELECT series_id, t, v FROM (SELECT *, row_number() OVER (PARTITION BY series_id, t ORDER BY src DESC, v DESC) AS rn FROM s) WHERE rn = 1""")
def multi_source_merge(spark, sf_dir):
    rows = samples(spark, sf_dir).where("v IS NOT NULL AND NOT isnan(v)")
    return merge.merge_sources([rows.where("seq % 3 = 1"), rows.where("seq % 3 = 2"), rows.where("seq % 3 = 0")], ["series_id", "t"])


@register(f"""WITH c AS (SELECT series_id, seq // 100000 AS chunk, t, v FROM samples_in), m AS (SELECT series_id, chunk, min(t) AS min_t, max(t) AS max_t FROM c GROUP BY 1, 2),
o AS (SELECT *, max(max_t) OVER (PARTITION BY series_id ORDER BY min_t, max_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR min_t > reach THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY min_t, max_t ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT series_id, min(t) AS min_t, max(t) AS max_t, count(DISTINCT t) AS n FROM c JOIN i USING (series_id, chunk) GROUP BY series_id, island""")
def chunk_overlap_coalesce(spark, sf_dir):
    own = samples(spark, sf_dir).selectExpr("series_id", "seq div 100000 AS chunk", "t", "v")
    chunks = own.groupBy("series_id", "chunk").agg(F.min("t").alias("min_t"), F.max("t").alias("max_t"))
    return merge.coalesce_chunks(chunks, own)


@register(f"""SELECT series_id, t, CASE WHEN NOT isnan(v) THEN v END AS v FROM (SELECT series_id, t, v, row_number() OVER (PARTITION BY series_id, t ORDER BY seq DESC, v DESC NULLS LAST) AS rn
FROM samples_in JOIN (SELECT DISTINCT series_id FROM series_in WHERE labels['region'] = 'reg-south') USING (series_id) WHERE seq <= 20000) WHERE rn = 1""")
def snapshot_read(spark, sf_dir):
    return _select(spark, sf_dir, [Eq("region", "reg-south")], -(60 * DAY), 60 * DAY, at=20000)


@register("""SELECT series_id, t, seq FROM (SELECT *, row_number() OVER (PARTITION BY series_id, t ORDER BY seq DESC) AS rn FROM (SELECT DISTINCT series_id, t, seq, v IS NULL AS gone FROM samples_in))
WHERE rn = 1 AND NOT gone""")
def mvcc_visible(spark, sf_dir):
    rows = samples(spark, sf_dir).select("series_id", "t", "seq", F.col("v").isNull().alias("gone")).distinct()
    return merge.visible(rows, ["series_id", "t"], "seq", "gone").select("series_id", "t", "seq")


# Groups


def _group_rows(spark, sf_dir):
    return table(spark, sf_dir, "group_in").withColumn("group_key", L.text(F.col("group_labels")))


_GROUP = f"g AS (SELECT *, {_TEXT('group_labels')} AS group_key FROM group_in)"
_LONG = f"""{_GROUP}, l AS (SELECT group_key, t, seq, unnest(CASE WHEN len(slots) > 0 THEN slots ELSE range(0, len(v)) END) AS slot, unnest(v) AS v FROM g),
cur AS (SELECT group_key, slot, t, v FROM (SELECT *, row_number() OVER (PARTITION BY group_key, slot, t ORDER BY seq DESC, v DESC NULLS LAST) AS rn FROM l WHERE slot IS NOT NULL) WHERE rn = 1)"""


@register(f"WITH {_LONG} SELECT group_key, slot::INT AS slot, t, CASE WHEN NOT isnan(v) THEN v END AS v FROM cur WHERE v IS NOT NULL")
def group_long_nonnull(spark, sf_dir):
    return finite(groups.non_null(groups.current(groups.long_form(_group_rows(spark, sf_dir)))))


@register(f"WITH {_LONG} SELECT group_key, t, {', '.join(f"max(CASE WHEN slot = {k} THEN v END) AS s{k}" for k in range(6))} FROM cur GROUP BY 1, 2")
def group_wide_null_fill(spark, sf_dir):
    return groups.wide(groups.current(groups.long_form(_group_rows(spark, sf_dir))), ["group_key"], range(6))


@register(f"""WITH {_GROUP}, l AS (SELECT group_key, t, seq, unnest(CASE WHEN len(slots) > 0 THEN slots ELSE range(0, len(v)) END) AS slot, unnest(v) AS v FROM g)
SELECT group_key, slot::INT AS slot, t, CASE WHEN NOT isnan(v) THEN v END AS v FROM (SELECT *, row_number() OVER (PARTITION BY group_key, slot, t ORDER BY seq DESC, v DESC) AS rn FROM l WHERE slot IS NOT NULL AND v IS NOT NULL) WHERE rn = 1""")
def group_merge_overlap(spark, sf_dir):
    return finite(groups.current(groups.long_form(_group_rows(spark, sf_dir)), overwrite_with_null=False))


def _members(spark, sf_dir):
    rows = _group_rows(spark, sf_dir)
    named = groups.members(rows)
    own = rows.groupBy("group_key").agg(F.any_value("group_labels").alias("group_labels"))
    return named.join(own, "group_key")


_MEMBERS = f"""{_GROUP}, p AS (SELECT group_key, group_labels, seq, lsets, slots, unnest(range(1, len(lsets) + 1)) AS pos FROM g WHERE len(lsets) > 0),
q AS (SELECT group_key, group_labels, seq, coalesce(slots[pos], pos - 1) AS slot, lsets[pos] AS labels FROM p),
m AS (SELECT group_key, slot, any_value(group_labels) AS group_labels, arg_min(labels, seq) AS labels FROM q GROUP BY 1, 2)"""


@register(f"""WITH {_MEMBERS} SELECT group_key, slot::INT AS slot, {_TEXT('labels')} AS member FROM m WHERE (coalesce(group_labels['region'], '') = 'reg-north' OR coalesce(labels['region'], '') = 'reg-north')
AND (regexp_full_match(coalesce(group_labels['__name__'], ''), '.*_(pct|c)') OR regexp_full_match(coalesce(labels['__name__'], ''), '.*_(pct|c)'))""")
def group_members_match(spark, sf_dir):
    chosen = groups.select_members(_members(spark, sf_dir), [Eq("region", "reg-north"), Re("__name__", ".*_(pct|c)")])
    return chosen.select("group_key", "slot", L.text(F.col("labels")).alias("member"))


@register(f"""WITH {_MEMBERS} SELECT group_key, slot::INT AS slot, '{{' || array_to_string(list_transform(list_sort(list_concat(list_filter(map_entries(group_labels), lambda e: NOT list_contains(map_keys(labels), e.key)), map_entries(labels))), lambda e: e.key || '=' || e.value), ',') || '}}' AS full_labels FROM m""")
def group_full_labels(spark, sf_dir):
    chosen = groups.select_members(_members(spark, sf_dir), [lambda labels: F.lit(True)])
    return chosen.select("group_key", "slot", L.text(F.col("full_labels")).alias("full_labels"))


# Benchmark shapes


def _bench(spark, sf_dir, metrics, hosts, days, by):
    names = Eq("__name__", metrics[0]) if len(metrics) == 1 else Re("__name__", "|".join(metrics))
    where = [names] if hosts is None else [names, Eq("hostname", hosts[0]) if len(hosts) == 1 else Re("hostname", "|".join(hosts))]
    rows = scan.select(registrations(spark, sf_dir), samples(spark, sf_dir), where, T0 + (45 - days) * DAY, T0 + 46 * DAY)
    return aggregate.bucketed(rows, DAY, by).select(*[F.col(c).alias(c.strip("_")) for c in by], "bucket", "max_v", "n")


def _bench_sql(metrics, hosts, days, by):
    where = [f"labels['__name__'] IN ({', '.join(repr(m) for m in metrics)})", f"t BETWEEN {T0 + (45 - days) * DAY} AND {T0 + 46 * DAY}", "v IS NOT NULL"]
    where += [f"labels['hostname'] IN ({', '.join(repr(h) for h in hosts)})"] if hosts else []
    keys = "".join(f"labels['{b}'] AS {b.strip('_')}, " for b in by)
    return f"WITH {_SERIES}, {_LIVE} SELECT {keys}t // {DAY} * {DAY} AS bucket, max(v) AS max_v, count(*) AS n FROM live JOIN series USING (series_id) WHERE {' AND '.join(where)} GROUP BY {', '.join(str(i + 1) for i in range(len(by) + 1))}"


def _add_bench(name, metrics, hosts, days, by):
    def query(spark, sf_dir):
        return _bench(spark, sf_dir, metrics, hosts, days, by)

    query.__name__ = name
    register(_bench_sql(metrics, hosts, days, by))(query)


for _m, _h, _d in [(1, 1, 1), (1, 1, 12), (1, 1, 24), (1, 8, 1), (5, 1, 1), (5, 1, 12), (5, 1, 24), (5, 8, 1)]:
    _add_bench(f"tsbs_{_m}_{_h}_{_d}", METRICS[:_m], HOSTS[:_h], _d, ["__name__", "hostname"])
_add_bench("tsbs_1_1_all", METRICS[:1], HOSTS[:1], 46, ["__name__", "hostname"])
_add_bench("tsbs_5_1_all", METRICS, HOSTS[:1], 46, ["__name__", "hostname"])


@register(f"""WITH {_SERIES}, {_LIVE}, a AS (SELECT labels['hostname'] AS hostname, t // {DAY} * {DAY} AS bucket, avg(v) AS avg_v, count(*) AS n FROM live JOIN series USING (series_id)
WHERE labels['__name__'] = 'cpu_busy_pct' AND v IS NOT NULL GROUP BY 1, 2) SELECT hostname, bucket, {digits_sql("avg_v", 11)} AS avg_v, n FROM a""")
def tsbs_double_groupby_1(spark, sf_dir):
    """Averages of all readings, infinite ones included, to 11 significant digits."""
    rows = scan.select(registrations(spark, sf_dir), samples(spark, sf_dir), [Eq("__name__", "cpu_busy_pct")])
    return finite(aggregate.bucketed(rows, DAY, ["hostname"], "avg").withColumn("avg_v", digits("avg_v", 11)), "avg_v")


def _high(spark, sf_dir, hosts):
    where = [Eq("__name__", "cpu_busy_pct"), *([Eq("hostname", hosts[0])] if hosts else [])]
    return scan.select(registrations(spark, sf_dir), samples(spark, sf_dir), where).where("v > 50 AND NOT isnan(v)").select("series_id", "t", "v")


@register(f"{_FROM} WHERE labels['__name__'] = 'cpu_busy_pct' AND labels['hostname'] = 'node-shared' AND v > 50")
def tsbs_high_cpu_1(spark, sf_dir):
    return _high(spark, sf_dir, HOSTS[:1])


@register(f"{_FROM} WHERE labels['__name__'] = 'cpu_busy_pct' AND v > 50")
def tsbs_high_cpu_all(spark, sf_dir):
    return _high(spark, sf_dir, None)


@register(f"WITH {_LIVE} SELECT series_id, max(t) AS t, arg_max(coalesce(v, 'nan'::DOUBLE), t) AS v FROM live WHERE v IS NOT NULL GROUP BY 1")
def lastpoint(spark, sf_dir):
    return aggregate.last_points(merge.last_write_wins(samples(spark, sf_dir), ["series_id", "t"], ["seq"]).where("v IS NOT NULL AND NOT isnan(v)"))


@register(f"WITH {_LIVE} SELECT series_id, min(t) AS t, arg_min(v, t) AS v FROM live WHERE v IS NOT NULL AND t >= {T0 + 20 * DAY} GROUP BY 1")
def seek_first_ge(spark, sf_dir):
    live = merge.last_write_wins(samples(spark, sf_dir), ["series_id", "t"], ["seq"]).where("v IS NOT NULL AND NOT isnan(v)")
    return scan.seek(live, T0 + 20 * DAY)


@register("SELECT series_id, min(t) AS min_t, max(t) AS max_t, count(*) AS samples FROM samples_in GROUP BY 1")
def series_time_bounds(spark, sf_dir):
    return catalog.time_bounds(samples(spark, sf_dir))


@register("SELECT t // 7200000 * 7200000 AS p_start, count(*) AS samples, count(DISTINCT series_id) AS series, min(t) AS min_t, max(t) AS max_t FROM samples_in GROUP BY 1")
def block_stats(spark, sf_dir):
    return catalog.partition_stats(scan.with_partition(samples(spark, sf_dir), 7_200_000))


@register("""WITH b AS (SELECT id AS block, mint AS min_t, maxt + 1 AS max_t FROM query_in), o AS (SELECT *, max(max_t) OVER (ORDER BY min_t, max_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR min_t >= reach THEN 1 ELSE 0 END) OVER (ORDER BY min_t, max_t ROWS UNBOUNDED PRECEDING) AS island FROM o),
w AS (SELECT *, count(*) OVER (PARTITION BY island) AS k, min(block) OVER (PARTITION BY island) AS first_block FROM i) SELECT first_block, block, min_t, max_t FROM w WHERE k > 1""")
def overlapping_blocks(spark, sf_dir):
    return intervals.overlapping_blocks(table(spark, sf_dir, "query_in").select(F.col("id").alias("block"), F.col("mint").alias("min_t"), (F.col("maxt") + 1).alias("max_t")))


def _partitions(spark, sf_dir):
    return scan.with_partition(samples(spark, sf_dir), DAY).select(F.col("p_start").alias("time_boundary"), F.lit(DAY).cast("bigint").alias("time_interval")).distinct()


_PARTITIONS = f"(SELECT DISTINCT t // {DAY} * {DAY} AS time_boundary, {DAY}::BIGINT AS time_interval FROM samples_in)"


@register(f"SELECT * FROM {_PARTITIONS} WHERE time_boundary <= {T0 + 9 * DAY} AND time_boundary + time_interval > {T0 + 4 * DAY + 5}")
def overlapping_partitions(spark, sf_dir):
    return intervals.overlapping_partitions(_partitions(spark, sf_dir), T0 + 4 * DAY + 5, T0 + 9 * DAY)


@register(f"SELECT * FROM {_PARTITIONS} WHERE time_boundary + time_interval > {T0 + 30 * DAY + 7}")
def purge_partitions(spark, sf_dir):
    return intervals.purge_partitions(_partitions(spark, sf_dir), T0 + 30 * DAY + 7)


@register(f"SELECT series_id, max(t) AS max_t FROM samples_in GROUP BY 1 HAVING max(t) > {T0 + 30 * DAY}")
def purge_series(spark, sf_dir):
    return intervals.purge_series(catalog.time_bounds(samples(spark, sf_dir)), T0 + 30 * DAY).select("series_id", "max_t")


def _tombs(spark, sf_dir):
    asked = table(spark, sf_dir, "query_in")
    first = asked.selectExpr("id AS series_id", "mint AS min_t", "mint + (maxt - mint) div 4 AS max_t")
    return first.unionByName(asked.selectExpr("id AS series_id", "mint + (maxt - mint) div 5 AS min_t", "mint + (maxt - mint) div 2 AS max_t"))


_TOMBS = "tombs AS (SELECT id AS series_id, mint AS min_t, mint + (maxt - mint) // 4 AS max_t FROM query_in UNION ALL SELECT id, mint + (maxt - mint) // 5, mint + (maxt - mint) // 2 FROM query_in)"


@register(f"WITH {_TOMBS} SELECT id, t, CASE WHEN NOT isnan(v) THEN v END AS v FROM query_samples q WHERE NOT EXISTS (SELECT 1 FROM tombs x WHERE x.series_id = q.id AND q.t BETWEEN x.min_t AND x.max_t)")
def tombstone_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "query_samples").withColumnRenamed("id", "series_id")
    return finite(intervals.delete(rows, _tombs(spark, sf_dir)).select(F.col("series_id").alias("id"), "t", "v"))


@register("SELECT id AS series_id, mint AS min_t, mint + (maxt - mint) // 2 AS max_t FROM query_in")
def interval_add_coalesce(spark, sf_dir):
    return intervals.coalesce_intervals(_tombs(spark, sf_dir))


@register("SELECT id, mint + (maxt - mint) // 2 >= mint + 3 * step_ms AS inside FROM query_in")
def interval_subrange(spark, sf_dir):
    arrays = intervals.coalesce_intervals(_tombs(spark, sf_dir)).groupBy("series_id").agg(F.collect_list(F.struct("min_t", "max_t")).alias("i"))
    asked = table(spark, sf_dir, "query_in").join(arrays, F.col("id") == F.col("series_id"))
    return asked.select("id", intervals.is_subrange(F.col("i"), F.col("mint"), F.col("mint") + 3 * F.col("step_ms")).alias("inside"))


# Labels, times, wire, codec


@register(f"WITH {_SERIES} SELECT series_id, {_TEXT('labels')} AS labels FROM series")
def label_string(spark, sf_dir):
    return series(spark, sf_dir).select("series_id", L.text(F.col("labels")).alias("labels"))


@register(f"""WITH {_SERIES} SELECT {_TEXT("map_from_entries(list_filter(map_entries(labels), lambda e: e.key IN ('region', 'os')))")} AS by_labels, count(*) AS n FROM series GROUP BY 1""")
def label_hash_by(spark, sf_dir):
    own = L.only(F.col("labels"), ["region", "os"])
    return series(spark, sf_dir).groupBy(L.identity(own).alias("h")).agg(F.min(L.text(own)).alias("by_labels"), F.count(F.lit(1)).alias("n")).drop("h")


@register(f"""WITH {_SERIES} SELECT {_TEXT("map_from_entries(list_filter(map_entries(labels), lambda e: e.key NOT IN ('hostname', 'instance', '__name__')))")} AS rest, count(*) AS n FROM series GROUP BY 1""")
def label_hash_without(spark, sf_dir):
    own = L.without(F.col("labels"), ["hostname", "instance"])
    return series(spark, sf_dir).groupBy(L.identity(own).alias("h")).agg(F.min(L.text(own)).alias("rest"), F.count(F.lit(1)).alias("n")).drop("h")


@register(f"""WITH {_SERIES} SELECT series_id, {_TEXT("map_from_entries(list_concat(list_filter(map_entries(labels), lambda e: e.key <> 'team'), CASE WHEN list_contains(map_keys(labels), 'rack') THEN [] ELSE [{'key': 'rack', 'value': 'none'}] END))")} AS labels FROM series""")
def label_add_del(spark, sf_dir):
    changed = L.drop(L.add(F.col("labels"), "rack", "none"), "team")
    return series(spark, sf_dir).select("series_id", L.text(changed).alias("labels"))


@register("""WITH s AS (SELECT DISTINCT coalesce(labels['region'], '') AS region, coalesce(labels['os'], '') AS os FROM series_in)
SELECT a.region AS region, CASE WHEN a.region < 'reg-north' THEN -1 WHEN a.region = 'reg-north' THEN 0 ELSE 1 END AS order_ FROM (SELECT DISTINCT region FROM s) a""")
def label_compare(spark, sf_dir):
    region = F.coalesce(F.try_element_at("labels", F.lit("region")), F.lit(""))
    own = series(spark, sf_dir).select(region.alias("region")).distinct()
    return own.select("region", L.compare(F.create_map(F.lit("region"), "region"), F.create_map(F.lit("region"), F.lit("reg-north"))).alias("order_"))


@register("SELECT series_id, t, t // 1800000 * 1800000 AS floor_t, t // 1800000 * 1800000 + 1800000 AS end_t FROM (SELECT DISTINCT series_id, t FROM samples_in)")
def partition_floor_ceiling(spark, sf_dir):
    return samples(spark, sf_dir).select("series_id", "t").distinct().select("series_id", "t", timeutil.partition_floor("t", 1_800_000).alias("floor_t"), timeutil.partition_end("t", 1_800_000).alias("end_t"))


@register("SELECT series_id, min(seq) AS first_seq, row_number() OVER (ORDER BY min(seq), series_id) AS new_id FROM samples_in GROUP BY 1")
def series_id_assignment(spark, sf_dir):
    first = samples(spark, sf_dir).groupBy("series_id").agg(F.min("seq").alias("first_seq"))
    return dense_ids(first, ["first_seq", "series_id"], "new_id")


@register("SELECT seq, t, len(v)::INT AS n, v[1] AS first_v FROM group_in WHERE len(slots) >= 0")
def wire_insert_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "group_in").select("seq", F.to_json(F.struct(F.lit(1).alias("type"), "lsets", "slots", "t", "v")).alias("value"))
    return wire.parse_inserts(rows, keep=["seq"]).select("seq", "t", F.size("v").alias("n"), F.get("v", F.lit(0)).alias("first_v"))


@register(f"WITH {_SERIES}, {_LIVE} SELECT series_id, labels['hostname'] AS hostname, t, v FROM live JOIN series USING (series_id) WHERE labels['__name__'] = 'board_temp_c' AND v IS NOT NULL AND isfinite(v)")
def wire_query_encode(spark, sf_dir):
    where, mint, maxt, metric = wire.parse_query('{"matchers": {"__name__": "board_temp_c"}, "mint": 0, "maxt": 9000000000000}')
    rows = scan.select(registrations(spark, sf_dir), samples(spark, sf_dir), where, mint, maxt).where(F.abs("v") < float("inf"))
    back = wire.decode_results(wire.encode_results(rows, metric))
    return back.select("series_id", aggregate.label("hostname").alias("hostname"), "t", "v")


@register("SELECT id, t, CASE WHEN NOT isnan(v) THEN v END AS v FROM query_samples")
def codec_round_trip(spark, sf_dir):
    blocks = table(spark, sf_dir, "query_samples").groupBy("id", F.expr(f"t div {DAY}").alias("day")).agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("s"))
    back = blocks.select("id", codec.encoded(F.col("s")).alias("b")).select("id", F.explode(codec.decoded(F.col("b"))).alias("p"))
    return finite(back.select("id", "p.t", "p.v"))


@register("""SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS min_v, max(l_extendedprice) AS max_v, round(avg(l_extendedprice), 4) AS avg_v, round(stddev_pop(l_extendedprice), 4) AS stddev_v,
quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.9) AS p90, quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1""")
def histogram_percentiles(spark, sf_dir):
    return aggregate.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]).withColumns({c: F.round(c, 4) for c in ("avg_v", "stddev_v")})


@register(f"SELECT series_id, t, v FROM (SELECT *, row_number() OVER (PARTITION BY series_id, t ORDER BY seq DESC) AS rn FROM samples_in WHERE series_id = 7 AND t = {T0 + 43}) WHERE rn = 1")
def kv_point_get(spark, sf_dir):
    return finite(scan.point_get(samples(spark, sf_dir), 7, T0 + 43))


@register("SELECT series_id, t, CASE WHEN NOT isnan(v) THEN v END AS v, seq FROM samples_in WHERE (series_id > 1000 OR (series_id = 1000 AND t >= 0)) AND series_id < 2000")
def kv_range_reverse(spark, sf_dir):
    return finite(scan.key_range(samples(spark, sf_dir), (1000, 0), (2000, 0), reverse=True))


@register("SELECT (event_id * 16777216 + user_id) AS ref, event_id AS series_id, user_id AS chunk_no, epoch_us(ts) // 1000 AS t FROM events")
def chunk_ref_pack(spark, sf_dir):
    ref = timeutil.pack_chunk(F.col("event_id"), F.col("user_id"))
    rows = table(spark, sf_dir, "events").select(ref.alias("ref"), timeutil.millis(F.col("ts")).cast("bigint").alias("t"))
    sid, chunk = timeutil.unpack_chunk(F.col("ref"))
    return rows.select("ref", sid.alias("series_id"), chunk.alias("chunk_no"), "t")


# Store and streams


def _fresh(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _late_store(spark, sf_dir, batches: int = 4, snapshot: int | None = None) -> Store:
    """All samples in batches of equal spans of ``seq``, the order of arrival, so what is late or rewritten later comes in a later batch; compacted in place."""
    store = Store(spark, _fresh(spark, "store"), 30 * DAY)
    series(spark, sf_dir).withColumn("label_key", L.label_key(F.col("labels"))).withColumn("batch", F.lit(0).cast("bigint")).write.parquet(store.root + "/series")
    rows = samples(spark, sf_dir)
    arrived = F.coalesce("seq", F.lit(0))
    low, high = rows.agg(F.min(arrived), F.max(arrived)).first()
    edges = [(low or 0) + ((high or 0) - (low or 0) + 1) * k // batches for k in range(1, batches)]
    for k in range(batches):
        after = arrived >= edges[k - 1] if k else F.lit(True)
        store.append(rows.where(after & (arrived < edges[k] if k < batches - 1 else F.lit(True))), k)
    store.compact(1, snapshot)  # every partition, also those that one batch filled
    return store


@register(f"WITH {_LIVE}, t AS (SELECT DISTINCT series_id FROM series_in WHERE labels['__name__'] = 'probe_ok_pct') SELECT series_id, t, v FROM live JOIN t USING (series_id)")
def ooo_late_append(spark, sf_dir):
    """One metric out of a store that took in all samples as they arrived."""
    return finite(_late_store(spark, sf_dir).query([Eq("__name__", "probe_ok_pct")]).select("series_id", "t", "v"))


@register(f"WITH {_LIVE}, t AS (SELECT DISTINCT series_id FROM series_in) SELECT series_id, t, v FROM live JOIN t USING (series_id)")
def ooo_late_append_all(spark, sf_dir):
    """Everything out of that store."""
    return finite(_late_store(spark, sf_dir).query([lambda labels: F.lit(True)]).select("series_id", "t", "v"))


@register(f"WITH l AS (SELECT id AS series_id, t, v FROM query_samples) SELECT series_id, t, count(*) AS n FROM l GROUP BY 1, 2")
def stream_ingest(spark, sf_dir):
    """Files that arrive as a stream into a store, a few per micro-batch; every row is stored once."""
    store, arriving = Store(spark, _fresh(spark, "store"), 30 * DAY), _fresh(spark, "arriving")
    table(spark, sf_dir, "query_samples").repartition(4).write.parquet(arriving)
    stream = ingest.file_stream(spark, arriving, "id bigint, t bigint, v double", 2).selectExpr("id AS series_id", "t", "v", "t AS seq")
    ingest.into_store(stream, store, _fresh(spark, "stream")).awaitTermination()
    return store.samples().groupBy("series_id", "t").agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {_MEMBERS}, named AS (SELECT group_key, slot, '{{' || array_to_string(list_transform(list_sort(list_concat(list_filter(map_entries(group_labels), lambda e: NOT list_contains(map_keys(labels), e.key)), map_entries(labels))), lambda e: e.key || '=' || e.value), ',') || '}}' AS labels FROM m),
l AS (SELECT group_key, t, seq, unnest(CASE WHEN len(slots) > 0 THEN slots ELSE range(0, len(v)) END) AS slot, unnest(v) AS v FROM g)
SELECT labels, t, CASE WHEN NOT isnan(v) THEN v END AS v FROM (SELECT labels, t, v, row_number() OVER (PARTITION BY labels, t ORDER BY seq DESC, v DESC NULLS LAST) AS rn FROM l JOIN named USING (group_key, slot)) WHERE rn = 1""")
def group_ingest(spark, sf_dir):
    """Group inserts in two batches into a store, the second by slots of members that the first named, and read again."""
    store = Store(spark, _fresh(spark, "store"), 30 * DAY)
    rows = table(spark, sf_dir, "group_in")
    store.add_groups(rows.where("size(lsets) > 0"), 0)
    store.add_groups(rows.where("size(lsets) = 0"), 1)
    everything = store.query([lambda labels: F.lit(True)], at=None)
    return finite(everything.select(L.text(F.col("labels")).alias("labels"), "t", "v"))
