"""Queries for the problems 1 and 6 to 10 over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm import distinct, mixing, packing, percentiles, runs, splitting, tokens
from tideline.operators import blocks, readings
from tideline.plans.problems import READINGS_SQL
from tideline.session import cut_lineage, written
from tideline.sources.tables import table

P = 12  # registers per sketch, as a power of two: one standard error is 1.2 %
CONTAINERS = ("container", "container_small")
COMBINED = ["region", "service", "team"]
PAIRED = ["region", "service", "team", "os", "arch", "datacenter", "service_environment", "service_version", "rack", "__name__"]  # all but hostname and instance, which nearly name a series


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(series_id, days)``: the days with rows of each series. What the join with tags needs, reduced in the map tasks and shuffled once."""
    rows = table(spark, sf_dir, "samples_in").where("series_id IS NOT NULL AND t IS NOT NULL")
    return rows.groupBy("series_id").agg(F.collect_set(readings.day().cast("int")).alias("days"))


def _by_day(active: DataFrame, *keys: str) -> DataFrame:
    return active.select("series_id", *keys, F.explode("days").alias("day_no"))


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(series_id, tags)``: the tags of each series, each once."""
    tags = table(spark, sf_dir, "series_tags").where("series_id IS NOT NULL")
    return tags.groupBy("series_id").agg(F.collect_set(F.struct("name", "value")).alias("tags"))


def _stated(counts: DataFrame) -> DataFrame:
    """Counts with their relative standard error and the bound of their absolute error."""
    return counts.withColumn("rel_error", F.lit(round(distinct.relative_error(P), 5))).withColumn("error_bound", distinct.error_bound(F.col("estimate"), P))


def _day_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(series_id, day_no, name, value)``, each once."""
    both = _active(spark, sf_dir).join(_tags(spark, sf_dir), "series_id")
    return _by_day(both.select("series_id", "days", F.inline("tags")), "name", "value")


def p1_day_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stated(distinct.distinct_counts(_day_tags(spark, sf_dir), ["day_no", "name", "value"], "series_id", P))


def p1_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per week and tag value, from the stored sketches of the days: what daily counts cannot tell."""
    keys = ["name", "value"]
    daily = written(distinct.pack(distinct.registers(_day_tags(spark, sf_dir), ["day_no", *keys], "series_id", P), ["day_no", *keys]))
    weekly = daily.withColumn("week", F.floor(F.col("day_no") / 7).cast("int"))
    merged = distinct.merge(distinct.unpack(weekly, ["week", *keys]), ["week", *keys])
    return _stated(distinct.estimate(distinct.pack(merged, ["week", *keys]), P))


def p1_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "series_tags").where(F.col("name").isin(COMBINED))
    wide = tags.groupBy("series_id").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in COMBINED])
    keys = ["day_no", *COMBINED]
    return _stated(distinct.combinations(distinct.registers(_by_day(_active(spark, sf_dir).join(wide, "series_id", "left"), *COMBINED), keys, "series_id", P), keys, P))


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day and pair of values of two tag names, for every two of ``PAIRED``.

    On the way tags are 64-bit hashes of name and value, as a row per series, day and pair is shuffled; names and values
    come back with the counts.
    """
    code = lambda name, value: F.xxhash64(name, value)
    paired = F.filter("tags", lambda x: x["name"].isin(PAIRED))
    sets = _tags(spark, sf_dir).select("series_id", F.transform(paired, lambda x: F.struct(x["name"].alias("name"), code(x["name"], x["value"]).alias("h"))).alias("tags"))
    first = _active(spark, sf_dir).join(sets, "series_id").select("series_id", "days", "tags", F.explode("tags").alias("x"))
    pairs = first.select("series_id", "days", F.col("x.h").alias("a"), F.explode(F.expr("transform(filter(tags, y -> y.name > x.name), y -> y.h)")).alias("b"))
    counts = distinct.distinct_counts(_by_day(pairs, "a", "b"), ["day_no", "a", "b"], "series_id", P)
    names = table(spark, sf_dir, "series_tags").where(F.col("name").isin(PAIRED)).select("name", "value").distinct().withColumn("h", code(F.col("name"), F.col("value")))
    for side in ("a", "b"):
        own = names.select(F.col("name").alias(f"name_{side}"), F.col("value").alias(f"value_{side}"), F.col("h").alias(side))
        counts = counts.join(own, side).drop(side)
    return _stated(counts)


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stated(distinct.distinct_counts(table(spark, sf_dir, "series_tags"), ["name"], "value", P))


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = percentiles.from_blocks(blocks.blocks(table(spark, sf_dir, "samples_in")))
    return percentiles.group_percentiles(parts, table(spark, sf_dir, "series_tags"), "series_id", ["name", "value"], (0.5, 0.9, 0.99))


def p6_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from partial results: sorted blocks of the even days and of the odd days, stored by themselves and put together."""
    rows = table(spark, sf_dir, "samples_in")
    stored = [written(percentiles.from_blocks(blocks.blocks(rows.where(F.pmod(readings.day(), F.lit(2)) == k)))) for k in (0, 1)]
    return percentiles.group_percentiles(stored[0].unionByName(stored[1]), table(spark, sf_dir, "series_tags"), "series_id", ["name", "value"], (0.5, 0.9, 0.99))


def _with_tol(spark: SparkSession, sf_dir: str, squared: bool = False, rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """The readings in blocks, with ``same_tol`` of their metric as ``tol``, or four times its square."""
    limits = readings.series_limits(table(spark, sf_dir, "series_in"), table(spark, sf_dir, "metric_ref"))
    tol = 4 * F.col("same_tol") * F.col("same_tol") if squared else F.col("same_tol")
    return blocks.blocks(table(spark, sf_dir, "samples_in"), limits.select("series_id", tol.alias("tol")), ["tol"], rows, min(rows, blocks.MARGIN))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse(_with_tol(spark, sf_dir).where("tol IS NOT NULL"), min_run=3).select("series_id", "t_start", "t_end")


def p7_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse(_with_tol(spark, sf_dir)).select("series_id", "t_start", "n", "duration_ms")


def p7_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse(_with_tol(spark, sf_dir, True), 3, 0.0, 1.0)


def p7_any_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by level that are there with blocks of one size and not with another: none."""
    keys = ["series_id", "t_start", "t_end", "n"]
    found = [cut_lineage(runs.collapse(_with_tol(spark, sf_dir, True, rows), 3, 0.0, 1.0).select(*keys)) for rows in (blocks.BLOCK_ROWS, 50)]
    either = found[0].join(found[1], keys, "left_anti").unionByName(found[1].join(found[0], keys, "left_anti"))
    return either.agg(F.count(F.lit(1)).alias("different"))


def _documents(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return tokens.with_tokens(table(spark, sf_dir, "documents"), list(keep))


def _limit(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    row = table(spark, sf_dir, "size_limits").where(F.col("limit_name") == name).select("max_tokens", "overlap_tokens").first()
    return row.max_tokens, row.overlap_tokens


def _packed(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    sized = cut_lineage(_documents(spark, sf_dir, "doc_id"))
    out = [packing.pack(sized, "doc_id", "tokens", _limit(spark, sf_dir, n)[0]).withColumn("limit_name", F.lit(n)) for n in names]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, *CONTAINERS)


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut_lineage(_documents(spark, sf_dir, "doc_id", "source"))
    return mixing.mix(sized, table(spark, sf_dir, "source_targets"), "doc_id", "source", "tokens")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_mixed(spark, sf_dir), table(spark, sf_dir, "source_targets"), "source", "tokens")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit, overlap = _limit(spark, sf_dir, "piece")
    return splitting.split_oversized(table(spark, sf_dir, "documents"), "doc_id", limit, overlap)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("piece_no = 0").select("doc_id")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


# What must hold of results that SQL cannot produce, worked out over whole results; SQL states it, and where it can the exact figures.


def _within(exact: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Exact counts by key, and whether the estimate lies within its bound of them."""
    known = exact.select(*[F.col(k).alias(f"_{k}") for k in keys], "exact")
    match = [counts[k].eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = known.join(counts, match, "left")
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.col("error_bound")
    return both.select(*[F.col(f"_{k}").alias(k) for k in keys], "exact", F.coalesce(near, F.lit(False)).alias("within_error"))


def p1_within_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label name, the exact number of values and whether the estimate is as near as stated."""
    exact = table(spark, sf_dir, "series_tags").where("value IS NOT NULL").groupBy("name").agg(F.count_distinct("value").alias("exact"))
    return _within(exact, p1_values(spark, sf_dir), ["name"])


def p1_day_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = _day_tags(spark, sf_dir).groupBy("day_no", "name", "value").agg(F.count_distinct("series_id").alias("exact"))
    return _within(exact, p1_day_tags(spark, sf_dir), ["day_no", "name", "value"])


def p1_week_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = _day_tags(spark, sf_dir).withColumn("week", F.floor(F.col("day_no") / 7).cast("int"))
    exact = weekly.groupBy("week", "name", "value").agg(F.count_distinct("series_id").alias("exact"))
    return _within(exact, p1_weeks(spark, sf_dir), ["week", "name", "value"])


def p1_combination_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact counts of every combination of days and the three tags, rolled-up ones told by ``level``."""
    tags = table(spark, sf_dir, "series_tags").where(F.col("name").isin(COMBINED))
    wide = tags.groupBy("series_id").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in COMBINED])
    keys = ["day_no", *COMBINED]
    rows = _by_day(_active(spark, sf_dir).join(wide, "series_id", "left"), *COMBINED)
    exact = rows.cube(*keys).agg(F.count_distinct("series_id").alias("exact"), F.grouping_id().cast("int").alias("level"))
    return _within(exact, p1_combinations(spark, sf_dir), [*keys, "level"])


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container size: containers over capacity, documents split though they fit, tokens lost or doubled, and whether
    there are at most 1 % and one more containers than needed at least."""
    packed = cut_lineage(p8_pack(spark, sf_dir))
    limits = table(spark, sf_dir, "size_limits").select("limit_name", F.col("max_tokens").cast("bigint").alias("most"))
    per_container = packed.groupBy("limit_name", "container").agg(F.sum("size").alias("n")).join(limits, "limit_name")
    over = per_container.groupBy("limit_name").agg(F.count_if(F.col("n") > F.col("most")).alias("overfull"), F.count(F.lit(1)).alias("containers"))
    bounds = [packing.least_containers(packed.where(F.col("limit_name") == n), "size", _limit(spark, sf_dir, n)[0]).withColumn("limit_name", F.lit(n)) for n in CONTAINERS]
    over = over.join(bounds[0].unionByName(bounds[1]), "limit_name").withColumn("close_packed", F.col("containers") <= 1.01 * F.col("least") + 1).drop("containers", "least")
    placed = packed.groupBy("limit_name", "id").agg(F.sum("size").alias("n"), F.count_distinct("part").alias("parts"))
    sizes = F.array(*[F.struct(F.lit(n).alias("limit_name"), F.lit(_limit(spark, sf_dir, n)[0]).alias("most")) for n in CONTAINERS])
    asked = _documents(spark, sf_dir, "doc_id").where("tokens > 0").select(F.col("doc_id").alias("id"), "tokens", F.inline(sizes))
    wanted = asked.join(placed, ["limit_name", "id"], "left")
    split = F.count_if((F.col("tokens") <= F.col("most")) & (F.col("parts") > 1))
    lost = F.sum(F.abs(F.col("tokens") - F.coalesce("n", F.lit(0))))
    return over.join(wanted.groupBy("limit_name").agg(split.alias("split_needlessly"), lost.alias("tokens_off")), "limit_name")


def p8_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packing by characters, which SQL can count: documents, parts, characters, least containers."""
    sized = table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").cast("bigint").alias("size"))
    out = []
    for name in CONTAINERS:
        most = _limit(spark, sf_dir, name)[0]
        packed = cut_lineage(packing.pack(sized, "doc_id", "size", most))
        containers = packed.groupBy("container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("parts"))
        least = F.ceil(F.sum("used") / most)
        one = containers.agg(F.sum("parts").alias("parts"), F.sum("used").alias("chars"), least.alias("least"), (F.count(F.lit(1)) <= 1.02 * least + 1).alias("close_packed"), (F.max("used") <= most).alias("within"))
        out.append(one.withColumn("documents", packed.agg(F.count_distinct("id")).scalar()).withColumn("limit_name", F.lit(name)))
    return out[0].unionByName(out[1])


def _mixed_well(spark: SparkSession, sf_dir: str, sized: DataFrame, size: str) -> DataFrame:
    """Per target source: its size, the size wanted, the whole copies that all its documents have at least, and whether repeats
    keep to their limit and the size meets what is wanted within one document of the source."""
    targets = table(spark, sf_dir, "source_targets")
    chosen = cut_lineage(mixing.mix(sized, targets, "doc_id", "source", size))
    valid = sized.where((F.col(size) > 0) & F.col("source").isNotNull())
    own = valid.join(chosen.select("doc_id", "copies"), "doc_id", "left").groupBy("source").agg(
        F.sum(size).alias("have"), F.max(size).alias("largest"), F.min(F.coalesce("copies", F.lit(0))).alias("whole_copies"), F.max("copies").alias("most"), F.sum(F.col(size) * F.coalesce("copies", F.lit(0))).alias("got"))
    report = targets.join(own, "source", "left")  # a source without documents contributes nothing and is not missed
    total = report.agg(F.min(F.col("have") * F.col("max_repeats") / F.col("target_share"))).scalar()
    wanted = F.col("target_share") * total
    return report.select("source", "have", F.round(wanted, 3).alias("wanted"), "whole_copies", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"), F.coalesce(F.abs(F.col("got") - wanted) <= F.col("largest"), F.lit(True)).alias("share_met"))


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut_lineage(_documents(spark, sf_dir, "doc_id", "source"))
    return _mixed_well(spark, sf_dir, sized, "tokens").select("source", "repeats_kept", "share_met")


def p9_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mixing by characters, which SQL can count."""
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", F.char_length("text").cast("bigint").alias("size"))
    return _mixed_well(spark, sf_dir, sized, "size").where("have IS NOT NULL")


def p10_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces whose text, tokenized again, is over the limit or not what is stated; pieces that repeat less of the one before
    than wanted (a tenth of that is conceded, as pieces may be cut inside a run of letters); texts not covered to their ends."""
    limit, overlap = _limit(spark, sf_dir, "piece")
    pieces = cut_lineage(_pieces(spark, sf_dir))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").alias("chars"))
    ends = pieces.groupBy("doc_id").agg(F.min("start_char").alias("a"), F.max("end_char").alias("b")).join(texts, "doc_id")
    again = tokens.with_tokens(pieces.select("n_tokens", "piece"), ["n_tokens"], "piece")
    sizes = again.agg(F.count_if((F.col("tokens") > limit) | (F.col("tokens") != F.col("n_tokens"))).alias("too_large"))
    by_text = Window.partitionBy("doc_id").orderBy("piece_no")
    next_start = F.lead("start_char").over(by_text)
    repeated = pieces.withColumn("next", next_start).where("next IS NOT NULL").select(F.expr("substring(piece, next - start_char + 1, end_char - next)").alias("shared"))
    overlaps = tokens.with_tokens(repeated.withColumn("k", F.lit(0)), ["k"], "shared").agg(F.count_if(F.col("tokens") < 0.9 * overlap).alias("without_overlap"))
    return sizes.withColumns({"without_overlap": overlaps.scalar(), "uncovered": ends.agg(F.count_if((F.col("a") != 0) | (F.col("b") != F.col("chars")))).scalar()})


QUERIES = {f.__name__: f for f in (p1_day_tags, p1_weeks, p1_combinations, p1_pairs, p1_values, p6_percentiles, p6_from_days, p7_found, p7_collapsed, p7_levels, p7_any_blocks, p8_pack, p9_mix, p9_shares, p10_found, p10_pieces, p1_within_error, p1_day_error, p1_week_error, p1_combination_error, p8_invariants, p8_by_length, p9_invariants, p9_by_length, p10_invariants)}

_RUNS_SQL = f"""WITH {READINGS_SQL},
metric AS (SELECT series_id, min(labels['__name__']) AS metric_name FROM series_in GROUP BY 1),
tol AS (SELECT m.series_id, r.same_tol FROM metric m LEFT JOIN metric_ref r USING (metric_name)),
steps AS (SELECT series_id, t, v, same_tol, lag(v) OVER w AS p FROM readings LEFT JOIN tol USING (series_id) WINDOW w AS (PARTITION BY series_id ORDER BY t)),
runs AS (SELECT series_id, t, v, same_tol, sum(CASE WHEN p IS NOT NULL AND (abs(v - p) <= coalesce(same_tol, 0) OR v = p) AND NOT (isinf(v - p) OR (isnan(v - p) AND v <> p)) THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM steps),
spans AS (SELECT series_id, min(t) AS t_start, max(t) AS t_end, count(*) AS n, max(same_tol) AS tol FROM runs GROUP BY series_id, run)"""

_PERCENTILES_SQL = f"""WITH {READINGS_SQL}, tags AS (SELECT DISTINCT series_id, name, value FROM series_tags),
r AS (SELECT name, value, v, row_number() OVER (PARTITION BY name, value ORDER BY v) AS k, count(*) OVER (PARTITION BY name, value) AS n FROM readings JOIN tags USING (series_id))
SELECT name, value, max(n) AS n, max(CASE WHEN k = greatest(ceil(round(n * 0.5::DOUBLE, 9)), 1) THEN v END) AS p50,
max(CASE WHEN k = greatest(ceil(round(n * 0.9::DOUBLE, 9)), 1) THEN v END) AS p90, max(CASE WHEN k = greatest(ceil(round(n * 0.99::DOUBLE, 9)), 1) THEN v END) AS p99 FROM r GROUP BY 1, 2"""
_DAY_TAGS = """d AS (SELECT DISTINCT series_id, CAST(floor(t / 86400000.0) AS INT) AS day_no FROM samples_in WHERE series_id IS NOT NULL AND t IS NOT NULL),
s AS (SELECT DISTINCT series_id, name, value FROM series_tags WHERE series_id IS NOT NULL)"""

SQL = {
    "p7_any_blocks": "SELECT 0::BIGINT AS different",
    "p1_within_error": "SELECT name, count(DISTINCT value) AS exact, true AS within_error FROM series_tags WHERE value IS NOT NULL GROUP BY 1",
    "p1_day_error": f"WITH {_DAY_TAGS} SELECT day_no, name, value, count(DISTINCT series_id) AS exact, true AS within_error FROM d JOIN s USING (series_id) GROUP BY ALL",
    "p1_week_error": f"WITH {_DAY_TAGS} SELECT floor(day_no / 7)::INT AS week, name, value, count(DISTINCT series_id) AS exact, true AS within_error FROM d JOIN s USING (series_id) GROUP BY ALL",
    "p1_combination_error": f"""WITH {_DAY_TAGS}, w AS (SELECT series_id, {', '.join(f"max(CASE WHEN name = '{n}' THEN value END) AS {n}" for n in COMBINED)} FROM s GROUP BY 1)
SELECT day_no, {', '.join(COMBINED)}, grouping_id(day_no, {', '.join(COMBINED)})::INT AS level, count(DISTINCT series_id) AS exact, true AS within_error FROM d LEFT JOIN w USING (series_id) GROUP BY CUBE (day_no, {', '.join(COMBINED)})""",
    "p8_invariants": "SELECT limit_name, 0::BIGINT AS overfull, true AS close_packed, 0::BIGINT AS split_needlessly, 0::BIGINT AS tokens_off FROM size_limits WHERE limit_name LIKE 'container%'",
    "p8_by_length": """SELECT limit_name, count(*) AS documents, sum(ceil(len(text) / max_tokens::DOUBLE))::BIGINT AS parts, sum(len(text))::BIGINT AS chars, ceil(sum(len(text)) / max(max_tokens)::DOUBLE)::BIGINT AS least, true AS close_packed, true AS within
FROM documents, size_limits WHERE limit_name LIKE 'container%' AND len(text) > 0 GROUP BY 1""",
    "p9_by_length": """WITH h AS (SELECT source, sum(len(text))::BIGINT AS have FROM documents WHERE len(text) > 0 GROUP BY 1), x AS (SELECT *, min(have * max_repeats / target_share) OVER () AS total FROM source_targets JOIN h USING (source))
SELECT source, have, round(target_share * total, 3) AS wanted, floor(least(total * target_share / have, max_repeats) + 1e-9)::INT AS whole_copies, true AS repeats_kept, true AS share_met FROM x""",
    "p9_invariants": "SELECT source, true AS repeats_kept, true AS share_met FROM source_targets",
    "p10_invariants": "SELECT 0::BIGINT AS too_large, 0::BIGINT AS without_overlap, 0::BIGINT AS uncovered",
    "p6_percentiles": _PERCENTILES_SQL,
    "p6_from_days": _PERCENTILES_SQL,
    "p7_found": f"{_RUNS_SQL} SELECT series_id, t_start, t_end FROM spans WHERE n >= 3 AND tol IS NOT NULL",
    "p7_collapsed": f"{_RUNS_SQL} SELECT series_id, t_start, n, t_end - t_start AS duration_ms FROM spans",
}
