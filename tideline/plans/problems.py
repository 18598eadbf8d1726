"""Queries for the general problems 2 to 5 over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import grid, keyagg, rolling, spikes
from tideline.plans.rounding import digits, digits_sql
from tideline.sources.tables import table


def _implausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible(*[table(spark, sf_dir, n) for n in ("samples_in", "series_in", "metric_ref")])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _implausible(spark, sf_dir).select("series_id", "t")


def p2_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _implausible(spark, sf_dir)


def p2_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _implausible(spark, sf_dir).where("out_of_bounds").select("series_id", "t", "v")


def p2_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _implausible(spark, sf_dir).where("stuck").select("series_id", "t", "v")


def _trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.trailing(rolling.daily_totals(table(spark, sf_dir, "samples_in"))).withColumn("day_no", F.col("day_no").cast("int"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trailing(spark, sf_dir).where("n_7 = 0").select("series_id", "day_no")


def p3_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lambda c: F.when(F.abs(c) < float("inf"), F.round(c, 5) + 0.0).alias(c)
    return _trailing(spark, sf_dir).select("series_id", "day_no", "n_7", kept("sum_7"), "n_30", kept("sum_30"))


def p3_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and averages of both periods. Infinite ones stay infinite, ``nan_p`` tells opposite infinities from no readings."""
    rounded = lambda c: F.when(~F.isnan(c), digits(c, 11) + 0.0).alias(c)
    rolled = _trailing(spark, sf_dir)
    columns = [x for p in (7, 30) for x in (f"n_{p}", rounded(f"sum_{p}"), rounded(f"avg_{p}"), F.isnan(f"sum_{p}").alias(f"nan_{p}"))]
    return rolled.select("series_id", "day_no", *columns)


def _regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.regular(table(spark, sf_dir, "query_in"), table(spark, sf_dir, "query_samples"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regular(spark, sf_dir).where("state <> 'read'").select("id", "slot_t")


def p4_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regular(spark, sf_dir).select("id", "slot_t", F.round("v", 6).alias("v"), "n", "state")


def _tag_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyagg.eager_totals(table(spark, sf_dir, "series_tags"), table(spark, sf_dir, "samples_in"), "series_id", ["name", "value"], "v")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyagg.frequent(_tag_totals(spark, sf_dir), 0.02).where("value IS NOT NULL").select("name", "value")


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.when(~F.isnan("pair_sum"), digits("pair_sum", 11)).alias("pair_sum")
    return _tag_totals(spark, sf_dir).select("name", "value", "left_rows", "pair_rows", "pair_values", kept, "pair_min", "pair_max")


QUERIES = {"p2_found": p2_found, "p2_faults": p2_faults, "p2_bounds": p2_bounds, "p2_stuck": p2_stuck, "p3_found": p3_found, "p3_rolling": p3_rolling, "p3_averages": p3_averages, "p4_found": p4_found, "p4_grid": p4_grid, "p5_found": p5_found, "p5_totals": p5_totals}

READINGS_SQL = """readings AS (
  SELECT series_id, t, v FROM (
    SELECT series_id, t, v, row_number() OVER (PARTITION BY series_id, t ORDER BY seq DESC, v DESC NULLS LAST) AS rn FROM samples_in
    WHERE series_id IS NOT NULL AND t IS NOT NULL)
  WHERE rn = 1 AND v IS NOT NULL AND NOT isnan(v))"""

_DAILY_SQL = f"""WITH {READINGS_SQL},
daily AS (SELECT series_id, CAST(floor(t / 86400000.0) AS INT) AS day_no, count(*) AS n, sum(v) AS total FROM readings GROUP BY ALL),
span AS (SELECT series_id, min(day_no) AS a, max(day_no) AS b FROM daily GROUP BY 1),
calendar AS (SELECT series_id, CAST(unnest(range(a, b + 1)) AS INT) AS day_no FROM span)"""

_ROUNDED_SQL = lambda x, c: f"({digits_sql(x, 11)}) + 0.0 AS {c}"
_TRAILING_SQL = lambda p: f"n_{p}, {_ROUNDED_SQL(f'sum_{p}', f'sum_{p}')}, {_ROUNDED_SQL(f'(CASE WHEN n_{p} > 0 THEN sum_{p} / n_{p} END)', f'avg_{p}')}, isnan(sum_{p}) AS nan_{p}"

_LIMITED_SQL = f"""WITH {READINGS_SQL},
metric AS (SELECT series_id, min(labels['__name__']) AS metric_name FROM series_in GROUP BY 1),
limited AS (SELECT r.series_id, t, v, min_value, max_value, same_tol FROM readings r LEFT JOIN metric USING (series_id) LEFT JOIN metric_ref USING (metric_name))"""

_SLOTS_SQL = """WITH valid AS (SELECT id, t, max(v) AS v, count(*) AS m FROM query_samples WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1, 2),
slots AS (SELECT id, mint, step_ms, maxt, unnest(range(0, (maxt - mint) // step_ms + 1)) AS slot FROM query_in),
inside AS (SELECT s.id, (s.t - q.mint) // q.step_ms AS slot, s.t, s.v, s.m FROM valid s JOIN query_in q ON s.id = q.id AND s.t BETWEEN q.mint AND q.maxt),
occ AS (SELECT id, slot, min(t) AS ft, arg_min(v, t) AS fv, max(t) AS lt, arg_max(v, t) AS lv, sum(m)::BIGINT AS n FROM inside GROUP BY 1, 2),
cells AS (SELECT s.id, s.slot, s.mint + s.slot * s.step_ms AS slot_t, 5 * s.step_ms AS gap, o.n, o.lv,
  last_value(o.lt IGNORE NULLS) OVER w AS pt, last_value(o.lv IGNORE NULLS) OVER w AS pv,
  first_value(o.ft IGNORE NULLS) OVER x AS nt, first_value(o.fv IGNORE NULLS) OVER x AS nv
  FROM slots s LEFT JOIN occ o ON o.id = s.id AND o.slot = s.slot
  WINDOW w AS (PARTITION BY s.id ORDER BY s.slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY s.id ORDER BY s.slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""

_TAGS_SQL = f"""WITH t AS (SELECT series_id, name, value, count(*) AS m FROM series_tags GROUP BY ALL),
s AS (SELECT series_id, count(*) AS r_n, count(CASE WHEN NOT isnan(v) THEN 1 END) AS r_v, sum(CASE WHEN NOT isnan(v) THEN v END) AS r_sum, min(CASE WHEN NOT isnan(v) THEN v END) AS r_min, max(CASE WHEN NOT isnan(v) THEN v END) AS r_max FROM samples_in GROUP BY 1)
SELECT name, value, sum(m)::BIGINT AS left_rows, coalesce(sum(m * r_n), 0)::BIGINT AS pair_rows, coalesce(sum(m * r_v), 0)::BIGINT AS pair_values,
{digits_sql("sum(m * r_sum)", 11)} AS pair_sum, min(r_min) AS pair_min, max(r_max) AS pair_max
FROM t LEFT JOIN s USING (series_id) GROUP BY 1, 2"""

SQL = {
    "p2_bounds": f"{_LIMITED_SQL} SELECT series_id, t, v FROM limited WHERE v < min_value OR (v > max_value AND NOT isnan(max_value))",
    "p2_stuck": f"""{_LIMITED_SQL}, steps AS (SELECT *, lag(v) OVER w IS NULL AS first, coalesce(isfinite(v) AND isfinite(lag(v) OVER w) AND abs(v - lag(v) OVER w) <= same_tol, false) AS same FROM limited WINDOW w AS (PARTITION BY series_id ORDER BY t)),
runs AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM steps),
long AS (SELECT *, count(*) OVER (PARTITION BY series_id, run) AS length FROM runs),
lively AS (SELECT series_id, count(*) AS n, count(CASE WHEN NOT first AND NOT same THEN 1 END) AS moved, count(CASE WHEN same AND length < 10 THEN 1 END) AS still FROM long GROUP BY 1)
SELECT series_id, t, v FROM long JOIN lively USING (series_id) WHERE length >= 10 AND moved >= n / 2 AND moved >= 0.7 * (moved + still)""",
    "p3_found": f"""{_DAILY_SQL} SELECT c.series_id, c.day_no FROM calendar c
WHERE NOT EXISTS (SELECT 1 FROM daily d WHERE d.series_id = c.series_id AND d.day_no BETWEEN c.day_no - 6 AND c.day_no)""",
    "p3_rolling": f"""{_DAILY_SQL}, r AS (SELECT c.series_id, c.day_no,
  coalesce(sum(CASE WHEN d.day_no > c.day_no - 7 THEN n END), 0)::BIGINT AS n_7, coalesce(sum(CASE WHEN d.day_no > c.day_no - 7 THEN total END), 0) AS sum_7,
  coalesce(sum(n), 0)::BIGINT AS n_30, coalesce(sum(total), 0) AS sum_30
  FROM calendar c LEFT JOIN daily d ON d.series_id = c.series_id AND d.day_no BETWEEN c.day_no - 29 AND c.day_no GROUP BY 1, 2)
SELECT series_id, day_no, n_7, CASE WHEN isfinite(sum_7) THEN round(sum_7, 5) + 0.0 END AS sum_7, n_30, CASE WHEN isfinite(sum_30) THEN round(sum_30, 5) + 0.0 END AS sum_30 FROM r""",
    "p3_averages": f"""{_DAILY_SQL}, r AS (SELECT c.series_id, c.day_no,
  coalesce(sum(CASE WHEN d.day_no > c.day_no - 7 THEN n END), 0)::BIGINT AS n_7, coalesce(sum(CASE WHEN d.day_no > c.day_no - 7 THEN total END), 0) AS sum_7,
  coalesce(sum(n), 0)::BIGINT AS n_30, coalesce(sum(total), 0) AS sum_30
  FROM calendar c LEFT JOIN daily d ON d.series_id = c.series_id AND d.day_no BETWEEN c.day_no - 29 AND c.day_no GROUP BY 1, 2)
SELECT series_id, day_no, {_TRAILING_SQL(7)}, {_TRAILING_SQL(30)} FROM r""",
    "p4_found": f"{_SLOTS_SQL} SELECT id, slot_t FROM cells WHERE n IS NULL",
    "p4_grid": f"""{_SLOTS_SQL}, out AS (SELECT id, slot_t, coalesce(n, 0) AS n,
  CASE WHEN n IS NOT NULL THEN 'read' WHEN pt IS NULL AND nt IS NULL THEN 'none' WHEN pt IS NULL THEN 'before' WHEN nt IS NULL THEN 'after' WHEN nt - pt <= gap THEN 'filled' ELSE 'gap' END AS state,
  CASE WHEN n IS NOT NULL THEN lv WHEN pt IS NULL THEN CASE WHEN nt - slot_t <= gap THEN nv END WHEN nt IS NULL THEN CASE WHEN slot_t - pt <= gap THEN pv END
  WHEN nt - pt <= gap AND isfinite(pv) AND isfinite(nv) THEN pv + (nv - pv) * ((slot_t - pt)::DOUBLE / (nt - pt)) END AS v FROM cells)
SELECT id, slot_t, round(v, 6) AS v, n, state FROM out""",
    "p5_found": """SELECT name, value FROM (SELECT name, value, count(*) AS n FROM series_tags GROUP BY 1, 2)
WHERE value IS NOT NULL AND n >= 0.02::DOUBLE * (SELECT count(*) FROM series_tags)""",
    "p5_totals": _TAGS_SQL,
}
