"""A selection of documents in which each source has its target share of all tokens."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLASSES_PER_OCTAVE = 4  # size classes; all documents of a class have the same inclusion probability
MOST_SOURCES = 10_000  # target sources, so that the plan per source is of bounded size
BUCKETS = 4096  # of Pareto ranks: only the documents of the bucket with the last selected one are put in order


def uniform(key: str, seed: int):
    """A number in (0, 1) from the key and the seed alone, so that a repeated task gives the same one."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(2**52)) + 0.5) / float(2**52)


def size_class(size: str):
    return F.floor(F.log2(F.col(size)) * CLASSES_PER_OCTAVE).cast("int")


def inclusion(classes: dict[int, tuple[int, int]], target: float, power: float) -> dict[int, float]:
    """Inclusion probability of each size class, ``min(1, c * 2^(power * class))``, with ``target`` as expected total size.

    ``classes`` has (documents, total size) by class. Larger documents get the higher probability, so that
    the total of a sample varies less than with equal probabilities.
    """
    k = np.array(sorted(classes))
    total = np.array([classes[i][1] for i in k], dtype=float)
    weight = 2.0 ** (power * k / CLASSES_PER_OCTAVE)
    if target >= total.sum():
        return {int(i): 1.0 for i in k}
    low, high = 0.0, 1.0 / weight.min()
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if (np.minimum(1, c * weight) * total).sum() < target else (low, c)
    return {int(i): float(p) for i, p in zip(k, np.minimum(1, high * weight), strict=True)}


def wanted_sizes(have: dict[str, int], targets: list[tuple[str, float, int]]) -> tuple[dict[str, tuple[float, int, float]], float]:
    """Of each usable source the size wanted, whole copies and what is wanted beyond them; and the total of all sizes.

    The total is the largest at which no source needs more than its allowed repeats. ``targets`` has share and repeats by source;
    a source without documents cannot contribute and does not limit the others.
    """
    usable = [(s, share, repeats) for s, share, repeats in targets if have.get(s) and share > 0 and repeats > 0]
    if not usable:
        return {}, 0.0
    total = min(have[s] * repeats / share for s, share, repeats in usable)
    out = {}
    for source, share, repeats in usable:
        copies = min(total * share / have[source], repeats)
        whole = int(copies + 1e-9)
        out[source] = (total * share, whole, max(0.0, (copies - whole) * have[source]))
    return out, total


def plan(stats: list[tuple[str, int, int, int]], targets: list[tuple[str, float, int]], power: float) -> tuple[list[tuple], float]:
    """Rows ``(source, class, whole copies, inclusion probability, size wanted beyond the whole copies)``, and the total.

    ``stats`` has documents and size by source and size class, ``targets`` as for :func:`wanted_sizes`.
    """
    by_source: dict[str, dict[int, tuple[int, int]]] = {}
    for source, k, n, size in stats:
        by_source.setdefault(source, {})[k] = (n, size)
    have = {s: sum(size for _, size in c.values()) for s, c in by_source.items()}
    rows, (sizes, total) = [], wanted_sizes(have, targets)
    for source, (_, whole, wanted) in sizes.items():
        chance = inclusion(by_source[source], wanted, power) if wanted > 0.5 else dict.fromkeys(by_source[source], 0.0)
        rows += [(source, k, whole, chance[k], wanted if wanted > 0.5 else 0.0) for k in by_source[source]]
    return rows, total


def mix(docs: DataFrame, targets: DataFrame, key: str, source: str, size: str, seed: int = 7, power: float = 0.5) -> DataFrame:
    """``(key, source, size, copies)`` of the selected documents; ``copies`` is how often each is to be used.

    ``targets`` has ``source, target_share, max_repeats``, a small table. The selection is as large as the
    repeats allow: the source that is scarcest against its share is used up. Each source first gives whole
    copies of all its documents, then a Pareto sample for the rest of its share: documents are ranked by the odds
    of a uniform number over the odds of their inclusion probability, which grows with size, and taken in
    that order until the size wanted is reached, so a source misses its share by less than one document. Of
    the ranks only counts per bucket are totalled; only the bucket at the limit is put in order. Documents
    of size 0 or NULL, and those of NULL or untargeted sources, are never selected. Keys are unique; of
    equal ranks the smaller key comes first.
    """
    spark = docs.sparkSession
    own = docs.where(F.col(source).isNotNull() & F.col(key).isNotNull() & (F.col(size) > 0)).select(key, source, size, size_class(size).alias("_class"))
    # One row per target source and size class: bounded by 4 classes per doubling of size, whatever the documents.
    listed = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    asked = [tuple(r) for r in listed.limit(MOST_SOURCES + 1).collect()]
    if len(asked) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    wanted = own.join(F.broadcast(listed.select(F.col("source").alias(source))), source, "left_semi")
    stats = [tuple(r) for r in wanted.groupBy(source, "_class").agg(F.count(F.lit(1)), F.sum(size)).collect()]
    rows, _ = plan(stats, asked, power)
    kind = dict(own.dtypes)[source]
    planned = spark.createDataFrame(rows, f"`{source}` {kind}, _class int, _whole int, _chance double, _wanted double")
    u, p = uniform(key, seed), F.col("_chance")
    odds = F.when(p >= 1, F.lit(0.0)).otherwise((u / (1 - u)) / (p / (1 - p)))
    ranked = own.join(F.broadcast(planned), [source, "_class"]).withColumn("_rank", F.when(p > 0, odds))
    bucket = F.floor(F.col("_rank") / (1 + F.col("_rank")) * BUCKETS).cast("int")
    ranked = ranked.withColumn("_bucket", bucket)
    # Sizes per bucket, a bounded table, give the bucket of each source in which the wanted size is reached.
    sizes = ranked.where("_bucket IS NOT NULL").groupBy(source, "_bucket").agg(F.sum(size).alias("_sum"), F.first("_wanted").alias("_wanted"))
    up_to = F.sum("_sum").over(Window.partitionBy(source).orderBy("_bucket"))
    reached_in = sizes.withColumn("_up_to", up_to).where("_up_to >= _wanted AND _up_to - _sum < _wanted")
    limits = reached_in.select(source, F.col("_bucket").alias("_border"), (F.col("_up_to") - F.col("_sum")).alias("_before"))
    # One row per target source. A source whose wanted size is never reached takes all it ranked.
    placed = ranked.join(F.broadcast(limits), source, "left")
    before_border = F.col("_border").isNull() | (F.col("_bucket") < F.col("_border"))
    none = F.col("_bucket").isNull() | (F.col("_wanted") <= 0) | (F.col("_bucket") > F.col("_border"))
    sure = placed.withColumn("_taken", F.when(none, 0).when(before_border, 1))
    border = sure.where("_taken IS NULL")
    in_bucket = Window.partitionBy(source, "_bucket").orderBy("_rank", key)
    reached = F.col("_before") + F.sum(size).over(in_bucket)
    # Taken as long as the total comes nearer to the size wanted.
    border = border.withColumn("_taken", F.when(reached - F.col(size) / 2 <= F.col("_wanted"), 1).otherwise(0))
    copies = F.col("_whole") + F.col("_taken")
    out = sure.where("_taken IS NOT NULL").unionByName(border)
    return out.select(key, source, size, copies.cast("int").alias("copies")).where("copies > 0")


def shares(selection: DataFrame, targets: DataFrame, source: str, size: str) -> DataFrame:
    """``(source, target_share, actual_share, total_size, documents, most_copies)`` of every target source."""
    used = selection.groupBy(F.col(source).alias("source")).agg(F.sum(F.col(size) * F.col("copies")).alias("total_size"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    report = targets.select("source", "target_share").join(used, "source", "left").na.fill(0, ["total_size", "documents", "most_copies"])
    whole = report.agg(F.sum("total_size").alias("whole")).select("whole")
    return report.withColumn("actual_share", F.coalesce(F.try_divide("total_size", whole.scalar()), F.lit(0.0))).select("source", "target_share", "actual_share", "total_size", "documents", "most_copies")
