"""Mix sources to target weights with hash-threshold histograms; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import unused
from .storage import Scratch, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: The hash has 32 bits; each level of the histogram looks at the next so many of them.
LEVELS = (12, 10, 10)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(key: Column, seed: str) -> Column:
    """32 bits of a keyed hash, as a long. Null keys share one value."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` from one row per source.

    Weights repeat over the sources in code-point order, null last. ``share``
    times all sizes is dealt out by weight; a source stops at ``most`` times
    its size and the excess is reshared. With the sources ordered by
    size/weight, those that stop are a prefix, so the level of the others is
    found with running sums instead of rounds. The windows see one narrow row a
    source and no document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    out = sizes.withColumn("weight", F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    out = out.withColumn("top", F.col("source_size") * most)
    order = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) * share - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumn("level", left / weights_left)
    # the level is right where the source at hand is the first that does not stop; later ones give lower levels
    fits = F.when(F.col("level") <= F.col("top") / F.col("weight"), F.col("level"))
    out = out.withColumn("level", F.max(fits).over(whole))
    target = F.when(F.col("level").isNull(), F.col("top")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("top")))
    return out.select("source", "source_size", target.alias("target"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def thresholds(rows: DataFrame, wanted: DataFrame, keep=materialize, levels: Sequence[int] = LEVELS) -> DataFrame:
    """Largest hash to take by source: ``source, cut`` (-1: none).

    ``rows`` has ``source, size, h``; ``wanted`` has ``source, rest`` with
    ``rest`` below the source's size. Sizes are summed by source and bucket of
    the leading bits; only the bucket in which the running sum passes
    ``rest`` is refined by the next bits. The last level has single hash
    values: the one at the boundary is taken if that comes nearer. A source
    has 4,096 buckets at most in a level, whatever it holds, so the window
    over its buckets is bounded.
    """
    shift = sum(levels)
    edge = wanted.select("source", F.col("rest"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    inside = rows.withColumn("prefix", F.lit(0).cast("long"))
    for bits in levels:
        shift -= bits
        e = edge.select(F.col("source").alias("_s"), F.col("prefix").alias("_p"), "rest", "below")
        step = inside.join(e, same(F.col("source"), F.col("_s")) & (F.col("prefix") == F.col("_p")))
        step = step.groupBy("source", "rest", "below", F.shiftright("h", shift).alias("prefix")).agg(F.sum("size").alias("sum"))
        w = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        step = step.withColumn("upto", F.col("below") + F.sum("sum").over(w))
        step = step.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("sum") <= F.col("rest")))
        step = step.withColumn("below", F.col("upto") - F.col("sum"))
        edge = keep(step.select("source", "rest", "prefix", "below", "sum"))
        inside = rows.withColumn("prefix", F.shiftright("h", shift))
    nearer = F.col("below") + F.col("sum") / 2 <= F.col("rest")
    return edge.select("source", F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("cut"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    scratch: Scratch | None = None,
) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken`` added.

    Every document is taken floor(target / source size) times; the rest of the
    target is filled with the documents whose hash is under the source's
    threshold, so a smaller budget always takes a subset. Null text has size
    0; null is a source of its own, listed last; rows with equal keys (null
    ones too) are taken together; an empty table stays empty. The result does
    not depend on partitioning. A hot source costs nothing extra: sums are
    combined before the shuffle and the thresholds are joined by AQE. Columns
    of the added names are replaced. The result reads small tables of
    ``scratch``, which may go once it is written.
    """
    keep = (scratch or Scratch()).keep
    added = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c not in added]
    h, name, full, cut = (unused(docs, c) for c in ("h", "source", "full", "cut"))
    sized = docs.select(*kept, word_count(F.col(text)).alias("size"), document_hash(F.col(key), seed).alias(h))
    slim = keep(sized.select(F.col(source).alias("source"), "size", F.col(h).alias("h")))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = keep(source_targets(sizes, weights, share, most))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("full", whole)
    wanted = targets.select("source", (F.col("target") - F.col("full") * F.col("source_size")).alias("rest")).filter("rest > 0")
    cuts = thresholds(slim, wanted, keep)
    plan = targets.alias("t").join(cuts.alias("c"), same(F.col("t.source"), F.col("c.source")), "left")
    plan = keep(plan.select(F.col("t.source").alias(name), "source_size", "target", F.col("full").alias(full), F.coalesce("cut", F.lit(-1).cast("long")).alias(cut)))
    out = sized.join(plan, same(F.col(source), F.col(name)), "left")
    copies = F.col(full) + F.when(F.col(h) <= F.col(cut), 1).otherwise(0)
    return out.select(*kept, "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def op4_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([5.0,2.0,1.0]::DOUBLE[], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS weight, 2.0::DOUBLE * source_size AS top FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(top) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT source, source_size, top, weight, max(CASE WHEN level <= top / weight THEN level END) OVER () AS level FROM l),
g AS (SELECT source, source_size, CASE WHEN level IS NULL THEN top ELSE least(level * weight, top) END AS target FROM t),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS full_ FROM g),
b AS (SELECT source, h, sum(size) AS sum_ FROM d GROUP BY source, h),
c AS (SELECT source, h, sum_, sum(sum_) OVER (PARTITION BY source ORDER BY h) AS upto FROM b)
SELECT d.doc_id, d.size, f.source_size, f.target,
    (d.size * (f.full_ + CASE WHEN c.upto - c.sum_ / 2 <= f.target - f.full_ * f.source_size AND f.target - f.full_ * f.source_size > 0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h
"""
