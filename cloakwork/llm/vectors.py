"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import Scratch, materialize

#: Bound of the sample that the rotation is learnt from; every vector is indexed.
MAX_SAMPLE = 8192
BITS = 64


def learn_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal directions turned so that the signs of the projections lose least.

    Alternates between the signs under the present rotation and the rotation
    that fits those signs best (orthogonal Procrustes).
    """
    mean = sample.mean(axis=0)
    x = sample - mean
    bits = min(bits, x.shape[1])
    _, _, directions = np.linalg.svd(x, full_matrices=False)
    bits = min(bits, len(directions))
    p = directions[:bits].T
    v = x @ p
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, p @ r


def random_rotation(size: int, bits: int = BITS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) for vectors of a length that has too few in the sample."""
    q, _ = np.linalg.qr(np.random.default_rng((seed, size)).normal(size=(size, min(bits, size))))
    return np.zeros(size), q


def tables_for(rows: int, least: float = 0.93, recall: float = 0.99) -> tuple[int, int]:
    """(tables, bits of each): a table is wide enough to hold about one other vector of ``rows`` in a bucket.

    A bit of two vectors with cosine ``least`` differs with a chance of
    angle / pi under a random rotation, less under a learnt one, so wider
    tables find fewer of them and more tables are needed.
    """
    width = max(8, min(31, math.ceil(math.log2(max(2, rows))) + 1))
    same = (1 - math.acos(least) / math.pi) ** width
    return math.ceil(math.log(1 - recall) / math.log(1 - same)), width


def planes(sample: np.ndarray | None, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) to codes of ``bits`` bits, from as many rotations as it takes, learnt if there is a sample."""
    parts, seed = [], 7
    while sum(p.shape[1] for _, p in parts) < bits:
        parts.append(random_rotation(size, seed=seed) if sample is None else learn_rotation(sample, seed=seed))
        seed += 1
    return parts[0][0], np.hstack([p for _, p in parts])[:, :bits]


def codes_of(vector: Column, learnt: dict[int, tuple[np.ndarray, np.ndarray]], tables: int, width: int):
    """array<int>: the part of each table of the vector's code, under the rotations of its length, random ones where none are learnt."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = dict(learnt)
        powers = np.left_shift(np.int64(1), np.arange(width, dtype=np.int64))
        for s in batches:
            sizes = s.map(len).to_numpy()
            codes = np.zeros((len(s), tables), dtype=np.int32)
            for size in np.unique(sizes).tolist():
                if size not in known:
                    known[size] = planes(None, size, tables * width)
                mean, projection = known[size]
                x = np.array(s[sizes == size].tolist(), dtype="float64").reshape(-1, size)
                on = ((x - mean) @ projection >= 0).reshape(len(x), tables, width)
                codes[sizes == size] = (on * powers).sum(axis=2)
            yield pd.Series(list(codes))

    return run(vector)


def near_duplicates(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    least: float = 0.93, max_sample: int = MAX_SAMPLE,
) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row.

    Rows link if their labels are equal and not null, their vectors have one
    length and their cosine, in double precision, is at least ``least``. Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing. Equal
    vectors of a label are one class, whose size counts in n_links; only
    classes are compared. Codes are cut into the parts of ``tables_for``;
    pairs that agree in a part, and differ in no more bits overall than six
    standard deviations above the mean at ``least``, are tested exactly, each
    in the first part in which they agree. So no link below ``least`` is
    reported; recall is measured in the tests. A repeated key counts as several vectors of one
    node. Each length has a rotation of its own, a random one if the table is
    larger than the sample and fewer than ``BITS`` of that length are in it;
    an empty table gives an empty result.
    """
    scratch = Scratch()
    try:
        return _near_duplicates(rows, key, vector, label, least, max_sample, scratch)
    finally:
        scratch.clear()


def _near_duplicates(rows: DataFrame, key: str, vector: str, label: str, least: float, max_sample: int, scratch: Scratch) -> DataFrame:
    keep = scratch.keep
    base = rows.select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(vector).cast("array<double>").alias("v"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    base = base.withColumn("ok", F.coalesce(F.col("l").isNotNull() & fine & (F.size("v") > 0), F.lit(False)))
    base = base.withColumn("norm", F.when(F.col("ok"), norm))
    usable = base.filter(F.col("ok") & (F.col("norm") > 0) & (F.col("norm") < float("inf")))
    # -0.0 and 0.0 are the same component
    usable = usable.withColumn("v", F.transform("v", lambda x: x + 0.0)).withColumn("h", F.xxhash64("l", "v"))
    classes = keep(usable.groupBy("l", "v").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("norm").alias("norm"), F.first("h").alias("h")))
    classes = classes.withColumn("d", F.size("v"))
    per_label = classes.groupBy("l", "d").count().agg(F.max("count")).first()[0] or 0
    pick = classes.orderBy(F.xxhash64("rep"), "rep").limit(max_sample).select("v").collect()
    if not pick:
        return base.select(F.col("k").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"), F.lit(True).alias("kept"))
    tables, width = tables_for(per_label, least)
    bits = tables * width
    sample: dict[int, list] = {}
    for r in pick:
        sample.setdefault(len(r["v"]), []).append(r["v"])
    learnt = {}
    for size, vs in sample.items():
        if len(vs) >= BITS or len(pick) < max_sample:
            x = np.array(vs)
            learnt[size] = planes(x / np.linalg.norm(x, axis=1, keepdims=True), size, bits)
    unit = F.transform("v", lambda x: x / F.col("norm"))
    coded = keep(classes.withColumn("code", codes_of(unit, learnt, tables, width)))
    chance = math.acos(least) / math.pi
    farthest = math.ceil(bits * chance + 6 * math.sqrt(bits * chance * (1 - chance)))
    side = lambda r, c: coded.select("l", "d", F.col("rep").alias(r), F.col("code").alias(c), F.posexplode("code").alias("t", "p"))
    both = side("a", "ca").join(side("b", "cb"), ["l", "d", "t", "p"])
    before = lambda c: F.slice(c, F.lit(1), F.col("t"))
    earlier = F.exists(F.zip_with(before("ca"), before("cb"), lambda x, y: x == y), lambda x: x)
    differ = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    pairs = both.filter((F.col("a") < F.col("b")) & ~earlier & (differ <= farthest)).select("l", "d", "a", "b")
    own = coded.select("l", "d", "rep", "v", "norm", "n")
    full = pairs.join(own.select("l", "d", F.col("rep").alias("a"), F.col("v").alias("va"), F.col("norm").alias("na"), F.col("n").alias("size_a")), ["l", "d", "a"])
    full = full.join(own.select("l", "d", F.col("rep").alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb"), F.col("n").alias("size_b")), ["l", "d", "b"])
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    links = keep(full.filter(dot / (F.col("na") * F.col("nb")) >= least).select("a", "b", "size_a", "size_b"))
    ends = links.select(F.col("a").alias("rep"), F.col("size_b").alias("n")).unionByName(links.select(F.col("b").alias("rep"), F.col("size_a").alias("n")))
    other = ends.groupBy("rep").agg(F.sum("n").alias("others"))
    comp = components(links, scratch=scratch).withColumnRenamed("node", "rep")
    facts = keep(coded.select("l", "v", "rep", "n").join(other, "rep", "left").join(comp, "rep", "left").select("l", "v", "rep", "n", "others", "component"))
    joined = usable.select("k", "l", "v").join(facts, ["l", "v"]).select("k", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("c"))
    linkable = F.col("ok") & (F.col("norm") > 0) & (F.col("norm") < float("inf"))
    alone = base.filter(~F.coalesce(linkable, F.lit(False)))
    alone = alone.select("k", F.lit(0).cast("long").alias("links"), F.col("k").alias("c"))
    out = joined.unionByName(alone)
    return materialize(out.select(F.col("k").alias(key), F.col("links").cast("long").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("k") == F.col("c"), F.lit(True)).alias("kept")))


def op6_itq_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
