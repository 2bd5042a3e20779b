"""Document fingerprints: homomorphic multiset hash of paragraphs; DataFrame functions only.

A paragraph's wide vector has two parts. ``exact``: 16 lanes of 32 bits
expanded from its SHA-512. ``sketch``: 63 lanes that count, for each bit, the
blocks of the paragraph whose hash has that bit. A block is up to five words,
dealt out from the start of each clause, so that an edit moves the blocks of its own
clause only. A document's fingerprint
is the sum over its paragraphs, modulo 2^32 and 2^20. Sums do not depend on
order, equal multisets of paragraphs have equal sums, and paragraphs can be
added to or taken from a fingerprint without the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import unused

LANES = 16
LANE = (1 << 32) - 1
#: Three counters of 20 bits share a long; the bit above each stays clear, so sums cannot run over.
FIELDS, STEP = 3, 21
COUNT = (1 << 20) - 1
ONES = sum(1 << STEP * i for i in range(FIELDS))
CLEAR = sum(COUNT << STEP * i for i in range(FIELDS))
#: Up to five words of a clause.
BLOCK = r"[^\x09-\x0D\x20.,;:!?|]+(?:[\x20\x09]+[^\x09-\x0D\x20.,;:!?|]+){0,4}"
TYPE = "struct<exact:array<bigint>,sketch:array<bigint>,n:bigint>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside a lambda a plain expression is computed at each mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _exact(paragraphs: Column) -> Column:
    zero = F.array_repeat(F.lit(0).cast("long"), LANES)

    def step(acc: Column, p: Column) -> Column:
        lanes = _let(F.sha2(p, 512), lambda digest: F.array(*[F.xxhash64(digest, F.lit(i)).bitwiseAND(F.lit(LANE)) for i in range(LANES)]))
        return F.zip_with(acc, lanes, lambda a, b: (a + b).bitwiseAND(F.lit(LANE)))

    return F.aggregate(paragraphs, zero, step)


def _sketch(hashes: Column) -> Column:
    names = [f"c{j}" for j in range(STEP)]
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in names])

    def step(acc: Column, h: Column) -> Column:
        return F.struct(*[(acc[c].bitwiseAND(F.lit(CLEAR)) + F.shiftright(h, j).bitwiseAND(F.lit(ONES))).alias(c) for j, c in enumerate(names)])

    return F.aggregate(hashes, zero, step, lambda acc: F.array(*[acc[c].bitwiseAND(F.lit(CLEAR)) for c in names]))


def fingerprint(text: Column) -> Column:
    """Struct (exact, sketch, n): n is the number of blocks. Null counts as the empty text, one empty paragraph."""
    body = F.coalesce(text, F.lit(""))
    hashes = F.transform(F.regexp_extract_all(body, F.lit(BLOCK), F.lit(0)), lambda b: F.xxhash64(b))
    return _let(hashes, lambda h: F.struct(_exact(F.split(body, "\n", -1)).alias("exact"), _sketch(h).alias("sketch"), F.size(h).cast("long").alias("n")))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the union of two multisets of paragraphs, or with ``sign=-1`` of a without b."""
    exact = F.zip_with(a["exact"], b["exact"], lambda x, y: (x + F.lit(sign) * y).bitwiseAND(F.lit(LANE)))
    guard = F.lit(sum(1 << STEP * i + 20 for i in range(FIELDS)))
    # with the guard bits set, no field borrows from the next one
    sketch = F.zip_with(a["sketch"], b["sketch"], lambda x, y: ((x.bitwiseOR(guard) - y) if sign < 0 else x + y).bitwiseAND(F.lit(CLEAR)))
    return F.struct(exact.alias("exact"), sketch.alias("sketch"), (a["n"] + F.lit(sign) * b["n"]).alias("n"))


def as_string(fp: Column) -> Column:
    """Hexadecimal digits of all lanes."""
    exact = F.transform(fp["exact"], lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    sketch = F.transform(fp["sketch"], lambda x: F.lpad(F.lower(F.hex(x)), 16, "0"))
    return F.array_join(F.concat(exact, sketch), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of the two multisets of blocks, 0 to 1; 1 for equal fingerprints, 0 if one has no words."""

    def signed(fp: Column) -> Column:
        fields = lambda x: F.array(*[F.shiftright(x, STEP * i).bitwiseAND(F.lit(COUNT)) for i in range(FIELDS)])
        return F.transform(F.flatten(F.transform(fp["sketch"], fields)), lambda c: (c * 2 - fp["n"]).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    def cosine_of(v: Column) -> Column:
        norm = F.sqrt(dot(v["x"], v["x"]) * dot(v["y"], v["y"]))
        return F.when(norm > 0, dot(v["x"], v["y"]) / norm).otherwise(F.lit(0.0))

    cosine = _let(F.struct(signed(a).alias("x"), signed(b).alias("y")), cosine_of)
    return F.when(a["exact"] == b["exact"], F.lit(1.0)).otherwise(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(0.0)))


def _bucket(key: Column, splits: list[int]) -> Column:
    """Number of splits below ``key`` (null: 0), found in two steps of about the square root of their number."""
    if not splits:
        return F.lit(0)
    width = max(1, int(len(splits) ** 0.5))
    table = F.lit(splits)
    heads = F.lit(splits[::width])
    group = F.size(F.filter(heads, lambda s: s < key))
    inside = F.size(F.filter(F.slice(table, F.greatest((group - 1) * width, F.lit(0)) + 1, width), lambda s: s < key))
    return F.when(key.isNull() | (group == 0), 0).otherwise((group - 1) * width + inside)


def with_next(docs: DataFrame, key: str, text: str, carry: list[str], rows_per_bucket: int = 1500, most_buckets: int = 1 << 15) -> DataFrame:
    """``docs`` with ``_next`` (struct of ``text`` and ``carry``) of the row that follows in descending ``key`` order.

    Nulls come last, ties are ordered by text, and the first row follows the
    last. Rows are dealt by ranges of the key (``most_buckets`` quantiles at
    most, the only thing that reaches the driver); each range also gets the
    first row of the next one, so one shuffle serves and no task sees the
    whole table. Beyond that many ranges each holds more rows, which the
    window sorts on disk; none is left out. Keys are integers.
    """
    n = docs.select(F.count(F.lit(1))).first()[0]
    parts = min(most_buckets, max(1, n // rows_per_bucket))
    splits: list[int] = []
    if parts > 1:
        probabilities = [i / parts for i in range(1, parts)]
        got = docs.select(F.percentile_approx(F.col(key).cast("long"), F.lit(probabilities), F.lit(4 * parts)).alias("q")).first()[0]
        splits = sorted(set(got or []))
    bucket, seen, last = (unused(docs, c) for c in ("b", "seen", "k"))
    own = docs.withColumn(bucket, _bucket(F.col(key), splits)).withColumn(seen, F.lit(0))
    first = own.groupBy(bucket).agg(F.max(key).alias(last)).collect()  # a row per bucket
    if not first:
        return own.withColumn("_next", F.struct(F.col(text), *carry)).drop(bucket, seen)
    first = sorted(first, key=lambda r: -r[bucket])
    send = [(r[last], above[bucket], 1) for above, r in zip(first, first[1:], strict=False)] + [(first[0][last], first[-1][bucket], 2)]
    guests = docs.sparkSession.createDataFrame(send, f"{last} long, {bucket} int, {seen} int")  # most_buckets rows at most
    copies = docs.join(F.broadcast(guests), F.col(key).cast("long").eqNullSafe(F.col(last)))
    order = [F.when(F.col(seen) == 2, 1).otherwise(0), F.col(key).desc_nulls_last(), F.col(text).asc_nulls_first()]
    w = Window.partitionBy(bucket).orderBy(*order)
    out = own.unionByName(copies.drop(last)).withColumn("_next", F.lead(F.struct(F.col(text), *carry)).over(w))
    return out.filter(F.col(seen) == 0).drop(bucket, seen)


def compare_with_edit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last third (rounded down, code points) replaced by
    the first as many, or all, of the next document in descending key order.
    Null text counts as empty; repeated rows each give a row, in the order of
    their texts; null keys come last. Extra columns are not read; an empty
    table gives an empty result; very long texts are read whole.
    """
    body = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    body = body.withColumn("fp", fingerprint(F.col("text")))
    rows = with_next(body, "key", "text", ["fp"])
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    rows = rows.withColumn("n_chars", size.cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), size - third), F.substring(F.col("_next.text"), F.lit(1), third)))
    rows = rows.withColumn("edited_fp", fingerprint(F.col("edited")))
    return rows.select(
        F.col("key").alias(key), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("fp")).alias("fingerprint"), as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("_next.fp")).alias("near_next"),
    )


def op8_multiset_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_edit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
