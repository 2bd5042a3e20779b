"""Quality classifier: compressed size under dictionaries of good and bad labelled text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import unused

#: Texts are compressed in pieces of so many bytes, so that the dictionary counts in all of a long text.
PIECE = 1024
#: Bounds of the sample that is fitted: documents a class, and code points a document.
MAX_DOCS, MAX_CHARS = 1500, 40_000
DICTIONARY = 1 << 16


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 4 == 2


@dataclass
class Model:
    """``weights`` are those of 1, the size difference and the log of the ratio; dictionaries are None if a class had no text."""

    good: bytes | None
    bad: bytes | None
    weights: tuple[float, float, float]


class Scorer:
    def __init__(self, model: Model, level: int = 3):
        self.weights, self.pair = model.weights, None
        if model.good and model.bad:
            self.pair = []
            for raw in (model.good, model.bad):
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                self.pair.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: str) -> tuple[float, float]:
        """Normalised difference of the two compressed sizes, and log of the ratio under the good dictionary (low for repeated text)."""
        data = text.encode("utf-8", "replace")
        if not data or self.pair is None:
            return 0.0, 0.0
        good, bad = (sum(len(z.compress(data[i : i + PIECE])) for i in range(0, len(data), PIECE)) for z in self.pair)
        return (bad - good) / (bad + good), math.log(good / len(data))

    def score(self, text: str | None) -> float:
        x = self.features(text or "")
        z = self.weights[0] + self.weights[1] * x[0] + self.weights[2] * x[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def dictionary(texts: list[str]) -> bytes | None:
    """Raw dictionary of ``DICTIONARY`` bytes: an equal share of lines from each text, in turn."""
    lines = [[x for x in t.split("\n") if x.strip()] for t in texts]
    lines = [x for x in lines if x]
    if not lines:
        return None
    share = max(200, DICTIONARY // len(lines))
    parts: list[bytes] = []
    total = 0
    for own in lines:
        piece = "\n".join(own).encode("utf-8", "replace")
        at = max(0, (len(piece) - share) // 2)
        parts.append(piece[at : at + share])
        total += share
        if total >= DICTIONARY:
            break
    return b"\n".join(parts)[-DICTIONARY:]


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float, float]:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> Model:
    """Fit on at most ``max_docs`` documents a class, the first in the order of a hash of the key.

    Rows that are held out, have no label or no text, or are longer than
    ``max_chars`` are not in the sample, which is all that reaches the driver;
    of several texts of one key the smallest counts.
    Every other document builds the dictionaries, the rest calibrates. If a
    class has no text, every score is 0.5.
    """
    rows = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    rows = rows.groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("_y"), F.min(label).alias("_z")).filter("_y = _z")
    order = F.xxhash64(F.col("_k"), F.lit("sample"))
    ids = [rows.filter(F.col("_y") == y).select("_k", "_y", order.alias("_o")).orderBy("_o", "_k").limit(max_docs) for y in (0, 1)]
    sample = ids[0].unionByName(ids[1])  # 2 * max_docs rows at most
    sizes = (F.length(text) > 0) & (F.length(text) <= max_chars)
    got = docs.filter(sizes).join(F.broadcast(sample), F.col(key) == F.col("_k")).groupBy("_k", "_y", "_o").agg(F.min(text).alias("_t")).collect()
    got = sorted(got, key=lambda r: (r["_o"], r["_k"]))
    teach, tune = got[::2], got[1::2]
    parts = [dictionary([r["_t"] for r in teach if r["_y"] == y]) for y in (1, 0)]
    model = Model(parts[0], parts[1], (0.0, 0.0, 0.0))
    if None in parts or not tune:
        return Model(None, None, (0.0, 0.0, 0.0))
    scorer = Scorer(model)
    x = np.array([(1.0, *scorer.features(r["_t"])) for r in tune])
    return Model(parts[0], parts[1], fit_weights(x, np.array([float(r["_y"]) for r in tune])))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if at least ``threshold``); columns of those names are replaced.

    The score uses the whole text alone, so equal texts have equal scores;
    null counts as empty, and an empty text gets the score of a size
    difference of 0. Very long texts are compressed whole, piece by piece; an
    empty table stays empty.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    own = unused(docs, "score")
    out = docs.select(*kept, run(F.col(text)).alias(own))
    return out.select(*kept, F.col(own).alias("score"), (F.col(own) >= threshold).cast("int").alias("predicted"))


def op7_compression_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
