"""Exact Jaccard join of documents' five-word shingles by universe partition and pigeonhole.

Two sets with a Jaccard similarity of 3/4 differ in at most H = (|r|+|s|)/7
elements. Shingles are hashed into segments; sets that share more segments
than H can spoil agree on one of them. Each size band has its own number of
segments; a set indexes the content of each of its segments, and for some
segments also the contents with one element deleted, which lets those
tolerate one difference. How many segments a band has, and how many of those
get the deletions, is chosen by cost.

A signature's sets are its list. Each list first gives its first set with each
other one; verified, these pairs join most of a group of near copies. Lists
that still hold several components are then allocated by cost: a set's
segments tolerate more than they must, so it drops its longest lists up to
that slack, and a pair still meets in one list that both keep. The sets of
such lists are compared in blocks of bounded size, which give links only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .storage import Scratch, materialize, sized

WIDTH = 5
#: The similarity as a fraction.
NUM, DEN = 3, 4
#: Shingles of a block of sets that are compared with those of another block in one task.
BLOCK = 1_000_000
#: Pairs of sets whose parities are compared at once.
SLICE = 1_000_000
#: Bits of a signature within its bucket.
LOW_BITS = 38
#: Characters that are handled at once.
CHUNK = 2_000_000
REMEMBER = 500_000
_U = np.uint64
_C = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    """Hashes of words, made at the first look-up."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sets of 64-bit shingle hashes of texts. Words are split at ASCII white space; A-Z are lower-cased."""

    def __init__(self):
        self.hashes = _Hashes()

    def words(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split()
        return np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))

    def set(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; with fewer words than ``WIDTH``, one of the whole sequence; without words, none."""
        w = self.words(text or "")
        n = len(w)
        if not n:
            return w
        width = min(n, WIDTH)
        with np.errstate(over="ignore"):
            h = np.zeros(n - width + 1, dtype=np.uint64)
            for i in range(width):
                h += mix(w[i : n - width + 1 + i] + _C[i]) * _C[i]
            return np.unique(mix(h + _U(width)))


def edges_of_bands(largest: int) -> list[int]:
    """Upper sizes of the bands: similar sets are in one band or in neighbouring ones."""
    tops = [0, 1]
    while tops[-1] < largest:
        tops.append(max(tops[-1] + 1, tops[-1] * DEN // NUM))
    return tops


def differences(r: int, s: int) -> int:
    return (r + s) * (DEN - NUM) // (DEN + NUM)


def need(size: int, middle: int) -> int:
    """What a set's segments must tolerate in a group of two bands whose lower one ends at ``middle``, as the larger of a pair."""
    return differences(size, min(size, middle)) + 1


SIGMAS = 7


@lru_cache(maxsize=None)
def allocation(low: int, middle: int, top: int) -> tuple[int, int]:
    """(segments, those with deletions) of the group of bands with sizes ``low`` to ``top``.

    Costs are the expected signatures, those of a single shingle counting
    five times as they find more strangers. The tolerance must exceed what is
    needed by ``SIGMAS`` standard deviations at the smallest, middle and
    largest size, or all shingles are segments of their own (0, 0), which
    always suffices. A set whose own segments come out shorter is known to
    ``describe`` and compared otherwise (``short_pairs``).
    """
    best, chosen = 5.0 * (low + top) / 2, (0, 0)
    base = need(top, middle)
    step = max(1, base // 24)
    for t in [1, *range(max(2, base // 2), 4 * base + 8, step)]:
        for q in sorted({0, t // 2, t}):
            cost, fits = 0.0, True
            for x in (low, middle, top):
                p0 = (1 - 1 / t) ** x
                p1 = x / t * (1 - 1 / t) ** (x - 1)
                p2 = x * (x - 1) / 2 / t**2 * (1 - 1 / t) ** max(0, x - 2)
                one, two = 1 - p0, 2 - 2 * p0 - p1
                spread = (t - q) * (one - one**2) + q * (p1 + 4 * (1 - p0 - p1) - two**2)
                if (t - q) * one + q * two - SIGMAS * max(0.0, spread) ** 0.5 < need(x, middle):
                    fits = False
                    break
                cost += (t * one + q * (x / t - p1) + 4 * (t * p1 + q * 2 * p2)) / 3
            if fits and cost < best:
                best, chosen = cost, (t, q)
    return chosen




class Signer:
    """Signatures of a chunk of sets in the groups of bands they belong to."""

    def __init__(self):
        self.tops = edges_of_bands(1 << 16)

    def group(self, size: int, lower: bool) -> tuple[int, int, int, int, int] | None:
        """(group, segments, deletions, need, most) for the group that a set's band begins, or the one that it ends.

        ``need`` holds for the set as the larger of a pair, ``most`` for either.
        """
        while size * 2 > self.tops[-1]:
            self.tops = edges_of_bands(size * 4)
        band = int(np.searchsorted(self.tops, size))  # sizes tops[band-1]+1 .. tops[band]
        g = band - 1 if lower else band
        if g < 1:
            return None
        low, middle, top = self.tops[g - 1] + 1, self.tops[g], self.tops[g + 1]
        t, q = allocation(low, middle, top)
        other = min(size, middle) if lower else min(top, size * DEN // NUM)
        return g, t, q, need(size, middle), differences(size, other) + 1

    def _segments(self, sets: list[np.ndarray], lower: bool):
        """Of the sets that have a group: indexes, sizes, group, segments and deletions of each; shingles, their set and their segment."""
        info = [self.group(len(s), lower) if len(s) else None for s in sets]
        on = [i for i, x in enumerate(info) if x]
        sizes = np.array([len(sets[i]) for i in on], dtype=np.int64)
        facts = [np.array([info[i][k] for i in on], dtype=np.int64) for k in range(5)]
        h = np.concatenate([sets[i] for i in on]) if on else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(on)), sizes)
        g, t = facts[0], facts[1]
        with np.errstate(over="ignore"):
            seed = mix(g.astype(np.uint64) * _C[0] + _U(11))[doc]
            spread = np.maximum(t[doc], 1).astype(np.uint64)
            seg = (((mix(h ^ seed) >> _U(32)) * spread) >> _U(32)).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        return on, sizes, facts, h, doc, np.where(t[doc] == 0, np.arange(len(h)) - first[doc], seg)

    def tolerances(self, sets: list[np.ndarray], lower: bool) -> tuple[np.ndarray, np.ndarray]:
        """By set: what its segments tolerate beyond what any pair may need, and beyond what it needs as the larger one."""
        slack, short = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        on, sizes, (_, t, q, least, most), _, doc, seg = self._segments(sets, lower)
        if on:
            count = np.where(t == 0, sizes, t)
            at = np.cumsum(count) - count
            many = np.bincount(at[doc] + seg, minlength=int(count.sum()))
            owner = np.repeat(np.arange(len(on)), count)
            double = (np.arange(len(many)) - at[owner] < q[owner]) & (many >= 2)
            has = np.bincount(owner, (many > 0) + double.astype(np.int64), len(on)).astype(np.int64)
            slack[on], short[on] = has - most, has - least
        return slack, short

    def sign(self, sets: list[np.ndarray], lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of set, signature, weight), sorted by set. The weight is what a segment tolerates less if the signature is not looked up."""
        on, sizes, (g, t, q, _, _), h, doc, seg = self._segments(sets, lower)
        if not on:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            count = np.where(t == 0, sizes, t)
            key = (np.cumsum(count) - count)[doc] + seg
            order = np.argsort(key, kind="stable")
            key, u, doc, seg = key[order], mix(h[order] + _C[1]), doc[order], seg[order]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            total = np.add.reduceat(u, start)
            many = np.diff(np.r_[start, len(key)])
            d, s = doc[start], seg[start]
            # a segment that is one shingle has no number of its own
            salt = mix(g[d].astype(np.uint64) * _C[2] + np.where(t[d] == 0, 0, s + 1).astype(np.uint64) * _C[3])
            double = (s < q[d]) & (many >= 2)
            exact = mix(total + salt)
            part = np.repeat(np.arange(len(start)), many)
            more = double[part]
            deleted = mix(total[part[more]] - u[more] + salt[part[more]])
        docs, signatures = np.r_[d, doc[more]], np.r_[exact, deleted]
        weight = np.r_[np.where(double, 2, 1), np.ones(len(deleted), np.int64)].astype(np.uint64)
        order = np.argsort(docs, kind="stable")
        return np.array(on)[docs[order]], signatures[order], weight[order]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(ids, texts) of at most about ``CHUNK`` characters."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            t = t.as_py()
            ids.append(i)
            texts.append(t)
            size += len(t or "")
            if size >= CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def parities(s: np.ndarray) -> np.ndarray:
    """For each of 1024 hash classes, or as many as elements, whether the set has an odd number of its elements; 64 classes a long.

    Each class in which two sets differ takes a different element, so the
    number of such classes is a lower bound of the sets' difference. Halves
    can be folded, as a class is given by the lowest bits.
    """
    classes = max(1024, 1 << (len(s) - 1).bit_length()) if len(s) else 1024
    odd = np.bincount((s & _U(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd).view(np.int64)


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id, n, f1, f2, odd, slack0, slack1, short`` from columns doc_id and text.

    The set's size, a 128-bit sum over it, its parities, what its segments
    tolerate beyond need in the group that its band begins and in the one that
    it ends, and whether they tolerate less than the set needs.
    """
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("odd", pa.list_(pa.int64())), ("slack0", pa.int64()), ("slack1", pa.int64()), ("short", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(), Signer()
        for ids, texts in _chunks(batches):
            sets = [shingler.set(t) for t in texts]
            x = np.array([sums(s) for s in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            (slack0, short0), (slack1, short1) = (signer.tolerances(sets, lower) for lower in (False, True))
            columns = [ids, [len(s) for s in sets], x[:, 0], x[:, 1], [parities(s) for s in sets], slack0, slack1, (short0 < 0) | (short1 < 0)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, odd array<long>, slack0 long, slack1 long, short boolean")


def sums(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(s.sum(dtype=np.uint64)), int(mix(s + _C[2]).sum(dtype=np.uint64))


#: Weight of an entry whose list was told by the chunk that it stands for.
TOLD = 3
PACKED = "bucket int, lower int, ids binary, counts binary, low binary, high binary, rows binary"
#: What a bucket gives: kind 0, a pair of sets a and b; kind 1, the set b in the list a with a weight in the group that its band begins (lower 0) or ends.
FOUND = "kind int, a long, b long, weight int, lower int"
_ROW = np.dtype([("kind", "<i4"), ("a", "<i8"), ("b", "<i8"), ("weight", "<i4"), ("lower", "<i4")])


def _rows(kind: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray | int = 0, lower: np.ndarray | int = 0) -> np.ndarray:
    out = np.zeros(len(a), _ROW)
    out["kind"], out["a"], out["b"], out["weight"], out["lower"] = kind, a, b, weight, lower
    return out


def signatures(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed signatures by bucket, from columns doc_id and text.

    Sets go by their first sum, so copies are one set wherever they are; a
    partition signs them once. Sets of a chunk that share a signature are
    combined before the shuffle: the first stands for the others, whose pairs
    with it and places in the list travel as they are, to any bucket. So a
    list has an entry a chunk at most, however many sets have the signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer, seen = Shingler(), Signer(), set()
        for _, texts in _chunks(batches):
            keep, sets = [], []
            for t in texts:
                s = shingler.set(t)
                mark = (*sums(s), len(s))
                if len(s) and mark not in seen:
                    seen.add(mark)
                    keep.append(mark[0])
                    sets.append(s)
            if not sets:
                continue
            name = np.array(keep, dtype=np.uint64).view(np.int64)
            out: list[tuple] = []
            both = [signer.sign(sets, lower) for lower in (False, True)]
            lower = np.repeat([0, 1], [len(x[0]) for x in both])
            d, sig, weight = (np.concatenate([x[k] for x in both]) for k in range(3))
            bucket = ((sig >> _U(LOW_BITS)) % _U(buckets)).astype(np.int64)
            sig &= _U((1 << LOW_BITS) - 1)
            # sets that meet within the chunk
            order = np.lexsort((name[d], sig, bucket))
            d, sig, weight, bucket, lower = (x[order] for x in (d, sig, weight, bucket, lower))
            start = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (sig[1:] != sig[:-1])][: len(d)])
            many = np.diff(np.r_[start, len(d)])
            meet = np.repeat(many > 1, many)
            if meet.any():
                number, sets_here = (bucket << LOW_BITS | sig.astype(np.int64))[meet], name[d[meet]]
                a, b = unique_pairs(np.repeat(name[d[start]], many)[meet], sets_here)
                told = np.concatenate([_rows(0, a, b), _rows(1, number, sets_here, weight[meet], lower[meet])])
                out.append((hash((keep[0], len(keep))) % buckets, 0, b"", b"", b"", b"", told.tobytes()))
            weight = np.where(meet, _U(TOLD), weight)
            stays = np.zeros(len(d), bool)
            stays[start] = True
            d, sig, weight, bucket, lower = (x[stays] for x in (d, sig, weight, bucket, lower))
            order = np.lexsort((d, lower, bucket))
            d, sig, weight, bucket, lower = (x[order] for x in (d, sig, weight, bucket, lower))
            cut = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (lower[1:] != lower[:-1])][: len(d)])
            for i, j in zip(cut, np.r_[cut[1:], len(d)], strict=True):
                dd, ss, ww = d[i:j], sig[i:j], weight[i:j]
                at = np.flatnonzero(np.r_[True, dd[1:] != dd[:-1]])
                low, high = (ss & _U(0xFFFFFFFF)).astype("<u4"), ((ss >> _U(32)) | ww << _U(6)).astype("u1")
                out.append((int(bucket[i]), int(lower[i]), name[dd[at]].tobytes(), np.diff(np.r_[at, len(dd)]).astype("<u4").tobytes(), low.tobytes(), high.tobytes(), b""))
            if out:
                kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in PACKED.split(", ")])

    return docs.mapInArrow(run, PACKED)


def unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    new &= a != b
    return a[new], b[new]


def _lists(group: pd.DataFrame) -> pd.DataFrame:
    """The lists of one bucket: the first set of each with each other one, and the sets of lists that are not told yet."""
    told = [np.frombuffer(x, _ROW) for x in group["rows"] if x]
    group = group[group["low"].str.len() > 0]
    out = [np.zeros(0, _ROW), *told]
    if len(group):
        counts = [np.frombuffer(c, "<u4") for c in group["counts"]]
        ids = np.concatenate([np.repeat(np.frombuffer(i, "<i8"), c) for i, c in zip(group["ids"], counts, strict=True)])
        high = np.concatenate([np.frombuffer(x, "u1") for x in group["high"]]).astype(np.int64)
        sig = np.concatenate([np.frombuffer(x, "<u4") for x in group["low"]]).astype(np.int64) | (high & 0x3F) << 32
        lower = np.repeat(group["lower"].to_numpy(), [len(x) for x in group["high"]])
        weight, bucket = high >> 6, int(group["bucket"].iloc[0])
        # entries of one set, from several partitions, count once, told if one of them is
        order = np.lexsort((weight, ids, sig))
        order = order[np.r_[(sig[order][1:] != sig[order][:-1]) | (ids[order][1:] != ids[order][:-1]), True]]
        ids, sig, weight, lower = ids[order], sig[order], weight[order], lower[order]
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        many = np.diff(np.r_[start, len(sig)])
        shared = np.repeat(many > 1, many)
        out.append(_rows(0, *unique_pairs(np.repeat(ids[start], many)[shared], ids[shared])))
        # a list of two is no more than its pair, unless an entry stands for others
        some = np.repeat(np.maximum.reduceat(weight, start) == TOLD, many)
        fresh = shared & (weight != TOLD) & (np.repeat(many > 2, many) | some)
        out.append(_rows(1, sig[fresh] | bucket << LOW_BITS, ids[fresh], weight[fresh], lower[fresh]))
    return pd.DataFrame.from_records(np.concatenate(out))


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of smallest keys that sizes and parities do not rule out, from ``pairs`` of first sums."""
    l, r = (classes.select(F.col("f1").alias(x), F.col("f2").alias(f"g{k}"), F.col("rep").alias(f"rep{k}"), F.col("n").alias(f"n{k}"), F.col("odd").alias(f"odd{k}")) for k, x in ((1, "a"), (2, "b")))  # noqa: E741

    def folded(x: str, other: str) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(other), F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))

    # sizes that may be similar differ by one fold at most; longer ones leave nulls, which decide nothing
    differ = F.aggregate(F.zip_with(folded("odd1", "odd2"), folded("odd2", "odd1"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    close = (F.col("n1") * NUM <= F.col("n2") * DEN) & (F.col("n2") * NUM <= F.col("n1") * DEN)
    close = close & (differ * (DEN + NUM) <= (F.col("n1") + F.col("n2")) * (DEN - NUM))
    out = pairs.join(r, "b").join(l, "a").filter(F.col("rep1") != F.col("rep2")).filter(close)
    return out.select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b")).distinct()


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        recent: dict[tuple, np.ndarray] = {}

        def get(i: tuple, t: str) -> np.ndarray:
            s = recent.get(i)
            if s is None:
                if len(recent) >= 64:
                    recent.clear()
                s = recent[i] = shingler.set(t)
            return s

        for f in frames:
            good = []
            for a, b, ta, tb in zip(f["a"], f["b"], f["ta"], f["tb"], strict=True):
                x, y = get((a, hash(ta)), ta), get((b, hash(tb)), tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(DEN * both >= NUM * (len(x) + len(y) - both))
            yield f.loc[good, ["a", "b"]]

    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long").distinct()


def connecting_links(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect just what the similar ones of ``pairs`` connect.

    Each document is verified with the smallest one it is paired with; this
    joins most of a group of near copies. Of the other pairs only those
    between two components are verified, and they are given as links of the
    components' smallest documents. So a group has about a link a member,
    however many lists its members share.
    """
    first = scratch.keep(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    labels = components(verify(first, texts), scratch=scratch)
    of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    rest = pairs.join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = scratch.keep(rest.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).filter("ca <> cb"))
    between = verify(rest.select("a", "b"), texts).join(rest, ["a", "b"]).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    return labels.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(between)


def fetch(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of ``docs`` with one of ``ids`` (column doc_id), written once for several uses.

    The ids are written first and counted: up to 32 MB of them are sent to all
    executors, and the texts are shuffled only beyond that.
    """
    return scratch.keep(docs.join(sized(scratch.keep(ids.distinct())), "doc_id", "left_semi"))


def short_pairs(classes: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Pairs of the sets whose segments tolerate too little with all sets of their sizes, or None. About one set in 10^12 is such."""
    band = F.floor(F.log("n") / F.log(F.lit(1.5))).cast("int")
    some = scratch.keep(classes.filter("short").select(F.col("f1").alias("a"), F.explode(F.array(band - 1, band, band + 1)).alias("band")))
    if not some.limit(1).count():
        return None
    return some.join(classes.select(F.col("f1").alias("b"), band.alias("band")), "band").select("a", "b")


def list_members(places: DataFrame, labels: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """``around, x, component``: the documents of lists that sets of several components keep, by the lists' main component.

    ``places`` has the sets b of lists a with their weights. A set drops its
    longest lists as long as their weights stay within its slack; two similar
    sets still meet in the shortest of the lists they share, as all go by one
    order. Lists whose sets are mostly of one component are taken together.
    """
    sets = classes.select(F.col("f1").alias("b"), "rep", "slack0", "slack1").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    sets = scratch.keep(sets.select("b", "rep", "slack0", "slack1", F.coalesce("component", "rep").alias("component")))
    # different sets of one sum go together, with the least slack
    names = sets.groupBy("b").agg(*[F.min(c).alias(c) for c in ("slack0", "slack1")], F.min("component").alias("lo"), F.max("component").alias("hi"))
    rows = places.groupBy("a", "b", "lower").agg(F.max("weight").alias("weight")).join(names, "b")
    rows = scratch.keep(rows.select("a", "b", "lower", "weight", "lo", "hi", F.when(F.col("lower") == 0, F.col("slack0")).otherwise(F.col("slack1")).alias("slack")))
    lists = rows.groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi AND m > 2")
    longest_first = Window.partitionBy("b", "lower").orderBy(F.col("m").desc(), "a").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = rows.select("a", "b", "lower", "weight", "slack").join(lists.select("a", "m"), "a").withColumn("used", F.sum("weight").over(longest_first))
    kept = scratch.keep(kept.filter("used > slack").select("a", "b").join(sets.select("b", "rep", "component"), "b").select("a", F.col("rep").alias("x"), "component"))
    main = kept.groupBy("a", "component").count().groupBy("a").agg(F.max_by("component", F.struct("count", -F.col("component"))).alias("around"), F.count(F.lit(1)).alias("several"))
    return scratch.keep(kept.join(main.filter("several > 1"), "a").select("around", "x", "component").distinct())


def _fold(odd: np.ndarray, words: int) -> np.ndarray:
    """Parities of fewer classes from those of more, as rows."""
    while odd.shape[1] > words:
        half = odd.shape[1] // 2
        odd = odd[:, :half] ^ odd[:, half:]
    return odd


def _pairs_within(rows: list[tuple], others: list[tuple] | None) -> list[tuple[int, int]]:
    """Links that connect all components with similar sets among ``rows``, or between ``rows`` and ``others``; rows are (x, component, text)."""
    shingler, parent = Shingler(), {}

    def find(c):
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    def prepared(part):
        sets = [shingler.set(t) for _, _, t in part]
        by_words: dict[int, list[int]] = {}
        odds = [parities(s).view(np.uint64) for s in sets]
        for i, o in enumerate(odds):
            by_words.setdefault(len(o), []).append(i)
        return sets, np.array([len(s) for s in sets]), np.array([c for _, c, _ in part]), [(k, np.array(v), np.array([odds[i] for i in v])) for k, v in by_words.items()]

    mine = prepared(rows)
    other = prepared(others) if others is not None else mine
    found = []
    for k, ii, left in mine[3]:
        for m, jj, right in other[3]:
            if max(k, m) > 2 * min(k, m) or (others is None and m < k):
                continue
            words = min(k, m)
            a, b = _fold(left, words), _fold(right, words)
            step = max(1, SLICE // len(b))
            for at in range(0, len(a), step):
                i, n = ii[at : at + step], mine[1][ii[at : at + step]][:, None]
                both = n + other[1][jj][None, :]
                ok = (mine[2][i][:, None] != other[2][jj][None, :]) & (n * NUM <= other[1][jj][None, :] * DEN) & (other[1][jj][None, :] * NUM <= n * DEN)
                if not ok.any():
                    continue
                differ = np.zeros(ok.shape, np.int64)
                for w in range(words):
                    differ += np.bitwise_count(a[at : at + step, None, w] ^ b[None, :, w])
                for p, q in zip(*np.nonzero(ok & (differ * (DEN + NUM) <= both * (DEN - NUM))), strict=True):
                    p, q = i[p], jj[q]
                    c, d = find(mine[2][p]), find(other[2][q])
                    if c == d:
                        continue
                    x, y = mine[0][p], other[0][q]
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    if DEN * same >= NUM * (len(x) + len(y) - same):
                        parent[max(c, d)] = min(c, d)
                        found.append((rows[p][0], (others or rows)[q][0]))
    return found


def compare_blocks(members: DataFrame, texts: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between documents of different components that are around the same one.

    They are dealt into blocks of about ``BLOCK`` shingles, the documents of
    that component apart. Two blocks, or one, are a task, but for two of the
    component itself; it gives no more links than it takes to connect what it
    has. No pairs are made as rows.
    """
    n = classes.groupBy(F.col("rep").alias("x")).agg(F.sum("n").alias("n"))
    members = scratch.keep(members.join(n, "x").withColumn("home", F.col("component") == F.col("around")))
    blocks = lambda c: F.ceil(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) / BLOCK).cast("int")
    sizes = members.groupBy("around").agg(blocks(~F.col("home")).alias("others"), blocks(F.col("home")).alias("homes"))
    placed = members.join(sizes.filter("others > 0"), "around")
    own = F.pmod(F.xxhash64("x", "around"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("others"))).cast("int")
    placed = placed.withColumn("own", F.when(F.col("home"), own + F.col("others")).otherwise(own))
    # a block is the first one in tasks with itself and later ones, the second one in those with earlier ones
    first = F.when(F.col("home"), F.array().cast("array<int>")).otherwise(F.sequence(F.col("own"), F.col("others") + F.col("homes") - 1))
    earlier = F.filter(F.sequence(F.lit(0), F.col("others") - 1), lambda i: i < F.col("own"))
    task = F.concat(F.transform(first, lambda j: F.struct(F.col("own").alias("i"), j.alias("j"))), F.transform(earlier, lambda i: F.struct(i.alias("i"), F.col("own").alias("j"))))
    placed = placed.withColumn("task", F.explode(task)).select("around", "task.i", "task.j", "own", "component", F.col("x").alias("doc_id"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        sides = [list(group.loc[group["own"] == k, ["doc_id", "component", "text"]].itertuples(index=False, name=None)) for k in (i, j)]
        got = _pairs_within(sides[0], None if i == j else sides[1]) if sides[0] and sides[1] else []
        return pd.DataFrame(sorted((min(p), max(p)) for p in got), columns=["a", "b"], dtype="int64")

    return placed.join(texts, "doc_id").groupBy("around", "i", "j").applyInPandas(run, "a long, b long").distinct()


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Documents without words (null, empty or white-space text) have an empty
    set and link with nothing; so do rows with a null key, whose component is
    null. Equal sets are one class, compared through its smallest key. Rows
    that repeat a key share its component; extra columns are not read. An
    empty table gives an empty result. Links within a component that follow
    from others are not listed, which is why groups of any size cost a number
    of comparisons in proportion to their members.
    """
    spark = docs.sparkSession
    scratch = Scratch()
    try:
        base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
        facts = scratch.keep(describe(base))
        total = facts.agg(F.sum("n")).first()[0] or 0
        buckets = min(1 << 24, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 4_000_000 + 1))
        known = base.filter(F.col("doc_id").isNotNull())
        classes = facts.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("odd", "slack0", "slack1", "short")])
        classes = scratch.keep(classes)
        found = scratch.keep(signatures(known, buckets).groupBy("bucket").applyInPandas(_lists, FOUND))
        pairs = found.filter("kind = 0").select("a", "b").distinct()
        short = short_pairs(classes, scratch)
        # different sets of one sum meet here too
        twins = classes.groupBy("f1").count().filter("count > 1").select(F.col("f1").alias("a"), F.col("f1").alias("b"))
        pairs = pairs.unionByName(twins) if short is None else pairs.unionByName(twins).unionByName(short)
        pairs = scratch.keep(possible(pairs, classes))
        texts = fetch(known, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), scratch)
        links = scratch.keep(connecting_links(pairs, texts, scratch))
        labels = components(links, scratch=scratch)
        members = list_members(found.filter("kind = 1").select("a", "b", "weight", "lower"), labels, classes, scratch)
        texts = fetch(known, members.select(F.col("x").alias("doc_id")), scratch)
        more = scratch.keep(compare_blocks(members, texts, classes, scratch))
        labels = components(links.unionByName(more), scratch=scratch)
        reps = facts.filter("n > 0").select("doc_id", "n", "f1", "f2").join(classes.select("n", "f1", "f2", "rep"), ["n", "f1", "f2"]).filter("doc_id <> rep").select("doc_id", "rep").distinct()
        label = labels.select(F.col("node").alias("rep"), "component")
        groups = reps.join(label, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("c")).unionByName(label.select(F.col("rep").alias("doc_id"), F.col("component").alias("c")))
        # a key with several texts joins their components
        out = facts.select("doc_id", "n").join(groups.groupBy("doc_id").agg(F.min("c").alias("c")), "doc_id", "left")
        return materialize(out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id")))
    finally:
        scratch.clear()


def op5_universe_partition_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
