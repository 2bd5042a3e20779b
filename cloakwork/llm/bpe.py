"""BPE encoding and decoding; long unsplit text is encoded as a tree of halves.

The tree has two levels of one kind. A text is cut into halves down to leaves
wherever that falls; leaves are split into pre-tokens on their own, and two
neighbours are joined by splitting growing windows around the seam until a
pre-token agrees with either side. A pre-token that is itself longer than a
leaf is halved in the same way, and joined by encoding windows until tokens
agree.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from ..functions.spans import unused

#: The pre-tokenizer's pattern once white space is single blanks. It is used for texts up to U+024F,
#: where the libraries agree on letters and numbers; the library's own splitter does the others.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^ \p{L}\p{N}]+")
BEYOND = re.compile("[^\x00-ɏ]")


#: Characters of a leaf. It decides where halves are cut, never what comes out.
LEAF = 1024


class TreeEncoder:
    """Encodes as ``Tokenizer.encode(text, add_special_tokens=False)`` does, for byte-level BPE models.

    A text of more than ``leaf`` characters is halved down to leaves, which
    are split independently and joined upwards by ``join_words``. Pre-tokens
    of up to ``leaf`` bytes are encoded once and remembered (at most
    ``remember`` of them); a longer one is halved down to leaves too, joined by
    ``join``. ``joins`` counts the joins of either kind.
    """

    def __init__(self, path: str, leaf: int = LEAF, remember: int = 200_000, threads: int = 2):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf, self.remember, self.threads = leaf, remember, threads
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.suffix = self.tokenizer.model.end_of_word_suffix or ""
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        self.markers = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.memo: dict[str, tuple[bytes, int, str]] = {}
        self.joins = 0

    def tokens(self, piece: str, at: int = 0) -> list[tuple[int, int, int]]:
        """(start, end, id) of the model's tokens of ``piece``, whose characters stand for bytes."""
        out = []
        found = self.tokenizer.model.tokenize(piece)
        for k, t in enumerate(found):
            n = len(t.value) - (len(self.suffix) if k + 1 == len(found) and self.suffix and t.value.endswith(self.suffix) else 0)
            out.append((at, at + n, t.id))
            at += n
        return out

    def join(self, piece: str, left: list, right: list) -> list:
        """Tokens of two neighbouring parts of ``piece`` as one part.

        A window around the seam is re-encoded. Where one of its tokens is
        also in the left part, and a later one, not its last, is in the right
        part, each pair of neighbours in the result is as in an encoding of
        that stretch, which makes the whole the encoding. Otherwise the
        window grows, at worst to both parts. The last token of the left part
        and of a window that ends inside the part carry the end-of-word mark
        wrongly, so they never count as agreeing.
        """
        self.joins += 1
        first, seam, last = left[0][0], right[0][0], right[-1][1]
        known_left = {t: i for i, t in enumerate(left[:-1])}
        known_right = {t: i for i, t in enumerate(right)}
        width = 32
        while True:
            a, b = max(first, seam - width), min(last, seam + width)
            window = self.tokens(piece[a:b], a)
            start = 0 if a == first else next((k for k, t in enumerate(window) if t in known_left), None)
            end = len(window) - 1 if b == last else next((k for k in range(len(window) - 2, -1, -1) if window[k] in known_right), None)
            if start is not None and end is not None and start <= end:
                before = [] if a == first else left[: known_left[window[start]]]
                after = [] if b == last else right[known_right[window[end]] + 1 :]
                return before + window[start : end + 1] + after
            width *= 2

    def tree(self, piece: str) -> list[tuple[int, int, int]]:
        cuts = [0, len(piece)]
        while max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) > self.leaf:
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:], strict=False) if b - a > self.leaf)})
        with ThreadPoolExecutor(self.threads) as pool:
            parts = list(pool.map(lambda ab: self.tokens(piece[ab[0] : ab[1]], ab[0]), zip(cuts, cuts[1:], strict=False)))
            while len(parts) > 1:
                pairs = list(zip(parts[::2], parts[1::2], strict=False))
                parts = list(pool.map(lambda ab: self.join(piece, *ab), pairs)) + parts[2 * len(pairs) :]
        return parts[0]

    def word(self, word: str) -> tuple[bytes, int, str]:
        """ids as bytes, their number, decoded text of one pre-token."""
        piece = self.bytes.pre_tokenize_str(word)[0][0]
        ids = [t[2] for t in (self.tokens(piece) if len(piece) <= self.leaf else self.tree(piece))]
        text = " ".join(map(self.tokenizer.id_to_token, ids))
        out = (struct.pack(f"<{len(ids)}I", *ids), len(ids), text)
        if len(piece) <= self.leaf:
            if len(self.memo) >= self.remember:
                self.memo.clear()
            self.memo[word] = out
        return out

    def split(self, text: str) -> list[str]:
        """Pre-tokens of normalised text, which leave out nothing but blanks."""
        if not BEYOND.search(text):
            return SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    @staticmethod
    def placed(text: str, words: list[str], at: int) -> list[tuple[int, str]]:
        """(start, word) of words that follow ``at``."""
        out = []
        for w in words:
            at = text.index(w, at)
            out.append((at, w))
            at += len(w)
        return out

    def join_words(self, text: str, left: list[str], right: list[str], first: int, seam: int, last: int) -> list[str]:
        """Pre-tokens of ``text[first:last]`` from those of its parts before and after ``seam``.

        Splitting goes from left to right and starts anew after each
        pre-token. So where a pre-token of the window is also one of the left
        part (not its last, which the seam may have cut), the window splits as
        the whole does from there on; and where a later one, not the window's
        last, is also one of the right part, that part splits as the whole
        does after it.
        """
        self.joins += 1
        width = 16
        while True:
            a, b = max(first, seam - width), min(last, seam + width)
            window = self.placed(text, self.split(text[a:b]), a)
            # words of both parts that may lie in the window, by their places
            near_left, near_right, at = {}, {}, seam
            for i in range(len(left) - 1, -1, -1):
                at = text.rindex(left[i], first, at)
                if at < a:
                    break
                if i < len(left) - 1:
                    near_left[at, left[i]] = i
            at = seam
            for i, w in enumerate(right):
                at = text.index(w, at)
                if at + len(w) > b:
                    break
                near_right[at, w] = i
                at += len(w)
            start, before = (0, 0) if a == first else next(((k, near_left[x]) for k, x in enumerate(window) if x in near_left), (None, 0))
            end, after = (len(window) - 1, len(right)) if b == last else next(((k, near_right[window[k]] + 1) for k in range(len(window) - 2, -1, -1) if window[k] in near_right), (None, 0))
            if start is not None and end is not None and (start <= end or (a == first and b == last)):
                return left[:before] + [w for _, w in window[start : end + 1]] + right[after:]
            width *= 2

    def text_words(self, text: str, first: int, last: int) -> list[str]:
        """Pre-tokens of ``text[first:last]`` by the tree of halves."""
        if last - first <= self.leaf:
            return self.split(text[first:last])
        seam = (first + last) // 2
        return self.join_words(text, self.text_words(text, first, seam), self.text_words(text, seam, last), first, seam, last)

    def words(self, text: str) -> list[str]:
        text = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return self.text_words(text, 0, len(text))

    def encode(self, text: str) -> tuple[bytes, int, str]:
        """ids as little-endian unsigned 32-bit integers, their number, and their decoded text.

        The vocabulary has no decoder, so decoding joins the tokens by blanks.
        """
        parts = self.markers.split(text) if self.markers else [text]
        got: list[tuple[bytes, int, str]] = []
        for i, part in enumerate(parts):
            if i % 2:
                got.append((struct.pack("<I", self.added[part]), 1, part))
            elif part:
                memo = self.memo
                got += [memo.get(w) or self.word(w) for w in self.words(part)]
        return b"".join([x[0] for x in got]), sum([x[1] for x in got]), " ".join([x[2] for x in got])


def encode_texts(docs: DataFrame, path: str, text: str = "text", leaf: int = LEAF, with_ids: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens, ids_sha256, decoded_sha256`` and, if asked, ``ids`` and ``decoded`` themselves.

    Null text counts as empty (no tokens). Rows are independent, so repeated
    rows give repeated results, and an empty table gives an empty one; very
    long texts are read whole. Columns of the added names are replaced.
    ``path`` is the vocabulary file, which every executor must be able to read.
    """
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = TreeEncoder(path, leaf)
        for texts in batches:
            rows = []
            for t in texts:
                ids, n, decoded = encoder.encode(t or "")
                row = (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*row, list(struct.unpack(f"<{n}I", ids)), decoded) if with_ids else row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])

    names = [c.split()[0] for c in kind.split(", ")]
    kept = [c for c in docs.columns if c not in names]
    got = unused(docs, "bpe")
    return docs.select(*kept, run(F.col(text)).alias(got)).select(*kept, *[F.col(got)[c].alias(c) for c in names])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe_tree(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_texts(docs, path or default_vocabulary(), with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
