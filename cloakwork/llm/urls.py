"""URL filter: weighted vocabulary counted with an Aho-Corasick automaton."""

from __future__ import annotations

import pkgutil
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import unused

#: The default vocabulary: lines of term, kind (strict or soft) and weight.
VOCABULARY = "url_terms.tsv"
#: Soft weights of a URL, each term counted once, from which it is rejected.
LEAST_SOFT = 2.0


@dataclass(frozen=True)
class Vocabulary:
    """One strict term rejects a URL; so do soft terms whose weights reach ``least_soft`` together.

    Weight 1 is a term that tells nothing alone; 2 is one that is enough by
    itself where it stands between boundaries.
    """

    strict: tuple[str, ...]
    soft: tuple[tuple[str, float], ...]
    least_soft: float = LEAST_SOFT

    @classmethod
    def loads(cls, text: str, least_soft: float = LEAST_SOFT) -> Vocabulary:
        rows = [line.split("\t") for line in text.splitlines() if line.strip() and not line.startswith("#")]
        strict = tuple(sorted({t.lower() for t, kind, *_ in rows if kind == "strict"}))
        soft = {t.lower(): float(rest[0]) if rest else 1.0 for t, kind, *rest in rows if kind == "soft"}
        return cls(strict, tuple(sorted((t, w) for t, w in soft.items() if t not in strict)), least_soft)


@lru_cache(maxsize=1)
def default_vocabulary() -> Vocabulary:
    return Vocabulary.loads(pkgutil.get_data(__package__, VOCABULARY).decode())


#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def automaton(vocabulary: Vocabulary) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for term, weight in (*vocabulary.soft, *((t, 0.0) for t in vocabulary.strict)):
        machine.add_word(term, (term, weight))
    machine.make_automaton()
    return machine


def hits(machine: ahocorasick.Automaton, text: str) -> tuple[set[str], dict[str, float]]:
    """Strict terms, and soft ones with their weights, in ``text`` (lower case) that no ASCII letter or digit touches."""
    strict: set[str] = set()
    soft: dict[str, float] = {}
    inside = frozenset(LOWER + "0123456789")
    for last, (term, weight) in machine.iter(text):
        first = last - len(term) + 1
        if (first and text[first - 1] in inside) or text[last + 1 : last + 2] in inside and last + 1 < len(text):
            continue
        if weight:
            soft[term] = weight
        else:
            strict.add(term)
    return strict, soft


def vocabulary_hits(vocabulary: Vocabulary):
    """Pandas UDF: URL -> struct(n_strict, n_soft, weight), distinct terms; null counts as an empty URL."""
    if not vocabulary.strict and not vocabulary.soft:
        raise ValueError("the vocabulary is empty")

    @F.pandas_udf("n_strict int, n_soft int, weight double")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = automaton(vocabulary)
        table = str.maketrans(UPPER, LOWER)
        for urls in batches:
            both = [hits(machine, u.translate(table)) for u in urls.fillna("")]
            rows = [(len(a), len(b), float(sum(b.values()))) for a, b in both]
            yield pd.DataFrame(rows, columns=["n_strict", "n_soft", "weight"]).astype({"n_strict": "int32", "n_soft": "int32", "weight": "float64"})

    return count


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Equal lengths: the first listed."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        best = F.when(fits, F.struct(F.lit(rule_host + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def filter_urls(pages: DataFrame, url: str = "url", vocabulary: Vocabulary | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Add ``host, path, rule, n_strict, n_soft, weight, verdict`` to every row.

    The verdict is that of the longest fitting rule; without one, ``block`` if
    the whole URL has a strict term, or soft terms of enough weight, else
    ``allow``. A null URL, or one without ``://``, has an empty host and path
    (its vocabulary is still counted). Rows are judged one by one, so repeated
    rows get the same verdict and an empty table stays empty; very long URLs
    are read whole; input columns of the added names are replaced.
    """
    words = vocabulary or default_vocabulary()
    got, host, path, rule = (unused(pages, c) for c in ("hits", "host", "path", "rule"))
    out = pages.withColumn(got, vocabulary_hits(words)(F.col(url)))
    out = out.withColumn(host, host_of(F.col(url))).withColumn(path, path_of(F.col(url)))
    out = out.withColumn(rule, matching_rule(F.col(host), F.col(path), rules))
    own = F.when((F.col(got)["n_strict"] > 0) | (F.col(got)["weight"] >= words.least_soft), "block").otherwise("allow")
    added = {"host": F.col(host), "path": F.col(path), "rule": F.col(rule)["rule"], **{c: F.col(got)[c] for c in ("n_strict", "n_soft", "weight")}, "verdict": F.coalesce(F.col(rule)["verdict"], own)}
    keep = [F.col(c) for c in pages.columns if c not in added]
    return out.select(*keep, *[v.alias(k) for k, v in added.items()])


def op10_url_vocabulary(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def oracle() -> str:
    lower = "translate(coalesce(url,''),'%s','%s')" % (UPPER, LOWER)
    words = default_vocabulary()

    def has(term: str) -> str:
        return f"(regexp_matches(u,'(^|[^a-z0-9]){re.escape(term)}([^a-z0-9]|$)'))::INT"

    rules = " ".join(
        f"WHEN (host='{h}' OR ends_with(host,'.{h}')) AND starts_with(path,'{p}') THEN '{v}:{h}{p}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"""
    WITH a AS (SELECT page_id, {lower} AS u,
        translate(regexp_extract(coalesce(url,''),'^(?s:.*?)://([^/?#]*)',1),'{UPPER}','{LOWER}') AS host,
        regexp_extract(coalesce(url,''),'^(?s:.*?)://[^/?#]*([^?#]*)',1) AS path FROM pages),
    b AS (SELECT page_id, host, path, CASE {rules} END AS r, ({'+'.join(map(has, words.strict))})::INT AS n_strict,
        ({'+'.join(has(t) for t, _ in words.soft)})::INT AS n_soft, ({'+'.join(f'{has(t)}*{w}' for t, w in words.soft)})::DOUBLE AS weight FROM a)
    SELECT page_id, host, path, split_part(r,':',2) AS rule,
        CASE WHEN r IS NOT NULL THEN split_part(r,':',1) WHEN n_strict>0 OR weight>={words.least_soft} THEN 'block' ELSE 'allow' END AS verdict,
        n_strict, n_soft FROM b"""
