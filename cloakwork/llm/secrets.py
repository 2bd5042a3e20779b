"""Secret scan over an incremental blob ledger; DataFrame functions only.

Every version of every path is content-addressed. The ledger is a table of
blobs, the rule versions that each was scanned for, and what was found. An
update hashes the versions where they lie, compares the hashes with the
ledger, and fetches and scans only blobs with unseen rule versions, each
once. Findings are joined back from the ledger to all paths that hold a blob.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import unused
from .storage import Scratch, shared_dir


@dataclass(frozen=True)
class Rule:
    """``group`` is the part whose length must be ``shortest`` at least; ``hint`` is in every text that matches."""

    kind: str
    regex: str
    group: int = 0
    shortest: int = 1
    hint: str | None = None

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.kind}\n{self.regex}\n{self.group}\n{self.shortest}".encode()).hexdigest()[:16]


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: What the scan finds beyond the base kinds.
MORE_RULES = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<start:int,end:int>>"


def found(text: Column, rule: Rule) -> Column:
    """Spans of leftmost non-overlapping matches whose group is long enough; others still use up their text.

    The texts between the matches give the offsets, so two passes of the
    regex do, and only over texts that match at all.
    """
    pieces = F.arrays_zip(
        F.split(text, rule.regex, -1).alias("g"),
        F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)).alias("v"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["g"])
        b = a + F.coalesce(F.length(x["m"]), F.lit(0))
        kept = F.when(F.length(x["v"]) >= rule.shortest, F.array(F.struct(a.alias("start"), b.alias("end"))))
        return F.struct(b.alias("at"), F.concat(acc["out"], F.coalesce(kept, F.array().cast(SPANS))).alias("out"))

    spans = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    test = text.rlike(rule.regex)
    if rule.hint:
        test = text.contains(rule.hint) & test
    return F.when(test, spans).otherwise(F.array().cast(SPANS))


ENTRIES = f"blob binary, versions array<string>, found array<struct<version:string,spans:{SPANS}>>"
ALL_SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"
#: Bytes of findings up to which they are sent to all executors; beyond it, both sides are shuffled.
MAX_BROADCAST = 32 << 20


def address(text: Column) -> Column:
    """SHA-256 of a text; null is the empty blob."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class Ledger:
    """Blobs at ``path``: ``blob``, the ``versions`` of rules it was scanned for, and what was ``found`` by those that found anything.

    Each update appends one file set; nothing is rewritten, so an update that
    fails half-way leaves the ledger as it was.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRIES).parquet(self.path) if self.exists() else self.spark.createDataFrame([], ENTRIES)

    def unseen(self, versions: DataFrame, text: str, rules: Sequence[Rule] = RULES) -> DataFrame:
        """``blob, todo``: the versions of rules that blobs of ``versions`` were not scanned for. Only hashes are shuffled."""
        wanted = F.lit([r.version for r in rules])
        blobs = versions.select(address(F.col(text)).alias("blob")).distinct()
        known = self.entries().join(blobs, "blob", "left_semi").groupBy("blob").agg(F.flatten(F.collect_list("versions")).alias("known"))
        todo = F.coalesce(F.array_except(wanted, F.col("known")), wanted)
        return blobs.join(known, "blob", "left").select("blob", todo.alias("todo")).filter(F.size("todo") > 0)

    def update(self, versions: DataFrame, text: str, rules: Sequence[Rule] = RULES) -> None:
        """Scans what is unseen of ``versions`` and appends it. An empty table appends nothing but an empty file set."""
        wanted = F.lit([r.version for r in rules])
        scratch = Scratch()
        try:
            if self.exists():
                todo = scratch.keep(self.unseen(versions, text, rules))
                bodies = versions.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("body")).join(todo, "blob")
                bodies = bodies.groupBy("blob").agg(F.first("body").alias("body"), F.first("todo").alias("todo"))
            else:
                # nothing is known, so nothing is to compare
                bodies = versions.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("body"))
                bodies = bodies.groupBy("blob").agg(F.first("body").alias("body")).withColumn("todo", wanted)
            none = F.array().cast(SPANS)
            results = [F.struct(F.lit(r.version).alias("version"), F.when(F.array_contains("todo", r.version), found(F.col("body"), r)).otherwise(none).alias("spans")) for r in rules]
            entries = bodies.select("blob", F.col("todo").alias("versions"), F.filter(F.array(*results), lambda x: F.size(x["spans"]) > 0).alias("found"))
            entries.write.mode("append").option("compression", "zstd").parquet(self.path)
        finally:
            scratch.clear()

    def findings(self, rules: Sequence[Rule] = RULES) -> DataFrame:
        """``blob, spans``: array of (start, ord, end, kind), code points, sorted by start and rule order, of blobs with any."""
        entries = self.entries().filter(F.size("found") > 0).select("blob", F.explode("found").alias("x"))
        number = F.array_position(F.lit([r.version for r in rules]), F.col("x.version")).cast("int") - 1
        kind = F.element_at(F.lit([r.kind for r in rules]), F.col("i") + 1)
        rows = entries.withColumn("i", number).filter("i >= 0")
        tagged = F.transform("x.spans", lambda s: F.struct(s["start"].alias("start"), F.col("i").alias("ord"), s["end"].alias("end"), kind.alias("kind")))
        return rows.groupBy("blob").agg(F.array_distinct(F.array_sort(F.flatten(F.collect_list(tagged)))).alias("spans"))


def join_back(versions: DataFrame, text: str, findings: DataFrame, scratch: Scratch) -> DataFrame:
    """Every row of ``versions`` with ``blob`` and ``spans`` of its text; columns of those names are replaced.

    Findings are written first and sent to all executors as long as they are
    under ``MAX_BROADCAST`` bytes, so that no text moves. Beyond that both
    sides are shuffled by blob; one that a third of the rows hold is split by
    AQE, as either side comes straight from its shuffle.
    """
    kept = [c for c in versions.columns if c not in ("blob", "spans")]
    b, s = unused(versions, "b"), unused(versions, "s")
    hit = scratch.keep(findings.select(F.col("blob").alias(b), F.col("spans").alias(s)))
    size = hit.agg(F.sum(F.lit(64) + F.size(s) * 48)).first()[0] or 0
    out = versions.select(*kept, address(F.col(text)).alias("blob")).join(F.broadcast(hit) if size <= MAX_BROADCAST else hit, F.col("blob") == F.col(b), "left")
    return out.select(*kept, F.lower(F.hex("blob")).alias("blob"), F.coalesce(s, F.array().cast(ALL_SPANS)).alias("spans"))


def scan(versions: DataFrame, text: str = "text", ledger: Ledger | None = None, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, Scratch]:
    """Rows of ``versions`` with ``blob`` and ``spans``, and the files that they are read from.

    ``ledger`` is brought up to date first; without one, a ledger of this scan
    alone is made in the shared folder. Null text is the empty blob; repeated
    rows share their blob's findings; an empty table gives an empty result.
    """
    spark, scratch = versions.sparkSession, Scratch()
    if ledger is None:
        ledger = Ledger(spark, f"{shared_dir(spark).rstrip('/')}/cloakwork-ledger-{uuid.uuid4().hex}")
        scratch.written.append((spark, ledger.path))
    ledger.update(versions, text, rules)
    return join_back(versions, text, ledger.findings(rules), scratch), scratch


def describe(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        inside = s["start"] < acc["at"]
        return F.struct(F.when(inside, acc["out"]).otherwise(fresh).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def op2_blob_ledger(spark, sf_dir: str) -> DataFrame:
    rows, _ = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda i: F.size(F.filter("spans", lambda s: s["ord"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["ord"] < len(BASE_RULES))
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(describe(base), 256).alias("base_sha256"), describe(F.col("spans")).alias("spans"),
    )


def oracle() -> str:
    def spans(i: int, r: Rule) -> str:
        x = r.regex.replace("'", "''")
        gap, m = f"regexp_split_to_array(t,'{x}')", f"regexp_extract_all(t,'{x}',0)"
        v = f"regexp_extract_all(t,'{x}',{r.group})"
        at = "coalesce(list_sum(list_transform({0}[1:{1}], lambda y: length(y))),0)::BIGINT"
        start = f"({at.format('g', 'k')} + {at.format('m', 'k-1')})"
        item = f"{{'s':{start},'o':{i},'e':{start}+length(m[k]),'k':'{r.kind}','n':length(v[k])}}"
        return (
            f"SELECT doc_id, unnest(list_filter(list_transform(range(1,len(m)+1), lambda k: {item}), lambda z: z.n>={r.shortest})) AS z"
            f" FROM (SELECT doc_id, {gap} AS g, {m} AS m, {v} AS v FROM d WHERE regexp_matches(t,'{x}'))"
        )

    union = " UNION ALL ".join(spans(i, r) for i, r in enumerate(RULES))
    text = "coalesce(string_agg(z.k||':'||z.s||':'||z.e, ',' ORDER BY z.s, z.o){0},'')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text,'') AS t FROM documents), f AS ({union}),
    a AS (SELECT doc_id, count(*) FILTER (z.o=0) AS n_assign, count(*) FILTER (z.o=1) AS n_access, count(*) FILTER (z.o=2) AS n_hex,
        {text.format(' FILTER (z.o<3)')} AS base, {text.format('')} AS spans FROM f GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign,0)::BIGINT AS n_assign, coalesce(n_access,0)::BIGINT AS n_access, coalesce(n_hex,0)::BIGINT AS n_hex,
        sha256(coalesce(base,'')) AS base_sha256, coalesce(spans,'') AS spans FROM d LEFT JOIN a USING (doc_id)"""
