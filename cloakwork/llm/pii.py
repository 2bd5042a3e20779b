"""PII pseudonyms by format-preserving Feistel permutations; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import unused

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "date": r"(?<![\dA-Za-z-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\dA-Za-z-])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\dA-Za-z])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\dA-Za-z])",
    "number": r"(?<![\dA-Za-z])(?:(?:\d{4}[ -]){3}\d{4}|\d{13,18})(?![\dA-Za-z])",
}
ANY = "|".join(KINDS.values())
#: Days from 1900-01-01 to 2099-12-31, and two factors whose product is the least above it.
DAYS, DAY_SIDES = 73049, (271, 270)
ROUNDS = 8


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _prf(key: str, kind: str, i: Column, x: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")


def feistel(key: str, kind: str, left: Column, right: Column, a: Column | int, b: Column | int, use) -> Column:
    """``use(l, r)`` of the keyed permutation of pairs (left < a, right < b).

    Each round adds a keyed hash of one side to the other, modulo that side's
    size, which can be undone; so it is a bijection for any two sizes.
    """
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (a, b))

    def step(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        l = F.when(odd, (acc["l"] + _prf(key, kind, i, acc["r"]) % a) % a).otherwise(acc["l"])  # noqa: E741
        r = F.when(odd, acc["r"]).otherwise((acc["r"] + _prf(key, kind, i, acc["l"]) % b) % b)
        return F.struct(l.alias("l"), r.alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.lit(list(range(1, ROUNDS + 1))), start, step, lambda p: use(p["l"], p["r"]))


def _padded(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def luhn_digit(body: Column) -> Column:
    """The check digit that makes ``body`` and it pass Luhn's test."""
    n = F.length(body)

    def step(s: Column, i: Column) -> Column:
        d = F.substring(body, n + 1 - i, F.lit(1)).cast("int") * (1 + i % 2)
        return s + F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)
    return ((10 - total % 10) % 10).cast("string")


def _digits(key: str, kind: str, d: Column) -> Column:
    n = F.length(d)
    h = F.floor(n / 2).cast("int")
    side = lambda k: F.pow(F.lit(10.0), k).cast("long")
    return feistel(
        key, kind, F.substring(d, F.lit(1), h).cast("long"), F.substring(d, h + 1, n - h).cast("long"), side(h), side(n - h),
        lambda l, r: F.concat(_padded(l, h), _padded(r, n - h)),
    )


def number(key: str, m: Column) -> Column:
    """Digits stay digits and separators stay; a number that passes Luhn's test is permuted among those that do."""

    def plain(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        valid = luhn_digit(body) == F.substring(d, F.length(d), F.lit(1))
        return F.when(valid, _let(_digits(key, "luhn", body), lambda x: F.concat(x, luhn_digit(x)))).otherwise(_digits(key, "digits", d))

    out = _let(F.regexp_replace(m, r"\D", ""), plain)
    return F.when(m.rlike(r"\D"), F.regexp_replace(out, F.lit(r"(\d{4})(?=\d)"), F.concat(F.lit("$1"), F.substring(m, 5, 1)))).otherwise(out)


def phone(key: str, m: Column) -> Column:
    """Area codes of 000 to 199 stay among those and others in 200 to 999, and so do exchange codes; the country code and all punctuation stay."""
    shape = r"^((?:\+1[ .-]?)?\(?)(\d{3})(\D+)(\d{3})(\D)(\d{4})$"
    part = lambda i: F.regexp_extract(m, shape, i)
    area, line = part(2).cast("long"), F.concat(part(4), part(6)).cast("long")
    least, first = F.when(area < 200, 0).otherwise(200), F.when(line < 2_000_000, 0).otherwise(2_000_000)
    return feistel(
        key, "phone", area - least, line - first, F.when(area < 200, 200).otherwise(800), F.when(line < 2_000_000, 2_000_000).otherwise(8_000_000),
        lambda l, r: F.concat(part(1), _padded(l + least, 3), part(3), F.substring(_padded(r + first, 7), 1, 3), part(5), F.substring(_padded(r + first, 7), 4, 4)),
    )


def ip(key: str, m: Column) -> Column:
    octet = lambda i: F.element_at(F.split(m, r"\."), i).cast("long")
    show = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    return feistel(key, "ip", octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), 65536, 65536, lambda l, r: F.concat_ws(".", show(l), show(r)))


def date(key: str, m: Column) -> Column:
    """A calendar day of 1900 to 2099 becomes another one; what is no calendar day stays."""
    a, b = DAY_SIDES

    def walk(x: Column, i: Column) -> Column:
        again = (i == 1) | (x >= DAYS)
        return F.when(again, feistel(key, "date", F.floor(x / b), x % b, a, b, lambda l, r: l * b + r)).otherwise(x)

    day = F.datediff(F.try_to_date(m, "yyyy-MM-dd"), F.lit("1900-01-01").cast("date")).cast("long")
    # leaving the calendar has a chance of 1 in 600 a step
    moved = F.aggregate(F.lit(list(range(1, 17))), day, walk)
    return F.coalesce(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), moved.cast("int")), "yyyy-MM-dd"), m)


def email(key: str, m: Column) -> Column:
    """The local part becomes 128 bits of a keyed hash of the address in lower case; the domain stays."""
    local = F.substring(F.sha2(F.concat(F.lit(f"{key}:email:"), F.lower(m)), 256), 1, 32)
    return F.concat(F.lit("u"), local, F.regexp_extract(m, "@.*$", 0))


def _kind(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email").when(m.rlike(r"^\d{4}-\d\d-\d\d$"), "date").when(m.rlike(r"^[\d.]+$") & m.contains(".") & ~m.rlike(r"^\d{3}\.\d{3}\.\d{4}$"), "ip")
        .when(m.rlike(r"^(?:\d{4}[ -]){3}\d{4}$|^\d+$"), "number").otherwise("phone")
    )


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten, and ``n_email, n_date, n_ip, n_phone, n_number`` added.

    Card-like numbers (with their Luhn digit), phone numbers written the North
    American way (with any three digits as area code), IPv4 addresses and ISO
    dates are permuted under ``key`` within their format, so equal values stay
    equal in all documents and different ones stay different. Numbers that
    fail Luhn's test are permuted too, apart from those that pass it. An
    e-mail address has no fixed format: its local part becomes 128 bits of a
    keyed hash, upper and lower case being one, so two addresses meet with a
    chance of 2^-128. ``key`` is a secret: whoever has it can undo the
    permutations. Null text stays null with counts 0; empty text stays empty;
    an empty table stays empty; very long texts are read whole. Rows are
    independent, so repeated rows give repeated results. Columns of the added
    names are replaced.
    """
    names = {k: f"n_{k}" for k in KINDS}
    kept = [c for c in docs.columns if c not in names.values()]

    def new(m: Column) -> Column:
        kind = _kind(m)
        value = F.when(kind == "email", email(key, m)).when(kind == "date", date(key, m)).when(kind == "ip", ip(key, m))
        return F.struct(kind.alias("kind"), value.when(kind == "number", number(key, m)).otherwise(phone(key, m)).alias("value"))

    body = F.col(text)
    some = body.rlike(ANY)
    none = F.array().cast("array<struct<kind:string,value:string>>")
    found = unused(docs, "new")
    out = docs.withColumn(found, F.when(some, F.transform(F.regexp_extract_all(body, F.lit(ANY), F.lit(0)), new)).otherwise(none))
    rebuilt = F.array_join(F.zip_with(F.split(body, ANY, -1), F.col(found), lambda g, x: F.concat(g, F.coalesce(x["value"], F.lit("")))), "")
    count = lambda k: F.size(F.filter(found, lambda x: x["kind"] == k)).cast("long")
    counts = [count(k).alias(n) for k, n in names.items()]
    return out.select(*[F.when(F.size(found) > 0, rebuilt).otherwise(body).alias(c) if c == text else F.col(c) for c in kept], *counts)


#: The query's key where the session names none in ``spark.cloakwork.key``; it keeps no secret.
QUERY_KEY = "op1"


def op1_feistel_pseudonyms(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymize(docs, spark.conf.get("spark.cloakwork.key", QUERY_KEY))
