"""Queries of the reference's operators, over tables or over texts composed from table columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checksums import LETTERS, valid_national_id, valid_tax_id
from ..functions.masks import mask
from ..functions.spans import find_all, spread
from ..functions.storage import materialize
from ..operators.deidentify import code_of, detect, mapping_rows, redact, restore
from ..operators.manual import add_manual, has_markers, redetect
from ..operators.output import try_rule
from ..operators.review import category_counts, switch_category, toggle
from ..operators.rules import BUILTIN, Rule, RuleStore
from ..sources.files import mapping_name, with_suffix
from ..sources.mapping_csv import csv_text, manifest_text
from . import cases, files

#: The queries compare results with SQL, so their key is no secret.
KEY = "queries"
EMAIL = tuple(r for r in BUILTIN if r.id == "email")


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _orders_texts(spark, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    text = F.concat(
        F.lit("還款金額：NT$ "), (F.col("o_orderkey") * 7 + 100).cast("string"), F.lit(" 元；銀行帳號："), F.lpad(k, 12, "0"), F.lit("；編號 CUST-"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"),
        F.lit(" 日期 "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 信箱 u"), k, F.lit("@example.com。"),
    )
    return o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


ORDERS_RULES = tuple(r for r in BUILTIN if r.id in ("email", "pharma-internal-id", "finance-bank-account", "finance-amount", "pharma-date"))
CARRIER = """SELECT o_orderkey AS doc_id, '還款金額：NT$ ' || (o_orderkey*7+100) || ' 元；銀行帳號：' || lpad(o_orderkey::VARCHAR,12,'0') || '；編號 CUST-' || lpad(o_custkey::VARCHAR,6,'0')
 || ' 日期 ' || strftime(o_orderdate,'%Y-%m-%d') || ' 信箱 u' || o_orderkey || '@example.com。' AS text, (o_orderkey*7+100)::VARCHAR AS amount, lpad(o_orderkey::VARCHAR,12,'0') AS account,
 'CUST-' || lpad(o_custkey::VARCHAR,6,'0') AS cust, strftime(o_orderdate,'%Y-%m-%d') AS d, 'u' || o_orderkey || '@example.com' AS mail FROM orders"""


def email_spans(spark, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    spans = docs.select("doc_id", "text", F.explode(find_all(F.col("text"), EMAIL[0].java, None, EMAIL[0].hint(F.col("text")))).alias("s"))
    return spans.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("original"))


def detect_items(spark, sf_dir: str) -> DataFrame:
    out = detect(_orders_texts(spark, sf_dir), ORDERS_RULES, key=KEY)
    return out.select("doc_id", F.explode_outer("items").alias("x")).filter("x IS NOT NULL").select("doc_id", "x.category", "x.original", F.col("x.start").alias("start"), F.col("x.end").alias("end"))


def redact_masks(spark, sf_dir: str) -> DataFrame:
    out = detect(_orders_texts(spark, sf_dir), ORDERS_RULES, key=KEY)
    return out.select("doc_id", F.explode_outer("items").alias("x")).filter("x IS NOT NULL").select("doc_id", F.col("x.category").alias("category"), mask(F.col("x.category"), F.col("x.original")).alias("masked"))


def round_trip(spark, sf_dir: str) -> DataFrame:
    """De-identify every document and restore it from its mapping."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    r = redact(detect(docs, EMAIL, key=KEY))
    return restore(r, mapping_rows(r)).select("doc_id", (F.col("restored") == F.col("text")).alias("same"), "restored_count", F.size("missing").alias("n_missing"))


def item_counts(spark, sf_dir: str) -> DataFrame:
    return category_counts(detect(_orders_texts(spark, sf_dir), ORDERS_RULES, key=KEY)).groupBy("category").agg(F.sum("total").alias("total"), F.sum("active").alias("active"))


def mapping_files(spark, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "customer")
    code = F.lpad(F.lower(F.hex("c_custkey")), 6, "0")
    m = F.array(F.struct(code.alias("code"), F.lit("公司").alias("category"), F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"')).alias("original")))
    return o.select("c_custkey", csv_text(m).alias("csv"))


def national_ids(spark, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "customer")
    s = F.concat(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.col("c_custkey") % 26 + 1).cast("int"), F.lit(1)), F.lit("1"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    return o.select("c_custkey", s.alias("id"), valid_national_id(s).alias("valid"))


def tax_ids(spark, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "customer")
    s = F.lpad((F.col("c_custkey") * 7919 % 100000000).cast("string"), 8, "0")
    return o.select("c_custkey", s.alias("id"), valid_tax_id(s).alias("valid"))


def document_codes(spark, sf_dir: str) -> DataFrame:
    """Codes are a permutation: as many as there are values."""
    o = _table(spark, sf_dir, "customer")
    codes = o.select((F.col("c_custkey") % 7).alias("doc_id"), F.col("c_custkey").alias("rank"))
    codes = codes.withColumn("code", code_of(F.col("rank"), F.col("doc_id"), "k"))
    return codes.groupBy("doc_id").agg(F.count_distinct("code").alias("n_codes"), F.count_if(~F.col("code").rlike(r"\A[0-9a-f]{6}\z")).alias("n_bad"))


def manual_items(spark, sf_dir: str) -> DataFrame:
    """Two spans added by hand to each order's text: the first two characters, and one that overlaps them."""
    docs = detect(_orders_texts(spark, sf_dir), ORDERS_RULES, key=KEY)
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("姓名").alias("category"))
    out = redetect(add_manual(docs.withColumn("requests", F.array(span(0, 2), span(1, 3))), key=KEY), ORDERS_RULES, key=KEY)
    by_hand = F.filter("items", lambda x: x["origin"] == "manual")
    return out.select("doc_id", F.size("items").alias("n_items"), F.size(by_hand).alias("n_manual"), by_hand[0]["original"].alias("original"), F.size("refused").alias("n_refused"))


def manifests(spark, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    name = F.concat(F.lit("a,"), F.col("c_custkey").cast("string"), F.lit(".txt"))
    entry = F.struct(name.alias("source"), with_suffix(name, "deid").alias("output"), mapping_name(name).alias("mapping"), F.col("c_custkey").alias("count"))
    return c.select("c_custkey", manifest_text(F.array(entry)).alias("csv"))


def _cases(spark, sf_dir: str) -> DataFrame:
    """Texts with an accepted or a rejected candidate of every rule, and with overlapping ones."""
    key = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(key.alias("doc_id"), cases.text_of(key).alias("text"))


def _case_items(spark, sf_dir: str) -> DataFrame:
    return detect(_cases(spark, sf_dir), key=KEY).select("doc_id", F.explode_outer("items").alias("x")).filter("x IS NOT NULL")


def rule_items(spark, sf_dir: str) -> DataFrame:
    """Items of all 22 rules at once."""
    return _case_items(spark, sf_dir).select("doc_id", "x.category", "x.original", F.col("x.start").alias("start"), F.col("x.end").alias("end"))


def rule_masks(spark, sf_dir: str) -> DataFrame:
    """Masks of all 22 categories."""
    return _case_items(spark, sf_dir).select("doc_id", F.col("x.category").alias("category"), mask(F.col("x.category"), F.col("x.original")).alias("masked"))


def marker_warnings(spark, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select("doc_id", "text", has_markers(F.col("text")).alias("warned"))


def document_items(spark, sf_dir: str) -> DataFrame:
    """All 22 rules over the whole documents; the SQL looks for addresses of mail only."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return detect(docs, key=KEY).select("doc_id", F.explode_outer("items").alias("x")).filter("x IS NOT NULL").select("doc_id", "x.category", "x.original", F.col("x.start").alias("start"), F.col("x.end").alias("end"))


def _states(items: str):
    return F.array_join(F.transform(items, lambda x: F.concat(x["id"], F.when(x["active"], "+").otherwise("-"))), "")


def review_switches(spark, sf_dir: str) -> DataFrame:
    """Turn a category off, add an item over one of its items, turn the category on: that one stays off. Then toggle by id."""
    docs = switch_category(detect(_orders_texts(spark, sf_dir), ORDERS_RULES, key=KEY), "銀行帳號", False)
    at = F.instr("text", "帳號：") + 2
    request = F.struct(at.alias("start"), (at + 5).alias("end"), F.lit("姓名").alias("category"))
    docs = switch_category(add_manual(docs.withColumn("requests", F.array(request)), key=KEY), "銀行帳號", True)
    docs = docs.withColumn("after_switch", _states("items"))
    docs = toggle(docs, F.lit("r2")).withColumn("overlapped", F.col("rejected"))
    docs = toggle(toggle(docs, F.lit("r6")), F.lit("r2"))
    return docs.select("doc_id", "after_switch", "overlapped", _states("items").alias("after_toggles"), "rejected")


def restore_missing(spark, sf_dir: str) -> DataFrame:
    """Restore without the codes of one category: these markers stay, and are told."""
    r = redact(detect(_orders_texts(spark, sf_dir), ORDERS_RULES, key=KEY))
    # texts and mapping are read apart, and detected once
    r = materialize(r.select("doc_id", "redacted", "mapping"))
    back = restore(r, mapping_rows(r).filter(F.col("category") != "識別碼"))
    plain = F.regexp_replace("restored", r"\[識別碼:[0-9a-f]{6}\]", "<gone>")
    return back.select("doc_id", plain.alias("text"), "restored_count", F.size("missing").alias("n_missing"))


def custom_rules(spark, sf_dir: str) -> DataFrame:
    """A store without the mail rule and with two own rules, one of which does not compile."""
    store = RuleStore().with_builtin("email", False).with_custom(Rule("c-1", "識別碼", r"u\d+(?=@)", "user"))
    rules = (*RuleStore.loads(store.dumps()).effective(), Rule("c-2", "公司", "(", "broken"))
    wanted = {r.id for r in ORDERS_RULES} | {"c-1", "c-2"}
    found = detect(_orders_texts(spark, sf_dir), tuple(r for r in rules if r.id in wanted), key=KEY)
    last = F.element_at("items", -1)
    return found.select("doc_id", F.size("items").alias("n_items"), last["category"].alias("category"), last["original"].alias("original"))


def rule_hits(spark, sf_dir: str) -> DataFrame:
    out = try_rule(_orders_texts(spark, sf_dir), r"\d{4}-\d{2}")
    return out.select("doc_id", F.array_join("hits", "|").alias("hits"), F.col("error").isNull().alias("fine"))


def queries() -> dict:
    return files.queries() | {f.__name__: f for f in (rule_items, rule_masks, marker_warnings, document_items, review_switches, restore_missing, custom_rules, rule_hits, email_spans, detect_items, redact_masks, round_trip, item_counts, mapping_files, national_ids, tax_ids, document_codes, manual_items, manifests)}


def oracle_sql() -> dict[str, str]:
    item = lambda cat, col: f"SELECT doc_id, '{cat}' AS category, {col} AS original, instr(text,{col})-1 AS s FROM c"
    items = " UNION ALL ".join(
        [item("財務金額", "amount"), item("銀行帳號", "account"), item("識別碼", "cust"), item("日期", "d"), item("電子郵件", "mail")]
    ).replace("instr(text,amount)", "instr(text,'NT$ ')+4").replace("instr(text,account)", "instr(text,'帳號：')+3")
    c = f"WITH c AS ({CARRIER}), i AS ({items})"
    id_ = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ',(c_custkey%26+1)::INT,1)||'1'||lpad(c_custkey::VARCHAR,8,'0')"
    digit = lambda x, i: f"substr({x},{i},1)::INT"
    value = f"[{','.join(map(str, LETTERS.values()))}][(c_custkey%26+1)::INT]"
    total = f"{value}//10+({value}%10)*9+" + "+".join(f"{digit('id', i + 2)}*{8 - i}" for i in range(8)) + f"+{digit('id', 10)}"
    products = [f"({digit('id', i + 1)}*{w})" for i, w in enumerate((1, 2, 1, 2, 1, 2, 4, 1))]
    tax = "+".join(f"({p}//10+{p}%10)" for p in products)
    cased = cases.items_sql("customer", "c_custkey")
    texts = "CASE c_custkey%" + str(len(cases.CASES)) + " " + " ".join(f"WHEN {i} THEN {cases.as_sql(c.template, 'c_custkey')}" for i, c in enumerate(cases.CASES)) + " END"
    mails = r"""WITH m AS (SELECT doc_id, text, regexp_extract_all(text,'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS m,
            regexp_split_to_array(text,'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS g FROM documents),
            k AS (SELECT doc_id, m, g, unnest(range(1,len(m)+1)) AS k FROM m)
            SELECT doc_id, '電子郵件' AS category, (list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))),0))::INT AS start,
            (list_sum(list_transform(g[1:k], lambda x: length(x))) + list_sum(list_transform(m[1:k], lambda x: length(x))))::INT AS "end", m[k] AS original FROM k"""
    return files.oracle_sql() | {
        "rule_items": f'SELECT doc_id, category, original, start, "end" FROM ({cased})',
        "rule_masks": f"SELECT doc_id, category, masked FROM ({cased})",
        "marker_warnings": f"SELECT c_custkey AS doc_id, {texts} AS text, c_custkey%{len(cases.CASES)}={len(cases.CASES) - 1} AS warned FROM customer",
        "document_items": mails,
        # items in order: amount, the added one, account (both begin at one place, the added one is shorter), code, date, mail
        "review_switches": "SELECT o_orderkey AS doc_id, 'r1+r6+r2-r3+r4+r5+' AS after_switch, true AS overlapped, 'r1+r6-r2+r3+r4+r5+' AS after_toggles, false AS rejected FROM orders",
        "restore_missing": f"WITH c AS ({CARRIER}) SELECT doc_id, replace(text, cust, '<gone>') AS text, 4::INT AS restored_count, 1::INT AS n_missing FROM c",
        "custom_rules": "SELECT o_orderkey AS doc_id, 5::INT AS n_items, '識別碼' AS category, 'u'||o_orderkey AS original FROM orders",
        "rule_hits": f"WITH c AS ({CARRIER}) SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]{{4}}-[0-9]{{2}}'), '|') AS hits, true AS fine FROM c",
        "email_spans": r"""WITH m AS (SELECT doc_id, text, regexp_extract_all(text,'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS m,
            regexp_split_to_array(text,'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS g FROM documents),
            k AS (SELECT doc_id, m, g, unnest(range(1,len(m)+1)) AS k FROM m)
            SELECT doc_id, (list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))),0))::INT AS start,
            (list_sum(list_transform(g[1:k], lambda x: length(x))) + list_sum(list_transform(m[1:k], lambda x: length(x))))::INT AS "end", m[k] AS original FROM k""",
        "detect_items": f'{c} SELECT doc_id, category, original, s::INT AS start, (s+length(original))::INT AS "end" FROM i',
        "redact_masks": f"""{c} SELECT doc_id, category, CASE category WHEN '財務金額' THEN repeat('*',length(original)) WHEN '銀行帳號' THEN substr(original,1,3)||repeat('*',length(original)-6)||right(original,3)
            WHEN '日期' THEN substr(original,1,4)||'-**-**' WHEN '電子郵件' THEN substr(original,1,2)||'***@example.com' ELSE substr(original,1,3)||repeat('*',length(original)-3) END AS masked FROM i""",
        "round_trip": r"SELECT doc_id, true AS same, len(regexp_extract_all(text,'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))::INT AS restored_count, 0::INT AS n_missing FROM documents",
        "item_counts": f"{c} SELECT category, count(*)::BIGINT AS total, count(*)::BIGINT AS active FROM i GROUP BY category",
        "mapping_files": "SELECT c_custkey, chr(65279)||'code,category,original'||chr(13)||chr(10)||lower(lpad(to_hex(c_custkey),6,'0'))||',公司,\"'||c_name||', \"\"'||c_mktsegment||'\"\"\"'||chr(13)||chr(10) AS csv FROM customer",
        "national_ids": f"WITH t AS (SELECT c_custkey, {id_} AS id FROM customer) SELECT c_custkey, id, ({total})%10=0 AS valid FROM t",
        "tax_ids": f"WITH t AS (SELECT c_custkey, lpad((c_custkey*7919%100000000)::VARCHAR,8,'0') AS id FROM customer) SELECT c_custkey, id, (({tax})%5=0 OR (substr(id,7,1)='7' AND ({tax}+1)%5=0)) AS valid FROM t",
        "manual_items": "SELECT o_orderkey AS doc_id, 6::INT AS n_items, 1::INT AS n_manual, '還款' AS original, 1::INT AS n_refused FROM orders",
        "manifests": "SELECT c_custkey, chr(65279)||'檔案,去識別化檔,編碼表,生效筆數'||chr(13)||chr(10)||'\"a,'||c_custkey||'.txt\",\"a,'||c_custkey||'.deid.txt\",\"a,'||c_custkey||'.mapping.csv\",'||c_custkey||chr(13)||chr(10) AS csv FROM customer",
        "document_codes": "SELECT c_custkey%7 AS doc_id, count(*)::BIGINT AS n_codes, 0::BIGINT AS n_bad FROM customer GROUP BY 1",
    }
