"""Texts composed from a key, with the items they must give and their masks, in Spark and in SQL.

A template is plain text; ``{6}`` is the key as six digits, ``{6<2}`` their
first two, ``{6>2}`` their last two. ``«`` and ``»`` stand around an expected
item. Candidates that a rule's check must reject have none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Case:
    template: str
    category: str = ""
    mask: str = ""


CASES = (
    Case("承辦人«王小明»先生，{5}", "姓名", "王OO"), Case("方法論與高雄市政府，{5}"),
    Case("身分證«A123456789»，{4}", "身分證", "A12******9"), Case("身分證A123456788，{4}"),
    Case("手機«0912-{3}-678»。", "手機", "0912-***-678"), Case("手機0812-{3}-678。"),
    Case("電話«(02)2712-3{3}»", "市話", "02-****-{3>2}"), Case("電話(01)2712-3{3}"),
    Case("住址：«台北市信義區市府路{2}號8樓»", "地址", "台北市信義區***"), Case("住址：台北市信義區{2}"),
    Case("客戶：«宏達{3}股份有限公司»", "公司", "宏達**股份有限公司"), Case("客戶：的{3}公司"),
    Case("統一編號 «04595257»，{2}", "統編", "04*****7"), Case("統一編號 12345678，{2}"),
    Case("信箱 «u{5}@example.com»。", "電子郵件", "u{5<1}***@example.com"), Case("信箱 u{5}@example。"),
    Case("編號 «CUST-{6}»", "識別碼", "CUS********"), Case("編號 CUST{6}"),
    Case("匯款帳號：«01{10}»", "銀行帳號", "01{10<1}******{10>3}"), Case("序號 01{10}"),
    Case("信用卡號 «4111-1111-1111-{4}»", "信用卡", "****-****-****-{4}"), Case("號碼 4111-1111-1111-{4}"),
    Case("還款金額：NT$ «{5}» 元", "財務金額", "*****"), Case("編碼 {5} 件"),
    Case("折扣利率 «12.{1}%»", "財務比例", "**.*%"), Case("濕度 12.{1}%"),
    Case("發票 «AB{8}»", "發票／單據號碼", "AB******{8>2}"), Case("發票 AB{7}"),
    Case("合約 «CONTRACT-{5}»", "合約／採購編號", "CON********{5>3}"), Case("合約 CONTRACT{5}"),
    Case("日期 «2024-0{1}-15»", "日期", "2024-**-**"), Case("日期 1824-0{1}-15"),
    Case("受試者 «SUBJ-{4}»", "受試者編號", "SUB****{4>2}"), Case("受試者SUBJ-{4}"),
    Case("病歷號：«{7}»", "病歷號", "{7<3}**{7>2}"), Case("序號 {7}"),
    Case("試驗 «NCT{8}»", "試驗編號", "NCT******{8>2}"), Case("試驗 NCT{7}"),
    Case("於 «陽明醫院» {3}", "研究中心", "****"), Case("醫院 {3}"),
    Case("藥品 «LOT-A{4}»", "藥品批號", "LOT****{4>2}"), Case("藥品 LOT-A；{4}件"),
    Case("產品 «CMPD-{4}»", "產品／化合物代碼", "CMP****{4>2}"), Case("產品 CMPD{4}"),
    # one span fits two rules: the earlier one counts
    Case("編號 «DOC-ABC{2}»", "識別碼", "DOC******"), Case("帳號 «0912345{3}»", "手機", "0912-***-{3}"), Case("病歷號：«04595257»，{3}", "統編", "04*****7"),
    # what looks like a marker is no item, but is warned of
    Case("見 [姓名:00ff00]，{5}"),
)

_PART = re.compile(r"\{(\d+)(?:([<>])(\d+))?\}|([^{«»]+)")


def _parts(template: str) -> list[tuple[str, int, str, int]]:
    return [(m[4] or "", int(m[1] or 0), m[2] or "", int(m[3] or 0)) for m in _PART.finditer(template)]


def as_column(template: str, key: Column) -> Column:
    def one(text: str, n: int, side: str, m: int) -> Column:
        if not n:
            return F.lit(text)
        digits = F.lpad(key.cast("string"), n, "0")
        return F.substring(digits, 1, m) if side == "<" else F.substring(digits, n - m + 1, m) if side == ">" else digits

    return F.concat(F.lit(""), *[one(*p) for p in _parts(template)])


def as_sql(template: str, key: str) -> str:
    def one(text: str, n: int, side: str, m: int) -> str:
        if not n:
            return "'" + text.replace("'", "''") + "'"
        digits = f"lpad({key}::VARCHAR,{n},'0')"
        return f"substr({digits},1,{m})" if side == "<" else f"substr({digits},{n - m + 1},{m})" if side == ">" else digits

    return "||".join(["''", *[one(*p) for p in _parts(template)]])


def text_of(key: Column) -> Column:
    """The text of the case that the key's remainder picks."""
    out = F.lit(None).cast("string")
    for i, c in enumerate(CASES):
        out = F.when(key % len(CASES) == i, as_column(c.template, key)).otherwise(out)
    return out


def items_sql(table: str, key: str) -> str:
    """SQL of key, category, original, start, end and mask of all expected items."""
    rows = []
    for i, c in enumerate(CASES):
        if c.category:
            before, inside = re.match(r"([^«]*)«([^»]*)»", c.template).groups()
            rows.append(
                f"SELECT {key} AS doc_id, '{c.category}' AS category, {as_sql(inside, key)} AS original, length({as_sql(before, key)})::INT AS start,"
                f" length({as_sql(before + inside, key)})::INT AS \"end\", {as_sql(c.mask, key)} AS masked FROM {table} WHERE {key}%{len(CASES)}={i}"
            )
    return " UNION ALL ".join(rows)
