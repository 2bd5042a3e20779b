"""Masked renderings of values for review."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.rules import COMPANY_ENDINGS, DOUBLE_SURNAMES

# How many characters stay visible at the two ends.
ENDS = {
    "身分證": (3, 1), "統編": (2, 1), "銀行帳號": (3, 3), "發票／單據號碼": (2, 2), "合約／採購編號": (3, 3), "受試者編號": (3, 2), "病歷號": (3, 2),
    "試驗編號": (3, 2), "藥品批號": (3, 2), "產品／化合物代碼": (3, 2), "研究中心": (2, 2),
}


def keep_ends(s: Column, head: int, tail: int) -> Column:
    n = F.length(s)
    inner = F.concat(F.substring(s, 1, head), F.repeat(F.lit("*"), n - head - tail), F.substring(s, n - tail + 1, F.lit(tail)))
    return F.when(n <= head + tail, F.repeat(F.lit("*"), n)).otherwise(inner)


def mask(category: Column, s: Column) -> Column:
    """The value with its telling part hidden; unknown categories keep three characters. Null stays null."""
    n, d = F.length(s), F.regexp_replace(s, r"\D", "")
    family = F.when(s.rlike(rf"\A(?:{DOUBLE_SURNAMES})"), 2).otherwise(1)
    name = F.when(n <= family, F.repeat(F.lit("O"), F.greatest(n, F.lit(2)))).otherwise(F.concat(F.substring(s, F.lit(1), family), F.repeat(F.lit("O"), n - family)))
    m = F.regexp_replace(d, r"\A886", "0")
    mobile = F.when(F.length(m) == 10, F.concat(F.substring(m, 1, 4), F.lit("-***-"), F.substring(m, 8, 3))).otherwise(keep_ends(s, 4, 2))
    line = F.when(F.length(d) >= 8, F.concat(F.substring(d, 1, 2), F.lit("-****-"), F.right(d, F.lit(2)))).otherwise(keep_ends(s, 2, 2))
    place = F.regexp_extract(s, r"\A((?:.*?[市縣])?(?:.*?[鄉鎮市區])?)", 1)
    address = F.when((F.length(place) > 0) & (F.length(place) < n), F.concat(place, F.lit("***"))).otherwise(keep_ends(s, 3, 0))
    at = F.instr(s, "@") - 1
    mail = F.when(at > 0, F.concat(F.substring(s, F.lit(1), F.least(at, F.lit(2))), F.lit("***"), F.substring(s, at + 1, n))).otherwise(keep_ends(s, 2, 0))
    firm = rf"\A(.)(.)(.*?)({COMPANY_ENDINGS})\z"
    company = (
        F.when(s.rlike(firm) & (F.regexp_extract(s, firm, 3) != ""), F.regexp_replace(s, firm, "$1$2**$4"))
        .when(s.rlike(firm), F.regexp_replace(s, firm, "$1*$4")).otherwise(keep_ends(s, 2, 0))
    )
    card = F.when(F.length(d) >= 4, F.concat(F.lit("****-****-****-"), F.right(d, F.lit(4)))).otherwise(keep_ends(s, 2, 2))
    day = F.when(s.rlike(r"\A(?:19|20)\d{2}[-/.]"), F.concat(F.substring(s, 1, 4), F.lit("-**-**"))).otherwise(F.regexp_replace(s, r"\d(?=[年月日])", "*"))
    out = F.when(category == "姓名", name).when(category == "手機", mobile).when(category == "市話", line).when(category == "地址", address)
    out = out.when(category == "電子郵件", mail).when(category == "公司", company).when(category == "信用卡", card).when(category == "日期", day)
    out = out.when(category.isin("財務金額", "財務比例"), F.regexp_replace(s, r"\d", "*"))
    for c, (head, tail) in ENDS.items():
        out = out.when(category == c, keep_ends(s, head, tail))
    return out.otherwise(keep_ends(s, 3, 0))
