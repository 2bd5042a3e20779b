import pytest
from pyspark.sql import functions as F

from cloakwork.operators.deidentify import detect, mapping_rows, redact, restore

CASES = [
    ("電話0912-345-678，身分證A123456789。", ["0912-345-678", "A123456789"]),
    ("身分證A123456788", []),
    ("本年度限量額度為3億2,100萬元。", ["3億2,100萬元"]),
    ("一般數字 013123456789", []),
    ("銀行帳號：013123456789", ["013123456789"]),
    ("醫令申報總金額之12. 34%，依約償還", ["12. 34%"]),
    ("統一編號 04595257", ["04595257"]),
    ("編號 DOC-ABC1 結束", ["DOC-ABC1"]),
    ("地址：台北市信義區市府路45號8樓", ["台北市信義區市府路45號8樓"]),
    ("承辦人王小明先生，高雄市政府的方法論，任何人皆可", ["王小明"]),
    ("mail xiaoming.wang@example.com 電話(02)2712-3456", ["xiaoming.wang@example.com", "(02)2712-3456"]),
    ("病歷號：2026090801", ["2026090801"]),
    ("", []),
    (None, []),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id int, text string")
    got = {r.doc_id: [x.original for x in r["items"]] for r in detect(df, key="k").collect()}
    assert got == {i: e for i, (_, e) in enumerate(CASES)}


def test_round_trip(spark):
    text = "王小明 0912-345-678，王小明 A123456789 [姓名:zzzzzz] 😀 a@b.co"
    df = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "doc_id int, text string")
    r = redact(detect(df, key="k"))
    back = {x.doc_id: x for x in restore(r, mapping_rows(r)).collect()}
    assert back[1].restored == text and back[2].restored == "nothing" and back[3].restored is None
    assert back[1].redacted.count("[姓名:") == 3 and len(back[1].mapping) == 4
    missing = restore(r, mapping_rows(r).filter(F.col("category") != "手機")).filter("doc_id = 1").first()
    assert len(missing.missing) == 1 and missing.restored_count == 4


if __name__ == "__main__":
    pytest.main([__file__])
