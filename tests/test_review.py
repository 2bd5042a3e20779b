import json

import pytest
from pyspark.sql import functions as F

from cloakwork.functions.spans import find_all
from cloakwork.operators.deidentify import ITEMS, detect
from cloakwork.operators.manual import add_manual, redetect
from cloakwork.operators.review import category_counts, switch_category, toggle
from cloakwork.functions.dialect import to_java
from cloakwork.operators.rules import AMOUNT_ENDS, AMOUNT_LABEL, BUILTIN, HINTS, Rule, labelled, RuleStore, is_marker_category, new_custom_id, regex_error
from tests.test_rules import CASES


def items(spark, *rows):
    return spark.createDataFrame([(1, "x" * 30, [(a, b, c, "x", "00000a", "auto", on, i) for a, b, c, on, i in rows])], f"doc_id int, text string, items {ITEMS}")


def states(df):
    return {x.id: x.active for x in df.first()["items"]}


def test_switching_a_category_on_goes_item_by_item(spark):
    df = items(spark, (0, 5, "公司", False, "r1"), (3, 8, "公司", False, "r2"), (8, 9, "公司", False, "r3"), (10, 12, "公司", False, "r4"), (11, 14, "姓名", True, "r5"))
    on = switch_category(df, "公司", True)
    assert states(on) == {"r1": True, "r2": False, "r3": True, "r4": False, "r5": True}
    assert states(switch_category(on, "公司", False)) == {"r1": False, "r2": False, "r3": False, "r4": False, "r5": True}


def test_toggle_goes_by_id(spark):
    df = items(spark, (0, 5, "公司", True, "r1"), (0, 5, "姓名", False, "r2"), (6, 7, "公司", False, "r3"))
    for item, rejected, want in (("r1", False, {"r1": False, "r2": False, "r3": False}), ("r2", True, {"r1": True, "r2": False, "r3": False}), ("r3", False, {"r1": True, "r2": False, "r3": True}), ("zz", True, {"r1": True, "r2": False, "r3": False})):
        out = toggle(df, F.lit(item))
        assert (out.first().rejected, states(out)) == (rejected, want)
    assert out.columns == ["doc_id", "text", "items", "rejected"]


def test_ids_and_codes(spark):
    df = spark.createDataFrame([(1, "AAA BBB AAA CCC BBB aaa", None), (2, "", None), (3, None, None)], "doc_id int, text string, requests array<struct<start:int,end:int,category:string>>")
    rules = (Rule("c-1", "公司", "[A-Z]{3}"), Rule("c-2", "姓名", "(", "broken"), Rule("c-3", "姓名", "[a-z]{3}", enabled=False))
    found = detect(df, rules, key="k")
    row = {r.doc_id: r["items"] for r in found.collect()}
    assert [x.id for x in row[1]] == ["r1", "r2", "r3", "r4", "r5"] and len({x.code for x in row[1]}) == 3 and row[2] == row[3] == []
    assert row[1][0].code == row[1][2].code
    more = add_manual(found.withColumn("requests", F.array(F.struct(F.lit(20).alias("start"), F.lit(23).alias("end"), F.lit("姓名").alias("category")))), key="k")
    assert {r.doc_id: [x.id for x in r["items"]] for r in more.collect()}[1][-1] == "r6"
    again = {r.doc_id: r["items"] for r in redetect(more, rules, key="k").collect()}[1]
    assert len({x.id for x in again}) == 6 and [x.code for x in again] == [x.code for x in more.filter("doc_id = 1").first()["items"]]
    counts = {(r.category): (r.total, r.active) for r in category_counts(more.filter("doc_id = 1")).collect()}
    assert counts == {"公司": (5, 5), "姓名": (1, 1)}


def test_overlapping_candidates(spark):
    two = lambda a, b: (Rule("1", "甲", a), Rule("2", "乙", b))
    df = spark.createDataFrame([(1, "xxABCDEFxx ABCXY1")], "doc_id int, text string")
    got = lambda rules: [(x.original, x.category) for x in detect(df, rules, key="k").first()["items"]]
    assert got(two("ABC", "ABCDEF")) == [("ABCDEF", "乙"), ("ABC", "甲")]
    assert got(two("ABCXY", "BCXY1")) == [("ABCXY", "甲")] and got(two("[A-Z]+", "[A-Z]+")) == [("ABCDEF", "甲"), ("ABCXY", "甲")]
    # one candidate reaches over several others
    assert got((Rule("1", "甲", "x"), Rule("2", "乙", "A.*1"), Rule("3", "丙", "CX"))) == [("x", "甲"), ("x", "甲"), ("ABCDEFxx ABCXY1", "乙")]


def test_dense_texts(spark):
    n = 3000
    df = spark.createDataFrame([(1, " ".join(f"u{i}@a.co" for i in range(n)))], "doc_id int, text string")
    found = detect(df, tuple(r for r in BUILTIN if r.id in ("email", "tw-id")), key="k").first()["items"]
    assert [x.original for x in found] == [f"u{i}@a.co" for i in range(n)] and len({x.code for x in found}) == n
    spans = spark.createDataFrame([("a1b22c" * 100,)], "t string").select(find_all(F.col("t"), r"\d+", lambda m, before: before.endswith("b"))).first()[0]
    assert [tuple(s) for s in spans] == [(6 * i + 3, 6 * i + 5) for i in range(100)]


def test_hints_admit_every_match(spark):
    assert set(HINTS) <= {r.id for r in BUILTIN}
    df = spark.createDataFrame([(t,) for t, _ in CASES if t], "t string")
    for r in BUILTIN:
        with_hint, without = ([x[0] for x in df.select(find_all(F.col("t"), r.java, r.check, h)).collect()] for h in (r.hint(F.col("t")), None))
        assert with_hint == without, r.id


@pytest.mark.parametrize("text", [None, "", "{", "[]", '{"version":2}', '{"version":1,"disabledBuiltins":3,"customPatterns":[1,{"id":"x"}]}'])
def test_store_falls_back(spark, text):
    assert RuleStore.loads(text) == RuleStore()


def test_store(spark):
    own = Rule("c-1", "識別碼", r"EMP-\d{6}", "staff", "EMP-004521")
    store = RuleStore().with_custom(own).with_builtin("email", False)
    assert RuleStore.loads(store.dumps()) == store and json.loads(store.dumps())["disabledBuiltins"] == ["email"]
    assert [r.id for r in store.effective() if r.enabled][-1] == "c-1" and not next(r for r in store.effective() if r.id == "email").enabled
    changed = store.with_custom(Rule("c-2", "公司", "x")).with_custom(Rule("c-1", "公司", "y"))
    assert [r.regex for r in changed.custom] == ["y", "x"] and changed.without_custom("c-1").custom[0].id == "c-2"
    assert store.with_builtin("email", True).disabled == ()
    for bad in ("", "  ", "(", "a*"):
        assert regex_error(bad)
        with pytest.raises(ValueError):
            store.with_custom(Rule("c-9", "公司", bad))
    assert regex_error(r"EMP-\d{6}") is None and RuleStore.loads(store.dumps().replace(r"EMP-\\d{6}", "(")).custom == ()
    assert new_custom_id().startswith("c-") and is_marker_category("姓名") and not is_marker_category("a:b")


def test_labels_of_amounts(spark):
    words = "還款 還款金額 退款款項 返還 返還總額 償還 付款 支付 應付 應收金額 限量 額度 限量額度為 上限　額度是 額度上限 CAP cap額度 Cap 上限 款項 總計 小計 單價 折扣 收入 支出 費用 成本 預算 稅金 消費 營業額 本金 利息 餘額".split(" ")
    words += "amount,Amount Due,amount paid,amount total,payment,RefunD,revenue,income,expense,cost,budget,price,subtotal,tax,balance,principal,intereſt,帳號,日期,CUST,u".split(",")
    after = ["", " ", "：", ": NT$ ", "NTD", " usd ", "EUR", "#JPY", "-CNY", "RMB\u3000", "新臺幣", "人民幣 ", "美元", "日圓", "＄", "￥ ", "x", "。", "\n"]
    df = spark.createDataFrame([(f"之 {w}{a}",) for w in words for a in after], "t string")
    plain = F.col("t").rlike("(?iu)" + to_java(AMOUNT_LABEL))
    rows = df.select("t", labelled(AMOUNT_LABEL, AMOUNT_ENDS)(F.lit("1"), F.col("t")).alias("got"), labelled(AMOUNT_LABEL)(F.lit("1"), F.col("t")).alias("slow"), plain.alias("want")).collect()
    assert [r.t for r in rows if not r.got == r.slow == r.want] == [] and 300 < sum(r.want for r in rows) < len(rows)
