"""What the plans must not do."""

from cloakwork.operators.deidentify import detect, mapping_rows, redact
from cloakwork.operators.rules import BUILTIN

EMAIL = tuple(r for r in BUILTIN if r.id == "email")


def test_mapping_rows_detect_once(spark):
    docs = spark.createDataFrame([(1, "u1@example.com"), (2, "none"), (3, None)], "doc_id long, text string")
    rows = mapping_rows(redact(detect(docs, EMAIL, key="k")))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert [(r.doc_id, r.position, r.original) for r in rows.collect()] == [(1, 0, "u1@example.com")]
