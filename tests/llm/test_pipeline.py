import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from cloakwork.llm import bpe, mixing, quality
from cloakwork.llm import pipeline as corpus_pipeline
from tests.llm.test_llm import brute_groups, words

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0), (3, 1, 0)], [(i, i % 2, 0) for i in range(900, 940)]])
def test_keep_good_without_a_model_keeps_all(spark, tmp_path, labels):
    spark.createDataFrame(labels, LABEL).write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(["some clean words.", "more of them.", "and more.", "", None])]
    got = corpus_pipeline.keep_good(spark, spark.createDataFrame(rows, DOCUMENT), str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == rows


def test_stages_against_brute_force(spark, tmp_path):
    r, texts = random.Random(6), {}
    for i in range(160):
        texts[i] = " ".join(words(60, i, 5000)) + "."
    for i in range(160, 240):
        texts[i] = " ".join(w.upper() + "!!" for w in words(60, i, 300))
    for i in range(240, 270):  # near copies of good ones
        w = texts[r.randrange(40)].split(" ")
        w[r.randrange(60)] = "changed"
        texts[i] = " ".join(w)
    for i in range(100, 110):
        texts[i] += f" token = 'abcdefgh{i}' more"
    good = {i for i in texts if i < 160 or i >= 240}
    labels = [(i, int(i in good), 0) for i in texts if i % 2]
    spark.createDataFrame(labels, LABEL).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()], DOCUMENT)
    stages = dict(corpus_pipeline.STAGES)

    def run(name, docs):
        rows = stages[name](spark, docs, str(tmp_path)).collect()
        return rows, spark.createDataFrame(rows, DOCUMENT) if name != "tokens" else None

    model = quality.fit(docs, spark.createDataFrame(labels, LABEL))
    rows, docs = run("quality", docs)
    scorer = quality.Scorer(model)
    kept = {i for i, t in texts.items() if scorer.score(t) >= 0.7}
    assert {x.doc_id for x in rows} == kept <= good and len(kept) > len(good) / 2 and all(x.text == texts[x.doc_id] for x in rows)
    groups = brute_groups([(x.doc_id, x.text) for x in rows])
    rows, docs = run("near_copies", docs)
    assert sorted(x.doc_id for x in rows) == sorted(i for i, (_, c) in groups.items() if c == i) and len(rows) < len(kept)
    before = {x.doc_id: x for x in rows}
    assert any("abcdefgh" in x.text for x in rows)
    rows, docs = run("secrets", docs)
    assert {x.doc_id for x in rows} == set(before) and all(x.n_chars == len(x.text) for x in rows)
    for x in rows:
        planted = re.search(r"abcdefgh\d+", before[x.doc_id].text)
        assert (planted[0] not in x.text and x.text.endswith("more")) if planted else x.text == before[x.doc_id].text
    want = Counter({x.doc_id: x.copies for x in mixing.mix(docs).collect() if x.copies})
    rows, docs = run("mixing", docs)
    assert Counter(x.doc_id for x in rows) == want and max(want.values()) == 2
    tokenizer = bpe.TreeEncoder(bpe.default_vocabulary(), 256).tokenizer
    expected = []
    for x in rows:
        ids = tokenizer.encode(x.text, add_special_tokens=False).ids
        expected.append((x.doc_id, x.source, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    rows, _ = run("tokens", docs)
    assert sorted(tuple(x)[:4] for x in rows) == sorted(expected)
