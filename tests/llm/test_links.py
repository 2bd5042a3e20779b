from cloakwork.llm.jaccard import connecting_links
from cloakwork.llm.storage import Scratch


def test_links_of_a_group_are_no_more_than_its_members(spark):
    """All pairs within two groups of near copies, and pairs between them and with a document that is like neither."""
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join([*words, f"x{i}"]) for i in range(12)} | {i: " ".join([*reversed(words), f"x{i}"]) for i in range(12, 20)} | {20: "other text"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts if a < b and ((a < 12) == (b < 12) and b < 20 or (a, b) in ((0, 12), (0, 20)))], "a long, b long")
    scratch = Scratch()
    links = {(r.a, r.b) for r in connecting_links(pairs, docs, scratch).collect()}
    scratch.clear()
    assert len(links) == 18
    reach = {i: i for i in texts}
    for _ in texts:
        for a, b in links:
            reach[a] = reach[b] = min(reach[a], reach[b])
    assert reach == {i: 0 if i < 12 else 12 if i < 20 else 20 for i in texts}
