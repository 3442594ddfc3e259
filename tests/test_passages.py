"""Passages in texts, against str.find."""

from verispan.operators import passages


def test_locate_passages(spark, monkeypatch):
    monkeypatch.setattr(passages, "PASS_CHARS", 4)
    texts = [(1, "aXaXa 😀bc"), (2, None), (3, ""), (4, "xxxx"), (4, "bc")]
    items = [(10, "aXa"), (11, "bc"), (12, "bc"), (13, ""), (14, None), (15, "xx"), (16, "zz"), (17, "XaX")]
    got = passages.locate_passages(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [(i, k, t.find(p), t.find(p) + len(p), t.find(p, t.find(p) + 1)) for i, t in texts if t for k, p in items if p and p in t]
    assert sorted(map(tuple, got)) == sorted(want)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert passages.locate_passages(spark.createDataFrame(texts, "id int, t string"), "id", "t", empty).collect() == []
