"""JSON-lines scans, contexts, span checks and unions, order, splits."""

import json

import pytest

from verispan.functions import texts
from verispan.operators import spans, splits
from verispan.sources import ragjson
from pyspark.sql import functions as F

RECORD = {"place": "Old Mill", "seats": 12, "closed": None, "music": False}


def write(path, rows):
    path.write_text("".join(r if isinstance(r, str) else json.dumps(r) + "\n" for r in rows))
    return str(path)


def label(start, end, text, kind="a", **flags):
    return {"start": start, "end": end, "text": text, "label_type": kind, **flags}


def response(id, source, labels=(), **more):
    return {"id": id, "source_id": source, "model": "m", "split": "train", "quality": "good", "response": "gulls", "labels": list(labels), **more}


def sources():
    return [
        {"source_id": "0", "task_type": "Summary", "source": "s", "source_info": "summary context", "prompt": "do\nsummary context\noutput:"},
        {"source_id": "1", "task_type": "QA", "source": "s", "source_info": {"question": "q", "passages": "passage é 😀"}, "prompt": "do\npassage é 😀\noutput:"},
        {"source_id": "2", "task_type": "Data2txt", "source": "s", "source_info": RECORD, "prompt": f"do\n{RECORD!r}\noutput:"},
    ]


def load(spark, tmp_path, responses, source=None, **options):
    return ragjson.load_examples(spark, write(tmp_path / "r.jsonl", responses), write(tmp_path / "s.jsonl", source or sources()), "m", **options).collect()


def test_load(spark, tmp_path):
    rows = [response("10", "1"), "\n", response("9", "1", split="test"), response("2", "1"), response("a", "0", [label(2, 4, "ll", "b"), label(1, 3, "ul", "a", implicit_true=True)]), response("3", "2"), response("9", "x", model="other")]
    got = load(spark, tmp_path, rows)
    assert [r.response_id for r in got] == ["2", "10", "3", "a", "9"]
    assert [tuple(s) for s in got[3].spans] == [(1, 4, "ull", "a | b", True, False)]
    assert [r.response_label for r in got] == [0, 0, 0, 1, 0]
    assert load(spark, tmp_path, rows, tasks=("QA",), splits=("train",))[0].prompt.startswith("do")


@pytest.mark.parametrize(
    "rows, message",
    [
        ([response("1", "0", [label(1, 3, "xx")])], "spans"),
        ([response("1", "0", [label(3, 9, "ls")])], "spans"),
        ([response("1", "0", [label(3, 3, "")])], "spans"),
        ([response("1", "0"), response("1", "1")], "duplicate"),
        ([response("1", "7")], "without a source"),
        ([response("1", "0"), "[1]\n"], "line 2"),
        ([response("1", "0"), "{bad\n"], "line 2"),
    ],
)
def test_bad_rows(spark, tmp_path, rows, message):
    with pytest.raises(ValueError, match=message):
        load(spark, tmp_path, rows)


def test_bad_sources(spark, tmp_path):
    twice = sources() + sources()[:1]
    with pytest.raises(ValueError, match="duplicate source_id"):
        load(spark, tmp_path, [response("1", "0")], twice)
    ambiguous = [dict(sources()[0], prompt="summary context summary context")]
    with pytest.raises(ValueError, match="once"):
        load(spark, tmp_path, [response("1", "0")], ambiguous)
    with pytest.raises(ValueError, match="unknown tasks"):
        load(spark, tmp_path, [response("1", "0")], tasks=("Other",))


@pytest.mark.parametrize("line, message", [("{bad", "line 4"), ("[1]", "line 4"), ('{"source_id": "9", "prompt": 5}', "line 4"), ('{"source_id": "9", "prompt": ["x"]}', "text prompt")])
def test_source_lines_are_checked(spark, tmp_path, line, message):
    with pytest.raises(ValueError, match=message):
        load(spark, tmp_path, [response("1", "0")], [json.dumps(x) + "\n" for x in sources()] + [line + "\n"])


def test_numbers_of_any_length_are_in_order(spark):
    names = ["9" * 45, "10", "9", "007", "7", "1" + "0" * 45, "a", "0", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(*texts.natural_key("n"))
    assert [r.n for r in rows.collect()] == ["0", "007", "7", "9", "10", "9" * 45, "1" + "0" * 45, "", "a"]


def test_locate(spark):
    rows = spark.createDataFrame([("aXaXa", "aXa"), ("😀bc", "c"), ("abc", "x"), ("abab", "ab")], "t string, p string")
    assert [tuple(r.u) for r in rows.select(texts.locate_unique("t", "p").alias("u")).collect()] == [(None, None, "ambiguous"), (2, 3, "ok"), (None, None, "missing"), (None, None, "ambiguous")]


def test_merge_forms_agree(spark):
    given = [(0, 5, 8, "b", False, True), (1, 1, 3, "a", True, False), (2, 3, 6, "a", False, False), (3, 10, 11, "c", False, False)]
    rows = spark.createDataFrame([("r", "0123456789a", *g) for g in given], "id string, response string, ordinal int, start int, end int, label_type string, implicit_true boolean, due_to_null boolean")
    got = sorted(tuple(r) for r in spans.merge_spans(rows, "id", "response").collect())
    assert got == [("r", 1, 8, "1234567", "a | b", True, True), ("r", 10, 11, "a", "c", False, False)]
    folded = rows.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("s")).select(spans.merge_array("s").alias("m")).first().m
    assert [tuple(x) for x in folded] == [(1, 8), (10, 11)]


def test_splits_do_not_depend_on_order(spark):
    rows = [(f"{t}-{i}", t, "train") for t in ("QA", "Summary") for i in range(60)]
    a = splits.dev_split(spark.createDataFrame(rows, "response_id string, task string, split string"), 10, 2024)
    b = splits.dev_split(spark.createDataFrame(rows[::-1], "response_id string, task string, split string").repartition(3), 10, 2024)
    pick = lambda df: sorted(r.response_id for r in df.where("is_dev = 1").collect())
    assert pick(a) == pick(b) and len(pick(a)) == 20


def test_work_shards_partition_the_order(spark):
    rows = spark.createDataFrame([(str(i),) for i in range(101)], "response_id string").repartition(5)
    found = [sorted(int(r.response_id) for r in splits.work_shard(rows, 3, k, texts.natural_key("response_id")).collect()) for k in range(3)]
    assert found == [list(range(k, 101, 3)) for k in range(3)]
    with pytest.raises(ValueError):
        splits.work_shard(rows, 3, 3, texts.natural_key("response_id"))


def test_pieces_cover_the_text(spark, monkeypatch):
    import re

    given = [(1, " a  b\n\nc😀 "), (2, ""), (3, None), (4, "é"), (5, "\t"), (6, "x y" * 400), (7, "no\u00a0break\x0bhere")]
    rows = spark.createDataFrame([(*r, "k") for r in given], "id int, text string, piece_of string").coalesce(1)
    for size in (1 << 20, 2):
        monkeypatch.setattr(texts, "PIECE_BYTES", size)
        got = texts.pieces(rows, "id", "text", ("piece_of",)).orderBy("id", "token_index").collect()
        want = [(i, "k", n, m.start(), m.end(), m.group()) for i, t in given for n, m in enumerate(re.finditer("[^ \n\t]+|[ \n\t]+", t or ""))]
        assert [tuple(r) for r in got] == want


def test_safe_names_agree(spark):
    from verispan.sources.artifacts import safe_name

    names = ["plain-1.x", "a b/c", "..x..", "é", "_a_"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in rows.select(texts.safe_name("n")).collect()] == [safe_name(n) for n in names]
