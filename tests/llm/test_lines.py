"""Line dedup: against DuckDB and on planted lines."""

import duckdb
import pytest

from verispan.llm import lines, queries

SITES = [f"s{k}" for k in range(12)]
BOILER = "Accept all cookies here"


def test_matches_sql(spark):
    where = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{where}/documents.parquet')")
    want = sorted(con.sql(lines.ORACLE_SQL).fetchall())
    got = sorted(tuple(r) for r in queries.op5_lines(spark, where).collect())
    assert got == want
    assert sum(r[2] for r in got) > 0


def test_boilerplate_goes_and_copies_stay(spark):
    rows = []
    for k, site in enumerate(SITES):
        rows.append((k, f"unique start number {k}\n  {BOILER} \nunique end number {k}\n", site, 1))
        rows.append((100 + k, "a copied document here\nwith its second line\nand a third one", site, 1))
        rows.append((200 + k, f"Is it.\nown line of document {k}", site, 1))
    rows += [(300, None, "s1", 1), (301, "", None, 1), (None, f"no id\n{BOILER}", None, 1), (302, BOILER, "s1", 1), (302, BOILER, "s1", 1), (303, "long line " * 50000 + "\n" + BOILER, "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int")
    got = lines.strip_boilerplate(docs).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        texts.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_removed))
    assert all(texts[k] == [(f"unique start number {k}\nunique end number {k}\n", 4, 1)] for k in range(12))
    assert all(texts[100 + k][0][2] == 0 and texts[200 + k][0][2] == 0 for k in range(12))
    assert texts[300] == [(None, 0, 0)] and texts[301] == [("", 1, 0)]
    assert texts[None] == [("no id", 2, 1)] and texts[302] == [("", 1, 1)] * 2
    assert texts[303][0][2] == 1
    assert lines.strip_boilerplate(docs.limit(0)).collect() == []


def test_threshold_is_exact(spark):
    docs = []
    for n in (lines.SITES - 1, lines.SITES, lines.SITES + 1):
        for k in range(n):
            docs.append((n * 100 + k, f"before {n} {k} xxxxxxx\nshared line for {n} sites\nafter {n} {k} yyyyyyy", f"site{k}"))
    got = {r.doc_id: r.n_removed for r in lines.strip_boilerplate(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert got == {d[0]: int(d[0] // 100 >= lines.SITES) for d in docs}


@pytest.mark.parametrize("size", [1, 3, 4, 10])
def test_blocks_go_whole_and_copies_stay(spark, size):
    notice = [f"line {k} of the notice that all sites carry" for k in range(size)]
    story = [" ".join(f"story{k}x{j}" for j in range(20)) for k in range(10)]
    rows = []
    for k in range(12):
        own = [f"what page {k} says by itself", f"and more of page {k}"]
        rows += [(k, "\n".join([own[0], *notice, own[1]]), f"s{k}"), (100 + k, "\n".join(story), f"s{k}")]
        rows += [(200 + k, "\n".join([*story[:4], f"edited sentence of copy {k}", *story[5:]]), f"s{k}")]
        rows += [(300 + k, "\n".join(notice), f"s{k}")]
    rows += [(400 + k, f"own text {k} of a page\nOn nine sites only", f"s{k}") for k in range(9)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.strip_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for i, text, _ in rows:
        left = [x for x in text.split("\n") if x not in notice]
        n = text.count("\n") + 1
        assert got[i] == ("\n".join(left), n, n - len(left))
