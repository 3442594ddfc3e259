"""The pipeline's line dedup: blocks of boilerplate go whole, copies stay."""

import corpus_pipeline as pipeline


def test_footer_of_three_lines_goes_and_copies_stay(spark):
    footer = ["All rights reserved by us", "Read our privacy statement", "Contact the web master"]
    story = [" ".join(f"story{k}x{j}" for j in range(20)) for k in range(10)]
    rows = []
    for k in range(12):
        body = " ".join(f"own{k}x{j}" for j in range(60))
        rows.append((k, "\n".join([body, *footer]), f"s{k}"))
        rows.append((100 + k, "\n".join(story), f"s{k}"))
        rows.append((200 + k, "\n".join([*story[:4], f"edited sentence of copy {k}", *story[5:]]), f"s{k}"))
    rows += [(300 + k, " ".join(f"few{k}x{j}" for j in range(60)) + "\nOn nine sites only", f"s{k}") for k in range(9)]
    docs = spark.createDataFrame([(i, t, s, len(t)) for i, t, s in rows], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.dedup_lines(spark, docs, "").collect()}
    for i, t, _ in rows:
        want = t.split("\n")[0] if i < 100 else t
        assert got[i] == (want, len(want))
