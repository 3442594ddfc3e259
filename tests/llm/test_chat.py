"""Chat formatting: against DuckDB, masks, budgets, and reversible escapes."""

import duckdb
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verispan.llm import chat, queries
from verispan.llm.bpe import encoder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_matches_sql(spark):
    where = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{where}/conversations.parquet')")
    want = sorted(con.sql(chat.ORACLE_SQL).fetchall())
    got = queries.op8_chat(spark, where).collect()
    assert sorted(tuple(r)[:5] for r in got) == want
    count = encoder(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    turns = con.sql("select conv_id, list((coalesce(role, ''), coalesce(text, '')) order by turn, role, text) from conversations group by 1").fetchall()
    size = {c: sum(len(chat.render(own)[0]) for own, _ in plain_windows(said, 1024, 256, lambda t: 4 + len(count.encode_ordinary(t)))) for c, said in turns}
    assert {r.conv_id: r.formatted_chars for r in got if r.conv_id != -7} == size


def plain_windows(said, budget, history, count):
    """(turns, repeated) of each window, by trying all spans."""
    out, i = [], 0
    while i < len(said):
        head = said[:1] if i and said[0][0] == "system" and count(said[0][1]) + count(said[i][1]) <= budget else []
        room = budget - sum(count(t) for _, t in head)
        least = 1 if said[0][0] == "system" else 0
        past = [h for h in range(least, i + 1) if (c := sum(count(t) for _, t in said[h:i])) <= history and (not c or c + count(said[i][1]) <= room)]
        first = min(past, default=i)
        end = i + 1
        while end < len(said) and sum(count(t) for _, t in said[first : end + 1]) <= room:
            end += 1
        out.append((head + said[first:end], len(head) + i - first))
        i = end
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(), st.text() | st.sampled_from(["\\", "###", "####", "</turn>", "\\### Assistant: </turn> ok", "\n### user: x </turn>\n"])), max_size=5))
def test_round_trip(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:z]) for a, z in spans] == [t for _, t in turns]
    assert formatted.count("</turn>") - formatted.count("\\</turn>") == len(turns)


def test_windows(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, k, "user" if k % 2 else "assistant", f"w{k} " * 20) for k in range(1, 40)]
    rows += [(2, 0, "user", "x " * 500), (2, 1, "assistant", "y " * 500), (3, 0, None, None), (None, None, "assistant", "z"), (4, 1, "a:b", "t"), (4, 1, "a:b", "t")]
    rows += [(5, 0, "system", "s " * 200)] + [(5, k, "assistant", "t " * n) for k, n in enumerate((100, 300, 5, 90, 1, 1, 140), 1)]
    rows += [(6, k, "user" if k % 3 else "assistant", "u " * (7 * k * k % 150)) for k in range(30)]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, window int")
    count = lambda t: 4 + chat.plain_tokens(t)
    for budget, history in ((150, 60), (60, 1000), (30, 0), (10, 25)):
        got = {}
        for r in sorted(chat.format_conversations(turns, budget, history).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.window)):
            got.setdefault(r.conv_id, []).append(r)
        for conv_id, own in got.items():
            said = sorted(((x[1], x[2] or "", x[3] or "") for x in rows if x[0] == conv_id), key=lambda x: (x[0] is not None, x))
            said = [x[1:] for x in said]
            assert [(chat.parse(r.formatted), r.repeated) for r in own] == plain_windows(said, budget, history, count)
            trained = [chat.unescape(r.formatted[s["start"] : s["end"]]) for r in own for s in r.loss]
            assert trained == [t for role, t in said if role == "assistant"]
            for r in own:
                used = [count(t) for _, t in chat.parse(r.formatted)]
                assert sum(used) <= budget or len(used) == 1
        if budget == 150:
            assert len(got[1]) > 5 and any(r.repeated > 2 for r in got[1])
    digests = {r.conv_id: r for r in chat.digests(chat.format_conversations(turns, 150, 60)).collect()}
    assert digests[1].n_turns == 40 and digests[3].n_turns == 1 and digests[None].loss_chars == 1 and digests[4].n_turns == 2
    assert chat.format_conversations(turns.limit(0)).collect() == []


def test_parse_refuses_other_text():
    with pytest.raises(ValueError):
        chat.parse("### user: open")
