import hashlib

from hypothesis import given
from hypothesis import strategies as st

from panelcraft.llm import chat

CONV = "conv_id long, turn long, role string, text string"
SAID = r"\### Assistant: </turn> ok"


def expected_rows(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, turns in by.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        said = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        size = sum(len(chat.format_turn(r, x)[0]) for r, x in turns)
        out.append((c, len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return sorted(out, key=str)


def got_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_reads_back_every_conversation(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)]
    assert got_rows(chat.op9_chat_tree(spark, sf)) == expected_rows(rows)


def shared(n=40):
    rows = []
    for c in range(n):
        rows += [(c, 0, "system", "be kind"), (c, 1, "user", f"q{c % 5}"), (c, 2, "assistant", f"a{c % 10}")]
    return [*rows, (90, 0, "system", "be kind"), (91, 0, None, None), (92, None, "user", "first"), (92, 0, "user", "second"), (None, 0, "a:b#", "x\n\\y")]


def test_shared_turns_are_emitted_once_a_shard(spark, sf):
    df = spark.createDataFrame(shared(), CONV).repartition(3)
    nodes = chat.prefix_tree(df)
    assert got_rows(chat.read_back(nodes)) == expected_rows(shared())
    rows = nodes.orderBy("shard", "seq").collect()
    texts = [(r.shard, r.depth, r.text) for r in rows if not r.ended]
    assert len({t for t in texts if t[1] == 0}) == sum(t[1] == 0 for t in texts)  # a first turn once in its shard
    path, stream = [], {}
    for r in rows:
        if r.ended:
            continue
        path[r.depth :] = [r]
        assert r.position_start == sum(len(p.text) for p in path[:-1])
        assert r.stream_start == stream.get(r.shard, 0)
        covered = [i for a in r.ancestors for i in range(a.start, a.stop)]
        assert covered == [i for p in path[:-1] for i in range(p.stream_start, p.stream_start + len(p.text))]
        stream[r.shard] = r.stream_start + len(r.text)


def test_stored_tree_and_empty_table(spark, sf, scratch):
    df = spark.createDataFrame(shared(), CONV)
    chat.prefix_tree(df).write.parquet(f"{scratch}/tree")
    assert got_rows(chat.read_back(spark.read.parquet(f"{scratch}/tree").repartition(5))) == expected_rows(shared())
    assert chat.read_back(chat.prefix_tree(df.limit(0))).count() == 0
    clash = df.selectExpr("*", "1 as path", "2 as turns", "3 as shard")
    assert got_rows(chat.read_back(chat.prefix_tree(clash))) == expected_rows(shared())


@given(st.text(), st.text())
def test_turns_are_reversible(role, text):
    formatted, start, stop = chat.format_turn(role, text)
    assert chat.unescape(formatted[start:stop]) == text
    found = chat.TURN.fullmatch(formatted)
    assert (chat.unescape(found[1]), chat.unescape(found[2])) == (role, text)
    assert formatted.count("</turn>") == 1


def test_token_units(spark, sf):
    """Offsets, positions and intervals in tokens; equal turns have equal ids, which spell the text."""
    from tokenizers import Tokenizer

    from panelcraft.llm.packing import default_tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    rows = chat.prefix_tree(spark.createDataFrame(shared(), CONV).repartition(3)).where("NOT ended").orderBy("shard", "seq").collect()
    path, stream = [], {}
    for r in rows:
        path[r.depth :] = [r]
        assert r.ids == tok.encode(r.text, add_special_tokens=False).ids
        assert r.token_position == sum(len(p.ids) for p in path[:-1])
        assert r.token_start == stream.get(r.shard, 0)
        covered = [i for a in r.token_ancestors for i in range(a.start, a.stop)]
        assert covered == [i for p in path[:-1] for i in range(p.token_start, p.token_start + len(p.ids))]
        stream[r.shard] = r.token_start + len(r.ids)


def test_hot_and_null_conversations(spark, sf, monkeypatch):
    """A conversation (and a null conv_id) with a third of all rows, over several blocks of turns."""
    monkeypatch.setattr(chat, "BLOCK", 100)
    rows = [(7, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(700)] + [(None, i % 300, "user", f"x{i % 9}") for i in range(600)]
    rows += [(8, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(650)]  # a prefix of 7
    rows += [(1000 + c, t, "assistant", f"{c} {t}") for c in range(200) for t in range(3)]
    df = spark.createDataFrame(rows, CONV).repartition(4)
    nodes = chat.prefix_tree(df)
    assert got_rows(chat.read_back(nodes)) == expected_rows(rows)
    paths = chat.paths_of(chat.turns_of(df)).collect()
    assert max(len(r.path) for r in paths) <= chat.DEEP + 32
    plan = chat.turns_of(df)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_prefix_digests_do_not_depend_on_blocks(spark, sf, monkeypatch):
    rows = [(c, i, "user", f"t{i % 7}") for c in (1, 2) for i in range(50)] + [(3, 0, "user", "t0"), (3, 1, "user", "t0")]
    df = spark.createDataFrame(rows, CONV)
    want = sorted(map(tuple, chat.turns_of(df).collect()))
    assert len({r[4:] for r in want if r[0] == 1}) == 50 and [r[1:] for r in want if r[0] == 1] == [r[1:] for r in want if r[0] == 2]
    monkeypatch.setattr(chat, "BLOCK", 7)
    assert sorted(map(tuple, chat.turns_of(df).collect())) == want


def test_a_long_text(spark, sf):
    rows = [(1, 0, "user", "<#:\\ " * 20_000), (1, 1, "assistant", "y" * 50_000)]
    assert got_rows(chat.read_back(chat.prefix_tree(spark.createDataFrame(rows, CONV)))) == expected_rows(rows)
