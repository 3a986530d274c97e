import random

from shirabe.llm import bpe, chat, common

TOK = bpe.codec(bpe.DEFAULT_TOKENIZER).tok


def tokens(turn):
    return TOK.encode(f"{turn[0]}: {turn[1]}\n\n", add_special_tokens=False).ids


def brute(convs):
    """{path of turns: (position_start, ids, conversations through it, that end there)}"""
    out = {}
    for c, turns in convs.items():
        for d in range(1, len(turns) + 1):
            k = tuple(turns[:d])
            at = out.setdefault(k, [sum(len(tokens(t)) for t in k[:-1]), tokens(k[-1]), 0, []])
            at[2] += 1
            if d == len(turns):
                at[3].append(c)
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree_id string")
    return chat.prefix_tree(df.repartition(3)).collect()


def check(spark, rows, convs):
    """convs: turns by conversation; each row without an id is one, of the key (None, n)."""
    whole, want = run(spark, rows), brute(convs)
    got = [r for r in whole if r.kind == "node"]
    assert len(got) == len(want) == len({r.node_id for r in got})
    by = {r.node_id: r for r in got}
    children, paths = {}, {}
    for r in got:
        children.setdefault(r.parent_id, []).append(r)
        spans, at = [], r
        while at.parent_id is not None:
            at = by[at.parent_id]
            spans.append((at.token_start, at.token_start + at.n_tokens))
        assert at.node_id == r.tree_id and at.depth == 1
        seen = {x for a, b in spans for x in range(a, b)}
        assert {x for a in r.attention for x in range(a.start, a.end)} == seen and len(seen) == r.position_start
        assert all(a.end < b.start for a, b in zip(r.attention, r.attention[1:]))
        assert r.position_ids == list(range(r.position_start, r.position_start + r.n_tokens))
        paths[r.node_id] = r
    # depth-first: a node comes right after its parent or after all of an elder sibling's descendants
    for tree in {r.tree_id for r in got}:
        order = []

        def walk(r):
            order.append(r.node_id)
            for c in sorted(children.get(r.node_id, []), key=lambda c: c.dfs_order):
                walk(c)

        walk(by[tree])
        mine = sorted((r for r in got if r.tree_id == tree), key=lambda r: r.dfs_order)
        assert [r.node_id for r in mine] == order and [r.dfs_order for r in mine] == list(range(1, len(mine) + 1))
        at = 0
        for r in mine:
            assert r.token_start == at
            at += r.n_tokens
    ends = {}
    for r in whole:
        if r.kind == "conversation":
            ends.setdefault(r.node_id, []).append(r.conv_id)
            assert (by[r.node_id].tree_id, by[r.node_id].depth) == (r.tree_id, r.depth)
    ids = {chat.path_of(p)[-1]: (at, tuple(i), n, sorted(e, key=repr)) for p, (at, i, n, e) in want.items()}
    one = lambda c: None if isinstance(c, tuple) else c
    assert {r.node_id: (r.position_start, tuple(r.token_ids), r.n_conversations, sorted(ends.get(r.node_id, []), key=repr)) for r in got} == {k: (at, i, n, sorted(map(one, e), key=repr)) for k, (at, i, n, e) in ids.items()}
    assert all(r.n_ends == len(ends.get(r.node_id, [])) for r in got)


def test_random_conversations(spark):
    r = random.Random(4)
    say = ["hi", "what is this?", "", "été 日本"]
    convs = {c: [(["user", "assistant"][i % 2], r.choice(say)) for i in range(r.randint(1, 5))] for c in range(40)}
    rows = [(c, i, *t, "x") for c, turns in convs.items() for i, t in enumerate(turns)]
    r.shuffle(rows)
    check(spark, rows, convs)


def test_odd_rows(spark):
    rows = [(1, 0, "user", "a", None), (1, 0, "user", "a", None), (1, None, None, None, None), (2, 5, "user", "b" * 50_000, None), (2, 4, "user", None, None), (None, 1, "user", "a", None), (None, 1, "user", "a", None), (3, 1, "user", "a", None), (4, 1, "b", "x", None), (4, 1, "a", "x", None)]
    check(spark, rows, {1: [("", ""), ("user", "a"), ("user", "a")], 2: [("user", ""), ("user", "b" * 50_000)], (None, 0): [("user", "a")], (None, 1): [("user", "a")], 3: [("user", "a")], 4: [("a", "x"), ("b", "x")]})
    assert run(spark, []) == []


def test_one_system_prompt_over_many_ranges(spark):
    """All conversations in one tree, some deep: the layout is put together from ranges, no task has the tree."""
    r = random.Random(9)
    convs = {c: [("system", "be kind")] + [("user", r.choice("abcdefgh")) for _ in range(r.choice([0, 1, 2, 3, 6]))] for c in range(600)}
    convs |= {1000 + c: [("system", "be kind"), *(("user", "a") for _ in range(90 + c))] for c in range(8)}
    rows = [(c, i, *t, "x") for c, turns in convs.items() for i, t in enumerate(turns)]
    with_ranges = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        check(spark, rows, convs)
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree_id string")
        with common.scratch(spark):
            told = chat.prefix_tree(df)
            sizes = {}
            for path in common._SCOPES[-1]:
                if "/nodes-" in path:
                    sizes = {x["range"]: x["count"] for x in spark.read.parquet(path).groupBy("range").count().collect()}
            assert told.count() and len(sizes) > 10 and max(sizes.values()) < 0.4 * sum(sizes.values())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", with_ranges)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("x", 1, "user", "a"), ("y", 1, "user", "a")], "conv_id string, turn long, role string, text string")
    assert sorted(r.conv_id for r in chat.prefix_tree(df).collect() if r.kind == "conversation") == ["x", "y"]
