"""Chat formatting with a prefix tree.

Conversations that begin with the same turns share these: each distinct prefix of turns is a node, and its last
turn's tokens are emitted once. A tree holds all conversations with the same first turn; its nodes are laid out
depth-first, and each has its place in that layout, position ids (as if its conversation stood alone), and the
intervals of the layout that its tokens may attend to besides themselves: those of its ancestors, joined where
they touch.

A turn is written ``<role>: <text>`` and an empty line. Turns stand in the order of their number; the layout of
siblings goes by node id, the hash of the path.

How: a conversation's path is the list of its nodes' ids. The distinct paths are sorted by range over all tasks;
in that order a conversation adds the nodes beyond what it shares with the one before, and these come in the
order of the layout. So each task lays out its own range with a stack, however many trees it holds and however
many ranges a tree (say, of one system prompt) fills. What ranges owe each other, one path a range, is settled
on the driver and added in a last pass. Equal conversations are counted before the sort. Work and rows go by the
number of turns; there is no group but the conversation itself, which is handled whole.

Defined results: a null role or text counts as empty; a null turn number comes first; turns of the same number
go by role, then text, and repeated rows are repeated turns; each row without a conv_id is a conversation of its
own. Equal conversations share all nodes. A turn without tokens has empty lists and adds no interval. Other columns
aren't carried. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import DEFAULT_TOKENIZER, encode_arrow
from .common import keep_table, scratch, write_table

#: Bytes of new turns that are encoded at once.
STEP_BYTES = 4 << 20
_L, _BIN = T.LongType(), T.BinaryType()
_SPANS = T.ArrayType(T.StructType([T.StructField("start", _L), T.StructField("end", _L)]))
_EDGE = T.StructType([T.StructField(n, t) for n, t in (("first", T.ArrayType(_BIN)), ("first_tokens", T.ArrayType(_L)), ("first_counts", T.ArrayType(_L)), ("last", T.ArrayType(_BIN)), ("last_start", T.ArrayType(_L)), ("last_end", T.ArrayType(_L)), ("tokens", _L), ("nodes", _L))])
#: A node as its range sees it; places are counted from the range's start in the range's first tree.
_NODE = T.StructType([T.StructField(n, t) for n, t in (("range", T.IntegerType()), ("head", T.BooleanType()), ("tree_id", _BIN), ("node_id", _BIN), ("parent_id", _BIN), ("depth", T.IntegerType()), ("dfs_order", _L), ("token_start", _L), ("position_start", _L), ("n_tokens", T.IntegerType()), ("token_ids", T.ArrayType(T.IntegerType())), ("shared", T.IntegerType()), ("attention", _SPANS), ("n_conversations", _L), ("n_ends", _L), ("edge", _EDGE))])


# --- paths -----------------------------------------------------------------------------------------------
def _md5(b: bytes) -> bytes:
    return hashlib.md5(b, usedforsecurity=False).digest()


def path_of(turns) -> list[bytes]:
    """The node ids of a conversation's prefixes, of (role, text) pairs."""
    out, at = [], b""
    for role, text in turns:
        r = role.encode("utf-8", "surrogatepass")
        at = _md5(at + _md5(b"%d:" % len(r) + r + text.encode("utf-8", "surrogatepass")))
        out.append(at)
    return out


def _paths(batches):
    for batch in batches:
        turns = [[(t["role"], t["text"]) for t in c] for c in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(path_of, turns), pa.list_(pa.binary())), pa.array([[f"{r}: {t}\n\n" for r, t in c] for c in turns], pa.list_(pa.string()))], names=["conv_id", "path", "said"])


def conversations(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, path, said) of each conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("t"))
    whole = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    lone = rows.where("conv_id is null").select("conv_id", F.array("t").alias("turns"))
    both = whole.unionByName(lone)
    schema = T.StructType([both.schema["conv_id"], T.StructField("path", T.ArrayType(_BIN)), T.StructField("said", T.ArrayType(T.StringType()))])
    return both.mapInArrow(_paths, schema)


# --- the layout of a range --------------------------------------------------------------------------------
def _shared(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class _Range:
    """Lays out the nodes of sorted paths."""

    def __init__(self, number: int, tokenizer: str):
        self.number, self.tokenizer = number, tokenizer
        self.stack: list[dict] = []
        self.first: list[bytes] = []
        self.head: list[dict] = []
        self.rows: list[dict] = []
        self.tokens = self.nodes = 0

    def add(self, block: list[tuple[list[bytes], list[str], int]]) -> None:
        last = [x["node_id"] for x in self.stack]
        new, keep = [], []
        for path, said, _ in block:
            k = _shared(path, last)
            keep.append(k)
            new += said[k:]
            last = path
        _, n, off, ids, *_ = encode_arrow(pa.array(new, pa.large_string()), self.tokenizer, check=False)
        at = 0
        for (path, _, count), k in zip(block, keep):
            while len(self.stack) > k:
                self.pop()
            for x in self.stack:
                x["n_conversations"] += count
            for depth in range(k + 1, len(path) + 1):
                self.push(path, depth, int(n[at]), ids[off[at] : off[at + 1]], count)
                at += 1
            self.stack[-1]["n_ends"] += count
            if not self.first:
                self.first, self.head = path, list(self.stack)

    def push(self, path, depth, n, ids, count) -> None:
        up = self.stack[-1] if self.stack else None
        if up is None and self.first and path[0] != self.first[0]:
            self.tokens = self.nodes = 0
        head = not self.first
        # ancestors on the range's first path are settled later; of the others the parent has the list
        shared = 0 if up is None else up["shared"] + 1 if up["on_first"] else up["shared"]
        spans = [] if up is None or up["on_first"] else list(up["attention"])
        if up is not None and not up["on_first"] and up["n_tokens"]:
            a, z = up["token_start"], up["token_start"] + up["n_tokens"]
            if spans and spans[-1][1] == a:
                spans[-1] = (spans[-1][0], z)
            else:
                spans.append((a, z))
        self.nodes += 1
        self.stack.append({
            "range": self.number, "head": head, "on_first": head, "tree_id": path[0], "node_id": path[depth - 1], "parent_id": path[depth - 2] if depth > 1 else None, "depth": depth, "dfs_order": self.nodes, "token_start": self.tokens,
            "position_start": up["position_start"] + up["n_tokens"] if up else 0, "n_tokens": n, "token_ids": ids, "shared": shared, "attention": spans, "n_conversations": count, "n_ends": 0, "edge": None,
        })
        self.tokens += n

    def pop(self) -> None:
        self.rows.append(self.stack.pop())

    def end(self) -> None:
        if not self.first:
            return
        last = list(self.stack)
        while self.stack:
            self.pop()
        edge = {
            "first": self.first, "first_tokens": [x["n_tokens"] for x in self.head], "first_counts": [v for x in self.head for v in (x["n_conversations"], x["n_ends"])],
            "last": [x["node_id"] for x in last], "last_start": [x["token_start"] for x in last], "last_end": [x["token_start"] + x["n_tokens"] for x in last], "tokens": self.tokens, "nodes": self.nodes,
        }
        self.rows.append({"range": self.number, "head": False, "edge": edge})

    def flush(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([x.get(f.name) for x in self.rows], f.type) for f in schema]
        self.rows = []
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def _laid(tokenizer: str, schema: pa.Schema):
    def run(batches):
        r = _Range(TaskContext.get().partitionId(), tokenizer)
        block, size = [], 0
        for batch in batches:
            for path, said, count in zip(*(batch.column(k).to_pylist() for k in range(3))):
                block.append((path, said, count))
                size += sum(map(len, said))
                if size >= STEP_BYTES:
                    r.add(block)
                    block, size = [], 0
                    yield r.flush(schema)
        if block:
            r.add(block)
        r.end()
        if r.rows:
            yield r.flush(schema)

    return run


# --- what ranges owe each other -------------------------------------------------------------------------------
def settle(edges: list) -> tuple[dict, dict]:
    """({range: (its first tree, nodes of its first path that an earlier range has, tokens and nodes to add to
    places in its first tree, intervals of its first path)}, {node: conversations through it and that end with it,
    counted in later ranges}) of the edges of all ranges in order."""
    by_range, more = {}, {}
    last, spans, tokens, nodes = [], [], 0, 0
    for e in edges:
        k = _shared(e["first"], last)
        before = sum(e["first_tokens"][:k])
        add_t, add_n = (tokens - before, nodes - k) if k else (0, 0)
        starts = np.append(0, np.cumsum(e["first_tokens"])).tolist()
        head = spans[:k] + [(starts[j] + add_t, starts[j + 1] + add_t) for j in range(k, len(e["first"]))]
        by_range[e["range"]] = (e["first"][0], k, add_t, add_n, head)
        for j in range(k):
            through, ends = more.get(e["first"][j], (0, 0))
            more[e["first"][j]] = (through + e["first_counts"][2 * j], ends + e["first_counts"][2 * j + 1])
        same = e["last"][0] == e["first"][0]
        on_first = _shared(e["last"], e["first"])
        shift = add_t if same else 0
        spans = head[:on_first] + [(a + shift, z + shift) for a, z in zip(e["last_start"][on_first:], e["last_end"][on_first:])]
        last, tokens, nodes = e["last"], e["tokens"] + shift, e["nodes"] + (add_n if same else 0)
    return by_range, more


def _join(spans):
    out: list[tuple[int, int]] = []
    for a, z in spans:
        if a == z:
            continue
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out


def _settled(by_range: dict, more: dict, schema: pa.Schema):
    place = {f.name: k for k, f in enumerate(schema)}

    def run(batches):
        for batch in batches:
            cell = lambda name: batch.column(place[name])  # noqa: E731, B023
            ranges, depth, trees, nodes = (cell(n).to_pylist() for n in ("range", "depth", "tree_id", "node_id"))
            mine = [by_range[r] for r in ranges]
            stays = np.array([not (h and d <= m[1]) for h, d, m in zip(cell("head").to_pylist(), depth, mine)], bool)  # else an earlier range has it
            first = np.array([t == m[0] for t, m in zip(trees, mine)], bool)
            add = np.array([(m[2], m[3]) for m in mine], np.int64).reshape(-1, 2) * first[:, None]
            extra = np.array([more.get(n, (0, 0)) for n in nodes], np.int64).reshape(-1, 2)
            new = {"token_start": add[:, 0], "dfs_order": add[:, 1], "n_conversations": extra[:, 0], "n_ends": extra[:, 1]}
            columns = [pa.array(batch.column(k).to_numpy() + new[f.name]) if f.name in new else batch.column(k) for k, f in enumerate(schema)]
            spans = cell("attention").to_pylist()
            for i in np.flatnonzero(first).tolist():
                own = [(s["start"] + mine[i][2], s["end"] + mine[i][2]) for s in spans[i]]
                spans[i] = [{"start": a, "end": z} for a, z in _join(mine[i][4][: cell("shared")[i].as_py()] + own)]
            columns[place["attention"]] = pa.array(spans, schema.field("attention").type)
            yield pa.RecordBatch.from_arrays(columns, schema=schema).filter(pa.array(stays))

    return run


def prefix_tree(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """A row of kind ``node`` for each node: tree_id, node_id, parent_id, depth, dfs_order, token_start (its place in
    the tree's layout), position_start, n_tokens, token_ids, position_ids, attention (ancestors' intervals),
    n_conversations (that pass through it) and n_ends (that end with it); and a row of kind ``conversation`` for each
    conversation: conv_id, tree_id, and the node_id and depth with which it ends."""
    from pyspark.sql.pandas.types import to_arrow_schema

    with scratch(df.sparkSession):
        convs, kept = write_table(conversations(df, conv_col, turn_col, role_col, text_col), "conversations")
        keep_table(kept)
        last = F.element_at("path", -1)
        distinct = convs.groupBy(last.alias("last")).agg(F.first("path").alias("path"), F.first("said").alias("said"), F.count("*").alias("n")).drop("last")
        ordered = distinct.repartitionByRange("path").sortWithinPartitions("path").select("path", "said", "n")
        rows, kept = write_table(ordered.mapInArrow(_laid(path, to_arrow_schema(_NODE)), _NODE), "nodes")
        keep_table(kept)
        edges = [r.edge.asDict() | {"range": r.range} for r in rows.where("edge is not null").select("range", "edge").collect()]
    by_range, more = settle(sorted(edges, key=lambda e: e["range"]))
    slim = T.StructType([f for f in _NODE if f.name != "edge"])
    nodes = rows.where("edge is null").drop("edge").mapInArrow(_settled(by_range, more, to_arrow_schema(slim)), slim)
    ids = F.when(F.col("n_tokens") > 0, F.sequence("position_start", F.col("position_start") + F.col("n_tokens") - 1)).otherwise(F.array().cast("array<bigint>"))
    nodes = nodes.select(F.lit("node").alias("kind"), "tree_id", "node_id", "parent_id", "depth", "dfs_order", "token_start", "position_start", "n_tokens", "token_ids", ids.alias("position_ids"), "attention", "n_conversations", "n_ends")
    ends = convs.select(F.lit("conversation").alias("kind"), "conv_id", F.get("path", F.lit(0)).alias("tree_id"), last.alias("node_id"), F.size("path").alias("depth"))
    return nodes.unionByName(ends, allowMissingColumns=True)
