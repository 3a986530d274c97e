"""Mixing overlapping sources to target weights by min-cost flow.

A document may belong to several collections (say its crawl and its language); each of its selected copies
counts for one of them. Documents are aggregated by membership pattern; what goes to the driver is one row of
token sums a pattern. There a min-cost flow routes the patterns' tokens to the collections' quotas: the first
use of a token is free, each repetition costs more than the one before (convex), and a quota that can't be met
stays short at a cost above any repetition.

The tokens of a pattern lie on a line in the order of a seeded hash of the documents; the flow cuts each
repetition of that line into intervals, one for each collection. A cut is turned into the hash value at which
it falls (exactly: by prefix sums over 4,096 hash ranges, then inside the range of the cut), so selection is
comparing a hash with a few bounds: no shuffle or sort of documents.

Defined results: tokens are runs of characters that aren't ASCII white space; null texts have none. A null name
in a document's list of collections is left out of it and the other names stay (so a document without a source
still counts for its language); a document without any target collection isn't selected. A document is taken if its first token lies in an interval, so a
collection's total misses its quota by less than a document an interval. Equal rows (id and text) have one
hash and are taken or left together, and so are different documents that happen to have one; a document without
tokens goes with the one after it. An empty table gives an empty mix. Columns are carried;
``mix_source`` and ``mix_copy`` are added (``<name>_in`` where a column bears these names).
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, keep_table, make_room, scratch, write_table

EPOCHS, SEED, ALPHA = 4, 20240607, 0.7
#: Cost of the n-th use of a token.
COSTS = (0, 1, 4, 9, 16, 25, 36, 49)
SHORT = 10_000
_RANGE_BITS = 12
_SEP = "\x1f"
TOKEN = "[^ \\t\\n\\r\\f\\x0B]+"


# --- flow ----------------------------------------------------------------------------------------------------
def quotas(weights: dict[str, float], budget: int) -> dict[str, int]:
    """The budget in whole tokens by weight (largest remainders; ties by name)."""
    total = sum(weights.values())
    if total <= 0:
        return dict.fromkeys(weights, 0)
    exact = {s: budget * w / total for s, w in weights.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: budget - sum(out.values())]:
        out[s] += 1
    return out


def tempered(capacity: dict[str, int], alpha: float = ALPHA) -> dict[str, float]:
    """Weights in proportion to a power of each collection's tokens."""
    return {s: float(n) ** alpha if n else 0.0 for s, n in capacity.items()}


def route(capacity: dict[str, int], members: dict[str, list[str]], quota: dict[str, int], epochs: int = EPOCHS) -> dict[str, dict[str, int]]:
    """Tokens that each pattern sends to each of its collections, at least cost (successive shortest paths)."""
    if epochs > len(COSTS):
        raise ValueError(f"at most {len(COSTS)} repetitions")
    patterns = sorted(p for p in capacity if capacity[p] > 0)
    sources = sorted(quota)
    node = {("p", p): i + 2 for i, p in enumerate(patterns)} | {("s", s): i + 2 + len(patterns) for i, s in enumerate(sources)}
    graph: list[list[int]] = [[] for _ in range(len(node) + 2)]
    to, cap, cost = [], [], []

    def arc(a, b, c, w):
        for x, y, k, z in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(z)

    for p in patterns:
        for e in range(epochs):
            arc(0, node["p", p], capacity[p], COSTS[e])
    sent = {}
    for p in patterns:
        for s in members[p]:
            if s in quota:
                sent[p, s] = len(to)
                arc(node["p", p], node["s", s], capacity[p] * epochs, 0)
    for s in sources:
        arc(0, node["s", s], quota[s], SHORT)
        arc(node["s", s], 1, quota[s], 0)
    height = [0] * len(graph)
    while True:
        far, via = [None] * len(graph), [-1] * len(graph)
        far[0] = 0
        heap = [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in graph[a]:
                b = to[e]
                if cap[e] and (far[b] is None or d + cost[e] + height[a] - height[b] < far[b]):
                    far[b], via[b] = d + cost[e] + height[a] - height[b], e
                    heapq.heappush(heap, (far[b], b))
        if far[1] is None:
            break
        height = [h + (f if f is not None else far[1]) for h, f in zip(height, far)]
        b, most = 1, None
        while b:
            e = via[b]
            most = cap[e] if most is None else min(most, cap[e])
            b = to[e ^ 1]
        b = 1
        while b:
            e = via[b]
            cap[e] -= most
            cap[e ^ 1] += most
            b = to[e ^ 1]
    out: dict[str, dict[str, int]] = {p: {} for p in patterns}
    for (p, s), e in sent.items():
        if cap[e ^ 1]:
            out[p][s] = cap[e ^ 1]
    return out


@dataclass
class Interval:
    pattern: str
    copy: int
    source: str
    low: int  # tokens from the start of the pattern's line
    high: int


def intervals(flow: dict[str, dict[str, int]], capacity: dict[str, int]) -> list[Interval]:
    """Lay each pattern's flows one after another along repetitions of its line."""
    out = []
    for p in sorted(flow):
        at, size = 0, capacity[p]
        for s in sorted(flow[p]):
            end = at + flow[p][s]
            while at < end:
                copy = at // size
                stop = min(end, (copy + 1) * size)
                out.append(Interval(p, copy + 1, s, at - copy * size, stop - copy * size))
                at = stop
    return out


# --- Spark ---------------------------------------------------------------------------------------------------
def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(TOKEN)), F.lit(0)).cast("long")


def _pattern(sources: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.coalesce(sources, F.array().cast("array<string>"))))), _SEP)


def _key(seed: int, id_col: str, text_col: str) -> Column:
    t = F.col(text_col).cast("string")
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(id_col).isNull(), t, t.isNull())


def _bounds(slim: DataFrame, cuts: set[tuple[str, int]]) -> dict[tuple[str, int], int | None]:
    """The smallest key at which as many tokens of the pattern lie before; None beyond the last."""
    spark = slim.sparkSession
    if not cuts:
        return {}
    wanted = spark.createDataFrame(sorted(cuts), "pattern string, cut long")
    by_range = slim.groupBy("pattern", F.shiftright("key", 64 - _RANGE_BITS).alias("range")).agg(F.sum("tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranged = by_range.withColumn("before", F.coalesce(before, F.lit(0)))
    hit = ranged.join(wanted, "pattern").where("before < cut").groupBy("pattern", "cut").agg(F.max(F.struct("range", "before")).alias("r"))
    places = hit.select("pattern", "cut", "r.range", "r.before")
    inside = slim.withColumn("range", F.shiftright("key", 64 - _RANGE_BITS)).join(places, ["pattern", "range"]).groupBy("pattern", "cut", "before", "key").agg(F.sum("tokens").alias("n"))
    run = F.sum("n").over(Window.partitionBy("pattern", "cut").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    first = inside.withColumn("c", F.col("before") + F.coalesce(run, F.lit(0))).where("c >= cut").groupBy("pattern", "cut").agg(F.min("key").alias("key"))
    found = places.join(first, ["pattern", "cut"], "left").select("pattern", "cut", "range", "key").collect()
    out: dict[tuple[str, int], int | None] = dict.fromkeys(cuts)
    for r in found:  # no such row in its range: the next range begins after the cut
        after = (r["range"] + 1) << (64 - _RANGE_BITS)
        out[r["pattern"], r["cut"]] = r["key"] if r["key"] is not None else (after if after < 1 << 63 else None)
    return out


@dataclass
class Plan:
    """What a mix decided: rows (pattern, copy, source, low key, high key); None is no bound."""

    rows: list[tuple[str, int, str, int | None, int | None]]
    capacity: dict[str, int]
    quota: dict[str, int]
    flow: dict[str, dict[str, int]]


def plan(slim: DataFrame, weigh, budget: int | None = None, epochs: int = EPOCHS) -> Plan:
    """slim: (key, pattern, tokens). weigh: {collection: weight}, or a function of {collection: tokens} that
    returns it. budget: tokens of the mix; all tokens of documents that have a collection if None."""
    capacity = {r.pattern: r.n for r in slim.groupBy("pattern").agg(F.sum("tokens").alias("n")).collect() if r.n}
    members = {p: p.split(_SEP) for p in capacity if p}
    own: dict[str, int] = {}
    for p, ss in members.items():
        for s in ss:
            own[s] = own.get(s, 0) + capacity[p]
    weights = weigh(own) if callable(weigh) else weigh
    usable = {p: n for p, n in capacity.items() if any(s in weights for s in members.get(p, ()))}
    quota = quotas(weights, sum(usable.values()) if budget is None else budget)
    flow = route(usable, members, quota, epochs)
    pieces = intervals(flow, usable)
    inner = {(i.pattern, x) for i in pieces for x in (i.low, i.high) if 0 < x < usable[i.pattern]}
    bound = _bounds(slim, inner)
    rows = []
    for i in pieces:
        low = bound[i.pattern, i.low] if i.low else None
        if i.low and low is None:
            continue  # nothing lies beyond
        rows.append((i.pattern, i.copy, i.source, low, bound[i.pattern, i.high] if i.high < usable[i.pattern] else None))
    return Plan(rows, capacity, quota, flow)


def select(keyed: DataFrame, p: Plan, key: str, pattern: str, source: str = "mix_source", copy: str = "mix_copy") -> DataFrame:
    """Join the decisions to rows that have a key and a pattern; adds the source and the copy."""
    names = [fresh(keyed.columns, x) for x in ("__p", "__low", "__high")]
    made = keyed.sparkSession.createDataFrame([(a, s, c, lo, hi) for a, c, s, lo, hi in p.rows], f"`{names[0]}` string, `{source}` string, `{copy}` int, `{names[1]}` long, `{names[2]}` long")
    if len(p.rows) <= 100_000:  # a few rows a pattern, of which the driver has the list
        made = F.broadcast(made)
    low, high = F.col(names[1]), F.col(names[2])
    inside = (low.isNull() | (F.col(key) >= low)) & (high.isNull() | (F.col(key) < high))
    return keyed.join(made, (F.col(pattern) == F.col(names[0])) & inside).drop(*names)


def by_family(own: dict[str, int], alpha: float = ALPHA) -> dict[str, float]:
    """An equal share of the mix for each family of collections (what precedes the colon in their names);
    inside a family tempered weights."""
    out: dict[str, float] = {}
    families = sorted({s.partition(":")[0] for s in own})
    for f in families:
        w = tempered({s: n for s, n in own.items() if s.partition(":")[0] == f}, alpha)
        total = sum(w.values()) or 1.0
        out |= {s: x / total / len(families) for s, x in w.items()}
    return out


def _prepared(df: DataFrame, sources: Column, id_col: str, text_col: str, seed: int):
    key, pattern = fresh(df.columns, "__key"), fresh(df.columns, "__pattern")
    keyed = df.withColumn(pattern, _pattern(sources)).withColumn(key, _key(seed, id_col, text_col))
    slim = keyed.select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.col(pattern).alias("pattern"), token_count(F.col(text_col)).alias("tokens"))
    return keyed, key, pattern, write_table(slim, "mix")


def mix(df: DataFrame, sources: Column, weigh=by_family, id_col: str = "doc_id", text_col: str = "text", budget: int | None = None, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of ``df`` in the mix, once for each copy, with ``mix_source`` and ``mix_copy``. sources: an
    array of the names of the collections to which a row belongs."""
    df = df.withColumn(fresh(df.columns, "__sources"), sources)
    held = df.columns[-1]
    return _mixed(make_room(df, ["mix_source", "mix_copy"]), held, ("mix_source", "mix_copy"), weigh, id_col, text_col, budget, epochs, seed)


def mix_rows(df: DataFrame, sources: Column, weigh=by_family, id_col: str = "doc_id", text_col: str = "text", budget: int | None = None, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of ``df`` in the mix, once for each copy, with their columns as they are."""
    columns = df.columns
    held, *names = (fresh(columns, x) for x in ("__sources", "__source", "__copy"))
    out = _mixed(df.withColumn(held, sources), held, tuple(names), weigh, id_col, text_col, budget, epochs, seed)
    return out.select(*[F.col(f"`{c}`") for c in columns])


def _mixed(df: DataFrame, held: str, names: tuple[str, str], weigh, id_col, text_col, budget, epochs, seed) -> DataFrame:
    with scratch(df.sparkSession):
        keyed, key, pattern, (slim, _) = _prepared(df, F.col(held), id_col, text_col, seed)
        decided = plan(slim, weigh, budget, epochs)
    return select(keyed, decided, key, pattern, *names).drop(key, pattern, held)


def mix_decisions(df: DataFrame, sources: Column, weigh=by_family, id_col: str = "doc_id", text_col: str = "text", budget: int | None = None, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, mix_source, mix_copy, tokens) of every copy in the mix; texts aren't read again."""
    with scratch(df.sparkSession):
        *_, (slim, path) = _prepared(df, sources, id_col, text_col, seed)
        keep_table(path)
    return select(slim, plan(slim, weigh, budget, epochs), "key", "pattern").select(F.col("id").alias("doc_id"), "mix_source", "mix_copy", "tokens")


def source_and_language() -> Column:
    """The collections of a document of the tables: its source, and its language."""
    return F.array(F.concat(F.lit("source:"), F.col("source")), F.concat(F.lit("lang:"), F.col("lang")))
