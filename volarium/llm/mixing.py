"""Mixing overlapping sources to target weights by min-cost flow.

A document belongs to one or more sources; its membership pattern is the set of them. Documents are aggregated by
pattern, and a flow network routes word capacity: every pattern offers its words once at cost 0, a second time at cost 1 and
so on up to `max_copies` (convex costs of repetition); a pattern reaches its sources, and a source takes up to its
target. A cheapest maximal flow is found by successive shortest paths. All paths through the same repetition cost
the same, so they are augmented together by blocking flows, repetition by repetition. The flow of a pattern is then
turned into documents: they are ordered by a seeded hash cut into 65536 bins, and a route goes through all bins in that order and takes
those that still fit; a bin that does not fit is passed over.

Only the sums by pattern reach the driver: at most `max_patterns` patterns, checked; the plan, for each route
a bounded number of bin ranges or at most 65536 bits, is broadcast if it cannot exceed 64 MB, and joined by shuffle otherwise.
Selection is a narrow pass over the documents. Texts of any length are counted whole.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; an empty membership takes part in nothing;
rows with equal ids and texts are taken alike; an empty table gives an empty table; other columns pass through unless they are
named like a result column, which replaces them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volarium.session import stage

RESULT = ("size", "routes", "copies", "taken")
BINS = 1 << 16
MOST_RANGES = 64  # of a route; more are stored as bits
MOST_ROUTE_BYTES = BINS // 8 + 256
BROADCAST_BYTES = 64 << 20  # a plan that may be larger is joined by shuffle
PLAN = "pattern__ array<string>, plan__ array<struct<copy:int,source:string,first:int,last:int,bits:array<bigint>>>"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_order(names: Sequence[str | None]) -> list[str | None]:
    """By code point, null last."""
    return sorted(set(names), key=lambda s: (s is None, s or ""))


def targets(sizes: Sequence[float], weights: Sequence[float], budget: float, max_copies: float) -> list[float]:
    """Shares of the budget by weight; a share above `max_copies` times its source's size stops there and the excess is shared again."""
    limit = [max_copies * s for s in sizes]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = budget
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > limit[i]} if total > 0 else set()
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total if total > 0 else 0.0
            break
        for i in over:
            out[i] = limit[i]
        left -= sum(limit[i] for i in sorted(over))
        open_ -= over
    return out


class FlowNetwork:
    """Maximal flow by blocking flows; edges can be opened later, which keeps the flow found so far."""

    def __init__(self, nodes: int) -> None:
        self.edges: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[float] = []

    def edge(self, a: int, b: int, room: float) -> int:
        self.edges[a].append(len(self.to))
        self.edges[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [room, 0.0]
        return len(self.to) - 2

    def flow(self, edge: int) -> float:
        return self.room[edge ^ 1]

    def _depths(self, source: int, sink: int, least: float) -> list[int] | None:
        depth = [-1] * len(self.edges)
        depth[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in self.edges[v]:
                if self.room[e] > least and depth[self.to[e]] < 0:
                    depth[self.to[e]] = depth[v] + 1
                    queue.append(self.to[e])
        return depth if depth[sink] >= 0 else None

    def augment(self, source: int, sink: int, least: float) -> None:
        while (depth := self._depths(source, sink, least)) is not None:
            at = [0] * len(self.edges)
            path: list[int] = []
            v = source
            while True:
                if v == sink:
                    push = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= push
                        self.room[e ^ 1] += push
                    first = next(k for k, e in enumerate(path) if self.room[e] <= least)
                    v = self.to[path[first] ^ 1]
                    del path[first:]
                    continue
                while at[v] < len(self.edges[v]):
                    e = self.edges[v][at[v]]
                    if self.room[e] > least and depth[self.to[e]] == depth[v] + 1:
                        break
                    at[v] += 1
                else:
                    if not path:
                        break
                    at[self.to[path[-1] ^ 1]] += 1
                    v = self.to[path.pop() ^ 1]
                    continue
                path.append(e)
                v = self.to[e]


def route(patterns: Sequence[tuple[Sequence[int], float]], wanted: Sequence[float], max_copies: int) -> list[list[tuple[int, int, float]]]:
    """For each pattern (sources, size) its routes (copy, source, words); the words of a copy sum to the size at most."""
    p, s = len(patterns), len(wanted)
    net = FlowNetwork(p + s + 2)
    begin, end = p + s, p + s + 1
    least = 1e-9 * max([1.0, *wanted])
    inner = [[(j, net.edge(k, p + j, float("inf"))) for j in members] for k, (members, _) in enumerate(patterns)]
    for j, w in enumerate(wanted):
        net.edge(p + j, end, w)
    out: list[list[tuple[int, int, float]]] = [[] for _ in patterns]
    offers = []
    for copy in range(max_copies):
        offers.append([net.edge(begin, k, float(size)) for k, (_, size) in enumerate(patterns)])
        net.augment(begin, end, least)
    for k, edges in enumerate(inner):
        rest = [net.flow(e) for _, e in edges]
        for copy in range(max_copies):  # deal the pattern's flows to its copies, one copy after the other
            room = net.flow(offers[copy][k])
            for i, (j, _) in enumerate(edges):
                take = min(room, rest[i])
                if take > least:
                    out[k].append((copy, j, take))
                    rest[i] -= take
                    room -= take
    return out


def bin_ranges(numbers: Sequence[int], places: Sequence[int]) -> list[dict]:
    """Sorted bins as ranges of neighbours in the pattern's order (places); many ranges as one with a bit for each bin, from the 64 that hold the first."""
    out: list[dict] = []
    for number, place in zip(numbers, places, strict=True):
        if out and out[-1]["next"] == place:
            out[-1].update(last=number, next=place + 1)
        else:
            out.append({"first": number, "last": number, "next": place + 1})
    if len(out) > MOST_RANGES:
        start = numbers[0] >> 6
        bits = np.zeros(((numbers[-1] >> 6) - start + 1) * 64, np.uint8)
        bits[np.asarray(numbers) - start * 64] = 1
        out = [{"first": numbers[0], "last": numbers[-1], "bits": np.packbits(bits, bitorder="little").view("<i8").tolist()}]
    return [{"first": x["first"], "last": x["last"], "bits": x.get("bits")} for x in out]


def choose_bins(ways: Sequence[tuple[int, str | None, float]], bins: pa.Table) -> pa.Table:
    """Bins for the routes (copy, source, words) of one pattern, as ranges or bits.

    A route goes through all bins in order, takes each that still fits, and one more bin if that comes nearer. A copy takes
    no bin twice.
    """
    order = np.argsort(bins.column("bin__").to_numpy())
    number, size = bins.column("bin__").to_numpy()[order].tolist(), bins.column("size").to_numpy()[order].tolist()
    free: dict[int, list[bool]] = {}
    plan = []
    for copy, source, words in ways:
        open_ = free.setdefault(copy, [True] * len(size))
        taken = []
        for k in range(len(size)):
            if open_[k] and size[k] <= words:
                words -= size[k]
                open_[k] = False
                taken.append(k)
        best = min((i for i in range(len(size)) if open_[i]), key=lambda i: abs(size[i] - words), default=None)
        if best is not None and abs(size[best] - words) < words:
            open_[best] = False
            taken.append(best)
        taken.sort()
        plan += [{"copy": copy, "source": source, **x} for x in bin_ranges([number[i] for i in taken], taken)]
    rows = [plan] if plan else []
    kind = pa.list_(pa.struct([("copy", pa.int32()), ("source", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("bits", pa.list_(pa.int64()))]))
    return pa.table({"pattern__": pa.array([bins.column("members__")[0].as_py()] * len(rows), pa.list_(pa.string())), "plan__": pa.array(rows, kind)})


def mix(docs: DataFrame, membership: Column, weights: Callable[[int], float], budget_ratio: float = 1.5, max_copies: int = 2, seed: int = 11,
        id_col: str = "doc_id", text_col: str = "text", max_patterns: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Documents with size, routes (copy and source of each time it is taken), copies and taken (words), and the table
    of sources (source, source_size, target). `weights` gives the weight of the k-th source in order."""
    spark = docs.sparkSession
    docs = docs.drop(*RESULT)
    bin_ = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(BINS)).cast("int")
    members = F.array_sort(F.array_distinct(membership))
    keyed = docs.withColumns({"members__": members, "bin__": bin_, "size": word_count(F.col(text_col))})
    sums = keyed.groupBy("members__", "bin__").agg(F.sum("size").alias("size"))
    binned = stage(sums, "mix-bins").table
    by_pattern = binned.groupBy("members__").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(by_pattern) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    by_pattern = sorted((r for r in by_pattern if r[0]), key=lambda r: [(s is None, s or "") for s in r[0]])
    names = source_order([s for r in by_pattern for s in r[0]])
    place = {s: k for k, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in by_pattern:
        for s in r[0]:
            sizes[place[s]] += r[1]
    wanted = targets(sizes, [weights(k) for k in range(len(names))], budget_ratio * sum(r[1] for r in by_pattern), max_copies)
    routes = route([([place[s] for s in r[0]], r[1]) for r in by_pattern], wanted, max_copies)

    ways = {tuple(r[0]): [(copy, names[j], words) for copy, j, words in of] for r, of in zip(by_pattern, routes, strict=True)}
    chosen_bins = binned.where("size > 0").groupBy("members__").applyInArrow(lambda key, bins: choose_bins(ways.get(tuple(key[0].as_py() or ()), ()), bins), PLAN)
    found = stage(chosen_bins, "mix-plan")
    small = found.rows <= BROADCAST_BYTES // (MOST_ROUTE_BYTES * max(1, max(map(len, routes), default=0)))
    chosen = keyed.join(F.broadcast(found.table) if small else found.table, F.col("members__").eqNullSafe(F.col("pattern__")), "left")
    hits = F.expr("filter(plan__, x -> bin__ >= x.first and bin__ <= x.last and "
                  "(x.bits is null or getbit(get(x.bits, shiftright(bin__, 6) - shiftright(x.first, 6)), bin__ & 63) = 1))")
    taken = chosen.withColumn("routes", F.coalesce(F.transform(hits, lambda x: F.struct(x["copy"].alias("copy"), x["source"].alias("source"))),
                                                   F.array().cast("array<struct<copy:int,source:string>>")))
    taken = taken.withColumn("copies", F.size("routes")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    sources = spark.createDataFrame([(s, int(sizes[k]), float(wanted[k])) for s, k in place.items()], "source string, source_size long, target double")
    return taken.select(*docs.columns, *RESULT), sources
