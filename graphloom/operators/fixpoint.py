"""Fixpoint operators on edge tables: components, reachability, strong components.

Graphs under ``SMALL_EDGES`` edges, counted first, are solved by one task in linear time. Larger
ones are first cut into weak components, by contraction; whole components are dealt out to
tasks, and only a component that is itself larger is solved by driver loops of joins whose
state is written to the shared folder each round. All ways give the same rows (tested).
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.files import reading, writing
from graphloom.session import materialize, parts_for, shared_path, shuffle_width

#: Largest edge table that one task holds (two 8-byte numbers an edge).
SMALL_EDGES = 4_000_000
MAX_ROUNDS = 200


def _column(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[pa.ChunkedArray]:
    whole = list(batches)
    if not whole:
        return [pa.chunked_array([], pa.string()) for _ in names]
    table = pa.Table.from_batches(whole)
    return [table.column(n) for n in names]


def _coded(src: pa.ChunkedArray, dst: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Nodes in ascending order, and both edge ends as their positions."""
    kind = src.type
    nodes = pa.concat_arrays([*src.chunks, *dst.chunks]) if src.num_chunks + dst.num_chunks else pa.array([], kind)
    nodes = nodes.unique().drop_null()
    order = nodes.take(pa.compute.sort_indices(nodes)) if len(nodes) else nodes
    find = lambda c: np.asarray(pa.compute.index_in(c, value_set=order)).astype(np.int64)
    return order, find(src), find(dst)


def _min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable position of every node, ignoring direction."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def connected_components(edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst): component is the least node."""
    edges = materialize(edges.select("src", "dst").dropna(), "cc-edges")
    kind = edges.schema["src"].dataType.simpleString()
    if edges.count() <= small:
        return edges.coalesce(1).mapInArrow(_solve_components, f"node {kind}, component {kind}")
    return _contracted_components(edges, small)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _hash(column: str) -> Column:
    return F.xxhash64(column)


def _codes(edges: DataFrame) -> DataFrame:
    """(node, code): a different number for every node; hashes, or places should two hashes be equal."""
    names = _both_ways(edges).groupBy(_hash("src").alias("code")).agg(F.min("src").alias("node"), F.max("src").alias("other"))
    names = materialize(names, "cc-names")
    if not names.filter("node <> other").isEmpty():
        nodes = _both_ways(edges).select(F.col("src").alias("node")).distinct()
        return materialize(nodes.withColumn("code", F.monotonically_increasing_id()), "cc-names")
    return names.select("node", "code")


def _contracted_components(edges: DataFrame, small: int) -> DataFrame:
    """Every round merges each node into the least of its neighbours and itself, by another order.

    A round loses a part of all nodes, about half of a path's, so all rounds together cost a few
    times the first; the rest of at most ``small`` edges is solved by one task.
    """
    names = _codes(edges)
    a, b = names.select(F.col("node").alias("src"), F.col("code").alias("a")), names.select(F.col("node").alias("dst"), F.col("code").alias("b"))
    if names.filter(_hash("node") != F.col("code")).isEmpty():
        left = edges.select(_hash("src").alias("src"), _hash("dst").alias("dst"))
    else:
        left = edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    left, merged, order = materialize(left, "cc"), [], random.Random(1)
    while (n := left.count()) > small:
        mask = F.lit(order.getrandbits(63))
        up = _both_ways(left).groupBy(F.col("src").alias("node")).agg(F.min(F.col("dst").bitwiseXOR(mask)).alias("low"))
        up = up.select("node", F.least("low", F.col("node").bitwiseXOR(mask)).bitwiseXOR(mask).alias("up"))
        merged.append(up := materialize(up, "cc-up"))
        left = left.join(up.select(F.col("node").alias("src"), F.col("up").alias("a")), "src").join(up.select(F.col("node").alias("dst"), F.col("up").alias("b")), "dst")
        left = left.filter("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        left = materialize(left, "cc")
    root = left.coalesce(1).mapInArrow(_solve_components, "node long, component long") if n else None
    for up in reversed(merged):
        if root is None:
            root = up.select("node", F.col("up").alias("component"))
        else:
            root = up.join(root.withColumnRenamed("node", "up"), "up", "left").select("node", F.coalesce("component", "up").alias("component"))
    named = materialize(names.join(root.select(F.col("node").alias("code"), F.col("component").alias("root")), "code").select("node", "root"), "cc-roots")
    least = named.groupBy("root").agg(F.min("node").alias("component"))
    return named.join(least, "root").select("node", "component")


def _solve_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes, a, b = _coded(*_column(batches, ["src", "dst"]))
    if len(nodes):
        label = _min_labels(len(nodes), a, b)
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], ["node", "component"])


def _tagged(edges: DataFrame, small: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, component), ``edges`` with the weak component of each, and the components that no single task holds."""
    label = materialize(connected_components(edges, small), "label")
    tagged = materialize(edges.join(label.withColumnRenamed("node", "src"), "src").select("src", "dst", "component"), "tagged")
    return label, tagged, materialize(tagged.groupBy("component").count().filter(F.col("count") > small).select("component"), "large")


#: Edges that a task is given, when whole components are dealt out.
PART_EDGES = 400_000


def _tarjan(n: int, a: np.ndarray, b: np.ndarray) -> list[list[int]]:
    """Strong components, with an explicit stack."""
    order = np.argsort(a, kind="stable")
    to = b[order].tolist()
    start = np.searchsorted(a[order], np.arange(n + 1)).tolist()
    index, low, on = [-1] * n, [0] * n, bytearray(n)
    stack: list[int] = []
    out: list[list[int]] = []
    clock = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, start[root])]
        while work:
            v, i = work.pop()
            if index[v] < 0:
                index[v] = low[v] = clock
                clock += 1
                stack.append(v)
                on[v] = 1
            elif i > start[v]:
                low[v] = min(low[v], low[to[i - 1]]) if on[to[i - 1]] else low[v]
            while i < start[v + 1]:
                w = to[i]
                i += 1
                if index[w] < 0:
                    work.append((v, i))
                    work.append((w, start[w]))
                    break
                if on[w]:
                    low[v] = min(low[v], index[w])
            else:
                if low[v] == index[v]:
                    group = []
                    while True:
                        w = stack.pop()
                        on[w] = 0
                        group.append(w)
                        if w == v:
                            break
                    out.append(group)
    return out


def strong_components(edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """(node, component) of directed ``edges``: component is the least node of the cycle class."""
    edges = materialize(edges.select("src", "dst").dropna().distinct(), "scc-edges")
    kind, n = edges.schema["src"].dataType.simpleString(), edges.count()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, a, b = _coded(*_column(batches, ["src", "dst"]))
        if len(nodes):
            label = np.zeros(len(nodes), np.int64)
            for group in _tarjan(len(nodes), a, b):
                label[group] = min(group)
            yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], ["node", "component"])

    if n <= small:
        return edges.coalesce(1).mapInArrow(solve, f"node {kind}, component {kind}")
    _, tagged, large = _tagged(edges, small)
    width = max(shuffle_width(edges.sparkSession), parts_for(n, PART_EDGES))
    some = tagged.join(F.broadcast(large), "component", "left_anti")  # at most n / small rows
    some = some.repartition(width, "component").mapInArrow(solve, f"node {kind}, component {kind}")
    if large.isEmpty():
        return some
    return some.unionByName(_coloured_components(tagged.join(large, "component", "left_semi").select("src", "dst")))


def _spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Least label that reaches each node along ``edges`` (src, dst) from ``seeds`` (node, label)."""
    label = materialize(seeds, "scc-label")
    for _ in range(MAX_ROUNDS):
        sent = edges.join(label, edges.src == label.node).select(F.col("dst").alias("node"), "label")
        new = label.unionByName(sent).groupBy("node").agg(F.min("label").alias("label"))
        new = materialize(new, "scc-label")
        old = label.withColumnRenamed("label", "old")
        if new.join(old, "node").filter(F.col("label") != F.col("old")).isEmpty():
            return new
        label = new
    raise RuntimeError("labels did not converge")


def _coloured_components(edges: DataFrame) -> DataFrame:
    """Forward colouring, then backward search inside each colour from its root."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    left, found = materialize(nodes, "scc-nodes"), None
    for _ in range(MAX_ROUNDS):
        if left.isEmpty():
            return found
        own = edges.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi")
        own = materialize(own.select("src", "dst"), "scc-own")
        colour = _spread(own, left.select("node", F.col("node").alias("label")))
        tagged = own.join(colour.select(F.col("node").alias("src"), F.col("label").alias("ls")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("ld")), "dst")
        inside = tagged.filter("ls = ld").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.filter("node = label").select("node")
        back = roots
        done = materialize(roots.select("node", F.col("node").alias("component")), "scc-back")
        inside = materialize(inside, "scc-inside")
        front = done
        for _ in range(MAX_ROUNDS * 50):
            nxt = inside.join(front, inside.src == front.node).select(F.col("dst").alias("node"), "component").distinct()
            front = materialize(nxt.join(done.select("node"), "node", "left_anti"), "scc-front")
            if front.isEmpty():
                break
            done = materialize(done.unionByName(front), "scc-back")
        found = done if found is None else materialize(found.unionByName(done), "scc-found")
        left = materialize(left.join(done.select("node"), "node", "left_anti"), "scc-nodes")
    raise RuntimeError("strong components did not converge")


class _Adjacency:
    """A small graph as sorted nodes and their successors, read from its file once per process."""

    held: dict[str, _Adjacency] = {}

    def __init__(self, uri: str):
        with reading(uri) as f:
            table = pa.ipc.open_file(f).read_all()
        src, dst = table.column("src"), table.column("dst")
        self.nodes, a, b = _coded(src, dst)
        order = np.argsort(a, kind="stable")
        self.to = b[order].tolist()
        self.first = np.searchsorted(a[order], np.arange(len(self.nodes) + 1)).tolist()

    @classmethod
    def of(cls, uri: str) -> _Adjacency:
        if uri not in cls.held:
            cls.held.clear()
            cls.held[uri] = cls(uri)
        return cls.held[uri]

    def levels(self, seeds: list[int], max_depth: int | None) -> dict[int, int]:
        depth = dict.fromkeys(seeds, 0)
        front, d = list(depth), 0
        while front and (max_depth is None or d < max_depth):
            d += 1
            new = []
            for x in front:
                for y in self.to[self.first[x] : self.first[x + 1]]:
                    if y not in depth:
                        depth[y] = d
                        new.append(y)
            front = new
        return depth


def _reachable_by_start(edges: DataFrame, seeds: DataFrame, max_depth: int | None) -> DataFrame:
    """Every task searches from its own starts in the whole graph, which is a file of bounded size."""
    spark = edges.sparkSession
    uri = shared_path(spark, "adjacency") + ".arrow"
    kind, start = edges.schema["src"].dataType.simpleString(), seeds.schema["start"].dataType.simpleString()

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        with writing(uri) as out, pa.ipc.new_file(out, whole.schema) as f:
            f.write_table(whole)
        yield pa.RecordBatch.from_pydict({"n": pa.array([whole.num_rows], pa.int64())})

    found = edges.limit(1).count() > 0
    if found:
        edges.coalesce(1).mapInArrow(save, "n long").collect()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Seeds come sorted by start; those without an edge are their own only result."""
        graph = _Adjacency.of(uri) if found else None
        now, known, rows = None, [], [[], [], []]
        lone: list = []

        def flush(done) -> None:
            if known:
                levels = graph.levels(known, max_depth)
                ids = graph.nodes.take(pa.array(list(levels))).to_pylist()
                rows[0] += [done] * len(ids)
                rows[1] += ids
                rows[2] += levels.values()
            rows[0] += [done] * len(lone)
            rows[1] += lone
            rows[2] += [0] * len(lone)

        def batch_of(like: pa.RecordBatch) -> pa.RecordBatch:
            cols = [pa.array(rows[0], like.column("start").type), pa.array(rows[1], like.column("node").type), pa.array(rows[2], pa.int32())]
            for r in rows:
                r.clear()
            return pa.RecordBatch.from_arrays(cols, ["start", "node", "depth"])

        batch = None
        for batch in batches:
            at = pa.compute.index_in(batch.column("node"), value_set=graph.nodes) if found else pa.nulls(batch.num_rows, pa.int32())
            for s, node, i in zip(batch.column("start").to_pylist(), batch.column("node").to_pylist(), at.to_pylist()):
                if s != now:
                    flush(now)
                    known, lone, now = [], [], s
                    if len(rows[0]) > 50_000:
                        yield batch_of(batch)
                if i is None:
                    lone.append(node)
                else:
                    known.append(i)
        if batch is not None:
            flush(now)
            yield batch_of(batch)

    rows = seeds.select("start", "node").distinct().repartition(shuffle_width(spark), "start").sortWithinPartitions("start")
    return rows.mapInArrow(search, f"start {start}, node {kind}, depth int")


#: Results that a slice of the starts in one component should have, edges from which a component is cut into slices, and slices at most.
SLICE_ROWS, SLICED_EDGES, SLICES = 2_500_000, 10_000, 512


def _edges_and_seeds(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Array, list[int], list[int], pa.Array, np.ndarray, list[int]] | None:
    """Nodes, their successors by place, starts, and the seeds (start, node) by place, sorted by start."""
    whole = list(batches)
    if not whole:
        return None
    table = pa.Table.from_batches(whole)
    seed = table.column("dst").is_null()
    edges, seeds = table.filter(pa.compute.invert(seed)), table.filter(seed)
    nodes, a, b = _coded(edges.column("src"), edges.column("dst"))
    order = np.argsort(a, kind="stable")
    first = np.searchsorted(a[order], np.arange(len(nodes) + 1)).tolist()
    start = seeds.column("start").combine_chunks().dictionary_encode()
    of, at = np.asarray(start.indices), np.asarray(pa.compute.index_in(seeds.column("src"), value_set=nodes))
    place = np.argsort(of, kind="stable")
    return nodes, first, b[order].tolist(), start.dictionary, of[place], at[place].tolist()


def _search(first: list[int], to: list[int], seeds: list[int], mark: list[int], stamp: int, max_depth: int | None) -> tuple[list[int], list[int]]:
    """Nodes breadth first, and how many each level has; ``mark`` has no ``stamp`` yet."""
    found, sizes, low = [], [], 0
    for x in seeds:
        if mark[x] != stamp:
            mark[x] = stamp
            found.append(x)
    while low < len(found):
        high = len(found)
        sizes.append(high - low)
        if max_depth is not None and len(sizes) > max_depth:
            break
        for x in found[low:high]:
            for y in to[first[x] : first[x + 1]]:
                if mark[y] != stamp:
                    mark[y] = stamp
                    found.append(y)
        low = high
    return found, sizes


def _slices(tagged: DataFrame, seeds: DataFrame, max_depth: int | None, total: int) -> DataFrame:
    """(component, k): into how many slices the starts of a large component are cut, by a few searches in each."""
    kind = tagged.schema["component"].dataType.simpleString()
    most = tagged.groupBy("component").agg(F.count("*").alias("edges")).filter(F.col("edges") > max(SLICED_EDGES, total // 100_000))  # at most 100,000 rows
    most = materialize(most, "most")
    starts = seeds.join(F.broadcast(most), "component").groupBy("component", "edges").agg(F.count_distinct("start").alias("starts"))
    many = materialize(starts.filter(F.col("starts") * F.col("edges") > SLICE_ROWS), "sliced")

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = list(batches)
        table = pa.Table.from_batches(whole) if whole else None
        for component in table.column("component").unique() if whole else ():
            own = table.filter(pa.compute.equal(table.column("component"), component))
            nodes, a, b = _coded(own.column("src"), own.column("dst"))
            order = np.argsort(a, kind="stable")
            first, to, mark = np.searchsorted(a[order], np.arange(len(nodes) + 1)).tolist(), b[order].tolist(), [-1] * len(nodes)
            some = random.Random(1).sample(range(len(nodes)), min(len(nodes), 100))
            n = sum(len(_search(first, to, [x], mark, x, max_depth)[0]) for x in some) / len(some)
            yield pa.RecordBatch.from_arrays([pa.array([component.as_py()], own.column("component").type), pa.array([n], pa.float64())], ["component", "mean"])

    mean = tagged.join(F.broadcast(many.select("component")), "component").repartition(shuffle_width(tagged.sparkSession), "component").mapInArrow(tried, f"component {kind}, mean double")
    k = F.least(F.lit(SLICES), F.ceil(F.col("starts") * F.col("mean") / SLICE_ROWS)).cast("int")
    return materialize(mean.join(many, "component").select("component", k.alias("k")).filter("k > 1"), "slices")


def _dealt(tagged: DataFrame, seeds: DataFrame, max_depth: int | None) -> DataFrame:
    """Edges (src, dst) and seeds (start, src) in partitions that hold the whole component of each seed."""
    total = tagged.count()
    slices = _slices(tagged, seeds, max_depth, total)
    k = F.coalesce("k", F.lit(1))
    edges = tagged.join(F.broadcast(slices), "component", "left")
    edges = edges.select("component", F.explode(F.sequence(F.lit(0), k - 1)).alias("slice"), F.lit(None).cast(seeds.schema["start"].dataType).alias("start"), "src", "dst")
    own = seeds.join(F.broadcast(slices), "component", "left")
    own = own.select("component", F.pmod(F.xxhash64("start"), k).cast("int").alias("slice"), "start", F.col("node").alias("src"), F.lit(None).cast(tagged.schema["dst"].dataType).alias("dst"))
    more = slices.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    width = max(shuffle_width(tagged.sparkSession), parts_for(total, PART_EDGES) + 2 * more)
    return edges.unionByName(own).repartition(width, "component", "slice").select("start", "src", "dst")


def _reachable_in_parts(dealt: DataFrame, max_depth: int | None, counted: bool) -> DataFrame:
    """(start, node, depth), or with ``counted`` (start, n), of partitions from ``_dealt``."""
    start, kind = dealt.schema["start"].dataType.simpleString(), dealt.schema["src"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _edges_and_seeds(batches)
        if whole is None:
            return
        nodes, first, to, starts, of, at = whole
        ends = np.searchsorted(of, np.arange(len(starts) + 1)).tolist()
        mark, rows, lengths, found, depths = [-1] * len(nodes), [], [], [], []

        def batch() -> pa.RecordBatch:
            who = pa.array(rows, pa.int64())
            if counted:
                return pa.RecordBatch.from_arrays([starts.take(who), pa.array(lengths, pa.int64())], ["start", "n"])
            depth = np.concatenate([np.repeat(np.arange(len(d), dtype=np.int32), d) for d in depths])
            return pa.RecordBatch.from_arrays([starts.take(pa.array(np.repeat(rows, lengths))), nodes.take(pa.array(found, pa.int64())), pa.array(depth)], ["start", "node", "depth"])

        for s in range(len(starts)):
            some, sizes = _search(first, to, at[ends[s] : ends[s + 1]], mark, s, max_depth)
            rows.append(s)
            lengths.append(len(some))
            if not counted:
                found += some
                depths.append(sizes)
            if len(found) > 500_000 or len(rows) > 100_000:
                yield batch()
                for x in (rows, lengths, found, depths):
                    x.clear()
        if rows:
            yield batch()

    return dealt.mapInArrow(search, f"start {start}, n long" if counted else f"start {start}, node {kind}, depth int")


def _reachable_by_rounds(edges: DataFrame, seeds: DataFrame, max_depth: int | None) -> DataFrame:
    """Each round sends only the new frontier, and a node is sent once per start."""
    front = materialize(seeds.select("start", "node", F.lit(0).alias("depth")).distinct(), "bfs")
    seen, depth = front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(edges, front.node == edges.src).select("start", F.col("dst").alias("node")).distinct()
        step = step.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        front = materialize(step.withColumn("depth", F.lit(depth)), "bfs")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if depth % 8 == 0:
            seen = materialize(seen, "bfs-seen")
    return seen


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, small: int = SMALL_EDGES, counted: bool = False) -> DataFrame:
    """Breadth-first levels: (start, node, depth) with each node at its least depth.

    ``edges`` (src, dst), ``seeds`` (start, node), without nulls. The seeds have depth 0. With
    ``counted`` (start, n), the number of nodes, which leave no task. Tasks search in whole weak
    components; starts in one component are shared out among tasks by what they will reach.
    """
    edges = materialize(edges.select("src", "dst").dropna().distinct(), "bfs-edges")
    total = lambda df: df.groupBy("start").agg(F.count("*").alias("n"))
    if edges.count() <= small:
        found = _reachable_by_start(edges, seeds, max_depth)
        return total(found) if counted else found
    label, tagged, large = _tagged(edges, small)
    seeds = materialize(seeds.select("start", "node").distinct().join(label, "node", "left"), "seeds")
    lone = seeds.filter("component is null").select("start", "node", F.lit(0).alias("depth"))
    inside = seeds.filter("component is not null")
    if large.isEmpty():
        rest = None
    else:
        rest = _reachable_by_rounds(tagged.join(F.broadcast(large), "component", "left_semi").select("src", "dst"), inside.join(F.broadcast(large), "component", "left_semi"), max_depth)
        tagged, inside = (x.join(F.broadcast(large), "component", "left_anti") for x in (tagged, inside))
    found = _reachable_in_parts(_dealt(tagged, inside, max_depth), max_depth, counted)
    if not counted:
        return reduce(DataFrame.unionByName, [found, lone, *([rest] if rest is not None else [])])
    parts = reduce(DataFrame.unionByName, [found, lone.select("start", F.lit(1).cast("long").alias("n")), *([total(rest)] if rest is not None else [])])
    return parts.groupBy("start").agg(F.sum("n").alias("n"))


def longest_layers(edges: DataFrame, nodes: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """(node, layer): 0 without out-edges, else 1 + the largest layer of the targets; acyclic input."""
    edges = materialize(edges.select("src", "dst").distinct(), "layer-edges")
    if edges.count() <= small:
        kind = edges.schema["src"].dataType.simpleString()

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, a, b = _coded(*_column(batches, ["src", "dst"]))
            if not len(names):
                return
            layer, left = np.zeros(len(names), np.int32), np.bincount(a, minlength=len(names))
            order = np.argsort(b, kind="stable")
            callers, first = a[order], np.searchsorted(b[order], np.arange(len(names) + 1))
            ready, n = np.flatnonzero(left == 0).tolist(), 0
            while ready:
                x = ready.pop()
                n += 1
                for y in callers[first[x] : first[x + 1]].tolist():
                    layer[y] = max(layer[y], layer[x] + 1)
                    left[y] -= 1
                    if not left[y]:
                        ready.append(y)
            if n < len(names):
                raise RuntimeError("layers need an acyclic input")
            yield pa.RecordBatch.from_arrays([names, pa.array(layer)], ["node", "layer"])

        some = edges.coalesce(1).mapInArrow(solve, f"node {kind}, layer int")
        return nodes.select("node").join(some, "node", "left").select("node", F.coalesce("layer", F.lit(0)).alias("layer"))
    layer = materialize(nodes.select("node", F.lit(0).alias("layer")), "layer")
    for _ in range(MAX_ROUNDS * 10):
        up = edges.join(layer, edges.dst == layer.node).groupBy("src").agg((F.max("layer") + 1).alias("up"))
        new = layer.join(up.withColumnRenamed("src", "node"), "node", "left").select("node", F.coalesce("up", F.lit(0)).alias("layer"))
        new = materialize(new, "layer")
        if new.join(layer.withColumnRenamed("layer", "old"), "node").filter("layer <> old").isEmpty():
            return new
        layer = new
    raise RuntimeError("layers did not converge; is the input acyclic?")


def kind_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType
