"""Road distances: parts of a graph that are searched side by side, a kernel for graphs of bounded size, neighbours, nearest sources."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .storage import materialize

#: Arcs of a graph that every worker may hold (about 40 bytes each); larger graphs are relaxed in DataFrames.
KERNEL_ARCS = 5_000_000
#: Nodes of a part of a larger graph, and shares of the groups that a part is searched for in one task.
PART_NODES, BUCKETS = 4096, 64


class Graph:
    """Neighbours of consecutive nodes in three arrays."""

    def __init__(self, u: np.ndarray, v: np.ndarray, length: np.ndarray):
        n = int(max(u.max(), v.max())) + 1 if len(u) else 0
        a, b, w = np.r_[u, v], np.r_[v, u], np.r_[length, length]
        order = np.lexsort((b, a))
        self.to, self.length = b[order], w[order]
        self.start = np.searchsorted(a[order], np.arange(n + 1))

    def distances(self, source: int, cutoff: float | None = None, paths: bool = False, targets: set[int] | None = None) -> tuple[dict[int, float], dict[int, int]]:
        """Distance of every node within the cutoff, and if asked the node before it on a shortest path; of equal paths, by the
        smallest node before. With targets, only until these are reached."""
        left = len(targets) if targets is not None else -1
        done: dict[int, float] = {}
        before: dict[int, int] = {}
        heap = [(0.0, source, -1)]
        while heap:
            d, x, p = heapq.heappop(heap)
            if x in done:
                continue
            done[x] = d
            if paths:
                before[x] = p
            if targets is not None and x in targets:
                left -= 1
                if not left:
                    break
            if x + 1 >= len(self.start):
                continue
            for i in range(self.start[x], self.start[x + 1]):
                y, e = int(self.to[i]), d + float(self.length[i])
                if y not in done and (cutoff is None or e <= cutoff):
                    heapq.heappush(heap, (e, y, x if paths else -1))
        return done, before


def broadcast_graph(edges: DataFrame):
    """The graph for workers, or None if it has more than KERNEL_ARCS arcs."""
    if edges.count() > KERNEL_ARCS:
        return None
    t = edges.select("u", "v", "length").toArrow()
    return edges.sparkSession.sparkContext.broadcast(Graph(*(t.column(c).to_numpy() for c in ("u", "v", "length"))))


def _parts(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs inside a part of PART_NODES nodes with neighbouring numbers (part, u, v, length), and both ways of those between parts (node, to, length)."""
    e = edges.select("u", "v", "length").withColumn("part", F.floor(F.col("u") / PART_NODES)).withColumn("other", F.floor(F.col("v") / PART_NODES))
    e = materialize(e, "parted")
    between = e.where("part <> other")
    return e.where("part = other").select("part", "u", "v", "length"), between.select("u", "v", "length").union(between.select("v", "u", "length")).toDF("node", "to", "length")


def _spread_inside(arcs: pa.Table, labels: pa.Table, tied: bool, number: int) -> pa.Table:
    """Labels of one part that fall when the fresh ones go along the arcs inside it, with the order in which they got their values."""
    out: dict[str, list] = {c: [] for c in ("grp", "owner", "node", "distance", "round")}
    known = labels.sort_by("grp") if labels.num_rows else labels
    ends = np.unique(np.r_[arcs.column("u").to_numpy(), arcs.column("v").to_numpy()]) if arcs.num_rows else np.zeros(0, np.int64)
    graph = Graph(np.searchsorted(ends, arcs.column("u").to_numpy()), np.searchsorted(ends, arcs.column("v").to_numpy()), arcs.column("length").to_numpy()) if len(ends) else None
    place = {x: k for k, x in enumerate(ends.tolist())}
    start, to, length = (graph.start.tolist(), graph.to.tolist(), graph.length.tolist()) if graph else ([], [], [])
    at, order = 0, number << 40
    groups = known.column("grp").to_pylist()
    columns = [known.column(c).to_pylist() for c in ("owner", "node", "distance", "fresh", "cutoff")]
    while at < len(groups):
        end = at
        best: dict[tuple, float] = {}
        least: dict[int, float] = {}
        heap = []
        while end < len(groups) and groups[end] == groups[at]:
            owner, node, d, fresh, _ = (c[end] for c in columns)
            if d < best.get((owner, node), math.inf):
                best[owner, node] = d
            if fresh:
                heap.append((d, node, owner))
            least[node] = min(d, least.get(node, math.inf))
            end += 1
        limit = math.inf if columns[4][at] is None else columns[4][at]
        heapq.heapify(heap)
        done = set()
        while heap:
            d, node, owner = heapq.heappop(heap)
            if (owner, node) in done or d > best[owner, node] or (tied and _behind(d, least[node])):
                continue
            done.add((owner, node))
            order += 1
            for c, x in zip(out.values(), (groups[at], owner, node, d, order), strict=True):
                c.append(x)
            k = place.get(node)
            for i in range(start[k], start[k + 1]) if k is not None else ():
                y, e = int(ends[to[i]]), d + length[i]
                if e <= limit and e < best.get((owner, y), math.inf) and not (tied and _behind(e, least.get(y, math.inf))):
                    best[owner, y] = e
                    least[y] = min(e, least.get(y, math.inf))
                    heapq.heappush(heap, (e, y, owner))
        at = end
    return pa.table({"grp": pa.array(out["grp"], labels.schema.field("grp").type), "owner": pa.array(out["owner"], pa.int64()), "node": pa.array(out["node"], pa.int64()), "distance": pa.array(out["distance"], pa.float64()), "round": pa.array(out["round"], pa.int64())})


def _behind(d: float, least: float) -> bool:
    """Whether a label is so far behind the nearest that it never is as near for any node beyond."""
    return d > least + 2 * max(1e-9, 1e-12 * max(1.0, d, least)) if least < math.inf else False


def _searching(tied: bool, number: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(arcs: pa.Table, labels: pa.Table) -> pa.Table:
        return _spread_inside(arcs, labels, tied, number)

    return run


def spread(sources: DataFrame, edges: DataFrame, limits: Callable[[DataFrame], DataFrame] | None = None, tied: bool = False) -> DataFrame:
    """grp, owner, node, distance, round: the smallest distances along arcs from sources (grp, owner, node), of each owner in a group.

    The graph is cut into parts of neighbouring node numbers. In a round, the parts that got new labels search inside, each in a task for some groups, and
    only labels that cross between parts move on; so rounds grow with the parts on the way and not with its arcs. round rises in the order in which
    labels got their values. limits: given the labels so far, grp and cutoff (null: none). tied: of each group and node only the owners that are about as
    near as the nearest are kept."""
    spark = sources.sparkSession
    keys = ["grp", "owner", "node"]
    inside, between = _parts(edges)
    kind = sources.schema["grp"].dataType.simpleString()
    schema = f"grp {kind}, owner long, node long, distance double, round long"
    front = materialize(sources.select(*keys).distinct().withColumn("distance", F.lit(0.0)), "spread-front")
    labels = spark.createDataFrame([], schema)
    part = F.floor(F.col("node") / PART_NODES).alias("part")
    bucket = F.pmod(F.xxhash64("grp"), F.lit(BUCKETS)).alias("bucket")
    number = 0
    while not front.isEmpty():
        number += 1
        cutoffs = limits(labels) if limits else None
        moved = front.select(*keys, "distance", F.lit(True).alias("fresh"), part, bucket)
        active = materialize(moved.select("part", "bucket").distinct(), "spread-active")
        old = labels.select(*keys, "distance", F.lit(False).alias("fresh"), part, bucket).join(active, ["part", "bucket"], "left_semi")
        given = old.unionByName(moved)
        given = given.join(cutoffs, "grp", "left") if cutoffs is not None else given.withColumn("cutoff", F.lit(None).cast("double"))
        own = inside.join(active, "part")
        fell = materialize(own.groupBy("part", "bucket").cogroup(given.groupBy("part", "bucket")).applyInArrow(_searching(tied, number), schema), "spread-fell")
        best = F.min(F.struct("distance", "round")).alias("b")
        labels = materialize(labels.unionByName(fell).groupBy(*keys).agg(best).select(*keys, "b.distance", "b.round"), "spread-labels")
        over = fell.join(between, "node").select("grp", "owner", F.col("to").alias("node"), (F.col("distance") + F.col("length")).alias("distance"))
        over = over.groupBy(*keys).agg(F.min("distance").alias("distance")).join(labels.select(*keys, F.col("distance").alias("old")), keys, "left").where("old is null or distance < old").drop("old")
        if cutoffs is not None:
            over = over.join(limits(labels), "grp", "left").where("cutoff is null or distance <= cutoff").drop("cutoff")
        if tied:
            least = labels.groupBy("grp", "node").agg(F.min("distance").alias("least"))
            over = over.join(least, ["grp", "node"], "left").where(F.col("least").isNull() | (F.col("distance") <= F.col("least") + 2 * tolerance(F.col("distance"), F.col("least")))).drop("least")
        front = materialize(over, "spread-front")
    return labels


def relaxed(sources: DataFrame, edges: DataFrame, cutoff: float | None = None, targets: DataFrame | None = None) -> DataFrame:
    """source, node, distance, round of spread() from single nodes; nothing that grows with the graph is held by one task.

    A column cutoff of sources is a limit for each of them. With targets (source, target), a label stops where it is longer than those of all targets of its
    source, once they have some; so what a source costs goes by its farthest target and the parts on the way, not by the network."""
    limit = F.max("cutoff") if "cutoff" in sources.columns else F.max(F.lit(cutoff).cast("double"))
    given = materialize(sources.groupBy(F.col("source").alias("grp")).agg(limit.alias("cutoff")), "relax-sources")
    wanted = None if targets is None else targets.select(F.col("source").alias("grp"), F.col("target").alias("node")).distinct()

    def limits(labels: DataFrame) -> DataFrame:
        if wanted is None:
            return given
        ends = wanted.join(labels.select("grp", "node", "distance"), ["grp", "node"], "left").groupBy("grp").agg(F.max("distance").alias("far"), F.max(F.col("distance").isNull()).alias("missing"))
        return given.join(ends, "grp", "left").select("grp", F.least("cutoff", F.when(~F.col("missing"), F.col("far"))).alias("cutoff"))

    found = spread(given.select("grp", F.lit(0).cast("long").alias("owner"), F.col("grp").alias("node")), edges, limits)
    return found.select(F.col("grp").alias("source"), "node", "distance", "round")


def distances(sources: DataFrame, edges: DataFrame, cutoff: float | None = None, kernel: bool | None = None) -> DataFrame:
    """source, node, distance of all nodes that roads lead to from each distinct source, within the cutoff."""
    shared = None if kernel is False else broadcast_graph(edges)
    if shared is None:
        return relaxed(sources.select("source"), edges, cutoff).drop("round")
    schema = StructType([StructField("source", LongType()), StructField("node", LongType()), StructField("distance", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        for b in batches:
            for s in b.column("source").to_pylist():
                d, _ = graph.distances(s, cutoff)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), s)), pa.array(list(d), pa.int64()), pa.array(list(d.values()), pa.float64())], names=schema.names)

    one = sources.select("source").distinct()
    return one.repartition("source").mapInArrow(run, schema)


def pair_distances(pairs: DataFrame, edges: DataFrame, shared=None) -> DataFrame:
    """source, target, distance of distinct pairs that roads connect. Each source is solved once, as far as its farthest target; only
    the pairs asked for leave a task. shared: the graph, if it was broadcast before."""
    asked = pairs.select("source", "target").distinct()
    shared = shared or broadcast_graph(edges)
    if shared is None:
        return relaxed(asked, edges, targets=asked).drop("round").withColumnRenamed("node", "target").join(asked, ["source", "target"])
    names = ["source", "target", "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, source, targets = shared.value, None, []

        def solved() -> pa.RecordBatch:
            d, _ = graph.distances(source, targets=set(targets))
            found = [t for t in targets if t in d]
            return pa.RecordBatch.from_arrays([pa.array([source] * len(found), pa.int64()), pa.array(found, pa.int64()), pa.array([d[t] for t in found], pa.float64())], names=names)

        for b in batches:
            for s, t in zip(b.column("source").to_pylist(), b.column("target").to_pylist(), strict=True):
                if s != source and targets:
                    yield solved()
                    targets = []
                source = s
                targets.append(t)
        if targets:
            yield solved()

    return asked.repartition("source").sortWithinPartitions("source").mapInArrow(run, "source long, target long, distance double")


def walked_back(asked: DataFrame, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, distance, path of pairs, from the labels of relaxed().

    The node before another is the smallest whose distance and arc make up its distance, as in the kernel. Pointers to the node 2 ** k steps before are
    doubled in tables; a path's nodes are then found from its target by the pointers, the longest first, so rounds grow with the
    logarithm of its arcs."""
    arcs = edges.select("u", "v", "length").union(edges.select("v", "u", "length")).toDF("before", "node", "length")
    come = labels.join(arcs, "node").join(labels.select("source", F.col("node").alias("before"), F.col("distance").alias("d"), F.col("round").alias("r")), ["source", "before"])
    # arcs may be too short to make a difference to a sum; then the round tells which came first
    come = come.where("d + length = distance and (d < distance or r < round)").where("node <> source")
    jumps = [materialize(come.groupBy("source", "node").agg(F.min("before").alias("before")), "pointers")]
    while True:
        last = jumps[-1]
        again = last.select("source", F.col("node").alias("before"), F.col("before").alias("far"))
        longer = materialize(last.join(again, ["source", "before"]).select("source", "node", F.col("far").alias("before")), "pointers")
        if longer.isEmpty():
            break
        jumps.append(longer)
    found = asked.join(labels.select("source", F.col("node").alias("target"), "distance"), ["source", "target"])
    on = found.select("source", "target", F.col("target").alias("node"), F.lit(0).cast("long").alias("step"))
    for k in reversed(range(len(jumps))):
        more = on.join(jumps[k], ["source", "node"]).select("source", "target", F.col("before").alias("node"), (F.col("step") + (1 << k)).alias("step"))
        on = materialize(on.unionByName(more), "path-nodes")
    ordered = F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("step", "node"))), lambda x: x["node"]))  # a path is one row in the end
    path = on.groupBy("source", "target").agg(ordered.alias("path"))
    return asked.join(found.join(path, ["source", "target"]), ["source", "target"], "left")


def paths_to(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, distance, path (nodes from source to target) of distinct pairs; null where no road leads. Each source is
    solved once for all its targets; on a graph beyond the kernel's size by relaxation, with the same result."""
    shared = broadcast_graph(edges)
    if shared is None:
        asked = materialize(pairs.select("source", "target").distinct(), "path-pairs")
        return walked_back(asked, relaxed(asked, edges, targets=asked), edges)
    schema = StructType([StructField("source", LongType()), StructField("target", LongType()), StructField("distance", DoubleType()), StructField("path", ArrayType(LongType()))])
    asked = pairs.select("source", "target").distinct().repartition("source").sortWithinPartitions("source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, last, found = shared.value, None, ({}, {})
        for b in batches:
            ds, ps = [], []
            for s, t in zip(b.column("source").to_pylist(), b.column("target").to_pylist(), strict=True):
                if s != last:
                    last, found = s, graph.distances(s, None, True)
                ds.append(found[0].get(t))
                path = []
                while t in found[0] and t != -1:
                    path.append(t)
                    t = found[1][t]
                ps.append(path[::-1] or None)
            yield pa.RecordBatch.from_arrays([b.column("source"), b.column("target"), pa.array(ds, pa.float64()), pa.array(ps, pa.list_(pa.int64()))], names=schema.names)

    return asked.mapInArrow(run, schema)


class TooManyPairs(ValueError):
    def __init__(self, count: int, most: int, radius: float):
        super().__init__(f"{count} neighbour pairs within {radius:g}; at most {most}")
        self.count, self.most, self.radius = count, most, radius


def same_arc_pairs(places: DataFrame, radius: float) -> DataFrame:
    """type, i, j, d of places on one arc that are at most radius apart along it, i < j. Arcs are cut into stretches of the radius,
    and a place meets those of its own stretch and of the next."""
    on = places.where("kind = 1").select("type", "position", "u", "v", "offset").withColumn("stretch", F.floor(F.col("offset") / radius))
    a = on.select("type", "u", "v", F.col("position").alias("p"), F.col("offset").alias("o"), F.explode(F.array(F.col("stretch") - 1, F.col("stretch"), F.col("stretch") + 1)).alias("stretch"))
    pairs = a.join(on, ["type", "u", "v", "stretch"]).where((F.col("p") < F.col("position")) & (F.abs(F.col("o") - F.col("offset")) <= radius))
    return pairs.select("type", F.col("p").alias("i"), F.col("position").alias("j"), F.abs(F.col("o") - F.col("offset")).alias("d"))


def attachments(places: DataFrame) -> DataFrame:
    """type, position, node, along: the ends of each place's arc and the way to them; a place on a vertex is at that vertex."""
    inside = places.where("kind = 1")
    return (
        places.where("kind = 0").select("type", "position", F.col("a").alias("node"), F.lit(0.0).alias("along"))
        .unionByName(inside.select("type", "position", F.col("u").alias("node"), F.col("offset").alias("along")))
        .unionByName(inside.select("type", "position", F.col("v").alias("node"), (F.col("arc_length") - F.col("offset")).alias("along")))
    )


def _most_pairs(at: DataFrame, roads: DataFrame, places: DataFrame, radius: float) -> dict[str, int]:
    """For each type a number that its pairs within the radius don't exceed, without making a pair. What is left of the radius at a vertex is compared with
    how far away the places there are, by running counts over both; a pair counts once for each pair of ends that joins it. Places on one arc
    are counted over ranges of their offsets."""
    asks = at.select("type", F.col("node").alias("source"), "along").join(roads, "source").select("type", "node", (F.lit(radius) - F.col("along") - F.col("distance")).alias("key"), F.lit(0).alias("here"), F.lit(1).alias("asks"))
    holds = at.select("type", "node", F.col("along").alias("key"), F.lit(1).alias("here"), F.lit(0).alias("asks"))
    # rounding of the sums differs from that of the pairs, so a little more than the radius counts
    slack = float(radius) * 1e-9
    near = F.expr(f"sum(here) over (partition by type, node order by key range between unbounded preceding and {slack!r}D following)")
    found = asks.where("key >= 0").unionByName(holds).withColumn("n", near).where("asks = 1")
    through = found.groupBy("type").agg(F.sum("n").alias("n"))
    same = F.expr(f"count(*) over (partition by type, u, v order by offset range between {radius + slack!r}D preceding and {slack!r}D following)")
    along = places.where("kind = 1").withColumn("n", same).groupBy("type").agg(F.sum("n").alias("n"))
    return {r["type"]: r["n"] // 2 for r in through.unionByName(along.withColumn("n", 2 * F.col("n"))).groupBy("type").agg(F.sum("n").alias("n")).collect()}


def pairs_within(places: DataFrame, edges: DataFrame, radius: float, most: int | None) -> tuple[DataFrame, dict[str, int]]:
    """The neighbour pairs (see neighbor_pairs) of all types that have at most `most`, and of other types the number.

    Pairs are written only once they are known to be few enough: from above, or where that does not tell, by an exact count."""
    if radius <= 0 or places.isEmpty():
        return places.sparkSession.createDataFrame([], "type string, i long, j long, d double"), {}
    at = materialize(attachments(places).where(F.col("along") <= radius), "attachments")
    roads = materialize(distances(at.select(F.col("node").alias("source")), edges, radius), "vertex-distances")
    left = at.select("type", F.col("position").alias("i"), F.col("node").alias("source"), F.col("along").alias("from_"))
    right = at.select("type", F.col("position").alias("j"), "node", F.col("along").alias("to_"))
    through = left.join(roads, "source").where(F.col("from_") + F.col("distance") <= radius).join(right, ["type", "node"])
    # summed from the side of the smaller position, so the result doesn't depend on the order of rows
    through = through.where("i < j").select("type", "i", "j", (F.col("from_") + F.col("distance") + F.col("to_")).alias("d")).where(F.col("d") <= radius)
    pairs = through.unionByName(same_arc_pairs(places, radius)).groupBy("type", "i", "j").agg(F.min("d").alias("d"))
    over: dict[str, int] = {}
    if most is not None and (unsure := [t for t, n in _most_pairs(at, roads, places, radius).items() if n > most]):
        exact = pairs.where(F.col("type").isin(unsure)).groupBy("type").count()
        over = {r["type"]: r["count"] for r in exact.where(F.col("count") > most).collect()}
    return materialize(pairs.where(~F.col("type").isin([*over])), "neighbours"), over


def neighbor_pairs(places: DataFrame, edges: DataFrame, radius: float, most: int | None = 20_000_000) -> DataFrame:
    """type, i, j, d: places of a type at most radius apart by road, i < j, each pair once with its smallest distance.

    Distances between vertices within the radius are found once for all types, from the vertices that have places; then
    both sides are attached. Places on one arc are compared directly too. More pairs than `most` are an error, by type."""
    pairs, over = pairs_within(places, edges, radius, most)
    if over:
        raise TooManyPairs(max(over.values()), most, radius)
    return pairs


def tolerance(a, b):
    return F.greatest(F.lit(1e-9), 1e-12 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)))


def nearest_sources(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """type, node, distance, cluster: of sources (type, cluster, node) the nearest by road to every node that one leads to; of those
    within the tolerance of the nearest, the smallest cluster. Labels of a node are spread together, per type and cluster."""
    labels = spread(sources.select(F.col("type").alias("grp"), F.col("cluster").alias("owner"), "node"), edges, tied=True).select(F.col("grp").alias("type"), F.col("owner").alias("cluster"), "node", "distance")
    least = labels.groupBy("type", "node").agg(F.min("distance").alias("least"))
    tied = labels.join(least, ["type", "node"]).where(F.col("distance") <= F.col("least") + tolerance(F.col("distance"), F.col("least")))
    return tied.groupBy("type", "node").agg(F.first("least").alias("distance"), F.min("cluster").alias("cluster"))
