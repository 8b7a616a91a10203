"""The density hierarchy of a type as tables, for types that are too large for one task.

A node of the hierarchy is named by its smallest position p and its distance d; a position is a node with distance -1, and everything hangs on the root
(-1, infinity). Nodes are made from the lightest edges up, in levels of edges; within one, the components that its edges make are independent of each
other, so each is merged in a task of its own. The condensed tree is read off the nodes by pointers that double."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .components import components
from .storage import materialize

LEAF, ROOT, INF = -1.0, -1, float("inf")
#: A key with more than this share of the rows of a join is looked up in a broadcast table, of 1 / HOT rows at most.
HOT = 0.001

NODES = StructType(
    [StructField("type", StringType())]
    + [StructField(n, t) for n, t in (("p", LongType()), ("d", DoubleType()), ("size", LongType()), ("pp", LongType()), ("pd", DoubleType()), ("psize", LongType()), ("plarge", LongType()))]
)


class Sets:
    """Disjoint sets of numbers, each named by its smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (y := self.up.get(root, root)) != root:
            root = y
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left joined with right, whose keys are unique; left is a written table. Frequent keys don't move: what right has for them is broadcast."""
    most = 1 + HOT * left.count()
    hot = F.broadcast(left.groupBy(*keys).count().where(F.col("count") > most).select(*keys))
    return left.join(F.broadcast(right.join(hot, keys)), keys).unionByName(left.join(hot, keys, "left_anti").join(right, keys))


def _levels(forest: DataFrame, most: int) -> tuple[DataFrame, int, list[set[str]]]:
    """type, cu, cv, m, level of all edges, the number of levels, and for each level the types for which it is a single distance. A level has about `most`
    edges of a type, and equal distances are never parted: one that alone has more is a level itself."""
    bounds, single = [], {}
    for r in forest.groupBy("type").count().collect():  # a row for each type
        k = -(-r["count"] // most)
        own: list[tuple[float, bool]] = []
        if k > 1:
            at = [x / k for x in range(1, k)]
            cuts = forest.where(F.col("type").eqNullSafe(r["type"])).agg(F.percentile_approx("m", at, max(10_000, 100 * k))).first()[0]
            for c in sorted(set(cuts)):
                if cuts.count(c) > 1:
                    single.setdefault(len(own) + 1, set()).add(r["type"])
                    own.append((c, False))
                own.append((c, True))
        bounds.append((r["type"], own))
    levels = max((len(b) for _, b in bounds), default=0) + 1
    at = forest.sparkSession.createDataFrame(bounds, "type string, bounds array<struct<c:double,closed:boolean>>")
    passed = F.size(F.filter("bounds", lambda x: (F.col("m") > x["c"]) | ((F.col("m") == x["c"]) & ~x["closed"])))
    e = forest.join(F.broadcast(at), "type").select("type", F.col("i").cast("long").alias("cu"), F.col("j").cast("long").alias("cv"), "m", passed.alias("level"))
    return e, levels, [single.get(x, set()) for x in range(levels)]


def _merged(rows: DataFrame, least: int) -> DataFrame:
    """Rows (type, root, edge, a, b, m, size) are nodes (b null) and edges of components: each is merged by its edges in a task, and gives its nodes
    with their parents, and its last node, without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets, top, touched, level, out = None, Sets(), {}, {}, None, []

        def close() -> None:
            groups: dict[int, list[int]] = {}
            for x in touched:
                groups.setdefault(sets.find(x), []).append(x)
            for p, members in groups.items():
                children = [top[x] for x in members]
                size = sum(n for _, _, n in children)
                large = sum(n >= least for _, _, n in children) if level > 0 else 0
                out.extend((key[0], *c, p, level, size, large) for c in children)
                top[p] = p, level, size
            touched.clear()

        def end() -> None:
            if key is not None:
                close()
                out.extend((key[0], *top[x], None, None, None, None) for x in top if sets.find(x) == x)

        def written() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(NODES)
            kinds = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=NODES.names)

        for batch in batches:  # sorted by type, root, edge, m
            for t, root, edge, a, b, m, n in zip(*[batch.column(c).to_pylist() for c in ("type", "root", "edge", "a", "b", "m", "size")], strict=True):
                if (t, root) != key:
                    end()
                    key, sets, top, level = (t, root), Sets(), {}, None
                if not edge:
                    top[a] = a, m, n
                    continue
                if m != level:
                    close()
                    level = m
                a, b = sets.find(a), sets.find(b)
                if sets.join(a, b):
                    touched[a] = touched[b] = True
            yield written()
        end()
        yield written()

    return rows.repartition("type", "root").sortWithinPartitions("type", "root", "edge", "m").mapInArrow(run, NODES)


def dendrogram(cores: DataFrame, forest: DataFrame, least: int, most: int) -> DataFrame:
    """All nodes of the hierarchies (type, p, d, size) with their parents: pp, pd, size of the parent (null for the root) and how many of its children have
    `least` points or more (0 for a parent at distance 0, inside which nothing is told apart)."""
    e, levels, single = _levels(forest, most)
    e = materialize(e, "levels")
    tops, tree = cores.select("type", F.col("position").alias("p"), F.lit(LEAF).alias("d"), F.col("weight").cast("long").alias("size")), None
    for level in range(levels):
        now = e.where(F.col("level") == level)
        pair = lambda c: F.struct("type", F.col(c).alias("c"))
        part = components(now.select(pair("cu").alias("u"), pair("cv").alias("v")))
        part = materialize(part.select("node.type", F.col("node.c").alias("p"), F.col("label.c").alias("root")), "level-parts")
        inside = materialize(tops.join(part, ["type", "p"]), "level-nodes")
        flat = F.coalesce(F.col("type").isin(*single[level]), F.lit(False)) if single[level] else F.lit(False)
        edges = now.where(~flat).join(part.withColumnRenamed("p", "cu"), ["type", "cu"])
        rows = inside.where(~flat).select("type", "root", F.lit(False).alias("edge"), F.col("p").alias("a"), F.lit(None).cast("long").alias("b"), F.col("d").alias("m"), "size")
        made = _merged(rows.unionByName(edges.select("type", "root", F.lit(True).alias("edge"), F.col("cu").alias("a"), F.col("cv").alias("b"), "m", F.lit(None).cast("long").alias("size"))), least)
        if single[level]:  # one distance: its components are the nodes
            at = now.where(flat).groupBy("type").agg(F.first("m").alias("pd"))  # a row for each type
            own = materialize(inside.where(flat).join(F.broadcast(at), "type"), "level-flat")
            large = F.sum(((F.col("size") >= least) & (F.col("pd") > 0)).cast("long"))
            sums = materialize(own.groupBy("type", "root", "pd").agg(F.sum("size").alias("psize"), large.alias("plarge")), "level-sums")
            made = made.unionByName(lookup(own, sums.drop("pd"), ["type", "root"]).withColumnRenamed("root", "pp").select(*NODES.names))
            none = [F.lit(None).cast(NODES[c].dataType).alias(c) for c in ("pp", "pd", "psize", "plarge")]
            made = made.unionByName(sums.select("type", F.col("root").alias("p"), F.col("pd").alias("d"), F.col("psize").alias("size"), *none))
        made = materialize(made, "level-merged")
        found = made.where("pp is not null")
        tree = found if tree is None else tree.unionByName(found)
        tops = materialize(tops.join(part, ["type", "p"], "left_anti").unionByName(made.where("pp is null").select(*tops.columns)), "level-tops")
        if level + 1 < levels:
            moved = e.where(F.col("level") > level)
            for c in ("cu", "cv"):
                moved = moved.join(part.select("type", F.col("p").alias(c), "root"), ["type", c], "left").withColumn(c, F.coalesce("root", c)).drop("root")
            e = materialize(moved, "levels")
    large = tops.groupBy("type").agg(F.sum((F.col("size") >= least).cast("long")).alias("plarge"))  # a row for each type
    roots = tops.join(F.broadcast(large), "type").select("type", "p", "d", "size", F.lit(ROOT).cast("long").alias("pp"), F.lit(INF).alias("pd"), F.lit(None).cast("long").alias("psize"), "plarge")
    return tree.unionByName(roots) if tree is not None else roots


def _ends(nodes: DataFrame) -> DataFrame:
    """nodes with hp, hd, where their pointers end; a pointer that is not done goes to a node that has one itself. Open pointers that meet are of one
    small subtree, so no node is looked up by many."""
    while True:
        nodes = materialize(nodes, "pointers")
        if nodes.where("not done").isEmpty():
            return nodes
        far = nodes.select("type", F.col("p").alias("hp"), F.col("d").alias("hd"), F.col("hp").alias("fp"), F.col("hd").alias("fd"), F.col("done").alias("far"))
        step = nodes.where("not done").join(far, ["type", "hp", "hd"]).withColumns({"hp": F.col("fp"), "hd": F.col("fd"), "done": F.col("far")})
        nodes = nodes.where("done").unionByName(step.select(*nodes.columns))


def _inverse(c: str) -> Column:
    return F.when(F.col(c) > 0, 1 / F.col(c)).otherwise(F.lit(INF))


def condense(cores: DataFrame, forest: DataFrame, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Where each position leaves its cluster (type, position, cp, cd, lam), and the clusters: type, cp, cd, the cluster above (up, ud), birth, members,
    stability and the largest lam within (end). The root is (-1, infinity), with birth 0."""
    tree = dendrogram(cores, forest, least, most)
    large = (F.col("size") >= least) & (F.col("pd") > 0)
    born = large & (F.col("plarge") >= 2)
    last = born | (~large & (F.coalesce("psize", F.lit(least)) >= least))  # a new cluster, or a part too small to be one
    nodes = tree.withColumns({"large": large, "born": born, "last": last}).withColumns(
        {"hp": F.when(F.col("last"), F.col("p")).otherwise(F.col("pp")), "hd": F.when(F.col("last"), F.col("d")).otherwise(F.col("pd")), "done": F.col("last") | (F.col("pp") == ROOT)}
    )
    nodes = _ends(nodes.select("type", "p", "d", "size", "pp", "pd", "large", "born", "last", "hp", "hd", "done"))
    # what is born or leaves does so in the cluster of its parent
    heads = nodes.where("large").select("type", F.col("p").alias("pp"), F.col("d").alias("pd"), F.col("hp").alias("cp"), F.col("hd").alias("cd"))
    ends = materialize(nodes.where(F.col("last") & (F.col("pp") != ROOT)).select("type", "p", "d", "size", "pp", "pd", "born"), "ends")
    at_root = nodes.where(F.col("last") & (F.col("pp") == ROOT)).select("type", "p", "d", "size", "pp", "pd", "born", F.lit(ROOT).cast("long").alias("cp"), F.lit(INF).alias("cd"))
    ends = lookup(ends, heads, ["type", "pp", "pd"]).unionByName(at_root)
    ends = materialize(ends.select("type", "p", "d", "size", "born", "cp", "cd", F.when(F.col("pp") == ROOT, F.lit(0.0)).otherwise(_inverse("pd")).alias("lam")), "ends")
    alone = nodes.where(F.col("large") & (F.col("d") == LEAF)).select("type", F.col("p").alias("position"), "size", F.col("hp").alias("cp"), F.col("hd").alias("cd"))
    alone = alone.join(cores.select("type", "position", F.coalesce("core", F.lit(INF)).alias("core")), ["type", "position"]).withColumn("lam", _inverse("core")).drop("core")
    small = nodes.where(~F.col("large") & (F.col("d") == LEAF)).select("type", F.col("p").alias("position"), F.col("hp").alias("p"), F.col("hd").alias("d"))
    exits = small.join(ends.select("type", "p", "d", "cp", "cd", "lam"), ["type", "p", "d"]).select("type", "position", "cp", "cd", "lam")
    exits = materialize(exits.unionByName(alone.select(*exits.columns)), "exits")
    root = cores.select("type").distinct().select("type", F.lit(ROOT).cast("long").alias("cp"), F.lit(INF).alias("cd"), F.lit(None).cast("long").alias("up"), F.lit(None).cast("double").alias("ud"), F.lit(0.0).alias("birth"), F.lit(0).cast("long").alias("members"))
    clusters = ends.where("born").select("type", F.col("p").alias("cp"), F.col("d").alias("cd"), F.col("cp").alias("up"), F.col("cd").alias("ud"), F.col("lam").alias("birth"), F.col("size").alias("members"))
    clusters = materialize(clusters.unionByName(root), "clusters")
    events = materialize(ends.select("type", "cp", "cd", "lam", "size").unionByName(alone.select("type", "cp", "cd", "lam", "size")), "events")
    stay = lookup(events, clusters.select("type", "cp", "cd", "birth"), ["type", "cp", "cd"])
    sums = stay.groupBy("type", "cp", "cd").agg(F.sum((F.col("lam") - F.col("birth")) * F.col("size")).alias("stability"), F.max("lam").alias("end"))
    return exits, materialize(clusters.join(sums, ["type", "cp", "cd"], "left").fillna(0.0, ["stability", "end"]), "clusters")


def numbered_clusters(a: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The clusters of one type, each after the one above it, the root first, and for each the number of the one above."""
    a = a.assign(below=a["cp"] != ROOT).sort_values(["birth", "below", "cp", "cd"], ignore_index=True)
    number = {c: k for k, c in enumerate(zip(a["cp"], a["cd"], strict=True))}
    return a, np.array([-1, *(number[int(p), d] for p, d in zip(a["up"][1:], a["ud"][1:], strict=True))], np.int64)


def share(exits: DataFrame, chosen: DataFrame) -> DataFrame:
    """type, position, label, membership, clusters from the exits of positions and what became of each cluster: its label, the length of the life that
    membership is measured by, and the lam from which on a position belongs to it."""
    x = lookup(exits, chosen, ["type", "cp", "cd"])
    inside = (F.col("label") >= 0) & (F.col("lam") >= F.col("from"))
    member = F.when((F.col("whole") == 0) | (F.col("lam") == INF), 1.0).otherwise(F.least("lam", "whole") / F.col("whole"))
    return x.select("type", "position", F.when(inside, F.col("label")).otherwise(-1).cast("long").alias("label"), F.when(inside, member).otherwise(0.0).alias("membership"), "clusters")
