"""The economic graph: transactions, technical coefficients and the maximum-weight acyclic subgraph.

Tables are long: source, target, value. The number of sectors is bounded by the classification (16 or 80)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sectors import sector_id
from .storage import materialize, require

#: Sectors that one reachability mask holds; two masks hold the largest classification.
BITS = 62
MOST_SECTORS = 2 * BITS


def validated(table: DataFrame) -> DataFrame:
    """Normal sector ids on both axes, each pair once, equal axes, finite values of 0 or more."""
    t = table.select(sector_id(F.col("source")).alias("source"), sector_id(F.col("target")).alias("target"), F.col("value").cast("double").alias("value"))
    t = materialize(t, "io-table")  # a row for each pair of sectors; checks and users read it, not what it came from
    require(t.where("source is null or target is null"), "rows without a sector")
    require(t.where("value is null or isnan(value) or value = double('Infinity') or value < 0"), "values must be finite and not negative")
    require(t.groupBy("source", "target").count().where("count > 1"), "repeated sector pairs")
    a, b = t.select(F.col("source").alias("sector")).distinct(), t.select(F.col("target").alias("sector")).distinct()
    require(a.join(b, "sector", "left_anti").unionByName(b.join(a, "sector", "left_anti")), "sectors on one axis only")
    return t


def squared(table: DataFrame) -> DataFrame:
    """With a row for every pair of the sectors on either axis; those that a long table leaves out are 0."""
    table = materialize(table, "io-long")
    names = table.select(F.col("source").alias("s")).union(table.select("target")).distinct().agg(F.collect_list("s").alias("names"))  # the classification's
    pairs = names.select(F.explode("names").alias("source"), "names").select("source", F.explode("names").alias("target"))
    return pairs.join(table, ["source", "target"], "left").na.fill(0.0, ["value"])


def technical_coefficients(z: DataFrame, x: DataFrame) -> DataFrame:
    """value = z / gross output of the using sector; x: sector, total_output, finite and above 0."""
    require(x.where("total_output is null or isnan(total_output) or total_output <= 0 or total_output = double('Infinity')"), "gross output must be finite and positive")
    require(z.select(F.col("target").alias("sector")).distinct().join(x, "sector", "left_anti"), "sectors without gross output")
    return z.join(x.withColumnRenamed("sector", "target"), "target").select("source", "target", (F.col("value") / F.col("total_output")).alias("value"))


def candidate_edges(z: DataFrame) -> DataFrame:
    """Positive values between different sectors."""
    return z.where("value > 0 and source <> target")


def fast_acyclic(z: DataFrame) -> DataFrame:
    """source, target, value of the greedy acyclic subgraph: edges by falling value, then names, each kept unless its target
    already reaches its source.

    A fold over the sorted edges in one expression. Its state is, for each sector, the set of sectors that it reaches, as
    bits. The edges are at most the square of the number of sectors, which is checked."""
    edges = materialize(candidate_edges(z), "candidate-edges")  # a row for each pair of sectors at most
    names = edges.select(F.col("source").alias("s")).union(edges.select("target")).distinct().groupBy().agg(F.array_sort(F.collect_list("s")).alias("names"))
    n = edges.select(F.col("source").alias("s")).union(edges.select("target")).distinct().count()
    if n > MOST_SECTORS:
        raise ValueError(f"at most {MOST_SECTORS} sectors, not {n}")
    indexed = edges.join(F.broadcast(names)).select(
        F.struct(
            (-F.col("value")).alias("w"), "source", "target", (F.array_position("names", F.col("source")) - 1).cast("int").alias("u"), (F.array_position("names", F.col("target")) - 1).cast("int").alias("v")
        ).alias("e")
    )
    one = "if({0} < %d, named_struct('a', shiftleft(1L, {0}), 'b', 0L), named_struct('a', 0L, 'b', shiftleft(1L, {0} - %d)))" % (BITS, BITS)
    has = "if({0} < %d, shiftrightunsigned({1}.a, {0}) & 1L, shiftrightunsigned({1}.b, {0} - %d) & 1L) = 1L" % (BITS, BITS)
    # sectors are numbered from 0; element_at counts from 1
    step = f"""(s, e) -> if({has.format('e.u', 'element_at(s.reach, e.v + 1)')}, s, named_struct(
        'reach', transform(s.reach, x -> if({has.format('e.u', 'x')}, named_struct('a', x.a | element_at(s.reach, e.v + 1).a, 'b', x.b | element_at(s.reach, e.v + 1).b), x)),
        'kept', concat(s.kept, array(e))))"""
    none = "cast(array() as array<struct<w:double,source:string,target:string,u:int,v:int>>)"
    fold = f"aggregate(edges, named_struct('reach', transform(sequence(0, {max(n, 1) - 1}), i -> {one.format('i')}), 'kept', {none}), {step}, s -> s.kept)"
    kept = indexed.agg(F.array_sort(F.collect_list("e")).alias("edges")).select(F.explode(F.expr(fold)).alias("e"))
    return kept.select("e.source", "e.target", (-F.col("e.w")).alias("value"))


def _order_of(members: list[str], weight: dict[tuple[str, str], float]) -> list[str]:
    """The order with the largest forward weight, by subsets: what a set earns when its sectors come first, in the best order."""
    n, half = len(members), len(members) // 2
    w = np.array([[weight.get((a, b), 0.0) for b in members] for a in members])

    def sums(rows: np.ndarray) -> np.ndarray:
        """For each set of the rows, their sum."""
        out = np.zeros((1 << len(rows), n))
        for i, r in enumerate(rows):
            out[1 << i : 2 << i] = out[: 1 << i] + r
        return np.ascontiguousarray(out.T)

    low, high = sums(w[:half]), sums(w[half:])
    earned = lambda v, t: best[t] + (low[v][t & ((1 << half) - 1)] + high[v][t >> half])
    best = np.zeros(1 << n)
    size = np.bitwise_count(np.arange(1 << n, dtype=np.uint32))
    for k in range(1, n + 1):
        for sets in np.array_split(np.flatnonzero(size == k), max(1, (1 << n) >> 20)):
            top = np.full(len(sets), -1.0)
            for v in range(n):
                has = np.flatnonzero(sets >> v & 1)
                top[has] = np.maximum(top[has], earned(v, sets[has] ^ (1 << v)))
            best[sets] = top
    out, s = [], (1 << n) - 1
    while s:
        last = next(v for v in range(n) if s >> v & 1 and earned(v, s ^ (1 << v)) == best[s])
        out.append(members[last])
        s ^= 1 << last
    return out[::-1]


def _strong_components(edges: dict[str, set[str]]) -> list[list[str]]:
    """Groups of sectors that reach each other, each before those it leads to."""
    reach: dict[str, set[str]] = {}
    for a in edges:
        seen, todo = {a}, [a]
        while todo:
            for b in edges.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[a] = seen
    groups: list[list[str]] = []
    done: set[str] = set()
    for a in sorted(edges, key=lambda a: (-len(reach[a]), a)):
        if a not in done:
            groups.append(sorted(b for b in reach[a] if a in reach[b]))
            done.update(groups[-1])
    return groups


def exact_acyclic(spark: SparkSession, z: DataFrame, most: int = 25) -> DataFrame:
    """The acyclic subgraph of the largest weight, proven: the best order of each strongly connected group of sectors.

    A group of more than `most` sectors is an error, never an approximation. The table has at most as many rows as pairs of sectors."""
    rows = candidate_edges(z).collect()
    weight = {(r["source"], r["target"]): r["value"] for r in rows}
    edges: dict[str, set[str]] = {}
    for a, b in weight:
        edges.setdefault(a, set()).add(b)
        edges.setdefault(b, set())
    place: dict[str, int] = {}
    for group in _strong_components(edges):
        if len(group) > most:
            raise RuntimeError(f"the optimum for {len(group)} interdependent sectors is not proven; at most {most}")
        for s in _order_of(group, weight) if len(group) > 1 else group:
            place[s] = len(place)
    kept = [(a, b, w) for (a, b), w in sorted(weight.items()) if place[a] < place[b]]
    return spark.createDataFrame(kept, "source string, target string, value double")


def acyclic(spark: SparkSession, z: DataFrame, method: str = "fast") -> DataFrame:
    if method not in ("fast", "exact"):
        raise ValueError("the method is fast or exact")
    return fast_acyclic(z) if method == "fast" else exact_acyclic(spark, z)


def audit(z: DataFrame, kept: DataFrame, method: str) -> DataFrame:
    """One row: weights and numbers of edges of the source graph, kept, removed and of self-loops. Removed counts the self-loops."""
    a = z.where("value > 0").agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("source_weight"), F.count("*").alias("source_edges"), F.coalesce(F.sum(F.when(F.col("source") == F.col("target"), F.col("value"))), F.lit(0.0)).alias("self_loop_weight")
    )
    b = kept.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("retained_weight"), F.count("*").alias("retained_edges"))
    return a.join(b).select(
        F.lit({"fast": "fast_greedy", "exact": "exact_order"}[method]).alias("method"), "source_weight", "retained_weight", (F.col("source_weight") - F.col("retained_weight")).alias("removed_weight"),
        "self_loop_weight", "source_edges", "retained_edges", (F.col("source_edges") - F.col("retained_edges")).alias("removed_edges"),
    )


def matched_pair(z: DataFrame, a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validated transactions and coefficients of the same sectors."""
    z, a = validated(z), validated(a)
    s, t = z.select("source").distinct(), a.select("source").distinct()
    require(s.join(t, "source", "left_anti").unionByName(t.join(s, "source", "left_anti")), "sectors in one of the two tables only")
    return z, a


def reweighted(kept: DataFrame, a: DataFrame, method: str) -> DataFrame:
    """source_type, target_type, transaction_value, technical_coefficient, mwas_method; a kept edge without a positive coefficient is an error."""
    out = kept.join(a.withColumnRenamed("value", "technical_coefficient"), ["source", "target"], "left")
    require(out.where("technical_coefficient is null or technical_coefficient <= 0").select("source", "target"), "kept edges without a positive coefficient")
    return out.select(F.col("source").alias("source_type"), F.col("target").alias("target_type"), F.col("value").alias("transaction_value"), "technical_coefficient", F.lit(method).alias("mwas_method"))


def build_dag(spark: SparkSession, z: DataFrame, a: DataFrame, method: str = "fast") -> tuple[DataFrame, DataFrame]:
    """The weighted acyclic graph of sectors, and its audit."""
    z, a = matched_pair(z, a)
    kept = acyclic(spark, z, method)
    return reweighted(kept, a, method), audit(z, kept, method)


def is_acyclic(edges: DataFrame, source: str = "source", target: str = "target") -> bool:
    """Whether repeated removal of the nodes without an edge into them, or without one out of them, removes all edges."""
    e = materialize(edges.select(F.col(source).alias("s"), F.col(target).alias("t")).distinct(), "peeled")
    n = e.count()
    while n:
        entered, left = e.select(F.col("t").alias("s")).distinct(), e.select(F.col("s").alias("t")).distinct()
        e = materialize(e.join(entered, "s", "left_semi").join(left, "t", "left_semi"), "peeled")
        m = e.count()
        if m == n:
            return False
        n = m
    return True
