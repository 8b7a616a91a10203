import itertools
import random

import pytest

from waylattice.operators import io_graph as io


def table(spark, rows):
    return spark.createDataFrame([(a, b, float(v)) for a, b, v in rows], "source string, target string, value double")


def edges(df):
    return {(r["source"], r["target"]): r["value"] for r in df.collect()}


def test_fast_keeps_the_heavy_edges(spark):
    kept = io.fast_acyclic(table(spark, [("A", "B", 10), ("B", "C", 9), ("C", "A", 1), ("C", "B", 2)]))
    assert edges(kept) == {("A", "B"): 10, ("B", "C"): 9}


def test_exact_three_cycle(spark):
    z = table(spark, [("A", "B", 20), ("B", "C", 30), ("C", "A", 10)])
    kept = io.exact_acyclic(spark, z)
    assert sum(edges(kept).values()) == 50
    a = io.audit(z, kept, "exact").first()
    assert (a["retained_weight"], a["removed_weight"], a["retained_edges"]) == (50, 10, 2)


def test_self_loops_are_counted(spark):
    z = table(spark, [("A", "A", 5), ("A", "B", 1), ("B", "B", 4)])
    a = io.audit(z, io.fast_acyclic(z), "fast").first()
    assert (a["self_loop_weight"], a["retained_weight"], a["removed_weight"]) == (9, 1, 9)


def test_exact_beats_all_orders(spark):
    rng = random.Random(5)
    names = "abcdef"
    w = {(a, b): rng.randint(0, 9) for a in names for b in names if a != b}
    best = max(sum(v for (a, b), v in w.items() if o.index(a) < o.index(b)) for o in map("".join, itertools.permutations(names)))
    kept = io.exact_acyclic(spark, table(spark, [(a, b, v) for (a, b), v in w.items()]))
    assert sum(edges(kept).values()) == best and io.is_acyclic(kept)


def test_fast_matches_a_plain_scan_over_many_sectors(spark):
    rng = random.Random(7)
    names = [f"{i:02d}" for i in range(70)]
    rows = [(a, b, rng.randint(1, 500)) for a in names for b in names if a != b and rng.random() < 0.1]
    reach = {n: {n} for n in names}
    want = {}
    for a, b, v in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in reach[b]:
            want[a, b] = v
            for n in names:
                if a in reach[n]:
                    reach[n] |= reach[b]
    assert edges(io.fast_acyclic(table(spark, rows))) == want


def test_coefficients_and_checks(spark):
    z = table(spark, [(a, b, v) for a, row in zip("123", [[10, 20, 30], [5, 10, 15], [1, 2, 3]], strict=True) for b, v in zip("123", row, strict=True)])
    x = spark.createDataFrame([("1", 100.0), ("2", 200.0), ("3", 300.0)], "sector string, total_output double")
    a = edges(io.technical_coefficients(z, x))
    assert [a["1", t] for t in "123"] == [0.1, 0.1, 0.1]
    dag, _ = io.build_dag(spark, z, io.technical_coefficients(z, x))
    assert {r["source_type"] for r in dag.collect()} == {"01", "02"}
    with pytest.raises(ValueError):
        io.validated(table(spark, [("1", "2", float("nan")), ("2", "1", 1)]))
    with pytest.raises(ValueError):
        io.technical_coefficients(z, x.where("sector <> '3'"))
    with pytest.raises(RuntimeError):
        io.exact_acyclic(spark, table(spark, [(a, b, 1) for a in "abc" for b in "abc"]), 2)


def test_exact_of_all_sectors(spark):
    rng = random.Random(9)
    names = [f"{i:02d}" for i in range(1, 26)]
    hidden = names[:]
    rng.shuffle(hidden)
    at = {s: i for i, s in enumerate(hidden)}
    # each pair is heavier along the hidden order, so that this is the optimum
    w = {(a, b): rng.randint(50, 99) if at[a] < at[b] else rng.randint(1, 49) for a in names for b in names if a != b}
    kept = io.exact_acyclic(spark, table(spark, [(a, b, v) for (a, b), v in w.items()]))
    assert edges(kept) == {(a, b): v for (a, b), v in w.items() if at[a] < at[b]}


def test_whole_queries_leave_no_sector_out(spark):
    from waylattice.plans.catalog import QUERIES

    d = "/root/testdata/sf0.001"
    wide = QUERIES["io_matrix_wide"](spark, d)
    assert wide.columns == ["source", *[f"{i:02d}" for i in range(1, 26)]]
    z = QUERIES["io_transactions_long"](spark, d).collect()
    got = {(r["source"], c): r[c] for r in wide.collect() for c in wide.columns[1:] if r[c] is not None}
    assert got == {(r["source"], r["target"]): r["cents"] for r in z}
    best, fast = QUERIES["mwas_exact_objective"](spark, d).first()[0], sum(r["cents"] for r in QUERIES["mwas_fast_edges"](spark, d).collect())
    assert best >= fast > 0


def test_a_check_for_cycles_reads_its_edges_once(spark):
    from waylattice.operators import io_graph

    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 2.0), ("A", "C", 3.0)], "source string, target string, value double")
    assert io_graph.is_acyclic(edges.mapInArrow(count, edges.schema)) and read.value == 3
    read.value = 0
    assert io_graph.fast_acyclic(edges.mapInArrow(count, edges.schema)).count() == 3 and read.value == 3


def test_graphs_are_peeled_from_both_ends(spark, monkeypatch):
    tables, write = [], io.materialize
    monkeypatch.setattr(io, "materialize", lambda df, tag: tables.append(tag) or write(df, tag))
    chain = [(f"{k:02d}", f"{k + 1:02d}", 1) for k in range(12)]
    assert io.is_acyclic(table(spark, chain)) and len(tables) <= 8
    assert not io.is_acyclic(table(spark, [*chain, ("05", "03", 1)]))
    assert not io.is_acyclic(table(spark, [("A", "A", 1)]))


def test_order_lines_are_read_once(spark, monkeypatch):
    from waylattice.plans import catalog

    read, made = [], catalog.derived.io_z
    monkeypatch.setattr(catalog.derived, "io_z", lambda *args: read.append(args) or made(*args))
    assert catalog.QUERIES["technical_coefficients"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(read) == 1
