import numpy as np
import pytest

from waylattice.operators import density, paths, roads


def hierarchy(xs, samples=2, floor=0.0, **config):
    """Labels of points on a line, each of its own place; every pair is an edge, which the forest is taken from."""
    x = np.array(xs, float)
    d = np.abs(x[:, None] - x)
    core = np.maximum(np.sort(d, axis=1)[:, samples - 1], floor)
    m = np.maximum(d, np.maximum(core[:, None], core))
    i, j = np.triu_indices(len(x), 1)
    sets, keep = density.Sets(), []
    for k in np.lexsort((j, i, m[i, j])):
        if sets.join(int(i[k]), int(j[k])):
            keep.append(k)
    i, j = i[keep], j[keep]
    label, member = density.Hierarchy(np.ones(len(x), np.int64), core, i, j, m[i, j], density.ClusteringConfig(3, samples, **config)).labels()
    return [frozenset(x[label == c]) for c in range(label.max(initial=-1) + 1)], label, member


#: Two halves of three, 1.5 apart, and three far away.
XS = [0, 1, 2, 3.5, 4.5, 5.5, 100, 101, 102]
LEFT, RIGHT, FAR = frozenset(XS[:3]), frozenset(XS[3:6]), frozenset(XS[6:])


@pytest.mark.parametrize(
    "config, want",
    [
        ({}, {LEFT | RIGHT, FAR}),
        ({"selection": "leaf"}, {LEFT, RIGHT, FAR}),
        ({"selection": "leaf", "epsilon": 2.0}, {LEFT | RIGHT, FAR}),
        ({"epsilon": 2.0}, {LEFT | RIGHT, FAR}),
        ({"max_cluster_size": 4}, {LEFT, RIGHT, FAR}),
        ({"selection": "leaf", "floor": 2.0}, {LEFT | RIGHT, FAR}),
    ],
)
def test_selection(config, want):
    got, _, member = hierarchy(XS, **config)
    assert {*got} == want and np.all((member >= 0) & (member <= 1))


def test_the_root_is_as_large_as_the_clusters_born_from_it():
    xs = [0, 1, 2, 10, 11, 12]
    got, _, _ = hierarchy(xs, allow_single_cluster=True, max_cluster_size=4)
    assert {*got} == {frozenset(map(float, xs[:3])), frozenset(map(float, xs[3:]))}
    assert len(hierarchy([0, 1, 2, 3, 4], allow_single_cluster=True, max_cluster_size=4)[0]) <= 1


def plain_tree(x, core, least):
    """Condensed clusters by their definition: (points at birth, birth, exits of points, children), from components of ever smaller distances."""
    d = np.maximum(np.abs(x[:, None] - x), np.maximum(core[:, None], core))

    def parts(own, limit):
        left, out = set(own), []
        while left:
            todo, part = [left.pop()], set()
            while todo:
                p = todo.pop()
                part.add(p)
                near = {q for q in left if d[p, q] < limit}
                left -= near
                todo += near
            out.append(part)
        return out

    def grow(own, birth):
        node = {"own": own, "birth": birth, "exits": {}, "children": []}
        now = own
        while now:
            inside = {d[p, q] for p in now for q in now if p < q}
            level = max((t for t in inside if len(parts(now, t)) > 1), default=None)
            if level is None:
                break
            big = [p for p in parts(now, level) if len(p) >= least]
            for p in now - set().union(*big):
                node["exits"][p] = 1 / level
            if len(big) > 1:
                node["children"] = [grow(p, 1 / level) for p in big]
                break
            now = big[0] if big else set()
        return node

    return grow(set(range(len(x))), 0.0)


def plain_stability(node):
    return sum(lam - node["birth"] for lam in node["exits"].values()) + sum((c["birth"] - node["birth"]) * len(c["own"]) for c in node["children"])


def cuts(node, root=True, single=False):
    """All choices of clusters of which none is below another."""
    rest = [()]
    for c in node["children"]:
        rest = [a + b for a in rest for b in cuts(c, False)]
    return rest if root and not single else [*rest, (node,)]


@pytest.mark.parametrize("seed", range(25))
def test_selection_is_the_best_cut(seed):
    """Of all sets of clusters apart from each other, the chosen one has the largest sum of stabilities."""
    rng = np.random.default_rng(seed)
    x = np.sort(np.concatenate([rng.normal(50 * k, rng.uniform(1, 15), rng.integers(3, 9)) for k in range(4)]))
    single = bool(seed % 2)
    most = None if seed % 3 else 8
    core = np.sort(np.abs(x[:, None] - x), axis=1)[:, 1]
    got, _, member = hierarchy(x, allow_single_cluster=single, max_cluster_size=most)
    tree = plain_tree(x, core, 3)
    size = lambda c: sum(len(k["own"]) for k in c["children"]) if c is tree else len(c["own"])
    allowed = [c for c in cuts(tree, True, single) if most is None or all(size(n) <= most for n in c)]
    best = max(sum(map(plain_stability, c)) for c in allowed)
    own = [frozenset(map(float, x[sorted(n["own"])])) for c in allowed if sum(map(plain_stability, c)) > best * (1 - 1e-12) for n in c]
    for cluster in got:  # the root alone keeps fewer points
        assert any(cluster <= o for o in own)
    if len(got) > 1:
        assert {*got} <= {*own}
    assert np.all((member >= 0) & (member <= 1))


def test_one_cluster_needs_leave():
    xs = [0, 1, 2, 3, 4]
    assert hierarchy(xs)[0] == []
    got, _, member = hierarchy(xs, allow_single_cluster=True)
    assert got == [frozenset(map(float, xs))] and np.all(member == 1)


def test_equal_distances_merge_at_once():
    got, label, _ = hierarchy([0, 1, 2, 10, 11, 12, 20, 21, 22])
    assert len(got) == 3 and sorted(map(len, got)) == [3, 3, 3]


def test_labels_do_not_follow_the_order():
    rng = np.random.default_rng(3)
    xs = np.concatenate([rng.choice(200, 12, replace=False) / 10 + 100 * k for k in range(4)])
    want = {*hierarchy(xs)[0]}
    for _ in range(3):
        assert {*hierarchy(rng.permutation(xs))[0]} == want


def line(k, *ends):
    return (k, 0, [{"x": float(x), "y": float(y)} for x, y in ends])


def test_statuses(spark):
    """Each way in which the search for a radius ends: start 296.3, growth 1.5, up to 1000."""
    away = [line(k, (0, 5000 * k), (10, 5000 * k)) for k in range(1, 6)]
    v, a = roads.build_network(spark.createDataFrame([line(0, (0, 0), (100_000, 0)), *away], "line_id long, part int, coords array<struct<x:double,y:double>>"))
    group = lambda x, n=6: [(x + k, 0) for k in range(n)]
    rows = {
        "converged": group(1) + group(90_000),
        "insufficient_points": group(500, 3),
        "structurally_unreachable": [(5, 5000 * k) for k in range(1, 6)],
        "pair_cap_limited": group(50_000) + group(50_400),
        "ceiling_reached": group(30_000) + [(40_000 + 5000 * k, 0) for k in range(5)],
    }
    data = [(f"{t}-{k}", t, float(x), float(y)) for t, xy in rows.items() for k, (x, y) in enumerate(xy)]
    s = roads.materialize(roads.snap(spark.createDataFrame(data, "point_id string, type string, x double, y double"), v, a), "s")
    places, of = roads.positions(s)
    out, summary, trace = density.cluster_by_type(s, places, of, a, density.ClusteringConfig(max_distance=1000.0, max_pairs=60))
    got = {r["type"]: r for r in summary.collect()}
    assert {t: r["status"] for t, r in got.items()} == {t: t for t in rows}
    assert got["ceiling_reached"]["radius"] == 1000 and got["ceiling_reached"]["truncated_share"] == pytest.approx(5 / 11)
    assert got["converged"]["clusters"] == 2 and got["converged"]["radius"] == pytest.approx(1000 / 1.5**2)
    assert got["pair_cap_limited"]["radius"] == pytest.approx(1000 / 1.5**3) and got["pair_cap_limited"]["pairs"] == 30
    tried = [(r["type"], r["outcome"], r["pairs"]) for r in trace.collect()]
    assert ("pair_cap_limited", "pair_limit", 66) in tried and tried.count(("pair_cap_limited", "ok", 30)) == 1
    assert out.count() == len(data) and out.where("type = 'insufficient_points' and cluster >= 0").count() == 0


def test_too_many_pairs_at_a_fixed_radius(spark):
    v, a = roads.build_network(spark.createDataFrame([line(0, (0, 0), (100, 0))], "line_id long, part int, coords array<struct<x:double,y:double>>"))
    s = roads.materialize(roads.snap(spark.createDataFrame([(str(k), "a", float(k), 0.0) for k in range(9)], "point_id string, type string, x double, y double"), v, a), "s")
    places, of = roads.positions(s)
    with pytest.raises(paths.TooManyPairs):
        density.cluster_by_type(s, places, of, a, density.ClusteringConfig(max_distance=50.0, distance_mode="fixed", max_pairs=10))


def planar(spark, groups):
    """Points of one type by road component."""
    rows = [(f"{c}-{k:03d}", "A", c, float(x), float(y)) for c, xy in groups.items() for k, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "point_id string, type string, component long, x double, y double")


@pytest.mark.parametrize("config", [{}, {"allow_single_cluster": True}, {"core_floor": 2.0}])
def test_planar_clusters_equal_those_of_all_pairs(spark, config):
    rng = np.random.default_rng(4)
    xy = {c: np.concatenate([rng.normal((40 * k, 30 * c), s, (n, 2)) for k, (s, n) in enumerate(((1, 12), (4, 15), (0.2, 9), (30, 6)))]) for c in (0, 1)}
    own = density.ClusteringConfig(4, 3, **config)
    got = {r["point_id"]: (r["cluster"], r["membership"]) for r in density.euclidean_clusters(planar(spark, xy), own).collect()}
    assert len(got) == sum(map(len, xy.values()))
    for c, p in xy.items():
        d = np.hypot(*(p[:, None] - p).transpose(2, 0, 1))
        core = np.maximum(np.sort(d, axis=1)[:, 2], own.core_floor)
        m = np.maximum(d, np.maximum(core[:, None], core))
        i, j = np.triu_indices(len(p), 1)
        sets, keep = density.Sets(), []
        for k in np.lexsort((j, i, m[i, j])):
            if sets.join(int(i[k]), int(j[k])):
                keep.append(k)
        label, member = density.Hierarchy(np.ones(len(p), np.int64), core, i[keep], j[keep], m[i, j][keep], own).labels()
        mine = [got[f"{c}-{k:03d}"] for k in range(len(p))]
        assert [(x < 0) for x, _ in mine] == list(label < 0)
        assert len({(a, b) for (a, _), b in zip(mine, label, strict=True)}) == len(set(label))
        assert [x for _, x in mine] == pytest.approx(list(member))
    assert len({x for x, _ in got.values() if x >= 0}) >= 2


def test_planar_clusters_never_join_road_components(spark):
    near = {0: [(1, 0), (2, 0), (3, 0)], 1: [(1, 1), (2, 1), (3, 1)], 2: [(9, 9)]}
    got = density.euclidean_clusters(planar(spark, near), density.ClusteringConfig(2, 2, allow_single_cluster=True)).collect()
    assert {(r["point_id"][0], r["cluster"]) for r in got} == {("0", 0), ("1", 1), ("2", -1)}
    assert density.euclidean_clusters(planar(spark, {0: []}), density.ClusteringConfig(2, 2)).count() == 0
    same = density.euclidean_clusters(planar(spark, {0: [(5, 5)] * 6}), density.ClusteringConfig(3, 3, allow_single_cluster=True)).collect()
    assert len(same) == 6


def test_a_type_with_too_many_pairs_is_clustered_in_the_plane(spark):
    v, a = roads.build_network(spark.createDataFrame([line(0, (0, 0), (100, 0))], "line_id long, part int, coords array<struct<x:double,y:double>>"))
    rows = [(f"a{k}", "a", float(k if k < 5 else 80 + k), 0.0) for k in range(10)] + [(f"b{k}", "b", float(k), 0.0) for k in range(3)]
    s = roads.materialize(roads.snap(spark.createDataFrame(rows, "point_id string, type string, x double, y double"), v, a), "s")
    places, of = roads.positions(s)
    config = density.ClusteringConfig(3, 2, max_distance=50.0, distance_mode="fixed", max_pairs=10)
    out, summary, _ = density.cluster_by_type(s, places, of, a, config, continue_on_error=True)
    assert {r["type"]: r["status"] for r in summary.collect()} == {"a": "fallback_euclidean_hdbscan", "b": "fixed"}
    got = {r["point_id"]: r["cluster"] for r in out.where("type = 'a'").collect()}
    assert {got[f"a{k}"] for k in range(5)} == {0} and {got[f"a{k}"] for k in range(5, 10)} == {1} and out.count() == 13


@pytest.mark.parametrize("most", [None, 10, 0])
def test_forest_by_contraction_is_that_of_kruskal(spark, most):
    """With many equal distances, several components and types; the order m, i, j makes the forest one."""
    rng = np.random.default_rng(11)
    rows = []
    for t, n in (("a", 60), ("b", 25), ("c", 2)):
        side = n // 2
        pairs = {tuple(sorted(p)) for p in rng.integers(0, n, (4 * n, 2)).tolist() if p[0] != p[1] and (p[0] < side) == (p[1] < side)}
        rows += [(t, i, j, float(rng.integers(1, 6))) for i, j in pairs]
    want = set()
    for t in "abc":
        sets = density.Sets()
        want |= {r for r in sorted((r for r in rows if r[0] == t), key=lambda r: (r[3], r[1], r[2])) if sets.join(r[1], r[2])}
    got = density.spanning_forest(spark.createDataFrame(rows, "type string, i long, j long, m double"), most=most)
    found = [tuple(r) for r in got.select("type", "i", "j", "m").collect()]
    assert len(found) == len(want) and set(found) == want


def forest_of(x, weights, samples):
    """Cores and Kruskal's forest of weighted places on a line, without the pairs over 50, so that parts stay apart."""
    d = np.abs(x[:, None] - x)
    order = np.argsort(d, axis=1, kind="stable")
    within = np.cumsum(weights[order], axis=1) >= samples
    core = np.where(weights >= samples, 0.0, np.sort(d, axis=1)[np.arange(len(x)), within.argmax(axis=1)])
    core[core > 50] = np.inf
    m = np.maximum(d, np.maximum(core[:, None], core))
    i, j = np.triu_indices(len(x), 1)
    sets, keep = density.Sets(), []
    for k in np.lexsort((j, i, m[i, j])):
        if m[i[k], j[k]] <= 50 and sets.join(int(i[k]), int(j[k])):
            keep.append((int(i[k]), int(j[k]), float(m[i[k], j[k]])))
    return core, keep


@pytest.fixture(scope="module")
def hierarchies(spark):
    """Types of places: at random, on a grid (one distance for most), with heavy places, at one place, far apart, and a single one."""
    rng = np.random.default_rng(5)
    sets = {
        "random": (np.round(np.r_[rng.normal(0, 8, 60), rng.normal(90, 3, 40), rng.uniform(300, 900, 30)], 3), np.ones(130, int)),
        "grid": (np.r_[np.arange(70), 200 + 2 * np.arange(30), 400 + 3.5 * np.arange(12)].astype(float), np.ones(112, int)),
        "heavy": (np.round(rng.uniform(0, 400, 60), 3), rng.integers(1, 8, 60)),
        "same": (np.repeat([0.0, 1.0, 2.0, 40.0], 12), np.ones(48, int)),
        "apart": (1000.0 * np.arange(9), np.r_[np.ones(8, int), 6]),
        "one": (np.array([1.0]), np.array([2])),
    }
    cores, edges = [], []
    for t, (x, w) in sets.items():
        core, keep = forest_of(x, w, 3)
        cores += [(t, k, int(w[k]), None if np.isinf(core[k]) else float(core[k])) for k in range(len(x))]
        edges += [(t, *e) for e in keep]
    cores = spark.createDataFrame(cores, "type string, position long, weight long, core double")
    return density.materialize(cores, "test-cores"), density.materialize(spark.createDataFrame(edges, "type string, i long, j long, m double"), "test-forest")


@pytest.mark.parametrize("config, most", [({}, 45), ({"selection": "leaf", "epsilon": 1.5}, 45), ({"allow_single_cluster": True, "max_cluster_size": 45}, 30)])
def test_the_hierarchy_in_tables_is_that_of_one_task(hierarchies, config, most):
    cores, forest = hierarchies
    c = density.ClusteringConfig(4, 3, **config)
    want = {(r["type"], r["position"]): r for r in density.position_labels(cores, forest, c).collect()}
    got = density.position_labels(cores, forest, c, most).collect()
    assert len(got) == len(want) == cores.count()
    for r in got:
        w = want[r["type"], r["position"]]
        assert (r["label"], r["clusters"]) == (w["label"], w["clusters"]), r
        assert r["membership"] == pytest.approx(w["membership"], abs=1e-12)
    if not config:
        key = lambda r: (r["type"], r["first"], r["birth"])
        want, got = (sorted(density.condensed_clusters(cores, forest, c, m).collect(), key=key) for m in (None, most))
        assert [(*key(r), r["members"]) for r in got] == [(*key(r), r["members"]) for r in want] and len(want) > 10
        assert [r["stability"] for r in got] == pytest.approx([r["stability"] for r in want], rel=1e-9)
