"""Operators on pairs and repeats against brute force, on small tables with hot groups, ties, nulls and long texts."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waylattice.llm import jaccard_join as jj
from waylattice.llm.common import WordHashes, gram_hashes, long_gram_hashes, native_filter
from waylattice.llm.decontaminate import contamination, find_spans, winnowed, words_of
from waylattice.llm.exact_dedup import exact_dedup, keep_first
from waylattice.llm.suffix_dedup import extend, repeated_passages

SCHEMA = "doc_id long, text string, component_id string, spans int"


def texts(seed=0, n=120):
    """Texts in groups of exact and near copies, with a common passage, nulls, and a very long one."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    common = [word() for _ in range(60)]
    out = [None, "", "  \t\n", "one", "one two three", "One two  three", "a b c d e", "A B C D E f"]
    base = [word() for _ in range(80)]
    out += [" ".join(base), "\n".join(base), " ".join(base) + " "]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35:
            x = list(base)
            for _ in range(rng.randint(1, 5)):
                x[rng.randrange(len(x))] = word()
        elif kind < 0.6:
            x = [word() for _ in range(rng.randint(1, 150))]
            at = rng.randrange(len(x))
            x[at:at] = common[: rng.randint(30, 60)]
        else:
            x = [word() for _ in range(rng.randint(1, 90))]
        out.append(" ".join(x))
    out.append(" ".join(word() for _ in range(20_000)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(rows)], SCHEMA)


def test_exact_dedup_cases(spark):
    rows = [(1, "a  b"), (2, "a b"), (2, "a b"), (None, "a\tb"), (5, None), (6, ""), (None, "z"), (9, "A b")]
    df = spark.createDataFrame([(i, t, True, 0) for i, t in rows], "doc_id long, text string, kept boolean, keep_id int")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(df).collect()), key=repr)
    want = sorted([(False, 1, 1, 4, True), (False, 2, 1, 4, False), (False, 2, 1, 4, False), (True, 0, 1, 4, False), (False, 5, 5, 2, True), (False, 6, 5, 2, False), (True, 0, None, 1, True), (False, 9, 9, 1, True)], key=repr)
    assert got == want
    kept = keep_first(df)
    assert kept.columns == df.columns and sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, [1, 5, None, 9]))
    assert exact_dedup(df.limit(0)).count() == 0


def test_keep_first_drops_repeated_rows(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "doc_id long, text string")
    assert sorted(r["text"] for r in keep_first(df).collect()) == ["x", "y"]


def test_native_filter_has_no_false_negatives(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"))
    test = native_filter(keys, 2000)
    got = spark.range(20_000).withColumn("hit", test(F.xxhash64("id")))
    assert got.where("id < 2000 and not hit").count() == 0 and got.where("id >= 2000 and hit").count() < 500


def test_gram_hashes_agree_on_equality():
    h = np.array([5, 6, 7, 5, 6, 7, 8], np.uint64)
    for f in (gram_hashes, long_gram_hashes):
        g = f(h, 3)
        assert g[0] == g[3] and len(set(g.tolist())) == 4 and len(f(h, 8)) == 0


def brute_components(rows):
    sets = []
    for t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in range(len(rows))}


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_components(spark, seed, monkeypatch):
    monkeypatch.setattr(jj, "TILE", 16)  # hot buckets of many parts
    rows = texts(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.jaccard_components(frame(spark, rows)).collect()}
    want = brute_components(rows)
    assert got == want
    assert max(collections.Counter(c for _, c in want.values()).values()) > 10


def test_jaccard_keeps_columns_and_empty(spark):
    df = frame(spark, texts(2, 20))
    kept = jj.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert jj.jaccard_components(df.limit(0)).count() == 0
    one = spark.createDataFrame([(None, "a b"), (None, None), (3, "a b")], "doc_id long, text string")
    assert sorted(map(repr, ((r["doc_id"], r["component_id"]) for r in jj.jaccard_components(one).collect()))) == sorted(map(repr, [(None, 3), (None, None), (3, 3)]))


def test_signatures_never_refuse_a_link():
    rng = np.random.default_rng(0)
    for n in (10, 130, 300, 1500, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for change in (0.02, 0.1):
            k = max(1, int(change * n))
            b = np.unique(np.concatenate([a[k:], rng.integers(0, 1 << 63, k).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            tile = jj.Tile(np.array([len(a), len(b)]), [jj.signature(a), jj.signature(b)], 80)
            s = tile.score(0, np.array([1]))[0]
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert s >= both / (len(a) + len(b)) - 1e-12


def brute_repeats(rows, span=50):
    words = [(t or "").encode().lower().split() for t in rows]
    own = collections.defaultdict(set)
    for i, w in enumerate(words):
        for j in range(len(w) - span + 1):
            own[tuple(w[j : j + span])].add(i)
    out = {}
    for i, w in enumerate(words):
        hit, first = [False] * len(w), None
        for j in range(len(w) - span + 1):
            o = own[tuple(w[j : j + span])]
            if len(o) > 1:
                hit[j : j + span] = [True] * span
                first = min(o) if first is None else min(first, *o)
        out[i] = hit, first
    return out


@pytest.mark.parametrize(("seed", "group"), [(3, 20_000), (4, 20_000), (3, 1), (4, 6)])
def test_repeated_passages(spark, seed, group):
    """Also when all matched heads, or the frequent ones, are too frequent to be brought together."""
    rows = texts(seed)
    got = repeated_passages(frame(spark, rows), group=group).collect()
    want = brute_repeats(rows)
    assert len(got) == len(rows) and sum(any(h) for h, _ in want.values()) > 20
    for r in got:
        hit = [False] * r["n_words"]
        for s in r["spans"]:
            hit[s["start"] : s["end"]] = [True] * (s["end"] - s["start"])
        assert (hit, r["first_id"]) == want[r["doc_id"]], r["doc_id"]
        assert r["n_repeated"] == sum(hit)


@pytest.mark.parametrize("sent", [200_000, 25, 0])
def test_frequent_passages_are_looked_up_in_tasks(spark, monkeypatch, sent):
    """A passage that many different texts have makes no row of a join for each; only passages beyond those that are sent do."""
    joined = []
    join = type(spark.range(1)).join
    monkeypatch.setattr(type(spark.range(1)), "join", lambda self, other, on=None, how=None: joined.append(on) or join(self, other, on, how))
    line = " ".join(f"c{i}" for i in range(70))
    rows = [*texts(5), *(f"{' '.join(f'a{i}x{j}' for j in range(i))} {line} b{i % 4}" for i in range(40))]
    got = repeated_passages(frame(spark, rows), group=3, sent=sent).collect()
    want = brute_repeats(rows)
    assert len(got) == len(rows) and (["h", "h2"] in joined) == (sent < 200_000)
    for r in got:
        hit = [any(s["start"] <= j < s["end"] for s in r["spans"]) for j in range(r["n_words"])]
        assert (hit, r["first_id"]) == want[r["doc_id"]], r["doc_id"]


def test_extension_to_both_sides():
    """Suffixes 0 and 1 agree in one word to the left and one to the right, 2 only to the left, 3 is of another head, 4 is 0's text again."""
    left, right = [b"x a", b"y a", b"a", b"x a", b"x a"], [b"b c", b"b d", b"e", b"b c", b"b c"]
    x, j, lowest = extend(np.array([0, 0, 0, 1, 0]), left, right, np.array([1, 2, 3, 4, 1]), np.array([3, 0, 2, 1, 4]), 2)
    assert sorted(zip(x.tolist(), j.tolist(), lowest.tolist(), strict=True)) == [(0, 1, 0), (1, 1, 0), (4, 1, 0)]


def test_repeats_of_empty_table(spark):
    assert repeated_passages(frame(spark, []).limit(0)).count() == 0
    same = spark.createDataFrame([(7, " ".join(map(str, range(60))))] * 2, "doc_id long, text string")
    assert [r["n_repeated"] for r in repeated_passages(same).collect()] == [60, 60]


def brute_windows(rows, items):
    out = []
    for t in rows:
        w = words_of((t or "").encode())
        hit, found = [False] * len(w), set()
        for k, x in items:
            v = words_of((x or "").encode())
            n = min(13, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in grams:
                    hit[i : i + n] = [True] * n
                    found.add(str(k))
        out.append((len(w), sum(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_decontamination(spark, block_words):
    rng = random.Random(8)
    word = lambda: rng.choice(["ab", "c", "dé", "x1", "Ö"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 12, 13, 14, 40])))) for i in range(12)] + [(50, None), (51, "!!"), (52, "q " * 30), (3, "another text with the id of an item that is there and longer than thirteen words in all")]
    rows = [None, "", "..."]
    for _ in range(60):
        x = [word() for _ in range(rng.randint(0, 60))]
        v = words_of((rng.choice(items)[1] or "").encode())
        at = rng.randint(0, len(x))
        x[at:at] = [w.decode() for w in v[rng.randint(0, 5) :]]
        rows.append("; ".join(x).upper() if rng.random() < 0.3 else " ".join(x))
    rows.append("q " * 5000)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(rows)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in contamination(find_spans(docs, bench, block_words=block_words)).collect()}
    want = brute_windows(rows, items)
    assert len(got) == len(rows)
    for i, (n, hit, found) in enumerate(want):
        assert got[i] == (n, hit, found, hit > 0 and 20 * hit >= n), i
    none = contamination(find_spans(docs, bench.limit(0)))
    assert none.where("n_hit > 0").count() == 0 and find_spans(docs.limit(0), bench).count() == 0


def test_winnowing_keeps_one_of_every_window():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 50, 300).astype(np.uint64)
    at = set(winnowed(g, 7).tolist())
    assert all(at & set(range(i, i + 7)) for i in range(len(g) - 6)) and len(winnowed(g[:6], 7)) == 0
    assert len(WordHashes().of([b"a", b"b", b"a"])) == 3


def test_bands_follow_the_threshold(spark):
    from waylattice.llm.jaccard_join import BANDS, MISS, ROWS, band_shape

    assert band_shape(80) == (BANDS, ROWS)
    for percent in range(1, 101):
        bands, rows = band_shape(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= MISS * (1 + 1e-9)
    # 150 pairs that share 6 of 20 shingles each
    docs = []
    for i in range(150):
        common = [f"c{i}x{j}" for j in range(6)]
        docs += [(2 * i, " ".join(common + [f"a{i}x{j}" for j in range(7)])), (2 * i + 1, " ".join(common + [f"b{i}x{j}" for j in range(7)]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jj.jaccard_components(df, shingle=1, percent=30).collect()}
    assert got == {i: i - i % 2 for i in range(300)}


def test_one_row_of_each_component_stays_without_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near = long + " more"
    rows = [(None, long), (None, near), (None, ""), (None, None), (None, "alone in the world of texts"), (7, "some other text of a few words"), (7, long + " end"), (8, "some other text of a few words"), (9, "kept")]
    kept = jj.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [rows[2], rows[3], rows[4], rows[5], rows[6], rows[8]]))
    nameless = [(None, long), (None, near), (None, long), (None, "alone in the world of texts")]
    kept = jj.keep_one_of_each(spark.createDataFrame(nameless, "doc_id long, text string")).collect()
    assert len(kept) == 2 and (None, "alone in the world of texts") in map(tuple, kept)


def test_columns_may_have_any_names(spark):
    names = ["doc_id", "text", "text_sha", "verdict", "verdict_id", "verdict_sha", "set", "kept_id", "kept_set", "text_sha_", "verdict_"]
    df = spark.createDataFrame([(1, "a  b", *"mine45678"), (2, "a b", *"other4567"), (3, "c", *"123456789")], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    for keep in (keep_first, jj.keep_one_of_each):
        assert sorted(map(tuple, keep(df).collect())) == [(1, "a  b", *"mine45678"), (3, "c", *"123456789")]


def test_blocks_hold_what_they_may():
    from waylattice.llm.decontaminate import Block, pack

    assert pack({3: 5, 1: 4, 2: 6, 9: 30, 10: 1}, 10) == [[1, 2], [3], [9], [10]]
    rng = random.Random(3)
    words = [f"word{i}" for i in range(5_000)]
    items = [(str(i), " ".join(rng.choices(words, k=500)).encode()) for i in range(400)]
    block = Block(items)
    held = sum(x.nbytes for x in (block.starts, block.ends, block.fingerprints, *(y for w in block.windows.values() for y in w))) + len(block.text)
    assert held < 55 * 200_000  # bytes for each word


def test_repeated_benchmark_items_are_one(spark):
    item = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "x " + item), (2, "y")], "doc_id long, text string")
    found = contamination(find_spans(docs, spark.createDataFrame([(5, item)] * 50 + [(6, item)], "item_id long, text string"), block_words=100))
    assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in found.collect()} == {1: (40, ["5", "6"]), 2: (0, [])}


def test_pairs_at_the_threshold_are_found(spark):
    docs = []
    for i in range(400):  # 8 m words in common, and m on either side: 80 percent
        m = i % 5 + 1
        common = [f"c{i}x{j}" for j in range(8 * m)]
        docs += [(2 * i, " ".join([*common, *(f"a{i}x{j}" for j in range(m))])), (2 * i + 1, " ".join([*common, *(f"b{i}x{j}" for j in range(m))]))]
    got = {r["doc_id"]: r["component_id"] for r in jj.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), shingle=1).collect()}
    assert got == {i: i - i % 2 for i in range(800)}


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jj, "TILE", 64)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = [" ".join(base[:k] + [f"x{rng.randrange(10**6)}"] + base[k + 1 :]) for k in (rng.randrange(100) for _ in range(1500))]
    rows += [" ".join(base[:70] + [f"y{i}z{j}" for j in range(30)]) for i in range(200)]  # much in common, but no link
    rows += [" ".join(base + [f"v{i}z{j}" for j in range(40 + i)]) for i in range(60)]  # longer
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.jaccard_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_likeliest_pairs_are_held_in_bounds(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, 60).astype(np.uint64)) for _ in range(40)]
    tile = jj.Tile(np.array(list(map(len, sets))), [jj.signature(s) for s in sets], 10)
    group, yes = np.arange(40) % 7, np.ones(40, bool)
    whole = tile.between(group, yes, yes, 3)
    monkeypatch.setattr(jj, "PAIRS", 50)
    few = tile.between(group, yes, yes, 3)
    codes = lambda x: sorted(map(tuple, np.sort(group[x[0]], axis=1).tolist()))
    assert codes(whole) == codes(few) and whole[1] and few[1] and max(collections.Counter(codes(whole)).values()) == 3
    assert len(tile.between(group, yes, yes, 10**6)[0]) > len(whole[0]) and not tile.between(group, yes, yes, 10**6)[1]
