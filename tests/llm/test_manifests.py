"""Merkle manifests, byte-level BPE and the divergence of sources against plain versions."""

import hashlib
import random
import struct
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waylattice.llm import divergence as dv
from waylattice.llm.bpe import Vocabulary, boundaries, decode, encode, encoding, matcher, public_vocabulary
from waylattice.llm.merkle import ARITY, audited, folded, lay_out, level_sizes, op11_merkle_manifest, tree_size, veb_address

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row: dict) -> str:
    return sha(*("-" if (v := row[c]) is None else f"{len(str(v).encode())}:{v}" for c in ("doc_id", "source", "lang", "n_chars", "text")))


def plain_tree(nodes: list[str]) -> tuple[str, list[tuple[list[str], list[list[str]]]]]:
    """The root, and for each leaf the siblings of each level (left, right)."""
    found, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i - i % 3 : i - i % 3 + 3]
            found[k].append((run[: i % 3], run[i % 3 + 1 :]))
        nodes, at = [sha(*nodes[j : j + 3]) for j in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], found


def plain_manifest(rows: list[dict]) -> list[tuple]:
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees.append((own, *plain_tree([plain_leaf(r) for r in own])))
    root, over = plain_tree([t[1] for t in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, over, strict=True):
        for r, path in zip(own, paths, strict=True):
            handed = dict(r)
            if r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                handed["text"] = r["text"].replace("\n", "")
            node = plain_leaf(handed)
            for left, right in path + top:
                node = sha(*left, node, *right)
            out.append((r["doc_id"], plain_leaf(r), subroot, root, sha(*(x for a, b in path + top for x in a + b)), node, node == root))
    return out


@pytest.mark.parametrize("height", range(1, 9))
def test_layout_is_a_bijection_with_whole_bottom_trees(height):
    places = [veb_address(height, d, np.arange(ARITY**d)) for d in range(height)]
    assert sorted(np.concatenate(places)) == list(range(tree_size(height)))
    if height > 1:
        top = height // 2
        below = tree_size(height - top)
        for root in range(ARITY**top):  # each bottom tree takes places of its own, side by side
            own = np.concatenate([places[d][root * ARITY ** (d - top) : (root + 1) * ARITY ** (d - top)] for d in range(top, height)])
            assert own.min() == tree_size(top) + root * below and own.max() - own.min() == below - 1


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 81, 82])
def test_block_equals_plain_tree(n):
    leaves = [sha(str(k)) for k in range(n)]
    height, nodes, root = lay_out([bytes.fromhex(x) for x in leaves], None)
    assert root.hex() == plain_tree(leaves)[0] and height == len(level_sizes(n, None))
    assert nodes[32 * int(veb_address(height, 0, np.arange(1))[0]) :][:32] == root


def random_docs(n: int, seed: int) -> list[dict]:
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b\n", "é", "日本", "", None, "long " * 50])
    sources = ["s1"] * 6 + [None, "", "é", "z", "Z"]
    rows = [{"doc_id": rnd.choice([None, *range(n)]), "text": word(), "lang": rnd.choice(["en", None, ""]), "source": rnd.choice(sources), "n_chars": rnd.choice([None, 5])} for _ in range(n)]
    return rows + rows[: n // 5]


def shown(m, found):
    hex_ = lambda c: F.lower(F.hex(c))
    rows = found.select("id", hex_("leaf").alias("leaf"), hex_("subroot").alias("subroot"), F.lit(m.root).alias("root"), F.sha2(hex_("siblings"), 256).alias("p"), hex_("folded").alias("f")).collect()
    return [(*r, r[-1] == m.root) for r in rows]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_equals_plain_version_with_blocks_of_any_height(spark, levels):
    rows = random_docs(90, 3)
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], DOCS).withColumn("tree", F.lit("x")).withColumn("DIGEST", F.lit(1))
    tampered = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("doc_id").isNotNull(), F.replace("text", F.lit("\n"), F.lit("")))
    m, found = audited(docs, tampered, levels=levels)
    assert sorted(shown(m, found), key=str) == sorted(plain_manifest(rows), key=str)
    if levels < 7:
        assert len(m.blocks) > 1 and m.blocks[0].agg(F.max("leaves")).first()[0] <= ARITY**levels
    kinds = {(r["kind"], r["source"]) for r in m.table().select("kind", "source").collect()}
    assert ("source", None) in kinds and ("source", "s1") in kinds and ("root", None) in kinds


def test_manifest_of_string_ids_one_row_and_none(spark):
    docs = spark.createDataFrame([("b", "t", "en", "s", 1)], DOCS.replace("doc_id long", "doc_id string"))
    m, found = audited(docs)
    r = found.first()
    assert r["leaf"].hex() == r["subroot"].hex() == r["folded"].hex() == m.root and r["siblings"] == b"" and r["steps"] == b""
    m, found = audited(docs.limit(0))
    assert m.root is None and found.count() == 0


def test_fold_finds_any_change(spark):
    m, found = audited(spark.createDataFrame([(k, f"t{k}", "en", f"s{k % 4}", k) for k in range(40)], DOCS), levels=2)
    for r in found.collect():
        assert folded(r["leaf"], r["siblings"], r["steps"]).hex() == m.root
        assert folded(r["leaf"][::-1], r["siblings"], r["steps"]).hex() != m.root


def test_op11_on_repeated_rows(spark, tmp_path):
    rows = random_docs(30, 5)
    spark.createDataFrame([tuple(r.values()) for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op11_merkle_manifest(spark, str(tmp_path)).collect()), key=str) == sorted(plain_manifest(rows), key=str)


@pytest.fixture(scope="module")
def vocabulary():
    return public_vocabulary()


def awkward_texts() -> list[str | None]:
    rnd = random.Random(1)
    pool = ["a", "b", " ", "  ", "\n", "'s", "'", "re", "'re", "1", "22", "é", "日", "本", "!", "...", " x", "\x1c", " ", "'l", "l", "v", "e", "😀", "<|endoftext|>"]
    return ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 300))) for _ in range(150)] + ["a" * 500 + " b'c's" + " " * 300 + "x", "'" * 200, " " * 333, "x", "", None, "", "word " * 3000]


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 6), (40, 12), (32_768, 1_024)])
def test_chunks_encode_as_whole_texts(spark, vocabulary, chunk, overlap):
    texts = awkward_texts()
    enc = encoding(vocabulary.ranks, vocabulary.pattern)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, IDS string").withColumn("row", F.lit(1)).withColumn("part", F.lit(2))
    found = decode(encode(docs, vocabulary, carry=("doc_id", "IDS", "row", "part"), chunk=chunk, overlap=overlap), vocabulary)
    assert found.columns == ["doc_id", "row", "part", "ids", "decoded"]
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert bytes(got[k]["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(got[k]["decoded"]) == (t or "").encode()


def test_repeated_rows_and_no_rows_encode(spark, vocabulary):
    docs = spark.createDataFrame([(1, "same text " * 20)] * 3 + [(None, "x" * 300)], "doc_id long, text string")
    assert encode(docs, vocabulary, chunk=50, overlap=10).groupBy("doc_id").count().orderBy("doc_id").collect() == [(None, 1), (1, 3)]
    assert encode(docs.limit(0), vocabulary).count() == 0


def test_decode_of_bytes_that_are_no_text(spark, vocabulary):
    enc = encoding(vocabulary.ranks, vocabulary.pattern)
    half = enc.encode_single_token(b"\xe6")
    rows = spark.createDataFrame([(1, bytearray(struct.pack("<I", half))), (2, None), (3, bytearray())], "k long, ids binary")
    assert [bytes(r["decoded"]) for r in decode(rows, vocabulary).orderBy("k").collect()] == [b"\xe6", b"", b""]
    with pytest.raises(ValueError, match="already"):
        decode(rows, vocabulary, name="K")


def test_vocabulary_has_a_bound(tmp_path, monkeypatch):
    (tmp_path / "v").write_bytes(b"YQ== 0\n")
    assert Vocabulary.read(str(tmp_path / "v"), "x").ranks == b"YQ== 0\n"
    monkeypatch.setattr("waylattice.llm.bpe.MOST_BYTES", 3)
    with pytest.raises(ValueError, match="more than"):
        Vocabulary.read(str(tmp_path / "v"), "x")


def test_boundaries_of_a_part_agree_with_the_whole(vocabulary):
    find = matcher(vocabulary.pattern)
    for text in awkward_texts():
        whole = set(boundaries(text or "", find, True))
        for cut in range(4, len(text or ""), 7):
            assert set(boundaries(text[:cut], find, False)) <= whole


def plain_divergence(rows: list[tuple], least: int = 3, ranks: int = 200) -> list[tuple]:
    def terms(text):
        return "".join(c.lower() if "A" <= c <= "Z" else c if c > "\x7f" or "a" <= c <= "z" else " " for c in text or "").split(" ")

    groups, has = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = [w for w in terms(text) if w]
        groups[lang or "", source or ""].update(words)
        has[lang or ""].update(set(words))
    out = []
    for lang in {k[0] for k in groups}:
        kept = [t for t, n in has[lang].items() if n >= least]
        own = {s: c for (k, s), c in groups.items() if k == lang}
        shares = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept})(sum(c[t] for t in kept))
        p, q = {s: shares(c) for s, c in own.items()}, shares(sum(own.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            found = [(f(p[s][t], q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", found, ranks)):
                for k, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.append((lang, s, part, item, v, k + 1))
    return out


@pytest.fixture(scope="module")
def divergent():
    rnd = random.Random(7)
    words = [f"{c}{d}" for c in "abcdefgh" for d in ("", "x", "é", "YZ", "q" * 70)] + ["1", "--", "日本"]
    rows = [(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25))), rnd.choice(["en", "en", "de", None]), rnd.choice(["s1", "s1", "s2", None, "é"])) for _ in range(120)]
    return rows + rows[:15] + [(None, "en", "no text"), ("once", "rare", "a"), ("twice", "rare", "b"), ("", "alone", "c"), ("the " * 30_000, "en", "s2")]


@pytest.mark.parametrize(("head", "shard", "ranks"), [(1 << 20, 4096, 200), (10, 5, 3), (0, 4096, 200)])
def test_divergence_equals_plain_version(spark, divergent, head, shard, ranks):
    """With all, some and none of the terms in the broadcast hashes."""
    docs = spark.createDataFrame(divergent, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("SHARD", F.lit("x")).repartition(5)
    found = dv.divergence(docs, ranks=ranks, head_terms=head, shard_terms=shard)
    assert sorted(map(tuple, found.select("lang", "source", "part", "item", "value", "rank").collect())) == sorted(plain_divergence(divergent, ranks=ranks))


def test_divergence_when_tasks_send_early(spark, divergent, monkeypatch):
    """The bounds are read in the workers of this test by functions that carry them."""
    rows = list(dv._frequencies(iter([pa.record_batch({"lang": ["en"] * 2, "text": [b"a b", b"a"]})])))
    assert sorted(zip(rows[0].column("term").to_pylist(), rows[0].column("n").to_pylist(), strict=True)) == [("a", 2), ("b", 1)]
    monkeypatch.setattr(dv, "SLOTS", 0)
    shard = dv.build_shard((pa.scalar("en"), pa.scalar(0), pa.scalar(True)), pa.table({"term": ["a", "b", "c"]}))
    own = dv.Recount({"en": dv.Slots(shard, 1)}, 1, True)
    sent = []
    for text in (b"a b a", b"c a z"):
        own.counters["en", "s"].update(dv.terms_of(text))
        sent += list(own.add())
    assert not own.dense and sum(b.column("slot")[0].as_py() != b"" for b in sent) == 2
    total = dv.dense_counts(shard, pa.Table.from_batches(sent))
    counts = dict(zip(total.column("terms")[0].as_py(), np.frombuffer(total.column("counts")[0].as_py(), np.int64).tolist(), strict=True))
    assert counts == {"a": 3, "b": 1, "c": 1}


def test_divergence_of_no_rows(spark):
    assert dv.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 100, 5000])
def test_perfect_hash_is_minimal_and_verified(n):
    terms = [f"term{k}" for k in range(n)]
    seed, sizes, bits, slots = dv.perfect_hash([t.encode() for t in terms])
    assert sorted(slots) == list(range(n)) and sum(bits) == n and sum(sizes) == len(bits)
    table = pa.concat_tables([dv.build_shard((pa.scalar("en"), pa.scalar(s), pa.scalar(True)), pa.table({"term": own})) for s in range(3) if (own := [t for t in terms if crc32(t.encode()) % 3 == s])])
    found = dv.Slots(table, 3)
    assert sorted(found.find([t.encode() for t in terms])) == list(range(n))
    assert set(found.find([f"other{k}".encode() for k in range(1000)])) == {-1}


def test_shares_are_exact_beyond_double_precision():
    rnd = random.Random(2)
    for _ in range(200):
        total = rnd.randint(1, 9 * 10**15)
        count = rnd.randint(0, total)
        assert dv.share(np.array([count]), np.array([total]))[0] == 1 + 10**9 * count // total
