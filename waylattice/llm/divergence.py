"""An audit of how sources diverge: terms that are frequent enough are counted again through minimal perfect hashes, into dense slots."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, mix, table

#: Terms of a shard on average, and shards at least, so that small vocabularies have tasks too.
SHARD_TERMS, LEAST_SHARDS = 4096, 64
#: Terms (of so many bytes at most) whose hashes are broadcast; rarer and longer ones are counted by a shuffle.
HEAD_TERMS, TERM_BYTES = 1 << 20, 64
#: Entries of a task's counters, and slots of its dense arrays (4 bytes each), before it sends what it has.
COUNTED, SLOTS = 300_000, 1 << 25
#: Parts of a share, and ranks of a report on terms.
SCALE, RANKS = 1_000_000_000, 200

#: A-Z to lower case; letters and all bytes beyond ASCII stay, others are blanks.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_STEP = 0x9E3779B97F4A7C15
HASHED = "lang string, shard int, head boolean, seed int, sizes array<int>, bits binary, keys array<string>"
SENT = "lang string, shard int, sources array<string>, source binary, slot binary, n binary, terms array<string>"
MATRIX = "lang string, shard int, sources array<string>, terms array<string>, counts binary"
VALUES = "lang string, source string, part string, item string, value long"


def at_level(h: np.ndarray, level: int) -> np.ndarray:
    """Other hashes of the same terms for each level."""
    return mix(h + np.uint64(level * _STEP % (1 << 64)))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) in 64-bit integers, by three digits at a time; exact for totals up to 9e15."""
    out, rest = np.divmod(count, total)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return 1 + out


def perfect_hash(terms: list[bytes]) -> tuple[int, list[int], bytes, np.ndarray]:
    """A minimal perfect hash: seed, bits of each level, the levels' bits (a byte each), and each term's slot. At a level, a term that meets
    no other sets its bit, and the rest go on; a slot is the number of bits set before."""
    seed = 0
    while len(np.unique(h := np.array([xxhash.xxh3_64_intdigest(t, seed) for t in terms], np.uint64))) < len(terms):
        seed += 1
    sizes, bits, place, rest, start = [], [], np.zeros(len(terms), np.int64), np.arange(len(terms)), 0
    while len(rest):
        size = len(rest) + len(rest) // 4 + 1
        at = (at_level(h[rest], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        level = np.zeros(size, np.uint8)
        level[at[alone]] = 1
        place[rest[alone]] = start + at[alone]
        sizes.append(size)
        bits.append(level)
        start, rest = start + size, rest[~alone]
    bits = np.concatenate(bits)
    return seed, sizes, bits.tobytes(), np.cumsum(bits, dtype=np.int64)[place] - 1


def build_shard(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """A shard's terms in the order of their slots; one that is not broadcast has them in their own order."""
    lang, shard, head = (x.as_py() for x in key)
    terms = sorted(x.encode() for x in t.column("term").to_pylist())
    seed, sizes, bits = 0, [], b""
    if head:
        seed, sizes, bits, slots = perfect_hash(terms)
        terms = [terms[k] for k in np.argsort(slots)]
    columns = ([lang], [shard], [head], [seed], [sizes], [bits], [[x.decode() for x in terms]])
    types = (pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()))
    return pa.table([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=["lang", "shard", "head", "seed", "sizes", "bits", "keys"])


class Slots:
    """The shards of a language side by side: a term's slot, or -1 where the term stored there is another."""

    def __init__(self, rows: pa.Table, shards: int):
        own = rows.column("shard").to_numpy()
        self.row = np.full(shards, -1)
        self.row[own] = np.arange(len(own))
        self.shards, self.shard = shards, own
        self.seeds = rows.column("seed").to_numpy()
        levels = rows.column("sizes").to_pylist()
        self.sizes = np.zeros((len(own), max(map(len, levels))), np.int64)
        for k, each in enumerate(levels):
            self.sizes[k, : len(each)] = each
        ends = np.cumsum(self.sizes.ravel())
        self.starts = np.r_[0, ends[:-1]].reshape(self.sizes.shape)
        self.bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8)
        self.rank = np.cumsum(self.bits, dtype=np.int32)
        keys = [k.encode() for each in rows.column("keys").to_pylist() for k in each]
        self.first = np.r_[0, np.cumsum(pa.compute.list_value_length(rows.column("keys")).to_numpy())]
        self.stored, self.ends, self.n = b"".join(keys), np.r_[0, np.cumsum([len(k) for k in keys])].tolist(), len(keys)

    def find(self, terms: list[bytes]) -> np.ndarray:
        row = self.row[np.fromiter(map(crc32, terms), np.int64, len(terms)) % self.shards]
        if self.seeds.any():
            h = np.array([xxhash.xxh3_64_intdigest(t, int(self.seeds[r])) for t, r in zip(terms, row, strict=True)], np.uint64)
        else:
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))
        slot, rest = np.full(len(terms), -1), np.flatnonzero(row >= 0)
        for level in range(self.sizes.shape[1]):
            size = self.sizes[row[rest], level]
            rest, size = rest[size > 0], size[size > 0]
            at = self.starts[row[rest], level] + (at_level(h[rest], level) % size.astype(np.uint64)).astype(np.int64)
            hit = self.bits[at] == 1
            slot[rest[hit]] = self.rank[at[hit]] - 1
            rest = rest[~hit]
        stored, ends = self.stored, self.ends
        same = [s >= 0 and stored[ends[s] : ends[s + 1]] == t for s, t in zip(slot.tolist(), terms, strict=True)]
        return np.where(same, slot, -1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms and the documents they are in, added up in the task."""
    found: dict[str, Counter] = defaultdict(Counter)

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, c in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "term", "n"])
        found.clear()

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            found[lang].update(set(terms_of(text)))
        if sum(map(len, found.values())) > COUNTED:
            yield from sent()
    yield from sent()


class Recount:
    """The second pass of a task: counters feed dense slots, a shard of all groups of a language is sent at a time."""

    def __init__(self, languages: dict[str, Slots], shards: int, rest: bool):
        self.languages, self.shards, self.rest = languages, shards, rest
        self.counters: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.dense: dict[str, dict[str, np.ndarray]] = defaultdict(dict)
        self.held = self.added = 0

    def add(self) -> Iterator[pa.RecordBatch]:
        """Empty the counters into slots; terms without one go by name, if any such are frequent."""
        other = defaultdict(lambda: defaultdict(list))
        for (lang, source), c in self.counters.items():
            terms, n = list(c), np.fromiter(c.values(), np.int64, len(c))
            slot = self.languages[lang].find(terms) if lang in self.languages else np.full(len(terms), -1)
            if lang in self.languages:
                if source not in self.dense[lang]:
                    self.held += self.languages[lang].n
                own = self.dense[lang].setdefault(source, np.zeros(self.languages[lang].n, np.int32))
                own[slot[slot >= 0]] += n[slot >= 0].astype(np.int32)  # a task sends before it has read 2^31 words
            if self.rest:
                for k in np.flatnonzero(slot < 0).tolist():
                    other[lang, crc32(terms[k]) % self.shards][source].append((terms[k].decode(), int(n[k])))
        self.counters.clear()
        for (lang, shard), by in other.items():
            sources = list(by)
            flat = [(g, t, n) for g, s in enumerate(sources) for t, n in by[s]]
            yield self._row(lang, shard, sources, np.array([x[0] for x in flat]), np.zeros(0), np.array([x[2] for x in flat]), [x[1] for x in flat])
        if self.held > SLOTS or self.added > 1 << 30:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        for lang, by in self.dense.items():
            own, sources = self.languages[lang], list(by)
            stacked = np.stack([by[s] for s in sources])
            for k, shard in enumerate(own.shard.tolist()):
                part = stacked[:, own.first[k] : own.first[k + 1]]
                g, slot = np.nonzero(part)
                if len(g):
                    yield self._row(lang, shard, sources, g, slot, part[g, slot], None)
        self.dense.clear()
        self.held = self.added = 0

    @staticmethod
    def _row(lang, shard, sources, g, slot, n, terms) -> pa.RecordBatch:
        packed = [x.astype(k).tobytes() for x, k in ((g, np.int32), (slot, np.int32), (n, np.int64))]
        types = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((lang, shard, sources, *packed, terms), types, strict=True)], names=["lang", "shard", "sources", "source", "slot", "n", "terms"])


def dense_counts(hashed: pa.Table, sent: pa.Table) -> pa.Table:
    """Of one language and shard, the counts of all its sources and terms that are kept: what tasks sent, added up in dense slots."""
    if not hashed.num_rows or not sent.num_rows:
        return pa.table({c: pa.array([], k) for c, k in (("lang", pa.string()), ("shard", pa.int32()), ("sources", pa.list_(pa.string())), ("terms", pa.list_(pa.string())), ("counts", pa.binary()))})
    terms, by_name = [], {}
    for r in sorted(hashed.select(["head", "keys"]).to_pylist(), key=lambda r: not r["head"]):  # slots of the hash come first
        if not r["head"]:
            by_name = {t: len(terms) + k for k, t in enumerate(r["keys"])}
        terms += r["keys"]
    sources = sorted({s for each in sent.column("sources").to_pylist() for s in each})
    place = {s: k for k, s in enumerate(sources)}
    counts = np.zeros((len(sources), len(terms)), np.int64)
    for r in sent.select(["sources", "source", "slot", "n", "terms"]).to_pylist():
        g = np.array([place[s] for s in r["sources"]])[np.frombuffer(r["source"], np.int32)]
        n = np.frombuffer(r["n"], np.int64)
        if r["terms"] is None:
            np.add.at(counts, (g, np.frombuffer(r["slot"], np.int32)), n)
        else:
            slot = np.array([by_name.get(t, -1) for t in r["terms"]])
            np.add.at(counts, (g[slot >= 0], slot[slot >= 0]), n[slot >= 0])
    head = hashed.column("lang")[0].as_py(), hashed.column("shard")[0].as_py()
    return pa.table({"lang": [head[0]], "shard": pa.array([head[1]], pa.int32()), "sources": pa.array([sources], pa.list_(pa.string())), "terms": pa.array([terms], pa.list_(pa.string())), "counts": pa.array([counts.tobytes()], pa.binary())})


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            n = np.frombuffer(r["counts"], np.int64).reshape(len(r["sources"]), -1).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(n), pa.string()), pa.array(r["sources"], pa.string()), pa.array(n)], names=["lang", "source", "n"])


def _values(ranks: int):
    """For a language and shard: sums of the divergence of each source from each other, and that of its terms from the language. Of a
    source's terms, those beyond `ranks` values of this shard can't be among the first `ranks`, and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                names, totals, v = [g["source"] for g in r["groups"]], np.array([g["n"] for g in r["groups"]], np.int64), r["v"]
                counts = np.zeros((len(names), len(r["terms"])), np.int64)
                place = {s: k for k, s in enumerate(names)}
                counts[[place[s] for s in r["sources"]]] = np.frombuffer(r["counts"], np.int64).reshape(len(r["sources"]), -1)
                p = share(counts + 1, (totals + v)[:, None])
                q = share(counts.sum(axis=0) + 1, np.int64(totals.sum() + v))
                for a, source in enumerate(names):
                    sums = ((p[a] - p) ** 2 // p).sum(axis=1)
                    others = np.flatnonzero(np.arange(len(names)) != a)
                    yield _batch(r["lang"], source, "pair", [names[k] for k in others], sums[others])
                    found = np.flatnonzero((counts[a] > 0) & (p[a] > q))
                    f = (p[a][found] - q[found]) ** 2 // q[found]
                    if len(f) > ranks:
                        most = f >= np.partition(f, -ranks)[-ranks]
                        found, f = found[most], f[most]
                    yield _batch(r["lang"], source, "term", [r["terms"][k] for k in found], f)

    return run


def _batch(lang: str, source: str, part: str, items: list[str], values: np.ndarray) -> pa.RecordBatch:
    same = [pa.array([x] * len(items), pa.string()) for x in (lang, source, part)]
    return pa.RecordBatch.from_arrays([*same, pa.array(items, pa.string()), pa.array(values, pa.int64())], names=["lang", "source", "part", "item", "value"])


def divergence(
    docs: DataFrame, least: int = 3, ranks: int = RANKS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", head_terms: int = HEAD_TERMS, shard_terms: int = SHARD_TERMS
) -> DataFrame:
    """How the sources of each language differ in the terms that at least `least` of its documents have.

    Returns lang, source, part, item, value, rank. Part `pair`: every other source of the language, and the divergence from it, summed over all
    terms that are kept. Part `term`: the `ranks` terms that stand out most from the language as a whole. Shares are whole billionths with one
    added to every count, and all arithmetic is exact (for up to 9e15 words).

    The first pass counts documents by language and term, exactly, and keeps the frequent terms. They are sharded by hash, and each shard gets a
    minimal perfect hash with its terms stored; those of the head_terms most frequent terms are broadcast. The second pass finds each term's
    slot, checks it against the stored term, and counts in dense slots of each source; tasks send shards of counts, which are added up in dense
    slots too. Terms beyond the broadcast head go by name, in the same shards. So a worker's memory is bounded, and no term is dropped.

    * Null texts, languages and sources count as empty. A source without terms has all counts 0; a language without terms that are kept
      has pairs of value 0. A source that is alone in its language has no pairs.
    * Rows may repeat: each is a document. An empty table gives an empty result; other columns are not read. Ties go by the item's bytes.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), text)
    kept = rows.select("lang", "text").mapInArrow(_frequencies, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    kept = materialize(kept, "audit-terms")

    # the head: documents at least 2 ** k, for the smallest k with few enough terms
    fits = F.octet_length("term") <= TERM_BYTES
    by_power = dict(kept.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*")).collect())
    total, power = sum(by_power.values()), min(by_power, default=0)
    while sum(n for k, n in by_power.items() if k >= power) > head_terms:
        power += 1
    shards = max(LEAST_SHARDS, math.ceil(total / shard_terms))
    head = (F.floor(F.log2("n")) >= power) & fits
    placed = kept.select("lang", "term", (F.crc32(F.col("term").cast("binary")) % shards).cast("int").alias("shard"), head.alias("head"))
    hashed = materialize(placed.groupBy("lang", "shard", "head").applyInArrow(build_shard, HASHED), "audit-hashes")
    tables = hashed.where("head").orderBy("lang", "shard").toArrow()
    shared, rest = spark.sparkContext.broadcast(tables), not hashed.where("not head").isEmpty()

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = shared.value
        languages = {lang: Slots(all_.filter(pa.compute.equal(all_.column("lang"), lang)), shards) for lang in set(all_.column("lang").to_pylist())}
        own = Recount(languages, shards, rest)
        for b in batches:
            for lang, source, data in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                own.counters[lang, source].update(terms := terms_of(data))
                own.added += len(terms)
            if sum(map(len, own.counters.values())) > COUNTED:
                yield from own.add()
        yield from own.add()
        yield from own.send()

    sent = rows.mapInArrow(recount, SENT)
    matrix = materialize(hashed.groupBy("lang", "shard").cogroup(sent.groupBy("lang", "shard")).applyInArrow(dense_counts, MATRIX), "audit-counts")

    # of each language all sources with their counts, beside each of its shards
    groups = rows.select("lang", "source").distinct().join(matrix.mapInArrow(_sums, "lang string, source string, n long").groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
    groups = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("groups"))
    groups = materialize(groups.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left"), "audit-groups")
    beside = matrix.select("lang", "shard").join(groups, "lang")
    values = materialize(matrix.join(beside, ["lang", "shard"]).mapInArrow(_values(ranks), VALUES), "audit-values")

    empty = groups.where("v is null").select("lang", F.explode("groups.source").alias("source"), F.col("groups.source").alias("all"))
    empty = empty.select("lang", "source", F.lit("pair").alias("part"), F.explode(F.array_except("all", F.array("source"))).alias("item"), F.lit(0).cast("long").alias("value"))
    pairs = values.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).unionByName(empty)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = values.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) USING (lang, source, term)),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM c),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM c GROUP BY lang, term),
a AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 200
"""
