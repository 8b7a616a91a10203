"""Repeated passages by a sparse suffix array: suffixes at minimiser positions are sorted, neighbours compared, matches extended."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import WordHashes, key_filter, least_step, long_gram_hashes, materialize, may_hold, mix, run_starts, signed, small_batches, table, text_bytes
from .decontaminate import winnowed

#: Words of the shortest passage, and words by which suffixes are sorted. Of any SPAN - HEAD + 1 following suffixes the one whose
#: head has the smallest hash is retained, so two equal passages retain the same suffix.
SPAN, HEAD = 50, 20
#: Different suffixes that a task sorts before it passes them on.
SORTED = 250_000
#: Suffixes with one head that a task compares at once; those of a more frequent head meet passage by passage.
GROUP = 20_000
#: Of passages around more frequent heads, how many every task holds (24 bytes and an id each), the most frequent ones; the rest are joined.
SENT = 200_000
#: Such passages that a task sums before it passes them on.
SUMMED = 1_000_000
#: Matched suffixes, of whole groups, that are extended together.
EXTENDED = 5_000


class Words:
    """A text's lower-cased words, one blank between them, and where each begins."""

    def __init__(self, text: bytes):
        self.words = text.lower().split()
        self.bytes = b" ".join(self.words)
        self.begin = np.r_[0, np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1)]
        self.key = xxhash.xxh3_64_intdigest(self.bytes) - (1 << 63)

    def runs(self, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        """The words from each start to each end, that excluded."""
        return [self.bytes[a : max(a, b - 1)] for a, b in zip(self.begin[start].tolist(), self.begin[end].tolist(), strict=True)]


def head_key(head: bytes) -> int:
    return xxhash.xxh3_64_intdigest(head) - (1 << 63)


def retained(h: np.ndarray, span: int, head: int) -> np.ndarray:
    """Positions of the retained suffixes."""
    return winnowed(long_gram_hashes(h, head), span - head + 1)


def _groups(batches: Iterator[pa.RecordBatch], by: str, least: int) -> Iterator[pa.Table]:
    """Sorted rows in tables of about `least` rows, none of which parts rows with equal `by`."""
    kept, size = [], 0
    for b in batches:
        if b.num_rows:
            kept.append(b)
            size += b.num_rows
        if size >= least:
            t = pa.Table.from_batches(kept)
            cut = pc.index(t[by], t[by][-1]).as_py()
            if cut:
                yield t.slice(0, cut)
            kept, size = t.slice(cut).to_batches(), len(t) - cut
            least = max(least, 2 * size)
    if kept:
        yield pa.Table.from_batches(kept)


def _numbers(runs: list[bytes], wide: int, known: dict[bytes, int], backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each of some runs of words the number of words, and their numbers (equal for equal words), the nearest to the head first; 0 where a run has no more."""
    out, sizes = np.zeros((wide, len(runs)), np.int64), np.zeros(len(runs), np.int64)
    for i, run in enumerate(runs):
        words = run.split()
        sizes[i] = len(words)
        out[: len(words), i] = [known.setdefault(w, len(known) + 1) for w in (reversed(words) if backwards else words)]
    return sizes, out


def _prefixes(group: np.ndarray, words: np.ndarray, most: int) -> list[np.ndarray]:
    """For each length, the class of suffixes of one group that agree in so many words: those whose common prefix is that long."""
    out = [group]
    for word in words:
        out.append(np.unique(out[-1] * most + word, return_inverse=True)[1])
    return out


def extend(group: np.ndarray, left: list[bytes], right: list[bytes], texts: np.ndarray, rank: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Extend suffixes that share a head (the same group) by up to `wide` words in all, so many to the left and the rest to the right.

    Returns, one entry for each extension that another text of the group has too: the suffix, how many words the passage
    begins before it, and the lowest rank of a suffix with that passage."""
    known: dict[bytes, int] = {}
    n_left, before = _numbers(left, wide, known, True)
    n_right, after = _numbers(right, wide, known, False)
    to_left, to_right = (_prefixes(group, w, len(known) + 1) for w in (before, after))
    found = []
    for j in range(wide + 1):
        x = np.flatnonzero((n_left >= j) & (n_right >= wide - j))
        if len(x):
            same = to_left[j][x] * len(group) + to_right[wide - j][x]
            order = np.argsort(same, kind="stable")
            x, starts = x[order], run_starts(same[order])
            sizes = np.diff(np.r_[starts, len(x)])
            several = np.minimum.reduceat(texts[x], starts) < np.maximum.reduceat(texts[x], starts)
            hit = np.repeat(several, sizes)
            found.append((x[hit], np.full(int(hit.sum()), j), np.repeat(np.minimum.reduceat(rank[x], starts), sizes)[hit]))
    empty = np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (empty, empty, empty)


def _flat(t: pa.Table, *cols: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows of the values of list columns of equal sizes, and the values."""
    sizes = pc.list_value_length(t[cols[0]]).to_numpy().astype(np.int64)
    return np.repeat(np.arange(len(t)), sizes), [pc.list_flatten(t[c]).to_numpy() for c in cols]


def _ranked(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of ids in ascending order, nulls last, and the rank of each."""
    order = pc.sort_indices(ids).to_numpy().astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return order, rank


class Passages:
    """Passages by 128 bits of hash, with the smallest id that has each."""

    def __init__(self, h: np.ndarray, h2: np.ndarray, first: pa.Array):
        by = np.argsort(h)
        self.h, self.h2, self.first = h[by], h2[by], first.take(pa.array(by))
        self.order, self.rank = _ranked(self.first)

    def find(self, h: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Where each is, or -1."""
        at, end = np.searchsorted(self.h, h), np.searchsorted(self.h, h, "right")
        out = np.full(len(h), -1)
        todo = np.flatnonzero(at < end)
        while len(todo):
            hit = self.h2[at[todo]] == h2[todo]
            out[todo[hit]] = at[todo[hit]]
            at[todo] += 1
            todo = todo[~hit]
            todo = todo[at[todo] < end[todo]]
        return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, head: int = HEAD, group: int = GROUP, sent: int = SENT) -> DataFrame:
    """Find the passages of at least `span` words (lower-cased, whatever the whitespace) that two rows or more have.

    Returns one row per input row: id_col, n_words, spans (start and end word of each maximal run of words that lie in a
    repeated passage, end excluded), n_repeated (words in them), first_id (the smallest id that has one of these
    passages, or null without any).

    1. Suffixes at minimiser positions are sorted by the words of their heads, in each task and then in ranges over all
    tasks, and each is compared with its neighbour: a head that two different texts have is a match. A task passes on one
    row for each head, so a passage that all texts have weighs as any other. 2. Matched suffixes meet by their head, with
    the words on both sides that a passage around it may have, and are extended: suffixes that agree in j words to the
    left and in span - head - j to the right have a passage in common. All words are compared. Texts find their matched
    suffixes by a filter of bounded size; what it lets through in vain meets no other. A head with more than `group`
    suffixes is not brought together: each of its passages is looked up by 128 bits of hash instead, summed in each
    task before the shuffle. The `sent` most frequent ones that are repeated are looked up in the tasks, the rest by a join. 3. Passages that two different texts have are joined into runs. Texts that are equal as a
    whole (by 64 bits of hash) are one text; they are repeated from end to end, if long enough.

    * Null and empty texts, and those shorter than span, have no spans. A null id never is first_id, unless all are null.
    * Rows with the same id and text count as two rows; so do rows with the same id and another text.
    * A passage that repeats within one row alone is not reported.
    * An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark, 512)
    source = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    TEXT, SUFFIX = 0, 1
    id_type = source.schema["id"].dataType
    schema = StructType([StructField("kind", IntegerType()), StructField("id", id_type), StructField("head", BinaryType()), StructField("a", LongType()), StructField("b", LongType()), StructField("n", LongType())])
    wide = span - head

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: dict[bytes, tuple[int, int, int]] = {}  # of each head the first and last text, and how many suffixes have it

        def suffixes(like: pa.DataType) -> Iterator[pa.RecordBatch]:
            array = sorted(held)
            for i in range(0, len(array), 20_000):
                part = array[i : i + 20_000]
                lo, hi, n = zip(*map(held.__getitem__, part), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), SUFFIX, np.int32)), pa.nulls(len(part), like), pa.array(part, pa.binary()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(n, pa.int64())], names=schema.names
                )
            held.clear()

        like = pa.null()
        for b in batches:
            like = b.column("id").type
            keys, counts = [], []
            for x in b.column("text").to_pylist():
                text = Words(x)
                d = text.key
                keys.append(d)
                counts.append(len(text.words))
                if len(text.words) >= span:
                    at = retained(hashes.of(text.words), span, head)
                    for s in text.runs(at, at + head):
                        lo, hi, n = held.get(s, (d, d, 0))
                        held[s] = min(lo, d), max(hi, d), n + 1
                    if len(held) > SORTED:
                        yield from suffixes(like)
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, TEXT, np.int32)), b.column("id"), pa.nulls(n, pa.binary()), pa.array(keys, pa.int64()), pa.nulls(n, pa.int64()), pa.array(counts, pa.int64())], names=schema.names)
        yield from suffixes(like)

    first = materialize(source.mapInArrow(first_pass, schema), "suffix-first")
    rows = first.where(F.col("kind") == TEXT).select("id", F.col("a").alias("d"), F.col("n").alias("n_words"))
    n = rows.count()
    texts = materialize(rows.groupBy("d").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "suffix-texts", n)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Heads whose neighbour in the sorted array has the same head and another text, and how many suffixes have each."""
        for t in _groups(batches, "head", EXTENDED):
            heads = t["head"].combine_chunks()
            starts = np.flatnonzero(np.r_[True, pc.not_equal(heads[1:], heads[:-1]).to_numpy(zero_copy_only=False)])
            low, high, count = np.minimum.reduceat(t["a"].to_numpy(), starts), np.maximum.reduceat(t["b"].to_numpy(), starts), np.add.reduceat(t["n"].to_numpy(), starts)
            matched = low < high
            keys = [head_key(x) for x in heads.take(pa.array(starts[matched])).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(count[matched], pa.int64())], names=["key", "n"])

    sorted_ = first.where(F.col("kind") == SUFFIX).select("head", "a", "b", "n").repartitionByRange("head").sortWithinPartitions("head")
    matches = materialize(sorted_.mapInArrow(compare, "key long, n long"), "suffix-matches")
    places = lambda wide: [F.shiftrightunsigned("key", 18 * j).bitwiseAND(wide - 1) for j in range(3)]
    filters = [key_filter(m.select("key"), places) for m in (matches, matches.where(F.col("n") > group))]
    HEADS, PASSAGES = 0, 1
    near = StructType(
        [StructField("kind", IntegerType()), StructField("d", LongType()), StructField("at", ArrayType(IntegerType())), StructField("head", BinaryType()), StructField("left", BinaryType()), StructField("right", BinaryType())]
        + [StructField(c, ArrayType(LongType())) for c in ("h", "h2")]
    )

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHashes(), [(w, x.value) for w, x in filters]
        given: set[int] = set()  # equal texts in one task are given once
        for b in batches:
            out: list[tuple] = []
            if len(given) > 300_000:
                given.clear()
            for x in b.column("text").to_pylist():
                text = Words(x)
                size = len(text.words)
                if size < span or text.key in given:
                    continue
                given.add(text.key)
                h = hashes.of(text.words)
                at = retained(h, span, head)
                heads = text.runs(at, at + head)
                k = np.array([head_key(s) for s in heads], np.int64).view(np.uint64)
                matched, frequent = (may_hold(x, *[(k >> np.uint64(18 * j)) & np.uint64(w - 1) for j in range(3)]) for w, x in bits)
                i = np.flatnonzero(matched & ~frequent)
                start, end = np.maximum(at[i] - wide, 0), np.minimum(at[i] + span, size)
                lefts, rights = text.runs(start, at[i]), text.runs(at[i] + head, end)
                out += [(HEADS, text.key, [a], heads[m], left, right, None, None) for a, m, left, right in zip(at[i].tolist(), i.tolist(), lefts, rights, strict=True)]
                i = at[matched & frequent]
                if len(i):
                    around = np.zeros(size - span + 1, bool)
                    for j in range(wide + 1):
                        p = i - j
                        around[p[(p >= 0) & (p < len(around))]] = True
                    p = np.flatnonzero(around)
                    out.append((PASSAGES, text.key, p.astype(np.int32), None, None, None, signed(long_gram_hashes(h, span)[p]), signed(long_gram_hashes(mix(h), span)[p])))
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        cols = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=near.names)

    around = materialize(source.mapInArrow(second_pass, near), "suffix-around")
    found = StructType([StructField("d", LongType()), StructField("at", ArrayType(IntegerType())), StructField("other_first", id_type)])

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "head", EXTENDED):
            heads = t["head"].combine_chunks()
            number = np.cumsum(np.r_[False, pc.not_equal(heads[1:], heads[:-1]).to_numpy(zero_copy_only=False)]).astype(np.int64)
            ids = t["first"].combine_chunks()
            order, rank = _ranked(ids)
            d, position = t["d"].to_numpy(), t["position"].to_numpy().astype(np.int64)
            x, j, lowest = extend(number, t["left"].to_pylist(), t["right"].to_pylist(), d, rank, wide)
            by = np.argsort(x, kind="stable")
            x, j, lowest = x[by], j[by], lowest[by]
            starts = run_starts(x)
            if len(starts):
                at = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(x)], pa.int32()), pa.array((position[x] - j).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(d[x[starts]]), at, ids.take(pa.array(order[np.minimum.reduceat(lowest, starts)]))], names=found.names)

    sums = StructType([StructField(c, LongType()) for c in ("h", "h2", "lo", "hi")] + [StructField("other_first", id_type), StructField("n", LongType())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each passage in a task its first and last text, its smallest id, and how many texts have it."""

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(kept)
            text, (h, h2) = _flat(t, "h", "h2")
            if not len(h):
                return
            ids = t["first"].combine_chunks()
            ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
            order, rank = _ranked(ids)
            by = np.lexsort((h2, h))
            h, h2, text = h[by], h2[by], text[by]
            starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])
            d = t["d"].to_numpy()[text]
            lowest = ids.take(pa.array(order[np.minimum.reduceat(rank[text], starts)]))
            yield pa.RecordBatch.from_arrays([pa.array(h[starts]), pa.array(h2[starts]), pa.array(np.minimum.reduceat(d, starts)), pa.array(np.maximum.reduceat(d, starts)), lowest, pa.array(np.diff(np.r_[starts, len(h)]))], names=sums.names)

        kept, size = [], 0
        for b in batches:
            kept.append(b)
            size += len(b.column("h").flatten())
            if size >= SUMMED:
                yield from out()
                kept, size = [], 0
        if kept:
            yield from out()

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Passages of each text that are among the frequent ones."""
        held = frequent.value
        for b in batches:
            text, (at, h, h2) = _flat(pa.Table.from_batches([b]), "at", "h", "h2")
            where = held.find(h, h2)
            hit = np.flatnonzero(where >= 0)
            if len(hit):
                starts = run_starts(text[hit])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(hit)], pa.int32()), pa.array(at[hit].astype(np.int32)))
                lowest = held.first.take(pa.array(held.order[np.minimum.reduceat(held.rank[where[hit]], starts)]))
                yield pa.RecordBatch.from_arrays([b.column("d").take(pa.array(text[hit][starts])), lists, lowest], names=found.names)

    known = around.join(texts.select("d", "first"), "d")
    members = known.where(F.col("kind") == HEADS).select("head", "left", "right", "d", F.col("at")[0].alias("position"), "first")
    hits = members.repartition("head").sortWithinPartitions("head").mapInArrow(extended, found)
    if matches.where(F.col("n") > group).limit(1).count():
        passages = known.where(F.col("kind") == PASSAGES).select("d", "first", "at", "h", "h2")
        both = passages.mapInArrow(summed, sums).groupBy("h", "h2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("other_first").alias("other_first"), F.sum("n").alias("n")).where("lo <> hi")
        both = materialize(both.select("h", "h2", "other_first", F.floor(F.log2("n") * 8).alias("step")), "suffix-both")
        least, left = least_step(both.groupBy("step").count(), (sent,))
        t = (both.where(F.col("step") >= least) if least < math.inf else both.limit(0)).select("h", "h2", "other_first").toArrow().combine_chunks()
        frequent = spark.sparkContext.broadcast(Passages(t["h"].to_numpy(), t["h2"].to_numpy(), pa.concat_arrays(t["other_first"].chunks or [pa.nulls(0, t["other_first"].type)])))
        hits = hits.unionByName(passages.mapInArrow(looked_up, found))
        if left:
            each = passages.select("d", F.explode(F.arrays_zip("at", "h", "h2")).alias("x")).select("d", "x.at", "x.h", "x.h2")
            rest = both.where(F.col("step") < least) if least < math.inf else both
            hits = hits.unionByName(each.join(rest, ["h", "h2"]).groupBy("d").agg(F.collect_set("at").alias("at"), F.min("other_first").alias("other_first")))
    hits = hits.groupBy("d").agg(F.flatten(F.collect_list("at")).alias("at"), F.min("other_first").alias("other_first"))
    spans = StructType([StructField("d", LongType()), StructField("other_first", id_type), StructField("spans", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            found = []
            for at in b.column("at").to_pylist():
                a = np.unique(np.array(at))
                s = np.flatnonzero(np.r_[True, np.diff(a) > span])
                e = np.r_[s[1:], len(a)] - 1
                found.append([{"start": x, "end": y + span} for x, y in zip(a[s].tolist(), a[e].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("other_first"), pa.array(found, kind)], names=spans.names)

    partly = materialize(hits.mapInArrow(runs, spans), "suffix-spans")
    known = materialize(texts.join(partly, "d", "left"), "suffix-known", n)
    full = (F.col("copies") > 1) & (F.col("n_words") >= span)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    result = rows.join(known, "d").withColumn("spans", F.when(full, whole).otherwise(F.coalesce("spans", none)))
    return result.select(
        F.col("id").alias(id_col),
        "n_words",
        "spans",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_repeated"),
        F.when(full | (F.size("spans") > 0), F.least("first", "other_first")).alias("first_id"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_repeated", (F.col("n_repeated") > 0).alias("repeats"), F.col("first_id").alias("first_doc_id"), F.to_json("spans").alias("spans"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
p AS (SELECT r, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM i),
f AS (SELECT h, min(doc_id) AS first FROM p GROUP BY h HAVING count(DISTINCT r) > 1),
x AS (SELECT r, i, first, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM p JOIN f USING (h)),
g AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM x),
s AS (SELECT r, min(first) AS first, min(i) - 1 AS s, max(i) + 49 AS e FROM g GROUP BY r, g),
o AS (SELECT r, min(first) AS first, sum(e - s) AS n, '[' || string_agg('{"start":' || s || ',"end":' || e || '}', ',' ORDER BY s) || ']' AS spans FROM s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_repeated, coalesce(n, 0) > 0 AS repeats, first AS first_doc_id, coalesce(spans, '[]') AS spans
FROM d LEFT JOIN o USING (r)
"""
