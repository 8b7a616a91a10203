"""Language-model scoring with a probabilistic suffix tree over words."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from ..operators.storage import extended, shuffles_removed
from .common import Powers, binary, crc_mod, discard, key_order, least_step, materialize, mix, run_starts, signed, small_batches, table, text_bytes, unpacked, word_filter, word_may_hold, word_runs

#: What comes before a text's first word, and after its last; hashes, as of words.
START, END = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
#: Words, contexts and next words of contexts that every worker holds (16 bytes each); what is rarer is joined.
HEAD_WORDS, HEAD_CONTEXTS, HEAD_NEXT = 500_000, 1_000_000, 2_000_000
#: Instead of a next word: only the context counts.
NONE = np.uint64(0)
#: Pairs that a task sums before it passes them on (18 bytes each, and as much again while they are sorted).
HELD = 1_500_000
#: Bytes of blocks that a task passes on at once, about.
SENT = 4 << 20
#: Symbols beyond the head that a task holds before it passes them on (some 35 bytes each), and the rows between the first and the last.
CHAINS, CHAIN_ROWS = 300_000, 1 << 16
#: Texts are scored in so many rounds, so that symbols beyond the head of one round alone are on disk.
ROUNDS = 3


@dataclass(frozen=True)
class TreeConfig:
    """depth: words of the longest context. least: occurrences from which on a context has a next word of its own. divergence: a context is
    retained, with its suffixes, if its count times the divergence (in nats) of its distribution from that of the next shorter
    context reaches it, however rare it is."""

    depth: int = 3
    least: int = 2
    divergence: float = 12.0


def _as_long(x: np.uint64) -> int:
    return int(x.view(np.int64))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a gram, from those of the grams without its last and without its first word."""
    return mix(a * np.uint64(0xD1B54A32D192ED03) + b)


def sequence(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """START, words and END of each text, one text after another, and the place of each in its text."""
    total = counts + 2
    begin = np.r_[0, np.cumsum(total)[:-1]].astype(np.int64)
    place = np.arange(int(total.sum())) - np.repeat(begin, total)
    s = np.empty(len(place), np.uint64)
    s[begin], s[begin + total - 1] = START, END
    s[(place > 0) & (place < np.repeat(total - 1, total))] = hashes
    return s, place


def grams(s: np.ndarray, n: int) -> list[np.ndarray]:
    """For each number of words before it, up to n, the hash of every symbol with them; without meaning where a text has fewer."""
    out = [s]
    for _ in range(n):
        longer = out[-1].copy()
        longer[1:] = join(out[-1][:-1], out[-1][1:])
        out.append(longer)
    return out


def pair_order(a: np.ndarray, b: np.ndarray, share: int) -> np.ndarray:
    """Places of pairs of hashes, with equal pairs and equal first hashes together: sorted by leading bits of both (one in `share` is the second's) with
    the places below. Where others have the same leading bits, equal ones may stand apart."""
    bits = max(1, len(a).bit_length())
    second = (64 - bits) // share
    low, both = np.uint64((1 << bits) - 1), np.uint64((1 << bits + second) - 1)
    x = b >> np.uint64(64 - bits - second)
    x &= ~low
    x |= a & ~both
    x |= np.arange(len(a), dtype=np.uint64)
    x.sort()
    x &= low
    return x.view(np.int64)


class Sums:
    """Contexts with next words, and how often they occur; given out, each about once, when many are held: as blocks, one for each partition that counts
    them. Of a shorter context, only the partition is kept. Single words, which may have most words behind them, and pairs go to partitions of their own;
    longer contexts are followed by their pairs."""

    def __init__(self, parts: int, level: int):
        self.parts, self.level, self.rows, self.size = parts, level, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, up: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.rows.append((a, b, up))
        self.size += len(a)
        if self.size >= HELD:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        held = [np.concatenate(x) for x in zip(*self.rows, strict=True)]
        self.rows, self.size = [], 0
        if not held or not len(held[0]):
            return
        order = pair_order(held[0], held[1], 2 if self.level == 1 else 3)
        if self.level > 1:
            order = order[np.lexsort((held[2][order], _part(held[0], self.parts)[order]))]
        for i in range(3):
            held[i] = held[i][order]
        del order
        a, b, up = held
        new = np.r_[True, a[1:] != a[:-1]]
        starts = np.flatnonzero(new)
        c, n, up = a[starts], _times(starts, len(a)), up[starts]
        c[c == START] = END  # as many texts begin as end
        pairs = np.flatnonzero(new | np.r_[True, b[1:] != b[:-1]])
        times = _times(pairs, len(a))
        known = b[pairs] != NONE
        pairs, times = pairs[known], times[known]
        if self.level == 1:
            yield from _blocks(CONTEXT, _part(c, self.parts), n, c)
            yield from _blocks(PAIR, _part(join(a[pairs], b[pairs]), self.parts), times, a[pairs], b[pairs])
            return
        many = np.bincount(np.searchsorted(starts, pairs, "right") - 1, minlength=len(starts)).astype(np.int32)
        part = _part(c, self.parts)
        first = run_starts(part)
        cuts = np.r_[first, len(part)]
        wide = np.r_[0, np.cumsum(many)][cuts]
        columns = {"part": pa.array(part[first].astype(np.int32)), "kind": pa.array(np.full(len(first), CONTEXT, np.int32))}
        columns |= {f: binary(x, cuts) for f, x in (("x", n), ("a", c), ("up", up), ("many", many))} | {f: binary(x, wide) for f, x in (("b", b[pairs]), ("times", times))}
        yield from in_slices(pa.RecordBatch.from_pydict({f: columns[f] for f in BLOCK_COLUMNS}))


def _times(starts: np.ndarray, size: int) -> np.ndarray:
    return np.diff(np.r_[starts, size]).astype(np.int32)


def _part_type(parts: int) -> type:
    return np.int16 if parts < 1 << 15 else np.int32  # the former are sorted faster


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return (key.view(np.int64) % parts).astype(_part_type(parts))


#: Blocks of counts, each for one partition.
BLOCKS = "part int, kind int, x binary, a binary, b binary, up binary, many binary, times binary"
BLOCK_COLUMNS = [x.split()[0] for x in BLOCKS.split(", ")]


def _blocks(kind: int, part: np.ndarray, *rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows as one value for each partition that they are for, a few of them at once."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    starts = run_starts(part[order])
    cuts = np.r_[starts, len(order)]
    columns = [binary(x[order], cuts) for x in rows] + [pa.nulls(len(starts), pa.binary())] * (6 - len(rows))
    yield from in_slices(pa.RecordBatch.from_arrays([pa.array(part[order[starts]].astype(np.int32)), pa.array(np.full(len(starts), kind, np.int32)), *columns], names=BLOCK_COLUMNS))


def in_slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of large values, a few of them at once, as the JVM holds what it is sent beside its heap."""
    step = max(1, len(b) * SENT // max(1, b.nbytes))
    for i in range(0, len(b), step):
        yield b.slice(i, step)


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _tables(batches: Iterator[pa.RecordBatch]) -> dict[int, pa.Table]:
    """All rows of a partition by their kind."""
    kept = [b for b in batches if b.num_rows]
    t = pa.Table.from_batches(kept) if kept else None
    return {k: t.filter(pc.equal(t["kind"], k)) for k in pc.unique(t["kind"]).to_pylist()} if kept else {}


CONTEXT, PAIR, ABOVE = 0, 1, 2


def _counts(train: DataFrame, level: int, least: int, seen=None, branching=None) -> DataFrame:
    """kind, a, b, n; of longer contexts as blocks for the partitions of the next shorter ones. PAIR: how often word b follows context a of `level` words, if it does `least` times; b is the gram of the last
level` symbols. CONTEXT: how often a context a occurs; with level 1, all words and ends instead.

    seen and branching: filters of grams of the level before, those that are seen `least` times, and of contexts that
    longer ones may diverge from. No other pair can matter."""
    parts = _parts(train.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, sums = Powers(), Sums(parts, level)
        for batch in batches:
            for hashes, counts in word_runs(batch.column("text"), powers):
                s, place = sequence(hashes, counts)
                at = np.flatnonzero(place >= level)
                if level == 1:
                    yield from sums.add(s[at - 1], s[at], np.zeros(len(at), _part_type(parts)))
                    continue
                all_ = grams(s, level - 1)
                at = at[word_may_hold(branching.value, all_[-2][at - 1])]
                at = at[word_may_hold(seen.value, all_[-1][at - 1])]
                b = all_[-1][at]
                b[~word_may_hold(seen.value, b)] = NONE
                yield from sums.add(all_[-1][at - 1], b, _part(all_[-2][at - 1], parts))
        yield from sums.out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(batches)
        if level > 1 and tables:  # pairs stand behind their contexts
            tables[PAIR] = tables[CONTEXT]
        for kind in sorted(tables):
            t = tables.pop(kind)
            a, up, n = (unpacked(t[c], k) for c, k in (("a", np.uint64), ("up", _part_type(parts)), ("x", np.int32)))
            b = unpacked(t["b"], np.uint64) if kind == PAIR else None
            if kind == PAIR and level > 1:
                many, n = unpacked(t["many"], np.int32), unpacked(t["times"], np.int32)
                a, up = np.repeat(a, many), np.repeat(up, many)
            del t
            key = join(a, b) if kind == PAIR else a
            order = key_order(key)
            starts = run_starts(key[order])
            n = np.add.reduceat(n[order], starts, dtype=np.int64) if len(n) else n
            known = np.flatnonzero(n >= (1 if level == 1 and kind == CONTEXT else least))
            n, at = n[known], order[starts[known]]
            del key, order, starts, known
            if level > 1:
                yield from _blocks(kind, up[at], n, a[at], *([b[at]] if kind == PAIR else []))
                continue
            for i in range(0, len(at), 50_000):
                x = at[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(signed(a[x])), pa.array(signed(b[x])) if kind == PAIR else pa.nulls(len(x), pa.int64()), pa.array(n[i : i + 50_000])], names=["kind", "a", "b", "n"])

    sums = train.mapInArrow(run, BLOCKS).repartitionById(parts, F.col("part"))
    return sums.mapInArrow(count, "kind int, a long, b long, n long" if level == 1 else BLOCKS)


#: A row for each context: its hash, the shorter contexts and how often they occur, how often it occurs, log10 of what the next shorter one
#: counts for, its divergence, whether longer ones may diverge, and of its next words the grams, the probabilities (if there are longer contexts), and log10 of
#: what these are divided by those that the next shorter context gives, which has them all as next words.
LEVEL = "c long, ups array<long>, ns array<long>, n long, v double, gain double, branching boolean, g array<long>, p array<double>, d array<double>"


def _lists(x: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(x))


def _level(rows: DataFrame, k: int, config: TreeConfig, unseen: float) -> DataFrame:
    """The contexts of level k, from rows of all three kinds; those of one shorter context are in one partition."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tables(batches)
        if PAIR not in t or CONTEXT not in t or k > 1 and ABOVE not in t:
            return
        if k == 1:
            a, b, x, q = (t[PAIR][c].to_numpy() for c in ("a", "b", "n", "q"))
            whole, occurs = (t[CONTEXT][c].to_numpy() for c in ("a", "n"))
        else:
            a, b, x = (unpacked(t[PAIR][c], np.int64) for c in ("a", "b", "x"))
            whole, occurs = (unpacked(t[CONTEXT][c], np.int64) for c in ("a", "x"))
            up = t[ABOVE]
            g = Lookup(pc.list_flatten(up["g"]).to_numpy())
            e = g.find(b.view(np.uint64))
            a, b, x, e = a[e >= 0], b[e >= 0], x[e >= 0], e[e >= 0]
            q = pc.list_flatten(up["p"]).to_numpy()[g.order][e]
            above = np.repeat(np.arange(len(up)), pc.list_value_length(up["g"]).to_numpy())[g.order][e]
        known = Lookup(whole)
        at = known.find(a.view(np.uint64))
        order = np.lexsort((b, a))
        order = order[at[order] >= 0]
        if not len(order):
            return
        a, b, x, q = a[order], b[order], x[order], q[order]
        starts = run_starts(a)
        d = np.diff(np.r_[starts, len(a)])
        n = occurs[known.order][at[order][starts]]
        s, sum_q, e = np.add.reduceat(x, starts), np.add.reduceat(q, starts), np.add.reduceat(x * np.log(x / q), starts)
        # what follows too rarely to be known is one symbol; the least that the shorter context can give it
        rest, other = n - s, np.maximum(1 - sum_q, unseen)
        gain = e - s * np.log(n) + np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / (n * other)), 0.0)
        r, z = rest + d, n + d
        # no longer context can diverge more than by all of its symbols being the least likely one
        most = n * np.log(z / np.minimum(float(config.least), r * other))
        p = (x + np.repeat(r, d) * q) / np.repeat(z, d)
        more = np.log10(p / q)
        g = signed(join(a.view(np.uint64), b.view(np.uint64)))
        if k == 1:
            ups = ns = np.empty((len(starts), 0), np.int64)
        else:
            i = above[order][starts]
            chain = lambda c, own: np.c_[pc.list_flatten(up[c]).to_numpy().reshape(len(up), k - 2)[i], up[own].to_numpy()[i]]
            ups, ns = chain("ups", "c"), chain("ns", "n")
        end = np.r_[starts, len(a)]
        for lo in range(0, len(starts), 20_000):
            y = slice(lo, lo + 20_000)
            m = len(starts[y])
            of = slice(end[lo], end[min(lo + 20_000, len(starts))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[starts[y]]), *(_lists(c[y].ravel(), np.full(m, k - 1)) for c in (ups, ns)), pa.array(n[y]), pa.array(np.log10(r / z)[y]), pa.array(gain[y]), pa.array((most >= config.divergence)[y]), _lists(g[of], d[y]), _lists(p[of], d[y]) if k < config.depth else pa.nulls(m, pa.list_(pa.float64())), _lists(more[of], d[y])],
                names=["c", "ups", "ns", "n", "v", "gain", "branching", "g", "p", "d"],
            )

    return rows.repartitionById(_parts(rows.sparkSession), F.col("part")).mapInArrow(contexts, LEVEL)


def _levels(train: DataFrame, config: TreeConfig) -> tuple[DataFrame, int, int, list[DataFrame]]:
    """The words with their counts, how many words there are in all and how many different ones, and the levels of contexts."""
    counts = materialize(_counts(train, 1, config.least), "lm-counts", hashes=True)
    parts = _parts(train.sparkSession)
    part = lambda c: F.pmod(F.col(c), F.lit(parts)).cast("int").alias("part")
    words = materialize(counts.where(F.col("kind") == CONTEXT).select(F.col("a").alias("key"), "n"), "lm-words", hashes=True)
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    known = words.where(F.col("key") != F.lit(_as_long(END))).unionByName(words.where(F.col("key") == F.lit(_as_long(END))).select(F.lit(_as_long(START)).alias("key"), "n"))
    given = counts.where(F.col("kind") == PAIR).join(words.select(F.col("key").alias("b"), ((F.col("n") + 1) / (n + v + 1)).alias("q")), "b")
    rows = known.where(F.col("n") >= config.least).select(part("key"), F.lit(CONTEXT).alias("kind"), F.col("key").alias("a"), "n").unionByName(given.select(part("a"), "kind", "a", "b", "n", "q"), True)
    levels = [materialize(_level(rows, 1, config, 1 / (n + v + 1)), "lm-level", hashes=True)]
    discard(counts)
    for k in range(2, config.depth + 1):
        above = levels[-1]
        many, branching = above.agg(F.coalesce(F.sum(F.size("g")), F.lit(0)), F.count_if("branching")).first()
        filters = word_filter(above.select(F.explode("g").alias("g")), many), word_filter(above.where("branching").select("c"), branching)
        counts = materialize(_counts(train, k, config.least, *filters).select("part", "kind", "x", "a", "b"), "lm-counts", hashes=True)  # what they were made of goes
        rows = counts.unionByName(above.where("branching").select(part("c"), F.lit(ABOVE).alias("kind"), "c", "ups", "ns", "n", "g", "p"), True)
        levels.append(materialize(_level(rows, k, config, 1 / (n + v + 1)), "lm-level", hashes=True))
        discard(counts)
        for x in filters:
            x.destroy()
    return words, n, v, levels


def _model(levels: list[DataFrame], config: TreeConfig) -> list[DataFrame]:
    """The retained contexts of each level, with what their next words add to log10 of the next shorter context's probability."""
    out, longer = [], None
    for k in range(len(levels), 0, -1):
        level = levels[k - 1]
        own = level.where(F.col("gain") >= config.divergence)
        if longer is not None:  # with all their suffixes
            kept = own.select("c").unionByName(longer.select(F.element_at("ups", -1).alias("c")))
            own = level.join(kept.distinct(), "c", "left_semi")
        longer = materialize(own.select("c", "ups", "ns", "n", "v", "g", "d"), "lm-retained", hashes=True)
        discard(level)
        out.append(longer)
    return out


def _arrays(df: DataFrame, *cols: str) -> tuple[np.ndarray, ...]:
    found = df.select(*cols).toArrow().sort_by(cols[0])
    return tuple(found.column(c).to_numpy() for c in cols)


class Lookup:
    """Places of 64-bit hashes in a table of them, by their leading bits."""

    def __init__(self, keys: np.ndarray):
        keys = keys.view(np.uint64)
        self.order = key_order(keys)
        self._index(keys[self.order])

    def _index(self, keys: np.ndarray) -> None:
        self.keys = keys
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __getstate__(self) -> np.ndarray:
        return self.keys  # a broadcast is a file on every worker

    def __setstate__(self, keys: np.ndarray) -> None:
        self._index(keys)  # they are sorted

    def find(self, q: np.ndarray) -> np.ndarray:
        """Where each is, or -1."""
        out = np.full(len(q), -1)
        part = (q >> self.shift).astype(np.int64)
        at, end = self.first[part], self.first[part + 1]
        todo = np.flatnonzero(at < end)
        while len(todo):
            hit = self.keys[at[todo]] == q[todo]
            out[todo[hit]] = at[todo[hit]]
            at[todo] += 1
            todo = todo[~hit]
            todo = todo[at[todo] < end[todo]]
        return out


class Head:
    """The frequent part of the tree: contexts, their next words, and single words with log10 of one more than their counts."""

    def __init__(self, contexts: tuple[np.ndarray, np.ndarray], following: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray], depth: int):
        self.depth = depth
        self.tables = []
        for keys, values in (contexts, following, words):
            lookup = Lookup(keys)
            self.tables.append((lookup, values[lookup.order].astype(np.float64)))

    def walk(self, s: np.ndarray, place: np.ndarray, less: float, tail: np.ndarray):
        """For every symbol but starts: its place in s; the place among words, or -1; log10 of the probability by the longest retained
        context of the head, less that of one more than the word's count if that is not among them, and a list of (symbols, contexts, grams)
        of the contexts beyond, which the tail may retain, shorter ones first."""
        (contexts, weight), (following, more), (words, logs) = self.tables
        at = np.flatnonzero(place > 0)
        w = words.find(s[at])
        v = np.where(w >= 0, logs[w], 0.0) - less if len(logs) else np.full(len(at), -less)
        all_ = grams(s, self.depth)
        live, beyond, waiting = np.arange(len(at)), [], np.empty(0, np.int64)
        for k in range(1, self.depth + 1):
            waiting = waiting[place[at[waiting]] >= k]
            live = live[place[at[live]] >= k]
            c = contexts.find(all_[k - 1][at[live] - 1])
            out = live[c < 0]
            live, c = live[c >= 0], c[c >= 0]
            e = following.find(all_[k][at[live]])
            if len(weight):
                v[live] += np.where(e >= 0, more[e], weight[c]) if len(more) else weight[c]
            waiting = np.r_[waiting, out]
            waiting = waiting[word_may_hold(tail, all_[k - 1][at[waiting] - 1])]
            if len(waiting):
                beyond.append((waiting, all_[k - 1][at[waiting] - 1], all_[k][at[waiting]]))
        return at, w, v, beyond


DOCUMENT, RARE, BEYOND, TAIL, MORE = range(5)


def score_texts(
    docs: DataFrame, train_mask, id_col: str = "doc_id", text_col: str = "text", config: TreeConfig = TreeConfig(), head_words: int = HEAD_WORDS, head_contexts: int = HEAD_CONTEXTS, head_next: int = HEAD_NEXT
) -> DataFrame:
    """Fit a tree and word counts to the texts that train_mask selects, and score all texts.

    Returns one row per input row: id_col, trained (the mask), n_tokens, n_known, train_tokens, base_score, score. The
    tokens are lower-cased words and one end. base_score is the log10 probability under add-one word counts, score that
    under the tree, whose symbols are the tokens, with add-one word counts at its root.

    Contexts are runs of up to config.depth words. Level by level, how often each word follows each context is summed in
    each task and then by shuffle. A context is retained if its distribution diverges from that of the next shorter one,
    however rare it is, so the table of contexts grows with the corpus. Next words seen less than config.least times are
    not told apart: they share what is left to the shorter context, as unseen ones do (Witten-Bell). Longer contexts are
    counted only where a filter of bounded size has seen their parts; those that it lets through in vain are counted too,
    and found too rare. The most frequent contexts, next words and words are broadcast; symbols in rarer contexts, found
    by a filter, and rarer words are joined with the tables.

    * A null or empty text is one end. A null id hashes as empty text.
    * Rows may repeat; each is counted and scored. Texts may be of any length.
    * If nothing is trained on, train_tokens is 0, and both scores are 0 for all tokens: the probability of what is unknown is one.
    """
    spark = docs.sparkSession
    small_batches(spark, 512)
    source = docs.select(F.col(id_col).alias("id"), train_mask.alias("trained"), text_bytes(text_col).alias("text"))
    with shuffles_removed(spark):
        return _scored(source, id_col, config, head_words, head_contexts, head_next)


def _scored(source: DataFrame, id_col: str, config: TreeConfig, head_words: int, head_contexts: int, head_next: int) -> DataFrame:
    spark = source.sparkSession
    words, n, v, levels = _levels(source.where("trained").select("text"), config)
    kept_tables = _model(levels, config)
    model = functools.reduce(DataFrame.unionByName, kept_tables)
    log_step = lambda c: F.floor(F.log2(c) * 8)
    step = log_step("n")
    word_step, _ = least_step(words.groupBy(step.alias("step")).count(), (head_words,))
    least, _ = least_step(model.groupBy(step.alias("step")).agg(F.count("*"), F.sum(F.size("g"))), (head_contexts, head_next))
    within = lambda df, x: df.where(step >= x) if x < math.inf else df.limit(0)
    frequent = within(model, least)
    head = Head(
        _arrays(frequent, "c", "v"),
        _arrays(frequent.select(F.explode(F.arrays_zip("g", "d")).alias("x")).select("x.g", "x.d"), "g", "d"),
        _arrays(within(words, word_step).select("key", F.log10(F.col("n") + 1).alias("v")), "key", "v"),
        config.depth,
    )
    tail = model.where(step < least) if least < math.inf else model
    late = word_filter(tail.select("c"), tail.count())
    shared, less, parts = spark.sparkContext.broadcast(head), math.log10(n + v + 1), _parts(spark)
    # a context of the tail is looked up where the shortest of its suffixes that is in the tail too is looked up
    beyond = F.filter(F.arrays_zip("ups", "ns"), lambda x: log_step(x["ns"]) < least if least < math.inf else F.lit(True))
    tail = tail.select(F.pmod(F.coalesce(F.get(beyond, F.lit(0))["ups"], F.col("c")), F.lit(parts)).cast("int").alias("part"), F.lit(TAIL).alias("kind"), "c", "v", "g", "d")
    plain = [StructField("row", LongType()), source.schema["id"], StructField("trained", BooleanType())]
    plain += [StructField(c, t()) for c, t in (("n_tokens", LongType), ("n_known", LongType), ("base", DoubleType), ("score", DoubleType))]
    blocks = ("rows", "keys", "times", "sizes", "contexts", "grams", "many")
    kinds = [StructField("part", IntegerType()), StructField("kind", IntegerType())]
    schema = StructType(kinds + plain + [StructField(c, BinaryType()) for c in blocks])
    ended = StructType([kinds[1], *plain, *(StructField(c, LongType()) for c in ("key", "times"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, head = Powers(), shared.value
        types: dict[str, pa.DataType] = {}
        held: list[tuple[np.ndarray, ...]] = []

        def out(kind: int, part: np.ndarray, **cols: pa.Array) -> pa.RecordBatch:
            cols |= {"part": pa.array(part.astype(np.int32)), "kind": pa.array(np.full(len(part), kind, np.int32))}
            return pa.RecordBatch.from_arrays([cols[f] if f in cols else pa.nulls(len(part), types.get(f, pa.binary())) for f in schema.names], names=schema.names)

        def chains() -> Iterator[pa.RecordBatch]:
            """Symbols beyond the head, those in the same gram together with their rows, by the partition of their first context."""
            if held:
                rows, sizes, c, g, whole = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                first = np.r_[0, np.cumsum(sizes, dtype=np.int64)[:-1]]
                shortest = c[first]
                order = pair_order(shortest, whole, 2)
                order = order[np.argsort(_part(shortest, parts)[order], kind="stable")]
                alike = run_starts(whole[order])
                each, many = order[alike], _times(alike, len(order))  # one symbol for all in the same gram
                sizes, part = sizes[each], _part(shortest[each], parts)
                del shortest, whole
                starts = run_starts(part)
                cuts = np.r_[starts, len(part)]
                own = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
                c = c[np.repeat(first[each] - own[:-1], sizes) + np.arange(own[-1])]
                low = rows.min()
                cols = {"sizes": binary(sizes, cuts), "grams": binary(g[each], cuts), "many": binary(many, cuts), "contexts": binary(c, own[cuts])}
                cols |= {"rows": binary(((rows[order] - low) // ROUNDS).astype(np.uint16), np.r_[0, np.cumsum(many)][cuts]), "row": pa.array(np.full(len(starts), low))}
                yield from in_slices(out(BEYOND, part[starts], **cols))

        size = 0
        for batch in batches:
            types |= {f.name: f.type for f in batch.schema} | dict(n_tokens=pa.int64(), n_known=pa.int64(), base=pa.float64(), score=pa.float64())
            a = 0
            for hashes, counts in word_runs(batch.column("text"), powers):
                s, place = sequence(hashes, counts)
                own = batch.slice(a, len(counts))
                a += len(counts)
                text = np.repeat(np.arange(len(counts)), counts + 1)  # of every symbol but the starts
                at, w, logp, beyond = head.walk(s, place, less, late.value)
                sums = lambda x: np.bincount(text, x, len(counts))
                logs = head.tables[2][1]
                base = np.where(w >= 0, logs[w], 0.0) if len(logs) else np.zeros(len(w))
                row = own.column("row").to_numpy()
                if held and (row[-1] - held[0][0][0]) // ROUNDS >= CHAIN_ROWS:
                    yield from chains()
                    size = 0
                numbers = {"n_tokens": counts + 1, "n_known": sums(w >= 0).astype(np.int64), "base": sums(base), "score": sums(logp)}
                yield out(DOCUMENT, row % parts, row=own.column("row"), id=own.column("id"), trained=own.column("trained"), **{f: pa.array(x) for f, x in numbers.items()})
                rows = row[text]
                rare = np.flatnonzero(w < 0)
                if len(rare):
                    order = rare[np.lexsort((s[at[rare]], text[rare]))]
                    word = s[at[order]]
                    first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (text[order[1:]] != text[order[:-1]])])
                    cols = {"rows": rows[order[first]], "keys": word[first], "times": np.diff(np.r_[first, len(order)])}
                    whole = np.array([0, len(first)])
                    yield out(RARE, row[:1] % parts, **{f: binary(x, whole) for f, x in cols.items()})
                if beyond:
                    i, c, g = (np.concatenate([x[j] for x in beyond]) for j in range(3))
                    order = np.argsort(i, kind="stable")
                    first = run_starts(i[order])
                    i = i[order[first]]
                    sizes = np.diff(np.r_[first, len(order)]).astype(np.int8)
                    held.append((rows[i], sizes, c[order], g[order[first]], g[order[np.r_[first[1:], len(order)] - 1]]))
                    size += len(i)
                    if size >= CHAINS:
                        yield from chains()
                        size = 0
        yield from chains()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents and rare words as they are; of symbols beyond the head what they add to their rows."""
        types: dict[str, pa.DataType] = {}

        def out(kind: int, size: int, **cols) -> pa.RecordBatch:
            cols = {f: x if isinstance(x, pa.Array) else pa.array(x) for f, x in cols.items()} | {"kind": pa.array(np.full(size, kind, np.int32))}
            return pa.RecordBatch.from_arrays([cols[f] if f in cols else pa.nulls(size, types.get(f, pa.int64())) for f in ended.names], names=ended.names)

        kept: dict[int, list[pa.Table]] = {TAIL: [], BEYOND: []}
        for batch in batches:
            types |= {f.name: batch.schema.field(f.name).type for f in plain}
            for kind, t in _tables(iter([batch])).items():
                if kind in kept:
                    kept[kind].append(t.select(["c", "v", "g", "d"] if kind == TAIL else ["row", "rows", "sizes", "contexts", "grams", "many"]))
                elif kind == DOCUMENT:
                    for x in t.select([f.name for f in plain]).to_batches():
                        yield out(DOCUMENT, len(x), **dict(zip(x.schema.names, x.columns, strict=True)))
                else:
                    row = unpacked(t["rows"], np.int64)
                    yield out(RARE, len(row), row=row, key=unpacked(t["keys"], np.int64), times=unpacked(t["times"], np.int64))
        if not kept[BEYOND]:
            return
        t = pa.concat_tables(kept.pop(BEYOND))
        row, sizes, c, g, many = (unpacked(t[f], k) for f, k in (("rows", np.uint16), ("sizes", np.int8), ("contexts", np.uint64), ("grams", np.uint64), ("many", np.int32)))
        row = row.astype(np.int64) * ROUNDS + np.repeat(t["row"].to_numpy(), pc.binary_length(t["rows"]).to_numpy() // 2)
        del t
        value, sizes = np.zeros(len(g)), sizes.astype(np.int64)
        if kept[TAIL]:
            t = pa.concat_tables(kept.pop(TAIL))
            contexts, following = Lookup(t["c"].to_numpy()), Lookup(pc.list_flatten(t["g"]).to_numpy())
            weight, more = t["v"].to_numpy()[contexts.order], pc.list_flatten(t["d"]).to_numpy()[following.order]
            del t
            first = np.r_[0, np.cumsum(sizes)[:-1]]
            for j in range(int(sizes.max())):  # shorter contexts first
                i = np.flatnonzero(sizes > j)
                own = c[first[i] + j]
                if j:  # only the shortest gram was sent
                    g[i] = join(own, g[i])
                of, word = contexts.find(own), following.find(g[i])
                value[i] += np.where(word >= 0, more[word], np.where(of >= 0, weight[of], 0.0))
        value = np.repeat(value, many)
        order = np.argsort(row, kind="stable")
        starts = run_starts(row[order])
        yield out(MORE, len(starts), row=row[order[starts]], score=np.add.reduceat(value[order], starts))

    scored = None
    for k in range(ROUNDS):
        own = source.where(F.pmod(F.xxhash64("id"), F.lit(ROUNDS)) == k).withColumn("row", F.monotonically_increasing_id() * ROUNDS + k)
        done = own.mapInArrow(run, schema).unionByName(tail, True).repartitionById(parts, F.col("part")).mapInArrow(resolve, ended)
        scored = extended(scored, done) if scored else materialize(done, "lm-scored", hashes=True)
    for x in kept_tables:
        discard(x)
    rare = scored.where(F.col("kind") == RARE).select("row", "key", "times")
    log = F.log10(F.col("n") + 1)
    more = rare.join(words.where(step < word_step) if word_step < math.inf else words, "key").select("row", F.col("times").alias("known"), (F.col("times") * log).alias("base_more"), F.lit(0.0).alias("score_more"))
    more = more.unionByName(scored.where(F.col("kind") == MORE).select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base_more"), F.col("score").alias("score_more")))
    more = more.groupBy("row").agg(F.sum("known").alias("known"), F.sum("base_more").alias("base_more"), F.sum("score_more").alias("score_more"))
    return scored.where(F.col("kind") == DOCUMENT).select("row", "id", "trained", "n_tokens", "n_known", "base", "score").join(more, "row", "left").select(
        F.col("id").alias(id_col),
        "trained",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0)) - F.col("n_tokens") * less).alias("base_score"),
        (F.col("score") + F.coalesce("base_more", F.lit(0.0)) + F.coalesce("score_more", F.lit(0.0))).alias("score"),  # a rare word's count is the root of both
    )


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), crc_mod(7) != 2)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
