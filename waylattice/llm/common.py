"""Shared helpers: tables, materialised intermediates, tokens and hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import discard, materialize, shared_dir, ship

__all__ = ["discard", "materialize", "shared_dir", "ship"]

#: Whitespace of the contracts: blank and the five controls from tab to carriage return. Python's bytes.split() uses the same six.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the queries, whose workers get the package."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Whole texts can be long, so a batch for a Python worker holds few of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind as no column of df (case ignored) has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_bytes(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit("")).cast("binary").alias(col)


def crc_mod(n: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


class WordHashes(dict):
    """64-bit hashes of words, remembered for frequent use; forgets all when it has grown to its bound."""

    BOUND = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: A-Z to lower case, and each byte of whitespace to a blank.
_FOLDED = np.array([b + 32 if 65 <= b <= 90 else 32 if b in b" \t\n\x0b\x0c\r" else b for b in range(256)], np.uint8)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of texts that are hashed together; a longer text is hashed alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd number and of its inverse, as many as have been asked for."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x)], dtype=np.uint64) for x in (_ODD, inverse))
        return self.up, self.down


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def word_runs(texts: pa.Array, powers: Powers) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some texts after another, the hashes of their lower-cased words and the number of words of each text: sums of the bytes'
    numbers times powers, all words at once. texts is a binary array without nulls."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        x = _FOLDED[data[offsets[a] : offsets[b]]]
        cuts = offsets[a : b + 1] - offsets[a]
        inside = x != 32
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = cuts[:-1][cuts[:-1] < len(x)]  # a text's first and last byte are ends of words too
        starts[edge] = inside[edge]
        edge = cuts[1:][cuts[1:] > 0] - 1
        ends[edge] = inside[edge]
        start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        up, down = powers.of(max(1, len(x)))
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTES[x] * up[: len(x)], dtype=np.uint64, out=sums[1:])
        yield mix((sums[end] - sums[start]) * down[start]), np.diff(np.searchsorted(start, cuts))
        a = b


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k words, from the words' hashes; empty if there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)


def run_starts(x: np.ndarray) -> np.ndarray:
    """Positions in a sorted array at which a new value begins."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)


def key_order(keys: np.ndarray) -> np.ndarray:
    """Places of 64-bit hashes in ascending order: sorted with the places in their low bits, which is faster; as that may leave hashes that agree
    in all other bits unsorted, it is tested."""
    low = np.uint64((1 << max(1, len(keys).bit_length())) - 1)
    order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    k = keys[order]
    return np.argsort(keys) if (k[1:] < k[:-1]).any() else order


def binary(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of numbers, those between two cuts as one value."""
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), pa.py_buffer(x)])


def unpacked(column: pa.ChunkedArray, kind) -> np.ndarray:
    """All numbers of some values made by binary()."""
    found = [np.empty(0, kind)]
    for x in column.chunks:
        _, offsets, data = x.buffers()
        if len(x) and data:
            offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(x.type) else np.int32)[x.offset : x.offset + len(x) + 1]
            found.append(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy().view(kind))
    return np.concatenate(found)


#: Bits of a filter of keys; with more keys than it can tell apart it lets more through, and all in the end.
FILTER_BITS = 1 << 27


def key_filter(keys: DataFrame, positions, most: int = FILTER_BITS):
    """A broadcast Bloom filter of a table of keys, at most FILTER_BITS / 8 bytes however many there are.

    positions: given the number of bits, a power of two, the columns of each key's bits. Returns the number and the broadcast array."""
    wide = 1 << 16
    n = keys.count()
    while wide < min(most, 16 * n):
        wide *= 2
    at = F.explode(F.array(*positions(wide))).alias("at")
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    words = keys.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table_ = np.zeros(wide // 64, np.int64)
    table_[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return wide, keys.sparkSession.sparkContext.broadcast(table_.view(np.uint64))


def may_hold(words: np.ndarray, *positions: np.ndarray) -> np.ndarray:
    """Whether a filter has all bits of each key."""
    found = np.ones(len(positions[0]), bool)
    for p in positions:
        p = p.astype(np.int64)
        found &= (words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
    return found


def long_gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """As gram_hashes, by sums of powers: the cost does not grow with k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    r = np.uint64(0x9E3779B97F4A7C15)
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(hashes) - 1, r)], dtype=np.uint64)
    back = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, np.uint64(pow(int(r), -1, 1 << 64)))], dtype=np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum(hashes * power, dtype=np.uint64)]
    return mix((sums[k:] - sums[:-k]) * back + np.uint64(k))


def least_step(counts: DataFrame, most: tuple[int, ...]) -> tuple[float, int]:
    """Of tables' rows by step (step, rows of each kind), the lowest step from which on there are no more rows than `most` of any kind, and
    how many steps are lower; found without a sort of the rows."""
    held, least = [0] * len(most), math.inf
    steps = sorted(counts.collect(), reverse=True)
    for i, (step, *many) in enumerate(steps):
        held = [h + m for h, m in zip(held, many, strict=True)]
        if any(h > m for h, m in zip(held, most, strict=True)):
            return least, len(steps) - i
        least = step
    return least, 0


def in_runs(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[pa.Table]:
    """Rows with equal values of the columns `by`, from batches in which they follow each other."""
    kept: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        values = list(zip(*[b.column(c).to_pylist() for c in by], strict=True))
        start = 0
        for i, v in enumerate(values):
            if v != last:
                if i > start:
                    kept.append(b.slice(start, i - start))
                if kept:
                    yield pa.Table.from_batches(kept)
                kept, start, last = [], i, v
        kept.append(b.slice(start))
    if kept:
        yield pa.Table.from_batches(kept)


def word_filter(keys: DataFrame, rows: int, most: int = FILTER_BITS):
    """A broadcast Bloom filter of 64-bit hashes (one column, about `rows` rows), FILTER_BITS / 8 bytes at most, in which a hash has four bits
    of one word; as key_filter, it lets more through when there are more."""
    wide = 1 << 10
    while wide < min(most // 64, rows // 4):
        wide *= 2
    h = F.col(keys.columns[0])
    bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * j).bitwiseAND(63).cast("int"))
    bits = bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))
    found = keys.groupBy(F.shiftrightunsigned(h, 24).bitwiseAND(wide - 1).alias("word")).agg(F.bit_or(bits).alias("bits")).toArrow()
    table_ = np.zeros(wide, np.int64)
    table_[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(table_.view(np.uint64))


def word_may_hold(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a word_filter may have each hash."""
    bits = np.zeros(len(h), np.uint64)
    for j in range(4):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * j)) & np.uint64(63))
    return words[((h >> np.uint64(24)) & np.uint64(len(words) - 1)).astype(np.int64)] & bits == bits


def native_filter(keys: DataFrame, rows: int, most: int = FILTER_BITS):
    """As key_filter, for expressions only: given a 64-bit hash column, whether it may be among `keys` (one such column, at most
    `rows` rows). The bits are a scalar subquery of one array, of FILTER_BITS / 8 bytes at most."""
    wide = 1 << 16
    while wide < min(most, 16 * rows):
        wide *= 2
    places = lambda c: [F.shiftrightunsigned(c, 18 * j).bitwiseAND(wide - 1) for j in range(3)]
    at = F.explode(F.array(*places(F.col(keys.columns[0])))).alias("at")
    words = keys.select(at).groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    dense = keys.sparkSession.range(wide // 64).join(words, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    array = materialize(dense.agg(F.array_sort(F.collect_list("w")).alias("w")).select(F.col("w.bits").alias("bits")), "filter", 1)

    def test(hash_: Column) -> Column:
        bits = array.scalar()
        found = None
        for p in places(hash_):
            hit = F.element_at(bits, F.shiftright(p, 6).cast("int") + 1).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63).cast("int"))) != 0
            found = hit if found is None else found & hit
        return found

    return test
