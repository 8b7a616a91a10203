"""N-gram Jaccard join: size-banded tiles with bitmap signatures that bound the overlap, then exact intersection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType

from ..operators.components import components
from .common import WordHashes, free_names, gram_hashes, in_runs, key_filter, materialize, may_hold, mix, native_filter, run_starts, signed, small_batches, table, text_bytes

SHINGLE, PERCENT = 5, 80
#: Band keys of a set, each of ROWS minima of independent orders of its shingles. Linked sets have an equal minimum with probability
#: 0.8 or more, so no key in common with (1 - 0.8 ** 3) ** 40 = 3e-13 at most; texts that share a passage alone rarely have one.
BANDS, ROWS = 40, 3
#: The most that this probability may be, for any percent.
MISS = 1e-12
#: Sets of a side of a tile. A larger bucket is cut by size, and what is still larger into parts.
TILE = 2048
#: Pairs that a tile holds before it drops those that are not the likeliest.
PAIRS = 1_000_000
#: Bits of a signature by the least size of a set.
WIDTHS = ((0, 512), (128, 1024), (256, 2048), (1024, 8192), (4096, 32768))


def shingles(data: bytes, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; with fewer words, the hash of the whole sequence; without words, empty."""
    words = data.lower().split()
    return np.unique(gram_hashes(hashes.of(words), min(size, len(words)))) if words else np.empty(0, np.uint64)


def set_key(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def least_overlap(total: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least intersection of linked sets whose sizes add up to total."""
    return -(-percent * total // (100 + percent))


def band_shape(percent: int) -> tuple[int, int]:
    """Keys, and minima of each, with which a pair at the threshold is missed with probability MISS at most."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    for rows in range(ROWS, 0, -1):
        if (1 - (percent / 100) ** rows) ** BANDS <= MISS:
            return BANDS, rows
    return math.ceil(math.log(MISS) / math.log(1 - percent / 100)), 1


class Bands:
    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        x = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
        self.flip, self.times = x[: bands * rows], x[bands * rows :] | np.uint32(1)
        self.bands, self.rows = bands, rows
        self.salt = mix(np.arange(bands, dtype=np.uint64))

    def keys(self, s: np.ndarray) -> np.ndarray:
        if not len(s):
            return np.empty(0, np.int64)
        x = (s >> np.uint64(32)).astype(np.uint32)[:, None]
        least = np.full(len(self.flip), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 2048):
            np.minimum(least, ((x[i : i + 2048] ^ self.flip) * self.times).min(axis=0), out=least)
        key = self.salt
        for column in least.reshape(self.bands, self.rows).T:
            key = mix(key ^ column)
        return signed(key)


def signature(s: np.ndarray) -> bytes:
    width = next(w for least, w in reversed(WIDTHS) if len(s) >= least)
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Tile:
    """Sets of one tile, by size: what their signatures allow."""

    def __init__(self, sizes: np.ndarray, signatures: list[bytes], percent: int):
        self.n, self.percent = sizes.astype(np.int64), percent
        self.level = np.array([next(i for i, (_, w) in enumerate(WIDTHS) if w == len(x) * 8) for x in signatures])
        self.bits, self.at = [], []
        for level, (_, w) in enumerate(WIDTHS):
            own = np.flatnonzero(self.level >= level)
            m = np.zeros((len(own), w // 64), np.uint64)
            for row, i in enumerate(own):
                x = np.frombuffer(signatures[i], np.uint64).reshape(-1, w // 64)
                m[row] = np.bitwise_or.reduce(x, axis=0)
            at = np.full(len(sizes), -1)
            at[own] = np.arange(len(own))
            self.bits.append((m, np.bitwise_count(m).sum(axis=1, dtype=np.int64)))
            self.at.append(at)

    def score(self, i: int, others: np.ndarray) -> np.ndarray:
        """The most that others can share with set i, as a part of the sum of sizes; -1 where that is too little for a link."""
        need = least_overlap(self.n[i] + self.n[others], self.percent)
        most = np.minimum(self.n[i], self.n[others])
        live = np.flatnonzero(most >= need)
        for level in range(self.level[i] + 1):
            if level:
                live = live[self.level[others[live]] >= level]
            if not len(live):
                continue
            m, count = self.bits[level]
            a, b = self.at[level][i], self.at[level][others[live]]
            both = np.bitwise_count(m[a] & m[b]).sum(axis=1, dtype=np.int64)
            bound = np.minimum(self.n[i] - count[a], self.n[others[live]] - count[b]) + both
            most[live] = np.minimum(most[live], bound)
            live = live[most[live] >= need[live]]
        return np.where(most >= need, most / (self.n[i] + self.n[others]), -1.0)

    def forest(self) -> list[tuple[int, int]]:
        """A spanning forest of the pairs that the signatures allow, likeliest pairs first."""
        edges, todo = [], np.ones(len(self.n), bool)
        best, by = np.empty(len(self.n)), np.zeros(len(self.n), np.int64)
        while todo.any():
            cur = int(np.argmax(todo))
            todo[cur] = False
            best.fill(-1)
            while len(rest := np.flatnonzero(todo)):
                s = self.score(cur, rest)
                better = rest[s > best[rest]]
                by[better] = cur
                best[better] = s[s > best[rest]]
                cur = int(rest[np.argmax(best[rest])])
                if best[cur] < 0:
                    break
                edges.append((int(by[cur]), cur))
                todo[cur] = False
        return edges

    def between(self, group: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> tuple[np.ndarray, bool]:
        """Of the allowed pairs of a left and a right set, between each two groups the `most` likeliest; whether there are more."""
        held, size, more = [np.empty((0, 3))], 0, False
        for i in np.flatnonzero(left).tolist():
            rest = np.flatnonzero(right & (group != group[i]) & ~((left & right[i]) & (np.arange(len(group)) < i)))
            s = self.score(i, rest)
            found = s >= 0
            held.append(np.c_[np.full(found.sum(), i), rest[found], s[found]])
            size += len(held[-1])
            if size > PAIRS:
                best, rest_out = self._likeliest(np.concatenate(held), group, most)
                held, size, more = [best], 0, more or rest_out
        best, rest_out = self._likeliest(np.concatenate(held), group, most)
        return best[:, :2].astype(np.int64), more or rest_out

    @staticmethod
    def _likeliest(pairs: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, bool]:
        a, b = group[pairs[:, 0].astype(np.int64)], group[pairs[:, 1].astype(np.int64)]
        code = np.minimum(a, b) * len(group) + np.maximum(a, b)
        order = np.lexsort((-pairs[:, 2], code))
        starts = run_starts(code[order])
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        return pairs[order[rank < most]], bool((rank >= most).any())


def _sets(docs: DataFrame, shingle: int, shape: tuple[int, int]) -> DataFrame:
    """id, n, k (128-bit hash of the set, null if it is empty), keys."""
    schema = StructType([docs.schema["id"], StructField("n", LongType()), StructField("k", BinaryType()), StructField("keys", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bands = WordHashes(), Bands(*shape)
        for b in batches:
            sets = [shingles(x, hashes, shingle) for x in b.column("text").to_pylist()]
            cols = [
                b.column("id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_key(s) for s in sets], pa.binary()),
                pa.array([bands.keys(s) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema)


def _read_again(docs: DataFrame, found: DataFrame, shingle: int) -> DataFrame:
    """k, n, bits and s (the sorted set) of the sets `found`. Texts are picked by a filter of bounded size, so that they aren't shuffled."""
    wide, shared = key_filter(found, lambda wide: [F.conv(F.hex(F.substring("k", 4 * j + 1, 4)), 16, 10).cast("long") % wide for j in range(3)])
    schema = StructType([StructField("k", BinaryType()), StructField("n", LongType()), StructField("bits", BinaryType()), StructField("s", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, words = WordHashes(), shared.value
        given: set[bytes] = set()  # copies in one task are given once
        for b in batches:
            rows = []
            if len(given) > 300_000:
                given.clear()
            for x in b.column("text").to_pylist():
                s = shingles(x, hashes, shingle)
                if (k := set_key(s)) is None or k in given:
                    continue
                if may_hold(words, np.frombuffer(k, ">u4", 3).astype(np.int64) % wide).all():
                    given.add(k)
                    rows.append((k, len(s), signature(s), s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.binary()))], names=schema.names)

    return docs.mapInArrow(run, schema)


#: Partners of a set that are intersected with it in one place.
PARTNERS = 256


def _verified(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """a, b and whether they link: each set b travels to a copy of its a, one for PARTNERS of them, and is intersected there."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("slices"))
    pairs = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int").alias("slice"))
    other = pairs.join(arrays, pairs["b"] == arrays["k"]).select("a", "slice", "b", "s")
    own = arrays.join(pairs.select("a", "slice").distinct(), arrays["k"] == F.col("a")).select("a", "slice", F.lit(None).cast("binary").alias("b"), "s")
    both = own.unionByName(other).repartition("a", "slice").sortWithinPartitions("a", "slice", F.col("b").asc_nulls_first())
    schema = StructType([StructField("a", BinaryType()), StructField("b", BinaryType()), StructField("linked", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine = None, None
        for t in batches:
            out: tuple[list, list, list] = ([], [], [])
            for a, b, s in zip(*[t.column(c).to_pylist() for c in ("a", "b", "s")], strict=True):
                s = np.frombuffer(s, np.uint64)
                if b is None:
                    key, mine = a, s
                    continue
                assert key == a
                shared = len(np.intersect1d(mine, s, assume_unique=True))
                for x, v in zip(out, (a, b, 100 * shared >= percent * (len(mine) + len(s) - shared)), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.bool_())], names=schema.names)

    return both.mapInArrow(run, schema)


def _placed(members: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """k, key, window, members: the sets that meet. A bucket of up to TILE sets is one window. In a larger one, sets are in bands of
    size, as wide as linked sets can differ at most, and each window has a band and the one below: no pair that can link is apart."""
    step = math.log(100 / percent) * (1 + 1e-9)
    band = F.floor(F.log("n") / step) if step else F.col("n")
    few = members.where(F.col("members") <= TILE).select("k", "key", F.lit(-1).cast("long").alias("window"), "members")
    large = members.where(F.col("members") > TILE).join(sizes, "k").withColumn("band", band.cast("long"))
    counts = large.groupBy("key", "band").agg(F.count("*").alias("own"))
    below = counts.select("key", (F.col("band") + 1).alias("band"), F.col("own").alias("below"))
    windows = counts.join(below, ["key", "band"], "left").select("key", F.col("band").alias("window"), (F.col("own") + F.coalesce("below", F.lit(0))).alias("members"))
    # windows that have no band of their own would have pairs of the band below alone
    return few.unionByName(large.select("k", "key", F.explode(F.array("band", F.col("band") + 1)).alias("window")).join(windows, ["key", "window"]))


def _tiles(rows: DataFrame, turn: int) -> DataFrame:
    """Adds lo, hi, the tile among those of a window, and on which sides of it a set is.

    A window of up to TILE sets is one tile. A larger one is cut by hash into parts. At turn 0 the first part meets each other
    one; later, sets outside the window's largest component meet all sets. Of two sets that are not in one component, one
    at least is outside the largest, so every pair that is still open meets; and a group of like sets, one component
    after turn 0, costs its size and not its square."""
    rows = rows.withColumn("parts", F.ceil(F.col("members") / TILE).cast("int")).withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))
    side = lambda lo, hi, left, right: {"lo": lo, "hi": hi, "left": left, "right": right}
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    each = lambda n: F.explode(F.sequence(zero, n - 1))
    one = rows.where("parts = 1").withColumns(side(zero, zero, yes, yes))
    several = rows.where("parts > 1")
    if turn == 0:
        first = several.where("part = 0").withColumn("hi", F.explode(F.sequence(F.lit(1), F.col("parts") - 1))).withColumns({"lo": zero, "left": yes, "right": yes})
        out = one.unionByName(first).unionByName(several.where("part > 0").withColumns(side(zero, F.col("part"), no, yes)))
    else:
        labels = several.groupBy("key", "window", "label").agg(F.count("*").alias("size"))
        largest = labels.groupBy("key", "window").agg(F.max(F.struct("size", "label")).alias("largest"))
        several = several.join(largest, ["key", "window"]).withColumn("rest", F.ceil((F.col("members") - F.col("largest.size")) / TILE).cast("int")).where("rest > 0")
        outside = several.where(F.col("label") != F.col("largest.label")).withColumn("hi", each(F.col("parts")))
        outside = outside.withColumns({"lo": F.pmod(F.xxhash64("k", F.lit(1)), F.col("rest")).cast("int"), "left": yes, "right": no})
        all_ = several.withColumn("lo", each(F.col("rest"))).withColumns({"hi": F.col("part"), "left": no, "right": yes})
        out = one.unionByName(outside.unionByName(all_).drop("rest", "largest"))
    return out.drop("parts", "part")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Link texts whose sets of distinct word shingles have 100 * intersection >= percent * union, and find the components.

    Returns one row per input row: id_col, n_shingles, component_id (the smallest id reachable by links, its own included).

    1. Texts with equal sets are one set from here on. 2. Bands of minima bucket the sets, in front of the join, so that only
    sets that may link are compared. A pair at the threshold has no key in common with probability MISS at most, if the
    orders are independent (3e-13 for 80 percent): the lower the percent, the fewer minima a key has, and then the more
    keys there are. 3. Within a bucket, sets meet in tiles; those of a large bucket are cut into bands of size, and a tile
    has only sizes that can link (_placed, _tiles). A tile compares the bitmap signatures of its sets: a bit set in only one
    of two counts against the overlap, which bounds it from above. It gives a spanning forest of the pairs that are still
    possible, never all of them. 4. Those pairs are intersected exactly, as sorted arrays. Where all pairs of a tile's forest
    link, the tile is done: any other possible pair is within a component. Else, the tile gives the likeliest pairs
    between each two components, more in each turn, until none is left out. So what is sent grows with the sets and with
    the pairs just below the threshold.

    * Null and empty texts, and texts without words, have 0 shingles, no links, and their own id as component_id.
    * A null id is never the smallest, unless a component has no other; rows may repeat.
    * An empty table gives an empty result.
    """
    shape = band_shape(percent)
    first, classes = _components(docs, id_col, text_col, shingle, percent, shape)
    classes = classes.drop("label")
    return first.join(classes, "k", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, shape: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """id, n, k of each row, and for each k its component: a label, and the smallest id."""
    spark = docs.sparkSession
    small_batches(spark, 512)
    source = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    first = materialize(_sets(source, shingle, shape), "jaccard-sets")
    n = first.count()
    sets = first.where("k is not null")
    reps = materialize(sets.groupBy("k").agg(F.min("id").alias("rep")), "jaccard-reps", n)

    one = sets.join(reps.withColumnRenamed("k", "k_"), (F.col("k") == F.col("k_")) & F.col("id").eqNullSafe(F.col("rep")))
    keyed = materialize(one.select("k", "keys"), "jaccard-keys", n).select("k", F.explode("keys").alias("key"))
    # two different sets at least; sets of repeated rows are not
    buckets = materialize(keyed.groupBy("key").agg(F.count("*").alias("members"), F.min(F.xxhash64("k")).alias("lo"), F.max(F.xxhash64("k")).alias("hi")).where("lo < hi").select("key", "members"), "jaccard-buckets", 8 * n)
    members = materialize(keyed.join(buckets, "key"), "jaccard-members", 8 * n)
    found = materialize(members.select("k").distinct(), "jaccard-found", n)
    # of equal texts one
    whole = materialize(_read_again(source, found, shingle).join(found, "k", "left_semi").dropDuplicates(["k"]), "jaccard-whole", n)
    signatures, arrays = whole.select("k", "n", "bits"), whole.select("k", "s")

    edge = StructType([StructField("key", LongType()), StructField("window", LongType()), StructField("a", BinaryType()), StructField("b", BinaryType()), StructField("more", BooleanType())])

    def candidates(rows: DataFrame, turn: int, most: int) -> DataFrame:
        """Pairs of each tile, a < b, and whether it may have more: of a forest at turn 0, then between components. A part of a window
        whose forest is not one tree may have more in other parts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in in_runs(batches, "key", "window", "lo", "hi"):
                several = t.column("members")[0].as_py() > TILE
                if t.num_rows < 2 and not several:
                    continue
                k, key, window = t.column("k").to_pylist(), t.column("key")[0], t.column("window")[0]
                if turn:
                    _, group = np.unique(np.array(t.column("label").to_pylist(), object), return_inverse=True)
                    if not group.any():
                        continue
                tile, more = Tile(t.column("n").to_numpy(), t.column("bits").to_pylist(), percent), False
                if turn:
                    pairs, more = tile.between(group, t.column("left").to_numpy(), t.column("right").to_numpy(), most)
                else:
                    pairs = tile.forest()
                    more = several and (len(pairs) < t.num_rows - 1 or not t.column("left").to_numpy().any())
                if more and not len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array([x.as_py()], y) for x, y in ((key, pa.int64()), (window, pa.int64()))] + [pa.nulls(1, pa.binary())] * 2 + [pa.array([True])], names=edge.names)
                ordered = [(k[i], k[j]) if k[i] < k[j] else (k[j], k[i]) for i, j in pairs]
                size = len(ordered)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * size, pa.int64()), pa.array([window.as_py()] * size, pa.int64()), pa.array([a for a, _ in ordered], pa.binary()), pa.array([b for _, b in ordered], pa.binary()), pa.array([more] * size, pa.bool_())],
                    names=edge.names,
                )

        tiles = _tiles(rows, turn).join(signatures, "k").repartition("key", "window", "lo", "hi").sortWithinPartitions("key", "window", "lo", "hi", "n", "k")
        return tiles.mapInArrow(run, edge)

    placed = materialize(_placed(members, whole.select("k", "n"), percent), "jaccard-placed", 8 * n)
    links, turn, most = None, 0, 4
    while True:
        pairs = materialize(candidates(placed, turn, most), "jaccard-pairs", 8 * n)
        checked = materialize(_verified(pairs.where("a is not null").select("a", "b").distinct(), arrays, percent), "jaccard-checked", 4 * n)
        new = checked.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        links = new if links is None else links.unionByName(new)
        labels = materialize(components(links, n), "jaccard-labels", n)
        # windows of which some possible pair may not have been intersected: at turn 0, also those in which some pair does not link
        still = pairs.where("more").select("key", "window")
        if not turn:
            still = still.unionByName(pairs.join(checked.where("not linked"), ["a", "b"], "left_semi").select("key", "window"))
        still = materialize(still.distinct(), "jaccard-open", n)
        if still.isEmpty():
            break
        rows = placed.drop("label").join(still, ["key", "window"], "left_semi").join(labels.withColumnsRenamed({"node": "k"}), "k", "left")
        placed = materialize(rows.withColumn("label", F.coalesce("label", "k")), "jaccard-placed", 8 * n)
        most, turn = most * (16 if turn else 1), turn + 1

    classes = reps.join(labels, reps["k"] == labels["node"], "left").select("k", "rep", F.coalesce("label", "k").alias("label"))
    least = classes.groupBy("label").agg(F.min("rep").alias("component"))
    return first, materialize(classes.join(least, "label").select("k", "label", "component"), "jaccard-classes", n)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, with all columns: that of the smallest id, and of rows with this id that of the smallest
    set key. Ids may be null or repeat. Rows without words are all kept."""
    first, classes = _components(docs, id_col, text_col, SHINGLE, PERCENT, band_shape(PERCENT))
    rows = materialize(first.where("k is not null").join(classes.select("k", "label"), "k").groupBy("label", "id", "k").agg(F.count("*").alias("times")), "jaccard-rows")
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("best"))
    judged = rows.join(best, "label").select("id", "k", "times", (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("k") == F.col("best.k"))).alias("stays"))
    judged = materialize(judged, "jaccard-kept")
    dropped = judged.where("not stays or times > 1").select("id").distinct()
    may_go = native_filter(dropped.select(F.xxhash64("id").alias("key")), dropped.count())(F.xxhash64(id_col))
    # most rows have no id of a dropped one, and stay where they are; of the others the text says which row it is
    own, other_id, other_set = free_names(docs, "set", "kept_id", "kept_set")
    schema = StructType([*docs.schema.fields, StructField(own, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            keys = [set_key(shingles(x if isinstance(x, bytes) else (x or "").encode(), hashes)) for x in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], names=schema.names)

    asked = docs.where(may_go).mapInArrow(run, schema)
    kept = judged.where("stays").select(F.col("id").alias(other_id), F.col("k").alias(other_set))
    one = asked.where(F.col(own).isNotNull()).join(kept, F.col(id_col).eqNullSafe(F.col(other_id)) & (F.col(own) == F.col(other_set)), "left_semi").dropDuplicates([id_col, own])
    return docs.where(~may_go).unionByName(asked.where(F.col(own).isNull()).unionByName(one).select(*docs.columns))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT r, hash(array_to_string(w[i : i + 4], ' ')) AS g FROM i),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
o AS (SELECT a.r AS u, b.r AS v, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS (SELECT u, v FROM o JOIN n a ON a.r = u JOIN n b ON b.r = v WHERE 100 * x >= 80 * (a.n + b.n - x)),
c AS (SELECT r AS u, r AS v FROM d UNION SELECT c.u, l.v FROM c JOIN l ON c.v = l.u)
SELECT x.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(y.doc_id) AS component_id
FROM c JOIN d x ON x.r = c.u JOIN d y ON y.r = c.v LEFT JOIN n ON n.r = c.u GROUP BY c.u, x.doc_id, n.n
"""
