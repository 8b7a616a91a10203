"""Byte-level BPE: long texts are pre-tokenised in overlapping chunks that are stitched where their boundaries agree; pieces are encoded apart."""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import materialize, table

#: Code points of a chunk, and of what it shares with the next one.
CHUNK, OVERLAP = 32_768, 1_024
#: Code points that a boundary must be away from the end of a chunk that goes on: no match looks further ahead.
AHEAD = 3
#: A vocabulary is broadcast, so it has a bound: that of a file with as many entries of usual length.
MOST_BYTES = 64 << 20


@dataclass(frozen=True)
class Vocabulary:
    """The bytes of a file of ranks (base64 of a token's bytes and its rank in each line), and the pattern of pre-tokens."""

    ranks: bytes
    pattern: str

    @staticmethod
    def read(path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            ranks = f.read(MOST_BYTES + 1)
        if len(ranks) > MOST_BYTES:
            raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
        return Vocabulary(ranks, pattern)


@lru_cache(2)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """Made once in each worker process."""
    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


@lru_cache(2)
def matcher(pattern: str) -> regex.Pattern:
    """The pattern for texts of any script; white space is that of Unicode, as in the encoder."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def boundaries(text: str, find: regex.Pattern, last: bool) -> list[int]:
    """Ends of pre-tokens at which a text can be cut: what stands before has no white space at its end, so it is matched alike alone. With more
    text to come, those near the end are left out. No match goes over a boundary: what follows depends on the text behind it alone."""
    most = len(text) if last else len(text) - AHEAD
    return [e for m in find.finditer(text) if 0 < (e := m.end()) <= most and not text[e - 1].isspace()]


def packed_ids(text: str, enc: tiktoken.Encoding) -> bytes:
    return np.array(enc.encode_ordinary(text), "<u4").tobytes()


def _chunks(batches: Iterator[pa.RecordBatch], size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Chunks of texts (row, part, own, after): own texts follow each other, after is the beginning of the next."""
    for b in batches:
        for row, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True):
            n = -(-len(text) // size)
            own = [text[k * size : (k + 1) * size] for k in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(own, pa.string()), pa.array([x[:overlap] for x in own[1:]] + [""], pa.string())],
                names=["row", "part", "own", "after"],
            )


CHUNKS = "row long, part long, own string, after string"
CUTS = "heads array<int>, tails array<int>"


def _stitched(chunks: DataFrame, shared, overlap: int) -> DataFrame:
    """Chunks with the cuts they begin and end at: the first boundary in what a chunk shares with the next one that both have.

    From a boundary that both have on, their boundaries are the same, and the first chunk of a text has the true ones; so has each next.
    Where two have none in common (one pre-token is longer than the overlap), they are put together and tried again with the chunk behind, so
    rounds end when the longest pre-token is inside one chunk. A round reads the texts of the last round that have such a place."""

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = matcher(shared.value.pattern)
        for b in batches:
            heads, tails = [], []
            for own, after in zip(b.column("own").to_pylist(), b.column("after").to_pylist(), strict=True):
                found = boundaries(own + after, find, not after)
                heads.append(found[: bisect.bisect_right(found, overlap)])
                tails.append([x - len(own) for x in found[bisect.bisect_right(found, len(own)) :]] if after else [])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=[*b.schema.names, "heads", "tails"])

    done, behind = None, Window.partitionBy("row").orderBy("part")
    while True:
        marked = materialize(chunks.mapInArrow(cuts, f"{CHUNKS}, {CUTS}"), "bpe-chunks")
        ends = marked.select("row", "part", "tails", F.lead("heads").over(behind).alias("next"))
        cut = F.when(F.col("next").isNotNull(), F.array_min(F.array_intersect("tails", "next")))
        ends = ends.select("row", "part", cut.alias("cut"), (F.col("next").isNotNull() & cut.isNull()).alias("open"))
        begins = F.coalesce(F.lag("cut").over(behind), F.lit(0))
        ends = materialize(ends.select("row", "part", "cut", "open", begins.alias("begin"), F.max("open").over(Window.partitionBy("row")).alias("again")), "bpe-cuts")
        whole = marked.select("row", "part", "own", "after").join(ends.where("not again"), ["row", "part"]).drop("open", "again")
        done = whole if done is None else done.unionByName(whole)
        again = ends.where("again")
        if again.isEmpty():
            return done
        group = F.coalesce(F.sum(F.when(~F.col("open"), 1).otherwise(0)).over(behind.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        joined = marked.select("row", "part", "own", "after").join(again.select("row", "part", group.alias("group")), ["row", "part"])
        parts = F.array_sort(F.collect_list(F.struct("part", "own", "after")))
        joined = joined.groupBy("row", "group").agg(parts.alias("c"))
        chunks = joined.select("row", F.col("group").alias("part"), F.array_join("c.own", "").alias("own"), F.element_at("c", -1)["after"].alias("after"))


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Token ids of texts: one row per input row, the columns named in carry and ids, 4 bytes for each id, least first.

    Each match of the pattern is encoded apart by the ranks; special tokens are ordinary text. A text of up to `chunk` code points is
    encoded where it is read. A longer one is cut into chunks with an overlap, which are spread over all tasks and pre-tokenised; they are stitched
    where the boundaries of neighbours agree, and the pieces between are encoded in the tasks. The ids of a text meet in one row in the end.

    * A null text counts as empty, and an empty text has no ids. Rows may repeat; a text may have any length a row can have, and one
      pre-token may be longer than a chunk. An empty table gives an empty result.
    * A carried column named ids (in any case) is left out; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    carry = tuple(c for c in carry if c.lower() != "ids")
    names = [f"keep_{i}" for i in range(len(carry))]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(carry, names, strict=True)], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value.ranks, shared.value.pattern)
        for b in batches:
            ids = pa.array([packed_ids(t, enc) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), ids], names=[*names, "ids"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value.ranks, shared.value.pattern)
        for b in batches:
            ids = []
            for r in b.to_pylist():
                end = len(r["own"]) + r["cut"] if r["after"] else None
                ids.append(packed_ids((r["own"] + r["after"])[r["begin"] : end], enc))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("part"), pa.array(ids, pa.binary())], names=["row", "part", "ids"])

    long = F.length("text") > chunk
    short = rows.where(~long).mapInArrow(here, StructType([*kept, StructField("ids", BinaryType())]))
    texts = materialize(rows.where(long).withColumn("row", F.monotonically_increasing_id()), "bpe-long")
    chunks = texts.select("row", "text").mapInArrow(lambda batches: _chunks(batches, chunk, overlap), CHUNKS).repartition("row", "part")
    encoded = _stitched(chunks, shared, overlap).mapInArrow(pieces, "row long, part long, ids binary")
    whole = encoded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", F.hex("ids").alias("ids")))).alias("p"))
    whole = texts.drop("text").join(whole.select("row", F.unhex(F.array_join("p.ids", "")).alias("ids")), "row").drop("row")
    return short.unionByName(whole.select(*names, "ids")).toDF(*carry, "ids")


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the bytes that ids stand for, joined as they are: they need not be a text. Null or no ids give no bytes; an id that the vocabulary
    lacks, or bytes that are no whole ids, raise."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    if name.lower() in (c.lower() for c in encoded.columns):
        raise ValueError(f"there is a column {name} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value.ranks, shared.value.pattern)
        for b in batches:
            out = [enc.decode_bytes(np.frombuffer(ids or b"", "<u4").tolist()) for ids in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, name])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(name, BinaryType())]))


def public_vocabulary() -> Vocabulary:
    """The vocabulary of the query, from the installed files."""
    import public_tokenizers

    return Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_vocabulary()
    found = decode(encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
