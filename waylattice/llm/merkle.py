"""A Merkle manifest of a dataset: one ternary tree for each source and one over the sources, kept as blocks in van Emde Boas order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, materialize, table

#: Children of a node, and levels of a block above its leaves: a block has at most ARITY ** LEVELS leaves.
ARITY, LEVELS = 3, 7
BLOCK = "tree string, block long, leaves int, height int, nodes binary, digest binary"
PATH = "tree string, i long, siblings binary, steps binary"
PROOF = "id {id}, leaf binary, claimed binary, subroot binary, siblings binary, steps binary"


def tree_size(height: int) -> int:
    """Nodes of a complete tree of `height` levels."""
    return (ARITY**height - 1) // (ARITY - 1)


def veb_address(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes `index` of one level (depth 0 is the root) of a complete tree of `height` levels in van Emde Boas order: the
    tree is cut at half its height, the top comes first and then each bottom tree, all laid out in the same way."""
    place = np.zeros_like(index)
    while height > 1:
        top = height // 2
        if depth < top:
            height = top
        else:
            which, index = np.divmod(index, ARITY ** (depth - top))
            place = place + tree_size(top) + which * tree_size(height - top)
            height, depth = height - top, depth - top
    return place


def level_sizes(leaves: int, levels: int | None) -> list[int]:
    """Nodes of each level, leaves first: up to one node, or so many levels above the leaves."""
    out = [leaves]
    while out[-1] > 1 if levels is None else len(out) <= levels:
        out.append(-(-out[-1] // ARITY))
    return out


def node_of(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def lay_out(leaves: list[bytes], levels: int | None) -> tuple[int, bytes, bytes]:
    """Height, nodes in van Emde Boas order (32 bytes each, up to the last used place) and root of a block."""
    sizes = level_sizes(len(leaves), levels)
    height, row = len(sizes), [x.hex() for x in leaves]
    nodes = np.zeros((tree_size(height), 32), np.uint8)
    used = 0
    for up, n in enumerate(sizes):
        if up:
            row = [node_of(row[j : j + ARITY]) for j in range(0, len(row), ARITY)]
        at = veb_address(height, height - 1 - up, np.arange(n))
        nodes[at] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(n, 32)
        used = max(used, int(at.max()) + 1)
    return height, nodes[:used].tobytes(), bytes.fromhex(row[0])


def paths(n: int, height: int, nodes: bytes, levels: int | None, above: bytes, above_steps: bytes) -> tuple[pa.Array, pa.Array]:
    """For each leaf of a block its siblings, from the leaves to the root of all trees, and its steps: a byte 3 * siblings + own place for a level."""
    digests = np.frombuffer(nodes + above, np.uint8).reshape(-1, 32)
    own, index = len(nodes) // 32, np.arange(n)
    at, shown, steps = [], [], []
    for up, size in enumerate(level_sizes(n, levels)[:-1]):
        node = index // ARITY**up
        first = node - node % ARITY
        each = first[:, None] + np.arange(ARITY)
        at.append(veb_address(height, height - 1 - up, np.minimum(each, size - 1)))
        shown.append((each < size) & (each != node[:, None]))
        steps.append(3 * (np.minimum(ARITY, size - first) - 1) + node - first)
    rest = np.arange(own, len(digests))
    at.append(np.broadcast_to(rest, (n, len(rest))))
    shown.append(np.ones((n, len(rest)), bool))
    steps = np.column_stack([*steps, np.broadcast_to(np.frombuffer(above_steps, np.uint8), (n, len(above_steps)))]).astype(np.uint8)
    shown = np.concatenate(shown, axis=1)
    ends = np.r_[0, np.cumsum(shown.sum(axis=1) * 32)].astype(np.int32)
    flat = digests[np.concatenate(at, axis=1)[shown]].tobytes()
    siblings = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
    wide = np.arange(n + 1, dtype=np.int32) * steps.shape[1]
    return siblings, pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(wide), pa.py_buffer(np.ascontiguousarray(steps).tobytes())])


def folded(leaf: bytes, siblings: bytes, steps: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    node, others, at = leaf.hex(), siblings.hex(), 0
    for step in steps:
        n, place = divmod(step, 3)
        left = at + 64 * place
        right = at + 64 * n
        node = hashlib.sha256((others[at:left] + node + others[left:right]).encode()).hexdigest()
        at = right
    return bytes.fromhex(node)


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields: `-` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    shown = []
    for f in fields:
        f = f.cast("string")
        shown.append(F.when(f.isNull(), "-").otherwise(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f)))
    return F.unhex(F.sha2(F.concat(*shown), 256))


def positions(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """Adds i, the place of a row among those of its tree. Rows are sorted in ranges over all trees, so a large tree has many tasks; a range knows
    how many rows of each tree the ranges before it have."""
    parts = materialize(
        rows.repartitionByRange(F.col(tree), *order).sortWithinPartitions(F.col(tree), *order)
        .withColumn("part_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)),
        "merkle-sorted",
    )
    sizes = parts.groupBy("part_", tree).agg(F.count("*").alias("n_"), F.min("at_").alias("first_"))
    before = F.sum("n_").over(Window.partitionBy(tree).orderBy("part_")) - F.col("n_")
    starts = sizes.select(tree, "part_", (before - F.col("first_")).alias("shift_"))
    return parts.join(starts, ["part_", tree]).withColumn("i", F.col("at_") + F.col("shift_")).drop("part_", "at_", "shift_")


@dataclass
class Manifest:
    """blocks: the blocks of all trees, a table for each round of recursion over block roots (tree, block, leaves, height, nodes, digest,
    alone: whether its tree ends in it). over: the same for the tree over the sources. names: tree and i of each source, in order."""

    root: str | None
    names: DataFrame
    blocks: list[DataFrame] = field(default_factory=list)
    over: list[DataFrame] = field(default_factory=list)
    levels: int = LEVELS

    def table(self) -> DataFrame:
        """All blocks with their kind (source or root) and round."""
        both = [(k, r, b) for k, all_ in (("source", self.blocks), ("root", self.over)) for r, b in enumerate(all_)]
        out = None
        for kind, r, b in both:
            b = b.select(F.lit(kind).alias("kind"), F.lit(r).alias("round"), F.when(F.col("tree").startswith("="), F.substring("tree", 2, 2**31 - 1)).alias("source"), "block", "leaves", "height", "nodes", "digest")
            out = b if out is None else out.unionByName(b)
        return out


def _rounds(leaves: DataFrame, levels: int, tag: str) -> list[DataFrame]:
    """Blocks of trees from their leaves (tree, i, digest), then of the trees of their blocks' roots, until each tree has one root."""
    wide, out = ARITY**levels, []
    while True:

        def build(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            tree, block, alone = (x.as_py() for x in key)
            order = np.argsort(t.column("i").to_numpy(), kind="stable")
            digests = t.column("digest").to_pylist()
            height, nodes, root = lay_out([digests[k] for k in order], None if alone else levels)
            return pa.table({"tree": [tree], "block": [block], "leaves": pa.array([len(digests)], pa.int32()), "height": pa.array([height], pa.int32()), "nodes": pa.array([nodes], pa.binary()), "digest": pa.array([root], pa.binary()), "alone": [alone]})

        sized = leaves.groupBy("tree").agg((F.max("i") < wide).alias("alone"))
        rows = leaves.withColumn("block", F.floor(F.col("i") / wide).cast("long"))
        # known from the block alone, but for the first: only trees with one block end in it
        small = rows.where("block = 0").join(sized, "tree").unionByName(rows.where("block > 0").withColumn("alone", F.lit(False)))
        out.append(materialize(small.select("tree", "block", "alone", "i", "digest").groupBy("tree", "block", "alone").applyInArrow(build, BLOCK + ", alone boolean"), tag))
        leaves = out[-1].where("not alone").select("tree", F.col("block").alias("i"), "digest")
        if leaves.isEmpty():
            return out


def manifest(leaves: DataFrame, levels: int = LEVELS) -> Manifest:
    """The trees of placed leaves (tree, i, digest): runs of three nodes become one, level by level, and the trees' roots, in order of their
    names, likewise one root. Blocks of 3 ** levels leaves are built apart, each in its van Emde Boas layout, and their roots are the leaves of
    the next round; so no task holds more than a block, however large a source is. Without leaves, the root is None."""
    blocks = _rounds(leaves, levels, "merkle-blocks")
    tops = blocks[0].where("alone")
    for b in blocks[1:]:
        tops = tops.unionByName(b.where("alone"))
    tops = materialize(positions(tops.select(F.lit("").alias("one"), "tree", "digest"), "one", [F.col("tree")]), "merkle-sources")
    over = _rounds(tops.select(F.col("one").alias("tree"), "i", "digest"), levels, "merkle-root")
    root = over[-1].where("alone").first()
    return Manifest(root["digest"].hex() if root else None, tops.select("tree", "i", F.col("digest").alias("subroot")), blocks, over, levels)


def _below(blocks: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """Paths (tree, i, siblings, steps) of the leaves of blocks whose own paths are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                siblings, steps = paths(r["leaves"], r["height"], r["nodes"], None if r["alone"] else levels, r["siblings"], r["steps"])
                i = pa.array(np.arange(r["leaves"]) + r["block"] * ARITY**levels)
                yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * r["leaves"], pa.string()), i, siblings, steps], names=["tree", "i", "siblings", "steps"])

    return blocks.join(above.withColumnRenamed("i", "block"), ["tree", "block"]).mapInArrow(run, PATH)


def block_paths(m: Manifest) -> DataFrame:
    """The blocks that hold leaves of sources, with subroot and the path from their roots to the root of all."""
    nothing = F.lit(b"")
    path = None
    for r in reversed(range(len(m.over))):
        top = m.over[r].where("alone").select("tree", F.col("block").alias("i"), nothing.alias("siblings"), nothing.alias("steps"))
        path = materialize(_below(m.over[r], top if path is None else path.unionByName(top), m.levels), "merkle-paths")
    own = m.names.join(path.select("i", "siblings", "steps"), "i").drop("i")
    path = None
    for r in reversed(range(len(m.blocks))):
        top = m.blocks[r].where("alone").join(own, "tree").select("tree", F.col("block").alias("i"), "siblings", "steps")
        path = top if path is None else path.unionByName(top)
        if r:
            path = materialize(_below(m.blocks[r], path, m.levels), "merkle-paths")
    return m.blocks[0].join(path.withColumnRenamed("i", "block"), ["tree", "block"]).join(m.names.select("tree", "subroot"), "tree")


def proofs(leaves: DataFrame, m: Manifest) -> DataFrame:
    """For each placed leaf (tree, i, id, digest, claimed): id, leaf, claimed, subroot, siblings and steps. A block's leaves
    meet its layout in one task, where places of siblings are computed, not searched."""
    wide, levels = ARITY**m.levels, m.levels

    def run(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        b = blocks.to_pylist()[0]
        rows = rows.take(np.argsort(rows.column("i").to_numpy(), kind="stable"))
        siblings, steps = paths(b["leaves"], b["height"], b["nodes"], None if b["alone"] else levels, b["siblings"], b["steps"])
        subroot = pa.array([b["subroot"]] * len(rows), pa.binary())
        return pa.table([rows.column("id"), rows.column("digest"), rows.column("claimed"), subroot, siblings, steps], names=["id", "leaf", "claimed", "subroot", "siblings", "steps"])

    rows = leaves.withColumn("block", F.floor(F.col("i") / wide).cast("long"))
    return rows.groupBy("tree", "block").cogroup(block_paths(m).groupBy("tree", "block")).applyInArrow(run, PROOF.format(id=leaves.schema["id"].dataType.simpleString()))


def fold(found: DataFrame) -> DataFrame:
    """Adds folded, the root that the claimed leaf (else the leaf) and the siblings lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("leaf", "claimed", "siblings", "steps"))
            roots = [folded(leaf if claimed is None else claimed, s, steps) for leaf, claimed, s, steps in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(roots, pa.binary())], names=[*b.schema.names, "folded"])

    return found.mapInArrow(run, f"{found.schema.simpleString()[7:-1]},folded:binary")


def audited(
    docs: DataFrame, claimed_text: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), levels: int = LEVELS,
) -> tuple[Manifest, DataFrame]:
    """The manifest of a table, and for each row: id, leaf, claimed, subroot, siblings, steps, folded (all digests as 32 bytes).

    claimed_text: texts as somebody hands them in, to be tested against the manifest; where it is null or equals the text, the row's own
    leaf is folded. A leaf is the digest of the fields; leaves of a source ascend by id, null ids first, and those with one id by digest.

    * Null fields have a mark of their own; a null source is a tree of its own, the first. Empty and null texts differ.
    * Repeated rows are leaves each, with equal digests; which of them comes first makes no difference to the result but for their proofs,
      which are dealt to the rows of one id and digest in any order.
    * An empty table has no root and no rows. Other columns are not read.
    """
    tree = F.when(F.col(source_col).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    claimed = F.lit(None).cast("binary")
    if claimed_text is not None:
        other = leaf_digest(*[claimed_text if c == text_col else F.col(c) for c in fields])
        claimed = F.when(claimed_text.isNotNull() & (claimed_text != F.col(text_col)), other)
    rows = materialize(docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf_digest(*map(F.col, fields)).alias("digest"), claimed.alias("claimed")), "merkle-leaves")
    leaves = materialize(positions(rows, "tree", [F.col("id").asc_nulls_first(), F.col("digest")]), "merkle-placed")
    m = manifest(leaves.select("tree", "i", "digest"), levels)
    return m, fold(proofs(leaves, m))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(crc_mod(2) == 0, F.replace("text", F.lit("\n"), F.lit("")))
    m, found = audited(docs, F.when(F.col("doc_id").isNotNull(), tampered))
    shown = lambda c: F.lower(F.hex(c)).alias(c)
    proof = F.sha2(F.lower(F.hex("siblings")), 256).alias("proof_sha256")
    root = F.lit(m.root).cast("string")
    return found.select(F.col("id").alias("doc_id"), shown("leaf"), shown("subroot"), root.alias("root"), proof, F.lower(F.hex("folded")).alias("folded_root"), (F.lower(F.hex("folded")) == root).alias("verified"))


OP11_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, text,
         CASE WHEN list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) % 2 = 1 THEN 3988292384 ELSE 0 END)) % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS claimed,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents),
l AS (SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(claimed) || ':' || claimed, '-')) AS own FROM f),
p AS (SELECT *, coalesce('=' || source, '-') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS k FROM l),
t AS (SELECT tree, 0 AS up, i, leaf AS d, count(*) OVER (PARTITION BY tree) AS n FROM p
      UNION ALL
      SELECT tree, up + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY tree, up, i // 3),
s AS (SELECT tree, d AS subroot, up AS top, row_number() OVER (ORDER BY tree) - 1 AS j FROM t WHERE n = 1),
r AS (SELECT 0 AS up, j, subroot AS d, count(*) OVER () AS n FROM s
      UNION ALL
      SELECT up + 1, j // 3, sha256(string_agg(d, '' ORDER BY j)), (any_value(n) + 2) // 3 FROM r WHERE n > 1 GROUP BY up, j // 3),
v AS (SELECT d AS root, up AS over FROM r WHERE n = 1),
x AS (SELECT p.*, subroot, top, j, root, over FROM p JOIN s USING (tree), v),
o AS (SELECT k, u AS step, tree, u AS up, i // pow(3, u)::BIGINT AS at FROM (SELECT *, unnest(range(0, top)) AS u FROM x)
      UNION ALL
      SELECT k, top + u, '', u, j // pow(3, u)::BIGINT FROM (SELECT *, unnest(range(0, over)) AS u FROM x)),
g AS (SELECT tree, up, i, d FROM t UNION ALL SELECT '', up, j, d FROM r),
q AS (SELECT k, step, coalesce(string_agg(d, '' ORDER BY g.i) FILTER (g.i < o.at), '') AS a, coalesce(string_agg(d, '' ORDER BY g.i) FILTER (g.i > o.at), '') AS b
      FROM o JOIN g ON g.tree = o.tree AND g.up = o.up AND g.i // 3 = o.at // 3 GROUP BY k, step),
e AS (SELECT k, string_agg(a || b, '' ORDER BY step) AS proof FROM q GROUP BY k),
w AS (SELECT k, 0 AS step, own AS node FROM p UNION ALL SELECT w.k, w.step + 1, sha256(a || node || b) FROM w JOIN q ON q.k = w.k AND q.step = w.step),
z AS (SELECT k, arg_max(node, step) AS folded_root FROM w GROUP BY k)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM x JOIN z USING (k) LEFT JOIN e USING (k)
"""
