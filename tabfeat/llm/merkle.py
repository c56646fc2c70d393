"""Merkle manifest of a table: one tree per source, one tree over the sources, stored as blocks in van Emde Boas order.

A node is the SHA-256 of up to 16 children, which are its run. Leaves of a source are numbered by ranges, so a source of any
size is dealt over many tasks. An aligned subtree of 4,096 leaves is one block: an array that is split at half height, the
top tree first, then every bottom tree, each laid out in the same way. Addresses come from arithmetic on (depth, index)
alone, both when a block is built and when siblings are fetched. The roots of the blocks are the leaves of the next tier of
blocks, up to one block per source; the subroots of the sources are the leaves of the last tree.

Proofs come down the tiers again: each block learns the siblings above its root once, its leaves add their own.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabfeat.llm.text import arrow_schema, by_partition
from tabfeat.session import scratch_path

BITS = 4
FANOUT = 1 << BITS

#: Levels of edges in a block, a parameter: its leaves number 16 to that power.
BLOCK_EDGES = 3

#: Bytes of a digest as hex text, the form in which digests are hashed.
HEX = 64


# ---- one block -------------------------------------------------------------------------------


def tree_size(levels: int) -> int:
    """Nodes of a complete tree with that many levels of nodes."""
    return ((1 << BITS * levels) - 1) // (FANOUT - 1)


def addresses(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` of a depth stand in the array of a complete tree: split at half height until one level is left."""
    place = np.zeros(len(index), np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
        else:
            bottom, below = levels - top, BITS * (depth - top)
            place += tree_size(top) + (index >> below) * tree_size(bottom)
            index, depth, levels = index & ((1 << below) - 1), depth - top, bottom
    return place


def levels_for(n: int, most: int = BLOCK_EDGES) -> int:
    """Levels of nodes of the blocks that n leaves of one tier need: one that just holds them, or many of full height."""
    edges = 0
    while edges < most and (1 << BITS * edges) < n:
        edges += 1
    return edges + 1


def widths(levels: int, leaves: int) -> list[int]:
    """Nodes of each depth, the root's first; the right-hand part of the last block is missing."""
    out = [leaves]
    for _ in range(levels - 1):
        out.append(-(-out[-1] // FANOUT))
    return out[::-1]


class Block:
    """The nodes of an aligned subtree; ``stored`` keeps those that exist, in van Emde Boas order."""

    def __init__(self, levels: int, leaves: int):
        self.levels, self.widths = levels, widths(levels, leaves)
        self.tree = np.zeros(tree_size(levels), f"S{HEX}")

    def _row(self, depth: int) -> np.ndarray:
        return addresses(self.levels, depth, np.arange(self.widths[depth]))

    def runs(self, depth: int) -> list[bytes]:
        """Hex digests of the runs of a depth, each of up to 16 siblings."""
        row, step = self.tree[self._row(depth)].tobytes(), FANOUT * HEX
        return [row[i:i + step] for i in range(0, len(row), step)]

    @classmethod
    def build(cls, levels: int, leaves: list[bytes]) -> Block:
        block = cls(levels, len(leaves))
        block.tree[block._row(levels - 1)] = leaves
        for depth in range(levels - 2, -1, -1):
            block.tree[block._row(depth)] = [sha256(run).hexdigest().encode() for run in block.runs(depth + 1)]
        return block

    @property
    def root(self) -> bytes:
        return bytes(self.tree[0])

    def _present(self) -> np.ndarray:
        return np.sort(np.concatenate([self._row(d) for d in range(self.levels)]))

    @property
    def stored(self) -> bytes:
        return bytes.fromhex(self.tree[self._present()].tobytes().decode())

    @classmethod
    def load(cls, levels: int, leaves: int, stored: bytes) -> Block:
        block = cls(levels, leaves)
        block.tree[block._present()] = np.frombuffer(stored.hex().encode(), f"S{HEX}")
        return block

    def paths(self) -> Iterable[list[tuple[bytes, bytes]]]:
        """For every leaf the siblings to its left and right, level by level up to the block's root."""
        runs = [self.runs(d) for d in range(self.levels - 1, 0, -1)]
        for leaf in range(self.widths[-1]):
            path, index = [], leaf
            for level in runs:
                run, own = level[index >> BITS], (index & (FANOUT - 1)) * HEX
                path.append((run[:own], run[own + HEX:]))
                index >>= BITS
            yield path


def packed(path: list[tuple[bytes, bytes]]) -> bytes:
    """A path as bytes: per level the numbers of siblings on either side, then their digests."""
    return b"".join(bytes((len(a) // HEX, len(b) // HEX)) + bytes.fromhex((a + b).decode()) for a, b in path)


def unpacked(data: bytes) -> list[tuple[bytes, bytes]]:
    path, at = [], 0
    while at < len(data):
        a, b = data[at], data[at + 1]
        at += 2
        digests = data[at:at + (a + b) * HEX // 2].hex().encode()
        path.append((digests[:a * HEX], digests[a * HEX:]))
        at += (a + b) * HEX // 2
    return path


def folded(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that follows from a leaf and its siblings, all in hex."""
    for left, right in path:
        leaf = sha256(left + leaf + right).hexdigest().encode()
    return leaf


# ---- tables ----------------------------------------------------------------------------------


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[_field(f) for f in fields]).cast("binary"), 256)


def leaf_rows(docs: DataFrame, received: Column | None = None) -> DataFrame:
    """_key (the source; sorts nulls first, else bytewise), doc_id, leaf, and claimed: the leaf of the text that was received
    instead, where ``received`` is not null."""
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = _digest(*rest, F.col("text"))
    claimed = F.lit(None).cast("string") if received is None else F.when(received.isNotNull(), _digest(*rest, received))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    return docs.select(key.alias("_key"), F.col("doc_id"), leaf.alias("leaf"), claimed.alias("claimed"))


def _numbered(rows: DataFrame, path: str, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` (written twice, to ``path``) with _pos, the place within their _key by ``order``, and _n, the number of rows of the key.

    The rows are sorted over ranges; every range counts its rows of each key, and the sums of the counts before give a
    range its start. Rows that agree in everything are parted by a number, so they cannot fill a range either.
    """
    spark = rows.sparkSession
    rows.withColumn("_tie", F.monotonically_increasing_id()).write.parquet(f"{path}/rows")
    by = [F.col("_key"), *[F.col(c).asc_nulls_first() for c in order], F.col("_tie")]
    ranged = spark.read.parquet(f"{path}/rows").repartitionByRange(*by).sortWithinPartitions(*by)
    ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()).write.parquet(f"{path}/sorted")
    rows = spark.read.parquet(f"{path}/sorted").withColumn("_range", F.shiftright("_at", 33))
    counts = rows.groupBy("_key", "_range").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    own = Window.partitionBy("_key")
    before = F.sum("_rows").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_key", "_range", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(own).alias("_n"))
    counts.write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    placed = rows.join(counts, ["_key", "_range"]).withColumn("_pos", F.col("_before") + F.col("_at") - F.col("_first"))
    return placed.drop("_range", "_at", "_first", "_before"), counts.agg(F.max("_n")).first()[0] or 0


_BLOCKS = "_key string, _block long, _n long, leaves int, levels int, nodes binary, root string"


def _blocks(nodes: DataFrame, edges: int) -> DataFrame:
    """One row for every block of a tier: ``nodes`` has _key, _pos, _n and digest."""
    arrow = arrow_schema(_BLOCKS)

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_pos")
        n, leaves = rows["_n"][0].as_py(), [d.encode() for d in rows["digest"].to_pylist()]
        block = Block.build(levels_for(n, edges), leaves)
        values = (rows["_key"][0].as_py(), rows["_block"][0].as_py(), n, len(leaves), block.levels, block.stored, block.root.decode())
        return pa.Table.from_pylist([dict(zip(arrow.names, values))], arrow)

    ready = nodes.select("_key", "_pos", "_n", "digest", F.shiftright("_pos", BITS * edges).alias("_block"))
    return ready.groupBy("_key", "_block").applyInArrow(build, _BLOCKS)


def _tiers(nodes: DataFrame, largest: int, path: str, edges: int) -> list[DataFrame]:
    """Blocks of every tier, written; the block roots of one tier are the leaves of the next, until each key has one block."""
    spark, tiers, width = nodes.sparkSession, [], 1 << BITS * edges
    while largest:
        _blocks(nodes, edges).write.parquet(f"{path}/tier{len(tiers)}")
        tiers.append(spark.read.parquet(f"{path}/tier{len(tiers)}"))
        nodes = tiers[-1].where(F.col("_n") > width).select(
            "_key", F.col("_block").alias("_pos"), F.ceil(F.col("_n") / width).cast("long").alias("_n"), F.col("root").alias("digest"))
        largest = 0 if largest <= width else -(-largest // width)
    return tiers


@dataclass
class Manifest:
    """``rows``: every leaf with _key, _pos and _n; ``tiers``: blocks of the sources' trees; ``sources``: _key, _pos and
    digest (subroot) of each source; ``top``: blocks of the tree over the sources; ``root`` (None for an empty table); ``edges`` of a block."""

    rows: DataFrame
    tiers: list[DataFrame]
    sources: DataFrame
    top: list[DataFrame]
    root: str | None
    edges: int

    def done(self, tier: DataFrame) -> DataFrame:
        """The blocks of a tier whose root is the subroot of their source."""
        return tier.where(F.col("_n") <= 1 << BITS * self.edges)


def build_manifest(spark: SparkSession, leaves: DataFrame, edges: int = BLOCK_EDGES) -> Manifest:
    """The trees over the rows of ``leaf_rows``; everything is written to the shared folder."""
    path = scratch_path(spark, "merkle")
    rows, largest = _numbered(leaves, f"{path}/leaves", ["doc_id", "leaf"])
    tiers = _tiers(rows.withColumnRenamed("leaf", "digest"), largest, f"{path}/blocks", edges)
    found = Manifest(rows, tiers, rows, [], None, edges)
    if tiers:
        subroots = reduce(DataFrame.unionByName, [found.done(t).select(
            F.lit("").alias("_key"), F.col("_key").alias("source_key"), F.col("root").alias("digest")) for t in tiers])
        sources, largest = _numbered(subroots, f"{path}/subroots", ["source_key"])
        found.sources = sources.select(F.col("source_key").alias("_key"), "_pos", "digest")
        found.top = _tiers(sources, largest, f"{path}/top", edges)
        found.root = found.top[-1].select("root").first()[0]
    return found


def _below(blocks: DataFrame, above: DataFrame, edges: int) -> DataFrame:
    """_key, _block (of the tier below), path and subroot: the siblings above each leaf of the blocks."""
    joined = blocks.select("_key", "_block", "leaves", "levels", "nodes").join(above, ["_key", "_block"])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own, first = unpacked(row["path"]), row["_block"] << BITS * edges
                paths = [packed(p + own) for p in Block.load(row["levels"], row["leaves"], row["nodes"]).paths()]
                yield {"_key": [row["_key"]] * len(paths), "_block": [first + i for i in range(len(paths))], "path": paths,
                       "subroot": [row["subroot"]] * len(paths)}

    return by_partition(joined, "_key string, _block long, path binary, subroot string", run)


def _above(manifest: Manifest) -> DataFrame:
    """_key, _block, path and subroot of every block of the sources' lowest tier."""
    spark = manifest.rows.sparkSession
    above = spark.createDataFrame([("", 0, b"", "")], "_key string, _block long, path binary, subroot string")
    for blocks in reversed(manifest.top):
        above = _below(blocks, above, manifest.edges)
    to_source = above.select(F.col("_block").alias("_pos"), "path").join(manifest.sources, "_pos").select(
        "_key", F.lit(0).cast("long").alias("_block"), "path", F.col("digest").alias("subroot"))
    above = None
    for tier in reversed(manifest.tiers):
        tops = manifest.done(tier).select("_key").join(to_source, "_key")
        above = tops if above is None else above.unionByName(tops.select(above.columns))
        if tier is not manifest.tiers[0]:
            above = _below(tier, above, manifest.edges)
    return above


_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verify(manifest: Manifest) -> DataFrame:
    """Every leaf with the digest of its proof, and the root that its claimed leaf (else its own) folds to."""
    spark = manifest.rows.sparkSession
    if manifest.root is None:
        return spark.createDataFrame([], _RESULT)
    arrow, root = arrow_schema(_RESULT), manifest.root

    def run(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        rows, block = rows.sort_by("_pos"), blocks.to_pylist()[0]
        above, out = unpacked(block["path"]), {name: [] for name in arrow.names}
        upper = b"".join(a + b for a, b in above)
        leaves, claimed = rows["leaf"].to_pylist(), rows["claimed"].to_pylist()
        for leaf, claim, path in zip(leaves, claimed, Block.load(block["levels"], block["leaves"], block["nodes"]).paths(), strict=True):
            out["proof_sha256"].append(sha256(b"".join([x for pair in path for x in pair]) + upper).hexdigest())
            out["folded_root"].append(folded((claim or leaf).encode(), path + above).decode())
        n = len(leaves)
        out |= {"doc_id": rows["doc_id"].to_pylist(), "leaf": leaves, "subroot": [block["subroot"]] * n, "root": [root] * n}
        out["verified"] = [f == root for f in out["folded_root"]]
        return pa.table([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    blocks = manifest.tiers[0].select("_key", "_block", "leaves", "levels", "nodes").join(_above(manifest), ["_key", "_block"])
    rows = manifest.rows.select("_key", F.shiftright("_pos", BITS * manifest.edges).alias("_block"), "_pos", "doc_id", "leaf", "claimed")
    return rows.groupBy("_key", "_block").cogroup(blocks.groupBy("_key", "_block")).applyInArrow(run, _RESULT)


def lowered_where(every: int) -> Column:
    """The text with A-Z in lower case where ``every`` divides the crc32 of doc_id in decimal, else null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.translate("text", upper, upper.lower()))


def audit(docs: DataFrame, received: Column | None = None, edges: int = BLOCK_EDGES) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``.

    ``received`` is the text as it arrived, null where it is the original. Leaves of a source ascend by doc_id, null first;
    rows that share a doc_id are leaves of their own, ordered by their digests; a null source is a source of its own and
    the first. Null fields hash as ``-``; a null text received is the original. An empty table gives no rows. Other columns
    are not read.
    """
    return verify(build_manifest(docs.sparkSession, leaf_rows(docs, received), edges))
