"""MinHash near-duplicates: many universal hash minima, banding, signature verification, exact confirmation, components.

Documents with equal shingle sets are one class and compared once. Classes whose minima agree in a band share a bucket.
A bucket first compares its members with the smallest one only; after the components of those links, members of different
components that were not compared yet are compared in blocks of bounded size, by sketches that hold most sets whole. So no
bucket emits all its pairs, and none loses one that could join two components.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfeat.llm.components import components
from tabfeat.llm.text import WordHashes, by_batch, give_back, lower_ascii, mixed, numbered, texts_of, window_hashes
from tabfeat.session import cut_lineage, scratch_path

SHINGLE = 5
SIMILARITY_PERCENT = 75

#: 32 bands of 4 minima: two texts of similarity 0.75 meet in none with a chance of 5 in a million, of 0.8 of 6 in 100 million.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS

#: Share of equal minima below which a pair is not confirmed: five standard deviations under 0.75.
LEAST_AGREEMENT = 0.56

#: Members of a bucket in one block of the second comparison, and hashes of a set that it compares at most.
BLOCK, SKETCH = 1024, 1024

#: Hashes that a block compares at once: two tables of 4 bytes for each of them and each member are held.
COLUMNS = 1024

_random = np.random.default_rng(5)
_A = (_random.integers(0, 1 << 31, HASHES, np.uint64) * 2 + 1).astype(np.uint32)[:, None]
_B = _random.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)[:, None]


def shingle_words(text: bytes) -> set[bytes]:
    """The set itself: distinct windows of five words, or all words if there are fewer."""
    words = lower_ascii(text).split()
    size = min(SHINGLE, len(words))
    return {b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set()


def shingle_hashes(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the set."""
    words = lower_ascii(text).split()
    return np.unique(window_hashes(hashes.of(words), min(SHINGLE, len(words)))) if words else np.empty(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over the set; 16 bits of each are kept."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, (_A * x[i:i + 1024] + _B).min(axis=1), out=least)
    return least.astype(np.uint16)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null when empty) and signature."""
    hashes = WordHashes()

    def run(batch):
        out = defaultdict(list)
        out["doc_id"] = batch.column("doc_id").to_pylist()
        for text in batch.column("text").to_pylist():
            own = shingle_hashes(text, hashes)
            out["n_shingles"].append(len(own))
            out["digest"].append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            out["signature"].append(minima(own).tobytes() if len(own) else None)
        return out

    return by_batch(texts_of(docs, "doc_id"), "doc_id long, n_shingles long, digest binary, signature binary", run)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band for each row of minima."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        key = mixed(key + rows[:, :, i] + np.uint64(1))
    return key.view(np.int64)


def _bands(classes: DataFrame) -> DataFrame:
    """band and node, one row for each band of each class."""

    def run(batch):
        n = batch.num_rows
        blobs = batch.column("signature").to_pylist()
        keys = band_keys(np.frombuffer(b"".join(blobs), np.uint16).reshape(n, HASHES))
        return {"band": keys.reshape(-1), "node": np.repeat(batch.column("node").to_numpy(zero_copy_only=False), BANDS)}

    return by_batch(classes.select("node", "signature"), "band long, node long", run)


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs a, b whose signatures agree well enough to be confirmed."""
    sides = [classes.select(F.col("node").alias(c), F.col("signature").alias(f"_{c}")) for c in "ab"]

    def run(batch):
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("_a", "_b"))
        good = (left == right).mean(axis=1) >= LEAST_AGREEMENT
        return {c: batch.column(c).to_numpy(zero_copy_only=False)[good] for c in "ab"}

    return by_batch(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "_a", "_b"), "a long, b long", run)


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough, as edges u, v."""
    sides = [texts.select(F.col("node").alias(c), F.col("packed").alias(f"_{c}")) for c in "ab"]

    def run(batch):
        out, seen = {"u": [], "v": []}, {}

        def of(node, packed):
            if node not in seen:
                if len(seen) > 64:
                    seen.clear()
                seen[node] = shingle_words(zstandard.decompress(packed))
            return seen[node]

        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "_a", "_b")), strict=True):
            p, q = of(a, x), of(b, y)
            common = len(p & q)
            if 100 * common >= SIMILARITY_PERCENT * (len(p) + len(q) - common):
                out["u"].append(a)
                out["v"].append(b)
        return out

    return by_batch(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "_a", "_b"), "u long, v long", run)


def _packed_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and compressed text of the documents that are compared at all; texts travel compressed."""

    def run(batch):
        pack = zstandard.ZstdCompressor(level=3)
        return {"node": batch.column("node").to_pylist(), "packed": [pack.compress(t) for t in batch.column("text").to_pylist()]}

    packed = by_batch(texts_of(docs.select(F.col("doc_id").alias("node"), "text"), "node"), "node long, packed binary", run)
    return packed.join(nodes, "node").groupBy("node").agg(F.max("packed").alias("packed"))


def _sketches(texts: DataFrame) -> DataFrame:
    """node, level and sketch: the 32-bit hashes of the set below 2^(32 - level), all of them (level 0) or at most SKETCH."""
    hashes = WordHashes()

    def run(batch):
        out = {"node": batch.column("node").to_pylist(), "level": [], "sketch": []}
        for packed in batch.column("packed").to_pylist():
            values, level = (shingle_hashes(zstandard.decompress(packed), hashes) >> np.uint64(32)).astype(np.uint32), 0
            while len(values) > SKETCH:
                level += 1
                values = values[values < 1 << (32 - level)]
            out["level"].append(level)
            out["sketch"].append(values.tobytes())
        return out

    return by_batch(texts, "node long, level int, sketch binary", run)


def similar_in_block(sketches: list[np.ndarray], levels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of left and right members may be similar enough."""
    return compared_in_block(sketches, levels, left, right)[0]


def compared_in_block(sketches: list[np.ndarray], levels: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of left and right members may be similar enough, and which surely are.

    Whole sets are compared exactly but for the few hashes that may collide; sketches by estimate (five deviations), which
    makes no pair sure.
    """
    out, sure = np.zeros((len(left), len(right)), bool), np.zeros((len(left), len(right)), bool)
    owner, value = np.repeat(np.arange(len(sketches), dtype=np.int32), [len(s) for s in sketches]), np.concatenate(sketches)
    for level in np.unique(levels):
        use = (levels[owner] <= level) & (value < 1 << (32 - int(level)))
        size = np.bincount(owner[use], minlength=len(sketches)).astype(np.float32)
        _, column, times = np.unique(value[use], return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times[column] > 1)
        member, column = owner[use][shared], np.unique(column[shared], return_inverse=True)[1].astype(np.int32)
        common = np.zeros(out.shape, np.float32)
        order = np.argsort(column, kind="stable")
        member, column = member[order], column[order]
        for at in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
            a, b = np.searchsorted(column, [at, at + COLUMNS])
            table = np.zeros((len(sketches), COLUMNS), np.float32)
            table[member[a:b], column[a:b] - at] = 1
            common += table[left] @ table[right].T
        union = size[left][:, None] + size[right][None, :] - common
        least = 75.0 * union - 200.0 if level == 0 else 65.5 * union
        compared = np.maximum(levels[left][:, None], levels[right][None, :]) == level
        out |= compared & (100.0 * common >= least)
        if level == 0:
            sure |= compared & (100.0 * common >= 75.0 * union + 200.0)
    return out, sure


def spanning_pairs(possible: np.ndarray, sure: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) that join the components ``left`` and ``right`` as far as the sure ones do, and all other possible
    ones between components that are still apart. So a block of n similar members emits fewer than n sure pairs."""
    names, label = np.unique(np.concatenate([left, right]), return_inverse=True)
    rows, columns, group = label[:len(left)], label[len(left):], np.arange(len(names))
    pairs = []
    for i in np.flatnonzero(sure.any(axis=1)):
        found = np.flatnonzero(sure[i])
        while True:
            apart = found[group[columns[found]] != group[rows[i]]]
            if not len(apart):
                break
            pairs.append((int(i), int(apart[0])))
            group[group == group[columns[apart[0]]]] = group[rows[i]]
    i, j = np.nonzero(possible & ~sure & (group[rows][:, None] != group[columns][None, :]))
    return pairs + list(zip(i.tolist(), j.tolist()))


def _across(members: DataFrame, links: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs a < b of one bucket, neither its smallest member, in different components and similar by their sketches; of those
    that are surely similar only enough to join their components."""
    placed = members.where("node <> pivot").join(components(links), "node", "left").select(
        "band", "node", F.coalesce("component", "node").alias("component"))
    open_bands = placed.groupBy("band").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("_n")).where(
        "_low < _high").select("band", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    rows = cut_lineage(placed.join(open_bands, "band"))
    rows = rows.join(_sketches(texts.join(rows.select("node").distinct(), "node", "left_semi")), "node")
    own = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    rows = rows.withColumns({"_own": own, "_other": F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))})
    rows = rows.select("band", "node", "component", "level", "sketch", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))

    def compare(frame):
        import pandas as pd

        node, component = frame["node"].to_numpy(), frame["component"].to_numpy()
        left, right = (np.flatnonzero(frame["_own"] == frame[c]) for c in ("_i", "_j"))
        possible, sure = compared_in_block([np.frombuffer(s, np.uint32) for s in frame["sketch"]], frame["level"].to_numpy(), left, right)
        chosen = np.array(spanning_pairs(possible, sure, component[left], component[right]), np.int64).reshape(-1, 2)
        a, b = node[left[chosen[:, 0]]], node[right[chosen[:, 1]]]
        del possible, sure
        give_back()
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return rows.groupBy("band", "_i", "_j").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two documents are linked if their sets of five-word shingles have a Jaccard similarity of 0.75 or more, which is
    confirmed on the full sets; component_id is the smallest doc_id reachable. Null texts and texts without words have an
    empty set and no link. Repeated rows are copies; rows that share a doc_id are one node, and with different texts stand
    together. Rows without a doc_id link with none and are kept. An empty table gives none. Columns other than doc_id and
    text are not read.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "near-dedup")
    shingle_sets(docs).write.parquet(f"{path}/sets")
    sets = spark.read.parquet(f"{path}/sets")
    sets.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("signature").alias("signature")).write.parquet(f"{path}/classes")
    all_classes = spark.read.parquet(f"{path}/classes")
    classes = all_classes.select("node", "signature")

    bands = _bands(classes)
    buckets = bands.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("_last")).where("pivot < _last").select("band", "pivot")
    bands.join(buckets, "band").write.parquet(f"{path}/members")
    members = spark.read.parquet(f"{path}/members")
    _packed_texts(docs, members.select("node").distinct()).write.option("compression", "none").parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")

    tried = cut_lineage(members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    likely = cut_lineage(_agreeing(tried, classes))  # so that no task runs two Python workers at once
    links = cut_lineage(_linked(likely, texts))
    more = _across(members, links, texts).join(tried, ["a", "b"], "left_anti")
    links = cut_lineage(links.unionByName(_linked(more, texts)))

    found = components(links)
    placed = sets.select("doc_id", "n_shingles", "digest").join(all_classes.select("digest", "node"), "digest", "left").join(found, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that another row of their component stands for: the one of smallest doc_id, rows
    without a doc_id last.

    The rows are numbered first and judged by number, so rows that share a doc_id are compared by their texts like any other,
    and so are rows without one. Texts without words stay. All columns are returned as they are.
    """
    keyed = numbered(docs, "near-dedup")
    number, name = F.col("_row"), F.coalesce(F.col("_name"), F.lit(1 << 62))
    found = near_duplicates(keyed.select(number.alias("doc_id"), "doc.text")).where("n_shingles > 0").select(
        F.col("doc_id").alias("_row"), F.col("component_id").alias("_component"))
    placed = found.join(keyed.select("_row", F.col("doc.doc_id").alias("_name")), "_row")
    first = placed.groupBy("_component").agg(F.min(F.struct(name.alias("name"), number.alias("row"))).alias("_first"))
    dropped = placed.join(first, "_component").where(number != F.col("_first.row")).select("_row")
    return keyed.join(dropped, "_row", "left_anti").select("doc.*")
