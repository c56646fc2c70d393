"""Document fingerprints: MinHash signatures of whole texts, likeness of signatures, heads of signature bands.

A fingerprint is the least value of each of 128 universal hash permutations over a text's five-word shingles, 16 bits of
each. Texts are compared with an edited version and with the next document: texts are sorted over ranges of doc_id, every
task passes over its range once and holds one text besides the current batch; the last text of a range meets the first of
the next range in a small second step. Equal minima estimate the Jaccard similarity of the shingle sets.

``band_heads`` joins signatures on bands: every text is compared with the smallest doc_id of each of its buckets, first by
signature, then by the Jaccard similarity of the full sets. That is linear in the number of documents, however large a bucket.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabfeat.llm.text import WordHashes, by_batch, by_partition, lower_ascii, mixed, texts_of, window_hashes
from tabfeat.session import cut_lineage, scratch_path

SHINGLE = 5
HASHES = 128

#: Bands of the join: a pair of similarity 0.75 shares none with a chance of 1 in 2,000, one of 0.85 of 1 in 3 million.
BANDS, ROWS = 20, 4
SIMILARITY_PERCENT = 75

#: Share of equal minima under which a pair is not verified: five standard deviations below 0.75.
LEAST_AGREEMENT = 0.56

_random = np.random.default_rng(13)
_FACTOR = (_random.integers(0, 1 << 31, HASHES, np.uint64) * 2 + 1).astype(np.uint32)[:, None]
_SHIFT = _random.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)[:, None]
_NONE = np.full(HASHES, 0xFFFFFFFF, np.uint32)

_SPACE = b" \t\n\x0b\x0c\r"


def minima(shingles: np.ndarray, least: np.ndarray = _NONE) -> np.ndarray:
    """The least value of every permutation over the shingles, and over those that ``least`` stands for."""
    x, least = (shingles >> np.uint64(32)).astype(np.uint32), least.copy()
    for i in range(0, len(x), 512):
        np.minimum(least, (_FACTOR * x[i:i + 512] + _SHIFT).min(axis=1), out=least)
    return least


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all windows of five words; of fewer words, the whole sequence; of none, nothing."""
    return window_hashes(hashes, min(SHINGLE, len(hashes))) if len(hashes) else np.empty(0, np.uint64)


def two_signatures(text: bytes, edited: bytes, shared: int, words: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of two texts that agree in their first ``shared`` bytes, whose shingles are hashed once, and the first one's shingles."""
    text, edited = lower_ascii(text), lower_ascii(edited)
    cut = max(text.rfind(s, 0, shared) for s in (_SPACE[i:i + 1] for i in range(len(_SPACE)))) + 1  # words before it are whole in both
    same, own, other = words.of(text[:cut].split()), words.of(text[cut:].split()), words.of(edited[cut:].split())
    if len(same) < SHINGLE:
        whole = shingles(np.concatenate([same, own]))
        return minima(whole), minima(shingles(np.concatenate([same, other]))), whole
    first, tail = shingles(same), same[1 - SHINGLE:]
    rest, changed = (window_hashes(np.concatenate([tail, x]), SHINGLE) for x in (own, other))
    least = minima(first)
    return minima(rest, least), minima(changed, least), np.concatenate([first, rest])


def packed(signature: np.ndarray) -> bytes:
    return signature.astype(">u2").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal minima of two packed signatures; texts without words are like each other alone."""
    none = packed(_NONE)
    if none in (a, b):
        return float(a == b)
    return float((np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)).mean())


class _Reader:
    """Fingerprints of one text and the text that is edited with the next."""

    def __init__(self):
        self.words = WordHashes()

    def compare(self, text: str, following: str) -> dict:
        quarter = len(text) // 4
        kept = text[:len(text) - quarter]
        edited = (kept + following[:quarter]).encode()
        own, other, whole = two_signatures(text.encode(), edited, len(kept.encode()), self.words)
        return {"n_chars": len(text), "edited_sha256": sha256(edited).hexdigest(), "signature": packed(own), "edited": packed(other),
                "near_edited": likeness(packed(own), packed(other)), "digest": xxhash.xxh3_128_digest(np.unique(whole).tobytes()) if len(whole) else None}

    def alone(self, text: str) -> bytes:
        return self.compare(text, "")["signature"]


_PAIR = "doc_id long, n_chars long, edited_sha256 string, signature binary, edited binary, near_edited double, near_next double, digest binary"
_NAMES = [c.split()[0] for c in _PAIR.split(", ")]

#: What a row of the first pass is: a whole result, or the last or first text of a range.
_WHOLE, _LAST, _FIRST = 0, 1, 2


def _sorted_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text by ranges, nulls first; rows that share a doc_id by a hash of their texts, equal rows in any order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_tie"), F.monotonically_increasing_id().alias("_row"))
    by = [F.col("doc_id").asc_nulls_first(), F.col("_tie"), F.col("_row")]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text", F.spark_partition_id().alias("_part"))


def _put(out: dict[str, list], **values) -> None:
    for name, column in out.items():
        column.append(values.get(name))


def _first_pass(docs: DataFrame) -> DataFrame:
    """The results of all texts whose next one is in the same range, and the first and last text of every range."""
    names = [*_NAMES, "kind", "part", "text"]

    def run(batches):
        reader, before, waiting = _Reader(), None, None
        for batch in batches:
            out = {name: [] for name in names}
            for doc_id, text, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_part")), strict=True):
                if before is None:
                    _put(out, kind=_FIRST, part=part, text=text)
                else:
                    found = {"doc_id": before[0], **reader.compare(before[1], text)}
                    if waiting:
                        _put(out, **waiting, near_next=likeness(waiting["signature"], found["signature"]), kind=_WHOLE, part=part)
                    waiting = found
                before = doc_id, text
            yield out
        if before:
            out = {name: [] for name in names}
            if waiting:
                _put(out, **waiting, near_next=likeness(waiting["signature"], reader.alone(before[1])), kind=_WHOLE, part=part)
            _put(out, doc_id=before[0], kind=_LAST, part=part, text=before[1])
            yield out

    return by_partition(_sorted_texts(docs), f"{_PAIR}, kind int, part int, text string", run)


def _over_borders(passed: DataFrame) -> DataFrame:
    """The results of the last texts of the ranges: each meets the first of the next range that has rows, the very last the first of all."""
    first = passed.where(F.col("kind") == _FIRST)
    one_row_a_range = Window.orderBy("part")
    following = F.coalesce(F.lead("part").over(one_row_a_range), F.min("part").over(Window.partitionBy()))
    ranges = first.select("part").select("part", following.alias("_next"))
    last = passed.where(F.col("kind") == _LAST).select("part", "doc_id", "text")
    met = last.join(ranges, "part").join(first.select(F.col("part").alias("_next"), F.col("text").alias("following")), "_next")

    def run(batch):
        reader, out = _Reader(), {name: [] for name in _NAMES}
        for doc_id, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True):
            found = reader.compare(text, following)
            _put(out, doc_id=doc_id, **found, near_next=likeness(found["signature"], reader.alone(following)))
        return out

    return by_batch(met.select("doc_id", "text", "following"), _PAIR, run)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, signature, edited (the edited text's signature), near_edited, near_next and digest
    (of the shingle set, null without words) of every row, written to the shared folder.

    The edited text has its last quarter of code points (rounded down) replaced by the first as many, or all, of the next
    text by ascending doc_id; after the last comes the first, and a single row follows itself. Rows without a doc_id come
    first; rows that share one stand in the order of a hash of their texts. A null text is empty; texts without words are
    like each other alone. Shingles are windows of five words in lower case (A-Z), or all words if there are fewer. An
    empty table gives none. Other columns are not read.
    """
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "fingerprints")
    _first_pass(docs).write.parquet(f"{path}/ranges")
    passed = spark.read.parquet(f"{path}/ranges")
    _over_borders(passed).write.parquet(f"{path}/borders")
    return passed.where(F.col("kind") == _WHOLE).select(_NAMES).unionByName(spark.read.parquet(f"{path}/borders").select(_NAMES))


def as_text(signature: str) -> Column:
    """A signature column as lower-case hex."""
    return F.lower(F.hex(signature))


# ---- bands -----------------------------------------------------------------------------------


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of minima."""
    rows = signatures[:, :BANDS * ROWS].reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(signatures), BANDS))
    for i in range(ROWS):
        key = mixed((key << np.uint64(16)) + key + rows[:, :, i] + np.uint64(1))
    return key.view(np.int64)


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, HASHES)


def _bands(classes: DataFrame) -> DataFrame:
    def run(batch):
        keys = band_keys(_signatures(batch.column("signature")))
        return {"band": keys.reshape(-1), "node": np.repeat(batch.column("node").to_numpy(zero_copy_only=False), BANDS)}

    return by_batch(classes, "band long, node long", run)


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs head, node whose full shingle sets have the similarity asked for; texts are compared as sets of hashed shingles."""
    nodes = pairs.select(F.col("head").alias("node")).unionByName(pairs.select("node")).distinct()
    reader = WordHashes()

    def sets(batch):
        return {"node": batch.column("node").to_pylist(),
                "set": [np.unique(shingles(reader.of(lower_ascii(t).split()))).tobytes() for t in batch.column("text").to_pylist()]}

    chosen = docs.select(F.col("doc_id").alias("node"), "text").join(nodes, "node", "left_semi")
    hashed = by_batch(texts_of(chosen, "node"), "node long, set binary", sets).groupBy("node").agg(F.min("set").alias("set"))
    joined = pairs.join(hashed.withColumnRenamed("set", "_b"), "node").join(hashed.select(F.col("node").alias("head"), F.col("set").alias("_a")), "head")

    def compare(batch):
        good = []
        for a, b in zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist(), strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            good.append(100 * common >= SIMILARITY_PERCENT * (len(a) + len(b) - common))
        return {c: batch.column(c).to_numpy(zero_copy_only=False)[good] for c in ("head", "node")}

    return by_batch(joined.select("head", "node", "_a", "_b"), "head long, node long", compare)


def band_heads(prints: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and head of every row of ``prints``: the smallest doc_id that heads a bucket of it, or its class, and has a
    Jaccard similarity of 0.75 or more, itself included.

    Texts with equal sets are one class, headed by its smallest doc_id. Rows without words or doc_id head themselves.
    This is a lookup of heads, not a clustering: two texts whose buckets have other heads may be similar all the same.
    """
    named = prints.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = cut_lineage(named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature")))
    bands = _bands(classes.select("node", "signature"))
    heads = bands.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("_last")).where("head < _last").drop("_last")
    pairs = bands.join(heads, "band").where("head < node").select("head", "node").distinct()
    sides = pairs.join(classes.select("node", "signature"), "node").join(classes.select(F.col("node").alias("head"), F.col("signature").alias("_head")), "head")

    def agree(batch):
        good = (_signatures(batch.column("_head")) == _signatures(batch.column("signature"))).mean(axis=1) >= LEAST_AGREEMENT
        return {c: batch.column(c).to_numpy(zero_copy_only=False)[good] for c in ("head", "node")}

    likely = cut_lineage(by_batch(sides.select("head", "node", "_head", "signature"), "head long, node long", agree))
    best = _verified(likely, docs).groupBy("node").agg(F.min("head").alias("head"))
    placed = prints.select("doc_id", "digest").join(classes.select("digest", "node"), "digest", "left").join(best, "node", "left")
    return placed.select("doc_id", F.coalesce("head", "node", "doc_id").alias("head"))
