"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items, one scan of each text.

The automaton is broadcast. Its size is bounded: the benchmark is measured first, and a benchmark above the bound is cut
into shards of bounded size, one automaton and one scan each. The texts then get a row key first, by which the words that
the shards hit are united, so every size gives the same rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfeat.llm.text import by_batch, bytes_of, keep_rows, numbered, texts_of

#: Words in a window; an item of fewer words is one window.
WINDOW = 10

#: Bytes of benchmark text behind one automaton, which takes some hundred times as much memory at most.
SHARD_BYTES = 2 << 20

_SEPARATORS = {*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
_NORMAL = bytes(32 if c in _SEPARATORS else c + 32 if 65 <= c <= 90 else c for c in range(256))


def normal_words(text: bytes) -> list[bytes]:
    """A-Z in lower case; words are runs of letters, digits and everything beyond ASCII."""
    return text.translate(_NORMAL).split()


def word_offsets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each normalised word starts and ends in the bytes of the original text."""
    inside = np.frombuffer(text.translate(_NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edges[::2], edges[1::2]


def windows_of(items: list[tuple[str | None, bytes]], size: int = WINDOW) -> dict[str, tuple[int, tuple[str, ...]]]:
    """Each window (with a space at either end), its number of words and the items that have it."""
    owners: dict[str, set[str]] = defaultdict(set)
    lengths: dict[str, int] = {}
    for item, text in items:
        words = [w.decode("latin-1") for w in normal_words(text)]
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            window = f" {' '.join(words[i:i + n])} "
            owners[window].add("" if item is None else str(item))
            lengths[window] = n
    return {w: (lengths[w], tuple(sorted(owners[w]))) for w in owners}


def automaton_of(windows: dict[str, tuple[int, tuple[str, ...]]]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for window, value in windows.items():
        automaton.add_word(window, value)
    automaton.make_automaton()
    return automaton


class Shard:
    """Windows of some items; the automaton is built once in each worker."""

    _built: dict[str, ahocorasick.Automaton] = {}

    def __init__(self, name: str, windows: dict[str, tuple[int, tuple[str, ...]]]):
        self.name, self.windows = name, windows

    def automaton(self) -> ahocorasick.Automaton:
        if self.name not in Shard._built:
            if len(Shard._built) > 1:
                Shard._built.clear()
            Shard._built[self.name] = automaton_of(self.windows)
        return Shard._built[self.name]


def hits(text: bytes, automaton: ahocorasick.Automaton) -> tuple[int, np.ndarray, set[str]]:
    """Number of words, which of them are hit, and the items with a window in the text."""
    words = normal_words(text)
    joined = f" {b' '.join(words).decode('latin-1')} "
    found = list(automaton.iter(joined)) if len(automaton) and words else []
    covered = np.zeros(len(words) + 1, np.int64)
    items: set[str] = set()
    if found:
        spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
        stops = np.searchsorted(spaces, [end for end, _ in found])
        np.add.at(covered, stops, -1)
        np.add.at(covered, stops - [n for _, (n, _) in found], 1)
        for _, (_, owners) in found:
            items.update(owners)
    return len(words), np.cumsum(covered)[:-1] > 0, items


def _shards(benchmark: DataFrame, window: int) -> list[Shard]:
    """Items read shard by shard of at most about SHARD_BYTES; usually there is one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = total // SHARD_BYTES + 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    name = benchmark.sparkSession.sparkContext.applicationId
    out = []
    for k in range(count):
        rows = [(r.item, bytes(r.text)) for r in items.where(part == k).collect()]
        windows = windows_of(rows, window)
        out.append(Shard(f"{name}-{k}-{hashlib.md5(repr(sorted(windows.items())).encode()).hexdigest()}", windows))
    return out


SCHEMA = "doc_id long, n_words long, hit array<int>, items array<string>, span_starts array<long>, span_ends array<long>"

#: What one shard finds in a row: the words that are hit, and where each starts and ends.
_PART = "_row long, doc_id long, n_words long, hit array<int>, items array<string>, starts array<long>, ends array<long>"


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position in ``at`` of each run of adjacent words."""
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    return first, np.append(first[1:], len(at))[:len(first)] - 1


def _scan(docs: DataFrame, shard: Shard) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(shard)

    def run(batch):
        automaton = sent.value.automaton()
        out = defaultdict(list)
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            n, hit, items = hits(text, automaton)
            at = np.flatnonzero(hit)
            first, last = _runs(at)
            starts, ends = word_offsets(text) if len(at) else (at, at)
            for name, value in zip(_NAMES, (doc, n, at.astype(np.int32), sorted(items), starts[at[first]], ends[at[last]]), strict=True):
                out[name].append(value)
        return out

    return by_batch(texts_of(docs, "doc_id"), SCHEMA, run)


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_PARTS = [c.split()[0] for c in _PART.split(", ")]


def _scan_part(keyed: DataFrame, shard: Shard, every: bool) -> DataFrame:
    """Rows of a shard: all of them or those with a hit."""
    sent = keyed.sparkSession.sparkContext.broadcast(shard)

    def run(batch):
        automaton = sent.value.automaton()
        out = {name: [] for name in _PARTS}
        for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("_row", "doc_id", "text")), strict=True):
            n, hit, items = hits(text, automaton)
            at = np.flatnonzero(hit)
            if every or len(at):
                starts, ends = word_offsets(text) if len(at) else (at, at)
                for name, value in zip(_PARTS, (row, doc, n, at.astype(np.int32), sorted(items), starts[at], ends[at]), strict=True):
                    out[name].append(value)
        return out

    return by_batch(keyed, _PART, run)


def _scan_shards(docs: DataFrame, shards: list[Shard]) -> DataFrame:
    """Every row with what any shard finds in it, united by row key; the first shard gives all rows, the others hits."""
    keyed = numbered(texts_of(docs, "doc_id"), "decontamination").select("_row", "doc.*")
    parts = _scan_part(keyed, shards[0], True)
    for shard in shards[1:]:
        parts = parts.unionByName(_scan_part(keyed, shard, False))
    united = parts.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.collect_list(F.struct("hit", "items", "starts", "ends")).alias("_found")).select(
        "doc_id", "n_words", *[F.flatten(F.col("_found")[c]).alias(c) for c in ("hit", "items", "starts", "ends")])

    def run(batch):
        out = defaultdict(list)
        for row in batch.to_pylist():
            at, which = np.unique(np.array(row["hit"], np.int32), return_index=True)
            starts, ends = (np.array(row[c], np.int64)[which] for c in ("starts", "ends"))
            first, last = _runs(at)
            for name, value in zip(_NAMES, (row["doc_id"], row["n_words"], at, sorted(set(row["items"])), starts[first], ends[last]), strict=True):
                out[name].append(value)
        return out

    return by_batch(united, SCHEMA, run)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, items, and the hit spans in bytes of the original text.

    A document word inside any occurrence of a window of an item is hit. Null and empty texts have no words and are clean;
    items without words match nothing; repeated items and shared windows count each item_id once, a null item_id as an
    empty one. Every row is judged by itself, whatever its doc_id, with any number of shards. Other columns of either table
    are not read.
    """
    shards = _shards(benchmark, window)
    scanned = _scan(docs, shards[0]) if len(shards) == 1 else _scan_shards(docs, shards)
    n_hit = F.size("hit").cast("long")
    return scanned.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        "items", "span_starts", "span_ends")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a hit word, each judged by itself, with all their columns."""
    for shard in _shards(benchmark, window):
        sent = docs.sparkSession.sparkContext.broadcast(shard)

        def untouched(batch, sent=sent):
            automaton = sent.value.automaton()
            return [not hits(t, automaton)[2] for t in bytes_of(batch.column("text"))]

        docs = keep_rows(docs, untouched)
    return docs
