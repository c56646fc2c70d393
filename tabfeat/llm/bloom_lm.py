"""LM scoring with a log-frequency Bloom filter: quantised n-gram counts in one filter for each part of the key space.

An n-gram of count c is in the filter once for each level up to 1 + log_b(c); its count is read back by probing level after
level until one is missing. Counts are gathered over the whole corpus: every task counts its batches, packed rows of keys
and counts meet by key slice, and the filter of a slice is sized by what is in it, so n-grams of any count are stored
whatever the corpus. No place holds all filters: the distinct n-grams of a batch of texts meet them by key, and what is read
comes back to the batch.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfeat.llm.text import WordHashes, by_batch, by_partition, crc_mod5, lower_ascii, mixed, texts_of
from tabfeat.session import scratch_path

#: Bits of a filter for each of its entries, and bits set for an entry (false positives under 1 %).
ENTRY_BITS, PROBES = 12, 4

#: Counts are quantised to powers of this base.
BASE = 1.5

#: Largest weight of the bigram estimate, and the count of the first word at which it has half of it.
BIGRAM_WEIGHT, BIGRAM_HALF = 0.3, 50.0

_END = np.uint64(0x5EED0FE11D0C5E1D)
_PAIR = np.uint64(0x9E3779B97F4A7C15)

UNIGRAM, BIGRAM = 0, 1

#: Parts of the key space that counts travel in (top bits of a key). A pair's key has 32 bits more, a word's all 64.
SLICE_BITS = 12
_SPARE = 64 - SLICE_BITS - 32


def token_hashes(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words in lower case (A-Z), then of the end."""
    words = lower_ascii(text).split()
    return np.append(hashes.of(words), _END)


def bigram_hashes(tokens: np.ndarray) -> np.ndarray:
    """One for each token, with the token before it; the first has the end before it."""
    return mixed(np.concatenate([[_END], tokens[:-1]]) * _PAIR + tokens) >> np.uint64(_SPARE) << np.uint64(_SPARE)


def _short(pairs: np.ndarray) -> bytes:
    """Keys of pairs without the number of their slice."""
    return (pairs >> np.uint64(_SPARE)).astype("<u4").tobytes()


def _long(short: bytes, part: np.ndarray | int) -> np.ndarray:
    """The keys of pairs in a slice, or in the slice of each."""
    own = np.frombuffer(short, "<u4").astype(np.uint64)
    return np.asarray(part, np.uint64) << np.uint64(64 - SLICE_BITS) | own << np.uint64(_SPARE)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)))
    return key[first], np.add.reduceat(count, first) if len(first) else count


def level_of(counts: np.ndarray) -> np.ndarray:
    """Number of levels of each count: 1 for one occurrence."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


_LEVEL_COUNTS = np.array([0.0] + [max(1.0, (BASE ** (j - 1) + BASE**j) / 2) for j in range(1, 130)])

PACKED = "slice int, kind int, keys binary, counts binary"

#: A slice of the learned table: keys and counts of its words, and the filter of its words or pairs.
LEARNED = "slice int, kind int, tokens long, distinct long, keys binary, counts binary, bits binary"


def sliced(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The parts of sorted keys by their top bits."""
    top = (keys >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(top, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(keys)] if len(keys) else [], strict=True):
        yield int(top[a]), slice(a, b)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """Counts of all words and filters of all words and word pairs: one row for each slice and kind.

    A task counts its batches first; rows are dealt by slice, and a task merges what it has read of one slice whenever
    that has doubled, so it holds about the distinct keys of one slice.
    """
    hashes = WordHashes()

    def count(batch):
        tokens = [token_hashes(t, hashes) for t in batch.column("text").to_pylist()]
        out = defaultdict(list)
        for kind, keys in ((UNIGRAM, tokens), (BIGRAM, [bigram_hashes(t) for t in tokens])):
            if keys:
                key, number = np.unique(np.concatenate(keys), return_counts=True)
                for part, at in sliced(key, SLICE_BITS):
                    own = key[at].tobytes() if kind == UNIGRAM else _short(key[at])
                    for name, value in zip(_COLUMNS, (part, kind, own, number[at].astype("<i4").tobytes()), strict=True):
                        out[name].append(value)
        return {c: out[c] for c in _COLUMNS}

    def merge(batches):
        keys, counts, held, now = [], [], 0, None
        for batch in batches:
            for part, kind, k, c in zip(*(batch.column(x).to_pylist() for x in _COLUMNS), strict=True):
                if (part, kind) != now:
                    if keys:
                        yield _kept(now, *merged(keys, counts))
                    keys, counts, held, now = [], [], 0, (part, kind)
                keys.append(np.frombuffer(k, np.uint64) if kind == UNIGRAM else _long(k, part))
                counts.append(np.frombuffer(c, "<i4").astype(np.int64))
                held += len(keys[-1])
                if held > 2 * len(keys[0]) + 500_000:
                    key, number = merged(keys, counts)
                    keys, counts, held = [key], [number], len(key)
        if keys:
            yield _kept(now, *merged(keys, counts))

    dealt = by_batch(texts_of(docs), PACKED, count).repartition("slice", "kind").sortWithinPartitions("slice", "kind")
    return by_partition(dealt, LEARNED, merge)


_COLUMNS = ("slice", "kind", "keys", "counts")


def _kept(at: tuple[int, int], keys: np.ndarray, counts: np.ndarray) -> dict[str, list]:
    """A merged row; the filter is all that is kept of pairs."""
    words = at[1] == UNIGRAM
    return {"slice": [at[0]], "kind": [at[1]], "tokens": [int(counts.sum())], "distinct": [len(keys)],
            "keys": [keys.tobytes() if words else b""], "counts": [counts.astype("<i8").tobytes() if words else b""],
            "bits": [filter_bits(keys, counts)]}


def _level_hashes(keys: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    return mixed(keys + np.asarray(level, np.uint64) * np.array([0xC2B2AE3D27D4EB4F], np.uint64))


def _spot(hashes: np.ndarray, i: int, width: np.ndarray | int) -> np.ndarray:
    """Number of the i-th bit of each hash in a filter of that many bits."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return ((low + np.uint64(i) * high) % np.asarray(width, np.uint64)).astype(np.int64)


def filter_bits(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter of distinct keys with their counts: every count is stored, and the size follows from the levels."""
    levels = level_of(counts)
    entries = int(levels.sum())
    bits = np.zeros(max(64, ENTRY_BITS * entries // 8 * 8), bool)
    level = np.arange(entries) - np.repeat(np.cumsum(levels) - levels, levels) + 1
    hashes = _level_hashes(np.repeat(keys, levels), level)
    for i in range(PROBES):
        bits[_spot(hashes, i, len(bits))] = True
    return np.packbits(bits).tobytes()


class Filters:
    """The filters of successive slices side by side."""

    def __init__(self, first: int, blobs: list[bytes]):
        own = [blob or bytes(8) for blob in blobs]
        sizes = np.array([8 * len(blob) for blob in own], np.int64)
        self.first, self.width, self.start = first, sizes, np.cumsum(sizes) - sizes
        self.bits = np.frombuffer(b"".join(own), np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The last level of each key that is found, 0 if none; a key is dropped at its first bit that is not set."""
        found, left = np.zeros(len(keys), np.uint8), np.arange(len(keys))
        part = (keys >> np.uint64(64 - SLICE_BITS)).astype(np.int64) - self.first
        for level in range(1, len(_LEVEL_COUNTS) - 1):
            hashes = _level_hashes(keys[left], level)
            for i in range(PROBES):
                at = part[left]
                spot = self.start[at] + _spot(hashes, i, self.width[at])
                hit = (self.bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1).astype(bool)
                left, hashes = left[hit], hashes[hit]
            if not len(left):
                break
            found[left] = level
        return found


#: Bytes of filters and tokens of the corpus behind one slice of questions, about; at least so many bits of slices.
SLICE_BYTES, SLICE_TOKENS, LEAST_BITS = 8 << 20, 16 << 20, 6

#: Keys that are looked up at once.
ASKED_KEYS = 1 << 20


class LanguageModel:
    """The learned table, and the sums over it."""

    #: The smallest count that is stored.
    least = 1

    def __init__(self, table: DataFrame):
        self.table = table
        rows = table.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("tokens", "distinct")], F.sum(F.length("bits")).alias("size")).collect()
        totals = {r.kind: r for r in rows}
        self.tokens = totals[UNIGRAM].tokens if UNIGRAM in totals else 0
        self.vocabulary = totals[UNIGRAM].distinct if UNIGRAM in totals else 0
        self.size = sum(r["size"] for r in rows)
        parts = max(1.0, self.size / SLICE_BYTES, self.tokens / SLICE_TOKENS)
        self.bits = min(SLICE_BITS, max(LEAST_BITS, math.ceil(math.log2(parts))))

    def filter(self) -> FrequencyFilter:
        return FrequencyFilter(self)


class FrequencyFilter:
    """Quantised counts of given n-grams by membership probes, where the filters lie."""

    def __init__(self, model: LanguageModel):
        self.model = model

    def counts(self, keys: np.ndarray, kind: int = UNIGRAM) -> np.ndarray:
        """Count of each key: the middle of its last level found, 0 if it is not stored."""
        distinct, which = np.unique(keys, return_inverse=True)
        none = np.empty(0, np.uint64)
        asked = _questions(0, *((distinct, none) if kind == UNIGRAM else (none, distinct)), self.model.bits)
        rows = self.model.table.sparkSession.createDataFrame([tuple(v[0] for v in row.values()) for row in asked], _MIXED)
        found = sorted(_answered(rows, self.model).select("slice", "levels").collect())
        return _LEVEL_COUNTS[np.frombuffer(b"".join(r.levels for r in found), np.uint8)[which]]


def learn(docs: DataFrame, path: str) -> LanguageModel:
    """Count all n-grams of ``docs`` into a table under ``path``."""
    ngram_counts(docs).write.option("compression", "zstd").parquet(f"{path}/ngrams")
    return LanguageModel(docs.sparkSession.read.parquet(f"{path}/ngrams"))


#: Rows of the learned table (stage 0), n-grams of a batch in a slice and what is known of them (1), and its texts (2).
_MIXED = ("slice int, stage int, batch long, part int, kind int, keys binary, counts binary, levels binary, at binary, "
          "doc_id array<long>, n_tokens array<long>")
_RESULT = "doc_id long, n_tokens long, n_known long, logs double, score double"


def _row(**values) -> dict[str, list]:
    return {c.split()[0]: [values.get(c.split()[0])] for c in _MIXED.split(", ")}


def _questions(batch: int, words: np.ndarray, pairs: np.ndarray, bits: int) -> Iterator[dict[str, list]]:
    """Rows of stage 1 of sorted distinct words and pairs: one for each slice of the top ``bits``.

    ``keys`` has the words; ``at`` the pairs, without the numbers of their parts, and ``counts`` how many each part has.
    """
    borders = np.arange(1, 1 << SLICE_BITS, dtype=np.uint64) << np.uint64(64 - SLICE_BITS)
    parts, own = 1 << (SLICE_BITS - bits), [np.concatenate([[0], np.searchsorted(k, borders), [len(k)]]) for k in (words, pairs)]
    for i in range(1 << bits):
        (a, b), (c, d) = ((at[i * parts], at[(i + 1) * parts]) for at in own)
        if a < b or c < d:
            sizes = np.diff(own[1][i * parts:(i + 1) * parts + 1]).astype("<u4")
            yield _row(slice=i, stage=1, batch=batch, keys=words[a:b].tobytes(), at=_short(pairs[c:d]), counts=sizes.tobytes())


def _answered(asked: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows of stage 1 with the exact counts of their words and the levels of their words and pairs; others as they are."""
    parts = 1 << (SLICE_BITS - model.bits)

    def run(batches):
        now, learned, slice_, asked, held = None, [], None, [], 0

        def answers():
            first = asked[0]["slice"] * parts
            words, filters = slice_
            all_words = np.concatenate([np.frombuffer(row["keys"], np.uint64) for row in asked])
            all_pairs = np.concatenate([
                _long(row["at"], first + np.repeat(np.arange(parts), np.frombuffer(row["counts"], "<u4"))) for row in asked])
            at = np.minimum(np.searchsorted(words[0], all_words), max(len(words[0]) - 1, 0))
            counts = np.where(words[0][at] == all_words, words[1][at], 0) if len(words[0]) else np.zeros(len(all_words), np.int64)
            levels, i, j = [own.levels(k) for own, k in zip(filters, (all_words, all_pairs), strict=True)], 0, 0
            for row in asked:
                n, m = len(row["keys"]) // 8, len(row["at"]) // 4
                yield _row(slice=row["slice"], stage=1, batch=row["batch"], counts=counts[i:i + n].astype("<i8").tobytes(),
                           levels=levels[UNIGRAM][i:i + n].tobytes() + levels[BIGRAM][j:j + m].tobytes(), kind=n)
                i, j = i + n, j + m

        for batch in batches:
            for row in batch.to_pylist():
                if row["slice"] != now or held > ASKED_KEYS:
                    if asked:
                        yield from answers()
                    asked, held = [], 0
                if row["slice"] != now:
                    now, learned, slice_ = row["slice"], [], None
                if row["stage"] == 0:
                    learned.append(row)
                elif row["stage"] == 2:
                    yield _row(**row)
                else:
                    if slice_ is None:
                        learned.sort(key=lambda r: (r["kind"], r["part"]))
                        words = [np.concatenate([np.empty(0, t), *[np.frombuffer(r[c], t) for r in learned if r["kind"] == UNIGRAM]])
                                 for c, t in (("keys", np.uint64), ("counts", np.int64))]
                        blobs = {(r["kind"], r["part"]): r["levels"] for r in learned}
                        slice_ = words, [Filters(now * parts, [blobs.get((kind, now * parts + i)) for i in range(parts)]) for kind in (UNIGRAM, BIGRAM)]
                        learned = []
                    asked.append(row)
                    held += len(row["keys"]) // 8 + len(row["at"]) // 4
        if asked:
            yield from answers()

    table = model.table.select(F.shiftright("slice", SLICE_BITS - model.bits).alias("slice"), F.lit(0).alias("stage"),
                               F.col("slice").alias("part"), "kind", "keys", "counts", F.col("bits").alias("levels"))
    met = asked.unionByName(table, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", "stage")
    return by_partition(met, _MIXED, run)


def _ids_packed(ids: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _ids_unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def log10_probabilities(unigram: np.ndarray, pair: np.ndarray, tokens: int, vocabulary: int) -> np.ndarray:
    """Of each token of texts that follow each other, every one closed by its end, from its count and that of its pair.

    Words have add-half smoothing; pairs are interpolated by how often their first word was seen.
    """
    single = (unigram + 0.5) / (tokens + 0.5 * (vocabulary + 1))
    before = np.concatenate([unigram[-1:], unigram[:-1]])  # the last token is an end, as is what the first has before it
    weight = BIGRAM_WEIGHT * before / (before + BIGRAM_HALF)
    return np.log10((1 - weight) * single + weight * np.minimum(pair / np.maximum(before, 1), 1.0))


def scored(docs: DataFrame, training: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``, learned from ``training``.

    base_score is exact, score is the filter's: the distinct words and pairs of every batch meet counts and filters by key,
    as packed rows, and come back to the batch's texts. Null and empty texts are the end alone; with no training rows N and
    V are 0; repeated rows are scored each; an empty table gives none.
    """
    model = learn(training, path or scratch_path(docs.sparkSession, "bloom-lm"))
    bits, tokens_all, vocabulary = model.bits, model.tokens, model.vocabulary
    hashes = WordHashes()

    def pack(batches):
        """Rows of stages 1 and 2 of each batch; its words are numbered by how often it has them."""
        for count, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            name = batch.column("_part")[0].as_py() << 32 | count
            tokens = [token_hashes(t, hashes) for t in batch.column("text").to_pylist()]
            sizes = [len(t) for t in tokens]
            tokens = np.concatenate(tokens)
            words, which, times = np.unique(tokens, return_inverse=True, return_counts=True)
            yield from _questions(name, words, np.unique(bigram_hashes(tokens)), bits)
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            yield _row(slice=((name >> 32) * 31 + count) % (1 << bits), stage=2, batch=name, keys=words[order].tobytes(), at=_ids_packed(rank[which]),
                       doc_id=batch.column("doc_id").to_pylist(), n_tokens=sizes)

    def add(batches):
        """What is known of a batch's n-grams onto its texts, which come last."""
        counts, levels = [], ([], [])
        for batch in batches:
            for row in batch.to_pylist():
                if row["stage"] == 1:
                    counts.append(np.frombuffer(row["counts"], "<i8"))
                    own = np.frombuffer(row["levels"], np.uint8)
                    levels[UNIGRAM].append(own[:row["kind"]])
                    levels[BIGRAM].append(own[row["kind"]:])
                    continue
                words, ids = np.frombuffer(row["keys"], np.uint64), _ids_unpacked(row["at"])
                order = np.argsort(words)
                count, level = np.empty(len(words), np.int64), np.empty(len(words), np.uint8)
                count[order], level[order] = np.concatenate(counts), np.concatenate(levels[UNIGRAM])
                which = np.unique(bigram_hashes(words[ids]), return_inverse=True)[1]
                score = log10_probabilities(_LEVEL_COUNTS[level][ids], _LEVEL_COUNTS[np.concatenate(levels[BIGRAM])][which], tokens_all, vocabulary)
                starts = np.cumsum([0, *row["n_tokens"][:-1]])
                yield {"doc_id": row["doc_id"], "n_tokens": row["n_tokens"], "n_known": np.add.reduceat((count > 0).astype(np.int64)[ids], starts),
                       "logs": np.add.reduceat(np.log10(count + 0.5)[ids], starts), "score": np.add.reduceat(score, starts)}
                counts, levels = [], ([], [])

    packed = by_partition(texts_of(docs, "doc_id", F.spark_partition_id().cast("long").alias("_part")), _MIXED, pack)
    answered = _answered(packed, model).repartition("batch").sortWithinPartitions("batch", "stage", "slice")
    summed = by_partition(answered, _RESULT, add)
    base = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(model.tokens + 0.5 * (model.vocabulary + 1)))
    return summed.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows whose crc32(doc_id as text) mod 5 is not 1."""
    return docs.where(F.coalesce(crc_mod5("doc_id") != 1, F.lit(True)))
