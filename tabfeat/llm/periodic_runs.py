"""Periodic runs of words: multi-scale minimizers seed the long periods, direct lag scans find the short ones.

A run is a stretch of words with smallest period q and at least max(6, 4 q) words that no neighbour extends. Periods up to
8 are found by comparing the words with themselves q further on. Every further scale looks for periods in (P, 2P]: all
2P-word hashes are made from those of half the length, and the least hash of each window of P is kept. Within a run such
windows see the same hashes a period apart, and no 2P-word hash recurs earlier, so two neighbouring equal minima at distance
q seed it; the seed is then extended on the words themselves. All texts of a piece of a batch are scanned as one array, with
a mark of its own behind every text, which no stretch can cross.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tabfeat.llm.text import by_partition, mixed, texts_of

LEAST_WORDS, LEAST_PERIODS = 6, 4

#: Periods up to this one are scanned directly; the scales double from here.
SHORT_PERIOD = 8

#: Bytes of text whose words are scanned together; a longer text is scanned by itself.
PIECE_BYTES = 2 << 20

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def least_length(period: int) -> int:
    return max(LEAST_WORDS, LEAST_PERIODS * period)


def _by_lag(ids: np.ndarray, period: int) -> Iterator[tuple[int, int, int]]:
    """All maximal stretches with that period, by one comparison of the whole array."""
    if len(ids) <= period:
        return
    equal = np.zeros(len(ids) - period + 2, np.int8)
    equal[1:-1] = ids[:-period] == ids[period:]
    edges = np.flatnonzero(np.diff(equal))
    first, lengths = edges[::2], edges[1::2] - edges[::2] + period
    long = lengths >= least_length(period)
    yield from zip(first[long].tolist(), lengths[long].tolist(), [period] * int(long.sum()))


def _ahead(values: np.ndarray, by: int, fill) -> np.ndarray:
    """The values ``by`` places further on, with ``fill`` behind the last."""
    out = np.full(len(values), fill, values.dtype)
    out[:-by] = values[by:]
    return out


def _doubled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of twice as many words from those of ``size``; stretches that leave the array get hashes of their own."""
    out = mixed(hashes * _FACTOR + _ahead(hashes, size, 0))
    tail = min(size, len(out))
    out[len(out) - tail:] = mixed(out[len(out) - tail:] + np.arange(1, tail + 1, dtype=np.uint64) * _FACTOR)
    return out


def minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """The places whose hash is the least of some window (a power of two) that holds them."""
    least, size = hashes, 1
    while size < window:
        least = np.minimum(least, _ahead(least, size, np.uint64(0xFFFFFFFFFFFFFFFF)) if size < len(least) else least)
        size *= 2
    most, size = least, 1
    while size < window and size < len(most):
        behind = most.copy()
        behind[size:] = most[:-size]
        most, size = np.maximum(most, behind), size * 2
    return np.flatnonzero(most == hashes)


def _seeds(hashes: np.ndarray, place: np.ndarray, scale: int) -> np.ndarray:
    """(period, place) of neighbouring equal minimizers at a distance of that scale, sorted."""
    chosen = minimizers(hashes, scale)
    order = np.argsort(hashes[chosen], kind="stable")
    own, at = hashes[chosen][order], place[chosen][order]
    gap = at[1:] - at[:-1]
    good = (own[1:] == own[:-1]) & (gap > scale) & (gap <= 2 * scale)
    pairs = np.column_stack([gap[good], at[:-1][good]])
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values agree; looks at twice as many each time."""
    at, step = 0, 32
    while at < len(a):
        differ = np.flatnonzero(a[at:at + step] != b[at:at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return len(a)


def _extended(ids: np.ndarray, seeds: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The maximal stretches of the seeds' periods, each once."""
    before, done = 0, 0
    for period, at in seeds.tolist():
        if period == before and at < done:
            continue
        ahead = _reach(ids[at:len(ids) - period], ids[at + period:])
        back = _reach(ids[:at][::-1], ids[period:at + period][::-1])
        before, done = period, at + max(ahead, 1)
        if ahead + back + period >= least_length(period):
            yield at - back, ahead + back + period, period


def find_runs(ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in an array of texts; ``ends`` has the place of each text's mark, which occurs once."""
    stretches: list[tuple[int, int, int]] = []
    sizes = np.diff(ends, prepend=-1) - 1
    longest = int(sizes.max(initial=0))
    for period in range(1, min(SHORT_PERIOD, longest // LEAST_PERIODS) + 1):
        stretches += _by_lag(ids, period)
    place, size, scale = np.arange(len(ids)), 1, SHORT_PERIOD
    owner, hashes = np.repeat(np.arange(len(ends)), sizes + 1), mixed((ids.astype(np.int64) + 1).view(np.uint64) * _FACTOR)
    while LEAST_PERIODS * (scale + 1) <= longest:
        inside = sizes[owner] >= LEAST_PERIODS * (scale + 1)
        place, owner, hashes = place[inside], owner[inside], hashes[inside]
        while size < 2 * scale:
            hashes, size = _doubled(hashes, size), 2 * size
        stretches += _extended(ids, _seeds(hashes, place, scale))
        scale *= 2
    smallest: dict[tuple[int, int], int] = {}  # a stretch of several periods is a run of the smallest
    for start, length, period in stretches:
        smallest[start, length] = min(period, smallest.get((start, length), period))
    return sorted((start, length, period) for (start, length), period in smallest.items())


def implanted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail where 10 divides the crc32 of doc_id in decimal."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + period] * (-(-(n - a) // period)))[:n - a]


def _most_periodic(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The greatest length / period, compared exactly; ties go to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    if runs:
        change = np.zeros(len(words) + 1, np.int32)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


_SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
           "collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>")


def _reports(ids: list, texts: list[bytes], implant: bool) -> dict[str, list]:
    out: dict[str, list] = {name: [] for name in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs")}
    known: dict[bytes, int] = {}
    documents = [implanted(t.split(), d) if implant else t.split() for d, t in zip(ids, texts, strict=True)]
    ends = np.cumsum([len(w) + 1 for w in documents]) - 1
    coded = np.empty(int(ends[-1]) + 1 if len(ends) else 0, np.int32)
    for k, (words, end) in enumerate(zip(documents, ends.tolist())):
        coded[end - len(words):end] = [known.setdefault(w, len(known)) for w in words]
        coded[end] = -2 - k
    found = find_runs(coded, ends)
    owner = np.searchsorted(ends, [r[0] for r in found]).tolist()
    own: list[list] = [[] for _ in documents]
    for (start, length, period), k in zip(found, owner):
        own[k].append((start - int(ends[k]) + len(documents[k]), length, period))
    for doc_id, words, runs in zip(ids, documents, own):
        best = _most_periodic(runs)
        out["doc_id"].append(doc_id)
        out["n_runs"].append(len(runs))
        for name, value in zip(("start", "length", "period", "exponent_milli"), (*best, 1000 * best[1] // best[2]) if best else (None,) * 4):
            out[name].append(value)
        out["runs_sha256"].append(sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest())
        out["collapsed_sha256"].append(sha256(_collapsed(words, runs)).hexdigest())
        out["runs"].append([{"start": s, "length": n, "period": p} for s, n, p in runs])
    return out


def _in_pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch cut by rows so that a piece has few bytes of text."""
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // PIECE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def periodic_runs(docs: DataFrame, implant: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the most periodic run, digests of the list of runs and of
    the collapsed text, and all ``runs``, of every row.

    ``implant`` gives a tenth of the documents (by crc32 of doc_id) a periodic tail first; rows without a doc_id get none.
    Null texts have no words; a text without a run has four nulls. Rows that share a doc_id are judged by themselves. An
    empty table gives none. Other columns are not read. One pass over the texts, no shuffle; a text is held whole.
    """
    def run(batches):
        for batch in batches:
            for piece in _in_pieces(batch):
                yield _reports(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), implant)

    return by_partition(texts_of(docs, "doc_id"), _SCHEMA, run)
