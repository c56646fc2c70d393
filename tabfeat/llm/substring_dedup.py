"""Suffix-array dedup: bytes under a 50-byte string that also starts in a document with a smaller doc_id.

The suffixes of all texts are dealt out by content: a 50-byte string belongs to the bucket of the smallest hash among its
12-byte parts, so equal strings meet wherever they stand, and neighbouring strings with the same smallest part travel as
one stretch of text. A task drops the stretches that repeat one of an earlier document of its batch and sends the rest.

A bucket is an index of the logarithmic family. Its stretches come in order of documents and in batches; a batch gets its
suffix array (cut at 50 bytes and ordered by their fingerprints, as only equality matters beyond them), which is scanned
against the levels for strings of earlier documents; what is new becomes a level, and levels of like size are merged, so a
string is moved a logarithmic number of times. The number of buckets grows with the bytes of the table.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfeat.llm.text import by_batch, by_partition, mixed, texts_of
from tabfeat.session import scratch_path

#: Bytes of a removed string, and of the parts that choose its bucket.
LENGTH, PART = 50, 12

#: Bytes of the table behind a bucket, and suffixes in a batch of a bucket's index.
BUCKET_BYTES, BATCH_SUFFIXES = 6 << 20, 1 << 18

#: Longer texts are cut here, with LENGTH - 1 bytes in both parts.
CUT = 1 << 20

_random = np.random.default_rng(1)
_TABLES = _random.integers(0, 1 << 63, (2, 256), np.uint64)
_FACTORS = [int(x) | 1 for x in _random.integers(1 << 40, 1 << 62, 2, np.uint64)]


class Powers:
    """Powers of an odd factor and of its inverse modulo 2^64."""

    _known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if which not in cls._known or len(cls._known[which][0]) < n:
            size = max(n, 1 << 16)
            factor = np.full(size, _FACTORS[which], np.uint64)
            inverse = np.full(size, pow(_FACTORS[which], -1, 1 << 64), np.uint64)
            factor[0] = inverse[0] = 1
            cls._known[which] = np.multiply.accumulate(factor), np.multiply.accumulate(inverse)
        return tuple(x[:n] for x in cls._known[which])


class Prints:
    """Fingerprints of the substrings of some bytes."""

    def __init__(self, data: np.ndarray, which: int):
        powers, self.inverse = Powers.of(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * powers[:-1], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        """Of every substring of that length."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:-length]) * self.inverse[:n])

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def stretches(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, first byte, end and fingerprint of each stretch of at least LENGTH bytes."""
    if len(data) < LENGTH:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(2)), np.empty(0, np.uint64))
    prints = Prints(data, 0)
    least = sliding_least(prints.all(PART), LENGTH - PART + 1)
    starts = np.flatnonzero(np.diff(least, prepend=~least[:1]))
    ends = np.append(starts[1:], len(least)) - 1 + LENGTH
    return least[starts], starts, ends, prints.at(starts, ends)


_SENT = "bucket int, stage int, batch long, docs binary, digests binary, place binary, size binary, key binary, text binary"
_COLUMNS = [c.split()[0] for c in _SENT.split(", ")]


def _row(**values) -> dict[str, list]:
    return {c: [values.get(c)] for c in _COLUMNS}


def _squeezed(values: np.ndarray) -> bytes:
    """Integers compressed byte by byte of their width: the high ones are mostly alike."""
    planes = values.view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _loose(blob: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(width, -1).T.copy().view(kind).reshape(-1)


def _places(doc: np.ndarray, start: np.ndarray) -> bytes:
    """Numbers of documents and offsets in them, as steps from one to the next."""
    return _squeezed(np.diff(doc.astype("<i8") << 32 | start.astype("<i8"), prepend=0))


def _from_places(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.cumsum(_loose(blob, "<i8"))
    return both >> 32, both & 0xFFFFFFFF


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each run of equal values starts and ends."""
    cuts = np.flatnonzero(np.diff(values, prepend=-1)) if len(values) else values
    yield from zip(cuts.tolist(), [*cuts[1:].tolist(), len(values)] if len(values) else [], strict=True)


def text_digest(text: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) >> 1


def pack_batch(ids: list[int], texts: list[bytes], batch: int, buckets: int) -> Iterator[dict[str, list]]:
    """What a batch of documents sends: its own findings (stage 2), and for each bucket the stretches it has not seen before (stage 1)."""
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    ids_, texts = np.array(ids, np.int64)[order], [texts[i] for i in order]
    found = []
    for i, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        for at in range(0, max(len(data) - LENGTH + 1, 0), CUT):
            key, start, end, mark = stretches(data[at:at + CUT + LENGTH - 1])
            found.append((key, np.full(len(key), i, np.int32), start + at, end + at, mark))
    key, doc, start, end, mark = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 5
    _, first, again = np.unique(mark, return_index=True, return_inverse=True)
    first = first[again]
    send = np.ones(len(key), bool)
    for k in np.flatnonzero(ids_[doc] > ids_[doc[first]]) if len(key) else []:
        r = first[k]
        send[k] = texts[doc[k]][start[k]:end[k]] != texts[doc[r]][start[r]:end[r]]
    digests = np.array([text_digest(t) for t in texts], np.int64)
    yield _row(bucket=batch % buckets, stage=2, batch=batch, docs=_squeezed(ids_), digests=_squeezed(digests),
               place=_places(doc[~send], start[~send]), size=_squeezed((end - start)[~send].astype("<i4")))
    bucket = (mixed(key.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    send = np.flatnonzero(send)
    send = send[np.argsort(bucket[send], kind="stable")]
    for a, b in runs(bucket[send]):
        own = send[a:b]
        stretch = b"".join([texts[i][s:e] for i, s, e in zip(doc[own].tolist(), start[own].tolist(), end[own].tolist(), strict=True)])
        yield _row(bucket=int(bucket[own[0]]), stage=1, batch=batch, docs=_squeezed(ids_), place=_places(doc[own], start[own]),
                   size=_squeezed((end - start)[own].astype("<i4")), key=key[own].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3].tobytes(),
                   text=zstandard.ZstdCompressor(level=6).compress(stretch))


class LogIndex:
    """Levels of sorted suffix fingerprints with the first document of each; sizes fall by half at least."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which suffixes (fingerprints ``one`` and ``two``, in order of ``doc``) are in an earlier document; then they are indexed."""
        order = np.argsort(one, kind="stable")
        head = np.flatnonzero(np.diff(one[order], prepend=~one[order[:1]]))
        first = order[head]
        group = np.empty(len(one), np.int64)
        group[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(one))))
        key, check, owner = one[first], two[first], doc[first].copy()
        new = np.ones(len(key), bool)
        for k, c, d in self.levels:
            at = np.searchsorted(k, key)
            at[at == len(k)] = 0
            hit = (k[at] == key) & (c[at] == check)
            owner[hit] = d[at[hit]]
            new &= ~hit
        matched = (owner[group] < doc) & (check[group] == two)
        if new.any():
            self.levels.append((key[new], check[new], owner[new]))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            a, b = self.levels.pop(), self.levels.pop()
            merged = [np.concatenate(x) for x in zip(b, a, strict=True)]
            order = np.argsort(merged[0], kind="stable")
            self.levels.append(tuple(x[order] for x in merged))
        return matched


def search_bucket(rows: list[dict]) -> Iterator[dict[str, list]]:
    """Stage 1 rows of a bucket as the spans of each batch's documents that repeat an earlier one."""
    parts, data = [], []
    for r, row in enumerate(rows):
        (doc, start), size = _from_places(row["place"]), _loose(row["size"], "<i4")
        key = np.frombuffer(row["key"], np.uint8).reshape(-1, 3).astype(np.int64) @ np.array([1, 1 << 8, 1 << 16])
        parts.append((np.full(len(doc), r), doc, _loose(row["docs"], "<i8")[doc], start, size, key))
        data.append(np.frombuffer(zstandard.decompress(row["text"]), np.uint8))
    which, doc, owner, start, size, key = (np.concatenate(x) for x in zip(*parts, strict=True))
    data = np.concatenate(data)
    offset = np.cumsum(size) - size
    # Only stretches whose key (three bytes of it) stands in two documents can repeat anything.
    distinct, group = np.unique(key, return_inverse=True)
    low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(low, group, owner)
    np.maximum.at(high, group, owner)
    use = np.flatnonzero((low < high)[group])
    use = use[np.argsort(owner[use], kind="stable")]
    index, out = LogIndex(), defaultdict(list)
    batch = np.cumsum(size[use]) // BATCH_SUFFIXES
    for own in np.split(use, np.flatnonzero(np.diff(batch)) + 1) if len(use) else []:
        places = np.cumsum(size[own]) - size[own]
        text = data[np.repeat(offset[own] - places, size[own]) + np.arange(size[own].sum())]
        valid = np.ones(len(text), bool)
        valid[(places + size[own])[:, None] - np.arange(1, LENGTH)] = False
        at = np.flatnonzero(valid)
        one, two = (Prints(text, i).all(LENGTH)[at] for i in (0, 1))
        found = at[index.add(one, two, np.repeat(owner[own], size[own] - LENGTH + 1))]
        if len(found):
            head = np.flatnonzero(np.diff(found, prepend=-2) > 1)
            begin, stop = found[head], found[np.append(head[1:], len(found)) - 1] + LENGTH
            e = np.searchsorted(places, begin, side="right") - 1
            out["which"].append(which[own[e]])
            out["doc"].append(doc[own[e]])
            out["start"].append(start[own[e]] + begin - places[e])
            out["size"].append(stop - begin)
    if out:
        cols = {c: np.concatenate(v) for c, v in out.items()}
        for r in np.unique(cols["which"]):
            mine = cols["which"] == r
            yield _row(bucket=rows[r]["bucket"], stage=1, batch=rows[r]["batch"], place=_places(cols["doc"][mine], cols["start"][mine]),
                       size=_squeezed(cols["size"][mine].astype("<i4")))


def united(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans as maximal runs."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    head = np.flatnonzero(np.append(True, start[1:] > end[:-1])) if len(start) else np.empty(0, np.int64)
    return start[head], end[np.append(head[1:], len(start)) - 1] if len(start) else end


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, and the starts and ends of its repeated runs, for documents that have any."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(total // BUCKET_BYTES + 1)

    def pack(batches):
        for count, batch in enumerate(batches):
            yield from pack_batch(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(),
                                  batch.column("_part")[0].as_py() << 32 | count, buckets)

    def search(batches):
        rows, now = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != now:
                    if rows:
                        yield from search_bucket(rows)
                    rows, now = [], row["bucket"]
                if row["stage"] == 2:
                    yield _row(**row)
                else:
                    rows.append(row)
        if rows:
            yield from search_bucket(rows)

    def gather(batches):
        parts = []
        for batch in batches:
            for row in batch.to_pylist():
                parts.append((*_from_places(row["place"]), _loose(row["size"], "<i4")))
                if row["stage"] == 1:
                    continue
                doc, start, size = (np.concatenate(x) for x in zip(*parts, strict=True))
                ids, digests = _loose(row["docs"], "<i8"), _loose(row["digests"], "<i8")
                order = np.argsort(doc, kind="stable")
                doc, start, size = doc[order], start[order], size[order]
                out = {"doc_id": [], "digest": [], "starts": [], "ends": []}
                for a, b in runs(doc):
                    begin, stop = united(start[a:b], start[a:b] + size[a:b])
                    for c, v in zip(out, (ids[doc[a]], digests[doc[a]], begin, stop), strict=True):
                        out[c].append(v)
                parts = []
                yield out

    rows = texts_of(docs.where(F.col("doc_id").isNotNull()), "doc_id", F.spark_partition_id().cast("long").alias("_part"))
    sent = by_partition(rows, _SENT, pack).repartition("bucket").sortWithinPartitions("bucket")
    answered = by_partition(sent, _SENT, search).repartition("batch").sortWithinPartitions("batch", "stage")
    return by_partition(answered, "doc_id long, digest long, starts array<long>, ends array<long>", gather)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed ``starts`` and ``ends`` (bytes) of every row.

    A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id, judged on the input. Null
    texts count as empty; texts under 50 bytes lose nothing; rows that share a doc_id do not remove from each other; rows
    without a doc_id lose nothing and take nothing; an empty table gives none. Columns other than doc_id and text are not
    read.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "substring-dedup")
    repeated_spans(docs).write.parquet(path)
    spans = spark.read.parquet(path).groupBy("doc_id", "digest").agg(F.first("starts").alias("starts"), F.first("ends").alias("ends"))

    def squeeze(batch):
        pack = zstandard.ZstdCompressor(level=3)
        texts = batch.column("text").to_pylist()
        return {"doc_id": batch.column("doc_id").to_pylist(), "digest": [text_digest(t) for t in texts], "text": [pack.compress(t) for t in texts]}

    def cut(batch):
        out = defaultdict(list)
        for row in batch.to_pylist():
            text, starts, ends = zstandard.decompress(row["text"]), row["starts"] or [], row["ends"] or []
            kept = b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True))
            for c, v in zip(_RESULT, (row["doc_id"], len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), starts, ends), strict=True):
                out[c].append(v)
        return {c: out[c] for c in _RESULT}

    texts = by_batch(texts_of(docs, "doc_id"), "doc_id long, digest long, text binary", squeeze)
    return by_batch(texts.join(spans, ["doc_id", "digest"], "left"), _RESULT_SCHEMA, cut)


_RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
_RESULT = [c.split()[0] for c in _RESULT_SCHEMA.split(", ")]
