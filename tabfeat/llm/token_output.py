"""Token-ID output: frequency-ranked ids in a byte-aligned variable-length code, control bytes apart from the data bytes.

A folder holds two tables. ``ranks`` maps the rank of a token id by frequency to the id. ``blocks`` has, in ascending
order of doc_id, groups of documents: their ids and numbers of tokens, the control bytes (two bits a token: its length
less one, four tokens a byte, each document padded to whole bytes) and the data bytes (1 to 4 a token, low byte first).
Frequent ids have low ranks and so take one byte. Decoding looks the lengths of four tokens up by their control byte.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabfeat.llm.text import by_batch, by_partition, lower_ascii, texts_of
from tabfeat.session import scratch_path

#: Tokens in a block, unless one document has more.
BLOCK_TOKENS = 1 << 16

#: Pieces, and words that the library encodes whole, whose ids a worker remembers; encoding one costs more than hashing it.
ENCODED_PIECES, ENCODED_WORDS = 400_000, 50_000

#: Bytes of text that are cut into pieces at a time, unless one word has more.
SLICE_BYTES = 2 << 20

#: Lengths of the four values of every control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1

#: Kinds of bytes. Words without odd ones, which are Latin letters that no normal form changes and printable ASCII without the
#: apostrophe, are cut into pieces here just as the tokenizer cuts them. Of two bytes, the first says if a letter is one of those
#: (0xC3), but for the signs of times and division.
SPACE, LETTER, DIGIT, SIGN, END, ODD = range(6)


def _kind(byte: int) -> int:
    if byte == 0x20 or 0x09 <= byte <= 0x0D:
        return SPACE
    if 0x30 <= byte <= 0x39:
        return DIGIT
    if 0x41 <= byte <= 0x5A or 0x61 <= byte <= 0x7A or 0x80 <= byte <= 0xBF or byte == 0xC3:
        return LETTER
    return SIGN if 0x21 <= byte <= 0x7E and byte != 0x27 else ODD


_KINDS = bytes(map(_kind, range(256)))


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one above 255."""
    table, spare = {}, 256
    for byte in range(256):
        if 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or 0xAE <= byte <= 0xFF:
            table[byte] = chr(byte)
        else:
            table[byte], spare = chr(spare), spare + 1
    return table


class Remembered(dict):
    """What a function says of each word, as long as a worker remembers it: the latest ``most`` distinct ones."""

    def __init__(self, fn, most: int):
        self.fn, self.most, self.older = fn, most, {}

    def __missing__(self, word):
        value = self.older.get(word)
        if value is None:
            value = self.fn(word)
        if 2 * len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value


class Encoder:
    """Token ids of texts; the library encodes a piece once for all its occurrences that a worker remembers.

    White space never joins or changes tokens of a lower-casing vocabulary with word ends, so a text's ids are those of
    its words. Pieces of plain words go to the library's model by themselves, which skips its work on offsets; all other
    words, and whole texts for a vocabulary of another kind, go through its complete encoding. Texts are cut in slices,
    all pieces of one at once, and each distinct piece of a slice is looked up once.
    """

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = id_type(self.tokenizer.get_vocab_size(with_added_tokens=True))
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.marks = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])).encode() or rb"(?!)")
        self.by_word = (spec.get("model") or {}).get("end_of_word_suffix") == "</w>"
        self.table = str.maketrans({chr(b): c for b, c in _byte_characters().items()})
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.pieces, self.words = Remembered(self._piece, ENCODED_PIECES), Remembered(self._whole, ENCODED_WORDS)

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode("ascii") if piece.isascii() else piece.decode("latin-1").translate(self.table)
        return array(self.code, [t.id for t in self.model.tokenize(text)]).tobytes()

    def _whole(self, text: bytes) -> bytes:
        return array(self.code, self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids).tobytes()

    def ids(self, texts: list[bytes], end_id: int) -> list[bytes]:
        """The ids of each text with the end id, as bytes."""
        end = np.array([end_id], self.dtype).tobytes()
        if not self.by_word:
            return [self._whole(t) + end for t in texts]
        data = b"\0".join([*texts, b""])  # a byte after each text stands for its end
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        found, stops, at, n = [], [], 0, 0
        while at < len(data):
            size, to = SLICE_BYTES, 0
            while not to:
                raw = data[at:at + size]
                own = ends[np.searchsorted(ends, at):np.searchsorted(ends, at + len(raw))] - at
                kinds = np.frombuffer(raw.translate(_KINDS), np.uint8).copy()
                kinds[own] = END
                cuts = np.flatnonzero((kinds == SPACE) | (kinds == END))
                to, size = (cuts[-1] + 1 if len(cuts) else 0), 2 * size
            ids, stop = self._slice(raw[:to], kinds[:to], cuts, end)
            found.append(ids)
            stops.append(stop + n)
            at, n = at + int(to), n + len(ids)
        blob = b"".join(x.tobytes() for x in found)
        stops = (np.concatenate([np.zeros(1, np.int64), *stops]) * self.dtype.itemsize).tolist()
        return [blob[i:j] for i, j in zip(stops, stops[1:])]

    def _slice(self, data: bytes, kinds: np.ndarray, cuts: np.ndarray, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole words and ends, and how many there are up to each end. ``cuts`` are the places between words."""
        data.decode("utf-8")  # raises where a text is none
        raw, lower = np.frombuffer(data, np.uint8), np.frombuffer(lower_ascii(data), np.uint8).copy()
        two = np.flatnonzero(raw == 0xC3)
        second = raw[two + 1]
        lower[two[second <= 0x9E] + 1] += 0x20
        kinds[two[(second == 0x97) | (second == 0xB7)]] = ODD
        for mark in self.marks.finditer(data):
            kinds[mark.start()] = ODD
        odd = np.unique(np.searchsorted(cuts, np.flatnonzero(kinds == ODD)))
        if len(odd):  # such a word is one piece as it is
            step = np.zeros(len(raw) + 1, np.int8)
            step[np.where(odd > 0, cuts[odd - 1] + 1, 0)] += 1
            step[cuts[odd]] -= 1
            whole = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
            kinds[whole], lower[whole] = ODD, raw[whole]
        first = (kinds == DIGIT) | (kinds == END)
        first[0] = True
        first[1:] |= kinds[1:] != kinds[:-1]
        solid = kinds != SPACE
        starts = np.flatnonzero(first[solid]).astype(np.int32)
        bounds = np.append(starts, np.int32(np.count_nonzero(solid)))
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(lower[solid])])
        kind = kinds[solid][starts]
        at, known = np.empty(len(starts), np.int64), []
        for chosen, ids_of in ((kind == END, lambda _: end), (kind == ODD, self.words.__getitem__), (kind < END, self.pieces.__getitem__)):
            own = pieces.filter(pa.array(chosen)).dictionary_encode()
            at[chosen] = own.indices.to_numpy() + len(known)
            known += map(ids_of, own.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(known), self.dtype)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        counts = sizes[at]
        after = np.cumsum(counts)
        return flat[np.repeat((np.cumsum(sizes) - sizes)[at] - after + counts, counts) + np.arange(counts.sum())], after[kind == END]


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id and the ids of the whole text with the end id, as bytes of ``id_type``."""

    def run(batch):
        return {"doc_id": batch.column("doc_id").to_pylist(), "ids": Encoder.load(tokenizer).ids(batch.column("text").to_pylist(), end_id)}

    return by_batch(texts_of(docs, "doc_id"), "doc_id long, ids binary", run)


def frequencies(ids: DataFrame, dtype: np.dtype) -> DataFrame:
    """How often each id occurs: one row per id, counted per task first."""

    def run(batches):
        counts = np.zeros(1, np.int64)
        for batch in batches:
            own = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype))
            if len(own) > len(counts):
                counts = np.concatenate([counts, np.zeros(len(own) - len(counts), np.int64)])
            counts[:len(own)] += own
        seen = np.flatnonzero(counts)
        yield {"id": seen, "n": counts[seen]}

    return by_partition(ids.select("ids"), "id long, n long", run).groupBy("id").agg(F.sum("n").alias("n"))


def _control_places(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Where the code of every token stands when each document begins a control byte, and how many codes there are."""
    padded = -(-counts // 4) * 4
    return np.arange(counts.sum()) + np.repeat(np.cumsum(padded) - padded - np.cumsum(counts) + counts, counts), int(padded.sum())


def pack(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit integers, of one document or ``counts`` of several."""
    values = values.astype("<u4")
    lengths = 1 + (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    places, n = _control_places(np.array([len(values)]) if counts is None else counts)
    codes = np.zeros(n, np.uint8)
    codes[places] = lengths - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int | np.ndarray) -> tuple[np.ndarray, int]:
    """The integers behind ``control``, the first ``n`` or as many for each of several documents, and how many data bytes they take."""
    places, _ = _control_places(np.atleast_1d(n))
    mask = np.arange(4) < LENGTHS[control].reshape(-1)[places, None]
    used = int(mask.sum())
    out = np.zeros((len(places), 4), np.uint8)
    out[mask] = data[:used]
    return out.view("<u4").reshape(-1), used


BLOCKS = "part int, first long, doc_ids array<long>, lengths array<long>, control binary, data binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode all documents and write them under ``path``; each text is encoded once, its ids kept in a table meanwhile."""
    spark = docs.sparkSession
    dtype = Encoder.load(tokenizer).dtype
    table = f"{path}/ids"
    encoded(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(table)
    ids = spark.read.parquet(table)
    order = [r.id for r in frequencies(ids, dtype).orderBy(F.desc("n"), "id").collect()]  # at most the vocabulary
    rank = np.zeros(max(order, default=0) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    spark.createDataFrame(list(enumerate(order)), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    sent = spark.sparkContext.broadcast(rank)

    def blocks(batches) -> Iterator[dict[str, list]]:
        first, start, block = 0, 0, defaultdict(list)

        def done():
            counts = np.array(block["n"])
            control, data = pack(sent.value[np.frombuffer(b"".join(block["ids"]), dtype)], counts)
            return {"part": [block["part"][0]], "first": [start], "doc_ids": [block["doc_id"]], "lengths": [block["n"]],
                    "control": [control], "data": [data]}

        for batch in batches:
            rows = batch.to_pydict()
            rows["n"] = [len(blob) // dtype.itemsize for blob in rows["ids"]]
            for k, n in enumerate(rows["n"]):
                if block["n"] and first + n - start > BLOCK_TOKENS:
                    yield done()
                    start, block = first, defaultdict(list)
                for c in rows:
                    block[c].append(rows[c][k])
                first += n
        if block["n"]:
            yield done()

    by_partition(in_order(ids), BLOCKS, blocks).write.option("compression", "zstd").parquet(f"{path}/blocks")


def in_order(ids: DataFrame) -> DataFrame:
    """Encoded documents over ranges of doc_id, whose number is ``part``; ranges are drawn from the table as it was written."""
    dealt = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.length("ids"), "ids")
    return dealt.withColumn("part", F.spark_partition_id())


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and ``ids`` of every document under ``path``."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # at most the vocabulary
    sent = spark.sparkContext.broadcast(np.array([r.id for r in ranks], "<u4"))
    blocks = spark.read.parquet(f"{path}/blocks")
    total = F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))
    parts = blocks.groupBy("part").agg(total.alias("_n"))  # one row per file
    before = F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("base"))

    def run(batch):
        out = defaultdict(list)
        for row in batch.to_pylist():
            counts = np.array(row["lengths"])
            values, _ = unpack(np.frombuffer(row["control"], np.uint8), np.frombuffer(row["data"], np.uint8), counts)
            ids, ends = sent.value[values], np.cumsum(counts).tolist()
            out["doc_id"] += row["doc_ids"]
            out["start"] += (np.cumsum(counts) - counts + row["base"] + row["first"]).tolist()
            out["n_tokens"] += row["lengths"]
            out["ids"] += [ids[i:j].tobytes() for i, j in zip([0, *ends], ends)]
        return out

    return by_batch(blocks.join(F.broadcast(parts), "part"), "doc_id long, start long, n_tokens long, ids binary", run)


def token_digest(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write the documents under ``path`` (a new shared folder if not given), read them back, and digest what was read.

    doc_id, start, n_tokens (with the end id) and ids_crc32 of every row. Null and empty texts are the end id alone.
    Documents are ordered by doc_id, null first; rows that share one by their ids. An empty table gives no rows. Columns
    other than doc_id and text are not read.
    """
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
