"""Operators with exact results, against brute force over the odd cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabfeat.llm import decontaminate, mixing, near_dedup, quality_rules, substring_dedup, token_output
from tabfeat.llm.queries import tokenizer_path


def raw(text):
    return (text or "").encode()


def lower(text):
    return raw(text).translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))


# ---- 1: repeated strings ---------------------------------------------------------------------


def removed_by_force(rows, length=50):
    first, out = {}, []
    for doc, text in sorted((d, raw(t)) for d, t, *_ in rows):
        cover = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if first.setdefault(text[i:i + length], doc) < doc:
                cover[i:i + length] = b"\1" * length
        kept = bytes(c for c, v in zip(text, cover) if not v)
        spans = len(re.findall(rb"\x01+", bytes(cover)))
        out.append((doc, len(text), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def digest_rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


REMOVED = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("small", [False, True])
def test_repeats_match_brute_force(edge_docs, edge_rows, monkeypatch, small):
    if small:  # many buckets, batches and cuts, as on large tables
        monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 5_000)
    assert digest_rows(substring_dedup.without_repeats(edge_docs), *REMOVED) == removed_by_force(edge_rows)


def test_index_levels_and_cuts_keep_the_result(edge_rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BATCH_SUFFIXES", 300)
    monkeypatch.setattr(substring_dedup, "CUT", 777)
    sent, spans = defaultdict(list), defaultdict(list)
    rows = sorted(((d, raw(t)) for d, t, *_ in edge_rows), reverse=True)
    for batch in range(3):
        part = rows[batch::3]
        for row in substring_dedup.pack_batch([d for d, _ in part], [t for _, t in part], batch, 4):
            row = {c: v[0] for c, v in row.items()}
            sent[row["bucket"] if row["stage"] == 1 else None].append(row)
    found = sent.pop(None)
    for bucket in sent.values():
        found += [{c: v[0] for c, v in row.items()} for row in substring_dedup.search_bucket(bucket)]
    for row in found:
        ids = sorted(d for d, _ in rows[row["batch"]::3])
        for i, s, n in zip(*substring_dedup._from_places(row["place"]), substring_dedup._loose(row["size"], "<i4"), strict=True):
            spans[ids[i]].append((s, s + n))
    for doc, _, n_removed, n_spans, _ in removed_by_force(edge_rows):
        start, end = substring_dedup.united(*(np.array(x, np.int64) for x in zip(*spans[doc]))) if spans[doc] else ([], [])
        assert (sum(end) - sum(start), len(start)) == (n_removed, n_spans), doc


def test_batches_without_any_repeat(spark):
    docs = spark.createDataFrame([(i, chr(97 + i) * 60 + f"{i}" * 60) for i in range(8)], "doc_id long, text string").repartition(4)
    assert {r.n_removed for r in substring_dedup.without_repeats(docs).collect()} == {0}


def test_log_index_has_geometric_levels():
    index, rng = substring_dedup.LogIndex(), np.random.default_rng(0)
    for doc in range(40):
        keys = rng.integers(0, 1 << 60, 100, np.uint64)
        assert not index.add(keys, keys, np.full(100, doc)).any()
    sizes = [len(k) for k, _, _ in index.levels]
    assert sum(sizes) == 4000 and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    again = index.levels[0][0][:7]
    assert index.add(again, again, np.full(7, 99)).all()


# ---- 2: token ids ----------------------------------------------------------------------------


def test_tokens_round_trip(edge_docs, edge_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want, start = [], 0
    encoded = [(d, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for d, t, *_ in edge_rows]
    for doc, ids in sorted(encoded, key=lambda x: x[0]):
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert digest_rows(token_output.token_digest(edge_docs, tokenizer_path(), 2), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_blocks_split_and_codes_of_every_length(spark, monkeypatch, edge_docs, edge_rows):
    values = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 5], np.uint32)
    control, data = token_output.pack(values)
    back, used = token_output.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values))
    assert back.tolist() == values.tolist() and used == len(data) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4 + 1
    from tabfeat.session import scratch_path

    path = scratch_path(spark, "tokens")
    token_output.write_tokens(edge_docs, path, tokenizer_path(), 2)
    assert token_output.read_tokens(spark, path).count() == len(edge_rows)


ODD_PARTS = ["a", "B", "word", "É", "é", "ß", "Þ", "×", "÷", "ÿ", "'s", "’", "0", "12", "#", "<", ".", "...", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "  ",
             "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2009", "\0", "\x7f", "日本", "é", "\u0301", "İ", "\u212a", "ﬁ", "😀", "²", "ª", "Ω"]


@pytest.mark.parametrize("size", [7, 300, 1 << 20])
def test_cut_pieces_have_the_ids_of_whole_texts(monkeypatch, size):
    monkeypatch.setattr(token_output, "SLICE_BYTES", size)
    rng = np.random.default_rng(size)
    texts = ["", "\0", " ", "É", "x" * 1000, "日" * 500] + ["".join(rng.choice(ODD_PARTS, n)) for n in rng.integers(0, 25, 3000)]
    encoder = token_output.Encoder(tokenizer_path())
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2], encoder.dtype).tobytes() for t in texts]
    assert encoder.ids([t.encode() for t in texts], 2) == want and encoder.ids([], 2) == []
    with pytest.raises(UnicodeDecodeError):
        encoder.ids([b"no \xc3 text"], 2)


def test_a_slice_asks_once_for_a_piece(monkeypatch):
    monkeypatch.setattr(token_output, "ENCODED_PIECES", 0)
    encoder, asked = token_output.Encoder(tokenizer_path()), Counter()
    model = encoder.pieces.fn
    encoder.pieces.fn = lambda piece: asked.update([piece]) or model(piece)
    encoder.ids([b"Word word, (WORD) other. " * 100, b"other word"], 2)
    assert asked == {b"word": 1, b"other": 1, b",": 1, b"(": 1, b")": 1, b".": 1}


def test_packed_documents_together_equal_each_alone():
    rng = np.random.default_rng(1)
    counts = np.array([1, 4, 3, 0, 9, 2])
    values = rng.integers(0, 1 << 32, counts.sum(), np.uint32) >> rng.integers(0, 32, counts.sum(), np.uint32)
    each = [token_output.pack(v) for v in np.split(values, np.cumsum(counts)[:-1])]
    control, data = token_output.pack(values, counts)
    assert (control, data) == (b"".join(c for c, _ in each), b"".join(d for _, d in each))
    back, used = token_output.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), counts)
    assert back.tolist() == values.tolist() and used == len(data)


def test_ids_pass_python_once_to_be_packed_and_once_to_be_read(spark, edge_docs, capsys):
    """Ranges are drawn before the ids are packed, blocks are not shuffled to be read, and Spark takes the checksums."""
    ids = token_output.in_order(spark.createDataFrame([(2, b"ab"), (1, b"abcd"), (1, b"ab")], "doc_id long, ids binary"))
    assert [(r.doc_id, bytes(r.ids)) for r in ids.coalesce(1).collect()] == [(1, b"ab"), (1, b"abcd"), (2, b"ab")]
    token_output.token_digest(edge_docs, tokenizer_path(), 2).explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and "SortMergeJoin" not in plan


# ---- 4: statistics of quality rules ----------------------------------------------------------


def statistics_by_force(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))


def test_quality_statistics_and_base(edge_docs, edge_rows):
    judged = quality_rules.judge(edge_docs)
    got = digest_rows(judged, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for d, t, *_ in edge_rows:
        s = statistics_by_force(t)
        want.append((d, *s, s[0] < 10 or 100 * s[4] > 20 * s[0]))
    assert got == sorted(want)
    assert not judged.where("base_failed AND kept").count()
    kept = sorted(r.doc_id for r in judged.where("kept").collect())
    assert kept == sorted(r.doc_id for r in quality_rules.keep_good(edge_docs).collect())


def test_quality_rejects_symbol_capital_and_table_junk(spark):
    """Among documents with some capitals and symbols of their own, in a group and in one of few rows."""
    import random

    rng = random.Random(5)

    def prose(words=80):
        text = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(words))
        return ". ".join(text[i:i + 60].capitalize() for i in range(0, len(text), 60)) + (" & more" if rng.random() < 0.1 else "")

    rows = [(i, prose(rng.randrange(30, 200)), "en", "a" if i % 10 else "b") for i in range(300)]
    junk = [" ".join(w + "###" for w in prose().split()), prose().upper(), " | ".join(prose().split()), prose() + " | ".join(prose(60).split())]
    rows += [(1000 + 10 * i + k, text, "en", source) for i, source in enumerate("ab") for k, text in enumerate(junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert not [d for d in kept if d >= 1000] and len(kept) >= 0.98 * 300
    assert kept == {r.doc_id for r in quality_rules.keep_good(docs).collect()}


# ---- 5: near duplicates ----------------------------------------------------------------------


def components_by_force(rows):
    sets = {}
    for d, t, *_ in rows:
        w = lower(t).split()
        k = min(5, len(w))
        sets[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]) and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return sorted((d, len(sets[d]), top(d), top(d) == d) for d, *_ in rows)


NEAR = ("doc_id", "n_shingles", "component_id", "kept")


def test_near_duplicates_match_brute_force(edge_docs, edge_rows):
    assert digest_rows(near_dedup.near_duplicates(edge_docs), *NEAR) == components_by_force(edge_rows)
    left = [r.doc_id for r in near_dedup.one_of_each(edge_docs).collect()]
    assert sorted(left) == sorted({d for d, _, _, kept in components_by_force(edge_rows) if kept})


def test_near_duplicates_chains_and_blocks(spark, monkeypatch):
    """Chains of copies in which most pairs are too far apart, compared in several blocks."""
    import random

    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng, rows = random.Random(3), []
    for family in range(3):
        words = [f"f{family}x{i}" for i in range(120)]
        for step in range(25):
            words[rng.randrange(120)] = f"s{family}y{step}"
            rows.append((family * 100 + rng.randrange(10**6) * 1000 + step, " ".join(words), "en", "a"))
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert digest_rows(near_dedup.near_duplicates(docs), *NEAR) == components_by_force(rows)


def test_block_comparison_of_sketches():
    rng = np.random.default_rng(1)
    base = rng.permutation(np.unique(rng.integers(0, 1 << 32, 6000, np.uint64).astype(np.uint32)))
    sets = [base, base[: int(len(base) * 0.9)], base[: len(base) // 2], base[:500], base[:450], base[:100]]
    sketches, levels = [], []
    for s in sets:
        level = 0
        while len(s) > near_dedup.SKETCH:
            level += 1
            s = s[s < 1 << (32 - level)]
        sketches.append(np.sort(s))
        levels.append(level)
    every = np.arange(len(sets))
    similar = near_dedup.similar_in_block(sketches, np.array(levels), every, every)
    assert similar[0, 1] and similar[3, 4] and not similar[0, 2] and not similar[3, 5] and not similar[2, 3]


def test_memory_of_a_full_block():
    """Two sides of BLOCK similar sets of 900 shingles are compared in a bounded space."""
    import tracemalloc

    rng = np.random.default_rng(1)
    base, sketches = rng.integers(0, 1 << 32, 900, dtype=np.uint64).astype(np.uint32), []
    for _ in range(2 * near_dedup.BLOCK):
        own, n = base.copy(), rng.integers(0, 300)
        own[rng.integers(0, 900, n)] = rng.integers(0, 1 << 32, n, dtype=np.uint64)
        sketches.append(np.unique(own))
    every = np.arange(2 * near_dedup.BLOCK)
    tracemalloc.start()
    near_dedup.compared_in_block(sketches, np.zeros(len(every), int), every[:near_dedup.BLOCK], every[near_dedup.BLOCK:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 135 << 20


def test_spanning_pairs_join_what_all_sure_pairs_join():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (40, 40), (60, 25)):
        for share in (0.0, 0.02, 0.3, 1.0):
            possible = rng.random((n, m)) < share
            sure = possible & (rng.random((n, m)) < 0.7)
            left, right = rng.integers(0, 30, n), rng.integers(0, 30, m)
            group = {c: c for c in [*left.tolist(), *right.tolist()]}

            def top(c, group=group):
                while group[c] != c:
                    c = group[c]
                return c

            pairs = near_dedup.spanning_pairs(possible, sure, left, right)
            trees = [(i, j) for i, j in pairs if sure[i, j]]
            for i, j in trees:  # no pair of a tree is needless
                a, b = top(int(left[i])), top(int(right[j]))
                assert a != b
                group[a] = b
            assert all(top(int(left[i])) == top(int(right[j])) for i, j in np.argwhere(sure))
            rest = {(int(i), int(j)) for i, j in np.argwhere(possible & ~sure) if top(int(left[i])) != top(int(right[j]))}
            assert rest == {(i, j) for i, j in pairs if not sure[i, j]}


# ---- 9: mixing -------------------------------------------------------------------------------


def test_mixing_targets_and_repeats(spark, edge_docs, edge_rows):
    rows = mixing.mix(edge_docs).collect()
    size = Counter()
    for d, t, _, s in edge_rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        level = rest / sum(weight[s] for s in order if s not in full)
        above = {s for s in order if s not in full and weight[s] * level > 2 * size[s]}
        if not above:
            break
        full |= above
    for s in order:
        target[s] = 2 * size[s] if s in full else weight[s] * level
    taken = Counter()
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(r.size for r in rows if r.source == s) / 2 + 1e-6
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(edge_docs.repartition(7)).collect()))
    wanted = Counter()
    for r in rows:
        wanted[r.doc_id] = max(wanted[r.doc_id], r.repeats)
    got = Counter(r.doc_id for r in mixing.repeated(edge_docs).collect())
    assert got == Counter({d: n * sum(x[0] == d for x in edge_rows) for d, n in wanted.items() if n})


# ---- 10: decontamination ---------------------------------------------------------------------


def contamination_by_force(rows, items):
    def words(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i:i + n])].add(item)
    out = []
    for d, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        ids = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_contamination_matches_brute_force(spark, edge_docs, edge_rows, monkeypatch):
    passage = edge_rows[9][1].split()
    items = [(1, " ".join(passage[40:60]).upper()), (2, "Two, words!"), (2, "two words"), (3, None), (4, "..."), (15, edge_rows[0][1]), (7, " ".join(passage[45:55]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = contamination_by_force(edge_rows, items)
    assert digest_rows(decontaminate.contamination(edge_docs, benchmark), *cols) == want
    assert sorted(r.doc_id for r in decontaminate.clean(edge_docs, benchmark).collect()) == sorted(r[0] for r in want if not r[5])
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 100)  # several automata
    assert digest_rows(decontaminate.contamination(edge_docs.dropDuplicates(["doc_id"]), benchmark), *cols) == sorted(set(want))
    span = {r.doc_id: (r.span_starts, r.span_ends) for r in decontaminate.contamination(edge_docs, benchmark).collect()}
    starts, ends = span[7]
    assert [raw("Two words")[a:b] for a, b in zip(starts, ends)] == [b"Two words"]


def test_contamination_by_several_automata_judges_every_row(spark, monkeypatch):
    """Rows that share a doc_id or have none; windows of two shards overlap and adjoin in one text."""
    words = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(words[3:13])), (2, " ".join(words[8:20])), (3, " ".join(words[20:30]))]
    rows = [(None, " ".join(words)), (None, "clean words only"), (None, None), (5, " ".join(words[:14])), (5, " ".join(words[18:33])),
            (5, " ".join(words[:14])), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "span_starts", "span_ends")

    def found():
        return sorted(map(str, decontaminate.contamination(docs, benchmark).select(*cols).collect()))

    whole = found()
    assert len(whole) == len(rows) and sum("n_hit=27" in r for r in whole) == 1
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 15)
    assert len(decontaminate._shards(benchmark, decontaminate.WINDOW)) > 3
    assert found() == whole


# ---- empty tables ----------------------------------------------------------------------------


def test_empty_tables_give_no_rows(spark, no_docs):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert not substring_dedup.without_repeats(no_docs).count()
    assert not token_output.token_digest(no_docs, tokenizer_path(), 2).count()
    assert not quality_rules.judge(no_docs).count()
    assert not near_dedup.near_duplicates(no_docs).count()
    assert not mixing.mix(no_docs).count()
    assert not decontaminate.contamination(no_docs, benchmark).count()
