"""Fingerprints: contract columns against a plain recomputation, likeness against exact similarity, heads of bands."""

import hashlib
import random

import numpy as np
import pytest

from tabfeat.llm import fingerprints
from tabfeat.llm.text import WordHashes


def shingle_set(text):
    words = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    size = min(5, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows):
    """doc_id, n_chars, edited text and next text, for rows of distinct doc_ids."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, (d, t) in enumerate(rows):
        following, m = rows[(i + 1) % len(rows)][1], len(t) // 4
        yield d, t, t[:len(t) - m] + following[:m], following


def rows_of(n, seed=4):
    rng = random.Random(seed)
    out = [(i, " ".join(rng.choice(["Wörd", "日本", "a", "B", f"w{rng.randrange(900)}"]) for _ in range(rng.randrange(1, 200)))) for i in range(n)]
    return out + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "ONE\ttwo"), (None, "nameless text of a few words")]


@pytest.mark.parametrize("parts", [1, 7])
def test_contract_columns(spark, parts):
    rows = rows_of(120)
    docs = spark.createDataFrame([(d, t, "x", 9) for d, t in rows], "doc_id long, text string, fingerprint string, n_chars int").repartition(parts)
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    want = list(plain(rows))
    assert len(got) == len(rows)
    reader, signatures = fingerprints._Reader(), {}
    for d, text, edited, following in want:
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert bytes(r.signature) == reader.alone(text) and bytes(r.edited) == reader.alone(edited)
        assert r.near_edited == fingerprints.likeness(reader.alone(text), reader.alone(edited))
        assert r.near_next == fingerprints.likeness(reader.alone(text), reader.alone(following))
        assert abs(r.near_edited - jaccard(text, edited)) < 0.25 and abs(r.near_next - jaccard(text, following)) < 0.25
        signatures.setdefault(text.lower() if text.isascii() else text, set()).add(bytes(r.signature))
    assert all(len(s) == 1 for s in signatures.values())
    assert np.mean([got[d].near_edited - jaccard(t, e) for d, t, e, _ in want]) == pytest.approx(0, abs=0.02)


def test_signature_of_the_shared_part_is_the_whole_one():
    reader = fingerprints._Reader()
    for d, text, edited, _ in plain(rows_of(60, seed=8)):
        own, other, whole = fingerprints.two_signatures(text.encode(), edited.encode(), len(text[:len(text) - len(text) // 4].encode()), reader.words)
        hashes = fingerprints.shingles(WordHashes().of(fingerprints.lower_ascii(text.encode()).split()))
        assert (own == fingerprints.minima(hashes)).all() and set(whole.tolist()) == set(hashes.tolist())
        assert (other == fingerprints.minima(fingerprints.shingles(WordHashes().of(fingerprints.lower_ascii(edited.encode()).split())))).all()


def test_repeated_rows_single_row_and_empty_table(spark, edge_docs, edge_rows, no_docs):
    got = fingerprints.fingerprints(edge_docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in edge_rows)
    alone = spark.createDataFrame([(5, "abcd efgh")], "doc_id long, text string")
    r = fingerprints.fingerprints(alone).first()
    assert (r.n_chars, r.edited_sha256, r.near_next) == (9, hashlib.sha256(b"abcd efab").hexdigest(), 1.0)
    assert fingerprints.fingerprints(no_docs).count() == 0
    same = spark.createDataFrame([(None, "x")] * 30 + [(1, "y")] * 30, "doc_id long, text string").repartition(6)
    assert fingerprints.fingerprints(same).count() == 60


def test_heads_of_bands(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(60):  # copies with one to three changed words
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(120)] = f"new{i}"
        rows.append((10 + i, " ".join(words)))
    rows += [(200 + i, " ".join(f"v{rng.randrange(5000)}" for _ in range(60))) for i in range(50)] + [(300, None), (301, ""), (None, "no id here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    heads = {r.doc_id: r.head for r in fingerprints.band_heads(fingerprints.fingerprints(docs), docs).collect()}
    assert len(heads) == len(rows)
    texts = dict(rows)
    for d, h in heads.items():
        assert h == d or jaccard(texts[d], texts[h]) >= 0.75
        if d is not None and d >= 200:
            assert h == d
        elif d is not None and jaccard(texts[d], texts[10]) >= 0.8:
            assert h == 10
