"""Periodic runs: the scan against a direct search, and the operator on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabfeat.llm import periodic_runs


def plain_runs(words):
    """All stretches of every period by direct comparison; the smallest period of a stretch is kept."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def scanned(documents):
    ends = np.cumsum([len(w) + 1 for w in documents]) - 1
    ids = np.concatenate([np.array([*w, -2 - k], np.int32) for k, w in enumerate(documents)])
    found, start = periodic_runs.find_runs(ids, ends), 0
    out = []
    for words in documents:
        out.append([(s - start, n, q) for s, n, q in found if start <= s < start + len(words)])
        start += len(words) + 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4))
def test_scan_of_few_words(documents):
    assert scanned(documents) == [plain_runs(w) for w in documents]


@pytest.mark.parametrize("seed", range(12))
def test_scan_of_long_periods(seed):
    rng, documents = random.Random(seed), []
    for _ in range(5):
        n = rng.randrange(1, 700)
        words = [rng.randrange(rng.choice([3, 500])) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            start, period = rng.randrange(n), rng.randrange(1, max(2, n // 4))
            for i in range(start + period, min(n, start + int(period * rng.uniform(3, 7)))):
                words[i] = words[i - period]
        documents.append(words)
    assert scanned(documents) == [plain_runs(w) for w in documents]


def test_every_period_at_the_least_length():
    """Exactly four periods of distinct words, amid words of their own: found for every period; one word less is none."""
    for period in range(2, 200):
        block = list(range(period))
        assert scanned([[900, 901, *block * 4, 902, 903]]) == [[(2, 4 * period, period)]]
        assert scanned([[900, 901, *(block * 4)[:-1], 902, 903]]) == [[]]


def test_smallest_period_counts():
    assert scanned([[1] * 40]) == [[(0, 40, 1)]] and scanned([[1, 2] * 30]) == [[(0, 60, 2)]]
    assert scanned([[1] * 5]) == [[]] and scanned([[]]) == [[]]


def report(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_reports_of_odd_rows(spark, edge_docs, edge_rows, no_docs):
    rows = [(d, t) for d, t, *_ in edge_rows if t is None or len(t) < 20_000]
    rows += [(None, "a b " * 40), (None, None)] + [(100 + i, "x y z " * i + "end. " + "q " * (i % 9)) for i in range(60)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_runs int, runs string").repartition(3)
    got = [tuple(r)[:8] for r in periodic_runs.periodic_runs(docs, implant=True).collect()]
    assert sorted(map(str, got)) == sorted(str(report(*r)) for r in rows)
    assert len([r for r in got if r[1]]) > 60
    assert periodic_runs.periodic_runs(edge_docs).count() == len(edge_rows) and periodic_runs.periodic_runs(no_docs).count() == 0
