"""Merkle manifest: block layout, proofs and the whole audit against a plain recomputation."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabfeat.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i:i + 16]) for i in range(0, len(below), 16)])
    return levels


def siblings(levels, i):
    path = []
    for level in levels[:-1]:
        start = i // 16 * 16
        path.append((level[start:i], level[i + 1:start + 16]))
        i //= 16
    return path


def plain_audit(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in order:
        leaves = sorted(((r[0] is not None, r[0] or 0, digest(*map(field, (r[0], r[3], r[2], r[4], r[1]))), r) for r in by[s]), key=lambda x: x[:3])
        own[s] = leaves, climb([x[2] for x in leaves])
    top = climb([own[s][1][-1][0] for s in order])
    for k, s in enumerate(order):
        leaves, levels = own[s]
        for i, (_, _, leaf, (doc, text, lang, source, n_chars)) in enumerate(leaves):
            path, claimed = siblings(levels, i) + siblings(top, k), leaf
            if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0:
                claimed = digest(*map(field, (doc, source, lang, n_chars, text and text.translate(LOWER))))
            proof = digest(*[x for pair in path for side in pair for x in side])
            for left, right in path:
                claimed = digest(*left, claimed, *right)
            yield doc, leaf, levels[-1][0], top[-1][0], proof, claimed, claimed == top[-1][0]


def same(got, rows):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_audit(rows)))


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5, 6])
def test_layout_is_a_bijection_and_splits_at_half_height(levels):
    places = [merkle.addresses(levels, d, np.arange(16 ** d)) for d in range(levels)]
    assert sorted(np.concatenate(places)) == list(range(merkle.tree_size(levels)))
    top = levels // 2
    if top:
        assert max(places[top - 1]) < merkle.tree_size(top) == places[top][0]  # the top half stands before every bottom tree
        width = merkle.tree_size(levels - top)
        assert (np.diff(places[top]) == width).all()
        below = places[-1].reshape(len(places[top]), -1)
        assert (below // 1 >= places[top][:, None]).all() and (below < places[top][:, None] + width).all()


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 700))
def test_block_paths_fold_to_the_root(n):
    leaves = [digest(str(i)).encode() for i in range(n)]
    block = merkle.Block.build(merkle.levels_for(n), leaves)
    levels = climb([x.decode() for x in leaves])
    assert block.root.decode() == levels[-1][0] and len(block.stored) == 32 * sum(map(len, levels))
    again = merkle.Block.load(block.levels, n, block.stored)
    for i, (leaf, path) in enumerate(zip(leaves, again.paths(), strict=True)):
        assert [(a.decode(), b.decode()) for a, b in path] == [("".join(a), "".join(b)) for a, b in siblings(levels, i)]
        assert merkle.unpacked(merkle.packed(path)) == path and merkle.folded(leaf, path) == block.root


def test_audit_of_odd_rows(spark, edge_docs, edge_rows):
    same(merkle.audit(edge_docs, merkle.lowered_where(5)).collect(), [(*r, None) for r in edge_rows])


def test_audit_of_many_tiers_hot_source_and_repeated_rows(spark):
    """Blocks of 16 leaves, so that a thousand rows need several tiers; one row occurs very often."""
    rng = random.Random(3)
    rows = [(i, f"Text {i} Ünï", rng.choice(["en", None]), "hot" if i % 3 else rng.choice(["a", "b", "é", "", None]), rng.choice([None, i])) for i in range(600)]
    rows += [(None, None, None, None, None)] * 300 + [(5, "x", "en", "alone", 1)] + rows[:20] + [(10_000 + i, "y", "", f"s{i}", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = merkle.build_manifest(spark, merkle.leaf_rows(docs, merkle.lowered_where(5)), edges=1)
    assert len(found.tiers) == 3 and len(found.top) == 2
    same(merkle.verify(found).collect(), rows)


def test_single_row_and_empty_table(spark, no_docs):
    rows = [(3, "only", "en", None, 4)]
    same(merkle.audit(spark.createDataFrame(rows, SCHEMA), merkle.lowered_where(5)).collect(), rows)
    assert merkle.audit(no_docs, merkle.lowered_where(5)).count() == 0


def test_without_received_texts_everything_verifies(spark):
    docs = spark.createDataFrame([(i, f"T{i}", "en", "s", i) for i in range(40)], SCHEMA)
    assert all(r.verified for r in merkle.audit(docs).collect())
