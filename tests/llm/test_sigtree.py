"""The signature-tree join against all pairs."""

import random

import numpy as np
import pytest
from brute import near_groups, shingle_set
from test_table_operators import copies, documents

from sheaf.llm import sigtree


def found(spark, docs, words=4, percent=85):
    return sigtree.similar_groups(documents(spark, docs), words, percent).collect()


@pytest.mark.parametrize("words, percent, seed", [(4, 85, 1), (5, 80, 2), (2, 100, 3)])
def test_groups_equal_all_pairs(spark, words, percent, seed):
    docs = copies(seed)
    rows = found(spark, docs, words, percent)
    assert len(rows) == len(docs) and {r.doc_id: r.component_id for r in rows} == near_groups(docs, words, percent)
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(shingle_set(t, words)) for i, t in docs}


def test_families_in_subtrees(spark, monkeypatch):
    monkeypatch.setattr(sigtree, "TREE_SHINGLES", 300)
    monkeypatch.setattr(sigtree, "TREE_SETS", 7)
    docs = copies(3, families=3, near=40)
    # copies that lose words at their ends: sizes of several ranges in one family
    long = [f"v{k}" for k in range(300)]
    docs += [(10_000 + k, " ".join(long[: 300 - 4 * k])) for k in range(50)]
    want = near_groups(docs, 4, 85)
    assert {r.doc_id: r.component_id for r in found(spark, docs)} == want
    assert len({want[10_000 + k] for k in range(50)}) == 1


def test_null_repeated_and_empty(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = [(5, text), (None, text), (7, text + " end"), (7, text + " end"), (7, text + " end"), (9, "other words that stand alone here"), (9, text), (None, None), (11, None), (12, " ")]
    rows = found(spark, docs)
    assert len(rows) == 10 and all(r.component_id is None for r in rows if r.doc_id is None)
    assert {r.component_id for r in rows if r.doc_id in (5, 7)} == {5}
    assert {r.component_id for r in rows if r.doc_id == 11} == {11} and {r.n_shingles for r in rows if r.doc_id in (11, 12)} == {0}
    assert found(spark, []) == []
    with pytest.raises(ValueError):
        sigtree.similar_groups(documents(spark, docs), 4, 50)


def sets_of(rng, base, n, change):
    out = []
    for _ in range(n):
        own = base.copy()
        own[rng.integers(0, len(own), rng.integers(0, change + 1))] = rng.integers(0, 2**63, 1, dtype=np.uint64)
        out.append(np.unique(own))
    return out


def smallest(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        up[high] = low
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bits", [256, 1024, 65536])
def test_a_tree_loses_no_link_and_spares_pairs(bits):
    rng = np.random.default_rng(7)
    sets = []
    for size in (3, 40, 200, 900):
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        sets += sets_of(rng, base, 40, max(1, size // 8))
    ids = rng.permutation(len(sets)).tolist()
    join = sigtree.Join(*[sigtree.Tree(ids, sets, bits)] * 2, 85)
    got = smallest(join.run(), ids)
    linked = [(a, b) for a, x in zip(ids, sets) for b, y in zip(ids, sets) if a < b and sigtree.reaches(len(np.intersect1d(x, y)), len(x), len(y), 85)]
    assert got == smallest(linked, ids)
    assert join.decided < len(ids) * (len(ids) - 1) / 2 / (2 if bits == 256 else 6)
    # two trees find what joins their sides
    half = len(ids) // 2
    across = sigtree.Join(sigtree.Tree(ids[:half], sets[:half], bits), sigtree.Tree(ids[half:], sets[half:], bits), 85).run()
    left = set(ids[:half])
    between = [(a, b) for a, b in linked if (a in left) != (b in left)]
    assert smallest(across, ids) == smallest(between, ids)
