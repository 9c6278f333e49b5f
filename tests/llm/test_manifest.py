"""The Merkle manifest against a plain one."""

import random

import pytest
from brute import plain_manifest

from sheaf.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, grp string, g int"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", 1, None, 3) for r in rows], SCHEMA).repartition(parts)


def found(spark, rows):
    docs = frame(spark, rows)
    return sorted((tuple(r) for r in merkle.manifest(docs, merkle.changed_size(docs)).collect()), key=repr)


def table(seed, n, langs, ids):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        text = rng.choice([None, "", "é" * rng.randint(0, 9), "word " * rng.randint(1, 40)])
        rows.append((ids(rng), rng.choice(["s", None, "tü"]), rng.choice(langs), None if text is None or rng.random() < 0.1 else len(text), text))
    return rows


@pytest.mark.parametrize("levels", [3, 10])
def test_equals_a_plain_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "DIRECTORY", (2, 3, 16) if levels < 10 else (10, 16, 16))
    rows = table(levels, 150, ["de", "en", "en", "en", "z", "é", "", None], lambda rng: rng.randint(-300, 5000))
    want = plain_manifest(rows)
    assert found(spark, rows) == want
    assert {r[-1] for r in want} == {True, False}


def test_wide_null_and_repeated_ids(spark):
    wide = [-(2**63), 2**63 - 1, 2**40, 2**40 + 1, -1, 0, 63, 64, None]
    rows = table(5, 60, ["a", None], lambda rng: rng.choice(wide))
    rows += [rows[0]] * 9 + [(7, "s", "a", 1, "x")] * 20 + [(7, "s", "a", 1, str(k)) for k in range(30)]
    assert found(spark, rows) == plain_manifest(rows)


def test_small_tables(spark):
    for rows in ([], [(1, None, None, None, None)], [(1, "s", "a", 2, "xy"), (2, "s", "b", 2, "xy")], [(k, "s", "a", 1, "x") for k in range(3)]):
        assert found(spark, rows) == plain_manifest(rows)
    only = found(spark, [(1, None, None, None, None)])[0]
    assert only[1] == only[2] == only[3] and only[-1]


def test_many_groups(spark):
    rows = [(k, "s", f"g{k % 90}" if k % 91 else None, k, "t") for k in range(400)]
    assert found(spark, rows) == plain_manifest(rows)
