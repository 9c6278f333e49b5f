import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import Katz, crc
from pyspark.sql import functions as F

from sheaf.llm import katz

SCHEMA = "doc_id long, text string, lang string, score string"


def check(rows, found):
    model = Katz([t for i, t in rows if crc(i) % 10])
    want = sorted((i is None, i or 0, *model.row(t), crc(i) % 10 == 0) for i, t in rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score, r.held_out) for r in found)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and g[6] == w[6]
        assert g[4:6] == pytest.approx(w[4:6], rel=1e-9, abs=1e-9)
    assert {r.train_tokens for r in found} == {model.n}


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    out = []
    for i in range(n):
        own = rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 60))
        out.append((i, rng.choice([" ", "\n", "\t "]).join(own + ["Rare%d" % i] * rng.randint(0, 2))))
    return out


def test_equals_plain_model(spark):
    rows = [*texts(300, 1), (None, "w1 w2 new"), (301, None), (302, ""), (5, "twice"), (5, "twice"), (303, "w0 " * 3000), (304, "Ünï \x85 </s> <s>")]
    docs = spark.createDataFrame([(i, t, None, "x") for i, t in rows], SCHEMA).repartition(3)
    check(rows, katz.held_out_scores(docs).collect())


def test_many_chunks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(katz, "PART_ENTRIES", 500)
    rows = texts(200, 2)
    docs = spark.createDataFrame([(i, t, None, "x") for i, t in rows], SCHEMA).repartition(8)
    check(rows, katz.held_out_scores(docs).collect())


@pytest.mark.parametrize("fan, entries, steps", [(3, 100, 4), (8, 400, 2)])
def test_lists_merged_in_steps(spark, monkeypatch, fan, entries, steps):
    """The same scores when lists reach their parts over several merges, and rows that do not multiply."""
    monkeypatch.setattr(katz, "FAN", fan)
    monkeypatch.setattr(katz, "PART_ENTRIES", entries)
    rows = texts(200, 4)
    assert len(katz._factors(sum(len(t.split()) + 1 for _, t in rows) // entries)) >= steps
    docs = spark.createDataFrame([(i, t, None, "x") for i, t in rows], SCHEMA).repartition(20)
    check(rows, katz.held_out_scores(docs).collect())


def test_steps_nest():
    """Finer ranges lie inside coarser ones, so a merged list is cut where its range ends."""
    keys = np.sort(np.random.default_rng(2).integers(0, 2**64, 5000, dtype=np.uint64))
    coarse, fine = katz._part_ends(keys, 7), katz._part_ends(keys, 7 * 5)
    assert (fine[4::5] == coarse).all() and (katz._part_ends(keys, 35, range(10, 15)) == fine[10:15]).all()
    for parts in (1, 128, 129, 5000, 10**7):
        steps = katz._factors(parts)
        assert max(steps) <= katz.FAN and parts <= math.prod(steps) < 2 * parts + katz.FAN


def test_contexts_without_rest(spark):
    # every bigram is frequent, so nothing is left over by discounts alone
    rows = [(i, "a b c") for i in range(40)] + [(i, "a c b a") for i in range(100, 130)]
    docs = spark.createDataFrame([(i, t, None, "x") for i, t in rows], SCHEMA)
    check(rows, katz.held_out_scores(docs).collect())


def test_empty_and_untrained(spark):
    assert katz.held_out_scores(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(1, "a b", None, None)], SCHEMA)
    row = katz.scores(docs, F.lit(None).cast("boolean")).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_probabilities_sum_to_one():
    model = Katz([t for _, t in texts(200, 3)])
    for h in itertools.islice(model.after, 30):
        assert math.fsum(model.p(w, h) for w in model.uni) + model.p("unseen", h) == pytest.approx(1, abs=1e-9)


def test_packing_is_reversible():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (katz._unpack_sorted(katz._pack_sorted(keys)) == keys).all()
    assert katz._part_ends(keys, 7)[-1] == 1000
    assert pa.array(katz._unpack(katz._pack(np.arange(5, dtype="<u4")), "<u4")).to_pylist() == [0, 1, 2, 3, 4]
