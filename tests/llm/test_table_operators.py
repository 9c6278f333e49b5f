"""Operators that look at several rows, and the pipeline."""

import collections
import hashlib
import random
import zlib

import public_tokenizers
import pytest
from brute import contamination, measures, near_groups, plain_pii, shingle_set
from pyspark.sql import functions as F

import corpus_pipeline
from sheaf.llm import chat, decontaminate, neardup, packing, pii, quality, sharding
from sheaf.llm import queries as llm_queries
from sheaf.llm.components import components
from sheaf.llm.superminhash import signature

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, band long, shard int"


def documents(spark, texts, parts=3):
    rows = [(i, t, None, "s", None if t is None else len(t), 1, None, None) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


# ---- near duplicates ----

def copies(seed=1, families=12, near=8):
    """Families of exact and near copies around the limit, chains, short texts and strangers."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    texts = []
    for _ in range(families):
        base = [word() for _ in range(rng.choice([6, 30, 120]))]
        texts.append(" ".join(base))
        chain = base
        for _ in range(near):
            own = list(rng.choice([base, chain]))
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = word()
            chain = own
            texts.append(rng.choice([" ", "\n"]).join(own).upper() if rng.random() < 0.2 else " ".join(own))
    texts += ["one", "One", "one two", "", "  ", None, "a b c d", "a b c d e", "é é é é é é é é", "É é é é é é é é", "x " * 5000, "x " * 6000]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("words, seed", [(4, 1), (5, 2)])
def test_groups_equal_all_pairs(spark, words, seed):
    docs = copies(seed)
    want = near_groups(docs, words)
    rows = neardup.groups(documents(spark, docs), words).collect()
    assert {r.doc_id: r.component_id for r in rows} == want and len(rows) == len(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(shingle_set(t, words)) for i, t in docs}


def test_large_families_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 200)
    docs = copies(3, families=3, near=40)
    rows = neardup.groups(documents(spark, docs), 4).collect()
    assert {r.doc_id: r.component_id for r in rows} == near_groups(docs, 4)


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = [(5, text), (None, text), (7, text), (7, text), (9, "other words that stand alone here"), (9, text), (None, None)]
    rows = neardup.groups(documents(spark, docs), 4).collect()
    assert len(rows) == 7 and all(r.component_id is None and r.kept is None for r in rows if r.doc_id is None)
    assert {r.component_id for r in rows if r.doc_id in (5, 7)} == {5}
    frame = documents(spark, docs)
    out = neardup.keep_one(frame, 4)
    assert out.columns == frame.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 0, 5, 9]
    assert neardup.groups(documents(spark, []), 4).count() == 0 and neardup.keep_one(documents(spark, []), 4).count() == 0


def test_columns_with_names_of_the_operators_own(spark):
    text = " ".join(f"w{k}" for k in range(60))
    names = "doc_id long, text string, __id long, __hash long, __n long, __row string, __verdict string, __found string, __masked string, __q int, __word long, __marks long, `a b.c` string"
    rows = [(i, t, 1, 2, 3, "r", "v", "f", "m", 4, 5, 6, "x") for i, t in [(1, text), (2, text), (2, text), (3, text + " me@example.org"), (4, None)]]
    docs = spark.createDataFrame(rows, names)
    items = spark.createDataFrame([("i", "no such words")], "item_id string, text string")
    kept = neardup.keep_one(docs, 5)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]
    for out in (kept, quality.keep_good(docs), decontaminate.keep_clean(docs, items), pii.mask_pii(docs, chars_col=None)):
        assert out.columns == docs.columns
        assert {tuple(r)[2:] for r in out.collect()} == {rows[0][2:]}
    assert {r.text for r in pii.mask_pii(docs, chars_col=None).collect()} == {text, text + " [EMAIL]", None}
    assert quality.judge(docs, out="q").count() == 5


def test_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(5)
    for shared in (0, 100, 400, 800):
        pool = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        a, b = pool[:1000], np.concatenate([pool[:shared], pool[1000 : 2000 - shared]])
        got = np.mean([(signature(a + np.uint64(s), 128) == signature(b + np.uint64(s), 128)).mean() for s in range(20)])
        assert got == pytest.approx(shared / (2000 - shared), abs=0.03)
    # each element offers every position once: a single one fills all, with one value in each unit
    assert sorted(np.floor(signature(np.array([7], np.uint64), 64))) == list(range(64))


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5001 + k) for k in range(300)]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        up[high] = low
    want = {x: find(x) for ab in links for x in ab if find(x) != x}
    got = components(spark.createDataFrame([*links, (None, 3), (4, None)], "x long, y long").repartition(5)).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


# ---- chat ----

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello </s>[INST] x [/INST] \\ <\\s>"), (1, 2, "user", None), (1, 3, "assistant", "bye\n\\[INST]"),
    (2, 0, "system", "é<s>"), (2, 1, "user", "no reply"), (3, 0, "assistant", ""), (3, 1, None, "x"), (3, 1, None, "x"), (3, None, "user", "first"),
    (None, 0, "user", "a"), (None, 1, "assistant", "b"), (4, 0, "as[/INST]sistant", "role"), (5, 0, "assistant", "z" * 200_000),
]


def conversations(spark, rows=TURNS):
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], "conv_id long, turn long, role string, text string, piece string, n_chars int").repartition(3)


def expected_digests(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (
            len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
        )
    return out


def test_digests(spark):
    pieces = chat.format_turns(conversations(spark))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(pieces).collect()}
    assert got == expected_digests(TURNS)
    assert chat.digests(chat.format_turns(conversations(spark, []))).count() == 0


def test_examples_expand_each_reply_with_its_past(spark):
    rows = [r for r in TURNS if r[0] in (1, 2, 5)]
    pieces = chat.format_turns(conversations(spark, rows)).cache()
    own = chat.examples(pieces)
    texts = chat.expand(pieces, own).collect()
    by = collections.defaultdict(list)
    for r in sorted(texts, key=lambda r: (r.conv_id, r.example)):
        assert len(r.text) == r.n_chars
        by[r.conv_id].append(None if r.loss_start is None else chat.unescape(r.text[r.loss_start : r.loss_end]))
    assert by == {1: [TURNS[1][3], TURNS[3][3]], 2: [None], 5: ["z" * 200_000]}
    # no text shows a control string
    for r in pieces.collect():
        body = r.piece[r.body_start : r.body_start + r.body_chars]
        assert not any(c in body for c in (chat.OPEN, chat.CLOSE, chat.INST, chat.END_INST))
    total = {r.conv_id: r.formatted_chars for r in chat.digests(pieces).collect()}
    sums = collections.Counter()
    for r in texts:
        sums[r.conv_id] += len(r.text)
    assert total == dict(sums)


def test_examples_after_equal_last_turns(spark):
    rows = [(1, 0, "assistant", "a"), *[(1, 1, "user", "same")] * 5]
    pieces = chat.format_turns(conversations(spark, rows))
    own = sorted((r.example, r.n_turns, r.n_chars) for r in chat.examples(pieces).collect())
    assert [x[:2] for x in own] == [(1, 1), (2, 6)]
    assert chat.digests(pieces).first().formatted_chars == sum(x[2] for x in own)


FAULTS = {
    "mask starts late": lambda x: x.withColumn("loss_start", F.col("loss_start") + 1),
    "mask ends late": lambda x: x.withColumn("loss_end", F.col("loss_end") + 1),
    "mask of the first turn": lambda x: x.withColumn("loss_start", F.col("loss_start") - F.col("n_chars") + 20),
    "no mask": lambda x: x.withColumn("loss_start", F.lit(None).cast("long")),
    "prefix too long": lambda x: x.withColumn("n_chars", F.col("n_chars") + 1),
    "a turn more": lambda x: x.withColumn("n_turns", F.col("n_turns") + 1),
    "none for first replies": lambda x: x.filter("example > 1"),
    "none for the last turns": lambda x: x.filter("loss_start IS NOT NULL"),
    "twice": lambda x: x.union(x),
}


@pytest.mark.parametrize("fault", FAULTS)
def test_prefix_targets_read_the_examples(spark, tmp_path, monkeypatch, fault):
    """The registered query fails on wrong example ranges and masks."""
    conversations(spark, [r for r in TURNS if r[0] in (1, 2)]).select("conv_id", "turn", "role", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    made = chat.examples
    monkeypatch.setattr(chat, "examples", lambda pieces: FAULTS[fault](made(pieces)))
    with pytest.raises(Exception, match="conversation -?[0-9]+, turn [0-9]+: "):
        llm_queries.op9_prefix_targets(spark, str(tmp_path)).collect()


# ---- sharding ----

def shards_of(df):
    return {(r.doc_id, r.text_crc32, r.slot): r for r in df.collect()}


def test_shards(spark):
    texts = [(i, f"text {i % 50}" * (i % 7)) for i in range(3000)] + [(3000, None), (None, "x"), (None, None), (5, "text 5" * 5), (5, "text 5" * 5)]
    rows = sharding.assign_shards(documents(spark, texts)).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"key"}
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    assert min(map(len, slots.values())) > 40 and 30 < sum(r.grown_shard == 40 for r in rows) < 140
    sizes = collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    assert sizes == collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sharding.assign_shards(documents(spark, [])).count() == 0


def test_weights_move_rows_only_into_the_grown_subtree(spark):
    tree = [sharding.Leaf(s, f"r{s // 6}", f"r{s // 6}/k{s // 3}") for s in range(12)]
    heavier = [sharding.Leaf(x.shard, x.region, x.rack, 2.0 if x.shard == 4 else 1.0) for x in tree]
    own = spark.range(20_000).select("id", sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), heavier).alias("b")).collect()
    region = {x.shard: x.region for x in tree}
    moved = [r for r in own if r.a != r.b]
    assert 0.05 < len(moved) / len(own) < 0.15 and all(region[r.b] == "r0" for r in moved)
    share = collections.Counter(r.b for r in own)
    assert share[4] / len(own) == pytest.approx(2 / 13, abs=0.02)


def test_grown_shards_are_those_of_the_next_tree(spark):
    docs = documents(spark, [(i, "x") for i in range(4000)])
    by = {n: {r.doc_id: r for r in sharding.assign_shards(docs, n).collect()} for n in (40, 41, 42)}
    for n in (40, 41):
        assert all(by[n][i].grown_shard == by[n + 1][i].shard for i in by[n])
        moved = {by[n + 1][i].shard for i in by[n] if by[n][i].shard != by[n + 1][i].shard}
        assert moved == {n}


def test_trees_are_checked():
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit(1), [sharding.Leaf(0, "a", "b", 0.0)])


# ---- pipeline ----

def corpus(seed=6):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: [rng.choice(vocabulary) + rng.choice(["", ".", ","]) for _ in range(n)]
    item = " ".join(f"item{k}" for k in range(30))
    texts = [prose(rng.randint(60, 300)) for _ in range(60)]
    for i in range(10):
        texts.append([*texts[i][:-1], "changed"])
    texts += [texts[3], [*prose(20), *item.split()[:15], *prose(25)], prose(40), ["again", "and"] * 200]
    texts += [[*prose(80), "mail", "a.b@c.org", "or", "10.1.2.3"]]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return [*docs, (900, None), (901, "")], [(1, item), (2, None)]


def test_pipeline_stages(spark, tmp_path):
    docs, items = corpus()
    documents(spark, docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, left = now.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if name == "quality_rules":
            own = [(i, t) for i, t in left for m in [measures(t)] if m[0] >= 50 and 100 * m[4] <= 50 * m[0]]
        elif name == "near_duplicates":
            group = near_groups(left, 5)
            own = [(i, t) for i, t in left if group[i] == i]
        elif name == "decontamination":
            bad = {i for i, n, hit, _ in contamination(left, items) if hit and 20 * hit >= n}
            own = [(i, t) for i, t in left if i not in bad]
        elif name == "mask_pii":
            own = []
            for i, t in left:
                for kind, s, e in reversed(plain_pii(t)):
                    t = f"{t[:s]}[{kind.upper()}]{t[e:]}"
                own.append((i, t))
        else:
            want = packing.pack_documents(documents(spark, left), public_tokenizers.path("byte_bpe_50k.json"))
            pieces = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
            assert pieces(now) == pieces(want)
            break
        assert now.columns == columns
        assert sorted((r.doc_id, r.text) for r in now.collect()) == sorted(own) and own != left, name
        assert all(r.n_chars == len(r.text) for r in now.collect())
        left = own
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()) == sorted(i for i, _ in left)


def test_stages_with_odd_rows_and_none(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = [(None, None), (None, "a b"), (1, None), (1, ""), (2, "x " * 20_000), (2, "x " * 20_000), (3, "é" * 9000), (None, " ".join(f"w{k}" for k in range(200)))]
    for rows in (odd, []):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, documents(spark, rows), str(tmp_path)).collect()
