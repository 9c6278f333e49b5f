"""Operators that judge or rewrite one text at a time."""

import base64
import hashlib
import pathlib
import random
import string

import numpy as np
import public_tokenizers
import pytest
import zstandard
from brute import contamination, measures, plain_kept, plain_pii
from tokenizers import Tokenizer

from sheaf.llm import decontaminate, packing, pii, quality, tokens, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, item_id int, words array<int>"


def documents(spark, texts, parts=3):
    rows = [(i, t, None, "s", None if t is None else len(t), "x", None, None) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


@pytest.fixture(scope="module")
def odd():
    """Null, empty, blank, very long, repeated and many-script texts, and a null id."""
    rng = random.Random(4)
    words = ["the", "of", "Ünïcode", "naïve", "a.b", "x@y.z", "12", "日本", "don't", "we'll", "#tag", "|", "end.\n", "\t", "　", "🙂", "<|endoftext|>", "\x1c"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(40)]
    long = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(60_000))
    texts += [None, "", " \n\t ", long, "y" * 50_000, "9" * 30_000, "@" * 500, "a@" * 500 + "b.c", "one two\n" * 400, texts[0], texts[0]]
    return [*enumerate(texts), (7, "repeated id"), (None, "no id 10.0.0.1"), (None, None)]


# ---- decontamination ----

def found(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def expected(docs, items, window=13):
    out = []
    for doc, n, hit, own in contamination(docs, items, window):
        out.append((doc is None, doc or 0, n, hit, len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    return sorted(out)


def passages(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)] + ["é", "ß9", "日"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 5, 12, 13, 14, 40])))) for k in range(60)]
    items += [(60, "W1, w2; W3-w4"), (61, None), (None, "w5 " * 20), (62, "a a a a a a a a a a a a a a a a"), (3, items[3][1]), (63, items[5][1])]
    docs = []
    for i in range(80):
        own = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(own))
            own[at:at] = (rng.choice(items)[1] or "").split()
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(own).title()))
    return docs + [(80, None), (81, ""), (82, "a " * 500), (5, "w1 w2 w3 w4"), (None, "w1 w2 w3 w4")], items


def test_contamination(spark):
    docs, items = passages()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert found(decontaminate.report(documents(spark, docs), benchmark)) == expected(docs, items)


def test_contamination_in_blocks_and_segments(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", 7)
    docs, items = passages(8)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(documents(spark, docs), benchmark, block_words=200)
    assert found(got) == expected(docs, items)


def test_contamination_of_nothing(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and not r.contaminated for r in decontaminate.report(documents(spark, odd), none).collect())
    assert decontaminate.report(documents(spark, []), none).count() == 0


def test_keep_clean_keeps_columns(spark, odd):
    docs = documents(spark, odd)
    benchmark = spark.createDataFrame([(1, "repeated id")], "item_id long, text string")
    out = decontaminate.keep_clean(docs, benchmark)
    assert out.columns == docs.columns and out.count() == docs.count() - 1


# ---- personal data ----

def spans_of(text):
    return [(("email", "ip", "card", "phone")[k], s, e) for s, k, e in pii.plain(text or "")]


def test_plain_identifiers(spark, odd):
    rng = random.Random(5)
    parts = ["a.b@c.de", "@", "x@y", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 010-9999", "+", "-", " ", "5", "é", "@.com", "a@b.c@d.e", "+12", "007.1.2.3", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(2000)]
    for text in [*texts, *(t for _, t in odd if t and len(t) < 20_000)]:
        assert spans_of(text) == plain_pii(text), text


def test_find_pii_digest(spark, odd):
    for r in pii.find_pii(documents(spark, odd)).collect():
        own = [t for i, t in odd if i == r.doc_id]
        if len(own) == 1 and len(own[0] or "") < 20_000:
            base = plain_pii(own[0])
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone")]


DISGUISED = [
    ("write to jane.doe (at) mail [dot] example [dot] com now", "email", "jane.doe (at) mail [dot] example [dot] com"),
    ("jane at example dot com", "email", "jane at example dot com"),
    ("see jаne@exаmple.com today", "email", "jаne@exаmple.com"),
    ("x ja​ne@exam​ple.com y", "email", "ja​ne@exam​ple.com"),
    ("call + one five five five zero one zero nine nine nine nine", None, None),
    ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
    ("ip １０.0.0.１!", "ip", "１０.0.0.１"),
    ("tel +１ (555) 010-９999 x", "phone", "+１ (555) 010-９999"),
]


@pytest.mark.parametrize("text, kind, source", DISGUISED)
def test_disguises(text, kind, source):
    got = [(("email", "ip", "card", "phone")[k], text[s:e]) for s, k, e in pii.disguised(text, pii.plain(text))]
    if kind:
        assert (kind, source) in got


@pytest.mark.parametrize("text", ["we met at noon and at the dot of ten", "two of three, four or five", "plain a@b.co and 10.0.0.1", "café – naïve", "at example.com dot", "1 2 3 4 5 6"])
def test_clean_texts_have_no_added_spans(text):
    assert pii.disguised(text, pii.plain(text)) == []


ENDED = ["jane@firma [dot] gr", "jane@firma[.]mx", "jane at firma dot online", "jane@firma dot kr", "jane at firma [dot] cz", "j at x dot xn--p1ai"]


@pytest.mark.parametrize("source", ENDED)
def test_disguised_mail_of_any_ending(source):
    text = f"to {source}, now"
    assert pii._mask(text) == ("to [EMAIL], now",)
    assert pii._mask("look at the dot of it, at a dot zzz") == ("look at the dot of it, at a dot zzz",)


DOTTED = [
    "192[.]168[.]1[.]20", "192 dot 168 dot 1 dot 20", "192[.]168.1.20", "192.168.1[dot]20", "10 (dot) 0 (dot) 0 (punto) 1", "10 point 0 point 0 point 1",
    "one nine two dot one six eight dot one dot two zero", "１９２[.]168[.]1[.]20",
]


@pytest.mark.parametrize("source", DOTTED)
def test_disguised_dots_of_ip(source):
    text = f"host {source} or 10.0.0.1, up"
    assert [(k, text[s:e]) for s, k, e in pii.disguised(text, pii.plain(text))] == [(1, source)]
    assert pii._mask(text) == ("host [IP] or [IP], up",)
    clean = "1 dot 5 dot 2 and 300 dot 1 dot 1 dot 1"
    assert pii._mask(clean) == (clean,)


def test_masking(spark, odd):
    docs = documents(spark, [*odd, (900, "a jane@x.org b 10.0.0.1 c")])
    out = pii.mask_pii(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    row = out.filter("doc_id = 900").first()
    assert (row.text, row.n_chars) == ("a [EMAIL] b [IP] c", 18)
    assert out.count() == docs.count() and out.filter("doc_id = 40").first().text is None
    assert pii.mask_pii(documents(spark, [])).count() == 0


# ---- quality ----

def test_quality(spark, odd):
    for r in quality.judge(documents(spark, odd), out="q").select("doc_id", "text", "q.*").collect():
        want = measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        if r.text:
            assert r.ratio == pytest.approx(len(r.text.encode()) / len(zstandard.ZstdCompressor(level=3).compress(r.text.encode())))
        assert not (r.kept and r.base_failed)


def test_quality_bands(spark):
    rng = random.Random(6)
    letters = "etaoinshrdlucmfwyp"
    prose = lambda n: " ".join("".join(rng.choices(letters, range(len(letters), 0, -1), k=rng.randint(2, 9))) for _ in range(n))
    noise = " ".join("".join(rng.choices("".join(map(chr, range(0x100, 0x2000))), k=9)) for _ in range(400))
    stretch = prose(3000) + " " + " ".join(f"{k % 7}{k // 700}" for k in range(30_000))
    texts = [(1, prose(200)), (2, " ".join(f"{k}" for k in range(100, 400)) * 1), (3, noise), (4, stretch)]
    kept = {r.doc_id: r.q.kept for r in quality.judge(documents(spark, texts), out="q").collect()}
    assert kept[1] and not kept[3] and not kept[4]
    assert quality.limits(100) == (0.0, float("inf")) and quality.limits(1 << 40) == (1.45, 5.0)
    assert quality.limits(1024) == (1.3, 3.8) and 3.8 < quality.limits(1500)[1] < 4.2


COMMON = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her".split()


def mixture(rng, size, noise, repeated):
    """Sentences of common words, a share of random characters, a share of three sentences again and again."""
    sentence = lambda: " ".join(rng.choice(COMMON) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(rng.randint(6, 16))) + ". "
    own, text, tail = "".join(sentence() for _ in range(3)), "", ""
    while len(text) < size * (1 - noise - repeated):
        text += sentence()
    while len(tail) < size * repeated:
        tail += own
    return text + tail + " " + "".join(rng.choices(string.ascii_letters + string.digits, k=int(size * noise)))


def test_verdict_equals_a_plain_one(spark):
    rng = random.Random(12)
    texts = list(enumerate(mixture(rng, size, noise, repeated) for size in (300, 1000, 4000, 9000, 30_000) for noise in (0, 0.3, 0.6, 0.95) for repeated in (0, 0.3, 0.6) if noise + repeated < 1))
    texts += [(1000, None), (1001, ""), (1002, "a" * 255), (1003, "ab " * 3000)]
    rows = quality.judge(documents(spark, texts), out="q").select("doc_id", "q.*").collect()
    assert {r.doc_id: r.kept for r in rows} == {i: plain_kept(t) for i, t in texts}
    assert len({r.kept for r in rows if not r.base_failed}) == 2


@pytest.mark.parametrize("size, noise, repeated, kept", [
    (1000, 0, 0, True), (1000, 0.3, 0, True), (20_000, 0.2, 0, True), (20_000, 0.6, 0, False), (100_000, 0.5, 0, False),
    (20_000, 0, 0.2, True), (20_000, 0, 0.45, False), (100_000, 0, 0.45, False),
])
def test_where_the_limits_bite(size, noise, repeated, kept):
    """Shares of random characters and of repeated sentences beside ordinary ones, as in the README."""
    measured = quality._measure(mixture(random.Random(5), size, noise, repeated), zstandard.ZstdCompressor(level=quality.LEVEL))
    assert (measured[6] and measured[7] <= quality.BAD_CHUNKS) == kept


def test_labelled_good_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    assert not quality.judge(docs.filter("quality = 1").select("doc_id", "text"), out="q").filter("NOT q.base_failed AND NOT q.kept").count()


HINDI = (
    "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है "
    "और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। प्रत्येक व्यक्ति को जीवन, स्वाधीनता और वैयक्तिक सुरक्षा का अधिकार है। "
    "कोई भी गुलामी या दासता की हालत में न रखा जाएगा, गुलामी-प्रथा और गुलामों का व्यापार अपने सभी रूपों में निषिद्ध होगा।"
)


def test_ordinary_prose_stays(spark):
    """Licences, Hindi, and the made-up prose of earlier rounds, which compress better than the given good texts."""
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(["the", "of", "stone", "river", "walks", "under"]) + rng.choice("abcdefgh") * rng.randint(0, 2) + str(rng.randint(0, 99)) for _ in range(n))
    vocabulary = [f"{a}{b}{c}" for a in ("sto", "ri", "wal", "un", "gre") for b in ("ne", "ver", "king", "der") for c in ("s", "d", "")]
    small = " ".join(rng.choice(vocabulary) + rng.choice(["", ".", ","]) for _ in range(300))
    licences = [p.read_text() for name in ("GPL-3", "LGPL-2.1", "Apache-2.0") if (p := pathlib.Path("/usr/share/common-licenses", name)).exists()]
    texts = list(enumerate([prose(200), small, HINDI, *licences]))
    assert all(r.q.kept for r in quality.judge(documents(spark, texts), out="q").collect())
    repeated = [(0, " ".join(f"{k % 7}{k // 700}" for k in range(30_000)))]
    assert not quality.judge(documents(spark, repeated), out="q").first().q.kept


def test_every_chunk_is_judged(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choices("etaoinshrdlucmfwyp", k=rng.randint(2, 9))) for _ in range(n))[:n]
    noise = lambda n: base64.b64encode(rng.randbytes(n)).decode()[:n]
    texts = [
        (1, prose(4050) + noise(4050)), (2, prose(3900) + " " + noise(2200)), (3, prose(8192) + noise(4000)), (4, prose(4096) + "ab " * 1000),
        (5, prose(4097)), (6, prose(8100)), (7, prose(12_000) + noise(400)),
    ]
    found = {r.doc_id: r.q for r in quality.judge(documents(spark, texts), out="q").collect()}
    assert [i for i, q in sorted(found.items()) if q.kept] == [5, 6, 7]
    assert found[3].bad_chunk_share == 4000 / 12_192 and found[4].bad_chunk_share == 3000 / 7096 and found[6].bad_chunk_share == 0
    assert found[2].in_band and found[3].in_band


def test_quality_keeps_columns(spark):
    texts = [(1, "a b"), (2, None)]
    docs = documents(spark, texts)
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(docs).count() == 0
    assert quality.keep_good(documents(spark, [])).count() == 0


# ---- tokens ----

def test_token_counts_equal_the_library(spark, odd):
    library = Tokenizer.from_file(PATH)
    for r in tokens.token_counts(documents(spark, odd), PATH).collect():
        own = {t for i, t in odd if i == r.doc_id}
        counts = {(len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in own}
        assert (r.n_bytes, r.n_tokens) in counts and r.over_limit == (r.n_tokens > 512)


def test_every_prefix_count_equals_the_library():
    library, own, rng = Tokenizer.from_file(PATH), tokens.Vocabulary(PATH), random.Random(9)
    parts = ["a", "b", " ", " ", "\n", "'", "s", "'ll", "'re", "'ve", "é", "日", "1", "23", "!", "<|endoftext|>", "<|end", "\t", "the", "ing", "　", "\x1c", "\x85", "ß", "🙂"]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert own.prefix_counts(text).tolist() == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    monkeypatch.setattr(tokens, "REMEMBERED_IDS", 5)
    own, other = tokens.Vocabulary(PATH), Tokenizer.from_file(PATH)
    text = " ".join(f"word{k} other{k % 3}" for k in range(200)) + " " + "z" * 100
    assert own.prefix_counts(text)[-1] == len(other.encode(text).ids) == len(own.ids(text)) // 4


def test_fits_and_prefix_table(spark):
    docs = documents(spark, [(1, "the cat sat on the mat"), (2, None)])
    counts = {r.doc_id: r.counts for r in tokens.prefix_table(docs, PATH).collect()}
    assert counts[2] == [] and counts[1][-1] == 6
    fits = {r.doc_id: r.fits_chars for r in tokens.token_counts(docs, PATH, limit=3).collect()}
    assert "the cat sat on the mat"[: fits[1]] == "the cat sat" and fits[2] == 0


# ---- packing ----

def test_packing(spark, odd):
    import zlib

    library = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(documents(spark, odd), PATH, capacity=512).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        end = 0
        for at, length in sorted(own):
            assert at == end
            end += length
        assert end <= 512
    pieces = sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for i, text in odd:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 512 or 512
        starts = [0, *range(first, len(ids), 512)]
        want += [(i is None, i or 0, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
    assert pieces == sorted(want)
    least = -(-sum(r.length for r in rows) // 512)
    assert least <= len(by_sequence) <= least + 3
    assert packing.pack_documents(documents(spark, []), PATH).count() == 0


def test_pack_places_by_sum_of_squares():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 101, 500)
    sequence, offset = packing.pack(sizes, 100)
    # again, with the definition: after each placement, the least sum of squares among open sequences with room
    count, fill = {}, {}
    for i in np.argsort(-sizes, kind="stable"):
        s, place = int(sizes[i]), int(sequence[i])
        gap = 100 - fill.get(place, 0)
        rooms = [g for g, n in count.items() if n and g >= s]
        total = lambda g: sum((n - (k == g) + (k == g - s)) ** 2 for k, n in ({g - s: 0} | count).items() if k > 0)  # noqa: E731, B023
        if rooms:
            assert place in fill and total(gap) == min(map(total, rooms))
            count[gap] -= 1
        else:
            assert place not in fill
        assert offset[i] == fill.get(place, 0)
        fill[place] = fill.get(place, 0) + s
        if gap > s:
            count[gap - s] = count.get(gap - s, 0) + 1


# ---- toxicity ----

def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(7)
    bad, good = ["scumling", "scumlets", "rottener", "rottenest"], [f"word{k}" for k in range(80)]
    rows, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.3
        own = rng.choices(good, k=rng.randint(5, 60)) + (rng.choices(bad, k=2) if toxic else [])
        rng.shuffle(own)
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(toxic), "x"))
    rows += [(900, None), (901, ""), (None, "scumlets"), (3, rows[3][1]), (902, "w " * 50_000)]
    labels += [(3, 1, labels[3][2], "x"), (950, 1, 1, "x"), (None, 1, 1, "x"), (5, None, None, "x")]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    out = toxicity.toxicity(documents(spark, rows), table).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    truth = {i: t for i, _, t, _ in labels}
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 200 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_features_of_stretches(monkeypatch):
    text = " ".join(f"wörd{k % 97} x{k}" for k in range(3000))
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "STRETCH", 100)
    parts = toxicity.features(text)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])
    assert len(toxicity.features("ab")[0]) == 3 and len(toxicity.features(" \n")[0]) == 0  # " ab", "ab " and " ab "


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.toxicity(documents(spark, [(1, "a b"), (2, None)]), none).collect()] == [0.5, 0.5]
    assert toxicity.toxicity(documents(spark, []), none).count() == 0


def test_long_texts_are_judged_whole():
    text = "plain words here " * 20_000 + "10.0.0.1"
    assert plain_pii(text) == spans_of(text)


def test_results_of_a_batch_go_on_in_parts(spark, monkeypatch):
    """A worker holds the results of few rows at once; all rows come back in order."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from sheaf.llm import common

    sizes = []
    real = common.batch_of
    monkeypatch.setattr(common, "batch_of", lambda rows, schema: sizes.append(len(rows)) or real(rows, schema))
    held = {}
    monkeypatch.setattr(common, "arrow_udf", lambda run, schema: held.update(run=run) or (lambda text: text))
    common.text_column(lambda t: (t,), "text string")("x")
    texts = [None if i % 7 == 0 else f"t{i}" for i in range(1300)]
    out = list(held["run"](iter([pa.array(texts, pa.string()), pa.array([], pa.string())])))
    assert max(sizes) <= 512 and sum(sizes) == 1300
    assert [r["text"] for a in out for r in a.to_pylist()] == texts
    monkeypatch.undo()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    back = df.select("i", "text", common.text_column(lambda t: (t,), "again string")(F.col("text")).alias("r")).collect()
    assert len(back) == 1300 and all(r["text"] == r["r"]["again"] for r in back)
