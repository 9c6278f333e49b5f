"""Benchmark decontamination by Wu-Manber search over words.

The patterns are windows of consecutive item words.  For patterns of one
length, a shift table tells for a block of two words how far the next possible
end of a window is, so most words of a text are never looked at.  Where the
shift is zero, the block is the suffix of some windows: its hash bucket lists
them, and comparing the words decides.  Items shorter than a window are
patterns of their own length, each length with its own table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sheaf.functions.session import materialise
from sheaf.llm.common import batch_of, free_name, texts_of

WINDOW = 13
#: Item words whose tables one task holds; a larger benchmark is searched in several passes.
BLOCK_WORDS = 300_000
#: Item words kept together; longer items are cut with an overlap of a window less one word.
SEGMENT_WORDS = 20_000

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8: lower-cased A-Z, runs of digits, letters and all beyond ASCII."""
    return _WORDS.findall(text.encode().lower()) if text else []


class Patterns:
    """Search tables for all windows of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[int]]] = {}
        self._seen: set[tuple] = set()

    def add(self, window: tuple, item: int) -> None:
        m, b = self.length, self.block
        suffix = window[m - b :]
        if window not in self._seen:
            self._seen.add(window)
            for end in range(b, m + 1):
                block = window[end - b : end]
                if self.shift.get(block, m) > m - end:
                    self.shift[block] = m - end
        items = self.buckets.setdefault(suffix, {}).setdefault(window, [])
        if not items or items[-1] != item:
            items.append(item)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(first word, items) of every occurrence, ends in order."""
        m, b, n = self.length, self.block, len(words)
        far, shift, buckets = m - b + 1, self.shift.get, self.buckets
        end = m
        while end <= n:
            block = tuple(words[end - b : end])
            step = shift(block, far)
            if step:
                end += step
                continue
            items = buckets[block].get(tuple(words[end - m : end]))
            if items:
                yield end - m, items
            end += 1


class Index:
    """Search tables of one block of item segments: (item, words), items numbered."""

    def __init__(self, segments: Sequence[tuple[int, Sequence[bytes], bool]], window: int):
        by_length: dict[int, Patterns] = {}
        for item, words, whole in segments:
            size = min(window, len(words))
            if not size or (size < window and not whole):
                continue
            table = by_length.setdefault(size, Patterns(size))
            for at in range(len(words) - size + 1):
                table.add(tuple(words[at : at + size]), item)
        self.tables = list(by_length.values())

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit ranges of words (joined, in order) and the items found."""
        found, items = [], set()
        for table in self.tables:
            for at, of in table.search(words):
                found.append((at, at + table.length))
                items.update(of)
        return joined(found), items


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


FOUND = "n_words long, starts array<int>, ends array<int>, items array<string>"


def _scan(segments: list[tuple[str, list[bytes], bool]], window: int):
    """A column function: finds the windows of these segments in texts, added to what an earlier pass found."""

    @arrow_udf(FOUND)
    def scan(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        names = sorted({s[0] for s in segments})
        number = {name: k for k, name in enumerate(names)}
        index = Index([(number[i], words, whole) for i, words, whole in segments], window)
        for texts, before in batches:
            rows = []
            for text, old in zip(texts_of(texts), before.to_pylist()):
                words = words_of(text)
                ranges, items = index.search(words) if words else ([], set())
                named = {names[k] for k in items}
                if old:
                    ranges, named = joined([*ranges, *zip(old["starts"], old["ends"])]), named | set(old["items"])
                rows.append((len(words), [a for a, _ in ranges], [b for _, b in ranges], sorted(named)))
            yield batch_of(rows, FOUND)

    return scan


def _segments(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Item words in segments: item, part, n (words), whole, words (UTF-8, joined by blanks)."""
    schema = "item string, part int, n int, whole boolean, words binary"
    arrow = pa.schema([("item", pa.string()), ("part", pa.int32()), ("n", pa.int32()), ("whole", pa.bool_()), ("words", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(body)
                for part, at in enumerate(range(0, max(1, len(words) - window + 1), SEGMENT_WORDS)):
                    own = words[at : at + SEGMENT_WORDS + window - 1]
                    if own:
                        rows.append({"item": item, "part": part, "n": len(own), "whole": len(own) == len(words), "words": b" ".join(own)})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).filter("item IS NOT NULL").mapInArrow(cut, schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, out: str = "contamination", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """All rows and columns, with a struct ``out``: n_words, starts and ends (hit ranges of words), items.

    The benchmark is cut into blocks of about ``block_words`` words by a hash;
    each block is one pass over the texts, so a task's tables stay bounded, and
    every pass but the last is written to the shared folder.  Null and empty
    texts have no words; items without words, or without an id, are no
    patterns; repeated items and rows count as they are (an item once).  An
    empty benchmark finds nothing.  Other columns are not read.
    """
    segments = _segments(benchmark, item_id, item_text, window)
    total = segments.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_words))
    found = docs.withColumn(out, F.lit(None).cast("struct<n_words:bigint,starts:array<int>,ends:array<int>,items:array<string>>"))
    for k in range(blocks):
        own = segments.filter(F.pmod(F.xxhash64("item", "part"), F.lit(blocks)) == k).collect()  # about block_words words
        if k:
            found = materialise(found)
        scan = _scan([(r["item"], bytes(r["words"]).split(b" "), r["whole"]) for r in own], window)
        found = found.withColumn(out, scan(F.col(text_col), F.col(out)))
    return found


def n_hit(found: Column) -> Column:
    return F.aggregate(F.arrays_zip(found["starts"], found["ends"]), F.lit(0).cast("long"), lambda n, r: n + r["ends"] - r["starts"])


def contaminated(found: Column) -> Column:
    """A twentieth of the words or more are hit."""
    return (n_hit(found) > 0) & (20 * n_hit(found) >= found["n_words"])


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits.  Rows are judged alone,
    repeated ones and null ids too; other columns are not read.  An empty
    table gives no rows, an empty benchmark no hits.  Items of a null id are
    not searched for, as they have no name to report.
    """
    options.setdefault("text_col", "text")
    found = contamination(docs.select(F.col(id_col).alias("doc_id"), F.col(options["text_col"])), benchmark, "__found", **options)
    f = F.col("__found")
    return found.select(
        "doc_id", f["n_words"].alias("n_words"), n_hit(f).alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(f["items"], ",").cast("binary"), 256).alias("items_sha256"), contaminated(f).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows that are not contaminated, with the columns of ``docs``, whatever their names.

    Null and empty texts stay.  Rows are judged alone, so repeated rows stay or
    go together; an empty table stays empty, an empty benchmark keeps all.
    """
    found = free_name(docs, "__found")
    return contamination(docs, benchmark, found, **options).filter(~contaminated(F.col(found))).drop(found)
