"""Quality rules: word counts of a text and zstandard compression bands.

Repetitive text compresses too well, random text hardly at all.  How well
ordinary text compresses depends on its length, so the limits do too.  Whole
texts are judged, and fixed chunks of them, so that a long text cannot hide a
repetitive or random stretch.
"""

from __future__ import annotations

import math

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import free_name, run_hashes, text_column, word_hashes

#: Least and greatest ratio of raw to compressed size at powers of two of UTF-8 bytes; between them by
#: the logarithm of the length, below the first none.  The greatest ones are wide, so that ordinary
#: text of several languages and scripts meets them; repetition is left to the chunks and the counts.
LEAST = ((8, 1.10), (9, 1.20), (10, 1.30), (12, 1.40), (16, 1.45))
GREATEST = ((8, 3.0), (9, 3.3), (10, 3.8), (12, 4.4), (16, 5.0))
#: Bytes of a chunk, and the share of bytes in chunks outside the limits of their length that rejects a text.
CHUNK, BAD_CHUNKS = 4096, 0.3
LEVEL = 3
_SPACE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, in_band boolean, bad_chunk_share double"


def limits(size: int) -> tuple[float, float]:
    """Least and greatest ratio of a text of so many bytes."""
    if size < 1 << LEAST[0][0]:
        return 0.0, math.inf
    at = math.log2(size)
    return float(np.interp(at, *zip(*LEAST))), float(np.interp(at, *zip(*GREATEST)))


def _ratio(data: bytes, zstd: zstandard.ZstdCompressor) -> tuple[float, bool]:
    """The ratio, and whether it lies within the limits."""
    ratio = len(data) / len(zstd.compress(data))
    low, high = limits(len(data))
    return ratio, low <= ratio <= high


def _measure(text: str | None, zstd: zstandard.ZstdCompressor) -> tuple:
    if not text:
        return 0, 0, 0, 0, 0, 0.0, True, 0.0
    data = text.encode()
    words = data.split()
    n = len(words)
    runs = run_hashes(word_hashes(words), 3) if n >= 3 else np.empty(0, np.uint64)
    _, which, counts = np.unique(runs, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[which] > 1)
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[again + k] = True
    lines = [line for line in data.split(b"\n") if line.strip()]
    # every chunk of a text beyond one, the shorter last one by the limits of its own length
    chunks = [data[at : at + CHUNK] for at in range(0, len(data), CHUNK)] if len(data) > CHUNK else []
    return (
        n, len(text) - (len(data) - len(data.translate(None, _SPACE))), len(data) - len(data.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)), int(hit.sum()), *_ratio(data, zstd),
        sum(len(c) for c in chunks if not _ratio(c, zstd)[1]) / len(data),
    )


measures = text_column(_measure, MEASURES, lambda: zstandard.ZstdCompressor(level=LEVEL))


def verdict(m: Column) -> tuple[Column, Column]:
    """Base failure, and whether the text stays."""
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return failed, ~failed & m["in_band"] & (m["bad_chunk_share"] <= BAD_CHUNKS)


def judge(docs: DataFrame, text_col: str = "text", out: str = "quality") -> DataFrame:
    """All rows and columns, with a struct ``out``: the measures, base_failed and kept.

    Null and empty texts have no words and fail.  Each row is judged alone, so
    ids, ties, repeated rows and other columns do not matter; only ``out`` must
    be a new name.
    """
    held = free_name(docs, f"__{out}")
    failed, kept = verdict(F.col(held))
    return docs.withColumn(held, measures(F.col(text_col))).select(
        *[F.col(f"`{c}`") for c in docs.columns], F.struct(f"{held}.*", failed.alias("base_failed"), kept.alias("kept")).alias(out)
    )


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``, whatever their names.

    Null and empty texts go.  Each row is judged alone, so repeated rows stay or
    go together; an empty table stays empty.
    """
    verdict = free_name(docs, "__verdict")
    return judge(docs, text_col, verdict).filter(F.col(verdict)["kept"]).drop(verdict)
