"""Token ids and exact token counts of byte-level BPE vocabularies.

A text is cut into the vocabulary's pieces (words with their leading blank,
numbers, signs, white space); each distinct piece is encoded once per task and
then looked up, because words repeat far more often than texts.

Counts come from a dynamic programme over the prefixes of a piece: of the
tokens that end at a position, exactly one goes together with the last token of
the prefix before it, so ``count[i] = count[i - len(token)] + 1``.  Two tokens go
together if encoding their joined bytes gives these two.  This yields the exact
count of every prefix of a text, which answers questions about truncation and
budgets without encoding again.
"""

from __future__ import annotations

import functools
import itertools
import operator
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from tokenizers import Tokenizer, pre_tokenizers

from sheaf.llm.common import batch_of, texts_of

#: The split of byte-level vocabularies (fixed value); white space as Unicode has it.
_SPACE = r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_NO_SPACE = _SPACE.replace("[", "[^", 1)
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?{_NO_SPACE[:-1]}\p{{L}}\p{{N}}]+|{_SPACE}+(?!{_NO_SPACE})|{_SPACE}+"
SPLIT_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Distinct pieces with their ids, pieces with their counts, prefixes and token pairs that a worker
#: remembers, and the length of those that it does.
REMEMBERED_IDS, REMEMBERED, REMEMBERED_LENGTH = 150_000, 400_000, 40


def _alphabet() -> dict[int, str]:
    """The letter that stands for each byte."""
    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    out = {}
    for c in map(chr, range(256)):
        letters = level.pre_tokenize_str(c)[0][0]
        for byte, letter in zip(c.encode(), letters):
            out[byte] = letter
    # bytes that occur only in longer UTF-8 forms, and those in none
    for lead in range(0xC2, 0xF5):
        form = next((f for f in (bytes([lead, *t]) for t in (b"\x80", b"\xa0\x80", b"\x80\x80", b"\x90\x80\x80", b"\x80\x80\x80")) if _is_text(f)), None)
        if form:
            for byte, letter in zip(form, level.pre_tokenize_str(form.decode())[0][0]):
                out[byte] = letter
    return out


def _is_text(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def _last_step(steps: bytes) -> int:
    return int(np.frombuffer(steps, "<i2")[-1])


class Memory(dict):
    """Values of pieces, computed when first asked for.

    A full memory becomes the old one, from which what is asked for again
    comes back; so frequent pieces stay and rare ones go.
    """

    def __init__(self, compute, size: int):
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.compute(piece)
            if len(piece) > REMEMBERED_LENGTH:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value


class Vocabulary:
    """A byte-level BPE vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.known = {t: i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.longest = max(map(len, self.known))
        self.split, self.split_ascii = regex.compile(SPLIT), re.compile(SPLIT_ASCII)
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.two_spaces, self.two_ascii = regex.compile(_SPACE * 2), re.compile(r"[\t-\r ]{2}")
        self.spaces = regex.compile(_SPACE + "+")
        self.alphabet = _alphabet()
        self.id_bytes, self.steps = Memory(self._encode, REMEMBERED_IDS), Memory(self._piece_steps, REMEMBERED)
        self.prefixes: dict[str, tuple] = {"": ([""], [0])}
        self.pairs: dict[str, dict[str, bool]] = defaultdict(dict)
        self.n_pairs = 0

    def _split(self, text: str) -> list[str]:
        return (self.split_ascii if text.isascii() else self.split).findall(text)

    def _parts(self, text: str) -> Iterator[tuple[str, str | None]]:
        """Stretches of ordinary text, each with the special token after it."""
        at = 0
        if self.cut and any(s in text for s in self.special):
            for m in self.cut.finditer(text):
                yield text[at : m.start()], m[0]
                at = m.end()
        yield text[at:], None

    # ---- ids ----

    def _letters(self, piece: str) -> str:
        """A piece in the vocabulary's alphabet, one letter for each byte."""
        if piece.isascii() and piece.isprintable():
            return piece.replace(" ", self.alphabet[32])
        return piece.encode().decode("latin-1").translate(self.alphabet)

    def _encode(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(self._letters(piece))]).tobytes()

    def ids(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers; special strings as the library has them."""
        out = []
        for ordinary, special in self._parts(text):
            out += map(self.id_bytes.__getitem__, self._split(ordinary))
            if special:
                out.append(array("I", [self.special[special]]).tobytes())
        return b"".join(out)

    # ---- counts of prefixes ----

    def _goes_together(self, left: str, right: str) -> bool:
        found = [t.value for t in self.tokenizer.model.tokenize(left + right)]
        if self.n_pairs >= REMEMBERED:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        self.pairs[left][right] = found == ([left, right] if left else [right])
        return self.pairs[left][right]

    def _counts(self, letters: str) -> tuple[int, ...]:
        """Tokens of each prefix of a piece, in bytes; the work on prefixes that pieces share is remembered."""
        seen, known, pairs, longest = self.prefixes, self.known, self.pairs, self.longest
        n = at = len(letters)
        while (state := seen.get(letters[:at])) is None:
            at -= 1
        if at == n:
            return state[1]
        # the token that ends each prefix, and how many there are
        last, count = list(state[0]), list(state[1])
        for i in range(at + 1, n + 1):
            for j in range(i - 1, max(0, i - longest) - 1, -1):
                token = letters[j:i]
                if token in known:
                    left = last[j]
                    together = pairs[left].get(token)
                    if together is None:
                        together = self._goes_together(left, token)
                    if together:
                        last.append(token)
                        count.append(count[j] + 1)
                        break
            else:
                raise ValueError("the vocabulary lacks single bytes")
            if i <= REMEMBERED_LENGTH:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                    seen[""] = ([""], [0])
                seen[letters[:i]] = tuple(last), tuple(count)
        return tuple(count)

    def _piece_steps(self, piece: str) -> bytes:
        count = self._counts(self._letters(piece))
        if len(count) > len(piece) + 1:
            count = [0, *(count[e] for e in itertools.accumulate(len(c.encode()) for c in piece))]
        if piece in ("'re", "'ve", "'ll"):
            count = [*count[:2], 2, count[3]]  # pieces only once they are whole
        return array("h", map(operator.sub, count[1:], count)).tobytes()

    def _ordinary(self, text: str) -> np.ndarray:
        pieces = self._split(text)
        steps = np.frombuffer(b"".join(map(self.steps.__getitem__, pieces)), "<i2")
        if not (self.two_ascii if text.isascii() else self.two_spaces).search(text):
            return steps
        # A run of white space is one piece while it ends the prefix; its last
        # character goes with the next word as soon as there is one.
        steps, at = steps.astype("<i4"), 0
        for left, right in zip(pieces, pieces[1:]):
            at += len(left)
            if self.spaces.fullmatch(left) and self.spaces.match(right):
                off = _last_step(self._piece_steps(left + right[0])) - _last_step(self._piece_steps(right[0]))
                steps[at] += off
                steps[at + 1] -= off
        return steps

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact token count of every prefix of a text, by code points from 1."""
        out, done = [], 0
        for ordinary, special in self._parts(text):
            counts = self._ordinary(ordinary + (special[:-1] if special else "")).cumsum(dtype=np.int64) + done
            out.append(counts)
            if special:
                done = (int(counts[len(ordinary) - 1]) if ordinary else done) + 1
                out.append(np.array([done]))
        return np.concatenate(out)


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process, with what it remembers."""
    return Vocabulary(path)


COUNTED = "n_bytes long, n_tokens long, fits_chars long"


def counted(text: Column, path: str, limit: int) -> Column:
    """n_bytes, n_tokens, and fits_chars: code points of the longest prefix of at most ``limit`` tokens."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(path)
        for batch in batches:
            rows = []
            for body in texts_of(batch):
                counts = vocab.prefix_counts(body or "")
                fits = np.flatnonzero(counts <= limit)
                rows.append((len((body or "").encode()), int(counts[-1]) if len(counts) else 0, int(fits[-1]) + 1 if len(fits) else 0))
            yield batch_of(rows, COUNTED)

    return arrow_udf(run, COUNTED)(text)


def prefix_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``counts``: the token count of every prefix of the text, one number per code point."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(path)
        for batch in batches:
            yield pa.array([vocab.prefix_counts(body or "") for body in texts_of(batch)], pa.list_(pa.int64()))

    return docs.select(F.col(id_col).alias("doc_id"), arrow_udf(run, "array<long>")(F.col(text_col)).alias("counts"))


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit, fits_chars.

    Null texts are empty: no bytes, no tokens.  Rows are counted alone, so
    repeated rows and ids do not matter; other columns are not read; an empty
    table gives no rows.
    """
    return docs.select(F.col(id_col).alias("doc_id"), counted(F.col(text_col), path, limit).alias("c")).select(
        "doc_id", "c.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"), "c.fits_chars"
    )


PIECES = "starts array<long>, lengths array<long>, crcs array<long>"


def token_pieces(text: Column, path: str, capacity: int, end_id: int = 0) -> Column:
    """Pieces of at most ``capacity`` ids of text and end id: starts, lengths, crc32 of the ids.

    Only the first piece of a longer text may be shorter than the capacity.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab, end = vocabulary(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for body in texts_of(batch):
                ids = vocab.ids(body or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                starts = [0, *range(first, n, capacity)]
                ends = [*starts[1:], n]
                rows.append((starts, [b - a for a, b in zip(starts, ends)], [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts, ends)]))
            yield batch_of(rows, PIECES)

    return arrow_udf(run, PIECES)(text)
