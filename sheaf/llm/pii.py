"""Personal data, also in disguise, with spans in the source text.

Plain identifiers are found by pattern.  For disguised ones three transducers
rewrite the text and keep, for every character they write, the range of source
characters it stands for: homoglyphs and invisible characters, spelled digits,
and disguises of ``@`` and ``.``.  The same patterns then run over the result,
and what they find is mapped back.  A found span is added where it meets no
plain one.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from array import array

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import free_name, text_column
from sheaf.llm.endings import ENDINGS

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]++")
# No lead digit before a run: a match from inside a run of digits fails just as one from its start.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

# ---- fixed values: look-alikes of ASCII characters, by script, in the order of the ASCII ones ----
_CYRILLIC = dict(zip("асеһіјкорѕтхуԁԛԝАВСЕНІЈКМОРЅТХ", "acehijkopstxydqwABCEHIJKMOPSTX"))
_GREEK = dict(zip("ανορτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "avoptuikABEZHIKMNOPTYX"))
_MARKS = {"\u3002": ".", "\u2024": ".", "\u2010": "-", "\u2011": "-", "\u2013": "-", "\u2212": "-", "\ufe62": "+"}
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# ---- end of fixed values ----
_LOOKALIKE = {**_CYRILLIC, **_GREEK, **_MARKS}
# fullwidth forms, mathematical letters and digits, circled digits
_ODD_CHARS = re.compile("[" + re.escape("".join(_LOOKALIKE) + _INVISIBLE) + "\uff01-\uff5e\U0001d400-\U0001d7ff\u2460-\u2468\u24ea]")
_DIGIT_WORD = "(?:" + "|".join(sorted(map(re.escape, _DIGIT_WORDS), key=len, reverse=True)) + "|[0-9])"
_SPELLED = re.compile(rf"(?<!\w){_DIGIT_WORD}(?:[\s.,-]{{1,3}}{_DIGIT_WORD}(?!\w)){{2,}}", re.I)
_ONE_DIGIT = re.compile(rf"(?<!\w){_DIGIT_WORD}(?!\w)", re.I)
_NAME = r"[A-Za-z0-9-]+"
_AT_BRACKET, _DOT_BRACKET = r"\s*[\[({<]\s*(?:at|arroba|@)\s*[\])}>]\s*", r"\s*[\[({<]\s*(?:dot|punto|punkt|point|\.)\s*[\])}>]\s*"
_AT_WORD, _DOT_WORD = r"\s+(?:at|arroba)\s+", r"\s+(?:dot|punto|punkt)\s+"
# A bare word for "@" counts only before a disguised dot; a plain "@" needs a disguised dot too.
_DISGUISED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:(?P<at1>{_AT_BRACKET}){_NAME}(?:(?:\.|{_DOT_BRACKET}|{_DOT_WORD}){_NAME})+"
    rf"|(?P<at2>{_AT_WORD}|@){_NAME}(?:\.{_NAME})*(?:{_DOT_BRACKET}|{_DOT_WORD}){_NAME}(?:(?:\.|{_DOT_BRACKET}|{_DOT_WORD}){_NAME})*)",
    re.I,
)
_HINT = re.compile(r"[\[({<\s](?:at|arroba|@)[\])}>\s]|[\[({<\s](?:dot|punto|punkt|point|\.)[\])}>\s]", re.I)
_ANY_DOT = re.compile(rf"{_DOT_BRACKET}|{_DOT_WORD}", re.I)
_BRACKET_DOT = re.compile(_DOT_BRACKET, re.I)
# Four or more groups of digits or spelled digits between dots; which dots are disguised is looked up after.
_QUAD_DOT = rf"(?:\.|{_DOT_BRACKET}|\s+(?:dot|punto|punkt|point)\s+)"
_QUAD_WORDS = rf"{_DIGIT_WORD}(?:[\s-]{_DIGIT_WORD}){{0,2}}(?!\w)"
_QUAD = re.compile(rf"(?<![0-9])(?:[0-9]++|(?<!\w){_QUAD_WORDS})(?:{_QUAD_DOT}(?:[0-9]++|{_QUAD_WORDS})){{3,}}", re.I)
_ANY_QUAD_DOT = re.compile(_QUAD_DOT, re.I)
#: Characters around a disguise that are read again.
_REACH = 80

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def plain(text: str) -> list[Span]:
    """(start, kind, end) of plain identifiers, in order."""
    out = []
    floor, at = 0, text.find("@")
    while at >= 0:
        stop = at
        # back over the local part, in steps, so that a long text is not copied for each "@"
        begin, width = at, 64
        while begin > floor:
            low = max(floor, begin - width)
            run = _LOCAL.match(text[low:begin][::-1])
            if not run:
                break
            begin, width = begin - run.end(), width * 2
            if begin > low:
                break
        domain = _DOMAIN.match(text, at) if begin < at else None
        if domain:
            out.append((begin, 0, domain.end()))
            floor = stop = domain.end()
        at = text.find("@", max(stop, at + 1))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = "".join(_DIGITS.findall(m[0]))
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class Tape:
    """Text with the source range of every character."""

    def __init__(self, text: str, starts: array, ends: array):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def of(cls, text: str, at: int) -> Tape:
        return cls(text, array("q", range(at, at + len(text))), array("q", range(at + 1, at + len(text) + 1)))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Each (start, end, new) stands for its whole source range; edits in order."""
        text, starts, ends, at = [], array("q"), array("q"), 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a])
            starts.extend(self.starts[at:a])
            ends.extend(self.ends[at:a])
            if new:
                text.append(new)
                starts.extend([self.starts[a]] * len(new))
                ends.extend([self.ends[b - 1]] * len(new))
            at = b
        return Tape("".join(text), starts, ends)


def _unmask_chars(t: Tape) -> Tape:
    edits = []
    for m in _ODD_CHARS.finditer(t.text):
        c = m[0]
        new = "" if c in _INVISIBLE else _LOOKALIKE.get(c) or unicodedata.normalize("NFKC", c)
        edits.append((m.start(), m.end(), new))
    return t.rewrite(edits) if edits else t


def _unspell_digits(t: Tape) -> Tape:
    edits = []
    for run in _SPELLED.finditer(t.text):
        last = None
        words = list(_ONE_DIGIT.finditer(t.text, run.start(), run.end()))
        if all(w[0].isdigit() for w in words):
            continue
        for w in words:
            if last is not None and w.start() > last and t.text[last : w.start()].strip(" ,\t\n") == "":
                edits.append((last, w.start(), ""))
            edits.append((w.start(), w.end(), _DIGIT_WORDS.get(w[0].lower(), w[0])))
            last = w.end()
    return t.rewrite(edits) if edits else t


def _restore_email(t: Tape) -> Tape:
    edits = []
    for m in _DISGUISED.finditer(t.text):
        kind = "at1" if m["at1"] else "at2"
        # all in bare words: an address only with a registered ending
        if m["at2"] and m["at2"] != "@" and not _BRACKET_DOT.search(t.text, m.end(kind), m.end()):
            ending = re.split(r"[.\s]+", m[0])[-1].lower()
            if ending not in ENDINGS and not ending.startswith("xn--"):
                continue
        edits.append((*m.span(kind), "@"))
        edits += [(d.start(), d.end(), ".") for d in _ANY_DOT.finditer(t.text, m.end(kind), m.end())]
    return t.rewrite(edits) if edits else t


def _restore_ip(t: Tape) -> Tape:
    edits = []
    for m in _QUAD.finditer(t.text):
        at = m.start()
        for d in [*_ANY_QUAD_DOT.finditer(t.text, m.start(), m.end()), None]:
            group = t.text[at : d.start() if d else m.end()]
            if not group.isdigit():
                edits.append((at, at + len(group), "".join(_DIGIT_WORDS.get(w.lower(), w) for w in re.split(r"[\s-]", group))))
            if d:
                if d[0] != ".":
                    edits.append((d.start(), d.end(), "."))
                at = d.end()
    return t.rewrite(edits) if edits else t


def _regions(text: str) -> list[tuple[int, int]]:
    """Stretches that hold a sign of a disguise, with their surroundings, cut at white space and joined."""
    signs = [(m.start(), m.end()) for pattern in (_ODD_CHARS, _SPELLED, _HINT) for m in pattern.finditer(text)]
    out: list[list[int]] = []
    for a, b in sorted(signs):
        a, b = max(0, a - _REACH), min(len(text), b + _REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def disguised(text: str, known: list[Span]) -> list[Span]:
    """Spans that appear only once disguises are undone, apart from ``known``."""
    added = set()
    for a, b in _regions(text):
        t = source = Tape.of(text[a:b], a)
        for step in (_unmask_chars, _unspell_digits, _restore_ip, _restore_email):
            t = step(t)
        if t is source:
            continue
        for s, kind, e in plain(t.text):
            start, end = t.starts[s], t.ends[e - 1]
            # found as it stood, or cut off by the edge of the stretch: not an added one
            if t.text[s:e] == text[start:end] or (e == len(t.text) and b < len(text)) or (s == 0 and a > 0):
                continue
            added.add((start, kind, end))
    starts, ends = [], []  # what plain spans cover, as disjoint stretches
    for s, _, e in sorted(known):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out, last = [], [0] * len(KINDS)
    for s, kind, e in sorted(added):
        before = bisect.bisect_left(starts, e)
        if s >= last[kind] and (not before or ends[before - 1] <= s):
            out.append((s, kind, e))
            last[kind] = e
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


FOUND = "n_email long, n_ip long, n_card long, n_phone long, n_added long, base string, spans string"


def _find(text: str | None) -> tuple:
    if not text:
        return 0, 0, 0, 0, 0, "", ""
    base = plain(text)
    more = disguised(text, base)
    counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
    return *counts, len(more), _joined(base), _joined(sorted([*base, *more]))


find = text_column(_find, FOUND)


def _mask(text: str | None) -> tuple:
    """Each span, or joined overlapping spans, as [KIND] of the first."""
    if not text:
        return (text,)
    base = plain(text)
    out, at = [], 0
    for s, k, e in sorted([*base, *disguised(text, base)]):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return ("".join([*out, text[at:]]) if out else text,)


mask = text_column(_mask, "text string")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, plain counts by kind, base_sha256 of the plain spans, n_added, spans.

    Spans are code points, end exclusive, ordered by start, then kind.  Null
    and empty texts have none.  Rows are judged alone; other columns are not
    read; an empty table gives no rows.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), find(F.col(text_col)).alias("f"))
    return found.select(
        "doc_id", "f.n_email", "f.n_ip", "f.n_card", "f.n_phone", F.sha2(F.col("f.base").cast("binary"), 256).alias("base_sha256"), "f.spans", "f.n_added"
    )


def mask_pii(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The same rows with identifiers replaced by their kind; ``chars_col`` follows the new text.

    Null texts and null sizes stay null.  Rows are rewritten alone, repeated ones
    too; all other columns stay as they are, whatever their names; an empty
    table stays empty.
    """
    held = free_name(docs, "__masked")
    new = F.col(f"{held}.text")
    masked = docs.withColumn(held, mask(F.col(text_col)))

    def out(c: str) -> Column:
        if c == text_col:
            return new.alias(c)
        if c == chars_col:
            return F.when(F.col(f"`{c}`").isNotNull() & new.isNotNull(), F.char_length(new)).otherwise(F.col(f"`{c}`")).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"`{c}`")

    return masked.select(*[out(c) for c in docs.columns])
