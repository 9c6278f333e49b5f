"""Column functions for text, numbers and paths.  All but ``nfkc`` stay in the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# All characters that count as white space: the Unicode white space and the
# four ASCII separators.
_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_WS = f"[{_BLANKS}]"


def pattern(regex: str) -> str:
    """A regex with Unicode classes, and newline as the only line terminator."""
    return "(?dU)" + regex


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def clean(c: Column) -> Column:
    """Text without outer white space; blank becomes null."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def squeeze(c: Column) -> Column:
    """Inner runs of white space become one blank, outer ones vanish."""
    return F.regexp_replace(strip(c), f"{_WS}+", " ")


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def match_key(c: Column) -> Column:
    """Comparison key: no white space at all, case folded, blank is null."""
    return F.nullif(casefold(F.regexp_replace(c, f"{_WS}+", "")), F.lit(""))


def header_key(c: Column) -> Column:
    """Header comparison key: newline and wide blank count as a blank."""
    return strip(F.translate(c, "\n　", "  "))


def _normal_form(form: str):
    # a nested function travels to the tasks by value: executors need no copy
    # of this package
    def normalise(s: pd.Series) -> pd.Series:
        return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize(form, v))

    return F.pandas_udf(normalise, T.StringType())


nfkc = _normal_form("NFKC")


def template_key(c: Column) -> Column:
    """Template comparison key: NFKC with squeezed blanks, null as empty."""
    return squeeze(F.coalesce(nfkc(c), F.lit("")))


def clip(c: Column, n: int) -> Column:
    """At most ``n`` characters of squeezed text, with an ellipsis if cut."""
    s = squeeze(c)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(F.nullif(s, F.lit("")))


def table_cell(c: Column) -> Column:
    """Text that cannot break a pipe table."""
    s = strip(F.translate(F.coalesce(c, F.lit("")), "|\n\r", "／  "))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("—"))


def to_number(c: Column) -> Column:
    """The number in a text, or null; a number with a type letter, as ``1d``, is none."""
    return F.when(~c.rlike(r"(?i)[0-9.][df]\s*$"), c.try_cast("double"))


def int_if_whole(c: Column) -> Column:
    """A number as text, without decimals if it is whole."""
    whole = c == F.floor(c)
    return F.when(whole, F.floor(c).cast("string")).otherwise(c.cast("string"))


def suffix(c: Column) -> Column:
    """Lower-case file suffix with its dot; a leading dot starts no suffix."""
    return F.lower(F.regexp_extract(basename(c), r"(?s)^.+(\.[^.]+)$", 1))


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def fixed1(c: Column) -> Column:
    """One decimal, ties to even."""
    return F.bround(c.cast("decimal(38,20)"), 1).cast("string")


def fixed0(c: Column) -> Column:
    """No decimals, ties away from zero."""
    return F.round(c.cast("decimal(38,20)"), 0).cast("decimal(38,0)").cast("string")


def general(c: Column) -> Column:
    """Shortest form with six significant digits."""
    size = F.abs(c)
    exact = c.cast("decimal(38,20)")
    out = F.bround(exact, 0)
    for digits in range(1, 6):
        out = F.when(size < 10 ** (6 - digits), F.bround(exact, digits)).otherwise(out)
    text = out.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def estimate_tokens(c: Column) -> Column:
    """CJK characters count one each, four of any other count one."""
    wide = F.length(F.regexp_replace(c, "[^一-鿿　-ヿ]", ""))
    return wide + F.floor((F.length(c) - wide) / 4)


def fill(template: str, **parts: Column) -> Column:
    """``"a {x} b"`` as a concat expression; a null part is an empty text."""
    pieces = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            pieces.append(F.coalesce(parts[piece].cast("string"), F.lit("")))
        elif piece:
            pieces.append(F.lit(piece))
    return F.concat(*pieces) if pieces else F.lit("")


def lookup_map(table: dict[str, object]) -> Column:
    """A small fixed dictionary as a map literal."""
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])


# ---- hierarchical paths ----------------------------------------------------


def normalize_path(c: Column) -> Column:
    """NFKC, each ``/`` part stripped, empty parts dropped."""
    parts = F.transform(F.split(nfkc(c), "/"), strip)
    return F.array_join(F.filter(parts, lambda p: p != ""), "/")


def ancestors(c: Column) -> Column:
    """``a/b/c`` -> [``a``, ``a/b``, ``a/b/c``]; an empty path has none."""
    parts = F.split(c, "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(upto)


def display_ref(code: Column, path: Column) -> Column:
    """``五/(二)/2`` -> ``R03 五、(二) 2``; one part is shown as it is."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    first = F.get(parts, F.lit(0))
    rest = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p, i: F.when(p.startswith("(") | (i == 0), p).otherwise(F.concat(F.lit(" "), p)),
    )
    return (
        F.when(F.size(parts) == 0, code)
        .when(F.size(parts) == 1, F.concat_ws(" ", code, first))
        .otherwise(F.concat(code, F.lit(" "), first, F.lit("、"), F.array_join(rest, "")))
    )


def natural_key(c: Column) -> Column:
    """Sort key of ``a-b`` ids: numbers part by part, no number counts 0."""
    return F.transform(F.split(c, "-"), lambda p: F.coalesce(p.try_cast("double"), F.lit(0.0)))
