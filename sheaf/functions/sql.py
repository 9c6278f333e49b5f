"""The text functions under SQL names, for queries written in SQL alone.

Each is a SQL function whose body is an expression, so Catalyst puts it in
place: it costs what the column function of the same meaning costs, and filters
and pruning work through it.  What has several results is an array, to be opened
by ``inline`` or ``explode`` outside the select that makes it
(``FROM (SELECT id, parse_refs(raw) AS found FROM t) LATERAL VIEW inline(found)``), so
that it stays within its row; a SQL table function would become a join on the text.  Only ``nfkc`` and ``nfkc_all`` run in
Python, in Arrow batches.

A null argument gives null, of ``parse_refs`` and ``split_sentences`` too (which then
open to no rows); ``table_cell`` gives a dash.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf import presets as P
from sheaf.functions import text as X

_PLACES = 1 << 31


def _nfkc_all():
    def normalise(s: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            return v if v is None or v.isascii() else unicodedata.normalize("NFKC", v)

        return s.map(lambda vs: None if vs is None else [one(v) for v in vs])

    return F.pandas_udf(normalise, T.ArrayType(T.StringType()))


def _text(value: str) -> str:
    """A SQL literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _strip(x: str) -> str:
    return f"btrim({x}, {_text(X._BLANKS)})"


def _squeeze(x: str) -> str:
    return f"regexp_replace({_strip(x)}, {_text(X._WS + '+')}, ' ')"


def _path(x: str) -> str:
    return f"array_join(filter(transform(split({x}, '/'), p -> {_strip('p')}), p -> p <> ''), '/')"


def _head(x: str) -> str:
    return f"regexp_extract({x}, {_text(X.pattern(P.REF_HEAD))}, 1)"


def _tail(x: str) -> str:
    return f"substr({x}, length({_head(x)}) + 1)"


def _unbroken(x: str) -> str:
    """Characters that would end a table cell, replaced."""
    broken, instead = _text("|\n\r"), _text("／  ")
    return f"translate(coalesce({x}, ''), {broken}, {instead})"


_QUOTED = "concat('\\\\Q', sep, '\\\\E')"
_PARTS = "filter(split(path, '/'), p -> p <> '')"

# name -> (arguments, result, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "strip_text": ("s STRING", "STRING", _strip("s")),
    "clean_text": ("s STRING", "STRING", f"nullif({_strip('s')}, '')"),
    "squeeze_text": ("s STRING", "STRING", _squeeze("s")),
    "match_key": (
        "s STRING", "STRING", f"nullif(replace(lower(regexp_replace(s, {_text(X._WS + '+')}, '')), 'ß', 'ss'), '')",
    ),
    "clip_text": (
        "s STRING, n INT", "STRING",
        f"CASE WHEN length({_squeeze('s')}) > n THEN concat(substr({_squeeze('s')}, 1, n), '…') ELSE nullif({_squeeze('s')}, '') END",
    ),
    "table_cell": (
        "s STRING", "STRING", f"coalesce(nullif({_strip(_unbroken('s'))}, ''), '—')",
    ),
    "estimate_tokens": (
        "s STRING", "BIGINT",
        "length(regexp_replace(s, '[^一-鿿　-ヿ]', '')) + floor((length(s) - length(regexp_replace(s, '[^一-鿿　-ヿ]', ''))) / 4)",
    ),
    "normalize_path": ("s STRING", "STRING", _path("nfkc(s)")),
    "ancestors": (
        "path STRING", "ARRAY<STRING>",
        "CASE WHEN path = '' THEN CAST(array() AS ARRAY<STRING>) ELSE "
        "transform(sequence(1, size(split(path, '/'))), n -> array_join(slice(split(path, '/'), 1, n), '/')) END",
    ),
    "display_ref": (
        "code STRING, path STRING", "STRING",
        f"CASE WHEN size({_PARTS}) = 0 THEN code WHEN size({_PARTS}) = 1 THEN concat_ws(' ', code, {_PARTS}[0]) "
        f"ELSE concat(code, ' ', {_PARTS}[0], '、', array_join(transform(slice({_PARTS}, 2, greatest(size({_PARTS}) - 1, 0)), "
        "(p, i) -> CASE WHEN startswith(p, '(') OR i = 0 THEN p ELSE concat(' ', p) END), '')) END",
    ),
    "natural_key": ("s STRING", "ARRAY<DOUBLE>", "transform(split(s, '-'), p -> coalesce(try_cast(p AS DOUBLE), 0.0D))"),
    "split_sentences": (
        f"body STRING, sep STRING DEFAULT {_text(P.SENTENCE_END)}", "ARRAY<STRING>",
        # the parts are bound to a name, so that a text is split once and not again for each of its parts
        f"get(transform(array(split(body, {_QUOTED})), ps -> filter(transform(ps, (p, i) -> CASE WHEN i < size(ps) - 1 THEN concat(p, sep) ELSE p END), p -> p <> '')), 0)",
    ),
    "parse_refs": (
        "raw STRING", "ARRAY<STRUCT<ref_idx: BIGINT, reg_code: STRING, section_path_prefix: STRING>>",
        f"flatten(transform(transform(nfkc_all(split(raw, {_text(P.REF_SPLIT)})), x -> {_path('x')}), (e, k) -> "
        f"transform(regexp_extract_all({_head('e')}, {_text(X.pattern(P.REF_CODE))}, 0), (c, j) -> "
        f"named_struct('ref_idx', k * {_PLACES}L + j, 'reg_code', c, 'section_path_prefix', "
        f"CASE WHEN startswith({_tail('e')}, '/') THEN {_path(_tail('e'))} ELSE '' END))))",
    ),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Makes the functions callable from SQL in this session; their names."""
    spark.udf.register("nfkc", X.nfkc)
    spark.udf.register("nfkc_all", _nfkc_all())
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return ["nfkc", "nfkc_all", *FUNCTIONS]
