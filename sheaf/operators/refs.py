"""Regulation references: parsing and hierarchical matching (REF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf import presets as P
from sheaf.functions import text as X


def _entries(df: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """One row per non-empty entry, with its codes and path.

    Entries are split before normalising, so a wide semicolon separates
    nothing.  The normaliser is the only Python step.
    """
    split = df.select(*keys, F.posexplode(F.split(F.col(raw), P.REF_SPLIT)).alias("entry_idx", "__raw"))
    entry = split.withColumn("__entry", X.normalize_path(F.col("__raw"))).filter(F.col("__entry") != "")
    head = F.regexp_extract("__entry", X.pattern(P.REF_HEAD), 1)
    tail = F.substr(F.col("__entry"), F.length(head) + 1)
    path = F.when(tail.startswith("/"), normalize_tail(tail)).otherwise(F.lit(""))
    return entry.select(
        *keys, "entry_idx", F.regexp_extract_all(head, F.lit(X.pattern(P.REF_CODE)), 0).alias("codes"), path.alias("path")
    )


def normalize_tail(tail: Column) -> Column:
    parts = F.transform(F.split(tail, "/"), X.strip)
    return F.array_join(F.filter(parts, lambda p: p != ""), "/")


def parse_refs(df: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """Reference text -> (keys, ref_idx, reg_code, section_path_prefix).

    Entries stand on lines or between semicolons.  Several codes of an entry
    share its path; an unreadable tail means the whole regulation.
    """
    entries = _entries(df, keys, raw)
    codes = entries.select(*keys, "entry_idx", F.posexplode("codes").alias("code_idx", "reg_code"), F.col("path").alias("section_path_prefix"))
    # both numbers are 32-bit, so the pair fits one
    order = (F.col("entry_idx").cast("bigint") * (1 << 31) + F.col("code_idx")).alias("ref_idx")
    return codes.select(*keys, order, "reg_code", "section_path_prefix")


def dropped_refs(df: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """How many entries of each text name no code."""
    n = _entries(df, keys, raw).groupBy(*keys).agg(F.count_if(F.size("codes") == 0).alias("dropped"))
    return df.select(*keys).join(n, keys, "left").withColumn("dropped", F.coalesce("dropped", F.lit(0)))


def path_matches(prefix: Column, path: Column) -> Column:
    """Equal, below, above, or the whole regulation; compared by path parts."""
    slash = F.lit("/")
    return (
        (prefix == "")
        | (path == prefix)
        | path.startswith(F.concat(prefix, slash))
        | prefix.startswith(F.concat(path, slash))
    )


def lookup(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks at or below each wanted (reg_code, section_path_prefix).

    Each chunk is listed under all its ancestor paths and under the whole
    regulation, so the prefix search is an equi-join on (code, path): it
    spreads a hot regulation by path and needs no pairwise comparison.
    """
    return wanted.join(_listed(chunks), ["reg_code", "section_path_prefix"])


def _listed(chunks: DataFrame) -> DataFrame:
    under = F.concat(F.array(F.lit("")), X.ancestors(F.col("section_path")))
    return chunks.withColumn("section_path_prefix", F.explode(under))


def lookup_counts(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """How many chunks each wanted path has at or below it.

    Counted once per (code, path) with a map-side combine, so neither a whole
    regulation nor many references to it multiply rows.  Paths without chunks
    drop out.
    """
    counts = _listed(chunks).groupBy("reg_code", "section_path_prefix").agg(F.count(F.lit(1)).alias("n_chunks"))
    return wanted.join(counts, ["reg_code", "section_path_prefix"])


def _first_of(rows: DataFrame, path: str, n: int) -> DataFrame:
    """The first chunks of each (code, path); the limit applies before the shuffle too."""
    order = Window.partitionBy("reg_code", path).orderBy("order", "chunk_id")
    return rows.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= n)


def lookup_first(chunks: DataFrame, wanted: DataFrame, n: int = P.PER_REF_CAP) -> DataFrame:
    """``lookup`` with only the first ``n`` chunks of each wanted path.

    The first chunks are found once per (code, path); however many references
    name a whole regulation, each joins at most ``n`` rows.
    """
    return wanted.join(_first_of(_listed(chunks), "section_path_prefix", n), ["reg_code", "section_path_prefix"])


def _above(refs: DataFrame) -> DataFrame:
    """Each reference with the paths above its own."""
    proper = F.filter(X.ancestors(F.col("section_path_prefix")), lambda p: p != F.col("section_path_prefix"))
    return refs.withColumn("section_path", F.explode(proper))


def match_counts(refs: DataFrame, chunks: DataFrame, ref_keys: list[str]) -> DataFrame:
    """Chunks that match each reference in either direction: (ref_keys, n_chunks).

    At or below by counts per listed path, above by counts per exact path;
    references without a match drop out.
    """
    exact = chunks.groupBy("reg_code", "section_path").agg(F.count(F.lit(1)).alias("n_chunks"))
    above = _above(refs).join(exact, ["reg_code", "section_path"]).select(*ref_keys, "n_chunks")
    both = lookup_counts(chunks, refs).select(*ref_keys, "n_chunks").unionByName(above)
    return both.groupBy(*ref_keys).agg(F.sum("n_chunks").alias("n_chunks"))


def first_matches(refs: DataFrame, chunks: DataFrame, ref_keys: list[str], n: int = P.PER_REF_CAP) -> DataFrame:
    """The first ``n`` chunks by document order that match each reference in either direction.

    A reference meets the first chunks of its own path and of the paths above
    it, so rows are linear in references and chunks.
    """
    below = lookup_first(chunks, refs, n).drop("pos")
    above = _above(refs).join(_first_of(chunks, "section_path", n), ["reg_code", "section_path"]).select(*below.columns)
    order = Window.partitionBy(*ref_keys).orderBy("order", "chunk_id")
    return below.unionByName(above).withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= n)
