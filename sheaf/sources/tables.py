"""Sources and sinks (SRC)."""

from __future__ import annotations

import datetime
import urllib.parse
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf import presets as P
from sheaf import schemas
from sheaf.functions import text as X
from sheaf.functions.session import materialise
from sheaf.operators import refs as R
from sheaf.operators import scan

KEY = "bundle_id"


class IndexMismatch(RuntimeError):
    """An index was built with another model or dimension."""


class RetrievalMapError(RuntimeError):
    """A retrieval map is missing, broken, or of another version."""


# ---- forms and files -------------------------------------------------------


def read_cells(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Cell grids with their fixed schema; parquet, json or csv.

    A cell text may hold line breaks, so a csv file is read as a whole by one
    task; large inputs belong in parquet.
    """
    reader = spark.read.schema(schemas.CELLS)
    if fmt == "csv":
        return reader.options(header="true", multiLine="true", quote='"', escape='"').csv(path)
    return reader.format(fmt).load(path)


def write_cells(cells: DataFrame, path: str) -> None:
    """Cells laid out by sheet, so that a rule reads only its sheets."""
    spread = cells.repartition("sheet", KEY, F.floor(F.col("row") / P.SCAN_BLOCK))
    spread.sortWithinPartitions("sheet", KEY, "row").write.mode("overwrite").partitionBy("sheet").parquet(path)


def read_manifest(spark: SparkSession, path: str, max_bytes: int = P.MAX_FILE_BYTES, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """Files within and over the size limit; contents are not read."""
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
        .select("path", "length", "modificationTime")
        .withColumn("filename", X.basename(F.col("path")))
    )
    return size_gate(listed, max_bytes)


def size_gate(files: DataFrame, max_bytes: int = P.MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    return files.filter(F.col("length") <= max_bytes), files.filter(F.col("length") > max_bytes)


def sheet_directory(cells: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Sheet names per file; reads two columns, no values."""
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_set("sheet")).alias("sheets"))


def read_page_lines(spark: SparkSession, path: str, split_bytes: int | None = None, name: Column | None = None) -> DataFrame:
    """Extracted text files -> (doc_id, page_no, line_no, line); a form feed ends a page.

    Files of any size: each is read in splits, and page and line numbers are
    carried from split to split, one summary row a split.  The rows are those of
    :func:`page_lines` over whole texts; a byte order mark that begins a file is no
    part of its text, and a compressed file (one split) shows no empty line behind
    its last line break.  A stretch without line feeds must fit one row.  Files
    without any byte give no rows.  ``split_bytes`` is the size of a split, that of the
    session by default; ``name`` gives ``doc_id`` from the columns of the folders, by default
    it is the name of the file.
    """
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, split_bytes or before)
    try:
        return _numbered_lines(
            spark.read.text(path, lineSep="\n").select(
                (X.basename(F.input_file_name()) if name is None else name).alias("doc_id"), F.col("_metadata.file_path").alias("__file"),
                F.col("_metadata.file_block_start").alias("__block"), F.col("_metadata.file_size").alias("__size"),
                F.monotonically_increasing_id().alias("__at"), "value",
            )
        )
    finally:
        spark.conf.set(key, before)


def _numbered_lines(records: DataFrame) -> DataFrame:
    """Lines of records that ended in a line feed, numbered over pages and splits.

    ``__at`` ascends within a split; only its order counts.  A record is cut into
    pieces at form feeds and a piece into lines; a running sum of pieces that open
    a page gives the page, and a running maximum of the places where pages open
    the line.
    """
    crlf = F.col("value").endswith("\r")
    body = F.when(crlf, F.substr(F.col("value"), F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    pieces = records.select(
        "doc_id", "__file", "__block", "__size", "__at", crlf.alias("__cr"), (F.octet_length("value") + 1).cast("bigint").alias("__bytes"),
        F.posexplode(F.split(body, "\f")).alias("__piece", "__text"),
    ).withColumn("__lines", F.split("__text", "\r")).drop("__text")
    opens, n = F.col("__piece") > 0, F.size("__lines").cast("bigint")
    place = ["__at", "__piece"]
    counted = scan.running(pieces, ["__file"], place, "__block", page_no=("sum", F.when(opens, 1).otherwise(0)), __end=("sum", n))
    numbered = scan.running(counted, ["__file"], place, "__block", __open=("max", F.when(opens, F.col("__end") - n)))
    first = F.col("__end") - n - F.coalesce("__open", F.lit(0))
    lines = materialise(numbered.select(
        "doc_id", "__file", "__size", "__cr", F.when(opens, 0).otherwise(F.col("__bytes")).alias("__bytes"), "page_no", first.alias("__first"),
        F.posexplode("__lines").alias("__pos", "line"),
    ).select(
        "doc_id", "__file", "__size", "__cr", F.when(F.col("__pos") == 0, F.col("__bytes")).otherwise(0).alias("__bytes"),
        F.col("page_no").cast("int"), (F.col("__first") + F.col("__pos")).cast("int").alias("line_no"), "line",
    ))
    # all records count one line feed: with the last one's missing, the bytes are one more than the file has
    last = F.max(F.struct("page_no", "line_no", "__cr"))
    ends = lines.groupBy("__file", "doc_id").agg(last.alias("l"), (F.sum("__bytes") - F.max("__size")).alias("over"))
    mark = 3  # bytes of a byte order mark
    closed = F.col("over").isin(0, -mark) | (F.col("over").isin(1, 1 - mark) & F.col("l")["__cr"])
    behind = ends.filter(closed).select("doc_id", F.col("l")["page_no"].alias("page_no"), (F.col("l")["line_no"] + 1).alias("line_no"), F.lit("").alias("line"))
    return lines.select("doc_id", "page_no", "line_no", "line").unionByName(behind)


def page_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    pages = docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.col(text), "\f")).alias("page_no", "__page"))
    return pages.select("doc_id", "page_no", F.posexplode(F.split("__page", "\r\n|\n|\r")).alias("line_no", "line"))


def page_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg((F.max("page_no") + 1).alias("n_pages"))


# ---- configuration as tables -----------------------------------------------


def registry_dim(spark: SparkSession, registry: dict[str, str] | None = None) -> DataFrame:
    """Document code -> chunking style (a few rows)."""
    return spark.createDataFrame(list((registry or P.REGULATIONS).items()), "reg_code string, style string")


def review_dims(spark: SparkSession) -> dict[str, DataFrame]:
    """Required columns and documents, conditions and comparisons as tables."""
    required = [(i, c, P.F01_COLUMNS[c], label) for i, (c, label) in enumerate(P.F01_REQUIRED)]
    docs = [(r, c, label, "error") for r, c, label in P.REQUIRED_DOCS] + [(*P.SOFT_DOC, "warn")]
    compare = [
        ("CROSS.OWNER_MISMATCH", P.OWNER_COMPARISON, "warn"),
        ("CROSS.UNIT_MISMATCH", P.UNIT_COMPARISON, "warn"),
    ]
    return {
        "required_columns": spark.createDataFrame(required, "seq int, col string, name string, label string"),
        "required_docs": spark.createDataFrame(docs, "role string, code string, label string, severity string"),
        "conditional_docs": spark.createDataFrame(
            P.CONDITIONAL_DOCS, "code string, label string, grades array<string>, keywords array<string>"
        ),
        "comparisons": spark.createDataFrame(compare, "code string, label string, severity string"),
        "signatures": spark.createDataFrame(P.SIGNATURES, "kind string, sheet string, priority int, reason string"),
    }


# ---- index -----------------------------------------------------------------


def write_index(chunks: DataFrame, path: str) -> None:
    """Replaces the chunk and vector table, one folder per regulation."""
    chunks.withColumnRenamed("chunk_id", "id").write.mode("overwrite").partitionBy("reg_code").parquet(f"{path}/chunks")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk and vector table; codes are texts, also where they look like numbers."""
    table = spark.read.schema(schemas.INDEX_CHUNKS).parquet(f"{path}/chunks")
    return table.withColumnRenamed("id", "chunk_id")


def replace_codes(chunks: DataFrame, kept: DataFrame, path: str) -> None:
    """Writes the folders of the codes in ``chunks``; folders of codes not in ``kept`` go.

    Only the names of folders to remove come to the driver, which lists the
    folders of a table anyway.
    """
    spark = chunks.sparkSession
    chunks.withColumnRenamed("chunk_id", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "reg_code"
    ).parquet(f"{path}/chunks")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/chunks")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory() and s.getPath().getName().startswith("reg_code=")]
    named = spark.createDataFrame([(urllib.parse.unquote(n.split("=", 1)[1]), n) for n in old], "reg_code string, folder string")
    for row in named.join(kept, "reg_code", "left_anti").collect():
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, row["folder"]), True)


def write_index_state(state: DataFrame, path: str, model: str, dim: int) -> None:
    """What each code of the index was made from, and with which model; see ``plans.index``."""
    state.select("*", F.lit(model).alias("embedding_model"), F.lit(dim).alias("embedding_dim")).coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/state")


def read_index_state(spark: SparkSession, path: str, model: str, dim: int) -> DataFrame:
    """The stored states of this model and dimension; none where there is no state."""
    try:
        found = spark.read.schema(schemas.INDEX_STATE).parquet(f"{path}/state")
    except AnalysisException:
        found = spark.createDataFrame([], schemas.INDEX_STATE)
    right = (F.col("embedding_model") == model) & (F.col("embedding_dim") == dim)
    return found.filter(right).drop("embedding_model", "embedding_dim")


def index_meta(chunks: DataFrame, sources: DataFrame, model: str, dim: int, built_at: str | None = None) -> DataFrame:
    """The index description as rows: the index, chunks per code, hash per source file.

    ``sources(filename, content)`` is read as binary files.  Row kinds are
    ``index`` (one row), ``chunks`` (name is the code) and ``source`` (name is
    the file).
    """
    built_at = built_at or datetime.datetime.now(datetime.timezone.utc).isoformat()
    head = chunks.sparkSession.createDataFrame([("index", None, None, None)], "kind string, name string, chunks bigint, sha256 string")
    counts = chunks.groupBy(F.col("reg_code").alias("name")).agg(F.count(F.lit(1)).alias("chunks"))
    rows = head.unionByName(
        counts.select(F.lit("chunks").alias("kind"), "name", "chunks", F.lit(None).cast("string").alias("sha256"))
    ).unionByName(
        sources.select(F.lit("source").alias("kind"), F.col("filename").alias("name"), F.lit(None).cast("bigint").alias("chunks"), F.sha2("content", 256).alias("sha256"))
    )
    return rows.select(
        F.lit(P.SCHEMA_VERSION).alias("schema_version"), F.lit(built_at).alias("built_at"),
        F.lit(model).alias("embedding_model"), F.lit(dim).alias("embedding_dim"), "*",
    )


def write_index_meta(meta: DataFrame, path: str) -> None:
    meta.write.mode("overwrite").json(f"{path}/meta")


def open_index(spark: SparkSession, path: str, model: str, dim: int) -> DataFrame:
    """The index table, if it was built with this model and dimension."""
    try:
        meta = spark.read.schema(schemas.INDEX_META).json(f"{path}/meta").filter("kind = 'index'").first()
    except AnalysisException as exc:
        raise IndexMismatch(f"no index description at {path}") from exc
    if meta is None:
        raise IndexMismatch(f"empty index description at {path}")
    if meta["embedding_model"] != model:
        raise IndexMismatch(f"model {meta['embedding_model']!r}, expected {model!r}")
    if meta["embedding_dim"] != dim:
        raise IndexMismatch(f"dimension {meta['embedding_dim']}, expected {dim}")
    try:
        table = spark.read.parquet(f"{path}/chunks").withColumnRenamed("id", "chunk_id")
    except AnalysisException:  # an index without chunks has no files to take a schema from
        table = read_chunks(spark, path)
    right = F.size("embedding") == dim
    return table.withColumn(
        "embedding", F.when(right, F.col("embedding")).otherwise(F.raise_error(F.lit("vector of another dimension")))
    )


def lookup(chunks: DataFrame, keys: DataFrame, n: int = P.PER_REF_CAP) -> DataFrame:
    """The first ``n`` chunks at or below each (reg_code, section_path_prefix), and how many there are."""
    return R.lookup_counts(chunks, R.lookup_first(chunks, keys, n))


# ---- retrieval map ---------------------------------------------------------

_SECTION_KEYS = {"reg_code": True, "section_path": True, "title": True, "excerpt": True, "score": False, "origin": True}
_ITEM_KEYS = {
    "item_id": True, "canonical_topic": False, "canonical_description": False,
    "canonical_ref_raw": False, "refs": False, "sections": False,
}
_QUESTION_KEYS = {"qid": True, "sections": False}
_REF_KEYS = {"reg_code": True, "section_path_prefix": False}
_TOP_KEYS = {"schema_version": True, "built_at": True, "embedding_model": True, "f03_items": False, "f02_questions": False}


def _bad_keys(found: Column, spec: dict[str, bool]) -> Column:
    """Unknown keys plus missing required ones."""
    known = F.array(*[F.lit(k) for k in spec])
    needed = F.array(*[F.lit(k) for k, must in spec.items() if must])
    return F.size(F.array_except(found, known)) + F.size(F.array_except(needed, found))


def write_retrieval_map(by_item: DataFrame, by_question: DataFrame, path: str, model: str, built_at: str | None = None) -> None:
    """One JSON document a line, each with the head and one entry, committed as a whole.

    A line is a valid map of its own, so a map of any size is written and read
    by many tasks.  The first line has no entry.
    """
    built_at = built_at or datetime.datetime.now(datetime.timezone.utc).isoformat()
    head = [F.lit(P.SCHEMA_VERSION).alias("schema_version"), F.lit(built_at).alias("built_at"), F.lit(model).alias("embedding_model")]

    def lines(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.to_json(F.struct(*head, F.create_map("key", "value").alias(name)), {"ignoreNullFields": "false"}).alias("value"))

    first = by_item.sparkSession.range(1).select(F.to_json(F.struct(*head)).alias("value"))
    first.unionByName(lines(by_item, "f03_items")).unionByName(lines(by_question, "f02_questions")).write.mode("overwrite").text(path)


def load_retrieval_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, questions) of a checked retrieval map: one document, or one a line.

    Fails on a missing file, broken JSON, a non-object, another version,
    unknown or missing keys, or an unknown section origin.
    """
    try:
        by_line = spark.read.text(path).filter(F.trim("value") != "")
        broken = by_line.filter(F.json_object_keys("value").isNull()).limit(1).count()
        # a document over several lines is read whole
        raw = spark.read.text(path, wholetext=True).filter(F.trim("value") != "") if broken else by_line
        top = raw.select(
            "value", F.json_object_keys("value").alias("keys"), F.get_json_object("value", "$.schema_version").alias("version"),
            # a number, not a text that looks like it
            F.col("value").rlike(rf'"schema_version"\s*:\s*{P.SCHEMA_VERSION}\s*[,}}]').alias("numeric"),
            F.from_json("value", schemas.RETRIEVAL_MAP).alias("m"),
            F.from_json("value", "f03_items map<string,string>, f02_questions map<string,string>").alias("parts"),
        )
        right = F.coalesce((F.col("version") == str(P.SCHEMA_VERSION)) & F.col("numeric"), F.lit(False))
        found = top.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("keys").isNull()).alias("broken"), F.count_if(~right).alias("other"),
            F.max(F.when(~right, F.coalesce("version", F.lit("none")))).alias("version"), F.sum(_bad_keys(F.col("keys"), _TOP_KEYS)).alias("bad"),
        ).first()
    except AnalysisException as exc:
        raise RetrievalMapError(f"no retrieval map at {path}") from exc
    if not found["n"]:
        raise RetrievalMapError(f"empty retrieval map at {path}")
    if found["broken"]:
        raise RetrievalMapError(f"no JSON object at {path}")
    if found["other"]:
        raise RetrievalMapError(f"version {found['version']} at {path}, expected {P.SCHEMA_VERSION}")
    if found["bad"]:
        raise RetrievalMapError(f"{found['bad']} unknown or missing keys at {path}")

    def nested(part: str, spec: dict[str, bool]) -> Column:
        """Wrong keys in the entries of one map and in their lists."""
        def lists(entry: Column, name: str, keys: dict[str, bool]) -> Column:
            rows = F.from_json(F.get_json_object(entry, f"$.{name}"), "array<string>")
            return F.aggregate(
                F.coalesce(rows, F.array().cast("array<string>")), F.lit(0),
                lambda n, r: n + F.coalesce(_bad_keys(F.json_object_keys(r), keys), F.lit(1)),
            )

        entries = F.map_values(F.coalesce(F.col("parts")[part], F.create_map().cast("map<string,string>")))
        def wrong(e: Column) -> Column:
            n = F.coalesce(_bad_keys(F.json_object_keys(e), spec), F.lit(1)) + lists(e, "sections", _SECTION_KEYS)
            return n + lists(e, "refs", _REF_KEYS) if "refs" in spec else n

        return F.aggregate(entries, F.lit(0), lambda n, e: n + wrong(e))

    wrong = top.agg(F.sum(nested("f03_items", _ITEM_KEYS) + nested("f02_questions", _QUESTION_KEYS)).alias("n")).first()["n"]
    items = top.select(F.explode("m.f03_items").alias("key", "value")).select("key", "value.*")
    questions = top.select(F.explode("m.f02_questions").alias("key", "value")).select("key", "value.*")
    if not wrong:
        origins = items.select(F.explode("sections").alias("s")).unionAll(questions.select(F.explode("sections").alias("s")))
        wrong = origins.filter(F.col("s.origin").isNull() | ~F.col("s.origin").isin("curated", "semantic")).count()
    if wrong:
        raise RetrievalMapError(f"{wrong} wrong fields at {path}")
    none_refs = F.array().cast(T.ArrayType(items.schema["refs"].dataType.elementType))
    none_secs = F.array().cast(T.ArrayType(items.schema["sections"].dataType.elementType))
    return (
        items.withColumn("refs", F.coalesce("refs", none_refs)).withColumn("sections", F.coalesce("sections", none_secs)),
        questions.withColumn("sections", F.coalesce("sections", none_secs)),
    )


def flat_sections(entries: DataFrame, key: str) -> DataFrame:
    """Nested entries -> one row per section."""
    return entries.select(F.col("key").alias(key), F.posexplode("sections").alias("pos", "s")).select(key, "pos", "s.*")


# ---- report sinks ----------------------------------------------------------

_COMMITS = "_commits"
AUDIT_COLUMNS = [
    KEY, "subject", "filing_unit", "form_type", "error_count", "warn_count", "passed", "enable_llm", "duration_ms",
]


def append_audit(reports: DataFrame, path: str, event_date: str | None = None, run_id: str | None = None, **constants) -> None:
    """Appends identifiers and counts only; any other column is left out.

    With a ``run_id`` the rows count once they are whole and only once: each
    attempt writes under a name of its own, then one commit row.  A run that is
    already committed appends nothing; :func:`read_audit` leaves out attempts that
    were cut off, and all but the first commit of runs that met.
    """
    date = event_date or datetime.date.today().isoformat()
    spark = reports.sparkSession
    rows = reports
    for name, value in constants.items():
        if name not in AUDIT_COLUMNS:
            raise ValueError(f"{name!r} may not be in the audit trail")
        rows = rows.withColumn(name, F.lit(value))
    kept = [c for c in AUDIT_COLUMNS if c in rows.columns]
    if run_id is not None and not audit_commits(spark, path).filter(F.col("run_id") == run_id).isEmpty():
        return
    attempt = uuid.uuid4().hex
    marks = [F.lit(run_id).alias("run_id"), F.lit(attempt).alias("attempt")] if run_id is not None else []
    rows.select(
        F.lit("review_done").alias("event"), *kept, F.current_timestamp().alias("ts"), *marks, F.lit(date).alias("event_date")
    ).write.mode("append").partitionBy("event_date").json(path)
    if marks:
        spark.range(1).select(*marks, F.lit(date).alias("event_date"), F.current_timestamp().alias("committed_at")).coalesce(1).write.mode(
            "append"
        ).json(f"{path}/{_COMMITS}")


def audit_commits(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, attempt): the first committed attempt of each run."""
    try:
        found = spark.read.schema(schemas.AUDIT_COMMITS).json(f"{path}/{_COMMITS}")
    except AnalysisException:
        found = spark.createDataFrame([], schemas.AUDIT_COMMITS)
    first = F.min(F.struct("committed_at", "attempt"))
    return found.groupBy("run_id").agg(first.alias("c")).select("run_id", F.col("c.attempt").alias("attempt"))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit trail: rows of committed runs, each run once, and rows appended without a run.

    Filters on ``event_date`` reach the folders.
    """
    rows = spark.read.schema(schemas.AUDIT).json(path)
    whole = audit_commits(spark, path).withColumn("whole", F.lit(True))
    return rows.join(whole, ["run_id", "attempt"], "left").filter(F.col("run_id").isNull() | F.col("whole")).drop("attempt", "whole")


def write_reports(rendered: DataFrame, path: str) -> None:
    """Rows of rendered reports, a long report spread over files, in order within each."""
    parts = rendered.repartition(KEY, F.floor(F.col("no") / P.JOIN_BLOCK)).sortWithinPartitions(KEY, "no")
    parts.write.mode("overwrite").parquet(path)


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> None:
    """Tables as views, for SQL over findings and reports."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
