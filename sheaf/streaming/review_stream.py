"""The same review over arriving bundles (STR)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sheaf import schemas
from sheaf.functions.session import drop_tables, materialise, written_tables
from sheaf.operators.classify import FORM_KINDS
from sheaf.plans.review import review_bundles
from sheaf.streaming.state import BundleFiles, FirstFile, keep_state_on_disk

KEY = "bundle_id"
#: Groups of bundles whose files are one processor's state; fixed, as state is found by them.
STATE_GROUPS = 1024


def read_files(spark, path: str, max_files: int = 1000) -> DataFrame:
    """Manifest rows as they arrive."""
    return spark.readStream.schema(schemas.FILES).option("maxFilesPerTrigger", max_files).json(path)


def write_cells_by_bundle(cells: DataFrame, path: str, buckets: int) -> None:
    """Cells in ``buckets`` folders by bundle, of which a batch of the stream reads those of its bundles."""
    bucket = _bucket(buckets).alias("bundle_bucket")
    # a folder is the work of as many tasks as its size asks for: by bucket alone there are no more tasks than folders
    cells.select("*", bucket).hint("rebalance", F.col("bundle_bucket")).write.mode("append").partitionBy("bundle_bucket").parquet(path)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int")


def review_stream(
    files: DataFrame, cells_path: str, out: str, checkpoint: str, fmt: str = "parquet", partition: str | None = None, cell_buckets: int | None = None
) -> StreamingQuery:
    """Reviews the bundles that a micro-batch touches, each with all of its files so far.

    The file rows of a bundle are keyed state, so a batch looks up its own
    bundles only, however many there are; processors are called for groups of
    them (:class:`BundleFiles`).  It reviews these whole and writes one
    version of each under ``out/<table>/batch_id=n``; :func:`latest` reads the
    last version of every bundle.  Folders are named by batch and overwritten,
    and state goes back with a batch that runs again, so its result is there once.

    Of the cells only what the touched bundles need is read: by the folders of
    :func:`write_cells_by_bundle` if ``cell_buckets`` is given, or by
    ``partition``, a column, such as the arrival day, that the files rows carry
    and the cells are partitioned by.
    """
    spark = files.sparkSession
    keep_state_on_disk(spark)
    rows = files.select(
        F.pmod(F.xxhash64(KEY), F.lit(STATE_GROUPS)).alias("state_group"), F.col(KEY).cast("string").alias("bundle"),
        F.col("file_idx").cast("long").cast("string").alias("file_idx"), F.to_json(F.struct(*files.columns)).alias("row"),
    )
    kept = rows.groupBy("state_group").transformWithStateInPandas(BundleFiles(), "row string", "Update", "None")
    touched = kept.select(F.from_json("row", files.schema).alias("f")).select("f.*")

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark, mark = batch.sparkSession, written_tables()
        own_files = materialise(batch)
        extra = f", {partition} string" if partition else ", bundle_bucket int" if cell_buckets else ""
        cells = spark.read.schema(schemas.CELLS + extra).format(fmt).load(cells_path)
        if cell_buckets:
            # bucket numbers, at most ``cell_buckets`` of them, prune the folders
            numbers = [r[0] for r in own_files.select(_bucket(cell_buckets)).distinct().collect()]
            cells = cells.filter(F.col("bundle_bucket").isin(numbers)).drop("bundle_bucket")
        keys = [KEY] if partition is None else [partition, KEY]
        done = review_bundles(own_files, cells.join(own_files.select(*keys).distinct(), keys, "left_semi"))
        for name in ("findings", "reports"):
            done[name].write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
        drop_tables(spark, mark)

    return (
        touched.writeStream.outputMode("update").foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest(spark, out: str, table: str) -> DataFrame:
    """``findings`` or ``reports`` of every bundle as its last batch left them."""
    versions = spark.read.parquet(f"{out}/{table}")
    newest = spark.read.parquet(f"{out}/reports").groupBy(KEY).agg(F.max("batch_id").alias("batch_id"))
    return versions.join(newest, [KEY, "batch_id"], "left_semi").drop("batch_id")


def _milliseconds(spark: SparkSession, interval: str) -> int:
    return spark.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + INTERVAL {interval})").first()[0]


def first_wins_stream(files: DataFrame, delay: str = "1 day", arrived: str = "arrived") -> DataFrame:
    """The first file by position of each (bundle, form kind), in any order of arrival.

    (bundle_id, kind, winner_idx, winner_filename, version): a row for the first
    file that arrives, and a correcting one with the next version whenever a file
    of a smaller position does; :func:`winners_so_far` reads the last ones.
    Files without a path (null ``file_id``) never win.  State goes once ``delay``
    has passed since the last file of a key, and files that come later than that
    are left out.  Of a batch only the least file of a key and task is shuffled.
    """
    spark = files.sparkSession
    keep_state_on_disk(spark)
    forms = files.filter(F.col("kind").isin(FORM_KINDS) & F.col("file_idx").isNotNull())
    if "file_id" in files.columns:
        forms = forms.filter(F.col("file_id").isNotNull())
    name = F.col("filename") if "filename" in files.columns else F.lit(None).cast("string")
    rows = forms.select(
        KEY, "kind", F.col("file_idx").cast("long").alias("file_idx"), name.alias("filename"), F.col(arrived).cast("timestamp").alias("arrived"),
        F.unix_millis(F.col(arrived).cast("timestamp")).alias("arrived_ms"),
    )

    def least(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = [frame[KEY], frame["kind"]]
            own = frame.loc[frame.groupby(keys, dropna=False)["file_idx"].idxmin()].copy()
            last = frame.groupby(keys, dropna=False)[["arrived", "arrived_ms"]].transform("max")
            own[["arrived", "arrived_ms"]] = last.loc[own.index]
            yield own

    kind = rows.schema[KEY].dataType.simpleString()
    fewer = rows.mapInPandas(least, f"{KEY} {kind}, kind string, file_idx long, filename string, arrived timestamp, arrived_ms long")
    return fewer.withWatermark("arrived", delay).groupBy(KEY, "kind").transformWithStateInPandas(
        FirstFile([KEY, "kind"], _milliseconds(spark, delay)), f"{KEY} {kind}, kind string, winner_idx long, winner_filename string, version int", "Append", "EventTime"
    )


def winners_so_far(won: DataFrame) -> DataFrame:
    """(bundle_id, kind, winner_idx, winner_filename) of the rows that :func:`first_wins_stream` has written, as ``classify.winners``."""
    return won.groupBy(KEY, "kind").agg(F.min("winner_idx").alias("winner_idx"), F.min_by("winner_filename", "winner_idx").alias("winner_filename"))


_SUMS = ("reviews", "errors", "warnings", "passed")


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("reviews"), F.sum("error_count").alias("errors"), F.sum("warn_count").alias("warnings"), F.count_if("passed").alias("passed")]


def audit_windows(audit: DataFrame, window: str = "1 day", delay: str = "1 day", ts: str = "ts", unit: str = "filing_unit") -> DataFrame:
    """Reviews, errors, warnings and passes per unit and time window.

    As a stream, rows that come after their window is closed are lost;
    :func:`audit_stream` keeps them.
    """
    rows = audit.withWatermark(ts, delay) if audit.isStreaming else audit
    return (
        rows.groupBy(F.window(ts, window), unit).agg(*_counts())
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), unit, *_SUMS)
    )


def audit_stream(audit: DataFrame, out: str, checkpoint: str, window: str = "1 day", delay: str = "1 day", ts: str = "ts", unit: str = "filing_unit") -> StreamingQuery:
    """Windows as they close, and a correction for each late row's window: ``out/windows``.

    (kind, window_start, window_end, unit, reviews, errors, warnings, passed).  A
    window is closed once a row has come that is ``delay`` younger than its end,
    and is written once then; what comes later is written as its ``correction``,
    so windows plus corrections are the counts of all rows, in any order of
    arrival.  Each batch keeps its counts by window (``out/deltas``, in folders
    by day, so that closing windows read their own days) and the youngest row
    seen (``out/seen``).  All folders are named by batch and overwritten, so a
    batch that runs again changes nothing.  Rows without a time are left out.
    """
    wait = F.expr(f"INTERVAL {delay}")

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark, mark = batch.sparkSession, written_tables()
        rows = batch.filter(F.col(ts).isNotNull())
        own = materialise(audit_windows(rows, window, delay, ts, unit))
        day = F.to_date("window_end").cast("string").alias("day")
        own.select("*", day).write.mode("overwrite").partitionBy("day").parquet(f"{out}/deltas/batch_id={batch_id}")
        before = None
        if batch_id:
            seen = spark.read.schema("until timestamp, batch_id int").parquet(f"{out}/seen")
            before = seen.filter(F.col("batch_id") < batch_id).agg(F.max("until")).first()[0]  # one row a batch
        youngest = rows.agg(F.max(F.col(ts).cast("timestamp"))).first()[0]
        until = max((t for t in (before, youngest) if t is not None), default=None)
        spark.createDataFrame([(until,)], "until timestamp").coalesce(1).write.mode("overwrite").parquet(f"{out}/seen/batch_id={batch_id}")
        closed = F.lit(before).cast("timestamp") - wait
        closing = F.lit(until).cast("timestamp") - wait
        end = F.col("window_end")
        late = F.coalesce(end <= closed, F.lit(False))
        deltas = spark.read.option("basePath", f"{out}/deltas").schema(T.StructType([*own.schema.fields, *T.StructType().add("batch_id", "integer").add("day", "string").fields])).parquet(f"{out}/deltas")
        days = (F.col("day") <= F.to_date(closing).cast("string")) & F.coalesce(F.col("day") >= F.to_date(closed).cast("string"), F.lit(True))
        due = deltas.filter(days & (F.col("batch_id") <= batch_id) & (end <= closing) & F.coalesce(end > closed, F.lit(True)))
        sums = [F.sum(c).alias(c) for c in _SUMS]
        columns = ["window_start", "window_end", unit]
        done = due.groupBy(*columns).agg(*sums).select(F.lit("window").alias("kind"), "*")
        more = own.filter(late).select(F.lit("correction").alias("kind"), *columns, *_SUMS)
        done.unionByName(more).write.mode("overwrite").parquet(f"{out}/windows/batch_id={batch_id}")
        drop_tables(spark, mark)

    return audit.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_windows(spark: SparkSession, out: str, unit: str = "filing_unit") -> DataFrame:
    """Counts of all closed windows, corrections included, as :func:`audit_windows` gives them for the same rows."""
    rows = spark.read.parquet(f"{out}/windows")
    return rows.groupBy("window_start", "window_end", unit).agg(*[F.sum(c).alias(c) for c in _SUMS])
