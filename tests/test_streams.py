"""Streams against the batch operators, whatever the order of arrival."""

import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators import classify
from sheaf.streaming import review_stream

FILES = "bundle_id string, kind string, file_idx long, file_id string, filename string, arrived timestamp"


def write_batches(spark, rows, schema, path, parts):
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.mode("append").json(str(path))


def run_first_wins(spark, tmp_path, delay):
    stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    won = review_stream.first_wins_stream(stream, delay)
    query = won.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_first_file_wins_in_any_order(spark, tmp_path):
    import datetime

    rng = random.Random(3)
    start = datetime.datetime(2026, 1, 1)
    # one bundle has a third of all files, some files have no path or no kind of form
    rows = [
        (rng.choice(["hot", f"b{rng.randrange(20)}", f"b{rng.randrange(20)}"]), rng.choice(["f01", "f02", "f03", "unknown"]), i, None if rng.random() < 0.1 else f"p{i}", f"n{i}.xlsx", start + datetime.timedelta(minutes=rng.randrange(600)))
        for i in range(300)
    ]
    rng.shuffle(rows)
    write_batches(spark, rows, FILES, tmp_path / "in", 3)
    won = run_first_wins(spark, tmp_path, "1 day")
    classified = spark.createDataFrame(rows, FILES)
    key = ["bundle_id", "kind", "winner_idx", "winner_filename"]
    assert sorted(review_stream.winners_so_far(won).select(*key).collect()) == sorted(classify.winners(classified).select(*key).collect())
    got = classify.route(classified, review_stream.winners_so_far(won))
    columns = ["bundle_id", "kind", "file_idx", "winner_idx", "role"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, classify.route(classified).select(*columns).collect()))
    # versions of a key count its corrections, each with a smaller position
    for own in won.groupBy("bundle_id", "kind").agg(F.sort_array(F.collect_list(F.struct("version", "winner_idx"))).alias("v")).collect():
        assert [v["version"] for v in own["v"]] == list(range(1, len(own["v"]) + 1))
        assert sorted((v["winner_idx"] for v in own["v"]), reverse=True) == [v["winner_idx"] for v in own["v"]]


def test_first_wins_forgets_and_keeps_its_winners(spark, tmp_path):
    import datetime

    day = lambda n: datetime.datetime(2026, 1, n)
    rows = [("a", "f01", 5, "p", "five", day(1)), ("b", "f01", 9, "p", "nine", day(10)), ("c", "f01", 1, "p", "one", day(20)), ("a", "f01", 3, "p", "late", day(1)), ("a", "f01", 7, "p", "seven", day(21))]
    write_batches(spark, rows, FILES, tmp_path / "in", 5)
    won = run_first_wins(spark, tmp_path, "2 days")
    assert {(r["bundle_id"], r["winner_idx"]) for r in review_stream.winners_so_far(won).collect()} == {("a", 5), ("b", 9), ("c", 1)}
    assert {r["winner_idx"] for r in won.filter("bundle_id = 'a'").collect()} == {5, 7}  # the state had gone


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_and_corrections_are_all_rows(spark, tmp_path, seed):
    import datetime

    rng = random.Random(seed)
    schema = "ts timestamp, filing_unit string, error_count int, warn_count int, passed boolean"
    start = datetime.datetime(2026, 3, 1)
    rows = [(start + datetime.timedelta(minutes=rng.randrange(6 * 1440)), rng.choice(["x", "y", None]), rng.randrange(3), rng.randrange(4), rng.random() < 0.5) for _ in range(400)]
    rows += [(None, "x", 1, 1, True), (start + datetime.timedelta(days=9), "x", 0, 0, True)]
    rng.shuffle(rows)
    write_batches(spark, rows, schema, tmp_path / "in", 4)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    review_stream.audit_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), "3 hours", "1 day").awaitTermination()
    got = review_stream.closed_windows(spark, str(tmp_path / "out"))
    whole = review_stream.audit_windows(spark.createDataFrame(rows, schema).filter("ts IS NOT NULL"), "3 hours")
    closed = whole.filter(F.col("window_end") <= F.lit(start + datetime.timedelta(days=8)))
    assert got.count() > 30 and sorted(map(str, got.select(*whole.columns).collect())) == sorted(map(str, closed.collect()))
    kinds = spark.read.parquet(str(tmp_path / "out" / "windows")).groupBy("kind").count().collect()
    assert {r["kind"] for r in kinds} == {"window", "correction"}


def test_a_batch_looks_up_its_own_bundles_only(spark, tmp_path, monkeypatch):
    """Rows that reach the review follow the touched bundles, not what came before."""
    seen = []

    def counted(files, cells):
        seen.append((files.count(), {r[0] for r in cells.select("bundle_id").distinct().collect()}))
        return {name: files.select("bundle_id").distinct() for name in ("findings", "reports")}

    monkeypatch.setattr(review_stream, "review_bundles", counted)
    from sheaf import schemas

    columns = [c.split()[0] for c in schemas.FILES.split(", ")]
    row = lambda b, i: {**dict.fromkeys(columns), "bundle_id": b, "file_idx": i, "filename": f"{b}{i}", "readable": True}
    batches = [[row(f"b{k}", 0) for k in range(200)], [row("b7", 1), row("b9", 0)], [row("b7", 2)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame([[r[c] for c in columns] for r in rows], schemas.FILES).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    cells = spark.createDataFrame([(f"b{k}", "f", "s", 1, "A", "v", None) for k in range(200)], schemas.CELLS)
    review_stream.write_cells_by_bundle(cells, str(tmp_path / "cells"), 32)
    stream = review_stream.read_files(spark, str(tmp_path / "in"), max_files=1)
    review_stream.review_stream(stream, str(tmp_path / "cells"), str(tmp_path / "out"), str(tmp_path / "state"), cell_buckets=32).awaitTermination()
    assert sorted(n for n, _ in seen) == [3, 3, 200]
    assert sorted(len(b) for _, b in seen) == [1, 2, 200]


class _Pages:
    """State of one group as a dictionary, with the number of looks at it."""

    def __init__(self):
        self.kept, self.looks = {}, 0

    def exists(self):
        return bool(self.kept)

    def getValue(self, key):
        self.looks += 1
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.looks += 1
        self.kept[key] = value


def test_files_of_many_bundles_are_one_call(monkeypatch):
    """One call of the processor serves a group of bundles; each of them costs a look and an update, the first ones no look."""
    import pandas as pd

    from sheaf.streaming import state

    monkeypatch.setattr(state, "PAGE_ROWS", 4)
    monkeypatch.setattr(state, "FRAME_ROWS", 7)
    files, pages, expected = state.BundleFiles(), _Pages(), {}
    files.pages = pages

    def arrive(rows):
        frames = [pd.DataFrame(rows[k::2], columns=["bundle", "file_idx", "row"]) for k in range(2)]
        out = list(files.handleInputRows((3,), iter(frames), None))
        assert all(len(f) <= 7 for f in out)
        for b, i, row in rows:
            expected.setdefault(b, {})[i] = max(r for c, j, r in rows if (c, j) == (b, i))
        touched = {b for b, _, _ in rows}
        assert sorted(r for f in out for r in f["row"]) == sorted(r for b in touched for r in expected[b].values())

    arrive([(f"b{n}", "0", f"b{n}/0") for n in range(500)])
    assert pages.looks == 500
    arrive([("b7", "1", "b7/1"), ("b9", "0", "again"), ("b9", "0", "again, greater"), (None, "0", "no bundle"), ("b8", None, "no place")])
    rng = random.Random(5)
    for n in range(40):
        arrive([("hot", str(rng.randrange(30)), f"hot {n} {rng.random()}") for _ in range(rng.randrange(1, 6))] + [(None, "0", f"{n}"), ("b7", str(n % 9), f"{n}")])
    before = pages.looks
    arrive([("b3", "0", "third")])
    assert pages.looks - before == 2


def test_cells_of_a_folder_are_written_by_many_tasks(spark, tmp_path):
    from sheaf import schemas

    names = [c.split()[0] for c in schemas.CELLS.split(", ")]
    cells = spark.range(0, 40_000, 1, 8).selectExpr("concat('b', id % 5) AS bundle_id", "'f' AS file_id", "'s' AS sheet", "CAST(id AS int) AS row", "'A' AS col", "sha2(CAST(id AS string), 256) AS value", "CAST(null AS string) AS formula").select(*names)
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "256k")
    try:
        review_stream.write_cells_by_bundle(cells, str(tmp_path / "cells"), 2)
    finally:
        spark.conf.unset(key)
    assert len(list((tmp_path / "cells").glob("bundle_bucket=*/*.parquet"))) >= 6
    back = spark.read.parquet(str(tmp_path / "cells"))
    assert back.groupBy("bundle_id").agg(F.countDistinct("bundle_bucket").alias("n")).filter("n > 1").isEmpty()
    assert back.select(*names).exceptAll(cells).isEmpty() and back.count() == 40_000
