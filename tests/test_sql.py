"""Functions under SQL names against the column functions, and a query in SQL alone."""

import random

import pytest
from pyspark.sql import functions as F

from sheaf.functions import sql
from sheaf.functions import text as X
from sheaf.operators import chunking, refs

COLUMNS = {
    "strip_text(s)": lambda: X.strip(F.col("s")),
    "clean_text(s)": lambda: X.clean(F.col("s")),
    "squeeze_text(s)": lambda: X.squeeze(F.col("s")),
    "match_key(s)": lambda: X.match_key(F.col("s")),
    "clip_text(s, 5)": lambda: X.clip(F.col("s"), 5),
    "table_cell(s)": lambda: X.table_cell(F.col("s")),
    "estimate_tokens(s)": lambda: X.estimate_tokens(F.col("s")),
    "normalize_path(s)": lambda: X.normalize_path(F.col("s")),
    "ancestors(s)": lambda: X.ancestors(F.col("s")),
    "display_ref(code, s)": lambda: X.display_ref(F.col("code"), F.col("s")),
    "natural_key(s)": lambda: X.natural_key(F.col("s")),
    "split_sentences(s)": lambda: chunking.split_sentences(F.col("s")),
    "split_sentences(s, '.')": lambda: chunking.split_sentences(F.col("s"), "."),
    "nfkc(s)": lambda: X.nfkc(F.col("s")),
}
PIECES = ["R01", "R12", "Ｒ０３", "、", "&", "/", "／", ";", "；", "\n", "(二)", "（三）", "五", "2", "-", "1.5", " ", "　", "\t", " ", "。", ".", "|", "ß", "A", "'", "\\", ""]


@pytest.fixture(scope="module")
def texts(spark):
    sql.register_functions(spark)
    draw = random.Random(7)
    rows = [(i, "R09", "".join(draw.choices(PIECES, k=draw.randint(0, 14)))) for i in range(600)]
    df = spark.createDataFrame([*rows, (600, None, None), (601, "R09", "")], "id int, code string, s string").repartition(4)
    df.createOrReplaceTempView("sql_texts")
    return df


@pytest.mark.parametrize("call", sorted(COLUMNS))
def test_function_equals_column(spark, texts, call):
    by_sql = {r[0]: r[1] for r in spark.sql(f"SELECT id, {call} FROM sql_texts").collect()}
    by_column = {r[0]: r[1] for r in texts.select("id", COLUMNS[call]().alias("v")).collect()}
    assert len(by_sql) == 602 and by_sql == by_column


def test_parse_refs(spark, texts):
    got = spark.sql("SELECT id, r.* FROM (SELECT id, parse_refs(s) AS found FROM sql_texts) LATERAL VIEW inline(found) r AS ref_idx, reg_code, section_path_prefix")
    want = refs.parse_refs(texts, ["id"], "s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100


def test_functions_stay_within_the_row(spark, texts):
    """No join, no shuffle: bodies are put in place."""
    df = spark.sql("SELECT id, reg_code, display_ref(reg_code, path) FROM (SELECT id, parse_refs(s) AS found FROM sql_texts) LATERAL VIEW inline(found) r AS i, reg_code, path")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_filters_reach_the_scan(spark, texts, tmp_path):
    texts.write.parquet(str(tmp_path / "t"))
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("sql_stored")
    df = spark.sql("SELECT clean_text(s) AS c FROM sql_stored WHERE id < 5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(id,5)" in plan and "ReadSchema: struct<id:int,s:string>" in plan


@pytest.mark.parametrize("call", ["split_sentences(s)", "split_sentences(s, '.')", None])
def test_sentences_split_a_text_once(texts, call):
    """The parts are not made again for each of them."""
    df = texts.select((F.expr(call) if call else chunking.split_sentences(F.col("s"))).alias("x"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
