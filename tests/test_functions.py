"""Boundary cases of the scoring and text functions."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.functions import text as T
from tessera.operators import code
from tessera.sources import io
from tessera.plans.base import CONFIG_JSON
from tessera.operators.marking import parse_config


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("has_code", "text", "code_", "ai", "want"),
    [(True, 1.0, 1.0, 1.0, (1.0, "code_present")), (True, 0.5, 0.5, 0.5, (0.5, "code_present")), (False, 1.0, 1.0, 1.0, (1.0, "theory_only")), (False, 0.4, 0.9, 0.8, (0.62, "theory_only"))],
)
def test_risk(spark, has_code, text, code_, ai, want):
    r = value(spark, scores.risk(F.lit(has_code), F.lit(text), F.lit(code_), F.lit(ai)))
    assert (round(r["weighted_score"], 9), r["weight_profile"]) == want
    assert (r["code_sim_max"] is None) == (not has_code)


def test_levels_and_bands(spark):
    assert [value(spark, scores.risk_level(F.lit(x))) for x in (0.1, 0.39, 0.40, 0.69, 0.70, 0.99)] == ["low", "low", "medium", "medium", "high", "high"]
    bands = [value(spark, scores.confidence_band(F.lit(x).cast("double"))) for x in (None, 0.2, 0.39, 0.40, 0.75, 0.76)]
    assert [b.split("_")[0] for b in bands] == ["AUTHENTIC", "AUTHENTIC", "AUTHENTIC", "INCONCLUSIVE", "INCONCLUSIVE", "PROBABLE"]


def test_marks_waive_the_inconclusive_band(spark):
    config = parse_config(F.lit('{"total_marks": 100, "ai_thresholds": [{"min_value": 0, "max_value": 100, "marks_deduct": 20}]}'))
    got = [value(spark, scores.marks(F.lit(100.0), config, F.lit(p), F.lit(0.0), F.lit(0.0), F.lit(0.0)))["marks_obtained"] for p in (0.55, 0.85)]
    assert got == [100.0, 80.0]


def test_first_threshold_in_list_order(spark):
    config = parse_config(F.lit(CONFIG_JSON))
    assert value(spark, scores.deduction(F.lit(40.0), config["ai_thresholds"])) == 0.0
    assert value(spark, scores.deduction(F.lit(75.0), config["text_copy_thresholds"])) == 10.0


def test_text(spark):
    assert value(spark, T.sanitize(F.lit("He" + chr(0x200B) + "llo" + chr(0xAD) + " Wor" + chr(0xFEFF) + "ld" + chr(0x200E)))) == "Hello World"
    assert value(spark, T.sanitize(F.lit(None).cast("string"))) == ""
    r = value(spark, T.split_code(F.lit("intro\nint a;\n\none\ntwo\nthree\nend\nreturn a;")))
    assert r["prose"] == "intro\nthree\nend" and r["blocks"] == ["int a;\n\none\ntwo", "return a;"]
    assert value(spark, T.student_name(F.lit("Course Name: X\nName: Ann Lee | Section 2"))) == "Ann Lee"
    assert value(spark, T.student_id(F.lit("Paper\nID: A-12"))) == "A-12"
    assert value(spark, T.student_id(F.lit("Student ID: section\nID: A-12"))) is None  # only the first label counts
    assert value(spark, T.stylometric(F.lit(" "))) is None


def test_code_over_parquet(spark, tmp_path):
    spark.createDataFrame([(i, f"def f{i}(x):\n    return x", f"def g(y):\n    return y + {i % 2}") for i in range(20)], "i int, x string, y string").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t").select("i", code.renamed_tokens(F.col("x")).alias("x"), code.renamed_tokens(F.col("y")).alias("y"))
    got = code.sequence_ratio(rows, "x", "y", "r").where("r > 0.5").select("i", "r").collect()
    assert len(got) == 20 and all(r["r"] < 1 for r in got)


def test_percent_text_rounds_the_double(spark):
    values = [0.1845, 0.0785, 0.0355, 0.125, 0.375, 0.999999, 0.0, 1.0, 0.29, *(i / 2000 for i in range(300))]
    got = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").select("v", io.percent_text(F.col("v")).alias("t")).collect()
    assert all(r["t"] == ("N/A" if r["v"] is None else f"{r['v'] * 100:.1f}") for r in got)


def test_sanitized_rows(spark):
    rows = spark.createDataFrame([(1, "plain"), (2, "\ufb01ne\u200b"), (3, None)], "i int, t string")
    assert {r["i"]: r["t"] for r in T.sanitized(rows, "t").collect()} == {1: "plain", 2: "fine", 3: ""}


def test_code(spark):
    a, b = "def f(x):\n    return x + 1", "def g(y):\n    return y + 1"
    c = "while True:\n    print('stop', 3 * 4)\nimport os"
    rows = spark.createDataFrame([(1, a, a), (2, a, b), (3, a, c)], "i int, x string, y string").select("i", code.renamed_tokens(F.col("x")).alias("x"), code.renamed_tokens(F.col("y")).alias("y"))
    ratio = {r["i"]: r["r"] for r in code.sequence_ratio(rows, "x", "y", "r").collect()}
    assert ratio[1] == 1.0 and ratio[2] == 1.0 and ratio[3] < 0.5
    assert value(spark, code.language(F.lit(a))) == "python"


def test_rounding_is_that_of_the_sql(spark):
    """Halves as they are after the multiplication: 0.07125 is below its half then, and its shortest text is at it."""
    import duckdb

    xs = [0.07125, 0.08625, 0.14125, 0.5, 0.0, 1.0, 0.28499999999999998, 0.12345]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(scores.rounded(F.col("x"), 4)).collect()]
    assert got == [duckdb.execute(f"SELECT round({x!r}::DOUBLE, 4)").fetchone()[0] for x in xs] and got[0] == 0.0712
    sheet = spark.createDataFrame([(1, "s", "n", False, 0.0715)], "doc long, student_id string, student_name string, has_code boolean, t double")
    risks = sheet.select("doc", F.lit("b").alias("batch"), "has_code", F.col("t").alias("text_sim_max"), F.col("t").alias("code_sim_max"), F.col("t").alias("ai_prob"), F.lit(0.1).alias("weighted_score"), F.lit("low").alias("risk_level"), F.lit("x").alias("weight_profile"))
    row = io.analysis_sheet(sheet.drop("t"), risks, sheet.select("doc", F.col("t").alias("ai_prob")), sheet.select("doc", F.lit(1.0).alias("marks_obtained"), F.lit(2.0).alias("total_marks"))).first()
    want = duckdb.execute("SELECT round(0.0715::DOUBLE * 100, 1)").fetchone()[0]
    assert (row["text_sim_max"], row["ai_probability"], row["code_sim_max"]) == (want, want, str(want))
