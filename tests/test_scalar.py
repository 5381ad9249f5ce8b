from __future__ import annotations

from pyspark.sql import functions as F

from textloom import char_count, clean_text, sentence_count, text, word_count


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f("t").alias("x")).first()["x"]


def test_clean_text(spark):
    cases = {"Hello, World! 123": "hello world", None: "", "  Hi--there\t42 ": "hi there", "Ａ　b c": "ａ b c", "ΑΣ": "ας"}
    for value, want in cases.items():
        assert one(spark, clean_text, value) == want


def test_word_count(spark):
    cases = {"hello world": 2, "  one   two  ": 2, "single": 1, "": 0, None: 0, "今天天气很好": 6, "你好": 2, "ご飯": 2, "안녕하세요": 5, "Hello 你好": 2, "今天 nice 天气": 3, "你好。": 1, "a　b": 2, "・": 1}
    rows = spark.createDataFrame(list(cases.items()), "t string, n int").select("t", "n", word_count("t").alias("x")).collect()
    assert [(r["t"], r["x"]) for r in rows] == [(r["t"], r["n"]) for r in rows]


def test_counts(spark):
    rows = spark.createDataFrame([("abc",), ("",), (None,), ("a🙂é",), ("  ",)], "t string").select(char_count("t").alias("c")).collect()
    assert [r["c"] for r in rows] == [3, 0, 0, 3, 2]
    cases = {"One. Two? Three!": 3, "": 0, None: 0, "3.14": 2, "...": 0, "tail": 1, "你好。再见！": 2, "एक। दो॥": 2}
    rows = spark.createDataFrame(list(cases.items()), "t string, n int").select("n", sentence_count("t").alias("x")).collect()
    assert all(r["n"] == r["x"] for r in rows)


def test_accessor_and_pushdown(spark, tmp_path):
    df = spark.createDataFrame([(1, "A b"), (2, "c d e")], "id int, t string")
    assert [r["n"] for r in df.select(text("t").word_count().alias("n")).collect()] == [2, 3]
    df.write.parquet(str(tmp_path / "x"))
    plan = spark.read.parquet(str(tmp_path / "x")).select("id", text("t").clean_text().alias("c")).filter(F.col("id") == 2)._jdf.queryExecution().toString()
    assert "EqualTo(id,2)" in plan and "Python" not in plan
