from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom import concordance, list_loaded_models, prefetch_model, token_rows, token_strings, tokenize
from textloom.functions.tokenize import NATIVE, register_dictionary, route

TEXTS = [("[CLS] hello [SEP] [PAD] [UNK]",), ("Please wear a mask",), ("",), (None,), ("Hello, Queensland",), ("naïve café 🙂 x",), ("İstanbul ΑΣ.",), ("你好，世界 a　b",), ("don't stop—now",)]


def test_native_goldens(spark):
    df = spark.createDataFrame(TEXTS, "t string")
    got = [r["x"] for r in df.select(token_strings("t").alias("x")).collect()]
    assert got[:4] == [["hello"], ["please", "wear", "a"], [], []]


@pytest.mark.parametrize(("lowercase", "remove_punct"), [(True, True), (True, False), (False, True), (False, False)])
def test_three_forms_agree(spark, lowercase, remove_punct):
    options = {"lowercase": lowercase, "remove_punct": remove_punct}
    df = spark.createDataFrame([(k, t) for k, (t,) in enumerate(TEXTS)], "id int, t string").filter("t is null or t not like 'İ%'")
    strings = {r["id"]: r["x"] for r in df.select("id", token_strings("t", **options).alias("x")).collect()}
    spans = {r["id"]: [(x["token"], x["start"], x["end"]) for x in r["x"]] for r in df.select("id", tokenize("t", model=NATIVE, **options).alias("x")).collect()}
    rows: dict = {k: [] for k in spans}
    for r in token_rows(df, "id", "t", **options).orderBy("id", "start").collect():
        rows[r["id"]].append((r["token"], r["start"], r["end"]))
    assert rows == spans and {k: [x[0] for x in v] for k, v in spans.items()} == strings
    for k, (t,) in enumerate(TEXTS):
        for token, a, b in spans.get(k, ()):
            assert (t.lower() if lowercase else t)[a:b] == token


def test_routing():
    for bad, words in (("native:other", "Unknown native"), ("huggingface: ", "must include"), ("lindera:x", "Unknown Lindera"), ("x", "Unknown tokenizer")):
        with pytest.raises(ValueError, match=words):
            route(bad)
    with pytest.raises(ValueError):
        tokenize("t", model=" ")
    prefetch_model(NATIVE)
    assert NATIVE in list_loaded_models()
    with pytest.raises(RuntimeError, match="dictionary"):
        prefetch_model("lindera:jieba")


def test_dictionary_model(spark):
    register_dictionary("lindera:ko-dic", lambda: lambda text: [(c, k, k + 1) for k, c in enumerate(text)])
    df = spark.createDataFrame([("ab.",)], "t string")
    assert [x["token"] for x in df.select(tokenize("t", model="lindera:ko-dic").alias("x")).first()["x"]] == ["a", "b"]


def test_file_tokenizer(spark):
    model = "huggingface:/opt/tokenizers/byte_bpe_50k.json"
    df = spark.createDataFrame([("Hello there",)], "t string")
    got = df.select(tokenize("t", model=model, lowercase=False).alias("x")).first()["x"]
    assert "".join("Hello there"[x["start"] : x["end"]] for x in got) == "Hello there"


def test_concordance(spark):
    df = spark.createDataFrame([("Hello world, hello again.",), ("unhappy days",), (None,), ("a $5 (x) bill",)], "t string")

    def hits(word, **options):
        return [[tuple(h) for h in r["x"]] for r in df.select(concordance("t", word, **options).alias("x")).collect()]

    assert hits("hello", num_left_tokens=1, num_right_tokens=1)[0] == [("", "Hello", "world", 0, 5, "", "world"), (",", "hello", "again", 13, 18, ",", "again")]
    assert hits("happy")[1][0][5:] == ("un", "days")
    assert hits("")[0] == [] and hits("hello")[2] == []
    assert [h[1] for h in hits("$5 (x)")[3]] == ["$5 (x)"]
    assert hits("HELLO", case_sensitive=True)[0] == []
    assert [h[1] for h in hits(r"h\w+", regex=True)[0]] == ["Hello", "hello"]
    assert [h[1] for h in hits(r"again.$", regex=True)[0]] == ["again."]
    assert hits("hello", num_left_tokens=-1, num_right_tokens=0)[0][1][0] == ""
    for bad in ("(", "(?=x)", r"(a)\1"):
        with pytest.raises(ValueError, match="Concordance failed"):
            concordance("t", bad, regex=True)
    rows = df.select(F.inline_outer(concordance("t", "zzz"))).collect()
    assert len(rows) == 4 and all(v is None for r in rows for v in r)
