"""A positional index: words and phrases with their contexts by joins on places, so that searches don't read texts again.

Two Parquet tables. ``texts`` has a row for each text (row, id, and its tokens of the native model in order with their starts);
``postings`` has a row for each token (row, place, token, start, end), by token and in ranges, so that a search
reads the row groups of its words. A phrase is a join of postings on neighbouring places, and
contexts are pieces of a text's tokens, which meet all the text's hits once. What a task sorts is about ``PART`` tokens,
however many there are. What is shuffled is as short as it can be: a posting's place and start go as one number and its end,
which follows of the token, is not sent; a text's tokens, which have no white space, go as one string.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokenize import NATIVE, native_spans, tokenize
from .stages import swept

#: Tokens of a task, about.
PART = 1 << 20
#: Of the Parquet writer: small row groups, numbers as differences.
_WRITE = {"parquet.block.size": str(8 << 20), "compression": "zstd", "parquet.writer.version": "v2"}
_WRITE |= {f"parquet.enable.dictionary#{c}": "false" for c in ("row", "place", "start", "end", "start.list.element")}


class PositionalIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.texts, self.postings = (spark.read.parquet(f"{path}/{t}") for t in ("texts", "postings"))
        self.parts = self.postings.count() // PART + 1  # from the files' footers

    @classmethod
    def build(cls, df: DataFrame, id_col: str, text_col: str, path: str) -> PositionalIndex:
        """Write the index of ``df`` below ``path``, which must not be there. Ids may repeat: each row is a text of its own.

        Texts are tokenized once; null and empty ones have no tokens. A frequent token's postings lie in as
        many ranges as they need.
        """
        spark, path = df.sparkSession, path.rstrip("/")
        texts = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        found = texts.withColumn("t", tokenize("text", model=NATIVE, lowercase=False, remove_punct=False))
        found.select("row", "id", F.col("t.token").alias("tokens"), F.col("t.start").alias("start")).write.options(**_WRITE).parquet(f"{path}/texts")
        written = spark.read.parquet(f"{path}/texts")
        parts = (written.agg(F.sum(F.size("start"))).first()[0] or 0) // PART + 1
        each = written.select("row", F.posexplode(F.arrays_zip("tokens", "start")).alias("place", "t"))
        each = each.select("row", (F.shiftleft(F.col("place").cast("bigint"), 32) + F.col("t.start")).alias("at"), F.col("t.tokens").alias("token"))
        low, start = F.lower("token"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1))
        ordered = each.repartitionByRange(parts, low, "row", "at").sortWithinPartitions(low, "row", "at")
        postings = ordered.select("row", F.shiftright("at", 32).cast("int").alias("place"), "token", low.alias("low"), start.alias("start"), (start + F.char_length("token")).alias("end"))
        postings.write.options(**_WRITE).parquet(f"{path}/postings")
        swept(spark)
        return cls(spark, path)

    def hits(self, phrase: str, case_sensitive: bool = False) -> DataFrame:
        """(row, place, width, start, end, tokens) of the phrase's tokens next to each other, whatever lies between them."""
        wanted = [t for t, *_ in native_spans(phrase, False)]
        made = None
        for k, token in enumerate(wanted):
            same = F.col("low") == token.lower()
            own = self.postings.filter(same & (F.col("token") == token) if case_sensitive else same)
            own = own.select("row", (F.col("place") - k).alias("place"), F.col("token").alias(f"t{k}"), F.col("start").alias(f"s{k}"), F.col("end").alias(f"e{k}"))
            made = own if made is None else made.join(own, ["row", "place"])
        if made is None:
            return self.postings.limit(0).select("row", "place", F.lit(0).alias("width"), "start", "end", F.array("token").alias("tokens"))
        last = len(wanted) - 1
        return made.select("row", "place", F.lit(last + 1).alias("width"), F.col("s0").alias("start"), F.col(f"e{last}").alias("end"), F.array(*[f"t{k}" for k in range(last + 1)]).alias("tokens"))

    def search(self, phrases: Sequence[str], *, num_left_tokens: int = 5, num_right_tokens: int = 5, case_sensitive: bool = False) -> DataFrame:
        """(phrase, id, hit, left_context, matched_text, right_context, start_idx, end_idx, l1, r1) of all hits of all ``phrases``.

        ``hit`` counts a phrase's hits within a text from 1. Hits of a phrase may overlap. The
        matched text is the phrase's tokens with one space between; contexts are as a concordance has them.
        """
        left, right = max(0, num_left_tokens), max(0, num_right_tokens)
        found = None
        for phrase in phrases:
            own = self.hits(phrase, case_sensitive).withColumn("phrase", F.lit(phrase))
            found = own if found is None else found.unionByName(own)
        if found is None:
            raise ValueError("no phrase to search for")
        by_text = found.repartition(self.parts, "row").groupBy("row").agg(F.collect_list(F.struct("phrase", "place", "width", "start", "end", "tokens")).alias("hits"))
        words = self.texts.select("row", "id", F.array_join("tokens", " ").alias("words")).repartition(self.parts, "row").withColumn("words", F.split("words", " "))

        def with_sides(h: Column) -> Column:
            before = F.slice("words", F.greatest(h["place"] - left, F.lit(0)) + 1, F.least(h["place"], F.lit(left)))
            return F.struct(h["phrase"].alias("phrase"), h["place"].alias("place"), h["start"].alias("start"), h["end"].alias("end"), h["tokens"].alias("tokens"), before.alias("left"), F.slice("words", h["place"] + h["width"] + 1, F.lit(right)).alias("right"))

        whole = words.join(by_text, "row").select("row", "id", F.inline(F.transform("hits", with_sides)))
        left_side, right_side = F.col("left"), F.col("right")
        end: Column = F.coalesce(F.try_element_at(left_side, F.lit(-1)), F.lit(""))
        hit = F.row_number().over(Window.partitionBy("phrase", "row").orderBy("place"))
        return whole.select(
            "phrase", "id", hit.alias("hit"), F.array_join(left_side, " ").alias("left_context"), F.array_join("tokens", " ").alias("matched_text"),
            F.array_join(right_side, " ").alias("right_context"), F.col("start").alias("start_idx"), F.col("end").alias("end_idx"), end.alias("l1"), F.coalesce(F.get(right_side, 0), F.lit("")).alias("r1"),
        )
