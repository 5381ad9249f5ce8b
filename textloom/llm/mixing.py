"""Mixing sources to target weights by subset-sum budget fitting (operator 4).

Documents are counted by source and exact length in words. A source whose target is above its
size is taken whole, once or twice; the rest of its budget is filled from that table of counts:
each length gives its proportional share of documents, and what remains, a few documents' words,
goes to a bounded-knapsack dynamic programme over the remaining counts. Within a length,
documents are chosen by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import read_table, staged

WEIGHTS, BUDGET, MOST, SEED = (5, 2, 1), 1.5, 2, 20240601
#: Documents that the dynamic programme chooses from, and the bits of sums that it may shift (fewer documents, if very long ones are left to fit).
POOL, WORK = 1 << 12, 1 << 34
#: Documents of a hash bucket.
BUCKET, BUCKETS = 256, 1 << 14


def targets(sizes: list[int], weights: list[float], budget: float, most: float = MOST) -> list[float]:
    """Shares of ``budget`` by weight, at most ``most`` times a size; what is above goes to the others, again by weight."""
    out, left, over = [0.0] * len(sizes), float(budget), set(range(len(sizes)))
    while over:
        total = sum(weights[i] for i in over)
        full = {i for i in over if left * weights[i] / total >= most * sizes[i]}
        if not full:
            for i in over:
                out[i] = left * weights[i] / total
            return out
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        over -= full
    return out


def knapsack(items: list[int], target: int) -> list[int]:
    """Indices of items whose sum comes nearest to ``target`` from below, exactly.

    The set of sums that can be made is one integer, a bit for each sum, which an item shifts;
    the choice is read back from sets at every 32nd item, and between them in the same way.
    """
    mask = (1 << (target + 1)) - 1

    def forward(bits: int, first: int, last: int, every: int) -> list[int]:
        """The sets before items first, first + every, ..., and after the last."""
        out = []
        for k in range(first, last):
            if (k - first) % every == 0:
                out.append(bits)
            bits |= (bits << items[k]) & mask
        return [*out, bits]

    def back(bits: int, first: int, last: int, at: int, chosen: list[int]) -> int:
        """Read back items from last to first for the sum ``at``; the sum that is left."""
        every = 1
        while (last - first) / every > 32:
            every *= 32
        sets = forward(bits, first, last, every)[:-1]
        for n in range(len(sets) - 1, -1, -1):
            a = first + n * every
            if every > 1:
                at = back(sets[n], a, min(last, a + every), at, chosen)
            elif not sets[n] >> at & 1:
                chosen.append(a)
                at -= items[a]
        return at

    # no further than needed: blocks of items until the target itself can be made
    bits, end = 1, 0
    while end < len(items) and not bits >> target & 1:
        last = min(len(items), end + 32)
        bits, end = forward(bits, end, last, 32)[-1], last
    chosen: list[int] = []
    back(1, 0, end, bits.bit_length() - 1, chosen)
    return chosen


def shares(counts: np.ndarray, part: int, total: int, start: int) -> np.ndarray:
    """Whole numbers near counts * part / total (at most 1): their sum up to any place is rounded at one point for all, so it is less than 1 off."""
    edges = (np.cumsum(counts).astype(object) * part + start) // total
    return np.diff(edges, prepend=0).astype(np.int64)


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """How many documents of each length (ascending, above 0) to take, at most ``counts``, to come as near below ``budget`` as found.

    Every length gives its share of the documents, at any budget: shares are rounded along the
    lengths, so their words are less than two of the longest documents off, and as much is left
    open for the programme. It fills what is left from a pool of documents drawn alike from all
    lengths that fit, in random order, so its choice follows the lengths as well. A pool of short
    documents may hold too few words for what a very long one left open; then shares of lengths
    up to a quarter of that come first. The result is exact over the pool, which has all
    documents that are left where these are fewer than POOL.
    """
    if budget >= int((lengths * counts).sum()):
        return counts.copy()
    rng = np.random.default_rng(seed)
    take, left, top, pool = np.zeros(len(lengths), np.int64), int(budget), int(budget), None
    while True:
        free = np.flatnonzero((counts > take) & (lengths <= left))
        n, most = (counts - take)[free], max(64, min(POOL, WORK // max(1, left)))
        if n.sum() <= most:
            pool = np.repeat(free, n)
            break
        drawn = np.repeat(free, shares(n, most, int(n.sum()), int(rng.integers(0, n.sum()))))
        if top < lengths[0] or (top < budget and int(lengths[drawn].sum()) >= 2 * left):
            pool = drawn
            break
        free = np.flatnonzero((counts > take) & (lengths <= top))
        n = (counts - take)[free]
        total = int((n * lengths[free]).sum())
        part = min(total, left - 2 * int(lengths[free].max(initial=0)))
        if part > 0:
            more = shares(n, part, total, int(rng.integers(0, total)))
            take[free] += more
            left -= int((more * lengths[free]).sum())
        top //= 4
    if len(pool):
        pool = rng.permutation(pool)
        unit = int(np.gcd.reduce(lengths[pool]))
        chosen = pool[knapsack((lengths[pool] // unit).tolist(), left // unit)]
        np.add.at(take, chosen, 1)
    return take


def _fitted(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    return pd.DataFrame({"slot": pdf["slot"], "size": pdf["size"], "n": pdf["n"], "chosen": fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["rest"].iloc[0]))})


def source_targets(made: DataFrame, weights: tuple[float, ...], budget: float, most: int) -> DataFrame:
    """(slot, source, source_size, target, whole, rest), a row a source, from (source, size).

    Nothing of a source reaches the driver: a source's place among all is counted by sorted
    partitions, and ``targets`` goes round by round over sums.
    """
    spark = made.sparkSession
    by_source = made.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("source_size"))
    ordered = staged(by_source.sort(F.asc_nulls_last("source")).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33).cast("bigint")
    sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    before = np.append(0, np.cumsum([n for _, n in sizes])).tolist()
    offsets = spark.createDataFrame([(p, int(before[k])) for k, (p, _) in enumerate(sizes)], "part bigint, before bigint")
    slots = ordered.withColumn("part", part).join(offsets, "part").withColumn("slot", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1))
    weight = F.get(F.array(*map(F.lit, map(float, weights))), (F.col("slot") % len(weights)).cast("int"))
    slots = staged(slots.select("slot", "source", "source_size", weight.alias("weight")), "slots")
    words, weight = slots.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    # a source that is full at one level stays full as the others' level rises; none is at first
    level, open_weight, open_size = None, weight, words
    while open_weight:
        new = (budget * words - most * (words - open_size), open_weight)
        if new == level:
            break
        level = new
        below = F.lit(level[0]) * F.col("weight") / F.lit(level[1]) < most * F.col("source_size")
        open_weight, open_size = slots.agg(F.sum(F.when(below, F.col("weight")).otherwise(0.0)), F.sum(F.when(below, F.col("source_size")).otherwise(0))).first()
    share = F.lit(level[0]) * F.col("weight") / F.lit(level[1]) if level else F.lit(0.0)
    target = F.least(share, (most * F.col("source_size")).cast("double"))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(target / F.col("source_size")))).otherwise(0).cast("int")
    plan = slots.select("slot", "source", "source_size", target.alias("target"), whole.alias("whole"))
    rest = F.when(F.col("whole") < most, F.round("target").cast("bigint") - F.col("whole") * F.col("source_size")).otherwise(F.lit(0)).cast("bigint")
    return plan.withColumn("rest", rest)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, copies, taken.

    Size is the number of words (null and empty texts: 0; texts may have any length). Sources by
    code point, null last, get ``weights`` in turn, of ``budget`` times all words. taken = size *
    copies, copies at most ``most``. Choices depend on ids and texts, not on the order of rows;
    null ids are told apart by their texts; rows equal in both are ties, broken anyhow with the
    same number taken. Documents without words are taken as often as the whole source is. An
    empty table gives an empty one; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"), F.lit(0))
    lot = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), text), 1) / F.lit(float(1 << 63))
    made = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), lot.alias("lot"), F.xxhash64(F.lit(seed), text).alias("tie")), "sizes")
    plan = staged(source_targets(made, weights, budget, most), "targets")
    slots = made.join(plan, made["source"].eqNullSafe(plan["source"])).select("doc_id", made["source"], "size", "lot", "tie", "slot", "source_size", "target", "whole", "rest")
    counts = slots.filter("size > 0 AND rest > 0").groupBy("slot", "size", "rest").agg(F.count(F.lit(1)).alias("n"))
    chosen = staged(counts.groupBy("slot").applyInPandas(_fitted, "slot bigint, size bigint, n bigint, chosen bigint"), "chosen")
    # the lots of a length fall in buckets of about BUCKET documents; whole buckets are taken up to the one that the count ends in
    buckets = F.least(F.lit(BUCKETS), F.ceil(F.col("n") / BUCKET)).cast("bigint")
    marked = slots.filter("size > 0 AND rest > 0").join(chosen.filter("chosen > 0"), ["slot", "size"]).withColumn("bucket", F.floor(F.col("lot") * buckets))
    filled = marked.groupBy("slot", "size", "chosen", "bucket").agg(F.count(F.lit(1)).alias("own"))
    before = F.sum("own").over(Window.partitionBy("slot", "size").orderBy("bucket")) - F.col("own")
    ends = staged(filled.withColumn("before", before).filter("before < chosen AND before + own >= chosen").select("slot", "size", F.col("bucket").alias("end"), (F.col("chosen") - F.col("before")).alias("more")), "ends")
    cut = slots.join(chosen.select("slot", "size", "n"), ["slot", "size"], "left").join(ends, ["slot", "size"], "left").withColumn("bucket", F.floor(F.col("lot") * buckets))
    cut = staged(cut, "cut")
    place = F.row_number().over(Window.partitionBy("slot", "size").orderBy("lot", "tie", "doc_id"))
    last = cut.filter("bucket = end").withColumn("extra", (place <= F.col("more")).cast("int"))
    others = cut.filter("end IS NULL OR bucket <> end").withColumn("extra", F.coalesce((F.col("bucket") < F.col("end")).cast("int"), F.lit(0)))
    out = last.unionByName(others).withColumn("copies", F.col("whole") + F.col("extra"))
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each row that it takes, with its size, its source's target and its number of copies (see ``mix_sources`` for nulls, ties and repeated rows)."""
    return mix_sources(docs).filter("copies > 0")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op4_mixing_sources``: all but the choice, and that no document is taken more than twice."""
    rows = op4_mixing_sources(spark, sf_dir)
    return rows.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), (F.col("taken") <= 2 * F.col("size")).alias("within"))


TARGETS_ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, 2.0 * n / w AS full_at, 1.5 * sum(n) OVER () - coalesce(sum(2 * n) OVER (ORDER BY 2.0 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
  sum(w) OVER (ORDER BY 2.0 * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM s),
level AS (SELECT min_by(remaining / weights, full_at) FILTER (remaining / weights <= full_at) AS level FROM o)
SELECT doc_id, size, n AS source_size, round(CAST(least(2 * n, coalesce(level, 1e300) * w) AS DOUBLE), 4) AS target, true AS within FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, level
"""
