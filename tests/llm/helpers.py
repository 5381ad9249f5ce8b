from __future__ import annotations

import random
import re

#: Columns that operators use themselves, and the type of each.
CLASHES = "doc bigint, key bigint, seg bigint, place bigint, kind int, size bigint, slot int, lot double, row int, page bigint, _id bigint, pattern bigint, mult bigint, task bigint"
LONG = " ".join(f"w{k % 977}x{k // 977}" for k in range(60_000))


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(seed: int, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Small texts of few words with copies, shared passages, runs, nulls and empty ones."""
    rng = random.Random(seed)
    vocabulary = ["a", "b", "é", "word", "🙂", "of", "the", "x" * 40]
    passage = [rng.choice(vocabulary) + str(rng.randrange(30)) for _ in range(45)]
    out: list[tuple[int | None, str | None]] = []
    for k in range(n):
        t = [rng.choice(vocabulary) + str(rng.randrange(50)) for _ in range(rng.randrange(0, 90))]
        if k % 3 == 0:
            t[len(t) // 2 : len(t) // 2] = passage[rng.randrange(10) : 45 - rng.randrange(10)]
        if k % 7 == 0:
            t += [rng.choice(vocabulary)] * rng.randrange(60)
        if k % 11 == 0:
            t += ["p", "q"] * rng.randrange(40)
        out.append((k, rng.choice([" ", "\n", "\t "]).join(t)))
    return [*out, (n, out[0][1]), (n + 1, out[3][1]), (n + 2, None), (n + 3, ""), (n + 4, " \n "), (None, out[3][1]), (n + 5, "one two")]


def frame(spark, rows, clashes: bool = True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    if clashes:
        for c in CLASHES.split(", "):
            name, kind = c.split(" ")
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(5).cast(kind))
    return df.repartition(3)
