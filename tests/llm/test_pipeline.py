from __future__ import annotations

import random

import corpus_pipeline

STOP = "the of and to in is that it was for with on as by".split()


def prose(rng, n):
    return " ".join(rng.choice(STOP) if rng.random() < 0.3 else "".join(rng.choice("abcdeiorstn") for _ in range(rng.randrange(3, 9))) for _ in range(n)) + "."


def test_stages_catch_what_is_planted(spark, tmp_path):
    rng = random.Random(9)
    item, passage = prose(rng, 30), prose(rng, 70)
    rows = [(k, prose(rng, rng.randrange(60, 120))) for k in range(60)]
    clean = {k for k, _ in rows}
    near = rows[4][1].split()
    near[10] = "changed"
    rows += [(100, rows[3][1]), (101, " ".join(near)), (102, prose(rng, 60) + " " + item + " " + prose(rng, 60)), (103, prose(rng, 60) + " " + passage), (104, passage + " " + prose(rng, 50))]
    rows += [(200 + k, " | ".join(f"ITEM{rng.randrange(900)}$$$" for _ in range(40))) for k in range(12)] + [(300, None), (301, ""), (302, "too short")]
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 3}" if d % 5 else None, len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    held, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        held = spark.read.parquet(str(tmp_path / name))
        seen.append({r["doc_id"]: r for r in held.collect()})
    assert clean | {100, 101, 102, 103, 104} == set(seen[0])
    assert set(seen[0]) - set(seen[1]) == {100, 101}
    assert set(seen[2]) == set(seen[1]) and passage not in seen[2][104]["text"] and passage in seen[2][103]["text"]
    assert all(seen[2][d]["text"] == dict(rows)[d] for d in clean) and seen[2][104]["n_chars"] == len(seen[2][104]["text"])
    assert set(seen[2]) - set(seen[3]) == {102}
    mix = list(seen[4].values())
    taken: dict = {}
    for r in mix:
        taken.setdefault((r["source"], r["target"]), []).append(r["taken"])
    assert set(seen[4]) <= set(seen[3]) and all(abs(sum(v) - target) <= 40 for (_, target), v in taken.items())
    assert sorted((r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r["doc_id"], r["taken"]) for r in mix)


def test_rows_without_ids_shared_ids_and_repeats(spark, tmp_path):
    rng = random.Random(4)
    item, a, b, c = prose(rng, 30), prose(rng, 90), prose(rng, 90), prose(rng, 90)
    rows = [(1, a), (1, a), (1, b), (None, c), (None, c), (None, a + " end"), (None, prose(rng, 70) + " " + item), (2, None), (None, ""), (3, prose(rng, 40) + " " + item), (4, prose(rng, 80))]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 7) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, row int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    key = lambda df: sorted(((str(r["doc_id"]), str(r["text"])) for r in df.collect()))
    good = corpus_pipeline.STAGES[0][1](spark, df, str(tmp_path))
    assert set(key(good)) <= {(str(d), t) for d, t in rows if t} and good.columns == df.columns
    held, seen = df, []
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, held, str(tmp_path))
        held = spark.createDataFrame(out.collect(), out.schema)
        seen.append(key(held))
        assert held.columns == df.columns
    rest = [("1", a), ("1", b), ("None", c), ("2", "None"), ("None", ""), ("4", rows[-1][1])]
    leaks = [("None", rows[6][1]), ("3", rows[9][1])]
    assert seen[0] == sorted(rest + leaks)
    assert len(seen[1]) == 8 and set(rest) <= set(seen[1]) and sum(item in t for _, t in seen[1]) == 1  # a copy of the item is cut out of one
    assert seen[2] == sorted(x for x in seen[1] if item not in x[1])
    mix = corpus_pipeline.STAGES[4][1](spark, held, str(tmp_path)).collect()
    assert mix and all(r["copies"] in (1, 2) for r in mix)
    empty = str(tmp_path / "empty")
    df.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
