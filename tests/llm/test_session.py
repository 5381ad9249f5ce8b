from __future__ import annotations

from types import SimpleNamespace

import pytest

from textloom.llm import session


def test_folders_are_recorded_and_deleted(spark, tmp_path):
    with session.recorded() as made:
        kept = session.staged(spark.range(3), "kept")
        session.staged(spark.range(4), "gone")
    assert len(made) == 2 and kept.count() == 3 and all(spark.sparkContext.applicationId in x for x in made)
    session.deleted(spark, made[1])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{made[1]}/gone")
    assert kept.count() == 3


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    for master, fine in (("spark://host:7077", False), ("local[2]", True)):
        one = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
        if fine:
            assert session.shared_dir(one).startswith("file:///")
        else:
            with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
                session.shared_dir(one)
