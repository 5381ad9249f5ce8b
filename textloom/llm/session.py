"""Where intermediate tables go, how lineage is cut, and how what is no longer needed is deleted."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_swept: set[str] = set()
#: Folders written within ``recorded``, innermost last.
_records: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a temporary one in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="textloom-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = f"file://{_own[0]}"
    return root.rstrip("/")


def _at(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path in it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one, wherever it lies."""
    fs, at = _at(spark, path)
    fs.delete(at, True)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder; results that still read it are gone then."""
    deleted(spark, _own_folder(spark))


def _sweep(fs: object, at: object) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone, and then nothing can be done
        fs.delete(at, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder below the application's own, which is deleted when the driver ends."""
    own = _own_folder(spark)
    if own not in _swept:
        _swept.add(own)
        atexit.register(_sweep, *_at(spark, own))  # works when the session is stopped before, too
    folder = f"{own}/{uuid.uuid4().hex}"
    for record in _records:
        record.append(folder)
    return f"{folder}/{name}"


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that are written meanwhile, so that they can be deleted once nothing reads them."""
    _records.append([])
    try:
        yield _records[-1]
    finally:
        _records.pop()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends at files that outlive any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"_{name}_{uuid.uuid4().hex}"
