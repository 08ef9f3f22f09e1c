"""Tables that cut the lineage of iterations, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where that is unset, a folder of our own if the master is local (tests); on a cluster that is an error, as executors share no local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="cairn-"))
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/cairn-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in a fresh folder: the lineage ends there, and any executor can read it again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables from ``written``; only for tables that no frame the caller holds still reads."""
    for table in tables:
        if path := getattr(table, "_cairn_path", None):
            delete(table.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of a vocabulary, term list, shape table or the like, which are sent to all executors.
VOCABULARY_ROWS = 1_000_000


def bounded(df: DataFrame, most: int = VOCABULARY_ROWS) -> DataFrame:
    """``df`` for a broadcast, after a check that it has ``most`` rows or fewer."""
    if (rows := df.limit(most + 1).count()) > most:
        raise ValueError(f"a table of over {most} rows ({rows} seen) is too large to broadcast")
    return F.broadcast(df)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
