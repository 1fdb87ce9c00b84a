"""Intermediate tables in the folder that spark.checkpoint.dir names: lineage ends in files that outlive any executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_CUTS: list[DataFrame] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset, as in local tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = _LOCAL.setdefault("folder", "file://" + tempfile.mkdtemp(prefix="rankspark-"))
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes a frame to the shared folder and reads it again."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    _CUTS.append(out)
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(where)  # what no job drops goes with the application
    return out


def drop_cut(*frames: DataFrame) -> None:
    """Deletes the files of frames made by cut(); no later plan may read them."""
    for df in frames:
        if path := getattr(df, "_cut_path", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
            _CUTS[:] = [x for x in _CUTS if x is not df]


def cut_mark() -> int:
    return len(_CUTS)


def cuts_since(mark: int) -> list[DataFrame]:
    """The frames cut since cut_mark() gave that number and not dropped; a job that has its result drops them."""
    return _CUTS[mark:]
