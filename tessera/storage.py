"""Intermediate tables in the folder that every executor and the driver share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of sessions whose ``spark.checkpoint.dir`` is unset, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where it is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = _own[app]
    return base.rstrip("/")


#: Spark's own switch: the shuffle files of a query are deleted when it ends, not when the driver's heap is next collected.
_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str, codec: str | None = None, buckets: tuple[int, str] | None = None, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends at the files,
    so a lost executor costs no more than the stage that was running.

    With ``buckets`` (how many, and a column) the table is bucketed: a join or cogroup on the column doesn't shuffle it.
    With ``drop_shuffles`` the shuffles that made the table leave the disk once it is written.
    """
    if drop_shuffles:
        conf, before = df.sparkSession.conf, df.sparkSession.conf.get(_DROP)
        conf.set(_DROP, "true")
        try:
            return materialize(df, tag, codec, buckets)
        finally:
            conf.set(_DROP, before)
    spark = df.sparkSession
    name = f"{tag}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    write = df.write.options(**({"compression": codec} if codec else {}))
    if buckets:
        table = name.replace("-", "_")
        write.format("parquet").bucketBy(*buckets).option("path", path).saveAsTable(table)
        return spark.table(table)
    write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` returned and nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
