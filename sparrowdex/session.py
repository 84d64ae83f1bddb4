"""Session helpers: defaults for local runs and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "sparrowdex") -> SparkSession:
    """A session for one machine. On a cluster the caller brings the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir if set, else (local tests) a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="sparrowdex-")
        LOCAL[spark.sparkContext.applicationId] = place
    return place


def written(df: DataFrame, name: str) -> str:
    """Write to a new folder of the shared folder; its path."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    HELD.append(path)
    return path


def through_table(df: DataFrame, name: str) -> DataFrame:
    """Write to a table in the shared folder and read it again: cuts the lineage and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `through_table` writes inside are deleted at the end; results must be taken or written before."""
    held = len(HELD)
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in HELD[held:]:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        del HELD[held:]


#: Folders written by this process.
HELD: list[str] = []
#: The shared folders of sessions without spark.checkpoint.dir (local tests).
LOCAL: dict[str, str] = {}
