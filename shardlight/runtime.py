"""Session, table access and lineage helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: White space as the test tables define it (Unicode White_Space plus the C0 separators).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shardlight")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of the session, which need not have it on their path. Once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="shardlight-code-"), "shardlight.zip")  # of the driver; Spark serves it
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "shardlight")):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables of this application.

    A cluster names the folder above it in ``spark.checkpoint.dir``; without that setting a cluster is an error. Only in a local session
    a temporary folder is made, once, and removed at the end. :func:`clean` removes what an application wrote.
    """
    above = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.shardlight.dir", None)
    if not above:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="shardlight-")
        atexit.register(shutil.rmtree, made, True)
        above = "file://" + made
        spark.conf.set("spark.shardlight.dir", above)
    return f"{above.rstrip('/')}/shardlight-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Removes the intermediate tables of this application; results that were not written elsewhere can't be read after it."""
    from shardlight.folder import Folder

    Folder(spark, shared_dir(spark)).delete()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable shared storage and go on from there (cuts the lineage).

    A written table rather than a checkpoint: the size estimates of a checkpoint are those of its plan, and in loops of
    joins they grow without bound.
    """
    return stored(df, "cut")


def stored(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cheaper to read selectively than a checkpoint: columns can be pruned and filters pushed down.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than cores (one small file) spread over them; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shuffle_width(df: DataFrame) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
