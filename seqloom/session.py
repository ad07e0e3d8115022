"""Small helpers around a SparkSession that every subpackage shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context.

    Vectorised functions import it there; so it need not be installed on, or on the path of, the workers.
    """
    sc = spark.sparkContext
    if getattr(sc, "_seqloom_shipped", False):
        return
    package = Path(__file__).parent
    archive = f"{tempfile.mkdtemp(prefix='seqloom-')}/seqloom-package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(archive)
    sc._seqloom_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (any path Spark's readers can open)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's switch for removing a query's shuffle files as it ends; it counts for frames made while it is on.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run inside leave no shuffle files on the executors.

    Otherwise they stay until the driver happens to collect its garbage; over many rounds
    of small queries that is most of the disk.  A frame made inside should not be run twice.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as files that every executor can read.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  A
    machine-local folder is made only where that is unset and Spark runs in local
    mode (tests); on a cluster a missing setting is an error.  Shuffle files of the computation go as it ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            shared = tempfile.mkdtemp(prefix="seqloom-checkpoint-")
        sc.setCheckpointDir(shared)
    with without_shuffle_files(spark):
        return df.select("*").checkpoint(eager=True)  # a new frame, since df was made outside


def forget(*used: DataFrame) -> None:
    """Removes the files of frames that ``checkpointed`` gave, when nothing reads them any more."""
    for df in used:
        place = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if place.isDefined():
            remove_shared(df.sparkSession, place.get())


def input_bytes(df: DataFrame) -> int:
    """About how many bytes ``df`` reads: the sizes of its sources, or a full split per partition if that is less.

    A source's size is that of its files; one that Spark doesn't know counts as huge.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sources = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return min(sources, df.rdd.getNumPartitions() * int(split))


def parallel(df: DataFrame, key: str) -> DataFrame:
    """``df``, dealt out by ``key`` if it has fewer partitions than the cluster has cores.

    So a table of one small file is not the work of one task; an input of many splits is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def local_session(app: str = "seqloom", cpus: int = 8, memory: str = "12g") -> SparkSession:
    """A ``local[cpus]`` session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_path(spark: SparkSession) -> str:
    """A new path below the shared checkpoint folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        checkpointed(spark.range(0))  # sets the folder
    return f"{sc.getCheckpointDir()}/tables/{uuid.uuid4().hex}"


def write_shared(df: DataFrame) -> str:
    """Writes ``df`` as Parquet below the shared checkpoint folder; the path of the table.

    Smaller than a checkpoint for wide rows, and it can be removed when it has been used.
    """
    path = shared_path(df.sparkSession)
    with without_shuffle_files(df.sparkSession):
        df.write.parquet(path)
    return path


def remove_shared(spark: SparkSession, path: str) -> None:
    """Removes a table that ``write_shared`` wrote, or any folder that every executor can reach."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
