"""Session, scratch tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most this many rows; the callers' rows are at most a few dozen bytes wide.
BROADCAST_ROWS = 250_000

_registered: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine; on a cluster, build your own and pass it in."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; a temporary one only where that is unset."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        given = getattr(spark.sparkContext, "_codelattice_dir", "")
        if not given:
            given = "file://" + tempfile.mkdtemp(prefix="codelattice-")
            spark.sparkContext._codelattice_dir = given
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, for clusters whose workers can't import it from a path."""
    sc = spark.sparkContext
    if getattr(sc, "_codelattice_shipped", False):
        return
    here = Path(__file__).parent
    name = os.path.join(tempfile.mkdtemp(prefix="codelattice-"), "codelattice.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(name)
    sc._codelattice_shipped = True


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder. What is written under it is deleted when the driver ends."""
    root = f"{shared_dir(spark)}/codelattice-{spark.sparkContext.applicationId}"
    if root not in _registered:
        _registered.add(root)
        atexit.register(_delete, spark, root)
    return f"{root}/{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def write_scratch(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder (in a folder for each ``by``) and read it back: its lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete what :func:`write_scratch` wrote, before the driver ends; nothing may read it any more."""
    roots = {f.rpartition("/")[0] for f in df.inputFiles()}
    for path in roots:
        if "/codelattice-" in path:
            _delete(df.sparkSession, path)


def hint_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is (it must be cheap to count, such as a scratch table)."""
    return F.broadcast(df) if df.count() <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
