"""Session helpers that every operator of this subpackage shares.

Intermediate results that must survive the loss of an executor are written as
Parquet under the folder that the cluster names in ``spark.checkpoint.dir``.
Only a plain local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as the contracts define them (fixed values).
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"

_own_dir: list[str] = []
_watched: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="feloom-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return "file://" + _own_dir[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/feloom/{label}-{uuid.uuid4().hex}"


#: Shuffle files go at the end of the execution that made them, not when the driver's garbage collector finds them unused.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Executions inside delete their shuffle files when they end; each plans shuffles of its own, so no other reads them."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table of its own in the shared folder: the lineage ends here and its size is known to the planner.

    Its shuffle files go with the write; what is left of such tables goes when the driver ends.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with _without_leftovers(spark):
        df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    for names in _watched:
        names.append(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._fl_folder = path
    return made


@contextlib.contextmanager
def scratch(spark: SparkSession, keep: list[DataFrame]) -> Iterator[None]:
    """Delete the tables that :func:`cut` makes inside, but for those of the frames that are in ``keep`` at the end."""
    names: list[str] = []
    _watched.append(names)
    try:
        yield
    finally:
        _watched.remove(names)
    kept = {getattr(df, "_fl_folder", None) for df in keep}
    for name in names:
        if name not in kept:
            _delete(spark, name)


def drop(df: DataFrame) -> None:
    """Delete the table behind a frame that :func:`cut` made and that nothing reads any more."""
    _delete(df.sparkSession, df._fl_folder)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = df.sparkSession.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])
    return df.mapInArrow(function, schema)


def bounded_sample(rows: DataFrame, n: int, keys: list[str], most: int) -> DataFrame:
    """At most ``most`` of ``n`` rows, those with the smallest hashes of ``keys``.

    A threshold on the hash, half as high again as needed, is applied first: what
    all tasks together send to the driver is then bounded too, not only what each sends.
    """
    scale = 1 << 40
    share = min(1.0, (1.5 * most + 100) / max(1, n))
    place = F.pmod(F.xxhash64(*keys), F.lit(scale))
    return rows.where(place <= int(share * scale)).orderBy(place, *keys).limit(most)
