"""Helpers that the text operators share: the shared folder, written tables, bounded samples, task identity."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a context, so that their Python workers can import it."""
    context = spark.sparkContext
    if not getattr(context, "_larkspur_shipped", False):
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent))
        context.addPyFile(str(target))
        context._larkspur_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir, or, where that is unset, one of our own:
    a temporary folder in local mode, else one beside the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        base = f"file://{tempfile.gettempdir()}/larkspur-shared" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/.larkspur-shared"
    if "://" not in base and base.startswith("/"):
        scheme = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        base = f"file://{base}" if scheme.startswith("file:") else scheme.rstrip("/") + base
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written_at(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """The rows of df, written to the shared folder and read again (cuts lineage, survives lost executors), and the path."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    return written_at(df, name, **options)[0]


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run within are removed as each ends, for results that are written and not computed again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What a Python process keeps between tasks: one object, made when it is not there. Another key takes its place, so
    that what the stages of a pipeline keep does not add up in workers that serve all of them."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drops what is held, for tasks that need it no more."""
    _held.clear()


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes not to be a column of df."""
    while name in df.columns:
        name = f"_{name}"
    return name


def hashed_share(df: DataFrame, key: str, bound: int, total: int) -> DataFrame:
    """About `bound` rows (all, if there are no more), chosen by a hash of the key; reruns choose the same ones."""
    if total <= bound:
        return df
    steps = 1 << 40
    return df.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(steps)) < F.lit(int(steps * bound / total)))


def fold(key: str, n: int):
    """crc32 of the key as text, modulo n; null keys count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n))
