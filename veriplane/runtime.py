"""Session helpers: durable intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_SHIPPED: set[str] = set()
_MADE: dict[str, SparkSession] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; they need not have it installed.

    The driver serves the archive to its executors, so it may lie on the driver's own disk.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        package = Path(__file__).resolve().parent
        place = tempfile.mkdtemp(prefix="veriplane-package-")
        atexit.register(shutil.rmtree, place, True)
        with zipfile.ZipFile(f"{place}/veriplane.zip", "w") as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        sc.addPyFile(f"{place}/veriplane.zip")


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir`` of the session.

    Only where that setting is missing and all executors run on this machine (tests, a laptop) a folder of
    our own is made, and removed again at exit; on a cluster a missing setting is an error, as tables
    written to a machine's own disk could not be read back whole.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can reach")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="veriplane-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing uses yet; ``drop_all`` deletes what is written there."""
    path = f"{shared_root(spark)}/veriplane/{tag}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(drop_all)
    _MADE[path] = spark
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    plan size stays constant over the rounds of an iterative operator.
    """
    spark = df.sparkSession
    ship(spark)
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def stored_count(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """As ``stored``, with the number of rows, which is counted as they are written."""
    seen = Observation()
    back = stored(df.observe(seen, F.count(F.lit(1)).alias("n")), tag)
    return back, seen.get["n"]


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by ``stored``; for tables no later result reads."""
    for df in tables:
        _drop(df.sparkSession, df.stored_path)


def _drop(spark: SparkSession, path: str) -> None:
    system, target = file_system(spark, path)
    system.delete(target, True)
    _MADE.pop(path, None)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it wants it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = file_system(spark, path)
    return system.exists(target)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small new file; one that is already there is an error."""
    system, target = file_system(spark, path)
    out = system.create(target, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_texts(spark: SparkSession, folder: str, ending: str) -> list[str]:
    """The texts of the small files of a folder with that ending, in the order of their names."""
    system, target = file_system(spark, folder)
    if not system.exists(target):
        return []
    found = sorted((s.getPath() for s in system.listStatus(target) if s.getPath().getName().endswith(ending)), key=lambda p: p.getName())
    io, out = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils, []
    for file in found:
        stream = system.open(file)
        try:
            out.append(bytes(io.readFullyToByteArray(stream)).decode())
        except Py4JJavaError as e:
            if "ChecksumException" in str(e.java_exception):
                raise ValueError(f"{file.getName()} does not match its checksum") from None
            raise
        finally:
            stream.close()
    return out


def drop_all() -> None:
    """Delete every table made in the shared folder so far; call it when all results have been written. Also runs at exit."""
    for path, spark in list(_MADE.items()):
        try:
            _drop(spark, path)
        except Exception:  # the session may be gone
            _MADE.pop(path, None)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
