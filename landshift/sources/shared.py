"""Tables in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset on one machine, a new one. On a cluster, whose
    executors would not see such a folder, that is an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="landshift-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/landshift/{name}-{uuid.uuid4().hex}"


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends here and a lost executor costs nothing.
    ``tidy``: its shuffle files go as soon as it is written, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, str(tidy or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def resumed(make: Callable[[], DataFrame], path: str, spark: SparkSession) -> DataFrame:
    """The table at ``path``; made and written first unless an earlier run has finished it. So a run that was cut off
    goes on after its last finished stage."""
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fingerprint(df: DataFrame) -> str:
    """What a table is made of, as a hash: its schema, its plan, and name, size and time of every file it reads."""
    digest = hashlib.sha256(f"{df.schema.simpleString()}\n{df._jdf.queryExecution().analyzed().canonicalized().toString()}\n".encode())
    for file in sorted(df.inputFiles()):
        system, where = _system(df.sparkSession, file)
        status = system.getFileStatus(where)
        digest.update(f"{file} {status.getLen()} {status.getModificationTime()}\n".encode())
    return digest.hexdigest()


class Stages:
    """The tables of a run in a folder of their own, under a key of its inputs and parameters.

    A run that was cut off finds what it had finished when it starts again with the same inputs and parameters, and goes
    on from there; with others it makes everything anew. Inputs are told apart by their files; rows that were handed over
    without files, by ``version``."""

    def __init__(self, spark: SparkSession, folder: str, inputs: dict[str, DataFrame | None], parameters: object, version: str = ""):
        said = json.dumps({"inputs": {k: fingerprint(v) for k, v in sorted(inputs.items()) if v is not None}, "parameters": repr(parameters), "version": version}, sort_keys=True)
        self.spark, self.said = spark, said
        self.folder = f"{folder.rstrip('/')}/{hashlib.sha256(said.encode()).hexdigest()[:20]}"

    def table(self, make: Callable[[], DataFrame] | DataFrame, name: str) -> DataFrame:
        """The finished table of that name, or ``make`` written as such; a function is called only if there is none."""
        return resumed(make if callable(make) else lambda: make, f"{self.folder}/{name}", self.spark)


def published(df: DataFrame, path: str, keep: int = 2) -> DataFrame:
    """``df`` as the next state of the catalog table at ``path``, which may be what ``df`` reads: a version of its own is
    written beside those before, the oldest go. ``current`` reads the newest that is whole."""
    spark = df.sparkSession
    held = _versions(spark, path)
    to = f"{path}/version={(held[-1] + 1) if held else 1:08d}"
    df.write.mode("overwrite").parquet(to)
    for old in held[: max(0, len(held) + 1 - keep)]:
        _delete(spark, f"{path}/version={old:08d}")
    return spark.read.schema(df.schema).parquet(to)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest finished state of a catalog table, or None before the first."""
    held = _versions(spark, path)
    return spark.read.parquet(f"{path}/version={held[-1]:08d}") if held else None


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    system, where = _system(spark, path)
    return system.exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    system, where = _system(spark, path)
    system.delete(where, True)


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in order; none if there are none."""
    system, where = _system(spark, pattern)
    return sorted(s.getPath().toString() for s in system.globStatus(where) or [])


def _versions(spark: SparkSession, path: str) -> list[int]:
    return [int(p.rsplit("/", 2)[1].removeprefix("version=")) for p in folders(spark, f"{path}/version=*/_SUCCESS")]


def removed(df: DataFrame) -> None:
    """Delete the files behind a table of ``written`` that no later plan reads."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)
