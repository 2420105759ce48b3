"""Sessions, and the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: State of transformWithState lives in RocksDB.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's defaults; ``conf`` (dots as double underscores) comes on top."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


@contextmanager
def session(master: str | None = None, **conf: str) -> Iterator[SparkSession]:
    """A session that is closed at the end, also after an error."""
    spark = build_session(master, **conf)
    try:
        yield spark
    finally:
        spark.stop()


@contextmanager
def with_conf(spark: SparkSession, **conf: str) -> Iterator[SparkSession]:
    """Settings that hold inside the block only."""
    own = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield spark
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset (tests, a single
    machine) a temporary folder of this machine is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Files:
    """Spark's own file system layer, for the driver: any store that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def list(self, name: str) -> list[str]:
        """Names of the files in a folder, sorted; hidden ones and markers left out."""
        if not self.exists(name):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(name))]
        return sorted(n for n in names if not n.startswith(("_", ".")))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a new file; FileExistsError if there is one."""
        try:
            stream = self.fs.create(self._path(name), False)
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                raise FileExistsError(name) from e
            raise
        try:
            stream.write(text.encode("utf-8"))
        finally:
            stream.close()

    def mkdirs(self, name: str) -> None:
        self.fs.mkdirs(self._path(name))

    def write_parts(self, df: DataFrame, folder: str, parts: int) -> None:
        """Write exactly ``parts`` parquet files to a new folder; where there are fewer, files without rows make up the number."""
        df.coalesce(parts).write.option("maxRecordsPerFile", 0).parquet(f"{self.root}/{folder}")
        missing = parts - len(self.list(folder))
        if missing > 0:
            empty = f"_empty/{hashlib.sha1(df.schema.json().encode()).hexdigest()}"  # one for each schema, kept
            if not self.list(empty):
                df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{self.root}/{empty}")
            name = self.list(empty)[0]
            conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            for i in range(missing):
                self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._path(f"{empty}/{name}"), self.fs, self._path(f"{folder}/part-none-{i:05d}.parquet"), False, conf)

    def rename(self, old: str, new: str) -> bool:
        self.fs.mkdirs(self._path(new).getParent())
        return self.fs.rename(self._path(old), self._path(new))

    def delete(self, name: str = "") -> None:
        """Delete a file or folder; a missing one is ignored."""
        self.fs.delete(self._path(name), True)
