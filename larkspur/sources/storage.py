"""Files of the catalog, through Hadoop's file systems: any store that Spark reaches will do."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset, one of our own.

    Our own is a temporary folder of this machine, so it is only for sessions whose executors run in the driver, as in tests.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = getattr(shared_folder, "own", None)
        if own is None:
            own = shared_folder.own = tempfile.mkdtemp(prefix="larkspur-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = "file://" + own
    return folder.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


class Storage:
    """The few file operations that the catalog needs."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def read(self, path: str) -> str | None:
        fs, p = self._fs(path), self._path(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Write beside it, flush to disk, then swap in by one atomic rename."""
        spare = f"{path}.{uuid.uuid4().hex}"
        fs, p = self._fs(spare), self._path(spare)
        fs.mkdirs(p.getParent())
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options
        how = self._gateway.new_array(getattr(options, "Rename"), 1)
        how[0] = getattr(options, "Rename").OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._conf)
        context.rename(p, self._path(path), how)

    def remove(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    def data_files(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs(folder).listStatus(self._path(folder)) if s.getPath().getName().startswith("part-") and s.getLen())

    def folders(self, folder: str) -> list[str]:
        fs = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(self._path(folder)) if s.isDirectory()) if fs.exists(self._path(folder)) else []

    def size(self, path: str) -> int:
        return self._fs(path).getFileStatus(self._path(path)).getLen()

    def total(self, folder: str) -> int:
        """Bytes of all files in a folder."""
        return self._fs(folder).getContentSummary(self._path(folder)).getLength()
