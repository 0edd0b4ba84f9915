"""Folders on whatever file system Spark reads: local, HDFS, object stores."""

from __future__ import annotations

import tempfile
import uuid

from py4j.java_gateway import is_instance_of
from pyspark.sql import SparkSession


class Files:
    """Few small files and names, from the driver, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm, self.conf = spark, spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _system(self, path: str):
        found = self._path(path).getFileSystem(self.conf)
        # A local file has no checksum beside it, so that other programs may write it too.
        local = is_instance_of(self.spark.sparkContext._gateway, found, "org.apache.hadoop.fs.LocalFileSystem")
        return found.getRaw() if local else found

    def exists(self, path: str) -> bool:
        return self._system(path).exists(self._path(path))

    def names(self, folder: str) -> list[str]:
        """What is in a folder, by name; none if there is no such folder."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._system(folder).listStatus(self._path(folder)))

    def make(self, folder: str) -> None:
        self._system(folder).mkdirs(self._path(folder))

    def delete(self, path: str) -> None:
        self._system(path).delete(self._path(path), True)

    def delete_at_exit(self, path: str) -> None:
        """When the driver ends; the path has to be there."""
        self._path(path).getFileSystem(self.conf).deleteOnExit(self._path(path))

    def read(self, path: str) -> str:
        stream = self._system(path).open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> None:
        stream = self._system(path).create(self._path(path), True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Replaces a file: by a rename over it where the file system has that, else by a write that shows when it is closed."""
        uri = self._system(path).makeQualified(self._path(path)).toUri()
        try:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.conf)
        except Exception as error:
            if "UnsupportedFileSystemException" not in str(error):
                raise
            self._create(path, text)
            return
        fresh = f"{path}.{uuid.uuid4().hex}.tmp"
        self._create(fresh, text)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self._path(fresh), self._path(path), options)


def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, deleted when the driver ends.

    It lies below the folder that spark.checkpoint.dir names; only where that is
    unset and the master is local below this machine's temporary one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        shared = tempfile.gettempdir()
    folder = f"{shared.rstrip('/')}/plinth-{uuid.uuid4().hex}"
    files = Files(spark)
    files.make(folder)
    files.delete_at_exit(folder)
    return folder
