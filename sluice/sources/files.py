"""Small files on any file system that Spark reads, through Hadoop's API on the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _at(self, name: str):
        p = self._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self._conf), p

    def exists(self, name: str) -> bool:
        fs, p = self._at(name)
        return fs.exists(p)

    def read(self, name: str) -> str:
        fs, p = self._at(name)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, overwrite: bool = True) -> bool:
        """Writes a whole file: under another name first, then renamed. False if it exists and may not be replaced."""
        fs, p = self._at(name)
        _, draft = self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        fs.mkdirs(p.getParent())
        out = fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not overwrite:
            if fs.exists(p) or not fs.rename(draft, p):
                fs.delete(draft, False)
                return False
            return True
        if fs.exists(p):
            fs.delete(p, False)
        return fs.rename(draft, p)

    def list(self, name: str = "") -> list[str]:
        fs, p = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, name: str) -> bool:
        fs, p = self._at(name)
        return fs.delete(p, True)
