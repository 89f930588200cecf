"""Files and folders on any file system that the session reaches, through Hadoop's interface."""

from __future__ import annotations

import posixpath

from pyspark.sql import SparkSession

join = posixpath.join


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def move(self, path: str, to: str) -> None:
        fs, p = self._at(path)
        if not fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(to)):
            raise OSError(f"{path} could not become {to}")

    def children(self, path: str) -> list[str]:
        """The names in a folder; none if it doesn't exist."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()

    def read(self, path: str) -> str | None:
        """The text of a file; None if it doesn't exist."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Writes a text aside, synced, then takes the place of ``path`` by renaming: a reader sees the old text or the new one."""
        folder, name = posixpath.split(path)
        fs, aside = self._at(join(folder, f".{name}.tmp"))
        stream = fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        how = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename")
        overwrite = self.gateway.new_array(how, 1)
        overwrite[0] = how.OVERWRITE
        target = self.jvm.org.apache.hadoop.fs.Path(path)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(fs.makeQualified(aside), fs.makeQualified(target), overwrite)
