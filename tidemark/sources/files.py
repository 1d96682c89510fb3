"""Small files and folders on any Hadoop file system, from the driver."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def make(self, path: str) -> None:
        p, fs = self._at(path)
        fs.mkdirs(p)

    def remove(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def folders(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def sizes(self, path: str) -> list[tuple[str, int]]:
        """Names and bytes of the data files in a folder."""
        p, fs = self._at(path)
        return sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(p) if s.isFile() and s.getPath().getName().startswith("part-")) if fs.exists(p) else []

    def read(self, path: str) -> str | None:
        p, fs = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        """Names of the files in a folder."""
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile()) if fs.exists(p) else []

    def changed(self, path: str) -> int:
        """When a file or folder was last changed, in ms."""
        p, fs = self._at(path)
        return fs.getFileStatus(p).getModificationTime()

    def create(self, path: str, text: str) -> bool:
        """Make a file that isn't there, whole or not at all; False where there is one already."""
        draft = f"{path}.{uuid.uuid4().hex}"
        p, fs = self._at(draft)
        stream = fs.create(p)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            self._rename(draft, path)
        except Py4JJavaError as e:
            fs.delete(p, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def _rename(self, source: str, target: str) -> None:
        """Rename; raises where the target is there."""
        a, fs = self._at(source)
        b, _ = self._at(target)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri() if a.toUri().getScheme() else fs.getUri(), self._conf)
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        context.rename(a, b, options)
