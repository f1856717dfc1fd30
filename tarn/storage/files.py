"""The few file operations that a store needs, on a local file system or on any that Hadoop knows."""

from __future__ import annotations

import os
import shutil
import time
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class LocalFiles:
    """Paths of this machine, which for a cluster must be a mount that all processes share."""

    def __init__(self, root: str) -> None:
        self.root = os.path.abspath(root)

    def at(self, name: str) -> str:
        return os.path.join(self.root, name)

    def make(self, name: str) -> None:
        os.makedirs(self.at(name), exist_ok=True)

    def names(self, folder: str, older: float = 0) -> list[str]:
        """What the folder holds, of at least that age in seconds."""
        then = time.time() - older
        return [e.name for e in os.scandir(self.at(folder)) if not older or e.stat().st_mtime <= then]

    def read(self, name: str) -> str:
        with open(self.at(name)) as f:
            return f.read()

    def create_new(self, name: str, text: str) -> bool:
        """The file, whole, or not at all; False if there is one already."""
        draft = self.at(f"{os.path.dirname(name)}/{uuid.uuid4().hex}.draft")
        with open(draft, "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, self.at(name))
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(draft)

    def delete(self, name: str) -> None:
        path = self.at(name)
        if os.path.isdir(path):
            shutil.rmtree(path, ignore_errors=True)
        elif os.path.exists(path):
            os.remove(path)

    def size(self, name: str) -> int:
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(self.at(name)) for f in files)


class HadoopFiles:
    """Any other file system. A new file is written aside and renamed without overwriting, which HDFS does in one step, as
    its own logs rely on; a store whose rename is a copy needs a committer of its own."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root, self.jvm = root.rstrip("/"), spark._jvm
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), conf)

    def path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def make(self, name: str) -> None:
        self.fs.mkdirs(self.path(name))

    def names(self, folder: str, older: float = 0) -> list[str]:
        then = (time.time() - older) * 1000
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(folder)) if not older or s.getModificationTime() <= then]

    def read(self, name: str) -> str:
        if not self.fs.exists(self.path(name)):
            raise FileNotFoundError(name)
        stream = self.fs.open(self.path(name))
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create_new(self, name: str, text: str) -> bool:
        draft = f"{os.path.dirname(name)}/{uuid.uuid4().hex}.draft"
        stream = self.fs.create(self.path(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
            options = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
            options[0] = none
            self.context.rename(self.path(draft), self.path(name), options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
                raise
            return False
        finally:
            self.delete(draft)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def size(self, name: str) -> int:
        return int(self.fs.getContentSummary(self.path(name)).getLength())


def files_for(spark: SparkSession, root: str) -> LocalFiles | HadoopFiles:
    scheme, _, rest = root.partition("://")
    if not rest or scheme == "file":
        return LocalFiles((rest or root).removeprefix("file:"))
    return HadoopFiles(spark, root)
