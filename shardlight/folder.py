"""Small control files below a shared folder: pointers, manifests, locks."""

from __future__ import annotations

import os
import shutil
import time
import uuid

from pyspark.sql import SparkSession


class Folder:
    """Files below ``root`` on any file system Spark can reach. Local paths are handled by the driver itself, others by the
    Hadoop client. :meth:`create` never replaces a file, which is what numbered pointers and locks rest on (atomic on local and
    HDFS-like systems; an object store needs a committer with conditional writes)."""

    def __init__(self, spark: SparkSession, root: str, through_hadoop: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        path = self._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._local = self._fs.makeQualified(path).toUri().getPath() if self._fs.getScheme() == "file" and not through_hadoop else None

    def _at(self, name: str):
        return os.path.join(self._local, name) if self._local else self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return os.path.exists(self._at(name)) if self._local else self._fs.exists(self._at(name))

    def mkdirs(self, name: str = "") -> None:
        if self._local:
            os.makedirs(self._at(name), exist_ok=True)
        else:
            self._fs.mkdirs(self._at(name))

    def delete(self, name: str = "") -> None:
        """A file, or a folder with all below it; nothing if it isn't there."""
        if not self._local:
            self._fs.delete(self._at(name), True)
        elif os.path.isdir(self._at(name)):
            shutil.rmtree(self._at(name))
        elif os.path.exists(self._at(name)):
            os.unlink(self._at(name))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(os.listdir(self._at(name)) if self._local else [s.getPath().getName() for s in self._fs.listStatus(self._at(name))])

    def read(self, name: str) -> str:
        if self._local:
            with open(self._at(name), encoding="utf-8") as f:
                return f.read()
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        if self._local:
            with open(self._at(name), "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            return
        out = self._fs.create(self._at(name), False)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def create(self, name: str, text: str) -> bool:
        """Makes a complete file of that name, or says that there is one."""
        if self.exists(name):
            return False
        self.mkdirs()
        whole = f"_{name}.{uuid.uuid4().hex}"
        self._write(whole, text)
        if not self._local:
            done = self._fs.rename(self._at(whole), self._at(name))
            if not done:
                self.delete(whole)
            return done
        try:
            os.link(self._at(whole), self._at(name))
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(self._at(whole))

    def touch(self, name: str) -> None:
        if self._local:
            os.utime(self._at(name))
        else:
            self._fs.setTimes(self._at(name), int(time.time() * 1000), -1)

    def age(self, name: str) -> float:
        """Seconds since the file was made or touched."""
        changed = os.stat(self._at(name)).st_mtime if self._local else self._fs.getFileStatus(self._at(name)).getModificationTime() / 1000
        return time.time() - changed

    # -- numbered versions ------------------------------------------------------------------------------------------------
    def latest(self, prefix: str) -> tuple[int, str | None]:
        """Number and text of the newest version ``prefix-<number>``; (0, None) if there is none."""
        numbers = [int(n[len(prefix) + 1 :]) for n in self.names() if n.startswith(prefix + "-") and n[len(prefix) + 1 :].isdigit()]
        if not numbers:
            return 0, None
        return max(numbers), self.read(f"{prefix}-{max(numbers):012d}")

    def publish(self, prefix: str, number: int, text: str, keep: int = 3) -> bool:
        """Version ``number``, unless another writer made it first. The ``keep`` versions before it stay for readers."""
        if not self.create(f"{prefix}-{number:012d}", text):
            return False
        old = f"{prefix}-{number - keep - 1:012d}"
        if number > keep + 1 and self.exists(old):
            self.delete(old)
        return True
