"""Where files and results are kept: landing of uploads, atomic publishing, partition replacement.

All paths are those of Hadoop's file systems, so a folder may be in any store that Spark itself reads and writes."""

from __future__ import annotations

import posixpath
import secrets

from pyspark.sql import DataFrame, SparkSession


class Files:
    """Single files of one store, from the driver."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.at = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.at.getFileSystem(self.conf)
        if self.fs.getUri().getScheme() == "file":  # without files of checksums beside each file
            self.fs = self.jvm.org.apache.hadoop.fs.RawLocalFileSystem()
            self.fs.initialize(self.jvm.java.net.URI("file:///"), self.conf)
        self.at = self.fs.makeQualified(self.at)
        self.root = self.at.toString()

    def path(self, name: str):
        """The file of this name inside the root; names that lead outside are refused."""
        if not name or posixpath.normpath(name) != name or name.startswith(("/", "..")) or ":" in name:
            raise ValueError(f"outside the store: {name!r}")
        return self.jvm.org.apache.hadoop.fs.Path(self.at, name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str = "") -> list[str]:
        at = self.path(folder) if folder else self.at
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, content: bytes) -> bool:
        """Makes a file that isn't there yet; whether it was this call that made it."""
        path = self.path(name)
        try:
            stream = self.fs.create(path, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()
        return True

    def published(self, name: str, content: bytes) -> None:
        """The whole file or none (K5): written beside its place and then renamed over it."""
        path, beside = self.path(name), self.path(posixpath.join(posixpath.dirname(name), f".{posixpath.basename(name)}-{secrets.token_hex(8)}"))
        try:
            stream = self.fs.create(beside, False)
            try:
                stream.write(bytearray(content))
            finally:
                stream.close()
            how = self.jvm.org.apache.hadoop.fs.Options.Rename
            over = self.jvm.java.lang.reflect.Array.newInstance(how.OVERWRITE.getClass(), 1)
            over[0] = how.OVERWRITE
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(beside, path, over)
        except BaseException:
            self.fs.delete(beside, False)
            raise

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), False)


class FileStore:
    """A landing folder for single uploads (K1)."""

    def __init__(self, spark: SparkSession, root: str, most: int = 20 << 20) -> None:
        self.files, self.most = Files(spark, root), most

    def save(self, content: bytes, name: str) -> str:
        """The name under which the upload is kept: random, with the suffix of Word documents if it has that. Only the owner may read it."""
        if not content or len(content) > self.most or not content.startswith(b"PK\x03\x04"):
            raise ValueError("empty, too large or no zip archive")
        kept = secrets.token_hex(16) + (".docx" if name.lower().endswith(".docx") else ".bin")
        if not self.files.create(kept, content):
            raise FileExistsError(kept)
        self.files.fs.setPermission(self.files.path(kept), self.files.jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
        return kept

    def delete(self, name: str) -> None:
        self.files.delete(name)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Writes df and replaces only the partitions that it has; doing it again gives the same table (K2)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
