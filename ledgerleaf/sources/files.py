"""Small files of a store on whatever file system its folder is on."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, path: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}" if path else self.folder)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self, path: str = "") -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return bool(fs.exists(p))

    def claimed(self, path: str, text: str = "") -> bool:
        """Writes a file that isn't there yet; False where another writer was first."""
        fs, p = self._at(path)
        try:
            out = fs.create(p, False)
        except Exception as e:  # noqa: BLE001
            if "already exists" not in str(e):
                raise
            return False
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def text(self, path: str) -> str:
        rows = self.spark.read.text(f"{self.folder}/{path}", wholetext=True).collect()
        return rows[0].value if rows else ""

    def delete(self, path: str = "") -> bool:
        fs, p = self._at(path)
        return bool(fs.delete(p, True))
