"""Tables in versions: a batch rewrites the buckets that it touches and becomes visible by one marker.

Below a table's path, ``v=<id>/<part>/bucket=<b>`` holds the rows of one bucket of one part as version <id> wrote
them, and ``_commits/<id>`` says for each bucket which version holds it now. Readers take the last marker. A marker is
renamed into place after all data is written, so a version is there as a whole, with all its parts, or not at all;
what a failed run left is overwritten when its batch comes again, and a batch whose marker stands changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """A table of several parts, each with its key columns, kept in ``buckets`` buckets by hash of the ``by`` column."""

    def __init__(self, spark: SparkSession, path: str, parts: dict[str, str], by: str, buckets: int = 64):
        self.spark, self.path, self.parts, self.by, self.buckets = spark, path.rstrip("/"), parts, by, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._place("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _commits(self) -> list[int]:
        folder = self._place("_commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, version: int | None) -> dict[str, int]:
        if version is None:
            return {}
        stream = self._fs.open(self._place(f"_commits/{version}"))
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.by).cast("string")), F.lit(self.buckets)).cast("int")

    def _read(self, part: str, manifest: dict[str, int], only: list[int] | None = None) -> DataFrame:
        kept = {int(b): v for b, v in manifest.items() if only is None or int(b) in only}
        paths = [p for p in (f"{self.path}/v={v}/{part}/bucket={b}" for b, v in sorted(kept.items())) if self._fs.exists(self._jvm.org.apache.hadoop.fs.Path(p))]
        return self.spark.read.schema(self.parts[part]).parquet(*paths) if paths else self.spark.createDataFrame([], self.parts[part])

    def version(self) -> int | None:
        return max(self._commits(), default=None)

    def read(self, part: str) -> DataFrame:
        """The rows of a part as the last marker has them."""
        return self._read(part, self._manifest(self.version()))

    def apply(self, version: int, batch: DataFrame, change: Callable[[dict[str, DataFrame], DataFrame], dict[str, DataFrame]]) -> bool:
        """Make ``version`` from the one before it: False, and nothing done, if its marker stands already.

        ``change`` gets the rows of all parts in the buckets that ``batch`` touches, and gives their new rows; a row must
        stay in its bucket. Null keys are a bucket's rows like others. An empty batch is a version that equals the last.
        """
        commits = self._commits()
        if version in commits:
            return False
        manifest = self._manifest(max((c for c in commits if c < version), default=None))
        touched = sorted(r[0] for r in batch.select(F.coalesce(self._bucket(), F.lit(0))).distinct().collect())  # one number for each bucket
        if touched:
            made = change({p: self._read(p, manifest, touched) for p in self.parts}, batch)
            for part, rows in made.items():
                own = rows.withColumn("bucket", F.coalesce(self._bucket(), F.lit(0)))
                own.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={version}/{part}")
        manifest |= {str(b): version for b in touched}
        draft = self._place(f"_commits/.{version}.tmp")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not self._fs.rename(draft, self._place(f"_commits/{version}")):
            raise OSError(f"version {version} of {self.path} could not be committed")
        return True

    def clean(self, keep: int = 2) -> list[int]:
        """Drop the markers of all but the last ``keep`` versions, and the data that no marker names any more."""
        commits = self._commits()
        held, dropped = commits[-keep:], commits[:-keep]
        used = {v for c in held for v in self._manifest(c).values()}
        for c in dropped:
            self._fs.delete(self._place(f"_commits/{c}"), False)
        gone = [v for v in dropped if v not in used]
        for v in gone:
            self._fs.delete(self._place(f"v={v}"), True)
        return gone
