"""Tables that are changed by copying what changes: data files are never altered, a version lists those that make up the table.

An update finds the files that hold rows it changes, writes these anew beside the old ones and commits the next version, so a
reader sees all of it or nothing, a lost executor costs a task and a lost driver only leaves files that no version lists.
What passes through the driver are names of files.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ConcurrentChange(RuntimeError):
    """Another writer committed the version that this one was about to."""


class VersionedTable:
    """A table at ``path``, in whatever store Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _place(self, path: str):  # noqa: ANN202
        place = self._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self._conf)

    def _listed(self, path: str) -> list[str]:
        place, store = self._place(path)
        return sorted(s.getPath().toString() for s in store.listStatus(place)) if store.exists(place) else []

    def versions(self) -> list[int]:
        return [int(p.rpartition("/")[2]) for p in self._listed(f"{self.path}/versions") if p.rpartition("/")[2].isdigit()]

    def files(self, version: int | None = None) -> list[str]:
        """The data files of a version, by default the last one."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return []
        return [r.value for r in self.spark.read.text(f"{self.path}/versions/{version:012d}").collect()]

    def read(self, version: int | None = None, files: Sequence[str] | None = None) -> DataFrame:
        names = self.files(version) if files is None else list(files)
        return self.spark.read.schema(self.schema).parquet(*names) if names else self.spark.createDataFrame([], self.schema)

    def _written(self, rows: DataFrame) -> list[str]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.select(*self.schema.fieldNames()).write.parquet(folder)
        return [p for p in self._listed(folder) if p.endswith(".parquet")]

    def commit(self, version: int, files: Sequence[str]) -> int:
        """Version ``version`` with ``files``; raises if there is one already."""
        draft, target = (self._place(f"{self.path}/versions/{name}")[0] for name in (f".{uuid.uuid4().hex}", f"{version:012d}"))
        out = draft.getFileSystem(self._conf).create(draft, False)
        out.write(bytearray("\n".join(files).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(self._conf).getUri(), self._conf)
        try:
            context.rename(draft, target, self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            draft.getFileSystem(self._conf).delete(draft, False)
            raise ConcurrentChange(f"{self.path} has a version {version} by now") from error
        return version

    def append(self, rows: DataFrame) -> int:
        last = max(self.versions(), default=0)
        return self.commit(last + 1, [*self.files(last or None), *self._written(rows)])

    def upsert(self, updates: DataFrame, keys: Sequence[str], only_missing: bool = False, insert: bool = True) -> tuple[int, list[str]]:
        """(the version after it, the files it replaced): rows take the known values of the update with their keys.

        ``only_missing``: only where they have none. ``insert``: updates without a row become one. Null keys are equal; of
        several updates for one key the greatest values count, in order of the columns. Nothing that changes nothing is
        written, so the same update again leaves the version as it is.
        """
        values = [c for c in self.schema.fieldNames() if c not in keys and c in updates.columns]
        new = updates.groupBy(*keys).agg(F.max(F.struct(*values)).alias("_new")).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
        same = F.lit(True)
        for i, k in enumerate(keys):
            same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
        after = {c: F.coalesce(F.col(c), F.col(f"_new.{c}")) if only_missing else F.coalesce(F.col(f"_new.{c}"), F.col(c)) for c in values}
        last = max(self.versions(), default=0)
        files = self.files(last or None)
        changed = F.lit(False)
        for c, value in after.items():
            changed |= ~value.eqNullSafe(F.col(c))
        current = self.read(files=files)
        replaced: list[str] = []
        if files:
            rows = current.select(*keys, *values, F.col("_metadata.file_path").alias("_file"))
            replaced = sorted(r[0] for r in rows.join(new, same).filter(changed).select("_file").distinct().collect())
        fresh = new.join(current.select(*keys), same, "left_anti").select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), *(F.col(f"_new.{c}").alias(c) for c in values))
        rows = self.read(files=replaced).join(new, same, "left").withColumns(after).select(*self.schema.fieldNames()) if replaced else None
        if insert and not fresh.isEmpty():
            fresh = self.spark.createDataFrame([], self.schema).unionByName(fresh, allowMissingColumns=True)
            rows = fresh if rows is None else rows.unionByName(fresh)
        if rows is None:
            return last, []
        gone = {p.rpartition("/")[2] for p in replaced}
        return self.commit(last + 1, [*(p for p in files if p.rpartition("/")[2] not in gone), *self._written(rows)]), replaced

