"""A table in versions: folders of rows by bucket, and a manifest that names the folders that count.

A write makes new folders for the buckets that it touches and nothing else; it counts from
the moment its manifest, written beside, is renamed to the next number. A write that fails
before that leaves folders that no manifest names, and every reader goes on with the old
rows. Of two writers that began with the same version one gets the number; the other's
rename is refused, and its rows are as if never written. Paths are Hadoop's, so a table may
lie wherever Spark writes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class Conflict(Exception):
    """Another writer made the next version first."""


class VersionedTable:
    """Rows of one schema by the bucket of their key; `buckets` is fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType | str, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._root = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._fs.Path(path)

    def _names(self, path: str) -> list[str]:
        at = self._at(path)
        return [s.getPath().getName() for s in self._root.listStatus(at)] if self._root.exists(at) else []

    def version(self) -> int:
        """The newest version, 0 where there is none."""
        return max((int(n[1:-5]) for n in self._names(f"{self.path}/manifests") if n.startswith("v") and n.endswith(".json")), default=0)

    def folders(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        version = self.version() if version is None else version
        if not version:
            return {}
        text = self.spark.read.text(f"{self.path}/manifests/v{version}.json", wholetext=True).first()[0]
        return {int(b): f for b, f in json.loads(text)["folders"].items()}

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(list(self.folders(version).values()))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[int, str]:
        """New folders for rows. Spark deals them by bucket, splits buckets that are large and joins small ones."""
        into = f"data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).withColumn(BUCKET, self.bucket()).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{into}")
        return {int(n.partition("=")[2]): f"{into}/{n}" for n in self._names(f"{self.path}/{into}") if n.startswith(f"{BUCKET}=")}

    def _commit(self, base: int, folders: dict[int, str]) -> int:
        """The next version after base, by one rename that fails if there is one already."""
        at, scratch = f"{self.path}/manifests/v{base + 1}.json", self._at(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = self._root.create(scratch, False)
        out.write(bytearray(json.dumps({"folders": folders}).encode()))
        out.close()
        context = self._fs.FileContext.getFileContext(self._at(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(scratch, self._at(at), self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0))
        except Exception as x:
            self._root.delete(scratch, False)
            if "FileAlreadyExists" in str(x):
                raise Conflict(f"version {base + 1} is another writer's") from x
            raise
        return base + 1

    def overwrite(self, rows: DataFrame) -> int:
        """A version of these rows alone; it may read the version before."""
        base = self.version()
        return self._commit(base, self._write(rows))

    def replace(self, keys: DataFrame, rows: DataFrame, base: int | None = None) -> int:
        """A version in which all rows of `keys` (one column, named as the key) are gone and `rows` there instead.

        Only buckets that hold one of keys are read and written anew; rows must be of keys.
        Without any key there is nothing to do and no new version. Keys may be as many as
        rows, so they are merged, never broadcast.
        """
        base = self.version() if base is None else base
        held = self.folders(base)
        touched = [r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()]  # at most as many as there are buckets
        if not touched:
            return base
        old = self._rows([held[b] for b in touched if b in held]).join(keys.select(self.key).distinct().hint("merge"), self.key, "left_anti")
        new = self._write(old.select(*self.schema.names).unionByName(rows.select(*self.schema.names)))
        return self._commit(base, {b: f for b, f in held.items() if b not in touched} | new)

    def clear_unused(self, keep: int = 1) -> None:
        """Remove manifests older than the newest `keep`, and folders that no manifest names: also what failed writes left. Not beside a writer."""
        newest = self.version()
        for v in range(1, newest - keep + 1):
            self._root.delete(self._at(f"{self.path}/manifests/v{v}.json"), False)
        named = {f.split("/")[1] for v in range(max(1, newest - keep + 1), newest + 1) for f in self.folders(v).values()}
        for n in self._names(f"{self.path}/data"):
            if n not in named:
                self._root.delete(self._at(f"{self.path}/data/{n}"), True)
