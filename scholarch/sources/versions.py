"""Several tables that change together: a set of versions with one commit for all of them.

A version's tables are written below paths of their own and become visible by a manifest, written
last.  A load that ends early leaves files without a manifest, which no reader sees; two loads that
start from one version cannot both commit it, because the manifest's folder may not exist yet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, path string, row_count long"


class TableSet:
    """Tables below one shared folder, read at their last committed version."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def create(self, schemas: dict[str, str]) -> TableSet:
        """Version 0: empty tables of the given schemas."""
        self._commit(0, {name: self.spark.createDataFrame([], schema) for name, schema in schemas.items()})
        return self

    def version(self) -> int:
        return self._manifests().agg(F.max("version")).first()[0]

    def read(self, name: str, version: int | None = None) -> DataFrame:
        at = self.version() if version is None else version
        found = self._manifests().where((F.col("version") == at) & (F.col("name") == name)).select("path").collect()
        if not found:
            raise ValueError(f"no table {name} in version {at}")
        return self.spark.read.parquet(found[0].path)

    def commit(self, based_on: int, tables: dict[str, DataFrame]) -> int:
        """Write `tables` as the version after `based_on`; fails if another load has committed that version."""
        self._commit(based_on + 1, tables)
        return based_on + 1

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema(f"{MANIFEST}, version int").parquet(f"{self.folder}/commits")

    def _commit(self, version: int, tables: dict[str, DataFrame]) -> None:
        rows = []
        for name, df in tables.items():
            path = f"{self.folder}/data/{name}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            rows.append((name, path, self.spark.read.parquet(path).count()))
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/commits/version={version}")
