"""Cells of additive measures that are kept up to date batch by batch.

A batch of records is rolled up on its own and written as a part, under the batch's number, so that
a batch that is done again replaces itself. Reading adds the parts to the last version of the base.
``fold`` makes the next version of the base out of the last one and the parts, by key; it never goes
back to the records. A version lists the batches that it holds and counts once it is complete, so
a fold that is interrupted changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from equigauge.session import complete_folders, delete_folder


@dataclass(frozen=True)
class CellStore:
    """``root`` holds ``parts/batch=n`` and ``base/version=n``; all measures are sums.

    ``roll_up`` takes records to one row per key with the measures.
    """

    spark: SparkSession
    root: str
    roll_up: Callable[[DataFrame], DataFrame]
    keys: Sequence[str]

    def _versions(self) -> list[int]:
        return complete_folders(self.spark, f"{self.root}/base", "version")

    def _parts(self) -> list[int]:
        return complete_folders(self.spark, f"{self.root}/parts", "batch")

    def folded(self) -> set[int]:
        """Batches that the last version holds."""
        versions = self._versions()
        if not versions:
            return set()
        held = self.spark.read.schema("batch long").parquet(f"{self.root}/held/version={versions[-1]}")
        return {r["batch"] for r in held.collect()}

    def batches(self) -> set[int]:
        """All batches, folded or not."""
        return self.folded() | set(self._parts())

    def add(self, records: DataFrame, batch: int) -> None:
        """Roll up the records of a batch. One that is in the base already is left as it is."""
        if batch not in self.folded():
            self.roll_up(records).write.mode("overwrite").parquet(f"{self.root}/parts/batch={batch}")

    def read(self) -> DataFrame:
        """The cells of all batches. Fails where there are none yet."""
        tables = self._tables(self.folded())
        if len(tables) == 1:
            return tables[0]
        return self._merged(tables)

    def _tables(self, folded: set[int]) -> list[DataFrame]:
        """The base and every part that it does not hold; each has one row per key."""
        versions = self._versions()
        paths = [f"{self.root}/base/version={v}" for v in versions[-1:]]
        paths += [f"{self.root}/parts/batch={b}" for b in self._parts() if b not in folded]
        if not paths:
            raise FileNotFoundError(f"{self.root} has no batch yet")
        return [self.spark.read.parquet(p) for p in paths]

    def _merged(self, tables: list[DataFrame]) -> DataFrame:
        first = tables[0]
        every = first
        for table in tables[1:]:
            every = every.unionByName(table)
        sums = []
        for field in first.schema.fields:
            if field.name not in self.keys:
                total = F.sum(field.name).cast(field.dataType)
                sums.append(total.alias(field.name))
        return every.groupBy(*self.keys).agg(*sums)

    def fold(self) -> int | None:
        """Make the next version of the base; its number, or None where there is nothing new.

        Parts and versions that are no longer needed are deleted once the new one is complete.
        """
        folded, versions = self.folded(), self._versions()
        new = [b for b in self._parts() if b not in folded]
        if not new:
            return None
        version = versions[-1] + 1 if versions else 0
        held = self.spark.createDataFrame([(b,) for b in sorted(folded | set(new))], "batch long")
        held.write.mode("overwrite").parquet(f"{self.root}/held/version={version}")
        self._merged(self._tables(folded)).write.mode("overwrite").parquet(f"{self.root}/base/version={version}")
        for batch in self._parts():
            if batch in folded or batch in new:
                delete_folder(self.spark, f"{self.root}/parts/batch={batch}")
        for old in versions:
            delete_folder(self.spark, f"{self.root}/base/version={old}")
            delete_folder(self.spark, f"{self.root}/held/version={old}")
        return version
