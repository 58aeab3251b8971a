"""Stored matches whose left rows can be replaced in place.

Matches are filed in buckets by a hash of the left id. Replacing the matches of some left rows
writes the buckets that hold them anew, beside the old ones, and then a manifest version that
names the new buckets; all other buckets stay as they are. A replacement that fails on the way
leaves the newest version as it was, and a reader keeps the version that it opened.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.sources.versions import Manifest

BUCKETS = 256
_BUCKET = "left_bucket"


class MatchStore:
    """Matches at ``path``: any columns with ``left_id`` and, where given, ``run`` columns that
    belong to the key of a left row, too."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, run: Sequence[str] = ()):
        self.spark, self.path, self.buckets, self.run = spark, path, buckets, tuple(run)
        self._versions = Manifest(spark, f"{path}/manifest", "bucket int, written long")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.run, "left_id"), F.lit(self.buckets)).cast("int")

    def versions(self) -> int:
        """How many versions there are; they count from 0."""
        rows = self._versions.rows()
        return rows[0]["version"] + 1 if rows else 0

    def _write(self, matches: DataFrame, number: int) -> None:
        filed = matches.withColumn(_BUCKET, self._bucket())
        # Ranges spread a bucket with many rows over tasks.
        spread = filed.repartitionByRange(_BUCKET, *self.run, "left_id")
        spread.write.partitionBy(_BUCKET).mode("overwrite").parquet(f"{self.path}/data/{number}")

    def write(self, matches: DataFrame) -> None:
        """The matches as a new version of the whole table."""
        number = self.versions()
        self._write(matches, number)
        self._versions.commit([(b, number) for b in range(self.buckets)], number)

    def read(self, version: int | None = None) -> DataFrame:
        """The matches of the newest or the given version."""
        manifest = self._versions.rows(version)
        if not manifest:
            raise ValueError(f"no matches are stored at {self.path}")
        return self._of(manifest)

    def _of(self, manifest: Sequence) -> DataFrame:
        by_number: dict[int, list[int]] = {}
        for row in manifest:
            by_number.setdefault(row["written"], []).append(row["bucket"])
        found = None
        for number, buckets in sorted(by_number.items()):
            table = self.spark.read.parquet(f"{self.path}/data/{number}")
            part = table.where(F.col(_BUCKET).isin(buckets)).drop(_BUCKET)
            found = part if found is None else found.unionByName(part)
        return found

    def replace(self, left_ids: DataFrame, fresh: DataFrame) -> int:
        """Replaces the matches of the given left rows (``*run, left_id``) by those in ``fresh``;
        rows of other left ids in ``fresh`` are an error. Returns the new version."""
        key = [*self.run, "left_id"]
        chosen = left_ids.select(*key).distinct()
        if not fresh.join(chosen, key, "left_anti").isEmpty():
            raise ValueError("there are matches of left rows that are not to be replaced")
        manifest = self._versions.rows()
        # At most as many numbers as there are buckets.
        touched = {r[0] for r in chosen.select(self._bucket()).distinct().collect()}
        number = self.versions()
        if touched:
            old = self._of([r for r in manifest if r["bucket"] in touched])
            self._write(old.join(chosen, key, "left_anti").unionByName(fresh), number)
        self._versions.commit([(r["bucket"], number if r["bucket"] in touched else r["written"]) for r in manifest], number)
        return number
