"""A search index that grows with a stream: immutable segments, tombstones, merges.

Every micro-batch becomes a segment of its own: the records, their postings and a narrow table
of ids. A row that comes again, changed or not, and a deletion supersede the older version of
their id; nothing already written changes. The manifest, one small table per version, names the
segments that make up the index; a reader keeps the version it opened while later batches and
merges write new ones.

* A batch that runs again after a failure overwrites its own segment, and one that the manifest
  already holds is passed over; a replayed row is the new version of its id and counts once.
* When FAN segments of one level stand in the manifest, they are merged into one of the next
  level with the newest version of each id, so a row is rewritten once per level. Tombstones go
  when no older segment can hold their id.
* The number of records and their total length are carried from version to version: a batch adds
  its own rows and takes off those that they supersede.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tandem.functions.cells import quoted
from tandem.operators.keyword import KeywordIndex, build_postings
from tandem.sources.versions import Manifest

FAN = 4
_MANIFEST = "segment string, level int, first long, last long, n_docs long, total_length long"
_IDS = "id long, batch long, deleted boolean, length long"
_POSTINGS = "id long, batch long, term string, tf long"


class SegmentStore:
    """The index at ``path``. Batches hold ``id, contextual_content``, the ``columns`` to keep and,
    where rows can go, the boolean column ``deleted``."""

    def __init__(
        self, spark: SparkSession, path: str, columns: str = "", analyzer: str = "english", id_text: str | None = None,
        order: str | None = None, fan: int = FAN,
    ):
        """``columns`` is a schema text; ``id_text`` names the column whose plain tokens are
        searchable too; ``order`` the one that tells the newest of several rows of an id in one
        batch (without it the greatest row)."""
        self.spark, self.path, self.analyzer, self.id_text, self.order, self.fan = spark, path, analyzer, id_text, order, fan
        self._versions = Manifest(spark, f"{path}/manifest", _MANIFEST)
        self.record_schema = ", ".join(["id long, contextual_content string", *[columns] * bool(columns), "batch long, deleted boolean"])

    def manifest(self, version: int | None = None) -> list[Row]:
        """The segments of the newest (or the given) version, oldest first: a few per level."""
        return sorted(self._versions.rows(version), key=lambda s: s["first"])

    def _read(self, table: str, schema: str, segments: Sequence[Row]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/segments/{s['segment']}/{table}" for s in segments])

    def _write(self, segment: str, records: DataFrame, postings: DataFrame | None = None) -> None:
        """Records, then what is made of them as written, so nothing is computed twice."""
        folder = f"{self.path}/segments/{segment}"
        records.write.mode("overwrite").parquet(f"{folder}/records")
        written = self.spark.read.schema(self.record_schema).parquet(f"{folder}/records")
        if postings is None:
            kept = written.where("not deleted")
            made = build_postings(kept, id_text=quoted(self.id_text) if self.id_text else None, analyzer=self.analyzer)
            # A segment holds one version of an id.
            postings = made.join(written.select("id", "batch"), "id")
        postings.select("id", "batch", "term", "tf").write.mode("overwrite").parquet(f"{folder}/postings")
        lengths = self.spark.read.schema(_POSTINGS).parquet(f"{folder}/postings").groupBy("id").agg(F.sum("tf").alias("length"))
        ids = written.select("id", "batch", "deleted").join(lengths, "id", "left")
        ids.withColumn("length", F.coalesce("length", F.lit(0).cast("long"))).write.mode("overwrite").parquet(f"{folder}/ids")

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Adds a micro-batch as a segment, then merges where there are enough."""
        segments = self.manifest()
        if segments and batch_id <= max(s["last"] for s in segments):
            return
        rows = batch if "deleted" in batch.columns else batch.withColumn("deleted", F.lit(False))
        rows = rows.withColumns({"batch": F.lit(batch_id).cast("long"), "deleted": F.coalesce("deleted", F.lit(False))})
        names = [f.split()[0] for f in self.record_schema.split(", ")]
        newest = F.struct(*[quoted(c) for c in ([self.order] if self.order else []) + names if c != "id"])
        latest = rows.groupBy("id").agg(F.max(newest).alias("r")).select("id", *[F.col(f"r.`{c}`") for c in names if c != "id"])
        name = f"b{batch_id}"
        self._write(name, latest.select(*[quoted(c) for c in names]))
        ids = self.spark.read.schema(_IDS).parquet(f"{self.path}/segments/{name}/ids")
        before = self.live(segments).join(ids.select("id"), "id", "left_semi")

        def totals(df: DataFrame) -> Row:
            return df.where("not deleted").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).head()

        gone, come = totals(before), totals(ids)
        n_docs, length = (segments[0]["n_docs"], segments[0]["total_length"]) if segments else (0, 0)
        facts = n_docs + come["n"] - gone["n"], length + come["length"] - gone["length"]
        kept = [(s["segment"], s["level"], s["first"], s["last"], *facts) for s in segments]
        version = segments[0]["version"] + 1 if segments else 0
        self._versions.commit([*kept, (name, 0, batch_id, batch_id, *facts)], version)
        self._merge()

    def _merge(self) -> None:
        """Merges the oldest FAN segments of a level while any level has as many."""
        while True:
            segments = self.manifest()
            by_level: dict[int, list[Row]] = {}
            for s in segments:
                by_level.setdefault(s["level"], []).append(s)
            full = next((of[: self.fan] for _, of in sorted(by_level.items()) if len(of) >= self.fan), None)
            if full is None:
                return
            oldest = full[0]["first"] == segments[0]["first"]
            current = self.live(full)
            if oldest:
                current = current.where("not deleted")
            newest = current.select("id", "batch")
            name = f"m{full[0]['first']}-{full[-1]['last']}"
            self._write(
                name,
                self._read("records", self.record_schema, full).join(newest, ["id", "batch"], "left_semi"),
                self._read("postings", _POSTINGS, full).join(newest, ["id", "batch"], "left_semi"),
            )
            merged = (name, full[0]["level"] + 1, full[0]["first"], full[-1]["last"], full[0]["n_docs"], full[0]["total_length"])
            names = {s["segment"] for s in full}
            rest = [tuple(s)[:6] for s in segments if s["segment"] not in names]
            self._versions.commit(sorted([*rest, merged], key=lambda s: s[2]), segments[0]["version"] + 1)

    def live(self, segments: Sequence[Row]) -> DataFrame:
        """``id, batch, deleted, length`` of the newest version of each id, tombstones included."""
        ids = self._read("ids", _IDS, segments)
        return ids.groupBy("id").agg(F.max(F.struct("batch", "deleted", "length")).alias("r")).select("id", "r.*")

    def records(self, version: int | None = None) -> DataFrame:
        """The records of the index, one per id."""
        segments = self.manifest(version)
        current = self.live(segments).where("not deleted").select("id", "batch")
        return self._read("records", self.record_schema, segments).join(current, ["id", "batch"], "left_semi").drop("batch", "deleted")

    def index(self, version: int | None = None) -> KeywordIndex:
        """The keyword index of the same records."""
        segments = self.manifest(version)
        current = self.live(segments).where("not deleted")
        postings = self._read("postings", _POSTINGS, segments).join(current.select("id", "batch"), ["id", "batch"], "left_semi")
        return KeywordIndex(postings.select("id", "term", "tf"), current.where("length > 0").select("id", "length"), self.analyzer)

    def statistics(self, version: int | None = None) -> tuple[int, int]:
        """Number of records and of their tokens, as carried along."""
        segments = self.manifest(version)
        return (segments[0]["n_docs"], segments[0]["total_length"]) if segments else (0, 0)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(lambda batch, batch_id: self.append(batch, batch_id))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
