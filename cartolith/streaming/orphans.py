"""Orphan references kept up to date from a stream of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.orphans import OrphanState, named

#: What a stream of versions carries: rows of target_versions (what = 'target') and of reference_versions ('ref').
SCHEMA = ("what string, kind tinyint, id bigint, visible boolean, arrived bigint, tab tinyint, owner_id bigint, ring_no bigint, pos bigint, "
          "ref bigint, edited bigint, loaded bigint")


def events(targets: DataFrame, refs: DataFrame) -> DataFrame:
    """Versions of both kinds in one frame, as a stream carries them."""
    t = targets.withColumn("what", F.lit("target"))
    r = refs.withColumn("what", F.lit("ref"))
    both = t.unionByName(r, allowMissingColumns=True)
    return both.select([c.split()[0] for c in SCHEMA.split(", ")])


class OrphanMonitor:
    """Folds micro-batches into an OrphanState stored under root, a folder of deltas for each batch.

    A batch is derived from the last finished one before it, and marked when all
    its tables are written, with the list of tables its state consists of: a
    batch that is run again after a failure gives the same. Snapshots of the
    counts are kept for every batch, tables as long as one of the last two
    states consists of them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _finished(self) -> list[int]:
        at = self._hadoop(f"{self.root}/done")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _tables(self, batch: int) -> dict[str, list[str]]:
        """Paths below root of the tables that make up the state after a batch."""
        rows = self.spark.read.parquet(f"{self.root}/done/{batch}").orderBy("no").collect()
        return {k: [r["path"] for r in rows if r["part"] == k] for k in ("targets", "refs", "found")}

    def state(self, batch: int | None = None) -> OrphanState | None:
        """State after a batch, or after the last finished one; None before the first."""
        done = self._finished()
        if not done:
            return None
        parts = self._tables(done[-1] if batch is None else batch)
        return OrphanState(*([self.spark.read.parquet(f"{self.root}/{p}") for p in parts[k]] for k in ("targets", "refs", "found")))

    def on_batch(self, batch: DataFrame, number: int) -> None:
        at, written = f"state/{number}", {}

        def save(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{self.root}/{at}/{name}")
            written.setdefault(name, f"{at}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{self.root}/{at}/{name}")

        before = [n for n in self._finished() if n < number]
        batch = save(batch, "events")
        t = batch.where("what = 'target'").select("kind", "id", "edited", "visible", "arrived")
        r = batch.where("what = 'ref'").select("tab", "owner_id", "ring_no", "pos", "kind", "ref", "edited", "loaded")
        old = self._tables(before[-1]) if before else {"targets": [], "refs": [], "found": []}
        new = self.state(before[-1]).apply(t, r, save) if before else OrphanState.start(t, r, save)
        tables = {k: [written[f"{k}-base"]] if f"{k}-base" in written else [*old[k], written[k]] for k in old}
        new.snapshot().withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{self.root}/snapshots/{number}")
        rows = [(k, no, p) for k, ps in tables.items() for no, p in enumerate(ps)]
        self.spark.createDataFrame(rows, "part string, no int, path string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/done/{number}")
        if len(before) > 1:
            used = {p for ps in [*tables.values(), *old.values()] for p in ps}
            for n in before[:-1]:
                for f in self._fs.globStatus(self._hadoop(f"{self.root}/state/{n}/*")):
                    if f"state/{n}/{f.getPath().getName()}" not in used:
                        self._fs.delete(f.getPath(), True)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def orphans(self) -> DataFrame:
        return named(self.state().pending)
