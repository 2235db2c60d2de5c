"""References to records that are missing, deleted or arrived later.

State is kept by key: targets (kind, id) with what is known of the parent,
references (tab, owner_id, ring_no, pos) with their target, and the findings
about these. Each is a base table and a few deltas; a batch writes only the rows
of keys it touches and looks the others up by key, without moving them. Targets
and references are reduced by associative functions, so the rows of a key in all
deltas are merged by aggregating them. Probed again are new references against
the parent index, waiting ones whose parent arrived, and resolved ones whose
parent was deleted. Every few batches the deltas are merged into a new base.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BROADCAST_LIMIT, materialize, saved
from ..sources.tables import member_kind, micros, table

#: Number of each target table.
KIND_OF = {"nodes": 0, "ways": 1, "relations": 2}
#: Number of each table of references.
TAB_OF = {"way_refs": 0, "members": 1, "ring_vertices": 2}
REASONS = ["missing", "deleted", "late"]
_TARGET = ["kind", "id"]
_REF = ["tab", "owner_id", "ring_no", "pos"]
_NEVER, _LAST = -(10**17), 10**17


def target_versions(df: DataFrame, name: str) -> DataFrame:
    """kind, id, edited, visible, arrived of each row of nodes, ways or relations; null ids are dropped."""
    return df.where("id is not null").select(
        F.lit(KIND_OF[name]).cast("tinyint").alias("kind"), "id",
        F.coalesce(micros(df, "edited_at"), F.lit(_NEVER)).alias("edited"),
        F.coalesce("visible", F.lit(False)).alias("visible"),
        micros(df, "loaded_at").alias("arrived"))


def reference_versions(df: DataFrame, name: str) -> DataFrame:
    """tab, owner_id, ring_no, pos, kind, ref, edited, loaded of each row of a table of references.

    Rows with a null part of the key are dropped; a member of unknown type has a
    null kind and refers to no table.
    """
    owner, ring, pos, kind, ref = {
        "way_refs": ("way_id", F.lit(0), "pos", F.lit(0), "node_id"),
        "members": ("rel_id", F.lit(0), "pos", member_kind(F.col("mtype")), "ref_id"),
        "ring_vertices": ("rel_id", F.col("ring_no"), "vertex_no", F.lit(0), "node_idx"),
    }[name]
    out = df.select(
        F.lit(TAB_OF[name]).cast("tinyint").alias("tab"), F.col(owner).alias("owner_id"),
        ring.cast("bigint").alias("ring_no"), F.col(pos).cast("bigint").alias("pos"),
        kind.cast("tinyint").alias("kind"), F.col(ref).alias("ref"),
        F.coalesce(micros(df, "edited_at"), F.lit(_NEVER)).alias("edited"),
        F.coalesce(micros(df, "loaded_at"), F.lit(_LAST)).alias("loaded"))
    return out.dropna(subset=_REF)


def merge_targets(versions: DataFrame) -> DataFrame:
    """One row for each target: its current state and first arrival. Merging merged rows gives the same."""
    return versions.groupBy(*_TARGET).agg(
        F.max_by("visible", "edited").alias("visible"), F.max("edited").alias("edited"), F.min("arrived").alias("arrived"))


def _rank() -> Column:
    return F.col("edited").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") - F.col("loaded").cast("decimal(19,0)")


def merge_references(versions: DataFrame) -> DataFrame:
    """The current row of each reference, also where it refers to nothing (it may replace one that did)."""
    v = versions.withColumn("_rank", _rank())
    cols = ["kind", "ref", "edited", "loaded"]
    return v.groupBy(*_REF).agg(*(F.max_by(c, "_rank").alias(c) for c in cols))


def probe(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Each current reference with reason: 0 missing, 1 deleted, 2 late, null no orphan."""
    t = targets.select(F.col("kind").alias("t_kind"), F.col("id").alias("t_id"), "visible", "arrived")
    j = refs.join(t, (F.col("kind") == F.col("t_kind")) & (F.col("ref") == F.col("t_id")), "left")
    reason = F.when(F.col("ref").isNull() | F.col("kind").isNull(), None).when(F.col("t_id").isNull(), 0).when(~F.col("visible"), 1).when(F.col("arrived") > F.col("loaded"), 2)
    return j.select(*_REF, "edited", reason.cast("tinyint").alias("reason"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _in(rows: DataFrame, keys: DataFrame, n: int, on: list[str]) -> DataFrame:
    """Rows whose key is one of n keys; few keys go to the rows, so that those stay where they are."""
    return rows.join(F.broadcast(keys) if n * 64 <= BROADCAST_LIMIT else keys, on, "left_semi")


#: Deltas a state may have before they are merged into a new base.
MOST_DELTAS = 8


@dataclass
class OrphanState:
    """Targets, references and findings after some batches, each as written tables: a base and deltas, oldest first.

    save writes a table under a name and gives it back.
    """

    targets: list[DataFrame]
    refs: list[DataFrame]
    found: list[DataFrame]

    @classmethod
    def start(cls, targets: DataFrame, refs: DataFrame, save=materialize) -> OrphanState:
        """State after a first batch of versions."""
        t, r = save(merge_targets(targets), "targets"), save(merge_references(refs), "refs")
        return cls([t], [r], [save(probe(r, t).where("reason is not null").withColumn("batch", F.lit(0)), "found")])

    def apply(self, targets: DataFrame, refs: DataFrame, save=materialize) -> OrphanState:
        """State after one more batch of versions, in any order of edits and arrivals.

        What is written is in proportion to the batch and to the references of
        the targets in it. An empty batch changes nothing, a repeated one neither.
        """
        new_t, nt = saved(merge_targets(targets.select(*_TARGET, "visible", "edited", "arrived")), "batch-targets")
        new_r, nr = saved(merge_references(refs.select(*self.refs[0].columns)), "batch-refs")
        nt, nr = nt["n"], nr["n"]
        t = [*self.targets, save(merge_targets(new_t.unionByName(_in(_union(self.targets), new_t.select(*_TARGET), nt, _TARGET))), "targets")]
        r = [*self.refs, save(merge_references(new_r.unionByName(_in(_union(self.refs), new_r.select(*_REF), nr, _REF))), "refs")]
        # references that point to a target of the batch, now or in a version before
        moved = new_t.select("kind", F.col("id").alias("ref"))
        keys, n = saved(_in(_union(r).select(*_REF, "kind", "ref"), moved, nt, ["kind", "ref"]).select(*_REF).unionByName(new_r.select(*_REF)).distinct(), "touched")
        again, n = saved(merge_references(_in(_union(r), keys, n["n"], _REF)), "again")
        asked, m = saved(again.where("ref is not null and kind is not null").select("kind", F.col("ref").alias("id")).distinct(), "asked")
        about = probe(again, merge_targets(_in(_union(t), asked, m["n"], _TARGET)))
        state = OrphanState(t, r, [*self.found, save(about.withColumn("batch", F.lit(len(self.found))), "found")])
        return state if len(t) <= MOST_DELTAS else state.merged(save)

    def merged(self, save=materialize) -> OrphanState:
        """The same state as a base without deltas."""
        t, r = save(merge_targets(_union(self.targets)), "targets-base"), save(merge_references(_union(self.refs)), "refs-base")
        return OrphanState([t], [r], [save(self.pending.withColumn("batch", F.lit(0)), "found-base")])

    @property
    def pending(self) -> DataFrame:
        """The orphans: the last finding about each reference, where it has a reason."""
        if len(self.found) == 1:
            return self.found[0].where("reason is not null").drop("batch")
        last = _union(self.found).groupBy(*_REF).agg(F.max_by(F.struct("edited", "reason"), "batch").alias("f"))
        return last.select(*_REF, "f.edited", "f.reason").where("reason is not null")

    def snapshot(self) -> DataFrame:
        """Pending orphans by table, month of the reference's edit, and reason: tab, period, reason, n."""
        return named(self.pending).groupBy("tab", "period", "reason").agg(F.count(F.lit(1)).alias("n"))


def named(pending: DataFrame) -> DataFrame:
    """tab, owner_id, ring_no, pos, period, reason with names for the numbers; period is null without an edit time."""
    tabs = F.array(*(F.lit(t) for t in TAB_OF))
    day = F.date_from_unix_date(F.floor(F.col("edited") / 86_400_000_000).cast("int"))
    return pending.select(
        F.get(tabs, F.col("tab").cast("int")).alias("tab"), "owner_id", "ring_no", "pos",
        F.when(F.col("edited") != _NEVER, F.date_format(day, "yyyy-MM")).alias("period"),
        F.get(F.array(*(F.lit(x) for x in REASONS)), F.col("reason").cast("int")).alias("reason"))


def all_versions(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Versions of all targets and of all references of a dataset."""
    return (_union([target_versions(table(spark, root, t), t) for t in KIND_OF]),
            _union([reference_versions(table(spark, root, t), t) for t in TAB_OF]))


#: Share of the time between first and last arrival that the first batch of a dataset takes in.
FIRST_SHARE = 0.9


def orphans(spark: SparkSession, root: str, epochs: int = 2) -> DataFrame:
    """Orphans of a dataset, by taking its rows in as many batches of arrival time.

    With one epoch all rows are one batch. Otherwise the first takes what arrived
    in FIRST_SHARE of the time, as a first load does, the others equal steps of
    the rest; rows without an arrival come first.
    """
    t, r = all_versions(spark, root)
    lo, hi = t.agg(F.min("arrived"), F.max("arrived")).first() if epochs > 1 else (None, None)
    if lo is None:
        return named(probe(merge_references(r), merge_targets(t)).where("reason is not null"))
    first = int((hi - lo) * FIRST_SHARE)
    cuts = [lo + first + (hi - lo - first) * k // (epochs - 1) for k in range(epochs - 1)]
    nth = lambda c: sum(((F.coalesce(F.col(c), F.lit(_NEVER)) > x).cast("int") for x in cuts), F.lit(0))
    state = OrphanState.start(t.where(nth("arrived") == 0), r.where(nth("loaded") == 0))
    for k in range(1, epochs):
        state = state.apply(t.where(nth("arrived") == k), r.where(nth("loaded") == k))
    return named(state.pending)
