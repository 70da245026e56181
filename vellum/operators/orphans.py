"""References to records that do not exist, kept as incremental keyed state.

The state is a log of written tables; nothing is rewritten:

* the *parent index*, additions to a counter per ``(space, key, live_from)``: rows seen and rows alive.  Arrivals and deletions are both
  additions, so hot keys are combined before the shuffle and a deletion can reopen what an earlier row had resolved;
* the *references*, each with the state that the index gave it when it came;
* the *changes*, references whose state a later batch has changed.

A batch adds its own counts and references.  It probes its new references and those old ones whose key it touches, against the part of
the index that holds these keys, and logs the states that differ.  So a batch writes in proportion to what it touches, and only that
is shuffled: where the keys asked for are few, which is counted, they are sent to the state's scans.  After ``PARTS`` batches the log is
folded into one table each.

Defined results: references with a null key are no references; a key's state is ``missing`` without any row, ``deleted`` if no
row is alive, ``late`` if the earliest live row starts after the reference, else ``resolved``; a null start counts as earliest;
repeated references are references each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.keys import last_part, plain_patent, run_path, utc_month
from vellum.operators.relational import hot_keys, salted_join
from vellum.session import table, written

KEY = ["space", "key"]
REFERENCE = ["ref_table", "ref_field", "load_no", "ref_at", *KEY]
INDEX = [*KEY, "live_from", "n_rows", "n_live"]
#: A reference's own number: the batch it came with and its place there.
OWN = ["batch", "n"]
#: Keys that are sent to every task instead of shuffling the state (some MB); parts of the log before it is folded.
FEW_KEYS, PARTS = 50_000, 8


def parent_events(rows: DataFrame, space: str, key: F.Column, since: str, until: str) -> DataFrame:
    """Arrivals and deletions of parent rows as additions to the index, each with its time ``at``."""
    own = rows.select(F.lit(space).alias("space"), key.alias("key"), F.col(since).alias("live_from"), F.col(until).alias("gone_at")).where("key is not null")
    change = F.array(
        F.struct(F.col("live_from").alias("at"), F.lit(1).cast("bigint").alias("n_rows"), F.lit(1).cast("bigint").alias("n_live")),
        F.struct(F.col("gone_at").alias("at"), F.lit(0).cast("bigint").alias("n_rows"), F.lit(-1).cast("bigint").alias("n_live")),
    )
    kept = F.filter(change, lambda x: (x["n_rows"] == 1) | F.col("gone_at").isNotNull())
    return own.select(*KEY, "live_from", F.inline(kept)).select(*INDEX, "at")


def references(rows: DataFrame, ref_table: str, ref_field: str, space: str, key: F.Column, at: str = "loaded_at", row_id: str = "load_no") -> DataFrame:
    """References of one field."""
    return rows.select(F.lit(ref_table).alias("ref_table"), F.lit(ref_field).alias("ref_field"), F.col(row_id).alias("load_no"), F.col(at).alias("ref_at"), F.lit(space).alias("space"), key.alias("key")).where("key is not null")


def merged(counts: DataFrame) -> DataFrame:
    """The index with one counter per start; sums are combined on the map side."""
    return counts.groupBy(*KEY, "live_from").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_live").alias("n_live"))


def probed(refs: DataFrame, index: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """References with the state that the index gives them; those of hot keys are spread over tasks."""
    alive = F.when(F.col("n_live") > 0, F.struct(F.coalesce("live_from", F.timestamp_seconds(F.lit(0))).alias("first")))
    keys = index.groupBy(*KEY).agg(F.sum("n_rows").alias("n_rows"), F.min(alive).getField("first").alias("first_live"))
    state = (
        F.when(F.col("n_rows").isNull() | (F.col("n_rows") == 0), "missing")
        .when(F.col("first_live").isNull(), "deleted")
        .when(F.col("first_live") > F.col("ref_at"), "late")
        .otherwise("resolved")
    )
    return salted_join(refs, keys, KEY, hot_keys(refs, KEY) if hot is None else hot).select(*refs.columns, state.alias("ref_state"))


def union(parts: tuple[DataFrame, ...] | list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def of_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows with one of the keys; the keys are a written table, so they are counted at no cost."""
    own = keys.select(*KEY)
    return rows.join(F.broadcast(own) if keys.count() <= FEW_KEYS else own, KEY, "left_semi")


@dataclass
class OrphanState:
    """State after the batches so far; ``advance`` gives the next one and leaves this one as it is.

    ``hot`` are the keys that hold the most references, if they are known; else each batch counts its own.
    """

    hot: DataFrame | None = None
    index: tuple[DataFrame, ...] = ()
    refs: tuple[DataFrame, ...] = ()
    changes: tuple[DataFrame, ...] = ()
    batches: int = 0

    def advance(self, new_refs: DataFrame, events: DataFrame) -> OrphanState:
        """Take in one batch: arriving parents resolve waiting orphans, deletions reopen resolved references.

        ``new_refs`` is read twice and must give its rows in the same partitions, as a written table does.
        """
        number = self.batches + 1
        delta = written(merged(events), "orphan-index")
        index = (*self.index, delta)
        asked = new_refs.select(*REFERENCE).withColumns({"batch": F.lit(number), "n": F.monotonically_increasing_id(), "before": F.lit(None).cast("string")})
        if self.refs:
            asked = asked.unionByName(of_keys(self.latest, delta).withColumnRenamed("ref_state", "before"))
        keys = written(asked.select(*KEY).distinct(), "orphan-keys")
        found = written(probed(asked, merged(of_keys(union(index), keys)), self.hot), "orphan-found")
        new = found.where("before is null").drop("before")
        changed = found.where("before <> ref_state").select(*OWN, "ref_state", F.lit(number).alias("at_batch"))
        return OrphanState(self.hot, index, (*self.refs, new), (*self.changes, changed) if self.refs else (), number).folded()

    @cached_property
    def latest(self) -> DataFrame:
        """All references with their state now."""
        rows = union(self.refs)
        if not self.changes:
            return rows
        last = union(self.changes).groupBy(*OWN).agg(F.max(F.struct("at_batch", "ref_state")).alias("m")).select(*OWN, F.col("m.ref_state").alias("now"))
        last = written(last, "orphan-changed")
        return rows.join(F.broadcast(last) if last.count() <= FEW_KEYS else last, OWN, "left").withColumn("ref_state", F.coalesce("now", "ref_state")).drop("now")

    def folded(self) -> OrphanState:
        """The same state with one part of each kind, once there are many."""
        if len(self.index) <= PARTS:
            return self
        return OrphanState(self.hot, (written(merged(union(self.index)), "orphan-index"),), (written(self.latest, "orphan-refs"),), (), self.batches)

    def orphans(self) -> DataFrame:
        """All references that have no target now."""
        return self.latest.where("ref_state <> 'resolved'").select("ref_table", "ref_field", "load_no", utc_month(F.col("ref_at")).alias("ref_month"), "ref_state")

    def snapshot(self) -> DataFrame:
        """Counts per table, field, month and state."""
        return self.orphans().groupBy("ref_table", "ref_field", "ref_month", "ref_state").agg(F.count("*").alias("n_refs"))


def period(at: str, months: int) -> F.Column:
    """Number of the period of so many months; nulls are in the first."""
    return F.coalesce(F.floor((F.year(at) * 12 + F.month(at) - 1) / months), F.lit(0))


def replay(refs: DataFrame, events: DataFrame, months: int = 6) -> list[tuple[str, OrphanState]]:
    """State after each period of ``months`` months, fed in order of time; the last holds for all events.

    The number of batches follows from the span of time, not from the rows.
    """
    refs = written(refs.withColumn("period", period("ref_at", months)), "orphan-new-refs", "period")
    events = written(events.withColumn("period", period("at", months)).groupBy(*KEY, "live_from", "period").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_live").alias("n_live")), "orphan-events", "period")
    found = sorted(r[0] for r in refs.select("period").union(events.select("period")).distinct().collect())  # one row per period
    states, state = [], OrphanState(hot_keys(refs, KEY))
    for p in found or [0]:
        state = state.advance(refs.where(F.col("period") == p).drop("period"), events.where(F.col("period") == p).drop("period"))
        states.append((f"{p * months // 12:04d}-{p * months % 12 + 1:02d}", state))
    return states


def snapshots(states: list[tuple[str, OrphanState]]) -> DataFrame:
    """Orphans per period, table, field, month and state, as they stood at each period's end."""
    return union([state.snapshot().select(F.lit(name).alias("period"), "*") for name, state in states])


def corpus_references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """References and parent events of the run folder and the page manifest."""
    manifest, results = table(spark, sf_dir, "training_manifest"), table(spark, sf_dir, "results")
    files, pages = table(spark, sf_dir, "artifact_files"), table(spark, sf_dir, "filter_manifest")
    page = lambda patent, name: F.concat_ws("/", plain_patent(F.col(patent)), name)
    refs = references(manifest, "training_manifest", "graph_path", "artifact", run_path(F.col("graph_path")))
    refs = refs.unionByName(references(manifest, "training_manifest", "svg_path", "artifact", run_path(F.col("svg_path"))))
    refs = refs.unionByName(references(results, "results", "filename", "page", page("patent_id", last_part(F.col("input_path")))))
    events = parent_events(files, "artifact", run_path(F.col("path")), "created_at", "deleted_at")
    return refs, events.unionByName(parent_events(pages, "page", page("patent", F.col("filename")), "loaded_at", "removed_at"))
