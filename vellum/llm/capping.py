"""At most so many records per contributor, the best by a quality score, kept as incremental state.

The state holds each contributor's kept records and, once it is full, the cutoff: score and id of the last kept one.  A batch
is filtered against the cutoffs (what ranks behind is logged as displaced at once); the rest is reduced to its best per
contributor and salt, merged with the kept records, and what the merge pushes out is logged too.  A contributor with a third
of all rows is cut to its best within each salt before its rows meet.

Defined results: scores that are null, NaN or outside the valid range rank last; ties go to the smaller id; a null contributor
is a contributor; an empty batch changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.relational import hot_keys, salted_join
from vellum.session import written

SALTS = 64
ROW = ["contributor", "row_id", "score"]


def scored(rows: DataFrame, contributor: F.Column, row_id: str, score: str, at: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rows in the form of the state, with their time ``at``; an invalid score becomes one below all valid ones."""
    x = F.col(score)
    valid = x.isNotNull() & ~F.isnan(x) & (x >= low) & (x <= high)
    return rows.select(F.coalesce(contributor, F.lit("")).alias("contributor"), F.col(row_id).alias("row_id"), F.when(valid, x).otherwise(low - 1.0).alias("score"), F.col(at).alias("at"))


def best(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows per contributor, first within salts, then over them."""
    order = [F.desc("score"), F.asc("row_id")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)))
    few = salted.withColumn("place", F.row_number().over(Window.partitionBy("contributor", "salt").orderBy(*order))).where(F.col("place") <= limit)
    return few.withColumn("place", F.row_number().over(Window.partitionBy("contributor").orderBy(*order))).where(F.col("place") <= limit).select(*ROW, "place")


def behind(rows: DataFrame, cutoffs: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows with ``out``: whether they rank behind their contributor's cutoff; the rows of hot contributors are spread over tasks."""
    out = (F.col("score") < F.col("cut_score")) | ((F.col("score") == F.col("cut_score")) & (F.col("row_id") > F.col("cut_id")))
    return salted_join(rows.select(*ROW), cutoffs, ["contributor"], hot).select(*ROW, F.coalesce(out, F.lit(False)).alias("out"))


@dataclass
class CapState:
    """Kept records and the log of displaced ones after the batches so far; ``hot`` are the contributors with the most rows."""

    limit: int
    hot: DataFrame
    kept: DataFrame | None = None
    displaced: tuple[DataFrame, ...] = ()

    def cutoffs(self) -> DataFrame:
        """Score and id of the last kept record of every full contributor."""
        return self.kept.where(F.col("place") == self.limit).select("contributor", F.col("score").alias("cut_score"), F.col("row_id").alias("cut_id"))

    def advance(self, batch: DataFrame) -> CapState:
        """Take in one batch of scored rows with ids that no earlier batch had."""
        if self.kept is None:
            pool, log = batch.select(*ROW), ()
        else:
            tried = written(behind(batch, self.cutoffs(), self.hot), "cap-tried")
            log = (tried.where("out").select(*ROW),)
            pool = tried.where("not out").select(*ROW).unionByName(self.kept.select(*ROW))
        state = CapState(self.limit, self.hot, written(best(pool, self.limit), "cap-kept"))
        log += (behind(pool, state.cutoffs(), self.hot).where("out").select(*ROW),)
        return CapState(self.limit, self.hot, state.kept, self.displaced + log)

    def log(self) -> DataFrame:
        """All displaced rows."""
        whole = self.displaced[0]
        for part in self.displaced[1:]:
            whole = whole.unionByName(part)
        return whole


def share_limit(rows: DataFrame, share: float) -> int:
    """The largest count that is at most ``share`` of all rows, 1 at least."""
    return max(1, int(rows.count() * share))


def capped(rows: DataFrame, limit: int = 10, months: int = 6) -> CapState:
    """Feed scored rows in batches of ``months`` months, in order of their time; rows without one come first."""
    period = F.coalesce(F.floor((F.year("at") * 12 + F.month("at") - 1) / months), F.lit(0))
    staged = written(rows.withColumn("period", period).select(*ROW, "period"), "cap-rows", "period")
    state = CapState(limit, hot_keys(staged, ["contributor"]))
    for p in sorted(r[0] for r in staged.select("period").distinct().collect()) or [0]:  # one row per period
        state = state.advance(staged.where(F.col("period") == p))
    return state
