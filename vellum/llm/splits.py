"""Train, validation and test splits that keep related records together.

Records that share an entity, directly or over any number of ties, form a group (connected components).  Groups carry the
vector of their label counts and are placed by grouped iterative stratification: the label with the fewest outstanding
records goes first, its groups by size, each into the split that needs that label most.

Groups of a thousandth of all records or more, at most a thousand by that bound, are placed first, on the driver.  The rest is
placed in buckets of bounded expected size, each against its share of what the large groups left to fill, so no task holds
all groups.  A bucket holds groups with the same rarest label: the groups of a label that is rare everywhere meet in one task and
get that label's shares exactly, instead of one group per task, which would always go to the largest split.

Defined results: a null entity is a group of its own named by null; null labels count as a label; an empty table stays empty; more
than ``most_labels`` different labels raise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.keys import leading_patent, plain_patent
from vellum.operators.components import components
from vellum.operators.relational import hot_keys, hot_of, salted_join
from vellum.session import written

SPLITS, SHARES = ("train", "validation", "test"), (0.8, 0.1, 0.1)
MOST_LABELS = 4_096
BUCKET_GROUPS = 5_000
LARGE = 1_000


def grouped(rows: DataFrame, entity: F.Column, tie: F.Column) -> DataFrame:
    """Rows with ``group_key``, the smallest entity that they are connected to by ties."""
    named = rows.withColumn("_entity", entity).withColumn("_tied", tie)
    edges = named.select("_entity", "_tied").where("_tied is not null and _entity is not null and _tied <> _entity").distinct()
    roots = written(components(edges, "_entity", "_tied"), "split-groups").withColumnsRenamed({"node": "_entity", "root": "_found"})
    return salted_join(named, roots, ["_entity"], hot_keys(named, ["_entity"])).withColumn("group_key", F.coalesce("_found", "_entity")).drop("_entity", "_tied", "_found")


def place(groups: list[tuple[object, dict[str, int]]], desired: list[dict[str, float]], room: list[float]) -> dict[object, int]:
    """Split number of each ``(key, label counts)``; ``desired`` (per split and label) and ``room`` are used up."""
    outstanding: dict[str, int] = {}
    having: dict[str, list[int]] = {}
    for k, (_, counts) in enumerate(groups):
        for label, n in counts.items():
            outstanding[label] = outstanding.get(label, 0) + n
            having.setdefault(label, []).append(k)
    placed: dict[object, int] = {}
    left = set(range(len(groups)))
    while left:
        label = min((x for x in outstanding if outstanding[x] > 0), key=lambda x: (outstanding[x], x))
        for k in sorted((k for k in having[label] if k in left), key=lambda k: (-groups[k][1][label], -sum(groups[k][1].values()), str(groups[k][0]))):
            key, counts = groups[k]
            s = max(range(len(room)), key=lambda i: (desired[i].get(label, 0.0), room[i], -i))
            placed[key] = s
            left.discard(k)
            for x, n in counts.items():
                desired[s][x] = desired[s].get(x, 0.0) - n
                room[s] -= n
                outstanding[x] -= n
        outstanding[label] = 0
    return placed


def group_splits(rows: DataFrame, label: str, shares: tuple[float, ...] = SHARES, names: tuple[str, ...] = SPLITS, bucket_groups: int = BUCKET_GROUPS, large: int = LARGE, most_labels: int = MOST_LABELS) -> DataFrame:
    """``(group_key, split)`` for rows with a ``group_key``."""
    text = F.coalesce(F.col(label).cast("string"), F.lit("\0null"))
    cells = written(rows.groupBy("group_key", text.alias("label")).agg(F.count("*").alias("n")), "split-cells")
    sums = cells.groupBy("label").agg(F.sum("n").alias("in_all")).limit(most_labels + 1).collect()  # a checked number of rows
    if len(sums) > most_labels:
        raise ValueError(f"more than {most_labels} different labels")
    totals = {r["label"]: r["in_all"] for r in sums}
    rarity = rows.sparkSession.createDataFrame(list(totals.items()), "label string, in_all bigint")
    vectors = cells.join(F.broadcast(rarity), "label").groupBy("group_key").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("counts"), F.sum("n").alias("n"), F.min(F.struct("in_all", "label"))["label"].alias("rarest"))
    groups = written(vectors, "split-vectors")
    total = sum(totals.values())
    bound = max(1, total // large)
    big = [(r["group_key"], dict(r["counts"])) for r in groups.where(F.col("n") > bound).select("group_key", "counts", "n").orderBy(F.desc("n"), "group_key").collect()]  # fewer than ``large`` rows
    desired = [{x: w * n for x, n in totals.items()} for w in shares]
    room = [w * total for w in shares]
    fixed = place(big, desired, room)
    need = {x: [max(0.0, d[x]) for d in desired] for x in totals}
    shares_left = {x: [v / sum(vs) for v in vs] if sum(vs) else list(shares) for x, vs in need.items()}
    open_room = [max(0.0, r) for r in room]
    room_left = [r / sum(open_room) for r in open_room] if sum(open_room) else list(shares)
    kind = rows.schema["group_key"].dataType.simpleString()
    schema = f"group_key {kind}, split string"

    def bucket(frame: pd.DataFrame) -> pd.DataFrame:
        own = [(k, dict(c)) for k, c in zip(frame["group_key"], frame["counts"])]
        sums: dict[str, int] = {}
        for _, c in own:
            for x, n in c.items():
                sums[x] = sums.get(x, 0) + n
        n = sum(sums.values())
        found = place(own, [{x: shares_left[x][i] * m for x, m in sums.items()} for i in range(len(names))], [w * n for w in room_left])
        return pd.DataFrame([(k, names[s]) for k, s in found.items()], columns=["group_key", "split"])

    small = groups.where(F.col("n") <= bound)
    many = small.groupBy("rarest").agg(F.ceil(F.count("*") / bucket_groups).alias("buckets"))  # a row per label
    rest = small.join(F.broadcast(many), "rarest").withColumn("bucket", F.pmod(F.xxhash64("group_key"), F.col("buckets")))
    rest = rest.groupBy("rarest", "bucket").applyInPandas(bucket, schema)
    return rest.unionByName(rows.sparkSession.createDataFrame([(k, names[s]) for k, s in fixed.items()], schema))


def split_rows(rows: DataFrame, label: str, **how: object) -> DataFrame:
    """Rows with their ``split``; groups are never divided, and those that hold many rows are spread over tasks."""
    key = F.struct(F.coalesce("group_key", F.lit("")).alias("k"), F.col("group_key").isNull().alias("none"))  # null is a group too
    chosen = written(group_splits(rows, label, **how).select(key.alias("_group"), "split"), "split-choice")
    own = rows.withColumn("_group", key)
    return salted_join(own, chosen, ["_group"], hot_keys(own, ["_group"])).drop("_group")


def patent_groups(results: DataFrame) -> DataFrame:
    """Rows of ``results`` with the group of their patent, tied to the patent that ``sketch_id`` starts with."""
    return grouped(results, plain_patent(F.col("patent_id")), leading_patent(F.col("sketch_id")))


def mixed_groups(rows: DataFrame, shown: str) -> DataFrame:
    """Rows of groups that show more than one stored value of ``shown``."""
    seen = written(rows.groupBy("group_key").agg(F.min(shown).alias("low"), F.max(shown).alias("high"), F.count("*").alias("n")), "group-values")
    return salted_join(rows, seen.where("low <> high").select("group_key"), ["group_key"], hot_of(seen, ["group_key"], "n"), "left_semi")
