"""Joins, deduplication, upserts, exact ranks and samples of the corpus layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.components import components
from vellum.session import written


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest ``order`` of each key; only the key and ``order`` are aggregated, then joined back.

    ``order`` must be unique per key for one row to stay; null keys form a key.
    """
    last = df.groupBy(*keys).agg(F.max(order).alias("_last")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_last")
    same = F.col(order) == F.col("_last")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(last, same, "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not among the new ones, and all new rows; columns that one side lacks are null."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def unseen(candidates: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose key has no row yet, whatever its state."""
    return candidates.join(done.select(*keys), keys, "left_anti")


def ranked(df: DataFrame, *order: str | Column, name: str = "rank") -> tuple[DataFrame, int]:
    """Rows with their exact rank from 0 over all rows, and the number of rows.

    Rows are range-partitioned and written once; each partition ranks its own and adds the rows before it, so no task sees all.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    tagged = df.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(cols)])
    keys = [F.col(f"_o{i}") for i in range(len(cols))]
    cut = written(tagged.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = {r[0]: r[1] for r in cut.groupBy("_part").count().collect()}  # one row per partition
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before bigint")
    own = cut.join(F.broadcast(offsets), "_part").withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1 + F.col("_before"))
    return own.drop("_part", "_before", *[f"_o{i}" for i in range(len(cols))]), total


def tile(rank: Column, total: int, bins: int) -> Column:
    """Bin from 1 of a rank from 0; the first bins take the rows that are over."""
    size, over = divmod(total, bins)
    wide = over * (size + 1)
    return F.when(rank < wide, F.floor(rank / (size + 1)) + 1).otherwise(F.floor((rank - wide) / max(1, size)) + 1 + over)


def in_order_of_hash(*keys: str) -> Column:
    """A seeded order that does not depend on the engine or the partitions."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_id: str, right_id: str, cutoff: float) -> DataFrame:
    """The nearest point on the right, in the same group and within ``cutoff``, of each point ``(x, y)`` on the left.

    Groups are split into cells of the cutoff's size, so only neighbouring cells meet; ties go to the smaller right id.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(cutoff)).cast("bigint")
    a = left.select(*by, left_id, F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = right.select(*by, right_id, F.col("x").alias("bx"), F.col("y").alias("by_"), cell("x").alias("_c"), cell("y").alias("_d"), F.explode(steps).alias("_s"))
    b = b.select(*by, right_id, "bx", "by_", (F.col("_c") + F.col("_s.i")).alias("cx"), (F.col("_d") + F.col("_s.j")).alias("cy"))
    gap = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by_"))
    pairs = a.join(b, [*by, "cx", "cy"]).select(*by, left_id, right_id, gap.alias("distance")).where(F.col("distance") <= cutoff)
    best = pairs.groupBy(*by, left_id).agg(F.min(F.struct("distance", right_id)).alias("best"))
    return best.select(*by, left_id, F.col(f"best.{right_id}").alias(right_id), F.col("best.distance").alias("distance"))


def matched(pairs: DataFrame, by: list[str], gold_id: str) -> DataFrame:
    """True positives of one-to-one matching where only the nearest gold point counts: the distinct nearest ones."""
    return pairs.groupBy(*by).agg(F.countDistinct(gold_id).alias("tp"))


def grouped_within(pairs: DataFrame, by: str, left: str, right: str) -> DataFrame:
    """``(by, left, root)``: connected members of each group of ``by``, named by their smallest; members without a partner have no row.

    Members are whole numbers of at most 64 bits; the pair of group and member is one node, so nothing can collide.
    """
    key = lambda c: F.struct(F.col(by).alias("g"), F.col(c).alias("m"))
    roots = components(pairs.select(key(left).alias("src"), key(right).alias("dst")))
    return roots.select(F.col("node.g").alias(by), F.col("node.m").alias(left), F.col("root.m").alias("root"))


def limited_first(candidates: DataFrame, order: list[str], limit: int, *taken: tuple[DataFrame, list[str]]) -> DataFrame:
    """The first ``limit`` candidates in order, and of these the ones that no table of ``taken`` has: the limit comes before the filters."""
    first = candidates.orderBy(*order).limit(limit)
    for rows, keys in taken:
        first = unseen(first, rows, keys)
    return first


def sampled_ids(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """All rows of ``n`` distinct keys, the first in a seeded order."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    return rows.join(rows.select(key).distinct().orderBy(order, key).limit(n), key, "left_semi")


#: A key is hot if it holds more than one in so many rows, so there are fewer hot keys than that; salts that its rows are spread over.
HOT_SHARE, SALTS = 1_000, 32


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that hold more than a thousandth of all rows: fewer than a thousand, from counts that are combined before the shuffle."""
    counts = written(rows.groupBy(*keys).agg(F.count("*").alias("_n")), "key-counts")
    return hot_of(counts, keys, "_n")


def hot_of(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """The same from a table of counts."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) * HOT_SHARE > total).select(*keys)


def salted_join(rows: DataFrame, keyed: DataFrame, keys: list[str], hot: DataFrame, how: str = "left") -> DataFrame:
    """``rows.join(keyed, keys, how)`` whose hot keys are spread over ``SALTS`` partitions.

    ``keyed`` has a row per key, or few; ``hot`` comes from ``hot_keys`` or ``hot_of``, so it is small enough to be sent to every task.  Salts
    follow from the rows' contents, so a repeated task deals its rows alike.
    """
    small = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    plain = [F.col("`" + c.replace("`", "``") + "`") for c, t in rows.dtypes if "map<" not in t and "variant" not in t]  # what can be hashed
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*plain), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint"))
    own = rows.join(small, keys, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    other = keyed.join(small, keys, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return own.join(other, [*keys, "_salt"], how).drop("_salt")
