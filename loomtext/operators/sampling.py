"""First-wins dedupe, even and capped samples, quotas and splits.

Random order is the order of md5(seed:id): the same on every run, engine and partitioning. All ranks have a total order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import cut_lineage


def first_wins(df: DataFrame, key: Column | str, *order: str) -> DataFrame:
    """The first row of each key in read order; rows without a key stay out."""
    k = F.col(key) if isinstance(key, str) else key
    row = F.struct(*[F.col(o) for o in order], F.struct(*[F.col(c) for c in df.columns]).alias("_row"))
    # min of (order, row) is combined before the shuffle, which a window rank is not
    return df.where(k.isNotNull()).groupBy(k.alias("_key")).agg(F.min(row).alias("_m")).select("_m._row.*")


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key, as repeated keys of a lookup table are resolved."""
    row = F.struct(*[F.col(o) for o in order], F.struct(*[F.col(c) for c in df.columns]).alias("_row"))
    return df.groupBy(*keys).agg(F.max(row).alias("_m")).select("_m._row.*")


def ranked(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Row number from 0 over the whole table without bringing it into one task.

    There are as many ranges as the table has partitions, or as a shuffle has if these are more. Rows are range-partitioned in order and written once, so that both readings see the same partitions; the offsets are the
    running sums of one count per partition.
    """
    buckets = max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = df.repartitionByRange(buckets, *order).sortWithinPartitions(*order)
    own = cut_lineage(parts.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33)), "ranked")
    counts = own.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return own.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")  # one row a partition


def systematic(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Every (N / n)-th row in order: the rows at floor(i * (N / n)) for i below n; all rows if there are no more than n."""
    total = df.count()
    if total <= n:
        return df
    rows = df.sparkSession.range(n).select(F.floor(F.col("id") * (F.lit(float(total)) / F.lit(float(n)))).alias("_r"))
    return ranked(df, "_r", *order).join(rows, "_r", "left_semi").drop("_r")


def hash_order(id_col: str, seed: int = 0) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def capped(df: DataFrame, group: str, cap: Column | int, id_col: str, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows of each group, in hash order; a null group is one group."""
    w = Window.partitionBy(group).orderBy(hash_order(id_col, seed), F.col(id_col))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= (F.lit(cap) if isinstance(cap, int) else cap)).drop("_r")


def first_rows(df: DataFrame, group: str, cap: int, *order: str) -> DataFrame:
    """The first ``cap`` rows of each group in read order."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def quotas(df: DataFrame, bucket: str, want: dict[str, int], id_col: str, seed: int = 0) -> DataFrame:
    """So many rows of each bucket, in hash order."""
    # a limit that is a number is pushed below the shuffle, so that each task passes on that many rows of a bucket only
    parts = [capped(df.where(F.col(bucket) == k), bucket, n, id_col, seed) for k, n in want.items() if n > 0]
    return reduce(DataFrame.unionByName, parts) if parts else df.where("false")


def water_fill(kept: dict[str, int], priority: list[str], quota: int) -> dict[str, int]:
    """How many rows each source gives, in the order of priority, until the quota is reached; later sources aren't in the result."""
    taken: dict[str, int] = {}
    left = quota
    for s in priority:
        if left <= 0:
            break
        taken[s] = min(kept.get(s, 0), left)
        left -= taken[s]
    return taken


def fill_by_priority(df: DataFrame, source: str, priority: list[str], quota: int, *order: str) -> DataFrame:
    """All rows of the sources before the quota is full, and an even sample of the one that overflows it."""
    kept = dict(df.where(F.col(source).isin(*priority)).groupBy(source).count().collect())  # one row a source
    parts = []
    for s, n in water_fill(kept, priority, quota).items():
        rows = df.where(F.col(source) == s)
        parts.append(rows if n >= kept.get(s, 0) else systematic(rows, n, *order))
    out = parts[0] if parts else df.where("false")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def eval_size(pool: int, train: int = 12_000, most: int = 800, least: int = 250, small: int = 300) -> tuple[int, bool, int]:
    """(rows for evaluation, partial corpus, rows missing) of a pool."""
    n = min(most, pool - train)
    if n >= least:
        return n, False, 0
    return min(small, pool // 10), True, train + least - pool


def split_eval(df: DataFrame, n: int, id_col: str, seed: int = 0) -> DataFrame:
    """Adds ``split``: the first ``n`` rows in hash order are "eval", the others "train"."""
    return ranked(df.withColumn("_h", hash_order(id_col, seed)), "_r", "_h", id_col).withColumn("split", F.when(F.col("_r") < n, "eval").otherwise("train")).drop("_h", "_r")
