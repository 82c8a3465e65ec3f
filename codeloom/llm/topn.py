"""The N best items of every group, ranked in two stages.

1. Items are hashed into subgroups of their group; each subgroup is ranked by itself and keeps its N best.
2. The survivors of a group, at most N for each subgroup, are ranked again by the same order.

There are as many subgroups as tasks of a shuffle, so the items of a group of any size are spread evenly over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(rows: DataFrame, group: Column, item: Column, order: list[tuple[Column, bool]], n: int, subgroups: int | None = None) -> DataFrame:
    """group_key, item_id, rank of the n best items of each group. order: (column, descending), most important first; the item
    decides what is still even, so that ranks are the same in every run. Strings compare by their UTF-8 bytes.

    Items that come several times with the same ordering count once; floods of copies are combined before they travel. Nulls in
    group form a group; nulls in order rank last. Groups of fewer than n items come out whole, n below 1 and an empty input give
    no rows, other columns are ignored. subgroups: spark.sql.shuffle.partitions unless given."""
    salts = subgroups or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [c.alias(f"o{k}") for k, (c, _) in enumerate(order)]
    once = rows.select(group.alias("group_key"), item.alias("item_id"), *keys).distinct()
    by = [F.col(f"o{k}").desc_nulls_last() if down else F.col(f"o{k}").asc_nulls_last() for k, (_, down) in enumerate(order)]

    def best(of: DataFrame, *per: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*per).orderBy(*by, F.col("item_id").asc_nulls_last()))
        return of.withColumn("rank", rank).filter(F.col("rank") <= n)

    salted = once.withColumn("subgroup", F.pmod(F.xxhash64("item_id"), F.lit(salts)).cast("int"))
    survivors = best(salted, "group_key", "subgroup").drop("rank")
    return best(survivors, "group_key").select("group_key", "item_id", "rank")
