"""Numbers and running values in order within keys, by range partition: no key is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cavitas.session import cut


def _in_parts(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return cut(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))


def _carried(dealt: DataFrame, keys: list[str], of_part: Column, before: Column, default) -> DataFrame:
    """``dealt`` with ``__before``: what earlier parts of its key pass on, ``default`` for the first.

    Keys and parts in order run alike, so that a part begins inside one key at most: what is broadcast has fewer rows than there are parts.
    """
    by_part = dealt.groupBy(*keys, "__part").agg(of_part.alias("__own"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    passed = by_part.withColumn("__before", before.over(earlier)).where("__before IS NOT NULL").select(*keys, "__part", "__before")
    same = [dealt[k].eqNullSafe(F.col(f"__k{n}")) for n, k in enumerate(keys)]
    passed = passed.select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], F.col("__part").alias("__of_part"), "__before")
    joined = dealt.join(F.broadcast(passed), [dealt["__part"] == F.col("__of_part"), *same], "left")
    return joined.withColumn("__before", F.coalesce("__before", F.lit(default))).drop("__of_part", *[f"__k{n}" for n in range(len(keys))])


def numbered(rows: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """``rows`` with their number from 1 in order within each key.

    Rows are dealt by range of key and order, each part counts its own, and a key that goes on from
    one part to the next passes its count on.
    """
    dealt = _carried(_in_parts(rows, keys, order), keys, F.count("*"), F.sum("__own"), 0)
    own = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    return dealt.withColumn(name, F.col("__before") + own).drop("__part", "__before")


def running_max(rows: DataFrame, keys: list[str], order: list, value: str, name: str, default=0) -> DataFrame:
    """``rows`` with the largest ``value`` of those up to each in order within its key (null ones left out); ``default`` if there is none."""
    dealt = _carried(_in_parts(rows, keys, order), keys, F.max(value), F.max("__own"), default)
    own = F.max(value).over(Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(name, F.greatest(F.col("__before"), F.coalesce(own, F.lit(default)))).drop("__part", "__before")
