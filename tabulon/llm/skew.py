"""Joining rows to their groups when one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of more than this share of all rows, so fewer than this many, meet their rows without a shuffle.
HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows left-joined to groups(key, size, ...), which holds one row per key and the number of its rows.

    A group with over total / HOT rows is hot. There are fewer than HOT of them whatever the input, and as every one of their rows carries the key, the
    keys together are no longer than HOT times the mean key of the rows: that bounds what is broadcast. All other groups meet
    their rows by a shuffle in which no key has more than total / HOT rows. Keys are not null."""
    limit = total // HOT
    hot = groups.filter(F.col(size) > limit).withColumn("__hot", F.lit(True))
    cold = groups.filter(F.col(size) <= limit)
    more = [c for c in groups.columns if c != key]
    met = rows.join(F.broadcast(hot), key, "left")
    there = cold.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__c_{c}") for c in more])
    done = met.filter("__hot").select(*rows.columns, *more)
    rest = met.filter("__hot is null").select(*rows.columns)
    rest = rest.join(there.hint("merge"), F.col(key) == F.col("__k"), "left").select(*rows.columns, *[F.col(f"__c_{c}").alias(c) for c in more])
    return done.unionByName(rest)
