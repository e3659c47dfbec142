"""Joins between the groups of one source: by key, by position within key, by file stem, and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.session import cut


def stem(path: Column) -> Column:
    """File name without folders and without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def key_join(sample: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join with a side whose keys are unique."""
    return sample.join(other, key, "left")


def positional_join(sample: DataFrame, other: DataFrame, key: str, order: list[str], other_order: list[str]) -> DataFrame:
    """The i-th row of a key meets the i-th row of that key on the other side."""
    place = lambda o: F.row_number().over(Window.partitionBy(key).orderBy(*o))
    return sample.withColumn("__rn", place(order)).join(other.withColumn("__rn", place(other_order)), [key, "__rn"], "left").drop("__rn")


def admission(sample: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """How another group can join, in one row: keys shared, unique (one row a key), aligned (equal counts for every shared key), verdict."""
    a = sample.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    b = other.groupBy(key).agg(F.count(F.lit(1)).alias("m"))
    s = a.join(b, key, "inner").agg(F.count(F.lit(1)).alias("shared"), F.coalesce(F.bool_and(F.col("m") == 1), F.lit(False)).alias("is_unique"), F.coalesce(F.bool_and(F.col("n") == F.col("m")), F.lit(False)).alias("aligned"))
    verdict = F.when(F.col("shared") == 0, "skip: no shared key").when(F.col("is_unique"), "key").when(F.col("aligned"), "positional").otherwise("skip: not aligned")
    return s.withColumn("verdict", verdict)


def assemble(groups: dict[str, DataFrame], target: str | None = None, key: str = "_hash") -> tuple[DataFrame, dict[str, str]]:
    """(one table, how each other group joined) of the groups of a source.

    The rows are those of the group that has the target (`group:column`, or a column name), or of the only group that is given. Every other group joins by its admission's verdict:
    by key, by position within the key (in file order), or not at all. Columns are named `group:column` when there are several groups."""
    if len(groups) == 1:
        return next(iter(groups.values())).drop(key), {}
    held = [g for g, df in groups.items() if target and (target in df.columns or target in [f"{g}:{c}" for c in df.columns])]
    if not held:
        raise ValueError("several groups and none has the target: name it as group:column")
    base = held[0]
    named = {g: df.select(F.col(f"`{key}`").alias(key), *[F.col(f"`{c}`").alias(f"{g}:{c}") for c in df.columns if c != key]) for g, df in groups.items()}
    # Positions are the order of the files' rows, fixed once by writing them.
    placed = {g: cut(df.withColumn("__at", F.monotonically_increasing_id())) for g, df in named.items()}
    out, verdicts = placed[base], {}
    for g, other in placed.items():
        if g == base:
            continue
        how = verdicts[g] = admission(placed[base], other, key).first()["verdict"]
        other = other.withColumnRenamed("__at", "__there")
        if how == "key":
            out = key_join(out, other.drop("__there"), key)
        elif how == "positional":
            out = positional_join(out, other, key, ["__at"], ["__there"]).drop("__there")
    return out.drop(key, "__at"), verdicts


def best_stem_column(sample: DataFrame, columns: list[str], stems: DataFrame, stem_col: str) -> str | None:
    """The column of sample whose cells' stems hit most of the given stems; one pass per candidate column, counts only."""
    hits = {}
    for c in columns:
        hits[c] = sample.select(stem(F.col(c)).alias("__s")).join(stems.select(F.col(stem_col).alias("__s")).distinct(), "__s", "left_semi").count()
    best = max(columns, key=lambda c: hits[c], default=None)
    return best if best is not None and hits[best] else None


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, default) -> DataFrame:
    """Left join with a default for unseen keys."""
    t = table.select(F.col(table_key).alias("__k"), F.col(value).alias(value))
    return df.join(t, F.col(key) == F.col("__k"), "left").withColumn(value, F.coalesce(value, F.lit(default))).drop("__k")
