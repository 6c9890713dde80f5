"""Fronts of two objectives as DataFrames: (keys, auc, sign, ordinal)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .places import undominated


def pareto_front(df: DataFrame, keys: list[str], x: str = "auc", y: str = "sign") -> DataFrame:
    """The rows that no other row of the keys dominates; rows equal in both stay together. See undominated()."""
    return undominated(df, keys, x, y)


def best_of(df: DataFrame, keys: list[str], objective: str, ordinal: str = "ordinal") -> DataFrame:
    """The row with the largest objective, the first of equals."""
    at = Window.partitionBy(*keys).orderBy(F.desc(objective), ordinal)
    return df.withColumn("_at", F.row_number().over(at)).where("_at = 1").drop("_at")


def knee(df: DataFrame, keys: list[str], x: str = "auc", y: str = "sign", ordinal: str = "ordinal") -> DataFrame:
    """The row farthest from the line between the best of each objective, both scaled to [0, 1]; the first of equals.
    If one row is best in both, that row."""
    whole = Window.partitionBy(*keys)
    scaled = lambda c: F.coalesce(ratio(F.col(c) - F.min(c).over(whole), F.max(c).over(whole) - F.min(c).over(whole)), F.lit(0.0))
    s = df.withColumns({"_x": scaled(x), "_y": scaled(y)})
    ends = s.groupBy(*keys).agg(*[F.max_by(F.struct("_x", "_y", ordinal), F.struct(c, F.negative(ordinal))).alias(n) for n, c in (("_p", "_x"), ("_q", "_y"))])
    s = s.join(ends, keys) if keys else s.crossJoin(F.broadcast(ends))
    p, q = F.col("_p"), F.col("_q")
    length = F.sqrt(F.pow(q["_x"] - p["_x"], F.lit(2.0)) + F.pow(q["_y"] - p["_y"], F.lit(2.0)))
    away = F.abs((F.col("_x") - p["_x"]) * (q["_y"] - p["_y"]) - (F.col("_y") - p["_y"]) * (q["_x"] - p["_x"])) / F.nullif(length, F.lit(0.0))
    same = p[ordinal] == q[ordinal]
    rank = F.when(same, (F.col(ordinal) == p[ordinal]).cast("double")).otherwise(F.round(away, 12))
    s = s.withColumn("_d", rank)
    return best_of(s, keys, "_d", ordinal).drop("_x", "_y", "_p", "_q", "_d")


def select_solution(df: DataFrame, keys: list[str], rule: str = "knee") -> DataFrame:
    if rule not in ("knee", "max_sign", "max_auc"):
        raise ValueError(f"no such rule: {rule}")
    return knee(df, keys) if rule == "knee" else best_of(df, keys, "sign" if rule == "max_sign" else "auc")
