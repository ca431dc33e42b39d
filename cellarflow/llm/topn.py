"""Top N items within every group: local bounds from each partition, the best bound per group, then a small ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellarflow.runtime import materialize

#: Candidate rows a task gathers before it folds them into its local tops.
FOLD_ROWS = 200_000
_LOCAL = "grp string, item string, score double, bound double"


def _fold(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """The N best different items of each group, best first; an item counts with its highest score."""
    rows = rows.sort_values(["grp", "score", "item"], ascending=[True, False, True], kind="stable")
    rows = rows.drop_duplicates(["grp", "item"])
    return rows[rows.groupby("grp", sort=False).cumcount() < n]


def _local_tops(n: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per portion of a partition: its local tops, and where a group has N items the N-th best score as a bound."""

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows.groupby("grp", sort=False)["score"]
        full = at.transform("size") >= n
        return rows.assign(bound=at.transform("min").where(full))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= FOLD_ROWS:
                tops = _fold(pd.concat(held), n)
                held, size = [tops], len(tops)
                if size >= FOLD_ROWS // 2:  # many groups: pass on what is held, its bounds stay valid
                    yield close(tops)
                    held, size = [], 0
        if held:
            yield close(_fold(pd.concat(held), n))

    return run


def top_items(
    candidates: DataFrame, n: int = 10, *, group: str = "user_id", item: str = "item_id", score: str = "score"
) -> DataFrame:
    """The n best different items of every group: group, item, score, place (from 1).

    Rows with a null group, item or score and rows with a NaN score are left out. An item counts once per group, with its
    highest score; -0.0 equals 0.0. Order is by score descending, then item ascending by code point. A group with fewer
    items gives fewer rows. The result's columns bear the given names of group and item; others are ignored.

    Every partition finds its local tops in Arrow batches. Where it holds n different items of a group, the n-th best score
    bounds the group's true n-th best from below, so the largest bound of a group lets all lower rows be dropped. Local
    tops are written once; bounds, at most one per group and partition, are joined to them by shuffle, where adaptive
    execution splits a hot group. What remains of a group is close to n rows and ties, and is ranked in one window.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = candidates.select(
        F.col(group).cast("string").alias("grp"), F.col(item).cast("string").alias("item"), F.col(score).cast("double").alias("score")
    ).where("grp is not null and item is not null and score is not null and not isnan(score)")
    rows = rows.withColumn("score", F.col("score") + F.lit(0.0))
    local = materialize(rows.mapInPandas(_local_tops(n), _LOCAL), "tops")
    bounds = local.where("bound is not null").groupBy("grp").agg(F.max("bound").alias("least"))
    near = local.drop("bound").join(bounds, "grp", "left").where("least is null or score >= least")
    best = near.groupBy("grp", "item").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "item"))
    return (
        best.withColumn("place", place)
        .where(F.col("place") <= n)
        .select(F.col("grp").alias(group), F.col("item").alias(item), "score", F.col("place").cast("bigint").alias("place"))
    )
