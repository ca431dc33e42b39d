"""Ranking, combining and blending of recommendation rows (user_id, item_id, rank, score, source)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarflow.config import Blending, BoostRule
from cellarflow.functions.times import DAY_US
from cellarflow.functions.values import as_number, item_true
from cellarflow.schemas import COLD_START_USER

#: Decimals that a score is rounded to before it orders rows, so that the order of summing cannot change a rank.
SCORE_DECIMALS = 9
PERSONALIZED_LABELS = ("personalized", "item_based", "sequential", "content_fallback")


def top_k(rows: DataFrame, k: int, *, by: Sequence[str] = ("user_id",), order: Sequence[Column] | None = None) -> DataFrame:
    """The first k rows of each group with rank 1..k; by default score descending (rounded), then item ascending."""
    order = order or (F.desc(F.round("score", SCORE_DECIMALS)), F.asc("item_id"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def best_rank(rows: DataFrame) -> DataFrame:
    """One row per (user, item): the lowest rank, then the highest score, then the first source. Null ranks come last."""
    order = Window.partitionBy("user_id", "item_id").orderBy(F.asc_nulls_last("rank"), F.desc_nulls_last("score"), F.asc_nulls_last("source"))
    return rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def combine_priority(frames: Sequence[DataFrame], k: int) -> DataFrame:
    """Fills the k places of a user from the frames in order; an item keeps its earliest frame. Scores stay as they are."""
    tagged = union([f.withColumn("_order", F.lit(i)) for i, f in enumerate(frames)])
    first = Window.partitionBy("user_id", "item_id").orderBy("_order", F.asc_nulls_last("rank"), F.desc_nulls_last("score"), "source")
    once = tagged.withColumn("_place", F.row_number().over(first)).where("_place = 1")
    order = (F.asc("_order"), F.asc_nulls_last("rank"), F.asc("item_id"))
    return top_k(once.drop("_place"), k, order=order).select("user_id", "item_id", "rank", "score", "source")


#: Items up to whose number their factors are sent to every task, 8 bytes each.
SENT_FACTORS = 4_000_000


def _by_priority(widths: int, shared: Sequence[tuple[np.ndarray, np.ndarray] | None], labels: Sequence[str], k: int, factors: Broadcast[np.ndarray] | None, top: int) -> Callable:
    """Rows (user_id, then items and scores of each of widths PACKED lists) to (user_id, item, rank, score, source): lists in the order of
    shared, where None stands for the next PACKED one and the rest are the same for all users."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            count, held = np.zeros(n, np.int64), np.empty(0, np.int64)
            took: list[tuple[np.ndarray, ...]] = []
            column = iter(range(1, 2 * widths, 2))
            for label, same in enumerate(shared):
                lacking = count < k
                if same is None:
                    c = next(column)
                    of_user = batch.column(c)
                    size = np.where(of_user.is_null().to_numpy(zero_copy_only=False), 0, np.diff(of_user.offsets.to_numpy())).astype(np.int64)
                    row = np.repeat(np.arange(n), size)
                    item, score = of_user.flatten().to_numpy(), batch.column(c + 1).flatten().to_numpy()
                    keep = lacking[row]
                    row, item, score = row[keep], item[keep], score[keep]
                else:
                    rows = np.flatnonzero(lacking)
                    row, item, score = np.repeat(rows, len(same[0])), np.tile(same[0], len(rows)), np.tile(same[1], len(rows))
                key = row << 32 | item
                if len(held):
                    fresh = held[np.minimum(np.searchsorted(held, key), len(held) - 1)] != key
                    row, item, score, key = row[fresh], item[fresh], score[fresh], key[fresh]
                keep = count[row] + np.arange(len(row)) - np.searchsorted(row, row) < k
                row, item, score, key = row[keep], item[keep], score[keep], key[keep]
                count += np.bincount(row, minlength=n)
                held = np.sort(np.concatenate([held, key]))
                took.append((row, item, score, np.full(len(row), label)))
            row, item, score, label = map(np.concatenate, zip(*took, strict=True))
            if factors is not None:
                score = score * factors.value[item]
                by = np.lexsort((item, -np.sign(score) * np.floor(np.abs(score) * 10**SCORE_DECIMALS + 0.5), row))
            else:
                by = np.argsort(row, kind="stable")
            row, item, score, label = row[by], item[by], score[by], label[by]
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
            first = rank <= top
            source = pa.array(list(labels), pa.string()).take(pa.array(label[first]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row[first])), pa.array(item[first].astype(np.int32)), pa.array(rank[first].astype(np.int32)), pa.array(score[first]), source],
                names=["user_id", "item", "rank", "score", "source"],
            )

    return run


def combine_packed(
    users: DataFrame, lists: Sequence[tuple[str, DataFrame, bool]], codes: DataFrame, k: int, *, factors: DataFrame | None = None, top: int | None = None
) -> DataFrame:
    """combine_priority, with factors followed by apply_factors to top rows, of lists by item number: (user_id, item, rank, score, source).

    lists are (source, frame, shared): PACKED ones of different users each, or, where shared, one short ranking (item_id, rank, score)
    that all of users have. A user is one row, filled and ranked within a task; only lists are shuffled, and none is written out per
    user. codes numbers all items (item_id, item_id_no); factors (item_id, factor) must have at most SENT_FACTORS numbers.
    """
    spark = users.sparkSession
    same, labels, rows, n = [], [], users.select("user_id").distinct(), 0
    for label, f, shared in lists:
        labels.append(label)
        if shared:
            short = f.join(codes, "item_id").orderBy("rank").select("item_id_no", "score").collect()  # at most k rows
            same.append((np.array([r[0] for r in short], np.int32), np.array([r[1] for r in short], np.float64)))
        else:
            rows = rows.join(f.select("user_id", F.col("items").alias(f"i{n}"), F.col("scores").alias(f"s{n}")), "user_id", "left")
            same.append(None)
            n += 1
    sent = None
    if factors is not None:
        known = factors.join(codes, "item_id").where("factor <> 1").select("item_id_no", F.col("factor")).toArrow()
        table = np.ones((codes.agg(F.max("item_id_no")).first()[0] or 0) + 1)
        table[known.column(0).to_numpy()] = known.column(1).to_numpy()
        sent = spark.sparkContext.broadcast(table)
    return rows.mapInArrow(_by_priority(n, same, labels, k, sent, top or k), "user_id string, item int, rank int, score double, source string")


def combine_fusion(frames: Mapping[str, DataFrame], weights: Mapping[str, float], k: int, rrf_k: float = 60.0) -> DataFrame:
    """Weighted reciprocal rank fusion: sum of weight / (rrf_k + rank) over the named frames.

    A frame without a weight has 1; one of weight 0 still lists its items. source joins the labels of the frames an item
    came from with +, in the order of frames. Rows without a rank have no part.
    """
    parts = [
        f.where("rank is not null").select(
            "user_id", "item_id", (F.lit(float(weights.get(name, 1.0))) / (F.lit(float(rrf_k)) + F.col("rank"))).alias("score"),
            F.struct(F.lit(i).alias("o"), F.col("source").alias("label")).alias("_from"),
        )
        for i, (name, f) in enumerate(frames.items())
    ]
    fused = union(parts).groupBy("user_id", "item_id").agg(F.sum("score").alias("score"), F.sort_array(F.collect_set("_from")).alias("_from"))
    label = F.array_join(F.array_distinct(F.transform("_from", lambda x: x["label"])), "+")
    return top_k(fused.withColumn("source", label), k).select("user_id", "item_id", "rank", "score", "source")


def personal_weight(n: Column, b: Blending) -> Column:
    """The weight of personalized rows for a user of n interactions: 0 for none, else linear or sigmoid."""
    if b.curve == "linear":
        raw = F.least(F.lit(1.0), n / F.lit(b.saturate_at))
    else:
        power = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.lit(-b.steepness) * (n - F.lit(b.midpoint))))
        raw = F.lit(1.0) / (F.lit(1.0) + F.exp(power))
    return F.when(n <= 0, F.lit(0.0)).otherwise(raw)


def blend_weights(counts: DataFrame, b: Blending, *, latest: bool = True) -> DataFrame:
    """user_id with w_personalized, w_popular and w_latest, which sum to 1; without a latest list popular takes its part."""
    p = personal_weight(F.col("n_items").cast("double"), b)
    rest = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("w_personalized"))
    share = b.popular_share if latest else 1.0
    return counts.withColumn("w_personalized", p).select(
        "user_id", "w_personalized", (rest * F.lit(share)).alias("w_popular"), (rest * F.lit(1.0 - share)).alias("w_latest")
    )


def blend(
    personalized: DataFrame, popular: DataFrame, latest: DataFrame | None, counts: DataFrame, b: Blending, k: int, *, targets: DataFrame | None = None
) -> DataFrame:
    """Per-user blend of three lists of (user_id, item_id, rank): each adds its weight for the user / (rrf_k + rank).

    All personalized rows count as one list, by the best rank of an item. Users of targets (default: of counts) without a
    count have 0 interactions. Lists of weight 1e-9 or less are left out. source is the list's label, or blended for
    an item of several.
    """
    wanted = (targets or counts).select("user_id").distinct().join(counts, "user_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    weights = blend_weights(wanted, b, latest=latest is not None)
    one = best_rank(personalized.select("user_id", "item_id", "rank", "score", F.lit("personalized").alias("source")))
    lists = [(one, "personalized", "w_personalized"), (popular, "popular_fallback", "w_popular")]
    lists += [(latest, "latest", "w_latest")] if latest is not None else []
    # lists are told apart by bits, so that the aggregation holds numbers only and stays a hash aggregation
    rows = union([f.select("user_id", "item_id", "rank", F.lit(1 << i).alias("_bit")) for i, (f, _, _) in enumerate(lists)])
    case = lambda values, c: F.coalesce(*(F.when(F.col(c) == 1 << i, v) for i, v in enumerate(values)))
    weight = case([F.col(w) for _, _, w in lists], "_bit")
    scored = (
        rows.where("rank is not null").join(weights, "user_id").withColumn("_weight", weight).where("_weight > 1e-9")
        .withColumn("score", F.col("_weight") / (F.lit(b.rrf_k) + F.col("rank")))
    )
    mixed = scored.groupBy("user_id", "item_id").agg(F.sum("score").alias("score"), F.bit_or("_bit").alias("_bits"))
    labelled = mixed.withColumn("source", F.coalesce(case([F.lit(label) for _, label, _ in lists], "_bits"), F.lit("blended")))
    return top_k(labelled, k).select("user_id", "item_id", "rank", "score", "source")


def for_each_user(users: DataFrame, ranking: DataFrame) -> DataFrame:
    """One short ranking (item_id, rank, score) for every user, as an array from a scalar subquery: no join at all.

    The ranking must be limited beforehand; it has at most k rows in every use here.
    """
    packed = ranking.agg(F.sort_array(F.collect_list(F.struct("rank", "item_id", "score"))).alias("r"))
    return users.select("user_id", F.inline(packed.scalar())).select("user_id", "item_id", "rank", "score")


def latest_by_date(items: DataFrame, date: Column, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """The k newest items by date, then item: item_id, rank, score (count - rank + 1). Items without a date are left out."""
    rows = items.where(F.col("item_id").isNotNull()).withColumn("_date", date).where("_date is not null")
    if allowed is not None:
        rows = rows.join(allowed, "item_id", "left_semi")
    newest = rows.select("item_id", "_date").orderBy(F.desc("_date"), "item_id").limit(k)  # at most k rows from here on
    w = Window.orderBy(F.desc("_date"), "item_id")
    ranked = newest.withColumn("rank", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    return ranked.select("item_id", "rank", (F.col("_n") - F.col("rank") + 1).cast("double").alias("score"))


def usable_date_column(items: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate column with at least one readable date; one aggregation over all of them."""
    from cellarflow.functions.values import as_time

    there = [c for c in candidates if c in items.columns]
    if not there:
        return None
    row = items.agg(*(F.max(as_time(items, c).isNotNull()).alias(c) for c in there)).first()
    return next((c for c in there if row[c]), None)


def with_cold_start(recommendations: DataFrame, popular: DataFrame, latest: DataFrame | None, b: Blending, k: int) -> DataFrame:
    """Replaces the rows of the cold-start user by a blend of the popular and latest rankings (item_id, rank, score)."""
    nobody = popular.sparkSession.createDataFrame([(COLD_START_USER, 0)], "user_id string, n_items long")
    tag = lambda f: f.select(F.lit(COLD_START_USER).alias("user_id"), "item_id", "rank", "score")
    cold = blend(tag(popular).limit(0), tag(popular), tag(latest) if latest is not None else None, nobody, b, k)
    return recommendations.where(F.col("user_id") != COLD_START_USER).unionByName(cold.select(*recommendations.columns))


def boost_factors(items: DataFrame, rules: Sequence[BoostRule]) -> DataFrame:
    """item_id and the product of its factors; columns that are missing are passed over.

    boolean: factor where the flag is true. value_map: the factor of the value. numeric: 1 + weight * (x - min) / (max - min)
    over all items. A null, unknown or unreadable value has factor 1.
    """
    rules = [r for r in rules if r.item_column in items.columns]
    numeric = {r.item_column for r in rules if r.kind == "numeric"}
    bounds = {}
    if numeric:
        row = items.agg(*(f(as_number(items, c)).alias(f"{n}_{c}") for c in numeric for n, f in (("lo", F.min), ("hi", F.max)))).first()
        bounds = {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in numeric}
    total = F.lit(1.0)
    for r in rules:
        c = F.col(r.item_column)
        if r.kind == "boolean":
            factor = F.when(item_true(items, r.item_column), F.lit(float(r.factor))).otherwise(F.lit(1.0))
        elif r.kind == "value_map":
            factor = F.lit(1.0)
            for value, f in r.value_factors.items():
                factor = F.when(F.lower(c.cast("string")) == value.lower() if value in ("True", "False") else c.cast("string") == value, F.lit(float(f))).otherwise(factor)
        else:
            lo, hi = bounds[r.item_column]
            flat = lo is None or lo == hi
            factor = F.lit(1.0) if flat else F.lit(1.0) + F.lit(float(r.weight)) * F.coalesce((as_number(items, r.item_column) - F.lit(lo)) / F.lit(hi - lo), F.lit(0.0))
        total = total * factor
    return items.where(F.col("item_id").isNotNull()).select("item_id", total.alias("factor"))


def apply_factors(recommendations: DataFrame, factors: DataFrame, k: int | None) -> DataFrame:
    """Multiplies scores by the item's factor (1 where it has none) and ranks anew; with k, keeps the first k."""
    scored = recommendations.drop("rank").join(factors, "item_id", "left").withColumn("score", F.col("score") * F.coalesce("factor", F.lit(1.0)))
    return top_k(scored, k or 2_147_483_647).select("user_id", "item_id", "rank", "score", "source")


def days(n: float) -> int:
    return int(n * DAY_US)
