"""Backtesting: time folds, ranking metrics and the choice of a configuration."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellarflow.config import STRATEGIES, ConfigError, check_weights, positive
from cellarflow.functions.times import DAY_US
from cellarflow.runtime import cleaned

METRICS = ("MAP", "NDCG", "Recall", "Precision")


@dataclass(frozen=True)
class Fold:
    start_us: int
    end_us: int


def time_folds(events: DataFrame, n_folds: int, fold_days: int, *, not_after_us: int | None = None) -> list[Fold]:
    """Test windows of fold_days each, oldest first, that end just after the newest event; times t in microseconds.

    The test of a fold holds start <= t < end, its training set t < start. A fold with either empty is passed over.
    not_after_us leaves out events dated later. One aggregation over the events finds which folds are filled.
    """
    rows = events if not_after_us is None else events.where(F.col("t") <= F.lit(not_after_us))
    newest, oldest = rows.agg(F.max("t"), F.min("t")).first()
    if newest is None:
        return []
    end, width = newest + 1, fold_days * DAY_US
    folds = [Fold(end - (i + 1) * width, end - i * width) for i in reversed(range(n_folds))]
    filled = rows.agg(*(F.max((F.col("t") >= f.start_us) & (F.col("t") < f.end_us)).alias(str(i)) for i, f in enumerate(folds))).first()
    return [f for i, f in enumerate(folds) if filled[i] and oldest < f.start_us]


def split(events: DataFrame, fold: Fold) -> tuple[DataFrame, DataFrame]:
    """Training and test events of a fold."""
    t = F.col("t")
    return events.where(t < F.lit(fold.start_us)), events.where((t >= F.lit(fold.start_us)) & (t < F.lit(fold.end_us)))


def user_metrics(recommendations: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per user of the truth: map, ndcg, recall and precision at k; 0 for a user without recommendations.

    map sums the precision at each hit and divides by the user's relevant items; ndcg sums 1 / log2(rank + 1) over hits and
    divides by that of k hits; recall divides hits by relevant items, precision by k.
    """
    wanted = truth.select("user_id", "item_id").distinct()
    relevant = wanted.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    hits = recommendations.where(F.col("rank") <= k).select("user_id", "item_id", "rank").join(wanted, ["user_id", "item_id"], "left_semi")
    so_far = F.row_number().over(Window.partitionBy("user_id").orderBy("rank"))
    per = hits.withColumn("h", so_far).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("hits"), F.sum(F.col("h") / F.col("rank")).alias("ap"), F.sum(F.lit(1.0) / F.log2(F.col("rank") + F.lit(1.0))).alias("dcg")
    )
    ideal = F.lit(1.0) * F.expr(f"aggregate(sequence(1, {int(k)}), cast(0 as double), (a, i) -> a + 1.0d / log2(i + 1.0d))")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return relevant.join(per, "user_id", "left").select(
        "user_id", (zero("ap") / F.col("n")).alias("map"), (zero("dcg") / ideal).alias("ndcg"), (zero("hits") / F.col("n")).alias("recall"), (zero("hits") / F.lit(float(k))).alias("precision"),
    )


def mean_metrics(recommendations: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: the means over users of the truth; nulls if there are none."""
    return user_metrics(recommendations, truth, k).agg(*(F.avg(c).alias(c) for c in ("map", "ndcg", "recall", "precision")))


def metrics_by_candidate(recommendations: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """candidate with its mean map, ndcg, recall and precision over all users of the truth, for rows of many candidates at once.

    Hits of all candidates are found and summed together; a candidate without a hit has no row, which stands for zeros.
    """
    wanted = truth.select("user_id", "item_id").distinct()
    relevant = wanted.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    hits = recommendations.where(F.col("rank") <= k).select("candidate", "user_id", "item_id", "rank").join(wanted, ["user_id", "item_id"], "left_semi")
    so_far = F.row_number().over(Window.partitionBy("candidate", "user_id").orderBy("rank"))
    per = hits.withColumn("h", so_far).groupBy("candidate", "user_id").agg(
        F.count(F.lit(1)).alias("hits"), F.sum(F.col("h") / F.col("rank")).alias("ap"), F.sum(F.lit(1.0) / F.log2(F.col("rank") + F.lit(1.0))).alias("dcg")
    )
    ideal = F.lit(1.0) * F.expr(f"aggregate(sequence(1, {int(k)}), cast(0 as double), (a, i) -> a + 1.0d / log2(i + 1.0d))")
    n_users = relevant.agg(F.count(F.lit(1)).cast("double"))
    sums = per.join(relevant, "user_id").groupBy("candidate").agg(
        F.sum(F.col("ap") / F.col("n")).alias("map"), F.sum(F.col("dcg") / ideal).alias("ndcg"), F.sum(F.col("hits") / F.col("n")).alias("recall"),
        F.sum(F.col("hits") / F.lit(float(k))).alias("precision"),
    )
    return sums.select("candidate", *((F.col(c) / n_users.scalar()).alias(c) for c in ("map", "ndcg", "recall", "precision")))


@dataclass(frozen=True)
class Candidate:
    models: tuple[str, ...]
    weights: tuple[tuple[str, float], ...] | None = None
    rrf_k: float = 60.0

    @property
    def label(self) -> str:
        if self.weights is None:
            return "+".join(self.models)
        inner = ",".join(f"{m}={w:g}" for m, w in self.weights)
        return f"fusion({inner};rrf_k={self.rrf_k:g})" if self.rrf_k != 60.0 else f"fusion({inner})"


def parse_candidates(rows: Sequence[Mapping]) -> list[Candidate]:
    """Candidates from a configuration: each a list of known models, with weights for all of them or for none. At least one."""
    if not rows:
        raise ConfigError("the list of candidates is empty")
    out = []
    for r in rows:
        models = tuple(r.get("models") or ())
        if not models or any(m not in STRATEGIES for m in models):
            raise ConfigError("a candidate needs known models")
        weights = r.get("weights")
        if weights is not None:
            weights = check_weights(weights, STRATEGIES)
            if set(weights) != set(models):
                raise ConfigError("a candidate's weights must name just its models")
            weights = tuple((m, weights[m]) for m in models)
        out.append(Candidate(models, weights, positive("rrf_k", r.get("rrf_k", 60.0))))
    return out


def default_candidates(models: Sequence[str], personalized: Sequence[str]) -> list[Candidate]:
    """Every model alone, all by priority, and one fusion (1 for personalized models, 0.3 for others)."""
    fusion = tuple((m, 1.0 if m in personalized else 0.3) for m in models)
    return [*(Candidate((m,)) for m in models), Candidate(tuple(models)), Candidate(tuple(models), fusion)]


def without_sequential(candidates: Sequence[Candidate], median_items: float | None, least: float = 5.0) -> list[Candidate]:
    """Drops candidates with the sequential model where users have too few items; none left is an error."""
    keep = [c for c in candidates if "sequential" not in c.models or (median_items or 0) >= least]
    if not keep:
        raise ConfigError("no candidate is left")
    return keep


def evaluate(
    folds: Sequence[Fold], candidates: Sequence[Candidate], recommend: Callable[[Candidate, Fold], DataFrame], truth: Callable[[Fold], DataFrame], k: int
) -> list[tuple[Candidate, dict[str, float]]]:
    """The mean over folds of each candidate's metrics. The candidates of a fold are judged by one aggregation; one row per fold
    and candidate reaches the driver."""
    sums = [{f"{name}@{k}": 0.0 for name in METRICS} for _ in candidates]

    for f in folds:
        rows = [recommend(c, f).select("user_id", "item_id", "rank", F.lit(i).alias("candidate")) for i, c in enumerate(candidates)]
        with cleaned(rows[0].sparkSession):
            found = metrics_by_candidate(reduce(DataFrame.unionByName, rows), truth(f), k).collect()
        for r in found:
            for name in METRICS:
                sums[r["candidate"]][f"{name}@{k}"] += float(r[name.lower()])
    return [(c, {name: v / max(1, len(folds)) for name, v in s.items()}) for c, s in zip(candidates, sums, strict=True)]


def select_best(results: Sequence[tuple[Candidate, Mapping[str, float]]], metric: str) -> Candidate:
    """The first candidate with the highest value of the metric, named in full or by what stands before @."""
    if not results:
        raise ConfigError("there are no results")
    names = list(results[0][1])
    found = [n for n in names if n == metric] or [n for n in names if n.split("@")[0] == metric]
    if len(found) != 1:
        raise ConfigError(f"{metric!r} is {'ambiguous' if found else 'unknown'} among {', '.join(names)}")
    return max(enumerate(results), key=lambda x: (x[1][1][found[0]], -x[0]))[1][0]


def trajectory_warning(values: Sequence[float], *, drop: float = 0.25, span: float = 0.01, last: int = 3) -> str | None:
    """What looks wrong in a metric logged per epoch: a fall from the best, or a plateau of the last few values. One value says nothing."""
    if len(values) < 2:
        return None
    best = max(values)
    if best > 0 and best - values[-1] >= drop * best:
        return "fell"
    tail = values[-last:]
    size = max(*map(abs, tail), 1e-9)
    return "plateau" if len(values) >= last and max(tail) - min(tail) <= span * size else None
