"""The batch run: plan of strategies, their lists, combination, boosts, and the job that reads and writes."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarflow.config import NEEDS_HISTORY, PERSONALIZED, SOURCE_LABELS, STRATEGIES, Blending, BoostRule, ConfigError, FeatureColumn, FeatureConfig, JobSettings
from cellarflow.functions.times import micros
from cellarflow.functions.values import as_time
from cellarflow.operators import evaluate as E
from cellarflow.operators import interactions as I
from cellarflow.operators import ranking as R
from cellarflow.operators import strategies as S
from cellarflow.operators.lookup import item_snapshot
from cellarflow.operators.near_items import PACKED, unpacked
from cellarflow.runtime import materialize
from cellarflow.schemas import nan_to_null, newest_rows
from cellarflow.sources.tables import Store


def run_plan(models: Sequence[str], *, content_fallback: bool, blending: bool) -> list[str]:
    """The strategies to run, in order: content_fallback goes before the first that is not personalized, if it is enabled;
    a blend needs popular and gets its latest list from item dates. No strategy, or an unknown one, is an error."""
    plan = list(dict.fromkeys(models))
    if any(m not in STRATEGIES for m in plan):
        raise ConfigError(f"unknown strategy among {', '.join(plan)}")
    plan = [m for m in plan if m != "content_fallback" or content_fallback]
    if content_fallback and "content_fallback" not in plan:
        at = next((i for i, m in enumerate(plan) if m not in PERSONALIZED), len(plan))
        plan.insert(at, "content_fallback")
    if blending:
        plan = [m for m in plan if m != "latest"] + ([] if "popular" in plan else ["popular"])
    if not plan:
        raise ConfigError("no strategy is left to run")
    return plan


@dataclass
class Dataset:
    """What strategies read. Interactions and features are written once, for every strategy reads them. fitted holds what fit
    learned; a strategy that finds nothing there learns it from the interactions."""

    interactions: DataFrame
    targets: DataFrame
    items: DataFrame | None
    user_features: DataFrame
    item_features: DataFrame
    as_of_us: int
    fitted: dict[str, DataFrame] = field(default_factory=dict)
    _lists: dict[str, DataFrame] = field(default_factory=dict)
    _coded: S.Coded | None = None
    _scored: dict[bool, DataFrame] = field(default_factory=dict)

    @property
    def coded(self) -> S.Coded:
        """The interactions by item number, with numbers for the items of the items table too; numbers that fit left are used again."""
        if self._coded is None:
            if "item_codes" in self.fitted:
                codes = self.fitted["item_codes"]
                x = self.interactions.join(codes, "item_id").select("user_id", F.col("item_id_no").alias("item"), "weight", "last_us")
                self._coded = S.Coded(materialize(x, "coded_interactions"), codes)
            else:
                self._coded = S.coded_items(self.interactions, *([self.items] if self.items is not None else []))
        return self._coded

    def scored(self, strategy: str) -> DataFrame:
        """The target users that a personalized strategy has something to say of: with interactions, or, where it needs no
        history, with a feature."""
        history = strategy in NEEDS_HISTORY
        if history not in self._scored:
            known = self.interactions.select("user_id") if history else I.known_users(self.interactions, self.user_features)
            self._scored[history] = materialize(self.targets.join(known, "user_id", "left_semi"), "scored_users")
        return self._scored[history]


def build_dataset(events: DataFrame, users: DataFrame | None, items: DataFrame | None, config: FeatureConfig, as_of_us: int, half_life_days: float) -> Dataset:
    """Of users and items exported several times the newest row counts (by exported_at, where there is one)."""

    def one(df: DataFrame | None, key: str) -> DataFrame | None:
        if df is None:
            return None
        order = [F.desc_nulls_last(micros(df, "exported_at"))] if "exported_at" in df.columns else []
        return newest_rows(nan_to_null(df), key, [*order, F.xxhash64(*[c for c in df.columns])])

    users, items = one(users, "user_id"), one(items, "item_id")
    none = lambda: events.sparkSession.createDataFrame([], I.FEATURES)
    return Dataset(
        materialize(I.build_interactions(events, config, as_of_us, half_life_days), "interactions"),
        materialize(I.target_users(I.clean_events(events), users), "targets"),
        items,
        I.explode_features(users, "user_id", config.user_features) if users is not None else none(),
        I.explode_features(items, "item_id", config.item_features) if items is not None else none(),
        as_of_us,
    )


#: What fit keeps of each strategy; the others read the interactions or the items, which are kept with it.
_LEARNED: dict[str, Callable[[Dataset, JobSettings], dict[str, DataFrame]]] = {
    "item_based": lambda d, job: {"neighbours": S.near_numbers(d.coded, job.neighbours), "item_codes": d.coded.codes},
    "sequential": lambda d, job: {"transitions": S.move_numbers(d.coded), "item_codes": d.coded.codes},
    "collaborative": lambda d, job: S.fit_collaborative(d.interactions, user_features=d.user_features, item_features=d.item_features),
}


def fit(data: Dataset, models: Sequence[str], job: JobSettings) -> Dataset:
    """Learns and keeps what the strategies need, each once: neighbours, transitions, factors."""
    for name in models:
        if name in _LEARNED and (name not in PERSONALIZED or not data.scored(name).isEmpty()):
            for table, df in _LEARNED[name](data, job).items():
                if table not in data.fitted:
                    data.fitted[table] = df if table == "item_codes" else materialize(df, table)
    return data


def allowed_items(data: Dataset, config: FeatureConfig) -> DataFrame | None:
    """Items that pass the availability flags; None where no flag can be read."""
    flags = [c for c in config.availability if data.items is not None and c in data.items.columns]
    return item_snapshot(data.items, flags).where("is_available").select("item_id") if flags else None


#: Strategies whose lists come by item number, one row per user, and those with one list for all users.
_PACKED, _SHARED = ("item_based", "content_fallback", "sequential"), ("popular", "latest")


def shared_list(name: str, data: Dataset, job: JobSettings, k: int, allowed: DataFrame | None) -> DataFrame:
    """(item_id, rank, score) of a strategy that says the same to everyone."""
    if name not in data._lists:
        x = data.interactions
        rows = S.popular(x, k, allowed) if name == "popular" else S.latest(x, k, window_days=job.latest_days, not_after_us=data.as_of_us, allowed=allowed)
        data._lists[name] = materialize(rows, name)
    return data._lists[name]


def packed_list(name: str, data: Dataset, config: FeatureConfig, job: JobSettings, k: int, allowed: DataFrame | None) -> DataFrame:
    """PACKED lists of a strategy for the users that it knows something of; none where there are no such users."""
    if name not in data._lists:
        users, f = data.scored(name), data.fitted
        if name == "content_fallback" and data.items is None and not users.isEmpty():
            raise ConfigError("content_fallback needs the items table")
        if users.isEmpty():
            rows = data.interactions.sparkSession.createDataFrame([], PACKED)
        elif name == "item_based":
            near = f["neighbours"] if "neighbours" in f else materialize(S.near_numbers(data.coded, job.neighbours), "neighbours")
            rows = S.item_based_lists(data.coded, k, near, users=users, allowed=allowed)
        elif name == "content_fallback":
            rows = S.content_lists(data.coded, data.items, config.item_features, k, max_rows=job.content_rows, users=users, allowed=allowed)
        else:
            rows = S.sequential_lists(data.coded, k, f.get("transitions"), users=users, allowed=allowed)
        data._lists[name] = materialize(rows, name)
    return data._lists[name]


def strategy_list(name: str, data: Dataset, config: FeatureConfig, job: JobSettings, k: int, allowed: DataFrame | None, *, by_number: bool = False) -> DataFrame:
    """(user_id, item_id, rank, score, source) of one strategy; by_number has the item's number for its id. A personalized one
    scores only the users it knows something of, and does nothing where there are none."""
    x, f = data.interactions, data.fitted
    numbered = data.coded.with_numbers if by_number else lambda rows: rows
    if name in _SHARED:
        rows = S.to_users(data.targets, numbered(shared_list(name, data, job, k, allowed)))
    elif name in _PACKED:
        rows = unpacked(packed_list(name, data, config, job, k, allowed))
        rows = rows.withColumnRenamed("item", "item_id") if by_number else data.coded.with_names(rows)
    elif by_number and f"{name} by number" in data._lists:
        rows = data._lists[f"{name} by number"]
    elif not by_number and name in data._lists:
        rows = data._lists[name]
    else:
        users = data.scored(name) if name in PERSONALIZED else data.targets
        if name in PERSONALIZED and users.isEmpty():
            rows = x.sparkSession.createDataFrame([], "user_id string, item_id string, rank int, score double")
        elif name == "collaborative":
            kept = {n: f[n] for n in ("user_factors", "item_factors")} if "item_factors" in f else None
            options = {} if kept else {"user_features": data.user_features, "item_features": data.item_features}
            rows = S.collaborative(x, k, users=users, allowed=allowed, fitted=kept, **options)
        else:
            rows = S.REGISTRY[name](x, k)
        rows = data._lists[f"{name} by number" if by_number else name] = materialize(numbered(rows), name)
    return rows.withColumn("source", F.lit(SOURCE_LABELS.get(name, name)))


def recommend(data: Dataset, config: FeatureConfig, job: JobSettings, *, by_number: bool = False) -> DataFrame:
    """The final rows: strategies by plan, combined by blend, fusion or priority, boosted and cut to top_k. by_number, for runs without
    blend and boosts, has the item's number, which is in the order of ids, for its id."""
    b = config.blending
    plan = run_plan(job.models, content_fallback=job.content_fallback, blending=b.enabled)
    k = job.top_k * config.boost_overfetch if config.boosts else job.top_k
    allowed = allowed_items(data, config)
    if not b.enabled and job.model_weights is None and set(plan) <= {*_PACKED, *_SHARED} and data.coded.codes.count() <= R.SENT_FACTORS:
        packed = [
            (SOURCE_LABELS[m], shared_list(m, data, job, k, allowed) if m in _SHARED else packed_list(m, data, config, job, k, allowed), m in _SHARED) for m in plan
        ]
        factors = R.boost_factors(data.items, config.boosts) if config.boosts and data.items is not None else None
        rows = R.combine_packed(data.targets, packed, data.coded.codes, k, factors=factors, top=job.top_k)
        return rows.withColumnRenamed("item", "item_id") if by_number else data.coded.with_names(rows)
    lists = {m: strategy_list(m, data, config, job, k, allowed, by_number=by_number) for m in plan}
    if b.enabled:
        column = R.usable_date_column(data.items, b.latest_date_columns) if data.items is not None else None
        shared = R.latest_by_date(data.items, as_time(data.items, column), k, allowed) if column else None
        newest = S.to_users(data.targets, shared) if shared is not None else None
        own = [lists[m] for m in plan if m in PERSONALIZED]
        personal = R.union(own) if own else lists["popular"].limit(0)
        rows = R.blend(personal, lists["popular"], newest, I.interaction_counts(data.interactions), b, k, targets=data.targets)
        rows = R.with_cold_start(rows, S.popular(data.interactions, k, allowed), shared, b, k)
    elif job.model_weights is not None:
        if set(job.model_weights) - set(plan):
            raise ConfigError("model_weights name a strategy that does not run")
        rows = R.combine_fusion(lists, job.model_weights, k, job.rrf_k)
    else:
        rows = R.combine_priority(list(lists.values()), k)
    if config.boosts and data.items is not None:
        return R.apply_factors(rows, R.boost_factors(data.items, config.boosts), job.top_k)
    return rows.where(F.col("rank") <= job.top_k)


def backtest(
    events: DataFrame, users: DataFrame | None, items: DataFrame | None, config: FeatureConfig, job: JobSettings, candidates: Sequence[E.Candidate], as_of_us: int
) -> list[tuple[E.Candidate, dict[str, float]]]:
    """The mean metrics of each candidate over the job's folds before as_of. A strategy's list is made once a fold, whatever
    number of candidates share it. Without a filled fold there is nothing to judge by, which raises."""
    clean = materialize(I.clean_events(events), "events")
    folds = E.time_folds(clean, job.folds, job.fold_days, not_after_us=as_of_us)
    if not folds:
        raise ConfigError("no fold has events on both sides")
    raw = clean.withColumn("occurred_at", F.timestamp_micros("t"))
    parts = {f: E.split(raw, f) for f in folds}
    by_number = not config.boosts and not config.blending.enabled  # names are not needed to judge by
    codes = S.item_codes(clean, *([items] if items is not None else []))  # the same for all folds

    def prepared(f: E.Fold) -> tuple[Dataset, DataFrame]:
        """All learn from everyone, but only users of the truth are judged, so only they get lists."""
        one = build_dataset(parts[f][0], users, items, config, f.start_us, job.half_life_days)
        truth = I.build_interactions(parts[f][1], config, f.end_us, job.half_life_days)
        truth = materialize(S.Coded(truth, codes).with_numbers(truth) if by_number else truth, "truth")
        one.targets = materialize(one.targets.join(truth.select("user_id"), "user_id", "left_semi"), "judged")
        one.fitted["item_codes"] = codes
        return one, truth

    ready = {f: prepared(f) for f in folds}

    def rows(c: E.Candidate, f: E.Fold) -> DataFrame:
        return recommend(ready[f][0], config, with_candidate(job, c), by_number=by_number)

    return E.evaluate(folds, candidates, rows, lambda f: ready[f][1], job.top_k)


def with_candidate(job: JobSettings, c: E.Candidate) -> JobSettings:
    return replace(job, models=c.models, content_fallback="content_fallback" in c.models, model_weights=dict(c.weights) if c.weights else None, rrf_k=c.rrf_k)


def choose(
    events: DataFrame, users: DataFrame | None, items: DataFrame | None, config: FeatureConfig, job: JobSettings, as_of_us: int
) -> tuple[JobSettings, dict]:
    """The job with the models, weights and rrf_k of the best candidate, and what the manifest says of the choice."""
    candidates = E.parse_candidates(job.candidates) if job.candidates is not None else E.default_candidates([m for m in STRATEGIES if m != "content_fallback" or items is not None], PERSONALIZED)
    median = I.median_items_per_user(I.clean_events(events)).first()[0]
    candidates = E.without_sequential(candidates, median, job.sequential_least)
    results = backtest(events, users, items, config, job, candidates, as_of_us)
    best = E.select_best(results, job.primary_metric)
    return with_candidate(job, best), {"selected": best.label, "metric": job.primary_metric, "folds": job.folds, "results": {c.label: m for c, m in results}}


def save_artifact(store: Store, data: Dataset, config: FeatureConfig, job: JobSettings) -> None:
    """Everything that recommending anew needs, as tables and settings: recommend over read_artifact gives the same rows."""
    tables = {"interactions": data.interactions, "targets": data.targets, "user_features": data.user_features, "item_features": data.item_features} | data.fitted
    if data.items is not None:
        tables["items"] = data.items
    store.write_artifact(tables, {"job": asdict(job), "features": asdict(config), "as_of_us": data.as_of_us, "fitted": list(data.fitted)})


def load_artifact(store: Store) -> tuple[Dataset, FeatureConfig, JobSettings]:
    meta, t = store.read_artifact()
    f = meta["features"]
    config = FeatureConfig(
        **f | {
            "user_features": tuple(FeatureColumn(**x) for x in f["user_features"]), "item_features": tuple(FeatureColumn(**x) for x in f["item_features"]),
            "boosts": tuple(BoostRule(**x) for x in f["boosts"]), "blending": Blending(**f["blending"] | {"latest_date_columns": tuple(f["blending"]["latest_date_columns"])}),
            "quantity_scaled": tuple(f["quantity_scaled"]), "availability": tuple(f["availability"]),
        }
    )
    job = meta["job"] | {"models": tuple(meta["job"]["models"]), "epochs": tuple(meta["job"]["epochs"])}
    data = Dataset(t["interactions"], t["targets"], t.get("items"), t["user_features"], t["item_features"], meta["as_of_us"], {n: t[n] for n in meta["fitted"]})
    return data, config, JobSettings(**job)


def run_job(spark: SparkSession, store: Store, config: FeatureConfig, job: JobSettings, *, as_of: datetime | None = None) -> Mapping:
    """Reads the store, chooses the plan where the job asks for that, recommends, writes snapshot, recommendations and artifact,
    and always one manifest."""
    as_of = as_of or datetime.now(UTC)
    as_of_us = int(as_of.timestamp() * 1_000_000)
    manifest: dict = {"generated_at": datetime.now(UTC).isoformat(), "status": "failed", "error": None, "mode": "full", "models": list(job.models), "top_k": job.top_k, "half_life_days": job.half_life_days, "partial_outputs": []}
    try:
        events, users, items = store.read_input()
        if job.automl:
            job, manifest["automl"] = choose(events, users, items, config, job, as_of_us)
            manifest["models"] = list(job.models)
        plan = run_plan(job.models, content_fallback=job.content_fallback, blending=config.blending.enabled)
        data = fit(build_dataset(events, users, items, config, as_of_us, job.half_life_days), plan, job)
        if job.epochs and "collaborative" in plan:
            history = S.collaborative_epochs(data.interactions, job.top_k, job.epochs, user_features=data.user_features, item_features=data.item_features)
            names = list(history[0][1])
            manifest["epochs"] = {"values": history, "warnings": {n: E.trajectory_warning([m[n] for _, m in history]) for n in names}}
        rows = recommend(data, config, job)
        save_artifact(store, data, config, job)
        manifest["partial_outputs"].append("artifact")
        if data.items is not None:
            store.write_snapshot(data.items)
            manifest["partial_outputs"].append("items")
        n = store.write_recommendations(rows).count()
        manifest |= {"status": "ok", "n_rows": n, "n_users": store.count_users(), "partial_outputs": []}
    except Exception as e:
        manifest["error"] = f"{type(e).__name__}: {e}"[:500]
        raise
    finally:
        store.write_manifest(json.loads(json.dumps(manifest, default=str)))
    return manifest
