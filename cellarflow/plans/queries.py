"""One query per operator over the shop's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarflow.config import PERSONALIZED, SHOP, Blending, BoostRule, JobSettings
from cellarflow.functions.strings import duckdb_strip
from cellarflow.functions.times import DAY_US
from cellarflow.functions.values import as_time
from cellarflow.operators import evaluate as E
from cellarflow.operators import interactions as I
from cellarflow.operators import lookup as L
from cellarflow.operators import ranking as R
from cellarflow.operators import strategies as S
from cellarflow.plans import pipeline
from cellarflow.runtime import fresh_path, materialize
from cellarflow.schemas import nan_to_null, newest_rows
from cellarflow.sources import tables as T
from cellarflow.streaming import intake as N

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF_US = 1_775_001_600_000_000  # 2026-04-01 00:00 UTC
HALF_LIFE = 90.0
K = 10
SIGMOID, LINEAR = Blending(enabled=True), Blending(enabled=True, curve="linear")
BOOSTS = (
    BoostRule("listed", "published", "boolean", factor=1.3),
    BoostRule("strength", "abv_bucket", "value_map", value_factors={"none": 0.7, "low": 1.25, "high": 0.9}),
    BoostRule("earnings", "margin", "numeric", weight=0.4),
)
CURSOR = (1_773_000_000_000_000, "5")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None = None, *, stored_ranks: bool = False) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with its SQL if there is any.

    Places that a window counts come out as bigint, as they do in SQL; stored_ranks leaves the tables' own ranks as they are.
    """

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            counted = [] if stored_ranks else [c for c, kind in df.dtypes if c in ("rank", "place") and kind == "int"]
            return df.withColumns({c: F.col(c).cast("bigint") for c in counted}) if counted else df

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return run

    return add


# ---- shared inputs -------------------------------------------------------------------------------------------------


def events(spark: SparkSession, d: str) -> DataFrame:
    return I.clean_events(read(spark, d, "shop_events"))


def interactions(spark: SparkSession, d: str) -> DataFrame:
    return I.build_interactions(read(spark, d, "shop_events"), SHOP, AS_OF_US, HALF_LIFE)


def newest(df: DataFrame, key: str) -> DataFrame:
    return newest_rows(nan_to_null(df), key, [F.desc_nulls_last("exported_at")])


def items(spark: SparkSession, d: str) -> DataFrame:
    return newest(read(spark, d, "shop_items"), "item_id")


def users(spark: SparkSession, d: str) -> DataFrame:
    return newest(read(spark, d, "shop_users"), "user_id")


def stored(spark: SparkSession, d: str) -> DataFrame:
    return nan_to_null(read(spark, d, "recommendations"))


def strategy_rows(spark: SparkSession, d: str, *sources: str) -> DataFrame:
    """A strategy's list taken from the stored candidates: ranked by score, one row per item."""
    rows = stored(spark, d).where(F.col("source").isin(*sources) & F.col("score").isNotNull())
    once = rows.groupBy("user_id", "item_id").agg(F.max("score").alias("score"))
    return R.top_k(once, 30).withColumn("source", F.lit(sources[0]))


_EV = f"""ev AS (
  SELECT {duckdb_strip("user_id")} AS user_id, {duckdb_strip("item_id")} AS item_id, event_type,
         greatest(coalesce(CAST(quantity AS DOUBLE), 1), 1) AS quantity, epoch_us(occurred_at) AS t, event_id
  FROM shop_events WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND occurred_at IS NOT NULL)"""
_BASE = "CASE event_type WHEN 'purchase' THEN 4.0e0 WHEN 'review_positive' THEN 5.0e0 WHEN 'review_negative' THEN -3.0e0 WHEN 'saved' THEN 2.0e0 WHEN 'cart_add' THEN 1.0e0 WHEN 'view' THEN 0.3e0 END"
_QTY = "CASE WHEN event_type = 'purchase' THEN ln(1 + quantity) ELSE 1.0e0 END"
_DECAY = f"pow(0.5e0, CAST(greatest({AS_OF_US} - t, 0) AS DOUBLE) / {DAY_US}.0e0 / {HALF_LIFE}e0)"
_CAPPED = f"""{_EV}, known AS (SELECT *, {_BASE} AS base FROM ev WHERE {_BASE} IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id, event_type ORDER BY t DESC, event_id, quantity DESC) AS place FROM known),
capped AS (SELECT * FROM placed WHERE event_type <> 'view' OR place <= 5)"""
_INTER = f"""{_CAPPED}, inter AS (
  SELECT user_id, item_id, sum(base * {_QTY} * {_DECAY}) AS weight, max(t) AS last_us FROM capped GROUP BY 1, 2 HAVING sum(base * {_QTY} * {_DECAY}) > 0)"""
_ITEMS = "it AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY exported_at DESC NULLS LAST) AS place FROM shop_items WHERE item_id IS NOT NULL) WHERE place = 1)"
_USERS = "us AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY exported_at DESC NULLS LAST) AS place FROM shop_users WHERE user_id IS NOT NULL) WHERE place = 1)"
_STORED = "stored AS (SELECT user_id, item_id, rank, CASE WHEN NOT isnan(score) THEN score END AS score, source FROM recommendations)"


def _list_sql(name: str, *sources: str) -> str:
    inside = ", ".join(f"'{s}'" for s in sources)
    return f"""{name} AS (SELECT user_id, item_id, score, rank, '{sources[0]}' AS source FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank
  FROM (SELECT user_id, item_id, max(score) AS score FROM stored WHERE source IN ({inside}) AND score IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 30)"""


# ---- scans and weighting -------------------------------------------------------------------------------------------


@query("SELECT user_id, item_id, event_type, epoch_us(occurred_at) AS t FROM shop_events WHERE event_type = 'purchase' AND channel = 'web'")
def scan_pushdown(spark, d):
    where = (F.col("event_type") == "purchase") & (F.col("channel") == "web")
    return T.read_parquet(spark, f"{d}/shop_events.parquet", where=where).select("user_id", "item_id", "event_type", F.unix_micros("occurred_at").alias("t"))


@query(f"WITH {_EV} SELECT event_type, count(*) AS n, CAST(sum(quantity) AS DOUBLE) AS total FROM ev GROUP BY event_type")
def quantities_by_type(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("total"))


@query(f"WITH {_EV} SELECT event_type, count(*) AS n FROM ev WHERE {_BASE} IS NULL GROUP BY event_type")
def unknown_types(spark, d):
    return events(spark, d).where(I.base_weight(SHOP).isNull()).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_EV} SELECT event_id, quantity, round({_QTY}, 9) AS factor, count(*) AS n FROM ev WHERE event_type = 'purchase' GROUP BY ALL")
def quantity_scaled(spark, d):
    rows = events(spark, d).where("event_type = 'purchase'")
    return rows.groupBy("event_id", "quantity", F.round(I.quantity_factor(SHOP), 9).alias("factor")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_EV} SELECT event_id, t, round({_DECAY}, 9) AS decay, count(*) AS n FROM ev GROUP BY ALL")
def time_decay(spark, d):
    return events(spark, d).groupBy("event_id", "t", F.round(I.decay(F.col("t"), AS_OF_US, HALF_LIFE), 9).alias("decay")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CAPPED} SELECT user_id, item_id, event_type, count(*) AS n, min(t) AS first_us FROM capped GROUP BY 1, 2, 3")
def events_capped(spark, d):
    known = events(spark, d).where(I.base_weight(SHOP).isNotNull())
    return I.cap_events(known, SHOP).groupBy("user_id", "item_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_us"))


@query(f"WITH {_INTER} SELECT user_id, item_id, round(weight, 6) AS weight, last_us FROM inter")
def interactions_weighted(spark, d):
    return interactions(spark, d).select("user_id", "item_id", F.round("weight", 6).alias("weight"), "last_us")


_USER_FEATURES = f"""{_USERS}, uf AS (
  SELECT user_id AS id, 'favorite_styles' AS feature, s AS value FROM us, unnest(favorite_styles) AS x(s) WHERE s IS NOT NULL
  UNION ALL SELECT user_id, 'region_slug', region_slug FROM us WHERE region_slug IS NOT NULL)"""
_ITEM_FEATURES = f"{_ITEMS}, itf AS (" + " UNION ALL ".join(f"SELECT item_id AS id, '{c.column}' AS feature, {c.column} AS value FROM it WHERE {c.column} IS NOT NULL" for c in SHOP.item_features) + ")"


@query(f"WITH {_USER_FEATURES} SELECT * FROM uf")
def user_features(spark, d):
    return I.explode_features(users(spark, d), "user_id", SHOP.user_features)


@query(f"WITH {_ITEM_FEATURES} SELECT * FROM itf")
def item_features(spark, d):
    return I.explode_features(items(spark, d), "item_id", SHOP.item_features)


_TARGETS = "targets AS (SELECT user_id FROM ev UNION SELECT user_id FROM shop_users WHERE user_id IS NOT NULL)"


@query(f"WITH {_EV}, {_TARGETS} SELECT * FROM targets")
def target_users(spark, d):
    return I.target_users(events(spark, d), read(spark, d, "shop_users"))


@query(f"WITH {_INTER}, {_TARGETS}, {_USER_FEATURES}, known_users AS (SELECT user_id FROM inter UNION SELECT id FROM uf) SELECT user_id, user_id IN (SELECT user_id FROM known_users) AS is_warm FROM targets")
def warm_and_cold_users(spark, d):
    targets = I.target_users(events(spark, d), read(spark, d, "shop_users"))
    return I.warm_or_cold(targets, I.known_users(interactions(spark, d), user_features(spark, d)))


@query(f"WITH {_INTER}, {_ITEM_FEATURES} SELECT item_id FROM inter UNION SELECT id FROM itf")
def item_catalog(spark, d):
    return I.catalog(interactions(spark, d), item_features(spark, d))


@query(f"WITH {_INTER} SELECT user_id, count(*) AS n_items FROM inter GROUP BY user_id")
def interaction_counts(spark, d):
    return I.interaction_counts(interactions(spark, d))


@query(f"WITH {_EV} SELECT CAST(median(n) AS DOUBLE) AS median_items FROM (SELECT user_id, count(DISTINCT item_id) AS n FROM ev GROUP BY user_id)")
def median_items_per_user(spark, d):
    return I.median_items_per_user(events(spark, d))


# ---- strategies ----------------------------------------------------------------------------------------------------

_POPULAR = f"popular AS (SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM (SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM inter GROUP BY item_id) ORDER BY rank LIMIT {K})"
_RECENT = f"recent AS (SELECT * FROM inter WHERE last_us <= {AS_OF_US} AND last_us >= (SELECT max(last_us) FROM inter WHERE last_us <= {AS_OF_US}) - 14 * {DAY_US})"


@query(f"WITH {_INTER}, {_POPULAR} SELECT * FROM popular")
def popular_items(spark, d):
    return S.popular(interactions(spark, d), K)


@query(f"WITH {_INTER}, {_POPULAR}, {_TARGETS} SELECT user_id, item_id, rank, score FROM targets, popular")
def popular_for_users(spark, d):
    return S.to_users(target_users(spark, d), S.popular(interactions(spark, d), K))


@query(f"WITH {_INTER}, {_RECENT}, {_POPULAR.replace('FROM inter', 'FROM recent')} SELECT * FROM popular")
def latest_items(spark, d):
    return S.latest(interactions(spark, d), K, not_after_us=AS_OF_US)


_NEAR = """per_user AS (SELECT user_id, count(*) AS n FROM inter GROUP BY 1),
raw AS (SELECT user_id, item_id, weight, sqrt(weight) * (ln((SELECT CAST(count(DISTINCT item_id) AS DOUBLE) FROM inter)) - ln(1 + n)) AS v FROM inter JOIN per_user USING (user_id)),
norms AS (SELECT item_id, sqrt(sum(v * v)) AS norm FROM raw GROUP BY 1),
vec AS (SELECT user_id, item_id, v / norm AS v FROM raw JOIN norms USING (item_id) WHERE norm > 0),
pairs AS (SELECT a.item_id, b.item_id AS other_id, sum(a.v * b.v) AS similarity FROM vec a JOIN vec b USING (user_id) GROUP BY 1, 2),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(similarity, 9) DESC, other_id) AS place FROM pairs) WHERE place <= 20)"""
_KNN = f"{_INTER}, {_NEAR}"


@query(f"WITH {_KNN} SELECT item_id, other_id, round(similarity, 6) AS similarity, place FROM near")
def item_neighbours(spark, d):
    return S.item_neighbours(interactions(spark, d)).select("item_id", "other_id", F.round("similarity", 6).alias("similarity"), "place")


@query(f"""WITH {_KNN}, scored AS (
  SELECT i.user_id, n.other_id AS item_id, sum(i.weight * n.similarity) AS score FROM inter i JOIN near n ON n.item_id = i.item_id GROUP BY 1, 2 HAVING sum(i.weight * n.similarity) > 0),
fresh AS (SELECT s.* FROM scored s ANTI JOIN inter i ON i.user_id = s.user_id AND i.item_id = s.item_id)
SELECT user_id, item_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM fresh) WHERE rank <= {K}""")
def item_based(spark, d):
    return S.item_based(materialize(interactions(spark, d), "interactions"), K).withColumn("score", F.round("score", 6))


_TOK = "tok AS (SELECT DISTINCT id AS item_id, feature || '=' || value AS token FROM itf), sizes AS (SELECT item_id, count(*) AS n FROM tok GROUP BY 1)"
_TOKENS = f"{_ITEM_FEATURES}, {_TOK}"


@query(f"WITH {_TOKENS} SELECT item_id, n FROM sizes")
def item_token_counts(spark, d):
    return S.item_tokens(items(spark, d), SHOP.item_features).select("item_id", F.size("tokens").cast("bigint").alias("n"))


_CONTENT = """hist AS (SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_us DESC, item_id) AS place FROM inter) WHERE place <= 50),
cold AS (SELECT * FROM tok WHERE item_id NOT IN (SELECT item_id FROM inter) AND item_id IN (SELECT item_id FROM al)),
sets AS (SELECT item_id, list(token ORDER BY token) AS s FROM tok GROUP BY 1),
warm_sets AS (SELECT DISTINCT s FROM sets WHERE item_id IN (SELECT item_id FROM hist)),
cos AS (SELECT w.s, c.item_id, round(len(list_intersect(w.s, c.s)) / sqrt(CAST(len(w.s) * len(c.s) AS DOUBLE)), 12) AS score
        FROM warm_sets w, (SELECT * FROM sets WHERE item_id IN (SELECT item_id FROM cold)) c WHERE list_has_any(w.s, c.s)),
user_sets AS (SELECT DISTINCT h.user_id, s.s FROM hist h JOIN sets s USING (item_id)),
best AS (SELECT user_id, item_id, max(score) AS score FROM user_sets JOIN cos USING (s) GROUP BY 1, 2)"""


@query(f"""WITH {_INTER}, {_TOKENS}, al AS (SELECT item_id FROM tok), {_CONTENT}
SELECT user_id, item_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM best) WHERE rank <= {K}""")
def content_fallback(spark, d):
    rows = S.content_fallback(materialize(interactions(spark, d), "interactions"), items(spark, d), SHOP.item_features, K)
    return rows.withColumn("score", F.round("score", 6))


_STEPS = "steps AS (SELECT lag(item_id) OVER (PARTITION BY user_id ORDER BY last_us, item_id) AS from_id, item_id AS to_id FROM inter), moves AS (SELECT from_id, to_id, count(*) AS n FROM steps WHERE from_id IS NOT NULL GROUP BY 1, 2)"
_MOVES = f"{_INTER}, {_STEPS}"


@query(f"WITH {_MOVES} SELECT * FROM moves")
def transitions(spark, d):
    return S.transitions(interactions(spark, d))


@query(f"""WITH {_MOVES}, odds AS (SELECT * FROM (SELECT from_id, to_id, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY from_id) AS p, row_number() OVER (PARTITION BY from_id ORDER BY n DESC, to_id) AS place FROM moves) WHERE place <= 50),
ends AS (SELECT user_id, item_id AS from_id, pow(0.5e0, place - 1) AS f FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_us DESC, item_id DESC) AS place FROM inter) WHERE place <= 3),
scored AS (SELECT user_id, to_id AS item_id, sum(f * p) AS score FROM ends JOIN odds USING (from_id) GROUP BY 1, 2),
fresh AS (SELECT s.* FROM scored s ANTI JOIN inter i ON i.user_id = s.user_id AND i.item_id = s.item_id)
SELECT user_id, item_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM fresh) WHERE rank <= {K}""")
def sequential(spark, d):
    """Only the 50 most frequent next items of an item, as this query's SQL has it; sequential_whole has all of them."""
    return S.sequential(materialize(interactions(spark, d), "interactions"), K, fan_out=50).withColumn("score", F.round("score", 6))


@query(f"""WITH {_MOVES}, odds AS (SELECT from_id, to_id, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY from_id) AS p FROM moves),
ends AS (SELECT user_id, item_id AS from_id, pow(0.5e0, place - 1) AS f FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_us DESC, item_id DESC) AS place FROM inter) WHERE place <= 3),
scored AS (SELECT user_id, to_id AS item_id, sum(f * p) AS score FROM ends JOIN odds USING (from_id) GROUP BY 1, 2),
fresh AS (SELECT s.* FROM scored s ANTI JOIN inter i ON i.user_id = s.user_id AND i.item_id = s.item_id)
SELECT user_id, item_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM fresh) WHERE rank <= {K}""")
def sequential_whole(spark, d):
    return S.sequential(materialize(interactions(spark, d), "interactions"), K).withColumn("score", F.round("score", 6))


@query()
def collaborative(spark, d):
    return S.collaborative(materialize(interactions(spark, d), "interactions"), K, user_features=user_features(spark, d), item_features=item_features(spark, d))


# ---- combining, blending, boosting ---------------------------------------------------------------------------------

_A, _B, _C = _list_sql("a", "collaborative"), _list_sql("b", "item_based"), _list_sql("c", "popular")


@query(f"""WITH {_STORED}, {_A}, {_B}, {_C},
tagged AS (SELECT *, 0 AS o FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY o, rank) AS first FROM tagged) WHERE first = 1)
SELECT user_id, item_id, place AS rank, score, source FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o, rank, item_id) AS place FROM once) WHERE place <= {K}""")
def combine_priority(spark, d):
    return R.combine_priority([strategy_rows(spark, d, s) for s in ("collaborative", "item_based", "popular")], K)


@query(f"""WITH {_STORED}, {_A}, {_B}, {_C},
parts AS (SELECT user_id, item_id, 1.0e0 / (60.0e0 + rank) AS x, 0 AS o, source FROM a UNION ALL SELECT user_id, item_id, 0.5e0 / (60.0e0 + rank), 1, source FROM b
  UNION ALL SELECT user_id, item_id, 0.3e0 / (60.0e0 + rank), 2, source FROM c),
fused AS (SELECT user_id, item_id, sum(x) AS score, string_agg(source, '+' ORDER BY o) AS source FROM parts GROUP BY 1, 2)
SELECT user_id, item_id, rank, round(score, 9) AS score, source FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM fused) WHERE rank <= {K}""")
def combine_fusion(spark, d):
    frames = {s: strategy_rows(spark, d, s) for s in ("collaborative", "item_based", "popular")}
    return R.combine_fusion(frames, {"collaborative": 1.0, "item_based": 0.5, "popular": 0.3}, K).withColumn("score", F.round("score", 9))


def _weights_sql(p: str) -> str:
    return f"""counts AS (SELECT user_id, count(*) AS n FROM inter GROUP BY 1),
w AS (SELECT user_id, p AS w_personalized, (1 - p) * 0.7e0 AS w_popular, (1 - p) * (1 - 0.7e0) AS w_latest FROM (SELECT user_id, {p} AS p FROM counts))"""


_SIGMOID_SQL = "1 / (1 + exp(greatest(-50.0e0, least(50.0e0, -1.0e0 * (n - 5.0e0)))))"
_ROUNDED = "SELECT user_id, round(w_personalized, 9) AS w_personalized, round(w_popular, 9) AS w_popular, round(w_latest, 9) AS w_latest FROM w"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("user_id", *(F.round(c, 9).alias(c) for c in ("w_personalized", "w_popular", "w_latest")))


@query(f"WITH {_INTER}, {_weights_sql(_SIGMOID_SQL)} {_ROUNDED}")
def blend_weights_sigmoid(spark, d):
    return _rounded(R.blend_weights(interaction_counts(spark, d), SIGMOID))


@query(f"WITH {_INTER}, {_weights_sql('least(1.0e0, n / 10.0e0)')} {_ROUNDED}")
def blend_weights_linear(spark, d):
    return _rounded(R.blend_weights(interaction_counts(spark, d), LINEAR))


@query(f"WITH {_STORED} SELECT user_id, item_id, rank, score, source FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY rank NULLS LAST, score DESC NULLS LAST, source) AS place FROM stored) WHERE place = 1", stored_ranks=True)
def best_rank(spark, d):
    return R.best_rank(stored(spark, d)).select("user_id", "item_id", "rank", "score", "source")


_BY_DATE = f"by_date AS (SELECT item_id, rank, CAST(count(*) OVER () - rank + 1 AS DOUBLE) AS score FROM (SELECT item_id, row_number() OVER (ORDER BY published_at DESC, item_id) AS rank FROM it WHERE published_at IS NOT NULL ORDER BY rank LIMIT {K}))"


@query(f"WITH {_ITEMS}, {_BY_DATE} SELECT * FROM by_date")
def latest_by_date(spark, d):
    it = items(spark, d)
    return R.latest_by_date(it, as_time(it, "published_at"), K)


_PERSONAL = "personal AS (SELECT user_id, item_id, min(rank) AS rank FROM (SELECT user_id, item_id, rank FROM a UNION ALL SELECT user_id, item_id, rank FROM b) GROUP BY 1, 2)"
_BLEND = f"""targets AS (SELECT DISTINCT user_id FROM stored), wt AS (
  SELECT t.user_id, coalesce(CASE WHEN n > 0 THEN {_SIGMOID_SQL} END, 0) AS p FROM targets t LEFT JOIN (SELECT user_id, count(*) AS n FROM inter GROUP BY 1) USING (user_id)),
rows_ AS (SELECT user_id, item_id, rank, 'personalized' AS source FROM personal UNION ALL SELECT user_id, item_id, rank, 'popular_fallback' FROM c
  UNION ALL SELECT user_id, item_id, rank, 'latest' FROM targets, by_date),
weighed AS (SELECT r.*, CASE source WHEN 'personalized' THEN p WHEN 'popular_fallback' THEN (1 - p) * 0.7e0 ELSE (1 - p) * (1 - 0.7e0) END AS w FROM rows_ r JOIN wt USING (user_id)),
mixed AS (SELECT user_id, item_id, sum(w / (60.0e0 + rank)) AS score, CASE WHEN count(DISTINCT source) > 1 THEN 'blended' ELSE min(source) END AS source FROM weighed WHERE w > 1e-9 GROUP BY 1, 2)
SELECT user_id, item_id, rank, round(score, 9) AS score, source FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM mixed) WHERE rank <= {K}"""


@query(f"WITH {_INTER}, {_STORED}, {_ITEMS}, {_A}, {_B}, {_C}, {_PERSONAL}, {_BY_DATE}, {_BLEND}")
def blend(spark, d):
    targets = stored(spark, d).select("user_id").distinct()
    newest_list = S.to_users(targets, latest_by_date(spark, d))
    personal = R.union([strategy_rows(spark, d, "collaborative"), strategy_rows(spark, d, "item_based")])
    rows = R.blend(personal, strategy_rows(spark, d, "popular"), newest_list, interaction_counts(spark, d), SIGMOID, K, targets=targets)
    return rows.withColumn("score", F.round("score", 9))


@query(f"""WITH {_INTER}, {_POPULAR}, {_ITEMS}, {_BY_DATE},
rows_ AS (SELECT item_id, 0.7e0 / (60.0e0 + rank) AS x, 'popular_fallback' AS source FROM popular UNION ALL SELECT item_id, (1 - 0.7e0) / (60.0e0 + rank), 'latest' FROM by_date),
mixed AS (SELECT item_id, sum(x) AS score, CASE WHEN count(*) > 1 THEN 'blended' ELSE min(source) END AS source FROM rows_ GROUP BY 1)
SELECT '__cold_start__' AS user_id, item_id, rank, round(score, 9) AS score, source FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, item_id) AS rank FROM mixed) WHERE rank <= {K}""")
def cold_start_rows(spark, d):
    before = stored(spark, d).where("user_id = '__cold_start__'").select("user_id", "item_id", "rank", "score", "source")
    rows = R.with_cold_start(before, popular_items(spark, d), latest_by_date(spark, d), SIGMOID, K)
    return rows.withColumn("score", F.round("score", 9))


_MARGIN = "CASE WHEN NOT isnan(margin) THEN margin END"
_FACTOR_PARTS = f"""bounds AS (SELECT min({_MARGIN}) AS lo, max({_MARGIN}) AS hi FROM it),
factors AS (SELECT item_id, (CASE WHEN published THEN 1.3e0 ELSE 1.0e0 END) * (CASE abv_bucket WHEN 'none' THEN 0.7e0 WHEN 'low' THEN 1.25e0 WHEN 'high' THEN 0.9e0 ELSE 1.0e0 END)
  * (1 + 0.4e0 * coalesce(({_MARGIN} - lo) / (hi - lo), 0)) AS factor FROM it, bounds)"""
_FACTORS = f"{_ITEMS}, {_FACTOR_PARTS}"


@query(f"WITH {_FACTORS} SELECT item_id, round(factor, 9) AS factor FROM factors")
def boost_factors(spark, d):
    return R.boost_factors(items(spark, d), BOOSTS).select("item_id", F.round("factor", 9).alias("factor"))


@query(f"""WITH {_STORED}, {_FACTORS}, {_A}, scored AS (SELECT user_id, item_id, score * coalesce(factor, 1) AS score, source FROM a LEFT JOIN factors USING (item_id))
SELECT user_id, item_id, rank, round(score, 9) AS score, source FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM scored) WHERE rank <= {K}""")
def boosted_ranks(spark, d):
    rows = R.apply_factors(strategy_rows(spark, d, "collaborative"), R.boost_factors(items(spark, d), BOOSTS), K)
    return rows.withColumn("score", F.round("score", 9))


# ---- evaluation ----------------------------------------------------------------------------------------------------

_FOLD_END = f"(SELECT max(t) + 1 FROM ev WHERE t <= {AS_OF_US})"


@query(f"""WITH {_EV}, folds AS (SELECT i, {_FOLD_END} - (i + 1) * 7 * {DAY_US} AS start_us, {_FOLD_END} - i * 7 * {DAY_US} AS end_us FROM range(3) AS r(i))
SELECT CAST(start_us AS BIGINT) AS start_us, CAST(end_us AS BIGINT) AS end_us, (SELECT count(*) FROM ev WHERE t < start_us) AS n_train, (SELECT count(*) FROM ev WHERE t >= start_us AND t < end_us) AS n_test FROM folds""")
def time_folds(spark, d):
    ev = events(spark, d)
    folds = E.time_folds(ev, 3, 7, not_after_us=AS_OF_US)
    t = F.col("t")
    counts = [F.struct(F.lit(f.start_us).alias("start_us"), F.lit(f.end_us).alias("end_us"), F.count_if(t < f.start_us).alias("n_train"), F.count_if((t >= f.start_us) & (t < f.end_us)).alias("n_test")) for f in folds]
    return ev.agg(F.array(*counts).alias("folds")).select(F.inline("folds"))


_TRUTH = f"truth AS (SELECT user_id, item_id FROM inter WHERE last_us >= {AS_OF_US} - 7 * {DAY_US} AND last_us <= {AS_OF_US})"
_HITS = f"""WITH {_INTER}, {_STORED}, {_TRUTH}, {_C}, relevant AS (SELECT user_id, count(*) AS n FROM truth GROUP BY 1),
hits AS (SELECT c.user_id, c.rank, row_number() OVER (PARTITION BY c.user_id ORDER BY c.rank) AS h FROM c SEMI JOIN truth t ON t.user_id = c.user_id AND t.item_id = c.item_id WHERE c.rank <= {K}),
per AS (SELECT user_id, count(*) AS hits, sum(CAST(h AS DOUBLE) / rank) AS ap, sum(1 / log2(rank + 1)) AS dcg FROM hits GROUP BY 1),
m AS (SELECT user_id, coalesce(ap, 0) / n AS map, coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, {K + 1}) AS r(i)) AS ndcg, CAST(coalesce(hits, 0) AS DOUBLE) / n AS recall, coalesce(hits, 0) / {K}.0e0 AS precision FROM relevant LEFT JOIN per USING (user_id))"""


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    truth = interactions(spark, d).where((F.col("last_us") >= AS_OF_US - 7 * DAY_US) & (F.col("last_us") <= AS_OF_US))
    return strategy_rows(spark, d, "popular"), truth


@query(f"{_HITS} SELECT user_id, round(map, 9) AS map, round(ndcg, 9) AS ndcg, round(recall, 9) AS recall, round(precision, 9) AS precision FROM m")
def metrics_by_user(spark, d):
    return E.user_metrics(*_judged(spark, d), K).select("user_id", *(F.round(c, 9).alias(c) for c in ("map", "ndcg", "recall", "precision")))


@query(f"{_HITS} SELECT round(avg(map), 9) AS map, round(avg(ndcg), 9) AS ndcg, round(avg(recall), 9) AS recall, round(avg(precision), 9) AS precision FROM m")
def metrics_mean(spark, d):
    return E.mean_metrics(*_judged(spark, d), K).select(*(F.round(c, 9).alias(c) for c in ("map", "ndcg", "recall", "precision")))


@query(f"WITH {_INTER}, {_TRUTH} SELECT user_id, item_id FROM truth")
def held_out_truth(spark, d):
    return _judged(spark, d)[1].select("user_id", "item_id")


# ---- lookup --------------------------------------------------------------------------------------------------------

_SNAPSHOT = f"{_ITEMS}, snap AS (SELECT item_id, category, coalesce(published, false) AND coalesce({duckdb_strip('in_stock')} IN ('1', 'true', 'True', 'TRUE', 'yes', 'Yes', 'YES'), false) AS is_available FROM it)"
_PLACES = "places AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank NULLS LAST, score DESC NULLS LAST, item_id, source) AS place FROM stored)"
_ASKED = "asked AS (SELECT DISTINCT user_id FROM shop_users)"


def asked(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "shop_users").select("user_id").distinct()


def snapshot(spark: SparkSession, d: str) -> DataFrame:
    raw = read(spark, d, "shop_items")
    return L.item_snapshot(raw, SHOP.availability, newest=[F.desc_nulls_last("exported_at")])


@query(f"WITH {_SNAPSHOT} SELECT * FROM snap")
def item_snapshot(spark, d):
    return snapshot(spark, d)


@query(f"WITH {_STORED}, {_PLACES}, {_ASKED} SELECT user_id, item_id, place, score, source FROM places SEMI JOIN asked USING (user_id) WHERE place <= {K}")
def lookup_users(spark, d):
    return L.lookup(stored(spark, d), asked(spark, d), K).select("user_id", "item_id", "place", "score", "source")


_NO_COLD = f"{_STORED.replace('stored AS', 'everything AS')}, stored AS (SELECT * FROM everything WHERE user_id <> '__cold_start__')"
_DONOR = """lent AS (SELECT *, CASE source WHEN 'popular_fallback' THEN 0 ELSE 1 END AS p FROM stored WHERE source IN ('popular_fallback', 'latest')),
donor AS (SELECT user_id FROM lent GROUP BY user_id ORDER BY min(p), user_id LIMIT 1),
fallback AS (SELECT user_id, item_id, score, source, row_number() OVER (ORDER BY rank NULLS LAST, score DESC NULLS LAST, item_id, source) AS place FROM lent SEMI JOIN donor USING (user_id))"""


@query(f"WITH {_NO_COLD}, {_DONOR} SELECT user_id, item_id, place, score, source FROM fallback WHERE place <= {K}")
def donor_fallback(spark, d):
    return L.fallback_rows(stored(spark, d).where("user_id <> '__cold_start__'"), K).select("user_id", "item_id", "place", "score", "source")


_FALLBACK = """cold AS (SELECT item_id, place, score, source FROM places WHERE user_id = '__cold_start__'),
served AS (SELECT user_id, item_id, place, score, source, false AS is_fallback FROM places SEMI JOIN asked USING (user_id)
  UNION ALL SELECT a.user_id, item_id, place, score, source, true FROM (SELECT user_id FROM asked EXCEPT SELECT user_id FROM stored) a, cold)"""


@query(f"WITH {_STORED}, {_PLACES}, {_ASKED}, {_FALLBACK} SELECT * FROM served WHERE place <= {K}")
def lookup_with_fallback(spark, d):
    return L.lookup_or_fallback(stored(spark, d), asked(spark, d), K)


@query(f"""WITH {_STORED}, {_PLACES}, {_ASKED}, {_FALLBACK}, {_SNAPSHOT},
kept AS (SELECT s.* FROM served s SEMI JOIN (SELECT item_id FROM snap WHERE is_available AND category = 'beer') x ON x.item_id = s.item_id WHERE place <= {K * 5})
SELECT user_id, item_id, place, score, source, is_fallback FROM (SELECT user_id, item_id, score, source, is_fallback, row_number() OVER (PARTITION BY user_id ORDER BY place) AS place FROM kept) WHERE place <= {K}""")
def serve_filtered(spark, d):
    return L.serve(stored(spark, d), snapshot(spark, d), asked(spark, d), K, category="beer")


@query(f"WITH {_STORED}, {_PLACES}, {_SNAPSHOT} SELECT user_id, p.item_id, place, category FROM places p LEFT JOIN snap USING (item_id) WHERE place <= {K}")
def rows_with_category(spark, d):
    rows = stored(spark, d)
    shown = L.lookup(rows, rows.select("user_id"), K).select("user_id", "item_id", "place")
    return L.with_category(shown, snapshot(spark, d))


@query(f"WITH {_STORED}, {_PLACES}, {_SNAPSHOT} SELECT user_id, place, p.item_id, coalesce(printf('%.4f', round(score, 4) + 0.0), '') AS score, coalesce(category, '') AS category FROM places p LEFT JOIN snap USING (item_id) WHERE place <= 3")
def shown_cells(spark, d):
    """What a table of a user's rows shows: scores with four decimals, blanks for what is missing."""
    shown = L.with_category(L.lookup(stored(spark, d), stored(spark, d).select("user_id"), 3), snapshot(spark, d))
    return shown.select("user_id", "place", "item_id", L.cell("score").alias("score"), F.coalesce("category", F.lit("")).alias("category"))


# ---- stores and streams --------------------------------------------------------------------------------------------

_DELIVERED = f"""good AS (
  SELECT {duckdb_strip("user_id")} AS user_id, {duckdb_strip("item_id")} AS item_id, {duckdb_strip("event_type")} AS event_type, coalesce(quantity, 1) AS quantity, epoch_us(occurred_at) AS t,
         coalesce(nullif({duckdb_strip("event_id")}, ''), nullif({duckdb_strip("idempotency_key")}, '')) AS given
  FROM stream_deliveries WHERE {duckdb_strip("user_id")} <> '' AND {duckdb_strip("item_id")} <> '' AND {duckdb_strip("event_type")} <> '' AND occurred_at IS NOT NULL AND coalesce(quantity, 1) >= 1),
norm AS (SELECT coalesce(given, concat_ws('|', user_id, item_id, event_type, CAST(quantity AS VARCHAR), CAST(t AS VARCHAR))) AS event_id, user_id, item_id, event_type, quantity, t FROM good)"""
_ONCE = """first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY t, user_id, item_id, event_type, quantity) AS n FROM norm) WHERE n = 1),
batch AS (SELECT event_id, user_id, item_id, event_type, quantity, t FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id, event_type, quantity, t ORDER BY event_id) AS m FROM first) WHERE m = 1)"""
_BATCH = f"{_DELIVERED}, {_ONCE}"
_SLICES = f"""pop AS (SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS place FROM (
  SELECT item_id, round(sum({_BASE} * {_QTY}), 6) AS score FROM batch WHERE {_BASE} IS NOT NULL GROUP BY 1) ORDER BY place LIMIT {K}),
new AS (SELECT item_id, CAST({K} - place + 1 AS DOUBLE) AS score, place FROM (SELECT item_id, row_number() OVER (ORDER BY max(t) DESC, item_id) AS place FROM batch WHERE {_BASE} IS NOT NULL GROUP BY 1) WHERE place <= {K})"""


def batch(spark: SparkSession, d: str) -> DataFrame:
    return N.dedupe_batch(N.normalise(read(spark, d, "stream_deliveries"))[0])


@query(f"WITH {_DELIVERED} SELECT * FROM norm")
def stream_normalised(spark, d):
    return N.normalise(read(spark, d, "stream_deliveries"))[0]


@query("SELECT delivery_id FROM stream_deliveries WHERE delivery_id NOT IN (SELECT delivery_id FROM stream_deliveries WHERE " + " AND ".join(f"{duckdb_strip(c)} <> ''" for c in ("user_id", "item_id", "event_type")) + " AND occurred_at IS NOT NULL AND coalesce(quantity, 1) >= 1)")
def stream_rejected(spark, d):
    return N.normalise(read(spark, d, "stream_deliveries"))[1].select("delivery_id")


@query(f"WITH {_BATCH} SELECT * FROM batch")
def stream_deduped(spark, d):
    return batch(spark, d)


@query(f"WITH {_BATCH}, {_SLICES} SELECT * FROM pop")
def batch_popular(spark, d):
    return N.popular_slice(batch(spark, d), SHOP, K)


@query(f"WITH {_BATCH}, {_SLICES} SELECT * FROM new")
def batch_latest(spark, d):
    return N.latest_slice(batch(spark, d), SHOP, K)


_KEEP = "len(list_intersect(string_split(coalesce(source, ''), '+'), ['personalized', 'item_based', 'sequential', 'content_fallback', 'blended'])) > 0"


@query(f"""WITH {_BATCH}, {_SLICES}, {_STORED}, people AS (SELECT DISTINCT user_id FROM batch WHERE user_id <> '__cold_start__'),
touched AS (SELECT user_id, item_id, max(t) AS t FROM batch WHERE {_BASE} IS NOT NULL GROUP BY 1, 2),
boost AS (SELECT user_id, item_id, CAST(count(*) OVER (PARTITION BY user_id) - place + 1 AS DOUBLE) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, item_id) AS place FROM touched)),
keep AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank NULLS LAST, score DESC NULLS LAST, item_id, source) AS place FROM stored WHERE {_KEEP}),
old AS (SELECT *, row_number() OVER (ORDER BY rank NULLS LAST, score DESC NULLS LAST, item_id, source) AS place FROM stored WHERE user_id = '__cold_start__'),
rows_ AS (SELECT user_id, item_id, score, 'incremental' AS source, 0 AS tier, place FROM boost SEMI JOIN people USING (user_id) WHERE place <= 3
  UNION ALL SELECT user_id, item_id, score, source, 1, place FROM keep SEMI JOIN people USING (user_id) WHERE place <= {K} - CASE WHEN user_id IN (SELECT user_id FROM touched) THEN 3 ELSE 0 END
  UNION ALL SELECT user_id, item_id, score, 'popular_fallback', 2, place FROM (SELECT * FROM people UNION ALL SELECT '__cold_start__'), pop
  UNION ALL SELECT user_id, item_id, score, 'latest', 3, place FROM (SELECT * FROM people UNION ALL SELECT '__cold_start__'), new
  UNION ALL SELECT user_id, item_id, score, source, 4, place FROM old),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY tier, place) AS n FROM rows_) WHERE n = 1)
SELECT user_id, item_id, rank, round(score, 9) AS score, source FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, place, item_id) AS rank FROM once) WHERE rank <= {K}""")
def incremental_merge(spark, d):
    rows = N.merge_batch(stored(spark, d), materialize(batch(spark, d), "batch"), SHOP, K)
    return rows.withColumn("score", F.round("score", 9))


_NEWER = "newer AS (SELECT user_id, item_id, CAST(1 AS INTEGER) AS rank, CAST(1 AS DOUBLE) AS score, 'latest' AS source FROM (SELECT user_id, min(item_id) AS item_id FROM shop_events WHERE channel = 'kiosk' AND user_id IS NOT NULL AND item_id IS NOT NULL GROUP BY 1))"


@query(f"WITH {_STORED}, {_NEWER} SELECT * FROM stored ANTI JOIN newer USING (user_id) UNION ALL SELECT * FROM newer", stored_ranks=True)
def replaced_users(spark, d):
    kiosk = read(spark, d, "shop_events").where("channel = 'kiosk' and user_id is not null and item_id is not null")
    rows = kiosk.groupBy("user_id").agg(F.min("item_id").alias("item_id")).select("user_id", "item_id", F.lit(1).alias("rank"), F.lit(1.0).alias("score"), F.lit("latest").alias("source"))
    return T.replace_users(stored(spark, d), T.replace_ids(rows, rows), rows)


@query(f"WITH {_STORED} SELECT count(DISTINCT user_id) AS n_users FROM stored")
def stored_users(spark, d):
    return stored(spark, d).agg(F.countDistinct("user_id").alias("n_users"))


@query(f"WITH {_STORED} SELECT * FROM stored SEMI JOIN (SELECT user_id FROM shop_users) USING (user_id)", stored_ranks=True)
def rows_for_users(spark, d):
    return stored(spark, d).join(asked(spark, d), "user_id", "left_semi")


@query(f"WITH {_EV} SELECT event_id, t, user_id, item_id FROM (SELECT DISTINCT event_id, t, user_id, item_id FROM ev) WHERE (t, event_id) > ({CURSOR[0]}, '{CURSOR[1]}') ORDER BY t, event_id LIMIT 100")
def keyset_page(spark, d):
    return T.keyset_page(events(spark, d).select("event_id", "t", "user_id", "item_id").distinct(), CURSOR, 100)


@query(f"WITH {_EV} SELECT event_id, t, n FROM (SELECT event_id, t, count(*) * 3 AS n FROM ev GROUP BY 1, 2)")
def event_times(spark, d):
    """The same times read from timestamps, from ISO texts with an offset and from epoch seconds."""
    rows = read(spark, d, "shop_events").where("user_id is not null and item_id is not null and occurred_at is not null")
    at = F.col("occurred_at")
    kinds = [at, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), F.unix_micros(at) / 1e6]
    frames = [rows.select("event_id", k.alias("occurred_at")) for k in kinds]
    times = R.union([f.select("event_id", N.event_time(f, "occurred_at").alias("t")) for f in frames])
    return times.groupBy("event_id", "t").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT event_id, count(*) AS n FROM shop_events
WHERE NOT coalesce({duckdb_strip("user_id")} <> '' AND {duckdb_strip("item_id")} <> '' AND {duckdb_strip("event_type")} <> '' AND occurred_at IS NOT NULL AND coalesce(quantity, 1) >= 1, false) GROUP BY 1""")
def events_rejected(spark, d):
    """The shop's events as a stream would take them: those without a user, item, type, time or sensible quantity."""
    return N.normalise(read(spark, d, "shop_events"))[1].groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT channel AS mode, count(*) AS n_rows, max(epoch_us(ingested_at)) AS at_us FROM shop_events WHERE channel IS NOT NULL AND ingested_at IS NOT NULL GROUP BY 1 ORDER BY at_us DESC LIMIT 2")
def newest_manifests(spark, d):
    """Manifests of one run per channel, dated by its newest row, written in the order of names and read back newest first."""
    store = T.Store(spark, fresh_path(spark, "manifests"))
    runs = read(spark, d, "shop_events").where("channel is not null and ingested_at is not null").groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("ingested_at")).alias("at"))
    for r in runs.orderBy("channel").collect():  # one row per channel
        store.write_manifest({"generated_at": (datetime(1970, 1, 1) + timedelta(microseconds=r["at"])).isoformat(), "mode": r["channel"], "n_rows": r["n"], "at_us": r["at"]})
    return spark.createDataFrame([(m["mode"], m["n_rows"], m["at_us"]) for m in store.manifests(2)], "mode string, n_rows bigint, at_us bigint")


# ---- whole runs ----------------------------------------------------------------------------------------------------

CLOSED_FORM = ("item_based", "sequential", "content_fallback", "latest", "popular")
_AVAILABLE = f"snap AS{_SNAPSHOT.split(', snap AS')[1]}, al AS (SELECT item_id FROM snap WHERE is_available)"


def _lists_sql(k: int) -> str:
    """The lists of all closed-form strategies, from ev, inter, it and itf, for allowed items."""
    cut = lambda name, source: f"SELECT user_id, item_id, rank, score, '{source}' AS source FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM {name}) WHERE rank <= {k}"
    fresh = lambda name: f"SELECT s.* FROM {name} s ANTI JOIN inter i ON i.user_id = s.user_id AND i.item_id = s.item_id WHERE s.item_id IN (SELECT item_id FROM al)"
    shown = lambda name, rows: f"{name} AS (SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM (SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM {rows} WHERE item_id IN (SELECT item_id FROM al) GROUP BY item_id) ORDER BY rank LIMIT {k})"
    return f"""{_AVAILABLE}, {_TARGETS}, {shown("pop_", "inter")}, {_RECENT}, {shown("lat_", "recent")},
l_popular AS (SELECT user_id, item_id, rank, score, 'popular_fallback' AS source FROM targets, pop_), l_latest AS (SELECT user_id, item_id, rank, score, 'latest' AS source FROM targets, lat_),
{_NEAR}, ib AS (SELECT i.user_id, n.other_id AS item_id, sum(i.weight * n.similarity) AS score FROM inter i JOIN near n ON n.item_id = i.item_id GROUP BY 1, 2 HAVING sum(i.weight * n.similarity) > 0),
ib_fresh AS ({fresh("ib")}), l_item_based AS ({cut("ib_fresh", "item_based")}),
{_STEPS}, odds AS (SELECT from_id, to_id, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY from_id) AS p FROM moves),
ends AS (SELECT user_id, item_id AS from_id, pow(0.5e0, place - 1) AS f FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_us DESC, item_id DESC) AS place FROM inter) WHERE place <= 3),
sq AS (SELECT user_id, to_id AS item_id, sum(f * p) AS score FROM ends JOIN odds USING (from_id) GROUP BY 1, 2), sq_fresh AS ({fresh("sq")}), l_sequential AS ({cut("sq_fresh", "sequential")}),
{_TOK}, {_CONTENT}, l_content_fallback AS ({cut("best", "content_fallback")})"""


def _priority_sql(models: tuple[str, ...], k: int) -> str:
    tagged = " UNION ALL ".join(f"SELECT *, {i} AS o FROM l_{m}" for i, m in enumerate(models))
    return f"""SELECT user_id, item_id, place AS rank, score, source FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o, rank, item_id) AS place FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY o, rank) AS first FROM ({tagged})) WHERE first = 1)) WHERE place <= {k}"""


_WHOLE = f"{_INTER}, {_ITEM_FEATURES}"
_RUN = ("item_based", "sequential", "content_fallback", "popular")
_BATCH_SQL = f"""WITH {_WHOLE}, {_FACTOR_PARTS}, {_lists_sql(3 * K)}, mixed AS ({_priority_sql(_RUN, 3 * K)}),
boosted AS (SELECT user_id, item_id, score * coalesce(factor, 1) AS score, source FROM mixed LEFT JOIN factors USING (item_id))
SELECT user_id, item_id, rank, round(score, 6) AS score, source FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM boosted) WHERE rank <= {K}"""


def _data(spark: SparkSession, d: str) -> pipeline.Dataset:
    return pipeline.build_dataset(read(spark, d, "shop_events"), read(spark, d, "shop_users"), read(spark, d, "shop_items"), SHOP, AS_OF_US, HALF_LIFE)


_BATCH_JOB, _BATCH_CONFIG = JobSettings(models=_RUN, content_fallback=True), replace(SHOP, boosts=BOOSTS)


@query(_BATCH_SQL)
def batch_pipeline(spark, d):
    """The whole batch run over the shop's tables: all closed-form strategies but latest by priority, available items only, boosted."""
    return pipeline.recommend(_data(spark, d), _BATCH_CONFIG, _BATCH_JOB).withColumn("score", F.round("score", 6))


@query(_BATCH_SQL)
def artifact_rows(spark, d):
    """The same rows from an artifact: fitted, written, read back and recommended from, without learning anything anew."""
    store = T.Store(spark, fresh_path(spark, "store"))
    pipeline.save_artifact(store, pipeline.fit(_data(spark, d), _RUN, _BATCH_JOB), _BATCH_CONFIG, _BATCH_JOB)
    return pipeline.recommend(*pipeline.load_artifact(store)).withColumn("score", F.round("score", 6))


@query(f"""WITH {_WHOLE}, {_lists_sql(K)}, {_BY_DATE.replace("published_at IS NOT NULL", "published_at IS NOT NULL AND item_id IN (SELECT item_id FROM al)")},
wt AS (SELECT t.user_id, coalesce(CASE WHEN n > 0 THEN {_SIGMOID_SQL} END, 0) AS p FROM targets t LEFT JOIN (SELECT user_id, count(*) AS n FROM inter GROUP BY 1) USING (user_id)
  UNION ALL SELECT '__cold_start__', 0),
rows_ AS (SELECT user_id, item_id, min(rank) AS rank, 'personalized' AS source FROM (SELECT * FROM l_item_based UNION ALL SELECT * FROM l_sequential) GROUP BY 1, 2
  UNION ALL SELECT user_id, item_id, rank, 'popular_fallback' FROM wt, pop_ UNION ALL SELECT user_id, item_id, rank, 'latest' FROM wt, by_date),
weighed AS (SELECT r.*, CASE source WHEN 'personalized' THEN p WHEN 'popular_fallback' THEN (1 - p) * 0.7e0 ELSE (1 - p) * (1 - 0.7e0) END AS w FROM rows_ r JOIN wt USING (user_id)),
mixed AS (SELECT user_id, item_id, sum(w / (60.0e0 + rank)) AS score, CASE WHEN count(DISTINCT source) > 1 THEN 'blended' ELSE min(source) END AS source FROM weighed WHERE w > 1e-9 GROUP BY 1, 2)
SELECT user_id, item_id, rank, round(score, 9) AS score, source FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM mixed) WHERE rank <= {K}""")
def batch_blended(spark, d):
    """The whole batch run with blending: personalized, popular and newest items by each user's weights, and the cold-start rows."""
    job = JobSettings(models=("item_based", "sequential", "popular"))
    return pipeline.recommend(_data(spark, d), replace(SHOP, blending=SIGMOID), job).withColumn("score", F.round("score", 9))


_CANDIDATES = E.default_candidates(CLOSED_FORM, PERSONALIZED)
_FUSED = " UNION ALL ".join(f"SELECT user_id, item_id, {1.0 if m in PERSONALIZED else 0.3}e0 / (60.0e0 + rank) AS x FROM l_{m}" for m in CLOSED_FORM)


def _fold_sql(i: int) -> str:
    """Hits of every candidate in the i-th fold from the end, and how many users it is judged by."""
    newest = f"(SELECT max(epoch_us(occurred_at)) + 1 FROM shop_events WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND epoch_us(occurred_at) <= {AS_OF_US})"
    start, end = f"({newest} - {7 * (i + 1) * DAY_US})", f"({newest} - {7 * i * DAY_US})"
    during = lambda part, when, as_of: part.replace(str(AS_OF_US), as_of).replace("occurred_at IS NOT NULL)", f"occurred_at IS NOT NULL AND {when})")
    at = "epoch_us(occurred_at)"
    solo = [f"SELECT '{c.label}' AS candidate, user_id, item_id, rank FROM l_{c.models[0]}" for c in _CANDIDATES if len(c.models) == 1]
    fused = f"SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(sum(x), 9) DESC, item_id) AS rank FROM ({_FUSED}) GROUP BY 1, 2"
    mixed = [f"SELECT '{c.label}', user_id, item_id, rank FROM ({_priority_sql(CLOSED_FORM, K) if c.weights is None else fused}) WHERE rank <= {K}" for c in _CANDIDATES if len(c.models) > 1]
    lists = during(_lists_sql(K), "true", start).replace("SELECT user_id FROM ev UNION SELECT user_id FROM shop_users WHERE user_id IS NOT NULL", "SELECT DISTINCT user_id FROM ev")
    return f"""(WITH {during(_INTER, f"{at} < {start}", start)}, {_ITEM_FEATURES}, {lists}, recs AS ({" UNION ALL ".join(solo + mixed)}),
truth AS (WITH {during(_INTER, f"{at} >= {start} AND {at} < {end}", end)} SELECT user_id, item_id FROM inter), relevant AS (SELECT user_id, count(*) AS n FROM truth GROUP BY 1),
hits AS (SELECT r.candidate, r.user_id, r.rank, row_number() OVER (PARTITION BY candidate, r.user_id ORDER BY r.rank) AS h FROM recs r SEMI JOIN truth t ON t.user_id = r.user_id AND t.item_id = r.item_id WHERE r.rank <= {K}),
per AS (SELECT candidate, user_id, count(*) AS hits, sum(CAST(h AS DOUBLE) / rank) AS ap, sum(1 / log2(rank + 1)) AS dcg FROM hits GROUP BY 1, 2)
SELECT candidate, sum(ap / n) / m AS map, sum(dcg) / (SELECT sum(1 / log2(j + 1)) FROM range(1, {K + 1}) AS r(j)) / m AS ndcg, sum(CAST(hits AS DOUBLE) / n) / m AS recall, sum(hits / {K}.0e0) / m AS precision
FROM per JOIN relevant USING (user_id), (SELECT count(*) AS m FROM relevant) GROUP BY candidate, m)"""


@query(f"""WITH all_ AS (SELECT * FROM (VALUES {", ".join(f"('{c.label}', {i})" for i, c in enumerate(_CANDIDATES))}) AS v(candidate, o)),
means AS (SELECT candidate, o, coalesce(sum(map), 0) / 2 AS map, coalesce(sum(ndcg), 0) / 2 AS ndcg, coalesce(sum(recall), 0) / 2 AS recall, coalesce(sum(precision), 0) / 2 AS precision
  FROM all_ LEFT JOIN ({_fold_sql(0)} UNION ALL {_fold_sql(1)}) USING (candidate) GROUP BY 1, 2)
SELECT candidate, row_number() OVER (ORDER BY round(map, 9) DESC, o) = 1 AS is_best, round(map, 9) AS map, round(ndcg, 9) AS ndcg, round(recall, 9) AS recall, round(precision, 9) AS precision FROM means""")
def automl(spark, d):
    """Every closed-form strategy alone, all by priority and all fused, over two weekly folds: the mean metrics of each."""
    job = JobSettings(folds=2, fold_days=7, half_life_days=HALF_LIFE)
    return _results(spark, pipeline.backtest(read(spark, d, "shop_events"), None, read(spark, d, "shop_items"), SHOP, job, _CANDIDATES, AS_OF_US))


@query()
def automl_all(spark, d):
    """The same with collaborative among the strategies, as a job chooses by default."""
    job = JobSettings(folds=2, fold_days=7, half_life_days=HALF_LIFE)
    candidates = E.default_candidates(("collaborative", *CLOSED_FORM), PERSONALIZED)
    return _results(spark, pipeline.backtest(read(spark, d, "shop_events"), None, read(spark, d, "shop_items"), SHOP, job, candidates, AS_OF_US))


def _results(spark: SparkSession, results: list) -> DataFrame:
    best = E.select_best([(c, {n: round(v, 9) for n, v in m.items()}) for c, m in results], "MAP").label
    rows = [(c.label, c.label == best, *(round(m[f"{n}@{K}"], 9) for n in E.METRICS)) for c, m in results]
    return spark.createDataFrame(rows, "candidate string, is_best boolean, map double, ndcg double, recall double, precision double")
