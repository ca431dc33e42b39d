"""Queries p1, p4, p6, p7 and p8 with their SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarflow.functions.strings import WHITESPACE, duckdb_strip, duckdb_whitespace
from cellarflow.functions.times import DAY_US
from cellarflow.llm.cooccurrence import pairs_together
from cellarflow.llm.mixing import mix_sources
from cellarflow.llm.packing import pack_texts
from cellarflow.llm.quality import (
    CLOSING,
    ENDS,
    HIRAGANA,
    LEARNT_LETTERS,
    LEARNT_WORDS,
    SEPARATORS,
    STATISTICS,
    UNSPACED_LETTERS,
    measure_texts,
    not_prose,
    plain_statistics,
    text_quality,
    word_lists,
)
from cellarflow.llm.topn import top_items


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: The 0.999 quantile of chi squared with one degree of freedom.
SIGNIFICANT = 10.828


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in five baskets or more, ten times more often than chance would have it and significantly so.

    The log-likelihood ratio is at least 2 n_ab (ln lift - 1 + 1 / lift), 14.03 for such pairs, so SIGNIFICANT leaves out none.
    """
    return pairs_together(_read(spark, sf_dir, "shop_events"), min_together=5, min_lift=10, min_llr=SIGNIFICANT).select("item_a", "item_b")


def p1_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of at least two common baskets whose number of them chance does not explain, in either direction."""
    pairs = pairs_together(_read(spark, sf_dir, "shop_events"), min_together=2, min_llr=SIGNIFICANT)
    return pairs.select("item_a", "item_b", "n_ab", F.round("lift", 6).alias("lift"), F.round("llr", 6).alias("llr"))


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pairs_together(_read(spark, sf_dir, "shop_events"))
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("llr", 6).alias("llr"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_items(_read(spark, sf_dir, "recommendations")).select("user_id", "item_id", "place")


def p4_best_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator by item: the three best users of each item, with their scores."""
    return top_items(_read(spark, sf_dir, "recommendations"), 3, group="item_id", item="user_id")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [(r["container_kind"], r["capacity_tokens"]) for r in _read(spark, sf_dir, "container_kinds").collect()]  # the kinds asked for
    return pack_texts(_read(spark, sf_dir, "documents"), kinds)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: containers used, the least number that could do, and the share of their room that is filled."""
    packed = p6_packed(spark, sf_dir)
    each = packed.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("used"))
    return each.groupBy("container_kind", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.ceil(F.sum("used") / F.first("capacity_tokens")).alias("least_containers"),
        F.round(F.sum("used") / F.sum("capacity_tokens"), 6).alias("fill"),
    )


def _mixed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    if "weight" in options:  # newer texts count more: half for each half-year of age, a tenth where the time is not known
        newest = documents.agg(F.max("created_at"))
        age = (F.unix_micros(newest.scalar()) - F.unix_micros("created_at")) / F.lit(182.5 * DAY_US)
        documents = documents.withColumn(options["weight"], F.coalesce(F.pow(F.lit(0.5), age), F.lit(0.1)))
    uses, shares = mix_sources(documents, _read(spark, sf_dir, "mix_targets"), **options)
    report = shares.select("source", "target_share", F.round("real_share", 9).alias("real_share"))
    return uses.join(report, uses["source"].eqNullSafe(report["source"]), "left").select("doc_id", uses["source"], "n_tokens", "uses", "target_share", "real_share")


def p7_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of each document, with the share its source asked for and the share it really got."""
    return _mixed(spark, sf_dir)


def p7_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mix with newer texts more likely in it: inclusion odds differ within a source."""
    return _mixed(spark, sf_dir, weight="_weight")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "mix_targets"))[1]


def _texts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [_read(spark, sf_dir, t) for t in ("documents", "prose_samples", "common_words")]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_prose(measure_texts(*_texts(spark, sf_dir))).select("doc_id")


def p8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(*_texts(spark, sf_dir))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every document that the tails are taken of."""
    documents, _, words = _texts(spark, sf_dir)
    stats = plain_statistics(documents.select("doc_id", "text"), sorted({w for _, w in word_lists(documents, words)}))
    return stats.select("doc_id", "n_words", *(F.round(s, 6).alias(s) for s in STATISTICS[1:]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_significant, p1_pairs, p4_found, p4_best_scores, p6_packed, p6_fill, p7_uses, p7_weighted, p7_shares, p8_found, p8_quality, p8_statistics)
}

_BASKETS = f"""
WITH baskets AS (
  SELECT DISTINCT {duckdb_strip("user_id")} AS u, CAST(floor(epoch_us(occurred_at) / 86400000000.0) AS BIGINT) AS d, {duckdb_strip("item_id")} AS item
  FROM shop_events WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND occurred_at IS NOT NULL),
total AS (SELECT count(*) AS n FROM (SELECT DISTINCT u, d FROM baskets)),
items AS (SELECT item, count(*) AS n FROM baskets GROUP BY item),
together AS (
  SELECT x.item AS item_a, y.item AS item_b, count(*) AS n_ab
  FROM baskets x JOIN baskets y ON x.u = y.u AND x.d = y.d AND x.item < y.item GROUP BY 1, 2),
rated AS (
  SELECT item_a, item_b, n_ab, a.n AS n_a, b.n AS n_b, total.n AS n
  FROM together JOIN items a ON a.item = item_a JOIN items b ON b.item = item_b, total)
"""


def _part(k: str, row: str, col: str) -> str:
    return f"(CASE WHEN {k} > 0 THEN CAST({k} AS DOUBLE) * ln(CAST({k} AS DOUBLE) * n / (CAST({row} AS DOUBLE) * ({col}))) ELSE 0 END)"


_LLR = " + ".join(
    (
        _part("n_ab", "n_a", "n_b"), _part("(n_a - n_ab)", "n_a", "n - n_b"), _part("(n_b - n_ab)", "(n - n_a)", "n_b"),
        _part("(n - n_a - n_b + n_ab)", "(n - n_a)", "n - n_b"),
    )
)

_BLANK = "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE)
_BREAKS = "[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]+"
_PAT = {k: "'" + v.replace("'", "''") + "'" for k, v in {
    "not_letter": "[^\\p{L}\\p{Nl}\\p{No}]+", "not_alpha": "[^\\p{L}]+", "not_digit": "[^\\p{Nd}]+", "lines": _BREAKS, "ended": f"[{ENDS}][{CLOSING}]*$",
    "stop": f"[^0-9{_BLANK}][.!?…][{CLOSING}]*(?:[{_BLANK}]|$)|[。！？]", "separator": f"[{SEPARATORS}]", "sentences": f"[{ENDS}\\n\\r]+",
    "not_unspaced": f"[^{UNSPACED_LETTERS}]+", "not_hiragana": f"[^{HIRAGANA}]+",
}.items()}
_SIZE = lambda pattern: f"length(regexp_replace(text, {pattern}, '', 'g'))"
_LANG = "CASE WHEN regexp_matches(substr(lower({0}), 1, 2), '^[a-z]{{2}}$') THEN substr(lower({0}), 1, 2) ELSE 'und' END"
_SHARE = lambda a, b, none="0": f"CASE WHEN text IS NOT NULL THEN coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), {none}) END"
_STATISTICS = f"""
WITH docs AS (SELECT doc_id, text, lower(text) AS low, {_LANG.format(duckdb_strip("lang"))} AS lang FROM documents),
listed AS (SELECT DISTINCT {_LANG.format(duckdb_strip("lang"))} AS lang, lower({duckdb_strip("word")}) AS word FROM common_words WHERE {duckdb_strip("word")} <> ''),
other AS (SELECT lang, low FROM docs WHERE text IS NOT NULL AND lang <> 'und' AND lang NOT IN (SELECT lang FROM listed)),
met AS (SELECT lang, unnest(list_distinct(regexp_split_to_array(low, {_PAT["not_alpha"]}))) AS word FROM other),
counted AS (SELECT lang, word, count(*) AS n FROM met WHERE length(word) BETWEEN 1 AND {LEARNT_LETTERS} GROUP BY 1, 2),
often AS (SELECT lang, word, n FROM counted JOIN (SELECT lang, count(*) AS d FROM other GROUP BY 1) USING (lang) WHERE n * 10 >= d),
learnt AS (SELECT word FROM (SELECT word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM often) WHERE place <= {LEARNT_WORDS}),
common AS (SELECT list(word) AS words FROM (SELECT word FROM listed UNION SELECT word FROM learnt)),
cut AS (SELECT doc_id, text, list_filter(regexp_split_to_array(low, {_PAT["not_letter"]}), lambda x: x <> '') AS w,
  {_SIZE(_PAT["not_letter"])} AS letters, {_SIZE(_PAT["not_digit"])} AS digits, length(translate(text, {duckdb_whitespace()}, '')) AS solid,
  {_SIZE(_PAT["not_unspaced"])} AS kana, {_SIZE(_PAT["not_hiragana"])} AS hira,
  list_filter(list_transform(regexp_split_to_array(text, {_PAT["lines"]}), lambda x: {duckdb_strip("x")}), lambda x: x <> '') AS lines,
  len(regexp_extract_all(text, {_PAT["stop"]})) AS stops, len(regexp_extract_all(text, {_PAT["separator"]})) AS seps,
  list_filter(list_transform(regexp_split_to_array(low, {_PAT["sentences"]}), lambda x: {duckdb_strip("x")}), lambda x: x <> '') AS parts FROM docs),
sized AS (SELECT *, len(w) AS n, len(list_filter(w, lambda x: list_contains(words, x))) AS n_common, len(list_filter(lines, lambda x: regexp_matches(x, {_PAT["ended"]}))) AS n_ended,
  len(list_distinct(w)) AS n_distinct, len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS n_pairs, len(list_distinct(parts)) AS n_parts FROM cut, common)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN n END AS n_words, round({_SHARE("letters", "n")}, 6) AS mean_word_length,
  round({_SHARE("(solid - letters - digits)", "solid")}, 6) AS symbol_share, round({_SHARE("digits", "solid")}, 6) AS digit_share,
  round({_SHARE("n_ended", "len(lines)")}, 6) AS ended_line_share, round(CASE WHEN kana > 0.3 * letters THEN {_SHARE("hira", "letters")} ELSE {_SHARE("n_common", "n")} END, 6) AS common_share,
  round({_SHARE("n_distinct", "n")}, 6) AS distinct_share, round(CASE WHEN text IS NULL THEN NULL WHEN n < 2 THEN 1 ELSE {_SHARE("n_pairs", "(n - 1)")} END, 6) AS pair_share,
  round({_SHARE("n_parts", "len(parts)", "1")}, 6) AS sentence_share, round(least({_SHARE("seps", "greatest(letters, 1)")}, 1), 6) AS separator_share,
  round({_SHARE("letters", "greatest(stops, 1)")}, 6) AS stop_gap FROM sized"""

SQL: dict[str, str] = {
    "p1_found": _BASKETS + "SELECT item_a, item_b FROM rated WHERE n_ab >= 5 AND n_ab * n >= 10 * n_a * n_b",
    "p1_significant": _BASKETS
    + f"SELECT * FROM (SELECT item_a, item_b, n_ab, round(CAST(n_ab AS DOUBLE) * n / (CAST(n_a AS DOUBLE) * n_b), 6) AS lift, round(2 * ({_LLR}), 6) AS llr FROM rated WHERE n_ab >= 2) WHERE llr >= {SIGNIFICANT}",
    "p1_pairs": _BASKETS
    + f"SELECT item_a, item_b, n_ab, n_a, n_b, round(CAST(n_ab AS DOUBLE) * n / (CAST(n_a AS DOUBLE) * n_b), 6) AS lift, round(2 * ({_LLR}), 6) AS llr FROM rated",
    "p8_statistics": _STATISTICS,
    "p4_found": """
WITH best AS (
  SELECT user_id, item_id, max(score) + 0.0 AS score FROM recommendations
  WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2)
SELECT user_id, item_id, place FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS place FROM best) WHERE place <= 10""",
    "p4_best_scores": """
WITH best AS (
  SELECT user_id, item_id, max(score) + 0.0 AS score FROM recommendations
  WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2)
SELECT item_id, user_id, score, place FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, user_id) AS place FROM best) WHERE place <= 3""",
}
