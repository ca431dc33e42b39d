"""Mixing sources to target weights: certain whole copies, then Pareto order sampling for the rest."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarflow.functions.strings import strip
from cellarflow.llm.tokens import DEFAULT_VOCABULARY, n_tokens
from cellarflow.runtime import materialize

#: Buckets of the sampling order per source; only the bucket where the target is met is ranked row by row.
BUCKETS = 1 << 16
#: Documents per source that may fill what the order leaves open.
FILLERS = 3
#: Buckets of a weight for each doubling of it.
WEIGHT_STEPS = 64
_SLACK = 1e-9


def source_name(column: Column | str) -> Column:
    """Sources without regard to letter case and surrounding white space."""
    return F.lower(strip(column))


def uniform(key: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 that depends on the key and the seed alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def largest_total(targets: list[tuple[str, float, int]], available: dict[str, int]) -> float:
    """The most tokens a mix can have in which every source that there is keeps its share under its repeats.

    Sources without a token, or that may not be used, leave their share to the others in proportion.
    """
    live = [(w, available.get(s, 0) * r) for s, w, r in targets if w > 0 and available.get(s, 0) > 0 and r > 0]
    whole = sum(w for w, _ in live)
    return min((most * whole / w for w, most in live), default=0.0)


def allocate(targets: list[tuple[str, float, int]], available: dict[str, int], total: float) -> dict[str, float]:
    """Tokens wanted of each source: its share of total, at most max_repeats times what there is.

    What scarce sources cannot give goes to the others in proportion to their shares, so total is kept while anything is left.
    """
    live = {s: (w, available.get(s, 0) * r) for s, w, r in targets if w > 0 and available.get(s, 0) > 0 and r > 0}
    left = float(total)
    out = {s: 0.0 for s, _, _ in targets}
    while live and left > 0:
        weight = sum(w for w, _ in live.values())
        short = {s: most for s, (w, most) in live.items() if left * w / weight > most * (1 + _SLACK)}
        if not short:
            out |= {s: min(left * w / weight, most) for s, (w, most) in live.items()}
            break
        for s, most in short.items():
            out[s], left = float(most), left - most
            del live[s]
    return out


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    *,
    total_tokens: int | Literal["available"] | None = None,
    seed: int = 17,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: str | None = None,
    vocabulary: str = DEFAULT_VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """(uses, shares) of a mix in which every source gets its share of all tokens.

    uses: one row per document with an id: doc_id, source, n_tokens, uses (0 for documents left out).
    shares: one row per source of targets or documents: source, target_share, max_repeats, n_docs, available_tokens,
    wanted_tokens, mixed_tokens, real_share, most_uses.

    targets has source, target_share, max_repeats; sources match without regard to case and surrounding white space.
    Documents of a null source or one without a target, and texts that are null or have no tokens, are never used.
    Targets that repeat a source, or whose share or repeats are null or negative, raise ValueError. Repeated ids are
    separate documents that share their luck. Empty documents give empty uses, and shares of 0.

    The mix is as large as it can be with every source that there is at its share (see largest_total). total_tokens asks for
    another size, or, "available", for that of all documents of sources with a target; then scarce sources give what they
    have, and the others share the gap.

    A document wants wanted / available uses of its source (in proportion to weight, where that column is given; null
    and negative weights count as 0). The whole part, at most max_repeats, is certain. The fraction is the inclusion
    probability p of one more use: documents are ranked by Pareto's (u / (1 - u)) / (p / (1 - p)) with u from a hash of
    id and seed, and taken in that order while the next one fits into the source's remaining tokens. The order is cut by a
    histogram of buckets per source, so no source is ever sorted in one task. Where the next one is longer than the gap, up to
    FILLERS more documents of the source are taken, each the one whose length is nearest to the gap that is left.
    """
    goals = [(r["s"], r["target_share"], r["max_repeats"]) for r in targets.select(source_name("source").alias("s"), "target_share", "max_repeats").collect()]
    if len({s for s, _, _ in goals}) != len(goals) or any(None in g or g[1] < 0 or g[2] < 0 for g in goals):
        raise ValueError("targets need one row per source, with a share and repeats of at least 0")
    spark = documents.sparkSession
    wish = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    sized = materialize(
        documents.where(F.col(doc_id).isNotNull()).select(
            F.col(doc_id).cast("bigint").alias("doc_id"), source_name(source).alias("source"), n_tokens(text, vocabulary).alias("n_tokens"), wish.alias("w")
        ),
        "sized",
    )
    with_target = F.col("source").isin([s for s, _, _ in goals])
    usable = with_target & (F.col("n_tokens") > 0) & (F.col("w") > 0)
    # the sources of targets bound these rows
    have = {r["source"]: r for r in sized.where(usable).groupBy("source").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("w")).alias("nw")).collect()}
    there = {s: int(r["n"]) for s, r in have.items()}
    total = largest_total(goals, there) if total_tokens is None else sum(there.values()) if total_tokens == "available" else total_tokens
    wanted = allocate(goals, there, total)
    rate = {s: wanted[s] / r["nw"] for s, r in have.items() if wanted.get(s)}
    repeats = {s: r for s, _, r in goals}
    if weight is not None:
        rate = _rates(sized.where(usable), wanted, repeats)
    plan = spark.createDataFrame(
        [(s, float(rate.get(s, 0.0)), int(repeats[s]), float(wanted[s]), float(w)) for s, w, _ in goals],
        "source string, rate double, cap int, wanted double, share double",
    )
    hoped = F.least(F.col("w") * F.col("rate"), F.col("cap").cast("double"))
    drawn = (
        sized.where(usable)
        .join(F.broadcast(plan), "source")  # one row per target
        .withColumn("certain", F.floor(hoped + F.lit(_SLACK)).cast("int"))
        .withColumn("p", F.when(F.col("certain") < F.col("cap"), F.greatest(hoped - F.col("certain"), F.lit(0.0))).otherwise(F.lit(0.0)))
        .withColumn("p", F.when(F.col("p") > _SLACK, F.col("p")).otherwise(F.lit(0.0)))
    )
    u = uniform(F.col("doc_id"), seed)
    order = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    drawn = drawn.withColumn("q", F.when(F.col("p") > 0, order))
    drawn = drawn.withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS).cast("int"))
    fixed = drawn.groupBy("source").agg(F.sum(F.col("certain") * F.col("n_tokens")).alias("fixed"))
    by_bucket = drawn.where("bucket is not null").groupBy("source", "bucket").agg(F.sum("n_tokens").alias("here"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    limits = (
        by_bucket.withColumn("before", F.coalesce(F.sum("here").over(running), F.lit(0)))
        .join(fixed, "source")
        .join(F.broadcast(plan.select("source", "wanted")), "source")
        .select("source", "bucket", "before", "here", (F.col("wanted") - F.col("fixed")).alias("rest"))
    )
    # per source: the buckets wholly below the target, and the one in which it is met
    cut = limits.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("here") >= F.col("rest"))).select(
        "source", F.col("bucket").alias("cut_bucket"), "before", "rest"
    )
    spent = limits.groupBy("source").agg(F.max("rest").alias("any_rest"))
    drawn = drawn.join(F.broadcast(cut), "source", "left").join(F.broadcast(spent), "source", "left")  # one row per target
    at_cut = drawn.where(F.col("bucket") == F.col("cut_bucket"))
    so_far = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    room = F.col("rest") - F.col("before") - F.coalesce(so_far, F.lit(0))
    border = at_cut.withColumn("room", room).select(
        "doc_id", "source", "n_tokens", (F.col("certain") + (F.col("room") >= F.col("n_tokens")).cast("int")).alias("uses"), (F.col("room") < F.col("n_tokens")).alias("more")
    )
    extra = F.when(F.col("bucket").isNull() | (F.col("any_rest") <= 0), F.lit(0)).when(
        F.col("cut_bucket").isNull() | (F.col("bucket") < F.col("cut_bucket")), F.lit(1)
    ).otherwise(F.lit(0))
    plain = drawn.where("bucket is null or cut_bucket is null or bucket <> cut_bucket").select(
        "doc_id", "source", "n_tokens", (F.col("certain") + extra).alias("uses"), (F.col("certain") + extra < F.col("cap")).alias("more")
    )
    never = sized.where(~F.coalesce(usable, F.lit(False))).select("doc_id", "source", "n_tokens", F.lit(0).alias("uses"), F.lit(False).alias("more"))
    uses = _filled(materialize(plain.unionByName(border).unionByName(never), "uses"), wanted, seed)
    got = uses.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("available_tokens"),
        F.coalesce(F.sum(F.col("n_tokens") * F.col("uses")), F.lit(0)).alias("mixed_tokens"), F.max("uses").alias("most_uses"),
    )
    shares = got.join(plan, got["source"].eqNullSafe(plan["source"]), "full").select(
        F.coalesce(got["source"], plan["source"]).alias("source"), F.coalesce("share", F.lit(0.0)).alias("target_share"),
        F.coalesce("cap", F.lit(0)).alias("max_repeats"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), F.coalesce("wanted", F.lit(0.0)).alias("wanted_tokens"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
    total = uses.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("uses")), F.lit(0)))
    real = F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), total.scalar().cast("double")), F.lit(0.0))
    return uses.select("doc_id", "source", "n_tokens", "uses"), shares.withColumn("real_share", real)


def _filled(uses: DataFrame, wanted: dict[str, float], seed: int) -> DataFrame:
    """uses with FILLERS more uses per source at most: of the document nearest in length to the gap, as long as it narrows it.

    Sums and one candidate per source reach the driver.
    """
    mixed = uses.where(F.col("source").isin(list(wanted))).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("n"))
    gap = {s: w - (got or 0) for s, w, got in ((r["source"], wanted[r["source"]], r["n"]) for r in mixed.collect())}
    taken: dict[str, list[int]] = {}
    for _ in range(FILLERS):
        left = {s: g for s, g in gap.items() if g >= 1}
        if not left:
            break
        near: Column = F.lit(None).cast("double")
        for s, g in left.items():
            near = F.when(F.col("source") == s, F.abs(F.col("n_tokens") - F.lit(float(g)))).otherwise(near)
        free = uses.where(F.col("more") & F.col("source").isin(list(left)) & ~F.col("doc_id").isin([d for ds in taken.values() for d in ds]))
        picks = free.groupBy("source").agg(F.min(F.struct(near.alias("near"), uniform(F.col("doc_id"), seed).alias("u"), "doc_id", "n_tokens")).alias("x")).collect()
        found = [r for r in picks if r["x"]["near"] < left[r["source"]]]
        if not found:
            break
        gap = {s: g - sum(r["x"]["n_tokens"] for r in found if r["source"] == s) for s, g in left.items() if any(r["source"] == s for r in found)}
        for r in found:
            taken.setdefault(r["source"], []).append(r["x"]["doc_id"])
    for s, docs in taken.items():
        hit = F.col("more") & (F.col("source") == s) & F.col("doc_id").isin(docs)
        uses = uses.withColumn("uses", F.when(F.coalesce(hit, F.lit(False)), F.col("uses") + 1).otherwise(F.col("uses")))
    return uses.drop("more")


def _rates(sized: DataFrame, wanted: dict[str, float], repeats: dict[str, int]) -> dict[str, float]:
    """The factor per source that turns weights into expected uses meeting the wanted tokens when uses are capped.

    One pass: sums per source and bucket of the weight's logarithm, a few thousand rows at most however many documents there
    are. A bucket counts as capped where its mean weight is; the tokens are met exactly later, for sampling is cut by them.
    """
    step = F.floor(F.log2("w") * F.lit(WEIGHT_STEPS))
    sums = sized.groupBy("source", step.alias("step")).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("w")).alias("nw")).collect()
    rate = {}
    for s, want in wanted.items():
        rows = sorted(((r["nw"] / r["n"], r["n"], r["nw"]) for r in sums if r["source"] == s), reverse=True)
        free, capped = sum(x[2] for x in rows), 0.0
        for mean, n, nw in rows:  # heaviest first: capped while its uses would exceed the cap
            if want - capped <= 0 or free <= 0 or mean * (want - capped) / free < repeats[s]:
                break
            free, capped = free - nw, capped + n * repeats[s]
        if want > 0 and rows:
            rate[s] = (want - capped) / free if free > 0 and want > capped else repeats[s] / rows[-1][0]
    return rate
