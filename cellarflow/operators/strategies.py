"""Strategies: closed-form rankings as DataFrames, matrix factorisation by ALS. All give user_id, item_id, rank, score."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarflow.config import FeatureColumn
from cellarflow.functions.values import as_list
from cellarflow.operators import factor_lists
from cellarflow.operators.near_items import PACKED, best_near, unpacked
from cellarflow.operators.next_items import best_next
from cellarflow.operators.pair_sums import pair_sums
from cellarflow.operators.ranking import days, for_each_user, top_k, union
from cellarflow.runtime import broadcast_if_small, materialize

#: Items of a user that one row holds, about; users with more are split into pieces.
PIECE = 2048
#: Tokens of an item up to which its sets of tokens are listed; items with more are compared token by token.
LISTED_TOKENS = 8
HISTORY = 50
#: Values of a boost or cosine are compared after rounding to so many decimals.
_EXACT = 12


@dataclass
class Coded:
    """Interactions by item number (user_id, item, weight, last_us), and the items' numbers (item_id, item_id_no) in the order of their ids."""

    interactions: DataFrame
    codes: DataFrame

    def numbers(self, items: DataFrame) -> DataFrame:
        """The numbers of these items: item."""
        return self.codes.join(items.select("item_id").distinct(), "item_id", "left_semi").select(F.col("item_id_no").alias("item"))

    def with_names(self, rows: DataFrame, *, merge: bool = False) -> DataFrame:
        """The rows with item_id in place of item; merge joins by sorting, however small the codes are."""
        codes = self.codes.hint("merge") if merge else broadcast_if_small(self.codes, self.codes.count(), 128)
        return rows.join(codes, rows["item"] == codes["item_id_no"]).select(*("item_id" if c == "item" else c for c in rows.columns))

    def with_numbers(self, rows: DataFrame) -> DataFrame:
        """The rows with the item's number for item_id."""
        codes = self.codes.withColumnRenamed("item_id", "_name")
        return rows.join(codes, rows["item_id"] == codes["_name"]).select(*(F.col("item_id_no").alias("item_id") if c == "item_id" else c for c in rows.columns))

    def named(self, lists: DataFrame) -> DataFrame:
        """PACKED lists as rows (user_id, item_id, rank, score)."""
        return self.with_names(unpacked(lists))


def coded_items(interactions: DataFrame, *others: DataFrame) -> Coded:
    """Numbers for the items of the interactions, and of other frames with an item_id."""
    codes = item_codes(interactions, *others)
    return Coded(materialize(interactions.join(codes, "item_id").select("user_id", F.col("item_id_no").alias("item"), "weight", "last_us"), "coded_interactions"), codes)


def item_codes(*frames: DataFrame) -> DataFrame:
    """(item_id, item_id_no) of the items of these frames."""
    return materialize(_dense_ids(union([f.where("item_id is not null").select("item_id").distinct() for f in frames]).distinct(), "item_id", in_order=True), "item_codes")


def popular(interactions: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """The k items with most interactions (one per user), whatever their weight: item_id, rank, score."""
    rows = interactions if allowed is None else interactions.join(allowed.select("item_id").distinct(), "item_id", "left_semi")
    counts = rows.groupBy("item_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    best = counts.orderBy(F.desc("score"), "item_id").limit(k)  # a top-k heap per partition; k rows from here on
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "item_id"))).select("item_id", "rank", "score")


def latest(interactions: DataFrame, k: int, *, window_days: int = 14, not_after_us: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """popular over the interactions of the last window_days before the newest one.

    not_after_us leaves out interactions dated later, so that a clock running ahead cannot shift the window.
    """
    rows = interactions if not_after_us is None else interactions.where(F.col("last_us") <= F.lit(not_after_us))
    newest = rows.agg(F.max("last_us"))
    return popular(rows.where(F.col("last_us") >= newest.scalar() - F.lit(days(window_days))), k, allowed)


def to_users(users: DataFrame, ranking: DataFrame) -> DataFrame:
    return for_each_user(users, ranking)


def item_vectors(interactions: DataFrame) -> DataFrame:
    """(user_id, item_id, n_user, v): sqrt(weight) * (ln items - ln(1 + items of the user)), scaled to length 1 per item."""
    n_items = interactions.agg(F.count_distinct("item_id").cast("double"))
    per_user = interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_user"))
    raw = interactions.join(per_user, "user_id").select(
        "user_id", "item_id", "n_user", (F.sqrt("weight") * (F.ln(n_items.scalar()) - F.log1p(F.col("n_user").cast("double")))).alias("v")
    )
    norms = raw.groupBy("item_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return raw.join(norms, "item_id").where("norm > 0").select("user_id", "item_id", "n_user", (F.col("v") / F.col("norm")).alias("v"))


def item_neighbours(interactions: DataFrame, neighbours: int = 20) -> DataFrame:
    """(item_id, other_id, similarity, place): the most similar items of each item by cosine, itself included.

    Each pair of items of a user is made once and summed within its task, see pair_sums; an item's similarity to itself is 1
    and needs no sum. Items are numbered in the order of their ids, so that sums, ties and the cut work on whole numbers.
    """
    data = coded_items(interactions)
    name = lambda c, n: data.codes.select(F.col("item_id_no").alias(c), F.col("item_id").alias(n))
    near = near_numbers(data, neighbours)
    return near.join(name("key", "item_id"), "key").join(name("item", "other_id"), "item").select("item_id", "other_id", F.col("s").alias("similarity"), "place")


def near_numbers(data: Coded, neighbours: int) -> DataFrame:
    """item_neighbours by number: (key, item, s, place)."""
    vectors = materialize(item_vectors(data.interactions.withColumnRenamed("item", "item_id")), "vectors")
    entries = vectors.select(F.col("user_id").alias("group"), F.col("item_id").alias("item"), "v", F.col("n_user").alias("n_group"))
    largest = vectors.agg(F.coalesce(F.max("n_user"), F.lit(0))).first()[0]
    sums = pair_sums(entries, PIECE, largest)
    pair = lambda x, y: F.struct(F.col(x).alias("key"), F.col(y).alias("item"), "s")
    own = vectors.select(F.col("item_id").alias("key")).distinct().select("key", F.col("key").alias("item"), F.lit(1.0).alias("s"))
    both = sums.select(F.inline(F.array(pair("a", "b"), pair("b", "a")))).unionByName(own)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.round("s", _EXACT - 3)), "item"))
    return both.withColumn("place", place).where(F.col("place") <= neighbours)


def item_based(
    interactions: DataFrame, k: int, *, neighbours: int = 20, users: DataFrame | None = None, allowed: DataFrame | None = None, near: DataFrame | None = None
) -> DataFrame:
    """Scores by the user's items: each touched item gives weight * similarity to its own neighbours; touched items go.

    A touched item reaches at most its neighbours, so the sums grow with interactions * neighbours, however popular an item.
    They are made and cut within the tasks, see near_items; only the interactions are shuffled, and the lists of the less used items where not all
    of them can be sent to every task. users are those to score; near is what item_neighbours gave, where it was kept.
    """
    if near is None:
        data = coded_items(interactions)
        return data.named(item_based_lists(data, k, materialize(near_numbers(data, neighbours), "neighbours"), users=users, allowed=allowed))
    data = coded_items(interactions, near, near.select(F.col("other_id").alias("item_id")))
    number = lambda c, n: data.codes.select(F.col("item_id").alias(c), F.col("item_id_no").alias(n))
    lists = near.join(number("item_id", "key"), "item_id").join(number("other_id", "item"), "other_id").select("key", "item", F.col("similarity").alias("s"))
    return data.named(item_based_lists(data, k, materialize(lists, "neighbours"), users=users, allowed=allowed))


def item_based_lists(data: Coded, k: int, near: DataFrame, *, users: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """item_based as PACKED lists; near has key, item, s."""
    if allowed is not None:
        near = materialize(near.join(data.numbers(allowed), "item", "left_semi"), "near_allowed")
    own = data.interactions if users is None else materialize(data.interactions.join(users, "user_id", "left_semi"), "own")
    return best_near(own.select("user_id", "item", "weight"), near.select("key", "item", "s"), k)


def _prefixed(prefix: str) -> Callable[[Column], Column]:
    return lambda v: F.concat(F.lit(prefix), v)


def item_tokens(items: DataFrame, features: Sequence[FeatureColumn]) -> DataFrame:
    """(item_id, tokens): the different column=value texts of an item; items without any are left out."""
    parts = [
        F.transform(as_list(items, f.column) if f.type == "list" else F.array_compact(F.array(F.col(f.column).cast("string"))), _prefixed(f.column + "="))
        for f in features
        if f.column in items.columns
    ]
    tokens = F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")
    return items.where("item_id is not null").select("item_id", tokens.alias("tokens")).where(F.size("tokens") > 0)


def content_fallback(
    interactions: DataFrame, items: DataFrame, features: Sequence[FeatureColumn], k: int, *, max_rows: int = 50, users: DataFrame | None = None,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """Untouched items for users with a history: the greatest cosine of token sets with one of the user's newest 50 items.

    items must have one row per item_id. A cosine is shared tokens / sqrt(tokens * tokens); items at 0 are left out. A user
    gets at most min(k, max_rows) rows. The history is ordered by time, then item. users are those to score.

    Cosines are found once per different token set of touched items, without pairing sets that share a token: of all
    untouched items that hold a given set of tokens only the first min(k, max_rows) by number of tokens, then id, can be
    among the best of anyone. (An item ahead of another in the list of the tokens that the other shares with a touched item
    has at least its cosine there, and comes first in a tie.) So each touched set meets the short lists of its subsets, and
    a token that a third of all items carry costs no more than any other. Items of more than LISTED_TOKENS tokens have too many
    subsets; pairs with one of them are compared by their shared tokens. A set's list then travels to its users' tasks, see near_items.

    Sets and tokens are numbers from there on, and their joins go by sorting: a written table of token sets is
    small as a file and many times that as rows, so that its size says nothing of what a broadcast would hold.
    """
    data = coded_items(interactions, items)
    return data.with_names(unpacked(content_lists(data, items, features, k, max_rows=max_rows, users=users, allowed=allowed)), merge=True)


def content_lists(
    data: Coded, items: DataFrame, features: Sequence[FeatureColumn], k: int, *, max_rows: int = 50, users: DataFrame | None = None, allowed: DataFrame | None = None
) -> DataFrame:
    """content_fallback as PACKED lists; data must have numbers of all items."""
    take = min(k, max_rows)
    named = item_tokens(items, features)
    tokens = materialize(named.join(data.codes, "item_id").select(F.col("item_id_no").alias("item"), "tokens"), "tokens")
    cold = tokens.join(data.interactions.select("item").distinct(), "item", "left_anti")
    if allowed is not None:
        cold = cold.join(data.numbers(allowed), "item", "left_semi")
    own = data.interactions if users is None else data.interactions.join(users, "user_id", "left_semi")
    recent = materialize(top_k(own, HISTORY, order=(F.desc("last_us"), F.asc("item"))).select("user_id", "item"), "recent")
    of_items = recent.select("item").distinct().hint("merge").join(tokens.hint("merge"), "item").select("item", F.array_sort("tokens").alias("set"))
    sets = materialize(_dense_ids(of_items.select("set").distinct(), "set"), "warm_sets")
    numbers = of_items.hint("merge").join(sets.hint("merge"), "set").select("item", "set_no")
    history = recent.hint("merge").join(numbers.hint("merge"), "item").select("user_id", "set_no").distinct()
    cosine = lambda n, a, b: F.round(n / F.sqrt((a * b).cast("double")), _EXACT)

    codes = materialize(_dense_ids(cold.select(F.explode("tokens").alias("token")).distinct(), "token"), "token_codes")

    def coded(f: DataFrame, name: str, column: str, n: str) -> DataFrame:
        """Each row's number of tokens, and the numbers of those that an untouched item has."""
        each = f.select(name, F.size(column).alias(n), F.explode(column).alias("token")).hint("merge").join(codes.hint("merge"), "token")
        return materialize(each.groupBy(name, n).agg(F.array_sort(F.collect_list("token_no")).alias("codes")), "coded")

    cold, warm = coded(cold, "item", "tokens", "n_cold"), coded(sets, "set_no", "set", "n_warm")
    listed = cold.where(F.col("n_cold") <= LISTED_TOKENS).select("item", "n_cold", F.explode(_subsets("codes")).alias("part"))
    first = materialize(top_k(listed, take, by=("part",), order=(F.asc("n_cold"), F.asc("item"))).select("part", "item", "n_cold"), "first")
    parts = warm.where(F.col("n_warm") <= LISTED_TOKENS).select("set_no", "n_warm", F.explode(_subsets("codes")).alias("part"))
    pairs = _short_lists_met(parts, first, take, cosine)
    if not cold.where(F.col("n_cold") > LISTED_TOKENS).isEmpty() or not warm.where(F.col("n_warm") > LISTED_TOKENS).isEmpty():
        sides = lambda f, *names: f.select(*names, F.explode("codes").alias("token"))
        met = sides(warm, "set_no", "n_warm").hint("merge").join(sides(cold, "item", "n_cold").hint("merge"), "token").where((F.col("n_warm") > LISTED_TOKENS) | (F.col("n_cold") > LISTED_TOKENS))
        shared = met.groupBy("set_no", "n_warm", "item", "n_cold").agg(F.count(F.lit(1)).alias("n"))
        pairs = pairs.unionByName(shared.select("set_no", "item", cosine(F.col("n"), F.col("n_warm"), F.col("n_cold")).alias("score")))
    best = top_k(pairs.groupBy("set_no", "item").agg(F.max("score").alias("score")), take, by=("set_no",), order=(F.desc("score"), F.asc("item")))
    lists = materialize(best.select(F.col("set_no").alias("key"), "item", F.col("score").alias("s")), "lists")  # at most take items a set
    own = materialize(history.select("user_id", F.col("set_no").alias("item"), F.lit(1.0).alias("weight")), "own")
    return best_near(own, lists, take, most=True)


def _short_lists_met(parts: DataFrame, first: DataFrame, take: int, cosine: Callable) -> DataFrame:
    """(set_no, item, score): what the sets' subsets find in the short lists, without what cannot be among a set's first take.

    A list of take items makes take items of a set at least as near as its last one, so lists that begin below the
    highest of these bounds, and items below it, are left out before the lists are joined. Ties with it stay.
    """
    heads = first.groupBy("part").agg(F.min("n_cold").alias("n_first"), F.max("n_cold").alias("n_last"), F.count(F.lit(1)).alias("n_list"))
    to = lambda n: cosine(F.size("part"), F.col("n_warm"), F.col(n))
    met = parts.hint("merge").join(heads.hint("merge"), "part").withColumns({"begins": to("n_first"), "ends": F.when(F.col("n_list") >= take, to("n_last")).otherwise(F.lit(0.0))})
    near = met.withColumn("bound", F.max("ends").over(Window.partitionBy("set_no"))).where("begins >= bound").select("set_no", "n_warm", "part", "bound")
    return near.hint("merge").join(first.hint("merge"), "part").withColumn("score", to("n_cold")).where("score >= bound").select("set_no", "item", "score")


def _subsets(column: str) -> Column:
    """The sets of at least one of the column's tokens, each in the column's order."""
    return F.expr(f"transform(sequence(1, shiftleft(1, size({column})) - 1), m -> filter({column}, (t, i) -> (shiftright(m, i) & 1) = 1))")


def transitions(interactions: DataFrame) -> DataFrame:
    """(from_id, to_id, n): how often a user's next item by last touch, then item, follows an item."""
    w = Window.partitionBy("user_id").orderBy("last_us", "item_id")
    steps = interactions.withColumn("from_id", F.lag("item_id").over(w)).where("from_id is not null")
    return steps.groupBy("from_id", F.col("item_id").alias("to_id")).agg(F.count(F.lit(1)).alias("n"))


def sequential(
    interactions: DataFrame, k: int, *, last: int = 3, fade: float = 0.5, fan_out: int | None = None, users: DataFrame | None = None,
    allowed: DataFrame | None = None, moves: DataFrame | None = None,
) -> DataFrame:
    """Next items by first-order transitions from the user's last items: sum of fade^(position - 1) * n / n_from, unseen only.

    An item leads to all of its next items, or only to its fan_out most frequent ones (ties by id) where that is given, which
    loses scores; n_from counts all of its transitions. Lists of next items are read by weight and only so far as an item of
    theirs may be among the best, see next_items; where even the long lists are too large to be sent to every task, the users'
    last items are joined with all of their next items. users are those to score; moves is what transitions gave, where it was kept.

    A counting baseline, not a neural model: an architecture of that kind needs a library that is not here.
    """
    frames = [] if moves is None else [moves.select(F.col(c).alias("item_id")) for c in ("from_id", "to_id")]
    data = coded_items(interactions, *frames)
    if moves is not None:
        number = lambda c: data.codes.select(F.col("item_id").alias(c), F.col("item_id_no").alias(f"{c}_no"))
        moves = moves.join(number("from_id"), "from_id").join(number("to_id"), "to_id").select(F.col("from_id_no").alias("from_id"), F.col("to_id_no").alias("to_id"), "n")
    return data.named(sequential_lists(data, k, moves, last=last, fade=fade, fan_out=fan_out, users=users, allowed=allowed))


def sequential_lists(
    data: Coded, k: int, moves: DataFrame | None = None, *, last: int = 3, fade: float = 0.5, fan_out: int | None = None, users: DataFrame | None = None,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """sequential as PACKED lists; moves is transitions by number."""
    moves = materialize(move_numbers(data), "moves") if moves is None else moves
    total = moves.groupBy("from_id").agg(F.sum("n").alias("n_from"))
    often = moves if fan_out is None else top_k(moves, fan_out, by=("from_id",), order=(F.desc("n"), F.asc("to_id")))
    odds = often.join(total, "from_id").select("from_id", "to_id", (F.col("n") / F.col("n_from")).alias("p"))
    if allowed is not None:
        odds = odds.join(data.numbers(allowed).withColumnRenamed("item", "to_id"), "to_id", "left_semi")
    odds = materialize(odds.select(F.col("from_id").alias("key"), F.col("to_id").alias("item"), "p"), "odds")
    own = data.interactions.select("user_id", "item", "last_us")
    own = own if users is None else materialize(own.join(users, "user_id", "left_semi"), "own")
    sizes = odds.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    ends = top_k(own, last, order=(F.desc("last_us"), F.desc("item"))).select("user_id", F.col("rank").alias("place"), "item")
    best = best_next(own, ends, odds, sizes, k, fade)
    if best is None:
        reach = ends.join(odds.withColumnRenamed("item", "to"), ends["item"] == odds["key"])
        scored = reach.groupBy("user_id", F.col("to").alias("item")).agg(F.sum(F.pow(F.lit(fade), F.col("place") - 1) * F.col("p")).alias("score"))
        fresh = scored.join(own.select("user_id", "item"), ["user_id", "item"], "left_anti")
        ranked = top_k(fresh, k, order=(F.desc(F.round("score", 9)), F.asc("item")))
        packed = ranked.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item", "score"))).alias("x"))
        best = packed.select("user_id", F.col("x.item").alias("items"), F.col("x.score").alias("scores"))
    return best


def move_numbers(data: Coded) -> DataFrame:
    """transitions by number: (from_id, to_id, n)."""
    return transitions(data.interactions.withColumnRenamed("item", "item_id"))


def fit_collaborative(
    interactions: DataFrame, *, user_features: DataFrame | None = None, item_features: DataFrame | None = None, feature_weight: float = 0.1,
    rank: int = 16, iterations: int = 5, reg: float = 0.05, alpha: float = 10.0, seed: int = 42, blocks: int = 8,
) -> dict[str, DataFrame]:
    """Implicit ALS over interactions and feature edges: users to pseudo-items of their features, pseudo-users to items.

    Gives user_factors (user_id, no, features) and item_factors (item_id, no, features) of real users and items; a user with
    features but no interactions gets factors from them.
    """
    from pyspark.ml.recommendation import ALS

    edges = interactions.select(F.concat(F.lit("u:"), "user_id").alias("u"), F.concat(F.lit("i:"), "item_id").alias("i"), "weight")
    tag = lambda f: F.concat(F.lit("f:"), F.col(f"{f}feature"), F.lit("="), F.col(f"{f}value"))
    if user_features is not None:
        edges = edges.unionByName(user_features.select(F.concat(F.lit("u:"), "id").alias("u"), tag("").alias("i"), F.lit(feature_weight).alias("weight")))
    if item_features is not None:
        edges = edges.unionByName(item_features.select(tag("").alias("u"), F.concat(F.lit("i:"), "id").alias("i"), F.lit(feature_weight).alias("weight")))
    edges = materialize(edges, "edges")
    number = lambda c: materialize(_dense_ids(edges.select(c).distinct(), c), f"ids_{c}")
    us, its = number("u"), number("i")
    coded = edges.join(us, "u").join(its, "i").select(F.col("u_no"), F.col("i_no"), F.col("weight").cast("float"))
    model = ALS(
        userCol="u_no", itemCol="i_no", ratingCol="weight", implicitPrefs=True, rank=rank, maxIter=iterations, regParam=reg, alpha=alpha, seed=seed,
        numUserBlocks=blocks, numItemBlocks=blocks, checkpointInterval=-1,
    ).fit(coded)
    real = lambda ids, c, name: ids.where(f"{c} like '{c}:%'").select(F.col(f"{c}_no").alias("no"), F.expr(f"substring({c}, 3)").alias(name))
    kept = lambda factors, ids, name: factors.join(ids, factors["id"] == ids["no"]).select(name, "no", "features")
    return {"user_factors": kept(model.userFactors, real(us, "u", "user_id"), "user_id"), "item_factors": kept(model.itemFactors, real(its, "i", "item_id"), "item_id")}


def collaborative(
    interactions: DataFrame, k: int, *, users: DataFrame | None = None, allowed: DataFrame | None = None, fitted: dict[str, DataFrame] | None = None,
    unseen: bool = True, **options,
) -> DataFrame:
    """The k items not touched yet (any items, where unseen is false) with the highest scores of implicit ALS; fitted is what fit_collaborative gave, where it was
    kept, else it is fitted with the options here.

    Items not allowed are left out before scoring, and items seen before the cut, so k unseen items remain if there are so many. Factors of items
    are sent to every task and read by length, see factor_lists; where they are too large for that, ALS multiplies all and each user asks for k
    and at least as many as they have seen. users are those to score. Scores are the model's and not comparable with
    other strategies.
    """
    fitted = {n: materialize(f, n) for n, f in fit_collaborative(interactions, **options).items()} if fitted is None else fitted
    items, people = fitted["item_factors"], fitted["user_factors"]
    if allowed is not None:
        items = items.join(allowed.select("item_id").distinct(), "item_id", "left_semi")
    if users is not None:
        people = people.join(users.select("user_id").distinct(), "user_id", "left_semi")
    interactions = interactions if unseen else interactions.limit(0)
    seen = interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    people = materialize(people.join(seen, "user_id", "left").withColumn("n", F.coalesce("n", F.lit(0))), "people")
    items = materialize(items, "real_items")
    n_items, width = items.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    most = people.agg(F.max("n")).first()[0]
    if not n_items or most is None:
        return top_k(interactions.select("user_id", "item_id", F.lit(0.0).alias("score")).limit(0), k).select("user_id", "item_id", "rank", "score")
    if n_items * width <= factor_lists.SENT:
        rows = items.orderBy("item_id").select("no", "features").toArrow()  # in the order of ids, by which ties go
        features = rows.column("features").combine_chunks().flatten().to_numpy().reshape(n_items, width)
        sent = people.sparkSession.sparkContext.broadcast(factor_lists.Factors(rows.column("no").to_numpy(), features))
        met = interactions.join(items.select("item_id", "no"), "item_id").groupBy("user_id").agg(F.collect_list("no").alias("seen"))
        best = unpacked(people.join(met, "user_id", "left").select("user_id", "features", "seen").mapInArrow(factor_lists.kernel(sent, k), PACKED))
        names = broadcast_if_small(items.select(F.col("no").alias("item"), "item_id"), n_items, 128)
        return best.join(names, "item").select("user_id", "item_id", "rank", "score")
    scorer = _als_model(width, people, items)
    low, high, bands = -1, 16, []
    while low < most:  # a user of a band asks for k and as many as anyone in it has seen: a few bands up to the most
        own = people.where((F.col("n") > low) & (F.col("n") <= high)).select(F.col("no").alias("u_no"))
        bands.append(scorer.recommendForUserSubset(own, min(n_items, k + min(high, most))))
        low, high = high, high * 4
    found = union(bands).select("u_no", F.inline("recommendations"))
    named = found.join(people.select(F.col("no").alias("u_no"), "user_id"), "u_no").join(items.select(F.col("no").alias("i_no"), "item_id"), "i_no")
    fresh = named.select("user_id", "item_id", F.col("rating").cast("double").alias("score")).join(interactions.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return top_k(fresh, k).select("user_id", "item_id", "rank", "score")


def collaborative_epochs(interactions: DataFrame, k: int, epochs: Sequence[int], *, max_users: int = 2000, **options) -> list[tuple[int, dict[str, float]]]:
    """Precision and recall at k on the interactions themselves after so many iterations each, to watch a fit by.

    Measured over at most max_users users, the first by a hash of their id. The fit starts from a seed, so one of e iterations is
    the beginning of a longer one; each is made anew, which costs the sum of the epochs in iterations.
    """
    from cellarflow.operators.evaluate import mean_metrics

    users = materialize(interactions.select("user_id").distinct().orderBy(F.xxhash64("user_id"), "user_id").limit(max_users), "watched")
    truth = interactions.join(users, "user_id", "left_semi")
    out = []
    for e in epochs:
        row = mean_metrics(collaborative(interactions, k, users=users, unseen=False, iterations=e, **options), truth, k).first()
        out.append((e, {f"Precision@{k}": row["precision"], f"Recall@{k}": row["recall"]}))
    return out


def _als_model(width: int, users: DataFrame, items: DataFrame):
    """An ALS model of kept factors, with these items only, so that no other item takes a place in its lists."""
    from pyspark.ml.recommendation import ALSModel

    sides = [f.select(F.col("no").alias("id"), "features")._jdf for f in (users, items)]
    java = users.sparkSession._jvm.org.apache.spark.ml.recommendation.ALSModel("kept", width, *sides)
    return ALSModel(java.setUserCol("u_no").setItemCol("i_no"))


def _dense_ids(ids: DataFrame, name: str, *, in_order: bool = False) -> DataFrame:
    """Whole numbers from 0 for different ids, by counts per partition: no global sort in one task. in_order numbers them by
    value, over range partitions."""
    spread = ids.repartitionByRange(name).sortWithinPartitions(name) if in_order else ids
    parts = materialize(spread.select(name, F.monotonically_increasing_id().alias("_n")), "numbering")
    part = F.shiftright("_n", 33)  # the partition; the lower bits count its rows
    per = parts.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("c"))
    base = per.withColumn("base", F.sum("c").over(Window.orderBy("_part")) - F.col("c"))  # one row per partition
    return parts.join(F.broadcast(base), part == F.col("_part")).select(name, (F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("base")).cast("int").alias(f"{name}_no"))


REGISTRY: dict[str, Callable] = {}


def register(name: str, strategy: Callable, *, replace: bool = False) -> None:
    if name in REGISTRY and not replace:
        raise ValueError(f"strategy {name} is registered already")
    REGISTRY[name] = strategy


for _name, _f in {"popular": popular, "latest": latest, "item_based": item_based, "content_fallback": content_fallback, "sequential": sequential, "collaborative": collaborative}.items():
    register(_name, _f)
