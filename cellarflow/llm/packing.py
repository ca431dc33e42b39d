"""Filling fixed-capacity containers: best fit in every partition, then merging of underfull containers up a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarflow.llm.tokens import DEFAULT_VOCABULARY, encoding
from cellarflow.runtime import materialize

#: A container at least this full is closed where it stands.
NEARLY_FULL = 0.995
#: Groups of containers that one task of the next round merges.
FAN_IN = 8
#: Items that one task packs at a time in the first round, and containers that one task merges at most.
PORTION = 200_000
_PIECE = "kind string, capacity bigint, doc_id bigint, piece_no bigint, token_start bigint, n_tokens bigint, bin string, home bigint, used bigint, lead boolean"


class BestFit:
    """Best fit over whole numbers: an item goes into the fullest open container that still takes it."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.mask, self.by_room, self.used = capacity, 0, {}, []

    def add(self, size: int) -> int:
        """The number of the container that took the item."""
        fits = self.mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = self.by_room[room]
            number = at.pop()
            if not at:
                self.mask ^= 1 << room
        else:
            room, number = self.capacity, len(self.used)
            self.used.append(0)
        self.used[number] += size
        left = room - size
        if left:
            self.by_room.setdefault(left, []).append(number)
            self.mask |= 1 << left
        return number


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Best fit decreasing: the container of each item, and what each container holds. No item may exceed capacity."""
    bins, out = BestFit(capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = bins.add(sizes[i])
    return out, bins.used


def _first_round(kinds: list[tuple[str, int]], vocabulary: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sizes the texts of a partition and packs them by best fit, each kind for itself. bin names the partition, portion
    and container."""

    def pack(doc_ids: list[int], sizes: list[int], name: str, home: int) -> Iterator[pd.DataFrame]:
        for kind, capacity in kinds:
            rows: list[tuple] = []
            rest: list[tuple[int, int, int]] = []
            for doc, size in zip(doc_ids, sizes, strict=True):
                whole = 0 if size <= capacity else size // capacity
                rows += [(doc, k, k * capacity, capacity, f"{name}f{len(rows) + k}", capacity, True) for k in range(whole)]
                if size > whole * capacity or not size:
                    rest.append((doc, whole, size - whole * capacity))
            into, used = best_fit([n for _, _, n in rest], capacity)
            met: set[int] = set()
            for (doc, k, n), b in zip(rest, into, strict=True):
                rows.append((doc, k, k * capacity, n, f"{name}b{b}", used[b], b not in met))
                met.add(b)
            if rows:
                out = pd.DataFrame(rows, columns=["doc_id", "piece_no", "token_start", "n_tokens", "bin", "used", "lead"])
                yield out.assign(kind=kind, capacity=capacity, home=home)[[c.split()[0] for c in _PIECE.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, pid = encoding(vocabulary), TaskContext.get().partitionId()
        docs: list[int] = []
        sizes: list[int] = []
        portion = 0
        for batch in batches:
            docs += batch["doc_id"].tolist()
            sizes += [len(enc.encode_ordinary(t)) for t in batch["text"]]
            if len(docs) >= PORTION:
                yield from pack(docs, sizes, f"{pid}.{portion}.", pid)
                docs, sizes, portion = [], [], portion + 1
        yield from pack(docs, sizes, f"{pid}.{portion}.", pid)

    return run


def _merge(round_no: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        capacity = int(rows["capacity"].iloc[0])
        rows = rows.sort_values(["used", "bin"], ascending=[False, True])
        into, used = best_fit(rows["used"].astype(int).tolist(), capacity)
        home = int(rows["home"].iloc[0])
        parents = [f"r{round_no}.{home}.{rows['part'].iloc[0]}.b{b}" for b in into]
        return pd.DataFrame(
            {"kind": rows["kind"], "capacity": capacity, "bin": rows["bin"], "parent": parents, "used": [used[b] for b in into], "home": home}
        )

    return run


def pack_texts(
    documents: DataFrame,
    kinds: list[tuple[str, int]],
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str = DEFAULT_VOCABULARY,
    nearly_full: float = NEARLY_FULL,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """The container of every text or piece, for each (kind, capacity in tokens):
    container_kind, capacity_tokens, container_id, doc_id, piece_no, token_start, n_tokens, used_tokens.

    A text of at most the capacity goes whole into one container. A longer one is cut at multiples of the capacity, counted in
    tokens of the whole text; every full piece has a container to itself and the remainder is packed like a text, so
    pieces joined by piece_no give the text's tokens again. used_tokens is what the container holds; it never exceeds
    the capacity. A text of no tokens takes a place of size 0. Rows with a null text or id have nothing to pack and are left out.
    Rows that repeat an id are packed each. Empty input gives an empty result.

    Round one packs every input partition where it is read, together with the sizing of its texts, without a shuffle.
    Containers at least nearly_full, and those whose free room is under the smallest size still open in their kind, are
    closed. The others go up a tree as items of their used size: fan_in neighbouring groups merge by best fit in a round.
    A group of more than PORTION containers is merged in parts, and what they leave open again in fewer parts, so its size
    changes the number of rounds and not what meets. Rounds end when one part of one group is left, or none closed any.
    """
    if any(c < 1 for _, c in kinds) or len({k for k, _ in kinds}) != len(kinds):
        raise ValueError("kinds need different names and capacities of at least 1")
    texts = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    pieces = materialize(texts.mapInPandas(_first_round(list(kinds), vocabulary), _PIECE), "pieces")
    closed = F.col("used") >= F.col("capacity") * F.lit(nearly_full)
    open_bins = pieces.where(F.col("lead") & ~closed).select("kind", "capacity", "bin", "home", "used")
    hops: list[DataFrame] = []
    n_open, round_no = open_bins.count(), 0
    while n_open > 1:
        round_no += 1
        smallest = open_bins.groupBy("kind").agg(F.min("used").alias("least"))
        # a container that not even the smallest open one fits into stays as it is
        alive = open_bins.join(F.broadcast(smallest), "kind").where(F.col("used") + F.col("least") <= F.col("capacity")).drop("least")
        grouped = alive.withColumn("home", F.expr(f"home div {fan_in}"))
        load = grouped.groupBy("kind", "home").agg(F.count(F.lit(1)).alias("n"))
        parts = grouped.join(load, ["kind", "home"]).withColumn("part", F.expr(f"pmod(xxhash64(bin), cast(ceil(n / {PORTION}) as bigint))"))
        hop = materialize(
            parts.groupBy("kind", "home", "part").applyInPandas(
                _merge(round_no), "kind string, capacity bigint, bin string, parent string, used bigint, home bigint"
            ),
            "hop",
        )
        hops.append(hop)
        merged = hop.select("kind", "capacity", F.col("parent").alias("bin"), "home", "used").distinct()
        open_bins = materialize(merged.where(~closed), "open")
        now, homes = (open_bins.agg(F.count(F.lit(1)), F.countDistinct("home")).first() or (0, 0))[:2]
        if homes <= 1 and (n_open <= PORTION or now >= n_open):  # all open containers met in one part, or none was filled
            break
        n_open = now

    # the containers of the last round, followed down to the bins of round one: underfull bins only
    def follow(upper: DataFrame, lower: DataFrame) -> DataFrame:
        up = upper.select("kind", F.col("bin").alias("parent"), F.col("parent").alias("higher"), F.col("total").alias("more"))
        met = lower.select("kind", "bin", "parent", F.col("used").alias("total")).join(up, ["kind", "parent"], "left")
        return met.select("kind", "bin", F.coalesce("higher", "parent").alias("parent"), F.coalesce("more", "total").alias("total"))

    home = pieces.withColumns({"container": F.col("bin"), "total": F.col("used")})
    if hops:
        top = hops[-1].select("kind", "bin", "parent", F.col("used").alias("total"))
        path = reduce(follow, reversed(hops[:-1]), top)
        loose = pieces.where(~closed).join(path, ["kind", "bin"], "left")
        loose = loose.withColumns({"container": F.coalesce("parent", "bin"), "total": F.coalesce("total", "used")})
        home = home.where(closed).unionByName(loose.select(*home.columns))
    return home.select(
        F.col("kind").alias("container_kind"), F.col("capacity").alias("capacity_tokens"), F.col("container").alias("container_id"),
        "doc_id", "piece_no", "token_start", "n_tokens", F.col("total").alias("used_tokens"),
    )
