"""Best items of users by the product of kept factors: numpy within a task, items read by length until none can be among the best."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast

from cellarflow.operators.near_items import packed_lists

#: Values of all items' factors together up to which they are sent to every task, 12 bytes each; beyond that the caller multiplies blocks by a join.
SENT = 32_000_000
#: Users and items multiplied at once; the first items are fewer, for they only set the bounds.
USERS, FIRST, ITEMS = 256, 1024, 8192
_UNIT = 1e9  # scores are compared after rounding to 9 decimals


class Factors:
    """Items by the length of their factors, longest first; items come by id, no are their numbers."""

    def __init__(self, no: np.ndarray, features: np.ndarray) -> None:
        length = np.sqrt(np.square(features.astype(np.float64)).sum(axis=1))
        by = np.argsort(-length, kind="stable")
        self.length, self.place, self.no = length[by], by, no[by]
        self.exact = features[by]
        self.at = np.full(int(no.max()) + 1 if len(no) else 1, -1, np.int64)
        self.at[self.no] = np.arange(len(by))


def best_products(users: np.ndarray, seen_row: np.ndarray, seen_at: np.ndarray, items: Factors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position of the item, score): the k items of each row of users with the greatest products, ties by id, without those seen.

    A product is at most the product of the lengths, so a user is done where that is below their k-th score for the next, shorter items. Products are
    made in single precision and those that come near the bound again in double.
    """
    length = np.sqrt(np.square(users.astype(np.float64)).sum(axis=1))
    row, at, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    bound = np.full(len(users), -np.inf)
    begin, n = 0, len(items.no)
    while begin < n:
        end = min(n, begin + (ITEMS if begin else FIRST))
        slack = 1e-5 * length * items.length[begin] + 2 / _UNIT
        rows = np.flatnonzero(length * items.length[begin] + slack >= bound)
        if not len(rows):
            break
        s = users[rows] @ items.exact[begin:end].T
        where = np.full(len(users), -1)
        where[rows] = np.arange(len(rows))
        here = (seen_at >= begin) & (seen_at < end) & (where[seen_row] >= 0)
        s[where[seen_row[here]], seen_at[here] - begin] = -np.inf
        least = bound[rows]
        if end - begin > k:
            least = np.maximum(least, np.where(np.isneginf(least), np.partition(s, -k, axis=1)[:, -k], -np.inf))
        r, c = np.nonzero((s >= (least - slack[rows])[:, None]) & ~np.isneginf(s))
        r, c = rows[r], c + begin
        exact = np.concatenate([np.einsum("ij,ij->i", users[r[i : i + 200_000]].astype(np.float64), items.exact[c[i : i + 200_000]].astype(np.float64)) for i in range(0, max(1, len(r)), 200_000)])
        row, at, score = np.concatenate([row, r]), np.concatenate([at, c]), np.concatenate([score, exact])
        by = np.lexsort((items.place[at], -np.round(score * _UNIT), row))
        row, at, score = row[by], at[by], score[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        last = rank == k - 1
        bound[row[last]] = score[last]
        row, at, score = row[rank < k], at[rank < k], score[rank < k]
        begin = end
    return row, at, score


def kernel(sent: Broadcast[Factors], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (user_id, features, numbers of the items seen) to PACKED lists of item numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for batch in batches:
            users = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            seen = batch.column(2)
            size = np.where(seen.is_null().to_numpy(zero_copy_only=False), 0, np.diff(seen.offsets.to_numpy())).astype(np.int64)
            until, at = np.append(0, np.cumsum(size)), items.at[seen.flatten().to_numpy()]
            for begin in range(0, batch.num_rows, USERS):
                end = min(batch.num_rows, begin + USERS)
                part = slice(until[begin], until[end])
                row, place, score = best_products(users[begin:end], np.repeat(np.arange(end - begin), size[begin:end]), at[part], items, k)
                yield packed_lists(batch.column(0).slice(begin, end - begin), row, items.no[place], score)

    return run
