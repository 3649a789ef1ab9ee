"""The total order of results: score down, then id up; truncation only after ordering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores are compared after rounding to so many places, so that the order of additions cannot move a rank.
PLACES = 9


def finite(score: Column) -> Column:
    """The score, or an error where it is not a finite number (Spark would rank NaN first)."""
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a score is not finite")).cast("double")).otherwise(score)


def top_n(scored: DataFrame, n: int, by: str = "score", keys: tuple[str, ...] = ("query_id",), id_col: str = "chunk_id", rank: str = "rank") -> DataFrame:
    """The n best rows of each key with their rank from 1; Spark prunes in each task before the shuffle."""
    if n < 1:
        raise ValueError("n is at least 1")
    order = Window.partitionBy(*keys).orderBy(F.round(F.col(by), PLACES).desc(), F.col(id_col).asc())
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)


#: Scores of a block of rows and all queries that a task holds at once.
CELLS = 4_000_000


def rounded(score: np.ndarray) -> np.ndarray:
    """Scores as top_n compares them: a half goes away from zero, as in SQL, not to the even neighbour."""
    return np.trunc(score * 10.0**PLACES + np.copysign(0.5, score)) / 10.0**PLACES


class Best:
    """The n best rows of each query that a task has met, in the total order, so that only these are shuffled."""

    def __init__(self, queries: list | pa.Array, n: int) -> None:
        self.queries, self.n = queries if isinstance(queries, pa.Array) else pa.array(queries), n
        self.floor = np.full(len(queries), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.size = 0

    def add(self, ids: pa.Array, score: np.ndarray, valid: np.ndarray | None = None) -> None:
        """A block of scores, a row for each id and a column for each query; valid leaves some of them out."""
        if valid is not None:
            score = np.where(valid, score, -np.inf)
        if len(score) >= self.n:
            self.floor = np.maximum(self.floor, rounded(np.partition(score, -self.n, axis=0)[-self.n]))
        # all that may round to the floor, of which the few left are rounded
        row, query = np.nonzero(score >= self.floor - 10.0**-PLACES)
        own = score[row, query]
        kept = (rounded(own) >= self.floor[query]) & (own > -np.inf)
        row, query, own = row[kept], query[kept], own[kept]
        if not len(row):
            return
        self.held.append((query, own, ids.take(pa.array(row))))
        self.size += len(row)
        if self.size > 4 * self.n * len(self.queries) + 100_000:
            self._prune()

    def _prune(self) -> None:
        if not self.held:
            return
        query, score = (np.concatenate([h[i] for h in self.held]) for i in range(2))
        ids = pa.concat_arrays([h[2] for h in self.held])
        order = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
        order = order[np.lexsort((-rounded(score[order]), query[order]))]
        sorted_ = query[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_, sorted_, side="left")
        full = order[rank == self.n - 1]
        self.floor[query[full]] = rounded(score[full])
        order = order[rank < self.n]
        self.held, self.size = [(query[order], score[order], ids.take(pa.array(order)))], len(order)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self._prune()
        for query, score, ids in self.held:
            yield pa.RecordBatch.from_arrays([self.queries.take(pa.array(query)), ids, pa.array(score)], names=["query_id", "chunk_id", "score"])


class RankingError(ValueError):
    """A ranking that is none: an id twice, or an id that nothing has."""


def checked(scored: DataFrame, keys: tuple[str, ...] = ("query_id", "chunk_id")) -> DataFrame:
    """A ranking from outside the engine, if it has each of its keys once."""
    twice = duplicates(scored, keys).limit(5).collect()
    if twice:
        raise RankingError("twice in a ranking: " + "; ".join(" / ".join(str(r[k]) for k in keys) for r in twice))
    return scored


def duplicates(scored: DataFrame, keys: tuple[str, ...] = ("query_id", "chunk_id")) -> DataFrame:
    """Keys that a ranking has more than once: a ranking must have none."""
    return scored.groupBy(*keys).count().where("count > 1")
