"""Filling fixed-capacity containers: length patterns fitted to the histogram by non-negative least squares, residuals by best fit."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rhythmlake.session import written

#: Most pieces in a pattern, halvings of a container that patterns fill (a container, its halves and its quarters), sweeps of the
#: least-squares fit, and fits of what a fit has left before the rest is packed by best fit.
FEW, HALVINGS, SWEEPS, ROUNDS = 3, 2, 100, 2
#: Pieces ranked together in one task, about.
RANKED = 250_000


@dataclass
class Plan:
    """Kinds of containers: what lengths each holds (length: how many) and how many containers are of the kind."""

    kinds: list[tuple[dict[int, int], int]] = field(default_factory=list)
    #: How many of the kinds, the first ones, come from fitted patterns.
    fitted: int = 0

    def slots(self) -> tuple[np.ndarray, ...]:
        """Sorted arrays (length, first rank, pieces a container, first container): where the pieces of each length go, by rank."""
        used: dict[int, int] = {}
        rows, base = [], 0
        for lengths, n in self.kinds:
            for size, times in lengths.items():
                rows.append((size, used.get(size, 0), times, base))
                used[size] = used.get(size, 0) + times * n
            base += n
        return tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 4

    @property
    def n_containers(self) -> int:
        return sum(n for _, n in self.kinds)

    @property
    def n_fitted(self) -> int:
        return sum(n for _, n in self.kinds[: self.fitted])


def patterns(histogram: np.ndarray, size: int) -> list[dict[int, int]]:
    """All patterns of one to FEW pieces whose lengths occur in the histogram (often enough) and add up to `size`."""
    there = histogram[: size + 1] > 0
    there[0] = False
    lengths = np.flatnonzero(there)
    found = [(size,)] if there[size] else []
    second = lengths[(size - lengths >= lengths) & there[size - lengths]]
    found += zip((size - second).tolist(), second.tolist(), strict=True)
    for a in lengths.tolist():
        b = lengths[(lengths <= a) & (lengths < size - a)]
        c = size - a - b
        fits = (c <= b) & there[c]
        found += ((a, *x) for x in zip(b[fits].tolist(), c[fits].tolist(), strict=True))
    counted = ({k: p.count(k) for k in p} for p in found)
    return [c for c in counted if len(c) == FEW or all(histogram[k] >= m for k, m in c.items())]


def fit(histogram: np.ndarray, columns: list[dict[int, int]], sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative least squares: repeat counts x >= 0 of the patterns that bring their lengths nearest to the histogram.

    Multiplicative updates (Lee and Seung): x *= (A'b) / (A'Ax). The error never grows, and x stays at 0 or above.
    """
    b = histogram.astype(float)
    b[0] = 0
    n = np.array([len(c) for c in columns], dtype=np.int64)
    at = np.fromiter((k for c in columns for k in c), np.int64, n.sum())
    times = np.fromiter((m for c in columns for m in c.values()), float, n.sum())
    of, first = np.repeat(np.arange(len(columns)), n), np.cumsum(n) - n
    x = np.full(len(columns), b.sum() / max(1, len(at)))
    target = np.add.reduceat(times * b[at], first) if len(columns) else x
    for _ in range(sweeps if len(columns) else 0):
        reached = np.bincount(at, weights=times * x[of], minlength=len(b))
        x *= target / np.maximum(np.add.reduceat(times * reached[at], first), 1e-12)
    return x


def paired(blocks: list[tuple[dict[int, int], int]]) -> tuple[list[tuple[dict[int, int], int]], dict[int, int] | None]:
    """Kinds of half containers two by two to kinds of whole ones, and the half that is left over if their number is odd."""
    out, single = [], None
    for kind, n in blocks:
        if single is not None:
            out.append(({k: single.get(k, 0) + kind.get(k, 0) for k in single | kind}, 1))
            single, n = None, n - 1
        if n > 1:
            out.append(({k: 2 * m for k, m in kind.items()}, n // 2))
        single = kind if n % 2 else None
    return out, single


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Pack a histogram: lengths in falling order, each into the open containers with the least room for it; kinds, not single containers."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    room = np.zeros(capacity + 1, dtype=bool)

    def put(kind: dict[int, int], n: int, left: int) -> None:
        open_.setdefault(left, []).append((kind, n))
        room[left] = True

    for size in np.flatnonzero(histogram)[::-1].tolist():
        n = int(histogram[size])
        while n:
            fits = np.flatnonzero(room[size:])
            if len(fits):
                left = size + int(fits[0])
                kind, have = open_[left].pop()
                if not open_[left]:
                    room[left] = False
                times = min(left // size, max(1, n // have)) if n >= have else 1
                take = min(have, n // times)
                if take < have:
                    put(kind, have - take, left)
                put(kind | {size: kind.get(size, 0) + times}, take, left - times * size)
                n -= take * times
            else:
                times = min(capacity // size, n)
                take = n // times
                put({size: times}, take, capacity - times * size)
                n -= take * times
    return [k for kinds in open_.values() for k in kinds]


def plan(histogram: np.ndarray, capacity: int) -> Plan:
    """Fit, round, and pack the residuals. histogram[k]: pieces of length k, k from 0 to capacity.

    Patterns of few pieces fill a container, half of one, or a quarter, without rest; all of them are fitted together. A repeat count is
    rounded up as far as pieces are left; patterns with the longest pieces come first, so short ones remain for the rest. What is left is fitted again, then packed by best fit.
    Halves and quarters make up containers two by two; the pieces of one without a partner go to the rest.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    halvings = next(h for h in range(HALVINGS, -1, -1) if capacity % (1 << h) == 0)
    blocks: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(halvings + 1)]
    for _ in range(ROUNDS):
        columns = [(c, h) for h in range(halvings + 1) for c in patterns(left, capacity >> h)]
        if not columns:
            break
        fitted = fit(left, [c for c, _ in columns])
        rest = left.tolist()
        for p in np.lexsort((-fitted, [-max(c) for c, _ in columns])).tolist():
            column, h = columns[p]
            n = min(int(np.ceil(fitted[p] - 1e-3)), *(rest[k] // m for k, m in column.items()))
            if n > 0:
                blocks[h].append((column, n))
                for k, m in column.items():
                    rest[k] -= m * n
        left = np.array(rest)
    for h in range(halvings, 0, -1):
        whole, single = paired(blocks[h])
        blocks[h - 1] += whole
        for k, m in (single or {}).items():
            left[k] += m
    return Plan(blocks[0] + best_fit(left, capacity), len(blocks[0]))


def _place(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, times, base = slots.value
        key = (size << 44) + first
        for batch in batches:
            n, rank = batch.column("n_tokens").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, (n << 44) + rank, side="right") - 1
            where = np.where(n == 0, 0, base[at] + (rank - first[at]) // times[at]) if len(key) else np.zeros(len(n), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "piece", "n_pieces", "n_tokens")] + [pa.array(where, pa.int64())], ["doc_id", "piece", "n_pieces", "n_tokens", "container"])

    return run


def pieces_of(sizes: DataFrame, capacity: int = 2048, doc_id: str = "doc_id", size: str = "n_tokens") -> tuple[DataFrame, np.ndarray]:
    """The pieces (doc_id, piece, n_pieces, n_tokens) of all items, written once, and the histogram of their lengths (capacity + 1 numbers)."""
    rows = sizes.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"))
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)).cast("int")
    pieces = rows.withColumn("n_pieces", n_pieces).select("doc_id", "n_pieces", "size", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
    pieces = written(pieces.select("doc_id", "piece", "n_pieces", F.least(F.lit(capacity), F.col("size") - F.col("piece").cast("bigint") * capacity).alias("n_tokens")), "pieces")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("n_tokens").count().collect():  # at most capacity + 1 rows
        histogram[row["n_tokens"]] = row["count"]
    return pieces, histogram


def placed(pieces: DataFrame, histogram: np.ndarray, planned: Plan) -> DataFrame:
    """The pieces with their containers. The ranks of a length are given within salts and shifted by the salts before."""
    slots = pieces.sparkSession.sparkContext.broadcast(planned.slots())
    n_salts = int(histogram.max() // RANKED) + 1
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_salts)))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("n_tokens", "salt").agg(F.count("*").alias("n")).select("n_tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("own", own).join(shift, ["n_tokens", "salt"]).withColumn("rank", F.col("shift") + F.col("own") - 1)
    id_type = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "n_pieces", "n_tokens", "rank").mapInArrow(_place(slots), f"doc_id {id_type}, piece int, n_pieces int, n_tokens bigint, container bigint")


def pack(sizes: DataFrame, capacity: int = 2048, doc_id: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Put items into containers: doc_id, piece, n_pieces, n_tokens, container. Numbers of pieces and containers count from 0.

    Only an item larger than `capacity` is split, into full pieces and the rest. Every row is placed, also repeated ones; a size that is
    null or 0 takes no room and lies in container 0. An empty table gives no rows; other columns are ignored.

    What reaches the driver is the histogram of piece lengths, capacity + 1 numbers at most whatever the data. The plan (`plan`)
    says for each length which ranks go where; a length that a third of all items have is spread over many tasks.
    """
    pieces, histogram = pieces_of(sizes, capacity, doc_id, size)
    return placed(pieces, histogram, plan(histogram, capacity))
