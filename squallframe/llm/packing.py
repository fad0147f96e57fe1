"""Packing token pieces into sequences: Martello-Toth dominance reduction, then best fit decreasing.

Only piece lengths decide a packing, and there are at most ``capacity`` different ones. So the
instance is its length histogram, counted by Spark (at most ``capacity`` rows whatever the
corpus holds); the driver packs the histogram into classes of equal sequences, and the executors
place every piece by its rank within its length. No piece passes through the driver.

Reduction (dominance of small feasible sets, applied to whole counts at once): a length that
nothing fits beside stands alone; a pair that fills a sequence is fixed; where at most one more piece
fits, the longest that fits is fixed; where at most two more fit, the pair that no other pair
beats in either member is fixed. What is left is packed best fit decreasing.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Lengths:
    """Counts of pieces by length, with the nearest length at or below, and the least ones above."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: v for k, v in counts.items() if v > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def at_most(self, size: int, without: tuple[int, ...] = ()) -> int | None:
        """Longest length <= size of which a piece is left after ``without`` are taken."""
        at = bisect.bisect_right(self.sizes, size) - 1
        while at >= 0 and self.count[self.sizes[at]] <= without.count(self.sizes[at]):
            at -= 1
        return self.sizes[at] if at >= 0 else None

    def least(self, n: int, above: int = 0, without: tuple[int, ...] = ()) -> list[int]:
        """The n shortest pieces longer than ``above``, after ``without`` are taken."""
        out: list[int] = []
        for at in range(bisect.bisect_right(self.sizes, above), len(self.sizes)):
            size = self.sizes[at]
            out += [size] * min(n - len(out), self.count[size] - without.count(size))
            if len(out) == n:
                break
        return out


def dominating_set(left: Lengths, size: int, capacity: int) -> tuple[int, ...] | None:
    """Pieces that go beside ``size`` in some best packing, or None where no small set dominates."""
    room = capacity - size
    least = left.least(3, without=(size,))
    if not least or least[0] > room:
        return ()
    best = left.at_most(room, (size,))
    if best == room or len(least) == 1 or least[0] + least[1] > room:
        return (best,)
    if len(least) == 3 and sum(least) <= room:
        return None
    second = left.at_most(room - best, (size, best))
    if second is None:  # other pairs may beat the longest piece
        return (best,) if sum(least[:2]) > room else None
    rivals = left.least(2, above=second, without=(size, best))  # a rival pair has both members above the second
    return (best, second) if len(rivals) < 2 or sum(rivals) > room or rivals[0] > best else None


def reduce_by_dominance(left: Lengths, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Fix dominating sets for good: list of (how many sequences, their pieces)."""
    fixed: list[tuple[int, tuple[int, ...]]] = []

    def fix(pieces: tuple[int, ...]) -> None:
        uses = {s: pieces.count(s) for s in pieces}
        n = min(left.count[s] // k for s, k in uses.items())
        fixed.append((n, pieces))
        for s, k in uses.items():
            left.take(s, n * k)

    for size in list(left.sizes)[::-1]:  # pairs that fill a sequence
        if left.count.get(size, 0) and size < capacity and left.count.get(capacity - size, 0) > (2 * size == capacity):
            fix((size, capacity - size))
    for size in list(left.sizes)[::-1]:  # from the longest, as long as small sets dominate
        while left.count.get(size, 0):
            beside = dominating_set(left, size, capacity)
            if beside is None:
                break
            fix((size, *beside))
    return fixed


def best_fit(left: Lengths, capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best fit decreasing over counts: list of (how many sequences, ((length, pieces of it), ...))."""
    rooms: dict[int, list] = {}
    order: list[int] = []

    def put(room: int, n: int, held: tuple) -> None:
        if n:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(order, room)
            rooms[room].append((n, held))

    done: list[tuple[int, tuple]] = []
    for size in left.sizes[::-1]:
        todo = left.count[size]
        while todo:
            at = bisect.bisect_left(order, size)
            if at == len(order):  # open new sequences
                each = capacity // size
                put(capacity - each * size, todo // each, ((size, each),))
                if todo % each:
                    put(capacity - todo % each * size, 1, ((size, todo % each),))
                break
            room = order[at]
            n, held = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            each = room // size
            full, rest = min(n, todo // each), 0
            put(room - each * size, full, (*held, (size, each)))
            todo -= full * each
            if full < n:
                rest = min(todo, each - 1)
                if rest:
                    put(room - rest * size, 1, (*held, (size, rest)))
                    todo -= rest
                put(room, n - full - (rest > 0), held)
    done += [g for room in order for g in rooms[room]]
    return done


def plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Where the pieces of each length go, by rank in their length.

    Columns: length, first (rank the row starts at), each (pieces of it in one sequence), sequence (the
    first of the class), offset (of the first of them). Rows grow with lengths, not with pieces.
    """
    left = Lengths(counts)
    classes = [(n, tuple((s, p.count(s)) for s in sorted(set(p), reverse=True))) for n, p in reduce_by_dominance(left, capacity)]
    classes += best_fit(left, capacity)
    rows, used, sequence = [], {}, 0
    for n, held in classes:
        offset = 0
        for size, each in held:
            rows.append((size, used.get(size, 0), each, sequence, offset))
            used[size] = used.get(size, 0) + n * each
            offset += size * each
        sequence += n
    return pd.DataFrame(rows, columns=["length", "first", "each", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def rank_in_length(pieces: DataFrame, length: str = "length", slots: int = 64) -> DataFrame:
    """0-based ``rank`` of each piece in its length, in two levels so that a common length is no hot key."""
    spread = pieces.withColumn("__slot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slots)).cast("int"))
    before = Window.partitionBy(length).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (spread.groupBy(length, "__slot").agg(F.count(F.lit(1)).alias("n"))
               .select(F.col(length).alias("__l"), F.col("__slot").alias("__s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before")))
    inside = F.row_number().over(Window.partitionBy(length, "__slot").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return (spread.withColumn("__inside", inside)
            .join(offsets, (F.col(length) == F.col("__l")) & (F.col("__slot") == F.col("__s")))
            .withColumn("rank", F.col("__inside") + F.col("__before")).drop("__inside", "__before", "__slot", "__l", "__s"))


def place(ranked: DataFrame, table: pd.DataFrame) -> DataFrame:
    """``sequence_id`` and ``offset`` of every ranked piece."""
    lengths, firsts = table["length"].to_numpy(np.int64), table["first"].to_numpy(np.int64)
    each, sequence, offset = (table[c].to_numpy(np.int64) for c in ("each", "sequence", "offset"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in ranked.schema if f.name != 'rank')}, sequence_id long, offset long"

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spots = np.empty(len(lengths), dtype=[("l", np.int64), ("f", np.int64)])
        spots["l"], spots["f"] = lengths, firsts
        width = int(firsts.max(initial=0)) + 1
        key = lengths * width + firsts if len(lengths) and lengths[-1] < 2**62 // width else None
        for batch in batches:
            size, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            if key is not None:
                row = np.searchsorted(key, size * width + np.minimum(rank, width - 1), side="right") - 1
            else:
                wanted = np.empty(len(size), dtype=spots.dtype)
                wanted["l"], wanted["f"] = size, rank
                row = np.searchsorted(spots, wanted, side="right") - 1
            within = rank - firsts[row]
            yield batch.drop(columns="rank").assign(
                sequence_id=sequence[row] + within // each[row], offset=offset[row] + within % each[row] * size)

    return ranked.mapInPandas(apply, schema)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces (doc_id, piece, ids_crc32, length, ...).

    Pieces have lengths from 1 to ``capacity``. Pieces that tie in all columns share no place: they
    are ranked in any order. An empty table gives no rows.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    return place(rank_in_length(pieces), plan(histogram, capacity))


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Fewest sequences any packing needs: the better of the volume and the half-size bound."""
    volume = -(-sum(k * v for k, v in counts.items()) // capacity)
    return max(volume, sum(v for k, v in counts.items() if 2 * k > capacity))
