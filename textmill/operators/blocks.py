"""Self-joins of rows that hold lists of numbers, met block by block.

Rows are dealt into blocks of a bounded number of items, by size; each pair of blocks whose sizes allow a match is one
group of one task. Pairs of rows that share an item are counted inside the task and go no further unless they may match,
so what is shuffled are the rows, once for each block that theirs meets, and what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.sources.scratch import checkpoint

BLOCK_ITEMS = 8_000_000  # items of a block at most, but for a longer row
LEAST_ITEMS, SOME_BLOCKS = 100_000, 16  # smaller tables are cut into up to so many blocks of at least so many items
CELLS, MATCHES = 4_000_000, 2_000_000  # pairs of rows, and shared items, that are counted at a time
SHARES = 1 << 20
MOST_PARTITIONS = 1000


def in_order(df: DataFrame, *order: str, out: str = "id") -> DataFrame:
    """``df``, written, with ``out``: numbers from 0 on in the given order, as int where they fit."""
    written = checkpoint(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33).alias("__part")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written.groupBy(part).agg(F.count("*").alias("n"))  # one row for each partition
    starts = parts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    number = F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    kind = "int" if written.count() < 1 << 31 else "long"
    return written.withColumn("__part", part).join(F.broadcast(starts), "__part").select(*df.columns, number.cast(kind).alias(out))


def pairs_in_blocks(rows: DataFrame, size: str, items: str, work, schema: str, meets: Callable[[Column, Column], Column], some: int = SOME_BLOCKS) -> DataFrame:
    """What ``work`` finds in each pair of blocks of ``rows``, whose array ``items`` gives their share of a block.

    Smaller tables are cut into up to ``some`` blocks, each row being sent once for each block that its own one meets.

    Blocks follow the order of ``size``, and rows of one size are dealt by a hash; two blocks meet if ``meets(largest,
    smallest)`` allows it for the largest size of the first and the smallest of the second. ``work`` gets the rows of both,
    with ``side`` 0 or 1; a block that meets itself comes once, as side 0.
    """
    per_size = rows.groupBy(size).agg(F.sum(F.size(items).cast("long")).alias("__n"))
    total = per_size.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    most = min(BLOCK_ITEMS, max(LEAST_ITEMS, -(-total // some)))
    before = Window.orderBy(size).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_size.select(size, "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))  # a row for each size
    share = F.pmod(F.xxhash64(items), F.lit(SHARES)) / SHARES
    block = F.floor((F.col("__start") + share * F.col("__n")) / most).cast("long").alias("__block")
    dealt = checkpoint(rows.join(starts, size).select(*rows.columns, block))
    packed = checkpoint(dealt.groupBy("__block").applyInArrow(_packing(items), "__block long, rows binary"))
    blocks = checkpoint(dealt.groupBy("__block").agg(F.min(size).alias("low"), F.max(size).alias("high")))
    a, b = F.col("a.__block"), F.col("b.__block")
    sides = F.array(F.struct(a.alias("__block"), F.lit(0).alias("side")), F.struct(b.alias("__block"), F.lit(1).alias("side")))
    meeting = blocks.alias("a").join(blocks.alias("b"), (a == b) | ((a < b) & meets(F.col("a.high"), F.col("b.low"))))
    meeting = meeting.select(a.alias("__a"), b.alias("__b"), F.inline(F.when(a == b, F.slice(sides, 1, 1)).otherwise(sides)))
    meeting = checkpoint(meeting)
    n = meeting.filter("side = 0").count()
    # pairs of blocks are a small table
    met = packed.join(F.broadcast(meeting), "__block").repartition(max(1, min(2 * n, MOST_PARTITIONS)), "__a", "__b")
    return met.groupBy("__a", "__b").applyInArrow(work, schema)


def _packing(items: str):
    """The rows of a block as compressed tables, one for each batch; items, which ascend, as steps from the item before."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(items)
            flat, starts = lists.flatten().to_numpy(), np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
            steps = np.diff(flat, prepend=flat[:1])
            heads = starts[np.asarray(lists.value_lengths()) > 0]
            steps[heads] = flat[heads]
            offsets = pa.array(np.append(starts, len(flat)).astype(np.int32))
            own = batch.drop_columns(["__block", items])
            table = pa.Table.from_arrays([*own.columns, pa.ListArray.from_arrays(offsets, pa.array(steps))], names=[*own.schema.names, items])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            yield pa.RecordBatch.from_arrays([batch.column("__block")[:1], pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["__block", "rows"])

    return work


def _unpacked(portions: pa.ChunkedArray, items: str) -> pa.Table:
    found = []
    for portion in portions:
        table = pa.ipc.open_stream(portion.as_buffer()).read_all().combine_chunks()
        lists = table[items].combine_chunks()
        steps, counts = lists.flatten().to_numpy(), np.asarray(lists.value_lengths()).astype(np.int64)
        upto = np.cumsum(steps, dtype=np.int64)
        ends = np.cumsum(counts)
        before = np.where(ends > counts, upto[np.maximum(ends - counts - 1, 0)], 0) if len(steps) else np.zeros(len(counts), np.int64)
        flat = (upto - np.repeat(before, counts)).astype(steps.dtype)
        at = table.schema.get_field_index(items)
        found.append(table.set_column(at, items, pa.ListArray.from_arrays(lists.offsets, pa.array(flat))))
    return pa.concat_tables(found)


def meet_in_blocks(left: DataFrame, right: DataFrame, items: str, work, schema: str) -> DataFrame:
    """What ``work`` finds in each pair of a block of ``left`` and one of ``right``, tables with the same columns.

    Rows are dealt by a hash into blocks of about BLOCK_ITEMS items at most. ``work`` gets the rows of both, with ``side`` 0 or 1;
    a block that meets nothing on the other side comes alone.
    """
    sides, numbers = [], []
    # the larger side is cut finely in small tables, too
    for side, some in ((left, SOME_BLOCKS // 4), (right, SOME_BLOCKS)):
        written = checkpoint(side)
        total = written.agg(F.coalesce(F.sum(F.size(items).cast("long")), F.lit(0))).first()[0]
        sides.append(written)
        numbers.append(max(-(-total // BLOCK_ITEMS), min(some, -(-total // LEAST_ITEMS)), 1))
    own = [F.pmod(F.xxhash64(items, "size"), F.lit(n)) for n in numbers]
    every = [F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))) for n in numbers]
    met = sides[0].select("*", F.lit(0).alias("side"), own[0].alias("__a"), every[1].alias("__b")).unionByName(
        sides[1].select("*", F.lit(1).alias("side"), every[0].alias("__a"), own[1].alias("__b"))
    )
    dealt = met.repartition(max(1, min(2 * numbers[0] * numbers[1], MOST_PARTITIONS)), "__a", "__b")
    return dealt.groupBy("__a", "__b").applyInArrow(work, schema)


class Block:
    """Rows with lists of items in ascending order."""

    def __init__(self, table: pa.Table, counts: np.ndarray, items: np.ndarray):
        self.table, self.counts, self.items = table, counts, items
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        self.rows = np.repeat(np.arange(len(self.counts)), self.counts)

    @classmethod
    def of(cls, table: pa.Table, items: str) -> Block:
        lists = table[items].chunks
        counts = np.concatenate([np.asarray(x.value_lengths()) for x in lists] or [np.empty(0)]).astype(np.int64)
        return cls(table, counts, np.concatenate([np.asarray(x.flatten()) for x in lists] or [np.empty(0, np.int32)]))

    def heads(self, counts: np.ndarray) -> Block:
        """The same rows with their first items only."""
        return Block(self.table, counts, self.items[stretches(self.starts, counts)])

    def column(self, name: str) -> np.ndarray:
        return self.table[name].to_numpy()


def both_sides(batches: Iterator[pa.RecordBatch], items: str) -> tuple[Block, Block]:
    """The two blocks of a group; the first one twice where it meets itself."""
    table = pa.Table.from_batches(batches)
    one, two = (table.filter(pc.equal(table["side"], s))["rows"] for s in (0, 1))
    first = Block.of(_unpacked(one, items), items)
    return first, Block.of(_unpacked(two, items), items) if len(two) else first


def stretches(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def sharing_rows(a: Block, b: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, number of items in both), in portions, for all rows with an item in common.

    A block with itself gives each pair once.
    """
    order = np.argsort(b.items, kind="stable")
    items = b.items[order]
    low = np.searchsorted(items, a.items, "left")
    lists = np.searchsorted(items, a.items, "right") - low
    reach = np.concatenate([[0], np.cumsum(lists)])
    edges = reach[np.append(a.starts, len(a.items))]  # matches before each row
    at, n_a, n_b = 0, len(a.counts), max(len(b.counts), 1)
    while at < n_a:
        to = int(np.searchsorted(edges, edges[at] + MATCHES, "right")) - 1
        to = min(max(min(to, at + CELLS // n_b), at + 1), n_a)
        places = np.arange(a.starts[at], a.ends[to - 1])
        from_a = np.repeat(places, lists[places])
        from_b = order[stretches(low[places], lists[places])]
        if a is b:
            once = a.rows[from_a] < b.rows[from_b]
            from_a, from_b = from_a[once], from_b[once]
        key = (a.rows[from_a] - at) * n_b + b.rows[from_b]
        if 16 * len(key) < (to - at) * n_b:
            found, counts = np.unique(key, return_counts=True)
        else:
            counts = np.bincount(key)
            found = np.flatnonzero(counts)
            counts = counts[found]
        yield found // n_b + at, found % n_b, counts
        at = to


def overlaps(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many items rows ``i`` of a and ``j`` of b share, of rows without repeated items."""
    found = np.zeros(len(i), np.int64)
    reach = np.cumsum(a.counts[i] + b.counts[j])
    at, base = 0, 1 + max((int(x.items.max(initial=0)) for x in (a, b)))
    while at < len(i):
        done = reach[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(reach, done + MATCHES, "right")))
        places = np.arange(at, to)
        keys = [np.repeat(places, x.counts[r[at:to]]) * base + x.items[stretches(x.starts[r[at:to]], x.counts[r[at:to]])] for x, r in ((a, i), (b, j))]
        both = np.sort(np.concatenate(keys))
        found[at:to] = np.bincount(both[1:][both[1:] == both[:-1]] // base - at, minlength=to - at)
        at = to
    return found


FREQUENT = 1024  # items of a portion, the most frequent ones, that are counted by a product of matrices
ASKED_ROWS, HELD_ROWS = 512, 4096  # rows of either side that are compared at a time


def shared_tiles(a: Block, b: Block) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(rows of a, rows of b, how many items each two of them share), for all rows, portion by portion of ``b``.

    Items do not repeat in a row. Portions of ``b`` without an item are left out.
    """
    for low in range(0, len(b.counts), HELD_ROWS):
        rows_b = slice(low, min(low + HELD_ROWS, len(b.counts)))
        n_b = rows_b.stop - low
        held, of_b = b.items[b.starts[low] : b.ends[rows_b.stop - 1]], b.rows[b.starts[low] : b.ends[rows_b.stop - 1]] - low
        known, place, times = np.unique(held, return_inverse=True, return_counts=True)
        if not len(known):
            continue
        # the frequent items come first
        rank = np.empty(len(known), np.int64)
        rank[np.argsort(-times, kind="stable")] = np.arange(len(known))
        at = rank[place]
        n_frequent = min(FREQUENT, len(known))
        is_frequent = at < n_frequent
        dense_b = np.zeros((n_frequent, n_b), np.float32)
        dense_b[at[is_frequent], of_b[is_frequent]] = 1
        rare, rare_rows = at[~is_frequent], of_b[~is_frequent]
        order = np.argsort(rare, kind="stable")
        rare_rows, lists = rare_rows[order], np.bincount(rare, minlength=len(known))
        list_starts = np.cumsum(lists) - lists
        for first in range(0, len(a.counts), ASKED_ROWS):
            last = min(first + ASKED_ROWS, len(a.counts))
            asked, of_a = a.items[a.starts[first] : a.ends[last - 1]], a.rows[a.starts[first] : a.ends[last - 1]] - first
            found = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            is_known = known[found] == asked
            asked, of_a = rank[found[is_known]], of_a[is_known]
            is_frequent = asked < n_frequent
            dense_a = np.zeros((last - first, n_frequent), np.float32)
            dense_a[of_a[is_frequent], asked[is_frequent]] = 1
            shared = dense_a @ dense_b
            asked, of_a = asked[~is_frequent], of_a[~is_frequent]
            cells = np.repeat(of_a * n_b, lists[asked]) + rare_rows[stretches(list_starts[asked], lists[asked])]
            np.add.at(shared.reshape(-1), cells, np.float32(1))
            yield slice(first, last), rows_b, shared


def nearest_rows(a: Block, b: Block, size_a: np.ndarray, size_b: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, Jaccard distance): for each row of ``a`` the k nearest rows of ``b`` with an item in common.

    The lower row of ``b`` wins a tie. Items do not repeat in a row; the sizes count items that the other side cannot hold, too.
    """
    bound = np.zeros(len(a.counts), np.float32)  # similarity of the k-th row so far
    best = [np.empty((0, 3))] * (-(-len(a.counts) // ASKED_ROWS))
    for rows, rows_b, shared in shared_tiles(a, b):
        first, low, n, n_b = rows.start, rows_b.start, rows.start // ASKED_ROWS, rows_b.stop - rows_b.start
        both = size_a[rows, None].astype(np.float32) + size_b[rows_b].astype(np.float32)
        similar = shared / (both - shared)
        # a first bound from this portion, drawn down by more than single precision can err
        if n_b > k:
            own = np.partition(similar, n_b - k, axis=1)[:, n_b - k] if low == 0 else bound[rows]
            bound[rows] = np.maximum(bound[rows], own)
        i, j = np.nonzero((similar >= bound[rows, None] - 1e-5) & (shared > 0))
        common, x, y = shared[i, j].astype(np.float64), size_a[i + first], size_b[j + low]
        new = np.column_stack([i, j + low, 1.0 - common / (x + y - common)])
        # rows numbered up to 2 ** 53 are exact as floats
        merged = np.concatenate([best[n], new])
        merged = merged[np.lexsort((merged[:, 1], merged[:, 2], merged[:, 0]))]
        owners = merged[:, 0].astype(np.int64)
        counts = np.bincount(owners, minlength=rows.stop - first)
        nth = np.arange(len(owners)) - np.repeat(np.cumsum(counts) - counts, counts)
        best[n] = merged[nth < k]
        full = best[n][nth[nth < k] == k - 1]
        bound[full[:, 0].astype(np.int64) + first] = (1 - full[:, 2]).astype(np.float32)
    for n, rows in enumerate(best):
        yield rows[:, 0].astype(np.int64) + n * ASKED_ROWS, rows[:, 1].astype(np.int64), np.ascontiguousarray(rows[:, 2])


SKETCH = 256  # parts that the items of a weighted row are dealt into
SKETCHED_ROWS = 512  # rows of either side that are compared at a time
LOOKED_UP = 1 << 17  # items of candidates that are looked up at a time, few enough for a processor's cache
PLACES = 16_000_000  # rows times items whose places are laid out at a time


def _part_lengths(rows: Block, weights: np.ndarray, first: int, last: int) -> np.ndarray:
    """For the rows from ``first`` to ``last`` the length of each part of their items, which go to parts by their numbers."""
    own = slice(rows.starts[first], rows.ends[last - 1])
    cells = (rows.rows[own] - first) * SKETCH + rows.items[own] % SKETCH
    return np.sqrt(np.bincount(cells, weights[own] ** 2, (last - first) * SKETCH)).reshape(-1, SKETCH).astype(np.float32)


def summed(rows: Block, weights: np.ndarray) -> tuple[Block, np.ndarray, np.ndarray]:
    """The rows with each item once, the sums of the weights that it comes with, and the squared length of a row from each item on."""
    new = np.ones(len(rows.items), bool)
    new[1:] = (rows.items[1:] != rows.items[:-1]) | (rows.rows[1:] != rows.rows[:-1])
    at = np.flatnonzero(new)
    one = Block(rows.table, np.bincount(rows.rows[new], minlength=len(rows.counts)), rows.items[new])
    squares = np.add.reduceat(weights**2, at) if len(at) else weights
    upto = np.cumsum(squares)
    return one, np.add.reduceat(weights, at) if len(at) else weights, upto[one.ends - 1][one.rows] - upto + squares


def near_rows(a: Block, b: Block, weights_a: np.ndarray, weights_b: np.ndarray, min_dot: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of a, row of b) whose weights have a dot product, rounded to 9 digits, of at least ``min_dot``, in portions.

    Items ascend in a row, and no weight is negative. A block with itself gives each pair once. The weights of an item that
    repeats add up; as their dot product may then pass that of the lengths, the lengths from the first common item on have to
    reach ``min_dot``, too, as they do by themselves where no item repeats.
    """
    same = a is b
    a, weights_a, tails_a = summed(a, weights_a)
    b, weights_b, tails_b = (a, weights_a, tails_a) if same else summed(b, weights_b)
    known = np.unique(a.items)
    of_a = np.searchsorted(known, a.items)
    of_b = np.minimum(np.searchsorted(known, b.items), max(len(known) - 1, 0))
    of_b = (np.where(known[of_b] == b.items, of_b, len(known)) if len(known) else np.zeros(len(b.items))).astype(np.int32)
    n_items = len(known) + 1  # the last place is for items that a does not hold
    some_a = min(SKETCHED_ROWS, max(16, PLACES // n_items))
    sketches = [(low, _part_lengths(b, weights_b, low, min(low + SKETCHED_ROWS, len(b.counts)))) for low in range(0, len(b.counts), SKETCHED_ROWS)]
    for low_a in range(0, len(a.counts), some_a):
        high_a = min(low_a + some_a, len(a.counts))
        sketch = _part_lengths(a, weights_a, low_a, high_a)
        own = np.arange(a.starts[low_a], a.ends[high_a - 1])
        # where each item of these rows is, from 1 on
        place = np.zeros((high_a - low_a) * n_items, np.int32 if len(a.items) < 1 << 31 else np.int64)
        place[(a.rows[own] - low_a) * n_items + of_a[own]] = own + 1
        for low, held in sketches:
            if same and low + len(held) <= low_a:
                continue
            # more than single precision can err
            i, j = np.divmod(np.flatnonzero(sketch @ held.T >= min_dot - 1e-4), len(held))
            i, j = i + low_a, j + low
            if same:
                i, j = i[i < j], j[i < j]
            reach = np.cumsum(b.counts[j])
            at = 0
            while at < len(i):
                done = reach[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(reach, done + LOOKED_UP, "right")))
                counts = b.counts[j[at:to]]
                places = stretches(b.starts[j[at:to]], counts)
                found = place[np.repeat((i[at:to] - low_a) * n_items, counts) + of_b[places]]
                common = np.flatnonzero(found)
                found, places = found[common] - 1, places[common]
                pair = np.repeat(np.arange(to - at), counts)[common]
                dots = np.bincount(pair, weights_a[found] * weights_b[places], to - at)
                near = np.flatnonzero(np.floor(dots * 1e9 + 0.5) / 1e9 >= min_dot)
                if len(near):
                    first = np.searchsorted(pair, near)
                    near = near[tails_a[found[first]] * tails_b[places[first]] >= min_dot * min_dot - 1e-6] + at
                    yield i[near], j[near]
                at = to
