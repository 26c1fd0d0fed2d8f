"""Substring deduplication: bytes that a string of SPAN bytes covers which an earlier document holds too.

Every string of SPAN bytes holds an anchor: a string of ANCHOR bytes whose hash is the least of all that
the SPAN bytes hold. Anchors depend on the content alone, so equal strings meet at equal anchors. Only
anchors that two documents hold go on, each with the bytes around it, enough for every string of SPAN
bytes that holds it. Where an anchor's surroundings differ, all these strings are put in order by
deep-shallow sorting, and the least document of equal strings decides.

Texts travel in bundles of documents. Shuffles carry hashes of anchors, once for each bundle, and the
surroundings, once for each bundle that repeats them. Anchors in very many documents or places do not meet
in one task: their strings are counted one by one, as a plain aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.chunks import pieces, text_bytes
from textmill.llm.common import partitions, table
from textmill.llm.registry import query
from textmill.llm.suffixes import deep_shallow
from textmill.llm.words import mix
from textmill.sources.scratch import checkpoint

SPAN = 50
ANCHOR = 26
AROUND = SPAN - ANCHOR  # bytes to either side of an anchor
STARTS = AROUND + 1  # strings of SPAN bytes that hold an anchor
CONTEXT = SPAN + AROUND
BUNDLE_BYTES = 2 << 20  # text of a bundle; a longer text is a bundle by itself
RANGE_BUNDLES = 8  # a range of hashes gets as many anchors as so many bundles hold, so that its task's memory does not grow with the table
HOT_DOCUMENTS = 500_000  # an anchor that more documents hold is hot
HOT_PLACES = 500_000  # and one in more places, as in runs of one byte, where each position is an anchor
AT_A_TIME = 1 << 16  # places whose surroundings are laid out at once
LATER = np.iinfo(np.int64).max

BUNDLES = "bundle long, ids array<long>, sizes array<long>, texts binary"


def bundle(documents: DataFrame) -> DataFrame:
    """``documents(doc_id, text)`` in bundles, the texts compressed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in pieces(batches, "text", BUNDLE_BYTES):
            offsets, data = text_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number]),
                    pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([np.diff(offsets)], pa.list_(pa.int64())),
                    pa.array([zstandard.compress(data.tobytes())], pa.binary()),
                ],
                names=["bundle", "ids", "sizes", "texts"],
            )
            number += 1

    return documents.mapInArrow(work, BUNDLES)


class Bundle:
    """The documents of a row of ``BUNDLES``; ``order`` is LATER for a null id, which takes no part."""

    def __init__(self, ids, sizes, texts: bytes):
        self.ids = ids
        self.order = np.array([LATER if i is None else i for i in ids], np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.edges = np.concatenate([[0], np.cumsum(self.sizes)])
        self.data = np.frombuffer(zstandard.decompress(texts, max_output_size=int(self.edges[-1])) if self.edges[-1] else b"", np.uint8)

    @classmethod
    def of(cls, batch, row: int) -> Bundle:
        return cls(*(batch.column(c)[row].as_py() for c in ("ids", "sizes", "texts")))

    def anchors(self, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions in the bundle, documents, hashes) of the anchors of all documents but ``skip``."""
        at = anchors(self.data, self.edges)
        doc = np.searchsorted(self.edges, at, side="right") - 1
        taken = (self.order != LATER) & ~skip
        kept = taken[doc]
        return at[kept], doc[kept], anchor_hashes(self.data, at[kept])


def _doubled(values: np.ndarray, width: int, join) -> np.ndarray:
    """join over values[i : i + width] for each i that has so many."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = join(values[: len(values) - step], values[step:])
        have += step
    return values


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """32 bits of a polynomial hash of the ANCHOR bytes from each position on, at least 1."""
    base, parts = 0x9E3779B97F4A7C15 | 1, {1: data.astype(np.uint64) + np.uint64(1)}
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    while 2 * max(parts) <= ANCHOR:
        n = max(parts)
        parts[2 * n] = parts[n][: len(parts[n]) - n] * power(n) + parts[n][n:]
    out, have = None, 0
    for n in sorted(parts, reverse=True):
        if have + n <= ANCHOR:
            part = parts[n][have:]
            out = part if out is None else out[: len(part)] * power(n) + part[: len(out)]
            have += n
    return ((out * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def anchors(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Positions whose hash is the least of any SPAN bytes within one document that hold them."""
    if len(data) < SPAN:
        return np.empty(0, np.int64)
    grams = _gram_hashes(data)
    least = _doubled(grams, STARTS, np.minimum)  # for the SPAN bytes from each position on
    # strings of SPAN bytes must not leave their document
    for edge in edges[1:-1].tolist():
        least[max(0, edge - SPAN + 1) : edge] = 0
    # the highest of the minima of all strings that hold a gram is the gram's own hash if it is the least of one
    around = np.concatenate([np.zeros(AROUND, np.uint32), least, np.zeros(AROUND, np.uint32)])
    return np.flatnonzero(_doubled(around, STARTS, np.maximum) == grams)


def anchor_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits of the ANCHOR bytes at each position."""
    out = np.zeros(len(at), np.uint64)
    for j in range(0, ANCHOR, 2):
        pair = data[at + j].astype(np.uint64) << np.uint64(8) | data[at + j + 1]
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + pair + np.uint64(1)) if j % 8 == 0 else out * np.uint64(0x9FB21C651E98DF25) + pair + np.uint64(1)
    return mix(out)


def _ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _packed(numbers: np.ndarray, kind: str) -> bytes:
    """Numbers with their high bytes together, compressed."""
    width = np.dtype(kind).itemsize
    return zstandard.compress(np.ascontiguousarray(numbers.astype(kind)).view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal values."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.diff(values, prepend=values[0] - 1))
    return starts, np.append(starts[1:], len(values))


def _rows(schema: list[str], rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema)


def _offer(n_ranges: int):
    """(part, bundle, numbers, held, places): the distinct anchors of each bundle by range of hashes, how many documents hold them, and in how many places."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = Bundle.of(batch, i)
                _, doc, hashes = own.anchors(np.zeros(len(own.sizes), bool))
                part, number = _ranges(hashes, n_ranges), (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64)
                order = np.lexsort((doc, number, part))
                part, number, doc = part[order], number[order], doc[order]
                starts, ends = _runs(part * (1 << 32) + number)
                # documents are in order within a run: count where they change
                new = np.diff(doc, prepend=-1) != 0
                new[starts] = True
                held = np.minimum(np.add.reduceat(new, starts), 0xFFFF) if len(starts) else starts
                part, number, places = part[starts], number[starts], ends - starts
                rows = [
                    (int(part[a]), batch.column("bundle")[i].as_py(), _packed(number[a:b], "<u4"), _packed(held[a:b], "<u2"), _packed(places[a:b], "<u4"))
                    for a, b in zip(*_runs(part), strict=True)
                ]
                yield _rows(["part", "bundle", "numbers", "held", "places"], rows, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])

    return work


def _shared(hot_documents: int, hot_places: int):
    """Per range what each bundle's anchors share with another document, and which of them are hot."""

    def work(key, group):
        bundles = group["bundle"].to_numpy()
        numbers = [_unpacked(x, "<u4") for x in group["numbers"].to_pylist()]
        flat, inverse = np.unique(np.concatenate(numbers), return_inverse=True)
        total = lambda c, kind: np.bincount(inverse, weights=np.concatenate([_unpacked(x, kind) for x in group[c].to_pylist()]))
        held = total("held", "<u2")
        shared, hot = held > 1, (held > hot_documents) | (total("places", "<u4") > hot_places)
        rows, at = [], 0
        for b, own in zip(bundles.tolist(), numbers, strict=True):
            where = inverse[at : at + len(own)]
            at += len(own)
            kept = shared[where]
            if kept.any():
                flags = hot[where][kept]
                rows.append((b, int(key[0].as_py()), _packed(own[kept], "<u4"), _packed(flags, "u1"), bool(flags.any())))
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
        return pa.Table.from_batches([_rows(["bundle", "part", "numbers", "hot", "any_hot"], rows, types)])

    return work


SHARED = "bundle long, part long, numbers binary, hot binary, any_hot boolean"
CONTEXTS = "part long, bundle long, contexts binary, least binary, which binary, docs binary, orders binary, starts binary"
KINDS = {"least": "<i8", "which": "<u4", "docs": "<u4", "orders": "<i8", "starts": "<u4"}
WINDOWS = "bundle long, doc int, own long, begin int, end int, one long, two long"


def _chosen(own: Bundle, copies: list, replies: pa.Table, n_ranges: int, hot: bool):
    """(position, document, range) of the anchors that the replies name, hot ones or all others."""
    skip = np.zeros(len(own.sizes), bool)
    skip[[int(c) for c in copies]] = True
    at, doc, hashes = own.anchors(skip)
    part, number = _ranges(hashes, n_ranges), (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64)
    named = [np.empty(0, np.int64)]
    for p, numbers, flags in zip(replies["part"].to_pylist(), replies["numbers"].to_pylist(), replies["hot"].to_pylist(), strict=True):
        numbers = _unpacked(numbers, "<u4").astype(np.int64)
        is_hot = _unpacked(flags, "u1").astype(bool)
        named.append(p * (1 << 32) + numbers[is_hot == hot])
    kept = np.isin(part * (1 << 32) + number, np.concatenate(named))
    return at[kept], doc[kept], part[kept]


def _contexts_of(own: Bundle, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The bytes around each anchor, then how many of them to the left and to the right are its document's."""
    left = np.minimum(AROUND, at - own.edges[doc])
    right = np.minimum(AROUND, own.edges[doc + 1] - at - ANCHOR)
    out = np.empty((len(at), CONTEXT + 2), np.uint8)
    place = np.arange(CONTEXT)
    out[:, :CONTEXT] = own.data[np.clip(at[:, None] - AROUND + place, 0, len(own.data) - 1)]
    out[:, :CONTEXT][(place < AROUND - left[:, None]) | (place >= AROUND + ANCHOR + right[:, None])] = 0
    out[:, CONTEXT], out[:, CONTEXT + 1] = left, right
    return out


def _distinct(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each distinct row, number of the distinct row of each row)."""
    if not len(contexts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # numpy drops zeros at the end of byte strings; a last byte of one keeps them
    whole = np.ascontiguousarray(np.concatenate([contexts, np.ones((len(contexts), 1), np.uint8)], axis=1)).view(f"S{contexts.shape[1] + 1}").reshape(-1)
    _, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
    return first, inverse.reshape(-1)


def _distinct_contexts(own: Bundle, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct contexts, number of the context of each anchor); few anchors are laid out at a time."""
    kept, which, n = [np.empty((0, CONTEXT + 2), np.uint8)], [np.empty(0, np.int64)], 0
    for a in range(0, len(at), AT_A_TIME):
        some = _contexts_of(own, at[a : a + AT_A_TIME], doc[a : a + AT_A_TIME])
        first, local = _distinct(some)
        kept.append(some[first])
        which.append(local + n)
        n += len(first)
    flat = np.concatenate(kept)
    first, again = _distinct(flat)
    return flat[first], again[np.concatenate(which)]


def _surround(n_ranges: int):
    """Cogroup of a bundle with its copies and replies: its shared anchors with their surroundings, by range."""

    def work(bundles: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        if bundles.num_rows and replies.num_rows:
            own = Bundle.of(bundles, 0)
            at, doc, part = _chosen(own, bundles["copies"][0].as_py() or [], replies, n_ranges, False)
            order = np.argsort(part, kind="stable")
            at, doc, part = at[order], doc[order], part[order]
            for a, b in zip(*_runs(part), strict=True):
                contexts, which = _distinct_contexts(own, at[a:b], doc[a:b])
                least = np.full(len(contexts), LATER)
                np.minimum.at(least, which, own.order[doc[a:b]])
                start = at[a:b] - own.edges[doc[a:b]]
                whole = zstandard.compress(contexts.tobytes(), 1)
                arrays = zip((least, which, doc[a:b], own.order[doc[a:b]], start), KINDS.values(), strict=True)
                rows.append((int(part[a]), bundles["bundle"][0].as_py(), whole, *(_packed(x, kind) for x, kind in arrays)))
        names = ["part", "bundle", "contexts", "least", "which", "docs", "orders", "starts"]
        return pa.Table.from_batches([_rows(names, rows, [pa.int64(), pa.int64()] + [pa.binary()] * 6)])

    return work


def least_documents(contexts: np.ndarray, least: np.ndarray) -> np.ndarray:
    """(contexts, STARTS): the least document that holds each string of SPAN bytes; LATER where there is none.

    Contexts are distinct. One whose anchor no other has decides alone; the strings of all others are
    ordered, and equal ones take the least document of all.
    """
    place = np.arange(STARTS)
    left, right = contexts[:, CONTEXT].astype(np.int64), contexts[:, CONTEXT + 1].astype(np.int64)
    whole = (place >= AROUND - left[:, None]) & (place <= right[:, None])
    out = np.where(whole, least[:, None], LATER)
    anchor = np.ascontiguousarray(contexts[:, AROUND : AROUND + ANCHOR])
    _, group = _distinct(anchor)
    met = np.bincount(group)[group] > 1 if len(group) else np.empty(0, bool)
    row, start = np.nonzero(whole & met[:, None])
    if len(row):
        strings = np.lib.stride_tricks.sliding_window_view(contexts[:, :CONTEXT], SPAN, axis=1)[row, start]
        order, first = deep_shallow(strings)
        owners = least[row]
        best = np.full(len(row), LATER)
        np.minimum.at(best, first, owners)
        out[row, start] = best[first]
    return out


def _decide(key, group):
    """All surroundings of a range: the stretches of each document that an earlier one holds."""
    read = lambda c: [_unpacked(x, KINDS[c]) for x in group[c].to_pylist()]
    contexts = [np.frombuffer(zstandard.decompress(x), np.uint8).reshape(-1, CONTEXT + 2) for x in group["contexts"].to_pylist()]
    flat = np.concatenate(contexts)
    first, which = _distinct(flat)
    best = np.full(len(first), LATER)
    np.minimum.at(best, which, np.concatenate(read("least")))
    known = least_documents(flat[first], best)
    rows, at = [], 0
    names = ("which", "docs", "orders", "starts")
    for bundle, n, *own in zip(group["bundle"].to_pylist(), map(len, contexts), *map(read, names), strict=True):
        here = which[at : at + n]
        at += n
        for a in range(0, len(own[0]), AT_A_TIME):
            local, docs, orders, starts = (x[a : a + AT_A_TIME] for x in own)
            earlier = known[here[local]] < orders[:, None]
            some = np.flatnonzero(earlier.any(axis=1))
            # strings of SPAN bytes that hold one anchor overlap, so they cover one stretch
            begin = starts[some].astype(np.int64) - AROUND + earlier[some].argmax(axis=1)
            end = starts[some].astype(np.int64) + STARTS - earlier[some][:, ::-1].argmax(axis=1) - 1 - AROUND + SPAN
            if len(some):
                rows.append((bundle, *(_packed(x, "<u4") for x in (docs[some], begin, end))))
    return pa.Table.from_batches([_rows(["bundle", "docs", "begins", "ends"], rows, [pa.int64()] + [pa.binary()] * 3)])


MARKS = "bundle long, docs binary, begins binary, ends binary"


def _starts_with(own: Bundle, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Starts in the bundle of the strings of SPAN bytes that hold an anchor at ``at``, each once."""
    first, last = np.maximum(at - AROUND, own.edges[doc]), np.minimum(at, own.edges[doc + 1] - SPAN)
    some = first <= last
    steps = np.bincount(first[some], minlength=len(own.data) + 1).astype(np.int32)
    steps -= np.bincount(last[some] + 1, minlength=len(own.data) + 1).astype(np.int32)
    return np.flatnonzero(np.cumsum(steps[:-1]) > 0)


def _hot_windows(n_ranges: int):
    """Each string of SPAN bytes that holds a hot anchor, by two hashes, once for each stretch of a document that its places cover."""

    def work(bundles: pa.Table, replies: pa.Table) -> pa.Table:
        types = {"bundle": pa.int64(), "doc": pa.int32(), "own": pa.int64(), "begin": pa.int32(), "end": pa.int32(), "one": pa.int64(), "two": pa.int64()}
        found = [pa.table({c: pa.array([], t) for c, t in types.items()})]
        if bundles.num_rows and replies.num_rows:
            own = Bundle.of(bundles, 0)
            at, doc, _ = _chosen(own, bundles["copies"][0].as_py() or [], replies, n_ranges, True)
            starts = _starts_with(own, at, doc)
            for a in range(0, len(starts), AT_A_TIME):
                start = starts[a : a + AT_A_TIME]
                doc = np.searchsorted(own.edges, start, side="right") - 1
                one, two = (np.zeros(len(start), np.uint64) for _ in range(2))
                for j in range(SPAN):
                    byte = own.data[start + j].astype(np.uint64)
                    one, two = mix(one * np.uint64(3) + byte + np.uint64(1)), mix(two * np.uint64(5) + byte + np.uint64(977))
                order = np.lexsort((start, two, one, doc))
                start, doc, one, two = start[order], doc[order], one[order], two[order]
                # places of a string that overlap or touch cover one stretch
                new = np.ones(len(start), bool)
                new[1:] = (np.diff(doc) != 0) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (np.diff(start) > SPAN)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(start)) - 1
                doc, base = doc[first], own.edges[doc[first]]
                columns = (
                    np.full(len(first), bundles["bundle"][0].as_py()), doc.astype(np.int32), own.order[doc], (start[first] - base).astype(np.int32),
                    (start[last] - base + SPAN).astype(np.int32), one[first].view(np.int64), two[first].view(np.int64),
                )
                found.append(pa.table(dict(zip(types, map(pa.array, columns), strict=True))))
        return pa.concat_tables(found).combine_chunks()

    return work


def _mark_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bundles = batch.column("bundle").to_numpy()
        order = np.argsort(bundles, kind="stable")
        marks = [batch.column(c).to_numpy()[order] for c in ("doc", "begin", "end")]
        rows = [(int(bundles[order[a]]), *(_packed(x[a:b], "<u4") for x in marks)) for a, b in zip(*_runs(bundles[order]), strict=True)]
        yield _rows(["bundle", "docs", "begins", "ends"], rows, [pa.int64()] + [pa.binary()] * 3)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _finish(with_bytes: bool):
    """Cogroup of a bundle with its marks: what is removed of each document, and what is left."""

    def work(bundles: pa.Table, marks: pa.Table) -> pa.Table:
        rows = []
        if bundles.num_rows:
            own = Bundle.of(bundles, 0)
            read = lambda c: np.concatenate([np.empty(0, np.uint32), *(_unpacked(x, "<u4") for x in marks[c].to_pylist())]).astype(np.int64)
            docs, begins, ends = read("docs"), read("begins"), read("ends")
            steps = np.zeros(len(own.data) + 1, np.int64)
            np.add.at(steps, own.edges[docs] + begins, 1)
            np.add.at(steps, own.edges[docs] + ends, -1)
            gone = np.cumsum(steps[:-1]) > 0
            for c in bundles["copies"][0].as_py() or []:
                if own.sizes[c] >= SPAN:
                    gone[own.edges[c] : own.edges[c + 1]] = True
            for i, (a, b) in enumerate(zip(own.edges[:-1], own.edges[1:], strict=True)):
                out = gone[a:b]
                kept = own.data[a:b][~out].tobytes()
                spans = int((np.diff(out.astype(np.int8), prepend=0) == 1).sum())
                rows.append((own.ids[i], int(b - a), int(out.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        return pa.Table.from_batches([_rows(names, rows, [pa.int64()] * 4 + [pa.string(), pa.binary()])])

    return work


def deduplicate(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_documents: int = HOT_DOCUMENTS, with_bytes: bool = True, hot_places: int = HOT_PLACES) -> DataFrame:
    """One row for each document: its bytes, removed bytes, removed runs, and the bytes that stay.

    A byte goes if it lies in SPAN bytes that also start in a document with a smaller id; texts are taken
    as given, not as others leave them. A null text is an empty one. Rows with equal ids are one another's
    equals: none is smaller. A row with a null id has no order; it keeps its bytes and removes none.
    Copies of a text keep the one of the smallest id. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    bundles = checkpoint(bundle(rows))
    n_ranges = max(2 * partitions(spark), -(-bundles.count() // RANGE_BUNDLES))
    # whole copies: all but the least are removed at once and need no anchors
    each = bundles.mapInArrow(_digests, "bundle long, doc int, own long, digest string").filter(F.col("own") < LATER)
    each = checkpoint(each)
    least = each.groupBy("digest").agg(F.min("own").alias("least"))
    copies = each.join(least, "digest").filter("own > least").groupBy("bundle").agg(F.collect_list("doc").alias("copies"))
    bundles = bundles.join(copies, "bundle", "left")

    offered = bundles.select("bundle", "ids", "sizes", "texts").mapInArrow(_offer(n_ranges), "part long, bundle long, numbers binary, held binary, places binary")
    shared = checkpoint(offered.groupBy("part").applyInArrow(_shared(hot_documents, hot_places), SHARED))
    by_bundle = bundles.groupBy("bundle").cogroup(shared.groupBy("bundle"))
    marks = by_bundle.applyInArrow(_surround(n_ranges), CONTEXTS).groupBy("part").applyInArrow(_decide, MARKS)
    marks = checkpoint(marks)
    hot = shared.filter("any_hot")
    if not hot.isEmpty():
        windows = checkpoint(bundles.groupBy("bundle").cogroup(hot.groupBy("bundle")).applyInArrow(_hot_windows(n_ranges), WINDOWS))
        first = windows.groupBy("one", "two").agg(F.min("own").alias("least"))
        later = windows.join(first, ["one", "two"]).filter("own > least").select("bundle", "doc", "begin", "end")
        marks = marks.union(checkpoint(later.mapInArrow(_mark_windows, MARKS)))
    return bundles.groupBy("bundle").cogroup(marks.groupBy("bundle")).applyInArrow(_finish(with_bytes), RESULT)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            own = Bundle.of(batch, i)
            data = own.data.tobytes()
            shas = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(own.edges[:-1], own.edges[1:], strict=True)]
            n = len(shas)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("bundle")[i].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(own.order), pa.array(shas, pa.string())],
                names=["bundle", "doc", "own", "digest"],
            )


@query("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"), with_bytes=False).drop("kept")
