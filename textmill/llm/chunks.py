"""Byte-level encoding of Arrow text columns, each distinct chunk of text once.

A chunk is a stretch of text that no match of the pre-tokenisation pattern can leave: the pattern never
matches across the border from a character to the white space after it. So the ids of a text are the ids
of its chunks in a row, and repeated words are encoded once for a batch and kept for the next ones.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from itertools import chain, repeat
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT_CHUNKS = 400_000  # entries of a worker's table of encoded chunks
PIECE_BYTES = 16 << 20  # text that is worked on at a time
JOINED_CHUNKS = 1000  # new chunks that are encoded as one text
IS_STOP, IS_LETTER = (np.isin(np.arange(256), list(c)) for c in (b".,;:!?", ascii_letters.encode()))


def safe_cuts(data: np.ndarray, starts: np.ndarray, stops: bool = False) -> np.ndarray:
    """Sorted byte positions at which ``data`` may be cut: starts of texts, and spaces after characters.

    A space counts if the byte before it is ASCII and not white space, or ends a two-byte letter; the
    few other cases stay uncut, which is always right. With ``stops``, stops and commas after ASCII letters count, too.
    """
    at = np.flatnonzero(data == 32)
    at = at[at > 1]
    last, before = data[at - 1], data[at - 2]
    plain = (last > 32) & (last < 127)
    letter = (last >= 128) & (before >= 0xC3) & (before <= 0xDF)
    marked = np.zeros(len(data), bool)
    marked[starts[starts < len(data)]] = True
    marked[at[plain | letter]] = True
    if stops:
        at = np.flatnonzero(IS_STOP[data])
        at = at[at > 0]
        marked[at[IS_LETTER[data[at - 1]]]] = True
    return np.flatnonzero(marked)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[0] : starts[0] + lengths[0]], values[starts[1] : ...], ... in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class ChunkEncoder:
    """Encodes texts chunk by chunk and keeps the ids of the chunks.

    Special tokens are plain text, unless ``added``: then texts that hold an added token are encoded whole,
    by the tokenizer as it is defined.
    """

    kept = KEPT_CHUNKS
    stops = False  # whether chunks end before stops, too

    def __init__(self, tokenizer, added: bool = False):
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer.encode_special_tokens = True
        self.tokenizer = tokenizer
        known = tokenizer.get_added_tokens_decoder().values() if added else ()
        self.added = [t.content for t in known]
        # no match of the byte-level pattern goes on from a letter to a stop
        special = all(t.special for t in tokenizer.get_added_tokens_decoder().values())
        before = tokenizer.pre_tokenizer
        self.stops = special and tokenizer.normalizer is None and isinstance(before, ByteLevel) and before.use_regex
        # a token that stays active must not come about where chunks are joined
        self.joined = JOINED_CHUNKS if all(t.special for t in known) else 1
        # tokens are written with one character for each byte
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        self._clear()

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in a row, number of ids of each).

        Chunks that start with a space and end with a character may follow each other in one text, since
        no match leaves them; the sizes of the tokens tell where each one ends.
        """
        offsets, data = text_bytes(pa.array(chunks, pa.string()))
        size, last = np.diff(offsets), data[offsets[1:] - 1]
        joins = (data[offsets[:-1]] == 32) & (last > 32) & (last < 127)
        for i in np.flatnonzero((data[offsets[:-1]] == 32) & (last >= 127)).tolist():
            joins[i] = not chunks[i][-1].isspace()
        order = np.argsort(~joins, kind="stable")  # those that may be joined come first
        n = int(joins.sum())
        ordered = [chunks[i] for i in order]
        texts = ["".join(ordered[i : min(i + self.joined, n)]) for i in range(0, n, self.joined)] + ordered[n:]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))
        ends = np.cumsum(size[order])
        last = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
        lengths = np.diff(last, prepend=0)
        counts = np.empty(len(chunks), np.int64)
        counts[order] = lengths
        starts = np.empty(len(chunks), np.int64)
        starts[order] = last - lengths
        return ragged(ids, starts, counts).astype(np.uint32), counts

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.empty(0, np.uint32)
        self.starts = self.lengths = self.uses = np.empty(0, np.int64)

    def _make_room(self) -> None:
        """Keep the chunks that were met in more than one batch, at most half of the table."""
        most = np.sort(self.uses)[-self.kept // 2]
        kept = np.flatnonzero(self.uses > max(1, most))
        chunks = list(self.place)
        self.place = {chunks[i]: n for n, i in enumerate(kept.tolist())}
        self.ids = ragged(self.ids, self.starts[kept], self.lengths[kept])
        self.lengths, self.uses = self.lengths[kept], self.uses[kept]
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _rows(self, chunks: list[str]) -> np.ndarray:
        if len(self.place) > self.kept:
            self._make_room()
        place = self.place
        rows = np.fromiter(map(place.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(rows < 0)
        if len(new):
            fresh = [chunks[i] for i in new]
            flat, lengths = self.encode(fresh)
            rows[new] = np.arange(len(place), len(place) + len(new))
            place.update(zip(fresh, rows[new].tolist(), strict=True))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
            self.ids = np.concatenate([self.ids, flat])
        self.uses[rows] += 1
        return rows

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each text; null counts as empty."""
        whole = np.zeros(len(column), bool)
        for token in self.added:
            whole |= pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._by_chunks(column)
        ids, counts = self._by_chunks(pc.if_else(pa.array(whole), "", column))
        self.tokenizer.encode_special_tokens = False
        found = [x.ids for x in self.tokenizer.encode_batch_fast(column.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)]
        self.tokenizer.encode_special_tokens = True
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.insert(ids, np.repeat(np.cumsum(counts)[whole], sizes), np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())))
        counts[whole] = sizes
        return ids, counts

    def _by_chunks(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets, data = text_bytes(column)
        counts = np.zeros(len(column), np.int64)
        cuts = safe_cuts(data, offsets[:-1], self.stops)
        if not len(cuts):
            return np.empty(0, np.uint32), counts
        ends = np.append(cuts, len(data)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(ends), pa.py_buffer(data))
        coded = pc.dictionary_encode(chunks)
        rows = self._rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        lengths = self.lengths[rows]
        before = np.concatenate([[0], np.cumsum(lengths)])
        edges = before[np.searchsorted(cuts, offsets)]
        return ragged(self.ids, self.starts[rows], lengths), np.diff(edges)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (one more than texts, from 0) and the bytes of a text column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.string()), "")
    if not len(column):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most ``most`` bytes of text, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        reach = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            done = reach[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(reach, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def give_back() -> None:
    """Return memory that this worker has freed to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what numpy freed
    if trim:
        trim(0)


def giving_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work``, after which the worker, which goes on to other tasks or waits for them, gives back what it has freed."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return done


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def worker_encoder(key: str, load: Callable[[], object], added: bool = False) -> ChunkEncoder:
    """The encoder of this Python worker for the tokenizer that ``load`` gives, loaded once."""
    if (key, added) not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel units
        _encoders[key, added] = ChunkEncoder(load(), added)
    return _encoders[key, added]
