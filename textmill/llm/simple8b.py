"""Simple-8b word-aligned coding of token ids.

A 64-bit word holds a 4-bit selector (high bits) and 60 bits of data: as many ids as the selector says,
each in the same number of bits, the first one lowest. The escape selector holds no id; the word after it
is one id of up to 64 bits. Ids are coded in blocks of ``BLOCK``; blocks start at a word, and a list of
offsets says which, so that any block can be decoded alone and all of them side by side.

A file is, in little-endian 64-bit words: MAGIC, number of ids, BLOCK, number of blocks, the offset of
each block in words and the end, then the words.
"""

from __future__ import annotations

import numpy as np

MAGIC = 0x38365F454C504D53
BLOCK = 4096
ESCAPE = 0
# Fixed values: (ids in a word, bits of each) for the selectors 1 to 14, most ids first.
SELECTORS = (
    (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7),
    (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
COUNTS = np.array([0, *(n for n, _ in SELECTORS)])


def _bits(ids: np.ndarray) -> np.ndarray:
    """Number of bits of each id, at least 1."""
    bits = np.ones(ids.shape, np.uint8)
    low = ids
    for b in (32, 16):
        if len(low) and low.max() >> np.uint64(b):
            more = low >= (np.uint64(1) << np.uint64(b))
            bits[more] += np.uint8(b)
            low = np.where(more, low >> np.uint64(b), low)
    return bits + _SHORT_BITS[low.astype(np.uint16)]


# bits of the 16-bit numbers beyond the first bit, by doubling
_SHORT_BITS = np.zeros(1, np.uint8)
while len(_SHORT_BITS) < 1 << 16:
    _more = np.full(len(_SHORT_BITS), len(_SHORT_BITS).bit_length() - 1, np.uint8)
    _SHORT_BITS = np.concatenate([_SHORT_BITS, _more])


def _choices(bits: np.ndarray) -> np.ndarray:
    """For each place the first selector whose ids from there on fit; past the end there are zeros."""
    n = bits.shape[1]

    def both(most: np.ndarray, step: int) -> np.ndarray:
        out = most.copy()
        np.maximum(most[:, : n - step], most[:, step:], out=out[:, : n - step])
        return out

    powers = {1: bits}  # the largest number of bits among the next 1, 2, 4, ... ids
    while 2 * max(powers) <= SELECTORS[0][0]:
        powers[2 * max(powers)] = both(powers[max(powers)], max(powers))
    choice = np.full(bits.shape, ESCAPE, np.uint8)
    for s in range(len(SELECTORS), 0, -1):
        count, width = SELECTORS[s - 1]
        have = max(p for p in powers if p <= count)
        most = both(powers[have], count - have) if count > have else powers[have]
        np.copyto(choice, np.uint8(s), where=most <= width)
    return choice


def encode(ids: np.ndarray) -> bytes:
    """A file of ``ids`` (any unsigned type)."""
    ids = np.asarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK)
    grid = np.zeros((blocks, BLOCK), np.uint64)
    grid.reshape(-1)[: len(ids)] = ids
    sizes = np.full(blocks, BLOCK)
    if blocks:
        sizes[-1] = len(ids) - (blocks - 1) * BLOCK
    choice = _choices(_bits(grid))
    # all blocks take their next word at the same time
    taken: list[tuple[np.ndarray, ...]] = []
    live, at, filled = np.arange(blocks), np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
    while len(live):
        chosen = choice[live, at]
        taken.append((live, at, chosen, filled[live]))
        filled[live] += np.where(chosen == ESCAPE, 2, 1)
        at = at + np.where(chosen == ESCAPE, 1, COUNTS[chosen])
        going = at < sizes[live]
        live, at = live[going], at[going]
    none = [np.empty(0, np.int64)] * 4
    block, start, selector, place = map(np.concatenate, zip(*taken, strict=True)) if taken else none
    offsets = np.concatenate([[0], np.cumsum(filled)])
    place = place + offsets[block]
    words = np.zeros(int(offsets[-1]), np.uint64)
    padded = np.concatenate([grid, np.zeros((blocks, 60), np.uint64)], axis=1).reshape(-1)
    origin = block * (BLOCK + 60) + start
    for s in range(len(SELECTORS) + 1):
        own = np.flatnonzero(selector == s)
        if not len(own):
            continue
        if s == ESCAPE:
            words[place[own] + 1] = padded[origin[own]]
            continue
        count, width = SELECTORS[s - 1]
        packed = np.full(len(own), np.uint64(s) << np.uint64(60))
        for j in range(count):
            packed |= padded[origin[own] + j] << np.uint64(j * width)
        words[place[own]] = packed
    head = np.array([MAGIC, len(ids), BLOCK, blocks], np.uint64)
    return np.concatenate([head, offsets.astype(np.uint64), words]).astype("<u8").tobytes()


def decode(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a file, or those of the blocks ``first`` to ``last`` (exclusive)."""
    whole = np.frombuffer(data, "<u8")
    if len(whole) < 5 or int(whole[0]) != MAGIC:
        raise ValueError("not a file of Simple-8b blocks")
    total, size, blocks = (int(x) for x in whole[1:4])
    last = blocks if last is None else min(last, blocks)
    first = min(first, last)
    offsets = whole[4 : 5 + blocks].astype(np.int64)
    words = whole[5 + blocks + offsets[first] : 5 + blocks + offsets[last]]
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    # an id after an escape may look like one: take the escapes in order, block by block if there are any
    if len(words) and (selector == ESCAPE).any():
        at = 0
        marks = np.flatnonzero(selector == ESCAPE)
        for m in marks.tolist():
            if m >= at:
                raw[m + 1] = True
                at = m + 2
        selector[raw] = len(COUNTS)
    counts = np.append(COUNTS, 1)[selector]
    block = np.searchsorted(offsets[first : last + 1] - offsets[first], np.arange(len(words)), side="right") - 1
    # places run through whole blocks; what the last word of a block holds beyond its end is dropped
    reach = np.cumsum(counts) - counts
    begin = (offsets[first:last] - offsets[first]).astype(np.int64)
    inside = reach - reach[begin][block] if len(words) else reach
    sizes = np.full(max(last - first, 0), size)
    if last == blocks and last > first:
        sizes[-1] = total - (blocks - 1) * size
    out = np.zeros(((last - first), size + 60), np.uint64)
    flat, origin = out.reshape(-1), block * (size + 60) + inside
    for s, (count, width) in enumerate(SELECTORS, 1):
        own = np.flatnonzero(selector == s)
        mask = np.uint64((1 << width) - 1)
        for j in range(count if len(own) else 0):
            flat[origin[own] + j] = (words[own] >> np.uint64(j * width)) & mask
    flat[origin[raw]] = words[raw]
    return out[:, :size].reshape(-1)[: int(sizes.sum())]
