"""Simple-8b: as many numbers as fit in the 60 low bits of a word, whose 4 high bits say how many and how wide.

A file of numbers is cut into blocks of BLOCK numbers that begin with a word of their own, so that any block can be
decoded alone. Numbers over 60 bits are escaped: the word with selector ESCAPE holds their place in a list of exceptions,
so that a word's meaning never hangs on the word before it and all words are decoded at once.
"""

from __future__ import annotations

import struct

import numpy as np

#: Selector: numbers a word, bits a number. These and the header are the file format.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE, BLOCK, MAGIC = 15, 1024, b"S8B1"
_COUNTS = np.array([c for c, _ in SELECTORS] + [0, 1], np.int64)


def encode(values: np.ndarray) -> bytes:
    """Header (magic, numbers, blocks, words, exceptions), first word of every block, words, exceptions."""
    values = np.ascontiguousarray(values, np.uint64)
    n, blocks = len(values), -(-len(values) // BLOCK)
    choice = np.full(blocks * BLOCK, ESCAPE, np.uint8)
    wide = np.full((blocks, BLOCK + 60), 64, np.uint8)  # past a block's end nothing fits
    bits = np.zeros(n, np.uint8)
    for b in sorted({b for _, b in SELECTORS}):
        bits += values >= np.uint64(1 << b)
    flat = np.full(blocks * BLOCK, 64, np.uint8)
    flat[:n] = np.array([*(b for _, b in SELECTORS), 64], np.uint8)[bits]
    wide[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    widest, span = wide, 1
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, width = SELECTORS[s]
        while span < count:
            by = min(span, count - span)
            widest, span = np.maximum(widest[:, :-by], widest[:, by:]), span + by
        choice.reshape(blocks, BLOCK)[widest[:, :BLOCK] <= width] = s
    # All blocks take their next word at the same time.
    begins = np.zeros(blocks * BLOCK, bool)
    at, ends = np.arange(blocks) * BLOCK, np.minimum((np.arange(blocks) + 1) * BLOCK, n)
    live = np.arange(blocks)
    while len(live):
        here = at[live]
        begins[here] = True
        at[live] = here + _COUNTS[choice[here]]
        live = live[at[live] < ends[live]]
    first = np.flatnonzero(begins)
    selector = choice[first]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s, (count, width) in enumerate(SELECTORS):
        own = np.flatnonzero(selector == s)
        for k in range(count if len(own) else 0):
            words[own] |= values[first[own] + k] << np.uint64(k * width)
    escaped = np.flatnonzero(selector == ESCAPE)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    offsets = np.searchsorted(first, np.arange(blocks) * BLOCK).astype("<u4")
    head = MAGIC + struct.pack("<QIIQ", n, blocks, len(words), len(escaped))
    return head + offsets.tobytes() + words.astype("<u8").tobytes() + values[first[escaped]].astype("<u8").tobytes()


def decode(data: bytes, block: int | None = None) -> np.ndarray:
    """The numbers of a file, or of one of its blocks."""
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b file")
    n, blocks, size, more = struct.unpack_from("<QIIQ", data, 4)
    at = 4 + struct.calcsize("<QIIQ")
    offsets = np.frombuffer(data, "<u4", blocks, at)
    words = np.frombuffer(data, "<u8", size, at + 4 * blocks)
    exceptions = np.frombuffer(data, "<u8", more, at + 4 * blocks + 8 * size)
    if block is not None:
        words = words[offsets[block] : offsets[block + 1] if block + 1 < blocks else size]
    selector = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(_COUNTS[selector])
    starts = ends - _COUNTS[selector]
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s, (count, width) in enumerate(SELECTORS):
        own = np.flatnonzero(selector == s)
        for k in range(count if len(own) else 0):
            out[starts[own] + k] = words[own] >> np.uint64(k * width) & np.uint64((1 << width) - 1)
    own = np.flatnonzero(selector == ESCAPE)
    out[starts[own]] = exceptions[words[own] & np.uint64((1 << 60) - 1)]
    return out
