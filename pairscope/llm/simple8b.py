"""Simple-8b: word-aligned packing of unsigned integers, vectorised in both directions.

A 64-bit word holds a selector in its top four bits and as many equal-width values in the other 60 as fit. Values are cut
into blocks of ``BLOCK``; a block begins at a word of its own, and a table gives each block's first word, so all blocks
decode in the same array operations and one block decodes alone. A value of more than 60 bits is an escape: selector 0,
whose payload is the value's place in a list of whole 64-bit values behind the words.
"""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the format: selector -> (values in a word, bits of each). Selector 0 is the escape.
LAYOUT = (
    (1, 60), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
ESCAPE = 0
BLOCK = 1024
MAGIC = b"S8B1"
_HEAD = struct.Struct("<4sIQQ")
_WIDEST = max(n for n, _ in LAYOUT)
_COUNTS = np.array([n for n, _ in LAYOUT], dtype=np.int64)
_PAYLOAD = np.uint64((1 << 60) - 1)


def _choices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place: the selector of a word that begins there, and how many values it takes. A word ends with its block."""
    n = len(values)
    blocks = -(-n // BLOCK)
    # bits of each value (one too many for some beyond 53 bits), 61 for escapes; zeros behind each block fit any word
    bits = np.zeros((blocks, BLOCK + _WIDEST), dtype=np.uint8)
    whole = np.zeros(blocks * BLOCK, dtype=np.uint64)
    whole[:n] = values
    exponents = np.minimum(np.frexp(whole.astype(np.float64))[1], 60)
    bits[:, :BLOCK] = np.where(whole > _PAYLOAD, 61, exponents).reshape(blocks, BLOCK)
    # widest value of the next 1, 2, 4, ... places; two of them overlap to any count
    widest, power = {1: bits}, 1
    while 2 * power <= _WIDEST:
        m = widest[power].copy()
        np.maximum(m[:, :-power], m[:, power:], out=m[:, :-power])
        power *= 2
        widest[power] = m
    # the lowest selector that fits holds the most values; kept as its distance from the end, 0 for none
    best = np.zeros((blocks, BLOCK), dtype=np.uint8)
    for k in range(1, len(LAYOUT)):
        count, width = LAYOUT[k]
        power = 1 << (count.bit_length() - 1)
        m = widest[power]
        most = np.maximum(m[:, :BLOCK], m[:, count - power:count - power + BLOCK])
        np.maximum(best, (most <= width) * np.uint8(len(LAYOUT) - k), out=best)
    selector = (len(LAYOUT) - best.reshape(-1)[:n]) % len(LAYOUT)
    left = np.tile(np.arange(BLOCK, 0, -1), blocks)[:n]
    left[n - n % BLOCK:] = np.arange(n % BLOCK, 0, -1)
    return selector, np.minimum(_COUNTS[selector], left)


def encode(values: np.ndarray) -> bytes:
    """Header, first word of each block, words, escaped values; any unsigned 64-bit values, none too."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    selector, taken = _choices(values)
    steps, starts, at = taken.tolist(), [], 0
    while at < len(steps):
        starts.append(at)
        at += steps[at]
    starts = np.array(starts, dtype=np.int64)
    chosen, held = selector[starts].astype(np.int64), taken[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([values, np.zeros(_WIDEST, dtype=np.uint64)])
    for k, (count, bits) in enumerate(LAYOUT):
        mine = np.flatnonzero(chosen == k)
        if k == ESCAPE or not bits or not len(mine):
            continue
        places = np.arange(count)
        block = padded[starts[mine][:, None] + places]
        block[places >= held[mine][:, None]] = 0
        words[mine] |= np.bitwise_or.reduce(block << (places * bits).astype(np.uint64), axis=1)
    escapes = np.flatnonzero(chosen == ESCAPE)
    words[escapes] = np.arange(len(escapes), dtype=np.uint64)
    offsets = np.flatnonzero(starts % BLOCK == 0).astype("<u4")
    return b"".join((
        _HEAD.pack(MAGIC, len(offsets), len(values), len(words)), offsets.tobytes(), words.astype("<u8").tobytes(),
        values[starts[escapes]].astype("<u8").tobytes()))


def decode(data: bytes) -> np.ndarray:
    """The values of ``encode`` as unsigned 64-bit integers."""
    magic, blocks, n, size = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b stream")
    at = _HEAD.size
    offsets = np.frombuffer(data, "<u4", blocks, at).astype(np.int64)
    words = np.frombuffer(data, "<u8", size, at + 4 * blocks)
    escaped = np.frombuffer(data, "<u8", -1, at + 4 * blocks + 8 * size)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[selector]
    before = np.cumsum(counts) - counts
    block = np.zeros(size, dtype=np.int64)
    block[offsets[1:]] = 1
    block = np.cumsum(block)
    # each block gets room for what its last word pads
    width = BLOCK + _WIDEST
    place = block * width + before - before[offsets][block]
    out = np.zeros(blocks * width, dtype=np.uint64)
    for k, (count, bits) in enumerate(LAYOUT):
        mine = np.flatnonzero(selector == k)
        if not bits or not len(mine):
            continue
        if k == ESCAPE:
            out[place[mine]] = escaped[(words[mine] & _PAYLOAD).astype(np.int64)]
            continue
        shifts = (np.arange(count) * bits).astype(np.uint64)
        out[place[mine][:, None] + np.arange(count)] = (words[mine][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    return out.reshape(blocks, width)[:, :BLOCK].reshape(-1)[:n]
