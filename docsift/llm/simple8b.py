"""Simple-8b: ids packed into 64-bit words.

The upper 4 bits of a word, its selector, say how many ids its other 60 bits hold, each with as many bits as fit.
Selector 0 is an escape: the next word is one id of up to 64 bits as it is. Ids are packed in blocks of a fixed number
of ids, which begin with a word of their own; the place of each block's first word stands before the words, so blocks
are decoded independently, and all words of a selector at once.

Layout, little-endian: the mark, ids, ids of a block (unsigned 32 bits each), first word of each block (unsigned 32
bits), the words.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format: ids in a word by selector; 0 is the escape.
COUNTS = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
MARK = 0x31423853
BLOCK_IDS = 1024
HEADER_WORDS = 3


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs."""
    if not len(ids) or ids.max() < 2**53:  # exact as floating point: the exponent is the number of bits
        return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    bits = np.zeros(len(ids), dtype=np.uint8)
    rest = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        large = rest >> np.uint64(step) > 0
        bits[large] += step
        rest[large] >>= np.uint64(step)
    return bits + (rest > 0)


def _selectors(ids: np.ndarray, block_ids: int) -> np.ndarray:
    """For each place, the selector of a word that would begin there: the one for the most ids that fit."""
    n = len(ids)
    selector = np.zeros(n, dtype=np.uint8)
    bits = _bit_lengths(ids)
    left = np.minimum(block_ids - np.arange(n) % block_ids, n - np.arange(n)).astype(np.int32)
    widest = bits.copy()
    reach = 1
    for number in range(len(COUNTS) - 1, 0, -1):
        count = COUNTS[number]
        while reach < count:
            if reach < n:
                np.maximum(widest[: n - reach], bits[reach:], out=widest[: n - reach])
            reach += 1
        if n and widest.min() > 60 // count:  # nor do more ids fit anywhere
            break
        selector[(widest <= 60 // count) & (left >= count)] = number
    return selector


def pack(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """The ids (of up to 64 bits) in the layout above."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    selector = _selectors(ids, block_ids)
    steps = np.maximum(np.array(COUNTS, dtype=np.int64)[selector], 1)
    # Where words begin, in all blocks side by side.
    begins = np.zeros(n, dtype=bool)
    at = np.arange(0, n, block_ids)
    ends = np.minimum(at + block_ids, n)
    while len(at):
        begins[at] = True
        at = at + steps[at]
        going = at < ends
        at, ends = at[going], ends[going]
    places = np.flatnonzero(begins)
    chosen = selector[places]
    widths = 1 + (chosen == 0)
    word_at = np.cumsum(widths) - widths
    words = np.zeros(int(widths.sum()), dtype=np.uint64)
    for number in np.unique(chosen).tolist():
        mine = chosen == number
        if number == 0:
            words[word_at[mine] + 1] = ids[places[mine]]
            continue
        count = COUNTS[number]
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(60 // count)
        packed = np.bitwise_or.reduce(ids[places[mine][:, None] + np.arange(count)] << shifts, axis=1)
        words[word_at[mine]] = packed | np.uint64(number << 60)
    first_words = word_at[places % block_ids == 0]
    head = np.array([MARK, n, block_ids], dtype="<u4").tobytes()
    return head + first_words.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def _parts(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    mark, n, block_ids = np.frombuffer(data, dtype="<u4", count=HEADER_WORDS).tolist()
    if mark != MARK:
        raise ValueError("not a Simple-8b segment")
    blocks = -(-n // block_ids)
    first_words = np.frombuffer(data, dtype="<u4", count=blocks, offset=4 * HEADER_WORDS)
    return n, block_ids, first_words, np.frombuffer(data, dtype="<u8", offset=4 * (HEADER_WORDS + blocks))


def _unpack_words(words: np.ndarray) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    for place in np.flatnonzero(selector == 0).tolist():
        if not raw[place]:
            raw[place + 1] = True
    selector[raw] = -1
    counts = np.where(raw, 1, np.array(COUNTS, dtype=np.int64)[np.maximum(selector, 0)])
    first = np.cumsum(counts) - counts
    ids = np.zeros(int(counts.sum()), dtype=np.uint64)
    for number in np.unique(selector).tolist():
        mine = selector == number
        if number == -1:
            ids[first[mine]] = words[mine]
        elif number > 0:
            count = COUNTS[number]
            width = 60 // count
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
            values = words[mine][:, None] >> shifts & np.uint64((1 << width) - 1)
            ids[first[mine][:, None] + np.arange(count)] = values
    return ids


def unpack(data: bytes) -> np.ndarray:
    """All ids of a segment."""
    n, _, _, words = _parts(data)
    ids = _unpack_words(words)
    if len(ids) != n:
        raise ValueError("a Simple-8b segment is damaged")
    return ids


def unpack_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block of a segment, without looking at the others."""
    _, _, first_words, words = _parts(data)
    end = first_words[block + 1] if block + 1 < len(first_words) else len(words)
    return _unpack_words(words[first_words[block] : end])
