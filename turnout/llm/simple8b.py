"""Simple-8b: ids packed in 64-bit words, in blocks whose offsets are stored for decoding at once.

A segment is, little-endian: the magic ``S8B1``; the number of documents, ids, blocks, words and
escapes (five u64); doc_ids (i64; NO_ID for none); ids of each document (u64); the first word of
each block (u64); the escapes (u64); the words (u64). A word has a selector in its top four bits:
selectors 2 to 15 hold ``COUNTS`` ids of ``BITS`` bits, first id lowest; selector 0 is an escape,
whose payload is the place of one larger id among the escapes. Blocks hold BLOCK ids (the last may
hold fewer) and begin with a word of their own; what a block's last word has beyond is zero.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"S8B1"
BLOCK = 128
NO_ID = -(2**63)
# Ids in a word, and bits of each, for selectors 2 to 15.
COUNTS = [60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
BITS = [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]

_U = np.uint64


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, at least one."""
    out = np.ones(len(ids), np.uint8)
    for bits in range(1, 64):
        over = ids >= _U(1 << bits)
        if not over.any():
            break
        out += over
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escapes) of unsigned 64-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK + 64, _U)
    padded[:n] = ids
    width = _widths(padded)
    # the largest width among the next COUNTS ids, from small counts to large ones
    choice = np.zeros(len(padded), np.uint8)
    most, have = width.copy(), 1
    for selector in range(15, 1, -1):
        count, bits = COUNTS[selector - 2], BITS[selector - 2]
        while have < count:
            step = min(have, count - have)
            most[:-step] = np.maximum(most[:-step], most[step:])
            have += step
        choice[most <= bits] = selector
    size = np.array([1, 0, *COUNTS])
    at, ends = np.arange(blocks) * BLOCK, (np.arange(blocks) + 1) * BLOCK
    owner, places = [], []
    live = np.arange(blocks)
    while len(live):
        owner.append(live)
        places.append(at[live])
        at[live] += size[choice[at[live]]]
        live = live[at[live] < np.minimum(ends[live], n)]
    if not owner:
        return np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, _U)
    owner, places = np.concatenate(owner), np.concatenate(places)
    order = np.lexsort((places, owner))
    owner, places = owner[order], places[order]
    selectors = choice[places]
    words = selectors.astype(_U) << _U(60)
    end = np.minimum((owner + 1) * BLOCK, n)
    for selector in np.unique(selectors):
        on = np.flatnonzero(selectors == selector)
        if selector == 0:
            escapes_on = on
            words[on] |= np.arange(len(on), dtype=_U)
            continue
        bits = BITS[selector - 2]
        for j in range(COUNTS[selector - 2]):
            inside = places[on] + j < end[on]
            words[on] |= np.where(inside, padded[places[on] + j], _U(0)) << _U(bits * j)
    escapes = padded[places[escapes_on]] if (selectors == 0).any() else np.zeros(0, _U)
    return words, np.searchsorted(owner, np.arange(blocks)).astype(_U), escapes


def unpack(words: np.ndarray, first: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ids; each word's place follows from its block's offset."""
    out = np.zeros(n, _U)
    if not n:
        return out
    selectors = (words >> _U(60)).astype(np.int64)
    size = np.array([1, 0, *COUNTS])[selectors]
    block = np.searchsorted(first, np.arange(len(words)), "right") - 1
    run = np.cumsum(size) - size
    places = run - run[first.astype(np.int64)][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for selector in np.unique(selectors):
        on = np.flatnonzero(selectors == selector)
        if selector == 0:
            out[places[on]] = escapes[(words[on] & _U((1 << 60) - 1)).astype(np.int64)]
            continue
        bits = BITS[selector - 2]
        for j in range(COUNTS[selector - 2]):
            inside = on[places[on] + j < end[on]]
            out[places[inside] + j] = words[inside] >> _U(bits * j) & _U((1 << bits) - 1)
    return out


def write_segment(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    words, first, escapes = pack(ids.astype(_U))
    keys = np.array([NO_ID if d is None else d for d in doc_ids], np.int64)
    head = struct.pack("<5Q", len(keys), len(ids), len(first), len(words), len(escapes))
    return b"".join([MAGIC, head, keys.tobytes(), sizes.astype(_U).tobytes(), first.tobytes(),
                     escapes.tobytes(), words.tobytes()])


def read_segment(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, all ids)."""
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b segment")
    counts = struct.unpack_from("<5Q", data, 4)
    docs, n, blocks, n_words, n_escapes = counts
    parts, at = [], 44
    for kind, size in ((np.int64, docs), (_U, docs), (_U, blocks), (_U, n_escapes), (_U, n_words)):
        parts.append(np.frombuffer(data, kind, size, at))
        at += 8 * size
    if at != len(data):
        raise ValueError("a Simple-8b segment has the wrong length")
    keys, sizes, first, escapes, words = parts
    ids = unpack(words, first, escapes, n)
    return [None if k == NO_ID else int(k) for k in keys], sizes.astype(np.int64), ids
