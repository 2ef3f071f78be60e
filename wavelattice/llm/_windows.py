"""Cuts texts into segments of window starts that share an anchor.

Every string of WIDTH bytes holds WIDTH - GRAM + 1 strings of GRAM bytes; the
one of least hash (leftmost of equals) is its anchor. Equal strings have equal
anchors at equal places, so all occurrences of a string meet under one anchor,
and an anchor serves a whole run of neighbouring starts.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

GRAM = 64
_LOW = np.uint64((1 << 22) - 1)
#: Bytes handled at once; longer texts go in overlapping pieces.
PIECE = 1 << 20
_TABLE = np.random.default_rng(0x5A).integers(0, 1 << 64, 256, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the `gram` bytes at each position: by doubling, and parts of unequal size put together."""
    part, size, out, done = _TABLE[data], 1, None, 0
    count = len(data) - gram + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    while True:
        if gram & size:
            here = part[done : done + count]
            out = here if out is None else (out ^ (out >> np.uint64(29))) * _MIX + here
            done += size
        if done == gram:
            return (out ^ (out >> np.uint64(32))) * _MIX
        part = (part[:-size] ^ (part[:-size] >> np.uint64(29))) * _MIX + part[size:]
        size *= 2


def window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbouring keys."""
    size = 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[: len(keys) - (width - size)], keys[width - size :]) if width > size else keys


def segments(raw: bytes, width: int):
    """(anchor hash, digest, first start, number of starts) of every segment of raw; segment bytes are starts + width - 1."""
    n = len(raw) - width + 1
    out_a, out_s, out_lo, out_n = [], [], [], []
    for at in range(0, max(n, 0), PIECE):
        piece = np.frombuffer(raw, np.uint8, min(PIECE + width - 1, len(raw) - at), at)
        h = gram_hashes(piece)
        keys = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        place = window_min(keys, width - GRAM + 1) & _LOW
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        ends = np.append(first[1:], len(place))
        out_a.append(h[place[first].astype(np.int64)])
        for lo, hi in zip(first.tolist(), ends.tolist(), strict=True):
            out_lo.append(at + lo)
            out_n.append(hi - lo)
            out_s.append(xxh3_64_intdigest(raw[at + lo : at + hi + width - 1]))
    anchors = np.concatenate(out_a) if out_a else np.empty(0, np.uint64)
    return anchors.view(np.int64), np.array(out_s, np.uint64).view(np.int64), out_lo, out_n


def marks(raw: bytes, gram: int, passage: int) -> np.ndarray:
    """Hashes of selected strings of `gram` bytes: equal strings of `passage` bytes have one in common.

    In each run of passage - gram + 1 neighbouring strings the one of least hash is selected.
    """
    wide, out = passage - gram + 1, []
    for at in range(0, max(len(raw) - passage + 1, 0), PIECE):
        h = gram_hashes(np.frombuffer(raw, np.uint8, min(PIECE + passage - 1, len(raw) - at), at), gram)
        keys = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        place = window_min(keys, wide) & _LOW
        out.append(h[place[np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))].astype(np.int64)])
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.empty(0, np.int64)
