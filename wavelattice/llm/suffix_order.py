"""Two-stage suffix sorting of one block of bytes, and lengths of adjacent common prefixes.

Stage one sorts directly only the suffixes that are smaller than their
successor (type S). Stage two induces all others (type L) by one scan over the
byte buckets from small to large: a suffix seen in order puts its predecessor,
if that is of type L, at the end of the predecessor's bucket. Whole buckets
are handled at once; only runs of one byte need a step per place. Where only
some positions are wanted, both stages leave out all that these do not rest on.

Order is by the first `depth` bytes; suffixes that agree on these may stand in
any order.
"""

from __future__ import annotations

import numpy as np


def suffix_types(data: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last is not."""
    n = len(data)
    sign = np.sign(data[1:].astype(np.int16) - data[:-1].astype(np.int16))
    sign = np.append(sign, -1)
    # Equal bytes take the sign of the next unequal pair.
    at = np.where(sign != 0, np.arange(n), n)
    return sign[np.minimum.accumulate(at[::-1])[::-1]] > 0


def words_at(padded: np.ndarray) -> np.ndarray:
    """View: the eight bytes from each position as one big-endian number."""
    return np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))


def sort_directly(words: np.ndarray, pos: np.ndarray, depth: int) -> np.ndarray:
    """pos ordered by the `depth` bytes from each; ties are carried on eight bytes at a time."""
    first = words[pos].astype(np.uint64)
    order = np.argsort(first, kind="stable")
    pos, first = pos[order], first[order]
    same = np.concatenate([first[1:] == first[:-1], [False]])
    tied = np.flatnonzero(same | np.concatenate([[False], same[:-1]]))
    group = np.cumsum(~np.concatenate([[False], same[:-1]]))[tied]
    for at in range(8, depth, 8):
        if not len(tied):
            break
        word = words[np.minimum(pos[tied] + at, len(words) - 1)].astype(np.uint64)
        joined = group[1:] == group[:-1]
        unlike = joined & (word[1:] != word[:-1])
        if unlike.any():
            # Only groups in which words differ are sorted anew.
            begins = np.flatnonzero(np.concatenate([[True], ~joined]))
            label = np.cumsum(np.concatenate([[True], ~joined])) - 1
            moved = np.add.reduceat(np.append(unlike, False).astype(np.int64), begins)[label] > 0
            here = np.flatnonzero(moved)
            perm = here[np.lexsort((word[here], group[here]))]
            pos[tied[here]] = pos[tied[perm]]
            word[here] = word[perm]
            split = np.concatenate([[True], ~joined | (word[1:] != word[:-1])])
            group = np.cumsum(split)
            alone = split & np.append(split[1:], True)
            tied, group = tied[~alone], group[~alone]
    return pos


def rested_on(wanted: np.ndarray, small: np.ndarray) -> np.ndarray:
    """True at wanted positions and at those that they are induced from: what follows one of type L, up to the next of type S."""
    last = np.maximum.accumulate(np.where(wanted, np.arange(len(wanted)), -1))
    passed = np.cumsum(small) - small
    return (last >= 0) & (passed == passed[last])


def suffix_array(data: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Positions of data in the order of their suffixes' first `depth` bytes; with a mask, of wanted positions and the few they rest on."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    words = words_at(np.concatenate([data, np.zeros(depth + 16, np.uint8)]))
    small = suffix_types(data)
    needed = np.ones(n, bool) if wanted is None else rested_on(wanted, small)
    directly = sort_directly(words, np.flatnonzero(small & needed), depth)
    large_needed = needed & ~small
    bounds = np.searchsorted(data[directly], np.arange(257)) if len(directly) else np.zeros(257, np.int64)
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[n - 1]:
        induced[data[n - 1]].append(np.array([n - 1]))  # its successor is the empty suffix, the least of all
    out = [np.empty(0, np.int64)]

    def before(seen: np.ndarray) -> np.ndarray:
        prior = seen[seen > 0] - 1
        return prior[large_needed[prior]]

    for byte in range(256):
        large = []
        queue = np.concatenate(induced[byte]) if induced[byte] else np.empty(0, np.int64)
        while len(queue):
            large.append(queue)
            prior = before(queue)
            queue = prior[data[prior] == byte]
        bucket = np.concatenate([*large, directly[bounds[byte] : bounds[byte + 1]]])
        if len(bucket):
            out.append(bucket)
            prior = before(bucket)
            kinds = data[prior]
            prior, kinds = prior[kinds > byte], kinds[kinds > byte]
            order = np.argsort(kinds, kind="stable")
            prior, kinds = prior[order], kinds[order]
            cuts = np.flatnonzero(np.diff(kinds)) + 1
            for part in np.split(prior, cuts) if len(prior) else ():
                induced[data[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For neighbours in order: how many bytes they have in common, counted up to depth (one number fewer than order)."""
    n = len(data)
    words = words_at(np.concatenate([data, np.zeros(depth + 16, np.uint8)]))
    room = np.minimum(n - np.maximum(order[:-1], order[1:]), depth)
    out = np.minimum(np.zeros(len(room), np.int64), room)
    left = np.arange(len(room))
    for at in range(0, depth, 8):
        unlike = words[order[left] + at] ^ words[order[left + 1] + at]
        ends = unlike != 0
        out[left[ends]] = at + (unlike[ends].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
        left = left[~ends]
        out[left] = at + 8
        left = left[room[left] > at + 8]
    return np.minimum(out, room)
