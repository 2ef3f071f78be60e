"""Suffix sorting of wanted positions only."""

import numpy as np
import pytest

from wavelattice.llm import suffix_dedup, suffix_order


def texts():
    rng = np.random.default_rng(3)
    yield from (rng.integers(0, k, n).astype(np.uint8) for k in (1, 2, 4, 200) for n in (1, 2, 9, 300, 2000))
    once = rng.integers(97, 101, 300).astype(np.uint8)
    yield np.concatenate([once, once[:200], once[50:], np.full(150, 98, np.uint8), once])


@pytest.mark.parametrize("share", [0.0, 0.03, 0.5, 1.0])
def test_wanted_positions_stand_as_in_the_whole_order(share):
    rng = np.random.default_rng(4)
    for data in texts():
        depth = len(data)  # so that no two suffixes tie
        wanted = np.repeat(rng.random(len(data) // 20 + 1) < share, 20)[: len(data)]
        want = sorted(np.flatnonzero(wanted).tolist(), key=lambda p: data[p:].tobytes())
        got = suffix_order.suffix_array(data, depth, wanted)
        assert len(np.unique(got)) == len(got)
        assert got[wanted[got]].tolist() == want


def test_a_block_sorts_little_more_than_its_window_starts(monkeypatch):
    rng = np.random.default_rng(5)
    rows = [{"k0": i, "k1": i, "anchor": 0, "lo": 0, "n": 50, "m": 1, "parts": 1, "raw": rng.integers(97, 123, 449).astype(np.uint8).tobytes()} for i in range(20)]
    rows[7]["raw"] = rows[3]["raw"][:420] + rows[7]["raw"][420:]
    sizes, sort = [], suffix_order.suffix_array

    def counted(*args):
        sizes.append(len(out := sort(*args)))
        return out

    monkeypatch.setattr(suffix_dedup, "suffix_array", counted)
    assert sorted(x[:4] for x in suffix_dedup.block_repeats(rows, 400)) == [(3, 3, 0, 420), (7, 7, 0, 420)]
    assert sizes[0] < 1.2 * 20 * 50
