"""Order of the suffixes of many strings by their first bytes, within groups, where equal ones stand together.

Suffixes are sorted by their group and their next bytes, as many as a number of 64 bits holds. Where all
neighbours of a run share the whole width, the run is settled; the others are sorted on by the bytes that follow.
Groups are sorted some at a time, which bounds what is held.
"""

from __future__ import annotations

import numpy as np

#: Suffixes that are sorted at a time; a group of more goes whole.
SORTED = 1 << 18


def least_of_equal(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, values: np.ndarray, groups: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string and each of its windows of ``width`` bytes (8 at least), the least value of the strings of its group with an equal window.

    Returns the windows' results, string after string, and the first of each string.
    """
    windows = np.maximum(lengths - width + 1, 0)
    first = np.concatenate(([0], np.cumsum(windows)))
    out = np.repeat(values, windows)
    raw = np.concatenate((text, np.zeros(8, np.uint8)))
    # the eight bytes from each place on, as numbers that sort as the bytes do, and as they lie
    sorting, lying = (np.ndarray(len(text) + 1, kind, raw, strides=(1,)) for kind in (">u8", np.uint64))
    by = np.argsort(groups, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(groups[by]) != 0)) if len(by) else by
    ends = np.append(heads, len(by))
    before = np.concatenate(([0], np.cumsum(windows[by])))[ends]
    lo = 0
    while lo < len(heads):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + SORTED, "right")) - 1)
        some = by[ends[lo] : ends[hi]]
        n = windows[some]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
        _settle(sorting, lying, np.repeat(starts[some], n) + step, np.repeat(first[some], n) + step, np.repeat(of, n), out, width)
        lo = hi
    return out, first


def _settle(sorting: np.ndarray, lying: np.ndarray, at: np.ndarray, place: np.ndarray, group: np.ndarray, out: np.ndarray, width: int) -> None:
    """Lower ``out`` at each window's ``place`` to the least of the windows of its group that equal it; windows begin at ``at``."""
    depth = 0
    while len(at):
        take = min((64 - int(group.max()).bit_length()) // 8, width - depth)
        key = group.astype(np.uint64) << np.uint64(8 * take) | sorting[at + depth].astype(np.uint64) >> np.uint64(64 - 8 * take) if take < 8 else sorting[at + depth].astype(np.uint64)
        order = np.argsort(key)
        key, at, place = key[order], at[order], place[order]
        new = np.append(True, key[1:] != key[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(at)))
        depth += take
        # neighbours in one run that differ further on
        pair = np.flatnonzero(~new)
        for d in range(depth, width, 8) if depth < width else ():
            d = min(d, width - 8)
            same = lying[at[pair] + d] == lying[at[pair - 1] + d]
            new[pair[~same]] = True  # marks the run below
            pair = pair[same]
        new[heads] = False
        mixed = np.logical_or.reduceat(new, heads)
        some = np.repeat(~mixed & (sizes > 1), sizes)
        whole = place[some]
        if len(whole):
            n = sizes[~mixed & (sizes > 1)]
            out[whole] = np.repeat(np.minimum.reduceat(out[whole], np.cumsum(n) - n), n)
        left = np.repeat(mixed, sizes)
        group = np.repeat(np.arange(np.count_nonzero(mixed)), sizes[mixed])
        at, place = at[left], place[left]
