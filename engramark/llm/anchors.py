"""Anchors of repeated strings: positions chosen by content, so that equal windows have equal anchors."""

from __future__ import annotations

import numpy as np

from engramark.llm import bytetext

#: Bytes that an anchor's hash covers.
GRAM = 64
#: Window starts that one section of a text takes; positions within it fit the low bits below.
SECTION = 4 << 20
_POSITION_BITS = np.uint64(24)


def anchors(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor, hash): runs of successive window starts that have one anchor.

    A window is ``length`` bytes of one text; its anchor is the position in it
    whose GRAM bytes have the least hash, the first of equals. So the anchor and
    its hash depend on the window's bytes only, and two equal windows have equal
    anchors at equal distances. Texts are data[offs[i]:offs[i + 1]].
    """
    parts: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(1, len(data)), SECTION):
        end = min(len(data), at + SECTION + length - 1)
        if end - at >= length:
            parts.append(_section(data[at:end], offs - at, length, at))
    if not parts:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _section(data: np.ndarray, offs: np.ndarray, length: int, at: int) -> tuple[np.ndarray, ...]:
    n = len(data)
    up, down = bytetext.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    hashes = bytetext.mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    low = hashes >> _POSITION_BITS << _POSITION_BITS | np.arange(len(hashes), dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    valid = np.zeros(len(low) + 2, bool)
    change = np.zeros(len(low) + 2, np.int32)
    begin, stop = np.clip(offs[:-1], 0, len(low)), np.clip(offs[1:] - length + 1, 0, len(low))
    some = stop > begin
    np.add.at(change, begin[some], 1)
    np.add.at(change, stop[some], -1)
    valid[1:] = np.cumsum(change)[:-1] > 0
    differs = np.ones(len(low) + 1, bool)
    differs[1:-1] = low[1:] != low[:-1]
    on = valid[1:-1]
    first = np.flatnonzero(on & (differs[:-1] | ~valid[:-2]))
    last = np.flatnonzero(on & (differs[1:] | ~np.append(on[1:], False)))
    anchor = (low[first] & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))).astype(np.int64)
    return first + at, last + at, anchor + at, hashes[anchor]
