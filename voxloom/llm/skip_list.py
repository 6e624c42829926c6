"""Indexable skip lists over the units of texts, one list a row, all rows of a batch side by side in NumPy arrays.

The nodes of a list are the n + 1 places between its units. A node stands in lane 0 and, by a fixed hash of its place, in
each further lane with a quarter of the chance of the one before; place 0 stands in all of them. A link carries two widths:
the units and the code points that it passes over. Going down from the top lane and adding up widths finds the code-point
offset of any place in logarithmic time, without looking at the units between."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .hashing import SPACE, mix, text_bytes

#: The units of a link that leads nowhere: more than any rank.
_END = np.int64(1) << 62


def unit_widths(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each unit of each row, and the n + 1 bounds of the rows' units. A unit is white space with the word
    after it, or the white space at the end of a text."""
    data, bounds = text_bytes(column)
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    space = SPACE[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = space[1:] & ~space[:-1]
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    start = np.flatnonzero(begins)
    lead = (data & 0xC0) != 0x80  # all bytes of UTF-8 but the continuations
    return np.add.reduceat(lead, start, dtype=np.int64), np.searchsorted(start, bounds)


class SkipLists:
    def __init__(self, widths: np.ndarray, bounds: np.ndarray):
        rows = len(bounds) - 1
        count = np.diff(bounds)
        first = np.concatenate(([0], np.cumsum(count + 1)))  # the nodes of a row follow each other
        place = np.arange(first[-1]) - np.repeat(first[:-1], count + 1)
        row = np.repeat(np.arange(rows), count + 1)
        total = np.concatenate(([0], np.cumsum(widths)))
        offset = total[np.repeat(bounds[:-1], count + 1) + place] - np.repeat(total[bounds[:-1]], count + 1)
        hashed = mix(place.astype(np.uint64) + np.uint64(1))
        self.counts, self.lanes = count, []
        node = np.arange(first[-1])
        while True:
            lane, below = len(self.lanes), node
            if lane:
                up = (hashed[node] & np.uint64((1 << 2 * lane) - 1) == 0) | (place[node] == 0)
                at = np.flatnonzero(up)
                node = node[at]
            else:
                at = node
            last = np.ones(len(node), bool)
            last[:-1] = row[node][1:] != row[node][:-1]
            units, chars = np.full(len(node), _END), np.zeros(len(node), np.int64)
            go = np.flatnonzero(~last)
            units[go] = place[node[go + 1]] - place[node[go]]
            chars[go] = offset[node[go + 1]] - offset[node[go]]
            heads = np.searchsorted(node, first[:-1])
            self.lanes.append((heads, units, chars, at))
            if lane and len(node) == len(below) or len(node) == rows or lane == 31:
                return

    def offsets(self, row: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Code points before the unit of this rank (0 to n) in the list of each row."""
        at = self.lanes[-1][0][row]
        passed, chars = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for lane in range(len(self.lanes) - 1, -1, -1):
            _, units, points, down = self.lanes[lane]
            while True:
                go = passed + units[at] <= rank
                if not go.any():
                    break
                passed += np.where(go, units[at], 0)
                chars += np.where(go, points[at], 0)
                at = at + go
            if lane:
                at = down[at]
        return chars
