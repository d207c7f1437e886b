"""Hamming neighbours by bit-sliced comparison: vertical bit planes, carry-save counters, early abandon."""

from __future__ import annotations

import numpy as np

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Words of 64 lanes that one step works on.
WORDS = 1 << 15


def planes_of(lanes: np.ndarray) -> np.ndarray:
    """Bit planes (bits, groups, words) of fingerprints (groups, words * 64, parts): bit j of a word is lane j's bit."""
    out = np.empty((64 * lanes.shape[2], lanes.shape[0], lanes.shape[1] // 64), dtype=np.uint64)
    for p in range(len(out)):
        bits = ((lanes[:, :, p // 64] >> np.uint64(p % 64)) & np.uint64(1)).astype(np.uint8)
        out[p] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return out


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above radius, from the highest counter bit down."""
    above = np.zeros_like(counters[0])
    equal = np.full_like(counters[0], ALL)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def near_rows(groups: list[np.ndarray], radius: int) -> list[tuple[int, int, np.ndarray]]:
    """For groups of fingerprints (rows, parts of 64 bits): (group, row, mask words) of every row that has another within radius in its group.

    A row's block of lanes is abandoned once every lane's counter has passed the radius. Groups should be of like
    size, as all are padded to the largest.
    """
    words = -(-max(len(g) for g in groups) // 64)
    lanes = np.zeros((len(groups), words * 64, groups[0].shape[1]), dtype=np.uint64)
    absent = np.ones((len(groups), words * 64), dtype=np.uint8)
    for i, g in enumerate(groups):
        lanes[i, : len(g)] = g
        absent[i, : len(g)] = 0
    planes = planes_of(lanes)
    closed = np.packbits(absent, axis=1, bitorder="little").view(np.uint64)
    group_of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    row_of = np.concatenate([np.arange(len(g)) for g in groups])
    step = max(1, WORDS // words)
    found: list[tuple[int, int, np.ndarray]] = []
    bits = max(1, radius.bit_length())
    for at in range(0, len(group_of), step):
        g, r = group_of[at : at + step], row_of[at : at + step]
        own = lanes[g, r]
        over = closed[g].copy()
        over[np.arange(len(g)), r // 64] |= np.uint64(1) << (r % 64).astype(np.uint64)
        counters = [np.zeros_like(over) for _ in range(bits)]
        for p in range(len(planes)):
            carry = planes[p][g] ^ (np.uint64(0) - ((own[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)))[:, None]
            for c in counters:
                # A carry-save half adder: the sum bit stays, the carry goes to the next counter bit.
                onward = c & carry
                c ^= carry
                carry = onward
            over |= carry
            if p % 8 == 7 and p >= radius:
                over |= _exceeds(counters, radius)
                live = (over != ALL).any(axis=1)
                if not live.any():
                    g = g[:0]
                    break
                if live.sum() < 0.7 * len(live):
                    g, r, own, over = g[live], r[live], own[live], over[live]
                    counters = [c[live] for c in counters]
        if len(g):
            near = ~over
            for i in np.flatnonzero(near.any(axis=1)):
                found.append((int(g[i]), int(r[i]), near[i]))
    return found


def members(mask: np.ndarray) -> np.ndarray:
    """Lane numbers of a mask."""
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))


def components(rows: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Rows of each component of the rows' masks."""
    out = []
    seen: set[int] = set()
    for root in sorted(rows):
        if root in seen:
            continue
        reached = np.zeros_like(rows[root])
        reached[root // 64] |= np.uint64(1) << np.uint64(root % 64)
        front = np.array([root])
        while len(front):
            spread = np.bitwise_or.reduce(np.stack([rows[int(x)] for x in front])) & ~reached
            reached |= spread
            front = members(spread)
        inside = members(reached)
        seen.update(inside.tolist())
        out.append(inside)
    return out
