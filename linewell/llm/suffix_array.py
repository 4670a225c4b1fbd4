"""Suffix arrays in numpy: of a bounded depth by packed sorts; in full by Larsson-Sadakane refinement, with Kasai common prefixes."""
from __future__ import annotations

import numpy as np

LANE = 64  # positions that a lane of the common-prefix pass walks
STEPS = np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k:k + len(data)]
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes.

    Groups are first those of eight equal bytes. Each round sorts only what is still in a group with others, by the
    group of the position as many bytes ahead as are already compared, which doubles that number, until all are
    told apart. (Common prefixes need the full order, ties included.)
    """
    n = len(data)
    first = words_at(data)
    # later positions first among equals: a suffix that ends within eight bytes stands before longer ones that go on in zeros
    order = (n - 1 - np.argsort(first[::-1], kind="stable")).astype(np.int32)
    rank = np.full(n, -1, np.int64)

    def regroup(slots: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Ranks of the suffixes at ``slots``, where ``new`` marks first ones of groups; returns the slots still undecided."""
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(slots)))
        rank[order[slots]] = np.repeat(slots[starts], sizes)
        return slots[np.repeat(sizes > 1, sizes)]

    key = first[order]
    ends = order > n - 8
    open_slots = regroup(np.arange(n), np.concatenate(([True], (key[1:] != key[:-1]) | ends[1:] | ends[:-1])) if n else np.zeros(0, bool))
    done = 8
    while len(open_slots):
        at = order[open_slots]
        ahead = at.astype(np.int64) + done
        key = rank[at] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[open_slots] = at[by]
        key = key[by]
        open_slots = regroup(open_slots, np.concatenate(([True], key[1:] != key[:-1])))
        done *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, up to ``depth``; 0 for the first.

    Kasai: a suffix shares at least one byte less with its predecessor than the suffix one position to its left does with
    its own. Lanes of positions are walked side by side; each position starts from what its left neighbour leaves.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int32)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    eight = np.concatenate([words_at(data), np.zeros(depth + 8, np.uint64)])
    shared = np.zeros(n, np.int32)
    carry = np.zeros(-(-n // LANE), np.int32)
    for step in range(LANE):
        at = np.arange(step, n, LANE)
        other = before[at]
        length = np.where(other >= 0, carry[:len(at)], 0).astype(np.int32)
        room = np.minimum(depth, n - np.maximum(at, other)).astype(np.int32)
        live = np.flatnonzero((other >= 0) & (length < room))
        while len(live):
            x = eight[at[live] + length[live]] ^ eight[other[live] + length[live]]
            same = (8 - np.searchsorted(STEPS, x, side="right")).astype(np.int32)  # leading bytes without a difference
            length[live] = np.minimum(length[live] + same, room[live])
            live = live[(same == 8) & (length[live] < room[live])]
        shared[at] = length
        carry[:len(at)] = np.maximum(length - 1, 0)
    return shared[order]


START = 5  # bytes that the first sort compares


def _sorted(pos: np.ndarray, key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``pos`` (rising) in the order of ``key``, numbers of so many bits, and marks of the first position of each group of equal keys. Overwrites ``key``.

    Key and position are packed into one number where they fit: numbers are sorted several times faster than an order is found.
    """
    low = int(pos[-1]).bit_length()
    if bits + low <= 64:
        key <<= np.uint64(low)
        key |= pos.view(np.uint64)
        key.sort()
        at = (key & np.uint64((1 << low) - 1)).view(np.int64)
        key >>= np.uint64(low)
    else:
        by = np.argsort(key, kind="stable")
        at, key = pos[by], key[by]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return at, new


def string_groups(data: np.ndarray, size: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``data`` to ``depth`` bytes (5 or more): the positions that have as many ahead of their piece's end, in the order of those
    bytes, and each one's group of equal strings. ``data`` is pieces of ``size`` bytes one after another, one of which has ``depth`` bytes.

    Strings of a length are ranked by a sort of pairs of ranks of half that length; the last pair overlaps. A position takes part
    as long as its piece has that many bytes ahead of it.
    """
    n = len(data)
    left = np.repeat(np.cumsum(size), size) - np.arange(n)
    key = np.zeros(n - START + 1, np.uint64)
    for k in range(START):
        key <<= np.uint64(8)
        key |= data[k:n - START + 1 + k]
    pos = np.flatnonzero(left >= START)
    at, new = _sorted(pos, key[pos], 8 * START)
    rank, done = np.zeros(n, np.uint64), START
    while done < depth:
        group = np.cumsum(new)
        rank[at] = group
        bits, ahead = int(group[-1]).bit_length(), min(done, depth - done)
        done += ahead
        pos = np.flatnonzero(left >= done)
        key = rank[pos]
        key <<= np.uint64(bits)
        key |= rank[pos + ahead]
        at, new = _sorted(pos, key, 2 * bits)
    return at, np.cumsum(new) - 1
