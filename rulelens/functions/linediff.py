"""The lines two texts share, in order: where one has to be changed to get the other."""

from bisect import bisect_left

import numpy as np

# Up to so many pairs of lines the longest common run of lines is worked out exactly.
EXACT_PAIRS = 4_000_000


def _longest_common(a, b):
    """`(i, j)` of a longest common subsequence, from a table of lengths filled row by row."""
    length = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, line in enumerate(a):
        grown = np.maximum(length[i, 1:], length[i, :-1] + (b == line))
        np.maximum.accumulate(grown, out=length[i + 1, 1:])
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if length[i, j] == length[i - 1, j]:
            i -= 1
        elif length[i, j] == length[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def _anchors(a, b):
    """`(i, j)` of lines that are there once on both sides, as many as keep their order (patience)."""
    once_a, first_a, count_a = np.unique(a, return_index=True, return_counts=True)
    once_b, first_b, count_b = np.unique(b, return_index=True, return_counts=True)
    _, at_a, at_b = np.intersect1d(once_a[count_a == 1], once_b[count_b == 1], assume_unique=True, return_indices=True)
    pairs = sorted(zip(first_a[count_a == 1][at_a].tolist(), first_b[count_b == 1][at_b].tolist()))
    tops, ends, before = [], [], [-1] * len(pairs)  # piles: their smallest last j, and whose pair that is
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before[k] = ends[pile - 1] if pile else -1
        tops[pile : pile + 1], ends[pile : pile + 1] = [j], [k]
    run, k = [], ends[-1] if ends else -1
    while k >= 0:
        run.append(pairs[k])
        k = before[k]
    return run[::-1]


def common_lines(old, new, exact_pairs=EXACT_PAIRS):
    """`(i, j)` of lines taken as unchanged, rising on both sides.

    Equal first and last lines are unchanged. What is between them has as many unchanged lines as possible where it is
    small; where it is large it is first cut at lines that are unique on both sides. A large part without such
    lines is taken as changed as a whole.
    """
    known = {}
    a, b = (np.array([known.setdefault(line, len(known)) for line in side], np.int64) for side in (old, new))
    found, open_parts = [], [(0, len(a), 0, len(b))]
    while open_parts:
        i, i_end, j, j_end = open_parts.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            found.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        if (i_end - i) * (j_end - j) <= exact_pairs:
            found += [(i + x, j + y) for x, y in _longest_common(a[i:i_end], b[j:j_end])]
            continue
        cuts = [(i + x, j + y) for x, y in _anchors(a[i:i_end], b[j:j_end])]
        found += cuts
        starts = [(i, j), *((x + 1, y + 1) for x, y in cuts)]
        if cuts:
            open_parts += [(x, x_end, y, y_end) for (x, y), (x_end, y_end) in zip(starts, [*cuts, (i_end, j_end)])]
    return sorted(found)


def _slid(before, after, old, new):
    """Two neighbouring changes as one where that changes no more lines, else None.

    Lines that were only removed (or only added) may as well be those one line further up if the line before them equals
    their last one; likewise further down.
    """
    (i, i_end, j, j_end), (k, k_end, m, m_end) = before, after
    gap = k - i_end
    for side, low, high, one_sided in ((old, k, k_end, m == m_end), (new, m, m_end, k == k_end)):
        if one_sided and all(side[low - s] == side[high - s] for s in range(1, gap + 1)):
            return (i, k_end - gap, j, m_end - gap)
    for side, low, high, one_sided in ((old, i, i_end, j == j_end), (new, j, j_end, i == i_end)):
        if one_sided and all(side[low + s] == side[high + s] for s in range(gap)):
            return (i + gap, k_end, j + gap, m_end)
    return None


def changes(old, new, exact_pairs=EXACT_PAIRS):
    """`(i, i_end, j, j_end)`: old lines i to i_end became new lines j to j_end (from 0, ends not included).

    Of equally short ways to say it, one with removed and added lines at one place is preferred.
    """
    out, i, j = [], 0, 0
    for x, y in [*common_lines(old, new, exact_pairs), (len(old), len(new))]:
        if x > i or y > j:
            change = (i, x, j, y)
            while out and (joined := _slid(out[-1], change, old, new)):
                out.pop()
                change = joined
            out.append(change)
        i, j = x + 1, y + 1
    return out


def hunks(found, n_new, context=3):
    """`(first, end, changes)` of the new side: changes with the lines around them; those that meet are one hunk."""
    out = []
    for change in found:
        first, end = max(0, change[2] - context), min(n_new, change[3] + context)
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], end, [*out[-1][2], change])
        else:
            out.append((first, end, [change]))
    return out
