"""Alignment of two sequences of lines, and its text in the unified notation.

Lines found once on both sides are anchors if they stand in the same order, the longest such
chain; what lies between two anchors is aligned on its own. Where no line is found once, the
k-th copy on one side stands for the k-th on the other. Time is n log n for each level, and a
level leaves smaller pieces only.
"""

from __future__ import annotations

from bisect import bisect_left

CONTEXT = 3


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of ``pairs``, sorted on the left, that rises on the right as well."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, right) in enumerate(pairs):
        p = bisect_left(tails, right)
        before[k] = at[p - 1] if p else -1
        if p == len(tails):
            tails.append(right)
            at.append(k)
        else:
            tails[p], at[p] = right, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _places(lines: list, first: int, last: int) -> dict:
    """Places of each line between two bounds, by line."""
    out: dict = {}
    for i in range(first, last):
        out.setdefault(lines[i], []).append(i)
    return out


def matches(old: list, new: list) -> list[tuple[int, int]]:
    """Places of equal lines, rising on both sides, that the alignment joins."""
    out = []
    stack = [(0, len(old), 0, len(new))]
    while stack:
        a, b, c, d = stack.pop()
        while a < b and c < d and old[a] == new[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        left, right = _places(old, a, b), _places(new, c, d)
        shared = [line for line in left if line in right]
        single = [line for line in shared if len(left[line]) == len(right[line]) == 1]
        pairs = sorted(p for line in single or shared for p in zip(left[line], right[line]))
        anchors = _chain(pairs)
        out += anchors
        if anchors:
            bounds = [(a - 1, c - 1), *anchors, (b, d)]
            stack += [(i + 1, x, j + 1, y) for (i, j), (x, y) in zip(bounds, bounds[1:])]
    return sorted(out)


def _entries(old: list, new: list) -> list[tuple[str, int, int]]:
    """Sign of every line with the numbers of lines before it on both sides."""
    out, i, j = [], 0, 0
    for x, y in [*matches(old, new), (len(old), len(new))]:
        out += [("-", k, j) for k in range(i, x)]
        out += [("+", x, k) for k in range(j, y)]
        if x < len(old):
            out.append((" ", x, y))
        i, j = x + 1, y + 1
    return out


def _span(start: int, size: int) -> str:
    """A range in a hunk header: lines count from 1; one of no lines names the line before it."""
    return f"{start + (size > 0)}" + ("" if size == 1 else f",{size}")


def unified(old: list[str], new: list[str], context: int = CONTEXT) -> tuple[int, int, str]:
    """Additions, deletions and the unified text; no text for equal sides."""
    entries = _entries(old, new)
    changed = [k for k, (sign, _, _) in enumerate(entries) if sign != " "]
    if not changed:
        return 0, 0, ""
    text, at = ["--- before", "+++ after"], 0
    while at < len(changed):
        last = at
        while last + 1 < len(changed) and changed[last + 1] - changed[last] <= 2 * context + 1:
            last += 1
        part = entries[max(0, changed[at] - context) : changed[last] + context + 1]
        sizes = [sum(sign != other for sign, _, _ in part) for other in "+-"]
        text.append(f"@@ -{_span(part[0][1], sizes[0])} +{_span(part[0][2], sizes[1])} @@")
        text += [sign + (new[j] if sign == "+" else old[i]) for sign, i, j in part]
        at = last + 1
    gone = sum(sign == "-" for sign, _, _ in entries)
    return len(changed) - gone, gone, "\n".join(text)
