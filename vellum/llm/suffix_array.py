"""Linear suffix sorting by grouping, and longest common prefixes.

Suffixes are grouped by their Lyndon prefix. Groups are taken in descending
order: each suffix of a group looks up its previous smaller one (the nearest
earlier suffix of a lower group), and those found move up within their own group
by how many of the group's suffixes point at them, since that many copies of the
group's prefix are appended to theirs. After the last group each group holds the
suffixes of one Lyndon prefix; within it they are ordered as the suffixes that
follow that prefix, so walking the array once in order emits every group, with
no renaming and no recursion.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of text in order. The end of text sorts before every symbol."""
    n = len(text) + 1
    order = sorted(range(n - 1), key=text.__getitem__)
    order.insert(0, n - 1)  # the empty suffix
    place, start, size, length = [0] * n, [0] * n, [0] * n, [0] * n
    first = 0
    for i, s in enumerate(order):
        if i < 2 or text[s] != text[order[i - 1]]:
            first = i
        place[s], start[s] = i, first
        size[first] += 1
        length[first] = 1
    before = [-1] * n
    end = n
    while end > 1:
        group = start[order[end - 1]]
        members = sorted(order[group:end])
        pointed: dict[int, int] = {}
        for s in members:
            j = s - 1
            while j >= 0 and start[j] >= group:
                j = before[j]
            before[s] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, c in pointed.items():
            by_count.setdefault(c, []).append(j)
        for c in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for j in by_count[c]:  # to the end of its group, which becomes a group of its own
                h = start[j]
                m = moved[h] = moved.get(h, 0) + 1
                at = h + size[h] - m
                other, old = order[at], place[j]
                order[old], place[other] = other, old
                order[at], place[j] = j, at
            for h, m in moved.items():
                if m == size[h]:
                    length[h] += c * length[group]
                    continue
                size[h] -= m
                new = h + size[h]
                size[new], length[new] = m, length[h] + c * length[group]
                for at in range(new, new + m):
                    start[order[at]] = new
        end = group
    following: list[list[int]] = [[] for _ in range(n)]
    for s in range(n - 1):
        following[s + length[start[s]]].append(s)
    out = [0] * n
    free = list(range(n))
    out[0] = n - 1
    for i in range(n):
        for s in following[out[i]]:
            g = start[s]
            out[free[g]] = s
            free[g] += 1
    return out[1:]


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """lcp[i]: symbols that the suffixes order[i - 1] and order[i] share; lcp[0] is 0."""
    n = len(text)
    rank, lcp, h = [0] * n, [0] * n, 0
    for i, s in enumerate(order):
        rank[s] = i
    for s in range(n):
        if r := rank[s]:
            t = order[r - 1]
            while s + h < n and t + h < n and text[s + h] == text[t + h]:
                h += 1
            lcp[r] = h
            h -= h > 0
        else:
            h = 0
    return lcp
