"""Suffix arrays by linear grouping, and the repeated windows that they show."""

from __future__ import annotations

import numpy as np

#: Bytes that may end a symbol, the coarsest set first; the last set is every byte.
ENDS = (b"\n.!?|;", b"\n.!?|;,: ", bytes(range(256)))
LONGEST = 256


def group_suffixes(text: list[int]) -> list[int]:
    """The suffix array of ``text`` (non-negative integers) by Lyndon grouping.

    First the suffixes are grouped by their longest Lyndon prefix. Groups start as the suffixes of
    one symbol and are processed in descending order. For each member the previous smaller suffix
    is found by jumping along the pointers of processed suffixes; the suffixes so reached have the
    processed group's string next, once for each member that points at them, and move to the upper
    end of their own group, the more repeats the higher. Then the order within groups is emitted:
    taken in ascending order, each suffix hands its place to those whose next smaller suffix it
    is, which the pointers list, and each group fills from its start.
    """
    n = len(text)
    order = np.argsort(np.array(text, np.int64), kind="stable").tolist()
    place, start, size = [0] * n, [0] * n, [0] * n
    first, last = 0, None
    for k, i in enumerate(order):
        if text[i] != last:
            first, last = k, text[i]
        place[i] = k
        start[i] = first
        size[first] += 1
    before = [-1] * n
    end = n
    while end:
        low = start[order[end - 1]]
        members = order[low:end]
        end = low
        repeats: dict[int, int] = {}
        if len(members) > 1:
            members.sort()
        for i in members:
            p = i - 1
            while p >= 0 and start[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                repeats[p] = repeats.get(p, 0) + 1
        if not repeats:
            continue
        if len(repeats) == 1:
            ((p, _),) = repeats.items()
            home = start[p]
            if size[home] > 1:  # alone, it stays where it is
                top = home + size[home] - 1
                other, at = order[top], place[p]
                order[at], place[other] = other, at
                order[top], place[p] = p, top
                size[home] -= 1
                start[p], size[top] = top, 1
            continue
        homes: dict[int, list[tuple[int, int]]] = {}
        for p, k in repeats.items():
            homes.setdefault(start[p], []).append((k, p))
        for home, moved in homes.items():
            if size[home] == 1:
                continue
            moved.sort(reverse=True)
            top = home + size[home]
            j = 0
            while j < len(moved):
                k, made = moved[j][0], j
                while j < len(moved) and moved[j][0] == k:
                    p = moved[j][1]
                    top -= 1
                    other, at = order[top], place[p]
                    order[at], place[other] = other, at
                    order[top], place[p] = p, top
                    j += 1
                for _, p in moved[made:j]:
                    start[p] = top
                size[top] = j - made
            if top > home:
                size[home] = top - home
    sorted_suffixes, free, done = [0] * n, list(range(n)), [False] * n
    s, k = n, 0
    while True:
        p = s - 1
        while p >= 0 and not done[p]:
            done[p] = True
            slot = free[start[p]]
            free[start[p]] = slot + 1
            sorted_suffixes[slot] = p
            p = before[p]
        if k == n:
            return sorted_suffixes
        s = sorted_suffixes[k]
        k += 1


def common_symbols(text: list[int], suffixes: list[int]) -> list[int]:
    """Length of the common prefix of each suffix and the one sorted before it (first: 0)."""
    n = len(text)
    rank, out, h = [0] * n, [0] * n, 0
    for r, s in enumerate(suffixes):
        rank[s] = r
    for s in range(n):
        r = rank[s]
        if r:
            o = suffixes[r - 1]
            limit = n - max(s, o)
            while h < limit and text[s + h] == text[o + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out


def symbol_ends(data: np.ndarray, ends: bytes) -> np.ndarray:
    """Offsets after each byte that ends a symbol."""
    table = np.zeros(256, bool)
    table[list(ends)] = True
    return np.flatnonzero(table[data]) + 1


def repeated_starts(texts: list[bytes], window: int) -> list[np.ndarray]:
    """For each text, the starts of windows that start anywhere else too, in it or another text.

    A text is read as symbols: bytes up to and with an ending byte, the coarsest choice whose
    symbols stay under LONGEST bytes and the window; texts of different choices are compared at the finest. No
    symbol is another's proper prefix, so the suffix array over the symbols' ranks is the byte
    order of the suffixes at symbol starts. A window that starts x bytes before such a suffix
    equals another if those x bytes are equal and the suffixes share window - x bytes, that is, lie
    in one run of the suffix array whose neighbours share as many.
    """
    if not texts:
        return []
    arrays = [np.frombuffer(t, np.uint8) for t in texts]
    longest = min(LONGEST, window)
    for ends in ENDS:
        cuts = [symbol_ends(a, ends) for a in arrays]
        gaps = [np.diff(c, prepend=0, append=len(a)) for c, a in zip(cuts, arrays, strict=True)]
        if all(g.max(initial=0) < longest for g in gaps):
            break
    symbols: list[bytes] = []
    owner, begin = [], []
    for k, (text, cut) in enumerate(zip(texts, cuts, strict=True)):
        edges = [0, *cut.tolist()]
        if edges[-1] != len(text):
            edges.append(len(text))
        symbols += [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        symbols.append(b"")  # ends the text
        owner += [k] * len(edges)
        begin += edges
    ranks = {s: i for i, s in enumerate(sorted(set(symbols)))}
    # every end of a text is a symbol of its own, below all others
    codes = [ranks[s] + len(texts) if s else k for s, k in zip(symbols, owner, strict=True)]
    suffixes = group_suffixes(codes)
    shared = common_symbols(codes, suffixes)
    owner_a, begin_a = np.array(owner), np.array(begin)
    order, same = np.array(suffixes), np.array(shared)
    common = np.zeros(len(order), np.int64)
    at = order[1:] + same[1:]
    common[1:] = begin_a[np.minimum(at, len(begin_a) - 1)] - begin_a[order[1:]]
    near = (common < window) & (common > window - 2 * longest)
    for r in np.flatnonzero(near[1:]) + 1:
        at = shared[r]
        common[r] += common_prefix(symbols[suffixes[r] + at], symbols[suffixes[r - 1] + at])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # symbol t of a text reaches back over symbol t - 1
    t = np.flatnonzero(owner_a[1:] == owner_a[:-1]) + 1
    reach = begin_a[t] - begin_a[t - 1]
    offsets = np.cumsum([0, *map(len, texts)])[:-1]
    data = np.concatenate(arrays)
    base = offsets[owner_a[t]] + begin_a[t]
    limit = (np.array([len(x) for x in texts]) - window)[owner_a[t]]
    hashes = np.zeros(len(t), np.uint64)
    found = np.zeros(len(data), bool)
    for x in range(1, int(reach.max(initial=0)) + 1):
        live = np.flatnonzero(reach >= x)
        t, reach, base, limit, hashes = (v[live] for v in (t, reach, base, limit, hashes))
        hashes = (hashes ^ (data[base - x] + np.uint64(1))) * np.uint64(0x9FB21C651E98DF25)
        hashes ^= hashes >> np.uint64(31)
        can = np.flatnonzero(begin_a[t] - x <= limit)
        if not len(can):
            continue
        runs = np.cumsum(common < window - x)[rank[t[can]]].astype(np.uint64)
        keys = (hashes[can] ^ (runs * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
        by_key = np.argsort(keys)
        ordered = keys[by_key]
        equal = ordered[1:] == ordered[:-1]
        twice = np.concatenate(([False], equal)) | np.concatenate((equal, [False]))
        found[base[can[by_key[twice]]] - x] = True
    return [np.flatnonzero(found[o : o + len(x)]) for o, x in zip(offsets, texts, strict=True)]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n
