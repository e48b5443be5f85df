"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import itertools
import re
import string

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text: str | None, fold: bool = True) -> list[str]:
    text = text or ""
    return WORD.findall(text.translate(FOLD) if fold else text)


def shingles(text: str | None) -> frozenset:
    w = words(text)
    if len(w) >= 5:
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def groups(nodes, links) -> dict:
    """The smallest node that each reaches."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_components(texts: dict[int, str | None], percent: int = 75) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in texts.items()}
    holders: dict = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared: dict = {}
    for ids in holders.values():
        for pair in itertools.combinations(sorted(ids), 2):
            shared[pair] = shared.get(pair, 0) + 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    return groups(texts, links)


def edit_distance(a: str, b: str) -> int:
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    w = words(text, fold=False)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen: dict = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
