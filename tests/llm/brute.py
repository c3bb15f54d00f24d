"""Plain versions of the operators, and small corpora, for the tests of this folder."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return [w for w in SPACE.split(text or "") if w]


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def docs_df(spark, rows):
    """rows: texts, or (doc_id, text), or (doc_id, text, lang, source)."""
    full = []
    for i, r in enumerate(rows):
        r = (i, r) if r is None or isinstance(r, str) else r
        doc_id, text, lang, source = (*r, "en", f"src{i % 3}")[:4] if len(r) < 4 else r
        full.append((doc_id, text, lang, source, None if text is None else len(text)))
    return spark.createDataFrame(full, DOCS)


def components(links: list[tuple[int, int]], nodes: list[int]) -> dict[int, int]:
    up = {n: n for n in nodes}

    def top(n: int) -> int:
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text: str | None, n: int = 5) -> set[tuple[str, ...]]:
    w = words(lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_components(rows: list[tuple[int, str | None]], percent: int = 75) -> list[tuple[int, int, int]]:
    sets = [shingles(t) for _, t in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    comp = components(links, [*range(len(rows))])
    least = defaultdict(list)
    for i, c in comp.items():
        least[c].append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(least[comp[i]])) for i in range(len(rows)))


def without_windows(texts: list[str | None], width: int = 35) -> list[tuple[int, int, list[str]]]:
    """(words, removed, kept words) of each text."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), [x for i, x in enumerate(w) if i not in gone]))
    return out


def prose(rnd: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))
