"""Variant spellings of names: parsing, compatibility and a true edit metric.

The metric is the unrestricted Damerau-Levenshtein distance (insertions, deletions, substitutions and
transpositions of neighbours at cost one each), which keeps the triangle inequality; the restricted
"optimal string alignment" does not and must not be used with pivots.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

PARTICLES = frozenset("de la van von der den del di da du le".split())
SUFFIXES = frozenset("jr sr ii iii iv phd md".split())
FUNCTION = frozenset("of for and the &".split())
#: Abbreviated and spelled-out parts of organisation names.
SPELLED_OUT = {
    "univ": "university", "inst": "institute", "lab": "laboratory", "labs": "laboratory", "laboratories": "laboratory",
    "ctr": "centre", "center": "centre", "dept": "department", "tech": "technology", "comp": "computing", "collab": "collaboration",
    "sci": "science", "eng": "engineering", "natl": "national", "intl": "international", "acad": "academy", "grp": "group",
}
GENERIC = frozenset(SPELLED_OUT.values()) | {"college", "school", "consortium", "team"}
#: Letters that keep their look without a decomposition.
PLAIN = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "đ": "d", "Đ": "D", "ı": "i", "’": "'", "‘": "'", "ʼ": "'", "`": "'", "‐": "-", "‑": "-", "–": "-"})
WORD = re.compile(r"[^\W\d_](?:[\w'\-]|\.-)*\.?|&|,")
NICK = re.compile(r"\"([^\"]+)\"")


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.translate(PLAIN)) if not unicodedata.combining(c)).casefold()


def _is_initial(t: str) -> bool:
    bare = t.rstrip(".")
    return len(bare) == 1 or bool(re.fullmatch(r"(?:\w\.-?)+\w?", t)) and len(bare.replace(".", "").replace("-", "")) <= 3


@lru_cache(100_000)
def parts(name: str) -> tuple[str, str, str, str, str, str]:
    """``(kind, family, given, middle, suffix, nick)`` of a name, folded; ``kind`` is 'o' (organisation), 'p'
    (person, order known) or 'u' (person, two words whose order only the corpus can tell)."""
    text = fold(name)
    nick = (m := NICK.search(text)) and m[1].strip() or ""
    tokens = WORD.findall(NICK.sub(" ", text))
    words = [t for t in tokens if t != ","]
    bare = [SPELLED_OUT.get(t.rstrip("."), t.rstrip(".")) for t in words]
    if any(t in GENERIC for t in bare) or any(t in ("of", "for", "&") for t in bare[1:]):
        core = [t for t in bare if t not in GENERIC and t not in FUNCTION]
        # topic words follow a function word; the proper name is what is left
        topic: list[str] = []
        proper = list(core)
        seen = False
        for i, t in enumerate(bare):
            if t in ("of", "for"):
                seen = True
            elif t in FUNCTION or t in GENERIC:
                continue
            elif seen and (i and bare[i - 1] in FUNCTION):
                topic.append(t)
                proper.remove(t)
        if "," in tokens and tokens.index(",") > 0:
            head = [t for t in tokens[: tokens.index(",")] if t not in FUNCTION]
            if head and all(h.rstrip(".") in core for h in head):
                proper = [h.rstrip(".") for h in head]
                topic = [t for t in core if t not in proper]
        kind = sorted(t for t in bare if t in GENERIC)
        return "o", " ".join(proper), " ".join(kind + sorted(topic)), "", "", ""
    suffix = "".join(t.rstrip(".") for t in words if t.rstrip(".") in SUFFIXES)
    tokens = [t for t in tokens if t.rstrip(".") not in SUFFIXES]
    while tokens and tokens[-1] == ",":
        tokens.pop()
    if "," in tokens:
        k = tokens.index(",")
        family, rest = tokens[:k], [t for t in tokens[k + 1 :] if t != ","]
        order = "p"
    else:
        order = "p"
        first = next((i for i, t in enumerate(tokens) if t in PARTICLES), None)
        if len(tokens) <= 1:
            family, rest = tokens, []
        elif first is not None and first > 0:
            family, rest = tokens[first:], tokens[:first]
        elif first == 0:
            k = max(i for i, t in enumerate(tokens) if t in PARTICLES) + 2
            family, rest = tokens[:k], tokens[k:]
        elif _is_initial(tokens[0]):
            k = next((i for i, t in enumerate(tokens) if not _is_initial(t)), len(tokens) - 1)
            family, rest = tokens[k:], tokens[:k]
        elif _is_initial(tokens[-1]):
            family, rest = tokens[:1], tokens[1:]
        elif any(_is_initial(t) for t in tokens[1:-1]):
            k = max(i for i, t in enumerate(tokens[:-1]) if _is_initial(t)) + 1
            family, rest = tokens[k:], tokens[:k]
        else:
            family, rest = tokens[-1:], tokens[:-1]
            order = "u"
    family = [t.rstrip(".") for t in family]
    rest = [t.rstrip(".").replace(".", "") for t in rest]
    long = [t for t in rest if not (len(t.replace("-", "")) <= 2 and (len(t) == 1 or "-" in t))]
    if long:
        k = rest.index(long[0])
        given = "-".join(long) if order == "u" or k == 0 and len(long) > 1 else long[0]
        middle = "".join(t[0] for t in rest if t not in long)
    else:
        given, middle = (rest[0] if rest else ""), "".join(t[0] for t in rest[1:])
    return order, " ".join(family).replace("-", " "), given.replace("-", " ").strip(), middle, suffix, nick


def damerau(a: str, b: str) -> int:
    """The unrestricted Damerau-Levenshtein distance."""
    if a == b:
        return 0
    last: dict[str, int] = {}
    n, m = len(a), len(b)
    big = n + m
    d = [[big] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    for j in range(m + 1):
        d[1][j + 1] = j
    for i in range(1, n + 1):
        col = 0
        for j in range(1, m + 1):
            i1, j1 = last.get(b[j - 1], 0), col
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, col = 0, j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1))
        last[a[i - 1]] = i
    return d[n + 1][m + 1]


def encode(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, padded by -1, and lengths."""
    size = max((len(x) for x in names), default=0)
    out = np.full((len(names), max(1, size)), -1, np.int32)
    for i, x in enumerate(names):
        out[i, : len(x)] = np.frombuffer(x.encode("utf-32-le"), np.int32)
    return out, np.array([len(x) for x in names], np.int32)


def damerau_many(one: str, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The distance of ``one`` to every row of ``encode``'s arrays, all rows at once."""
    rows, width = codes.shape
    n = len(one)
    big = n + width + 1
    d = np.full((n + 2, width + 2, rows), big, np.int16)
    d[1, 1:] = np.arange(width + 1, dtype=np.int16)[:, None]
    d[1:, 1] = np.arange(n + 1, dtype=np.int16)[:, None]
    seen: dict[int, int] = {}
    at = np.arange(rows)
    for i in range(1, n + 1):
        c = ord(one[i - 1])
        col = np.zeros(rows, np.int64)
        for j in range(1, width + 1):
            x = codes[:, j - 1]
            equal = x == c
            best = np.minimum(np.minimum(d[i, j] + (1 - equal), d[i + 1, j] + 1), d[i, j + 1] + 1)
            for ch, i1 in seen.items():  # transpositions end where this column's letter came before in ``one``
                hit = np.flatnonzero((x == ch) & (col > 0))
                if len(hit):
                    best[hit] = np.minimum(best[hit], d[i1, col[hit], at[hit]] + (i - i1) + (j - col[hit] - 1))
            d[i + 1, j + 1] = best
            col[equal] = j
        seen[c] = i
    return d[n + 1, lengths + 1, at].astype(np.int32)
