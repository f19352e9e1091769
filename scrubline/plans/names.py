"""Column names compared and rewritten; a few hundred at most, so on the driver."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable


def snake_case(name: str) -> str:
    """name in lower case with underscores between its words."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", str(name))
    return re.sub(r"\W+|_+", "_", spaced).strip("_").lower() or "column"


def name_key(name: str) -> str:
    """The letters and digits of a name in lower case."""
    return re.sub(r"[\W_]+", "", str(name)).lower()


def words(name: str) -> frozenset[str]:
    return frozenset(w for w in snake_case(name).split("_") if w)


def similarity(a: str, b: str) -> float:
    """1 for names that are the same in snake case, else matching blocks blended with shared words, to four places."""
    one, two = snake_case(a), snake_case(b)
    if one == two:
        return 1.0
    blocks = difflib.SequenceMatcher(None, one, two).ratio()
    every = words(a) | words(b)
    shared = len(words(a) & words(b)) / len(every) if every else 0.0
    return round(max(blocks, (blocks + shared) / 2), 4)


def best_match(name: str, candidates: Iterable[str], least: float = 0.0) -> tuple[str | None, float]:
    """The most similar candidate and its similarity; the first of several counts."""
    best: tuple[str | None, float] = (None, 0.0)
    for other in candidates:
        if (score := similarity(name, other)) > best[1]:
            best = (other, score)
    return best if best[1] >= least else (None, 0.0)
