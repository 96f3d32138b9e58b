"""Many keywords at once: one automaton pass over each text, so that the time
hardly depends on how many terms are looked for."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tasklattice.functions.text import flexible_phrase, pattern_classes

try:
    import ahocorasick
except ImportError:  # the same results by one pattern for all terms
    ahocorasick = None

_INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


class Keywords:
    """Terms searched in lower-case text. In :meth:`words` each stands between
    word edges; in :meth:`any` dotted and short ones do, long ones stand anywhere,
    and the blanks and hyphens of phrases match any run of separators."""

    def __init__(self, terms: tuple[str, ...]):
        self.terms = sorted({t for t in terms if t})
        kinds = pattern_classes(self.terms)
        self.whole = frozenset(kinds["dotted"] + kinds["short"])
        self.anywhere = frozenset(kinds["long"])
        # A phrase is tried where its first word stands.
        self.phrases: dict[str, list[re.Pattern]] = {}
        for t in kinds["phrase"]:
            self.phrases.setdefault(re.split(r"[\s\-]+", t)[0] or t[:1], []).append(re.compile(flexible_phrase(t)))
        self._find = self._automaton(self.terms)
        self._find_any = self._automaton(sorted(self.whole | self.anywhere | set(self.phrases)))

    @staticmethod
    def _automaton(words: list[str]):
        if not words:
            return lambda text: ()
        if ahocorasick:
            a = ahocorasick.Automaton()
            for w in words:
                a.add_word(w, w)
            a.make_automaton()
            return lambda text: ((end + 1 - len(w), w) for end, w in a.iter(text))
        return lambda text: ((m.start(), w) for w in words for m in re.finditer(f"(?={re.escape(w)})", text))

    @staticmethod
    def _edged(text: str, at: int, end: int) -> bool:
        return (at == 0 or text[at - 1] not in _INNER) and (end == len(text) or text[end] not in _INNER)

    def words(self, text: str) -> list[str]:
        """The sorted terms between word edges."""
        found: set[str] = set()
        for at, w in self._find(text):
            if w not in found and self._edged(text, at, at + len(w)):
                found.add(w)
        return sorted(found)

    def any(self, text: str) -> bool:
        for at, w in self._find_any(text):
            if w in self.anywhere or w in self.whole and self._edged(text, at, at + len(w)) or any(p.match(text, at) for p in self.phrases.get(w, ())):
                return True
        return False


@cache
def _of(terms: tuple[str, ...]) -> Keywords:
    return Keywords(terms)


def matched(c: Column, terms: list[str]) -> Column:
    """The sorted terms that stand between word edges in the text, in any case,
    joined by a comma and a blank; '' for none and for null."""
    key = tuple(terms)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        k = _of(key)
        return pd.Series([", ".join(k.words(t.lower())) if isinstance(t, str) else "" for t in texts], dtype=object)

    return run(c)


def any_of(c: Column, terms: list[str]) -> Column:
    """Whether the text, in any case, holds one of ``terms``; false for null."""
    key = tuple(terms)

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        k = _of(key)
        return pd.Series([isinstance(t, str) and k.any(t.lower()) for t in texts], dtype=bool)

    return run(c)
