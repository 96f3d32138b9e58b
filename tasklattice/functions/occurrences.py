"""Rules on where a short keyword stands: is ``ai``, ``ki`` or ``ia`` the
technology, or a canton, a verb ending or another word?"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_HIT = re.compile(r"\b(?:ai|ki|ia)\b", re.I)
#: Words whose presence within six words marks the technology.
CONTEXT = frozenset("data daten données dati machine maschinelles learning deep neural neuronale model models modelle modell modèles modelli algorithm algorithmen algorithme software digital digitale tech technologie technology intelligence intelligenz intelligenza artificial artificielle artificiale künstliche künstlicher automation automatisierung cloud python engineer".split())
# The codes of the Swiss cantons.
CANTONS = frozenset("AG AI AR BE BL BS FR GE GL GR JU LU NE NW OW SG SH SO SZ TG TI UR VD VS ZG ZH".split())


def is_canton(text: str, at: int, width: int = 50) -> bool:
    """Whether the hit is one of at least three canton codes near each other, or
    follows a word for canton."""
    if text[at : at + 2] != "AI":
        return False
    near = text[max(0, at - width) : at + width]
    codes = {w for w in re.findall(r"\b[A-Z]{2}\b", near)} & CANTONS
    return len(codes) >= 3 or bool(re.search(r"(?:kantone?|cantons?|cantoni?|\bKt\.?)\W{0,3}(?:[A-Z]{2}\W{1,4})*$", text[max(0, at - width) : at], re.I))


def classify(text: str, lang: str = "") -> list[tuple[int, str, str]]:
    """(position, hit, class) of each occurrence: canton, technology, context or
    other. In Italian and French ``ai`` is a word of the language unless its
    letters are capitals or the words around speak of technology."""
    words = [(m.start(), m.group().lower()) for m in re.finditer(r"\w+", text)]
    starts = {a: i for i, (a, _) in enumerate(words)}
    out = []
    for m in _HIT.finditer(text):
        i = starts.get(m.start(), 0)
        around = {w for _, w in words[max(0, i - 6) : i + 7]}
        if is_canton(text, m.start()):
            kind = "canton"
        elif m.group().isupper() and not text.isupper():
            kind = "technology"
        elif around & CONTEXT:
            kind = "context"
        else:
            kind = "technology" if m.group().lower() == "ki" and lang == "de" else "other"
        out.append((m.start(), m.group(), kind))
    return out


def occurrences(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, position, hit, kind), one row per occurrence in the whole text."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, *x) for k, t in zip(b[key], b[column], strict=True) if t for x in classify(t)]
            yield pd.DataFrame(out, columns=[key, "position", "hit", "kind"])

    return rows.select(key, column).mapInPandas(run, f"{key} {kind}, position int, hit string, kind string")
