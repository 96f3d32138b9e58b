"""Per-document statistics that tell running prose from lists, tables and junk.

Tables show in vertical alignment: the same delimiter as often in every line, or
columns of blanks at the same places. Lists show in markers at the starts of
lines, in a period of indentation, and in stacked short lines that end no
sentence. Junk shows in the ratios of words, letters and symbols, in repeated
words or lines, and in the traces of code and broken encodings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent words of German, French, Italian and English.
COMMON = frozenset(
    "der die das und in den von zu mit ist sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wir ihr ihre ihnen uns unser unsere "
    "le la les de des du et en un une dans que qui est pour au aux par sur plus ce ne pas se avec il elle sont son sa ses ou mais nous vous votre vos notre nos ont été cette leur si ainsi dont lors chez "
    "il lo gli di del della dei delle che è per con una non si da dal alla nel nella sono come più anche ha suo sua suoi sue loro questo questa ai al dalla sul sulla presso ogni ma lei "
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so what our your about into than how when them".split()
)

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_MARK = re.compile(r"\s*(?:[-*•·–—‣▪○●►>+]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)])\s+\S")
_CLOSERS, _STOPS = "»\"”'’)]", (".", "!", "?", "…")
_NUMBER = re.compile(r"[+\-]?\d[\d.,'’%:/\-]*")
_CODE = re.compile(r"(?:\bat\s+[\w.$<>]+\s*\(|0x[0-9a-fA-F]{2,}|Traceback|Exception|\bFile \"[^\"]*\", line \d+|</?[a-zA-Z][^>]{0,80}>|[{};]\s*$|(?<!\w)\w++\(\w*+\)\s*[;{]|=>|::|&[a-z]{2,6};|\$\{|\{\{|%[sd]\b|\b(?:var|function|const|return|import|def|null|undefined|NaN)\b)", re.M)
#: What every trace of code, or of a broken encoding, holds.
_MAYBE_CODE = re.compile(r"[<{};$%&(]|=>|::|0x|Traceback|Exception|File \"|var|function|const|return|import|def|null|undefined|NaN")
_MAYBE_BROKEN = re.compile("[�\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9fÃÂâ]")
_LOST = re.compile(r"[?¦¤§¬¨](?<=[^\W\d_].)(?=[^\W\d_])")
_NOT_ALNUM = re.compile(r"[\W_]+")
_NOT_DIGIT = re.compile(r"\D+")
_BROKEN = re.compile(r"[�\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]|[ÃÂâ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹Œ¢£¤¥¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿]|Ã.")
_TEMPLATE = re.compile(r"\{\{?[\w .]+\}?\}|\[\[?[\w .]+\]?\]|<%.*?%>|\$\{.*?\}|<<[^>]*>>|%%\w+%%|lorem ipsum|\bX{3,}\b|_{3,}", re.I)
_MENU = re.compile(r"(?:\s[|›»>/·•]\s|\s{2,}|<<|>>)")
_DELIMITERS = ("\t", "|", ";", ",")

STATS = ("n_words", "n_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "common_share", "end_share", "mark_share", "delimiter_alignment", "blank_alignment", "indent_period", "length_autocorrelation", "short_line_share", "entropy", "repeat_share", "duplicate_line_share", "code_share", "broken_share", "longest_word")


def delimiter_alignment(lines: list[str]) -> float:
    """Share of the lines that hold the most frequent number (two columns at
    least) of the delimiter that aligns best; a comma followed by a blank is
    ordinary punctuation."""
    best = 0.0
    lines = [x.rstrip(" ;,") for x in lines]
    for d in _DELIMITERS:
        counts = [x.count(",") - x.count(", ") if d == "," else x.count(d) for x in lines]
        (k, n), *_ = Counter(counts).most_common(1)
        if k == 0:
            rest = Counter(c for c in counts if c)
            if not rest:
                continue
            k, n = rest.most_common(1)[0]
        best = max(best, n / len(lines))
    return best


def blank_alignment(lines: list[str]) -> float:
    """Share of the lines that fall into the most frequent number (two at least)
    of columns set apart by two or more blanks."""
    counts = Counter(len(re.split(r"\s{2,}", x)) for x in (x.strip() for x in lines) if len(x.split()) > 1)
    n = max((v for k, v in counts.items() if k >= 2), default=0)
    return n / len(lines)


def periodicity(values: list[int]) -> float:
    """Largest autocorrelation at lags of one to four, 0 where nothing varies."""
    v = np.asarray(values, dtype=float)
    if len(v) < 4 or not v.std():
        return 0.0
    v = v - v.mean()
    return float(max((v[:-k] * v[k:]).sum() / (v * v).sum() for k in range(1, min(5, len(v) - 1))))


def words(text: str) -> list[str]:
    """The words of a text in lower case."""
    low = text.lower()
    return _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]


def ended(line: str) -> bool:
    """Whether a line ends in a stop, closing quotes and brackets aside."""
    return line.rstrip().rstrip(_CLOSERS).endswith(_STOPS)


def statistics(text: str | None) -> dict[str, float]:
    """The statistics of one text; all 0 for a null or blank one."""
    out = dict.fromkeys(STATS, 0.0)
    text = text or ""
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines:
        return out
    low = words(text)
    tokens = text.split()
    solid = sum(map(len, tokens))
    letters = sum(map(len, low))
    digits = len(_NOT_DIGIT.sub("", text))
    counts = Counter(low)
    lengths = [len(x.strip()) for x in lines]
    out["n_words"], out["n_lines"] = len(low), len(lines)
    out["mean_word_length"] = letters / len(low) if low else 0.0
    out["digit_ratio"] = digits / solid
    out["symbol_ratio"] = (solid - len(_NOT_ALNUM.sub("", text))) / solid
    out["common_share"] = sum(counts[w] for w in counts if w in COMMON) / len(low) if low else 0.0
    out["end_share"] = sum(map(ended, lines)) / len(lines)
    out["mark_share"] = sum(bool(_MARK.match(x)) for x in lines) / len(lines)
    if len(lines) >= 2:
        out["delimiter_alignment"], out["blank_alignment"] = delimiter_alignment(lines), blank_alignment(lines)
    out["indent_period"] = periodicity([len(x) - len(x.lstrip()) for x in lines])
    out["length_autocorrelation"] = periodicity(lengths)
    out["short_line_share"] = sum(n <= 70 for n in lengths) / len(lines)
    total = sum(counts.values())
    out["entropy"] = -sum(n / total * log2(n / total) for n in counts.values()) if total else 0.0
    # Words that stand again within the four before them, prose seldom does that.
    out["repeat_share"] = sum(w == a or w == b or w == c or w == d for w, a, b, c, d in zip(low, [None, *low], [None] * 2 + low, [None] * 3 + low, [None] * 4 + low)) / max(1, len(low) - 1)
    out["duplicate_line_share"] = 1 - len({x.strip() for x in lines}) / len(lines)
    out["code_share"] = sum(bool(_MAYBE_CODE.search(x) and _CODE.search(x)) for x in lines) / len(lines)
    out["broken_share"] = len(_BROKEN.findall(text)) / solid if _MAYBE_BROKEN.search(text) else 0.0
    out["longest_word"] = max(map(len, tokens), default=0)
    return out


def sentences_of(text: str) -> tuple[int, float, int]:
    """How many sentences of four words or more with common words the text has,
    with wrapped lines joined, the share of the words in them, and how many of
    them end in a stop."""
    n = inside = total = stops = 0
    for p in re.split(r"\n\s*\n", text):
        for s in re.split(r"(?<=[.!?…])\s+", " ".join(p.split())):
            w = words(s)
            total += len(w)
            if len(w) >= 4 and sum(x in COMMON for x in w) >= max(1, 0.12 * len(w)):
                n += 1
                inside += len(w)
                stops += ended(s)
    return n, inside / total if total else 0.0, stops


def wrapped(lines: list[str]) -> bool:
    """Whether the lines, but the last, are about equally long, as in wrapped text."""
    n = [len(x.strip()) for x in lines]
    return max(n) >= 40 and min(n[:-1], default=0) >= 0.6 * max(n)


def stacked(s: dict[str, float]) -> bool:
    """Whether the lines stand in a pattern that prose has not: indented in a
    period, or short and of lengths that come again in a period."""
    return s["n_lines"] >= 6 and (s["indent_period"] >= 0.5 or s["length_autocorrelation"] >= 0.6 and s["short_line_share"] >= 0.9)


def kind(text: str | None, s: dict[str, float] | None = None) -> str:
    """``prose``, ``list``, ``table`` or ``junk``; a null or blank text is junk."""
    text = text or ""
    s = s or statistics(text)
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines or not s["n_words"]:
        cells = [c for x in lines for c in re.split(r"[\t|;,]|\s{2,}", x.strip()) if c.strip()]
        numbers = len(lines) >= 2 and len(cells) >= 2 * len(lines) and all(_NUMBER.fullmatch(c.strip()) for c in cells)
        return "table" if numbers and max(s["delimiter_alignment"], s["blank_alignment"]) >= 0.8 else "junk"
    if s["broken_share"] > 0.02 or text.count("�") + len(_LOST.findall(text)) > 0.02 * len(text):
        return "junk"
    if len(lines) >= 3 and s["duplicate_line_share"] > 0.6:
        return "junk"
    if s["code_share"] >= 0.5 and s["common_share"] < 0.2:
        return "junk"
    aligned = max(s["delimiter_alignment"], s["blank_alignment"])
    if len(lines) >= 2 and aligned >= 0.8 and s["mark_share"] < 0.5 and s["common_share"] < 0.25:
        return "table"
    if s["symbol_ratio"] > 0.35 and s["common_share"] < 0.15 and s["mark_share"] < 0.8:
        return "junk"
    if s["mark_share"] >= 0.6 and len(lines) >= 2 and s["end_share"] < 0.6:
        return "list"
    sentences, share, stops = sentences_of(text)
    if s["longest_word"] > 60 and share < 0.5:
        return "junk"
    if s["n_words"] >= max(8, 12 * len(lines)) and s["repeat_share"] > 0.3 and s["common_share"] < 0.45:
        return "junk"
    if len(_TEMPLATE.findall(text)) >= max(1, len(lines) / 2):
        return "junk"
    if stacked(s) and s["n_words"] <= 8 * len(lines):
        return "list"
    if sentences and share >= 0.5 and (stops or len(lines) <= 2 or wrapped(lines)):
        return "prose"
    if len(_MENU.findall(text)) >= 3 * len(lines) and s["common_share"] < 0.2:
        return "junk"
    if len(lines) >= 3 and s["end_share"] < 0.5:
        return "list"
    if s["common_share"] >= 0.15 or sentences:
        return "prose"
    return "list" if len(lines) >= 2 and s["symbol_ratio"] < 0.2 else "junk"


def document_statistics(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, the statistics in STATS and doc_kind.
    Texts are read whole; null and blank ones have zeros and are junk. No shuffle:
    rows are read in Arrow batches and stay in their partitions."""
    kind_of_key = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[column], strict=True):
                s = statistics(t)
                rows.append((k, *s.values(), kind(t, s)))
            yield pd.DataFrame(rows, columns=[key, *STATS, "doc_kind"])

    return docs.select(key, column).mapInPandas(run, f"{key} {kind_of_key}, " + ", ".join(f"{x} double" for x in STATS) + ", doc_kind string")


def not_prose(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_kind) of the documents that are not running prose."""
    return document_statistics(docs).filter(F.col("doc_kind") != "prose").select("doc_id", "doc_kind").distinct()
