"""Text columns: normalising, keywords, hashes, simple language marks.

All but :func:`html_text_of` are built from native expressions; null in gives null
out unless said otherwise.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _decomposed() -> tuple[str, str]:
    """The letters that decompose into an ASCII letter and accents, and the letters
    they become."""
    pairs = {}
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        first, *rest = unicodedata.normalize("NFD", chr(cp))
        if rest and first.isascii() and all(unicodedata.combining(x) for x in rest):
            pairs[chr(cp)] = first
    return "".join(pairs), "".join(pairs.values())


ACCENTED, UNACCENTED = _decomposed()
# Letters and signs that no canonical decomposition takes apart.
LETTERS = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "ł": "l", "Ł": "L", "ı": "i", "ħ": "h", "Ħ": "H", "ŋ": "n", "Ŋ": "N", "ŧ": "t", "Ŧ": "T", "№": "No"}
#: White space of any script, the same in Java, RE2 and Python's ``str.split``.
SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"


def strip_accents(c: Column) -> Column:
    """Letters with accents become plain ones; accents that stand alone vanish."""
    return F.regexp_replace(F.translate(c, ACCENTED, UNACCENTED), "[\u0300-\u036f]", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def collapse_all(c: Column) -> Column:
    """Runs of white space of any script become one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def normalize_ascii(c: Column) -> Column:
    """Without accents and other signs beyond ASCII, lower case, single blanks;
    punctuation stays."""
    return collapse_all(F.lower(F.regexp_replace(strip_accents(c), r"[^\x00-\x7F]", "")))


def normalize_db(c: Column) -> Column:
    """Without accents (and ß as ss, æ as ae and their like), lower case; every run
    of signs that are no letter or digit of any script is one blank."""
    plain = F.translate(c, *map("".join, zip(*((k, v) for k, v in LETTERS.items() if len(v) == 1), strict=True)))
    for letter, two in ((k, v) for k, v in LETTERS.items() if len(v) == 2):
        plain = F.replace(plain, F.lit(letter), F.lit(two))
    return collapse_all(F.regexp_replace(F.lower(strip_accents(plain)), r"[^\p{L}\p{N}\s]+", " "))


def canonicalize(c: Column) -> Column:
    """Lower case, single blanks, plain quotes; null becomes empty."""
    return F.coalesce(collapse(F.regexp_replace(F.lower(c), "[“”„«»‘’']", '"')), F.lit(""))


# Legal forms and country words left out of firm names.
FIRM_WORDS = "ag|sa|gmbh|sarl|kg|co|ltd|inc|genossenschaft|schweiz|suisse|svizzera|switzerland|holding|group"


def normalize_firm(c: Column) -> Column:
    plain = F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9 ]", " ")
    return collapse(F.regexp_replace(plain, rf"\b({FIRM_WORDS})\b", " "))


_EDGE = "(^|[^a-z0-9_])", "([^a-z0-9_]|$)"


def word_pattern(term: str) -> str:
    """A pattern for ``term`` between word edges, the same in Java, RE2 and
    Python."""
    return _EDGE[0] + re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", term) + _EDGE[1]


def spaced_letters(term: str) -> str | None:
    """A pattern for a short word whose letters are set apart by one sign, for two
    to five letters (a third sign is optional in the longer ones)."""
    if not 2 <= len(term) <= 5 or not term.isalpha():
        return None
    sep = r"[.\-_/ ]"
    return _EDGE[0] + term[0] + sep + (sep + "?").join(term[1:]) + _EDGE[1]


def flexible_phrase(term: str) -> str:
    """Blanks and hyphens of a phrase match any run of blanks and separators."""
    return r"[\s_/.\-]*".join(re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", w) for w in re.split(r"[\s\-]+", term))


def pattern_classes(terms: list[str]) -> dict[str, list[str]]:
    """Keywords by the way they are searched: with dots, short, phrases, long."""
    out: dict[str, list[str]] = {"dotted": [], "short": [], "phrase": [], "long": []}
    for t in sorted(set(terms)):
        out["dotted" if "." in t else "phrase" if re.search(r"[\s\-]", t) else "short" if len(t) <= 5 else "long"].append(t)
    return out


# Ten stop words of each language, in the order ties are decided.
STOP_WORDS = {
    "de": "der die das und ist in den von zu mit".split(),
    "fr": "le la les et est dans de des pour avec".split(),
    "it": "il la le e di che per con del della".split(),
    "en": "the and is in of to for with on at".split(),
}


def language_by_stop_words(c: Column) -> Column:
    """The language with the most of its stop words, ties in the order de, fr, it,
    en; 'unknown' for none or null."""
    t = F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    score = {k: sum((t.contains(f" {w} ").cast("int") for w in ws), F.lit(0)) for k, ws in STOP_WORDS.items()}
    top = F.greatest(*score.values())
    out = F.when(c.isNull() | (top == 0), "unknown")
    for k in STOP_WORDS:
        out = out.when(score[k] == top, k)
    return out


def only_after_numbers(c: Column, word: str = "ml") -> Column:
    """Whether ``word`` occurs and always as a unit behind a digit."""
    t = F.lower(c)
    everywhere, unit = F.regexp_count(t, F.lit(rf"\b{word}\b")), F.regexp_count(t, F.lit(rf"[0-9]\s*{word}\b"))
    glued = F.regexp_count(t, F.lit(rf"[0-9]{word}\b"))
    return (everywhere + glued > 0) & (everywhere + glued == unit)


def md5_content(c: Column) -> Column:
    """Digest of the lower-case text with single blanks; null counts as ''."""
    return F.md5(F.coalesce(collapse_all(F.lower(c)), F.lit("")).cast("binary"))


def app_id(c: Column) -> Column:
    return F.upper(F.md5(c.cast("binary")))


def surrogate_uid(*keys: list[Column]) -> Column:
    """``surr_`` and the SHA-1 of the first combination of columns that are all
    filled, joined by a bar; null if none is complete."""
    out = []
    for cols in keys:
        full = F.lit(True)
        for c in cols:
            full = full & c.isNotNull() & (F.trim(c) != "")
        out.append(F.when(full, F.concat(F.lit("surr_"), F.sha1(F.concat_ws("|", *cols).cast("binary")))))
    return F.coalesce(*out)


def md5_number(c: Column) -> Column:
    """The first eight hex digits of the MD5 as a signed 32-bit number."""
    n = F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.when(n >= 2**31, n - 2**32).otherwise(n)


def codes(c: Column) -> Column:
    """The codes of a list in any notation (JSON, braces, quotes, commas, blanks)
    as an array of strings; null and empty lists give an empty array."""
    parts = F.split(F.coalesce(c, F.lit("")), r"""[\[\]{}()'"|,;\s]+""")
    return F.filter(parts, lambda x: x != "")


def split_pipe(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\|"), F.trim), lambda x: x != "")


#: Cut-offs and marks of the three schemes for p-values.
STARS = {"four": ((0.001, "***"), (0.01, "**"), (0.05, "*"), (0.1, "+")), "dagger": ((0.001, "***"), (0.01, "**"), (0.05, "*"), (0.1, "†")), "three": ((0.01, "***"), (0.05, "**"), (0.1, "*"))}


def significance(p: Column, scheme: str = "four") -> Column:
    out = F.when(p.isNull() | F.isnan(p), "")
    for cut, mark in STARS[scheme]:
        out = out.when(p < cut, mark)
    return out.otherwise("")


def broad_code(c: Column) -> Column:
    return c.endswith("0") | (F.length(c) < 4)


def uuid_or_null(c: Column) -> Column:
    # Fixed value: the form of a UUID.
    return F.when(F.lower(c).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), c)


def year_prefix(c: Column, least: int = 2000, most: int = 2030) -> Column:
    """The year in the first four characters, null outside the range."""
    y = F.substring(c, 1, 4).try_cast("int")
    return F.when(y.between(least, most), y)


def _collapsed(t: str) -> str:
    return " ".join(t.split())


def html_text_of(t: str | None) -> str:
    """Entities decoded, then tags left out, NFKC, lower case, single blanks; null
    becomes empty."""
    return "" if t is None else _collapsed(unicodedata.normalize("NFKC", re.sub(r"<[^>]+>", " ", html.unescape(t))).lower())


def each(f: Callable[[str | None], str | None], c: Column) -> Column:
    """``f`` of every text, in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([f(None if t is None or t is pd.NA else t) for t in texts], dtype=object)

    return run(c)


def text_array(c: Column) -> Column:
    """The trimmed parts of a list written with brackets, quotes and commas; null
    for null, 'null' and lists without any part."""
    bare = F.regexp_replace(c, r"""[\[\]{}'"]""", "")
    parts = F.filter(F.transform(F.split(bare, ","), lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")), lambda x: x != "")
    return F.when((F.trim(c) != "null") & (F.size(parts) > 0), parts)
