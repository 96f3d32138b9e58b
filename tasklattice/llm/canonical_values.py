"""Free-entered values mapped to the closest entry of a reference list.

A prefix-filter set-similarity join. Each value is reduced to its word windows
(so that a title inside an ad's sentence, before a place or after "wanted" is
found), each window and each reference title to the set of letter pairs of its
words. Pairs are ordered by global rarity; only the rare prefix of each set is
joined, with the length and positional filters; the Jaccard similarity of what is
left is computed exactly. Surviving pairs are confirmed by edit distance or as an
abbreviation, and the best is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklattice.llm.common import fold
from tasklattice.plans.lineage import cut

#: Least Jaccard similarity of two sets of letter pairs to be compared further.
THRESHOLD = 0.3

_BRACKETS = re.compile(r"\([^)]*\)|\[[^\]]*\]")
_SHARE = re.compile(r"\d+(?:[.,]\d+)?\s*(?:[-–]\s*\d+\s*)?%?")
_GENDER = re.compile(r"\b(?:[mwfdhx](?:\s*/\s*[mwfdhx])+)\b|[:*]in(?:nen)?\b", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_HYPHEN = re.compile(r"(?<=\w)[-­‐‑](?=\w)")
_SHORT_TAIL = re.compile(r"(\w+)[-‐‑](\w{2,3}(?:in)?)\b")
_DOT_INSIDE = re.compile(r"(?<=[^\W\d_])\.(?=[^\W\d_])")
_CAPITALS = re.compile(r"[A-Z]{2}")
_VOWELS = frozenset("aeiouy")

#: Endings of male forms and what they become in female ones.
_FEMALE = {
    "de": (("mann", "frau"), ("mann", "in"), ("eur", "euse"), ("", "in")),
    "fr": (("teur", "trice"), ("eur", "euse"), ("eur", "eure"), ("ier", "iere"), ("er", "ere"), ("ien", "ienne"), ("if", "ive"), ("ef", "effe"), ("al", "ale"), ("e", "ee"), ("at", "ate"), ("ant", "ante"), ("il", "ile")),
    "it": (("tore", "trice"), ("tore", "tora"), ("iere", "iera"), ("o", "a"), ("e", "essa")),
    "en": (("man", "woman"), ("er", "ress"), ("or", "ress")),
}


def words(text: str) -> list[tuple[str, bool]]:
    """The folded words of ``text`` and whether each looks abbreviated (a dot
    follows, capitals inside a word or few of them alone, a short last part after
    a hyphen, or a few consonants alone). Percentages, bracketed remarks and
    gender marks are left out; hyphens inside words join."""
    t = _GENDER.sub(" ", _SHARE.sub(" ", _BRACKETS.sub(" ", text)))
    tails = {a + b for a, b in _SHORT_TAIL.findall(t)}
    t = _HYPHEN.sub("", t)
    out = []
    for m in _WORD.finditer(t):
        raw = m.group().replace("'", "").replace("’", "")
        folded = fold(raw)
        dotted = t[m.end() : m.end() + 1] == "."
        capitals = _CAPITALS.search(raw) and (len(raw) <= 3 or not raw.isupper())
        marks = bool(capitals) or raw in tails or (2 <= len(folded) <= 4 and not _VOWELS & set(folded))
        # "Ing.in": what follows the dot belongs to the word
        if out and _DOT_INSIDE.match(t, m.start() - 1) and len(folded) <= 3:
            out[-1] = (out[-1][0] + folded, True)
        else:
            out.append((folded, dotted or marks))
    return out


def windows(text: str, most: int) -> list[tuple[str, bool]]:
    """All runs of up to ``most`` words of ``text``."""
    w = words(text)
    return sorted({(" ".join(x for x, _ in w[i:j]), any(a for _, a in w[i:j])) for i in range(len(w)) for j in range(i + 1, min(len(w), i + most) + 1)})


def pairs_of_letters(window: str) -> list[str]:
    return sorted({p[i : i + 2] for word in window.split(" ") for p in [f"^{word}$"] for i in range(len(p) - 1)})


#: Words of 64 bits that sketch a set of letter pairs.
SKETCH = 4


def sketch(pairs: list[str]) -> list[int]:
    """A bit for each pair, by its hash, as signed words."""
    bits = [0] * SKETCH
    for p in pairs:
        h = crc32(p.encode()) % (64 * SKETCH)
        bits[h // 64] |= 1 << (h % 64)
    return [b - 2**64 if b >= 2**63 else b for b in bits]


def forms(title: str, lang: str) -> set[str]:
    """A reference title and its female forms, folded."""
    base = " ".join(w for w, _ in words(title))
    out = {base}
    parts = base.split(" ")
    for k in range(len(parts)):
        for male, female in _FEMALE[lang]:
            if parts[k].endswith(male) and len(parts[k]) - len(male) >= 2 and (male or k == len(parts) - 1):
                out.add(" ".join([*parts[:k], parts[k][: len(parts[k]) - len(male)] + female, *parts[k + 1 :]]))
    if lang in ("fr", "it"):  # adjectives follow the noun's form: change every word that can change
        for male, female in _FEMALE[lang]:
            changed = []
            for i, p in enumerate(parts):
                pair = (male, female) if i == 0 else next(((m, f) for m, f in _FEMALE[lang] if p.endswith(m) and m in ("al", "o", "e", "if", "il")), None)
                changed.append(p[: len(p) - len(pair[0])] + pair[1] if pair and p.endswith(pair[0]) else p)
            if changed[0] != parts[0]:
                out.add(" ".join(changed))
    return out


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or ``most`` + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def abbreviates(short: str, full: str) -> bool:
    """Whether ``short`` holds some letters of ``full`` in their order, the first
    among them, and at least four in ten."""
    if short[:1] != full[:1] or len(short) < 4 or len(short) < 0.4 * len(full):
        return False
    it = iter(full)
    return all(ch in it for ch in short)


def agreement(window: str, abbreviated: bool, form: str, missing: int = 0, jaccard: float = 1.0) -> float:
    """How surely ``window`` stands for ``form``, 0 for not: 1 where they are
    equal, less by the share of edited letters, at most 0.7 for abbreviations.
    ``missing`` letter pairs of ``form`` are not in ``window``; an edit takes away
    three at most. A word without signs of an abbreviation may lack letters inside
    if first and last one agree and ``jaccard`` is half at least."""
    best = 0.0
    a, b = window.replace(" ", ""), form.replace(" ", "")
    most = 0 if len(b) < 4 else 1 if len(b) < 10 else 2
    if missing <= 3 * most and abs(len(a) - len(b)) <= most:
        tries = {(a, b)}
        if " " in form:
            tries.add(("".join(sorted(window.split(" "))), "".join(sorted(form.split(" ")))))
        for x, y in tries:
            if (d := edits(x, y, most)) <= most:
                best = max(best, 1 - d / len(y))
    if best < 0.7:
        inside = jaccard >= 0.5 and len(a) >= 8 and len(a) >= 0.6 * len(b) and a[-1:] == b[-1:]
        if (abbreviated or inside) and abbreviates(a, b):
            best = max(best, 0.4 + 0.3 * len(a) / len(b))
    return best


def reference_forms(reference: DataFrame) -> DataFrame:
    """``reference`` has isco_code and title_de, title_fr, title_it, title_en:
    (isco_code, form), all different; null titles give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = {(code, f) for lang in _FEMALE for code, t in zip(b["isco_code"], b[f"title_{lang}"], strict=True) if t for f in forms(t, lang)}
            yield pd.DataFrame(sorted(got), columns=["isco_code", "form"])

    return reference.select("isco_code", *(f"title_{x}" for x in _FEMALE)).mapInPandas(run, "isco_code string, form string").distinct()


_BITS = [f"b{i}" for i in range(SKETCH)]
SET_COLUMNS = "pairs array<string>, " + ", ".join(f"{b} bigint" for b in _BITS)


def with_sets(words: pd.Series) -> pd.DataFrame:
    """The set of letter pairs of each window or form, and its sketch."""
    pairs = [pairs_of_letters(x) for x in words]
    return pd.DataFrame({words.name: words.tolist(), "pairs": pairs, **dict(zip(_BITS, zip(*(sketch(p) for p in pairs), strict=True), strict=True))} if pairs else {c: [] for c in (words.name, "pairs", *_BITS)})


def _prefixes(sets: DataFrame, counts: DataFrame, threshold: float, name: str) -> DataFrame:
    """The rare prefix of each set, one row per member, with its position."""
    members = sets.select(name, *_BITS, F.explode("pairs").alias("pair")).join(counts, "pair")
    ordered = members.groupBy(name, *_BITS).agg(F.sort_array(F.collect_list(F.struct("count", "pair"))).alias("s"))
    size = F.size("s")
    rare = F.slice("s.pair", F.lit(1), (size - F.ceil(size * F.lit(threshold)) + 1).cast("int"))
    bits = [F.col(b).alias(f"{name}_{b}") for b in _BITS]
    return ordered.select(name, F.col("s.pair").alias(f"{name}_pairs"), size.alias(f"{name}_n"), *bits, F.posexplode(rare).alias(f"{name}_at", "pair"))


def similar_sets(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of ``left.window`` and ``right.form`` (both with SET_COLUMNS) whose
    Jaccard similarity reaches ``threshold``: (window, form, jaccard, missing).

    Before the sets are intersected, their sketches bound what they can share: the
    common bits, and the members that fell on a bit already taken.
    """
    counts = left.select(F.explode("pairs").alias("pair")).unionByName(right.select(F.explode("pairs").alias("pair"))).groupBy("pair").count()
    a, b = _prefixes(left, counts, threshold, "window"), _prefixes(right, counts, threshold, "form")
    least: Column = F.ceil((F.col("window_n") + F.col("form_n")) * (threshold / (1 + threshold)))
    set_bits = sum((F.bit_count(f"form_{x}") for x in _BITS), F.lit(0))
    b = b.withColumn("form_lost", F.col("form_n") - set_bits)
    common = sum((F.bit_count(F.col(f"window_{x}").bitwiseAND(F.col(f"form_{x}"))) for x in _BITS), F.lit(0))
    joined = a.join(b, "pair").filter(
        (F.col("form_n") >= F.col("window_n") * threshold)
        & (F.col("window_n") >= F.col("form_n") * threshold)
        & (F.lit(1) + F.least(F.col("window_n") - F.col("window_at") - 1, F.col("form_n") - F.col("form_at") - 1) + F.least("window_at", "form_at") >= least)
        & (common + F.col("form_lost") >= least)
    )
    shared = F.size(F.array_intersect("window_pairs", "form_pairs"))
    score = shared / (F.col("window_n") + F.col("form_n") - shared)
    return joined.withColumn("jaccard", score).filter(F.col("jaccard") >= threshold).select("window", "form", "jaccard", (F.col("form_n") - shared).alias("missing")).distinct()


def mapped(values: DataFrame, reference: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``values`` has the column value. One row per different value that stands
    for an entry: (value, isco_code, agreement). Values that stand for none, null
    and empty ones are absent. Among equally good entries the smallest code wins.
    """
    refs = cut(reference_forms(reference))
    # Windows are as long as the longest title, and a word more, as a word may be parted.
    most = 1 + (refs.agg(F.max(F.size(F.split("form", " ")))).first()[0] or 0)

    def cut_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(v, w, a) for v in b["value"] for w, a in windows(v, most)]
            yield pd.DataFrame(rows, columns=["value", "window", "abbreviated"])

    def add_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield with_sets(b.iloc[:, 0])

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = list(zip(b["window"], b["form"], b["missing"], b["jaccard"], strict=True))
            b["plain"] = [agreement(w, False, f, m, j) for w, f, m, j in pairs]
            b["short"] = [p or agreement(w, True, f, 99, j) for (w, f, _, j), p in zip(pairs, b["plain"], strict=True)]
            yield b[b["short"] > 0][["window", "form", "jaccard", "plain", "short"]]

    parts = values.select("value").filter(F.col("value").isNotNull()).distinct().mapInPandas(cut_windows, "value string, window string, abbreviated boolean")
    left = parts.select("window").distinct().mapInPandas(add_pairs, f"window string, {SET_COLUMNS}")
    right = refs.select("form").distinct().mapInPandas(add_pairs, f"form string, {SET_COLUMNS}")
    sure = similar_sets(left, right, threshold).mapInPandas(confirm, "window string, form string, jaccard double, plain double, short double").join(refs, "form")
    # Of one window only the best entry of either kind can win: no hot window meets all its forms again.
    order = lambda c: F.max(F.when(F.col(c) > 0, F.struct(F.col(c).alias("agreement"), F.length("form").alias("n"), "jaccard", (-F.col("isco_code").try_cast("int")).alias("tie"), "isco_code")))
    best = sure.groupBy("window").agg(order("plain").alias("plain"), order("short").alias("short"))
    pick = F.when(F.col("abbreviated"), F.col("short")).otherwise(F.col("plain"))
    # Longer windows that agree as well explain more of the value.
    won = parts.join(best, "window").withColumn("pick", pick).filter(F.col("pick").isNotNull()).groupBy("value").agg(F.max("pick").alias("pick"))
    return won.select("value", F.col("pick.isco_code").alias("isco_code"), F.col("pick.agreement").alias("agreement"))


UNMATCHED = "unmatched"


def map_titles(rows: DataFrame, key: str, column: str, reference: DataFrame) -> DataFrame:
    """(row_key, isco_code) for each different key whose ``column`` isn't null."""
    own = rows.filter(F.col(column).isNotNull()).select(F.col(key).cast("string").alias("row_key"), F.col(column).alias("value")).distinct()
    return own.join(mapped(own, reference), "value", "left").select("row_key", F.coalesce("isco_code", F.lit(UNMATCHED)).alias("isco_code")).distinct()


def map_code_lists(rows: DataFrame, key: str, column: str, crosswalk: DataFrame) -> DataFrame:
    """(row_key, isco_code): each different ISCO code that the codes of the list
    have in ``crosswalk`` (x28_code, isco_19), and 'unmatched' once if any code is
    not in it. The list may be written as JSON, with braces, quotes, commas or
    blanks; whole numbers may have decimals. Null and empty lists give no row."""
    codes = F.filter(F.transform(F.split(F.col(column), r"""[\[\]{}()'"|;,\s]+"""), lambda c: F.regexp_replace(c, r"\.0+$", "")), lambda c: c != "")
    own = rows.select(F.col(key).cast("string").alias("row_key"), F.explode(F.array_distinct(codes)).alias("code")).distinct()
    walk = crosswalk.select(F.trim("x28_code").alias("code"), F.trim("isco_19").alias("isco_code")).filter(F.col("code").isNotNull() & F.col("isco_code").isNotNull()).distinct()
    return own.join(walk, "code", "left").select("row_key", F.coalesce("isco_code", F.lit(UNMATCHED)).alias("isco_code")).distinct()


def map_codes(rows: DataFrame, key: str, column: str, reference: DataFrame) -> DataFrame:
    """(row_key, isco_code) for each different key whose ``column`` isn't null.
    Digits are taken without separators, scheme names and decimals; a value of
    three digits is a code that lost its leading zero, if that code is listed.
    Values without digits are matched as titles."""
    own = rows.filter(F.col(column).isNotNull()).select(F.col(key).cast("string").alias("row_key"), F.col(column).alias("value")).distinct()
    bare = F.regexp_replace(F.regexp_replace(F.lower("value"), r"(ch-?)?isco(-(08|19|88))?", " "), r"^\s*(\d+)\.0+\s*$", "$1")
    digits = F.regexp_replace(F.regexp_extract(bare, r"\d[\d\s.\-]*", 0), r"\D", "")
    known = reference.select(F.trim("isco_code").alias("known")).distinct()
    code = F.when(F.length("digits") == 4, F.col("digits")).when((F.length("digits") == 3) & F.col("plain_number"), F.concat(F.lit("0"), F.col("digits")))
    typed = own.withColumn("digits", digits).withColumn("plain_number", bare.rlike(r"^[\s:]*\d+\s*$")).withColumn("code", code)
    titled = typed.filter(F.col("digits") == "")
    by_title = titled.select("row_key", "value").join(mapped(titled, reference), "value", "left").select("row_key", "isco_code")
    by_code = typed.filter(F.col("digits") != "").join(known, F.col("code") == F.col("known"), "left").select("row_key", F.col("known").alias("isco_code"))
    return by_title.unionByName(by_code).select("row_key", F.coalesce("isco_code", F.lit(UNMATCHED)).alias("isco_code")).distinct()
