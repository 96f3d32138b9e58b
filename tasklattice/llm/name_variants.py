"""Variant spellings of one firm, linked by merging and matching again.

A profile is a set of spellings with the legal forms seen and the votes on whether
the firm recruits. Profiles that share a blocking key are compared; matching ones
merge, which unites their spellings, initials and forms; the richer profiles enter
blocking again, until no profile merges any more.

Any two spellings that match share a blocking key: the words with up to two
letters left out, so that two words within two edits meet, the full names of
nicknames, and for names with shortened words the initials. A key of many profiles
(a line of business, or a firm of very many spellings) is refined without loss: the
key with each key of each other word (all deletions together two at most) or, if
one of the two is shortened, with its initial. What is still large is compared
whole, in slices.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklattice.llm.canonical_values import edits
from tasklattice.llm.common import fold
from tasklattice.plans.components import components
from tasklattice.plans.lineage import cut

#: Keys of more profiles than this are refined.
BLOCK = 48
#: Most profiles of a key in one slice.
SLICE = 512

# Words that withhold a name.
PLACEHOLDERS = frozenset("anonym anonyme anonimo anonymous vertraulich confidentiel confidenziale confidential diskret discret na ka kein keine keineangabe unbekannt inconnu sconosciuto unknown none null nan unserkunde notreclient nostrocliente ourclient kunde client firma company tbd xxx".split())

# Legal forms and the ways they are written, after folding.
FORMS = (
    ("co kg", r"(?:&|\+|und|et|e)?\s*co\.?\s*kg\b\.?"),
    ("ag", r"\b(?:ag|a\.\s?g\.?|aktiengesellschaft)(?!\w)\.?"),
    ("sarl", r"\b(?:sarl|s\.?\s?a\.?\s?r\.?\s?l)(?!\w)\.?"),
    ("sa", r"\b(?:sa|s\.\s?a\.?|societe anonyme|societa anonima)(?!\w)\.?"),
    ("gmbh", r"\b(?:gmbh|g\.\s?m\.\s?b\.\s?h\.?|gesellschaft mit beschrankter haftung)(?!\w)\.?"),
    ("genossenschaft", r"\b(?:genossenschaft|genoss\.?|gen\.|cooperative|cooperativa)(?!\w)\.?"),
    ("ltd", r"\b(?:ltd|limited|inc|plc)(?!\w)\.?"),
    ("kg", r"\bkg(?!\w)\.?"),
)

# Words that begin the name of a branch, department or country part.
_BRANCH = re.compile(r"\s*[,;(/–-]*\s*\b(?:zweig)?(?:niederlassung|filiale|stelle|standort|geschaftsstelle|succursale|agence|sede|site|branch|abteilung|departement|department|reparto|service du personnel|buro)\b.*$")
_UNIT = re.compile(r"\b(?:hr|human resources|personalabteilung|ressources humaines|risorse umane|personaldienst)\b\.?\s*$")
_COUNTRY = re.compile(r"\(?\b(?:schweiz|suisse|svizzera|switzerland)\b\)?")
_LEET = str.maketrans("013458", "oleasb")

# Short forms of first names.
NICKNAMES = {
    "giuseppe": "beppe peppe pino", "josef": "sepp sepp seppi jupp", "johann": "hans hannes jo", "johannes": "hans hannes", "elisabeth": "lisbeth lisa sissi betty elsi lisi beth", "friedrich": "fritz fredi friedel",
    "francesco": "franco cesco ciccio checco", "katharina": "kathrin kathi kati kaethi kathi trini katja", "margrit": "gritli gritt margrith gret greti", "margaretha": "gret greti gritli", "michael": "michi mike michel", "alexander": "alex sandro xandi sascha", "benjamin": "beni benji ben",
    "jacqueline": "jacky jackie lina", "susanne": "susi sanne", "christian": "chrigu chris", "andreas": "andi res", "thomas": "tom thomi", "daniel": "dani", "robert": "robi rob bob", "antonio": "toni nino", "giovanni": "gianni nino", "heinrich": "heiri heinz", "werner": "werni", "walter": "walti", "peter": "pit peti", "ulrich": "ueli uli", "wilhelm": "willi willy", "rudolf": "ruedi rolf", "maria": "mia mimi", "barbara": "barbla babs babi", "stefan": "steff stefu", "matthias": "matthi hias", "nikolaus": "klaus niki", "emanuele": "lele", "salvatore": "toto turi", "domenico": "mimmo", "vincenzo": "enzo", "lorenzo": "renzo", "filippo": "pippo", "luigi": "gigi gino",
    "william": "bill will", "richard": "dick rick", "charles": "charlie", "edward": "ted eddie", "margaret": "peggy meg", "catherine": "kate cathy", "philippe": "phil", "francois": "fanfan",
}
_DIGRAPH = re.compile("([aou])e")
_FULL: dict[str, frozenset[str]] = {}
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        _FULL[_s] = _FULL.get(_s, frozenset()) | {_full}


def read_name(name: str) -> tuple[list[str], list[str]]:
    """The words of a name, sorted (a dot marks a shortened one), and its legal
    forms. Placeholders give no words."""
    t = fold(unicodedata.normalize("NFKC", name)).replace("’", "'")
    if "".join(ch for ch in t if ch.isalnum()) in PLACEHOLDERS:
        return [], []
    t = _COUNTRY.sub(" ", t)
    head = _BRANCH.sub("", t)
    t = head if re.search(r"\w{3}", head) else t
    t = _UNIT.sub(" ", t)
    forms = []
    for form, pattern in FORMS:
        new = re.sub(pattern, " ", t)
        if new != t and re.search(r"\w{2}", new):
            forms.append(form)
            t = new
    t = re.sub(r"(?<=\w)\.-?(?=\w{2})", "\x00", t)  # "ger.bau" is one shortened word
    out = []
    for w in re.findall(r"[\w\x00']+\.?", t.replace("-", " ")):
        short = w.endswith(".") or "\x00" in w
        w = re.sub(r"[.\x00'_]", "", w)
        if any(ch.isalpha() for ch in w):
            w = w.translate(_LEET)
        if w and (short or w not in ("und", "et", "e", "and", "the", "co")):
            out.append(w + "." * (short or len(w) == 1))
    return sorted(out), sorted(set(forms))


@lru_cache(200_000)
def word_cost(a: str, b: str) -> int:
    """Edits between two words, 0 for a short form or a nickname, 9 if they differ."""
    x, y = a.rstrip("."), b.rstrip(".")
    if x == y:
        return 0
    if a[-1] == "." or b[-1] == ".":
        s, f = (x, y) if len(x) <= len(y) else (y, x)
        it = iter(f)
        return 0 if s[0] == f[0] and all(ch in it for ch in s) else 9
    if (y in _FULL.get(x, ())) or (x in _FULL.get(y, ())) or (_FULL.get(x, frozenset()) & _FULL.get(y, frozenset())):
        return 0
    most = 2 if min(len(x), len(y)) >= 5 and max(len(x), len(y)) >= 6 else 1 if min(len(x), len(y)) >= 4 else 0
    d = edits(x, y, most)
    if d > 0 and (_DIGRAPH.search(x) or _DIGRAPH.search(y)):
        d = min(d, edits(_DIGRAPH.sub(r"\1", x), _DIGRAPH.sub(r"\1", y), most))
    return d if d <= most else 9


def name_cost(a: list[str], b: list[str], most: int = 2) -> int:
    """Least sum of word costs over all one-to-one assignments, 9 above ``most``.
    The same words are the same name, however short they are. One spelling may
    lack up to four words of the other (a town), if three words or more are left
    and all of them are whole and the same."""
    if a and Counter(a) == Counter(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    if not a or len(b) > len(a) + 4 * (len(a) >= 3):
        return 9
    if len(b) > len(a):
        return 0 if not Counter(a) - Counter(b) and all(w[-1] != "." for w in a) else 9
    rest = list(b)
    for w in a:  # equal words first: they always belong together
        if w in rest:
            rest.remove(w)
    left = list(a)
    for w in b:
        if w in left:
            left.remove(w)

    def assign(i: int, free: tuple[str, ...], budget: int) -> int:
        if i == len(left):
            return 0
        best = 9
        for k, w in enumerate(free):
            if (c := word_cost(left[i], w)) <= budget:
                best = min(best, c + assign(i + 1, (*free[:k], *free[k + 1 :]), budget - c))
        return best

    if len(left) > 5:
        return 9
    d = assign(0, tuple(rest), most)
    # Short forms alone don't name a firm: one full word must agree.
    return d if d <= most and any(w[-1] != "." and len(w) > 3 for w in a) and any(w[-1] != "." and len(w) > 3 for w in b) else 9


def _key(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts)) - 2**63


@lru_cache(50_000)
def _signatures(word: str) -> dict[str, int]:
    """What a whole word shares with every whole word that matches it, and the
    letters left out for it."""
    most = 2 if len(word) >= 5 else 1 if len(word) >= 4 else 0
    out = {"~" + f: 0 for f in (*_FULL.get(word, ()), *([word] if word in NICKNAMES else []))}
    for w in {word, _DIGRAPH.sub(r"\1", word)}:
        last = {w}
        for n in range(most + 1):
            for v in last:
                out[v] = min(n, out.get(v, n))
            last = {v[:i] + v[i + 1 :] for v in last for i in range(len(v)) if len(v) > 1}
    return out


def _initials(words: list[str]) -> set[int]:
    """Names that match by shortened words only hold one each and have the same
    initials."""
    return {_key("initials", *sorted(w[0] for w in words))} if any(w[-1] == "." for w in words) else set()


def _outer_keys(spelling: str) -> set[int]:
    ws = spelling.split(" ")
    return {_key(v) for w in ws if w[-1] != "." for v in _signatures(w)} | _initials(ws)


def _refined_keys(spelling: str, hot: set[int]) -> dict[int, bool]:
    """The finer keys for the hot ones of a spelling. False: only profiles with
    True need to meet this one (a whole word beside shortened ones)."""
    ws = spelling.split(" ")
    n = str(len(ws))
    out = {k: True for k in _initials(ws) & hot}
    for k, w in enumerate(ws):
        if w[-1] == ".":
            continue
        for v, d in _signatures(w).items():
            if _key(v) not in hot:
                continue
            if len(ws) == 1:
                out[_key(v, "", n)] = True
            for j, o in enumerate(ws):
                if j == k:
                    continue
                short = o[-1] == "."
                at = _key("initial", v, o[0], n)
                out[at] = short or out.get(at, False)
                if not short:
                    out |= {_key(*sorted((v, x)), n): True for x, e in _signatures(o).items() if d + e <= 2}
                    if len(ws) >= 3 and v == w:  # a spelling that lacks words has the others whole
                        out[_key("whole", *sorted((w, o)))] = True
    return out


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i in range(0, len(b), 500):  # a profile has about a hundred keys
            part = b.iloc[i : i + 500]
            rows = [(p, k) for p, ss in zip(part["pid"], part["spellings"], strict=True) for k in set().union(*(_outer_keys(s) for s in ss))]
            yield pd.DataFrame(rows, columns=["pid", "key"])


def _refined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i in range(0, len(b), 100):
            part, rows = b.iloc[i : i + 100], []
            for p, ss, hot in zip(part["pid"], part["spellings"], part["hot"], strict=True):
                hot, own = set(hot), {}
                for s in ss:
                    for k, asks in _refined_keys(s, hot).items():
                        own[k] = asks or own.get(k, False)
                rows += [(p, k, asks) for k, asks in own.items()]
            yield pd.DataFrame(rows, columns=["pid", "key", "asks"])


def _matches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = []
        for sa, sb, fa, fb, ra, rb in zip(b["sa"], b["sb"], b["fa"], b["fb"], b["ra"], b["rb"], strict=True):
            apart = pd.notna(ra) and pd.notna(rb) and bool(ra) != bool(rb) and not set(fa) & set(fb)
            keep.append(not apart and any(name_cost(x.split(" "), y.split(" ")) <= 2 for x in sa for y in sb))
        yield b.loc[keep, ["a", "b"]]


def _candidates(profiles: DataFrame) -> DataFrame:
    """Pairs of profiles (a < b) that share a block."""
    n = 2 * profiles.sparkSession.sparkContext.defaultParallelism  # few rows, much work for each
    profiles = profiles.repartition(n, "pid")
    keys = cut(profiles.select("pid", "spellings").mapInPandas(_keys, "pid bigint, key bigint"))
    counted = cut(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1), "key"))
    small = counted.filter(F.col("n") <= BLOCK).select("key", "pid")
    pairs = small.join(small.select("key", F.col("pid").alias("b")), "key").filter(F.col("pid") < F.col("b")).select(F.col("pid").alias("a"), "b")
    hot = counted.filter(F.col("n") > BLOCK).groupBy("pid").agg(F.collect_list("key").alias("hot"))
    fine = cut(profiles.join(hot, "pid").select("pid", "spellings", "hot").mapInPandas(_refined, "pid bigint, key bigint, asks boolean"))
    sizes = fine.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("asks").alias("asked")).filter((F.col("n") > 1) & F.col("asked"))
    sized = cut(fine.join(sizes.select("key", F.ceil(F.col("n") / SLICE).cast("int").alias("slices")), "key"))
    # Who asks goes to every slice of the key, so each pair meets once.
    asking = sized.filter("asks").select("key", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("pid").alias("p"))
    asked = sized.select("key", F.pmod(F.xxhash64("pid"), F.col("slices")).cast("int").alias("slice"), F.col("pid").alias("q"), "asks")
    met = asking.join(asked, ["key", "slice"]).filter((F.col("p") < F.col("q")) | ~F.col("asks"))
    return cut(pairs.unionByName(met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))).distinct())


def firms(rows: DataFrame) -> DataFrame:
    """``rows`` has company_name and company_is_recruiter. One row per different
    name that isn't null, blank or a placeholder: (company_name, firm), where firm
    is a number that all spellings of the firm share. Names without any letter or
    digit are left out; an empty input gives no rows.

    Firms of one name core are kept apart if one recruits and the other does not
    and no legal form is seen in both; a name without a vote that fits both is
    joined only to the one of its own legal form.
    """
    rec = F.col("company_is_recruiter").cast("int")
    names = rows.filter(F.col("company_name").isNotNull()).groupBy("company_name").agg(F.coalesce(F.sum(rec), F.lit(0)).alias("yes"), F.coalesce(F.sum(1 - rec), F.lit(0)).alias("no"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = [read_name(n) for n in b["company_name"]]
            out = b.assign(spelling=[" ".join(w) for w, _ in parsed], forms=[f for _, f in parsed])
            yield out[out["spelling"] != ""]

    vote = F.when(F.col("yes") > F.col("no"), True).when(F.col("no") > F.col("yes"), False)
    read_names = names.mapInPandas(read, "company_name string, yes bigint, no bigint, spelling string, forms array<string>")
    own = cut(read_names.withColumn("pid", F.xxhash64("spelling", F.concat_ws(",", "forms"), F.coalesce(vote.cast("string"), F.lit("?")))))
    profiles = own.groupBy("pid").agg(F.collect_set("spelling").alias("spellings"), F.first("forms").alias("forms"), F.sum("yes").alias("yes"), F.sum("no").alias("no")).withColumn("recruits", vote)
    where = own.select("company_name", F.col("pid").alias("firm"))
    while True:
        side = lambda x: profiles.select(F.col("pid").alias(x), F.col("spellings").alias(f"s{x}"), F.col("forms").alias(f"f{x}"), F.col("recruits").alias(f"r{x}"))
        pairs = _candidates(profiles).join(side("a"), "a").join(side("b"), "b")
        spread = pairs.select("a", "b", "sa", "sb", "fa", "fb", "ra", "rb").repartition(2 * profiles.sparkSession.sparkContext.defaultParallelism, "a", "b")
        links = cut(spread.mapInPandas(_matches, "a bigint, b bigint"))
        known = profiles.select(F.col("pid"), "forms", "recruits")
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = ends.join(known.select(F.col("pid").alias("a"), F.col("forms").alias("fa"), F.col("recruits").alias("ra")), "a").join(known.select(F.col("pid").alias("b"), F.col("forms").alias("fb"), F.col("recruits").alias("rb")), "b")
        ends = cut(ends)
        both = ends.filter(F.col("ra").isNull()).groupBy("a").agg((F.bool_or("rb") & ~F.bool_and("rb")).alias("torn"))
        sure = ends.join(both, "a", "left").filter(~F.coalesce("torn", F.lit(False)) | F.arrays_overlap("fa", "fb"))
        # A link of a torn profile must hold from its side.
        good = sure.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") == 2)
        joined = components(good, "a", "b")
        if joined.isEmpty():
            return where
        moved = joined.select(F.col("id").alias("pid"), "component")
        label = F.coalesce("component", "pid")
        profiles = cut(
            profiles.join(moved, "pid", "left")
            .groupBy(label.alias("pid"))
            .agg(F.array_distinct(F.flatten(F.collect_list("spellings"))).alias("spellings"), F.array_distinct(F.flatten(F.collect_list("forms"))).alias("forms"), F.sum("yes").alias("yes"), F.sum("no").alias("no"))
            .withColumn("recruits", vote)
        )
        where = cut(where.join(moved.withColumnRenamed("pid", "firm"), "firm", "left").select("company_name", F.coalesce("component", "firm").alias("firm")))


def linked_names(rows: DataFrame) -> DataFrame:
    """Every pair of different names of one firm: (name_a, name_b), name_a < name_b
    by code points."""
    f = firms(rows)
    return f.select("firm", F.col("company_name").alias("name_a")).join(f.select("firm", F.col("company_name").alias("name_b")), "firm").filter(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
