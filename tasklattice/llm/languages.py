"""Languages of texts and of their segments, by hyperdimensional profiles.

Each letter has a random vector of plus and minus ones. A run of three letters is
bound into one vector: the letters' vectors, permuted (rolled) by their place and
multiplied. A text is the bundle (sum) of its runs; so is the prototype of a
language. The language of a text is the prototype with the highest cosine.

Bundling is linear, so the product of a text with a prototype is the sum over its
runs of the run's product with the prototype. These products are computed once for
every possible run (``table``), and a text costs one lookup a letter; running sums
give the product of any segment. The length of a bundle is the square root of the
dimension times the number of runs, as the runs' vectors are nearly orthogonal.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklattice.llm.common import bounded_sample, filled

LANGS = ("de", "fr", "it", "en")
DIMENSION = 8192
#: Letters with a vector of their own; all other characters are word boundaries.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßàâéèêëîïôûùçìòæœ'"
_N = len(LETTERS) + 1
#: At most so many labelled ads are read to fit the prototypes.
SAMPLE = 3000

#: Where prototypes begin before they see labelled texts: plain sentences.
SEED = {
    "de": "Wir suchen eine Person, die gerne mit Menschen arbeitet und sich für unsere Aufgaben begeistert. Sie haben eine abgeschlossene Ausbildung und mehrere Jahre Erfahrung. Zu Ihren Aufgaben gehören die Planung und die Kontrolle der Arbeiten sowie der Austausch mit unseren Kundinnen und Kunden. Wir bieten Ihnen einen sicheren Arbeitsplatz, gute Leistungen und viel Freiheit. Haben wir Ihr Interesse geweckt? Dann freuen wir uns auf Ihre Bewerbung. Bitte senden Sie uns die Unterlagen mit einem kurzen Schreiben. Der Betrieb liegt nahe beim Bahnhof und ist gut zu erreichen. Es werden nur Bewerbungen berücksichtigt, welche dem Profil entsprechen. Wer schon einmal ein Team geführt hat, ist im Vorteil. Das Pensum kann nach Absprache auch kleiner sein. Die Anstellung ist nicht befristet und der Lohn wird jedes Jahr neu geprüft. Für Fragen stehen wir gerne zur Verfügung, auch am Telefon.",
    "fr": "Nous cherchons une personne qui aime travailler avec les gens et qui s'intéresse à nos activités. Vous avez une formation achevée et plusieurs années d'expérience. Vos tâches comprennent la planification et le contrôle des travaux ainsi que les échanges avec nos clients. Nous vous offrons un emploi sûr, de bonnes prestations et beaucoup de liberté. Ce poste vous intéresse ? Alors nous nous réjouissons de recevoir votre candidature. Merci de nous envoyer le dossier avec une courte lettre. L'entreprise se trouve près de la gare et elle est facile d'accès. Seules les candidatures qui correspondent au profil seront prises en compte. Si vous avez déjà dirigé une équipe, c'est un avantage. Le taux peut aussi être plus petit selon accord. Le contrat n'est pas limité et le salaire est revu chaque année. Nous répondons volontiers à vos questions, aussi par téléphone.",
    "it": "Cerchiamo una persona che ama lavorare con la gente e che si interessa alle nostre attività. Lei ha una formazione conclusa e diversi anni di esperienza. I suoi compiti comprendono la pianificazione e il controllo dei lavori nonché gli scambi con i nostri clienti. Le offriamo un impiego sicuro, buone prestazioni e molta libertà. Questo posto le interessa? Allora aspettiamo con piacere la sua candidatura. Ci mandi per favore la documentazione con una breve lettera. La ditta si trova vicino alla stazione ed è facile da raggiungere. Saranno prese in considerazione solo le candidature che corrispondono al profilo. Chi ha già guidato una squadra parte con un vantaggio. Il grado di occupazione può anche essere più piccolo secondo accordo. Il contratto non è limitato e lo stipendio viene rivisto ogni anno. Rispondiamo volentieri alle sue domande, anche per telefono.",
    "en": "We are looking for a person who likes to work with people and who cares about what we do. You have a completed degree and several years of experience. Your duties include the planning and review of the work as well as talking with our clients. We offer you a safe job, good benefits and a lot of freedom. Does this sound like you? Then we look forward to your application. Please send us the file with a short letter. The company is close to the station and easy to reach. Only applications that fit the profile will be considered. Anyone who has led a team before will have an advantage. The workload can also be smaller if we agree on it. The contract is not limited and the salary is reviewed every year. We are happy to answer your questions, also on the phone.",
}

# Codes and names of the four languages in labels.
_LABELS = {
    "de": "de deu ger gsw deutsch german allemand tedesco schweizerdeutsch",
    "fr": "fr fra fre frz francais französisch franzosisch french francese",
    "it": "it ita italiano italienisch italien italian",
    "en": "en eng english englisch anglais inglese",
}
LABELS = {w: k for k, v in _LABELS.items() for w in v.split()}
NO_LABEL = ("", "-", "und", "unknown")

_BREAK = re.compile(r"(?<=[.!?…])[\"”»')\]]*\s+(?=\S)|[\r\n]+|\s+[•*]\s+")
_FIELD = re.compile(r"\s*[-*•–]?\s*[^\W\d_][^:.!?\n]{0,28}\s?:\s?\S.{0,40}")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
# Gender marks of titles.
_MARKS = (("de", re.compile(r"\b(?:[mw]/[wm](?:/[dx])?|[wm]/[mw]/d)\b", re.I)), ("fr", re.compile(r"\b(?:h/f|f/h)\b", re.I)), ("en", re.compile(r"\bm/f/d\b|all genders|\bfull[ -]time\b", re.I)), ("it", re.compile(r"\bm/f\b(?!/)", re.I)))


def label_language(label: str | None) -> str | None:
    """de, fr, it or en for a label; '' where there is none, None for another
    language."""
    t = (label or "").strip().lower()
    if t in NO_LABEL:
        return ""
    t = t.replace("ç", "c")
    return LABELS.get(t) or LABELS.get(re.split(r"[-_ (]", t)[0])


def _codes() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    for i, ch in enumerate(LETTERS, 1):
        table[ord(ch)] = i
        if len(ch.upper()) == 1:
            table[ord(ch.upper())] = i
    table[ord("’")] = table[ord("'")]
    return table


class Profiles:
    """The products of the known runs of letters with the prototypes."""

    def __init__(self, counts: np.ndarray, seed: int = 7):
        """``counts``: for each language how often each run occurs. A prototype
        bundles the runs by how much more usual they are in its language than in
        the others (log share, centred over the languages). Runs seen less than
        twice have no vector and tell nothing."""
        self.counts = counts
        rng = np.random.default_rng(seed)
        letters = rng.choice(np.array([-1, 1], dtype=np.int8), (_N, DIMENSION))
        first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
        used = np.flatnonzero(counts.sum(axis=0) >= 2)
        used = used[used > 0]
        share = np.log((counts[:, used] + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * len(used)))
        weights = (share - share.mean(axis=0)).astype(np.float32)
        bound = lambda ids: (first[ids // (_N * _N)] * second[ids // _N % _N] * letters[ids % _N]).astype(np.float32)
        blocks = [used[i : i + 1024] for i in range(0, len(used), 1024)]
        prototypes = np.zeros((len(LANGS), DIMENSION), dtype=np.float32)
        for i, ids in enumerate(blocks):
            prototypes += weights[:, i * 1024 : i * 1024 + len(ids)] @ bound(ids)
        prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
        self.table = np.zeros((_N**3, len(LANGS)), dtype=np.float32)
        for ids in blocks:
            self.table[ids] = bound(ids) @ prototypes.T / np.sqrt(DIMENSION)

    _code = None

    @classmethod
    def runs(cls, text: str) -> np.ndarray:
        """The number of the run that ends at each character."""
        if cls._code is None:
            cls._code = _codes()
        codes = cls._code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int32)
        padded = np.concatenate(([0, 0], codes))
        return (padded[:-2] * _N + padded[1:-1]) * _N + padded[2:]

    @classmethod
    def count(cls, texts: Iterable[str]) -> np.ndarray:
        runs = cls.runs("\n".join(texts))
        return np.bincount(runs, minlength=_N**3).astype(np.float64) * (np.arange(_N**3) > 0)

    def cosines(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        """Cosine of each span of ``text`` with each prototype."""
        runs = self.runs(text)
        sums = np.zeros((len(runs) + 1, len(LANGS)))
        np.cumsum(self.table[runs], axis=0, out=sums[1:])
        n = np.concatenate(([0], np.cumsum(self.table[runs, 0] != 0)))
        a, b = np.asarray(spans, dtype=np.int64).reshape(-1, 2).T
        return (sums[b] - sums[a]) / np.sqrt(np.maximum(1, n[b] - n[a]))[:, None]

    def best(self, text: str) -> tuple[str, float]:
        c = self.cosines(text, [(0, len(text))])[0]
        return LANGS[int(c.argmax())], confidence(c)


def confidence(cosines: np.ndarray) -> float:
    """Between 0.25 and 1: the softmax of the cosines, with the scale at which a
    lead of 0.15, usual for a sentence, gives about 0.95."""
    e = np.exp(25 * (cosines - cosines.max()))
    return float(e.max() / e.sum())


def spans_of(text: str) -> list[tuple[int, int, bool]]:
    """Sentences of ``text``: start, end, and whether it is a full sentence (four
    words or more, no field of the form ``label: value``). Runs of text without
    stops are cut into windows of ten words."""
    out, at = [], 0
    for m in [*_BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        if end > at:
            piece = text[at:end]
            n = len(_WORD.findall(piece))
            if n > 24:
                ws = list(_WORD.finditer(piece))
                step = 10
                for i in range(0, n, step):
                    if n - i < step // 2 and i:
                        break
                    last = ws[-1].end() if n - i - step < step // 2 else ws[i + step - 1].end()
                    out.append((at + ws[i].start(), at + last, True))
            elif n:
                out.append((at, end, n >= 4 and not (n < 9 and _FIELD.fullmatch(piece))))
        at = m.end() if m else end
    return out


#: A segment counts for a language of its own from this lead of the cosine on.
LEAD = 0.05
#: A language in which only windows inside other text speak needs more.
LEAD_ALONE = 0.05


def segments(profiles: Profiles, text: str) -> list[tuple[int, int, str, float]]:
    """Maximal segments of one language: start, end, language, confidence. Pieces
    that are no full sentence or unsure belong to the segment before them."""
    text = _HIDDEN.sub("", text)
    spans = spans_of(text)
    if not spans:
        return []
    cos = profiles.cosines(text, [(a, b) for a, b, _ in spans])
    order = np.sort(cos, axis=1)
    lead = order[:, -1] - order[:, -2]
    whole = cos.sum(axis=0)
    names = cos.argmax(axis=1)
    sure = [(full and x >= LEAD) for (_, _, full), x in zip(spans, lead, strict=True)]
    strong = {}
    for k in range(len(LANGS)):
        own = [x for s, n, x in zip(sure, names, lead, strict=True) if s and n == k]
        if own:
            strong[k] = (len(own), max(own))
    main = max(strong, key=lambda k: strong[k][0]) if strong else int(whole.argmax())
    kept = {k for k, (n, x) in strong.items() if k == main or x >= LEAD_ALONE}
    out: list[list] = []
    for i, (a, b, _) in enumerate(spans):
        k = int(names[i]) if sure[i] and names[i] in kept else None
        if out and (k is None or k == out[-1][2]):
            out[-1][1] = b
            out[-1][3].append(i)
        else:
            out.append([a, b, main if k is None else k, [i]])
    merged: list[list] = []
    for s in out:
        if merged and merged[-1][2] == s[2]:
            merged[-1][1] = s[1]
            merged[-1][3] += s[3]
        else:
            merged.append(s)
    return [(a, b, LANGS[k], confidence(cos[idx].mean(axis=0)) if int(cos[idx].mean(axis=0).argmax()) == k else 0.25) for a, b, k, idx in merged]


def title_language(profiles: Profiles, title: str) -> tuple[str, float]:
    for lang, mark in _MARKS:
        if mark.search(title):
            return lang, 0.99
    return profiles.best(title)


def fit(labelled: list[tuple[str, str]], titles: list[tuple[str, str]] = (), rounds: int = 3) -> Profiles:
    """Prototypes from the seed sentences and from labelled texts, whose labels
    may be wrong: in each round a sentence is used only where the prototypes so
    far agree with its label. ``titles`` are trusted."""
    base = np.stack([Profiles.count([SEED[k]]) for k in LANGS])
    for k, t in titles:
        base[LANGS.index(k)] += Profiles.count([t])
    p = Profiles(base)
    pieces = [(LANGS.index(k), x[a:b]) for k, t in labelled for x in [_HIDDEN.sub("", t)] for a, b, full in spans_of(x) if full]
    if not pieces:
        return p
    text = "\n".join(t for _, t in pieces)
    ends = np.cumsum([len(t) + 1 for _, t in pieces])
    starts = ends - [len(t) + 1 for _, t in pieces]
    spans = [(int(a), int(b) - 1) for a, b in zip(starts, ends, strict=True)]
    gold = np.array([k for k, _ in pieces])
    runs = Profiles.runs(text)
    owner = np.repeat(np.arange(len(pieces)), ends - starts)[: len(runs)]
    for _ in range(rounds):
        agree = p.cosines(text, spans).argmax(axis=1) == gold
        own = np.where(agree[owner], gold[owner], -1)
        p = Profiles(base + np.stack([np.bincount(runs[own == k], minlength=_N**3) * (np.arange(_N**3) > 0) for k in range(len(LANGS))]))
    return p


def fitted(rows: DataFrame, labels: DataFrame, reference: DataFrame | None = None, sample: int = SAMPLE) -> Profiles:
    """Prototypes fitted on at most ``sample`` labelled ads, those with the least
    hash of their uid; only these reach the driver."""
    known = labels.filter(_labelled("lang")).select("uid", "lang")
    # Of a few labels many rows may be without text or delivered twice: some 1.5 times the sample is read.
    texts = rows.select("uid", "content_clean").filter(filled("content_clean")).join(known, "uid")
    got = bounded_sample(texts, sample, "uid", known.count())
    titles = [(k, t) for r in (reference.collect() if reference is not None else []) for k in LANGS if (t := r[f"title_{k}"])]
    return fit([(k, r.content_clean) for r in got if (k := label_language(r.lang))], titles)


def fitted_on(rows: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE) -> Profiles:
    """The same for a table whose texts and labels are columns."""
    known = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("lang")).filter(filled("text") & _labelled("lang"))
    got = bounded_sample(known, sample, "key", known.count())
    return fit([(k, r.text) for r in got if (k := label_language(r.lang))])


def _labelled(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.lower(F.trim(column)).isin(*NO_LABEL)


def ad_segments(rows: DataFrame, profiles: Profiles) -> DataFrame:
    """``rows`` has uid, title and content_clean: (uid, start, end, lang,
    confidence), one row per segment of content_clean, or one for the title where
    content_clean is null or blank. Ads with neither, or without any letter, give
    no row. Offsets count characters without the invisible ones (soft hyphens,
    zero-width). Repeated rows of an ad give its segments once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for uid, title, text in zip(b["uid"], b["title"], b["content_clean"], strict=True):
                if text and text.strip():
                    out += [(uid, *s) for s in segments(profiles, text)]
                elif title and _WORD.search(title):
                    out.append((uid, 0, len(title), *title_language(profiles, title)))
            yield pd.DataFrame(out, columns=["uid", "start", "end", "lang", "confidence"])

    return rows.select("uid", "title", "content_clean").mapInPandas(run, "uid string, start int, end int, lang string, confidence double").distinct()


def mislabelled(rows: DataFrame, labels: DataFrame, profiles: Profiles) -> DataFrame:
    """(uid, lang) of the ads without label, with one that names none of their
    languages, or with several languages: one row for each language."""
    t = F.regexp_replace(F.lower(F.trim("label")), "ç", "c")
    head = F.split(t, r"[-_ (]").getItem(0)
    pairs = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    label = F.when(F.col("label").isNull() | t.isin(*NO_LABEL), "").otherwise(F.coalesce(pairs[t], pairs[head], F.lit("other")))
    langs = ad_segments(rows, profiles).groupBy("uid").agg(F.collect_set("lang").alias("langs"))
    own = labels.select("uid", F.col("lang").alias("label")).groupBy("uid").agg(F.max("label").alias("label"))
    wrong = langs.join(own, "uid", "left").filter((F.size("langs") > 1) | (label == "") | ~F.array_contains("langs", label))
    return wrong.select("uid", F.explode("langs").alias("lang"))
