"""Broken prompt and response pairs, by ordered rules.

The rules look for emptiness, refusal phrases in several languages, copied
prompts, unclosed delimiters and abrupt endings, and a script or language other
than the prompt's. Every rule that applies is emitted with its rank; ``first``
keeps the one of the lowest rank.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklattice.llm import languages
from tasklattice.plans.lineage import cut
from tasklattice.plans.skew import join_groups_back

DEFECTS = ("empty", "refusal", "copy", "truncated", "other_language")

# Words for nothing.
NOTHING = frozenset("na nan null none nil nichts keine kein keines leer entfallt rien aucun aucune neant vide niente nessuno nessuna vuoto nothing empty notapplicable nonapplicable nonapplicabile nichtzutreffend undefined unknown nodata keinedaten".split())

# How a refusal speaks, in German, French, Italian, English and a few
# more languages, without accents. A speaker, a negation and a verb of answering
# must come together, so that tasks that can't be done by hand are none.
_SELF = r"(?:as an? (?:ai |artificial |large )*(?:language model|assistant|ai\b)|als (?:ki[- ]?)?(?:sprachmodell|assistent|ki\b)|en tant qu(?:e modele|'ia\b|'assistant|'intelligence)|come (?:modello linguistico|intelligenza artificiale|assistente)|como modelo de (?:lenguaje|linguagem)|als taalmodel)"
_SORRY = r"(?:i'?m sorry|i am sorry|sorry|i apologi[sz]e|unfortunately|(?:es )?tut mir (?:sehr )?leid|(?:ich )?bedau[e]?re\b|leider|desolee?|je suis desolee?|je regrette|malheureusement|mi dispiace|purtroppo|lo siento|desculpe|het spijt me|przykro mi)"
_SPEAKER = r"\b(?:i|i'?m|me|my|we|ich|mir|mich|je|j'|moi|m'|me|nous|io|mi|mio|posso|sono|puedo|possa|ik|moge|this request|your request|diese anfrage|ihre anfrage|cette demande|votre demande|questa richiesta)(?:\b|(?<='))"
_NOT = r"\b(?:not|cannot|can'?t|won'?t|unable|don'?t|refuse|decline|nicht|kein\w*|ablehnen|unmoglich|pas|impossible|ne puis|ne saurais|refuse|non|impossibile|rifiut\w+|no|nao|niet|nie)\b"
_REPLY = r"\b(?:help|assist|answer|respond|provide|process|complete|comply|extract|fulfill?|generate|continue|support|do (?:this|that|so)|(?:weiter)?helfen|(?:be)?antworten|bearbeiten|liefern|bereitstellen|ausfuhren|erfullen|nachkommen|unterstutzen|extrahieren|verarbeiten|erstellen|entsprechen|repondre|traiter|fournir|aider|donner|satisfaire|effectuer|realiser|extraire|accomplir|generer|rispondere|aiutar\w*|fornire|elaborare|soddisfare|trattare|estrarre|eseguire|completare|ayudar\w*|responder|ajudar|helpen|beantwoorden|pomoc|odpowiedziec)\b"
_PLAINLY = r"against my (?:guidelines|polic(?:y|ies))|\bi (?:must|have to) (?:decline|refuse)|\bi (?:refuse|decline) to\b|\bi (?:do not|don't) have enough information|verstosst gegen meine|muss ich ablehnen|contraire a mes (?:regles|directives)|contro le mie (?:linee|regole)|devo rifiutare"
_PLAIN_REFUSAL, _BEGINS, _HAS_NOT, _HAS_SPEAKER, _HAS_REPLY = re.compile(_PLAINLY), re.compile(rf"\W*(?:{_SELF}|{_SORRY})"), re.compile(_NOT), re.compile(_SPEAKER), re.compile(_REPLY)
_FIRST_PERSON = re.compile(r"\b(?:i (?:can(?:no|'?)t|can not|won'?t|will not|am (?:unable|not able)|do not|don't)|i'm (?:unable|not able)|(?:kann|darf|werde|konnte|mochte) ich|ich (?:kann|darf|werde|bin|konnte)|je (?:ne|n')|(?:il )?m'est impossible|impossible (?:pour moi )?de|(?:io )?non (?:posso|sono in grado|mi e possibile|riesco)|no puedo|nao posso|ik kan|nie moge)\b|^\W*unable to\b")

_FENCE = re.compile(r"```[a-zA-Z]*")
_WRAP = re.compile(r"^\s*(?:(?:output|input|answer|response|result|antwort|ausgabe|eingabe|ergebnis|reponse|réponse|sortie|entree|entrée|resultat|résultat|risposta|uscita|ingresso|risultato|here is the (?:list|answer|result)|hier ist die (?:liste|antwort))\s*:\s*)+", re.I)
_QUOTED = re.compile(r'"((?:[^"\\]|\\.)*)"')
_WORD = re.compile(r"[^\W\d_]+")
# Words that don't end a statement.
HANGING = frozenset("der die das den dem des ein eine einen einem einer und oder von zu mit für auf aus bei nach über durch le la les un une des du de et ou à au aux avec pour sur dans par en il lo gli i uno di da del della dei delle con per su tra e o the a an of and or to with for on in by from at".split())


_ACCENTS = re.compile("[\u0300-\u036f]")
_FAR = re.compile("[^\x00-\u036f\u2000-\u206f\u20a0-\u20cf]")


def plain(text: str) -> str:
    """Case folded, without accents, with straight apostrophes."""
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKD", text.replace("’", "'")).casefold()
    return "".join(ch for ch in t if not unicodedata.combining(ch)) if _FAR.search(t) else _ACCENTS.sub("", t)


def unwrapped(text: str) -> str:
    """``text`` without fences and leading labels such as ``Answer:``."""
    while True:
        new = _WRAP.sub("", _FENCE.sub("", text)).strip()
        if new == text:
            return new
        text = new


def items_of(text: str | None) -> tuple[list[str], bool]:
    """The statements of a prompt or response in any notation (list, list in a
    string, object, lines), and whether the notation was closed."""
    t = unwrapped(text or "")
    closed = True
    for _ in range(3):
        if not t or t[0] not in '["{':
            break
        try:
            v = json.loads(t)
        except ValueError:
            if t[0] == '"' and not re.match(r'"\s*\[', t):
                closed = t.count('"') % 2 == 0
                break
            closed = False
            found = _QUOTED.findall(t.replace('\\"', '"'))
            return found or [t.strip('[]{}"\n ')], False
        if isinstance(v, str):
            t = unwrapped(v)
            continue
        if isinstance(v, dict):
            v = [x for y in v.values() for x in (y if isinstance(y, list) else [y])]
        if isinstance(v, list):
            return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) if isinstance(x, (dict, list)) else str(x) for x in v if x is not None], True
        return [str(v)] if v is not None else [], True
    return [x.strip() for x in t.splitlines() if x.strip()], closed


_NOT_ALNUM = re.compile(r"[\W_]+")


def letters(text: str) -> str:
    return _NOT_ALNUM.sub("", plain(text))


def is_empty(items: list[str], text: str | None) -> bool:
    if not text:
        return True
    rest = letters(unwrapped(text))
    return not rest or rest in NOTHING or all((x := letters(i)) in NOTHING or not x for i in items)


def declines(statement: str) -> bool:
    """Whether one statement refuses to answer: it says so plainly, or it is an
    apology or speaks as a model, is negated and is about the speaker or about
    answering, or the speaker can't do something that is answering."""
    t = plain(statement)
    if _PLAIN_REFUSAL.search(t):
        return True
    if not _HAS_NOT.search(t):
        return False
    if _BEGINS.match(t):
        return bool(_HAS_REPLY.search(t) or _HAS_SPEAKER.search(t))
    return bool(_FIRST_PERSON.search(t) and _HAS_REPLY.search(t))


def is_refusal(items: list[str]) -> bool:
    """The first statement declines, or half of all statements do."""
    said = [x for x in items if x.strip()]
    return bool(said) and (declines(said[0]) or 2 * sum(map(declines, said)) >= len(said))


def is_copy(prompt: list[str], response: list[str]) -> bool:
    """The response holds the prompt's letters and digits in their order, all of
    them or all but a cut end; one item kept from several is none."""
    p, r = letters("".join(prompt)), letters("".join(response))
    if not r or not p:
        return False
    if r == p:
        return True
    if len(prompt) > 1 and len(response) <= 1 and len(r) < 0.6 * len(p):
        return False
    return (p.startswith(r) and len(r) >= 0.6 * len(p)) or (r.startswith(p) and len(p) >= 0.8 * len(r))


def is_truncated(items: list[str], closed: bool, text: str) -> bool:
    """An unclosed list or string, or a last statement that breaks off."""
    if not closed:
        return True
    if text.count("```") % 2:
        return True
    last = items[-1].rstrip() if items else ""
    if not last:
        return False
    ws = _WORD.findall(last)
    if last[-1] in ",;:-–(/&" or (ws and last[-1].isalpha() and ws[-1].lower() in HANGING):
        return True
    stops = [bool(re.search(r"[.!?…]$", x.strip())) for x in items]
    return len(items) >= 2 and not stops[-1] and all(stops[:-1])


# Where the blocks of a script begin and end.
_SCRIPTS = {"latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)), "cyrillic": ((0x400, 0x4FF),), "greek": ((0x370, 0x3FF),), "arabic": ((0x600, 0x6FF),), "hebrew": ((0x590, 0x5FF),), "cjk": ((0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF)), "indic": ((0x900, 0xDFF),)}


def script(text: str) -> str | None:
    """The script of most letters, None where there are none."""
    if text.isascii():
        return "latin" if _WORD.search(text) else None
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = {k: sum(int(((codes >= a) & (codes <= b)).sum()) for a, b in blocks) for k, blocks in _SCRIPTS.items()}
    return max(n, key=n.get) if any(n.values()) else None


def shares(profiles: languages.Profiles, items: list[str]) -> dict[str, float]:
    """The share of the letters of ``items`` in each language. Items that are not
    surely of one language count for none, unless none is sure."""
    text, spans, at = "\n".join(items), [], 0
    for x in items:
        spans.append((at, at + len(x)))
        at += len(x) + 1
    cos = profiles.cosines(text, spans)
    order = np.sort(cos, axis=1)
    sure = order[:, -1] - order[:, -2] >= languages.LEAD
    if not sure.any():
        return {languages.LANGS[int(profiles.cosines(text, [(0, len(text))])[0].argmax())]: 1.0}
    out: dict[str, float] = {}
    for (a, b), k in ((x, int(c.argmax())) for x, c, s in zip(spans, cos, sure, strict=True) if s):
        out[languages.LANGS[k]] = out.get(languages.LANGS[k], 0) + b - a
    total = sum(out.values()) or 1
    return {k: v / total for k, v in out.items()}


def is_other_language(profiles: languages.Profiles, prompt: list[str], response: list[str]) -> bool:
    p, r = " ".join(prompt), " ".join(response)
    if len(_WORD.findall(r)) < 3 or len(_WORD.findall(p)) < 3:
        return False
    if script(p) != script(r):
        return True
    cos = profiles.cosines(r, [(0, len(r))])[0]
    best = int(cos.argmax())
    rest = sorted(cos)[-2]
    pieces = [x for s in prompt for x in re.split(r"(?<=[.!?])\s+", s) if len(_WORD.findall(x)) >= 3] or prompt
    return cos[best] - rest > 0.03 and shares(profiles, pieces).get(languages.LANGS[best], 0) < 0.25


def defects(profiles: languages.Profiles, prompt: str | None, response: str | None, parsed: tuple[list[str], bool] | None = None) -> list[str]:
    """All defects of a response, in the order of DEFECTS. An empty response may
    also be unclosed; nothing else can be said of it."""
    r, closed = parsed or items_of(response)
    if is_empty(r, response):
        return ["empty"] + ["truncated"] * bool(response and (not closed or response.count("```") % 2))
    p, _ = items_of(prompt)
    copied = is_copy(p, r)
    rules = (
        ("refusal", lambda: is_refusal(r)),
        ("copy", lambda: copied),
        ("truncated", lambda: is_truncated(r, closed, response) or copied and len(letters("".join(r))) < len(letters("".join(p)))),
        ("other_language", lambda: not copied and is_other_language(profiles, p, r)),
    )
    return [name for name, applies in rules if applies()]


_LAST = re.compile(r"([^\W\d_]+)$")
#: A last word breaks off if, of the words seen, less than this share is a whole
#: word (and not the beginning of a longer one) or ends a statement.
RARE = 0.05


def flagged(pairs: DataFrame, profiles: languages.Profiles) -> DataFrame:
    """``pairs`` has step_no, uid, prompt and response: one row per triggered
    defect, (step_no, uid, defect, rank), all different. A null response is empty;
    a null prompt can be neither copied nor of another language.

    A statement may be cut and its list closed again. So the last word of each
    response not yet seen to be truncated is looked up among the words of all
    different statements of its step that are not the last of a response. It
    breaks off if the words it begins outnumber it there (``RARE``), or if it
    hardly ever ends one of them. Both are shares, with half a case added to each
    side, so they mean the same in small and large tables and few cases say
    nothing.

    Plan: each pair is parsed once and what is found is written once. Statements
    collapse to different ones before they are split into words; only words and
    their counts are joined.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: dict[str, list] = {"defects": [], "end": [], "statements": []}
            seen: set[tuple[int, str]] = set()
            for s, p, r in zip(b["step_no"], b["prompt"], b["response"], strict=True):
                parsed = items_of(r)
                d = defects(profiles, p, r, parsed)
                last = _LAST.search(parsed[0][-1].rstrip()) if parsed[0] and not {"empty", "copy", "truncated"} & set(d) else None
                out["defects"].append(d)
                out["end"].append(last and last.group().lower())
                fresh = {(s, x) for x in parsed[0][:-1]} - seen
                seen |= fresh
                out["statements"].append([x for _, x in fresh])
            yield pd.DataFrame({"step_no": b["step_no"], "uid": b["uid"], **out})

    rows = pairs.select("step_no", "uid", "prompt", "response")
    seen = cut(rows.mapInPandas(run, "step_no int, uid bigint, defects array<string>, end string, statements array<string>"))
    rank = F.create_map(*[F.lit(x) for i, d in enumerate(DEFECTS) for x in (d, i)])
    plainly = seen.select("step_no", "uid", F.explode("defects").alias("defect")).withColumn("rank", F.element_at(rank, F.col("defect")))
    statements = seen.select("step_no", F.explode("statements").alias("statement")).distinct()
    split = statements.select("step_no", F.regexp_extract_all(F.lower("statement"), F.lit(r"\p{L}+"), F.lit(0)).alias("w"))
    words = split.select("step_no", F.posexplode("w").alias("at", "word"), F.size("w").alias("size")).groupBy("step_no", "word").agg(F.count("*").alias("n"), F.count_if(F.col("at") == F.col("size") - 1).alias("n_ends"))
    words = cut(words)
    ends = cut(seen.filter(F.col("end").isNotNull()).groupBy("step_no", "end").agg(F.count("*").alias("rows")))
    begun = words.filter(F.length("word") > 1).select("step_no", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))).alias("end"))
    longer = begun.join(ends.select("step_no", "end"), ["step_no", "end"]).groupBy("step_no", "end").agg(F.sum("n").alias("n_longer"))
    known = ends.join(words.withColumnRenamed("word", "end"), ["step_no", "end"], "left").join(longer, ["step_no", "end"], "left").na.fill(0, ["n", "n_ends", "n_longer"])
    share = lambda a, b: (F.col(a) + 0.5) / (b + 1)
    cut_off = known.filter((share("n", F.col("n") + F.col("n_longer")) < RARE) | (share("n_ends", F.col("n")) < RARE)).select("step_no", "end", "rows")
    found = join_groups_back(seen.filter(F.col("end").isNotNull()).select("step_no", "uid", "end"), cut_off, ["step_no", "end"], "rows")
    return plainly.unionByName(found.select("step_no", "uid", F.lit("truncated").alias("defect"), F.lit(DEFECTS.index("truncated")).alias("rank"))).distinct()


def first(flags: DataFrame) -> DataFrame:
    """The defect of the lowest rank of each step and uid."""
    return flags.groupBy("step_no", "uid").agg(F.min(F.struct("rank", "defect")).alias("d")).select("step_no", "uid", F.col("d.defect").alias("defect"))
