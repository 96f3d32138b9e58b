"""Personal information in free text, replaced by typed placeholders.

A text is first brought into a plain form by small transducers: look-alike letters
become Latin ones, other scripts' digits and dashes become plain, invisible
characters vanish, ``(at)`` and ``[dot]`` become signs, and runs of spelled digits
become digits. Each step records where its output came from, so what is found in
the plain form is mapped back to the characters of the source, and the rest of the
text stays as it was.

One automaton finds all cue words (forms of address, phrases around contact
persons, street words, document words) in a single pass; patterns are tried only
at the cues.

Names that no phrase announces are weighed: capitalised words after a verb of
asking or before contact data gain by the contact data near them, by an e-mail
address that holds them, by a known first name and by small words around them, and
lose by standing in lower case elsewhere; words of firms, departments and places
rule them out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from tasklattice.llm.common import filled, fold

TYPES = ("email", "phone", "national_id", "address", "name")
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}

# Look-alikes of Latin letters and signs.
_LOOKS = dict(zip("АВЕКМНОРСТХаеорсухіїјѕԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανι＠．＋－‐‑‒–—−／⁄’ʼ`´  　（）٠١٢٣٤٥٦٧٨٩０１２３４５６７８９", "ABEKMHOPCTXaeopcyxiïjsdhABEZHIKMNOPTYXoavi@.+-------//''''   ()01234567890123456789", strict=True))
_LOOKS |= dict.fromkeys("\t\xa0\u2007\u2009\u202f\u3000", " ")
_PLAIN = str.maketrans(_LOOKS)
_INVISIBLE = "­​‌‍⁠﻿"
# Digits spelled in German, French, Italian and English.
_SPELLED = {w: str(i) for words in ("null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "zero uno due tre quattro cinque sei sette otto nove", "zero one two three four five six seven eight nine") for i, w in enumerate(words.split())} | {"zwo": "2", "oh": "0", "fuenf": "5"}
_DIGIT_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_SIGNS = rf"(?P<gone>[{_INVISIBLE}]+)|(?P<space> [ {_INVISIBLE}]+)|(?P<at>[\[({{<]\s*(?:at|ät|ad|a|arobase|chiocciola|@)\s*[\])}}>][^\S\n]*)|(?P<dot>[\[({{<]\s*(?:dot|punkt|point|punto|\.)\s*[\])}}>][^\S\n]*)"
#: A dot said after an at sign, written or disguised: taken only behind one.
_SAID_DOT = r"(?P<saiddot>(?<=\w)[^\S\n]+(?:dot|punkt|point|punto)[^\S\n]+(?=[a-z]))"
_AFTER_AT = re.compile(r"@\s?[\w\-.]+$")
_DISGUISE = re.compile(rf"{_SIGNS}|{_SAID_DOT}", re.I)
_ANY_DOT = r"(?:\.|\s+(?:dot|punkt|point|punto)\s+|\s*[\[({{<]\s*(?:dot|punkt|point|punto|\.)\s*[\])}}>]\s*)".replace("{{", "{").replace("}}", "}")
#: Tried only where the automaton has seen spelled digits in a row or a spoken sign.
_SPOKEN = re.compile(rf"{_SIGNS}|(?P<digits>\b(?:{_DIGIT_WORD})(?:[\s\-,]+(?:{_DIGIT_WORD})){{5,}}\b)|(?P<spoken>(?<=\w)\s(?:at|arobase|chiocciola|klammeraffe)\s+(?=[\w\-]+{_ANY_DOT}[a-z]))|{_SAID_DOT}", re.I)
_LOOKING = re.compile("[" + re.escape("".join(_LOOKS)) + "]")
_MAYBE = re.compile(rf"[{_INVISIBLE}]|  |[\[({{<]\s*(?:at|ät|ad|a|arobase|chiocciola|dot|punkt|point|punto|\.|@)\s*[\])}}>]|@[\w\-.]+[^\S\n]+(?:dot|punkt|point|punto)\s", re.I)


_SAID = re.compile(rf"[\w\-]+{_ANY_DOT}[a-z]")


def lower(text: str) -> str:
    """Lower case, character by character where that would change the length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(ch.lower() if len(ch.lower()) == 1 else ch for ch in text)


class Plain:
    """The plain form of a text and the way back to its source."""

    def __init__(self, source: str):
        self.source = source
        text = source.translate(_PLAIN) if _LOOKING.search(source) else source
        self.at: list[int] | None = None
        self.text, self.low = text, lower(text)
        self.hits = list(cues().iter(self.low))
        spoken = self._spelled() or any("said" in h[1][2] and _SAID.match(self.low, h[0] + 1) for h in self.hits)
        if not spoken and not _MAYBE.search(text):
            return
        out, starts, origins, n, last = [], [], [], 0, 0
        for m in (_SPOKEN if spoken else _DISGUISE).finditer(text):
            begin = m.start()
            if m.lastgroup == "saiddot" and not _AFTER_AT.search("".join(out)[-64:] + text[max(last, begin - 64) : begin]):
                continue
            if m.lastgroup in ("gone", "space"):
                new = "" if m.lastgroup == "gone" else " "
            elif m.lastgroup == "digits":
                new = "".join(_SPELLED[w.lower()] for w in re.findall(r"[^\W\d_]+", m.group()))
            else:
                new = "." if m.lastgroup in ("dot", "saiddot") else "@"
                while begin > last and text[begin - 1] in " \t\xa0":
                    begin -= 1
            for piece, at, same in ((text[last:begin], last, True), (new, begin, False)):
                if piece:
                    out.append(piece)
                    starts.append(n)
                    origins.append((at, begin if same else m.end(), same))
                    n += len(piece)
            last = m.end()
        if last < len(text) or not out:
            out.append(text[last:])
            starts.append(n)
            origins.append((last, len(text), True))
        self.text, self.at, self.origins = "".join(out), starts, origins
        self.low = lower(self.text)
        self.hits = list(cues().iter(self.low))

    def _spelled(self) -> bool:
        """Whether six digits are spelled in a row."""
        run, last = 0, -9
        for end, (length, _, kinds) in self.hits:
            a = end + 1 - length
            if "digit" in kinds and (a == 0 or not self.low[a - 1].isalpha()) and not self.low[end + 1 : end + 2].isalpha():
                run = run + 1 if a - last <= 4 else 1
                last = end
                if run >= 6:
                    return True
        return False

    def back(self, a: int, b: int) -> tuple[int, int]:
        """The span of the source behind the span [a, b) of the plain form."""
        if self.at is None:
            return a, b
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, max(a, b - 1)) - 1
        (s, _, same), (t, end, same_end) = self.origins[i], self.origins[j]
        return s + (a - self.at[i] if same else 0), (t + b - self.at[j] if same_end else end)


# Cue words.
HONORIFICS = "herr|herrn|hr.|frau|fr.|fräulein|madame|mme|mme.|mademoiselle|mlle|monsieur|m.|mr|mr.|mrs|mrs.|ms|ms.|miss|signor|signora|signorina|sig.|sig.ra|sig.na|dr.|dott.|dott.ssa|prof.|ing.|avv.".split("|")
BEFORE = "ansprechperson ist|ansprechpartner ist|ansprechpartnerin ist|kontaktperson ist|auskunft gibt ihnen gerne|auskunft erteilt ihnen gerne|auskunft erteilt|vorgesetzte stelle:|vorgesetzte stelle :|vorgesetzte stelle|gespräch mit|wenden sie sich an|rufen sie bitte|kontakt:|kontakt :|ansprechperson:|personne de contact est|votre contact est|votre interlocuteur est|votre interlocutrice est|renseignements auprès de|adressez-vous à|après un entretien avec|persona di contatto è|persona di riferimento è|informazioni presso|si rivolga a|dopo un colloquio con|risponderà a|contact person is|your contact is|please contact|report to|speak to|after a talk with|vous serez sous la direction de|superiore diretto:|superiore:|responsable hiérarchique :|responsable hiérarchique:|supérieur hiérarchique :|supérieur hiérarchique:".split("|")
AFTER = "répond volontiers|vous répond|is happy to|will be happy to|risponde volentieri|erfahren sie mehr|during the first|gibt ihnen gerne auskunft|beantwortet gerne|beantwortet ihre fragen|vous renseigne|vous donnera|sera ravi|sera ravie|le risponde|sarà lieto|sarà lieta|looks forward|vous accompagne pendant|l'accompagna".split("|")
STREETS_DE = "strasse|straße|str.|weg|gasse|gässli|platz|allee|rain|halde|matte|matt|ring|graben|steig|quai|promenade|hof|berg|acker|wiese".split("|")
NO_STREETS = frozenset("arbeitsplatz parkplatz studienplatz ausbildungsplatz lehrplatz sitzplatz schulungsplatz marktplatz-job arbeitsweg umweg heimweg karriereweg bildungsweg lebensweg berufsweg ausweg rückweg hinweg".split())
STREETS_ROMANCE = "rue|chemin|ch.|avenue|av.|route|rte|place|boulevard|bd|quai|allée|impasse|ruelle|passage|sentier|cours|via|viale|piazza|corso|vicolo|strada|largo|piazzale|salita|contrada|vicoletto".split("|")
STREETS_EN = "street|st.|road|rd|rd.|lane|avenue|ave.|drive|square|close|way|court|place|hill|terrace|gardens|row|crescent|yard|walk".split("|")
DOCUMENTS = "ahv|avs|avs-nr|ausweis|pass|passnummer|reisepass|identitätskarte|id-karte|id-nr|passeport|carte d'identité|passaporto|carta d'identità|passport|identity card|id card|social security|sozialversicherung|assurance sociale|previdenza sociale|sozialversicherungsnummer".split("|")
#: Verbs and prepositions of asking someone, and labels before one.
ASK = "call|contact|email|phone|reach out to|speak with|speak to|talk to|talk with|write to|ask for|get in touch with|hilft|hilft ihnen|berät sie|unterstützt sie|informiert sie|rufen sie|kontaktieren sie|melden sie sich bei|auskunft bei|fragen an|bewerbung an|contactez|contacter|appelez|appeler|écrivez à|demandez|auprès de|joindre|contatti|contattare|chiami|chiamare|scriva a|chieda di|rivolgersi a|presso".split("|")
LABELS = "contact:|contact :|contact person:|contatto:|contatti:|ansprechpartner:|ansprechpartnerin:|kontaktperson:|personne de contact:|personne de contact :|persona di contatto:|referente:|recruiter:|hiring manager:|auskunft:|renseignements:|renseignements :|informazioni:|responsable:|responsable :|vorgesetzter:|vorgesetzte:".split("|")
FIRST_NAMES = "oliver beat lukas regula reto urs sonja giulia anne-lise tamara ruedi yves hans-peter fabio marco luc dario emily claire noémie priska nadia heidi chiara josef elisabeth giuseppe alexander johann benjamin jacqueline margrit friedrich francesco michael katharina peter thomas daniel martin andreas christian stefan markus patrick bruno roland rené kurt werner walter ernst fritz hans max paul karl otto anna maria ursula ruth monika barbara sandra nicole daniela claudia karin brigitte silvia susanne verena christine esther sabine petra corinne franziska eva laura julia lena mia emma lara sara sarah lea nina pierre jean jacques michel philippe andré françois nicolas laurent pascal alain olivier julien antoine louis marie sophie nathalie isabelle catherine sylvie céline camille léa chloé manon luca matteo andrea paolo giovanni antonio roberto stefano alessandro davide simone carlo luigi elena francesca valentina martina paola lucia john james robert william david richard charles mary susan linda jennifer jessica karen nancy lisa betty helen".split()

_NAME = r"[^\W\d_](?:[^\W\d_]|['\-](?=[^\W\d_]))+"
_TITLED = re.compile(rf"\s*(?:(?:dr|prof|med|dipl)\.?\s+)*((?:[^\W\d_]\.\s*)?{_NAME}(?:\s+{_NAME})?)", re.I)
_PERSON = re.compile(rf"\s*((?:[^\W\d_]\.\s?(?:[^\W\d_]\.\s?)?{_NAME})|(?:{_NAME},\s*{_NAME})|(?:{_NAME}\s+{_NAME}(?:\s+(?:[^\W\d_]\.|{_NAME}))?))", re.I)
_PERSON_END = re.compile(rf"((?:[^\W\d_]\.\s?{_NAME})|(?:{_NAME},\s*{_NAME})|(?:{_NAME}\s+{_NAME}))[\s,]*$", re.I)
_NUMBER = re.compile(r"(?<![\w@.+])(?:\(?\+|\(?00|\(?0(?=[\d(\s]))?\s?\(?\d(?:[\s().\-/·]{0,3}\d){6,16}(?![\w@]|[.,']\d)")
_DIGITS = re.compile(r"[+(\d][\d\s().\-/·+]{7,}")
_AHV = re.compile(r"(?<!\d)756[.\s\-]{0,2}\d{4}[.\s\-]{0,2}\d{4}[.\s\-]{0,2}\d{2}(?!\d)")
_SERIAL = re.compile(r"\b(?:[A-Z]\d{7}|[A-Z]{2}\d{6}|[A-Z]\d{2}[A-Z]\d{5})\b", re.I)
_HOUSE = r"\d{1,4}\s?[a-z]?(?![\w%]|\s?%|[.,:'’\-]\d|\s*-\s*\d)"
_AFTER_DE = re.compile(rf"\s+(?:nr\.?\s*)?({_HOUSE})", re.I)
_AFTER_ROMANCE = re.compile(rf"\s+((?:(?:de la|de l'|de|du|des|d'|dei|delle|della|del|di|degli|la|le|les)\s*)?[^\W\d_][\w'\-.]*(?:\s+[^\W\d_][\w'\-.]*){{0,3}}?),?\s+({_HOUSE})", re.I)
_BEFORE_ROMANCE = re.compile(r"(?<![\w.,'’\-/])(?<!\d:)(\d{1,4}\s?[a-z]?),?[^\S\r\n]+$", re.I)
_NAME_ROMANCE = re.compile(r"\s+(?:(?:de la|de l'|de|du|des|d'|dei|delle|della|del|di|degli|la|le|les)\s*)?[^\W\d_][\w'\-]*", re.I)
_BEFORE_EN = re.compile(r"(?<![\w.,'’\-/])(?<!\d:)(\d{1,4}\s?[a-z]?),?[^\S\r\n]+((?:[^\W\d_][\w'\-]*[^\S\r\n]+){1,3})$", re.I)
_TOWN = re.compile(r",?\s*(?:(?:in|à|a)\s+)?(?:CH-?|D-|F-|I-|A-)?\d{4,5}\s+[^\W\d_][\w\-]*(?:[ \-][A-ZÄÖÜ][\w\-]*){0,2}", re.I)
_LOCAL = re.compile(r"[\w.+\-!#%&'*/=?^{|}~]+[^\S\n]{0,3}$")
_DOMAIN = re.compile(r"[^\S\n]{0,3}[\w\-]+(?:[^\S\n]?\.[\w\-]+)*?[^\S\n]?\.[a-z]{2,24}(?![\w\-]|\.\w)", re.I)

_PROJECT = re.compile(r"(?:proje[ck]t|projet|progetto|programm|programme)\w*\s+[\"«„]?$")
_SMALL_BEFORE = re.compile(r"(?:^|\s)[a-zäöüéèàç][\w']*\s+$")
_SMALL_AFTER = re.compile(r",?\s+[^\W\d_][\w\-]*\s+[a-zäöüéèàç]")

# Words that stand in no street name.
_NO_STREET = frozenset("of work the travail lavoro pour près avec dans sur et ou à per circa con e in ce cet qui que dès und für mit".split())

# Words that are no part of a person's name.
NO_NAME = frozenset(
    "der die das den dem des ein eine einen einem einer unser unsere unserer unserem unseren ihr ihre ihrem ihrer wir sie ich und oder mit von zu im in am an auf aus bei für nach über team betrieb firma unternehmen personalabteilung abteilung leitung geschäftsleitung direktion kundendienst hr personaldienst sekretariat werkstatt bitte gerne dort hier uns ihnen wer was mehr ist sind wird werden kann herr frau herrn "
    "le la les un une des du de notre nos votre vos nous vous il elle et ou à au aux en dans sur pour par équipe l'équipe entreprise maison direction service secrétariat vente comptabilité logistique ressources humaines qui que monsieur madame "
    "il lo gli i uno una nostro nostra suo sua noi lei e o a al da di in con per su squadra ditta azienda direzione ufficio reparto servizio segreteria signor signora "
    "the a an our your we you he she they and or to of at in on for by with team company firm department management office service desk staff group finance research workshop warehouse sales hr human resources mr mrs ms someone who".split()
)
_FIRM_WORDS = frozenset("ag sa gmbh sàrl sarl genossenschaft co kg ltd inc immobilien technik informatik gerätebau apotheken sanitär maschinenbau verlag optik holzbau medizintechnik gartenbau treuhand versicherungen bäckerei textilien logistik energie personal".split())


# Words of departments, places and things that follow verbs of asking.
_NO_PERSON = frozenset(
    "kunden kundschaft personen menschen mitarbeitende gemeinde stadt kanton bank spital klinik schule stiftung verein verband amt büro zentrum center centre central customer customers support care reception head headquarters hotline helpdesk recruiting recruitment talent people operations apply today monday tuesday wednesday thursday friday "
    "montag dienstag mittwoch donnerstag freitag stelle stellen bewerbung unterlagen dossier ville commune canton banque hôpital école fondation association bureau centre candidature lundi mardi mercredi jeudi vendredi comune città cantone banca ospedale scuola fondazione associazione candidatura lunedì martedì mercoledì giovedì venerdì "
    "monte ponte castel san santa saint sainte sankt bad lake north south east west rue via strasse platz schweiz suisse svizzera switzerland deutsch french german english italian".split()
)
_NOUN_END = re.compile(r"(?:ung|heit|keit|schaft|tion|strasse|straße|platz|gasse|weg|ismus|tät|ment|abteilung|dienst|stelle|team|leitung)(?:en|s)?$", re.I)
_CAPITAL = r"[^\W\d_a-zß-öø-ÿ](?:[^\W\d_]|['’\-](?=[^\W\d_]))+"
_FULL_NAME = re.compile(rf"[^\S\n]*({_CAPITAL}(?:[^\S\n]+[^\W\d_]\.)?(?:[^\S\n]+(?:von|van|de|di|da|le|la|der|den|ter))*[^\S\n]+{_CAPITAL})(?![\w@])")
_FULL_NAMES = re.compile(rf"(?<![\w@.\-])({_CAPITAL}[^\S\n]+{_CAPITAL})(?![\w@])")
_SMALL = re.compile(r"(?<!\w)[a-zß-öø-ÿ][\w'’\-]*")
#: From this weight on capitalised words are a person's name.
NAME_WEIGHT = 2.5


_STREETS = frozenset((*STREETS_DE, *STREETS_ROMANCE, *STREETS_EN))


@cache
def _known() -> frozenset[str]:
    return frozenset(FIRST_NAMES)


def name_weight(plain: Plain, a: int, b: int, asked: float, contacts: list[tuple[int, int]], locals_: set[str], small: set[str], company: str) -> float:
    """How surely the capitalised words [a, b) name a person. ``asked`` is what
    stands before them worth; ``contacts`` are the spans of e-mail addresses and
    phone numbers in order, ``locals_`` the words of the addresses' local parts,
    ``small`` the words that stand in lower case."""
    text, low = plain.text, plain.low
    ws = re.findall(_NAME, low[a:b])
    firm = set(re.findall(_NAME, company.lower()))
    if any(w in NO_NAME or w in _FIRM_WORDS or w in _NO_PERSON or w in firm or w in _STREETS or _NOUN_END.search(w) for w in ws):
        return 0.0
    if re.match(r"[\s,&+]*(?:\w+\s+)?(?:ag|sa|gmbh|sàrl|sarl|ltd|inc|kg|genossenschaft)\b", low[b : b + 24]) or text[a:b].isupper():
        return 0.0
    # Where all words around are capitalised, capitals tell nothing.
    around = re.findall(r"(?<![\w@.])[^\W\d_]", text[max(0, a - 60) : a] + " " + text[b : b + 60])
    if len(around) >= 4 and sum(x.islower() for x in around) < 0.2 * len(around):
        return 0.0
    w = asked
    if any(fold(x) in locals_ for x in ws if len(x) >= 4):
        w += 3
    k = bisect_right(contacts, (a, a))
    for s, e in contacts[max(0, k - 1) : k + 1]:
        between = text[b:s] if s >= b else text[e:a]
        if len(between) <= (45 if s >= b else 12) and not re.search(r"[.!?]\s+[^\W\d_]|\n\s*\n", between) and (s >= b or "\n" not in between):
            w += 1.5
            break
    w += 1.0 * any(x in _known() for x in ws)
    w += 0.5 * bool(re.match(r"\s*(?:$|[.,;:!?()\n–-]|[a-zß-öø-ÿ])", text[b : b + 3]))
    w += 0.5 * bool(re.search(r"[a-zß-öø-ÿ][\w'’]*[^\S\n]+$", text[max(0, a - 24) : a])) * (not asked)
    w -= 1.5 * any(x in small for x in ws)
    return w


@cache
def cues() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    words: dict[str, list[str]] = {}
    for kind, ws in (("hon", HONORIFICS), ("before", BEFORE), ("after", AFTER), ("ask", ASK), ("label", LABELS), ("de", STREETS_DE), ("rom", STREETS_ROMANCE), ("en", STREETS_EN), ("doc", DOCUMENTS), ("first", FIRST_NAMES), ("digit", _SPELLED), ("said", (" at ", " arobase ", " chiocciola ", " klammeraffe "))):
        for w in ws:
            words.setdefault(w, []).append(kind)
    for w, kinds in words.items():
        a.add_word(w, (len(w), w, tuple(kinds)))
    a.make_automaton()
    return a


def _named(text: str, start: int, end: int, address: bool) -> bool:
    """Whether the words of a span can be a person's name."""
    ws = re.findall(rf"{_NAME}|[^\W\d_]\.", text[start:end])
    low = [w.lower() for w in ws]
    return bool(ws) and not any(w in NO_NAME for w in low) and (address or len(ws) >= 2)




def checked(number: str) -> bool:
    """Whether the last digit of a social security number is its check digit (as
    in article numbers: weights of one and three, a sum divisible by ten)."""
    d = [int(x) for x in re.sub(r"\D", "", number)]
    return sum(x * (3 if i % 2 else 1) for i, x in enumerate(d)) % 10 == 0


def detect(plain: Plain, company: str = "") -> list[tuple[int, int, str]]:
    """Spans of personal information in a plain text: start, end, type."""
    text, low, n = plain.text, plain.low, len(plain.text)
    found: list[tuple[int, int, str]] = []
    at = low.find("@")
    while at >= 0:
        left, right = _LOCAL.search(text, max(0, at - 66), at), _DOMAIN.match(text, at + 1)
        if left and right and left.end() == at:
            found.append((left.start(), right.end(), "email"))
        at = low.find("@", at + 1)
    mails = list(found)
    inside = lambda a, b: any(s < b and a < e for s, e, _ in mails)
    numbers = [(m.start(), m.end()) for m in _AHV.finditer(text)] if "756" in text else []
    found += [(*m, "national_id") for m in numbers if checked(text[slice(*m)])]
    ids = [f for f in found if f[2] == "national_id"]
    for m in (x for run in _DIGITS.finditer(text) if sum(ch.isdigit() for ch in run.group()) >= 9 for x in _NUMBER.finditer(text, max(0, run.start() - 1), min(n, run.end() + 1))):
        digits = re.sub(r"\D", "", m.group())
        plus = "+" in m.group()
        ok = (plus or digits.startswith("00")) and 10 <= len(digits) - (0 if plus else 2) + 1 <= 15 or (digits.startswith("0") and not digits.startswith("00") and 9 <= len(digits) <= 11)
        if ok and not inside(m.start(), m.end()) and not any(s < m.end() and m.start() < e for s, e, _ in ids):
            begin = m.end() - len(m.group().lstrip())
            found.append((begin + (text[begin] == "(" and ")" not in m.group()), m.end(), "phone"))
    contacts = sorted((s, e) for s, e, t in found if t in ("email", "phone"))
    mail_words = {fold(w) for s, e, t in mails for w in re.split(r"[\W\d_]+", text[s:e].split("@")[0]) if len(w) >= 4}
    asked: list[tuple[int, float]] = []
    documents: list[int] = []
    titled: set[int] = set()
    for end, (length, word, kinds) in plain.hits:
        a, b = end + 1 - length, end + 1
        right = b >= n or not (low[b].isalnum() and low[b - 1].isalnum())
        if not right:
            continue
        left = a == 0 or not low[a - 1].isalnum()
        for kind in kinds:
            if kind == "de":
                k = a
                while k > 0 and (low[k - 1].isalpha() or low[k - 1] in "-."):
                    k -= 1
                if a - k >= 3 and (m := _AFTER_DE.match(text, b)) and low[k:b] not in NO_STREETS:
                    found.append((k, m.end(), "address"))
                elif a - k == 0 and word in ("strasse", "straße", "platz", "weg", "gasse", "quai") and (m := _AFTER_DE.match(text, b)) and text[a].isupper() and a > 1 and (p := re.search(r"([A-ZÄÖÜ][\w\-]+[ \-])$", text[max(0, a - 30) : a])):
                    found.append((a - len(p.group()), m.end(), "address"))
                continue
            if not left:
                continue
            if kind == "rom":
                if m := _AFTER_ROMANCE.match(text, b):
                    middle = m.group(1).lower().split()
                    if not _NO_STREET & set(middle) and not low[max(0, a - 3) : a].startswith("en") and "." not in m.group(1)[:-1]:
                        found.append((a, m.end(), "address"))
                elif (p := _BEFORE_ROMANCE.search(text, max(0, a - 9), a)) and (m := _NAME_ROMANCE.match(text, b)) and not _NO_STREET & set(m.group().lower().split()):
                    found.append((p.start(1), m.end(), "address"))
            elif kind == "en":
                if (p := _BEFORE_EN.search(text, max(0, a - 48), a)) and not any(w in NO_NAME or w in ("weeks", "years", "days", "people", "months", "hours", "percent", "clients", "employees") for w in p.group(2).lower().split()[:-1] + p.group(2).lower().split()[:1]):
                    found.append((p.start(1), b, "address"))
            elif kind in ("ask", "label"):
                asked.append((b, 3.0 if kind == "label" else 2.0))
            elif kind == "doc":
                documents.append(b)
            elif kind == "hon":
                if word == "m." and text[a] != "M":
                    continue
                if word in ("fr.", "m.", "ing.", "hr.", "ms", "mr") and not (b < n and text[b].isspace()):
                    continue
                if (m := _TITLED.match(text, b)) and "\n" not in text[b : m.start(1)]:
                    ws = m.group(1).split()
                    first = ws[-1] if len(ws) > 1 and len(ws[0]) == 2 and ws[0][1] == "." else ws[0]
                    if first.lower() not in NO_NAME and (first[0].isupper() or low[a:b] == text[a:b]):
                        stop = m.end() if len(ws) == 1 or (ws[-1].lower() not in NO_NAME and ws[-1][0].isupper() == first[0].isupper()) else m.start(1) + len(ws[0])
                        found.append((a, stop, "name"))
                        titled.add(a)
            elif kind == "before":
                if (m := _PERSON.match(text, b)) and "\n" not in text[b : m.start(1)]:
                    s, e = m.span(1)
                    while e > s and not _named(text, s, e, False):
                        cut = max(text.rfind(" ", s, e), text.rfind(",", s, e))
                        if cut <= s:
                            e = s
                            break
                        e = cut
                    words = text[s:e].replace(",", " ").split()
                    if len(words) == 3 and not (text[s].isupper() and words[-1][0].isupper()):
                        e = s + len(text[s:e].rsplit(None, 1)[0])
                    if e > s and _named(text, s, e, False):
                        found.append((s, e, "name"))
            elif kind == "after":
                if (m := _PERSON_END.search(text, max(0, a - 60), a)) and _named(text, m.start(1), m.end(1), False):
                    found.append((m.start(1), m.end(1), "name"))
            elif kind == "first":
                firm = company.lower()
                if not text[a].isupper() or _PROJECT.search(low, max(0, a - 14), a) or not (_SMALL_BEFORE.search(text, max(0, a - 20), a) or _SMALL_AFTER.match(text, b)):
                    continue
                for m in (re.compile(rf"\s+({_NAME})").match(text, b), re.compile(rf"({_NAME}),?\s+$").search(text, max(0, a - 30), a)):
                    if not m:
                        continue
                    other = m.group(1)
                    if len(other) < 3 or not other[0].isupper() or other.lower() in NO_NAME or other.lower() in _FIRM_WORDS or other.lower() in firm or text.isupper():
                        continue
                    tail = re.match(rf"[\s,]*({_NAME})?", text[max(b, m.end(1)) :])
                    if tail and tail.group(1) and tail.group(1).lower() in _FIRM_WORDS:
                        continue
                    if m.start() >= b or ("," in m.group() or other.isupper()):
                        found.append((min(a, m.start(1)), max(b, m.end(1)), "name"))
    tried = [(m.span(1), worth) for b, worth in asked if (m := _FULL_NAME.match(text, b))]
    for s, _ in contacts:
        tried += [(m.span(1), 0.0) for m in _FULL_NAMES.finditer(text, max(0, s - 70), s)]
    small = set(_SMALL.findall(text)) if tried else set()
    taken = sorted((x, y) for x, y, t in found if t == "name")
    for (a, b), worth in tried:
        k = bisect_right(taken, (b, -1))
        if not any(a < y for _, y in taken[max(0, k - 2) : k]) and name_weight(plain, a, b, worth, contacts, mail_words, small, company) >= NAME_WEIGHT:
            found.append((a, b, "name"))
    found += [(*m, "national_id") for m in numbers if not checked(text[slice(*m)]) and any(0 <= m[0] - d <= 40 for d in documents)]
    for m in _SERIAL.finditer(text) if documents else ():
        if any(0 <= m.start() - d <= 40 for d in documents) and not inside(*m.span()):
            found.append((m.start(), m.end(), "national_id"))
    return [(a, b, t) for a, b, t in found if t == "email" or not inside(a, b)]


def spans(source: str, company: str = "") -> list[tuple[int, int, str]]:
    """Non-overlapping spans of the source text, in order: start, end, type. Of
    overlapping ones the longer stays."""
    p = Plain(source)
    out: list[tuple[int, int, str]] = []
    for a, b, t in sorted(detect(p, company or ""), key=lambda f: (f[0] - f[1], f[0])):
        s, e = p.back(a, b)
        if all(e <= x or y <= s for x, y, _ in out):
            out.append((s, e, t))
    return sorted(out)


def masked(source: str, company: str = "") -> tuple[str, list[tuple[int, int, str]]]:
    found = spans(source, company)
    out, last = [], 0
    for a, b, t in found:
        out += [source[last:a], PLACEHOLDER[t]]
        last = b
    return "".join([*out, source[last:]]), found


def mask_ads(rows: DataFrame) -> DataFrame:
    """``rows`` has uid, content_clean and company_name: (uid, masked, types,
    starts, ends), one row per ad and different text, where the arrays hold what
    was found, in order, as offsets of the source. Null and blank texts give no
    row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [masked(t, c) for t, c in zip(b["content_clean"], b["company_name"], strict=True)]
            yield pd.DataFrame({"uid": b["uid"], "masked": [m for m, _ in got], "types": [[x[2] for x in s] for _, s in got], "starts": [[x[0] for x in s] for _, s in got], "ends": [[x[1] for x in s] for _, s in got]})

    return rows.filter(filled("content_clean")).select("uid", "content_clean", "company_name").mapInPandas(run, "uid string, masked string, types array<string>, starts array<int>, ends array<int>").distinct()


def found_types(rows: DataFrame) -> DataFrame:
    """(uid, pii_type): each type that occurs in an ad's content_clean. Only these
    short rows are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {(u, t) for u, text, c in zip(b["uid"], b["content_clean"], b["company_name"], strict=True) for _, _, t in spans(text, c)}
            yield pd.DataFrame(sorted(out), columns=["uid", "pii_type"])

    return rows.filter(filled("content_clean")).select("uid", "content_clean", "company_name").mapInPandas(run, "uid string, pii_type string").distinct()
