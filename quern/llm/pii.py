"""Personal information in free text, replaced by typed placeholders (problem 4).

Generators propose overlapping spans with high recall (addresses of mail, runs and spelled-out runs of
digits, codes, streets with numbers, runs of capitalized or known name words); boosted trees judge each
span by its own format and by the words around it; spans above the calibrated threshold of their type
are kept, the surest first, and replaced. Spans are found in the canonical form of a text and are
carried back to the text itself, which is left as it is everywhere else.

The trees are trained on invented sentences (pii_grammar.py); no sentence of the tables at hand is among them.
Name words are learned from all texts: words that often follow titles, greetings and introductions.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import codepoints as cp
from quern.llm.canonical import canonical_arrow, covered, origins
from quern.llm.pii_grammar import SPELLED, Grammar
from quern.llm.trees import Boosted, fit

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
#: Occurrences after an introduction that a name word needs, and their least share of its occurrences.
MIN_INTRODUCED, MIN_INTRODUCED_SHARE = 2, 0.08
#: Name words that are sent to every task, 8 bytes each; more are joined with the texts.
BROADCAST_WORDS = 4_000_000
#: Texts in the training grammar.
TRAINING = 9_000

_DIGITS = str.maketrans("۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789")
_OTHER_DIGIT = re.compile("[۰-۹٠-٩]")
_DIGIT = re.compile(r"\d")

# Titles, introductions that a name follows in any case of letters, and those that only say so before capitals.
TITLES = r"mr|mrs|ms|miss|dr|prof|herr|frau|m(?=\.)|mme|mlle|monsieur|madame|آقای|خانم|دکتر|مهندس"
INTRODUCED = (
    r"my (?:full |last |first )?name is|i am called|name:|signed|yours(?: truly| faithfully)?,|sincerely,|regards,|wishes,|ich heiße|mein (?:voller )?name ist|gruß,|grüße,|gezeichnet|"
    r"je m'appelle|mon nom(?: complet)? est|cordialement,|amicalement,|signé|bien à vous,|اسمم|اسم من|نام من|نامم|نام کامل من|ارادتمند،|با احترام،|با تشکر،"
)
MENTIONED = r"ask(?: for)?|dear|this is|i'm|i am|here is|hier spricht|ich bin|liebe[rs]?|ici|je suis|chère?|contact|met|saw|with|by|mit|avec|par|von"
# Words of street names, by their place beside the name.
STREETS_AFTER = r"street|road|lane|avenue|row|drive|close|court|square|terrace|crescent|grove|hill|way|park|gardens?|mews|boulevard|parkway|highway|walk|st|rd|ave|ln|blvd"
STREETS_BEFORE = r"rue|avenue|boulevard|impasse|place|allée|allee|chemin|quai|cours|passage|square|route|calle|via"
STREETS_WITHIN = r"stra(?:ß|ss)e|str\.?|weg|gasse|platz|allee|ufer|damm|ring|steig|chaussee|markt"
STREETS_PERSIAN = r"خیابان|بلوار|میدان|کوچه|بن‌بست|بزرگراه"
# Words of four languages that say what stands beside them, by what they speak of.
CUES = {
    "phone": r"\b(?:tel|tél|(?:tele)?phones?|mobile|cell|call(?:s|ed|ing)?|ring|dial|text|fax|whatsapp|landline|reach\w*|numbers?|ruf\w*|telefon\w*|handy\w*|mobil\w*|anruf\w*|nummer|festnetz|wähl\w*|erreich\w*|rückruf|téléphone|portable|numéro|r?appel\w*|joign\w*|compose\w*|fixe)\b|تلفن|موبایل|همراه|تماس|زنگ|شماره",
    "id": r"\b(?:passports?|identity|ids?|ssn|social|insurance|national|tax|licen[cs]e|\w*ausweis\w*|reisepass|steuer\w*|\w*versicherung\w*|führerschein|passeport|identit\w*|carte|sécu\w*|sociale|permis|fiscal|identifiant)\b|ملی|گذرنامه|شناسنامه|شناسایی|بیمه|پاسپورت",
    "service": r"\b(?:invoice|batch|serial|order|tracking|case|ticket|ref|reference|booking|files?|request|registration|claim|item|re|dossier|cas|objet|facture|lot|série|commande|suivi|réservation|demande|réf|inscription|rechnung|charge|seriennummer|bestell\w*|sendung\w*|aktenzeichen|vorgang|buchung|fall|akte|anmeldung|betreff)\b|فاکتور|سریال|سفارش|رهگیری|پرونده|تیکت|رزرو|درخواست|پیگیری|ثبت",
    "measure": r"\b(?:meter|gauge|counter|costs?|budget|population|balance|views|scores?|version|dated|years?|months?|dollars?|euros?|kwh|points?|people|hours?|minutes?|reads?|\w*zähler\w*|stand|gekostet|kostet|etat|einwohner|punkt\w*|monat|jahr|compteur|relevé|coût\w*|habitants|mois|personnes|daté|vues)\b|کنتور|هزینه|بودجه|جمعیت|نمره|نسخه|تاریخ|بازدید|تومان|ریال|ماه|سال|نفر|امتیاز|خرج|ساعت",
    "place": r"\b(?:live[sd]?|living|address|home|house|flat|moved?|deliver\w*|post|send|parcel|apartment|at|wohn\w*|anschrift|adresse|umgezogen|lieferung|\w*wohnung|gemeldet|paket|haus|habit\w*|déménag\w*|livr\w*|appartement|domicili\w*|colis|demeur\w*)\b|آدرس|نشانی|خانه|منزل|ساکن|سکونت|بسته|اسباب",
    "mail": r"\b(?:e-?mails?|mails?|inbox|contact|write|forward|kontakt|schreib\w*|courriel|écri\w*)\b|رایانامه|ایمیل|پیام|نامه|بنویس",
    "speech": r"\b(?:said|says|told|called|thinks?|asked|agreed|helps?|helped|wrote|speaking|sagte|meinte|rief|riet|hat|schrieb|dit|pense|m'a|répondu|m'aide|appelé)\b|گفت|هستم|کمک|زنگ|نوشت|صحبت",
    "relation": r"\b(?:brother|sister|mother|father|friend|neighbou?r|doctor|cousin|uncle|aunt|colleague|boss|manager|partner|husband|wife|met|saw|thanks|dear|visited|bruder|schwester|mutter|vater|freund(?:in)?|nachbar(?:in)?|arzt|chef|leiter|traf|mit|frère|sœur|mère|père|ami|voisine?|médecin|selon|avec|vu)\b|برادر|خواهر|مادر|پدر|دوست|همسایه|همکار",
    "product": r"\b(?:app|groups?|team|course|band|club|radio|film|program\w*|gruppe|kurs|verein|appli|groupe|cours|équipe|called)\b|برنامه|گروه|اپ|تیم",
    "town": r"\b(?:in|to|from|near|town|city|village|road|nach|aus|ort|stadt|à|ville|allés)\b|(?<![\w‌])(?:شهر|رفتیم|آمدیم)",
}
_CUES = [(k, re.compile(p)) for k, p in CUES.items()]
_NUMBER = r"\d{1,4}(?: ?[a-d])?\b"
_GENERATORS = (
    ("mail", re.compile(r"[\w.+-]+(?: ?(?:@|\(at\)|\[at\]) ?\w[\w-]*(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)\w[\w-]*)+| at \w[\w-]*(?: dot \w[\w-]*)+)")),
    ("digits", re.compile(r"(?<![\w@.+])(?:[a-z]{1,2} ?)?(?:\+|\()?\d[\da-z]*\)?(?:(?: ?[-–/] ?| ?\.(?=\d)| (?=[(\d]))\(?\d+\)?)*(?:[ -]?[a-z](?: ?\d{3})?)?(?![\w@])|(?<!\w)[a-z]{5}\d{6}[a-z]{2}\d[a-z]{2}(?!\w)")),
    ("spelled", re.compile(rf"(?<!\w)(?:(?:{SPELLED})[ -]+){{5,}}(?:{SPELLED})(?!\w)")),
    (
        "street",
        (
            re.compile(rf"(?:(?:flat|apt|unit) \d+\w?, )?\b{_NUMBER},? (?:[\w'’-]+ ){{1,3}}(?:{STREETS_AFTER})\b(?:\.?, [\w-]+(?: \w{{2,3}} ?\d\w\w)?(?:, [a-z]{{2}} \d{{5}})?)?"),
            re.compile(rf"(?:[\w'’-]+ ){{1,3}}(?:{STREETS_AFTER}) (?:no\.?|nr\.?|number)? ?{_NUMBER}"),
            re.compile(rf"\b(?:an? de[rm] |am |im )?[\w-]*(?: ?(?:{STREETS_WITHIN})) {_NUMBER}(?:(?:,| in) (?:\d{{5}} )?[\w-]+)?"),
            re.compile(rf"\b\d{{1,4}}(?: ?(?:bis|ter|[a-d]))*,? (?:{STREETS_BEFORE}) [\w'’ -]{{2,40}}(?:, \d{{5}} [\w-]+)?"),
            re.compile(rf"(?:{STREETS_PERSIAN}) (?:[^.؟!()]{{1,50}}?(?:پلاک|نبش(?: کوچه| خیابان)?|شماره|پ) ?|[^.؟!()\d]{{1,40}}?(?:کوچه) ?|[\w‌]+ (?:[\w‌]+ )?)\d{{1,4}}[a-d]?(?: واحد \d+)?"),
            # no word for a street: a number beside names, with a postal code or a town
            re.compile(rf"(?:[\w'’-]+ )?[\w'’-]+ {_NUMBER},? (?:in )?\d{{4,5}} [\w-]+"),
            re.compile(r"\b\d{1,4}[a-d]?,? [\w'’-]+(?: [\w'’-]+)?, [\w-]+(?:,? [a-z]{2} \d{5}| [a-z]{1,2}\d{1,2} ?\d[a-z]{2})"),
            re.compile(rf"\b(?:am|an der|im) [\w-]+ {_NUMBER}(?:(?:,| in) (?:\d{{5}} )?[\w-]+)?"),
        ),
    ),
)
#: Parts of a street match that may be the address by themselves.
_TOWN = re.compile(r"(?:,| in | à ) ?(?:\d{5} )?[\w-]+(?: [\w-]+)*$")
_STREET_WORD = re.compile(rf"\b(?:{STREETS_AFTER}|{STREETS_BEFORE})\b|(?:{STREETS_WITHIN})\b|{STREETS_PERSIAN}")
_POSTAL = re.compile(r"\b\d{5}\b|\b[a-z]{1,2}\d{1,2} ?\d[a-z]{2}\b")
_SMALL_WORDS = frozenset("a an the in of on to at for and while is was has had that about im der die das den und zu um ist hat au un une en et sur dans est a qui i my we it است و را که از به در با هم بود هستم هست گفت".split())
_PARTICLES = frozenset("de da del di du la le van von der den al el ibn".split())
_GROUP = re.compile(r"[a-z]*\d[\da-z]*")
#: Judged windows kept per task; many texts share a frame.
_MEMORY = 100_000

_LETTER = r"[^\W\d_]"
_TOKEN = re.compile(rf"{_LETTER}(?:{_LETTER}|[\u0300-\u036f\u064b-\u0652\u0670\u200c])*")
_TITLE = re.compile(rf"(?:{TITLES})$")
_INTRO_END = re.compile(rf"(?<!\w)(?:{INTRODUCED}|{MENTIONED}) $")
_SURE_END = re.compile(rf"(?<!\w)(?:{INTRODUCED}) $")
_INTRO = re.compile(rf"(?<!\w)(?:{INTRODUCED}) (?={_LETTER})")
_START = re.compile(r"(?:^|[.!?؟:;؛\n(\"“«])\s*$")


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: int


# --- known name words ----------------------------------------------------------------------------


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case form of each code point, and whether it belongs to a word."""
    size = sys.maxunicode + 1
    low, inside = np.arange(size, dtype=np.uint32), np.zeros(size, bool)
    for c in range(0x20000):
        ch = chr(c)
        if ch.isalpha():
            inside[c] = True
            form = ch.lower()
            low[c] = ord(form) if len(form) == 1 else c
    for a, b in ((0x300, 0x370), (0x64B, 0x653), (0x670, 0x671), (0x200C, 0x200D)):
        inside[a:b] = True
    return low, inside


def word_hashes(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash (of the lower-case letters) of every word in rows of code points."""
    low, inside = _letters()
    word = np.r_[False, inside[points], False]
    edge = np.zeros(len(points) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | edge))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | edge))
    return starts, ends, cp.span_hashes(low[points], starts, ends)


class Words:
    """A set of name words, kept as sorted 64-bit hashes."""

    def __init__(self, words: Iterable[str] | np.ndarray = ()) -> None:
        if not isinstance(words, np.ndarray):
            _, _, words = word_hashes(*cp.decode(pa.array([*words], pa.string())))
        self.hashes = np.unique(words.astype(np.uint64))

    def __len__(self) -> int:
        return len(self.hashes)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        at = np.searchsorted(self.hashes, hashes).clip(max=len(self.hashes) - 1)
        return self.hashes[at] == hashes

    def of(self, text: str) -> set[int]:
        """Where known words start in a text."""
        starts, _, h = word_hashes(*cp.decode(pa.array([text], pa.string())))
        return set(starts[self.has(h)].tolist())


# --- candidates ----------------------------------------------------------------------------------


def _split(m: re.Match) -> Iterator[tuple[int, int]]:
    """The whole run of digits, and its parts where two numbers or a word and a number may stand side by side."""
    text, a = m.group(), m.start()
    yield a, m.end()
    cuts = [i for i, ch in enumerate(text) if ch == " " and i + 1 < len(text)]
    for i in cuts:
        left, right = (sum(map(str.isdigit, x)) for x in (text[:i], text[i:]))
        if left == 0 or left >= 7 and (right >= 7 or text[i + 1] in "(+"):
            yield (a + i + 1, m.end()) if left == 0 else (a, a + i)
        if left >= 7 and right >= 7:
            yield a + i + 1, m.end()
        if right == 0:
            yield a, a + i


def _names(text: str, low: str, known: set[int]) -> Iterator[tuple[int, int]]:
    """Runs of capitalized and known words, words after titles and introductions."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    shouted = sum(map(str.isupper, text)) > 0.6 * max(1, sum(map(str.isalpha, text)))
    named, titled, joined = [], [], []
    for k, (a, b) in enumerate(tokens):
        initial = b - a == 1 and text[a].isupper() and text[b : b + 1] == "."
        named.append(a in known or initial or not shouted and text[a].isupper() and b - a > 1)
        titled.append(bool(_TITLE.match(low[a:b] + ("." if text[b : b + 1] == "." else "")) or _TITLE.match(low[a:b])))
        gap = text[b : tokens[k + 1][0]] if k + 1 < len(tokens) else "|"
        joined.append(gap in (" ", "-", "'", "’") or gap in (". ", ".") and (initial or titled[k]))
    n = len(tokens)
    k = 0
    while k < n:
        if not named[k] and not titled[k]:
            k += 1
            continue
        end = k + 1
        while end < n and joined[end - 1] and (named[end] or low[tokens[end][0] : tokens[end][1]] in _PARTICLES and end + 1 < n and joined[end] and named[end + 1]):
            end += 1
        first = k
        if titled[k]:
            # a title makes the next one or two words a name, whatever they are
            for more in (1, 2):
                if k + more < n and all(joined[k : k + more]) and end < k + 1 + more:
                    yield tokens[k][0], tokens[k + more][1]
        has_known = any(tokens[i][0] in known for i in range(first, end))
        if end - first >= 2 or has_known:
            yield tokens[first][0], tokens[end - 1][1]
        if end - first >= 3 or titled[first] and end - first == 2:
            if end - first >= 3 or has_known:
                yield tokens[first + 1][0], tokens[end - 1][1]
            if tokens[end - 2][1] - tokens[end - 2][0] > 1:
                yield tokens[first][0], tokens[end - 2][1]
        i = first
        while has_known and i < end:
            j = i
            while j < end and tokens[j][0] in known:
                j += 1
            if j > i and (i, j) != (first, end):
                yield tokens[i][0], tokens[j - 1][1]
                if i > first and (titled[i - 1] or tokens[i - 1][1] - tokens[i - 1][0] == 1):
                    yield tokens[i - 1][0], tokens[j - 1][1]
            i = max(j, i + 1)
        k = end
    place = {a: k for k, (a, _) in enumerate(tokens)}
    for m in _INTRO.finditer(low):
        k = place.get(m.end())
        if k is not None:
            for more in range(3):
                if k + more < n and all(joined[k : k + more]):
                    yield tokens[k][0], tokens[k + more][1]


def propose(low: str, text: str, known: set[int], wanted: Sequence[bool] = (True,) * 5) -> list[Span]:
    """Overlapping candidate spans of a canonical text (``low``: folded), by the wanted generators."""
    found = set()
    for kind, (name, pattern) in enumerate(_GENERATORS[:3]):
        for m in pattern.finditer(low) if wanted[kind] else ():
            if name == "digits":
                found |= {(a, b, kind) for a, b in _split(m) if sum(map(str.isdigit, low[a:b])) >= (5 if b - a < 8 else 4)}
            else:
                found.add((*m.span(), kind))
    for pattern in _GENERATORS[3][1] if wanted[3] else ():
        for m in pattern.finditer(low):
            a, b = m.span()
            own = m.group()
            town = _TOWN.search(own)
            capitals = any(map(str.isupper, text[a:b]))
            if town and town.start() > 3:
                found.add((a, a + town.start(), 3))
            # a town has a capital where the street has one
            if not town or not capitals or any(x[:1].isupper() for x in re.findall(r"[^\W\d_]+", text[a + town.start() : b])):
                found.add((a, b, 3))
                cuts = [i for i, ch in enumerate(own) if ch == " "]
                # words that lead up to the street, or follow it, are no part of it
                found |= {(a + i + 1, b, 3) for i in cuts[:2] if not own[:1].isdigit()}
                if own[:1].isdigit():
                    found |= {(a, a + i, 3) for i in cuts[2:6]}
    if wanted[4]:
        found |= {(a, b, 4) for a, b in _names(text, low, known)}
    return sorted({Span(*_trimmed(low, a, b), kind) for a, b, kind in found}, key=lambda s: (s.start, s.end, s.kind))


def _trimmed(low: str, a: int, b: int) -> tuple[int, int]:
    """Without blanks, closing marks and brackets that do not belong to the piece."""
    if low[a : a + 1] == "(" and low[b - 1 : b] == ")" and low.count("(", a, b) == 1:
        a, b = a + 1, b - 1
    while b > a and (low[b - 1] in " ,.-–/،" or low[b - 1] == ")" and "(" not in low[a:b]):
        b -= 1
    while a < b and (low[a] in " ,.-–/" or low[a] == "(" and ")" not in low[a:b]):
        a += 1
    return a, b


def context(low: str, span: Span) -> tuple[int, int]:
    """Where the words around a span begin and end that may speak of it: those of a neighbouring sentence do not."""
    first = max(0, span.start - 28)
    for m in _END.finditer(low, first, span.start):
        first = m.end()
    if span.kind in (1, 2) and _NUMBER_NEXT.search(low, span.end, span.end + 30):
        return first, span.end  # what is said there is said of the next number
    m = _STOP.search(low, span.end, span.end + 18)
    return first, m.start() if m else min(len(low), span.end + 18)


def features(low: str, original: str, span: Span, known: set[int], around: tuple[int, int], lowered: bool) -> list[int]:
    """Format of the span and cues around it (see context()), as small integers; ``lowered``: in lower case among capitals."""
    own = low[span.start : span.end]
    shown = original[span.start : span.end]
    near = before = low[around[0] : span.start]
    after = low[span.end : around[1]]
    at_start = bool(_START.search(near))
    before, after = re.split(r"\d{4,}", before)[-1], re.split(r"\d{4,}", after)[0]
    groups = _GROUP.findall(own) if span.kind == 1 else []
    digits = sum(map(str.isdigit, own))
    letters = sum(ch.isalpha() for ch in own)
    first = re.sub(r"\D", "", own)[:2]
    tokens = _TOKEN.findall(own)
    street = _STREET_WORD.search(own) if span.kind == 3 else None
    f = [
        span.kind,
        len(own),
        digits,
        letters,
        own.startswith(("+", "00")),
        int(first[:1] or 0) + 1,
        int(first[1:2] or 0) + 1,
        "(" in own,
        own.count("-"),
        own.count("."),
        own.count("/"),
        own.count(" "),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        len(groups[0]) if groups else 0,
        len(groups[-1]) if groups else 0,
        len(re.match(r"[a-z]*", groups[0]).group()) if groups else 0,
        sum(any(map(str.isalpha, g)) for g in groups),
        "#" in near[-2:] + after[:1],
        own.endswith("000") and " " in own,
        len(tokens),
        sum(span.start + m.start() in known for m in _TOKEN.finditer(own)) if span.kind == 4 else 0,
        sum(m.group()[:1].isupper() for m in _TOKEN.finditer(shown)),
        sum(t in _SMALL_WORDS for t in tokens),
        bool(tokens) and bool(_TITLE.match(tokens[0] + ".") or _TITLE.match(tokens[0])),
        bool(re.search(r"(?:^|[ .])[^\W\d_]\.", own)) if span.kind == 4 else 0,
        2 * ("@" in own) + any(x in own for x in ("(at)", "[at]", " at ")),
        0 if not street else 1 + (street.start() > 0) + 2 * (street.end() == len(own)),
        bool(_POSTAL.search(own)) if span.kind == 3 else 0,
        (own[:1].isdigit() + 2 * own[-1:].isdigit()) if span.kind == 3 else 0,
        at_start,
        any(map(str.isupper, shown)) and not any(map(str.islower, shown)),
        (1 + bool(_SURE_END.search(near))) if _INTRO_END.search(near) else 0,
        1 if not after.strip() else 2 if after[:1] in ",،" else 0,
        1 if not near.strip() else 2 if near.rstrip()[-1:] in ":" else 3 if near.rstrip()[-1:] in ",،" else 0,
        any("؀" <= ch < "܀" for ch in own),
        shown[:1].isupper() + 2 * bool(tokens and shown[own.rfind(tokens[-1]) :][:1].isupper()),
        lowered,
        any(map(str.isdigit, near[-2:])) + 2 * any(map(str.isdigit, after[:2])),
        _beside(low, original, span.end, around[1], 1),
        _beside(low, original, around[0], span.start, -1),
    ]
    f += [bool(p.search(before)) + 2 * bool(p.search(after)) for _, p in _CUES]
    return [min(63, int(x)) for x in f]


#: Ends of sentences and brackets, but for the dots of usual abbreviations.
_END = re.compile(r"(?<!\btel)(?<!\btél)(?<!\bno)(?<!\bnr)(?<!\bref)(?<!\bréf)(?<!\bst)(?<!\bdr)[.!?؟;؛] |\) |\n")
_STOP = re.compile(r"[.!?؟;؛)](?: |$)|\n| \(")
_NUMBER_NEXT = re.compile(r"\d{3}")
_NEXT = re.compile(rf"[ '’-]({_LETTER}+)")
_BEFORE = re.compile(rf"({_LETTER}+)\.?[ '’-]$")


def _lowered(text: str, low: str, span: Span, uppers: int) -> bool:
    own = text[span.start : span.end]
    return uppers > 0 and not any(map(str.isupper, own))


def _beside(low: str, original: str, start: int, end: int, step: int) -> int:
    """What the next word between two places is: none (0), a small word (1), in lower case (2), capitalized (3)."""
    m = _NEXT.match(low, start, end) if step > 0 else _BEFORE.search(low, start, end)
    if not m:
        return 0
    return 1 if m.group(1) in _SMALL_WORDS else 3 if original[m.start(1)].isupper() else 2


def folded(text: str) -> str:
    """Lower case with ASCII digits, position by position."""
    low = text.lower()
    low = low if len(low) == len(text) else "".join(ch.lower() if len(ch.lower()) == 1 else ch for ch in text)
    return low.translate(_DIGITS) if _OTHER_DIGIT.search(low) else low


# --- training ------------------------------------------------------------------------------------


def labelled(grammar: Grammar, texts: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts of a few sentences each, with their marked spans."""
    made = []
    for _ in range(texts):
        text, spans = "", []
        for _ in range(grammar.r.randint(1, 3)):
            sentence, a, b, kind = grammar.sentence()
            if kind:
                spans.append((len(text) + a, len(text) + b, kind))
            text += sentence + " "
        made.append((text, spans))
    return made


@functools.cache
def train(seed: int = 7, texts: int = TRAINING) -> dict[str, Boosted]:
    """One model per type, from the grammar; thresholds are calibrated on a held-out part of it."""
    grammar = Grammar(seed)
    made = labelled(grammar, texts)
    words = Words(grammar.words)
    x, y, part = [], [], []
    for text, spans in made:
        low, known, uppers = folded(text), words.of(text), sum(map(str.isupper, text))
        for s in propose(low, text, known):
            label, overlaps, inside = "", False, False
            for a, b, kind in spans:
                if s.start < b and a < s.end:
                    overlaps, inside = True, inside or s.kind == 4 and kind != "NAME"
                over = min(b, s.end) - max(a, s.start)
                if over >= 0.9 * (s.end - s.start) and over >= 0.9 * (b - a):
                    label = kind
            if inside:
                continue  # words of a street or an address of mail look like names and are covered by it
            x.append(features(low, text, s, known, context(low, s), _lowered(text, low, s, uppers)))
            y.append(label)
            part.append(overlaps and not label)
    rows, labels, doubtful = np.array(x), np.array(y), np.array(part)
    # a span that is only off by a word finds the piece all the same, so it does not count against a threshold
    return {kind: fit(rows, labels == kind, doubtful) for kind in TYPES}


# --- name words ----------------------------------------------------------------------------------

_SHOWN = re.compile(rf"(?<!\w)(?P<sure>(?:{TITLES})\.?|{INTRODUCED}|(?:{MENTIONED})) (?={_LETTER})", re.I)
_IS_TITLE = re.compile(rf"(?:{TITLES})\.?", re.I)
_IS_INTRO = re.compile(rf"(?:{INTRODUCED})", re.I)
#: A text without any of these words introduces nobody.
_MAY_SHOW = "(?i:" + "|".join(x.replace(r"m(?=\.)", r"m\.") for x in (TITLES, INTRODUCED)) + rf")|(?:^|\P{{L}})(?i:{MENTIONED}) \p{{Lu}}"
#: Distinct words counted in a task before they are handed on.
_COUNTED = 2_000_000


def _introduced(text: str) -> Iterator[str]:
    """Words in a place where a name stands: one after a title, up to two after an introduction."""
    for m in _SHOWN.finditer(text):
        said = m.group("sure")
        title, sure = _IS_TITLE.fullmatch(said), _IS_INTRO.fullmatch(said)
        at, first = m.end(), None
        for _ in range(1 if title else 2):
            t = _TOKEN.match(text, at)
            if not t or _IS_TITLE.fullmatch(t.group()):
                break
            word = t.group()
            cased = word.lower() != word.upper()
            # without capitals a mention says nothing, and a word in lower case after one in capitals is no part of the name
            if cased and word.islower() and (not sure or first is not None and not first.islower()) and not title:
                break
            first = first or word
            if len(word) >= 3:
                yield word
            at = t.end() + 1
            if text[t.end() : at] not in (" ", "-"):
                break


def _count_names(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return words, *(np.bincount(place, np.concatenate([p[i] for p in parts]), len(words)).astype(np.int64) for i in (1, 2))

    def counted() -> pa.RecordBatch:
        words, shown, seen = summed()
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(shown), pa.array(seen)], ["word", "shown", "seen"])

    held = 0
    for batch in batches:
        for block in cp.blocks(canonical_arrow(batch.column(0))):
            points, offsets = cp.decode(block)
            starts, ends, h = word_hashes(points, offsets)
            words, n = np.unique(h[ends - starts >= 3], return_counts=True)
            parts.append((words, np.zeros(len(words), np.int64), n))
            may_show = pc.match_substring_regex(block, _MAY_SHOW)
            found = [w for text in block.filter(may_show).to_pylist() for w in _introduced(text)]
            if found:
                # each is one word, so it has one hash
                _, _, h = word_hashes(*cp.decode(pa.array(found, pa.string())))
                words, n = np.unique(h, return_counts=True)
                parts.append((words, n, np.zeros(len(words), np.int64)))
            held += len(words)
            if len(parts) > 64:
                parts = [summed()]
                held = len(parts[0][0])
            if held > _COUNTED:
                yield counted()
                parts, held = [], 0
    if parts:
        yield counted()


def name_words(texts: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """``word``: hashes of words that often follow a title or an introduction, counted over all texts."""
    union = None
    for df, column in texts:
        part = df.select(F.col(column).alias("text")).where("text IS NOT NULL AND text != ''")
        union = part if union is None else union.unionByName(part)
    counted = union.mapInArrow(_count_names, "word long, shown long, seen long").groupBy("word").agg(F.sum("shown").alias("shown"), F.sum("seen").alias("seen"))
    return counted.where((F.col("shown") >= MIN_INTRODUCED) & (F.col("shown") >= F.col("seen") * MIN_INTRODUCED_SHARE)).select("word")


# --- applying ------------------------------------------------------------------------------------


class Redactor:
    """Trained models and learned name words.

    ``words`` is a set that every task has, or a frame of hashes that is joined with the texts.
    """

    def __init__(self, models: dict[str, Boosted], words: Words | DataFrame) -> None:
        self.models = models
        self.words = words
        plain = TITLES.replace(r"m(?=\.)", "m")
        n, w = "[0-9۰-۹٠-٩]", r"[\p{L}\p{N}'’-]+"
        #: What a text must contain for each generator to be run on it; names are also looked for where a known word stands.
        self.hints = (
            r"(?i)@|[\(\[]at[\)\]]| at .* dot ",
            r"(?:[0-9۰-۹٠-٩][^\p{L}]{0,3}){4}[0-9۰-۹٠-٩]|(?i:[A-Z][0-9]{2}|[A-Z][0-9][A-Z])",
            rf"(?i)(?:(?:{SPELLED})[ -]+){{5}}",
            rf"(?i){n}[a-d]?,? (?:{w} ){{1,3}}(?:{STREETS_AFTER})(?:\P{{L}}|$)|\P{{L}}(?:{STREETS_AFTER}) (?:no\.?|nr\.?|number)? ?{n}|(?:{STREETS_WITHIN}) {n}|{n}(?: ?(?:bis|ter|[a-d]))*,? (?:{STREETS_BEFORE}) \p{{L}}|(?:{STREETS_PERSIAN}) [^.؟!()]{{1,70}}{n}"
            rf"|{n}[a-d]?,? (?:in )?{n}{{4,5}} \p{{L}}|{n}[a-d]?,? {w}(?: {w})?, {w}(?:,? [a-z]{{2}} {n}{{5}}| [a-z]{{1,2}}{n})|(?:^|\P{{L}})(?:am|an der|im) {w} {n}",
            rf"(?i:(?:^|[^\p{{L}}])(?:(?:{plain})\.?|{INTRODUCED}) \p{{L}})|\p{{Lu}}[\p{{L}}'’-]*\.? (?:\p{{L}}{{1,3}}\.? )?\p{{Lu}}",
        )
        self.memory: dict[tuple, int] = {}
        self.judged: list[tuple[float, int]] = []

    def __getstate__(self) -> dict:
        return {"models": self.models, "words": self.words if isinstance(self.words, Words) else None}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _known(self, texts: pa.Array, own: pa.Array | None) -> dict[int, set[int]]:
        """For each row the places of its known words; ``own`` lists each row's known words where they were joined."""
        out: dict[int, set[int]] = {}
        done = 0
        given = own.to_pylist() if own is not None else None
        for block in cp.blocks(texts):
            points, offsets = cp.decode(block)
            starts, _, h = word_hashes(points, offsets)
            if given is None:
                at = np.flatnonzero(self.words.has(h))
            else:
                row = np.searchsorted(offsets, starts, "right") - 1
                hit = [k for k, (r, x) in enumerate(zip(row.tolist(), h.view(np.int64).tolist(), strict=True)) if x in (given[done + r] or ())]
                at = np.array(hit, np.int64)
            row = np.searchsorted(offsets, starts[at], "right") - 1
            for r, a in zip(row.tolist(), (starts[at] - offsets[row]).tolist(), strict=True):
                out.setdefault(done + r, set()).add(a)
            done += len(block)
        return out

    def spans(self, texts: pa.Array, own: pa.Array | None = None) -> list[list[tuple[int, int, str]]]:
        """For each canonical text its accepted spans in order."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(texts))]
        filled = texts.fill_null("")
        hints = np.array([pc.match_substring_regex(filled, h).to_numpy(zero_copy_only=False) for h in self.hints])
        known_at = self._known(filled, own)
        hints[4, list(known_at)] = True
        at = np.flatnonzero(hints.any(0))
        if len(self.memory) > _MEMORY:
            self.memory, self.judged = {}, []
        rows: list[int] = []
        found: list[Span] = []
        which: list[int] = []
        fresh: list[list[int]] = []
        before = len(self.judged)
        for i, wanted, text in zip(at.tolist(), hints[:, at].T.tolist(), filled.take(pa.array(at)).to_pylist(), strict=True):
            low, known, uppers = folded(text), known_at.get(i, frozenset()), sum(map(str.isupper, text))
            for s in propose(low, text, known, wanted):
                # everything that features() looks at
                around, lowered = context(low, s), _lowered(text, low, s, uppers)
                window = text[around[0] : s.start], text[s.start : s.end], text[s.end : around[1]]
                of_name = tuple(a - s.start for a in sorted(known) if s.start <= a < s.end) if s.kind == 4 else ()
                key = (s.kind, lowered, window if s.kind == 4 else _DIGIT.sub("9", "\0".join(window)), of_name, re.sub(r"\D", "", low[s.start : s.end])[:2], low[s.end - 3 : s.end] == "000")
                k = self.memory.get(key)
                if k is None:
                    k = self.memory[key] = before + len(fresh)
                    fresh.append(features(low, text, s, known, around, lowered))
                rows.append(i)
                found.append(s)
                which.append(k)
        if fresh:
            matrix = np.array(fresh)
            margin = np.array([(m := self.models[t]).probability(matrix) - m.cut for t in TYPES])
            best = margin.argmax(0)
            self.judged += zip(margin.max(0).tolist(), best.tolist(), strict=True)
        good = [k for k in range(len(rows)) if self.judged[which[k]][0] > 0]
        good.sort(key=lambda k: (-self.judged[which[k]][0], found[k].start - found[k].end))
        for k in good:
            s, taken = found[k], out[rows[k]]
            if all(s.end <= a or s.start >= b for a, b, _ in taken):
                taken.append((s.start, s.end, TYPES[self.judged[which[k]][1]]))
        return [sorted(spans) for spans in out]


def redacted(text: str, spans: Iterable[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by its type in brackets."""
    out, last = [], 0
    for a, b, kind in spans:
        out += [text[last:a], f"[{kind}]"]
        last = b
    return "".join([*out, text[last:]])


def carried_back(text: str, plain: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the canonical form ``plain`` as spans of ``text``."""
    if text == plain or not spans:
        return spans
    origin = origins(text)
    return [(int(origin[a]), covered(text, int(origin[b - 1]) + 1), kind) for a, b, kind in spans]


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("types", T.ArrayType(T.StringType()))])


def _redacted(texts: pa.Array, own: pa.Array | None, redactor: Redactor) -> pa.Array:
    # texts delivered many times are judged once
    coded = texts.dictionary_encode("encode") if own is None else None
    if coded is not None and len(coded.dictionary) < len(texts):
        return _redacted(coded.dictionary, None, redactor).take(coded.indices)
    plain = canonical_arrow(texts)
    spans = redactor.spans(plain, own)
    at = [i for i, s in enumerate(spans) if s]
    done = texts
    if at:
        rows = pa.array(at)
        both = zip(texts.take(rows).to_pylist(), plain.take(rows).to_pylist(), at, strict=True)
        mask = np.zeros(len(texts), bool)
        mask[at] = True
        done = pc.replace_with_mask(texts, pa.array(mask), pa.array([redacted(t, carried_back(t, p, spans[i])) for t, p, i in both], texts.type))
    kinds = pa.array([sorted({k for _, _, k in s}) for s in spans], pa.list_(pa.string()))
    return pa.StructArray.from_arrays([done.cast(pa.string()), kinds], ["text", "types"])


def redact(text: Column, redactor: Redactor, known: Column | None = None) -> Column:
    """``text`` with placeholders, otherwise as it is, and ``types``, the distinct types found; null for null.

    ``known`` lists the hashes of each row's known words where the redactor does not hold them itself.
    """
    if known is not None:

        @F.arrow_udf(_RESULT)
        def run_joined(texts: pa.Array, own: pa.Array) -> pa.Array:
            return _redacted(texts, own, redactor)

        return run_joined(text, known)

    @F.arrow_udf(_RESULT)
    def run(texts: pa.Array) -> pa.Array:
        return _redacted(texts, None, redactor)

    return run(text)


def build(texts: Sequence[tuple[DataFrame, str]], broadcast_words: int = BROADCAST_WORDS) -> Redactor:
    """The redactor of a corpus. Up to ``broadcast_words`` name words are held by every task, more stay a frame."""
    words = name_words(texts)
    first = words.limit(broadcast_words + 1).toPandas()["word"].to_numpy(np.int64)
    return Redactor(train(), Words(first.view(np.uint64)) if len(first) <= broadcast_words else words)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _hashes_of(texts: pa.Array) -> pa.Array:
    rows: list[np.ndarray] = []
    for block in cp.blocks(canonical_arrow(texts)):
        points, offsets = cp.decode(block)
        starts, _, h = word_hashes(points, offsets)
        cut = np.searchsorted(starts, offsets)
        rows += [np.unique(h[a:b].view(np.int64)) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    return pa.array(rows, pa.list_(pa.int64()))


def judged(rows: DataFrame, key: str, text: str, redactor: Redactor) -> DataFrame:
    """``key, raw, r`` for every row, repeats included."""
    shown = rows.select(F.col(key).alias("key"), F.col(text).alias("raw"))
    if isinstance(redactor.words, Words):
        return shown.withColumn("r", redact(F.col("raw"), redactor))
    # the words of each distinct text meet the known words; texts find theirs by digest
    shown = shown.withColumn("digest", F.md5("raw"))
    words = shown.where("raw IS NOT NULL").select("digest", F.explode(_hashes_of("raw")).alias("word")).distinct()
    own = words.join(redactor.words, "word", "left_semi").groupBy("digest").agg(F.collect_set("word").alias("known"))
    return shown.join(own, "digest", "left").withColumn("r", redact(F.col("raw"), redactor, F.col("known"))).drop("digest", "known")


def records(rows: DataFrame, key: str, text: str, redactor: Redactor) -> DataFrame:
    """``key, text, types`` of every distinct row: whole texts with placeholders, untouched outside of them.

    Null texts stay null with no types; empty texts stay empty; rows repeated alike give one row.
    """
    shown = judged(rows, key, text, redactor)
    # repeats are found by key and digest, so that texts are not shuffled as keys
    once = shown.groupBy("key", F.md5("raw").alias("digest")).agg(F.first("r").alias("r"))
    return once.select("key", "r.text", "r.types")


def found(rows: DataFrame, key: str, text: str, redactor: Redactor) -> DataFrame:
    """``key, pii_type``: the types found in each record; repeated records count once."""
    shown = rows.where(F.col(text).isNotNull() & (F.col(text) != ""))
    return judged(shown, key, text, redactor).select("key", F.explode("r.types").alias("pii_type")).distinct()
