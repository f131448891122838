"""Text decoded with a wrong character set: find it and undo it (problem 8).

Learning: sentences are joined with near-twins on their text stripped of non-ASCII characters.
Where two twins differ, the runs between the same ASCII characters are aligned character by
character: what stands for what becomes the learned mapping. Where one wrong conversion (written as
one charset, read as another) explains aligned characters, it extends the mapping to characters
that no twins showed; aligned characters that no known charset explains are a mapping of their own.

Applying: the learned mappings are then run over every text, each up to three times (text can be
damaged twice). What remains with replacement characters or question marks in place of letters has
lost its bytes; such sentences are restored from a clean twin where one exists.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import codepoints as cp

#: Charsets that a text may have been written or read in by mistake; where several explain the same, the first is taken.
CHARSETS = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1256", "cp1257", "cp437", "cp850", "mac_roman", "koi8-r", "iso8859-6")
#: Aligned characters that a conversion must explain before it is applied, and how many of them must differ.
MIN_EXPLAINED, MIN_DISTINCT = 6, 2
#: Occurrences that an aligned character needs where no charset explains it.
MIN_ALIGNED = 3
PASSES = 3
ALIGNED = "aligned"

_RUN = re.compile(r"[^\x00-\x7f]+")
_LOST = "�"
#: Two words or more of nothing but question marks; one such word is a writer's own.
LOST_WORDS = r"(?:^|[\s«(\"-])\?+[.,:;»)\"!]*[ ]+[«(\"]?\?+(?:[\s.,:;»)\"!]|$)"


@functools.cache
def reading(charset: str) -> tuple[str, ...]:
    """The character of each byte; bytes without one become the control character of that number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(charset))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@functools.cache
def writing(charset: str) -> dict[str, int]:
    """The byte of each character."""
    return {ch: b for b, ch in reversed(list(enumerate(reading(charset))))}


def spoil(text: str, written: str, read: str) -> list[str] | None:
    """For each character what it becomes when written as one charset and read as another."""
    table = reading(read)
    if written == "utf-8":
        return ["".join(table[b] for b in ch.encode("utf-8", "surrogatepass")) for ch in text]
    codes = writing(written)
    return [table[codes[ch]] if ch in codes else "" for ch in text]


def _plausible(ch: str) -> bool:
    """Latin and Arabic letters, digits and the punctuation that goes with them."""
    c = ord(ch)
    if c < 0x80 or c in (0x200C, 0x200D):
        return True
    kind = unicodedata.category(ch)
    if c < 0x180:
        return kind[0] == "L" or ch in " «»°½¼¾§·²³±µ€£¥¢–ªº©®­"
    if 0x600 <= c < 0x700:
        return 0x621 <= c <= 0x652 or kind == "Nd" or ch in "،؛؟٪٫٬ٰٔپچژکگھۀی"
    return 0x2010 <= c < 0x2040 or c in (0x20AC, 0x2116, 0x2122, 0x2212, 0x2022)


def align(garbled: str, clean: str) -> list[tuple[str, str]]:
    """What stands for each character of the runs that differ, without any charset: ``piece, character``.

    A run of one character is its whole counterpart; in longer runs all characters have pieces of one
    length. Runs that cannot be cut so tell nothing. Only a side with characters out of
    place can be damaged.
    """
    a, b = _RUN.findall(garbled), _RUN.findall(clean)
    runs = [(x, y) for x, y in zip(a, b, strict=False) if x != y] if len(a) == len(b) else []
    if all(_plausible(ch) for x, _ in runs for ch in x):
        return []
    pairs = []
    for x, y in runs:
        each, rest = divmod(len(x), len(y))
        if not rest:
            pairs += [(x[each * i : each * (i + 1)], ch) for i, ch in enumerate(y)]
    return [(g, c) for g, c in pairs if _plausible(c)]


def explain(garbled: str, clean: str) -> Iterator[tuple[str, str, list[tuple[str, str, bool]]]]:
    """Conversions that turn ``clean`` into ``garbled``, with the aligned characters of the runs that differ.

    The third entry of a pair tells whether the conversion itself explains it.
    """
    a, b = _RUN.findall(garbled), _RUN.findall(clean)
    if len(a) != len(b):
        return
    runs = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if not runs:
        return
    same_length = all(len(x) == len(y) for x, y in runs)
    in_bytes = all(len(x) == len(y.encode()) for x, y in runs)
    for read in CHARSETS:
        if in_bytes:
            pairs = [p for x, y in runs for p in zip(spoil(y, "utf-8", read), y, strict=True)]
            if "".join(p[0] for p in pairs) == "".join(x for x, _ in runs):
                yield "utf-8", read, [(g, c, True) for g, c in pairs]
        # letters swapped for letters do not tell which side is damaged: some must be out of place
        if same_length and not all(_plausible(ch) for x, _ in runs for ch in x):
            for written in CHARSETS:
                if written == read:
                    continue
                pairs, off = [], 0
                for x, y in runs:
                    for g, s, c in zip(x, spoil(y, written, read), y, strict=True):
                        off += g != s
                        if s and g != s:
                            off += len(garbled)
                        pairs.append((g, c, g == s))
                # characters that the charset lacks were replaced by a relative before; those that it has must fit
                if off <= 0.25 * len(pairs) and all(_plausible(c) for _, c, _ in pairs) and sum(g != c for g, c, _ in pairs) > 0.5 * len(pairs):
                    yield written, read, pairs


@dataclass
class Conversion:
    """A wrong conversion and the way back."""

    written: str
    read: str
    #: Aligned characters (garbled: clean) that the twins showed; they go before what a charset would make of a text.
    seen: dict[str, str] = field(default_factory=dict)
    #: Characters seen in clean twins, beside the plausible ones.
    alphabet: frozenset[str] = frozenset()
    #: Words of the corpus (see vocabulary), to tell sound from damaged where both sides are Latin.
    words: Mapping[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        pieces = "|".join(map(re.escape, sorted(self.seen, key=len, reverse=True))) or "(?!)"
        self._shown = re.compile(f"(?:{pieces})+")
        self._piece = re.compile(pieces)
        self.foreign = False
        if self.written == ALIGNED:
            odd = "|".join(re.escape(g) for g in self.seen if not all(map(_plausible, g))) or "(?!)"
            self._strong = re.compile(f"[A-Za-z](?:{odd})|(?:{odd})[A-Za-z]")
            self._odd = re.compile(odd)
            self._pattern = re.compile(r"[^\n.!?]+")
            return
        table = reading(self.read)
        # bytes from 0x80 to 0x9f are read as control characters by some programs
        self._codes = {chr(b): b for b in range(0x80, 0xA0)} | writing(self.read)
        if self.written == "utf-8":
            signs = lambda b: {ch for ch, code in self._codes.items() if code == b and ord(ch) > 0x7F}
            group = lambda lo, hi: "[" + "".join(re.escape(ch) for b in range(lo, hi) for ch in sorted(signs(b))) + "]"
            tail = group(0x80, 0xC0)
            self._pattern = re.compile(f"(?:{group(0xC2, 0xE0)}{tail}|{group(0xE0, 0xF0)}{tail}{{2}}|{group(0xF0, 0xF5)}{tail}{{3}})+")
            return
        back = reading(self.written)
        self.map = {table[b]: back[b] for b in range(128, 256) if ord(table[b]) > 0x7F} | self.seen
        self.foreign = sum(0x600 <= ord(c) < 0x700 for c in self.map.values()) > len(self.map) // 3
        part = "[" + "".join(re.escape(ch) for ch in self.map) + "]"
        if self.foreign:
            # whole words, as the letters of both charsets never mix in one
            word = rf"(?<!\w){part}+(?!\w)"
            self._pattern = re.compile(rf"{word}(?:[\s\d.,:;()\"'-]+{word})*")
        else:
            self._pattern = re.compile(r"[^\n.!?]+")

    def undo(self, text: str) -> str:
        return self._pattern.sub(self._back, text)

    @property
    def hint(self) -> str | None:
        """A pattern for RE2 without which a text has nothing to undo; none where single words decide."""
        members = lambda chars: "[" + "".join(f"\\x{{{ord(ch):x}}}" for ch in sorted(chars)) + "]"
        if self.written == ALIGNED:
            return "|".join(re.escape(g) for g in self.seen if not all(map(_plausible, g))) or None
        if self.written == "utf-8":
            part = lambda lo, hi: members(ch for ch, b in self._codes.items() if lo <= b < hi and ord(ch) > 0x7F)
            tail = part(0x80, 0xC0)
            one = f"(?:{part(0xC2, 0xE0)}{tail}|{part(0xE0, 0xF0)}{tail}{tail}|{part(0xF0, 0xF5)}{tail}{tail}{tail})"
            return f"(?:^|[^\\p{{L}}]|[A-Za-z]){one}+(?:$|[^\\p{{L}}]|[A-Za-z])" if self._own_script else one
        return f"(?:^|[^\\p{{L}}\\p{{N}}_]){members(self.map)}{{2}}" if self.foreign else None

    @property
    def _own_script(self) -> bool:
        return self.read in ("cp1256", "iso8859-6", "cp1251", "koi8-r", "cp1253")

    def _fits(self, text: str) -> bool:
        return all(_plausible(ch) or ch in self.alphabet for ch in text)

    def _back(self, m: re.Match) -> str:
        found = m.group()
        if self.written == ALIGNED:
            return self._by_pieces(found) if self._out_of_place(found) else found
        if self.written == "utf-8":
            restored = self._by_pieces(found) if self._shown.fullmatch(found) else bytes(self._codes[ch] for ch in found).decode("utf-8", "replace")
            if not self._fits(restored) and _LOST not in restored:
                restored = self._pattern.sub(self._back, restored)  # damaged twice
            own_script = self._own_script or any(0x600 <= ord(ch) < 0x700 for ch in restored)
            whole = not own_script or self._alone(m)
            return restored if whole and self._fits(restored) else found
        if not self.foreign:
            return self._by_words(found)
        restored = "".join(self.map.get(ch, ch) for ch in found)
        if not self._fits(restored):
            return found
        words = [w for w in re.findall(r"[^\x00-\x7f]+", restored) if len(w) > 1]
        arabic = sum(0x600 <= ord(ch) < 0x700 for ch in restored) > sum(map(len, words)) // 2
        return restored if arabic and (len(words) > 1 or any(len(w) > 3 for w in words)) else found

    def _out_of_place(self, sentence: str) -> bool:
        """Whether a sentence mixes pieces into words of ASCII letters, or is nearly all pieces: other words of their script stay."""
        if self._strong.search(sentence):
            return True
        other = sum(ch > "\x7f" for ch in sentence)
        return other >= 4 and bool(self._odd.search(sentence)) and sum(len(p) for p in self._piece.findall(sentence)) >= 0.9 * other

    def _by_pieces(self, text: str) -> str:
        return self._piece.sub(lambda m: self.seen[m.group()], text)

    def gains(self, word: str) -> bool:
        """Whether a word becomes a much more frequent one."""
        new = plain_word("".join(self.map.get(ch, ch) for ch in word))
        return new != word and self.words.get(new or "", 0) >= MIN_GAIN * max(1, self.words.get(word, 0))

    def _by_words(self, sentence: str) -> str:
        """A sentence is damaged where a rare word becomes a frequent one; then its other unknown words are converted too."""
        parts = re.split(r"(\s+)", sentence)
        out, shown = [], False
        for part in parts:
            word = plain_word(part)
            new = part if word is None else "".join(self.map.get(ch, ch) for ch in part)
            if new != part:
                gain = self.words.get(plain_word(new) or "", 0) >= MIN_GAIN * max(1, self.words.get(word, 0))
                shown |= gain
                new = new if gain or word not in self.words and self._fits(new) else part
            out.append(new)
        return "".join(out) if shown else sentence

    @staticmethod
    def _alone(m: re.Match) -> bool:
        """Whether no letter outside ASCII stands next to the match: in scripts of their own whole words are damaged."""
        before, after = m.string[max(0, m.start() - 1) : m.start()], m.string[m.end() : m.end() + 1]
        return not any(x > "\x7f" and x.isalpha() for x in (before, after))


_EDGES = re.compile(r"^[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+$")


def plain_word(part: str) -> str | None:
    """A word as the vocabulary has it (digits as 0, no ASCII marks around it); None if it is ASCII or Arabic."""
    if part.isascii() or any(0x600 <= ord(ch) < 0x700 for ch in part):
        return None
    return re.sub("[0-9]+", "0", _EDGES.sub("", part))


#: A character that is neither ASCII nor Arabic, for RE2.
_LATIN_MARKED = r"[^\x00-\x7F\x{600}-\x{6FF}\x{200C}\x{200D}]"


@dataclass
class Repair:
    """The conversions learned from a corpus."""

    conversions: list[Conversion]
    words: Mapping[str, int] = field(default_factory=dict)

    def __call__(self, text: str, wanted: Sequence[bool] | None = None) -> str:
        """The text with every conversion undone; ``wanted`` tells which of them have something to undo at first."""
        for k, c in enumerate(self.conversions):
            if wanted is not None and not wanted[k]:
                continue
            for _ in range(PASSES):
                before = text
                text = c.undo(text)
                if text == before:
                    break
                wanted = None  # what comes out may need another
        return text

    def wanted(self, texts: pa.Array) -> np.ndarray:
        """For each conversion and text whether there is anything to undo."""
        out = np.zeros((len(self.conversions), len(texts)), bool)
        by_words = [k for k, c in enumerate(self.conversions) if c.hint is None]
        for k, c in enumerate(self.conversions):
            if c.hint is not None:
                out[k] = pc.match_substring_regex(texts, c.hint).to_numpy(zero_copy_only=False)
        if by_words:
            marked = np.flatnonzero(pc.match_substring_regex(texts, _LATIN_MARKED).to_numpy(zero_copy_only=False))
            for rows, word in self._marked_words(texts.take(pa.array(marked))):
                for k in by_words:
                    if self._gains(k, word):
                        out[k, marked[rows]] = True
        return out

    def _gains(self, k: int, word: str) -> bool:
        if len(self._judged) > 1_000_000:
            self._judged.clear()
        known = self._judged.get((k, word))
        if known is None:
            plain = plain_word(word)
            known = self._judged[k, word] = plain is not None and self.conversions[k].gains(plain)
        return known

    @functools.cached_property
    def _judged(self) -> dict[tuple[int, str], bool]:
        return {}

    def __getstate__(self) -> dict:
        return {"conversions": self.conversions, "words": self.words}

    @staticmethod
    def _marked_words(texts: pa.Array) -> Iterator[tuple[np.ndarray, str]]:
        """Each distinct word with characters that are neither ASCII nor Arabic, and the rows it stands in."""
        done = 0
        for block in cp.blocks(texts):
            points, offsets = cp.decode(block)
            blank = np.r_[True, (points <= 0x20) | (points == 0xA0) | (points == 0x2028) | (points == 0x2029), True]
            edge = np.zeros(len(points) + 1, bool)
            edge[offsets] = True
            starts = np.flatnonzero(~blank[1:-1] & (blank[:-2] | edge[:-1]))
            ends = np.flatnonzero(~blank[1:-1] & (blank[2:] | edge[1:])) + 1
            marks = np.r_[0, np.cumsum((points > 0x7F) & ~((points >= 0x600) & (points < 0x700)) & (points != 0x200C))]
            some = marks[ends] > marks[starts]
            starts, ends = starts[some], ends[some]
            _, first, place = np.unique(cp.span_hashes(points, starts, ends), return_index=True, return_inverse=True)
            row = np.searchsorted(offsets, starts, "right") - 1
            order = np.argsort(place, kind="stable")
            cuts = np.r_[0, np.cumsum(np.bincount(place, minlength=len(first)))]
            for k, i in enumerate(first.tolist()):
                yield done + row[order[cuts[k] : cuts[k + 1]]], "".join(map(chr, points[starts[i] : ends[i]].tolist()))
            done += len(block)


#: Ends of sentences: line breaks and closing punctuation; and those that are no lost characters.
_CUT, _CUT_LOST = r"(?<=\n)|(?<=[.!?] )", r"(?<=\n)|(?<=[.!] )|(?<=[^?\s«(\"-]\? )"


def _sentences(documents: DataFrame, key: str, text: str, cut: str = _CUT) -> DataFrame:
    """``key, part, sentence`` with whole texts cut at line breaks and after closing punctuation."""
    return documents.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.split(text, cut)).alias("part", "sentence"))


def _skeleton(c: str) -> Column:
    """The text stripped of non-ASCII characters (and of digits, which differ between twins)."""
    return F.regexp_replace(c, r"[^\x00-\x7F]+|[0-9]+", "")


def _lengths(c: str, measure: str) -> Column:
    return F.expr(f"array_join(transform(regexp_extract_all({c}, '[^\\\\x00-\\\\x7F]+', 0), r -> cast({measure}(r) as string)), ' ')")


def twins(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``other, twin``: each sentence form with the most frequent form of the same stripped text.

    Where stripped text has few letters (other scripts), the lengths of the runs taken out, in
    characters or bytes, are part of the key. Each form meets one form only, however large a group is.
    """
    forms = _sentences(documents, key, text).select(F.trim(F.regexp_replace("sentence", "[0-9]+", "0")).alias("form")).where(r"form RLIKE '[^\\x00-\\x7F]'").groupBy("form").count()
    forms = forms.select("form", "count", _skeleton("form").alias("skeleton"), _lengths("form", "length").alias("chars"), _lengths("form", "octet_length").alias("bytes"))
    lettered = F.length(F.regexp_replace("skeleton", "[^A-Za-z]", "")) >= 12
    chars, octets = F.concat_ws("|", "skeleton", "chars"), F.concat_ws("|", "skeleton", "bytes")
    # as a possible twin a form answers to its length in bytes too
    offers = forms.select("form", "count", F.explode(F.array_distinct(F.when(lettered, F.array("skeleton")).otherwise(F.array(chars, octets)))).alias("at"))
    best = offers.groupBy("at").agg(F.max(F.struct("count", "form")).alias("b")).select("at", F.col("b.form").alias("twin"), F.col("b.count").alias("most"))
    # with the count on both sides the forms are one exchange, read twice
    asks = forms.select("form", "count", F.when(lettered, F.col("skeleton")).otherwise(chars).alias("at"))
    pairs = asks.join(best, "at").where("form != twin AND count <= most")
    letters = lambda c: F.array_distinct(F.split(F.regexp_replace(c, r"[\x00-\x7F]", ""), ""))
    common = F.size(F.array_intersect(letters("form"), letters("twin")))
    return pairs.where(common <= 0.4 * F.least(F.size(letters("form")), F.size(letters("twin")))).select(F.col("form").alias("other"), "twin")


#: Words rarer than this share of all words with non-ASCII characters are no evidence; so the list holds 1 / MIN_SHARE words at most.
MIN_SHARE, MIN_COUNT = 1e-5, 3
#: How many times as frequent the sound form of a damaged word must be.
MIN_GAIN = 20


def vocabulary(documents: DataFrame, text: str = "text") -> dict[str, int]:
    """Counts of the frequent words with non-ASCII, non-Arabic characters, over all documents."""
    parts = documents.where(F.expr(f"{text} RLIKE '[^\\\\x00-\\\\x7F\\\\x{{600}}-\\\\x{{6FF}}\\\\x{{200C}}]'")).select(F.explode(F.split(text, r"\s+")).alias("part"))
    marks = r"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+"
    words = parts.where(r"part RLIKE '[^\\x00-\\x7F]' AND NOT part RLIKE '[\\x{600}-\\x{6FF}]' AND length(part) <= 60")
    words = words.select(F.regexp_replace(F.regexp_replace("part", f"^{marks}|{marks}$", ""), "[0-9]+", "0").alias("word")).groupBy("word").count()
    seen = Observation()
    words = words.where(F.col("count") >= MIN_COUNT).observe(seen, F.sum("count").alias("total"))
    # no more words than this can have their share of the total, which the same job adds up
    rows = words.orderBy(F.desc("count"), "word").limit(int(1 / MIN_SHARE)).collect()
    total = (seen.get["total"] or 0) if rows else 0
    return {r["word"]: r["count"] for r in rows if r["count"] >= total * MIN_SHARE}


def _learn(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    count: Counter[tuple[str, str, str, str, bool]] = Counter()
    for batch in batches:
        for other, twin in zip(batch["other"], batch["twin"], strict=True):
            for garbled, clean in ((other, twin), (twin, other)):
                for written, read, pairs in explain(garbled, clean):
                    count.update((written, read, *p) for p in pairs)
            count.update((ALIGNED, ALIGNED, g, c, True) for g, c in align(other, twin))
    yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["written", "read", "garbled", "clean", "exact", "n"])


def learn(documents: DataFrame, key: str = "doc_id", text: str = "text") -> Repair:
    """The conversions that explain differences between all twins, likeliest first.

    What comes to the driver is one row per conversion and character, independent of the corpus' size.
    """
    # a number of partitions of its own: pairs are small, but each is aligned under all charsets
    spread = twins(documents, key, text).repartition(max(8, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "other")
    rows = spread.mapInPandas(_learn, "written string, read string, garbled string, clean string, exact boolean, n long").groupBy("written", "read", "garbled", "clean", "exact").agg(F.sum("n").alias("n")).collect()
    return choose(((r.written, r.read, r.garbled, r.clean, r.exact, r.n) for r in rows), vocabulary(documents, text))


def choose(rows: Iterable[tuple[str, str, str, str, bool, int]], words: Mapping[str, int] | None = None) -> Repair:
    """Accepted conversions out of ``written, read, garbled, clean, exact, n``: those that explain most by themselves."""
    by: dict[tuple[str, str], Counter] = {}
    exact: dict[tuple[str, str], Counter] = {}
    alone: Counter[tuple[str, str]] = Counter()
    for written, read, g, c, own, n in rows:
        if written == ALIGNED:
            alone[g, c] += n
            continue
        by.setdefault((written, read), Counter())[g, c] += n
        if own:
            exact.setdefault((written, read), Counter())[g, c] += n
    shown: Counter[str] = Counter()
    for pairs in by.values():
        for (_, c), n in pairs.items():
            shown[c] += n
    alphabet = frozenset(c for c, n in shown.items() if n >= MIN_EXPLAINED and c.isalpha())
    found: list[tuple[bool, Conversion]] = []
    explained: set[tuple[str, str]] = set()
    order_of = ("utf-8", *CHARSETS).index
    order = sorted(by.items(), key=lambda x: (-sum(exact.get(x[0], {}).values()), x[0][0] != "utf-8", *map(order_of, x[0])))
    for (written, read), pairs in order:
        # a conversion that explains nothing beyond the ones before it is the same damage under another name
        new = {p: n for p, n in exact.get((written, read), {}).items() if p not in explained}
        if sum(new.values()) < MIN_EXPLAINED or len({c for _, c in new}) < MIN_DISTINCT:
            continue
        explained |= set(pairs)
        seen = {g: c for (g, c), _ in sorted(pairs.items(), key=lambda x: x[1]) if g != c}
        found.append((written != "utf-8", Conversion(written, read, seen, alphabet, words or {})))
    conversions = [c for _, c in sorted(found, key=lambda x: x[0])]
    # what no charset explains: pieces that nearly always stand for the same letter
    rest = {p: n for p, n in alone.items() if p not in explained and p[0] != p[1] and all(c.undo(p[0]) == p[0] for c in conversions)}
    every: Counter[str] = Counter()
    for (g, _), n in rest.items():
        every[g] += n
    seen = {g: c for (g, c), n in sorted(rest.items(), key=lambda x: x[1]) if n >= MIN_ALIGNED and n >= 0.9 * every[g] and c.isalpha()}
    if sum(rest[g, c] for g, c in seen.items()) >= MIN_EXPLAINED and len(set(seen.values())) >= MIN_DISTINCT and any(not all(map(_plausible, g)) for g in seen):
        conversions.append(Conversion(ALIGNED, ALIGNED, seen, alphabet, words or {}))
    return Repair(conversions, words or {})


def repaired(text: Column | str, repair: Repair) -> Column:
    """The text with every learned conversion undone; null stays null, ASCII texts are passed through."""

    @F.arrow_udf(T.StringType())
    def undo(texts: pa.Array) -> pa.Array:
        filled = texts.fill_null("")
        wanted = repair.wanted(filled)
        open_ = wanted.any(0)
        if not open_.any():
            return texts
        at = np.flatnonzero(open_)
        done = [repair(x, w) for x, w in zip(filled.take(pa.array(at)).to_pylist(), wanted[:, at].T.tolist(), strict=True)]
        return pc.replace_with_mask(texts, pa.array(open_), pa.array(done, texts.type))

    return undo(text)


def damaged(documents: DataFrame, key: str = "doc_id", text: str = "text", repair: Repair | None = None) -> DataFrame:
    """``key, text, restored, lossy``: texts with a stretch in a wrong encoding, and what could be restored.

    ``lossy`` marks texts in which characters were lost (replacement characters, or words of
    question marks); ``restored`` keeps those in place. Null, empty and sound texts give no row.
    Rows repeated under one key are each judged.
    """
    repair = repair or learn(documents, key, text)
    texts = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    suspect = texts.where(F.expr(r"text RLIKE '[^\\x00-\\x7F]'") | F.col("text").rlike(LOST_WORDS))
    judged = suspect.withColumn("restored", repaired("text", repair)).withColumn("lossy", F.col("restored").contains(_LOST) | F.col("restored").rlike(LOST_WORDS))
    return judged.where("lossy OR restored != text")


def from_twins(documents: DataFrame, lossy: DataFrame, key: str = "doc_id", text: str = "text", repair: Repair | None = None) -> DataFrame:
    """``key, restored``: lossy texts with those sentences replaced that have a clean twin.

    A twin is the most frequent sound sentence with the same stripped text of 12 letters or more;
    the runs of characters between the same ASCII characters are taken over from it. A sentence without
    such a twin is compared by its shape, with a question mark for each character outside ASCII or lost: it
    is restored where all sound sentences of that shape that agree with what is left of it are one. With
    ``repair``, sound sentences are repaired before they are compared by shape.
    """
    parts = _sentences(lossy.select("key", F.col("restored").alias("text")), "key", "text", _CUT_LOST)
    lost = F.col("sentence").contains(_LOST) | F.col("sentence").rlike(LOST_WORDS)
    sound = _sentences(documents, key, text, _CUT_LOST).select(F.trim(F.regexp_replace("sentence", "[0-9]+", "0")).alias("form"))
    sound = sound.where(~(F.col("form").contains(_LOST) | F.col("form").rlike(LOST_WORDS))).groupBy("form").count()
    letters = F.length(F.regexp_replace("at", "[^A-Za-z]", "")) >= 12
    best = sound.select("form", "count", F.trim(_skeleton("form")).alias("at")).where(letters).groupBy("at").agg(F.max_by("form", F.struct("count", "form")).alias("twin"))
    parts = parts.withColumn("at", F.when(F.col("sentence").contains(_LOST), F.trim(_skeleton("sentence"))))
    joined = parts.join(best, "at", "left").withColumn("sentence", _merge("sentence", "twin"))

    shape = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "[0-9]+", "0"), r"[^\x00-\x7F]", "?"))
    asked = joined.where(lost).select("sentence", shape("sentence").alias("shape")).where(F.length(F.regexp_replace("shape", r"[^?A-Za-z]", "")) >= 12).distinct()
    # with the count the forms are one exchange, read twice
    offered = sound.where("count > 0").select("form", shape("form").alias("shape")).where(r"form RLIKE '[^\\x00-\\x7F]'").join(F.broadcast(asked.select("shape").distinct()), "shape", "left_semi")
    if repair:
        offered = offered.select("shape", repaired("form", repair).alias("form")).where(shape("form") == F.col("shape")).distinct()
    filled = asked.join(offered, "shape").select("sentence", _fill("sentence", "form").alias("filled")).where("filled IS NOT NULL")
    only = filled.groupBy("sentence").agg(F.min("filled").alias("filled"), F.max("filled").alias("other")).where("filled = other").select("sentence", "filled")
    joined = joined.join(only, "sentence", "left").withColumn("sentence", F.coalesce("filled", "sentence"))
    return joined.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sentence"))), lambda x: x["sentence"]), "").alias("restored"))


def fill(sentence: str, form: str) -> str | None:
    """``sentence`` with its lost characters (replacement characters, question marks) taken from a form of the same shape; None if the rest differs."""
    body = sentence.strip(" ")
    a, b = re.split("([0-9]+)", body), re.split("([0-9]+)", form)
    if [len(x) for x in a[::2]] != [len(x) for x in b[::2]]:
        return None
    out = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if i % 2:
            out.append(x)
            continue
        if any(p != q and (p not in (_LOST, "?") or q.isascii()) for p, q in zip(x, y, strict=True)):
            return None
        out.append(y)
    at = sentence.index(body)
    return sentence[:at] + "".join(out) + sentence[at + len(body) :]


@F.arrow_udf(T.StringType())
def _fill(sentences: pa.Array, forms: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else fill(x, y) for x, y in zip(sentences.to_pylist(), forms.to_pylist(), strict=True)], pa.string())


def merge(sentence: str, twin: str | None) -> str:
    """``sentence`` with the runs of ``twin`` in place of those that hold replacement characters."""
    if not twin or _LOST not in sentence:
        return sentence
    strip = re.compile(r"[^\x00-\x7f0-9]+|[0-9]+")
    a, b = [x for x in re.split(r"([^\x00-\x7f]+)", sentence)], [x for x in re.split(r"([^\x00-\x7f]+)", twin)]
    plain = lambda xs: [strip.sub("", x).strip() for x in xs[::2]]
    if plain(a) != plain(b):
        return sentence
    return "".join(y if i % 2 and _LOST in x else x for i, (x, y) in enumerate(zip(a, b, strict=True)))


@F.arrow_udf(T.StringType())
def _merge(sentences: pa.Array, twins: pa.Array) -> pa.Array:
    return pa.array([x if x is None else merge(x, t) for x, t in zip(sentences.to_pylist(), twins.to_pylist(), strict=True)], pa.string())
