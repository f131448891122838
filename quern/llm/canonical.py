"""One form for texts that look the same but differ in their characters (problem 2).

Whole Arrow batches are handled as arrays of code points: a lookup table maps or deletes single
characters, ligatures and presentation forms are expanded with running offsets, combining marks
are ordered and composed with their letters by table look-ups on all positions at once. No step
calls a string function per row.

What the form unites: full-width and half-width forms, mathematical letters, ligatures, Arabic
presentation forms, composed and combining accents, blanks of any width and number, invisible
characters, Cyrillic and Greek letters drawn like Latin ones, Arabic and Persian forms of a letter
or digit that differ only by keyboard layout. What it keeps apart: letter case, accents, digits
that look different, punctuation, words, lines, and the single zero-width non-joiner between two
letters of the Arabic script, which belongs to the spelling.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import codepoints as cp

# Letters that are drawn alike. Left: Cyrillic and Greek; right: the Latin letter.
LOOK_ALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧνο",
        "ABESIJKMHOPCTYXaesijopcyxhdqwABEZHIKMNOPTYXvo",
        strict=True,
    )
)
# Arabic forms and the Persian letter or digit that is drawn alike; hyphens.
KEYBOARD = {"ي": "ی", "ى": "ی", "ك": "ک", "ڪ": "ک", "٠": "۰", "١": "۱", "٢": "۲", "٣": "۳", "٧": "۷", "٨": "۸", "٩": "۹", "‐": "-", "‑": "-"}
#: Tags of compatibility decompositions that change width, joining form or font only.
_TAGS = {"<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>", "<noBreak>"}
_ZWNJ, _ZWJ, _BLANK, _LINE = 0x200C, 0x200D, 0x20, 0x0A
_DROP = -1
_CHANGES, _IS_BLANK, _IS_ARABIC, _IS_ZWNJ = 1, 2, 4, 8


class _Tables:
    """Lookup tables over all code points, built from the Unicode database."""

    def __init__(self) -> None:
        size = sys.maxunicode + 1
        self.one = np.arange(size, dtype=np.int32)
        self.many = np.zeros(size, bool)
        self.mark = np.zeros(size, np.uint8)
        self.arabic = np.zeros(size, bool)
        self.blank = np.zeros(size, bool)
        expansions: dict[int, str] = {}
        splits: dict[int, str] = {}
        pairs: dict[int, int] = {}
        for c in range(size):
            if 0xD800 <= c < 0xE000 or 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or c >= 0x20000:
                continue
            ch = chr(c)
            kind = unicodedata.category(ch)
            if kind in ("Zs", "Zl", "Zp") or ch in "\t\n\r\x0b\x0c\x85":
                self.one[c] = _LINE if kind in ("Zl", "Zp") or ch in "\n\r\x0b\x0c\x85" else _BLANK
            elif kind in ("Cc", "Cf") and c not in (_ZWNJ, _ZWJ) or 0xFE00 <= c <= 0xFE0F or c == 0x034F:
                self.one[c] = _DROP
            else:
                form = self._form(ch)
                if len(form) == 1:
                    self.one[c] = ord(form)
                else:
                    expansions[c] = form
            self.mark[c] = unicodedata.combining(ch)
            self.arabic[c] = kind[0] in "LM" and unicodedata.bidirectional(ch) in ("AL", "NSM") and (0x0600 <= c < 0x0780)
            plain = unicodedata.normalize("NFD", ch)
            if len(plain) > 1:
                splits[c] = plain
                composed = unicodedata.decomposition(ch).split()
                if len(composed) == 2 and unicodedata.normalize("NFC", ch) == ch:
                    first, second = (int(x, 16) for x in composed)
                    pairs[first << 21 | second] = c
        pairs[ord("ی") << 21 | 0x654] = 0x626
        pairs[ord("ه") << 21 | 0x654] = 0x6C0
        self.blank[[_BLANK, _LINE]] = True
        self.many[list(expansions)] = True
        self.flag = (_CHANGES * ((self.one != np.arange(size)) | self.many | (self.mark > 0))).astype(np.uint8)
        self.flag[_ZWJ] = self.flag[0x1100:0x1200] = _CHANGES
        self.flag |= (_IS_BLANK * self.blank | _IS_ARABIC * self.arabic).astype(np.uint8)
        self.flag[_ZWNJ] = _IS_ZWNJ
        self.expansion = self._pool(expansions)
        self.split = self._pool(splits)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_values = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)

    @classmethod
    def _form(cls, ch: str) -> str:
        tag, _, rest = unicodedata.decomposition(ch).partition(" ")
        if tag in _TAGS or tag == "<compat>" and unicodedata.category(ch)[0] == "L":
            return "".join(cls._form(chr(int(x, 16))) for x in rest.split())
        # letters are united below their accents, so that composed and combining accents come to the same
        plain = "".join(KEYBOARD.get(x) or LOOK_ALIKE.get(x) or x for x in unicodedata.normalize("NFD", ch))
        return unicodedata.normalize("NFC", plain).replace("\u06cc\u0654", "\u0626")

    @staticmethod
    def _pool(table: dict[int, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, and for each its length and start in the pool."""
        keys = np.array(sorted(table), np.int32)
        lengths = np.array([len(table[k]) for k in keys.tolist()], np.int64)
        pool = np.array([ord(x) for k in keys.tolist() for x in table[k]], np.int32)
        return keys, lengths, np.cumsum(lengths) - lengths, pool


@functools.cache
def _tables() -> _Tables:
    return _Tables()


#: Code points, row offsets, and for each code point its place in the text that it comes from (None where nobody asks).
_Rows = tuple[np.ndarray, np.ndarray, np.ndarray | None]


def _kept(points: np.ndarray, offsets: np.ndarray, origin: np.ndarray | None, keep: np.ndarray) -> _Rows:
    return *cp.select(points, offsets, keep), None if origin is None else origin[keep]


def _expanded(points: np.ndarray, offsets: np.ndarray, origin: np.ndarray | None, at: np.ndarray, table: tuple) -> _Rows:
    keys, lengths, starts, pool = table
    k = np.searchsorted(keys, points[at])
    if origin is not None:
        sizes = np.ones(len(points), np.int64)
        sizes[at] = lengths[k]
        origin = np.repeat(origin, sizes)
    return *cp.expand(points, offsets, at, lengths[k], starts[k], pool), origin


def _composed(points: np.ndarray, offsets: np.ndarray, origin: np.ndarray | None) -> _Rows:
    """Marks in canonical order, composed with their letters where a composed letter exists."""
    t = _tables()
    if not t.mark[points].any():
        return points, offsets, origin
    rows = cp.rows_of(offsets)
    before_mark = np.zeros(len(points), bool)
    before_mark[:-1] = (t.mark[points[1:]] > 0) & (rows[1:] == rows[:-1])
    at = np.flatnonzero(before_mark | (t.mark[points] > 0))
    at = at[np.isin(points[at], t.split[0])]
    if len(at):
        points, offsets, origin = _expanded(points, offsets, origin, at, t.split)
        rows = cp.rows_of(offsets)
    rank = t.mark[points]
    marks = np.flatnonzero(rank > 0)
    run = np.cumsum(np.r_[True, (np.diff(marks) > 1) | (rows[marks[1:]] != rows[marks[:-1]])])
    points = points.copy()
    points[marks] = points[marks][np.lexsort((rank[marks], run))]
    while True:
        key = points[:-1].astype(np.int64) << 21 | points[1:]
        k = np.searchsorted(t.pair_keys, key).clip(max=len(t.pair_keys) - 1)
        hit = (t.pair_keys[k] == key) & (rows[1:] == rows[:-1]) & (t.mark[points[1:]] > 0) & (t.mark[points[:-1]] == 0)
        at = np.flatnonzero(hit)
        if not len(at):
            return points, offsets, origin
        points[at] = t.pair_values[k[at]]
        keep = np.ones(len(points), bool)
        keep[at + 1] = False
        points, offsets, origin = _kept(points, offsets, origin, keep)
        rows = cp.rows_of(offsets)


def _hangul(points: np.ndarray, offsets: np.ndarray, origin: np.ndarray | None) -> _Rows:
    """Conjoining letters of Hangul composed to syllables, by the arithmetic of the Unicode standard."""
    for first, count, second, others in ((0x1100, 19, 0x1161, 21), (0xAC00, 11172, 0x11A8, 27)):
        after = (points >= second) & (points < second + others)
        if not after.any():
            continue
        before, _ = _neighbours(points, offsets)
        fits = after & (before >= first) & (before < first + count)
        if first == 0xAC00:
            fits &= (before - first) % 28 == 0
        at = np.flatnonzero(fits)
        points = points.copy()
        if first == 0xAC00:
            points[at - 1] += points[at] - second + 1
        else:
            points[at - 1] = 0xAC00 + ((points[at - 1] - first) * 21 + points[at] - second) * 28
        points, offsets, origin = _kept(points, offsets, origin, ~fits)
    return points, offsets, origin


def _neighbours(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code point before and after each one in its row, -1 at the edges."""
    before, after = np.full(len(points), -1, np.int32), np.full(len(points), -1, np.int32)
    before[1:], after[:-1] = points[:-1], points[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = -1
    after[offsets[1:][full] - 1] = -1
    return before, after


def canonical_points(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The canonical form of rows of code points."""
    return _canonical_rows(points, offsets, None)[:2]


def _canonical_rows(points: np.ndarray, offsets: np.ndarray, origin: np.ndarray | None) -> _Rows:
    t = _tables()
    if not len(points):
        return points, offsets, origin
    at = np.flatnonzero(t.many[points])
    if len(at):
        points, offsets, origin = _expanded(points, offsets, origin, at, t.expansion)
    points = t.one[points]
    keep = points != _DROP
    if not keep.all():
        points, offsets, origin = _kept(points, offsets, origin, keep)
    points, offsets, origin = _composed(*_hangul(points, offsets, origin))
    # the composed letter may itself have a keyboard or look-alike form
    points = t.one[points]
    joiners = (points == _ZWNJ) | (points == _ZWJ)
    if joiners.any():
        # of several joiners in a row the first counts
        before, _ = _neighbours(points, offsets)
        first = joiners & (before != _ZWNJ) & (before != _ZWJ)
        points, offsets, origin = _kept(points, offsets, origin, first | ~joiners)
        before, after = _neighbours(points, offsets)
        inside = (points == _ZWNJ) & t.arabic[before] & t.arabic[after] & (before >= 0) & (after >= 0)
        emoji = (points == _ZWJ) & (before >= 0x2190) & (after >= 0x2190)
        points, offsets, origin = _kept(points, offsets, origin, (points != _ZWNJ) & (points != _ZWJ) | inside | emoji)
    blank = t.blank[points]
    if blank.any():
        # of a run of blanks one is kept, a line break if there is one; none at the edges of a row
        run = np.flatnonzero(blank)
        rows = cp.rows_of(offsets)
        starts = np.r_[True, (np.diff(run) > 1) | (rows[run[1:]] != rows[run[:-1]])]
        group = np.cumsum(starts) - 1
        lines = np.zeros(group[-1] + 1, bool)
        np.logical_or.at(lines, group, points[run] == _LINE)
        points = points.copy()
        first = run[starts]
        points[first] = np.where(lines, _LINE, _BLANK)
        keep = ~blank
        keep[first] = True
        points, offsets, origin = _kept(points, offsets, origin, keep)
        before, after = _neighbours(points, offsets)
        points, offsets, origin = _kept(points, offsets, origin, ~(t.blank[points] & ((before < 0) | (after < 0))))
    return points, offsets, origin


def _touched(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that are not in canonical form already."""
    if not len(points):
        return np.zeros(len(offsets) - 1, bool)
    flag = _tables().flag[points]
    special = (flag & _CHANGES) > 0
    blank = (flag & _IS_BLANK) > 0
    special[1:] |= blank[1:] & blank[:-1]
    full = offsets[1:] > offsets[:-1]
    for edge in (offsets[:-1][full], offsets[1:][full] - 1):
        special[edge[blank[edge]]] = True
    joiner = np.flatnonzero(flag & _IS_ZWNJ)
    if len(joiner):
        arabic = np.r_[(flag & _IS_ARABIC) > 0, False]
        inside = arabic[joiner - 1] & arabic[joiner + 1]
        # a row's first or last joiner has a letter of another row beside it
        inside &= ~np.isin(joiner, offsets)
        inside &= ~np.isin(joiner + 1, offsets)
        special[joiner[~inside]] = True
    return cp.rows_with(offsets, np.flatnonzero(special))


def canonical_arrow(texts: pa.Array) -> pa.Array:
    """The canonical form of every text; null stays null, text without visible characters becomes empty."""
    return cp.mapped(texts, canonical_points, _touched)


def origins(text: str) -> np.ndarray:
    """For each code point of a text's canonical form the place in ``text`` that it comes from; one entry more for the end."""
    points, offsets = cp.decode(pa.array([text], pa.string()))
    _, _, origin = _canonical_rows(points, offsets, np.arange(len(points)))
    return np.r_[origin, len(points)]


def covered(text: str, end: int) -> int:
    """``end``, moved behind the marks and invisible characters that belong to the character before it."""
    t = _tables()
    while end < len(text) and (t.mark[ord(text[end])] or t.one[ord(text[end])] == _DROP):
        end += 1
    return end


@F.arrow_udf(T.StringType())
def _canonical(texts: pa.Array) -> pa.Array:
    return canonical_arrow(texts)


def canonical(text: Column | str) -> Column:
    """Column form of canonical_arrow: whole texts of any length, null for null."""
    return _canonical(text)


def _digest(c: str) -> Column:
    return F.unhex(F.md5(c))


def look_alike_classes(rows: DataFrame, key: Column, text: Column) -> DataFrame:
    """``key, form, raw``: digests of the canonical and the literal text of each row.

    Rows with the same ``form`` look the same; those with another ``raw`` differ in their
    characters. Rows without key, text or any visible character are left out; repeated rows count once.
    """
    shown = rows.select(key.alias("key"), text.alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    shown = shown.withColumn("canonical", canonical("text")).where("canonical != ''")
    return shown.select("key", _digest("canonical").alias("form"), _digest("text").alias("raw")).distinct()


def look_alike_links(rows: DataFrame, key: Column, text: Column) -> DataFrame:
    """``key, class_id, links``: the class of each row's text and how many rows look the same in other characters.

    One row per key and text, however large a class is; copies are counted, not expanded.
    """
    members = look_alike_classes(rows, key, text)
    literal = members.groupBy("form", "raw").agg(F.count("*").alias("same"))
    whole = literal.groupBy("form").agg(F.sum("same").alias("all"))
    sizes = literal.join(whole, "form").select("form", "raw", (F.col("all") - F.col("same")).alias("links"))
    return members.join(sizes, ["form", "raw"]).select("key", F.lower(F.hex("form")).alias("class_id"), "links")


def look_alike_pairs(rows: DataFrame, key: Column, text: Column) -> DataFrame:
    """``key_a < key_b``: pairs of rows whose texts look the same but are not the same characters.

    Pairs are made between classes of equal text first, so rows of equal text never meet; the work
    after that is in proportion to the result. See look_alike_classes for what is left out.
    """
    members = look_alike_classes(rows, key, text)
    classes = members.select("form", "raw").distinct()
    mixed = classes.groupBy("form").count().where("count > 1").select("form")
    classes = classes.join(mixed, "form", "left_semi")
    pairs = classes.join(classes.withColumnRenamed("raw", "raw_b"), "form").where("raw < raw_b")
    left = members.select(F.col("form"), F.col("raw"), F.col("key").alias("a"))
    right = members.select(F.col("form"), F.col("raw").alias("raw_b"), F.col("key").alias("b"))
    met = pairs.join(left, ["form", "raw"]).join(right, ["form", "raw_b"]).where("a != b")
    return met.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()


def disguised_quotes(quotes: DataFrame, texts: DataFrame, quote_key: str, text_key: str, quote: str, text: str) -> DataFrame:
    """``text_key, quote_key`` of quotes not literally contained in their text that look like a part of it.

    ``quotes`` has both keys. Null and empty quotes, quotes without visible characters and quotes of
    unknown texts give no row. Only rows that fail the literal test are brought to canonical form.
    """
    q = quotes.select(F.col(text_key).alias("k"), F.col(quote_key).alias("q"), F.col(quote).alias("quote")).where("quote IS NOT NULL AND quote != ''")
    t = texts.select(F.col(text_key).alias("k"), F.col(text).alias("text")).where("text IS NOT NULL AND text != ''")
    off = q.join(t, "k").where(~F.contains("text", "quote"))
    seen = off.select("k", "q", canonical("quote").alias("quote"), canonical("text").alias("text"))
    return seen.where((F.col("quote") != "") & F.contains("text", "quote")).select(F.col("k").alias(text_key), F.col("q").alias(quote_key)).distinct()
