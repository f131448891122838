"""Defects of prompt and response pairs (problem 5).

Refusals are told by a linear model over word n-grams (refusals.py). Two models are trained from the tables at hand. A naive Bayes model over character trigrams,
counted per labelled language, gives the language posteriors of prompt and response; a full answer
whose posterior favours another language than the prompt's is a defect. N-grams of characters are
counted over all distinct responses, at the end of a text and anywhere: an ending whose n-grams mostly go on
elsewhere has a low end-of-text likelihood, and the response is taken to break off.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import codepoints as cp
from quern.llm import refusals
from quern.llm.canonical import canonical_arrow

#: Labelled texts per language that the language model is fitted on (a bounded sample, chosen by hash).
LANGUAGE_SAMPLE = 300
#: Languages below this share of the labelled texts are not modelled.
LANGUAGE_SHARE = 0.01
_TRIGRAM_BITS, _ORDERS = 15, (1, 4, 8, 16)
#: Letters that a text needs for its language to be judged, and log-odds per text to call it another one.
MIN_LETTERS, MIN_LOG_ODDS = 20, 15.0
#: A response breaks off where its last characters are less than this many times likelier at an end than elsewhere.
MIN_RATIO = 8.0
#: N-grams sent to a task at once, 8 bytes each.
BLOCK_GRAMS = 8_000_000
#: Letters and digits of a prompt that can be copied at all, and of the words that may lead in a copy.
MIN_COPIED, MAX_LEAD_IN = 12, 40

#: What is said by others; a broken answer may end inside a quotation.
_QUOTED = r"[“„«][^“”„«»]*(?:[”“»]|$)|\"[^\"]*(?:\"|$)"


@functools.cache
def _folds() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letter of each code point (0 for others), and the code point with digits folded."""
    size = sys.maxunicode + 1
    letter, plain = np.zeros(size, np.uint32), np.arange(size, dtype=np.uint32)
    for c in range(0x3000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            letter[c] = ord(low) if len(low) == 1 else c
        elif unicodedata.category(ch) == "Nd":
            plain[c] = 0x30
    letter[0x3000:0x20000] = np.arange(0x3000, 0x20000)
    return letter, plain


def _trigrams(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of letters (other characters are one blank), whether each counts, and letters per row."""
    letter = _folds()[0][points]
    before = np.zeros(len(points) + 1, np.int64)
    np.cumsum(letter > 0, out=before[1:])
    letters = before[offsets[1:]] - before[offsets[:-1]]
    a, b, c = np.zeros_like(letter), np.zeros_like(letter), letter
    b[1:], a[2:] = letter[:-1], letter[:-2]
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    b[starts] = a[starts] = 0
    second = starts + 1
    second = second[second < len(a)]
    a[second] = 0
    with np.errstate(over="ignore"):
        h = ((a * np.uint32(961) + b * np.uint32(31) + c) * np.uint32(0x9E3779B1)) >> np.uint32(32 - _TRIGRAM_BITS)
    return h, (c > 0) | (b > 0) & (a > 0), letters


@dataclass
class Languages:
    """Naive Bayes over hashed trigrams: ``log_likelihood[hash, language]``."""

    names: list[str]
    log_likelihood: np.ndarray

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text in each language, and its number of letters."""
        all_scores, all_letters = [], []
        for block in cp.blocks(texts):
            points, offsets = cp.decode(block)
            h, counts, letters = _trigrams(points, offsets)
            sums = np.zeros((len(points) + 1, len(self.names)), np.float64)
            np.cumsum(self.log_likelihood[h] * counts[:, None], axis=0, out=sums[1:])
            all_scores.append(sums[offsets[1:]] - sums[offsets[:-1]])
            all_letters.append(letters)
        if not all_scores:
            return np.zeros((0, len(self.names))), np.zeros(0, np.int64)
        return np.concatenate(all_scores), np.concatenate(all_letters)


def fit_languages(labelled: DataFrame, text: str = "text", language: str = "lang", sample: int = LANGUAGE_SAMPLE, share: float = LANGUAGE_SHARE) -> Languages:
    """The language model of a bounded sample of labelled texts; labels are compared by their first part in lower case."""
    rows = labelled.select(F.col(text).alias("text"), F.lower(F.trim(F.split(F.trim(language), "[-_]")[0])).alias("lang")).where("text IS NOT NULL AND lang != ''")
    least = (rows.count() or 0) * share
    known = [r["lang"] for r in rows.groupBy("lang").count().where(F.col("count") >= least).orderBy("lang").collect()]
    rows = rows.where(F.col("lang").isin(known)) if known else rows.limit(0)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    chosen = rows.withColumn("rank", rank).where(F.col("rank") <= sample).select("lang", "text")
    counts = np.zeros((1 << _TRIGRAM_BITS, max(1, len(known))))
    for r in chosen.repartition(4, "lang", F.xxhash64("text")).mapInPandas(_count_trigrams, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect():
        counts[r["slot"], known.index(r["lang"])] = r["n"]
    smoothed = counts + 0.5
    return Languages(known or [""], np.log(smoothed / smoothed.sum(0)).astype(np.float32))


def _count_trigrams(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, group in batch.groupby("lang"):
            for block in cp.blocks(pa.array(group["text"], pa.string())):
                h, counts, _ = _trigrams(*cp.decode(block))
                found[lang] = found.get(lang, 0) + np.bincount(h[counts], minlength=1 << _TRIGRAM_BITS)
    for lang, n in found.items():
        slots = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "slot": slots.astype(np.int32), "n": n[slots]})


def _trimmed(texts: pa.Array) -> pa.Array:
    """Without what may follow a broken end: blanks, invisible characters, mark-up, commas and dots of omission."""
    return pc.replace_substring_regex(texts, r"(?:[\s\x{A0}\x{200B}-\x{200F}\x{2060}\x{FEFF}*_#`~|,;،؛…]|\.{2,})+$", "")


@F.arrow_udf(T.StringType())
def _trim(texts: pa.Array) -> pa.Array:
    return _trimmed(texts).cast(pa.string())


def _suffixes(points: np.ndarray, offsets: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each order the 64-bit hash of the n-gram that ends at each position, and whether it lies inside its row."""
    h = _folds()[1][points].astype(np.uint64)
    place = np.arange(len(points)) - np.repeat(offsets[:-1], np.diff(offsets))
    out, base, n = {}, np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while True:
            if n in _ORDERS:
                mixed = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
                out[n] = (mixed ^ mixed >> np.uint64(32), place >= n - 1)
            if n >= _ORDERS[-1]:
                return out
            longer = h.copy()
            longer[n:] += h[:-n] * base
            h, base, n = longer, base * base, 2 * n


class Grams:
    """A set of hashed n-grams, each with its place in the sorted list."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes.astype(np.uint64))

    @functools.cached_property
    def _may(self) -> tuple[np.ndarray, np.uint64]:
        """Whether any n-gram starts with these bits: most others are passed by without a search."""
        bits = max(16, int(len(self.hashes)).bit_length() + 4)
        shift = np.uint64(64 - bits)
        table = np.zeros(1 << bits, bool)
        table[self.hashes >> shift] = True
        return table, shift

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes}

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``hashes`` that are in the set, and their places in the list."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        table, shift = self._may
        at = np.flatnonzero(table[hashes >> shift])
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[place] == hashes[at]
        return at[same], place[same]


def _last_grams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``order, rows, hashes``: the n-grams that end the texts, by the texts' last characters only."""
    done = 0
    for block in cp.blocks(pc.utf8_slice_codeunits(texts, -_ORDERS[-1])):
        points, offsets = cp.decode(block)
        rows = np.flatnonzero(offsets[1:] > offsets[:-1])
        last = offsets[1:][rows] - 1
        for n, (hashes, inside) in _suffixes(points, offsets).items():
            whole = inside[last]
            yield n, done + rows[whole], hashes[last][whole].view(np.int64)
        done += len(block)


def _grams_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, _, hashes in _last_grams(batch.column(0)):
            own = np.unique(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), n, np.int32)), pa.array(own)], ["n", "gram"])


def _keyed_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, rows, hashes in _last_grams(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), n, np.int32)), pa.array(hashes)], ["digest", "n", "gram"])


def _counted(texts: DataFrame, grams: dict[int, Grams]) -> DataFrame:
    """``n, gram, ends, places`` of the given n-grams over all ``texts`` (one row each)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, ends = ({n: np.zeros(len(g.hashes), np.int64) for n, g in grams.items()} for _ in range(2))
        for batch in batches:
            for block in cp.blocks(batch.column(0)):
                points, offsets = cp.decode(block)
                last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
                for n, (hashes, inside) in _suffixes(points, offsets).items():
                    size = len(grams[n].hashes)
                    places[n] += np.bincount(grams[n].find(hashes[inside])[1], minlength=size)
                    ends[n] += np.bincount(grams[n].find(hashes[last][inside[last]])[1], minlength=size)
        for n, g in grams.items():
            at = np.flatnonzero(places[n])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(g.hashes[at].view(np.int64)), pa.array(ends[n][at]), pa.array(places[n][at])], ["n", "gram", "ends", "places"])

    rows = texts.select("text").mapInArrow(count, "n int, gram long, ends long, places long")
    return rows.groupBy("n", "gram").agg(F.sum("ends").alias("ends"), F.sum("places").alias("places"))


def end_ratios(texts: DataFrame, text: str, block: int = BLOCK_GRAMS) -> DataFrame:
    """``digest, ratio``: for each distinct text how much likelier its last characters are at the end of a text than inside one.

    Counted exactly over all distinct texts (without what may follow a broken end; ``digest`` is the md5
    of that): copies of a text do not vouch for each other, and each text's own end is left out. Longer
    n-grams count more where they are frequent; characters never seen elsewhere speak for
    an end. As the ratio is relative to the length of texts, it does not depend on how many sentences they have or
    how many texts there are. Empty texts have no row.

    The n-grams that end some text are sent to the tasks that count them, ``block`` at a time: more of
    them mean more passes over the texts, not more memory.
    """
    shown = texts.select(_trim(F.col(text)).alias("text")).where("text != ''")
    grams = shown.mapInArrow(_grams_of, "n int, gram long").distinct()
    once = shown.distinct()
    first = grams.limit(block + 1).toPandas()
    parts = [first]
    if len(first) > block:
        n = -(-grams.count() // (block // 2))
        parts = (grams.where(F.pmod("gram", F.lit(n)) == k).toPandas() for k in range(n))
    counts = functools.reduce(DataFrame.unionByName, (_counted(once, {n: Grams(part["gram"][part["n"] == n].to_numpy(np.int64).view(np.uint64)) for n in _ORDERS}) for part in parts))
    length = shown.agg(F.avg(F.length("text"))).first()[0] or 1.0
    own = once.select(F.unhex(F.md5("text")).alias("digest"), "text").mapInArrow(_keyed_grams, "digest binary, n int, gram long")
    # an n-gram that occurs in one text only tells nothing about it
    met = own.join(counts.where("places > 1"), ["n", "gram"], "left")
    per = met.groupBy("digest").agg(*[F.max(F.when(F.col("n") == n, F.col(c) - 1)).cast("double").alias(f"{c}{n}") for n in _ORDERS for c in ("ends", "places")])
    p = F.lit(0.5)
    for n in _ORDERS:
        ends, seen = (F.coalesce(F.col(f"{c}{n}"), F.lit(0.0)) for c in ("ends", "places"))
        p = (ends + 10 * p) / (seen + 10)
    return per.select("digest", (p / (1 - p + 1e-9) * length).alias("ratio"))


_WORD = re.compile(r"[^\W_]+")


def is_copy(prompt: str, response: str) -> bool:
    """Whether a response (both in canonical form) is the prompt and nothing else: once or repeated, perhaps led in."""
    p, r = ("".join(_WORD.findall(x.casefold())) for x in (prompt, response))
    if len(p) < MIN_COPIED or not r.endswith(p):
        return False
    while r.endswith(p):
        r = r[: -len(p)]
    return len(r) <= MAX_LEAD_IN


def defects(prompts: pa.Array, responses: pa.Array, languages: Languages, refusal: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """For each pair the defect that shows in itself (empty, copy, refusal, or null), and whether its languages differ."""
    out = np.full(len(responses), None, object)
    answers = responses.fill_null("")
    written = pc.match_substring_regex(answers, r"[\p{L}\p{N}]").to_numpy(zero_copy_only=False)
    out[~written] = "empty"
    asked = prompts.fill_null("")

    size = pc.utf8_length(asked).to_numpy(zero_copy_only=False), pc.utf8_length(answers).to_numpy(zero_copy_only=False)
    rest = (size[1] + size[0] // 4) % np.maximum(size[0], 1)
    near = written & (size[0] >= MIN_COPIED) & (size[1] * 10 >= size[0] * 8) & (rest <= size[0] // 4 + 2 * MAX_LEAD_IN + 20)
    at = np.flatnonzero(near)
    if len(at):
        # decomposed and disguised letters change lengths: what remains is compared in canonical form
        sides = [x.take(pa.array(at)) for x in (asked, answers)]
        a, b = (canonical_arrow(x).to_pylist() for x in sides)
        # a disguised capital may have been lowered in its own script
        c, d = (canonical_arrow(pc.utf8_lower(x)).to_pylist() for x in sides)
        out[at[[is_copy(*x) or is_copy(*y) for x, y in zip(zip(a, b, strict=True), zip(c, d, strict=True), strict=True)]]] = "copy"

    open_ = np.array([x is None for x in out], bool)
    own = pc.replace_substring_regex(answers, _QUOTED, " ")
    refused = refusals.refuses(own, refusal)
    out[open_ & refused] = "refusal"
    at = np.flatnonzero(open_ & ~refused)
    other = np.zeros(len(responses), bool)
    if len(at):
        p, p_letters = languages.scores(canonical_arrow(asked.take(pa.array(at))))
        r, r_letters = languages.scores(own.take(pa.array(at)))
        of_prompt, of_response = p.argmax(1), r.argmax(1)
        k = np.arange(len(at))
        sure = np.minimum(p[k, of_prompt] - p[k, of_response], r[k, of_response] - r[k, of_prompt]) >= MIN_LOG_ODDS
        other[at] = sure & (p_letters >= MIN_LETTERS) & (r_letters >= MIN_LETTERS)
    return pa.array(out, pa.string()), other


_SHOWN = T.StructType([T.StructField("defect", T.StringType()), T.StructField("other", T.BooleanType())])


def _shown(prompt: Column, response: Column, languages: Languages, refusal: np.ndarray) -> Column:
    """Column form of defects()."""

    @F.arrow_udf(_SHOWN)
    def judge(prompts: pa.Array, responses: pa.Array) -> pa.Array:
        found, other = defects(prompts, responses, languages, refusal)
        return pa.StructArray.from_arrays([found, pa.array(other)], ["defect", "other"])

    return judge(prompt, response)


def broken(turns: DataFrame, labelled: DataFrame, key: str, prompt: str, response: str, notice: Column) -> DataFrame:
    """``key, defect`` of every defective pair, one of empty, copy, refusal, truncated, other_language (in this order).

    A null response is empty; a null, empty or very short prompt can neither be copied nor have
    another language. ``notice`` marks pairs with a fixed notice, which neither breaks off nor has a wrong language. Repeated rows give one row. ``labelled``
    has ``text`` and ``lang``; where it is empty no language is judged.
    """
    languages, refusal = fit_languages(labelled), refusals.model(refusals.plain_clauses(labelled, "text"))
    cut = end_ratios(turns, response).where(F.col("ratio") < MIN_RATIO).select("digest", F.lit(True).alias("cut"))
    digest = F.unhex(F.md5(_trim(F.col(response))))
    rows = turns.select(F.col(key).alias("key"), F.coalesce(notice, F.lit(False)).alias("notice"), digest.alias("digest"), _shown(F.col(prompt), F.col(response), languages, refusal).alias("s"))
    # texts stay where they are: from here on a row is a few numbers
    rows = rows.select("key", "notice", "digest", "s.defect", "s.other").join(cut, "digest", "left")
    later = F.when(F.col("notice"), None).when(F.col("cut"), "truncated").when(F.col("other"), "other_language")
    return rows.select("key", F.coalesce("defect", later).alias("defect")).where("defect IS NOT NULL").distinct()
