"""Text expressions: normalization, crisis phrases, evidence comparison, token overlap."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters brought to one form, marks that are deleted, characters that become blanks.
LETTERS_FROM = "يىئكآأإۀة۰۱۲۳۴۵۶۷۸۹"
LETTERS_TO = "یییکاااهه0123456789"
MARKS = "[\\u064B-\\u065F\\u0670]"
BREAKS = "[\\u200C\\u200D\\r\\n\\t\\f\\x0B!?,.:;\\u061B\\u061F\"'()\\-\\[\\]{}<>/\\\\]"
# Phrases that state a crisis.
CRISIS = (
    "خودکشی",
    "خودمو بکشم",
    "خودم رو بکشم",
    "خودکشی کنم",
    "نمیخوام زنده باشم",
    "نمی خواهم زنده باشم",
    "میخوام بمیرم",
    "می خواهم بمیرم",
    "پایان بدم به زندگی",
    "پایان دادن به زندگی",
    "رگمو بزنم",
    "رگم رو بزنم",
    "رگم بزنم",
    "قصدم خودکشیه",
    "خسته شدم از زندگی میخوام بمیرم",
)
#: Blanks of any width, as a character class that Java and RE2 read alike.
BLANKS = "[\\s\\x0B\\x1C-\\x1F\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def squeezed(text: Column | str) -> Column:
    """Runs of blanks become one, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def normalized(text: Column | str) -> Column:
    """Letters unified, marks deleted, punctuation as blanks, lower case (P9); null becomes empty."""
    plain = F.translate(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), LETTERS_FROM, LETTERS_TO)
    return F.lower(squeezed(F.regexp_replace(F.regexp_replace(plain, MARKS, ""), BREAKS, " ")))


def plain_phrase(phrase: str) -> str:
    """normalized() for a phrase at hand."""
    out = re.sub(MARKS, "", phrase.translate(str.maketrans(LETTERS_FROM, LETTERS_TO)))
    return " ".join(re.sub(BREAKS, " ", out).split()).lower()


def crisis(text: Column | str, phrases: tuple[str, ...] = CRISIS, normalize_phrases: bool = False) -> Column:
    """Whether the normalized text contains any phrase (P10); phrases are taken as written unless told otherwise.

    One pattern holds all phrases, so the text is normalized and searched once.
    """
    chosen = [plain_phrase(p) if normalize_phrases else p for p in phrases]
    return normalized(text).rlike("|".join(rf"\Q{p}\E" for p in chosen)) if chosen else F.lit(False)


def evidence(text: Column | str) -> Column:
    """Evidence as it is compared (P25): squeezed, lower case; null becomes empty."""
    return F.lower(squeezed(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))))


def words(text: Column) -> Column:
    """The words of squeezed text; none for an empty text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def token_f1(gold: Column, predicted: Column) -> Column:
    """F1 of the words of two squeezed texts as multisets (G11); 0 where either has none or nothing is shared."""
    g, p = words(gold), words(predicted)
    count = lambda xs, t: F.size(F.filter(xs, lambda w: w == t))
    shared = F.aggregate(F.transform(F.array_distinct(g), lambda t: F.least(count(g, t), count(p, t))), F.lit(0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(2.0 * shared, F.size(g) + F.size(p)), F.lit(0.0))
