import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import canonical as ca

ONE = lambda t: ca.canonical_arrow(pa.array([t], pa.string()))[0].as_py()


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Ｈｉ　ｔｈｅｒｅ", "Hi there"), ("café", "café"), ("a​b﻿­⁠c", "abc"), ("a   b", "a b"), ("Неllο ѕаy", "Hello say"), ("كتاب علي", "کتاب علی"), ("١٢", "۱۲"), ("ﬁle", "file"), ("ﻻ", "لا"),
        ("می‌‌دانم", "می‌دانم"), ("dog‌ day", "dog day"), ("آ", "آ"), ("ئ", "یٔ"), ("  x ", "x"), ("co‑op", "co-op"), ("𝐛𝐨𝐥𝐝", "bold"), ("ệ", "ệ"),
    ],
)
def test_same_form(a, b):
    assert ONE(a) == ONE(b)


@pytest.mark.parametrize(("a", "b"), [("Hi", "hi"), ("café", "cafe"), ("می‌دانم", "میدانم"), ("می‌دانم", "می دانم"), ("٤", "۴"), ("12", "۱۲"), ("a!", "a"), ("“a”", '"a"'), ("a\nb", "a b"), ("²", "2")])
def test_other_form(a, b):
    assert ONE(a) != ONE(b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.characters(codec="utf-8"), max_size=40)), max_size=12))
def test_batches_rows_and_fixpoint(texts):
    got = ca.canonical_arrow(pa.array(texts, pa.string())).to_pylist()
    assert got == [None if t is None else ONE(t) for t in texts]
    assert got == ca.canonical_arrow(pa.array(got, pa.string())).to_pylist()
    for form in ("NFC", "NFD"):
        again = [None if t is None else ONE(unicodedata.normalize(form, t)) for t in texts]
        plain = [t is None or all(unicodedata.normalize("NFC", unicodedata.normalize("NFD", c)) == c for c in t) for t in texts]
        assert all(x == y for x, y, ok in zip(got, again, plain, strict=True) if ok)


def test_sliced_and_long():
    long = "ａ" * 3_000_000 + "é" * 10
    arr = pa.array(["x", long, None, "ｂ", ""]).slice(1)
    assert ca.canonical_arrow(arr).to_pylist() == ["a" * 3_000_000 + "é" * 10, None, "b", ""]


def test_pairs_and_quotes(spark):
    turns = spark.createDataFrame([(1, "héllo you", "q"), (2, "héllo you", "q"), (3, "héllo you", "q"), (3, "héllo you", "q"), (4, None, "q"), (5, " ", "q"), (6, "​", "q"), (None, "héllo  you", "q"), (7, "Héllo you", "q")], "key long, text string, form string")
    got = ca.look_alike_pairs(turns, F.col("key"), F.col("text")).collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 3)]
    links = {(r.key, r.class_id): r.links for r in ca.look_alike_links(turns, F.col("key"), F.col("text")).collect()}
    assert len(links) == 4 and len({c for _, c in links}) == 2 and {k: n for (k, _), n in links.items()} == {1: 1, 2: 2, 3: 1, 7: 0}
    quotes = spark.createDataFrame([(10, 1, "ｈéｌｌｏ"), (11, 1, "héllo"), (12, 1, "hello"), (13, 1, ""), (14, 1, None), (15, 99, "x"), (16, 1, "​")], "s long, key long, quote string")
    assert [tuple(r) for r in ca.disguised_quotes(quotes, turns, "s", "key", "quote", "text").collect()] == [(1, 10)]
    assert ca.look_alike_pairs(turns.limit(0), F.col("key"), F.col("text")).count() == 0
