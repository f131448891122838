import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pii_sentences import FRESH, LAST, SENTENCES, WORDS
from pyspark.sql import functions as F

from quern.llm import pii
from quern.llm.pii_grammar import Grammar

_PIECE = re.compile(r"\{(\w+):([^}]*)\}")


@pytest.fixture(scope="module")
def redactor():
    return pii.Redactor(pii.train(), pii.Words(WORDS))


def done(redactor, text):
    plain = pii.canonical_arrow(pa.array([text]))
    spans = redactor.spans(plain)[0]
    return pii.redacted(text, pii.carried_back(text, plain[0].as_py(), spans)), {k for *_, k in spans}


@pytest.mark.parametrize(("sentences", "least"), [(SENTENCES, 0.88), (FRESH, 0.83), (LAST, 0.9)])
def test_recall_and_precision_by_type(redactor, sentences, least):
    """Sentences apart from the grammar, most names in them unknown: nearly all pieces of each type, and little else."""
    hit, wanted, given = Counter(), Counter(), Counter()
    for s in sentences:
        got = done(redactor, _PIECE.sub(r"\2", s))[1]
        want = {k for k, _ in _PIECE.findall(s)}
        hit.update(got & want)
        wanted.update(want)
        given.update(got)
    for kind in pii.TYPES:
        assert hit[kind] >= least * wanted[kind] and hit[kind] >= 0.9 * given[kind], (kind, hit, wanted, given)


def test_grammar_owes_nothing_to_the_tables(spark, folder):
    """No phrase of the training grammar of two words or more stands in the tables, but for everyday ones."""
    from quern.llm import pii_grammar as g

    texts = "\n".join(r.t.lower() for name, c in (("agent_turns", "user_message"), ("resilience_logs", "reasoning")) for r in spark.read.parquet(f"{folder}/{name}.parquet").where(f"{c} IS NOT NULL").select(F.col(c).alias("t")).distinct().collect())
    tables = [*g._LEADS.values(), g._OPENERS, g._CLOSERS, g._SERVICE, g._MEASURES, g._COUNTED, g._NO_PERSON, g._SMALL_TALK]
    phrases = {p.strip().lower() for t in tables for xs in t.values() for x in xs for p in re.split(r"\||\{\}", x)}
    assert not [p for p in phrases if len(p) >= 10 and " " in p and p in texts]


def test_the_rest_of_a_text_stays(redactor):
    """Outside the placeholders not a character changes, whatever the canonical form makes of it."""
    r, g = random.Random(5), Grammar(31)
    wide = str.maketrans({c: chr(ord(c) + 0xFEE0) for c in "0123456789@abcdefghij"})
    found = 0
    for text, _ in pii.labelled(g, 300):
        odd = "".join(x + r.choice(["", "", "", "​", "́"]) if x.isalpha() else x for x in text).translate(wide) + "  x"
        out, kinds = done(redactor, odd)
        found += bool(kinds)
        rest = re.split(r"\[(?:EMAIL|PHONE|ID_NUMBER|ADDRESS|NAME)\]", out)
        assert re.fullmatch(".+?".join(map(re.escape, rest)), odd, re.S)
    assert found > 100


def test_edge_texts(redactor):
    for text in ("", " ", "​", "plain", "9", "x" * 200_000, "Ann " * 20_000):
        assert done(redactor, text)[0] == text
    assert pii._redacted(pa.array([None, "", "Tel.: 0161 496 0142"], pa.string()), None, redactor).to_pylist() == [{"text": None, "types": []}, {"text": "", "types": []}, {"text": "Tel.: [PHONE]", "types": ["PHONE"]}]


def frames(spark):
    r = random.Random(3)
    names = [("Ann", "Bergholt"), ("Quill", "Marrow"), ("Tove", "Sandrik")]
    rows = [(i, r.choice(["My name is {} {}.", "signed {} {}", "Dear {} {}, hello", "I walk home."]).format(*r.choice(names)), "c") for i in range(300)]
    return rows, spark.createDataFrame([*rows, rows[0], (900, None, "c"), (901, "", "c")], "id long, body string, text string")


def test_frames(spark, redactor):
    rows, df = frames(spark)
    model = pii.build([(df, "body")])
    h = pii.word_hashes(*pii.cp.decode(pa.array(["bergholt marrow sandrik ann hello walk name"])))[2]
    assert model.words.has(h).tolist() == [True] * 4 + [False] * 3
    found = pii.found(df, "id", "body", model)
    want = {i for i, t, _ in rows if not t.startswith("I walk")}
    assert {(x.key, x.pii_type) for x in found.collect()} == {(i, "NAME") for i in want}
    kept = pii.records(df, "id", "body", redactor).collect()
    assert len(kept) == 302 and {x.key: x.text for x in kept}[900] is None
    assert pii.found(df.limit(0), "id", "body", redactor).count() == 0


def test_many_name_words_are_joined(spark):
    """Where the name words are too many to be sent to every task, the joined way gives the same."""
    _, df = frames(spark)
    sent, joined = pii.build([(df, "body")]), pii.build([(df, "body")], broadcast_words=2)
    assert isinstance(sent.words, pii.Words) and not isinstance(joined.words, pii.Words)
    for f in (pii.found, pii.records):
        assert sorted(map(str, f(df, "id", "body", sent).collect())) == sorted(map(str, f(df, "id", "body", joined).collect()))


def test_names_of_all_texts(spark):
    """Each name is introduced twice in 70,000 texts: none may be lost to a sample or a cap."""
    word = lambda i: "".join(chr(97 + int(d)) for d in f"{i:05d}")
    rows = [(f"My name is Qu{word(i)} Za{word(i)} and this is note {n}.",) for i in range(6_000) for n in "ab"]
    plain = spark.range(70_000).selectExpr("concat('I take the short way home, ', id) AS body")
    model = pii.build([(spark.createDataFrame(rows, "body string").unionByName(plain), "body")])
    assert len(model.words) == 12_000


def test_word_hashes():
    """A word has one hash wherever it stands, in any case of letters."""
    texts = ["Ann met ann, ANN's aunt", "", "é ann", "ann"]
    starts, ends, h = pii.word_hashes(*pii.cp.decode(pa.array(texts)))
    words = ["ann", "met", "ann", "ann", "s", "aunt", "é", "ann", "ann"]
    assert (ends - starts).tolist() == list(map(len, words))
    assert len({(w, x) for w, x in zip(words, h.tolist(), strict=True)}) == len(set(words)) == len(set(h.tolist()))
