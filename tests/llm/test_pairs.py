import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import pairs

EN = ["Put the phone in another room before bed.", "Tell one person a single sentence about today.", "Keep one chair in the flat free of work.", "The same worry returns because it has no hour of its own."]
DE = ["Leg das Telefon vor dem Schlafen weg.", "Sag deiner Leitung, dass du vor Donnerstag nicht kannst.", "Ein Kopf ohne Pause bewacht alle Türen zugleich.", "Gewohnheiten lockern sich zuerst am Abend."]
END = {"en": "One step is enough for today.", "de": "Ein Schritt genügt für heute."}


def make(r, lang):
    body = EN if lang == "en" else DE
    return " ".join([*r.sample(body, 3), END[lang]])


def test_defects(spark):
    r = random.Random(1)
    rows, truth = [], {}
    for i in range(800):
        lang = r.choice(["en", "de"])
        rows.append([i, " ".join(r.sample(EN if lang == "en" else DE, 2)), make(r, lang), None])
    for i, (kind, change) in enumerate(
        [
            ("empty", lambda q, a: None), ("empty", lambda q, a: " …​"), ("copy", lambda q, a: q), ("copy", lambda q, a: f"Your message: {q.upper()} {q}"), ("copy", lambda q, a: "“" + q.replace("e", "е") + "”"),
            ("refusal", lambda q, a: "I'm sorry to hear that. I must decline to answer."), ("truncated", lambda q, a: a[: len(a) // 2 - 3]), ("truncated", lambda q, a: a[:40].rstrip() + " **"), ("", lambda q, a: f"You said “{q[:30]}”. " + a),
        ]
    ):
        rows[i][2] = change(rows[i][1], rows[i][2])
        if kind:
            truth[i] = kind
    rows[20][1:3] = [" ".join(EN[:2]), make(r, "de")]
    rows[21][1:3] = ["ok", make(r, "de")]
    rows[22][1:3] = [None, make(r, "de")]
    rows[23][1:4] = [" ".join(EN[:2]), make(r, "de"), "HIGH_RISK"]
    rows[24][1:3] = ["Ｔｅｌｌ ｏｎｅ ｐｅｒｓｏｎ а sіnglе sеntеnсе", make(r, "en")]
    truth[20] = "other_language"
    rows.append(list(rows[0]))
    turns = spark.createDataFrame([(*x, "clash") for x in rows], "id long, q string, a string, s string, key string")
    labelled = spark.createDataFrame([(" ".join(EN), "en"), (" ".join(DE), "DE-at"), (None, "fr"), ("x", None)], "text string, lang string")
    got = pairs.broken(turns, labelled, "id", "q", "a", F.col("s") == "HIGH_RISK").collect()
    assert {x.key: x.defect for x in got} == truth and len(got) == len(truth)
    assert pairs.broken(turns.limit(0), labelled, "id", "q", "a", F.lit(False)).count() == 0
    assert pairs.broken(turns.limit(1), labelled.limit(0), "id", "q", "a", F.lit(False)).count() <= 1


def test_held_out_languages(spark):
    labelled = spark.createDataFrame([(" ".join(EN[:3]), "en"), (" ".join(DE[:3]), "de")], "text string, lang string")
    model = pairs.fit_languages(labelled)
    import pyarrow as pa

    scores, letters = model.scores(pa.array([EN[3], DE[3], "", "x" * 3_000_000]))
    assert [model.names[i] for i in scores[:2].argmax(1)] == ["en", "de"] and letters.tolist()[2:] == [0, 3_000_000]


def test_copies_do_not_vouch(spark):
    """A truncated response delivered many times, with changing marks after it, stays truncated; a repeated notice is none."""
    r = random.Random(2)
    cut = make(r, "en")[:61].rstrip()
    rows = [(i, " ".join(r.sample(DE, 2)) + f" {i}", make(r, "en").replace("phone", f"phone {i}"), "") for i in range(400)]
    rows += [(1000 + i, "How is it?", cut + ("", " **", "…")[i % 3], "") for i in range(600)] + [(2000 + i, "How is it?", "The safety check is paused", "UNAVAILABLE") for i in range(3)]
    turns = spark.createDataFrame(rows, "id long, q string, a string, s string")
    labelled = spark.createDataFrame([], "text string, lang string")
    got = pairs.broken(turns, labelled, "id", "q", "a", F.col("s") == "UNAVAILABLE").collect()
    assert {(x.key, x.defect) for x in got} == {(1000 + i, "truncated") for i in range(600)}


def brute(texts, i):
    """The ratio of text ``i`` by counting in all others."""
    whole, p = "\n".join(texts), 0.5
    for n in (1, 4, 8, 16):
        gram = texts[i][-n:]
        places = len(re.findall(f"(?={re.escape(gram)})", whole)) - 1
        ends = sum(t.endswith(gram) for t in texts) - 1
        p = (ends + 10 * p) / (places + 10)
    return p / (1 - p) * sum(map(len, texts)) / len(texts)


def test_counts_are_exact(spark):
    """Ratios equal those of a brute-force count, in one pass and in many."""
    r = random.Random(4)
    word = lambda k: "".join(r.choice("abcdefghij") for _ in range(k))
    ends = [word(16) for _ in range(20)]
    texts = [f"{word(r.randint(20, 400))} {r.choice(ends)}" for _ in range(150)]
    df = spark.createDataFrame([(t + x,) for t in texts for x in ("", " **")] + [(None,), ("",), ("  ",)], "a string")
    want = {hashlib.md5(t.encode()).digest(): brute(texts, i) for i, t in enumerate(texts)}
    for block in (pairs.BLOCK_GRAMS, 200):
        got = {bytes(x.digest): x.ratio for x in pairs.end_ratios(df, "a", block).collect()}
        assert set(got) == set(want)
        assert max(abs(got[k] / want[k] - 1) for k in want) < 1e-6


@pytest.mark.parametrize(("texts", "sentences"), [(2_000, 3), (2_000, 12), (20_000, 6), (20_000, 12)])
def test_unrepeated_texts_of_any_number(spark, texts, sentences):
    """No sentence twice, one answer in ten cut somewhere: what is complete stays so, however many answers there are."""
    r = random.Random(texts + sentences)
    words = ["".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") for _ in range(r.randint(1, 3))) + r.choice(["", "n", "s", "r"]) for _ in range(3_000)]
    rows, cut = [], set()
    for i in range(texts):
        made = " ".join(" ".join(r.choices(words, k=r.randint(5, 14))).capitalize() + r.choice([".", ".", ".", "!", "?"]) for _ in range(sentences))
        if r.random() < 0.1:
            at = r.randint(len(made) // 3, len(made) - 6)
            if made[at - 1] not in ".!? ":
                made = made[:at]
                cut.add(hashlib.md5(made.encode()).digest())
        rows.append((made,))
    got = {bytes(x.digest) for x in pairs.end_ratios(spark.createDataFrame(rows, "a string").repartition(8), "a").where(F.col("ratio") < pairs.MIN_RATIO).collect()}
    assert len(got & cut) >= 0.9 * len(cut), (len(got & cut), len(cut))
    assert len(got - cut) <= 0.02 * texts, (len(got - cut), texts)


FRESH = {
    "Sorry, I can't discuss this one": 1, "I do not feel comfortable responding to that request": 1, "I won't be giving any opinion here": 1, "That is not something I'm allowed to talk about": 1, "I'm unable to provide medical advice": 1, "My rules don't let me answer this": 1,
    "Darüber möchte ich nicht sprechen": 1, "Hierzu kann ich keine Auskunft erteilen": 1, "Ich darf dir dazu nicht raten": 1, "Meine Vorgaben lassen keine Antwort zu": 1, "Je ne suis pas en mesure de vous aider": 1, "Je ne peux pas discuter de ce sujet": 1, "Il m'est défendu de répondre": 1,
    "از جواب دادن معذورم": 1, "نمی‌توانم در این باره صحبت کنم": 1, "اجازه ندارم پاسخ بدهم": 1,
    "I'd rather not discuss money with your boss; try a short note first": 0, "I cannot promise it will pass tonight": 0, "I can't imagine how tired you must be": 0, "Your request sounds reasonable": 0, "Tell her you can't come": 0, "You are allowed to say no": 0, "Some letters can wait for an answer": 0,
    "Du kannst heute nicht alles lösen": 0, "Ich weiß nicht, wie sich das anfühlt": 0, "Frag morgen noch einmal": 0, "Tu ne peux pas tout porter": 0, "Je ne sais pas à quoi ressemble ta nuit": 0, "Demande un avis au médecin": 0, "امشب نمی‌توانی همه را حل کنی": 0, "فردا جواب نامه را بده": 0, "خسته شدی و حق داری": 0,
}


def test_refusals_apart_from_the_grammar(spark):
    """Sentences written by hand: at least three in four refusals found, at most one in eight others taken for one."""
    import pyarrow as pa

    from quern.llm import refusals

    labelled = spark.createDataFrame([(" ".join(EN),), (" ".join(DE),), (None,)], "text string")
    w = refusals.model(refusals.plain_clauses(labelled, "text"))
    got = dict(zip(FRESH, refusals.refuses(pa.array(list(FRESH)), w).tolist(), strict=True))
    found = sum(got[t] for t, k in FRESH.items() if k)
    wrong = sum(got[t] for t, k in FRESH.items() if not k)
    assert found >= 0.75 * sum(FRESH.values()) and wrong <= 2, (found, wrong, [t for t, k in FRESH.items() if got[t] != k])
    assert refusals.refuses(pa.array([None, "", " ", "x" * 100_000], pa.string()), w).tolist() == [False] * 4
