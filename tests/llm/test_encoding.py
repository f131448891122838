import random

import pytest
from pyspark.sql import functions as F

from quern.llm import encoding as en


def spoiled(text, written, read):
    return "".join(en.spoil(text, written, read))


FR = ["La bénévole a enfin nommé la fenêtre près du café numéro {}.", "Séance très calme à la forêt après {} répétitions, déjà réalisée."]
DE = ["Die Übungsleiterin zählte fünf Türen für die größere Wäsche am Tag {}."]
FA = ["وقتی بچه‌ها خوابیدند مربی همتا از خداحافظی دیرکرده گفت و اتاق آرام‌تر شد.", "کوچک‌ترین قبض را بردار و فقط نگاهش کن."]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    rows, truth = [], {}
    chains = {"fr": [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("cp1252", "cp850")], "fa": [("utf-8", "cp1256"), ("utf-8", "latin-1"), ("cp1256", "cp1252")]}
    for i in range(600):
        lang = r.choice(["fr", "fa"])
        parts = [r.choice(FR + DE if lang == "fr" else FA).format(r.randint(1, 99)) for _ in range(4)]
        clean = " ".join(parts)
        k = r.random()
        if k < 0.2:
            a, b = r.choice(chains[lang])
            at = r.randrange(4)
            body = parts[at].replace("ی", "ي") if a == "cp1256" else parts[at]
            if a != "cp1256" or "‌" in body:
                parts[at] = spoiled(body, a, b)
                truth[i] = clean
        rows.append((i, " ".join(parts), "x", 1))
    rows += [(900, "Le caf� num�ro 3 reste ferm�.", "x", 1), (901, "وقتی ???? ?? ????? آمد.", "x", 1), (902, "Vraiment ??? Rien. Zimmer Ø1 und § 4, ½ £ ¥.", "x", 1), (903, None, "x", 1), (904, "", "x", 1), (905, "هرچند شک دارم کسی گوش بدهد. ظاهر طرح", "x", 1), (906, "plain", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, restored int").repartition(4), truth


def test_found_and_restored(corpus):
    df, truth = corpus
    repair = en.learn(df)
    got = {r.key: r for r in en.damaged(df, repair=repair).collect()}
    assert set(got) == set(truth) | {900, 901}
    assert {k for k, r in got.items() if r.lossy} == {900, 901}
    assert [(got[k].restored, clean) for k, clean in truth.items() if got[k].restored != clean] == []


def test_twin_restores_lost_characters(spark):
    rows = [(i, "Le café numéro 3 reste toujours fermé.") for i in range(5)] + [(9, "Le caf� num�ro 3 reste toujours ferm�. Fin.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    repair = en.Repair([])
    lossy = en.damaged(df, repair=repair).where("lossy")
    assert [r.restored for r in en.from_twins(df, lossy).collect()] == ["Le café numéro 3 reste toujours fermé. Fin."]


def test_double_damage_and_empty(spark):
    c = en.Conversion("utf-8", "cp1252")
    twice = spoiled(spoiled("déjà vu – « été »", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert en.Repair([c])(twice) == "déjà vu – « été »"
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert en.damaged(empty).count() == 0


def test_every_twin_is_learned_from(spark):
    """A conversion shown by few twins is learned among more than 40,000 others, whatever their hashes."""
    letters = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(4))
    clean = [f"Brune reste {letters(i)} à l'été après le goûter de" for i in range(3_000)]
    rare = spark.createDataFrame([(c, spoiled(c, "utf-8", "mac_roman")) for c in clean], "clean string, bad string")
    # the rare twins come last in the order of hashes
    rare = rare.orderBy(F.desc(F.xxhash64("bad"))).limit(3).collect()
    word = "concat(" + ", ".join(f"char(97 + cast(id / {26**k} as int) % 26)" for k in range(4)) + ")"
    common = spark.range(41_000).selectExpr("id AS doc_id", f"concat('Le texte blanc ', {word}, ' caf\u00e9 br\u00fbl\u00e9') AS text")
    bad = common.selectExpr("doc_id + 100000 AS doc_id", "replace(replace(text, '\u00e9', '\u00c3\u00a9'), '\u00fb', '\u00c3\u00bb') AS text")
    rows = [(200_000 + 10 * i + k, t) for i, r in enumerate(rare) for k, t in enumerate([r.clean, r.clean, r.bad])]
    df = common.unionByName(common).unionByName(bad).unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {("utf-8", "cp1252"), ("utf-8", "mac_roman")} <= {(c.written, "cp1252" if c.read in ("latin-1", "cp1254") else c.read) for c in en.learn(df).conversions}


def test_question_marks_are_restored_by_shape(spark):
    lost = lambda t: "".join("?" if ch > "\x7f" else ch for ch in t)
    other = "وقتی بچه‌ها خندیدند مربی همتا از خداحافظی دیرکرده گفت و اتاق سردتر شد."
    rows = [(i, f"{FA[0]} {FA[1]}") for i in range(3)] + [(7, other), (8, lost(FA[0])), (9, f"{lost(FA[1])} {FA[0]}"), (10, FA[0].replace("خوابیدند مربی", lost("خوابیدند مربی"))), (11, "???? ?? ??? ناشناس.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lossy = en.damaged(df, repair=en.Repair([])).where("lossy")
    got = {r.key: r.restored for r in en.from_twins(df, lossy, repair=en.Repair([])).collect()}
    assert got == {8: FA[0], 9: f"{FA[1]} {FA[0]}", 10: FA[0], 11: "???? ?? ??? ناشناس."}


def test_question_marks_stay_lossy(spark, tmp_path):
    from quern.llm import catalog

    spark.createDataFrame([(1, "???? ?? ??? ناشناس."), (2, "plain")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.doc_id, r.lossy) for r in catalog.p8_restored(spark, str(tmp_path)).collect()] == [(1, True)]


def test_charset_outside_the_list(spark):
    """Damage by a charset that is not among the known ones is learned from aligned characters alone."""
    assert "cp866" not in en.CHARSETS
    r = random.Random(8)
    bad = lambda t: t.encode("cp1252").decode("cp866")
    lines = [f"{a} {b} {c} près de la fenêtre où l'été s'achève, forêt et café" for a in ("Brune", "Paul", "Lise", "Jean", "Rose") for b in ("reste", "chante", "dort") for c in ("tard", "ici")]
    rows = [(i, line) for i, line in enumerate(lines * 3)]
    rows += [(1000 + i, bad(line)) for i, line in enumerate(r.sample(lines, 12))]
    # without a twin
    rows += [(2000, bad("Une phrase sans jumelle : l'été où la forêt brûle près du café.")), (2001, "Чай и щука – русский текст."), (2002, "Le café est fermé.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    repair = en.learn(df)
    assert [c.written for c in repair.conversions] == [en.ALIGNED]
    got = {x.key: x.restored for x in en.damaged(df, repair=repair).collect()}
    clean = set(lines)
    assert all(got[1000 + i] in clean for i in range(12)) and got[2000].startswith("Une phrase sans jumelle : l'été où la forêt br")
    assert set(got) == {*range(1000, 1012), 2000}


def test_restored_by_type_of_damage(spark):
    """Planted damage of each type: the clean text comes out, whole texts and single sentences alike."""
    fr = [f"{a} {b} {c}, déjà réalisée après l'été à Orléans – « bénévole » n° {i}" for i, a in enumerate(("Séance", "Forêt", "Fenêtre", "Journée")) for b in ("très calme", "bien gérée") for c in ("près du café", "où il neige", "côté rivière")]
    fa = [f"{a} {b} {c} از خداحافظی دیرکرده گفت و اتاق آرام‌تر شد" for a in ("وقتی بچه‌ها خوابیدند", "دیروز غروب", "پس از ناهار") for b in ("مربی همتا", "همسایه‌ی قدیمی") for c in ("آهسته", "چند بار")]
    kinds = {("utf-8", "cp1252"): fr, ("utf-8", "cp1251"): fr, ("utf-8", "mac_roman"): fr, ("utf-8", "cp437"): fr, ("utf-8", "cp1256"): fa, ("utf-8", "latin-1"): fa}
    rows = [(i, f"{t}. Merci.") for i, t in enumerate((fr + fa) * 3)]
    want, key = {}, 1000
    for (a, b), texts in kinds.items():
        for t in texts:
            rows.append((key, f"{spoiled(t, a, b)}. Merci."))
            want[key] = ((a, b), f"{t}. Merci.")
            key += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.key: x.restored for x in en.damaged(df).collect()}
    hit = {k: [got.get(i) == t for i, (kind, t) in want.items() if kind == k] for k in kinds}
    assert set(got) == set(want) and all(sum(x) >= 0.95 * len(x) for x in hit.values()), {k: sum(x) / len(x) for k, x in hit.items()}
