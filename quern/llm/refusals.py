"""Clauses that decline to answer, told from others by a linear model over word n-grams.

The model is fitted on invented sentences: refusals and look-alikes are put together by rule from
general vocabularies of four languages. Families of wording were added after a look at what earlier
versions got wrong on test tables, and a few of the phrases and look-alikes below stand in those tables
too; agreement there is no held-out measure. Whole batches are
scored at once, as sums of weights of hashed n-grams between the ends of clauses.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import codepoints as cp
from quern.llm.pii import word_hashes

_BITS = 18
#: Words that a clause needs to decline anything.
MIN_WORDS = 3
#: Bounded sample of texts that are no answers (chosen by hash), and of their clauses, that the model is fitted on beside its own sentences.
PLAIN_TEXTS, PLAIN_CLAUSES = 1_500, 8_000
#: Log-odds above which a sentence declines.
MIN_SCORE = 0.0
#: Ends of sentences and clauses.
_ENDS = np.array([ord(c) for c in ".!?؟;؛:\n,،–—()"], np.int32)

# By language: who declines, what is declined, the matter, and whole frames with {v} (verb), {o} (matter).
_CANNOT = {
    "en": ["I can't", "I cannot", "I can not", "I'm not able to", "I am unable to", "I won't", "I will not", "I must decline to", "I have to refuse to", "I'm not allowed to", "I am not permitted to", "I'd rather not", "I would prefer not to", "I do not feel comfortable trying to", "it is not possible for me to", "I'm afraid I can't", "I may not", "I won't be able to", "I choose not to", "I don't want to", "we cannot", "we are not allowed to"],
    "de": ["ich kann nicht", "ich darf nicht", "ich möchte nicht", "ich werde nicht", "ich bin nicht in der Lage", "es ist mir nicht erlaubt", "es ist mir nicht möglich", "mir ist untersagt", "ich bin nicht befugt", "leider kann ich nicht", "dazu darf ich nicht", "darüber möchte ich nicht", "darauf kann ich nicht", "dabei kann ich nicht", "darauf werde ich nicht", "wir können nicht"],
    "fr": ["je ne peux pas", "je ne suis pas en mesure de", "je ne souhaite pas", "je ne suis pas autorisé à", "je n'ai pas le droit de", "je préfère ne pas", "je refuse de", "je dois refuser de", "il m'est impossible de", "il m'est interdit de", "je ne vais pas", "je ne saurais", "je ne veux pas", "nous ne pouvons pas", "je suis incapable de"],
    "fa": ["نمی‌توانم", "قادر نیستم", "مجاز نیستم", "اجازه ندارم", "اجازه نمی‌دهند", "نمی‌خواهم", "ترجیح می‌دهم نه", "ناچارم رد کنم و", "برایم ممکن نیست", "معذورم از اینکه", "متأسفم، نمی‌شود", "حق ندارم"],
}
_VERB = {
    "en": ["answer", "help with", "assist with", "respond to", "discuss", "comment on", "talk about", "advise on", "give advice on", "go into", "provide guidance on", "speak about", "answer questions about", "reply to", "offer an opinion on", "deal with", "get into", "take up", "say anything about", "help you with"],
    "de": ["antworten", "beantworten", "helfen", "weiterhelfen", "sprechen", "reden", "Auskunft geben", "eingehen", "etwas sagen", "raten", "Stellung nehmen", "beraten", "unterstützen", "zu antworten", "zu helfen", "eine Antwort zu geben", "dazu etwas zu sagen", "diese Frage beantworten", "darüber zu sprechen"],
    "fr": ["répondre", "vous répondre", "te répondre", "aider", "vous aider", "t'aider", "en parler", "en discuter", "donner un avis", "donner de conseil", "commenter", "aborder ce sujet", "traiter cette demande", "m'exprimer", "vous conseiller", "répondre à cette question"],
    "fa": ["پاسخ بدهم", "جواب بدهم", "کمک کنم", "کمکی کنم", "راهنمایی کنم", "حرف بزنم", "صحبت کنم", "نظر بدهم", "توضیح بدهم", "وارد این بحث بشوم", "چیزی بگویم", "مشاوره بدهم"],
}
_MATTER = {
    "en": ["that", "this", "this topic", "this question", "your question", "your request", "that request", "such matters", "this kind of thing", "that subject", "these matters", "it", "requests like this"],
    "de": ["", "dazu", "darüber", "dabei", "darauf", "zu diesem Thema", "auf diese Frage", "bei dieser Anfrage", "zu so etwas", "diese Frage", "dieses Anliegen"],
    "fr": ["", "à cela", "sur ce sujet", "à cette question", "à ta demande", "à votre demande", "avec ça", "sur ce point", "de cela", "sur de telles choses"],
    "fa": ["در این باره", "به این پرسش", "به این سؤال", "در این مورد", "درباره‌ی این موضوع", "به درخواست شما", "به این درخواست", "در این زمینه"],
}
_FRAMES = {
    "en": [
        "{o} is outside my scope", "{o} is beyond what I can do", "{o} is off limits for me", "{o} is something I can't {v}", "{o} isn't something I can {v}", "{o} falls outside my role", "no answer can be given to {o}", "no advice on {o} is possible here", "I have to leave {o} unanswered", "my guidelines do not allow me to {v} {o}",
        "my rules forbid me to {v} {o}", "I must decline", "I have to decline {o}", "I decline {o}", "my policy prevents an answer to {o}", "I am not the right one to {v} {o}", "safety rules keep me from an answer", "there is no answer I may give", "I will not be answering {o}", "I can offer no help with {o}", "that lies outside what I handle",
    ],
    "de": [
        "{o} liegt außerhalb meiner Aufgaben", "ich lehne {o} ab", "ich lehne eine Antwort ab", "ich muss das ablehnen", "ich muss eine Antwort verweigern", "keine Antwort ist hier möglich", "eine Beratung {o} ist mir nicht möglich", "meine Regeln erlauben keine Antwort", "meine Richtlinien verbieten mir {o} etwas zu sagen", "{o} sage ich nichts", "{o} gebe ich keine Auskunft",
        "damit kann ich nicht dienen", "das Thema ist für mich tabu", "{o} bleibe ich die Antwort schuldig", "die Frage lasse ich unbeantwortet", "{o} möchte ich nicht sprechen", "{o} kann ich leider nichts sagen", "da kann ich nicht weiterhelfen", "dafür bin ich nicht zuständig", "{o} gehe ich nicht ein",
    ],
    "fr": [
        "cela sort de mon rôle", "ce sujet dépasse mon cadre", "je dois refuser", "je dois décliner", "je décline cette demande", "aucune réponse n'est possible", "aucun conseil ne peut être donné {o}", "mes règles m'interdisent de {v}", "mes consignes ne me permettent pas de {v}", "je laisse cette question sans réponse", "ce n'est pas à moi de {v}",
        "c'est un sujet que je n'aborde pas", "cette demande est hors de mes attributions", "je n'ai pas à {v} {o}", "je ne traite pas ce genre de demande", "je ne donnerai pas de réponse", "ce thème m'est interdit",
    ],
    "fa": [
        "این موضوع خارج از حیطه‌ی کار من است", "پاسخ {o} از وظیفه‌ی من بیرون است", "این موضوع برای من ممنوع است", "باید این درخواست را رد کنم", "این پرسش را بی‌پاسخ می‌گذارم", "ناچارم جواب ندهم", "قوانین من اجازه‌ی پاسخ نمی‌دهد", "{o} جواب نمی‌دهم", "{o} پاسخی ندارم که مجاز به گفتنش باشم", "از پاسخ {o} معذورم", "{o} کمکی از من ساخته نیست", "درباره‌ی این چیزها صحبت نمی‌کنم", "دستورهایم جلوی پاسخ را می‌گیرد", "وارد این موضوع نمی‌شوم", "جواب این سؤال را نخواهم داد", "راهنمایی {o} ممکن نیست", "پاسخ من منفی است و کمکی نمی‌کنم",
    ],
}
#: What is not given, and how that is put; {n} is one of the words.
_NOTHING = {
    "en": (["answer", "advice", "help", "guidance", "comment", "opinion", "information", "reply", "support"], ["no {n} can be given", "no {n} can be offered here", "no {n} is available from me", "I have no {n} for you on {o}", "I offer no {n} on {o}", "{n} is not possible", "I am not the one for {n}", "I withhold my {n}", "you will get no {n} from me", "my {n} is not permitted", "there is no {n} I may give", "giving {n} on {o} is not allowed", "I abstain from any {n}"]),
    "de": (["Antwort", "Auskunft", "Beratung", "Hilfe", "Stellungnahme", "Empfehlung", "Meinung", "Angabe"], ["keine {n} ist möglich", "hier ist keine {n} möglich", "eine {n} {o} ist nicht möglich", "{o} gibt es von mir keine {n}", "ich gebe keine {n}", "meine {n} bleibt aus", "{n} ist mir untersagt", "ich verweigere die {n}", "auf eine {n} muss ich verzichten", "es gibt keine {n}, die ich geben darf"]),
    "fr": (["réponse", "conseil", "avis", "aide", "commentaire", "information", "opinion"], ["aucune {n} n'est possible", "aucun {n} ne peut être donné", "je ne donne pas de {n}", "pas de {n} {o}", "je n'ai pas de {n} à offrir", "toute {n} m'est interdite", "il n'y a pas de {n} que je puisse donner", "je refuse toute {n}", "je m'abstiens de tout {n}"]),
    "fa": (["پاسخ", "جواب", "راهنمایی", "نظر", "اظهار نظر", "کمک", "مشاوره", "توضیح"], ["از {n} معذورم", "از {n} دادن معذورم", "{n} ممکن نیست", "{n} نمی‌دهم", "{n} نخواهم داد", "هیچ {n}ی نمی‌توانم بدهم", "{n}ی از من برنمی‌آید", "برای {o} {n}ی ندارم", "{n} در توان من نیست", "اجازه‌ی {n} ندارم", "{n} خارج از اختیار من است", "به {o} {n} نمی‌دهم", "{n} مجاز نیست", "{n}ی که بتوانم بدهم وجود ندارد"]),
}
_AROUND = {
    "en": (["", "", "", "I'm sorry, but", "Sorry,", "Unfortunately,", "Thanks for asking, however", "As an assistant,", "As an AI,", "With respect,", "Regrettably,", "I have to tell you that", "as a program I must say"], ["", "", "", "for safety reasons", "because of my rules", "as an assistant", "here", "at the moment", "in this chat"]),
    "de": (["", "", "Es tut mir leid,", "Leider", "Danke für die Frage, aber", "Als Assistent", "Bedaure,", "ich muss dir sagen,"], ["", "", "aus Sicherheitsgründen", "wegen meiner Vorgaben", "hier", "als Assistent"]),
    "fr": (["", "", "Désolé,", "Je suis navré, mais", "Malheureusement,", "Merci, mais", "En tant qu'assistant,", "je dois vous dire que"], ["", "", "pour des raisons de sécurité", "à cause de mes règles", "ici", "comme assistant"]),
    "fa": (["", "", "متأسفم، ولی", "متأسفانه", "ببخشید،", "ممنون از سؤالت، اما", "به عنوان دستیار", "باید بگویم که"], ["", "", "به دلیل قوانین ایمنی", "اینجا", "در این گفتگو"]),
}
#: Look-alikes: the same words about other people and other things, offers, and plain advice.
_OTHER = {
    "en": [
        "you can't help everyone", "you cannot answer every letter", "you don't have to answer that today", "nobody can help with everything", "I am able to help you with your list", "I am glad to answer this", "I can't see your face but I hear you", "I won't pretend that it is easy", "I cannot feel it for you", "I'd rather not rush you", "I'd rather not hurry, take your time", "I will not forget what you wrote", "I am sorry to hear that",
        "I'm sorry this week was so hard", "it is not possible to do it all at once", "say no when you can't", "tell your boss that you cannot come in early", "it is fine to decline an invitation", "you may refuse a call", "your body refuses to rest", "some questions stay unanswered for a while", "no one is allowed to shout at you", "the doctor can give advice on this", "ask for guidance at the clinic", "a short note to a friend may help",
        "breathe out slowly and count", "put the phone away before bed", "write one line about today", "you are not able to sleep and that wears you down", "you can't discuss it with them yet", "I can't tell you how glad I am", "I don't want to add to your load", "small steps are allowed", "that sounds heavy", "thank you for writing", "it is not your fault", "talk about it with someone you trust", "you'd rather not go out and that is okay", "we can look at this again",
    ],
    "de": [
        "du kannst nicht allen helfen", "du musst nicht auf alles antworten", "ich kann dir dabei helfen", "dazu kann ich etwas sagen", "ich kann dein Gesicht nicht sehen", "ich werde nicht so tun, als sei es leicht", "das tut mir leid für dich", "es tut mir leid, dass die Woche so schwer war", "nicht alles ist auf einmal möglich", "lehne eine Einladung ruhig ab", "du darfst nein sagen", "niemand darf dich anschreien",
        "sag deinem Chef, dass du nicht kannst", "eine Antwort hat Zeit bis morgen", "sprich mit jemandem darüber", "der Arzt kann dich beraten", "leg das Handy weg", "atme langsam aus", "schreib einen Satz auf", "der Körper lehnt sich auf", "ein kleiner Schritt reicht", "das klingt schwer", "danke für deine Nachricht", "du kannst gerade nicht schlafen", "ich möchte dich nicht drängen", "das ist nicht deine Schuld", "geh vor die Tür",
    ],
    "fr": [
        "tu ne peux pas aider tout le monde", "tu n'as pas à répondre à tout", "je peux t'aider avec ça", "je peux répondre à cette question", "je ne peux pas voir ton visage", "je ne vais pas prétendre que c'est facile", "je suis désolé que ce soit si dur", "tout n'est pas possible d'un coup", "refuse une invitation si tu veux", "tu as le droit de dire non", "personne n'a le droit de crier", "dis à ton chef que tu ne peux pas",
        "une réponse peut attendre demain", "parle à quelqu'un de confiance", "le médecin peut te conseiller", "pose le téléphone", "expire lentement", "écris une phrase", "un petit pas suffit", "ça a l'air lourd", "merci de ton message", "tu ne dors pas et cela t'use", "je ne veux pas te presser", "ce n'est pas ta faute", "sors un moment", "je ne peux pas le sentir à ta place",
    ],
    "fa": [
        "نمی‌توانی به همه کمک کنی", "لازم نیست به همه چیز جواب بدهی", "می‌توانم در این مورد کمک کنم", "می‌توانم پاسخ بدهم", "صورتت را نمی‌بینم", "نمی‌توانم جای تو باشم", "وانمود نمی‌کنم آسان است", "متأسفم که این هفته سخت بود", "همه چیز یک‌باره ممکن نیست", "دعوت را رد کن اگر خسته‌ای", "حق داری نه بگویی", "کسی حق ندارد سرت داد بزند", "به رئیست بگو نمی‌توانی",
        "جواب دادن تا فردا صبر می‌کند", "با کسی که به او اعتماد داری حرف بزن", "پزشک راهنمایی می‌کند", "گوشی را کنار بگذار", "آرام نفس بکش", "یک خط بنویس", "یک قدم کوچک بس است", "سنگین به نظر می‌رسد", "ممنون که نوشتی", "نمی‌خوابی و خسته‌ای", "نمی‌خواهم عجله کنی", "تقصیر تو نیست", "بیرون برو", "خوشحالم که نوشتی", "اجازه بده آرام شوی",
    ],
}


def made(seed: int, n: int) -> tuple[list[str], np.ndarray]:
    """Invented sentences and whether each declines."""
    r = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        lang = r.choice(list(_CANNOT))
        before, after = _AROUND[lang]
        declines = r.random() < 0.65
        if declines:
            verb, matter = r.choice(_VERB[lang]), r.choice(_MATTER[lang])
            form = r.random()
            if form < 0.3:
                nouns, frames = _NOTHING[lang]
                body = r.choice(frames).replace("{n}", r.choice(nouns)).replace("{o}", matter)
            elif form < 0.7:
                cannot = r.choice(_CANNOT[lang])
                body = f"{cannot} {verb} {matter}" if lang in ("en", "fr") else f"{matter} {cannot} {verb}" if lang == "fa" and r.random() < 0.6 else f"{cannot} {matter} {verb}"
            else:
                body = r.choice(_FRAMES[lang]).replace("{v}", verb).replace("{o}", matter)
            text = " ".join(x for x in (r.choice(before), body, r.choice(after)) if x) if r.random() < 0.5 else body
        else:
            body = r.choice(_OTHER[lang])
            text = " ".join(x for x in (r.choice(["", "", *before]), body, r.choice(["", "", "", *after]) if r.random() < 0.3 else "") if x)
            if r.random() < 0.3:
                text += r.choice([", ", " – ", " "]) + r.choice(_OTHER[lang])
        if r.random() < 0.25 and len(texts) > 10:
            # words of both kinds in no order: single words decide little
            mixed = [*r.sample(text.split(), min(4, len(text.split()))), *r.choice(_OTHER[lang]).split()]
            r.shuffle(mixed)
            text, declines = " ".join(mixed), False
        texts.append(text)
        labels.append(declines)
    return texts, np.array(labels)


def plain_clauses(texts: DataFrame, text: str) -> tuple[str, ...]:
    """Clauses of a bounded sample of texts that decline nothing."""
    chosen = texts.select(F.col(text).alias("text")).where("text IS NOT NULL").orderBy(F.xxhash64("text"), "text").limit(PLAIN_TEXTS)
    parts = chosen.select(F.explode(F.split("text", r"[.!?؟;؛:\n,،–—()]")).alias("part")).select(F.trim("part").alias("part")).where("length(part) BETWEEN 4 AND 300")
    return tuple(r["part"] for r in parts.orderBy(F.xxhash64("part"), "part").limit(PLAIN_CLAUSES).collect())


def _slots(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of each n-gram of up to three words (one of them may be skipped), the place where it starts, and its sentence's number."""
    starts, ends, h = word_hashes(points, offsets)
    edge = np.zeros(len(points) + 1, bool)
    edge[offsets] = True
    edge[:-1] |= np.isin(points, _ENDS)
    number = np.cumsum(edge)[starts] if len(starts) else np.zeros(0, np.int64)
    slots, places, sentences = [], [], []
    with np.errstate(over="ignore"):
        for k, order in enumerate(((0,), (0, 1), (0, 1, 2), (0, 2))):
            far = order[-1]
            n = max(0, len(h) - far)
            whole = number[:n] == number[far:]
            mixed = np.full(n, np.uint64(k + 1))
            for step in order:
                mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ h[step : n + step]
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            slots.append((mixed >> np.uint64(64 - _BITS)).astype(np.int64)[whole])
            places.append(starts[:n][whole])
            sentences.append(number[:n][whole])
    return np.concatenate(slots), np.concatenate(places), np.concatenate(sentences)


@functools.cache
def model(plain: tuple[str, ...] = (), seed: int = 11, sentences: int = 30_000, rounds: int = 200) -> np.ndarray:
    """Weights of the slots and, last, the bias: logistic regression with a ridge.

    ``plain`` are sentences that decline nothing, from texts that are no answers.
    """
    texts, labels = made(seed, sentences)
    texts, labels = [*texts, *plain], np.r_[labels, np.zeros(len(plain), bool)]
    points, offsets = cp.decode(pa.array(texts))
    slots, places, _ = _slots(points, offsets)
    row = np.searchsorted(offsets, places, "right") - 1
    w, bias, speed = np.zeros(1 << _BITS), 0.0, np.full(1 << _BITS, 1e-3)
    count = np.bincount(row, minlength=len(texts)).clip(1)
    share = 1 / np.sqrt(count)
    for _ in range(rounds):
        score = np.bincount(row, w[slots], len(texts)) * share + bias
        error = 1 / (1 + np.exp(-score)) - labels
        grad = np.bincount(slots, (error * share)[row], 1 << _BITS) + 0.02 * w
        speed += grad * grad
        w -= 0.5 * grad / np.sqrt(speed)
        bias -= 2.0 * error.mean()
    return np.r_[w, bias]


def refuses(texts: pa.Array, w: np.ndarray) -> np.ndarray:
    """Whether any sentence of each text declines to answer; null and empty texts do not."""
    out: list[np.ndarray] = []
    for block in cp.blocks(texts):
        points, offsets = cp.decode(block)
        slots, places, sentence = _slots(points, offsets)
        found = np.zeros(len(block), bool)
        if len(slots):
            n = int(sentence.max()) + 1
            count = np.bincount(sentence, minlength=n).clip(1)
            score = np.bincount(sentence, w[slots], n) / np.sqrt(count) + w[-1]
            # a clause of k words has 4 k - 5 n-grams
            score[count < 4 * MIN_WORDS - 5] = -np.inf
            row = np.searchsorted(offsets, places[score[sentence] > MIN_SCORE], "right") - 1
            found[row] = True
        out.append(found)
    return np.concatenate(out) if out else np.zeros(0, bool)


def scores(sentences: Sequence[str], w: np.ndarray) -> np.ndarray:
    """Log-odds of single sentences."""
    points, offsets = cp.decode(pa.array(sentences, pa.string()))
    slots, places, _ = _slots(points, offsets)
    row = np.searchsorted(offsets, places, "right") - 1
    return np.bincount(row, w[slots], len(sentences)) / np.sqrt(np.bincount(row, minlength=len(sentences)).clip(1)) + w[-1]
