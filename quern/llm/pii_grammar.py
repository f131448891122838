"""Invented sentences with marked personal information, from which the trees of pii.py are trained.

Everything is put together by rule: pieces follow the public formats of their type (number plans,
identity documents, postal addresses), names and streets are syllables, and the words around a piece
are drawn from general vocabularies of four languages. Look-alikes that are not personal
(references, amounts, versions, products, places) come by the same rules.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

#: Digits as words.
SPELLED = (
    "zero|oh|one|two|three|four|five|six|seven|eight|nine|"
    "null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|"
    "zéro|un|deux|trois|quatre|cinq|sept|huit|neuf|"
    "صفر|یک|دو|سه|چهار|پنج|شش|هفت|هشت|نه"
)
#: Parts of syllables: so many combine that two invented words are hardly ever the same.
_SYLLABLE = ("b c d f g h k l m n p r s t v w y z br ch gr kr sh st th tr".split(), "a e i o u ai ei ie ou ö ü é".split(), ["", "", "n", "r", "l", "s", "m", "t", "ck", "ll", "nd", "rt"])
_PERSIAN_SYLLABLE = (list("بپتجچحخدرزسشصطفقکگلمنه"), ["ا", "و", "ی", "", ""], ["", "", "ر", "ن", "د", "م", "ل", "ب", "ش"])
_ASCII = str.maketrans("öüé", "oue")
LANGUAGES = ("en", "de", "fr", "fa")

_STREETS = {
    "en": ["Street", "Road", "Lane", "Avenue", "Row", "Grove", "Hill", "Way", "Gardens", "Close", "Court", "Crescent", "Mews", "Terrace", "Drive", "Park", "Boulevard", "St", "Rd", "Ave"],
    "de": ["straße", "strasse", "str.", "str", "weg", "gasse", "platz", "allee", "ufer", "damm", "ring", "steig"],
    "fr": ["rue", "avenue", "boulevard", "impasse", "place", "allée", "chemin", "quai", "cours", "passage"],
    "fa": ["خیابان", "بلوار", "میدان", "کوچه", "بزرگراه", "بن‌بست"],
}
_TITLES = {"en": ["Mr", "Mrs", "Ms", "Dr", "Prof", "Mr.", "Dr."], "de": ["Herr", "Frau", "Dr.", "Prof."], "fr": ["M.", "Mme", "Mlle", "Monsieur", "Madame", "Dr"], "fa": ["آقای", "خانم", "دکتر", "مهندس"]}
_OPENERS = {
    "en": ["", "", "", "Please note:", "As agreed,", "For the form:", "By the way,", "Okay then,", "Yesterday", "Then", "When", "Now"],
    "de": ["", "", "", "Zur Info:", "Wie besprochen,", "Für das Formular:", "Übrigens,", "Gestern", "Dann", "Wenn"],
    "fr": ["", "", "", "Pour info :", "Comme convenu,", "Pour le formulaire :", "Au fait,", "Hier", "Puis", "Quand"],
    "fa": ["", "", "", "دیروز", "بعد", "وقتی", "برای اطلاع:", "طبق قرار،", "برای فرم:", "راستی،"],
}
_CLOSERS = {
    "en": ["", ".", ".", ", thanks", " if needed.", ", as before.", "!", " (new)"],
    "de": ["", ".", ".", ", danke", " bei Bedarf.", ", wie gehabt.", "!"],
    "fr": ["", ".", ".", ", merci", " au besoin.", ", comme avant.", " !"],
    "fa": ["", ".", ".", "، ممنون", " در صورت نیاز.", " است.", "!"],
}
#: What leads up to a piece of each type. "|" parts what comes before from what comes after.
_LEADS = {
    "EMAIL": {
        "en": ["My e-mail address:", "email:", "Contact", "you may email", "forward everything to", "my inbox is|every day", "e-mail|whenever it suits"],
        "de": ["Meine E-Mail-Adresse lautet", "E-Mail:", "Kontakt:", "leite alles weiter an", "Mails bitte an|senden"],
        "fr": ["Mon adresse électronique est", "courriel :", "Contact :", "transférez tout à", "un mail à|suffit"],
        "fa": ["رایانامه‌ی من", "ایمیل:", "پیام را بفرست به", "نامه‌ها را به|ارسال کن"],
    },
    "PHONE": {
        "en": ["Mobile:", "phone no.", "tel.", "tel", "you can ring", "my cell is", "text", "dial|after six", "the landline is", "WhatsApp", "reachable by phone:", "her number was|back then", "the nurse called from"],
        "de": ["Handynummer:", "Telefon", "Tel.:", "Mobil", "wählen Sie|nach sechs", "unter|bin ich erreichbar", "Festnetz:", "Rückruf unter", "meine Nummer lautet"],
        "fr": ["Portable :", "téléphone :", "tél. fixe", "composez le", "joignable au", "mon numéro est le", "ligne fixe :", "rappelez-moi au|ce soir"],
        "fa": ["شماره همراه:", "موبایل من", "تلفن ثابت", "زنگ بزنید به", "شماره تلفنم", "تماس:", "تلفن", "خط|روشن می‌ماند"],
    },
    "ID_NUMBER": {
        "en": ["Passport number", "SSN:", "national insurance", "identity card", "tax id", "social security no.", "my ID is", "driving licence", "the clerk copied my passport,|, again", "identity number|was asked for"],
        "de": ["Reisepass Nr.", "Personalausweis:", "Steuer-ID", "Rentenversicherungsnummer", "Sozialversicherung:", "mein Ausweis hat die Nummer", "Führerschein Nr."],
        "fr": ["Numéro de passeport", "sécurité sociale :", "carte d'identité", "mon identifiant fiscal,|, est noté", "n° de sécu", "permis de conduire"],
        "fa": ["شماره ملی:", "گذرنامه به شماره", "شماره شناسنامه", "بیمه تامین اجتماعی", "کد ملی", "کارت شناسایی"],
    },
    "ADDRESS": {
        "en": ["Home address:", "we moved to", "deliver it to", "my flat is", "the house is", "I used to live at", "outside|in spring", "the parcel for|came back", "post it to", "our place,|, is cold"],
        "de": ["Anschrift:", "wir sind umgezogen in", "Lieferung an", "unsere Wohnung:", "gemeldet in der", "das Paket für|kam zurück", "ich wohnte früher"],
        "fr": ["Adresse postale :", "nous avons déménagé au", "livrez au", "notre appartement :", "domicilié au", "le colis pour|a été retourné", "j'habitais"],
        "fa": ["آدرس:", "خانه‌ی ما در", "آدرس منزل", "اسباب‌کشی کردیم به", "محل سکونت:", "بسته‌ی|برگشت خورد"],
    },
    "NAME": {
        "en": ["This is|speaking", "Kind regards,", "Best wishes,", "dear", "my doctor,|, agreed", "|called me yesterday", "I met|at work", "my neighbour|helps a lot", "my cousin|told me to rest", "|thinks I should rest", "I talked to|yesterday", "thanks to|I slept", "my full name is", "I'm", "I was visited by|on Sunday", "|and I work together", "the manager,|, wrote back"],
        "de": ["Hier spricht", "Liebe Grüße,", "Viele Grüße,", "Liebe", "ich traf|bei der Arbeit", "meine Nachbarin|hilft mir", "|hat mir geholfen", "|sagte das auch", "mein voller Name ist", "mit|habe ich gesprochen", "mein Cousin|und ich", "unser Leiter,|, schrieb zurück"],
        "fr": ["Ici|au téléphone", "Bien à vous,", "Amicalement,", "Cher", "j'ai vu|au travail", "ma voisine|m'aide", "|pense que je dois dormir", "mon cousin|et moi", "mon nom complet est", "selon|, ça passera", "notre chef,|, a répondu"],
        "fa": ["سلام،|صحبت می‌کند", "با احترام،", "با تشکر،", "همسایه‌ام|کمک کرد", "برادرم|گفت استراحت کن", "نام کامل من|است", "دیروز|زنگ زد", "من|هستم", "با|حرف زدم", "اسم من|است", "به گفته‌ی|خوب می‌شود"],
    },
}
#: What a person does in a sentence, and who a person is.
_DOES = {
    "en": ["said no", "says it is normal", "told me to wait", "called twice", "wrote back", "asked me again", "came by", "left early", "never replied", "knows the way", "moved away", "was there too", "sat with us", "is ill"],
    "de": ["sagte nein", "meinte das auch", "rief zweimal an", "schrieb zurück", "kam vorbei", "ging früh", "ist krank", "war auch da", "wartet noch", "kennt den Weg"],
    "fr": ["a dit non", "m'a dit d'attendre", "a appelé deux fois", "a répondu", "est passé", "est partie tôt", "est malade", "était là aussi", "attend encore"],
    "fa": ["گفت نه", "گفت طبیعی است", "دوباره زنگ زد", "جواب داد", "سر زد", "زود رفت", "مریض است", "هم آنجا بود", "منتظر است"],
}
_WHO = {
    "en": ["my brother", "my friend", "our teacher", "the nurse", "my therapist", "a colleague named", "my aunt", "the landlord", "with", "and", "for", "from", "when", "because", "after", "until", "about"],
    "de": ["mein Bruder", "meine Freundin", "unser Lehrer", "die Schwester", "mein Therapeut", "eine Kollegin namens", "mit", "und", "für", "von", "wenn", "weil", "seit", "bis"],
    "fr": ["mon ami", "ma tante", "notre professeur", "l'infirmière", "ma thérapeute", "une collègue nommée", "avec", "et", "pour", "de", "quand", "parce que", "depuis que", "chez"],
    "fa": ["دوستم", "خاله‌ام", "معلممان", "پرستار", "همکارم", "با", "و", "برای", "از", "وقتی", "چون", "تا"],
}
#: Words that state that a number is no one's own.
_SERVICE = {
    "en": ["invoice", "batch", "serial no.", "order", "tracking code", "case", "ticket", "ref.", "booking", "file no.", "request", "registration", "re: claim", "item"],
    "de": ["Rechnung", "Charge", "Seriennummer", "Bestellung", "Sendungsnummer", "Aktenzeichen", "Vorgang", "Ticket", "Buchung", "Fall", "Akte", "Anmeldung"],
    "fr": ["facture", "lot", "numéro de série", "commande", "suivi", "dossier", "ticket", "réservation", "cas", "demande", "réf.", "inscription"],
    "fa": ["فاکتور", "شماره سریال", "سفارش", "کد رهگیری", "پرونده", "تیکت", "رزرو", "درخواست", "کد پیگیری", "ثبت"],
}
_MEASURES = {
    "en": ["the gauge shows", "counter at", "meter:", "it cost", "a budget of", "population", "balance", "views:", "my score is", "version", "dated", "between the hours"],
    "de": ["der Zähler zeigt", "Stand", "gekostet hat es", "ein Etat von", "Einwohner", "Punktzahl", "Version", "vom", "Zählerstand", "Aufrufe:"],
    "fr": ["le compteur indique", "relevé :", "cela coûte", "un budget de", "habitants :", "mon score est", "version", "daté du", "vues :"],
    "fa": ["کنتور", "هزینه‌اش", "بودجه‌ی", "جمعیت", "نمره‌ام", "نسخه‌ی", "به تاریخ", "بازدید:"],
}
_UNITS = {"en": ["a month", "dollars", "kWh", "points", "euros", "people"], "de": ["im Monat", "Euro", "kWh", "Punkte", "Leute"], "fr": ["par mois", "euros", "kWh", "points", "personnes"], "fa": ["تومان", "ریال", "در ماه", "نفر", "امتیاز"]}
#: Counted things, some with words that also stand in addresses.
_COUNTED = {
    "en": ["wins in a row", "miles of road", "houses down the lane", "laps around the park", "minutes to the court", "steps up the hill", "weeks on my way", "cups in the garden", "days close together", "people at the square"],
    "de": ["Minuten zu Fuß den Weg", "Runden um den Platz", "Häuser in der Straße", "Tage am Ufer", "Schritte die Gasse hinauf", "Stunden im Park"],
    "fr": ["fois dans la rue", "places assises", "jours de cours", "tours du quai", "minutes de chemin", "pas dans le passage"],
    "fa": ["بار در خیابان", "دقیقه تا میدان", "خانه آن طرف کوچه", "روز در بزرگراه", "قدم تا بلوار"],
}
#: Frames for capitalized words that name no person.
_NO_PERSON = {
    "en": ["the {} app keeps crashing", "our {} group", "we drove to {}", "{} is a quiet town", "I listened to {} on the radio", "a course called {}", "in {} it rained", "the {} team", "the {} Council", "{} Hospital", "{} Bank", "the National {} number", "a letter from {} University", "living in {}", "the road to {} was shut", "we left {} in May"],
    "de": ["die App {} stürzt ab", "unsere Gruppe {}", "wir fuhren nach {}", "{} ist ein ruhiger Ort", "der Kurs {}", "in {} regnete es", "seit {}", "aus {}", "das {}", "die {}", "das Amt {}", "die {} Klinik", "die Universität {}"],
    "fr": ["l'appli {} plante", "notre groupe {}", "nous sommes allés à {}", "{} est une ville calme", "le cours {}", "à {} il pleuvait", "depuis {}", "le {}", "la Caisse {}", "l'hôpital {}", "l'université {}"],
    "fa": ["برنامه‌ی {} هنگ می‌کند", "گروه ما {}", "رفتیم {}", "{} شهر آرامی است", "در {} باران آمد", "از {} آمدیم"],
}
_SMALL_TALK = {
    "en": ["it has been a long week", "nobody asks how I am", "mornings are hard", "tea helps a little", "the clinic is closed", "on Monday I rest", "this is fine", "i am tired again", "Hello there", "the doctor says so", "Mrs next door sings"],
    "de": ["es war eine lange Woche", "Guten Morgen", "niemand fragt nach mir", "Tee hilft etwas", "am Montag ruhe ich", "der Arzt sagt das auch", "ich bin müde", "Frau sein ist schwer", "die Arbeit und die Kinder"],
    "fr": ["la semaine a été longue", "personne ne demande", "le thé aide un peu", "lundi je me repose", "je suis fatigué", "le médecin le dit aussi", "Bonjour à tous"],
    "fa": ["هفته‌ی درازی بود", "کسی حالم را نمی‌پرسد", "چای کمی کمک می‌کند", "دوشنبه استراحت می‌کنم", "من خسته هستم", "دکتر هم همین را گفت", "خانم همکارم خندید"],
}


class Grammar:
    """Sentences with marked spans, the same for the same seed."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        #: Name words used in sentences; some names stay unknown, as in any corpus.
        self.words: set[str] = set()

    def pick(self, options: Sequence[str]) -> str:
        return self.r.choice(options)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def word(self, lang: str) -> str:
        parts = _PERSIAN_SYLLABLE if lang == "fa" else _SYLLABLE
        made = "".join(self.pick(part) for _ in range(self.r.randint(2, 3)) for part in parts)
        return made if lang == "fa" else made.title()

    def digits(self, n: int, first: str = "0123456789") -> str:
        return self.pick(first) + "".join(self.pick("0123456789") for _ in range(n - 1))

    def grouped(self, number: str, sizes: Sequence[int], sep: str) -> str:
        out, at = [], 0
        for n in sizes:
            out.append(number[at : at + n])
            at += n
        return sep.join(x for x in [*out, number[at:]] if x)

    # --- pieces -----------------------------------------------------------------------------------

    def email(self, lang: str) -> str:
        a, b = (self.word("en").lower().translate(_ASCII) for _ in range(2))
        local = self.pick([f"{a}.{b}", f"{a}_{b}", f"{a}-{b}", f"{a}+{b[:3]}", f"{a[0]}{b}", f"{b}{self.r.randint(1, 1999)}", a])
        host = ".".join([*self.pick([[], [], ["mail"], ["post"]]), self.word("en").lower().translate(_ASCII), self.pick(["com", "net", "org", "invalid", "test", "co.uk", "de", "fr", "ir"])])
        at = self.pick(["@", "@", "@", "@", " @ ", "(at)", "[at]", " (at) ", " [at] ", " at "])
        dot = {"[at]": "[dot]", " [at] ": " [dot] ", " at ": " dot ", " (at) ": " (dot) "}.get(at, ".") if self.chance(0.7) or at == " at " else "."
        return local + at + host.replace(".", dot)

    def phone(self, lang: str) -> str:
        if self.chance(0.12):
            k = {"en": 0, "de": 10, "fr": 20, "fa": 29}[lang]
            words = SPELLED.split("|")[k : k + 9]
            return self.pick([" ", " ", "-"]).join(self.pick(words) for _ in range(self.r.randint(7, 12)))
        sep = self.pick([" ", " ", "-", ".", "", " - " if self.chance(0.3) else "-"])
        form = self.r.randint(0, 6)
        if form == 0:  # international
            head = self.pick(["+", "+", "00"]) + self.pick(["1", "33", "44", "49", "98", "34", "47", "351", "43", "41"])
            body = self.digits(self.r.randint(9, 10), "123456789")
            return head + (sep or self.pick(["", " "])) + self.grouped(body, self.pick([[2, 2, 2, 2], [3, 3], [1, 2, 2, 2], [4], [3, 4], [2, 4]]), sep)
        if form == 1:  # area code in brackets
            area = self.pick([self.digits(3, "23456789"), "0" + self.digits(self.r.randint(2, 4), "123456789")])
            rest = self.digits(self.r.randint(6, 8))
            return f"({area}){self.pick([' ', ' ', ''])}" + self.grouped(rest, self.pick([[3], [4], [2, 2], [5]]), self.pick([" ", "-"]))
        if form == 2:  # area code and line, with a stroke
            return f"0{self.digits(self.r.randint(2, 4), '123456789')}{self.pick(['/', ' / ', '-'])}" + self.grouped(self.digits(self.r.randint(6, 8)), self.pick([[], [3], [5]]), self.pick([" ", "-"]))
        if form == 3:  # seven digits
            return self.grouped(self.digits(7, "23456789"), [3], self.pick(["-", "-", ".", " "]))
        if form == 4:  # ten digits in threes
            return self.pick(["", "", "1" + (sep or "-")]) + self.grouped(self.digits(10, "23456789"), [3, 3], sep or "-")
        if form == 5:  # pairs
            return self.grouped("0" + self.digits(9, "123456789"), [2, 2, 2, 2], sep)
        return self.grouped("0" + self.digits(self.r.randint(9, 10), "1234567899"), self.pick([[4, 3], [5], [3, 4], [4, 6]]), sep)

    def number(self, lang: str) -> str:
        d = self.digits
        letter = lambda: self.pick("ABCDEFGHJKLMNPRSTUVWXYZ")
        mixed = lambda n: "".join(letter() if self.chance(0.3) else self.pick("0123456789") for _ in range(n))
        made = [
            lambda: f"{d(3, '12345678')}-{d(2)}-{d(4)}",
            lambda: d(9, "123456789"),
            lambda: f"{d(3)}-{d(6)}-{d(1)}",
            lambda: d(10, "0123456789"),
            lambda: d(11, "123456789"),
            lambda: letter() + d(self.r.randint(7, 8)),
            lambda: letter() + letter() + d(7),
            lambda: letter() + d(2) + mixed(6),
            lambda: letter() + d(1) + letter() + d(2) + letter() + d(2) + self.pick([letter(), d(1)]),
            lambda: self.pick([" ", " ", ""]).join([letter() + letter(), d(2), d(2), d(2), self.pick("ABCD")]),
            lambda: self.pick([" ", " ", ""]).join([self.pick("12"), d(2), d(2, "01"), d(2), d(3), d(3), d(2)]),
            lambda: self.pick([" ", " ", ""]).join([d(2), d(6), letter(), d(3)]),
            lambda: d(8) + self.pick(["", "-"]) + letter(),
            lambda: f"{d(6)}{self.pick([' ', '-'])}{d(self.r.randint(4, 5))}",
            lambda: f"{d(3)}.{d(3)}.{d(3)}-{d(2)}",
            lambda: f"{d(4)} {d(4)} {d(4)}",
            lambda: (self.word("en") * 2).upper()[:5] + d(6) + letter() + letter() + d(1) + letter() + letter(),
        ]
        return self.r.choice(made)()

    def address(self, lang: str) -> str:
        n = self.pick([self.digits(self.r.randint(1, 3), "123456789")] * 3 + [self.digits(2, "123456789") + self.pick("abc")])
        street, town = self.word(lang), self.word(lang)
        if lang in ("fr", "fa") and self.chance(0.35):
            street += " " + self.word(lang)
        if lang in ("en", "fr", "de") and self.chance(0.15):
            street, town = f"{street}-{self.word(lang)}", f"{town}-{self.word(lang)}"
        if lang == "en":
            road = f"{street}{self.pick(['', '', ' ' + self.word(lang)])} {self.pick(_STREETS['en'])}"
            code = self.pick(["", "", f" {self.pick('BLMSNE')}{self.digits(1)} {self.digits(1)}{self.pick('ABD')}{self.pick('ELQ')}", f", {self.pick(['TX', 'OH', 'NY'])} {self.digits(5)}"])
            tail = self.pick(["", f", {town}{code}", f", {town}{code}{self.pick([', second floor', ', rear door'])}" if self.chance(0.2) else ""])
            return self.pick([f"{n} {road}{tail}"] * 4 + [f"{road} {self.pick(['', 'no. ', 'number '])}{n}", f"{self.pick(['Flat', 'Apt', 'Unit'])} {self.digits(1, '123456789')}, {n} {road}{tail}", f"{n}, {road}{tail}"])
        if lang == "de":
            kind = self.pick(_STREETS["de"])
            road = self.pick([f"{street}{kind}"] * 3 + [f"{street}er {kind.title()}", f"Am {street}{kind}", f"An der {street}", f"Am {street}"])
            return f"{road} {n}{self.pick(['', '', f', {self.digits(5)} {town}', f' in {self.digits(5)} {town}', f', {town}'])}"
        if lang == "fr":
            return f"{n}{self.pick(['', '', ' bis', ' ter', ','])} {self.pick(_STREETS['fr'])} {self.pick(['', 'de la ', 'des ', 'du ', 'de '])}{street}{self.pick(['', '', ', ' + self.digits(5) + ' ' + town, ' à ' + town])}"
        plaque = self.pick(["پلاک", "شماره", "پ"])
        kind, inner = self.pick(_STREETS["fa"]), self.pick(["", f"، کوچه {self.word(lang)}", f" کوچه‌ی {self.digits(1, '123456789')}"])
        return self.pick([f"{kind} {street}{inner}{self.pick(['،', ''])} {plaque} {n}{self.pick(['', ' واحد ' + self.digits(1, '123456789')])}"] * 3 + [f"{kind} {street}، نبش {self.pick(['کوچه', 'خیابان'])} {n}", f"{kind} {street} {n}"])

    def name(self, lang: str) -> str:
        first, last, other = (self.word(lang) for _ in range(3))
        known = self.r.random()
        self.words |= {first.lower()} if known < 0.25 else {last.lower()} if known < 0.4 else {first.lower(), last.lower()} if known < 0.7 else set()
        title = self.pick(_TITLES[lang])
        if lang == "fa":
            return self.pick([f"{first} {last}"] * 3 + [f"{title} {last}", f"{title} {first} {last}"])
        long = [f"{first} {last}-{other}", f"{first} {other} {last}", f"{first} {other[0]}. {last}", f"{first[0]}. {last}", f"{first} {self.pick(['de', 'van', 'von', 'al', 'la'])} {last}"]
        whole = self.pick([f"{first} {last}"] * 5 + [f"{title} {last}"] * 2 + [f"{title} {first} {last}"] + long)
        return self.pick([whole] * 8 + [whole.lower(), whole.upper()])

    # --- sentences --------------------------------------------------------------------------------

    def counted(self, lang: str) -> str:
        """Counted things near a word that also stands in addresses."""
        thing = self.word(lang).lower()
        if lang == "en":
            if self.chance(0.25):
                return f"more {self.pick(['during', 'sharing', 'offering', 'hearing', 'exploring', 'ordering', 'scoring', 'a path of', 'a mile of'])} {self.digits(2, '123456789')} {thing}s"
            return f"{thing}s {self.pick(['in a', 'on the', 'down the', 'by the', 'of', 'up the', 'across the'])} {self.pick(_STREETS['en'][:17]).lower()}"
        if lang == "de":
            return f"{thing.title()} {self.pick(['am', 'auf dem', 'in der', 'über den'])} {self.pick(['Weg', 'Platz', 'Ufer', 'Ring', 'Straße', 'Gasse', 'Allee'])}"
        if lang == "fr":
            return f"{thing}s {self.pick(['dans la', 'sur la', 'au', 'le long du'])} {self.pick(_STREETS['fr'])}"
        return f"{thing} {self.pick(['در', 'تا', 'کنار'])} {self.pick(_STREETS['fa'])}"

    def plain(self, lang: str) -> str:
        """A sentence without personal information, often of the same format."""
        form = self.r.random()
        lower = lang == "fa" or self.chance(0.5)
        if form < 0.34:
            prefix = self.pick(["", "", "", "", "".join(self.pick("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(2)), "#", "№ "])
            n = prefix + self.pick([self.digits(self.r.randint(5, 12), "0123456789"), self.digits(9), f"{self.digits(4)}-{self.digits(4)}", f"{self.digits(3)}-{self.digits(5)}", f"{self.digits(2)}/{self.digits(6)}"])
            cue = self.pick(_SERVICE[lang])
            link = self.pick([" ", " ", ": ", " no. " if lang == "en" else " ", " is " if lang == "en" else " "])
            text = f"{cue}{link}{n}"
            if prefix == "" and self.chance(0.15):
                text += "#"
            text = self.pick([text] * 3 + [f"({text})", f"{n} ({cue})" if prefix else text])
        elif form < 0.52:
            n = self.pick([
                f"{self.digits(2)}.{self.digits(2)}.20{self.digits(2)}", f"20{self.digits(2)}-{self.digits(2)}-{self.digits(2)}", f"1{self.digits(3, '34')}/{self.digits(2)}/{self.digits(2)}", f"{self.digits(2)}/{self.digits(2)}/20{self.digits(2)}",
                f"{self.digits(1, '123456789')} 000 000", f"{self.digits(2, '123456789')} 000 000", f"{self.digits(3, '123456789')},{self.digits(3)}", f"{self.digits(2, '12')}:{self.digits(2, '012345')}", f"{self.digits(1)}.{self.digits(2)}.{self.digits(1)}", f"{self.digits(2)}/100",
                f"{self.digits(4)} {self.digits(4)} {self.digits(3)}", f"{self.digits(5)} {self.digits(3)}", self.digits(self.r.randint(5, 8)), f"{self.digits(3)}.{self.digits(3)}",
            ])
            text = self.pick([f"{self.pick(_MEASURES[lang])} {n}", f"{self.pick(_MEASURES[lang])} {n} {self.pick(_UNITS[lang])}", f"{n} {self.pick(_UNITS[lang])}"])
        elif form < 0.68:
            n = self.digits(self.r.randint(1, 3), "123456789")
            counted = self.pick([self.pick(_COUNTED[lang]), self.counted(lang), self.counted(lang)])
            text = self.pick([f"{n} {counted}", f"{self.pick(_SMALL_TALK[lang])}, {n} {counted}, {self.pick(_SMALL_TALK[lang])}", f"{self.pick(_SMALL_TALK[lang])} {n} {counted}"])
        elif form < 0.86:
            thing = self.pick([self.word("en"), f"{self.word('en')} {self.word('en')}", self.word(lang), f"{self.word('en')}{self.pick([' 2', ' v' + self.digits(1) + '.' + self.digits(1), ''])}"])
            text = self.pick(_NO_PERSON[lang]).replace("{}", thing)
            if self.chance(0.12):
                text = f"{text} @{self.word('en').lower()}_{self.word('en').lower()}"
        else:
            text = self.pick(_SMALL_TALK[lang])
        text = text if lower else text[:1].upper() + text[1:]
        text += self.pick(_CLOSERS[lang])
        return text.upper() if self.chance(0.04) else text

    def sentence(self, share_plain: float = 0.45) -> tuple[str, int, int, str]:
        """``text, start, end, type``; the type is empty for plain sentences."""
        lang = self.pick(LANGUAGES)
        if self.chance(share_plain):
            return self.plain(lang), 0, 0, ""
        kind = self.pick((*_LEADS, "NAME", "NAME", "ADDRESS"))
        made = {"EMAIL": self.email, "PHONE": self.phone, "ID_NUMBER": self.number, "ADDRESS": self.address, "NAME": self.name}[kind](lang)
        lead, _, tail = self.pick(_LEADS[kind][lang]).partition("|")
        if kind == "NAME" and self.chance(0.5):
            lead, tail = self.pick(["", self.pick(_WHO[lang])]), self.pick(["", self.pick(_DOES[lang]), self.pick(_DOES[lang])])
        bare = kind != "NAME" and self.chance(0.18)
        if bare:
            lead, tail = "", ""
        if kind == "ADDRESS" and lang == "fa" and self.chance(0.4):
            lead += f" {self.word('fa')}،"  # a town goes before its streets
        opener = self.pick(_OPENERS[lang])
        before = " ".join(x for x in (opener, lead) if x)
        if before and not self.chance(0.3):
            before = before[:1].upper() + before[1:]
        closer = tail if tail.startswith(",") else f" {tail}" if tail else self.pick(_CLOSERS[lang])
        opening, closing = ("(", ")") if bare and self.chance(0.4) else ("", "")
        text = f"{before}{' ' if before else ''}{opening}{made}{closing}{closer}"
        start = len(text) - len(closer) - len(closing) - len(made)
        form = self.r.random()
        if form < 0.05 and len(text.lower()) == len(text):
            text = text.lower()
        elif form < 0.09 and len(text.upper()) == len(text):
            text = text.upper()
        return text, start, start + len(made), kind
