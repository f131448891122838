"""Sentences written by hand, apart from the grammar that the trees learn from; {TYPE:...} marks a piece.

The first set was looked at while the model was made. The second was written later, but its score was seen
before the last changes. The third was scored once, when nothing was changed any more.
"""

#: Name words that a corpus may have taught; most names below are not among them.
WORDS = ["amelia", "thornbury", "farrokh", "کیانوش", "بهرامی"]

SENTENCES = [
    # mail
    "If the office is shut, drop a line to {EMAIL:j.okonkwo@brightmail.org} instead.",
    "Billing went to {EMAIL:accounts+spring@harbourview.co.uk} and bounced.",
    "I registered as {EMAIL:lena_fischer88@posteo.test} years ago.",
    "Please cc {EMAIL:omar(at)fieldnotes.net} on this.",
    "Reach the coach: {EMAIL:coach [at] northside [dot] org}",
    "Schick die Unterlagen an {EMAIL:b.yilmaz@rathaus-nord.de}, danke.",
    "Ma boîte {EMAIL:claire.dumont@laposte.test} est pleine.",
    "پاسخ را به {EMAIL:sara.moradi@nameh.ir} بفرستید.",
    "my account {EMAIL:tom-hale@quietriver.com} got locked",
    "Ihr findet mich unter {EMAIL:kontakt@werkstatt7.de} jederzeit.",
    # phone
    "After the shift I pick up on {PHONE:0161 496 0142}.",
    "My work line is {PHONE:+44 20 7946 0958}, ext. 4 does not work.",
    "the counsellor rang from {PHONE:(312) 555-0148} around noon",
    "Text {PHONE:646-555-0172} if the door is locked",
    "Mum's new mobile: {PHONE:07911 123456}",
    "Dad still has the old number, {PHONE:555-0137}.",
    "Mein Handy {PHONE:0176 5550 9981} liegt meistens im Flur.",
    "Die Praxis hat die Nummer {PHONE:0221 / 555 04 17}.",
    "Ruft bitte {PHONE:+49 151 55501234} an.",
    "Vous pouvez m'appeler au {PHONE:06 39 98 12 34} le soir.",
    "Le standard, {PHONE:01.99.00.45.67}, ne répond plus.",
    "Mon portable est le {PHONE:+33 7 55 50 11 22}.",
    "لطفاً با {PHONE:0912 555 4321} تماس بگیر.",
    "شماره موبایلم {PHONE:۰۹۳۵۵۵۵۰۱۲۳} است و شب‌ها جواب می‌دهم.",
    "تلفن خانه {PHONE:۰۲۱-۵۵۵۰۱۲۳۴} قطع شده.",
    "It is {PHONE:zero seven seven zero zero nine zero zero one two three}, said slowly.",
    # identity numbers
    "The bank wanted my passport, {ID_NUMBER:K48291057}, before lunch.",
    "SSN {ID_NUMBER:219-09-9999} is printed on the letter.",
    "My National Insurance number is {ID_NUMBER:QQ 12 34 56 C}.",
    "Driving licence {ID_NUMBER:MORGA657054SM9IJ} expires in June.",
    "my id number {ID_NUMBER:8204125009087} was typed wrong",
    "they scanned my identity card ({ID_NUMBER:L01X00T47})",
    "Meine Steuer-ID {ID_NUMBER:65929970489} fehlt im Formular.",
    "Sozialversicherungsnummer {ID_NUMBER:15 070649 C 103} steht auf dem Bescheid.",
    "Reisepassnummer: {ID_NUMBER:C01X0006H}",
    "Mon numéro de sécurité sociale est {ID_NUMBER:2 69 05 49 588 157 80}.",
    "Passeport n° {ID_NUMBER:14AA12345} perdu hier.",
    "کد ملی پدرم {ID_NUMBER:0076229645} است.",
    "شماره گذرنامه {ID_NUMBER:H95467231} را خواستند.",
    "کارت ملی با شماره {ID_NUMBER:۱۲۷-۴۵۶۷۸۹-۱} گم شد.",
    # addresses
    "The keys are at {ADDRESS:14 Elm Grove, Leeds}.",
    "We rent {ADDRESS:221b Marlow Street} since May.",
    "Send the forms to {ADDRESS:77 Old Mill Road, Bristol}.",
    "my gran lived at {ADDRESS:9 Sycamore Gardens} all her life",
    "Please leave it at {ADDRESS:Flat 6, 30 Castle Hill, Exeter}.",
    "The office moved to {ADDRESS:1600 Harrison Boulevard}.",
    "Wir wohnen {ADDRESS:Hauptstr 12, 50667 Köln}.",
    "Das Paket ging an {ADDRESS:Lindenallee 45}, nicht zu mir.",
    "Meine Adresse ist {ADDRESS:Am Mühlbach 3, 79098 Freiburg}.",
    "Mein Bruder wohnt in der {ADDRESS:Goethestraße 17a}.",
    "Ich hole es in der {ADDRESS:Kirchgasse 8} ab.",
    "J'habite au {ADDRESS:12 rue des Lilas, 69003 Lyon} avec ma sœur.",
    "Le cabinet est au {ADDRESS:8 bis avenue Victor Hugo}.",
    "Adresse : {ADDRESS:45 chemin du Moulin, 31500 Toulouse}",
    "آدرس ما {ADDRESS:خیابان ولیعصر، کوچه نسترن، پلاک 27} است.",
    "خانه‌ام در {ADDRESS:خیابان سعدی پلاک ۱۱ واحد ۳} است.",
    "بسته را به {ADDRESS:بلوار کشاورز، پلاک 210} ببرید.",
    # names
    "My name is {NAME:Siobhan Kavanagh} and I work nights.",
    "Yesterday {NAME:Priya Raghunathan-Bose} told me to write this down.",
    "I share the flat with {NAME:Halina Wojcik} these days.",
    "Regards, {NAME:Tobias Lindqvist}",
    "My therapist {NAME:Dr. Abernathy} says to breathe.",
    "When {NAME:Amelia Thornbury} left, the house went quiet.",
    "i spoke with {NAME:mr. adeyemi} at school",
    "Our neighbour {NAME:Mrs Delacroix-Hunt} brings soup.",
    "{NAME:Kwame Mensah} said it would pass.",
    "I met {NAME:J. R. Whitcombe} at the clinic.",
    "Ask for {NAME:Nadia Petrosyan}, please.",
    "Ich heiße {NAME:Jürgen Wittstock} und bin neu hier.",
    "{NAME:Frau Özdemir} hat mir sehr geholfen.",
    "Viele Grüße, {NAME:Anneliese Krautwald}",
    "Gestern rief {NAME:Herr Baumgartner} an.",
    "Je m'appelle {NAME:Thibault Lacroix}.",
    "Cordialement, {NAME:Solène Marchetti}",
    "{NAME:Mme Berthelot} m'a dit de venir.",
    "C'est mon voisin {NAME:Étienne Vasseur} qui conduit.",
    "اسم من {NAME:شیرین دلاوری} است.",
    "{NAME:آقای رستگار} گفت صبر کنم.",
    "با احترام، {NAME:نیلوفر صدیقی}",
    "دیشب {NAME:کیانوش بهرامی} زنگ زد.",
    "{NAME:دکتر یزدانی} نسخه نوشت.",
    # several
    "{NAME:Dr. Farrokh} moved; the new line is {PHONE:0131 496 0773}.",
    "Contact {EMAIL:h.novak@centrum.test} or {PHONE:+43 1 5550 1199}.",
    "Ich bin {NAME:Mareike Stollberg}, {ADDRESS:Rosenweg 5, 22303 Hamburg}.",
    # none
    "Invoice 2024118834 is still unpaid.",
    "The batch number 555-20391 was recalled.",
    "My order 48817-2203 shipped late.",
    "Ticket AB558120344 was closed without an answer.",
    "Case no. 778120456 has moved to another desk.",
    "Rechnung 100238845 ist bezahlt.",
    "Das Aktenzeichen lautet 304 551 982.",
    "Dossier n° 884120337 en attente.",
    "شماره پرونده ۷۷۴۱۲۰۹۸۳ را گم کردم.",
    "کد رهگیری 5540021897 نیامد.",
    "The electricity meter read 0042 8831 last month.",
    "We paid 14 000 000 for the roof.",
    "On 12.04.2023 at 18:45 it started again.",
    "1403/02/17 was the worst day.",
    "I got 71/100 and 68.5 the week before.",
    "Version 10.4.2 of the Quiet Hours app crashes.",
    "Our Tuesday circle @slow_mornings is full.",
    "I grew up in Millbrook and moved to New Harbour.",
    "I ran 12 laps around the park.",
    "It is a 40 minute walk down the lane.",
    "We have 3 beds on this ward.",
    "Ich laufe jeden Tag 5 Runden um den Platz.",
    "Seit Montag schlafe ich kaum.",
    "Die Gruppe Neuer Anfang trifft sich freitags.",
    "J'ai marché 20 minutes dans la rue.",
    "Le groupe Nouveau Souffle est ouvert à tous.",
    "Il y avait 200 places au concert.",
    "روزی 30 دقیقه در خیابان راه می‌روم.",
    "ساعت ۷ صبح بیدار شدم و چای خوردم.",
    "گروه صبح آرام هر هفته جمع می‌شود.",
    "the doctor says i am fine",
    "Ms or Miss, I never know what to tick.",
    "Sleep helps. Nothing Else Does.",
    "Nobody called for 14 days.",
    "I said no to 2 jobs and yes to one.",
]

FRESH = [
    "Forward the notes to {EMAIL:ruth.adler@meadowpost.net} when done.",
    "Notre association répond à {EMAIL:bureau@lestilleuls.test}.",
    "Wer Fragen hat, mailt an {EMAIL:info(at)nachbarhilfe.de}.",
    "برای من به {EMAIL:n.tavakoli@payam.test} بنویس.",
    "She signs in with {EMAIL:mel_99@rivermail.com}, I think.",
    "The ward phone is {PHONE:0117 496 0388} after ten.",
    "Leave a voicemail on {PHONE:(415) 555-0103}.",
    "Ihre Nummer ist {PHONE:040 5557 8812}, oft besetzt.",
    "Faites le {PHONE:02 61 91 55 07} et patientez.",
    "به شماره {PHONE:0903 555 7788} پیام بده.",
    "My number in Spain was {PHONE:+34 655 501 223}.",
    "The border officer noted passport {ID_NUMBER:N7719034} twice.",
    "My social security number, {ID_NUMBER:301-11-8842}, leaked.",
    "Personalausweisnummer {ID_NUMBER:T22000129} liegt bei.",
    "Ma carte d'identité porte le numéro {ID_NUMBER:880692310285}.",
    "کد ملی مادرم {ID_NUMBER:4579921134} را اشتباه زدند.",
    "National ID {ID_NUMBER:9001015009087} on every page.",
    "I sleep at {ADDRESS:31 Foxglove Lane, Taunton} now.",
    "Parcels for {ADDRESS:5 Kestrel Court} end up next door.",
    "My mother's place is {ADDRESS:118 Victoria Road}.",
    "Ich lebe in der {ADDRESS:Bergstraße 44}, dritter Stock.",
    "Unser Büro: {ADDRESS:Marktplatz 2, 06108 Halle}.",
    "Il loge au {ADDRESS:27 rue Pasteur, 44000 Nantes}.",
    "Envoyez tout au {ADDRESS:3 impasse des Cerisiers}.",
    "ما در {ADDRESS:خیابان فردوسی، کوچه سوم، پلاک 8} زندگی می‌کنیم.",
    "{NAME:Gwendolyn Achebe} phoned this morning.",
    "I owe {NAME:Mr Castellanos} an apology.",
    "My roommate {NAME:Ingrid Solheim} snores.",
    "Sincerely, {NAME:Rafael Quintero}",
    "My name is {NAME:Oluwaseun Adebayo}, I am a nurse.",
    "{NAME:Dr. Hennings} rät zu mehr Schlaf.",
    "Mein Name ist {NAME:Ludger Brinkmann}.",
    "Mit {NAME:Frau Ahrens} komme ich gut aus.",
    "Je m'appelle {NAME:Capucine Moreau-Lefort}.",
    "{NAME:Monsieur Garnier} ne dit jamais bonjour.",
    "نام من {NAME:بهزاد نامدار} است.",
    "{NAME:خانم ستوده} به من سر زد.",
    "The claim 88120043 was rejected.",
    "Receipt no. 2023-55810 is lost.",
    "Bestellnummer 7719-20334 kam nie an.",
    "Commande 55120988 annulée.",
    "سفارش ۵۵۱۰۹۸۲۳ لغو شد.",
    "In 2019 I weighed 82.5 kilos.",
    "We met at 10:15 on 03/11/2022.",
    "There were 25 people on the street.",
    "I moved from Ashford to Kingsmere.",
    "The Silver Birch group meets weekly.",
    "Am Dienstag war ich 3 Stunden im Park.",
    "J'ai relu 4 fois la même page.",
    "دیروز 12 نفر در میدان بودند.",
    "No one at work knows.",
]

LAST = [
    "Could you reply to {EMAIL:dora.winfield@cloverhall.co.uk} by Friday?",
    "My old address was {EMAIL:p_jansen71@zuidpost.test}, now dead.",
    "Meldet euch bei {EMAIL:team[at]lesekreis[dot]de}.",
    "Le contact reste {EMAIL:h.bonnard@atelier-sud.fr}.",
    "آدرس {EMAIL:m.karimi@dabir.ir} جواب نمی‌دهد.",
    "The hospice number is {PHONE:0191 498 0566}.",
    "I keep dialling {PHONE:(206) 555-0117} by mistake.",
    "Mein Vater ist unter {PHONE:0341 555 12 90} zu erreichen.",
    "Elle m'a laissé le {PHONE:07 68 55 01 29}.",
    "شماره‌اش {PHONE:0919 555 6612} بود.",
    "Reach the landlord: {PHONE:+31 20 555 0147}",
    "The form wants my passport number, {ID_NUMBER:P20938417}.",
    "Social security {ID_NUMBER:447-20-9913} was on the envelope.",
    "Ausweis {ID_NUMBER:L8ZN0K4R2} ist im Fundbüro.",
    "Numéro de sécu {ID_NUMBER:1 85 11 75 120 044 31}, encore refusé.",
    "کد ملی برادرم {ID_NUMBER:3240175800} است.",
    "Letters still go to {ADDRESS:62 Harbour Street, Whitby}.",
    "The shelter is at {ADDRESS:4 Chapel Row}.",
    "Mein Zimmer ist in der {ADDRESS:Schillerstraße 9}, ganz oben.",
    "Adresse: {ADDRESS:Mühlenweg 21, 24103 Kiel}",
    "Nous logeons {ADDRESS:19 boulevard Gambetta}.",
    "نشانی: {ADDRESS:خیابان حافظ، کوچه یاس، پلاک 40}",
    "My manager, {NAME:Terrence Blackwood}, cut my hours.",
    "Dear {NAME:Mrs Ferreira}, thank you.",
    "My name is {NAME:Yusuf Demirci}.",
    "I cried when {NAME:Marguerite Oyelaran} hugged me.",
    "{NAME:Frau Lindemann} wohnt unter mir.",
    "Ich heiße {NAME:Korbinian Achleitner}.",
    "Je m'appelle {NAME:Apolline Desrosiers}.",
    "{NAME:M. Fontaine} a réparé la porte.",
    "اسمم {NAME:روزبه کیانی} است.",
    "{NAME:آقای شریفی} فردا می‌آید.",
    "Policy number 66120-441 expired.",
    "Fall 903112755 ist noch offen.",
    "Réf. 200418873 sans suite.",
    "پرونده ۲۰۳۳۱۱۸۷۴ بسته شد.",
    "On 2021-09-30 I scored 58/100.",
    "There were 15 cars in the lane.",
    "We visited Lower Denby last summer.",
    "Die App Sanfter Schlaf kostet 9 Euro.",
    "It rained for 6 days.",
    "Personne ne m'a appelé depuis 3 semaines.",
]
