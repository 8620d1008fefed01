"""Phrasings that no list of the operators was written for: how many are found, and how many findings are right."""

import random

from loomtext.llm import defects, lexicon, personal

REFUSED = """I'm afraid that I cannot help with this request.
Sorry, I am unable to produce a heading for that.
As an AI, I do not write titles for such messages.
We must decline to summarise this conversation.
That is not something I can name.
This message cannot be given a title.
I won't create a title for harmful content.
I am not comfortable naming this message.
This goes against my guidelines.
Je ne peux pas donner de titre à ce message.
Désolé, mais je ne traite pas ce sujet.
Il m'est impossible de résumer cette demande.
Lo siento, no se puede resumir este texto.
No puedo ayudarte con ese mensaje.
Como una IA, no pongo títulos a eso.
Ich kann dafür leider keinen Titel vergeben.
Es tut mir leid, das geht nicht.
Tut mir leid, dafür gibt es keinen Titel.
Não posso dar um título a esta mensagem.
Sinto muito, não vou resumir isso.
Non posso scrivere un titolo per questo messaggio.
Mi dispiace, non è possibile.
Ik kan hier geen titel voor geven.
Het spijt me, dit lukt niet.
Jag kan inte ge det här en rubrik.
Tyvärr kan jag inte hjälpa till.
Nie mogę podać tytułu tej wiadomości.
Przykro mi, nie da się tego streścić.
Я не могу придумать заголовок для этого.
К сожалению, это невозможно.""".split("\n")
TITLES = """Cannot connect to printer
Decline of the Roman empire
Sorry state of city roads
Unable to start engine cold morning
Rules for outdoor chess
Refuse collection dates
Guidelines for new bakers
Impossible triangle drawing
Désolé album chords
Lettre de regret au club
Recette de tarte sans sucre
Consejos para plantar rosas
Carta para mi vecino
Leid und Freude Gedicht
Kann man Reis einfrieren
Receita de bolo simples
Possibile menu per domenica
Geen suiker in thee
Rubrik till skoltidning
Przepis na zupę
Заголовок для газеты
Moving house checklist""".split("\n")


def test_refusals_in_other_words():
    rules = defects.TitleRules(lexicon.Lexicon({}))
    message = "zzz qqq xxx about nothing at all"
    hit = [t for t in REFUSED if "refusal" in rules(t, message)]
    wrong = [t for t in TITLES if "refusal" in rules(t, message)]
    assert len(hit) >= 0.9 * len(REFUSED), set(REFUSED) - set(hit)
    assert len(hit) >= 0.9 * (len(hit) + len(wrong)), wrong


GIVEN = {"en": "Walter Agnes Doris Clive Nadia", "fr": "Lucien Odile Margot Thibault", "es": "Ramiro Begoña Leandro Pilar", "de": "Gerlinde Uwe Detlef Annika"}
FAMILY = {"en": "Hartwell Oakden Pemberly Strand Moffat", "fr": "Rochard Delmas Vauquelin", "es": "Quiroga Villalobos Cienfuegos", "de": "Brinkmann Oswald Kettler"}
CARRIERS = {
    "en": ["Dear {p}, thank you for your visit.", "My name is {p} and the parcel never came.", "You can reach me at {e} all week.", "Please call {t} before noon.", "Deliver it to {a}, second door.", "The passport {n} was found on the bus.", "Name: {p}; phone: {t}; address: {a}", "Kind regards,\n{p}\n{e}"],
    "fr": ["Je m'appelle {p} et j'habite {a}.", "Bonjour, mon téléphone est le {t}.", "Merci d'écrire à {e} avant lundi.", "Demandez {p} à l'accueil.", "Nom : {p}\nAdresse : {a}\nCourriel : {e}"],
    "es": ["Me llamo {p} y vivo en {a}.", "Mi teléfono es {t}, gracias.", "Correo: {e}", "Pregunte por {p} en la tienda.", "Saludos,\n{p}"],
    "de": ["Mein Name ist {p}, ich wohne in der {a}.", "Rufen Sie mich unter {t} an.", "Meine Anschrift: {a}", "Mit freundlichen Grüßen,\n{p}\n{e}", "Fragen Sie Frau {p} nach dem Schlüssel."],
}
PLAIN = ["The match ended 3-1 after 90 minutes.", "Version 2.14.7 came out on 2021-03-14.", "Order 4471 has 12 items and costs $129.", "Turn left at the old mill and walk on.", "Il fait beau depuis trois jours.", "El tren sale a las 10:45 del andén 4.", "Die Lieferung umfasst 250 Stück.", "Chapter 12 begins on page 233."]


def person(rng, lang):
    return f"{rng.choice(GIVEN[lang].split())} {rng.choice(FAMILY[lang].split())}"


def piece(rng, lang, kind):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "p":
        return person(rng, lang)
    if kind == "e":
        return person(rng, lang).lower().replace(" ", rng.choice("._")).replace("ñ", "n") + "@" + rng.choice(["postbox.example", "mail.test", "firm-a.example"])
    if kind == "t":
        return {"en": f"({rng.randint(200, 989)}) 555-{rng.randint(1000, 9999)}", "fr": "06 " + " ".join(d(2) for _ in range(4)), "es": f"+34 6{d(2)} {d(3)} {d(3)}", "de": f"0{rng.randint(151, 179)}/{rng.randint(1, 9)}{d(6)}"}[lang]
    if kind == "a":
        n = rng.randint(1, 180)
        return {"en": f"{n} {rng.choice(['Willow', 'Foundry', 'Castle'])} {rng.choice(['Lane', 'Street', 'Road'])}", "fr": f"{n} rue {rng.choice(['Pasteur', 'Voltaire', 'Mozart'])}", "es": f"Calle {rng.choice(['Olmo', 'Sierra', 'Cervantes'])}, {n}", "de": f"{rng.choice(['Linden', 'Garten', 'Berg'])}{rng.choice(['straße', 'weg', 'allee'])} {n}"}[lang]
    return f"{rng.choice('ABCD')}{rng.choice('KLMX')}{rng.randint(1, 9)}{d(6)}"


def test_personal_information_in_other_words(spark):
    rng = random.Random(11)
    kinds = {"p": "person", "e": "email", "t": "phone", "a": "address", "n": "id_number"}
    rows, truth = [], set()
    for i in range(600):
        lang = rng.choice(list(CARRIERS))
        text, own = [], set()
        for form in rng.sample(CARRIERS[lang], rng.randint(0, 2)):
            said = {k: piece(rng, lang, k) for k in kinds}
            own |= {(i, kinds[k], v) for k, v in said.items() if "{" + k + "}" in form}
            text.append(form.format(**said))
        text += rng.sample(PLAIN, rng.randint(1, 2))
        rng.shuffle(text)
        rows.append((i, "\n".join(text)))
        truth |= own
    # half of the given names are in the table
    given = spark.createDataFrame([(n, k) for k, names in GIVEN.items() for n in names.split()[::2]], "given_name string, lang string")
    found = {tuple(r) for r in personal.PersonalInformation(spark.createDataFrame(rows, "doc_id long, text string"), given).pieces().collect()}
    right = len(found & truth)
    assert right >= 0.9 * len(truth), sorted(truth - found, key=lambda x: x[1:])[:25]
    assert right >= 0.9 * len(found), sorted(found - truth, key=lambda x: x[1:])[:25]
