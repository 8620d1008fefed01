"""Broken prompt and response pairs (problem 1): defective titles and the kinds of their defects.

The rules look at the raw answer, with the message that it answers:

1. Reasoning is set aside; reasoning that is opened and never closed is ``truncated``.
2. Wrapping (quotes, markup, labels) and stand-ins for "nothing" are set aside; if nothing is left it is ``empty``.
3. A phrase of refusal in words that don't follow the message is a ``refusal``.
4. The words of the whole message, 20 characters or more, are a ``copy``.
5. A delimiter that is opened and never closed, a last word that breaks off within a word of the message, or a last word that calls
   for another one make it ``truncated``.
6. Words of a language or script that no sentence of the message is in make it ``language``.

``all_defects`` has every rule that fires, each judged by itself, ``defect`` the first in the order above. Only a message of less than
20 characters that is its own title, or an answer of which nothing is left, ends the search: there is nothing more to judge. An answer
that breaks off within its reasoning hasn't begun, so it is truncated and not empty.

Defined results: a null raw is empty; rows with an error have no defect; without a message the rules about it don't fire; repeated
rows give one record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexicon import Lexicon, fit_lexicon

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.?!;])\s+|\n+|\s(?:--|>>)\s*|\s\|\s")
_THINK = re.compile(r"<(think|thinking|reasoning)>.*?</\1>", re.S | re.I)
_OPEN_THINK = re.compile(r"<(?:think|thinking|reasoning)>", re.I)

#: Words before a colon that announce a title.
LABELS = "title headline subject answer titel überschrift titre título titulo titolo rubrik tytuł tytul заголовок onderwerp".split()
#: Answers that stand for nothing.
NOTHING = {
    "n a", "na", "none", "null", "nil", "nan", "empty", "no title", "untitled", "title", "undefined", "blank", "nothing", "tbd", "unknown", "not available", "not applicable",
    "sans titre", "aucun", "aucun titre", "vide", "kein titel", "ohne titel", "leer", "keiner", "sin título", "sin titulo", "ninguno", "vacío", "vacio", "sem título", "sem titulo", "nenhum", "vazio",
    "senza titolo", "nessuno", "vuoto", "geen titel", "zonder titel", "geen", "leeg", "ingen titel", "utan titel", "tom", "brak tytułu", "bez tytułu", "brak", "puste", "без названия", "нет", "нет заголовка", "пусто",
} | set(LABELS)
#: Phrases of refusal, by language.
REFUSALS = re.compile(
    r"\b(?:"
    r"i (?:can ?not|can['’]?t|could not|won['’]?t|will not|must decline|am not able|am unable|do not feel|apologi[sz]e)|i['’]m (?:sorry|not able|unable|afraid)|(?:we|i) (?:have to|must) (?:decline|refuse)|as an ai|sorry\W+(?:but )?i|unfortunately\W+(?:this|i|it)"
    r"|(?:no|not an?) \w+ (?:can|could|may|will) be \w+|\w+ (?:can ?not|can['’]?t|could not) be (?:given|made|created|produced|provided|generated)|not something (?:i|we)\b|not (?:allowed|permitted|comfortable|willing|going) to|(?:decline|refuse) to"
    r"|falls? outside|(?:outside|beyond|against|contrary to|violat\w+) (?:of )?(?:what i|what we|my|our|the) ?(?:\w+ )?(?:allowed|guidelines?|polic\w+|rules?|terms|limits|scope)|(?:my|our) (?:guidelines|policy|policies|rules)|unable to (?:\w+ )?(?:create|provide|generate|help|title|give|write)"
    r"|je (?:ne peux pas|ne suis pas en mesure|refuse|suis désolée?|regrette)|désolée?\W+(?:mais )?je|il m['’]est impossible|en tant qu['’](?:ia|intelligence)"
    r"|(?:no puedo|no me es posible|lo siento|no estoy en condiciones|no soy capaz|me niego)|como (?:una? )?(?:ia|inteligencia)"
    r"|ich kann (?:\w+ ){0,6}(?:nicht|kein\w*)|(?:es )?tut mir leid|leider (?:kann|darf|ist)|als ki\b|ich darf (?:\w+ ){0,5}(?:nicht|kein\w*)|nicht in der lage"
    r"|(?:não posso|não consigo|não me é possível|não sou capaz|não estou em condições|desculpe\W+(?:mas )?não|sinto muito|lamento)|como (?:uma )?ia\b"
    r"|(?:non posso|non sono in grado|non mi è possibile|mi dispiace|spiacente)|come (?:un['’]?)?ia\b"
    r"|ik kan (?:\w+ ){0,6}(?:niet|geen)|het spijt me|(?:sorry|helaas)\W+(?:maar )?(?:ik|kan)|niet in staat|als ai\b"
    r"|jag kan (?:\w+ ){0,4}(?:inte|ingen)|(?:tyvärr|förlåt|beklagar)\W+(?:men )?(?:jag|kan|detta|det)|jag beklagar|inte möjlighet"
    r"|(?:nie mogę|nie jestem w stanie|przepraszam|przykro mi|niestety)\b|jako (?:model|ai)\b"
    r"|(?:я не могу|не могу|не в состоянии|извините|простите|к сожалению|мне жаль|как ии)\b"
    r"|(?:debo|tengo que|devo|preciso|dois|must|have to) (?:\w+ ){0,2}(?:rechazar|declinar\w*|recusar|rifiutar\w*|refuser|décliner|decline|refuse)"
    r"|muss (?:\w+ ){0,3}ablehnen|moet (?:\w+ ){0,4}(?:weigeren|afwijzen)|måste (?:\w+ ){0,3}(?:avböja|neka|avvisa)|muszę (?:\w+ ){0,2}odmówić|вынужден\w* (?:\w+ ){0,2}(?:отказ\w+|отклонить)"
    r")",
    re.I,
)
#: Words that call for another one, by language.
CALLING = {
    "English": "the a an of to for with from by at on into under about between and or that which whose like near called made my your our their his its than as",
    "French": "le la les un une des du de d l au aux et ou que qui à dans sur pour par avec sans chez selon comme près en mon ma mes notre",
    "Spanish": "el la los las un una unos del al de y o que con sin por para según sobre entre desde como cerca en mi su nuestra",
    "German": "der die das den dem des ein eine einen einem einer und oder dass mit ohne für von vom zu zum zur im in nach über bei wie während mein meine unser unsere",
    "Portuguese": "o a os as um uma de do da dos das no na nos nas ao e ou que com sem por para segundo sobre em meu minha nossa",
    "Italian": "il lo la i gli le un uno una di del dello della dei degli delle al allo alla nel nella sul sulla dal dalla da e o che con senza per secondo come su mio mia nostra",
    "Dutch": "de het een en of van voor met zonder op in bij volgens zoals dat mijn onze tijdens binnen",
    "Swedish": "en ett den det och eller att med utan för från enligt som på i om av till under vår",
    "Polish": "i lub że z ze bez dla od do na w o po przy według",
    "Russian": "и или что с со без для от до на в во о об про по к у мой моя наш",
}
#: Words behind which "that" points back.
_PREPOSITIONS = frozenset("of to for with from by at on about like".split())
CALLING = {k: frozenset(v.split()) for k, v in CALLING.items()}
_PAIRS = (('"', '"'), ("“", "”"), ("„", "“”"), ("«", "»"), ("‘", "’"), ("'", "'"), ("`", "`"), ("(", ")"), ("[", "]"), ("{", "}"))
_CUT = re.compile(r"[,(\[{–—-]$")
_LABEL = re.compile(rf"^\W*(?:{'|'.join(LABELS)})\s*[:：]\s*", re.I)


def unwrap(raw: str) -> tuple[str, bool, bool]:
    """(content, reasoning open, delimiter open). Labels, markup and complete quotes are taken off, in turns."""
    t = _THINK.sub("", raw)
    if _OPEN_THINK.search(t):
        return t[: _OPEN_THINK.search(t).start()].strip(), True, False
    t = t.strip()
    open_ = False
    for _ in range(6):
        before = t
        t = _LABEL.sub("", t).strip()
        for mark in ("***", "**", "__", "*", "```"):
            if t.startswith(mark) and len(t) >= len(mark):
                inner = t[len(mark) :]
                if inner.rstrip(" .!?").endswith(mark):
                    t = inner.rstrip(" .!?")[: -len(mark)].strip()
                elif inner.strip() and mark in ("**", "__", "***", "```") and mark not in inner:
                    open_, t = True, inner.strip()
                break
        t = re.sub(r"^#+\s*", "", t)
        for a, z in _PAIRS:
            if t.startswith(a):
                body = t[1:]
                tail = body.rstrip(" .!?:;…")
                if tail and tail[-1] in z:
                    t = tail[:-1].strip()
                elif a not in "'‘" or " " in body:
                    if not any(c in body for c in z):
                        open_, t = True, body.strip()
                break
        if t == before:
            break
    return t, False, open_


class TitleRules:
    def __init__(self, lexicon: Lexicon, lead: float = 2.0, copy_chars: int = 20) -> None:
        self.lexicon, self.lead, self.copy_chars = lexicon, lead, copy_chars

    def languages_of(self, message: str) -> dict[str, float]:
        """Languages of the message's sentences, as far as their words tell."""
        out: dict[str, float] = {}
        for s in [*_SENTENCE.split(message), message]:
            lang, lead, n = self.lexicon.best(s)
            if lang and lead > 0.7:
                out[lang] = max(out.get(lang, 0.0), lead)
        return out

    def foreign(self, words: list[str], message: str) -> bool:
        own = set(_WORD.findall(message.lower()))
        said = " ".join(w for w in words if w not in own)
        lang, lead, n = self.lexicon.best(said)
        if lang is None or n < 1 or lead < self.lead:
            return False
        # all words of the title must fit as well: those that the message has too may tip the scale
        whole, wlead, _ = self.lexicon.best(" ".join(words))
        return whole == lang and wlead >= self.lead and lang not in self.languages_of(message)

    def broken(self, text: str, words: list[str], own: list[str], follows: bool, message: str | None) -> bool:
        """The last word breaks off within a word of the message, or calls for another one."""
        last, whole = words[-1], set(own)
        within = last not in whole and any(len(w) > len(last) and w.startswith(last) for w in whole)
        pointing = len(words) > 1 and last == "that" and words[-2] in _PREPOSITIONS  # "help with that" is complete
        calls = not pointing and not (follows and words[-2:] == own[-2:]) and any(last in CALLING[x] for x in (self.languages_of(message) if message else CALLING))
        return within or calls or bool(_CUT.search(text.rstrip(" \t\n.!?…\"'*”»")))

    def __call__(self, raw: str | None, message: str | None) -> list[str]:
        text, think, open_ = unwrap(raw or "")
        words, own = _WORD.findall(text.lower()), _WORD.findall(message.lower()) if message else []
        out = ["truncated"] if think else []
        if not words or " ".join(words) in NOTHING and own != words:
            return out or ["empty"]
        rest = iter(own)
        follows = bool(own) and all(w in rest for w in words)
        # white space and case are no difference, nor are the marks between words
        is_copy = bool(own) and "".join(words).casefold() == "".join(own).casefold()
        if is_copy and len(message.strip()) < self.copy_chars:
            return out
        if not follows and REFUSALS.search(text):
            out.append("refusal")
        if is_copy:
            out.append("copy")
        if open_ or not is_copy and self.broken(text, words, own, follows, message):
            out.append("truncated")
        if message and not follows and not is_copy and self.foreign(words, message):
            out.append("language")
        return list(dict.fromkeys(out))


def defects(titles: DataFrame, messages: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """(run_id, defect, all_defects) of every defective record without error.

    titles: run_id, id, raw, error; messages: id, text, language. Both tables may deliver rows repeatedly.
    """
    lexicon = lexicon or fit_lexicon(messages)
    shared = titles.sparkSession.sparkContext.broadcast(lexicon.scores)  # bounded by the sample
    mine = titles.where("error IS NULL AND run_id IS NOT NULL").select("run_id", "id", "raw").groupBy("run_id").agg(F.max_by(F.struct("id", "raw"), F.struct(F.col("raw").isNotNull(), "id", "raw")).alias("r")).select("run_id", "r.id", "r.raw")
    texts = messages.select("id", F.col("text").alias("message")).where("id IS NOT NULL")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = TitleRules(Lexicon(shared.value))
        for b in batches:
            found = [(r, d) for r, raw, m in zip(*(b.column(i).to_pylist() for i in range(3))) if (d := rules(raw, m))]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([d[0] for _, d in found], pa.string()), pa.array([d for _, d in found], pa.list_(pa.string()))], names=["run_id", "defect", "all_defects"])

    joined = mine.join(texts, "id", "left").select("run_id", "raw", "message")
    out = joined.mapInArrow(judge, "run_id long, defect string, all_defects array<string>")
    # a message delivered again gives the same row again
    return out.groupBy("run_id").agg(F.min_by(F.struct("defect", "all_defects"), F.struct("defect", "all_defects")).alias("d")).select("run_id", "d.defect", "d.all_defects")
