"""Broken prompt and response pairs: a multi-label linear classifier trained on defects made from sound pairs.

Sound answers are cut off, replaced by their prompt, by an answer in another language or by a short or long refusal; hashed n-grams of
the whole answer and features of the pair feed one logistic model a defect. The sample may hold defective pairs itself: a first round of models,
each scoring only pairs it was not fitted on, drops those, and a second is fitted on the rest. Thresholds come from a curve through all the
held-out scores, so they hardly depend on the sample. It is bounded (``TRAIN_PAIRS``) and drawn by a hash of the key.

Defined results: a null or contentless answer is ``empty``; a null prompt allows only ``empty``, ``truncated`` and ``refusal``; one
defect a pair, empty or else the most certain one of those beyond their threshold (ties: copy, refusal, language, truncated); repeated rows
count once; empty tables give no rows.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.linear import Examples, Logistic, calibrated, held_out, slot, vector
from inkspan.tables import bounded_rows

#: Most pairs that the classifier is trained on.
TRAIN_PAIRS = 1200
#: Answers of fewer words are not taken for sound ones to train on.
LEAST_WORDS = 40
#: An answer of fewer words is short: its n-grams also count as such.
SHORT = 30
DEFECTS = ("empty", "copy", "refusal", "language", "truncated")
#: The certainty that a finding needs. Refusals come in more wordings than can be made here, so what resembles them is taken sooner.
SURE = {"copy": 0.5, "refusal": 0.3, "language": 0.5, "truncated": 0.5}
_WORD = re.compile(r"[^\W\d_]+|\d+")
_MARKUP = re.compile("<[^>]*>|&[a-z]+;|[\u200b\ufeff]")
_ASK = {
    "de": re.compile(r"(?i)\b(in german|only german|german only|auf deutsch|de version|en allemand|en alemán|answer in german)\b"),
    "fr": re.compile(r"(?i)\b(in french|only french|french only|auf französisch|fr version|en français|en francés)\b"),
    "es": re.compile(r"(?i)\b(in spanish|only spanish|spanish only|auf spanisch|es version|en espagnol|en español)\b"),
    "en": re.compile(r"(?i)\b(in english|only english|english only|auf englisch|en version|en anglais|en inglés)\b"),
}
#: Refusals by language: openings, ways to decline with verbs and objects, whole sentences that decline, closings.
_REFUSE = {
    "en": (
        ["I'm sorry, but", "Sorry,", "I apologise, but", "I'm afraid", "Thank you for the request, but", "Thanks for your message, however", "I appreciate the question, but", "I see why this matters to you. Still,", "Unfortunately", "Regrettably,", "As an AI,", "As an assistant,", "As a language model,", "", "", ""],
        ["I can't", "I cannot", "I can not", "I won't", "I will not", "I'm unable to", "I am unable to", "I am not able to", "I'm not going to", "I must decline to", "I have to refuse to", "I'd rather not", "I would prefer not to", "I'm not in a position to", "I am not allowed to", "I don't feel able to", "it is not possible for me to", "it isn't possible for me to", "I don't feel comfortable being asked to", "I do not want to"],
        ["write", "help with", "provide", "produce", "create", "draft", "do", "assist with", "complete", "generate", "offer", "fulfil", "support", "continue with", "answer"],
        ["this", "that", "this text", "this request", "your request", "that kind of content", "such a text", "what you ask for", "a piece like this", "content of this kind", "this one", "it"],
        ["this request has been declined.", "request refused.", "declined.", "the request was turned down, so nothing is provided.", "no answer is given to this request.", "your request cannot be fulfilled.", "that is outside of what I am able to do.", "this falls beyond what I can offer.", "this goes against my guidelines.", "my policies do not allow it.", "no text will be produced for this request.", "nothing was written in reply to this.", "content like that isn't available from me.", "making such content isn't possible for me.", "I have to say no.", "I need to pass on this one.", "my answer has to be no.", "that is not something I do.", "I don't feel comfortable doing that.", "someone else may be able to write it instead."],
        ["", "", "Let me know if I can help with something else.", "Please ask me about another topic.", "I would be glad to help with a different subject.", "Feel free to ask for something else.", "I hope you understand.", "Maybe another person could take it on."],
    ),
    "de": (
        ["Es tut mir leid, aber", "Es tut mir leid,", "Leider", "Entschuldigung,", "Danke für die Anfrage, aber", "Bedauerlicherweise", "", ""],
        ["ich kann", "kann ich", "ich möchte", "ich darf", "ich werde"],
        ["diesen Text nicht", "diese Anfrage nicht", "dabei nicht", "so etwas nicht", "dazu nichts", "einen solchen Inhalt nicht"],
        ["schreiben", "verfassen", "bearbeiten", "beantworten", "anbieten", "erstellen", "liefern"],
        ["diese Anfrage muss ich ablehnen.", "dabei kann ich nicht helfen.", "das ist mir nicht möglich.", "ich muss das ablehnen.", "dafür bin ich nicht der Richtige.", "die Anfrage wurde abgelehnt.", "abgelehnt.", "kein Text erstellt.", "das verstößt gegen meine Richtlinien.", "bei diesem Thema kann ich nicht weiterhelfen."],
        ["", "", "Gern helfe ich bei einem anderen Thema.", "Bitte stellen Sie eine andere Frage.", "Ich bitte um Verständnis."],
    ),
    "fr": (
        ["Je suis désolé, mais", "Désolé,", "Désolée, mais", "Malheureusement,", "Merci pour la demande, mais", "Je regrette,", "", ""],
        ["je ne peux pas", "je ne suis pas en mesure de", "il m'est impossible de", "je ne souhaite pas", "je dois refuser de", "je préfère ne pas"],
        ["rédiger", "écrire", "fournir", "produire", "traiter", "créer"],
        ["ce texte", "cette demande", "ce contenu", "un tel texte", "cela", "ce genre de contenu"],
        ["je dois refuser cette demande.", "je ne peux pas vous aider pour cela.", "cela ne m'est pas possible.", "la demande a été refusée.", "demande refusée.", "aucun texte fourni.", "cela va à l'encontre de mes règles.", "je ne peux pas répondre à cela."],
        ["", "", "N'hésitez pas à proposer un autre sujet.", "Je peux aider pour autre chose.", "Merci de votre compréhension."],
    ),
    "es": (
        ["Lo siento, pero", "Perdón,", "Lamentablemente,", "Gracias por preguntar, pero", "Lo lamento,", "Por desgracia", "", ""],
        ["no puedo", "no me es posible", "no voy a", "no estoy en condiciones de", "debo negarme a", "prefiero no"],
        ["escribir", "redactar", "ofrecer", "producir", "crear", "atender"],
        ["este texto", "esta solicitud", "este contenido", "un texto así", "eso", "ese tipo de contenido"],
        ["debo rechazar esta petición.", "no puedo ayudar con eso.", "eso no me es posible.", "la solicitud ha sido rechazada.", "solicitud denegada.", "no se ofrece ningún texto.", "eso va en contra de mis normas.", "no puedo responder a eso."],
        ["", "", "Si tienes otro tema, con gusto ayudo.", "Puedo ayudar con otra cosa.", "Gracias por comprender."],
    ),
}


# What a long refusal says before and after it declines.
_AROUND = {
    "en": ["I have read your message carefully and I want to take it seriously.", "I can see that this means a lot to you.", "I understand what you are after and why.", "It sounds as if you really need this.", "I see why you ask, and it seems a reasonable wish.", "I know that you would like to have this, and you explain it well.", "You clearly put some thought into it, and I appreciate the detail.", "Requests like this one come up often, and every time I have to weigh several things.", "There are good reasons to be interested in the subject, and I do not want to judge them.", "My aim is to be useful and honest in equal measure.", "I know that this is not the answer you were hoping for.", "It may help to look at the question from another side, or to speak with someone who knows the field.", "Many libraries and public offices give good advice on it, free of charge.", "If it is urgent, a person you trust can often do more than I can.", "Please do not take this as a comment on you or on your plans.", "I apologise for the inconvenience, and for the time that this has cost you.", "I could, for example, explain the background in general terms, or suggest a different theme."],
    "de": ["Ich habe Ihre Nachricht genau gelesen und nehme sie ernst.", "Ich verstehe, dass Ihnen das wichtig ist.", "Sie haben sich offenbar viele Gedanken gemacht, und das schätze ich.", "Solche Anfragen kommen oft, und jedes Mal sind mehrere Dinge abzuwägen.", "Mir ist klar, dass Sie eine andere Antwort erhofft haben.", "Vielleicht hilft es, mit jemandem zu sprechen, der sich auskennt.", "Viele Büchereien und Ämter beraten dazu kostenlos.", "Bitte verstehen Sie das nicht als Urteil über Sie oder Ihr Vorhaben.", "Ich bitte um Entschuldigung für die Mühe und die verlorene Zeit."],
    "fr": ["J'ai lu votre message avec attention et je le prends au sérieux.", "Je comprends que cela compte pour vous.", "Vous y avez manifestement réfléchi, et j'apprécie les détails.", "De telles demandes reviennent souvent, et il faut chaque fois peser plusieurs choses.", "Je sais que ce n'est pas la réponse que vous espériez.", "Il peut être utile d'en parler avec une personne qui connaît le domaine.", "Beaucoup de bibliothèques et de services publics donnent de bons conseils.", "Ne prenez pas cela comme un jugement sur vous ou sur vos projets.", "Je vous prie d'excuser la gêne et le temps perdu."],
    "es": ["He leído su mensaje con atención y lo tomo en serio.", "Entiendo que esto es importante para usted.", "Es evidente que lo ha pensado mucho, y agradezco los detalles.", "Peticiones así llegan a menudo, y cada vez hay que sopesar varias cosas.", "Sé que no es la respuesta que esperaba.", "Puede ayudar hablar con alguien que conozca el tema.", "Muchas bibliotecas y oficinas públicas dan buenos consejos gratis.", "No lo tome como un juicio sobre usted o sobre sus planes.", "Pido disculpas por la molestia y por el tiempo perdido."],
}
_BUT = {"en": ["Still,", "However,", "Even so,", "But", "All the same,", "Yet"], "de": ["Trotzdem:", "Dennoch:", "Aber", "Allerdings:"], "fr": ["Pourtant,", "Cependant,", "Mais", "Toutefois,"], "es": ["Aun así,", "Sin embargo,", "Pero", "No obstante,"]}
_MORE = {
    "en": [", and I prefer to say so openly.", ", and I want to be honest about it.", ", however much I would like to.", " in any form.", " at this time.", " for you here.", ", since it is against the rules I work by.", ", and I hope that makes sense."],
    "de": [", und das sage ich lieber offen.", ", so gern ich es täte.", " in dieser Form.", ", weil es gegen meine Regeln ist."],
    "fr": [", et je préfère le dire franchement.", " sous cette forme.", ", car mes règles s'y opposent.", " pour le moment."],
    "es": [", y prefiero decirlo con franqueza.", " en esta forma.", ", porque va contra mis reglas.", " por ahora."],
}
_SAID = {"en": '"{}" said the voice on the phone, and we laughed.', "de": "„{}“ sagte die Stimme am Telefon, und wir lachten.", "fr": "« {} » dit la voix au téléphone, et nous avons ri.", "es": "«{}» dijo la voz al teléfono, y nos reímos."}


def words(s: str) -> list[str]:
    return _WORD.findall(s.lower())


def contentless(s: str | None) -> bool:
    return s is None or not re.search(r"[^\W_]", _MARKUP.sub(" ", s))


class Languages:
    """Guesses a language by its common words; ties and texts without any give none."""

    def __init__(self, common: dict[str, list[str]]):
        self.of: dict[str, list[str]] = {}
        for lang, ws in common.items():
            for w in ws:
                self.of.setdefault(w, []).append(lang)

    def learn(self, rows: list[tuple[str | None, str]]) -> None:
        """Adds words that occur almost only in answers of one language, or in the prompts that led to them."""
        seen: dict[str, dict[str, int]] = {}
        for p, t in rows:
            lang, sure = self.guess(words(t))
            if lang and sure > 0.5:
                for w in {*words(p or ""), *words(t)}:
                    by = seen.setdefault(w, {})
                    by[lang] = by.get(lang, 0) + 1
        sizes: dict[str, int] = {}
        for p, t in rows:
            lang, _ = self.guess(words(t))
            if lang:
                sizes[lang] = sizes.get(lang, 0) + 1
        for w, by in seen.items():
            rates = {lang: n / sizes[lang] for lang, n in by.items()}
            best = max(rates, key=lambda k: rates[k])
            if w not in self.of and by[best] >= 3 and rates[best] > 0.9 * sum(rates.values()):
                self.of[w] = [best]

    def shares(self, ws: list[str]) -> dict[str, float]:
        out: dict[str, float] = {}
        for w in ws:
            for lang in (langs := self.of.get(w, ())):
                out[lang] = out.get(lang, 0.0) + 1 / len(langs)
        return out

    def guess(self, ws: list[str]) -> tuple[str | None, float]:
        return self.best(self.shares(ws))

    def best(self, shares: dict[str, float]) -> tuple[str | None, float]:
        got = sorted(shares.items(), key=lambda kv: -kv[1])
        if not got:
            return None, 0.0
        second = got[1][1] if len(got) > 1 else 0.0
        return (got[0][0], (got[0][1] - second) / got[0][1]) if got[0][1] > second else (None, 0.0)


def wanted(prompt: str, langs: Languages) -> str | None:
    for lang, ask in _ASK.items():
        if ask.search(prompt):
            return lang
    return langs.guess(words(prompt))[0]


def features(prompt: str | None, text: str, langs: Languages, known: frozenset[int]) -> dict[str, dict[str, float]]:
    """Named features for each defect."""
    ws = words(text)
    pw = words(prompt or "")
    n = len(ws)
    # copy: how much of the answer is the prompt, and of the prompt the answer; what else it says
    ps, ts = set(pw), set(ws)
    mine, theirs = sum(w in ps for w in ws) / max(1, n), sum(w in ts for w in pw) / max(1, len(pw))
    pairs = set(zip(pw, pw[1:]))
    two = sum(p in pairs for p in zip(ws, ws[1:])) / max(1, n - 1)
    new = [w for w in ws if w not in ps]
    copy = {"mine": mine, "theirs": theirs, "two": two, "both": mine * theirs, "all": mine * two * theirs, "rest": min(1.0, len(new) / 20), "bias": 1.0}
    scale = 0.3 / math.sqrt(max(1, len(new)))
    for a, b in zip(["^", *new], new):
        copy["x:" + b] = copy["x:" + a + " " + b] = scale
    want = wanted(prompt, langs) if prompt else None
    share = langs.shares(ws)
    got, sure = langs.best(share)
    other = float(want is not None and got is not None and got != want)
    language = {"other": other, "sure": other * sure, "margin": other * min(1.0, n / 15), "want": share.get(want, 0.0) / max(1.0, sum(share.values())) if want else 1.0, "bias": 1.0}
    if want:
        scale = 1 / math.sqrt(max(1, len(ts)))
        for w in ts:
            language[f"{want}:{w}"] = scale
    # n-grams of the whole answer: its head, rest and tail, and anywhere
    size = "s" if n < SHORT else "l"
    refusal = {"bias": 1.0, "size" + size: 1.0, "length": min(1.0, n / 200), "inprompt": mine, "topic" + size: theirs}
    ends = max(40, n - 40)
    scale = min(1.0, math.sqrt(2 * SHORT / max(1, n)))
    for k, (a, b) in enumerate(zip(["^", *ws], ws)):
        part = "h:" if k < 40 else "m:" if k < ends else "t:"
        refusal[size + part + b] = refusal["w:" + a + " " + b] = scale
        if k > 1:
            refusal["w:" + ws[k - 2] + " " + a + " " + b] = scale
    t = text.rstrip().rstrip("\u200b")
    line = t.rsplit("\n", 1)[-1]
    last = words(line[-120:])[-4:]
    # since the last mark that ends a sentence, how much text runs on
    run = re.split(r"[.!?…:][\s\"'”)»*]*", t)[-1] if not re.search(r"[.!?…][\"'”)»*\]]*$", t) else ""
    ended = bool(re.search(r"[.!?…\]>`\"”»)]$|[^\w\s,;:\-—'’*\[(/\"]$", t))
    item = bool(re.match(r"\s*(?:[-*•·]|\d+[.)]|#|https?:|\[)", line))
    trunc = {"ended": float(ended), "item": float(item), "comma": float(t.endswith((",", ";", "-", "(", "—"))), "run": min(1.0, len(run.split()) / 12), "bias": 1.0, "bold": float(line.count("**") % 2)}
    tag = "E" if ended else "O"
    lines = t.rsplit("\n", 2)
    trunc["brief" + tag] = float(len(line.split()) <= 4 and len(lines) > 1)
    if not ended and last:
        trunc["t1:" + last[-1]] = 1.0
        if len(last) > 1:
            trunc["t2:" + " ".join(last[-2:])] = 1.0
        if len(last) > 2:
            trunc["t3:" + " ".join(last[-3:])] = 1.0
        trunc["known"] = float(slot("w:" + last[-1]) in known)
        trunc["cut"] = float(slot("w:" + last[-1]) not in known) * (0.0 if item else 1.0)
        trunc["first:" + (words(line)[:1] or [""])[0]] = float(len(line.split()) <= 4)
    return {"copy": copy, "language": language, "refusal": refusal, "truncated": trunc}


def _cut(rng: random.Random, text: str) -> str:
    spans = [m.end() for m in re.finditer(r"\S+", text)]
    k = rng.randrange(max(1, len(spans) // 5), max(2, len(spans) - 1))
    at = spans[k]
    for _ in range(12):  # not at the end of a sentence
        if re.search(r"[.!?:…]\W*$", text[:at]):
            k = rng.randrange(max(1, len(spans) // 5), max(2, len(spans) - 1))
            at = spans[k]
    out, kind = re.sub(r"[,;]$", "", text[:at]), rng.random()
    if kind < 0.25:
        word = re.search(r"\w+$", out)
        out = out[: -max(1, len(word.group()) // 2)] if word and len(word.group()) > 3 else out
    elif kind < 0.35:
        out += ","
    elif kind < 0.45:
        out += rng.choice([" and the", " und die", " et les", " y los", " and", " of the"])
    elif kind < 0.5:
        out += " **" + (text[spans[k] : spans[min(k + 3, len(spans) - 1)]].strip() or "the")
    return out


def _copied(rng: random.Random, prompt: str) -> str:
    ws = prompt.split()
    kind = rng.randrange(7)
    if kind == 0:
        return prompt
    if kind == 1:
        return rng.choice(["Sure! ", "Prompt: ", "> ", "Here it is: ", "Of course. "]) + prompt
    if kind == 2:
        return prompt.upper() if rng.random() < 0.5 else prompt.lower()
    if kind == 3:
        return rng.choice(["\n", "\n\n", " "]).join([prompt] * rng.randrange(2, 5))
    if kind == 4 and len(ws) > 4:
        ws[rng.randrange(len(ws))] = rng.choice(["simple", "other", "really", "some"])
    elif kind == 5 and len(ws) > 4:
        for _ in range(rng.randrange(1, 4)):
            ws[rng.randrange(len(ws))] = rng.choice(["", "simple", "other", "really", "quick", ws[0]])
    else:
        ws.insert(rng.randrange(len(ws) + 1), rng.choice(["really", "simply", "the", "just"]))
    return " ".join(ws)


def _declines(rng: random.Random, lang: str, opening: bool = True) -> str:
    """A sentence that declines: a modal, a verb and an object in the order of the language, or a whole one."""
    start, modal, first, second, whole, _ = _REFUSE[lang]
    said = rng.choice(whole) if rng.random() < 0.45 else f"{rng.choice(modal)} {rng.choice(first)} {rng.choice(second)}."
    said = f"{rng.choice(start)} {said}".strip() if opening else said
    return said[:1].upper() + said[1:]


def _refused(rng: random.Random, lang: str) -> str:
    said = _declines(rng, lang)
    if rng.random() < 0.4:  # something kind comes first
        said = f"{rng.choice(_AROUND[lang])} {rng.choice(_BUT[lang])} {said[:1].lower() if said[:2] != 'I ' else 'I'}{said[1:]}"
    if rng.random() < 0.4:
        said = said[:-1] + rng.choice(_MORE[lang])
    more = " " + _declines(rng, lang) if rng.random() < 0.2 else ""
    return rng.choice(["", "", "", "> ", "Assistant: ", "Answer: "]) + (said + more + " " + rng.choice(_REFUSE[lang][5])).strip()


def _refused_at_length(rng: random.Random, lang: str, prompt: str, other: str) -> str:
    """A long refusal: it declines somewhere in, before or after what it says around that, with the prompt or sentences of another answer or without."""
    around = rng.sample(_AROUND[lang], rng.randrange(1, len(_AROUND[lang]) + 1))
    if rng.random() < 0.4:
        around = [*around[: rng.randrange(1, 3)], *re.split(r"(?<=[.!?])\s+", other)[: rng.randrange(3, 9)]]
        rng.shuffle(around)
    if rng.random() < 0.5:
        around.insert(rng.randrange(len(around) + 1), prompt.strip())
    around.insert(rng.choice([0, len(around), rng.randrange(len(around) + 1)]), _declines(rng, lang))
    if rng.random() < 0.3:
        around.insert(rng.randrange(len(around) + 1), _declines(rng, lang))
    return rng.choice([" ", " ", "\n\n"]).join([*around, rng.choice(_REFUSE[lang][5])]).strip()


def _listed(rng: random.Random, text: str) -> str:
    """A list of short parts of an answer, such as may close it."""
    ws = re.sub(r"[^\w\s'’-]", " ", text).split()
    marks = rng.choice(["- ", "* ", "• ", "1. "])
    items = []
    for _ in range(rng.randrange(2, 5)):
        k = rng.randrange(max(1, len(ws) - 4))
        items.append(marks + " ".join(ws[k : k + rng.randrange(1, 5)]))
    return "\n".join(items)


def _quoted(rng: random.Random, lang: str, text: str) -> str:
    """A sound answer in which somebody declines something."""
    parts = re.split(r"(?<=[.!?])\s+", text)
    parts.insert(rng.randrange(1, len(parts) + 1), _SAID[lang].format(_declines(rng, lang, False)))
    return " ".join(parts)


def _made(rng: random.Random, rows: list[tuple[str, str]], langs: Languages) -> list[tuple[int, str | None, str, str]]:
    """(place of the pair it is made from, prompt, answer, defect or '') of sound and broken pairs made from ``rows``; a pair itself comes first."""
    by_lang: dict[str | None, list[str]] = {}
    for _, t in rows:
        by_lang.setdefault(langs.guess(words(t))[0], []).append(t)
    common: dict[str, list[str]] = {}
    for w, spoken in langs.of.items():
        if len(spoken) == 1:
            common.setdefault(spoken[0], []).append(w)
    out: list[tuple[int, str | None, str, str]] = []
    for k, (p, t) in enumerate(rows):
        want = wanted(p, langs) or "en"
        put = lambda prompt, text, defect="", k=k: out.append((k, prompt, text, defect))
        put(p, t)
        put(p, re.sub(r"[.!?]+$", "", t.rstrip()) if rng.random() < 0.8 else p + "\n\n" + t)
        put(p, rng.choice(["I'm sorry this took a while.", "I'm sorry, I can't say it better, but here is the draft.", "I cannot start without thanks.", "Leider etwas spät, aber hier ist der Text.", "Désolé pour le retard, voici le texte.", "Lo siento por la demora, aquí está."]) + rng.choice([" ", "\n\n"]) + t)
        sentences = [x for x in re.split(r"(?<=[.!?])\s+", t) if len(x.split()) > 4]
        if sentences:
            put(p, " ".join(sentences[: rng.randrange(1, 4)]))
            put(p, re.sub(r"[.!?]+$", "", " ".join(sentences[: rng.randrange(1, max(2, len(sentences)))])))
        put(p, _cut(rng, t), "truncated")
        put(p, _cut(rng, t), "truncated")
        if rng.random() < 0.5:  # lists at the end, whole and cut inside an item
            whole = t + "\n\n" + _listed(rng, rng.choice(by_lang[langs.guess(words(t))[0]]))
            put(p, whole)
            if rng.random() < 0.3:
                put(p, whole[: -rng.randrange(2, 5)] if rng.random() < 0.5 else whole + rng.choice([" and", " und die", " et", " y la", ","]), "truncated")
        put(p, _copied(rng, p), "copy")
        tongue = want if rng.random() < 0.7 else rng.choice(list(_REFUSE))
        put(p, _refused(rng, tongue), "refusal")
        put(p, _refused(rng, tongue), "refusal")
        put(p, _refused_at_length(rng, tongue, p, rng.choice(by_lang.get(tongue) or [t])), "refusal")
        if rng.random() < 0.15:
            put(p, _quoted(rng, want, t))
        if rng.random() < 0.15:  # the same words around, and nothing declined
            put(p, " ".join([*rng.sample(_AROUND[tongue], rng.randrange(1, 6)), *re.split(r"(?<=[.!?])\s+", rng.choice(by_lang.get(tongue) or [t]))[: rng.randrange(6)]]))
        if rng.random() < 0.5:  # sound answers of other lengths
            put(p, t + "\n\n" + rng.choice(rows)[1])
        others = [x for x in by_lang if x and x != want]
        if others:
            put(p, rng.choice(by_lang[rng.choice(others)]), "language")
        spoken = [x for x in common if x != want]
        if spoken and rng.random() < 0.3:  # languages that no sound answer is in
            ws = common[rng.choice(spoken)]
            put(p, " ".join(" ".join(rng.choices(ws, k=rng.randrange(5, 15))).capitalize() + "." for _ in range(rng.randrange(2, 9))), "language")
    return out


def _of(made: list[tuple[int, str | None, str, str]], defect: str) -> np.ndarray:
    """The examples that a defect's model is fitted on: what is broken otherwise says nothing about where a text breaks off."""
    return np.array([i for i, m in enumerate(made) if defect != "truncated" or m[3] in ("", defect)], dtype=np.int64)


def train(rows: list[tuple[str | None, str | None]], langs: Languages, seed: int = 11) -> tuple[dict[str, Logistic], frozenset[int]]:
    """The models, with thresholds, and the words known from sound answers."""
    pool = [(p, t) for p, t in rows if p and t and len(t.split()) >= LEAST_WORDS]
    same = Counter(" ".join(words(t)) for _, t in pool)
    pool = [(p, t) for p, t in pool if same[" ".join(words(t))] == 1] or pool  # an answer to several prompts answers none
    langs.learn(pool)
    models: dict[str, Logistic] = {}
    known: frozenset[int] = frozenset()
    for last in (False, True):
        known = frozenset(slot("w:" + w) for _, t in pool for w in words(t.rsplit(None, 1)[0]))
        made = _made(random.Random(seed), pool, langs)
        found: dict[str, list] = {d: [] for d in DEFECTS[1:]}
        for _, p, t, _ in made:  # vectors at once: the named features of all examples would fill the driver
            for d, f in features(p, t, langs, known).items():
                found[d].append(vector(f))
        group = np.array([m[0] for m in made], dtype=np.int64)
        own = np.array([i for i, m in enumerate(made) if i == 0 or made[i - 1][0] != m[0]], dtype=np.int64)
        broken: set[int] = set()
        for d in DEFECTS[1:]:
            keep = _of(made, d)
            xs = Examples([found[d][i] for i in keep])
            ys = np.array([made[i][3] == d for i in keep])
            found[d] = []
            scores = held_out(xs, ys, group[keep])
            threshold, slope = calibrated(scores, ys, SURE[d])
            if last:
                models[d] = Logistic().fit(xs, ys, np.arange(len(ys)))
                models[d].threshold, models[d].slope = threshold, slope
            else:
                at = dict(zip(keep.tolist(), scores.tolist()))
                broken |= {int(group[i]) for i in own if at[int(i)] > threshold}
        if not last:
            pool = [x for k, x in enumerate(pool) if k not in broken] or pool
    return models, known


def classify(prompt: str | None, text: str | None, langs: Languages, models: dict[str, Logistic], known: frozenset[int]) -> str | None:
    if contentless(text):
        return "empty"
    f = features(prompt, text, langs, known)
    asked = [d for d in DEFECTS[1:] if d in models and (prompt or d not in ("copy", "language"))]
    sure = {d: models[d].certainty(vector(f[d])) for d in asked}
    best = max(sure, key=lambda d: sure[d], default=None)
    return best if best is not None and sure[best] > 0 else None


def broken_pairs(pairs: DataFrame, common_words: DataFrame, train_pairs: int = TRAIN_PAIRS) -> DataFrame:
    """file, defect for each broken pair of ``pairs`` (file, prompt, text)."""
    common: dict[str, list[str]] = {}
    for r in bounded_rows(common_words.where("lang is not null and word is not null").select("lang", "word").distinct(), 10_000, "common words"):
        common.setdefault(r.lang, []).append(r.word)
    langs = Languages(common)
    sample = pairs.where("prompt is not null and length(text) > 120").withColumn("_k", F.xxhash64("file", F.lit(5))).orderBy("_k", "file").limit(train_pairs).select("prompt", "text").collect()
    models, known = train([(r.prompt, r.text) for r in sample], langs)

    def run(batches):
        for b in batches:
            found = [classify(p if isinstance(p, str) else None, t if isinstance(t, str) else None, langs, models, known) for p, t in zip(b.prompt, b.text)]
            yield pd.DataFrame({"file": b.file, "defect": pd.Series(found, dtype=object)})[[x is not None for x in found]]

    return pairs.select("file", "prompt", "text").mapInPandas(run, "file string, defect string")
