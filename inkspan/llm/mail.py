"""Newly written text of an e-mail: a sequence model labels each body line new, quoted, signature or disclaimer.

A linear chain over the non-blank lines (averaged structured perceptron, Viterbi decoding) reads position, punctuation,
prefix and neighbouring-line features. It is trained here on mails put together from labelled parts: greetings, closings,
signatures, device lines, disclaimers, separators, quoting prefixes and the lines that introduce quotes, around
body lines taken from a bounded sample of the mails themselves (``TRAIN_MAILS``).

Defined results: a null mail, or one without an empty line after its headers, has no new line; CR at a line's end is ignored;
blank lines have no label; repeated mails are each labelled; very long mails are labelled whole.
"""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_MAILS = 400
MADE_MAILS = 1500
LABELS = ("new", "quoted", "signature", "disclaimer")
BITS = 15

_PREFIX = re.compile(r"^\s{0,3}(?:[>|]|\S{1,3}>)")
_INDENT = re.compile(r"^(?:\t| {4})")
_RULE = re.compile(r"^\W{2,}$")
_MARK = re.compile(r"(?i)^\W*(original message|original appointment|forwarded (message|by)|begin forwarded|ursprüngliche nachricht|weitergeleitete nachricht|message (transféré|d'origine|original)|mensaje (original|reenviado)|message transféré|forwarded)\b.*")
_HEAD = re.compile(r"(?i)^\W{0,2}(from|sent|to|cc|subject|date|von|gesendet|an|betreff|datum|de|envoyé|à|objet|enviado|para|asunto|fecha)\W{0,2}:\W{0,2}\s")
_INTRO = re.compile(r"(?i)\b(wrote|said|schrieb|a écrit|écrit|escribió|writes)\b[^.?!]{0,80}:\s*$")
_INTRO_A = re.compile(r"(?i)^(on|am|le|el)\b.*\d.*\b\d{1,2}[:h]\d\d")
_PS = re.compile(r"(?i)^\W?p\.?\s?s\b\.?")
_DEVICE = re.compile(r"(?i)\b(sent (from|with|via|using)|gesendet|verschickt|envoyé (de(puis)?|avec|à partir)|enviado (desde|con)|for (mobile|android|ios))\b")
# Words of legal and other notices that are added to mails, in four languages.
_LEGAL = re.compile(
    r"(?i)\b(?:confidential\w*|privileged|intended|addressees?|recipients?|disclos\w+|unauthori[sz]ed|prohibited|permitted|distribut\w+|copying|may not|forward(?:ed|ing)?|in error|delete|notify|attachments?|virus\w*|liab\w+|warrant\w*|opinions|views|binding|contract\w*|employer|registered|disclaimer|notice|printing|environment|trees|paper"
    r"|vertraulich\w*|empfänger\w*|irrtümlich\w*|unbefugt\w*|haft\w+|verbindlich\w*|unverbindlich|rechtlich\w*|hinweis|anhänge|ansichten|umwelt\w*|ausdruck\w*|drucken|löschen"
    r"|confidentiel\w*|destinataires?|erreur|opinions?|engagent|responsabilité|juridique|supprimer|imprimer|environnement|avertissement|auteur"
    r"|confidencial\w*|destinatari\w+|por error|opiniones|responsabilidad|aviso|legal|elimin\w+|imprimir|medio ambiente)\b"
)
_CONTACT = re.compile(r"(?i)(https?://|www\.|@|☎|\+\d{2}|\btel\b|\bt[ .:+]+\d|\bm: |\(\d\)\d|\d{3}[ .-]\d{3,4})")
_GREET = re.compile(r"(?i)^(hi|hello|dear|hey|morning|good (morning|evening)|hallo|liebe[rs]?|lieber|guten|bonjour|cher|chère|salut|hola|querid[oa]|estimad[oa]|buen[oa]s)\b")
_CLOSE = re.compile(r"(?i)^(kind |best |warm |many )?(regards|best|thanks|thank you|cheers|yours|talk soon|sincerely|all the best|take care|danke|gruß|grüße|(viele|liebe|beste|herzliche) grüße|mit freundlichen grüßen|bis bald|cordialement|bien à (toi|vous)|à bientôt|merci|amitiés|bises|un saludo|saludos|hasta pronto|gracias|un abrazo|atentamente)\b[^.?!]{0,20}$")


def split_mail(text: str) -> tuple[list[str], int, list[str]]:
    """The lines, the number of the header lines with the empty line, and the sender's name parts."""
    lines = [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]
    end = next((i for i, x in enumerate(lines) if x == ""), None)
    if end is None:
        return lines, len(lines), []
    names: list[str] = []
    for x in lines[:end]:
        if x.lower().startswith("from:"):
            local = re.sub(r".*<|@.*", "", x[5:])
            names = [p for p in re.split(r"[^\w]+", local.lower()) if len(p) > 2]
    return lines, end + 1, names


def _plain(s: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c)).replace("ø", "o").replace("ß", "ss")


def line_features(lines: list[str], names: list[str]) -> tuple[list[int], list[list[str]]]:
    """The indexes of the non-blank lines and their features."""
    kept = [i for i, x in enumerate(lines) if x.strip()]
    block = [0] * len(lines)  # the share of legal words and the size of each paragraph
    legal = [0] * len(lines)
    i = 0
    while i < len(lines):
        if not lines[i].strip():
            i += 1
            continue
        j = i
        while j < len(lines) and lines[j].strip():
            j += 1
        n = sum(len(_LEGAL.findall(x)) for x in lines[i:j])
        for k in range(i, j):
            block[k], legal[k] = j - i, n
        i = j
    kinds, out = [], []
    for i in kept:
        x = lines[i]
        s = x.strip()
        if _MARK.match(s) and len(s) < 120:
            k = "mark"
        elif _PREFIX.match(x):
            k = "prefix"
        elif _HEAD.match(x):
            k = "head"
        elif _RULE.match(s):
            k = "rule" + s[0] + ("L" if len(s) > 3 else "")
        elif _INTRO.search(s):
            k = "intro"
        elif _INTRO_A.match(s):
            k = "introa"
        elif re.fullmatch(r"(?i)(wrote|schrieb.*|a écrit|escribió|[^.!?]{0,40} (wrote|schrieb|escribió|a écrit)) ?:", s):
            k = "intro"
        elif _PS.match(s):
            k = "ps"
        elif _DEVICE.search(s) and len(s) < 70:
            k = "device"
        elif _INDENT.match(x):
            k = "indent"
        elif _CLOSE.match(s):
            k = "close"
        elif _GREET.match(s) and len(s) < 45:
            k = "greet"
        elif _CONTACT.search(s) and len(s) < 50:
            k = "contact"
        elif len(s) <= 3 or re.fullmatch(r"/?\w+([- ’']\w+){0,4}\.?", s) and len(s) < 40:
            k = "name" if any(n in _plain(s) for n in names) else "brief"
        else:
            k = "text"
        kinds.append(k)
    fenced = heads = closed = quoting = -1
    last_prefix = -1
    for n, (i, k) in enumerate(zip(kept, kinds)):
        x, s = lines[i], lines[i].strip()
        prev, nxt = kinds[n - 1] if n else "^", kinds[n + 1] if n + 1 < len(kinds) else "$"
        nx2 = kinds[n + 2] if n + 2 < len(kinds) else "$"
        if k == "mark" or (k == "head" and nxt == "head" and kinds[n + 2 : n + 3] == ["head"]):
            fenced = fenced if fenced >= 0 else n
        if k == "head":
            heads = n
        gap = i > 0 and not lines[i - 1].strip()
        f = ["b", "k:" + k, "k2:" + prev + ">" + k, "k3:" + k + ">" + nxt, "kk:" + prev + ">" + k + ">" + nxt, f"g:{k}{gap}", "n2:" + k + ">" + nxt + ">" + nx2]
        f.append("fence:" + ("no" if fenced < 0 else "yes") + k)
        f.append(f"closed:{'no' if closed < 0 else min(3, n - closed)}:{k}:{gap}")
        f.append(f"quoting:{'no' if quoting < 0 else min(2, n - quoting)}:{k}")
        f.append(f"lp:{'no' if last_prefix < 0 else min(2, n - last_prefix)}:{k}:{gap}")
        f.append(f"legal:{min(3, legal[i])}:{k}")
        f.append(f"own:{len(_LEGAL.findall(s)) > 0}:{min(2, legal[i])}:{k}")
        f.append(f"len:{min(6, len(s) // 12)}:{k}")
        f.append(f"end:{s[-1] if not s[-1].isalnum() else 'a'}:{k}")
        f.append(f"name:{any(m in _plain(s) for m in names)}:{len(s) < 40}")
        f.append(f"pos:{'first' if n == 0 else 'last' if n == len(kept) - 1 else 'mid'}:{k}")
        f.append(f"block:{min(4, block[i])}:{k}:{legal[i] > 1}")
        w = re.findall(r"\w+", s.lower())
        f += ["w1:" + w[0], "w2:" + " ".join(w[:2])] if w else []
        f.append(f"caps:{round(sum(t[0].isupper() for t in re.findall(r'[^\W\d_]+', s)) / max(1, len(w)), 1) if len(s) < 60 else 'x'}:{k}")
        out.append(f)
        if k in ("close", "rule-", "rule_") or k == "rule_L":
            closed = n if closed < 0 or k == "close" else closed
        if k == "ps":
            closed = -1
        if k in ("intro", "introa"):
            quoting = n
        if k in ("prefix", "indent"):
            last_prefix = n
    del heads
    return kept, out


def _hash(f: str) -> int:
    return zlib.crc32(f.encode()) & ((1 << BITS) - 1)


def _ids(features: list[list[str]]) -> list[np.ndarray]:
    return [np.fromiter((_hash(x) for x in f), dtype=np.int32, count=len(f)) for f in features]


class Chain:
    def __init__(self):
        n = len(LABELS)
        self.w, self.t, self.s = np.zeros((1 << BITS, n)), np.zeros((n, n)), np.zeros(n)

    def decode(self, ids: list[np.ndarray]) -> list[int]:
        if not ids:
            return []
        e = [self.w[i].sum(axis=0) for i in ids]
        best, back = self.s + e[0], []
        for x in e[1:]:
            step = best[:, None] + self.t
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + x
        y = [int(best.argmax())]
        for b in reversed(back):
            y.append(int(b[y[-1]]))
        return y[::-1]

    def fit(self, data: list[tuple[list[np.ndarray], list[int]]], epochs: int = 5, seed: int = 3) -> "Chain":
        rng = random.Random(seed)
        sw, st, ss = np.zeros_like(self.w), np.zeros_like(self.t), np.zeros_like(self.s)
        n = 0
        order = list(range(len(data)))
        for _ in range(epochs):
            rng.shuffle(order)
            for k in order:
                ids, y = data[k]
                z = self.decode(ids)
                n += 1
                if z == y:
                    continue
                for i, a, b in zip(ids, y, z):
                    if a != b:
                        np.add.at(self.w, (i, a), 1)
                        np.add.at(self.w, (i, b), -1)
                        np.add.at(sw, (i, a), n)
                        np.add.at(sw, (i, b), -n)
                for seq, d in ((y, 1), (z, -1)):
                    self.s[seq[0]] += d
                    ss[seq[0]] += d * n
                    for a, b in zip(seq, seq[1:]):
                        self.t[a, b] += d
                        st[a, b] += d * n
        self.w, self.t, self.s = self.w - sw / n, self.t - st / n, self.s - ss / n
        return self


# --- made mails ------------------------------------------------------------------------------------------

_GIVEN = ["Marta", "Joel", "Ines", "Tariq", "Clément", "Beate", "Øyvind", "Nuria", "Ana-Rosa", "Piotr", "Léonie", "Wim"]
_FAMILY = ["Halvern", "Castrel", "Obermoor", "Tindalay", "del Monte", "Quarrish", "Belfort", "Sandrik", "O'Malloy", "van Teele"]
_CLOSINGS = ["Kind regards,", "Best,", "Best regards", "Thanks,", "Thanks", "Cheers,", "Yours", "Talk soon,", "Regards,", "All the best,", "Mit freundlichen Grüßen", "Viele Grüße", "Gruß,", "Danke", "Liebe Grüße,", "Bis bald", "Cordialement,", "Bien à toi,", "À bientôt", "Merci", "Un saludo,", "Hasta pronto", "Gracias,", "Saludos"]
_GREETINGS = ["Hi {n},", "Hello {n},", "Dear {n},", "{n},", "{n} -", "Morning {n} -", "Hey {n}", "Hallo {n},", "Liebe {n},", "Lieber {n},", "Guten Morgen {n},", "Bonjour {n},", "Chère {n},", "Salut {n},", "Hola {n},", "Querida {n}:", "Buenas tardes, {n}:", "Estimado {n},", "Hi all,"]
_RANKS, _JOBS = ["Senior", "Junior", "Lead", "Assistant", "Deputy", "", ""], ["Manager", "Engineer", "Analyst", "Accountant", "Director", "Consultant", "Coordinator", "Designer", "Teacher", "Officer", "Editor"]
_UNITS = ["Sales", "Finance", "Human Resources", "Research", "Customer Care", "Purchasing", "Public Affairs", "Library Services", "Vertrieb", "Personalabteilung", "Buchhaltung", "Kundendienst", "Ressources humaines", "Service commercial", "Comptabilité", "Recursos humanos", "Atención al cliente", "Ventas"]
_SHORT_ROLES = ["{j}, {u}", "{r} {j}", "{r} {j}, {u}", "{u}", "{u} Department", "Office of {u}", "Head of {u}", "Abteilung {u}", "Service {u}", "{u} y {u2}", "{u} & {u2}", "Freelance {j}"]
_GADGETS = ["iPhone", "iPad", "Android phone", "Samsung", "smartphone", "mobile device", "BlackBerry", "laptop", "phone", "tablet"]
_DEVICE_LINES = ["Sent from my {g}", "Sent from my {g}.", "Sent using my {g}, excuse my brevity", "Sent with Mailbird", "Get Outlook for Android", "Von meinem {g} gesendet", "Gesendet mit der Mail-App", "Envoyé de mon {g}", "Envoyé depuis mon {g}", "Enviado desde mi {g}", "Sent via webmail", "Get the app for mobile"]
# Notices are put together sentence by sentence.
_NOTICES = {
    "en": (
        ["{this} is confidential{and}.", "{this} is intended only for the {who} to whom it is addressed.", "{this} may contain privileged information.", "Any {use} of it by others is {not}.", "Only the {who} may use or forward {this_}.", "You may not keep, copy or forward {this_} without our consent.", "If you are not the intended {who}, {do}.", "If you have received it in error, {do}.", "Views expressed here are those of the author and not of the employer.", "Nothing in {this_} is a binding offer or contract.", "We accept no liability for viruses in attachments.", "The firm is registered in {land} under number {n}.", "Think of the environment before printing.", "Save paper: do not print {this_}."],
        {"this": ["This email", "This message", "This e-mail and its attachments", "The content of this mail", "The information above"], "this_": ["this message", "this email", "this mail"], "and": ["", " and may be privileged", " and protected by law"], "who": ["recipient", "addressee", "person", "named recipient"], "use": ["use", "copying", "disclosure", "distribution", "storage"], "not": ["prohibited", "not permitted", "unlawful", "forbidden"], "do": ["please delete it", "please notify the sender and delete it", "you may not copy or forward it", "tell us at once"], "land": ["England", "Ireland", "Delaware", "Wales"]},
    ),
    "de": (["Diese {x} ist vertraulich.", "Diese {x} ist nur für den {e} bestimmt.", "Wenn Sie nicht der richtige {e} sind, löschen Sie diese {x}.", "Haben Sie sie irrtümlich erhalten, informieren Sie bitte den Absender.", "Jede unbefugte Weitergabe ist untersagt.", "Der Inhalt ist rechtlich nicht verbindlich.", "Hinweis: Wir haften nicht für Viren in Anhängen.", "Bitte denken Sie vor dem Ausdruck an die Umwelt."], {"x": ["Mail", "E-Mail", "Nachricht"], "e": ["Empfänger", "Adressaten"]}),
    "fr": (["Ce {x} est confidentiel.", "Ce {x} est réservé à ses destinataires.", "Si vous n'êtes pas le destinataire, veuillez le supprimer.", "En cas de réception par erreur, merci d'avertir l'expéditeur.", "Les avis exprimés sont ceux de leur auteur et n'engagent pas la société.", "Toute diffusion non autorisée est interdite.", "Nous déclinons toute responsabilité en cas de virus.", "Pensez à l'environnement avant d'imprimer ce {x}."], {"x": ["message", "courriel", "mail"]}),
    "es": (["Este {x} es confidencial.", "Este {x} va dirigido solo a su destinatario.", "Si no es usted el destinatario, elimine este {x}.", "Si lo recibe por error, avise al remitente.", "Las opiniones son las de su autor.", "Queda prohibida su difusión sin permiso.", "No asumimos responsabilidad por virus.", "Cuide el medio ambiente: no imprima este {x} sin necesidad."], {"x": ["mensaje", "correo", "mail"]}),
}


def _filled(rng: random.Random, text: str, parts: dict[str, list[str]]) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: rng.choice(parts[m.group(1)]) if m.group(1) in parts else str(rng.randrange(1000, 99999)), text)


def _notice(rng: random.Random) -> str:
    """A disclaimer of one to four sentences, with or without a heading."""
    kinds, parts = _NOTICES[rng.choice(["en", "en", "de", "fr", "es"])]
    head = rng.choice(["", "", "", "DISCLAIMER: ", "Notice: ", "NOTICE: ", "Hinweis: ", "Avis : ", "Aviso legal: ", "Confidentiality notice: "])
    out = head + " ".join(_filled(rng, x, parts) for x in rng.sample(kinds, rng.choice([1, 1, 2, 3, 4])))
    return out.upper() if rng.random() < 0.05 else out


def _role(rng: random.Random) -> str:
    return rng.choice(_SHORT_ROLES).format(r=rng.choice(_RANKS), j=rng.choice(_JOBS), u=rng.choice(_UNITS), u2=rng.choice(_UNITS)).strip()


_MARKS = ["-----Original Message-----", "-----ORIGINAL MESSAGE-----", " ----- Original Message -----", "------------ Forwarded ------------", "---------------------- Forwarded by {n} on 11/07/2018 ----", "---------- Forwarded message ---------", "Begin forwarded message:", "-----Ursprüngliche Nachricht-----", "---------- Weitergeleitete Nachricht ---------", "---------- Message transféré ----------", "---------- Mensaje reenviado ----------"]
_INTROS = ["{n} wrote on 2019-08-19:", "On Jan 31, 2019, at 15:23, {n} wrote:", "On Tue, 4 May 2010, {n} said:", "Am 8. März 2019 um 07:00 schrieb {n}:", "{n} schrieb am 25.03.2014:", "{n} escribió el 17/02/2018:", "Le 4 mai 2016 à 10:12, {n} a écrit :", "{n} a écrit le 04/05/2016 :", "El 17/02/2018 9:15, {n} escribió:", "In an earlier mail {n} said:", "Quoting {n} <someone@house.example>:", "{n} <someone@house.example> wrote:"]
# Own sentences that look like something else.
_TRAPS = ["I must ask you to treat these figures as confidential for now.", "-- just to be clear, none of this is decided.", "- first we pack, then we leave", "Subject: that is what I forgot to fill in, sorry.", "To: whom should it go, do you know?", "He wrote in the margin that the date was wrong.", "Many thanks to everyone who stayed until the end.", "Best of all was the last part.", "I am writing this on my phone, so there may be errors.", "* bring the keys and the second list", "My question is this: who pays?", "Did you delete the old copy in error, or was it me?", "Regards are all very well, but an answer would be better.", "What she said was clear: no."]
_HEADS = [("From", "Sent", "To", "Subject"), ("Von", "Gesendet", "An", "Betreff"), ("De", "Envoyé", "À", "Objet"), ("De", "Enviado", "Para", "Asunto")]


def _wrap(s: str, width: int) -> list[str]:
    out, cur = [], ""
    for w in s.split():
        if cur and len(cur) + 1 + len(w) > width:
            out.append(cur)
            cur = w
        else:
            cur = f"{cur} {w}".strip()
    return [*out, cur] if cur else out


def make_mail(rng: random.Random, sentences: list[str]) -> tuple[list[str], list[str], list[str]]:
    """The lines of a body, a label for each (blank lines: '') and the sender's name parts."""
    me, you = ((rng.choice(_GIVEN), rng.choice(_FAMILY)) for _ in range(2))
    lines: list[str] = []
    labels: list[str] = []

    def put(x: str, label: str) -> None:
        lines.append(x)
        labels.append(label if x.strip() else "")

    def prose(label: str, prefix: str = "", n: int | None = None) -> None:
        text = " ".join(rng.choice(sentences) if rng.random() > 0.06 else rng.choice(_TRAPS) for _ in range(n or rng.randrange(1, 5)))
        for x in _wrap(text, rng.choice([55, 68, 70, 72, 76, 400])):
            put(prefix + x, label)

    def own(paragraphs: int) -> None:
        for k in range(paragraphs):
            if k:
                put("", "")
            prose("new")

    def names() -> str:
        return rng.choice([me[0], f"{me[0]} {me[1]}", me[0][0] + ".", "/" + me[0], f"{me[0]} {me[1]}"])

    def contact() -> None:
        for x in rng.sample([_role(rng), _role(rng), rng.choice(["www.", "https://"]) + "house.example", rng.choice(["Tel. ", "T ", "m: ", "☎ ", "T +"]) + rng.choice(["919.555.0105", "+44 (0)113 496 0802", "30 23125 722", "(0) 555-0101"])], rng.randrange(1, 4)):
            put(x, "signature")

    def sign() -> None:
        if rng.random() < 0.75:
            put("", "")
            put(rng.choice(_CLOSINGS), "signature")
            if rng.random() < 0.15:
                put("", "")
            put(names(), "signature")
        if rng.random() < 0.5:
            for _ in range(rng.randrange(0, 3)):
                put("", "")
            if rng.random() < 0.7:
                put(rng.choice(["--", "-- ", "__________", "____________________________________", "* * *", "==="]), "signature")
            put(f"{me[0]} {me[1]}", "signature")
            contact()

    def extras() -> None:
        if rng.random() < 0.12:
            put("", "")
            for x in _wrap(rng.choice(["P.S. ", "PS: ", "P.S.: ", "PS "]) + rng.choice(sentences), rng.choice([60, 72, 400])):
                put(x, "new")
        if rng.random() < 0.2:
            put("", "")
            put(rng.choice(_DEVICE_LINES).format(g=rng.choice(_GADGETS)), "disclaimer")
        if rng.random() < 0.3:
            put("", "")
            if rng.random() < 0.4:
                put(rng.choice(["=" * 40, "*" * 30, "_" * 32, "-" * 20, "* * *"]), "disclaimer")
            for x in _wrap(_notice(rng), rng.choice([55, 65, 72, 400])):
                put(x, "disclaimer")

    def body_of_quote(prefix: str) -> None:
        if rng.random() < 0.5:
            put(prefix + rng.choice(_GREETINGS).format(n=me[0]), "quoted")
            put(prefix.rstrip() if rng.random() < 0.7 else "", "quoted")
        for k in range(rng.randrange(1, 4)):
            if k:
                put(prefix.rstrip(), "quoted")
            prose("quoted", prefix)
            if prefix.startswith(">") and rng.random() < 0.3:
                put(">" + prefix + rng.choice(sentences)[:24], "quoted")
        if rng.random() < 0.4:
            put(prefix.rstrip(), "quoted")
            put(prefix + rng.choice(_CLOSINGS), "quoted")
            put(prefix + you[0], "quoted")

    def intro() -> None:
        x = rng.choice(_INTROS).format(n=f"{you[0]} {you[1]}")
        if rng.random() < 0.2 and " " in x:
            head, _, tail = x.rpartition(" ")
            put(head, "quoted")
            put(tail, "quoted")
        else:
            put(x, "quoted")

    def block() -> None:
        if rng.random() < 0.85:
            put(rng.choice(_MARKS).format(n=f"{you[0]} {you[1]}"), "quoted")
        star = rng.random() < 0.2
        for key in rng.choice(_HEADS):
            k = f"*{key}:*" if star else f"{key}:"
            put(f"{k} " + rng.choice([f"{you[0]} {you[1]}", "2018-11-05 12:31", "the title", "draft two"]), "quoted")
        put("", "")
        body_of_quote("")

    prefix = rng.choice(["> ", ">", "| ", "    ", "\t", "> ", ">> ", f"{you[0][0]}{you[1][0].upper()}> "])
    shape = rng.random()
    if shape < 0.15:  # quote first, own text below
        intro()
        body_of_quote(prefix if prefix.strip() else "> ")
        put("", "")
        if rng.random() < 0.6:
            put(rng.choice(_GREETINGS).format(n=you[0]), "new")
            if rng.random() < 0.6:
                put("", "")
        own(rng.randrange(1, 3))
        sign()
        extras()
    elif shape < 0.3:  # answers between the quoted parts
        if rng.random() < 0.5:
            put(rng.choice(_GREETINGS).format(n=you[0]), "new")
            put("", "")
        if rng.random() < 0.5:
            own(1)
            put("", "")
        intro()
        for _ in range(rng.randrange(1, 4)):
            prose("quoted", prefix if prefix.strip() else "> ", 1)
            put("", "")
            own(1)
            put("", "")
        sign()
        extras()
    elif shape < 0.37:  # forwarded only
        if rng.random() < 0.4:
            own(1)
            put("", "")
        else:
            put("", "")
        block()
    else:
        if rng.random() < 0.65:
            put(rng.choice(_GREETINGS).format(n=you[0]), "new")
            if rng.random() < 0.6:
                put("", "")
        own(rng.randrange(1, 4))
        sign()
        extras()
        kind = rng.random()
        if kind < 0.4:
            put("", "")
            intro()
            body_of_quote(prefix)
        elif kind < 0.7:
            put("", "")
            block()
    return lines, labels, [_plain(p) for p in re.split(r"[^\w]+", f"{me[0]} {me[1]}") if len(p) > 2]


def train(texts: list[str], made: int = MADE_MAILS, seed: int = 17) -> Chain:
    rng = random.Random(seed)
    sentences = []
    for t in texts:
        lines, at, _ = split_mail(t)
        body = " ".join(re.sub(r"^[>|\s]+", "", x) for x in lines[at:])
        sentences += [s for s in re.split(r"(?<=[.!?])\s+", body) if 4 < len(s.split()) < 30 and s[-1] in ".!?" and not re.search(r"[:@*_=]|-{2}", s)]
    sentences = sentences or ["We moved the second chapter to the end and nobody noticed.", "The printer was out of paper again."]
    data = []
    for _ in range(made):
        lines, labels, names = make_mail(rng, sentences)
        kept, f = line_features(lines, names)
        data.append((_ids(f), [LABELS.index(labels[i]) for i in kept]))
    return Chain().fit(data)


def label_mail(text: str, model: Chain) -> list[tuple[int, str]]:
    """(line number from 1, label) of each non-blank body line."""
    lines, at, names = split_mail(text)
    kept, f = line_features(lines[at:], [_plain(n) for n in names])
    return [(at + i + 1, LABELS[y]) for i, y in zip(kept, model.decode(_ids(f)))]


def trained(mails: DataFrame, key: str, text: str, sample: int) -> Chain:
    """The model, trained with the sentences of ``sample`` mails drawn by a hash of the key; only the drawn keys' texts are fetched."""
    drawn = mails.where(F.col(text).isNotNull()).select(F.col(key).alias("_k")).orderBy(F.xxhash64("_k", F.lit(3)), "_k").limit(sample)
    rows = mails.join(F.broadcast(drawn.distinct()), F.col(key) == F.col("_k"), "left_semi").where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return train([r.t for r in sorted(rows.limit(4 * sample).collect(), key=lambda r: (str(r.k), r.t))])


def label_lines(mails: DataFrame, key: str = "mail_id", text: str = "text", sample: int = TRAIN_MAILS) -> DataFrame:
    """key, line_no, label, line for each non-blank body line of each mail."""
    model = trained(mails, key, text, sample)

    def run(batches):
        for b in batches:
            out = []
            for k, t in zip(b["k"], b["t"]):
                if isinstance(t, str):
                    lines = None
                    for n, label in label_mail(t, model):
                        lines = lines or t.split("\n")
                        out.append((k, n, label, lines[n - 1].rstrip("\r")))
            yield pd.DataFrame(out, columns=[key, "line_no", "label", "line"])

    kind = mails.schema[key].dataType.simpleString()
    return mails.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, line_no int, label string, line string")


def new_texts(mails: DataFrame, key: str = "mail_id", text: str = "text", sample: int = TRAIN_MAILS) -> DataFrame:
    """key, new_text of each mail: its newly written lines, joined where they were labelled; empty if there is none."""
    model = trained(mails, key, text, sample)

    def own(t: str | None) -> str:
        lines = t.split("\n") if isinstance(t, str) else []
        return "\n".join(lines[n - 1].rstrip("\r") for n, label in label_mail(t, model) if label == "new") if lines else ""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({key: b["k"], "new_text": pd.Series([own(t) for t in b["t"]], dtype=object, index=b.index)})

    kind = mails.schema[key].dataType.simpleString()
    return mails.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, new_text string")
