"""Small tests of every llm operator: defined results, brute force, round trips, held-out accuracy."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkspan.llm import encoding, leak, mail, mix, pairs, pii, quality, sample

COMMON = {"en": ["the", "and", "of", "was", "is", "in", "a", "to", "it"], "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "war"], "fr": ["le", "la", "et", "les", "est", "une", "dans"], "es": ["el", "los", "una", "que", "y", "es", "con"]}
SENTENCES = ["The printer was out of paper again on Monday morning.", "We moved the second chapter to the end and nobody noticed it.", "It rained for nine days and the garden was late.", "The letter in the drawer is older than the house."]


# --- 1 -----------------------------------------------------------------------------------------------------


def test_rule_list_on_held_out_documents(spark):
    common = [w for ws in COMMON.values() for w in ws]
    texts = spark.createDataFrame([(i, " ".join(SENTENCES * 3)) for i in range(4)], "file string, text string")
    case = quality.learn(spark, texts, "file", "text", common)
    held = quality.made_documents(SENTENCES, seed=999, per_kind=60)
    rows = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(held)], "id long, text string, truth string")
    got = [(r.truth, r.kind or "prose") for r in quality.kinds(rows, "text", case, common).collect()]
    assert sum(a == b for a, b in got) / len(got) > 0.93


def test_statistics_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "word"), (5, "a b " * 50_000)]
    x = quality.with_statistics(spark.createDataFrame(rows, "id long, text string"), "text", ["a"])
    assert {r.id: r.n_words for r in x.collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 100_000}
    assert quality.with_statistics(spark.createDataFrame([], "text string"), "text", []).count() == 0
    assert spark.range(1).select(quality.word_count(F.lit(None).cast("string")).alias("n")).first().n == 0


# --- 2 -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("codec", ["cp1252", "mac_roman", "cp850", "cp437", "cp1251"])
def test_round_trip_of_encodings(codec):
    for w in ("café", "Straße", "mañana", "naïve", "l’été", "àâçèêëîï"):
        try:
            bad = w.encode("utf-8").decode(codec)
        except UnicodeDecodeError:
            continue
        assert any(r == w for r, _ in encoding.readings(bad)), (w, bad)


def test_decoding_table(spark):
    clean = ["Le café est fermé."] * 30 + ["Voilà — un été."] * 30 + ["Ein früher Zug — spät."] * 10
    bad = ["Le cafÃ© est fermÃ©.", "VoilÃƒÂ\xa0 — un Ã©tÃ©.", "Le caf� est là.", "Ein fr³her Zug."]
    fine = ['It shows "Ã©" on the page.', "Glyphs √, ├ and ┤.", "PÃO DE MAÇÃ", "", "plain ascii"]
    rows = [("t", str(i), "text", s) for i, s in enumerate(clean + bad + fine)] + [("t", "null", "text", None)]
    df = spark.createDataFrame(rows, "tbl string, rec string, field string, body string")
    got = {r.rec: r for r in encoding.restore(df).collect()}
    n = len(clean)
    assert set(got) == {str(n + k) for k in range(len(bad))}
    assert [got[str(n + k)].restored for k in range(4)] == ["Le café est fermé.", "Voilà — un été.", "Le café est là.", "Ein früher Zug."]
    assert encoding.garbled(df.where("rec = 'none'"))[0].count() == 0


def test_lost_character_beside_a_sound_one(spark):
    bad = ["Un “caf� noir.", "C’est qu’apr�s midi."]
    for known in ([], ["Un “café noir, c’est qu’après midi, un “café noir."] * 20):
        df = spark.createDataFrame([("t", str(i), "text", s) for i, s in enumerate(bad + known)], "tbl string, rec string, field string, body string")
        got = {r.rec: (r.restored, r.whole) for r in encoding.restore(df).collect()}
        assert set(got) == {"0", "1"} and all(encoding.LOST in t and not w for t, w in got.values())


def test_restored_by_place(spark):
    texts = [("un vÃ©lo2go ici", "un vélo2go ici"), ("na\ufffdve and \ufffd14, r\ufffdsum\ufffd", "naïve and €14, résumé"), ("So fun ðŸ˜€ and (cafÃ©) 12Ã©3", "So fun 😀 and (café) 12é3"), ("Ã©tÃ© vÃ©lo", "été vélo"), ("\ufffd alone", "\ufffd alone")]
    known = ["naïve résumé café", "it cost €14 or €33"] * 6
    df = spark.createDataFrame([("t", str(i), "text", s) for i, s in enumerate([a for a, _ in texts] + known)], "tbl string, rec string, field string, body string")
    got = {int(r.rec): (r.restored, r.whole) for r in encoding.restore(df).collect()}
    assert got == {i: (b, "\ufffd" not in b) for i, (_, b) in enumerate(texts)}


def test_sound_words_have_no_reading():
    for w in ("naïve", "Überweisung", "“quoted”", "—", "日本語", "привет", "😀", "l’été", "ÉTÉ", "señor", "½", "ßßß", "Łódź"):
        assert not [r for r in encoding.readings(w) if r[1] == "utf8"], w


# --- 5 -----------------------------------------------------------------------------------------------------


def test_pairs(spark):
    rng = random.Random(2)
    nouns = ["garden", "ladder", "kettle", "harbour", "window", "letter", "bridge", "market"]
    make = lambda k: " ".join(f"The {rng.choice(nouns)} was behind the {rng.choice(nouns)} and it is in the {rng.choice(nouns)}." for _ in range(k))
    rows = [(f"f{i}", f"Write a note about the {rng.choice(nouns)} and the {rng.choice(nouns)}.", make(6)) for i in range(260)]
    special = [("empty", rows[0][1], "<p></p>"), ("null", rows[0][1], None), ("copy", rows[1][1], "Sure! " + rows[1][1]), ("refusal", rows[2][1], "I'm sorry, but I can't help with that request."), ("cut", rows[3][1], make(5) + " The garden was behind the"), ("noprompt", None, make(6)), ("french", rows[4][1], "Le jardin est dans la maison et les lettres est une chose. " * 5), ("german", rows[4][1], "Der Garten ist nicht das Haus und die Leiter war ein Problem. " * 5)]
    df = spark.createDataFrame(rows + special, "file string, prompt string, text string")
    words = spark.createDataFrame([(k, w) for k, ws in COMMON.items() for w in ws], "lang string, word string")
    got = {r.file: r.defect for r in pairs.broken_pairs(df, words).collect()}
    want = {"empty": "empty", "null": "empty", "copy": "copy", "refusal": "refusal", "cut": "truncated", "french": "language", "german": "language"}
    assert {k: got.get(k) for k in want} == want and "noprompt" not in got
    assert sum(k[1:].isdigit() for k in got) <= 8
    assert pairs.broken_pairs(df.where("file = 'x'"), words).count() == 0


def test_long_refusals():
    rng = random.Random(3)
    nouns = ["garden", "ladder", "kettle", "harbour", "window", "letter", "bridge", "market"]
    make = lambda k: " ".join(f"The {rng.choice(nouns)} was behind the {rng.choice(nouns)} and it is in the {rng.choice(nouns)}." for _ in range(k))
    langs = pairs.Languages(COMMON)
    models, known = pairs.train([(f"Write a note about the {rng.choice(nouns)}.", make(6)) for _ in range(260)], langs)
    before = "Thank you for such a thoughtful brief about the harbour festival. I looked at every point you listed, from the tone to the number of words, and I can see how much the evening matters to the people who organise it each summer. It would be a pleasure to see it succeed."
    after = "The town hall or a local paper may have someone with the time and the right background for it, and they will know the families involved far better than any outsider could. I wish you a good season."
    decline = "After weighing all of that with care, however, I can't help with that request."
    judge = lambda text: pairs.classify("Write a note about the harbour.", text, langs, models, known)
    assert [judge(x) for x in (f"{before} {decline} {after}", f"{before} {after} {decline}", f"{decline} {before} {after}")] == ["refusal"] * 3
    assert judge(make(8)) is None
    say = "It is a theme with a long history, and people come to it from many sides. "
    for n in (1, 2, 4, 6, 9):  # as long as it may be
        assert judge(say * n + "I'm sorry, but I can't help with that request. " + say * n) == "refusal"
    assert judge(make(6) + "\n\n- the old ladder\n- a kettle") is None and judge(make(6) + "\n\n- the old ladder\n- the letter is behind the") == "truncated"


def test_pairs_hardly_depend_on_the_draw():
    rng = random.Random(8)
    nouns = ["garden", "ladder", "kettle", "harbour", "window", "letter", "bridge", "market", "cellar", "poster"]
    make = lambda k: " ".join(f"{rng.choice(['The', 'Their', 'One'])} {rng.choice(nouns)} was behind the {rng.choice(nouns)} and it is in the {rng.choice(nouns)}." for _ in range(k))
    ask = lambda: f"Write a note about the {rng.choice(nouns)} and the {rng.choice(nouns)} for the people of the town who could not come to the market."
    rows = []
    for i in range(900):
        p, t = ask(), make(rng.randrange(5, 12))
        if i % 12 == 0:
            t = rng.choice([p, "Sure! " + p, p.lower(), (p + "\n") * 3])
        elif i % 12 == 1:
            t = "I see what you are after, and it seems to mean a lot. Still, I cannot offer it, and I would rather tell you so than write something that helps nobody in the end, whatever it says."
        elif i % 12 == 2:
            t = "Le jardin est dans la maison et les lettres est une chose. " * rng.randrange(5, 9)
        elif i % 12 == 3:
            t = " ".join(t.split()[: -rng.randrange(2, 9)])
        rows.append((p, t))
    counts = []
    for seed in range(5):
        langs = pairs.Languages(COMMON)
        models, known = pairs.train(random.Random(seed).sample(rows, 300), langs)
        counts.append(Counter(pairs.classify(p, t, langs, models, known) for p, t in rows))
    for d in ("copy", "refusal", "language", "truncated"):
        got = [c[d] for c in counts]
        assert min(got) >= (0.8 if d == "truncated" else 0.95) * 75 and max(got) <= 1.1 * 75, (d, got)
    total = [900 - c[None] for c in counts]
    assert max(total) - min(total) <= 0.04 * max(total), counts


# --- 6 -----------------------------------------------------------------------------------------------------


def test_mail_lines_held_out():
    model = mail.train(["H: x\n\n" + " ".join(SENTENCES)], made=500)
    rng, bad, n = random.Random(77), 0, 0
    for _ in range(120):
        lines, labels, names = mail.make_mail(rng, SENTENCES)
        kept, f = mail.line_features(lines, names)
        bad += sum(mail.LABELS[y] != labels[i] for i, y in zip(kept, model.decode(mail._ids(f))))
        n += len(kept)
    assert bad / n < 0.02
    assert mail.label_mail("no empty line", model) == [] and mail.label_mail("", model) == []
    text = "From: joel.halvern@x.example\r\n\r\nHi Marta,\r\n\r\nThe printer was out of paper.\r\n\r\nBest,\r\nJoel\r\n\r\nMarta wrote on 2019-08-19:\r\n> old\r\n"
    assert [k for k, label in mail.label_mail(text, model) if label == "new"] == [3, 5]


def test_new_texts_and_lines_agree(spark):
    rows = [(1, "From: a@x.example\n\nThe roof is tight.\r\n\nIt rained.\n\nBest,\nAnn\n"), (2, None), (3, ""), (4, "no empty line"), (5, "From: a@x.example\n\n> old\n"), (1, "From: a@x.example\n\nThe roof is tight.\r\n\nIt rained.\n\nBest,\nAnn\n")]
    df = spark.createDataFrame(rows, "mail_id long, text string").withColumn("k", F.lit("clash")).withColumn("label", F.lit("clash"))
    got = sorted((r.mail_id, r.new_text) for r in mail.new_texts(df).collect())
    lines = {}
    for r in sorted(mail.label_lines(df.dropDuplicates(["mail_id"])).where("label = 'new'").collect(), key=lambda r: r.line_no):
        lines.setdefault(r.mail_id, []).append(r.line)
    assert [k for k, _ in got] == [1, 1, 2, 3, 4, 5] and all(t == "\n".join(lines.get(k, [])) for k, t in got) and got[0][1].startswith("The roof is tight.")
    assert mail.new_texts(df.limit(0)).count() == 0


def test_mail_wording_that_the_trainer_never_saw():
    """Parts of mails written for this test, in words that the made ones do not have."""
    model = mail.train(["H: x\n\n" + " ".join(SENTENCES)])
    head = "From: berta.ohm@x.example\nSubject: y\n\n"
    parts = [
        ("Morgen Jutta,\n\nThe roof is tight again.\n\nWarmly,\nBerta\n\n--\nBerta Ohm\nHead Gardener, Parks and Trees\nwww.parks.example\n\nThe contents of this mail are meant solely for the named recipient and any disclosure is unauthorised.\nKindly notify us and delete all copies.", {4, 6}),
        ("The roof is tight again, so come in.\n\nSent from my wristwatch", {4}),
        ("Jutta Pohl <j@x.example> wrote:\n> is the roof tight\n> or not\n\nHello Jutta,\n\nYes, since Monday it is tight.", {8, 10}),
        ("Yes, since Monday it is tight.\n\n-----Original Message-----\nFrom: Jutta\nSent: Monday\nTo: Berta\nSubject: roof\n\nIs the roof tight, or do we wait?", {4}),
    ]
    right, n = 0, 0
    for body, want in parts:
        got = mail.label_mail(head + body, model)
        right += sum((label == "new") == (k in want) for k, label in got)
        n += len(got)
    assert right / n >= 0.9, (right, n)  # a lone short line after a greeting at the end may pass for a signature


# --- 7 -----------------------------------------------------------------------------------------------------


def test_sample(spark):
    df = spark.range(2000).withColumnRenamed("id", "post_id").withColumn("id", F.lit("clash"))
    a = {r.post_id for r in sample.draw(df.repartition(7), 100, "post_id").collect()}
    b = {r.post_id for r in sample.draw(df.coalesce(1), 100, "post_id").collect()}
    assert a == b and len(a) == 100
    assert sample.draw(df, 5000, "post_id").count() == 2000 and sample.draw(df, 0, "post_id").count() == 0
    assert sample.draw(df.limit(0), 5, "post_id").count() == 0
    hits = Counter(r.post_id % 4 for s in range(12) for r in sample.draw(df, 100, "post_id", seed=s).collect())
    assert all(230 < hits[k] < 370 for k in range(4))


# --- 8 -----------------------------------------------------------------------------------------------------


def test_automaton_against_brute_force():
    rng = random.Random(4)
    items = [[rng.choice("abcd") for _ in range(30)] for _ in range(6)]
    auto = leak.Automaton(items)
    for _ in range(60):
        doc = [rng.choice("abcde") for _ in range(40)]
        for a, b, state in auto.spans(doc, 2):
            inside = {k for k, it in enumerate(items) if any(it[i : i + b - a] == doc[a:b] for i in range(len(it)))}
            assert inside == auto.items[state] and inside
        longest = max((b - a for a, b, _ in auto.spans(doc, 1)), default=0)
        brute = max((n for n in range(1, 31) for i in range(40 - n + 1) if any(it[j : j + n] == doc[i : i + n] for it in items for j in range(31 - n))), default=0)
        assert longest == brute


def test_leaks(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(60))) for k in range(5)] + [(9, None)]
    ws = items[0][1].split()
    part = ws[10:40]
    part[7] = "changed"
    docs = [(1, "lead in text " + "  ".join(f"**{w.upper()}**," for w in part) + " tail"), (2, " ".join(ws[:12])), (3, None), (4, ""), (5, items[1][1] + " " + items[2][1]), (6, " ".join(rng.sample(ws, 60)))]
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leak.leaks(d, it).collect()} == {(1, 0), (5, 1), (5, 2)}
    clean = {r.doc_id: r for r in leak.without_leaks(d, it).collect()}
    assert clean[5].removed == 2 and not clean[5].text.strip() and clean[3].text is None and clean[2].removed == 0


def test_matches_of_every_item():
    rng = random.Random(5)
    items = [[rng.choice("abc") for _ in range(25)] for _ in range(5)]
    items.append(items[0][5:15])
    auto = leak.Automaton(items)
    for _ in range(40):
        doc = [rng.choice("abcd") for _ in range(40)]
        got = auto.item_spans(doc, 3)
        for k, it in enumerate(items):
            ends = {j: max((n for n in range(3, j + 1) if any(it[p : p + n] == doc[j - n : j] for p in range(len(it) - n + 1))), default=0) for j in range(41)}
            assert set(got.get(k, ())) == {(j - n, j) for j, n in ends.items() if n and ends.get(j + 1) != n + 1}


def test_nested_and_near_equal_items():
    rng = random.Random(8)
    long = [f"w{rng.randrange(500)}" for _ in range(90)]
    near = [w if k % 20 != 10 else f"x{k}" for k, w in enumerate(long)]
    items = [(1, " ".join(long)), (2, " ".join(long[20:60])), (3, " ".join(near)), (4, " ".join(["other"] + long[5:35] + ["end"] * 20)), (5, "nothing of it at all")]
    assert {x[0] for x in leak.Matcher(items).leaks("before it " + " ".join(long) + " after it")} == {1, 2, 3, 4}


def test_every_stretch_and_long_runs(spark):
    rng = random.Random(12)
    ws = [f"w{rng.randrange(900)}" for _ in range(120)]
    item, part, other = " ".join(ws), " ".join(ws[:45]), " ".join(ws[70:])
    short, run = " ".join(ws[50:62]), " ".join(ws[50:80])
    docs = [(1, f"a {item} b {item} c"), (2, f"a {other} b {part} c"), (3, f"a {run} b"), (4, f"a {short} b"), (5, f"a {part} b " + "filler " * 300 + f"{other} c {item} d {run} e")]
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    assert Counter(r.doc_id for r in leak.leaks(d, it).collect()) == {1: 2, 2: 2, 3: 1, 5: 4}
    clean = {r.doc_id: " ".join(r.text.split()) for r in leak.without_leaks(d, it).collect()}
    assert clean == {1: "a b c", 2: "a b c", 3: "a b", 4: f"a {short} b", 5: "a b " + "filler " * 300 + "c d e"}


# --- 9 -----------------------------------------------------------------------------------------------------


def test_water_filling():
    used = mix.water_fill({"a": 100, "b": 1000, "c": 10}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 2, "b": 1, "c": 3})
    assert used["a"] == 2 and used["c"] == 3 and abs(used["b"] - (1110 - 230) / 1000) < 1e-9
    assert mix.water_fill({}, {"a": 1.0}, {"a": 2}) == {} and mix.water_fill({"a": 0}, {"a": 1.0}, {"a": 2}) == {}
    small = mix.water_fill({"a": 10, "b": 10}, {"a": 0.9, "b": 0.1}, {"a": 9, "b": 9}, budget=10)
    assert abs(small["a"] - 0.9) < 1e-9 and abs(small["b"] - 0.1) < 1e-9


def test_mix(spark):
    docs = [(i, "a" if i % 3 else "b", " ".join(["word"] * (1 + i % 7)) if i % 50 else None) for i in range(900)] + [(9999, "free", "x"), (9998, None, "x")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    m = mix.mix(mix.counted_documents(d, t), t)
    rows = m.collect()
    assert {r.source for r in rows} == {"a", "b"} and max(r.uses for r in rows if r.source == "a") == 1 and max(r.uses for r in rows if r.source == "b") <= 3
    got = {r.source: r.actual_share for r in mix.shares(m, t).collect()}
    assert abs(got["a"] - 0.5) < 0.05 and got["none"] == 0


# --- 10 ----------------------------------------------------------------------------------------------------

NAMES = (frozenset({"Rafe", "Frank", "Mirela"}), frozenset({"Harrowgill", "Van der Osterwyn", "de la Rocavert", "O'Kellerin"}))
KNOWN = lambda g, f: g in NAMES[0] and f in NAMES[1]


@pytest.mark.parametrize(("text", "want"), [
    ("Write to rafe.h@kontor.example, please.", [("email", "rafe.h@kontor.example")]),
    ("Copy rafe (at) mail (dot) oakdesk (dot) test on it", [("email", "rafe (at) mail (dot) oakdesk (dot) test")]),
    ("Mail: rafe AT kontor DOT example\nnext", [("email", "rafe AT kontor DOT example")]),
    ("The subject line “Draft at desk dot final” was for jokes", []),
    ("Call (617) 555-0125 after six, or 312.555.0136 ext. 4.", [("phone", "(617) 555-0125"), ("phone", "312.555.0136")]),
    ("Tel: +44 (0)113 496 0878", [("phone", "+44 (0)113 496 0878")]), ("Mon numéro est le 02.61.91.71.98, merci", [("phone", "02.61.91.71.98")]),
    ("SSN 908-39-0562 was on it", [("id_number", "908-39-0562")]), ("Ausweis: 06 877 752 341", [("id_number", "06 877 752 341")]), ("DNI, 00.036.364-R, a", [("id_number", "00.036.364-R")]),
    ("ISBN 978-0-00-55501-4, order 4471-902-11, invoice 2016-004512, version 10.4.2.118, #48211907", []),
    ("at 161B Old Mill Road with", [("address", "161B Old Mill Road")]), ("au 53 bis, chemin du Lavoir, merci", [("address", "53 bis, chemin du Lavoir")]), ("Große Mühlenstraße 12a", [("address", "Große Mühlenstraße 12a")]), ("Calle del Almendro 37 cada", [("address", "Calle del Almendro 37")]),
    ("Mrs Rafe A. Harrowgill and Mirela Van der Osterwyn", [("name", "Mirela Van der Osterwyn"), ("name", "Rafe A. Harrowgill")]), ("Frank Talk is a column", []), ("RAFE O'KELLERIN", [("name", "RAFE O'KELLERIN")]),
    ("ring two one zero five five five zero one two three now", [("phone", "two one zero five five five zero one two three")]),
    ("ｒａｆｅ＠kontor.example", [("email", "ｒａｆｅ＠kontor.example")]), ("", []),
])
def test_pii(text, want):
    assert sorted({(k, text[a:b]) for a, b, k in pii.find(text, KNOWN)}) == sorted(want)


def test_pii_tables(spark):
    docs = [(i, f"Thanks to {g} {f} for it.") for i, (g, f) in enumerate((g, f) for g in ("Ana", "Bea", "Cleo") for f in ("Foxley", "Garmond", "Hillsby"))]
    docs += [(50 + i, f"Thanks to Dora {f}.") for i, f in enumerate(("Foxley", "Garmond", "Hillsby"))] + [(90, "Ana Lysis is a word game."), (91, None), (92, "")]
    d, g = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("Ana",), ("Bea",), ("Cleo",), (None,)], "given_name string")
    names = pii.learn_names(d, g)
    known = [{r[0] for r in x.collect()} for x in names]
    assert "Dora" in known[0] and known[1] == {"Foxley", "Garmond", "Hillsby"}
    got = {r.doc_id for r in pii.findings(d, names).collect()}
    assert got == set(range(9)) | {50, 51, 52}
    red = {r.doc_id: r.text for r in pii.redacted(d, names).collect()}
    assert red[0] == "Thanks to [NAME] for it." and red[90] == docs[-3][1] and red[91] is None and red[92] == ""


def test_names_by_ratio_at_every_size(spark):
    one = ["Edited by Ana Grandvoile in one sitting.", "Frank Talk is a column, not a man.", "Nobody but Quorin L. Grandvoile had a key."]
    chance = [f"Photo: {f}, {g} Then it rained." for f in ("Foxley", "Garmond", "Hillsby") for g in ("Ana", "Bea", "Cleo")]
    rest = ["Then it was late. We sat there and then we left."] * 10
    g = spark.createDataFrame([("Ana",), ("Bea",), ("Cleo",), ("Frank",)], "given_name string")
    for times in (1, 20):
        texts = (one + chance + rest * 9) * times
        d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        names = pii.learn_names(d, g)
        given, family = ({r[0] for r in x.collect()} for x in names)
        assert family == {"Grandvoile"} and given == {"Ana", "Bea", "Cleo", "Frank", "Quorin"}
        assert [{t[a:e] for a, e, _ in pii.find(t, lambda x, y: x in given and y in family)} for t in texts[:3]] == [{"Ana Grandvoile"}, set(), {"Quorin L. Grandvoile"}]


def test_more_names_than_memory_holds(spark, monkeypatch):
    docs = [(i, f"Yesterday I met Ana Grandvoile and {g} Okonjwe, said {g} Tellmore.") for i, g in enumerate(["Ana", "Rafe", "Ilka"])] + [(9, None), (10, "ANA GRANDVOILE called 020 7946 0378.")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    g = spark.createDataFrame([("Ana",), ("Rafe",), ("Ilka",)], "given_name string")
    names = pii.learn_names(d, g)
    few = sorted(map(tuple, pii.findings(d, names).collect())), sorted(map(tuple, pii.redacted(d, names).fillna("").collect()))
    monkeypatch.setattr(pii, "NAMES", 1)
    many = sorted(map(tuple, pii.findings(d, names).collect())), sorted(map(tuple, pii.redacted(d, names).fillna("").collect()))
    assert few == many and len(few[0]) > 5


def test_numbers_by_what_stands_around_them():
    for text, want in (
        ("His tax id: 943163712 was on the form.", "id_number"), ("El teléfono de la tienda es 943163712, por si quieres llamar para reservar.", "phone"), ("The permit 943163712 was issued in May.", "id_number"),
        ("You will find the form in the hall, and the 943163712 is what it says on it.", "id_number"), ("Puedes ir con las cajas que están por la tarde, el 943163712 para todo.", "phone"),
    ):
        assert [k for _, _, k in pii.find(text, KNOWN)] == [want], text
    assert [k for _, _, k in pii.find("We met at 12 Mill Lane, near the 14 Mill Lane Bakery.", KNOWN)] == ["address"]


def test_any_number_of_items(spark, monkeypatch):
    rng = random.Random(4)
    passage = lambda: " ".join(rng.choice(["ember", "lantern", "quarry", "willow", "copper", "saddle", "meadow", "thimble"]) + str(rng.randrange(50)) for _ in range(30))
    items = [(i, passage()) for i in range(9)] + [(90, None), (91, "")]
    docs = [(i, f"before it all {t} and then {items[(i + 1) % 9][1]} after") for i, t in items[:9]] + [(50, None), (51, ""), (50, items[0][1])]
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted(tuple("" if v is None else v for v in r) for r in df.collect())
    one = key(leak.leaks(d, it)), key(leak.without_leaks(d, it))
    monkeypatch.setattr(leak, "SHARD_WORDS", 70)
    assert (key(leak.leaks(d, it)), key(leak.without_leaks(d, it))) == one and len(one[0]) == 19
    assert leak.leaks(d, it.where("item_id > 100")).count() == 0 and leak.without_leaks(d, it.where("item_id > 100")).count() == len(docs)
