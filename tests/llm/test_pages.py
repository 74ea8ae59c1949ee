"""Operators that judge text, on small pages of known content."""

import itertools
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import furniture, language, pii, prose
from tests.llm.test_exact import NASTY, docs

NOUNS = "printer ledger harbour window carpenter valley mirror orchard postcard ranking".split()
VERBS = "sorts paints visits repairs copies measures forgets rewrites".split()


def sentence(rng):
    return f"The {rng.choice(NOUNS)} {rng.choice(VERBS)} the {rng.choice(NOUNS)} before the {rng.choice(NOUNS)} of number {rng.choice(NOUNS)} opens in the {rng.choice(NOUNS)}."


SITES = {
    "north-press.example": (["Products", "Pricing", "Careers", "Support"], "We and our vendors use tracking technologies", "Sign up for updates"),
    "quiet-room.test": (["Menü", "Wohnen", "Garten", "Technik"], "Datenschutz und Impressum", "Kurz notiert"),
    "old-mill.example": (["Start", "Listings", "Agents", "Sell"], "Privacy Policy of the group", "More for you"),
    "far-coast.test": (["Rubriques", "Idées", "Livres", "Radio"], "Mentions diverses", "Encore"),
}


def page(rng, site):
    """Lines of a page and which are furniture; menus, notices and boxes differ by site, bodies by page."""
    menu, notice, head = SITES[site]
    body = [(sentence(rng) + " " + sentence(rng), False) for _ in range(rng.randint(2, 5))]
    box = [(head, True)] + [(f"A {rng.choice(NOUNS)} for the {rng.choice(NOUNS)} and {rng.choice(NOUNS)}", True) for _ in range(rng.randint(2, 3))]
    at = rng.randint(1, len(body) - 1)
    lines = [(x, True) for x in menu] + body[:at] + box + body[at:] + [(notice, True), (f"© {rng.randint(1990, 2020)} {site}", True)]
    if rng.random() < 0.5:
        lines = [(" | ".join(menu), True), *lines[len(menu) :]]
    return lines


def corpus(seed, n, sites=tuple(SITES)):
    rng = random.Random(seed)
    return [(i, page(rng, s := rng.choice(sites)), s) for i in range(n)]


BODY = "The long day\nThe printer sorts the ledger before the doors open. It took four weeks before anyone saw that.\nNobody knows why the harbour is so quiet, and that is the point."


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, "\n".join(x for x, _ in lines), s) for i, lines, s in corpus(1, 160)]
    return spark.createDataFrame(rows, "id long, text string, site string")


@pytest.fixture(scope="module")
def model(pages):
    return furniture.train(pages)


def test_no_phrases_are_written_down():
    source = open(furniture.__file__).read().lower()
    assert not [w for w in ("cookie", "accept all", "newsletter", "impressum", "rights reserved", "comments", "版权") if w in source]


def test_furniture_is_learned_from_repetition(model):
    right = wrong = missed = 0
    for _, lines, s in corpus(2, 60):
        _, states = model.page("\n".join(x for x, _ in lines), s)
        for (_, want), got in zip(lines, states, strict=True):
            right += want and got > 0
            missed += want and got == 0
            wrong += got > 0 and not want
    assert right / (right + missed) > 0.95 and right / (right + wrong) > 0.95


def test_held_out_site_is_read_by_shape(spark):
    """Furniture of a site that training has not seen: its words are unknown, its shape and place are not."""
    others = [s for s in SITES if s != "old-mill.example"]
    rows = [(i, "\n".join(x for x, _ in lines), s) for i, lines, s in corpus(3, 160, others)]
    held = furniture.train(spark.createDataFrame(rows, "id long, text string, site string"))
    right = total = wrong = 0
    for _, lines, s in corpus(4, 40, ["old-mill.example"]):
        _, states = held.page("\n".join(x for x, _ in lines), s)
        right += sum(w and g > 0 for (_, w), g in zip(lines, states, strict=True))
        wrong += sum(g > 0 and not w for (_, w), g in zip(lines, states, strict=True))
        total += sum(w for _, w in lines)
    assert right / total > 0.7 and right / (right + wrong) > 0.9


def test_copies_of_a_page_are_no_furniture(spark):
    rng = random.Random(7)
    lines = page(rng, "north-press.example")
    rows = [(i, "\n".join(x for x, _ in y), s) for i, y, s in corpus(6, 80)]
    rows += [(1000 + i, "\n".join(x for x, _ in lines), s) for i in range(30) for s in ["north-press.example"]]
    _, states = furniture.train(spark.createDataFrame(rows, "id long, text string, site string")).page("\n".join(x for x, _ in lines), "north-press.example")
    assert [s > 0 for (_, w), s in zip(lines, states, strict=True) if not w] == [False] * sum(not w for _, w in lines)


def test_viterbi_finds_the_best_path(model):
    lines = page(random.Random(5), "north-press.example")[:6]
    _, gap, seen = model.read("\n".join(x for x, _ in lines), "north-press.example")
    scores = model.scores(gap, seen)

    def score(path):
        return sum(scores[i][k] for i, k in enumerate(path)) + sum(model.pair[a, b] for a, b in itertools.pairwise(path))

    best = max(itertools.product(range(3), repeat=len(scores)), key=score)
    assert score(model.path(scores)) == pytest.approx(score(best))


def test_decoding_sums_the_weights_of_the_features(model):
    for _, lines, s in corpus(8, 5):
        text = "\n".join(x for x, _ in lines)
        whole = [[sum(model.weights.get(k, (0, 0, 0))[j] for k in f) for j in range(3)] for f in furniture.features(furniture.blocks(text, s), model.heads)]
        _, gap, seen = model.read(text, s)
        assert [y for x in model.scores(gap, seen) for y in x] == pytest.approx([y for x in whole for y in x])


def test_partial_labels_raise_the_likelihood_of_allowed_paths(model):
    feats = [[["a"], ["b"], ["a"]], [["a"], ["b"]]] * 5
    labels = [[furniture.LABELS[0], furniture.LABELS[1], furniture.OPEN], [furniture.LABELS[0], furniture.OPEN]] * 5
    m = furniture.fit(list(zip(feats, labels, strict=True)))
    assert m.path([list(m.weights["a"]), list(m.weights["b"]), list(m.weights["a"])]) == [0, 1, 0]
    assert furniture.fit([]).path([[0.0, 0.0, 0.0]]) == [0]


def test_furniture_of_nasty_pages(spark, model):
    lines = page(random.Random(9), "north-press.example")
    text = "\n".join(x for x, _ in lines)
    d = docs(spark, [*NASTY, (20, text)], site="north-press.example")
    got = {r.line_no for r in furniture.furniture_lines(d, model).where("id = 20").collect()}
    assert got == {i for i, (_, w) in enumerate(lines) if w}
    bodies = {r.id: r.body for r in furniture.main_bodies(d, model).collect()}
    assert bodies[1] is None and bodies[2] == "" and bodies[20] == "\n".join(x for x, w in lines if not w) and len(bodies) == len(NASTY) + 1
    assert furniture.furniture_lines(docs(spark, [])).count() == 0
    assert furniture.furniture_lines(docs(spark, NASTY, site=None)).count() >= 0


@pytest.mark.parametrize(
    "text, junk",
    [
        (BODY, False),
        ("- one lamp\n- the bright harbour\n- 3 kg flour\n- every weekly ledger", True),
        ("Heading\nNorvor: the lamp\nOstel: one harbour\nRimar: the weekly ledger", True),
        ("a | b | c\n--- | --- | ---\nx | 3 | 4\ny | 5 | 6", True),
        ("name;count;share\nlamp;31;4%\nharbour;7;9%", True),
        ("12 33 4 5\n7 81 2 3\n99 1 0 4", True),
        ("xkcdqw zrtpl qpwmnb lkjh\nvbnm qwrt plkm zxcv dfgh\nqwsd rtfg vbhn mklp zzxq", True),
        ("10:31:02 ERR [a.b] code=4\n10:31:09 INFO [c.d] code=7", True),
        ("foo(bar[3], x) == baz.qux();\nif (x) { y = z(); }\nfor (i = 0; i < n; i++) {", True),
        ("anna12: The lamp is out, and nobody knows why.\nbert7: It is still on in the harbour.\nanna12: So it is.", False),
        ("– The lamp is out, and nobody knows why it is.\n– It is still on in the harbour of the town.", False),
        ("the lamp was out when we\ncame to the harbour, and the\nprinter said that it had been\nso for weeks.", False),
        ("我们在港口学到的东西很简单：灯已经熄灭了，没有人知道为什么。\n过了四个星期，大家才发现这一点。", False),
        ("• 灯塔\n• 多语言的港口\n• 词典", True),
    ],
)
def test_line_classes(text, junk):
    assert (prose.statistics(text)[7] > 0.5) == junk


def test_statistics_of_nasty_records(spark):
    d = docs(spark, [*NASTY, (20, BODY), (21, "- a lamp\n- the harbour\n- one ledger")])
    measured = prose.measure(d)
    got = {r.id: r for r in prose.outliers(measured, ["id"]).collect()}
    assert set(got) == {4, 5, 6, 7, 8, 9, 20, 21}
    assert all(r.score >= 0 for r in got.values()) and got[21].junk_share == 1.0
    assert prose.outliers(prose.measure(docs(spark, [])), ["id"]).count() == 0


EN = "The printer sorts the ledger before the doors open. It took four weeks before anyone saw that. Nobody knows why."
DE = "Die Lampe ist aus und niemand weiß warum. Der Hafen liegt hinter der Mühle und das Museum neben dem Fluss."
FR = "La lampe est dans le port et personne ne sait pourquoi. Il y avait une fontaine au bord du fleuve pour les visiteurs."
ZH = "我们在港口学到的东西很简单。灯已经熄灭了，没有人知道为什么。过了四个星期大家才发现。"


def test_languages(spark):
    known = [(i, t, x) for i, (t, x) in enumerate([(EN, "en"), (DE, "de"), (FR, "French"), (ZH, "zh-CN")] * 6)]
    odd = [(100, EN, "de"), (101, DE, None), (102, DE + " " + FR, "de"), (103, EN, "en-GB"), (104, None, "en"), (105, "", None), (106, "zu kurz", "en"), (107, FR, "zxx"), (108, ZH, "xx"), (109, EN * 2000, "  ")]
    d = spark.createDataFrame(known + odd, "id long, text string, label string").withColumn("site", F.lit("a-site.example")).withColumn("url", F.lit(None).cast("string")).withColumn("words", F.lit(1)).withColumn("lang", F.lit("x"))
    found = language.languages(d)
    rows = {r.id: r for r in found.collect()}
    assert 104 not in rows and rows[106].lang is None and all(0 < r.confidence <= 1 for r in rows.values() if r.lang)
    assert {(r.id, r.lang) for r in language.cases(found).collect()} == {(100, "en"), (101, "de"), (102, "de"), (102, "fr"), (107, "fr"), (108, "zh"), (109, "en")}
    assert language.cases(language.languages(d.where("false"))).count() == 0
    cut = {(r.id, r.lang): (DE + " " + FR)[r.start_pos : r.end_pos] for r in language.segments(found).where("id = 102").collect()}
    assert cut == {(102, "de"): DE, (102, "fr"): FR}
    whole = language.segments(found).where("id = 103").collect()
    assert [(r.seg_no, r.start_pos, r.end_pos, r.lang) for r in whole] == [(0, 0, len(EN), "en")] and 0.9 < whole[0].confidence <= 1
    assert language.segments(found).where("id in (104, 105, 106)").count() == 0


def test_segments_have_offsets_of_the_page(spark):
    """Furniture between, letters whose lower case is longer, and three stretches."""
    model = language.word_model(spark.createDataFrame([(t * 3, x) for t, x in ((EN, "en"), (DE, "de"), (FR, "fr"), (ZH, "zh"))], "text string, label string"))
    judge = language.Judge(model)
    kept = [(0, "İİİ it was here before. " + EN), (200, ""), (260, DE), (500, EN)]
    body = "\n".join(x for _, x in kept)
    got = language.page_segments(judge, body, kept)
    assert [(g["lang"], g["start"], g["end"]) for g in got] == [("en", 0, len(EN) + 24), ("de", 260, 260 + len(DE)), ("en", 500, 500 + len(EN))]
    assert all(0.9 < g["confidence"] <= 1 for g in got) and judge.segments("") == [] and judge.segments("!!! ...") == []


def test_labels_are_trusted_as_far_as_texts_confirm_them(spark):
    names = [f.split()[0] for f in language._SCHEMA.split(", ")[:-1]]
    row = lambda i, label, best: {"id": i, "label": label, "words": 50, "bare": False} | {f"l_{x}": 0.0 if x == best else -50.0 for x in language.LANGUAGES} | {f"s_{x}": 0 for x in language.LANGUAGES}
    rows = [row(i, "en", "en" if i < 30 else "de") for i in range(40)] + [row(90, "fr", "fr")]
    found = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(language._SCHEMA.split(", ")[:-1]))
    right = language.label_reliability(found)
    assert right["en"] == pytest.approx(46 / 60) and right["fr"] == pytest.approx(17 / 21) and right["pt"] == 0.8


LEARNED = pii.Learned(frozenset({"shaw", "bury", "illon", "oux", "eau", "rink"}), frozenset("汐笙"))
FINDER = pii.Finder(frozenset({"Nora", "Élodie", "Jörg"}), frozenset({"陈"}), learned=LEARNED)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Write to mailto:a.b+list@some-mail.example if", [("email", "a.b+list@some-mail.example")]),
        ("ask (ulm_18 [at] horfen-mail [dot] invalid) or x@y", [("email", "ulm_18 [at] horfen-mail [dot] invalid")]),
        ("Write to the desk @Nelor on the board", []),
        ("Call (463) 555-0117 before noon and ask for Nora Istshaw.", [("phone", "(463) 555-0117"), ("name", "Nora Istshaw")]),
        ("tel: +44 1632 960 761", [("phone", "+44 1632 960 761")]),
        ("+33 (0)1 99 00 76 40 avant midi", [("phone", "+33 (0)1 99 00 76 40")]),
        ("联系电话：10033153315，我的身份证号是999056197504053644，至今", [("phone", "10033153315"), ("id_number", "999056197504053644")]),
        ("Meine Ausweisnummer lautet 00 314 652 028. Der", [("id_number", "00 314 652 028")]),
        ("My identity number is QQ 12 34 56 A and I", [("id_number", "QQ 12 34 56 A")]),
        ("documento 05.515.655-Y, domicilio Plaza de la Stotav, 171", [("id_number", "05.515.655-Y"), ("address", "Plaza de la Stotav, 171")]),
        ("The order reference is 4268-5439-26 and the catalogue lists shelf mark 5900 1193 99 under", []),
        ("Version 2.38.5 fixed ticket 87414963. Checksum 55234490155523 did", []),
        ("living at Flat 9, 62 Horeyjun Road, Corton", [("address", "Flat 9, 62 Horeyjun Road")]),
        ("an Riwenristraße 186a, 00459 Bel", [("address", "Riwenristraße 186a")]),
        ("au 29 bis impasse des Kelbel, 00702", [("address", "29 bis impasse des Kelbel")]),
        ("寄到岚明市河银区紫白大道9号4单元", [("address", "岚明市河银区紫白大道9号")]),
        ("Le Dr Osbury a dit à Mme Junoux et à M. Feneau que", [("name", "Osbury"), ("name", "Junoux"), ("name", "Feneau")]),
        ("signed by O. Osbury, not by Fallornor Bridge or Linos Valley", [("name", "O. Osbury")]),
        ("stehen Solistbrink, Jörg, wohnhaft", [("name", "Solistbrink, Jörg")]),
        ("表由陈汐笙签字。那一周晚些时候", [("name", "陈汐笙")]),
        ("ÉLODIE QUILTAVILLON a signé", [("name", "ÉLODIE QUILTAVILLON")]),
        ("John Smith called", [("name", "John Smith")]),
        ("Maria Garcia and Peter Johnson met", [("name", "Maria Garcia"), ("name", "Peter Johnson")]),
        ("Angela Merkel spoke", [("name", "Angela Merkel")]),
        ("Yesterday Dr Watson came", [("name", "Watson")]),
        ("张伟 今天来了", [("name", "张伟")]),
        ("card 4111 1111 1111 1111", [("id_number", "4111 1111 1111 1111")]),
        ("card 4111 1111 1111 1112", []),
        ("Order 4111 1111 1111 1111", []),
        ("IBAN GB82 WEST 1234 5698 7654 32", [("id_number", "GB82 WEST 1234 5698 7654 32")]),
        ("GB82 WEST 1234 5698 7654 33", []),
        ("SSN 536-90-4399", [("id_number", "536-90-4399")]),
        ("it says 12345678A there", []),
        ("it says 12345678Z there", [("id_number", "12345678Z")]),
        ("the documento 12345678A there", [("id_number", "12345678A")]),
        ("x " + "a" * 100 + "@some-mail.example", [("email", "a" * 100 + "@some-mail.example")]),
        ("under the letter Q. What we learned", []),
        ("", []),
    ],
)
def test_mentions(text, want):
    assert [(s.kind, text[s.start : s.end]) for s in FINDER.find(text)] == want


def test_names_are_learned_from_counts(spark):
    rows = [(i, f"We met {g} {s} there. The {s.title()} Bridge is old, and Wolfgang came.") for i, (g, s) in enumerate((g, a + "thwick") for g in ("Nora", "Peter", "Dr", "Mrs") for a in ("Os", "Mar", "Hel"))]
    rows += [(100 + i, f"标注表由陈{c}签字。陈{c}来了，陈{c}走了。") for i, c in enumerate("汐汐汐")] + [(200, None), (201, ""), (203, "大家都走了。" * 9 + "他来了。" * 9), (202, "The Harbour and the Window. " * 3000)]
    learned = pii.learn(spark.createDataFrame(rows, "id long, text string"), frozenset({"Nora"}), frozenset({"陈"}))
    assert "wick" in learned.endings and not {"bour", "ndow"} & learned.endings and learned.zh_given == {"汐"}
    finder = pii.Finder(learned=learned)
    assert [s[:3] for s in finder.find("Then Wilbur Belthwick sang, and 陈汐 too.")] == [(5, 21, "name"), (32, 34, "name")] or [s.start for s in finder.find("Then Wilbur Belthwick sang, and 陈汐 too.")] == [0, 32]
    assert pii.learn(spark.createDataFrame([], "id long, text string")) == pii.Learned()


def test_many_spans_take_little_time():
    text = "Ask a.b@some-mail.example or call (463) 555-0117. " * 4000
    began = time.perf_counter()
    spans = FINDER.find(text)
    assert len(spans) == 8000 and time.perf_counter() - began < 20
    assert all(a.end <= b.start for a, b in itertools.pairwise(spans))


def test_iban():
    assert pii.iban("DE89 3704 0044 0532 0130 00") and not pii.iban("DE89 3704 0044 0532 0130 01") and not pii.iban("DE89")


def test_check_digits():
    assert pii.luhn("79927398713") and not pii.luhn("79927398714") and not pii.luhn("")
    assert pii.mod23("12345678Z") and pii.mod23("X1234567L") and not pii.mod23("12345678A")
    assert pii.iso7064_11_2("11010519491231002X") and not pii.iso7064_11_2("110105194912310021")
    assert pii.mod97("255081416802538") and pii.iso7064_11_10("86095742719") and pii.mod11_weighted("123456789")


def test_masking(spark):
    d = docs(spark, [*NASTY, (20, "Ask Nora Istshaw (n.ist@some.example), tel: 502-555-0151.")])
    names = spark.createDataFrame([("Nora", "given"), (None, "given")], "name_form string, form_kind string")
    out = {r.id: r for r in pii.redact(d, names).collect()}
    assert out[20].text == "Ask [NAME] ([EMAIL]), tel: [PHONE]." and out[20].n_masked == 3
    assert out[1].text is None and out[8].text == "same text, same text" and len(out) == len(NASTY) + 1
    spans = pii.mentions(d, names).where("id = 20").orderBy("start_pos").collect()
    assert [(r.start_pos, r.kind) for r in spans] == [(4, "name"), (18, "email"), (44, "phone")]
    assert pii.mentions(docs(spark, [])).count() == 0


def test_junk_record_alone_in_its_language_is_found(spark, monkeypatch):
    from millrace.llm import queries

    rows = [("documents", 1, "en", 0.0, True, 0.9), ("documents", 2, "de", 4.0, True, 0.9), ("documents", 3, "de", 1.0, True, 0.1), ("documents", 4, "fr", 0.0, False, 0.9), ("documents", 5, "", float("inf"), True, 0.0)]
    measured = spark.createDataFrame(rows, "rec_table string, id long, lang string, layout_score double, counted boolean, junk_share double")
    monkeypatch.setattr(queries, "_quality", lambda s, folder: measured)
    assert sorted(r.rec_id for r in queries.p5_found(spark, "").collect()) == [1, 2, 5]


def test_noise_that_ends_as_sentences_is_no_language():
    assert prose.mostly_bare(["#7f 91 == 88 41 ## 20 93 %% 17.", "Ã¤Ã¶ Ã¼Ã© Ã¢Â€ Ã±Ã³ Ã¨Ã´ Ã«Ã¯ Ã¥Ã¸."] * 2) and prose.mostly_bare([])
    assert not prose.mostly_bare(["The river was high in the morning and we went home."] * 4)


def test_quick_look_agrees_with_the_classes():
    rng = random.Random(31)
    kinds = ["The river was high in the morning and we went home.", "a | b | c", "x | 3 | 4", "12 33 4 5", "- one lamp", "a short line", "xkcdqw zrtpl qpwmnb lkjh", "10:31:02 ERR [a.b] code=4", "the lamp was out when we came to the harbour and"]
    for _ in range(500):
        lines = [rng.choice(kinds) for _ in range(rng.randint(1, 9))]
        assert prose.mostly_bare(lines) == (sum(c in (prose.ROW, prose.NONE) for c in prose.line_classes(lines)) * 2 > len(lines))


MIXED = st.text(alphabet=st.sampled_from("aZ éÉßœÿ÷ǅΣİ中文。！”」』）…．.!?\"')]’» \t　\x1f0٣²_-/|;；:：,#@x\n"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(MIXED)
def test_fast_ways_agree_with_their_plain_definitions(text):
    plain = "".join(prose._ACCENTS.get(c, c) for c in text.lower())
    assert prose.plain(text) == plain
    assert prose.words_of(plain) == re.findall(r"[^\W\d_]+", plain)
    assert language.tokens(text) == language._TOKEN.findall(plain)
    assert language._SENTENCE.split(plain) == re.split(r"[.!?…]+[\"”»’')\]]*\s+|[。！？]+[”’」』）\"]*", plain)
    for line in text.split("\n"):
        assert prose.ends(line) == bool(re.search(r"[.!?。！？…][\"”»“’')\]）」』]*\s*$", line))
        assert furniture._ends(line.strip()) == bool(re.search(r"[.!?。！？…][\"”»“’')\]）]*$", line.strip()))
        if not (n := furniture.normal(line.strip())) or len(n) > 40 and furniture._ends(line.strip()):
            continue
        tokens = furniture._TOKEN.findall(n)
        words = [w for w in tokens if w[0].isalnum()]
        if not furniture._HAN.search(n) and words:
            assert {"<" + " ".join(words[:2]), ">" + " ".join(words[-2:])} <= set(furniture.read_line(line, ()).keys)


def test_start_of_a_long_line_is_that_of_its_form():
    rng = random.Random(5)
    names = furniture.site_names("old-mill7.example")
    for _ in range(300):
        raw = "".join(rng.choice(["old mill7 ", "old-mill7.example ", "12", "Σ", "  ", "word ", "x.com "]) for _ in range(rng.randint(20, 160)))
        if len(raw) > 2 * furniture.SHORT and (start := furniture.long_start(raw, names)):
            form = furniture.normal(raw, names)
            assert len(form) > furniture.SHORT and form.startswith(start) and len(start) == furniture._START
    assert furniture.long_start("a lamp " * 60, names) and not furniture.long_start("a lamp " * 60, ("n" * 70,))


def test_sentences_cost_less_than_by_their_plain_definition():
    rng = random.Random(7)
    bodies = [" ".join(sentence(rng) for _ in range(40)) for _ in range(60)]

    def by_definition(body):
        parts = [language._TOKEN.findall(p) for p in re.split(r"[.!?…]+[\"”»’')\]]*\s+|[。！？]+[”’」』）\"]*", prose.plain(body))]
        return [t for p in parts for t in p], list(itertools.accumulate((len(p) for p in parts if p), initial=0))[:-1]

    def seconds(f):
        took = []
        for _ in range(7):
            began = time.process_time()
            for b in bodies:
                f(b)
            took.append(time.process_time() - began)
        return min(took)

    assert all(language.sentences(b) == by_definition(b) for b in bodies)
    assert seconds(language.sentences) * 1.5 < seconds(by_definition)
