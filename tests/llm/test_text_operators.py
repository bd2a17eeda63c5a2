"""Sentences, turns, personal data, languages and splitting on fixtures and against brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palaver.llm import languages, pii, sentences, splitting, turns


def units(text):
    return [text[a - 1 : b] for a, b in sentences.spans(text)]


CASES = [
    ["We pay approx. $ 3.76 per seat.", "The office opens at 8 a.m.", "Dr. Vane will join us, cf. the invite."],
    ['She said "We ship it. No excuses." and moved on.', '"Are you sure?" asked the auditor.', "Well... maybe it can wait.", "See No. 5 in the list, e.g. the part on C. Vane."],
    ["Hr. Vane hat z. B. noch nicht geantwortet.", "Am 23. März fangen wir an.", "Er sagte: „Das reicht. Wir hören auf.“ und ging hinaus.", "Das kostet ca. 3,5 Prozent mehr, d. h. zu viel."],
    ["M. Vane arrivera vers 15 h, c.-à-d. après la pause.", "Elle a dit : « C'est fini. On arrête. » puis elle est partie.", "Voir l'art. 8 et la p. 1 du dossier."],
    ["El Sr. Vane llegará a las 5 p. m. con los papeles.", "¿Os parece bien?", "Sube un 2,5 %, p. ej. en el norte."],
    ["Договор подписан в 2025 г. на двух страницах.", "Работы по ул. Садовой и т. д. отложены.", "Она сказала: «Хватит. Остановимся.» и вышла."],
    ["قالت: «يكفي. لنتوقف هنا.» ثم خرجت من القاعة.", "من يستطيع ذلك؟"],
    ['उसने कहा, "बस। अब रुकते हैं।" और चली गई।', "देखिए पृ. 12 पर विवरण।"],
    ['그녀는 "이제 됐어요. 그만합시다."라고 말하고 나갔습니다.', "비용이 21.67% 늘었습니다."],
]


@pytest.mark.parametrize("parts", CASES, ids=range(len(CASES)))
def test_sentences_joined_by_space(parts):
    assert units(" ".join(parts)) == parts


def test_rules_are_those_of_the_language():
    for text in ("We choose option D. Then we left.", "Call Me. Now we go.", "See plan M. We start.", "He took vitamin C. Then he slept.", "The answer was no. 3 people left.", "It ended at the St. Nobody came."):
        assert len(units(text)) == 2, text
    one = ["El informe lo firma D. Then hoy.", "Voir M. Vane demain avec nous.", "See room no. 3 for the plan.", "The U.S. Senate was there.", "Das macht Hr. Vane mit uns.", "The St. Corvin case is open."]
    assert all(units(x) == [x] for x in one)
    mixed = "Wir haben z. B. noch nichts. We choose option D. Then we left. Hr. Vane ist nicht da."
    assert units(mixed) == ["Wir haben z. B. noch nichts.", "We choose option D.", "Then we left.", "Hr. Vane ist nicht da."]


def test_scripts_without_spaces():
    parts = ["她说：“够了。我们停下来吧。”然后就离开了会议室。", "费用增加了17.95%，超出了估计。", "没有人相信合同会提前完成……", "那句“到底行不行？”他一直没有回答。"]
    assert units("".join(parts)) == parts
    parts = ["本当に間に合うのかな（まだ誰も試していない。）と思いました。", "バージョン4.0では直しました。", "このままではいけません！"]
    assert units("".join(parts)) == parts


def test_line_breaks_and_nothing():
    assert units("a b\nc. D\n\n  e ") == ["a b", "c.", "D", "e"]
    assert sentences.spans(None) == [] and sentences.spans("") == [] and sentences.spans(" \n ") == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='aB1 .!?。"«»“”()\n', max_size=60))
def test_units_cover_the_text(text):
    at = 0
    for a, b in sentences.spans(text):
        assert a > at and not text[at : a - 1].strip() and text[a - 1 : b].strip() == text[a - 1 : b]
        at = b
    assert not text[at:].strip()


# --- turns ---------------------------------------------------------------------------------------------------------


def test_layouts():
    t = "Meeting: plan\nDate: 2026-01-01\n\n[00:01] Ann Vane: Hello.\n[00:09] ANN VANE: Um, again.\nReminder: buy milk.\n[00:12] Bo Lint (HR): Hm. Uh.\n[laughter]\n[00:20] B. Lint: Yes.\nmore words\n"
    assert turns.text_turns(t) == [(4, 6), (9, 10)]
    assert turns.text_turns("Ann Vane  00:01\nHello.\n\nBo Lint  00:05\n[cough]\nAnn Vane  00:09\nBye.") == [(2, 7)]
    assert turns.text_turns(">> Ann: Hi [00:02]\n>> Bo: Yes [00:04]\nNote: go on") == [(1, 1), (2, 3)]
    assert turns.text_turns("(00:06) Ann Vane - Hi\n(00:09) Vane, Ann - More") == [(1, 2)]
    assert turns.text_turns("no speaker here\nAnn: hi\nBo: yes") == [(2, 2), (3, 3)]
    t = "00:02 freya vane> Hi.\n\nAction item: go on\n00:33 ANN LINT> Yes.\n01:09 Freya Vane> No.\n01:30 ann lint> Well.\n01:59 freya vane> Bye."
    assert turns.text_turns(t) == [(1, 3), (4, 4), (5, 5), (6, 6), (7, 7)]
    assert turns.cue_label("Small print", "x")[0] is None and turns.cue_label("freya vane", "x")[0] == "freya vane"
    assert turns.cue_label(None, "freya vane: hi")[:2] == ("freya vane", True) and turns.cue_label(None, "freya vane: Hi")[1] is False and turns.cue_label(None, "Freya Vane: hi")[:2] == ("Freya Vane", False)
    assert turns.text_turns(None) == [] and turns.text_turns("") == []


UNSEEN = [
    "{00:10} Tobias ~ hello there\n{00:15} Ann ~ yes\n{00:20} Tobias ~ bye now",
    "00:10 @Tobias :: hello there\n00:12 @Ann :: yes ok\n00:15 @Tobias :: bye",
    "10:00 | Tobias => hello there\n10:02 | Ann => fine then\n10:05 | Tobias => bye",
    "Tobias\thello there\nAnn\tyes indeed\nTobias\tbye\nAnn\tsee you\nTobias\tyes",
    "[Tobias] hello there\n[Ann] yes\n[Tobias] bye\n[Ann] see you\n[Tobias] yes",
    "Tobias (00:10) hello there\nAnn (00:12) yes\nTobias (00:15) bye",
]


@pytest.mark.parametrize("text", UNSEEN)
def test_layouts_are_mined(text):
    got = turns.read_turns(text)
    assert [g[:2] for g in got] == [(i, i) for i in range(1, text.count("\n") + 2)]
    assert [g[2] for g in got[:2]] == ["Tobias", "Ann"] and got[0][4] == "hello there"


def test_spoken_turns(spark):
    t = "[00:01] Ann Vane: Um, hello [noise] there.\nmore words\n[00:12] bo lint (HR): Hm.\n[00:20] Bo Lint: Yes, uh, sure.\n"
    assert turns.read_turns(t) == [(1, 2, "Ann Vane", 1.0, "hello there. more words"), (4, 4, "Bo Lint", 20.0, "Yes, sure.")]
    rows = [("m", i, None, float(i), s, x) for i, (s, x) in enumerate([("Ann Vane", "Um, first"), (None, "goes on (laughs)"), ("ANN VANE", "more"), ("Bo Lint", "*noise*"), ("Bo Lint", "yes")])]
    df = spark.createDataFrame(rows, "meeting_id string, pos int, start_time string, start_seconds double, speaker string, text string")
    got = sorted(tuple(r) for r in turns.spoken_cue_turns(df).collect())
    assert got == [("m", 0, 2, 0.0, "Ann Vane", "first goes on more"), ("m", 4, 4, 4.0, "Bo Lint", "yes")]


def test_same_speakers():
    m = turns.same_speakers(["Ann Vane", "ann vane", "A. Vane", "Ann V.", "Vane, Ann", "Ann", "[Ann Vane]", "Bo Lint"])
    assert len({v for k, v in m.items() if k != "Bo Lint"}) == 1 and m["Bo Lint"] != m["Ann"]
    assert [turns.fold(x) for x in ("[Ann Vane (HR)]", "[Ann Vane]", "<Ann Vane>", "- Ann Vane (HR)", "[Ann Vane] (HR)", "(Ann Vane)")] == ["ann vane"] * 6
    m = turns.same_speakers(["Ann Vanebrook", "Ann Vanebrok", "Ann Vanebrook (HR)"])
    assert len(set(m.values())) == 1


def test_cue_fold_matches_loop(spark):
    rnd, rows = random.Random(4), []
    for m in ["hot"] * 8 + ["a", "b", None]:
        base = sum(r[0] == m for r in rows)
        for p in range(base, base + rnd.randint(5, 40)):
            rows.append((m, float(rnd.randint(0, 50)), p, rnd.choice(["x", "y", None])))
    want = set()
    for m in {r[0] for r in rows}:
        cur = None
        for _, at, p, w in sorted((r for r in rows if r[0] == m), key=lambda r: (r[1], r[2])):
            if cur and (w is None or w == cur[0]):
                cur[2] = p
            elif w is not None:
                if cur:
                    want.add((m, cur[1], cur[2]))
                cur = [w, p, p]
        if cur:
            want.add((m, cur[1], cur[2]))
    df = spark.createDataFrame(rows, "meeting_id string, at double, pos int, who string")
    got = turns.fold_turns(df.repartition(4)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert turns.fold_turns(df.limit(0)).count() == 0


def test_cues(spark):
    rows = [
        ("m", 2, "00:00:09,000", None, None, "- Ann Vane: late"), ("m", 0, "00:00:01,000", 1.0, "Ann Vane", "first"), ("m", 1, "00:00:05,000", 5.0, "Reminder", "goes on"),
        ("m", 3, "00:00:12,000", 12.0, "Bo Lint", "Uh, um."), ("m", 4, "00:00:14,000", 14.0, None, "<v Bo Lint>yes</v>"), ("m", 5, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "meeting_id string, pos int, start_time string, start_seconds double, speaker string, text string")
    assert sorted(tuple(r) for r in turns.cue_turns(df).collect()) == [("m", 0, 2), ("m", 4, 4)]


# --- personal data -------------------------------------------------------------------------------------------------


def values(text, field=False, given=()):
    return [(k, text[a:b]) for a, b, k in pii.find(text, field, frozenset(given))]


def test_detection():
    t = "Reach Robert Vane's desk at r.vane+x@mail.example or robert dot vane at mail dot example, +49 30 23125 606, (265) 555-0158."
    assert values(t, given=["Robert"]) == [("name", "Robert Vane"), ("email", "r.vane+x@mail.example"), ("email", "robert dot vane at mail dot example"), ("phone", "+49 30 23125 606"), ("phone", "(265) 555-0158")]
    t = "Dr. Vane and C. Lint met on 2026-01-02; QQ 12 34 56 A, X1234567B, 986-67-4211, 00 293 050 614; invoice 45663, version 3.7.1, ticket TCK-98933."
    assert values(t) == [("name", "Vane"), ("name", "C. Lint"), ("id_number", "QQ 12 34 56 A"), ("id_number", "X1234567B"), ("id_number", "986-67-4211"), ("id_number", "00 293 050 614")]
    t = "Send it to Flat 4, 36 Salt Lane, Tarn; P.O. Box 12, Puerto Alba 55555; 12 rue Harrow, 13401 Alba; Lindenstraße 5, 10115 Stadt; Calle Sol 8, 30829 Alba."
    assert [k for k, _ in values(t)] == ["address"] * 5
    assert values("[ROBERT VANE (HR)]: hi") == [("name", "ROBERT VANE")]
    assert values("Mark the page; I hope so; we may go; to be frank") == []
    assert values("我昨天和Katherine Vane谈过。") == [("name", "Katherine Vane")]


def test_names_without_any_list():
    """Context and scripts only; the words around them stay."""
    for text, want in (
        ("I met Tobias Lindqvist yesterday.", ["Tobias Lindqvist"]),
        ("Please call Fatima Rahman or Hiroshi Tanaka.", ["Fatima Rahman", "Hiroshi Tanaka"]),
        ("We spoke with Jessica and Brandon about it.", ["Jessica", "Brandon"]),
        ("Ngozi Okafor lives at the end.", ["Ngozi Okafor"]),
        ("Ivan Petrov", ["Ivan Petrov"]),
        ("Иван Петров ушёл.", ["Иван Петров"]),
        ("Dr. Иванов here", ["Иванов"]),
        ("昨日、田中太郎さんと話しました。お客様から。", ["田中太郎"]),
        ("김민수 씨가 왔습니다.", ["김민수"]),
        ("We deliver to New York and the United States Office.", []),
        ("Ella dijo que no. Will the plan work? Will like, the plan work?", []),
    ):
        assert [v for k, v in values(text) if k == "name"] == want, text
    assert [text for k, text in [(k, "Grace is out."[a:b]) for a, b, k in pii.find("Grace is out.", False, frozenset({"Grace"}))]] == ["Grace"]


def test_given_names_by_evidence(spark):
    rows = [("Anna Vane",), ("anna vane",), ("Dr. Anna Lint",), ("Omar Vane",), ("Vane Foods Ltd",), (None,), ("",)]
    names = spark.createDataFrame(rows, "name string")
    assert [r.word for r in pii.given_names(names).collect()] == ["Anna"]
    texts = spark.createDataFrame([("m", "Anna is out."), ("n", None), ("o", "")], "k string, t string")
    got = {r.k: r.known for r in pii.with_known(texts, "k", "t", names).collect()}
    assert got == {"m": ["Anna"], "n": None, "o": None}


def test_name_field():
    assert values("Vane, R. (07700 900501)", True) == [("name", "Vane, R."), ("phone", "07700 900501")]
    assert values("Prof. Iris Vane (HR)", True) == [("name", "Iris Vane")]
    assert values("12 Salt Lane, Puerto Alba Iris Vane", True) == [("address", "12 Salt Lane, Puerto Alba"), ("name", "Iris Vane")]
    assert values("12 Salt Lane, Tarn Iris Vane", True)[1] == ("name", "Iris Vane") and values("Iris Vane, 12 Salt Lane, Puerto Alba", True)[0] == ("name", "Iris Vane")
    assert values("Vane Foods AG", True) == [] and values("Speaker 2", True) == [] and values("everyone", True) == []
    assert pii.find(None) == [] and pii.find("") == []


def test_redact_keeps_the_rest():
    assert pii.redact("Dr. Иванов here") == "Dr. [NAME_1] here"
    t = "Robert Vane: call 07700 900123, says Robert Vane. Grace: no."
    assert pii.redact(t, False, frozenset({"Grace"})) == "[NAME_1]: call [PHONE_1], says [NAME_1]. [NAME_2]: no."
    assert pii.redact(None) is None and pii.redact("") == ""


def test_surrogates():
    t = "[00:01] Robert Vane: Vane or R. Vane? Grace Lint: QQ123456A, QQ 12 34 56 A and 07700 900123. ROBERT VANE left."
    s = pii.surrogate(t, b"k")
    assert s == pii.surrogate(t, b"k") != pii.surrogate(t, b"other")
    assert "Vane" not in s and "Grace" not in s and "QQ123456A" not in s
    a, b = s.split("] ", 1)[1].split(":")[0].split(" ")
    assert a in pii.MALE and f"{a.upper()} {b.upper()} left." in s
    assert s.split(" or ")[1][0] == a[0]
    k = pii.surrogate("Иван Петров и Анна Петрова", b"k")
    assert all("а" <= c.lower() <= "я" or c == " " for c in k) and k.split()[0] in pii.MALE_CYRILLIC and k.split()[3] in pii.FEMALE_CYRILLIC
    x, y = s.split(": ")[2].split(" and ")[0].split(", ")
    assert x == y.replace(" ", "") and x.startswith("QQ")


# --- languages -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return languages.train([])


def test_held_out_accuracy():
    """Fitted on all but every fifth seed sentence, tested on those."""
    t, y = languages.seed_rows()
    test = [i for i in range(len(t)) if i % 5 == 4]
    m = languages.fit([t[i] for i in range(len(t)) if i not in test], [y[i] for i in range(len(t)) if i not in test])
    best = m.scores([t[i] for i in test]).argmax(1)
    assert sum(languages.CODES[b] == y[i] for b, i in zip(best, test, strict=True)) >= 0.85 * len(test)


def test_stretches(model):
    en, de, zh = "She has been waiting for an hour. That is what we know.", "Ich glaube nicht, dass das klappt. Die Kinder warten schon im Garten.", "他们已经等了一个多小时。"
    got = languages.stretches(f"{en} {de} {zh}", model)
    assert [(a, c) for a, _, c, _ in got] == [(1, "en"), (len(en) + 2, "de"), (len(en) + len(de) + 3, "zh")]
    assert all(0 < p <= 1 for *_, p in got)
    assert languages.stretches(None, model) == [] and languages.stretches("", model) == []
    assert languages.stretches("12345 67", model)[0][2] is None


def test_wrong_labels_are_outvoted():
    t, y = languages.seed_rows()
    rows = [([s], c if i % 4 else "hi") for i, (s, c) in enumerate(zip(t, y, strict=True))]
    m = languages.train(rows)
    assert languages.stretches("The children were waiting for another cup of tea.", m)[0][2] == "en"


# --- splitting -----------------------------------------------------------------------------------------------------


def test_range_max():
    import numpy as np

    v = np.random.default_rng(0).integers(0, 4, 200).astype(np.int8)
    t = splitting.RangeMax(v, 64)
    for lo in range(0, 136):
        w = v[lo : lo + 64]
        assert t.query(lo, lo + 63) == (w.max(), lo + np.flatnonzero(w == w.max())[-1])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,。\ń", max_size=300), st.integers(5, 60), st.integers(0, 20))
def test_pieces(text, limit, overlap):
    ps = splitting.cut(text, limit, overlap)
    if not text:
        assert ps == []
        return
    o = min(overlap, limit - 1)
    assert all(b - a + 1 <= limit for a, b, _ in ps) and ps[0][0] == 1 and ps[-1][1] == len(text)
    assert all(n[0] == p[1] + 1 - o for p, n in zip(ps, ps[1:], strict=False))
    assert text == "".join(text[(a if i == 0 else a + o) - 1 : b] for i, (a, b, _) in enumerate(ps))


def test_natural_cuts_and_forced():
    text = "One two three. Four five, six seven. Eight"
    assert [text[a - 1 : b] for a, b, _ in splitting.cut(text, 26, 0)][0] == "One two three. "
    assert [f for *_, f in splitting.cut("x" * 50, 20, 5)] == [True, True, False]
    assert splitting.longest_run("ab cde。" + "y" * 9) == 9
    assert splitting.cut(None, 5, 1) == [] and splitting.cut("abc", None, 1) == []


def test_piece_rows(spark):
    rows = [("f", "1", 0, "a b " * 30, 50, 5), ("f", "2", 0, "z" * 90, 50, 5), ("f", "3", 0, None, 50, 5), ("f", "4", 0, "", 50, 5), ("f", "5", 1, "ok", 50, 5)]
    df = spark.createDataFrame(rows, "field_name string, rec_key string, item_no int, text string, max_chars int, overlap_chars int").withColumn("piece", F.lit("clash"))
    got = {(r.rec_key, r.piece_no): r for r in splitting.pieces(df).collect()}
    assert ("3", 0) not in got and ("4", 0) not in got and got["5", 0].piece == "ok"
    assert got["2", 0].forced and not got["1", 0].forced and got["2", 1].run == 90
