"""Names, packing, mixing and shared spans against brute force."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palaver.llm import mixing, names, packing, spans, tokens


def one_edit(a, b):
    if a == b:
        return False
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        # the join counts any two changed places with the same letters as a swap
        return len(d) == 1 or (len(d) == 2 and sorted(a) == sorted(b))
    if abs(len(a) - len(b)) != 1:
        return False
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def test_near_tokens_lose_no_pair(spark):
    rnd, toks = random.Random(3), {}
    for _ in range(80):
        w = "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(6, 11)))
        toks[w] = rnd.randint(3, 9)
        i = rnd.randrange(1, len(w) - 1)
        for v in (w[:i] + w[i + 1 :], w[:i] + "z" + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :]):
            toks.setdefault(v, 1)
    rows = [("p", x, n) for x, n in toks.items()]
    got = {(r.token, r.near) for r in names.near_tokens(spark.createDataFrame(rows, "kind string, token string, df long")).collect()}
    want = {(a, b) for a, b in itertools.permutations(toks, 2) if one_edit(a, b) and min(len(a), len(b)) >= 4 and (toks[b] > toks[a] or (toks[b] == toks[a] and b < a))}
    adjacent = {(a, b) for a, b in want if len(a) != len(b) or sum(x != y for x, y in zip(a, b, strict=True)) == 1 or any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1))}
    assert adjacent <= got <= want


SAME = [
    ["Robert Vanebrook", "ROBERT VANEBROOK", "Vanebrook, Robert", "Vanebrook Robert", "R. Vanebrook", "Vanebrook, R.", "rvanebrook", "robert.vanebrook", "Robert_Vanebrook", "Bob Vanebrook", "Dr. Robert Vanebrook", "Robert Q. Vanebrook", "Robert Vanebroook", "Robbert Vanebrook", "Robert Vanebrook (HR)", "Robert Vanebrook <+49 30 23125 606>"],
    ["Grace Vanebrook", "Grace Vanebrook, 07700 900501"],
    ["Lintwell Foods Ltd", "Lintwell Fds. Ltd", "LINTWELL FOODS LIMITED", "The Lintwell Foods Limited", "Lintwel Foods Ltd"],
    ["Lintwell Research Ltd", "Lintwell Res."],
    ["Chiara Moss", "Chris Moss"][:1],
]


def test_classes(spark):
    rows = [(v,) for g in SAME for v in g] + [("Speaker 2",), ("",), ("everyone",), ("Robert",)]
    got = {r.value: r["class"] for r in names.classes(spark.createDataFrame(rows, "value string")).collect()}
    assert set(got) == {v for g in SAME for v in g}
    assert [len({got[v] for v in g}) for g in SAME] == [1] * len(SAME)
    assert len(set(got.values())) == len(SAME)
    assert names.classes(spark.createDataFrame([], "value string")).count() == 0


def _classes(spark, values):
    return {r.value: r["class"] for r in names.classes(spark.createDataFrame([(v,) for v in values], "value string")).collect()}


@pytest.mark.parametrize("k", [1, 3, 8])
def test_misspelling_links_at_any_support(spark, k):
    ways = ["{} {}", "{} {} (HR)", "Dr. {} {}", "{} {} (Ops)", "{} {} <a@b.example>", "{}  {}", "{}_{}", "{}.{}"]
    good = [w.format(g, "Lindqvist") for g in ("Anna", "Boris", "Tobias") for w in ways]
    bad = [w.format(g, "Lindqvst") for g in ("Anna", "Boris", "Tobias") for w in ways[:k]]
    got = _classes(spark, good + bad)
    for g in ("Anna", "Boris", "Tobias"):
        assert len({c for v, c in got.items() if v.removeprefix("Dr. ").startswith(g)}) == 1
    assert len(set(got.values())) == 3


def test_short_forms_by_rule_and_table(spark):
    for a, b in (("Toby Vanebrook", "Tobias Vanebrook"), ("Jochen Vanebrook", "Joachim Vanebrook"), ("Nell Vanebrook", "Eleanor Vanebrook"), ("Abby Vanebrook", "Abigail Vanebrook")):
        assert len(set(_classes(spark, [a, b]).values())) == 1
    got = _classes(spark, ["Jo Vanebrook", "Omar Vanebrook", "A. Vanebrook", "Anna Vanebrook", "Arno Vanebrook"])
    assert len(set(got.values())) == 5  # an initial that fits two people stands alone


def test_chain_of_misspellings_is_one_class(spark):
    got = _classes(spark, ["Anna Lindqvist", "Anna Lindqvst", "Anna Lindqvt", "Anna Lindqt"])
    assert len(set(got.values())) == 1


def test_verification_rejects(spark, monkeypatch):
    """An initial beside a frequent family name is too little, beside a rare one it is enough."""
    values = [f"{g} Smith" for g in ("Carl", "Omar", "Boris", "Tobias", "Ulrik", "Wanda", "Xenia", "Zora", "Edith", "Hugo", "Igor", "Nadja")]
    values += ["C. Smith", "Carl Vanebrook", "C. Vanebrook"]
    got = _classes(spark, values)
    assert got["C. Smith"] != got["Carl Smith"] and got["C. Vanebrook"] == got["Carl Vanebrook"]
    monkeypatch.setattr(names, "THRESHOLD", 0.0)
    assert _classes(spark, values)["C. Smith"] == _classes(spark, values)["Carl Smith"]


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "i int, t string")
    n = {r.i: r.n for r in df.select("i", tokens.count_tokens("t").alias("n")).collect()}
    assert n[1] == 2 and n[2] == 0 and n[3] == 0 and n[4] > 1


def test_packing(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([rnd.randint(1, 90), rnd.randint(90, 400), rnd.randint(400, 1900)])) for i in range(600)] + [(900, 0), (901, None)]
    caps = [100, 200, 800]
    got = packing.containers(spark.createDataFrame(rows, "doc_id long, n_tokens int").fillna(0), caps).collect()
    have = defaultdict(int)
    room = Counter()
    for r in got:
        have[r.doc_id] += r.n_tokens
        if r.container_no is not None:
            room[r.capacity_tokens, r.block, r.container_no] += r.n_tokens
    assert have == {i: n or 0 for i, n in rows}
    assert all(n <= c for (c, _, _), n in room.items())
    assert Counter(r.doc_id for r in got) == {i: max(1, -(-(n or 0) // 800)) for i, n in rows}
    assert sum(room.values()) / sum(c for c, _, _ in room) > 0.97
    groups = Counter()
    for r in got:
        if r.container_no is not None:
            groups[r.capacity_tokens, r.step_group] += r.n_tokens
    for c in caps:
        g = [v for (k, _), v in groups.items() if k == c]
        assert max(g) - min(g) <= 2 * c
    assert packing.containers(spark.createDataFrame([], "doc_id long, n_tokens int"), caps).count() == 0


def mix_rows(seed=2):
    rnd = random.Random(seed)
    return [(i, s := rnd.choices(["big", "mid", "tiny"], [60, 30, 3])[0], rnd.randint(0, 300), round(rnd.uniform(0.1, 1), 3)) for i in range(3000)]


def test_mixing(spark):
    docs = spark.createDataFrame(mix_rows(), "doc_id long, source string, n_tokens int, weight double")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 4), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    got = mixing.choose(docs, targets).collect()
    used = Counter()
    for r in got:
        used[r.source] += r.n_tokens * r.times
    total = sum(used.values())
    assert all(abs(used[s] / total - p) < 0.005 for s, p in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)))
    most = {"big": 1, "mid": 2, "tiny": 4}
    assert all(1 <= r.times <= most[r.source] for r in got) and len({r.doc_id for r in got}) == len(got)
    epochs = {s: min(Counter(r.times for r in got if r.source == s)) for s in most}
    assert all(r.times - epochs[r.source] in (0, 1) for r in got)
    assert mixing.choose(docs.limit(0), targets).count() == 0


def test_heavier_texts_are_chosen_more_often(spark):
    docs = spark.createDataFrame([(i, "s", 10, 1.0 if i % 2 else 0.2) for i in range(4000)], "doc_id long, source string, n_tokens int, weight double")
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = [r.doc_id for r in mixing.choose(docs, targets, total_tokens=10_000.0).collect()]
    assert len(got) == 1000
    odd = sum(i % 2 for i in got) / len(got)
    # without replacement by keys u ** (1 / w): the heavier half is taken about four and a half times as often at a quarter
    assert 0.74 < odd < 0.88


def brute(docs):
    L = spans.MIN_LENGTH
    of = defaultdict(set)
    for i, t in docs:
        for s in range(len(t or "") - L + 1):
            of[t[s : s + L]].add(i)
    out = set()
    for i, t in docs:
        hit = [s for s in range(len(t or "") - L + 1) if len(of[t[s : s + L]]) > 1]
        run = None
        for s in hit:
            if run and s <= run[1] + L:
                run[1] = s
            else:
                if run:
                    out.add((i, run[0] + 1, run[1] + L))
                run = [s, s]
        if run:
            out.add((i, run[0] + 1, run[1] + L))
    return out


def test_shared_spans(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh \n") for _ in range(n))
    stock = [word(n) for n in (199, 200, 201, 230, 260, 400, 900, 1500)] + ["=" * 450, "ab" * 180]
    docs = []
    for i in range(60):
        t = word(rnd.randint(0, 300))
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(stock)
            a = rnd.randint(0, max(0, len(s) - 190))
            t += s[a : a + rnd.randint(190, 1500)] + word(rnd.randint(0, 60))
        docs.append((i, t))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, None), (103, ""), (104, "ü𝔞" * 150), (105, "x" + "ü𝔞" * 150)]
    df = spark.createDataFrame(docs + [docs[5]], "doc_id long, text string")
    got = spans.covered(df).collect()
    assert {tuple(r) for r in got} == brute(docs) and len(got) == len({tuple(r) for r in got})
    assert spans.covered(df.limit(0)).count() == 0
    assert spans.covered(spark.createDataFrame([(1, "q" * 500)], "doc_id long, text string")).count() == 0


def test_shared_spans_in_blocks(spark, monkeypatch):
    rnd = random.Random(1)
    common = "".join(rnd.choice("abcdef") for _ in range(700))
    other = lambda n: "".join(rnd.choice("uvwxyz") for _ in range(n))
    docs = [(1, other(900) + common + other(400)), (2, common), (3, other(2000))]
    got = {tuple(r) for r in spans.covered(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and list(spans._blocks("x" * 10)) and len(got) == 2
    parts = [(at, p.n) for at, p in _small_blocks(monkeypatch, "y" * 2500)]
    assert all(a + n - b == spans.MIN_LENGTH - 1 for (a, n), (b, _) in itertools.pairwise(parts)) and parts[-1][0] + parts[-1][1] == 2500


def _small_blocks(monkeypatch, text):
    monkeypatch.setattr(spans, "BLOCK", 1000)
    return list(spans._blocks(text))


def test_hot_hash_is_complete(spark):
    rows = spark.createDataFrame([(7, i, i) for i in range(5000)] + [(i + 100, i % 2, 0) for i in range(50)] + [(9, 1, 0), (9, 2, 0)], "h long, doc_id long, s int")
    got = spans.shared_rows(rows, ["h"]).groupBy("h").agg(F.count("*").alias("n")).collect()
    assert {r.h: r.n for r in got} == {7: 5000, 9: 2}


def test_chunks_vary_and_lie_in_their_windows():
    """Each window holds the chunk of its anchor, and the same window elsewhere has the same one."""
    import numpy as np

    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdef ghij\n") for _ in range(3000))
    first, last, begin, end = spans.Prints(text).anchors()
    assert first[0] == 0 and last[-1] == 3000 - spans.MIN_LENGTH and (first[1:] == last[:-1] + 1).all()
    assert (begin - spans.GEAR + 1 >= last).all() and (end < first + spans.MIN_LENGTH).all()
    assert len(set((end - begin).tolist())) > 20 and (end - begin).min() >= spans.LEAST
    other = spans.Prints("zz" * 90 + text[500:1500] + "yy" * 90)
    mine = spans.Prints(text).digest(begin - spans.GEAR + 1, end + 1)
    inside = (first >= 500) & (last <= 1500 - spans.MIN_LENGTH)
    assert np.isin(mine[inside], other.chunks()).all()


def test_windows_of_equal_rolling_hash_are_told_apart(spark):
    rows = spark.createDataFrame([(7, 1, 1), (7, 1, 2), (7, 2, 3), (8, 1, 1)], "h long, proof long, doc_id long")
    assert sorted(r.doc_id for r in spans.shared_rows(rows, ["h", "proof"]).collect()) == [1, 2]
