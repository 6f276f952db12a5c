"""Operators on texts and categories against plain computations, and on awkward tables."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from curatrix.llm import containers as B
from curatrix.llm import mixing as M
from curatrix.llm import pairs as R
from curatrix.llm import proportions as Q
from curatrix.llm import subjects as U
from curatrix.llm import tokens as T

TABLES = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(TABLES).exists(), reason="no test tables")


# ---- tokens

def test_token_counts_are_exact(spark):
    texts = ["Hello  world's 123\n\n end", "", None, "naïve 中文 text<|end|>", "a" * 5000, " \t ", "x y z"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    enc = T.encoder(T.VOCABULARY)
    want = {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert {r.k: r.tokens for r in T.with_token_counts(df, keep=("k",)).collect()} == want


@needs_tables
def test_budget_adds_up(spark):
    from curatrix.llm.queries import p5_token_budget

    rows = {r.id: r.text for r in spark.read.parquet(f"{TABLES}/normalized.parquet").select("id", "text").collect()}
    enc = T.encoder(T.VOCABULARY)
    got = p5_token_budget(spark, TABLES).collect()
    assert sum(r.tokens for r in got) == sum(len(enc.encode_ordinary(t)) for t in rows.values() if t)
    assert sum(r.documents for r in got) == len(rows)


def test_budget_of_awkward_rows(spark):
    df = spark.createDataFrame([("a", "the cat", 1, "x"), ("a", "the cat", 2, "x"), (None, None, 1, None), (None, "", 1, None), ("b", "der Hund ist da", 1, "x")], "id string, text string, ingested_at int, piece string")
    got = {(r.s, r.language): (r.documents, r.tokens) for r in T.token_budget(df, {"s": T.label("piece")}).collect()}
    assert got[("x", "en")] == (1, 2) and got[(None, None)] == (2, 0) and got[("x", "de")][0] == 1
    assert T.token_budget(df.limit(0), {"s": T.label("piece")}).count() == 0


def test_language():
    said = {"The cat is on the mat": "en", "Der Hund ist nicht da": "de", "El gato y los perros": "es", "Le chat est dans les rues": "fr", "因此最后才验证导数": "zh", "12 34": None, "": None, None: None, "xyzzy": "unknown"}
    said |= {"Il gatto è nella casa della zia": "it", "O gato não está em casa": "pt", "De kat zit niet op het dak": "nl", "Кошка сидит на крыше": "cyrillic", "これは猫です": "ja", "고양이가 있다": "ko", "Η γάτα είναι εδώ": "el"}
    assert {t: T.language_of(t) for t in said} == said


# ---- containers

def test_containers_hold(spark):
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in rng.integers(0, 120, 500)] + [None, 250, 300, 100, 0]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id int, tokens int").repartition(3)
    rows = B.fill_containers(df, 100).collect()
    per, doc = {}, {}
    for r in rows:
        doc.setdefault(r.doc_id, []).append((r.part, r.tokens))
        if r.container is not None:
            per[r.container] = per.get(r.container, 0) + r.tokens
    assert max(per.values()) <= 100
    assert {d: sum(n for _, n in p) for d, p in doc.items()} == {i: n or 0 for i, n in enumerate(sizes)}
    assert {d for d, p in doc.items() if len(p) > 1} == {i for i, n in enumerate(sizes) if n and n > 100}
    assert sum(per.values()) / (100 * len(per)) > 0.9
    assert B.fill_containers(df.limit(0), 100).count() == 0


def test_fullest_closes_first():
    fit, made = B.BestFit(10, 2), []
    fresh = lambda: made.append(len(made)) or made[-1]
    assert [fit.place(n, fresh) for n in (6, 7, 5, 4, 5)] == [0, 1, 2, 0, 2]  # 7 closed when 5 came


# ---- mixes

def test_mix_reaches_its_targets(spark):
    rng = np.random.default_rng(1)
    docs = [(i, s, int(rng.integers(5, 200))) for i, s in enumerate(["a"] * 600 + [" B\t"] * 300 + ["c"] * 3 + [None] * 5)] + [(9000, "a", None), (9001, "a", 0)]
    sized = spark.createDataFrame(docs, "doc_id int, source string, tokens int")
    weights = spark.createDataFrame([("A", 0.5, 2, 40_000), ("b", 0.3, 4, 40_000), ("c", 0.1, 2, 40_000), ("d", 0.1, 3, 40_000)], "source string, target_weight double, max_repeats int, budget_tokens long")
    solved = M.balance(sized, weights)
    mixed = M.mix_sources(sized, weights, solved)
    rows = {r.source: r for r in M.mix_report(weights, solved, mixed).collect()}
    assert abs(rows["A"].mixed_tokens - 20_000) < 400 and abs(rows["b"].mixed_tokens - 12_000) < 400
    supply = sum(n for _, s, n in docs if s == "c")
    assert rows["c"].short and rows["c"].mixed_tokens == 2 * supply and rows["d"].short and rows["d"].mixed_tokens == 0
    assert not rows["A"].short
    limit = {"A": 2, "b": 4, "c": 2}
    assert all(1 <= r.copies <= limit[r.source] for r in mixed.collect())
    assert M.mix_sources(sized.limit(0), weights).count() == 0


@pytest.mark.parametrize("keep_sizes", [False, True])
def test_dual_is_solved(spark, keep_sizes):
    """The multipliers leave 0, and with them the rates meet the constraints: the dual's gradient vanishes."""
    rng = np.random.default_rng(2)
    docs = [(i, s, int(n)) for i, (s, n) in enumerate(zip(["a"] * 500 + ["b"] * 400 + ["c"] * 300, rng.lognormal(4, 1, 1200) + 1))]
    sized = spark.createDataFrame(docs, "doc_id int, source string, tokens int")
    total = sum(n for *_, n in docs)
    weights = spark.createDataFrame([("a", 0.2, 3, total), ("b", 0.6, 4, total), ("c", 0.2, 1, total)], "source string, target_weight double, max_repeats int, budget_tokens long")
    solved = M.balance(sized, weights, keep_sizes=keep_sizes)
    state = {r.key: r for r in solved.state.collect()}
    for r in solved.tilt.collect():
        t = np.array([n for _, s, n in docs if s == r.key], float)
        w = r.max_repeats / (1 + np.exp(-(r.a + r.b * t / r.mean)))
        target = {"a": 0.2, "b": 0.6, "c": 0.2}[r.key] * total
        assert abs((w * t).sum() - target) < 1e-5 * target and (w <= r.max_repeats).all() and not state[r.key].short
        assert abs(state[r.key].b) + abs(state[r.key].c) > 0.01 and 1 < state[r.key].steps < 30
        if keep_sizes:
            assert abs((w * t).sum() / w.sum() / t.mean() - 1) < 1e-4
        else:  # the tilt: the log odds are linear in the size, with the source's multiplier as slope
            assert np.allclose(np.log(w / (r.max_repeats - w)), r.a + state[r.key].b * t / r.mean)


# ---- proportions

def test_swap_repair_ends_at_the_goal():
    supply, floor, goal = np.array([100, 10, 50]), np.array([5, 5, 0]), np.array([30.0, 20.0, 10.0])
    n = Q.swap_repair(np.array([5, 5, 50]), supply, floor, goal)
    assert n.sum() == 60 and n[1] == 10 and abs(n[0] - 35) <= 1 and (n >= floor).all() and (n <= supply).all()


def test_sample_matches_its_plan(spark):
    rows = [(f"i{k}", "t", " D1 " if k % 3 else "d2", "m", ["high", "", None][k % 3]) for k in range(300)] + [("i0", "t", "d2", "m", "high"), ("x", None, "d1", "m", None), (None, "t", "d1", "m", None)]
    records = Q.signed(spark.createDataFrame(rows, "id string, text string, dataset string, meta_domain string, meta_difficulty_bin string"))
    assert records.count() == 300
    targets = spark.createDataFrame([(1, "D1", "m", None, 0.5, 10, 100), (2, "d2", "m", "High", 0.4, 0, 100), (3, "d9", "m", None, 0.1, 5, 100)], "target_id long, dataset string, meta_domain string, meta_difficulty_bin string, target_share double, min_rows long, sample_rows long")
    plan = {r.target_id: r for r in Q.target_plan(records, targets).collect()}
    assert (plan[1].supply, plan[2].supply, plan[3].supply) == (200, 100, 0) and [plan[k].short for k in (1, 2, 3)] == [False, False, True]
    assert [plan[k].unmet for k in (1, 2, 3)] == [None, None, "supply"]
    tight = spark.createDataFrame([(1, "D1", "m", None, 0.5, 80, 100), (2, "d2", "m", "High", 0.5, 10, 100)], targets.schema)
    assert {r.target_id: r.unmet for r in Q.target_plan(records, tight).collect()} == {1: None, 2: "total"}
    assert sum(r.drawn for r in plan.values()) == 100 and plan[1].drawn >= 50 and plan[2].drawn >= 40
    got = Q.proportional_sample(records, Q.target_plan(records, targets), parts=8).collect()
    assert len({r.id for r in got}) == len(got) == 100
    assert sum(r.target_id == 1 for r in got) == plan[1].drawn
    assert Q.proportional_sample(records.limit(0), Q.target_plan(records.limit(0), targets)).count() == 0


# ---- pairs

def test_pairs_of_a_text():
    t = "<|start|>user<|message|>q1<|end|><|start|>assistant<|channel|>analysis<|message|>no<|end|><|start|>assistant<|channel|>final<|message|>a1<|end|><|start|>assistant<|message|>a2<|end|><|start|>user<|message|>q2<|end|><|start|>assistant<|channel|>final<|message|>open"
    assert R.pairs(t) == [("q1", "a1\na2"), ("q2", "open")] and R.pairs("no tags") == [] and R.pairs("") == []


def sound_pairs(spark, texts):
    rows = spark.read.parquet("/root/testdata/sf0.1/normalized.parquet").where("text is not null").orderBy("id").limit(texts).select("text").collect()
    return [p for r in rows for p in R.pairs(r.text)]


def over(model, rows):
    return R.judge(model, rows)


@needs_tables
def test_classifier_on_held_out_pairs(spark):
    """Whole families of refusals are held out: the classifier is tested on patterns that it was not fitted on."""
    pairs = sound_pairs(spark, 1500)
    train, test = pairs[:2000], pairs[2000:2500]
    model = R.fit(train, families=slice(0, None, 2))
    whole = [(q, a) for q, a in test if len(a) > 80 and a.rstrip()[-1:] in ".!?。"]
    others = {"de": ["Wenn die Bilanz fehlt, bleibt die Steuer ohne Bedeutung. Nur die Aktie ändert sich."], "en": ["The loan is lent against the bond, and the interest shows why it is so."]}
    rng = np.random.default_rng(5)
    made = [(d, q, b) for q, a in whole for d, b in R.broken(rng, q, a, others, slice(1, None, 2))]
    said = over(model, [(q, b) for _, q, b in made])
    right = {d: np.mean([s[k] >= 0 for (e, _, _), s in zip(made, said) if e == d]) for k, d in enumerate(R.DEFECTS)}
    assert min(right.values()) > 0.8, right
    assert np.mean([R.DEFECTS[s.argmax()] == d and s.max() >= 0 for (d, _, _), s in zip(made, said)]) > 0.9, right
    assert (over(model, whole).max(1) >= 0).mean() < 0.15


@needs_tables
def test_defects_after_long_beginnings(spark):
    model = R.fit(sound_pairs(spark, 1000)[:1500])
    q = "How does a bond differ from a loan?"
    long = "This is one of those matters on which whole shelves of books have been filled. It helps to look at it from more than one side, with the common use of the words in mind and with some care for the cases in which they part. "
    rng = np.random.default_rng(3)
    for times in (1, 3):  # 220 and 660 characters before it
        said = over(model, [(q, long * times + R.refusal(rng, "en")) for _ in range(200)])
        assert ((said.argmax(1) == 2) & (said.max(1) >= 0)).mean() > 0.75
    assert over(model, [(q, long * 3)])[0].max() < 0
    assert R.DEFECTS[over(model, [(q, long * 3 + "The bond is sold on a mar")])[0].argmax()] == "truncated"
    words = [chr(97 + k // 26) + chr(97 + k % 26) + "x" for k in range(60)]
    assert R.features([("", " ".join(words))], frozenset())[2][0] > R.features([("", " ".join(words[:30]))], frozenset())[2][0] + 80
    points = ["1. The loan is given by a bank.", "2. The bond is sold on a market.", "3. The price of the bond moves."]
    whole, cut = (R.shape(q, long + "There are three points. \n" + "\n".join(points[:k]), frozenset())[0] for k in (3, 2))
    assert "points all" in whole and "points fewer" in cut


def test_threshold_between_precision_and_recall():
    rng = np.random.default_rng(0)
    cut = R.best_cut(rng.normal(4, 1, 1000), rng.normal(-4, 1, 4000), 0.05)
    assert -1.5 < cut < 2 and R.best_cut(np.zeros(0), np.zeros(3), 0.1) == 0.0
    high = R.best_cut(rng.normal(4, 1, 1000), rng.normal(2, 1, 4000), 0.05)  # not clipped
    assert high > 3


def test_pairs_of_awkward_rows(spark):
    df = spark.createDataFrame([("a", None, 1), (None, "x", 1), ("b", "", 1), ("c", "<|start|>user<|message|>q", 1), ("c", "<|start|>user<|message|>q", 2)], "id string, text string, pair_no int")
    assert {r.id for r in R.broken_pairs(df).collect()} <= {"c"} and R.broken_pairs(df.limit(0)).count() == 0


# ---- subjects

@needs_tables
def test_subjects_of_held_out_documents(spark):
    root = "/root/testdata/sf0.1"
    read = lambda n: spark.read.parquet(f"{root}/{n}.parquet")
    names = [r.subject for r in read("subjects").collect()]
    rows = U.labelled_sample(read("documents"), read("doc_subject_labels"), "doc_id", "text", 6000, 0)
    train, test = rows[:700], [r for r in rows[700:] if r[1] <= set(names)]
    m = U.fit(train, names)
    hits = said = true = 0
    for text, labels in test:
        s = U.sentences(text)
        sizes_at = m.encode(s)
        got = {names[j] for j in np.flatnonzero(m.shares(m.gains(*sizes_at), sizes_at[2], np.zeros(len(s), int), 1)[0] >= 0.2)}
        hits, said, true = hits + len(got & labels), said + len(got), true + len(labels)
    assert hits / said > 0.8 and hits / true > 0.8


def test_sentences():
    assert U.sentences("[{\"role\": \"user\", \"content\": \"The cat sat. It slept there.\"}]") == [["the", "cat", "sat"], ["it", "slept", "there"]]
    assert U.sentences("<|start|>user<|message|>One two three 4<|end|>") == [["one", "two", "three", "#"]]
    assert U.sentences("因此最后才验证。") == [["因此", "此最", "最后", "后才", "才验", "验证"]] and U.sentences("  ") == []


def test_subjects_of_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, " ", "s"), (3, "the acid met the base", "s"), (4, "the goal met the team", "s"), (None, "x", "s")], "doc_id long, text string, subject string")
    labels = spark.createDataFrame([(3, " Chemistry "), (4, "sport"), (4, "odd"), (9, "law"), (None, "law"), (1, None)], "doc_id long, subject string")
    subjects = spark.createDataFrame([("chemistry", "d"), ("sport", "d"), (None, "d")], "subject string, description string")
    got = {(r.doc_id, r.subject) for r in U.document_subjects(docs, labels, subjects).collect()}
    assert got <= {(3, "chemistry"), (4, "sport")}
    assert U.document_subjects(docs.limit(0), labels, subjects).count() == 0 and U.document_subjects(docs, labels.limit(0), subjects).count() == 0
