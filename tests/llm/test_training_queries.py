"""The training queries on whole tables against plain computations of what they define."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from curatrix.llm import pairs as R
from curatrix.llm import queries as Q
from curatrix.llm import tokens as T
from curatrix.llm import vectors as V
from curatrix.session import read_table

ROOT = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(ROOT).exists(), reason="no test tables")


def strip(x):
    return None if x is None or not x.strip() else x.strip().lower()


def tokens(texts):
    enc = T.encoder(T.VOCABULARY)
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def test_token_budget_of_every_slice(spark):
    first = {}
    for r in read_table(spark, ROOT, "normalized").orderBy("ingested_at").collect():
        first.setdefault(r.id if r.id is not None else object(), r)
    rows = list(first.values())
    docs, total = Counter(), Counter()
    for r, n in zip(rows, tokens([r.text for r in rows])):
        key = (strip(r.dataset), strip(r.meta_domain), T.language_of(r.text))
        docs[key] += 1
        total[key] += n
    got = {(r.dataset, r.meta_domain, r.language): (r.documents, r.tokens) for r in Q.p5_token_budget(spark, ROOT).collect()}
    assert got == {k: (docs[k], total[k]) for k in docs}


def test_languages_are_those_of_the_texts(spark):
    """The tables are written in five languages; nothing else may come out but where a text shows none."""
    said = Counter(r.language for r in Q.p5_token_budget(spark, ROOT).collect())
    assert {"en", "de", "es", "fr", "zh"} <= set(said) <= {"en", "de", "es", "fr", "zh", "unknown", None}


def test_split_documents(spark):
    docs = read_table(spark, ROOT, "documents").select("doc_id", "text").collect()
    capacity = {r.plan: r.capacity_tokens for r in read_table(spark, ROOT, "pack_plans").collect()}["main"]
    want = {r.doc_id for r, n in zip(docs, tokens([r.text for r in docs])) if n > capacity}
    got = [r.doc_id for r in Q.p7_found(spark, ROOT).collect()]
    assert set(got) == want and len(got) == len(want)
    report = Q.p7_report(spark, ROOT).first()
    assert report.tokens == sum(tokens([r.text for r in docs])) and report.fullest <= capacity and report.fill > 0.98


def test_short_sources(spark):
    docs = read_table(spark, ROOT, "documents").select("source", "text").collect()
    supply = Counter()
    for r, n in zip(docs, tokens([r.text for r in docs])):
        supply[strip(r.source)] += n
    weights = read_table(spark, ROOT, "mix_weights").collect()
    want = {w.source for w in weights if w.target_weight * w.budget_tokens > w.max_repeats * supply[strip(w.source)]}
    assert {r.source for r in Q.p8_found(spark, ROOT).collect()} == want
    for r in Q.p8_report(spark, ROOT).collect():
        assert r.most_tokens == r.max_repeats * supply[strip(r.source)]
        assert not r.short or r.mixed_tokens == r.most_tokens


def test_clusters_hold_the_definition(spark):
    rows = {r.id: np.array(r.vec, np.float32) for r in V.usable_rows(read_table(spark, ROOT, "embedding_shards")).collect()}
    ids = sorted(rows)
    x = V.unit(np.stack([rows[i] for i in ids]))
    after = dict((r.id_a, r.id_b) for r in Q.p6_found(spark, ROOT).collect())
    label = np.full(len(ids), -1)
    at = {i: k for k, i in enumerate(ids)}
    for c, i in enumerate(sorted(set(after) - set(after.values()))):
        while i is not None:
            label[at[i]] = c
            i = after.get(i)
    sizes = np.bincount(label[label >= 0])
    assert len(sizes) > 5 and sizes.min() >= 10
    cos = x @ V.unit(np.stack([x[label == c].sum(0) for c in range(len(sizes))])).T
    own = cos[np.arange(len(x)), label]
    assert own[label >= 0].min() >= 0.45
    cos[np.flatnonzero(label >= 0), label[label >= 0]] = -1
    assert cos.max() < 0.4
    shown = Q.p6_clusters(spark, ROOT).collect()
    assert sorted(r["size"] for r in shown) == sorted(sizes.tolist()) and all(len(set(r.typical)) == 5 for r in shown)


def test_subset_is_varied(spark):
    got = Q.p1_varied_subset(spark, ROOT).collect()
    assert sorted(r.rank for r in got) == list(range(1, 385))
    rows = {r.id: np.array(r.vec, np.float32) for r in V.usable_rows(read_table(spark, ROOT, "embedding_shards")).collect()}
    x = V.unit(np.stack([rows[r.id] for r in sorted(got, key=lambda r: r.rank)[:192]]))
    s = x @ x.T
    np.fill_diagonal(s, 0)
    rng = np.random.default_rng(0)
    y = V.unit(np.stack([rows[i] for i in rng.choice(sorted(rows), 192, replace=False)]))
    t = y @ y.T
    np.fill_diagonal(t, 0)
    assert s.max() < 0.8 and (s > 0.45).sum() < (t > 0.45).sum() / 10


def test_pairs_that_lack_an_answer(spark):
    """Of the defects one shows by itself: a pair without any letter or digit in its answer is empty, and only pairs of the texts come out."""
    texts = {(r.id, r.text) for r in read_table(spark, ROOT, "normalized").where("id is not null and text is not null").collect()}
    found = {(r.id, r.pair_no): r.defect for r in Q.p2_found(spark, ROOT).collect()}
    every = {(i, n): a for i, t in texts for n, (_, a) in enumerate(R.pairs(t), 1)}
    assert set(found) <= set(every) and set(found.values()) == set(R.DEFECTS)
    bare = {k for k, a in every.items() if not any(c.isalnum() for c in a)}
    assert len([k for k in bare if found.get(k) == "empty"]) >= 0.95 * len(bare)


def test_shares_of_subjects(spark):
    labels = {(r.doc_id, strip(r.subject)) for r in read_table(spark, ROOT, "doc_subject_labels").where("subject is not null").collect()}
    got = {(r.doc_id, strip(r.subject)) for r in Q.p9_found(spark, ROOT).collect()}
    known = {d for d, _ in labels}
    mine = {x for x in got if x[0] in known}
    assert len(mine & labels) / len(mine) > 0.75  # labels by hand, some wrong
    assert all(0.2 - 1e-9 <= r.share <= 1 for r in Q.p9_shares(spark, ROOT).collect())
