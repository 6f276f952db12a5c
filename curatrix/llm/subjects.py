"""Subject areas of documents: interpolated n-gram language models per subject against a background model.

A labelled sample gives each subject's model, and one of what deals with no subject; the background is a model of its
own, of all subjects in equal parts. A sentence deals with the subject under whose model its tokens cost least, if each
costs enough less than under the background; a document has the subjects of a fifth of its sentences or more. Labels are
those of documents, so the models and the sentences' subjects are estimated in turns. How much less is enough is
calibrated for each subject on documents that were held out.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.tokens import label

TAGS = re.compile(r"<\|start\|>[^<]{0,80}(?:<\|channel\|>[^<]{0,40})?<\|message\|>|<\|[a-z]+\|>")
BREAKS = re.compile(r"(?<=[.!?。!?…])(?:\s+|(?=[^\s\d.!?]))|(?<=[。!?])|\n+")
WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+", re.UNICODE)
HAN = re.compile(r"[一-鿿]")


def plain(text: str) -> str:
    """The prose of a text: message contents without tags, roles or JSON around them, entities resolved."""
    t = html.unescape(text.strip())
    if t.startswith("[{") or t.startswith('{"'):
        try:
            got = json.loads(t)
            got = got if isinstance(got, list) else [got]
            t = "\n".join(str(m.get("content") or "") for m in got if isinstance(m, dict))
        except ValueError:
            t = re.sub(r'"(?:role|content|name)"\s*:\s*|"(?:user|assistant|system|tool)"|[\[\]{}]', "\n", t)
    return TAGS.sub("\n", t)


def sentences(text: str) -> list[list[str]]:
    """The tokens of each sentence with three words or more (four Han characters): words in lower case, digits as one, Han characters in pairs."""
    out = []
    for s in BREAKS.split(plain(text)):
        if not s:
            continue
        if len(HAN.findall(s)) > 3:
            c = HAN.findall(s)
            out.append([a + b for a, b in zip(c, c[1:])])
        else:
            w = ["#" if x[0].isdigit() else x for x in WORDS.findall(s.lower())]
            if len(w) > 2:
                out.append(w)
    return out


class Models:
    """Interpolated unigram and bigram models of all subjects, as log ratios to the background for each known n-gram."""

    def __init__(self, subjects: list[str]):
        self.subjects, self.words, self.pairs = subjects, {}, {}
        # the last model is that of sentences without a subject
        self.one = self.two = np.zeros((0, len(subjects) + 1), np.float32)
        self.least = np.full(len(subjects), 0.25)

    def encode(self, sents: list[list[str]], learn: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers, pair numbers, sentence lengths); -1 for what isn't known, or with ``learn`` a new number."""
        ones, twos, sizes = [], [], []
        word = (lambda w: self.words.setdefault(w, len(self.words))) if learn else (lambda w: self.words.get(w, -1))
        pair = (lambda p: self.pairs.setdefault(p, len(self.pairs))) if learn else (lambda p: self.pairs.get(p, -1))
        for s in sents:
            n = [word(w) for w in s]
            ones += n
            twos += [-1, *map(pair, zip(n, n[1:]))]
            sizes.append(len(n))
        return np.array(ones, int), np.array(twos, int), np.array(sizes, int)

    def estimate(self, ones: np.ndarray, twos: np.ndarray, weight: np.ndarray, held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
        """Models from tokens with a weight for each subject.

        Bigrams are interpolated with unigrams and these with the words of all; the shares are those under which the
        tokens ``held`` out (ones, twos, weights) are likeliest, found by a few steps of expectation maximisation.
        """
        v, p, s = len(self.words), len(self.pairs), len(self.subjects) + 1
        ones_w, known = np.zeros((v, s)), twos >= 0
        twos_w = np.zeros((p, s))
        for j in range(s):
            ones_w[:, j] = np.bincount(ones, weight[:, j], v)
            twos_w[:, j] = np.bincount(twos[known], weight[known, j], p)
        first, second = (np.fromiter(x, int, p) for x in zip(*self.pairs)) if p else (np.zeros(0, int), np.zeros(0, int))
        words = (np.bincount(ones, minlength=v) + 0.5) / (len(ones) + 0.5 * v)
        # the background has all subjects in equal parts, whatever the corpus is made of
        size = np.maximum(ones_w.sum(0), 1)
        ones_w, twos_w = np.column_stack([ones_w, (ones_w / size).sum(1) * size.mean()]), np.column_stack([twos_w, (twos_w / size).sum(1) * size.mean()])
        uni = ones_w / np.maximum(ones_w.sum(0), 1)
        two = twos_w / np.maximum(ones_w[first], 1.0)
        m0, m2 = 0.1, 0.3
        if held is not None:
            a, b, w = held
            mine, w = w.argmax(1), w.max(1)
            m0 = shares([uni[a, mine], words[a]], w)[1]
            ok = b >= 0
            m2 = shares([two[b[ok], mine[ok]], ((1 - m0) * uni + m0 * words[:, None])[a[ok], mine[ok]]], w[ok])[0]
        uni = (1 - m0) * uni + m0 * words[:, None]
        own = m2 * two + (1 - m2) * uni[second]
        self.one = np.log(uni[:, :-1] / uni[:, -1:]).astype(np.float32)
        self.two = np.log(own[:, :-1] / own[:, -1:]).astype(np.float32)

    def gains(self, ones: np.ndarray, twos: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each sentence and subject, what its tokens save against the background in nats."""
        if not len(sizes):
            return np.zeros((0, self.one.shape[1]), np.float32)
        g = np.zeros((len(ones), self.one.shape[1]), np.float32)
        a = ones >= 0
        g[a] = self.one[ones[a]]
        b = twos >= 0
        g[b] = self.two[twos[b]]
        ends = np.cumsum(sizes)
        return np.add.reduceat(g, ends - sizes, 0)

    def shares(self, gains: np.ndarray, sizes: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """For each document and subject, the share of its sentences that deal with it."""
        n = np.zeros((docs, len(self.subjects)))
        if len(gains):
            best = gains.argmax(1)
            top = gains[np.arange(len(gains)), best] / sizes
            hit = np.flatnonzero((best < len(self.subjects)) & (top >= np.append(self.least, np.inf)[best]))
            np.add.at(n, (doc[hit], best[hit]), 1)
        return n / np.maximum(np.bincount(doc, minlength=docs), 1)[:, None]


def shares(likely: list[np.ndarray], weight: np.ndarray, steps: int = 20) -> np.ndarray:
    """The shares of a mixture under which tokens with these likelihoods are likeliest, none below 0.05."""
    mix = np.full(len(likely), 1.0 / len(likely))
    for _ in range(steps):
        part = np.stack([m * x for m, x in zip(mix, likely)])
        part = (part / np.maximum(part.sum(0), 1e-30)) @ weight
        mix = np.maximum(part / max(part.sum(), 1e-30), 0.05)
        mix /= mix.sum()
    return mix


def fit(rows: list[tuple[str, frozenset[str]]], subjects: list[str], turns: int = 5, part: float = 0.2, folds: int = 2) -> Models:
    """Models from (text, subjects) of labelled documents; labels may be wrong or missing.

    Each of ``folds`` parts of the documents is scored by models fitted on the others; on these scores the thresholds
    are calibrated. The models that come out are fitted on all.
    """
    at = {s: j for j, s in enumerate(subjects)}
    # a document all of whose labels are unknown tells nothing; one without labels is of no subject
    rows = [r for r in rows if not r[1] or r[1] & at.keys()]
    sents, doc = [], []
    for k, (t, _) in enumerate(rows):
        for s in sentences(t):
            sents.append(s), doc.append(k)
    doc = np.array(doc, int)
    m = Models(subjects)
    ones, twos, sizes = m.encode(sents, learn=True)
    if not len(sizes):
        return m
    of = np.zeros((len(rows), len(subjects) + 1))
    for k, (_, labels) in enumerate(rows):
        of[k, -1] = 0.2 if labels else 1.0
        for s in labels & at.keys():
            of[k, at[s]] = 1 / len(labels & at.keys())
    where = np.repeat(np.arange(len(sizes)), sizes)
    fold = np.arange(len(rows)) % folds

    def learn(docs: np.ndarray, out: np.ndarray) -> None:
        """Fits on the documents ``docs``; ``out`` are held out for the interpolation."""
        mine, theirs = docs[doc][where], out[doc][where]
        soft = of[doc]
        for turn in range(turns + 1):
            held = (ones[theirs], twos[theirs], soft[where][theirs]) if turn in (1, turns) and theirs.any() else None
            m.estimate(ones[mine], twos[mine], soft[where][mine], held)
            if turn < turns:
                # a document's labels are likely but not sure, and any document has sentences without a subject
                z = m.gains(ones, twos, sizes) + np.log(np.where(of[doc] > 0, 1.0, 0.005))
                z = np.exp(z - z.max(1, keepdims=True))
                soft = z / z.sum(1, keepdims=True)

    g = np.zeros((len(sizes), len(subjects) + 1), np.float32)
    if len(rows) >= 10 * folds:
        for f in range(folds):
            learn(fold != f, fold == f)
            out = fold[doc] == f
            g[out] = m.gains(ones, twos, sizes)[out]
        m.least = thresholds(m, g, sizes, doc, of[:, :-1] > 0, part)
    learn(np.ones(len(rows), bool), fold == 0)
    return m


def thresholds(m: Models, g: np.ndarray, sizes: np.ndarray, doc: np.ndarray, truth: np.ndarray, part: float) -> np.ndarray:
    """For each subject the gain per token from which on a sentence counts: where the documents' labels are met best."""
    grid = np.arange(0.02, 1.2, 0.02)
    f1 = np.zeros((len(grid), len(m.subjects)))
    for k, least in enumerate(grid):
        m.least = np.full(len(m.subjects), least)
        said = m.shares(g, sizes, doc, len(truth)) >= part - 1e-9
        f1[k] = 2 * (said & truth).sum(0) / np.maximum(said.sum(0) + truth.sum(0), 1)
    # few labels say little about one subject: its curve is seen together with that of all
    f1 = f1 + f1.mean(1, keepdims=True)
    return np.array([grid[np.flatnonzero(f1[:, j] >= f1[:, j].max() - 1e-3)].mean() for j in range(len(m.subjects))])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, most: int, seed: int) -> list[tuple[str, frozenset[str]]]:
    """(text, subjects) of at most ``most`` labelled documents, by hash of the id, with all the labels they have."""
    one = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("k"), label("subject").alias("s")).distinct()
    per = one.groupBy("k").agg(F.collect_set("s").alias("s"))
    first = per.orderBy(F.xxhash64("k", F.lit(seed)), "k").limit(most)
    got = docs.where(F.col(text).isNotNull()).join(F.broadcast(first), F.col(id_col) == F.col("k")).select(F.col(text).alias("t"), "s").collect()
    return [(r.t, frozenset(r.s)) for r in got]


def document_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = 6000, part: float = 0.2, seed: int = 0) -> DataFrame:
    """(id, subject, share): the subjects that at least ``part`` of a document's sentences deal with.

    The models are fitted on at most ``sample`` labelled documents; every document is then read as a whole. Documents
    with a null or blank text, and those without a subject, don't come out; each id counts, also if its text occurs
    elsewhere. Labels of other spelling count, unknown ones don't; a null label means none. Without any labels there
    are no subjects. The result names its first column after ``id_col``.
    """
    spark = docs.sparkSession
    names = {r.k: r.subject for r in subjects.where(F.col("subject").isNotNull()).select("subject", label("subject").alias("k")).collect()}
    rows = labelled_sample(docs, labels, id_col, text, sample, seed)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, subject string, share double"
    if not rows or not names:
        return spark.createDataFrame([], schema)
    model = spark.sparkContext.broadcast(fit(rows, sorted(names)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            sents, doc = [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                for s in sentences(t):
                    sents.append(s), doc.append(k)
            ones, twos, sizes = m.encode(sents)
            share = m.shares(m.gains(ones, twos, sizes), sizes, np.array(doc, int), b.num_rows)
            k, j = np.nonzero(share >= part - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(k)), pa.array([names[m.subjects[x]] for x in j], pa.string()), pa.array(share[k, j])], names=[id_col, "subject", "share"])

    return docs.where(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)
