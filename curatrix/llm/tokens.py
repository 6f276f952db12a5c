"""Token counts under a public byte-level BPE tokenizer.

The vocabulary file is a parameter; it stays where it is installed. Counts don't include special tokens, whose strings
in a text are ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.languages import UNKNOWN, WORDS, tongue
from curatrix.session import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pre-splitting pattern of the tokenizer (public).
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a vocabulary file; loaded once in a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str = "text", out: str = "tokens", vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, out): the tokens of each text, without a shuffle; null and empty texts have none.

    Pieces repeat, so a task keeps the lengths of the pieces it has met (at most 500,000) and tokenizes each once.
    """
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField(out, T.LongType())])
    target = "__text"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        enc = encoder(vocabulary)
        split = regex.compile(PIECES).findall
        known: dict[str, int] = {}
        for b in batches:
            counts = []
            for t in b.column(target).to_pylist():
                n = 0
                for p in split(t) if t else ():
                    k = known.get(p)
                    if k is None:
                        if len(known) > 500_000:
                            known.clear()
                        k = known[p] = len(enc.encode_ordinary(p))
                    n += k
                counts.append(n)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(counts, pa.int64())], names=[*keep, out])

    return df.select(*keep, F.col(text).alias(target)).mapInArrow(run, schema)


INSTRUCTIONS = re.compile(r"<\|start\|>(?:system|developer).*?<\|end\|>|<\|[a-z]+\|>", re.S)


def language_of(text: str | None) -> str | None:
    """The language that a text shows (see :mod:`curatrix.llm.languages`); instructions of the system don't count.

    None for a null text and for one without letters; ``unknown`` where letters tell no language.
    """
    if not text:
        return None
    own = INSTRUCTIONS.sub(" ", text)
    words = WORDS.findall(own.lower())
    return tongue(words, own)[0] or UNKNOWN if words else None


def label(name: str) -> Column:
    """A label without outer white space and in lower case; empty ones are missing."""
    return F.nullif(F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", "")), F.lit(""))


#: Repeated ids that are sent to all executors (about 50 MB); more are joined by shuffles.
REPEATED = 1_000_000


def one_per_id(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """The first row of each id by ``order``; rows without an id stay, each for itself.

    Only ids are shuffled to see which are repeated; of the rows, texts and all, only theirs are.
    """
    ids = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__again")).agg(F.count(F.lit(1)).alias("__n"))
    again = cut_lineage(ids.where("__n > 1").select("__again"))
    few = F.broadcast(again) if again.count() <= REPEATED else again
    same = F.col(id_col) == F.col("__again")
    w = Window.partitionBy(id_col).orderBy(*order)
    first = df.join(few, same, "left_semi").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return df.join(few, same, "left_anti").unionByName(first)


def token_budget(df: DataFrame, slices: dict[str, Column], text: str = "text", id_col: str | None = "id", order: str | None = "ingested_at", language: str | None = "language", vocabulary: str = VOCABULARY, held: int = 500_000) -> DataFrame:
    """(*slices, language, documents, tokens): exact totals of documents and tokens in each combination of ``slices`` and language.

    Texts are split into pieces as the tokenizer does, and a task counts its pieces by slice (at most ``held`` counts
    at a time). Counts of a piece meet, each distinct piece is tokenized once, and its length goes to the sums. A piece
    has at most one count per slice and task, so no piece gathers the texts it occurs in.

    Of rows with the same ``id_col`` the first by ``order`` counts, rows with a null id count each; null and empty
    texts are documents without tokens; null slices are slices of their own. ``language`` names the column for the
    language that :func:`language_of` reads from the text; None leaves it out. Empty input gives no rows.
    """
    given = list(slices)
    names = [*given, *([language] if language else [])]
    keep = [c for c in (id_col, order) if c]
    rows = df.select(*[F.col(c).alias(f"__{n}") for c, n in zip(keep, ("id", "order"))], F.col(text).alias("__text"), *[c.cast("string").alias(n) for n, c in slices.items()])
    if id_col:
        rows = one_per_id(rows, "__id", [*(["__order"] if order else []), "__text", *slices])
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("piece", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(PIECES).findall
        counts: dict[tuple, Counter] = {}

        def flush() -> pa.RecordBatch:
            flat = [(*s, p, n) for s, c in counts.items() for p, n in c.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*flat), [pa.string()] * (len(names) + 1) + [pa.int64()])], names=[*names, "piece", "n"])

        for b in batches:
            texts = b.column("__text").to_pylist()
            for t, *s in zip(texts, *[b.column(n).to_pylist() for n in given]):
                c = counts.setdefault((*s, language_of(t)) if language else tuple(s), Counter())
                c[""] += 1  # the empty piece stands for the document
                if t:
                    c.update(split(t))
            if sum(map(len, counts.values())) > held:
                yield flush()
        if counts:
            yield flush()

    counted = rows.select("__text", *slices).mapInArrow(count, schema).groupBy(*names, "piece").agg(F.sum("n").alias("n"))
    uses = counted.groupBy("piece").agg(F.collect_list(F.struct(*names, "n")).alias("uses"))
    kind = dict(uses.dtypes)["uses"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            words = b.column("piece").to_pylist()
            lengths = pa.array([len(enc.encode_ordinary(w)) for w in words], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([w == "" for w in words], pa.bool_()), lengths, b.column("uses")], names=["mark", "tokens", "uses"])

    lengths = uses.mapInArrow(run, f"mark boolean, tokens long, uses {kind}")
    flat = lengths.select("mark", "tokens", F.explode("uses").alias("u")).select("mark", "tokens", "u.*")
    return flat.groupBy(*names).agg(
        F.sum(F.when(F.col("mark"), F.col("n")).otherwise(0)).alias("documents"), F.sum(F.col("tokens") * F.col("n")).alias("tokens")
    )
