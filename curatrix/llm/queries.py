"""Queries of the training-data problems, by name; each takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_varied_subset(spark: SparkSession, root: str) -> DataFrame:
    """A varied subset of 384 records, with what is known of each."""
    from curatrix.llm.subset import varied_subset

    shards = read_table(spark, root, "embedding_shards")
    picked = F.broadcast(varied_subset(shards, 384))  # 384 rows
    about = shards.join(picked, "id", "left_semi").groupBy("id").agg(F.min("dataset").alias("dataset"), F.min("meta_domain").alias("meta_domain"))
    return about.join(picked, "id").select("id", "rank", "round", "dataset", "meta_domain")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of question and answer with a defect."""
    from curatrix.llm.pairs import broken_pairs

    return broken_pairs(read_table(spark, root, "normalized"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Unordered pairs in which one is among the five most similar of the other, at a cosine of 0.8 or more."""
    from curatrix.llm.neighbours import permutation_neighbours

    near = permutation_neighbours(read_table(spark, root, "embedding_shards"), k=5, least_cosine=0.8)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p3_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The five most similar other ids of every id."""
    from curatrix.llm.neighbours import permutation_neighbours

    return permutation_neighbours(read_table(spark, root, "embedding_shards"), k=5, posts=None, candidates=None)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Ids that follow each other in the sorted list of a cluster."""
    from curatrix.llm.clusters import consecutive, density_clusters

    members = density_clusters(read_table(spark, root, "embedding_shards"))
    return consecutive(members, int(spark.conf.get("spark.sql.shuffle.partitions")))


def p6_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Size and most typical members of each cluster."""
    from curatrix.llm.clusters import density_clusters, describe

    return describe(density_clusters(read_table(spark, root, "embedding_shards")))


def sized_documents(spark: SparkSession, root: str, *keep: str) -> DataFrame:
    """(doc_id, *keep, tokens) of every document."""
    from curatrix.llm.tokens import with_token_counts

    return with_token_counts(read_table(spark, root, "documents"), keep=("doc_id", *keep))


def p4_plan(spark: SparkSession, root: str) -> DataFrame:
    """What is drawn for each target, and which can't be met."""
    from curatrix.llm.proportions import signed, target_plan

    return target_plan(signed(read_table(spark, root, "normalized")), read_table(spark, root, "quota_targets"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Targets that need more than their supply."""
    return p4_plan(spark, root).where("short").select("target_id")


def p4_sample(spark: SparkSession, root: str) -> DataFrame:
    """The sample: each drawn id with its target."""
    from curatrix.llm.proportions import proportional_sample, signed, target_plan

    records = signed(read_table(spark, root, "normalized"))
    return proportional_sample(records, target_plan(records, read_table(spark, root, "quota_targets")))


def p5_token_budget(spark: SparkSession, root: str) -> DataFrame:
    """Documents and tokens by dataset, language and domain."""
    from curatrix.llm.tokens import label, token_budget

    slices = {"dataset": label("dataset"), "meta_domain": label("meta_domain")}
    return token_budget(read_table(spark, root, "normalized"), slices)


def filled(spark: SparkSession, root: str, plan: str) -> tuple[DataFrame, int]:
    from curatrix.llm.containers import fill_containers

    capacity = read_table(spark, root, "pack_plans").where(F.col("plan") == plan).agg(F.max("capacity_tokens")).first()[0]
    return fill_containers(sized_documents(spark, root), capacity), capacity


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that plan main splits."""
    return filled(spark, root, "main")[0].where("part = 1").select("doc_id").distinct()


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    """The container of each document, or of each of its parts, under plan main."""
    return filled(spark, root, "main")[0]


def p7_report(spark: SparkSession, root: str) -> DataFrame:
    """How well plan main fills its containers."""
    from curatrix.llm.containers import container_report

    return container_report(*filled(spark, root, "main"))


def p8_report(spark: SparkSession, root: str) -> DataFrame:
    """Target and reached share of each source."""
    from curatrix.llm.mixing import balance, mix_report, mix_sources
    from curatrix.session import cut_lineage

    sized, weights = cut_lineage(sized_documents(spark, root, "source")), read_table(spark, root, "mix_weights")
    solved = balance(sized, weights)
    return mix_report(weights, solved, mix_sources(sized, weights, solved))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Sources whose target is more than all their tokens, repeated as often as allowed."""
    return p8_report(spark, root).where("short").select("source")


def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    """The documents of the mix with their copies."""
    from curatrix.llm.mixing import mix_sources
    from curatrix.session import cut_lineage

    return mix_sources(cut_lineage(sized_documents(spark, root, "source")), read_table(spark, root, "mix_weights"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """The subjects of each document."""
    return p9_shares(spark, root).select("doc_id", "subject").distinct()


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    """The subjects of each document with the share of its sentences that deal with them."""
    from curatrix.llm.subjects import document_subjects

    return document_subjects(*(read_table(spark, root, t) for t in ("documents", "doc_subject_labels", "subjects")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_varied_subset, p2_found, p3_found, p3_neighbours, p4_found, p4_plan, p4_sample, p5_token_budget, p6_found, p6_clusters, p7_found, p7_containers, p7_report, p8_found, p8_report, p8_mix, p9_found, p9_shares)}


# The supply of each target, straight from its definition.
P4 = """
WITH rows AS (
  SELECT DISTINCT id, lower(regexp_replace(dataset, '^\\s+|\\s+$', '', 'g')) AS d, lower(regexp_replace(meta_domain, '^\\s+|\\s+$', '', 'g')) AS m,
         nullif(lower(regexp_replace(meta_difficulty_bin, '^\\s+|\\s+$', '', 'g')), '') AS b
  FROM normalized WHERE id IS NOT NULL AND text IS NOT NULL)
SELECT t.target_id FROM quota_targets t LEFT JOIN rows r
  ON r.d = lower(t.dataset) AND r.m = lower(t.meta_domain) AND r.b IS NOT DISTINCT FROM nullif(lower(t.meta_difficulty_bin), '')
GROUP BY t.target_id, t.min_rows, t.target_share, t.sample_rows
HAVING greatest(t.min_rows, t.target_share * t.sample_rows) > count(DISTINCT r.id)
"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4}
