"""The queries of this subpackage: one for each operator, by the digests that are asked of it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bag_minhash, block_anchors, fingerprints, packing, pseudo_likelihood, quality_bayes, quality_rules, secret_links, trie_bpe, warc
from quarry.llm.common import importable, table, text_of


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages archived as WARC records with revisits, and what the reader gets back."""
    found = warc.archived(table(spark, sf_dir, "pages")).where("kind <> 'gap'")
    return found.select(
        warc.page_number(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        warc.page_number(F.col("refers_to")).alias("refers_to"),
    )


def op2_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    found = bag_minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


def op3_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posteriors of low quality and toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_bayes.posteriors(docs, quality_bayes.train(docs, table(spark, sf_dir, "labels")))


def op4_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document with linked weak parts."""
    found, of = secret_links.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, weak, links = (F.col(of)[c] for c in ("base", "weak", "links"))
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{secret_links.KINDS[k]}") for k in range(secret_links.BASE)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secret_links.listed(base), 256).alias("base_sha256"),
        secret_links.listed(F.concat(base, weak)).alias("spans"),
        F.size(weak).cast("long").alias("n_linked"),
        secret_links.listed_links(links).alias("credentials"),
    )


def op5_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df, fp = fingerprints.with_next(docs, "doc_id", "text", fingerprints.sketch, "fp")
    text = fingerprints.edited(text_of("text"), F.col(f"{fp}.next_text"))
    df = df.select("doc_id", F.length(text_of("text")).cast("long").alias("n_chars"), F.col(f"{fp}.own").alias("own"), F.col(f"{fp}.next").alias("next"), text.alias("edited"))
    df = df.withColumn("changed", fingerprints.sketch(F.col("edited")))
    own, other = F.col("own"), F.col("changed")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.written(own).alias("fingerprint"),
        fingerprints.written(other).alias("edited_fingerprint"),
        fingerprints.likeness(own, other).alias("near_edited"),
        fingerprints.likeness(own, F.col("next")).alias("near_next"),
        fingerprints.containment(own, other).alias("contained_edited"),
    )


def vocabulary() -> str:
    """The place of the vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op7_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return trie_bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudo-log-likelihood of every document under a model of all documents."""
    return pseudo_likelihood.trained_scores(table(spark, sf_dir, "documents"))


def op9_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages that occur earlier."""
    return block_anchors.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document by a decision list learnt from labels."""
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    df, stats, result = quality_rules.judged(docs.select("doc_id", "text"), rules)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return df.select("doc_id", *[F.col(f"{stats}.{c}") for c in counts], *[F.col(f"{result}.{c}") for c in ("base_failed", "kept", "rule")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (
        op1_warc_salvage,
        op2_bag_minhash,
        op3_quality_bayes,
        op4_secret_links,
        op5_scaled_sketch,
        op6_bounded_packing,
        op7_trie_bpe,
        op8_pseudo_likelihood,
        op9_block_anchors,
        op10_decision_list,
    )
    import corpus_pipeline


    def ready(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: ready(f) for f in all_} | {"pipeline": ready(corpus_pipeline.run)}


OP1 = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
heads as (select payload_digest, min(page_id) as head from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
  case when head <> page_id then 'revisit' else 'response' end as record_type,
  case when head <> page_id then head end as refers_to
from p left join heads using (payload_digest)
"""


OP9 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
starts as (select doc_id, unnest(range(1, len(ws) - 18)) as p, unnest(list_transform(range(1, len(ws) - 18), lambda i: sha256(array_to_string(ws[i:i + 19], ' ')))) as t
  from d where len(ws) >= 20),
windows as (select doc_id, p, row_number() over (partition by t order by doc_id, p) as k from starts),
gone as (select distinct doc_id, unnest(range(p, p + 20)) as q from windows where k > 1),
words as (select doc_id, unnest(range(1, len(ws) + 1)) as q, unnest(ws) as w from d),
kept as (select doc_id, string_agg(w, ' ' order by q) as t, count(*) as n from words anti join gone using (doc_id, q) group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}) | {"op1_warc_salvage": OP1, "op9_block_anchors": OP9}
