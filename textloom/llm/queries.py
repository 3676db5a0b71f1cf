"""Registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.llm.common import table


def op1_feistel_sharding(spark, sf_dir):
    from textloom.llm import sharding

    placed = sharding.assign(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_embedding_dedup(spark, sf_dir):
    from textloom.llm import embedding_dedup

    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_toxicity_chain(spark, sf_dir):
    from textloom.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_token_files(spark, sf_dir):
    import public_tokenizers

    from textloom.llm import token_files

    shards = token_files.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_documents(shards)


def op5_simhash(spark, sf_dir):
    from textloom.llm import simhash

    found = simhash.group(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_tag_path_text(spark, sf_dir):
    from textloom.llm import html_main

    return html_main.extract(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark, sf_dir):
    from textloom.llm import decontaminate

    return decontaminate.report(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


def op8_pieces(spark, sf_dir):
    import public_tokenizers

    from textloom.llm import pieces

    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_url_filter(spark, sf_dir):
    from textloom.llm import url_filter

    return url_filter.judge(table(spark, sf_dir, "pages"))


def surrogate_key(spark):
    """The secret of the surrogates: a session's ``spark.textloom.surrogate.key``. Without that
    setting a published key stands in, which is good for tests alone."""
    return spark.conf.get("spark.textloom.surrogate.key", None) or "published key for tests"


def op10_surrogates(spark, sf_dir):
    from textloom.llm import pii

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.anonymised(docs, surrogate_key(spark), count_col="n_replaced")


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql():
    from textloom.llm import url_filter

    return {"op9_url_filter": url_filter.judge_sql()}
