"""The operators' queries with production parameters, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from annals.llm import html_main_text, maxent_lm, mixing, near_dedup, quality_rules, sentencepiece_codec, token_tables, topk, toxicity, warc
from annals.llm.common import saved
from annals.session import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digest(rows, *more: str):
    """doc_id, n_tokens and the two digests of rows with ids and decoded, then more of their columns."""
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *more,
    )


def op1_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.roundtrip(docs, tokenizer("piece_bpe_32k.model"))
    return digest(coded, F.element_at("ends", -1).cast("long").alias("n_bytes"), F.xxhash64("begins", "ends").alias("spans_xxhash64"))


def op2_minhash_near_dedup(spark, sf_dir):
    return near_dedup.link(table(spark, sf_dir, "documents"), words=3, percent=85)


def op3_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op4_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    _, _, folder = warc.archived(pages)
    found = warc.read(saved(warc.located(folder, pages), "located"), folder)
    return found.select("page_id", "payload_bytes", F.coalesce("computed", "payload_digest").alias("payload_digest"), "record_type", "refers_to")


def op5_token_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest, folder = token_tables.written(docs, tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_tables.read(manifest, folder)


def op6_topk(spark, sf_dir):
    return topk.join(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op7_maxent_lm(spark, sf_dir):
    return maxent_lm.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.CATEGORIES))


def op9_html_main_text(spark, sf_dir):
    return html_main_text.extract(table(spark, sf_dir, "pages"))


def op10_mixing(spark, sf_dir):
    return mixing.plan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_minhash_near_dedup, op3_quality_rules, op4_warc, op5_token_tables, op6_topk, op7_maxent_lm, op8_toxicity, op9_html_main_text, op10_mixing)}
ORACLES: dict[str, str] = {}
