"""A corpus pipeline over the documents table: from raw documents to the token ids of a mix.

Each stage works on all that its predecessor kept; see each operator for its defined cases.
"""

from __future__ import annotations

from annals.llm import mixing, near_dedup, quality_rules, queries, sentencepiece_codec, toxicity
from annals.llm.common import saved
from annals.session import table


def quality(spark, docs, sf_dir):
    """Base rules and robust outliers by language and source; rejected documents go."""
    return quality_rules.accepted(docs)


def toxic(spark, docs, sf_dir):
    """A chain fitted on the labelled rows of this stage's input; toxic documents go."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.CATEGORIES))


def near(spark, docs, sf_dir):
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8)."""
    return near_dedup.deduplicated(docs, words=5, percent=80)


def mix(spark, docs, sf_dir):
    """Sources to their target weights; a document taken twice is there twice."""
    return mixing.mixed(docs)


def encode(spark, docs, sf_dir):
    """Token ids of every text of the mix with the digests of ids and decoded text."""
    coded = sentencepiece_codec.roundtrip(docs.select("doc_id", "text"), queries.tokenizer("piece_bpe_32k.model"))
    return queries.digest(coded, "ids")


STAGES = [("quality_rules", quality), ("toxicity", toxic), ("near_dedup", near), ("mixing", mix), ("sentencepiece", encode)]

#: The classifier and estimator stages are iterative; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
