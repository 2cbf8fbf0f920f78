"""The pipeline's stages, each against its contract on its own input, and run() as their composition."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from annals.llm import queries, quality_rules, toxicity
from annals.llm.common import saved
from annals.session import table

from . import brute


@pytest.fixture(scope="module")
def made(spark, small):
    """The input of every stage and the last result."""
    docs = [table(spark, small, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(saved(stage(spark, docs[-1], small), name))
    return docs


def rows(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def test_stages_keep_the_columns(made):
    for out in made[1:-1]:
        assert out.columns == made[0].columns


def test_rejections_take_effect(spark, small, made):
    kept = {r[0] for r in rows(quality_rules.judge(made[0]).where("kept"), "doc_id")}
    assert {r[0] for r in rows(made[1], "doc_id")} == kept
    chain = toxicity.fit(made[1], table(spark, small, "labels"), toxicity.CATEGORIES)
    fine = {r[0] for r in rows(toxicity.score(made[1], chain).where("not toxic"), "doc_id")}
    assert {r[0] for r in rows(made[2], "doc_id")} == fine and fine < kept


def test_one_of_each_group_stays(made):
    truth = brute.near_duplicates(rows(made[2], "doc_id", "text"), 5, 80)
    assert {r[0] for r in rows(made[3], "doc_id")} == {i for i, (_, c) in truth.items() if c == i}


def test_the_mix_meets_its_targets(made):
    size, taken, whole = {}, {}, {}
    for i, t, s in rows(made[3], "doc_id", "text", "source"):
        whole[i] = len(brute.words(t))
        size[s] = size.get(s, 0) + whole[i]
    each: dict = {}
    for i, t, s, n in rows(made[4], "doc_id", "text", "source", "n_chars"):
        assert n == len(t)
        k = len(brute.words(t))
        taken[s] = taken.get(s, 0) + k
        each[i] = each.get(i, 0) + k
    goal = brute.mix_targets(size)
    assert all(abs(taken[s] - goal[s]) <= 1 for s in size)
    assert all(k <= 2 * whole[i] for i, k in each.items())


def test_the_last_stage_encodes_the_mix(made):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    want = []
    for i, t in rows(made[4], "doc_id", "text"):
        ids = [*library.encode(t), library.eos_id()]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(want) == sorted(rows(made[5], "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))


def test_run_is_the_composition(spark, small, made):
    names = ("doc_id", "n_tokens", "ids_sha256")
    assert sorted(rows(corpus_pipeline.run(spark, small), *names)) == sorted(rows(made[-1], *names))


def test_stages_bear_odd_and_no_rows(spark, small, odd_docs, no_docs):
    shaped = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    nameless = shaped.unionByName(shaped.where("doc_id in (1, 10)").withColumn("doc_id", F.lit(None).cast("long")))
    for docs in (nameless, no_docs.select(shaped.columns)):
        for name, stage in corpus_pipeline.STAGES:
            docs = saved(stage(spark, docs, small), name)
