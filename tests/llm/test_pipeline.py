"""The pipeline's stages against what each is to do with its own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stepchange.llm import toxicity
from stepchange.llm.common import table, written
from test_corpus import brute_lines, brute_links

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, found = table(spark, FOLDER, "documents"), {}
    found["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = found[name] = written(stage(spark, docs, FOLDER), name)
    return found


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_columns_and_order(stages):
    for name in list(stages)[:-1]:
        assert stages[name].columns == stages["documents"].columns
    assert list(stages)[1:] == ["toxicity", "line_dedup", "near_dup", "decontaminate", "mix"]


def test_toxicity_rejects_what_its_scores_say(spark, stages):
    model = toxicity.train(stages["documents"], table(spark, FOLDER, "labels"))
    kept = toxicity.score(stages["documents"], model).where("score < 0.5")
    assert {r.doc_id for r in kept.collect()} == set(texts(stages["toxicity"]))


def test_line_dedup_against_brute_force(stages):
    before = texts(stages["toxicity"])
    assert texts(stages["line_dedup"]) == brute_lines(sorted(before.items()))


def test_near_dup_against_brute_force(stages):
    before = texts(stages["line_dedup"])
    assert set(texts(stages["near_dup"])) == {i for i, (_, root) in brute_links(before).items() if i == root}


def test_decontamination_leaves_no_window(spark, stages):
    before, after = texts(stages["near_dup"]), texts(stages["decontaminate"])
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    windows = set()
    for r in table(spark, FOLDER, "benchmark").collect():
        words = split(r.text or "")
        windows |= {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()
    hit = {i for i, t in before.items() if any(tuple(w[j : j + n]) in windows for n in {len(x) for x in windows} for w in [split(t)] for j in range(len(w) - n + 1))}
    assert set(after) == set(before) - hit and hit


def test_mix_takes_its_targets(stages):
    sums = stages["mix"].groupBy("source").agg(F.sum("copy_words").alias("n"), F.first("target").alias("t")).collect()
    assert sums and all(abs(r.n - r.t) <= 0.5 for r in sums)


def test_run_is_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, FOLDER).count() == stages["mix"].count()


def test_pipeline_of_an_empty_table(spark, stages):
    docs = stages["documents"].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER), name)
        assert docs.count() == 0


