"""Each stage of the pipeline against a plainer version of its decision, on the small test tables."""

import re
from collections import Counter

import corpus_pipeline
import pytest

from tallyglass.llm import classifier, jaccard, secrets
from tests.llm import odd

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The rows before the first and after each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stored(stage(spark, out[-1], sf_dir), "test"))
    return out


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "secret_scan", "mix_sources", "pack_windows"]
    for df in stages[:-1]:
        assert df.columns == COLUMNS


def test_quality_stage(spark, sf_dir, stages):
    scores = classifier.quality_scores(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    good = {r["doc_id"] for r in scores if r["score"] >= classifier.CUTOFF}
    assert {r["doc_id"] for r in stages[1].collect()} == good and len(good) < len(scores)


def test_one_of_each_stage(stages):
    before, after = stages[1].collect(), stages[2].collect()
    sets = {}
    for r in before:
        w = odd.words_of(r["text"].lower())
        sets[r["doc_id"]] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    root = {d: d for d in sets}
    ids = sorted(sets)
    for _ in range(5):
        for i, a in enumerate(ids):
            for b in ids[:i]:
                if len(sets[a] & sets[b]) >= jaccard.THRESHOLD * len(sets[a] | sets[b]) - 1e-9:
                    root[a] = root[b] = min(root[a], root[b])
    assert sorted(r["doc_id"] for r in after) == sorted(set(root.values()))


def test_secret_stage(stages):
    before = {r["doc_id"]: r for r in stages[2].collect()}
    after = {r["doc_id"]: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for d, r in after.items():
        assert not secrets.base_spans(r["text"])
        if not secrets.base_spans(before[d]["text"]) and "[secret]" not in r["text"]:
            assert r == before[d]
        assert r["n_chars"] == len(r["text"])


def test_mix_stage(stages):
    before = Counter(w for r in stages[3].collect() for w in re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    after = Counter(w for r in stages[4].collect() for w in re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert abs(sum(after.values()) - sum(before.values())) < 0.02 * sum(before.values())
    assert all(after[w] <= 3 * before[w] for w in after)


def test_pack_stage(stages):
    pieces = stages[5].collect()
    total = sum(p["length"] for p in pieces)
    assert {p["sequence_id"] for p in pieces} == set(range(-(-total // 1024)))
    per = Counter()
    for p in pieces:
        per[p["sequence_id"]] += p["length"]
    assert all(n == 1024 for s, n in per.items() if s < max(per))
    assert len([p for p in pieces if p["start"] == 0]) == stages[4].count()


def test_run_is_the_stages_in_turn(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages[5].count()
