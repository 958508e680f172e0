"""Toxic passages, and the pipeline stage by stage."""

import random
import zlib

import pytest

import corpus_pipeline
from framegauge.llm.line_dedup import line_dedup
from framegauge.llm.queries import TOXIC_SCORE, op10_toxicity
from framegauge.llm.simhash_dedup import simhash_groups
from framegauge.llm.toxicity import ToxicityModel, fit_toxicity, held_out, maximal_segments, toxic_passages

SF = "/root/testdata/sf0.01"


def by_definition(scores, offset=0):
    """The best segment, the shortest of equals, then those on its left and on its right."""
    if not scores or max(scores) <= 0:
        return []
    sums = ((sum(scores[i:j]), i - j, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))
    total, _, i, j = max(sums, key=lambda x: (x[0], x[1]))
    return by_definition(scores[:i], offset) + [(offset + i, offset + j, total)] + by_definition(scores[j:], offset + j)


def test_maximal_segments():
    choice = random.Random(3)
    for _ in range(800):
        scores = [choice.choice([-3, -2, -1, -1, 1, 2, 3, 5]) + choice.random() / 1000 for _ in range(choice.randint(0, 14))]
        got = [(s, e, round(v, 6)) for s, e, v in maximal_segments(scores)]
        assert got == [(s, e, round(v, 6)) for s, e, v in by_definition(scores)]
    assert maximal_segments([1.0, -0.1] * 200_000)[0][:2] == (0, 399_999)


def made_up(n):
    choice = random.Random(n)
    plain = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [choice.choice(plain) for _ in range(choice.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            at = choice.randrange(len(words))
            words[at:at] = [choice.choice(["slur", "insult", "curse"]) + choice.choice(["", "ing", "s"]) for _ in range(4)]
        docs.append((i, " ".join(words), "s", 0.5))
        labels.append((i, int(toxic)))
    return docs, labels


def test_model_and_passages(spark):
    docs, labels = made_up(900)
    extra = [(5000, None, None, None), (5001, "", None, None), (None, "slur insult curse slur", None, None), (5002, "word1 " * 60_000 + "slur insult curse slur", "s", 1.0)]
    frame = spark.createDataFrame(docs + extra, "doc_id bigint, text string, source string, toxicity double")
    marks = spark.createDataFrame(labels + [(7, None), (None, 1), (3, 0), (3, 0)], "doc_id bigint, toxic int")
    model = fit_toxicity(frame, marks)
    found = {r["doc_id"]: r for r in toxic_passages(frame, model).collect()}
    unseen = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    wrong = [i for i in unseen if (found[i]["toxicity"] >= TOXIC_SCORE) != (i % 5 == 0)]
    assert len(unseen) > 200 and len(wrong) <= 0.02 * len(unseen)
    assert found[5000]["passages"] == found[5001]["passages"] == [] and found[5000]["toxicity"] < 0.5
    assert found[5002]["toxicity"] >= TOXIC_SCORE and found[5002]["passages"][0]["text"] == "slur insult curse slur"
    assert found[5002]["passages"][0]["start"] == 60_000 and found[None]["toxicity"] >= TOXIC_SCORE
    assert all(0 <= r["toxicity"] <= 1 for r in found.values())


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(i, 0) for i in range(50)]])
def test_labels_of_one_class_at_most(spark, labels):
    docs = spark.createDataFrame([(i, "some words here") for i in range(50)], "doc_id bigint, text string")
    model = fit_toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert model == ToxicityModel() and toxic_passages(docs, model).where("toxicity >= 0.7").count() == 0
    assert toxic_passages(docs.limit(0), model).count() == 0


def test_held_out_third(spark):
    df = spark.range(300).select("id", held_out(spark.range(1).id if False else __import__("pyspark").sql.functions.col("id")).alias("h"))
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in df.collect())


def test_toxicity_of_the_documents(spark):
    scored = op10_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    clean, toxic = scored[scored.toxic == 0], scored[scored.toxic == 1]
    assert (clean.predicted == 0).mean() >= 0.97 and (toxic.predicted == 1).mean() >= 0.6


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    sizes = [docs.count()]
    for name in ("toxicity", "quality rules", "line dedup", "SimHash near-dedup"):
        before, docs = docs, stage[name](spark, docs, SF).persist()
        assert docs.columns == corpus_pipeline.COLUMNS
        sizes.append(docs.count())
        if name == "line dedup":
            want = {r["doc_id"]: r["text"] for r in line_dedup(before).collect()}
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
        if name == "SimHash near-dedup":
            groups = {r["component_id"] for r in simhash_groups(before).collect()}
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == groups
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4] > 0.3 * sizes[0]
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    assert set(pieces.doc_id) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert (pieces.groupby("doc_id")["length"].sum() == pieces.groupby("doc_id")["doc_tokens"].first()).all()
