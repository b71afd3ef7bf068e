"""The pipeline on a small folder, stage by stage, against brute force."""

import random

import pytest
from test_exact_dedup import normal
from test_jaccard_join import brute_force
from test_packing import check

import corpus_pipeline
from odd import ODD, odd_documents
from termscale.llm.quality import score_quality, train_quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(9)
    words = [f"word{i}" for i in range(300)]
    items = [" ".join(draw.choices(words, k=20)) for _ in range(3)]
    texts = []
    for i in range(60):
        body = draw.choices(words, k=draw.randint(5, 80))
        if i % 10 == 3:
            body[2:2] = items[i % 3].split()
        texts.append(" ".join(body) + "." if i % 3 else " ".join(f"{w}###" for w in body).upper())
    texts += texts[:8] + [t.replace(" ", "\n ", 1) for t in texts[5:9]]
    texts += [" ".join([*t.split()[:-1], "changed"]) for t in texts if len(t.split()) > 60]
    path = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int("###" not in t), 0) for i, t in enumerate(texts) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


def leaks(text, items):
    words = text.lower().replace(".", "").split()
    for item in (i.split() for i in items):
        for at in range(-len(item), len(words)):
            same = [0 <= at + j < len(words) and words[at + j] == w for j, w in enumerate(item)]
            if any(sum(same[j : j + 13]) >= 11 for j in range(len(item) - 12)):
                return True
    return False


def test_stages_against_brute_force(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = train_quality(docs, spark.read.parquet(f"{path}/labels.parquet"))
    rejected = {r.doc_id for r in score_quality(docs, model).collect() if r.predicted == 0}
    kept = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in rejected}
    assert {i for i, t in kept.items() if "###" in t} == set() and rejected
    steps = [set(kept)]
    first = {}
    for i in sorted(kept):
        first.setdefault(normal(kept[i]), i)
    kept = {i: kept[i] for i in first.values()}
    steps.append(set(kept))
    kept = {i: kept[i] for i in {root for _, root in brute_force(kept, 5, 80, 100).values()}}
    steps.append(set(kept))
    kept = {i: t for i, t in kept.items() if not leaks(t, items)}
    steps.append(set(kept))
    assert all(a > b for a, b in zip(steps, steps[1:], strict=False))
    stage_docs = docs
    for (_, stage), ids in zip(corpus_pipeline.STAGES, steps, strict=False):
        stage_docs = stage(spark, stage_docs, path)
        assert stage_docs.columns == docs.columns
        assert {r.doc_id for r in stage_docs.collect()} == ids
    rows = corpus_pipeline.run(spark, path).collect()
    check(rows, kept, 2048)


def test_odd_rows(spark, folder):
    path, _ = folder
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, path)
        assert found.columns == docs.columns or name == "packing"
        assert found.count() <= 1000 * len(ODD)
        assert stage(spark, docs.limit(0), path).count() == 0
