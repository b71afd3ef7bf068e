"""Quality, toxicity and language: held-out accuracy, folds, and rows of every odd kind."""

import zlib

import numpy as np
import pytest
from odd import ODD, no_documents, odd_documents

from termscale.llm import language_id, quality
from termscale.llm.language_id import fit as fit_languages
from termscale.llm.language_id import predict_languages, train_languages
from termscale.llm.passages import WIDTH, encode_group
from termscale.llm.queries import op3_quality, op6_toxicity, op9_language_id
from termscale.llm.toxicity import fit_chain, probabilities, score_toxicity, train_toxicity, word_numbers

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def truth(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    return {r.doc_id: r for r in docs.join(labels, "doc_id", "left").collect()}


def test_quality_on_held_out_documents(spark, truth):
    rows = op3_quality(spark, SF_DIR).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id].quality is not None]
    assert np.mean([r.predicted == truth[r.doc_id].quality for r in held]) > 0.95


def test_attention_gradient():
    draw = np.random.default_rng(0)
    documents = [draw.standard_normal((n, WIDTH)) for n in (1, 3, 2)]
    labels, passages, every = np.array([1.0, 0, 1]), np.array([1, 3, 2]), np.concatenate(documents)
    model = quality.fit(documents, labels)

    def loss():
        logit = quality._forward(model, every, passages)[0]
        return np.mean(np.log1p(np.exp(-np.where(labels == 1, logit, -logit))))

    logit, saved = quality._forward(model, every, passages)
    grown = quality._gradient(model, passages, saved, (quality._sigmoid(logit) - labels) / 3)
    for name in ("encode", "encode_bias", "turn", "gate", "attend", "score"):
        place = tuple(s // 2 for s in model[name].shape)
        kept = model[name][place]
        model[name][place] = kept + 1e-5
        above = loss()
        model[name][place] = kept - 1e-5
        below = loss()
        model[name][place] = kept
        assert grown[name][place] == pytest.approx((above - below) / 2e-5, rel=1e-3, abs=1e-7)


def test_passages_do_not_depend_on_the_group():
    texts = ["one two three", "", " \n lead and trail \n ", "ÄÖ! x" * 300, "w " * 130]
    together, counts = encode_group(texts)
    assert counts.tolist() == [1, 1, 1, 5, 3]
    parts = np.split(together, np.cumsum(counts)[:-1])
    for text, part in zip(texts, parts, strict=True):
        np.testing.assert_allclose(encode_group([text])[0], part, rtol=1e-5, atol=1e-6)


def test_toxicity(spark, truth):
    rows = {r.doc_id: r for r in op6_toxicity(spark, SF_DIR).collect()}
    assert rows.keys() == truth.keys()
    assert all(r.toxic == (r.score >= 0.3) and r.score == r.p_toxic for r in rows.values())
    toxic = [i for i, r in truth.items() if r.toxic == 1]
    clean = [i for i, r in truth.items() if r.toxic == 0]
    assert np.mean([rows[i].toxic for i in toxic]) > 0.95 and np.mean([rows[i].toxic for i in clean]) < 0.01


def test_toxicity_on_held_out_documents(truth):
    known = sorted((i, r) for i, r in truth.items() if r.toxic is not None)
    words = [word_numbers(r.text) for _, r in known]
    labels = np.array([[1 - r.quality, r.toxic] for _, r in known], float)
    held = np.arange(len(known)) % 4 == 0
    chain = fit_chain([w for w, h in zip(words, held, strict=True) if not h], labels[~held])
    earlier = np.zeros((held.sum(), 0))
    for link in chain:
        some = [w for w, h in zip(words, held, strict=True) if h]
        earlier = np.hstack([earlier, probabilities(link, some, earlier)[:, None]])
    found, wanted = earlier[:, 1] >= 0.3, labels[held, 1] == 1
    # 40 toxic documents to learn from: most words of toxic texts have been seen.
    assert found[wanted].mean() > 0.6 and found[~wanted].mean() < 0.02


def test_languages_on_held_out_documents(spark, truth):
    rows = op9_language_id(spark, SF_DIR).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in rows if r.held_out]) > 0.97


def grams(data):
    return {data[i : i + n] for n in range(1, 5) for i in range(len(data) - n + 1)}


def test_presence_kernel_by_definition():
    texts = ["ab ab", "abc", "", "a", "the quick brown fox", "der schnelle Fuchs"]
    parts, _ = language_id.passages(texts)
    # All texts in one call: no n-gram runs into the next one.
    vectors = language_id.presence(parts)
    for a, va in zip(parts, vectors, strict=True):
        for b, vb in zip(parts, vectors, strict=True):
            expected = len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
            assert va @ vb == pytest.approx(expected, abs=0.02)


def test_kernel_of_a_long_text_is_the_mean_of_its_passages(monkeypatch):
    monkeypatch.setattr(language_id, "PASSAGE", 16)
    text, marks = "abc def ghi jkl mno pqr stu", language_id.presence([b"abc ", b"xyz "]).T
    coded = text.encode() + b" "
    each = [language_id.presence([coded[:16]]) @ marks, language_id.presence([coded[16:]]) @ marks]
    assert language_id.kernel([text, "zz"], marks)[0] == pytest.approx(np.mean(each, axis=0)[0], abs=1e-6)


def test_a_language_is_a_function_of_the_text(spark):
    """Alone, beside any others, and on any partition a text has the same language and score."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang")
    cut = docs.selectExpr("doc_id + 10000 AS doc_id", "left(text, 12) AS text", "lang")
    long = docs.filter("lang = 'en'").limit(1).selectExpr("-1L AS doc_id", "repeat(text || ' ', 2000000 div (1 + length(text))) AS text", "lang")
    every = docs.union(cut).union(long)
    model = train_languages(docs)
    found = [
        {r.doc_id: (r.lang_pred, r.score) for r in predict_languages(x, model).collect()}
        for x in (every.coalesce(1), every.repartition(4), every.repartition(37, "text"))
    ]
    assert found[0] == found[1] == found[2]
    assert found[0][-1][0] == "en" and found[0][-1][1] > 0.9


def test_odd_rows(spark):
    model = quality.train_quality(odd_documents(spark), spark.createDataFrame([(1, 1), (6, 0), (3, None)], "doc_id long, quality int"))
    rows = quality.score_quality(odd_documents(spark), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score_quality(odd_documents(spark), None).collect()} == {0.5}
    assert quality.score_quality(no_documents(spark), model).count() == 0
    kept = quality.without_rejected(odd_documents(spark), None, threshold=0.6)
    assert kept.columns == odd_documents(spark).columns and kept.count() == 0

    labels = spark.createDataFrame([(1, 1), (6, 0), (9, 0), (4, None), (77, 1)], "doc_id long, toxic int")
    toxic = train_toxicity(odd_documents(spark), labels, {"toxic": "toxic"})
    assert score_toxicity(odd_documents(spark), toxic, ["toxic"]).count() == len(ODD)
    assert train_toxicity(odd_documents(spark), labels.limit(0), {"toxic": "toxic"}) is None
    assert {r.score for r in score_toxicity(odd_documents(spark), None, ["a", "b"]).collect()} == {0.0}
    assert score_toxicity(no_documents(spark), toxic, ["toxic"]).count() == 0

    languages = fit_languages(["the cat and the dog", "der Hund und die Katze"] * 3, ["en", "de"] * 3)
    rows = predict_languages(odd_documents(spark), languages).collect()
    und = sorted((r.doc_id or 0) for r in rows if r.lang_pred == "und")
    assert len(rows) == len(ODD) and und == [0, 3, 4, 5, 6] and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in predict_languages(odd_documents(spark), None).collect()} == {"und"}
    assert predict_languages(no_documents(spark), languages).count() == 0


def test_each_row_is_rejected_by_its_own_text(spark):
    good, junk = "This is a plain sentence about rivers and towns.", "### @@@ ### ### !!! ### @@@"
    model = quality.train_quality(
        spark.createDataFrame([(i, junk if i % 2 else good) for i in range(40)], "doc_id long, text string"),
        spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int"),
    )
    rows = [(None, good), (None, junk), (1, junk), (1, good), (2, junk), (3, good)]
    kept = quality.without_rejected(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(None, good), (1, good), (3, good)], key=str)
