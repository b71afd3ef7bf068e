"""Toxicity by a classifier chain of linear models over words.

Categories are predicted one after the other; each model also sees the probabilities of the categories before it.
For training those come out of fold, so that a later model does not lean on probabilities that were fitted to
the very same documents.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: Labelled documents that the chain is fitted on, at most; the choice is by a hash of the id.
MAX_TRAINING = 6000
#: Hashed words, training documents that must hold a word, folds, steps of the optimiser, ridge.
WORDS, LEAST, FOLDS, STEPS, RATE, RIDGE = 1 << 20, 3, 3, 120, 0.05, 2e-4
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")


def word_numbers(text: str | None) -> np.ndarray:
    """The distinct hashed words of a text."""
    words = set(_WORD.findall((text or "").lower()))
    numbers = np.fromiter((xxh3_64_intdigest(w) & (WORDS - 1) for w in words), np.int64, len(words))
    return np.unique(numbers)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _sums(values, ends):
    """Sums of neighbouring values up to each of `ends`."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def fit_linear(documents: list[np.ndarray], earlier: np.ndarray, labels: np.ndarray) -> dict:
    """Logistic regression on words, each scaled by its log odds, and on earlier probabilities."""
    flat = np.concatenate([*documents, np.zeros(0, np.int64)])
    rows = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    seen = np.bincount(flat, minlength=WORDS)
    keep = seen[flat] >= LEAST
    flat, rows = flat[keep], rows[keep]
    ends = np.searchsorted(rows, np.arange(len(documents)), "right")
    used, column = np.unique(flat, return_inverse=True)
    positive = np.bincount(column, labels[rows], len(used))
    negative = np.bincount(column, 1 - labels[rows], len(used))
    odds = np.log((positive + 0.5) / (labels.sum() + 1)) - np.log((negative + 0.5) / ((1 - labels).sum() + 1))
    scale = odds[column]
    size = len(used)
    weights, bias = np.zeros(size + earlier.shape[1]), 0.0
    first, second = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    for step in range(1, STEPS + 1):
        logit = _sums(scale * weights[column], ends) + earlier @ weights[size:] + bias
        error = (_sigmoid(logit) - labels) / len(labels)
        grown = np.concatenate([np.bincount(column, scale * error[rows], size), earlier.T @ error, [error.sum()]])
        grown[:-1] += RIDGE * weights
        first, second = 0.9 * first + 0.1 * grown, 0.999 * second + 0.001 * grown**2
        move = RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    words = np.zeros(WORDS, np.float32)
    words[used] = odds * weights[:size]
    return {"words": words, "earlier": weights[size:], "bias": bias}


def probabilities(model: dict, documents: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
    ends = np.cumsum([len(d) for d in documents])
    sums = _sums(model["words"][np.concatenate([*documents, np.zeros(0, np.int64)])].astype(float), ends)
    return _sigmoid(sums + earlier @ model["earlier"] + model["bias"])


def fit_chain(documents: list[np.ndarray], labels: np.ndarray) -> list[dict]:
    """One model per column of `labels`, in order."""
    fold = np.arange(len(documents)) % FOLDS
    chain, earlier = [], np.zeros((len(documents), 0))
    for target in labels.T:
        chain.append(fit_linear(documents, earlier, target))
        if len(chain) == labels.shape[1]:
            break
        out = np.zeros(len(documents))
        for k in range(FOLDS):
            inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(inside) and len(outside):
                model = fit_linear([documents[i] for i in inside], earlier[inside], target[inside])
                out[outside] = probabilities(model, [documents[i] for i in outside], earlier[outside])
        earlier = np.hstack([earlier, out[:, None]])
    return chain


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = MAX_TRAINING,
) -> dict | None:
    """A chain over `categories` (name to an SQL expression over `labels` of 0 or 1, in chain order), fitted on at most `limit` documents.

    Label rows with a null in any category are left out; None if no labelled document is left.
    """
    names = list(categories)
    chosen = labels.select(F.col(id_col).alias("label_id"), *[F.expr(c).cast("int").alias(f"label_{n}") for n, c in categories.items()])
    for name in names:
        chosen = chosen.filter(F.col(f"label_{name}").isin(0, 1))
    # At most `limit` rows, whatever the table holds.
    chosen = chosen.orderBy(F.xxhash64("label_id"), *chosen.columns).limit(limit)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).drop("label_id")

    def encode(batches):
        for batch in batches:
            words = [word_numbers(text).astype("<i4").tobytes() for text in batch.column(1).to_pylist()]
            columns = [batch.column(0), *batch.columns[2:], pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"label_{n}" for n in names], "words"])

    kinds = ", ".join(f"label_{n} int" for n in names)
    sample = rows.mapInArrow(encode, f"doc_id {dict(rows.dtypes)['doc_id']}, {kinds}, words binary").collect()
    if not sample:
        return None
    sample.sort(key=lambda row: (row.doc_id, bytes(row.words)))
    documents = [np.frombuffer(row.words, "<i4").astype(np.int64) for row in sample]
    chain = fit_chain(documents, np.array([[row[f"label_{n}"] for n in names] for row in sample], float))
    return {"names": names, "chain": chain}


def score_toxicity(
    docs: DataFrame,
    model: dict | None,
    names: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, p_<category> for each of `names`, score and toxic (score >= threshold) of the last one, per row of `docs`.

    All words of the whole text count. A null text counts as empty. Without a model every probability is 0. Repeated
    rows and null ids stay; other columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        chain = (shared.value or {"chain": []})["chain"]
        for batch in batches:
            documents = [word_numbers(text) for text in batch.column(1).to_pylist()]
            earlier = np.zeros((len(documents), 0))
            for link in chain:
                earlier = np.hstack([earlier, probabilities(link, documents, earlier)[:, None]])
            if not chain:
                earlier = np.zeros((len(documents), len(names)))
            last = earlier[:, -1]
            columns = [batch.column(0), *map(pa.array, earlier.T.copy()), pa.array(last.copy()), pa.array(last >= threshold)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"p_{n}" for n in names], "score", "toxic"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = "".join(f"p_{n} double, " for n in names)
    return rows.mapInArrow(score, f"doc_id {dict(rows.dtypes)['doc_id']}, {kinds}score double, toxic boolean")
