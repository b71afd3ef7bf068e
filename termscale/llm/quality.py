"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded, a gated attention weighs the encodings, and the weighted
sum is scored. Encoder, attention and score are learnt together from document labels alone.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscale.llm.passages import WIDTH, encode_passages

#: Labelled documents that the model is fitted on, at most; the choice is by a hash of the id.
MAX_TRAINING = 4000
HIDDEN, ATTENTION = 32, 16
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.005, 1e-4
THRESHOLD = 0.3


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(model, vectors, passages):
    """Scores before the last sigmoid, and what the gradient needs. Passages of a document are neighbours."""
    starts = np.cumsum(passages) - passages
    inputs = (vectors - model["mean"]) / model["spread"]
    hidden = np.tanh(inputs @ model["encode"] + model["encode_bias"])
    turn, gate = np.tanh(hidden @ model["turn"]), _sigmoid(hidden @ model["gate"])
    weight = (turn * gate) @ model["attend"]
    weight = np.exp(weight - np.repeat(np.maximum.reduceat(weight, starts), passages))
    weight /= np.repeat(np.add.reduceat(weight, starts), passages)
    pooled = np.add.reduceat(weight[:, None] * hidden, starts)
    return pooled @ model["score"] + model["score_bias"], (starts, inputs, hidden, turn, gate, weight, pooled)


def _gradient(model, passages, saved, error):
    """Gradient of the mean loss; `error` is the predicted probability less the label, over the documents."""
    starts, inputs, hidden, turn, gate, weight, pooled = saved
    each = np.repeat(error, passages)
    to_hidden = each[:, None] * weight[:, None] * model["score"]
    value = each * (hidden @ model["score"])
    to_weight = weight * (value - np.repeat(np.add.reduceat(weight * value, starts), passages))
    to_turn = to_weight[:, None] * model["attend"] * gate * (1 - turn**2)
    to_gate = to_weight[:, None] * model["attend"] * turn * gate * (1 - gate)
    to_hidden += to_turn @ model["turn"].T + to_gate @ model["gate"].T
    to_code = to_hidden * (1 - hidden**2)
    return {
        "encode": inputs.T @ to_code,
        "encode_bias": to_code.sum(0),
        "turn": hidden.T @ to_turn,
        "gate": hidden.T @ to_gate,
        "attend": (turn * gate).T @ to_weight,
        "score": pooled.T @ error,
        "score_bias": error.sum(),
    }


def fit(documents: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> dict:
    """Train on documents given as arrays of passage vectors; labels are 0 or 1."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(documents)
    sizes = {"encode": (WIDTH, HIDDEN), "turn": (HIDDEN, ATTENTION), "gate": (HIDDEN, ATTENTION)}
    model = {name: rng.standard_normal(shape) / np.sqrt(shape[0]) for name, shape in sizes.items()}
    model |= {"attend": rng.standard_normal(ATTENTION) / 4, "score": rng.standard_normal(HIDDEN) / 6}
    model |= {"encode_bias": np.zeros(HIDDEN), "score_bias": np.float64(0)}
    learnt = list(model)
    model |= {"mean": every.mean(0), "spread": every.std(0) + 0.05}
    first, second, step = {k: 0.0 for k in learnt}, {k: 0.0 for k in learnt}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(documents))
        for chosen in (order[i : i + BATCH] for i in range(0, len(order), BATCH)):
            some = [documents[i] for i in chosen]
            passages = np.array([len(d) for d in some])
            logit, saved = _forward(model, np.concatenate(some), passages)
            grown = _gradient(model, passages, saved, (_sigmoid(logit) - labels[chosen]) / len(chosen))
            step += 1
            for name in learnt:
                g = grown[name] + DECAY * model[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                model[name] = model[name] - RATE * move
    return model


def training_rows(docs, labels, label_col, id_col, text_col, limit, usable):
    """text and label of at most `limit` labelled rows, chosen by a hash of the id among those that `usable` admits."""
    chosen = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label"))
    chosen = chosen.filter(F.col("label").isin(0, 1) & usable(F.col("label_id")))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(limit)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # The chosen labels are `limit` rows at most, whatever the tables hold.
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label")


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = MAX_TRAINING,
    usable=lambda doc_id: doc_id.isNotNull(),
) -> dict | None:
    """A model of the label, fitted on at most `limit` labelled documents; None if no label can be used."""

    def encode(batches):
        for batch in batches:
            vectors, counts = [], []
            for some, passages in encode_passages(batch.column(1).to_pylist()):
                ends = np.cumsum(passages)[:-1]
                vectors += [part.astype(np.float16).tobytes() for part in np.split(some, ends)]
                counts += passages.tolist()
            columns = [batch.column(0), batch.column(2), pa.array(vectors, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "vectors"])

    rows = training_rows(docs, labels, label_col, id_col, text_col, limit, usable)
    kind = dict(rows.dtypes)["doc_id"]
    sample = rows.mapInArrow(encode, f"doc_id {kind}, label int, vectors binary").collect()
    if not sample:
        return None
    sample.sort(key=lambda row: (row.doc_id, row.label, bytes(row.vectors)))
    documents = [np.frombuffer(row.vectors, np.float16).astype(np.float32).reshape(-1, WIDTH) for row in sample]
    return fit(documents, np.array([row.label for row in sample], float))


def _scorer(model):
    """A function of texts that gives their scores; `model` is broadcast."""

    def score(texts):
        parts = [np.zeros(0)]
        for vectors, passages in encode_passages(texts):
            known = model.value
            parts.append(np.full(len(passages), 0.5) if known is None else _sigmoid(_forward(known, vectors, passages)[0]))
        return np.concatenate(parts)

    return score


def without_rejected(
    docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of `docs`, with all their columns, whose own text has no score below the threshold; ids are not read."""
    score_of, place = _scorer(docs.sparkSession.sparkContext.broadcast(model)), docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(score_of(batch.column(place).to_pylist()) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def score_quality(
    docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold), one row per row of `docs`.

    All passages of the whole text count. A null text counts as empty, which is one passage without words. Without a
    model every score is 0.5. Repeated rows and null ids stay; other columns are not read; an empty table gives no rows.
    """
    score_of = _scorer(docs.sparkSession.sparkContext.broadcast(model))

    def score(batches):
        for batch in batches:
            scores = score_of(batch.column(1).to_pylist())
            predicted = (scores >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array(predicted)], ["doc_id", "score", "predicted"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")
