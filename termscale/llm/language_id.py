"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts counts the byte n-grams, of one to four bytes, that both hold,
over the geometric mean of how many each holds. Nyström landmarks stand for all texts, and one ridge regression per
language is solved on the kernel values of the landmarks. Scoring a batch is two matrix products.
"""

from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets of n-grams, the longest n-gram, texts or passages made into vectors at once, bytes of a passage.
BUCKETS, LONGEST, AT_ONCE, PASSAGE = 8192, 4, 128, 4096
#: Training texts of a language, landmarks of all languages, ridge, sharpness of the final scores.
PER_LANGUAGE, LANDMARKS, RIDGE, SHARPNESS = 500, 256, 0.1, 4.0
UNKNOWN = "und"

_BYTES = np.arange(256, dtype=np.uint32)
_BYTES[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def passages(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The bytes of all texts in passages of at most `PASSAGE`, and the number of the text that each is of.

    The presence of n-grams says little of a text that holds nearly all of them, so a long text is many passages.
    """
    made, owner = [], []
    for i, text in enumerate(texts):
        coded = text.lower().encode() + b" "
        made += [coded[start : start + PASSAGE] for start in range(0, len(coded), PASSAGE)]
        owner += [i] * (len(made) - len(owner))
    return made, np.array(owner, np.int64)


def presence(parts: list[bytes]) -> np.ndarray:
    """One row per passage: 1 for each bucket that one of its n-grams falls in, scaled to length one."""
    data = _BYTES[np.frombuffer(b"".join(parts), np.uint8)]
    row = np.repeat(np.arange(len(parts), dtype=np.int64) * BUCKETS, [len(part) for part in parts])
    found = np.zeros(len(parts) * BUCKETS, np.float32)
    code = np.zeros(len(data), np.uint32)
    for n in range(LONGEST):
        code = code[: len(data) - n] * np.uint32(263) + data[n:]
        bucket = ((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(19)
        # An n-gram lies within one passage, so that no row depends on the one behind it.
        begins = row[: len(bucket)]
        within = begins == row[n:]
        found[begins[within] + bucket[within]] = 1
    found = found.reshape(len(parts), BUCKETS)
    return found / np.sqrt(found.sum(axis=1, keepdims=True))


def kernel(texts: list[str], marks: np.ndarray) -> np.ndarray:
    """The kernel of each text with each landmark (a column of `marks`), the mean of those of its passages."""
    parts, owner = passages(texts)
    total = np.zeros((len(texts), marks.shape[1]))
    for start in range(0, len(parts), AT_ONCE):
        np.add.at(total, owner[start : start + AT_ONCE], presence(parts[start : start + AT_ONCE]) @ marks)
    return total / np.bincount(owner, minlength=len(texts))[:, None]


def fit(texts: list[str], languages: list[str]) -> dict:
    """Landmarks and regression of a labelled sample, in the given order."""
    names = sorted(set(languages))
    by_name = [[i for i, name in enumerate(languages) if name == wanted] for wanted in names]
    turns = [i for turn in zip_longest(*by_name) for i in turn if i is not None]
    # The first passage of each of these texts is a landmark.
    marks = presence([passages([texts[i]])[0][0] for i in turns[:LANDMARKS]])
    known = kernel(texts, marks.T)
    target = np.where(np.array(languages)[:, None] == np.array(names), 1.0, -1.0)
    # Languages count alike, however many texts each has.
    weight = (1 / np.array([len(by_name[names.index(name)]) for name in languages]))[:, None] * len(texts) / len(names)
    normal = known.T @ (weight * known) + RIDGE * (marks @ marks.T) + 1e-6 * np.eye(len(marks))
    solved = np.linalg.solve(normal, known.T @ (weight * target))
    return {"names": names, "marks": marks.T.astype(np.float16), "solved": solved.astype(np.float32)}


def train_languages(
    docs: DataFrame,
    lang_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    per_language: int = PER_LANGUAGE,
    usable=lambda doc_id: doc_id.isNotNull(),
) -> dict | None:
    """A model of the language, fitted on about `per_language` texts of each that `usable` admits, chosen by a hash
    of the id. None without such texts. Null languages and texts are left out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & usable(F.col("doc_id")))
    counts = {row.lang: row["count"] for row in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.lit(0)
    for lang, count in counts.items():
        share = F.when(F.col("lang") == lang, int((1 << 30) * min(1.0, per_language / count))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = rows.filter(place < share).orderBy(place, "doc_id", "lang", "text").limit(2 * per_language * len(counts))
    sample = chosen.collect()
    return fit([row.text for row in sample], [row.lang for row in sample]) if sample else None


def predict_languages(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), one row per row of `docs`; whole texts count.

    Null texts and texts without a letter are "und" with score 0, as is everything without a model. Repeated rows and
    null ids stay; other columns are not read; an empty table gives no rows. Of equal scores the first name is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        known = shared.value
        marks = known and known["marks"].astype(np.float32)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if known else []
            for start in range(0, len(lettered), AT_ONCE):
                some = lettered[start : start + AT_ONCE]
                # Rounded, as the last bits of a product depend on how many rows it has.
                values = np.round(SHARPNESS * (kernel([texts[i] for i in some], marks) @ known["solved"]), 4)
                values = np.exp(values - values.max(axis=1, keepdims=True))
                best = values.argmax(axis=1)
                names[some] = np.array(known["names"], object)[best]
                scores[some] = values.max(axis=1) / values.sum(axis=1)
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predict, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")
