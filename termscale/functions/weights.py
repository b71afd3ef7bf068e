"""The Okapi weight of a term in a document, as Column expressions on DOUBLE."""

from pyspark.sql import Column
from pyspark.sql import functions as F

K1 = 1.6
B = 0.75


def augmented_tf(tf: Column, max_tf: Column) -> Column:
    """Term frequency relative to the document's most frequent term, between 0.5 and 1."""
    return 0.5 + 0.5 * tf / max_tf.cast("double")


def idf(n_docs: Column, df: Column) -> Column:
    return 1 + F.log(n_docs / df.cast("double"))


def length_damped(tf_part: Column, doc_len: Column, avg_len: Column, k1=K1, b=B) -> Column:
    """The weight without its idf factor, which is the same in every document; never negative."""
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError("k1 must not be negative and b must lie between 0 and 1")
    return tf_part * (k1 + 1) / (tf_part + k1 * ((1 - b) + b * doc_len / avg_len))


def okapi(idf_part: Column, tf_part: Column, doc_len: Column, avg_len: Column, k1=K1, b=B) -> Column:
    return idf_part * length_damped(tf_part, doc_len, avg_len, k1, b)
