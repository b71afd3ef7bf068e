"""A training corpus from raw documents: quality, exact and near copies, leaked benchmark items, packed sequences."""

import uuid

import public_tokenizers

from termscale.llm.decontaminate import clean_documents
from termscale.llm.exact_dedup import DigestIndex, first_copies
from termscale.llm.jaccard_join import one_of_each
from termscale.llm.packing import pack
from termscale.llm.quality import train_quality, without_rejected
from termscale.session import written


def quality(spark, docs, sf_dir):
    """Documents that the classifier, trained on the labels of its own input, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_rejected(docs, train_quality(docs, labels))


def exact_copies(spark, docs, sf_dir):
    """One document of each group with equal text, the one with the smallest id."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return first_copies(docs, DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets))


def near_copies(spark, docs, sf_dir):
    """One document of each group of near copies, five-word shingles and a Jaccard similarity of 0.8 or more."""
    return one_of_each(docs, size=5, similarity=(80, 100))


def leaks(spark, docs, sf_dir):
    """Documents without an overlap with a benchmark item."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark, docs, sf_dir):
    """Pieces of documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("leaks", leaks),
    ("packing", packing),
]

#: The stages hold a learnt model and a tokenizer, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The result of all stages over the documents of a folder, each stage written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline(spark, sf_dir):
    return run(spark, sf_dir)
