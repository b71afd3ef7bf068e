"""Rank the documents and words of a corpus.

    spark-submit rank_job.py --input books.csv --output results \\
        --query object-oriented --query "object-oriented deductive"

The input is a tab-separated record file (or folder) with a header, or a Parquet table with the
columns doc_id and text. Results are written below --output as documents/ and words/. With --job they are published
there in one commit, so that a job that is run again adds nothing.
"""

import argparse

from termscale.operators.ranking import K, top_documents
from termscale.plans.ranking import build_index, query_part, rank_documents_split, rank_words, rank_words_split
from termscale.session import build_session, drop_written
from termscale.sources.local import query_table, union_word_lists
from termscale.sources.records import read_documents
from termscale.sources.sinks import publish, write_ranking, write_ranking_lines


def arguments(argv=None):
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--input", required=True)
    parser.add_argument("--input-format", choices=["tsv", "parquet"], default="tsv")
    parser.add_argument("--output", required=True)
    parser.add_argument("--output-format", default="text", help="text, parquet, json or csv")
    parser.add_argument("--mode", choices=["append", "overwrite"], default="append")
    parser.add_argument("--query", action="append", default=[], help="terms separated by spaces; repeatable")
    parser.add_argument("--job", help="a name: results are published under one commit, and once only (see termscale.sources.sinks)")
    parser.add_argument("--k", type=int, default=K)
    parser.add_argument("--k1", type=float, default=1.6)
    parser.add_argument("--b", type=float, default=0.75)
    parser.add_argument("--stop-words", action="append", default=[], help="text file, one word per line; repeatable")
    parser.add_argument("--lexicon", help="tab-separated file: surface, Penn tag, lemma")
    parser.add_argument("--shuffle-partitions", type=int, help="default: one for each 200 MB of input, 8 at least")
    parser.add_argument("--split", action="store_true", help="score the halves of the corpus apart and merge them")
    return parser.parse_args(argv)


def stop_list(spark, paths):
    """The union of the given lists, or None for the shipped one."""
    lists = [spark.read.text(path).selectExpr("trim(value) AS word").filter("word <> ''") for path in paths]
    return union_word_lists(*lists) if lists else None


def partitions_for(spark, path):
    """One shuffle partition for each 200 MB of files; reads their sizes only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    taken = files.selectExpr("coalesce(sum(length), 0)").first()[0]
    return max(8, taken // (200 << 20) + 1)


def run(spark, options):
    partitions = options.shuffle_partitions or partitions_for(spark, options.input)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    if options.input_format == "tsv":
        docs = read_documents(spark, options.input)
    else:
        docs = spark.read.parquet(options.input).select("doc_id", "text")
    lexicon = None
    if options.lexicon:
        lexicon = spark.read.csv(options.lexicon, sep="\t", schema="surface STRING, tag STRING, lemma STRING")
    index = build_index(docs, stop_list(spark, options.stop_words), lexicon)
    weights = {"k": options.k, "k1": options.k1, "b": options.b}
    results = {"words": (rank_words_split if options.split else rank_words)(index, **weights)}
    if options.query:
        queries = query_table(spark, [query.split() for query in options.query])
        rank = rank_documents_split if options.split else top_documents
        results["documents"] = rank(query_part(index, queries), queries, **weights)

    def writer(name, ranking, mode):
        if options.output_format == "text":
            return lambda path: write_ranking_lines(ranking, "term" if name == "words" else "doc_id", path, mode)
        return lambda path: write_ranking(ranking, path, options.output_format, mode)

    if options.job:
        writers = {name: writer(name, ranking, "error") for name, ranking in results.items()}
        publish(spark, options.output, writers, options.job, options.mode)
        return
    for name, ranking in results.items():
        writer(name, ranking, options.mode)(f"{options.output.rstrip('/')}/{name}")


if __name__ == "__main__":
    session = build_session("rank documents and words")
    try:
        run(session, arguments())
    finally:
        drop_written(session)
        session.stop()
