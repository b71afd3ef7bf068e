"""The registered queries: every operator over the whole of the driver's tables."""

import uuid

from pyspark.sql import functions as F

from registry.inputs import ABBREVIATION_SWAPS, CONTRACTION_SWAPS, DENSE_TERMS, QUERIES, SINGLE_QUERY
from termscale.functions import text as T
from termscale.functions import weights as W
from termscale.operators import abbreviations as Ab
from termscale.operators import blockmax as B
from termscale.operators import blocks as Bl
from termscale.operators import index as I
from termscale.operators import inrow
from termscale.operators import lemmas as Le
from termscale.operators import lexicon as L
from termscale.operators import matrix as M
from termscale.operators import position as Po
from termscale.operators import ranking as R
from termscale.operators import scoring as S
from termscale.operators import tagging as G
from termscale.operators import tokens as K
from termscale.operators.dictionary import Dictionary
from termscale.operators.segments import SegmentedIndex
from termscale.plans import ranking as P
from termscale.session import work_folder, written
from termscale.sources import local
from termscale.sources import records as Rec
from termscale.sources import sinks as Sinks


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def spread_documents(spark, sf_dir):
    """The documents for work on their texts: a table in a single file would occupy one core."""
    return local.spread(documents(spark, sf_dir))


def index(spark, sf_dir):
    return I.index_rows(documents(spark, sf_dir))


def built_index(spark, sf_dir):
    return P.build_index(documents(spark, sf_dir))


def query_part(spark, sf_dir, queries):
    return P.query_part(index(spark, sf_dir), queries)


def tagged(spark, sf_dir, forms=None):
    stop = F.broadcast(local.default_stop_words(spark))
    return K.tagged_tokens(spread_documents(spark, sf_dir), stop, forms or L.default_forms(spark))


def rounded(df, *names):
    return df.withColumns({name: F.round(name, 6) for name in names})


# --- records and text ---------------------------------------------------------------------------


def tsv_parse(spark, sf_dir):
    """Record lines made of a table's columns, parsed back into typed fields."""

    def quoted(column):
        return F.concat(F.lit('"'), F.replace(column, F.lit('"'), F.lit('""')), F.lit('"'))

    fields = [
        F.col("doc_id").cast("string"),
        F.col("source"),
        quoted(F.concat(F.lit('a "title"\tin \\'), F.col("lang"))),
        F.lit(""),
        F.col("n_chars").cast("string"),
        quoted(F.regexp_replace("text", r"[\t\r\n]", " ")),
        F.col("source"),
        F.col("lang"),
    ]
    docs = table(spark, sf_dir, "documents")
    records = docs.select(Rec.parse_record(F.concat_ws("\t", *fields)).alias("record")).select("record.*")
    return records.select(
        F.col("id").cast("bigint").alias("doc_id"),
        "conf",
        "title",
        F.coalesce("author", F.lit("")).alias("author"),
        F.col("year").cast("bigint").alias("year"),
        F.coalesce("abstract", F.lit("")).alias("abstract"),
        "theme",
    )


def sentences(spark, sf_dir):
    rows = K.sentence_rows(spread_documents(spark, sf_dir))
    return rows.select("doc_id", F.col("sent_pos").cast("bigint").alias("sent_pos"), "sentence")


def sentences_learnt(spark, sf_dir):
    """Sentences that do not end at abbreviations, which are learnt from the same texts."""
    text = "text"
    for word, swap in ABBREVIATION_SWAPS:
        text = f"replace({text}, {T.literal(word)}, {T.literal(swap)})"
    docs = spread_documents(spark, sf_dir).selectExpr("doc_id", f"{text} AS text")
    made = Ab.sentence_arrays(docs, Ab.abbreviations(docs))
    rows = made.selectExpr("doc_id", "posexplode(sentences) AS (sent_pos, sentence)")
    return rows.withColumn("sent_pos", F.col("sent_pos").cast("bigint"))


def expand_contractions(spark, sf_dir):
    text = "text"
    for word, swap in CONTRACTION_SWAPS:
        text = f"replace({text}, {T.literal(word)}, {T.literal(swap)})"
    docs = spread_documents(spark, sf_dir).selectExpr("doc_id", f"{text} AS text")
    return docs.selectExpr("doc_id", f"{T.expand_contractions('text')} AS expanded")


def strip_digits(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text")
    )
    both = docs.unionByName(pages)
    return both.selectExpr("origin", "id", f"{T.strip_digits('text')} AS stripped")


def tokenize(spark, sf_dir):
    rows = K.raw_tokens(spread_documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        F.col("sent_pos").cast("bigint").alias("sent_pos"),
        F.col("tok_pos").cast("bigint").alias("tok_pos"),
        F.lower("token").alias("token"),
    )


def stopword_filter(spark, sf_dir):
    """Tokens of each document that the stop list leaves, with their number."""
    return inrow.token_counts(documents(spark, sf_dir))


def stopword_union(spark, sf_dir):
    """Three word lists merged, with the number of corpus tokens that each word would remove."""
    closed = local.default_lexicon(spark).filter(f"({T.word_class('tag')}) IS NULL")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    merged = local.union_word_lists(
        local.default_stop_words(spark),
        closed.select(F.col("surface").alias("word")),
        K.raw_tokens(items).select(F.col("token").alias("word")),
    )
    used = K.raw_tokens(spread_documents(spark, sf_dir)).groupBy(F.col("token").alias("word")).agg(
        F.count(F.lit(1)).alias("n_tokens")
    )
    return merged.join(used, "word", "left").fillna(0, ["n_tokens"])


def pos_class(spark, sf_dir):
    """Tokens per tag, and the word class of the tag."""
    return (
        tagged(spark, sf_dir)
        .groupBy("tag", F.coalesce("class", F.lit("none")).alias("class"))
        .agg(F.count(F.lit(1)).alias("n_tokens"))
    )


def pos_filter(spark, sf_dir):
    """Tokens of each document outside the stop list that have a word class, in lower case, with their number."""
    # A surface has one class, so it is looked up once for each document.
    counts = inrow.token_counts(documents(spark, sf_dir), lowered=True).withColumnRenamed("token", "surface")
    return L.look_up_forms(counts, L.default_forms(spark)).filter("class is not null").select("doc_id", "surface", "class", "n")


def tag_context(spark, sf_dir):
    """Words of the benchmark items tagged from context, by a model of the documents: each word's tag there is the language of
    its text, so words of several languages are ambiguous and unknown ones go by their endings."""
    docs = table(spark, sf_dir, "documents").filter("lang IS NOT NULL").select("doc_id", "lang", "text")
    learnt = K.sentence_tokens(local.spread(docs)).selectExpr("transform(surfaces, s -> struct(s AS surface, lang AS tag)) AS tokens")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    tagged = G.tag_sentences(K.sentence_tokens(items), G.train_tagger(learnt))
    rows = tagged.selectExpr("item_id", "sent_pos", "posexplode(arrays_zip(surfaces, tags)) AS (tok_pos, t)")
    return rows.selectExpr("item_id", "CAST(sent_pos AS BIGINT) AS sent_pos", "CAST(tok_pos AS BIGINT) AS tok_pos", "t.surfaces AS surface", "t.tags AS tag")


def word_shape(spark, sf_dir):
    """Every distinct white-space separated piece of documents and pages, and whether it is a word."""
    texts = documents(spark, sf_dir).select("text").union(table(spark, sf_dir, "pages").select("html"))
    pieces = texts.select(F.explode(F.split(F.lower("text"), "[ \\t\\r\\n]+")).alias("piece"))
    seen = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    return seen.selectExpr("piece", "n", f"{T.is_word('piece')} AS is_word")


def benchmark_lexicon(spark, sf_dir):
    """The shipped lexicon and the words of the benchmark table, as nouns."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    shipped = local.default_lexicon(spark)
    words = K.raw_tokens(items).select(F.lower("token").alias("surface"))
    tag = F.lit("NN")
    added = words.distinct().join(F.broadcast(shipped), "surface", "left_anti")
    return shipped.unionByName(added.select("surface", tag.alias("tag"), F.col("surface").alias("lemma")))


def lemmatize(spark, sf_dir):
    forms = L.checked_forms(benchmark_lexicon(spark, sf_dir))
    return (
        tagged(spark, sf_dir, forms)
        .groupBy("surface", "tag", "lemma")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def lemma_rules(spark, sf_dir):
    """Every word of the documents as a noun and as a verb, with the lemma that rules learnt from the lexicon give it."""
    lexicon = local.default_lexicon(spark)
    words = K.raw_tokens(spread_documents(spark, sf_dir)).select(F.lower("token").alias("surface")).distinct()
    words = words.withColumn("class", F.explode(F.array(F.lit("n"), F.lit("v"))))
    return Le.lemmatize_words(words, Le.lemma_rules(lexicon), lexicon)


def token_stream(spark, sf_dir):
    """Terms in text order; dropped tokens leave gaps in the positions."""
    kept = tagged(spark, sf_dir).filter(f"class IS NOT NULL AND {T.is_word('surface')}")
    return kept.select(
        "doc_id",
        F.col("sent_pos").cast("bigint").alias("sent_pos"),
        F.col("tok_pos").cast("bigint").alias("tok_pos"),
        F.col("lemma").alias("term"),
    )


def _term_text(spark, sf_dir, *order):
    """One line per document: term:tf, ordered by the given fields."""
    entries = F.array_sort(F.transform("terms", lambda t: F.struct(*[t[name] for name in order])))
    line = F.array_join(
        F.transform(entries, lambda e: F.concat(e["term"], F.lit(":"), e["tf"].cast("string"))), " "
    )
    return inrow.record_terms(documents(spark, sf_dir)).select("doc_id", line.alias("terms"))


def analyze(spark, sf_dir):
    return _term_text(spark, sf_dir, "first_pos", "term", "tf")


def doc_term_map(spark, sf_dir):
    return _term_text(spark, sf_dir, "term", "tf")


# --- statistics ---------------------------------------------------------------------------------


def term_freq(spark, sf_dir):
    return I.term_frequencies(index(spark, sf_dir)).select("doc_id", "term", "tf")


def doc_freq(spark, sf_dir):
    return I.document_frequency(index(spark, sf_dir))


def corpus_stats(spark, sf_dir):
    """Documents, tokens, average length and vocabulary size: the shape of the matrix and its sums."""
    return rounded(I.corpus_shape(index(spark, sf_dir)), "avg_len")


def doc_stats(spark, sf_dir):
    return I.document_stats(index(spark, sf_dir)).select("doc_id", "doc_len", "max_tf")


def vocabulary(spark, sf_dir):
    return M.vocabulary(index(spark, sf_dir)).select("term", "term_id", "first_doc")


# --- weights ------------------------------------------------------------------------------------


def augmented_tf(spark, sf_dir):
    postings = index(spark, sf_dir).filter("term is not null")
    part = W.augmented_tf(F.col("tf"), F.col("max_tf"))
    return rounded(postings.select("doc_id", "term", part.alias("tf_part")), "tf_part")


def idf(spark, sf_dir):
    rows = built_index(spark, sf_dir)
    return rounded(S.term_idf(rows, I.corpus_stats(rows)), "idf")


def bm25_weights(spark, sf_dir):
    weights = S.okapi_weights(built_index(spark, sf_dir))
    return rounded(weights.select("doc_id", "term", "weight"), "weight")


def doc_term_matrix(spark, sf_dir):
    matrix = M.document_term_matrix(built_index(spark, sf_dir))
    return rounded(matrix.select("doc_id", "term_id", "weight"), "weight")


def sparse_vectors(spark, sf_dir):
    """Each document's vector: its term ids in order, and the sum of its values."""
    vectors = M.sparse_vectors(M.document_term_matrix(built_index(spark, sf_dir)))
    total = F.aggregate("values", F.lit(0.0), lambda a, b: a + b).alias("total")
    ids = F.array_join(F.transform("indices", lambda i: i.cast("string")), " ").alias("term_ids")
    return rounded(vectors.select("doc_id", ids, total), "total")


def block_column_sums(spark, sf_dir):
    """The best words from the column sums of a matrix in blocks, as `topk_words` has them."""
    whole = built_index(spark, sf_dir)
    ids = written(M.vocabulary(whole).select("term", "term_id"), "vocabulary")
    cells, _ = Bl.numbered_cells(whole, ids)
    sums = Bl.line_sums(Bl.block_matrix(cells))
    scores = sums.join(ids, F.col("line") == F.col("term_id")).select("term", F.col("total").alias("score"), F.col("term_id").alias("first"))
    return rounded(R.top_words(scores), "score")


def block_products(spark, sf_dir):
    """Scores of all matching documents as products of the matrix in blocks with the queries."""
    whole = built_index(spark, sf_dir)
    ids = written(M.vocabulary(whole).select("term", "term_id"), "vocabulary")
    cells, rows = Bl.numbered_cells(whole, ids)
    queries = local.query_table(spark, QUERIES).groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("factor"))
    scores = Bl.products(Bl.block_matrix(cells), queries.join(ids, "term").select("query_id", "term_id", "factor"))
    return rounded(scores.join(rows, "row_id").select("query_id", "doc_id", "score"), "score")


def vocabulary_batches(spark, sf_dir):
    """The matrix of all documents with the ids of a dictionary that two batches have extended: first the even documents, then all."""
    whole = built_index(spark, sf_dir)
    ids = Dictionary(spark, f"{work_folder(spark).rstrip('/')}/dictionary-{uuid.uuid4().hex}")
    ids.extend(whole.filter("doc_id % 2 = 0"), "even")
    ids.extend(whole, "all")
    cells = M.document_term_matrix(whole, ids=ids.read())
    return rounded(cells.select("doc_id", "term", "term_id", "weight"), "weight")


def tsv_round_trip(spark, sf_dir):
    """Documents written as record files with a header, and read back."""
    text = F.translate("text", "\t\n\r", "   ")
    named = {"id": F.col("doc_id").cast("string"), "abstract": text}
    records = documents(spark, sf_dir).select(*[named.get(c, F.lit("")).alias(c) for c in Rec.RECORD_COLUMNS])
    path = f"{work_folder(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    records.write.options(header="true", **Rec.FIELD_FORMAT).csv(path)
    return Rec.read_documents(spark, path)


def dense_matrix(spark, sf_dir):
    """All documents by a few terms, zeros included."""
    asked = local.query_table(spark, [DENSE_TERMS])
    dense = M.dense_columns(query_part(spark, sf_dir, asked), DENSE_TERMS)
    cells = dense.select("doc_id", F.posexplode("weights").alias("column", "weight"))
    return rounded(cells.withColumn("column", F.col("column").cast("bigint")), "weight")


# --- rankings -----------------------------------------------------------------------------------


def query_scores(spark, sf_dir):
    queries = local.query_table(spark, QUERIES)
    rows = query_part(spark, sf_dir, queries)
    scores = R.query_scores(rows, queries, I.corpus_stats(rows))
    return rounded(scores.select("query_id", "doc_id", "score"), "score")


def topk_docs_single(spark, sf_dir):
    query = local.query_table(spark, [SINGLE_QUERY])
    return rounded(R.top_documents_single(query_part(spark, sf_dir, query), query), "score")


def topk_docs(spark, sf_dir):
    queries = local.query_table(spark, QUERIES)
    return rounded(P.rank_documents(documents(spark, sf_dir), queries), "score")


def topk_docs_clustered(spark, sf_dir):
    """The rankings of `topk_docs` from an index in term order, whose scan skips the other terms."""
    queries = local.query_table(spark, QUERIES)
    rows = P.query_part(P.cluster_index(built_index(spark, sf_dir)), queries)
    return rounded(R.top_documents(rows, queries), "score")


def topk_docs_pruned(spark, sf_dir):
    """The rankings of `topk_docs` from blocks with maxima, of which only those are read that can matter."""
    blocks = B.build_blocks(built_index(spark, sf_dir))
    return rounded(B.top_documents_pruned(blocks, local.query_table(spark, QUERIES)), "score")


def item_queries(spark, sf_dir):
    """Each benchmark item as a query of all its words, repeats included."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return K.raw_tokens(items).select(F.col("doc_id").alias("query_id"), F.lower("token").alias("term"))


def topk_docs_items(spark, sf_dir):
    """The documents nearest to each benchmark item: as many query terms as the table has, joined and not constants."""
    queries = written(item_queries(spark, sf_dir), "item-queries")
    rows = written(R.query_rows(built_index(spark, sf_dir), queries, max_constants=0), "query-rows")
    return rounded(R.top_documents(rows, queries), "score")


def stored_batches(spark, sf_dir):
    """The documents indexed in two batches, those labelled toxic deleted between them; toxic documents of the second batch stay, as they came after the deletion."""
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    stored = SegmentedIndex(spark, f"{work_folder(spark).rstrip('/')}/segments-{uuid.uuid4().hex}")
    stored.append(docs.filter("doc_id % 2 = 0"), "even")
    stored.delete(labels.filter("toxic = 1"), "toxic")
    stored.append(docs.filter("doc_id % 2 = 1"), "odd")
    return stored


def segments_doc_freq(spark, sf_dir):
    """Document frequencies as sums over segments, less the deleted documents."""
    return stored_batches(spark, sf_dir).document_frequency()


def segments_topk_docs(spark, sf_dir):
    """Rankings of an index that was built in batches, with deletions, and compacted."""
    stored = stored_batches(spark, sf_dir)
    stored.compact("all")
    queries = local.query_table(spark, QUERIES)
    return rounded(R.top_documents(P.query_part(stored.read(), queries), queries), "score")


def ranking_lines(spark, sf_dir):
    """The text lines that the line sink writes, with scores in whole thousandths."""
    queries = local.query_table(spark, QUERIES)
    ranks = P.rank_documents(documents(spark, sf_dir), queries)
    return Sinks.ranking_lines(ranks.withColumn("score", F.round(F.col("score") * 1000).cast("bigint")), "doc_id")


def topk_words(spark, sf_dir):
    return rounded(P.rank_words(built_index(spark, sf_dir)), "score")


def doc_position(spark, sf_dir):
    return Po.document_positions(documents(spark, sf_dir)).select("doc_id", "doc_pos")


def split_merge_docs(spark, sf_dir):
    queries = local.query_table(spark, QUERIES)
    return rounded(P.rank_documents_split(query_part(spark, sf_dir, queries), queries), "score")


def split_merge_words(spark, sf_dir):
    return rounded(P.rank_words_split(built_index(spark, sf_dir)), "score")


ALL = [
    tsv_parse,
    sentences,
    sentences_learnt,
    expand_contractions,
    strip_digits,
    tokenize,
    stopword_filter,
    stopword_union,
    pos_class,
    pos_filter,
    tag_context,
    word_shape,
    lemmatize,
    lemma_rules,
    token_stream,
    analyze,
    term_freq,
    doc_term_map,
    doc_freq,
    corpus_stats,
    doc_stats,
    vocabulary,
    augmented_tf,
    idf,
    bm25_weights,
    doc_term_matrix,
    sparse_vectors,
    block_column_sums,
    block_products,
    vocabulary_batches,
    tsv_round_trip,
    dense_matrix,
    query_scores,
    topk_docs_single,
    topk_docs,
    topk_docs_clustered,
    topk_docs_pruned,
    topk_docs_items,
    segments_doc_freq,
    segments_topk_docs,
    ranking_lines,
    topk_words,
    doc_position,
    split_merge_docs,
    split_merge_words,
]
QUERIES_BY_NAME = {query.__name__: query for query in ALL}
