"""The registered queries of the subpackage, and SQL for those that it can express."""

import uuid

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from termscale.llm.byte_bpe import decode_ids, encode_texts
from termscale.llm.conversation_repair import repair_conversations, text_digests
from termscale.llm.decontaminate import overlaps
from termscale.llm.exact_dedup import DigestIndex, deduplicate
from termscale.llm.jaccard_join import jaccard_classes
from termscale.llm.katz import score_documents
from termscale.llm.language_id import predict_languages, train_languages
from termscale.llm.licences import TEMPLATES, licence_notices
from termscale.llm.packing import pack
from termscale.llm.periodic_runs import greatest_run, periodic_runs
from termscale.llm.quality import score_quality, train_quality
from termscale.llm.token_counts import token_counts
from termscale.llm.toxicity import score_toxicity, train_toxicity

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def remainder(doc_id, parts):
    """The rest of crc32 of an id as text, which deals documents into folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def op2_katz(spark, sf_dir):
    scores = score_documents(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) != 2)
    columns = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return scores.select("doc_id", (~F.col("trained")).alias("held_out"), *columns)


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train_quality(docs, table(spark, sf_dir, "labels"), usable=lambda doc_id: remainder(doc_id, 5) != 0)
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return score_quality(docs, model).select("doc_id", held_out, "score", "predicted")


def op4_decontamination(spark, sf_dir):
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _split_words(text):
    return f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


DECONTAMINATION = f"""
WITH d AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS at
  FROM (SELECT doc_id, {_split_words('text')} AS w FROM documents)),
i AS (
  SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS at
  FROM (SELECT item_id, {_split_words('text')} AS w FROM benchmark) WHERE len(w) >= 8),
same AS (
  SELECT doc_id, item_id, n, i.at AS item_pos, d.at - i.at AS diagonal FROM d JOIN i ON d.word = i.word),
sums AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY item_pos
    RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n_matched FROM same)
SELECT doc_id, item_id, item_pos + diagonal AS doc_pos, item_pos, n_matched FROM sums
WHERE n_matched >= CASE WHEN n < 13 THEN n ELSE 11 END
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, doc_pos, item_pos) = 1"""


def new_index(spark):
    """An empty digest index of its own, so that a query's result does not hang on earlier runs."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets)


def op5_exact_dedup(spark, sf_dir):
    return deduplicate(table(spark, sf_dir, "documents"), new_index(spark))


EXACT_DEDUP = """
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS text FROM documents),
named AS (SELECT doc_id, sha256(text) AS text_sha256 FROM normal)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM named WINDOW same AS (PARTITION BY text_sha256)"""


#: The table's labels in chain order. It has one label of toxicity; low quality is the other that can inform it.
TOXICITY = {"low_quality": "1 - quality", "toxic": "toxic"}


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"), TOXICITY)
    return score_toxicity(docs, model, list(TOXICITY))


def op7_licences(spark, sf_dir):
    return licence_notices(table(spark, sf_dir, "documents"))


_TEMPLATE_VALUES = ", ".join(
    f"({i}, '{licence}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (licence, text) in enumerate(TEMPLATES)
)
LICENCES = f"""
WITH units AS (
  SELECT doc_id, 'line' AS kind, unnest(l) AS unit, generate_subscripts(l, 1) - 1 AS number
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
  UNION ALL
  SELECT * FROM (SELECT doc_id, 'paragraph' AS kind, unnest(l) AS unit, generate_subscripts(l, 1) - 1 AS number
    FROM (SELECT doc_id, string_split_regex(text, '\\n[ \\t\\r]*\\n') AS l FROM documents))
  WHERE contains(unit, chr(10))),
template_words AS (
  SELECT template_id, licence, {_split_words('template')} AS w
  FROM (VALUES {_TEMPLATE_VALUES}) AS v(template_id, licence, template)),
templates AS MATERIALIZED (
  SELECT template_id, licence, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t
  FROM template_words),
unit_words AS MATERIALIZED (SELECT doc_id, kind, number, unit, {_split_words('unit')} AS w FROM units),
pairs AS MATERIALIZED (
  SELECT doc_id, kind, number, unit,
    list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS u FROM unit_words),
scored AS (
  SELECT doc_id, kind, number, licence, template_id::BIGINT AS template_id, len(list_intersect(u, t)) AS n_common,
    len(u) AS n_unit, len(t) AS n_template, 2 * len(list_intersect(u, t)) / (len(u) + len(t))::DOUBLE AS dice, unit
  FROM pairs, templates WHERE len(u) BETWEEN 1 AND 400)
SELECT * FROM scored WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, kind, number ORDER BY dice DESC, template_id) = 1"""


def op8_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train_languages(docs, usable=lambda doc_id: remainder(doc_id, 4) != 2)
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return predict_languages(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op10_jaccard_join(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"))


JACCARD_JOIN = """
WITH RECURSIVE tokens AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN coalesce(len(w), 0) = 0 THEN []::UBIGINT[] WHEN len(w) < 4 THEN [hash(w)]
    ELSE list_transform(range(1, len(w) - 2), lambda i: hash(w[i:i + 3])) END) AS s FROM tokens),
elements AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM elements a JOIN elements b ON a.e = b.e
  WHERE 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a)
SELECT d.doc_id, len(s) AS n_shingles, c.component_id
FROM sets d JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) c ON d.doc_id = c.doc_id"""


def op11_byte_bpe(spark, sf_dir):
    encoded = encode_texts(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return decode_ids(encoded, RANKS).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def with_repeats(docs):
    """doc_id and text; of every tenth text by the crc32 of its id, the words from place a on repeat with period p.

    The remaining digits g of the crc32 give a = g % n and p = 1 + (n - a) div (3 + g % 8) for n words. A null
    id has no crc32, and its text stays.
    """
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeated(made):
        # A variable of a lambda, so that the text is split once and not once per word.
        w, n, g = made["words"], F.size(made["words"]), F.floor(made["crc"] / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda word, i: F.when(i < a, word).otherwise(F.get(w, a + (i - a) % p))), " ")

    made = F.array(F.struct(words.alias("words"), crc.alias("crc")))
    text = F.when(crc % 10 == 0, F.get(F.transform(made, repeated), F.lit(0))).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", greatest_run(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def damaged(turns):
    """Turns dropped, emptied, cut, repeated or given the user's role, by the crc32 of conversation and turn; nulls are one space."""
    conv, turn = (F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn"))
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20).alias("fate"),
    ).filter("fate <> 0")
    fate = F.col("fate")
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    role = F.when(fate == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def op13_conversation_repair(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    found, repaired = repair_conversations(damaged(turns))
    digests = text_digests(repaired)
    ids = turns.select(F.col("conv_id").alias("own_id")).distinct()
    joined = ids.join(found, F.col("own_id").eqNullSafe(found.conv_id), "left").join(
        digests, F.col("own_id").eqNullSafe(digests.conv_id), "left"
    )
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        F.col("own_id").alias("conv_id"),
        *(F.coalesce(name, F.lit(0)).alias(name) for name in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


LLM_QUERIES = {
    query.__name__: query
    for query in (
        op1_token_counts,
        op2_katz,
        op3_quality,
        op4_decontamination,
        op5_exact_dedup,
        op6_toxicity,
        op7_licences,
        op8_packing,
        op9_language_id,
        op10_jaccard_join,
        op11_byte_bpe,
        op12_periodic_runs,
        op13_conversation_repair,
        corpus_pipeline.pipeline,
    )
}
LLM_SQL = {
    "op4_decontamination": DECONTAMINATION,
    "op5_exact_dedup": EXACT_DEDUP,
    "op7_licences": LICENCES,
    "op10_jaccard_join": JACCARD_JOIN,
}
