"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark plans."""

import re
import sys

from registry.inputs import ABBREVIATION_SWAPS, CONTRACTION_SWAPS, DENSE_TERMS, QUERIES, SINGLE_QUERY
from termscale import rules

# Patterns and tables are written apart from the Spark side, so that a wrong one shows.
EDGE_PUNCTUATION = ".<>-{}[]/:;\\@!#$%^&*()"
SPLIT = r"""\p{Z}\x01-\x20",;:@#$%&?!()\[\]{}<>`"""
TOKEN = f"[^'{SPLIT}]+(?:'[^'{SPLIT}]+)*"
SENTENCE = r"""(?s)(.+?(?:[.!?]+["')\]}>]*|\z))(?:[ \t\r\n]+|\z)"""
END_MARK = r"""[.!?]+["')\]}>]*\z"""
DIGITS = "[" + "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isdigit()) + "]"


# The parameters of the weight, as SQL numbers.
K1, B = "1.6::DOUBLE", "0.75::DOUBLE"


def lit(text):
    return "'" + text.replace("'", "''") + "'"


def values(name, columns, rows):
    body = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else lit(v) for v in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


def replaced(column, pairs):
    for search, replacement in pairs:
        column = f"replace({column}, {lit(search)}, {lit(replacement)})"
    return column


def expanded(column):
    return f"CASE WHEN contains({column}, '''') THEN {replaced(column, rules.contraction_rules())} ELSE {column} END"


def stripped(column):
    return f"regexp_replace({column}, {lit(DIGITS)}, '', 'g')"


def is_word(column):
    edges = lit(EDGE_PUNCTUATION)
    return (
        f"(length({column}) >= 2 AND NOT contains({edges}, left({column}, 1))"
        f" AND NOT contains({edges}, right({column}, 1)))"
    )


CLASS = (
    "CASE WHEN starts_with(tag, 'J') THEN 'a' WHEN starts_with(tag, 'V') THEN 'v'"
    " WHEN starts_with(tag, 'N') THEN 'n' WHEN starts_with(tag, 'R') THEN 'r' END"
)


def token_tables(prefix, table, key):
    """<prefix>_sents and <prefix>_tok of a table's text."""
    return [
        f"""{prefix}_sents AS (
  SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS sent_pos FROM (
    SELECT {key} AS doc_id, list_filter(regexp_extract_all(text, {lit(SENTENCE)}, 1), lambda x: x <> '') AS l
    FROM {table}))""",
        f"""{prefix}_tok AS (
  SELECT doc_id, sent_pos, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS tok_pos FROM (
    SELECT doc_id, sent_pos, regexp_extract_all({stripped(expanded('bare'))}, {lit(TOKEN)}, 0) AS l
    FROM (SELECT *, regexp_replace(sentence, {lit(END_MARK)}, '') AS bare FROM {prefix}_sents)))""",
    ]


def form_tables(lexicon):
    """forms: for each distinct surface, cut every suffix off and look the rest up in the lexicon."""
    return [
        f"entries AS (SELECT surface, tag, lemma, {CLASS} AS class FROM {lexicon})",
        "kept AS (SELECT *, lower(token) AS surface FROM d_tok WHERE token NOT IN (SELECT w FROM stop))",
        "surfaces AS (SELECT DISTINCT surface FROM kept)",
        """candidates AS (
  SELECT s.surface, e.tag, e.lemma, 0 AS source FROM surfaces s JOIN entries e USING (surface)
  UNION ALL
  SELECT s.surface, r.rule_tag, e.lemma, 1 FROM surfaces s
  JOIN rules r ON s.surface LIKE '%' || r.suffix
  JOIN entries e ON e.class = r.class
   AND e.lemma = left(s.surface, length(s.surface) - length(r.suffix)) || r.replacement)""",
        """forms AS (
  SELECT surface, tag, lemma FROM (
    SELECT *, row_number() OVER (PARTITION BY surface ORDER BY source, length(lemma), lemma, tag) AS choice
    FROM candidates) WHERE choice = 1)""",
        f"""tagged AS (
  SELECT doc_id, sent_pos, tok_pos, surface, tag, lemma, {CLASS} AS class FROM (
    SELECT k.doc_id, k.sent_pos, k.tok_pos, k.surface, coalesce(f.tag, 'NN') AS tag,
           coalesce(f.lemma, k.surface) AS lemma
    FROM kept k LEFT JOIN forms f ON k.surface = f.surface))""",
    ]


FIXED = [
    values("stop", ["w"], [(w,) for w in rules.stop_words()]),
    values("lexicon", ["surface", "tag", "lemma"], rules.lexicon_rows()),
    values("rules", ["class", "suffix", "replacement", "rule_tag"], rules.detachment_rows()),
]

STATISTICS = [
    f"stream AS (SELECT doc_id, sent_pos, tok_pos, lemma AS term FROM tagged WHERE class IS NOT NULL AND {is_word('surface')})",
    """tf AS (
  SELECT doc_id, term, count(*) AS tf, min(sent_pos * 4294967296 + tok_pos) AS first_pos
  FROM stream GROUP BY doc_id, term)""",
    """doc AS (
  SELECT d.doc_id, coalesce(sum(tf.tf), 0)::BIGINT AS doc_len, coalesce(max(tf.tf), 0)::BIGINT AS max_tf
  FROM documents d LEFT JOIN tf ON d.doc_id = tf.doc_id GROUP BY d.doc_id)""",
    "corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(doc_len)::BIGINT AS total_len, sum(doc_len) / count(*) AS avg_len FROM doc)",
    "terms AS (SELECT term, count(*)::BIGINT AS df, 1 + ln(any_value(n_docs) / count(*)) AS idf FROM tf, corpus GROUP BY term)",
    """vocab AS (
  SELECT term, first_doc, row_number() OVER (ORDER BY first_doc, first_pos) - 1 AS term_id FROM (
    SELECT term, doc_id AS first_doc, first_pos FROM tf
    QUALIFY row_number() OVER (PARTITION BY term ORDER BY doc_id, first_pos) = 1))""",
    f"""w AS (
  SELECT doc_id, term, idf * (a * ({K1} + 1)) / (a + {K1} * (1 - {B} + {B} * doc_len / avg_len)) AS weight
  FROM (SELECT tf.doc_id, tf.term, 0.5::DOUBLE + 0.5::DOUBLE * tf.tf / doc.max_tf AS a, terms.idf, doc.doc_len, corpus.avg_len
        FROM tf JOIN doc ON tf.doc_id = doc.doc_id JOIN terms ON tf.term = terms.term, corpus))""",
]

TOKENS = token_tables("d", "documents", "doc_id")


def query_values(queries):
    return values("q", ["query_id", "term"], [(i, t) for i, terms in enumerate(queries, 1) for t in terms])


def sql(select, *extra, lexicon="lexicon", first=()):
    parts = FIXED + list(first) + TOKENS + form_tables(lexicon) + STATISTICS + list(extra)
    # Computed once each, however often they are named.
    parts = [re.sub(r"^(\w+) AS \(", r"\1 AS MATERIALIZED (", part) for part in parts]
    return "WITH " + ",\n".join(parts) + "\n" + select


def ranking(queries, k=10):
    """Score every document for every query, then rank."""
    return (
        query_values(queries),
        """scores AS (
  SELECT i.query_id, d.doc_id, coalesce(s.score, 0) AS score
  FROM (SELECT DISTINCT query_id FROM q) i CROSS JOIN documents d
  LEFT JOIN (SELECT query_id, doc_id, sum(weight) AS score FROM q JOIN w ON q.term = w.term GROUP BY ALL) s
    ON s.query_id = i.query_id AND s.doc_id = d.doc_id)""",
        f"""ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank,
         doc_id, score FROM scores QUALIFY rank <= {k})""",
    )


TOP_DOCS = "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ranked"
TOP_WORDS = """SELECT row_number() OVER (ORDER BY round(s.score, 9) DESC, v.term_id) AS rank, s.term, round(s.score, 6) AS score
FROM (SELECT term, sum(weight) AS score FROM w GROUP BY term) s JOIN vocab v ON s.term = v.term
QUALIFY rank <= 10"""

BENCHMARK_TOKENS = token_tables("b", "benchmark", "item_id")

# A hidden Markov model of word languages, and Viterbi as a recursion over places.
TAGGING = (
    *BENCHMARK_TOKENS,
    "tt AS (SELECT t.doc_id, sent_pos, tok_pos, lower(token) AS surface, lang AS tag FROM d_tok t JOIN documents d ON t.doc_id = d.doc_id WHERE lang IS NOT NULL)",
    "wt AS (SELECT surface, tag, count(*) AS n FROM tt GROUP BY ALL)",
    "tags AS (SELECT tag, sum(n) AS total, row_number() OVER (ORDER BY tag) AS no FROM wt GROUP BY tag)",
    "moves AS (SELECT coalesce(lag(tag) OVER (PARTITION BY doc_id, sent_pos ORDER BY tok_pos), '') AS before, tag FROM tt)",
    """trans AS (
  SELECT b.tag AS before, t.tag, t.no, ln((coalesce(n, 0) + 1) / (sum(coalesce(n, 0) + 1) OVER (PARTITION BY b.tag))) AS move
  FROM (SELECT tag FROM tags UNION ALL SELECT '') b CROSS JOIN tags t
  LEFT JOIN (SELECT before, tag, count(*) AS n FROM moves GROUP BY ALL) m ON m.before = b.tag AND m.tag = t.tag)""",
    "rare AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY surface) AS size FROM wt) WHERE size <= 10)",
    """ends AS (
  SELECT ending, tag, sum(n) AS n FROM (
    SELECT right(surface, k) AS ending, tag, n FROM rare, (VALUES (1), (2), (3)) v(k) WHERE k < length(surface)
    UNION ALL SELECT '', tag, n FROM wt) GROUP BY ALL)""",
    """likely AS (
  SELECT ending, tag, ln((n / sum(n) OVER (PARTITION BY ending)) / (total / (SELECT sum(total) FROM tags))) AS own
  FROM ends JOIN tags USING (tag))""",
    "items AS (SELECT doc_id, sent_pos, tok_pos, lower(token) AS surface FROM b_tok)",
    """longest AS (
  SELECT surface, max(length(ending)) AS k FROM (SELECT DISTINCT surface FROM items WHERE surface NOT IN (SELECT surface FROM wt)) s
  JOIN (SELECT DISTINCT ending FROM likely) e ON right(surface, length(ending)) = ending AND length(ending) < length(surface) OR ending = ''
  GROUP BY surface)""",
    """choices AS (
  SELECT surface, tag, ln(n / total) AS own FROM wt JOIN tags USING (tag)
  UNION ALL SELECT surface, tag, own FROM longest JOIN likely ON ending = CASE WHEN k = 0 THEN '' ELSE right(surface, k) END)""",
    """walk(doc_id, sent_pos, tok_pos, tag, score, path) AS (
  SELECT doc_id, sent_pos, tok_pos, c.tag, move + own, [c.tag] FROM items i JOIN choices c USING (surface)
  JOIN trans ON before = '' AND trans.tag = c.tag WHERE tok_pos = 0
  UNION ALL
  SELECT * FROM (
    SELECT i.doc_id, i.sent_pos, i.tok_pos, c.tag, w.score + move + own AS score, list_append(path, c.tag) AS path
    FROM walk w JOIN items i ON i.doc_id = w.doc_id AND i.sent_pos = w.sent_pos AND i.tok_pos = w.tok_pos + 1
    JOIN choices c ON c.surface = i.surface JOIN trans ON before = w.tag AND trans.tag = c.tag
    QUALIFY row_number() OVER (PARTITION BY i.doc_id, i.sent_pos, i.tok_pos, c.tag ORDER BY w.score + move DESC, w.tag) = 1))""",
    """ended AS (
  SELECT doc_id, sent_pos, path FROM walk
  QUALIFY row_number() OVER (PARTITION BY doc_id, sent_pos ORDER BY tok_pos DESC, score DESC, tag) = 1)""",
)


OPENING, CLOSING = "([{<\"'", ")]}>\"',;:"
BLANKS = "chr(9) || chr(10) || chr(13) || ' '"
HIDDEN = "hidden AS (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id % 2 = 0)"
LEARNT_SENTENCES = f"""WITH docs AS MATERIALIZED (SELECT doc_id, {replaced('text', ABBREVIATION_SWAPS)} AS text FROM documents),
cleaned AS (
  SELECT lower(rtrim(ltrim(piece, {lit(OPENING)}), {lit(CLOSING)})) AS w
  FROM (SELECT unnest(string_split_regex(text, '[ \\t\\r\\n]+')) AS piece FROM docs)),
words AS (
  SELECT CASE WHEN ends_with(w, '.') THEN left(w, length(w) - 1) ELSE w END AS word, ends_with(w, '.') AS stop FROM cleaned),
counted AS (
  SELECT word, count(*) FILTER (stop) AS s, count(*) FILTER (NOT stop) AS o FROM words
  WHERE regexp_matches(word, '\\p{{L}}') GROUP BY word),
chance AS (SELECT sum(s) / sum(s + o) AS p FROM counted),
short AS MATERIALIZED (
  SELECT word FROM (
    SELECT word, s, o, p, length(replace(word, '.', '')) AS letters, length(word) - length(replace(word, '.', '')) AS inner_stops
    FROM counted, chance WHERE s > 0)
  WHERE 2 * (s * (ln(0.99::DOUBLE) - ln(p)) + o * (ln(1 - 0.99::DOUBLE) - ln(1 - p)))
    * exp(-letters) * (inner_stops + 1) * pow(letters, -o) >= 0.3),
pieces AS (
  SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS place
  FROM (SELECT doc_id, list_filter(regexp_extract_all(text, {lit(SENTENCE)}, 0), lambda x: x <> '') AS l FROM docs)),
lasts AS (
  SELECT *, list_extract(string_split_regex(rtrim(piece, {BLANKS}), '[ \\t\\r\\n]'), -1) AS final FROM pieces),
flagged AS (
  SELECT doc_id, place, piece, regexp_matches(piece, '[.!?]+["'')\\]}}>]*[ \\t\\r\\n]*\\z') AS ended,
    ends_with(final, '.') AND lower(ltrim(left(final, length(final) - 1), {lit(OPENING)})) IN (SELECT word FROM short) AS goes_on
  FROM lasts),
numbered AS (
  SELECT *, coalesce(sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (
    PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sent_pos FROM flagged),
joined AS (
  SELECT doc_id, sent_pos, string_agg(piece, '' ORDER BY place) AS whole, last(ended ORDER BY place) AS ended
  FROM numbered GROUP BY doc_id, sent_pos)
SELECT doc_id, sent_pos, CASE WHEN ended THEN rtrim(whole, {BLANKS}) ELSE whole END AS sentence FROM joined"""


def oracle():
    return {
        "tsv_parse": """SELECT doc_id, source AS conf, 'a "title"' || chr(9) || 'in ' || chr(92) || lang AS title,
  '' AS author, n_chars AS year, regexp_replace(text, '[\\t\\r\\n]', ' ', 'g') AS abstract, lang AS theme FROM documents""",
        "sentences": sql("SELECT doc_id, sent_pos, sentence FROM d_sents"),
        "sentences_learnt": LEARNT_SENTENCES,
        "expand_contractions": f"SELECT doc_id, {expanded('text')} AS expanded FROM "
        f"(SELECT doc_id, {replaced('text', CONTRACTION_SWAPS)} AS text FROM documents)",
        "strip_digits": f"SELECT 'documents' AS origin, doc_id AS id, {stripped('text')} AS stripped FROM documents "
        f"UNION ALL SELECT 'pages', page_id, {stripped('html')} FROM pages",
        "tokenize": sql("SELECT doc_id, sent_pos, tok_pos, lower(token) AS token FROM d_tok"),
        "stopword_filter": sql(
            "SELECT doc_id, token, count(*) AS n FROM d_tok WHERE token NOT IN (SELECT w FROM stop) GROUP BY ALL"
        ),
        "stopword_union": sql(
            f"""SELECT m.word, coalesce(u.n, 0) AS n_tokens FROM (
  SELECT w AS word FROM stop UNION SELECT surface FROM lexicon WHERE {CLASS} IS NULL
  UNION SELECT token FROM b_tok) m
LEFT JOIN (SELECT token, count(*) AS n FROM d_tok GROUP BY token) u ON m.word = u.token""",
            *BENCHMARK_TOKENS,
        ),
        "pos_class": sql(
            "SELECT tag, coalesce(class, 'none') AS class, count(*) AS n_tokens FROM tagged GROUP BY ALL"
        ),
        "pos_filter": sql(
            "SELECT doc_id, surface, class, count(*) AS n FROM tagged WHERE class IS NOT NULL GROUP BY ALL"
        ),
        "tag_context": sql(
            """SELECT i.doc_id AS item_id, i.sent_pos, i.tok_pos, i.surface, path[i.tok_pos + 1] AS tag
FROM items i JOIN ended e ON i.doc_id = e.doc_id AND i.sent_pos = e.sent_pos""",
            *TAGGING,
        ).replace("WITH ", "WITH RECURSIVE ", 1),
        "word_shape": f"""SELECT piece, count(*) AS n, {is_word('piece')} AS is_word FROM (
  SELECT unnest(string_split_regex(lower(text), '[ \\t\\r\\n]+')) AS piece
  FROM (SELECT text FROM documents UNION ALL SELECT html FROM pages)) GROUP BY piece""",
        "lemmatize": sql(
            "SELECT surface, tag, lemma, count(*) AS n FROM tagged GROUP BY ALL",
            lexicon="(SELECT * FROM lexicon UNION ALL SELECT * FROM added)",
            first=BENCHMARK_TOKENS
            + [
                """added AS (
  SELECT DISTINCT lower(token) AS surface, 'NN' AS tag, lower(token) AS lemma
  FROM b_tok WHERE lower(token) NOT IN (SELECT surface FROM lexicon))"""
            ],
        ),
        "lemma_rules": sql(
            """SELECT surface, class, coalesce(known, made, surface) AS lemma FROM (
  SELECT w.surface, w.class, o.lemma AS known, left(w.surface, length(w.surface) - length(cut)) || put AS made FROM words w
  LEFT JOIN own o ON o.surface = w.surface AND o.class = w.class
  LEFT JOIN best b ON b.class = w.class AND right(w.surface, length(ending)) = ending AND length(ending) <= length(w.surface)
   AND (length(cut) < length(w.surface) OR put <> '')
  QUALIFY row_number() OVER (PARTITION BY w.surface, w.class ORDER BY length(ending) DESC NULLS LAST) = 1)""",
            "learnt AS (SELECT DISTINCT surface, class, lemma FROM entries WHERE class IS NOT NULL)",
            """edits AS (
  SELECT surface, class, surface[shared + 1:] AS cut, lemma[shared + 1:] AS put FROM (
    SELECT *, (SELECT max(k) FROM range(0, 40) r(k)
      WHERE k <= length(surface) AND k <= length(lemma) AND left(surface, k) = left(lemma, k)) AS shared FROM learnt))""",
            """best AS (
  SELECT class, ending, cut, put FROM (
    SELECT class, CASE WHEN k = 0 THEN '' ELSE right(surface, k) END AS ending, cut, put, count(*) AS n FROM edits, range(0, 6) r(k)
    WHERE k BETWEEN length(cut) AND length(surface) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY class, ending ORDER BY n DESC, length(cut), cut, put) = 1)""",
            "own AS (SELECT surface, class, first(lemma ORDER BY length(lemma), lemma) AS lemma FROM learnt GROUP BY ALL)",
            "words AS (SELECT DISTINCT lower(token) AS surface, class FROM d_tok, (VALUES ('n'), ('v')) v(class))",
        ),
        "token_stream": sql("SELECT doc_id, sent_pos, tok_pos, term FROM stream"),
        "analyze": sql(
            """SELECT d.doc_id, coalesce(string_agg(term || ':' || tf, ' ' ORDER BY first_pos), '') AS terms
FROM documents d LEFT JOIN tf ON d.doc_id = tf.doc_id GROUP BY d.doc_id"""
        ),
        "term_freq": sql("SELECT doc_id, term, tf FROM tf"),
        "doc_term_map": sql(
            """SELECT d.doc_id, coalesce(string_agg(term || ':' || tf, ' ' ORDER BY term), '') AS terms
FROM documents d LEFT JOIN tf ON d.doc_id = tf.doc_id GROUP BY d.doc_id"""
        ),
        "doc_freq": sql("SELECT term, df FROM terms"),
        "corpus_stats": sql(
            """SELECT n_docs, total_len, round(avg_len, 6) AS avg_len,
  (SELECT count(*) FROM terms) AS vocabulary_size FROM corpus"""
        ),
        "doc_stats": sql("SELECT doc_id, doc_len, max_tf FROM doc"),
        "vocabulary": sql("SELECT term, term_id, first_doc FROM vocab"),
        "augmented_tf": sql(
            """SELECT tf.doc_id, tf.term, round(0.5::DOUBLE + 0.5::DOUBLE * tf.tf / doc.max_tf, 6) AS tf_part
FROM tf JOIN doc ON tf.doc_id = doc.doc_id"""
        ),
        "idf": sql("SELECT term, df, round(idf, 6) AS idf FROM terms"),
        "bm25_weights": sql("SELECT doc_id, term, round(weight, 6) AS weight FROM w"),
        "doc_term_matrix": sql(
            "SELECT w.doc_id, v.term_id, round(w.weight, 6) AS weight FROM w JOIN vocab v ON w.term = v.term"
        ),
        "sparse_vectors": sql(
            """SELECT w.doc_id, string_agg(v.term_id::VARCHAR, ' ' ORDER BY v.term_id) AS term_ids,
  round(sum(w.weight), 6) AS total FROM w JOIN vocab v ON w.term = v.term GROUP BY w.doc_id"""
        ),
        "block_column_sums": sql(TOP_WORDS),
        "block_products": sql(
            """SELECT query_id::BIGINT AS query_id, doc_id, round(sum(weight), 6) AS score
FROM q JOIN w ON q.term = w.term GROUP BY query_id, doc_id""",
            query_values(QUERIES),
        ),
        "vocabulary_batches": sql(
            """SELECT w.doc_id, w.term, term_id, round(w.weight, 6) AS weight FROM w JOIN (
  SELECT v.term, row_number() OVER (ORDER BY f.term IS NULL, f.doc_id, f.first_pos, v.first_doc, v.term_id) - 1 AS term_id
  FROM vocab v LEFT JOIN (
    SELECT term, doc_id, first_pos FROM tf WHERE doc_id % 2 = 0
    QUALIFY row_number() OVER (PARTITION BY term ORDER BY doc_id, first_pos) = 1) f ON f.term = v.term) i ON w.term = i.term"""
        ),
        "tsv_round_trip": """SELECT doc_id, translate(text, chr(9) || chr(10) || chr(13), '   ') AS text FROM documents""",
        "topk_docs_clustered": sql(TOP_DOCS, *ranking(QUERIES)),
        "topk_docs_pruned": sql(TOP_DOCS, *ranking(QUERIES)),
        "topk_docs_items": sql(
            """SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, score
  FROM (
    SELECT i.query_id, d.doc_id, coalesce(s.score, 0) AS score
    FROM (SELECT DISTINCT doc_id AS query_id FROM b_tok) i CROSS JOIN documents d
    LEFT JOIN (SELECT b.doc_id AS query_id, w.doc_id, sum(weight) AS score FROM b_tok b JOIN w ON lower(b.token) = w.term GROUP BY ALL) s
      ON s.query_id = i.query_id AND s.doc_id = d.doc_id)
  QUALIFY rank <= 10)""",
            *BENCHMARK_TOKENS,
        ),
        "segments_doc_freq": sql(
            "SELECT term, count(*)::BIGINT AS df FROM tf WHERE doc_id NOT IN (SELECT doc_id FROM hidden) GROUP BY term", HIDDEN
        ),
        "segments_topk_docs": sql(
            TOP_DOCS,
            *ranking(QUERIES),
            first=[HIDDEN, "left_over AS (SELECT * FROM whole_table WHERE doc_id NOT IN (SELECT doc_id FROM hidden))"],
        )
        .replace("documents", "left_over")
        .replace("whole_table", "documents"),
        "ranking_lines": sql(
            """SELECT query_id, '[' || string_agg('(' || doc_id || ', ' || score || ')', ', ' ORDER BY rank) || ']' AS value
FROM (SELECT query_id, rank, doc_id, round(score * 1000)::BIGINT AS score FROM ranked) GROUP BY query_id""",
            *ranking(QUERIES),
        ),
        "dense_matrix": sql(
            """SELECT d.doc_id, q.pos AS "column", coalesce(round(w.weight, 6), 0) AS weight
FROM documents d CROSS JOIN q LEFT JOIN w ON w.doc_id = d.doc_id AND w.term = q.term""",
            values("q", ["pos", "term"], list(enumerate(DENSE_TERMS))).replace(
                "AS (", "AS (SELECT col0::BIGINT, col1 FROM (", 1
            )
            + ")",
        ),
        "query_scores": sql(
            """SELECT query_id::BIGINT AS query_id, doc_id, round(sum(weight), 6) AS score
FROM q JOIN w ON q.term = w.term GROUP BY query_id, doc_id""",
            query_values(QUERIES),
        ),
        "topk_docs_single": sql("SELECT doc_id, round(score, 6) AS score FROM ranked", *ranking([SINGLE_QUERY])),
        "topk_docs": sql(TOP_DOCS, *ranking(QUERIES)),
        "topk_words": sql(TOP_WORDS),
        "doc_position": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS doc_pos FROM documents",
        "split_merge_docs": sql(TOP_DOCS, *ranking(QUERIES)),
        "split_merge_words": sql(TOP_WORDS),
    }
