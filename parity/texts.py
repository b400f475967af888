"""Text and lexical queries over `conversations`, `documents` and `benchmark`."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity.registry import query, table
from versionlake.functions import text as X
from versionlake.functions.scorers import SparseScorer
from versionlake.operators import lexical, postings, ranking, tiles, transcripts as T
from versionlake.session import reliable_checkpoint

PHRASES = ["that", "was", "Thank you."]
WORDS = "list_filter(regexp_split_to_array(trim({0}), '\\s+'), lambda x: x <> '')"
CLEAN = ("trim(regexp_replace(regexp_replace({0}, '\\bthat\\b', '', 'gi'), '\\bwas\\b', '', 'gi'), "
         "' ' || chr(10) || chr(9) || chr(13))")


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


@query("clean_phrases", f"""
SELECT conv_id, turn, md5({CLEAN.format('text')}) AS text FROM conversations""")
def clean_phrases(spark, sf_dir):
    return turns(spark, sf_dir).withColumn("text", F.md5(X.remove_phrases(F.col("text"), PHRASES)))


@query("collapse_repeats")
def collapse_repeats(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", X.collapse_repeats(F.col("text"), 2).alias("text"))


@query("chunk_mask", f"""
SELECT conv_id, turn, len({WORDS.format("replace(text, '.', ' ')")}) >= 12 AS mask FROM conversations""")
def chunk_mask(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", X.valid_chunk(
        F.replace(F.col("text"), F.lit("."), F.lit(" ")), 12).alias("mask"))


@query("regroup_text", f"""
WITH c AS (SELECT conv_id, turn, {CLEAN.format('text')} AS t FROM conversations),
m AS (SELECT *, len({WORDS.format('t')}) >= 12 AS ok FROM c)
SELECT conv_id, count(*)::INT AS n_texts, count(*) FILTER (ok)::INT AS n_valid,
       md5(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (ok), '')) AS joined
FROM m GROUP BY conv_id""")
def regroup_text(spark, sf_dir):
    cleaned = T.clean_chunks(turns(spark, sf_dir), "text", PHRASES, repeat_threshold=1, min_words=12)
    out = T.regroup_text(cleaned, "conv_id", "turn", tracks=turns(spark, sf_dir))
    return out.select("conv_id", F.size("texts").alias("n_texts"),
                      F.size(F.filter("mask", lambda m: m)).alias("n_valid"), F.md5("joined").alias("joined"))


@query("regroup_non_trivial", """
SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS joined FROM conversations
WHERE len(string_split(text, ' ')) > 3 GROUP BY conv_id""")
def regroup_non_trivial(spark, sf_dir):
    return (T.regroup_non_trivial(turns(spark, sf_dir), "conv_id", "turn")
            .withColumn("joined", F.md5("joined")))


@query("split_pieces", """
WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_matches(x, '\\S')) AS p
           FROM documents)
SELECT doc_id, len(p)::INT AS n, md5(array_to_string(p, '|')) AS pieces FROM p""")
def split_pieces(spark, sf_dir):
    return (table(spark, sf_dir, "documents").select("doc_id", X.split_pieces(F.col("text")).alias("p"))
            .select("doc_id", F.size("p").cast("int").alias("n"), F.md5(F.array_join("p", "|")).alias("pieces")))


TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}')"


@query("tokenize", f"""
SELECT doc_id, len({TOKENS.format('text')})::INT AS n_tokens,
       md5(array_to_string({TOKENS.format('text')}, ' ')) AS tokens FROM documents""")
def tokenize(spark, sf_dir):
    return (table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
            .select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens")))


@query("jaccard_pairs", f"""
WITH t AS (SELECT conv_id, turn, {TOKENS.format('text')} AS k FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.k AS x, b.k AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0.0
  ELSE len(list_distinct(list_intersect(x, y))) / len(list_distinct(list_concat(x, y)))::DOUBLE END, 6) AS score
FROM p""")
def jaccard_pairs(spark, sf_dir):
    t = turns(spark, sf_dir).select("conv_id", "turn", X.tokens(F.col("text")).alias("x"))
    follow = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    return t.join(follow, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(X.jaccard(F.col("x"), F.col("y")), 6).alias("score"))


def wer_pairs(spark, sf_dir):
    return turns(spark, sf_dir).select(
        "conv_id", "turn", "text", F.regexp_replace("text", " (de|the|der) ", " ").alias("hyp"),
        F.regexp_replace("text", "(on|en) ", "$1").alias("hyp2"), F.length("text").alias("size"))


def rows_sql(pairs: str, first: str, others: str) -> str:
    """The table of two word lists x and y, row by row: `first` is the first row, `others` a row from the one before it.

    `pairs` gives id, x, y; the result `last` has the value in the corner of each table.
    """
    return f"""
WITH RECURSIVE p AS ({pairs}),
cell AS (SELECT id, 0 AS i, j::INT AS j, ({first})::INT AS v FROM (SELECT id, unnest(range(0, len(y) + 1)) AS j FROM p)
  UNION ALL
  SELECT id, i + 1, j, ({others})::INT FROM (
    SELECT c.id, i, j, v, lag(v) OVER (PARTITION BY c.id ORDER BY j) AS w, x[i + 1] = y[j] AS same
    FROM cell c JOIN p ON p.id = c.id WHERE i < len(x))),
last AS (SELECT cell.id, v FROM cell JOIN p ON p.id = cell.id WHERE i = len(x) AND j = len(y))"""


PLAIN_WORDS = "list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda k: k <> '')"


@query("wer", rows_sql(
    f"""SELECT conv_id || '-' || turn AS id, conv_id, turn, {PLAIN_WORDS.format('text')} AS x,
               {PLAIN_WORDS.format("regexp_replace(text, ' (de|the|der) ', ' ', 'g')")} AS y FROM conversations""",
    "j", """j + min(CASE WHEN j = 0 THEN i + 1 ELSE least(v + 1, w + (NOT same)::INT) - j END)
            OVER (PARTITION BY id ORDER BY j)""") + """
SELECT conv_id, turn, CASE WHEN len(x) > 0 THEN round(v / len(x)::DOUBLE, 6) END AS wer FROM p LEFT JOIN last USING (id)""")
def wer(spark, sf_dir):
    return (T.word_errors(wer_pairs(spark, sf_dir), "text", "hyp")
            .select("conv_id", "turn", F.round("wer", 6).alias("wer")))


def system_sql(name: str, change: str) -> str:
    return f"""SELECT conv_id || '-' || turn || '-{name}' AS id, '{name}' AS system, length(text) AS size,
               {PLAIN_WORDS.format('text')} AS x, {PLAIN_WORDS.format(f"regexp_replace(text, {change}, 'g')")} AS y FROM conversations"""


# the p-value is one minus the t density between -t and t, by Simpson's rule
@query("compare_systems", rows_sql(
    system_sql("a", "' (de|the|der) ', ' '") + " UNION ALL " + system_sql("b", "'(on|en) ', '\\1'"),
    "j", """j + min(CASE WHEN j = 0 THEN i + 1 ELSE least(v + 1, w + (NOT same)::INT) - j END)
            OVER (PARTITION BY id ORDER BY j)""") + """,
rated AS (SELECT system, size, v / len(x)::DOUBLE AS wer FROM p JOIN last USING (id) WHERE len(x) > 0),
sums AS (SELECT avg(wer) FILTER (system = 'a') AS mean_a, stddev_samp(wer) FILTER (system = 'a') AS std_a,
                avg(wer) FILTER (system = 'b') AS mean_b, stddev_samp(wer) FILTER (system = 'b') AS std_b,
                corr(wer, size) FILTER (system = 'b') AS correlation, count(*) FILTER (system = 'b') AS n FROM rated),
student AS (SELECT (n - 2)::DOUBLE AS free, abs(correlation) * sqrt((n - 2) / (1 - correlation * correlation)) AS t FROM sums),
density AS (SELECT k, t, exp(lgamma((free + 1) / 2) - lgamma(free / 2)) / sqrt(free * pi())
                          * pow(1 + pow(t * k / 4000, 2) / free, -(free + 1) / 2) AS f
            FROM student, (SELECT unnest(range(0, 4001)) AS k)),
inside AS (SELECT 2 * max(t) / 4000 / 3 * sum(f * CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) AS share FROM density)
SELECT round(mean_a, 6) AS mean_a, round(std_a, 6) AS std_a, round(mean_b, 6) AS mean_b, round(std_b, 6) AS std_b,
       round(correlation, 6) AS correlation, n, round(1 - share, 6) AS p_value FROM sums, inside""")
def compare_systems(spark, sf_dir):
    out = T.compare_systems(wer_pairs(spark, sf_dir), "text", "hyp", "hyp2", "size")
    return out.select(*[F.round(c, 6).alias(c) if c != "n" else F.col(c) for c in out.columns])


@query("correlation", """
SELECT round(corr(value, hour(ts)), 6) AS correlation, count(*) AS n FROM events""")
def correlation(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.agg(F.round(F.corr("value", F.hour("ts").cast("double")), 6).alias("correlation"),
                 F.count("*").alias("n"))


@query("text_chunks")
def text_chunks(spark, sf_dir):
    out = T.add_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", F.size("chunks").alias("n_chunks"),
                      F.array_max(F.transform("chunks", F.length)).alias("longest"),
                      F.md5(F.array_join("chunks", "|")).alias("chunks"))


# ---------------------------------------------------------------- lexical

COUNTS = f"""
WITH docs AS (SELECT 'd' || doc_id AS id, text FROM documents),
qs AS (SELECT 'q' || item_id AS id, text FROM benchmark),
tok AS (SELECT id, unnest({TOKENS.format('text')}) AS term FROM docs),
tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n FROM docs),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qtf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({TOKENS.format('text')}) AS term FROM qs) GROUP BY ALL),
idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, n),
raw AS (SELECT id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
vec AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw),
qraw AS (SELECT id, term, tf * idf AS w FROM qtf JOIN idf USING (term)),
qvec AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM qraw),
dl AS (SELECT d.id, coalesce(sum(tf), 0)::DOUBLE AS dl FROM docs d LEFT JOIN tf ON tf.id = d.id GROUP BY d.id),
avgdl AS (SELECT avg(dl) AS a FROM dl),
bm AS (SELECT tf.id, tf.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / a)) AS w
       FROM tf JOIN df USING (term) JOIN dl ON dl.id = tf.id, n, avgdl)
"""


def docs_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")


def items_of(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), F.col("item_id")).alias("id"), "text")


def ranked_sql(query_side, corpus_side, k=10):
    return COUNTS + f""",
pairs AS (SELECT q.id AS query_id, d.id AS corpus_id FROM qs q, docs d),
s AS (SELECT q.id AS query_id, c.id AS corpus_id, sum(q.w * c.w) AS s FROM {query_side} q JOIN {corpus_side} c
      USING (term) GROUP BY ALL),
f AS (SELECT query_id, corpus_id, round(coalesce(s, 0.0), 9) AS s FROM pairs LEFT JOIN s USING (query_id, corpus_id)),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, corpus_id))::INT AS rank FROM f)
SELECT query_id, corpus_id, round(s, 6) AS score, rank FROM r WHERE rank <= {k}"""


@query("tfidf", COUNTS + "SELECT id, term, round(w, 6) AS weight FROM vec")
def tfidf(spark, sf_dir):
    return lexical.postings(lexical.tfidf(docs_of(spark, sf_dir))).withColumn("weight", F.round("weight", 6))


@query("tfidf_max_features", COUNTS.replace(
    "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)",
    "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 200)")
    + "SELECT id, term, round(w, 6) AS weight FROM vec")
def tfidf_max_features(spark, sf_dir):
    return (lexical.postings(lexical.tfidf(docs_of(spark, sf_dir), max_features=200))
            .withColumn("weight", F.round("weight", 6)))


@query("bm25_index", COUNTS + "SELECT id, term, round(w, 6) AS weight FROM bm")
def bm25_index(spark, sf_dir):
    return lexical.postings(lexical.bm25_index(docs_of(spark, sf_dir))).withColumn("weight", F.round("weight", 6))


def lexical_top(queries, corpus, k=10):
    out = tiles.top_k(queries, corpus, SparseScorer(), k)
    return out.select("query_id", "corpus_id", F.round("score", 6).alias("score"), "rank")


@query("tfidf_topk", ranked_sql("qvec", "vec"))
def tfidf_topk(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    model = lexical.tfidf_fit(docs)
    return lexical_top(lexical.tfidf_transform(items_of(spark, sf_dir), model), lexical.tfidf_transform(docs, model))


@query("bm25_topk", ranked_sql("(SELECT id, term, tf AS w FROM qtf)", "bm"))
def bm25_topk(spark, sf_dir):
    return lexical_top(lexical.query_counts(items_of(spark, sf_dir)), lexical.bm25_index(docs_of(spark, sf_dir)))


def bounded_top(queries, corpus, k=10):
    return postings.top_k(queries, corpus, k).select("query_id", "corpus_id", F.round("score", 6).alias("score"), "rank")


@query("bm25_postings", ranked_sql("(SELECT id, term, tf AS w FROM qtf)", "bm"))
def bm25_postings(spark, sf_dir):
    return bounded_top(lexical.query_counts(items_of(spark, sf_dir)), lexical.bm25_index(docs_of(spark, sf_dir)))


@query("tfidf_postings", ranked_sql("qvec", "vec"))
def tfidf_postings(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    model = lexical.tfidf_fit(docs)
    return bounded_top(lexical.tfidf_transform(items_of(spark, sf_dir), model), lexical.tfidf_transform(docs, model))


@query("sparse_topk", ranked_sql("(SELECT id, term, 1 + ln(tf) AS w FROM qtf)",
                                 "(SELECT id, term, 1 + ln(tf) AS w FROM tf)"))
def sparse_topk(spark, sf_dir):
    def log_counts(docs):
        return lexical.query_counts(docs).withColumn("weights", F.transform("weights", lambda w: 1 + F.log(w)))
    return lexical_top(log_counts(items_of(spark, sf_dir)), log_counts(docs_of(spark, sf_dir)))


@query("tfidf_cosine", COUNTS + """,
p AS (SELECT 'd' || doc_id AS a, 'd' || (doc_id + 1) AS b FROM documents)
SELECT a AS query_id, b AS corpus_id, round(sum(x.w * y.w), 6) AS score
FROM p JOIN vec x ON x.id = a JOIN vec y ON y.id = b AND y.term = x.term GROUP BY ALL""")
def tfidf_cosine(spark, sf_dir):
    pairs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("query_id"),
        F.concat(F.lit("d"), F.col("doc_id") + 1).alias("corpus_id"))
    return (lexical.pair_cosine(pairs, lexical.tfidf(docs_of(spark, sf_dir)))
            .withColumn("score", F.round("score", 6)))


NEXT_TURN = f"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM conversations),
p AS (SELECT conv_id || '-' || turn AS pair, a.k AS c, b.k AS r
      FROM t a JOIN (SELECT conv_id, turn - 1 AS turn, k FROM t) b USING (conv_id, turn)),
o AS (SELECT unnest([1, 2, 3, 4]) AS n),
cg AS (SELECT pair, n, gram, count(*) AS c FROM (
         SELECT pair, n, unnest(list_transform(range(1, len(c) - n + 2), lambda i: array_to_string(c[i:i + n - 1], ' '))) AS gram
         FROM p, o WHERE len(c) >= n) GROUP BY ALL),
rg AS (SELECT pair, n, gram, count(*) AS c FROM (
         SELECT pair, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) AS gram
         FROM p, o WHERE len(r) >= n) GROUP BY ALL),
pr AS (SELECT pair, n, sum(least(cg.c, coalesce(rg.c, 0))) / sum(cg.c)::DOUBLE AS p
       FROM cg LEFT JOIN rg USING (pair, n, gram) GROUP BY pair, n),
l AS (SELECT pair, sum(CASE WHEN p > 0 THEN ln(p) END) AS s, count(*) FILTER (p > 0) AS k FROM pr GROUP BY pair)
SELECT pair, round(CASE WHEN k = 4 THEN (CASE WHEN len(c) > len(r) THEN 1 ELSE exp(1 - len(r) / len(c)::DOUBLE) END)
                        * exp(s / 4) ELSE 0 END, 6) AS bleu
FROM p LEFT JOIN l USING (pair)"""


def next_turn(spark, sf_dir):
    t = turns(spark, sf_dir).select("conv_id", "turn", X.ascii_words(F.col("text")).alias("c"))
    follow = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("c").alias("r"))
    return t.join(follow, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("pair"), "c", "r")


@query("bleu", NEXT_TURN)
def bleu(spark, sf_dir):
    return T.bleu(next_turn(spark, sf_dir), "pair", "c", "r").withColumn("bleu", F.round("bleu", 6))


ROUGE_PAIRS = """
SELECT a.conv_id || '-' || a.turn AS id, a.k AS x, b.k AS y
FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM conversations) a
JOIN (SELECT conv_id, turn - 1 AS turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM conversations) b
  USING (conv_id, turn)"""


@query("rouge_l", rows_sql(ROUGE_PAIRS, "0", """
    max(CASE WHEN j = 0 THEN 0 WHEN same THEN w + 1 ELSE v END) OVER (PARTITION BY id ORDER BY j)""") + """
SELECT id AS pair, round(CASE WHEN len(x) + len(y) > 0 THEN 2.0::DOUBLE * v / (len(x) + len(y)) ELSE 0.0 END, 6) AS rouge
FROM p JOIN last USING (id)""")
def rouge_l(spark, sf_dir):
    return next_turn(spark, sf_dir).select("pair", F.round(X.rouge_l(F.col("c"), F.col("r")), 6).alias("rouge"))


@query("error_text_report")
def error_text_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text", F.col("source").alias("label"))
    items = tiles.compact_checkpoint(lexical.tfidf(docs).join(docs.select("id", "label"), "id"), ("terms",))
    ranked = reliable_checkpoint(tiles.top_k(items, items, SparseScorer(), 10))
    first = ranking.first_relevant(items, items, SparseScorer(), ranked)
    errors = ranking.error_table(first, ranking.false_positives(ranked))
    out = T.error_text_report(errors, docs, items.drop("label"), "id", "text")
    return out.select("query_id", "fp_id", "fn_id", *[F.round(c, 6).alias(c) for c in out.columns[3:]])
