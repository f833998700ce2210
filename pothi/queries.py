"""Queries of the core operators over the tables of a folder, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pothi.functions import metrics, text, vectors
from pothi.operators import chunking, dedup, dense, fusion, generation, lexical, sampling, validation
from pothi.plans import evaluation
from pothi.sources import files

#: Searches ask for every row whose id is divisible by this, against all rows.
EVERY = 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Question-answer pairs, each once, as delivered last."""
    return dense.latest(table(spark, folder, "nctb_qa"), "pair_id", "loaded_at")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks, each once; repeated rows are equal."""
    return table(spark, folder, "chunks").dropDuplicates(["chunk_id"])


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "predictions").distinct()


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """The stated query set."""
    return table(spark, folder, "nctb_qa").where(F.col("pair_id") % EVERY == 0).groupBy("pair_id").agg(F.min("question").alias("question"), F.min("chunk_id").alias("gold_chunk_id"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


WS, PUNCT = text.WS, text.PUNCTUATION.replace("'", "''")
BN, EN = text.BENGALI_DIGITS, text.ASCII_DIGITS


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def sql_tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '{WS}+'), lambda t: t <> '')"


def sql_preamble(c: str) -> str:
    return sql_strip(f"regexp_replace({c}, '(?i){text.PREAMBLE.replace(chr(92) + 's', WS)}', '')")


def sql_normal(c: str) -> str:
    plain = f"regexp_replace(lower(translate({sql_preamble(c)}, '{BN}', '{EN}')), '{PUNCT}', ' ', 'g')"
    return sql_strip(f"regexp_replace({plain}, '{WS}+', ' ', 'g')")


def sql_stem(t: str) -> str:
    short = f"regexp_replace({t}, '{text.SUFFIXES}', '')"
    return f"CASE WHEN length({t}) > 5 AND length({short}) >= 3 THEN {short} ELSE {t} END"


def sql_expand(c: str) -> str:
    plain = sql_strip(f"regexp_replace(translate({c}, '{BN}', '{EN}'), '(?i){text.QUESTION_OPENING}{WS}+', '')")
    return f"CASE WHEN {plain} <> {c} THEN {c} || ' ' || {plain} ELSE {c} END"


def sql_f1(p: str, g: str) -> str:
    n = f"coalesce(list_sum(list_transform(list_intersect({p}, {g}), lambda t: least(len(list_filter({p}, lambda x: x = t)), len(list_filter({g}, lambda y: y = t))))), 0)"
    return f"CASE WHEN {n} > 0 THEN 2.0 * {n} / (len({p}) + len({g})) ELSE 0.0 END"


SQL_PAIRS = "(SELECT * FROM nctb_qa QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY loaded_at DESC) = 1)"
SQL_CHUNKS = "(SELECT DISTINCT ON (chunk_id) * FROM chunks)"
SQL_PREDICTIONS = "(SELECT DISTINCT * FROM predictions)"


# Scalars


@query(
    f"SELECT pair_id, {sql_normal('answer')} AS normal, {sql_preamble('answer')} AS bare FROM {SQL_PAIRS} WHERE answer IS NOT NULL"
)
def normalize_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Normal form of each answer, and the answer without its preamble."""
    c = F.col("answer")
    return pairs(spark, folder).where(c.isNotNull()).select("pair_id", text.normal_form(c).alias("normal"), text.strip_preamble(c).alias("bare"))


@query(f"SELECT pair_id, {sql_expand('question')} AS expanded FROM {SQL_PAIRS}")
def expand_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions expanded for lexical search."""
    return pairs(spark, folder).select("pair_id", text.expand_query(F.col("question")).alias("expanded"))


@query(
    f"""SELECT stem, count(*) AS n, count(DISTINCT chunk_id) AS chunks FROM (
    SELECT chunk_id, {sql_stem('t')} AS stem FROM (SELECT chunk_id, unnest({sql_tokens('text')}) AS t FROM {SQL_CHUNKS})) GROUP BY stem"""
)
def stem_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each stem occurs, and in how many chunks."""
    t = chunks(spark, folder).select("chunk_id", F.explode(text.stemmed_tokens(F.col("text"))).alias("stem"))
    in_chunk = t.groupBy("stem", "chunk_id").agg(F.count("*").alias("n"))
    return in_chunk.groupBy("stem").agg(F.sum("n").alias("n"), F.count("*").alias("chunks"))


@query(
    f"""SELECT DISTINCT filename, regexp_extract(filename, '(?i){text.FILENAME}', 1) AS subject, lower(regexp_extract(filename, '(?i){text.FILENAME}', 2)) AS lang,
    CASE lower(regexp_extract(filename, '(?i){text.FILENAME}', 2)) WHEN 'ben' THEN 'bn' ELSE 'en' END AS lang_code, CAST(regexp_extract(filename, '(?i){text.FILENAME}', 3) AS INT) AS class_num,
    'class' || CAST(regexp_extract(filename, '(?i){text.FILENAME}', 3) AS INT) || '_' || CASE lower(regexp_extract(filename, '(?i){text.FILENAME}', 2)) WHEN 'ben' THEN 'bn' ELSE 'en' END AS folder_key
    FROM source_files WHERE regexp_matches(filename, '(?i){text.FILENAME}')"""
)
def parse_filenames(spark: SparkSession, folder: str) -> DataFrame:
    """What the names of the books say; names that do not fit are skipped."""
    return files.with_parsed_name(table(spark, folder, "source_files").select("filename").distinct())


@query(
    f"""SELECT chunk_id, 'chunk_' || lpad(CAST(chunk_id AS VARCHAR), 6, '0') AS id, 'passage: ' || text AS document, substring(text, 1, 200) AS preview,
    CASE subject WHEN 'ICT' THEN 'ict' WHEN 'Science' THEN 'science' ELSE lower(subject) END AS subject_code,
    CASE WHEN class_num BETWEEN 6 AND 8 THEN 'junior_sec' WHEN class_num IN (9, 10) THEN 'ssc' ELSE 'unknown' END AS grade_band,
    CASE lang_code WHEN 'bn' THEN 'bengali' ELSE 'latin' END AS script FROM {SQL_CHUNKS}"""
)
def vector_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the vector index without their vectors: id, prefixed document, preview, looked-up metadata."""
    return chunks(spark, folder).select(
        "chunk_id", text.chunk_key(F.col("chunk_id")).alias("id"), F.concat(F.lit(text.PASSAGE_PREFIX), "text").alias("document"), F.substring("text", 1, 200).alias("preview"),
        text.subject_code(F.col("subject")).alias("subject_code"), text.grade_band(F.col("class_num")).alias("grade_band"), text.script(F.col("lang_code")).alias("script"),
    )


@query(f"SELECT pair_id, md5(question) AS question_md5, md5(coalesce(answer, '')) AS answer_md5, split, source, loaded_at FROM {SQL_PAIRS}")
def latest_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs after keeping the last delivery of each."""
    digests = (F.md5("question").alias("question_md5"), F.md5(F.coalesce("answer", F.lit(""))).alias("answer_md5"))
    return pairs(spark, folder).select("pair_id", *digests, "split", "source", "loaded_at")


# Sources and chunks


@query(
    "SELECT dimension, value, count(*) AS n FROM (SELECT DISTINCT * FROM source_files) s, LATERAL (VALUES ('extraction_method', extraction_method), ('status', status), ('lang_code', lang_code)) v(dimension, value) GROUP BY ALL"
)
def source_audit_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Files by method, status and language, in one pass."""
    return evaluation.grouping_counts(table(spark, folder, "source_files").distinct(), ["extraction_method", "status", "lang_code"])


SQL_WINDOWS = """
WITH RECURSIVE pages AS (SELECT doc_id, {strip} AS page FROM documents WHERE text IS NOT NULL),
w(doc_id, page, pos, start, len, chunk) AS (
  SELECT doc_id, page, -1, 0, 0, '' FROM pages WHERE length(page) > 0
  UNION ALL
  SELECT doc_id, page, pos + 1, nxt, cut, substring(page, nxt + 1, cut)
  FROM (SELECT doc_id, page, pos, nxt, CASE WHEN nxt + 1000 >= length(page) THEN length(page) - nxt
      WHEN a > 500 THEN a + 1 WHEN b > 500 THEN b + 1 WHEN c > 500 THEN c + 1 WHEN d > 500 THEN d + 1 WHEN e > 500 THEN e + 1 ELSE 1000 END AS cut
    FROM (SELECT doc_id, page, pos, nxt, {last} FROM (
      SELECT doc_id, page, pos, CASE WHEN pos < 0 THEN 0 ELSE start + greatest(len - 200, 500) END AS nxt FROM w) x
      WHERE nxt < length(page)) y) z)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS chunk_pos, CAST(start AS INT) AS start, text, CAST(length(text) AS INT) AS char_count
FROM (SELECT doc_id, pos, start, {strip_chunk} AS text FROM w WHERE pos >= 0) WHERE length(text) > 50
"""
_LAST = ", ".join(
    f"length(regexp_extract(substring(page, nxt + 1, 1000), '(?s)^(.*)[{mark}]', 1)) AS {name}" for mark, name in (("।", "a"), (".", "b"), ("?", "c"), ("!", "d"), ("\\n", "e"))
)


@query(SQL_WINDOWS.format(strip=sql_strip("text"), strip_chunk=sql_strip("chunk"), last=_LAST))
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents cut into overlapping chunks at sentence ends."""
    return chunking.split_pages(table(spark, folder, "documents"), "doc_id")


@query(
    "SELECT chunk_id, CAST(row_number() OVER (ORDER BY source, page_num NULLS FIRST, chunk_pos, chunk_id) - 1 AS BIGINT) AS position FROM " + SQL_CHUNKS
)
def number_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive numbers over all chunks in the order of books, pages and places."""
    rows = chunks(spark, folder).select("source", "page_num", "chunk_pos", "chunk_id")
    return chunking.number_rows(rows, ["source", "page_num", "chunk_pos", "chunk_id"], "position").select("chunk_id", "position")


@query(
    f"""SELECT language, class_num, grade_band, count(*) AS n, round(avg(char_count), 6) AS mean_chars, min(char_count) AS least, max(char_count) AS most
    FROM {SQL_CHUNKS} GROUP BY GROUPING SETS ((language), (class_num), (grade_band), ())"""
)
def chunk_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Number and length of chunks by language, class and grade, and over all."""
    sets = [[F.col("language")], [F.col("class_num")], [F.col("grade_band")], []]
    return rounded(
        chunks(spark, folder)
        .groupingSets(sets, "language", "class_num", "grade_band")
        .agg(F.count("*").alias("n"), F.avg("char_count").alias("mean_chars"), F.min("char_count").alias("least"), F.max("char_count").alias("most"))
    )


@query(
    f"""SELECT language, bin, count(*) AS n FROM (SELECT language, CAST(least(greatest(floor(char_count / 40.0), 0), 39) AS BIGINT) AS bin FROM {SQL_CHUNKS}) GROUP BY language, bin"""
)
def chunk_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Histogram of chunk lengths by language, forty bins of forty characters."""
    place = F.least(F.greatest(F.floor(F.col("char_count") / 40.0), F.lit(0)), F.lit(39)).cast("bigint")
    return chunks(spark, folder).groupBy("language", place.alias("bin")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT source, count(*) AS pages, count(CASE WHEN n > 20 THEN 1 END) AS with_text, round(sum(n) / greatest(count(*), 1), 6) AS mean_chars
    FROM (SELECT source, length({sql_strip('text')}) AS n FROM documents WHERE text IS NOT NULL) GROUP BY source"""
)
def page_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of each source, those with more than twenty characters, and their mean length."""
    n = table(spark, folder, "documents").where("text is not null").select("source", F.char_length(text.strip(F.col("text"))).alias("n"))
    return rounded(n.groupBy("source").agg(F.count("*").alias("pages"), F.count_if(F.col("n") > 20).alias("with_text"), F.avg("n").alias("mean_chars")))


# Retrieval


SQL_BM25 = f"""
WITH docs AS (SELECT chunk_id AS doc_id, list_transform({sql_tokens('text')}, lambda t: {sql_stem('t')}) AS words FROM (SELECT chunk_id, min(text) AS text FROM chunks GROUP BY 1)),
lens AS (SELECT doc_id, len(words) AS length FROM docs), st AS (SELECT count(*) AS n, avg(length) AS m FROM lens),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM docs) GROUP BY ALL),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT pair_id AS query_id, min(question) AS question, min(chunk_id) AS gold FROM nctb_qa WHERE pair_id % {EVERY} = 0 GROUP BY 1),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, {sql_stem('t')} AS term FROM (SELECT query_id, unnest({sql_tokens(sql_expand('question'))}) AS t FROM q)) GROUP BY ALL),
hits AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / m))) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN lens USING (doc_id), st GROUP BY ALL),
every AS (SELECT query_id, doc_id AS chunk_id, coalesce(score, 0.0) AS score FROM q CROSS JOIN lens LEFT JOIN hits USING (query_id, doc_id)),
ranking AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM every QUALIFY rank <= 10)
"""


def bm25(spark: SparkSession, folder: str, k: int = 10) -> DataFrame:
    index = lexical.build_index(table(spark, folder, "chunks"), "chunk_id")
    return lexical.bm25_top(index, questions(spark, folder), "pair_id", "question", k)


@query(SQL_BM25 + "SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ranking")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best chunks of each question of the query set, by BM25."""
    return rounded(bm25(spark, folder))


@query(
    SQL_BM25
    + "SELECT query_id, chunk_id, round(score / greatest(max(score) OVER (PARTITION BY query_id), 1e-9), 6) AS score, CAST(rank AS INT) AS rank FROM ranking"
)
def bm25_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """The same with scores by the best one of the question."""
    return rounded(lexical.normalised(bm25(spark, folder)))


@query(
    SQL_BM25
    + """SELECT count(*) AS questions, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN best <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_3,
    round(avg(CASE WHEN best <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10
    FROM (SELECT q.query_id, min(rank) AS best FROM q LEFT JOIN ranking r ON r.query_id = q.query_id AND r.chunk_id = q.gold WHERE gold IS NOT NULL GROUP BY 1)"""
)
def bm25_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of the gold chunk by BM25 over the questions that name one."""
    gold = questions(spark, folder).where("gold_chunk_id is not null")
    hits = bm25(spark, folder).select(F.col("query_id").alias("pair_id"), F.col("chunk_id").alias("gold_chunk_id"), "rank")
    joined = gold.join(hits, ["pair_id", "gold_chunk_id"], "left")
    at = {f"recall_at_{k}": metrics.mean(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)) for k in (1, 3, 10)}
    return rounded(joined.agg(F.count("*").alias("questions"), *(c.alias(n) for n, c in at.items())))


def embedded(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


SQL_DENSE = f"""
WITH every AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) AS score
  FROM embeddings q CROSS JOIN embeddings d WHERE q.vec_id % {EVERY} = 0),
ranking AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM every QUALIFY rank <= 10)
"""


def dense_ranking(spark: SparkSession, folder: str, k: int = 10) -> DataFrame:
    rows = embedded(spark, folder)
    return dense.dense_top(rows.where(F.col("id") % EVERY == 0), rows, k)


@query(SQL_DENSE + "SELECT query_id, chunk_id, round(score, 5) AS score, CAST(rank AS INT) AS rank FROM ranking")
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of each vector of the query set, exactly."""
    return rounded(dense_ranking(spark, folder), 5)


@query("SELECT count(*) AS questions, true AS reached FROM embeddings WHERE vec_id % 20 = 0")
def dense_inverted_file_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the inverted file finds nine of ten of the exact nearest vectors, over the whole query set."""
    rows = embedded(spark, folder)
    asked = rows.where(F.col("id") % EVERY == 0)
    exact = dense.dense_top(asked, rows).select("query_id", "chunk_id")
    found = dense.inverted_file_top(asked, rows).select("query_id", "chunk_id").withColumn("found", F.lit(1))
    both = exact.join(found, ["query_id", "chunk_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("questions"), (F.sum(F.coalesce("found", F.lit(0))) >= 0.9 * F.count("*")).alias("reached"))


@query()
def dense_topk_inverted_file(spark: SparkSession, folder: str) -> DataFrame:
    """The same by an inverted file that indexes every row."""
    rows = embedded(spark, folder)
    return rounded(dense.inverted_file_top(rows.where(F.col("id") % EVERY == 0), rows), 5)


SQL_RANKS = "(SELECT query_id, chunk_id, min(rank) AS r FROM rankings WHERE retriever = '{0}' GROUP BY 1, 2)"


def two_rankings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The rankings that are not lexical, and the lexical ones."""
    r = table(spark, folder, "rankings").distinct()
    return r.where("retriever <> 'bm25'"), r.where("retriever = 'bm25'")


@query(
    """WITH d AS (SELECT query_id, chunk_id, min(rank) AS r FROM rankings WHERE retriever <> 'bm25' GROUP BY 1, 2), b AS (SELECT query_id, chunk_id, min(rank) AS r FROM rankings WHERE retriever = 'bm25' GROUP BY 1, 2),
    f AS (SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.chunk_id, b.chunk_id) AS chunk_id, coalesce(0.7 / (60 + d.r), 0) + coalesce(0.3 / (60 + b.r), 0) AS score
      FROM d FULL OUTER JOIN b ON d.query_id = b.query_id AND d.chunk_id = b.chunk_id)
    SELECT query_id, chunk_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS INT) AS rank FROM f QUALIFY rank <= 10"""
)
def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted reciprocal rank fusion of the two rankings."""
    return rounded(fusion.reciprocal_rank_fusion(*two_rankings(spark, folder)), 9)


def overlap_reranked(spark: SparkSession, folder: str) -> DataFrame:
    """All ranked chunks with a stand-in reranker: ten times the overlap of question and chunk, less five."""
    both = table(spark, folder, "rankings").select("query_id", "chunk_id").distinct()
    q = pairs(spark, folder).select(F.col("pair_id").alias("query_id"), "question")
    joined = both.join(q, "query_id").join(chunks(spark, folder).select("chunk_id", "text"), "chunk_id")
    return joined.withColumn("rerank_score", 10.0 * validation.overlap(F.col("question"), F.col("text")) - 5.0)


SQL_RERANKED = f"""
WITH rr AS (SELECT r.query_id, r.chunk_id, 10.0 * CASE WHEN len(a) > 0 AND len(s) > 0 THEN len(list_filter(a, lambda x: list_contains(s, x))) / len(a) ELSE 0.0 END - 5.0 AS rerank_score
  FROM (SELECT DISTINCT query_id, chunk_id FROM rankings) r JOIN (SELECT pair_id, {sql_tokens('question')} AS a FROM {SQL_PAIRS}) q ON q.pair_id = r.query_id
  JOIN (SELECT chunk_id, {sql_tokens('text')} AS s FROM {SQL_CHUNKS}) c ON c.chunk_id = r.chunk_id),
d AS (SELECT query_id, chunk_id, max(score) AS s FROM rankings WHERE retriever <> 'bm25' GROUP BY 1, 2),
b AS (SELECT query_id, chunk_id, max(score / greatest(m, 1e-9)) AS s FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM rankings WHERE retriever = 'bm25') GROUP BY 1, 2),
fused AS (SELECT query_id, chunk_id, 0.5 / (1 + exp(-rerank_score / 5)) + 0.3 * greatest(0, least(1, coalesce(d.s, 0))) + 0.2 * coalesce(b.s, 0) AS score
  FROM rr LEFT JOIN d USING (query_id, chunk_id) LEFT JOIN b USING (query_id, chunk_id))
"""


@query(
    SQL_RERANKED
    + "SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS INT) AS rank FROM fused QUALIFY rank <= 10"
)
def fused_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """Two-stage ranking: reranked, fused with dense and lexical scores."""
    d, b = two_rankings(spark, folder)
    return rounded(fusion.two_stage(overlap_reranked(spark, folder), d, lexical.normalised(b)))


SQL_MMR = (
    SQL_DENSE.replace("rank <= 10", "rank <= 15").replace("\nWITH every", "\nWITH RECURSIVE every")
    + """, c AS MATERIALIZED (SELECT r.query_id, r.chunk_id, r.score, CAST(r.rank AS INT) AS place, CAST(e.embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) AS len
      FROM ranking r JOIN embeddings e ON e.vec_id = r.chunk_id),
    near AS MATERIALIZED (SELECT x.query_id, x.place, y.place AS other, list_dot_product(x.v, y.v) / (x.len * y.len + 1e-9) AS cosine FROM c x JOIN c y USING (query_id)),
    pick(query_id, step, chosen, last) AS (
      SELECT query_id, 1, [place], place FROM c WHERE place = 1
      UNION ALL
      SELECT query_id, step + 1, list_append(chosen, place), place FROM (
        SELECT p.query_id, p.step, p.chosen, c.place, 0.6 * c.score - 0.4 * max(n.cosine) AS value
        FROM pick p JOIN c ON c.query_id = p.query_id AND NOT list_contains(p.chosen, c.place) JOIN near n ON n.query_id = p.query_id AND n.place = c.place AND list_contains(p.chosen, n.other)
        WHERE p.step < 10 GROUP BY p.query_id, p.step, p.chosen, c.place, c.score) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(value, 9) DESC, place) = 1)
    SELECT p.query_id, c.chunk_id, round(c.score, 5) AS relevance, CAST(p.step AS INT) AS rank FROM pick p JOIN c ON c.query_id = p.query_id AND c.place = p.last"""
)


@query(SQL_MMR)
def mmr_select(spark: SparkSession, folder: str) -> DataFrame:
    """Ten diversified neighbours out of the fifteen nearest."""
    rows = embedded(spark, folder).withColumnRenamed("id", "chunk_id")
    return rounded(fusion.maximal_marginal_relevance(dense_ranking(spark, folder, 15).join(rows, "chunk_id")), 5)


@query(
    f"""SELECT query_id, parent_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first, parent_id) AS INT) AS rank FROM
    (SELECT query_id, source AS parent_id, min(rank) AS first FROM (SELECT DISTINCT query_id, chunk_id, rank FROM rankings WHERE retriever = 'bm25') r JOIN {SQL_CHUNKS} c USING (chunk_id) GROUP BY 1, 2)"""
)
def parent_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Books of the ranked chunks, each at the place of its first chunk."""
    parents = chunks(spark, folder).select("chunk_id", F.col("source").alias("parent_id"))
    return fusion.roll_up(two_rankings(spark, folder)[1], parents)


@query(
    f"""SELECT retriever, count(*) AS ranked, round(avg(hit), 6) AS recall_at_5, round(avg(mrr), 6) AS mean_reciprocal_rank FROM (
    SELECT r.retriever, r.query_id, max(CASE WHEN r.chunk_id = p.chunk_id THEN 1.0 ELSE 0.0 END) AS hit, max(CASE WHEN r.chunk_id = p.chunk_id THEN 1.0 / r.rank ELSE 0.0 END) AS mrr
    FROM (SELECT DISTINCT * FROM rankings) r JOIN {SQL_PAIRS} p ON p.pair_id = r.query_id WHERE p.chunk_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""
)
def ranking_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall and mean reciprocal rank of each retriever."""
    gold = pairs(spark, folder).where("chunk_id is not null").select(F.col("pair_id").alias("query_id"), F.col("chunk_id").alias("gold"))
    hit = F.col("chunk_id") == F.col("gold")
    per = (
        table(spark, folder, "rankings").distinct().join(gold, "query_id").groupBy("retriever", "query_id")
        .agg(F.max(F.when(hit, 1.0).otherwise(0.0)).alias("hit"), F.max(F.when(hit, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"))
    )
    return rounded(per.groupBy("retriever").agg(F.count("*").alias("ranked"), F.avg("hit").alias("recall_at_5"), F.avg("mrr").alias("mean_reciprocal_rank")))


# Validation


def sql_greedy(ids: str, least: float) -> str:
    """CTEs that fold the similar pairs of (id, question), in order, into the list of dropped ids; the last row of ``scan`` has all."""
    return f"""ids AS ({ids}), tf AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest({sql_tokens('question')}) AS w FROM ids) GROUP BY ALL), len2 AS (SELECT id, sum(n * n) AS s FROM tf GROUP BY 1),
    dots AS (SELECT a.id AS a, b.id AS b, sum(a.n * b.n) AS d FROM tf a JOIN tf b ON a.w = b.w AND a.id < b.id GROUP BY ALL),
    alike AS (SELECT a, b, row_number() OVER (ORDER BY a, b) AS i FROM dots JOIN len2 x ON x.id = a JOIN len2 y ON y.id = b WHERE d / sqrt(x.s::DOUBLE) / sqrt(y.s::DOUBLE) >= {least} - 1e-12),
    scan(i, dropped) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
      SELECT e.i, CASE WHEN list_contains(s.dropped, e.a) OR list_contains(s.dropped, e.b) THEN s.dropped ELSE list_append(s.dropped, e.b) END FROM scan s JOIN alike e ON e.i = s.i + 1),
    gone AS (SELECT unnest(dropped) AS id FROM (SELECT dropped FROM scan ORDER BY i DESC LIMIT 1))"""


SQL_QUESTIONS = "SELECT pair_id AS id, min(question) AS question FROM nctb_qa WHERE pair_id IS NOT NULL GROUP BY 1"


SQL_SIGNALS = f"""
WITH p AS (SELECT *, coalesce(answer, '') AS a0, coalesce(source_text, '') AS s0, {sql_strip("coalesce(question, '')")} AS q, {sql_strip("coalesce(answer, '')")} AS a, {sql_strip("coalesce(evidence, '')")} AS e FROM {SQL_PAIRS}),
t AS (SELECT *, {sql_tokens('a0')} AS aw, {sql_tokens('s0')} AS sw,
  length(regexp_replace(coalesce(question, '') || ' ' || a0, '[^ঀ-৿]', '', 'g')) AS nb, length(regexp_replace(coalesce(question, '') || ' ' || a0, '[^A-Za-z]', '', 'g')) AS nl FROM p),
sig AS (SELECT pair_id, language, chunk_id, CASE WHEN len(aw) > 0 AND len(sw) > 0 THEN len(list_filter(aw, lambda x: list_contains(sw, x))) / len(aw) ELSE 0.0 END AS overlap,
  CASE WHEN nb + nl = 0 THEN NULL WHEN nb > nl THEN 'bn' ELSE 'en' END AS detected_lang,
  CASE WHEN length(q) < 10 THEN 'question_too_short' WHEN length(a) < 5 THEN 'answer_too_short' WHEN e = '' THEN 'missing_evidence' WHEN lower(q) = lower(a) THEN 'question_equals_answer'
    WHEN NOT (q LIKE '%?' OR q LIKE '%।' OR len(list_intersect({sql_tokens('q')}, [{', '.join(f"'{w}'" for w in validation.QUESTION_WORDS)}])) > 0) THEN 'not_a_question' ELSE 'ok' END AS structure_reason FROM t),
flags AS (SELECT *, overlap >= 0.25 AS s3, coalesce(detected_lang = coalesce(language, 'en'), false) AS s4, structure_reason = 'ok' AS s5 FROM sig)
"""


@query(SQL_SIGNALS + "SELECT pair_id, round(overlap, 6) AS overlap, detected_lang, structure_reason, s3, s4, s5 FROM flags")
def pair_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap, language and structure signals of each pair."""
    out = validation.signals(pairs(spark, folder))
    return rounded(out.select("pair_id", "overlap", "detected_lang", "structure_reason", "s3", "s4", "s5"))


def flagged_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Signals of the pairs; verifiers are not at hand offline and let a pair pass that has evidence."""
    out = validation.signals(pairs(spark, folder))
    out = validation.round_trip(out, table(spark, folder, "rankings"))
    verified = F.coalesce("evidence", F.lit("")) != ""
    return out.withColumns({"s2": verified, "s6": verified})


@query(
    f"""WITH hits AS (SELECT DISTINCT query_id, chunk_id FROM rankings WHERE rank <= 3)
    SELECT p.pair_id, h.query_id IS NOT NULL AS s1 FROM {SQL_PAIRS} p LEFT JOIN hits h ON h.query_id = p.pair_id AND h.chunk_id = p.chunk_id WHERE p.pair_id IN (SELECT query_id FROM rankings)"""
)
def round_trip_signal(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a pair's own chunk is among the first three retrieved, for the pairs that were searched."""
    r = table(spark, folder, "rankings")
    asked = pairs(spark, folder).join(r.select(F.col("query_id").alias("pair_id")).distinct(), "pair_id", "left_semi")
    return validation.round_trip(asked, r).select("pair_id", "s1")


@query(
    SQL_SIGNALS
    + f""", hits AS (SELECT DISTINCT query_id, chunk_id FROM rankings WHERE rank <= 3),
    f AS (SELECT fl.s3 AND fl.s4 AND fl.s5 AS a, coalesce(p.evidence, '') <> '' AS s2, h.query_id IS NOT NULL AS s1 FROM flags fl JOIN {SQL_PAIRS} p USING (pair_id)
      LEFT JOIN hits h ON h.query_id = p.pair_id AND h.chunk_id = p.chunk_id),
    n AS (SELECT count(*) AS total_raw, count(*) FILTER (a) AS after_s3_s4_s5, count(*) FILTER (a AND s2) AS after_s2, count(*) FILTER (a AND s2 AND s1) AS after_s1 FROM f)
    SELECT *, after_s1 AS after_s6, after_s1 AS after_dedup, least(200, after_s1) AS gold_test_set_size, round(after_s1 / total_raw, 6) AS cmar, CASE WHEN after_s1 > 0 THEN 1.0 ELSE 0.0 END AS cmar_of_verified,
      0.8 AS cmar_target, after_s1 / total_raw >= 0.8 AS cmar_met, round(1 - after_s1 / total_raw, 6) AS rejection_rate FROM n"""
)
def validation_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """How many pairs each signal lets pass, and both acceptance ratios, before greedy elimination as its SQL says."""
    return rounded(validation.funnel(flagged_pairs(spark, folder)))


@query(
    SQL_SIGNALS.replace("\nWITH p AS", "\nWITH RECURSIVE p AS")
    + f""", hits AS (SELECT DISTINCT query_id, chunk_id FROM rankings WHERE rank <= 3),
    f AS (SELECT p.pair_id, p.question, fl.s3 AND fl.s4 AND fl.s5 AS a, coalesce(p.evidence, '') <> '' AS s2, h.query_id IS NOT NULL AS s1 FROM flags fl JOIN {SQL_PAIRS} p USING (pair_id)
      LEFT JOIN hits h ON h.query_id = p.pair_id AND h.chunk_id = p.chunk_id),
    {sql_greedy("SELECT pair_id AS id, question FROM f WHERE a AND s2 AND s1", 0.97)},
    n AS (SELECT count(*) AS total_raw, count(*) FILTER (a) AS after_s3_s4_s5, count(*) FILTER (a AND s2) AS after_s2, count(*) FILTER (a AND s2 AND s1) AS after_s1,
      count(*) FILTER (a AND s2 AND s1 AND pair_id NOT IN (SELECT id FROM gone)) AS after_dedup FROM f)
    SELECT * EXCLUDE (after_dedup), after_s1 AS after_s6, after_dedup, least(200, after_dedup) AS gold_test_set_size, round(after_dedup / total_raw, 6) AS cmar, round(coalesce(after_dedup / nullif(after_s1, 0), 0.0), 6) AS cmar_of_verified,
      0.8 AS cmar_target, after_dedup / total_raw >= 0.8 AS cmar_met, round(1 - after_dedup / total_raw, 6) AS rejection_rate FROM n"""
)
def validation_funnel_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """The whole funnel: greedy elimination at cosine 0.97 of question words among the pairs that the last signal lets pass."""
    return rounded(validation.funnel(*validation.deduplicated(flagged_pairs(spark, folder))))


@query(f"WITH RECURSIVE {sql_greedy(SQL_QUESTIONS, 0.97)} SELECT id AS pair_id, id NOT IN (SELECT id FROM gone) AS kept FROM ids")
def greedy_dedup_097(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that greedy elimination keeps at cosine 0.97 of question words."""
    return dedup.greedy_dedup(table(spark, folder, "nctb_qa"), "pair_id", "question", 0.97)


@query(f"WITH RECURSIVE {sql_greedy(SQL_QUESTIONS, 0.90)} SELECT id AS pair_id, id NOT IN (SELECT id FROM gone) AS kept FROM ids")
def greedy_dedup_090(spark: SparkSession, folder: str) -> DataFrame:
    """The same at 0.9, where chains of similar pairs are longer."""
    return dedup.greedy_dedup(table(spark, folder, "nctb_qa"), "pair_id", "question", 0.90)


@query(f"SELECT chunk_id, source FROM {SQL_CHUNKS} WHERE chunk_id NOT IN (SELECT chunk_id FROM nctb_qa WHERE chunk_id IS NOT NULL)")
def chunks_without_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that generation has not done yet."""
    return sampling.not_done(chunks(spark, folder), table(spark, folder, "nctb_qa"), "chunk_id").select("chunk_id", "source")


# Sampling


SQL_ALLOCATION = f"""
WITH c AS {SQL_CHUNKS}, z AS (SELECT subject_code, language, class_num, count(*) AS size FROM c GROUP BY ALL), tot AS (SELECT (SELECT count(*) FROM c) AS n),
w AS (SELECT z.*, n, CAST(floor(n / 4) AS BIGINT) AS total, least(size, greatest(1, CAST(round_even(floor(n / 4) * ln(1 + size) / sum(ln(1 + size)) OVER (), 0) AS BIGINT))) AS wanted FROM z, tot),
a AS (SELECT subject_code, language, class_num, size, CASE WHEN n <= total THEN size ELSE greatest(0, least(wanted, total - coalesce(sum(wanted) OVER (
  ORDER BY subject_code NULLS FIRST, language NULLS FIRST, class_num NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END AS allocation FROM w)
"""
STRATA = ["subject_code", "language", "class_num"]


def quarter(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    rows = chunks(spark, folder)
    return rows, rows.count() // 4


@query(SQL_ALLOCATION + "SELECT subject_code, language, class_num, CAST(size AS BIGINT) AS size, CAST(allocation AS BIGINT) AS allocation FROM a")
def stratified_allocation(spark: SparkSession, folder: str) -> DataFrame:
    """How many of a quarter of the chunks each stratum gives, by logarithmic weights."""
    rows, total = quarter(spark, folder)
    return sampling.log_allocation(rows, STRATA, total)


@query(
    SQL_ALLOCATION
    + """SELECT chunk_id FROM (SELECT c.chunk_id, a.allocation, row_number() OVER (PARTITION BY c.subject_code, c.language, c.class_num ORDER BY o % 256, o, c.chunk_id) AS place
    FROM (SELECT *, (chunk_id * 7919 + 104729) % 1000003 AS o FROM c) c JOIN a ON a.subject_code IS NOT DISTINCT FROM c.subject_code AND a.language IS NOT DISTINCT FROM c.language AND a.class_num IS NOT DISTINCT FROM c.class_num)
    WHERE place <= allocation"""
)
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of that sample."""
    rows, total = quarter(spark, folder)
    return sampling.stratified_sample(rows, "chunk_id", STRATA, total, sampling.arithmetic_order(F.col("chunk_id"))).select("chunk_id")


@query(
    f"""WITH o AS (SELECT pair_id, (pair_id * 7919 + 104729) % 1000003 AS o FROM (SELECT DISTINCT pair_id FROM nctb_qa)), g AS (SELECT pair_id FROM o ORDER BY o, pair_id LIMIT 200)
    SELECT pair_id, pair_id IN (SELECT pair_id FROM g) AS gold FROM o"""
)
def gold_and_train(spark: SparkSession, folder: str) -> DataFrame:
    """Gold sample of two hundred pairs, and what it leaves for training."""
    ids = table(spark, folder, "nctb_qa").select("pair_id").distinct()
    gold = sampling.gold_sample(ids, "pair_id", order=sampling.arithmetic_order(F.col("pair_id")))
    return gold.withColumn("gold", F.lit(True)).unionByName(sampling.training_rest(ids, gold, "pair_id").withColumn("gold", F.lit(False)))


@query(f"SELECT chunk_id, day FROM (SELECT chunk_id, CAST(floor(chunk_id / 100) + 1 AS INT) AS day FROM {SQL_CHUNKS}) WHERE day IN (1, 3)")
def day_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the first and the third day at a hundred a day."""
    rows = chunks(spark, folder)
    days = (sampling.day_slice(rows, "chunk_id", day, 100).select("chunk_id", F.lit(day).alias("day")) for day in (1, 3))
    return next(days).unionByName(next(days))


# Generation


@query(
    f"SELECT pair_id, question, coalesce(answer, '') AS answer, coalesce(evidence, '') AS evidence FROM {SQL_PAIRS}"
)
def parse_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Responses of a model, here written from the pairs with and without a fence, parsed again."""
    p = pairs(spark, folder)
    listed = F.when(F.col("pair_id") % 3 == 0, F.to_json(F.array(F.struct("question", F.coalesce("answer", F.lit("")).alias("answer"), F.array(F.coalesce("evidence", F.lit(""))).alias("evidence")))))
    plain = F.to_json(F.array(F.struct("question", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("evidence", F.lit("")).alias("evidence"))))
    body = F.coalesce(listed, plain)
    response = F.when(F.col("pair_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return p.select("pair_id", F.explode(generation.parse_pairs(response)).alias("x")).select("pair_id", "x.*")


@query(
    f"""SELECT chunk_id, CASE WHEN language = 'bn' THEN {len(generation.QA_PROMPT_BN) - 8} ELSE {len(generation.QA_PROMPT_EN) - 8} END
    + length(coalesce(class_num::VARCHAR, '')) + length(coalesce(subject, '')) + 1 + length(coalesce(text, '')) AS prompt_chars FROM {SQL_CHUNKS}"""
)
def prompt_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Length of the generation prompt of each chunk."""
    p = generation.qa_prompt(F.col("language"), F.col("subject"), F.col("class_num"), F.col("text"))
    return chunks(spark, folder).select("chunk_id", F.char_length(p).cast("bigint").alias("prompt_chars"))


# Evaluation


@query(
    f"""SELECT config_id, pair_id, CASE WHEN coalesce(predicted, '') <> '' AND coalesce(gold_answer, '') <> '' AND {sql_normal('predicted')} = {sql_normal('gold_answer')} THEN 1.0 ELSE 0.0 END AS em,
    round({sql_f1('p', 'g')}, 6) AS token_f1 FROM (SELECT *, {sql_tokens(sql_normal("coalesce(predicted, '')"))} AS p, {sql_tokens(sql_normal("coalesce(gold_answer, '')"))} AS g FROM {SQL_PREDICTIONS})"""
)
def answer_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Exact match and token F1 of each prediction, computed anew."""
    p, g = F.col("predicted"), F.col("gold_answer")
    return rounded(predictions(spark, folder).select("config_id", "pair_id", metrics.exact_match(p, g).alias("em"), metrics.token_f1(p, g).alias("token_f1")))


SQL_ROUGE = f"""
WITH RECURSIVE t AS (SELECT config_id, pair_id, {sql_tokens(sql_normal("coalesce(predicted, '')"))} AS p, {sql_tokens(sql_normal("coalesce(gold_answer, '')"))} AS g FROM {SQL_PREDICTIONS}),
k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY config_id, pair_id, p, g) AS id, * FROM t),
cells AS (SELECT id, i, list(j ORDER BY j) AS js FROM (SELECT id, i, unnest(range(1, len(g) + 1)) AS j, p[i] AS w, g FROM (SELECT id, unnest(range(1, len(p) + 1)) AS i, p, g FROM k)) WHERE g[j] = w GROUP BY 1, 2),
lis(id, i, ends) AS (
  SELECT id, 0, []::BIGINT[] FROM k
  UNION ALL
  SELECT l.id, l.i + 1, CASE WHEN c.js IS NULL THEN l.ends ELSE list_filter(list_transform(range(1, len(l.ends) + 2), lambda x:
      coalesce(list_min(list_filter(c.js, lambda j: j > coalesce(CASE WHEN x > 1 THEN l.ends[x - 1] ELSE 0 END, 0) AND (x > len(l.ends) OR j < l.ends[x]))), l.ends[x])), lambda e: e IS NOT NULL) END
  FROM lis l JOIN k ON k.id = l.id LEFT JOIN cells c ON c.id = l.id AND c.i = l.i + 1 WHERE l.i < len(k.p)),
lcs AS (SELECT l.id, len(l.ends) AS n FROM lis l JOIN k ON k.id = l.id AND l.i = len(k.p))
SELECT config_id, pair_id, round(CASE WHEN n > 0 THEN 2.0 * n / (len(p) + len(g)) ELSE 0.0 END, 6) AS rouge_l FROM k JOIN lcs USING (id)
"""


@query(SQL_ROUGE)
def rouge_scores(spark: SparkSession, folder: str) -> DataFrame:
    """ROUGE-L of each prediction."""
    return rounded(predictions(spark, folder).select("config_id", "pair_id", metrics.rouge_l(F.col("predicted"), F.col("gold_answer")).alias("rouge_l")))


@query(
    f"SELECT config_id, pair_id, {', '.join(f'CASE WHEN coalesce(list_contains(retrieved_ids[1:{k}], gold_chunk_id), false) THEN 1.0 ELSE 0.0 END AS recall_at_{k}' for k in (1, 3, 5, 10))} FROM {SQL_PREDICTIONS}"
)
def recall_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of each prediction's retrieved ids at four depths."""
    r = {f"recall_at_{k}": metrics.recall_at(F.col("retrieved_ids"), F.col("gold_chunk_id"), k) for k in evaluation.DEPTHS}
    return predictions(spark, folder).select("config_id", "pair_id", *(c.alias(n) for n, c in r.items()))


@query(
    f"""SELECT config_id, pair_id, CASE WHEN o < f - 0.10 AND coalesce(open_answer, '') <> '' THEN 1 ELSE 0 END AS guarded, CASE WHEN o < f - 0.10 THEN 1 ELSE 0 END AS unguarded FROM (
    SELECT config_id, pair_id, open_answer, {sql_f1('p', 'g')} AS f, {sql_f1('op', 'g')} AS o FROM (SELECT *, {sql_tokens(sql_normal("coalesce(predicted, '')"))} AS p, {sql_tokens(sql_normal("coalesce(open_answer, '')"))} AS op,
    {sql_tokens(sql_normal("coalesce(gold_answer, '')"))} AS g FROM {SQL_PREDICTIONS}))"""
)
def grounding_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flag of answers that passages helped, with and without the guard for empty open answers."""
    o, f1 = metrics.token_f1(F.col("open_answer"), F.col("gold_answer")), metrics.token_f1(F.col("predicted"), F.col("gold_answer"))
    flags = {n: metrics.grounding_flag(o, f1, F.col("open_answer"), g) for n, g in (("guarded", True), ("unguarded", False))}
    return predictions(spark, folder).select("config_id", "pair_id", *(c.alias(n) for n, c in flags.items()))


@query(
    f"""WITH p AS (SELECT config_id, pair_id, list_distinct({sql_tokens(sql_normal("coalesce(predicted, '')"))}) AS a, retrieved_ids FROM {SQL_PREDICTIONS}),
    s AS (SELECT config_id, pair_id, list_distinct(flatten(list({sql_tokens(sql_normal("coalesce(c.text, '')"))}))) AS seen FROM (SELECT config_id, pair_id, unnest(retrieved_ids) AS chunk_id FROM p) JOIN {SQL_CHUNKS} c USING (chunk_id) GROUP BY 1, 2)
    SELECT p.config_id, p.pair_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, coalesce(seen, []))) / len(a) ELSE 0.0 END, 6) AS coverage FROM p LEFT JOIN s USING (config_id, pair_id)"""
)
def passage_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Share of an answer's tokens that its retrieved chunks hold."""
    logged = table(spark, folder, "predictions")
    # Distinct within its key, so that it need not move again for the join.
    p = logged.repartition("config_id", "pair_id").distinct().select("config_id", "pair_id", "predicted")
    named = logged.select("config_id", "pair_id", "predicted", F.col("retrieved_ids").alias("ids"))
    # Each chunk is tokenised once, however many answers retrieved it.
    words = chunks(spark, folder).select("chunk_id", F.array_distinct(metrics.answer_tokens(F.col("text"))).alias("words"))
    shown = p.join(evaluation.tokens_seen(named, words), ["config_id", "pair_id"], "left")
    return rounded(shown.select("config_id", "pair_id", metrics.coverage_by(F.col("predicted"), F.col("seen")).alias("coverage")))


def sql_mean(c: str, name: str, where: str = "") -> str:
    return f"round(coalesce(avg({c}) {f'FILTER ({where})' if where else ''}, 0), 6) AS {name}"


MEANS = [sql_mean(f"recall_at_{k}", f"recall_at_{k}") for k in (1, 3, 5, 10)] + [sql_mean("em", "em"), sql_mean("token_f1", "token_f1"), sql_mean("hallucination", "hallucination_rate")]
MASKS = {"bn": "language = 'bn'", "en": "language = 'en'", "junior_sec": "grade_band = 'junior_sec'", "ssc": "grade_band = 'ssc'", "ict": "subject_code = 'ict'", "science": "subject_code = 'science'"}
SQL_SUMMARY = f"""(SELECT c.config_id, retriever, generator, prompt_type, n, {', '.join(m.split(' AS ')[1] for m in MEANS)}, bn_f1, bn_em, en_f1, en_em, junior_sec_f1, ssc_f1 FROM run_configs c JOIN (
  SELECT config_id, count(*) AS n, {', '.join(MEANS)}, {sql_mean('token_f1', 'bn_f1', MASKS['bn'])}, {sql_mean('em', 'bn_em', MASKS['bn'])}, {sql_mean('token_f1', 'en_f1', MASKS['en'])},
  {sql_mean('em', 'en_em', MASKS['en'])}, {sql_mean('token_f1', 'junior_sec_f1', MASKS['junior_sec'])}, {sql_mean('token_f1', 'ssc_f1', MASKS['ssc'])} FROM {SQL_PREDICTIONS} GROUP BY config_id) USING (config_id))"""


def summarised(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.summary(predictions(spark, folder), table(spark, folder, "run_configs"))


@query(f"SELECT * FROM {SQL_SUMMARY}")
def evaluation_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Means of each configuration from the logged metrics."""
    return rounded(summarised(spark, folder))


SQL_SPREAD = "round(coalesce(stddev_samp(token_f1), 0), 6) AS token_f1_std, round(coalesce(1.96 * stddev_samp(token_f1) / sqrt(count(token_f1)), 0), 6) AS token_f1_ci95, round(coalesce(stddev_samp(rouge_l), 0), 6) AS rouge_l_std"


@query(
    f"""SELECT c.config_id, retriever || ' + ' || generator || ' + ' || prompt_type AS "desc", retriever, generator, prompt_type, s.* EXCLUDE (config_id) FROM run_configs c JOIN (SELECT config_id, count(*) AS n, {', '.join(MEANS)},
    {sql_mean('rouge_l', 'rouge_l')}, 0.0 AS bert_score, {SQL_SPREAD}, 0.0 AS bert_score_std, {', '.join(sql_mean('token_f1', f'{k}_f1', w) for k, w in MASKS.items())},
    {', '.join(sql_mean('rouge_l', f'{k}_rouge_l', w) for k, w in MASKS.items())}, {', '.join(f'0.0 AS {k}_bert_score' for k in ('bn', 'en', 'ict', 'science'))},
    {sql_mean('coalesce(retrieval_ms, 0)', 'avg_retrieval_ms')}, {sql_mean('coalesce(generation_ms, 0)', 'avg_generation_ms')} FROM {SQL_PREDICTIONS} GROUP BY config_id) s USING (config_id)"""
)
def evaluation_summary_enhanced(spark: SparkSession, folder: str) -> DataFrame:
    """The wider summary; sentence similarity needs an embedder and is 0 here."""
    return rounded(evaluation.enhanced_summary(predictions(spark, folder), table(spark, folder, "run_configs")))


@query(
    f"SELECT config_id, retriever, generator, prompt_type, v.language, v.token_f1, v.em FROM {SQL_SUMMARY} s, LATERAL (VALUES ('bn', s.bn_f1, s.bn_em), ('en', s.en_f1, s.en_em)) v(language, token_f1, em)"
)
def language_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """The summary by language as rows."""
    return rounded(evaluation.long_breakdown(summarised(spark, folder)))


@query(
    f"SELECT config_id, retriever, generator, prompt_type, v.grade_band, v.token_f1 FROM {SQL_SUMMARY} s, LATERAL (VALUES ('junior_sec', s.junior_sec_f1), ('ssc', s.ssc_f1)) v(grade_band, token_f1)"
)
def grade_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """The summary by grade as rows."""
    return rounded(evaluation.long_grades(summarised(spark, folder)))


@query(f"SELECT config_id, token_f1 FROM {SQL_SUMMARY} ORDER BY token_f1 DESC, config_id LIMIT 1")
def best_configuration(spark: SparkSession, folder: str) -> DataFrame:
    """The configuration with the greatest token F1."""
    return evaluation.best_configuration(rounded(summarised(spark, folder))).select("config_id", "token_f1")


@query(f"SELECT config_id, token_f1 FROM {SQL_SUMMARY} ORDER BY token_f1 DESC, config_id LIMIT 5")
def top_configurations(spark: SparkSession, folder: str) -> DataFrame:
    """The five best configurations, a report."""
    return rounded(summarised(spark, folder)).orderBy(F.col("token_f1").desc(), "config_id").limit(5).select("config_id", "token_f1")


@query(f"SELECT retriever, round(avg(token_f1), 6) AS token_f1 FROM {SQL_SUMMARY} GROUP BY retriever")
def retriever_means(spark: SparkSession, folder: str) -> DataFrame:
    """Mean token F1 of the configurations of each retriever."""
    return rounded(rounded(summarised(spark, folder)).groupBy("retriever").agg(F.avg("token_f1").alias("token_f1")))


@query(
    f"""SELECT config_id, round(en_f1 - bn_f1, 6) AS language_gap FROM {SQL_SUMMARY}"""
)
def language_gap(spark: SparkSession, folder: str) -> DataFrame:
    """How much better English answers score than Bengali ones."""
    return rounded(rounded(summarised(spark, folder)).select("config_id", (F.col("en_f1") - F.col("bn_f1")).alias("language_gap")))


@query(
    f"""SELECT config_id, CASE WHEN config_id >= 10 THEN 'new' ELSE 'stored' END AS origin, CASE WHEN config_id < 10 THEN n END AS n, token_f1 FROM {SQL_SUMMARY}"""
)
def merged_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Stored rows where no new one comes in, and the new rows, which have fewer columns."""
    all_rows = rounded(summarised(spark, folder))
    stored = all_rows.select("config_id", F.lit("stored").alias("origin"), "n", "token_f1")
    new = all_rows.where("config_id >= 10").select("config_id", F.lit("new").alias("origin"), "token_f1")
    return evaluation.merge_summaries(stored, new)


@query(
    f"""SELECT c.config_id, count(*) AS runs, count(*) - count(p.pair_id) AS missing FROM run_configs c CROSS JOIN (SELECT DISTINCT pair_id FROM nctb_qa WHERE split = 'test') t
    LEFT JOIN (SELECT DISTINCT config_id, pair_id FROM predictions) p ON p.config_id = c.config_id AND p.pair_id = t.pair_id GROUP BY 1"""
)
def missing_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of each configuration over the test pairs, and those without a result."""
    tests = table(spark, folder, "nctb_qa").where("split = 'test'").select("pair_id").distinct()
    runs = evaluation.configuration_runs(table(spark, folder, "run_configs").select("config_id"), tests)
    todo = evaluation.missing_runs(runs, table(spark, folder, "predictions")).groupBy("config_id").agg(F.count("*").alias("missing"))
    return runs.groupBy("config_id").agg(F.count("*").alias("runs")).join(todo, "config_id", "left").select("config_id", "runs", F.coalesce("missing", F.lit(0)).alias("missing"))


@query(
    f"SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
)
def neighbour_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Dot product of each vector with the next one."""
    v = table(spark, folder, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rounded(v.join(after, "vec_id").select("vec_id", vectors.dot(F.col("embedding"), F.col("other")).alias("similarity")), 5)
