"""Queries that need models, run with the deterministic stand-ins, and SQL that says the same."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pothi.functions import metrics, text, vectors
from pothi.operators import dedup, dense, fusion, generation, lexical, retrievers, validation
from pothi.plans import evaluation, run
from pothi.sources import files
from pothi.plugins import FirstWords, HashingEmbedder, LengthVerifier, OverlapScorer, ScriptDetector
from pothi.queries import (
    EVERY, SQL_BM25, SQL_CHUNKS, SQL_PAIRS, SQL_PREDICTIONS, SQL_QUESTIONS, SQL_SUMMARY, WS, chunks, pairs, predictions, query, questions, rounded, sql_f1, sql_greedy, sql_normal, sql_tokens, summarised, table,
)

DIMENSIONS = 64


def sql_vectors(name: str, source: str, key: str, content: str) -> str:
    """CTEs ``name`` (key, slot, v) and ``name_n`` (key, length): the stand-in embedding of a text."""
    words = f"list_filter(regexp_split_to_array(lower({content}), '{WS}+'), lambda t: t <> '')"
    return f"""{name} AS MATERIALIZED (SELECT {key}, CAST('0x' || substr(h, 1, 8) AS BIGINT) % {DIMENSIONS} AS slot, sum(CASE WHEN CAST('0x' || substr(h, 9, 8) AS BIGINT) % 2 = 1 THEN 1.0 ELSE -1.0 END) AS v
      FROM (SELECT {key}, md5(unnest({words})) AS h FROM {source}) GROUP BY ALL),
    {name}_n AS MATERIALIZED (SELECT {key}, sqrt(sum(v * v)) AS length FROM {name} GROUP BY {key})"""


def sql_overlap(left: str, right: str) -> str:
    """The stand-in score of a pair of word lists."""
    return f"CASE WHEN len({left}) > 0 THEN 10.0 * len(list_filter({left}, lambda w: list_contains({right}, w))) / len({left}) - 5.0 ELSE -5.0 END"


@query(
    f"""WITH p AS (SELECT row_number() OVER () AS id, config_id, pair_id, 'query: ' || {sql_normal("coalesce(predicted, '')")} AS a, 'query: ' || {sql_normal("coalesce(gold_answer, '')")} AS b FROM {SQL_PREDICTIONS}),
    {sql_vectors('x', 'p', 'id', 'a')}, {sql_vectors('y', 'p', 'id', 'b')},
    d AS (SELECT x.id, sum(x.v * y.v) AS dot FROM x JOIN y USING (id, slot) GROUP BY 1)
    SELECT config_id, pair_id, round(coalesce(dot, 0) / (n.length * m.length), 6) AS similarity FROM p JOIN x_n n USING (id) JOIN y_n m USING (id) LEFT JOIN d USING (id)"""
)
def sentence_similarity_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of each predicted and gold answer."""
    similarity = evaluation.sentence_similarity(F.col("predicted"), F.col("gold_answer"), HashingEmbedder(DIMENSIONS))
    return rounded(predictions(spark, folder).select("config_id", "pair_id", similarity.alias("similarity")))


@query(
    f"""WITH p AS (SELECT DISTINCT config_id, pair_id, predicted, retrieved_ids FROM {SQL_PREDICTIONS}),
    e AS (SELECT config_id, pair_id, predicted, row_number() OVER (PARTITION BY config_id, pair_id ORDER BY place) AS rank, {sql_tokens('substring(text, 1, 512)')} AS premise FROM (
      SELECT config_id, pair_id, predicted, retrieved_ids[place] AS chunk_id, place FROM (SELECT *, unnest(range(1, len(retrieved_ids) + 1)) AS place FROM p)) JOIN {SQL_CHUNKS} c USING (chunk_id)),
    s AS (SELECT config_id, pair_id, rank, {sql_overlap('premise', 'answer')} AS score FROM (SELECT *, {sql_tokens("coalesce(predicted, '')")} AS answer FROM e WHERE rank <= 5)),
    b AS (SELECT config_id, pair_id, rank, score FROM s QUALIFY row_number() OVER (PARTITION BY config_id, pair_id ORDER BY score DESC, rank) = 1)
    SELECT config_id, pair_id, round(coalesce(score, 0.0), 6) AS score, CAST(coalesce(rank, -1) AS INT) AS rank FROM p LEFT JOIN b USING (config_id, pair_id)"""
)
def faithfulness_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The best support of each answer by its first five retrieved chunks, and the place of that chunk."""
    p = table(spark, folder, "predictions").select("config_id", "pair_id", F.col("predicted").alias("answer"), F.col("retrieved_ids").alias("ids"))
    out = evaluation.faithfulness_of_ids(p, chunks(spark, folder), OverlapScorer())
    return rounded(out.select("config_id", "pair_id", "score", F.col("rank").cast("int").alias("rank")))


@query(
    f"""WITH r AS (SELECT query_id, chunk_id, {sql_overlap('a', 's')} AS rerank_score FROM (SELECT DISTINCT query_id, chunk_id FROM rankings) x
      JOIN (SELECT pair_id AS query_id, {sql_tokens('question')} AS a FROM {SQL_PAIRS}) q USING (query_id) JOIN (SELECT chunk_id, {sql_tokens('substring(text, 1, 512)')} AS s FROM {SQL_CHUNKS}) c USING (chunk_id))
    SELECT query_id, chunk_id, round(rerank_score, 6) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 6) DESC, chunk_id) AS INT) AS rank FROM r QUALIFY rank <= 3"""
)
def rerank_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The three best of the ranked chunks of each question by a reranker."""
    q = pairs(spark, folder).select(F.col("pair_id").alias("query_id"), "question")
    shown = table(spark, folder, "rankings").select("query_id", "chunk_id").distinct().join(q, "query_id").join(chunks(spark, folder).select("chunk_id", "text"), "chunk_id")
    return rounded(fusion.rerank(shown, OverlapScorer(), 3).select("query_id", "chunk_id", "rerank_score", "rank"))


SQL_TWO_STAGE = (
    SQL_BM25.replace("rank <= 10", "rank <= 50").replace("\nWITH docs", "\nWITH RECURSIVE docs")
    + f""", ch AS (SELECT chunk_id, 'passage: ' || text AS content, text FROM {SQL_CHUNKS}), qq AS (SELECT query_id, question, 'query: ' || question AS content FROM q),
    {sql_vectors('cv', 'ch', 'chunk_id', 'content')}, {sql_vectors('qv', 'qq', 'query_id', 'content')},
    dn AS (SELECT query_id, chunk_id, coalesce(dot, 0) / (n.length * m.length) AS score FROM qv_n n CROSS JOIN cv_n m LEFT JOIN (
      SELECT query_id, chunk_id, sum(qv.v * cv.v) AS dot FROM qv JOIN cv USING (slot) GROUP BY 1, 2) USING (query_id, chunk_id)),
    dr AS (SELECT * FROM dn QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) <= 50),
    rr AS (SELECT query_id, chunk_id, {sql_overlap('a', 's')} AS rs FROM ranking JOIN (SELECT query_id, {sql_tokens('question')} AS a FROM q) x USING (query_id)
      JOIN (SELECT chunk_id, {sql_tokens('substring(text, 1, 512)')} AS s FROM ch) y USING (chunk_id)),
    kept AS (SELECT * FROM rr QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rs, 6) DESC, chunk_id) <= 15),
    bn AS (SELECT query_id, chunk_id, score / greatest(max(score) OVER (PARTITION BY query_id), 1e-9) AS score FROM ranking),
    fused AS (SELECT query_id, chunk_id, 0.5 / (1 + exp(-rs / 5)) + 0.3 * greatest(0, least(1, coalesce(dr.score, 0))) + 0.2 * coalesce(bn.score, 0) AS score
      FROM kept LEFT JOIN dr USING (query_id, chunk_id) LEFT JOIN bn USING (query_id, chunk_id)),
    c AS MATERIALIZED (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS INT) AS place FROM fused),
    near AS MATERIALIZED (SELECT query_id, x.place, y.place AS other, coalesce(dot, 0) / (n.length * m.length) AS cosine FROM c x JOIN c y USING (query_id) JOIN cv_n n ON n.chunk_id = x.chunk_id JOIN cv_n m ON m.chunk_id = y.chunk_id
      LEFT JOIN (SELECT a.chunk_id AS ca, b.chunk_id AS cb, sum(a.v * b.v) AS dot FROM cv a JOIN cv b USING (slot) GROUP BY 1, 2) d ON d.ca = x.chunk_id AND d.cb = y.chunk_id),
    pick(query_id, step, chosen, last) AS (
      SELECT query_id, 1, [place], place FROM c WHERE place = 1
      UNION ALL
      SELECT query_id, step + 1, list_append(chosen, place), place FROM (
        SELECT p.query_id, p.step, p.chosen, c.place, 0.6 * c.score - 0.4 * max(n.cosine) AS value
        FROM pick p JOIN c ON c.query_id = p.query_id AND NOT list_contains(p.chosen, c.place) JOIN near n ON n.query_id = p.query_id AND n.place = c.place AND list_contains(p.chosen, n.other)
        WHERE p.step < 10 GROUP BY p.query_id, p.step, p.chosen, c.place, c.score) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(value, 9) DESC, place) = 1)
    SELECT p.query_id, c.chunk_id, round(c.score, 5) AS score, CAST(p.step AS INT) AS rank FROM pick p JOIN c ON c.query_id = p.query_id AND c.place = p.last"""
)


def asked(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).select(F.col("pair_id").alias("query_id"), "question")


def stand_in_retrievers(spark: SparkSession, folder: str) -> dict[str, retrievers.Retriever]:
    """Lexical, dense and hybrid retrievers over the chunks."""
    c, embedder = chunks(spark, folder), HashingEmbedder(DIMENSIONS)
    of_words = retrievers.lexical_retriever(lexical.build_index(table(spark, folder, "chunks"), "chunk_id"))
    of_meaning = retrievers.dense_retriever(retrievers.embedded_chunks(c, embedder, "double"), embedder, "double")
    return {"bm25": of_words, "dense": of_meaning, "hybrid": retrievers.hybrid_retriever(of_meaning, of_words)}


@query(SQL_TWO_STAGE)
def two_stage_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Fifty lexical candidates, the fifteen best of a reranker, fused with dense and lexical scores, ten of them diversified."""
    c, embedder = chunks(spark, folder), HashingEmbedder(DIMENSIONS)
    vectors = retrievers.embedded_chunks(c, embedder, "double")
    of_words = retrievers.lexical_retriever(lexical.build_index(table(spark, folder, "chunks"), "chunk_id"))
    found = retrievers.TwoStage(of_words, OverlapScorer(), c, retrievers.dense_retriever(vectors, embedder, "double"), of_words, vectors)(asked(spark, folder), 10)
    return rounded(found, 5)


SQL_PARENTS = f"(SELECT source, min(text) AS text FROM {SQL_CHUNKS} GROUP BY 1)"


@query(
    f"""WITH f AS (SELECT query_id, source AS parent_id, min(rank) AS first FROM (SELECT DISTINCT query_id, chunk_id, rank FROM rankings WHERE retriever = 'bm25') r JOIN {SQL_CHUNKS} c USING (chunk_id) GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, parent_id) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM f),
    s AS (SELECT query_id, parent_id, {sql_overlap('a', 's')} AS score FROM o JOIN (SELECT pair_id AS query_id, {sql_tokens('question')} AS a FROM {SQL_PAIRS}) q USING (query_id)
      JOIN (SELECT source AS parent_id, {sql_tokens('substring(text, 1, 512)')} AS s FROM {SQL_PARENTS}) p USING (parent_id) WHERE n > 3)
    SELECT query_id, parent_id, CAST(place AS INT) AS rank FROM o WHERE n <= 3
    UNION ALL SELECT query_id, parent_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, parent_id) AS INT) AS rank FROM s QUALIFY rank <= 3"""
)
def hierarchical_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Three books for each question, reranked only where more of them hold ranked chunks."""
    c = chunks(spark, folder).select("chunk_id", F.col("source").alias("parent_id"), "text")
    whole = c.groupBy("parent_id").agg(F.min("text").alias("text"))
    parents = c.drop("text").join(whole, "parent_id")
    r = table(spark, folder, "rankings").distinct().where("retriever = 'bm25'")
    return retrievers.hierarchical(r, parents, pairs(spark, folder).select(F.col("pair_id").alias("query_id"), "question"), 3, OverlapScorer())


@query(
    f"""SELECT DISTINCT r.query_id, r.chunk_id, CAST(r.rank AS INT) AS rank, c.source, c.subject_code, substring(c.text, 1, 200) AS preview FROM rankings r JOIN {SQL_CHUNKS} c USING (chunk_id) WHERE retriever = 'bm25' AND rank <= 3"""
)
def ranking_previews(spark: SparkSession, folder: str) -> DataFrame:
    """The first three ranked chunks of each question with their metadata."""
    records = chunks(spark, folder).select("chunk_id", "source", "subject_code", F.substring("text", 1, 200).alias("preview"))
    r = table(spark, folder, "rankings").where("retriever = 'bm25'").select("query_id", "chunk_id", "rank").distinct()
    return retrievers.previewed(r, records)


@query(
    f"""SELECT pair_id, CASE WHEN n % 7 = 0 THEN 'api_failed' WHEN n % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS s2_verdict, n % 7 <> 0 AND n % 2 = 0 AS s2 FROM (
    SELECT pair_id, {len(validation.VERIFY_PROMPT) - 6} + length(coalesce(question, '')) + length(coalesce(answer, '')) + length(substring(coalesce(source_text, ''), 1, 600)) AS n FROM {SQL_PAIRS})"""
)
def verified_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict and flag of a verifier for each pair."""
    return validation.verify(pairs(spark, folder), "s2", LengthVerifier()).select("pair_id", "s2_verdict", "s2")


class _EchoPairs:
    """A generator of one pair that names the length of its prompt."""

    def generate(self, prompts: list[str]) -> list[str | None]:
        return [f'[{{"question": "How long is it?", "answer": "{len(p)}", "evidence": ["prompt"]}}]' for p in prompts]


@query(
    f"""SELECT 'qa_' || lpad(CAST(row_number() OVER (ORDER BY chunk_id) - 1 AS VARCHAR), 5, '0') AS qa_id, chunk_id, 'How long is it?' AS question, CAST(CASE WHEN language = 'bn' THEN {len(generation.QA_PROMPT_BN) - 8} ELSE {len(generation.QA_PROMPT_EN) - 8} END
    + length(coalesce(class_num::VARCHAR, '')) + length(coalesce(subject, '')) + 1 + length(coalesce(text, '')) AS VARCHAR) AS answer, 'prompt' AS evidence
    FROM {SQL_CHUNKS} WHERE chunk_id NOT IN (SELECT chunk_id FROM nctb_qa WHERE chunk_id IS NOT NULL)"""
)
def generated_for_new_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of the chunks that have none yet, with their ids."""
    made = generation.generated_pairs(chunks(spark, folder), _EchoPairs(), table(spark, folder, "nctb_qa").where("chunk_id is not null"))
    return generation.numbered_pairs(made, ["chunk_id"]).select("qa_id", "chunk_id", "question", "answer", "evidence")


_WORDS = 12


def sql_first(c: str, n: int = _WORDS) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array({c}, '{WS}+'), lambda t: t <> '')[1:{n}], ' ')"


def sql_last(c: str, n: int = _WORDS) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array({c}, '{WS}+'), lambda t: t <> '')[-{n}:], ' ')"


SQL_RUN = (
    SQL_BM25
    + f""", t AS (SELECT pair_id, question, answer AS gold FROM {SQL_PAIRS} WHERE pair_id % {EVERY} = 0 AND question IS NOT NULL),
    top AS (SELECT query_id AS pair_id, list(chunk_id ORDER BY rank) AS ids, min_by(text, rank) AS first FROM ranking JOIN {SQL_CHUNKS} c USING (chunk_id) GROUP BY 1),
    a AS (SELECT t.pair_id, gold, g.chunk_id AS gold_chunk, ids, {sql_first("substring(coalesce(first, ''), 1, 400)")} AS grounded, {sql_last('question')} AS open FROM t JOIN (SELECT pair_id, chunk_id FROM {SQL_PAIRS}) g USING (pair_id) LEFT JOIN top USING (pair_id)),
    m AS (SELECT pair_id, prompt_type, gold_chunk, ids, {sql_tokens(sql_normal("coalesce(gold, '')"))} AS g, {sql_tokens(sql_normal("CASE WHEN prompt_type = 'grounded' THEN grounded ELSE open END"))} AS p, {sql_tokens(sql_normal("open"))} AS o, open FROM a, (VALUES ('grounded'), ('open')) v(prompt_type)),
    f AS (SELECT *, {sql_f1('p', 'g')} AS f1, {sql_f1('o', 'g')} AS of FROM m)
    SELECT prompt_type, count(*) AS n, round(avg(f1), 6) AS token_f1, round(avg(CASE WHEN coalesce(list_contains(ids[1:5], gold_chunk), false) THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5,
      round(avg(CASE WHEN prompt_type = 'grounded' AND open <> '' AND of < f1 - 0.10 THEN 1.0 ELSE 0.0 END), 6) AS hallucination_rate FROM f GROUP BY 1"""
)


@query(SQL_RUN)
def run_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """A run of two configurations, grounded and open, with lexical retrieval and a stand-in generator, in summary."""
    configs = spark.createDataFrame([(1, "bm25", "first", "grounded"), (2, "bm25", "first", "open")], "config_id int, retriever string, generator string, prompt_type string")
    tests = pairs(spark, folder).where((F.col("pair_id") % EVERY == 0) & F.col("question").isNotNull()).select("pair_id", "question", F.col("answer").alias("gold_answer"), F.col("chunk_id").alias("gold_chunk_id"))
    of_words = retrievers.lexical_retriever(lexical.build_index(table(spark, folder, "chunks"), "chunk_id"))
    results = run.run_matrix(configs, tests, chunks(spark, folder), {"bm25": of_words}, {"first": FirstWords(_WORDS)})
    means = [F.avg(c).alias(n) for c, n in (("token_f1", "token_f1"), ("recall_at_5", "recall_at_5"), ("hallucination", "hallucination_rate"))]
    return rounded(results.join(configs.select("config_id", "prompt_type"), "config_id").groupBy("prompt_type").agg(F.count("*").alias("n"), *means))


@query(
    f"""SELECT config_id, round(rl - f1, 6) AS rouge_gap, round(en - bn, 6) AS language_gap FROM (SELECT config_id, coalesce(avg(rouge_l), 0) AS rl, coalesce(avg(token_f1), 0) AS f1,
    coalesce(avg(token_f1) FILTER (language = 'en'), 0) AS en, coalesce(avg(token_f1) FILTER (language = 'bn'), 0) AS bn FROM {SQL_PREDICTIONS} GROUP BY 1) JOIN run_configs USING (config_id)"""
)
def metric_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """How far ROUGE-L stands above token F1, and English above Bengali."""
    return rounded(run.gaps(evaluation.enhanced_summary(predictions(spark, folder), table(spark, folder, "run_configs"))))


@query(
    f"""WITH m AS (SELECT config_id, {sql_f1('p', 'g')} AS f, subject_code FROM (SELECT config_id, subject_code, {sql_tokens(sql_normal("coalesce(predicted, '')"))} AS p, {sql_tokens(sql_normal("coalesce(gold_answer, '')"))} AS g FROM {SQL_PREDICTIONS}))
    SELECT config_id, s.retriever, s.n, s.token_f1, round(coalesce(stddev_samp(f), 0), 6) AS token_f1_std, round(coalesce(1.96 * stddev_samp(f) / sqrt(count(f)), 0), 6) AS token_f1_ci95,
      round(coalesce(avg(f) FILTER (subject_code = 'ict'), 0), 6) AS ict_f1, round(coalesce(avg(f) FILTER (subject_code = 'science'), 0), 6) AS science_f1
    FROM m LEFT JOIN {SQL_SUMMARY} s USING (config_id) GROUP BY ALL"""
)
def rescored_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The base summary with metrics computed anew from the stored answers."""
    out = run.rescored(predictions(spark, folder), rounded(summarised(spark, folder)))
    return rounded(out.select("config_id", "retriever", "n", "token_f1", "token_f1_std", "token_f1_ci95", "ict_f1", "science_f1"))


@query(f"SELECT chunk_id, md5('passage: ' || text) AS document_md5, md5('query: ' || text) AS query_md5 FROM {SQL_CHUNKS}")
def embedding_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """What an embedder is given for each chunk, as a passage and as a query."""
    return chunks(spark, folder).select("chunk_id", *(F.md5(F.concat(F.lit(p), "text")).alias(n) for p, n in ((text.PASSAGE_PREFIX, "document_md5"), (text.QUERY_PREFIX, "query_md5"))))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query(
    f"""WITH c AS (SELECT chunk_id, substring(text, 1, {generation.PASSAGE_CHARACTERS}) AS t, source FROM {SQL_CHUNKS}), p AS (SELECT pair_id, question, q.chunk_id, c.t FROM {SQL_PAIRS} q JOIN c USING (chunk_id))
    SELECT pair_id, md5({_sql_text(generation.GROUNDED_RULES + generation.GROUNDED_EXAMPLES + generation.NOW)} || 'Passage 1:' || chr(10) || t || chr(10) || chr(10) || 'Question: ' || coalesce(question, '') || chr(10) || 'Answer:') AS grounded_md5,
      md5({_sql_text(generation.OPEN_RULES + generation.OPEN_EXAMPLES + generation.NOW)} || 'Question: ' || coalesce(question, '') || chr(10) || 'Answer:') AS open_md5 FROM p"""
)
def prompt_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the prompt of each pair with its own chunk as the passage, and of the one without passages."""
    p = pairs(spark, folder).select("pair_id", "question", "chunk_id").join(chunks(spark, folder).select("chunk_id", "text"), "chunk_id")
    grounded, free = generation.grounded_prompt(F.col("question"), F.array("text")), generation.open_prompt(F.col("question"))
    return p.select("pair_id", F.md5(grounded).alias("grounded_md5"), F.md5(free).alias("open_md5"))


@query(
    """SELECT DISTINCT filename, CASE WHEN extraction_method = 'native' THEN 'native' ELSE 'ocr' END AS branch FROM source_files
    WHERE extraction_method IS NOT NULL AND status <> 'audit_failed' AND filename NOT IN (SELECT filename FROM source_files WHERE extracted_path IS NOT NULL AND error IS NULL AND class_num % 2 = 0)"""
)
def extraction_routes(spark: SparkSession, folder: str) -> DataFrame:
    """The branch that reads each audited file, where the books of even classes are done already."""
    audited = table(spark, folder, "source_files").distinct()
    done = audited.where("extracted_path is not null and error is null and class_num % 2 = 0")
    return files.to_extract(audited, done).select("filename", "branch").distinct()


@query(
    f"""WITH p AS (SELECT row_number() OVER () AS id, config_id, language, 'query: ' || {sql_normal("coalesce(predicted, '')")} AS a, 'query: ' || {sql_normal("coalesce(gold_answer, '')")} AS b FROM {SQL_PREDICTIONS}),
    {sql_vectors('x', 'p', 'id', 'a')}, {sql_vectors('y', 'p', 'id', 'b')},
    d AS (SELECT x.id, sum(x.v * y.v) AS dot FROM x JOIN y USING (id, slot) GROUP BY 1),
    s AS (SELECT config_id, language, coalesce(dot, 0) / (n.length * m.length) AS v FROM p JOIN x_n n USING (id) JOIN y_n m USING (id) LEFT JOIN d USING (id))
    SELECT config_id, round(avg(v), 6) AS bert_score, round(coalesce(stddev_samp(v), 0), 6) AS bert_score_std, round(coalesce(avg(v) FILTER (language = 'bn'), 0), 6) AS bn_bert_score,
      round(coalesce(avg(v) FILTER (language = 'en'), 0), 6) AS en_bert_score FROM s JOIN run_configs USING (config_id) GROUP BY 1"""
)
def similarity_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The similarity columns of the wider summary, with the stand-in embedder."""
    similarity = evaluation.sentence_similarity(F.col("predicted"), F.col("gold_answer"), HashingEmbedder(DIMENSIONS))
    wide = evaluation.enhanced_summary(predictions(spark, folder).withColumn("bert_score", similarity), table(spark, folder, "run_configs"))
    return rounded(wide.select("config_id", "bert_score", "bert_score_std", "bn_bert_score", "en_bert_score"))


@query(f"WITH RECURSIVE {sql_greedy(SQL_QUESTIONS, 0.9)} SELECT a, b, round(d / sqrt(x.s::DOUBLE) / sqrt(y.s::DOUBLE), 6) AS similarity FROM alike JOIN dots USING (a, b) JOIN len2 x ON x.id = a JOIN len2 y ON y.id = b")
def similar_questions(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of questions with a cosine of 0.9 or more."""
    q = table(spark, folder, "nctb_qa").where("pair_id is not null").groupBy(F.col("pair_id").alias("id")).agg(F.min("question").alias("question"))
    return rounded(dedup.similar_pairs(dedup.word_vectors(q, "id", "question"), 0.9))


@query(
    f"""SELECT config_id, pair_id, CASE WHEN coalesce(list_contains(retrieved_ids[1:5], gold_chunk_id), false) THEN 1.0 ELSE 0.0 END AS recall_at_5 FROM {SQL_PREDICTIONS}"""
)
def recall_of_named_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Recall where every second retrieved id is kept under its formatted name."""
    named = F.transform("retrieved_ids", lambda x, i: F.when(i % 2 == 0, F.format_string("chunk_%06d", x)).otherwise(x.cast("string")))
    return predictions(spark, folder).select("config_id", "pair_id", metrics.recall_at_named(named, F.col("gold_chunk_id"), 5).alias("recall_at_5"))


@query("SELECT query_id, chunk_id, retriever, round(greatest(0, least(1, 1 - score)), 6) AS similarity FROM (SELECT DISTINCT * FROM rankings)")
def distance_similarities(spark: SparkSession, folder: str) -> DataFrame:
    """Scores read as cosine distances, as similarities."""
    r = table(spark, folder, "rankings").distinct()
    return rounded(r.select("query_id", "chunk_id", "retriever", vectors.similarity_of_distance(F.col("score")).alias("similarity")))


@query(f"SELECT chunk_id, md5(text) AS text_md5, source, class_num, origin FROM {SQL_CHUNKS}, (VALUES ('json'), ('csv'), ('parquet')) v(origin) WHERE origin <> 'csv' OR class_num IS NOT NULL")
def stage_round_trips(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks after they were written and read again as JSON, as CSV (those with a class) and as folders by class."""
    from pothi.plans.store import shared_folder

    c = chunks(spark, folder).select("chunk_id", F.md5("text").alias("text_md5"), "source", "class_num", F.col("class_num").cast("string").alias("folder_key"))
    to = f"{shared_folder(spark)}/pothi/round-trips-{uuid.uuid4().hex}"
    schema = "chunk_id long, text_md5 string, source string, class_num int"
    files.write_json(c.drop("folder_key"), f"{to}/json")
    files.write_csv(c.drop("folder_key").where("class_num is not null"), f"{to}/csv")
    files.write_partitioned(c, f"{to}/parquet")
    read = {
        "json": spark.read.schema(schema).json(f"{to}/json"),
        "csv": files.read_csv(spark, f"{to}/csv", schema),
        "parquet": spark.read.parquet(f"{to}/parquet").select("chunk_id", "text_md5", "source", "class_num"),
    }
    return reduce(DataFrame.unionByName, (df.withColumn("origin", F.lit(name)) for name, df in read.items()))


@query(f"SELECT chunk_id, CASE WHEN chunk_id % 3 = 0 THEN 'incoming' ELSE 'stored' END AS origin FROM {SQL_CHUNKS} WHERE chunk_id % 3 = 0 OR chunk_id % 2 = 0")
def vector_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """An index of every second chunk after every third one came in."""
    c = chunks(spark, folder).select("chunk_id")
    stored, incoming = c.where("chunk_id % 2 = 0").withColumn("origin", F.lit("stored")), c.where("chunk_id % 3 = 0").withColumn("origin", F.lit("incoming"))
    return dense.upsert(stored, incoming, "chunk_id")


@query(
    f"""SELECT config_id, pair_id, CASE WHEN coalesce(predicted, '') = '' THEN '' WHEN bengali > latin THEN 'bn' WHEN bengali + latin > 0 THEN 'en' ELSE '' END AS detected FROM (
    SELECT config_id, pair_id, predicted, length(regexp_replace(coalesce(predicted, ''), '[^ঀ-৿]', '', 'g')) AS bengali, length(regexp_replace(coalesce(predicted, ''), '[^A-Za-z]', '', 'g')) AS latin FROM {SQL_PREDICTIONS})"""
)
def detected_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The language of each answer by a detector that is plugged in."""
    found = validation.detect_language(F.col("predicted"), ScriptDetector())
    return predictions(spark, folder).select("config_id", "pair_id", F.coalesce(found, F.lit("")).alias("detected"))


@query(
    SQL_BM25.replace("rank <= 10", "rank <= 20") + "SELECT query_id, array_to_string(list(CAST(chunk_id AS VARCHAR) ORDER BY rank), ',') AS ids FROM ranking GROUP BY 1"
)
def retrieved_id_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of the twenty best chunks of each question, in order."""
    index = lexical.build_index(table(spark, folder, "chunks"), "chunk_id")
    found = lexical.bm25_top(index, asked(spark, folder), "query_id", "question", 20)
    listed = F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
    return found.groupBy("query_id").agg(F.array_join(listed["chunk_id"].cast("array<string>"), ",").alias("ids"))
