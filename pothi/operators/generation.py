"""Prompts, parsing of model responses, and generation with provenance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pothi.functions.text import _nfc
from pothi.operators.chunking import number_rows
from pothi.plans.store import exists
from pothi.plugins import Generator

# Texts of the prompts.
QA_PROMPT_EN = (
    "You are a teacher. Generate exactly %s question-answer pairs from the following Class %s %s textbook excerpt. "
    "Every pair MUST include an 'evidence' field containing the exact verbatim span from the text that supports the answer. "
    "Output ONLY a valid JSON array, no preamble, no markdown fences.\n"
    'Format: [{"question": "...", "answer": "...", "evidence": "..."}, ...]\n\nText:\n%s'
)
QA_PROMPT_BN = _nfc(
    "তুমি একজন শিক্ষক। নিচের পাঠ্যাংশ থেকে Class %s %s বইয়ের জন্য %sটি প্রশ্ন-উত্তর জোড়া তৈরি করো। "
    "প্রতিটি জোড়ায় অবশ্যই একটি 'evidence' ক্ষেত্র থাকতে হবে (পাঠ্যাংশের হুবহু অংশ যা উত্তরটি সমর্থন করে)। "
    "শুধুমাত্র JSON array আউটপুট করো, অন্য কিছু না।\n"
    'Format: [{"question": "...", "answer": "...", "evidence": "..."}, ...]\n\nপাঠ্যাংশ:\n%s'
)
GROUNDED_RULES = (
    "Answer the question using ONLY the information in the passages below.\nRules:\n"
    "1. Use ONLY words and facts from the passages — do NOT use outside knowledge.\n"
    "2. Give a short, direct answer. No preamble like 'According to the passage'.\n"
    "3. Match the language of the question: Bengali question → Bengali answer, English question → English answer.\n"
    "4. If the answer cannot be found in the passages, respond exactly: 'Not found in context.' — do NOT guess.\n\n"
)
GROUNDED_EXAMPLES = _nfc(
    "--- Examples ---\n"
    "Passage 1:\nPhotosynthesis is the process by which green plants use sunlight, water and carbon dioxide to produce food and oxygen.\n\n"
    "Question: What do green plants use to produce food?\nAnswer: Sunlight, water and carbon dioxide.\n\n"
    "Passage 1:\nবাংলাদেশের জাতীয় ফুল হলো শাপলা। এটি জলাশয়ে জন্মায় এবং সাদা রঙের হয়।\n\n"
    "Question: বাংলাদেশের জাতীয় ফুলের নাম কী?\nAnswer: শাপলা।\n\n"
    "Passage 1:\nThe mitochondria is the powerhouse of the cell.\n\nQuestion: What is the capital of France?\nAnswer: Not found in context.\n\n"
)
OPEN_RULES = (
    "Answer the following question with a short, direct answer.\n"
    "If the question is in Bengali, answer in Bengali. If in English, answer in English.\n\n"
)
OPEN_EXAMPLES = _nfc(
    "--- Examples ---\nQuestion: What is the capital of Bangladesh?\nAnswer: Dhaka.\n\n"
    "Question: অক্সিজেনের রাসায়নিক প্রতীক কী?\nAnswer: O\n\n"
)
NOW = "--- Now answer this ---\n"
PASSAGES, PASSAGE_CHARACTERS = 5, 400


def _or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def qa_prompt(language: Column, subject: Column, class_num: Column, text: Column, pairs: int = 2) -> Column:
    """Prompt that asks for question-answer pairs of a chunk, in Bengali for ``bn``; nulls are left blank."""
    bengali = F.format_string(QA_PROMPT_BN, _or_empty(class_num), _or_empty(subject), F.lit(str(pairs)), _or_empty(text))
    english = F.format_string(QA_PROMPT_EN, F.lit(str(pairs)), _or_empty(class_num), _or_empty(subject), _or_empty(text))
    return F.when(language == "bn", bengali).otherwise(english)


def grounded_prompt(question: Column, passages: Column) -> Column:
    """Prompt with the first passages of an array of texts."""
    shown = F.transform(
        F.slice(passages, 1, PASSAGES),
        lambda t, i: F.concat(F.lit("Passage "), (i + 1).cast("string"), F.lit(":\n"), F.substring(_or_empty(t), 1, PASSAGE_CHARACTERS), F.lit("\n\n")),
    )
    head = GROUNDED_RULES + GROUNDED_EXAMPLES + NOW
    return F.concat(F.lit(head), F.array_join(shown, ""), F.lit("Question: "), _or_empty(question), F.lit("\nAnswer:"))


def open_prompt(question: Column) -> Column:
    return F.concat(F.lit(OPEN_RULES + OPEN_EXAMPLES + NOW + "Question: "), _or_empty(question), F.lit("\nAnswer:"))


def parse_pairs(response: Column) -> Column:
    """Array of (question, answer, evidence) of a response, null when it is no array of pairs.

    A fence around the array is taken off.  Evidence may be a text or a list,
    of which the first counts; anything else is empty.  An empty array is null.
    """
    plain = F.trim(response)
    fenced = F.regexp_replace(F.element_at(F.split(plain, "```"), F.lit(2)), "^json", "")
    body = F.trim(F.when(plain.startswith("```"), fenced).otherwise(plain))
    parsed = F.try_parse_json(body)
    is_list = F.schema_of_variant(parsed).startswith("ARRAY")
    items = F.when(is_list, F.try_variant_get(parsed, "$", "array<variant>"))

    def item(v: Column) -> Column:
        listed, plain_text = F.try_variant_get(v, "$.evidence[0]", "string"), F.try_variant_get(v, "$.evidence", "string")
        kind = F.schema_of_variant(F.try_variant_get(v, "$.evidence", "variant"))
        evidence = F.when(kind.startswith("ARRAY"), listed).when(kind == "STRING", plain_text)
        return F.struct(
            F.try_variant_get(v, "$.question", "string").alias("question"),
            F.try_variant_get(v, "$.answer", "string").alias("answer"),
            F.coalesce(evidence, F.lit("")).alias("evidence"),
        )

    pairs = F.transform(items, item)
    whole = F.forall(pairs, lambda p: p["question"].isNotNull() & p["answer"].isNotNull())
    return F.when((F.size(pairs) > 0) & whole, pairs)


def generate(df: DataFrame, prompt: Column, generator: Generator, name: str = "response") -> DataFrame:
    """``df`` with the generator's response to each prompt, null where it failed."""
    schema = df.schema
    schema = type(schema)([*schema.fields])
    schema.add(name, "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.drop(columns="_prompt")
            out[name] = pd.Series(generator.generate(pdf["_prompt"].tolist()), index=pdf.index, dtype=object)
            yield out

    return df.withColumn("_prompt", prompt).mapInPandas(run, schema)


def generated_pairs(chunks: DataFrame, generator: Generator, done: DataFrame | None = None, per_chunk: int = 2) -> DataFrame:
    """Pairs of the chunks that have none yet, with the provenance of their chunk."""
    todo = chunks if done is None else chunks.join(done.select("chunk_id").distinct(), "chunk_id", "left_anti")
    prompt = qa_prompt(F.col("language"), F.col("subject"), F.col("class_num"), F.col("text"), per_chunk)
    parsed = generate(todo, prompt, generator).withColumn("pair", F.explode(parse_pairs(F.col("response"))))
    kept = [c for c in chunks.columns if c != "text"]
    return parsed.select("pair.question", "pair.answer", "pair.evidence", F.col("text").alias("source_text"), *kept)


def numbered_pairs(made: DataFrame, order: list[str], first: int = 0) -> DataFrame:
    """``made`` with consecutive ids ``qa_00000`` ... in the given order, ties by question."""
    numbered = number_rows(made, [*order, "question"], "_number", first)
    return numbered.withColumn("qa_id", F.format_string("qa_%05d", "_number")).drop("_number")


def cached_pairs(chunks: DataFrame, generator: Generator, cache: str, per_chunk: int = 2) -> DataFrame:
    """All pairs in the ``cache`` folder (parquet) after generating for the chunks that have none there.

    A response without pairs leaves nothing behind, so its chunk is asked again
    next time.
    """
    spark = chunks.sparkSession
    done = spark.read.parquet(cache).select("chunk_id") if exists(spark, f"{cache}/_SUCCESS") else None
    generated_pairs(chunks, generator, done, per_chunk).write.mode("append").parquet(cache)
    return spark.read.parquet(cache)
