"""Question-answer pairs: lexical quality, worthiness of chunks, parsing of generated answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import fixed as K
from corpusmill.functions.text import find_all, py_strip, word_ngrams


def lexical_quality(answer: Column, content: Column) -> Column:
    """answer_words and those found, bigrams and those found, the two judgements; all 0 and false without a text."""
    a, c = (F.lower(py_strip(F.coalesce(x, F.lit("")))) for x in (answer, content))
    # Both texts are prepared once, as an element, and not again for each n-gram.
    texts = F.array(F.struct(a.alias("a"), c.alias("c"), find_all(a, K.WORD_RUN).alias("words")))
    return F.get(F.transform(texts, _quality), 0)


def _quality(t: Column) -> Column:
    a, c, words = t["a"], t["c"], F.array_distinct(t["words"])
    grams = word_ngrams(t["words"], 2)
    found = F.size(F.array_intersect(words, find_all(c, K.WORD_RUN)))
    kept = F.size(F.filter(grams, lambda g: F.contains(c, g)))
    some = (a != "") & (c != "")
    n = lambda x: F.when(some, x).otherwise(0)
    return F.struct(
        n(F.size(words)).alias("n_words"),
        n(found).alias("n_found"),
        n(F.size(grams)).alias("n_grams"),
        n(kept).alias("n_kept"),
        (some & (found >= K.QA_ANSWERABLE * F.greatest(F.size(words), F.lit(1)))).alias("answerable"),
        (some & F.when(F.size(grams) > 0, kept >= K.QA_FAITHFUL * F.size(grams)).otherwise(found >= K.QA_FAITHFUL * F.greatest(F.size(words), F.lit(1)))).alias("faithful"),
    )


EVALUATORS: dict[str, Callable[[Column, Column], Column]] = {"lexical_overlap_v1": lexical_quality}


def evaluator(name: str | None = None) -> Callable[[Column, Column], Column]:
    """By name; unknown names give the default."""
    return EVALUATORS.get((name or "").strip().lower(), lexical_quality)


def is_worthy(content: Column, chunk_type: Column) -> Column:
    """Long enough, few links, no table or code, not a list of short lines."""
    t = py_strip(F.coalesce(content, F.lit("")))
    rows = F.filter(F.split(t, "\n"), lambda r: py_strip(r) != "")
    chars = F.aggregate(rows, F.lit(0), lambda acc, r: acc + F.length(r))
    short = (F.size(rows) >= K.QA_MANY_LINES) & (chars < K.QA_SHORT_LINE * F.size(rows))
    return (F.length(t) >= K.QA_MIN_CHARS) & (F.regexp_count(t, F.lit("https?://")) < K.QA_MAX_URLS) & ~chunk_type.isin("table", "code") & ~short


def parse_pairs(df: DataFrame, answer_col: str = "answer") -> DataFrame:
    """chunk_id, qa_id, question, answer from JSON arrays, also inside code fences or prose; incomplete pairs go."""
    body = F.regexp_extract(F.col(answer_col), r"(?s)(\[.*\])", 1)
    pairs = F.from_json(F.nullif(body, F.lit("")), "array<struct<question:string,answer:string>>")
    x = df.select("chunk_id", F.posexplode(pairs).alias("nth", "p")).select("chunk_id", "nth", F.trim("p.question").alias("question"), F.trim("p.answer").alias("answer"))
    x = x.where("question <> '' AND answer <> ''")
    # Ids count within a chunk: a number over all rows would need one task for all of them.
    w = Window.partitionBy("chunk_id").orderBy("nth")
    return x.select("chunk_id", F.format_string("%s_qa_%04d", F.col("chunk_id").cast("string"), F.row_number().over(w)).alias("qa_id"), "question", "answer")


def unfenced(answer: Column) -> Column:
    """A model's answer without the code fence around it."""
    t = py_strip(F.coalesce(answer, F.lit("")))
    t = F.when(F.startswith(t, F.lit("```")) & F.contains(t, F.lit("\n")), F.regexp_replace(t, r"^[^\n]*\n", "")).otherwise(t)
    return F.when(F.endswith(t, F.lit("```")), py_strip(F.regexp_replace(t, "```$", ""))).otherwise(t)


def judged(answer: Column, threshold: int = 7) -> Column:
    """A model's verdict on a pair: scores of 0 to 10 from its JSON object, whether each reaches the threshold, the reason.

    No answer and no readable object are errors and count as failed; a missing score is 0.
    """
    text = unfenced(answer)
    scores = F.from_json(text, "answerable_score int, faithful_score int, brief_reason string")
    is_object = text.rlike(r"(?s)^\{.*\}$") & F.coalesce(scores["answerable_score"].isNotNull() | scores["faithful_score"].isNotNull() | text.rlike(r"^\{\s*\}$"), F.lit(False))
    a, f = (F.when(is_object, F.coalesce(scores[n], F.lit(0))).otherwise(0) for n in ("answerable_score", "faithful_score"))
    return F.struct(
        a.alias("answerable_score"),
        f.alias("faithful_score"),
        (is_object & (a >= threshold)).alias("answerable"),
        (is_object & (f >= threshold)).alias("faithful"),
        F.when(is_object, F.coalesce(scores["brief_reason"], F.lit(""))).alias("reason"),
        F.when(text == "", "no answer").when(~is_object, "unreadable answer").alias("error"),
    )


def synthesized(chunks: DataFrame, generate: Callable[[Column], Column], validate: Callable[[Column], Column] | None = None, chars: int = 2000) -> DataFrame:
    """chunk_id, source_doc, qa_id, question, answer and their judgement for worthy chunks (chunk_id, doc_id, chunk_type, content).

    `generate` and `validate` are models as column functions; without `validate` the lexical quality judges.
    """
    worthy = chunks.where(is_worthy(F.col("content"), F.coalesce("chunk_type", F.lit("normal"))))
    pairs = parse_pairs(worthy.select("chunk_id", unfenced(generate(F.left("content", F.lit(chars)))).alias("answer")))
    x = pairs.join(worthy.select("chunk_id", F.col("doc_id").alias("source_doc"), "content"), "chunk_id")
    if validate is None:
        verdict = lexical_quality(F.col("answer"), F.col("content"))
    else:
        prompt = F.concat_ws("\n", F.left("content", F.lit(1500)), F.col("question"), F.col("answer"))
        verdict = judged(validate(prompt))
    return x.withColumn("v", verdict).select("chunk_id", "source_doc", "qa_id", "question", "answer", F.col("v.answerable").alias("answerable"), F.col("v.faithful").alias("faithful"))
