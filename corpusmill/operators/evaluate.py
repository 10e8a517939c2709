"""Relevance judgements, ranking metrics, comparisons, grids and human scores."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import fixed as K
from corpusmill.functions.text import compact, e6, share_e6


def keyword_share(keywords: Column, text: Column) -> Column:
    hits = F.size(F.filter(keywords, lambda k: F.contains(compact(text), compact(k))))
    return F.coalesce(hits / F.nullif(F.size(keywords), F.lit(0)), F.lit(0.0))


def is_relevant(keywords: Column, text: Column, similarity: Column) -> Column:
    """A third of the keywords; or some and a figure; or else enough similarity, more of it where keywords exist."""
    share = keyword_share(keywords, text)
    least = F.when(F.size(keywords) > 0, max(K.JUDGE_SEMANTIC, K.JUDGE_SEMANTIC_WITH_KEYWORDS)).otherwise(K.JUDGE_SEMANTIC)
    return (share >= K.JUDGE_KEYWORDS) | ((share > 0) & text.rlike(K.EVIDENCE)) | (similarity >= least)


def _discount(rank: Column) -> Column:
    return F.log(F.lit(2.0)) / F.log(rank + 1.0)


def ranking_metrics(hits: DataFrame, totals: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """hits (query_id, rank, rel as 0 or 1), totals (query_id, total) to recall, precision, ndcg at k and mrr, in millionths."""
    x = hits.join(totals, "query_id")
    cols = []
    for k in ks:
        near = F.col("rank") <= k
        shown = F.least(F.count("*"), F.lit(k))
        found = F.sum(F.when(near, F.col("rel")).otherwise(0))
        best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.max("total"), shown), F.lit(1)).cast("int")), F.lit(0.0), lambda acc, i: acc + _discount(i))
        gain = F.aggregate(F.array_sort(F.collect_list(F.when(near & (F.col("rel") == 1), F.col("rank")))), F.lit(0.0), lambda acc, i: acc + _discount(i))
        cols += [
            share_e6(found, F.max("total")).alias(f"recall_{k}_e6"),
            share_e6(found, shown).alias(f"precision_{k}_e6"),
            F.when(F.max("total") > 0, e6(gain / best)).otherwise(0).cast("long").alias(f"ndcg_{k}_e6"),
        ]
    first = F.min(F.when(F.col("rel") == 1, F.col("rank")))
    return x.groupBy("query_id").agg(*cols, F.coalesce(e6(1.0 / first), F.lit(0)).cast("long").alias("mrr_e6"))


def winners(scores: DataFrame) -> DataFrame:
    """(item, strategy, score) to strategy, wins and ties: a sole best score wins, a shared one ties."""
    w = Window.partitionBy("item")
    best = scores.withColumn("best", F.max("score").over(w)).where("score = best").withColumn("shared", F.count("*").over(w))
    return best.groupBy("strategy").agg(F.count_if(F.col("shared") == 1).alias("wins"), F.count_if(F.col("shared") > 1).alias("ties"))


def strategy_summary(scores: DataFrame) -> DataFrame:
    """Means of (grp, strategy, value) by group and overall (grp null), as sums and counts."""
    out = scores.groupingSets([[F.col("grp"), F.col("strategy")], [F.col("strategy")]], "grp", "strategy")
    return out.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.grouping("grp").alias("overall"))


#: The parameter grid; combinations whose target exceeds the maximum are left out.
GRID = {
    "min_chars": (120, 180, 240, 300),
    "target_chars": (450, 550, 650, 900),
    "max_chars": (800, 1000, 1200, 1400),
    "heading_flush": (120, 180, 240, 300, 360),
    "threshold": (0.45, 0.5, 0.55, 0.6),
    "overlap": (0, 1),
}


def grid(spark: SparkSession) -> DataFrame:
    rows = [r for r in product(*GRID.values()) if r[1] <= r[2]]
    return spark.createDataFrame(rows, "min_chars int, target_chars int, max_chars int, heading_flush int, threshold double, overlap int")


def best_configs(results: DataFrame, by: tuple[str, ...], limit: int) -> DataFrame:
    return results.orderBy(*[F.desc(c) for c in by], *[c for c in results.columns if c not in by]).limit(limit)


def human_rates(scores: DataFrame) -> DataFrame:
    """(doc_group, evaluator, score) to counts of whole chunks by group, by evaluator and overall; unscored rows do not count."""
    x = scores.where("score IS NOT NULL")
    sets = [[F.col("doc_group")], [F.col("evaluator")], []]
    out = x.groupingSets(sets, "doc_group", "evaluator").agg(F.count("*").alias("n"), F.sum("score").alias("complete"), F.countDistinct("evaluator").alias("evaluators"), F.grouping_id().alias("level"))
    return out.select("level", "doc_group", "evaluator", "n", "complete", "evaluators", (F.col("complete") >= K.PASS_SEMANTIC * F.col("n")).alias("passed"))


def sample_per_doc(chunks: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows of each document, chosen by a hash: the same ones however the rows are spread."""
    w = Window.partitionBy("doc_id").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "chunk_id")), "chunk_id")
    return chunks.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
