"""What larger tables need: results that stay the same when a job is dealt out, and plans without the steps that grew."""

import math
import random

from pyspark.sql import functions as F

from corpusmill.operators import clean, enrich, organize, parse, ranges, retrieve, search, segment


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def test_tfidf_search_shuffles_no_grams(spark, monkeypatch):
    chunks = spark.createDataFrame([(d, i, f"{d}{i}", t, "normal") for d in "de" for i, t in enumerate(("alpha beta", "Beta  gamma delta", "", "alpha alpha"))], "doc_id string, ordinal int, chunk_id string, content string, chunk_type string")
    asked = spark.createDataFrame([("q1", "d", "beta alpha"), ("q2", "e", "GAMMA"), ("q3", "e", ""), ("q4", "none", "x")], "query_id string, doc_id string, question string")
    found = search.Store.of(chunks, "tfidf", rank="none").search(asked, 9)
    assert "gram" not in plan(found)
    within = rows(found)
    monkeypatch.setattr(search, "LARGE", 2)
    assert within == rows(search.Store.of(chunks, "tfidf", rank="none").search(asked, 9)) and len(within) == 12


def test_entity_tags_normalise_a_text_once(spark):
    tags = enrich.entity_tags(F.col("text"))
    text = " ".join(f'v{i}.{i}.1 "Term {i}" "TERM {i}" 2024-0{i}-01' for i in range(1, 8)) + " RAG python 向量数据库"
    got = spark.createDataFrame([(text,), (None,), ("python API",)], "text string").select(tags.alias("t"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    dates = [f"2024-0{i}-01" for i in range(1, 8)]
    assert [r["t"] for r in got.collect()] == [[*dates, "v1.1.1", "v2.2.1", "v3.3.1"], [], ["API", "Python"]]


def test_nearest_makes_no_pairs_and_keeps_ties(spark, monkeypatch):
    rng = random.Random(3)
    some = [(i, [rng.choice((-1.0, 0.0, 0.5, 1.1)) for _ in range(3)]) for i in range(300)] + [(300, None), (301, [0.0, 0.0, 0.0]), (302, [1.0]), (303, [1.0, None, 0.0])]
    rng.shuffle(some)
    vectors = spark.createDataFrame(some, "vec_id long, v array<float>")
    asked = vectors.where("vec_id % 50 = 0 OR vec_id > 300").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    monkeypatch.setattr(retrieve, "PRODUCTS", 60)
    monkeypatch.setattr(retrieve, "PAIRS", 7)

    def score(q, v, cosine):
        fit = q is not None and v is not None and len(q) == len(v) == 3 and None not in q + v
        if not cosine:
            return -math.floor(sum((x - y) ** 2 for x, y in zip(q, v, strict=True)) * 1e6 + 0.5) if fit else None
        norm = math.sqrt(sum(x * x for x in q)) * math.sqrt(sum(x * x for x in v)) if fit else 0
        return math.floor(sum(x * y for x, y in zip(q, v, strict=True)) / norm * 1e6 + 0.5) if norm else 0

    held, queries = [tuple(r) for r in vectors.collect()], [tuple(r) for r in asked.collect()]
    for measure in ("cosine", "l2"):
        for k in (5, 400):
            found = retrieve.nearest(asked, vectors, k, measure)
            assert "NestedLoop" not in plan(found)
            want = []
            for query_id, q in queries:
                scores = [(vec_id, score(q, v, measure == "cosine")) for vec_id, v in held]
                scores.sort(key=lambda x: (math.inf if x[1] is None else -x[1], x[0]))
                want += [(query_id, vec_id, s, n) for n, (vec_id, s) in enumerate(scores[:k], 1)]
            assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    named = vectors.select(F.format_string("%03d", "vec_id").alias("vec_id"), "v")
    got = retrieve.nearest(asked, named, 5).select("query_id", F.col("vec_id").cast("long"), "score_e6", "rank")
    assert rows(got) == rows(retrieve.nearest(asked, vectors, 5).select("query_id", "vec_id", "score_e6", "rank"))


LINES = (
    "# Head", "## 1. x", "第1章 总则", "一、概述", "1.1 验收标准", "introduction", "| a | b |", "| --- | ---: |", "|a|", "x||", "•", "-", "- item", "```", "x```", "$$", "x = y", "![f](u)", "", "", "  ", "\u3000", "plain line.",
    "1. contents .... 5", "引言\t12", "foo - 3 -", "1 a  7", "wide    12", "目 录", "目录", "姓名：某", "学号", "2024 年", "2024年1月2日", "标题: 值值值", "key:\tvalue", "label    value text  ..", "实习报告", "| " + "长 " * 700 + "| b |", "#\u3000T", "١ abc", "a\x85b: c", "日期", "5 - ",
)


def texts(spark, n=400, lines=LINES):
    rng = random.Random(5)
    some = ["\n".join(rng.choice(lines) + rng.choice(("", " ")) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return spark.createDataFrame([(i, t) for i, t in enumerate([None, "", *some, "\n\n".join(f"word {i}. " * 40 for i in range(30))])], "doc_id long, text string")


def test_line_classes_are_counted_before_a_shuffle(spark):
    df = texts(spark)
    found = parse.class_counts(df)
    assert "rlike" not in plan(found).lower()
    assert rows(found) == rows(parse.lines(df).groupBy("k").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars")))


def test_documents_are_cleaned_without_a_window(spark):
    df = texts(spark)
    blocks = parse.blocks(df)
    was = F.col("metadata")["original_block_type"].alias("was")
    for found, want in (
        (clean.cleaned_of(df), clean.cleaned(blocks).select("doc_id", "raw", "last_raw", "text", "block_type", was)),
        (clean.report_of(df), clean.report(blocks)),
        (clean.flat_tables_of(df), blocks.where("block_type = 'table'").select("doc_id", "raw", clean.flatten_table(F.col("text")).alias("flat"))),
    ):
        assert "Window" not in plan(found) and "Exchange" not in plan(found)
        assert rows(found) == rows(want)
    fates = {r["fate"] for r in clean.classified(blocks).select("fate").distinct().collect()}
    assert fates == {"cover", "toc", "flat", "keep"}


def test_documents_are_chunked_without_gathering_them(spark):
    # Levels of headings that are marked by white space or digits beyond ASCII are those of `title_paths`.
    df = texts(spark, 150, [x for x in LINES if x not in ("#\u3000T", "١ abc")])
    for config in (None, segment.SegmentConfig.headings_only()):
        found = segment.segmented_of(df, config)
        assert "Exchange" not in plan(found) and "ArrowEvalPython" not in plan(found)
        assert rows(found) == rows(segment.segmented(parse.blocks(df), config))


def test_chunks_are_organised_where_they_stand(spark):
    rng = random.Random(7)
    words = ("检索", "分块", "the", "The", "API", "api", "alpha", "beta_1", "长的词语在此", "x", "ab", "a", "b2", "abab", "，", "。", "7", "77")
    some = [(i, 1, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(200, 1, None), (201, 1, "abc 检索 検索。一一 ab")]
    df = spark.createDataFrame(some, "chunk_id long, nth int, content string").withColumn("doc_id", F.col("chunk_id"))
    found = organize.organized(df)
    assert "Exchange" not in plan(found) and "Window" not in plan(found)
    tags = organize.tags(df.select("doc_id", F.col("content").alias("text"))).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("nth", "tag"))).alias("t"))
    want = {r["doc_id"]: [x["tag"] for x in r["t"]] for r in tags.collect()}
    assert {r["chunk_id"]: r["tags"] for r in found.collect()} == {i: want.get(i, []) for i, _, _ in some}


def test_chunking_takes_bounded_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    long = spark.createDataFrame([(i, f"word {i}. " * 20_000) for i in range(40)], "doc_id long, text string")
    found = segment.segmented_of(long)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    assert found.select("doc_id").distinct().count() == 40


def test_keywords_shuffle_only_what_can_be_best(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("x", "xyz", "Word", "中文检索词", "_", "7", "é")] + ["about", "chunk", "__", "标题", "the", "²x", "ǅa"]
    docs = [(i, " ".join(words[int(len(words) * rng.random() ** 3)] for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(150, None), (3, "twice xyz xyz"), (None, "no id"), (None, "id none")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    terms = df.select("doc_id", F.explode(enrich.keyword_tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    counts, spread = {}, {}
    for d, term, n in map(tuple, terms.collect()):
        counts.setdefault(d, {})[term] = n
        spread[term] = spread.get(term, 0) + 1
    want = []
    for d, own in counts.items():
        scored = sorted((-math.floor(n * math.log((1 + len(docs)) / (1 + spread[t])) * 1e6 + 0.5), t, n) for t, n in own.items())
        want += [(d, rank, t, n, spread[t], -w) for rank, (w, t, n) in enumerate(scored[:4], 1)]
    for frequent, counted in ((200_000, 500_000), (20, 7), (0, 1)):
        monkeypatch.setattr(enrich, "FREQUENT", frequent)
        monkeypatch.setattr(enrich, "COUNTED", counted)
        found = enrich.keywords_tfidf(df, 4)
        assert "Generate" not in plan(found) and "_salt" not in plan(found)
        assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["rank"], r["term"], r["n"], r["df"], r["weight_e6"])) for r in found.collect())
    spark.catalog.clearCache()


def test_range_records_are_cut_where_texts_are_parsed(spark):
    df = texts(spark, 100)
    found = ranges.records_of(df, lambda n: [(i // 4, i, i + 3, None if i % 8 else f"part {i}", "rule") for i in range(0, n, 4)], 120)
    assert "Exchange" not in plan(found) and "Join" not in plan(found)
    blocks = parse.raw_blocks(df).select("doc_id", F.col("raw").alias("i"), F.concat(F.lit("b"), "raw").alias("block_id"), "text")
    spans = blocks.where("i % 4 = 0").select("doc_id", F.expr("int(i / 4)").alias("nth"), F.col("i").alias("start"), (F.col("i") + 3).alias("stop"), F.when(F.col("i") % 8 == 0, F.concat(F.lit("part "), "i")).alias("title"), F.lit("rule").alias("reason"))
    assert rows(found) == rows(ranges.records(blocks, spans, 120)) and found.count() > 100
