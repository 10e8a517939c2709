"""Retrieval, evaluation, QA, stores, sources and streaming."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import evaluate, qa, retrieve, store
from corpusmill.sources import files
from corpusmill.streaming.ingest import CHUNKS, DOCS, ingest_stream
from tests.test_documents import values


def test_vectors(spark):
    got = values(spark, ["abc", "bcd", "标题a", "ab", None], retrieve.trigram_counts)
    assert [[tuple(c) for c in g] for g in got] == [[(194, 1)], [(121, 1)], [(95, 1)], [], []]
    (v,) = values(spark, ["abcd"], retrieve.trigram_vector)
    assert len(v) == 256 and abs(sum(x * x for x in v) - 1) < 1e-6
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, v array<float>")
    q = df.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    assert [r["vec_id"] for r in retrieve.nearest(q, df, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert [r["score_e6"] for r in retrieve.nearest(q, df, 3, "l2").orderBy("rank").collect()] == [0, -1_000_000, -4_000_000]
    assert retrieve.nearest(q.limit(0), df, 3).count() == 0


def test_scores(spark):
    assert values(spark, [0.0, 1.0, -1.0], retrieve.distance_to_score, "double") == [1.0, 0.5, 1.0]
    chunks = spark.createDataFrame([("a", "nothing shared", []), ("b", "vector search question", ["undersized"])], "chunk_id string, text string, quality_flags array<string>")
    hits = spark.createDataFrame([(1, "vector search", "a", 0.1, 1), (1, "vector search", "b", 0.43, 2), (1, "vector search", "gone", 0.0, 3)], "query_id int, question string, chunk_id string, distance double, cand_rank int")
    (best,) = retrieve.hybrid(hits, chunks, 1).collect()
    assert (best["chunk_id"], best["score_e6"]) == ("b", 754545)
    assert values(spark, ["What is Recall@5 和 验收标准?"], retrieve.query_terms) == [["what", "is", "recall@5", "验收标准"]]
    df = spark.createDataFrame([("alpha beta gamma delta", "alpha beta gamma delta", "normal"), ("alpha", "Alpha", "metric"), ("%", "x", "metric"), ("Recall alpha", "alpha", "metric")], "q string, t string, k string")
    assert [round(r[0], 6) for r in df.select(retrieve.lexical_boost(F.col("q"), F.col("t"), F.col("k"))).collect()] == [0.08, 0.025, 0.0, 0.075]


def test_ranking_metrics(spark):
    hits = spark.createDataFrame([(1, r, rel) for r, rel in enumerate((0, 1, 1, 0, 1), 1)] + [(2, 1, 0)], "query_id int, rank int, rel int")
    totals = spark.createDataFrame([(1, 4), (2, 0)], "query_id int, total long")
    got = {r["query_id"]: r for r in evaluate.ranking_metrics(hits, totals).collect()}
    one = got[1]
    assert [one[f"recall_{k}_e6"] for k in (1, 3, 5)] == [0, 500000, 750000] and [one[f"precision_{k}_e6"] for k in (1, 3, 5)] == [0, 666667, 600000]
    assert [one[f"ndcg_{k}_e6"] for k in (1, 3, 5)] == [0, 530721, 592512] and one["mrr_e6"] == 500000
    assert all(got[2][c] == 0 for c in got[2].asDict() if c != "query_id")


def test_judging_and_reports(spark):
    df = spark.createDataFrame([(["a", "b", "c"], "A only", 0.0), (["a", "b", "c"], "a with 5%", 0.0), (["a", "b", "c", "d"], "a", 0.5), (["z"], "none", 0.6), ([], "x", 0.5)], "k array<string>, t string, s double")
    assert [r[0] for r in df.select(evaluate.is_relevant(F.col("k"), F.col("t"), F.col("s"))).collect()] == [False, True, False, True, True]
    assert evaluate.grid(spark).count() == 2400
    scores = spark.createDataFrame([(1, "s", 3), (1, "b", 2), (2, "s", 1), (2, "b", 1)], "item int, strategy string, score int")
    assert {tuple(r) for r in evaluate.winners(scores).collect()} == {("s", 1, 1), ("b", 0, 1)}
    human = spark.createDataFrame([("a", "e", 1), ("a", "f", 1), ("b", "e", 0), ("b", "e", None)], "doc_group string, evaluator string, score int")
    assert [(r["n"], r["complete"], r["passed"]) for r in evaluate.human_rates(human).where("level = 3").collect()] == [(3, 2, False)]
    chunks = spark.createDataFrame([("d", f"c{i}") for i in range(9)], "doc_id string, chunk_id string")
    a, b = ({r["chunk_id"] for r in evaluate.sample_per_doc(chunks.repartition(n), 3).collect()} for n in (1, 4))
    assert a == b and len(a) == 3


def test_qa(spark):
    df = spark.createDataFrame([("alpha beta gamma", "alpha beta delta"), ("", "x"), (None, None), ("word", "a Word b")], "a string, c string")
    got = [tuple(r[0]) for r in df.select(qa.lexical_quality(F.col("a"), F.col("c"))).collect()]
    assert got == [(3, 2, 2, 1, True, True), (0, 0, 0, 0, False, False), (0, 0, 0, 0, False, False), (1, 1, 1, 1, True, True)]
    assert qa.evaluator("missing") is qa.lexical_quality
    answers = ['```json\n[{"question": "q", "answer": "a"}, {"question": " ", "answer": "b"}]\n```', 'so: [{"question": "q2", "answer": "a2"}] ok', "nothing", None, "[broken"]
    x = spark.createDataFrame(list(enumerate(answers)), "chunk_id int, answer string")
    assert [(r["qa_id"], r["question"]) for r in qa.parse_pairs(x).orderBy("chunk_id").collect()] == [("0_qa_0001", "q"), ("1_qa_0001", "q2")]
    texts = ["x" * 299, "x" * 300, "http://a " * 40, "short line\n" * 40, "a much longer line of words than forty characters\n" * 10]
    assert values(spark, texts, lambda c: qa.is_worthy(c, F.lit("normal"))) == [False, True, False, False, True]


def test_store(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "doc_id string, v string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "doc_id string, v string")
    assert {tuple(r) for r in store.upsert(old, new, "doc_id").collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    assert [r["doc_id"] for r in store.delete(old, new, "doc_id").collect()] == ["a"]
    docs = spark.createDataFrame([("a", "s1", "ready", 0), ("b", "s2", "processing", 0)], "doc_id string, file_sha256 string, status string, chunk_count int")
    incoming = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s3"), ("c", "s4")], "doc_id string, file_sha256 string")
    assert {tuple(r) for r in store.changed(docs, incoming).collect()} == {("b", "s2"), ("c", "s3")}
    d = docs.withColumn("last_error", F.lit(None).cast("string"))
    outcome = spark.createDataFrame([("a", None, "boom"), ("b", 3, None)], "doc_id string, chunk_count int, last_error string")
    assert {(r["doc_id"], r["status"], r["chunk_count"], r["last_error"]) for r in store.ready(d, outcome).collect()} == {("a", "failed", 0, "boom"), ("b", "ready", 3, None)}
    assert [tuple(r) for r in spark.createDataFrame([([3, 1],), ([],)], "p array<int>").select(*store.page_bounds(F.col("p"))).collect()] == [(1, 3), (-1, -1)]


def docx(paragraphs, rows):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    para = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{"".join(para(*p) for p in paragraphs)}{table}</w:body></w:document>')
        z.writestr("word/media/b.png", b"B")
        z.writestr("word/media/a.jpeg", b"A")
    return out.getvalue()


def test_sources(spark, tmp_path):
    payload = docx([("Title", "Heading1"), ("body text",)], [["a", "b"], ["", ""], ["c"]])
    assert files.word_blocks(payload) == [("p0001", "heading", "Title"), ("p0002", "", "body text"), ("t0001", "table", "| a | b |\n| --- | --- |\n| c |  |")]
    assert files.word_images(payload) == [("img_001.jpeg", b"A"), ("img_002.png", b"B")] and files.word_blocks(b"no") == [] == files.word_images(None)
    for name, data in (("one.txt", "héllo".encode()), ("two.MD", "中文".encode("gb18030")), ("three.docx", payload), ("four.xyz", b"?"), ("bad name!.txt", b"\xff\xff\xff")):
        (tmp_path / name).write_bytes(data)
    got = {r["doc_id"]: (r["text"], r["error"]) for r in files.texts(files.read_files(spark, str(tmp_path))).collect()}
    assert got["one"] == ("héllo", None) and got["two"] == ("中文", None) and got["three"][0].startswith("Title\n\nbody text\n\n| a") and got["four"][1] == "unsupported file type: .xyz"
    assert got["bad_name"][0] is not None
    scores = spark.createDataFrame([("d", 'line\n"two"', "1")], "doc_id string, content string, score string")
    files.write_scores(scores, f"{tmp_path}/scores")
    assert files.read_scores(spark, f"{tmp_path}/scores").collect() == scores.collect()
    files.write_json_lines(scores, f"{tmp_path}/json")
    assert [json.loads(x.value)["doc_id"] for x in spark.read.text(f"{tmp_path}/json").collect()] == ["d"]


@pytest.mark.parametrize("changed", [False, True])
def test_incremental_ingest(spark, tmp_path, changed):
    source, docs, chunks = (f"{tmp_path}/{x}" for x in ("in", "docs", "chunks"))
    schema = "doc_id string, text string"
    spark.createDataFrame([("a", "# T\nsome words"), ("b", "other text"), ("e", "")], schema).coalesce(1).write.parquet(source)
    run = lambda: ingest_stream(spark.readStream.schema(schema).parquet(source), docs, chunks, f"{tmp_path}/cp").awaitTermination()
    run()
    before = {r["chunk_id"]: r["content"] for r in store.read_table(spark, chunks, CHUNKS).collect()}
    assert set(before) == {"a_chunk_0001", "b_chunk_0001"}
    spark.createDataFrame([("b", "new text" if changed else "other text")], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    after = {r["chunk_id"]: r["content"] for r in store.read_table(spark, chunks, CHUNKS).collect()}
    assert after == before | ({"b_chunk_0001": "new text"} if changed else {})
    assert {(r["doc_id"], r["status"], r["chunk_count"]) for r in store.read_table(spark, docs, DOCS).collect()} == {("a", "ready", 1), ("b", "ready", 1), ("e", "ready", 0)}
