"""Versioned tables, statuses of ingest, settings, searches, judgements and range records."""

import io
import json
import math
import re
import time
import zipfile
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill import settings
from corpusmill.functions import fixed as K
from corpusmill.operators import organize, parse, qa, ranges, reports, search, segment, store
from corpusmill.operators.segment import SegmentConfig
from corpusmill.sources import files
from corpusmill.streaming import ingest


def test_a_writer_that_dies_leaves_the_last_version(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id int"
    one = spark.createDataFrame([(1,)], schema)
    assert store.read_table(spark, path, schema).count() == 0
    store.write_version(one, path)
    # A writer that died: files, but no mark of success.
    (tmp_path / "t" / "v2").mkdir()
    (tmp_path / "t" / "v2" / "part-0.parquet").write_bytes(b"half")
    assert [r["id"] for r in store.read_table(spark, path, schema).collect()] == [1]
    bad = one.select(F.raise_error(F.lit("lost")).cast("int").alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.write_version(bad, path)
    assert [r["id"] for r in store.read_table(spark, path, schema).collect()] == [1]
    for i in (2, 3, 4):
        store.write_version(store.read_table(spark, path, schema).unionByName(spark.createDataFrame([(i,)], schema)), path)
    assert sorted(r["id"] for r in store.read_table(spark, path, schema).collect()) == [1, 2, 3, 4]
    assert len(list((tmp_path / "t").glob("v*"))) == 2


def test_ingest_goes_through_its_statuses(spark, tmp_path):
    docs, chunks = f"{tmp_path}/docs", f"{tmp_path}/chunks"
    schema = "doc_id string, text string, error string"
    seen = []

    def watched(batch):
        seen.append({r["doc_id"]: r["status"] for r in store.read_table(spark, docs, ingest.DOCS).collect()})
        return ingest.default_chunks(batch)

    first = spark.createDataFrame([("a", "# T\n\nSome words stand here.", None), ("b", None, "cannot be read")], schema)
    ingest.ingest_batch(spark, first, docs, chunks, watched)
    assert seen == [{"a": "processing", "b": "processing"}]
    got = {r["doc_id"]: (r["status"], r["chunk_count"], r["last_error"]) for r in store.read_table(spark, docs, ingest.DOCS).collect()}
    assert got == {"a": ("ready", 1, None), "b": ("failed", 0, "cannot be read")}
    ingest.ingest_batch(spark, first.where("doc_id = 'a'"), docs, chunks, watched)
    assert len(seen) == 1  # ready with the same content: nothing is done

    def broken(batch):
        raise RuntimeError("no chunker")

    second = spark.createDataFrame([("a", "# T\n\nOther words.", None), ("c", "New.", None)], schema)
    with pytest.raises(RuntimeError):
        ingest.ingest_batch(spark, second, docs, chunks, broken)
    got = {r["doc_id"]: (r["status"], r["last_error"]) for r in store.read_table(spark, docs, ingest.DOCS).collect()}
    assert got == {"a": ("failed", "no chunker"), "b": ("failed", "cannot be read"), "c": ("failed", "no chunker")}
    assert store.read_table(spark, chunks, ingest.CHUNKS).count() == 1  # what was stored stays
    ingest.ingest_batch(spark, second, docs, chunks)
    got = {r["doc_id"]: (r["status"], r["chunk_count"]) for r in store.read_table(spark, docs, ingest.DOCS).collect()}
    assert got == {"a": ("ready", 1), "b": ("failed", 0), "c": ("ready", 1)}
    assert "Other words." in [r["content"].split("\n")[-1] for r in store.read_table(spark, chunks, ingest.CHUNKS).where("doc_id = 'a'").collect()][0]


def test_documents_and_their_chunks(spark):
    docs = spark.createDataFrame([("a", "a.md", "ready"), ("b", "b.md", "failed")], "doc_id string, file_name string, status string")
    chunks = store.with_ordinals(spark.createDataFrame([("a", 7, "y"), ("a", 3, "x"), ("z", 1, "lost")], "doc_id string, at int, content string"), "at")
    assert [(r["ordinal"], r["content"]) for r in store.chunks_of(docs, chunks, "a").collect()] == [(1, "x"), (2, "y")]
    assert store.chunks_of(docs, chunks, "b").count() == 0
    with pytest.raises(KeyError):
        store.chunks_of(docs, chunks, "z")
    assert [(r["doc_id"], r["ordinal"]) for r in store.all_chunks(docs, chunks).collect()] == [("a", 1), ("a", 2)]
    assert store.migrated(docs.drop("status"), "doc_id string, status string, size int").collect()[0] == ("a", None, None)
    j = store.json_decoded(spark.createDataFrame([('["a"]',), ("{",), (None,), ('{"x":1}',)], "c string"), "c", "array<string>", F.array())
    assert [r["c"] for r in j.collect()] == [["a"], [], [], []]


def test_settings(tmp_path):
    path = tmp_path / "deep" / "s.json"
    assert settings.read_settings(path) == settings.DEFAULTS
    path.parent.mkdir()
    for text in ("{", "[1]", "null", '{"model": "  "}'):
        path.write_text(text)
        assert settings.read_settings(path) == settings.DEFAULTS
    settings.write_settings(path, {"model": " m ", "api_key": "k", "other": 1})
    settings.write_settings(path, {"base_url": ""})
    assert json.loads(path.read_text()) == settings.DEFAULTS | {"model": "m", "api_key": "k"} and len(list(path.parent.iterdir())) == 1
    for bad in (SegmentConfig(min_chars=0), SegmentConfig(overlap=-1), SegmentConfig(target_chars=900)):
        with pytest.raises(ValueError):
            settings.validated(bad)
    assert settings.validated(SegmentConfig()) and settings.default_config()["target_chars"] == 550


CHUNKS = [("d", 1, "d1", "alpha beta gamma", None), ("d", 2, "d2", "alpha beta gamma", None), ("d", 3, "d3", "delta  epsilon alpha", "metric"), ("e", 1, "e1", "Beta BETA beta 95%", "metric"), ("d", 4, "d4", "", None)]


def test_search_by_vectors_and_tfidf(spark):
    chunks = spark.createDataFrame(CHUNKS, "doc_id string, ordinal int, chunk_id string, content string, chunk_type string")
    asked = spark.createDataFrame([("q1", "d", "alpha beta"), ("q2", "e", "beta"), ("q3", "none", "x")], "query_id string, doc_id string, question string")
    with pytest.raises(ValueError):
        search.Store.of(chunks.where("false"))
    held = search.Store.of(chunks)
    with pytest.raises(KeyError):
        held.search(asked, strict=True)
    assert [r["doc_id"] for r in held.documents().collect()] == ["d", "e"] and [r["query_id"] for r in held.unknown(asked).collect()] == ["q3"]
    got = [(r["query_id"], r["rank"], r["chunk_id"]) for r in held.search(asked, 2).orderBy("query_id", "rank").collect()]
    assert got == [("q1", 1, "d2"), ("q1", 2, "d1"), ("q2", 1, "e1")]  # of equal chunks the later one is first
    replaced = held.replaced(spark.createDataFrame([("d", 1, "n1", "alpha", None)], chunks.schema))
    assert {(r["doc_id"], r["chunk_count"]) for r in replaced.summary().collect()} == {("d", 1), ("e", 1)}

    def grams(t):
        t = re.sub(r"\s\s+", " ", t.lower())
        return Counter(t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1))

    texts = {c[2]: c[3] for c in CHUNKS if c[0] == "d"}
    counts = {k: grams(t) for k, t in texts.items()}
    df = Counter(g for c in counts.values() for g in c)
    idf = {g: math.log((1 + len(texts)) / (1 + n)) + 1 for g, n in df.items()}

    def vector(c):
        v = {g: (1 + math.log(n)) * idf[g] for g, n in c.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {g: x / norm for g, x in v.items()}

    q = vector(grams("alpha beta"))
    want = {k: sum(x * vector(c).get(g, 0) for g, x in q.items()) for k, c in counts.items()}
    got = {r["chunk_id"]: r["similarity_e6"] for r in search.Store.of(chunks, "tfidf", rank="none").search(asked, 10).where("query_id = 'q1'").collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k] * 1e6) <= 1 for k in want)


def test_registered_encoders_and_answers(spark):
    search.register_encoder("length", lambda t: F.array(F.struct(F.lit(0).alias("bucket"), F.length(t).alias("n"))))
    assert search.encoder("length") is not search.encoder("missing") is search.encoder()
    hits = spark.createDataFrame([("q", 2, ["A", "B"], "x" * 900, "why"), ("q", 1, [], "first", "why")], "query_id string, rank int, title_path array<string>, content string, question string")
    (r,) = search.answered(hits, lambda prompt: F.concat(F.lit("n="), F.length(prompt).cast("string"))).collect()
    assert r["prompt"].startswith("文档片段：\n[无标题]\nfirst\n\n---\n\n[A > B]\nx") and r["prompt"].count("x") == 800 and r["answer"] == f"n={len(r['prompt'])}"
    assert search.answered(hits).first()["answer"] == ""


def test_statistics_of_chunks(spark):
    rows = [("a", "x" * 200 + ".", "normal", ["b1"], []), ("a", "half", "table", [], ["undersized"]), ("a", "| t |", "code", ["b2"], ["Row_SPLIT"]), ("a", " ", "formula", ["b3"], [])]
    chunks = spark.createDataFrame(rows, "doc_id string, content string, chunk_type string, source_ids array<string>, quality_flags array<string>")
    got = {r["doc_id"]: r.asDict() for r in reports.chunk_statistics(chunks, documents=spark.createDataFrame([("a",), ("none",)], "doc_id string")).collect()}
    assert set(got["none"].values()) == {"none", 0}
    a = got["a"]
    assert (a["chunk_count"], a["avg_chars_e2"], a["length_hit_e6"], a["undersized"], a["refs_e6"]) == (4, round((201 + 4 + 5 + 1) / 4 * 100), 250_000, 1, 750_000)
    assert a["intact_e6"] == 333_333  # the table is whole; the code is flagged, the formula empty


def test_evaluation_and_reports(spark, tmp_path):
    rows = [("g", s, "recall@5", v) for s, v in (("s", 0.6), ("s", 0.5), ("h", 0.5), ("h", 0.5), ("f", 0.5), ("f", 0.4))]
    got = {r["grp"]: r for r in reports.evaluation(spark.createDataFrame(rows, "grp string, strategy string, metric string, value double"), "s", "h", "f").collect()}
    assert (got[None]["main_e6"], got[None]["over_base_e6"], got[None]["total_gain"], got[None]["semantic_gain"], got[None]["passed"]) == (550_000, 100_000, 222, 100, True)
    df = spark.createDataFrame([(1, "a|b\nc")], "n int, t string")
    assert "| 1 | a\\|b c |" in reports.report_markdown("R", [("part", df)])
    assert json.loads(reports.report_json(df)) == {"n": 1, "t": "a|b\nc"}
    reports.write_with_stats(df, df.agg(F.count("*").alias("n")), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out.stats").first()["n"] == 1


def test_judgements_of_models(spark):
    answers = ['{"answerable_score": 8, "faithful_score": 6, "brief_reason": "r"}', '```json\n{"answerable_score": 7, "faithful_score": 10}\n```', "", None, "no", "[1]", "{}", '{"answerable_score": 9}']
    got = [r["v"] for r in spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string").select("i", qa.judged(F.col("a")).alias("v")).orderBy("i").collect()]
    assert [(v["answerable"], v["faithful"], v["error"]) for v in got] == [(True, False, None), (True, True, None), (False, False, "no answer"), (False, False, "no answer"), (False, False, "unreadable answer"), (False, False, "unreadable answer"), (False, False, None), (True, False, None)]


def test_synthesis(spark):
    text = "Words that answer questions stand in this chunk. " * 10
    chunks = spark.createDataFrame([("c1", "d", "normal", text), ("c2", "d", "code", text)], "chunk_id string, doc_id string, chunk_type string, content string")
    pairs = qa.synthesized(chunks, lambda content: F.lit('```json\n[{"question": "Q?", "answer": "words that answer questions"}, {"question": "", "answer": "x"}]\n```'))
    assert [(r["chunk_id"], r["source_doc"], r["answerable"], r["faithful"]) for r in pairs.collect()] == [("c1", "d", True, True)]
    r = reports.qa_report(pairs).first()
    assert (r["total"], r["documents"], r["both_e6"], r["passed"]) == (1, 1, 1_000_000, True)
    judged = qa.synthesized(chunks, lambda content: F.lit('[{"question": "Q?", "answer": "a"}]'), lambda prompt: F.lit('{"answerable_score": 9, "faithful_score": 3}'))
    assert [(r["answerable"], r["faithful"]) for r in judged.collect()] == [(True, False)]


def test_range_records(spark):
    blocks = spark.createDataFrame([("d", i, f"b{i}", t) for i, t in enumerate(["aaaa", "bbbb", "  ", "c" * 30, "dd"])], "doc_id string, i int, block_id string, text string")
    spans = spark.createDataFrame([("d", 0, 0, 3, "T", "why"), ("d", 1, 4, 4, None, None)], "doc_id string, nth int, start int, stop int, title string, reason string")
    got = [(r["chunk_id"], r["chunk_title"], r["content"], r["block_ids"], r["chunk_summary"]) for r in ranges.records(blocks, spans, 12).orderBy("chunk_id").collect()]
    assert got == [("d_ai_chunk_0001", "T", "aaaa\n\nbbbb", "b0,b1", "why"), ("d_ai_chunk_0002", "T（续2）", "c" * 30, "b3", "why"), ("d_ai_chunk_0003", "未命名分段", "dd", "b4", "")]
    answers = ['{"ranges": [{"start": 0, "end": 2, "title": "a"}]}', '```json\n[{"start": 1, "end": 1}]\n```', "none", None]
    found = [r["v"] for r in spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string").select("i", ranges.parsed_ranges(F.col("a")).alias("v")).orderBy("i").collect()]
    assert [[(x["start"], x["stop"]) for x in v] for v in found] == [[(0, 2)], [(1, 1)], [], []]


def test_chunks_are_of_cleaned_blocks(spark):
    text = "# 目录\n\n目录\n\n1 Intro ........ 3\n\n# Intro\n\nSome words stand here, and they go on.\n"
    blocks = parse.blocks(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    content = "\n".join(r["content"] for r in segment.segmented(blocks).collect())
    assert "Some words stand here" in content and "......" not in content


def brute_cuts(text, size):
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            ahead = text[end : end + size // 2]
            ends = [m.end() for m in re.finditer("[.!?。！？]", ahead)]
            end += ahead.index("\n") + 1 if "\n" in ahead else ends[-1] if ends else 0
        out.append((at, min(end, len(text))))
        at = end
    return out


def test_fixed_cuts_are_linear():
    for text in ("", "a", "a b. c\nd" * 100, "x" * 2000, "é。" * 700):
        for size in (5, 64, 512):
            assert list(segment.fixed_cuts(text, size)) == brute_cuts(text, size)
    long, began = "word and word. " * 400_000, time.time()
    assert sum(hi - lo for lo, hi in segment.fixed_cuts(long, 512)) == len(long) and time.time() - began < 3


def test_organised_with_and_without_a_model(spark):
    chunks = spark.createDataFrame([("c1", "d", 1, "Spark reads tables. Spark writes tables. Others do not."), ("c2", "d", 2, "  "), ("c3", "d", 3, None)], "chunk_id string, doc_id string, nth int, content string")
    each, whole = organize.organized_batch(chunks)
    got = {r["chunk_id"]: r for r in each.collect()}
    assert got["c1"]["source"] == "rule" and "Spark" in "".join(got["c1"]["tags"]) and got["c1"]["summary"]
    assert all((got[c]["tags"], got[c]["summary"], got[c]["entities"], got[c]["source"]) == ([], "", [], "empty") for c in ("c2", "c3"))
    assert whole.first()["summary"] == got["c1"]["summary"]
    model = lambda prompt: F.when(prompt.startswith("tags"), "- one, two").when(prompt.startswith("entities"), "person: Ada")
    r = {r["chunk_id"]: r for r in organize.organized(chunks, model).collect()}["c1"]
    assert r["tags"] == ["one", "two"] and [tuple(e) for e in r["entities"]] == [("person", "Ada")] and r["summary"] == got["c1"]["summary"] and r["source"] == "model"


def test_protected_types_have_statistics():
    assert {"table", "code", "formula"} <= set(K.PROTECTED)


def pdf(*pages, deflate=False):
    """A plain PDF file of pages with the given content streams."""
    body = [b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"2 0 obj << /Type /Pages /Count %d >> endobj" % len(pages)]
    for i, content in enumerate(pages):
        data = zlib.compress(content) if deflate else content
        body.append(b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj" % (10 + 2 * i, 11 + 2 * i))
        body.append(b"%d 0 obj << /Length %d %s>> stream\n%s\nendstream endobj" % (11 + 2 * i, len(data), b"/Filter /FlateDecode " if deflate else b"", data))
    return b"%PDF-1.4\n" + b"\n".join(body) + b"\n%%EOF"


def test_pdf_files(spark, tmp_path):
    first, second = b"BT (Hello \\(you\\)) Tj 0 -12 Td [(wor) -20 (ld)] TJ ET", b"BT <FEFF4E2D6587> Tj ET BT (---) Tj ET"
    for deflate in (False, True):
        assert files.pdf_pages(pdf(first, second, deflate=deflate)) == ["Hello (you)\nworld", "中文\n---"]
    for bad in (b"no", b"%PDF /Encrypt"):
        with pytest.raises(ValueError):
            files.pdf_pages(bad)
    rows = spark.createDataFrame([("a", pdf(first, second)), ("b", b"broken")], "doc_id string, payload binary")
    pages = files.pdf_page_rows(rows)
    assert {(r["doc_id"], r["page"], r["error"]) for r in pages.collect()} == {("a", 1, None), ("a", 2, None), ("b", None, "unreadable PDF: not a readable PDF file")}
    blocks = [(r["block_id"], r["page"], r["text"]) for r in files.page_blocks(pages).orderBy("block_id").collect()]
    assert blocks == [("p0001_b0000", 1, "Hello (you)\nworld"), ("p0002_b0000", 2, "中文")]
    custom = files.pdf_page_rows(rows, lambda data: ["one", "two"])
    assert custom.count() == 4


def test_files_of_one_name_broken_archives_and_images(spark, tmp_path):
    (tmp_path / "in" / "x").mkdir(parents=True)
    for at, data in (("a.txt", b"one"), ("x/a.txt", b"two"), ("b.pdf", pdf(b"BT (page) Tj ET")), ("c.pdf", b"junk"), ("none", b"?")):
        (tmp_path / "in" / at).write_bytes(data)
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<a/>" * 500)
        z.writestr("word/media/p.png", b"\x01\x02")
    broken = bytearray(whole.getvalue())
    broken[45:60] = b"\xff" * 15
    assert files.word_blocks(bytes(broken)) == []
    (tmp_path / "in" / "d.docx").write_bytes(whole.getvalue())
    found = files.read_files(spark, str(tmp_path / "in"))
    got = {r["doc_id"]: (r["text"], r["error"]) for r in files.texts(found).collect()}
    assert len(got) == 6 and sorted(t for t, _ in got.values() if t) == ["one", "page", "two"]
    assert got["c"][1].startswith("unreadable PDF") and got["none"][1] == "unsupported file type: "
    for _ in range(2):
        files.write_images(files.images(found), f"{tmp_path}/images")
    assert spark.read.parquet(f"{tmp_path}/images").count() == 1
    assert files.image(spark, f"{tmp_path}/images", "d", "img_001.png") == b"\x01\x02"
    with pytest.raises(KeyError):
        files.image(spark, f"{tmp_path}/images", "d", "img_002.png")
    with pytest.raises(FileNotFoundError):
        files.read_file(spark, f"{tmp_path}/in/missing.txt")
    with pytest.raises(ValueError):
        files.read_file(spark, f"{tmp_path}/in/none")
    assert files.texts(files.read_file(spark, f"{tmp_path}/in/b.pdf")).first()["text"] == "page"
    with pytest.warns(UserWarning, match="no document for zz"):
        assert files.corpus(spark, str(tmp_path / "in"), ["b", "zz"]).count() == 1
    with pytest.raises(FileNotFoundError):
        files.corpus(spark, str(tmp_path / "in"), ["zz"], strict=True)
    (tmp_path / "q.json").write_text('{"doc_id": "b", "questions": [{"question": "Q1", "answer_keywords": ["k"]}, {"question": "Q2"}]}\n')
    assert [(r["qid"], r["question"], r["answer_keywords"]) for r in files.read_questions(spark, str(tmp_path / "q.json")).orderBy("qid").collect()] == [(1, "Q1", ["k"]), (2, "Q2", [])]
    (tmp_path / "s.csv").write_bytes(b"\xef\xbb\xbfdoc_id,score\nb,1\n")
    assert files.read_scores(spark, str(tmp_path / "s.csv")).columns == ["doc_id", "score"]
