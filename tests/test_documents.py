"""Parsing, cleaning, chunking and enrichment on literals and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import clean, enrich, organize, parse, ranges, segment
from corpusmill.operators.segment import Block, SegmentConfig, Segmenter


def values(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r["v"] for r in df.select("i", expr(F.col("x")).alias("v")).orderBy("i").collect()]


def doc(spark, text):
    return spark.createDataFrame([("d", text)], "doc_id string, text string")


def test_auto_config():
    for total, want in ((2999, (150, 300, 600, 120)), (3000, (225, 450, 900, 150)), (10000, (325, 650, 1300, 216)), (50000, (425, 850, 1700, 283)), (200000, (550, 1100, 2200, 366)), (0, (180, 550, 800, 240))):
        c = SegmentConfig.auto(total)
        assert (c.min_chars, c.target_chars, c.max_chars, c.heading_flush) == want


def test_headings(spark):
    yes = ["3.14", "12 apples", "2024. Foo", "Abstract", "# x", "第一章 绪论", "related WORK"]
    no = ["1) x", "1.", "#x", "1. Intro    - 4 -", "1 " + "x" * 80, "", "plain"]
    assert values(spark, yes + no, parse.is_heading) == [True] * len(yes) + [False] * len(no)
    assert values(spark, ["## a", "1.2.3 a", "一、a", "第1章 a", "Abstract", "other"], parse.heading_level) == [2, 3, 2, 1, 1, 3]
    assert values(spark, ["## A b ##", "1.1 x"], parse.heading_title) == ["A b", "1.1 x"]


def test_line_classes(spark):
    lines = ["**bold**", "---", "-5", "-", "• x", "| a | b |", "a | b", "|", "![a](b)", "<IMG src=x>", "text", "", "| --- | :-: |"]
    assert values(spark, lines, parse.line_class) == ["U", "U", "U", "M", "U", "T", "T", "P", "I", "I", "P", "B", "T"]


def test_block_types(spark):
    texts = ["| a | b |\n| --- | ---: |\n| 1 | 2 |", "A | B | C …", "a = b", "$$x\ny$$", "```\ncode", "![a](b)\n<img x>", "plain text", "# h"]
    assert values(spark, texts, parse.block_type) == ["table", "paragraph", "formula", "formula", "code", "image", "paragraph", "heading"]


def test_raw_blocks_merge_lines_and_markers(spark):
    got = [(r["raw"], r["text"]) for r in parse.raw_blocks(doc(spark, "p1\np2\n\n•\np3\np4")).orderBy("raw").collect()]
    assert got == [(0, "p1\np2"), (1, "• p3"), (2, "p4")]


def test_fences_reopen_and_lose(spark):
    text = "```\na\n```\n\nn1\n\n```\nb\n```\n\nn2"
    got = [(r["raw"], r["text"], r["block_type"]) for r in parse.blocks(doc(spark, text)).orderBy("raw").collect()]
    assert got == [(2, "```\nb\n```\n\nn2", "code")]
    assert parse.blocks(doc(spark, None)).count() == 0 and parse.blocks(doc(spark, "")).count() == 0


def test_title_paths(spark):
    text = "# A\nx\n## B\ny\n### C\nz\n## D\nw\n# E\nv"
    got = [(r["text"], list(r["title_path"])) for r in parse.title_paths(doc(spark, text)).where("block_type = 'paragraph'").orderBy("raw").collect()]
    assert got == [("x", ["A"]), ("y", ["A", "B"]), ("z", ["A", "B", "C"]), ("w", ["A", "D"]), ("v", ["E"])]


def test_cleaning(spark):
    assert values(spark, ["学号：123", "报告名称: 同类方案调研", "2024年5月6日", "word: value xyz", "plain sentence here", "小组   组"], clean.is_cover) == [True, True, True, True, False, True]
    assert values(spark, ["目 录", "1.1 标题  5", "Intro .... 7", "12 apples and 5", "text"], clean.is_toc) == [True, True, True, True, False]
    assert values(spark, ["| a | b |\n| --- | --- |\n| c |  |", "x\n|y|"], clean.flatten_table) == ["a\n\nb\n\nc", "x\n\ny"]


def test_sentences_tokens_boundaries(spark):
    assert values(spark, ["v 3.14 ok. b", "...", ""], T.sentences) == [["v 3.", "14 ok.", "b"], ["..."], [""]]
    assert values(spark, ["end。", "end.", "end!", "a:", "(x)", "", "x； "], T.ends_at_boundary) == [True, False, False, False, False, True, True]
    assert values(spark, ["a_b 中文 c!", None], T.token_count) == [5, 0]
    assert values(spark, [["A", "b", "a", "B", "c"]], T.dedupe_ci, "array<string>") == [["A", "b", "c"]]
    assert values(spark, [["a", "b", "c"], ["a"], []], lambda c: T.word_ngrams(c, 2), "array<string>") == [["a b", "b c"], ["a"], []]
    assert values(spark, ["http://x.y/é_1", "__", None], T.safe_doc_id) == ["http___x_y_é_1", "doc", "doc"]


def cut_plain(text, size):
    """Sequential form of the fixed-length cuts."""
    cuts, prev = [], 0
    while prev < len(text):
        target = prev + size
        if target >= len(text):
            cuts.append(len(text))
            break
        ahead = text[target : min(target + size // 2, len(text))]
        ends = [i + 1 for i, ch in enumerate(ahead) if ch in ".!?。！？"]
        prev = target + (ahead.index("\n") + 1 if "\n" in ahead else ends[-1] if ends else 0)
        cuts.append(prev)
    return cuts


def test_fixed_cuts(spark):
    texts = ["x" * 30, "ab. cd\nef " * 9, "a.b!c?" * 11, "no ends here " * 7, " ", "\n" * 25, "。" * 40]
    assert [[hi for _, hi in segment.fixed_cuts(t, 10)] for t in texts] == [cut_plain(t, 10) for t in texts]
    (one,) = segment.fixed_chunks(doc(spark, " short ")).collect()
    assert one["content"] == "short"
    assert segment.fixed_chunks(doc(spark, None)).count() == 0


WORDS = st.lists(st.sampled_from(["alpha", "beta.", "gamma;", "中文。", "delta", "x", "99%", "end!"]), min_size=1, max_size=80).map(" ".join)


@given(st.lists(st.tuples(st.sampled_from(["paragraph", "heading", "table", "code"]), WORDS), max_size=12), st.sampled_from([SegmentConfig(40, 120, 200), SegmentConfig.headings_only(), SegmentConfig.auto(100)]))
@settings(max_examples=150, deadline=None)
def test_segmenter_keeps_all_text_within_limits(parts, config):
    blocks = [Block(f"b{i}", t[:60] if k == "heading" else t, k, 1 + i % 3 if k == "heading" else 0, t[:60] if k == "heading" else "") for i, (k, t) in enumerate(parts)]
    pieces = Segmenter(config).run(blocks)
    squeeze = lambda t: "".join(t.split())
    every = squeeze("".join(p.content for p in pieces))
    for b in blocks:
        if b.kind in ("table", "code"):
            assert squeeze(b.text) in every
        elif b.kind == "paragraph":
            assert all(w in every for w in b.text.split())
    for p in pieces:
        assert p.content and p.blocks
        head = len(p.blocks[0].text) + 2 if p.blocks[0].kind == "heading" else 0
        assert p.fixed or p.kind == "metric" or p.chars <= config.max_chars + head + 82


def test_segmenter_rules():
    c = SegmentConfig(80, 400, 800)
    root, a, b = Block("b0", "# Root", "heading", 1, "Root"), Block("b1", "## A", "heading", 2, "A"), Block("b3", "## B", "heading", 2, "B")
    (only,) = Segmenter(c).run([root, a, Block("b2", "short text one", "paragraph"), b, Block("b4", "short text two", "paragraph")])
    assert only.path == ["Root", "A"] and only.titles == ["Root", "A", "B"]
    (metric,) = Segmenter(c).run([Block("b0", "# 验收标准", "heading", 1, "验收标准"), Block("b1", "不破句率: 100%\nRecall@5: +18%", "paragraph")])
    assert metric.kind == "metric" and metric.metrics == ["不破句率: 100%", "Recall@5: +18%"]
    table = Segmenter(c).run([a, Block("b1", "| a | b |\n| --- | --- |", "table"), Block("b2", "tail " * 120, "paragraph")])
    assert [p.kind for p in table] == ["table", "normal"] and table[0].content.startswith("## A\n\n|")
    assert Segmenter(c).run([root]) == [] and Segmenter(c).run([]) == []
    assert Segmenter.by_length("aaaa bbbb cccc", 6) == ["aaaa", "bbbb", "cccc"]
    s = Segmenter(SegmentConfig(overlap=1))
    assert s.packed(["one. ", "two. ", "three. "], 10) == ["one.two.", "two.three."]
    assert s.packed(["x" * 12, "y"], 10) == ["x" * 12, "y"]


def test_chunks_end_to_end(spark):
    text = "# Root\nintro " + "words here " * 30 + "\n## Part\n" + "more text; " * 60 + "\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n![i](x.png)"
    one = segment.chunks(parse.title_paths(doc(spark, text))).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in one] == list(range(1, len(one) + 1)) and one[0]["chunk_id"] == "d_chunk_0001"
    for r in one:
        assert r["char_count"] == len(r["content"]) and r["source_ids"]
        assert ("oversized" in r["quality_flags"]) == (r["char_count"] > r["max_chars"]) and ("undersized" in r["quality_flags"]) == (r["char_count"] < r["min_chars"])
    many = segment.chunks(parse.title_paths(spark.createDataFrame([(f"d{i}", text) for i in range(5)], "doc_id string, text string").repartition(5)))
    assert {r["content"] for r in many.collect()} == {r["content"] for r in one} and many.count() == 5 * len(one)


def test_enrichment(spark):
    assert values(spark, ["One. Two! Three？ four", "x" * 130, None, "a! " + "b" * 200], enrich.lead_summary) == ["One. Two!Three？four", "x" * 120, "", "a!" + "b" * 118]
    tags = values(spark, ['On 2024-05-06 v1.2 uses RAG and "quoted term", see 清华大学'], enrich.entity_tags)[0]
    assert tags[:3] == ["2024-05-06", "v1.2", "quoted term"] and "清华大学" in tags and "RAG" in tags
    kinds = values(spark, ["Recall@5 is 12.5% on 2024年5月6日 with V1.2 ≥ 3"], enrich.typed_entities)[0]
    assert [(k["type"], k["value"]) for k in kinds] == [("percentage", "12.5%"), ("threshold", "≥ 3"), ("metric", "Recall@5"), ("date", "2024年5月6日"), ("version", "V1.2")]
    df = spark.createDataFrame([(1, "apple apple pear with a1 ab pear apple kiwi")], "doc_id long, text string")
    assert [(r["rank"], r["term"], r["n"]) for r in enrich.keywords_freq(df, 2).orderBy("rank").collect()] == [(1, "apple", 3), (2, "pear", 2)]
    with pytest.raises(ValueError, match="unknown keyword strategy"):
        enrich.keyword_strategy("nope")
    chunks = spark.createDataFrame([("c1", "normal", ["Fruit list"], "apple apple pear"), ("c2", "table", [], "1 2")], "chunk_id string, chunk_type string, title_path array<string>, content string")
    assert {r["chunk_id"]: r["label"] for r in enrich.labels(chunks, "freq").collect()} == {"c1": ["Fruit", "list", "apple", "pear"], "c2": ["table"]}


def test_organizing(spark):
    df = spark.createDataFrame([(1, "cat dog cat bird the of")], "doc_id long, text string")
    assert [r["tag"] for r in organize.tags(df).orderBy("nth").collect()] == ["catdog", "dogbird", "cat", "dog", "bird"]
    assert values(spark, ["First one. Cat cat cat. Dog. Cat dog cat.", "Only. Two", ""], lambda c: organize.extractive_summary(c, 30)) == ["First one.Cat cat cat.Cat dog ", "Only.Two", ""]
    s = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "")], "doc_id long, nth int, summary string")
    assert organize.document_summary(s).first()["summary"] == "a；b"
    assert values(spark, ["- a, b，" + "x" * 30 + "\n# c"], organize.parse_tags) == [["a", "b", "c"]]
    assert [tuple(e) for e in values(spark, ["org: X\nbad\ndate：2024"], organize.parse_entities)[0]] == [("org", "X"), ("date", "2024")]


def test_ranges(spark):
    assert [[tuple(r) for r in x] for x in values(spark, [[5, 5, 5], [20], [], [3, 30, 3]], lambda c: ranges.rule_ranges(c, 12), "array<int>")] == [[(0, 0), (1, 1), (2, 2)], [(0, 0)], [], [(0, 0), (1, 1), (2, 2)]]
    raw = [[(2, 3), (3, 5)], [(0, 99)], [], [(1, 0), (4, 4)], [(9, 9)]]
    got = values(spark, [[{"start": a, "stop": b} for a, b in r] for r in raw], lambda c: ranges.sanitized(c, F.lit(6)), "array<struct<start:int,stop:int>>")
    assert [[tuple(x) for x in g] for g in got] == [
        [(0, 1, False), (2, 3, True), (4, 5, True)],
        [(0, 5, True)],
        [(0, 5, False)],
        [(0, 3, False), (4, 4, True), (5, 5, False)],
        [(0, 5, False)],
    ]
    blocks = spark.createDataFrame([("d", i, f"t{i}") for i in range(4)], "doc_id string, i int, text string")
    spans = spark.createDataFrame([("d", 1, 0, 1), ("d", 2, 2, 3)], "doc_id string, nth int, start int, stop int")
    assert [r["content"] for r in ranges.materialized(blocks, spans).orderBy("nth").collect()] == ["t0\n\nt1", "t2\n\nt3"]
