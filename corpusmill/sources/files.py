"""Files as documents: text and Markdown, Word and PDF files, tables of scores, and sinks."""

from __future__ import annotations

import io
import re
import warnings
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from corpusmill.arrow import map_rows
from corpusmill.functions.text import has_text_signal, safe_doc_id
from corpusmill.operators.parse import block_type, raw_blocks

TEXT_SUFFIXES, WORD_SUFFIXES, PDF_SUFFIXES = (".txt", ".md", ".markdown"), (".docx",), (".pdf",)
SUFFIXES = (*TEXT_SUFFIXES, *WORD_SUFFIXES, *PDF_SUFFIXES)
#: What broken archives, parts of them and their XML raise.
_BROKEN = (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def decode_text(payload: bytes | None) -> str | None:
    """UTF-8 (a byte order mark stays), else GB 18030, else UTF-8 with replacements."""
    if payload is None:
        return None
    for encoding in ("utf-8", "gb18030"):
        try:
            return payload.decode(encoding)
        except UnicodeDecodeError:
            continue
    return payload.decode("utf-8", errors="replace")


def table_markdown(rows: list[list[str]]) -> str:
    """Rows of cells as a Markdown table: empty rows go, short ones are filled up, the first is the header."""
    rows = [[re.sub(r"\s*\n\s*", " ", c).strip() for c in r] for r in rows]
    rows = [r for r in rows if any(r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def word_blocks(payload: bytes | None) -> list[tuple[str, str, str]]:
    """(block_id, block_type, text) of a Word file: paragraphs, then tables; broken files give none."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(payload or b"")).read("word/document.xml"))
    except _BROKEN:
        return []
    body, out = root.find(f"{_W}body"), []
    if body is None:
        return []
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    for i, p in enumerate(body.findall(f"{_W}p"), 1):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        text, name = text_of(p).strip(), (style.get(f"{_W}val") or "") if style is not None else ""
        if p.find(f".//{_W}drawing") is not None:
            out.append((f"p{i:04d}", "image", f"[IMAGE: p{i:04d}]" + (f" {text}" if text else "")))
        elif text:
            out.append((f"p{i:04d}", "heading" if name.lower().startswith("heading") else "", text))
    for i, t in enumerate(body.findall(f"{_W}tbl"), 1):
        cells = [["\n".join(text_of(p) for p in c.findall(f"{_W}p")) for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")]
        if text := table_markdown(cells):
            out.append((f"t{i:04d}", "table", text))
    return out


def word_images(payload: bytes | None) -> list[tuple[str, bytes]]:
    """(name, bytes) of a Word file's media in order of their names; broken files give none."""
    try:
        z = zipfile.ZipFile(io.BytesIO(payload or b""))
        names = sorted(n for n in z.namelist() if n.startswith("word/media/") and not n.endswith("/"))
        return [(f"img_{i:03d}{'.' + n.rsplit('.', 1)[1] if '.' in n.rsplit('/', 1)[1] else ''}", z.read(n)) for i, n in enumerate(names, 1)]
    except _BROKEN:
        return []


#: Reads a PDF file's bytes into the text of its pages; raises ValueError on what it cannot read.
PdfDecoder = Callable[[bytes], list[str]]
_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|T\*|'|\"|\bT[djJDm]\b|\bET\b", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_pages(payload: bytes) -> list[str]:
    """The text that pages of a plain PDF show: streams as they are or deflated, strings in Latin-1 or UTF-16.

    Fonts with encodings of their own need another decoder (`pdf_blocks` takes one). Encrypted files and what is no PDF
    are ValueErrors.
    """
    if not payload.startswith(b"%PDF") or b"/Encrypt" in payload:
        raise ValueError("not a readable PDF file")
    objects = {int(m[1]): m[3] for m in _OBJECT.finditer(payload)}
    out = []
    for body in objects.values():
        if not re.search(rb"/Type\s*/Page\b(?!s)", body):
            continue
        contents = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        refs = [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", contents[1])] if contents else []
        out.append("\n".join(_shown(_decoded(objects.get(r, b""))) for r in refs).strip())
    return out


def _decoded(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    if b"/FlateDecode" not in body[: found.start()]:
        return found[1]
    try:
        return zlib.decompressobj().decompress(found[1])
    except zlib.error as e:
        raise ValueError("a broken stream") from e


def _shown(content: bytes) -> str:
    """Strings in the order they are shown; moves to another line break lines."""
    lines: list[str] = [""]
    pending = ""
    for token in _SHOWN.findall(content):
        if token[:1] == b"(":
            raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
            pending += raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")
        elif token[:1] == b"<":
            digits = re.sub(rb"[<>\s]", b"", token)
            raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            pending += raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                lines.append("")
            lines[-1] += pending
            pending = ""
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET") and lines[-1]:
            lines.append("")
    return "\n".join(lines).strip()


PAGE_SCHEMA = StructType([StructField("doc_id", StringType()), StructField("page", IntegerType()), StructField("text", StringType()), StructField("error", StringType())])


def pdf_page_rows(files: DataFrame, decode: PdfDecoder = pdf_pages) -> DataFrame:
    """doc_id, page (from 1), text of PDF files (doc_id, payload); one row with `error` for a file that cannot be read."""

    def rows(row: dict) -> Iterator[tuple]:
        try:
            pages = decode(bytes(row["payload"] or b""))
        except (ValueError, IndexError, KeyError) as e:
            yield row["doc_id"], None, None, f"unreadable PDF: {e}"
            return
        for i, text in enumerate(pages, 1):
            yield row["doc_id"], i, text, None

    return map_rows(files.select("doc_id", "payload"), rows, PAGE_SCHEMA)


def page_blocks(pages: DataFrame) -> DataFrame:
    """doc_id, page, block_id, text, block_type: each page's raw blocks that have a letter or digit, numbered as they stand."""
    key = F.concat_ws("\u0001", F.col("doc_id").cast("string"), F.col("page").cast("string"))
    named = pages.where(F.col("text").isNotNull()).select(key.alias("doc_id"), "text")
    x = raw_blocks(named).withColumn("page", F.element_at(F.split("doc_id", "\u0001"), 2).cast("int")).withColumn("doc_id", F.element_at(F.split("doc_id", "\u0001"), 1))
    return x.where(has_text_signal(F.col("text"))).select("doc_id", "page", F.format_string("p%04d_b%04d", F.col("page"), F.col("raw")).alias("block_id"), "text", block_type(F.col("text")).alias("block_type"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file_name, suffix, payload, file_sha256, file_size of all files below a path.

    Files of one name in several folders keep apart: from the second on (in order of their paths) the path's digest follows.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    x = raw.select("path", safe_doc_id(F.regexp_replace(name, r"\.[^.]+$", "")).alias("name"), name.alias("file_name"), suffix(F.col("path")).alias("suffix"), F.col("content").alias("payload"), F.sha2("content", 256).alias("file_sha256"), F.col("length").alias("file_size"))
    firsts = x.groupBy("name").agg(F.min("path").alias("first"))
    doc_id = F.when(F.col("path") == F.col("first"), F.col("name")).otherwise(F.concat_ws("_", "name", F.left(F.md5("path"), F.lit(8))))
    return x.join(firsts, "name").select(doc_id.alias("doc_id"), "file_name", "suffix", "payload", "file_sha256", "file_size")


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One file as `read_files` gives it; FileNotFoundError if it is not there, ValueError for other suffixes."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)
    if not path.lower().endswith(SUFFIXES):
        raise ValueError(f"unsupported file type: {path.rsplit('/', 1)[-1]}")
    return read_files(spark, path)


TEXT_SCHEMA = StructType([StructField("doc_id", StringType()), StructField("text", StringType()), StructField("error", StringType())])


def texts(files: DataFrame, decode_pdf: PdfDecoder = pdf_pages) -> DataFrame:
    """doc_id, text, error: text files decoded, blocks of Word files and pages of PDF files joined by blank lines, an error
    for other suffixes and for PDF files that cannot be read. Only text that is not UTF-8 leaves the JVM."""
    none = F.lit(None).cast("string")
    text_files = files.where(F.col("suffix").isin(*TEXT_SUFFIXES)).withColumn("valid", F.is_valid_utf8(F.col("payload").cast("string")))
    fast = text_files.where(F.coalesce("valid", F.lit(True))).select("doc_id", F.col("payload").cast("string").alias("text"), none.alias("error"))
    slow = map_rows(text_files.where("NOT valid").select("doc_id", "payload"), lambda row: iter([(row["doc_id"], decode_text(bytes(row["payload"])), None)]), TEXT_SCHEMA)
    word = map_rows(files.where(F.col("suffix").isin(*WORD_SUFFIXES)).select("doc_id", "payload"), lambda row: iter([(row["doc_id"], "\n\n".join(t for _, _, t in word_blocks(row["payload"])), None)]), TEXT_SCHEMA)

    def pdf_row(row: dict) -> Iterator[tuple]:
        try:
            yield row["doc_id"], "\n\n".join(t for t in decode_pdf(bytes(row["payload"] or b"")) if t), None
        except (ValueError, IndexError, KeyError) as e:
            yield row["doc_id"], None, f"unreadable PDF: {e}"

    pdf = map_rows(files.where(F.col("suffix").isin(*PDF_SUFFIXES)).select("doc_id", "payload"), pdf_row, TEXT_SCHEMA)
    other = files.where(~F.coalesce(F.col("suffix").isin(*SUFFIXES), F.lit(False))).select("doc_id", none.alias("text"), F.concat(F.lit("unsupported file type: "), F.coalesce("suffix", F.lit(""))).alias("error"))
    return fast.unionByName(slow).unionByName(word).unionByName(pdf).unionByName(other)


IMAGE_SCHEMA = StructType([StructField("doc_id", StringType()), StructField("name", StringType()), StructField("data", BinaryType())])


def images(files: DataFrame) -> DataFrame:
    """doc_id, name, data of the media in Word files."""
    return map_rows(files.where(F.col("suffix").isin(*WORD_SUFFIXES)).select("doc_id", "payload"), lambda row: ((row["doc_id"], n, d) for n, d in word_images(row["payload"])), IMAGE_SCHEMA)


def write_images(found: DataFrame, path: str) -> None:
    """Adds those images that the table at `path` has not yet, by document and name, to a folder for each document."""
    spark = found.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        found = found.join(spark.read.schema(IMAGE_SCHEMA).parquet(path).select("doc_id", "name"), ["doc_id", "name"], "left_anti")
    found.write.mode("append").partitionBy("doc_id").parquet(path)


def image(spark: SparkSession, path: str, doc_id: str, name: str) -> bytes:
    """An image's bytes; KeyError if there is none of that name."""
    found = spark.read.schema(IMAGE_SCHEMA).parquet(path).where((F.col("doc_id") == doc_id) & (F.col("name") == name)).select("data").head(1)
    if not found:
        raise KeyError(f"{doc_id}/{name}")
    return bytes(found[0]["data"])


def corpus(spark: SparkSession, path: str, wanted: list[str], strict: bool = False) -> DataFrame:
    """doc_id, text of the wanted documents below a path; those that are not there are an error if `strict`, else warned of."""
    found = texts(read_files(spark, path)).where(F.col("doc_id").isin(*wanted) & F.col("text").isNotNull()).select("doc_id", "text")
    lost = sorted(set(wanted) - {r["doc_id"] for r in found.select("doc_id").collect()})  # ids that the caller named
    if lost and strict:
        raise FileNotFoundError(", ".join(lost))
    if lost:
        warnings.warn(f"no document for {', '.join(lost)}", stacklevel=2)
    return found


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set, a JSON object a line of doc_id and questions: doc_id, qid (from 1), question, answer_keywords."""
    kind = "doc_id string, questions array<struct<question:string,answer_keywords:array<string>>>"
    x = spark.read.schema(kind).json(path).select("doc_id", F.posexplode("questions").alias("at", "q"))
    return x.select("doc_id", (F.col("at") + 1).alias("qid"), "q.question", F.coalesce("q.answer_keywords", F.array().cast("array<string>")).alias("answer_keywords"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """A sheet of human scores: CSV with a header, quoted line breaks kept, a byte order mark left out."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_scores(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
