"""Lines, blocks, block types, headings and title paths.

Texts become lines; lines are classed; runs of plain or table lines become blocks; fenced runs become code blocks; each
block gets a type, and headings a level and the path of titles above them. The predicates on one line or block are column
expressions. What depends on the lines before is one pass over a document's lines, which stand in one row already: an
Arrow-batched map without a shuffle or a window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from corpusmill.arrow import bounded, map_values
from corpusmill.functions import fixed as K
from corpusmill.functions.text import WHITE, any_match, py_strip

#: Levels that headings can have; deeper dotted numbers count as the last.
LEVELS = 8


def first_line(text: Column) -> Column:
    return F.substring_index(py_strip(text), "\n", 1)


def is_toc_row(line: Column) -> Column:
    return any_match(py_strip(line), K.TOC_ROW)


def is_heading(text: Column) -> Column:
    """Short, not a row of contents, and a known word or numbered or marked as a heading."""
    line = first_line(text)
    known = F.lower(line).isin(*K.HEADING_WORDS)
    marked = any_match(line, (K.HEADING_MARKDOWN, K.HEADING_CHAPTER, K.HEADING_HAN, K.HEADING_NUMBER))
    return (F.length(line) <= K.HEADING_MAX_CHARS) & (line != "") & ~is_toc_row(line) & (known | marked)


def heading_level(text: Column) -> Column:
    line = first_line(text)
    number = F.regexp_extract(line, r"^(\d+(?:\.\d+)*)", 1)
    return (
        F.when(F.lower(line).isin(*K.HEADING_WORDS), 1)
        .when(line.rlike(K.HEADING_MARKDOWN), F.length(F.regexp_extract(line, K.HEADING_MARKDOWN, 1)))
        .when(line.startswith("第"), 1)
        .when(line.rlike("^[一二三四五六七八九十]+[、.]"), 2)
        .when(number != "", F.length(F.regexp_replace(number, "[^.]", "")) + 1)
        .otherwise(3)
    )


def heading_title(text: Column) -> Column:
    return py_strip(F.regexp_replace(first_line(text), "^[# ]+|[# ]+$", ""))


def table_cells(line: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(py_strip(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|", -1), py_strip)


def is_separator_row(line: Column) -> Column:
    cells = table_cells(line)
    return (F.size(cells) >= 2) & F.forall(cells, lambda c: c.rlike(K.SEPARATOR_CELL))


def is_table_line(line: Column) -> Column:
    """Two cells at least, so a bar at least: most lines are settled by that."""
    cells = table_cells(line)
    return F.contains(line, F.lit("|")) & ((F.size(F.filter(cells, lambda c: c != "")) >= 2) | is_separator_row(line))


def is_image_line(line: Column) -> Column:
    return (F.contains(line, F.lit("![")) | F.contains(line, F.lit("<"))) & any_match(line, K.IMAGE)


def line_class(line: Column) -> Column:
    """B blank, H heading, I image, T table, M bullet marker alone, U bullet, P plain; the first that fits."""
    return (
        F.when(line == "", "B")
        .when(is_heading(line), "H")
        .when(is_image_line(line), "I")
        .when(is_table_line(line), "T")
        .when(line.isin(*K.BULLET_MARKERS), "M")
        .when(line.rlike(K.BULLET), "U")
        .otherwise("P")
    )


def lines(df: DataFrame) -> DataFrame:
    """doc_id, i (from 0), line (stripped), k (class). Null texts have no lines."""
    text = F.regexp_replace("text", "\r\n?", "\n")
    out = df.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("i", "raw")).select("doc_id", "i", py_strip(F.col("raw")).alias("line"))
    return out.withColumn("k", line_class(F.col("line")))


# ---- one document ----

_rx = lambda *patterns: [regex.compile(p) for p in patterns]


def as_column(pattern: str) -> str:
    """The pattern as column expressions take it: white space and digits are ASCII, and a dot is no line end of any kind."""
    for short, chars in ((r"\s", r" \t\n\x0b\f\r"), (r"\d", "0-9")):
        pattern = regex.sub(r"\[[^\]]*\]", lambda m: m[0].replace(short, chars), pattern).replace(short, f"[{chars}]")
    pattern = pattern.replace(r"\S", r"[^ \t\n\x0b\f\r]")
    return regex.sub(r"\\.|\[(?:\\.|[^\]])*\]|\.", lambda m: r"[^\n\r\x85\u2028\u2029]" if m[0] == "." else m[0], pattern)


class Patterns:
    """Compiled patterns of lines, and what they said of lines."""

    def __init__(self, form: Callable[[str], str] = str) -> None:
        rx = lambda *patterns: [regex.compile(form(p)) for p in patterns]
        self.toc, self.images = rx(*K.TOC_ROW), rx(*K.IMAGE)
        self.heads = rx(K.HEADING_MARKDOWN, K.HEADING_CHAPTER, K.HEADING_HAN, K.HEADING_NUMBER)
        self.separator, self.bullet = rx(K.SEPARATOR_CELL, K.BULLET)
        self.lines: dict[str, tuple[str, str]] = {}


_TEXTS, _COLUMNS = Patterns(), Patterns(as_column)
(_FORMULA,) = _rx(K.FORMULA)
_HAN_LEVEL, _DOTTED = _rx("[一二三四五六七八九十]+[、.]", r"\d+(?:\.\d+)*")
_WORDS = frozenset(K.HEADING_WORDS)


class Rules:
    """The predicates above for one text at a time."""

    @staticmethod
    def first_line(text: str) -> str:
        return text.strip(WHITE).partition("\n")[0]

    @staticmethod
    def heading(text: str, rx: Patterns = _TEXTS) -> bool:
        line = Rules.first_line(text)
        if not line or len(line) > K.HEADING_MAX_CHARS or any(p.search(line.strip(WHITE)) for p in rx.toc):
            return False
        return line.lower() in _WORDS or any(p.search(line) for p in rx.heads)

    @staticmethod
    def level(text: str) -> int:
        line = Rules.first_line(text)
        if line.lower() in _WORDS or line[:1] == "第" and not _TEXTS.heads[0].search(line):
            return 1
        if marked := _TEXTS.heads[0].search(line):
            return len(marked[1])
        if _HAN_LEVEL.match(line):
            return 2
        number = _DOTTED.match(line)
        return number[0].count(".") + 1 if number else 3

    @staticmethod
    def title(text: str) -> str:
        return Rules.first_line(text).strip("# ").strip(WHITE)

    @staticmethod
    def cells(line: str) -> list[str]:
        return [c.strip(WHITE) for c in line.strip(WHITE).removeprefix("|").removesuffix("|").split("|")]

    @staticmethod
    def separator(line: str, rx: Patterns = _TEXTS) -> bool:
        cells = Rules.cells(line)
        return len(cells) >= 2 and all(rx.separator.search(c) for c in cells)

    @staticmethod
    def table_line(line: str, rx: Patterns = _TEXTS) -> bool:
        return "|" in line and (sum(c != "" for c in Rules.cells(line)) >= 2 or Rules.separator(line, rx))

    @staticmethod
    def image(text: str, rx: Patterns = _TEXTS) -> bool:
        return ("![" in text or "<" in text) and any(p.search(text) for p in rx.images)

    @staticmethod
    def table(text: str) -> bool:
        rows = Rules.lines(text)
        if "|" not in text or len(rows) < 2:
            return False
        if any(Rules.separator(b) and len(Rules.cells(a)) == len(Rules.cells(b)) for a, b in zip(rows[:-1], rows[1:], strict=True)):
            return True
        widths = [len(Rules.cells(r)) for r in rows if Rules.table_line(r)]
        return len(widths) >= 2 and len(set(widths)) == 1

    @staticmethod
    def lines(text: str) -> list[str]:
        return [t for x in text.split("\n") if (t := x.strip(WHITE))]

    @staticmethod
    def formula(text: str) -> bool:
        t = text.strip(WHITE)
        return (t.startswith("$$") and t.endswith("$$")) or ("\n" not in t and len(t) <= K.FORMULA_MAX_CHARS and _FORMULA.search(t) is not None)

    @staticmethod
    def kind(text: str) -> str:
        """The type of a block."""
        if Rules.heading(text):
            return "heading"
        if Rules.image(text) and all(map(Rules.image, Rules.lines(text))):
            return "image"
        if Rules.table(text):
            return "table"
        if text.startswith(K.FENCE) or text.endswith(K.FENCE):
            return "code"
        return "formula" if Rules.formula(text) else "paragraph"


#: What a numbered or marked heading starts with, besides digits.
_HEAD_STARTS = frozenset("#第一二三四五六七八九十")
_LONGEST_WORD = max(map(len, _WORDS))


#: What rows of contents end with, at the end of a stripped line; digits besides.
_TOC_ENDS = frozenset("-\x1c\x1d\x1e\x1f")


def _heading_line(line: str, rx: Patterns) -> bool:
    """`Rules.heading` of a stripped line that is not empty; most are settled by their first or last character."""
    first, last = line[0], line[-1]
    marked = first in _HEAD_STARTS or first.isdecimal()
    if not marked and (len(line) > _LONGEST_WORD or line.lower() not in _WORDS) or len(line) > K.HEADING_MAX_CHARS:
        return False
    if (last in _TOC_ENDS or last.isdecimal()) and any(p.search(line) for p in rx.toc):
        return False
    return any(p.search(line) for p in rx.heads) or line.lower() in _WORDS


def _table_line(line: str, rx: Patterns) -> bool:
    filled = 0
    for cell in line.split("|"):
        if cell and cell.strip(WHITE):
            filled += 1
            if filled == 2:
                return True
    return Rules.separator(line, rx)


def _class_of(line: str, rx: Patterns) -> str:
    """The class of a stripped line."""
    if line == "":
        return "B"
    if _heading_line(line, rx):
        return "H"
    if Rules.image(line, rx):
        return "I"
    if "|" in line and _table_line(line, rx):
        return "T"
    if line in K.BULLET_MARKERS:
        return "M"
    return "U" if line[0] in "•*-" and rx.bullet.search(line) else "P"


#: Lines of up to 400 characters that are kept with their stripped form and class, until there are so many.
_LINES_HELD = 1 << 14


def classed_lines(text: str, rx: Patterns = _TEXTS) -> Iterator[tuple[str, str]]:
    """Each line of a text, stripped, with its class."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    held = rx.lines
    for raw in text.split("\n"):
        found = held.get(raw)
        if found is None:
            line = raw.strip(WHITE)
            found = line, _class_of(line, rx)
            if len(raw) <= 400:
                if len(held) >= _LINES_HELD:
                    held.clear()
                held[raw] = found
        yield found


def class_counts(df: DataFrame) -> DataFrame:
    """k, n, chars: how many lines of each class there are in the texts, and their characters, as `lines` has them."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: Counter[str] = Counter()
        chars: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for line, k in classed_lines(text, _COLUMNS) if text is not None else ():
                    lines[k] += 1
                    chars[k] += len(line)
        yield pa.RecordBatch.from_pydict({"k": list(lines), "n": list(lines.values()), "chars": [chars[k] for k in lines]}, pa.schema([("k", pa.string()), ("n", pa.int64()), ("chars", pa.int64())]))

    bounded(df)
    return df.select("text").mapInArrow(counted, "k string, n long, chars long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))


def _single(line: str, own: str) -> str:
    """The type of a block that is this one line of the class `own`: one line alone is no table."""
    if own == "H":
        return "heading"
    if own == "I":
        return "image"
    if line.startswith(K.FENCE) or line.endswith(K.FENCE):
        return "code"
    return "formula" if ("=" in line or line.startswith("$$") or not line.isascii()) and Rules.formula(line) else "paragraph"


def _several(text: str) -> str:
    """The type of a block of plain or table lines: its first line is no heading, and none is an image."""
    if "|" in text and Rules.table(text):
        return "table"
    if text.startswith(K.FENCE) or text.endswith(K.FENCE):
        return "code"
    return "formula" if text.startswith("$$") and Rules.formula(text) else "paragraph"


def typed_texts(text: str) -> list[tuple[str, str]]:
    """(text, type) of raw blocks: runs of plain or of table lines are one, a lone marker takes the next plain line."""
    out: list[tuple[str, str]] = []
    run: list[str] = []  # plain or table lines that stand together so far
    above, above_class, ran = "", "", ""  # the line before, its class, and its class once a marker was joined

    def end() -> None:
        out.append((run[0], _single(run[0], ran)) if len(run) == 1 else (t := "\n".join(run), _several(t)))
        run.clear()

    for line, own in classed_lines(text):
        if own == "P" and above_class != "M" or own == "T":
            if run and own != ran:
                end()
            run.append(line)
            ran = own
        else:
            if run:
                end()
            if own == "P":
                joined = f"{above} {line}"
                out.append((joined, _single(joined, "MU")))
                ran = "MU"
            else:
                if own not in "BM":
                    out.append((line, _single(line, own)))
                ran = own
        above, above_class = line, own
    if run:
        end()
    return out


def raw_texts(text: str) -> list[str]:
    """The texts of raw blocks."""
    return [t for t, _ in typed_texts(text)]


def document_blocks(text: str) -> list[tuple[int, int, str, str]]:
    """(first raw block, last one, text, type) after fenced runs are joined.

    A block that starts with a fence opens a run (again, if one is open: what it held is lost); one that ends with a
    fence without starting with one closes it; the last open run of a document stays.
    """
    if K.FENCE not in text:
        return [(i, i, t, kind) for i, (t, kind) in enumerate(typed_texts(text))]
    out: list[tuple[int, int, str, str]] = []
    run: list[tuple[int, str]] = []
    for i, (t, kind) in enumerate(typed_texts(text)):
        opens = t.startswith(K.FENCE)
        if opens:
            run = []
        if opens or run:
            run.append((i, t))
            if not opens and t.endswith(K.FENCE):
                out.append((run[0][0], i, "\n\n".join(x for _, x in run), "code"))
                run = []
        else:
            out.append((i, i, t, kind))
    if run:
        out.append((run[0][0], run[-1][0], "\n\n".join(x for _, x in run), "code"))
    return out


def headed(blocks: Iterable[tuple[int, int, str, str]]) -> Iterator[tuple]:
    """(first, last, text, type, level, title) of blocks; level and title of headings."""
    for first, last, text, kind in blocks:
        if kind == "heading":
            yield first, last, text, kind, min(Rules.level(text), LEVELS), Rules.title(text)
        else:
            yield first, last, text, kind, None, None


def _path_rows(doc_id, text: str | None) -> Iterator[tuple]:
    stack: list[tuple[int, str]] = []
    path: list[str] = []
    for first, last, block, kind, level, title in headed(document_blocks(text or "")):
        if level is not None:
            stack = [*(x for x in stack if x[0] < level), (level, title)]
            path = [t for _, t in stack]
        yield doc_id, first, last, block, kind, level, title, path


def _schema(df: DataFrame, *fields: StructField) -> StructType:
    return StructType([StructField("doc_id", df.schema["doc_id"].dataType), *fields])


_RAW = (StructField("raw", IntegerType()), StructField("text", StringType()))
_BLOCK = (StructField("raw", IntegerType()), StructField("last_raw", IntegerType()), StructField("text", StringType()), StructField("block_type", StringType()))
_PATH = (*_BLOCK, StructField("heading_level", IntegerType()), StructField("title", StringType()), StructField("title_path", ArrayType(StringType())))


def raw_blocks(df: DataFrame) -> DataFrame:
    """doc_id, raw (from 0), text of each raw block; null and blank texts have none."""
    return map_values(df.select("doc_id", "text"), lambda doc_id, text: ((doc_id, i, t) for i, t in enumerate(raw_texts(text or ""))), _schema(df, *_RAW))


def blocks(df: DataFrame, words: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, raw, last_raw, text, block_type after fenced runs are joined; only blocks with one of `words`, if there are any."""
    def rows(doc_id, text: str | None) -> Iterator[tuple]:
        for b in document_blocks(text or ""):
            if not words or any(w in b[2] for w in words):
                yield doc_id, *b

    return map_values(df.select("doc_id", "text"), rows, _schema(df, *_BLOCK))


def title_paths(df: DataFrame, kind: str | None = None) -> DataFrame:
    """The blocks (of one type, if it is given) with heading_level, title and title_path (the path in force at each block;
    headings include themselves)."""
    rows = _path_rows if kind is None else lambda doc_id, text: (r for r in _path_rows(doc_id, text) if r[4] == kind)
    return map_values(df.select("doc_id", "text"), rows, _schema(df, *_PATH))


# ---- blocks as columns ----


def with_headings(blocks: DataFrame) -> DataFrame:
    """Adds heading_level and title to blocks; both are null where a block is no heading."""
    head = F.col("block_type") == "heading"
    return blocks.withColumn("heading_level", F.when(head, F.least(heading_level(F.col("text")), F.lit(LEVELS)))).withColumn("title", F.when(head, heading_title(F.col("text"))))


def block_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), py_strip), lambda x: x != "")


def is_table(text: Column) -> Column:
    """A separator row under a header of as many cells, or two table lines at least, all of as many cells."""
    rows = block_lines(text)
    pairs = F.zip_with(F.slice(rows, F.lit(1), F.greatest(F.size(rows) - 1, F.lit(0))), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    headed = F.exists(pairs, lambda p: is_separator_row(p["b"]) & (F.size(table_cells(p["a"])) == F.size(table_cells(p["b"]))))
    like = F.transform(F.filter(rows, is_table_line), lambda r: F.size(table_cells(r)))
    return F.contains(text, F.lit("|")) & (F.size(rows) >= 2) & (headed | ((F.size(like) >= 2) & (F.size(F.array_distinct(like)) == 1)))


def is_formula(text: Column) -> Column:
    t = py_strip(text)
    display = t.startswith("$$") & t.endswith("$$")
    return display | (~F.contains(t, F.lit("\n")) & (F.length(t) <= K.FORMULA_MAX_CHARS) & t.rlike(K.FORMULA))


def block_type(text: Column) -> Column:
    rows = block_lines(text)
    return (
        F.when(is_heading(text), "heading")
        .when(is_image_line(text) & F.forall(rows, is_image_line), "image")
        .when(is_table(text), "table")
        .when(text.startswith(K.FENCE) | text.endswith(K.FENCE), "code")
        .when(is_formula(text), "formula")
        .otherwise("paragraph")
    )
