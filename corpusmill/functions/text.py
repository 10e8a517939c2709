"""Column builders for text: JVM-side expressions only."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import fixed as K

_TOKEN = re.compile(K.TOKEN)
#: White space of Unicode, as `py_strip` takes it off.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def py_strip(c: Column) -> Column:
    """Without white space (Unicode's) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm_ws(c: Column) -> Column:
    """White space runs as single blanks, stripped."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def compact(c: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", "")


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def any_match(c: Column, patterns: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def token_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(K.TOKEN))


def tokens(c: Column) -> Column:
    return find_all(F.lower(F.coalesce(c, F.lit(""))), K.TOKEN)


def sentences(c: Column) -> Column:
    """Stripped sentences; the whole stripped text where there are none."""
    found = F.filter(F.transform(find_all(c, K.SENTENCE), py_strip), lambda s: s != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(py_strip(c)))


def dedupe_ci(items: Column) -> Column:
    """Items without later ones that are equal in lower case."""
    kept = F.aggregate(
        items,
        F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: F.when(F.array_contains(acc["seen"], F.lower(x)), acc).otherwise(F.struct(F.array_append(acc["seen"], F.lower(x)).alias("seen"), F.array_append(acc["out"], x).alias("out"))),
    )
    return kept["out"]


def first_ci(items: Column, limit: int) -> Column:
    """The first `limit` items without later ones that are equal in lower case; what is kept is never longer than that."""
    kept = F.aggregate(
        items,
        F.array().cast("array<struct<low:string,item:string>>"),
        lambda acc, x: F.when((F.size(acc) >= limit) | F.exists(acc, lambda y: y["low"] == F.lower(x)), acc).otherwise(F.array_append(acc, F.struct(F.lower(x).alias("low"), x.alias("item")))),
    )
    return F.transform(kept, lambda y: y["item"])


def word_ngrams(words: Column, n: int) -> Column:
    """n-grams joined by blanks; all words as one where there are fewer than n, none without words."""
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.when(F.size(words) >= n, many).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def e6(c: Column) -> Column:
    """Millionths as a whole number, halves up: equal on every engine where the doubles are."""
    return F.floor(c * 1_000_000 + 0.5).cast("long")


def share_e6(part: Column, whole: Column) -> Column:
    return F.coalesce(e6(part / F.nullif(whole, F.lit(0))), F.lit(0).cast("long"))


def safe_doc_id(c: Column) -> Column:
    """Letters and digits, everything else an underscore, none at the ends; `doc` if nothing is left."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(c), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(inner, F.lit("")), F.lit("doc"))


def has_text_signal(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"[\p{L}\p{N}_]")


def ends_at_boundary(c: Column) -> Column:
    """Whether a chunk ends where a sentence may; empty ones do."""
    stripped = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+$", "")
    return (stripped == "") | stripped.rlike(K.SENTENCE_END)


def _cosine(left: str | None, right: str | None) -> float:
    a, b = (Counter(_TOKEN.findall((t or "").lower())) for t in (left, right))
    norm = math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
    return sum(n * b[t] for t, n in a.items()) / norm if norm else 0.0


def token_cosine(left: Column, right: Column) -> Column:
    """Cosine of the token counts of two texts, 0 if either has none: linear in their lengths, in Arrow batches."""
    return F.udf(_cosine, "double", useArrow=True)(left, right)
