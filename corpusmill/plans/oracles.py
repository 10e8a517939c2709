"""DuckDB SQL that gives the rows of the registered queries, built from the same fixed values."""

from __future__ import annotations

from corpusmill.functions import fixed as K
from corpusmill.plans.derived import MDOC_DUCK


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(x: str, values) -> str:
    return f"{x} IN ({', '.join(map(q, values))})"


def rx(x: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {q(p)})" for p in patterns) + ")"


def cells(x: str) -> str:
    return f"list_transform(string_split(regexp_replace(regexp_replace(trim({x}), '^\\|', ''), '\\|$', ''), '|'), lambda c: trim(c))"


def all_match(xs: str, condition: str) -> str:
    return f"(len(list_filter({xs}, lambda z: NOT ({condition}))) = 0)"


def separator(x: str) -> str:
    return f"(len({cells(x)}) >= 2 AND {all_match(cells(x), rx('z', K.SEPARATOR_CELL))})"


def table_line(x: str) -> str:
    return f"({separator(x)} OR (len({cells(x)}) >= 2 AND len(list_filter({cells(x)}, lambda z: z <> '')) >= 2))"


def first(x: str) -> str:
    return f"split_part(trim({x}, ' ' || chr(10)), chr(10), 1)"


def heading(x: str) -> str:
    f = first(x)
    return f"(length({f}) <= {K.HEADING_MAX_CHARS} AND {f} <> '' AND NOT {rx(f, *K.TOC_ROW)} AND ({among(f'lower({f})', K.HEADING_WORDS)} OR {rx(f, K.HEADING_MARKDOWN, K.HEADING_CHAPTER, K.HEADING_HAN, K.HEADING_NUMBER)}))"


def level(x: str) -> str:
    f = first(x)
    number = f"regexp_extract({f}, '^(\\d+(?:\\.\\d+)*)', 1)"
    return (
        f"CASE WHEN {among(f'lower({f})', K.HEADING_WORDS)} THEN 1 WHEN {rx(f, K.HEADING_MARKDOWN)} THEN length(regexp_extract({f}, {q(K.HEADING_MARKDOWN)}, 1))"
        f" WHEN starts_with({f}, '第') THEN 1 WHEN {rx(f, '^[一二三四五六七八九十]+[、.]')} THEN 2 WHEN {number} <> '' THEN length(regexp_replace({number}, '[^.]', '', 'g')) + 1 ELSE 3 END"
    )


def title(x: str) -> str:
    return f"trim(regexp_replace({first(x)}, '^[# ]+|[# ]+$', '', 'g'))"


def norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def compact(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '\\s+', '', 'g')"


def e6(x: str) -> str:
    return f"CAST(floor(({x}) * 1000000 + 0.5) AS BIGINT)"


def n_tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, {q(K.TOKEN)}))"


LINES = f"""
mdoc AS ({MDOC_DUCK}),
src AS (SELECT doc_id, text FROM mdoc),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM src),
l1 AS (SELECT doc_id, i, trim(raw) AS line FROM l0),
l2 AS (SELECT *, CASE WHEN line = '' THEN 'B' WHEN {heading('line')} THEN 'H' WHEN {rx('line', *K.IMAGE)} THEN 'I' WHEN {table_line('line')} THEN 'T'
       WHEN {among('line', K.BULLET_MARKERS)} THEN 'M' WHEN {rx('line', K.BULLET)} THEN 'U' ELSE 'P' END AS k FROM l1)"""

RAW = f"""{LINES},
r0 AS (SELECT *, lag(k) OVER w AS p, lag(line) OVER w AS before FROM l2 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r1 AS (SELECT doc_id, i, CASE WHEN k = 'P' AND p = 'M' THEN before || ' ' || line ELSE line END AS line, CASE WHEN k = 'P' AND p = 'M' THEN 'MU' ELSE k END AS k FROM r0),
r2 AS (SELECT *, CASE WHEN k = lag(k) OVER (PARTITION BY doc_id ORDER BY i) AND k IN ('P', 'T') THEN 0 ELSE 1 END AS start FROM r1),
r3 AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY i) AS blk FROM r2 WHERE k <> 'B'),
r4 AS (SELECT doc_id, blk, string_agg(line, chr(10) ORDER BY i) AS text FROM r3 WHERE k <> 'M' GROUP BY doc_id, blk),
raw AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY blk) - 1 AS raw, text FROM r4)"""


def rows_of(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda y: trim(y)), lambda y: y <> '')"


def is_table(x: str) -> str:
    rows = rows_of(x)
    like = f"list_transform(list_filter({rows}, lambda r: {table_line('r')}), lambda r: len({cells('r')}))"
    headed = f"len(list_filter(range(2, len({rows}) + 1), lambda j: {separator(f'{rows}[j]')} AND len({cells(f'{rows}[j - 1]')}) = len({cells(f'{rows}[j]')}))) > 0"
    return f"(len({rows}) >= 2 AND ({headed} OR (len({like}) >= 2 AND list_min({like}) = list_max({like}))))"


def block_type(x: str) -> str:
    formula = f"((starts_with({x}, '$$') AND ends_with({x}, '$$')) OR (NOT contains({x}, chr(10)) AND length({x}) <= {K.FORMULA_MAX_CHARS} AND {rx(x, K.FORMULA)}))"
    return (
        f"CASE WHEN {heading(x)} THEN 'heading' WHEN len({rows_of(x)}) > 0 AND {all_match(rows_of(x), rx('z', *K.IMAGE))} THEN 'image' WHEN {is_table(x)} THEN 'table'"
        f" WHEN starts_with({x}, '```') OR ends_with({x}, '```') THEN 'code' WHEN {formula} THEN 'formula' ELSE 'paragraph' END"
    )


BLOCKS = f"""{RAW},
f0 AS (SELECT *, CASE WHEN starts_with(text, '```') THEN 1 ELSE 0 END AS s, CASE WHEN ends_with(text, '```') AND NOT starts_with(text, '```') THEN 1 ELSE 0 END AS e FROM raw),
f1 AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY raw) AS seg, sum(s) OVER (PARTITION BY doc_id) AS last FROM f0),
f2 AS (SELECT *, coalesce(sum(CASE WHEN seg > 0 THEN e ELSE 0 END) OVER (PARTITION BY doc_id, seg ORDER BY raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM f1),
f3 AS (SELECT *, seg > 0 AND prior = 0 AS code FROM f2),
f4 AS (SELECT *, max(CASE WHEN code THEN e ELSE 0 END) OVER (PARTITION BY doc_id, seg) AS closed FROM f3),
f5 AS (SELECT doc_id, code, CASE WHEN code THEN -seg ELSE raw END AS key, min(raw) AS raw, max(raw) AS last_raw, string_agg(text, chr(10) || chr(10) ORDER BY raw) AS text
       FROM f4 WHERE NOT code OR closed = 1 OR seg = last GROUP BY 1, 2, 3),
blocks AS (SELECT doc_id, raw, last_raw, text, CASE WHEN code THEN 'code' ELSE {block_type('text')} END AS block_type FROM f5)"""

_AT = ", ".join(f"coalesce(max(CASE WHEN heading_level = {n} THEN last_raw END) OVER w, -1) AS at{n}, last_value(CASE WHEN heading_level = {n} THEN title END IGNORE NULLS) OVER w AS t{n}" for n in range(1, 9))
_PATH = ", ".join(f"CASE WHEN at{n} > greatest(-1{''.join(f', at{k}' for k in range(1, n))}) THEN t{n} END" for n in range(1, 9))
PATHS = f"""{BLOCKS},
h0 AS (SELECT *, CASE WHEN block_type = 'heading' THEN least({level('text')}, 8) END AS heading_level, CASE WHEN block_type = 'heading' THEN {title('text')} END AS title FROM blocks),
h1 AS (SELECT *, {_AT} FROM h0 WINDOW w AS (PARTITION BY doc_id ORDER BY last_raw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
paths AS (SELECT doc_id, raw, last_raw, text, block_type, heading_level, title, list_filter([{_PATH}], lambda z: z IS NOT NULL) AS title_path FROM h1)"""


def toc(x: str) -> str:
    return f"({among(f'''regexp_replace({x}, '\\s+', '', 'g')''', K.TOC_MARKERS)} OR {rx(first(x), *K.TOC_ENTRY)})"


def cover(x: str) -> str:
    tight = f"regexp_replace({x}, '\\s+', '', 'g')"
    return (
        f"({rx(tight, f'^({K.COVER_FIELDS})[：:]')} OR (length({x}) <= 24 AND {rx(x, f'^({K.COVER_SHORT})')}) OR (length({x}) <= 120 AND {rx(x, K.COVER_LABEL, K.COVER_COLON)})"
        f" OR (length({tight}) <= 20 AND {rx(tight, K.COVER_DATE)}) OR (length({x}) <= 36 AND {rx(x, K.COVER_WORDS)}))"
    )


def body_table(x: str) -> str:
    rows = f"list_filter(string_split(trim({x}), chr(10)), lambda y: trim(y) <> '')"
    return f"(block_type = 'table' AND length(trim({x})) >= {K.BODY_TABLE_CHARS} AND (len({rows}) <= {K.BODY_TABLE_LINES} OR list_sum(list_transform({rows}, lambda y: length(y))) > {K.BODY_TABLE_MEAN} * len({rows})))"


def flat_table(x: str) -> str:
    inner = "list_transform(string_split(regexp_replace(regexp_replace(r, '^\\|+', ''), '\\|+$', ''), '|'), lambda c: trim(c))"
    kept = f"list_filter({rows_of(x)}, lambda r: NOT {all_match(inner, rx('z', K.SEPARATOR_CELL))})"
    return f"trim(array_to_string(flatten(list_transform({kept}, lambda r: list_filter({inner}, lambda c: c <> ''))), chr(10) || chr(10)))"


def cuts(size: int, name: str = "cuts") -> str:
    """Recursive cut places of fixed-length chunks."""
    ahead = f"substr(text, (prev + {size} + 1)::BIGINT, least({size // 2}, length(text) - prev - {size})::BIGINT)"
    line = f"strpos({ahead}, chr(10))"
    end = f"length(regexp_extract({ahead}, '(?s)^.*[.!?。！？]', 0))"
    cut = f"CASE WHEN prev + {size} >= length(text) THEN length(text) ELSE prev + {size} + CASE WHEN {line} > 0 THEN {line} ELSE {end} END END"
    return f"""{name}(doc_id, text, nth, lo, hi) AS (
  SELECT doc_id, text, 1, 0::BIGINT, ({cut.replace('prev', '0')})::BIGINT FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, nth + 1, hi, ({cut.replace('prev', 'hi')})::BIGINT FROM {name} WHERE hi < length(text))"""


def fixed(size: int, suffix: str = "") -> str:
    return f"{cuts(size, 'cuts' + suffix)}, fixed{suffix} AS (SELECT doc_id, nth, lo, hi, trim(substr(text, lo + 1, hi - lo), ' ' || chr(10)) AS content FROM cuts{suffix} WHERE trim(substr(text, lo + 1, hi - lo), ' ' || chr(10)) <> '')"


def boundary(x: str) -> str:
    return f"({x} = '' OR {rx(x, K.SENTENCE_END)})"


def summary(x: str) -> str:
    whole = f"regexp_replace({norm(x)}, '([。！？!?；;]) ', '\\1', 'g')"
    lead = f"regexp_extract({norm(x)}, '^[^。！？!?；;]*[。！？!?；;]?', 0)"
    return f"CASE WHEN length({lead}) >= {K.SUMMARY_CHARS} THEN left({whole}, {K.SUMMARY_CHARS}) ELSE trim(left({whole}, {K.SUMMARY_CHARS})) END"


KEYWORDS = f"""
kt AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS term FROM documents),
kv AS (SELECT doc_id, term, count(*) AS n FROM kt WHERE NOT {among('lower(term)', K.KEYWORD_STOPWORDS)} AND length(term) >= 2 AND NOT {rx('term', '[0-9]', '^_+$')} AND NOT {rx('lower(term)', '^[a-z]{1,2}$')} GROUP BY 1, 2)"""

_COS = "SELECT a.vec_id AS query_id, b.vec_id, {score} AS score_e6 FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0"
_ZIP = "list_zip(a.embedding, b.embedding)"
_DOT = "list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip({x}, {y}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), lambda s, v: s + v)"
COSINE = f"{_DOT.format(x='a.embedding', y='b.embedding')} / nullif(sqrt({_DOT.format(x='a.embedding', y='a.embedding')}) * sqrt({_DOT.format(x='b.embedding', y='b.embedding')}), 0)"
L2 = "list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), lambda s, v: s + v)"


def nearest(k: int, score: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_e6 DESC, vec_id) AS rank FROM ({_COS.format(score=score)})) WHERE rank <= {k}"


NEAR5 = nearest(5, e6(f"coalesce({COSINE}, 0)"))


def tokens_of(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), {q(K.LEXICAL_TOKEN)}))"


def overlap(question: str, x: str) -> str:
    return f"coalesce(len(list_intersect({tokens_of(question)}, {tokens_of(x)}))::DOUBLE / nullif(len({tokens_of(question)}), 0), 0)"


PENALTY = "(CASE WHEN length(text) < 180 THEN 0.05 ELSE 0.0 END + CASE WHEN length(text) > 800 THEN 0.05 ELSE 0.0 END)::DOUBLE"

RANKED = f"""
near AS ({NEAR5}),
hits AS (SELECT n.query_id, n.rank, CASE WHEN v.label = w.label THEN 1 ELSE 0 END AS rel FROM near n JOIN embeddings v ON v.vec_id = n.vec_id JOIN embeddings w ON w.vec_id = n.query_id),
totals AS (SELECT a.vec_id AS query_id, count(*) AS total FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0 GROUP BY 1)"""


def _metrics() -> str:
    cols = []
    for k in (1, 3, 5):
        shown, found = f"least(count(*), {k})", f"sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END)"
        gain = f"coalesce(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_sort(list(rank) FILTER (rank <= {k} AND rel = 1)), lambda i: ln(2.0::DOUBLE) / ln(i + 1.0::DOUBLE))), lambda s, v: s + v), 0.0)"
        best = f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, 1 + greatest(least(max(total), {shown}), 1)), lambda i: ln(2.0::DOUBLE) / ln(i + 1.0::DOUBLE))), lambda s, v: s + v)"
        cols += [
            f"coalesce({e6(f'{found}::DOUBLE / nullif(max(total), 0)')}, 0) AS recall_{k}_e6",
            f"coalesce({e6(f'{found}::DOUBLE / nullif({shown}, 0)')}, 0) AS precision_{k}_e6",
            f"CASE WHEN max(total) > 0 THEN {e6(f'{gain} / {best}')} ELSE 0 END AS ndcg_{k}_e6",
        ]
    mrr = e6("1.0::DOUBLE / min(CASE WHEN rel = 1 THEN rank END)")
    return f"SELECT query_id, {', '.join(cols)}, coalesce({mrr}, 0) AS mrr_e6 FROM hits JOIN totals USING (query_id) GROUP BY query_id"


METRICS = _metrics()
BY_SIZE = ", ".join(fixed(s, str(s)) for s in (256, 512, 1024)) + ", sized AS (" + " UNION ALL ".join(f"SELECT doc_id, count(*) FILTER ({boundary('content')} OR {rx('content', '[.!?]$')}) AS value, 'fixed_{s}' AS strategy FROM fixed{s} GROUP BY doc_id" for s in (256, 512, 1024)) + ")"

TARGET = "CASE WHEN length(text) <= 0 THEN 550 WHEN length(text) < 3000 THEN 300 WHEN length(text) < 10000 THEN 450 WHEN length(text) < 50000 THEN 650 WHEN length(text) < 200000 THEN 850 ELSE 1100 END"
TAG = f"""
tt AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, list_filter(regexp_extract_all(text, {q(K.TAG_TOKEN)}), lambda z: length(z) >= 2 AND NOT {among('lower(z)', K.TAG_STOPWORDS)}) AS t FROM documents)),
tn AS (SELECT doc_id, term, count(*) AS n, min(pos) AS pos FROM tt GROUP BY 1, 2),
tr AS (SELECT *, row_number() OVER w AS place, lead(term) OVER w AS nxt, lead(n) OVER w AS nxt_n FROM tn WINDOW w AS (PARTITION BY doc_id ORDER BY n DESC, pos)),
tp AS (SELECT doc_id, term || nxt AS tag, max(n + nxt_n) AS score, min(place) AS place, 0 AS single FROM tr WHERE nxt IS NOT NULL AND length(term || nxt) <= {K.BIGRAM_CHARS} GROUP BY 1, 2
       UNION ALL SELECT doc_id, term, n, place, 1 FROM tr),
tq AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tag ORDER BY single, score DESC, place) AS again FROM tp),
tz AS (SELECT doc_id, tag, row_number() OVER (PARTITION BY doc_id ORDER BY single, score DESC, place) AS nth FROM tq WHERE again = 1)"""

_TURNS = "asked AS (SELECT conv_id, arg_min(turn, turn) AS turn, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id), said AS (SELECT conv_id, turn AS answer_turn, text FROM conversations WHERE role = 'assistant')"
_TERMS = f"list_distinct(list_filter(list_transform(regexp_extract_all(question, {q(K.QUERY_TERM)}), lambda t: {compact('t')}), lambda t: length(t) >= 2))"
_COUNTS = "list_transform(list_distinct({t}), lambda z: len(list_filter({t}, lambda y: y = z))::DOUBLE)"


def _cosine_counts() -> str:
    a, b = (f"regexp_extract_all(lower({x}), {q(K.TOKEN)})" for x in ("a.text", "b.text"))
    return f"""
p AS (SELECT a.conv_id, a.turn, {a} AS x, {b} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
px AS (SELECT conv_id, turn, t, count(*)::DOUBLE AS n FROM (SELECT conv_id, turn, unnest(x) AS t FROM p) GROUP BY 1, 2, 3),
py AS (SELECT conv_id, turn, t, count(*)::DOUBLE AS n FROM (SELECT conv_id, turn, unnest(y) AS t FROM p) GROUP BY 1, 2, 3),
d AS (SELECT conv_id, turn, sum(px.n * py.n) AS dot FROM px JOIN py USING (conv_id, turn, t) GROUP BY 1, 2),
nx AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS n FROM px GROUP BY 1, 2), ny AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS n FROM py GROUP BY 1, 2)
SELECT p.conv_id, p.turn, {e6('coalesce(d.dot / nullif(nx.n * ny.n, 0), 0)')} AS cosine_e6 FROM p LEFT JOIN d USING (conv_id, turn) LEFT JOIN nx USING (conv_id, turn) LEFT JOIN ny USING (conv_id, turn)"""


def _grams(n: int) -> str:
    return f"SELECT item_id AS doc_id, unnest(list_transform(range(1, greatest(length(t) - {n} + 2, 1)), lambda i: substr(t, i, {n}))) AS gram FROM (SELECT item_id, regexp_replace(lower(text), '\\s\\s+', ' ', 'g') AS t FROM benchmark)"


def _qa() -> str:
    words, grams = f"regexp_extract_all(a, {q(K.WORD_RUN)})", "g"
    return f"""WITH x AS (SELECT s.conv_id, s.turn, lower(trim(u.text, ' ' || chr(10))) AS a, lower(trim(s.text, ' ' || chr(10))) AS c FROM conversations s JOIN conversations u ON s.conv_id = u.conv_id AND s.turn = u.turn + 1 WHERE s.role = 'assistant' AND u.role = 'user'),
y AS (SELECT *, {words} AS w, CASE WHEN len({words}) >= 2 THEN list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]) WHEN len({words}) = 1 THEN {words} ELSE [] END AS g, a <> '' AND c <> '' AS ok FROM x),
z AS (SELECT conv_id, turn, ok, len(list_distinct(w)) AS nw, len(list_intersect(list_distinct(w), regexp_extract_all(c, {q(K.WORD_RUN)}))) AS nf, len({grams}) AS ng, len(list_filter({grams}, lambda t: contains(c, t))) AS nk FROM y)
SELECT conv_id, turn, CASE WHEN ok THEN nw ELSE 0 END AS n_words, CASE WHEN ok THEN nf ELSE 0 END AS n_found, CASE WHEN ok THEN ng ELSE 0 END AS n_grams, CASE WHEN ok THEN nk ELSE 0 END AS n_kept,
ok AND nf >= 0.3 * greatest(nw, 1) AS answerable, ok AND CASE WHEN ng > 0 THEN nk >= 0.5 * ng ELSE nf >= 0.5 * greatest(nw, 1) END AS faithful FROM z"""


#: CRC-32 of three characters, by a table of its 256 steps; buckets of hashed trigrams.
_CRC = f"""
crc0(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc0 WHERE k < 8),
crct AS (SELECT list(c ORDER BY i) AS t FROM crc0 WHERE k = 8)"""


def _buckets(source: str, key: str, text: str, name: str) -> str:
    """(key, bucket, n) of hashed trigrams of a table's texts."""
    return f"""
{name}g AS (SELECT {key}, unnest(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substr(t, i, 3))) AS gram FROM (SELECT {key}, lower({text}) AS t FROM {source}) WHERE length(t) >= 3),
{name}d AS (SELECT DISTINCT gram FROM {name}g),
{name}h AS (SELECT gram, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(hex(encode(gram))) // 2), lambda i: ('0x' || substr(hex(encode(gram)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % {K.VECTOR_SIZE} AS bucket FROM {name}d, crct),
{name} AS (SELECT {key}, bucket, count(*) AS n FROM {name}g JOIN {name}h USING (gram) GROUP BY ALL)"""


_CHUNKS = f"""asked AS (SELECT conv_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
chunks AS (SELECT conv_id, turn, text, 'turn ' || turn || ': ' || text AS body FROM conversations WHERE role = 'assistant')"""
_BOOST = e6(f"CASE WHEN len({_TERMS}) > 0 THEN least(0.08::DOUBLE, 0.025::DOUBLE * len(list_filter({_TERMS}, lambda t: contains({compact('body')}, t)))) + CASE WHEN {rx('question', K.METRIC_QUERY)} AND {rx('text', K.METRIC)} THEN 0.05::DOUBLE ELSE 0.0 END ELSE 0.0 END")
_VECTOR_SIMILARITY = f"""{_CRC}, {_CHUNKS}, {_buckets('asked', 'conv_id', 'question', 'qv')}, {_buckets('chunks', 'conv_id, turn', 'body', 'cv')},
qn AS (SELECT conv_id, sqrt(sum(n * n)::DOUBLE) AS l FROM qv GROUP BY 1), cn AS (SELECT conv_id, turn, sqrt(sum(n * n)::DOUBLE) AS l FROM cv GROUP BY 1, 2),
inner_ AS (SELECT c.conv_id, c.turn, sum(q.n * c.n)::BIGINT AS s FROM qv q JOIN cv c ON q.conv_id = c.conv_id AND q.bucket = c.bucket GROUP BY 1, 2),
sim AS (SELECT conv_id, turn, coalesce(coalesce(s, 0) / nullif(coalesce(qn.l, 0) * coalesce(cn.l, 0), 0), 0)::DOUBLE AS similarity FROM asked JOIN chunks USING (conv_id) LEFT JOIN inner_ USING (conv_id, turn) LEFT JOIN qn USING (conv_id) LEFT JOIN cn USING (conv_id, turn))"""


def _search(k: int, boost: str) -> str:
    return f"""scored AS (SELECT conv_id AS query_id, turn, conv_id || '_' || turn AS chunk_id, question, text, {e6('similarity')} AS similarity_e6, {e6('similarity')} + {boost} AS score_e6 FROM sim JOIN asked USING (conv_id) JOIN chunks USING (conv_id, turn)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_e6 DESC, turn DESC) AS rank FROM scored) WHERE rank <= {k})"""


def _tf(key: str, body: str, source: str, name: str) -> str:
    grams = " UNION ALL ".join(f"SELECT {key}, unnest(list_transform(range(1, greatest(length(t) - {n} + 2, 1)), lambda i: substr(t, i, {n}))) AS gram FROM {name}t" for n in (1, 2, 3, 4))
    return f"{name}t AS (SELECT {key}, regexp_replace(lower({body}), '\\s\\s+', ' ', 'g') AS t FROM {source}), {name} AS (SELECT {key}, gram, count(*) AS c FROM ({grams}) GROUP BY ALL)"


_TFIDF_SIMILARITY = f"""{_CHUNKS}, {_tf('conv_id, turn', 'body', 'chunks', 'tc')}, {_tf('conv_id', 'question', 'asked', 'tq')},
idf AS (SELECT conv_id, gram, ln((1 + docs)::DOUBLE / (1 + df)) + 1 AS idf FROM (SELECT conv_id, gram, count(*) AS df FROM tc GROUP BY 1, 2) JOIN (SELECT conv_id, count(*) AS docs FROM chunks GROUP BY 1) USING (conv_id)),
wc AS (SELECT conv_id, turn, gram, (1 + ln(c::DOUBLE)) * idf AS w FROM tc JOIN idf USING (conv_id, gram)), wq AS (SELECT conv_id, gram, (1 + ln(c::DOUBLE)) * idf AS w FROM tq JOIN idf USING (conv_id, gram)),
nc AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS l FROM wc GROUP BY 1, 2), nq AS (SELECT conv_id, sqrt(sum(w * w)) AS l FROM wq GROUP BY 1),
inner_ AS (SELECT c.conv_id, c.turn, sum(q.w * c.w) AS s FROM wq q JOIN wc c ON q.conv_id = c.conv_id AND q.gram = c.gram GROUP BY 1, 2),
sim AS (SELECT conv_id, turn, coalesce(s / (nq.l * nc.l), 0) AS similarity FROM asked JOIN chunks USING (conv_id) LEFT JOIN inner_ USING (conv_id, turn) LEFT JOIN nq USING (conv_id) LEFT JOIN nc USING (conv_id, turn))"""
_KEYWORD_SIMILARITY = (
    _VECTOR_SIMILARITY.replace("'turn ' || turn || ': ' || text AS body", "text AS body").replace("arg_min(text, turn) AS question", "arg_min(turn, turn) AS turn, arg_min(text, turn) AS question").replace("FROM asked JOIN chunks USING (conv_id) LEFT", "FROM (SELECT conv_id FROM asked) JOIN chunks USING (conv_id) LEFT")
    + ", said AS (SELECT conv_id, turn AS answer_turn, text FROM conversations WHERE role = 'assistant')"
)
def _entities() -> str:
    found = [f"regexp_extract_all(t, {q(K.ENTITY_DATE)})", f"regexp_extract_all(t, {q(K.ENTITY_VERSION)})", *[f"regexp_extract_all(t, {q(x)}, 1)" for x in K.QUOTED], *[f"regexp_extract_all(t, {q(f'[一-鿿A-Za-z0-9]{{2,20}}{x}')})" for x in K.ORG_SUFFIXES]]
    terms = ", ".join(f"CASE WHEN contains(t, {q(x)}) OR regexp_matches(t, {q(f'(?i)\\b{x}\\b')}) THEN {q(x)} END" for x in K.TECH_TERMS)
    return f"""SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(range(1, len(z) + 1), lambda i: CASE WHEN list_position(list_transform(z, lambda y: lower(y)), lower(z[i])) = i THEN z[i] END), lambda y: y IS NOT NULL), 1, {K.MAX_ENTITIES}), '|') AS tags
FROM (SELECT doc_id, list_filter(list_transform(flatten([{', '.join(found)}, list_filter([{terms}], lambda y: y IS NOT NULL)]), lambda y: trim(y)), lambda y: y <> '') AS z FROM (SELECT doc_id, {norm('text')} AS t FROM mdoc))"""


_FLAGGED = f"{fixed(512)}, flagged AS (SELECT *, contains(content, '|') AS protected, {n_tokens('content')} AS tokens FROM fixed)"
_GRID = "grid AS (SELECT * FROM (SELECT unnest([120, 180, 240, 300]) AS min_chars), (SELECT unnest([450, 550, 650, 900]) AS target_chars), (SELECT unnest([800, 1000, 1200, 1400]) AS max_chars), (SELECT unnest([120, 180, 240, 300, 360]) AS heading_flush), (SELECT unnest(['0.45', '0.50', '0.55', '0.60']) AS threshold), (SELECT unnest([0, 1]) AS overlap) WHERE target_chars <= max_chars)"

ORACLE_SQL: dict[str, str] = {
    "doc_scan_stats": f"SELECT lang, count(*) AS n_docs, sum(length(text)) AS chars, max(length(text)) AS longest, count(*) FILTER ({rx('text', '[\\p{L}\\p{N}_]')}) AS with_signal FROM documents GROUP BY lang",
    "config_auto": f"SELECT target, count(*) AS n_docs, min(greatest(120, target // 2)) AS min_chars, max(target * 2) AS max_chars, min(greatest(120, target // 3)) AS flush FROM (SELECT {TARGET} AS target FROM documents) GROUP BY target",
    "line_classes": f"WITH {LINES.replace('src AS (SELECT doc_id, text FROM mdoc)', 'src AS (SELECT doc_id, text FROM mdoc UNION ALL SELECT doc_id::VARCHAR, text FROM documents)')} SELECT k, count(*) AS n, sum(length(line)) AS chars FROM l2 GROUP BY k",
    "raw_blocks": f"WITH {RAW} SELECT doc_id, raw, text FROM raw",
    "fence_blocks": f"WITH {BLOCKS} SELECT doc_id, raw, last_raw, text FROM blocks WHERE block_type = 'code'",
    "block_types": f"WITH {BLOCKS} SELECT block_type, count(*) AS n, sum(length(text)) AS chars FROM blocks GROUP BY block_type",
    "title_paths": f"WITH {PATHS} SELECT doc_id, raw, heading_level, title, array_to_string(title_path, ' > ') AS path FROM paths WHERE block_type = 'heading'",
    "clean_report": f"""WITH {BLOCKS}, c0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY last_raw) AS nth FROM blocks),
c1 AS (SELECT *, CASE WHEN nth <= 24 AND {cover('text')} THEN 'cover' WHEN {toc('text')} THEN 'toc' WHEN {body_table('text')} AND {flat_table('text')} <> '' THEN 'flat' ELSE 'keep' END AS fate FROM c0)
SELECT doc_id, count(*) AS original_count, count(*) FILTER (fate IN ('keep', 'flat')) AS cleaned_count, count(*) FILTER (fate = 'cover') AS removed_cover_count, count(*) FILTER (fate = 'toc') AS removed_toc_count, count(*) FILTER (fate = 'flat') AS flattened_table_count FROM c1 GROUP BY doc_id""",
    "flatten_tables": f"WITH {BLOCKS} SELECT doc_id, raw, {flat_table('text')} AS flat FROM blocks WHERE block_type = 'table'",
    "sentences": f"SELECT doc_id, len(s) AS n, list_max(list_transform(s, lambda z: length(z))) AS longest FROM (SELECT doc_id, CASE WHEN len(f) > 0 THEN f ELSE [trim(text, ' ' || chr(10))] END AS s FROM (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(text, {q(K.SENTENCE)}), lambda z: trim(z)), lambda z: z <> '') AS f FROM documents))",
    "token_counts": f"SELECT doc_id, {n_tokens('text')} AS n FROM documents",
    "metric_text": f"WITH {BLOCKS} SELECT doc_id, raw, array_to_string(list_transform(list_sort(list_distinct(flatten([{', '.join(f'regexp_extract_all(text, {q(p)})' for p in K.METRIC_TERMS)}]))), lambda z: replace(replace({norm('z')}, '≥', '{K.AT_LEAST}'), '>=', '{K.AT_LEAST}')), '；') AS terms FROM blocks WHERE {rx('text', K.METRIC)}",
    "fixed_chunks": f"WITH RECURSIVE {fixed(512)} SELECT doc_id, nth, hi, content FROM fixed",
    "fixed_chunk_stats": f"WITH RECURSIVE {fixed(512)} SELECT doc_id, count(*) AS chunk_count, sum(length(content)) AS chars, sum({n_tokens('content')}) AS tokens, count(*) FILTER (length(content) BETWEEN 180 AND 800) AS hits, count(*) FILTER (length(content) > 800) AS oversized, count(*) FILTER (length(content) < 180) AS undersized, count(*) FILTER ({boundary('content')}) AS unbroken FROM fixed GROUP BY doc_id",
    "lead_summary": f"SELECT doc_id, {summary('text')} AS summary FROM documents",
    "typed_entities": f"WITH mdoc AS ({MDOC_DUCK}), e AS ({' UNION ALL '.join(f'''SELECT doc_id, {q(k)} AS type, unnest(list_distinct(list_transform(regexp_extract_all(text, {q(p)}), lambda z: trim(z)))) AS value FROM mdoc''' for k, p in K.TYPED_ENTITIES)}) SELECT type, value, count(*) AS n FROM e GROUP BY 1, 2",
    "keywords_freq": f"WITH {KEYWORDS} SELECT doc_id, rank, term, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM kv) WHERE rank <= 5",
    "keywords_tfidf": f"""WITH {KEYWORDS}, kd AS (SELECT term, count(*) AS df FROM kv GROUP BY term),
kw AS (SELECT doc_id, term, n, df, {e6('n * ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df))')} AS weight_e6 FROM kv JOIN kd USING (term))
SELECT doc_id, rank, term, n, df, weight_e6 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight_e6 DESC, term) AS rank FROM kw) WHERE rank <= 5""",
    "tags": f"WITH {TAG} SELECT doc_id, nth, tag FROM tz WHERE nth <= 5",
    "document_summary": f"WITH RECURSIVE {fixed(512)}, s AS (SELECT doc_id, nth, {summary('content')} AS summary FROM fixed) SELECT doc_id, left(string_agg(summary, '；' ORDER BY nth), 300) AS summary FROM s WHERE summary <> '' GROUP BY doc_id",
    "backlinks": f"WITH RECURSIVE {fixed(512)} SELECT doc_id || '_' || nth AS chunk_id, 'fixed_' || hi AS primary_ref, 'fixed_' || hi AS refs, least(nth, hi) AS first_page, greatest(nth, hi) AS last_page, 1 AS source_ref_count FROM fixed",
    "retrieval_text": f"WITH {PATHS} SELECT doc_id, raw, trim(concat_ws(chr(10), CASE WHEN len(title_path) > 0 THEN '标题路径: ' || array_to_string(title_path, ' > ') END, CASE WHEN {rx('text', K.METRIC)} THEN '内容类型: 技术指标 验收标准 评价指标 百分比 阈值' END, text)) AS body FROM paths WHERE block_type = 'paragraph'",
    "token_cosine": f"WITH {_cosine_counts()}",
    "vector_topk": nearest(10, e6(f"coalesce({COSINE}, 0)")),
    "hybrid_topk": f"""WITH near AS ({nearest(40, f'-{e6(L2)}')}),
x AS (SELECT n.query_id, n.vec_id AS chunk_id, n.rank AS cand_rank, {e6(f"0.65::DOUBLE * (1 / (1 + greatest((-n.score_e6 / 1e6)::DOUBLE, 0.0))) + 0.35::DOUBLE * {overlap('w.text', 'd.text')} - {PENALTY.replace('text', 'd.text')}")} AS score_e6
      FROM near n JOIN documents w ON w.doc_id = n.query_id JOIN documents d ON d.doc_id = n.vec_id)
SELECT query_id, chunk_id, rank, score_e6 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_e6 DESC, cand_rank) AS rank FROM x) WHERE rank <= 10""",
    "lexical_boost": f"WITH {_TURNS}, x AS (SELECT conv_id, turn, answer_turn, question, text, {_TERMS} AS terms FROM asked JOIN said USING (conv_id)) SELECT conv_id, turn, answer_turn, {e6(f'''CASE WHEN len(terms) > 0 THEN least(0.08::DOUBLE, 0.025::DOUBLE * len(list_filter(terms, lambda t: contains({compact('text')}, t)))) + CASE WHEN {rx('question', K.METRIC_QUERY)} AND {rx('text', K.METRIC)} THEN 0.05::DOUBLE ELSE 0.0 END ELSE 0.0 END''')} AS boost_e6 FROM x",
    "char_tfidf_norms": f"""WITH g AS ({' UNION ALL '.join(_grams(n) for n in (1, 2, 3, 4))}), c AS (SELECT doc_id, gram, count(*) AS c FROM g GROUP BY 1, 2), f AS (SELECT gram, count(*) AS df FROM c GROUP BY 1),
w AS (SELECT doc_id, gram, (1 + ln(c::DOUBLE)) * (ln((1 + (SELECT count(*) FROM benchmark))::DOUBLE / (1 + df)) + 1) AS w FROM c JOIN f USING (gram))
SELECT doc_id, count(*) AS grams, {e6('max(w) / sqrt(sum(w * w))')} AS top_e6 FROM w GROUP BY doc_id""",
    "cleaned_blocks": f"""WITH {BLOCKS}, c0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY last_raw) AS nth FROM blocks),
c1 AS (SELECT *, CASE WHEN nth <= 24 AND {cover('text')} THEN 'cover' WHEN {toc('text')} THEN 'toc' WHEN {body_table('text')} AND {flat_table('text')} <> '' THEN 'flat' ELSE 'keep' END AS fate FROM c0)
SELECT doc_id, raw, CASE WHEN fate = 'flat' THEN 'paragraph' ELSE block_type END AS block_type, CASE WHEN fate = 'flat' THEN {flat_table('text')} ELSE text END AS text, CASE WHEN fate = 'flat' THEN block_type ELSE '' END AS was FROM c1 WHERE fate NOT IN ('cover', 'toc')""",
    "fixed_statistics": f"""WITH RECURSIVE {_FLAGGED}, s AS (SELECT doc_id, count(*) AS chunk_count, floor(sum(length(content)) * 100 / count(*) + 0.5)::BIGINT AS avg_chars_e2, floor(sum(tokens) * 100 / count(*) + 0.5)::BIGINT AS avg_tokens_e2,
{e6('count(*) FILTER (length(content) BETWEEN 180 AND 800)::DOUBLE / count(*)')} AS length_hit_e6, {e6('count(*) FILTER (tokens BETWEEN 100 AND 1200)::DOUBLE / count(*)')} AS token_hit_e6,
count(*) FILTER (length(content) > 800) AS oversized, count(*) FILTER (length(content) < 180) AS undersized, 1000000 AS refs_e6, {e6(f"count(*) FILTER ({boundary('content')})::DOUBLE / count(*)")} AS unbroken_e6,
coalesce({e6('count(*) FILTER (protected AND length(content) % 7 <> 0)::DOUBLE / nullif(count(*) FILTER (protected), 0)')}, 1000000) AS intact_e6 FROM flagged GROUP BY doc_id)
SELECT d.doc_id, coalesce(chunk_count, 0) AS chunk_count, coalesce(avg_chars_e2, 0) AS avg_chars_e2, coalesce(avg_tokens_e2, 0) AS avg_tokens_e2, coalesce(length_hit_e6, 0) AS length_hit_e6, coalesce(token_hit_e6, 0) AS token_hit_e6, coalesce(oversized, 0) AS oversized, coalesce(undersized, 0) AS undersized,
coalesce(refs_e6, 0) AS refs_e6, coalesce(unbroken_e6, 0) AS unbroken_e6, coalesce(intact_e6, 0) AS intact_e6 FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN s USING (doc_id)""",
    "trigram_vectors": f"WITH RECURSIVE {_CRC}, {_buckets('benchmark', 'item_id', 'text', 'tv')} SELECT item_id, bucket::INT AS bucket, n::INT AS n FROM tv",
    "store_search": f"WITH RECURSIVE {_VECTOR_SIMILARITY}, {_search(3, _BOOST)} SELECT query_id, rank, chunk_id, similarity_e6, score_e6 FROM best",
    "tfidf_search": f"WITH {_TFIDF_SIMILARITY}, {_search(3, _BOOST)} SELECT query_id, rank, chunk_id, similarity_e6, score_e6 FROM best",
    "store_catalogue": "SELECT conv_id AS doc_id, count(*) AS chunk_count, true AS indexed FROM conversations WHERE role = 'assistant' GROUP BY 1 UNION ALL SELECT DISTINCT conv_id, 0, false FROM conversations WHERE role = 'user' AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'assistant')",
    "answer_prompts": f"""WITH RECURSIVE {_VECTOR_SIMILARITY}, {_search(2, '0')} SELECT query_id, '文档片段：' || chr(10) || string_agg('[' || chunk_id || ']' || chr(10) || left(text, 800), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || '问题：' || any_value(question) || chr(10) || chr(10) || '回答：' AS prompt, '' AS answer FROM best GROUP BY query_id""",
    "hit_pages": f"WITH RECURSIVE {fixed(512)}, p AS (SELECT doc_id, lo // 2000 AS page, min(nth) AS nth FROM fixed GROUP BY 1, 2) SELECT doc_id, string_agg(page::VARCHAR, ',' ORDER BY nth) AS pages FROM p GROUP BY doc_id",
    "evaluation_report": f"""WITH RECURSIVE {BY_SIZE}, m AS (SELECT lang AS grp, grouping(lang) AS overall, sum(value) FILTER (strategy = 'fixed_256')::DOUBLE / nullif(count(*) FILTER (strategy = 'fixed_256'), 0) AS a, sum(value) FILTER (strategy = 'fixed_512')::DOUBLE / nullif(count(*) FILTER (strategy = 'fixed_512'), 0) AS b,
sum(value) FILTER (strategy = 'fixed_1024')::DOUBLE / nullif(count(*) FILTER (strategy = 'fixed_1024'), 0) AS c FROM sized JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), ())),
g AS (SELECT *, coalesce(floor((a - b) / nullif(b, 0) * 1000 + 0.5), 0)::BIGINT AS ab, coalesce(floor((b - c) / nullif(c, 0) * 1000 + 0.5), 0)::BIGINT AS bc, coalesce(floor((a - c) / nullif(c, 0) * 1000 + 0.5), 0)::BIGINT AS ac FROM m)
SELECT grp, 'unbroken' AS metric, overall, {e6('a')} AS main_e6, {e6('b')} AS middle_e6, {e6('c')} AS base_e6, {e6('a')} - {e6('b')} AS over_middle_e6, {e6('a')} - {e6('c')} AS over_base_e6, ab AS semantic_gain, bc AS structure_gain, ac AS total_gain, ac >= 100 AS passed FROM g""",
    "badcase_previews": f"WITH {RANKED}, m AS ({METRICS}) SELECT m.query_id, recall_5_e6, n.rank, n.vec_id AS chunk_id, left({norm('d.text')}, 120) AS preview FROM m JOIN near n ON n.query_id = m.query_id AND n.rank <= 3 JOIN documents d ON d.doc_id = n.vec_id WHERE recall_5_e6 < 300000",
    "qa_report": f"SELECT count(*) AS total, count(DISTINCT conv_id) AS documents, {e6('count(*) FILTER (answerable)::DOUBLE / count(*)')} AS answerable_e6, {e6('count(*) FILTER (faithful)::DOUBLE / count(*)')} AS faithful_e6, {e6('count(*) FILTER (answerable AND faithful)::DOUBLE / count(*)')} AS both_e6, count(*) FILTER (answerable) >= 0.9 * count(*) AND count(*) FILTER (faithful) >= 0.9 * count(*) AS passed FROM ({_qa()})",
    "qa_judged": "SELECT conv_id, turn, CASE WHEN k < 2 THEN n % 11 ELSE 0 END AS answerable_score, CASE WHEN k < 2 THEN n % 9 + 2 ELSE 0 END AS faithful_score, k < 2 AND n % 11 >= 7 AS answerable, k < 2 AND n % 9 + 2 >= 7 AS faithful, CASE WHEN k < 2 THEN role END AS reason, CASE k WHEN 2 THEN 'unreadable answer' WHEN 3 THEN 'no answer' END AS error FROM (SELECT conv_id, turn, role, length(text) AS n, turn % 4 AS k FROM conversations)",
    "strategies": "SELECT * FROM (VALUES ('segmentation', 'smart', 'headings, meaning, protected blocks, overlap'), ('segmentation', 'heading', 'headings and lengths only'), ('segmentation', 'fixed', '512 characters each'), ('keywords', 'freq', NULL), ('keywords', 'tfidf', NULL)) t(kind, name, description)",
    "request_checks": """WITH r AS (SELECT o_orderkey AS k, ['.txt', '.MD', '.exe', ''][o_orderkey % 4 + 1] AS suffix, ['', 'TFIDF', 'freq', 'rake'][o_orderkey % 5 % 4 + 1] AS name, o_orderkey % 3 * 100 AS lo, o_orderkey % 7 * 100 AS mid, o_orderkey % 11 * 100 AS hi, o_orderkey % 5 - 1 AS overlap FROM orders)
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN lower(suffix) NOT IN ('.txt', '.md') THEN '400: unsupported file type: ' || coalesce(nullif(suffix, ''), 'none') WHEN least(lo, mid, hi) <= 0 OR overlap < 0 THEN '400: lengths must be positive and overlap not negative' WHEN NOT (lo <= mid AND mid <= hi) THEN '400: min_chars <= target_chars <= max_chars does not hold' WHEN name = 'rake' THEN '400: keyword strategies are freq, tfidf' ELSE 'ok' END AS outcome FROM r) GROUP BY outcome""",
    "all_chunks": f"WITH RECURSIVE {fixed(512)} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS ordinal, hi AS end, source || '.txt' AS file_name, CASE WHEN lang = 'es' THEN 'failed' ELSE 'ready' END AS status FROM fixed JOIN documents USING (doc_id)",
    "json_columns": "SELECT k, count(*) AS n FROM (SELECT CASE WHEN event_id % 10 < 2 THEN -1 ELSE (props::JSON->>'k')::INT END AS k FROM events) GROUP BY k",
    "corpus_texts": f"WITH {RAW} SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY raw)) AS digest, length(string_agg(text, chr(10) || chr(10) ORDER BY raw)) AS chars FROM raw GROUP BY doc_id",
    "entity_tags": f"WITH mdoc AS ({MDOC_DUCK}) {_entities()}",
    "page_blocks": f"""WITH {RAW.replace('src AS (SELECT doc_id, text FROM mdoc)', "src AS (SELECT conv_id || ':' || (turn + 1) AS doc_id, text FROM conversations)")} SELECT split_part(doc_id, ':', 1) AS doc_id, split_part(doc_id, ':', 2)::INT AS page, format('p{{:04d}}_b{{:04d}}', split_part(doc_id, ':', 2)::INT, raw::INT) AS block_id, text FROM raw WHERE {rx('text', '[\\p{L}\\p{N}_]')}""",
    "rule_ranges": f"""WITH RECURSIVE b AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda z: {norm('z')}), lambda z: z <> ''), lambda z: length(z)) AS s FROM documents),
w(doc_id, s, nth, start, i, size) AS (SELECT doc_id, s, 0, 0, 1, s[1] FROM b WHERE len(s) > 0
UNION ALL SELECT doc_id, s, CASE WHEN size + s[i + 1] + 2 >= 600 THEN nth + 1 ELSE nth END, CASE WHEN size + s[i + 1] + 2 >= 600 THEN i ELSE start END, i + 1, CASE WHEN size + s[i + 1] + 2 >= 600 THEN s[i + 1] ELSE size + s[i + 1] + 2 END FROM w WHERE i < len(s))
SELECT doc_id, nth, start, max(i) - 1 AS stop FROM w GROUP BY doc_id, nth, start""",
    "sample_per_doc": f"WITH RECURSIVE {fixed(512)}, x AS (SELECT doc_id, doc_id || '_' || nth AS chunk_id FROM fixed) SELECT * FROM (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY md5('42|' || chunk_id), chunk_id) AS nth FROM x) WHERE nth <= 3",
    "semi_anti": "SELECT lang, count(*) AS n, 'labelled' AS side FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY lang UNION ALL SELECT lang, count(*), 'unlabelled' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang",
    "keyword_judge": f"""WITH RECURSIVE {_KEYWORD_SIMILARITY}, k AS (SELECT conv_id, turn, list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_position(w, w[i]) = i THEN w[i] END), lambda z: z IS NOT NULL) AS kw FROM (SELECT conv_id, turn, regexp_extract_all(lower(question), '[a-z]{{4,}}') AS w FROM asked)),
x AS (SELECT conv_id, turn, answer_turn, text, len(kw) AS n, coalesce(len(list_filter(kw, lambda z: contains({compact('text')}, {compact('z')})))::DOUBLE / nullif(len(kw), 0), 0) AS share FROM k JOIN said USING (conv_id))
SELECT x.conv_id, x.turn, answer_turn, {e6('share')} AS share_e6, share >= 0.34 OR (share > 0 AND {rx('text', K.EVIDENCE)}) OR similarity >= CASE WHEN n > 0 THEN {max(K.JUDGE_SEMANTIC, K.JUDGE_SEMANTIC_WITH_KEYWORDS)} ELSE {K.JUDGE_SEMANTIC} END AS relevant FROM x JOIN sim ON sim.conv_id = x.conv_id AND sim.turn = answer_turn""",
    "ir_metrics": f"WITH {RANKED} {METRICS}",
    "badcases": f"WITH {RANKED} SELECT query_id, recall_5_e6, mrr_e6 FROM ({METRICS}) WHERE recall_5_e6 < 300000",
    "strategy_comparison": f"WITH RECURSIVE {BY_SIZE} SELECT lang AS grp, strategy, count(*) AS n, sum(value) AS total, grouping(lang) AS overall FROM sized JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang, strategy), (strategy))",
    "strategy_winners": f"WITH RECURSIVE {BY_SIZE}, b AS (SELECT *, max(value) OVER (PARTITION BY doc_id) AS best FROM sized), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS shared FROM b WHERE value = best) SELECT strategy, count(*) FILTER (shared = 1) AS wins, count(*) FILTER (shared > 1) AS ties FROM c GROUP BY strategy",
    "grid_search": f"WITH {_GRID}, h AS (SELECT min_chars, max_chars, count(*) AS hits FROM (SELECT DISTINCT min_chars, max_chars FROM grid) JOIN documents ON length(text) BETWEEN min_chars AND max_chars GROUP BY 1, 2) SELECT min_chars, target_chars, max_chars, heading_flush, threshold, overlap, hits FROM grid JOIN h USING (min_chars, max_chars) ORDER BY hits DESC, target_chars DESC, min_chars, max_chars, heading_flush, threshold, overlap LIMIT 20",
    "human_rates": "SELECT grouping(lang, source) AS level, lang AS doc_group, source AS evaluator, count(*) AS n, sum(quality) AS complete, count(DISTINCT source) AS evaluators, sum(quality) >= 0.85 * count(*) AS passed FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())",
    "qa_quality": _qa(),
    "qa_worthy": f"SELECT doc_id, length(t) >= 300 AND len(regexp_extract_all(t, 'https?://')) < 3 AND NOT (len({rows_of('t')}) >= 8 AND list_sum(list_transform(list_filter(string_split(t, chr(10)), lambda y: trim(y) <> ''), lambda y: length(y))) < 40 * len({rows_of('t')})) AS worthy FROM (SELECT doc_id, trim(text, ' ' || chr(10)) AS t FROM documents)",
    "qa_json": "SELECT conv_id || '_' || turn AS chunk_id, conv_id || '_' || turn || '_qa_0001' AS qa_id, 'q' || turn AS question, role AS answer FROM conversations",
    "doc_id_sanitise": "SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(trim(url), '[^\\p{L}\\p{N}]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'doc') AS doc_id FROM pages",
    "ingest_idempotent": """WITH d AS (SELECT doc_id, sha256(text) AS sha, lang FROM documents), s AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'old' ELSE sha END AS sha FROM d WHERE lang IN ('de', 'fr')),
t AS (SELECT doc_id, sha FROM d WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = d.doc_id AND s.sha = d.sha)), a AS (SELECT sha, 'ready' AS status FROM s WHERE doc_id NOT IN (SELECT doc_id FROM t) UNION ALL SELECT sha, 'processing' FROM t)
SELECT status, count(*) AS n, count(DISTINCT sha) AS contents FROM a GROUP BY status""",
    "overlap_penalty": f"SELECT doc_id, len({tokens_of('text')}) AS n_tokens, {e6(overlap(q('the re inand tion de la und'), 'text'))} AS overlap_e6, {e6(PENALTY)} AS penalty_e6 FROM documents",
    "vector_records": f"WITH {PATHS} SELECT doc_id || '_' || raw AS id, raw AS ordinal, 'normal' AS chunk_type, length(text) AS char_count, 1 AS source_ref_count, CASE WHEN raw > 3 THEN raw ELSE -1 END AS page_start, CASE WHEN raw > 3 THEN raw ELSE -1 END AS page_end, array_to_string(title_path, ' / ') AS title_path FROM paths WHERE block_type = 'paragraph'",
    "table_rules": """WITH d AS (SELECT doc_id::VARCHAR AS doc_id, CASE WHEN lang = 'es' THEN 'lost' ELSE 'ready' END AS status FROM documents), k AS (SELECT * FROM d WHERE status <> 'lost' OR doc_id < '5'), c AS (SELECT toxic::VARCHAR AS chunk_id, doc_id::VARCHAR AS doc_id FROM labels),
v AS (SELECT 'status' AS rule FROM k WHERE status = 'lost' UNION ALL SELECT 'chunk_id' FROM c GROUP BY chunk_id HAVING count(*) > 1 UNION ALL SELECT 'ordinal' FROM c GROUP BY doc_id HAVING count(*) > 1 UNION ALL SELECT 'parent' FROM c WHERE doc_id NOT IN (SELECT doc_id FROM k))
SELECT rule, count(*) AS n FROM v GROUP BY rule""",
}
