"""Structured texts derived from the conversation and order tables, for the document operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MDOC = """
SELECT concat('conv_', conv_id) AS doc_id,
       concat('# Conversation ', conv_id, '\\n\\n', listagg(concat('## ', turn, '. ', role, '\\n', text), '\\n\\n') WITHIN GROUP (ORDER BY turn)) AS text
FROM {conversations} GROUP BY conv_id
UNION ALL
SELECT concat('order_', o.o_orderkey),
       concat('第1章 Order ', o.o_orderkey, '\\n一、概述\\nStatus ', o.o_orderstatus, ' priority ', o.o_orderpriority, '\\n\\n',
              '| line | part | flag |\\n| --- | ---: | --- |\\n', t.body, '\\n\\n',
              '1.1 验收标准\\n不破句率: 100%\\nRecall@5: +', o.o_orderkey % 100, '%\\n\\n',
              '•\\nfirst item ', o.o_custkey, '\\n- second item\\n\\n', '```\\ncode ', o.o_orderkey, '\\n```\\n\\nAfter code.\\n\\n',
              '![fig](http://example.org/', o.o_orderkey, '.png)\\n\\nx = ', o.o_custkey)
FROM {orders} o JOIN (
  SELECT l_orderkey, listagg(concat('| ', l_linenumber, ' | ', l_partkey, ' | ', l_returnflag, ' |'), '\\n')
         WITHIN GROUP (ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS body
  FROM {lineitem} GROUP BY l_orderkey) t ON t.l_orderkey = o.o_orderkey
"""

MDOC_DUCK = """
SELECT 'conv_' || conv_id::VARCHAR AS doc_id,
       '# Conversation ' || conv_id::VARCHAR || (chr(10) || chr(10)) ||
       string_agg('## ' || turn::VARCHAR || '. ' || role || chr(10) || text, (chr(10) || chr(10)) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id
UNION ALL
SELECT 'order_' || o.o_orderkey::VARCHAR,
       '第1章 Order ' || o.o_orderkey::VARCHAR || chr(10) || '一、概述' || chr(10) || 'Status ' || o.o_orderstatus || ' priority ' || o.o_orderpriority || (chr(10) || chr(10)) ||
       '| line | part | flag |' || chr(10) || '| --- | ---: | --- |' || chr(10) || t.body || (chr(10) || chr(10)) ||
       '1.1 验收标准' || chr(10) || '不破句率: 100%' || chr(10) || 'Recall@5: +' || (o.o_orderkey % 100)::VARCHAR || '%' || (chr(10) || chr(10)) ||
       '•' || chr(10) || 'first item ' || o.o_custkey::VARCHAR || chr(10) || '- second item' || (chr(10) || chr(10)) ||
       '```' || chr(10) || 'code ' || o.o_orderkey::VARCHAR || chr(10) || '```' || (chr(10) || chr(10)) || 'After code.' || (chr(10) || chr(10)) ||
       '![fig](http://example.org/' || o.o_orderkey::VARCHAR || '.png)' || (chr(10) || chr(10)) || 'x = ' || o.o_custkey::VARCHAR
FROM orders o JOIN (
  SELECT l_orderkey, string_agg('| ' || l_linenumber::VARCHAR || ' | ' || l_partkey::VARCHAR || ' | ' || l_returnflag || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS body
  FROM lineitem GROUP BY l_orderkey) t ON t.l_orderkey = o.o_orderkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mdoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: headings of three styles, a table, metric lines, bullets, a fence, an image and a formula."""
    return spark.sql(MDOC, **{n: table(spark, sf_dir, n) for n in ("conversations", "orders", "lineitem")})
