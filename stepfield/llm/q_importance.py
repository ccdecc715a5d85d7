"""op11: documents drawn in proportion to their likeness to the benchmark's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepfield.llm import importance
from stepfield.llm.common import table


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op11_importance_resampling": op11_importance_resampling}
# The checksum bit by bit: each byte is xored into the register, then the register is shifted eight times (seven of them with 0).
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op11_importance_resampling": f"""
WITH a AS (SELECT doc_id, 0 AS side, {_WORDS} AS w FROM documents UNION ALL SELECT item_id, 1, {_WORDS} FROM benchmark),
f AS (SELECT doc_id, side, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM a),
h AS (SELECT feature, hex(feature) AS x FROM (SELECT DISTINCT feature FROM f)),
y AS (SELECT feature, list_transform(range(0, 4 * len(x)), lambda j: CASE WHEN j % 8 = 0
  THEN 16 * (instr('0123456789ABCDEF', x[j // 4 + 1]) - 1) + instr('0123456789ABCDEF', x[j // 4 + 2]) - 1 ELSE 0 END) AS bits FROM h),
c AS (SELECT feature, xor(list_reduce(bits, lambda s, b: CASE WHEN xor(s, b) % 2 = 1 THEN xor(xor(s, b) // 2, 3988292384) ELSE xor(s, b) // 2 END, 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM y),
n AS (SELECT doc_id, side, bucket, count(*) AS n FROM f JOIN c USING (feature) GROUP BY ALL),
b AS (SELECT r.i AS bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM range(10000) r(i) LEFT JOIN n ON n.bucket = r.i GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM b) + 10000) / ((s + 1) * ((SELECT sum(t) FROM b) + 10000))))::BIGINT AS gain FROM b),
d AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM n JOIN g USING (bucket) WHERE side = 0 GROUP BY 1),
e AS (SELECT a.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
  + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || a.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM a LEFT JOIN d USING (doc_id) WHERE side = 0),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE n_words >= 20)
SELECT e.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM r) THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)
"""
}
