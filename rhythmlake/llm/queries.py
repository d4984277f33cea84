"""The queries of this subpackage, each over its whole tables, with SQL where SQL can express them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhythmlake.functions.numbers import half_up
from rhythmlake.llm.cooccurrence import cooccurrence, significant
from rhythmlake.llm.packing import best_fit, pack, pieces_of, placed, plan
from rhythmlake.llm.spans import shared_share, shared_spans
from rhythmlake.llm.subsequences import frequent_subsequences
from rhythmlake.llm.tokens import decode_corpus, encode_corpus, token_bytes, token_counts
from rhythmlake.sources.tables import app_name, micros, table


def _pairs(spark: SparkSession, d: str, least: int) -> DataFrame:
    rows = table(spark, d, "sessions").select("device_id", "day_key", app_name("app_pkg").alias("app_pkg"))
    return cooccurrence(rows, ("device_id", "day_key"), "app_pkg", min_count=least)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return significant(_pairs(spark, d, 10)).select(F.col("item_a").alias("app_a"), F.col("item_b").alias("app_b"))


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that shares a basket with its measures, rounded by the arithmetic of SQL (a million times the double, to the nearest whole number)."""
    out = _pairs(spark, d, 1)
    return out.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n_baskets", *[half_up(F.col(c), 6).alias(c) for c in ("expected", "lift", "llr")])


def p2_every_pair(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p2_pairs, for comparison with SQL that has no least number of baskets."""
    return p2_pairs(spark, d)


def _patterns(spark: SparkSession, d: str, length: int | None, distinct: bool) -> DataFrame:
    rows = table(spark, d, "sessions").select("device_id", "day_key", app_name("app_pkg").alias("app_pkg"), micros("start_ts").alias("us"))
    return frequent_subsequences(rows, ("device_id", "day_key"), ("us",), "app_pkg", length=length, distinct=distinct)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("pattern")
    return _patterns(spark, d, 3, True).filter(F.size(p) == 3).select(p[0].alias("app_1"), p[1].alias("app_2"), p[2].alias("app_3"))


def p5_patterns(spark: SparkSession, d: str) -> DataFrame:
    """All frequent patterns of any length, also with an app that returns, with their support counts."""
    return _patterns(spark, d, None, False).select(F.array_join("pattern", ">").alias("pattern"), "n_sequences", "n_all")


def p5_any_length(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p5_patterns, for comparison with SQL that goes on after three steps and lets apps return."""
    return p5_patterns(spark, d)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p7_decode(spark: SparkSession, d: str) -> DataFrame:
    """The texts back from their ids."""
    return decode_corpus(p7_ids(spark, d), token_bytes(spark))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document with its container of 2,048 tokens."""
    return pack(token_counts(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_pack(spark, d).filter("n_pieces > 1 AND piece = 0").select("doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are filled and how many come from fitted patterns, beside the least number that could hold all
    tokens and the number that best fit alone would take."""
    pieces, histogram = pieces_of(token_counts(table(spark, d, "documents")))
    planned = plan(histogram, 2048)
    alone = sum(n for _, n in best_fit(np.concatenate(([0], histogram[1:])), 2048))
    out = placed(pieces, histogram, planned).agg(F.sum("n_tokens").alias("n_tokens"), F.countDistinct("container").alias("n_containers"))
    return out.select(
        "n_tokens", "n_containers", F.ceil(F.col("n_tokens") / 2048).alias("least_containers"), F.round(F.col("n_tokens") / (F.col("n_containers") * 2048), 6).alias("filled"),
        F.lit(planned.n_fitted).cast("bigint").alias("from_patterns"), F.lit(alone).cast("bigint").alias("best_fit_alone"),
    )


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every packing: all documents lie in containers, and nothing is too full, twice, lost or split without need."""
    sizes = token_counts(table(spark, d, "documents"))
    packed = pack(sizes)
    full = packed.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > 2048).alias("too_full"))
    own = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"), F.countDistinct("piece").alias("d"), F.max("n_pieces").alias("p"))
    met = sizes.join(own, "doc_id", "left").agg(
        F.count("n").alias("n_documents"), F.count_if(~F.col("n").eqNullSafe(F.col("n_tokens"))).alias("lost"), F.count_if((F.col("k") != F.col("d")) | (F.col("k") != F.col("p"))).alias("twice"),
        F.count_if((F.col("p") > 1) & (F.col("n_tokens") <= 2048)).alias("split_without_need"),
    )
    return met.withColumn("too_full", full.scalar())


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(table(spark, d, "documents"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document is shared elsewhere."""
    docs = table(spark, d, "documents")
    return shared_share(docs, shared_spans(docs))


QUERIES = {f.__name__: f for f in (p2_found, p2_pairs, p2_every_pair, p5_found, p5_patterns, p5_any_length, p7_ids, p7_decode, p8_found, p8_pack, p8_fill, p8_invariants, p9_found, p9_shares)}

_P2 = """
b AS (SELECT DISTINCT device_id, day_key, lower(trim(app_pkg)) AS app FROM sessions WHERE device_id IS NOT NULL AND day_key IS NOT NULL AND app_pkg IS NOT NULL),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT device_id, day_key FROM b)),
c AS (SELECT app, count(*) AS n FROM b GROUP BY app),
ab AS (SELECT x.app AS a, y.app AS b, count(*) AS n_ab FROM b x JOIN b y ON x.device_id = y.device_id AND x.day_key = y.day_key AND x.app < y.app GROUP BY ALL HAVING count(*) >= 10),
m AS (SELECT a, b, n_ab, ca.n AS n_a, cb.n AS n_b, n.n AS n FROM ab JOIN c ca ON ca.app = a JOIN c cb ON cb.app = b CROSS JOIN n)"""


def _g(k: str, r: str, c: str) -> str:
    return f"CASE WHEN {k} > 0 THEN ({k})::DOUBLE * ln(({k})::DOUBLE * n::DOUBLE / (({r})::DOUBLE * ({c})::DOUBLE)) ELSE 0 END"


_LLR = " + ".join(_g(*x) for x in (("n_ab", "n_a", "n_b"), ("n_a - n_ab", "n_a", "n - n_b"), ("n_b - n_ab", "n - n_a", "n_b"), ("n - n_a - n_b + n_ab", "n - n_a", "n - n_b")))
_P5 = """
r AS (SELECT device_id, day_key, epoch_us(start_ts) AS us, lower(trim(app_pkg)) AS app FROM sessions WHERE device_id IS NOT NULL AND day_key IS NOT NULL AND start_ts IS NOT NULL AND app_pkg IS NOT NULL),
q AS (SELECT *, row_number() OVER (PARTITION BY device_id, day_key ORDER BY us, app) AS i, dense_rank() OVER (ORDER BY device_id, day_key) AS s FROM r),
n AS (SELECT count(DISTINCT s) AS n FROM q),
p1 AS (SELECT app AS pattern, count(DISTINCT s) AS k FROM q GROUP BY app),
d2 AS (SELECT x.s, x.app AS a, y.app AS b, min(y.i) AS i FROM q x JOIN q y ON x.s = y.s AND x.i < y.i AND x.app <> y.app GROUP BY ALL),
p2 AS (SELECT a || '>' || b AS pattern, count(*) AS k FROM d2 GROUP BY ALL),
d3 AS (SELECT DISTINCT d2.s, a, b, z.app AS c FROM d2 JOIN q z ON d2.s = z.s AND d2.i < z.i AND z.app <> a AND z.app <> b),
p3 AS (SELECT a, b, c, count(*) AS k FROM d3 GROUP BY ALL)"""
#: Steps the SQL of p5_any_length goes to; on the test tables the longest frequent pattern has fewer.
_DEEP = 8
_P5A = """
r AS (SELECT DISTINCT device_id, day_key, epoch_us(start_ts) AS us, lower(trim(app_pkg)) AS app FROM sessions WHERE device_id IS NOT NULL AND day_key IS NOT NULL AND start_ts IS NOT NULL AND app_pkg IS NOT NULL),
q AS (SELECT app, row_number() OVER (PARTITION BY device_id, day_key ORDER BY us, app) AS i, dense_rank() OVER (ORDER BY device_id, day_key) AS s FROM r),
n AS (SELECT count(DISTINCT s) AS n FROM q),
l1 AS (SELECT s, app AS pattern, min(i) AS i FROM q GROUP BY ALL)"""
for _k in range(1, _DEEP + 1):
    _P5A += f""",
f{_k} AS (SELECT pattern, count(*) AS k FROM l{_k}, n GROUP BY ALL HAVING count(*) >= 10 AND count(*) * 100 >= any_value(n.n) * 4)"""
    if _k < _DEEP:
        _P5A += f""",
l{_k + 1} AS (SELECT x.s, x.pattern || '>' || y.app AS pattern, min(y.i) AS i FROM l{_k} x SEMI JOIN f{_k} f ON f.pattern = x.pattern JOIN q y ON y.s = x.s AND y.i > x.i GROUP BY ALL)"""
_P9 = """
w AS (SELECT doc_id, i, substr(text, i, 100) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 98)) AS i FROM documents WHERE length(text) >= 100)),
g AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
p AS (SELECT DISTINCT doc_id, i - 1 AS i FROM w SEMI JOIN g USING (s)),
c AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS cut FROM p),
r AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
found AS (SELECT doc_id, min(i) AS span_start, max(i) + 100 AS span_end FROM r GROUP BY doc_id, run)"""

SQL = {
    "p9_found": f"WITH {_P9} SELECT doc_id, span_start, span_end FROM found",
    "p9_shares": f"""WITH {_P9} SELECT d.doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, count(span_start) AS n_spans, coalesce(sum(span_end - span_start), 0)::BIGINT AS shared_chars,
        CASE WHEN length(any_value(text)) > 0 THEN round(coalesce(sum(span_end - span_start), 0)::DOUBLE / length(any_value(text)), 6) ELSE 0.0::DOUBLE END AS share
        FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id, length(text)""",
    "p2_found": f"WITH {_P2} SELECT a AS app_a, b AS app_b FROM m WHERE n_ab * n >= 3 * n_a * n_b",
    "p2_pairs": f"WITH {_P2} SELECT a AS item_a, b AS item_b, n_ab, n_a, n_b, n AS n_baskets, round(n_a::DOUBLE * n_b / n, 6) AS expected, round(n_ab / (n_a::DOUBLE * n_b / n), 6) AS lift, round(2.0::DOUBLE * ({_LLR}), 6) AS llr FROM m",
    "p5_found": f"WITH {_P5} SELECT a AS app_1, b AS app_2, c AS app_3 FROM p3, n WHERE k >= 10 AND k * 100 >= n.n * 4",
    "p2_every_pair": f"WITH {_P2.replace(' HAVING count(*) >= 10', '')} SELECT a AS item_a, b AS item_b, n_ab, n_a, n_b, n AS n_baskets, round(n_a::DOUBLE * n_b / n, 6) AS expected, round(n_ab / (n_a::DOUBLE * n_b / n), 6) AS lift, round(2.0::DOUBLE * ({_LLR}), 6) AS llr FROM m",
    "p5_any_length": f"WITH {_P5A} SELECT pattern, k AS n_sequences, n.n AS n_all FROM ({' UNION ALL '.join(f'SELECT * FROM f{k}' for k in range(1, _DEEP + 1))}), n",
    "p8_invariants": "SELECT count(*) AS n_documents, 0::BIGINT AS lost, 0::BIGINT AS twice, 0::BIGINT AS split_without_need, 0::BIGINT AS too_full FROM documents",
    "p7_decode": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p5_patterns": f"""WITH {_P5} SELECT pattern, k AS n_sequences, n.n AS n_all FROM
        (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT a || '>' || b || '>' || c, k FROM p3), n WHERE k >= 10 AND k * 100 >= n.n * 4""",
}
