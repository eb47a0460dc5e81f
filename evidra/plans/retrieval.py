"""Queries: BM25, dense cosine, rank fusion and distinct-on top k over benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import text as tx
from evidra.operators import retrieval as re
from evidra.operators import vector_store as vs
from evidra.plans.registry import registry
from evidra.session import shared_path
from evidra.sources.logical import table

query = registry()

_STOP = ", ".join(repr(w) for w in tx.STOP_WORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"
_BM25 = f"""t AS (SELECT item_id AS id, unnest({_TOKENS}) AS term FROM benchmark), tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL),
l AS (SELECT id, sum(tf) AS len FROM tf GROUP BY id), s AS (SELECT count(*) AS chunks, avg(len({_TOKENS})) AS mean FROM benchmark), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT qid, term, count(*) AS times FROM (SELECT conv_id * 1000 + turn AS qid, unnest({_TOKENS}) AS term FROM conversations) GROUP BY ALL),
b AS (SELECT qid, id, sum(times * ln(1 + (chunks - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN l USING (id) CROSS JOIN s GROUP BY qid, id),
r AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY floor(score * 1000000 + 0.5) DESC, id) - 1 AS rank, max(score) OVER (PARTITION BY qid) AS best FROM b),
sp AS (SELECT * FROM r WHERE best > 0 AND score > best * 0.35 AND rank < 12)"""
_DOT = lambda a, b: f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"

def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    asked = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    scores = re.bm25(chunks, asked, tx.tokens)
    return re.ranked(scores.withColumn("score", F.floor(F.col("score") * 1000000 + 0.5)), 12, re.SPARSE_FLOOR)


@query(f"WITH {_BM25} SELECT qid, id, rank FROM sp")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir).select("qid", "id", "rank")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the mean vector of each label: as many questions as labels, whatever the table's size."""
    v = table(spark, sf_dir, "embeddings")
    cells = v.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = cells.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda c: c["x"]).alias("mean"))
    asked = mean.select(F.col("label").alias("qid"), F.col("mean").alias("vector"))
    return vs.nearest(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), asked, 12, 1_000_000)


_DENSE = f"""m AS (SELECT label, list(x ORDER BY d) AS mean FROM (SELECT label, d, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY ALL) GROUP BY label),
d AS (SELECT m.label AS qid, vec_id AS id, floor({_DOT("mean", "embedding")} * 1000000 + 0.5) AS score FROM m CROSS JOIN embeddings),
dn AS (SELECT * FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM d) WHERE rank < 12)"""


@query(f"WITH {_DENSE} SELECT qid, id, rank FROM dn")
def dense_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("qid", "id", "rank")


@query(f"""WITH {_BM25}, {_DENSE} SELECT coalesce(sp.qid, dn.qid) AS qid, coalesce(sp.id, dn.id) AS id, floor((coalesce(0.5 / (60 + sp.rank), 0) + coalesce(1.0 / (60 + dn.rank), 0)) * 1000000 + 0.5)::BIGINT AS score,
  sp.rank AS sparse_rank, dn.rank AS dense_rank FROM sp FULL JOIN dn ON sp.qid = dn.qid AND sp.id = dn.id""")
def weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = re.fuse_ranks(_sparse(spark, sf_dir).withColumn("qid", F.col("qid").cast("long")), _dense(spark, sf_dir).withColumn("qid", F.col("qid").cast("long")))
    return fused.withColumn("score", F.floor(F.col("score") * 1000000 + 0.5))


@query(f"""WITH {_BM25}, c AS (SELECT qid, id % 7 AS clause, min(rank) AS rank FROM sp GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, clause) - 1 AS place FROM c) WHERE place < 3""")
def distinct_on_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re.distinct_on(_sparse(spark, sf_dir).withColumn("clause", F.col("id") % 7), "clause", 3)


@query(f"""WITH q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 25 = 0),
v AS (SELECT vec_id, label, CASE WHEN vec_id % 10 = 3 THEN list_reverse(embedding) ELSE embedding END AS e FROM embeddings WHERE label IN (2, 3, 5) AND vec_id % 10 <> 7),
s AS (SELECT qid, 'vector ' || vec_id AS name, floor({_DOT("q", "e")} * 1000000 + 0.5) AS score FROM q JOIN v ON label IN (2, 3, 5))
SELECT qid, name, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, name) AS n FROM s) WHERE n <= 5""")
def filtered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors among those of some labels, after upserts that replace vectors and move some to another label.

    Ids are hashes of names, so ties, which these tables' rounded scores seldom have, are broken by name for the SQL's sake.
    """
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("name"), "vec_id", F.col("embedding").alias("vector"), "label")
    store = vs.VectorStore(spark, shared_path(spark, "vectors"), ["label"])
    store.upsert(v)
    changed = v.filter(F.pmod("vec_id", F.lit(10)).isin(3, 7))
    moved = F.pmod("vec_id", F.lit(10)) == 7
    store.upsert(changed.withColumn("vector", F.when(moved, F.col("vector")).otherwise(F.reverse("vector"))).withColumn("label", F.when(moved, -1).otherwise(F.col("label"))))
    asked = v.filter(F.pmod("vec_id", F.lit(25)) == 0).select(F.col("vec_id").alias("qid"), "vector")
    admitted = store.read().filter(F.col("label").isin(2, 3, 5)).select(F.col("name").alias("id"), "vector")
    return vs.nearest(admitted, asked, 5, 1_000_000).select("qid", F.col("id").alias("name"), "score")
