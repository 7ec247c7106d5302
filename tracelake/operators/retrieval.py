"""Retrieval: BM25 by an inverted index of joins, and nearest vectors by blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.scaling import frequent
from tracelake.session import materialise

#: Bytes of query vectors that are sent to the executors at a time, and parts that a frequent term's documents go to.
BLOCK_BYTES, SALTS = 64 << 20, 32


def bm25(corpus: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``query_id, doc_id, score``: the ``k`` best documents of each query.

    ``corpus`` has ``doc_id, toks``, ``queries`` ``query_id, toks``; a term repeated in a query counts once.
    Ties go to the smaller ``doc_id``. Queries without a known term, and empty tables, give no rows.
    """
    size = corpus.select("doc_id", F.size("toks").alias("dl"))
    total = size.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = corpus.select("doc_id", F.explode("toks").alias("tok")).groupBy("doc_id", "tok").agg(F.count("*").alias("tf"))
    df = tf.groupBy("tok").agg(F.count("*").alias("df"))
    # terms in a large part of the documents, of which there are few, are spread over several tasks
    hot = frequent(df, "df").select("tok", F.lit(SALTS).alias("parts"))
    asked = queries.select("query_id", F.explode(F.array_distinct("toks")).alias("tok")).join(df, "tok").join(F.broadcast(hot), "tok", "left")
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    tf = tf.join(F.broadcast(hot), "tok", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    hit = asked.join(tf, ["tok", "salt"]).join(size, "doc_id").crossJoin(F.broadcast(total))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hit.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def nearest(corpus: DataFrame, queries: DataFrame, k: int, digits: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``q, nb, sim``: the ``k`` vectors of ``corpus`` (``nb, vector``) nearest by cosine to each of ``queries`` (``q, vector``), exactly.

    A vector is never its own neighbour. Similarities are rounded to ``digits``, ties go to the smaller ``nb``;
    zero and null vectors have similarity 0 to all. Queries go to the executors in blocks of at most
    ``block_bytes``, each block written before the next; every batch of the corpus gives its own ``k`` nearest,
    so what is shuffled grows with batches, not pairs. Empty tables give no rows.
    """
    spark = corpus.sparkSession
    row = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    blocks = max(1, -(-row["n"] * max(row["dims"] or 1, 1) * 8 // block_bytes))
    kinds = dict(queries.dtypes)["q"], dict(corpus.dtypes)["nb"]

    def unit(vectors, dims: int) -> np.ndarray:
        x = np.array([np.zeros(dims) if v is None else v for v in vectors], dtype=np.float64).reshape(len(vectors), dims)
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    out = None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).collect()  # at most about block_bytes
        shared = spark.sparkContext.broadcast(([r["q"] for r in own], unit([r["vector"] for r in own], row["dims"] or 0)))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, vectors = shared.value
            for f in frames:
                if not len(f) or not ids:
                    continue
                nb = f["nb"].to_numpy()
                order = np.argsort(nb, kind="stable")
                nb, other = nb[order], unit(f["vector"].to_numpy()[order], vectors.shape[1])
                for lo in range(0, len(ids), 1024):
                    sim = np.floor(vectors[lo : lo + 1024] @ other.T * 10**digits + 0.5) / 10**digits
                    sim[np.asarray(ids[lo : lo + 1024])[:, None] == nb[None, :]] = -2.0
                    best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                    yield pd.DataFrame({"q": np.repeat(ids[lo : lo + 1024], best.shape[1]), "nb": nb[best].ravel(), "sim": np.take_along_axis(sim, best, 1).ravel()})

        part = corpus.select("nb", "vector").mapInPandas(run, f"q {kinds[0]}, nb {kinds[1]}, sim double").where("sim > -2")
        if blocks > 1:
            part = materialise(part)
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "nb")
    return out.select("q", "nb", F.round("sim", digits).alias("sim")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")
