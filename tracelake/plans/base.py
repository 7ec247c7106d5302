"""Tables that several queries start from, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.operators.scaling import join_by_frequency
from tracelake.session import materialise, read, spread


def sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{T.SPACE}+'), lambda w: w <> '')"


def sql_tokens(c: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(lower({c}), '{T.SPACE}+'), lambda w: trim(w, '.,;:!?')), lambda w: w <> '')"


EV = """ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY extra_info.id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM evaluations) WHERE rn = 1)"""
PAIRS = EV + """, pairs AS (SELECT ex_id, ref, cand, cand_idx, is_member, w FROM (
    SELECT extra_info.id AS ex_id, reward_model.ground_truth AS ref, unnest(responses) AS cand, unnest(range(len(responses)))::INT AS cand_idx,
           extra_info.is_member AS is_member, extra_info.mia_weight AS w FROM ev) WHERE ref IS NOT NULL AND cand IS NOT NULL)"""
TPAIRS = PAIRS + f""", tp AS (SELECT *, {sql_tokens('ref')} AS rt, {sql_tokens('cand')} AS ct FROM pairs)"""


def evaluations(spark, d: str) -> DataFrame:
    """The last loaded row of every evaluation."""
    w = Window.partitionBy("extra_info.id").orderBy(F.desc_nulls_last("loaded_at"))
    return read(spark, d, "evaluations").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def pairs(spark, d: str) -> DataFrame:
    """``ex_id, ref, cand, cand_idx, is_member, w``: every response with its reference."""
    return evaluations(spark, d).select(
        F.col("extra_info.id").alias("ex_id"), F.col("reward_model.ground_truth").alias("ref"), F.posexplode("responses").alias("cand_idx", "cand"),
        F.col("extra_info.is_member").alias("is_member"), F.col("extra_info.mia_weight").alias("w"),
    ).where("ref is not null and cand is not null")


def token_pairs(spark, d: str) -> DataFrame:
    return pairs(spark, d).withColumns({"rt": T.tokens(F.col("ref")), "ct": T.tokens(F.col("cand"))})


BAG = f"""tok AS (SELECT doc_id, source, unnest({sql_tokens('text')}) AS tok FROM documents WHERE text IS NOT NULL),
bag AS (SELECT doc_id, source, tok, count(*) AS n FROM tok GROUP BY ALL),
total AS (SELECT sum(n) AS total FROM bag),
lm AS (SELECT tok, ln(sum(n) / (SELECT total FROM total)) AS lp, sum(n) AS cnt FROM bag GROUP BY tok),
scored AS (SELECT b.doc_id, b.source, b.tok, b.n, lm.lp, lm.cnt FROM bag b JOIN lm USING (tok))"""


def spoken(spark, d: str) -> DataFrame:
    """``doc_id, source, tok``: a row per token of every document."""
    docs = spread(read(spark, d, "documents").where("text is not null").select("doc_id", "source", "text"))
    # one word a row before its punctuation goes, so that all of it runs in generated code
    words = docs.select("doc_id", "source", F.explode(F.split(F.lower("text"), T.SPACE + "+")).alias("w"))
    return words.select("doc_id", "source", F.btrim("w", F.lit(T.PUNCTUATION)).alias("tok")).where("tok <> ''")


def bag(spark, d: str) -> DataFrame:
    """``doc_id, source, tok, n``: the tokens of every document with their counts."""
    return spoken(spark, d).groupBy("doc_id", "source", "tok").agg(F.count("*").alias("n"))


def unigrams(spark, d: str) -> DataFrame:
    """``tok, lp, cnt``: every token of the corpus with its log-probability and count; written, as it is read several times."""
    per = materialise(spoken(spark, d).groupBy("tok").agg(F.count("*").alias("cnt")))
    total = per.agg(F.sum("cnt").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("tok", F.log(F.col("cnt") / F.col("total")).alias("lp"), "cnt")


def scored_bag(spark, d: str) -> DataFrame:
    """:func:`bag` with the log-probability ``lp`` of each token in the whole corpus."""
    return join_by_frequency(bag(spark, d), unigrams(spark, d), "tok", "cnt")


QUALITY = """lab AS (SELECT doc_id, quality = 1 AS is_member FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rated_at DESC NULLS LAST, rater NULLS LAST) AS rn FROM labels WHERE quality IS NOT NULL) WHERE rn = 1)"""


def quality(spark, d: str) -> DataFrame:
    """``doc_id, is_member``: the latest quality rating of each rated document."""
    w = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("rated_at"), F.asc_nulls_last("rater"))
    return read(spark, d, "labels").where("quality is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("doc_id", (F.col("quality") == 1).alias("is_member"))


LOSS = BAG + ", " + QUALITY + """, loss AS (SELECT doc_id, round(-sum(n * lp) / sum(n), 6) AS score FROM scored GROUP BY doc_id),
sl AS (SELECT doc_id, -score AS score, is_member FROM loss JOIN lab USING (doc_id))"""


def _loss(tokens: DataFrame, spark, d: str) -> DataFrame:
    scored = join_by_frequency(tokens, unigrams(spark, d), "tok", "cnt")
    return scored.groupBy("doc_id").agg(F.round(-F.sum("lp") / F.count("*"), 6).alias("score"))


def doc_loss(spark, d: str) -> DataFrame:
    return _loss(spoken(spark, d).select("doc_id", "tok"), spark, d)


def labelled_loss(spark, d: str) -> DataFrame:
    """``doc_id, score, is_member``: the negated corpus unigram loss of the rated documents; others aren't scored."""
    rated = quality(spark, d)
    tokens = spoken(spark, d).select("doc_id", "tok").join(rated.select("doc_id"), "doc_id", "left_semi")
    return _loss(tokens, spark, d).join(rated, "doc_id").select("doc_id", (-F.col("score")).alias("score"), "is_member")


ROLL = """roll AS (SELECT request_id, batch_data_id AS uid, rollout_offset, lower(trim(data_source)) AS source, max_response_len,
  CASE WHEN isnan(reward_score) THEN 0.0 ELSE coalesce(reward_score, 0.0) END AS r,
  coalesce(list_sum(list_transform(list_filter(messages, lambda m: m.role IN ('assistant', 'gpt')), lambda m: coalesce(len(string_split(m.content, ' ')), 0))), 0)::BIGINT AS len
  FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM rollouts) WHERE rn = 1)"""


def rollouts(spark, d: str) -> DataFrame:
    """``request_id, uid, rollout_offset, source, max_response_len, r, len``: the last row of each request, its reward and answer length."""
    w = Window.partitionBy("request_id").orderBy(F.desc_nulls_last("loaded_at"))
    t = read(spark, d, "rollouts").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    said = F.filter("messages", lambda m: m["role"].isin("assistant", "gpt"))
    n = F.aggregate(said, F.lit(0).cast("long"), lambda s, m: s + F.coalesce(F.size(F.split(m["content"], " ")).cast("long"), F.lit(0)))
    return t.select(
        "request_id", F.col("batch_data_id").alias("uid"), "rollout_offset", F.lower(F.trim("data_source")).alias("source"), "max_response_len",
        F.coalesce(F.nanvl("reward_score", F.lit(0.0)), F.lit(0.0)).alias("r"), F.coalesce(n, F.lit(0)).cast("long").alias("len"),
    )


# Token rows: a sequence is an order, a group its customer, a position its line number.
TOKENS = """tk AS (SELECT o_custkey AS uid, l_orderkey AS seq, l_linenumber AS pos, -l_discount AS old_lp, -l_tax AS lp, -(l_discount + l_tax) / 2 AS ref_lp,
  (l_quantity - 25) / 10 AS adv, l_extendedprice / 100000 AS val, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS mask, l_quantity / 50 AS rew
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dup FROM lineitem) JOIN orders ON l_orderkey = o_orderkey WHERE dup = 1)"""


def token_rows(spark, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = read(spark, d, "lineitem").withColumn("dup", F.row_number().over(w)).where("dup = 1")
    return li.join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("uid"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("pos"), (-F.col("l_discount")).alias("old_lp"), (-F.col("l_tax")).alias("lp"),
        (-(F.col("l_discount") + F.col("l_tax")) / 2).alias("ref_lp"), ((F.col("l_quantity") - 25) / 10).alias("adv"), (F.col("l_extendedprice") / 100000).alias("val"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("mask"), (F.col("l_quantity") / 50).alias("rew"),
    )
