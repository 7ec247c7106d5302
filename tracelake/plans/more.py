"""Balanced batches, retrieval, backfill, permutations and other record operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import similarity as X
from tracelake.functions import text as T
from tracelake.operators.partitions import balanced
from tracelake.operators.retrieval import bm25
from tracelake.plans import base as B
from tracelake.plans.registry import query
from tracelake.session import read

HELD = f"h AS (SELECT item_id, {B.sql_tokens('reward_model.ground_truth')} AS toks, {B.sql_tokens('prompt[-1].content')} AS q FROM heldout WHERE reward_model.ground_truth IS NOT NULL)"


def _lengths(spark, d):
    return B.rollouts(spark, d).where("request_id is not null").select("request_id", "len")


@query()
def balanced_partitions(spark, d):
    return balanced(_lengths(spark, d), "request_id", "len", 128, parts=8)


@query()
def token_budget_micro_batches(spark, d):
    return balanced(_lengths(spark, d), "request_id", "len", 128, budget=1024)


@query()
def partition_imbalance(spark, d):
    """Per batch the lightest and heaviest part of both methods."""
    p = balanced(_lengths(spark, d), "request_id", "len", 128, parts=8)
    one = lambda c: p.groupBy("batch_no", c).agg(F.sum("len").alias("n")).groupBy("batch_no").agg((F.max("n") - F.min("n")).alias(f"spread_{c}"))
    return one("part").join(one("part_greedy"), "batch_no")


@query(f"""WITH {HELD}, tf AS (SELECT item_id AS doc_id, tok, count(*) AS tf FROM (SELECT item_id, unnest(toks) AS tok FROM h) GROUP BY ALL), df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok), sz AS (SELECT item_id AS doc_id, len(toks) AS dl FROM h), t AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sz),
a AS (SELECT DISTINCT item_id AS query_id, unnest(q) AS tok FROM h), s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM a JOIN df USING (tok) JOIN tf USING (tok) JOIN sz USING (doc_id), t GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM s) WHERE rn <= 5""")
def bm25_topk(spark, d):
    """The five best held-out truths for each held-out prompt: the top-k retrieval operator."""
    h = read(spark, d, "heldout").where("reward_model.ground_truth is not null")
    corpus = h.select(F.col("item_id").alias("doc_id"), T.tokens(F.col("reward_model.ground_truth")).alias("toks"))
    return bm25(corpus, h.select(F.col("item_id").alias("query_id"), T.tokens(F.element_at("prompt", -1)["content"]).alias("toks")), 5)


@query(f"WITH {B.EV}, e AS (SELECT extra_info.id AS ex_id, trim(prompt[1].content, ' ') AS p, extra_info.is_member AS m FROM ev) SELECT ex_id FROM e WHERE m AND p IS NOT NULL AND p NOT IN (SELECT p FROM e WHERE NOT m AND p IS NOT NULL)")
def members_without_shared_problem(spark, d):
    e = B.evaluations(spark, d).select(F.col("extra_info.id").alias("ex_id"), F.trim(F.try_element_at("prompt", F.lit(1))["content"]).alias("p"), F.col("extra_info.is_member").alias("m")).where("p is not null")
    return e.where("m").join(e.where("not m").select("p"), "p", "left_anti").select("ex_id")


@query(f"WITH {B.EV}, e AS (SELECT extra_info.id AS ex_id, extra_info.original_idx AS k, reward_model.ground_truth AS gt FROM ev WHERE extra_info.original_idx IS NOT NULL), g AS (SELECT k, md5(array_to_string(list_sort(list_distinct(list(gt))), chr(31))) AS target FROM e WHERE gt IS NOT NULL GROUP BY k) SELECT ex_id, target FROM e JOIN g USING (k)")
def targets_of_matching_problems(spark, d):
    """All solutions of a problem, attached to each of its rows."""
    e = B.evaluations(spark, d).select(F.col("extra_info.id").alias("ex_id"), F.col("extra_info.original_idx").alias("k"), F.col("reward_model.ground_truth").alias("gt")).where("k is not null")
    g = e.where("gt is not null").select("k", "gt").distinct().groupBy("k").agg(F.md5(F.array_join(F.array_sort(F.collect_list("gt")), "\x1f")).alias("target"))
    return e.join(g, "k").select("ex_id", "target")


@query("SELECT original_idx, coalesce(nullif(trim(text, ' '), ''), list_filter(messages, lambda m: m.role = 'assistant')[-1].content) IS NULL AS missing, count(*) AS n FROM mixed_corpus GROUP BY 1, 2")
def backfilled_texts(spark, d):
    filled = F.coalesce(F.nullif(F.trim("text"), F.lit("")), T.last_content(F.col("messages"), "assistant"))
    return read(spark, d, "mixed_corpus").groupBy("original_idx", filled.isNull().alias("missing")).agg(F.count("*").alias("n"))


@query("SELECT extra_info.is_member AS is_member, least(9, floor(extra_info.mia_weight * 10))::INT AS bin, count(*) AS n FROM heldout WHERE extra_info.mia_weight IS NOT NULL GROUP BY 1, 2")
def weight_histogram(spark, d):
    w = F.col("extra_info.mia_weight")
    return read(spark, d, "heldout").where(w.isNotNull()).groupBy(F.col("extra_info.is_member").alias("is_member"), F.least(F.lit(9), F.floor(w * 10)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT item_id, row_number() OVER (ORDER BY md5('7' || item_id::VARCHAR), item_id) - 1 AS pos, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM heldout) SELECT idx, pos FROM s")
def seeded_shuffle_and_inverse(spark, d):
    """Each row's place before and after a seeded shuffle of the fixed held-out table; the inverse is the same table read the other way."""
    all_ = Window.partitionBy(F.lit(0))
    s = read(spark, d, "heldout").select("item_id")
    return s.select((F.row_number().over(all_.orderBy("item_id")) - 1).cast("long").alias("idx"), (F.row_number().over(all_.orderBy(F.md5(F.concat(F.lit("7"), F.col("item_id").cast("string"))), "item_id")) - 1).cast("long").alias("pos"))


@query("SELECT vec_id, i::INT AS chunk, list_sum(list_slice(embedding, i * 16 + 1, i * 16 + 16)::DOUBLE[]) AS total FROM (SELECT vec_id, embedding, unnest(range(4)) AS i FROM embeddings)".replace("list_sum(", "round(list_sum(").replace("::DOUBLE[])", "::DOUBLE[]), 6)"))
def unfolded_chunks(spark, d):
    chunks = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, 16))
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode(chunks).alias("chunk", "v"))
    return e.select("vec_id", "chunk", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_max(embedding::DOUBLE[]) AS m FROM embeddings), z AS (SELECT *, list_transform(x, lambda v: exp(v - m)) AS p FROM e) SELECT vec_id, round(m + ln(list_sum(p)) - list_sum(list_transform(list_zip(p, x), lambda t: t[1] * t[2])) / list_sum(p), 5) AS entropy FROM z")
def entropy_from_logits(spark, d):
    """Entropy of the softmax of a vector of logits, shifted by its maximum."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x")).withColumn("m", F.array_max("x"))
    z = e.withColumn("p", F.transform("x", lambda v: F.exp(v - F.col("m"))))
    return z.select("vec_id", F.round(F.col("m") + F.log(total(F.col("p"))) - total(F.zip_with("p", "x", lambda p, x: p * x)) / total(F.col("p")), 5).alias("entropy"))


@query("SELECT item_id, extra_info.is_member AS is_member FROM (SELECT *, row_number() OVER (PARTITION BY extra_info.is_member ORDER BY item_id) AS rn FROM heldout) WHERE rn <= 5")
def first_n_per_class(spark, d):
    """Five examples of each class for inspection: the sampling operator."""
    w = Window.partitionBy("extra_info.is_member").orderBy("item_id")
    return read(spark, d, "heldout").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("item_id", F.col("extra_info.is_member").alias("is_member"))


@query("SELECT r.request_id, r.batch_data_id AS item_id, h.data_source FROM (SELECT DISTINCT request_id, batch_data_id FROM rollouts) r JOIN heldout h ON r.batch_data_id = h.item_id")
def rollouts_with_items(spark, d):
    r = read(spark, d, "rollouts").select("request_id", F.col("batch_data_id").alias("item_id")).distinct()
    return r.join(read(spark, d, "heldout").select("item_id", "data_source"), "item_id").select("request_id", "item_id", "data_source")


@query("SELECT state, finish_reason, count(*) AS n, round(avg(CASE WHEN isnan(reward_score) THEN 0 ELSE reward_score END), 5) AS mean FROM rollouts GROUP BY CUBE (state, finish_reason)")
def rollout_cube(spark, d):
    return read(spark, d, "rollouts").cube("state", "finish_reason").agg(F.count("*").alias("n"), F.round(F.avg(F.nanvl("reward_score", F.lit(0.0))), 5).alias("mean"))


@query()
def counting_examples(spark, d):
    """Synthetic count-the-letter prompts with a 90/10 split, from a seed."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    r = spark.range(5000).select("id", F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.substring(F.lit(letters), (F.pmod(F.xxhash64("id", i), F.lit(5)) + 1).cast("int"), F.lit(1))).alias("w"), F.substring(F.lit(letters), (F.pmod(F.xxhash64("id", F.lit("c")), F.lit(5)) + 1).cast("int"), F.lit(1)).alias("c"))
    return r.select("id", F.concat(F.lit("How many "), "c", F.lit(" are there in "), F.array_join("w", ""), F.lit("?")).alias("prompt"), F.size(F.filter("w", lambda x: x == F.col("c"))).alias("answer"), (F.pmod(F.xxhash64("id", F.lit("split")), F.lit(10)) < 9).alias("train"))


@query(f"WITH {B.TPAIRS}, m AS (SELECT ex_id, cand_idx, round({'coalesce(len(list_intersect(list_distinct(rt), list_distinct(ct)))::DOUBLE / nullif(len(list_distinct(list_concat(rt, ct))), 0), 0)'}, 6) AS jaccard FROM tp), p AS (SELECT ex_id, cand_idx, jaccard, row_number() OVER (PARTITION BY ex_id ORDER BY jaccard DESC, cand_idx) AS place FROM m) SELECT ex_id, cand_idx, jaccard, place FROM p")
def ranked_candidates(spark, d):
    m = B.token_pairs(spark, d).select("ex_id", "cand_idx", F.round(X.jaccard(F.col("rt"), F.col("ct")), 6).alias("jaccard"))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("ex_id").orderBy(F.desc("jaccard"), "cand_idx")).cast("long"))
