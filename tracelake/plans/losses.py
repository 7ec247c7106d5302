"""Further losses, returns and advantages over token rows, and summaries of batches."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.operators import advantages as A
from tracelake.operators.scaling import positions
from tracelake.plans import base as B
from tracelake.plans.registry import query

TK = f"WITH {B.TOKENS}"
MM = lambda x: f"sum(({x}) * mask) / (sum(mask) + 1e-8)"
ID = ["seq", "pos"]


def _agg(x):
    return F.round(A.masked_mean(x, F.col("mask")), 6)


CLIP_COV = TK + f""", e AS (SELECT {MM('adv')} AS ma, {MM('lp')} AS ml FROM tk), q AS (SELECT tk.*, -adv * exp(lp - old_lp) AS a, -adv * greatest(0.8, least(1.2, exp(lp - old_lp))) AS b, round((adv - ma) * (lp - ml), 9) AS cov FROM tk, e),
band AS (SELECT seq, pos, row_number() OVER (ORDER BY md5(concat('5-', seq, '-', pos)), seq, pos) AS rn FROM q WHERE mask = 1 AND NOT b > a AND cov > 0.01 AND cov < 0.05), n AS (SELECT greatest(floor(0.01 * sum(mask)), 1) AS n FROM tk),
off AS (SELECT seq, pos FROM band, n WHERE rn <= n), l AS (SELECT q.*, CASE WHEN off.seq IS NULL THEN 1 ELSE 0 END AS corr FROM q LEFT JOIN off ON q.seq = off.seq AND q.pos = off.pos)
SELECT round({MM('greatest(a, b) * corr')}, 6) AS loss, round({MM('1 - corr')}, 6) AS clip_fraction, round({MM('old_lp - lp')}, 6) AS kl FROM l"""


@query(CLIP_COV)
def clip_cov_loss(spark, d):
    """Policy loss in which a hash-drawn part of the tokens within a band of covariance counts nothing.

    Only the chosen ones' keys, a set share of the tokens, are joined back.
    """
    t = B.token_rows(spark, d)
    m = F.col("mask")
    e = t.agg(A.masked_mean(F.col("adv"), m).alias("ma"), A.masked_mean(F.col("lp"), m).alias("ml"), F.greatest(F.floor(0.01 * F.sum("mask")), F.lit(1)).alias("n"))
    ratio = F.exp(F.col("lp") - F.col("old_lp"))
    q = t.crossJoin(F.broadcast(e)).withColumns({"a": -F.col("adv") * ratio, "b": -F.col("adv") * F.greatest(F.lit(0.8), F.least(F.lit(1.2), ratio)), "cov": F.round((F.col("adv") - F.col("ma")) * (F.col("lp") - F.col("ml")), 9)})
    band = q.where("mask = 1 and not b > a and cov > 0.01 and cov < 0.05").select(*ID, "n", F.md5(F.concat_ws("-", F.lit("5"), "seq", "pos")).alias("h"))
    off = positions(band, [F.asc("h"), F.asc("seq"), F.asc("pos")], "rank").where("rank < n").select(*ID, F.lit(0).alias("corr"))
    # a token row twice under one key would be joined twice: keys are unique here
    loss = q.join(off, ID, "left").withColumn("corr", F.coalesce("corr", F.lit(1)))
    return loss.agg(_agg(F.greatest("a", "b") * F.col("corr")).alias("loss"), _agg(1 - F.col("corr")).alias("clip_fraction"), _agg(F.col("old_lp") - F.col("lp")).alias("kl"))


@query(TK + """, s AS (SELECT uid, seq, sum(rew * mask) / sum(mask) AS m FROM tk GROUP BY uid, seq HAVING sum(mask) > 0), g AS (SELECT uid, count(*) AS n, sum(m) AS total FROM s GROUP BY uid HAVING count(*) > 1),
x AS (SELECT tk.seq, pos, (rew * n / (n - 1) - total / (n - 1)) * mask AS r FROM tk JOIN g ON tk.uid = g.uid) SELECT seq, pos, round(sum(r) OVER (PARTITION BY seq ORDER BY pos DESC), 8) AS ret FROM x""")
def dense_rloo_returns(spark, d):
    """Leave-one-out over the sequences of a group on rewards of every token, then returns to go."""
    t = B.token_rows(spark, d)
    s = t.groupBy("uid", "seq").agg((F.sum(F.col("rew") * F.col("mask")) / F.nullif(F.sum("mask"), F.lit(0))).alias("m")).where("m is not null")
    g = s.groupBy("uid").agg(F.count("*").alias("n"), F.sum("m").alias("total")).where("n > 1")
    x = t.join(g, "uid").withColumn("rew", F.col("rew") * F.col("n") / (F.col("n") - 1) - F.col("total") / (F.col("n") - 1))
    return A.returns_to_go(x).select(*ID, F.round("ret", 8).alias("ret"))


PRM = TK + """, s AS (SELECT uid, seq, round(sum(rew * mask), 6) AS q, (sum(rew) > 2.0)::INT AS acc FROM (SELECT uid, seq, rew, mask FROM tk) GROUP BY uid, seq), s2 AS (SELECT uid, seq, q, (round(x, 6) > 2.0)::INT AS acc FROM (SELECT uid, seq, round(sum(rew * mask), 6) AS q, sum(rew) AS x FROM tk GROUP BY uid, seq)),
c AS (SELECT uid, count(*) AS n, sum(acc) AS n1, sum(q * acc) AS q1, sum(q * (1 - acc)) AS q0 FROM s2 GROUP BY uid)
SELECT seq, round(-ln(CASE WHEN acc = 1 THEN 1 / (1 + exp(-0.05 * q)) ELSE 1 - 1 / (1 + exp(-0.05 * q)) END), 6) AS ce,
round(-ln(1 / (1 + exp(-(0.05 * q - CASE WHEN acc = 1 THEN CASE WHEN n - n1 > 0 THEN 0.05 * q0 / (n - n1) ELSE 0 END ELSE CASE WHEN n1 > 0 THEN 0.05 * q1 / n1 ELSE 0 END END) * (2 * acc - 1)))), 6) AS dpo,
round(n * pow(CASE WHEN acc = 1 THEN 1.0 ELSE (n - n1)::DOUBLE / n END, n - 1), 6) AS weight FROM s2 JOIN c USING (uid)"""


@query(PRM)
def process_reward_losses(spark, d):
    """Per sequence: cross-entropy of its score against its outcome, the loss against the mean of the other outcome, and its best-of-n weight."""
    s = B.token_rows(spark, d).groupBy("uid", "seq").agg(F.round(F.sum(F.col("rew") * F.col("mask")), 6).alias("q"), (F.round(F.sum("rew"), 6) > 2.0).cast("int").alias("acc"))
    c = s.groupBy("uid").agg(F.count("*").alias("n"), F.sum("acc").alias("n1"), F.sum(F.col("q") * F.col("acc")).alias("q1"), F.sum(F.col("q") * (1 - F.col("acc"))).alias("q0"))
    x = s.join(c, "uid")
    sig = lambda v: 1 / (1 + F.exp(-v))
    q, n0 = 0.05 * F.col("q"), F.col("n") - F.col("n1")
    other = F.when(F.col("acc") == 1, F.coalesce(F.try_divide(0.05 * F.col("q0"), n0.cast("double")), F.lit(0.0))).otherwise(F.coalesce(F.try_divide(0.05 * F.col("q1"), F.col("n1").cast("double")), F.lit(0.0)))
    ce = -F.log(F.when(F.col("acc") == 1, sig(q)).otherwise(1 - sig(q)))
    share = F.when(F.col("acc") == 1, 1.0).otherwise(n0 / F.col("n"))
    return x.select("seq", F.round(ce, 6).alias("ce"), F.round(-F.log(sig((q - other) * (2 * F.col("acc") - 1))), 6).alias("dpo"), F.round(F.col("n") * F.pow(share, F.col("n") - 1), 6).alias("weight"))


@query(TK + ", s AS (SELECT seq, sum((lp - old_lp) * mask) AS lr, max(rew) AS r, max(mask) AS m FROM tk GROUP BY seq) SELECT round(sum(pow(lr - 1.5 * r, 2) * m) / (sum(m) + 1e-8), 6) AS loss, round(avg(lr), 6) AS log_ratio, sum(m)::BIGINT AS n FROM s")
def sppo_loss(spark, d):
    """Squared distance of a sequence's log-ratio to its scaled reward, over sequences with any valid token."""
    s = B.token_rows(spark, d).groupBy("seq").agg(F.sum((F.col("lp") - F.col("old_lp")) * F.col("mask")).alias("lr"), F.max("rew").alias("r"), F.max("mask").alias("mask"))
    off = F.col("lr") - 1.5 * F.col("r")
    return s.agg(_agg(off * off).alias("loss"), F.round(F.avg("lr"), 6).alias("log_ratio"), F.sum("mask").alias("n"))


RESET = TK + f""", g AS (SELECT *, sum(1 - mask) OVER (PARTITION BY seq ORDER BY pos) AS part FROM tk), r AS (SELECT seq, pos, mask, sum(rew * pow(0.9, pos)) OVER (PARTITION BY seq, part ORDER BY pos DESC) / pow(0.9, pos) AS x FROM g),
e AS (SELECT {MM('x')} AS mu, ({MM('x * x')} - pow({MM('x')}, 2)) * sum(mask) / (sum(mask) - 1) AS va FROM r) SELECT seq, pos, round(x, 8) AS ret, round((x - mu) / sqrt(va + 1e-8) * mask, 4) AS advantage FROM r, e"""


@query(RESET)
def reset_returns(spark, d):
    """Discounted returns that start anew at masked tokens, and their whitened advantage."""
    part = F.sum(1 - F.col("mask")).over(Window.partitionBy("seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    w = Window.partitionBy("seq", "part").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    power = F.pow(F.lit(0.9), F.col("pos"))
    r = B.token_rows(spark, d).withColumn("part", part).withColumn("ret", F.sum(F.col("rew") * power).over(w) / power)
    return A.whitened(r, "ret").select(*ID, F.round("ret", 8).alias("ret"), F.round(F.col("white") * F.col("mask"), 4).alias("advantage"))


@query(TK + ", b AS (SELECT seq, round(avg(val), 4) AS base FROM tk GROUP BY seq) SELECT seq, pos, round(sum(rew * mask) OVER (PARTITION BY seq ORDER BY pos DESC) - base * mask, 6) AS advantage FROM tk JOIN b USING (seq)")
def remax_advantage(spark, d):
    """Returns to go minus the sequence's baseline."""
    t = B.token_rows(spark, d)
    r = A.returns_to_go(t).join(t.groupBy("seq").agg(F.round(F.avg("val"), 4).alias("base")), "seq")
    return r.select(*ID, F.round(F.col("ret") - F.col("base") * F.col("mask"), 6).alias("advantage"))


GAE_SQL = """, s AS (SELECT a.seq, a.pos, a.mask, b.rew + 0.99 * coalesce(lead(b.val) OVER (PARTITION BY a.seq, a.pos ORDER BY b.pos), 0) - b.val AS delta, row_number() OVER (PARTITION BY a.seq, a.pos ORDER BY b.pos) - 1 AS k FROM tk a JOIN tk b ON a.seq = b.seq AND b.pos >= a.pos),
g AS (SELECT seq, pos, max(mask) AS mask, sum(delta * pow(0.99 * 0.95, k)) AS x FROM s GROUP BY seq, pos)"""


@query(TK + GAE_SQL + f", e AS (SELECT {MM('x')} AS mu, ({MM('x * x')} - pow({MM('x')}, 2)) * sum(mask) / (sum(mask) - 1) AS va FROM g) SELECT seq, pos, round((x - mu) / sqrt(va + 1e-8), 4) AS advantage FROM g, e")
def gae_whitened(spark, d):
    t = B.token_rows(spark, d)
    g = A.gae(t, 0.99, 0.95).join(t.select(*ID, "mask"), ID)
    return A.whitened(g, "advantage").select(*ID, F.round("white", 4).alias("advantage"))


@query(f"""WITH {B.ROLL}, r AS (SELECT request_id, r FROM roll WHERE request_id IS NOT NULL), e AS (SELECT max(r) AS hi, min(r) AS lo FROM r)
SELECT request_id, CASE WHEN r = hi OR r = lo THEN 1.0 ELSE 0.0 END + 1e-8 AS max_min, CASE WHEN r = hi THEN 0.4 ELSE 0.1 END + 1e-8 AS max_random FROM r, e""")
def resampling_weights_by_extremes(spark, d):
    """Weights that keep the best and worst only, or prefer the best."""
    r = B.rollouts(spark, d).where("request_id is not null").select("request_id", "r")
    e = r.agg(F.max("r").alias("hi"), F.min("r").alias("lo"))
    ends = (F.col("r") == F.col("hi")) | (F.col("r") == F.col("lo"))
    return r.crossJoin(F.broadcast(e)).select("request_id", (F.when(ends, 1.0).otherwise(0.0) + 1e-8).alias("max_min"), (F.when(F.col("r") == F.col("hi"), 0.4).otherwise(0.1) + 1e-8).alias("max_random"))


@query(TK + ", v AS (SELECT *, rew - val AS d FROM tk WHERE mask = 1) SELECT round(avg(adv), 6) AS adv_mean, max(adv) AS adv_max, min(adv) AS adv_min, round(avg(val), 6) AS val_mean, max(val) AS val_max, min(val) AS val_min, round(avg(rew), 6) AS ret_mean, max(rew) AS ret_max, min(rew) AS ret_min, round(1 - var_samp(d) / (var_samp(rew) + 1e-5), 5) AS explained FROM v")
def token_batch_metrics(spark, d):
    """Advantages, values and returns of the valid tokens, and how much of the returns' variance the values explain."""
    t = B.token_rows(spark, d).where("mask = 1")
    three = lambda c, n: [F.round(F.avg(c), 6).alias(f"{n}_mean"), F.max(c).alias(f"{n}_max"), F.min(c).alias(f"{n}_min")]
    return t.agg(*three("adv", "adv"), *three("val", "val"), *three("rew", "ret"), F.round(1 - F.var_samp(F.col("rew") - F.col("val")) / (F.var_samp("rew") + 1e-5), 5).alias("explained"))


@query(TK + ", v AS (SELECT abs(exp(old_lp) - exp(lp)) AS x FROM tk WHERE mask = 1) SELECT round(max(x), 6) AS hi, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM v")
def probability_difference(spark, d):
    """How far two policies' token probabilities lie apart."""
    x = F.abs(F.exp("old_lp") - F.exp("lp"))
    return B.token_rows(spark, d).where("mask = 1").agg(F.round(F.max(x), 6).alias("hi"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"))


@query(TK + ", s AS (SELECT seq, count(*) AS n, round(sum(rew * mask), 6) AS r, sum(lp * mask) AS lp, sum(ref_lp * mask) AS ref FROM tk GROUP BY seq) SELECT count(*) AS n, round(avg(r), 5) AS reward, max(r) AS reward_max, min(r) AS reward_min, round(avg(n), 5) AS length, round(avg(lp), 5) AS log_prob, round(avg(lp - ref), 5) AS margin FROM s")
def preference_batch_summary(spark, d):
    s = B.token_rows(spark, d).groupBy("seq").agg(F.count("*").alias("n"), F.round(F.sum(F.col("rew") * F.col("mask")), 6).alias("r"), F.sum(F.col("lp") * F.col("mask")).alias("lp"), F.sum(F.col("ref_lp") * F.col("mask")).alias("ref"))
    return s.agg(F.count("*").alias("n"), F.round(F.avg("r"), 5).alias("reward"), F.max("r").alias("reward_max"), F.min("r").alias("reward_min"), F.round(F.avg("n"), 5).alias("length"), F.round(F.avg("lp"), 5).alias("log_prob"), F.round(F.avg(F.col("lp") - F.col("ref")), 5).alias("margin"))


@query("""WITH r AS (SELECT lower(trim(data_source)) AS source, epoch(loaded_at) - epoch(created_at) AS secs, coalesce(list_sum(list_transform(messages, lambda m: coalesce(len(string_split(m.content, ' ')), 0))), 0)::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM rollouts) WHERE rn = 1 AND loaded_at > created_at)
SELECT source, sum(n)::BIGINT AS n_tokens, round(sum(secs), 3) AS secs, round(1000 * sum(secs) / nullif(sum(n), 0), 5) AS ms_per_token, round(sum(n) / sum(secs), 9) AS throughput FROM r GROUP BY source""")
def throughput(spark, d):
    """Time per token and tokens per second of each source."""
    from tracelake.session import read

    w = Window.partitionBy("request_id").orderBy(F.desc_nulls_last("loaded_at"))
    t = read(spark, d, "rollouts").withColumn("rn", F.row_number().over(w)).where("rn = 1 and loaded_at > created_at")
    n = F.aggregate("messages", F.lit(0).cast("long"), lambda s, m: s + F.greatest(F.lit(0), F.coalesce(F.size(F.split(m["content"], " ")), F.lit(0))).cast("long"))
    secs = F.unix_micros(F.col("loaded_at").cast("timestamp")) / 1e6 - F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6
    t = t.select(F.lower(F.trim("data_source")).alias("source"), F.coalesce(n, F.lit(0)).alias("n"), secs.alias("secs"))
    total = F.sum("n").cast("double")
    return t.groupBy("source").agg(F.sum("n").alias("n_tokens"), F.round(F.sum("secs"), 3).alias("secs"), F.round(F.try_divide(1000 * F.sum("secs"), F.nullif(total, F.lit(0.0))), 5).alias("ms_per_token"), F.round(total / F.sum("secs"), 9).alias("throughput"))


@query(TK + ", n AS (SELECT seq, count(*) AS n FROM tk GROUP BY seq) SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS idx, (row_number() OVER (PARTITION BY seq ORDER BY pos) > 1 AND row_number() OVER (PARTITION BY seq ORDER BY pos) < n)::INT AS loss_mask FROM tk JOIN n USING (seq)")
def sft_loss_mask(spark, d):
    """A prompt of two tokens in front: what predicts the prompt's own tokens counts nothing, nor does the last token."""
    at = F.row_number().over(Window.partitionBy("seq").orderBy("pos")) - 1
    n = F.count("*").over(Window.partitionBy("seq"))
    prompt = 2
    return B.token_rows(spark, d).select("seq", at.cast("long").alias("idx"), ((at >= prompt - 1) & (at < n - 1)).cast("int").alias("loss_mask"))
