"""Grouped and windowed numerics over requests and token rows, and aggregates over the star schema and events."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.operators import advantages as A
from tracelake.operators.scaling import positions
from tracelake.plans import base as B
from tracelake.plans.registry import query
from tracelake.session import read

R = "request_id"


def _adv(df):
    return df.select(R, F.round("advantage", 5).alias("advantage"))


def _roll(spark, d):
    return B.rollouts(spark, d).where("uid is not null and request_id is not null")


ROLL = B.ROLL + ", ro AS (SELECT * FROM roll WHERE uid IS NOT NULL AND request_id IS NOT NULL)"
GRP = f"WITH {ROLL}, g AS (SELECT *, count(*) OVER w AS n, avg(r) OVER w AS m, stddev_samp(r) OVER w AS s, max(r) OVER w AS mx, sum(len * r) OVER w AS lr, sum(len) OVER w AS l FROM ro WINDOW w AS (PARTITION BY uid))"


@query(GRP + " SELECT request_id, round((r - CASE WHEN n > 1 THEN m ELSE 0 END) / (CASE WHEN n > 1 THEN s ELSE 1 END + 1e-6), 5) AS advantage FROM g")
def grpo_advantage(spark, d):
    return _adv(A.group_normalised(_roll(spark, d)))


@query(GRP + " SELECT request_id, round(r - CASE WHEN n > 1 THEN m ELSE 0 END, 9) AS advantage FROM g")
def grpo_advantage_no_std(spark, d):
    return A.group_normalised(_roll(spark, d), by_std=False).select(R, F.round("advantage", 9).alias("advantage"))


@query(GRP + " SELECT request_id, round(CASE WHEN n > 1 THEN r * n / (n - 1) - m * n / (n - 1) ELSE r END, 9) AS advantage FROM g")
def rloo_advantage(spark, d):
    return A.leave_one_out(_roll(spark, d)).select(R, F.round("advantage", 9).alias("advantage"))


@query(GRP + " SELECT request_id, round(r - coalesce(lr / nullif(l, 0), 0), 5) AS advantage FROM g")
def opo_advantage(spark, d):
    return _adv(A.length_weighted(_roll(spark, d)))


@query(GRP + ", k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY r DESC, request_id) AS rn, lead(r) OVER (PARTITION BY uid ORDER BY r DESC, request_id) AS nx FROM g) SELECT request_id, round(CASE WHEN rn = 1 AND n > 1 THEN r - nx ELSE 0 END, 5) AS advantage FROM k")
def passk_advantage(spark, d):
    return _adv(A.best_over_second(_roll(spark, d), R))


@query(GRP + ", c AS (SELECT request_id, r - CASE WHEN n > 1 THEN m ELSE 0 END AS x FROM g), t AS (SELECT avg(x) AS m, var_samp(x) AS v FROM c) SELECT request_id, round((x - m) / sqrt(v + 1e-8), 5) AS advantage FROM c, t")
def reinforce_baseline_advantage(spark, d):
    c = A.group_normalised(_roll(spark, d), by_std=False).withColumnRenamed("advantage", "x")
    t = c.agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    return c.crossJoin(F.broadcast(t)).select(R, F.round((F.col("x") - F.col("m")) / F.sqrt(F.col("v") + 1e-8), 5).alias("advantage"))


@query(GRP + ", e AS (SELECT *, avg(exp(2.0 * (r - mx))) OVER (PARTITION BY uid) AS em FROM g) SELECT request_id, round(ln(em) / 2.0 + mx, 5) AS baseline FROM e")
def softmean_baseline(spark, d):
    return A.softmean_baseline(_roll(spark, d), 2.0).select(R, F.round("baseline", 5).alias("baseline"))


@query(GRP + " SELECT uid, n, round(stddev_pop(r), 6) AS std, stddev_pop(r) > 0 OR n = 1 AS kept FROM g GROUP BY uid, n")
def zero_variance_group_filter(spark, d):
    g = _roll(spark, d).groupBy("uid").agg(F.count("*").alias("n"), F.stddev_pop("r").alias("s"))
    return g.select("uid", "n", F.round("s", 6).alias("std"), ((F.col("s") > 0) | (F.col("n") == 1)).alias("kept"))


@query(GRP + ", b AS (SELECT uid, m BETWEEN 0.2 AND 0.8 AS passed FROM g GROUP BY uid, m), o AS (SELECT *, row_number() OVER (ORDER BY passed DESC, uid) AS rn, count(*) OVER () AS n FROM b) SELECT uid, passed FROM o WHERE rn <= n // 2")
def group_filter_and_downsample(spark, d):
    """Groups whose mean is within the band first, cut to half their number: the down-sampling operator; one row per item."""
    g = _roll(spark, d).groupBy("uid").agg(F.avg("r").between(0.2, 0.8).alias("passed"))
    ranked = positions(g, [F.desc("passed"), F.asc("uid")], "rank")
    return ranked.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("n")))).where("rank < n div 2").select("uid", "passed")


@query(GRP + ", p AS (SELECT a.uid, CASE WHEN a.r > b.r THEN 1.0 WHEN a.r = b.r THEN 0.5 ELSE 0 END AS win FROM ro a JOIN ro b ON a.uid = b.uid AND a.rollout_offset < b.rollout_offset) SELECT uid, count(*) AS n, round(avg(win), 5) AS acc FROM p GROUP BY uid")
def pairwise_rank_accuracy(spark, d):
    """Share of pairs of a group in which the earlier rollout wins, ties half, without forming the pairs.

    Each row goes once to every other offset of its group (a batch has a fixed number of offsets); in each
    pair of offsets the wins follow from running counts over the rewards.
    """
    per = _roll(spark, d).where("rollout_offset is not null").groupBy("uid", F.col("rollout_offset").alias("o"), "r").agg(F.count("*").alias("c"))
    other = per.select("uid", F.col("o").alias("o2")).distinct()
    side = per.join(other, "uid").where("o <> o2").select("uid", F.least("o", "o2").alias("a"), F.greatest("o", "o2").alias("b"), "r", F.when(F.col("o") < F.col("o2"), F.col("c")).otherwise(0).alias("c1"), F.when(F.col("o") > F.col("o2"), F.col("c")).otherwise(0).alias("c2"))
    at = side.groupBy("uid", "a", "b", "r").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    below = F.coalesce(F.sum("c2").over(Window.partitionBy("uid", "a", "b").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pair = at.withColumn("below", below).groupBy("uid", "a", "b").agg((F.sum("c1") * F.sum("c2")).alias("n"), F.sum(F.col("c1") * (F.col("below") + 0.5 * F.col("c2"))).alias("wins"))
    return pair.groupBy("uid").agg(F.sum("n").alias("n"), F.round(F.sum("wins") / F.sum("n"), 5).alias("acc"))


@query(GRP + " SELECT request_id, round(least(0, -(len - (max_response_len - 16)) / 16.0 * 1.0), 5) AS penalty FROM g WHERE max_response_len IS NOT NULL")
def overlong_penalty(spark, d):
    p = -(F.col("len") - (F.col("max_response_len") - 16)) / 16.0
    return _roll(spark, d).where("max_response_len is not null").select(R, F.round(F.least(F.lit(0.0), p), 5).alias("penalty"))


@query(GRP + " SELECT request_id, len - 1 AS pos, round(r, 6) AS reward FROM g WHERE len > 0")
def reward_on_last_token(spark, d):
    return _roll(spark, d).where("len > 0").select(R, (F.col("len") - 1).alias("pos"), F.round("r", 6).alias("reward"))


@query(GRP + " SELECT source, count(*) AS n, round(avg(r), 5) AS mean, max(r) AS hi, min(r) AS lo, round(avg(len), 5) AS mean_len, round(avg((len >= max_response_len)::INT), 5) AS clip_ratio FROM g GROUP BY source")
def batch_data_metrics(spark, d):
    return _roll(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("r"), 5).alias("mean"), F.max("r").alias("hi"), F.min("r").alias("lo"), F.round(F.avg("len"), 5).alias("mean_len"), F.round(F.avg((F.col("len") >= F.col("max_response_len")).cast("int")), 5).alias("clip_ratio"))


@query(GRP + ", k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY r DESC, request_id) AS hi, row_number() OVER (PARTITION BY uid ORDER BY r, request_id) AS lo FROM g) SELECT uid, max(CASE WHEN hi = 1 THEN request_id END) AS chosen, max(CASE WHEN lo = 1 THEN request_id END) AS rejected FROM k WHERE n > 1 GROUP BY uid")
def preference_pairs(spark, d):
    """Best and worst request of a group, the first of equals."""
    g = _roll(spark, d).groupBy("uid").agg(F.min_by(R, F.struct(-F.col("r"), R)).alias("chosen"), F.min_by(R, F.struct("r", R)).alias("rejected"), F.count("*").alias("n"))
    return g.where("n > 1").drop("n")


@query(GRP + ", w AS (SELECT request_id, pow(r, 2) AS p FROM g), t AS (SELECT sum(p) AS s FROM w) SELECT request_id, round(p / s, 9) AS weight FROM w, t")
def resampling_weights(spark, d):
    w = _roll(spark, d).select(R, F.pow("r", F.lit(2)).alias("p"))
    return w.crossJoin(F.broadcast(w.agg(F.sum("p").alias("s")))).select(R, F.round(F.col("p") / F.col("s"), 9).alias("weight"))


TK = f"WITH {B.TOKENS}"


@query(TK + " SELECT seq, pos, round(sum(rew * mask) OVER (PARTITION BY seq ORDER BY pos DESC), 5) AS ret FROM tk")
def remax_returns(spark, d):
    return A.returns_to_go(B.token_rows(spark, d)).select("seq", "pos", F.round("ret", 5).alias("ret"))


@query(TK + " SELECT seq, pos, round(sum(rew * mask * pow(0.9, pos)) OVER (PARTITION BY seq ORDER BY pos DESC) / pow(0.9, pos), 5) AS ret FROM tk")
def discounted_returns(spark, d):
    return A.returns_to_go(B.token_rows(spark, d), 0.9).select("seq", "pos", F.round("ret", 5).alias("ret"))


@query(TK + """, s AS (SELECT a.seq, a.pos, a.val, b.pos AS p2, b.rew + 0.99 * coalesce(lead(b.val) OVER (PARTITION BY a.seq, a.pos ORDER BY b.pos), 0) - b.val AS delta, row_number() OVER (PARTITION BY a.seq, a.pos ORDER BY b.pos) - 1 AS k FROM tk a JOIN tk b ON a.seq = b.seq AND b.pos >= a.pos)
SELECT seq, pos, round(sum(delta * pow(0.99 * 0.95, k)), 8) AS advantage FROM s GROUP BY seq, pos""")
def gae_advantage(spark, d):
    return A.gae(B.token_rows(spark, d), 0.99, 0.95).select("seq", "pos", F.round("advantage", 8).alias("advantage"))


MM = "sum(x * m) / (sum(m) + 1e-8)"


@query(TK + f", v AS (SELECT adv AS x, mask AS m FROM tk) SELECT round(sum(x * m), 4) AS total, round({MM}, 6) AS mean, round(sum(x * x * m) / (sum(m) + 1e-8) - pow({MM}, 2), 6) AS var, sum(m)::BIGINT AS n FROM v")
def masked_statistics(spark, d):
    t = B.token_rows(spark, d)
    x, m = F.col("adv"), F.col("mask")
    mean = A.masked_mean(x, m)
    return t.agg(F.round(F.sum(x * m), 4).alias("total"), F.round(mean, 6).alias("mean"), F.round(A.masked_mean(x * x, m) - mean * mean, 6).alias("var"), F.sum(m).alias("n"))


@query(TK + f", v AS (SELECT adv AS x, mask AS m FROM tk), e AS (SELECT {MM} AS mu, (sum(x * x * m) / (sum(m) + 1e-8) - pow({MM}, 2)) * sum(m) / (sum(m) - 1) AS va FROM v) SELECT seq, pos, round((adv - mu) / sqrt(va + 1e-8), 4) AS white FROM tk, e")
def masked_whiten(spark, d):
    return A.whitened(B.token_rows(spark, d), "adv").select("seq", "pos", F.round("white", 4).alias("white"))


@query(TK + ", k AS (SELECT *, greatest(-20, least(20, ref_lp - lp)) AS q FROM tk) SELECT seq, pos, round(lp - ref_lp, 6) AS k1, round(abs(lp - ref_lp), 6) AS abs, round(0.5 * pow(lp - ref_lp, 2), 6) AS k2, round(greatest(-10, least(10, exp(q) - q - 1)), 6) AS k3 FROM k")
def kl_estimators(spark, d):
    return B.token_rows(spark, d).select("seq", "pos", *[F.round(A.kl_estimate(F.col("lp"), F.col("ref_lp"), k), 6).alias(k) for k in ("k1", "abs", "k2", "k3")])


@query(TK + ", s AS (SELECT seq, sum((lp - ref_lp) * mask) / nullif(sum(mask), 0) AS k FROM tk GROUP BY seq) SELECT seq, round(k, 6) AS mean_kl FROM s WHERE k IS NOT NULL")
def sequence_kl(spark, d):
    m = F.col("mask")
    g = B.token_rows(spark, d).groupBy("seq").agg(F.try_divide(F.sum((F.col("lp") - F.col("ref_lp")) * m), F.nullif(F.sum(m), F.lit(0))).alias("k"))
    return g.where("k is not null").select("seq", F.round("k", 6).alias("mean_kl"))


@query(TK + " SELECT seq, pos, round(rew - CASE WHEN mask = 1 THEN 0.1 * (old_lp - ref_lp) ELSE 0 END, 6) AS reward FROM tk")
def kl_penalised_rewards(spark, d):
    return B.token_rows(spark, d).select("seq", "pos", F.round(F.col("rew") - F.when(F.col("mask") == 1, 0.1 * (F.col("old_lp") - F.col("ref_lp"))).otherwise(0.0), 6).alias("reward"))


AGG = TK + """, s AS (SELECT seq, sum(adv * mask) AS t, sum(mask) AS n FROM tk GROUP BY seq), x AS (SELECT sum(t) AS a, sum(n) AS b, avg(t) AS c, avg(t / nullif(n, 0)) AS e FROM s)
SELECT round(a / (b + 1e-8), 6) AS token_mean, round(c, 5) AS seq_mean_token_sum, round(e, 6) AS seq_mean_token_mean, round(a / 7, 3) AS seq_mean_token_sum_norm FROM x"""


@query(AGG)
def loss_agg_modes(spark, d):
    """Four ways to bring a loss matrix to one number; sequences without unmasked tokens have no token mean."""
    s = B.token_rows(spark, d).groupBy("seq").agg(F.sum(F.col("adv") * F.col("mask")).alias("t"), F.sum("mask").alias("n"))
    x = s.agg(F.sum("t").alias("a"), F.sum("n").alias("b"), F.avg("t").alias("c"), F.avg(F.try_divide("t", F.nullif("n", F.lit(0)))).alias("e"))
    return x.select(F.round(F.col("a") / (F.col("b") + 1e-8), 6).alias("token_mean"), F.round("c", 5).alias("seq_mean_token_sum"), F.round("e", 6).alias("seq_mean_token_mean"), F.round(F.col("a") / 7, 3).alias("seq_mean_token_sum_norm"))


PL = TK + """, q AS (SELECT *, exp(greatest(-20, least(20, lp - old_lp))) AS ratio FROM tk), c AS (SELECT *, -adv * ratio AS a, -adv * greatest(0.8, least(1.2, ratio)) AS b FROM q), l AS (SELECT *, greatest(a, b) AS g FROM c)
SELECT round(sum(CASE WHEN adv < 0 THEN least(-adv * 3.0, g) ELSE g END * mask) / (sum(mask) + 1e-8), 6) AS loss, round(sum((b > a)::INT * mask) / (sum(mask) + 1e-8), 6) AS clip_fraction, round(sum((g > -adv * 3.0 AND adv < 0)::INT * mask) / (sum(mask) + 1e-8), 6) AS lower_clip_fraction, round(sum((old_lp - lp) * mask) / (sum(mask) + 1e-8), 6) AS kl FROM l"""


@query(PL)
def policy_loss(spark, d):
    loss, up, low = A.policy_loss(F.col("old_lp"), F.col("lp"), F.col("adv"))
    m = F.col("mask")
    mm = lambda x: F.round(A.masked_mean(x, m), 6)
    return B.token_rows(spark, d).agg(mm(loss).alias("loss"), mm(up).alias("clip_fraction"), mm(low).alias("lower_clip_fraction"), mm(F.col("old_lp") - F.col("lp")).alias("kl"))


@query(TK + ", c AS (SELECT *, greatest(adv - 0.2, least(adv + 0.2, val)) AS v FROM tk), l AS (SELECT *, pow(val - rew, 2) AS a, pow(v - rew, 2) AS b FROM c) SELECT round(sum(0.5 * greatest(a, b) * mask) / (sum(mask) + 1e-8), 6) AS loss, round(sum((b > a)::INT * mask) / (sum(mask) + 1e-8), 6) AS clip_fraction FROM l")
def value_loss(spark, d):
    loss, clip = A.value_loss(F.col("val"), F.col("adv"), F.col("rew"), 0.2)
    m = F.col("mask")
    return B.token_rows(spark, d).agg(F.round(A.masked_mean(loss, m), 6).alias("loss"), F.round(A.masked_mean(clip, m), 6).alias("clip_fraction"))


@query(TK + ", e AS (SELECT avg(adv) AS ma, avg(lp) AS ml, count(*) AS n FROM tk WHERE mask = 1), c AS (SELECT seq, pos, round((adv - ma) * (lp - ml), 9) AS cov, n FROM tk, e WHERE mask = 1) SELECT seq, pos, cov FROM (SELECT *, row_number() OVER (ORDER BY cov DESC, seq, pos) AS rn FROM c) WHERE rn <= greatest(1, floor(n * 0.002))")
def kl_cov_tokens(spark, d):
    """The tokens of highest covariance, 0.2 % of all: a top-k report."""
    t = B.token_rows(spark, d).where("mask = 1")
    e = t.agg(F.avg("adv").alias("ma"), F.avg("lp").alias("ml"), F.count("*").alias("n")).first()
    c = t.select("seq", "pos", F.round((F.col("adv") - F.lit(e["ma"] or 0.0)) * (F.col("lp") - F.lit(e["ml"] or 0.0)), 9).alias("cov"))
    n = max(1, int(e["n"] * 0.002))
    # what lies clearly below the n-th goes before anything is put in order
    floor = c.agg(F.percentile_approx("cov", 1 - min(1.0, 2 * n / max(e["n"], 1)), 10_000)).first()[0]
    top = c.where(F.col("cov") >= F.lit(floor)) if floor is not None else c
    return positions(top, [F.desc("cov"), F.asc("seq"), F.asc("pos")], "rank").where(F.col("rank") < n).select("seq", "pos", "cov")


@query("SELECT item_id, round(extra_info.mia_weight, 6) AS linear, round(pow(extra_info.mia_weight, 2), 6) AS quadratic, round(exp(extra_info.mia_weight - 1), 6) AS exponential, round(1 - extra_info.mia_weight, 6) AS inverted, round(coalesce(extra_info.mia_weight, avg(extra_info.mia_weight) OVER ()), 5) AS filled FROM heldout")
def weight_transforms(spark, d):
    h = read(spark, d, "heldout").select("item_id", F.col("extra_info.mia_weight").alias("w"))
    w = F.col("w")
    return h.crossJoin(F.broadcast(h.agg(F.avg("w").alias("m")))).select("item_id", F.round(w, 6).alias("linear"), F.round(w * w, 6).alias("quadratic"), F.round(F.exp(w - 1), 6).alias("exponential"), F.round(1 - w, 6).alias("inverted"), F.round(F.coalesce("w", "m"), 5).alias("filled"))


@query(TK + " SELECT seq, pos, sum((old_lp = 0)::INT) OVER (PARTITION BY seq ORDER BY pos) - (old_lp = 0)::INT = 0 AS kept FROM tk")
def response_mask_to_eos(spark, d):
    """Tokens up to the first end mark, that included."""
    eos = (F.col("old_lp") == 0).cast("int")
    return B.token_rows(spark, d).select("seq", "pos", (F.sum(eos).over(Window.partitionBy("seq").orderBy("pos")) - eos == 0).alias("kept"))


@query(TK + ", p AS (SELECT seq, list(round(rew, 4) ORDER BY pos) AS x FROM tk GROUP BY seq) SELECT seq, array_to_string(list_concat(list_slice(x, 1, 5), list_transform(range(greatest(0, 5 - len(x))), lambda i: 0.0)), ',') AS padded FROM p".replace("array_to_string(", "list_sum(").replace(", ',') AS padded", ") AS total, least(len(x), 5)::INT AS n_real"))
def padded_sequences(spark, d):
    """Sequences cut or padded to five tokens."""
    x = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.round("rew", 4).alias("rew")))), lambda s: s["rew"])
    p = B.token_rows(spark, d).groupBy("seq").agg(x.alias("x"))
    pad = F.concat(F.slice("x", 1, 5), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), 5 - F.size("x"))))
    return p.select("seq", F.aggregate(pad, F.lit(0.0), lambda s, v: s + v).alias("total"), F.least(F.size("x"), F.lit(5)).alias("n_real"))


@query(TK + ", s AS (SELECT uid, seq, round(sum((lp - ref_lp) * mask), 6) AS a, round(sum(rew * mask), 6) AS r FROM tk GROUP BY uid, seq), p AS (SELECT uid, arg_max(a, [r, -seq]) AS c, arg_min(a, [r, seq]) AS j, count(*) AS n FROM s GROUP BY uid) SELECT uid, round(ln(1 + exp(-0.1 * (c - j))), 6) AS dpo, round(pow(c - j - 5.0, 2), 4) AS ipo FROM p WHERE n > 1")
def preference_losses(spark, d):
    s = B.token_rows(spark, d).groupBy("uid", "seq").agg(F.round(F.sum((F.col("lp") - F.col("ref_lp")) * F.col("mask")), 6).alias("a"), F.round(F.sum(F.col("rew") * F.col("mask")), 6).alias("r"))
    p = s.groupBy("uid").agg(F.max_by("a", F.struct("r", -F.col("seq"))).alias("c"), F.min_by("a", F.struct("r", "seq")).alias("j"), F.count("*").alias("n")).where("n > 1")
    x = F.col("c") - F.col("j")
    return p.select("uid", F.round(F.log1p(F.exp(-0.1 * x)), 6).alias("dpo"), F.round(F.pow(x - 5.0, F.lit(2)), 4).alias("ipo"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def windowed_event_counts(spark, d):
    e = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("t"), "event_type", "value")
    g = e.groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM e) SELECT user_id, sid::BIGINT AS sid, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY user_id, sid")
def user_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w)
    e = read(spark, d, "events").withColumn("starts", F.when(F.coalesce(gap > F.expr("INTERVAL '30' MINUTE"), F.lit(True)), 1).otherwise(0)).withColumn("sid", F.sum("starts").over(w))
    return e.groupBy("user_id", "sid").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def lineitem_rollup(spark, d):
    return read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, r_name, count(DISTINCT o_orderkey) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")
def orders_per_nation(spark, d):
    t = lambda x: read(spark, d, x)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count_distinct("o_orderkey").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
