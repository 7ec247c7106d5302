"""Likelihood scores of documents and ranking metrics over them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions.kernels import zlib_size
from tracelake.operators import ranking as R
from tracelake.operators.scaling import ordered_prefix
from tracelake.plans import base as B
from tracelake.plans.registry import query
from tracelake.session import materialise, read

BOUNDS = [0.01, 0.05, 0.1, 0.2]


@query(f"WITH {B.BAG} SELECT doc_id, round(-sum(n * lp) / sum(n), 6) AS score FROM scored GROUP BY doc_id")
def doc_unigram_loss(spark, d):
    return B.doc_loss(spark, d)


LOWEST = """, low AS (SELECT doc_id, lp AS v, n, sum(n) OVER (PARTITION BY doc_id ORDER BY lp, tok ROWS UNBOUNDED PRECEDING) - n AS before, greatest(1, floor(sum(n) OVER (PARTITION BY doc_id) * 0.2)::BIGINT) AS k FROM scored)
SELECT doc_id, round(-sum(v * greatest(0, least(n, k - before))) / max(k), 6) AS score FROM low GROUP BY doc_id"""


def _lowest(scored, value, share=0.2):
    """Negated mean of the lowest ``max(1, int(n * share))`` values of each document, from counted tokens."""
    w = Window.partitionBy("doc_id").orderBy(value, "tok").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low = scored.select("doc_id", F.col(value).alias("v"), "n", (F.sum("n").over(w) - F.col("n")).alias("before"), F.greatest(F.lit(1), F.floor(F.sum("n").over(Window.partitionBy("doc_id")) * F.lit(share))).alias("k"))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.col("k") - F.col("before")))
    return low.groupBy("doc_id").agg(F.round(-F.sum(F.col("v") * taken) / F.max("k"), 6).alias("score"))


@query(f"WITH {B.BAG} {LOWEST}")
def doc_min_k(spark, d):
    return _lowest(B.scored_bag(spark, d), "lp")


PP = """, mo AS (SELECT sum(exp(lp) * lp) AS mu, sqrt(sum(exp(lp) * lp * lp) - pow(sum(exp(lp) * lp), 2)) AS sd FROM lm)"""


@query(f"WITH {B.BAG} {PP}, z AS (SELECT doc_id, tok, n, (lp - mu) / (sd + 1e-12) AS lp FROM scored, mo) {LOWEST.replace('FROM scored)', 'FROM z)')}")
def doc_min_k_plus(spark, d):
    s = B.scored_bag(spark, d)
    lm = B.unigrams(spark, d)
    mu = F.sum(F.exp("lp") * F.col("lp"))
    mo = lm.agg(mu.alias("mu"), F.sqrt(F.sum(F.exp("lp") * F.col("lp") * F.col("lp")) - F.pow(mu, F.lit(2))).alias("sd"))
    z = s.crossJoin(F.broadcast(mo)).select("doc_id", "tok", "n", ((F.col("lp") - F.col("mu")) / (F.col("sd") + 1e-12)).alias("lp"))
    return _lowest(z, "lp")


@query(f"""WITH {B.BAG}, st AS (SELECT source, sum(n) AS stotal FROM bag GROUP BY source), sl AS (SELECT source, tok, sum(n) AS sn FROM bag GROUP BY source, tok)
SELECT doc_id, round(-sum(n * lp) / sum(n) - (-sum(n * ln(sn / stotal)) / sum(n)), 5) AS score FROM scored s JOIN st ON s.source IS NOT DISTINCT FROM st.source JOIN sl ON s.source IS NOT DISTINCT FROM sl.source AND s.tok = sl.tok GROUP BY doc_id""")
def doc_reference_calibrated(spark, d):
    """Loss under the whole corpus minus loss under the document's own source."""
    s = B.scored_bag(spark, d)
    per = s.groupBy(F.coalesce("source", F.lit("\0")).alias("src"), "tok").agg(F.sum("n").alias("sn"))
    total = per.groupBy("src").agg(F.sum("sn").alias("stotal"))
    s = s.withColumn("src", F.coalesce("source", F.lit("\0"))).join(per, ["src", "tok"]).join(total, "src")
    return s.groupBy("doc_id").agg(F.round(-F.sum(F.col("n") * F.col("lp")) / F.sum("n") + F.sum(F.col("n") * F.log(F.col("sn") / F.col("stotal"))) / F.sum("n"), 5).alias("score"))


@query()
def doc_zlib_ratio(spark, d):
    z = read(spark, d, "documents").where("text is not null").select("doc_id", zlib_size("text").alias("z"))
    return B.doc_loss(spark, d).join(z, "doc_id").select("doc_id", F.round(F.col("score") / F.col("z"), 9).alias("score"))


@query(f"WITH {B.BAG} SELECT source, round(coalesce(-sum(n * lp) / sum(n), 0), 6) AS mean_loss, sum(n)::BIGINT AS n_tokens FROM scored GROUP BY source")
def loss_per_source(spark, d):
    return B.scored_bag(spark, d).groupBy("source").agg(F.round(F.coalesce(-F.sum(F.col("n") * F.col("lp")) / F.sum("n"), F.lit(0.0)), 6).alias("mean_loss"), F.sum("n").alias("n_tokens"))


AUROC = """, r AS (SELECT score, sum(is_member::INT) AS pos, sum((NOT is_member)::INT) AS neg FROM sl GROUP BY score),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM r), t AS (SELECT sum(pos) AS p, sum(neg) AS n FROM r)"""


@query(f"WITH {B.LOSS} {AUROC} SELECT sum(pos)::BIGINT AS n_members, sum(neg)::BIGINT AS n_nonmembers, round(sum(neg * (2 * (tp - pos) + pos)) / (2.0 * sum(pos) * sum(neg)), 6) AS auroc FROM c")
def auroc_loss_vs_quality(spark, d):
    return R.auroc(B.labelled_loss(spark, d))


@query(f"WITH {B.LOSS} {AUROC} SELECT score, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM c, t")
def roc_curve(spark, d):
    return R.roc_curve(B.labelled_loss(spark, d))


@query(f"WITH {B.LOSS} {AUROC} SELECT round(sum(pos * (tp / (tp + fp) + CASE WHEN tp - pos + fp - neg = 0 THEN 1 ELSE (tp - pos) / (tp - pos + fp - neg) END) / 2) / sum(pos), 6) AS pr_auc FROM c")
def pr_auc(spark, d):
    return R.pr_auc(B.labelled_loss(spark, d))


@query(f"WITH {B.LOSS} {AUROC} SELECT bound, round(coalesce(max(CASE WHEN fp / n <= bound THEN tp / p END), 0), 6) AS tpr FROM c, t, (SELECT unnest([0.01, 0.05, 0.1, 0.2])::DOUBLE AS bound) GROUP BY bound")
def tpr_at_fpr(spark, d):
    return R.tpr_at_fpr(B.labelled_loss(spark, d), BOUNDS)


@query()
def bootstrap_auroc(spark, d):
    return R.bootstrap_auroc(B.labelled_loss(spark, d))


@query(f"WITH {B.LOSS} SELECT is_member, row_number() OVER (PARTITION BY is_member ORDER BY doc_id) - 1 AS idx, doc_id AS id, score FROM sl")
def score_rows_dense_idx(spark, d):
    s = materialise(B.labelled_loss(spark, d).withColumn("one", F.lit(1)))
    return ordered_prefix(s, "doc_id", ["one"], keys=["is_member"]).select("is_member", F.col("one_before").cast("long").alias("idx"), F.col("doc_id").alias("id"), "score")


@query(f"""WITH {B.LOSS}, m AS (SELECT d.doc_id, l.score AS loss, d.n_chars::DOUBLE AS n_chars FROM documents d JOIN loss l USING (doc_id) WHERE n_chars IS NOT NULL),
e AS (SELECT min(loss) a, max(loss) b, min(n_chars) c, max(n_chars) e FROM m) SELECT doc_id, round(((loss - a) / (b - a) + (n_chars - c) / (e - c)) / 2, 6) AS score FROM m, e""")
def minmax_scores(spark, d):
    m = B.doc_loss(spark, d).withColumnRenamed("score", "loss").join(read(spark, d, "documents").where("n_chars is not null").select("doc_id", F.col("n_chars").cast("double").alias("n_chars")), "doc_id")
    return R.minmax(m, ["loss", "n_chars"]).select("doc_id", F.round((F.col("loss") + F.col("n_chars")) / 2, 6).alias("score"))


@query("""WITH w AS (SELECT item_id, extra_info.is_member AS is_member, extra_info.mia_weight AS w FROM heldout), e AS (SELECT min(w) a, max(w) b FROM w)
SELECT item_id, is_member, round(CASE WHEN w IS NULL THEN NULL WHEN b > a THEN (w - a) / (b - a) ELSE 0.5 END, 6) AS weight FROM w, e""")
def joint_minmax_weights(spark, d):
    w = read(spark, d, "heldout").select("item_id", F.col("extra_info.is_member").alias("is_member"), F.col("extra_info.mia_weight").alias("weight"))
    return R.minmax(w, ["weight"], 0.5).withColumn("weight", F.round("weight", 6))


SRC_AUC = f"""WITH {B.LOSS}, s AS (SELECT source, score, is_member FROM sl JOIN (SELECT doc_id, source FROM documents) USING (doc_id) WHERE source IS NOT NULL),
a AS (SELECT x.source, sum(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM s x JOIN s y ON x.source = y.source AND x.is_member AND NOT y.is_member GROUP BY x.source)"""


def _auc_by_source(spark, d, s=None):
    if s is None:
        s = B.labelled_loss(spark, d).join(read(spark, d, "documents").where("source is not null").select("doc_id", "source"), "doc_id")
    per = s.groupBy("source", "score").agg(F.sum(F.col("is_member").cast("long")).alias("pos"), F.sum((~F.col("is_member")).cast("long")).alias("neg"))
    c = ordered_prefix(materialise(per.withColumn("down", -F.col("score"))), "down", ["pos"], keys=["source"]).withColumnRenamed("pos_before", "tp0")
    return c.groupBy("source").agg(F.try_divide(F.sum(F.col("neg") * (2 * F.col("tp0") + F.col("pos"))).cast("double"), F.nullif(2.0 * F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc")).where("auc is not null")


@query(SRC_AUC + " SELECT source AS attack, round(100 * auc, 2) AS auroc_pct FROM a")
def auroc_percent_by_source(spark, d):
    return _auc_by_source(spark, d).select(F.col("source").alias("attack"), F.round(100 * F.col("auc"), 2).alias("auroc_pct"))


@query(SRC_AUC + """, r AS (SELECT round(100 * auc, 2) AS v, row_number() OVER (ORDER BY auc DESC, source) AS rn FROM a)
SELECT round(max(CASE WHEN rn = 1 THEN v END), 2) AS top1, round(avg(CASE WHEN rn <= 5 THEN v END), 2) AS top5, round(avg(CASE WHEN rn <= 10 THEN v END), 2) AS top10 FROM r""")
def leaderboard_topk(spark, d):
    """A handful of rows, one per source: the top-k report."""
    a = _auc_by_source(spark, d)
    r = a.select(F.round(100 * F.col("auc"), 2).alias("v"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("auc"), "source")).alias("rn"))
    return r.agg(F.round(F.max(F.when(F.col("rn") == 1, F.col("v"))), 2).alias("top1"), F.round(F.avg(F.when(F.col("rn") <= 5, F.col("v"))), 2).alias("top5"), F.round(F.avg(F.when(F.col("rn") <= 10, F.col("v"))), 2).alias("top10"))


@query(f"""WITH {B.LOSS} SELECT is_member, count(*) AS n, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS std, min(score) AS lo, max(score) AS hi FROM sl GROUP BY is_member""")
def score_file_stats(spark, d):
    return B.labelled_loss(spark, d).groupBy("is_member").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 6).alias("std"), F.min("score").alias("lo"), F.max("score").alias("hi"))


@query(f"""WITH {B.LOSS}, ref AS (SELECT doc_id, max(n_chars) AS ref FROM documents GROUP BY doc_id) SELECT doc_id, round(score - coalesce(ref, 0) / 1000.0, 6) AS diff FROM loss LEFT JOIN ref USING (doc_id)""")
def score_difference(spark, d):
    """Left join of two score tables with 0 for what the right one lacks."""
    ref = read(spark, d, "documents").groupBy("doc_id").agg(F.max("n_chars").alias("ref"))
    return B.doc_loss(spark, d).join(ref, "doc_id", "left").select("doc_id", F.round(F.col("score") - F.coalesce("ref", F.lit(0)) / 1000.0, 6).alias("diff"))
