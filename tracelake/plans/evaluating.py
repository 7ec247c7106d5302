"""Scores by name, bundles of metrics, grading, reference choice, prompts and re-weighted summaries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import grading as Q
from tracelake.functions import reward as W
from tracelake.functions import similarity as X
from tracelake.functions import text as T
from tracelake.functions.bundle import BUNDLE, lexical_metrics, profiled
from tracelake.functions.kernels import lcs
from tracelake.operators import attacks as K
from tracelake.operators import ranking as R
from tracelake.operators import rewards as RW
from tracelake.operators.scaling import join_by_frequency
from tracelake.plans import base as B
from tracelake.plans.registry import query
from tracelake.plans.scores import SRC_AUC, _auc_by_source
from tracelake.plans.similarity import BEST, GRAMS, ID, INTER, UNION, _div, _gram_score
from tracelake.session import read, spread

# Every token of a document with its place and log-probability.
PLACED = f"""{B.BAG}, pl AS (SELECT doc_id, unnest({B.sql_tokens('text')}) AS tok, unnest(range(len({B.sql_tokens('text')}))) AS pos FROM documents WHERE text IS NOT NULL), pt AS (SELECT doc_id, pos, tok, lp FROM pl JOIN lm USING (tok))"""


def _placed(spark, d):
    docs = spread(read(spark, d, "documents").where("text is not null").select("doc_id", "text"))
    t = docs.select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "tok"))
    return join_by_frequency(t, B.unigrams(spark, d), "tok", "cnt").select("doc_id", "pos", "tok", "lp")


def _windows_sql(value, table, w, s, share=0.2):
    return f"""wm AS (SELECT doc_id, pos, round(avg({value}) OVER f, 9) AS m, count(*) OVER f AS c FROM {table} WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)),
wr AS (SELECT doc_id, m, row_number() OVER (PARTITION BY doc_id ORDER BY m, pos) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM wm WHERE c = {w} AND pos % {s} = 0) SELECT doc_id, round(-avg(m), 6) AS score FROM wr WHERE rn <= greatest(1, floor(n * {share})) GROUP BY doc_id"""


@query(f"WITH {PLACED}, {_windows_sql('lp', 'pt', 4, 2)}")
def doc_min_k_windows(spark, d):
    """Min-k over the means of windows of four tokens, every two tokens."""
    return K.attack("mink", 0.2, 4, 2)(_placed(spark, d), B.unigrams(spark, d)).select("doc_id", F.round("score", 6).alias("score"))


MOMENTS = "mo AS (SELECT sum(exp(lp) * lp) AS mu, sqrt(sum(exp(lp) * lp * lp) - pow(sum(exp(lp) * lp), 2)) AS sd FROM lm)"


@query(f"WITH {PLACED}, {MOMENTS}, z AS (SELECT doc_id, pos, (lp - mu) / (sd + 1e-12) AS z FROM pt, mo), {_windows_sql('z', 'z', 1, 1, 0.1)}")
def doc_min_k_plus_tokens(spark, d):
    """Min-k++ over single tokens at 10 percent."""
    return K.attack("min-k++", 0.1)(_placed(spark, d), B.unigrams(spark, d)).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {PLACED} SELECT 'loss' AS attack, count(*) AS n, round(avg(s), 5) AS mean FROM (SELECT doc_id, -avg(lp) AS s FROM pt GROUP BY doc_id) UNION ALL SELECT 'min_k', count(*), round(avg(score), 5) FROM ({_windows_sql('lp', 'pt', 1, 1).replace('wm AS', 'WITH wm AS', 1)})")
def scores_by_name(spark, d):
    """Scores looked up by any of their names, and their means."""
    placed, model = _placed(spark, d), B.unigrams(spark, d)
    one = lambda name: K.attack(name)(placed, model).agg(F.lit(K.canonical(name)).alias("attack"), F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean"))
    return one("Loss").unionByName(one("min-k%"))


@query(SRC_AUC + """, v AS (SELECT source AS attack, round(100 * auc, 2) AS auroc, row_number() OVER (ORDER BY auc DESC, source) AS rn FROM a)
SELECT attack, auroc FROM v UNION ALL SELECT 'top1', round(max(CASE WHEN rn = 1 THEN auroc END), 2) FROM v UNION ALL SELECT 'top5_mean', round(avg(auroc), 2) FROM v WHERE rn <= 5 UNION ALL SELECT 'top10_mean', round(avg(auroc), 2) FROM v WHERE rn <= 10""")
def leaderboard_rows(spark, d):
    """The leaderboard with its three summary rows; one row per source, of which there are few."""
    a = _auc_by_source(spark, d).select(F.col("source").alias("attack"), F.round(100 * F.col("auc"), 2).alias("auroc"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("auc"), "source")).alias("rn"))
    top = lambda n, name: a.where(F.col("rn") <= n).agg(F.lit(name).alias("attack"), F.round(F.avg("auroc"), 2).alias("auroc"))
    return a.select("attack", "auroc").unionByName(top(1, "top1")).unionByName(top(5, "top5_mean")).unionByName(top(10, "top10_mean"))


@query(SRC_AUC + """, l AS (SELECT d.source, d.n_chars::DOUBLE AS score, lab.is_member FROM documents d JOIN lab USING (doc_id) WHERE d.source IS NOT NULL AND d.n_chars IS NOT NULL), o AS (SELECT x.source, sum(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM l x JOIN l y ON x.source = y.source AND x.is_member AND NOT y.is_member GROUP BY x.source)
SELECT a.source AS attack, printf('%.2f/%.2f', round(100 * a.auc, 2), round(100 * o.auc, 2)) AS pair FROM a JOIN o USING (source)""")
def paired_results(spark, d):
    """Each metric beside its ``_original`` twin, ready to paste; metrics without a twin are left out."""
    own = _auc_by_source(spark, d).select(F.col("source").alias("key"), F.round(100 * F.col("auc"), 2).alias("v"))
    s = B.quality(spark, d).join(read(spark, d, "documents").where("source is not null and n_chars is not null").select("doc_id", "source", F.col("n_chars").cast("double").alias("score")), "doc_id")
    twin = _auc_by_source(spark, d, s).select(F.concat("source", F.lit("_original")).alias("key"), F.round(100 * F.col("auc"), 2).alias("v"))
    values = own.unionByName(twin)
    return values.alias("a").join(values.alias("o"), F.concat("a.key", F.lit("_original")) == F.col("o.key")).select(F.col("a.key").alias("attack"), F.format_string("%.2f/%.2f", "a.v", "o.v").alias("pair"))


@query(BEST + ", ex AS (SELECT ex_id, max(w) AS w, round(avg(score), 6) AS avg_score, max(score) AS best_score, count(*) AS n FROM sc GROUP BY ex_id) SELECT ex_id, avg_score, best_score, n, round(avg_score * w, 6) AS weighted_avg_score, round(best_score * w, 6) AS weighted_best_score, round(n * w, 6) AS weighted_n FROM ex WHERE w IS NOT NULL")
def reweighted_examples(spark, d):
    """Stored rows per example with ``weighted_`` columns for every numeric one."""
    ex = _gram_score(spark, d).groupBy("ex_id").agg(F.max("w").alias("w"), F.round(F.avg("score"), 6).alias("avg_score"), F.max("score").alias("best_score"), F.count("*").alias("n")).where("w is not null")
    return R.reweighted(ex, "w", ["ex_id"]).drop("w")


METRICS = f"""SELECT ex_id, cand_idx, round({_div(INTER, UNION)}, 6) AS lexical_token_overlap, round({_div(INTER, 'len(list_distinct(rt))')}, 6) AS lexical_token_overlap_ref, round(CASE WHEN len(rt) = 0 THEN CASE WHEN len(ct) > 0 THEN 0.0 ELSE 1.0 END ELSE len(ct)::DOUBLE / len(rt) END, 6) AS length_ratio"""

@query(f"WITH {B.TPAIRS} {METRICS} FROM tp")
def selected_metrics(spark, d):
    """Three of the nine metrics."""
    return lexical_metrics(B.token_pairs(spark, d), ID, ["lexical_token_overlap", "lexical_token_overlap_ref", "length_ratio"])


@query()
def nine_metrics(spark, d):
    return lexical_metrics(B.token_pairs(spark, d), ID, list(BUNDLE))


@query()
def six_metrics(spark, d):
    """Jaccard, LCS length and ratios, token overlap by either length, from one pass over each pair."""
    r, c = F.col("rt"), F.col("ct")
    p = B.token_pairs(spark, d).withColumn("lcs_len", lcs("rt", "ct"))
    return p.select(*ID, F.round(X.jaccard(r, c), 6).alias("jaccard"), "lcs_len", F.round(X.ratio(F.col("lcs_len"), F.size(r)), 6).alias("lcs_ratio_ref"), F.round(X.ratio(F.col("lcs_len"), F.size(c)), 6).alias("lcs_ratio_cand"), F.round(X.overlap_len(r, c, r), 6).alias("overlap_ref"), F.round(X.overlap_len(r, c, c), 6).alias("overlap_cand"))


def _box(c):
    return f"list_extract(regexp_extract_all({c}, '{Q.BOXED}', 1), -1)"


@query(f"WITH {B.PAIRS}, b AS (SELECT *, {_box('cand')} AS given, {_box('right(cand, 100)')} AS tail, regexp_extract(cand, '([0-9]+)[^0-9]*$', 1) AS truth FROM pairs) SELECT ex_id, cand_idx, given, CASE WHEN tail = truth THEN 1 ELSE -1 END AS strict, CASE WHEN given = truth THEN 1 ELSE 0 END AS counted FROM b")
def strict_box_grading(spark, d):
    """The last box against the text's last number: within the last 100 characters, and anywhere."""
    truth = F.regexp_extract("cand", r"([0-9]+)[^0-9]*$", 1)
    return B.pairs(spark, d).select(*ID, Q.last_boxed(F.col("cand")).alias("given"), Q.strict_box(F.col("cand"), truth).alias("strict"), Q.boxed_count(F.col("cand"), truth).alias("counted"))


@query(f"""WITH {B.EV}, r AS (SELECT extra_info.id AS ex_id, extra_info.transformed_ground_truth AS t, prompt[1].content AS p, list_filter([reward_model.ground_truth, extra_info.member_ground_truth, extra_info.nonmember_ground_truth], lambda x: x IS NOT NULL) AS refs, coalesce(extra_info.is_member, FALSE) AS by_prompt FROM ev),
w AS (SELECT *, list_extract(list_filter(regexp_split_to_array(lower(trim(p, ' ')), '\\s+'), lambda w: w <> ''), -1) AS last FROM r), n AS (SELECT *, list_filter(refs, lambda x: coalesce(list_contains({B.sql_tokens('x').replace('lambda w:', 'lambda v:').replace("trim(w,", "trim(v,").replace("w <> ''", "v <> ''")}, last), FALSE)) AS near FROM w)
SELECT ex_id, CASE WHEN t IS NOT NULL THEN [t] WHEN by_prompt AND len(near) > 0 THEN near ELSE refs END AS refs FROM n""")
def filtered_references(spark, d):
    x = "extra_info."
    refs = F.filter(F.array("reward_model.ground_truth", x + "member_ground_truth", x + "nonmember_ground_truth"), lambda r: r.isNotNull())
    target = F.when(F.col(x + "transformed_ground_truth").isNotNull(), F.array(x + "transformed_ground_truth"))
    prompt = F.try_element_at("prompt", F.lit(1))["content"]
    return B.evaluations(spark, d).select(F.col(x + "id").alias("ex_id"), Q.chosen_references(refs, target, prompt, F.col(x + "is_member"), T.tokens).alias("refs"))


@query(f"""WITH {B.TPAIRS}, e AS (SELECT extra_info.id AS ex_id, lower(trim(data_source)) AS source FROM ev), x AS (SELECT tp.*, coalesce(source, '') AS source FROM tp JOIN e USING (ex_id))
SELECT ex_id, cand_idx, round(CASE WHEN source LIKE 'aime%' OR source LIKE 'olymp%' THEN CASE WHEN {_box('cand')} = {_box('ref')} THEN 1.0 ELSE 0.0 END WHEN source LIKE 'book%' OR source LIKE 'wiki%' OR source LIKE 'arxiv%' THEN {_div(INTER, 'len(list_distinct(rt))')} ELSE {_div(INTER, UNION)} END, 6) AS score FROM x""")
def routed_scores(spark, d):
    """Every response scored by the scorer of its data source, all in one pass; a score that fails is 0."""
    e = B.evaluations(spark, d).select(F.col("extra_info.id").alias("ex_id"), F.coalesce(F.lower(F.trim("data_source")), F.lit("")).alias("source"))
    x = B.token_pairs(spark, d).join(e, "ex_id")
    starts = lambda *p: F.col("source").rlike("^(?:" + "|".join(p) + ")")
    math = F.when(Q.last_boxed(F.col("cand")) == Q.last_boxed(F.col("ref")), 1.0).otherwise(0.0)
    score = F.when(starts("aime", "olymp"), math).when(starts("book", "wiki", "arxiv"), X.overlap_ref_set(F.col("rt"), F.col("ct"))).otherwise(X.jaccard(F.col("rt"), F.col("ct")))
    return x.select(*ID, F.round(Q.or_zero(score), 6).alias("score"))


# A word's vector: that of the row its first letter and length pick.
_VEC = """voc AS (SELECT embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 64))"""


@query(f"""WITH {_VEC}, h AS (SELECT item_id, unnest({B.sql_tokens('reward_model.ground_truth')}) AS tok FROM heldout WHERE reward_model.ground_truth IS NOT NULL), k AS (SELECT item_id, (ascii(tok) * 7 + length(tok)) % 64 AS k, count(*) AS n FROM h WHERE regexp_matches(tok, '^[a-z]') GROUP BY ALL),
c AS (SELECT item_id, n, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM k JOIN voc USING (k)), m AS (SELECT item_id, i, sum(n * x) / sum(n) AS x FROM c GROUP BY item_id, i), l AS (SELECT item_id, sqrt(sum(x * x)) AS norm FROM m GROUP BY item_id)
SELECT item_id, round(max(CASE WHEN i = 1 THEN x / norm END), 5) AS first, round(max(CASE WHEN i = 64 THEN x / norm END), 5) AS last, count(*) AS dims FROM m JOIN l USING (item_id) GROUP BY item_id""")
def mean_word_vectors(spark, d):
    """Sentence vectors: the mean of the words' vectors, of length one; words are counted before the vectors are joined."""
    first = read(spark, d, "embeddings").select("vec_id", "embedding").orderBy("vec_id").limit(64)  # the 64 words of this vocabulary
    voc = first.select("embedding", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("vec_id")) - 1).alias("k"))
    h = read(spark, d, "heldout").where("reward_model.ground_truth is not null").select("item_id", F.explode(T.tokens(F.col("reward_model.ground_truth"))).alias("tok")).where("tok rlike '^[a-z]'")
    k = h.groupBy("item_id", ((F.ascii("tok") * 7 + F.length("tok")) % 64).alias("k")).agg(F.count("*").alias("n"))
    m = k.join(F.broadcast(voc), "k").select("item_id", "n", F.posexplode("embedding").alias("i", "x")).groupBy("item_id", "i").agg((F.sum(F.col("n") * F.col("x").cast("double")) / F.sum("n")).alias("x"))
    norm = m.groupBy("item_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    at = lambda i: F.round(F.max(F.when(F.col("i") == i, F.col("x") / F.col("norm"))), 5)
    return m.join(norm, "item_id").groupBy("item_id").agg(at(0).alias("first"), at(63).alias("last"), F.count("*").alias("dims"))


@query(f"""WITH {B.PAIRS}, t AS (SELECT DISTINCT x FROM (SELECT ref AS x FROM pairs UNION ALL SELECT cand FROM pairs)), v AS (SELECT x, [length(x)::DOUBLE, len({B.sql_words('x')})::DOUBLE, len(string_split(x, 'e'))::DOUBLE] AS v FROM t)
SELECT ex_id, cand_idx, round((list_cosine_similarity(a.v, b.v) + 1) / 2, 5) AS score FROM pairs JOIN v a ON pairs.ref = a.x JOIN v b ON pairs.cand = b.x WHERE ref <> '' AND cand <> ''""")
def embedded_reward(spark, d):
    """Every distinct text is embedded once, and the vectors joined back by a hash of the text; the vectors stand in for a model's."""
    p = B.pairs(spark, d).where("ref <> '' and cand <> ''").withColumns({"hr": F.xxhash64("ref"), "hc": F.xxhash64("cand")})
    t = p.select(F.col("hr").alias("h"), F.col("ref").alias("x")).unionByName(p.select(F.col("hc").alias("h"), F.col("cand").alias("x"))).distinct()
    v = t.select("h", F.col("x").alias("__x"), F.array(F.length("x").cast("double"), F.size(T.words(F.col("x"))).cast("double"), F.size(F.split("x", "e")).cast("double")).alias("v"))
    # the hash brings them together, the text decides
    a, b = v.select(F.col("h").alias("hr"), F.col("__x").alias("ar"), F.col("v").alias("vr")), v.select(F.col("h").alias("hc"), F.col("__x").alias("ac"), F.col("v").alias("vc"))
    j = p.join(a, "hr").where("ref = ar").join(b, "hc").where("cand = ac")
    return j.select(*ID, F.round(X.unit_cosine(F.col("vr"), F.col("vc")), 5).alias("score"))


@query(f"""WITH {B.PAIRS}, s AS (SELECT ex_id, len(cand)::DOUBLE AS v FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY ex_id ORDER BY v) AS k, count(*) OVER (PARTITION BY ex_id) AS n FROM s), d AS (SELECT r.*, unnest(list_distinct(list_concat(list_filter([2, 4, 8, 16, 32], lambda x: x < n), [n]))) AS draws FROM r WHERE n > 1),
e AS (SELECT ex_id, draws, n, sum(v * b) AS bm, sum(v * v * b) AS bs, sum(v * w) AS wm, sum(v * v * w) AS ws FROM (SELECT *, pow(k / n::DOUBLE, draws) - pow((k - 1) / n::DOUBLE, draws) AS b, pow((n - k + 1) / n::DOUBLE, draws) - pow((n - k) / n::DOUBLE, draws) AS w FROM d WHERE draws <= n) GROUP BY ex_id, draws, n)
SELECT ex_id, draws::INT AS draws, round(bm, 4) AS best_mean, round(sqrt(greatest(bs - bm * bm, 0)), 3) AS best_std, round(wm, 4) AS worst_mean, round(sqrt(greatest(ws - wm * wm, 0)), 3) AS worst_std FROM e""")
def best_and_worst_of_n(spark, d):
    """Mean and deviation of the best and the worst of 2, 4, 8, ... and of all n draws with replacement, exactly, without drawing."""
    s = B.pairs(spark, d).select("ex_id", F.length("cand").cast("double").alias("v"))
    r = s.withColumns({"k": F.row_number().over(Window.partitionBy("ex_id").orderBy("v")), "n": F.count("*").over(Window.partitionBy("ex_id")).cast("double")})
    r = r.withColumn("draws", F.explode(F.array_union(F.filter(F.array(*[F.lit(2**i) for i in range(1, 11)]), lambda x: x < F.col("n")), F.array(F.col("n").cast("int"))))).where("n > 1")
    share = lambda hi, lo: F.pow(hi / F.col("n"), F.col("draws")) - F.pow(lo / F.col("n"), F.col("draws"))
    b, w = share(F.col("k"), F.col("k") - 1), share(F.col("n") - F.col("k") + 1, F.col("n") - F.col("k"))
    e = r.groupBy("ex_id", "draws").agg(*[F.sum(F.col("v") * x).alias(f"{n}m") for x, n in ((b, "b"), (w, "w"))], *[F.sum(F.col("v") * F.col("v") * x).alias(f"{n}s") for x, n in ((b, "b"), (w, "w"))])
    std = lambda n: F.round(F.sqrt(F.greatest(F.col(f"{n}s") - F.col(f"{n}m") * F.col(f"{n}m"), F.lit(0.0))), 3)
    return e.select("ex_id", "draws", F.round("bm", 4).alias("best_mean"), std("b").alias("best_std"), F.round("wm", 4).alias("worst_mean"), std("w").alias("worst_std"))


@query(f"""WITH {B.TPAIRS}, e AS (SELECT extra_info.id AS ex_id, prompt[1].content AS p FROM ev)
SELECT ex_id, cand_idx, '0-1' AS scale, 'Reference: ' || trim(ref, ' ') || chr(10) || 'Candidate: ' || trim(cand, ' ') || chr(10) || 'Shared words: ' || printf('%.3f', round({_div(INTER, UNION)}, 3)) || ', length: ' || printf('%.3f', round(CASE WHEN len(rt) = 0 THEN CASE WHEN len(ct) > 0 THEN 0.0 ELSE 1.0 END ELSE len(ct)::DOUBLE / len(rt) END, 3)) || chr(10) || 'REWARD: <number between 0 and 1>' AS prompt FROM tp JOIN e USING (ex_id)""")
def judge_prompts(spark, d):
    """Prompts for a judge from a named template, with the metrics that the template names."""
    text = Q.template("v3")
    metrics = {n: BUNDLE[n]() for n in Q.PLACEHOLDERS.values()}
    e = B.evaluations(spark, d).select(F.col("extra_info.id").alias("ex_id"), F.try_element_at("prompt", F.lit(1))["content"].alias("p"))
    return B.token_pairs(spark, d).join(e, "ex_id").select(*ID, F.lit(Q.score_range(text)).alias("scale"), Q.filled(text, F.col("p"), F.col("ref"), F.col("cand"), metrics).alias("prompt"))


@query(r"""WITH r AS (SELECT doc_id, 'Reasoning first. Output: ' || text AS problem_raw FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(trim(regexp_extract(problem_raw, '(?is)output\s*:\s*(.*)$', 1), E' \t\n\r')) AS problem FROM r""")
def extracted_again(spark, d):
    """Fields taken anew from the raw texts stored beside them, without asking a model again."""
    r = read(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("Reasoning first. Output: "), F.col("text")).alias("problem_raw"))
    return r.select("doc_id", F.md5(F.btrim(F.regexp_extract("problem_raw", r"(?is)output\s*:\s*(.*)$", 1), F.lit(" \t\n\r"))).alias("problem"))


@query("""WITH h AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM heldout WHERE reward_model.ground_truth IS NOT NULL),
p AS (SELECT a.item_id, b.item_id AS other, CASE WHEN b.k = (a.k + 1) % a.n THEN 0 ELSE 1 END AS late, md5(concat('3-', a.item_id, '-', b.item_id)) AS h FROM h a JOIN h b ON a.item_id <> b.item_id)
SELECT item_id, other, rn - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY late, h, other) AS rn FROM p) WHERE rn <= 4""")
def perturbed_distractors(spark, d):
    """For each held-out item its paired one first, then three drawn by hash; over the fixed held-out table, 240 rows."""
    h = read(spark, d, "heldout").where("reward_model.ground_truth is not null").select("item_id").withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("item_id")) - 1)
    n = h.count()
    p = h.join(F.broadcast(h.select(F.col("item_id").alias("other"), F.col("k").alias("k2"))), F.col("item_id") != F.col("other"))
    late = F.when(F.col("k2") == (F.col("k") + 1) % F.lit(max(n, 1)), 0).otherwise(1)
    w = Window.partitionBy("item_id").orderBy(late, F.md5(F.concat_ws("-", F.lit("3"), "item_id", "other")), "other")
    return p.select("item_id", "other", (F.row_number().over(w) - 1).cast("long").alias("place")).where("place < 4")


@query(f"""WITH {B.EV} SELECT extra_info.id AS ex_id, h.item_id, reward_model.ground_truth IS NOT DISTINCT FROM h.gt AS same FROM ev JOIN (SELECT item_id, reward_model.ground_truth AS gt FROM heldout) h ON extra_info.original_idx = h.item_id""")
def perturbed_twins(spark, d):
    """Every evaluation beside the row of the twin table at its original place."""
    h = read(spark, d, "heldout").select("item_id", F.col("reward_model.ground_truth").alias("gt"))
    e = B.evaluations(spark, d).select(F.col("extra_info.id").alias("ex_id"), F.col("extra_info.original_idx").alias("item_id"), F.col("reward_model.ground_truth").alias("ref"))
    return e.join(h, "item_id").select("ex_id", "item_id", F.col("ref").eqNullSafe(F.col("gt")).alias("same"))


@query(f"""WITH {B.TPAIRS} SELECT ex_id, cand_idx, round({_div(INTER, UNION)}, 6) AS jaccard, round({_div(INTER, 'len(list_distinct(rt))')}, 6) AS token_overlap, round({_div(INTER, UNION)}, 6) AS reward FROM tp""")
def managed_rewards(spark, d):
    """Registered rewards applied to every response in one pass: the reward and its extras."""
    rewards = {n: RW.REWARDS[n] for n in ("jaccard", "token_overlap")}
    return RW.scored(B.pairs(spark, d), rewards).select(*ID, *[F.round(c, 6).alias(c) for c in (*rewards, "reward")])


@query(r"""WITH r AS (SELECT doc_id, 'We think first. Output: ' || left(text, 200) AS t FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '(?i)(output|answer)\s*:'))
SELECT doc_id, md5(t) AS summary_raw, trim(regexp_extract(t, '(?is)^(.*?)(?:Output|output|answer)\s*:', 1), ' ') AS summary_reasoning FROM r""")
def enriched_fields(spark, d):
    """A field with its raw text and the reasoning before it."""
    r = read(spark, d, "documents").where("text is not null").where(~F.col("text").rlike(r"(?i)(output|answer)\s*:")).select("doc_id", F.concat(F.lit("We think first. Output: "), F.substring("text", 1, 200)).alias("t"))
    return RW.enriched(r, {"summary": F.col("t")}).select("doc_id", F.md5("summary_raw").alias("summary_raw"), "summary_reasoning")


_PROFILES = ("lexical_token_overlap_ref", "unique_ngram_coverage_ref_ratio_1.50", "unique_ngram_coverage_ref_ratio_1.50_mia_quadratic")
_PENALTY = "CASE WHEN a = 0 THEN CASE WHEN b = 0 THEN 1.0 ELSE 0.0 END WHEN s >= 1 / 1.5 AND s <= 1.5 THEN 1.0 ELSE least(1.0, r) END"


@query(f"""WITH {B.TPAIRS} {GRAMS}, l AS (SELECT *, len({B.sql_words('ref')}) AS a, len({B.sql_words('cand')}) AS b, {_div(INTER, 'len(list_distinct(rt))')} AS m, {_div('len(list_intersect(rg, cg))', 'len(rg)')} AS u FROM gr), p AS (SELECT *, {_div('b', 'a')} AS s, least({_div('b', 'a')}, {_div('a', 'b')}) AS r FROM l)
SELECT ex_id, cand_idx, round(m, 6) AS plain, round(u * {_PENALTY}, 6) AS penalised, round(u * {_PENALTY} * pow(1 - w, 2), 6) AS weighted FROM p""")
def profile_rewards(spark, d):
    """Rewards by profile name: a metric alone, with a length penalty, and weighted by membership."""
    p = B.token_pairs(spark, d)
    names = dict(zip(("plain", "penalised", "weighted"), _PROFILES))
    return p.select(*ID, *[F.round(profiled(n), 6).alias(c) for c, n in names.items()])


_REFS = "list_filter([reward_model.ground_truth, extra_info.member_ground_truth, extra_info.nonmember_ground_truth], lambda x: x IS NOT NULL)"


@query(f"""WITH {B.EV}, e AS (SELECT extra_info.id AS ex_id, {_REFS} AS refs, responses FROM ev), c AS (SELECT ex_id, refs, unnest(responses) AS cand, unnest(range(len(responses)))::INT AS cand_idx FROM e), x AS (SELECT ex_id, cand_idx, cand, unnest(refs) AS ref, unnest(range(len(refs)))::INT AS ref_idx FROM c WHERE cand IS NOT NULL),
t AS (SELECT *, {B.sql_tokens('ref')} AS rt, {B.sql_tokens('cand')} AS ct, len({B.sql_words('ref')}) AS a, len({B.sql_words('cand')}) AS b FROM x), s AS (SELECT *, round({_div(INTER, UNION)}, 6) AS sim, {_div('b', 'a')} AS s, least({_div('b', 'a')}, {_div('a', 'b')}) AS r FROM t)
SELECT ex_id, cand_idx, count(*) AS n_refs, arg_min(ref_idx, [-sim, ref_idx]) AS best_ref, round(arg_min(sim * {_PENALTY}, [-sim, ref_idx]), 6) AS score FROM s GROUP BY ex_id, cand_idx""")
def best_over_references(spark, d):
    """Every response against all references of its sample: the most similar one, the first of equals, and the length penalty on that one."""
    x = "extra_info."
    refs = F.filter(F.array("reward_model.ground_truth", x + "member_ground_truth", x + "nonmember_ground_truth"), lambda r: r.isNotNull())
    c = B.evaluations(spark, d).select(F.col(x + "id").alias("ex_id"), refs.alias("refs"), F.posexplode("responses").alias("cand_idx", "cand")).where("cand is not null")
    t = c.select("ex_id", "cand_idx", "cand", F.posexplode("refs").alias("ref_idx", "ref"))
    a, b = F.size(T.words(F.col("ref"))), F.size(T.words(F.col("cand")))
    s = t.select(*ID, "ref_idx", F.round(X.jaccard(T.tokens(F.col("ref")), T.tokens(F.col("cand"))), 6).alias("sim"), W.length_penalty(a, b, "ratio", 1.5).alias("penalty"))
    first = F.struct(-F.col("sim"), F.col("ref_idx"))
    return s.groupBy(*ID).agg(F.count("*").alias("n_refs"), F.min_by("ref_idx", first).alias("best_ref"), F.round(F.min_by(F.col("sim") * F.col("penalty"), first), 6).alias("score"))


@query(f"WITH {B.TOKENS}, m AS (SELECT uid, 'advantage' AS metric, list(adv) AS v FROM tk GROUP BY uid UNION ALL SELECT uid, 'value', list(val) FROM tk GROUP BY uid) SELECT metric, count(*) AS n_lists, round(avg(list_avg(v)), 5) AS mean_of_means, sum(len(v))::BIGINT AS n_values FROM m GROUP BY metric")
def metric_list_means(spark, d):
    """Lists of values per metric reduced to their means."""
    m = B.token_rows(spark, d).groupBy("uid").agg(F.create_map(F.lit("advantage"), F.collect_list("adv"), F.lit("value"), F.collect_list("val")).alias("m"))
    v = m.select(F.explode("m").alias("metric", "v"))
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    return v.groupBy("metric").agg(F.count("*").alias("n_lists"), F.round(F.avg(mean), 5).alias("mean_of_means"), F.sum(F.size("v")).cast("long").alias("n_values"))


@query("""WITH h AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS p, count(*) OVER () AS n FROM heldout), r AS (SELECT item_id, (n - 1 - p) AS p, n FROM h) SELECT item_id, p AS position, p // 60 AS chunk FROM r""")
def reordered_chunks(spark, d):
    """Rows in another order, cut into chunks and put together again."""
    from tracelake.operators.scaling import positions

    h = positions(read(spark, d, "heldout").select("item_id"), [F.desc("item_id")], "position").withColumn("chunk", F.floor(F.col("position") / 60))
    parts = [h.where(F.col("chunk") == i) for i in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("item_id", "position", "chunk")
