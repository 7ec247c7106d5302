"""Reference-candidate metrics, reward shaping and evaluation summaries over the evaluation table."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import reward as W
from tracelake.functions import similarity as X
from tracelake.functions import text as T
from tracelake.functions.kernels import boxed, greedy_coverage, lcs, same_answer, sequence_ratio, shared_ngrams
from tracelake.operators.retrieval import nearest
from tracelake.plans import base as B
from tracelake.plans.registry import query
from tracelake.session import read

ID = ["ex_id", "cand_idx"]
INTER = "len(list_intersect(list_distinct(rt), list_distinct(ct)))"
UNION = "len(list_distinct(list_concat(rt, ct)))"


def _div(a, b):
    return f"coalesce({a}::DOUBLE / nullif({b}, 0), 0)"


@query(f"WITH {B.TPAIRS} SELECT ex_id, cand_idx, round({_div(INTER, UNION)}, 6) AS jaccard FROM tp")
def pair_jaccard(spark, d):
    return B.token_pairs(spark, d).select(*ID, F.round(X.jaccard(F.col("rt"), F.col("ct")), 6).alias("jaccard"))


@query(f"WITH {B.TPAIRS} SELECT ex_id, cand_idx, round({_div(INTER, 'len(list_distinct(rt))')}, 6) AS ref_set, round({_div(INTER, 'len(rt)')}, 6) AS ref_len, round({_div(INTER, 'len(ct)')}, 6) AS cand_len FROM tp")
def pair_token_overlap(spark, d):
    r, c = F.col("rt"), F.col("ct")
    return B.token_pairs(spark, d).select(*ID, F.round(X.overlap_ref_set(r, c), 6).alias("ref_set"), F.round(X.overlap_len(r, c, r), 6).alias("ref_len"), F.round(X.overlap_len(r, c, c), 6).alias("cand_len"))


@query(f"WITH {B.TPAIRS}, x AS (SELECT *, CASE WHEN len(rt) = 0 THEN CASE WHEN len(ct) > 0 THEN 0.0 ELSE 1.0 END ELSE len(ct)::DOUBLE / len(rt) END AS r FROM tp) SELECT ex_id, cand_idx, round(r, 6) AS ratio, round(1 / (1 + abs(r - 1)), 6) AS closeness FROM x")
def pair_length_ratio(spark, d):
    r = X.length_ratio(F.col("rt"), F.col("ct"))
    return B.token_pairs(spark, d).select(*ID, F.round(r, 6).alias("ratio"), F.round(X.length_similarity(r), 6).alias("closeness"))


@query()
def pair_lcs_ratio(spark, d):
    r, c = F.col("rt"), F.col("ct")
    p = B.token_pairs(spark, d).withColumn("n", lcs("rt", "ct"))
    return p.select(*ID, "n", F.round(X.ratio(F.col("n"), F.size(r)), 6).alias("by_ref"), F.round(X.ratio(F.col("n"), F.size(c)), 6).alias("by_cand"))


def _sql_grams(t):
    return f"list_distinct(flatten(list_transform(range(3, least(30, len({t})) + 1), lambda k: list_transform(range(1, len({t}) - k + 2), lambda i: array_to_string(list_slice({t}, i, i + k - 1), chr(31))))))"


GRAMS = f", gr AS (SELECT *, {_sql_grams('rt')} AS rg, {_sql_grams('ct')} AS cg FROM tp)"


@query(f"WITH {B.TPAIRS} {GRAMS} SELECT ex_id, cand_idx, len(rg)::INT AS ref_grams, round({_div('len(list_intersect(rg, cg))', 'len(rg)')}, 6) AS by_ref, round({_div('len(list_intersect(rg, cg))', 'len(cg)')}, 6) AS by_cand FROM gr")
def pair_unique_ngram_coverage(spark, d):
    p = B.token_pairs(spark, d).withColumn("g", shared_ngrams("rt", "ct"))
    return p.select(*ID, F.col("g.ref").alias("ref_grams"), F.round(X.ratio(F.col("g.both"), F.col("g.ref")), 6).alias("by_ref"), F.round(X.ratio(F.col("g.both"), F.col("g.cand")), 6).alias("by_cand"))


@query()
def pair_greedy_ngram_coverage(spark, d):
    """Greedy spans both ways, their cap of 30 tokens kept, and the longest common run."""
    p = B.token_pairs(spark, d).withColumns({"by_c": greedy_coverage("rt", "ct"), "by_r": greedy_coverage("ct", "rt")})
    return p.select(*ID, F.round(X.ratio(F.col("by_c.covered"), F.size("ct")), 6).alias("by_cand"), F.round(X.ratio(F.col("by_r.covered"), F.size("rt")), 6).alias("by_ref"), F.col("by_c.spans").alias("spans"), F.col("by_c.longest").alias("longest"))


@query()
def pair_sequence_ratio(spark, d):
    return B.pairs(spark, d).select(*ID, F.round(sequence_ratio("ref", "cand"), 6).alias("ratio"))


PEN = {"none": "1.0", "ratio": "r", "sqrt": "sqrt(r)", "log": "ln(1 + least(a, b)) / ln(1 + greatest(a, b))", "quadratic": "r * r", "super_quadratic": "pow(r, 2.5)", "cubic": "pow(r, 3)", "exponential": "exp(r - 1)"}
_PEN_SQL = ", ".join(f"round(CASE WHEN a = 0 THEN CASE WHEN b = 0 THEN 1.0 ELSE 0.0 END WHEN s >= 1 / 1.5 AND s <= 1.5 THEN 1.0 ELSE least(1.0, {e}) END, 6) AS {k}" for k, e in PEN.items())
LEN = f", ln AS (SELECT *, len({B.sql_words('ref')}) AS a, len({B.sql_words('cand')}) AS b FROM pairs), rs AS (SELECT *, {_div('b', 'a')} AS s, least({_div('b', 'a')}, {_div('a', 'b')}) AS r FROM ln)"


@query(f"WITH {B.PAIRS} {LEN} SELECT ex_id, cand_idx, {_PEN_SQL} FROM rs")
def length_penalty_all(spark, d):
    p = B.pairs(spark, d).withColumns({"a": F.size(T.words(F.col("ref"))), "b": F.size(T.words(F.col("cand")))})
    a, b = F.col("a"), F.col("b")
    return p.select(*ID, *[F.round(W.length_penalty(a, b, k.replace("_", "-")), 6).alias(k) for k in PEN])


def _trio(spark, d):
    """Token overlap, LCS ratio and unique n-gram coverage of each pair, and their penalised mean."""
    r, c = F.col("rt"), F.col("ct")
    p = B.token_pairs(spark, d).withColumns({"n": lcs("rt", "ct"), "g": shared_ngrams("rt", "ct")})
    m = {"token_overlap_ref": X.overlap_ref_set(r, c), "lcs_ratio": X.ratio(F.col("n"), F.size(r)), "unique_ngram_coverage_ref": X.ratio(F.col("g.both"), F.col("g.ref"))}
    p = p.withColumns(m)
    penalty = W.length_penalty(F.size(T.words(F.col("ref"))), F.size(T.words(F.col("cand"))), "ratio", 1.5)
    return p.withColumn("score", W.profile_score({k: F.col(k) for k in m}, W.TRIO, penalty))


@query()
def reward_trio_profile(spark, d):
    return _trio(spark, d).select(*ID, *[F.round(c, 6).alias(c) for c in ("token_overlap_ref", "lcs_ratio", "unique_ngram_coverage_ref", "score")])


GSCORE = f", sc AS (SELECT *, round({_div('len(list_intersect(rg, cg))', 'len(rg)')}, 6) AS score FROM gr)"


def _gram_score(spark, d):
    p = B.token_pairs(spark, d).withColumn("g", shared_ngrams("rt", "ct"))
    return p.select(*ID, "is_member", "w", F.round(X.ratio(F.col("g.both"), F.col("g.ref")), 6).alias("score"))


_MODES = {"linear": "score * (1 - w)", "quadratic": "score * pow(1 - w, 2)", "super_quadratic": "score * pow(1 - w, 2.5)", "cubic": "score * pow(1 - w, 3)", "contrastive": "greatest(score * (1 - w) - 0.5 * score * w, -0.1)"}


@query(f"WITH {B.TPAIRS} {GRAMS} {GSCORE} SELECT ex_id, cand_idx, {', '.join(f'round({e}, 6) AS {k}' for k, e in _MODES.items())} FROM sc WHERE w IS NOT NULL")
def membership_weighting(spark, d):
    s = _gram_score(spark, d).where("w is not null")
    return s.select(*ID, *[F.round(W.membership_weight(F.col("score"), F.col("w"), k.replace("_", "-"), True), 6).alias(k) for k in _MODES])


# References of a request: its item's ground truth first, then those of two neighbouring items as distractors.
ADAPT = f"""WITH {B.EV}, hs AS (SELECT item_id, reward_model.ground_truth AS gt, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM heldout WHERE reward_model.ground_truth IS NOT NULL),
refs AS (SELECT a.item_id, b.gt, j AS ref_idx FROM hs a, (SELECT unnest([0, 1, 2]) AS j), hs b WHERE b.k = (a.k + j) % a.n),
c AS (SELECT extra_info.id AS ex_id, extra_info.original_idx AS item_id, coalesce(extra_info.mia_weight, 0.5) AS w, unnest(responses) AS cand, unnest(range(len(responses)))::INT AS cand_idx FROM ev),
x AS (SELECT ex_id, cand_idx, w, ref_idx, {B.sql_tokens('gt')} AS rt, {B.sql_tokens('cand')} AS ct FROM c JOIN refs USING (item_id) WHERE cand IS NOT NULL),
s AS (SELECT ex_id, cand_idx, w, ref_idx, round({_div(INTER, 'len(list_distinct(rt))')}, 6) AS score FROM x),
g AS (SELECT ex_id, cand_idx, max(w) AS w, max(score) AS best, avg(score) AS mean, max(CASE WHEN ref_idx > 0 THEN score END) AS dmax, avg(CASE WHEN ref_idx > 0 THEN score END) AS davg FROM s GROUP BY ex_id, cand_idx)
SELECT ex_id, cand_idx, round((1 - w) * best + w * mean, 4) AS standard, round((1 - w) * best + w * davg, 4) AS distractor_avg, round((1 - w) * best + w * dmax, 4) AS distractor_max FROM g"""


@query(ADAPT)
def reward_adaptive_match(spark, d):
    """Adaptive matching of every response against its item's truth and two distractors."""
    held = read(spark, d, "heldout").where("reward_model.ground_truth is not null").select("item_id", F.col("reward_model.ground_truth").alias("gt"))
    ranked = held.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("item_id")) - 1)  # the held-out table is fixed, 240 rows
    n = ranked.count()
    refs = ranked.select("item_id", F.posexplode(F.array(*[F.pmod(F.col("k") + j, F.lit(max(n, 1))) for j in range(3)])).alias("ref_idx", "other"))
    refs = refs.join(F.broadcast(ranked.select(F.col("k").alias("other"), "gt")), "other").select("item_id", "ref_idx", T.tokens(F.col("gt")).alias("rt"))
    e = B.evaluations(spark, d).select(F.col("extra_info.id").alias("ex_id"), F.col("extra_info.original_idx").alias("item_id"), F.coalesce("extra_info.mia_weight", F.lit(0.5)).alias("w"), F.posexplode("responses").alias("cand_idx", "cand")).where("cand is not null")
    s = e.join(refs, "item_id").select(*ID, "w", "ref_idx", F.round(X.overlap_ref_set(F.col("rt"), T.tokens(F.col("cand"))), 6).alias("score"))
    far = F.when(F.col("ref_idx") > 0, F.col("score"))
    g = s.groupBy(*ID).agg(F.max("w").alias("w"), F.max("score").alias("best"), F.avg("score").alias("mean"), F.max(far).alias("dmax"), F.avg(far).alias("davg"), F.count("*").alias("n"))
    p = 1 - F.col("w")
    out = lambda v: F.round(W.adaptive_match(F.col("best"), F.col("mean"), F.col("davg"), F.col("dmax"), p, F.col("n"), v), 4).alias(v)
    return g.select(*ID, *[out(v) for v in ("standard", "distractor_avg", "distractor_max")])


BEST = f"WITH {B.TPAIRS} {GRAMS} {GSCORE}"


@query(BEST + ", ex AS (SELECT ex_id, round(avg(score), 6) AS avg_score, max(score) AS best_score, arg_min(cand_idx, [-score, cand_idx]) AS best_idx FROM sc GROUP BY ex_id) SELECT * FROM ex")
def best_candidate_per_reference(spark, d):
    """Mean and best over the candidates; the first of equal ones is best."""
    s = _gram_score(spark, d)
    return s.groupBy("ex_id").agg(F.round(F.avg("score"), 6).alias("avg_score"), F.max("score").alias("best_score"), F.min_by("cand_idx", F.struct(-F.col("score"), "cand_idx")).alias("best_idx"))


@query(BEST + ", ex AS (SELECT ex_id, avg(score) AS a, max(score) AS b FROM sc GROUP BY ex_id) SELECT count(*) AS n, round(avg(a), 5) AS avg_mean, round(avg(b), 5) AS best_mean, max(b) AS best_max FROM ex")
def dataset_summary(spark, d):
    ex = _gram_score(spark, d).groupBy("ex_id").agg(F.avg("score").alias("a"), F.max("score").alias("b"))
    return ex.agg(F.count("*").alias("n"), F.round(F.avg("a"), 5).alias("avg_mean"), F.round(F.avg("b"), 5).alias("best_mean"), F.max("b").alias("best_max"))


@query(BEST + ", ex AS (SELECT ex_id, max(w) AS w, avg(score) AS a, max(score) AS b FROM sc GROUP BY ex_id) SELECT round(sum((1 - w) * a) / sum(1 - w), 5) AS weighted_avg, round(sum((1 - w) * b) / sum(1 - w), 5) AS weighted_best FROM ex WHERE w IS NOT NULL")
def weighted_summary(spark, d):
    """Means weighted by the membership weight, inverted once."""
    ex = _gram_score(spark, d).groupBy("ex_id").agg(F.max("w").alias("w"), F.avg("score").alias("a"), F.max("score").alias("b")).where("w is not null")
    inv = 1 - F.col("w")
    return ex.agg(*[F.round(F.sum(inv * F.col(c)) / F.sum(inv), 5).alias(n) for c, n in (("a", "weighted_avg"), ("b", "weighted_best"))])


@query(BEST + ", ex AS (SELECT ex_id, bool_or(is_member) AS is_member, avg(score) AS a, max(score) AS b FROM sc GROUP BY ex_id) SELECT is_member, count(*) AS n, round(avg(a), 5) AS avg_mean, round(avg(b), 5) AS best_mean, max(b) AS best_max FROM ex GROUP BY is_member")
def subset_summary(spark, d):
    ex = _gram_score(spark, d).groupBy("ex_id").agg(F.max("is_member").alias("is_member"), F.avg("score").alias("a"), F.max("score").alias("b"))
    return ex.groupBy("is_member").agg(F.count("*").alias("n"), F.round(F.avg("a"), 5).alias("avg_mean"), F.round(F.avg("b"), 5).alias("best_mean"), F.max("b").alias("best_max"))


@query(f"WITH {B.EV}, p AS (SELECT lower(trim(data_source)) AS data_source, extra_info.id AS ex_id, len({B.sql_words('unnest(responses)')})::DOUBLE AS s FROM ev), e AS (SELECT data_source, ex_id, avg(s) AS m FROM p WHERE s IS NOT NULL GROUP BY ALL) SELECT data_source, round(avg(m), 5) AS mean_score FROM e GROUP BY data_source")
def mean_score_per_source(spark, d):
    """Mean over rows of the mean over responses, per data source."""
    e = B.evaluations(spark, d).select(F.lower(F.trim("data_source")).alias("data_source"), F.col("extra_info.id").alias("ex_id"), F.explode("responses").alias("r")).where("r is not null")
    m = e.groupBy("data_source", "ex_id").agg(F.avg(F.size(T.words(F.col("r"))).cast("double")).alias("m"))
    return m.groupBy("data_source").agg(F.round(F.avg("m"), 5).alias("mean_score"))


@query("""WITH e AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT a.vec_id AS q, b.vec_id AS nb, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS sim FROM e a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT q, nb, sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, nb) AS rn FROM p) WHERE rn <= 5""")
def embedding_topk_neighbours(spark, d):
    """The five nearest of all vectors for each query vector: the stated query set, ids divisible by 50, against all rows."""
    e = read(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))
    return nearest(e.select(F.col("vec_id").alias("nb"), F.col("embedding").alias("vector")), q, 5)


@query("""WITH c AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS v FROM c GROUP BY ALL), l AS (SELECT label, list(v ORDER BY i) AS cen FROM m GROUP BY label)
SELECT vec_id, round((list_cosine_similarity(embedding::DOUBLE[], cen) + 1) / 2, 5) AS sim FROM embeddings JOIN l USING (label)""")
def cosine_to_label_centroid(spark, d):
    """Element-wise mean vector per label, and each vector's cosine to it mapped to 0..1."""
    e = read(spark, d, "embeddings")
    m = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    cen = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("cen"))
    return e.join(cen, "label").select("vec_id", F.round(X.unit_cosine(F.col("embedding"), F.col("cen")), 5).alias("sim"))


@query(f"""WITH h AS (SELECT item_id, list_distinct(regexp_extract_all(lower(reward_model.ground_truth), '({T.MATH_TOKEN})', 1)) AS t FROM heldout WHERE reward_model.ground_truth IS NOT NULL),
p AS (SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t))::DOUBLE / nullif(len(list_distinct(list_concat(a.t, b.t))), 0), 6) AS sim FROM h a JOIN h b ON a.item_id <> b.item_id)
SELECT a, b, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn FROM p) WHERE rn <= 7""")
def distractor_topk_lexical(spark, d):
    """The seven most similar other items by regex tokens, over the fixed held-out table, by an inverted index."""
    h = read(spark, d, "heldout").where("reward_model.ground_truth is not null").select("item_id", F.array_distinct(T.math_tokens(F.col("reward_model.ground_truth"))).alias("t"))
    inv = h.select("item_id", F.size("t").alias("n"), F.explode("t").alias("tok"))
    other = inv.select(F.col("item_id").alias("b"), F.col("n").alias("nb"), "tok")
    both = inv.join(other, "tok").where("item_id <> b").groupBy(F.col("item_id").alias("a"), "b").agg(F.count("*").alias("i"), F.max("n").alias("na"), F.max("nb").alias("nb"))
    sim = both.select("a", "b", F.round(F.col("i") / (F.col("na") + F.col("nb") - F.col("i")), 6).alias("sim"))
    return sim.withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).where("rn <= 7").drop("rn")


@query()
def boxed_answer_grading(spark, d):
    """Whether the last boxed answer of a response equals that of its reference."""
    p = B.pairs(spark, d).withColumns({"given": boxed("cand"), "truth": boxed("ref")})
    return p.select(*ID, "given", "truth", same_answer("given", "truth").alias("is_right"), (F.length("cand") > 0).alias("answered"))


@query(f"WITH {B.PAIRS}, a AS (SELECT *, regexp_extract(right(cand, 300), '(?i)answer\\s*[:=]\\s*\\**([0-9.]+)', 1) AS given, regexp_extract(ref, '([0-9]+)[^0-9]*$', 1) AS truth FROM pairs) SELECT ex_id, cand_idx, given, CASE WHEN given <> '' AND given = truth THEN 1.0 ELSE -1.0 END AS score FROM a")
def minerva_grading(spark, d):
    """The last Answer: line of the last 300 characters against the reference's last number: 1 or -1."""
    p = B.pairs(spark, d).withColumns({"given": F.regexp_extract(F.expr("right(cand, 300)"), r"(?i)answer\s*[:=]\s*\**([0-9.]+)", 1), "truth": F.regexp_extract("ref", r"([0-9]+)[^0-9]*$", 1)})
    return p.select(*ID, "given", F.when((F.col("given") != "") & (F.col("given") == F.col("truth")), 1.0).otherwise(-1.0).alias("score"))


@query(f"WITH {B.PAIRS} SELECT ex_id, cand_idx, regexp_extract(cand, '(?i)Answer[ \\t]*:[ \\t]*\\$?([A-D])\\$?', 1) AS letter FROM pairs")
def letter_grading(spark, d):
    return B.pairs(spark, d).select(*ID, F.regexp_extract("cand", r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1).alias("letter"))


@query(f"""WITH {B.PAIRS}, j AS (SELECT *, regexp_extract_all(cand, '([0-9]+(?:\\.[0-9]+)?)', 1)[-1]::DOUBLE AS v FROM pairs), k AS (SELECT *, CASE WHEN v > 1 AND v <= 100 THEN v / 100 ELSE coalesce(v, 0) END AS x FROM j) SELECT ex_id, cand_idx, round(greatest(0, least(1, x)), 6) AS score FROM k""")
def judge_score_parsing(spark, d):
    return B.pairs(spark, d).select(*ID, F.round(T.judge_score(F.col("cand")), 6).alias("score"))


@query(f"WITH {B.PAIRS}, w AS (SELECT *, {B.sql_words('ref')} AS rw, {B.sql_words('cand')} AS cw FROM pairs) SELECT ex_id, cand_idx, CASE WHEN len(cw) <= len(rw) THEN cand ELSE array_to_string(list_slice(cw, 1, len(rw)), ' ') END AS cut FROM w")
def budget_truncation(spark, d):
    return B.pairs(spark, d).select(*ID, T.within_budget(F.col("cand"), F.col("ref")).alias("cut"))


@query(f"""WITH {B.EV} SELECT extra_info.id AS ex_id, CASE WHEN extra_info.mia_weight IS NOT NULL THEN extra_info.mia_weight WHEN reward_model.ground_truth = extra_info.member_ground_truth THEN extra_info.member_mia_weight WHEN reward_model.ground_truth = extra_info.nonmember_ground_truth THEN extra_info.nonmember_mia_weight END AS weight FROM ev""")
def membership_weight_lookup(spark, d):
    x, gt = "extra_info.", F.col("reward_model.ground_truth")
    w = F.coalesce(F.col(x + "mia_weight"), F.when(gt == F.col(x + "member_ground_truth"), F.col(x + "member_mia_weight")).when(gt == F.col(x + "nonmember_ground_truth"), F.col(x + "nonmember_mia_weight")))
    return B.evaluations(spark, d).select(F.col("extra_info.id").alias("ex_id"), w.alias("weight"))


@query(f"""WITH {B.EV} SELECT extra_info.id AS ex_id, CASE WHEN lower(trim(data_source)) LIKE 'aime%' OR lower(trim(data_source)) LIKE 'olymp%' THEN 'math' WHEN lower(trim(data_source)) LIKE 'book%' OR lower(trim(data_source)) LIKE 'wiki%' OR lower(trim(data_source)) LIKE 'arxiv%' THEN 'lexical' ELSE 'embedding' END AS scorer FROM ev""")
def scorer_routing(spark, d):
    s = F.lower(F.trim("data_source"))
    starts = lambda *p: F.coalesce(sum((s.startswith(x).cast("int") for x in p[1:]), s.startswith(p[0]).cast("int")) > 0, F.lit(False))
    return B.evaluations(spark, d).select(F.col("extra_info.id").alias("ex_id"), F.when(starts("aime", "olymp"), "math").when(starts("book", "wiki", "arxiv"), "lexical").otherwise("embedding").alias("scorer"))


@query(f"""WITH {B.PAIRS}, s AS (SELECT ex_id, cand_idx, w, len({B.sql_words('cand')}) > 30 AS good FROM pairs), n AS (SELECT ex_id, count(*) AS n, sum(good::INT) AS c FROM s GROUP BY ex_id)
SELECT ex_id, n, c::BIGINT AS c, (c > 0)::INT AS pass_at_n, round(c / n, 6) AS avg_at_n FROM n""")
def pass_at_k(spark, d):
    s = B.pairs(spark, d).select("ex_id", (F.size(T.words(F.col("cand"))) > 30).cast("long").alias("good"))
    return s.groupBy("ex_id").agg(F.count("*").alias("n"), F.sum("good").alias("c"), F.max("good").cast("int").alias("pass_at_n"), F.round(F.avg("good"), 6).alias("avg_at_n"))


@query(f"""WITH {B.PAIRS}, l AS (SELECT ex_id, cand_idx, len({B.sql_words('cand')}) % 5 AS label, len(cand) AS val FROM pairs), c AS (SELECT ex_id, label, count(*) AS n, min(cand_idx) AS f FROM l GROUP BY ALL),
b AS (SELECT ex_id, label FROM (SELECT *, row_number() OVER (PARTITION BY ex_id ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1) SELECT ex_id, b.label::INT AS label, arg_min(val, cand_idx)::INT AS val FROM l JOIN b USING (ex_id, label) GROUP BY ex_id, b.label""")
def majority_vote(spark, d):
    """The first value of the most frequent label; of equally frequent ones the one seen first."""
    s = B.pairs(spark, d).select("ex_id", "cand_idx", (F.size(T.words(F.col("cand"))) % 5).alias("label"), F.length("cand").alias("val"))
    per = s.groupBy("ex_id", "label").agg(F.count("*").alias("n"), F.min("cand_idx").alias("f"), F.min_by("val", "cand_idx").alias("val"))
    return per.groupBy("ex_id").agg(F.min_by(F.struct("label", "val"), F.struct(-F.col("n"), "f")).alias("b")).select("ex_id", "b.label", "b.val")


@query(f"""WITH {B.PAIRS}, s AS (SELECT ex_id, len(cand)::DOUBLE AS v FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY ex_id ORDER BY v) AS k, count(*) OVER (PARTITION BY ex_id) AS n FROM s)
SELECT ex_id, n, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std, round(sum(v * (pow(k, 2) - pow(k - 1, 2)) / pow(n, 2)), 5) AS best_of_2, round(sum(v * (pow(n - k + 1, 2) - pow(n - k, 2)) / pow(n, 2)), 5) AS worst_of_2 FROM r GROUP BY ex_id, n""")
def best_of_n_expectation(spark, d):
    """Mean, deviation, and the exact expectation of the best and worst of two draws with replacement."""
    s = B.pairs(spark, d).select("ex_id", F.length("cand").cast("double").alias("v"))
    r = s.withColumns({"k": F.row_number().over(Window.partitionBy("ex_id").orderBy("v")), "n": F.count("*").over(Window.partitionBy("ex_id"))})
    k, n = F.col("k"), F.col("n")
    e = lambda a, b: F.round(F.sum(F.col("v") * (F.pow(a, F.lit(2)) - F.pow(b, F.lit(2))) / F.pow(n, F.lit(2))), 5)
    return r.groupBy("ex_id", "n").agg(F.round(F.avg("v"), 5).alias("mean"), F.round(F.stddev_pop("v"), 5).alias("std"), e(k, k - 1).alias("best_of_2"), e(n - k + 1, n - k).alias("worst_of_2"))
