"""Rewards end to end, filters of groups, score tables in pairs, sequences of fixed length and masks of turns."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import records as RC
from tracelake.functions import reward as W
from tracelake.functions import similarity as X
from tracelake.functions import text as T
from tracelake.operators import ranking as R
from tracelake.operators.scaling import positions
from tracelake.plans import base as B
from tracelake.plans.registry import query
from tracelake.plans.similarity import ID, INTER, _div
from tracelake.session import materialise, read

_W = B.sql_words
_CUT = "CASE WHEN len({w}) = 0 THEN ' ' ELSE array_to_string(list_slice({w}, floor(len({w}) * 0.25)::INT + 1, len({w})), ' ') END"

REWARD = f"""WITH {B.PAIRS}, a AS (SELECT ex_id, cand_idx, w, {_W('ref')} AS rw0, {_W('cand')} AS cw0 FROM pairs), b AS (SELECT ex_id, cand_idx, w, {_CUT.format(w='rw0')} AS r, {_CUT.format(w='cw0')} AS c FROM a),
d AS (SELECT ex_id, cand_idx, w, r, {_W('r')} AS rw, {_W('c')} AS cw, c FROM b), e AS (SELECT ex_id, cand_idx, w, len(rw) AS a, len(cw) AS b, {B.sql_tokens('r')} AS rt, {B.sql_tokens("CASE WHEN len(cw) <= len(rw) THEN c ELSE array_to_string(list_slice(cw, 1, len(rw)), ' ') END")} AS ct FROM d),
f AS (SELECT *, {_div(INTER, 'len(list_distinct(rt))')} AS m, {_div('b', 'a')} AS s, least({_div('b', 'a')}, {_div('a', 'b')}) AS q FROM e),
g AS (SELECT ex_id, cand_idx, round(m * CASE WHEN a = 0 THEN CASE WHEN b = 0 THEN 1.0 ELSE 0.0 END WHEN s >= 1 / 1.5 AND s <= 1.5 THEN 1.0 ELSE least(1.0, q) END * coalesce(w, 1), 6) AS score FROM f)
SELECT ex_id, count(*) AS n, max(score) AS reward, arg_min(cand_idx, [-score, cand_idx]) AS best_idx FROM g GROUP BY ex_id"""


@query(REWARD)
def lexical_reward(spark, d):
    """The lexical reward from end to end: prefixes off, the candidate cut to the reference's length, its metric times length penalty and membership weight, the best per example."""
    p = B.pairs(spark, d).withColumns({"r": T.without_prefix(F.col("ref"), 0.25, " "), "c": T.without_prefix(F.col("cand"), 0.25, " ")})
    p = p.withColumns({"a": F.size(T.words(F.col("r"))), "b": F.size(T.words(F.col("c"))), "rt": T.tokens(F.col("r")), "ct": T.tokens(T.within_budget(F.col("c"), F.col("r")))})
    penalty = W.length_penalty(F.col("a"), F.col("b"), "ratio", 1.5)
    score = W.profile_score({"m": X.overlap_ref_set(F.col("rt"), F.col("ct"))}, {"m": 1.0}, penalty)
    s = p.select(*ID, F.round(W.membership_weight(score, F.coalesce("w", F.lit(1.0))), 6).alias("score"))
    return s.groupBy("ex_id").agg(F.count("*").alias("n"), F.max("score").alias("reward"), F.min_by("cand_idx", F.struct(-F.col("score"), "cand_idx")).alias("best_idx"))


@query(f"WITH {B.EV} SELECT extra_info.id AS ex_id, prompt[1].content AS problem, regexp_replace(responses[1], '(?i)^\\s*Solution:\\s*', '') AS solution, TRUE AS is_member FROM ev")
def mapped_fields(spark, d):
    """Fields under the names that later steps expect: question, attempt without its label, membership."""
    first = lambda c: F.try_element_at(c, F.lit(1))
    return B.evaluations(spark, d).select(F.col("extra_info.id").alias("ex_id"), first("prompt")["content"].alias("problem"), F.regexp_replace(first("responses"), r"(?i)^\s*Solution:\s*", "").alias("solution"), F.lit(True).alias("is_member"))


@query("""WITH r AS (SELECT lower(trim(data_source)) LIKE 'aime%' AS is_member, CASE WHEN isnan(reward_score) OR isinf(reward_score) OR reward_score IS NULL THEN 0.0 ELSE reward_score END AS s FROM rollouts WHERE data_source IS NOT NULL)
SELECT is_member, count(*) AS n, round(avg(-s), 6) AS mean, max(-s) AS hi FROM r GROUP BY is_member""")
def paired_score_files(spark, d):
    """Two tables of scores as one, what isn't finite as 0, the sign turned."""
    r = read(spark, d, "rollouts").where("data_source is not null").select(F.lower(F.trim("data_source")).startswith("aime").alias("m"), F.col("reward_score").alias("score"))
    both = R.paired_scores(r.where("m"), r.where("not m"))
    return both.groupBy("is_member").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.max("score").alias("hi"))


TK = f"WITH {B.TOKENS}"


@query(TK + """, p AS (SELECT seq, list(pos ORDER BY pos)::BIGINT[] AS x FROM tk GROUP BY seq), z AS (SELECT seq, x, list_transform(range(greatest(0, 4 - len(x))), lambda i: 0::BIGINT) AS pad FROM p)
SELECT seq, CASE WHEN len(x) > 4 THEN x[len(x) - 3:] ELSE list_concat(pad, x) END AS left_left, CASE WHEN len(x) > 4 THEN x[1:4] ELSE list_concat(x, pad) END AS right_right, CASE WHEN len(x) > 4 THEN list_concat(x[1:2], x[len(x) - 1:]) ELSE list_concat(pad, x) END AS left_middle FROM z""")
def fitted_sequences(spark, d):
    """Sequences of four elements: filled up on either side, cut on the left, the right and in the middle."""
    p = B.token_rows(spark, d).groupBy("seq").agg(F.sort_array(F.collect_list(F.col("pos").cast("long"))).alias("x"))
    zero = F.lit(0).cast("long")
    return p.select("seq", RC.fitted(F.col("x"), 4, zero, True, "left").alias("left_left"), RC.fitted(F.col("x"), 4, zero, False, "right").alias("right_right"), RC.fitted(F.col("x"), 4, zero, True, "middle").alias("left_middle"))


@query(f"""WITH {B.ROLL}, ro AS (SELECT * FROM roll WHERE uid IS NOT NULL AND request_id IS NOT NULL), g AS (SELECT uid, round(avg(r), 9) BETWEEN 0.2 AND 0.8 AND coalesce(max(len) < max(max_response_len) - 1, TRUE) AS passed FROM ro GROUP BY uid),
o AS (SELECT request_id, uid, passed, row_number() OVER (ORDER BY passed DESC, uid, request_id) AS rn, count(*) OVER () AS n FROM ro JOIN g USING (uid)) SELECT request_id, uid, passed FROM o WHERE rn <= n // 3""")
def filtered_oversampled_groups(spark, d):
    """Groups within the accuracy band of which no answer was cut first, then the others, a third of the rows in all."""
    r = B.rollouts(spark, d).where("uid is not null and request_id is not null").select("request_id", "uid", "r", "len", "max_response_len")
    g = r.groupBy("uid").agg((F.round(F.avg("r"), 9).between(0.2, 0.8) & F.coalesce(F.max("len") < F.max("max_response_len") - 1, F.lit(True))).alias("passed"))
    ranked = positions(r.join(g, "uid").select("request_id", "uid", "passed"), [F.desc("passed"), F.asc("uid"), F.asc("request_id")], "rank")
    return ranked.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("n")))).where("rank < n div 3").select("request_id", "uid", "passed")


@query(f"""WITH {B.EV}, p AS (SELECT coalesce(lower(trim(data_source)), '') AS source, extra_info.id AS ex_id, len(unnest(responses))::DOUBLE AS v FROM ev), e AS (SELECT source, ex_id, count(*) AS n, avg(v) AS m, stddev_pop(v) AS s FROM p WHERE v IS NOT NULL GROUP BY source, ex_id)
SELECT source, n, count(*) AS n_prompts, round(avg(m), 4) AS mean, round(avg(CASE WHEN n > 1 THEN s END), 4) AS std FROM e GROUP BY source, n""")
def metrics_over_prompts(spark, d):
    """Mean and deviation over the answers of each prompt, then over the prompts of a source with as many answers."""
    p = B.evaluations(spark, d).select(F.coalesce(F.lower(F.trim("data_source")), F.lit("")).alias("source"), F.col("extra_info.id").alias("ex_id"), F.explode("responses").alias("t")).where("t is not null")
    e = p.groupBy("source", "ex_id").agg(F.count("*").alias("n"), F.avg(F.length("t").cast("double")).alias("m"), F.stddev_pop(F.length("t").cast("double")).alias("s"))
    return e.groupBy("source", "n").agg(F.count("*").alias("n_prompts"), F.round(F.avg("m"), 4).alias("mean"), F.round(F.avg(F.when(F.col("n") > 1, F.col("s"))), 4).alias("std"))


@query("""WITH h AS (SELECT extra_info.is_member AS m, extra_info.mia_weight AS w FROM heldout WHERE extra_info.mia_weight IS NOT NULL) SELECT count(*) FILTER (m) AS n_members, count(*) FILTER (NOT m) AS n_nonmembers, round(coalesce(avg(w) FILTER (m), 0), 4) AS member_mean, round(coalesce(avg(w) FILTER (NOT m), 0), 4) AS nonmember_mean, round(abs(coalesce(avg(w) FILTER (m), 0) - coalesce(avg(w) FILTER (NOT m), 0)), 4) AS difference FROM h""")
def weight_legend(spark, d):
    """Means of the members' and non-members' weights and how far they lie apart."""
    h = read(spark, d, "heldout").select(F.col("extra_info.is_member").alias("m"), F.col("extra_info.mia_weight").alias("w")).where("w is not null")
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("w"))), F.lit(0.0))
    m = F.col("m")
    return h.agg(F.count(F.when(m, 1)).alias("n_members"), F.count(F.when(~m, 1)).alias("n_nonmembers"), F.round(mean(m), 4).alias("member_mean"), F.round(mean(~m), 4).alias("nonmember_mean"), F.round(F.abs(mean(m) - mean(~m)), 4).alias("difference"))


@query("""WITH h AS (SELECT item_id, coalesce(extra_info.is_member, TRUE) AS m FROM heldout), k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY md5(concat('13-', item_id)), item_id) AS rn FROM h), n AS (SELECT least(count(*) FILTER (m), count(*) FILTER (NOT m)) AS n FROM h)
SELECT item_id, m AS is_member FROM k, n WHERE rn <= n""")
def unused_against_members(spark, d):
    """As many rows that weren't used as were used, drawn by hash; where too few are left, as many of the used ones."""
    h = read(spark, d, "heldout").select("item_id", F.coalesce("extra_info.is_member", F.lit(True)).alias("m"), F.md5(F.concat_ws("-", F.lit("13"), "item_id")).alias("h"))
    n = h.groupBy("m").agg(F.count("*").alias("n")).agg(F.when(F.count("*") == 2, F.min("n")).otherwise(0).alias("n"))
    ranked = materialise(positions(h, [F.asc("m"), F.asc("h"), F.asc("item_id")], "at"))
    first = ranked.groupBy("m").agg(F.min("at").alias("first")).withColumnRenamed("m", "m2")
    return ranked.join(F.broadcast(first), F.col("m") == F.col("m2")).crossJoin(F.broadcast(n)).where("at - first < n").select("item_id", F.col("m").alias("is_member"))


TURNS = """WITH t AS (SELECT request_id, unnest(list_transform(messages, lambda m: lower(trim(m.role)))) AS role, unnest(range(len(messages)))::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM rollouts WHERE request_id IS NOT NULL AND messages IS NOT NULL) WHERE rn = 1),
r AS (SELECT *, CASE WHEN role = 'tool' AND lag(role) OVER w = 'tool' THEN 0 ELSE 1 END AS starts FROM t WINDOW w AS (PARTITION BY request_id ORDER BY pos)),
s AS (SELECT request_id, pos, role, sum(starts) OVER (PARTITION BY request_id ORDER BY pos) AS piece FROM r)
SELECT request_id, piece::BIGINT AS piece, min(pos) AS pos, any_value(role) AS role, count(*) AS n_turns, bool_or(role IN ('assistant', 'gpt')) AS in_loss, bool_and(coalesce(role, '') IN ('user', 'human', 'assistant', 'gpt', 'tool') OR (role = 'system' AND pos = 0)) AS is_valid FROM s GROUP BY request_id, piece"""


@query(TURNS)
def turn_pieces(spark, d):
    """Turns as the pieces a chat template takes: runs of tool turns as one, answers in the loss, a system turn only at the start."""
    w = Window.partitionBy("request_id").orderBy(F.desc_nulls_last("loaded_at"))
    t = read(spark, d, "rollouts").where("request_id is not null and messages is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    t = t.select("request_id", F.posexplode("messages").alias("pos", "m")).select("request_id", "pos", F.lower(F.trim("m.role")).alias("role"))
    run = Window.partitionBy("request_id").orderBy("pos")
    starts = F.when((F.col("role") == "tool") & (F.lag("role").over(run) == "tool"), 0).otherwise(1)
    s = t.withColumn("starts", starts).withColumn("piece", F.sum("starts").over(run))
    valid = F.coalesce(F.col("role").isin("user", "human", "assistant", "gpt", "tool") | ((F.col("role") == "system") & (F.col("pos") == 0)), F.lit(False))
    return s.groupBy("request_id", "piece").agg(F.min("pos").alias("pos"), F.first("role").alias("role"), F.count("*").alias("n_turns"), F.max(F.coalesce(F.col("role").isin("assistant", "gpt"), F.lit(False))).alias("in_loss"), F.min(valid).alias("is_valid"))
