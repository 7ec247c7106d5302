"""Rows by index, padding, column unions, minibatches, weights by order, previews and record shapes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import records as RC
from tracelake.functions import text as T
from tracelake.operators import batches as O
from tracelake.plans import base as B
from tracelake.plans.registry import query
from tracelake.session import materialise, read

INDICES = (0, 5, 17, 42, 63)


@query(f"SELECT index, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents) WHERE index IN {INDICES}")
def rows_by_index(spark, d):
    asked = spark.createDataFrame([(i,) for i in INDICES], "index bigint")
    return O.select_rows(read(spark, d, "documents").select("doc_id"), [F.asc("doc_id")], asked).select("index", "doc_id")


@query("""WITH h AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS p, count(*) OVER () AS n FROM heldout)
SELECT item_id, p AS position, FALSE AS is_padding FROM h UNION ALL SELECT item_id, n + p + k * n, TRUE FROM h, (SELECT unnest(range(7)) AS k) WHERE p + k * n < (7 - n % 7) % 7""")
def padded_to_divisor(spark, d):
    return O.pad_to_divisor(read(spark, d, "heldout").select("item_id"), [F.asc("item_id")], 7).select("item_id", "position", "is_padding")


@query("SELECT item_id, ability, data_source, reward_model.style AS style FROM heldout")
def column_union(spark, d):
    h = read(spark, d, "heldout")
    return O.column_union(h.select("item_id", "ability", "data_source"), h.select("item_id", F.col("reward_model.style").alias("style"), "ability"), ["item_id"])


@query("""WITH e AS (SELECT item_id, epoch::INT AS epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5(concat('7-', epoch, '-', item_id)), item_id) - 1 AS p FROM heldout, (SELECT unnest(range(2)) AS epoch))
SELECT item_id, epoch, p // 8 AS batch, p % 8 AS place FROM e""")
def minibatch_epochs(spark, d):
    return O.minibatches(read(spark, d, "heldout").select("item_id"), "item_id", 8, 2, seed=7).select("item_id", "epoch", "batch", "place")


_H = "SELECT item_id, extra_info.is_member AS is_member, coalesce(extra_info.mia_weight, 0) AS w FROM heldout WHERE extra_info.is_member IS NOT NULL"


@query(f"""WITH h AS ({_H}), r AS (SELECT item_id, is_member, row_number() OVER (PARTITION BY is_member ORDER BY item_id) - 1 AS idx FROM h), v AS (SELECT w, is_member, row_number() OVER (PARTITION BY is_member ORDER BY w DESC, item_id) - 1 AS idx FROM h)
SELECT item_id, is_member, idx, w AS weight FROM r JOIN v USING (is_member, idx)""")
def weights_by_order(spark, d):
    """Weights of a second table attached by membership and index; the held-out table is fixed, 240 rows."""
    h = read(spark, d, "heldout").select("item_id", F.col("extra_info.is_member").alias("is_member"), F.coalesce("extra_info.mia_weight", F.lit(0.0)).alias("weight")).where("is_member is not null")
    at = lambda *o: F.row_number().over(Window.partitionBy("is_member").orderBy(*o)).cast("long") - 1
    rows = h.select("item_id", "is_member", at("item_id").alias("idx"))
    weights = h.select("is_member", at(F.desc("weight"), "item_id").alias("idx"), "weight")
    return O.attach_by_index(rows, weights, "is_member")


@query("""WITH h AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS p, count(*) OVER () // 4 AS each FROM heldout) SELECT p // each AS part, list_sum(list(item_id ORDER BY p))::BIGINT AS total, count(*) AS n, min(item_id) AS first FROM h GROUP BY 1""")
def folded_batch(spark, d):
    f = O.folded(read(spark, d, "heldout").select("item_id"), [F.asc("item_id")], 4)
    return f.groupBy("part").agg(F.sum("item_id").alias("total"), F.count("*").alias("n"), F.min("item_id").alias("first"))


_PREVIEW = (("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double"))


def _preview_sql():
    num = lambda f, c, k: f"{f}({c})::DOUBLE" if k != "string" else "NULL::DOUBLE"
    return " UNION ALL ".join(f"SELECT '{c}' AS column, '{k}' AS dtype, count(*) AS n, count(*) FILTER ({c} IS NULL) AS n_null, round({num('avg', c, k)}, 6) AS mean, {num('min', c, k)} AS lo, {num('max', c, k)} AS hi FROM part" for c, k in _PREVIEW)


@query(_preview_sql())
def table_preview(spark, d):
    return O.preview(read(spark, d, "part").select(*[c for c, _ in _PREVIEW]))


@query(f"""WITH w AS (SELECT doc_id, len({B.sql_words('text')}) AS n FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, n, unnest(range(0, n, 32)) AS start FROM w)
SELECT doc_id, start::INT AS start, greatest(start + 32 - 64, 0)::INT AS begin_at, least(start + 32, n)::INT AS end_at, (least(start + 32, n) - start)::INT AS n_scored FROM s""")
def scoring_windows(spark, d):
    """Windows of at most 64 tokens with stride 32: where each begins and ends, and how many tokens are scored in it for the first time."""
    n = read(spark, d, "documents").where("text is not null").select("doc_id", F.size(T.words(F.col("text"))).alias("n")).where("n > 0")
    return n.select("doc_id", F.explode(RC.scoring_windows(F.col("n"), 64)).alias("w")).select("doc_id", "w.*")


@query("SELECT item_id, list_transform(list_filter(string_split_regex(regexp_replace('See <image> here: ' || prompt[1].content || '<video><image>', '(<image>|<video>)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''), lambda s: CASE s WHEN '<image>' THEN 'image' WHEN '<video>' THEN 'video' ELSE 'text:' || s END) AS parts FROM heldout WHERE len(prompt) > 0 AND prompt[1].content IS NOT NULL")
def media_parts(spark, d):
    h = read(spark, d, "heldout").select("item_id", F.try_element_at("prompt", F.lit(1))["content"].alias("c")).where("c is not null")
    parts = RC.media_parts(F.concat(F.lit("See <image> here: "), F.col("c"), F.lit("<video><image>")))
    return h.select("item_id", F.transform(parts, lambda p: F.when(p["type"] == "text", F.concat(F.lit("text:"), p["text"])).otherwise(p["type"])).alias("parts"))


@query("""WITH h AS (SELECT item_id, prompt[1].content AS q, reward_model.ground_truth AS a FROM heldout WHERE reward_model.ground_truth IS NOT NULL AND prompt[1].content IS NOT NULL),
o AS (SELECT item_id, q, left(a, 20) AS gold, ['1', '2', '3'] AS wrong, (item_id % 4)::INT AS k FROM h), c AS (SELECT item_id, q, k, list_concat(list_concat(list_slice(wrong, 1, k), [gold]), list_slice(wrong, k + 1, 3)) AS c FROM o)
SELECT item_id, substr('ABCD', k + 1, 1) AS gold_letter, q || chr(10) || chr(10) || 'A) ' || c[1] || chr(10) || 'B) ' || c[2] || chr(10) || 'C) ' || c[3] || chr(10) || 'D) ' || c[4] AS question FROM c""")
def exam_questions(spark, d):
    """Questions with four options; the right one stands at a place that the key decides."""
    h = read(spark, d, "heldout").select("item_id", F.try_element_at("prompt", F.lit(1))["content"].alias("q"), F.col("reward_model.ground_truth").alias("a")).where("a is not null and q is not null")
    at = (F.col("item_id") % 4).cast("int")
    options = RC.options_with(F.array(F.lit("1"), F.lit("2"), F.lit("3")), F.substring("a", 1, 20), at)
    return h.select("item_id", F.substring(F.lit("ABCD"), at + 1, F.lit(1)).alias("gold_letter"), RC.exam_question(F.col("q"), options).alias("question"))


@query(f"""WITH {B.EV} SELECT extra_info.id AS ex_id, NOT extra_info.is_member AS is_member, extra_info.nonmember_ground_truth AS member_ground_truth, extra_info.member_ground_truth AS nonmember_ground_truth, extra_info.nonmember_mia_weight AS member_mia_weight, extra_info.member_mia_weight AS nonmember_mia_weight FROM ev""")
def swapped_truths(spark, d):
    """Membership turned round, with the paired truths and weights changing places."""
    x = RC.swapped(F.col("extra_info"), ("member_ground_truth", "nonmember_ground_truth"), ("member_mia_weight", "nonmember_mia_weight"))
    e = B.evaluations(spark, d).select(F.col("extra_info.id").alias("ex_id"), (~F.col("extra_info.is_member")).alias("is_member"), x.alias("x"))
    return e.select("ex_id", "is_member", *[f"x.{c}" for c in ("member_ground_truth", "nonmember_ground_truth", "member_mia_weight", "nonmember_mia_weight")])


@query("SELECT doc_id, text AS content, lang AS language FROM documents")
def renamed_columns(spark, d):
    """Columns dropped, renamed and popped; a name that isn't there is an error."""
    return RC.reshaped(read(spark, d, "documents"), keep=["doc_id", "text", "lang"], rename={"text": "content", "lang": "language"})


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def inferred_text(spark, d):
    """The text column by priority of names."""
    df = read(spark, d, "documents")
    return df.select("doc_id", F.col(RC.text_column(df)).alias("text")).where("text is not null")


@query(f"""WITH h AS (SELECT item_id, list_sort(list_transform(list_filter({B.sql_words('reward_model.ground_truth')}, lambda w: TRUE), lambda w: w)) AS x, {B.sql_words('reward_model.ground_truth')} AS w FROM heldout WHERE reward_model.ground_truth IS NOT NULL)
SELECT item_id, '' AS blank_prompt, array_to_string(w[1:greatest(1, floor(len(w) * 0.3)::INT)], ' ') AS assistant_prefix, len(w)::INT AS n_words FROM h""")
def blank_and_prefix_prompts(spark, d):
    """Prompts for matching runs: an empty one, and the start of the truth as the assistant's own words."""
    h = read(spark, d, "heldout").select("item_id", F.col("reward_model.ground_truth").alias("t")).where("t is not null")
    return h.select("item_id", F.lit("").alias("blank_prompt"), T.prefix_of(F.col("t"), 0.3).alias("assistant_prefix"), F.size(T.words(F.col("t"))).alias("n_words"))


@query("SELECT item_id, key, value FROM (SELECT item_id, unnest(['prompt/list_len', 'prompt/0/role', 'reward_model/style']) AS key, unnest([len(prompt)::VARCHAR, prompt[1].role, reward_model.style]) AS value FROM heldout)")
def flattened_with_lists(spark, d):
    """Nested records as path and value; lists get a key for their length and one per element."""
    flat = RC.flattened(read(spark, d, "heldout").select("item_id", F.slice("prompt", 1, 1).alias("first"), "prompt", "reward_model"), "item_id", {"prompt": 1, "reward_model": 0})
    return flat.where(F.col("key").isin("prompt/list_len", "prompt/0/role", "reward_model/style"))


@query("""WITH t AS (SELECT request_id, unnest(list_transform(messages, lambda m: coalesce(len(string_split(m.content, ' ')), 0))) AS n, unnest(list_transform(messages, lambda m: m.role)) AS role, unnest(range(len(messages))) AS i FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM rollouts WHERE request_id IS NOT NULL AND messages IS NOT NULL) WHERE rn = 1)
SELECT request_id, i::INT AS turn, sum(n) OVER w - n AS start_at, sum(n) OVER w AS end_at, sum(CASE WHEN role IN ('assistant', 'gpt') THEN n ELSE 0 END) OVER w AS n_trained FROM t WINDOW w AS (PARTITION BY request_id ORDER BY i)""")
def conversation_buffers(spark, d):
    """Buffers that grow by turn: where each turn starts and ends in tokens, and how many trained tokens there are so far."""
    w = Window.partitionBy("request_id").orderBy(F.desc_nulls_last("loaded_at"))
    t = read(spark, d, "rollouts").where("request_id is not null and messages is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    t = t.select("request_id", F.posexplode("messages").alias("turn", "m")).select("request_id", "turn", F.col("m.role").alias("role"), F.coalesce(F.size(F.split("m.content", " ")), F.lit(0)).cast("long").alias("n"))
    t = t.withColumn("n", F.when(F.col("n") < 0, 0).otherwise(F.col("n")))
    run = Window.partitionBy("request_id").orderBy("turn")
    return t.select("request_id", "turn", (F.sum("n").over(run) - F.col("n")).alias("start_at"), F.sum("n").over(run).alias("end_at"), F.sum(F.when(F.col("role").isin("assistant", "gpt"), F.col("n")).otherwise(0)).over(run).alias("n_trained"))


@query("""WITH m AS (SELECT row_number() OVER (ORDER BY original_idx) AS k, original_idx FROM (SELECT DISTINCT original_idx FROM mixed_corpus WHERE original_idx IS NOT NULL AND is_contamination))
SELECT original_idx, rep::INT AS rep FROM m, (SELECT unnest(range(5)) AS rep) WHERE rep < 1 + original_idx % 3""")
def repeated_by_count(spark, d):
    """Every row as often as its own count says."""
    m = read(spark, d, "mixed_corpus").where("original_idx is not null and is_contamination").select("original_idx").distinct()
    return RC.repeated(m, (1 + F.col("original_idx") % 3).cast("int"), "rep")


@query("SELECT item_id + k * 0 AS item_id, k::INT AS tile FROM heldout, (SELECT unnest(range(3)) AS k)")
def tiled_rows(spark, d):
    """The whole table three times over, tile by tile."""
    return RC.repeated(read(spark, d, "heldout").select("item_id"), F.lit(3), "tile")


@query("""WITH m AS (SELECT original_idx, bool_or(is_contamination) AS c FROM mixed_corpus WHERE original_idx IS NOT NULL GROUP BY original_idx), n AS (SELECT count(*) FILTER (c) AS c, ceil(count(*) FILTER (c) * (100 - 40.0) / 40.0)::BIGINT AS take FROM m),
g AS (SELECT original_idx, row_number() OVER (ORDER BY md5(concat('11-', original_idx)), original_idx) AS rn FROM m WHERE NOT coalesce(c, FALSE)) SELECT original_idx, TRUE AS is_contamination FROM m WHERE c UNION ALL SELECT original_idx, FALSE FROM g, n WHERE rn <= take""")
def mixed_to_percentage(spark, d):
    """Contaminated rows, and as many general ones drawn by hash that the former make up 40 percent."""
    from tracelake.operators.scaling import positions

    m = materialise(read(spark, d, "mixed_corpus").where("original_idx is not null").groupBy("original_idx").agg(F.max("is_contamination").alias("c")))
    n = m.agg(F.count(F.when(F.col("c"), 1)).alias("c")).first()["c"]
    take = -(-n * 60 // 40)
    general = m.where(~F.coalesce("c", F.lit(False))).withColumn("h", F.md5(F.concat_ws("-", F.lit("11"), "original_idx")))
    drawn = positions(general, [F.asc("h"), F.asc("original_idx")], "rank").where(F.col("rank") < take)
    return m.where("c").select("original_idx", F.lit(True).alias("is_contamination")).unionByName(drawn.select("original_idx", F.lit(False).alias("is_contamination")))


@query(f"""WITH w AS (SELECT conversation_hash, list_filter(conversation, lambda m: m.content IS NOT NULL) AS c, language, coalesce(model, '') AS model, row_number() OVER (PARTITION BY conversation_hash ORDER BY loaded_at DESC NULLS LAST) AS rn FROM wildchat WHERE conversation IS NOT NULL AND conversation_hash IS NOT NULL),
l AS (SELECT conversation_hash, model, len(c) AS n, len({B.sql_words('c[1].content')}) AS u, len({B.sql_words('c[2].content')}) AS a FROM w WHERE rn = 1) SELECT conversation_hash, u::INT AS n_user, a::INT AS n_answer FROM l WHERE n = 2 AND u BETWEEN 5 AND 200 AND a BETWEEN 10 AND 400""")
def two_message_lengths(spark, d):
    """Conversations of exactly two messages whose lengths lie within their ranges."""
    w = Window.partitionBy("conversation_hash").orderBy(F.desc_nulls_last("loaded_at"))
    c = read(spark, d, "wildchat").where("conversation is not null and conversation_hash is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("conversation_hash", F.filter("conversation", lambda m: m["content"].isNotNull()).alias("c"))
    n = lambda i: F.size(T.words(F.get("c", i)["content"]))
    return c.select("conversation_hash", F.size("c").alias("n_messages"), n(0).alias("n_user"), n(1).alias("n_answer")).where("n_messages = 2").where("n_user between 5 and 200 and n_answer between 10 and 400").drop("n_messages")


@query(f"""WITH p AS (SELECT doc_id, text, len({B.sql_words('text')}) AS n, abs(coalesce(n_chars, 0) - length(text)) AS diff FROM documents WHERE text IS NOT NULL AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '') SELECT doc_id, n::INT AS n, diff::BIGINT AS diff FROM p WHERE diff > 0 AND n BETWEEN 3 AND 2000""")
def stale_length_filter(spark, d):
    """Non-empty texts whose stored length is off by more than a threshold, within a range of words."""
    p = read(spark, d, "documents").where("text is not null").where(F.btrim("text", F.lit(" \t\n\r")) != "")
    p = p.select("doc_id", F.size(T.words(F.col("text"))).alias("n"), F.abs(F.coalesce("n_chars", F.lit(0)) - F.length("text")).alias("diff"))
    return p.where("diff > 0 and n between 3 and 2000")


@query("SELECT doc_id, strftime(created_at, '%Y-%m-%d') AS day FROM documents WHERE strftime(created_at, '%Y-%m-%d') >= '2024-03-01' AND strftime(created_at, '%Y-%m-%d') < '2024-05-15'")
def date_range(spark, d):
    """Rows whose date, as text, lies in a half-open range; the filter on the timestamp reaches the scan."""
    r = read(spark, d, "documents").where("created_at >= timestamp_ntz'2024-03-01' and created_at < timestamp_ntz'2024-05-15'")
    return r.select("doc_id", F.date_format(F.col("created_at").cast("timestamp"), "yyyy-MM-dd").alias("day"))


@query("SELECT doc_id, coalesce(TRY_CAST(json_extract_string(CASE WHEN json_valid(meta) THEN meta END, '$.year') AS INT), 1900) AS year, coalesce(json_extract_string(CASE WHEN json_valid(meta) THEN meta END, '$.env.device'), 'none') AS device FROM documents WHERE meta IS NULL OR json_valid(meta)")
def config_lookup(spark, d):
    """Values of JSON settings by dotted path, with defaults."""
    m = read(spark, d, "documents").where(F.col("meta").isNull() | F.get_json_object("meta", "$").isNotNull())
    return m.select("doc_id", RC.setting(F.col("meta"), "year", "1900").cast("int").alias("year"), RC.setting(F.col("meta"), "env.device", "none").alias("device"))
