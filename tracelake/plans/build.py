"""Building datasets: text functions, filters with reasons, joins, sampling, set operations and record shapes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.plans import base as B
from tracelake.plans.registry import query
from tracelake.session import read

W = B.sql_words


def _docs(spark, d, *columns):
    return read(spark, d, "documents").where("text is not null").select("doc_id", *columns, "text")


@query(f"SELECT doc_id, len({B.sql_tokens('text')})::INT AS n_tokens, len(list_distinct({B.sql_tokens('text')}))::INT AS n_distinct FROM documents WHERE text IS NOT NULL")
def tokens_per_document(spark, d):
    t = T.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


def _script_sql(ranges):
    return B.sql_tokens(f"regexp_replace(text, '([{ranges}])', ' \\1 ', 'g')")


@query(f"SELECT doc_id, len({_script_sql(T.UNSPACED)})::INT AS n_reward, len({_script_sql(T.UNSPACED_NGRAM)})::INT AS n_ngram FROM documents WHERE text IS NOT NULL")
def script_aware_tokens(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.size(T.script_tokens(t)).alias("n_reward"), F.size(T.script_tokens(t, T.UNSPACED_NGRAM)).alias("n_ngram"))


@query(f"SELECT doc_id, len(regexp_extract_all(lower(text), '({T.MATH_TOKEN})', 1))::INT AS n_math, len(regexp_extract_all(lower(text), '([a-z0-9]+)', 1))::INT AS n_alnum FROM documents WHERE text IS NOT NULL")
def regex_tokens(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.size(T.math_tokens(t)).alias("n_math"), F.size(T.alnum_tokens(t)).alias("n_alnum"))


@query(f"""WITH w AS (SELECT doc_id, {W('text')} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string(list_slice(w, 1, greatest(1, floor(len(w) * 0.25)::INT)), ' ') AS prefix, array_to_string(list_slice(w, greatest(1, floor(len(w) * 0.25)::INT) + 1, len(w)), ' ') AS suffix FROM w""")
def prefix_suffix_split(spark, d):
    return _docs(spark, d).select("doc_id", T.prefix_of(F.col("text"), 0.25).alias("prefix"), T.suffix_of(F.col("text"), 0.25).alias("suffix"))


@query(f"""WITH w AS (SELECT doc_id, {W('text')} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN len(w) = 0 THEN '' ELSE array_to_string(list_slice(w, floor(len(w) * 0.25)::INT + 1, len(w)), ' ') END AS evaluator, CASE WHEN len(w) = 0 THEN ' ' ELSE array_to_string(list_slice(w, floor(len(w) * 0.25)::INT + 1, len(w)), ' ') END AS reward FROM w""")
def prefix_removal(spark, d):
    return _docs(spark, d).select("doc_id", T.without_prefix(F.col("text"), 0.25).alias("evaluator"), T.without_prefix(F.col("text"), 0.25, " ").alias("reward"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '(?s)\n\x7E[^\n]+.*$', ''), ' ')) AS first_solution, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\n{3,}', E'\n\n', 'g'), ' {2,}', ' ', 'g'), ' ')) AS no_images FROM documents WHERE text IS NOT NULL""")
def text_cleaning(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.md5(T.first_solution(t)).alias("first_solution"), F.md5(T.without_image_links(t)).alias("no_images"))


def _paper_sql(c):
    t = f"regexp_replace(regexp_replace({c}, E'\\r\\n?', E'\\n', 'g'), '(?s)<!--.*?-->', '', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '(?m)^\\s*%.*$', '', 'g'), '{T.MACRO}', '', 'g')"
    t = f"nullif(regexp_extract({t}, '{T.INTRODUCTION}[\\s\\S]*', 0), '')"
    return f"nullif(trim(regexp_replace({t}, '{T.REFERENCES}[\\s\\S]*', ''), E' \\t\\n\\r\\f'), '')"


_FRAME = ("# Title\n% a comment\n\\newcommand{\\x}{y}\n## 1. Introduction\n", "\n<!-- hidden -->\n# References\n[1] Someone.")


@query(f"""WITH d AS (SELECT doc_id, text, '{_FRAME[0]}' || text || '{_FRAME[1]}' AS framed FROM documents WHERE text IS NOT NULL) SELECT doc_id, {_paper_sql('text')} AS as_is, md5({_paper_sql('framed')}) AS framed FROM d""")
def paper_cleaning(spark, d):
    """Papers cut to their body: the texts as they are, of which few have the headings, and with headings around them."""
    framed = F.concat(F.lit(_FRAME[0]), F.col("text"), F.lit(_FRAME[1]))
    return _docs(spark, d).select("doc_id", T.clean_paper(F.col("text")).alias("as_is"), F.md5(T.clean_paper(framed)).alias("framed"))


@query(r"""SELECT doc_id, CASE WHEN regexp_extract(text, '(?is)solution\s*\.\s*(.*)$', 1) <> '' THEN length(regexp_extract(text, '(?is)solution\s*\.\s*(.*)$', 1)) ELSE length(text) END AS n_out FROM documents WHERE text IS NOT NULL""")
def output_extraction(spark, d):
    own = F.regexp_extract("text", r"(?is)solution\s*\.\s*(.*)$", 1)
    return _docs(spark, d).select("doc_id", F.when(own != "", F.length(own)).otherwise(F.length("text")).cast("long").alias("n_out"))


@query(r"""SELECT doc_id, TRY_CAST(json_extract_string(CASE WHEN json_valid(meta) THEN meta ELSE '{}' END, '$.year') AS INT) AS year, coalesce(json_extract_string(CASE WHEN json_valid(meta) THEN meta ELSE '{}' END, '$.ver'), '') AS ver FROM documents""")
def meta_parsing(spark, d):
    """Fields of a JSON column; missing or broken JSON counts as empty."""
    m = F.from_json("meta", "year int, ver string")
    return read(spark, d, "documents").select("doc_id", m["year"].alias("year"), F.coalesce(m["ver"], F.lit("")).alias("ver"))


@query(r"""WITH y AS (SELECT doc_id, TRY_CAST(regexp_extract(meta, '"year": ([0-9]{4})', 1) AS INT) AS year FROM documents) SELECT doc_id, year FROM y WHERE year IN (2018, 2019, 2020)""")
def year_filter(spark, d):
    y = F.regexp_extract("meta", r'"year": ([0-9]{4})', 1).try_cast("int")
    return read(spark, d, "documents").select("doc_id", y.alias("year")).where(F.col("year").isin(2018, 2019, 2020))


@query("SELECT doc_id, source FROM documents WHERE source IN ('aime', 'olympiads', 's1')")
def source_include(spark, d):
    return read(spark, d, "documents").where(F.col("source").isin("aime", "olympiads", "s1")).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE coalesce(source NOT IN ('wildchat', 'arxiv'), true)")
def source_exclude(spark, d):
    """Null sources stay."""
    return read(spark, d, "documents").where(F.coalesce(~F.col("source").isin("wildchat", "arxiv"), F.lit(True))).select("doc_id", "source")


# Problem and solution of every document that has both.
PS = rf"""ps AS (SELECT doc_id, regexp_extract(text, '(?s)Problem\. (.*?)\n\nSolution\.', 1) AS problem, regexp_extract(text, '(?s)\n\nSolution\. (.*)$', 1) AS solution FROM documents WHERE text LIKE 'Problem.%')"""


def _problems(spark, d):
    p = _docs(spark, d).where(F.col("text").startswith("Problem."))
    return p.select("doc_id", F.regexp_extract("text", r"(?s)Problem\. (.*?)\n\nSolution\.", 1).alias("problem"), F.regexp_extract("text", r"(?s)\n\nSolution\. (.*)$", 1).alias("solution"))


REASON = f"""CASE WHEN a < 12 THEN 'problem_too_short' WHEN a > 60 THEN 'problem_too_long' WHEN b < 15 THEN 'solution_too_short' WHEN b > 400 THEN 'solution_too_long' ELSE 'kept' END"""


@query(f"WITH {PS}, n AS (SELECT doc_id, len({W('problem')}) AS a, len({W('solution')}) AS b FROM ps) SELECT doc_id, {REASON} AS reason FROM n")
def length_filter_reasons(spark, d):
    a, b = F.size(T.words(F.col("problem"))), F.size(T.words(F.col("solution")))
    r = F.when(a < 12, "problem_too_short").when(a > 60, "problem_too_long").when(b < 15, "solution_too_short").when(b > 400, "solution_too_long").otherwise("kept")
    return _problems(spark, d).select("doc_id", r.alias("reason"))


@query(f"WITH {PS}, n AS (SELECT doc_id, len({W('problem')}) AS a, len({W('solution')}) AS b FROM ps) SELECT {REASON} AS reason, count(*) AS n FROM n GROUP BY 1")
def reject_reason_counts(spark, d):
    return length_filter_reasons(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {PS} SELECT doc_id, 'user' AS role1, trim(problem) AS content1, 'assistant' AS role2, trim(solution) AS content2 FROM ps")
def problem_to_messages(spark, d):
    m = lambda role, c: F.struct(F.lit(role).alias("role"), F.trim(c).alias("content"))
    t = _problems(spark, d).select("doc_id", F.array(m("user", "problem"), m("assistant", "solution")).alias("messages"))
    return t.select("doc_id", *[F.col("messages")[i][k].alias(f"{k}{i + 1}") for i in range(2) for k in ("role", "content")])


WC = """wc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conversation_hash ORDER BY loaded_at DESC NULLS LAST) AS rn FROM wildchat) WHERE rn = 1)"""


def _wildchat(spark, d):
    w = Window.partitionBy("conversation_hash").orderBy(F.desc_nulls_last("loaded_at"))
    return read(spark, d, "wildchat").withColumn("rn", F.row_number().over(w)).where("rn = 1")


def _last_sql(*roles):
    return f"list_filter(conversation, lambda m: m.role IN ({', '.join(repr(r) for r in roles)}))[-1].content"


@query(f"WITH {WC} SELECT conversation_hash, {_last_sql('user', 'human')} AS problem, {_last_sql('assistant', 'gpt')} AS solution FROM wc WHERE conversation IS NOT NULL")
def last_user_assistant(spark, d):
    c = F.col("conversation")
    return _wildchat(spark, d).where("conversation is not null").select("conversation_hash", T.last_content(c, "user", "human").alias("problem"), T.last_content(c, "assistant", "gpt").alias("solution"))


SPOKEN = "list_filter(conversation, lambda m: m.role IN ('user', 'assistant') AND length(trim(coalesce(m.content, ''), ' ')) > 0)"


@query(f"WITH {WC} SELECT conversation_hash, len({SPOKEN})::INT AS n_turns, md5(coalesce(array_to_string(list_transform({SPOKEN}, lambda m: upper(m.role[1]) || m.role[2:] || ': ' || m.content || chr(10)), ''), '')) AS chat FROM wc WHERE conversation IS NOT NULL")
def chat_template(spark, d):
    c = F.col("conversation")
    return _wildchat(spark, d).where("conversation is not null").select("conversation_hash", F.size(T.spoken_turns(c)).alias("n_turns"), F.md5(T.chat_text(c)).alias("chat"))


@query(f"WITH {WC} SELECT conversation_hash, len(from_json(messages, '[{{\"role\":\"VARCHAR\",\"content\":\"VARCHAR\"}}]'))::INT AS n FROM wc WHERE messages IS NOT NULL AND json_valid(messages)")
def messages_from_json(spark, d):
    m = F.from_json("messages", "array<struct<role:string,content:string>>")
    return _wildchat(spark, d).where("messages is not null").select("conversation_hash", F.size(m).alias("n")).where("n >= 0")


CONV = f"""CASE WHEN excluded THEN 'excluded' WHEN turn IS NULL OR turn <> 1 THEN 'multi_turn' WHEN language IS NULL OR language <> 'English' THEN 'language' WHEN model IS NULL OR model NOT LIKE '%large%' AND model NOT LIKE '%small%' THEN 'model'
 WHEN u IS NULL OR u < 8 THEN 'user_too_short' WHEN u > 200 THEN 'user_too_long' WHEN a IS NULL OR a < 10 THEN 'assistant_too_short' ELSE 'kept' END"""
CONVS = f"""{WC}, ex AS (SELECT DISTINCT conversation_hash FROM wildchat WHERE model LIKE 'heron%'),
n AS (SELECT wc.conversation_hash, turn, language, model, ex.conversation_hash IS NOT NULL AS excluded, len({W(_last_sql('user', 'human'))}) AS u, len({W(_last_sql('assistant', 'gpt'))}) AS a FROM wc LEFT JOIN ex ON wc.conversation_hash = ex.conversation_hash)"""


@query(f"WITH {CONVS} SELECT conversation_hash, {CONV} AS reason FROM n")
def conversation_filter_reasons(spark, d):
    """Exclusion list, single turn, language, model, then lengths; the first failed test is the reason."""
    ex = read(spark, d, "wildchat").where("model like 'heron%'").select("conversation_hash").distinct().withColumn("excluded", F.lit(True))
    c = F.col("conversation")
    n = _wildchat(spark, d).join(ex, "conversation_hash", "left").withColumns({"u": F.size(T.words(T.last_content(c, "user", "human"))), "a": F.size(T.words(T.last_content(c, "assistant", "gpt")))})
    bad = lambda x, t: F.col(x).isNull() | t
    r = (
        F.when(F.col("excluded"), "excluded").when(bad("turn", F.col("turn") != 1), "multi_turn").when(bad("language", F.col("language") != "English"), "language")
        .when(bad("model", ~F.col("model").contains("large") & ~F.col("model").contains("small")), "model").when(bad("u", F.col("u") < 8), "user_too_short").when(F.col("u") > 200, "user_too_long")
        .when(bad("a", F.col("a") < 10), "assistant_too_short").otherwise("kept")
    )
    return n.select("conversation_hash", r.alias("reason"))


@query(f"WITH {WC} SELECT conversation_hash FROM wc WHERE conversation_hash NOT IN (SELECT conversation_hash FROM wildchat WHERE model LIKE 'heron%' AND conversation_hash IS NOT NULL)")
def exclude_by_hash(spark, d):
    ex = read(spark, d, "wildchat").where("model like 'heron%'").select("conversation_hash")
    return read(spark, d, "wildchat").select("conversation_hash").distinct().join(ex, "conversation_hash", "left_anti")


@query(f"SELECT DISTINCT request_id, CASE WHEN len(list_filter(messages, lambda m: m.role = 'user')) = 1 AND len(messages) = 2 THEN 'pair' ELSE 'other' END AS shape FROM rollouts WHERE messages IS NOT NULL")
def two_message_filter(spark, d):
    m = F.col("messages")
    return read(spark, d, "rollouts").where("messages is not null").select("request_id", F.when((F.size(F.filter(m, lambda x: x["role"] == "user")) == 1) & (F.size(m) == 2), "pair").otherwise("other").alias("shape")).distinct()


@query(f"SELECT DISTINCT request_id, coalesce(list_sum(list_transform(list_filter(messages, lambda m: m.role <> 'assistant'), lambda m: len({W('m.content')}))) <= max_prompt_len, true) AS fits FROM rollouts")
def overlong_prompt_filter(spark, d):
    """Rows whose length can't be computed are kept."""
    n = F.aggregate(F.filter("messages", lambda m: m["role"] != "assistant"), F.lit(None).cast("int"), lambda s, m: F.coalesce(s + F.coalesce(F.size(T.words(m["content"])), F.lit(0)), F.size(T.words(m["content"])), s))
    return read(spark, d, "rollouts").select("request_id", F.coalesce(n <= F.col("max_prompt_len"), F.lit(True)).alias("fits")).distinct()


@query("SELECT lower(trim(replace(source, '-', '_'))) AS source, sum((coalesce(trim(text), '') = '')::INT)::BIGINT AS no_text, sum((messages IS NULL)::INT)::BIGINT AS no_messages, sum((original_id IS NULL)::INT)::BIGINT AS no_id FROM mixed_corpus GROUP BY 1")
def missing_fields(spark, d):
    n = lambda c: F.sum(c.cast("long"))
    return read(spark, d, "mixed_corpus").groupBy(F.lower(F.trim(F.replace("source", F.lit("-"), F.lit("_")))).alias("source")).agg(n(F.trim(F.coalesce("text", F.lit(""))) == "").alias("no_text"), n(F.col("messages").isNull()).alias("no_messages"), n(F.col("original_id").isNull()).alias("no_id"))


@query("SELECT lower(trim(replace(source, '-', '_'))) AS source, count(*) AS n, sum(coalesce(is_contamination, false)::INT)::BIGINT AS n_contamination, round(100.0 * sum(coalesce(is_contamination, false)::INT) / count(*), 4) AS pct FROM mixed_corpus GROUP BY 1")
def contamination_composition(spark, d):
    c = F.sum(F.coalesce("is_contamination", F.lit(False)).cast("long"))
    return read(spark, d, "mixed_corpus").groupBy(F.lower(F.trim(F.replace("source", F.lit("-"), F.lit("_")))).alias("source")).agg(F.count("*").alias("n"), c.alias("n_contamination"), F.round(100.0 * c / F.count("*"), 4).alias("pct"))


# Seeded sampling by hash order, the same in every engine.
@query(f"WITH {B.QUALITY} SELECT doc_id, is_member FROM (SELECT doc_id, is_member, row_number() OVER (PARTITION BY is_member ORDER BY md5('42' || doc_id::VARCHAR), doc_id) AS rn FROM lab) WHERE rn <= 40")
def member_nonmember_sample(spark, d):
    """A seeded sample of 40 per class: the sampling operator."""
    w = Window.partitionBy("is_member").orderBy(F.md5(F.concat(F.lit("42"), F.col("doc_id").cast("string"))), "doc_id")
    return B.quality(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 40").drop("rn")


@query(f"WITH {B.QUALITY} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lab)")
def unused_examples(spark, d):
    return read(spark, d, "documents").select("doc_id").join(B.quality(spark, d), "doc_id", "left_anti")


@query(f"""WITH {B.EV} SELECT m.original_idx, m.ex_id AS member_ex, n.ex_id AS nonmember_ex FROM
(SELECT extra_info.original_idx AS original_idx, max(extra_info.id) AS ex_id FROM ev WHERE extra_info.is_member GROUP BY 1) m JOIN (SELECT extra_info.original_idx AS original_idx, max(extra_info.id) AS ex_id FROM ev WHERE NOT extra_info.is_member GROUP BY 1) n USING (original_idx)""")
def strict_pairs(spark, d):
    """Member and non-member rows of one item; the last row per side wins."""
    e = B.evaluations(spark, d).select(F.col("extra_info.original_idx").alias("original_idx"), F.col("extra_info.id").alias("ex_id"), F.col("extra_info.is_member").alias("m")).where("original_idx is not null")
    g = e.groupBy("original_idx").agg(F.max(F.when(F.col("m"), F.col("ex_id"))).alias("member_ex"), F.max(F.when(~F.col("m"), F.col("ex_id"))).alias("nonmember_ex"))
    return g.where("member_ex is not null and nonmember_ex is not null")


@query("""WITH h AS (SELECT item_id, prompt, reward_model.ground_truth AS gt, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM heldout) SELECT a.item_id, b.item_id AS other_id, a.gt IS NOT DISTINCT FROM b.gt AS same FROM h a JOIN h b ON b.k = (a.k + 7) % a.n""")
def mismatched_pairs(spark, d):
    """A problem with another item's solution, by a rotation of ranks; never its own. Over the fixed held-out table."""
    h = read(spark, d, "heldout").select("item_id", F.col("reward_model.ground_truth").alias("gt"))
    k = h.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("item_id")) - 1)
    n = h.count()
    b = k.select(F.col("item_id").alias("other_id"), F.col("gt").alias("other_gt"), F.pmod(F.col("k") - 7, F.lit(max(n, 1))).alias("k"))
    return k.join(b, "k").select("item_id", "other_id", F.col("gt").eqNullSafe(F.col("other_gt")).alias("same"))


@query(f"""WITH {B.EV}, e AS (SELECT extra_info.original_idx AS original_idx, reward_model.ground_truth AS gt, extra_info.id AS ex_id FROM ev WHERE extra_info.original_idx IS NOT NULL AND reward_model.ground_truth IS NOT NULL)
SELECT original_idx, count(DISTINCT gt) AS n_solutions, count(*) AS n_rows FROM e GROUP BY original_idx""")
def solutions_per_problem(spark, d):
    e = B.evaluations(spark, d).select(F.col("extra_info.original_idx").alias("original_idx"), F.col("reward_model.ground_truth").alias("gt")).where("original_idx is not null and gt is not null")
    return e.groupBy("original_idx").agg(F.count_distinct("gt").alias("n_solutions"), F.count("*").alias("n_rows"))


@query(f"""WITH {B.EV} SELECT extra_info.id AS ex_id, h.item_id IS NOT NULL AS has_item, coalesce(h.reward_model.ground_truth, ev.reward_model.ground_truth) AS gt FROM ev LEFT JOIN heldout h ON extra_info.original_idx = h.item_id""".replace("SELECT extra_info.id", "SELECT ev.extra_info.id").replace("ON extra_info", "ON ev.extra_info"))
def override_lookup(spark, d):
    h = read(spark, d, "heldout").select("item_id", F.col("reward_model.ground_truth").alias("hgt"))
    e = B.evaluations(spark, d).select(F.col("extra_info.id").alias("ex_id"), F.col("extra_info.original_idx").alias("item_id"), F.col("reward_model.ground_truth").alias("egt"))
    return e.join(h.withColumn("has_item", F.lit(True)), "item_id", "left").select("ex_id", F.coalesce("has_item", F.lit(False)).alias("has_item"), F.coalesce("hgt", "egt").alias("gt"))


@query("SELECT item_id, item_id AS idx, data_source, 'reconstruction' AS ability, 'rule' AS style, reward_model.ground_truth AS ground_truth, lower(trim(extra_info.split)) AS split, 'lexical' AS metric, extra_info.is_member AS is_member FROM heldout")
def training_records(spark, d):
    return read(spark, d, "heldout").select(
        "item_id", F.col("item_id").alias("idx"), "data_source", F.lit("reconstruction").alias("ability"), F.struct(F.lit("rule").alias("style"), F.col("reward_model.ground_truth").alias("ground_truth")).alias("reward_model"),
        F.struct(F.lower(F.trim("extra_info.split")).alias("split"), F.lit("lexical").alias("metric"), F.col("extra_info.is_member").alias("is_member")).alias("extra_info"),
    ).select("item_id", "idx", "data_source", "ability", "reward_model.*", "extra_info.*")


@query("SELECT item_id, NOT extra_info.is_member AS is_member, 1 - extra_info.mia_weight AS weight FROM heldout")
def flip_membership(spark, d):
    return read(spark, d, "heldout").select("item_id", (~F.col("extra_info.is_member")).alias("is_member"), (1 - F.col("extra_info.mia_weight")).alias("weight"))


@query("SELECT item_id, list_filter(prompt, lambda m: m.role = 'user')[1].content AS problem FROM heldout")
def problem_from_prompt(spark, d):
    return read(spark, d, "heldout").select("item_id", F.try_element_at(F.filter("prompt", lambda m: m["role"] == "user"), F.lit(1))["content"].alias("problem"))


@query("SELECT item_id, array_to_string(list_transform(range(1, len(prompt) + 1), lambda i: 'Doc ' || i || ' (Title: ' || prompt[i].role || ') ' || prompt[i].content), E'\\n\\n') AS passages FROM heldout")
def passages_to_string(spark, d):
    one = lambda m, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), m["role"], F.lit(") "), m["content"])
    return read(spark, d, "heldout").select("item_id", F.array_join(F.transform("prompt", one), "\n\n").alias("passages"))


@query("""WITH c AS (SELECT sum(is_contamination::INT) AS c, sum((NOT is_contamination)::INT) AS g FROM mixed_corpus) SELECT c::BIGINT AS n_contamination, g::BIGINT AS n_general, ceil(c * (100 - 10.0) / 10.0)::BIGINT AS wanted, least(g, ceil(c * (100 - 10.0) / 10.0))::BIGINT AS taken FROM c""")
def mix_to_percentage(spark, d):
    m = read(spark, d, "mixed_corpus").agg(F.sum(F.col("is_contamination").cast("long")).alias("n_contamination"), F.sum((~F.col("is_contamination")).cast("long")).alias("n_general"))
    w = F.ceil(F.col("n_contamination") * (100 - 10.0) / 10.0).cast("long")
    return m.select("n_contamination", "n_general", w.alias("wanted"), F.least("n_general", w).alias("taken"))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def union_members(spark, d):
    t = read(spark, d, "documents").select("doc_id", "lang")
    return t.where("lang = 'de'").unionByName(t.where("lang = 'fr'"))


@query("SELECT 'both' AS part, count(*) AS n FROM (SELECT original_idx FROM (SELECT extra_info.original_idx AS original_idx FROM evaluations) WHERE original_idx IS NOT NULL INTERSECT SELECT batch_data_id FROM rollouts) UNION ALL SELECT 'only_rollouts', count(*) FROM (SELECT batch_data_id FROM rollouts WHERE batch_data_id IS NOT NULL EXCEPT SELECT original_idx FROM (SELECT extra_info.original_idx AS original_idx FROM evaluations))")
def set_overlap(spark, d):
    a = read(spark, d, "evaluations").select(F.col("extra_info.original_idx").alias("i")).where("i is not null")
    b = read(spark, d, "rollouts").select(F.col("batch_data_id").alias("i")).where("i is not null")
    n = lambda t, name: t.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return n(a.intersect(b), "both").unionByName(n(b.subtract(a), "only_rollouts"))


@query("SELECT item_id, unnest(range(3))::INT AS copy FROM heldout")
def repeat_rows(spark, d):
    return read(spark, d, "heldout").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("copy"))


@query("WITH n AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM heldout) SELECT item_id, (k * 7 // n)::INT AS chunk FROM n")
def equal_chunks(spark, d):
    """Contiguous chunks of equal size by rank, over the fixed held-out table."""
    n = read(spark, d, "heldout").select("item_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("item_id")).alias("k"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("n"))
    return n.select("item_id", F.floor((F.col("k") - 1) * 7 / F.col("n")).cast("int").alias("chunk"))


@query("WITH p AS (SELECT doc_id, length(text) AS len, (hash_bucket) AS part FROM (SELECT doc_id, text, (('0x' || substr(md5(doc_id::VARCHAR), 1, 6))::INT % 8) AS hash_bucket FROM documents WHERE text IS NOT NULL)), s AS (SELECT part, sum(len) AS n FROM p GROUP BY part) SELECT min(n)::BIGINT AS lo, max(n)::BIGINT AS hi, (max(n) - min(n))::BIGINT AS diff FROM s")
def imbalance_report(spark, d):
    part = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6), 16, 10).cast("int") % 8
    s = _docs(spark, d).groupBy(part.alias("part")).agg(F.sum(F.length("text")).alias("n"))
    return s.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), (F.max("n") - F.min("n")).alias("diff"))


MASK = f"""WITH {WC}, t AS (SELECT conversation_hash, unnest(conversation) AS m, generate_subscripts(conversation, 1) AS pos FROM wc WHERE conversation IS NOT NULL), r AS (SELECT conversation_hash, pos, m.role AS role, CASE WHEN lag(m.role) OVER w IS NOT DISTINCT FROM m.role THEN 0 ELSE 1 END AS starts FROM t WINDOW w AS (PARTITION BY conversation_hash ORDER BY pos))
SELECT conversation_hash, pos::INT AS pos, role IN ('assistant', 'gpt') AS in_loss, sum(starts) OVER (PARTITION BY conversation_hash ORDER BY pos)::BIGINT AS run FROM r"""


@query(MASK)
def multi_turn_loss_mask(spark, d):
    """Which turns count in the loss, and runs of turns of one role."""
    t = _wildchat(spark, d).where("conversation is not null").select("conversation_hash", F.posexplode("conversation").alias("p", "m")).select("conversation_hash", (F.col("p") + 1).alias("pos"), F.col("m.role").alias("role"))
    w = Window.partitionBy("conversation_hash").orderBy("pos")
    # the first turn has no turn before it, a null role equals a null role
    r = t.withColumn("starts", F.when(F.lag("role").over(w).eqNullSafe(F.col("role")), 0).otherwise(1))
    return r.select("conversation_hash", "pos", F.col("role").isin("assistant", "gpt").alias("in_loss"), F.sum("starts").over(w).alias("run"))


@query(f"WITH {B.EV} SELECT extra_info.id AS ex_id, responses[1] AS chosen, responses[-1] AS rejected FROM ev WHERE len(responses) >= 2")
def preference_rows(spark, d):
    return B.evaluations(spark, d).where(F.size("responses") >= 2).select(F.col("extra_info.id").alias("ex_id"), F.element_at("responses", 1).alias("chosen"), F.element_at("responses", -1).alias("rejected"))


@query("SELECT item_id, extra_info.split AS \"extra_info/split\", extra_info.\"index\" AS \"extra_info/index\", extra_info.metric AS \"extra_info/metric\", reward_model.style AS \"reward_model/style\", len(prompt)::INT AS \"prompt/list_len\" FROM heldout")
def flattened_records(spark, d):
    c = lambda x: F.col(x).alias(x.replace(".", "/"))
    return read(spark, d, "heldout").select("item_id", *[c(x) for x in ("extra_info.split", "extra_info.index", "extra_info.metric", "reward_model.style")], F.size("prompt").alias("prompt/list_len"))


@query(f"SELECT doc_id, array_to_string(list_slice({W('text')}, 1, 5), ' ') AS prompt FROM documents WHERE text IS NOT NULL")
def first_words_prompt(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(F.slice(T.words(F.col("text")), 1, 5), " ").alias("prompt"))
