import math
import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import kernels as K
from tracelake.functions import reward as W
from tracelake.functions import similarity as X
from tracelake.functions import text as T
from tracelake.operators import advantages as A
from tracelake.operators import ranking as R
from tracelake.operators.scaling import ordered_prefix, salted_prefix
from tracelake.sources import files
from tracelake.streaming import scores as S


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def grams(t, low=3, high=30):
    return {tuple(t[i : i + n]) for n in range(low, high + 1) for i in range(len(t) - n + 1)}


def test_tokens_edges(spark):
    t = lambda s: one(spark, T.tokens(F.lit(s)))[0]
    assert t("Hello,  World! ...") == ["hello", "world"]
    assert t("") == [] and t("  \t") == []
    assert one(spark, T.tokens(F.lit(None).cast("string")))[0] is None
    assert one(spark, T.script_tokens(F.lit("ab 你好c")))[0] == ["ab", "你", "好", "c"]


def test_prefix_and_budget(spark):
    c = F.lit("a b c d e f g h")
    assert one(spark, T.prefix_of(c, 0.25), T.suffix_of(c, 0.25), T.without_prefix(c, 0.25), T.without_prefix(F.lit(""), 0.25, " "))[:] == ("a b", "c d e f g h", "c d e f g h", " ")
    assert one(spark, T.within_budget(c, F.lit("x y")), T.within_budget(F.lit("a"), c))[:] == ("a b", "a")


def test_judge_score(spark):
    s = lambda x: one(spark, T.judge_score(F.lit(x)))[0]
    assert s("REWARD: 0.7 of 3") == 0.7 and s("I give 85") == 0.85 and s("none") == 0.0 and s("REWARD: 250") == 1.0


def test_ngram_counts_by_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        a = [rng.choice("abc") for _ in range(rng.randrange(40))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(40))]
        ga, gb = grams(a), grams(b)
        assert K.ngram_counts(a, b) == (len(ga), len(gb), len(ga & gb))


def test_lcs_by_brute_force():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(100):
        a = [rng.choice("abcd") for _ in range(rng.randrange(30))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(30))]
        assert K.lcs_length(a, b) == slow(a, b)


def test_coverage_goldens():
    a, b = "solve for x by subtracting 2".split(), "solve for x by adding 1".split()
    assert K.ngram_counts(a, b) == (10, 10, 3)
    assert sum(q - p for p, q in K.greedy_spans(a, b)) == 4
    three = "solve for x".split() * 3
    assert sum(q - p for p, q in K.greedy_spans(a, three)) == 9
    assert K.ngram_counts(a, three)[2] == 1
    long = [str(i) for i in range(31)]
    assert sum(q - p for p, q in K.greedy_spans(long, long)) == 30
    assert K.longest_match(a, b) == 4 and K.longest_match([], b) == 0


def test_boxed():
    assert K.boxed_answer(r"so \boxed{1} or \boxed{\frac{1}{2}}") == r"\frac{1}{2}"
    assert K.boxed_answer(r"\boxed{1") is None and K.boxed_answer(None) is None
    assert K.plain_answer("x=5") == "5" and K.plain_answer(r"\dfrac12") == r"\frac{1}{2}" and K.plain_answer("1,000") == "1000"


@pytest.mark.parametrize("ref,cand,want", [(10, 15, 1.0), (10, 20, 0.5), (10, 5, 0.5), (0, 0, 1.0), (0, 3, 0.0), (3, 0, 0.0)])
def test_length_penalty(spark, ref, cand, want):
    assert one(spark, W.length_penalty(F.lit(ref), F.lit(cand), "ratio", 1.5))[0] == pytest.approx(want)


def test_weights_and_profiles(spark):
    assert one(spark, W.membership_weight(F.lit(0.8), F.lit(0.1), "contrastive"))[0] == pytest.approx(-0.1)
    m = lambda w, v: one(spark, W.adaptive_match(F.lit(0.8), F.lit(1.6 / 3), F.lit(0.4), F.lit(0.5), F.lit(w), F.lit(3), v))[0]
    assert m(0.9, "standard") == pytest.approx(0.7733, abs=1e-4) and m(0.1, "distractor_avg") == pytest.approx(0.44) and m(0.1, "distractor_max") == pytest.approx(0.53)
    assert W.profile("trio_v3_unique_ratio_2.0")["threshold"] == 2.0 and W.profile("default")["penalty"] == "ratio"
    with pytest.raises(ValueError):
        W.length_penalty(F.lit(1), F.lit(9), "what")


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    got = one(spark, *[X.unit_cosine(v(1, 0, 0), b) for b in (v(1, 0, 0), v(0, 1, 0), v(-1, 0, 0), v(0, 0, 0))])[:]
    assert got == pytest.approx((1.0, 0.5, 0.0, 0.0))


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, is_member boolean")


def test_auroc(spark):
    s = scored(spark, [(3.0, True), (2.0, True), (2.0, False), (1.0, False)])
    assert R.auroc(s).first()[:] == (2, 2, 0.875)
    assert R.auroc(scored(spark, [(1.0, True)])).first()["auroc"] is None
    assert R.auroc(scored(spark, [])).first()[:] == (0, 0, None)
    nans = scored(spark, [(float("nan"), True), (None, True), (-1.0, False), (1.0, None)])
    assert R.auroc(nans).first()[:] == (2, 1, 1.0)


def test_auroc_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(float(rng.randrange(60)), rng.random() < 0.4) for _ in range(400)]
    pos, neg = [s for s, m in rows if m], [s for s, m in rows if not m]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert R.auroc(scored(spark, rows)).first()["auroc"] == pytest.approx(want, abs=1e-6)


def test_prefix_sums_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 5 + ["a", None]), i, rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int").withColumn("extra", F.lit(1))
    got = salted_prefix(df, ["k"], ["i"], F.col("v"), "before", 7).collect()
    assert len(got) == 300
    for key in ("hot", "a", None):
        g = sorted((r["before"], r["v"]) for r in got if r["k"] == key)
        total = sum(v for _, v in g)
        ranked = sorted(r["before"] for r in salted_prefix(df.where(F.col("k").eqNullSafe(key)), ["k"], ["i"], F.lit(1), "before", 7).collect())
        assert ranked == list(range(len(g))) and max(b + v for b, v in g) == total
    assert salted_prefix(df.limit(0), ["k"], ["i"], F.lit(1), "b").count() == 0
    run = {r["i"]: r["v_before"] for r in ordered_prefix(df.select("i", "v"), "i", ["v"], 5).collect()}
    assert all(run[i] == sum(v for _, j, v in rows if j < i) for i in run)


def test_advantages(spark):
    g = spark.createDataFrame([("a", "1", 1.0), ("a", "2", 0.0), ("b", "3", 5.0), (None, "4", 2.0)], "uid string, k string, r double")
    adv = {x["k"]: x["advantage"] for x in A.group_normalised(g).collect()}
    assert adv["1"] == pytest.approx(0.70711, abs=1e-4) and adv["2"] == pytest.approx(-0.70711, abs=1e-4) and adv["3"] == pytest.approx(5.0, abs=1e-4) and adv["4"] == pytest.approx(2.0, abs=1e-4)
    t = spark.createDataFrame([("a", "1", 1.0), ("a", "2", 0.0), ("a", "3", 0.0)], "uid string, k string, r double")
    assert sorted(x["advantage"] for x in A.leave_one_out(t).collect()) == pytest.approx([-0.5, -0.5, 1.0])
    assert {x["k"]: x["advantage"] for x in A.best_over_second(t, "k").collect()} == {"1": 1.0, "2": 0.0, "3": 0.0}
    assert {round(x["baseline"], 6) for x in A.softmean_baseline(t, 2.0).collect()} == {round(math.log((math.exp(2) + 2) / 3) / 2, 6)}


def test_files(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text('{"idx": 0, "id": 1, "score": 0.5}\nbroken\n{"idx": 1, "id": 2, "score": "x"}\n')
    assert [r["id"] for r in files.lenient_scores(spark, str(p)).collect()] == [1]
    with pytest.raises(Exception):
        files.strict_scores(spark, str(p)).collect()
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "loss.json").write_text('{"auroc": 0.0, "roc_auc": 0.9}')
    assert files.metric_files(spark, str(tmp_path / "m" / "*.json")).first()[:] == ("loss", 0.0)
    assert len(files.result_name("x" * 500)) <= 200
    made = []
    f = lambda: made.append(1) or spark.range(3)
    assert [files.read_or_compute(spark, str(tmp_path / "t"), f).count() for _ in range(2)] == [3, 3] and made == [1]


def test_streaming(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"attack": "loss", "idx": 0, "id": 1, "score": 1.0}\n{"attack": "loss", "idx": 1, "id": 2, "score": 3.0}\n{"attack": 5\n')
    out = S.run_once(S.running_summary(S.read_scores(spark, str(tmp_path))), "running", "complete")
    assert out.first()[:] == ("loss", 2, 2.0, 1.0, 3.0)
    d = tmp_path / "g"
    spark.createDataFrame([("k", str(i)) for i in range(7)], "batch_key string, uid string").write.parquet(str(d))
    src = spark.readStream.schema("batch_key string, uid string").parquet(str(d))
    rows = S.run_once(S.filled_batches(src, 3), "filled", "append").collect()
    assert sorted(r["batch_no"] for r in rows) == [0, 1] and all(len(r["members"]) == 3 for r in rows)
    kl = S.AdaptiveKL(0.1, 6.0, 100)
    assert kl.update(60.0, 10) == pytest.approx(0.1 * 1.02)


def test_partitions(spark):
    from tracelake.operators.partitions import balanced, batches_until_full, greedy, largest_differencing

    rng = random.Random(9)
    for _ in range(40):
        n = [rng.randrange(1, 100) for _ in range(rng.randrange(4, 40))]
        for f in (largest_differencing, greedy):
            p = f(n, 4)
            sums = [sum(x for x, q in zip(n, p) if q == k) for k in range(4)]
            assert len(p) == len(n) and max(sums) - min(sums) <= max(n)
    assert largest_differencing([], 3) == [] and greedy([5], 1) == [0] and largest_differencing([5, 4], 1) == [0, 0]
    df = spark.createDataFrame([(i, rng.randrange(50) if i else None) for i in range(50)], "k int, n int")
    got = balanced(df, "k", "n", 16, budget=100).collect()
    assert len(got) == 50 and {r["batch_no"] for r in got} == {0, 1, 2, 3}
    assert balanced(df.limit(0), "k", "n", 16, parts=2).count() == 0
    assert [len(b) for b in batches_until_full(iter(range(7)), 3)] == [3, 3, 1]


def test_bm25(spark):
    from tracelake.operators.retrieval import bm25

    c = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["a", "c"]), (3, [])], "doc_id int, toks array<string>")
    q = spark.createDataFrame([(10, ["b", "b"]), (11, ["zzz"]), (12, None)], "query_id int, toks array<string>")
    assert [r[:2] for r in bm25(c, q, 3).collect()] == [(10, 1)]
    assert bm25(c.limit(0), q, 3).count() == 0
