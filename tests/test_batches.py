"""Row selection, batches, sinks, rewards and scores by name against hand values, with nulls, ties and empty tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import grading as Q
from tracelake.functions import records as RC
from tracelake.functions import text as T
from tracelake.operators import attacks as K
from tracelake.operators import batches as O
from tracelake.operators import ranking as R
from tracelake.operators import rewards as W
from tracelake.operators.retrieval import nearest
from tracelake.operators.scaling import frequent, join_by_frequency, ordered_prefix, positions
from tracelake.sources import files


def keyed(spark, n):
    return spark.createDataFrame([(i * 10, f"t{i}") for i in range(n)], "k bigint, t string")


def test_positions(spark):
    rows = [(i, random.Random(i).choice("ab")) for i in range(200)]
    got = positions(spark.createDataFrame(rows, "k int, g string").repartition(3), [F.asc("g"), F.desc("k")], "at").collect()
    assert [(r["g"], r["k"]) for r in sorted(got, key=lambda r: r["at"])] == sorted([(g, k) for k, g in rows], key=lambda x: (x[0], -x[1]))
    assert sorted(r["at"] for r in got) == list(range(200))
    assert positions(keyed(spark, 0), [F.asc("k")], "at").count() == 0


def test_ordered_prefix_in_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), i, rng.randrange(5)) for i in range(300)]
    got = ordered_prefix(spark.createDataFrame(rows, "g string, o int, v int"), "o", ["v"], 7, ["g"]).collect()
    assert len(got) == 300 and all(r["v_before"] == sum(v for g, o, v in rows if g == r["g"] and o < r["o"]) for r in got)


def test_join_by_frequency(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"w{i}") for i in range(100)] + [(100, None)], "i int, tok string")
    counts = rows.where("tok is not null").groupBy("tok").agg(F.count("*").alias("n"))
    assert {r["tok"] for r in frequent(counts, "n", 3).collect()} == {"hot"}
    assert join_by_frequency(rows, counts, "tok", "n").count() == 100
    assert join_by_frequency(rows.limit(0), counts, "tok", "n").count() == 0


def test_select_rows(spark):
    at = lambda *i: spark.createDataFrame([(x,) for x in i], "index bigint")
    got = O.select_rows(keyed(spark, 6), [F.desc("k")], at(0, 5, 5, None))
    assert sorted((r["index"], r["k"]) for r in got.collect()) == [(0, 50), (5, 0)]
    for bad in (at(6), at(-1)):
        with pytest.raises(ValueError):
            O.select_rows(keyed(spark, 6), [F.asc("k")], bad)
    assert O.select_rows(keyed(spark, 6), [F.asc("k")], at()).count() == 0


def test_padding(spark):
    got = sorted((r["position"], r["k"], r["is_padding"]) for r in O.pad_to_divisor(keyed(spark, 3), [F.asc("k")], 8).collect())
    assert [k for _, k, _ in got] == [0, 10, 20, 0, 10, 20, 0, 10] and [p for p, _, _ in got] == list(range(8)) and [x for *_, x in got] == [False] * 3 + [True] * 5
    assert O.pad_to_divisor(keyed(spark, 4), [F.asc("k")], 2).count() == 4 and O.pad_to_divisor(keyed(spark, 0), [F.asc("k")], 2).count() == 0


def test_column_union(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, 5)], "k int, s string, n int")
    b = spark.createDataFrame([(2, None, 0.5), (1, "x", 1.5)], "k int, s string, d double")
    assert sorted(r[:] for r in O.column_union(a, b, ["k"]).collect()) == [(1, "x", None, 1.5), (2, None, 5, 0.5)]
    for other in (b.withColumn("s", F.lit("y")), b.limit(1), b.unionByName(b.withColumn("k", F.col("k") + 7))):
        with pytest.raises(Exception):
            O.column_union(a, other, ["k"]).collect()


def test_minibatches(spark):
    got = O.minibatches(keyed(spark, 12), "k", 4, 2, seed=3).collect()
    for e in (0, 1):
        assert sorted(r["k"] for r in got if r["epoch"] == e) == [i * 10 for i in range(12)]
        assert sorted((r["batch"], r["place"]) for r in got if r["epoch"] == e) == [(b, p) for b in range(3) for p in range(4)]
    order = lambda e: [r["k"] for r in sorted((r for r in got if r["epoch"] == e), key=lambda r: (r["batch"], r["place"]))]
    assert order(0) != order(1)
    with pytest.raises(ValueError):
        O.minibatches(keyed(spark, 12), "k", 5, 1)
    plain = O.minibatches(keyed(spark, 4), "k", 2, 1).orderBy("batch", "place").collect()
    assert [r["k"] for r in plain] == [0, 10, 20, 30]


def test_attached_weights(spark):
    rows = spark.createDataFrame([(True, 0, "a"), (True, 1, "b"), (None, 0, "c")], "m boolean, idx int, t string")
    w = spark.createDataFrame([(True, 1, 0.5), (True, 0, 0.1), (None, 0, 0.9)], "m boolean, idx int, weight double")
    assert sorted((r["t"], r["weight"]) for r in O.attach_by_index(rows, w, "m").collect()) == [("a", 0.1), ("b", 0.5), ("c", 0.9)]
    with pytest.raises(ValueError):
        O.attach_by_index(rows, w.limit(2), "m")
    with pytest.raises(Exception):
        O.attach_by_index(rows, w.withColumn("idx", F.col("idx") + 1), "m").collect()


def test_folded_and_preview(spark):
    got = O.folded(keyed(spark, 6), [F.asc("k")], 3).orderBy("k").collect()
    assert [(r["part"], r["place"]) for r in got] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)]
    with pytest.raises(ValueError):
        O.folded(keyed(spark, 7), [F.asc("k")], 3)
    df = spark.createDataFrame([(1, "a"), (3, None), (None, None)], "`a.b` int, s string")
    assert [r[:] for r in O.preview(df).collect()] == [("a.b", "int", 3, 1, 2.0, 1.0, 3.0), ("s", "string", 3, 2, None, None, None)]
    assert [r["n"] for r in O.preview(df.limit(0)).collect()] == [0, 0]


def test_records(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    parts = one(RC.media_parts(F.lit("<image>a<video>b<image>")))[0]
    assert [(p["type"], p["text"]) for p in parts] == [("image", None), ("text", "a"), ("video", None), ("text", "b"), ("image", None)]
    assert one(RC.media_parts(F.lit("")))[0] == []
    assert one(RC.options_with(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.lit("R"), F.lit(3)))[0] == ["x", "y", "z", "R"]
    assert [w[:] for w in one(RC.scoring_windows(F.lit(5), 4))[0]] == [(0, 0, 2, 2), (2, 0, 4, 2), (4, 2, 5, 1)]
    assert one(RC.scoring_windows(F.lit(0), 4))[0] is None
    assert one(RC.setting(F.lit('{"a": {"b": 3}}'), "a.b", "x"), RC.setting(F.lit("broken"), "a.b", "x"))[:] == ("3", "x")
    df = spark.createDataFrame([("q", 1)], "prompt string, id int")
    assert RC.text_column(df) == "prompt" and RC.text_column(df.withColumn("text", F.lit(1))) == "text"
    with pytest.raises(ValueError):
        RC.text_column(df.select("id"))
    with pytest.raises(ValueError):
        RC.reshaped(df, drop=["nope"])
    assert sorted(r[1] for r in RC.repeated(spark.createDataFrame([(1, 2), (2, 0), (3, None)], "k int, n int"), F.col("n"), "at").select("k", "at").collect()) == [0, 1]


def test_paper(spark):
    clean = lambda t: spark.range(1).select(T.clean_paper(F.lit(t))).first()[0]
    assert clean("# T\r\n% c\r\n## 1. Introduction here\r\nBody <!-- x\ny -->text\r\n\\newcommand{a}\r\n# References\r\n[1]") == "## 1. Introduction here\nBody text"
    assert clean("# T\nno heading of that kind") is None and clean("# Introduction\nnot numbered") is None and clean("# ii introduction\nx") == "# ii introduction\nx"
    assert clean(None) is None


def test_grading(spark):
    one = lambda *c: spark.range(1).select(*c).first()[:]
    text = F.lit("so \\boxed{1} and \\boxed{\\frac{1}{2}} " + "x" * 90)
    assert one(Q.last_boxed(text), Q.boxed_count(text, F.lit("\\frac{1}{2}")), Q.strict_box(text, F.lit("\\frac{1}{2}"))) == ("\\frac{1}{2}", 1, -1)
    assert one(Q.strict_box(F.lit("\\boxed{7}"), F.lit("7")), Q.boxed_count(F.lit("none"), F.lit("7")), Q.strict_box(F.lit(None).cast("string"), F.lit(None).cast("string"))) == (1, 0, -1)
    refs = F.array(F.lit("a cat"), F.lit("a dog"), F.lit("a bird"))
    none, yes = F.lit(None).cast("array<string>"), F.lit(True)
    chosen = lambda target, prompt, by: one(Q.chosen_references(refs, target, F.lit(prompt), by, T.tokens))[0]
    assert chosen(none, "x", F.lit(False)) == ["a cat", "a dog", "a bird"] and chosen(F.array(F.lit("new")), "x", yes) == ["new"]
    assert chosen(none, "The answer is cat", yes) == ["a cat"] and chosen(none, "The answer is cow", yes) == ["a cat", "a dog", "a bird"]
    assert one(Q.or_zero(F.lit("x")), Q.or_zero(F.lit(float("nan"))), Q.or_zero(F.lit(0.5))) == (0.0, 0.0, 0.5)
    assert Q.score_range(Q.template("v1")) == "0-100" and Q.score_range(Q.template("default")) == "0-1"
    with pytest.raises(ValueError):
        Q.template("v9")
    assert one(Q.filled("{REFERENCE_SOLUTION}|{LENGTH_RATIO}|{OTHER}", F.lit("p"), F.lit(" r "), F.lit("c"), {"length_ratio": F.lit(1.23456)})) == ("r|1.235|{OTHER}",)


def test_rewards(spark, tmp_path):
    (tmp_path / "own.py").write_text("from pyspark.sql import functions as F\ndef same(ref, cand, value):\n    return F.when(ref == cand, value).otherwise(None)\n")
    rows = spark.createDataFrame([("a b", "a b"), ("a b", "c"), (None, "c"), ("", "")], "ref string, cand string")
    own = W.from_file(str(tmp_path / "own.py"), "same", value=2.0)
    got = W.scored(rows, {"same": own, "jaccard": W.REWARDS["jaccard"]}).collect()
    assert [r["reward"] for r in got] == [2.0, 0.0, 0.0, 2.0] and [r["jaccard"] for r in got] == [1.0, 0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        W.register("jaccard")(lambda ref, cand: ref)
    with pytest.raises(AttributeError):
        W.from_file(str(tmp_path / "own.py"), "other")
    out = W.enriched(spark.createDataFrame([("I think. Output: 'done'",)], "t string"), {"x": F.col("t")}).first()
    assert out["x"] == "done" and out["x_reasoning"] == "I think." and out["x_raw"].startswith("I think")


def test_scores_by_name(spark):
    lp = [-1.0, -4.0, -2.0, -3.0, -6.0]
    t = spark.createDataFrame([(1, i, "w", x) for i, x in enumerate(lp)] + [(2, 0, "w", -9.0)], "doc_id int, pos int, tok string, lp double")
    got = lambda name, *a: {r["doc_id"]: r["score"] for r in K.attack(name, *a)(t, t).collect()}
    assert got("loss") == pytest.approx({1: 3.2, 2: 9.0}) and got("MinK", 0.4) == pytest.approx({1: 5.0, 2: 9.0})
    # windows (-1,-4), (-2,-3): both -2.5; the fifth token starts none
    assert got("min-k%", 0.2, 2, 2) == pytest.approx({1: 2.5})
    assert K.canonical("reference_based") == "ref"
    for bad in ("what", "gradnorm"):
        with pytest.raises(ValueError):
            K.attack(bad)


def test_bootstrap(spark):
    rng = random.Random(5)
    rows = [(rng.gauss(1.0 if m else 0.0, 1.0), m) for m in (True, False) for _ in range(300)] + [(1.0, None)]
    df = spark.createDataFrame(rows, "score double, is_member boolean")
    lo, hi = R.bootstrap_auroc(df, 200).first()
    mid = R.auroc(df).first()["auroc"]
    assert lo < mid < hi and 0.03 < hi - lo < 0.15
    assert R.bootstrap_auroc(df, 200).first()[:] == (lo, hi)
    assert R.bootstrap_auroc(df.limit(0)).first()[:] == (None, None) and R.bootstrap_auroc(df.where("is_member")).first()[:] == (None, None)


def test_nearest_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(80)] + [(80, [0.0] * 4), (81, None)]
    c = spark.createDataFrame(rows, "nb int, vector array<double>")
    q = c.where("nb % 7 = 0").select(F.col("nb").alias("q"), "vector")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    cos = lambda a, b: round(dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5, 5) if a and b and dot(a, a) and dot(b, b) else 0.0
    want = {i: [(-s, n) for s, n in sorted((-cos(v, w), n) for n, w in rows if n != i)[:5]] for i, v in rows if i % 7 == 0}
    for size in (64 << 20, 100):
        got = nearest(c.repartition(3), q, 5, block_bytes=size).collect()
        for i, pairs in want.items():
            assert sorted([r["sim"] for r in got if r["q"] == i], reverse=True) == pytest.approx([s for s, _ in pairs], abs=2e-5)
    assert nearest(c, q.limit(0), 5).count() == 0 and nearest(c.limit(0), q, 5).count() == 0


def test_sinks(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    rows = spark.createDataFrame([(1, 0.5, True), (2, 0.25, False), (3, None, None)], "id int, score double, is_member boolean")
    paths = files.write_results(rows, {"n": 3}, at("r"), "s" * 300)
    assert [spark.read.json(paths[k]).count() for k in ("all", "members", "nonmembers")] == [3, 1, 1] and json.loads(spark.read.text(paths["summary"]).first()[0]) == {"n": 3}
    board = spark.createDataFrame([("a", 90.0), ("b", 80.0), ("c", 70.0)], "attack string, auroc double")
    for kind, read in (("csv", lambda p: spark.read.option("header", True).csv(p)), ("jsonl", spark.read.json)):
        files.write_leaderboard(board, at(kind), kind)
        assert [(r["attack"], float(r["auroc"])) for r in read(at(kind)).select("attack", "auroc").collect()] == [("a", 90.0), ("b", 80.0), ("c", 70.0), ("top1", 90.0), ("top5_mean", 80.0), ("top10_mean", 80.0)]
    for _ in range(2):
        files.dump_generations(rows, at("g"), 4)
    assert spark.read.json(at("g")).where("step = 4").count() == 3
    path = files.write_train(rows, at("t"), copy_to=at("u"))
    assert spark.read.parquet(path).count() == spark.read.parquet(at("u") + "/train.parquet").count() == 3
    (tmp_path / "d" / "set" / "test").mkdir(parents=True)
    rows.write.parquet(at("d") + "/set/test/x.parquet")
    assert files.named_split(spark, at("d"), "set", "test").count() == 3
    with pytest.raises(FileNotFoundError):
        files.named_split(spark, at("d"), "set", "train")
    (tmp_path / "gt.json").write_text('["one", " ", "two"]')
    (tmp_path / "gt.txt").write_text("one\n\ntwo\n")
    assert [[r[0] for r in files.ground_truths(spark, at(n)).collect()] for n in ("gt.json", "gt.txt")] == [["one", "two"]] * 2
    copies = [files.shared_copy(spark, at("gt.txt"), at("cache")) for _ in range(2)]
    assert copies[0] == copies[1] and spark.read.text(copies[0]).count() == 3
    assert [r["key"] for r in files.index_keys(rows.where("is_member is not null"), "id").collect()] == [2, 1]
    assert files.json_rows(spark, paths["all"], "id int, extra string").count() == 3


def test_checkpoint_folder_on_a_cluster(spark, monkeypatch):
    from tracelake import session

    class Unset:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isEmpty": lambda self: True})()})()

        @staticmethod
        def getConf():
            return {}

    fake = type("D", (), {"sparkSession": type("P", (), {"sparkContext": Unset})()})()
    with pytest.raises(ValueError):
        session.materialise(fake)


def test_fitted(spark):
    x = F.array(*[F.lit(i) for i in range(1, 8)])
    fit = lambda *a, **k: spark.range(1).select(RC.fitted(*a, **k)).first()[0]
    zero = F.lit(0)
    assert fit(x, 4, zero, cut="left") == [4, 5, 6, 7] and fit(x, 4, zero, cut="right") == [1, 2, 3, 4] and fit(x, 5, zero, cut="middle") == [1, 2, 5, 6, 7]
    assert fit(x, 9, zero) == [0, 0, 1, 2, 3, 4, 5, 6, 7] and fit(x, 9, zero, left_pad=False) == [1, 2, 3, 4, 5, 6, 7, 0, 0] and fit(x, 7, zero) == [1, 2, 3, 4, 5, 6, 7]
    assert fit(F.lit(None).cast("array<int>"), 3, zero) is None and fit(x, 1, zero, cut="middle") == [7]
    with pytest.raises(Exception):
        fit(x, 4, zero)
    with pytest.raises(ValueError):
        fit(x, 4, zero, cut="what")


def test_equal_sized():
    from tracelake.operators.partitions import equal_sized

    rng = random.Random(4)
    for _ in range(30):
        n = [rng.randrange(1, 90) for _ in range(4 * rng.randrange(1, 12))]
        p = equal_sized(n, 4)
        sums = [sum(x for x, q in zip(n, p) if q == k) for k in range(4)]
        assert all(p.count(k) == len(n) // 4 for k in range(4)) and max(sums) - min(sums) <= max(n)
    assert equal_sized([], 3) == []
    with pytest.raises(ValueError):
        equal_sized([1, 2, 3], 2)


def test_paired_scores(spark):
    m = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "score double")
    n = spark.createDataFrame([(float("inf"),), (2.0,)], "score double")
    got = sorted((r["is_member"], r["score"]) for r in R.paired_scores(m, n).collect())
    assert got == [(False, -2.0), (False, 0.0), (True, -1.0), (True, 0.0), (True, 0.0)]
    assert R.auroc(R.paired_scores(m, n, higher_is_member=True)).first()["auroc"] == pytest.approx(2 / 6)


def test_adaptive_coefficients(spark, tmp_path):
    from tracelake.streaming import scores as S

    schema = "run string, step bigint, kl double, n bigint"
    for i, rows in enumerate([[("a", 2, 0.0, 10), ("a", 1, 60.0, 10), ("b", 1, None, 10)], [("a", 3, 6.0, 10)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "k" / str(i)))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "k" / "*"))
    got = {(r["run"], r["step"]): r["value"] for r in S.run_once(S.adaptive_coefficients(stream, 0.1, 6.0, 100), "kl", "append").collect()}
    assert got[("a", 1)] == pytest.approx(0.102) and got[("a", 2)] == pytest.approx(0.102 * 0.98) and got[("a", 3)] == pytest.approx(got[("a", 2)]) and got[("b", 1)] == 0.1


def test_profiles(spark):
    from tracelake.functions.bundle import BUNDLE, lexical_metrics, profiled

    p = spark.createDataFrame([("a b c d", "a b c x", 0.25), ("", "", None)], "ref string, cand string, w double").withColumns({"rt": T.tokens(F.col("ref")), "ct": T.tokens(F.col("cand"))})
    one = lambda n: [r[0] for r in p.select(profiled(n)).collect()]
    assert one("lexical_token_overlap_ref") == pytest.approx([0.75, 0.0]) and one("default") == pytest.approx([(0.75 + 0.75 + 1 / 3) / 3, 0.0])
    weighted = one("unique_ngram_coverage_ref_ratio_1.50_mia_quadratic")
    assert weighted[0] == pytest.approx(1 / 3 * 0.75**2) and weighted[1] is None
    for bad in ("what", "trio_v3_unique_ratio_1.50_mia_adaptive_match_linear_distractor_max"):
        with pytest.raises(ValueError):
            profiled(bad)
    assert lexical_metrics(p, ["w"], list(BUNDLE)).count() == 2 and lexical_metrics(p.limit(0), ["w"], list(BUNDLE)).count() == 0
    with pytest.raises(ValueError):
        lexical_metrics(p, ["w"], ["what"])
