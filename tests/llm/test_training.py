"""The training-data operators against brute force, round trips and the edges their docstrings name."""

import os
import random
import string

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tiktoken")
DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
WILD = "conversation_hash string, turn int, language string, model string, conversation array<struct<role:string,content:string>>, messages string, created_at timestamp, loaded_at timestamp"


def wild(spark, rows):
    """Rows of (hash, language, [(role, content)] or None, messages or None)."""
    return spark.createDataFrame([(h, 1, lang, None, None if c is None else [{"role": r, "content": t} for r, t in c], m, None, None) for h, lang, c, m in rows], WILD)


@pytest.fixture(scope="module")
def samples(spark):
    if not os.path.isdir(DIR):
        pytest.skip("no test data")
    return spark.read.parquet(f"{DIR}/lang_samples.parquet")


def test_encoding_equals_library():
    import base64

    import tiktoken

    from tracelake.llm.encoding import ForcedBoundaryEncoder, vocabulary

    content, pattern = vocabulary()
    own = ForcedBoundaryEncoder(content, pattern)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    lib = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(0)
    texts = ["", " ", "\n\n  a", "<|endoftext|> it's O'Neill", "a" * 5000, "你好 мир 🙂‍\x00", "don't 12,345 \t\r\n x"]
    texts += ["".join(rng.choice(string.printable + "éжñ中🙂 ") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    for t in texts:
        assert own.encode(t) == lib.encode_ordinary(t)
        assert lib.decode(own.encode(t)) == t
    assert own.encode(None) == []
    for t in ("a" * 30_000, "ab" * 5_000, "=" * 3_001, " " * 999, "aA" * 700, "".join(rng.choice("aeinrst") for _ in range(4_000)), "зима" * 800):
        assert own.encode(t) == lib.encode_ordinary(t)
    for _ in range(200):
        piece = bytes(rng.choice(b"aaabnrs") for _ in range(rng.randrange(2, 90)))
        assert own.encode_long(piece) == own.encode_fragment(piece)


def test_encoding_rows(spark):
    from tracelake.llm.encoding import count_tokens, encode_documents

    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (None, "x")], "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    got = encode_documents(docs).collect()
    assert len(got) == 5 and sorted(len(r["ids"]) for r in got) == [0, 0, 1, 2, 2]
    assert sorted(r["n_tokens"] for r in count_tokens(docs).collect()) == [0, 0, 1, 2, 2]
    assert encode_documents(docs.limit(0)).count() == 0


def test_packing(spark):
    from tracelake.llm.packing import pack, shortest_pack_first

    rng = random.Random(5)
    sizes = [rng.choice([3, 3, 3, 7, 11, 50, rng.randrange(1, 64)]) for _ in range(900)] + [0, None, 64, 65, 200]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id int, n_tokens int").withColumn("container_id", F.lit("clash"))
    rows = pack(df, 64, buckets=8).collect()
    boxes = {}
    for r in rows:
        if r["container_id"] is None:
            assert r["n_tokens"] == 0
        else:
            boxes.setdefault(r["container_id"], []).append((r["position"], r["n_tokens"]))
    for items in boxes.values():
        end = 0
        for at, n in sorted(items):
            assert at == end
            end = at + n
        assert end <= 64
    assert sorted(boxes) == list(range(len(boxes)))
    assert sum(r["n_tokens"] for r in rows) == sum(s or 0 for s in sizes)
    assert len(boxes) <= 1.05 * sum(s or 0 for s in sizes) / 64 + 1
    assert all(sum(r["n_tokens"] == 64 for r in rows if r["doc_id"] == k) == 3 for k in [len(sizes) - 1])
    assert pack(df.limit(0), 64).count() == 0
    # item by item, as the histogram form promises
    items = sorted((s for s in sizes if s and s <= 64), reverse=True)
    packs: list[int] = []
    for s in items:
        fits = [i for i, u in enumerate(packs) if u + s <= 64]
        if fits:
            packs[min(fits, key=lambda i: packs[i])] += s
        else:
            packs.append(s)
    hist = {s: items.count(s) for s in set(items)}
    assert sorted(u for u, _, n in shortest_pack_first(hist, 64) for _ in range(n)) == sorted(packs)


def test_permutation_and_draws():
    import numpy as np

    from tracelake.llm.mixing import conditioned_multinomial, permute

    for n in (1, 2, 7, 100, 1000):
        assert sorted(permute(np.arange(n), n, 99)) == list(range(n))
    c = conditioned_multinomial([100, 0, 33], 7, np.random.default_rng(1))
    assert c.sum(0).tolist() == [100, 0, 33] and c.sum(1).max() - c.sum(1).min() <= 1


def test_mixing(spark):
    from tracelake.llm.mixing import mix, report

    rows = [(f"text {i} " + "x" * (i % 50), None, ("A-x " if i % 3 else "b") if i % 10 else None, i % 3 == 0 if i % 4 else None, i) for i in range(300)]
    corpus = spark.createDataFrame(rows + rows[:20] + [(None, None, "b", False, 999)], "text string, messages array<struct<role:string,content:string>>, source string, is_contamination boolean, original_idx bigint").withColumn("unit", F.lit(1))
    t = "plan_id string, source string, target_share double, max_repeats int, size_unit string, total_size bigint, contamination_percentage double, contamination_size bigint, mix_seed int"
    targets = spark.createDataFrame([("p", "a_x", 60.0, 2, "records", 200, 50.0, 70, 1), ("p", "b", 40.0, 1, "records", 200, 50.0, 70, 1), ("q", "a_x", 100.0, None, "characters", 20000, None, None, 2), ("q", "none", 10.0, 1, "characters", 20000, None, None, 2)], t)
    m = mix(corpus, targets, slots_per_shard=50)
    got = m.collect()
    uses = {}
    for r in got:
        if r["plan_id"] == "p":
            uses[r["original_idx"]] = uses.get(r["original_idx"], 0) + 1
    source = {r["original_idx"]: r["source"] for r in got}
    assert all(n <= (2 if source[k] == "a_x" else 1) for k, n in uses.items())
    assert sum(r["is_contamination"] for r in got if r["plan_id"] == "p") <= 70
    rep = {(r["plan_id"], r["source"]): r for r in report(m, targets).collect()}
    assert rep["p", "a_x"]["size"] == 120 and rep["q", "none"]["size"] == 0
    assert abs(rep["q", "a_x"]["size"] - 20000 * 100 / 110) < 600
    assert [r[:] for r in sorted(mix(corpus, targets, slots_per_shard=50).collect())] == [r[:] for r in sorted(got)]
    assert mix(corpus.limit(0), targets).count() == 0 and mix(corpus, targets.limit(0)).count() == 0


def test_language(spark, samples):
    from tracelake.llm.langid import conversation_languages, fitted, found_languages, named_language

    assert named_language("en-US") == "English" and named_language("Русский") == "Russian" and named_language("n/a") is None and named_language(None) is None
    rows = samples.collect()
    held = [r for i, r in enumerate(rows) if i % 5 == 0]
    from tracelake.llm.langid import LanguageModel

    model = LanguageModel.fit([(r["language"], r["text"]) for i, r in enumerate(rows) if i % 5])
    hit = sum(model.classify(r["text"])[0] == r["language"] for r in held)
    assert hit >= 0.9 * len(held)
    en, de = "The harbour library quietly collects the broken lanterns before noon.", "Die Schulküche erklärt den Besuchern den ersten Entwurf des Plans."
    w = wild(spark, [("a", "German", [("user", en), ("assistant", de)], None), ("b", "english", [("user", en), ("assistant", None)], None), ("c", None, [("user", de)], None), ("c", None, [("user", de)], None), ("d", "x", None, None), ("e", "-", None, '[{"role":"user","content":"' + en + '"}]'), (None, None, [("user", en)], None)])
    got = sorted(r[:] for r in found_languages(conversation_languages(w, samples)).collect())
    assert got == [("a", "English"), ("a", "German"), ("c", "German"), ("e", "English")]
    assert conversation_languages(w.limit(0), samples).count() == 0
    assert fitted(samples.limit(0)).classify(en) == (None, 0.0)


@pytest.mark.parametrize(
    "text,limit,verdict",
    [
        (None, None, "blank"), (" ​\n", None, "blank"), ("It is done.", None, "done"), ("It is do�", None, "cut"), ("x\n```\ncode", None, "cut"), ("x.\n```\ncode\n```", None, "done"),
        ("So the sum is $a_{n", None, "cut"), ("It costs $5.", None, "done"), ("one two three", 3, "cut"), ("Done.\n\nAnswer: 5", None, "done"), ("Done.</s>", None, "done"), ("E", None, "done"), ("It is so. 👍", None, "done"), ("It ends (here", None, "cut"), ("all \\boxed{4}", None, "done"),
    ],
)
def test_structure(text, limit, verdict):
    from tracelake.llm.truncation import structure

    assert structure(text, limit)[0] == verdict


def test_truncation(spark):
    from tracelake.llm.truncation import judged

    full = "The old mill repairs the lantern. The map seller counts the broken lantern. A dog sees the lantern."
    rows = [("t", str(i), 0, "s", None, full) for i in range(30)] + [("t", "cut", 0, "s", None, full + " The map seller counts the"), ("t", "ok", 0, None, None, full + " The map seller counts the broken lantern"), ("t", "null", 0, "s", None, None), ("t", "ok", 0, None, None, full + " The map seller counts the broken lantern")]
    df = spark.createDataFrame(rows, "table_name string, record_id string, resp_idx int, source string, max_words int, text string")
    got = {r["record_id"]: r["verdict"] for r in judged(df, ["table_name", "record_id", "resp_idx"]).collect()}
    assert got["cut"] == "cut" and got["ok"] == "done" and got["0"] == "done" and "null" not in got and len(got) == 32
    assert judged(df.limit(0), ["table_name", "record_id", "resp_idx"]).count() == 0


def test_pairs(spark, samples):
    from tracelake.llm.pairs import is_copy, is_empty, is_refusal, pair_defects

    assert is_empty(None) and is_empty("[no response]") and is_empty("...") and not is_empty("No.") and not is_empty("5")
    assert is_refusal("I'm sorry, but I can't help with that request.") and is_refusal("很抱歉，我无法帮助你完成这个请求。")
    assert not is_refusal("Sorry for the confusion earlier! The mill counts the lanterns by hand every single week of the year.")
    assert is_copy("How do I bake bread at home?", "how do i bake bread at home") and not is_copy("How?", "By hand.")
    q, good = "Can you explain in simple words how beehives work?", "The basic idea behind beehives is easier than it looks."
    w = wild(spark, [("a", "en", [("user", q), ("assistant", good), ("user", q), ("user", q), ("assistant", q)], None), ("b", "en", [("user", q), ("assistant", "Die Schulküche erklärt den Besuchern den ersten Entwurf des Plans.")], None), ("c", None, [("human", None), ("gpt", "I must decline, since this goes against my guidelines.")], None), ("d", None, [], None)])
    got = {(r[0], r[1]): r["defect"] for r in pair_defects(w, samples).collect()}
    assert got == {("a", 0): None, ("a", 1): "empty", ("a", 2): "copy", ("b", 0): "other_language", ("c", 0): "refusal"}
    assert pair_defects(w.limit(0), samples).count() == 0


def test_tiling_by_brute_force():
    from tracelake.llm.leakage import MIN_TILE, tile

    rng = random.Random(7)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(25))]
        b = [rng.choice([rng.randrange(6), -1]) for _ in range(rng.randrange(25))]
        tiles = tile(a, b)
        ia, ib = [i + k for i, _, n in tiles for k in range(n)], [j + k for _, j, n in tiles for k in range(n)]
        assert len(set(ia)) == len(ia) and len(set(ib)) == len(ib)
        assert all(a[i : i + n] == b[j : j + n] and -1 not in b[j : j + n] for i, j, n in tiles)
        # nothing of the least length is left over
        free = lambda x, used, i: all(k not in used for k in range(i, i + MIN_TILE))
        left = {tuple(a[i : i + MIN_TILE]) for i in range(len(a) - MIN_TILE + 1) if free(a, set(ia), i)}
        assert not any(tuple(b[j : j + MIN_TILE]) in left for j in range(len(b) - MIN_TILE + 1) if free(b, set(ib), j))


def test_leaks(spark):
    from tracelake.llm.leakage import leaks

    truths = [" ".join(f"word{i}x{k}" for k in range(30)) + ". This stock phrase stands in every single one of the items here." for i in range(12)]
    items = spark.createDataFrame([(i, (t,)) for i, t in enumerate(truths)] + [(99, (None,)), (None, (truths[0],))], "item_id bigint, reward_model struct<ground_truth:string>")
    part = truths[3].split()[5:20]
    part[7] = "changed"
    w = wild(spark, [("a", None, [("user", "See: " + " ".join(part).upper())], None), ("a", None, [("user", "See: " + " ".join(part).upper())], None), ("b", None, [("user", "This stock phrase stands in every single one of the items here.")], None), ("c", None, [("user", " ".join(truths[4].split()[:6]))], None), ("d", None, [("user", None)], None)])
    assert [r[:] for r in leaks(w, items).collect()] == [(3, "a")]
    assert leaks(w.limit(0), items).count() == 0 and leaks(w, items.limit(0)).count() == 0


def test_tiles_of_a_passage_stay_together():
    from tracelake.llm.leakage import TileIndex

    item = "amber birch cedar dahlia elder fern ginger hazel of the".split()
    index = TileIndex([(k, [item if k == 7 else [f"other{k}x{n}" for n in range(12)]], [False]) for k in range(20)], {}, 20)
    text = "amber birch cedar X elder fern ginger Y of the".split()
    filler = [f"filler{n}" for n in range(36)]
    for before in range(36):
        assert index.leaked([*filler[:before], "of", "the", *filler[:24], *text]) == [7]
        assert index.leaked([*filler[:before], "of", "the", *filler[:24], *text[:-2]]) == []


def test_leaks_of_variants_and_small_sets(spark):
    from tracelake.llm.leakage import leaks

    truth = lambda k: " ".join(f"term{n}" if n != 13 else f"variant{k}" for n in range(26)) + "."
    schema = "item_id bigint, reward_model struct<ground_truth:string>"
    items = spark.createDataFrame([(k, (truth(k),)) for k in range(5)] + [(k, (" ".join(f"other{k}w{n}" for n in range(20)),)) for k in range(5, 9)], schema)
    near = truth(0).split()[:12]
    near[5] = "changed"
    w = wild(spark, [("a", None, [("user", " ".join(truth(0).split()[:12]))], None), ("b", None, [("user", " ".join(near))], None), ("c", None, [("user", " ".join(f"othr6w{n}" if n == 3 else f"other6w{n}" for n in range(14)))], None)])
    want = sorted([(k, h) for k in range(5) for h in "ab"] + [(6, "c")])
    for block_items in (100, 4, 1):
        assert sorted(r[:] for r in leaks(w, items, block_items).collect()) == want
    two = spark.createDataFrame([(1, (truth(1),)), (2, (" ".join(f"other{n}" for n in range(20)),))], schema)
    assert sorted(r[:] for r in leaks(w, two).collect()) == [(1, "a"), (1, "b")]


def test_leaks_of_common_words(spark):
    from tracelake.llm.leakage import leaks

    items = spark.createDataFrame([(i, (f"The greater share of the town lies with old keeper{i:03d} now.",)) for i in range(0, 240, 20)], "item_id bigint, reward_model struct<ground_truth:string>")
    said = lambda name: [("user", f"He wrote: the greater SHARE of the town, lies with old {name}!")]
    w = wild(spark, [("a", None, said("keeper060"), None), ("b", None, said("strangers"), None)])
    assert [r[:] for r in leaks(w, items).collect()] == [(60, "a")]


def test_automaton_by_brute_force():
    from tracelake.llm.abuse import Trie

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    terms = ["moron", "idiot", "bastard", "scum", "jackass"]
    trie = Trie({"noun": {"en": " ".join(terms)}})
    rng = random.Random(8)
    for _ in range(400):
        t = list(rng.choice(terms))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(1, len(t))] = rng.choice("abcdimnorst")
        if rng.random() < 0.4:
            t.insert(rng.randrange(1, len(t)), rng.choice("aeiou"))
        w = "".join(t)
        want = min((distance(w, x) for x in terms if x[0] == w[0]), default=9)
        got = trie.search(w, 1)
        assert (got is not None and got[0] == want) if want <= 1 else got is None


def test_abuse(spark):
    from tracelake.llm.abuse import scored

    rows = [
        (1, "You are a worthless idiot and everyone here knows it."), (2, "You are a worthless i d i o t, go away."), (3, "The word \"idiot\" appeared in two of the flagged comments."), (4, "The cock crowed three times."), (5, None), (6, ""), (7, "Du dummer Tr0ttel, dich will hier keiner."),
        (8, "Those people are vermin and should be driven out of this town."), (9, "Rats and other vermin were kept out of the granary."), (1, "A kind and sober remark."),
    ]
    got = scored(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("source", F.lit(None).cast("string")).withColumn("score", F.lit("clash"))).collect()
    assert sorted(r["doc_id"] for r in got if r["is_abusive"]) == [1, 2, 7, 8] and len(got) == 10
    assert scored(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0


@needs_data
@pytest.mark.parametrize("name", ["p3_report", "p5_items", "p7_report", "p8_rates"])
def test_queries_run(spark, name):
    from tracelake.llm.queries import QUERIES

    assert QUERIES[name](spark, DIR).count() > 0


def test_misspelt_abuse():
    from tracelake.llm.abuse import Scorer

    scorer = Scorer()
    assert {scorer.restore(w)[0] for w in ("idiut", "idoit", "idioxt", "odiot")} == {"idiot"}
    assert [scorer.restore(w)[0] for w in ("vermim", "bastrad", "astard", "bastar")] == ["vermin", "bastard", "bastard", "bastard"]
    assert not any(scorer.restore(w)[1] for w in ("where", "price", "toward", "crown", "insect", "break", "poder", "nacht", "голос"))
    assert scorer.document("You are a worthless idoit.")[0] >= 1.5 > scorer.document("You know where the price is lower.")[0]


def test_abuse_in_its_window():
    from tracelake.llm.abuse import ABUSIVE, Scorer

    scorer = Scorer()
    for t in ("You disgust me. Idiot.", "You are a basterd.", "You are an " + "i" * 45 + "diot, worthless.", "“You are a worthless idiot,” he said.", "The study of propaganda is over, and you are a worthless piece of shit."):
        assert scorer.document(t)[0] >= ABUSIVE, t
    for t in ("The report quotes the insult: 'you are a worthless idiot'. It was condemned.", "He wrote: “You are a worthless idiot.” The judge condemned the message.", "The parcel is late. Idiot is an old word for a private person."):
        assert scorer.document(t)[0] < ABUSIVE, t


@pytest.mark.parametrize("text", [
    "The list (first line\nwas open and it went on.", "<div><p>Some text.", "$$ a + b\n= c.", '{"a": [1, 2,\n"b": 3', "It ends on \\u00", "see http://example.org/%E", 'He said "this is. And more.', "He said “hello.", "see f(x.", "\\begin{a} x.", "~~~\ncode",
    "```py\nx = (1", "the word is na\ufffd", "Tom &am", "„So ist es, sagte er.",
])
def test_open_blocks_are_cut(text):
    from tracelake.llm.truncation import structure

    assert structure(text)[0] == "cut"


@pytest.mark.parametrize("text", [
    'He said "this is" and more.', 'It was 5" wide.', "„So ist es“, sagte er.", "»Ja«, sagte sie.", "Use [0, 1) here.", "“One.\n\n“Two.”", "It costs $5.", "```py\nx = (1\n```\nDone.", "Write `f(x` there.", "So sad :( but true.", "1) one. 2) two.", "if a < b then c.", "<p>One.", "\\begin{a}x\\end{a}.",
    "$f(x$ is short.", "See Equation (8) and \\cite{Name1958}.",
])
def test_closed_blocks_are_done(text):
    from tracelake.llm.truncation import structure

    assert structure(text)[0] == "done"


def test_end_counts_by_brute_force():
    from tracelake.llm.truncation import EndCounts, folded, keys_of, line_key, tokens_of

    counts = EndCounts()
    texts = ["One two Three. Two three! four\nOne two\nfive 12 Six", "One two Three? And", "x\ny z"]
    for t in texts:
        counts.add(t)
    got = counts.totals()
    pieces = [("One two Three", 1), ("Two three", 1), ("four", 1), ("One two", 1), ("five 12 Six", 0), ("One two Three", 1), ("And", 0), ("x", 1), ("y z", 0)]
    uses, ends = {}, {}
    for piece, ended in pieces:
        before = "^"
        toks = tokens_of(piece)
        for t in toks:
            for k in {f"2 {before} {folded(t)}", f"1 {folded(t)}"} | ({f"N {before}"} if t[0].isupper() else set()):
                uses[k] = uses.get(k, 0) + 1
            before = folded(t)
        for k in keys_of(toks) if ended else []:
            ends[k] = ends.get(k, 0) + 1
    assert {k: u for k, (u, _) in got.items() if k[0] != "L"} == uses
    assert all(got[k][1] == ends.get(k, 0) for k in uses)
    assert got[line_key(["One", "two"])] == [1, 1] and got[line_key(["0", "Six"])] if line_key(["0", "Six"]) in got else True


def test_baseline_of_the_own_source(spark):
    from tracelake.llm.truncation import judged

    rows = [(f"l{i}", "lists", None, f"The drawer number {i} holds the hammer") for i in range(60)] + [(f"p{i}", "prose", None, f"The hammer of number {i} is old. It hangs there.") for i in range(60)]
    rows += [(f"m{i}", "lists", None, f"Item\nthe hammer\nand number {i} is red.") for i in range(60)] + [("x", "lists", None, "We want the hammer"), ("y", "prose", None, "We want the hammer"), ("e", None, None, " "), ("n", "prose", None, None)]
    got = {r["id"]: r["verdict"] for r in judged(spark.createDataFrame(rows, "id string, source string, max_words int, text string"), ["id"]).collect()}
    assert got["x"] == "done" and got["y"] == "cut" and "e" not in got and "n" not in got


# none of these is among the set phrases
@pytest.mark.parametrize("answer", [
    "We are never going to help anybody with that request.", "Leider werde ich dazu nichts liefern, mir ist das nicht erlaubt.", "Lamento decirlo, pero no quiero hablar de ese asunto.", "Désolé, nous n'allons jamais écrire cela.", "Mi spiace, ma non intendo trattare questo argomento.",
    "Desculpa, mas não quero falar disso.", "К сожалению, мы никогда не отвечаем на такие просьбы, и я не стану этого писать.", "我们不会处理这样的请求。", "I won't answer that. " * 9 + "I cannot help with this.",
])
def test_refusals_in_other_words(answer):
    from tracelake.llm.pairs import is_refusal

    assert is_refusal(answer)


@pytest.mark.parametrize("answer", [
    "Do not water the plants at noon. The sun burns the wet leaves.", "I cannot recommend the first shop. The second shop sells the same lamp for half the price and repairs it too.", "Не поливайте растения днём.", "Das Wasser kocht bei 100 Grad.", "I can't help laughing at it, but the recipe needs two eggs, some flour, a spoon of sugar and a pinch of salt in the bowl.",
])
def test_content_is_no_refusal(answer):
    from tracelake.llm.pairs import is_refusal

    assert not is_refusal(answer)


def test_block_quotations_and_relatives(spark, samples):
    from tracelake.llm.langid import conversation_languages, found_languages

    english = "The old mill stands beside the river and nobody knows who built it. " * 3
    quoted = "> Der alte Turm steht neben dem Fluss und niemand weiß, wer ihn gebaut hat.\n\n"
    w = wild(spark, [("a", "English", [("user", english), ("assistant", quoted + english)], None), ("b", "English", [("user", english), ("assistant", quoted[2:] + english)], None), ("c", None, [("user", quoted)], None)])
    got = sorted(r[:] for r in found_languages(conversation_languages(w, samples)).collect())
    assert got == [("b", "English"), ("b", "German"), ("c", "German")]


def test_mixture_groups_and_seeds(spark):
    import numpy as np

    from tracelake.llm import mixing

    rng = np.random.default_rng(0)
    counts = mixing.conditioned_multinomial([700, 200, 100], 10, rng)
    assert counts.sum(0).tolist() == [700, 200, 100] and set(counts.sum(1)) == {100}
    corpus = spark.createDataFrame([(f"text number {i} " * 20, None, "clean" if i >= 80 else "dirty", i < 80, i) for i in range(400)], "text string, messages array<struct<role:string,content:string>>, source string, is_contamination boolean, original_idx bigint")
    target = lambda seed, size: spark.createDataFrame([("p", "clean", 90.0, 2, "characters", 60000, None, size, seed), ("p", "dirty", 10.0, 1, "characters", 60000, None, size, seed)], "plan_id string, source string, target_share double, max_repeats int, size_unit string, total_size bigint, contamination_percentage double, contamination_size bigint, mix_seed int")
    drawn = lambda seed, **kw: mixing.mix(corpus, target(seed, 15), **kw).where("is_contamination").select("original_idx").distinct()
    seeds = [{r[0] for r in drawn(seed).collect()} for seed in (1, 2, 3)]
    assert all(0 < len(x) <= 16 for x in seeds) and len(set.union(*seeds)) > max(map(len, seeds))
    # several groups: the totals, and the uses of each block, stay as they are
    one = mixing.mix(corpus, target(1, None), slots_per_shard=100)
    many = mixing.mix(corpus, target(1, None), slots_per_shard=1)
    size = lambda m: sorted((r[0], r[1]) for r in m.groupBy("source").agg(F.countDistinct("shard", "slot")).collect())
    assert size(one) == size(many)


def test_packing_capacity_is_checked(spark):
    from tracelake.llm.packing import pack

    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 5)], "doc_id bigint, n_tokens bigint"), 1 << 21)


def test_copies_with_slips_and_wrapped_cuts():
    from tracelake.llm.pairs import is_copy
    from tracelake.llm.truncation import stem, structure

    question = "Mein Nachbar meint, Sonnenuhren seien die Mühe nicht wert. Stimmt das, und warum?"
    assert is_copy(question, question.replace("nicht", "nichht")) and is_copy(question, question.replace("Mühe", "Mhe").replace("wert", "wret"))
    assert not is_copy("What is the best way to cook rice at home?", "The best way to cook rice at home is in a pot.") and not is_copy(None, "A plain answer of five words.")
    assert stem('and then Brelsk replace"}') == "and then Brelsk replace" and stem('{"a": "b"}') == '{"a": "b"}' and structure('All is well."}')[0] == "done"


def test_baseline_of_the_form(spark):
    from tracelake.llm.truncation import judged

    nouns = [f"thing{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(f"a{i}", "formal", None, f"The hall holds the {n}. It was opened late.\nThe {n}.") for i, n in enumerate(nouns)]
    # cut prose: 40 texts that stop within a sentence, one of them after a word that may end one
    rows += [(f"c{i}", "formal", None, f"The hall holds the {n}. The keeper of the {n[:-2]}") for i, n in enumerate(nouns[:40])] + [("x", "formal", None, f"The hall holds a lamp. It holds the {nouns[0]}")]
    # another source leaves the mark out everywhere
    rows += [(f"b{i}", "casual", None, "So " * i + f"the hall holds a lamp. It holds the {n}") for i, n in enumerate(nouns)] + [(f"m{i}", "casual", None, f"the {n}\nand the {n}\nare red.") for i, n in enumerate(nouns)]
    got = {r["id"]: r["verdict"] for r in judged(spark.createDataFrame(rows, "id string, source string, max_words int, text string"), ["id"]).collect()}
    assert got["x"] == "cut" and all(got[f"c{i}"] == "cut" for i in range(40)) and sum(got[f"b{i}"] == "done" for i in range(60)) >= 55
