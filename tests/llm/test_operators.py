"""The ten operators on small tables against brute force, with nulls, empties, long texts, ties and repeated rows."""

import hashlib
import random
import tracemalloc

import brute
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavelake.llm import components, decontamination, exact_dedup, jaccard_join, language_id, line_dedup, mixing, queries, toxicity, warc, window_dedup
from wavelake.llm.byte_dedup import remove_repeated_bytes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)


def corpus(seed, n=60):
    """Words from a small vocabulary, passages that documents share, copies, near copies, odd white space."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(1, 6)))
    vocab = [word() for _ in range(400)]
    passages = [" ".join(r.choice(vocab) for _ in range(r.choice((8, 49, 50, 51, 90)))) for _ in range(6)]
    rows = []
    for d in range(n):
        parts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 80)))]
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randint(0, len(parts)), r.choice(passages))
        text = r.choice(("\n", " ", "\t ", "\n\n")).join(parts)
        if rows and r.random() < 0.25:
            text = r.choice(rows)[1] or ""
            if r.random() < 0.6:
                w = text.split(" ")
                w[r.randrange(len(w))] = r.choice(vocab)
                text = " ".join(w)
        rows.append((d * 3 + 1, text))
    rows += [(n * 3 + 2, None), (n * 3 + 3, ""), (n * 3 + 4, " \n\t "), (n * 3 + 5, "one"), (n * 3 + 6, "one two three"), (n * 3 + 7, "a" * 3000), (n * 3 + 8, "ab " * 2000), (n * 3 + 9, "a" * 3000 + "b")]
    r.shuffle(rows)
    return rows


def jaccard(spark, rows, k, p, q, most, pivots):
    return sorted(tuple(r) for r in jaccard_join.jaccard_classes(frame(spark, rows).repartition(3), k, (p, q), most, pivots).collect())


@pytest.mark.parametrize("seed,k,p,q,most,pivots", [(1, 4, 85, 100, 200, 256), (3, 1, 1, 2, 4, 64)])
def test_jaccard(spark, seed, k, p, q, most, pivots):
    rows = corpus(seed)
    assert jaccard(spark, rows, k, p, q, most, pivots) == brute.jaccard(rows, k, p, q)


def test_jaccard_of_a_large_group_of_near_copies(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(40):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(60)] = f"x{r.randrange(1000)}"
        rows.append((d, " ".join(w)))
    assert jaccard(spark, rows, 1, 85, 100, 8, 64) == brute.jaccard(rows, 1, 85, 100)


def test_jaccard_of_sets_of_very_unequal_size(spark):
    """At shares under a half linked sets may differ more than twofold, and so may their signatures."""
    rows = [(i, " ".join(f"g{i // 4}w{k}" for k in range((64, 160, 33, 80)[i % 4]))) for i in range(40)]
    assert jaccard(spark, rows, 1, 2, 5, 200, 256) == brute.jaccard(rows, 1, 2, 5)


def test_jaccard_ids_that_repeat_or_lack(spark):
    a, b, c = "a b c d e f", "g h i j k l", "m n o p q r"
    rows = [(1, a), (1, b), (2, a), (3, b), (4, c), (None, a)]
    got = jaccard_join.jaccard_classes(frame(spark, rows), 2, (4, 5)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (None, None)} and len(got) == 6


@pytest.mark.parametrize("seed", [1, 2])
def test_windows(spark, seed):
    rows = corpus(seed)
    out = window_dedup.remove_repeated_windows(frame(spark, rows).repartition(3), 50).collect()
    got = sorted((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), hashlib.sha256(r.kept.encode()).hexdigest()) for r in out)
    assert got == brute.windows(rows, 50)


@pytest.mark.parametrize("seed,width", [(1, 200), (2, 200), (3, 40), (4, 120)])
def test_bytes(spark, seed, width):
    rows = corpus(seed)
    out = remove_repeated_bytes(frame(spark, rows).repartition(3), width).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out)
    assert got == brute.byte_strings(rows, width)


@pytest.mark.parametrize("seed,least", [(1, 6), (2, 40), (3, 1)])
def test_lines(spark, seed, least):
    r = random.Random(seed)
    lines = [" ".join(f"w{r.randrange(50)}" for _ in range(r.randint(0, 9))) for _ in range(12)]
    rows = [(d, "\n".join(r.choice(lines) for _ in range(r.randint(1, 25)))) for d in range(40)] + [(50, None), (51, ""), (52, "\n\n")]
    out = line_dedup.remove_repeated_lines(frame(spark, rows).repartition(3), least).collect()
    got = sorted((x.doc_id, x.n_lines, sum(s.end - s.start for s in x.spans), len(x.spans), hashlib.sha256((x.kept or "").encode()).hexdigest()) for x in out)
    assert got == brute.lines(rows, least)


@pytest.mark.parametrize("seed,least", [(4, 6), (5, 20)])
def test_maximal_line_runs(spark, seed, least):
    r = random.Random(seed)
    lines = [" ".join(f"w{r.randrange(50)}" for _ in range(r.randint(0, 5))) for _ in range(40)]
    rows = [(d, "\n".join(r.choice(lines) for _ in range(r.randint(1, 25)))) for d in range(20)]
    rows += [(20 + d, "\n".join([f"own{d}", *t.split("\n")[r.randint(0, 3) :], r.choice(lines)])) for d, t in rows]
    rows += [(50, None), (51, "a b c d e f g\nthe end"), (52, "a b c d e f g\nthe end"), (53, "new\na b c d e f g\nthe end\n\nnew")]
    got = {x.doc_id: x.kept for x in line_dedup.remove_repeated_lines(frame(spark, rows).repartition(3), least).collect() if x.doc_id != 50}
    assert got == brute.maximal_line_runs(rows, least) and (least > 6 or (got[52], got[53]) == ("", "new\n\nnew"))


def test_lines_of_few_words(spark, tmp_path):
    thai, footer = "ภาษาไทยไม่มีช่องว่างระหว่างคำ", "All rights reserved"
    rows = [(d, "\n".join([f"own{d}", thai, f"mine{d}", footer, f"last{d}", "short"])) for d in range(4)] + [(4, "half of it\nand all"), (5, "half of it\nand all\nx")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r.n_removed for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert out == {0: 0, 1: 2, 2: 2, 3: 2, 4: 0, 5: 0}
    kept = {r.doc_id: r.text for r in line_dedup.clean(frame(spark, rows)).collect()}
    assert kept[3] == "own3\nmine3\nlast3\nshort"
    by_chars = {r.doc_id: r.kept for r in line_dedup.remove_repeated_lines(frame(spark, rows), min_chars=14).collect()}
    assert by_chars[5] == "x"


def test_cleaned_documents_keep_their_columns(spark):
    rows = [(1, "a b c d e f g\nx"), (2, "a b c d e f g\ny"), (3, "a b c d e f g"), (4, None), (5, "")]
    out = {r.doc_id: r for r in line_dedup.clean(frame(spark, rows).withColumn("did", F.lit(9))).collect()}
    assert out[1].text.startswith("a b") and out[2].text == "y" and 3 not in out and out[4].text is None and out[5].text == "" and out[1].did == 9


def test_contamination(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(words) for _ in range(n))) for i, n in enumerate((20, 13, 30, 4, 2, 1, 0, 13))] + [(8, None), (None, "zz yy xx vv uu tt"), (1, "again " * 14)]
    rows = []
    for d in range(60):
        w = [r.choice(words) for _ in range(r.randint(0, 60))]
        if r.random() < 0.7:
            at = r.randint(0, len(w))
            w[at:at] = (r.choice(items)[1] or "").upper().split()
        rows.append((d, r.choice((" ", ", ", "-")).join(w)))
    rows += [(100, None), (101, ""), (102, "zz-yy xx vv;uu tt"), (102, "x"), (103, "É é" * 20)]
    b = spark.createDataFrame(items, "item_id long, text string")
    for most in (10**6, 50):
        rows_, occurs, windows = decontamination.hits(frame(spark, rows), b, most=most)
        assert rows_.count() == len(rows) and occurs.count() > 0
    out = decontamination.contamination(frame(spark, rows), b).collect()
    got = sorted((x.doc_id, x.n_words, x.n_hit, len(x["items"]), hashlib.sha256(",".join(x["items"]).encode()).hexdigest(), x.contaminated) for x in out)
    assert got == brute.contamination(rows, items)


def test_contamination_without_items(spark):
    out = decontamination.contamination(frame(spark, [(1, "a b")]), spark.createDataFrame([], "item_id long, text string")).collect()
    assert [(x.doc_id, x.n_words, x.n_hit, x.contaminated) for x in out] == [(1, 2, 0, False)]


def test_exact(spark):
    rows = [(5, "a b"), (3, "ab"), (9, "a  b"), (2, "ab "), (7, None), (8, " \n"), (6, ""), (4, "c"), (4, "c"), (-1, "q"), (None, "q"), (None, "zz")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(frame(spark, rows).repartition(4)).collect()}
    assert got == {(5, 9, 4, False), (3, 9, 4, False), (9, 9, 4, True), (2, 9, 4, False), (7, 8, 3, False), (8, 8, 3, True), (6, 8, 3, False), (4, 4, 2, True), (-1, -1, 2, True), (None, -1, 2, False), (None, None, 1, True)}


def test_mixing_comes_near_its_targets(spark):
    r = random.Random(3)
    rows = [(d, " ".join(["w"] * r.randint(1, 40)), "en", r.choice(("a", "b", "c", "d", None)), 0) for d in range(3000)] + [(5000, None, "en", "a", 0), (5001, "", "en", "z", 0), (7, "w", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    one = mixing.mix(docs).orderBy("doc_id", "size").collect()
    assert one == mixing.mix(docs.repartition(7)).orderBy("doc_id", "size").collect() and len(one) == len(rows)
    total = sum(x["size"] for x in one)
    by = {}
    for x in one:
        assert 0 <= x.taken <= 3 * x["size"]
        t = by.setdefault((x.target, x.source_size), [0, x.target, x.source_size])
        t[0] += x.taken
    assert sum(t[1] for t in by.values()) == pytest.approx(total)
    for taken, target, size in by.values():
        assert abs(taken - target) <= 40 and target <= 3 * size + 1e-6


def shares(sizes, weights, most):
    """Targets by plain repetition of the rule."""
    target = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(sum(sizes))
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > most * sizes[i]}
        for i in over or open_:
            target[i] = most * sizes[i] if over else left * weights[i] / w
        if not over:
            break
        left -= sum(most * sizes[i] for i in over)
        open_ -= over
    return target


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=9))
def test_shares(spark, sizes):
    rows = [(f"s{i}", n) for i, n in enumerate(sizes)]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).orderBy("source").collect()
    assert [r.target for r in got] == pytest.approx(shares(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3))


def test_language_on_held_out_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    extra = frame(spark, [(90001, None), (90002, ""), (90003, "12 34 -!"), (90003, "12 34 -!")])
    out = queries_frame = language_id.identify(d.select(*[c.split()[0] for c in DOCS.split(", ")]).unionByName(extra), queries.held_out(4, 2)).collect()
    assert {(r.lang_pred, r.score) for r in out if r.doc_id > 90000} == {("und", 0.0)} and len(queries_frame) == d.count() + 4
    lang = {r.doc_id: r.lang for r in d.collect()}
    held = [r for r in out if r.held_out and r.doc_id < 90000]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in out)


def test_language_profiles_of_many_copies(spark):
    few = [f"kolo tiro {chr(97 + i)}nabe suna" for i in range(10)]
    texts = [(few[i % 10], "xx") for i in range(6000)] + [(f"wug bliv {i} prax dont", "yy") for i in range(500)] + [("wug " * 30, "yy")] * 5000
    got = language_id.learn(spark.createDataFrame(texts, "text string, lang string").repartition(3), per_language=40)
    want = language_id.learn(spark.createDataFrame(sorted(set(texts)), "text string, lang string"), per_language=40)
    assert set(got) == {"xx", "yy"} and all(got[x].tolist() == want[x].tolist() for x in got)
    counts = [language_id.gram_counts(t, language_id.letter_table()) for t in few]
    grams, at = np.unique(np.concatenate([g for g, _ in counts]), return_inverse=True)
    assert got["xx"].tolist() == language_id.ranked(grams, np.bincount(at, weights=np.concatenate([c for _, c in counts])).astype(np.int64), language_id.TOP).tolist()


def test_every_language_is_learned(spark):
    r = random.Random(11)
    words = {f"l{i:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for i in range(230)}
    rows = [(10 * i + k, " ".join(r.choice(w) for _ in range(30)), x) for i, (x, w) in enumerate(words.items()) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs, F.col("doc_id") % 10 == 2).filter("held_out").collect()
    assert len(got) == 230 and all(x.lang_pred == f"l{x.doc_id // 10:03}" for x in got)
    profiles = language_id.learn(docs.filter("doc_id % 10 <> 2"))
    blocks = language_id.predicted(docs.select("doc_id", (F.col("doc_id") % 10 == 2).alias("held_out"), "text"), profiles, block=60).filter("held_out").collect()
    assert sorted(blocks) == sorted(got)
    assert language_id.learn(spark.createDataFrame([("12 3", "xx")], "text string, lang string")) == {}


def test_language_without_anything_to_learn(spark):
    out = language_id.identify(frame(spark, [(1, "abc")]).withColumn("lang", F.lit(None).cast("string")), queries.held_out(4, 2)).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)]


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    r = toxicity.score(d, labels, queries.held_out(5, 0)).join(labels, "doc_id").filter("held_out").collect()
    good = [(x.score, x.toxic) for x in r]
    pos, neg = [s for s, t in good if t], [s for s, t in good if not t]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.8 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in r)


def test_toxicity_ignores_all_but_the_text(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet").drop("n_chars"), spark.read.parquet(f"{SF}/labels.parquet")
    extra = spark.createDataFrame([(90000, None, None, None), (90001, "", "en", "x")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.score for r in toxicity.score(d.unionByName(extra), labels, queries.held_out(5, 0)).collect()}
    assert got[90000] == got[90001]
    none = toxicity.score(d, labels.filter("false"), queries.held_out(5, 0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


def test_toxicity_fit_is_where_the_gradient_vanishes():
    draw = np.random.default_rng(1)
    x, y, ratio = draw.random((300, 40)) < 0.2, (draw.random(300) < 0.3).astype(float), draw.normal(size=40)
    x[7] = False
    nothing = np.zeros(0, dtype=np.uint32)
    parts = [(np.nonzero(x[i : i + 100])[1].astype(np.uint32), x[i : i + 100].sum(axis=1).astype(np.uint32)) for i in (0, 100, 200)]
    w, bias = toxicity.fit_logistic([parts[0], (nothing, nothing), *parts[1:]], ratio, y)
    miss = 1 / (1 + np.exp(-(x @ (ratio * w) + bias))) - y
    assert np.abs(ratio * (x.T @ miss) + w).max() < 0.05 and abs(miss.sum()) < 0.05


def test_toxicity_sample_is_bounded_and_whole(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + "w " * i) for i in range(1, 41)] + [(7, "text 7 " + "w " * 7)] * 50 + [(8, None)] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 41)] + [(3, 0), (4, 2), (None, 1), (7, None)], "doc_id long, toxic int")
    text = {i: f"text {i} " + "w " * i for i in range(1, 41)}
    got = [(r.text, r.toxic) for r in toxicity.sampled(docs, labels, 100, 10_000).collect()]
    # Id 8 has a null text too, which counts once as empty.
    assert sorted(got) == sorted([(t, i % 2) for i, t in text.items()] + [("", 0)])
    for rows, chars in ((5, 10_000), (100, 300)):
        got = [(r.text, r.toxic) for r in toxicity.sampled(docs, labels, rows, chars).collect()]
        assert 0 < len(got) <= rows and sum(len(t) for t, _ in got) <= chars and all(t == "" or t in text.values() for t, _ in got)


def test_toxicity_labels_of_one_kind_and_texts_without_features(spark):
    docs = spark.createDataFrame([(i, "some words here") for i in range(20)] + [(99, None)], "doc_id long, text string")
    for toxic, want in ((1, 0.999), (0, 0.001)):
        labels = docs.selectExpr("doc_id", f"{toxic} toxic")
        assert {round(r.score, 9) for r in toxicity.score(docs, labels, F.lit(False)).collect()} == {want}
    empty = docs.selectExpr("doc_id", "'' text")
    labels = docs.selectExpr("doc_id", "int(doc_id < 7) toxic")
    assert {round(r.score, 9) for r in toxicity.score(empty, labels, F.lit(False)).collect()} == {round(7 / 21, 9)}
    assert toxicity.score(docs.limit(0), labels, F.lit(False)).count() == 0


def test_logistic_fit_reaches_the_optimum():
    rng = np.random.default_rng(5)
    dense = rng.random((60, 30)) < 0.2
    dense[10] = False
    y = (dense[:, :3].sum(axis=1) + rng.random(60) > 1).astype(float)
    ratio = rng.normal(size=30)
    places = [np.flatnonzero(row).astype(np.uint32) for row in dense]
    parts = [(np.concatenate(places[a:b]), np.array([len(p) for p in places[a:b]], dtype=np.uint32)) for a, b in ((0, 25), (25, 60))]
    w, bias = toxicity.fit_logistic(parts, ratio, y)
    x = dense * ratio
    p = 1 / (1 + np.exp(-(x @ w + bias)))
    assert np.abs(x.T @ (p - y) + toxicity.PENALTY * w).max() < 0.01 and abs((p - y).sum()) < 0.01


def test_toxicity_fit_in_tasks_is_the_fit_at_hand(spark):
    draw = np.random.default_rng(3)
    texts = [" ".join(f"word{k}" for k in draw.integers(0, 60, n)) for n in draw.integers(0, 40, 300)]
    docs = spark.createDataFrame([*enumerate(texts), (300, None)], "doc_id long, text string")
    toxic = [int("word7 " in t or draw.random() < 0.1) for t in texts] + [0]
    seen, weights, bias = toxicity.train(docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"))
    row, feature = toxicity.features([*texts, None])
    want, y = np.unique(feature), np.array(toxic, dtype=float)
    assert seen.tolist() == want.tolist()
    ratio = [np.log((np.bincount(feature[y[row] == k], minlength=toxicity.SPACE)[want] + 1) / ((y == k).sum() + 2)) for k in (1, 0)]
    ratio = ratio[0] - ratio[1]
    w, b = toxicity.fit_logistic([(np.searchsorted(want, feature).astype(np.uint32), np.bincount(row, minlength=301).astype(np.uint32))], ratio, y)
    assert np.abs(weights - w * ratio).max() < 1e-9 and abs(bias - b) < 1e-9


def test_toxicity_fit_leaves_the_n_grams_with_the_tasks(spark):
    words = ["".join(x) for x in np.random.default_rng(4).choice(list("abcdefghijklm"), (2000, 6))]

    def peak(n: int) -> int:
        draw = np.random.default_rng(n)
        rows = [(i, " ".join(words[k] for k in draw.integers(0, 2000, 3000))) for i in range(n)]
        docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")
        docs = docs.repartition(4).localCheckpoint()
        tracemalloc.start()
        toxicity.train(docs, labels)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    # Of texts six times as many, over the same words; the driver's arrays go by words and rows alone.
    assert peak(300) < 1.2 * peak(50)


def test_toxic_column_passes_the_others(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("mine")), spark.read.parquet(f"{SF}/labels.parquet")
    out = toxicity.with_score(d, labels, queries.held_out(5, 0))
    assert out.columns == [*d.columns, "_toxicity"] and out.count() == d.count() and out.filter("score <> 'mine'").count() == 0


def test_warc_round_trip(spark, tmp_path):
    warc.register(spark)
    long = "é" * 30 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n" + "x" * 200
    rows = [(3, "http://a/\r\nX: y", long), (1, "http://b", long), (2, "http://c", "short"), (4, "http://d", "short"), (5, "http://e", None), (6, None, ""), (7, "http://f", "y" * 70_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = f"file://{tmp_path}/w"
    warc.archive(pages, path)
    for split in (1 << 20, 100):
        got = {int(r.record_id[10:-1]): r for r in spark.read.format("warc").option("split", split).load(path).collect()}
        assert set(got) == {1, 2, 3, 4, 5, 6, 7}
        assert got[3].record_type == "revisit" and got[3].refers_to == "<urn:page:1>" and got[3].payload is None and got[3].payload_length == len(long.encode())
        assert got[1].payload.decode() == long and got[2].payload == got[4].payload == b"short" and got[5].payload == got[6].payload == b"" and len(got[7].payload) == 70_000
    only = spark.read.format("warc").load(path).filter("record_type = 'revisit'")
    assert only.count() == 1
    assert spark.read.format("warc").option("payload", "false").load(path).filter("payload is not null").count() == 0


def test_plain_files_are_split_between_records(spark, tmp_path):
    warc.register(spark)
    rows = [{"record_id": f"<urn:page:{i}>", "record_type": "response", "target_uri": "u", "refers_to": None, "payload_digest": "d", "payload_length": 10 + i, "payload": b"p" * (10 + i)} for i in range(50)]
    (tmp_path / "x.warc").write_bytes(b"".join(warc.record(r) for r in rows))
    for split in (64, 300, 1000, 1 << 20):
        got = spark.read.format("warc").option("split", split).load(f"{tmp_path}/x.warc").collect()
        assert sorted(r.record_id for r in got) == sorted(r["record_id"] for r in rows) and all(len(r.payload) == r.payload_length for r in got)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r_.v: r_.c for r_ in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


EMPTY = ["op1_jaccard_join", "op3_mix_sources", "op4_suffix_dedup", "op5_language_id", "op6_line_dedup", "op7_exact_dedup", "op8_window_dedup"]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op10_warc", "op11_conversation_trie", "op12_packing", "op13_spelling_variants"}))
def test_odd_rows_and_extra_columns(spark, tmp_path, name):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "x y z", None, None, 5), (900, "", "en", "", 0), (900, "", "en", "", 0), (901, "zz " * 40_000, "en", "s", 120_000)], DOCS)
    docs = d.unionByName(odd)
    for c in ("score", "kept", "part", "told", "th", "size", "target", "g"):
        docs = docs.withColumn(c, F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 45


def test_warc_repeated_pages_and_odd_columns(spark, tmp_path):
    warc.register(spark)
    h = "h" * 150
    rows = [(1, "u", h), (1, "u", h), (2, "u", h), (None, "u", h), (None, None, None), (3, "u", "k" * 150), (3, "v", "m" * 150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_sha", F.lit("x")).withColumn("payload", F.lit(1)).repartition(3)
    warc.archive(pages, f"file://{tmp_path}/w")
    got = sorted((r.record_id or "", r.record_type, r.refers_to or "", r.payload_length) for r in spark.read.format("warc").load(f"file://{tmp_path}/w").collect())
    assert got == sorted(
        [("<urn:page:1>", "response", "", 150), ("<urn:page:1>", "revisit", "<urn:page:1>", 150), ("<urn:page:2>", "revisit", "<urn:page:1>", 150), ("", "response", "", 150), ("", "response", "", 0), ("<urn:page:3>", "response", "", 150), ("<urn:page:3>", "response", "", 150)]
    )


def test_warc_records_inside_payloads_and_broken_files(spark, tmp_path):
    warc.register(spark)
    inner = warc.record({"record_id": "<urn:page:999>", "record_type": "response", "target_uri": "u", "refers_to": None, "payload_digest": "d", "payload_length": 5, "payload": b"inner"})
    rows = [{"record_id": f"<urn:page:{i}>", "record_type": ("response", "revisit")[i % 3 == 2], "target_uri": "u", "refers_to": None, "payload_digest": "d", "payload_length": 1, "payload": b"x" * i + b"\r\n\r\n" + inner * 3} for i in range(20)]
    whole = b"".join(warc.record(r) for r in rows)
    (tmp_path / "a.warc").write_bytes(whole)
    for split in (50, 700, 1 << 20):
        got = spark.read.format("warc").option("split", split).load(f"{tmp_path}/a.warc").collect()
        assert sorted(r.record_id for r in got) == sorted(r["record_id"] for r in rows)
        assert spark.read.format("warc").option("split", split).load(f"{tmp_path}/a.warc").filter("record_type = 'revisit'").count() == 6
    import gzip

    packed = gzip.compress(whole)
    (tmp_path / "b.warc.gz").write_bytes(packed)
    assert spark.read.format("warc").load(f"{tmp_path}/b.warc.gz").count() == 20
    for name, data in (("c.warc", b"stray\r\n" + whole), ("d.warc", whole[:-30]), ("e.warc.gz", packed[:-40])):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="no record begins|cut off"):
            spark.read.format("warc").load(f"{tmp_path}/{name}").collect()


def test_exact_rows_that_repeat_an_id(spark):
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(frame(spark, [(1, "a b"), (1, "a  b"), (2, "ab"), (None, "ab     ")])).collect() if r.doc_id is not None)
    assert got == [(1, 1, 4, False), (1, 1, 4, True), (2, 1, 4, False)]


def test_bytes_of_rows_without_an_id(spark):
    t = "".join(chr(97 + i * i % 23) for i in range(500))
    out = remove_repeated_bytes(frame(spark, [(None, t), (3, t), (None, "own text"), (None, None)]).withColumn("at", F.lit(1)), 200).collect()
    assert sorted((r.n_bytes, len(r.kept)) for r in out) == [(0, 0), (8, 8), (500, 0), (500, 0)]


def test_jaccard_size_of_rows_without_an_id(spark):
    rows = [(None, "a b c d"), (1, "e f g"), (1, "h i j"), (None, None), (2, ""), (3, "w " * 9000 + "x")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_join.jaccard_classes(frame(spark, rows).withColumn("rep", F.lit("clash")), 2).collect())
    assert got == [(0, 0, 0), (0, 3, 0), (1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 2, 3)]


@pytest.mark.parametrize("seed,most,pivots,signed,frequent", [(1, 8, 4, 9000, 2000), (2, 4, 3, 5, 0)])
def test_jaccard_divides_groups_by_pivots(spark, monkeypatch, seed, most, pivots, signed, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    r = random.Random(seed)
    rows = []
    for d in range(120):
        w = [f"w{i}" for i in range(60)]
        for _ in range(r.randint(0, 16)):
            w[r.randrange(60)] = f"x{r.randrange(1000)}"
        rows.append((d, " ".join(w)))
    got = sorted(tuple(x) for x in jaccard_join.jaccard_classes(frame(spark, rows).repartition(3), 1, (85, 100), most, pivots, signed).collect())
    assert got == brute.jaccard(rows, 1, 85, 100)


def test_mixing_spreads_rows_of_one_id(spark):
    rows = [(7, "w w w", "en", "a", 0)] * 5000 + [(None, "w w", "en", "a", 0)] * 300 + [(d, "w", "en", "b", 0) for d in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    one = sorted(tuple(x) for x in mixing.mix(docs).select(F.coalesce("doc_id", F.lit(-1)), "size", "source_size", "taken").collect())
    assert one == sorted(tuple(x) for x in mixing.mix(docs.repartition(5)).select(F.coalesce("doc_id", F.lit(-1)), "size", "source_size", "taken").collect()) and len(one) == 5700
    by = {r.source_size: (r.t, r.target) for r in mixing.mix(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()}
    assert all(abs(t - target) <= 3 for t, target in by.values())
    assert mixing.placed(docs.select("source", F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("size"))).groupBy("id").agg(F.countDistinct("k").alias("n")).filter("id = 7").first().n == 5000
