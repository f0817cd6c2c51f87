"""The pipeline's stages on a small corpus with planted cases."""

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    base = " ".join(f"unseen{i}" for i in range(120))
    near = base.replace("unseen60", "changed")
    planted = spark.createDataFrame([(80001, base), (80002, near), (80003, "clean " + " ".join(f"own{i}" for i in range(40))), (80004, passage)], "doc_id long, text string")
    docs = docs.unionByName(planted.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.length("text").cast("long").alias("n_chars")))
    left = {80001, 80002, 80003, 80004}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "n-gram Jaccard join":
            left.discard(80002)
        if name == "benchmark decontamination":
            left.discard(80004)
        if name != "mixing sources":
            assert ids & {80001, 80002, 80003, 80004} == left, name
            docs = spark.createDataFrame(out.collect(), out.schema)
    assert out.filter("copies < 1 or copies > 3").count() == 0
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_rows_without_a_single_id(spark):
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    texts = [(None, passage), (None, "null one " * 9), (None, "null one " * 9), (7, passage), (7, "clean own words")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert sorted(r.text for r in out.collect()) == ["clean own words", "null one " * 9, "null one " * 9]
    mixed = corpus_pipeline.mix_sources(spark, out, SF)
    taken = corpus_pipeline.mix(out).agg({"taken": "sum"}).first()[0]
    assert mixed.filter("doc_id is null").count() == 2 and mixed.selectExpr("sum(copies * size(split(trim(text), ' ')))").first()[0] == taken


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], DOCS)


def test_the_survivor_of_a_group_does_not_hang_on_other_rows(spark):
    base = " ".join(f"unseen{i}" for i in range(120))
    near = base.replace("unseen60", "changed")
    group = [(9, base, "s"), (3, near, "s")]
    for more in ([], [(None, "an unrelated row", "s")], [(5, "one", "s"), (5, "two", "s")]):
        # The row of smaller id lies behind the other one.
        kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, group + more).coalesce(1), SF).collect()}
        assert 3 in kept and 9 not in kept and len(kept) == 1 + bool(more)
    nulls = [(None, base, "s"), (7, near, "s"), (7, base, "s"), (None, None, "s"), (None, "", "s")]
    out = corpus_pipeline.drop_near_duplicates(spark, frame(spark, nulls), SF).collect()
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in out) == sorted([(0, 0), (0, 0), (7, len(min((near, base), key=lambda t: hashlib.sha256(t.encode()).hexdigest())))])


def test_the_mix_of_odd_rows_is_reproducible(spark):
    rows = [(i if i % 7 else None, f"w{i} " * (i % 30), "abc"[i % 3] if i % 11 else None) for i in range(200)] + [(500, "same text here", "a")] * 6
    rows += [(500, "other text here", "a"), (None, None, "a")]
    draw = lambda docs: sorted((r.doc_id or -1, r.text, r.source or "", r.copies) for r in corpus_pipeline.mix_sources(spark, docs, SF).collect())
    first = draw(frame(spark, rows).repartition(1))
    assert first == draw(frame(spark, rows[::-1]).repartition(5)) and first
    mixed = corpus_pipeline.mix(frame(spark, rows).selectExpr("coalesce(doc_id, xxhash64(text)) as doc_id", "text", "source"))
    assert sum(c * len(t.split()) for _, t, _, c in first) == mixed.agg({"taken": "sum"}).first()[0]
    # Rows with an id of their own draw as they do where all have one.
    even = [r for r in rows if r[0] is not None and r[0] != 500]
    assert {x[0] for x in draw(frame(spark, even))} <= {r[0] for r in even}


def test_stages_with_odd_rows_empty_tables_and_columns_that_clash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = frame(spark, [(None, None, None), (None, "x y z", None), (900, "", "s"), (900, "", "s"), (901, "zz " * 20_000, "s")])
    clash = docs.unionByName(odd)
    for c in ("copies", "_row", "_cuts", "_toxicity", "_key", "_size"):
        clash = clash.withColumn(c, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clash, SF)
        assert out.columns[: len(clash.columns)] == clash.columns and 0 < out.count() <= 65, name
        assert out.filter(" and ".join(f"{c} = 'clash'" for c in clash.columns[5:])).count() == out.count()
        assert stage(spark, docs.limit(0), SF).count() == 0
