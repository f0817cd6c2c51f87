"""Corpus pipeline: five stages from raw documents to a mixed corpus.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents;
the last one adds how often a document is taken. run() writes each stage's
rows to the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm.decontamination import contamination
from wavelake.llm.jaccard_join import jaccard_classes
from wavelake.llm.line_dedup import clean
from wavelake.llm.mixing import mix, word_count
from wavelake.llm.queries import held_out, table
from wavelake.llm.textkit import fresh, stored
from wavelake.llm.toxicity import with_score
from wavelake.operators.ordered import numbered


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of score 0.5 or more go; the model is trained on the labels that are not held out.

    Each row is judged by its own text, with or without an id. Null and empty
    texts score the bias alone.
    """
    out = fresh(docs, "_toxicity")
    scored = with_score(docs, table(spark, sf_dir, "labels"), held_out(5, 0), out=out)
    return scored.filter(F.col(out) < 0.5).drop(out)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go, and documents that consist of them.

    Null and empty texts stay. Rows without an id come after all others; rows
    equal in id and text are one document.
    """
    out = clean(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def with_row(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """docs with a key of the row, the key's name, and whether some doc_id is null or repeats; else the doc_id is the key."""
    row = fresh(docs, "_row")
    odd = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn(row, F.col("doc_id").cast("bigint")), row, False
    # Written, so that a row has the same key each time it is read.
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row, True


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at five-word shingles and 0.8 one document stays: that of smallest id, null last.

    Each row is a document by its own text; of rows with one id, or without,
    the one with the smallest hash of the text stays, of equal rows any. So
    which one stays depends on the group alone. Null and empty texts link
    with nothing and stay.
    """
    rows, row, odd = with_row(docs)
    classes = jaccard_classes(rows.select(F.col(row).alias("doc_id"), "text"), k=5, share=(4, 5))
    if not odd:
        gone = classes.filter("component_id <> doc_id").select(F.col("doc_id").alias(row))
        return rows.join(gone, row, "left_anti").select(*docs.columns)
    classes = stored(classes.select(F.col("doc_id").alias("r"), F.col("component_id").alias("c")), "classes")
    linked = classes.filter("r <> c").select("c").distinct()
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.sha2("text", 256), F.col(row))
    members = classes.join(linked, "c").join(rows.select(F.col(row).alias("r"), rank.alias("rank")), "r")
    members = stored(members, "members")
    # Written, so that the join deals out its sides anew and Spark can split a large group.
    first = stored(members.groupBy("c").agg(F.min("rank").alias("first")), "first")
    gone = members.join(first, "c").filter("rank <> first").select(F.col("r").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words stand in benchmark windows go, each row by its own text, with or without an id."""
    rows, row, _ = with_row(docs)
    judged = contamination(rows, table(spark, sf_dir, "benchmark"), id_col=row)
    gone = judged.filter("contaminated").select(row)
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with `copies`, how often; rows without a doc_id too. Texts without words are not taken.

    Draws go by doc_id (the hash of the text for rows without one), size and
    place among equal rows, whatever the partitions and other rows' ids.
    Where ids repeat, rows of one source, id and size get the mix's rows for these
    in the order of their texts.
    """
    rows, row, odd = with_row(docs)
    copies, key, size = (fresh(rows, x) for x in ("copies", "_key", "_size"))
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).cast("int")
    if not odd:
        taken = mix(rows, id_col=row).filter("taken > 0").select(row, times.alias(copies))
        return rows.join(taken, row).select(*docs.columns, copies)
    rows = rows.withColumns({key: F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text")), size: word_count(F.col("text"))})
    drawn = stored(mix(rows, id_col=key, with_source=True).withColumn("n", F.monotonically_increasing_id()), "drawn")
    drawn = numbered(drawn.select(F.col("source").alias("s"), F.col(key).alias("k"), F.col("size").alias("z"), "taken", times.alias(copies), "n"), ["s", "k", "z"], ["taken", "n"], "place")
    text, place = fresh(rows, "_text"), fresh(rows, "_place")
    mine = rows.select(row, F.col("source").alias("_s"), F.col(key).alias("_k"), F.col(size).alias("_z"), F.sha2("text", 256).alias(text))
    mine = numbered(mine, ["_s", "_k", "_z"], [text, row], place)
    same = F.col("_s").eqNullSafe(F.col("s")) & (F.col("_k") == F.col("k")) & (F.col("_z") == F.col("z")) & (F.col(place) == F.col("place"))
    taken = mine.join(drawn.filter("taken > 0"), same).select(row, copies)
    return rows.join(taken, row).select(*docs.columns, copies)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]

#: SQL cannot express the classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
