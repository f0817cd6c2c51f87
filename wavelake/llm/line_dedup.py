"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

Lines get ids by rank among the distinct lines that occur more than once.
Prefix doubling ranks runs of 1, 2, 4, ... lines: the rank of 2h lines comes
from the ranks of h lines at a place and h places on, sorted and numbered over
range partitions. Suffixes that share h lines form an interval of the suffix
array, which is one rank of that round; those alone in their interval drop
out, and rounds end when none is left or the runs are long enough.

A repeated run counts from `min_words` words or `min_chars` characters on. How many lines that takes from
a place onwards, and up to a place back, is known from the document alone, and
two ranks of a power of two that overlap name the interval of runs of just that
length. All runs of an interval but the first in corpus order are later copies.
A line of a longer repeated run lies in the shortest window that starts at it
or, where the rest of the run is too short, in the shortest one that ends with
the run; so the union of both kinds gives the maximal repeated runs, whose lines
are deleted.

Every rank is given to distinct keys and joined back, so a line that a third
of all documents hold costs one key; the join's other side can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.llm.textkit import arrow_limits, fresh, gathered, partitions, runs, stored

#: Words that make a repeated run worth deleting.
MIN_WORDS = 6
#: Characters other than white space that do so as well, however few words they are.
MIN_CHARS = 16
#: White space, as between words.
SPACE = " \t\n\v\f\r"
PLACE = ["did", "th", "pos"]
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_lines", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])
OUT = "doc_id bigint, th bigint, n_lines bigint, spans array<struct<start:bigint,end:bigint>>, kept string"


def numbered(keys: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Distinct keys with their place in sorted order, from 0.

    Range partitions are sorted and numbered each on its own; the driver adds
    up how many rows each partition has, one number for each.
    """
    n = partitions(keys.sparkSession)
    order = keys.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    local = stored(order.select(*columns, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")), name)
    sizes = {r[0]: r[1] for r in local.groupBy("_p").agg(F.count(F.lit(1))).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p] = total
        total += sizes[p]
    if not before:
        return local.select(*columns, F.lit(0).cast("long").alias("rank"))
    offset = F.element_at(F.array(*[F.lit(before.get(p, 0)) for p in range(max(before) + 1)]), F.col("_p") + 1)
    # The low 33 bits of the id count the rows of a partition.
    return local.select(*columns, (offset + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("rank"))


def ranked(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Rows whose key occurs more than once, with the rank of the key."""
    twice = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c")
    return rows.join(numbered(twice, key, f"{name}-keys"), key)


def with_identity(docs: DataFrame) -> DataFrame:
    """did: the doc_id, null last; th: a hash of the text. Rows equal in both share every decision."""
    return docs.withColumn("did", F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))).withColumn("th", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def copies(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int | None = None) -> DataFrame:
    """(did, th, cuts): for each document with later copies of line runs, their (pos, need) windows."""
    one = with_identity(docs).filter("text is not null")
    lines = one.select("did", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    words = F.regexp_count("line", F.lit("[^\\x20\\x09-\\x0D]+")).cast("int")
    # A line with enough words makes any run long enough, so its characters need no count.
    chars = F.lit(0) if min_chars is None else F.when(F.col("nw") < min_words, F.char_length(F.translate("line", SPACE, ""))).otherwise(0)
    lines = lines.select(*PLACE, "line", words.alias("nw")).select(*PLACE, F.unhex(F.md5("line")).alias("id"), "nw", chars.alias("nc"))
    lines = stored(lines.dropDuplicates(PLACE), "lines")
    level = stored(ranked(lines.select(*PLACE, "id", "nw", "nc"), ["id"], "line-ids").select(*PLACE, "nw", "nc", F.col("rank").alias("r")), "line-ranks")

    # Lines needed from and up to each place: the least runs of repeated lines with enough words or characters.
    island = F.expr("pos - row_number() over (partition by did, th order by pos)")
    by_doc = level.withColumn("g", island).groupBy("did", "th", "g").agg(F.array_sort(F.collect_list(F.struct("pos", "nw", "nc"))).alias("a"))
    needs = stored(by_doc.mapInArrow(_needs(min_words, min_chars), "did bigint, th bigint, pos int, need int"), "line-needs")
    longest = needs.agg(F.max("need")).first()[0] or 0

    levels, h = [level.select(*PLACE, "r")], 1
    while 2 * h <= longest:
        a = levels[-1]
        b = a.select("did", "th", (F.col("pos") - h).cast("int").alias("pos"), F.col("r").alias("r2"))
        levels.append(stored(ranked(a.join(b, PLACE), ["r", "r2"], f"line-pairs-{h}").select(*PLACE, F.col("rank").alias("r")), f"line-ranks-{2 * h}"))
        h *= 2
        if levels[-1].isEmpty():
            break
    found = []
    for k, ranks in enumerate(levels):
        h = 1 << k
        own = needs.filter((F.col("need") >= h) & (F.col("need") < 2 * h))
        last = ranks.select("did", "th", F.col("pos").alias("at"), F.col("r").alias("r2"))
        found.append(own.join(ranks, PLACE).withColumn("at", (F.col("pos") + F.col("need") - h).cast("int")).join(last, ["did", "th", "at"]).select(*PLACE, "need", "r", "r2"))
    runs_ = found[0]
    for f in found[1:]:
        runs_ = runs_.unionByName(f)
    runs_ = stored(runs_, "line-runs")
    key = ["need", "r", "r2"]
    place = F.struct(*PLACE)
    first = runs_.groupBy(*key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    # Written, so that the join below deals out its sides anew and Spark can split a frequent run.
    first = stored(first, "line-firsts")
    later = runs_.join(first, key).filter(place != F.col("first"))
    return later.groupBy("did", "th").agg(F.collect_list(F.struct("pos", "need")).alias("cuts"))


def _needs(min_words: int, min_chars: int | None):
    schema = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("need", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for did, th, a in zip(batch["did"].to_pylist(), batch["th"].to_pylist(), batch["a"], strict=True):
                pos, n = a.values.field("pos").to_numpy(), len(a)
                end, start = np.full(n, n + 1), np.full(n, -1)
                for name, least in (("nw", min_words), ("nc", min_chars)):
                    if least is not None:
                        sums = np.concatenate([[0], np.cumsum(a.values.field(name).to_numpy().astype(np.int64))])
                        end = np.minimum(end, np.searchsorted(sums, sums[:-1] + least))
                        start = np.maximum(start, np.searchsorted(sums, sums[1:] - least, side="right") - 1)
                onwards, back = np.flatnonzero(end <= n), np.flatnonzero(start >= 0)
                # Windows of both kinds, each once.
                first, last = np.divmod(np.unique(np.concatenate([onwards * (n + 1) + end[onwards], start[back] * (n + 1) + back + 1])), n + 1)
                out[0] += [did] * len(first)
                out[1] += [th] * len(first)
                out[2] += pos[first].tolist()
                out[3] += (last - first).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in gathered(batches, "text"):
        counts, spans, kept = [], [], []
        for text, cuts in zip(table["text"].to_pylist(), table["cuts"].to_pylist(), strict=True):
            lines = text.split("\n") if text is not None else []
            counts.append(len(lines))
            if not cuts:
                spans.append([])
                kept.append(text)
                continue
            delta = np.zeros(len(lines) + 1, dtype=np.int64)
            at = np.array([c["pos"] for c in cuts])
            np.add.at(delta, at, 1)
            np.add.at(delta, at + np.array([c["need"] for c in cuts]), -1)
            gone = np.cumsum(delta[:-1]) > 0
            a, b = runs(gone)
            spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            kept.append("\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g))
        yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), table["th"].combine_chunks(), pa.array(counts, pa.int64()), pa.array(spans, OUT_ARROW.field("spans").type), pa.array(kept, pa.string())], schema=OUT_ARROW)


def remove_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int | None = None) -> DataFrame:
    """(doc_id, th, n_lines, spans, kept) for each row of docs (doc_id, text).

    A line is deleted where it lies in a run of lines of `min_words` words or
    more, or of `min_chars` characters other than white space (None: words
    alone count), none of them empty of copies, that also stands earlier: in a
    document of smaller id (null ids last, then by a hash of the text), or
    further up in the same one. Lines end at line feeds alone. `spans` are the
    maximal deleted runs; `kept` the other lines (null for a null text, empty
    if no line stays). Rows equal in id and text are one document, of which
    all carry the same result; rows that repeat an id with other texts are
    documents of their own. `th` is the hash of the text. An empty text is one
    empty line and stays; texts of any length are read whole; other columns are
    not read; an empty table gives no rows.
    """
    arrow_limits(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = copies(docs, min_words, min_chars)
    return with_identity(docs).join(cuts, ["did", "th"], "left").select("doc_id", "th", "text", "cuts").mapInArrow(_rebuilt, OUT)


def _cleaned(column: str):
    """Texts without their cut lines; documents of which nothing but white space is left go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, "text"):
            kept, stays = [], []
            for text, cuts in zip(table["text"].to_pylist(), table[column].to_pylist(), strict=True):
                if cuts:
                    lines = text.split("\n")
                    gone = np.zeros(len(lines), dtype=bool)
                    for c in cuts:
                        gone[c["pos"] : c["pos"] + c["need"]] = True
                    text = "\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g)
                kept.append(text)
                stays.append(not cuts or bool(text.strip(" \t\n\v\f\r")))
            at = table.schema.get_field_index("text")
            table = table.set_column(at, table.schema.field(at), pa.array(kept, table.schema.field(at).type)).drop_columns([column])
            yield from table.filter(pa.array(stays)).combine_chunks().to_batches()

    return run


def clean(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int | None = MIN_CHARS) -> DataFrame:
    """All columns of docs (doc_id, text, ...), the texts without later copies of line runs.

    A document of which only white space is left is a copy itself and goes. Null
    and empty texts stay; rows without an id come after all others.
    """
    arrow_limits(docs.sparkSession)
    cuts = copies(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), min_words, min_chars)
    did, th, mine = (fresh(docs, x) for x in ("_did", "_th", "_cuts"))
    rows = docs.withColumn(did, F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))).withColumn(th, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = rows.join(cuts.toDF(did, th, mine), [did, th], "left").select(*docs.columns, mine)
    return joined.mapInArrow(_cleaned(mine), docs.schema)
