"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (1 to 3
characters of a word padded with blanks), by rank. A document's own profile is
compared to each language's by the out-of-place distance: the sum over its
n-grams of how far the ranks lie apart, or `TOP` where the language lacks one.

The profiles are learned from a bounded sample (`PER_LANGUAGE` distinct texts of
each language, or all it has, chosen by a hash of the text). Predictions run
over all documents in one pass without a shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelake.llm.textkit import arrow_limits, gathered, ragged, stored

#: N-grams in a profile.
TOP = 300
#: Distinct texts a language's profile is learned from, at most.
PER_LANGUAGE = 400
#: Languages whose profiles travel together; documents are compared with more of them in blocks.
BLOCK = 5000
#: Rows of a table of languages or of sampled hashes that is broadcast, at most.
MOST_BROADCAST = 200_000

GRAMS = "lang string, gram bigint, n bigint"
STATE_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string()), ("near", pa.string()), ("far", pa.int64()), ("total", pa.int64())])
STATE = "doc_id bigint, held_out boolean, text string, near string, far bigint, total bigint"


def letter_table() -> np.ndarray:
    """Which code points are letters; kept with the process."""
    if "_wavelake_letters" not in sys.__dict__:
        sys.__dict__["_wavelake_letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return sys.__dict__["_wavelake_letters"]


def gram_counts(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, packed in 63 bits, and how often each occurs; none if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letters[codes]
    if not letter.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    # All else is a blank (1); a run of blanks counts as one.
    c = np.where(letter, codes, 1).astype(np.int64)
    c = np.concatenate([[1], c, [1]])
    c = c[np.concatenate([[True], (c[1:] != 1) | (c[:-1] != 1)])]
    two = (c[:-1] << 21) | c[1:]
    three = ((two[:-1] << 21) | c[2:])[c[1:-1] != 1]
    return np.unique(np.concatenate([c[c != 1], two, three]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by the n-gram."""
    if len(counts) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:top]


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of what a task reads, by language."""
    letters = letter_table()
    for table in gathered(batches, "text", 2 << 20):
        langs = table["lang"].to_pylist()
        found: dict[str, list] = {}
        for lang, text in zip(langs, table["text"].to_pylist(), strict=True):
            found.setdefault(lang, []).append(gram_counts(text or "", letters))
        for lang, each in found.items():
            grams, at = np.unique(np.concatenate([g for g, _ in each]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([c for _, c in each]), minlength=len(grams)).astype(np.int64)
            for i in range(0, len(grams), 10_000):
                m = len(grams[i : i + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array(grams[i : i + m]), pa.array(n[i : i + m])], names=["lang", "gram", "n"])


def sample_texts(docs: DataFrame, sizes: DataFrame, keys: DataFrame, per_language: int, languages: int) -> DataFrame:
    """(lang, text): of each language in sizes (lang, c) the per_language distinct texts of least hash, or all c."""
    sizes = F.broadcast(sizes) if languages <= MOST_BROADCAST else sizes
    # The place in hash order is found among those of small hash, never over a whole language.
    wide = 1.3
    while True:
        share = F.least(F.lit(1.0), F.lit(wide * (per_language + 50)) / F.col("c"))
        few = keys.join(sizes, "lang").filter(F.pmod("h", F.lit(1 << 40)) < share * F.lit(float(1 << 40)))
        held = few.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
        if sizes.join(held, "lang", "left").filter(F.coalesce("n", F.lit(0)) < F.least(F.lit(per_language), F.col("c"))).isEmpty():
            break
        wide *= 4
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h"))
    drawn = few.withColumn("r", place).filter(F.col("r") <= per_language).select("lang", "h")
    drawn = F.broadcast(drawn) if languages * per_language <= MOST_BROADCAST else drawn
    # Copies of a text are one: each task sends one of them at most.
    texts = docs.withColumn("h", F.xxhash64("text")).join(drawn, ["lang", "h"], "left_semi")
    return texts.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def learn(docs: DataFrame, top: int = TOP, per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Profiles from docs (text, lang), one for each value of lang, learned from at most per_language distinct texts."""
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    keys = stored(docs.select("lang", F.xxhash64("text").alias("h")).distinct(), "language-texts")
    sizes = stored(keys.groupBy("lang").agg(F.count(F.lit(1)).alias("c")), "languages")
    n = sizes.count()
    if not n:
        return {}
    sample = sample_texts(docs, sizes, keys, per_language, n)
    counts = sample.mapInArrow(_sample_counts, GRAMS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= top)
    best = stored(best.select("lang", "gram", "r"), "language-profiles")
    langs = sorted(r[0] for r in sizes.select("lang").collect())
    out: dict[str, np.ndarray] = {}
    # At most top x BLOCK rows at once.
    for i in range(0, n, BLOCK):
        few = best.filter(F.col("lang").between(langs[i], langs[min(i + BLOCK, n) - 1]))
        table = few.toArrow().combine_chunks().sort_by([("lang", "ascending"), ("r", "ascending")])
        names, grams = table["lang"].to_pylist(), table["gram"].to_numpy()
        at = [k for k in range(len(names)) if not k or names[k] != names[k - 1]] + [len(names)]
        out |= {names[a]: grams[a:b].copy() for a, b in zip(at, at[1:], strict=False) if a < b}
    return out


def _compare(profiles: dict[str, np.ndarray], top: int, last: bool):
    """Keeps the nearest language of the rows' own and these: `near`, and its distance `far` (-1 where there is none yet). The last block drops the text."""
    langs = sorted(profiles)
    size = [len(profiles[x]) for x in langs]
    grams = np.concatenate([profiles[x] for x in langs])
    order = np.argsort(grams, kind="stable")
    # The languages that have an n-gram, and its ranks in them, lie together.
    known, starts = np.unique(grams[order], return_index=True)
    starts = np.append(starts, len(grams))
    who = np.repeat(np.arange(len(langs), dtype=np.int32), size)[order]
    ranks = np.concatenate([np.arange(n, dtype=np.int32) for n in size])[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            near, far, total = batch["near"].to_pylist(), batch["far"].to_pylist(), batch["total"].to_pylist()
            for k, text in enumerate(batch["text"].to_pylist()):
                own = ranked(*gram_counts(text or "", letters), top)
                if not len(own):
                    continue
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                mine = np.flatnonzero(known[at] == own)
                at = at[mine]
                n = starts[at + 1] - starts[at]
                found = ragged(starts[at], n)
                # An n-gram that the language lacks lies `top` apart.
                gain = top - np.abs(ranks[found] - np.repeat(mine, n))
                distance = top * len(own) - np.bincount(who[found], weights=gain, minlength=len(langs)).astype(np.int64)
                i = int(np.argmin(distance))
                total[k] = top * len(own)
                if far[k] < 0 or distance[i] < far[k]:
                    near[k], far[k] = langs[i], int(distance[i])
            texts = pa.nulls(batch.num_rows, pa.string()) if last else batch["text"]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], texts, pa.array(near, pa.string()), pa.array(far, pa.int64()), pa.array(total, pa.int64())], schema=STATE_ARROW)

    return run


def predicted(rows: DataFrame, profiles: dict[str, np.ndarray], top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of rows (doc_id, held_out, text); the profiles are gone through in blocks of languages, in order."""
    langs = sorted(profiles)
    rows = rows.select("doc_id", "held_out", "text", F.lit(None).cast("string").alias("near"), F.lit(-1).cast("bigint").alias("far"), F.lit(1).cast("bigint").alias("total"))
    for i in range(0, len(langs), block):
        rows = rows.mapInArrow(_compare({x: profiles[x] for x in langs[i : i + block]}, top, i + block >= len(langs)), STATE)
    score = F.when(F.col("far") < 0, 0.0).otherwise(1.0 - F.col("far").cast("double") / F.col("total"))
    return rows.select("doc_id", "held_out", F.coalesce("near", F.lit("und")).alias("lang_pred"), score.alias("score"))


def identify(docs: DataFrame, held_out: Column, top: int = TOP, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text, lang).

    Profiles come from rows that are not held out; a row whose held_out is
    null (no doc_id) is not learned from. `und` with score 0 stands for a null
    text or one without a letter, or where nothing could be learned. The score
    is 1 less the distance over the largest distance possible. Equal distances
    go to the first language in code point order. Empty texts have no letter.
    Rows that repeat an id are predicted each by its own text; texts of any
    length count whole; other columns are not read; an empty table gives no
    rows.
    """
    arrow_limits(docs.sparkSession)
    profiles = learn(docs.filter(~held_out).select("text", "lang"), top, per_language)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return predicted(rows, profiles, top)
