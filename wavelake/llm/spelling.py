"""Spelling variants: words one edit apart, and the frequent form that each rare word stands for.

Words are counted where they are read. Two near words of at most m code
points agree before and after the place of their edit, so for each m a word is
dealt to *regions* [a, b) of its places: the key of a region is what stands
before a and after b, and near words meet in the region that holds their edit.
There are two regions to begin with, the halves; the region of a key that too
many words share is halved again, down to a single place, where no more words
can meet than an alphabet has letters. So no list of partners is cut, and no
group outgrows a task.

A group keeps a positional q-gram index of what its words have between a and b.
The postings of a word's q-grams, at most one place off, are merged by a heap;
partners that share as many as one edit must leave are verified. A pair counts
in the region that holds its first difference, so it counts once, and what
leaves a group are sums for each word, never pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.llm.textkit import arrow_limits, discard, stored

#: Shortest word, in code points, and least number of occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs this many times as often as its variant.
RATIO = 10
#: Of the crc32 values of occurrences, those that this number divides lose a letter.
MISSPELT = 31
#: Words of a region that one task compares at once, and their bytes; a larger region is halved.
GROUP, GROUP_BYTES = 128, 4 << 20
#: Length of the q-grams of a region.
Q = 2
#: Distinct words that a task counts before it passes them on.
HELD = 200_000

COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])
NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])


def _counting(length: int, misspelt: int | None):
    run = re.compile("[A-Za-zÀ-ÿ]{%d,}" % length)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=COUNTED)

        for batch in batches:
            for doc, text in zip(batch["doc"].to_pylist(), batch["text"].to_pylist(), strict=True):
                # bytes.lower() changes A-Z only.
                found = Counter(run.findall(text.encode().lower().decode()))
                start = zlib.crc32(f"{doc}:".encode())
                for word, n in found.items():
                    if misspelt and not (h := zlib.crc32(word.encode(), start)) % misspelt:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < length:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return count


def words_of(docs: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT, misspelt: int | None = None) -> DataFrame:
    """(word, n): maximal runs of letters of Latin-1, in lower case as to A-Z, that occur `count` times or more.

    With `misspelt`, an occurrence loses the code point h % length where
    `misspelt` divides h, the crc32 of `<doc_id>:<word>`; a null doc_id is
    written as an empty string.
    """
    arrow_limits(docs.sparkSession)
    texts = docs.filter("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_counting(length, misspelt), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


def _keyed(rows: DataFrame, regions) -> DataFrame:
    """A row for each region (m, a, b) of a word, with the region's key."""
    rows = rows.select("word", "n", F.explode(regions).alias("r")).select("word", "n", "r.m", "r.a", "r.b")
    before, after = F.expr("substring(word, 1, a)"), F.expr("substring(word, char_length(word) - (m - b) + 1)")
    return rows.withColumn("key", F.concat_ws("|", "m", "a", "b", before, after))


def _region(m, a, b):
    return F.struct(m.cast("int").alias("m"), a.cast("int").alias("a"), b.cast("int").alias("b"))


def _halves(m, a, b):
    """The two regions that a region falls into; the first is empty for none."""
    mid = F.floor((a + b) / 2)
    return [_region(m, a, mid), _region(m, mid, b)]


def one_edit(s: str, t: str) -> bool:
    """s is t with exactly one letter put in, taken out or replaced."""
    if len(s) < len(t):
        s, t = t, s
    if len(s) - len(t) > 1 or s == t:
        return False
    p = 0
    while p < len(t) and s[p] == t[p]:
        p += 1
    return s[p + 1 :] == t[p + (len(s) == len(t)) :]


def near_in_region(words: list[str], m: int, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Pairs of places in words, the longer of m letters, whose first difference lies in [a, b). All agree outside."""
    wide = b - a
    parts = [w[a : len(w) - (m - b)] for w in words]
    end = words[0][len(words[0]) - (m - b) :][:1]
    # One edit spoils q of the q-grams, padded with q - 1 signs on either side, of the longer part.
    bound = wide + Q - 1 - Q
    index: dict[tuple[int, str], list[int]] = defaultdict(list)
    seen: list[int] = []
    for i, part in enumerate(parts):
        padded = "\x00" * (Q - 1) + part + "\x01" * (Q - 1)
        grams = [(p, padded[p : p + Q]) for p in range(len(padded) - Q + 1)]
        if bound > 0:
            lists = [index[x, g] for p, g in grams for x in (p - 1, p, p + 1) if (x, g) in index]
            found = (j for j, same in groupby(merge(*lists)) if sum(1 for _ in same) >= bound)
        else:  # no q-gram need be shared: a region of one letter, whose words are all near
            found = iter(seen)
        for j in found:
            s, t = (part, parts[j]) if len(part) >= len(parts[j]) else (parts[j], part)
            # Two of the shorter words meet as the longer ones of m - 1. Where the letter that s has
            # more is also the next one after the region, the first difference lies further on.
            if len(s) == wide and one_edit(s, t) and not (len(t) < wide and s[:-1] == t and s[-1] == end):
                yield i, j
        for g in grams:
            index[g].append(i)
        seen.append(i)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple[str, int]]]]:
    """Rows of one key together; they come sorted."""
    key, held = None, []
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("key", "m", "a", "b", "word", "n")]
        for k, m, a, b, word, n in zip(*columns, strict=True):
            if k != key:
                if len(held) > 1:
                    yield at, held
                key, at, held = k, (m, a, b), []
            held.append((word, n))
    if len(held) > 1:
        yield at, held


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a group that has near words there: their number, and the most frequent one."""
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), NEAR, strict=True)], schema=NEAR)

    for (m, a, b), rows in _groups(batches):
        best: dict[int, tuple] = {}
        many: Counter[int] = Counter()
        for i, j in near_in_region([w for w, _ in rows], m, a, b):
            for x, y in ((i, j), (j, i)):
                many[x] += 1
                rank = (-rows[y][1], rows[y][0])
                best[x] = min(best.get(x, rank), rank)
        out += [(rows[x][0], n, -best[x][0], best[x][1]) for x, n in many.items()]
        if len(out) > 10_000:
            yield batch()
            out = []
    if out:
        yield batch()


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n_near, near_n, near): the number of words one edit apart, and the one of largest n, ties to the smallest. Words without any are left out.

    words: distinct (word, n). A region of more than `group` words is halved
    until it has one place; each round is written.
    """
    length = F.char_length("word")
    first = F.array(*[r for m in (length, length + 1) for r in _halves(m, F.lit(0), m)])
    now, small = stored(_keyed(words, first), "regions"), []
    while True:
        large = now.filter("b - a > 1").groupBy("key").agg(F.count("*").alias("c"), F.sum(F.octet_length("word")).alias("bytes")).filter((F.col("c") > group) | (F.col("bytes") > GROUP_BYTES) & (F.col("c") > 1)).select("key")
        large = stored(large, "large-regions")
        small.append(now.join(large, "key", "left_anti"))
        if large.isEmpty():
            break
        halves = F.array(*_halves(F.col("m"), F.col("a"), F.col("b")))
        now = stored(_keyed(now.join(large, "key", "left_semi"), halves), "regions")
    rows = small[0]
    for more in small[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("key", "m", "a", "b", "word", "n").repartition("key").sortWithinPartitions("key")
    sums = rows.mapInArrow(_compared, "word string, n_near bigint, near_n bigint, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("w"))).alias("best")
    return sums.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.k")).alias("near_n"), F.col("best.w").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to. Every form is followed in steps that double in length."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        discard(now)
        now = moved
        if now.filter("went").isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT, ratio: int = RATIO, misspelt: int | None = None, group: int = GROUP) -> DataFrame:
    """One row for each word of the texts: word, form, root, n, n_near, form_n.

    n: occurrences. n_near: words one edit apart. form: the near word of largest
    n (ties: the smallest by code points), if that is `ratio` times the word's
    own n or more, else null; form_n its n. root: the last word that forms lead
    to, the word itself if it has none.

    Null texts have no words; empty texts, texts without letters and empty
    tables give none. Rows that repeat count each time, a null doc_id changes
    nothing but the crc32 of `misspelt`. Texts and words of any length count
    whole; other columns are not read.
    """
    words = stored(words_of(docs, length, count, misspelt), "words")
    near = near_words(words, group)
    known = words.join(near, "word", "left")
    formed = F.col("near_n") >= ratio * F.col("n")
    known = stored(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "variants")
    discard(words)
    last = roots(known.filter("form is not null"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
