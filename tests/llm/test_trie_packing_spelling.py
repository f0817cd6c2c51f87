"""The trie, packing and spelling operators on small tables against brute force, with odd rows and small limits."""

import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavelake.llm import conversation_trie, packing, queries, spelling

TURNS = "conv_id long, turn long, role string, text string"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def talks(seed, n=80):
    """Conversations that share first turns, copies, one long pair, ties, nulls, empties and repeated rows."""
    r = random.Random(seed)
    said = [(r.choice(("user", "assistant", None)), r.choice((None, "", "a b", "c", " d  e ", f"f{i}"))) for i in range(5)]
    rows = []
    for c in range(-20, n):
        if c % 20 == 0 and c % 3 == 0:
            continue  # a group without its first conversation
        rows += [(c, t if r.random() < 0.9 else None, *r.choice(said)) for t in range(r.randint(1, 6))]
    for c in (1000, 1001):
        rows += [(c, t, "user", f"long {t}") for t in range(60)]
    rows += [(c, t, "user", f"copy {t}") for c in range(2000, 2040) for t in range(3)]
    rows += [(None, 1, "user", "nobody"), (3000, None, None, None), (3001, 1, "user", "same"), (3001, 1, "user", "same"), (3001, 1, "assistant", "same")]
    r.shuffle(rows)
    return rows


def nodes(frame):
    return sorted(tuple(-1 if x is None else x for x in r) for r in frame.collect())


@pytest.mark.parametrize("seed,rebuild,local", [(1, (20, 4), 2048), (2, (20, 4), 6), (3, None, 0)])
def test_trie(spark, seed, rebuild, local):
    rows = talks(seed)
    frame = spark.createDataFrame(rows, TURNS).repartition(5)
    assert nodes(conversation_trie.conversation_trie(frame, rebuild, local)) == brute.trie(rows, rebuild)


def test_trie_paths_and_ends_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 4)
    rows = talks(4)
    assert nodes(conversation_trie.conversation_trie(spark.createDataFrame(rows, TURNS), None, 10)) == brute.trie(rows)


@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=6), min_size=2, max_size=12))
def test_local_nodes(seqs):
    seqs = [[9, *s] for s in seqs]  # all share a first turn
    rows = [(c, t, "r", f"{x} x") for c, s in enumerate(seqs) for t, x in enumerate(s)]
    got = conversation_trie.local_nodes([(c, s, [2] * len(s)) for c, s in enumerate(seqs)], 1, -7)
    assert sorted(got) == [(*n[:2], -7 if n[1] == 1 else n[2], *n[3:]) for n in brute.trie(rows) if n[1]]


def test_trie_of_turnless_conversations_and_empty_tables(spark):
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    out = conversation_trie.conversation_trie(spark.createDataFrame(rows, TURNS), (20, 4)).collect()
    assert [tuple(r)[:7] for r in out] == [(c, 0, None, 1, 0, 1, 0)]
    for odd in ([], [(None, 1, "user", "x")]):
        assert conversation_trie.conversation_trie(spark.createDataFrame(odd, TURNS)).count() == 0


def test_trie_query_over_columns_that_clash(spark, tmp_path):
    frame = spark.createDataFrame(talks(5), TURNS)
    for c in ("b", "d", "n", "id", "pos", "words", "last"):
        frame = frame.withColumn(c, F.lit("clash"))
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    assert nodes(queries.op11_conversation_trie(spark, str(tmp_path))) == brute.trie(talks(5), (20, 4))


def packed(spark, rows, tokenizer=WORDS, window=64):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = packing.pack(frame, tokenizer, window).collect()
    t = Tokenizer.from_file(tokenizer)
    want = sorted((d if d is not None else -1, np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, x in rows)
    return out, want


def check_windows(out, window):
    by = {}
    for p in out:
        by.setdefault(p.sequence_id, []).append(p)
    sizes = []
    for pieces in by.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0 and len(p.ids) == 4 * p.length
            at += p.length
        sizes.append(at)
    short = [x for x in sizes if x != window]
    assert all(x < window and x & (x - 1) == 0 for x in short) and len(short) == len(set(short))
    total = sum(p.length for p in out)
    assert sizes.count(window) == total // window


TEXTS = ["", " \n\t", "One, two; THREE's 1234 don't", "Éa ñ ß İ ſ", "a\x1cb c\x1d", "x<|endoftext|>y <|startoftext|> z", "é  　 漢字 🙂", "word " * 700, "a" * 5000, "İΣ Σ"]


@pytest.mark.parametrize("tokenizer", [WORDS, BYTES])
def test_packing_keeps_every_id(spark, tokenizer):
    r = random.Random(1)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(r.choice(("ab", "Cd", "ee.", "12")) for _ in range(r.randint(0, 90)))) for i in range(150)]
    rows += [(500, None)]
    out, want = packed(spark, rows, tokenizer)
    docs = {}
    for p in sorted(out, key=lambda p: (p.doc_id, p.start)):
        held = docs.setdefault(p.doc_id, [])
        assert p.start == sum(len(x) for x in held) // 4
        held.append(p.ids)
    assert sorted((d, b"".join(x)) for d, x in docs.items()) == want
    assert all(p.doc_tokens == sum(len(x) for x in docs[p.doc_id]) // 4 for p in out)
    check_windows(out, 64)


def test_packing_rows_without_an_id_and_repeated_rows(spark):
    rows = [(None, "a b c"), (None, "a b c"), (7, "x"), (7, "x"), (7, None), (None, None)]
    out, want = packed(spark, rows)
    assert sorted(-1 if p.doc_id is None else p.doc_id for p in out if p.start == 0) == [d for d, _ in want]
    assert sum(len(p.ids) for p in out) == sum(len(x) for _, x in want)
    check_windows(out, 64)


def test_packing_empty_table_and_columns_that_clash(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for c in ("task", "length", "number", "ids", "start"):
        frame = frame.withColumn(c, F.lit("clash"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_packing(spark, str(tmp_path)).collect()
    # Three ids become windows of 2 and 1.
    assert sorted((p.doc_id, p.start, p.length, p.doc_tokens, p.offset) for p in out) == [(1, 0, 2, 3, 0), (1, 2, 1, 3, 0)]
    ids = [*Tokenizer.from_file(WORDS).encode("a b", add_special_tokens=False).ids, 1]
    assert {p.start: p.ids_crc32 for p in out} == {0: zlib.crc32(np.array(ids[:2], "<u4").tobytes()), 2: zlib.crc32(np.array(ids[2:], "<u4").tobytes())}
    assert packing.pack(frame.limit(0), WORDS).count() == 0


def test_slices_cut_at_white_space_only():
    text = "ab cde  f" * 50 + "x" * 200 + " y"
    parts = list(packing.slices(text, 20))
    assert "".join(parts) == text and len(parts) > 5 and all(p[0] == " " for p in parts[1:])
    assert list(packing.slices("", 20)) == [""]


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 5), min_size=1), st.integers(1, 20))
def test_fullest_is_the_best_sum_with_the_longest(have, capacity):
    chosen = packing.fullest(have, capacity)
    fits = [x for x in have if x <= capacity]
    assert all(0 < n <= have[x] for x, n in chosen.items())
    sums = {0}
    for x in fits:
        sums = {s + k * x for s in sums for k in range(have[x] + 1 - (x == max(fits)))}
    best = max((s + max(fits) for s in sums if s + max(fits) <= capacity), default=0) if fits else 0
    assert sum(x * n for x, n in chosen.items()) == best


@given(st.dictionaries(st.integers(1, 31), st.integers(1, 300), max_size=8))
def test_plan_lays_every_id_once(histogram):
    rows, windows = packing.planned(histogram, 32)
    ids, filled = set(), {}
    for length, first, count, start, piece, sequence, at, times, offset in rows:
        for i in range(count):
            more, slot = divmod(at + i, times)
            assert sequence + more < windows
            for k in range(piece):
                ids.add((length, first + i, start + k))
                place = (sequence + more, offset + slot * piece + k)
                assert place not in filled
                filled[place] = True
    assert len(ids) == len(filled) == sum(x * n for x, n in histogram.items())
    assert ids == {(x, i, k) for x, n in histogram.items() for i in range(n) for k in range(x)}
    ends = {}
    for w, o in filled:
        ends[w] = max(ends.get(w, 0), o + 1)
    short = [e for e in ends.values() if e != 32]
    assert sum(ends.values()) == len(filled) and all(e & (e - 1) == 0 for e in short) and len(set(short)) == len(short)


def prose(seed):
    r = random.Random(seed)
    stems = ["colour", "honour", "traveller", "aaabaaa", "abababab", "élèvesÀ", "Straßenbahn"]
    rows = []
    for d in range(60):
        words = []
        for _ in range(r.randint(0, 60)):
            w = r.choice(stems) * r.choice((1, 1, 2))
            if r.random() < 0.3:
                i = r.randrange(len(w))
                w = r.choice((w[:i] + w[i + 1 :], w[:i] + r.choice("abÿ") + w[i:], w[:i] + r.choice("abÿ") + w[i + 1 :]))
            words.append(w.upper() if r.random() < 0.2 else w)
        rows.append((d, r.choice((" ", "-", "1", "Ā")).join(words)))
    return rows + [(None, "colours colours colourss"), (None, None), (70, ""), (70, "12 !? 漢字"), (71, "b" * 300 + " " + "b" * 299 + " " + "b" * 300 + " " + "b" * 299)]


def found(frame):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in frame.collect())


@pytest.mark.parametrize("seed,length,count,ratio,misspelt,group", [(1, 7, 2, 10, 31, 128), (2, 7, 2, 3, 5, 1), (3, 5, 1, 2, None, 4)])
def test_spelling(spark, seed, length, count, ratio, misspelt, group):
    rows = prose(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(spelling.spelling_variants(frame, length, count, ratio, misspelt, group)) == brute.variants(rows, length, count, ratio, misspelt)


@settings(suppress_health_check=[HealthCheck.too_slow], deadline=None)
@given(st.lists(st.text("ab", min_size=3, max_size=7), min_size=2, max_size=25, unique=True), st.booleans())
def test_regions_meet_each_near_pair_once(words, deep):
    """Halved to the end or not, all regions together yield the pairs of brute force, each once."""
    pairs = []
    for m in range(3, 9):
        regions = [(i, i + 1) for i in range(m)] if deep else [(0, m // 2), (m // 2, m)]
        for a, b in regions:
            keys = {}
            for w in words:
                if len(w) in (m, m - 1):
                    keys.setdefault((w[:a], w[len(w) - (m - b) :]), []).append(w)
            for group in keys.values():
                pairs += [tuple(sorted((group[i], group[j]))) for i, j in spelling.near_in_region(group, m, a, b)]
    assert sorted(pairs) == sorted((s, t) for s in words for t in words if s < t and brute.one_edit(s, t))


def test_roots_of_a_long_chain(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(18)] + [("x", "w17")]
    out = {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert out == {w: "w18" for w, _ in forms}


def test_spelling_empty_table_and_columns_that_clash(spark, tmp_path):
    frame = spark.createDataFrame([(1, "xcolours colours1colours_colours")], "doc_id long, text string")
    for c in ("word", "n", "key", "m", "doc"):
        frame = frame.withColumn(c, F.lit("clash"))
    assert found(spelling.spelling_variants(frame)) == [("colours", "", "colours", 3, 0, -1)]
    assert spelling.spelling_variants(frame.limit(0)).count() == 0
