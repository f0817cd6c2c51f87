"""The queries of this subpackage, by the names that __spark_entry__ registers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm.textkit import arrow_limits, expire, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(mod: int, rest: int) -> Column:
    """crc32 of the doc_id as text, modulo mod, is rest."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)) == rest


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavelake.llm.jaccard_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"), k=4, share=(85, 100))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavelake.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out(5, 0))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavelake.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavelake.llm.byte_dedup import remove_repeated_bytes

    out = remove_repeated_bytes(table(spark, sf_dir, "documents"), width=200)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavelake.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"), held_out(4, 2))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavelake.llm.line_dedup import MIN_CHARS, remove_repeated_lines

    out = remove_repeated_lines(table(spark, sf_dir, "documents"), min_chars=MIN_CHARS)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_lines", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavelake.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavelake.llm.window_dedup import remove_repeated_windows

    out = remove_repeated_windows(table(spark, sf_dir, "documents"), width=50)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavelake.llm.decontamination import contamination

    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavelake.llm.warc import archive, register

    arrow_limits(spark)
    register(spark)
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive(table(spark, sf_dir, "pages"), path)
    expire(spark, path)
    read = spark.read.format("warc").load(path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1)
    responses = read.filter("record_type = 'response'").select(
        page("record_id").alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("string").alias("refers_to")
    )
    revisits = spark.read.format("warc").option("payload", "false").load(path).filter("record_type = 'revisit'").select(
        page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to")
    )
    kind = table(spark, sf_dir, "pages").schema["page_id"].dataType
    return responses.unionByName(revisits).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavelake.llm.conversation_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"), rebuild=(20, 4))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from wavelake.llm.packing import pack

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavelake.llm.spelling import MISSPELT, spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), misspelt=MISSPELT)


QUERIES = {
    f.__name__: f
    for f in (
        op1_jaccard_join, op2_toxicity, op3_mix_sources, op4_suffix_dedup, op5_language_id,
        op6_line_dedup, op7_exact_dedup, op8_window_dedup, op9_decontaminate, op10_warc,
        op11_conversation_trie, op12_packing, op13_spelling_variants,
    )
}

#: A table of 256 numbers, t, by which the next byte of a crc32 is looked up.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS t"
#: crc32 of the bytes in a list.
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"
#: The bytes of a text in UTF-8.
BYTES = "list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: (instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1)"

ORACLES = {
    "op7_exact_dedup": r"""
        WITH b AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
        g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM b GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM b JOIN g USING (norm)
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
        f AS (SELECT h, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY h)
        SELECT page_id, payload_bytes, sha256(p.h) AS payload_digest,
               CASE WHEN f.first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first <> page_id THEN f.first END AS refers_to
        FROM p LEFT JOIN f ON p.h = f.h AND payload_bytes >= 100
    """,
    "op8_window_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
        f AS (SELECT t, min(doc_id) AS first FROM win GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (t) WHERE first < doc_id),
        g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY 1),
        kept AS (SELECT d.doc_id, string_agg(d.w[i], ' ' ORDER BY i) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) d LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.p = d.i WHERE gone.p IS NULL GROUP BY 1)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op9_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS t, least(len(w), 13) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
        h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN iw USING (t, n)),
        p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
        x AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN x USING (doc_id)
    """,
    "op1_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        k AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT u, v FROM k JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
        both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
        r AS (SELECT DISTINCT u AS doc_id, u AS c FROM both_ways UNION SELECT r.doc_id, g.v FROM r JOIN both_ways g ON g.u = r.c),
        m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
    """,
    "op11_conversation_trie": rf"""
        WITH crc AS ({CRC_TABLE}),
        c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
        h AS (SELECT conv_id, conv_id - conv_id % 20 AS g, {CRC.format(bytes=BYTES.format(text="conv_id::VARCHAR"))} % 4 AS h FROM (SELECT DISTINCT conv_id FROM c), crc),
        r AS (SELECT h.conv_id, 0 AS part, pos, role, text FROM h JOIN c ON c.conv_id = h.g AND pos <= h
              UNION ALL SELECT conv_id, 1, pos, role, text FROM h JOIN c USING (conv_id) WHERE pos > h),
        s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, sha256(strlen(role) || ':' || role || text) AS turn, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r),
        n AS (SELECT conv_id, count(s.d) AS n FROM h LEFT JOIN s USING (conv_id) GROUP BY 1),
        k AS (SELECT conv_id, 0 AS d, '' AS k, 0 AS words FROM h
              UNION ALL SELECT conv_id, d, sha256(string_agg(turn, ',') OVER (PARTITION BY conv_id ORDER BY d)), words FROM s),
        node AS (SELECT d AS depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM k GROUP BY 1, 2),
        up AS (SELECT DISTINCT b.d AS depth, b.k, a.k AS parent FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.d = a.d + 1),
        kids AS (SELECT depth - 1 AS depth, parent AS k, count(*) AS n_children FROM up GROUP BY 1, 2),
        under AS (SELECT DISTINCT a.d AS depth, a.k, b.d AS d2, b.k AS k2 FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.d >= a.d),
        sums AS (SELECT u.depth, u.k, count(*) FILTER (WHERE kids.k IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.words)::BIGINT AS saved_tokens
                 FROM under u JOIN node x ON x.depth = d2 AND x.k = k2 LEFT JOIN kids ON kids.depth = d2 AND kids.k = k2 GROUP BY 1, 2),
        e AS (SELECT d AS depth, k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM k JOIN n USING (conv_id) WHERE d = n GROUP BY 1, 2)
        SELECT node.conv_id, node.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM node JOIN sums USING (depth, k) LEFT JOIN kids USING (depth, k) LEFT JOIN e USING (depth, k) LEFT JOIN up USING (depth, k) LEFT JOIN node p ON p.depth = node.depth - 1 AND p.k = up.parent
    """,
    "op13_spelling_variants": rf"""
        WITH RECURSIVE crc AS ({CRC_TABLE}),
        o AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
        b AS (SELECT r, times, {CRC.format(bytes=BYTES.format(text="coalesce(doc_id::VARCHAR, '') || ':' || r"))} AS h FROM (SELECT doc_id, r, count(*) AS times FROM o WHERE length(r) >= 7 GROUP BY 1, 2), crc),
        f AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, times FROM b),
        w AS (SELECT word, sum(times)::BIGINT AS n FROM f WHERE length(word) >= 7 GROUP BY 1 HAVING sum(times) >= 2),
        cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
        pair AS (SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
                 UNION SELECT cut.word, rest FROM cut JOIN w v ON v.word = rest UNION SELECT rest, cut.word FROM cut JOIN w v ON v.word = rest),
        near AS (SELECT a AS word, count(*) AS n_near, max(n) AS near_n, arg_min(b, (-n, b)) AS near FROM pair JOIN w ON w.word = b GROUP BY 1),
        k AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM w LEFT JOIN near USING (word)),
        way AS (SELECT word, word AS root FROM k UNION ALL SELECT way.word, k.form FROM way JOIN k ON k.word = way.root WHERE k.form IS NOT NULL),
        last AS (SELECT way.word, way.root FROM way JOIN k ON k.word = way.root WHERE k.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM k JOIN last USING (word)
    """,
}
