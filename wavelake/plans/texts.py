"""Queries on README texts, truth lines, keys, links, names and checksums."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelake import vocab
from wavelake.operators import textmine
from wavelake.plans.base import query, table


def _values(rows: list[str]) -> str:
    quoted = ["('" + r.replace("'", "''") + "')" for r in rows]
    return ", ".join(quoted)


def _mention_sql() -> str:
    return "[" + ", ".join(f"'{m}'" for m in _MENTIONS) + f"][doc_id % {len(_MENTIONS)} + 1]"


def _sql_pattern(name: str) -> str:
    return textmine.mode_pattern(name).replace("'", "''")


_MENTIONS = ["supports NBFM, D Star and fx.25", "8 x carrier or BELL202 only", "dmr/P25, I am DSTAR", "none", "M17 and ldpc; SOQPSK", "GMSK-modem 8PSK qpsk"]
_FOUND = ", ".join(f"CASE WHEN regexp_matches(text, '{_sql_pattern(n)}') THEN '{as_}' END" for n, as_ in textmine.SEARCHED)


@query(f"""WITH d AS (SELECT doc_id, text || ' ' || {_mention_sql()} AS text FROM documents), f AS (SELECT doc_id, unnest([{_FOUND}, CASE WHEN regexp_matches(text, '{textmine.COMPOSITE}') THEN 'sleipnir_8qpsk' END]) AS mode FROM d)
    SELECT doc_id, string_agg(mode, ',' ORDER BY lower(mode)) AS modes FROM (SELECT DISTINCT * FROM f WHERE mode IS NOT NULL) GROUP BY 1""")
def readme_modes(spark, sf_dir):
    mention = F.element_at(vocab.literal_list(_MENTIONS), (F.col("doc_id") % len(_MENTIONS) + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" "), mention).alias("text"))
    # Exploded and not filtered on, so that the names are looked for once.
    d = d.select("doc_id", F.explode(F.array(F.array_join(textmine.modes(F.col("text")), ","))).alias("modes"))
    return d.filter("modes <> ''")


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(t, '{textmine.GR4}') THEN CASE WHEN regexp_matches(t, '{textmine.GR3}') THEN 'both' ELSE '4' END WHEN regexp_matches(t, '{textmine.GR3}') THEN '3' END AS version,
    regexp_matches(t, '(?i)\\.iq|iq_sample|file_sink|vector_sink') AS samples FROM (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' GNU Radio 4' WHEN 1 THEN ' gr 3 gnuradio4' WHEN 2 THEN ' needs 3.10 and a file_sink' ELSE '' END AS t FROM documents)""")
def version_flags(spark, sf_dir):
    i = F.col("doc_id") % 4
    t = F.concat("text", F.when(i == 0, " GNU Radio 4").when(i == 1, " gr 3 gnuradio4").when(i == 2, " needs 3.10 and a file_sink").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", textmine.radio_version(F.col("t")).alias("version"), textmine.has_samples(F.col("t")).alias("samples"))


_README = r"E'Intro ' || doc_id || E'\n## Build steps\nrun make\n\nthen ' || text || E'\n## Dependencies\n- one\n* two ' || doc_id || E'\n\n# Use\nrest'"


@query(rf"""WITH r AS (SELECT doc_id, {_README} AS t FROM documents)
    SELECT doc_id, left(trim(regexp_replace(regexp_extract(t, '(?is)(#{{1,3}}\s*(?:build|install|compilation|getting started).*)$', 1).string_split_regex('\n#{{1,3}}\s')[1], '^\s+|\s+$', '', 'g')), 2000) AS build,
        'one,two ' || doc_id AS deps FROM r""")
def section_extract(spark, sf_dir):
    doc = F.col("doc_id").cast("string")
    t = F.concat(F.lit("Intro "), doc, F.lit("\n## Build steps\nrun make\n\nthen "), F.col("text"), F.lit("\n## Dependencies\n- one\n* two "), doc, F.lit("\n\n# Use\nrest"))
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return rows.select("doc_id", textmine.section(F.col("t"), "build|install|compilation|getting started").alias("build"), F.array_join(textmine.dependencies(F.col("t")), ",").alias("deps"))


_NAMES = ["NBFM", "nbfm", "dstar", "D-STAR", "vara fm", "8XQPSK", "DMR", "gmsk", "unknown", "fx.25", "dpmr", "DPMR"]


@query(f"""WITH m(ord, mode, canonical, family, order_name) AS (VALUES {', '.join(f"({i}, '{m[0]}', '{m[1]}', '{m[2]}', '{m[3]}')" for i, m in enumerate(vocab.MODES))}), n(name) AS (VALUES {_values(_NAMES)})
    SELECT name, canonical, family, order_name FROM (SELECT name, m.*, row_number() OVER (PARTITION BY name ORDER BY (m.mode = name) DESC, ord) AS r FROM n LEFT JOIN m ON upper(m.mode) = upper(name)) WHERE r = 1""")
def mode_lookup(spark, sf_dir):
    return textmine.lookup_modes(vocab.frame(spark, [(n,) for n in _NAMES], "name string"), "name").select("name", "canonical", "family", "order_name")


_VOCAB = ["AM-DSB", "AM-SSB", "WBFM", "BPSK", "QPSK", "8PSK", "CPFSK", "GFSK", "NBFM_25", "DMR", "M17"]


@query(f"""WITH m(mode, family, order_name, method) AS (VALUES {', '.join(f"('{m[0]}', '{m[2]}', '{m[3]}', '{m[4]}')" for m in vocab.MODES)}), v(o) AS (VALUES {_values(_VOCAB)})
    SELECT mode, concat_ws('; ', CASE WHEN family NOT IN ({', '.join(f"'{f}'" for f in vocab.FAMILIES)}) THEN 'family ' || family || ' not in model' END, CASE WHEN order_name NOT IN (SELECT o FROM v) THEN 'order ' || order_name || ' not in model' END) AS reason
    FROM m WHERE method NOT IN ('skip', 'plugin') AND (family NOT IN ({', '.join(f"'{f}'" for f in vocab.FAMILIES)}) OR order_name NOT IN (SELECT o FROM v))""")
def vocab_mismatch(spark, sf_dir):
    known = vocab.frame(spark, [(o, True) for o in _VOCAB], "order_name string, known boolean")
    bad_family = ~F.col("family").isin(vocab.FAMILIES)
    rows = vocab.mode_frame(spark).filter("method not in ('skip', 'plugin')").join(F.broadcast(known), "order_name", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    reason = F.concat_ws("; ", F.when(bad_family, F.concat(F.lit("family "), "family", F.lit(" not in model"))), F.when(~F.col("known"), F.concat(F.lit("order "), "order_name", F.lit(" not in model"))))
    return rows.filter(bad_family | ~F.col("known")).select("mode", reason.alias("reason"))


@query("SELECT n_name FROM nation WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_9') AND n_name NOT IN ('NATION_2', 'gr-opus')")
def include_exclude(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select("n_name")
    return textmine.scan_names(names, "n_name", ["NATION_1", "NATION_2", "NATION_3", "NATION_9"], ["NATION_2"])


_LINE = "CASE doc_id % 6 WHEN 0 THEN '# note' WHEN 1 THEN doc_id || '. bpsk 1 0' WHEN 2 THEN doc_id || ', Dqpsk 7' WHEN 3 THEN '  ' WHEN 4 THEN 'x1 qpsk' ELSE doc_id || ' other 3' END"
_TRUTH = """l AS (SELECT string_split_regex(trim(line), '\\s+') AS p, line FROM raw WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')),
    t AS (SELECT try_cast(regexp_replace(p[1], '[.,]+$', '') AS INT) AS idx, CASE WHEN lower(p[2]) IN ('bpsk', 'qpsk', '8psk', 'dqpsk', '16qam', '64qam', '256qam', 'msk') THEN upper(p[2]) ELSE upper(p[2]) END AS class FROM l WHERE len(p) >= 2)"""


def _lines(spark, sf_dir):
    i, n = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    line = F.when(i == 0, "# note").when(i == 1, F.concat(n, F.lit(". bpsk 1 0"))).when(i == 2, F.concat(n, F.lit(", Dqpsk 7"))).when(i == 3, "  ").when(i == 4, "x1 qpsk").otherwise(F.concat(n, F.lit(" other 3")))
    return table(spark, sf_dir, "labels").select(line.alias("line"))


@query(f"WITH raw AS (SELECT {_LINE} AS line FROM labels), {_TRUTH} SELECT idx, class FROM t WHERE idx IS NOT NULL")
def truth_line_parse(spark, sf_dir):
    return textmine.truth_lines(_lines(spark, sf_dir), "line")


@query(f"""WITH raw AS (SELECT {_LINE} AS line FROM labels), {_TRUTH}, c AS (SELECT doc_id, i::INT AS chunk FROM documents, range(6) r(i) WHERE i < 4 AND i * 400 < n_chars)
    SELECT doc_id, chunk, class FROM c JOIN t ON t.idx = c.doc_id""")
def truth_join_cap4(spark, sf_dir):
    truth = textmine.truth_lines(_lines(spark, sf_dir), "line")
    chunks = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("chunk")).filter(F.col("chunk") * 400 < F.col("n_chars"))
    return chunks.join(truth, chunks.doc_id == truth.idx).select("doc_id", "chunk", "class")


_KEYS = ["32FSK", "64FSK", "128_fsk", "OQPSK", "MSK", "bpsk", "AM-DSB", "am_ssb", "256qam", "8PSK", "ook", "zzz", "FM"]
_CLASSES = ", ".join(f"({i}, '{c}', '{c.upper().replace('-', '')}')" for i, c in enumerate(vocab.HISARMOD_ORDER))


@query(f"""WITH c(ord, class, k) AS (VALUES {_CLASSES}), n(key) AS (VALUES {_values(_KEYS)}), p AS (SELECT key, regexp_replace(upper(key), '[_-]', '', 'g') AS u FROM n)
    SELECT key, coalesce(arg_min(class, ord), key) AS class FROM p LEFT JOIN c ON contains(u, k) OR contains(k, u) GROUP BY key""")
def key_class_contains(spark, sf_dir):
    return vocab.frame(spark, [(k,) for k in _KEYS], "key string").select("key", textmine.key_class(F.col("key")).alias("class"))


_SNRS = ["snr_10", "-10dB", "SNR0", "10.5", "level -4 of", "none", "snr_-20db"]


@query(f"WITH n(key) AS (VALUES {_values(_SNRS)}) SELECT key, coalesce(try_cast(trim(regexp_replace(lower(key), 'db|snr|_', '', 'g')) AS DOUBLE), try_cast(nullif(regexp_extract(key, '([0-9.-]+)', 1), '') AS DOUBLE), 0.0::DOUBLE) AS snr FROM n")
def snr_key_parse(spark, sf_dir):
    return vocab.frame(spark, [(k,) for k in _SNRS], "key string").select("key", textmine.snr_key(F.col("key")).alias("snr"))


@query("""WITH e AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN sha256(text) WHEN 1 THEN 'UNVERIFIED' WHEN 2 THEN upper(sha256(text)) ELSE sha256('x') END AS sha, CASE WHEN doc_id % 5 <> 0 THEN sha END AS expected_sha FROM documents),
    a AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN sha256(text) END AS actual_sha FROM documents)
    SELECT doc_id, CASE WHEN actual_sha IS NULL THEN 'missing' WHEN expected_sha IS NULL THEN 'unregistered' WHEN NOT regexp_matches(expected_sha, '^[0-9a-fA-F]{64}$') THEN 'unverified' WHEN lower(expected_sha) = actual_sha THEN 'ok' ELSE 'corrupt' END AS status,
        CASE WHEN expected_sha IS NULL OR NOT regexp_matches(expected_sha, '^[0-9a-fA-F]{64}$') THEN 'UNVERIFIED' ELSE left(expected_sha, 16) END AS prefix FROM e FULL JOIN a USING (doc_id)""")
def checksum_verify(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    sha, i = F.sha2("text", 256), F.col("doc_id") % 4
    registered = F.when(i == 0, sha).when(i == 1, "UNVERIFIED").when(i == 2, F.upper(sha)).otherwise(F.sha2(F.lit("x"), 256))
    expected = d.select("doc_id", F.when(F.col("doc_id") % 5 != 0, registered).alias("expected_sha"))
    actual = d.select("doc_id", F.when(F.col("doc_id") % 7 != 0, sha).alias("actual_sha"))
    out = textmine.checksum_status(actual, expected, "doc_id")
    return out.select("doc_id", "status", F.when(F.coalesce(F.col("expected_sha").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), F.left("expected_sha", F.lit(16))).otherwise("UNVERIFIED").alias("prefix"))


_LINKS = """h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1), 1) AS i FROM pages),
    l AS (SELECT page_id, url, href, min(i - 1)::INT AS pos FROM h GROUP BY 1, 2, 3)"""


@query(rf"""WITH {_LINKS} SELECT page_id, pos, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href
    ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '/') || href END AS full_url FROM l""")
def link_scrape(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    found = textmine.links(p, "page_id", "html").join(p.select("page_id", "url"), "page_id")
    return found.select("page_id", "pos", textmine.absolute(F.col("url"), F.col("href")).alias("full_url"))


_URL = "CASE page_id % 5 WHEN 0 THEN url || '/c_2023.txt' WHEN 1 THEN 'http://x/2023/09/a.txt' WHEN 2 THEN url || '/signal_record.txt' WHEN 3 THEN url || '/CSPB.ML.2018R2.txt' ELSE url END"


@query(f"WITH u AS (SELECT page_id, {_URL} AS u FROM pages) SELECT page_id, CASE WHEN contains(lower(u), 'c_2023') OR contains(lower(u), '2018r2') THEN 0 WHEN contains(lower(u), '2023/09') THEN 1 WHEN ends_with(lower(u), '/signal_record.txt') THEN 2 ELSE 3 END AS priority FROM u")
def link_priority(spark, sf_dir):
    i = F.col("page_id") % 5
    u = F.when(i == 0, F.concat("url", F.lit("/c_2023.txt"))).when(i == 1, "http://x/2023/09/a.txt").when(i == 2, F.concat("url", F.lit("/signal_record.txt"))).when(i == 3, F.concat("url", F.lit("/CSPB.ML.2018R2.txt"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", textmine.link_priority(u).alias("priority"))


_ARCHIVE = "CASE page_id % 6 WHEN 0 THEN 'CSPB_ML_2018R2_1.zip' WHEN 1 THEN 'cspb.ml.2018 part.zip' WHEN 2 THEN 'batch2018.tar' WHEN 3 THEN 'setr2.zip' WHEN 4 THEN '' ELSE url END"


@query(f"""WITH a AS (SELECT page_id, replace(replace(lower({_ARCHIVE}), '_', '-'), ' ', '') AS n FROM pages)
    SELECT page_id, CASE WHEN n = '' THEN 'empty' WHEN contains(n, '2018r2') OR regexp_matches(n, 'cspb.*2018.*r2') OR ends_with(n, 'r2.zip') OR ends_with(n, 'r2.tar.gz') THEN 'r2'
        WHEN contains(n, '2018') AND NOT contains(n, 'r2') AND (contains(n, 'cspb') OR starts_with(n, 'batch')) THEN 'original' ELSE 'unknown' END AS variant FROM a""")
def variant_classify(spark, sf_dir):
    i = F.col("page_id") % 6
    n = F.when(i == 0, "CSPB_ML_2018R2_1.zip").when(i == 1, "cspb.ml.2018 part.zip").when(i == 2, "batch2018.tar").when(i == 3, "setr2.zip").when(i == 4, "").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", textmine.archive_variant(n).alias("variant"))


@query("""WITH s AS (SELECT doc_id, n_chars * pow(37, doc_id % 6)::BIGINT AS n FROM documents)
    SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE)
        WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE) ELSE printf('%.1f TB', n / 1099511627776.0::DOUBLE) END AS size FROM s""")
def size_format(spark, sf_dir):
    n = F.col("n_chars") * F.pow(F.lit(37), F.col("doc_id") % 6).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", textmine.human_size(n).alias("size"))


@query("SELECT p_partkey, 'mod_' || translate(lower(p_name || '-' || p_type || '.x'), '.-', '__') AS block FROM part")
def block_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", textmine.block_name(F.concat("p_name", F.lit("-"), "p_type", F.lit(".x"))).alias("block"))


@query("SELECT r_name, sum(c_acctbal) FILTER (c_acctbal > 0)::DOUBLE AS total, list_count(list(DISTINCT c_mktsegment))::BIGINT AS segments FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def source_groups(spark, sf_dir):
    """Projects by source group: a star join of small dimensions."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name").agg(F.round(F.sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), 6).alias("total"), F.count_distinct("c_mktsegment").alias("segments"))
