"""Queries of upkeep: listings, timestamps, names, lists, checksum files, data set facts, window shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelake.operators import audit, datasets, naming
from wavelake.plans.base import AUDIT, audit_frames, query, table


@query(f"WITH {AUDIT} SELECT project_id, project_name, last_scanned FROM projects ORDER BY last_scanned DESC NULLS LAST, project_id")
def project_listing(spark, sf_dir):
    return audit.list_projects(audit_frames(spark, sf_dir)["projects"])


@query(f"WITH {AUDIT} SELECT count(*) FILTER (NOT resolved) AS issues FROM issues")
def issue_count_open(spark, sf_dir):
    return audit.count_issues(audit_frames(spark, sf_dir)["issues"], open_only=True)


@query("SELECT event_id, strftime(ts - CASE WHEN event_id % 3 = 2 THEN INTERVAL 90 MINUTE ELSE INTERVAL 0 MINUTE END, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def scan_times(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    i = F.col("event_id") % 3
    return e.select("event_id", naming.scan_time(F.concat(text, F.when(i == 0, "Z").when(i == 1, "").otherwise("+01:30"))).alias("at"))


@query("SELECT page_id, replace(url, '/', '_') AS segment, translate(url, '/ ', '__') AS flat, replace(replace(url, ':', ''), '-', '') AS compact FROM pages")
def safe_names(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", naming.safe_name(u).alias("segment"), naming.flat_name(u).alias("flat"), naming.compact_time(u).alias("compact"))


@query(r"""WITH l AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(string_split(text, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''))) AS n FROM documents)
    SELECT doc_id, nullif(len(n), 0)::INT AS names, CASE WHEN len(n) > 0 THEN sha256(array_to_string(n, '|')) END AS digest FROM l""")
def name_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", naming.name_list(F.col("text")).alias("n"))
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), F.size("n")).alias("names"), F.sha2(F.array_join(F.array_sort("n"), "|").cast("binary"), 256).alias("digest"))


@query(r"SELECT event_id, regexp_replace(CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END || '; ' || CASE WHEN event_id % 3 = 0 THEN '' ELSE coalesce(props ->> '$.k', '') END, '^[; ]+|[; ]+$', '', 'g') AS notes FROM events")
def merged_notes(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", naming.merged_notes(F.when(i % 4 != 0, F.col("event_type")), F.when(i % 3 != 0, F.get_json_object("props", "$.k"))).alias("notes"))


@query("""WITH l AS (SELECT c_nationkey AS nation, list_sort(list(c_name)) AS n FROM customer GROUP BY 1)
    SELECT nation, array_to_string(n[1:12], ', ') || CASE WHEN len(n) > 12 THEN ', …' ELSE '' END AS line FROM l""")
def shown_names(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.array_sort(F.collect_list("c_name")).alias("n"))
    return rows.select("nation", naming.shown(F.col("n")).alias("line"))


@query("""WITH w AS (SELECT 's' || label % 3 AS source, 'c' || label AS class, (vec_id % 26 * 2 - 20)::DOUBLE AS snr_db FROM embeddings)
    SELECT source, array_to_string(list_sort(list_distinct(list(class))), ',') AS classes, count(DISTINCT class || '/' || snr_db) AS keys, count(*) AS windows, min(snr_db) AS snr_min, max(snr_db) AS snr_max FROM w GROUP BY 1""")
def dataset_info(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    w = e.select(F.concat(F.lit("s"), (F.col("label") % 3).cast("string")).alias("source"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("class"), (F.col("vec_id") % 26 * 2 - 20).cast("double").alias("snr_db"))
    return datasets.info(w).withColumn("classes", F.array_join("classes", ","))


@query("""SELECT vec_id, n::INT AS n, CASE WHEN n < 64 THEN embedding[n + 1]::DOUBLE ELSE 0.0 END AS filled, embedding[n % 64 + 1]::DOUBLE AS repeated FROM embeddings, range(100) t(n)""")
def window_shapes(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    both = F.arrays_zip(naming.padded(x, 100).alias("filled"), naming.tiled(x, 100).alias("repeated"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(both).alias("n", "b")).select("vec_id", "n", "b.filled", "b.repeated")


@query("SELECT vec_id, arg_min(i, (abs(embedding[i + 1]::DOUBLE - 0.1), i))::INT AS place FROM embeddings, range(64) t(i) GROUP BY 1")
def nearest_bin(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", naming.nearest(x, F.lit(0.1).cast("double")).alias("place"))


@query("""SELECT doc_id || '.onnx' AS name, sha256(text) AS sha FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0""")
def checksum_lines(spark, sf_dir):
    i = F.col("doc_id")
    line = F.concat(F.when(i % 7 == 0, "# ").otherwise(""), F.when(i % 5 == 0, F.substring(F.sha2("text", 256), 1, 60)).otherwise(F.upper(F.sha2("text", 256))), F.lit("  models/"), i.cast("string"), F.lit(".onnx"))
    return datasets.checksum_lines(table(spark, sf_dir, "documents").select(line.alias("value")))
