"""Queries on votes, verdicts and the audit store."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelake import vocab
from wavelake.operators import audit, judging, training
from wavelake.plans.base import AUDIT, PREDICTIONS, VERDICTS, alias_sql, audit_frames, expectations, predictions, query, sql_case, table, verdict_rows, vote_sql


@query(f"WITH {PREDICTIONS}, {vote_sql('predicted_order', 'v')} SELECT file, predicted_order, round(conf, 6) AS confidence, n AS votes, n_chunks FROM v")
def majority_vote(spark, sf_dir):
    return judging.majority_vote(predictions(spark, sf_dir), ["file"], "predicted_order", "confidence", "event_id").withColumn("confidence", F.round("confidence", 6))


@query("SELECT label, pos::INT AS pos, round(avg(embedding[pos + 1]::DOUBLE), 6) AS mean FROM embeddings, range(64) t(pos) GROUP BY 1, 2")
def mean_logits(spark, sf_dir):
    means = judging.mean_vector(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("embedding").alias("pos", "m")).select("label", "pos", F.round("m", 6).alias("mean"))


@query("""WITH l AS (SELECT vec_id, i::INT AS i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) t(i)),
    e AS (SELECT vec_id, i, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM l), p AS (SELECT vec_id, i, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e)
    SELECT vec_id, i AS top1, round(p, 6) AS prob FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) = 1""")
def softmax_top1(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("vec_id", judging.softmax(F.col("embedding")).alias("p"))
    return p.select("vec_id", judging.argmax(F.col("p")).alias("top1"), F.round(F.array_max("p"), 6).alias("prob"))


@query(f"WITH {VERDICTS} SELECT file, expected_family, expected_order, predicted_family, predicted_order, round(family_confidence, 6) AS family_confidence, family_pass, order_pass, hard_fail, reason FROM verdict")
def verdict(spark, sf_dir):
    return verdict_rows(spark, sf_dir).select("file", "expected_family", "expected_order", "predicted_family", "predicted_order", F.round("family_confidence", 6).alias("family_confidence"), "family_pass", "order_pass", "hard_fail", "reason")


@query(f"WITH {PREDICTIONS} SELECT event_id, confidence >= 0.5 AS pass_overall, (confidence >= 0.5) AND confidence >= 0.7 AND true AS order_pass, (confidence < 0.5 AND confidence < 0.4) OR predicted_order <> 'NXDN' AS hard_fail FROM p")
def custom_verdict(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("event_id", "confidence", F.col("predicted_order").alias("mode_id"), F.lit("NXDN").alias("expected_order"), (F.col("confidence") >= 0.5).alias("pass_overall"))
    return judging.custom_verdicts(rows).select("event_id", "pass_overall", "order_pass", "hard_fail")


@query(f"WITH {VERDICTS} SELECT coalesce(max(CASE WHEN hard_fail THEN 2 WHEN family_pass AND order_pass THEN 0 ELSE 1 END), 1) AS code FROM verdict")
def exit_code(spark, sf_dir):
    return judging.run_code(verdict_rows(spark, sf_dir))


@query(f"""WITH {VERDICTS}, o AS (SELECT *, family_pass AND order_pass AND NOT hard_fail AS ok FROM verdict)
    SELECT count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (hard_fail) AS hard_fails, round(coalesce(avg(ok::INT::DOUBLE), 0.0), 6) AS pass_rate FROM o""")
def summary_report(spark, sf_dir):
    return judging.summary(verdict_rows(spark, sf_dir)).withColumn("pass_rate", F.round("pass_rate", 6))


@query(f"""WITH {VERDICTS} SELECT file, printf('| mod_%d | %s | %s | %.2f | %s | %s | %s |', file, expected_order, predicted_order, family_confidence,
    CASE WHEN family_pass THEN '✓' ELSE '✗' END, CASE WHEN order_pass THEN '✓' ELSE '✗' END, CASE WHEN hard_fail THEN '✓' ELSE '✗' END) AS line FROM verdict""")
def report_markdown(spark, sf_dir):
    rows = verdict_rows(spark, sf_dir).withColumn("block", F.concat(F.lit("mod_"), F.col("file").cast("string")))
    return rows.join(judging.markdown_rows(rows), "block").select("file", "line")


@query(f"""WITH {VERDICTS} SELECT expected_family, CASE WHEN count(*) FILTER (hard_fail) > 0 THEN 'HARD FAIL' WHEN count(*) FILTER (NOT hard_fail AND NOT (family_pass AND order_pass)) > 0 THEN 'SOFT FAIL'
    WHEN count(*) FILTER (NOT hard_fail AND family_pass AND order_pass) > 0 THEN 'PASS' ELSE 'SKIPPED' END AS label, count(*) FILTER (NOT hard_fail AND family_pass AND order_pass) AS passed FROM verdict GROUP BY 1""")
def project_counters(spark, sf_dir):
    ok = F.col("family_pass") & F.col("order_pass")
    g = verdict_rows(spark, sf_dir).groupBy("expected_family").agg(F.count_if("hard_fail").alias("hard"), F.count_if(~F.col("hard_fail") & ~ok).alias("soft"), F.count_if(~F.col("hard_fail") & ok).alias("passed"))
    return g.select("expected_family", judging.overall_label(F.col("hard"), F.col("soft"), F.col("passed")).alias("label"), "passed")


@query(f"WITH {alias_sql()}, o(name) AS (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in vocab.ORDERS)}) SELECT e.name AS expected, p.name AS predicted FROM o e, o p WHERE CASE WHEN e.name IN (SELECT expected FROM alias) THEN (e.name, p.name) IN (SELECT (expected, accepted) FROM alias) ELSE e.name = p.name END")
def alias_match_matrix(spark, sf_dir):
    orders = vocab.frame(spark, [(x,) for x in vocab.ORDERS], "expected string")
    aliases = vocab.alias_frame(spark)
    own = orders.join(aliases, "expected", "left_anti").select("expected", F.col("expected").alias("predicted"))
    listed = aliases.join(orders, "expected").join(orders.select(F.col("expected").alias("accepted")), "accepted")
    return own.unionByName(listed.select("expected", F.col("accepted").alias("predicted")))


@query(f"""WITH d(order_name, family, prio) AS (VALUES {', '.join(f"('{o}', '{f}', {p})" for p, (s, m) in enumerate(vocab.FAMILY_SOURCES) for f, v in m.items() for o in v)}),
    o(order_name) AS (VALUES {', '.join(f"('{x}')" for x in vocab.ORDERS)}) SELECT o.order_name, arg_min(family, prio) AS family FROM o LEFT JOIN d USING (order_name) GROUP BY 1""")
def order_to_family(spark, sf_dir):
    orders = vocab.frame(spark, [(x,) for x in vocab.ORDERS], "order_name string")
    return training.order_families(orders, "order_name").select("order_name", "family")


@query(f"""WITH {VERDICTS}, n AS (SELECT *, 'mod_' || file AS block, CASE WHEN file % 5 = 0 THEN 'Approximation only' WHEN file % 7 = 0 THEN 'Protocol framing' ELSE '' END AS note FROM verdict),
    i AS (SELECT block, CASE WHEN hard_fail THEN 'hard_fail' WHEN NOT (family_pass AND order_pass) THEN 'soft_fail' WHEN family_confidence < 0.7 OR order_confidence < 0.7 THEN 'warning' END AS severity,
        CASE WHEN hard_fail THEN block || ': ' || reason WHEN NOT (family_pass AND order_pass) THEN printf('%s: expected %s/%s, got %s/%s', block, expected_family, expected_order, predicted_family, predicted_order)
             ELSE block || ': correct label, low confidence' END AS description FROM n
        UNION ALL SELECT block, 'info', block || ': ' || note FROM n WHERE note <> '')
    SELECT * FROM i WHERE severity IS NOT NULL""")
def severity_issues(spark, sf_dir):
    rows = verdict_rows(spark, sf_dir).withColumn("block", F.concat(F.lit("mod_"), F.col("file").cast("string")))
    note = F.when(F.pmod("file", F.lit(5)) == 0, "Approximation only").when(F.pmod("file", F.lit(7)) == 0, "Protocol framing").otherwise("")
    return judging.issues(rows.withColumn("note", note))


@query(f"WITH {PREDICTIONS} SELECT event_id, CASE WHEN confidence >= 0.7 THEN 'green' WHEN confidence < 0.4 THEN 'red' ELSE 'yellow' END AS band FROM p")
def confidence_bands(spark, sf_dir):
    return predictions(spark, sf_dir).select("event_id", judging.confidence_band(F.col("confidence")).alias("band"))


@query(f"WITH {AUDIT} SELECT i.issue_id, i.severity, p.project_name, b.block_name FROM issues i LEFT JOIN projects p USING (project_id) LEFT JOIN blocks b USING (block_id) WHERE NOT i.resolved AND i.detected_at >= TIMESTAMP '2024-01-15 00:00:00' AND p.project_name ILIKE '%CUSTOMER#00000000_%'")
def list_issues(spark, sf_dir):
    a = audit_frames(spark, sf_dir)
    return audit.list_issues(a["issues"], a["projects"], a["blocks"], project="CUSTOMER#00000000_", since="2024-01-15 00:00:00", open_only=True).select("issue_id", "severity", "project_name", "block_name")


@query(f"WITH {AUDIT} SELECT block_id, validation_id, value FROM validations QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY run_at DESC, validation_id DESC) = 1")
def latest_per_block(spark, sf_dir):
    return audit.latest(audit_frames(spark, sf_dir)["validations"], "block_id", "run_at", "validation_id").select("block_id", "validation_id", "value")


@query(f"WITH {AUDIT} SELECT block_id, validation_id FROM validations QUALIFY rank() OVER (PARTITION BY block_id ORDER BY run_at DESC) = 1")
def keep_latest_ties(spark, sf_dir):
    return audit.purged_validations(audit_frames(spark, sf_dir)["validations"]).select("block_id", "validation_id")


_CUT = """cut AS (SELECT project_id, min(m) AS cut FROM (SELECT block_id, max(run_at) AS m FROM validations GROUP BY 1) JOIN blocks USING (block_id) GROUP BY 1),
    stale AS (SELECT i.*, coalesce(p.project_id IS NOT NULL AND i.detected_at < coalesce(cut.cut, p.last_scanned, TIMESTAMP '1970-01-01'), false) AS stale FROM issues i LEFT JOIN projects p USING (project_id) LEFT JOIN cut USING (project_id))"""


@query(f"WITH {AUDIT}, {_CUT} SELECT issue_id, severity FROM stale WHERE NOT stale")
def purge_issues(spark, sf_dir):
    a = audit_frames(spark, sf_dir)
    return audit.purged_issues(a["issues"], a["validations"], a["blocks"], a["projects"]).filter("not stale").select("issue_id", "severity")


@query(f"""WITH {AUDIT}, {_CUT}, v AS (SELECT *, rank() OVER (PARTITION BY block_id ORDER BY run_at DESC) = 1 AS keep, block_id IN (SELECT block_id FROM blocks) AS known FROM validations)
    SELECT (SELECT count(*) FROM v WHERE keep) AS validations_kept, (SELECT count(*) FROM v WHERE NOT keep AND known) AS validations_deleted,
        (SELECT count(*) FROM stale WHERE NOT stale) AS issues_kept, (SELECT count(*) FROM stale WHERE stale) AS issues_deleted""")
def purge_preview(spark, sf_dir):
    a = audit_frames(spark, sf_dir)
    v, last = a["validations"], a["validations"].groupBy("block_id").agg(F.max("run_at").alias("last"))
    known = a["blocks"].select("block_id").withColumn("known", F.lit(True))
    # The preview counts deletions of validations that join a block; orphans are deleted without being counted.
    counts = v.join(last, "block_id").join(known, "block_id", "left").agg(F.count_if(F.col("run_at") == F.col("last")).alias("validations_kept"), F.count_if((F.col("run_at") < F.col("last")) & F.col("known").isNotNull()).alias("validations_deleted"))
    i = audit.purged_issues(a["issues"], v, a["blocks"], a["projects"]).agg(F.count_if(~F.col("stale")).alias("issues_kept"), F.count_if("stale").alias("issues_deleted"))
    return counts.crossJoin(i)


@query(f"""WITH {AUDIT} SELECT issue_id, CASE WHEN NOT resolved AND block_id IN (SELECT block_id FROM blocks WHERE project_id = 7) THEN description || ' | superseded by re-scan' WHEN issue_id = 10 THEN description || ' | fixed' ELSE description END AS description,
    resolved OR coalesce(block_id IN (SELECT block_id FROM blocks WHERE project_id = 7), false) OR issue_id = 10 AS resolved FROM issues""")
def supersede_resolve(spark, sf_dir):
    a = audit_frames(spark, sf_dir)
    out = audit.superseded(a["issues"], a["blocks"].filter("project_id = 7"))
    return audit.resolved(out, 10, "fixed").select("issue_id", "description", "resolved")


@query("""WITH o AS (SELECT c_custkey AS id, c_name AS path, c_mktsegment AS name, c_acctbal AS version FROM customer WHERE c_acctbal < 5000),
    n AS (SELECT c_name AS path, upper(c_mktsegment) AS name, c_acctbal + 1 AS version FROM customer WHERE c_acctbal >= 3000), m AS (SELECT max(id) AS m FROM o)
    SELECT o.id, path, o.name, coalesce(n.version, o.version) AS version FROM o LEFT JOIN n USING (path)
    UNION ALL SELECT m + row_number() OVER (ORDER BY path), path, n.name, n.version FROM n, m WHERE path NOT IN (SELECT path FROM o)""")
def upsert_projects(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_acctbal < 5000").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("path"), F.col("c_mktsegment").alias("name"), F.col("c_acctbal").alias("version"))
    new = c.filter("c_acctbal >= 3000").select(F.col("c_name").alias("path"), F.upper("c_mktsegment").alias("name"), (F.col("c_acctbal") + 1).alias("version"))
    return audit.upserted(old, new, ["path"], "id", ["name"])


@query(f"""WITH {AUDIT} SELECT (SELECT count(*) FROM projects) AS projects, strftime((SELECT max(last_scanned) FROM projects), '%Y-%m-%d %H:%M:%S') AS last_scanned, (SELECT count(*) FROM validations) AS validations,
    (SELECT count(*) FROM issues WHERE NOT resolved AND severity = 'hard_fail') AS open_hard_fail, (SELECT count(*) FROM issues WHERE NOT resolved AND severity = 'soft_fail') AS open_soft_fail,
    (SELECT count(*) FROM issues WHERE NOT resolved AND severity = 'warning') AS open_warning, (SELECT count(*) FROM issues WHERE NOT resolved AND severity = 'info') AS open_info""")
def status_summary(spark, sf_dir):
    a = audit_frames(spark, sf_dir)
    return audit.status(a["projects"], a["validations"], a["issues"]).withColumn("last_scanned", F.date_format("last_scanned", "yyyy-MM-dd HH:mm:ss"))


_STRATA = "e AS (SELECT event_id, event_type, value * 0.5 - 30 AS snr FROM events), b AS (SELECT *, (snr >= -20)::INT + (snr >= -10)::INT + (snr >= 0)::INT + (snr >= 10)::INT + (snr >= 20)::INT AS snr_bin FROM e)"


@query(f"""WITH {_STRATA}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type, snr_bin ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type, snr_bin) AS n FROM b)
    SELECT event_id, event_type, snr_bin, CASE WHEN i <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS part FROM r""")
def stratified_split(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", training.snr_bin(F.col("value") * 0.5 - 30).alias("snr_bin"))
    return training.stratified_split(e, ["event_type", "snr_bin"], "event_id", block=4096).select("event_id", "event_type", "snr_bin", "part")


@query("""WITH c AS (SELECT label::INT AS label, count(*) AS n FROM embeddings GROUP BY 1), k AS (SELECT i::INT AS label FROM range(12) t(i)), f AS (SELECT label, coalesce(n, 0) AS n FROM k LEFT JOIN c USING (label))
    SELECT label, n, round(12 * (1.0::DOUBLE / greatest(n, 1)) / sum(1.0::DOUBLE / greatest(n, 1)) OVER (), 6) AS weight FROM f""")
def class_weights(spark, sf_dir):
    classes = spark.range(12).select(F.col("id").cast("int").alias("label"))
    return training.class_weights(table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("label")), "label", classes).withColumn("weight", F.round("weight", 6))


@query("""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), t AS (SELECT coalesce(max(n) FILTER (label = 3), 0) AS n_of, coalesce(max(n) FILTER (label <> 3), 0) AS n_other FROM c)
    SELECT n_of, n_other, n_other > 0 AND n_of > 3 * n_other AS skewed FROM t""")
def class_skew(spark, sf_dir):
    return training.skewed(table(spark, sf_dir, "embeddings"), "label", of=3)


@query("SELECT event_id, value FROM events WHERE value >= 20 ORDER BY (event_id * 7919 + 42) % 100003, event_id LIMIT 512")
def calibration_sample(spark, sf_dir):
    key = (F.col("event_id") * 7919 + 42) % 100003
    return training.calibration_sample(table(spark, sf_dir, "events").select("event_id", "value"), F.col("value") >= 20, [key, "event_id"], 512)


@query("SELECT event_id, value FROM events ORDER BY (event_id * 7919 + 42) % 100003, event_id LIMIT 512")
def calibration_fallback(spark, sf_dir):
    key = (F.col("event_id") * 7919 + 42) % 100003
    return training.calibration_sample(table(spark, sf_dir, "events").select("event_id", "value"), F.col("value") >= 1e9, [key, "event_id"], 512)


@query("""WITH l AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x, round(embedding[i + 1]::DOUBLE, 1) AS y FROM embeddings, range(10) t(i)),
    a AS (SELECT vec_id, i FROM l QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) = 1), b AS (SELECT vec_id, i FROM l QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY y DESC, i) = 1)
    SELECT count(*) AS n, round(100 * avg((a.i = b.i)::INT::DOUBLE), 6) AS agreement, 100 - 100 * avg((a.i = b.i)::INT::DOUBLE) <= 3 AS accepted FROM a JOIN b USING (vec_id)""")
def top1_agreement(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("x"))
    exact = e.select("vec_id", judging.argmax(F.col("x")).alias("pred"))
    coarse = e.select("vec_id", judging.argmax(F.transform("x", lambda v: F.round(v, 1))).alias("pred"))
    return training.agreement(exact, coarse, "vec_id").withColumn("agreement", F.round("agreement", 6))


_UNION = f"""u AS (SELECT 'events' AS source, event_id AS id, {sql_case('event_type', [('click', 'NBFM_25'), ('error', 'QPSK'), ('purchase', 'GMSK_BT03'), ('signup', 'AM-DSB'), ('view', 'WBFM')])} AS order_name FROM events
    UNION ALL SELECT 'embeddings', vec_id, CASE label % 3 WHEN 0 THEN 'BPSK' WHEN 1 THEN '64QAM' ELSE 'PAM4' END FROM embeddings)"""


@query(f"""WITH {_UNION}, d(order_name, family, prio) AS (VALUES {', '.join(f"('{o}', '{f}', {p})" for p, (s, m) in enumerate(vocab.FAMILY_SOURCES) for f, v in m.items() for o in v)}),
    k AS (SELECT order_name, arg_min(family, prio) AS family FROM d GROUP BY 1)
    SELECT source, family, count(*) AS n FROM u LEFT JOIN k USING (order_name) WHERE NOT (source = 'embeddings' AND order_name IN ('WBFM', 'BPSK', 'QPSK')) GROUP BY 1, 2""")
def dataset_union(spark, sf_dir):
    from wavelake.plans.base import case

    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), case(F.col("event_type"), [("click", "NBFM_25"), ("error", "QPSK"), ("purchase", "GMSK_BT03"), ("signup", "AM-DSB"), ("view", "WBFM")]).alias("order_name"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") % 3 == 0, "BPSK").when(F.col("label") % 3 == 1, "64QAM").otherwise("PAM4").alias("order_name"))
    u = training.union_sources({"events": e, "embeddings": v})
    u = u.filter(~((F.col("source") == "embeddings") & F.col("order_name").isin(vocab.SKIP_FOR_FAMILY)))
    return training.order_families(u, "order_name").groupBy("source", "family").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT user_id AS file, count(*) % 10 AS carriers, avg(value) * 26 AS m, stddev_pop(value) * 3 AS s, count(*) FILTER (event_type = 'click') % 9 AS sy, count(*) FILTER (event_type = 'view') % 9 AS qp, max(value) * 60 AS w FROM events GROUP BY 1),
    h AS (SELECT *, least(1.0::DOUBLE, carriers / 8.0::DOUBLE) AS c1, CASE WHEN carriers < 2 THEN 0.0::DOUBLE WHEN abs(m - 1300) <= 150 AND s <= 160 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - abs(m - 1300) / 150) * 0.5::DOUBLE + greatest(0.0::DOUBLE, 1 - s / 160) * 0.5::DOUBLE END AS c2,
        CASE WHEN w BETWEEN 9000 AND 12000 THEN 1.0::DOUBLE WHEN w >= 8000 AND w < 9000 THEN (w - 8000) / 1000 WHEN w > 12000 AND w <= 13000 THEN (13000 - w) / 1000 ELSE 0.0::DOUBLE END AS b FROM g)
    SELECT file, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (c1 * 0.4::DOUBLE + c2 * 0.25::DOUBLE + sy / 8.0::DOUBLE * 0.2::DOUBLE + qp / 8.0::DOUBLE * 0.15::DOUBLE) * CASE WHEN b > 0.5 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END)), 6) AS confidence FROM h""")
def confidence_score(spark, sf_dir):
    from wavelake.operators.spectral import confidence_score as score

    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("file")).agg(
        (F.count(F.lit(1)) % 10).alias("c"), (F.avg("value") * 26).alias("m"), (F.stddev_pop("value") * 3).alias("s"),
        (F.count_if(F.col("event_type") == "click") % 9).alias("sy"), (F.count_if(F.col("event_type") == "view") % 9).alias("qp"), (F.max("value") * 60).alias("w"),
    )
    return e.select("file", F.round(score(*(F.col(x) for x in ("c", "m", "s", "sy", "qp", "w"))), 6).alias("confidence"))


@query("SELECT event_type, sum((props ->> '$.k')::BIGINT)::BIGINT AS total, count(*) FILTER ((props ->> '$.k')::BIGINT > 50) AS large FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").withColumn("k", k).groupBy("event_type").agg(F.sum("k").alias("total"), F.count_if(F.col("k") > 50).alias("large"))
