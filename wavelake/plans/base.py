"""How the test tables stand for the engine's inputs, in Spark and in SQL.

events are predictions of chunks (user_id the file, event_id the chunk,
event_type the label, value the confidence), validations and issues;
embeddings are windows of 32 I/Q samples; customers are projects and orders
blocks; documents are README texts and pages scraped pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RATE = 32000.0
STEP = 1000.0


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL of the same result."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LABELS = [("click", "FM", "NBFM_25"), ("error", "PSK", "QPSK"), ("purchase", "FSK", "GMSK_BT03"), ("signup", "AM", "AM-DSB"), ("view", "FSK", "NXDN")]
EXPECTED = [("AM", "AM-SSB"), ("FM", "NBFM_25"), ("FSK", "GMSK"), ("PSK", "QPSK"), ("FSK", "CPFSK"), ("AM", "AM-DSB")]


def case(column: Column, pairs: list[tuple]) -> Column:
    out = F.when(column == pairs[0][0], pairs[0][1])
    for k, v in pairs[1:]:
        out = out.when(column == k, v)
    return out


def sql_case(column: str, pairs: list[tuple]) -> str:
    show = lambda v: v if isinstance(v, (int, float)) else f"'{v}'"
    return f"CASE {column} " + " ".join(f"WHEN {show(k)} THEN {show(v)}" for k, v in pairs) + " END"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("user_id").alias("file"), case(F.col("event_type"), [(k, f) for k, f, _ in LABELS]).alias("predicted_family"),
        case(F.col("event_type"), [(k, o) for k, _, o in LABELS]).alias("predicted_order"), (F.col("value") / (F.col("value") + 50.0)).alias("confidence"),
    )


PREDICTIONS = f"""p AS (SELECT event_id, user_id AS file, {sql_case("event_type", [(k, f) for k, f, _ in LABELS])} AS predicted_family,
    {sql_case("event_type", [(k, o) for k, _, o in LABELS])} AS predicted_order, value / (value + 50.0) AS confidence FROM events)"""


def expectations(rows: DataFrame) -> DataFrame:
    i = F.pmod("file", F.lit(len(EXPECTED)))
    return rows.withColumn("expected_family", case(i, [(k, f) for k, (f, _) in enumerate(EXPECTED)])).withColumn("expected_order", case(i, [(k, o) for k, (_, o) in enumerate(EXPECTED)]))


def vote_sql(label: str, name: str) -> str:
    return f"""{name} AS (SELECT file, {label}, conf, n, sum(n) OVER (PARTITION BY file)::BIGINT AS n_chunks FROM
        (SELECT file, {label}, count(*) AS n, min(event_id) AS k, avg(confidence) AS conf FROM p GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY file ORDER BY n DESC, k) = 1)"""


def alias_sql() -> str:
    from wavelake.vocab import ORDER_ALIASES

    rows = ", ".join(f"('{k}', '{a}')" for k, v in sorted(ORDER_ALIASES.items()) for a in v)
    return f"alias(expected, accepted) AS (VALUES {rows})"


VERDICTS = f"""{PREDICTIONS}, {vote_sql("predicted_family", "vf")}, {vote_sql("predicted_order", "vo")}, {alias_sql()},
    r AS (SELECT vf.file, vf.predicted_family, vo.predicted_order, vf.conf AS family_confidence, vo.conf AS order_confidence,
        {sql_case(f"vf.file % {len(EXPECTED)}", [(k, f) for k, (f, _) in enumerate(EXPECTED)])} AS expected_family,
        {sql_case(f"vf.file % {len(EXPECTED)}", [(k, o) for k, (_, o) in enumerate(EXPECTED)])} AS expected_order FROM vf JOIN vo USING (file)),
    m AS (SELECT *, CASE WHEN expected_order IN ('AM-SSB', 'AM-DSB-SC', 'USB', 'LSB') THEN predicted_family IN ('AM', 'FM', 'QAM') ELSE expected_family = predicted_family END AS family_pass,
        CASE WHEN expected_order IN (SELECT expected FROM alias) THEN (expected_order, predicted_order) IN (SELECT (expected, accepted) FROM alias) ELSE expected_order = predicted_order END AS order_pass FROM r),
    verdict AS (SELECT *, NOT family_pass OR family_confidence < 0.4 AS hard_fail,
        CASE WHEN NOT family_pass THEN printf('Wrong family: expected %s, got %s', expected_family, predicted_family)
             WHEN family_confidence < 0.4 THEN printf('Family confidence %.2f below hard-fail threshold 0.4', family_confidence) END AS reason FROM m)"""


def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavelake.operators import judging

    p = predictions(spark, sf_dir)
    fam = judging.majority_vote(p, ["file"], "predicted_family", "confidence", "event_id").select("file", "predicted_family", F.col("confidence").alias("family_confidence"))
    order = judging.majority_vote(p, ["file"], "predicted_order", "confidence", "event_id").select("file", "predicted_order", F.col("confidence").alias("order_confidence"))
    return judging.verdicts(expectations(fam.join(order, "file")))


def audit_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """projects, blocks, validations and issues out of customers, orders and events.

    Each user is a block; block b belongs to customer b % 40.
    Signups are validations; all else is an issue, of which clicks have no block
    and views no project.
    """
    e = table(spark, sf_dir, "events")
    c = table(spark, sf_dir, "customer")
    projects = c.select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("project_name"), F.expr("timestamp_ntz '2024-01-10 00:00:00' + make_dt_interval(cast(c_custkey as int))").alias("last_scanned"))
    blocks = e.select(F.col("user_id").alias("block_id")).distinct().select("block_id", F.concat(F.lit("mod_"), F.col("block_id").cast("string")).alias("block_name"), F.pmod("block_id", F.lit(40)).alias("project_id"))
    validations = e.filter("event_type = 'signup'").select(F.col("event_id").alias("validation_id"), F.col("user_id").alias("block_id"), F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("run_at"), "value")
    issues = e.filter("event_type <> 'signup'").select(
        F.col("event_id").alias("issue_id"),
        F.when(F.col("event_type") != "view", F.pmod("user_id", F.lit(60))).alias("project_id"),
        F.when(F.col("event_type") != "click", F.col("user_id")).alias("block_id"),
        F.col("ts").alias("detected_at"),
        case(F.col("event_type"), [("error", "hard_fail"), ("purchase", "soft_fail"), ("click", "warning"), ("view", "info")]).alias("severity"),
        F.concat(F.lit("k="), F.get_json_object("props", "$.k")).alias("description"),
        (F.pmod("event_id", F.lit(3)) == 0).alias("resolved"),
    )
    return {"projects": projects, "blocks": blocks, "validations": validations, "issues": issues}


AUDIT = """projects AS (SELECT c_custkey AS project_id, c_name AS project_name, TIMESTAMP '2024-01-10 00:00:00' + to_days(c_custkey::INT) AS last_scanned FROM customer),
    blocks AS (SELECT DISTINCT user_id AS block_id, 'mod_' || user_id AS block_name, user_id % 40 AS project_id FROM events),
    validations AS (SELECT event_id AS validation_id, user_id AS block_id, date_trunc('day', ts)::TIMESTAMP AS run_at, value FROM events WHERE event_type = 'signup'),
    issues AS (SELECT event_id AS issue_id, CASE WHEN event_type <> 'view' THEN user_id % 60 END AS project_id, CASE WHEN event_type <> 'click' THEN user_id END AS block_id, ts AS detected_at,
        CASE event_type WHEN 'error' THEN 'hard_fail' WHEN 'purchase' THEN 'soft_fail' WHEN 'click' THEN 'warning' WHEN 'view' THEN 'info' END AS severity,
        'k=' || (props ->> '$.k') AS description, event_id % 3 = 0 AS resolved FROM events WHERE event_type <> 'signup')"""

SAMPLES = "s AS (SELECT vec_id, label, n::INT AS n, embedding[2 * n + 1]::DOUBLE AS re, embedding[2 * n + 2]::DOUBLE AS im FROM embeddings, range(32) t(n))"
SPECTRA = f"""{SAMPLES}, f AS (SELECT vec_id, label, k::INT AS bin, sqrt(pow(sum(re * cos(2 * pi() * k * n / 32) + im * sin(2 * pi() * k * n / 32)), 2)
        + pow(sum(im * cos(2 * pi() * k * n / 32) - re * sin(2 * pi() * k * n / 32)), 2)) AS mag FROM s, range(-16, 16) t(k) GROUP BY 1, 2, 3)"""


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavelake.operators import spectral

    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", spectral.fft_magnitudes("embedding").alias("mags"))
