"""The audit store: listings, latest runs, purges and upserts as frame-to-frame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.operators.ordered import numbered
from wavelake.shared import stored


def list_issues(issues: DataFrame, projects: DataFrame, blocks: DataFrame | None = None, project: str | None = None, severity: str | None = None, since: str | None = None, open_only: bool = False) -> DataFrame:
    """Issues with the names of their projects and blocks; null where they have none. The name filter ignores case and takes % and _."""
    if open_only:
        issues = issues.filter("not resolved")
    if severity is not None:
        issues = issues.filter(F.col("severity") == severity)
    if since is not None:
        issues = issues.filter(F.col("detected_at") >= F.lit(since).cast("timestamp_ntz"))
    out = issues.join(projects.select("project_id", "project_name"), "project_id", "left")
    if blocks is not None:
        out = out.join(blocks.select("block_id", "block_name"), "block_id", "left")
    return out if project is None else out.filter(F.col("project_name").ilike(f"%{project}%"))


def list_projects(projects: DataFrame) -> DataFrame:
    """Newest scan first, projects never scanned last."""
    return projects.orderBy(F.desc_nulls_last("last_scanned"), "project_id")


def count_issues(issues: DataFrame, open_only: bool = False) -> DataFrame:
    """One row: how many issues there are, or are open."""
    return issues.agg(F.count_if(~F.col("resolved") | F.lit(not open_only)).alias("issues"))


def latest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """One row for each key: the newest, of equals that of largest tie. A fixed number of rows leaves each task."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(whole, F.struct(at, tie)).alias("r")).select("r.*")


def newest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """All rows that are as new as the newest of their key."""
    # Written, so that the join deals out its sides anew and Spark can split a key with many rows.
    last = stored(rows.groupBy(key).agg(F.max(at).alias("_last")), "newest")
    return rows.join(last, key).filter(F.col(at) == F.col("_last")).drop("_last")


def purged_validations(validations: DataFrame) -> DataFrame:
    """What stays of validations (block_id, run_at): the newest of each block, ties all."""
    return newest(validations, "block_id", "run_at")


def purged_issues(issues: DataFrame, validations: DataFrame, blocks: DataFrame, projects: DataFrame) -> DataFrame:
    """Issues with `stale`: older than the first of the latest runs of their project's blocks, or, without runs, than its last scan. Without a project none is stale."""
    last = validations.groupBy("block_id").agg(F.max("run_at").alias("run_at"))
    cut = last.join(blocks.select("block_id", "project_id"), "block_id").groupBy("project_id").agg(F.min("run_at").alias("cut"))
    known = projects.select("project_id", "last_scanned").join(cut, "project_id", "left")
    bound = F.coalesce("cut", "last_scanned", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    known = known.select("project_id", bound.alias("bound"))
    return issues.join(known, "project_id", "left").withColumn("stale", F.coalesce(F.col("detected_at") < F.col("bound"), F.lit(False))).drop("bound")


def superseded(issues: DataFrame, blocks: DataFrame) -> DataFrame:
    """Open issues of re-scanned blocks are resolved and say so; issues without a block stay."""
    again = blocks.select("block_id").distinct().withColumn("_again", F.lit(True))
    hit = F.coalesce("_again", F.lit(False)) & ~F.col("resolved")
    joined = issues.join(again, "block_id", "left")
    return joined.withColumn("description", F.when(hit, F.concat("description", F.lit(" | superseded by re-scan"))).otherwise(F.col("description"))).withColumn("resolved", F.col("resolved") | hit).drop("_again")


def resolved(issues: DataFrame, issue_id: int, note: str | None = None) -> DataFrame:
    hit = F.col("issue_id") == issue_id
    text = F.col("description") if note is None else F.concat("description", F.lit(f" | {note}"))
    return issues.withColumn("description", F.when(hit, text).otherwise(F.col("description"))).withColumn("resolved", F.col("resolved") | hit)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], id_col: str, keep: list[str]) -> DataFrame:
    """Rows of old and new by key: new values where there are any, ids and `keep` columns from old, ids beyond the largest for the rest."""
    fresh = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_there"))
    joined = old.join(fresh, keys, "full")
    most = old.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_most"))
    # New keys are counted in key order, over range partitions; one row is joined to them.
    added = numbered(joined.filter(F.col(id_col).isNull()), [], keys, "_n").crossJoin(F.broadcast(most)).withColumn(id_col, F.col("_most") + F.col("_n") + 1).drop("_n", "_most")
    both = joined.filter(F.col(id_col).isNotNull()).unionByName(added.select(*joined.columns))

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(c)
        return F.coalesce(c, f"_new_{c}") if c in keep else F.coalesce(f"_new_{c}", c)

    return both.select(id_col, *keys, *[value(c).alias(c) for c in old.columns if c not in (id_col, *keys)])


def status(projects: DataFrame, validations: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: projects, validations, open issues by severity, last scan."""
    opened = issues.filter("not resolved").agg(*[F.count_if(F.col("severity") == s).alias(f"open_{s}") for s in ("hard_fail", "soft_fail", "warning", "info")])
    return projects.agg(F.count(F.lit(1)).alias("projects"), F.max("last_scanned").alias("last_scanned")).crossJoin(validations.agg(F.count(F.lit(1)).alias("validations"))).crossJoin(opened)


def upserts(old: DataFrame, new: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """The rows of new, with the ids of old rows of their keys, null for new keys; what new does not name stays."""
    held = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in old.columns if c not in keys])
    joined = new.join(held, keys, "left")
    value = lambda c: F.coalesce(F.col(c), F.col(f"_old_{c}")) if c in new.columns else F.col(f"_old_{c}")
    return joined.select(*keys, *[value(c).alias(c) for c in old.columns if c not in keys])


def project_report(validations: DataFrame, blocks: DataFrame, projects: DataFrame, project: str) -> DataFrame:
    """(block_name, expected_family, expected_order, predicted_family, predicted_order, family_pass, order_pass, run_at) of the newest validation of each block name in projects of that name, by block name.

    Of validations of one time the one of largest id counts. At most one row for each block leaves a task.
    """
    mine = projects.filter(F.col("project_name") == project).select("project_id")
    named = blocks.join(mine, "project_id").select("block_id", "block_name", "expected_family", "expected_order")
    return latest(validations.join(named, "block_id"), "block_name", "run_at", "validation_id").select("block_name", "expected_family", "expected_order", "predicted_family", "predicted_order", "family_pass", "order_pass", "run_at").orderBy("block_name")
