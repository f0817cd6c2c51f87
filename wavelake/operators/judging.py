"""Votes over chunks, label matching, verdicts, issues and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake import vocab
from wavelake.operators.spectral import bound
from wavelake.operators.textmine import to_digits


def majority_vote(chunks: DataFrame, keys: list[str], label: str, confidence: str, order: str) -> DataFrame:
    """One row for each key: the most frequent label, of equals the one seen first, and its mean confidence.

    Counts are combined map-side by (key, label), and the few labels of a key
    meet in one fixed-width maximum.
    """
    by_label = chunks.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.avg(F.col(confidence).cast("double")).alias("conf"))
    best = F.max(F.struct("n", (-F.col("first")).alias("late"), F.col(label).alias("label"), "conf"))
    return by_label.groupBy(*keys).agg(best.alias("b"), F.sum("n").alias("n_chunks")).select(*keys, F.col("b.label").alias(label), F.col("b.conf").alias(confidence), F.col("b.n").alias("votes"), "n_chunks")


def mean_vector(rows: DataFrame, keys: list[str], array: str) -> DataFrame:
    """Elementwise mean of arrays by key."""
    long = rows.select(*keys, F.posexplode(array).alias("pos", "v"))
    means = long.groupBy(*keys, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias(array))


def softmax(values: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    shifted = bound(F.array_max(values).cast("double"), lambda most: F.transform(values, lambda x: F.exp(x.cast("double") - most)))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return bound(shifted, lambda e: bound(total(e), lambda t: F.transform(e, lambda x: x / t)))


def argmax(values: Column) -> Column:
    """Index of the first largest element, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def family_match(expected: Column, expected_order: Column, predicted: Column) -> Column:
    got = F.upper(F.trim(predicted))
    return F.when(F.trim(expected_order).isin(vocab.SSB_ORDERS), got.isin(vocab.SSB_FAMILIES)).otherwise(F.upper(F.trim(expected)) == got)


def order_match(rows: DataFrame, expected: str, predicted: str, out: str) -> DataFrame:
    """Adds whether predicted is accepted for expected: by the alias table, else when equal."""
    aliases = vocab.alias_frame(rows.sparkSession).groupBy("expected").agg(F.collect_set("accepted").alias("_accepted")).withColumnRenamed("expected", "_expected")
    # The alias table is a fixed list of a few rows.
    joined = rows.join(F.broadcast(aliases), F.trim(expected) == F.col("_expected"), "left")
    return joined.withColumn(out, F.coalesce(F.array_contains("_accepted", F.col(predicted)), F.trim(expected) == F.col(predicted))).drop("_accepted", "_expected")


def verdicts(rows: DataFrame) -> DataFrame:
    """Adds family_pass, order_pass, hard_fail and reason to rows with expected_*, predicted_* and family_confidence."""
    family = family_match(F.col("expected_family"), F.col("expected_order"), F.col("predicted_family"))
    out = order_match(rows, "expected_order", "predicted_order", "order_pass").withColumn("family_pass", family)
    low = F.col("family_confidence") < vocab.HARD_FAIL
    return out.withColumn("hard_fail", ~F.col("family_pass") | low).withColumn(
        "reason",
        F.when(~F.col("family_pass"), F.format_string("Wrong family: expected %s, got %s", "expected_family", "predicted_family"))
        .when(low, F.format_string("Family confidence %.2f below hard-fail threshold 0.4", to_digits(F.col("family_confidence"), 2))),
    )


def custom_verdicts(rows: DataFrame, threshold: float = vocab.THRESHOLD) -> DataFrame:
    """The same for plugin results: mode_id, pass_overall, confidence against expected_order."""
    ok = F.col("pass_overall") & (F.col("confidence") >= threshold)
    failed = ~F.col("pass_overall") & (F.col("confidence") < vocab.HARD_FAIL)
    other = F.col("mode_id") != F.col("expected_order")
    return rows.withColumns({
        "family_pass": ok, "order_pass": ok, "hard_fail": failed | other,
        "reason": F.when(failed, F.format_string("Custom mode %s failed with confidence %.2f below 0.4", "mode_id", to_digits(F.col("confidence"), 2))).when(other, F.format_string("Plugin mode_id %s != expected_order %s", "mode_id", "expected_order")),
    })


def exit_code() -> Column:
    return F.when(F.col("hard_fail"), 2).when(F.col("family_pass") & F.col("order_pass"), 0).otherwise(1)


def run_code(results: DataFrame) -> DataFrame:
    """The worst exit code of a run; 1 when nothing ran."""
    return results.agg(F.coalesce(F.max(exit_code()), F.lit(1)).alias("code"))


def summary(results: DataFrame) -> DataFrame:
    """Counters of a report; the pass rate of an empty run is 0."""
    ok = F.col("family_pass") & F.col("order_pass") & ~F.col("hard_fail")
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.count_if("hard_fail").alias("hard_fails"),
        F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("pass_rate"),
    )


def overall_label(hard: Column, soft: Column, passed: Column) -> Column:
    return F.when(hard > 0, "HARD FAIL").when(soft > 0, "SOFT FAIL").when(passed > 0, "PASS").otherwise("SKIPPED")


def confidence_band(confidence: Column, threshold: float = vocab.THRESHOLD) -> Column:
    return F.when(confidence >= threshold, "green").when(confidence < vocab.HARD_FAIL, "red").otherwise("yellow")


def issues(results: DataFrame, threshold: float = vocab.THRESHOLD) -> DataFrame:
    """The issues that results raise, up to two each: (block, severity, description)."""
    ok = F.col("family_pass") & F.col("order_pass")
    low = (F.col("family_confidence") < threshold) | (F.col("order_confidence") < threshold)
    main = (
        F.when(F.col("hard_fail"), F.struct(F.lit("hard_fail").alias("severity"), F.concat_ws(": ", "block", "reason").alias("description")))
        .when(~ok, F.struct(F.lit("soft_fail").alias("severity"), F.format_string("%s: expected %s/%s, got %s/%s", "block", "expected_family", "expected_order", "predicted_family", "predicted_order").alias("description")))
        .when(low, F.struct(F.lit("warning").alias("severity"), F.format_string("%s: correct label, low confidence", "block").alias("description")))
    )
    noted = F.col("note").contains("Approximation") | F.lower("note").contains("protocol")
    extra = F.when(noted, F.struct(F.lit("info").alias("severity"), F.concat_ws(": ", "block", "note").alias("description")))
    return results.select("block", F.explode(F.filter(F.array(main, extra), lambda x: x.isNotNull())).alias("i")).select("block", "i.severity", "i.description")


def markdown_rows(results: DataFrame) -> DataFrame:
    """One line of a markdown table for each result."""
    tick = lambda c: F.when(F.col(c), "✓").otherwise("✗")
    return results.select("block", F.concat(F.lit("| "), F.concat_ws(" | ", "block", "expected_order", "predicted_order", F.format_string("%.2f", to_digits(F.col("family_confidence"), 2)), tick("family_pass"), tick("order_pass"), tick("hard_fail")), F.lit(" |")).alias("line"))


def project_reports(results: DataFrame, raised: DataFrame) -> DataFrame:
    """(project, report): a markdown report of each project of results (project, version, notice, run_at, block, skip_reason, verdict columns) with its issues (project, severity, description).

    Counters, the overall label, a row for each block, issues and what was
    skipped. A project has as many rows as blocks; they meet in one array.
    """
    skipped = F.col("skip_reason").isNotNull()
    ok = ~skipped & F.col("family_pass") & F.col("order_pass") & ~F.col("hard_fail")
    hard = ~skipped & F.col("hard_fail")
    mark = F.when(hard, "FAIL").when(ok, "PASS").otherwise("WARN")
    line = F.concat_ws(" | ", "block", F.concat_ws("/", "expected_family", "expected_order"), F.concat_ws("/", "predicted_family", "predicted_order"), F.format_string("%.2f", to_digits(F.col("family_confidence"), 2)), mark)
    listed = lambda when, text: F.array_join(F.array_sort(F.collect_list(F.when(when, text))), "\n")
    each = results.groupBy("project").agg(
        F.first("version").alias("version"), F.first("notice").alias("notice"), F.max("run_at").alias("run_at"), F.count_if(ok).alias("passed"), F.count_if(hard).alias("hard"),
        F.count_if(~skipped & ~ok & ~hard).alias("soft"), F.count_if(skipped).alias("skipped"),
        listed(~skipped, F.concat(F.lit("| "), line, F.lit(" |"))).alias("rows"), listed(skipped, F.concat(F.lit("- "), F.col("block"), F.lit(": "), F.col("skip_reason"))).alias("left_out"),
    )
    notes = raised.groupBy("project").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col("severity"), F.lit(": "), F.col("description")))), "\n").alias("notes"))
    out = each.join(notes, "project", "left")
    notice = F.regexp_replace(F.substring("notice", 1, 500), "\n", " ")
    count = lambda name, c: F.concat(F.lit(f"| {name} | "), F.col(c).cast("string"), F.lit(" |"))
    report = F.concat_ws(
        "\n", F.concat(F.lit("# Validation of "), F.col("project")), F.concat(F.lit("Run: "), F.col("run_at").cast("string")), F.concat(F.lit("Version: "), F.col("version")),
        F.when(F.length("notice") > 0, F.concat(F.lit("Machine-made text is declared: "), notice)), F.lit("## Summary"), count("passed", "passed"), count("soft failed", "soft"), count("hard failed", "hard"), count("skipped", "skipped"),
        F.concat(F.lit("Overall: "), overall_label(F.col("hard"), F.col("soft"), F.col("passed"))), F.lit("## Blocks"), "rows", F.lit("## Issues"), F.coalesce("notes", F.lit("none")), F.lit("## Skipped"), F.when(F.col("left_out") != "", F.col("left_out")).otherwise("none"),
    )
    return out.select("project", report.alias("report"))
