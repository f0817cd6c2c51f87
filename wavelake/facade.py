"""The engine's surface: one object whose methods return frames."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake import vocab
from wavelake.functions import waveforms
from wavelake.operators import audit, datasets, judging, naming, plugins, projects, scoring, textmine, training
from wavelake.shared import stored
from wavelake.sources import iq
from wavelake.store import AuditStore


def naming_time(spark: SparkSession, text: str) -> str:
    """A timestamp without its zone, in UTC."""
    return spark.range(1).select(naming.scan_time(F.lit(text))).first()[0].rstrip("Z")


class Engine:
    def __init__(self, spark: SparkSession, scorer: scoring.Scorer = scoring.constant, threshold: float = vocab.THRESHOLD):
        self.spark, self.scorer, self.threshold = spark, scorer, threshold

    def classify(self, path: str) -> DataFrame:
        """(path, predicted_family, family_confidence, predicted_order, order_confidence) by vote over windows."""
        return self._voted(self.scorer(iq.read_captures(self.spark, path).filter("error is null")))

    def _voted(self, scored: DataFrame) -> DataFrame:
        # Both votes group on the capture and share its shuffle by key.
        family = judging.majority_vote(scored, ["path", "stem"], "predicted_family", "family_confidence", "chunk_idx").drop("votes", "n_chunks")
        order = judging.majority_vote(scored, ["path", "stem"], "predicted_order", "order_confidence", "chunk_idx").drop("votes")
        return family.join(order, ["path", "stem"])

    def validate(self, path: str, repo: str | None = None) -> DataFrame:
        """Verdicts of all captures under path that have a sidecar; errors of files and sidecars as rows of their own."""
        chunks = iq.read_captures(self.spark, path)
        cars = iq.read_sidecars(self.spark, path).withColumnRenamed("error", "car_error")
        if repo is not None:
            cars = cars.filter(F.col("source") == repo)
        good = cars.filter("car_error is null")
        custom = F.lower(F.trim("expected_family")) == "custom"
        plain = self._voted(self.scorer(chunks.filter("error is null"))).join(good.filter(~custom), "stem")
        out = judging.verdicts(plain).select("path", "block_name", "source", "expected_family", "expected_order", "predicted_family", "predicted_order", "family_confidence", "order_confidence", "family_pass", "order_pass", "hard_fail", "reason", F.lit(None).cast("string").alias("error"))
        for mode in plugins.registered():
            mine = good.filter(custom & (F.col("expected_order") == mode))
            rows = chunks.filter("error is null").join(mine.select("stem"), "stem", "left_semi")
            done = plugins.apply(rows.select("path", "chunk_idx", "i", "q"), mode).withColumn("stem", iq.stem(F.col("path"))).join(mine, "stem")
            out = out.unionByName(judging.custom_verdicts(done, self.threshold).select(*out.columns[:5], F.lit("custom").alias("predicted_family"), F.col("mode_id").alias("predicted_order"), F.col("confidence").alias("family_confidence"), F.col("confidence").alias("order_confidence"), "family_pass", "order_pass", "hard_fail", "reason", F.lit(None).cast("string").alias("error")))
        none = {c: F.lit(None).cast(t) for c, t in out.dtypes}
        # Spark lists no empty files: a sidecar without any window stands for one.
        bare = good.join(chunks.select("stem").distinct(), "stem", "left_anti").select(F.col("stem").alias("path"), F.lit("no chunks").alias("error"))
        failed = chunks.filter("error is not null").select("path", "error").unionByName(bare).unionByName(cars.filter("car_error is not null").select(F.col("stem").alias("path"), F.col("car_error").alias("error")))
        return out.unionByName(failed.select(*[F.col(c) if c in ("path", "error") else F.lit(True).alias(c) if c == "hard_fail" else none[c].alias(c) for c in out.columns]))

    def signals(self, path: str, out: str, truth: str | None = None, first: int = 4) -> tuple[DataFrame, DataFrame]:
        """Labelled windows of the .tim files under path, and the files that were rejected with reasons, both written below `out`; the truth file is sought under path if none is named."""
        if truth is None:
            found = datasets.truth_file(projects.listing(self.spark, path, "*.txt")).first()
            if found is None:
                raise FileNotFoundError(f"no truth file under {path}")
            truth = found.path
        return iq.sorted_out(iq._signals(self.spark, path, truth, first), out)

    def report(self, results: DataFrame) -> DataFrame:
        return judging.summary(results.fillna(False, ["family_pass", "order_pass"]))

    def exit_code(self, results: DataFrame) -> int:
        return judging.run_code(results.fillna(False, ["family_pass", "order_pass"])).first()[0]

    def generate(self, classes: list[str] | None = None, per_snr: int = 1000, snrs: list[int] | None = None, seed: int = 42) -> DataFrame:
        return waveforms.generate(self.spark, classes, per_snr, snrs, seed)

    def verify_generators(self, classes: list[str] | None = None) -> DataFrame:
        return waveforms.verify(self.spark, classes)

    def prepare_training(self, frames: dict[str, DataFrame]) -> DataFrame:
        """Windows of several sources with family, split by class and SNR."""
        rows = training.order_families(training.union_sources(frames), "class").withColumn("snr_bin", training.snr_bin(F.col("snr_db")))
        key = F.pmod(F.xxhash64("source", "class", "snr_db", "number"), F.lit(1 << 40))
        return training.stratified_split(rows.withColumn("_key", key), ["class", "snr_bin"], "_key", block=1 << 30).drop("_key")

    def train(self, windows: DataFrame, path: str) -> DataFrame:
        """Fit a family model on the training part of windows (source, class, snr_db, number, i, q), keep it under path, and give (part, windows, accuracy) of each part."""
        windows = windows.drop("family")  # it is told from the class
        sources = [r.source for r in windows.select("source").distinct().collect()]
        rows = stored(self.prepare_training({s: windows.filter(F.col("source").eqNullSafe(s)).drop("source") for s in sources}).filter("family is not null"), "training")
        fitted = scoring.fit_ml(rows.filter("part = 'train'"), "family", sorted(r.family for r in rows.select("family").distinct().collect()))
        scoring.save_ml(fitted, path)
        right = (F.col("predicted") == F.col("family")).cast("double")
        return fitted(rows, "predicted", "confidence").groupBy("part").agg(F.count("*").alias("windows"), F.avg(right).alias("accuracy"))

    def scan(self, root: str, includes: list[str] | None = vocab.INCLUDES, excludes: list[str] = ()) -> DataFrame:
        return projects.plan(projects.discover(projects.listing(self.spark, root), root, includes, excludes))

    def generate_plan(self, plan: DataFrame, per_block: int = 4, seed: int = 42) -> DataFrame:
        """Windows (stem, chunk_idx, i, q) for the rows of a plan that have a synthetic class, at the plan's SNR."""
        classes = [c for v in vocab.SYNTHETIC.values() for c in v]
        as_class = F.when(F.col("order_name") == "GMSK", "GMSK_BT03").otherwise(F.col("order_name"))
        rows = plan.filter("skip_reason is null").withColumn("class", as_class).filter(F.col("class").isin(classes))
        stem = F.concat_ws("__", "project", "block")
        made = rows.select(stem.alias("stem"), "class", "family", F.col("snr_db").cast("float").alias("snr_db"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(per_block - 1).cast("bigint"))).alias("number"))
        # A name leads to the same windows in every project, so each is made once.
        once = made.select("class", "family", "snr_db", "number").distinct().mapInPandas(waveforms._windows(seed), waveforms.SCHEMA)
        return made.join(once.drop("family"), ["class", "snr_db", "number"]).select("stem", F.col("number").alias("chunk_idx"), "i", "q")

    def scan_run(self, root: str, store: AuditStore, run_at: str, includes: list[str] | None = vocab.INCLUDES, excludes: list[str] = (), per_block: int = 4) -> DataFrame:
        """Discover, generate, score, judge, store; (project, report) of each project. Rows without a generator are skipped with a reason."""
        at = F.lit(naming_time(self.spark, run_at)).cast("timestamp_ntz")
        run = uuid.uuid4().hex
        found = store.kept(run, "projects", projects.discover(projects.listing(self.spark, root), root, includes, excludes))
        plan = store.kept(run, "plan", projects.plan(found).distinct())
        windows = self.generate_plan(plan, per_block)
        scored = store.kept(run, "votes", self._voted(self.scorer(windows.withColumn("path", F.col("stem")))))
        named = plan.withColumn("stem", F.concat_ws("__", "project", "block")).withColumnsRenamed({"family": "expected_family", "order_name": "expected_order"})
        judged = judging.verdicts(named.join(scored.drop("path"), "stem"))
        bare = named.join(scored.select("stem"), "stem", "left_anti").withColumn("skip_reason", F.coalesce("skip_reason", F.lit("no generator")))
        judged = judged.unionByName(bare, allowMissingColumns=True).join(found.select("project", "project_path", "version", "readme"), "project").withColumn("run_at", at)
        judged = store.kept(run, "verdicts", judged)
        store.upsert_projects(found.select(F.col("project_path").alias("path"), F.col("project").alias("project_name"), "version", at.alias("last_scanned"), F.lit("scanned").alias("scan_status")))
        known = store.read("projects").select("project_id", F.col("path").alias("project_path"))
        keyed = judged.join(known, "project_path").withColumnRenamed("block", "block_name")
        store.upsert_blocks(keyed.select("project_id", "block_name", "expected_family", "expected_order").distinct())
        ids = store.read("blocks").select("block_id", "project_id", "block_name")
        rows = store.kept(run, "blocks", keyed.join(ids, ["project_id", "block_name"]))
        store.supersede(rows.select("block_id"))
        store.append("validations", rows.filter("skip_reason is null").select("block_id", "run_at", "predicted_family", "predicted_order", "family_confidence", "order_confidence", "family_pass", "order_pass", "hard_fail", "reason"))
        raised = judging.issues(rows.filter("skip_reason is null").withColumn("block", F.col("block_id")).withColumn("note", F.lit(None).cast("string")), self.threshold)
        raised = raised.join(rows.select(F.col("block_id").alias("block"), "project_id", "project").distinct(), "block")
        raised = store.kept(run, "issues", raised)
        store.append("issues", raised.select("project_id", F.col("block").alias("block_id"), at.alias("detected_at"), "severity", "description", F.lit(False).alias("resolved")))
        notice = textmine.notice(F.coalesce("readme", F.lit("")))
        return store.kept(run, "reports", judging.project_reports(rows.withColumn("block", F.col("block_name")).withColumn("notice", notice), raised))

    def classify_array(self, samples, rate: float = 48_000.0) -> DataFrame:
        """The vote over one array of complex samples."""
        x = np.asarray(samples, dtype=np.complex64)
        x = x[: len(x) // vocab.CHUNK * vocab.CHUNK].reshape(-1, vocab.CHUNK)
        rows = [("array", "array", k, w.real.tolist(), w.imag.tolist()) for k, w in enumerate(x)]
        return self._voted(self.scorer(vocab.frame(self.spark, rows, "path string, stem string, chunk_idx bigint, i array<float>, q array<float>")))

    def issues(self, issues: DataFrame, projects_: DataFrame, **options) -> DataFrame:
        return audit.list_issues(issues, projects_, **options)

    def plugins(self) -> DataFrame:
        return vocab.frame(self.spark, [(m, plugins.get(m).description) for m in plugins.registered()], "mode_id string, description string")
