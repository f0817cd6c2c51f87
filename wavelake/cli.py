"""Command line over the engine: python -m wavelake.cli COMMAND."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake import paths, vocab
from wavelake.facade import Engine
from wavelake.operators import datasets, plugins, projects
from wavelake.session import session
from wavelake.shared import stored
from wavelake.sources import cache
from wavelake.sources.manifest import PRIMARY, UNVERIFIED, Manifest
from wavelake.store import AuditStore

#: What needs a network, a radio toolkit, a vendor's compiler or h5py, none of which this engine has.
OUTSIDE = ["export", "export-quantised", "export-npu", "dataset-download", "dataset-convert-hisarmod"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wavelake")
    p.add_argument("--store", default="audit", help="folder of the audit store")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *positional: str, **options) -> None:
        c = sub.add_parser(name)
        for x in positional:
            c.add_argument(x.rstrip("?"), **({"nargs": "?"} if x.endswith("?") else {}))
        for k, v in options.items():
            c.add_argument("--" + k.replace("_", "-"), **(v if isinstance(v, dict) else {"default": v}))

    flag, many = {"action": "store_true"}, {"nargs": "*"}
    written = {"output": None, "format": {"choices": ["json", "csv", "markdown"], "default": "json"}}
    share = {"type": float, "default": vocab.THRESHOLD}
    add("validate", "path", repo=None, threshold=share, **written)
    add("classify", "path", threshold=share, **written)
    add("report", "path", repo=None, threshold=share, **written)
    add("train", "windows", "out")
    add("verify-family", "path")
    add("cache-clean", "path", version=cache.VERSION, dry_run=flag)
    add("checksum-verify", "folder", "file")
    add("checksum-update", "folder", "file")
    add("dataset-status", "root")
    add("dataset-verify", "root", "file")
    add("dataset-info", "path")
    add("dataset-checksum-update", "root", "file")
    for name in ("generate", "dataset-generate-synthetic"):
        add(name, "out", modes=many, chunks_per_snr={"type": int, "default": 1000}, seed={"type": int, "default": 42})
    add("scan", "path?")
    add("scan-run", "path?", at={"required": True}, includes=many, excludes=many)
    add("scan-issues", project=None, severity=None, since=None, open_only=flag)
    add("scan-purge", dry_run=flag)
    add("scan-resolve", "issue_id", note=None)
    add("scan-status")
    add("scan-list")
    add("scan-report", "project")
    add("plugins-list")
    add("plugins-describe", "mode_id")
    add("plugins")
    add("verify-generators")
    for name in OUTSIDE:
        add(name)
    return p


def show(frame: DataFrame, output: str | None = None, form: str = "json") -> int:
    """Print rows, or write them to a folder; as JSON lines, CSV or rows of a Markdown table."""
    columns = frame.columns
    if form == "markdown":
        cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in columns]), F.lit(" |"))
        lines, head = frame.select(cells.alias("value")), [f"| {' | '.join(columns)} |", "|" + "---|" * len(columns)]
    elif form == "csv":
        lines, head = frame.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("value")), [",".join(columns)]
    else:
        lines, head = frame.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("value")), []
    if output and form == "json":
        lines.write.mode("overwrite").text(output)
    elif output:  # a part of its own for each task, each with the head
        frame.write.mode("overwrite").option("header", "true").csv(output) if form == "csv" else lines.write.mode("overwrite").text(output)
    else:
        for line in head:
            print(line)
        for r in lines.toLocalIterator():
            print(r.value)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command in OUTSIDE:
        print(f"{a.command}: not part of this engine", file=sys.stderr)
        return 2
    engine = Engine(session(), threshold=getattr(a, "threshold", vocab.THRESHOLD))
    spark, store = engine.spark, AuditStore(engine.spark, a.store)
    files = lambda root: projects.listing(spark, root)

    def validate() -> int:
        # Scored once: what is shown and what the code is told from are the same rows.
        results = stored(engine.validate(a.path, a.repo), "results")
        show(results, a.output, a.format)
        return engine.exit_code(results)

    def verify() -> int:
        found = datasets.verification(files(a.root), datasets.read_checksums(spark, a.file))
        return show(found) or int(not found.filter("failure").isEmpty())

    def checksums() -> int:
        for name in datasets.verified_names(files(a.folder), datasets.read_checksums(spark, a.file)):
            print(name)
        return 0

    def generate() -> int:
        classes = [m if m in vocab.ORDERS else datasets.class_of_key(m) for m in a.modes] if a.modes else None
        engine.generate(classes, a.chunks_per_snr, seed=a.seed).write.partitionBy("class").mode("overwrite").parquet(a.out)
        return 0

    def clean() -> int:
        removed, kept = cache.clean(spark, a.path, a.version, a.dry_run)
        print(f"removed={removed} kept={kept}")
        return 0

    def digests() -> int:
        datasets.update_checksums(files(a.root), a.file, "")
        print(f"manifest rows changed={Manifest(spark, f'{a.root.rstrip(chr(47))}/.manifest').refresh(files(a.root).drop('content'))}")
        return 0

    def presence() -> int:
        # Digests come from the manifest; no file is opened for them.
        known = Manifest(spark, f"{a.root.rstrip('/')}/.manifest").status(vocab.frame(spark, PRIMARY, "dataset string, name string")).select("dataset", "checksum")
        return show(datasets.status(files(a.root)).join(known, "dataset", "left").fillna(UNVERIFIED, ["checksum"]))

    def stored_report() -> int:
        if store.read("projects").filter(F.col("project_name") == a.project).isEmpty():
            print(f"project not in the store: {a.project}", file=sys.stderr)
            return 1
        return show(store.report(a.project))

    def describe() -> int:
        plugin = plugins.get(a.mode_id)
        if plugin is None:
            print(f"no plugin {a.mode_id}", file=sys.stderr)
            return 1
        print(plugin.describe())
        return 0

    commands = {
        "validate": validate, "classify": lambda: show(engine.classify(a.path), a.output, a.format), "report": lambda: show(engine.report(engine.validate(a.path, a.repo)), a.output, a.format),
        "train": lambda: show(engine.train(spark.read.parquet(a.windows), a.out)),
        "verify-family": lambda: show(projects.checkpoint_cases(spark.read.parquet(a.path))), "cache-clean": clean, "checksum-verify": checksums,
        "checksum-update": lambda: print(datasets.update_checksums(files(a.folder), a.file)) or 0, "dataset-status": presence, "dataset-verify": verify,
        "dataset-info": lambda: show(datasets.info(spark.read.parquet(a.path))), "dataset-checksum-update": digests,
        "generate": generate, "dataset-generate-synthetic": generate, "scan": lambda: show(engine.scan(paths.scan_root(a.path), None)),
        "scan-run": lambda: show(engine.scan_run(paths.scan_root(a.path), store, a.at, a.includes or vocab.INCLUDES, a.excludes or [])), "scan-report": stored_report,
        "scan-issues": lambda: show(store.list_issues(project=a.project, severity=a.severity, since=a.since, open_only=a.open_only)), "scan-purge": lambda: print(store.purge(a.dry_run)) or 0,
        "scan-resolve": lambda: int(not store.resolve(int(a.issue_id), a.note)), "scan-status": lambda: show(store.status()), "scan-list": lambda: show(store.list_projects()),
        "plugins-list": lambda: show(engine.plugins()), "plugins": lambda: show(engine.plugins()), "plugins-describe": describe, "verify-generators": lambda: show(engine.verify_generators()),
    }
    return commands[a.command]()


if __name__ == "__main__":
    sys.exit(main())
