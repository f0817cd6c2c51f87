"""The audit store: tables of immutable Parquet files under a log of changes.

A change writes its own rows and nothing else: new rows, new states of rows that
are there, and marks for rows that go. Then it claims the next number of the
table's log by creating that entry, which only one writer can do. Readers take
the entries there are as their snapshot and need no other state, so a job that
dies before its claim leaves a folder that nothing names.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.operators import audit

TABLES = {
    "projects": "project_id bigint, path string, project_name string, version string, last_scanned timestamp_ntz, scan_status string",
    "blocks": "block_id bigint, project_id bigint, block_name string, expected_family string, expected_order string",
    "validations": "validation_id bigint, block_id bigint, run_at timestamp_ntz, predicted_family string, predicted_order string, family_confidence double, order_confidence double, family_pass boolean, order_pass boolean, hard_fail boolean, reason string",
    "issues": "issue_id bigint, project_id bigint, block_id bigint, detected_at timestamp_ntz, severity string, description string, resolved boolean",
}
#: Columns of the data files beside the table's: the row goes; the task that wrote a new row, and its place there.
MARKS = "_gone boolean, _task int, _place bigint"
#: Places in a task, as monotonically_increasing_id() counts them.
PLACES = (1 << 33) - 1
#: Seconds to wait for an entry that was created but has no content yet; after that its writer counts as dead.
WAIT = 10.0


@dataclass
class Entry:
    """One change. Rows without an id have the ids from `first` on: offsets[task] + place."""

    data: str
    kind: str  # insert: new rows only; change: states of old rows among them; base: all that came before
    first: int = 0
    offsets: list[int] = field(default_factory=list)
    next: int = 1
    rows: int = 0


class Conflict(Exception):
    """Another change was claimed since the snapshot."""


class AuditStore:
    """Tables under a root folder that all executors share; its file system must create a file for one caller only.

    Appends of writers at one time all take place. Other changes are computed
    from a snapshot and claim the entry after it; if another writer has it,
    they are computed anew. `compact` folds the log into one base, and `vacuum` deletes
    what came before the base.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str] = TABLES):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    # files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[int]:
        path = self._path(name, "log")
        fs = self._fs()
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def _entry(self, name: str, number: int) -> Entry | None:
        """An entry; None for one whose writer died before it wrote it."""
        until = time.time() + WAIT
        while True:
            stream = self._fs().open(self._path(name, "log", f"{number:012d}"))
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if text.endswith("\n"):
                return Entry(**json.loads(text))
            if time.time() > until:
                return None
            time.sleep(0.05)

    def snapshot(self, name: str) -> tuple[int, list[Entry]]:
        """The number of the last entry, and the entries from the last base on."""
        numbers = self._numbers(name)
        entries: list[Entry] = []
        for number in reversed(numbers):
            if (entry := self._entry(name, number)) is not None:
                entries.insert(0, entry)
                if entry.kind == "base":
                    break
        return (numbers[-1] if numbers else 0), entries

    def _claim(self, name: str, number: int, entry: Entry) -> bool:
        """Create an entry; False if another writer has."""
        fs, path = self._fs(), self._path(name, "log", f"{number:012d}")
        try:
            stream = fs.create(path, False)
        except Exception:
            if fs.exists(path):
                return False
            raise
        stream.write(bytearray((json.dumps(entry.__dict__) + "\n").encode()))
        stream.close()
        return True

    # reading

    def read(self, name: str, at: tuple[int, list[Entry]] | None = None) -> DataFrame:
        """The rows of a snapshot, the present one if none is given.

        New rows are read as they are; only rows that were changed are
        sought among them, and of their states the last one counts.
        """
        _, entries = at or self.snapshot(name)
        if not entries:
            return self.spark.createDataFrame([], self.tables[name])
        columns = [c.split()[0] for c in self.tables[name].split(", ")]
        id_col = columns[0]
        rows = self.spark.read.schema(f"{self.tables[name]}, {MARKS}").parquet(*[f"{self.root}/{name}/data/{e.data}" for e in entries])
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        of = lambda value: _looked_up({e.data: value(k, e) for k, e in enumerate(entries)}, folder)
        number = of(lambda _, e: F.lit(e.first)) + F.get(of(lambda _, e: F.array(*[F.lit(x).cast("bigint") for x in e.offsets])), F.col("_task")) + F.col("_place")
        rows = rows.withColumns({id_col: F.coalesce(F.col(id_col), number), "_at": of(lambda k, _: F.lit(k))}).drop("_task", "_place")
        changing = [k for k, e in enumerate(entries) if e.kind == "change"]
        if not changing:
            return rows.select(*columns)
        later = rows.filter(F.col("_at").isin(changing))
        states = later.groupBy(id_col).agg(F.max_by(F.struct(*columns, "_gone"), "_at").alias("r")).select("r.*")
        rest = rows.filter(~F.col("_at").isin(changing)).join(states.select(id_col), id_col, "left_anti")
        return rest.select(*columns).unionByName(states.filter("not _gone").select(*columns))

    # writing

    def _written(self, name: str, rows: DataFrame) -> tuple[str, list[int], int]:
        """Write rows; the folder, the offsets of tasks among rows without an id, and how many rows there are."""
        data = uuid.uuid4().hex
        id_col = self.tables[name].split()[0]
        kinds = self.spark.createDataFrame([], self.tables[name]).schema
        missing = lambda f: F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
        gone = F.col("_gone") if "_gone" in rows.columns else F.lit(False)
        out = rows.select(*[missing(f) for f in kinds], gone.alias("_gone"))
        out = out.withColumn("_k", F.monotonically_increasing_id())
        out.select(*kinds.names, "_gone", F.shiftright("_k", 33).cast("int").alias("_task"), F.col("_k").bitwiseAND(F.lit(PLACES)).alias("_place")).write.parquet(f"{self.root}/{name}/data/{data}")
        back = self.spark.read.schema(f"{self.tables[name]}, {MARKS}").parquet(f"{self.root}/{name}/data/{data}")
        # One row for each task: places are counted over all of its rows, so their number bounds them.
        tasks = {r["_task"]: (r["n"], r["rows"]) for r in back.groupBy("_task").agg(F.coalesce(F.max(F.when(F.col(id_col).isNull(), F.col("_place"))) + 1, F.lit(0)).alias("n"), F.count("*").alias("rows")).collect()}
        offsets, total = [], 0
        for task in range(max(tasks, default=-1) + 1):
            offsets.append(total)
            total += tasks.get(task, (0, 0))[0]
        return data, [*offsets, total], sum(n for _, n in tasks.values())

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows without ids; each gets one beyond those that are there, unique and in no order. Only they are written."""
        data, offsets, n = self._written(name, rows.drop(self.tables[name].split()[0]))
        if not n:
            return
        while True:
            last, entries = self.snapshot(name)
            first = entries[-1].next if entries else 1
            if self._claim(name, last + 1, Entry(data, "insert", first, offsets, first + offsets[-1], n)):
                return

    def change(self, name: str, f: Callable[[DataFrame], DataFrame]) -> int:
        """Apply f, which gives new states of rows by id (with `_gone`: that go) and rows without an id that are new, to the present rows. How many rows it gave.

        f is called again if another change comes in between.
        """
        while True:
            last, entries = at = self.snapshot(name)
            data, offsets, n = self._written(name, f(self.read(name, at)))
            if not n:
                return 0
            first = entries[-1].next if entries else 1
            if self._claim(name, last + 1, Entry(data, "change", first, offsets, first + offsets[-1], n)):
                return n

    def compact(self, name: str) -> None:
        """Write the present rows as a new base; what other writers do meanwhile stays, as this is then done anew."""
        while True:
            last, entries = at = self.snapshot(name)
            if not entries:
                return
            data, _, n = self._written(name, self.read(name, at))
            if self._claim(name, last + 1, Entry(data, "base", 0, [], entries[-1].next, n)):
                return

    def vacuum(self, name: str) -> int:
        """Delete entries before the last base and the folders that none names; how many folders. No reader of older snapshots or other writer may be at work."""
        fs, (_, entries) = self._fs(), self.snapshot(name)
        if not entries or not fs.exists(self._path(name, "data")):
            return 0
        for number in self._numbers(name)[: -len(entries)] if entries[0].kind == "base" else []:
            fs.delete(self._path(name, "log", f"{number:012d}"), False)
        named = {e.data for e in entries}
        unnamed = [p for p in (s.getPath() for s in fs.listStatus(self._path(name, "data"))) if p.getName() not in named]
        for path in unnamed:
            fs.delete(path, True)
        return len(unnamed)

    def kept(self, run: str, name: str, frame: DataFrame) -> DataFrame:
        """A step of a run, written and read back: its lineage ends here and what follows plans quickly."""
        path = f"{self.root}/_runs/{run}/{name}"
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    # what a scan does

    def upsert_projects(self, rows: DataFrame) -> None:
        """Rows (path, ...): the path is the key, and ids stay."""
        self.change("projects", lambda old: audit.upserts(old, rows, ["path"], "project_id"))

    def upsert_blocks(self, rows: DataFrame) -> None:
        """Rows (project_id, block_name, ...): both are the key, and ids stay."""
        self.change("blocks", lambda old: audit.upserts(old, rows, ["project_id", "block_name"], "block_id"))

    def supersede(self, blocks: DataFrame) -> int:
        """Open issues of blocks (block_id) that were scanned again are resolved; how many."""
        return self.change("issues", lambda issues: audit.superseded(issues.filter("not resolved"), blocks).filter("resolved"))

    def resolve(self, issue_id: int, note: str | None = None) -> bool:
        """Whether there was such an issue."""
        return self.change("issues", lambda issues: audit.resolved(issues.filter(F.col("issue_id") == issue_id), issue_id, note)) > 0

    def purge(self, dry_run: bool = False) -> dict[str, int]:
        """Keep the newest validations of each block and issues that are no older; how many rows go."""
        # Both are judged by the validations that are there now.
        validations = self.read("validations")
        stale = lambda issues: audit.purged_issues(issues, validations, self.read("blocks"), self.read("projects")).filter("stale").drop("stale")
        old = lambda rows: rows.join(audit.purged_validations(rows).select("validation_id"), "validation_id", "left_anti")
        if dry_run:
            return {"validations": old(validations).count(), "issues": stale(self.read("issues")).count()}
        gone = lambda f: lambda rows: f(rows).withColumn("_gone", F.lit(True))
        issues = self.change("issues", gone(stale))
        return {"validations": self.change("validations", gone(old)), "issues": issues}

    # listings

    def list_projects(self) -> DataFrame:
        return audit.list_projects(self.read("projects"))

    def list_issues(self, **options) -> DataFrame:
        """Newest first."""
        return audit.list_issues(self.read("issues"), self.read("projects"), self.read("blocks"), **options).orderBy(F.desc("detected_at"), F.desc("issue_id"))

    def count_issues(self, open_only: bool = True) -> int:
        issues = self.read("issues")
        return (issues.filter("not resolved") if open_only else issues).count()

    def status(self) -> DataFrame:
        return audit.status(self.read("projects"), self.read("validations"), self.read("issues"))

    def report(self, project: str) -> DataFrame:
        """The newest validation of each block of the projects of a name, by block; it reads and changes nothing."""
        return audit.project_report(self.read("validations"), self.read("blocks"), self.read("projects"), project)


def _looked_up(values: dict[str, Column], key: Column) -> Column:
    """The value of a key; a constant map, so that its size does not count in the plan's depth."""
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), key)
