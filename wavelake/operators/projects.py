"""Project scans over a listing of files: discovery, versions, generation plan, data set status."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake import vocab
from wavelake.operators import textmine
from wavelake.operators.datasets import TRUTH_FILES

#: Folder names that a scan does not enter; what a CMakeLists.txt says in a candidate, and in those of either version.
SKIPPED = [".git", "build", ".venv", "venv", "__pycache__", "node_modules"]
CANDIDATE = ["find_package(gnuradio", "gr_modtool", "gr_register"]
VERSION_3 = ["gnuradioconfig", "gnuradio-runtime", "find_package(gnuradio", "gr_modtool", "gr_register"]
VERSION_4 = ["gnuradio4", "find_package(gnuradio4"]
README_4, README_3 = "gnu\\s*radio\\s*4|gr\\s*4|gnuradio4", "gnu\\s*radio\\s*3\\.?10|gr\\s*3"


#: Folders below a scan's root in which a repository is looked for.
DEEPEST = 4


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, folder, name, length, content) of files under root; content is read only where a plan needs it.

    Hidden folders are not entered, but for the HEAD of repositories, of which
    each project has one.
    """
    read = spark.read.format("binaryFile")
    files = read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    if pattern == "*":
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        heads = [str(h.getPath()) for d in range(DEEPEST) for h in fs.globStatus(path(f"{root.rstrip('/')}/{'*/' * d}.git/HEAD")) or ()]
        if heads:
            files = files.unionByName(spark.read.format("binaryFile").load(heads))
    return files.withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))


def plain_text(content: Column) -> Column:
    """Bytes as text; those that are not UTF-8 are replaced."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.make_valid_utf8(content.cast("string")))


def discover(files: DataFrame, root: str, includes: list[str] | None = None, excludes: list[str] = ()) -> DataFrame:
    """(project_path, project, version, readme): out-of-tree modules, the shallowest of nested ones.

    A candidate folder has a CMakeLists.txt with a marker, a grc folder with
    block files, or an include folder of its own. The version is 3, 4, both or
    unknown, by CMake markers, block files, include folders, Python bindings,
    the README and the branch that .git/HEAD names. Bytes that are not UTF-8
    are replaced.
    """
    inside = F.regexp_replace(F.col("folder"), F.lit(f"^.*?{root.rstrip('/')}"), F.lit(""))
    files = files.withColumn("_in", inside)
    text = F.lower(plain_text(F.col("content")))
    heads = files.filter(F.col("_in").endswith("/.git") & (F.col("name") == "HEAD")).filter(text.contains("gnuradio4")).select(F.regexp_replace("folder", "/\\.git$", "").alias("project_path"), F.lit(4).alias("v"))
    for d in [*SKIPPED, *vocab.FRAMEWORK]:
        # The include folders of a module have the framework's name.
        files = files.filter(~F.concat(F.regexp_replace("_in", "/include/.*$", ""), F.lit("/")).contains(f"/{d}/"))
    said = lambda markers: functools.reduce(lambda a, b: a | b, [F.col("t").contains(m) for m in markers])
    above = lambda pattern: F.regexp_extract("folder", pattern, 1).alias("project_path")
    cmake = files.filter("name = 'CMakeLists.txt'").select(F.col("folder").alias("project_path"), text.alias("t"))
    grc = files.filter(F.col("folder").endswith("/grc") & F.col("name").endswith(".block.yml")).select(F.regexp_replace("folder", "/grc$", "").alias("project_path"))
    included = files.filter(F.col("folder").rlike("/include/(gnuradio|gnuradio-4\\.0)(/|$)"))
    four = included.filter(F.col("folder").rlike("/include/gnuradio-4\\.0(/|$)")).select(above("^(.*?)/include/")).distinct()
    # A folder below include/gnuradio speaks for version 3 unless there is one for 4 beside it.
    three = included.filter(F.col("folder").rlike("/include/gnuradio/[^/]+")).select(above("^(.*?)/include/")).distinct().join(four, "project_path", "left_anti")
    bound = files.filter(F.col("folder").rlike("/python/[^/]+/bindings(/|$)")).select(above("^(.*?)/python/[^/]+/bindings"))
    readmes = files.filter(F.lower("name").isin("readme.md", "readme.rst", "readme.txt", "readme"))
    told = readmes.select(F.col("folder").alias("project_path"), text.alias("t"))
    candidates = cmake.filter(said(CANDIDATE)).select("project_path").unionByName(grc).unionByName(included.select(above("^(.*?)/include/"))).distinct()
    votes = [cmake.filter(said(VERSION_3)), grc, three, bound, told.filter(F.col("t").rlike(README_3))], [cmake.filter(said(VERSION_4)), four, told.filter(F.col("t").rlike(README_4))]
    all_ = functools.reduce(DataFrame.unionByName, [x.select("project_path", F.lit(v).alias("v")) for v, each in zip((3, 4), votes, strict=True) for x in each], heads)
    found = candidates.join(all_.groupBy("project_path").agg(F.collect_set("v").alias("vs")), "project_path", "left")
    # An ancestor among the candidates wins: each candidate offers all its ancestors, so this is an equi-join.
    parts = F.split("project_path", "/")
    above = found.select("project_path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("up"))
    nested = above.filter("up <> project_path").join(found.select(F.col("project_path").alias("up")), "up", "left_semi").select("project_path").distinct()
    top = found.join(nested, "project_path", "left_anti").withColumn("project", F.regexp_extract("project_path", "([^/]*)$", 1))
    version = F.when(F.size("vs") > 1, "both").otherwise(F.coalesce(F.get("vs", F.lit(0)).cast("string"), F.lit("unknown")))
    readme = readmes.groupBy("folder").agg(F.min_by(plain_text(F.col("content")), "name").alias("readme"))
    out = top.join(readme.withColumnRenamed("folder", "project_path"), "project_path", "left").withColumn("version", version).drop("vs")
    return textmine.scan_names(out, "project", includes, list(excludes))


#: Why some modes of a README are not validated.
REASONS = {"DSSS": "spread spectrum, made to look like noise", "GDSS": "spread spectrum, made to look like noise", "LDPC": "a code for error correction, no modulation"}


def exclusion_reason(mode: Column) -> Column:
    """Why a mode cannot be validated; null for modes that no reason is known for. Case does not count."""
    return F.coalesce(*[F.when(F.upper(F.trim(mode)) == m, F.lit(r)) for m, r in REASONS.items()])


def plan(projects: DataFrame) -> DataFrame:
    """What to generate for the modes that READMEs name: (project, mode, block, family, order_name, method, snr_db, skip_reason)."""
    named = projects.select("project", "version", F.explode(textmine.modes(F.coalesce("readme", F.lit("")))).alias("mode"))
    looked = textmine.lookup_modes(named, "mode")
    snr = F.coalesce(*[F.when(F.upper("family") == f, F.lit(v)) for f, v in vocab.SCAN_SNR.items()], F.lit(15.0))
    skip = F.when(F.col("method") == "skip", F.concat("mode", F.lit(": "), F.coalesce(exclusion_reason(F.col("mode")), F.lit("not validatable")))).when((F.col("version") == "4") & (F.col("method") == "gr3_builtin"), "no generator for version 4")
    return looked.select("project", "mode", textmine.block_name(F.col("canonical")).alias("block"), "family", "order_name", "method", snr.alias("snr_db"), skip.alias("skip_reason"))


def completeness(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, complete): by digest where one is registered, else by size where that is known, else not."""
    valid = F.col("expected_sha").rlike("^[0-9a-fA-F]{64}$")
    joined = expected.join(files.select("name", "length", F.sha2("content", 256).alias("sha")), "name", "left")
    return joined.select("name", F.coalesce(F.when(valid, F.lower("expected_sha") == F.col("sha")), F.when(F.col("expected_size").isNotNull(), F.col("length") >= F.col("expected_size")), F.lit(False)).alias("complete"))


def dataset_status(files: DataFrame) -> DataFrame:
    """(dataset, status): present, incomplete, warning (of the first release of a corrected set) or present without a truth file, by what lies in its folder."""
    one = files.select(F.regexp_extract("folder", "([^/]*)$", 1).alias("dataset"), "name", textmine.archive_variant(F.col("name")).alias("variant"), "length")
    g = one.groupBy("dataset").agg(
        F.max(F.col("variant") == "r2").alias("r2"), F.max(F.col("variant") == "original").alias("old"), F.min("length").alias("least"),
        F.max(F.col("name").endswith(".tim")).alias("tims"), F.max(F.col("name").isin(TRUTH_FILES)).alias("truth"),
    )
    state = F.when(F.col("old") & ~F.col("r2"), "warning").when(F.col("least") == 0, "incomplete").when(F.col("tims") & ~F.col("truth"), "present (no truth file)").otherwise("present")
    return g.select("dataset", state.alias("status"))


#: What a family model is asked before it is exported: source, class, SNR and the family expected.
CASES = [
    ("radioml", "QAM16", 10, "QAM"), ("radioml", "AM-DSB", 10, "AM"), ("radioml", "CPFSK", 10, "FSK"), ("radioml", "GFSK", 10, "FSK"), ("radioml", "PAM4", 10, "PAM"),
    ("synthetic", "WBFM", 10, "FM"), ("synthetic", "BPSK", 10, "PSK"), ("synthetic", "QPSK", 10, "PSK"), ("synthetic", "NBFM_25", 10, "FM"),
]


def checkpoint_cases(scored: DataFrame, floor: float = 0.60) -> DataFrame:
    """(label, expected_family, predicted_family, family_confidence, ok, note) of each case, and of the classes that RadioML is not asked for.

    scored are windows (source, class, snr_db, number, predicted_family,
    family_confidence); the first one of a case decides. A case holds if the
    family is as expected with enough confidence; one without windows does
    not. Without any window of RadioML its cases are left out.
    """
    spark = scored.sparkSession
    cases = vocab.frame(spark, [(i, *c) for i, c in enumerate(CASES)], "ord int, source string, class string, snr int, expected_family string")
    # A fixed list of a few rows.
    mine = scored.join(F.broadcast(cases), (F.col("snr_db") == F.col("snr")) & (scored["source"] == cases["source"]) & (scored["class"] == cases["class"])).drop(scored["source"], scored["class"])
    first = mine.groupBy("ord").agg(F.min_by(F.struct("predicted_family", "family_confidence"), "number").alias("p"))
    label = F.concat_ws("", "source", F.lit(":"), "class", F.when(F.col("source") == "radioml", F.concat(F.lit("@"), F.col("snr"), F.lit("dB"))))
    ok = F.coalesce((F.col("p.predicted_family") == F.col("expected_family")) & (F.col("p.family_confidence") >= floor), F.lit(False))
    asked = cases.join(F.broadcast(first), "ord", "left").select("ord", "source", label.alias("label"), "expected_family", "p.*", ok.alias("ok"), F.when(F.col("p").isNull(), F.concat(F.lit("no windows of "), "class", F.lit(" at "), F.col("snr"), F.lit(" dB"))).alias("note"))
    skipped = vocab.frame(spark, [(100 + i, "radioml", f"radioml:{m} (left out)", "n/a", "skipped", 0.0, True, "asked of synthetic windows") for i, m in enumerate(sorted(vocab.SKIP_FOR_FAMILY))], "ord int, source string, label string, expected_family string, predicted_family string, family_confidence double, ok boolean, note string")
    there = scored.filter("source = 'radioml'").limit(1).agg((F.count("*") > 0).alias("there"))
    rows = asked.unionByName(skipped).crossJoin(F.broadcast(there)).filter((F.col("source") != "radioml") | F.col("there"))
    return rows.orderBy("ord").drop("ord", "source", "there")


def keep_quantised(agreement: Column, tolerance: float = 3.0) -> Column:
    return F.when(F.lit(100.0) - agreement <= tolerance, "keep").otherwise("discard")
