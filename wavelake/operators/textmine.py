"""Text mining: modes and sections of README texts, truth files, keys, links, names and sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake import vocab

#: Modes that texts are searched for, with the name found under.
SEARCHED = [(m[0], "D-Star" if m[0] == "DSTAR" else m[0]) for m in vocab.MODES]
#: Patterns that decide what a README says of the composite mode and of versions.
COMPOSITE = "(?i)sleipnir|8\\s*[-x]?\\s*carrier|8x\\s*qpsk"
GR4 = "(?i)gnu\\s*radio\\s*4|gr\\s*4|gnuradio4"
GR3 = "(?i)gnu\\s*radio\\s*3|gr\\s*3|3\\.10"


def mode_pattern(name: str) -> str:
    """Whole word, any case; a hyphen may be a blank or nothing."""
    return "(?i)\\b" + re.escape(name).replace("\\-", "[- ]?").replace("\\ ", " ") + "\\b"


def modes(text: Column) -> Column:
    """The modes that a text names, each once, sorted without regard to case.

    Names of one word are looked up among the words of the text, which is read
    once; only those with hyphens, dots or blanks need a search of their own.
    """
    simple = {}
    for name, as_ in SEARCHED:
        if re.fullmatch("\\w+", name):
            simple.setdefault(name.lower(), []).append(as_)
    one = F.array_intersect(F.split(F.lower(text), "[^a-z0-9_]+"), vocab.literal_list(list(simple)))
    table = F.create_map(*[x for n, v in simple.items() for x in (F.lit(n), vocab.literal_list(v))])
    words = F.flatten(F.transform(one, lambda w: F.element_at(table, w)))
    rest = F.array(*[F.when(text.rlike(mode_pattern(n)), F.lit(as_)) for n, as_ in SEARCHED if n.lower() not in simple], F.when(text.rlike(COMPOSITE), F.lit("sleipnir_8qpsk")))
    kept = F.array_distinct(F.filter(F.concat(words, rest), lambda x: x.isNotNull()))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))), lambda s: s["v"])


def radio_version(text: Column) -> Column:
    return F.when(text.rlike(GR4), F.when(text.rlike(GR3), "both").otherwise("4")).when(text.rlike(GR3), "3")


def has_samples(text: Column) -> Column:
    return text.rlike("(?i)\\.iq|iq_sample|file_sink|vector_sink")


def section(text: Column, heading: str, most: int = 2000) -> Column:
    """From a heading that matches to before the next one, at most `most` characters; null if there is none."""
    from_ = F.regexp_extract(text, f"(?is)(#{{1,3}}\\s*(?:{heading}).*)$", 1)
    # The text is cut at the next heading by a split, which needs no look-ahead.
    part = F.split(from_, "\n#{1,3}\\s", 2)[0]
    return F.when(from_ != "", F.substring(F.trim(F.regexp_replace(part, "^\\s+|\\s+$", "")), 1, most))


def dependencies(text: Column) -> Column:
    """Lines of the dependency section without bullets and headings, at most 200 characters each."""
    lines = F.split(F.coalesce(section(text, "dependenc(?:y|ies)", 1 << 30), F.lit("")), "\n")
    plain = F.transform(lines, lambda x: F.substring(F.trim(F.regexp_replace(F.trim(x), "^[-*]+", "")), 1, 200))
    return F.filter(plain, lambda x: (x != "") & ~x.startswith("#"))


def notice(text: Column) -> Column:
    """The notice of machine-made text that the first of three markers leads to, or null."""
    up = F.upper(text)
    at = F.coalesce(*[F.when(F.locate(m.upper(), up) > 0, F.locate(m.upper(), up)) for m in ("AI-generated", "IMPORTANT NOTICE", "AI generated")])
    window = F.substring(text, F.greatest(at - 200, F.lit(1)), 600)
    return F.when(window.rlike("(?i)\\bAI\\b"), F.substring(F.regexp_extract(F.substring(text, at, F.length(text)), "(?is)(IMPORTANT NOTICE.*?)(?=\n#{1,3}|\n\n\n|\\z)", 1), 1, 1500))


def lookup_modes(names: DataFrame, column: str) -> DataFrame:
    """Adds the mode record of a name: of the same spelling, else the first that differs in case alone."""
    dims = vocab.mode_frame(names.sparkSession)
    exact = dims.select(F.col("mode").alias(column), F.struct("canonical", "family", "order_name", "method").alias("_exact"))
    loose = dims.groupBy(F.upper("mode").alias("_up")).agg(F.min_by(F.struct("canonical", "family", "order_name", "method"), "ord").alias("_loose"))
    # The table of modes has a few dozen rows.
    out = names.join(F.broadcast(exact), column, "left").join(F.broadcast(loose), F.upper(column) == F.col("_up"), "left")
    return out.withColumn("_m", F.coalesce("_exact", "_loose")).select(*names.columns, "_m.canonical", "_m.family", "_m.order_name", "_m.method")


def truth_lines(lines: DataFrame, column: str) -> DataFrame:
    """(idx, class) of truth lines; comments, short lines and lines without a number are left out."""
    parts = F.split(F.trim(column), "\\s+")
    idx = F.regexp_replace(parts[0], "[.,]+$", "").try_cast("int")
    name = F.lower(parts[1])
    known = F.create_map(*[F.lit(x) for kv in vocab.TRUTH_ALIASES.items() for x in kv])
    rows = lines.filter((F.trim(column) != "") & ~F.trim(column).startswith("#")).filter(F.size(parts) >= 2)
    return rows.select(idx.alias("idx"), F.coalesce(F.try_element_at(known, name), F.upper(name)).alias("class")).filter("idx is not null")


def key_class(key: Column, exact_first: bool = False) -> Column:
    """The first class whose name is in the key, or that the key is in; the key itself if none is."""
    plain = F.regexp_replace(F.upper(key), "[_-]", "")
    cases = [(c.upper().replace("-", ""), c) for c in vocab.HISARMOD_ORDER]
    hits = [F.when(F.lit(k) == plain, c) for k, c in cases] if exact_first else []
    return F.coalesce(*hits, *[F.when(plain.contains(k) | F.lit(k).contains(plain), c) for k, c in cases], key)


def snr_key(key: Column) -> Column:
    """The SNR that a key states: as a number once its words are gone, else its first number, else 0."""
    rest = F.trim(F.regexp_replace(F.lower(key), "db|snr|_", ""))
    return F.coalesce(rest.try_cast("double"), F.regexp_extract(key, "([0-9.-]+)", 1).try_cast("double"), F.lit(0.0))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, href): each link target of a page once, at its first place."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit('<a[^>]*href="([^"]*)"'), 1)).alias("pos", "href"))
    return found.groupBy(key, "href").agg(F.min("pos").alias("pos")).select(key, "pos", "href")


def absolute(base: Column, href: Column) -> Column:
    """A link target against its page's address."""
    host = F.regexp_extract(base, "^([a-z]+://[^/?#]+)", 1)
    return F.when(href.rlike("^[a-z]+://"), href).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "/[^/]*$", "/"), href))


def link_priority(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.contains("c_2023") | low.contains("2018r2"), 0).when(low.contains("2023/09"), 1).when(low.endswith("/signal_record.txt"), 2).otherwise(3)


#: What marks a link to a truth file, and the file that is meant where a page has none.
TRUTH_MARKS, TRUTH_DEFAULT = ["signal_record", "metadata"], "signal_record_C_2023.txt"


def truth_links(pages: DataFrame, key: str, base: str, html: str) -> DataFrame:
    """(key, priority, url, name): links of a page to .txt files whose target or text names a truth file, each once, best first by priority; for a page without any, the default file beside it."""
    anchor = F.regexp_extract_all(html, F.lit('(?s)<a[^>]*href="[^"]*"[^>]*>.*?</a>'), 0)
    found = pages.select(key, F.col(base).alias("_base"), F.posexplode_outer(anchor).alias("_pos", "_a"))
    href = F.regexp_extract("_a", 'href="([^"]*)"', 1)
    said = F.lower(F.concat_ws(" ", href, F.regexp_replace("_a", "<[^>]*>", "")))
    url = absolute(F.col("_base"), href)
    path = F.regexp_replace(url, "[?#].*$", "")
    mine = F.lower(path).endswith(".txt") & (said.contains(TRUTH_MARKS[0]) | said.contains(TRUTH_MARKS[1]))
    rows = found.select(key, "_base", F.when(F.coalesce(mine, F.lit(False)), F.struct("_pos", url.alias("url"), F.regexp_extract(path, "([^/]*)$", 1).alias("name"))).alias("l"))
    once = rows.groupBy(key, "_base", "l.url").agg(F.min("l").alias("l"))
    # A page has the row without a link once; it stands only where there is no other.
    best = once.groupBy(key, "_base").agg(F.array_compact(F.collect_list("l")).alias("ls"))
    default = F.array(F.struct(F.lit(0).alias("_pos"), absolute(F.col("_base"), F.lit(TRUTH_DEFAULT)).alias("url"), F.lit(TRUTH_DEFAULT).alias("name")))
    out = best.select(key, F.explode(F.when(F.size("ls") > 0, F.col("ls")).otherwise(default)).alias("l"))
    return out.select(key, link_priority(F.col("l.url")).alias("priority"), "l.url", "l.name")


def archive_variant(name: Column) -> Column:
    """r2, original, unknown or empty for the name of an archive."""
    low = F.replace(F.replace(F.lower(name), F.lit("_"), F.lit("-")), F.lit(" "), F.lit(""))
    r2 = low.contains("2018r2") | low.rlike("cspb.*2018.*r2") | low.endswith("r2.zip") | low.endswith("r2.tar.gz")
    old = low.contains("2018") & ~low.contains("r2") & (low.contains("cspb") | low.startswith("batch"))
    return F.when(low == "", "empty").when(r2, "r2").when(old, "original").otherwise("unknown")


def to_digits(x: Column, digits: int) -> Column:
    """x to so many digits by its exact value, halves to the even digit, as C, Python and SQL's printf have it; format_string alone takes halves of the shortest decimal up."""
    scale, x = F.lit(10.0**digits), x.cast("double")
    # Two parts short enough to be scaled without an error, and what their sum leaves out.
    high = x.cast("float").cast("double")
    a, b = high * scale, (x - high) * scale
    total = a + b
    left, near = b - (total - a), F.rint(total)
    near = F.when((F.abs(total - near) == 0.5) & (left != 0), total + F.signum(left) / 2).otherwise(near)
    return F.when(F.abs(x) < 2.0**52, near / scale).otherwise(x)


def human_size(n: Column) -> Column:
    """A size over 1024 until it is below, with its unit; null for null."""
    size = lambda i, unit: F.format_string(f"%.1f {unit}", to_digits(n / F.lit(1024.0**i), 1))
    out = size(4, "TB")
    for i, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(n < 1024.0 ** (i + 1), size(i, unit)).otherwise(out)
    return F.when(n.isNotNull(), out)


def checksum_status(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """missing, unregistered, unverified, ok or corrupt for each registered or present file."""
    both = expected.join(actual, key, "full")
    valid = F.col("expected_sha").rlike("^[0-9a-fA-F]{64}$")
    return both.withColumn("status", F.when(F.col("actual_sha").isNull(), "missing").when(F.col("expected_sha").isNull(), "unregistered").when(~valid, "unverified").when(F.lower("expected_sha") == F.col("actual_sha"), "ok").otherwise("corrupt"))


def block_name(mode: Column) -> Column:
    return F.concat(F.lit("mod_"), F.translate(F.lower(mode), ".-", "__"))


def scan_names(found: DataFrame, column: str, includes: list[str] | None, excludes: list[str]) -> DataFrame:
    """Names to scan: all or those included, without the excluded."""
    spark = found.sparkSession
    one = lambda values: vocab.frame(spark, [(v,) for v in values], f"{column} string")
    out = found if includes is None else found.join(F.broadcast(one(includes)), column, "left_semi")
    return out.join(F.broadcast(one(sorted({*excludes, *vocab.EXCLUDES}))), column, "left_anti")
