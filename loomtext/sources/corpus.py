"""Corpus tables: files from a documents table or a directory tree, lines, and commit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import paths as P
from loomtext.operators.prefix import running_sum
from loomtext.runtime import table

MAX_FILE_BYTES = 10 * 1024 * 1024


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, path, language, content: the documents table as a tree source/lang/doc_id.txt."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))


def scan_directory(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), ignore_lines: list[str] = (), max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """path (under root), length, modified, content of the admitted files of a tree.

    Names and sizes are filtered before any content is read; then files that look binary go.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = F.regexp_replace(F.lit(root.rstrip("/") + "/"), r"^[a-z]+:/*", "/")
    rel = F.replace(F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/"), prefix, F.lit(""))
    rows = raw.withColumn("path", rel).where(admitted(F.col("path"), F.col("length"), include, exclude, ignore_lines, max_bytes))
    return rows.where(~P.is_binary_content(F.col("content"))).select("path", "length", F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("content"))


def admitted(path, length, include=(), exclude=(), ignore_lines=(), max_bytes: int = MAX_FILE_BYTES):
    ok = (length <= max_bytes) & ~P.is_binary_name(path) & ~P.is_hidden(path)
    if include:
        some = F.lit(False)
        for g in include:
            some = some | P.matches_glob(path, g)
        ok = ok & some
    for g in exclude:
        ok = ok & ~P.matches_glob(path, g)
    return ok & ~P.ignored(path, list(ignore_lines)) if ignore_lines else ok


def lines(corpus: DataFrame) -> DataFrame:
    """file_id, path, line (from 1), text."""
    cut = corpus.select("file_id", "path", F.split("content", "\n").alias("all"))
    each = cut.select("file_id", "path", F.posexplode("all").alias("pos", "text"))
    return each.select("file_id", "path", (F.col("pos") + 1).cast("long").alias("line"), "text")


def with_offsets(of_lines: DataFrame) -> DataFrame:
    """Adds the byte offset of each line's start."""
    w = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return of_lines.withColumn("offset", F.coalesce(F.sum(F.octet_length("text") + 1).over(w), F.lit(0)).cast("long"))


def hashes(corpus: DataFrame) -> DataFrame:
    """file_id, n_bytes, sha256, and a fast hash for equality only."""
    return corpus.select("file_id", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), F.xxhash64("content").alias("fast"))


def commit_log(log: DataFrame) -> DataFrame:
    """Rows of `git log --numstat` (no, value in order) -> hash, author, email, ts, message, changes.

    A header is `hash|name|email|epoch|subject`; numstat rows follow it: added, deleted, path by tabs.
    """
    header = F.regexp_like("value", F.lit(r"^[0-9a-f]{7,40}\|[^|]*\|[^|]*\|\d+\|"))
    part = running_sum(log.withColumns({"is_header": header, "one": header.cast("int")}), ["no"], "one", "commit_no")
    bits = F.split("value", r"\|", 5)
    heads = part.where("is_header").select("commit_no", bits[0].alias("hash"), bits[1].alias("author"), bits[2].alias("email"), F.timestamp_seconds(bits[3].cast("long")).alias("ts"), bits[4].alias("message"))
    cols = F.split("value", "\t")
    rows = part.where(~F.col("is_header") & F.regexp_like("value", F.lit(r"^(\d+|-)\t(\d+|-)\t."))).select("commit_no", "no", cols[0].try_cast("int").alias("added"), cols[1].try_cast("int").alias("deleted"), cols[2].alias("raw"))
    rows = rows.select("commit_no", F.struct("no", renamed("raw")["new"].alias("path"), renamed("raw")["old"].alias("old_path"), F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("deleted", F.lit(0)).alias("deleted")).alias("c"))
    changes = rows.groupBy("commit_no").agg(F.array_sort(F.collect_list("c")).alias("changes"))
    return heads.join(changes, "commit_no", "left").drop("commit_no")


def renamed(raw):
    """`a/{x => y}/b` or `x => y` -> struct(new, old); old is null for a plain path."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    pattern = r"^(.*?)\{(.*?) => (.*?)\}(.*)$"
    part = lambda i: F.regexp_extract(raw, pattern, i)
    join = lambda x: F.regexp_replace(F.concat(part(1), x, part(4)), "//", "/")
    braced, plain = raw.contains("{") & raw.contains(" => "), raw.contains(" => ")
    new = F.when(braced, join(part(3))).when(plain, F.split(raw, " => ")[1]).otherwise(raw)
    old = F.when(braced, join(part(2))).when(plain, F.split(raw, " => ")[0])
    return F.struct(new.alias("new"), old.alias("old"))


def name_status(rows: DataFrame) -> DataFrame:
    """`git diff --name-status` rows (value) -> status, path, old_path."""
    p = F.split("value", "\t")
    kind = F.substring(p[0], 1, 1)
    names = F.create_map(*[F.lit(x) for pair in (("A", "added"), ("M", "modified"), ("D", "deleted"), ("R", "renamed"), ("C", "copied")) for x in pair])
    two = kind.isin("R", "C")
    return rows.where(F.col("value") != "").select(F.coalesce(F.try_element_at(names, kind), F.lit("unknown")).alias("status"), F.when(two, F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(1))).alias("path"), F.when(two, F.get(p, F.lit(1))).alias("old_path"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, status between two snapshots (path, content)."""
    a, b = before.select("path", F.sha2("content", 256).alias("was")), after.select("path", F.sha2("content", 256).alias("now"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").otherwise("modified")
    return a.join(b, "path", "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select("path", status.alias("status"))


def diff_size(n_files):
    """small under 10 files, medium up to 50, else large; of a number or a column."""
    if isinstance(n_files, int):
        return "small" if n_files < 10 else "medium" if n_files <= 50 else "large"
    return F.when(n_files < 10, "small").when(n_files <= 50, "medium").otherwise("large")


def diff_stats(changes: DataFrame, *by: str) -> DataFrame:
    """n_files, n_added, n_deleted, size of the changed files (path, added, deleted); one row for each `by`."""
    rows = changes.groupBy(*by).agg(F.count_distinct("path").alias("n_files"), F.sum("added").cast("long").alias("n_added"), F.sum("deleted").cast("long").alias("n_deleted"))
    return rows.withColumn("size", diff_size(F.col("n_files")))
