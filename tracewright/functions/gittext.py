"""git log and diff texts as DataFrames: the line's state is carried by windows over the line number.

Both inputs are one file each, so a window over all its lines is as large as that file; several files go side by side
through `source`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .naming import git_path


def lines(spark: SparkSession, text: str, source: str = "") -> DataFrame:
    """source, no (from 0), line of a text at hand."""
    rows = [(source, i, line) for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "source string, no int, line string")


def _so_far(value: Column) -> Column:
    own = Window.partitionBy("source").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(value, ignorenulls=True).over(own)


def parse_log(log: DataFrame) -> DataFrame:
    """Lines of `git log --format=%H%x09%ad%x09%s --name-only`: sha, date, subject, file_path, a row for each file."""
    parts = F.split("line", "\t", 3)
    head = F.col("line").rlike("^[0-9a-f]{7,64}\t")
    marked = log.withColumn("commit", F.when(head, F.struct(parts[0].alias("sha"), parts[1].alias("date"), parts[2].alias("subject")))).withColumn("commit", _so_far(F.col("commit")))
    return marked.where(~head & (F.trim("line") != "") & F.col("commit").isNotNull()).select("commit.*", git_path(F.trim("line")).alias("file_path"))


def log_graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commit nodes and modified_by edges (file to commit)."""
    commit = F.concat(F.lit("commit:"), F.col("sha"))
    nodes = parsed.select(commit.alias("id"), F.lit("commit").alias("kind"), F.substring("sha", 1, 12).alias("name"), F.create_map(F.lit("date"), F.col("date"), F.lit("subject"), F.col("subject")).alias("properties")).dropDuplicates(["id"])
    edges = parsed.select(F.concat(F.lit("file:"), F.col("file_path")).alias("source_id"), commit.alias("target_id"), F.lit("modified_by").alias("kind"), F.lit("git").alias("tool_source"), F.lit(1.0).alias("confidence")).distinct()
    return nodes, edges


def parse_diff(diff: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lines of a unified diff: (file_path of new files), (file_path, line of added lines); deleted files are left out.

    compat: text behind a hunk's second @@ counts as a context line, which moves the hunk's added lines down by one."""
    hunk = F.regexp_extract("line", r"^@@ -\S+ \+(\d+)(?:,\d+)? @@(.*)$", 1)
    tail = F.trim(F.regexp_extract("line", r"^@@ -\S+ \+(\d+)(?:,\d+)? @@(.*)$", 2)) != ""
    is_hunk, is_new = hunk != "", F.col("line").startswith("+++ ")
    file_head = F.col("line").startswith("diff --git ")
    target = F.regexp_replace(F.regexp_replace("line", r"^\+\+\+ ", ""), "^b/", "")
    first = hunk.cast("int") + (F.when(tail, 1).otherwise(0) if compat else 0)
    state = (
        diff.withColumn("file_no", F.sum(F.when(file_head, 1).otherwise(0)).over(Window.partitionBy("source").orderBy("no")))
        .withColumn("file_path", F.last(F.when(is_new, target), ignorenulls=True).over(Window.partitionBy("source", "file_no").orderBy("no")))
        .withColumn("fresh", F.max(F.col("line").startswith("new file mode") | (F.col("line") == "--- /dev/null")).over(Window.partitionBy("source", "file_no")))
        .withColumn("hunk_no", F.sum(F.when(is_hunk, 1).otherwise(0)).over(Window.partitionBy("source", "file_no").orderBy("no")))
        .withColumn("first", F.last(F.when(is_hunk, first), ignorenulls=True).over(Window.partitionBy("source", "file_no").orderBy("no")))
    )
    body = state.where((F.col("hunk_no") > 0) & ~is_hunk & (F.col("file_path") != "/dev/null"))
    shown = F.col("line").startswith("+") | F.col("line").startswith(" ")
    before = Window.partitionBy("source", "file_no", "hunk_no").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    placed = body.withColumn("at", F.col("first") + F.coalesce(F.sum(F.when(shown, 1).otherwise(0)).over(before), F.lit(0)))
    added = placed.where(F.col("line").startswith("+")).select("file_path", F.col("at").cast("int").alias("line")).distinct()
    fresh = state.where(is_new & F.col("fresh") & (F.col("file_path") != "/dev/null")).select("file_path").distinct()
    return fresh, added


def changed_go_files(tracked: DataFrame, untracked: DataFrame) -> DataFrame:
    """Changed and untracked paths (column path) that matter to a build, in order."""
    wanted = F.col("path").endswith(".go") | F.col("path").rlike(r"(^|/)go\.(mod|work)$")
    return tracked.select("path").unionByName(untracked.select("path")).where(wanted).distinct().orderBy("path")
