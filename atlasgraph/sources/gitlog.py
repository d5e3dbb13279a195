"""Git history as tables: a data source of commits and file changes, changed lines, blobs."""

from __future__ import annotations

import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHANGES = "commit string, author string, authored_at string, message string, files_changed int, insertions int, deletions int, a_path string, b_path string, a_blob string, b_blob string, patch string"
_START, _FIELD = "\x01commit\x02", "\x02"
COMMITS_PER_TASK = 200


def _git(path: str, *args: str, stdin: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-c", "core.quotepath=off", "-c", "safe.directory=*", "-C", path, *args], input=stdin, capture_output=True)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} in {path}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout


def _has_commits(path: str) -> bool:
    """Whether HEAD is a commit; false for a repository without any, an error where there is no repository."""
    _git(path, "rev-parse", "--git-dir")
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", path, "rev-parse", "--verify", "--quiet", "HEAD"], capture_output=True)
    return done.returncode == 0


class _Range(InputPartition):
    def __init__(self, commits: list[str]):
        self.commits = commits


class GitReader(DataSourceReader):
    """Each task shows its own range of commits; every commit is compared with its first parent, a root with nothing."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        ids = _git(self.path, "rev-list", "HEAD").decode().split() if _has_commits(self.path) else []
        return [_Range(ids[i : i + COMMITS_PER_TASK]) for i in range(0, len(ids), COMMITS_PER_TASK)] or [_Range([])]

    def read(self, partition):
        if not partition.commits:
            return
        form = f"--format={_START}%H{_FIELD}%an{_FIELD}%aI{_FIELD}%B{_FIELD}"
        text = _git(self.path, "show", "--stdin", form, "--diff-merges=first-parent", "--root", "-M", "--full-index", "-p", "--no-color", "--no-ext-diff", stdin="\n".join(partition.commits).encode()).decode("utf-8", "replace")
        for part in text.split(_START)[1:]:
            sha, author, when, message, diff = part.split(_FIELD, 4)
            files = [_change(x) for x in ("\n" + diff).split("\ndiff --git ")[1:]]
            plus = sum(p.count("\n+") for *_, p in files)
            minus = sum(p.count("\n-") for *_, p in files)
            head = (sha, author, when, message.strip(), len(files), plus, minus)
            if not files:
                yield (*head, None, None, None, None, None)
            for f in files:
                yield (*head, *f)


def _change(text: str) -> tuple[str | None, str | None, str | None, str | None, str]:
    """(a_path, b_path, a_blob, b_blob, hunks) of one file's diff."""
    head, mark, body = text.partition("\n@@ ")
    a = b = a_blob = b_blob = None
    lines = head.split("\n")
    for line in lines[1:]:
        if line.startswith("--- a/"):
            a = line[6:].rstrip("\t")
        elif line.startswith("+++ b/"):
            b = line[6:].rstrip("\t")
        elif line.startswith("rename from "):
            a = line[12:]
        elif line.startswith("rename to "):
            b = line[10:]
        elif line.startswith("index "):
            a_blob, _, b_blob = line[6:].split(" ")[0].partition("..")
    if a is None and b is None:  # an empty file, a change of mode
        names = lines[0]
        a = b = names[len(names) // 2 + 3 :] if names.startswith("a/") else names
    zero = lambda x: None if x is None or set(x) == {"0"} else x
    return a, b, zero(a_blob), zero(b_blob), ("\n@@ " + body) if mark else ""


class GitDataSource(DataSource):
    """spark.read.format("gitlog").load(path): a row per commit and changed file, a row with null paths for a commit without any."""

    @classmethod
    def name(cls):
        return "gitlog"

    def schema(self):
        return CHANGES

    def reader(self, schema):
        return GitReader(self.options["path"])


def read_git(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(GitDataSource)
    return spark.read.format("gitlog").load(path)


def changed_lines(changes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, line): new-side numbers of added lines, old-side numbers of deleted ones.

    The patch becomes rows; running sums within each hunk give the numbers.
    """
    rows = changes.where("patch <> ''").select(*keys, F.posexplode(F.split("patch", "\n")).alias("pos", "text"))
    start = F.regexp_extract("text", r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", 0) != ""
    w = Window.partitionBy(*keys).orderBy("pos")
    rows = rows.withColumn("head", start).withColumn("hunk", F.sum(F.col("head").cast("int")).over(w)).where("hunk > 0")
    tag = F.substring("text", 1, 1)
    old0, new0 = (F.when(F.col("head"), F.regexp_extract("text", r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", i).cast("int")) for i in (1, 2))
    in_hunk = Window.partitionBy(*keys, "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    body = ~F.col("head") & (F.col("text") != "") & (tag != "\\")
    plain = body & ~tag.isin("+", "-")
    new = F.max(new0).over(in_hunk) + F.sum((body & (tag == "+") | plain).cast("int")).over(in_hunk) - 1
    old = F.max(old0).over(in_hunk) + F.sum((body & (tag == "-") | plain).cast("int")).over(in_hunk) - 1
    numbered = rows.select(*keys, body.alias("body"), tag.alias("tag"), new.alias("n"), old.alias("o"))
    return numbered.where("body and tag in ('+', '-')").select(*keys, F.when(F.col("tag") == "+", "new").otherwise("old").alias("side"), F.when(F.col("tag") == "+", F.col("n")).otherwise(F.col("o")).alias("line"))


def read_blobs(blobs: DataFrame, path: str) -> DataFrame:
    """(blob, source_text) of distinct blob names; null where a blob isn't there or isn't UTF-8. Git is asked once per batch."""

    def run(batches):
        for pdf in batches:
            out, at, texts = _git(path, "cat-file", "--batch", stdin="".join(f"{b}\n" for b in pdf["blob"]).encode()), 0, []
            for _ in pdf["blob"]:
                head, at = out[at : out.index(b"\n", at)].split(b" "), out.index(b"\n", at) + 1
                text = None
                if len(head) == 3:  # name, kind, size; otherwise it is missing
                    data, at = out[at : at + int(head[2])], at + int(head[2]) + 1
                    if head[1] == b"blob":
                        try:
                            text = data.decode("utf-8")
                        except UnicodeDecodeError:
                            pass
                texts.append(text)
            yield pd.DataFrame({"blob": pdf["blob"], "source_text": texts})

    return blobs.where("blob is not null").select("blob").distinct().mapInPandas(run, "blob string, source_text string")
