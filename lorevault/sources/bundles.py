"""File sources and sinks: skill bundles, rules, run ledgers, day files and Markdown backups."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lorevault.operators.running import running

SCALAR = re.compile(r"^([A-Za-z_][\w-]*):\s*(.*)$")


def frontmatter(text: str | None) -> tuple[dict[str, str], str, str | None]:
    """Header fields, body and what is wrong: scalars, flow lists ([a, b] joined by commas) and one nested block (outer.inner)."""
    if not text or not text.startswith("---"):
        return {}, text or "", "no header"
    head, sep, body = text[3:].lstrip("\r\n").partition("\n---")
    if not sep:
        return {}, text, "header isn't closed"
    fields: dict[str, str] = {}
    outer = ""
    for line in head.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = SCALAR.match(line.strip())
        if not m:
            return fields, body.lstrip("\n"), f"line isn't read: {line.strip()[:60]}"
        key, value = m[1], m[2].strip()
        nested = line[0] in " \t" and outer
        if value.startswith("[") and value.endswith("]"):
            value = ",".join(x.strip().strip("\"'") for x in value[1:-1].split(",") if x.strip())
        value = value.strip("\"'")
        if nested:
            fields[f"{outer}.{key}"] = value
        elif value:
            fields[key], outer = value, ""
        else:
            outer = key
    return fields, body.lstrip("\n"), None


def skill_bundles(spark: SparkSession, root: str, file: str = "SKILL.md") -> DataFrame:
    """One row per bundle folder directly under ``root``: bundle, fields (map), body, problem.

    Folders that begin with a dot are left out; broken bundles stay, with their problem.
    """
    files = spark.read.text(f"{root}/*/{file}", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("bundle"), "value")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [frontmatter(v) for v in pdf["value"]]
            yield pd.DataFrame({"bundle": pdf["bundle"], "fields": [f for f, _, _ in found], "body": [b for _, b, _ in found], "problem": [p for _, _, p in found]})

    return files.where(~F.col("bundle").startswith(".")).mapInPandas(parse, "bundle string, fields map<string,string>, body string, problem string")


def rules(spark: SparkSession, root: str, max_rules: int, max_chars: int) -> DataFrame:
    """The first ``max_rules`` rule files by name, while they fit: name, body. Empty ones are skipped; of the first that doesn't fit a prefix with a pointer to its file."""
    files = spark.read.text(f"{root}/*.md", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.trim("value").alias("body")).where("body <> ''")
    # The limit bounds what the window puts together.
    kept = files.orderBy("name").limit(max_rules)
    kept = kept.withColumn("used", F.sum(F.char_length("body")).over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, 0)))
    left = max_chars - (F.col("used") - F.char_length("body"))
    prefix = F.concat(F.rtrim(F.substring("body", F.lit(1), left)), F.lit("\n… see "), F.col("name"))
    return kept.where(left > 0).select("name", F.when(F.col("used") <= max_chars, F.col("body")).otherwise(prefix).alias("body"))


def project_memory(spark: SparkSession, root: str, max_chars: int) -> DataFrame:
    """Lines of the day files (YYYY-MM-DD.md), the newest day first, as far as ``max_chars`` go: day, nth, line.

    Headings, comments and blank lines are left out; a line is whole or not there.
    """
    files = spark.read.text(f"{root}/*.md", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})\.md$", 1).alias("day"), F.posexplode(F.split("value", "\n")).alias("nth", "line")).where("day <> ''")
    lines = files.withColumn("line", F.rtrim("line")).where(~F.col("line").rlike(r"^\s*(#|<!--|$)"))
    used = running(lines.withColumn("root", F.lit(1)), "used", F.char_length("line") + 1, "sum", ["root"], -F.unix_date(F.to_date("day")), [F.col("nth")])
    return used.where(F.col("used") <= max_chars).select("day", "nth", "line")


def emitted(fields: dict[str, str | list[str]]) -> str:
    """Fields as frontmatter that ``frontmatter`` reads: scalars, quoted where needed, and flow lists."""

    def scalar(v: str) -> str:
        return '"' + v.replace('"', "'") + '"' if v == "" or re.search(r"[:#\[\]{},\"']|^\s|\s$", v) else v

    lines = [f"{k}: [{', '.join(map(scalar, v))}]" if isinstance(v, list) else f"{k}: {scalar(v)}" for k, v in fields.items()]
    return "---\n" + "\n".join(lines) + "\n---\n"


NAME = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


def create_bundle(root: str, name: str, fields: dict[str, str | list[str]], body: str, most: int = 24) -> str:
    """Write a new skill bundle, never over another one, and no more than ``most`` of them; the path of its file."""
    if not NAME.fullmatch(name):
        raise ValueError(f"{name} is no name of a bundle")
    home = Path(root)
    if (home / name).exists():
        raise FileExistsError(name)
    if home.is_dir() and sum(p.is_dir() and not p.name.startswith(".") for p in home.iterdir()) >= most:
        raise ValueError(f"there are {most} bundles already")
    (home / name).mkdir(parents=True)
    path = home / name / "SKILL.md"
    path.write_text(emitted({"name": name, **fields}) + body.strip() + "\n", encoding="utf-8")
    return str(path)


def retire_bundle(root: str, name: str) -> str:
    """Move a bundle among the retired ones, under a free name; its new path."""
    to = Path(root) / ".retired" / name
    n = 1
    while to.exists():
        n += 1
        to = to.with_name(f"{name}-{n}")
    to.parent.mkdir(exist_ok=True)
    (Path(root) / name).rename(to)
    return str(to)


def create_rule(root: str, name: str, title: str, body: str) -> str:
    """Write a new rule file; a file of that name is a conflict."""
    if not NAME.fullmatch(name):
        raise ValueError(f"{name} is no name of a rule")
    path = Path(root) / f"{name}.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("x", encoding="utf-8") as f:
        f.write(f"# {title.strip()}\n\n{body.strip()}\n")
    return str(path)


RUN = StructType([StructField(c, StringType()) for c in ("skill", "outcome", "started_at", "session")])


def run_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a JSON lines ledger; lines that can't be read are dropped."""
    return spark.read.schema(RUN).option("mode", "DROPMALFORMED").json(path).where("skill is not null")


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def last_rates(runs: DataFrame, window: int = 10) -> DataFrame:
    """skill, total runs, runs in the window and their rate of success."""
    w = Window.partitionBy("skill").orderBy(F.desc("started_at"), F.desc("session"))
    r = runs.withColumn("nth", F.row_number().over(w))
    ok = F.col("outcome").isin("success", "ok", "completed").cast("int")
    last = F.col("nth") <= window
    return r.groupBy("skill").agg(F.count(F.lit(1)).alias("total"), F.count_if(last).alias("n_last"), F.round(F.avg(F.when(last, ok)), 3).alias("rate"))


def write_days(days: DataFrame, path: str) -> None:
    """Day bodies (day, body) as one text file folder per day; days written before and not given stay."""
    spark = days.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        days.select("day", "body").write.mode("overwrite").partitionBy("day").text(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def export_markdown(episodes: DataFrame, path: str, per_project: int = 2000) -> None:
    """Episodes (project_id, memory_id, created_at, summary) as Markdown lines under a heading per project, newest first."""
    w = Window.partitionBy("project_id").orderBy(F.desc("created_at"), "memory_id")
    e = episodes.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_project)
    text = F.regexp_replace(F.coalesce("summary", F.lit("")), r"\s+", " ")
    line = F.concat(F.lit("- "), F.col("memory_id"), F.lit(" | "), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" | "), text)
    heads = e.select("project_id").distinct().select("project_id", F.lit(0).alias("nth"), F.concat(F.lit("## "), F.coalesce("project_id", F.lit("-"))).alias("line"))
    lines = heads.unionByName(e.select("project_id", "nth", line.alias("line")))
    lines.repartitionByRange("project_id").sortWithinPartitions("project_id", "nth").select("line").write.mode("overwrite").text(path)


def import_markdown(spark: SparkSession, path: str) -> DataFrame:
    """What ``export_markdown`` wrote: project_id, memory_id, created_at, summary; other lines are skipped.

    The heading of a line is the last one before it in its file.
    """
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for pdf in batches:
            for text in pdf["value"]:
                project = None
                for line in text.splitlines():
                    if line.startswith("## "):
                        project = line[3:].strip()
                    elif line.startswith("- ") and line.count(" | ") >= 2:
                        memory_id, at, summary = line[2:].split(" | ", 2)
                        rows.append((None if project == "-" else project, memory_id, at, summary))
        if rows:
            yield pd.DataFrame(rows, columns=["project_id", "memory_id", "created_at", "summary"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, "project_id string, memory_id string, created_at string, summary string").withColumn("created_at", F.try_to_timestamp("created_at"))


def restored(spark: SparkSession, path: str, known: DataFrame, most_chars: int = 4000) -> DataFrame:
    """What a restore of a Markdown backup does with each item: project_id, memory_id, created_at, summary, outcome.

    outcome: ``failed`` (no text or no time), ``known`` (its memory_id is in ``known``),
    ``repeated`` (an item of the same id came before), ``truncated`` (the text is cut at ``most_chars``) or ``imported``.
    A dry run counts the outcomes; a restore appends the rows imported and truncated.
    """
    items = import_markdown(spark, path)
    w = Window.partitionBy("memory_id").orderBy(F.desc("created_at"), "summary")
    items = items.withColumn("nth", F.row_number().over(w)).join(known.select("memory_id").distinct().withColumn("there", F.lit(True)), "memory_id", "left")
    outcome = F.when(F.col("created_at").isNull() | (F.trim("summary") == ""), "failed").when(F.col("there"), "known").when(F.col("nth") > 1, "repeated").when(F.char_length("summary") > most_chars, "truncated").otherwise("imported")
    return items.select("project_id", "memory_id", "created_at", F.substring("summary", 1, most_chars).alias("summary"), outcome.alias("outcome"))
