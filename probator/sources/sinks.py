"""Where results go: Parquet for tables, JSON for structures, JSON lines for histories, Markdown and HTML for people.

Tables are written by executors. Structures are small and the driver writes them, through the file system that the path names, so that
a report may lie in an object store.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import is_numeric, markdown_cell, named, numeric
from .io import encoded, to_text


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def write_text(spark: SparkSession, path: str, content: str) -> None:
    at, files = _file_system(spark, path)
    out = files.create(at, True)
    try:
        out.write(bytearray(content, "utf-8"))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text, or None if there is no such file."""
    at, files = _file_system(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, content: str) -> bool:
    """Writes the file unless there is one; whether it did. Of several writers at once, one succeeds."""
    at, files = _file_system(spark, path)
    if files.exists(at):
        return False
    try:
        out = files.create(at, False)
    except Exception as error:  # the store's own exception: somebody was first
        if files.exists(at):
            return False
        raise error
    try:
        out.write(bytearray(content, "utf-8"))
    finally:
        out.close()
    return True


def list_files(spark: SparkSession, folder: str) -> list[str]:
    at, files = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, to_text(value, indent=2))


def read_json(spark: SparkSession, path: str):
    content = read_text(spark, path)
    return None if content is None else json.loads(content)


def append_event(spark: SparkSession, folder: str, number: int, event: dict) -> bool:
    """Adds an event to a history that is a folder with a file of one JSON line for each event, by number. False if that number is taken."""
    return create_once(spark, f"{folder}/{number:09d}.jsonl", to_text(event) + "\n")


def read_events(spark: SparkSession, folder: str) -> list[dict]:
    """The events of a history, in the order of their numbers."""
    return [json.loads(read_text(spark, f"{folder}/{name}")) for name in list_files(spark, folder) if name.endswith(".jsonl")]


def write_table(df: DataFrame, path: str, *, flat: bool = False) -> None:
    """Parquet. ``flat`` turns nested columns into JSON text."""
    (encoded(df) if flat else df).write.mode("overwrite").parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions of all runs, a folder for each run id."""
    df.write.mode("overwrite").partitionBy("run_id").parquet(path)


def read_predictions(spark: SparkSession, path: str, runs: list[str] | None = None) -> DataFrame:
    """Predictions again; with ``runs`` only their folders are listed and read."""
    df = spark.read.parquet(path)
    return df if runs is None else df.where(F.col("run_id").isin(runs))


# --- what a figure would show ------------------------------------------------------------------------------------


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of the finite values of a column between its least and most, or (bin, value, n) of its 30 commonest values if it is not numeric. Two passes, one row a bin."""
    if not is_numeric(df, column):
        n = df.where(named(column).isNotNull()).groupBy(named(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(bins)
        return n.select(F.row_number().over(_order("n", "value")).alias("bin"), "value", "n")
    x = df.select(numeric(df, column).alias("x")).where("x is not null")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = x.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # one row
    edges = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", width.alias("w"))
    return edges.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def _order(count: str, value: str):
    return Window.orderBy(F.desc(count), value)  # over a few dozen rows


def repetition(df: DataFrame, column: str) -> DataFrame:
    """(rows, n_ids): how many ids have so many rows."""
    sizes = df.where(named(column).isNotNull()).groupBy(named(column)).agg(F.count("*").alias("rows"))
    return sizes.groupBy("rows").agg(F.count("*").alias("n_ids"))


# --- reports -----------------------------------------------------------------------------------------------------


def markdown_table(header: list[str], rows: list[list]) -> str:
    line = lambda cells: "| " + " | ".join(map(markdown_cell, cells)) + " |"
    return "\n".join([line(header), line(["---"] * len(header)), *map(line, rows)])


def as_markdown(title: str, sections: list[tuple[str, list[str], list[list]]]) -> str:
    """A report: a title and sections of (heading, header, rows)."""
    return "\n\n".join([f"# {markdown_cell(title)}", *(f"## {markdown_cell(h)}\n\n{markdown_table(c, r) if r else 'None.'}" for h, c, r in sections)]) + "\n"


def as_html(title: str, sections: list[tuple[str, list[str], list[list]]]) -> str:
    cell = lambda tag, x: f"<{tag}>{html.escape(str(x))}</{tag}>"
    row = lambda tag, xs: "<tr>" + "".join(cell(tag, x) for x in xs) + "</tr>"
    body = "".join(f"<section>{cell('h2', h)}<table>{row('th', c)}{''.join(row('td', r) for r in rs)}</table></section>" for h, c, rs in sections)
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{html.escape(title)}</title><body>{cell("h1", title)}{body}</body></html>\n'


def write_report(spark: SparkSession, folder: str, name: str, title: str, sections: list[tuple[str, list[str], list[list]]], structure: dict) -> None:
    """The report as JSON, Markdown and HTML."""
    write_json(spark, f"{folder}/{name}.json", structure)
    write_text(spark, f"{folder}/{name}.md", as_markdown(title, sections))
    write_text(spark, f"{folder}/{name}.html", as_html(title, sections))
