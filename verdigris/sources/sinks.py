"""Writers: Spark's committer makes each of them atomic; rows never pass the driver except for the small run report."""

import json
import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def safe_relative(path: str) -> str:
    """A path that stays inside its root."""
    clean = posixpath.normpath(path)
    if posixpath.isabs(path) or clean == ".." or clean.startswith("../"):
        raise ValueError(f"path leaves its root: {path}")
    return clean


def append(rows: DataFrame, root: str, name: str) -> None:
    """Add rows to a table of the run store; readers take the latest of a key."""
    rows.write.mode("append").parquet(f"{root}/{safe_relative(name)}")


def ndjson(rows: DataFrame, path: str) -> None:
    """One compact JSON object in each line."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(header=True, escape='"').csv(path)


def run_report(metrics: DataFrame, cases: DataFrame, run: dict) -> tuple[dict, str]:
    """The report of a run as a JSON object and as Markdown: a row for each metric, so its size follows the number of metrics."""
    counts = cases.first().asDict()
    rows = {r["metric_id"]: {k: v for k, v in r.asDict().items() if k != "metric_id"} for r in metrics.orderBy("metric_id").collect()}
    report = {"schema_version": "verdigris.report.v1", **run, "cases": counts, "metrics": rows}
    lines = [f"# Run {run.get('run_id', '')}", "", f"Cases: {counts.get('done')} done of {counts.get('total')}, {counts.get('system_failures')} system failures", "", "| metric | scored | mean |", "|---|---|---|"]
    for name, m in rows.items():
        lines.append(f"| {name} | {m['scored']} | {'-' if m['mean'] is None else format(m['mean'], '.4f')} |")
    return report, "\n".join(lines) + "\n"


def write_text(spark, path: str, content: str) -> None:
    """A small text file through the Hadoop file system: written beside its place and renamed."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = to.getFileSystem(conf)
    stream = fs.create(part, True)
    stream.write(bytearray(content.encode()))
    stream.close()
    fs.delete(to, False)
    if not fs.rename(part, to):
        raise OSError(f"cannot write {path}")


def write_report(spark, folder: str, report: dict, markdown: str) -> None:
    write_text(spark, f"{folder}/report.json", json.dumps(report, ensure_ascii=False, indent=2, default=str))
    write_text(spark, f"{folder}/report.md", markdown)
