"""Rule files, reports, result files and manifests."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Rule = tuple[tuple[str, ...], str]


def parse_rules(lines: Iterable[str]) -> list[Rule]:
    """Lines like ``a,b->c``: blank lines and comments are skipped, dashes in names are
    underscores, a line without an arrow is an error."""
    out = []
    for number, line in enumerate(lines, 1):
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        left, arrow, right = text.partition("->")
        if not arrow:
            raise ValueError(f"line {number} has no arrow: {text}")
        out.append((tuple(sorted(x.strip().replace("-", "_") for x in left.split(","))), right.strip().replace("-", "_")))
    return out


def read_rules(path: str) -> list[Rule]:
    return parse_rules(Path(path).read_text(encoding="utf-8").splitlines())


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    return spark.createDataFrame([(list(lhs), rhs) for lhs, rhs in rules], "lhs array<string>, rhs string")


def evaluate(found: DataFrame, truth: DataFrame) -> DataFrame:
    """precision, recall and f1 of exact matches of left set and right side, rounded to
    four places."""
    from pyspark.sql import functions as F

    a, b = (x.select(F.array_sort("lhs").alias("lhs"), "rhs").distinct() for x in (found, truth))
    hits = a.intersect(b).agg(F.count(F.lit(1)).alias("hits"))
    counts = hits.crossJoin(a.agg(F.count(F.lit(1)).alias("found"))).crossJoin(b.agg(F.count(F.lit(1)).alias("true")))
    p = F.coalesce(F.col("hits") / F.nullif("found", F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("hits") / F.nullif("true", F.lit(0)), F.lit(0.0))
    return counts.select(F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)), 4).alias("f1"))


def evaluate_rules(found: Iterable[Rule], truth: Iterable[Rule]) -> tuple[float, float, float]:
    a, b = ({(tuple(sorted(lhs)), rhs) for lhs, rhs in x} for x in (found, truth))
    hits = len(a & b)
    p, r = hits / len(a) if a else 0.0, hits / len(b) if b else 0.0
    return round(p, 4), round(r, 4), round(2 * p * r / (p + r), 4) if hits else 0.0


def _replace(path: Path, text: str, attempts: int = 5) -> None:
    """Write whole or not at all; try again where another process holds the file."""
    path.parent.mkdir(parents=True, exist_ok=True)
    own = path.with_name(f".{path.name}.{os.getpid()}")
    own.write_text(text, encoding="utf-8")
    for left in reversed(range(attempts)):
        try:
            os.replace(own, path)
            return
        except PermissionError:
            if not left:
                raise
            time.sleep(0.2)


def write_report(path: str, rules: Iterable[Rule], scores: tuple[float, float, float], milliseconds: int) -> None:
    """Sorted rules, then precision, recall, F1 and the time."""
    lines = [f"{','.join(lhs)}->{rhs}" for lhs, rhs in sorted((tuple(sorted(lhs)), rhs) for lhs, rhs in rules)]
    lines += [f"Precision: {scores[0]:.4f}", f"Recall: {scores[1]:.4f}", f"F1: {scores[2]:.4f}", f"Runtime: {milliseconds} ms"]
    _replace(Path(path), "\n".join(lines) + "\n")


def write_results(folder: str, result, scores: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> None:
    """results.jsonl with a candidate a line, summary.json, discovered.txt."""
    top = Path(folder)
    _replace(top / "results.jsonl", "".join(json.dumps(c.record(), default=str) + "\n" for c in result.candidates))
    summary = {
        "settings": result.settings.to_dict(), "columns": result.columns, "candidates_scored": result.counted, "candidates_screened": len(result.screened), "candidates_kept": len(result.candidates),
        "dependencies": [{"lhs": list(lhs), "rhs": rhs} for lhs, rhs in result.dependencies], "precision": scores[0], "recall": scores[1], "f1": scores[2], "runtime_ms": int(1000 * result.seconds),
    }
    _replace(top / "summary.json", json.dumps(summary, indent=2, default=str))
    write_report(str(top / "discovered.txt"), result.dependencies, scores, summary["runtime_ms"])


def fingerprint(df: DataFrame, options: dict) -> str:
    """A hash of schema, options and input files; the same as long as none changes."""
    files = []
    for name in sorted(df.inputFiles()):
        local = name.removeprefix("file://")
        stat = os.stat(local) if os.path.exists(local) else None
        files.append([name, stat.st_size, stat.st_mtime_ns] if stat else [name])
    return hashlib.sha256(json.dumps([df.schema.json(), options, files], sort_keys=True, default=str).encode()).hexdigest()


def _read_text(spark: SparkSession, path: str) -> str | None:
    """A file of any store that Spark reads, None if there is none."""
    jvm = spark._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    files = file.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(file):
        return None
    stream = files.open(file)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """The same for writing: to a name of its own first, then renamed."""
    fs = spark._jvm.org.apache.hadoop.fs
    file, own = fs.Path(path), fs.Path(f"{path}.{os.getpid()}.new")
    files = file.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(own, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    files.delete(file, False)
    files.rename(own, file)


def prepared(df: DataFrame, folder: str, options: dict, build, *, force: bool = False) -> DataFrame:
    """What ``build(df)`` gives, kept as Parquet by split with its schema and a summary
    (rows of each split, columns); built again only if the fingerprint changed, or by
    ``force``."""
    spark, mark, now = df.sparkSession, f"{folder}/manifest.json", fingerprint(df, options)
    told = _read_text(spark, mark)
    if told and not force and json.loads(told)["fingerprint"] == now:
        return spark.read.parquet(f"{folder}/data")
    built = build(df)
    writer = built.write.mode("overwrite")
    split = "split" in built.columns
    (writer.partitionBy("split") if split else writer).parquet(f"{folder}/data")
    done = spark.read.parquet(f"{folder}/data")
    rows = {r[0]: r[1] for r in done.groupBy("split").count().collect()} if split else {"all": done.count()}
    _write_text(spark, f"{folder}/schema.json", built.schema.json())
    _write_text(spark, f"{folder}/summary.json", json.dumps({"rows": rows, "rows_total": sum(rows.values()), "columns": built.columns, "options": options, "fingerprint": now}, default=str))
    _write_text(spark, mark, json.dumps({"fingerprint": now, "options": options}, default=str))
    return done


def read_schema(spark: SparkSession, folder: str) -> StructType:
    """The schema that ``prepared`` saved."""
    text = _read_text(spark, f"{folder}/schema.json")
    if text is None:
        raise FileNotFoundError(f"{folder}/schema.json")
    return StructType.fromJson(json.loads(text))
