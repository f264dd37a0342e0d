"""Writers: append logs, merged files, scan caches, signature and pair tables, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import signature_text


def append_log(df: DataFrame, path: str) -> None:
    """One folder a prompt; appended files are also what the streaming source reads."""
    df.withColumn("prompt", F.col("prompt_id")).write.mode("append").partitionBy("prompt").json(path)


def merged(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def scan_cache(scanned: DataFrame, path: str) -> None:
    scanned.withColumn("_code", F.col("code")).drop("code").write.mode("overwrite").json(path)


def signature_rows(scanned: DataFrame) -> DataFrame:
    """The signature table's rows: joined set, JSON signature, two-digit severity, 1 or 0."""
    keys = [c for c in ("prompt_id", "model_display", "temperature", "event_id", "sample_index") if c in scanned.columns]
    return scanned.select(*keys, F.array_join("cwe_set", ";").alias("cwe_set"), F.to_json("pattern_signature").alias("signature"), F.format_string("%.2f", "severity_total").alias("severity"), F.col("is_vulnerable").cast("int").alias("vulnerable"))


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def curated_solutions(picks: DataFrame, problems: DataFrame, cap: int) -> DataFrame:
    """At most cap solutions of each picked problem, one row each with its place."""
    j = picks.join(problems, "problem_id").withColumn("s", F.slice("solutions", 1, cap))
    return j.select(*picks.columns, F.posexplode("s").alias("place", "code"))


def without_models(df: DataFrame, models: list[str], path: str | None = None) -> DataFrame:
    """Rows of the other models; written by prompt where a path is given."""
    kept = df.filter(~F.col("model_display").isin(models))
    if path:
        append_log(kept, path)
    return kept


def report(sections: dict[str, DataFrame], limit: int = 1000) -> tuple[str, str]:
    """JSON and Markdown of small result tables: at most limit rows each. Sections with more say so in both ("cut" lists them)."""
    data, lines, cut = {}, [], []
    for title, df in sections.items():
        rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
        if len(rows) > limit:
            cut.append(title)
            rows = rows[:limit]
        data[title] = rows
        lines += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in df.columns) + " |" for r in rows]
        lines += [f"The first {limit} rows; the table has more." if title in cut else "", ""]
    if cut:
        data["cut"] = cut
    return json.dumps(data, default=str, sort_keys=True), "\n".join(lines)


def signature_key(scanned: DataFrame) -> DataFrame:
    return scanned.withColumn("signature", signature_text(F.col("pattern_signature")))
