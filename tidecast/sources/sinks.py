"""Writers: partitioned checkpoints that can be resumed, artifacts with a manifest, rendered tables."""

from __future__ import annotations

import json
from collections.abc import Mapping
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = ("target", "arm", "horizon")


def append_checkpoint(master: DataFrame, path: str, cell: tuple[str, ...] = CELL) -> None:
    master.write.mode("append").partitionBy(*cell).parquet(path)


def load_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


load_checkpoint_frame = load_checkpoint


def pending_cells(cells: DataFrame, path: str, cell: tuple[str, ...] = CELL) -> DataFrame:
    """Cells that the checkpoint does not hold yet."""
    return cells.join(load_checkpoint(cells.sparkSession, path).select(*cell).distinct(), list(cell), "left_anti")


def lean_records(master: DataFrame) -> DataFrame:
    keep = ["target", "horizon", "origin", "origin_pos", "date", "model", "prediction", "actual", "forecast_policy", "variance_prediction"]
    return master.select(*[c for c in keep if c in master.columns])


def write_artifacts(tables: Mapping[str, DataFrame], path: str, formats: tuple[str, ...] = ("parquet",)) -> dict[str, object]:
    """Every table in every format, and ``manifest`` (one JSON line) beside them."""
    spark, files = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        for f in formats:
            to = f"{path}/{name}.{f}"
            w = df.write.mode("overwrite")
            (w.option("header", "true").csv(to) if f == "csv" else getattr(w, f)(to))
            files.append({"name": name, "format": f, "path": to, "columns": df.columns})
    manifest = {"artifacts": files}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").write.mode("overwrite").text(f"{path}/manifest.json")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict[str, object]:
    return json.loads(spark.read.text(f"{path}/manifest.json").first()["value"])


def stars(p: str = "p_value", levels: tuple[tuple[float, str], ...] = ((0.01, "***"), (0.05, "**"), (0.1, "*"))):
    out = F.lit("")
    for level, mark in sorted(levels, reverse=True):
        out = F.when(F.col(p) < level, mark).otherwise(out)
    return out


def _cells(df: DataFrame, digits: int, most: int) -> tuple[list[str], list[list[str]]]:
    rows = df.limit(most).collect()  # a table to be printed
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return df.columns, [[show(v) for v in r] for r in rows]


def markdown_table(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    head, body = _cells(df, digits, most)
    lines = [head, ["---"] * len(head), *body]
    return "\n".join("| " + " | ".join(x.replace("|", "\\|") for x in line) + " |" for line in lines)


def latex_table(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    head, body = _cells(df, digits, most)
    safe = lambda x: "".join({"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$"}.get(c, c) for c in x)
    row = lambda r: " & ".join(map(safe, r)) + r" \\"
    return "\n".join([r"\begin{tabular}{" + "l" * len(head) + "}", r"\toprule", row(head), r"\midrule", *map(row, body), r"\bottomrule", r"\end{tabular}"])


def html_table(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    head, body = _cells(df, digits, most)
    tr = lambda r, t: "<tr>" + "".join(f"<{t}>{escape(x)}</{t}>" for x in r) + "</tr>"
    return "<table>" + tr(head, "th") + "".join(tr(r, "td") for r in body) + "</table>"


def render_tables(tables: Mapping[str, DataFrame], fmt: str = "markdown") -> dict[str, str]:
    return {k: {"markdown": markdown_table, "latex": latex_table, "html": html_table}[fmt](v) for k, v in tables.items()}
