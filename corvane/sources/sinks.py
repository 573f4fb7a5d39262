"""Writers: deterministic JSON lines, append-only logs, metrics, CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sorted_json(df: DataFrame, path: str, key: str, one_file: bool = False) -> None:
    """JSON lines in order of ``key`` with nulls kept, keys in column order. The order runs over the files by name;
    ``one_file`` is for small tables whose bytes are to be compared."""
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    out = df.orderBy(key).select(line.alias("value"))
    (out.coalesce(1) if one_file else out).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> None:
    """Add rows to a log; nothing that stands there is touched."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("append").text(path)


def write_metrics(row: DataFrame, path: str) -> None:
    """One row of metrics as JSON, replacing what was there."""
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header; nulls as empty fields."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_samples(spark: object, path: str) -> DataFrame:
    """Samples (size, seed, ids array, ids_hash) written as JSON; rows whose hash doesn't fit their ids are refused."""
    rows = spark.read.schema("size bigint, seed bigint, ids array<string>, ids_hash string").json(path)
    wrong = rows.where(F.sha2(F.array_join("ids", "\n"), 256) != F.col("ids_hash")).limit(1).collect()
    if wrong:
        raise ValueError(f"ids of the sample of size {wrong[0]['size']} don't fit their hash")
    return rows


def frontier_svg(points: list[tuple[float, float, bool]], title: str, width: int = 480, height: int = 320) -> str:
    """A scatter of (cost, gain, on the frontier) as SVG text."""
    pad = 40
    xs, ys = [p[0] for p in points] or [0.0], [p[1] for p in points] or [0.0]
    place = lambda v, lo, hi, a, b: a + (b - a) * ((v - lo) / (hi - lo) if hi > lo else 0.5)
    dots, path = [], []
    for x, y, on in sorted(points):
        cx, cy = place(x, min(xs), max(xs), pad, width - pad), place(y, min(ys), max(ys), height - pad, pad)
        dots.append(f'<circle cx="{cx:.1f}" cy="{cy:.1f}" r="4" fill="{"#2457a6" if on else "#999999"}"/>')
        if on:
            path.append(f"{cx:.1f},{cy:.1f}")
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="{pad}" y="20">{title}</text><polyline points="{" ".join(path)}" fill="none" stroke="#2457a6"/>{"".join(dots)}</svg>'
