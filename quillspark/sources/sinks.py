"""Writers: tables, one-file exports, run reports, markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

C = F.col


def write_table(df: DataFrame, path: str) -> None:
    """Parquet; readers see all of it or nothing of it (the commit protocol renames at the end)."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One quoted CSV file with a header, for exports of result tables."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("compression", "gzip").json(path)


def write_with_report(df: DataFrame, path: str, name: str, **counters) -> dict:
    """Writes ``df`` and returns its counters, gathered by the same job."""
    seen = Observation(name)
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counters.items()]).write.mode("overwrite").parquet(path)
    return {"run": name, **seen.get}


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result table as markdown; refuses tables of more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: not a result table")
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *map(line, rows)])


def variables(values: dict) -> str:
    """Document variables as YAML; raises if one is missing."""
    gone = sorted(k for k, v in values.items() if v is None)
    if gone:
        raise ValueError(f"missing: {', '.join(gone)}")
    return "".join(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in sorted(values.items()))


def deposit(df: DataFrame, drop: list[str], rename: dict[str, str], key: str) -> DataFrame:
    """Published columns; raises if the key is not unique."""
    out = df.drop(*drop).withColumnsRenamed(rename)
    if not out.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} repeats")
    return out


def canonical_hash(df: DataFrame, digits: int = 8) -> DataFrame:
    """rows, hash: independent of row order, repeated rows counted; doubles at ``digits`` digits."""
    cells = [F.coalesce(F.format_string(f"%.{digits - 1}e", c) if k in ("double", "float") else F.col(c).cast("string"), F.lit("∅")) for c, k in sorted(df.dtypes)]
    return df.select(F.xxhash64(*cells).alias("h")).agg(F.count(F.lit(1)).alias("rows"), (F.sum(C("h").cast("decimal(38,0)")) % F.lit(2**61 - 1).cast("decimal(38,0)")).cast("long").alias("hash"))
