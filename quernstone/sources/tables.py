"""CSV, JSON and report files."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Header, quoted line breaks and a byte-order mark are understood; columns stay text without a schema."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = False, one_file: bool = False) -> None:
    """Refuses a folder that exists, unless told to replace it. one_file: for reports of bounded size."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("escape", '"').csv(path)


def read_lexicon(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def markdown(df: DataFrame, limit: int = 100) -> str:
    """A table of the first rows (a report, so limited)."""
    rows = [[("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)).replace("|", "\\|") for v in r] for r in df.limit(limit).collect()]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def upsert_section(document: str, name: str, body: str) -> str:
    """Replaces the text between the section's comment marks, or appends it with them; doing so twice changes nothing."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    block = f"{begin}\n{body.strip()}\n{end}"
    if begin in document and end in document:
        head, rest = document.split(begin, 1)
        return head + block + rest.split(end, 1)[1]
    return (document.rstrip() + "\n\n" if document.strip() else "") + block + "\n"


def run_metadata(**parts) -> str:
    """JSON of a run's settings, with a digest of each text among them."""
    digests = {f"{k}_sha256": hashlib.sha256(v.encode()).hexdigest() for k, v in parts.items() if isinstance(v, str)}
    return json.dumps({**parts, **digests}, ensure_ascii=False, sort_keys=True, indent=2)
