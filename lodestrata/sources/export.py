"""Reports as JSON, newline-delimited JSON and digests; documents.py renders them as Markdown and HTML.

Tables of a report are capped before their rows meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows that an export shows of each table.
CAPS = {"languages": 20, "dependencies": 300, "findings": 100, "modules": 60, "hotspots": 20}


def as_json(report: DataFrame) -> DataFrame:
    """repo_id and the whole row as a JSON document."""
    return report.select("repo_id", F.to_json(F.struct(*report.columns)).alias("document"))


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_ndjson(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of newline-delimited JSON; a line that isn't JSON is left out."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


#: Rows that a digest shows of each list.
DIGEST = {"languages": 8, "frameworks": 15, "modules": 30, "edges": 40, "hubs": 8, "entry_points": 12, "infrastructure": 10, "dependencies": 25, "headings": 20, "findings": 10}


def digest(lists: dict[str, tuple[DataFrame, list]], limit: int = 200) -> DataFrame:
    """repo_id and a column a list: the first DIGEST rows of each of lists {name: (table, order)} as an array of structs, their
    strings without control characters and cut to limit."""
    from ..operators.generic import cap_per_group

    out = None
    for name, (df, order) in lists.items():
        columns = [c for c in df.columns if c != "repo_id"]
        kinds = dict(df.dtypes)
        short = lambda c: F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 1)), F.lit("…"))).otherwise(c)
        said = [short(F.regexp_replace(c, r"[\x00-\x1f\x7f]", " ")).alias(c) if kinds[c] == "string" else F.col(c) for c in columns]
        first = cap_per_group(df, ["repo_id"], order, DIGEST[name], "_nth")
        rows = first.select("repo_id", F.struct("_nth", F.struct(*said).alias("row")).alias("r")).groupBy("repo_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["row"]).alias(name))
        out = rows if out is None else out.join(rows, "repo_id", "full")
    return out


def schema_json(df: DataFrame) -> str:
    return df.schema.json()
