"""Small results as Markdown, on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A table of the rows of an aggregate; more than `most` rows are an error, as a report is no export."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["-"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def report(title: str, sections: dict[str, DataFrame | str], most: int = 1000) -> str:
    """A page of Markdown: a heading, and under each section's its text or table."""
    parts = [f"# {title}\n"]
    for name, content in sections.items():
        parts.append(f"## {name}\n\n{content if isinstance(content, str) else markdown(content, most)}")
    return "\n".join(parts)


def samples(before: DataFrame, after: DataFrame, key: str, n: int = 2000) -> DataFrame:
    """(key, part, text): the first n characters of the texts of each row before and after, of rows (key, text) in both."""
    rows = before.select(key, F.col("text").alias("b")).join(after.select(key, F.col("text").alias("a")), key)
    parts = F.array(F.struct(F.lit("before").alias("part"), F.left("b", F.lit(n)).alias("text")), F.struct(F.lit("after").alias("part"), F.left("a", F.lit(n)).alias("text")))
    return rows.select(key, F.explode(parts).alias("p")).select(key, "p.*")


def write_samples(rows: DataFrame, key: str, path: str) -> None:
    """A text file for each sample, in folders by key and part."""
    rows.repartition(key, "part").write.mode("overwrite").partitionBy(key, "part").option("lineSep", "\n").text(path)
