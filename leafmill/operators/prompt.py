"""Prompts composed of tagged sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import lossy_utf8


def compose(parts: DataFrame, files: DataFrame) -> DataFrame:
    """prompt_id and prompt. parts: prompt_id, ord, tag, value; files: prompt_id, name, body (bytes).

    A value that names a file stands for its text. Sections are <tag>, text, </tag> on lines of their own, joined by an
    empty line; the section `instructions` (any case; the last of several) stands first and last instead.
    """
    named = files.select("prompt_id", F.col("name").alias("value"), lossy_utf8(F.col("body")).alias("__text"))
    met = parts.join(named, ["prompt_id", "value"], "left")
    section = F.concat(F.lit("<"), F.col("tag"), F.lit(">\n"), F.coalesce("__text", "value"), F.lit("\n</"), F.col("tag"), F.lit(">"))
    rows = met.select("prompt_id", "ord", (F.lower("tag") == "instructions").alias("held"), section.alias("s"))
    found = rows.groupBy("prompt_id").agg(
        F.sort_array(F.collect_list(F.when(~F.col("held"), F.struct("ord", "s")))).alias("body"),
        F.max(F.when(F.col("held"), F.struct("ord", "s"))).alias("around"),
    )
    body = F.array_join(F.transform("body", lambda r: r["s"]), "\n\n")
    return found.select("prompt_id", F.when(F.col("around").isNull(), body).otherwise(F.concat_ws("\n\n", F.col("around.s"), body, F.col("around.s"))).alias("prompt"))
