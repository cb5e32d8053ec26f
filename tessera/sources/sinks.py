"""Sinks (S4, S5, S6, S8): itemsets to Parquet / CSV / text lines, models.

Paths and save modes are parameters.  ``single_file`` funnels the rows
through one task; use it only for small results (an itemset table), never
for row-level data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import itemset_key


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Itemsets (or any result) as Parquet."""
    df.write.mode(mode).parquet(path)


def write_itemsets_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = True) -> None:
    """CSV with the item array rendered as a string (``[1, 2]``)."""
    out = df.select(F.col("items").cast("string").alias("items"),
                    *[c for c in df.columns if c != "items"])
    (out.coalesce(1) if single_file else out).write.mode(mode).csv(path)


def write_text_lines(df: DataFrame, path: str, value: str = "support", mode: str = "overwrite",
                     single_file: bool = True) -> None:
    """Text lines ``"{a,b}: n"``."""
    out = df.select(F.concat_ws(": ", itemset_key("items"), F.col(value).cast("string")).alias("value"))
    (out.coalesce(1) if single_file else out).write.mode(mode).text(path)


def save_model(model, path: str) -> None:
    """Persist a fitted MLlib model, overwriting."""
    model.write().overwrite().save(path)
