"""Main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.registry import query, table
from plumbline.llm.site_style import main_text


@query()
def op6_site_style_text(spark: SparkSession, folder: str) -> DataFrame:
    """Text of every page without the branches that its site's style tree finds unimportant."""
    return main_text(table(spark, folder, "pages"), ["page_id", "url"])
