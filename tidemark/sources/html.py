"""Tables inside HTML pages as rows of cells, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import parse_count


def _parts(text: Column, tag: str) -> Column:
    """The inner text of every such element, in order."""
    return F.regexp_extract_all(text, F.lit(rf"(?is)<(?:{tag})(?:\s[^>]*)?>(.*?)</(?:{tag})\s*>"), F.lit(1))


def plain(text: Column) -> Column:
    """Text without tags, common entities resolved, runs of white space as one space."""
    out = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;|&#160;| ", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.regexp_replace(out, entity, char)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def table_cells(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, table, row, cell, value), counted from 0; pages without tables have no rows."""
    t = pages.select(F.col(id_col).alias("page_id"), F.posexplode(_parts(F.col(html_col), "table")).alias("table", "body"))
    r = t.select("page_id", "table", F.posexplode(_parts(F.col("body"), "tr")).alias("row", "body"))
    c = r.select("page_id", "table", "row", F.posexplode(_parts(F.col("body"), "td|th")).alias("cell", "body"))
    return c.select("page_id", "table", "row", "cell", plain(F.col("body")).alias("value"))


def tag_counts(pages: DataFrame) -> DataFrame:
    """Links and table cells of each page."""

    def n(pattern: str) -> Column:
        return F.regexp_count("html", F.lit(pattern)).cast("long")

    return pages.select("page_id", n(r"(?i)<a\s").alias("n_links"), n(r"(?i)<(td|th)[\s>]").alias("n_cells"))


def month_matrix(cells: DataFrame, months: list[str]) -> DataFrame:
    """(year, month, value, total) from tables that have a header of any cell, ``months`` and a total, and a row a year.

    A table without that header whose rows begin with a year, or a year's row of another shape, is an error when the
    result is computed: a changed page must not yield a shorter series. Rows that begin otherwise are left out.
    """
    wide = cells.groupBy("page_id", "table", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "value"))), lambda x: x["value"]).alias("c"))
    headed = F.max((F.size("c") == len(months) + 2) & (F.slice("c", 2, len(months)) == F.array(*map(F.lit, months)))).over(Window.partitionBy("page_id", "table"))
    years = wide.withColumn("headed", headed).where(F.col("c")[0].rlike("^[0-9]{4}$"))
    at = F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit(", table "), F.col("table").cast("string"), F.lit(", row "), F.col("row").cast("string"))
    no_header = F.raise_error(F.concat(at, F.lit(": no header of months above")))
    odd_shape = F.raise_error(F.concat(at, F.lit(f": not {len(months) + 2} cells")))
    c = F.when(~F.col("headed"), no_header.cast("array<string>")).when(F.size("c") != len(months) + 2, odd_shape.cast("array<string>")).otherwise(F.col("c"))
    checked = years.select(c.alias("c"))
    named = F.array(*[F.struct(F.lit(i + 1).alias("month"), F.col("c")[i + 1].alias("value")) for i in range(len(months))])
    return checked.select(F.col("c")[0].cast("int").alias("year"), F.explode(named).alias("m"), F.col("c")[len(months) + 1].alias("total")).select("year", "m.month", "m.value", "total")


def month_list(cells: DataFrame) -> DataFrame:
    """(page_id, month, y) from rows whose second cell is a month and year as "Jan 2020" and whose third is a count.

    A month's name may be whole, cut to three or more letters, or end in a dot; other rows are left out. A month whose
    count cannot be read has null.
    """
    wide = cells.groupBy("page_id", "table", "row").agg(*[F.max(F.when(F.col("cell") == i, F.col("value"))).alias(f"c{i}") for i in (1, 2)])
    name, year = (F.regexp_extract("c1", r"^([A-Za-z]{3,9})[.]?\s+([0-9]{4})$", i) for i in (1, 2))
    month = F.try_to_timestamp(F.concat(F.lit("1 "), F.initcap(F.substring(name, 1, 3)), F.lit(" "), year), F.lit("d MMM yyyy")).cast("date")
    whole = F.lower(F.date_format(month, "MMMM")).startswith(F.lower(name))
    return wide.select("page_id", month.alias("month"), whole.alias("whole"), parse_count(F.col("c2")).alias("y")).where("whole").drop("whole")


def lakh_summary(cells: DataFrame) -> DataFrame:
    """(page_id, year, lakh) from rows whose second cell is a year and whose third a decimal number; other rows are left out."""
    wide = cells.groupBy("page_id", "table", "row").agg(*[F.max(F.when(F.col("cell") == i, F.col("value"))).alias(f"c{i}") for i in (1, 2)])
    lakh = F.regexp_replace("c2", ",", "").try_cast("decimal(18,4)")
    return wide.where(F.col("c1").rlike("^[0-9]{4}$")).select("page_id", F.col("c1").cast("int").alias("year"), lakh.alias("lakh")).where("lakh is not null")
