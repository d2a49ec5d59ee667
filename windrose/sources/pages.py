"""Fields of web pages by patterns: language, title, host, links; rows and cells of flight boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def board_fields(html: Column, url: Column) -> dict[str, Column]:
    return {
        "lang": F.regexp_extract(html, '<html lang="([a-z]+)"', 1),
        "title": F.regexp_extract(html, "<title>([^<]*)</title>", 1),
        "host": F.regexp_extract(url, "^https?://([^/?#]+)", 1),
        "n_paragraphs": F.size(F.regexp_extract_all(html, F.lit("<p>"), F.lit(0))),
        "links": F.array_join(F.regexp_extract_all(html, F.lit('<li><a href="([^"]*)"'), F.lit(1)), " "),
    }


def _text(cell: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(cell, "<[^>]*>", " "), r"\s+", " ")), F.lit(""))


def board_rows(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per table row of a board: its cells, a struck-out time as the scheduled one, and city and code of "City (ABC)"."""
    rows = pages.select(*keep, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "inner"))
    cells = F.regexp_extract_all("inner", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))
    struck = F.nullif(F.regexp_extract("inner", r"(?is)<del[^>]*>(.*?)</del>", 1), F.lit(""))
    clocks = F.regexp_extract_all(F.regexp_replace("inner", r"(?is)<del[^>]*>.*?</del>", ""), F.lit(r"(\d{1,2}:\d{2})"), F.lit(1))
    place = F.array_join(F.transform(cells, _text), "\n")
    return rows.filter(F.size(cells) > 0).select(
        *keep, "row", F.transform(cells, _text).alias("cells"), F.coalesce(F.trim(struck), F.get(clocks, F.lit(0))).alias("scheduled"), F.get(clocks, F.lit(0)).alias("actual"),
        F.nullif(F.trim(F.regexp_extract(place, r"([^\n]+?)\s*\(([A-Z]{3})\)", 1)), F.lit("")).alias("city"), F.nullif(F.regexp_extract(place, r"\(([A-Z]{3})\)", 1), F.lit("")).alias("iata"),
    )


def aircraft_and_tail(cell: Column) -> tuple[Column, Column]:
    """The two of a cell such as "B78X (VN-A874)"; a cell without brackets is the aircraft alone."""
    aircraft = F.nullif(F.trim(F.regexp_extract(cell, r"^([^(]*)", 1)), F.lit(""))
    return aircraft, F.nullif(F.trim(F.regexp_extract(cell, r"\(([^)]*)\)", 1)), F.lit(""))


def history_rows(pages: DataFrame, columns: dict[str, int], html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per data row of a history table, its cells under the names of their places; dashes are null."""
    rows = pages.select(*keep, F.posexplode(F.regexp_extract_all(html, F.lit(r'(?is)<tr[^>]*class="[^"]*\bdata-row\b[^"]*"[^>]*>(.*?)</tr>'), F.lit(1))).alias("row", "inner"))
    cells = F.transform(F.regexp_extract_all("inner", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), _text)
    rows = rows.select(*keep, "row", cells.alias("cells"))
    return rows.select(*keep, "row", *(F.when(~F.get("cells", F.lit(k)).isin("—", "-"), F.get("cells", F.lit(k))).alias(name) for name, k in columns.items()))


def detail_fields(html: Column, names: dict[str, str]) -> dict[str, Column]:
    """Fields of an item's panel by the test ids of their elements; of a list of terms its value counts."""
    out = {}
    for name, mark in names.items():
        inner = F.regexp_extract(html, rf'(?is)<(\w+)[^>]*\bdata-testid="{mark}"[^>]*>(.*?)</\1>', 2)
        value = F.regexp_extract(inner, r"(?is)<dd[^>]*>(.*?)</dd>", 1)
        out[name] = _text(F.when(F.length(value) > 0, value).otherwise(inner))
    return out


def term_value(html: Column, term: str) -> Column:
    """The value that follows the first term with that word in a list of terms."""
    return _text(F.regexp_extract(html, rf"(?is)<dt[^>]*>[^<]*{term}[^<]*</dt>\s*<dd[^>]*>(.*?)</dd>", 1))
