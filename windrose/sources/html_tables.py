"""Rows of the tables of web pages as a table function, for boards that patterns over tags cannot take apart.

The page is read as a stream of tags. A row ends where the next one, its table or the page ends, a cell where the next one
does, whether or not it is closed. A table inside a cell has rows of its own and adds nothing to the cell's text. Cells that
span columns or rows stand in every place that they cover. Text of hidden elements is left out; struck-out text is apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

ROW = "table int, row int, row_class string, cells array<string>, struck array<string>"
# Elements without an end, those that strike text out, classes that do so or hide, and the widest span.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
STRIKING, STRUCK, HIDDEN = frozenset(("del", "s", "strike")), frozenset(("del",)), frozenset(("d-none", "hidden"))
MOST_SPAN = 1000


class _Cell:
    def __init__(self, columns: int, rows: int) -> None:
        self.columns, self.rows = columns, rows
        self.text: list[str] = []
        self.struck: list[str] = []

    def values(self) -> tuple[str | None, str | None]:
        return " ".join("".join(self.text).split()) or None, " ".join("".join(self.struck).split()) or None


class _Table:
    def __init__(self, number: int) -> None:
        self.number, self.row, self.row_class = number, -1, None
        self.cells: list[_Cell] | None = None
        #: By column: the cell that still covers it and in how many rows.
        self.covering: dict[int, list] = {}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[_Table] = []
        self.count = 0
        self.rows: list[tuple] = []
        #: Open elements within the innermost cell: (tag, whether it strikes, whether it hides); of outer cells below.
        self.open: list[list[tuple[str, bool, bool]]] = [[]]

    def _end_row(self) -> None:
        table = self.tables[-1]
        if table.cells is None:
            return
        line: list[_Cell | None] = []
        given = iter(table.cells)
        cell, left = next(given, None), 0
        column = 0
        while cell is not None or any(c >= column for c in table.covering):
            if column in table.covering:
                over = table.covering[column]
                line.append(over[0])
                over[1] -= 1
                if not over[1]:
                    del table.covering[column]
            elif cell is not None:
                line.append(cell)
                left += 1
                if cell.rows > 1:
                    table.covering[column] = [cell, cell.rows - 1]
                if left >= cell.columns:
                    cell, left = next(given, None), 0
            else:
                line.append(None)
            column += 1
        if line:
            values = [c.values() if c else (None, None) for c in line]
            self.rows.append((table.number, table.row, table.row_class, [v[0] for v in values], [v[1] for v in values]))
        table.cells = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        if tag == "table":
            self.tables.append(_Table(self.count))
            self.open.append([])
            self.count += 1
        elif tag == "tr" and self.tables:
            self._end_row()
            table = self.tables[-1]
            table.row, table.row_class, table.cells = table.row + 1, given.get("class"), []
            self.open[-1] = []
        elif tag in ("td", "th") and self.tables:
            table = self.tables[-1]
            if table.cells is None:
                table.row, table.row_class, table.cells = table.row + 1, None, []
            spans = [min(MOST_SPAN, int(given.get(x) or 1)) if (given.get(x) or "1").isdigit() else 1 for x in ("colspan", "rowspan")]
            table.cells.append(_Cell(max(1, spans[0]), max(1, spans[1])))
            self.open[-1] = []
        elif tag not in VOID:
            classes = set((given.get("class") or "").split())
            self.open[-1].append((tag, tag in STRIKING or bool(classes & STRUCK), bool(classes & HIDDEN) or "hidden" in given or tag in ("script", "style")))
            self.handle_data(" ")
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.tables:
            self._end_row()
            self.tables.pop()
            self.open.pop()
        elif tag == "tr" and self.tables:
            self._end_row()
            self.open[-1] = []
        elif tag in ("td", "th") and self.tables:
            self.open[-1] = []
        elif any(t == tag for t, _, _ in self.open[-1]):
            while self.open[-1].pop()[0] != tag:
                pass
            self.handle_data(" ")

    def handle_data(self, data: str) -> None:
        if not self.tables or not self.tables[-1].cells or any(h for _, _, h in self.open[-1]):
            return
        cell = self.tables[-1].cells[-1]
        (cell.struck if any(s for _, s, _ in self.open[-1]) else cell.text).append(data)

    def finished(self) -> list[tuple]:
        self.close()
        while self.tables:
            self._end_row()
            self.tables.pop()
        return sorted(self.rows, key=lambda r: r[:2])


@udtf(returnType=ROW)
class TableRows:
    """One row for each row of each table of a page; tables in the order in which they begin."""

    def eval(self, html: str) -> Iterator[tuple]:
        if html:
            reader = _Reader()
            reader.feed(html)
            yield from reader.finished()


def table_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without their html, once for each row of their tables; pages without a table give no rows."""
    return pages.lateralJoin(TableRows(F.col(html).outer())).drop(html)


def board(pages: DataFrame, row_class: str = "datarows", time: int = 0, place: int = 1, html: str = "html") -> DataFrame:
    """Rows of an airport's board: a struck-out time is the scheduled one, and "City (ABC)" is city and code."""
    rows = table_rows(pages, html).filter(F.array_contains(F.split(F.coalesce("row_class", F.lit("")), r"\s+"), row_class))
    now, where = F.regexp_extract(F.get("cells", F.lit(time)), r"(\d{1,2}:\d{2})", 1), F.get("cells", F.lit(place))
    named: Column = where.rlike(r".+\(.*\)")
    return rows.withColumns({
        "scheduled": F.coalesce(F.get("struck", F.lit(time)), F.nullif(now, F.lit(""))), "actual": F.nullif(now, F.lit("")),
        "city": F.when(named, F.trim(F.regexp_extract(where, r"^(.+?)\s*\(", 1))).otherwise(where), "iata": F.when(named, F.trim(F.regexp_extract(where, r"\((.*?)\)", 1))),
    })
