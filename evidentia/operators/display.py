"""HTML and markdown of reports, as native expressions.

For the few rows of a report that people look at: cells of any nesting become
tables, matrices of shares become shaded tables, counts become bars, and the
headings of a notebook become a list of contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from ..functions.text import escaped, stripped


def short(text: Column, limit: int | None) -> Column:
    """The stripped text, cut behind ``limit`` characters with an ellipsis."""
    text = stripped(text)
    return text if limit is None else F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def _row(cells: list[Column], tag: str) -> Column:
    return F.concat(F.lit("<tr>"), *[p for c in cells for p in (F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))], F.lit("</tr>"))


def cell(value: Column, kind: DataType, limit: int | None = None, raw: tuple[str, ...] = ()) -> Column:
    """HTML of a value.

    A list of structs is a nested table, a list of scalars its items joined by
    commas, anything else escaped text; struct fields named in ``raw`` are HTML
    already.  A null is empty; an empty list says so.
    """
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        fields = kind.elementType.fields
        head = _row([escaped(F.lit(f.name)) for f in fields], "th")
        body = F.array_join(F.transform(value, lambda s: _row([s[f.name] if f.name in raw else cell(s[f.name], f.dataType, limit, raw) for f in fields], "td")), "")
        some = F.concat(F.lit("<table>"), head, body, F.lit("</table>"))
        return F.when(value.isNull(), "").when(F.size(value) == 0, "<i>(no rows)</i>").otherwise(some)
    if isinstance(kind, ArrayType):
        text = F.array_join(F.transform(value, lambda v: stripped(v.cast("string"))), ", ")
        return F.when(value.isNull(), "").when(F.size(value) == 0, "<i>(none)</i>").otherwise(escaped(short(text, limit)))
    if isinstance(kind, StructType):
        return cell(F.array(value), ArrayType(kind), limit, raw)
    return F.coalesce(escaped(short(value.cast(StringType()), limit)), F.lit(""))


def html_rows(rows: DataFrame, limit: int | None = None, raw: tuple[str, ...] = ()) -> DataFrame:
    """The rows with each column as HTML; columns named in ``raw`` stay as they are."""
    return rows.select(*[F.col(f"`{f.name}`") if f.name in raw else cell(F.col(f"`{f.name}`"), f.dataType, limit, raw).alias(f.name) for f in rows.schema.fields])


def shaded(rows: DataFrame, label: str, columns: list[str], most: float = 100.0, threshold: float = 50.0) -> DataFrame:
    """(label, html): table rows whose cells are shaded from white to green by their share of ``most``.

    Nulls and zeros have no text; from ``threshold`` on the text is white.
    """

    def one(c: str) -> Column:
        v = F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))
        light = F.round(100 - 70 * F.least(F.greatest(v / most, F.lit(0.0)), F.lit(1.0))).cast("int")
        text = F.when(v > 0, F.format_string("%.1f", v)).otherwise("")
        return F.concat(F.lit('<td style="background:hsl(120,40%,'), light, F.lit("%);color:"), F.when(v >= threshold, "white").otherwise("black"), F.lit('">'), text, F.lit("</td>"))

    return rows.select(label, F.concat(F.lit("<tr><th>"), escaped(F.col(label).cast("string")), F.lit("</th>"), *[one(c) for c in columns], F.lit("</tr>")).alias("html"))


def bars(rows: DataFrame, label: str, value: str, width: int = 300) -> DataFrame:
    """(label, svg): a bar for each row, in proportion to the largest value."""
    top = rows.agg(F.max(F.col(value).cast("double")).alias("_top"))
    wide = F.coalesce(F.round(F.try_divide(F.col(value) * F.lit(width), F.col("_top"))).cast("int"), F.lit(0))
    text = F.concat(F.col(value).cast("string"), F.lit(" "), escaped(F.col(label).cast("string")))
    svg = F.concat(F.lit(f'<svg width="{2 * width}" height="16"><rect width="'), wide, F.lit(f'" height="14" fill="#3a7"/><text x="{width + 6}" y="12">'), text, F.lit("</text></svg>"))
    return rows.crossJoin(F.broadcast(top)).select(label, svg.alias("svg"))  # one row


def notebook_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of the markdown cells of a notebook, in order."""
    cells = spark.read.schema("cells array<struct<cell_type:string,source:array<string>>>").json(path, multiLine=True).select(F.posexplode("cells").alias("c", "cell"))
    lines = cells.where("cell.cell_type = 'markdown'").select("c", F.posexplode("cell.source").alias("l", "value"))
    return lines.select(F.struct("c", "l").alias("line"), "value")


def contents(lines: DataFrame) -> DataFrame:
    """(line, entry): a nested list of links to the headings among (line, value); the first level stands alone."""
    rows = lines.where(F.col("value").rlike(r"^#+ \w+"))
    level = F.length(F.regexp_extract("value", "^(#+)", 1))
    title = F.regexp_replace("value", r"^[ #\n]+|[ #\n]+$", "")
    lead = F.when(level > 1, F.concat(F.expr("repeat('  ', greatest(length(regexp_extract(value, '^(#+)', 1)) - 2, 0))"), F.lit("- ["))).otherwise("\n[")
    return rows.select("line", F.concat(lead, title, F.lit("](#"), F.replace(title, F.lit(" "), F.lit("-")), F.lit(")")).alias("entry"))
