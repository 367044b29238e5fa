"""Column expressions: predicates, buckets, text, dates. All are built-in functions, so that scans and codegen see through them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def case_bucket(column: str | Column, bounds: Sequence[tuple[int, int]], beyond: str) -> Column:
    """'<low>-<high>' of the first bound that holds the value, `beyond` above all of them, 'none' for null and what is below."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.when(c.isNull(), "none")
    for low, high in bounds:
        out = out.when(c.between(low, high), f"{low}-{high}")
    return out.when(c > max(high for _, high in bounds), beyond).otherwise("none")


def optional_filter(df: DataFrame, condition: str | Column | None) -> DataFrame:
    """df filtered, or df itself if there is no condition."""
    return df if condition is None else df.where(condition)


def null_unless_equal(column: str, value: object) -> Column:
    return F.when(F.col(column) == value, F.col(column))


def differs_or_null(column: str, value: object) -> Column:
    """True where the value differs or is null; never null itself."""
    return ~F.col(column).eqNullSafe(F.lit(value))


def template_replace(template: str, values: dict[str, str]) -> Column:
    """The names in a template like 'A + B' replaced by the values of the columns they stand for, each followed by a space.

    values: the column of each name. Unknown names and null values give nothing."""
    names = F.transform(F.split(F.regexp_replace(template, r"\s+", ""), r"\+"), lambda x: x)
    table = F.create_map(*[x for name, column in values.items() for x in (F.lit(name), F.col(column).cast("string"))])
    found = F.filter(F.transform(names, lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull())
    return F.array_join(F.transform(found, lambda x: F.concat(x, F.lit(" "))), "")


def sort_chars(column: str) -> Column:
    """The characters of a text in code-point order."""
    return F.array_join(F.array_sort(F.split(column, "")), "")


def escape_unicode(column: str | Column) -> Column:
    r"""Characters beyond ASCII as \uXXXX."""

    def one(c: Column) -> Column:
        return F.when(F.ascii(c) > 127, F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))).otherwise(c)

    # runs of ASCII stay whole; only the characters between them are taken one by one
    return F.array_join(F.transform(F.split(column, r"(?<=[^\x00-\x7F])|(?=[^\x00-\x7F])"), one), "")


def iso_format(column: str | Column) -> Column:
    """A timestamp as ISO 8601 with hundredths and a literal Z."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SS'Z'")


def timestamp_or(column: str | Column, form: str, default: Column) -> Column:
    """The parsed timestamp, or default for texts that are null or not one."""
    return F.coalesce(F.try_to_timestamp(column, F.lit(form)), default)


def iso_year_week(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def week_range(column: str | Column) -> Column:
    """'yyyyww - yyyyww' as the list of all ISO weeks between, both included; an empty list for any other text."""
    c = F.col(column) if isinstance(column, str) else column
    ends = [F.regexp_extract(c, r"^\s*(\d{4})(\d{2})\s*-\s*(\d{4})(\d{2})\s*$", i) for i in (1, 2, 3, 4)]
    # the Monday of a week: that of the week of 4 January, and so many weeks on
    first, last = (
        F.date_add(F.date_trunc("week", F.make_date(ends[i].try_cast("int"), F.lit(1), F.lit(4))).cast("date"), (ends[i + 1].try_cast("int") - 1) * 7) for i in (0, 2)
    )
    fits = (ends[0] != "") & (last >= first)
    weeks = F.transform(F.sequence(first, last, F.expr("interval 7 days")), iso_year_week)
    return F.when(fits, weeks).otherwise(F.array().cast("array<string>"))


#: Requests for pages, and the endings that pages have (fixed values).
REQUEST = r"^GET (.+) HTTP/\d.\d$"
PAGE_ENDINGS = (".html", ".htm", "")


def requested_url(request: str | Column) -> Column:
    """The address in a GET request; empty for others."""
    return F.regexp_extract(request, REQUEST, 1)


def ending(url: Column) -> Column:
    """What follows the first dot in the last five characters, the dot included."""
    return F.regexp_extract(F.right(url, F.lit(5)), r"\..*", 0)


def used_memory(total: Column, used: Column, buffer: Column, cached: Column) -> Column:
    """total - ((total - used + buffer + cached) / total) * 100; null if total is 0."""
    return total - F.try_divide(total - used + buffer + cached, total) * 100
