"""Partial dates (YYYY, YYYY-MM, YYYY-MM-DD) as closed integer windows yyyymmdd, and the rules that match them.

A dated fact matches a constraint: exact (also none, unknown or null) as of,
i.e. it starts no later than the constraint ends; before strictly; after
strictly; between by containment. Undated or unreadable on either side never
matches; without a constraint everything does.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEPARATOR = ".."


def _token(value: Column) -> Column:
    return F.trim(value.cast("string"))


def time_start(value: Column) -> Column:
    """First day of a partial date; null if it is none."""
    v = _token(value)
    month = F.substring(v, 6, 2).try_cast("int")
    day = F.try_to_date(v, "yyyy-MM-dd")
    return (
        F.when(v.rlike(r"^[0-9]{4}$"), v.try_cast("int") * 10000 + 101)
        .when(v.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$"), F.substring(v, 1, 4).try_cast("int") * 10000 + month * 100 + 1)
        .when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & day.isNotNull(), F.translate(v, "-", "").try_cast("int"))
    )


def time_end(value: Column) -> Column:
    """Last day of a partial date; null if it is none."""
    v = _token(value)
    year, month = F.substring(v, 1, 4).try_cast("int"), F.substring(v, 6, 2).try_cast("int")
    last = F.day(F.last_day(F.try_to_date(F.concat(v, F.lit("-01")), "yyyy-MM-dd")))
    return F.when(v.rlike(r"^[0-9]{4}$"), year * 10000 + 1231).when(v.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$"), year * 10000 + month * 100 + last).otherwise(time_start(value))


def span(start: Column, end: Column) -> Column:
    """The window's width in integer steps, not days."""
    return end - start


def bounds(constraint: Column, semantic: Column) -> Column:
    """struct(s, e, kind) of a constraint: kind is before, after, between or exact; s and e are null if it can't be read."""
    name = F.lower(F.coalesce(semantic.cast("string"), F.lit("exact")))
    both = (name == "between") & constraint.contains(SEPARATOR)
    left, right = F.split_part(constraint, F.lit(SEPARATOR), F.lit(1)), F.substring_index(constraint, SEPARATOR, -1)
    kind = F.when(both, "between").when(name == "before", "before").when(name == "after", "after").otherwise("exact")
    start = F.when(both, F.when(time_start(right).isNotNull(), time_start(left))).otherwise(time_start(constraint))
    end = F.when(both, F.when(time_start(left).isNotNull(), time_end(right))).otherwise(time_end(constraint))
    return F.struct(start.alias("s"), end.alias("e"), kind.alias("kind"))


def in_bounds(start: Column, end: Column, b: Column) -> Column:
    """Whether a fact's window matches; false, not null, where either side is unreadable."""
    hit = F.when(b["kind"] == "between", (start >= b["s"]) & (end <= b["e"])).when(b["kind"] == "before", end < b["s"]).when(b["kind"] == "after", start > b["e"]).otherwise(start <= b["e"])
    return F.coalesce(hit, F.lit(False))


def matches(start: Column, end: Column, constraint: Column, semantic: Column) -> Column:
    """in_bounds, with everything matching where there is no constraint (null or empty)."""
    none = constraint.isNull() | (constraint == "")
    return none | in_bounds(start, end, bounds(constraint, semantic))


#: Calendar nodes by level: days since 1970, months since the year 0, years, decades.
DAY, MONTH, YEAR, DECADE = range(4)


def _date(value: Column) -> Column:
    """The day of yyyymmdd, null if there is no such day."""
    return F.try_to_date(F.lpad(value.cast("string"), 8, "0"), "yyyyMMdd")


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def _nodes(level: int, begin: Column, end: Column) -> Column:
    """Nodes of a level from begin to before end, none where that is not after it."""
    none = F.array().cast("array<int>")
    ids = F.when(begin < end, F.sequence(begin, F.greatest(begin, end - 1))).otherwise(none)
    return F.transform(ids, lambda x: F.struct(F.lit(level).alias("level"), x.cast("int").alias("node")))


def is_calendar(start: Column, end: Column) -> Column:
    """Whether a window is a day, a month or a year, as those of partial dates are."""
    real = _date(start).isNotNull()
    year = (start % 10000 == 101) & (end == start + 1130)
    month = (start % 100 == 1) & (end == F.date_format(F.last_day(_date(start)), "yyyyMMdd").cast("int"))
    return F.coalesce(real & ((start == end) | year | month), F.lit(False))


def is_span(start: Column, end: Column) -> Column:
    """Whether both ends are days."""
    return _date(start).isNotNull() & _date(end).isNotNull()


def covering_nodes(start: Column, end: Column) -> Column:
    """The nodes that hold a calendar window: its own and those above it."""
    day = _date(start)
    year, decade = F.year(day), F.floor(F.year(day) / 10).cast("int")
    node = lambda level, x: F.struct(F.lit(level).alias("level"), x.cast("int").alias("node"))
    wide = F.array(node(YEAR, year), node(DECADE, decade))
    single, whole_year = start == end, end - start == 1130
    months = F.concat(F.array(node(MONTH, _month(day))), wide)
    return F.when(single, F.concat(F.array(node(DAY, F.unix_date(day))), months)).when(whole_year, wide).otherwise(months)


def span_nodes(start: Column, end: Column) -> Column:
    """The fewest nodes that make up a span of days; none for a null or empty one. A calendar window lies in the span if and
    only if one of these holds it, as calendar nodes are nested or apart."""
    first, after = _date(start), F.date_add(_date(end), 1)
    d1, dx = F.unix_date(first), F.unix_date(after)
    m1 = _month(F.date_add(first, -1)) + 1  # the first month that begins in the span, and the one in which it ends
    mx = _month(after)
    day_of = lambda m: F.unix_date(F.make_date(F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"), F.lit(1)))
    y1, yx = F.ceil(m1 / 12).cast("int"), F.floor(mx / 12).cast("int")
    t1, tx = F.ceil(y1 / 10).cast("int"), F.floor(yx / 10).cast("int")
    years = F.when(t1 < tx, F.concat(_nodes(YEAR, y1, t1 * 10), _nodes(DECADE, t1, tx), _nodes(YEAR, tx * 10, yx))).otherwise(_nodes(YEAR, y1, yx))
    months = F.when(y1 < yx, F.concat(_nodes(MONTH, m1, y1 * 12), years, _nodes(MONTH, yx * 12, mx))).otherwise(_nodes(MONTH, m1, mx))
    days = F.when(m1 < mx, F.concat(_nodes(DAY, d1, day_of(m1)), months, _nodes(DAY, day_of(mx), dx))).otherwise(_nodes(DAY, d1, dx))
    return F.when(start <= end, days).otherwise(F.filter(_nodes(DAY, F.lit(0), F.lit(1)), lambda x: F.lit(False)))
