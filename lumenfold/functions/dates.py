"""Dates as official pages write them, and the date that a question is about."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.text import contains_any, fold_date, fold_ws

# Months in French and English, without marks.
MONTHS = {
    "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}
BEFORE = ("before", "avant", "prior to", "up to", "jusqu")
CHANGED = ("changed", "change", "changes", "changement", "modifi", "nouveau", "new rule", "updated", "mise a jour")


def month_number(name: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))]), name)


def make(y: Column, m: Column, d: Column) -> Column:
    """A date; null where there is no such day."""
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def parse_date(c: Column) -> Column:
    """ISO text of ``2026-07-01``, ``1/7/2026`` or ``1er juillet 2026``; empty for anything else. ISO input is taken as it is."""
    v = F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("1er"), F.lit("1"))
    part = lambda pattern, i: F.nullif(F.regexp_extract(v, pattern, i), F.lit(""))
    slash = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    folded = fold_ws(v)
    words = r"^(\d{1,2}) ([a-z]+) (\d{4})$"
    word = lambda i: F.nullif(F.regexp_extract(folded, words, i), F.lit(""))
    found = F.coalesce(make(part(slash, 3), part(slash, 2), part(slash, 1)), make(word(3), month_number(word(2)), word(1)))
    return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v).otherwise(F.coalesce(F.date_format(found, "yyyy-MM-dd"), F.lit("")))


def in_force(since: Column, until: Column, on: Column) -> Column:
    """Unknown ends are open; the last day counts."""
    return (since.isNull() | (since <= on)) & (until.isNull() | (until >= on))


def asked_about(c: Column, now: Column) -> Column:
    """struct(on, historical, about_change): the day that a question is about; ``now`` unless it says otherwise."""
    f = fold_date(c)
    iso = F.try_to_date(F.regexp_extract(c, r"\b(\d{4}-\d{2}-\d{2})\b", 1), "yyyy-MM-dd")
    names = "|".join(MONTHS)
    pattern = rf"((?:before |avant |prior to |up to |in |en |fin )?)\b({names}) (\d{{4}})\b"
    month = month_number(F.nullif(F.regexp_extract(f, pattern, 2), F.lit("")))
    year = F.nullif(F.regexp_extract(f, pattern, 3), F.lit("")).cast("int")
    head = F.substr(f, F.greatest(F.regexp_instr(f, F.lit(pattern)) - 24, F.lit(1)), F.lit(24 + 20))
    first = make(year, month, F.lit(1))
    end = F.last_day(first)
    by_month = F.when(contains_any(head, BEFORE), F.date_sub(first, 1)).otherwise(F.when(year <= F.year(now), F.least(end, now)).otherwise(end))
    only = F.nullif(F.regexp_extract(f, r"\b(20\d{2})\b", 1), F.lit("")).cast("int")
    by_year = F.when(only.isNotNull(), F.least(make(only, F.lit(12), F.lit(31)), now))
    last = F.when(F.contains(f, F.lit("last year")) | F.contains(f, F.lit("annee derniere")), make(F.year(now) - 1, F.lit(12), F.lit(31)))
    on = F.coalesce(iso, by_month, by_year, last, now)
    return F.struct(on.alias("on"), (on < now).alias("historical"), contains_any(f, CHANGED).alias("about_change"))


def is_now(asked: Column) -> Column:
    """A question about what holds today, for the struct of :func:`asked_about`."""
    return ~asked["historical"]
