"""Scalar rules as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def banding(value: Column, edges: Sequence[float]) -> Column:
    """How many of the ascending edges the value is beyond."""
    return sum(((value > e).cast("long") for e in edges[1:]), (value > edges[0]).cast("long"))


def severity(value: Column, threshold: float) -> Column:
    """none up to 0.75 of the threshold, info up to it, warn up to twice it, else error."""
    return F.when(value <= 0.75 * threshold, "none").when(value <= threshold, "info").when(value <= 2 * threshold, "warn").otherwise("error")


def first_prefix(value: Column, rules: Sequence[tuple[str, str]], other: str | None = None) -> Column:
    """Class of the first rule whose prefix the value has."""
    out = F.when(value.startswith(rules[0][0]), rules[0][1])
    for prefix, name in rules[1:]:
        out = out.when(value.startswith(prefix), name)
    return out.otherwise(F.lit(other)) if other is not None else out


def path_tail(path: Column) -> Column:
    """The last two parts of a path that has more than two."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: p != "")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(path)


def human_size(n: Column) -> Column:
    """F16. A tie goes to the even digit, as C rounds: such values are exact in binary, and in decimals of 20 places."""
    shown = lambda unit, digits: F.bround((n / unit).cast("decimal(38,20)"), digits).cast("string")
    return F.when(n >= 1 << 20, F.concat(shown(1 << 20, 2), F.lit(" MB"))).when(n >= 1024, F.concat(shown(1024, 1), F.lit(" KB"))).otherwise(F.format_string("%d B", n.cast("long")))


def stable_id(*parts: Column) -> Column:
    """`lens:` and 16 hex digits of the SHA-1 of the parts."""
    return F.concat(F.lit("lens:"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16))


def next_review(at: Column, stage: Column, days: Sequence[int] = (7, 30, 90)) -> Column:
    """at plus the stage's interval; null beyond the last one."""
    return F.date_add(at, F.try_element_at(F.array(*map(F.lit, days)), stage + 1))
