"""Response templates compiled to patterns on the driver; extraction is by group number, so it stays in generated code."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import captured_number

# What a number and hex digits look like in a reply.
NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"
HEX = r"(?:0[xX])?[0-9a-fA-F]+"


@dataclass
class Template:
    """A pattern, its value groups as (group, channel, kind) and the group that echoes the command."""

    pattern: str
    values: list[tuple[int, int, str]] = field(default_factory=list)
    echo: int | None = None


def compiled(template: str) -> Template:
    """`<cmd>` echoes the command, `<ch N>` and `<hex N>` are values of a channel, `<any>` skips, any other `<...>` is the next free channel's value; blanks stretch."""
    out, group = Template(""), 0
    used: set[int] = set()
    for token in re.split(r"(<[^<>]*>)", template):
        if not (token.startswith("<") and token.endswith(">")):
            out.pattern += r"\s+".join(re.escape(part) for part in re.split(r"\s+", token))
            continue
        name = token[1:-1].strip().lower()
        if name in ("any", "*", "skip"):
            out.pattern += ".*?"
            continue
        group += 1
        if name == "cmd" or name.startswith("command"):
            out.pattern, out.echo = out.pattern + r"([^\s]+)", group
            continue
        free = next(c for c in range(1, len(used) + 2) if c not in used)
        channel, kind = free, "number"
        if m := re.fullmatch(r"(?:ch|channel)\s*(\d+)", name):
            channel = int(m[1])
        elif m := re.fullmatch(r"hex\s*(\d+)?", name):
            channel, kind = int(m[1]) if m[1] else free, "hex"
        used.add(channel)
        out.values.append((group, channel, kind))
        out.pattern += f"({HEX if kind == 'hex' else NUMBER})"
    return out


def samples(line: Column, template: Template, names: list[str], channels: list[int] | None = None) -> Column:
    """ST2: array of (channel, value) found in a line; empty if it does not fit, or echoes a command that is none of the names."""
    text = F.trim(line)
    pattern = "(?i)" + template.pattern
    fits = text.rlike(pattern)
    if template.echo is not None:
        fits = fits & F.lower(F.regexp_extract(text, pattern, template.echo)).isin([n.strip().lower() for n in names])
    found = [F.struct(F.lit(channel).cast("long").alias("channel"), captured_number(F.regexp_extract(text, pattern, group), kind).alias("value")) for group, channel, kind in template.values if not channels or channel in channels]
    if not found:
        return F.array().cast("array<struct<channel:bigint,value:double>>")
    return F.when(fits, F.filter(F.array(*found), lambda s: s["value"].isNotNull())).otherwise(F.array().cast("array<struct<channel:bigint,value:double>>"))
