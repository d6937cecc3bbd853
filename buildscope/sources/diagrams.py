"""Class diagrams in JSON as tables of types, bases, members, methods and relations (SRC17)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.code import relation_kind

_FLAGS = (
    "is_virtual", "is_pure_virtual", "is_static", "is_const", "is_constructor", "is_defaulted", "is_deleted", "is_noexcept", "is_constexpr",
    "is_consteval", "is_coroutine", "is_operator", "is_copy_assignment", "is_move_assignment",
)
_PLACE = "source_location:struct<file:string,line:int,column:int>"
_METHOD = f"name:string,display_name:string,type:string,access:string,parameters:array<struct<name:string,type:string>>,{','.join(f'{f}:boolean' for f in _FLAGS)},{_PLACE}"
_MEMBER = f"name:string,type:string,access:string,is_static:boolean,{_PLACE}"
_ELEMENT = (
    "id:string,name:string,namespace:string,display_name:string,type:string,is_abstract:boolean,is_struct:boolean,is_union:boolean,is_template:boolean,is_nested:boolean,"
    f"bases:array<struct<id:string,access:string,is_virtual:boolean>>,members:array<struct<{_MEMBER}>>,methods:array<struct<{_METHOD}>>,{_PLACE}"
)
_SCHEMA = f"elements array<struct<{_ELEMENT}>>, relationships array<struct<source:string,destination:string,type:string,access:string,label:string>>"
# What kinds of types there are, and of access.
KINDS, ACCESS = ("enum", "concept", "class", "struct", "union"), ("public", "private", "protected")


class Diagram(NamedTuple):
    """types: file, id, name, display_name, namespace, qualified, kind, is_abstract, is_template, is_nested, source, line, ord. bases:
    file, type_id, ord, base, access, is_virtual. members: file, type_id, ord, name, type, access, is_static, source, line. methods:
    file, type_id, ord, name, display_name, returns, n_params, params, access, flags, is_destructor, source, line. relations: file, src, dst, kind,
    access, label, ord."""

    types: DataFrame
    bases: DataFrame
    members: DataFrame
    methods: DataFrame
    relations: DataFrame


def class_diagram(files: DataFrame) -> Diagram:
    """SRC17: the tables of diagrams (file, text).

    Elements without an id or a name, members and methods without a name, bases without an id and relations without both ends
    go; ids are texts, as they may be beyond 53 bits. A destructor is told by its tilde. A place counts if it has a file
    and a line. ord is the place in the file's list. Text that is no such JSON gives no rows.
    """
    read = files.select("file", F.from_json("text", _SCHEMA).alias("d"))
    text = lambda c: F.coalesce(c, F.lit(""))
    flag = lambda c: F.coalesce(c, F.lit(False))
    access = lambda c: F.when(c.isin(*ACCESS), c).otherwise("public")
    placed = lambda p: (F.when((text(p["file"]) != "") & p["line"].isNotNull(), p["file"]).alias("source"), F.when(text(p["file"]) != "", p["line"]).alias("line"))
    elements = read.select("file", F.posexplode("d.elements").alias("ord", "e")).where((text(F.col("e.id")) != "") & (text(F.col("e.name")) != ""))
    e = lambda c: F.col(f"e.{c}")
    space = text(e("namespace"))
    kind = F.when(flag(e("is_union")), "union").when(flag(e("is_struct")), "struct").when(e("type").isNull(), "class").when(e("type").isin(*KINDS), e("type")).otherwise("unknown")
    types = elements.select("file", e("id"), e("name"), F.coalesce(e("display_name"), e("name")).alias("display_name"), space.alias("namespace"), F.when(space != "", F.concat(space, F.lit("::"), e("name"))).otherwise(e("name")).alias("qualified"), kind.alias("kind"), *(flag(e(c)).alias(c) for c in ("is_abstract", "is_template", "is_nested")), *placed(e("source_location")), "ord")
    inner = lambda c: elements.select("file", e("id").alias("type_id"), F.posexplode(e(c)).alias("ord", "x"))
    x = lambda c: F.col(f"x.{c}")
    bases = inner("bases").where(text(x("id")) != "").select("file", "type_id", "ord", x("id").alias("base"), access(x("access")).alias("access"), flag(x("is_virtual")).alias("is_virtual"))
    members = inner("members").where(text(x("name")) != "").select("file", "type_id", "ord", x("name"), F.coalesce(x("type"), F.lit("?")).alias("type"), access(x("access")).alias("access"), flag(x("is_static")).alias("is_static"), *placed(x("source_location")))
    methods = inner("methods").where(text(x("name")) != "").select(
        "file", "type_id", "ord", x("name"), F.coalesce(x("display_name"), x("name")).alias("display_name"), text(x("type")).alias("returns"),
        F.coalesce(F.size(x("parameters")), F.lit(0)).cast("long").alias("n_params"), F.coalesce(F.transform(x("parameters"), lambda p: text(p["type"])), F.array().cast("array<string>")).alias("params"),
        access(x("access")).alias("access"), *(flag(x(f)).alias({"is_pure_virtual": "is_pure"}.get(f, f)) for f in _FLAGS), x("name").startswith("~").alias("is_destructor"), *placed(x("source_location")),
    )
    rows = read.select("file", F.posexplode("d.relationships").alias("ord", "r"))
    r = lambda c: F.col(f"r.{c}")
    relations = rows.where((text(r("source")) != "") & (text(r("destination")) != "")).select("file", r("source").alias("src"), r("destination").alias("dst"), relation_kind(r("type")).alias("kind"), F.when(r("access").isNotNull(), access(r("access"))).alias("access"), F.nullif(r("label"), F.lit("")).alias("label"), "ord")
    return Diagram(types, bases, members, methods, relations)
