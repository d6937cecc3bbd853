"""Binary files and mangled names (SRC6, F4), made from the driver's tables."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.mangled import artifact
from ..sources import elf
from .registry import pick, query, sql_pick


def image(symbols: list[tuple], wide: bool, little: bool, dynamic: bool = False, sections: tuple = (".text", ".data")) -> bytes:
    """An ELF file with these sections and symbols (name, value, size, info, section index)."""
    o = "<" if little else ">"
    strings, at = bytearray(b"\0"), []
    for name, *_ in symbols:
        at.append(len(strings))
        strings += name.encode() + b"\0"
    table = b"".join(struct.pack(o + "IBBHQQ", k, info, 0, shndx, value, size) if wide else struct.pack(o + "IIIBBH", k, value, size, info, 0, shndx) for k, (_, value, size, info, shndx) in zip(at, symbols, strict=True))
    names, name_at = bytearray(b"\0"), []
    every = [*sections, ".dynsym" if dynamic else ".symtab", ".strtab", ".shstrtab"]
    for n in every:
        name_at.append(len(names))
        names += n.encode() + b"\0"
    head, entry = (64, 64) if wide else (52, 40)
    head = max(head, 64)
    place, rows = head, [(0, 0, 0, 0, 0, 0, 0, 0)]
    for k, n in enumerate(sections):
        rows.append((name_at[k], 1, 6, 0x1000 * (k + 1), head, 16 * (k + 1), 0, 0))
    for n, kind, data, link, size in ((every[-3], 11 if dynamic else 2, table, len(every) - 1, 24 if wide else 16), (".strtab", 3, bytes(strings), 0, 0), (".shstrtab", 3, bytes(names), 0, 0)):
        rows.append((name_at[every.index(n)], kind, 0, 0, place, len(data), link, size))
        place += len(data)
    body = table + bytes(strings) + bytes(names)
    start = head + len(body)
    for name, kind, flags, addr, offset, size, link, ent in rows:
        body += struct.pack(o + ("IIQQQQIIQQ" if wide else "IIIIIIIIII"), name, kind, flags, addr, offset, size, link, 0, 1, ent)
    ident = b"\x7fELF" + bytes([2 if wide else 1, 1 if little else 2, 1]) + bytes(9)
    fixed = struct.pack(o + ("HHIQQQIHHHHHH" if wide else "HHIIIIIHHHHHH"), 2, 40, 1, 0, 0, start, 0, head, 0, 0, entry, len(rows), len(rows) - 1)
    return (ident + fixed).ljust(head, b"\0") + body


def images(t):
    """Files (file, content) of 200 parts each, a symbol a part, in four formats; every fifth file has dynamic symbols only, every seventh is broken."""
    k = F.col("p_partkey")
    part = F.floor(k / 200).cast("int")

    def built(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        n = rows[0]["file"]
        own = [("" if r["k"] % 9 == 8 else f"sym_{r['k']}", 0x8000 + 16 * (r["k"] % 1000), r["size"], (r["k"] % 4) << 4 | r["k"] % 8, (1, 2, 0, 0xFFF1, 0xFFF2)[r["k"] % 5]) for r in rows]
        data = b"no file" if n % 7 == 6 else image(own, n % 2 == 0, n // 2 % 2 == 0, n % 5 == 4)
        return pa.table({"file": pa.array([f"f{n}.elf"]), "content": pa.array([data], pa.binary())})

    rows = t.part.select(part.alias("file"), k.alias("k"), F.col("p_size").cast("long").alias("size"))
    return rows.groupBy("file").applyInArrow(built, "file string, content binary")


IMAGES = "with s as (select p_partkey k, p_partkey // 200 as n, p_size::bigint as size, row_number() over (partition by p_partkey // 200 order by p_partkey) - 1 as place from part)"


@query(
    "SRC6_symbols",
    IMAGES + f" select 'f' || n || '.elf' as file, place, 'sym_' || k as name, 32768 + 16 * (k % 1000) as value, size, {sql_pick('k', (*elf.TYPES, 'other'))} as type, {sql_pick('k', (*elf.BINDINGS, 'other'))} as binding, [1, 2, 0, 65521, 65522][k % 5 + 1] as section_index, case k % 5 when 0 then '.text' when 1 then '.data' end as section from s where n % 7 < 6 and k % 9 < 8",
)
def src6(t):
    return elf.symbols(images(t), size=64)


@query(
    "SRC6_sections",
    IMAGES
    + """, f as (select n, count(*) as c, sum(case when k % 9 = 8 then 1 else length('sym_' || k) + 1 end) + 1 as chars from s group by 1)
 select 'f' || n || '.elf' as file, case when n % 7 < 6 then case when n % 2 = 0 then 64 else 32 end end as class, case when n % 7 < 6 then n // 2 % 2 = 0 end as little_endian, case when n % 7 < 6 then n % 5 = 4 end as stripped, x.index, x.name, case when x.index = 3 then case when n % 2 = 0 then 24 else 16 end * c when x.index = 4 then chars when x.index = 5 then 39 else x.size end as size, case when n % 7 = 6 then 'no ELF file' end as problem
 from f join (values (0, '', 0, 0), (1, '.text', 16, 0), (2, '.data', 32, 0), (3, '.symtab', 0, 1), (3, '.dynsym', 0, 2), (4, '.strtab', 0, 0), (5, '.shstrtab', 0, 0), (null, null, null, 3)) x(index, name, size, w) on (n % 7 < 6 and (w = 0 or (w = 1 and n % 5 < 4) or (w = 2 and n % 5 = 4))) or (n % 7 = 6 and w = 3)""",
)
def src6_sections(t):
    return elf.sections(images(t)).select("file", "class", "little_endian", "stripped", "index", "name", "size", "problem")


# Mangled names with one part's key in them, and what each is: kind, entity, owner, reason, partial.
NAMES = (
    ("_ZTV{n}", "vtable", "{k}", "{k}", None, False),
    ("_ZTIN2ns{n}E", "typeinfo", "ns::{k}", "ns::{k}", None, False),
    ("_ZTS{n}", "typeinfo-name", "{k}", "{k}", None, False),
    ("_ZTT{n}", "vtt", "{k}", "{k}", None, False),
    ("_ZTC{n}0_4Base", "construction-vtable", "{k}", "{k}", None, False),
    ("_ZThn16_N2ns{n}3runEv", "thunk", "ns::{k}::run", "ns::{k}", None, False),
    ("_ZTv0_n24_N{n}D1Ev", "covariant-thunk", "{k}::~{k}", "{k}", None, False),
    ("_ZGVZN{n}3getEvE4inst", "guard-variable", "{k}::get::inst", "{k}::get", None, False),
    ("_ZZN{n}3getEvE4inst", "local-static", "{k}::get::inst", "{k}::get", None, False),
    ("_ZN{n}C2ERKS_", "constructor", "{k}::{k}", "{k}", None, False),
    ("_ZNK{n}IiSt4pairIifEE4sizeEv", "function", "{k}<...>::size", "{k}<...>", None, False),
    ("_Z{n}iPKc", "function", "{k}", None, None, False),
    ("_ZN{n}plES_", "function", "{k}", None, None, True),
    ("__cxa_throw", "runtime-support", "__cxa_throw", None, "throwing", False),
    ("main{k}", "unmangled", "main{k}", None, None, False),
)


def _sql(text, k="'c' || p_partkey"):
    if text is None:
        return "null"
    parts = text.replace("{n}", f"' || length({k}) || {k} || '").replace("{k}", f"' || {k} || '")
    return f"'{parts}'"


_case = lambda i: "case p_partkey % " + str(len(NAMES)) + "".join(f" when {j} then {_sql(n[i])}" for j, n in enumerate(NAMES)) + " end"


@query("F4_artifacts", f"select p_partkey, {_case(1)} as kind, {_case(2)} as entity, {_case(3)} as owner, {_case(4)} as reason, p_partkey % {len(NAMES)} in ({', '.join(str(j) for j, n in enumerate(NAMES) if n[5])}) as partial from part")
def f4(t):
    k = F.concat(F.lit("c"), "p_partkey")
    named = [F.regexp_replace(F.regexp_replace(F.lit(n[0]), r"\{n\}", F.concat(F.length(k), k)), r"\{k\}", k) for n in NAMES]
    name = F.element_at(F.array(*named), (F.col("p_partkey") % len(NAMES) + 1).cast("int"))
    return t.part.select("p_partkey", artifact(name).alias("a")).select("p_partkey", "a.*")
