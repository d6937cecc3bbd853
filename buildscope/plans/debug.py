"""Listings of disassemblers and debug information (SRC11, SRC15, F11, M34), made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import debug as D
from .registry import pick, query, spread, sql_pick
from .texts import lined, through_files


def place(at):
    return F.format_string("0x%08x", at)


def listing(t):
    """A record, a chain of type names, an array, a pointer and base types a part, in three files."""
    k = F.col("p_partkey")
    base = k * 128
    at = lambda n: place(base + n)
    entry = lambda n, indent, tag: F.concat(at(n), F.lit(":" + " " * indent + "DW_TAG_" + tag))
    value = lambda name, text: F.concat(F.lit(f"                DW_AT_{name}\t("), text, F.lit(")"))
    name = lambda c, text: value(c, F.concat(F.lit('"'), F.lit(text) if isinstance(text, str) else text, F.lit('"')))
    typed = lambda n, text: value("type", F.concat(at(n), F.lit(' "'), F.lit(text), F.lit('"')))
    null = lambda n, indent: F.concat(at(n), F.lit(":" + " " * indent + "NULL"))
    chain = F.when(k % 4 == 3, value("type", F.concat(place(base + 40 - 384), F.lit(' "far"')))).otherwise(typed(72, "base"))
    texts = [
        F.when(k < 3, F.lit("0x00000000: Compile Unit: length = 0x00000020, version = 0x0005, addr_size = 0x08")),
        F.when(k < 3, F.lit("0x00000001: DW_TAG_compile_unit")),
        entry(8, 3, "structure_type"), name("name", F.concat(F.lit("S"), k)), value("byte_size", F.lit("0x28")),
        F.when(k % 6 == 5, value("declaration", F.lit("true"))),
        entry(16, 5, "member"), name("name", F.lit("a")), typed(40, "T"), value("data_member_location", F.lit("0x00")),
        entry(24, 5, "member"), name("name", F.lit("b")), typed(48, "T[3]"), value("data_member_location", F.lit("0x08")),
        entry(28, 5, "member"), name("name", F.lit("p")), typed(64, "T *"), value("data_member_location", F.lit("0x18")),
        entry(30, 5, "member"), name("name", F.lit("shared")), typed(40, "T"),
        null(32, 5), value("name", F.lit('"lost"')),
        entry(40, 3, "typedef"), name("name", F.lit("T")), chain,
        entry(48, 3, "array_type"), typed(40, "T"), entry(52, 5, "subrange_type"), value("upper_bound", F.lit("0x02")), null(56, 5),
        entry(64, 3, "pointer_type"), typed(8, "S"),
        entry(72, 3, "base_type"), value("byte_size", F.concat(F.lit("0x0"), F.pow(F.lit(2), k % 4).cast("int"))),
    ]
    rows = F.array(*(F.struct((k * 64 + i).alias("line_no"), x.alias("line")) for i, x in enumerate(texts)))
    return through_files(spread(t.part).select(F.concat(F.lit("u"), k % 3).alias("file"), F.explode(rows).alias("l")).select("file", "l.*").where("line is not null"))


# The size of the type T of a part: that of its base type, or of the part three before it in the same file.
SIZED = "with p as (select p_partkey k, 'u' || p_partkey % 3 as file, p_partkey * 128 as base, case when p_partkey % 4 = 3 then 1 else (2 ** (p_partkey % 4))::bigint end as s from part)"


@query(
    "SRC15_entries",
    "with p as (select p_partkey k, 'u' || p_partkey % 3 as file, p_partkey * 128 as base from part) select file, 1::bigint as entry, 'DW_TAG_compile_unit' as tag, 0::bigint as depth, null::bigint as parent from p where k < 3"
    + "".join(f" union all select file, base + {n}, 'DW_TAG_{tag}', {depth}, {parent} from p" for n, tag, depth, parent in ((8, "structure_type", 1, "1"), (16, "member", 2, "base + 8"), (24, "member", 2, "base + 8"), (28, "member", 2, "base + 8"), (30, "member", 2, "base + 8"), (40, "typedef", 1, "1"), (48, "array_type", 1, "1"), (52, "subrange_type", 2, "base + 48"), (64, "pointer_type", 1, "1"), (72, "base_type", 1, "1"))),
)
def src15(t):
    return D.entries(listing(t)).select("file", "entry", "tag", "depth", "parent")


@query("SRC15_records", SIZED + " select file, 'S' || k as name, 'struct' as kind, 40::bigint as size_of, s + 3 * s + 8 as sum_members, case when s = 8 then 0 else 1 end + case when 8 + 3 * s < 24 then 1 else 0 end as holes, 8 - s + 24 - (8 + 3 * s) as sum_holes, 8::bigint as padding from p where k % 6 < 5")
def src15_records(t):
    return D.observed(listing(t))[0]


@query(
    "SRC15_members",
    SIZED + "".join(f"{' union all' if i else ''} select file, 'S' || k as record, {i}::bigint as pos, '{n}' as name, '{ty}' as type, {at}::bigint as \"offset\", {size} as size, {gap} as hole_after from p where k % 6 < 5" for i, (n, ty, at, size, gap) in enumerate((("a", "T", 0, "s", "8 - s"), ("b", "T[3]", 8, "3 * s", "16 - 3 * s"), ("p", "T *", 24, "8", "null")))),
)
def src15_members(t):
    return D.observed(listing(t))[1].select("file", "record", "pos", "name", "type", "offset", "size", "hole_after")


@query("SRC15_declared", SIZED + " select file, 'S' || k as name from p where k % 6 = 5")
def src15_declared(t):
    return D.observed(listing(t))[2]


def code(t):
    """Functions of a few instructions, a part each, with places and source text between them, in three files."""
    k = F.col("p_partkey")
    at = lambda n: F.format_string("%08x", k * 64 + n)
    insn = lambda n, raw, text: F.concat(F.lit("   "), F.format_string("%x", k * 64 + n), F.lit(f":\t{raw}      \t"), text)
    return lined(
        t.part,
        k,
        F.when(k % 5 == 0, F.lit("Disassembly of section .text:")),
        F.concat(at(0), F.lit(" <fn"), k, F.lit(">:")),
        F.when(k % 2 == 0, F.concat(F.lit("fn"), k, F.lit("():"))),
        F.when(k % 2 == 0, F.concat(F.lit("../src/f"), k % 7, F.lit(".c:"), k % 9)),
        F.when(k % 2 == 0, F.lit("  int x = 1;  ")),
        insn(0, "b530", pick(k, ("push\t{r4, lr}", "ldr.w\tr0, [r1, #4]\t; note", "beq.n\t8 <x>", "movs\tr0, #1"))),
        F.lit("   plain text"),
        F.lit("      ..."),
        F.concat(F.lit("  "), F.format_string("%x", k * 64 + 2), F.lit(":  b5 30    str  r0, [sp, #4]")),
        F.when(k % 3 > 0, F.lit("")),
        F.when(k % 3 > 0, F.lit("more text")),
        F.when(k % 2 == 0, F.lit("src/other.h")),
        insn(4, "4770", F.lit("bx\tlr")),
        file=F.concat(F.lit("l"), k % 3),
    )


MNEMONICS, OPERANDS = ("push", "ldr", "beq", "movs"), ("{r4, lr}", "r0, [r1, #4]", "8 <x>", "r0, #1")


@query(
    "SRC11_disassembly",
    f"""with p as (select p_partkey k, 'l' || p_partkey % 3 as file, p_partkey * 64 as spot, 'fn' || p_partkey as fn, p_partkey % 2 = 0 as even, lag(case when p_partkey % 2 = 0 and p_partkey % 9 > 0 then p_partkey % 9 end ignore nulls) over (partition by p_partkey % 3 order by p_partkey) as before, lag('fn' || p_partkey) over (partition by p_partkey % 3 order by p_partkey) as above from part),
 q as (select *, case when even and k % 9 > 0 then k % 9 else coalesce(before, 0) end as line from p)
 select file, 'blank' as kind, null::bigint as addr, null as mnemonic, null as operands, null::boolean as is_load, null::boolean as is_store, null::boolean as is_branch, null as source, null::bigint as line, above as function, '' as text from q where k % 5 = 0
 union all select file, 'label', spot, null, null, null, null, null, null, null, fn, lower(lpad(to_hex(spot), 8, '0')) || ' <' || fn || '>:' from q
 union all select file, 'func_sig', null, null, null, null, null, null, null, null, fn, fn || '():' from q where even
 union all select file, 'source_loc', null, null, null, null, null, null, '../src/f' || k % 7 || '.c', k % 9, fn, '../src/f' || k % 7 || '.c:' || k % 9 from q where even
 union all select file, 'source_code', null, null, null, null, null, null, null, line, fn, 'int x = 1;' from q where even
 union all select file, 'insn', spot, {sql_pick('k', MNEMONICS)}, {sql_pick('k', OPERANDS)}, k % 4 = 1, k % 4 = 0, k % 4 = 2, null, line, fn, '' from q
 union all select file, 'insn', spot + 2, 'str', 'r0, [sp, #4]', false, true, false, null, line, fn, '' from q
 union all select file, 'blank', null, null, null, null, null, null, null, null, fn, '' from q where k % 3 > 0
 union all select file, 'source_loc', null, null, null, null, null, null, 'src/other.h', 0, fn, 'src/other.h' from q where even
 union all select file, 'insn', spot + 4, 'bx', 'lr', false, false, true, null, line, fn, '' from q""",
)
def src11(t):
    out = D.disassembly(code(t))
    return out.select("file", "kind", "addr", "mnemonic", "operands", "is_load", "is_store", "is_branch", "source", "line", "function", F.when(F.col("kind") == "insn", "").otherwise(F.col("text")).alias("text"))


@query(
    "F11_faults",
    f"""with p as (select p_partkey k, 'l' || p_partkey % 3 as file, p_partkey * 64 as spot from part), x as (select file, spot - spot % 2 as target from (select file, spot + k % 7 as spot from p union all select file, 536870912 + spot + 2 from p union all select file, 1073741824 + spot from p)),
 i as (select k, file, spot as addr, {sql_pick('k', MNEMONICS)} as m, {sql_pick('k', OPERANDS)} as o, k % 4 = 1 as l, k % 4 = 0 as s, k % 4 = 2 as b, false as recent from p union all select k, file, spot + 2, 'str', 'r0, [sp, #4]', false, true, false, k % 4 = 2 from p union all select k, file, spot + 4, 'bx', 'lr', false, false, true, k % 4 = 2 and (k % 3 = 0 or k % 2 > 0) from p),
 j as (select distinct x.target, x.file, arg_max((i.addr, m, 'fn' || k, o, l, s, b), i.addr) over (partition by x.file, x.target) as i from x left join i on i.file = x.file and i.addr <= x.target),
 n as (select *, count(*) over (partition by file) as c from j), r as (select target, file, i[1] addr, i[2] m, i[3] as fn, i[4] o, i[5] l, i[6] s, i[7] b from n)
 select file, target, addr, m as mnemonic, fn as function, case when target < 256 and (l or s) then 'null_deref' when target < 256 and b then 'bad_branch' when s and target < 268435456 then 'write_to_flash' when (l or s) and target >= 1073741824 and target < 3758096384 then 'peripheral_access' when b and m in ('bx', 'blx') then 'bad_branch' when m in ('ldr', 'str') and target % 4 <> 0 then 'unaligned_access' when target >= 536870912 and target < 1073741824 and (select recent from i where i.file = r.file and i.addr = r.addr) then 'iaccviol' when (l or s) and contains(o, 'sp,') or contains(o, '[sp') then 'stack_overflow' end as fault from r""",
)
def f11(t):
    k = F.col("p_partkey")
    file = F.concat(F.lit("l"), k % 3).alias("file")
    targets = t.part.select(file, F.explode(F.array(k * 64 + k % 7, k * 64 + 536870914, k * 64 + 1073741824)).alias("target"))
    return D.faults(D.disassembly(code(t)), targets).drop("confidence")


@query(
    "M34_sources",
    """with f as (select distinct case p_partkey % 4 when 0 then '/build/x' || p_partkey || '.c' when 1 then '/proj/f' || p_partkey || '.c' when 2 then '/proj/src/mod/f' || p_partkey || '.c' else '/proj/.git/f' || p_partkey || '.c' end as path from part union select '/proj/deep/er/f' || p_partkey || '.c' from part where p_partkey % 5 < 2 union select '/proj/zeep/er/f' || p_partkey || '.c' from part where p_partkey % 5 = 1),
 s as (select case p_partkey % 4 when 0 then '/build/x' || p_partkey || '.c' when 1 then 'C:\\w\\lib\\f' || p_partkey || '.c' when 2 then '/home/me/src/mod/f' || p_partkey || '.c' else '../f' || p_partkey || '.c' end as source, p_partkey k from part)
 select source, case k % 4 when 0 then source when 1 then '/proj/f' || k || '.c' when 2 then '/proj/src/mod/f' || k || '.c' else case when k % 5 < 2 then '/proj/deep/er/f' || k || '.c' end end as path from s""",
)
def m34(t):
    k = F.col("p_partkey")
    named = lambda before, c=k: F.concat(F.lit(before), c, F.lit(".c"))
    by = lambda *c: F.when(k % 4 == 0, c[0]).when(k % 4 == 1, c[1]).when(k % 4 == 2, c[2]).otherwise(c[3])
    files = t.part.select(by(named("/build/x"), named("/proj/f"), named("/proj/src/mod/f"), named("/proj/.git/f")).alias("path"))
    files = files.unionByName(t.part.where("p_partkey % 5 < 2").select(named("/proj/deep/er/f").alias("path"))).unionByName(t.part.where("p_partkey % 5 = 1").select(named("/proj/zeep/er/f").alias("path")))
    places = t.part.select(by(named("/build/x"), named("C:\\w\\lib\\f"), named("/home/me/src/mod/f"), named("../f")).alias("source"))
    return D.resolved_sources(places, files, "/proj/")
