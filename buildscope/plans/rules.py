"""Scalar rules, filters and projections (F, FIL, PRJ, parts of M and X) on names made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scalars as S
from ..operators import core as O
from .registry import n_rows, pick, query, sql_pick

MANGLED = ("_ZTV4Base", "_ZTT4Base", "_ZTI4Base", "_ZTS4Base", "_ZThn8_N1A1fEv", "_ZGVZ1fvE1x", "__cxa_throw", "_Znwm", "_ZdlPv", "_ZN1AC1Ev", "_ZN1AD0Ev", "_ZN1A1fEv", "_ZL4initv", "_Z3foov", "main", "__Z3barv", "_ZN2ns3runEi")


def sql_first(value: str, rules, other: str = "null") -> str:
    """CASE over (class, pattern)."""
    return "case " + " ".join(f"when regexp_matches({value}, '{p}') then '{n}'" for n, p in rules) + f" else {other} end"


def sql_prefix(value: str, rules, other: str = "null") -> str:
    return "case " + " ".join(f"when starts_with({value}, '{p}') then '{n}'" for p, n in rules) + f" else {other} end"


def sql_any(value: str, parts, f: str = "contains") -> str:
    return "(" + " or ".join(f"{f}({value}, '{p}')" for p in parts) + ")"


@query("F3_pressure", "select o_orderkey, case when n > 0 then case when used / n > 0.95 then 'error' when used / n > 0.80 then 'warn' end end as level from (select o_orderkey, o_totalprice used, case when o_orderkey % 10 = 0 then 0.0 else 500000.0 end n from orders)")
def f3(t):
    return t.orders.select("o_orderkey", R.pressure(F.col("o_totalprice"), F.when(F.col("o_orderkey") % 10 == 0, 0.0).otherwise(500000.0)).alias("level"))


@query("F5_abi_category", f"with s as (select p_partkey, {sql_pick('p_partkey', MANGLED)} as name from part) select p_partkey, case when starts_with(name, '_Z') or starts_with(name, '__Z') then {sql_first('name', R.ABI, repr('global_fn'))} end as category from s")
def f5(t):
    return t.part.select("p_partkey", R.abi_category(pick(F.col("p_partkey"), MANGLED)).alias("category"))


SECTIONS = (".text", ".text.main", ".rodata.str", ".data", ".bss.big", ".debug_info", ".mystery", ".mcal_const_cfg", ".ARM.exidx", ".comment", ".zdebug_line", ".int_vector", ".plt", ".eh_frame_hdr", ".noinit")


@query("F6_section_class", f"with s as (select p_partkey, {sql_pick('p_partkey', SECTIONS)} as name from part) select p_partkey, {sql_prefix('name', [*R.ARM_SECTIONS, *((p, 'ignore') for p in R.IGNORED_SECTIONS)])} as class from s")
def f6(t):
    return t.part.select("p_partkey", R.section_class(pick(F.col("p_partkey"), SECTIONS)).alias("class"))


# Section names of the other families, and the class that each must get.
ESP32_EXPECTED = ((".flash.text", "flash"), (".flash.rodata_noload", "flash"), (".iram0.text_end", "both"), (".dram0.bss", "ram"), (".dram0.dummy", "ignore"), (".rtc.force_slow", "both"), (".ext_ram.dummy", "ignore"), (".ext_ram.bss", "ram"), (".zdebug_info", "ignore"), (".text", None), (".dram0.heap_start", "ignore"), (".noinit", "ram"))
X86_EXPECTED = ((".text.unlikely", "flash"), (".plt.sec", "flash"), (".data.rel.ro", "both"), (".got.plt", "both"), (".tbss", "ram"), (".bss", "ram"), (".gnu.hash", "ignore"), (".gnu.version_r", "ignore"), (".rela.plt", "ignore"), (".xt.lit", "ignore"), (".mystery", None), (".eh_frame_hdr", "flash"))


def _classes(expected):
    return f"select p_partkey, case p_partkey % {len(expected)}" + "".join(f" when {i} then '{c}'" for i, (_, c) in enumerate(expected) if c) + " end as class from part"


@query("F6_section_class_esp32", _classes(ESP32_EXPECTED))
def f6_esp32(t):
    return t.part.select("p_partkey", R.section_class(pick(F.col("p_partkey"), [n for n, _ in ESP32_EXPECTED]), R.ESP32_CLASSES).alias("class"))


@query("F6_section_class_x86", _classes(X86_EXPECTED))
def f6_x86(t):
    return t.part.select("p_partkey", R.section_class(pick(F.col("p_partkey"), [n for n, _ in X86_EXPECTED]), R.X86_CLASSES).alias("class"))


HANDLERS = ("NMI_Handler", "HardFault_Handler", "USART1_IRQHandler", "vPortSVCISR", "xPortSysTickHandler", "HAL_UART_IRQHandler", "my_isr", "tim-irq", "isr_main", "main", "IRQHandler", "SysTick_Handler", "Widget_interrupt", "PendSV_Handler2", "dma_copy")


@query("F7_isr_names", f"with s as (select p_partkey, {sql_pick('p_partkey', HANDLERS)} as name from part) select p_partkey, name, " + " or ".join(f"regexp_matches(name, '{p}')" for p in (*R.ARM_ISR, *R.ANY_ISR)) + " as is_isr from s")
def f7(t):
    name = pick(F.col("p_partkey"), HANDLERS)
    return t.part.select("p_partkey", name.alias("name"), R.is_isr(name).alias("is_isr"))


@query("F8_priority", f"with s as (select p_partkey, lower({sql_pick('p_partkey', HANDLERS)}) as name from part) select p_partkey, case " + " ".join(f"when {sql_any('name', parts)} then '{k}'" for k, parts in R.PRIORITIES) + " else 'unknown' end as priority from s")
def f8(t):
    return t.part.select("p_partkey", R.priority(pick(F.col("p_partkey"), HANDLERS)).alias("priority"))


CALLED = ("malloc", "xQueueSendFromISR", "xQueuePeek", "printf", "HAL_Delay", "memcpy", "osMutexAcquire", "osMutexNew", "vTaskDelay", "vTaskNotifyGiveFromISR", "__errno_location", "ulTaskNotifyTake", "xTaskCreate")


@query("F10_hazards", f"with s as (select p_partkey, {sql_pick('p_partkey', CALLED)} as func from part) select p_partkey, func, case " + " ".join(f"when func = '{n}' then '{c}'" for n, (c, _) in R.HAZARDS.items()) + " else 'rtos' end as category, case " + " ".join(f"when func = '{n}' then '{s}'" for n, (_, s) in R.HAZARDS.items()) + f" else 'warn' end as severity from s where func in ({', '.join(repr(n) for n in R.HAZARDS)}) or ({sql_any('func', R.HAZARD_PREFIXES, 'starts_with')} and not {sql_any('func', R.ISR_SAFE)})")
def f10(t):
    rows = t.part.select("p_partkey", pick(F.col("p_partkey"), CALLED).alias("func"))
    return rows.withColumn("h", R.hazard(F.col("func"))).where("h is not null").select("p_partkey", "func", "h.category", "h.severity")


@query("F9_cycles", "select p_partkey, case when size <> 0 then round_even(size / 3.0 * 1.5, 0)::bigint end as cycles from (select p_partkey, case when p_partkey % 9 = 0 then 0 else p_size end size from part)")
def f9(t):
    return t.part.select("p_partkey", R.cycles(F.when(F.col("p_partkey") % 9 == 0, 0).otherwise(F.col("p_size"))).alias("cycles"))


RESOLUTIONS = (*R.CERTAINTY, "other")


@query("F12_certainty", f"select p_partkey, case {sql_pick('p_partkey', RESOLUTIONS)} " + " ".join(f"when '{k}' then '{v}'" for k, v in R.CERTAINTY.items()) + " end as certainty from part")
def f12(t):
    return t.part.select("p_partkey", R.looked_up(pick(F.col("p_partkey"), RESOLUTIONS), R.CERTAINTY).alias("certainty"))


@query("F14_content_hash", "select doc_id, left(sha256(text), 16) h16, left(sha256(text), 12) h12, left(sha256(text), 8) h8 from documents")
def f14(t):
    return t.documents.select("doc_id", *(R.content_hash(F.col("text"), n).alias(f"h{n}") for n in (16, 12, 8)))


@query("F16_human_size", "select p_partkey, case when n >= 1048576 then printf('%.2f MB', n / 1048576) when n >= 1024 then printf('%.1f KB', n / 1024) else printf('%d B', n::bigint) end as size from (select p_partkey, (p_partkey * 7919 + 13)::double n from part)")
def f16(t):
    return t.part.select("p_partkey", S.human_size((F.col("p_partkey") * 7919 + 13).cast("double")).alias("size"))


KINDS, OUTCOMES = ("wtf", "quirk", "idiom", "learned", "decision"), ("unclear", "understood", "resolved")


@query("F18_review", f"""with s as (select o_orderkey, {sql_pick('o_orderkey', KINDS)} kind, o_orderkey // 5 % 4 confidence, {sql_pick('o_orderkey // 7', OUTCOMES)} outcome, o_orderdate::date d from orders),
n as (select o_orderkey, d, case when outcome = 'resolved' then 'learned' else kind end kind, case when outcome = 'understood' then confidence + 1 else 0 end confidence from s)
select o_orderkey, kind, confidence, case when kind <> 'decision' then d + ([7, 30, 90])[confidence + 1]::int end revisit_at from n""")
def f18(t):
    k = F.col("o_orderkey")
    new = R.review(pick(k, KINDS), F.floor(k / 5) % 4, pick(F.floor(k / 7), OUTCOMES), F.to_date("o_orderdate"))
    return t.orders.select("o_orderkey", *(c.alias(n) for n, c in new.items()))


TYPES = ("const char *", "volatile  int", "Foo const&", "unsigned long", "std::vector<const Foo *> &", "constant", "int  *  const *")


@query("F19_bare_type", f"select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace({sql_pick('p_partkey', TYPES)}, '\\b(const|volatile)\\b', '', 'g'), '[*&]', '', 'g'), '\\s+', ' ', 'g')) as name from part")
def f19(t):
    return t.part.select("p_partkey", R.bare_type(pick(F.col("p_partkey"), TYPES)).alias("name"))


TESTS = ("i < n", "(pos <= cap)", "p == NULL", "!ptr", "ret < 0", "status != 0", "a->len < b.size", "x > 3", "p != nullptr && q", "Result == -1", "f(x)")


@query("F20_condition_label", f"select p_partkey, {sql_first('trim(' + sql_pick('p_partkey', TESTS) + ')', R.CONDITIONS)} as label from part")
def f20(t):
    return t.part.select("p_partkey", R.condition_label(pick(F.col("p_partkey"), TESTS)).alias("label"))


@query("F21_hex_codec", r"""with s as (select p_partkey, p_name, p_partkey % 256 b from part)
select p_partkey, p_name || case b when 13 then '\r' when 10 then '\n' when 9 then '\t' when 0 then '\0' when 92 then '\\' else case when b between 32 and 126 then chr(b::int) else printf('\x%02X', b) end end as text,
 regexp_replace(hex(p_name), '(..)', '\1 ', 'g') || printf('%02X', b) as back from s""")
def f21(t):
    own = F.concat(F.regexp_replace(F.hex("p_name"), "(..)", "$1 "), F.lpad(F.hex(F.col("p_partkey") % 256), 2, "0"))
    return t.part.select("p_partkey", R.hex_to_text(own).alias("text")).withColumn("back", R.text_to_hex(F.col("text")))


@query("F22_captured_number", """with s as (select event_id, case event_id % 6 when 0 then value::varchar when 1 then '-.5' when 2 then '3e2' when 3 then 'abc' when 4 then 'NaN' else '0x' || event_id::varchar end raw from events)
select event_id, case when event_id % 6 = 5 then ('0x' || substr(raw, 3))::bigint::double else case when isfinite(try_cast(raw as double)) then try_cast(raw as double) end end as value from s""")
def f22(t):
    k = F.col("event_id")
    raw = F.when(k % 6 == 0, F.col("value").cast("string")).when(k % 6 == 1, "-.5").when(k % 6 == 2, "3e2").when(k % 6 == 3, "abc").when(k % 6 == 4, "NaN").otherwise(F.concat(F.lit("0x"), k))
    return t.events.select("event_id", F.when(k % 6 == 5, R.captured_number(raw, "hex")).otherwise(R.captured_number(raw)).alias("value"))


LAYOUTS = "select p_partkey, p_size::bigint * 4 size, p_size::bigint * 4 - (p_partkey % 13) * 2 + 3 data from part"


def layouts(t):
    size = F.col("p_size").cast("long") * 4
    return t.part.select("p_partkey", "p_brand", size.alias("size"), (size - (F.col("p_partkey") % 13) * 2 + 3).alias("data"))


@query("F23_waste_severity", f"select p_partkey, case when tail > 0 then case when floor(tail / size * 100 + 0.5) >= 25 then 'trap' else 'new' end end as severity from (select p_partkey, size, greatest(0, size - data) tail from ({LAYOUTS}))")
def f23(t):
    return layouts(t).select("p_partkey", R.waste_severity(R.padding(F.col("size"), F.col("data")), F.col("size")).alias("severity"))


@query("F24_tail_padding", f"select p_partkey, greatest(0, size - data) as tail from ({LAYOUTS})")
def f24(t):
    return layouts(t).select("p_partkey", R.padding(F.col("size"), F.col("data")).alias("tail"))


MODES = ("switch", "if", "table", "none")


@query("F25_confidence", f"with s as (select p_partkey, {sql_pick('p_partkey', MODES)} m, p_size / 64.0 r from part), c as (select p_partkey, round(case m when 'switch' then least(0.95::double, 0.5 + 0.5 * r) when 'if' then least(0.85::double, 0.35 + 0.5 * r) when 'table' then 0.6 else 0.15 end::double, 9) confidence from s) select p_partkey, confidence, case when confidence >= 0.7 then 'high' when confidence >= 0.4 then 'medium' else 'low' end as band from c")
def f25(t):
    own = F.round(R.confidence(pick(F.col("p_partkey"), MODES), F.col("p_size") / 64.0), 9)
    return t.part.select("p_partkey", own.alias("confidence"), R.confidence_band(own).alias("band"))


@query("F27_label", "with s as (select page_id, trim(regexp_replace(html, '[ \\t\\n\\r\\f]+', ' ', 'g')) x from pages) select page_id, case when length(x) > 60 then left(x, 59) || '…' else x end as label from s")
def f27(t):
    return t.pages.select("page_id", R.label(F.col("html")).alias("label"))


@query("F28_normalise", """with s as (select o_orderkey, case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then [0.0, 99.5] else [(o_orderkey % 70) + 0.5, (o_custkey % 70)::double, 3.9, -4.2] end::double[] v from orders),
c as (select o_orderkey, v, list_sort(list_distinct(list_filter(list_transform(v, lambda x: trunc(x)::bigint), lambda x: x between 1 and 64))) l from s)
select o_orderkey, array_to_string(case when v is null then [1, 2, 3, 4] when len(l) = 0 then [1] else l end, ',') as channels, greatest(0, least(7, coalesce(case when o_orderkey % 3 = 0 then null else o_orderkey % 20 - 5 end, 0))) as window from c""")
def f28(t):
    k = F.col("o_orderkey")
    values = F.when(k % 5 == 0, None).when(k % 5 == 1, F.array(F.lit(0.0), F.lit(99.5))).otherwise(F.array(k % 70 + F.lit(0.5).cast("double"), (F.col("o_custkey") % 70).cast("double"), F.lit(3.9), F.lit(-4.2)))
    return t.orders.select("o_orderkey", F.array_join(R.channels(values).cast("array<string>"), ",").alias("channels"), R.clamped(F.when(k % 3 != 0, k % 20 - 5), 0, 7, 0).alias("window"))


@query("FIL3_level_category", "select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_quantity > 20 and l_quantity <= 40")
def fil3(t):
    return t.lineitem.where(O.optional(F.col("l_returnflag") == "R", S.severity(F.col("l_quantity"), 20) == "warn")).select("l_orderkey", "l_linenumber")


@query("FIL4_edge_kinds", "select o_orderkey from (select o_orderkey, o_orderstatus, case when o_totalprice > 300000 then true when o_totalprice < 100000 then false end confirmed from orders) where o_orderstatus in ('O', 'P') and (confirmed is null or confirmed)")
def fil4(t):
    confirmed = F.when(F.col("o_totalprice") > 300000, True).when(F.col("o_totalprice") < 100000, False)
    return t.orders.withColumn("confirmed", confirmed).where(O.optional(F.col("o_orderstatus").isin("O", "P"), O.tri_state(F.col("confirmed"), (True, None)))).select("o_orderkey")


@query("FIL5_nodes_to_depth", "select p_partkey from part where p_size > 10 and p_brand <> 'Brand#7' and p_partkey > 0 and floor(log2(p_partkey)) <= 8")
def fil5(t):
    return t.part.where((F.col("p_size") > 10) & (F.col("p_brand") != "Brand#7") & (F.col("p_partkey") > 0)).where(F.floor(F.log2(F.greatest("p_partkey", F.lit(1)))) <= 8).select("p_partkey")


@query("FIL7_due", "with s as (select o_orderkey, case when o_orderkey % 7 = 0 then 'someday' when o_orderkey % 11 = 0 then null else strftime(o_orderdate, '%Y-%m-%d') end r from orders) select o_orderkey, try_cast(r as date) due from s where try_cast(r as date) <= date '1997-06-30'")
def fil7(t):
    k = F.col("o_orderkey")
    at = F.when(k % 7 == 0, "someday").when(k % 11 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", at.try_cast("date").alias("due")).where(F.col("due") <= F.lit("1997-06-30").cast("date"))


@query("FIL8_log_flags", "select event_id from events where event_type in ('click', 'view', 'error')")
def fil8(t):
    on = {"rx": True, "tx": False, "info": True}
    direction = F.when(F.col("event_type").isin("click", "view"), "rx").when(F.col("event_type") == "purchase", "tx").when(F.col("event_type") == "error", "info").otherwise("off")
    return t.events.where(direction.isin([d for d, wanted in on.items() if wanted])).select("event_id")


@query("PRJ1_categories", f"with s as (select p_partkey, {sql_pick('p_partkey', MANGLED)} as name, {sql_pick('p_partkey // 3', SECTIONS)} as section from part) select p_partkey, case when starts_with(name, '_Z') or starts_with(name, '__Z') then {sql_first('name', R.ABI, repr('global_fn'))} else 'c' end as category, coalesce({sql_prefix('section', [*R.ARM_SECTIONS, *((p, 'ignore') for p in R.IGNORED_SECTIONS)])}, 'other') as section_category from s")
def prj1(t):
    return t.part.select("p_partkey", F.coalesce(R.abi_category(pick(F.col("p_partkey"), MANGLED)), F.lit("c")).alias("category"), F.coalesce(R.section_class(pick(F.floor(F.col("p_partkey") / 3), SECTIONS)), F.lit("other")).alias("section_category"))


@query("PRJ2_short_keys", "select c_custkey n, trim(regexp_replace('<!-- generated --> ' || c_name, '<!--[^>]*-->', '', 'g')) p, c_nationkey f from customer")
def prj2(t):
    rows = t.customer.withColumn("c_name", F.concat(F.lit("<!-- generated --> "), "c_name"))
    return O.short_keys(rows, {"c_custkey": "n", "c_name": "p", "c_nationkey": "f"}, marked=["c_name"])


@query("PRJ3_remap_ends", """with e as (select l_suppkey src, l_partkey % 100 dst from lineitem), m as (select s_suppkey a, s_suppkey // 2 b from supplier where s_suppkey % 2 = 1),
r as (select coalesce(x.b, src) src, coalesce(y.b, dst) dst from e left join m x on src = x.a left join m y on dst = y.a) select src, dst, count(*) n from r where src <> dst group by 1, 2""")
def prj3(t):
    edges = t.lineitem.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst"))
    pairs = t.supplier.where("s_suppkey % 2 = 1").select(F.col("s_suppkey").alias("file"), F.floor(F.col("s_suppkey") / 2).cast("long").alias("paired"))
    return O.remap_ends(edges, pairs, "src", "dst", "file", "paired").groupBy("src", "dst").agg(n_rows().alias("n"))


THRESHOLDS = {"A": 5.0, "N": 20.0}


@query("X5_metric_thresholds", "select l_returnflag, case when l_quantity <= 0.75 * m then 'none' when l_quantity <= m then 'info' when l_quantity <= 2 * m then 'warn' else 'error' end severity, count(*) n from (select *, case l_returnflag when 'A' then 5.0 when 'N' then 20.0 else 10.0 end m from lineitem) group by 1, 2")
def x5(t):
    limit = F.when(F.col("l_returnflag") == "A", THRESHOLDS["A"]).when(F.col("l_returnflag") == "N", THRESHOLDS["N"]).otherwise(10.0)
    q = F.col("l_quantity")
    level = F.when(q <= 0.75 * limit, "none").when(q <= limit, "info").when(q <= 2 * limit, "warn").otherwise("error")
    return t.lineitem.groupBy("l_returnflag", level.alias("severity")).agg(n_rows().alias("n"))


@query("X2_extra_patterns", f"with s as (select p_partkey, {sql_pick('p_partkey', HANDLERS)} as name from part) select p_partkey from s where " + " or ".join(f"regexp_matches(name, '{p}')" for p in (*R.ARM_ISR, *R.ANY_ISR, "^dma_")))
def x2(t):
    return t.part.where(R.is_isr(pick(F.col("p_partkey"), HANDLERS), (*R.ARM_ISR, *O.valid_patterns(["^dma_", "(unclosed"])))).select("p_partkey")


@query("X1_user_patterns", "select c_custkey, regexp_matches(c_name, '[0-9]{5}') a, regexp_matches(c_name, '(?i)CUSTOMER#0+1') b, false c from customer")
def x1(t):
    name = F.col("c_name")
    return t.customer.select("c_custkey", O.user_match(name, "[0-9]{5}", "i").alias("a"), O.user_match(name, "CUSTOMER#0+1", "gi").alias("b"), O.user_match(name, "(broken", "i").alias("c"))


@query("X3_target_profile", f"with s as (select p_partkey, {sql_pick('p_partkey', SECTIONS)} as name from part) select p_partkey, name in ('.data', '.bss.big') and name not in ('.bss.big') cacheable, name in ('.bss.big') dma_safe from s")
def x3(t):
    profile = {"cacheable_sections": [".data", ".bss.big"], "dma_safe_sections": [".bss.big"]}
    name = pick(F.col("p_partkey"), SECTIONS)
    safe = name.isin(profile["dma_safe_sections"])
    return t.part.select("p_partkey", (name.isin(profile["cacheable_sections"]) & ~safe).alias("cacheable"), safe.alias("dma_safe"))


@query("X4_vendor_profiles", "select page_id, regexp_matches(url, '/(de|fr)/') excluded from pages")
def x4(t):
    return t.pages.select("page_id", O.any_glob(F.col("url"), ["*/de/*", "*/fr/*"]).alias("excluded"))
