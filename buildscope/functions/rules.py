"""Classification and formatting rules as Columns. All stay in generated code; none needs Python rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, patterns and numbers below must be these for the results to agree.

#: F5. Categories of mangled names, the first that fits.
ABI = (
    ("vtable", "^_ZTV"),
    ("vtt", "^_ZTT"),
    ("typeinfo", "^_ZTI"),
    ("typeinfo_name", "^_ZTS"),
    ("thunk", "^_ZT[chv]"),
    ("guard", "^_ZGV"),
    ("cxa_runtime", "^__cxa_"),
    ("operator_new", "^_Znw|^_Zna"),
    ("operator_del", "^_Zdl|^_Zda"),
    ("ctor", "^_ZN.*C[12]E"),
    ("dtor", "^_ZN.*D[012]E"),
    ("member_fn", "^_ZN"),
    ("namespace_fn", "^_ZL"),
    ("global_fn", "^_Z[^TNLG]"),
)

#: F6. Classes of section names for the families of targets, the first prefix that fits.
ARM_SECTIONS = (
    (".text", "flash"), (".rodata", "flash"), (".init", "flash"), (".fini", "flash"), (".itcm_text", "flash"), (".pflash", "flash"),
    (".ARM", "flash"), (".preinit_array", "flash"), (".init_array", "flash"), (".fini_array", "flash"),
    (".data", "both"), (".mcal_data", "both"), (".ramcode", "both"), (".sram_data", "both"), (".dtcm_data", "both"),
    (".bss", "ram"), (".mcal_bss", "ram"), (".dtcm_bss", "ram"), (".sram_bss", "ram"), (".non_cacheable", "ram"), (".heap", "ram"), (".stack", "ram"),
    (".mcal_const", "flash"), (".mcal_const_cfg", "flash"), (".mcal_shared", "ram"), (".shareable", "ram"), (".standby", "ram"), (".int_vector", "ram"), (".int_results", "ram"),
)
ESP32_CLASSES = (
    (".flash.text", "flash"), (".flash.rodata", "flash"), (".flash.appdesc", "flash"), (".flash_rodata_dummy", "flash"), (".flash.rodata_noload", "flash"),
    (".iram0.text", "both"), (".iram0.vectors", "both"), (".dram0.data", "both"), (".dram0.bss", "ram"), (".dram0.dummy", "ignore"), (".noinit", "ram"),
    (".rtc.text", "both"), (".rtc.force_fast", "both"), (".rtc.data", "both"), (".rtc.bss", "ram"), (".rtc_noinit", "ram"), (".rtc_reserved", "ram"), (".rtc.force_slow", "both"),
    (".ext_ram.dummy", "ignore"), (".ext_ram", "ram"), (".iram0.data", "both"), (".iram0.bss", "ram"), (".iram0.text_end", "ignore"), (".dram0.heap_start", "ignore"),
    (".debug", "ignore"), (".xtensa", "ignore"), (".xt.", "ignore"), (".comment", "ignore"),
)
X86_CLASSES = (
    (".text", "flash"), (".init", "flash"), (".fini", "flash"), (".plt", "flash"), (".plt.got", "flash"), (".plt.sec", "flash"), (".rodata", "flash"), (".rodata.str", "flash"),
    (".eh_frame", "flash"), (".eh_frame_hdr", "flash"), (".gcc_except_table", "flash"), (".init_array", "flash"), (".fini_array", "flash"), (".preinit_array", "flash"),
    (".data", "both"), (".data.rel.ro", "both"), (".got", "both"), (".got.plt", "both"), (".tdata", "both"), (".bss", "ram"), (".tbss", "ram"),
    (".note.ABI-tag", "ignore"), (".note.gnu.build-id", "ignore"), (".gnu.version", "ignore"), (".gnu.version_r", "ignore"), (".gnu.hash", "ignore"), (".dynsym", "ignore"),
    (".dynstr", "ignore"), (".rela.dyn", "ignore"), (".rela.plt", "ignore"), (".dynamic", "ignore"), (".interp", "ignore"), (".comment", "ignore"),
)
IGNORED_SECTIONS = (".debug", ".comment", ".xtensa", ".xt.", ".zdebug")

#: F7. Names of interrupt handlers: those of a family, and those of any.
ARM_ISR = (
    "^(NMI|HardFault|MemManage|BusFault|UsageFault|SVC|DebugMon|PendSV|SysTick)_Handler$",
    "^.+_IRQHandler$",
    "^vPort.+ISR$",
    "^xPortSysTickHandler$",
    "^HAL_.+IRQHandler$",
    "^.+[_-](?:ISR|isr|irq|IRQ|interrupt|Interrupt)$",
    "^(?:ISR|isr)_.+$",
)
ANY_ISR = ("^.+_IRQHandler$", "^.+(?:_isr|_ISR|_irq|_IRQ)$", "^(?:isr|ISR)_.+$", "^(?:NMI|HardFault|SysTick|PendSV|SVC)_Handler$")

#: F8. Classes of handlers by a part of the lower-cased name.
PRIORITIES = (
    ("fault", ("hardfault", "busfault", "memmanage", "usagefault")),
    ("nmi", ("nmi",)),
    ("system", ("systick", "pendsv", "svc")),
    ("peripheral", ("tim", "uart", "spi", "i2c", "can", "adc", "dma", "eth", "usb", "exti", "gpio", "intr")),
)

#: F9. Bytes an instruction and cycles an instruction.
DENSITY = {"arm": (3.0, 1.5), "esp32-xtensa": (3.5, 2.0), "esp32-riscv": (3.5, 1.5), "x86-64": (4.5, 1.3), "x86-32": (4.0, 1.5)}

#: F10. Functions that a handler should not call: category and severity.
HAZARDS = {
    "malloc": ("heap", "error"), "free": ("heap", "error"), "calloc": ("heap", "error"), "realloc": ("heap", "error"), "pvPortMalloc": ("heap", "error"), "vPortFree": ("heap", "error"),
    "xSemaphoreTake": ("rtos", "error"), "xQueueReceive": ("rtos", "error"), "xQueueSend": ("rtos", "warn"), "osMutexAcquire": ("rtos", "error"), "vTaskDelay": ("rtos", "error"),
    "vTaskDelayUntil": ("rtos", "error"), "osDelay": ("rtos", "error"), "ulTaskNotifyTake": ("rtos", "warn"),
    "printf": ("io", "warn"), "fprintf": ("io", "warn"), "sprintf": ("io", "warn"), "puts": ("io", "warn"), "fwrite": ("io", "warn"),
    "HAL_Delay": ("delay", "error"), "__errno_location": ("tls", "info"),
}
HAZARD_PREFIXES = ("pvPortMalloc", "vPortFree", "xQueue", "xSemaphore", "ulTask", "xTask", "vTask", "osQueue", "osMutex")
ISR_SAFE = ("FromISR", "_ISR", "ISR", "FROMISR")

#: F12. How certain a resolved call is.
CERTAINTY = {"exact": "certain", "devirtualised": "certain", "observed": "certain", "cha": "bounded", "rta": "bounded", "fn_ptr": "unknown", "unresolved": "unknown"}

#: F17, F18. Kinds of notes that come up again, and after how many days.
SCHEDULED, INTERVALS = ("wtf", "quirk", "idiom", "learned"), (7, 30, 90)

#: F20. Labels of conditions, the first that fits.
CONDITIONS = (
    ("Bounds check", r"^\(?\s*[\w.\->]+\s*(<|<=)\s*[\w.\->]+\s*\)?$"),
    ("Null check", r"(==|!=)\s*(NULL|nullptr)|^\(?\s*!\s*\w+\s*\)?$"),
    ("Error check", r"(?i)^\(?\s*(ret|rc|result|status|err|error)\w*\s*(<|==|!=)\s*-?\d"),
)

#: U3. Section names that tell a family of targets.
ESP32_SECTIONS = (".flash.text", ".flash.rodata", ".iram0.text", ".dram0.data", ".dram0.bss", ".iram0.vectors", ".rtc.text", ".dram0.dummy")
ARM_HINTS = (".non_cacheable_data", ".non_cacheable_bss", ".dtcm_data", ".mcal_data", ".int_vector", ".int_results")
X86_SECTIONS = (".plt", ".got", ".got.plt", ".dynamic", ".interp", ".rela.dyn", ".rela.plt", ".dynsym", ".eh_frame_hdr", ".gcc_except_table", ".data.rel.ro")

#: A24. Sections of exception tables (by prefix) and of dynamic linking (by name).
EXCEPTION_SECTIONS = (".eh_frame", ".eh_frame_hdr", ".gcc_except_table", ".ARM.exidx", ".ARM.extab", ".except_table")
DYNAMIC_SECTIONS = (".plt", ".got", ".got.plt", ".plt.got", ".plt.sec", ".rela.plt", ".rela.dyn", ".dynamic", ".dynsym", ".dynstr", ".interp", ".gnu.version")

#: M1. Parts of names of buffers that hardware may write.
DMA_WORDS = ("buf", "buffer", "frame", "ipc", "spi", "dma", "rx", "tx", "fifo", "packet", "msg", "transfer")

#: M5. Sections with handlers, and parts of section names that tell vectors and fast memory.
VECTOR_SECTIONS = (".isr_vector", ".vectors", ".int_vector", ".interrupts", ".ARM.excep", ".exception_handlers", "EXCEPTIONS", ".iram0.vectors", ".init_array")
FAST_SECTIONS = (".itcm", ".itcm_code", ".ramcode", ".fastcode", ".iram0.text", ".iram.text", ".iram0.bss")

# End of the fixed values.


def first_match(value: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The class of the first (class, pattern) that is found in value; null if none is."""
    out = F.when(value.rlike(rules[0][1]), rules[0][0])
    for name, pattern in rules[1:]:
        out = out.when(value.rlike(pattern), name)
    return out


def any_of(value: Column, parts: Sequence[str]) -> Column:
    """Whether value contains any of the parts."""
    return reduce(lambda a, b: a | b, (value.contains(p) for p in parts))


def any_prefix(value: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (value.startswith(p) for p in parts))


def pressure(used: Column, length: Column) -> Column:
    """error above 95 % of a region, warn above 80 %; null otherwise and for a region without length."""
    share = F.try_divide(used, length)
    return F.when(length > 0, F.when(share > 0.95, "error").when(share > 0.80, "warn"))


def abi_category(name: Column) -> Column:
    """null for a name that is not mangled."""
    return F.when(name.startswith("_Z") | name.startswith("__Z"), F.coalesce(first_match(name, ABI), F.lit("global_fn")))


def section_class(name: Column, rules: Sequence[tuple[str, str]] = ARM_SECTIONS, ignored: Sequence[str] = IGNORED_SECTIONS) -> Column:
    """class of the first prefix, else `ignore` for an ignored one, else null."""
    out = F.when(name.startswith(rules[0][0]), rules[0][1])
    for prefix, kind in rules[1:]:
        out = out.when(name.startswith(prefix), kind)
    return out.when(any_prefix(name, ignored), "ignore")


def is_isr(name: Column, patterns: Sequence[str] = ARM_ISR) -> Column:
    """patterns of a family and those of any."""
    return reduce(lambda a, b: a | b, (name.rlike(p) for p in dict.fromkeys((*patterns, *ANY_ISR))))


def priority(name: Column) -> Column:
    """F8."""
    low = F.lower(name)
    out = F.when(any_of(low, PRIORITIES[0][1]), PRIORITIES[0][0])
    for kind, parts in PRIORITIES[1:]:
        out = out.when(any_of(low, parts), kind)
    return out.otherwise("unknown")


def cycles(size: Column, arch: str = "arm") -> Column:
    """null for no bytes; halves go to the even number."""
    density, each = DENSITY.get(arch, (4.0, 1.5))
    return F.when(size != 0, F.bround(size / F.lit(density) * F.lit(each), 0).cast("long"))


def hazard(name: Column) -> Column:
    """struct (category, severity) of a call from a handler; null if it is harmless."""
    pair = lambda c, s: F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"))
    out = None
    for kind in dict.fromkeys(HAZARDS.values()):
        is_ = name.isin([n for n, k in HAZARDS.items() if k == kind])
        out = F.when(is_, pair(*kind)) if out is None else out.when(is_, pair(*kind))
    return out.when(any_prefix(name, HAZARD_PREFIXES) & ~any_of(name, ISR_SAFE), pair("rtos", "warn"))


def looked_up(value: Column, table: Mapping[str, str]) -> Column:
    """the table's entry; null if there is none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), value)


def next_revisit(kind: Column, confidence: Column, now: Column) -> Column:
    """null for an unscheduled kind and past the last interval."""
    return F.when(kind.isin(*SCHEDULED), F.date_add(now, F.try_element_at(F.array(*map(F.lit, INTERVALS)), confidence.cast("int") + 1)))


def review(kind: Column, confidence: Column, outcome: Column, now: Column) -> dict[str, Column]:
    """kind, confidence and date after `unclear`, `understood` or `resolved`."""
    kind_ = F.when(outcome == "resolved", F.lit("learned")).otherwise(kind)
    level = F.when(outcome == "understood", confidence + 1).otherwise(F.lit(0))
    return {"kind": kind_, "confidence": level, "revisit_at": next_revisit(kind_, level, now)}


def bare_type(name: Column) -> Column:
    """without qualifiers, pointers and references, blanks collapsed."""
    out = F.regexp_replace(F.regexp_replace(name, r"\b(const|volatile)\b", ""), "[*&]", "")
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f]+", " "))


def condition_label(text: Column) -> Column:
    """null if no rule fits."""
    return first_match(F.trim(text), CONDITIONS)


ESCAPED = {13: r"\r", 10: r"\n", 9: r"\t", 0: r"\0", 92: "\\\\"}


def hex_to_text(hexes: Column) -> Column:
    """blank-separated hex bytes as text in which other than printable ones are escaped."""

    def one(token):
        v = F.conv(token, 16, 10).cast("int")
        out = F.when(v == 13, F.lit(ESCAPED[13]))
        for byte, text in list(ESCAPED.items())[1:]:
            out = out.when(v == byte, F.lit(text))
        return out.when((v >= 32) & (v < 127), F.char(v)).otherwise(F.concat(F.lit("\\x"), F.lpad(F.upper(F.hex(v)), 2, "0")))

    return F.array_join(F.transform(F.filter(F.split(F.trim(hexes), r"\s+"), lambda t: t.rlike("^[0-9a-fA-F]+")), one), "")


def text_to_hex(text: Column) -> Column:
    """F21, back: every escape that is known is its byte, any other character its code's low byte."""

    def one(token):
        out = F.when(token.rlike(r"^\\x[0-9a-fA-F]{2}$"), F.upper(F.substring(token, 3, 2)))
        for byte, escape in ESCAPED.items():
            out = out.when(token == F.lit(escape), F.lit(f"{byte:02X}"))
        return out.otherwise(F.lpad(F.hex(F.ascii(token).bitwiseAND(F.lit(255))), 2, "0"))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)\\x[0-9a-fA-F]{2}|\\[rnt0\\]|."), F.lit(0)), one), " ")


def captured_number(raw: Column, kind: str = "number") -> Column:
    """a captured number, or hex digits, as a finite double; null otherwise."""
    if kind == "hex":
        digits = F.regexp_replace(raw, "^0[xX]", "")
        return F.when(digits.rlike("^[0-9a-fA-F]+$"), F.conv(digits, 16, 10).cast("double"))
    value = raw.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def padding(size: Column, data: Column) -> Column:
    """F24."""
    return F.greatest(F.lit(0), size - data)


def waste_severity(tail: Column, size: Column) -> Column:
    """null without tail padding, trap from 25 % on, else new."""
    return F.when(tail > 0, F.when(F.floor(F.try_divide(tail, size) * 100 + 0.5) >= 25, "trap").otherwise("new"))


def confidence(mode: Column, ratio: Column) -> Column:
    """F25, for a machine found by `switch`, `if`, `table` or not at all."""
    return F.when(mode == "switch", F.least(F.lit(0.95), 0.5 + 0.5 * ratio)).when(mode == "if", F.least(F.lit(0.85), 0.35 + 0.5 * ratio)).when(mode == "table", F.lit(0.6)).otherwise(F.lit(0.15))


def confidence_band(value: Column) -> Column:
    """M26."""
    return F.when(value >= 0.7, "high").when(value >= 0.4, "medium").otherwise("low")


def label(text: Column, most: int = 60) -> Column:
    """on one line, cut to so many characters."""
    one = F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most - 1), F.lit("…"))).otherwise(one)


def channels(values: Column) -> Column:
    """whole numbers of 1 to 64, each once and in order; [1] if none is left and [1, 2, 3, 4] for null."""
    own = F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("long")), lambda v: v.between(1, 64))))
    return F.when(values.isNull(), F.array(*(F.lit(i).cast("long") for i in (1, 2, 3, 4)))).when(F.size(own) == 0, F.array(F.lit(1).cast("long"))).otherwise(own)


def clamped(value: Column, low: int, high: int, default: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value, F.lit(default))))


def content_hash(text: Column, digits: int = 16) -> Column:
    """the first hex digits of the SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)


def target_family(esp32: Column, arm: Column, x86: Column) -> Column:
    """From how many section names of each family there are."""
    return F.when((esp32 > arm) & (esp32 > x86), "esp32").when(x86 >= 2, "x86-64").otherwise("arm")
