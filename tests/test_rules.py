"""What each rule says, written out; innermost ranges against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from buildscope.functions import rules as R
from buildscope.operators import located as L


def said(spark, rule, cases):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(cases)], "k int, v string")
    return {v: r for v, r in zip(cases, [r.x for r in rows.select("k", rule(F.col("v")).alias("x")).orderBy("k").collect()])}


ABI = {
    "_ZTV3Foo": "vtable", "_ZTT3Foo": "vtt", "_ZTI3Foo": "typeinfo", "_ZTS3Foo": "typeinfo_name", "_ZThn8_N3FooD0Ev": "thunk", "_ZTv0_n24_N3FooD0Ev": "thunk", "_ZTcv": "thunk", "_ZGVZ3foovE1x": "guard",
    "__cxa_throw": None, "_Znwm": "operator_new", "_Znam": "operator_new", "_ZdlPv": "operator_del", "_ZdaPv": "operator_del", "_ZN3FooC1Ev": "ctor", "_ZN3FooC2Ev": "ctor", "_ZN3FooD0Ev": "dtor",
    "_ZN3Foo3barEv": "member_fn", "_ZL3foov": "namespace_fn", "_Z3foov": "global_fn", "main": None, "__Z3foov": "global_fn",
}
ARM = {".text": "flash", ".rodata.str1": "flash", ".init_array": "flash", ".ARM.exidx": "flash", ".data": "both", ".mcal_data": "both", ".ramcode": "both", ".bss": "ram", ".heap": "ram", ".stack_dummy": "ram", ".mcal_const_cfg": "flash", ".standby": "ram", ".int_vector": "ram", ".debug_line": "ignore", ".comment": "ignore", ".xt.prop": "ignore", ".noinit": None, "text": None}
ISR = {"SysTick_Handler": True, "HardFault_Handler": True, "USART1_IRQHandler": True, "vPortSVCISR": True, "xPortSysTickHandler": True, "HAL_UART_IRQHandler": True, "tim_isr": True, "tim-irq": True, "ISR_main": True, "isr_main": True, "main": False, "Reset_Handler": False, "IRQHandler": False, "interrupt": False}
PRIORITY = {"HardFault_Handler": "fault", "BusFault": "fault", "MemManage_Handler": "fault", "UsageFault_Handler": "fault", "NMI_Handler": "nmi", "SysTick_Handler": "system", "PendSV_Handler": "system", "SVC_Handler": "system", "TIM2_IRQHandler": "peripheral", "DMA1_Channel3": "peripheral", "my_gpio": "peripheral", "main": "unknown"}
HAZARD = {"malloc": ("heap", "error"), "vPortFree": ("heap", "error"), "xQueueReceive": ("rtos", "error"), "xQueueSend": ("rtos", "warn"), "xQueueSendFromISR": None, "xTaskNotify": ("rtos", "warn"), "vTaskDelay": ("rtos", "error"), "osMutexRelease": ("rtos", "warn"), "printf": ("io", "warn"), "HAL_Delay": ("delay", "error"), "__errno_location": ("tls", "info"), "memcpy": None, "osDelay": ("rtos", "error"), "ulTaskNotifyTake": ("rtos", "warn")}
CERTAINTY = {"exact": "certain", "devirtualised": "certain", "observed": "certain", "cha": "bounded", "rta": "bounded", "fn_ptr": "unknown", "unresolved": "unknown", "other": None}
CONDITION = {"i < n": "Bounds check", "(p->len <= max)": "Bounds check", "p == NULL": "Null check", "!p": "Null check", "q != nullptr": "Null check", "ret < 0": "Bounds check", "rc != 0": "Error check", "status == -1": "Error check", "a && b": None}


@pytest.mark.parametrize(
    ("rule", "cases"),
    [(R.abi_category, ABI), (R.section_class, ARM), (R.is_isr, ISR), (R.priority, PRIORITY), (R.hazard, HAZARD), (lambda c: R.looked_up(c, R.CERTAINTY), CERTAINTY), (R.condition_label, CONDITION)],
    ids=["F5", "F6", "F7", "F8", "F10", "F12", "F20"],
)
def test_rule(spark, rule, cases):
    got = said(spark, rule, list(cases))
    assert {v: tuple(x) if hasattr(x, "asDict") else x for v, x in got.items()} == cases


def test_fixed_lists():
    """The lists as they must be."""
    assert R.ESP32_SECTIONS == (".flash.text", ".flash.rodata", ".iram0.text", ".dram0.data", ".dram0.bss", ".iram0.vectors", ".rtc.text", ".dram0.dummy")
    assert R.EXCEPTION_SECTIONS == (".eh_frame", ".eh_frame_hdr", ".gcc_except_table", ".ARM.exidx", ".ARM.extab", ".except_table")
    assert R.DMA_WORDS == ("buf", "buffer", "frame", "ipc", "spi", "dma", "rx", "tx", "fifo", "packet", "msg", "transfer")
    assert ".isr_vector" in R.VECTOR_SECTIONS and ".iram0.text" in R.FAST_SECTIONS and len(R.DYNAMIC_SECTIONS) == 12


@pytest.mark.parametrize("seed", range(3))
def test_innermost(spark, seed):
    rng = random.Random(seed)
    ranges = [(rng.choice("ab"), lo, lo + rng.choice([-2, 0, 0, 1, 5, 40, 700]), k) for k in range(120) for lo in [rng.randint(-60, 300)]] + [("a", -1000, 100_000, 900), ("a", -1000, 100_000, 899)]
    points = [(k, rng.choice("abc"), rng.randint(-80, 400)) for k in range(150)]
    want = {}
    for k, f, line in points:
        inside = [(line - lo, n) for g, lo, hi, n in ranges if g == f and lo <= line <= hi]
        want[k] = min(inside)[1] if inside else None
    got = L.enclosing(spark.createDataFrame(points, "k int, f string, line int"), spark.createDataFrame(ranges, "f string, lo int, hi int, name int"), "k", "f", "line", "lo", "hi", "name")
    assert {r.k: r.name for r in got.collect()} == want
    none = spark.createDataFrame([], "f string, lo int, hi int, name int")
    assert {r.name for r in L.enclosing(spark.createDataFrame(points, "k int, f string, line int"), none, "k", "f", "line", "lo", "hi", "name").collect()} == {None}


def test_innermost_over_many_cells(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(L, "CELL", 2)
    points = [(k, rng.choice(["a", "b", None]), rng.randint(-20, 120)) for k in range(300)]
    ranges = [(rng.choice(["a", "b", None]), lo, lo + rng.choice([0, 1, 3, 9, 40, 90, -1]), n) for n in range(60) for lo in [rng.randint(-20, 110)]]
    want = {k: min(((line - lo, n) for g, lo, hi, n in ranges if f is not None and g == f and lo <= line <= hi), default=(0, None))[1] for k, f, line in points}
    asked, held = spark.createDataFrame(points, "k int, f string, line int"), spark.createDataFrame(ranges, "f string, lo int, hi int, name int")
    assert {r.k: r.name for r in L.enclosing(asked, held, "k", "f", "line", "lo", "hi", "name").collect()} == want


def test_lines_of_short_ranges_are_one_row_each(spark):
    asked, held = spark.range(50).selectExpr("id as k", "'a' as f", "id as line"), spark.createDataFrame([("a", 3, 130, 1)], "f string, lo int, hi int, name int")
    got = L.enclosing(asked, held, "k", "f", "line", "lo", "hi", "name")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.k for r in got.collect() if r.name == 1} == set(range(3, 50))
