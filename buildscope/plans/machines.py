"""State machines and ports (E1, E2, E3), and folders kept up to date (G16), made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import machines as M
from ..operators import sweep
from .registry import query

HEAD = "#include \"hal{k}.h\"\nextern volatile int shared{k};\n"
TEXTS = (
    # a switch; a smaller one comes before it
    HEAD + "typedef enum { IDLE, RUN = 2, /* x */ STOP, FAULT{k}, LAST } State{k};\nvoid step(Ctx *c) {\n  switch (c->mode) { case IDLE: c->mode = RUN; break; }\n"
    "  switch (c->state) {\n    case IDLE:\n      if (ready(c)) {\n        if (c->n > {k})\n          c->state = RUN;\n      }\n      break;\n    case RUN: { log_it(); c->state = STOP; break; }\n"
    "    case State{k}::STOP: c->state = other; // c->state = LAST;\n    default: c->state = IDLE;\n  }\n}\n",
    # comparisons
    HEAD + "enum class Mode{k} : int { A, B, C };\nstatic int run(void) {\n  if (m.mode == Mode{k}::A) { start(); m.mode = Mode{k}::B; }\n  else if (m.mode == B) {\n    if (x) { m.mode = C; }\n  }\n  return 0;\n}\n",
    # a table of handlers
    HEAD + "enum { ON, OFF };\nvoid on_it(void) { g_state = OFF; }\nint get_off(void) { if (1) g_state = ON; return 1; }\nhandler_t table[] = { on_it, &get_off };\ndev.onCallback = on_it;\n",
    # nothing that dispatches
    HEAD + "class Drv{k} : public Base, private ns::Impl { virtual void set_x(int v) { x = v; } };\nenum Kind { ONE };\n",
)


def text(t):
    k = F.col("p_partkey")
    return t.part.select(F.concat(F.lit("f"), k, F.lit(".cpp")).alias("file"), F.regexp_replace(F.element_at(F.array(*map(F.lit, TEXTS)), (k % 4 + 1).cast("int")), r"\{k\}", k.cast("string")).alias("text"))


def rows(*values):
    """SQL rows for the files of each of the texts: values of a row, the first the text's number, {k} the part's key."""
    said = lambda v: "null" if v is None else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''").replace("{k}", "' || p_partkey || '") + "'"
    return " union all ".join(f"select 'f' || p_partkey || '.cpp', {', '.join(said(v) for v in own)} from part where p_partkey % 4 = {n}" for n, *own in values)


@query(
    "E1_machines",
    "with m(file, enum, states, kind, variable, confidence, line) as ("
    + rows((0, "State{k}", "IDLE,RUN,STOP,FAULT{k},LAST", "switch-case", "c->state", 0.8, 3), (1, "Mode{k}", "A,B,C", "if-else", "m.mode", 0.6833333333333333, 3), (2, "AnonEnum_L3", "ON,OFF", "dispatch-table", None, 0.6, 3), (3, "Kind", "ONE", "unknown", None, 0.15, 4))
    + ") select * replace (confidence::double as confidence) from m",
)
def e1(t):
    return M.state_machines(text(t)).withColumn("states", F.array_join("states", ","))


@query(
    "E2_transitions",
    "with m(file, enum, src, dst, label, kind, line) as ("
    + rows(
        (0, "State{k}", "IDLE", "RUN", "on c->n > {k}", "switch-case", 10), (0, "State{k}", "RUN", "STOP", "after log_it()", "switch-case", 13),
        (1, "Mode{k}", "A", "B", "after start()", "if-else", 5), (1, "Mode{k}", "B", "C", "on x", "if-else", 7),
        (2, "AnonEnum_L3", "ON", "OFF", "via on_it()", "dispatch-table", 4), (2, "AnonEnum_L3", "OFF", "ON", "via get_off()", "dispatch-table", 5),
    )
    + ") select * from m",
)
def e2(t):
    return M.transitions(text(t))


@query(
    "E3_ports",
    "with m(file, name, direction, mechanism, detail, line) as ("
    + rows(
        *((n, *r) for n in range(4) for r in (("hal{k}.h", "dependency", "include", None, 1), ("shared{k}", "shared", "global-variable", None, 2))),
        (0, "step()", "input", "function-call-in", None, 4), (0, "ready()", "output", "function-call-out", None, 8), (0, "log_it()", "output", "function-call-out", None, 13),
        (1, "start()", "output", "function-call-out", None, 5),
        (2, "on_it()", "input", "function-call-in", None, 4), (2, "get_off()", "input", "getter", None, 5), (2, "on_it()", "output", "callback-registration", "registered as onCallback", 7),
        (3, "set_x()", "input", "setter", "virtual", 3), (3, "Base", "dependency", "class-extension", "Drv{k} extends Base", 3), (3, "ns::Impl", "dependency", "class-extension", "Drv{k} extends ns::Impl", 3),
    )
    + ") select * from m",
)
def e3(t):
    return M.io_ports(text(t))


MARK = lambda of: f"left(sha256(string_agg(name || ':' || {of}, '|' order by name)), 16)"


@query(
    "G16_folders",
    f"""with f as (select 'a' || p_partkey % 5 as a, case when p_partkey % 10 = 3 then null else 'a' || p_partkey % 5 || '/b' || p_partkey % 40 end as b, 'f' || p_partkey || '.c' as name, 'h' || p_partkey as old, case when p_partkey % 74 = 0 then 'new' else 'h' || p_partkey end as hash, p_partkey % 37 = 0 as saved from part),
 b as (select a, b, {MARK('old')} as old, {MARK('hash')} as fingerprint, bool_or(saved) as saved from f where b is not null group by 1, 2),
 b2 as (select *, saved and old <> fingerprint as rewritten from b),
 c as (select a, name, old, hash, saved from f where b is null union all select a, split_part(b, '/', 2), old, case when rewritten then fingerprint else old end, rewritten from b2),
 a as (select a, {MARK('old')} as old, {MARK('hash')} as fingerprint, bool_or(saved) as saved from c group by 1),
 a2 as (select *, saved and old <> fingerprint as rewritten from a),
 r as (select {MARK('old').replace('name', 'a')} as old, {MARK("case when rewritten then fingerprint else old end").replace('name', 'a')} as fingerprint, bool_or(rewritten) as saved from a2)
 select b as path, fingerprint, rewritten from b2 where saved union all select a, fingerprint, rewritten from a2 where saved union all select '', fingerprint, old <> fingerprint from r where saved""",
)
def g16(t):
    k = F.col("p_partkey")
    top = F.concat(F.lit("a"), k % 5)
    folder = F.when(k % 10 == 3, top).otherwise(F.concat(top, F.lit("/b"), k % 40))
    files = t.part.select(F.concat(folder, F.lit("/f"), k, F.lit(".c")).alias("path"), F.concat(F.lit("h"), k).alias("old"), F.when(k % 74 == 0, "new").otherwise(F.concat(F.lit("h"), k)).alias("hash"), (k % 37 == 0).alias("saved"))
    # what is stored is what a sweep over all files, as they were, writes
    before = sweep.bubble_up(files.select("path", F.col("old").alias("hash")), t.spark.createDataFrame([], "path string, fingerprint string"), files.select("path"))
    return sweep.bubble_up(files.select("path", "hash"), before.where("rewritten").select("path", "fingerprint"), files.where("saved").select("path"))
