"""Control flow, call sequences and lifetimes (G18, E10, E11) of functions made from the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import flow as W
from ..operators.graph import cut
from .registry import query

# Statements of the functions of the parts, by what the part's key leaves modulo 3: id, parent, slot, pos, kind, text,
# init, update, label.
STATEMENTS = (
    # a loop over a switch with cases that fall through, break, continue and share a body
    (
        ("a", None, "body", 0, "simple", "int n", None, None, None), ("b", None, "body", 1, "simple", "n = 0", None, None, None),
        ("c", None, "body", 2, "for", "i < n", "i = 0", "i++", None), ("d", "c", "body", 0, "switch", "x", None, None, None),
        ("e", "d", "body", 0, "case", None, None, None, "1"), ("f", "d", "body", 1, "case", None, None, None, "2"),
        ("g", "f", "body", 0, "simple", "one()", None, None, None), ("h", "d", "body", 2, "case", None, None, None, "3"),
        ("i", "h", "body", 0, "simple", "two()", None, None, None), ("j", "h", "body", 1, "break", None, None, None, None),
        ("k", "d", "body", 3, "case", None, None, None, "4"), ("l", "k", "body", 0, "continue", None, None, None, None),
        ("m", "c", "body", 1, "simple", "after()", None, None, None), ("n", None, "body", 3, "return", "return n", None, None, None),
    ),
    # a label to go back to, a decision whose other branch is empty, a block
    (
        ("a", None, "body", 0, "label", "again:", None, None, "again"), ("b", "a", "body", 0, "simple", "go()", None, None, None),
        ("c", None, "body", 1, "if", "x", None, None, None), ("d", "c", "then", 0, "goto", "goto again", None, None, "again"),
        ("e", None, "body", 2, "block", None, None, None, None), ("f", "e", "body", 0, "simple", "z()", None, None, None),
    ),
    # loops that begin at their end, an empty loop, what is never reached
    (
        ("a", None, "body", 0, "do", "x", None, None, None), ("b", "a", "body", 0, "while", "y", None, None, None),
        ("c", "a", "body", 1, "if", "z", None, None, None), ("d", "c", "then", 0, "break", None, None, None, None),
        ("e", "c", "else", 0, "simple", "w()", None, None, None), ("f", None, "body", 1, "return", "return 1", None, None, None),
        ("g", None, "body", 2, "simple", "never()", None, None, None),
    ),
)
# Their edges, worked out by hand: src, dst, kind, label.
EDGES = (
    (
        ("entry", "a", "flow", None), ("a", "init:c", "flow", None), ("init:c", "c", "flow", None), ("c", "d", "true", None), ("c", "n", "false", None),
        ("update:c", "c", "loop-back", None), ("d", "g", "case", "1"), ("d", "g", "case", "2"), ("g", "i", "fallthrough", None), ("d", "i", "case", "3"),
        ("i", "m", "break", None), ("d", "update:c", "continue", None), ("d", "m", "case", "no match"), ("m", "update:c", "flow", None), ("n", "exit", "flow", None),
    ),
    (
        ("entry", "a", "flow", None), ("a", "b", "flow", None), ("b", "c", "flow", None), ("c", "d", "true", None), ("c", "f", "false", None),
        ("d", "a", "goto", None), ("f", "exit", "flow", None),
    ),
    (
        ("entry", "b", "flow", None), ("b", "b", "loop-back", None), ("b", "c", "false", None), ("c", "f", "break", None), ("c", "e", "false", None),
        ("e", "a", "flow", None), ("a", "b", "loop-back", None), ("a", "f", "false", None), ("f", "exit", "flow", None), ("g", "exit", "flow", None),
    ),
)
NODES = (
    ("entry", "exit", "a:process", "c:loop", "init:c:process", "update:c:process", "d:switch", "g:process", "i:process", "m:process", "n:process"),
    ("entry", "exit", "a:label", "b:process", "c:decision", "d:process", "f:process"),
    ("entry", "exit", "a:loop", "b:loop", "c:decision", "e:process", "f:process", "g:process"),
)


def _values(rows) -> str:
    quote = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + v + "'"
    return ", ".join(f"({', '.join(quote(v) for v in r)})" for r in rows)


def statements(t):
    """A function a part."""
    schema = "k int, id string, parent string, slot string, pos int, kind string, text string, init string, `update` string, label string"
    rows = t.spark.createDataFrame([(k, *r) for k, rs in enumerate(STATEMENTS) for r in rs], schema)
    return t.part.select(F.concat(F.lit("fn"), "p_partkey").alias("fn"), (F.col("p_partkey") % 3).cast("int").alias("k")).join(rows, "k").drop("k")


@query("G18_edges", f"select 'fn' || p_partkey as fn, src, dst, kind, label from part join (values {_values((k, *e) for k, es in enumerate(EDGES) for e in es)}) e(k, src, dst, kind, label) on k = p_partkey % 3")
def g18(t):
    return W.control_flow(statements(t))[1]


@query("G18_nodes", f"select 'fn' || p_partkey as fn, node, kind from part join (values {_values((k, n.rpartition(':')[0] or n, n.rpartition(':')[2]) for k, ns in enumerate(NODES) for n in ns)}) e(k, node, kind) on k = p_partkey % 3")
def g18_nodes(t):
    return W.control_flow(statements(t))[0].drop("texts")


def _nodes():
    """The syntax nodes of a line, each a list of columns, and those of a file's function."""
    n = F.col("l_linenumber")
    part, line = F.col("l_partkey"), n * 10
    text = lambda x: F.lit(x).cast("string")
    node = lambda at, parent, kind, name=text(None), type_=text(None), begin=line, end=line, storage=text(None), init=text(None): ((n * 20 + at).alias("id"), parent.alias("parent"), F.lit(kind).alias("kind"), name.alias("name"), type_.alias("type"), begin.alias("begin"), end.alias("end"), storage.alias("storage"), init.alias("init"))
    at = lambda i: n * 20 + i
    top = F.lit(0).cast("int")
    of_line = (
        node(1, top, "IfStmt", begin=line, end=line + 8),
        node(2, at(1), "CompoundStmt", begin=line, end=line + 7),
        node(3, at(2), "CallExpr", begin=line + 1), node(4, at(3), "ImplicitCastExpr"), node(5, at(4), "DeclRefExpr", F.concat(F.lit("fn"), part % 9)),
        node(6, at(2), "CXXMemberCallExpr", begin=100 - line), node(7, at(6), "MemberExpr", text("put")), node(8, at(7), "DeclRefExpr", text("box"), F.concat(F.lit("const Box"), part % 3, F.lit(" *"))),
        node(9, at(2), "DeclStmt"), node(10, at(9), "VarDecl", F.concat(F.lit("v"), n), F.concat(F.lit("Box"), part % 3), begin=line + 2),
        node(11, at(9), "VarDecl", F.concat(F.lit("w"), n), text("Box1"), begin=line + 1, storage=F.when(part % 2 == 0, "static")),
        node(12, at(9), "VarDecl", F.concat(F.lit("r"), n), text("const Ref &"), begin=line + 4, init=text("c")), node(13, at(12), "CXXMemberCallExpr", begin=line + 4),
        node(14, at(10), "CXXConstructExpr", type_=F.concat(F.lit("ns::Box"), part % 3), begin=line + 2),
        node(15, top, "CXXNewExpr", type_=text("Heap *"), begin=line + 5), node(16, at(2), "VarDecl", text("i"), text("int")),
    )
    root = (F.lit(0).alias("id"), F.lit(None).cast("int").alias("parent"), F.lit("FunctionDecl").alias("kind"), F.lit("f").alias("name"), text(None).alias("type"), F.lit(1).alias("begin"), F.lit(200).alias("end"), text(None).alias("storage"), text(None).alias("init"))
    walked = lambda x: (*x, x[0].alias("pos"), x[5].alias("line"))
    return [walked(x) for x in of_line], walked(root)


def syntax(t):
    """A file an order: a function, and for each of its lines a guarded call, a construction, variables and a heap object."""
    of_line, root = _nodes()
    first = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).withColumn("l_linenumber", F.col("l_linenumber").cast("int"))
    first = cut(first)
    rows = reduce(DataFrame.unionByName, (first.select(F.concat(F.lit("o"), "l_orderkey").alias("file"), *x) for x in of_line))  # of a kind that is not asked for nothing is made
    return t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("file"), *root).unionByName(rows)


LINES_A_TASK = 16384  # of which 16 nodes each are made


def dealt_syntax(t):
    """syntax(), dealt by file as lines, before they become nodes."""
    asked = lambda x: F.struct(x[0], x[1], x[9], x[2], x[3], x[4], x[10])  # noqa: E731  # what call_sequence() reads
    of_line, root = _nodes()
    lines = t.lineitem.select(F.concat(F.lit("o"), "l_orderkey").alias("file"), F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_partkey", F.lit(False).alias("_root"))
    files = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("file"), F.lit(True).alias("_root"))
    n_tasks = max(t.spark.sparkContext.defaultParallelism, -(-t.lineitem.count() // LINES_A_TASK))
    first = lines.unionByName(files, allowMissingColumns=True).repartition(n_tasks, "file").groupBy("file", "_root", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    nodes = F.when(F.col("_root"), F.array(asked(root))).otherwise(F.array(*map(asked, of_line)))
    return first.select("file", F.explode(nodes).alias("_n")).select("file", "_n.*")


LINES = "with n as (select l_orderkey, l_linenumber as n, min(l_partkey) as p from lineitem group by 1, 2)"


@query(
    "E10_call_sequence",
    LINES
    + """, s as (select 'o' || l_orderkey as file, n * 20 + 3 as pos, 'fn' || p % 9 as name, n * 10 + 1 as line, 'if' as guards, false as virtual from n
 union all select 'o' || l_orderkey, n * 20 + 6, 'Box' || p % 3 || '::put', 100 - n * 10, 'if', p % 3 = 1 from n union all select 'o' || l_orderkey, n * 20 + 14, 'ns::Box' || p % 3 || '::Box' || p % 3, n * 10 + 2, 'if', false from n)
 select file, pos, row_number() over (partition by file order by line, pos) - 1 as step, name, line, guards, virtual from s""",
)
def e10(t):
    known = t.spark.createDataFrame([("Box1::put",)], "name string")
    return W.call_sequence(dealt_syntax(t), known, dealt=True).withColumn("guards", F.array_join("guards", ","))


@query(
    "E11_objects",
    LINES
    + """, o as (select 'o' || l_orderkey as file, n * 20 + 10 as id, 'v' || n as name, 'Box' || p % 3 as type, n * 20 + 2 as scope, n * 10 + 2 as constructed, n * 10 + 7 as destroyed, 1 as rank, 'automatic' as storage, p % 3 > 0 as has_destructor from n
 union all select 'o' || l_orderkey, n * 20 + 11, 'w' || n, 'Box1', n * 20 + 2, n * 10 + 1, case when p % 2 = 0 then -1 else n * 10 + 7 end, case when p % 2 = 0 then 1 else 2 end, case when p % 2 = 0 then 'static' else 'automatic' end, true from n
 union all select 'o' || l_orderkey, n * 20 + 12, 'r' || n, 'Ref', n * 20 + 2, n * 10 + 4, n * 10 + 7, 0, 'automatic', true from n union all select 'o' || l_orderkey, n * 20 + 15, '(heap)', 'Heap', 0, n * 10 + 5, -1, -1, 'dynamic', true from n)
 select * replace (rank::bigint as rank) from o""",
)
def e11(t):
    types = t.spark.createDataFrame([("ns::Box0", "Box0", False, 0), ("ns::Box1", "Box1", True, 1)], "qualified string, name string, has_destructor boolean, ord int")
    return W.objects(syntax(t), types)


@query("E11_scopes", LINES + " select 'o' || l_orderkey as file, n * 20 + 1 as id, 0 as parent, 'if' as kind, n * 10 as begin, n * 10 + 8 as \"end\" from n union all select 'o' || l_orderkey, n * 20 + 2, n * 20 + 1, 'block', n * 10, n * 10 + 7 from n union all select 'o' || o_orderkey, 0, null, 'function', 1, 200 from orders")
def e11_scopes(t):
    return W.scopes(syntax(t))


@query("E11_dangling", LINES + " select 'o' || l_orderkey as file, n * 20 + 12 as id, 'r' || n as name, n * 10 + 4 as line from n")
def e11_dangling(t):
    return W.dangling(syntax(t))
