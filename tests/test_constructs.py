"""Class diagrams in JSON, what their types have, constructs of syntax nodes, layouts of another tool, by hand."""

import json

import pytest

from buildscope.operators import constructs as C
from buildscope.operators import dispatch as D
from buildscope.sources import debug, diagrams

METHOD = {"name": "m"}
ELEMENTS = [
    {"id": 12345678901234567890, "name": "Base", "namespace": "n", "is_abstract": True, "type": "class", "methods": [{"name": "run", "is_virtual": True, "is_pure_virtual": True, "parameters": [{"name": "a", "type": "int"}]}, {"name": "~Base"}], "members": [{"name": "count", "is_static": True, "type": "int"}], "source_location": {"file": "b.h", "line": 3, "column": 1}},
    {"id": "2", "name": "Derived", "type": "class", "bases": [{"id": "12345678901234567890", "access": "public"}, {"id": "3", "is_virtual": True}, {"name": "lost"}], "methods": [{"name": "run", "is_virtual": True}, {"name": "operator=", "display_name": "operator=(Derived&&)", "is_operator": True, "is_move_assignment": True}, {"name": "operator+", "is_operator": True}, {"name": "Derived", "display_name": "Derived(const Derived&)", "is_deleted": True, "is_constructor": True}, {"name": ""}]},
    {"id": "3", "name": "Safe", "is_struct": True, "type": "class", "methods": [{"name": "~Safe", "is_virtual": True}]},
    {"id": "4", "name": "Leaf", "bases": [{"id": "3"}], "methods": [{"name": "go", "is_virtual": True, "is_coroutine": True}, {"name": "k", "is_constexpr": True}, {"name": "j", "is_consteval": True}]},
    {"id": "5", "name": "Deep", "bases": [{"id": "4"}], "methods": [{"name": "go", "is_virtual": True}], "is_template": True},
    {"id": "6", "name": "Outside", "bases": [{"id": "99"}], "methods": [{"name": "go", "is_virtual": True}]},
    {"id": "7", "name": "Bare", "methods": [{"name": "go", "is_virtual": True}]},
    {"id": "8", "name": "U", "is_union": True, "type": "class"},
    {"id": "9", "name": "P", "type": "struct"},
    {"id": "10", "name": "Odd", "type": "thing"},
    {"id": "", "name": "gone"},
    {"id": "11", "name": ""},
]
RELATIONS = [{"source": "2", "destination": "12345678901234567890", "type": "extension", "access": "private"}, {"source": "4", "destination": "3", "type": "extension", "access": "public"}, {"source": "5", "destination": "77", "type": "extension", "access": "private"}, {"source": "", "destination": "3"}, {"source": "9", "destination": "8", "type": "aggregation", "label": "u"}]


@pytest.fixture(scope="module")
def diagram(spark):
    rows = [("a.json", json.dumps({"elements": ELEMENTS, "relationships": RELATIONS}), "x"), ("b.json", "no json", "x"), ("c.json", None, "x")]
    return diagrams.class_diagram(spark.createDataFrame(rows, "file string, text string, id string"))


def test_tables(diagram):
    types = {r.id: (r.qualified, r.kind, r.is_abstract, r.source, r.line) for r in diagram.types.collect()}
    assert types["12345678901234567890"] == ("n::Base", "class", True, "b.h", 3) and types["8"][1] == "union" and types["3"][1] == "struct" and types["10"][1] == "unknown" and types["9"][1] == "struct" and len(types) == 10
    assert sorted((r.type_id, r.base, r.is_virtual) for r in diagram.bases.collect() if r.type_id == "2") == [("2", "12345678901234567890", False), ("2", "3", True)]
    run = next(r for r in diagram.methods.collect() if r.name == "run" and r.is_pure)
    assert (run.n_params, run.params, run.is_virtual, run.display_name, run.is_destructor) == (1, ["int"], True, "run", False)
    assert [(r.src, r.dst, r.kind, r.access, r.label) for r in diagram.relations.orderBy("ord").collect()][3:] == [("9", "8", "aggregation", None, "u")]
    calls, found = D.resolve(D.Model(diagram.types, diagram.relations, diagram.members, diagram.methods), diagram.types.sparkSession.createDataFrame([("n::Base", "run", 1)], "static_type string, method string, arity long"))
    assert [(r.resolution, r.n) for r in calls.collect()] == [("devirtualised", 1)] and [r.target for r in found.collect()] == ["Derived::run"]


def test_types(diagram):
    got = {}
    for r in C.type_constructs(*diagram[:5]).collect():
        got.setdefault(r.qualified, {})[r.construct] = (r.severity, r.n, r.names)
    assert set(got["n::Base"]) == {"virtual_dispatch", "abstract_interface", "non_virtual_destructor", "static_data_member"}
    assert got["Derived"] == {
        "virtual_dispatch": ("new", 1, None), "multiple_inheritance": ("new", 2, None), "virtual_inheritance": ("trap", 1, None), "deleted_special_member": ("new", 1, ["Derived(const Derived&)"]),
        "move_semantics": ("new", 1, None), "operator_overload": ("new", 1, ["operator+"]), "non_public_inheritance": ("new", 0, ["private", "Base"]),
    }
    assert set(got["Leaf"]) == {"virtual_dispatch", "coroutine", "constexpr_method"} and got["Leaf"]["constexpr_method"][1] == 2
    assert set(got["Deep"]) == {"virtual_dispatch", "template_class"} and set(got["Outside"]) == {"virtual_dispatch"}
    assert set(got["Bare"]) == {"virtual_dispatch", "implicit_non_virtual_destructor"} and set(got["U"]) == {"union"} and set(got["P"]) == {"plain_data"} and set(got["Safe"]) == {"virtual_dispatch"}
    assert "Odd" not in got and C.OF_TYPES.keys() >= {c for v in got.values() for c in v}


def test_nodes(spark):
    kinds = ["CXXConstructExpr", "ExprWithCleanups", "MaterializeTemporaryExpr", "VarDecl", "CXXOperatorCallExpr", "CXXNewExpr", "CXXDeleteExpr", "CXXThrowExpr", "CXXTryStmt", "CXXDynamicCastExpr", "CXXTypeidExpr", "CXXForRangeStmt", "DecompositionDecl", "CoawaitExpr", "CoreturnStmt", "ImplicitCastExpr", "IfStmt"]
    rows = [(k, None, kind, "v", "const ns::Box &", k, "static", "_ZZ1x", "UserDefinedConversion", True, True) for k, kind in enumerate(kinds)]
    rows += [(20, None, "VarDecl", "g", "int", 30, "static", "_ZL1g", None, None, None), (21, None, "ExprWithCleanups", None, "int", 31, None, None, None, None, None), (22, None, "ImplicitCastExpr", None, "int", 32, None, None, "LValueToRValue", None, None)]
    rows += [(23, None, "CXXMemberCallExpr", None, "void", 33, None, None, None, None, None), (24, 23, "MemberExpr", "put", None, 33, None, None, None, None, None), (25, 24, "DeclRefExpr", "b", "ns::Box *", 33, None, None, None, None, None)]
    rows += [(26, None, "CXXMemberCallExpr", None, "void", 34, None, None, None, None, None), (27, 26, "MemberExpr", "plain", None, 34, None, None, None, None, None), (28, 27, "DeclRefExpr", "b", "Box", 34, None, None, None, None, None)]
    rows += [(30, None, "LambdaExpr", None, None, 35, None, None, None, None, None), (31, 30, "CXXRecordDecl", None, None, 35, None, None, None, None, None), (32, 31, "FieldDecl", None, "int &", 35, None, None, None, None, None), (33, 31, "FieldDecl", None, "int", 35, None, None, None, None, None)]
    rows += [(34, None, "LambdaExpr", None, None, 36, None, None, None, None, None), (35, None, "CXXThrowExpr", None, None, 7, None, None, None, None, None)]
    nodes = spark.createDataFrame([("f", i, p, i, k, n, t, line, i, *rest) for i, p, k, n, t, line, *rest in rows], "file string, id int, parent int, pos int, kind string, name string, type string, line int, col int, storage string, mangled string, cast string, cleanups boolean, array boolean")
    got = C.node_constructs(nodes, spark.createDataFrame([("ns::Box", "put")], "type string, method string"), spark.createDataFrame([("ns::Box",)], "type string")).collect()
    by = {r.line: (r.construct, r.severity, r.subject, r.certain) for r in got}
    assert len(got) == len(by) and {r.construct for r in got} == set(C.OF_NODES)
    assert by[0] == ("object_construction", "new", "ns::Box", True) and by[3][2] == "v" and by[6][2] == "array" and by[7][0] == "throw" and by[10][0] == "rtti_use"
    assert by[33] == ("virtual_call_site", "new", "ns::Box::put", None) and 34 not in by and by[35] == ("lambda", "trap", "2", None) and by[36] == ("lambda", "new", "0", None) and not {16, 30, 31, 32} & set(by)
    alone = {r.construct: r.certain for r in C.node_constructs(nodes).collect()}
    assert "virtual_call_site" not in alone and alone["object_construction"] is False


LAYOUT = """pahole: type 'Gone' not found
	/* XXX 9 bytes hole, lost */
struct Pin {
	uint8_t                    port;                 /*     0     1 */

	/* XXX 3 bytes hole, try to pack */

	uint32_t                   mask;                 /*     4     4 */
struct Inner {

	/* size: 12, cachelines: 1, members: 3 */
	/* sum members: 6, holes: 1, sum holes: 3 */
	/* padding: 3 */
};

class Bits : public Tag {
	/* XXX 7 bytes hole, before all */
	/* struct Tag                 <ancestor>; */     /*     0     0 */
	uint32_t                   ready:1;              /*     0: 0  4 */
	unsigned int               count:6;              /*     0: 2  4 */

	/* XXX 8 bits hole, try to pack */
	uint32_t                   :8;
	/* size: 4, cachelines: 1, members: 4 */
	/* sum bitfield members: 24 bits, bit holes: 1, sum bit holes: 8 bits */
};
union Never {
	int                        a;                    /*     0     4 */"""


@pytest.mark.parametrize("size", [1 << 20, 5, 1])
def test_layouts(spark, size):
    rows = [(f, n, x) for f, text in (("a", LAYOUT), ("b", LAYOUT.replace("Pin", "Pan"))) for n, x in enumerate(text.split("\n"))]
    records, members, missing = debug.layouts(spark.createDataFrame(rows, "file string, line_no int, line string"), size)
    got = {(r.file, r.name): tuple(r)[3:] for r in records.collect()}
    assert got == {(f, n): v for f, p in (("a", "Pin"), ("b", "Pan")) for n, v in ((p, ("struct", 12, 6, 1, 3, None, None, 3)), ("Bits", ("class", 4, None, None, None, 1, 8, None)))}
    own = [(r.record, r.pos, r.name, r.type, r.offset, r["size"], r.is_ancestor, r.bit_first, r.bit_width, r.hole_after, r.bit_hole_after) for r in members.where("file = 'a'").orderBy("place", "pos").collect()]
    assert own == [
        ("Pin", 0, "port", "uint8_t", 0, 1, False, None, None, 3, None), ("Pin", 1, "mask", "uint32_t", 4, 4, False, None, None, None, None),
        ("Bits", 0, "Tag", "struct Tag", 0, 0, True, None, None, None, None), ("Bits", 1, "ready", "uint32_t", 0, 4, False, 0, 1, None, None),
        ("Bits", 2, "count", "unsigned int", 0, 4, False, 2, 6, None, 8), ("Bits", 3, "", "uint32_t", 0, 0, False, 0, 8, None, None),
    ]
    assert sorted((r.file, r.name) for r in missing.collect()) == [("a", "Gone"), ("b", "Gone")]
