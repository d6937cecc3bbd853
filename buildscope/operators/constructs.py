"""What a compiler adds: constructs of types (E9) and of single syntax nodes (E8), as findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import DYNAMIC_SECTIONS, EXCEPTION_SECTIONS, abi_category, any_prefix, bare_type
from .graph import cut, hops

# How much news each construct of a type, and of a syntax node, is to a reader of C.
OF_TYPES = {
    "virtual_dispatch": "new", "abstract_interface": "new", "multiple_inheritance": "new", "virtual_inheritance": "trap",
    "non_virtual_destructor": "trap", "implicit_non_virtual_destructor": "trap", "deleted_special_member": "new", "move_semantics": "new",
    "coroutine": "trap", "operator_overload": "new", "template_class": "new", "static_data_member": "new", "constexpr_method": "new",
    "union": "familiar", "plain_data": "familiar", "non_public_inheritance": "new",
}
OF_NODES = {
    "object_construction": "new", "temporary_destroyed": "trap", "materialised_temporary": "new", "function_local_static": "trap",
    "virtual_call_site": "new", "operator_call": "new", "heap_allocation": "trap", "heap_release": "new", "throw": "trap", "try_block": "new",
    "rtti_use": "trap", "lambda": "new", "range_for": "familiar", "structured_binding": "familiar", "coroutine_suspend": "trap", "implicit_conversion": "trap",
}


def severity(words: dict[str, str], construct: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in words.items() for x in kv)), construct)


def safe_destructors(types: DataFrame, bases: DataFrame, methods: DataFrame) -> DataFrame:
    """Rows (type): types that inherit a virtual destructor, or may: that have a base, at any distance, with one, or one that is not known."""
    known = types.select(F.col("id").alias("base"), F.lit(True).alias("_known"))
    told = bases.join(known, "base", "left")
    unknown = told.where("_known is null").select(F.col("type_id").alias("node")).distinct()
    having = methods.where("is_destructor and is_virtual").select(F.col("type_id").alias("node")).distinct()
    down = cut(told.where("_known").select(F.col("base").alias("src"), F.col("type_id").alias("dst")).distinct())  # read in every round
    reached = hops(down, having.unionByName(unknown).distinct()).select(F.col("node").alias("src"))
    return down.join(reached, "src", "left_semi").select(F.col("dst").alias("type")).unionByName(unknown.select(F.col("node").alias("type"))).distinct()


def type_constructs(types: DataFrame, bases: DataFrame, members: DataFrame, methods: DataFrame, relations: DataFrame) -> DataFrame:
    """Rows (type, qualified, construct, severity, n, names, source, line) of a class diagram's tables (sources.diagrams).

    n counts what there is of it (methods, bases, members), where that is the point, and names lists it in order. A class is
    polymorphic if it has a virtual method or a direct base that is abstract; its destructor, declared or not, is held
    against it if it is not virtual and none is inherited that is, or may be.
    """
    # each is read several times, and parsing a diagram costs more than to store it
    types, bases, methods = cut(types), cut(bases.select("type_id", "base", "is_virtual")), cut(methods.select("type_id", "ord", "display_name", "is_virtual", "is_pure", "is_destructor", "is_deleted", "is_operator", "is_copy_assignment", "is_move_assignment", "is_coroutine", "is_constexpr", "is_consteval"))
    count = lambda c: F.count_if(c).alias
    names = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ord", F.col("display_name").alias("n"))))), lambda x: x["n"])
    operator = F.col("is_operator") & ~F.col("is_copy_assignment") & ~F.col("is_move_assignment")
    of_methods = methods.groupBy(F.col("type_id").alias("id")).agg(
        F.count(F.lit(1)).alias("methods"), count(F.col("is_virtual"))("virtuals"), count(F.col("is_virtual") & F.col("is_pure"))("pures"),
        F.min_by("is_virtual", F.when(F.col("is_destructor"), F.col("ord"))).alias("destructor"), count(F.col("is_deleted"))("deleted"), names(F.col("is_deleted")).alias("deleted_names"),
        count(F.col("is_move_assignment"))("moves"), count(F.col("is_coroutine"))("coroutines"), count(operator)("operators"), names(operator).alias("operator_names"),
        count(F.col("is_constexpr") | F.col("is_consteval"))("constant"),
    )
    abstract = types.select(F.col("id").alias("base"), F.col("is_abstract").alias("_abstract"))
    of_bases = bases.join(abstract, "base", "left").groupBy(F.col("type_id").alias("id")).agg(F.count(F.lit(1)).alias("bases"), count(F.col("is_virtual"))("virtual_bases"), F.max(F.coalesce("_abstract", F.lit(False))).alias("abstract_base"))
    of_members = members.groupBy(F.col("type_id").alias("id")).agg(count(F.col("is_static"))("statics"))
    safe = safe_destructors(types, bases, methods).select(F.col("type").alias("id"), F.lit(True).alias("safe"))
    every = types.join(of_methods, "id", "left").join(of_bases, "id", "left").join(of_members, "id", "left").join(safe, "id", "left")
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("array<string>")
    polymorphic = (n("virtuals") > 0) | yes(F.col("abstract_base"))
    unsafe = polymorphic & ~yes(F.col("safe"))
    rules = (
        ("virtual_dispatch", n("virtuals") > 0, n("virtuals"), none),
        ("abstract_interface", F.col("is_abstract") | (n("pures") > 0), n("pures"), none),
        ("multiple_inheritance", n("bases") > 1, n("bases"), none),
        ("virtual_inheritance", n("virtual_bases") > 0, n("virtual_bases"), none),
        ("non_virtual_destructor", unsafe & yes(~F.col("destructor")), zero, none),
        ("implicit_non_virtual_destructor", unsafe & F.col("destructor").isNull(), zero, none),
        ("deleted_special_member", n("deleted") > 0, n("deleted"), F.col("deleted_names")),
        ("move_semantics", n("moves") > 0, n("moves"), none),
        ("coroutine", n("coroutines") > 0, n("coroutines"), none),
        ("operator_overload", n("operators") > 0, n("operators"), F.col("operator_names")),
        ("template_class", F.col("is_template"), zero, none),
        ("static_data_member", n("statics") > 0, n("statics"), none),
        ("constexpr_method", n("constant") > 0, n("constant"), none),
        ("union", F.col("kind") == "union", zero, none),
        ("plain_data", F.col("kind").isin("struct", "class") & (n("bases") == 0) & (n("methods") == 0) & ~F.col("is_template"), zero, none),
    )
    found = F.filter(F.array(*(F.when(c, F.struct(F.lit(name).alias("construct"), k.alias("n"), names_.alias("names"))) for name, c, k, names_ in rules)), lambda x: x.isNotNull())
    told = every.select(F.col("id").alias("type"), "qualified", "source", "line", F.explode(found).alias("x")).select("type", "qualified", "x.*", "source", "line")
    hidden = relations.where("kind = 'inheritance' and access is not null and access <> 'public'")
    hidden = hidden.join(types.select(F.col("id").alias("src"), "qualified", "source", "line"), "src").join(types.select(F.col("id").alias("dst"), F.col("name").alias("base_name")), "dst")
    hidden = hidden.select(F.col("src").alias("type"), "qualified", F.lit("non_public_inheritance").alias("construct"), zero.alias("n"), F.array("access", "base_name").alias("names"), "source", "line")
    every = told.unionByName(hidden)
    return every.select("type", "qualified", "construct", severity(OF_TYPES, F.col("construct")).alias("severity"), "n", "names", "source", "line")


def node_constructs(nodes: DataFrame, virtual: DataFrame | None = None, destructors: DataFrame | None = None) -> DataFrame:
    """Rows (file, line, col, construct, severity, subject, certain) of syntax nodes, one of a construct and line: the first in the walk.

    nodes: file, id, parent, pos, kind, name, type, line, col, storage, mangled, cast, cleanups, array. A member call counts if its
    receiver's type has a virtual method of the name (virtual: type, method, with types by their own or qualified names);
    destructors (type, has) tells which types have one, which is what `certain` says; a lambda that captures by reference is a trap.
    """
    child = nodes.select("file", F.col("parent").alias("id"), "pos", F.col("id").alias("child"), F.col("kind").alias("child_kind"), F.col("name").alias("child_name"), F.col("type").alias("child_type"))
    first = lambda kind: child.where(F.col("child_kind") == kind).groupBy("file", "id").agg(F.min_by(F.struct("child", "child_name"), "pos").alias("c"))
    member = first("MemberExpr").select("file", F.col("id").alias("call"), F.col("c.child").alias("id"), F.col("c.child_name").alias("method"))
    receiver = child.groupBy("file", "id").agg(F.min_by("child_type", "pos").alias("receiver"))
    calls = member.join(receiver, ["file", "id"]).select("file", F.col("call").alias("id"), "method", bare_type(F.coalesce("receiver", F.lit(""))).alias("receiver"))
    records = first("CXXRecordDecl").select("file", F.col("id").alias("lambda"), F.col("c.child").alias("id"))
    fields = child.where("child_kind = 'FieldDecl'").join(records, ["file", "id"]).groupBy("file", F.col("lambda").alias("id")).agg(F.count(F.lit(1)).alias("captures"), F.max(F.coalesce(F.col("child_type").contains("&"), F.lit(False))).alias("by_reference"))
    every = nodes.join(calls, ["file", "id"], "left").join(fields, ["file", "id"], "left")
    own, kind = bare_type(F.coalesce("type", F.lit(""))), F.col("kind")
    short = lambda c: F.element_at(F.split(c, "::"), -1)
    if virtual is None:
        every = every.withColumn("is_virtual", F.lit(False))
    else:
        keys = virtual.select(F.explode(F.array_distinct(F.array("type", short(F.col("type"))))).alias("_type"), "method").distinct().withColumn("is_virtual", F.lit(True))
        whole = keys.withColumnsRenamed({"_type": "receiver", "is_virtual": "_whole"})
        brief = keys.withColumnsRenamed({"_type": "_short", "is_virtual": "_brief"})
        every = every.withColumn("_short", short(F.col("receiver"))).join(whole, ["receiver", "method"], "left").join(brief, ["_short", "method"], "left").withColumn("is_virtual", F.coalesce("_whole", "_brief", F.lit(False)))
    every = every.withColumn("own", own)
    if destructors is None:
        every = every.withColumn("certain", F.lit(False))
    else:
        known = destructors.select(F.explode(F.array_distinct(F.array("type", short(F.col("type"))))).alias("_type")).distinct().withColumn("_known", F.lit(True))
        # told once a type that is constructed, not once a node: a few types may have nearly all nodes
        made = nodes.where("kind = 'CXXConstructExpr'").select(own.alias("own")).distinct()
        told = cut(made.withColumn("_type", short(F.col("own"))).join(known, "_type").select("own", F.lit(True).alias("_known")))
        every = every.join(told, "own", "left").withColumn("certain", F.coalesce("_known", F.lit(False)))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    construct = (
        F.when(kind == "CXXConstructExpr", "object_construction")
        .when((kind == "ExprWithCleanups") & yes("cleanups"), "temporary_destroyed")
        .when(kind == "MaterializeTemporaryExpr", "materialised_temporary")
        .when((kind == "VarDecl") & (F.col("storage") == "static") & F.col("mangled").startswith("_ZZ"), "function_local_static")
        .when((kind == "CXXMemberCallExpr") & F.col("is_virtual"), "virtual_call_site")
        .when(kind == "CXXOperatorCallExpr", "operator_call")
        .when(kind == "CXXNewExpr", "heap_allocation")
        .when(kind == "CXXDeleteExpr", "heap_release")
        .when(kind == "CXXThrowExpr", "throw")
        .when(kind == "CXXTryStmt", "try_block")
        .when(kind.isin("CXXDynamicCastExpr", "CXXTypeidExpr"), "rtti_use")
        .when(kind == "LambdaExpr", "lambda")
        .when(kind == "CXXForRangeStmt", "range_for")
        .when(kind == "DecompositionDecl", "structured_binding")
        .when(kind.isin("CoawaitExpr", "CoyieldExpr", "CoreturnStmt"), "coroutine_suspend")
        .when((kind == "ImplicitCastExpr") & F.col("cast").isin("UserDefinedConversion", "ConstructorConversion"), "implicit_conversion")
    )
    subject = (
        F.when(kind == "CXXMemberCallExpr", F.concat("receiver", F.lit("::"), "method"))
        .when(kind.isin("VarDecl", "CXXNewExpr"), F.col("name"))
        .when(kind == "LambdaExpr", F.coalesce("captures", F.lit(0)).cast("string"))
        .when(kind == "CXXDeleteExpr", F.when(yes("array"), "array").otherwise("one"))
        .otherwise(F.nullif(F.col("own"), F.lit("")))
    )
    found = every.withColumns({"construct": construct, "subject": subject}).where("construct is not null")
    how = F.when((F.col("construct") == "lambda") & yes("by_reference"), "trap").otherwise(severity(OF_NODES, F.col("construct")))
    certain = F.when(F.col("construct") == "object_construction", F.col("certain"))
    told = found.withColumns({"severity": how, "certain": certain})
    order = Window.partitionBy("file", "construct", "line").orderBy("pos")
    return told.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("file", "line", "col", "construct", "severity", "subject", "certain")


def cpp_summary(symbols: DataFrame, sections: DataFrame, families: int = 50) -> DataFrame:
    """M4: one row of counts and bytes of what a language adds to a program; is_cpp alone if no symbol is mangled.

    symbols: ord, name, demangled, size; sections: name, size. Classes are those with a table of methods or type
    information, and of two tables of one class the last counts; template_instantiations are those of the so many families, told by what is
    before the first angle bracket, that take most bytes.
    """
    name, demangled = F.col("name"), F.coalesce("demangled", "name")
    mangled = symbols.withColumn("category", abi_category(name)).where("category is not null")
    owner = F.regexp_extract("name", "^_ZT[VI](.+)$", 1)
    classes = mangled.where(owner != "").groupBy(owner.alias("class")).agg(F.max_by("size", F.when(name.startswith("_ZTV"), F.col("ord"))).alias("table_size"))
    of_classes = classes.agg(F.count(F.lit(1)).alias("class_count"), F.coalesce(F.sum("table_size"), F.lit(0)).alias("vtable_bytes"))
    base = F.trim(F.substring_index(demangled, "<", 1))
    last = F.substring_index(base, " ", -1)
    family = F.when(base.contains(" ") & (last.contains("::") | last.rlike("^[A-Z]")), last).otherwise(base)
    kept = mangled.where(demangled.contains("<")).groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("ord").alias("first")).orderBy(F.desc("total"), "first").limit(families)
    of_families = kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("template_instantiations"))
    count = lambda c: F.count_if(F.col("category") == c)
    of_symbols = mangled.agg(F.count(F.lit(1)).alias("mangled_count"), count("ctor").alias("ctor_count"), count("dtor").alias("dtor_count"))
    held = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0))
    stubs = F.coalesce(F.sum(F.when(name == ".plt", F.greatest(F.lit(0), F.floor((F.col("size") - 16) / 16)))), F.lit(0))
    of_sections = sections.agg(held(any_prefix(name, EXCEPTION_SECTIONS)).alias("exception_bytes"), held(name.isin(*DYNAMIC_SECTIONS)).alias("dynamic_bytes"), stubs.alias("plt_imports"))
    every = of_symbols.crossJoin(of_classes).crossJoin(of_families).crossJoin(of_sections)  # a row each
    is_cpp = F.col("mangled_count") > 0
    names = ("mangled_count", "class_count", "vtable_bytes", "exception_bytes", "dynamic_bytes", "ctor_count", "dtor_count", "template_instantiations", "plt_imports")
    return every.select(is_cpp.alias("is_cpp"), *(F.when(is_cpp, F.col(n)).cast("long").alias(n) for n in names))
