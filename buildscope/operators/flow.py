"""Control flow, call sequences and lifetimes over tables of statements and syntax nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import bare_type
from .chains import followed
from .graph import cut

LOOPS = ("for", "while", "do")
ENTRY, EXIT = "entry", "exit"


def _ref(kind: str, c) -> Column:
    """A place in a function: A at a statement, N after it, B and C where break and continue in it lead to."""
    return F.concat(F.lit(kind), c)


def items(statements: DataFrame) -> DataFrame:
    """Statements with each run of simple ones as one, named by its first, with their texts in order; column texts."""
    seq = ["fn", "parent", "slot"]
    order = Window.partitionBy(*seq).orderBy("pos")
    simple = F.col("kind") == "simple"
    begins = ~simple | ~F.coalesce(F.lag(simple).over(order), F.lit(False))
    run = statements.withColumn("_run", F.sum(begins.cast("long")).over(order))
    first = F.min_by(F.struct("id", "pos", "kind", "init", "update", "label"), "pos").alias("f")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("texts")
    return run.groupBy(*seq, "_run").agg(first, texts).select(*seq, "f.*", "texts")


def control_flow(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of functions given as statements.

    statements: fn, id, parent (null at the top of a function), slot (then, else or body: the part of the parent that it
    is in), pos (its place there), kind (simple, if, for, while, do, switch, case, goto, break, continue, return,
    label, block, preproc), text, init and update (of a for, or null), label (of a case, null for default; of a goto and a
    label its name). ids are unique in a function and strings.

    nodes: fn, node, kind, texts; a for has up to three, init:id, id and update:id. edges: fn, src, dst, kind
    (flow, true, false, case, fallthrough, loop-back, break, continue, goto), label. What breaks, falls through or goes back
    keeps the last such kind on its way. A switch without a default has an edge "no match". Nothing leads to statements that are
    never reached; break and continue outside of what they leave lead nowhere, and a goto without a label too.

    Where control goes from a place is a chain of references: after the last statement of a branch to what is after the
    branch, into a block to its first statement, at a break to what is after the innermost loop or switch. All
    chains of all functions are followed at once, by doubling.
    """
    own = cut(items(statements))
    seq = Window.partitionBy("fn", "parent", "slot").orderBy("pos")
    up = own.select("fn", F.col("id").alias("parent"), F.col("kind").alias("up_kind"), F.col("update").alias("up_update"))
    placed = own.withColumn("next", F.lead("id").over(seq)).join(up, ["fn", "parent"], "left")
    firsts = own.groupBy("fn", "parent").pivot("slot", ["then", "else", "body"]).agg(F.min_by("id", "pos")).withColumnsRenamed({"then": "first_then", "else": "first_else", "body": "first_body"})
    inner = firsts.where("parent is not null").withColumnRenamed("parent", "id")
    # of a case the next one, and the next that has statements; a switch's cases are its body
    cases = placed.where("kind = 'case'").join(inner.select("fn", "id", "first_body"), ["fn", "id"], "left")
    after = Window.partitionBy("fn", "parent").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    cases = cases.withColumn("next_full", F.first("first_body", ignorenulls=True).over(after))
    falls = cases.select("fn", F.col("id").alias("parent"), "next_full", F.col("parent").alias("switch"))
    every = cut(placed.join(inner, ["fn", "id"], "left").join(falls, ["fn", "parent"], "left"))
    kind = F.col("kind")
    none = F.lit(None).cast("string")
    to = lambda ref=none, node=none, how=none, drops=F.lit(False): F.struct(ref.alias("to"), node.alias("node"), how.alias("how"), drops.alias("drops"))
    case = lambda *pairs, default: _whens(pairs, default)
    update = F.concat(F.lit("update:"), "parent")
    last = case(
        (F.col("up_kind").isNull(), to(node=F.lit(EXIT))),
        ((F.col("up_kind") == "for") & F.col("up_update").isNotNull(), to(node=update)),
        (F.col("up_kind").isin("for", "while"), to(node=F.col("parent"), how=F.lit("loop-back"))),
        (F.col("up_kind") == "do", to(node=F.col("parent"))),
        ((F.col("up_kind") == "case") & F.col("next_full").isNotNull(), to(ref=_ref("A", F.col("next_full")), how=F.lit("fallthrough"))),
        (F.col("up_kind") == "case", to(ref=_ref("N", F.col("switch")))),
        default=to(ref=_ref("N", F.col("parent"))),
    )
    n_ref = case((F.col("next").isNotNull() & (kind != "case"), to(ref=_ref("A", F.col("next")))), default=last)
    within = F.coalesce("first_body", "first_then")
    outward = lambda letter: case((F.col("parent").isNotNull(), to(ref=_ref(letter, F.col("parent")))), default=to())
    a_ref = case(
        (kind == "break", case((F.col("parent").isNotNull(), to(ref=_ref("B", F.col("parent")), how=F.lit("break"), drops=F.lit(True))), default=to())),
        (kind == "continue", case((F.col("parent").isNotNull(), to(ref=_ref("C", F.col("parent")), how=F.lit("continue"), drops=F.lit(True))), default=to())),
        (kind.isin("block", "do", "case") & within.isNotNull(), to(ref=_ref("A", within))),
        (kind == "block", to(ref=_ref("N", F.col("id")))),
        ((kind == "case") & F.col("next").isNotNull(), to(ref=_ref("A", F.col("next")))),
        (kind == "case", to(ref=_ref("N", F.col("parent")))),
        ((kind == "for") & F.col("init").isNotNull(), to(node=F.concat(F.lit("init:"), "id"))),
        default=to(node=F.col("id")),
    )
    b_ref = case((kind.isin(*LOOPS, "switch"), to(ref=_ref("N", F.col("id")))), default=outward("B"))
    c_ref = case(((kind == "for") & F.col("update").isNotNull(), to(node=F.concat(F.lit("update:"), "id"))), (kind.isin(*LOOPS), to(node=F.col("id"))), default=outward("C"))
    entries = F.array(*(F.struct(_ref(letter, F.col("id")).alias("ref"), c.alias("t")) for letter, c in (("A", a_ref), ("N", n_ref), ("B", b_ref), ("C", c_ref))))
    refs = every.select("fn", F.explode(entries).alias("e")).select("fn", "e.ref", "e.t.*")
    later = lambda a, b: F.coalesce(b, a)
    ends = followed(refs, ["fn"], "ref", "to", {"node": later, "how": later, "drops": lambda a, b: a | b})
    # edges as (src, place, kind, label): to a place, or to a node
    edge = lambda src, place, how, node=none, label=none: F.struct(src.alias("src"), place.alias("ref"), node.alias("dst"), F.lit(how).alias("kind"), label.alias("label"))
    here, next_ = F.col("id"), _ref("N", F.col("id"))
    at = lambda c: F.when(c.isNotNull(), _ref("A", c)).otherwise(next_)
    body = F.when(F.col("first_body").isNotNull(), _ref("A", F.col("first_body")))
    back = lambda node, how: edge(here, none, how, node=node)
    no_edges = F.array().cast("array<struct<src:string,ref:string,dst:string,kind:string,label:string>>")
    updated = F.col("update").isNotNull()
    loop = F.array(
        F.when(body.isNotNull(), edge(here, body, "true")).when((kind == "for") & updated, back(F.concat(F.lit("update:"), "id"), "true")).otherwise(back(here, "loop-back")),
        edge(here, next_, "false"),
    )
    of_for = F.concat(
        F.when(F.col("init").isNotNull(), F.array(edge(F.concat(F.lit("init:"), "id"), none, "flow", node=here))).otherwise(no_edges),
        F.when(updated, F.array(edge(F.concat(F.lit("update:"), "id"), none, "loop-back", node=here))).otherwise(no_edges),
    )
    out = (
        F.when(kind.isin("simple"), F.array(edge(here, next_, "flow")))
        .when(kind == "label", F.array(edge(here, at(F.col("first_body")), "flow")))
        .when(kind.isin("if", "preproc"), F.array(edge(here, at(F.col("first_then")), "true"), edge(here, at(F.col("first_else")), "false")))
        .when(kind == "for", F.concat(loop, of_for))
        .when(kind == "while", loop)
        .when(kind == "do", F.array(edge(here, next_, "false"), F.when(body.isNotNull(), edge(here, body, "do")).otherwise(back(here, "loop-back"))))
        .when(kind == "case", F.array(edge(F.col("parent"), _ref("A", here), "case", label=F.coalesce("label", F.lit("default")))))
        .when(kind == "return", F.array(edge(here, none, "flow", node=F.lit(EXIT))))
        .otherwise(no_edges)
    )
    plain = every.select("fn", F.explode(out).alias("e")).select("fn", "e.*")
    starts = firsts.where("parent is null").select("fn", F.lit(ENTRY).alias("src"), _ref("A", F.col("first_body")).alias("ref"), none.alias("dst"), F.lit("flow").alias("kind"), none.alias("label"))
    defaults = cases.groupBy("fn", F.col("parent").alias("id")).agg(F.max(F.col("label").isNull()).alias("has"))
    open_switches = every.where("kind = 'switch'").join(defaults, ["fn", "id"], "left").where("not coalesce(has, false)").select("fn", here.alias("src"), next_.alias("ref"), none.alias("dst"), F.lit("case").alias("kind"), F.lit("no match").alias("label"))
    labels = every.where("kind = 'label'").groupBy("fn", "label").agg(F.min_by("id", F.struct("pos", "id")).alias("dst"))
    gotos = every.where("kind = 'goto'").select("fn", here.alias("src"), "label").join(labels, ["fn", "label"]).select("fn", "src", none.alias("ref"), "dst", F.lit("goto").alias("kind"), none.alias("label"))
    edges = plain.unionByName(starts).unionByName(open_switches).unionByName(gotos)
    met = edges.join(ends.select("fn", "ref", "node", "how", "drops"), ["fn", "ref"], "left").withColumn("dst", F.coalesce("dst", "node")).where("dst is not null")
    said = F.when(F.col("kind") == "do", "loop-back").otherwise(F.coalesce("how", "kind"))
    edges = met.select("fn", "src", "dst", said.alias("kind"), F.when(~F.coalesce("drops", F.lit(False)), F.col("label")).alias("label"))
    shown = F.when(kind.isin("simple", "goto", "return"), "process").when(kind == "if", "decision").when(kind.isin(*LOOPS), "loop").otherwise(kind)
    nodes = every.where(~kind.isin("block", "break", "continue", "case")).select("fn", F.col("id").alias("node"), shown.alias("kind"), "texts")
    extra = F.explode(F.array(F.struct(F.concat(F.lit("init:"), "id").alias("node"), F.col("init").alias("text")), F.struct(F.concat(F.lit("update:"), "id").alias("node"), F.col("update").alias("text")))).alias("x")
    extras = every.where("kind = 'for'").select("fn", extra).where("x.text is not null").select("fn", "x.node", F.lit("process").alias("kind"), F.array("x.text").alias("texts"))
    ends_of = firsts.where("parent is null").select("fn", F.explode(F.array(F.lit(ENTRY), F.lit(EXIT))).alias("node")).select("fn", "node", F.col("node").alias("kind"), F.array().cast("array<string>").alias("texts"))
    return nodes.unionByName(extras).unionByName(ends_of), edges


def _whens(pairs, default: Column) -> Column:
    out = default
    for condition, value in reversed(pairs):
        out = F.when(condition, value).otherwise(out)
    return out


# What guards a call, and what ends a lifetime, by kind of syntax node; types without a destructor.
GUARDS = {
    "IfStmt": "if", "ForStmt": "for", "WhileStmt": "while", "DoStmt": "do", "CXXForRangeStmt": "for each", "SwitchStmt": "switch",
    "CaseStmt": "case", "CXXTryStmt": "try", "CXXCatchStmt": "catch", "ConditionalOperator": "?:",
}
SCOPES = {
    "FunctionDecl": "function", "CXXMethodDecl": "function", "CompoundStmt": "block", "IfStmt": "if", "ForStmt": "for", "WhileStmt": "while",
    "CXXForRangeStmt": "for each", "CXXTryStmt": "try", "CXXCatchStmt": "catch",
}
RAISES = 3  # times that calls go up among the rows of their file, each twice as far as before
BUILTIN = r"^(void|bool|char|signed|unsigned|short|int|long|float|double|u?int\d+_t|size_t|ptrdiff_t|auto)\b"


def named(words: dict[str, str], kind: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in words.items() for x in kv)), kind)


def _raised(rows: DataFrame, kept: list[str]) -> DataFrame:
    """rows (file, id, to, guards, kept...) with each `to` moved on to that of the row it names, and that row's guards put before its own.

    A row is sent to where it is and to where it points; both meet there in one order, so rows dealt by file stay where they are.
    """
    goes = F.col("to").isNotNull()
    sent = lambda at, asks: F.struct(F.col(at).alias("_at"), F.lit(asks).alias("_asks"))
    both = rows.withColumn("_s", F.explode(F.when(goes, F.array(sent("id", False), sent("to", True))).otherwise(F.array(sent("id", False)))))
    asks, stays = F.col("_s._asks"), F.col("_s._asks") | F.col("to").isNull()
    both = both.select("file", "id", F.col("_s._at").alias("_at"), asks.alias("_asks"), "to", "guards", *(F.when(stays, F.col(c)).alias(c) for c in kept))
    met = F.max(F.when(~F.col("_asks"), F.struct("to", "guards"))).over(Window.partitionBy("file", "_at").orderBy("_asks").rowsBetween(Window.unboundedPreceding, 0))
    moved = both.withColumn("_t", met).where("_asks or to is null")
    guards = F.when(F.col("_asks") & F.col("_t").isNotNull(), F.concat("_t.guards", "guards")).otherwise(F.col("guards"))
    return moved.select("file", "id", F.when(F.col("_asks"), F.col("_t.to")).alias("to"), guards.alias("guards"), *kept)


def call_sequence(nodes: DataFrame, virtual: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """Rows (file, pos, step, name, line, guards, virtual): the calls of a file by line, with what each is guarded by, from the outside in.

    nodes: file, id, parent, pos (place in the walk), kind, name (of a declaration referred to, or a member), type, line. A call's
    name is that of the declaration its first reference names, perhaps inside a cast; a member call's is its receiver's
    type and the member; a construction's the type's constructor. virtual (name) lists methods known to be so.

    Nodes are dealt by file once, or not at all if they are dealt so already (dealt); all that meets after that is of one file, and
    is matched where it lies. Calls no deeper than 2 ** RAISES nodes are done then; only files with deeper ones are followed on.
    """
    word = named(GUARDS, F.col("kind"))
    is_call = F.col("kind").isin("CallExpr", "CXXOperatorCallExpr", "CXXMemberCallExpr", "CXXConstructExpr")
    # a node meets its children: each goes to its own id and to its parent's
    own, at = F.col("_own"), F.when(F.col("parent").isNotNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    rows = nodes.select("file", "id", "parent", "pos", "kind", "name", "type", "line")
    rows = (rows if dealt else rows.repartition("file")).withColumn("_own", F.explode(at)).withColumn("_at", F.when(own, F.col("id")).otherwise(F.col("parent")))
    first = lambda name, *kinds: F.min(F.when(~own & F.col("kind").isin(*kinds), F.struct("pos", F.col("id").alias("child"), "kind", "name"))).over(met).alias(name)
    met = Window.partitionBy("file", "_at").orderBy("_own").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "file", "id", "parent", "pos", "kind", "type", "line", "_own", first("ref", "DeclRefExpr"), first("direct", "DeclRefExpr", "ImplicitCastExpr"), first("m", "MemberExpr"), F.min(F.when(~own, F.struct("pos", F.col("id").alias("child"), "type"))).over(met).alias("r"),
    ).where(own & (F.col("r").isNotNull() | is_call))
    # a call meets what its cast or member has inside
    inner, kind = F.col("r").isNotNull(), F.col("kind")
    tells = inner & kind.isin("MemberExpr", "ImplicitCastExpr") & F.col("parent").isNotNull()
    bare = bare_type(F.coalesce(F.when(kind == "CXXConstructExpr", F.col("type")).otherwise(F.col("r.type")), F.lit("")))  # once a row, before it is sorted
    rows = rows.withColumn("type", F.when(tells | (kind == "CXXConstructExpr"), F.nullif(bare, F.lit(""))))
    rows = rows.withColumn("_own", F.explode(F.when(tells, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))).withColumn("_at", F.when(own, F.col("id")).otherwise(F.col("parent")))
    told = lambda of: F.min(F.when(~own & (kind == of), F.struct("pos", F.col("id").alias("child"), F.col("ref.name").alias("inside"), F.col("type").alias("receiver")))).over(met)
    rows = rows.withColumn("_m", told("MemberExpr")).withColumn("_c", told("ImplicitCastExpr")).where(own)
    inside = F.when(F.col("_c.child") == F.col("direct.child"), F.col("_c.inside"))
    receiver = F.when(F.col("_m.child") == F.col("m.child"), F.col("_m.receiver"))
    name = (
        F.when(kind == "CXXMemberCallExpr", F.concat(F.coalesce(F.concat(receiver, F.lit("::")), F.lit("")), "m.name"))
        .when(kind == "CXXConstructExpr", F.concat("type", F.lit("::"), F.substring_index("type", "::", -1)))
        .when(is_call, F.when(F.col("direct.kind") == "DeclRefExpr", F.col("direct.name")).otherwise(inside))
    )
    none = F.array().cast("array<string>")
    rows = rows.select("file", "id", F.col("parent").alias("to"), F.when(inner & word.isNotNull(), F.array(word)).otherwise(none).alias("guards"), name.alias("name"), "pos", "line", (kind == "CXXMemberCallExpr").alias("_member"), inner.alias("_inner"))
    rows = rows.where("_inner or name is not null").drop("_inner")
    kept = ["name", "pos", "line", "_member"]
    for _ in range(RAISES):
        rows = _raised(rows, kept)
    named_ = F.col("name").isNotNull()
    step = F.row_number().over(Window.partitionBy("file", named_).orderBy("line", "pos")) - 1
    deep = F.max(F.col("to").isNotNull() & named_).over(Window.partitionBy("file"))
    rows = cut(rows.withColumn("step", step.cast("long")).withColumn("_deep", deep).where(named_ | F.col("_deep")))
    steps = rows.where(named_)
    if not rows.where("_deep").isEmpty():
        above = followed(rows.where("_deep"), ["file"], "id", "to", {"guards": lambda a, b: F.concat(b, a)})
        met_ = steps.where("_deep").drop("guards").join(above.select("file", "id", "guards").hint("merge"), ["file", "id"])
        steps = steps.where("not _deep").unionByName(met_)
    if virtual is None:
        known = steps.withColumn("virtual", F.lit(False))
    else:
        known = steps.join(virtual.select("name").distinct().withColumn("_v", F.lit(True)), "name", "left").withColumn("virtual", F.col("_member") & F.coalesce("_v", F.lit(False)))
    return known.select("file", "pos", "step", "name", "line", "guards", "virtual")


def scoped(nodes: DataFrame, some: DataFrame, through: str | None = None) -> DataFrame:
    """some (file, id, parent, ...) of the nodes with `scope`, the id of the next scope around each, and `scope_end`, its last line; null if there is none.

    Most have it as their parent, or as that of the statement around them, if `through` names the kind of such statements. Only if any
    has not, the nodes between scopes are followed, those that have children.
    """
    is_scope = F.col("kind").isin(*SCOPES)
    scopes = nodes.where(is_scope).select("file", F.col("id").alias("parent"), F.col("id").alias("scope"), F.col("end").alias("scope_end"))
    near = scopes
    if through is not None:
        around = nodes.where((F.col("kind") == through) & ~is_scope).select("file", "parent", "id").join(scopes.hint("merge"), ["file", "parent"])
        near = scopes.unionByName(around.select("file", F.col("id").alias("parent"), "scope", "scope_end"))
    met = cut(some.join(near.hint("merge"), ["file", "parent"], "left"))
    away = F.col("scope").isNull() & F.col("parent").isNotNull()
    if met.where(away).isEmpty():
        return met
    inner = nodes.where("parent is not null").select("file", F.col("parent").alias("id")).distinct()
    between = nodes.where(~is_scope).select("file", "id", "parent").join(inner.hint("merge"), ["file", "id"], "left_semi")
    chain = between.join(scopes.hint("merge"), ["file", "parent"], "left").select("file", "id", F.when(F.col("scope").isNull(), F.col("parent")).alias("to"), "scope", "scope_end")
    nearest = lambda a, b: F.coalesce(a, b)
    found = followed(chain, ["file"], "id", "to", {"scope": nearest, "scope_end": nearest}).select("file", F.col("id").alias("parent"), "scope", "scope_end")
    return met.where(~away).unionByName(met.where(away).drop("scope", "scope_end").join(found.hint("merge"), ["file", "parent"], "left"))


def lifetimes(nodes: DataFrame, types: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scopes, objects, dangling) of syntax nodes.

    nodes: file, id, parent, pos, kind, name, type, begin, end (lines), storage, init. scopes: file, id, parent (the next scope
    around), kind, begin, end. objects: file, id, name, type, scope, constructed, destroyed (the line where the scope ends; -1 for
    static and heap objects), rank (0 is destroyed first: the reverse of construction in the scope), storage,
    has_destructor. dangling: file, id, name, line of references that are bound to what a call returns. Variables
    outside of a scope, and of types that are no record, are not tracked. types (qualified, name, has_destructor) tells
    which types have a destructor; others, and all without it, are taken to have one.
    """
    return scopes(nodes), objects(nodes, types), dangling(nodes)


def scopes(nodes: DataFrame) -> DataFrame:
    """The scopes of lifetimes()."""
    own = nodes.where(F.col("kind").isin(*SCOPES)).select("file", "id", "parent", "kind", "begin", "end")
    return scoped(nodes, own).select("file", "id", F.col("scope").alias("parent"), named(SCOPES, F.col("kind")).alias("kind"), "begin", "end")


def _variable() -> Column:
    return (F.col("kind") == "VarDecl") & F.col("name").isNotNull()


def objects(nodes: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """The objects of lifetimes()."""
    type_ = F.coalesce("type", F.lit(""))
    bare = bare_type(type_)
    is_record = (bare != "") & ~bare.rlike(BUILTIN) & ~type_.contains("*")
    variable = _variable()
    static = F.col("storage") == "static"
    shown = F.when(variable, F.when(F.coalesce(static, F.lit(False)), "static").otherwise("automatic")).when(F.col("kind") == "CXXNewExpr", "dynamic").when(F.col("kind") == "MaterializeTemporaryExpr", "temporary")
    tracked = nodes.withColumn("kept", shown).where(F.col("kept").isNotNull() & (~variable | is_record)).select("file", "id", "parent", "pos", "name", "type", "begin", "kept")
    tracked = scoped(nodes, tracked, "DeclStmt").where(F.col("scope").isNotNull() | ~F.col("kept").isin("static", "automatic"))
    by = Window.partitionBy("file", "scope", "kept")
    n_before = F.row_number().over(Window.partitionBy("file", "scope", F.col("kept").isin("static", "automatic")).orderBy("pos")) - 1
    rank = F.when(F.col("kept") == "automatic", F.count(F.lit(1)).over(by) - F.row_number().over(by.orderBy("begin", "pos"))).when(F.col("kept") == "static", n_before).otherwise(-1)
    destroyed = F.when(F.col("kept") == "automatic", F.col("scope_end")).when(F.col("kept") == "temporary", F.col("begin")).otherwise(-1)
    name = F.when(F.col("kept") == "dynamic", "(heap)").when(F.col("kept") == "temporary", "(temporary)").otherwise(F.col("name"))
    dealt = tracked.repartition("file", "scope")  # for all windows
    out = dealt.select("file", "id", name.alias("name"), bare.alias("type"), "scope", F.col("begin").alias("constructed"), destroyed.alias("destroyed"), rank.cast("long").alias("rank"), F.col("kept").alias("storage"))
    names = out.columns
    if types is None:
        out = out.withColumn("has_destructor", F.lit(True))
    else:
        whole = types.groupBy(F.col("qualified").alias("type")).agg(F.min_by("has_destructor", "ord").alias("_a"), F.min("ord").alias("_oa"))
        short = types.groupBy(F.col("name").alias("_short")).agg(F.min_by("has_destructor", "ord").alias("_b"), F.min("ord").alias("_ob"))
        # told once a type, not once an object: a few types may have nearly all objects
        own = tracked.select(bare.alias("type")).distinct().withColumn("_short", F.element_at(F.split("type", "::"), -1)).join(whole, "type", "left").join(short, "_short", "left")
        first = F.when(F.col("_ob").isNull() | (F.col("_oa") <= F.col("_ob")), F.col("_a")).otherwise(F.col("_b"))
        told = cut(own.select("type", F.coalesce(first, F.lit(True)).alias("has_destructor")))
        out = out.join(told, "type", "left").select(*names, "has_destructor")
    return out


def dangling(nodes: DataFrame) -> DataFrame:
    """The dangling references of lifetimes()."""
    calls = nodes.where(F.col("kind").isin("CallExpr", "CXXMemberCallExpr")).select("file", F.col("parent").alias("id")).distinct()
    bound = nodes.where(_variable() & F.col("type").contains("&") & (F.col("init") == "c")).select("file", "id", "parent", "name", F.col("begin").alias("line"))
    return scoped(nodes, bound.join(calls.hint("merge"), ["file", "id"], "left_semi"), "DeclStmt").where("scope is not null").select("file", "id", "name", "line")
