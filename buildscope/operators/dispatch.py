"""Virtual dispatch over class models: who may be called (G9), what speaks for it (G10), and call graphs with the targets.

A model has four tables. types: id, name, qualified, is_abstract, ord (place in the model).
relations: src, dst, kind, ord; an inheritance goes from the derived type to its base. members:
type_id, ord, name, type. methods: type_id, ord, name, n_params, is_virtual, is_pure.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

# Relations by which one type holds another.
HOLDING = ("composition", "aggregation", "association")


@dataclass
class Model:
    types: DataFrame
    relations: DataFrame
    members: DataFrame
    methods: DataFrame


def derived(relations: DataFrame) -> DataFrame:
    """Edges (base, type) of the hierarchy. They grow with the model and are merged in every round, never broadcast."""
    return relations.where("kind = 'inheritance'").select(F.col("dst").alias("base"), F.col("src").alias("type")).distinct()


def subtrees(relations: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (root, type, depth): all types below each root (column id), itself included, and the least number of steps.

    Only pairs that the last round found are extended, and only a type with several bases can have been met before (or
    the root itself, in a circle): of those alone pairs are compared with the ones found, and a hierarchy that runs in a circle ends.
    """
    edges = derived(relations)
    several = edges.groupBy("type").agg((F.count(F.lit(1)) > 1).alias("several"))
    edges = cut(edges.join(several, "type"))  # read in every round
    front = cut(roots.select(F.col("id").alias("root")).distinct().select("root", F.col("root").alias("type"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("several")))
    parts, depth = [front], 0
    while not front.isEmpty():
        depth += 1
        step = front.select("root", F.col("type").alias("base")).join(edges.hint("merge"), "base").where("type <> root").select("root", "type", "several")
        again = step.where("several").distinct()
        if depth > 1:
            again = again.join(reduce(DataFrame.unionByName, parts).where("several").select("root", "type").hint("merge"), ["root", "type"], "left_anti")
        front = cut(step.where("not several").unionByName(again).select("root", "type", F.lit(depth).cast("long").alias("depth"), "several"))
        parts.append(front)
    return reduce(DataFrame.unionByName, parts).drop("several")


def evidence(model: Model) -> DataFrame:
    """Rows (id, reason, holder, member) for each type: abstract, member, held or none, the first that is true.

    A member speaks for every type whose name its own type mentions as a word, the first member
    in model order; else the first relation that holds the type. holder is the qualified name of the type
    that has it, member the member's name or the relation's kind. Mentions meet by their first word, and each
    word's first member is found before, so a word in every member is one row.
    """
    types, members = model.types, model.members
    named = types.select(F.col("id").alias("type_id"), F.col("ord").alias("holder_ord"), F.col("qualified").alias("holder"))
    spoken = members.join(named, "type_id").select(F.struct("holder_ord", "ord").alias("at"), "holder", F.col("name").alias("member"), F.col("type").alias("text"))
    words = spoken.withColumn("word", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), 0))))
    first = F.min(F.struct("at", "holder", "member")).alias("mention")
    own = types.select("id", F.col("name").alias("type_name"), F.regexp_extract("name", r"\w+", 0).alias("word"))
    plain = own.where("type_name = word").join(words.groupBy("word").agg(first), "word").select("id", "mention")
    # names such as List<int>, which are more than one word
    quoted = F.concat(F.lit(r"\b\Q"), "type_name", F.lit(r"\E\b"))
    other = own.where("type_name <> word").join(words, "word").where(F.regexp_like("text", quoted)).groupBy("id").agg(first)
    held = model.relations.where(F.col("kind").isin(*HOLDING)).groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("ord", "src", "kind")).alias("held"))
    holders = types.select(F.col("id").alias("src"), F.col("qualified").alias("owner"))
    held = held.select("id", F.col("held.src").alias("src"), F.col("held.kind").alias("held_kind")).join(holders, "src", "left").drop("src")
    every = types.select("id", "is_abstract").join(plain.unionByName(other), "id", "left").join(held, "id", "left")
    reason = F.when(F.col("is_abstract"), "abstract").when(F.col("mention").isNotNull(), "member").when(F.col("held_kind").isNotNull(), "held").otherwise("none")
    return every.withColumn("reason", reason).select(
        "id",
        "reason",
        F.when(F.col("reason") == "member", F.col("mention.holder")).when(F.col("reason") == "held", F.coalesce("owner", F.lit("another type"))).alias("holder"),
        F.when(F.col("reason") == "member", F.col("mention.member")).when(F.col("reason") == "held", F.col("held_kind")).alias("member"),
    )


def resolve(model: Model, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, candidates) for requests (static_type, method, arity), each once; a null arity fits every overload.

    calls: static_type, method, arity, resolution, certainty, n. candidates: static_type, method, arity, rank, target,
    type, reason, strength. A method that is not virtual is the only, exact, target. Else every
    method that is not pure, of a type that is not abstract, at or below the static type is one; those of types
    that something speaks for come first. One target: devirtualised; several, some of them without a reason:
    rta; several else: cha; none, or a type that the model has not: unresolved.
    """
    key = ["static_type", "method", "arity"]
    asked = cut(requests.select(F.col("static_type"), F.col("method"), F.col("arity").cast("long").alias("arity")).distinct())
    bases = model.types.groupBy(F.col("qualified").alias("static_type")).agg(F.min_by("id", "ord").alias("root"))
    every = F.array_sort(F.collect_list(F.struct("ord", "n_params", "is_virtual", "is_pure")))
    methods = model.methods.groupBy(F.col("type_id").alias("type"), F.col("name").alias("method")).agg(every.alias("overloads"))
    first = lambda arity: F.get(F.filter("overloads", lambda m: arity.isNull() | (m["n_params"] == 0) | (m["n_params"] == arity)), F.lit(0))
    exactly = lambda a: F.coalesce(~first(a["arity"])["is_virtual"], F.lit(False))
    # a row a method of a static type, with the arities that are asked of it: those that its own method settles, and the others
    wanted = asked.join(bases, "static_type").groupBy("root", "static_type", "method").agg(F.collect_list(F.struct("arity")).alias("arities"))
    wanted = wanted.join(methods.withColumnRenamed("type", "root"), ["root", "method"], "left")
    wanted = cut(wanted.select("root", "static_type", "method", F.filter("arities", exactly).alias("exact"), F.filter("arities", lambda a: ~exactly(a)).alias("open")))
    exact = wanted.select("static_type", "method", F.explode("exact").alias("a")).select("static_type", "method", "a.arity", F.col("static_type").alias("type"), F.lit("not virtual").alias("reason"))
    asked_below = wanted.where(F.size("open") > 0).select("root", "static_type", "method", "open")
    below = subtrees(model.relations, asked_below.select(F.col("root").alias("id"))).select("root", "type")
    # what a type answers is told before it meets the types above it; rows meet once more, by method of a static type, and are counted and ranked there
    known = evidence(model).select(F.col("id").alias("type"), "reason").where("reason <> 'abstract'").join(model.types.select(F.col("id").alias("type"), F.col("qualified").alias("owner")), "type")
    answers = cut(methods.where(F.exists("overloads", lambda m: ~m["is_pure"])).join(known, "type"))
    met = below.join(answers.hint("merge"), "type").select("root", "method", "owner", "reason", "overloads").join(asked_below.hint("merge"), ["root", "method"])
    found = met.select("root", "static_type", "method", "owner", "reason", "overloads", F.explode("open").alias("a")).select("*", "a.arity").where(~first(F.col("arity"))["is_pure"])
    found = found.select("root", *key, F.col("owner").alias("type"), "reason", F.when(F.col("reason").isin("member", "held"), "strong").otherwise("none").alias("strength"))
    counts = found.groupBy("root", *key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("strength") == "strong").alias("strong")).drop("root")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    tally = lambda rows, n, strong, is_exact: rows.select(*key, n.alias("n"), strong.alias("strong"), F.lit(is_exact).alias("exact"))
    told = tally(asked, zero, zero, False).unionByName(tally(exact, one, one, True)).unionByName(tally(counts, F.col("n"), F.col("strong"), False))
    told = told.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("strong").alias("strong"), F.max("exact").alias("exact"))
    n = F.col("n")
    resolution = F.when(F.col("exact"), "exact").when(n == 0, "unresolved").when(n == 1, "devirtualised").when((F.col("strong") > 0) & (F.col("strong") < n), "rta").otherwise("cha")
    certainty = F.when(F.col("resolution").isin("exact", "devirtualised"), "certain").when(F.col("resolution") == "unresolved", "unknown").otherwise("bounded")
    calls = told.withColumn("resolution", resolution).select(*key, "resolution", certainty.alias("certainty"), n.alias("n"))
    order = Window.partitionBy("root", *key).orderBy(F.desc("strength"), "type")
    ranked = found.withColumn("rank", F.row_number().over(order)).drop("root").unionByName(exact.withColumns({"strength": F.lit("strong"), "rank": F.lit(1)}))
    return calls, ranked.select(*key, "rank", F.concat("type", F.lit("::"), "method").alias("target"), "type", "reason", "strength")


def expand(model: Model, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a call graph with the targets of virtual methods; nodes (node), edges (src, dst, resolution).

    An edge into a virtual method stays and becomes cha, or unresolved; from the method new edges go
    to its targets, rta, or devirtualised if there is one only, and never twice between two nodes.
    Of overloads the model's last says whether the name is virtual.
    """
    named = model.methods.join(model.types.select(F.col("id").alias("type_id"), F.col("ord").alias("type_ord"), "qualified"), "type_id")
    slots = named.groupBy(F.concat("qualified", F.lit("::"), "name").alias("dst")).agg(F.max_by(F.struct("qualified", "name", "is_virtual"), F.struct("type_ord", "ord")).alias("m"))
    slots = slots.where("m.is_virtual").select("dst", F.col("m.qualified").alias("static_type"), F.col("m.name").alias("method")).join(edges.select("dst").distinct(), "dst")
    calls, targets = resolve(model, slots.select("static_type", "method", F.lit(None).cast("long").alias("arity")))
    said = cut(slots.join(calls.where("resolution <> 'exact'").drop("arity"), ["static_type", "method"]).select("dst", "static_type", "method", F.col("resolution").alias("said")))
    changed = edges.join(said.select("dst", "said"), "dst", "left").select("src", "dst", F.when(F.col("said") == "unresolved", "unresolved").when(F.col("said").isNotNull(), "cha").otherwise(F.col("resolution")).alias("resolution"))
    new = said.join(targets.select("static_type", "method", "target"), ["static_type", "method"]).where("target <> dst")
    new = new.select(F.col("dst").alias("src"), F.col("target").alias("dst"), F.when(F.col("said") == "devirtualised", "devirtualised").otherwise("rta").alias("resolution"))
    added = new.distinct().join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return nodes.select("node").unionByName(new.select(F.col("dst").alias("node"))).distinct(), changed.unionByName(added)


def tables_of_targets(model: Model) -> DataFrame:
    """Rows (type, method, target): the method that an object of the type answers with: its own, else that of the nearest base, of equally near ones the first in the model.

    A round hands what the last one found on to the types derived from it that have no answer yet: what is nearest to a type is
    nearest to one of its bases too, so each method of a type is handed on once.
    """
    names = model.types.select(F.col("id").alias("type"), "qualified", F.col("ord").alias("place"))
    own = model.methods.where("not is_pure").select(F.col("type_id").alias("type"), F.col("name").alias("method")).distinct().join(names, "type")
    front = cut(own.select("type", "method", "place", F.concat("qualified", F.lit("::"), "method").alias("target")))
    edges, done = cut(derived(model.relations)), front
    while not front.isEmpty():
        step = front.withColumnRenamed("type", "base").join(edges.hint("merge"), "base").join(done.select("type", "method").hint("merge"), ["type", "method"], "left_anti")
        front = cut(step.groupBy("type", "method").agg(F.min(F.struct("place", "target")).alias("t")).select("type", "method", "t.*"))
        done = done.unionByName(front)
    return done.select("type", "method", "target")


def live(model: Model, direct: DataFrame, virtual: DataFrame, creates: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(functions, types) that the roots (column node) reach, each needing the other: rapid type analysis.

    direct (src, dst) are plain calls, virtual (src, static_type, method) calls through a method, creates (src, type)
    where a function makes an object of a type; types are ids. A function is reached by a plain call, or if a
    reached function calls a method through a type at or above a live type that answers with it; a type is live when a
    reached function makes it. A round takes only what the last one found; methods that are called go down one step of
    the hierarchy a round, so a method of a type is handed on once, whatever the types above through which it is called.
    """
    answers, edges = cut(tables_of_targets(model)), cut(derived(model.relations))

    def new(rows: DataFrame, seen: DataFrame | None) -> DataFrame:
        rows = rows.distinct()
        return cut(rows if seen is None else rows.join(seen.hint("merge"), rows.columns, "left_anti"))

    def joined(seen: DataFrame | None, rows: DataFrame) -> DataFrame:
        return rows if seen is None else cut(seen.unionByName(rows))

    reached = front = new(roots.select("node"), None)
    called = types = fresh_called = None  # called: the methods (type, method) that are called through the type or one above it
    while not front.isEmpty() or (fresh_called is not None and not fresh_called.isEmpty()):
        by = front.withColumnRenamed("node", "src")
        slots = virtual.join(by, "src", "left_semi").select(F.col("static_type").alias("type"), "method")
        if fresh_called is not None:
            slots = slots.unionByName(fresh_called.withColumnRenamed("type", "base").join(edges.hint("merge"), "base").select("type", "method"))
        fresh_called = new(slots, called)
        fresh_types = new(creates.join(by, "src", "left_semi").select("type"), types)
        all_types = joined(types, fresh_types)
        pairs = fresh_called.join(all_types, "type", "left_semi")
        if called is not None:
            pairs = pairs.unionByName(called.join(fresh_types, "type", "left_semi"))
        dispatched = pairs.join(answers.hint("merge"), ["type", "method"]).select(F.col("target").alias("node"))
        front = new(direct.join(by, "src", "left_semi").select(F.col("dst").alias("node")).unionByName(dispatched), reached)
        called, types, reached = joined(called, fresh_called), all_types, joined(reached, front)
    return reached, types if types is not None else creates.select("type").limit(0)
