"""Hops: one step of a path as joins on ids.

Descendants and ancestors join on the ancestor list of a node, which every node carries, so that no hop is a
join by range: the list is exploded, which makes as many rows as the tree is deep.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lang.ast import Lit, Range
from ..plans.state import CompileError, Key, Node, State, fresh
from ..sources.model import Arbor, Mount, Table, Tables
from .ordinals import with_ordinals

NODE_COLUMNS = ("id", "parent", "name", "sib", "n_sib", "depth", "n_children", "n_descendants", "ancestors", "traits", "value", "props", "meta", "locator")


def glob_regex(text: str) -> str:
    return "^" + ".*".join(re.escape(p) for p in text.split("*")) + "$"


def matches(matcher, column):
    """The matcher as a condition on a name, or None for any."""
    if matcher.kind == "name":
        return column == matcher.text
    if matcher.kind == "glob":
        return column.rlike(glob_regex(matcher.text))
    if matcher.kind == "regex":
        return column.rlike(matcher.text)
    return None


def trait_condition(traits, column):
    out = F.lit(True)
    for clause in traits:
        either = F.lit(False)
        for negated, name in clause:
            has = F.size(column) > 0 if name == "*" else F.array_contains(column, name)
            either = either | (~has if negated else has)
        out = out & F.coalesce(either, F.lit(False))
    return out


def aliased(df: DataFrame, columns, prefix: str) -> tuple[DataFrame, dict[str, str]]:
    names = {c: f"{prefix}_{c}" for c in columns}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def table_rows(table: Table, catalog: Tables) -> tuple[DataFrame, Node]:
    df, names = aliased(table.df, table.df.columns, fresh("t"))
    return df, Node("row", table, names, catalog)


def arbor_nodes(arbor: Arbor) -> tuple[DataFrame, Node]:
    df, names = aliased(arbor.nodes, NODE_COLUMNS, fresh("n"))
    return df, Node("arbor", arbor, names, arbor)


def name_of(node: Node):
    if node.kind == "row":
        table = node.source
        return node.col(table.key).cast("string") if table.key else F.lit("row") if node.catalog.rows else F.lit(None).cast("string")
    return node.col("name")


class Hops:
    """Mixin of the compiler: applies steps to a state."""

    def start(self, spark) -> State:
        return State(spark.range(1).select(F.lit(0).alias(fresh("root"))), Node("root", self.source, {}, self.source))

    def hop(self, st: State, step) -> State:
        if step.axis == "mark":
            return st.but(marks=(*[m for m in st.marks if m[0] != step.prop], (step.prop, st.node)))
        if step.axis == "group":
            return self.group_hop(st, step)
        node = st.node
        if node is None:
            raise CompileError("a path needs a node to start at")
        if node.kind == "root":
            out = self.from_root(st, step)
        elif node.kind == "tables":
            raise CompileError("name the table whose rows are meant")
        elif node.kind == "table":
            out = self.from_table(st, step)
        elif node.kind == "row":
            out = self.from_row(st, step)
        else:
            out = self.from_arbor(st, step)
        return self.keep(out, step, st)

    def keep(self, out: State, step, before: State) -> State:
        """Traits, the leaf mark, predicates, and then reach."""
        node = out.node
        if step.traits:
            traits = node.col("traits") if node.kind == "arbor" else F.array(F.lit(node.kind))
            out = out.but(df=out.df.where(trait_condition(step.traits, traits)))
        if step.leaf and node.kind == "arbor":
            out = out.but(df=out.df.where(node.col("n_children") == 0))
        elif step.leaf and node.kind in ("table", "root"):
            out = out.but(df=out.df.where(F.lit(False)))
        for pred in step.preds:
            if isinstance(pred, (Range, Lit)) and (isinstance(pred, Range) or type(pred.value) is int):
                out = self.position(out, pred, before)
            else:
                out = self.filter(out, pred, navigation=True)
        if step.reach:
            by = [F.col(k.name) for k in before.order]
            far = self.distance
            w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
            name = fresh("d")
            df = out.df.withColumn(name, (F.min if step.reach == "?" else F.max)(far).over(w)).where(F.col(name) == far)
            out = out.but(df=df.drop(name))
        return out

    def position(self, out: State, pred, before: State) -> State:
        """[n] and [a..b] among the results of each source node."""
        low, high = (pred.low, pred.high) if isinstance(pred, Range) else (pred.value, pred.value)
        if not before.order:  # one source: the result is a prefix or a suffix of the order
            return self.slice(out, low, high)
        w = Window.partitionBy(*[F.col(k.name) for k in before.order])
        place, count = fresh("at"), fresh("of")
        df = out.df.withColumn(place, F.row_number().over(w.orderBy(*out.sorts())))
        if any(x is not None and x < 0 for x in (low, high)):
            df = df.withColumn(count, F.count(F.lit(1)).over(w))
        end = lambda x: F.lit(x) if x >= 0 else F.col(count) + x + 1
        if low is not None:
            df = df.where(F.col(place) >= end(low))
        if high is not None:
            df = df.where(F.col(place) <= end(high))
        return out.but(df=df.drop(place, count))

    # -- from the root, tables and rows

    def from_root(self, st: State, step) -> State:
        source = st.node.source
        if isinstance(source, Mount):
            if step.axis != "child" or step.matcher.kind != "name":
                raise CompileError("name the mounted source first")
            if step.matcher.text not in source.sources:
                raise CompileError(f"no source is named {step.matcher.text!r}")
            inner = source.sources[step.matcher.text]
            if isinstance(inner, Arbor):
                return self.arbor_root(st, inner)
            return st.but(node=Node("root", inner, {}, inner))
        if isinstance(source, Arbor):
            return self.from_arbor(self.arbor_root(st, source), step)
        if source.rows:
            if step.axis not in ("child", "desc") or step.matcher.kind == "name" and step.matcher.text != "row":
                return self.scan(st, source.tables[source.rows], source, F.lit(False))
            return self.scan(st, source.tables[source.rows], source)
        if step.axis == "child" and step.matcher.kind == "name":
            if step.matcher.text not in source.tables:
                raise CompileError(f"no table is named {step.matcher.text!r}")
            return st.but(node=Node("table", source.tables[step.matcher.text], {}, source))
        if step.axis == "child":
            name = fresh("table")
            rows = [(t,) for t in sorted(source.tables)]
            df = st.df.sparkSession.createDataFrame(rows, f"{name} string")
            condition = matches(step.matcher, F.col(name))
            return State(df if condition is None else df.where(condition), Node("tables", source, {"name": name}, source), order=(Key(name),), outer=st.outer)
        raise CompileError("a catalog is walked table by table")

    def arbor_root(self, st: State, arbor: Arbor) -> State:
        df, node = arbor_nodes(arbor)
        return State(df.where(node.col("id") == arbor.root), node, order=(), outer=st.outer)

    def scan(self, st: State, table: Table, catalog: Tables, condition=None) -> State:
        df, node = table_rows(table, catalog)
        if condition is not None:
            df = df.where(condition)
        return State(df, node, order=tuple(Key(node.columns[c]) for c in table.order), outer=st.outer)

    def from_table(self, st: State, step) -> State:
        table = st.node.source
        if step.axis == "parent":
            return st.but(node=Node("root", st.node.catalog, {}, st.node.catalog))
        if step.axis not in ("child", "desc"):
            raise CompileError(f"a table has no {step.axis} axis")
        out = self.scan(st, table, st.node.catalog)
        if step.matcher.kind != "any":
            name = name_of(out.node)
            if step.matcher.kind == "name" and table.key:
                kind = dict(table.df.dtypes)[table.key]
                condition = out.node.col(table.key) == F.lit(step.matcher.text).cast(kind)
            else:
                condition = matches(step.matcher, name)
            out = out.but(df=out.df.where(F.coalesce(condition, F.lit(False))))
        return out

    def from_row(self, st: State, step) -> State:
        node, table = st.node, st.node.source
        if step.axis == "child":  # cells: the columns that aren't null
            columns = [c for c in table.df.columns if not c.startswith("_") and (step.matcher.kind == "any" or re.search({"name": "^" + re.escape(step.matcher.text) + "$", "glob": glob_regex(step.matcher.text), "regex": step.matcher.text}[step.matcher.kind], c))]
            if not columns:
                columns, st = table.df.columns[:1], st.but(df=st.df.where(F.lit(False)))
            cell = fresh("cell")
            items = F.array(*[F.struct(F.lit(i + 1).alias("sib"), F.lit(c).alias("name"), node.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
            df = st.df.withColumn(cell, F.explode(F.filter(items, lambda x: x["value"].isNotNull())))
            names = {}
            for c, e in (("id", F.lit(None).cast("long")), ("parent", F.lit(None).cast("long")), ("name", F.col(cell)["name"]), ("sib", F.col(cell)["sib"]), ("n_sib", F.lit(len(columns))), ("depth", F.lit(3)), ("n_children", F.lit(0)), ("n_descendants", F.lit(0).cast("long")), ("ancestors", F.lit(None).cast("array<long>")), ("traits", F.array(F.lit("cell"))), ("value", F.col(cell)["value"]), ("props", F.lit(None).cast("map<string,string>")), ("meta", F.lit(None).cast("map<string,string>")), ("locator", F.col(cell)["name"])):
                names[c] = fresh(c)
                df = df.withColumn(names[c], e)
            return st.but(df=df, node=Node("arbor", None, names, None), topic=None, order=(*st.order, Key(names["sib"])))
        if step.axis == "parent":
            return st.but(node=Node("table", table, {}, node.catalog))
        if step.axis == "resolve":
            return self.resolve(st, step.prop, step.matcher.text)
        if step.axis == "out":
            return self.links(st, step, True)
        if step.axis in ("in", "rresolve"):
            return self.links(st, step, False)
        if step.axis == "both":
            a, b = self.links(st, step, True), self.links(st, step, False)
            if a.node.source is b.node.source and a.node.source is not None:
                names = {c: a.node.columns[c] for c in a.node.columns}
                b_df = b.df.select(*[F.col(b.node.columns[c]).alias(names[c]) for c in names], *[F.col(c) for c in st.df.columns])
                a_df = a.df.select(*[F.col(names[c]) for c in names], *[F.col(c) for c in st.df.columns])
                return a.but(df=a_df.unionByName(b_df).distinct(), order=(*st.order, *[Key(names[c]) for c in a.node.source.order]))
            if not a.node.source.fks and step.matcher.text in table.fks:
                return a
            return a if step.matcher.text in table.fks else b
        if step.axis in ("next", "prev", "follow", "precede"):
            other, right = table_rows(table, node.catalog)
            mine, place = fresh("at"), fresh("at")
            numbered = with_ordinals(other, [right.col(c) for c in table.order], place)
            key = [right.columns[c] for c in table.order]
            own = numbered.select(*[F.col(k).alias(k + "m") for k in key], F.col(place).alias(mine))
            df = st.df.join(own, [F.col(node.columns[c]) == F.col(k + "m") for c, k in zip(table.order, key, strict=True)]).drop(*[k + "m" for k in key])
            condition = {"next": F.col(place) == F.col(mine) + 1, "prev": F.col(place) == F.col(mine) - 1, "follow": F.col(place) > F.col(mine), "precede": F.col(place) < F.col(mine)}[step.axis]
            self.distance = F.abs(F.col(place) - F.col(mine))
            out = st.but(df=df.join(numbered, condition), node=right, topic=None, order=(*st.order, Key(place, step.axis == "precede")))
            return self.named(out, step)
        raise CompileError(f"a row has no {step.axis} axis")

    def named(self, out: State, step) -> State:
        condition = matches(step.matcher, name_of(out.node))
        return out if condition is None else out.but(df=out.df.where(F.coalesce(condition, F.lit(False))))

    def target(self, node: Node, prop: str, hint: str) -> tuple[Table, str]:
        catalog, table = node.catalog, node.source
        if prop in table.fks and (not hint or table.fks[prop][0] == hint):
            name, column = table.fks[prop]
            return catalog.tables[name], column
        if hint and hint in catalog.tables:
            found = catalog.tables[hint]
            return found, found.key or found.order[0]
        raise CompileError(f"{prop!r} is no foreign key; name its table after the arrow")

    def resolve(self, st: State, prop: str, hint: str, how: str = "inner") -> State:
        """The row that a foreign key refers to: at most one, so the target's keys are made unique unless declared."""
        node = st.node
        if node.kind == "arbor":
            return self.resolve_arbor(st, prop, hint, how)
        table, column = self.target(node, prop, hint)
        df, right = table_rows(table, node.catalog)
        if table.key != column:
            w = Window.partitionBy(right.col(column)).orderBy(*[right.col(c) for c in table.order])
            n = fresh("n")
            df = df.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)
        out = st.df.join(df, node.col(prop) == right.col(column), how)
        return st.but(df=out, node=right, topic=None)

    def links(self, st: State, step, forward: bool) -> State:
        node, label = st.node, step.prop or step.matcher.text
        if forward:
            if step.matcher.kind == "name":
                return self.resolve(st, label, "")
            if len(node.source.fks) == 1:
                return self.resolve(st, next(iter(node.source.fks)), "")
            raise CompileError("name the link: its targets stand in several tables")
        hint = step.matcher.text if step.axis == "rresolve" else ""
        found = [(t, c) for t in node.catalog.tables.values() for c, (to, _) in t.fks.items() if to == node.source.name and (c == label if label else True) and (not hint or t.name == hint)]
        if not found:
            raise CompileError(f"nothing refers to {node.source.name} by {label!r}")
        if len(found) > 1:
            raise CompileError(f"{label!r} refers here from several tables")
        table, column = found[0]
        df, right = table_rows(table, node.catalog)
        out = st.df.join(df, node.col(table.fks[column][1]) == right.col(column))
        self.distance = F.lit(1)
        return st.but(df=out, node=right, topic=None, order=(*st.order, *[Key(right.columns[c]) for c in table.order]))

    # -- arbors

    def from_arbor(self, st: State, step) -> State:
        node, arbor = st.node, st.node.source
        if arbor is None:
            raise CompileError("a cell has no further nodes")
        if step.axis == "resolve":
            return self.resolve_arbor(st, step.prop, step.matcher.text)
        if step.axis in ("out", "in", "both"):
            return self.crosslinks(st, step)
        right_df, right = arbor_nodes(arbor)
        condition = matches(step.matcher, right.col("name"))
        if condition is not None and step.axis not in ("next", "prev"):
            right_df = right_df.where(F.coalesce(condition, F.lit(False)))  # reaches the nodes before the join
        me, there = node.col, right.col
        self.distance = F.abs(there("depth") - me("depth"))
        descending = False
        if step.axis == "child":
            df = st.df.join(right_df, there("parent") == me("id"))
        elif step.axis == "parent":
            df = st.df.join(right_df, there("id") == me("parent"))
        elif step.axis == "desc":
            up = fresh("up")
            df = st.df.join(right_df.withColumn(up, F.explode(there("ancestors"))), F.col(up) == me("id")).drop(up)
        elif step.axis == "anc":
            up = fresh("up")
            df = st.df.withColumn(up, F.explode(me("ancestors"))).join(right_df, F.col(up) == there("id")).drop(up)
            descending = True
        elif step.axis == "rresolve":
            df = st.df.join(right_df, there("props")[step.prop] == me("name"))
        else:
            pair = there("parent") == me("parent")
            where = {"next": there("sib") == me("sib") + 1, "prev": there("sib") == me("sib") - 1, "follow": there("sib") > me("sib"), "precede": there("sib") < me("sib")}[step.axis]
            df = st.df.join(right_df, pair & where)
            if step.axis in ("next", "prev") and condition is not None:
                df = df.where(F.coalesce(condition, F.lit(False)))
            self.distance = F.abs(there("sib") - me("sib"))
            descending = step.axis in ("prev", "precede")
        label = {"child": "[child]", "desc": "[child]", "parent": "[parent]", "anc": "[parent]", "next": "[next]", "follow": "[next]", "prev": "[prev]", "precede": "[prev]"}.get(step.axis, "")
        edge = fresh("edge")
        df = df.withColumn(edge, F.struct(F.lit(label).alias("label"), F.lit(None).cast("map<string,string>").alias("props")))
        return self.first_seen(st.but(df=df, node=right, topic=None, edge=edge, order=(*st.order, Key(right.columns["id"], descending))), st)

    def first_seen(self, out: State, before: State) -> State:
        """Of paths that end at one node with equal registers the first stays: only hops that can merge need it."""
        if not before.order:
            return out
        by = [out.node.col("id"), *[v.col for _, v in out.regs], *[n.col("id") if n.kind == "arbor" else F.lit(0) for _, n in out.marks]]
        n, all_edges = fresh("n"), fresh("edges")
        w = Window.partitionBy(*by)
        df = out.df.withColumn(all_edges, F.collect_list(out.edge).over(w)) if out.edge else out.df
        df = df.withColumn(n, F.row_number().over(w.orderBy(*out.sorts()))).where(F.col(n) == 1).drop(n)
        return out.but(df=df, edges=all_edges if out.edge else None)

    def crosslinks(self, st: State, step) -> State:
        node, arbor = st.node, st.node.source
        if arbor.edges is None:
            raise CompileError("the source has no links")
        right_df, right = arbor_nodes(arbor)
        link = fresh("link")
        edges = arbor.edges.select(F.struct("src", "label", "dst", "props").alias(link))
        condition = matches(step.matcher, F.col(link)["label"])
        if condition is not None:
            edges = edges.where(condition)
        parts = []
        for forward in ((True, False) if step.axis == "both" else (step.axis == "out",)):
            here, there = ("src", "dst") if forward else ("dst", "src")
            parts.append(st.df.join(edges, F.col(link)[here] == node.col("id")).join(right_df, F.col(link)[there] == right.col("id")))
        df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        edge = fresh("edge")
        df = df.withColumn(edge, F.struct(F.col(link)["label"].alias("label"), F.col(link)["props"].alias("props"))).drop(link)
        self.distance = F.lit(1)
        return self.first_seen(st.but(df=df, node=right, topic=None, edge=edge, order=(*st.order, Key(right.columns["id"]))), st)

    def resolve_arbor(self, st: State, prop: str, hint: str, how: str = "inner") -> State:
        """The node that a property names: by link of that label if there are links, else by name or id property."""
        node, arbor = st.node, st.node.source
        right_df, right = arbor_nodes(arbor)
        target = F.coalesce(right.col("props")[arbor.refs], right.col("name")) if arbor.refs else right.col("name")
        one = fresh("one")
        keyed = right_df.withColumn(one, F.row_number().over(Window.partitionBy(target).orderBy(right.col("id")))).where(F.col(one) == 1).drop(one)
        value = F.regexp_replace(node.col("props")[prop], "^#", "")
        return st.but(df=st.df.join(keyed, value == target, how), node=right, topic=None)
