"""From syntax tree to DataFrame.

A query is planned stage by stage; nothing runs but what a pattern's rounds and row numbers need.  Reducers
fuse with the group or window before them, correlated subqueries become aggregates joined on their keys, and
existence tests become semi joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quantity, scalars, temporal
from ..functions.readings import Val, arithmetic, equal, less, literal, number, pushable, rank_key, truth
from ..functions.reducers import REDUCERS, reduce_list, reduce_rows
from ..lang.ast import Call, Inline, Interp, Lit, Op, Outer, Path, Projection, Query, Range, Rec, Ref, Shaped, Stage, Step, Sub, walk
from ..lang.parser import KEYED
from ..operators.axes import Hops, aliased, name_of
from ..operators.ordinals import bounded_window, with_ordinals
from ..operators.patterns import Patterns
from .state import CompileError, Group, Key, Node, State, fresh

LONG, STRING, DOUBLE, BOOL = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()


def conjuncts(expr):
    if isinstance(expr, Op) and expr.op == "and":
        return [x for a in expr.args for x in conjuncts(a)]
    return [expr]


def mentions(node, kind) -> bool:
    return any(isinstance(x, kind) for x in walk(node))


class Compiler(Hops, Patterns):
    def __init__(self, spark, source, now=None):
        self.spark, self.source, self.now = spark, source, now
        self.distance = F.lit(0)

    # -- queries

    def query(self, q: Query, outer: State | None = None) -> State:
        st = self.branches(q, outer)
        for optional, entry in q.correlations:
            st = self.correlate(st, entry, optional)
        return self.stages(st, q.pipeline)

    def branches(self, q: Query, outer: State | None) -> State:
        start = self.start(self.spark).but(outer=outer)
        states = [self.path(start, p) for p in q.branches]
        if len(states) == 1:
            return states[0]
        return self.union(states)

    def union(self, states: list[State]) -> State:
        """Branches one after another; a node that several reach counts once, where it is reached first."""
        first = states[0]
        if any(s.node is None or first.node is None or s.node.source is not first.node.source or s.node.kind != first.node.kind for s in states):
            return self.union_values(states)
        branch, topic = fresh("branch"), fresh("topic")
        names = first.node.columns
        parts = []
        with_topic = any(s.topic is not None for s in states)
        for i, s in enumerate(states):
            columns = [s.node.col(c).alias(n) for c, n in names.items()]
            if with_topic:
                columns.append((s.topic.col if s.topic else F.lit(None)).alias(topic))
            parts.append(s.df.select(*columns, F.lit(i).alias(branch)))
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        order = self.document_order(first.node)
        one = fresh("one")
        identity = [first.node.col(c) for c in (first.node.source.order if first.node.kind == "row" else ("id",))]
        df = df.withColumn(one, F.row_number().over(Window.partitionBy(*identity).orderBy(branch))).where(F.col(one) == 1).drop(one)
        kind = next((s.topic.type for s in states if s.topic), None)
        return State(df, first.node, Val(F.col(topic), kind) if with_topic else None, order=(Key(branch), *order), outer=first.outer)

    def union_values(self, states: list[State]) -> State:
        branch, topic = fresh("branch"), fresh("topic")
        if any(s.topic is None for s in states):
            raise CompileError("branches of different sources need projections")
        kinds = {s.topic.type.simpleString() for s in states}
        text = len(kinds) > 1
        df = None
        for i, s in enumerate(states):
            part = s.df.select((scalars.show(s.topic) if text else s.topic.col).alias(topic), F.lit(i).alias(branch))
            df = part if df is None else df.unionByName(part)
        return State(df, None, Val(F.col(topic), STRING if text else states[0].topic.type), order=(Key(branch),), outer=states[0].outer)

    def document_order(self, node: Node) -> tuple[Key, ...]:
        if node.kind == "row":
            return tuple(Key(node.columns[c]) for c in node.source.order)
        return (Key(node.columns["id"]),) if node.kind == "arbor" else ()

    def path(self, st: State, path: Path) -> State:
        if path.anchor and path.anchor[0] == "root":
            st = self.start(self.spark).but(outer=st.outer, regs=())
        elif path.anchor:
            st = st.but(node=self.mark(st, path.anchor[1]), topic=None)
        for step in path.steps:
            st = self.hop(st, step)
        if path.projection is not None:
            v = self.project(st, path.projection)
            st, v = st.add(v)
            st = st.but(topic=v)
        return st

    def mark(self, st: State, name: str) -> Node:
        marks = list(st.marks)
        if name.isdigit():
            if not 0 < int(name) <= len(marks):
                raise CompileError(f"there is no mark {name}")
            return marks[int(name) - 1][1]
        for n, node in reversed(marks):
            if n == name or name == ".":
                return node
        raise CompileError(f"no mark is named {name!r}")

    def project(self, st: State, p: Projection) -> Val:
        node = st.node
        if node is None:
            return Val(F.lit(None).cast("string"), STRING)
        if p.kind == "prop":
            if node.kind == "row":
                if p.name not in node.columns:
                    raise CompileError(f"{node.source.name} has no column {p.name!r}")
                return Val(node.col(p.name), node.source.df.schema[p.name].dataType)
            if node.kind == "arbor":
                return Val(node.col("props")[p.name], STRING)
            return Val(F.lit(None).cast("string"), STRING)
        if p.kind == "default":
            if node.kind == "arbor":
                return Val(node.col("value"), STRING)
            return Val(F.lit(None).cast("string"), STRING)
        if p.kind == "ameta":
            return self.adapter_meta(node, p.name)
        return self.core_meta(node, p.name)

    def adapter_meta(self, node: Node, name: str) -> Val:
        if node.kind == "arbor":
            return Val(node.col("meta")[name], STRING)
        if node.kind == "row":
            known = {"table": node.source.name, **node.source.meta}
            return literal(known[name]) if name in known else Val(F.lit(None).cast("string"), STRING)
        table = node.source if node.kind == "table" else node.source.tables.get(node.source.rows) if getattr(node.source, "rows", "") else None
        if table is not None and name == "n-rows":
            return literal(table.df.count())
        if table is not None and name == "columns":
            return literal(", ".join(c for c in table.df.columns if not c.startswith("_")))
        return Val(F.lit(None).cast("string"), STRING)

    def core_meta(self, node: Node, name: str) -> Val:
        if node.kind == "row":
            table = node.source
            path = F.concat(F.lit("" if node.catalog.rows else f"/{table.name}"), F.lit("/"), F.coalesce(name_of(node), F.lit("")))
            depth = 1 if node.catalog.rows else 2
            known = {"name": (name_of(node), STRING), "depth": (F.lit(depth).cast("long"), LONG), "name-path": (path, STRING), "parent-name": (F.lit(None if node.catalog.rows else table.name).cast("string"), STRING), "is-root": (F.lit(False), BOOL), "is-leaf": (F.lit(not table.df.columns), BOOL), "is-top-level": (F.lit(depth == 1), BOOL), "is-non-tree": (F.lit(False), BOOL), "traits": (F.array(F.lit("row")), T.ArrayType(STRING))}
        elif node.kind == "arbor":
            c = node.col
            known = {
                "name": (c("name"), STRING), "id": (c("id"), LONG), "index": (c("sib").cast("long"), LONG), "depth": (c("depth").cast("long"), LONG), "parent-id": (c("parent"), LONG),
                "n-children": (c("n_children").cast("long"), LONG), "n-descendants": (c("n_descendants"), LONG), "n-siblings": ((c("n_sib") - 1).cast("long"), LONG), "traits": (c("traits"), T.ArrayType(STRING)),
                "is-leaf": (c("n_children") == 0, BOOL), "is-root": (c("parent").isNull(), BOOL), "is-first-child": (c("sib") == 1, BOOL), "is-last-child": (c("sib") == c("n_sib"), BOOL), "is-top-level": (c("depth") == 1, BOOL), "is-non-tree": (F.lit(False), BOOL),
                "name-path": (c("locator"), STRING), "id-path": (F.array_join(F.transform(F.array_append(c("ancestors"), c("id")), lambda x: x.cast("string")), "/"), STRING), "parent-name": (F.try_element_at(F.split(c("locator"), "/"), F.lit(-2)), STRING),
                "source": (c("meta")["source"], STRING), "instant": (c("meta")["instant"], STRING), "dpid": (c("meta")["dpid"], STRING),
                "provenance": (F.concat(F.coalesce(F.concat(F.lit("?"), c("meta")["source"]), F.lit("")), F.coalesce(F.concat(F.lit("@"), c("meta")["instant"]), F.lit("")), F.coalesce(F.concat(F.lit("#"), c("meta")["dpid"]), F.lit(""))), STRING),
            }
        elif node.kind == "table":
            known = {"name": (F.lit(node.source.name), STRING), "depth": (F.lit(1).cast("long"), LONG), "is-root": (F.lit(False), BOOL), "name-path": (F.lit("/" + node.source.name), STRING)}
        elif node.kind == "tables":
            known = {"name": (node.col("name"), STRING), "depth": (F.lit(1).cast("long"), LONG)}
        else:
            known = {"depth": (F.lit(0).cast("long"), LONG), "is-root": (F.lit(True), BOOL), "name": (F.lit(None).cast("string"), STRING)}
        if name not in known:
            return Val(F.lit(None).cast("string"), STRING)
        return Val(*known[name])

    # -- correlation: each driver row once, with the first row of the entry that admits it

    def correlate(self, st: State, entry: Query, optional: bool) -> State:
        if len(entry.branches) != 1 or not entry.branches[0].steps:
            raise CompileError("a correlated entry is one path")
        path = entry.branches[0]
        last = path.steps[-1]
        bare = Path(path.anchor, (*path.steps[:-1], Step(last.axis, last.matcher, last.traits, (), last.reach, last.leaf, last.prop)))
        right = self.path(self.start(self.spark), bare)
        conditions = [c for p in last.preds for c in conjuncts(p)]
        mine = [c for c in conditions if not mentions(c, Outer) and not any(isinstance(x, Ref) and x.kind == "witness" for x in walk(c))]
        for c in mine:
            right = self.filter(right, c, navigation=True)
        keys, rest, both = [], [], []
        for c in conditions:
            if c in mine:
                continue
            pair = self.equi(c)
            if pair is not None and isinstance(pair[0], Path) and not pair[0].steps:
                inner, outer = pair
                right, a = self.value(right, inner)
                st, b = self.value(st, outer)
                keys.append((a, b))
            else:
                rest.append(c)
        if not keys and not rest:
            raise CompileError("a correlated entry needs a condition on the driver's row")
        if not rest and self.unique(right.node, [p for p, _ in keys]):
            both = right.df
        elif not rest:  # one witness a key: the first
            one = fresh("one")
            w = Window.partitionBy(*[a.col for a, _ in keys]).orderBy(*right.sorts())
            both = right.df.withColumn(one, F.row_number().over(w)).where(F.col(one) == 1).drop(one)
        if not rest:
            on = F.lit(True)
            for a, b in keys:
                on = on & self.key_equal(a, b)
            df = st.df.join(both, on, "left" if optional else "inner")
            return st.but(df=df, witnesses=(*st.witnesses, right.node))
        # A condition beyond equality: candidates by key or condition, then the first of each driver row.
        row = fresh("row")
        left = st.but(df=st.df.withColumn(row, F.struct(*[F.col(k.name) for k in st.order]) if st.order else F.lit(0)))
        on = F.lit(True)
        for a, b in keys:
            on = on & self.key_equal(a, b)
        joint = State(left.df, right.node, regs=right.regs, outer=left)
        for c in rest:
            on = on & self.truth_without_join(joint, c)
        df = left.df.join(right.df, on, "left" if optional else "inner")
        one = fresh("one")
        w = Window.partitionBy(row, *[n.col(c) for n in st.witnesses for c in (n.source.order if n.kind == "row" else ("id",))]).orderBy(*[F.col(k.name).asc_nulls_last() for k in right.order])
        df = df.withColumn(one, F.row_number().over(w)).where(F.col(one) == 1).drop(one, row)
        return st.but(df=df, witnesses=(*st.witnesses, right.node))

    def truth_without_join(self, st: State, expr):
        after, v = self.value(st, expr)
        if after.df is not st.df:
            raise CompileError("a join condition can't itself need a join")
        return truth(v)

    @staticmethod
    def key_equal(a: Val, b: Val):
        if a.type == b.type or a.numeric and b.numeric:
            return a.col.eqNullSafe(b.col)
        return equal(a, b)

    @staticmethod
    def unique(node: Node, keys: list[Val]) -> bool:
        if node.kind != "row" or not node.source.key:
            return False
        return any(k.col._jc.toString().strip("`") == node.columns[node.source.key] for k in keys)

    def equi(self, c):
        """(inner side, outer side) of an equality between this row and the outer one."""
        if not isinstance(c, Op) or c.op != "=":
            return None
        for a, b in (c.args, c.args[::-1]):
            foreign = isinstance(b, Outer) or isinstance(b, Ref) and b.kind == "witness"
            if foreign and not mentions(a, Outer):
                return a, b.expr if isinstance(b, Outer) else b
        return None

    # -- filters

    def filter(self, st: State, expr, navigation: bool = False) -> State:
        for c in conjuncts(expr):
            negated = isinstance(c, Op) and c.op == "not" and isinstance(c.args[0], Path) and bool(c.args[0].steps)
            inner = c.args[0] if negated else c
            if isinstance(inner, Path) and inner.steps and inner.projection is None and not inner.anchor:
                st = self.exists(st, inner, negated)
                continue
            if isinstance(c, Op) and c.op in ("=~",) and not navigation:
                st = self.capture(st, c)
            if navigation and isinstance(c, Op) and any(isinstance(x, Ref) and x.kind == "ord" for x in c.args):
                st = st.but(df=st.df.where(F.lit(False)))
                continue
            if isinstance(c, Op) and c.op in ("<", "<=", ">", ">=") and not any(self.many(a) for a in c.args):
                st, a = self.value(st, c.args[0])
                st, b = self.value(st, c.args[1])
                plain = pushable(c.op, a, b)
                if plain is not None:
                    st = st.but(df=st.df.where(plain))
                    continue
            st, v = self.value(st, c)
            st = st.but(df=st.df.where(truth(v)))
        return st

    def capture(self, st: State, c) -> State:
        st, v = self.value(st, c.args[0])
        pattern = c.args[1].value
        groups = pattern.replace("\\(", "").count("(") - pattern.count("(?") + pattern.count("(?<") - pattern.count("(?<=") - pattern.count("(?<!")
        name = fresh("captures")
        text = F.coalesce(scalars.show(v), F.lit(""))
        items = F.array(*[F.regexp_extract(text, pattern, k) for k in range(groups + 1)])
        return st.but(df=st.df.withColumn(name, items), captures=name)

    def identity(self, st: State) -> list[str]:
        node = st.node
        if node.kind == "arbor":
            return [node.columns["id"]]
        if node.kind == "row":
            return [node.columns[c] for c in node.source.order]
        return []

    def exists(self, st: State, path: Path, negated: bool) -> State:
        """A semi join with the rows that the path starts from."""
        node = st.node
        if node.kind == "row" and len(path.steps) == 1 and path.steps[0].axis in ("out", "resolve") and not path.steps[0].preds:
            label = path.steps[0].prop or path.steps[0].matcher.text
            c = node.col(label)
            return st.but(df=st.df.where(c.isNull() if negated else c.isNotNull()))
        if node.kind == "row" and len(path.steps) == 1 and path.steps[0].axis == "child" and path.steps[0].matcher.kind == "name":
            name = path.steps[0].matcher.text
            c = node.col(name).isNotNull() if name in node.columns else F.lit(False)
            return st.but(df=st.df.where(~c if negated else c))
        keys = self.identity(st)
        fresh_names = {k: fresh("k") for k in keys}
        start = State(st.df.select(*[F.col(c) for c in node.columns.values()]).distinct() if node.kind != "arbor" else st.df.select(*[F.col(c) for c in node.columns.values()]).dropDuplicates(keys), node, order=tuple(Key(k) for k in keys))
        found = self.path(start, path).df.select(*[F.col(k).alias(n) for k, n in fresh_names.items()]).distinct()
        on = [F.col(k).eqNullSafe(F.col(n)) for k, n in fresh_names.items()]
        return st.but(df=st.df.join(found, on, "left_anti" if negated else "left_semi"))

    # -- values

    def value(self, st: State, e) -> tuple[State, Val]:
        if isinstance(e, Lit):
            return st, literal(e.value)
        if isinstance(e, Shaped):
            return st, self.shaped(e)
        if isinstance(e, Op):
            return self.operator(st, e)
        if isinstance(e, Ref):
            return self.reference(st, e)
        if isinstance(e, Path):
            return self.path_value(st, e)
        if isinstance(e, Outer):
            if st.outer is None:
                raise CompileError("$$ is outside of any subcontext")
            return st, self.outer_value(st, e.expr)
        if isinstance(e, Call):
            return self.call_value(st, e.name, e.args)
        if isinstance(e, Interp):
            parts = []
            for p in e.parts:
                st, v = self.value(st, p)
                parts.append(F.coalesce(scalars.show(v), F.lit("")))
            return st, Val(F.concat(*parts), STRING)
        if isinstance(e, Rec):
            return self.record(st, e.fields)
        if isinstance(e, Inline):
            return self.inline(st, e)
        if isinstance(e, Sub):
            return self.subcontext(st, e.query)
        if isinstance(e, Projection):
            return st, self.project(st, e)
        raise CompileError(f"can't plan {e!r}")

    def outer_value(self, st: State, expr) -> Val:
        if isinstance(st.outer, _Fixed):
            return st.outer.values[expr]
        after, v = self.value(st.outer, expr)
        if after.df is not st.outer.df:
            raise CompileError("an outer value can't need a join")
        return v

    def record(self, st: State, fields) -> tuple[State, Val]:
        columns, kinds = [], []
        for name, x in fields:
            st, v = self.value(st, x)
            columns.append(v.col.alias(name))
            kinds.append(T.StructField(name, v.type if not v.null else STRING))
        if not columns:
            return st, Val(F.struct(F.lit(None).alias("_")), T.StructType([T.StructField("_", T.NullType())]))
        return st, Val(F.struct(*columns), T.StructType(kinds))

    def shaped(self, e: Shaped) -> Val:
        if e.kind == "instant":
            return Val(F.lit(e.text).cast("timestamp"), T.TimestampType(), True, e.text)
        if e.kind == "span":
            return Val(temporal.span(F.lit(temporal.literal_seconds(e.text))), T.DayTimeIntervalType(), True, e.text)
        return quantity.parse_literal(e.text) or literal(e.text)

    def operator(self, st: State, e: Op) -> tuple[State, Val]:
        if e.op in ("and", "or", "not"):
            out = None
            for a in e.args:
                st, v = self.flag(st, a)
                out = v if out is None else out & v if e.op == "and" else out | v
            return st, Val(~out if e.op == "not" else out, BOOL)
        if e.op in ("=", "!=", "<", "<=", ">", ">=") and any(self.many(a) for a in e.args):
            return self.membership(st, e)
        vals = []
        for a in e.args:
            st, v = self.value(st, a)
            vals.append(v)
        a, *rest = vals
        if e.op == "neg":
            if a.duration:
                return st, Val(-a.col, a.type)
            n = number(a)
            return st, Val(-n if n is not None else F.lit(None).cast("double"), a.type if a.numeric else DOUBLE)
        if e.op == "if":
            return st, self.choose(truth(a), *rest)
        if e.op == "match":
            out = rest[-1]
            pairs = rest[:-1]
            for k, r in reversed(list(zip(pairs[0::2], pairs[1::2], strict=True))):
                index = e.args.index(next(x for x, v in zip(e.args[1:], rest, strict=True) if v is k))
                regex = isinstance(e.args[index], Lit) and e.args[index].quoted and str(e.args[index].value).startswith("(?")
                out = self.choose(equal(a, k) if not regex else F.coalesce(a.col.rlike(k.value), F.lit(False)), r, out)
            return st, out
        b = rest[0]
        if e.op in ("=", "!="):
            if quantity.is_quantity(a) or quantity.is_quantity(b):
                same = quantity.equal(a, b) if quantity.is_quantity(a) and quantity.is_quantity(b) else F.lit(False)
            else:
                same = equal(a, b)
            return st, Val(same if e.op == "=" else ~same, BOOL)
        if e.op in ("<", "<=", ">", ">="):
            if quantity.is_quantity(a) or quantity.is_quantity(b):
                a, b = (v if quantity.is_quantity(v) else Val(quantity.parse(scalars.show(v)), quantity.TYPE) for v in (a, b))
                return st, Val(quantity.less(e.op, a, b), BOOL)
            return st, Val(less(e.op, a, b), BOOL)
        if e.op == "*=":
            return st, Val(F.coalesce(F.contains(scalars.show(a) if not a.text else a.col, scalars.show(b) if not b.text else b.col), F.lit(False)), BOOL)
        if e.op in ("=~", "!~"):
            text = a.col if a.text else scalars.show(a)
            hit = F.coalesce(text.rlike(b.value) if b.literal else F.regexp_like(text, b.col), F.lit(False))
            return st, Val(hit if e.op == "=~" else ~hit, BOOL)
        if quantity.is_quantity(a) or quantity.is_quantity(b):
            return st, quantity.arithmetic(e.op, a, b)
        return st, arithmetic(e.op, a, b)

    def flag(self, st: State, a) -> tuple[State, object]:
        if isinstance(a, Path) and a.steps and a.projection is None:
            keys = self.identity(st)
            name, there = fresh("is"), {k: fresh("k") for k in keys}
            found = self.exists(st, a, False).df.select(*[F.col(k).alias(n) for k, n in there.items()], F.lit(True).alias(name)).distinct()
            df = st.df.join(found, [F.col(k).eqNullSafe(F.col(n)) for k, n in there.items()], "left").drop(*there.values())
            return st.but(df=df), F.coalesce(F.col(name), F.lit(False))
        st, v = self.value(st, a)
        return st, truth(v)

    def choose(self, condition, a: Val, b: Val) -> Val:
        if a.null:
            return Val(F.when(~condition, b.col), b.type)
        if b.null:
            return Val(F.when(condition, a.col), a.type)
        if a.type == b.type or a.numeric and b.numeric:
            kind = a.type if a.type == b.type else DOUBLE
            return Val(F.when(condition, a.col.cast(kind)).otherwise(b.col.cast(kind)), kind)
        return Val(F.when(condition, scalars.show(a)).otherwise(scalars.show(b)), STRING)

    @staticmethod
    def many(e) -> bool:
        """An operand with any number of values: a path that leaves this row."""
        return isinstance(e, Path) and bool(e.anchor == ("root",) or e.steps and any(s.axis not in ("resolve", "out", "parent", "mark") for s in e.steps))

    def membership(self, st: State, e: Op) -> tuple[State, Val]:
        """Existential comparison with a path's values, as a join on its keys or on its start."""
        side = next(i for i, a in enumerate(e.args) if self.many(a))
        path, other = e.args[side], e.args[1 - side]
        name = fresh("is")
        if path.anchor == ("root",):
            st, v = self.value(st, other)
            inner = self.path(self.start(self.spark).but(outer=st), path)
            if inner.topic is None:
                raise CompileError("a path that is compared needs a projection")
            key = fresh("k")
            if e.op != "=":
                bound = reduce_rows("max" if (e.op in ("<", "<=")) == (side == 1) else "min", inner.topic, [], None)
                if e.op == "!=":
                    raise CompileError("write not (... = ...) for a set")
                one = inner.df.agg(bound.col.alias(key))
                df = st.df.crossJoin(F.broadcast(one))  # one row
                pair = (v, Val(F.col(key), bound.type)) if side == 1 else (Val(F.col(key), bound.type), v)
                return st.but(df=df), Val(less(e.op, *pair), BOOL)
            found = inner.df.select(inner.topic.col.alias(key)).distinct().withColumn(name, F.lit(True))
            w = Val(F.col(key), inner.topic.type)
            df = st.df.join(found, self.key_equal(v, w), "left").drop(key)
            return st.but(df=df), Val(F.coalesce(F.col(name), F.lit(False)), BOOL)
        keys = self.identity(st)
        there = {k: fresh("k") for k in keys}
        v0 = None
        start = State(st.df, st.node, regs=st.regs, order=tuple(Key(k) for k in keys), outer=st.outer, topic=st.topic)
        if not isinstance(other, (Lit, Shaped)):
            start, v0 = self.value(start, other)
        inner = self.path(start.but(topic=None), path)
        w = inner.topic if inner.topic is not None else Val(inner.node.col("value"), STRING)
        o = v0 if v0 is not None else self.value(inner, other)[1]
        pair = (w, o) if side == 0 else (o, w)
        hit = equal(*pair) if e.op == "=" else ~equal(*pair) if e.op == "!=" else less(e.op, *pair)
        found = inner.df.where(hit).select(*[F.col(k).alias(n) for k, n in there.items()]).distinct().withColumn(name, F.lit(True))
        df = st.df.join(found, [F.col(k).eqNullSafe(F.col(n)) for k, n in there.items()], "left").drop(*there.values())
        return st.but(df=df), Val(F.coalesce(F.col(name), F.lit(False)), BOOL)

    def reference(self, st: State, e: Ref) -> tuple[State, Val]:
        if e.kind == "topic":
            return st, self.topic(st)
        if e.kind == "ord":
            name = fresh("ord")
            return st.but(df=with_ordinals(st.df, st.sorts(), name)), Val(F.col(name).cast("long"), LONG)
        if e.kind == "reg":
            regs = list(st.regs)
            if e.key is None:
                return st, regs[-1][1] if regs else literal(None)
            if isinstance(e.key, int):
                return st, regs[e.key - 1][1] if 0 < e.key <= len(regs) else literal(None)
            return st, next((v for n, v in reversed(regs) if n == e.key), literal(None))
        if e.kind == "regs":
            vals = [v for n, v in st.regs if e.key is None or n == e.key]
            if not vals:
                return st, Val(F.array().cast("array<string>"), T.ArrayType(STRING))
            same = len({v.type.simpleString() for v in vals}) == 1
            return st, Val(F.array(*[v.col if same else scalars.show(v) for v in vals]), T.ArrayType(vals[0].type if same else STRING))
        if e.kind == "record":
            named: dict = {}
            for i, (n, v) in enumerate(st.regs):
                if n or e.key == 2:
                    named[n or f"#{i + 1}"] = v
            return self.struct_of(st, named)
        if e.kind == "capture":
            if st.captures is None:
                return st, literal(None)
            return st, Val(F.get(F.col(st.captures), F.lit(int(e.key))), STRING)
        if e.kind == "witness":
            if not 0 < e.key <= len(st.witnesses):
                raise CompileError(f"there is no witness {e.key}")
            inner, v = self.path_value(st.but(node=st.witnesses[e.key - 1]), e.path)
            return st.but(df=inner.df), v
        if e.kind == "input":
            base = self.path(st, e.path) if e.path and e.path.projection else st
            v = self.topic(base)
            name = fresh("all")
            rank = st.rank()
            total = base.df.agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("o"), v.col.alias("x")))), lambda s: s["x"]).alias(name) if rank is not None else F.collect_list(v.col).alias(name))
            return st.but(df=st.df.crossJoin(total)), Val(F.col(name), T.ArrayType(v.type))  # one row, as the language asks for
        if e.kind in ("edge", "edges"):
            if st.edge is None:
                return st, literal(None)
            c = F.col(st.edge)
            one = Val(c["props"][e.key] if e.key else c["label"], STRING)
            if e.kind == "edges" and st.edges is not None:
                return st, Val(F.transform(F.col(st.edges), lambda x: x["props"][e.key] if e.key else x["label"]), T.ArrayType(STRING))
            return st, one if e.kind == "edge" else Val(F.array(one.col), T.ArrayType(STRING))
        raise CompileError(f"unknown reference {e.kind}")

    def struct_of(self, st: State, named: dict) -> tuple[State, Val]:
        if not named:
            return st, Val(F.lit("{}"), STRING)
        return st, Val(F.struct(*[v.col.alias(n) for n, v in named.items()]), T.StructType([T.StructField(n, v.type) for n, v in named.items()]))

    def topic(self, st: State) -> Val:
        """The topic, or in navigation the node's name."""
        if st.topic is not None:
            return st.topic
        if st.node is None:
            return literal(None)
        if st.node.kind in ("row", "arbor", "tables"):
            return Val(name_of(st.node) if st.node.kind != "tables" else st.node.col("name"), STRING)
        return Val(F.lit(getattr(st.node.source, "name", None)).cast("string"), STRING)

    def path_value(self, st: State, p: Path) -> tuple[State, Val]:
        """A path as a value: this row's, or that of the one row it refers to; else a count or a list."""
        if p.anchor == ("root",):
            return self.subcontext(st, Query((p,)))
        at = st.but(node=self.mark(st, p.anchor[1])) if p.anchor else st
        if not p.steps:
            return st, self.project(at, p.projection) if p.projection else self.topic(at)
        if all(s.axis in ("resolve", "out") and not s.preds for s in p.steps) and at.node.kind == "row" or all(s.axis == "resolve" for s in p.steps):
            for s in p.steps:
                at = self.resolve(at, s.prop or s.matcher.text, s.matcher.text if s.axis == "resolve" else "", "left")
            v = self.project(at, p.projection) if p.projection else Val(name_of(at.node), STRING)
            return st.but(df=at.df), v
        if at.node.kind == "row" and len(p.steps) == 1 and p.steps[0].axis == "child" and p.steps[0].matcher.kind == "name" and p.steps[0].matcher.text in at.node.columns:
            return st, self.project(at, Projection("prop", p.steps[0].matcher.text))
        # Any other path: its values by the row it starts from.
        keys = self.identity(at)
        inner = self.path(State(at.df, at.node, order=tuple(Key(k) for k in keys), outer=at.outer, marks=at.marks), p)
        name, there = fresh("vals"), {k: fresh("k") for k in keys}
        rows = inner.df.groupBy(*[F.col(k).alias(n) for k, n in there.items()])
        single = all(s.axis in ("parent", "child") and s.matcher.kind == "name" for s in p.steps)
        if inner.topic is None:
            found, v = rows.agg(F.count(F.lit(1)).alias(name)), Val(F.coalesce(F.col(name), F.lit(0)).cast("long"), LONG)
        elif single:
            rank = inner.rank()
            found, v = rows.agg((F.min_by(inner.topic.col, rank) if rank is not None else F.first(inner.topic.col)).alias(name)), Val(F.col(name), inner.topic.type)
        else:
            item = F.struct(F.col(inner.order[-1].name).alias("o"), inner.topic.col.alias("x"))
            found, v = rows.agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["x"]).alias(name)), Val(F.col(name), T.ArrayType(inner.topic.type))
        df = st.df.join(found, [F.col(k).eqNullSafe(F.col(n)) for k, n in there.items()], "left").drop(*there.values())
        return st.but(df=df), v

    def call_value(self, st: State, name: str, args) -> tuple[State, Val]:
        if name == "now":
            if self.now is None:
                return st, Val(F.lit(None).cast("timestamp"), T.TimestampType())
            return st, Val(F.lit(self.now).cast("timestamp"), T.TimestampType())
        if not args:
            raise CompileError(f"{name!r} needs an argument here")
        st, v = self.value(st, args[0])
        rest = []
        for a in args[1:]:
            st, x = self.value(st, a)
            rest.append(x)
        if name in REDUCERS:
            return st, reduce_list(name, v if v.array else Val(F.array(v.col), T.ArrayType(v.type)), rest)
        return st, scalars.apply(name, v, rest)

    def inline(self, st: State, e: Inline) -> tuple[State, Val]:
        if isinstance(e.expr, Path) and (e.expr.anchor == ("root",) or e.expr.steps):
            return self.subcontext(st, Query((e.expr,), (), e.stages))
        st, v = self.value(st, e.expr)
        for stage in e.stages:
            if stage.op == "call" and stage.name in REDUCERS:
                v = reduce_list(stage.name, v if v.array else Val(F.array(v.col), T.ArrayType(v.type)), [self.value(st, a)[1] for a in stage.args])
            elif stage.op == "call":
                v = self.list_call(st, v, stage) if v.array else scalars.apply(stage.name, v, [self.value(st, a)[1] for a in stage.args])
            elif stage.op == "subst":
                v = scalars.substitute(v, *stage.args, stage.name)
            elif stage.op == "expr":
                st, v = self.value(st.but(topic=v), stage.expr)
            else:
                raise CompileError(f"no {stage.op} stage within an expression")
        return st, v

    def list_call(self, st: State, v: Val, stage: Stage) -> Val:
        kind = v.type.elementType
        if stage.name in ("sort",):
            return Val(F.array_sort(v.col), v.type)
        if stage.name == "reverse":
            return Val(F.reverse(v.col), v.type)
        if stage.name in ("top", "bottom"):
            n = int(stage.args[0].value)
            clean = F.filter(v.col, lambda x: x.isNotNull())
            ordered = F.sort_array(clean, stage.name == "bottom")
            return Val(F.slice(ordered, 1, n), v.type)
        args = [self.value(st, a)[1] for a in stage.args]
        probe = scalars.apply(stage.name, Val(F.lit(None).cast(kind), kind), args)
        return Val(F.transform(v.col, lambda x: scalars.apply(stage.name, Val(x, kind), args).col), T.ArrayType(probe.type))

    # -- subcontexts: a query for each row, as an aggregate joined on its keys

    def subcontext(self, st: State, q: Query) -> tuple[State, Val]:
        path = q.branches[0]
        stages, keys, rest = list(q.pipeline), [], []
        relative = path.anchor != ("root",) and st.node is not None and st.node.kind != "root"
        if relative:
            ids = self.identity(st)
            inner = self.path(State(st.df, st.node, order=tuple(Key(k) for k in ids), outer=st.outer), path)
            pairs = [(Val(F.col(k), st.df.schema[k].dataType), Val(F.col(k), st.df.schema[k].dataType)) for k in ids]
            inner, left = self.stages_until_reduced(inner, stages)
            return self.join_reduced(st, inner, left, pairs, q)
        last = path.steps[-1] if path.steps else None
        conditions = [c for p in (last.preds if last else ()) for c in conjuncts(p)]
        correlated = [c for c in conditions if mentions(c, Outer)]
        if last is not None and correlated:
            plain = tuple(c for c in conditions if c not in correlated)
            path = Path(path.anchor, (*path.steps[:-1], Step(last.axis, last.matcher, last.traits, plain, last.reach, last.leaf, last.prop)), path.projection)
        inner = self.path(self.start(self.spark).but(outer=st), path)
        for c in correlated:
            pair = self.equi(c)
            if pair is None:
                rest.append(c)
                continue
            inner, a = self.value(inner, pair[0])
            st, b = self.value(st, pair[1])
            keys.append((a, b))
        if rest:  # the outer values that conditions read, each set of them once
            used = [x.expr for c in rest for x in walk(c) if isinstance(x, Outer)]
            outs = []
            for u in used:
                st, v = self.value(st, u)
                st, v = st.add(v, "key")
                outs.append(v)
            names = [fresh("o") for _ in outs]
            sets = st.df.select(*[v.col.alias(n) for v, n in zip(outs, names, strict=True)]).distinct()
            there = {u: Val(F.col(n), v.type) for u, v, n in zip(used, outs, names, strict=True)}
            on = F.lit(True)
            for c in rest:
                on = on & truth(self.value(inner.but(outer=_Fixed(there)), c)[1])
            inner = inner.but(df=inner.df.join(sets, on))
            keys += [(there[u], v) for u, v in zip(used, outs, strict=True)]
        inner, left = self.stages_until_reduced(inner, stages)
        return self.join_reduced(st, inner, left, keys, q)

    def stages_until_reduced(self, inner: State, stages: list[Stage]):
        while stages and not (stages[0].pipe == "@|" and stages[0].op == "call" and stages[0].name in REDUCERS and stages[0].name != "unique"):
            inner = self.stage(inner, stages.pop(0), stages)
        return inner, stages

    def join_reduced(self, st: State, inner: State, stages: list[Stage], keys, q: Query) -> tuple[State, Val]:
        name = fresh("sub")
        count = False
        if stages:
            reducer = stages.pop(0)
            v = reduce_rows(reducer.name, self.topic(inner), [self.value(inner, a)[1] for a in reducer.args], inner.rank())
            count = reducer.name == "count"
        elif inner.topic is None:
            v, count = Val(F.count(F.lit(1)), LONG), True
        elif keys and inner.node is not None and self.unique(inner.node, [a for a, _ in keys]):
            v = Val(F.first(inner.topic.col), inner.topic.type)
        else:
            item = F.collect_list(inner.topic.col)
            v = Val(item, T.ArrayType(inner.topic.type))
        if not keys:
            one = inner.df.agg(v.col.alias(name))
            out, result = st.but(df=st.df.crossJoin(F.broadcast(one))), Val(F.col(name), v.type)  # one row
        else:
            there = [fresh("k") for _ in keys]
            rows = inner.df.groupBy(*[a.col.alias(n) for (a, _), n in zip(keys, there, strict=True)]).agg(v.col.alias(name))
            on = [self.key_equal(Val(F.col(n), a.type), b) for (a, b), n in zip(keys, there, strict=True)]
            out = st.but(df=st.df.join(rows, on, "left").drop(*there))
            result = Val(F.coalesce(F.col(name), F.lit(0)).cast("long") if count else F.col(name), v.type)
        for s in stages:
            out, result = self.inline(out.but(topic=result), Inline(Ref("topic"), (s,)))
        return out.but(topic=st.topic), result

    # -- stages

    def stages(self, st: State, stages) -> State:
        rest = list(stages)
        while rest:
            st = self.stage(st, rest.pop(0), rest)
        return st

    def stage(self, st: State, s: Stage, rest) -> State:
        if st.group is not None:
            return self.grouped(st, s, rest)
        if st.window is not None:
            return self.windowed(st, s)
        if s.pipe == "$|":
            return self.mapped(st, s)
        if s.op == "filter":
            return self.filter(st, s.expr)
        if s.op in ("at", "slice"):
            low, high = (s.expr.low, s.expr.high) if isinstance(s.expr, Range) else (s.expr.value, s.expr.value)
            return self.slice(st, low, high)
        if s.op == "nav":
            if st.topic is not None:
                raise CompileError("navigation starts from nodes, not values")
            return self.path(st, s.expr)
        if s.op == "expr":
            st, v = self.value(st, s.expr)
            st, v = st.add(v)
            return st.but(topic=v)
        if s.op == "push":
            st, v = self.value(st, s.expr)
            st, v = st.add(v, "r")
            return st.but(regs=(*st.regs, (s.name, v)), topic=v)
        if s.op == "pushtopic":
            if st.topic is None and st.node is not None:
                return st.but(marks=(*st.marks, (s.name, st.node)))
            return st.but(regs=(*st.regs, (s.name, self.topic(st))))
        if s.op == "subst":
            st, v = st.add(scalars.substitute(self.topic(st), *s.args, s.name))
            return st.but(topic=v)
        if s.op == "spread":
            return self.spread(st, bool(s.name))
        if s.pipe == "@|":
            return self.whole(st, s, rest)
        return self.per_row(st, s)

    def spread(self, st: State, outer: bool) -> State:
        v = self.topic(st)
        if not v.array:
            return st if outer else st.but(df=st.df.where(v.col.isNotNull()))
        place, item = fresh("pos"), fresh("item")
        f = F.posexplode_outer if outer else F.posexplode
        df = st.df.select("*", f(v.col).alias(place, item))
        return st.but(df=df, topic=Val(F.col(item), v.type.elementType), order=(*st.order, Key(place)))

    def per_row(self, st: State, s: Stage) -> State:
        v, name = self.topic(st), s.name
        if name in REDUCERS:
            out = reduce_list(name, v if v.array else Val(F.array(v.col), T.ArrayType(v.type)), [self.value(st, a)[1] for a in s.args])
        elif name in KEYED or name in ("sort", "reverse"):
            if name in ("sort", "reverse", "top", "bottom") and v.array:
                out = self.list_call(st, v, s)
            else:
                return st  # one row is a group of its own
        elif name in ("json", "xml", "markdown", "html") and st.topic is None and st.node is not None and st.node.kind == "arbor":
            from ..sources.render import subtree

            return subtree(self, st, name)
        else:
            args = []
            for a in s.args:
                st, x = self.value(st, a)
                args.append(x)
            out = scalars.apply(name, v, args)
            if name in scalars.EXPANDING:
                st, out = st.add(out)
                return self.spread(st.but(topic=out), False)
        st, out = st.add(out)
        return st.but(topic=out)

    def mapped(self, st: State, s: Stage) -> State:
        v = self.topic(st)
        if not v.array:
            v = Val(F.when(v.col.isNotNull(), F.array(v.col)), T.ArrayType(v.type))
        kind = v.type.elementType
        if s.op in ("slice", "at"):
            low, high = (s.expr.low, s.expr.high) if isinstance(s.expr, Range) else (s.expr.value, s.expr.value)
            n = F.size(v.col)
            at = lambda x: F.lit(x) if x >= 0 else n + x + 1
            a = F.greatest(F.lit(1), at(low) if low is not None else F.lit(1))
            b = F.least(n, at(high) if high is not None else n)
            out = Val(F.when(b >= a, F.slice(v.col, a, F.greatest(F.lit(0), b - a + 1))).otherwise(F.slice(v.col, 1, 0)), v.type)
        else:
            probe, result = [], {}

            def item(x):
                inner = st.but(topic=Val(x, kind))
                if s.op == "filter":
                    after, r = self.value(inner, s.expr)
                    r = Val(truth(r), BOOL)
                elif s.op == "call":
                    after, r = inner, scalars.apply(s.name, Val(x, kind), [self.value(inner, a)[1] for a in s.args])
                elif s.op == "subst":
                    after, r = inner, scalars.substitute(Val(x, kind), *s.args, s.name)
                else:
                    after, r = self.value(inner, s.expr)
                if after.df is not inner.df:
                    raise CompileError("a list's items can't be joined")
                result["type"] = r.type
                probe.append(r)
                return r.col

            mapped = (F.filter if s.op == "filter" else F.transform)(v.col, item)
            out = Val(mapped, v.type if s.op == "filter" else T.ArrayType(result["type"]))
            if isinstance(out.type.elementType, T.ArrayType):
                out = Val(F.flatten(out.col), out.type.elementType)
        st, out = st.add(out)
        return st.but(topic=out)

    def slice(self, st: State, low, high) -> State:
        """Rows low..high of the context, 1-based and inclusive; negative counts from the end."""
        if low is not None and high is not None and low < 0 <= high or low is not None and high is not None and high < 0 <= low or low is None and high is not None and high < 0 or high is None and low is not None and low > 1:
            name, total = fresh("ord"), fresh("n")
            df = with_ordinals(st.df, st.sorts(), name)
            df = df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(total))))  # one row
            at = lambda x: F.lit(x) if x >= 0 else F.col(total) + x + 1
            if low is not None:
                df = df.where(F.col(name) >= at(low))
            if high is not None:
                df = df.where(F.col(name) <= at(high))
            return st.but(df=df.drop(total), order=(Key(name),))
        if low is None and high is None:
            return st
        back = (low if low is not None else high) < 0
        first, last = (1 if low is None else low, high) if not back else (-high if high is not None else 1, -low)
        df = st.df.orderBy(*st.sorts(back)).limit(last) if last is not None else st.df.orderBy(*st.sorts(back))
        if first > 1:
            df = df.offset(first - 1)
        return st.but(df=df)

    def whole(self, st: State, s: Stage, rest) -> State:
        name = s.name
        if name in ("first", "last") or s.op in ("at",):
            df = st.df.orderBy(*st.sorts(name == "last")).limit(1)
            return st.but(df=df, topic=self.topic(st))
        if name == "unique":
            v = self.topic(st)
            one = fresh("one")
            w = Window.partitionBy(F.coalesce(scalars.show(v), F.lit("")) if not v.text else F.coalesce(v.col, F.lit(""))).orderBy(*st.sorts())
            df = st.df.withColumn(one, F.row_number().over(w)).where(F.col(one) == 1).drop(one)
            return st.but(df=df, topic=v)
        if name in REDUCERS:
            v = reduce_rows(name, self.topic(st), [self.value(st, a)[1] for a in s.args], st.rank())
            topic = fresh("agg")
            return State(st.df.agg(v.col.alias(topic)), None, Val(F.col(topic), v.type), outer=st.outer)
        if name == "sort":
            v = self.topic(st)
            keys = [F.collate(scalars.show(v), self.collation(s.args[0].value))] if s.args else rank_key(v)
            return self.ordered(st.but(topic=v), [(k, False, False) for k in keys])
        if name == "reverse":
            return st.but(order=tuple(Key(k.name, not k.descending, not k.nulls_last) for k in st.order))
        if name == "sort_by":
            keys = []
            for a in s.args:
                st, v = self.value(st, a)
                keys += [(k, False, True) for k in (rank_key(v) if not v.text else rank_key(v)[1:])]
            return self.ordered(st, keys)
        if name in ("top", "bottom"):
            st, keys = self.by_keys(st, s.args[1:] or (Ref("topic"),), name == "top")
            df = st.df.where(F.col(keys[0].name).isNotNull())
            st = st.but(df=df, order=(*keys, *st.order))
            n = int(s.args[0].value)
            return st.but(df=df.orderBy(*st.sorts()).limit(n))
        if name in ("min_by", "max_by"):
            st, keys = self.by_keys(st, s.args, name == "max_by")
            best = fresh("best")
            pack = F.struct(*[F.col(k.name) for k in keys])
            live = st.df.where(F.col(keys[0].name).isNotNull())
            one = live.agg((F.max if name == "max_by" else F.min)(pack).alias(best))
            return st.but(df=live.join(F.broadcast(one), F.col(best) == pack, "left_semi"))
        if name == "unique_by":
            st, keys = self.by_keys(st, s.args, False)
            one = fresh("one")
            w = Window.partitionBy(*[F.col(k.name) for k in keys]).orderBy(*st.sorts())
            return st.but(df=st.df.withColumn(one, F.row_number().over(w)).where(F.col(one) == 1).drop(one))
        if name == "group":
            keys = []
            for label, a in s.args:
                st, v = self.value(st, a)
                st, v = st.add(v, "key")
                keys.append((label, v))
            for _, v in keys:
                st = st.but(df=st.df.where(v.col.isNotNull()))
            return State(st.df, st.node, None, outer=st.outer, group=Group(st, tuple((n, v) for n, v in keys)))
        if name == "window":
            a = s.args[0]
            low, high = (a.low, a.high) if isinstance(a, Range) else (1 - a.value, 0)
            keys = []
            for x in s.args[1:]:
                st, v = self.value(st, x)
                st, v = st.add(v, "key")
                keys.append(v)
            return st.but(window=(low, high, keys))
        if name == "shift":
            return self.shift(st, s)
        if name == "ungroup":
            return st
        return self.per_row(st, s)

    @staticmethod
    def collation(locale: str) -> str:
        return locale.replace("-", "_") if "_" in locale or "-" in locale else locale

    def ordered(self, st: State, keys) -> State:
        names = []
        for column, descending, last in keys:
            name = fresh("by")
            st = st.but(df=st.df.withColumn(name, column))
            names.append(Key(name, descending, last))
        return st.but(order=(*names, *st.order))

    def by_keys(self, st: State, exprs, descending: bool) -> tuple[State, list[Key]]:
        keys = []
        for e in exprs:
            st, v = self.value(st, e)
            n = number(v) if v.text else None
            for c in ([v.col] if not v.text else [F.when(n.isNotNull(), 0).when(v.col.isNotNull(), 1), n, v.col]):
                name = fresh("by")
                st = st.but(df=st.df.withColumn(name, c))
                keys.append(Key(name, descending, True))
        return st, keys

    # -- windows

    def partition(self, st: State, keys: list[Val]):
        """A row whose key is null stands alone."""
        by = []
        for k in keys:
            by.append(k.col)
        if keys:
            null = F.lit(False)
            for k in keys:
                null = null | k.col.isNull()
            by.append(F.when(null, F.struct(*[F.col(k.name) for k in st.order])) if st.order else F.lit(0))
        return by

    def windowed(self, st: State, s: Stage) -> State:
        low, high, keys = st.window
        v = self.topic(st)
        plain = st.but(window=None)
        if s.pipe == "|" and s.op == "call" and s.name in REDUCERS and s.name not in ("unique", "median", "first", "last", "join"):
            r = reduce_rows(s.name, v, [], None)
            make = lambda spec: r.col.over(spec)
        elif s.pipe == "|" and s.op == "call" and s.name in ("first", "last"):
            r = v
            make = lambda spec: (F.first if s.name == "first" else F.last)(v.col).over(spec)
        else:
            r = Val(None, T.ArrayType(v.type))
            make = lambda spec: F.collect_list(v.col).over(spec)
        name = fresh("win")
        if keys:
            spec = Window.partitionBy(*self.partition(st, keys)).orderBy(*st.sorts()).rowsBetween(Window.unboundedPreceding if low is None else low, Window.unboundedFollowing if high is None else high)
            df = st.df.withColumn(name, make(spec))
        elif low is not None and high is not None:
            place = fresh("ord")
            df = bounded_window(with_ordinals(st.df, st.sorts(), place), place, low, high, make, name)
        else:  # a frame without an end reads the whole context for each row
            spec = Window.orderBy(*st.sorts()).rowsBetween(Window.unboundedPreceding if low is None else low, Window.unboundedFollowing if high is None else high)
            df = st.df.withColumn(name, make(spec))
        out = plain.but(df=df, topic=Val(F.col(name), r.type))
        if r.col is None:
            return self.stage(out, s, [])
        return out

    def shift(self, st: State, s: Stage) -> State:
        from ..lang.parser import Parser

        n = Parser.constant(s.args[0])
        keys = []
        for x in s.args[1:]:
            st, v = self.value(st, x)
            st, v = st.add(v, "key")
            keys.append(v)
        v, name = self.topic(st), fresh("shift")
        f = (lambda spec: F.lag(v.col, n).over(spec)) if n >= 0 else (lambda spec: F.lead(v.col, -n).over(spec))
        if keys:
            return st.but(df=st.df.withColumn(name, f(Window.partitionBy(*self.partition(st, keys)).orderBy(*st.sorts()))), topic=Val(F.col(name), v.type))
        place = fresh("ord")
        df = with_ordinals(st.df, st.sorts(), place)
        other, there = df.select((F.col(place) + n).alias(place + "x"), v.col.alias(name)), place + "x"
        df = df.join(other, F.col(place) == F.col(there), "left").drop(there)
        return st.but(df=df, topic=Val(F.col(name), v.type), order=(Key(place),))

    # -- groups

    def grouped(self, st: State, s: Stage, rest) -> State:
        base, keys = st.group.base, st.group.keys
        if s.op == "call" and s.name == "ungroup":
            df, first = self.first_place(base, keys, st.group.first)
            return base.but(df=df, regs=(*base.regs, *keys), order=(Key(first), *base.order), group=None)
        if s.pipe == "|" and s.op == "call" and s.name in ("top", "bottom", "sort_by", "min_by", "max_by", "unique_by", "reverse"):
            first = st.group.first
            if s.name not in ("sort_by", "reverse"):
                df, first = self.first_place(base, keys, first)
                base = base.but(df=df)
            return st.but(group=Group(self.within(base, keys, s), keys, first))
        reducer = s.name if s.pipe == "|" and s.op == "call" and s.name in REDUCERS else None
        topic = self.topic(base)
        rank = base.rank()
        if reducer:
            v = reduce_rows(reducer, topic, [self.value(base, a)[1] for a in s.args], rank)
        elif rank is not None:
            v = Val(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("o"), topic.col.alias("x")))), lambda x: x["x"]), T.ArrayType(topic.type))
        else:
            v = Val(F.collect_list(topic.col), T.ArrayType(topic.type))
        name, first = fresh("agg"), fresh("first")
        labels = [fresh("k") for _ in keys]
        columns = [v.col.alias(name)]
        order_needed = rank is not None
        if order_needed:
            columns.append((F.min(st.group.first) if st.group.first else F.min(rank)).alias(first))
        # Later property reads are those of the group's first row: it is kept only if something reads them.
        todo = [s, *rest] if not reducer else rest
        reads = any(isinstance(x, (Path, Projection)) for t in todo for x in walk(t)) and base.node is not None
        member = fresh("member")
        if reads and rank is not None:
            columns.append(F.min_by(F.struct(*[F.col(c).alias(c) for c in base.node.columns.values()]), rank).alias(member))
        df = base.df.groupBy(*[k.col.alias(n) for (_, k), n in zip(keys, labels, strict=True)]).agg(*columns)
        node = None
        if reads and rank is not None:
            df = df.select(*[c for c in df.columns if c != member], f"{member}.*")
            node = base.node
        regs = tuple((label, Val(F.col(n), k.type)) for (label, k), n in zip(keys, labels, strict=True))
        out = State(df, node, Val(F.col(name), v.type), regs, (Key(first),) if order_needed else tuple(Key(n) for n in labels), outer=base.outer)
        return out if reducer else self.stage(out, s, rest)

    def first_place(self, base: State, keys, first: str | None):
        """The rows with the place of their group's first row; a window on the keys that later stages share."""
        if first is not None:
            return base.df, first
        name, rank = fresh("first"), base.rank()
        w = Window.partitionBy(*[v.col for _, v in keys])
        return base.df.withColumn(name, F.min(rank).over(w) if rank is not None else F.lit(0)), name

    def within(self, base: State, keys, s: Stage) -> State:
        """A keyed stage on each group's members."""
        group = [v.col for _, v in keys]
        if s.name == "reverse":
            return base.but(order=tuple(Key(k.name, not k.descending, not k.nulls_last) for k in base.order))
        exprs = s.args[1:] if s.name in ("top", "bottom") else s.args
        st, by = self.by_keys(base, exprs or (Ref("topic"),), s.name in ("top", "max_by"))
        if s.name == "sort_by":
            return st.but(order=(*by, *st.order))
        place = fresh("place")
        if s.name == "unique_by":
            w = Window.partitionBy(*group, *[F.col(k.name) for k in by]).orderBy(*st.sorts())
            return st.but(df=st.df.withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place))
        live = F.col(by[0].name).isNotNull()
        if s.name in ("min_by", "max_by"):
            w = Window.partitionBy(*group).orderBy(*[k.sort() for k in by])
            return st.but(df=st.df.where(live).withColumn(place, F.rank().over(w)).where(F.col(place) == 1).drop(place))
        # A group that is emptied keeps one row, its first, without a topic.
        w = Window.partitionBy(*group).orderBy(live.desc(), *[k.sort() for k in by], *st.sorts())
        df = st.df.withColumn(place, F.row_number().over(w))
        n = int(s.args[0].value)
        df = df.where((live & (F.col(place) <= n)) | (~live & (F.col(place) == 1)))
        topic = self.topic(st)
        st = st.but(df=df, topic=Val(F.when(live, topic.col), topic.type) if st.topic is not None else None)
        return st.but(order=(Key(place), *st.order))

    # -- results

    def result(self, st: State, ordered: bool = True) -> DataFrame:
        """One column ``value``, a column for each field of a record, or ``locator`` for nodes."""
        if st.group is not None or st.window is not None:
            st = self.stage(st, Stage("|", "expr", expr=Ref("topic")), [])
        df = st.df.orderBy(*st.sorts()) if ordered and st.order else st.df
        if st.topic is None:
            node = st.node
            if node.kind == "arbor":
                return df.select(node.col("locator").alias("locator"))
            if node.kind == "row":
                return df.select(self.core_meta(node, "name-path").col.alias("locator"))
            if node.kind == "tables":
                return df.select(F.concat(F.lit("/"), node.col("name")).alias("locator"))
            return df.select(F.lit("/" + node.source.name if node.kind == "table" else "/").alias("locator"))
        v = st.topic
        if quantity.is_quantity(v):
            return df.select(quantity.show(v.col).alias("value"))
        if v.duration:
            return df.select(temporal.show(v).alias("value"))
        if v.struct:
            out = df.select(v.col.alias("__r"))
            columns = []
            for f in v.type.fields:
                c = F.col("__r").getField(f.name)
                x = Val(c, f.dataType)
                columns.append((scalars.show(x) if x.duration or quantity.is_quantity(x) else c).alias(f.name))
            return out.select(*columns)
        return df.select(v.col.alias("value"))


class _Fixed:
    """An outer scope whose values are given columns."""

    def __init__(self, values: dict):
        self.values, self.df = values, None


__all__ = ["Compiler", "aliased"]
