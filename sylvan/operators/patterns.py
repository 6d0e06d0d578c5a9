"""Path patterns: groups of steps repeated along simple paths.

Each round joins the frontier with its next hops and drops paths that meet a node again.  The visited nodes of
a path are a sorted list, so paths that cover the same ground are one.  An open pattern whose frontier is not
empty at the arbor's bound is an error, never a shortened answer.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.shared import stored
from ..plans.state import CompileError, Key, State, fresh
from .axes import arbor_nodes


class QuantifierBoundError(CompileError):
    """An open pattern has not ended within the bound."""


class Patterns:
    """Mixin of the compiler."""

    def group_hop(self, st: State, step) -> State:
        node = st.node
        if node.kind == "root" and hasattr(node.source, "nodes"):
            st = self.arbor_root(st, node.source)
            node = st.node
        if node is None or node.kind != "arbor":
            if step.low == 1 and step.high == 1 and len(step.alts) == 1 and not step.push:
                for inner in step.alts[0]:
                    st = self.hop(st, inner)
                return self.keep(st, step, st)
            if step.high is not None and step.low == step.high and len(step.alts) == 1 and not step.push:
                for _ in range(step.high):
                    for inner in step.alts[0]:
                        st = self.hop(st, inner)
                return self.keep(st, step, st)
            raise CompileError("patterns walk arbors")
        # Each round reads the nodes and links again, so they are stored once.
        arbor = replace(node.source, nodes=stored(node.source.nodes), edges=None if node.source.edges is None else stored(node.source.edges))
        node = replace(node, source=arbor)
        st = st.but(node=node)
        bound = node.source.bound
        if step.high is not None and step.high > bound:
            raise QuantifierBoundError(f"{step.high} repetitions exceed the bound of {bound}")
        seed, visited, crumbs = fresh("seed"), fresh("visited"), fresh("crumbs")
        base = st.but(df=st.df.withColumn(seed, F.struct(*[F.col(k.name) for k in st.order]) if st.order else F.lit(0)).withColumn(visited, F.array(node.col("id"))).withColumn(crumbs, F.array().cast("array<string>")))
        tiers = [self.tier(base, base, 0)] if step.low == 0 else []
        now, last = base, step.high if step.high is not None else bound + 1
        for n in range(1, last + 1):
            now = self.round(now, step, seed, visited, crumbs, base)
            now = now.but(df=stored(now.df))
            if now.df.isEmpty():
                break
            if n > bound:
                raise QuantifierBoundError(f"the pattern goes on after {bound} repetitions")
            if n >= step.low:
                tiers.append(self.tier(now, base, n))
        if not tiers:
            tiers = [self.tier(now, base, 0).where(F.lit(False))]
        df = tiers[0]
        for t in tiers[1:]:
            df = df.unionByName(t)
        out = base.but(df=df, order=(*st.order, Key("__tier"), Key(base.node.columns["id"])))
        out = self.renamed(out)
        return self.finish_group(out, step, seed, visited, crumbs)

    def renamed(self, out: State) -> State:
        name = fresh("tier")
        return out.but(df=out.df.withColumnRenamed("__tier", name), order=tuple(Key(name) if k.name == "__tier" else k for k in out.order))

    def tier(self, now: State, base: State, n: int):
        """The reached nodes under the names of the base's columns."""
        names = {now.node.columns[c]: base.node.columns[c] for c in base.node.columns}
        keep = [F.col(c) for c in base.df.columns if c not in names.values()]
        return now.df.select(*keep, *[F.col(a).alias(b) for a, b in names.items()], F.lit(n).alias("__tier"))

    def round(self, now: State, step, seed: str, visited: str, crumbs: str, base: State) -> State:
        parts = []
        carried = [c for c in base.df.columns if c not in base.node.columns.values() and c not in (visited, crumbs)]
        final = arbor_nodes(base.node.source)[1]
        for alt in step.alts:
            at = now.but(order=())
            seen = F.col(visited)
            for inner in alt:
                at = self.hop(at, inner)
                spot = fresh("seen")
                at = at.but(df=at.df.where(~F.array_contains(seen, at.node.col("id"))).withColumn(spot, F.array_sort(F.array_append(seen, at.node.col("id")))))
                seen = F.col(spot)
            trail = F.col(crumbs)
            for _, expr in step.push:
                from ..functions.scalars import show

                at, v = self.value(at, expr)
                trail = F.array_append(trail, show(v))
            parts.append(at.df.select(*carried, seen.alias(visited), trail.alias(crumbs), *[at.node.col(c).alias(n) for c, n in final.columns.items()]))
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        return now.but(df=df.dropDuplicates([seed, visited, crumbs, final.columns["id"]]), node=final, order=())

    def finish_group(self, out: State, step, seed: str, visited: str, crumbs: str) -> State:
        for pred in step.preds:
            out = self.filter(out, pred, navigation=True)
        tier = next(k.name for k in out.order[::-1] if k.name.startswith("_tier"))
        if step.reach:
            n = fresh("least")
            w = Window.partitionBy(seed)
            out = out.but(df=out.df.withColumn(n, (F.min if step.reach == "?" else F.max)(tier).over(w)).where(F.col(n) == F.col(tier)).drop(n))
        if step.push:
            from pyspark.sql import types as T

            from ..functions.readings import Val

            return out.but(regs=(*out.regs, (step.push[0][0], Val(F.col(crumbs), T.ArrayType(T.StringType())))), topic=None, edge=None)
        one = fresh("one")
        w = Window.partitionBy(seed, out.node.col("id")).orderBy(tier)
        df = out.df.withColumn(one, F.row_number().over(w)).where(F.col(one) == 1).drop(one)
        return out.but(df=df, topic=None, edge=None)
