"""Parent-child links to full hierarchies: paths, depths, roots, descendants and circular links.

Level-wise frontier joins go from the roots. A node joins the frontier once all its parents are done, so each
link is followed once; what no frontier reaches lies on a closed walk or below one. The unreached part is
trimmed from its leaves by the same frontier on turned links, and the rest split into strongly connected
components by colouring, which keeps one row per node however long a cycle is.
"""

from __future__ import annotations

from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import Scratch, own_session
from .names import concept_records, is_name, name_index, resolve

ROWS = 100_000  # links and states one task takes
HOT = 50_000  # links of one node in one partition; more are salted
CHUNK = 1_000_000  # path members a task holds back before it hands rows on


def parent_edges(concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(id), edges(parent, child)), distinct, of concepts that are not deleted.

    A is a parent of B if B's hypernyms or A's hyponyms names it. Names that stand for no concept, null
    and empty names give no edge. An empty table gives two empty tables.
    """
    rec = concept_records(concepts)
    live = rec.filter(F.col("deleted_at").isNull())
    up = live.select("id", "domain_key", "lang", F.lit(True).alias("up"), F.explode("hypernyms").alias("name"))
    down = live.select("id", "domain_key", "lang", F.lit(False).alias("up"), F.explode("hyponyms").alias("name"))
    refs = up.unionByName(down).filter(is_name(F.col("name")))
    hit = resolve(refs, name_index(rec), "inner").filter(~F.col("target_deleted"))
    edges = hit.select(F.when(F.col("up"), F.col("target")).otherwise(F.col("id")).alias("parent"), F.when(F.col("up"), F.col("id")).otherwise(F.col("target")).alias("child")).distinct()
    return live.select("id"), edges


class Frontier:
    """Hops of a frontier over distinct links (src, dst), level by level, the least value of a node kept.

    A state is a row (id, val, seen, need, out, fresh, done). A hop hands a value made of val and dst from each fresh
    node along its links. With `wait` a node becomes fresh once, when a value has come over each of its links, and is
    done a hop later; without it, whenever its value falls. While links and states are many, a job is one hop over
    partitions by their counted number, the links of nodes above HOT salted. Links of done nodes are dropped when they
    are half of all. What then fits ROWS, as the tail of a deep thin hierarchy does, makes its last hops in one task.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, name: str, links: DataFrame, grow: bool, wait: bool, rows: int = ROWS, hot: int = HOT):
        """grow: values are (depth, path, root) and grow by dst at each link; otherwise they are handed on as they are."""
        self.spark, self.scratch, self.name, self.grow, self.wait, self.rows, self.hot = spark, scratch, name, grow, wait, rows, hot
        s = scratch
        one = lambda end, i, o: links.select(F.col(end).alias("id"), F.lit(i).alias("need"), F.lit(o).alias("out"))
        self.degrees = s.write(one("dst", 1, 0).unionByName(one("src", 0, 1)).groupBy("id").agg(F.sum("need").alias("need"), F.sum("out").alias("out")), f"{name}/degrees")
        to = self.degrees.select(F.col("id").alias("dst"), "need", "out")
        own = self.degrees.filter("out > 0").select(F.col("id").alias("src"), F.col("out").alias("_links"))
        t = links.join(to, "dst").join(own, "src").select("src", "dst", "need", "out", F.pmod(F.xxhash64("dst"), self._salts(F.col("_links"))).alias("salt"))
        self.links, n = s.write_counted(t, f"{name}/links0", n=F.count(F.lit(1)))
        self.n_links, self.prunes, self.placed = n["n"], 0, None

    def _salts(self, n: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(n / F.lit(self.hot))).cast("bigint")

    def _meet(self, r: DataFrame) -> DataFrame:
        """r: (id, val, own, seen, need, out, done); own is the value the node had before, null for what arrives."""
        m = r.groupBy("id").agg(F.min("val").alias("val"), F.min("own").alias("own"), F.sum("seen").alias("seen"), F.max("need").alias("need"), F.max("out").alias("out"), F.max("done").alias("done"))
        fresh = (F.col("seen") == F.col("need")) & ~F.col("done") if self.wait else F.col("own").isNull() | (F.col("val") < F.col("own"))
        return m.select("id", "val", "seen", "need", "out", fresh.alias("fresh"), "done")

    def _step(self) -> Column:
        if not self.grow:
            return F.col("val")
        return F.struct((F.col("val.depth") + 1).alias("depth"), F.concat("val.path", F.array("dst")).alias("path"), F.col("val.root").alias("root"))

    def _hop(self, state: DataFrame, parts: int) -> DataFrame:
        """One hop over stored links and a stored state: the frontier moves to the placed links, what arrives to its node."""
        self.spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        if self.placed is None:
            self.placed = self.links.withColumnsRenamed({"need": "_need", "out": "_out"}).repartition(parts, "src", "salt").persist()
        f = state.filter("fresh").select(F.col("id").alias("src"), "val", F.explode(F.sequence(F.lit(0).cast("bigint"), self._salts(F.col("out")) - 1)).alias("salt"))
        a = self.placed.join(f.hint("shuffle_hash"), ["src", "salt"])
        a = a.select(F.col("dst").alias("id"), self._step().alias("val"), F.lit(None).cast(state.schema["val"].dataType).alias("own"), F.lit(1).cast("bigint").alias("seen"), F.col("_need").alias("need"), F.col("_out").alias("out"), F.lit(False).alias("done"))
        return self._meet(a.unionByName(state.select("id", "val", F.col("val").alias("own"), "seen", "need", "out", (F.col("fresh") & F.lit(self.wait)).alias("done"))))

    def _tail(self, state: DataFrame) -> DataFrame:
        """The last hops, in one task that holds at most ROWS links and states and hands nodes on as they are done."""
        grow, wait, schema = self.grow, self.wait, to_arrow_schema(state.schema)
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in state.schema if f.name not in ("id", "need", "out")]
        links = self.links.select(F.col("dst").alias("id"), "need", "out", *nulls, F.col("src").alias("_src"))
        both = links.select(*state.columns, "_src").unionByName(state.withColumn("_src", F.lit(None).cast("string"))).coalesce(1)

        def run(batches):
            kids: dict[str, list] = {}
            val, seen, front = {}, {}, []
            for b in batches:
                for r in b.to_pylist():
                    if r["_src"] is not None:
                        kids.setdefault(r["_src"], []).append((r["id"], r["need"]))
                        continue
                    val[r["id"]] = tuple(r["val"].values()) if grow else r["val"]
                    seen[r["id"]] = r["seen"]
                    if r["fresh"]:
                        front.append(r["id"])

            def rows(ids):
                out = [{"id": i, "val": dict(zip(("depth", "path", "root"), val[i])) if grow else val[i], "seen": 0, "need": 0, "out": 0, "fresh": False, "done": wait} for i in ids]
                return pa.RecordBatch.from_pylist(out, schema=schema)

            held, size = [], 0
            while front:
                met = set()
                for x in front:
                    for y, need in kids.get(x, ()):
                        v = (val[x][0] + 1, [*val[x][1], y], val[x][2]) if grow else val[x]
                        less = y not in val or v < val[y]
                        if less:
                            val[y] = v
                        if wait:
                            seen[y] = seen.get(y, 0) + 1
                            if seen[y] == need:
                                met.add(y)
                        elif less:
                            met.add(y)
                if wait:
                    held += front
                    size += sum(len(val[x][1]) if grow else 1 for x in front)
                    if size > CHUNK:
                        yield rows(held)
                        for x in held:
                            del val[x]
                        held, size = [], 0
                front = sorted(met)
            yield rows(held if wait else list(val))

        return both.mapInArrow(run, state.schema)

    def _prune(self, done: DataFrame) -> None:
        self._unplace()
        self.spark.conf.set("spark.sql.shuffle.partitions", str(ceil(self.n_links / self.rows)))
        gone = done.filter("done").select(F.col("id").alias("src"))
        left = self.links.join(gone.hint("shuffle_hash"), "src", "left_anti").select(self.links.columns)
        self.prunes += 1
        self.links, n = self.scratch.write_counted(left, f"{self.name}/links{self.prunes}", n=F.count(F.lit(1)))
        self.n_links = n["n"]
        self.scratch.drop(f"{self.name}/links{self.prunes - 1}")

    def _unplace(self) -> None:
        if self.placed is not None:
            self.placed.unpersist()
            self.placed = None

    def run(self, start: DataFrame) -> DataFrame:
        """start: (id, val, out), all fresh. With `wait` the done states, else the last state of every node met."""
        s, turn, used = self.scratch, 0, 0
        # re-planning starts a driver thread for every exchange, and hundreds of them live at once in such a loop
        self.spark.conf.set("spark.sql.adaptive.enabled", "false")
        parts = self.spark.conf.get("spark.sql.shuffle.partitions")
        at = lambda i: f"{self.name}/state/turn={i:06d}"
        tally = {"fresh": F.count_if("fresh"), "rows": F.count_if(~F.col("done")), "used": F.sum(F.when(F.col("done"), F.col("out")).otherwise(0))}
        zero = F.lit(0).cast("bigint")
        first = start.select("id", "val", zero.alias("seen"), zero.alias("need"), F.coalesce("out", zero).alias("out"), F.lit(True).alias("fresh"), F.lit(False).alias("done"))
        state, n = s.write_counted(first, at(0), **tally)
        schema = state.schema
        while n["fresh"]:
            turn += 1
            live, size = state.filter("not done"), self.n_links + n["rows"]
            live = self._tail(live) if size <= self.rows else self._hop(live, ceil(size / self.rows))
            state, n = s.write_counted(live, at(turn), **tally)
            used += n["used"] or 0
            if self.wait and n["fresh"] and 2 * used >= self.n_links:
                # no link leads back to a done node, so what later turns meet needs none of theirs
                self._prune(self.spark.read.schema(schema).parquet(s.path(f"{self.name}/state")))
                used = 0
            if not self.wait:
                s.drop(at(turn - 1))
        self._unplace()
        self.spark.conf.set("spark.sql.adaptive.enabled", "true")
        self.spark.conf.set("spark.sql.shuffle.partitions", parts)
        s.drop(f"{self.name}/links{self.prunes}", f"{self.name}/degrees")
        self.table = f"{self.name}/state" if self.wait else at(turn)
        return self.spark.read.schema(schema).parquet(s.path(self.table)).filter("done" if self.wait else "true")


class Hierarchy:
    """Runs the passes eagerly, in a session of its own; the results are tables in the shared folder.

    Several parents, repeated links and nodes without links are as usual; null ids and links with a null end are
    left out; an empty graph gives empty tables.
    """

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, rows: int = ROWS, hot: int = HOT):
        self.spark, self.rows, self.hot = spark, rows, hot
        self.loop = own_session(spark)
        s = self.scratch = Scratch(self.loop, "tree")
        self.edges = s.write(edges.filter(F.col("parent").isNotNull() & F.col("child").isNotNull()).select("parent", "child").distinct(), "edges")
        listed = s.write(nodes.filter(F.col("id").isNotNull()).select("id"), "listed")
        self.nodes = s.write(listed.unionByName(self.edges.select(F.explode(F.array("parent", "child")).alias("id"))).distinct(), "nodes")
        self.reached = self._peel()
        self.left, n = s.write_counted(self.nodes.join(self.reached.select("id"), "id", "left_anti"), "left", n=F.count(F.lit(1)))
        self.n_left = n["n"]
        self.cyclic = self._given(self._cycles(), "cycles")

    def _given(self, df: DataFrame, name: str) -> DataFrame:
        """A table of this object's session in the caller's."""
        return self.spark.read.schema(df.schema).parquet(self.scratch.path(name))

    def _frontier(self, name: str, links: DataFrame, grow: bool, wait: bool) -> Frontier:
        return Frontier(self.loop, self.scratch, name, links, grow, wait, self.rows, self.hot)

    def _unmet(self, nodes: DataFrame, f: Frontier, val: Column) -> DataFrame:
        """The nodes no link leads to, as start of a frontier."""
        return nodes.join(f.degrees, "id", "left").filter("coalesce(need, 0) = 0").select("id", val.alias("val"), "out")

    def _peel(self) -> DataFrame:
        """Levels from the roots. Of several shortest paths to a node the least counts."""
        f = self._frontier("peel", self.edges.select(F.col("parent").alias("src"), F.col("child").alias("dst")), True, True)
        return f.run(self._unmet(self.nodes, f, F.struct(F.lit(0).alias("depth"), F.array("id").alias("path"), F.col("id").alias("root"))))

    def _trim(self, nodes: DataFrame, links: DataFrame, name: str) -> tuple[DataFrame, int]:
        """(the nodes left when those without a child among the links go, again and again; their number)."""
        f = self._frontier(name, links.select(F.col("child").alias("src"), F.col("parent").alias("dst")), False, True)
        gone = f.run(self._unmet(nodes, f, F.lit(0)))
        kept, n = self.scratch.write_counted(nodes.join(gone.select("id"), "id", "left_anti"), f"{name}/kept", n=F.count(F.lit(1)))
        self.scratch.drop(f"{name}/state")
        return kept, n["n"]

    def _inside(self, links: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        n = nodes.select("id")
        return self.scratch.write(links.join(n.withColumnRenamed("id", "parent"), "parent", "left_semi").join(n.withColumnRenamed("id", "child"), "child", "left_semi").select("parent", "child"), name)

    def _cycles(self) -> DataFrame:
        """(id, component) of the nodes on a closed walk."""
        s = self.scratch
        found = [self.edges.filter("parent = child").select(F.col("parent").alias("id"), F.col("parent").alias("component"))]
        core, n, turn = self.left, self.n_left, 0
        if n:
            inner = self._inside(self.edges.filter("parent <> child"), core, "inner0")
            core, n = self._trim(core, inner, "trim0")
        while n:
            turn += 1
            inner = self._inside(inner, core, f"inner{turn}")
            f = self._frontier(f"colour{turn}", inner.select(F.col("parent").alias("src"), F.col("child").alias("dst")), False, False)
            # the least node that reaches each node
            colour = f.run(core.join(f.degrees, "id", "left").select("id", F.col("id").alias("val"), "out")).select("id", F.col("val").alias("colour"))
            # inside one colour, what reaches the colour's own node forms its component
            a, b = colour.select(F.col("id").alias("parent"), F.col("colour").alias("cp")), colour.select(F.col("id").alias("child"), F.col("colour").alias("cc"))
            same = s.write(inner.join(a, "parent").join(b, "child").filter("cp = cc").select(F.col("child").alias("src"), F.col("parent").alias("dst")), f"same{turn}")
            f = self._frontier(f"back{turn}", same, False, False)
            back = f.run(colour.filter("id = colour").join(f.degrees, "id", "left").select("id", F.lit(0).alias("val"), "out"))
            comp = s.write(back.select("id").join(colour, "id").select("id", F.col("colour").alias("component")), f"comp{turn}")
            several = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
            found.append(comp.join(several, "component", "left_semi").select("id", "component"))
            core, n = self._trim(s.write(core.join(comp, "id", "left_anti"), f"rest{turn}"), self._inside(inner, core.join(comp, "id", "left_anti"), f"between{turn}"), f"trim{turn}")
            s.drop(f"inner{turn - 1}", f"colour{turn}", f"same{turn}", f"back{turn}", f"trim{turn - 1}", f"between{turn}", f"rest{turn}")
        all_ = found[0]
        for f in found[1:]:
            all_ = all_.unionByName(f)
        out = s.write(all_.groupBy("id").agg(F.min("component").alias("component")), "cycles")
        s.drop(*[f"comp{i}" for i in range(1, turn + 1)], "inner0", f"inner{turn}", "trim0", f"trim{turn}")
        return out

    def tree(self) -> DataFrame:
        """(id, path, depth, root, on_cycle, component): one row a node.

        depth counts links from the root along a shortest path; of several the least path is given. To nodes on or
        below a closed walk the frontier goes on from those it has reached; where no root leads, path, depth and root
        are null.
        """
        known = self._given(self.reached, "peel/state").filter("done").select("id", "val")
        if self.n_left:
            into = self.edges.join(self.left.withColumnRenamed("id", "child"), "child", "left_semi").select(F.col("parent").alias("src"), F.col("child").alias("dst"))
            f = self._frontier("below", into, True, False)
            met = f.run(self.reached.select("id", "val").join(f.degrees.select("id", "out"), "id"))
            below = self._given(met, f.table).join(self._given(self.left, "left"), "id", "right").select("id", "val")
            known = known.unionByName(below)
        return known.join(self.cyclic, "id", "left").select("id", "val.path", "val.depth", "val.root", F.col("component").isNotNull().alias("on_cycle"), "component")

    def descendants(self) -> DataFrame:
        """(ancestor, descendant), distinct, between components; a node off every cycle is its own component.

        Members of one cycle are broader and narrower than each other; they are in tree().component and not
        expanded into pairs. Round k joins the pairs whose shortest walk has exactly 2^k links with all pairs of at
        most as many, so that in a tree every pair is derived once and the rounds grow as the logarithm of the depth.
        """
        s, c = self.scratch, self.loop.read.schema(self.cyclic.schema).parquet(self.scratch.path("cycles"))
        e = self.edges
        for side in ("parent", "child"):
            m = c.select(F.col("id").alias(side), F.col("component").alias("_c"))
            e = e.join(m, side, "left").withColumn(side, F.coalesce("_c", side)).drop("_c")
        first = e.filter("parent <> child").select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("links")).distinct()
        pairs, n = s.write_counted(first, "pairs/round=0", n=F.count(F.lit(1)))
        k, schema = 0, pairs.schema
        while n["n"]:
            # each round's new pairs are a table of their own, and the table of all is read over them
            so_far = self.loop.read.schema(schema).parquet(s.path("pairs"))
            far = pairs.filter(F.col("links") == 2**k).select("ancestor", F.col("descendant").alias("_m"))
            new = far.join(so_far.select(F.col("ancestor").alias("_m"), "descendant", "links"), "_m").groupBy("ancestor", "descendant").agg((F.min("links") + 2**k).cast("int").alias("links"))
            k += 1
            pairs, n = s.write_counted(new.join(so_far.select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti"), f"pairs/round={k}", n=F.count(F.lit(1)))
        return self.spark.read.schema(schema).parquet(s.path("pairs")).select("ancestor", "descendant")


def concept_hierarchy(concepts: DataFrame) -> Hierarchy:
    nodes, edges = parent_edges(concepts)
    return Hierarchy(concepts.sparkSession, nodes, edges)
