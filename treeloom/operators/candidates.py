"""Further families of candidate edges, and the evidence that they give together.

Each family is a set of (sent_id, ud_lo, ud_hi, str_lo, str_hi): the ud edge may correspond to the str edge. All joins have sent_id
among their keys, so a plan shuffles by sentence or edge and no group is larger than a sentence's candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .edges import ancestors, edges, roots, strict

KEY = ["sent_id", "ud_lo", "ud_hi", "str_lo", "str_hi"]


def _family(rows: DataFrame, u: tuple[str, str], s: tuple[str, str]) -> DataFrame:
    """Distinct candidates from the named token columns; an edge is no candidate for itself."""
    c = rows.select("sent_id", F.least(*u).alias("ud_lo"), F.greatest(*u).alias("ud_hi"), F.least(*s).alias("str_lo"), F.greatest(*s).alias("str_hi"))
    return c.where("ud_lo <> str_lo or ud_hi <> str_hi").distinct()


def _among(rows: DataFrame, a: str, b: str, kept: DataFrame) -> DataFrame:
    """Rows whose tokens ``a`` and ``b`` are joined by an edge of ``kept``."""
    return rows.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)}).join(kept.select("sent_id", "lo", "hi"), ["sent_id", "lo", "hi"], "left_semi").drop("lo", "hi")


def _arcs(tree_edges: DataFrame, head: str, dep: str) -> DataFrame:
    return tree_edges.select("sent_id", F.col("head").alias(head), F.col("dep").alias(dep))


def mirror_swap(ud: DataFrame, st: DataFrame) -> DataFrame:
    """ud h over b over a, a over b in str, {h, b} not in str: str's edge into a, from g, if {h, g} is in both trees."""
    m = strict(ud, st)
    rows = _arcs(m.where("status = 'unresolved'"), "h", "b").join(_arcs(m.where("status = 'mirrored'"), "b", "a"), ["sent_id", "b"])
    rows = rows.join(_arcs(edges(st), "g", "a"), ["sent_id", "a"])
    return _family(_among(rows, "h", "g", m.where("status <> 'unresolved'")), ("h", "b"), ("g", "a"))


def mirror_relative(ud: DataFrame, st: DataFrame) -> DataFrame:
    """Edges next to a mirrored one (ud b over a, str a over b).

    For {p, b}, p above b in ud: {p, a} if str has it, and str's edge into a. For {p, x}, x being b or above it in ud: {b, q}, if str has b
    over q and {p, q} points the same way in both trees.
    """
    m, s, u = strict(ud, st), edges(st), edges(ud)
    mirrored = _arcs(m.where("status = 'mirrored'"), "b", "a")
    above = mirrored.join(_arcs(u, "p", "b"), ["sent_id", "b"])
    near = _family(_among(above, "p", "a", s), ("p", "b"), ("p", "a"))
    into = _family(above.join(_arcs(s, "g", "a"), ["sent_id", "a"]), ("p", "b"), ("g", "a"))
    same = m.where("status = 'same_dir'")
    bridges = _arcs(same, "p", "q").unionByName(_arcs(same, "q", "p"))
    up = ancestors(ud).select("sent_id", F.col("id").alias("b"), F.col("anc").alias("x")).unionByName(mirrored.select("sent_id", "b", F.col("b").alias("x")).distinct())
    far = mirrored.join(_arcs(s, "b", "q"), ["sent_id", "b"]).join(bridges, ["sent_id", "q"]).join(_arcs(u, "p", "x"), ["sent_id", "p"]).join(up, ["sent_id", "b", "x"], "left_semi")
    return near.unionByName(into).unionByName(_family(far, ("p", "x"), ("b", "q"))).distinct()


def root_path(ud: DataFrame, st: DataFrame) -> DataFrame:
    """Both trees have one root, str's above ud's: {ud root, x} may be x's edge down the str path between the roots, for x on it, or its
    edge to the path, for x off it."""
    one = lambda t, c: roots(t).groupBy("sent_id").agg(F.min("id").alias(c), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    tops = one(ud, "r").join(one(st, "top"), "sent_id").where("r <> top")
    up = ancestors(st).select("sent_id", F.col("id").alias("r"), F.col("anc").alias("x"), "d")
    up = tops.join(up, ["sent_id", "r"])
    reach = up.where("x = top").select("sent_id")
    path = up.join(reach, "sent_id", "left_semi").select("sent_id", "r", "x")
    arcs = path.join(_arcs(edges(st), "x", "y"), ["sent_id", "x"])
    members = path.select("sent_id", F.col("x").alias("y")).unionByName(path.select("sent_id", F.col("r").alias("y"))).distinct()
    down = arcs.join(members, ["sent_id", "y"], "left_semi")
    off = arcs.join(members, ["sent_id", "y"], "left_anti")
    u = edges(ud)
    return _family(_among(down, "r", "x", u), ("r", "x"), ("x", "y")).unionByName(_family(_among(off, "r", "y", u), ("r", "y"), ("x", "y"))).distinct()


def order_residual(ud: DataFrame, st: DataFrame) -> DataFrame:
    """What strict matching leaves, in order of the dependents, punctuation aside: the i-th of m ud edges with the str edges at the same
    relative place among n, and its neighbours."""
    m = strict(ud, st)
    free = lambda rows, t: rows.join(t.where("coalesce(upos, '') <> 'PUNCT'").select("sent_id", F.col("id").alias("dep")), ["sent_id", "dep"], "left_semi")
    w = Window.partitionBy("sent_id")
    numbered = lambda rows: rows.withColumns({"i": F.row_number().over(w.orderBy("dep", "head")) - 1, "many": F.count(F.lit(1)).over(w)})
    a = numbered(free(m.where("status = 'unresolved'"), ud)).select("sent_id", F.col("lo").alias("ud_lo"), F.col("hi").alias("ud_hi"), "i", F.col("many").alias("m"))
    left = edges(st).join(m.where("head_str is not null").select("sent_id", "lo", "hi"), ["sent_id", "lo", "hi"], "left_anti")
    b = numbered(free(left, st)).select("sent_id", F.col("lo").alias("str_lo"), F.col("hi").alias("str_hi"), F.col("i").alias("j"), F.col("many").alias("n"))
    size = b.groupBy("sent_id").agg(F.max("n").alias("n"))
    centre = F.when(F.col("m") == 1, (F.col("n") - 1) / F.lit(2.0)).otherwise(F.col("i") * (F.col("n") - 1) / (F.col("m") - 1))
    near = F.bround("c", 0).cast("long")
    between = F.array(F.floor("c"), F.floor(F.col("c") + 0.999999))
    places = F.array_distinct(F.concat(F.array(near - 1, near, near + 1), F.when(F.col("m") != F.col("n"), between).otherwise(F.array().cast("array<bigint>"))))
    at = a.join(size, "sent_id").withColumn("c", centre).select("sent_id", "ud_lo", "ud_hi", F.explode(places).alias("j"))
    return at.join(b.select("sent_id", F.col("j").cast("long").alias("j"), "str_lo", "str_hi"), ["sent_id", "j"]).select(*KEY)


def evidence(families: dict[str, DataFrame]) -> DataFrame:
    """One row for each candidate with the sorted names of the families that propose it."""
    parts = [f.select(*KEY, F.lit(name).alias("source")) for name, f in families.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*KEY).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def certification(sources: Column) -> Column:
    """How far a match may be trusted, by the families that proposed it."""
    has = lambda *names: F.arrays_overlap(sources, F.array(*[F.lit(n) for n in names]))
    guess = ~has("exact_same_dir", "exact_mirrored") & (has("mirror_relative", "root_path") | (F.array_distinct(sources) == F.array(F.lit("order_residual"))))
    return F.when(F.size(sources) == 0, "candidate_gap").when(guess, "heuristic").otherwise("strict")
