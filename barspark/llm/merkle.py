"""Merkle manifest of a table: a tree of its rows for each group, a tree of the groups' roots above, and a proof for every row.

Rows are numbered by sorted ranges. Every ``fanout ** LOCAL`` of a group's leaves are a superblock, which a task reduces to one node; the nodes
above are few and are joined up to the root and down again, each to its at most ``fanout`` children, so no group is gathered. Then leaves and the
outer nodes that their proofs need are cogrouped by superblock: one function finishes the local levels, joins the proofs and folds the claimed leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

FANOUT = 16
#: Levels of a superblock: 4,096 leaves at a fanout of 16.
LOCAL = 3


def leaf_hash(*values: Column) -> Column:
    """Hex SHA-256 of the values, each ``-`` if null, else its length in UTF-8 bytes, ``:`` and itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def node_hash(children: Sequence[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def fold(leaf: str, siblings: Sequence[Sequence[str]], places: Sequence[int]) -> str:
    """The root that a leaf leads to: on each level it stands at its place among the siblings of its run."""
    for others, at in zip(siblings, places, strict=True):
        leaf = node_hash([*others[:at], leaf, *others[at:]])
    return leaf


def verify(leaf: str, proof: bytes, places: Sequence[int], runs: Sequence[int]) -> str:
    """``fold`` of a proof as ``prove`` returns it: digests one after the other, and each level's place and number of siblings."""
    digests, at, siblings = [proof[i : i + 32].hex() for i in range(0, len(proof), 32)], 0, []
    for n in runs:
        siblings.append(digests[at : at + n])
        at += n
    return fold(leaf, siblings, places)


def _numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` (a written table) with ``pos``, from 0 in their order within ``key``, and ``n``, the rows of the key: sorted ranges are numbered each by itself, then
    set off by the counts of those before. Equal rows are dealt over ranges by their number; which of them comes first makes no difference to any result."""
    x = rows.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
    by = [key, *order, "__salt"]
    x = materialize(x.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()).drop("__salt"), name)
    at = F.shiftright("__at", 33).alias("__range")
    n = x.groupBy(key, at).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    w = Window.partitionBy(key)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select(key, "__range", (before - F.col("__first")).alias("__off"), F.sum("__n").over(w).alias("n"))
    return x.withColumn("__range", F.shiftright("__at", 33)).join(n, [key, "__range"]).withColumn("pos", F.col("__at") + F.col("__off")).drop("__at", "__range", "__off")


def _climb(nodes: DataFrame, most: int, fanout: int) -> list[DataFrame]:
    """The levels from ``nodes`` (``k, idx, h, n``, n: the level's nodes of the key) up to where no key has more than one of at most ``most`` nodes; a node above
    holds its run's hashes. Keys with a single node end there."""
    levels = [nodes]
    while most > 1:
        run = F.array_sort(F.collect_list(F.struct("idx", "h")))
        up = levels[-1].where("n > 1").groupBy("k", F.expr(f"idx div {fanout}").alias("idx")).agg(F.transform(run, lambda x: x.h).alias("run"), F.first("n").alias("below"))
        levels.append(up.select("k", "idx", F.sha2(F.array_join("run", ""), 256).alias("h"), F.expr(f"(below + {fanout - 1}) div {fanout}").alias("n"), "run"))
        most = -(-most // fanout)
    return levels


def _descend(levels: list[DataFrame], roots: DataFrame, fanout: int) -> DataFrame:
    """``k, idx, up`` for each node of the lowest level and all further columns of ``roots`` (``k, up`` and more): ``up`` is the array of (place, others) from the node
    to the root, then that of the root. Each node hands its own to its at most ``fanout`` children."""
    paths = None
    for i in range(len(levels) - 1, -1, -1):
        own = levels[i].where("n = 1").select("k", "idx").join(roots, "k")
        if paths is not None:
            down = levels[i + 1].select("k", "idx", "run").join(paths, ["k", "idx"]).select("*", F.posexplode("run").alias("place", "__h"))
            others = F.filter("run", lambda _, j: j != F.col("place"))
            step = F.array(F.struct(F.col("place"), others.alias("others")))
            down = down.withColumns({"up": F.concat(step, "up"), "idx": F.col("idx") * fanout + F.col("place")})
            own = own.unionByName(down.select(*own.columns))
        paths = own
    return paths


def _reduce(hashes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The local levels of one superblock, its leaves first."""
    out = [hashes]
    for _ in range(levels):
        out.append([node_hash(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def _depth(n: int, fanout: int) -> int:
    d = 0
    while n > 1:
        n, d = -(-n // fanout), d + 1
    return d


def prove(rows: DataFrame, group_col: str, id_col: str, leaf_col: str = "leaf", claimed_col: str | None = None, fanout: int = FANOUT, local: int = LOCAL) -> DataFrame:
    """One row per row of ``rows``: its id, group and leaf, ``subroot`` (its group's), ``root``, ``proof`` (the siblings' digests, level by level from the leaf
    through the subroot to the root, left to right), ``places`` and ``runs`` (on each level its place in the run and the number of siblings) and ``folded_root``:
    the root that the claimed leaf, by default the leaf itself, leads to with these siblings.

    Leaves are hex SHA-256 and ascend by id within their group, null first, equal ids by leaf and claimed leaf; groups ascend as UTF-8 bytes, null first and a group
    of its own. ``fanout`` consecutive nodes (the last ones: fewer, even one) become one until a single one is left; a lone leaf is its own subroot. Ids and groups that repeat, or whole
    rows, are leaves each. Tables without rows give none; further columns are ignored."""
    key = F.coalesce(F.concat(F.lit("v"), F.col(f"`{group_col}`").cast("string")), F.lit("n"))
    leaf = F.col(f"`{leaf_col}`")
    claimed = F.col(f"`{claimed_col}`") if claimed_col else leaf
    d = materialize(rows.select(key.alias("k"), F.col(f"`{id_col}`").alias("id"), leaf.alias("leaf"), claimed.alias("claimed")), "leaves")
    d_id = d.schema["id"].dataType.simpleString()
    size = fanout**local
    ranges = materialize(_numbered(d, "k", ["id", "leaf", "claimed"], "ranges").withColumn("idx", F.expr(f"pos div {size}")), "numbered")
    most = ranges.agg(F.max("n")).first()[0] or 1

    def superblock(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pos")
        n, levels = int(f.n.iloc[0]), min(local, _depth(int(f.n.iloc[0]), fanout))
        return pd.DataFrame({"k": [f.k.iloc[0]], "idx": [f.idx.iloc[0]], "h": [_reduce(f.leaf.tolist(), levels, fanout)[-1][0]], "n": [-(-n // size)]})

    tops = ranges.select("k", "idx", "pos", "n", "leaf").groupBy("k", "idx").applyInPandas(superblock, "k string, idx long, h string, n long")
    levels = _climb(materialize(tops, "superblocks"), -(-most // size), fanout)
    roots = levels[0].where("n = 1").select("k", "h")
    for x in levels[1:]:
        roots = roots.unionByName(x.where("n = 1").select("k", "h"))
    roots = materialize(roots.withColumn("all", F.lit("")), "subroots")
    sources = materialize(_numbered(roots, "all", ["k"], "subroot-ranges").select(F.col("all").alias("k"), F.col("pos").alias("idx"), "h", "n", F.col("k").alias("group")), "numbered-subroots")
    above = _climb(sources.drop("group"), sources.count(), fanout)
    none = F.from_json(F.lit("[]"), "array<struct<place:int,others:array<string>>>")
    top = _descend(above, above[-1].where("n = 1").select("k", none.alias("up"), F.col("h").alias("root")), fanout)
    top = top.join(sources.select("idx", F.col("group"), F.col("h").alias("subroot")), "idx").select(F.col("group").alias("k"), "up", "root", "subroot")
    outer = materialize(_descend(levels, top, fanout), "outer")

    def joined(f: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pos").reset_index(drop=True)
        up = [] if o.empty else o.up.iloc[0]
        nodes = _reduce(f.leaf.tolist(), min(local, _depth(int(f.n.iloc[0]), fanout)), fanout)
        above = [[str(h) for h in x["others"]] for x in up]
        places_above = [int(x["place"]) for x in up]
        tail = [bytes.fromhex("".join(x)) for x in above]
        out = {"proof": [], "places": [], "runs": [], "folded_root": []}
        for i, c in enumerate(f.claimed.tolist()):
            siblings, places, at = [], [], i
            for level in nodes[:-1]:
                lo, p = at - at % fanout, at % fanout
                siblings.append([*level[lo:at], *level[at + 1 : lo + fanout]])
                places.append(p)
                at //= fanout
            out["proof"].append(bytes.fromhex("".join(map("".join, siblings))) + b"".join(tail))
            siblings += above
            out["places"].append(places + places_above)
            out["runs"].append([len(x) for x in siblings])
            out["folded_root"].append(fold(c, siblings, places + places_above))
        f = f[["k", "id", "leaf"]].copy()
        f["subroot"], f["root"] = o.subroot.iloc[0], o.root.iloc[0]
        return f.assign(**out)

    schema = f"k string, id {d_id}, leaf string, subroot string, root string, proof binary, places array<int>, runs array<int>, folded_root string"
    out = ranges.select("k", "idx", "pos", "n", "id", "leaf", "claimed").groupBy("k", "idx").cogroup(outer.groupBy("k", "idx")).applyInPandas(joined, schema)
    discard(d)
    group = F.when(F.col("k") != "n", F.expr("substring(k, 2)"))
    return out.select(F.col("id").alias(id_col), group.alias(group_col), "leaf", "subroot", "root", "proof", "places", "runs", "folded_root")
