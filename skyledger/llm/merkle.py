"""Merkle manifest of a dataset: a tree for each source, one tree over the sources' roots.

Leaves are hashes of rows.  Per source they ascend by doc_id; every ``ARITY`` consecutive nodes become one
until one remains, the source's subroot; subroots, ordered by source, become the root in the same way.

Rows are numbered without a hot task (dealt by range, counted, numbered within their range), and cut
into superblocks of ``ARITY ** depth`` consecutive leaves.  On the way up only one node a superblock leaves its task,
so a source of any size takes a few rounds of ever fewer rows.  On the way down leaves and the
outer nodes that their proofs need are cogrouped by superblock: one Python call reduces the superblock again,
joins local and outer siblings to proofs, and folds the leaves that a reader claims.  Nothing bigger than a
superblock meets in a task; the driver sees counts and the root.

Defined cases: a null column is hashed as ``-``, so it differs from an empty text; a null source is a source of its
own, ordered first; rows without a doc_id come before the others of their source and are never tampered with;
rows of one source and doc_id follow by leaf, so repeated rows each have a place and a proof; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

ARITY = 3
#: Levels of a superblock: 729 leaves.
DEPTH = 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """Hash of a row: each value behind its length in bytes, a null as ``-``."""

    def counted(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(counted, values)), 256)


def levels(nodes: list[str], height: int | None = None) -> list[list[str]]:
    """The nodes and those above them, ``height`` times or until one remains."""
    out = [nodes]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([digest("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return out


def steps(tree: list[list[str]], place: int) -> list[str]:
    """The proof of a node below the top of ``tree``: for each level its place in its run and the others of the run."""
    out = []
    for nodes in tree[:-1]:
        start, at = place - place % ARITY, place % ARITY
        out.append(str(at) + "".join(n for i, n in enumerate(nodes[start : start + ARITY]) if i != at))
        place //= ARITY
    return out


def fold(node: str, proof: list[str]) -> str:
    """The root that a leaf and its proof lead to."""
    for step in proof:
        cut = 1 + 64 * int(step[0])
        node = digest(step[1:cut] + node + step[cut:])
    return node


def _up(nodes: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables ``tree, place, n, node`` of every ``depth`` levels, and ``tree, node, level`` of the roots.

    ``level`` is the table from which a tree needs no other.
    """
    span = ARITY**depth

    def top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree, place, n = key
        node = levels(rows.sort_values("place")["node"].tolist(), depth if n > span else None)[-1]
        return pd.DataFrame({"tree": [tree], "place": [place], "n": [-(-n // span)], "node": node})

    tables, ends = [nodes], []
    while True:
        block = F.expr(f"place div {span}")
        above = written(tables[-1].select("tree", "place", "n", "node").groupBy("tree", block.alias("block"), "n").applyInPandas(top, "tree long, place long, n long, node string"))
        ends.append(above.where("n = 1").select("tree", "node", F.lit(len(tables) - 1).alias("level")))
        more = above.where("n > 1")
        if more.isEmpty():
            return tables, reduce(DataFrame.unionByName, ends)
        tables.append(more)


def _blocks(tables: list[DataFrame], i: int, outer: DataFrame, paths: DataFrame | None, span: int) -> tuple:
    """Both sides of the cogroup of table ``i``: its nodes, and the outer path of each of their superblocks."""
    own = outer.where(F.col("level") == i).select("tree", F.lit(0).cast("long").alias("block"), "path")
    if paths is not None:
        own = own.unionByName(paths.select("tree", F.col("place").alias("block"), "path"))
    return tables[i].withColumn("block", F.expr(f"place div {span}")).groupBy("tree", "block"), own.groupBy("tree", "block")


def _down(tables: list[DataFrame], outer: DataFrame, depth: int, last: int) -> DataFrame | None:
    """``tree, place, path`` of the nodes of table ``last``: their proofs up to the root, by way of the tables above."""
    span = ARITY**depth

    def paths(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("place")
        tree = levels(nodes["node"].tolist(), depth if len(nodes) and nodes["n"].iat[0] > span else None)
        upper = list(above["path"].iat[0])
        return pd.DataFrame({"tree": nodes["tree"], "place": nodes["place"], "path": [steps(tree, i) + upper for i in range(len(nodes))]})

    found = None
    for i in range(len(tables) - 1, last - 1, -1):
        one, two = _blocks(tables, i, outer, found, span)
        found = written(one.cogroup(two).applyInPandas(paths, "tree long, place long, path array<string>"))
    return found


def prove(leaves: DataFrame, *, depth: int = DEPTH, with_proof: bool = False) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``leaves``.

    ``leaves`` has ``source, doc_id, leaf, claimed``: ``claimed`` is the leaf that a reader computed (null: the
    same), folded with the original siblings.  ``with_proof`` adds ``proof``, for :func:`fold`: by level the
    place in the run (one digit) and the others of the run.
    """
    span = ARITY**depth
    placed = numbered(leaves.select("source", "doc_id", "leaf", "claimed"), ["source"], ["doc_id", "leaf"])
    trees = numbered(placed.select("source").distinct(), [], ["source"]).select(F.col("source").alias("name"), F.col("place").alias("tree"), F.col("n").alias("trees"))
    trees = written(trees)
    placed = placed.join(trees.select("name", "tree"), placed["source"].eqNullSafe(trees["name"])).select("tree", "place", "n", F.col("leaf").alias("node"), "doc_id", "claimed")

    tables, subroots = _up(placed, depth)
    subroots = written(subroots)
    over = subroots.join(trees, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("trees").alias("n"), "node")
    upper, top = _up(over, depth)
    end = top.first()
    root = end["node"] if end else ""
    # The one tree over the subroots has an empty path above it.
    over_path = top.select("tree", "level", F.array().cast("array<string>").alias("path"))
    paths = _down(upper, over_path, depth, 0)
    outer = written(subroots.join(paths.select(F.col("place").alias("tree"), "path"), "tree"))

    # The last cogroup also takes the subroot along.
    above = _down(tables, outer, depth, 1) if len(tables) > 1 else None
    one, two = _blocks(tables, 0, outer, above, span)
    schema = "tree long, doc_id long, leaf string, proof_sha256 string, folded_root string" + (", proof array<string>" if with_proof else "")

    def finish(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("place")
        own = nodes["node"].tolist()
        tree = levels(own, depth if len(own) and nodes["n"].iat[0] > span else None)
        upper = list(above["path"].iat[0])
        proofs = [steps(tree, i) + upper for i in range(len(own))]
        claimed = [c if isinstance(c, str) else o for o, c in zip(own, nodes["claimed"], strict=True)]
        out = {"tree": nodes["tree"], "doc_id": nodes["doc_id"], "leaf": own, "proof_sha256": [digest("".join(s[1:] for s in p)) for p in proofs], "folded_root": list(map(fold, claimed, proofs))}
        return pd.DataFrame(out | ({"proof": proofs} if with_proof else {}))

    rows = one.cogroup(two).applyInPandas(finish, schema).join(subroots.select("tree", F.col("node").alias("subroot")), "tree")
    out = rows.withColumn("root", F.lit(root)).withColumn("verified", F.col("folded_root") == F.col("root"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["proof"] if with_proof else []))


def hashed(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``source, doc_id, leaf, claimed`` of documents; ``claimed`` has the text ``tampered`` where that isn't null and differs."""
    whole = [F.col(c) for c in COLUMNS]
    claimed = F.lit(None).cast("string") if tampered is None else F.when(tampered != F.col("text"), leaf(*whole[:-1], tampered))
    return docs.select("source", "doc_id", leaf(*whole).alias("leaf"), claimed.alias("claimed"))


def without_line_feeds() -> Column:
    """The text without line feeds in rows whose doc_id has an even CRC-32; null in others."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(even & F.col("text").contains("\n"), F.replace("text", F.lit("\n"), F.lit("")))


def manifest(docs: DataFrame, *, tampered: Column | None = None, depth: int = DEPTH, with_proof: bool = False) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and what a reader of ``tampered`` texts finds (see :func:`prove`)."""
    return prove(written(hashed(docs, tampered)), depth=depth, with_proof=with_proof)


def oracle_sql() -> str:
    """DuckDB SQL for ``manifest(documents, tampered=without_line_feeds())``: nodes level by level, then siblings, then folds."""
    row = lambda text: "sha256(concat(" + ", ".join(f"coalesce(concat(strlen({v}), ':', {v}), '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + "))"
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)))"""
    return f"""WITH RECURSIVE h AS (SELECT doc_id, source, {row("text")} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {row("replace(text, chr(10), '')")} END AS bad FROM documents),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM h),
    up(tree, level, place, n, node) AS (SELECT tree, 0, place, n, leaf FROM leaves UNION ALL
      SELECT tree, level + 1, place // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM up WHERE n > 1 GROUP BY tree, level, place // 3, n),
    subroots AS (SELECT tree, node AS subroot FROM up WHERE n = 1),
    over_(level, place, n, node) AS (SELECT 0, tree, (SELECT count(*) FROM subroots), subroot FROM subroots UNION ALL
      SELECT level + 1, place // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM over_ WHERE n > 1 GROUP BY level, place // 3, n),
    top AS (SELECT node AS root FROM over_ WHERE n = 1),
    nodes AS (SELECT tree, level AS step, level, place, node FROM up WHERE n > 1 UNION ALL SELECT NULL, 1000 + level, level, place, node FROM over_ WHERE n > 1),
    wanted AS (SELECT l.tree, l.place AS leaf_place, x.step, x.level, CASE WHEN x.step < 1000 THEN l.place ELSE l.tree END // pow(3, x.level)::BIGINT AS own FROM leaves l JOIN (SELECT DISTINCT tree, step, level FROM nodes) x ON x.tree = l.tree OR x.tree IS NULL),
    others AS (SELECT w.tree, w.leaf_place, w.step, coalesce(string_agg(d.node, '' ORDER BY d.place) FILTER (WHERE d.place < w.own), '') AS lefts, coalesce(string_agg(d.node, '' ORDER BY d.place) FILTER (WHERE d.place > w.own), '') AS rights
      FROM wanted w JOIN nodes d ON d.step = w.step AND (d.tree = w.tree OR d.tree IS NULL) AND d.place // 3 = w.own // 3 GROUP BY ALL),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY tree, leaf_place ORDER BY step) AS k FROM others),
    fold(tree, leaf_place, k, node) AS (SELECT tree, place, 1, coalesce(bad, leaf) FROM leaves UNION ALL
      SELECT f.tree, f.leaf_place, f.k + 1, sha256(concat(s.lefts, f.node, s.rights)) FROM fold f JOIN numbered s ON s.tree = f.tree AND s.leaf_place = f.leaf_place AND s.k = f.k),
    folded AS (SELECT tree, leaf_place, arg_max(node, k) AS folded_root FROM fold GROUP BY ALL),
    proofs AS (SELECT tree, leaf_place, sha256(string_agg(concat(lefts, rights), '' ORDER BY k)) AS proof_sha256 FROM numbered GROUP BY ALL)
    SELECT l.doc_id, l.leaf, s.subroot, t.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = t.root AS verified
    FROM leaves l JOIN subroots s ON s.tree = l.tree CROSS JOIN top t JOIN folded f ON f.tree = l.tree AND f.leaf_place = l.place LEFT JOIN proofs p ON p.tree = l.tree AND p.leaf_place = l.place"""
