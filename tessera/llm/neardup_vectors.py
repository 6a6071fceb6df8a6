"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative a group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.storage import materialize

THRESHOLD = 0.93
#: Vectors a cell aims at, and how many cells in all make cells larger than that (a bound of the centroids that are broadcast).
#: A label of ``FEW`` vectors or more has two cells at least. Large cells are compared in blocks, so their size bounds nothing.
CELL, MOST_CELLS, FEW = 2_048, 2_048, 16
#: Vectors of a label that its centroids are fitted on at most (expected, drawn by hash), and rounds of k-means.
SAMPLE, ROUNDS = 8_192, 8
#: Vectors on either side of one product.
BLOCK = 1_024


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors: start with the row farthest from those chosen, then alternate; empty cells keep their centroid."""
    chosen, best = [0], x @ x[0]
    for _ in range(1, k):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, x @ x[chosen[-1]])
    c = x[chosen].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def kind_of(vectors: DataFrame, vec_col: str) -> str:
    """Single precision is kept as it is; any other type of component is compared as double."""
    return "float" if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else "double"


def nodes_of(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows as ``(id, label, dim, vec)`` with vec null where it can't be linked, and distinct vectors with their count and smallest id."""
    v = F.col(vec_col).cast(f"array<{kind_of(vectors, vec_col)}>")
    odd = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) | ~F.exists(v, lambda e: e != 0)
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(~odd, F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.when(usable, F.size(v)).alias("dim"), F.when(usable, v).alias("vec"))
    nodes = rows.where("vec is not null").groupBy("label", "dim", "vec").agg(F.min("id").alias("node"), F.count("*").alias("weight"))
    return rows, nodes


def centroids(nodes: DataFrame) -> dict[tuple, np.ndarray]:
    """Of each label with ``FEW`` vectors or more; the others are one cell."""
    held = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    total = held.agg(F.sum("n")).first()[0] or 0
    size = max(CELL, math.ceil(total / MOST_CELLS))
    large = held.where(F.col("n") >= FEW).select("label", "dim", F.greatest(F.lit(2), F.ceil(F.col("n") / size).cast("int")).alias("k"), F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n")).alias("rate"))
    draw = F.xxhash64(F.lit("cells"), "node").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    sample = nodes.join(F.broadcast(large), ["label", "dim"]).where(draw < F.col("rate")).select("label", "dim", "k", "node", "vec")

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("node")
        c = spherical_kmeans(unit(np.stack(p["vec"].to_list())), min(int(p["k"].iloc[0]), len(p)))
        return pd.DataFrame({"label": [p["label"].iloc[0]] * len(c), "dim": p["dim"].iloc[0], "cell": range(len(c)), "centre": list(c)})

    kind = nodes.schema["label"].dataType.simpleString()
    out: dict[tuple, list] = {}
    for label, dim, _, centre in sample.groupBy("label", "dim").applyInPandas(fit, f"label {kind}, dim int, cell int, centre array<double>").orderBy("label", "dim", "cell").collect():
        out.setdefault((label, dim), []).append(centre)
    return {k: np.array(v) for k, v in out.items()}


def placed(nodes: DataFrame, cells: dict[tuple, np.ndarray], threshold: float) -> DataFrame:
    """Each vector in its nearest cell (home), and as a guest in each later cell where a partner of it may live.

    A vector y within the threshold of x lies within chord sqrt(2 - 2 * threshold); if y's home is another cell, x is no
    further than that from the plane between both centroids. So no pair is lost, and each is met in one cell only.
    """
    held, chord = nodes.sparkSession.sparkContext.broadcast(cells), math.sqrt(2 - 2 * threshold) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps: dict[tuple, np.ndarray] = {}
        for b in batches:
            key = list(zip(b.column("label").to_pylist(), b.column("dim").to_pylist(), strict=True))
            at, cell = [np.arange(len(key))], [np.zeros(len(key), np.int64)]
            groups: dict[tuple, list[int]] = {}
            for i, k in enumerate(key):
                if k in held.value:
                    groups.setdefault(k, []).append(i)
            vecs = b.column("vec")
            for k, rows in groups.items():
                c = held.value[k]
                dot = unit(vecs.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), -1)) @ c.T
                home = dot.argmax(axis=1)
                if k not in gaps:
                    gaps[k] = np.sqrt(np.maximum(0.0, 2 - 2 * (c @ c.T))) + 1e-7
                near = (dot.max(axis=1)[:, None] - dot <= chord * gaps[k][home]) & (np.arange(len(c)) > home[:, None])
                cell[0][rows] = home
                i, g = np.nonzero(near)
                at.append(np.array(rows)[i])
                cell.append(g)
            home = np.concatenate([np.ones(len(key), bool), *[np.zeros(len(x), bool) for x in at[1:]]])
            at, cell = np.concatenate(at), np.concatenate(cell)
            for s in range(0, len(at), 4096):
                part = b.take(pa.array(at[s : s + 4096]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell[s : s + 4096].astype(np.int32)), pa.array(home[s : s + 4096])], names=[*part.schema.names, "cell", "home"])

    kind = nodes.schema["label"].dataType.simpleString()
    return nodes.select("label", "dim", "vec", "node", "weight").mapInArrow(run, f"label {kind}, dim int, vec {nodes.schema['vec'].dataType.simpleString()}, node long, weight long, cell int, home boolean")


def compare(a: pd.DataFrame, b: pd.DataFrame | None, threshold: float) -> pd.DataFrame:
    """Links of one product, or of one block with itself: of each linked vector the weight of its partners here and
    the smallest id of its component here. Components, not pairs, leave the task."""
    x = unit(np.stack(a["vec"].to_list()))
    if b is None:
        i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        node, weight = a["node"].to_numpy(), a["weight"].to_numpy()
    else:
        i, j = np.nonzero(x @ unit(np.stack(b["vec"].to_list())).T >= threshold)
        j = j + len(a)
        node, weight = np.concatenate([a["node"], b["node"]]), np.concatenate([a["weight"], b["weight"]])
    links = np.zeros(len(node), np.int64)
    np.add.at(links, i, weight[j])
    np.add.at(links, j, weight[i])
    root = node.copy()
    while len(i):
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (before == root).all():
            break
    some = np.unique(np.concatenate([i, j])).astype(np.int64)
    return pd.DataFrame({"node": node[some], "links": links[some], "root": root[some]})


def block_links(cells: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``(node, links, root)`` of all products: homes with homes, and guests with homes, in blocks dealt by a hash."""
    sizes = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.when(F.col("home"), 1)) / block).cast("int").alias("homes"), F.ceil(F.count(F.when(~F.col("home"), 1)) / block).cast("int").alias("guests"))
    rows = cells.join(sizes, ["label", "dim", "cell"])

    def own(n: str) -> F.Column:
        return F.pmod(F.xxhash64(F.lit("block"), "node"), F.greatest(F.col(n), F.lit(1))).cast("int")

    home = rows.where("home").withColumn("own", own("homes"))
    others = F.sequence(F.lit(0), F.col("homes") - 1)
    pair = F.transform(others, lambda o: F.struct(F.lit("h").alias("kind"), F.least("own", o).alias("a"), F.greatest("own", o).alias("b"), (F.col("own") > o).cast("int").alias("side")))
    guests = F.when(F.col("guests") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("guests") - 1, F.lit(0))), lambda g: F.struct(F.lit("g").alias("kind"), g.alias("a"), F.col("own").alias("b"), F.lit(1).alias("side"))))
    host = F.explode(F.concat(pair, F.coalesce(guests, F.array().cast(guests_type()))))
    guest = F.explode(F.transform(F.when(F.col("homes") > 0, others).otherwise(F.array().cast("array<int>")), lambda o: F.struct(F.lit("g").alias("kind"), own("guests").alias("a"), o.alias("b"), F.lit(0).alias("side"))))
    keep = ["label", "dim", "cell", "node", "weight", "vec"]
    dealt = home.select(*keep, host.alias("x")).unionByName(rows.where("not home").select(*keep, guest.alias("x")))
    dealt = dealt.select(*keep, "x.kind", "x.a", "x.b", "x.side")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        a, b = p[p["side"] == 0], p[p["side"] == 1]
        same = p["kind"].iloc[0] == "h" and p["a"].iloc[0] == p["b"].iloc[0]
        if not same and (a.empty or b.empty):
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        return compare(a, None if same else b, threshold)

    return dealt.groupBy("label", "dim", "cell", "kind", "a", "b").applyInPandas(run, "node long, links long, root long")


def guests_type() -> str:
    return "array<struct<kind:string,a:int,b:int,side:int>>"


def near_duplicate_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row a vector: ``id``, ``n_links``, ``component``, ``kept``.

    Vectors of the same label and length with a cosine of at least ``threshold`` (in double precision) are linked. Null
    ids, labels or vectors, zero vectors and vectors with null or non-finite components link with nothing: they are
    their own component. Equal vectors are one node with a weight, so copies cost no pairs, yet count as links.
    Repeated rows count each; an empty table gives an empty result; other columns are ignored.
    """
    rows, nodes = nodes_of(vectors, id_col, vec_col, label_col)
    nodes = materialize(nodes, "vectors")
    cells = materialize(placed(nodes, centroids(nodes), threshold), "cells")
    links = materialize(block_links(cells, threshold), "links")
    roots = connected_components(links.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    found = links.groupBy("node").agg(F.sum("links").alias("links")).join(roots, "node", "left").select("node", "links", "root")
    of = nodes.join(found, "node", "left").select("label", "dim", "vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("component"))
    out = rows.join(of, ["label", "dim", "vec"], "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
