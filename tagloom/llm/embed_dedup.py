"""Near-duplicate embeddings by an exact metric range join.

Vectors are compared only within equal labels.  On unit vectors a cosine of at
least c is a distance of at most eps = sqrt(2 - 2c).  Each label has pivots;
a vector belongs to the cell of its nearest pivot.  By the triangle inequality
a vector x of cell p can have a partner in cell q only if x is within eps of the
border between them: (d(x,q)**2 - d(x,p)**2) / (2 d(p,q)) <= eps; then x is
also sent to q.  Cells are joined independently: every vector meets the members
of its cell and those sent to it, block by block, so that a large cell is many
tasks, and no pair is missed or counted twice.  A block pair gives counts and a
spanning forest of its links, never the pairs.

Vectors that are equal component by component are one class from the start and
count as links of each other (their cosine is 1).  Vectors that are null, empty,
zero, or have null or non-finite components, and those with a null label, link
with nothing.  Vectors of different length never link.  Rows that repeat a
vec_id are vectors of their own with the same id.  Only vec_id, label and
embedding are read, whatever else the table has; an empty table gives an empty
result.  Rows of a large cell and of a large class are dealt over tasks in pieces.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pieces_of, staged
from .graph import components

#: Distances are widened by this much, so that rounding never hides a pair from its cell.
ROUNDING = 1e-7


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles from a binary column whose values have one length."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def vectors(rows: DataFrame) -> DataFrame:
    """id, group (label and length), unit (unit vector, packed doubles), f1, f2 (its fingerprint) of every vector that can link."""

    def packed(batches):
        for batch in batches:
            out: dict[str, list] = {"id": [], "grp": [], "vec": []}
            for i, label, v in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if not v or any(x is None for x in v):
                    continue
                a = np.array(v, np.float64)
                size = np.linalg.norm(a) if np.isfinite(a).all() else 0.0
                if not (size > 0 and np.isfinite(size)):
                    if not (np.isfinite(a).all() and a.any()):
                        continue
                    a = a / np.abs(a).max()  # squares over- or underflow
                    size = np.linalg.norm(a)
                out["id"].append(i)
                out["grp"].append(f"{len(a)}:{label}")
                out["vec"].append((a / size).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int64()), pa.array(out["grp"], pa.string()), pa.array(out["vec"], pa.binary())], names=["id", "grp", "vec"])

    base = rows.select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null and label is not null and v is not null")
    return map_batches(base, packed, "id bigint, grp string, vec binary").withColumn("f1", F.xxhash64("grp", "vec")).withColumn("f2", F.xxhash64("vec", "grp", F.lit(9)))


def _pivots(classes: DataFrame, counts: dict[str, int], per_cell: int, most: int, salt: int) -> dict[str, np.ndarray]:
    """Pivots by group: about one for per_cell vectors, chosen by hash; at most about `most` over all groups."""
    total = max(1, sum(n // per_cell for n in counts.values()))
    shrink = min(1.0, most / total)
    share = {g: min(1.0, shrink / per_cell) if n > per_cell else 0.0 for g, n in counts.items()}
    if not any(share.values()):
        return {}
    rate = max(share.values())
    steps = 1 << 30
    big = [g for g, s in share.items() if s]
    rows = classes.where(F.col("grp").isin(big)).where(F.pmod(F.xxhash64(F.lit(salt), "rid"), F.lit(steps)) < int(steps * rate)).select("grp", "rid", "vec").collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r["rid"]):
        out.setdefault(r["grp"], []).append(np.frombuffer(r["vec"], "<f8"))
    return {g: np.array(v) for g, v in out.items()}


def dedup(rows: DataFrame, cosine: float = 0.93, per_cell: int = 4096, block: int = 2048, most_pivots: int = 2000, salt: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    packed = staged(vectors(rows), "vectors")
    classes = packed.groupBy("grp", "f1", "f2").agg(F.min("id").alias("rid"), F.count("*").alias("many"))
    first = packed.select(F.col("id").alias("rid"), "grp", "f1", "f2", "vec")
    classes = staged(first.join(staged(classes, "classes"), ["rid", "grp", "f1", "f2"]).dropDuplicates(["rid", "grp", "f1", "f2"]), "classes")
    # a class is named by its fingerprint: ids may repeat
    rows_ = classes.count()
    large = classes.groupBy("grp").count().where(F.col("count") > max(per_cell, rows_ // most_pivots))  # fewer than most_pivots
    counts = {r[0]: r[1] for r in large.collect()}
    pivots = _pivots(classes, counts, per_cell, most_pivots, salt)
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + ROUNDING

    def dealt(batches):
        apart: dict[str, np.ndarray] = {}  # distances between a label's pivots, once in a task
        for batch in batches:
            groups = np.array(batch.column("grp").to_pylist(), object)
            take, cell, inner = [], [], []
            for g in dict.fromkeys(groups.tolist()):
                at = np.flatnonzero(groups == g)
                if g not in pivots:
                    take.append(at), cell.append(np.zeros(len(at), np.int32)), inner.append(np.ones(len(at), bool))
                    continue
                p = pivots[g]
                x = _matrix(batch.column("vec").take(pa.array(at)))
                d2 = np.maximum(0, 2 - 2 * (x @ p.T))
                near = d2.argmin(axis=1)
                if g not in apart:
                    apart[g] = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))
                between = apart[g][near]
                reach = d2 - d2[np.arange(len(x)), near][:, None] <= 2 * eps * between + ROUNDING
                reach[np.arange(len(x)), near] = True
                i, q = np.nonzero(reach)
                take.append(at[i]), cell.append(q.astype(np.int32)), inner.append(near[i] == q)
            if take:
                got = batch.select(["grp", "f1", "f2", "rid", "many", "vec"]).take(pa.array(np.concatenate(take)))
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array(np.concatenate(cell)), pa.array(np.concatenate(inner))], names=["grp", "f1", "f2", "rid", "many", "vec", "cell", "inner"])

    placed = staged(map_batches(classes, dealt, "grp string, f1 bigint, f2 bigint, rid bigint, many bigint, vec binary, cell int, inner boolean"), "cells")
    sizes = placed.groupBy("grp", "cell").agg(F.ceil(F.count_if("inner") / block).cast("int").alias("ib"), F.ceil(F.count_if(~F.col("inner")) / block).cast("int").alias("ob"), F.count("*").alias("n"))
    sizes = staged(sizes.withColumn("pieces", pieces_of(F.col("n"), placed.count())).drop("n"), "cellsizes").where("ib > 0")
    heavy = F.broadcast(sizes.where("pieces > 1").select("grp", "cell", "pieces"))  # fewer than HEAVY
    piece = F.pmod(F.xxhash64("f2", F.lit(salt)), F.coalesce("pieces", F.lit(1))).cast("int")
    everywhere = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    numbered = placed.join(heavy, ["grp", "cell"], "left").withColumn("piece", piece).drop("pieces").join(everywhere, ["grp", "cell", "piece"]).drop("piece")
    own = F.pmod(F.xxhash64("f1", F.lit(salt)), F.when(F.col("inner"), F.col("ib")).otherwise(F.col("ob"))).cast("int")
    numbered = numbered.withColumn("own", F.when(F.col("inner"), own).otherwise(F.col("ib") + own))
    # block i of the cell's members meets every block j of members and of those sent to it
    as_left = numbered.where("inner").select("grp", "cell", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ib") + F.col("ob") - 1)).alias("j"), F.lit(0).alias("side"), "f1", "rid", "many", "vec")
    as_right = numbered.select("grp", "cell", F.explode(F.sequence(F.lit(0), F.col("ib") - 1)).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "f1", "rid", "many", "vec")
    met = as_left.union(as_right.where("i <> j")).repartition("grp", "cell", "i", "j").sortWithinPartitions("grp", "cell", "i", "j", "side")

    def joined(batches):
        def closed(at, held):
            left = held[0]
            if not left[0] or (at[2] != at[3] and not held[1][0]):
                return None  # a block without rows
            x = np.frombuffer(b"".join(left[3]), "<f8").reshape(len(left[0]), -1)
            f, rid, many = (np.array(left[k]) for k in range(3))
            if at[2] != at[3]:
                right = held[1]
                y, g, qid, mult = np.frombuffer(b"".join(right[3]), "<f8").reshape(len(right[0]), -1), np.array(right[0]), np.array(right[1]), np.array(right[2])
            else:
                y, g, qid, mult = x, f, rid, many
            hit = (x @ y.T >= cosine) & (f[:, None] != g[None, :])
            if not hit.any():
                return None
            n = hit @ mult
            # labels of the block's links: the smallest id spreads until nothing changes
            a, b = rid.copy(), qid.copy()
            i, j = np.nonzero(hit)
            while True:
                was = a.sum(), b.sum()
                low = np.minimum(a[i], b[j])
                np.minimum.at(a, i, low)
                np.minimum.at(b, j, low)
                if (a.sum(), b.sum()) == was:
                    break
            linked, other = hit.any(1), hit.any(0)
            ids = np.concatenate([rid[linked], qid[other]])
            roots = np.concatenate([a[linked], b[other]])
            prints = np.concatenate([f[linked], g[other]])
            links = np.concatenate([n[linked], np.zeros(int(other.sum()), np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(prints), pa.array(ids), pa.array(roots), pa.array(links.astype(np.int64))], names=["f1", "a", "b", "n"])

        at, held = None, None
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("grp", "cell", "i", "j", "side", "f1", "rid", "many", "vec")}
            for key, side, *values in zip(zip(cols["grp"], cols["cell"], cols["i"], cols["j"], strict=True), cols["side"], cols["f1"], cols["rid"], cols["many"], cols["vec"], strict=True):
                if key != at:
                    if held and (out := closed(at, held)):
                        yield out
                    at, held = key, [[[], [], [], []], [[], [], [], []]]
                for k, v in enumerate(values):
                    held[side][k].append(v)
        if held and (out := closed(at, held)):
            yield out

    found = staged(map_batches(met, joined, "f1 bigint, a bigint, b bigint, n bigint"), "found")
    linked = found.groupBy("f1", F.col("a").alias("l_rid")).agg(F.sum("n").alias("n"))
    labels = components(found.select("a", "b"))
    named = classes.select("f1", "f2", "grp", "rid", "many").join(linked.withColumnsRenamed({"f1": "l_f1"}), (F.col("f1") == F.col("l_f1")) & (F.col("rid") == F.col("l_rid")), "left").join(labels, F.col("rid") == F.col("id"), "left")
    pieces = pieces_of(F.col("many"), packed.count())
    copies = F.broadcast(classes.withColumn("pieces", pieces).where("pieces > 1").select("f1", "f2", "pieces"))  # fewer than HEAVY
    named = named.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("part"), (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rid").alias("component"))
    named = staged(named, "named")
    # rows of one vec_id are told apart by their vectors; those that can't link have none
    marked = packed.select("id", "f1", "f2").join(copies, ["f1", "f2"], "left").withColumn("piece", F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1))).cast("int"))
    marks = marked.join(named, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("piece") == F.col("part"))).select("id", "n", "component")
    whole = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"))
    able = marks.select(F.col("id").alias("vec_id"), "n", "component")
    # as many rows of an id as the input has: those without a vector to compare come from the difference
    lone = whole.exceptAll(able.select("vec_id")).select("vec_id", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("component"))
    out = able.union(lone).withColumn("component", F.coalesce(F.least("component", "vec_id"), "vec_id"))
    return out.select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec_id").isNull() | (F.col("component") == F.col("vec_id"))).alias("kept"))
