"""Embedding near-dedup by collision-counting projections.

Each vector is projected on many random lines. Lines are taken in GROUPS groups of some lines each; in a group a query's
window reaches REACH standard deviations (of the projected difference of a pair at the threshold) to both sides on every
line, and a vector collides with the query in that group if it lies in all of the windows. Sorting each line into cells
CELL windows wide turns the windows into equi-joins: a vector stands in one cell of the group's lines and looks into
the one or two cells on each line that its window touches. Collisions are counted for each pair, and pairs with as many
as the binomial law gives a true pair with probability ``recall`` are verified by exact cosine.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import parts
from tessera.operators.components import connected_components
from tessera.plans.stage import materialize, release

GROUPS, REACH = 14, 2.0
#: Width of a cell in windows: a window touches 1 + 1/CELL cells of a line on average.
CELL = 1.5


def lines_for(rows: int) -> int:
    """Lines a group so that unlike pairs, each line passing about 0.22 of them, leave a few candidates a row at any size."""
    return max(3, math.floor(math.log(max(rows, 2)) / math.log(4.5)))


def least_collisions(per_group: float, groups: int, recall: float) -> int:
    """The largest count that a true pair reaches with probability ``recall`` or more."""
    tail = 0.0
    for n in range(groups, -1, -1):
        tail += math.comb(groups, n) * per_group**n * (1 - per_group) ** (groups - n)
        if tail >= recall:
            return max(1, n)
    return 1



def near_vectors(rows: DataFrame, threshold: float = 0.98, recall: float = 0.9995, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id_col, n_links, component_id, kept for every row with an id.

    Vectors are compared where labels are equal and not null and lengths are equal. Vectors that are null, empty, zero or
    hold null or non-finite components, and those without a label, link with nothing. Equal vectors of a label are one
    class and are joined as one; their links to each other count for all of them. Rows that repeat an id are one vector
    (the least); rows with a null id are left out: they are no vector of the result. An empty table gives no rows; other
    columns are not read, whatever their names.
    """
    own = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.struct(F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))).alias("r")).select("id", "r.label", "r.v")
    fine = F.coalesce(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull()
    base = materialize(own.withColumn("fine", fine), "vectors")
    classes = materialize(base.where("fine").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    s = lines_for(most)
    dims = [r["d"] for r in classes.select(F.size("v").alias("d")).distinct().collect()]
    rng = np.random.default_rng(seed)
    planes = {d: rng.standard_normal((d, GROUPS * s)) for d in sorted(dims)}
    width = 2 * REACH * math.sqrt(2 - 2 * threshold) * CELL
    shift = rng.random(GROUPS * s)
    salt = rng.integers(1, 1 << 62, s, dtype=np.int64) | 1

    def keyed(side: str):
        def run(it):
            for b in (x for batch in it for x in parts(batch, 1 << 20)):
                vs, reps, labels = b.column(0).to_pylist(), b.column(1), b.column(2)
                out = []
                by: dict[int, list[int]] = {}
                for i, v in enumerate(vs):
                    by.setdefault(len(v), []).append(i)
                for d, at in by.items():
                    x = np.array([vs[i] for i in at])
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    proj = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ planes[d] / width + shift
                    proj = proj.reshape(len(at), GROUPS, s)
                    low = np.floor(proj if side == "stands" else proj - 0.5 / CELL).astype(np.int64)
                    which, group = (x.ravel() for x in np.indices((len(at), GROUPS)))
                    own, cells = proj.reshape(-1, s), low.reshape(-1, s)
                    if side == "looks":  # all combinations of the cells touched, line by line
                        touched = np.floor(proj + 0.5 / CELL).astype(np.int64).reshape(-1, s) > cells
                        for line in range(s):
                            more = np.flatnonzero(touched[:, line])
                            second = cells[more].copy()
                            second[:, line] += 1
                            cells, touched = np.vstack([cells, second]), np.vstack([touched, touched[more]])
                            which, group, own = np.r_[which, which[more]], np.r_[group, group[more]], np.vstack([own, own[more]])
                    key = (cells * salt).sum(axis=1) * np.int64(64) + group
                    rows = pa.array(np.array(at)[which])
                    out.append(pa.record_batch([labels.take(rows), pa.array(key), pa.array(group.astype(np.int32)), reps.take(rows), pa.array(np.full(len(which), d, np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(own.ravel()), s).cast(pa.list_(pa.float64()))], names=["label", "key", "grp", "rep", "d", "at"]))
                yield from out

        kind = classes.schema["label"].dataType.simpleString()
        return classes.select("v", "rep", "label").mapInArrow(run, f"label {kind}, key long, grp int, rep long, d int, at array<double>")

    a, b = keyed("looks").alias("a"), keyed("stands").alias("b")
    within = F.expr(f"forall(zip_with(a.at, b.at, (x, y) -> abs(x - y) <= {0.5 / CELL}D), t -> t)")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("label", "key", "grp", "d")]
    met = a.join(b, [*same, F.col("a.rep") < F.col("b.rep")]).where(within)
    p1 = math.erf(REACH / math.sqrt(2)) ** s
    need = least_collisions(p1, GROUPS, recall)
    counted = met.groupBy(F.col("a.rep").alias("x"), F.col("b.rep").alias("y")).agg(F.count_distinct(F.col("a.grp")).alias("hits")).where(F.col("hits") >= need).select("x", "y")
    vec = classes.select("rep", "v")
    both = counted.join(vec.select(F.col("rep").alias("x"), F.col("v").alias("vx")), "x").join(vec.select(F.col("rep").alias("y"), F.col("v").alias("vy")), "y")

    def verify(it):
        for batch in it:
            for part in parts(batch, 1 << 22):
                good = np.zeros(part.num_rows, bool)
                size = np.array([len(v) for v in part.column("vx")])
                for d in np.unique(size):
                    at = pa.array(np.flatnonzero(size == d))
                    x, y = (part.column(c).take(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) for c in ("vx", "vy"))
                    good[at.to_numpy()] = cosines(x, y) >= threshold
                yield pa.record_batch([part.column("x"), part.column("y")], names=["x", "y"]).filter(pa.array(good))

    links = materialize(both.select("x", "y", "vx", "vy").mapInArrow(verify, "x long, y long"), "vector-links")
    comp = connected_components(links, "x", "y")
    size = classes.select("rep", "n")
    degree = links.select(F.col("x").alias("rep"), F.col("y").alias("o")).union(links.select(F.col("y").alias("rep"), F.col("x").alias("o"))).join(size.select(F.col("rep").alias("o"), F.col("n").alias("m")), "o").groupBy("rep").agg(F.sum("m").alias("far"))
    per = classes.join(degree, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left").select("label", "v", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = base.where("fine").join(per, ["label", "v"]).select("id", "n_links", "component_id")
    out = out.union(base.where("NOT fine").select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row in double precision; scaled first, so that very large or small components neither overflow nor vanish."""
    a, b = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def cosine(x: list[float], y: list[float]) -> float:
    return float(cosines(np.array([x]), np.array([y]))[0])
