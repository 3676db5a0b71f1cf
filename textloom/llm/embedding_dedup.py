"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside them.

Equal vectors become one node with a count. A spherical k-means is fitted on a bounded
sample (``SAMPLE_ROWS``); every node then belongs to the cell of its nearest centroid,
its home. A pair with the wanted cosine can lie on two sides of a border, so a node also
visits cells of smaller number whose border it is near:

    (v.c_home - v.c_other) / |c_home - c_other| <= margin.

With ``exact=True`` the margin is sin(acos(threshold)), beyond which no such pair can
cross a border, and the links are exact. Otherwise it is ``Z`` standard deviations of how
far a partner in a random direction lies from v across the border, Z * sin / sqrt(dim):
borders between cells are crossed unseen by a pair in some 30,000, at a fraction of the
visits; tests measure the recall against brute force.

A cell is compared in blocks of at most ``BLOCK`` home rows by ``BLOCK`` rows, each a task's
piece of its own, so a cell that holds a third of all rows is many blocks. A block
returns link counts per node and a spanning forest of its links, never all pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of another length than most are compared among themselves;
repeated ids and vectors keep their rows; null ids take part, and name a component only
if no row of it has an id (then it is null); an empty table gives an empty result; the
labels and any extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import forget, stored
from textloom.llm.components import connected_components

SAMPLE_ROWS = 32_768
MOST_CELLS = 2_048
BLOCK = 1_024
Z = 4.0
#: Rows without an id get numbers from here on, one each; real ids are smaller.
NO_ID = 2**62


def unit_rows(blobs, dtype: str) -> np.ndarray:
    """(n, dim) unit vectors in double precision from equally long binary rows."""
    x = np.frombuffer(b"".join(blobs), dtype).reshape(len(blobs), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """Unit centroids; an empty cell is given the row that its own centroid fits worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = x @ c.T
        home = near.argmax(axis=1)
        fit = near[np.arange(len(x)), home]
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        size = np.sqrt((total * total).sum(axis=1))
        gone = np.flatnonzero(size < 1e-9)
        total[gone] = x[np.argsort(fit, kind="stable")[: len(gone)]]
        size[gone] = 1
        c = total / size[:, None]
    return np.unique(c, axis=0)


def cells_of(x: np.ndarray, centroids: np.ndarray, margin: float):
    """Home cell of each row, and (row, cell) visits to cells of smaller number."""
    home = np.zeros(len(x), np.int64)
    rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    gap = np.sqrt(np.maximum(2 - 2 * (centroids @ centroids.T), 1e-24))
    for k in range(0, len(x), 4096):
        near = x[k : k + 4096] @ centroids.T
        h = near.argmax(axis=1)
        home[k : k + 4096] = h
        i, j = np.nonzero((near[np.arange(len(h)), h][:, None] - near <= margin * gap[h]) & (np.arange(near.shape[1])[None, :] < h[:, None]))
        rows.append(i + k)
        cells.append(j)
    return home, np.concatenate(rows), np.concatenate(cells)


def near_duplicates(table: DataFrame, threshold: float = 0.95, exact: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (one per component)."""
    spark = table.sparkSession
    double = "double" in dict(table.dtypes)[vector_col]
    dtype = "<f8" if double else "<f4"
    element = pa.float64() if double else pa.float32()

    def valid(batches):
        for batch in batches:
            out = []
            for v in batch.column(1):
                a = np.asarray(v.values.cast(element).to_numpy(zero_copy_only=False), dtype) if v.is_valid and v.values.null_count == 0 else None
                out.append(a.tobytes() if a is not None and len(a) and np.isfinite(a).all() and a.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vector"])

    narrow = table.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + F.monotonically_increasing_id()).alias("vec_id"), F.col(vector_col).alias("v"))
    vectors = stored(narrow.mapInArrow(valid, "vec_id long, vector binary").withColumn("key", F.md5("vector")), "vectors")
    nodes = stored(
        vectors.where("vector IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("vector").alias("vector")).withColumn("dim", F.octet_length("vector")),
        "vector-nodes",
    )
    count, dims = 0, [(r["dim"], r["n"]) for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()]
    if dims:
        dim, count = dims[0]
        sample = nodes.where(F.col("dim") == dim).select("vector", F.xxhash64("key").alias("h")).orderBy("h").limit(SAMPLE_ROWS)
        seen = unit_rows([r["vector"] for r in sample.collect()], dtype)
        k = max(1, min(MOST_CELLS, len(seen) // 8, math.isqrt(count) // 2))
        centroids = spherical_kmeans(seen, k)
    else:
        dim, centroids = 0, np.zeros((0, 1))
    sine = math.sqrt(1 - threshold * threshold)
    width = centroids.shape[1]
    margin = sine if exact else min(sine, Z * sine / math.sqrt(width))
    shared = spark.sparkContext.broadcast(centroids)  # MOST_CELLS rows at most

    def place(batches):
        """A row per node and cell: role 0 at home, 1 on a visit."""
        for batch in batches:
            size = batch.column("dim").to_numpy()
            usual = np.flatnonzero(size == dim)
            odd = np.flatnonzero(size != dim)
            cell, row, role = -size[odd].astype(np.int64), odd, np.zeros(len(odd), np.int64)
            if len(usual):
                x = unit_rows([v.as_py() for v in batch.column("vector").take(pa.array(usual))], dtype)
                home, i, j = cells_of(x, shared.value, margin)
                cell = np.concatenate([cell, home, j])
                row = np.concatenate([row, usual, usual[i]])
                role = np.concatenate([role, np.zeros(len(usual), np.int64), np.ones(len(i), np.int64)])
            taken = batch.select(["node", "n", "vector"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(role.astype(np.int32)), *taken.columns], ["cell", "role", "node", "n", "vector"])

    placed = stored(nodes.mapInArrow(place, "cell long, role int, node long, n long, vector binary"), "vector-cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.sum(1 - F.col("role")) / BLOCK).cast("int").alias("homes"), F.ceil(F.count("*") / BLOCK).cast("int").alias("alls"))
    # as ``home`` a row meets every part of the cell's rows, as ``other`` every part of its homes;
    # a cell's number of parts comes with a broadcast of at most MOST_CELLS rows and one per odd length
    with_size = placed.join(F.broadcast(sizes), "cell")
    salt = F.xxhash64("node", F.lit(1))
    as_home = with_size.where("role = 0").select(
        "cell", F.pmod(salt, F.col("homes")).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("q"), F.lit(True).alias("home"), "role", "node", "n", "vector"
    )
    as_other = with_size.select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("p"), F.pmod(salt, F.col("alls")).cast("int").alias("q"), F.lit(False).alias("home"), "role", "node", "n", "vector"
    )
    blocks = as_home.unionByName(as_other).select(F.xxhash64("cell", "p", "q").alias("block"), "home", "role", "node", "n", "vector")

    def compare(batches):
        from textloom.llm.simhash import spanning_forest

        def work(part):
            home = part.column("home").to_numpy(zero_copy_only=False)
            if not home.any() or home.all():
                return None
            role, node, n = (part.column(c).to_numpy(zero_copy_only=False) for c in ("role", "node", "n"))
            x = unit_rows(part.column("vector").to_pylist(), dtype)
            h, o = np.flatnonzero(home), np.flatnonzero(~home)
            links = x[h] @ x[o].T >= threshold
            links &= node[h][:, None] != node[o][None, :]
            visit = role[o] == 1
            weight = links @ n[o].astype(np.float64)
            back = n[h].astype(np.float64) @ links[:, visit]  # a pair of two homes is met from both sides
            i, j = np.nonzero(links)
            names, index = np.unique(node, return_inverse=True)
            a, b = index[h[i]], index[o[j]]
            once = np.unique(np.minimum(a, b) * len(names) + np.maximum(a, b))
            a, b = once // len(names), once % len(names)
            kept = spanning_forest(len(names), a, b, np.zeros(len(a), np.int64))
            some, more = weight > 0, back > 0
            who = np.concatenate([node[h][some], node[o][visit][more], names[a[kept]]])
            with_ = np.concatenate([np.full(int(some.sum() + more.sum()), -1), names[b[kept]]])
            linked = np.concatenate([weight[some], back[more], np.zeros(len(kept))]).astype(np.int64)
            counts = np.arange(len(who)) < int(some.sum() + more.sum())
            return pa.RecordBatch.from_arrays([pa.array(who), pa.array(with_, mask=counts), pa.array(linked)], ["a", "b", "links"])

        held = None
        for batch in batches:  # sorted by block; only the last block of a batch can go on in the next
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = held.column("block").to_numpy()
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            for i, j in zip([0, *cut[:-1].tolist()], cut.tolist()):
                if (out := work(held.slice(i, j - i).combine_chunks())) is not None:
                    yield out
            held = held.slice(int(cut[-1]) if len(cut) else 0)
        if held is not None and held.num_rows and (out := work(held.combine_chunks())) is not None:
            yield out

    found = stored(blocks.repartition("block").sortWithinPartitions("block").mapInArrow(compare, "a long, b long, links long"), "vector-links")
    component = connected_components(found.where("b IS NOT NULL").select("a", "b"), "vectors")
    direct = found.groupBy("a").agg(F.sum("links").alias("others")).withColumnRenamed("a", "node")
    classes = stored(
        nodes.select("key", "node", "n").join(direct, "node", "left").join(component, "node", "left")
        .select("key", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")),
        "vector-classes",
    )
    for done in (placed, nodes):
        forget(done)
    out = vectors.select("vec_id", "key").join(classes, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    null = lambda c: F.when(F.col(c) < NO_ID, F.col(c)).alias(c)
    return out.select(null("vec_id"), "n_links", null("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))
