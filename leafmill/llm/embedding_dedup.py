"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Vectors of one label are dealt to blocks of about `TILE` rows; each pair of blocks is a tile, a task's
unit of work, so that a label with a third of all rows is many tiles like the others.  Unit vectors are
quantised to int8, each with its own scale s, once; only these go to the tiles.  In a tile one exact integer product
gives s_a s_b (q_a . q_b).  With e the norm of a vector's quantisation error and g that of what was
kept, the true cosine differs by at most g_a e_b + e_a g_b + e_a e_b.  Pairs that reach the threshold by
more than that are links, pairs that miss it by more are none.  The others are computed again in double
precision: a tile names them, packed in one row, and gets the full vectors of just the rows in them.

A tile returns no pairs but, for each vector with links, their number and the smallest id that it
reaches within the tile; so a large group of copies costs rows, not pairs.

Vectors that are null, of no length, zero, or with a null or non-finite component, and those without
a label or id link with nothing.  Vectors of one label but different lengths do not link.  Rows
that share an id are one vector (the one with the smallest label and components) and each get its
result; a null id has a null component and is kept.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.graph import components, roots, saved
from leafmill.llm.memory import lean

TILE = 4096
#: Most rows of the table of labels that is broadcast; a larger one is joined by shuffle.
FEW_LABELS = 100_000
FOUND = "id long, n_links long, root long"
SMALL = "group long, id long, size int, q binary, scale double, kept double, error double, block int, blocks int"
TOLD = f"group long, low int, high int, {FOUND}, pairs binary"


def scaled(x: np.ndarray) -> np.ndarray:
    """The vectors times powers of two, so that no square is too large or too small; cosines stay exactly as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, norms of the kept part, norms of the error."""
    scale = np.maximum(np.abs(unit).max(1), 1e-30) / 127
    q = np.rint(unit / scale[:, None])
    kept = q * scale[:, None]
    slack = 1e-12 * unit.shape[1]  # double-precision rounding in these very figures
    return q.astype(np.int8), scale, np.linalg.norm(kept, axis=1) + slack, np.linalg.norm(unit - kept, axis=1) + slack


def bounded_pairs(x: tuple, y: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of quantised vectors x and y (`quantised`): rows whose cosine may reach the threshold, and whether it surely does."""
    (qx, sx, gx, ex), (qy, sy, gy, ey) = x, y
    exact = np.float32 if qx.shape[1] * 127 * 127 < 1 << 24 else np.float64  # holds the integer products exactly
    qx, qy = qx.astype(exact), qy.astype(exact)
    left, right, sure = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for a in range(0, len(qx), 256):
        b = min(a + 256, len(qx))
        product = (qx[a:b] @ qy.T).astype(np.float64) * sx[a:b, None] * sy
        bound = gx[a:b, None] * ey + ex[a:b, None] * gy + ex[a:b, None] * ey
        i, j = np.nonzero(product + bound >= threshold)
        left.append(a + i)
        right.append(j)
        sure.append(product[i, j] - bound[i, j] > threshold)
    return np.concatenate(left), np.concatenate(right), np.concatenate(sure)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x with those of y, in double precision."""
    x, y = scaled(x), scaled(y)
    return np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def _linked(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of these ids (sorted) that links (a, b) name by place: id, number of links, least id reached."""
    links = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
    some = np.flatnonzero(links)
    return ids[some], links[some].astype(np.int64), ids[roots(len(ids), a, b)[some]]


def _tile(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, block, sizes = (table[c].to_numpy() for c in ("id", "block", "size"))
        group, low, high = (k.as_py() for k in key)
        figures = [table[c].to_numpy() for c in ("scale", "kept", "error")]
        flat = np.frombuffer(b"".join(table["q"].to_pylist()), np.int8)
        start = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        none = [np.zeros(0, np.int64)]
        one, two, open_ = [*none], [*none], [np.zeros((0, 2), np.int64)]
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            q = flat[start[at][:, None] + np.arange(size)]
            x, y = np.flatnonzero(block[at] == low), np.flatnonzero(block[at] == high)
            pick = lambda some: (q[some], *(f[at[some]] for f in figures))  # noqa: B023, E731
            a, b, sure = bounded_pairs(pick(x), pick(y), threshold)
            a, b = at[x[a]], at[y[b]]
            keep = a < b if low == high else np.ones(len(a), bool)
            one.append(a[keep & sure])
            two.append(b[keep & sure])
            open_.append(np.stack([a[keep & ~sure], b[keep & ~sure]], 1))
        found = _linked(ids, np.concatenate(one), np.concatenate(two))
        pairs = ids[np.concatenate(open_)]
        n, extra = len(found[0]), int(len(pairs) > 0)
        return pa.table({
            **{c: pa.array([v] * (n + extra), k) for c, v, k in (("group", group, pa.int64()), ("low", low, pa.int32()), ("high", high, pa.int32()))},
            **{c: pa.array([*v.tolist(), *[None] * extra], pa.int64()) for c, v in zip(("id", "n_links", "root"), found, strict=True)},
            "pairs": pa.array([None] * n + [pairs.astype("<i8").tobytes()] * extra, pa.binary()),
        })

    return run


def _recomputed(threshold: float):
    def run(key: tuple, table: pa.Table, rows: pa.Table) -> pa.Table:
        pairs = np.frombuffer(table["pairs"][0].as_buffer(), "<i8").reshape(-1, 2)
        rows = rows.sort_by("id")
        ids, found = rows["id"].to_numpy(), []
        vectors = rows["vector"].to_pylist()
        place = np.searchsorted(ids, pairs)
        for a in range(0, len(place), 4096):
            some = place[a : a + 4096]
            for size in {len(vectors[i]) for i in some[:, 0].tolist()}:
                own = np.array([p for p in some.tolist() if len(vectors[p[0]]) == size])
                x, y = (np.array([vectors[i] for i in own[:, k]], np.float64) for k in (0, 1))
                found.append(own[cosines(x, y) >= threshold])
        links = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pa.table(dict(zip(("id", "n_links", "root"), _linked(ids, links[:, 0], links[:, 1]), strict=True)))

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: id, n_links, component_id, kept (the component's smallest id)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = rows.where(
        "id is not null and label is not null and size(vector) > 0 and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(vector, x -> x <> 0)"
    )
    sound = sound.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v")).select("id", "v.label", "v.vector")
    sound = saved(sound, "vectors")
    counts = saved(sound.groupBy("label").agg(F.count("*").alias("n")).select("label", F.ceil(F.col("n") / TILE).cast("int").alias("blocks"), F.monotonically_increasing_id().alias("group")), "labels")
    counts = F.broadcast(counts) if counts.count() <= FEW_LABELS else counts
    dealt = sound.join(counts, "label").select("group", "id", "vector", "blocks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch["vector"].offsets.to_numpy())
            flat, begin = batch["vector"].flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
            out: list = [None] * len(size)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                x = scaled(flat[begin[at][:, None] + np.arange(n)])
                for i, *figures in zip(at.tolist(), *quantised(x / np.linalg.norm(x, axis=1)[:, None]), strict=True):
                    out[i] = figures
            columns = [pa.array([v[k] if k else v[k].tobytes() for v in out], pa.float64() if k else pa.binary()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch["group"], batch["id"], pa.array(size, pa.int32()), *columns, batch["block"], batch["blocks"]], names=[f.split()[0] for f in SMALL.split(", ")])

    quick = dealt.mapInArrow(lean(small), SMALL).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = quick.select("group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "size", "q", "scale", "kept", "error", "block")
    told = saved(tiles.groupBy("group", "low", "high").applyInArrow(_tile(threshold), TOLD), "tile-links")
    asked = told.where("pairs is not null").select("group", "low", "high", "pairs")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, low, high, pairs in zip(*(batch[c] for c in ("group", "low", "high", "pairs")), strict=True):
                ids = np.unique(np.frombuffer(pairs.as_buffer(), "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(ids), t) for k, t in ((g, pa.int64()), (low, pa.int32()), (high, pa.int32()))] + [pa.array(ids)], names=["group", "low", "high", "id"])

    wanted = asked.mapInArrow(lean(named), "group long, low int, high int, id long").join(sound.select("id", "vector"), "id")
    again = asked.groupBy("group", "low", "high").cogroup(wanted.groupBy("group", "low", "high")).applyInArrow(_recomputed(threshold), FOUND)
    found = saved(told.where("id is not null").select("id", "n_links", "root").unionByName(again), "links")
    links = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    parts = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    out = rows.select("id").join(links, "id", "left").join(parts, "id", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
