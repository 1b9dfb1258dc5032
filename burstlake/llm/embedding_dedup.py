"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within and between cells, one vector kept of each group."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstlake.llm.shared import components, cut

#: Centroids of a label or cell are fitted on about so many of its vectors, and so many a cell at most; it is divided into so
#: many cells at most at once; rows of a cell, a block, and a group that is placed; larger cells are divided again, in so many levels.
SAMPLE_ROWS, SAMPLE_OF_CELL, MAX_CELLS, CELL_ROWS, BLOCK_ROWS, PLACE_ROWS, LEVELS = 4096, 128, 256, 2048, 4096, 8192, 4
#: A label is divided from so many times CELL_ROWS on, a cell from so many: each level moves its vectors twice.
DIVIDE, DIVIDE_AGAIN = 2, 32
#: Rows of one product of vectors; links that a task holds before it sums them up.
TILE_ROWS, HELD_LINKS = 512, 1 << 20

#: Rows that are divided or packed, and packed blocks of them.
ROWS = "root long, dim int, path long, slot int, key binary, id long, weight long, x binary, trail binary, cents binary"
BLOCKS = "root long, dim int, path long, slot int, no int, n int, alone boolean, trail binary, cents binary, mid array<double>, wide double, keys binary, ids binary, weights binary, x binary"


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a direction (finite and not zero), and these rows in length 1 and double precision."""
    x = np.asarray(x, np.float64)
    most = np.abs(x).max(1)
    at = np.flatnonzero(np.isfinite(most) & (most > 0))
    if len(at) < len(x):
        x, most = x[at], most[at]
    u = x / most[:, None]
    u /= np.sqrt((u * u).sum(1))[:, None]
    return at, u


def unit(v) -> np.ndarray | None:
    """The vector of length 1 in double precision; None if it is null, empty, zero or holds nulls or non-finite numbers."""
    if v is None or not len(v):
        return None
    _, u = units(np.array([[np.nan if e is None else e for e in v]], np.float64))
    return u[0] if len(u) else None


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(1))
        c = np.where(size[:, None] > 0, total / np.where(size > 0, size, 1)[:, None], c)
    return c


class Block(NamedTuple):
    """Vectors of one cell. trail: the cell's number at each level; cents: its centroid at each level."""

    ids: np.ndarray
    weight: np.ndarray
    u: np.ndarray
    f: np.ndarray
    trail: np.ndarray
    cents: np.ndarray


def border(a: Block, b: Block, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows of two blocks that can link with one of the other block.

    Where their trails part, the rows' cells are the nearest of the same centroids, so two rows with cosine `least` or
    more lie on either side of the plane between these two centroids, and neither is farther from it than sin(acos(least)).
    """
    for p, q, c, d in zip(a.trail, b.trail, a.cents, b.cents, strict=False):
        if p != q:
            side = c - d
            reach = np.sqrt(max(0.0, 1 - least * least)) * np.sqrt(side @ side) + 1e-9
            return np.flatnonzero(a.u @ side <= reach), np.flatnonzero(b.u @ -side <= reach)
    return np.arange(len(a.ids)), np.arange(len(b.ids))


def joined(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that the links u, v lead to."""
    top = np.arange(n)
    while True:
        least = np.minimum(top[u], top[v])
        if (least == top[u]).all() and (least == top[v]).all():
            return top
        np.minimum.at(top, u, least)
        np.minimum.at(top, v, least)
        while (top[top] != top).any():
            top = top[top]


def groups(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column of a matrix of links the first row of its group, -1 without a link; each is visited once."""
    row, col = np.full(linked.shape[0], -1), np.full(linked.shape[1], -1)
    for k in np.flatnonzero(linked.any(1)).tolist():
        if row[k] >= 0:
            continue
        row[k], front = k, np.array([k])
        while len(front):
            new = np.flatnonzero(linked[front].any(0) & (col < 0))
            col[new] = k
            front = np.flatnonzero(linked[:, new].any(1) & (row < 0))
            row[front] = k
    return row, col


Links = tuple[np.ndarray, np.ndarray, np.ndarray]


def summed(parts: list[Links]) -> Links:
    """(id, n, root) with one row for each id: its links, and an id of its group."""
    ids, n, root = map(np.concatenate, zip(*parts, strict=True))
    node, at = np.unique(np.concatenate([ids, root]), return_inverse=True)
    u, v = at[: len(ids)], at[len(ids) :]
    total = np.zeros(len(node), np.int64)
    np.add.at(total, u, n)
    return node, total, node[joined(u, v, len(node))]


def links(a: Block, b: Block | None, least: float) -> list[Links]:
    """Links of the rows of two blocks, or among those of one: the linked rows' ids, the weight of what they link with, an id of their group.

    Products in single precision tell which pairs surely link or don't; the few that they leave open are decided in double precision.
    """
    other = a if b is None else b
    rows, cols = border(a, other, least)
    slack = (a.u.shape[1] + 8) * 2.0**-23
    f, out = other.f[cols], []
    for t in range(0, len(rows) if len(cols) else 0, TILE_ROWS):
        own = rows[t : t + TILE_ROWS]
        cos = a.f[own] @ f.T
        if cos.max() < least - slack:
            continue
        linked = cos >= least - slack
        if b is None:
            linked &= own[:, None] < cols[None, :]
        i, j = np.nonzero(linked & (cos < least + slack))
        for k in range(0, len(i), 1 << 15):
            p, q = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            linked[p, q] = np.einsum("ij,ij->i", a.u[own[p]], other.u[cols[q]]) >= least
        n = np.count_nonzero(linked)
        if n > linked.size // 64:
            row, col = groups(linked)
            n = linked @ other.weight[cols], a.weight[own] @ linked
        elif n:
            i, j = np.nonzero(linked)
            top = joined(i, len(own) + j, len(own) + len(cols))
            row, col = np.full(len(own), -1), np.full(len(cols), -1)
            row[i], col[j] = top[i], top[len(own) + j]
            n = np.bincount(i, other.weight[cols[j]], len(own)), np.bincount(j, a.weight[own[i]], len(cols))
        else:
            continue
        for ids, top, k in ((a.ids[own], row, n[0]), (other.ids[cols], col, n[1])):
            hit = top >= 0
            out.append((ids[hit], k[hit].astype(np.int64), a.ids[own[top[hit]]]))
    return out


def vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length that vectors of a column of lists have; nulls in them are NaN."""
    at = column.offsets.to_numpy()
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
    values = column.values.to_numpy(zero_copy_only=False)
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        yield rows, values[at[rows][:, None] + np.arange(n)]


def one_of_each(part: pd.DataFrame) -> pd.DataFrame:
    """One row for each key, with the smallest id and the sum of weights; ids in order."""
    part = part.sort_values("id", kind="stable")
    if part["key"].duplicated().any():
        part = part.assign(weight=part.groupby("key")["weight"].transform("sum")).drop_duplicates("key")
    return part


def near_duplicates(df: DataFrame, least: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of df.

    Vectors are compared where labels are equal and not null and lengths are equal; they link if the cosine in double
    precision is `least` or more. Vectors that are null, empty, zero or hold nulls or non-finite numbers, and those
    with a null id, link with nothing. n_links counts the other rows linked directly, component_id is the smallest id
    reachable by links, kept marks the row that bears it (rows with a null id are kept and have a null component).
    Rows with the same id are one vertex with several vectors. Extra columns are left out; an empty table gives none.
    df is read three times and must give the same rows each time.

    Equal vectors are collapsed to one with a weight. Each label is divided into a cell for CELL_ROWS vectors,
    MAX_CELLS at most, by k-means on a seeded sample of SAMPLE_ROWS or less; every vector is placed in its nearest cell. Cells that
    are still large are divided in the same way, up to LEVELS times. A cell's rows are packed into blocks of BLOCK_ROWS.
    A block is compared with itself and, by a nested loop over the table of blocks, with those of the label that aren't too far
    away; of two cells only rows near the plane between them are multiplied. So vectors are written once and no copies of them
    are shuffled, however many cells they are compared with: tables and shuffles grow as df does. A task gives one row for each
    linked vector, its count and its group's root, never the pairs.
    """
    kind = df.schema[embedding].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    real = np.dtype("<f4" if single else "<f8")
    base = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("embedding"))
    base = base.withColumn("dim", F.coalesce(F.size("embedding"), F.lit(0))).withColumn("path", F.xxhash64("label", "dim"))

    def keyed(b: pa.RecordBatch) -> tuple[np.ndarray, list]:
        """Keys of the vectors that can link, None for the others, and the vectors' bytes: the same values (also as a multiple) are one class; length and label belong to its key."""
        key, x = np.full(b.num_rows, None, object), [None] * b.num_rows
        names = b.column("label").to_pylist()
        for rows, m in vectors(b.column("embedding")):
            at, u = units(m)
            for r, v, raw in zip(rows[at].tolist(), u, m[at].astype(real, copy=False), strict=True):
                if names[r] is not None:
                    key[r], x[r] = xxhash.xxh3_128_digest(v.tobytes() + b"|" + names[r].encode()), raw.tobytes()
        return key, x

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("path"), b.column("dim"), pa.array(keyed(b)[0], pa.binary())], ["vec_id", "path", "dim", "key"])

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, x = keyed(b)
            path, dim = (b.column(c).to_numpy(zero_copy_only=False) for c in ("path", "dim"))
            p = pd.DataFrame({"root": path, "dim": dim, "path": path, "slot": 0, "key": key, "id": b.column("vec_id").to_pandas(integer_object_nulls=True), "weight": 1, "x": x, "trail": None, "cents": None})
            p = p[p["key"].notna() & p["id"].notna()]
            if len(p):
                yield pa.RecordBatch.from_pandas(one_of_each(p.astype({"id": "int64"})), rows_schema, preserve_index=False)

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    rows_schema = pa.schema([(name, kinds[k]) for name, k in (c.split() for c in ROWS.split(", "))])
    rows = cut(base.mapInArrow(normal, "vec_id long, path long, dim int, key binary"))
    linkable = F.col("key").isNotNull() & F.col("vec_id").isNotNull()
    classes = cut(rows.where(linkable).groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("path").alias("path")))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(v, real) for v in one_of_each(part)["x"]])
        c = kmeans(units(x)[1], int(part["k"].iloc[0]))
        path = int(part["path"].iloc[0])
        cells = np.array([xxhash.xxh3_64_intdigest(b"%d/%d" % (path, k)) for k in range(len(c))], np.uint64).view(np.int64)
        return pd.DataFrame({"path": path, "cell": cells, "trail": [np.int32(k).tobytes() for k in range(len(c))], "cents": [v.tobytes() for v in c]})

    def place(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        part = one_of_each(part).drop(columns="part")
        if not len(part) or not len(known):
            return part
        x = units(np.stack([np.frombuffer(v, real) for v in part["x"]]))[1]
        c = np.stack([np.frombuffer(v, np.float64)[-x.shape[1] :] for v in known["cents"]])
        home = (x @ c.T).argmax(1)
        # A cell's slots hold about a block each, as this group's share of the cell tells.
        parts, size = int(known["parts"].iloc[0]), np.bincount(home, minlength=len(c))
        slot = int(known["part"].iloc[0]) * np.maximum(1, -(-size * parts // BLOCK_ROWS)) // parts
        first = np.zeros(len(home), bool)
        first[np.unique(home, return_index=True)[1]] = True
        told = {name: np.where(first, known[name].to_numpy()[home], None) for name in ("trail", "cents")}
        return part.assign(path=known["cell"].to_numpy()[home], slot=slot[home].astype(np.int32), **told)

    def divide(rows: DataFrame, need: DataFrame, above: DataFrame | None, level: int) -> tuple[DataFrame, DataFrame]:
        """The rows of the paths that need lists, each in its cell at this level, and these cells. above: the cells of the level before."""
        # need has a row for each label or cell of 2 * CELL_ROWS rows and more, so it is a small share of the rows, and is broadcast.
        met = rows.join(F.broadcast(need), "path")
        drawn = met.where(F.pmod(F.xxhash64(F.lit(9 + level), "key"), F.lit(1 << 30)) <= F.col("share"))
        cells = drawn.groupBy("path").applyInPandas(fit, "path long, cell long, trail binary, cents binary")
        if above is not None:
            before = above.select(F.col("cell").alias("path"), F.col("trail").alias("trail_before"), F.col("cents").alias("cents_before"))
            cells = cells.join(before, "path").select("path", "cell", F.concat("trail_before", "trail").alias("trail"), F.concat("cents_before", "cents").alias("cents"))
        cells = cut(cells)
        # Vectors meet their cell's centroids in groups of about PLACE_ROWS, so that centroids stand once in each group.
        left = met.select(*rows.columns, F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"))
        right = cells.join(F.broadcast(need), "path").select("path", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", "cell", "trail", "cents")
        return left.groupBy("path", "part").cogroup(right.groupBy("path", "part")).applyInPandas(place, ROWS), cells

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        told = part["cents"].first_valid_index()
        trail, cents = (b"", b"") if told is None else (part.at[told, "trail"], part.at[told, "cents"])
        part = one_of_each(part)
        blocks = -(-len(part) // BLOCK_ROWS)
        out = []
        for no in range(blocks):
            p = part.iloc[len(part) * no // blocks : len(part) * (no + 1) // blocks]
            x = b"".join(p["x"])
            u = units(np.frombuffer(x, real).reshape(len(p), -1))[1]
            mid = u.sum(0)
            mid = mid / np.sqrt(mid @ mid) if mid @ mid > 1e-12 else u[0]
            own = {"no": no, "n": len(p), "alone": told is None and blocks == 1, "trail": trail, "cents": cents, "mid": mid, "wide": float(np.arccos(np.clip(u @ mid, -1, 1)).max())}
            out.append({k: int(p[k].iloc[0]) for k in ("root", "dim", "path", "slot")} | own | {"keys": b"".join(p["key"]), "ids": p["id"].to_numpy(np.int64).tobytes(), "weights": p["weight"].to_numpy(np.int64).tobytes(), "x": x})
        return pd.DataFrame(out)

    def packed(rows: DataFrame) -> DataFrame:
        return cut(rows.groupBy("path", "slot").applyInPandas(pack, BLOCKS))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                cuts = lambda v, n=r.n: [v[k * len(v) // n : (k + 1) * len(v) // n] for k in range(n)]
                told = {"trail": [r.trail] + [None] * (r.n - 1), "cents": [r.cents] + [None] * (r.n - 1)}
                yield pd.DataFrame({"root": r.root, "dim": r.dim, "path": r.path, "slot": r.slot, "key": cuts(r.keys), "id": np.frombuffer(r.ids, np.int64), "weight": np.frombuffer(r.weights, np.int64), "x": cuts(r.x)} | told)

    def needed(size: DataFrame) -> tuple[DataFrame, int | None]:
        """What the paths of a table (path, n) are divided by, and the rows of the largest."""
        k = F.least(F.lit(MAX_CELLS), F.ceil(F.col("n") / CELL_ROWS)).cast("int")
        share = F.least(F.lit(SAMPLE_ROWS), k * SAMPLE_OF_CELL) / F.col("n") * (1 << 30)
        need = cut(size.select("path", k.alias("k"), F.ceil(F.col("n") / PLACE_ROWS).cast("int").alias("parts"), share.cast("long").alias("share"), "n"))
        return need.drop("n"), need.agg(F.max("n")).first()[0]

    source = base.mapInArrow(usable, ROWS)
    need, most = needed(classes.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > DIVIDE * CELL_ROWS))
    if most is None:
        blocks = packed(source)
    else:
        placed, cells = divide(source, need, None, 0)
        blocks = packed(source.join(F.broadcast(need), "path", "left_anti").unionByName(placed))
    for level in range(1, LEVELS if most else 0):
        size = blocks.where(F.length("trail") > 0).groupBy("path").agg(F.sum("n").alias("n")).where(F.col("n") > DIVIDE_AGAIN * CELL_ROWS)
        # A cell whose rows are all near one another isn't divided in vain: one that hasn't shrunk stays.
        need, most = needed(size.where(F.col("n") <= 0.75 * most))
        if most is None:
            break
        large = blocks.join(F.broadcast(need), "path", "left_semi").select(*blocks.columns)
        placed, cells = divide(large.mapInPandas(unpack, ROWS), need, cells, level)
        blocks = blocks.join(F.broadcast(need), "path", "left_anti").select(*blocks.columns).unionByName(packed(placed))

    def block(b: pa.RecordBatch, k: int, side: str) -> Block:
        take = lambda name, of: np.frombuffer(b.column(side + name)[k].as_buffer(), of)
        dim = b.column(side + "dim")[k].as_py()
        u = units(take("x", real).reshape(-1, dim))[1]
        return Block(take("ids", np.int64), take("weights", np.int64).astype(np.float64), u, u.astype(np.float32), take("trail", np.int32), take("cents", np.float64).reshape(-1, dim))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, name, a = [], 0, None, None
        tell = lambda found: pa.RecordBatch.from_arrays([pa.array(v) for v in found], ["id", "n", "root"])
        for batch in batches:
            pairs = "r_x" in batch.schema.names
            for k in range(batch.num_rows):
                at = tuple(batch.column("l_" + c)[k].as_py() for c in ("path", "slot", "no"))
                if at != name:  # pairs come with one block on the left after another
                    name, a = at, block(batch, k, "l_")
                found = links(a, block(batch, k, "r_") if pairs else None, least)
                held += found
                size += sum(len(f[0]) for f in found)
                if size > HELD_LINKS:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > HELD_LINKS // 2:
                        yield tell(held[0])
                        held, size = [], 0
        if held:
            yield tell(summed(held))

    seen = ("root", "path", "slot", "no", "alone", "mid", "wide", "dim", "trail", "cents", "ids", "weights", "x")
    left, right = (blocks.select(*(F.col(c).alias(side + c) for c in seen)) for side in ("l_", "r_"))
    order = [F.struct(*(F.col(side + c) for c in ("path", "slot", "no"))) for side in ("l_", "r_")]
    cos = F.aggregate(F.zip_with("l_mid", "r_mid", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))) - F.col("l_wide") - F.col("r_wide")
    near = apart <= F.lit(float(np.arccos(min(1.0, max(-1.0, least)))) + 1e-6)
    pairs = left.where("not l_alone").hint("shuffle_replicate_nl").join(right.where("not r_alone"), (F.col("l_root") == F.col("r_root")) & (order[0] < order[1]) & near)
    shape = "id long, n long, root long"
    # Pairs go to Python as the join makes them: a projection would copy both blocks once more.
    within, between = left.mapInArrow(compare, shape), pairs.mapInArrow(compare, shape)
    found = cut(within.unionByName(between))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))

    # Each class: the links of its vector, and the other rows of the same class.
    tally = classes.join(counts, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    tally = tally.select("key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(tally, "key", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))
