"""Whitening of embeddings by a bidiagonal qd solver.

Four passes over the vectors, none of which shuffles them. The first sums each dimension exactly.
The second takes the centred rows in blocks and keeps of each task the triangle R of a QR
decomposition; the triangles are joined in rounds, a bounded number in each call, until one is
left. R is made bidiagonal by Householder reflections, dqds finds its singular values to high
relative accuracy, and twisted factorisations of the shifted tridiagonal give the directions.
The third pass measures the covariance of the whitened rows, the fourth returns them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import stored

#: An entry c becomes floor(SCALE * c) + SHIFT; entries that reach LARGEST when scaled have no such number.
SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0**62
#: Components that are returned, and rows of a block of a QR decomposition.
COMPONENTS, BLOCK_ROWS = 8, 4096
#: Triangles that one call joins.
FAN_IN = 64
EPS = float(np.finfo(float).eps)


# ---- the rows


def whole(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x (whole numbers) of every row whose vector can be read."""
    v = F.col(vector_col)
    fits = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST / SCALE)
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, fits)).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors of the most frequent length (of equals the longer) and the exact sum of each of their dimensions."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            lengths = b.column(0).value_lengths().to_numpy(zero_copy_only=False)
            for dims in map(int, np.unique(lengths)):
                x = _matrix(b.column(0).filter(pa.array(lengths == dims)), dims)
                n, total = held.get(dims, (0, np.zeros(dims, object)))
                small = int(np.abs(x).max()) * len(x) < 2**62
                held[dims] = n + len(x), total + (x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0))
        out = [(dims, at, n, str(s)) for dims, (n, total) in held.items() for at, s in enumerate(total)]
        columns = zip(*out, strict=True) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["dims", "at", "n", "total"])

    parts = rows.select("x").mapInArrow(add, "dims int, at int, n long, total string")
    counted = stored(parts.groupBy("dims", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")), "whitening-sums")
    best = counted.agg(F.max(F.struct("n", "dims")).alias("b")).first()["b"]
    if best is None:
        return 0, []
    found = counted.where(F.col("dims") == best["dims"]).orderBy("at").collect()  # one row for each dimension
    return int(best["n"]), [int(r["total"]) for r in found]


# ---- R of all centred rows


def triangle(rows: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """R of a QR decomposition of the centred rows, dims x dims."""
    dims, mean_of = len(total), np.array(total, object)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, size = np.zeros((0, dims)), [], 0
        for b in batches:
            held.append(centred(_matrix(b.column(0), dims), n, mean_of))
            size += len(held[-1])
            if size >= BLOCK_ROWS:
                r, held, size = np.linalg.qr(np.vstack([r, *held]), mode="r"), [], 0
        if held:
            r = np.linalg.qr(np.vstack([r, *held]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.astype("<f8").tobytes()])], ["r"])

    def join(parts: pd.DataFrame) -> pd.DataFrame:
        stack = np.vstack([np.frombuffer(x, "<f8").reshape(-1, dims) for x in parts["r"]])
        return pd.DataFrame({"r": [np.linalg.qr(stack, mode="r").astype("<f8").tobytes()]})

    found = stored(rows.where(F.size("x") == dims).select("x").mapInArrow(reduce_rows, "r binary").withColumn("k", F.spark_partition_id()), "whitening-triangles")
    while found.count() > 1:
        ranked = found.select("r", F.floor(F.col("k") / FAN_IN).cast("int").alias("k"))
        found = stored(ranked.groupBy("k").applyInPandas(lambda key, part: join(part).assign(k=key[0]), "r binary, k int"), "whitening-triangles")
    r = np.frombuffer(found.first()["r"], "<f8").reshape(-1, dims)
    return np.vstack([r, np.zeros((dims - len(r), dims))])


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - S/n; n*x - S is taken exactly."""
    return departures(x, n, total).astype(np.float64) / n


def departures(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n*x - S exactly: as 64-bit numbers where these hold it, else as Python's."""
    most = int(np.abs(x).max(initial=0))
    if n * most < 2**62 and all(abs(int(s)) < 2**62 for s in total):
        return n * x - total.astype(np.int64)
    return n * x.astype(object) - total


# ---- the solver


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of B and the orthogonal Q, with r = P B Q'."""
    a, m = np.array(r, float), len(r)
    q = np.eye(m)
    for k in range(m):
        if k < m - 1:
            v = _reflector(a[k:, k])
            a[k:, k:] -= np.outer(v, v @ a[k:, k:])
        if k < m - 2:
            v = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, v)
            q[:, k + 1 :] -= np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def _reflector(x: np.ndarray) -> np.ndarray:
    """v with (I - v v') x = a multiple of the first unit vector."""
    size = np.abs(x).max(initial=0.0)
    if size == 0.0:
        return np.zeros_like(x)
    v = x / size
    norm = np.sqrt(v @ v)
    v[0] += np.copysign(norm, v[0])
    return v * np.sqrt(2.0 / (v @ v))


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The eigenvalues of B'B in falling order, from its squared diagonal q and superdiagonal e.

    Each turn makes one step without a shift, whose pivots d bound the least eigenvalue from both
    sides (1 / sum(1/d) and min d), and one with the greatest shift tried that keeps all pivots
    positive. Only positive numbers are added, so small values keep their relative accuracy.
    """
    top = max(float(np.max(q, initial=0.0)), float(np.max(e, initial=0.0)))
    if top == 0.0:
        return np.zeros(len(q))
    floor = top * 1e-40  # a pivot of zero would end the recurrence; this is far below what doubles resolve of B
    q, e, shift, out = [max(float(x), floor) for x in q], [float(x) for x in e], 0.0, []

    def step(s: float) -> tuple[list[float], list[float], float, float] | None:
        d, least, inverse, qs, es = q[0] - s, np.inf, 0.0, [], []
        for k in range(len(q)):
            if d <= 0.0:
                return None
            least, inverse = min(least, d), inverse + 1.0 / d
            if k < len(q) - 1:
                qs.append(d + e[k])
                t = q[k + 1] / qs[k]
                es.append(e[k] * t)
                d = d * t - s
                if s == 0.0:
                    d = max(d, floor)
        return [*qs, d], es, least, inverse

    while q:
        if len(q) == 1 or e[-1] <= EPS * EPS * (shift + q[-1]):
            out.append(shift + q.pop())
            if e:
                e.pop()
            continue
        q, e, least, inverse = step(0.0)
        for s in (0.999 * least, 0.8 * least, (1.0 - 8 * EPS) / inverse, 0.5 / inverse):
            if shift + s > shift and (found := step(s)) is not None:
                q, e = found[:2]
                shift += s
                break
    return np.sort(np.array(out))[::-1]


def _factors(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """B'B - value as L D L' from the top and U D U' from the bottom: both pivots and multipliers, and the twists gamma."""
    m = len(a)
    tiny = max(float(np.max(np.abs(a), initial=0.0)) ** 2, value) * 1e-60 or 1e-300
    some = lambda x: x if abs(x) > tiny else tiny
    diag, off = a * a, a[:-1] * b
    down, up, low, high = np.empty(m), np.empty(m), np.empty(m - 1), np.empty(m - 1)
    s, p = np.empty(m), np.empty(m)
    s[0] = -value
    for k in range(m - 1):  # stationary qd
        down[k] = some(s[k] + diag[k])
        low[k] = off[k] / down[k]
        s[k + 1] = s[k] * (b[k] * b[k] / down[k]) - value
    down[-1] = some(s[-1] + diag[-1])
    p[-1] = diag[-1] - value
    for k in range(m - 2, -1, -1):  # progressive qd
        up[k + 1] = some(b[k] * b[k] + p[k + 1])
        t = diag[k] / up[k + 1]
        high[k] = off[k] / up[k + 1]
        p[k] = p[k + 1] * t - value
    up[0] = some(p[0])
    return down, low, up, high, s + p + value


def directions(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of B'B for its first eigenvalues, as rows.

    Each comes from the twisted factorisation whose twist is least. Values closer than a
    millionth of their size are a cluster: its vectors are set at right angles to each other and
    refined by solving with the factors of the shifted matrix.
    """
    m, out = len(a), []
    for k, value in enumerate(values):
        down, low, _, high, twist = _factors(a, b, float(value))
        near = [out[j] for j in range(k) if values[j] - value <= 1e-6 * values[j]]
        found = None
        for r in np.argsort(np.abs(twist))[: 1 + len(near)]:
            z = np.zeros(m)
            z[r] = 1.0
            for j in range(r - 1, -1, -1):
                z[j] = -low[j] * z[j + 1]
            for j in range(r, m - 1):
                z[j + 1] = -high[j] * z[j]
            z = _apart(z / np.sqrt(z @ z), near)
            if found is None or z @ z > found @ found:
                found = z
        if near:
            for _ in range(3):
                found = _apart(_solve(down, low, found / np.sqrt(found @ found)), near)
        out.append(found / np.sqrt(found @ found))
    return np.array(out).reshape(len(values), m)


def _apart(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for v in others:
            z = z - (v @ z) * v
    return z


def _solve(down: np.ndarray, low: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = y.copy()
    for k in range(len(low)):
        x[k + 1] -= low[k] * x[k]
    x = x / down
    for k in range(len(low) - 1, -1, -1):
        x[k] -= low[k] * x[k + 1]
    return x / max(np.abs(x).max(), 1e-300)


def principal(r: np.ndarray, n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling) and unit eigenvectors, as rows, of R'R / n, at most `most` of those above rounding, and the trace."""
    a, b, q = bidiagonal(r)
    blocks, start = [], 0
    size = float(np.abs(r).max(initial=0.0))
    for k in range(len(a)):  # where the superdiagonal vanishes the problem falls apart
        if k == len(a) - 1 or abs(b[k]) <= EPS * size:
            blocks.append((start, k + 1))
            start = k + 1
    found = []
    for lo, hi in blocks:
        values = dqds(a[lo:hi] ** 2, b[lo : hi - 1] ** 2)[:most]
        for value, z in zip(values, directions(a[lo:hi], b[lo : hi - 1], values), strict=True):
            found.append((float(value), q[:, lo:hi] @ z))
    found = sorted(found, key=lambda f: -f[0])[:most]
    least = len(a) * (EPS * size) ** 2 * len(a)
    found = [(value / n, v) for value, v in found if value > least]
    return np.array([f[0] for f in found]), np.array([f[1] for f in found]).reshape(len(found), len(a)), float((r * r).sum()) / n


# ---- the operator


def whitened(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every readable row and component.

    A vector that is null, empty, or holds a null, non-finite or unrepresentable entry (2^52 or
    more in size) is dropped, and so are vectors of another length than most have (of equally
    frequent lengths the longer counts). Components without variance beyond rounding have no rows,
    so a table of equal vectors, of one vector or of none gives no row. Repeated rows count each
    time and come out each time; vec_id may be null and of any type, and other columns are not
    looked at. A deviation that no 64-bit number holds is null.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole(vectors, id_col, vector_col)
    n, total = sums(rows)
    if n == 0:
        return _nothing(rows, schema)
    values, directions_, trace = principal(triangle(rows, n, total), n, components)
    if not len(values):
        return _nothing(rows, schema)
    scaled, dims, mean_of = (directions_ / np.sqrt(values)[:, None]).T, len(total), np.array(total, object)
    error = identity_error(rows, n, total, scaled)
    explained = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, k, rows = departures(_matrix(b.column(1), dims), n, mean_of), len(values), b.num_rows
            w, most = (y.astype(np.float64) / n) @ scaled, int(np.abs(y).max(initial=0))
            squares = (y * y).sum(axis=1) if most * most * dims < 2**63 else [v if v < 2**63 else None for v in (y.astype(object) ** 2).sum(axis=1)]
            of = pa.array(np.arange(rows).repeat(k))
            columns = [
                b.column(0).take(of), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(len(of), n), pa.int64()),
                pa.array(squares, pa.int64()).take(of), pa.array(w.reshape(-1)), pa.array(np.tile(explained, rows)), pa.array(np.full(len(of), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == dims).select("vec_id", "x").mapInArrow(project, schema)


def identity_error(rows: DataFrame, n: int, total: list[int], scaled: np.ndarray) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity, over all rows."""
    dims, k, mean_of = len(total), scaled.shape[1], np.array(total, object)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((k + 1, k))
        for b in batches:
            w = centred(_matrix(b.column(0), dims), n, mean_of) @ scaled
            g[:k] += w.T @ w
            g[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(g.size, dtype=np.int32)), pa.array(g.reshape(-1))], ["at", "s"])

    parts = rows.where(F.size("x") == dims).select("x").mapInArrow(products, "at int, s double")
    g = np.zeros((k + 1) * k)
    for r in parts.groupBy("at").agg(F.sum("s").alias("s")).collect():  # (k + 1) * k rows
        g[r["at"]] = r["s"]
    g = g.reshape(k + 1, k) / n
    return float(np.abs(g[:k] - np.outer(g[k], g[k]) - np.eye(k)).max())


def _nothing(rows: DataFrame, schema: str) -> DataFrame:
    empty: dict[str, Column] = {name: F.lit(None).cast(kind).alias(name) for name, kind in (part.strip().split(" ", 1) for part in schema.split(", "))}
    return rows.limit(0).select(*empty.values())
