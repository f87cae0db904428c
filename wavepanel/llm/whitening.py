"""Embedding whitening on the leading components, found by Jacobi-Davidson.

The covariance matrix is never formed. Its product with a few vectors is one
Spark job over the distinct integer vectors, which lie in the shared folder as
packed blocks: every task centres its blocks, multiplies by the vectors and by
its transpose, and returns one small sum.

The driver holds a subspace of a few vectors of one entry a dimension. Rayleigh-
Ritz on it gives approximate pairs; pairs whose residuals have reached double
precision are locked, from the largest eigenvalue down. For each other wanted
pair (t, u) the correction equation (I - QQ')(V - t)(I - QQ') s = -r, Q the locked
vectors and u, is solved by MINRES, all pairs in step so that one job serves them
all; the corrections widen the subspace. In the end a few block Lanczos steps
beside the locked vectors look for an eigenvalue that was passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavepanel.llm.common import write_shared

#: Bytes of a block's doubles, and tasks from which partial sums are added up in two steps.
BLOCK_BYTES, MANY_PARTS = 1 << 22, 256
#: The subspace: extra vectors it starts with and its most; pairs corrected beside the wanted ones; most outer and inner
#: steps, and the residual that ends the inner ones early; block Lanczos steps of the last look and vectors of a block.
EXTRA, WIDEST, BESIDE, OUTER, INNER, SLACK, LOOK, ABREAST = 8, 64, 8, 60, 4, 1e-3, 6, 4
SEED = 7
EPS = float(np.finfo(float).eps)
Product = Callable[[np.ndarray], np.ndarray]


def integer_vectors(df: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): floor(scale * c) of each entry. Rows whose vector is null or holds
    null or non-finite entries are dropped."""
    whole = F.forall(vec_col, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    rows = df.filter(df[vec_col].isNotNull()).filter(whole)
    return rows.select(rows[id_col].alias("id"), F.transform(vec_col, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def _padded(dims: int):
    return F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def fit_blocks(rows: DataFrame, dims: int) -> DataFrame:
    """Every distinct vector once, in blocks (``width`` bytes an entry, ``x``), in the shared folder."""
    most = max(1, BLOCK_BYTES // (8 * dims))

    def block(mat: np.ndarray) -> pa.RecordBatch:
        top = int(max(mat.max(), -(mat.min() + 1)))
        width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
        return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([mat.astype(f"<i{width}").tobytes()], pa.binary())],
                                          names=["width", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            mat = _matrix(batch.column(0), dims)
            for a in range(0, len(mat), most):
                held.append(mat[a:a + most])
                n += len(held[-1])
                if n >= most:
                    joined = np.concatenate(held)
                    yield block(joined[:most])
                    held, n = [joined[most:]], n - most
        if n:
            yield block(np.concatenate(held))

    return write_shared(rows.select(_padded(dims).alias("x")).distinct().mapInArrow(run, "width int, x binary"), "fit-list")


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for width, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield np.frombuffer(raw.as_buffer(), f"<i{width}").reshape(-1, dims)


def _sum(blocks: DataFrame, dims: int, each: Callable[[np.ndarray], np.ndarray], shape: tuple) -> np.ndarray:
    """The sum of ``each(block)`` over all blocks: a partial sum a task, added up in a fixed order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for mat in _blocks(batches, dims):
            total += each(mat)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                          pa.array([total.tobytes()], pa.binary())], names=["part", "sum"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((p, s) for b in batches for p, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int64()), pa.array([_added(rows, shape).tobytes()], pa.binary())],
                                             names=["part", "sum"])

    sums = blocks.mapInArrow(run, "part long, sum binary")
    parts = blocks.rdd.getNumPartitions()
    if parts > MANY_PARTS:
        sums = sums.repartition(int(parts ** 0.5), "part").mapInArrow(again, "part long, sum binary")
    return _added(sorted((r.part, bytes(r.sum)) for r in sums.collect()), shape)


def _added(rows: list[tuple[int, bytes]], shape: tuple) -> np.ndarray:
    return np.sum([np.frombuffer(s).reshape(shape) for _, s in rows], axis=0) if rows else np.zeros(shape)


def _totals(blocks: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of every dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for mat in _blocks(batches, dims):
            n += len(mat)
            small = len(mat) * max(abs(int(mat.min())), abs(int(mat.max()))) < 1 << 62
            total = [a + int(b) for a, b in zip(total, mat.sum(axis=0, dtype=np.int64 if small else object))]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(t) for t in total]], pa.list_(pa.string()))],
                                         names=["n", "s"])

    rows = blocks.mapInArrow(run, "n long, s array<string>").collect()       # one small row a task
    return sum(r.n for r in rows), [sum(int(r.s[i]) for r in rows) for i in range(dims)]


# ---- Jacobi-Davidson --------------------------------------------------------

def orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """The directions of ``new`` beside the bases, each other, and rounding."""
    out: list[np.ndarray] = []
    for v in new.T:
        size = np.linalg.norm(v)
        if not size > 0 or not np.isfinite(size):
            continue
        v = v / size
        kept = 1.0
        for _ in range(3):
            for basis in (*bases, *([np.array(out).T] if out else [])):
                v = v - basis @ (basis.T @ v)
            now = np.linalg.norm(v)
            kept *= now
            if kept < 1e-10:
                break
            v = v / now
        else:
            out.append(v)
    return np.array(out).T if out else np.zeros((len(new), 0))


def minres(b: np.ndarray, shift: float, q: np.ndarray, tol: float, steps: int) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """MINRES for (I - qq')(V - shift)(I - qq') s = b. Yields vectors, is sent their
    products with V, and returns s."""
    beside = lambda v: v - q @ (q.T @ v)
    b = beside(b)
    beta = norm = float(np.linalg.norm(b))
    x, w, w_old = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    if not beta > 0:
        return x
    v, v_old = b / beta, np.zeros_like(b)
    phi, cs, sn, delta_next, eps_next, beta_old = beta, -1.0, 0.0, 0.0, 0.0, 0.0
    for _ in range(steps):
        p = beside((yield v) - shift * v)
        alpha = float(v @ p)
        p = beside(p - alpha * v - beta_old * v_old)
        beta = float(np.linalg.norm(p))
        delta, gamma = cs * delta_next + sn * alpha, sn * delta_next - cs * alpha
        epsilon, eps_next, delta_next = eps_next, sn * beta, -cs * beta
        root = float(np.hypot(gamma, beta))
        if not root > EPS * norm * EPS:
            break
        cs, sn = gamma / root, beta / root
        w_old, w = w, (v - delta * w - epsilon * w_old) / root
        x = x + cs * phi * w
        phi *= sn
        if abs(phi) <= tol * norm or beta <= 1e-14 * abs(alpha):
            break
        v_old, v, beta_old = v, p / beta, beta
    return x


def _in_step(solvers: list[Generator], product: Product) -> list[np.ndarray]:
    """Run the solvers together: their vectors go into one product a step."""
    done: dict[int, np.ndarray] = {}
    asked: dict[int, np.ndarray] = {}

    def advance(i: int, value: np.ndarray | None) -> None:
        try:
            asked[i] = solvers[i].send(value)
        except StopIteration as end:
            done[i] = end.value

    for i in range(len(solvers)):
        advance(i, None)
    while asked:
        now = sorted(asked)
        got = product(np.array([asked[i] for i in now]).T)
        asked.clear()
        for j, i in enumerate(now):
            advance(i, got[:, j])
    return [done[i] for i in range(len(solvers))]


def jacobi_davidson(product: Product, dims: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues (falling) and unit eigenvectors of a
    symmetric positive semidefinite matrix that is known by its products."""
    count = min(count, dims)
    draw = np.random.default_rng(SEED)
    basis = orthonormal(draw.standard_normal((dims, min(dims, count + EXTRA))))
    image = product(basis)
    values, locked = np.zeros(0), np.zeros((dims, 0))
    floor: dict[int, tuple[float, int]] = {}           # least residual of the next pair, and steps since it fell
    for outer in range(OUTER):
        small = basis.T @ image
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        top = max(float(theta[0]) if len(theta) else 0.0, float(values.max(initial=0.0)), 0.0)
        precise = 4 * EPS * top * dims ** 0.5
        want = min(count - len(values), len(theta))
        u, au = basis @ s, image @ s
        residual = au[:, :want] - u[:, :want] * theta[:want]
        residual -= locked @ (locked.T @ residual)
        sizes = np.linalg.norm(residual, axis=0)
        whole = basis.shape[1] + len(values) >= dims
        ready = 0
        while ready < want:
            least, since = floor.get(len(values) + ready, (np.inf, 0))
            floor[len(values) + ready] = (sizes[ready], 0) if sizes[ready] < least / 2 else (least, since + 1)
            # at double precision, or as near as the products' own rounding lets it come
            level = sizes[ready] <= 1e3 * precise and floor[len(values) + ready][1] >= 2
            if not (sizes[ready] <= precise or level or whole or top == 0.0):
                break
            ready += 1
        if ready:
            values, locked = np.append(values, theta[:ready]), np.column_stack((locked, u[:, :ready]))
            u, au, theta = u[:, ready:], au[:, ready:], theta[ready:]
        if len(values) == count:
            passed = None if whole else _passed_over(product, locked, values, draw)
            if passed is None:
                break
            # an eigenvalue above a locked one: its vector joins, and what is smaller is open again
            keep = values > passed[0]
            basis = orthonormal(np.column_stack((passed[1], locked[:, ~keep], u[:, :EXTRA])), locked[:, keep])
            values, locked = values[keep], locked[:, keep]
            image, floor = product(basis), {}
            continue
        # the next pairs are corrected too: they cost no further jobs, and hold off the wanted ones' neighbours
        want = min(count - len(values) + BESIDE, len(theta))
        residual = au[:, :want] - u[:, :want] * theta[:want]
        residual -= locked @ (locked.T @ residual)
        solvers = [minres(-residual[:, i], float(theta[i]), np.column_stack((locked, u[:, i])), SLACK, min(INNER, dims))
                   for i in range(want)]
        moves = _in_step(solvers, product)
        if u.shape[1] + want > WIDEST:                  # start again from the best
            u, au = u[:, :count + 2 * EXTRA], au[:, :count + 2 * EXTRA]
        new = orthonormal(np.column_stack((*moves, residual[:, :want])) if moves else residual[:, :0], locked, u)[:, :max(1, want)]
        if not new.shape[1]:
            new = orthonormal(draw.standard_normal((dims, 1)), locked, u)
        if new.shape[1]:
            basis, image = np.column_stack((u, new)), np.column_stack((au, product(new)))
        else:
            basis, image = u, au
    else:
        raise ArithmeticError(f"{len(values)} of {count} components reached double precision in {OUTER} steps")
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order]


def _passed_over(product: Product, locked: np.ndarray, values: np.ndarray, draw: np.random.Generator) -> tuple[float, np.ndarray] | None:
    """A value and vector beside the locked ones that is above the least of them, if Lanczos steps find one."""
    v = orthonormal(draw.standard_normal((len(locked), ABREAST)), locked)[:, :len(locked) - locked.shape[1]]
    basis, image = np.zeros((len(locked), 0)), np.zeros((len(locked), 0))
    for _ in range(LOOK):
        if not v.shape[1]:
            break
        new = product(v)
        basis, image = np.column_stack((basis, v)), np.column_stack((image, new))
        v = orthonormal(new, locked, basis)
    if not basis.shape[1]:
        return None
    small = basis.T @ image
    theta, s = np.linalg.eigh((small + small.T) / 2)
    above = theta[-1] > values.min() + 1e-12 * max(values.max(), 0.0)
    return (float(theta[-1]), basis @ s[:, -1:]) if above else None


# ---- whitening ----------------------------------------------------------------

@dataclass
class Whitening:
    """What was fitted: number and sums of the fit list, eigenvalues (falling), unit
    vectors (a column each), the trace, and how far the whitened fit list's covariance is from the identity."""

    dims: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def fit(rows: DataFrame, count: int) -> Whitening:
    """Fit on the distinct vectors of ``rows`` (id, x). Components whose variance is
    rounding beside the largest are left out, as they cannot be scaled to one."""
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not dims:
        return Whitening(0, 0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    blocks = fit_blocks(rows, dims).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, sums = _totals(blocks, dims)
        mean = np.array([s / n for s in sums])
        trace = float(_sum(blocks, dims, lambda x: ((x - mean) ** 2).sum(), ())) / n

        def product(vectors: np.ndarray) -> np.ndarray:
            def each(x: np.ndarray) -> np.ndarray:
                centred = x - mean
                return centred.T @ (centred @ vectors)
            return _sum(blocks, dims, each, vectors.shape) / n

        values, vectors = jacobi_davidson(product, dims, count)
        kept = values > 1e3 * EPS * dims * max(trace, 0.0)
        values, vectors = values[kept], vectors[:, kept]
        scaled = vectors / np.sqrt(values)
        k = len(values)
        middle = _sum(blocks, dims, lambda x: ((x - mean) @ scaled).sum(axis=0), (k,)) / n

        def cross(x: np.ndarray) -> np.ndarray:
            z = (x - mean) @ scaled - middle
            return z.T @ z
        error = float(np.abs(_sum(blocks, dims, cross, (k, k)) / n - np.eye(k)).max(initial=0.0))
    finally:
        blocks.unpersist()
    return Whitening(dims, n, sums, values, vectors, trace, error)


def exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - S)^2; null where that is no long."""
    reach = n * int(np.abs(x.astype(object)).max(initial=0)) + max(map(abs, sums), default=0) if x.size else 0
    if x.shape[1] * reach * reach < 1 << 62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    whole = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1).tolist()
    return [w if w < 1 << 63 else None for w in whole]


def whiten(df: DataFrame, scale: int = 256, count: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` for each
    row with a whole vector and each of the ``count`` leading components.

    Each entry c becomes floor(scale * c). The fit list holds each distinct vector
    once, so repeated rows weigh nothing and all get the same values. Shorter
    vectors count as ending in zeros. Fewer components come out if the fit list
    spans fewer (none if all vectors are equal, so no rows); of equal eigenvalues any
    orthonormal vectors serve. A null id is kept. An empty table gives no rows.
    """
    rows = integer_vectors(df, scale, id_col, vec_col)
    model = fit(rows, count)
    dims, k, sums = model.dims, len(model.values), model.sums
    schema = f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, " \
             "explained double, identity_error double"
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if not k:
        return df.sparkSession.createDataFrame([], schema)
    mean, scaled = np.array([s / model.n for s in sums]), model.vectors / np.sqrt(model.values)
    n, error, share = model.n, model.identity_error, model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_BYTES // (8 * dims))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                m = batch.num_rows
                x = _matrix(batch.column(1), dims)
                z = (x - mean) @ scaled
                each = np.repeat(np.arange(m), k)
                away = pa.array(exact_deviation(x, n, sums), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, n)), away.take(pa.array(each)), pa.array(z.ravel()),
                     pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))], names=names)

    return rows.select("id", _padded(dims).alias("x")).mapInArrow(run, schema)
