"""Sequential and iterative algorithms that run inside one task per group, in Arrow batches: alignment, hidden states, small dense algebra, byte pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dtw(cost: np.ndarray) -> float:
    """Dynamic time warping: each cell adds its cost to the least of top, left and diagonal. Cells of one antidiagonal do not depend on each other and are done at once."""
    n, m = cost.shape
    if not n or not m:
        return 0.0 if n == m else np.inf
    best = np.full((n + 1, m + 1), np.inf)
    best[0, 0] = 0.0
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        j = d - i
        best[i + 1, j + 1] = cost[i, j] + np.minimum(np.minimum(best[i, j + 1], best[i + 1, j]), best[i, j])
    return float(best[n, m])


def dtw_pairs(pairs: DataFrame, a: str, b: str, out: str = "dtw") -> DataFrame:
    """Adds the warping distance (absolute differences) between two array columns."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if u is None or v is None else dtw(np.abs(np.subtract.outer(np.array(u), np.array(v)))) for u, v in zip(x.to_pylist(), y.to_pylist())], pa.float64())

    return pairs.withColumn(out, run(a, b))


def viterbi(trans: np.ndarray, emit: np.ndarray) -> list[int]:
    """Best state path in log space with a uniform prior; emit[t, state]. Ties take the smaller state."""
    with np.errstate(divide="ignore"):
        a, e = np.log(trans), np.log(emit)
    score, back = e[0] - np.log(len(a)), []
    for t in range(1, len(e)):
        step = score[:, None] + a
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + e[t]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def forward_backward(trans: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Posterior of the states at each step, uniform prior, in log space."""
    with np.errstate(divide="ignore"):
        a, e = np.log(trans), np.log(emit)
    lse = lambda x, axis: x.max(axis=axis) + np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis))
    f = [e[0] - np.log(len(a))]
    for t in range(1, len(e)):
        f.append(lse(f[-1][:, None] + a, 0) + e[t])
    b = [np.zeros(len(a))]
    for t in range(len(e) - 1, 0, -1):
        b.append(lse(a + (e[t] + b[-1])[None, :], 1))
    g = np.array(f) + np.array(b[::-1])
    g = np.exp(g - g.max(axis=1, keepdims=True))
    return g / g.sum(axis=1, keepdims=True)


def decode_groups(df: DataFrame, by: str, order: str, emissions: str, trans: np.ndarray) -> DataFrame:
    """by, order, state: the Viterbi path of each group's emission rows (arrays)."""
    kind = dict(df.dtypes)

    def run(key, table):
        t = table.sort_by(order)
        path = viterbi(trans, np.array(t.column(emissions).to_pylist()))
        return pa.table({by: t.column(by), order: t.column(order), "state": pa.array(path, pa.int64())})

    return df.select(by, order, emissions).groupBy(by).applyInArrow(run, f"{by} {kind[by]}, {order} {kind[order]}, state long")


def posterior_groups(df: DataFrame, by: str, order: str, emissions: str, trans: np.ndarray) -> DataFrame:
    """by, order, posterior (array): the probability of each state at each of a group's emission rows."""
    kind = dict(df.dtypes)

    def run(key, table):
        t = table.sort_by(order)
        g = forward_backward(trans, np.array(t.column(emissions).to_pylist()))
        return pa.table({by: t.column(by), order: t.column(order), "posterior": pa.array(g.tolist(), pa.list_(pa.float64()))})

    return df.select(by, order, emissions).groupBy(by).applyInArrow(run, f"{by} {kind[by]}, {order} {kind[order]}, posterior array<double>")


KERNELS = {
    "linear": lambda a, b, g: a @ b.T,
    "rbf": lambda a, b, g: np.exp(-g * ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)),
    "poly": lambda a, b, g: (g * (a @ b.T) + 1.0) ** 2,
}


def train_svm(df: DataFrame, by: str, x: str, y: str, order: str, c: float = 1.0, kernel: str = "linear", gamma: float = 1.0) -> DataFrame:
    """One support vector machine per group, trained in one task (its kernel matrix is quadratic in the group): by, order, alpha, bias of each row. y is -1 or 1."""
    kind = dict(df.dtypes)

    def run(key, table):
        t = table.sort_by(order)
        points, side = np.array(t.column(x).to_pylist(), dtype=float), t.column(y).to_numpy().astype(float)
        alpha, bias = smo(KERNELS[kernel](points, points, gamma), side, c)
        return pa.table({by: t.column(by), order: t.column(order), "alpha": alpha, "bias": np.full(len(side), bias)})

    return df.select(by, order, x, y).groupBy(by).applyInArrow(run, f"{by} {kind[by]}, {order} {kind[order]}, alpha double, bias double")


def smo(k: np.ndarray, y: np.ndarray, c: float, tol: float = 1e-3, rounds: int = 10_000) -> tuple[np.ndarray, float]:
    """(alpha, bias) of the dual by the most violating pair; y is -1 or 1."""
    a, g = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(rounds):
        v = -y * g
        up = ((a < c) & (y > 0)) | ((a > 0) & (y < 0))
        low = ((a < c) & (y < 0)) | ((a > 0) & (y > 0))
        i, j = int(np.where(up, v, -np.inf).argmax()), int(np.where(low, v, np.inf).argmin())
        if v[i] - v[j] < tol:
            break
        step = (v[i] - v[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, c - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        g += step * y * (k[:, i] - k[:, j])
    return a, float((v[i] + v[j]) / 2)


def _signed(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The factors with a non-negative diagonal of r, which makes them unique for full rank."""
    s = np.where(np.diag(r) < 0, -1.0, 1.0)
    return q * s, r * s[:, None]


def _vectors(v: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest magnitude (the first of equals) is positive."""
    at = np.abs(v).round(9).argmax(axis=0)
    return v * np.where(v[at, np.arange(v.shape[1])] < 0, -1.0, 1.0)


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, l, u) with a[p] = l u, by rows with the largest pivot."""
    u, n = np.array(a, dtype=float), len(a)
    l, p = np.eye(n), np.arange(n)
    for k in range(n):
        at = k + int(np.abs(u[k:, k]).argmax())
        if u[at, k] == 0:
            continue
        u[[k, at]], p[[k, at]] = u[[at, k]], p[[at, k]]
        l[[k, at], :k] = l[[at, k], :k]
        l[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :] -= np.outer(l[k + 1 :, k], u[k])
    return p, l, np.triu(u)


def _svd(a: np.ndarray):
    u, s, v = np.linalg.svd(a, full_matrices=False)
    turned = _vectors(v.T)
    return u * np.where((turned * v.T).sum(axis=0) < 0, -1.0, 1.0), s, turned


LINALG = {
    "cholesky": np.linalg.cholesky,
    "inverse": np.linalg.inv,
    "qr_q": lambda a: _signed(*np.linalg.qr(a))[0],
    "qr_r": lambda a: _signed(*np.linalg.qr(a))[1],
    "svd_u": lambda a: _svd(a)[0],
    "singular_values": lambda a: np.linalg.svd(a, compute_uv=False)[None, :],
    "svd_v": lambda a: _svd(a)[2],
    "eigenvalues": lambda a: np.linalg.eigvalsh(a)[None, :],
    "eigenvectors": lambda a: _vectors(np.linalg.eigh(a)[1]),
    "lu_p": lambda a: lu(a)[0][None, :].astype(float),
    "lu_l": lambda a: lu(a)[1],
    "lu_u": lambda a: lu(a)[2],
    "logdet": lambda a: np.array([[np.linalg.slogdet(a)[1]]]),
}


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(a, b)


def tri_solve(l: np.ndarray, b: np.ndarray, transposed: bool = False) -> np.ndarray:
    """Solves l x = b, or its transpose, for a lower triangular l, by substitution."""
    n, x = len(l), np.array(b, dtype=float)
    for k in range(n - 1, -1, -1) if transposed else range(n):
        x[k] = (x[k] - (l[k + 1 :, k] @ x[k + 1 :] if transposed else l[k, :k] @ x[:k])) / l[k, k]
    return x


def cholesky_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    l = np.linalg.cholesky(a)
    return tri_solve(l, tri_solve(l, b), True)


SOLVERS = {"solve": solve, "cholesky": cholesky_solve, "lower": tri_solve, "upper": lambda l, b: tri_solve(l, b, True)}


def solve_groups(a: DataFrame, b: DataFrame, by: str, how: str = "solve") -> DataFrame:
    """by, i, j, v: the solution of each group's small system; a and b are matrices in coordinates (by, i, j, v)."""
    kind = dict(a.dtypes)[by]

    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({by: pa.array([], left.column(by).type), "i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "v": pa.array([], pa.float64())})
        x = np.atleast_2d(SOLVERS[how](_dense(left), _dense(right)))
        p, q = np.indices(x.shape)
        return pa.table({by: pa.array([key[0].as_py()] * x.size, left.column(by).type), "i": p.ravel(), "j": q.ravel(), "v": x.ravel().astype(float)})

    cells = lambda m: m.select(by, F.col("i").cast("long"), F.col("j").cast("long"), F.col("v").cast("double"))
    return cells(a).groupBy(by).cogroup(cells(b).groupBy(by)).applyInArrow(run, f"{by} {kind}, i long, j long, v double")


def _dense(t) -> np.ndarray:
    i, j, v = (t.column(c).to_numpy() for c in ("i", "j", "v"))
    m = np.zeros((int(i.max()) + 1, int(j.max()) + 1))
    m[i, j] = v
    return m


def per_group(df: DataFrame, by: str, fn) -> DataFrame:
    """Applies a dense function (a name of LINALG or a callable) to each group's small matrix in coordinates (i, j, v)."""
    op = LINALG[fn] if isinstance(fn, str) else fn
    kind = dict(df.dtypes)[by]

    def run(key, t):
        r = np.atleast_2d(op(_dense(t)))
        p, q = np.indices(r.shape)
        return pa.table({by: pa.array([key[0].as_py()] * r.size, t.column(by).type), "i": p.ravel(), "j": q.ravel(), "v": r.ravel().astype(float)})

    return df.select(by, F.col("i").cast("long"), F.col("j").cast("long"), F.col("v").cast("double")).groupBy(by).applyInArrow(run, f"{by} {kind}, i long, j long, v double")


def fft_rows(df: DataFrame, v: str, out: str = "spectrum") -> DataFrame:
    """Adds the real transform's bins as structs (re, im)."""
    from pyspark.sql.functions import arrow_udf

    kind = pa.list_(pa.struct([("re", pa.float64()), ("im", pa.float64())]))

    @arrow_udf("array<struct<re:double,im:double>>")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if u is None else [{"re": z.real, "im": z.imag} for z in np.fft.rfft(np.array(u, dtype=float)).tolist()] for u in x.to_pylist()], kind)

    return df.withColumn(out, run(F.col(v)))


def fft_complex(df: DataFrame, re: str, im: str, out: str = "spectrum", inverse: bool = False) -> DataFrame:
    """Adds the complex transform of two arrays as structs (re, im); the inverse is not divided by the length."""
    from pyspark.sql.functions import arrow_udf

    kind = pa.list_(pa.struct([("re", pa.float64()), ("im", pa.float64())]))

    def one(u, w):
        z = np.array(u, dtype=float) + 1j * np.array(w, dtype=float)
        z = np.fft.ifft(z) * len(z) if inverse else np.fft.fft(z)
        return [{"re": x.real, "im": x.imag} for x in z.tolist()]

    @arrow_udf("array<struct<re:double,im:double>>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if u is None or w is None else one(u, w) if u else [] for u, w in zip(x.to_pylist(), y.to_pylist())], kind)

    return df.withColumn(out, run(F.col(re), F.col(im)))


def encode_byte_pairs(df: DataFrame, text: str, merges: list[tuple[int, int]], out: str = "ids") -> DataFrame:
    """Adds the byte-pair ids of a text column; merges in order of rank."""
    from pyspark.sql.functions import arrow_udf

    ranks = {tuple(p): k for k, p in enumerate(merges)}

    @arrow_udf("array<int>")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if t is None else byte_pairs(t, ranks) for t in x.to_pylist()], pa.list_(pa.int32()))

    return df.withColumn(out, run(F.col(text)))


def byte_pairs(text: str, ranks: dict[tuple[int, int], int]) -> list[int]:
    """Byte-pair ids: the adjacent pair of lowest rank, leftmost first, becomes id 256 + rank."""
    ids = list(text.encode())
    while len(ids) > 1:
        best = min((ranks[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks) if any(p in ranks for p in zip(ids, ids[1:])) else None
        if best is None:
            break
        ids[best[1] : best[1] + 2] = [256 + best[0]]
    return ids
