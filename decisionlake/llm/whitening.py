"""Embedding whitening by QDWH spectral divide and conquer.

1. *Exact moments.* Every entry c becomes the integer x = floor(1024 c) + 100000. One pass counts the vectors and sums x per
   dimension in integers; a second sums the products of x less its mean, so that nothing large is subtracted afterwards.
   Tasks return one partial a batch group, Spark adds them; the driver sees dimension squared numbers, whatever the table.
2. *Components.* The polar factor U of V - s I, with a shift s inside the spectrum, is its matrix sign; (U + I) / 2 projects on the
   eigenvectors above s, (I - U) / 2 on those below. U comes from the QR-based dynamically weighted Halley iteration,
   which needs at most seven steps whatever the condition. An orthonormal basis of both subspaces splits V into two blocks,
   and each block is split again until it is one component. One refinement step against V ends it.
3. *Whitening.* Mean, components and the roots of eigenvalues (dimension x k numbers) go to the tasks; every row is whitened there.
   Two more passes measure the covariance of the whitened rows, centred again, against the identity.

All rows are fitted, none is sampled, and no step shuffles a vector.

Defined results: rows without a vector, or with a null or non-finite entry, go, as do entries beyond ``LARGEST``, whose squares no
number type here holds; of rows with vectors of differing lengths those of the most frequent length stay (of
equally frequent ones the shortest). Components whose eigenvalue is zero up to rounding have no whitened value and are left out. ``vec_id``
may be null or repeat; each row is judged by itself. A constant table, one row, and an empty table give no rows. Equal eigenvalues span a
space in which any basis is right. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlake.llm.common import slices

SCALE, OFFSET = 1024, 100_000
LARGEST = float(1 << 30)                  # of an entry
TOP = 8
ROWS = 4096                               # vectors a task holds at once
PARTIAL = 1 << 16                         # vectors of one partial sum, about


# spectral divide and conquer ------------------------------------------------------------------
def polar(a):
    """The orthogonal polar factor of a symmetric matrix by the QR-based dynamically weighted Halley iteration."""
    import numpy as np
    n = len(a)
    x = a / np.linalg.norm(a)                               # the Frobenius norm bounds the spectral one
    low = 1e-16                                             # below every singular value that matters
    eye = np.eye(n)
    for _ in range(30):
        if low < 1 - 1e-15:
            d = np.cbrt(4 * (1 - low * low) / low ** 4)
            h = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * np.sqrt(1 + d)))
            w, b = h, (h - 1) ** 2 / 4
        else:
            w, b = 3.0, 1.0
        c = w + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        new = (b / c) * x + (w - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (w + b * low * low) / (1 + c * low * low))
        moved = np.linalg.norm(new - x)
        x = new
        if low > 1 - 1e-15 and moved < 1e-13 * np.sqrt(n):
            break
    return x


def _split(a):
    """Orthonormal bases (above, below) of two invariant subspaces of a symmetric matrix; None if it is a multiple of the identity."""
    import numpy as np
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= 1e-15 * n * max(abs(mean), np.finfo(float).tiny):
        return None
    diagonal = np.sort(np.diag(a))
    # the median halves the work; the others stand in where an eigenvalue lies at it
    shifts = [float(np.median(diagonal)), float(mean), *(float(mean + t * spread / n) for t in (0.37, -0.37, 0.11, -0.11, 0.73, -0.73, 0.0213))]
    random = np.random.default_rng(n)
    for s in shifts:
        moved = a - s * np.eye(n)
        if not moved.any():
            continue
        above = (polar(moved) + np.eye(n)) / 2
        k = int(round(np.trace(above)))
        if k in (0, n) or np.linalg.norm(above @ above - above) > 1e-10:
            continue
        first, _ = np.linalg.qr(above @ random.standard_normal((n, k)))
        first, _ = np.linalg.qr(above @ first)
        whole, _ = np.linalg.qr(np.hstack([first, (np.eye(n) - above) @ random.standard_normal((n, n - k))]))
        return whole[:, :k], whole[:, k:]
    return None


def eigh(v):
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, by falling eigenvalue."""
    import numpy as np
    n = len(v)
    done, work = [], [np.eye(n)]
    while work:
        basis = work.pop()
        if basis.shape[1] == 1:
            done.append(basis)
            continue
        block = basis.T @ v @ basis
        parts = _split((block + block.T) / 2)
        if parts is None:                                   # equal eigenvalues: any basis
            done.append(basis)
        else:
            work.extend(basis @ p for p in parts)
    vectors, _ = np.linalg.qr(np.hstack(done)) if n else (np.zeros((0, 0)), None)
    return _refined(v, vectors)


def _refined(v, x):
    """One step of Ogita and Aishima's refinement: both the norms and the off-diagonal rest are pushed to rounding."""
    import numpy as np
    r, s = np.eye(x.shape[1]) - x.T @ x, x.T @ v @ x
    values = np.diag(s) / (1 - np.diag(r))
    gap = values[None, :] - values[:, None]
    rest = np.abs(s - np.diag(np.diag(s))).max(initial=0.0) + np.abs(values).max(initial=0.0) * np.abs(r).max(initial=0.0)
    apart = np.abs(gap) > max(1e3 * rest, 1e-12 * np.abs(values).max(initial=0.0))
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1.0), r / 2)
    x = x + x @ e
    x = x @ (1.5 * np.eye(x.shape[1]) - 0.5 * (x.T @ x))
    values = np.einsum("ij,ij->j", x, v @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order] / np.linalg.norm(x[:, order], axis=0)


# moments --------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Whitening:
    """A fitted model: row count, exact sums, the trace of the covariance, eigenvalues and components (columns)."""
    n: int
    sums: tuple
    trace: float
    values: object
    components: object

    def mean(self):
        import numpy as np
        return np.array([s / self.n for s in self.sums])    # integers divided once, correctly rounded

    def matrix(self, k: int):
        """Dimension x k: centred rows times this are whitened."""
        import numpy as np
        usable = int((self.values > len(self.values) * np.finfo(float).eps * max(self.trace, 0.0)).sum())
        k = min(k, usable)
        return self.components[:, :k] / np.sqrt(self.values[:k])


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that stay, entries as double."""
    e = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(e, lambda c: c.isNotNull() & (F.abs(c) <= LARGEST)), F.lit(False))     # not a number is above all numbers
    rows = embeddings.select("vec_id", e.alias("embedding")).where(fine)
    lengths = [(r["d"], r["n"]) for r in rows.groupBy(F.size("embedding").alias("d")).count().withColumnRenamed("count", "n")
               .orderBy(F.desc("n"), "d").limit(1).collect()]
    d = lengths[0][0] if lengths else 0
    return rows.where(F.size("embedding") == d)


def _integers(batch):
    """The batch's vectors as a matrix of integers x."""
    import numpy as np
    column = batch.column("embedding")
    flat = np.asarray(column.flatten(), np.float64)
    return (np.floor(flat * SCALE)).astype(np.int64).reshape(batch.num_rows, -1) + OFFSET


def _summed(rows: DataFrame, of, kind: str):
    """The sum over all rows of ``of(x)``, a matrix; partials are added by Spark, place by place."""
    def run(batches):
        import pyarrow as pa
        total, seen = None, 0
        for b in slices(batches, ROWS):
            if not b.num_rows:
                continue
            part = of(_integers(b))
            total = part if total is None else total + part
            seen += b.num_rows
            if seen >= PARTIAL:
                yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1).tolist()], pa.list_(kinds))], ["part"])
                total, seen = None, 0
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1).tolist()], pa.list_(kinds))], ["part"])

    import pyarrow as pa
    kinds = pa.int64() if kind == "bigint" else pa.float64()
    partials = rows.select("embedding").mapInArrow(run, f"part array<{kind}>")
    wide = "decimal(38,0)" if kind == "bigint" else "double"
    totals = partials.select(F.posexplode("part").alias("at", "p")).groupBy("at").agg(F.sum(F.col("p").cast(wide)).alias("p"))
    return [r["p"] for r in totals.orderBy("at").collect()]


def fit(rows: DataFrame) -> Whitening | None:
    """The model of ``rows`` (vec_id, embedding) as :func:`vectors` gives them; None if there are none, or only empty vectors."""
    import numpy as np
    sums = _summed(rows, lambda x: np.append(x.sum(axis=0), len(x)), "bigint")
    if len(sums) < 2:
        return None
    *sums, n = (int(s) for s in sums)
    mean = np.array([s / n for s in sums])

    def products(x):
        centred = x - mean
        return centred.T @ centred
    v = np.array(_summed(rows, products, "double")).reshape(len(sums), -1) / n
    values, components = eigh((v + v.T) / 2)
    return Whitening(n, tuple(sums), float(np.trace(v)), values, components)


def _deviations(x, n: int, sums):
    """Sum over the dimensions of (n x - S)^2, exact, as a list of integers."""
    import numpy as np
    largest = max(int(n) * int(np.abs(x).max(initial=0)), max(abs(s) for s in sums))
    if largest < 1 << 62:
        part = n * x - np.array(sums, np.int64)
        if x.shape[1] * int(np.abs(part).max(initial=0)) ** 2 < 1 << 63:
            return (part * part).sum(axis=1).tolist()
    part = n * x.astype(object) - np.array(sums, object)
    return (part * part).sum(axis=1).tolist()


def identity_error(rows: DataFrame, model: Whitening, k: int = TOP) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    import numpy as np
    mean, matrix = model.mean(), model.matrix(k)
    if not matrix.shape[1]:
        return 0.0
    middle = np.array(_summed(rows, lambda x: ((x - mean) @ matrix).sum(axis=0), "double")) / model.n

    def products(x):
        white = (x - mean) @ matrix - middle
        return white.T @ white
    covariance = np.array(_summed(rows, products, "double")).reshape(len(middle), -1) / model.n
    return float(np.abs(covariance - np.eye(len(middle))).max())


def whiten(rows: DataFrame, model: Whitening, k: int = TOP) -> DataFrame:
    """(vec_id, deviation, whitened list) of every row; ``deviation`` is exact."""
    mean, matrix = model.mean(), model.matrix(k)
    n, sums = model.n, model.sums

    def run(batches):
        import pyarrow as pa
        for b in slices(batches, ROWS):
            x = _integers(b)
            white = (x - mean) @ matrix
            flat = pa.ListArray.from_arrays(pa.array(range(0, white.size + 1, matrix.shape[1]), pa.int32()), pa.array(white.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([str(d) for d in _deviations(x, n, sums)]), flat],
                                             ["vec_id", "deviation", "whitened"])

    vec_id = rows.schema["vec_id"].dataType.simpleString()
    out = rows.select("vec_id", "embedding").mapInArrow(run, f"vec_id {vec_id}, deviation string, whitened array<double>")
    return out.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))


def components_of(embeddings: DataFrame, k: int = TOP) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every remaining row and component up to ``k``.

    A ``deviation`` beyond a long is null here; :func:`whiten` has it whole.
    """
    rows = vectors(embeddings)
    model = fit(rows)
    size = model.matrix(k).shape[1] if model else 0
    if not size:
        return embeddings.sparkSession.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    error = identity_error(rows, model, k)
    explained = F.array(*[F.lit(float(e) / model.trace) for e in model.values[:size]])
    out = whiten(rows, model, k).select(F.col("vec_id").cast("long").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
                      F.col("deviation").try_cast("long").alias("deviation"), "whitened", F.get(explained, F.col("at")).alias("explained"),
                      F.lit(error).alias("identity_error"))
