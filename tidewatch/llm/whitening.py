"""Whitening vectors by an exact, bit-sliced scatter matrix.

Components become whole numbers. A batch's numbers are shifted to start at zero in each
dimension and cut into bit planes, which are packed across rows into words. The cross-product
of two dimensions is the sum over pairs of their planes of the ones in both, weighted by the
planes' powers of two: an AND and a count of bits per word, without any rounding. Tasks send
their sums in three limbs, which the engine adds up. The matrix is centred as whole numbers,
divided once, and its eigenvectors turn and scale the rows.

Vectors that are null or hold null or non-finite components are left out. Vectors of different
length cannot have one covariance: each length is a fit of its own, with its own n. An empty
vector has no components, hence no rows. Components beyond 2**52 are cut to that before scaling.
A component without spread has no whitened value and explains nothing; identity_error is taken
over the others. A deviation that does not fit in a long is null. Repeated rows and ids and null
ids are rows like any other, each counted in the fit. Only the two named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import checkpointed, with_tasks

with_tasks(__name__)

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
LARGEST = float(1 << 52)
# Entries of a batch that are sliced at once, and of sums that a task holds before it sends them.
SLICED, HELD = 1 << 20, 1 << 22
LIMB = 40
# Models of this many bytes in all are handed to tasks in one pass over the vectors.
MODEL_BYTES = 64 << 20
MAX_LONG = (1 << 63) - 1


def whole(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * np.clip(values, -LARGEST, LARGEST)).astype(np.int64) + SHIFT


def by_length(column: pa.Array):
    """(places, whole numbers as a matrix) for each length of the vectors of a column."""
    ends = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(ends)
    values = column.values.to_numpy(zero_copy_only=False)
    for d in np.unique(sizes[sizes > 0]).tolist():
        places = np.flatnonzero(sizes == d)
        spots = ends[places][:, None] + np.arange(d)
        yield places, whole(values[spots])


def bit_planes(y: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative numbers, dimension by plane by word; a word holds 64 rows."""
    rows, d = y.shape
    bits = max(1, int(y.max()).bit_length())
    padded = np.zeros((-(-rows // 64) * 8, d, bits), np.uint8)
    for b in range(bits):
        packed = np.packbits(((y >> b) & 1).astype(np.uint8), axis=0)
        padded[:len(packed), :, b] = packed
    return np.ascontiguousarray(padded.transpose(1, 2, 0)).view(np.uint64)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products (upper half) of the columns, as Python integers."""
    rows, d = x.shape
    low = x.min(axis=0)
    planes = bit_planes(x - low)
    bits = planes.shape[1]
    powers = np.array([1 << b for b in range(bits)], object)
    # Small planes are weighted in machine words, wide ones as Python integers.
    small = rows.bit_length() + 2 * bits < 62
    weights = powers.astype(np.int64) if small else powers
    ones = np.bitwise_count(planes).sum(axis=-1, dtype=np.int64)
    sums = (ones @ weights).astype(object)
    products = np.zeros((d, d), np.int64 if small else object)
    for j in range(d):
        for b in range(bits):
            both = np.bitwise_count(planes[j, b] & planes[j:]).sum(axis=-1, dtype=np.int64)
            products[j, j:] += (both @ weights) * weights[b]
    # Back from the shifted numbers to the numbers themselves.
    base = low.astype(object)
    products = products.astype(object) + np.outer(base, sums) + np.outer(sums, base) + rows * np.outer(base, base)
    return sums + rows * base, products


def limbs(values: np.ndarray) -> list[pa.Array]:
    mask = (1 << LIMB) - 1
    parts = values & mask, (values >> LIMB) & mask, values >> 2 * LIMB
    return [pa.array(p.astype(np.int64)) for p in parts]


SUMS = "d int, j int, k int, a0 bigint, a1 bigint, a2 bigint"


def scatter_sums(vectors: DataFrame) -> DataFrame:
    """Sums over all vectors: (d, j, k) is a cross-product, (d, -1, k) a sum, (d, -2, 0) the count."""
    def run(batches):
        held: dict[int, list] = {}

        def send():
            for d, (n, sums, products) in held.items():
                j, k = np.triu_indices(d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(j) + d + 1, d, np.int32)),
                     pa.array(np.concatenate([j, np.full(d, -1), [-2]]).astype(np.int32)),
                     pa.array(np.concatenate([k, np.arange(d), [0]]).astype(np.int32)),
                     *limbs(np.concatenate([products[j, k], sums, np.array([n], object)]))],
                    names=["d", "j", "k", "a0", "a1", "a2"])
            held.clear()

        for batch in batches:
            for _, x in by_length(batch.column(0)):
                d = x.shape[1]
                step = max(64, SLICED // d // 64 * 64)
                for at in range(0, len(x), step):
                    part = x[at:at + step]
                    sums, products = scatter(part)
                    n, s, p = held.get(d, (0, 0, 0))
                    held[d] = [n + len(part), s + sums, p + products]
                if sum(d * d for d in held) > HELD:
                    yield from send()
        yield from send()

    parts = vectors.select("v").mapInArrow(run, SUMS)
    return parts.groupBy("d", "j", "k").agg(*[F.sum(a).alias(a) for a in ("a0", "a1", "a2")])


def covariance(n: int, sums: list[int], rows) -> np.ndarray:
    """n * products - sums * sums as whole numbers, over n * n; ``rows`` are the upper half's rows."""
    d = len(sums)
    total, out = np.array(sums, object), np.zeros((d, d))
    for j, row in enumerate(rows):
        out[j, j:] = out[j:, j] = ((n * row - sums[j] * total[j:]) / (n * n)).astype(np.float64)
    return out


def leading(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and their unit eigenvectors as columns; no spread gives 0."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    # The sign is free; the entry that is largest in size is made positive.
    biggest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[biggest, np.arange(len(order))] < 0, -1.0, 1.0)
    noise = len(covariance) * np.finfo(float).eps * max(float(values[0]), 0.0)
    return np.where(values > noise, values, 0.0), vectors


MODEL = "d int, n bigint, sums array<string>, share array<double>, e array<double>, axes binary"


def models(sums: DataFrame, components: int) -> DataFrame:
    """One row per length: count, sums, shares of the trace, eigenvalues and eigenvectors."""
    def fit(key: tuple, table: pa.Table) -> pa.Table:
        d = key[0].as_py()
        table = table.sort_by([("j", "ascending"), ("k", "ascending")])
        parts = [table[a].to_numpy() for a in ("a0", "a1", "a2")]

        def numbers(lo: int, hi: int) -> np.ndarray:
            a0, a1, a2 = (p[lo:hi].astype(object) for p in parts)
            return a0 + (a1 << LIMB) + (a2 << 2 * LIMB)

        # Sorted: the count, the d sums, then the rows of the upper half.
        n, total = int(numbers(0, 1)[0]), numbers(1, d + 1).tolist()
        ends = d + 1 + np.cumsum([0, *range(d, 0, -1)])
        v = covariance(n, total, (numbers(int(a), int(b)) for a, b in zip(ends, ends[1:])))
        e, axes = leading(v, components)
        trace = float(np.trace(v))
        return pa.Table.from_arrays(
            [pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([[str(s) for s in total]]),
             pa.array([(e / trace if trace > 0 else np.zeros(len(e))).tolist()]), pa.array([e.tolist()]),
             pa.array([np.ascontiguousarray(axes).tobytes()])], names=["d", "n", "sums", "share", "e", "axes"])

    return sums.groupBy("d").applyInArrow(fit, MODEL)


def groups_of(rows, limit: int):
    """Runs of models of about ``limit`` bytes, at least one model each."""
    group, size = {}, 0
    for r in rows:
        cost = len(r["axes"]) + 64 * r["d"]
        if group and size + cost > limit:
            yield group
            group, size = {}, 0
        axes = np.frombuffer(r["axes"]).reshape(r["d"], -1)
        group[r["d"]] = (r["n"], np.array([int(s) for s in r["sums"]], object), r["share"], np.array(r["e"]), axes)
        size += cost
    if group:
        yield group


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """n * x - sums exactly, and each row's sum of its squares, null if that is no long."""
    largest = n * int(np.abs(x).max()) + max(abs(int(s)) for s in sums)
    if largest < 1 << 62:
        c = n * x - sums.astype(np.int64)
        if x.shape[1] * int(np.abs(c).max()) ** 2 <= MAX_LONG:
            return c, (c * c).sum(axis=1).tolist()
        wide = c.astype(object)
    else:
        c = wide = n * x.astype(object) - sums
    squares = (wide * wide).sum(axis=1).tolist()
    return c, [s if s <= MAX_LONG else None for s in squares]


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """A row per vector: its key, ``d``, ``n``, ``deviation``, ``whitened`` and ``explained`` as arrays
    with an entry per component, and ``identity_error``."""
    column = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    usable = vectors.select(F.col(key).alias("key"), column.alias("v")).where(F.coalesce(fine, F.lit(False)))
    model = checkpointed(models(scatter_sums(usable), components))
    kind = usable.schema["key"].dataType.simpleString()
    out = f"key {kind}, d int, n bigint, deviation bigint, whitened array<double>, explained array<double>"

    def one_pass(group: dict) -> DataFrame:
        def run(batches):
            for batch in batches:
                for places, x in by_length(batch.column(1)):
                    d = x.shape[1]
                    if d not in group:
                        continue
                    n, sums, share, e, axes = group[d]
                    c, squares = centred(x, n, sums)
                    spread = e > 0
                    turned = (c / n).astype(np.float64) @ axes / np.sqrt(np.where(spread, e, 1.0))
                    rows, width = turned.shape
                    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
                    cells = pa.array(turned.ravel(), mask=np.tile(~spread, rows))
                    shares = pa.array(np.tile(share, rows))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(places)), pa.array(np.full(rows, d, np.int32)),
                         pa.array(np.full(rows, n, np.int64)), pa.array(squares, pa.int64()),
                         pa.ListArray.from_arrays(offsets, cells), pa.ListArray.from_arrays(offsets, shares)],
                        names=["key", "d", "n", "deviation", "whitened", "explained"])

        rows = checkpointed(usable.select("key", "v").mapInArrow(run, out))
        return rows.join(F.broadcast(identity_errors(rows, components)), "d")

    passes = [one_pass(g) for g in groups_of(model.orderBy("d").toLocalIterator(), model_bytes)]
    if not passes:
        return usable.where(F.lit(False)).select(
            "key", *[F.lit(None).cast(t).alias(n) for n, t in
                     (("d", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "array<double>"),
                      ("explained", "array<double>"), ("identity_error", "double"))])
    columns = ["key", "d", "n", "deviation", "whitened", "explained", "identity_error"]
    result = passes[0].select(*columns)
    for rows in passes[1:]:
        result = result.unionByName(rows.select(*columns))
    return result


def exact_sum(value: F.Column) -> F.Column:
    """The sum of numbers in steps of 2**-50 as two sums of whole numbers, so that the order in which
    rows and partial sums come makes no difference. Holds for 2**33 rows."""
    scaled = value * float(1 << 20)
    whole = F.rint(scaled)
    rest = F.rint((scaled - whole) * float(1 << 30))
    return (F.sum(whole.cast("bigint")) + F.sum(rest.cast("bigint")) / float(1 << 30)) / float(1 << 20)


def identity_errors(rows: DataFrame, components: int) -> DataFrame:
    """Per length, the largest entry by which the whitened rows' covariance misses the identity.

    It is measured on the rows: one row per length, as many as the pass has models."""
    names = [f"w{i}" for i in range(components)]
    flat = rows.select("d", *[F.get("whitened", F.lit(i)).alias(w) for i, w in enumerate(names)])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    # A component is null in all rows of a length or in none.
    means = [(exact_sum(F.col(a)) / F.count(a)).alias(a) for a in names]
    products = [(exact_sum(F.col(a) * F.col(b)) / F.count(F.col(a) * F.col(b))).alias(f"{a}_{b}") for a, b in pairs]
    missed = [F.abs(F.col(f"{a}_{b}") - F.col(a) * F.col(b) - (1.0 if a == b else 0.0)) for a, b in pairs]
    return flat.groupBy("d").agg(*means, *products).select("d", F.array_max(F.array(*missed)).alias("identity_error"))


def whiten_report(vectors: DataFrame) -> DataFrame:
    """A row per vector and component."""
    rows = whiten(vectors)
    cells = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "cell")
    return rows.select("key", "n", "deviation", "identity_error", cells).select(
        F.col("key").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("cell.whitened").alias("whitened"), F.col("cell.explained").alias("explained"), "identity_error")
