"""Embedding whitening from an exact scatter matrix in residue numbers.

Components become integers. Their scatter, with a constant one beside them for sums and count, is multiplied block by
block modulo several primes below 2^20: products of up to BLOCK residues stay below 2^53, so a double GEMM is exact.
Each partition sends one residue matrix a prime; residues are added, and the Chinese remainder gives every
entry of the scatter as it is, whatever the order of partitions. There are as many primes as the largest component and the
number of rows ask for. The covariance is rounded to doubles once, from exact integers, and goes to eigh.

Vectors of one length are a fit list of their own. The model (one row a length) is broadcast only while it is small.
How white the result is, is measured on the whitened vectors themselves, centred and merged part by part.

Defined results: a vector that is null, empty, or holds a null or non-finite component takes no part; a null or repeated
id is a row like any other; components beyond the range of a long stand at its ends; a component whose variance is not above
rounding (constant or dependent columns, a single row) has null for its whitened values; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

BLOCK, BLOCK_BYTES, SCALE, SHIFT, COMPONENTS = 4096, 1 << 20, 64, 1_000_000, 32
#: A model of at most so many bytes is broadcast.
BROADCAST = 32 << 20
#: Partial scatters of a partition are sent on beyond so many bytes.
HELD = 64 << 20


def whole_numbers(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """id and x (array of long) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    least, most = -(1 << 63) + (1 << 11), (1 << 63) - (1 << 21)
    long = lambda c: F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), F.floor(c * scale).cast("double"))).cast("long") + shift
    return df.filter(F.coalesce(finite, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(v, long).alias("x"))


BLOCKED = "dims int, rows int, largest double, ids array<bigint>, vectors binary"


def blocked(vectors: DataFrame) -> DataFrame:
    """vectors in blocks of one length, each a row: as many rows as fit in BLOCK_BYTES, BLOCK at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dims: int, ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
            largest = float(max(abs(int(x.min())), abs(int(x.max()))))
            kind = np.int32 if largest < 1 << 31 else np.int64
            columns = [pa.array([dims], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([largest]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([x.astype(kind).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["dims", "rows", "largest", "ids", "vectors"])

        for batch in batches:
            column = batch.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for dims in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dims)
                held.setdefault(dims, []).append((batch.column(0).take(pa.array(own)), flat[starts[own][:, None] + np.arange(dims)]))
                size = max(1, min(BLOCK, BLOCK_BYTES // (8 * dims)))
                if sum(len(x) for _, x in held[dims]) >= size:
                    ids, x = pa.concat_arrays([i for i, _ in held[dims]]), np.concatenate([x for _, x in held[dims]])
                    full = len(x) // size * size
                    for at in range(0, full, size):
                        yield block(dims, ids[at : at + size], x[at : at + size])
                    held[dims] = [(ids[full:], x[full:])]
        for dims, parts in held.items():
            ids, x = pa.concat_arrays([i for i, _ in parts]), np.concatenate([x for _, x in parts])
            if len(x):
                yield block(dims, ids, x)

    return vectors.select("id", "x").mapInArrow(run, BLOCKED)


def integers(blob: bytes, dims: int, rows: int) -> np.ndarray:
    kind = np.int32 if len(blob) == 4 * dims * rows else np.int64
    return np.frombuffer(blob, kind).reshape(rows, dims).astype(np.int64)


def primes(beyond: int) -> list[int]:
    """The largest primes below 2^20 whose product is beyond a number."""
    top = 1 << 20
    sieve = np.ones(top, bool)
    sieve[:2] = False
    for i in range(2, 1 << 10):
        if sieve[i]:
            sieve[i * i :: i] = False
    out, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        out.append(p)
        product *= p
        if product > beyond:
            return out
    raise ValueError("no primes left")


def scatter(blocks: DataFrame, moduli: list[int]) -> DataFrame:
    """dims, i, entries (array of decimal strings): row i of the exact scatter of (x, 1)."""
    m = len(moduli)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for dims, sums in held.items():
                rows = [sums[:, i].tobytes() for i in range(dims + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([dims] * (dims + 1), pa.int32()), pa.array(range(dims + 1), pa.int32()), pa.array(rows, pa.binary())], ["dims", "i", "sums"])
            held.clear()

        for batch in batches:
            for dims, rows, blob in zip(*(batch.column(c).to_pylist() for c in ("dims", "rows", "vectors"))):
                x = np.concatenate([integers(blob, dims, rows), np.ones((rows, 1), np.int64)], 1)
                if dims not in held:
                    held[dims] = np.zeros((m, dims + 1, dims + 1), np.int64)
                for k, p in enumerate(moduli):
                    r = (x % p).astype(np.float64)
                    held[dims][k] = (held[dims][k] + (r.T @ r).astype(np.int64)) % p
                if sum(s.nbytes for s in held.values()) > HELD:
                    yield from out()
        yield from out()

    product = 1
    for p in moduli:
        product *= p
    weights = [product // p * pow(product // p, -1, p) for p in moduli]

    def whole(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, i = key[0].as_py(), key[1].as_py()
        total = np.zeros((m, dims + 1), np.int64)
        for batch in batches:
            for blob in batch.column("sums").to_pylist():
                total = (total + np.frombuffer(blob, np.int64).reshape(m, dims + 1)) % np.array(moduli)[:, None]
        exact = [sum(w * r for w, r in zip(weights, column)) % product for column in total.T.tolist()]
        signed = [str(e - product if 2 * e > product else e) for e in exact]
        yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([i], pa.int32()), pa.array([signed], pa.list_(pa.string()))], ["dims", "i", "entries"])

    parts = blocks.select("dims", "rows", "vectors").mapInArrow(partial, "dims int, i int, sums binary")
    return parts.groupBy("dims", "i").applyInArrow(whole, "dims int, i int, entries array<string>")


MODEL = "dims int, n bigint, base array<bigint>, over array<bigint>, directions array<double>, explained array<double>"


def fitted(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row a length: n; per dimension S // n (base) and S % n (over); components by falling variance as unit
    vectors over their standard deviation (null where it is not above rounding), one after the other; explained shares."""

    def fit(table: pa.Table) -> pa.Table:
        dims = table.column("dims")[0].as_py()
        entries: list[list[int]] = [[]] * (dims + 1)
        for i, row in zip(table.column("i").to_pylist(), table.column("entries").to_pylist()):
            entries[i] = [int(e) for e in row]
        n, sums = entries[dims][dims], entries[dims][:dims]
        covariance = np.array([[(n * entries[i][j] - sums[i] * sums[j]) / (n * n) for j in range(dims)] for i in range(dims)])
        values, vectors = np.linalg.eigh(covariance)
        k = min(components, dims)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        largest = np.abs(vectors).argmax(0)
        vectors = vectors * np.sign(vectors[largest, np.arange(k)])
        above = values > dims * np.finfo(float).eps * max(values[0], 0.0)
        directions = np.where(above, vectors / np.sqrt(np.where(above, values, 1.0)), np.nan).T
        trace = np.trace(covariance)
        explained = np.where(above, values, 0.0) / trace if trace > 0 else np.zeros(k)
        blank = lambda a: pa.array(a, mask=np.isnan(a))
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        columns = [pa.array([dims], pa.int32()), pa.array([n]), pa.array([[s // n for s in sums]]), pa.array([[s % n for s in sums]]), one(blank(directions.ravel())), one(pa.array(explained))]
        return pa.Table.from_arrays(columns, ["dims", "n", "base", "over", "directions", "explained"])

    return rows.groupBy("dims").applyInArrow(fit, MODEL)


def _white(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Centred integers y (x - base) and whitened vectors of a block that has met its model."""
    x = integers(row["vectors"], row["dims"], row["rows"])
    y = x - np.array(row["base"])
    directions = np.array(row["directions"], np.float64).reshape(-1, row["dims"])
    return y, (y - np.array(row["over"]) / row["n"]) @ directions.T


def _deviation(y: np.ndarray, over: list[int], n: int) -> list[int]:
    """The sum over dimensions of (n * y - over)^2, exactly."""
    dims, reach = y.shape[1], max(abs(int(y.min())), abs(int(y.max())), 1)
    if dims * (n * reach + n) ** 2 < 1 << 63:
        return ((n * y - np.array(over)) ** 2).sum(1).tolist()
    return [sum((n * a - b) ** 2 for a, b in zip(row, over)) for row in y.tolist()]


def identity_error(met: DataFrame) -> DataFrame:
    """dims, identity_error: the largest absolute entry of the whitened vectors' covariance minus the identity. Each
    partition sends, for each component, its count, means, and centred products with all components."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for row in batch.to_pylist():
                _, z = _white(row)
                part = (len(z), z.mean(0), (z - z.mean(0)).T @ (z - z.mean(0)))
                held[row["dims"]] = _merged(held[row["dims"]], part) if row["dims"] in held else part
        for dims, (n, mean, products) in held.items():
            k = len(mean)
            names = ["dims", "i", "n", "mean", "products"]
            yield pa.RecordBatch.from_arrays([pa.array([dims] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([n] * k, pa.int64()), pa.array([mean.tobytes()] * k), pa.array([p.tobytes() for p in products])], names)

    def whole(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, total = key[1].as_py(), None
        for batch in batches:
            for n, mean, products in zip(*(batch.column(c).to_pylist() for c in ("n", "mean", "products"))):
                part = (n, np.frombuffer(mean), np.frombuffer(products))
                total = part if total is None else _merged(total, part, i)
        n, _, products = total
        error = np.abs(products / n - (np.arange(len(products)) == i))
        own = error[~np.isnan(error)]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([float(own.max()) if len(own) else None], pa.float64())], ["dims", "error"])

    parts = met.mapInArrow(partial, "dims int, i int, n bigint, mean binary, products binary")
    rows = parts.groupBy("dims", "i").applyInArrow(whole, "dims int, error double")
    return rows.groupBy("dims").agg(F.max("error").alias("identity_error"))


def _merged(a: tuple, b: tuple, i: int | None = None) -> tuple:
    """Two parts of count, means and centred products as one; products of component i only, or all."""
    n = a[0] + b[0]
    delta = b[1] - a[1]
    crossed = np.outer(delta, delta) if i is None else delta[i] * delta
    return n, a[1] + delta * (b[0] / n), a[2] + b[2] + crossed * (a[0] * b[0] / n)


def _met(blocks: DataFrame, model: DataFrame) -> DataFrame:
    """blocks with the model of their length: a stored model is broadcast where it is small; else lengths are joined."""
    size = model.agg(F.sum(8 * (F.size("directions") + 2 * F.size("base")))).first()[0] or 0
    return blocks.join(F.broadcast(model) if size <= BROADCAST else model, "dims")


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """id, dims, n, deviation (decimal(38,0), null where it has more digits), whitened and explained (arrays over components) and
    identity_error of each vector that takes part."""
    blocks = written(blocked(whole_numbers(df, key, vector, scale, shift)), "vectors")
    n, largest = blocks.agg(F.sum("rows"), F.max("largest")).first()
    bound = 2 * ((n or 0) + 1) * (int(largest or 0) + (1 << 12)) ** 2
    model = written(fitted(scatter(blocks, primes(bound)), components), "model")
    met = _met(blocks, model)
    errors = written(identity_error(met.select("dims", "rows", "vectors", "n", "base", "over", "directions")), "errors")
    whole = _met(blocks, model.join(errors, "dims"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                y, z = _white(row)
                rows, k = z.shape
                offsets = pa.array(range(0, rows * k + 1, k), pa.int32())
                lists = lambda a: pa.ListArray.from_arrays(offsets, a)
                far = [d if d < 10**38 else None for d in _deviation(y, row["over"], row["n"])]
                deviation = pa.array(far, pa.int64()).cast(pa.decimal128(38, 0)) if max(d or 1 << 63 for d in far) < 1 << 63 else pa.array(far, pa.decimal128(38, 0))
                columns = [
                    pa.array(row["ids"], pa.int64()), pa.array([row["dims"]] * rows, pa.int32()), pa.array([row["n"]] * rows, pa.int64()), deviation,
                    lists(pa.array(z.ravel(), mask=np.isnan(z.ravel()))), lists(pa.array(np.tile(row["explained"], rows))), pa.array([row["identity_error"]] * rows, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "dims", "n", "deviation", "whitened", "explained", "identity_error"])

    kinds = "id bigint, dims int, n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    return whole.mapInArrow(run, kinds)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component; a deviation beyond 64 bits is null."""
    white = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "pair")
    rows = white.withColumn("deviation", F.expr("try_cast(deviation AS bigint)")).select("*", pairs)
    return rows.select(F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), "n", "deviation", F.col("pair.whitened").alias("whitened"), F.col("pair.explained").alias("explained"), "identity_error")
