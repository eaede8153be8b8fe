"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become integers, so the scatter n * sum(z z') - Z Z' of the centred vectors is a matrix of integers, known
exactly.  Its characteristic polynomial is found modulo many primes, each by reduction to Hessenberg form, and put
together by Chinese remaindering; primes are rows of a table that Spark deals to tasks.  All roots are real, so the sign
changes of the polynomial moved to a point count the roots beyond it exactly: bisection isolates the largest roots and
refines them to ``DIGITS`` digits.  Components come from inverse iteration on the scatter less a root, in decimals of
``DIGITS`` digits.  The driver holds matrices and polynomials of the dimension, never rows.
"""

from __future__ import annotations

import decimal
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import materialise

SCALE, SHIFT = 1024, 100_000
#: Decimal digits of roots and of inverse iteration.
DIGITS = 60
#: Largest and smallest long.
MOST, LEAST = (1 << 63) - 1, -(1 << 63)
#: Bits of the signed parts into which centred entries are split: products of two, summed over a slice, stay exact in a double.
PART_BITS, SLICE = 18, 1 << 14

# --- the integer vectors


def integer_vectors(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x array<long>`` = floor(1024 c) + 100000 of the vectors that take part.

    Left out are null vectors, vectors with null, NaN or infinite entries, empty vectors, and vectors of another length
    than the most frequent one (ties: the longer).  Entries beyond a long are held at its end.
    """
    finite = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    sound = vectors.filter(F.coalesce(finite & (F.size(embedding) > 0), F.lit(False)))
    x = F.transform(embedding, lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(MOST - SHIFT)), F.lit(LEAST)) + SHIFT)
    whole = materialise(sound.select("vec_id", x.alias("x")))
    lengths = whole.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).head(2)
    return whole.filter(F.size("x") == lengths[0]["length"]) if len(lengths) > 1 else whole


def sums(x: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the sum of every dimension."""
    dims = x.select(F.size("x").alias("d")).head()
    if dims is None:
        return 0, []
    row = x.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims["d"])]).head()
    return row["n"], [int(row[f"s{i}"]) for i in range(dims["d"])]


def rows_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of a batch as a matrix of longs."""
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def parts(z: np.ndarray) -> list[np.ndarray]:
    """``z`` as sum of parts[k] * 2 ** (PART_BITS * k), signed parts that doubles hold exactly."""
    out, half = [], 1 << (PART_BITS - 1)
    while True:
        low = ((z + half) & ((1 << PART_BITS) - 1)) - half
        out.append(low.astype(np.float64))
        z = (z - low) >> PART_BITS
        if not z.any():
            return out


def gram(z: np.ndarray) -> np.ndarray:
    """The exact z' z as Python integers."""
    total = np.zeros((z.shape[1], z.shape[1]), dtype=object)
    for at in range(0, len(z), SLICE):
        own = parts(z[at : at + SLICE])
        for i, a in enumerate(own):
            for j, b in enumerate(own):
                total += (a.T @ b).astype(np.int64).astype(object) << (PART_BITS * (i + j))
    return total


def scatter(x: DataFrame, n: int, totals: list[int]) -> list[list[int]]:
    """n * sum((x - S/n)(x - S/n)') * n, exact: each vector is centred by the rounded mean before it is multiplied.

    Each task sums its own vectors; one row a dimension and task meets the others in the JVM as digits of base 10**18,
    so that no sum of them can overflow.
    """
    dims = len(totals)
    centre = np.array([round(s / n) if abs(s) < 1 << 52 else s // n for s in totals], dtype=np.int64)
    base = 10**18

    def run(batches):
        total, rest = np.zeros((dims, dims), dtype=object), np.zeros(dims, dtype=object)
        for batch in batches:
            z = rows_of(batch, dims)
            if z.size and (int(z.max()) - int(centre.min()) > MOST or int(z.min()) - int(centre.max()) < LEAST):
                raise OverflowError("entries are too far from their mean for whole numbers of 64 bits")
            z = z - centre
            total += gram(z)
            rest += np.array([int(v) for v in z.astype(object).sum(axis=0)] if len(z) else [0] * dims, dtype=object)
        for i in range(dims):
            row, digits = [int(v) for v in [*total[i], rest[i]]], []
            while any(row):
                digits.append([abs(v) % base * (1 if v >= 0 else -1) for v in row])
                row = [abs(v) // base * (1 if v >= 0 else -1) for v in row]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(digits), pa.int32()), pa.array(range(len(digits)), pa.int32()), pa.array(digits, pa.list_(pa.int64()))], names=["i", "place", "digits"]
            )

    tasks = x.select("x").mapInArrow(run, "i int, place int, digits array<bigint>")
    spread = tasks.select("i", "place", F.posexplode("digits").alias("j", "digit"))
    whole = [[0] * (dims + 1) for _ in range(dims)]
    for row in spread.groupBy("i", "j", "place").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit")).toLocalIterator():
        whole[row["i"]][row["j"]] += int(row["digit"]) * base ** row["place"]
    rest = [row[dims] for row in whole]
    return [[n * whole[i][j] - rest[i] * rest[j] for j in range(dims)] for i in range(dims)]


# --- the characteristic polynomial


def primes_below(top: int, bits: float) -> list[int]:
    """Primes downwards from ``top`` whose product has more than ``bits`` bits, by a sieve of stretches."""
    small = np.ones(1 << 16, dtype=bool)
    small[:2] = False
    for p in range(2, 256):
        if small[p]:
            small[p * p :: p] = False
    small_primes = np.flatnonzero(small).tolist()
    out, width = [], 1 << 18
    while bits > 0:
        low = top - width
        sieve = np.ones(width, dtype=bool)
        for p in small_primes:
            sieve[-low % p :: p] = False
        for p in (low + np.flatnonzero(sieve)[::-1]).tolist():
            out.append(p)
            bits -= math.log2(p)
            if bits <= 0:
                break
        top = low
    return out


def polynomial_modulo(matrix: list[list[int]], p: int) -> np.ndarray:
    """Coefficients of det(t I - M) modulo ``p`` < 2**31, of t**0 first, by reduction to Hessenberg form."""
    h = np.array([[v % p for v in row] for row in matrix], dtype=np.int64)
    d = len(h)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        if (at := k + int(below[0])) != k:
            h[[k, at]] = h[[at, k]]
            h[:, [k, at]] = h[:, [at, k]]
        factor = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - factor[:, None] * h[k] % p) % p
        # the inverse change of columns, added up in halves that cannot overflow
        low, high = factor & 0x7FFF, factor >> 15
        add = ((h[:, k + 1 :] * low % p).sum(axis=1) + (h[:, k + 1 :] * high % p).sum(axis=1) % p * (1 << 15)) % p
        h[:, k] = (h[:, k] + add) % p
    # p_k = (t - h_kk) p_(k-1) - sum over i of h_ik * (product of subdiagonals) * p_(i-1)
    poly = np.zeros((d + 1, d + 1), dtype=np.int64)
    poly[0, 0] = 1
    for k in range(1, d + 1):
        poly[k, 1:] = poly[k - 1, :-1]
        poly[k] = (poly[k] - int(h[k - 1, k - 1]) * poly[k - 1] % p) % p
        product = 1
        for i in range(k - 1, 0, -1):
            product = product * int(h[i, i - 1]) % p
            if not product:
                break
            poly[k] = (poly[k] - (int(h[i - 1, k - 1]) * product % p) * poly[i - 1] % p) % p
    return poly[d]


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """The integer coefficients of det(t I - M), of t**0 first.

    The k-th coefficient from the top is at most C(d, k) * trace**k / k**k for a matrix without negative roots.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bits = 2 + max((math.log2(math.comb(d, k)) + k * max(0.0, math.log2(max(trace, 1)) - math.log2(k)) for k in range(1, d + 1)), default=0.0)
    primes = primes_below(1 << 31, bits)
    shipped = spark.sparkContext.broadcast([[str(v) for v in row] for row in matrix])

    def run(batches):
        own = None
        for batch in batches:
            own = own or [[int(v) for v in row] for row in shipped.value]
            found = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([polynomial_modulo(own, p).tolist() for p in found], pa.list_(pa.int64()))], names=["p", "residues"])

    tasks = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(run, "p long, residues array<bigint>").collect()
    value, product = [0] * (d + 1), 1
    for row in rows:
        p, inverse = row["p"], pow(product, -1, row["p"])
        value = [v + product * ((r - v) * inverse % p) for v, r in zip(value, row["residues"], strict=True)]
        product *= p
    return [v - product if v > product // 2 else v for v in value]


# --- roots


def moved(poly: list[int], top: int, shift: int) -> list[int]:
    """Coefficients of 2**(shift d) * p((t + top) / 2**shift)."""
    d = len(poly) - 1
    out = [c << (shift * (d - k)) for k, c in enumerate(poly)]
    if top:
        for i in range(d):
            for k in range(d - 1, i - 1, -1):
                out[k] += top * out[k + 1]
    return out


def beyond(poly: list[int], top: int, shift: int) -> int:
    """How many roots are greater than top / 2**shift; exact, with multiplicity, since all roots are real."""
    signs = [c > 0 for c in moved(poly, top, shift) if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def largest_roots(poly: list[int], count: int) -> list[tuple[int, int, int]]:
    """(top, shift, group) of the ``count`` largest positive roots, falling: a root is top / 2**shift, from above.

    Intervals (low, high] are halved until each holds one root, or roots that agree to ``DIGITS`` digits, and then until
    the interval is narrower than a root's last digit.  Roots that cannot be told apart have one group.
    """
    bits = max((c.bit_length() for c in poly), default=1) + 1
    digits = math.ceil(DIGITS * math.log2(10))
    known: dict[tuple[int, int], int] = {}

    def more(at: int, shift: int) -> int:
        while shift and not at & 1:
            at, shift = at >> 1, shift - 1
        if (at, shift) not in known:
            known[at, shift] = beyond(poly, at, shift)
        return known[at, shift]

    positive = more(0, 0)
    high = 1
    while more(high, 0) and high.bit_length() <= bits:
        high *= 2
    out: list[tuple[int, int, int]] = []
    wanted = min(count, positive)
    stack = [(0, high, 0)]
    while stack and len(out) < wanted:
        low, high, shift = stack.pop()
        inside = more(low, shift) - more(high, shift)
        if not inside:
            continue
        if inside == 1 or (low and (high - low).bit_length() + digits < low.bit_length()):
            top, places = refined(poly, low, high, shift, digits) if inside == 1 else (high, shift)
            out += [(top, places, len(out))] * inside
            continue
        low, high, shift = 2 * low, 2 * high, shift + 1
        middle = (low + high) // 2
        stack += [(low, middle, shift), (middle, high, shift)]
    return out[:wanted]


def refined(poly: list[int], low: int, high: int, shift: int, digits: int) -> tuple[int, int]:
    """Halves (low, high] / 2**shift around its only root by the sign of the polynomial alone."""

    def sign(at: int, places: int) -> int:
        value = 0
        for k, c in enumerate(reversed(poly)):
            value = value * at + (c << (places * k))
        return (value > 0) - (value < 0)

    right = sign(high, shift)
    if not right:
        return high, shift
    while not low or (high - low).bit_length() + digits > low.bit_length():
        low, high, shift = 2 * low, 2 * high, shift + 1
        middle = (low + high) // 2
        own = sign(middle, shift)
        if not own:
            return middle, shift
        low, high = (low, middle) if own == right else (middle, high)
    return high, shift


# --- components


def components(matrix: list[list[int]], roots: list[tuple[int, int, int]]) -> list[list[float]]:
    """Unit vectors of the roots' null spaces by inverse iteration; those of one group are orthogonal to each other.

    Of each vector the entry with the greatest size (ties: the first) is positive.
    """
    d = len(matrix)
    with decimal.localcontext() as context:
        context.prec, context.Emax, context.Emin = 2 * DIGITS, decimal.MAX_EMAX, decimal.MIN_EMIN
        whole = [[Decimal(v) for v in row] for row in matrix]
        size = max((abs(v) for row in whole for v in row), default=Decimal(1)) or Decimal(1)
        done: list[tuple[int, list[Decimal]]] = []
        for k, (top, shift, group) in enumerate(roots):
            root = Decimal(top) / Decimal(1 << shift)
            rows = [[v - root if i == j else v for j, v in enumerate(row)] for i, row in enumerate(whole)]
            order, least = list(range(d)), size * Decimal(10) ** -(2 * DIGITS - 10)
            for i in range(d):
                best = max(range(i, d), key=lambda r: abs(rows[r][i]))
                rows[i], rows[best], order[i], order[best] = rows[best], rows[i], order[best], order[i]
                if abs(rows[i][i]) < least:
                    rows[i][i] = least
                for r in range(i + 1, d):
                    if rows[r][i]:
                        rows[r][i] = factor = rows[r][i] / rows[i][i]
                        own, base = rows[r], rows[i]
                        own[i + 1 :] = [a - factor * b for a, b in zip(own[i + 1 :], base[i + 1 :], strict=True)]
            v = [Decimal(((k + 3) * (i + 1) * 7919) % 101 + 1) for i in range(d)]
            for _ in range(3):
                v = solved(rows, [v[i] for i in order])
                for other, u in done:
                    if other == group:
                        share = sum(a * b for a, b in zip(u, v, strict=True))
                        v = [b - share * a for a, b in zip(u, v, strict=True)]
                norm = sum(a * a for a in v).sqrt()
                v = [a / norm for a in v]
            lead = max(range(d), key=lambda i: (abs(v[i]), -i))
            done.append((group, v if v[lead] > 0 else [-a for a in v]))
    return [[float(a) for a in v] for _, v in done]


def solved(rows: list[list[Decimal]], right: list[Decimal]) -> list[Decimal]:
    """Forward and back substitution with the factors that ``rows`` holds."""
    d = len(rows)
    for i in range(d):
        right[i] -= sum((a * b for a, b in zip(rows[i][:i], right[:i], strict=True)), Decimal(0))
    for i in range(d - 1, -1, -1):
        right[i] = (right[i] - sum((a * b for a, b in zip(rows[i][i + 1 :], right[i + 1 :], strict=True)), Decimal(0))) / rows[i][i]
    return right


# --- the operator


def fit(x: DataFrame, count: int = 8) -> dict:
    """``n``, ``sums``, and for each component its unit ``vectors``, ``eigenvalues`` (of V) and ``explained`` shares.

    A component needs an eigenvalue above zero, so there are fewer than ``count`` where the vectors span less.
    """
    n, totals = sums(x)
    if not n:
        return {"n": 0, "sums": [], "vectors": [], "eigenvalues": [], "explained": []}
    matrix = scatter(x, n, totals)
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    roots = largest_roots(characteristic_polynomial(x.sparkSession, matrix), count) if trace else []
    with decimal.localcontext() as context:
        context.prec = DIGITS
        exact = [Decimal(top) / Decimal(1 << shift) for top, shift, _ in roots]
        values, explained = [float(r / (n * n)) for r in exact], [float(r / trace) for r in exact]
    return {"n": n, "sums": totals, "vectors": components(matrix, roots), "eigenvalues": values, "explained": explained}


def project(x: DataFrame, model: dict) -> DataFrame:
    """``vec_id``, ``deviation`` (sum of (n x - S)**2, exact, held at the end of a long) and ``whitened array<double>``."""
    n, totals, dims = model["n"], model["sums"], len(model["sums"])
    centre = np.array([s // n for s in totals], dtype=np.int64)
    rest = [s - n * int(c) for s, c in zip(totals, centre, strict=True)]
    axes = np.array(model["vectors"]).reshape(-1, dims).T / np.sqrt(model["eigenvalues"])
    offset = np.array(rest, dtype=np.float64) / n

    def run(batches):
        for batch in batches:
            z = rows_of(batch, dims) - centre
            most = max(abs(int(z.min(initial=0))), int(z.max(initial=0))) + 1
            y = z if most * n < 1 << 62 and dims * (most * n) ** 2 <= MOST else z.astype(object)
            y = y * n - np.array(rest, dtype=y.dtype)
            deviation = [min(int(v), MOST) for v in (y * y).sum(axis=1)]
            out = (z - offset) @ axes
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviation, pa.int64()), pa.array(list(out), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"]
            )

    kind = dict(x.dtypes)["vec_id"]
    return x.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(projected: DataFrame, count: int) -> float:
    """The largest entry, by size, of the whitened vectors' covariance less the identity."""
    w = [F.col("whitened")[i] for i in range(count)]
    entries = [F.abs(F.covar_pop(w[i], w[j]) - (1.0 if i == j else 0.0)).alias(f"e{i}_{j}") for i in range(count) for j in range(i + 1)]
    return max(projected.agg(*entries).head())


def whiten(vectors: DataFrame, embedding: str = "embedding", count: int = 8) -> DataFrame:
    """One row per vector that takes part and component: see ``integer_vectors``, ``fit`` and ``project``.

    Vectors that all are equal have no component, so they and empty tables give no rows.  Rows with one ``vec_id`` and
    rows with a null one each have their own results; other columns are left out.
    """
    x = integer_vectors(vectors, embedding)
    model = fit(x, count)
    found = len(model["vectors"])
    schema = f"vec_id {dict(x.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not found:
        return x.sparkSession.createDataFrame([], schema)
    projected = materialise(project(x, model))
    error = identity_error(projected, found)
    shares = F.array(*[F.lit(v) for v in model["explained"]])
    spread = projected.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return spread.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"),
    )
