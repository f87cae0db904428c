"""Per-series time-series tests (TST7-TST9, WIN4-WIN7).

The reference ran these on one stacked column in file order; here each test
runs per series, ordered by its order columns, the single-series case being a
series key with one value.

Plan, all series at once:

1. the values of each series are packed in order (``blocks``), a series of any
   length spread over as many tasks as it needs;
2. an Arrow pass sums lag products: of the centred values for every lag the
   KPSS bandwidth may take, of the differences and of values with differences
   for the ADF lags, of the squared values for ARCH, and the running sum (WIN4,
   WIN5). A long series gives one small row of sums a chunk, added up in order, the
   rows of a chunk, then of a series being sorted together;
3. from these sums and the first and last values, the cross products of any
   regression sample follow: those of one lag difference differ only by terms
   at the ends. So a row a series (bounded by its number of lags, not by its length) finishes the regressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavepanel.functions import special as S
from wavepanel.operators.blocks import BLOCK_ROWS, chunks, key_field, ordered_blocks, whole_keys
from wavepanel.operators.clean import as_numbers
from wavepanel.operators.segments import Rows, chunked_row_number, resolve_width

# ---------------------------------------------------------------------------
# Fixed values that must equal the published tables for identical results.
# ---------------------------------------------------------------------------
# MacKinnon (1994) approximate p-values, one I(1) variable, constant only:
# upper / lower bounds of the statistic, switch point, small-p and large-p
# polynomial coefficients (ascending powers).
ADF_TAU_MAX = 2.74
ADF_TAU_MIN = -18.83
ADF_TAU_STAR = -1.61
ADF_SMALLP = [2.1659, 1.4412, 0.038269]
ADF_LARGEP = [1.7339, 0.93202, -0.12745, -0.010368]
# MacKinnon (2010) critical values, constant only: c0 + c1/T + c2/T^2 + c3/T^3
ADF_CRIT = {"1%": [-3.43035, -6.5393, -16.786, -79.433],
            "5%": [-2.86154, -2.8903, -4.234, -40.040],
            "10%": [-2.56677, -1.5384, -2.809, 0.0]}
# KPSS level-stationarity critical values (Kwiatkowski et al. 1992, Table 1)
KPSS_CRIT = [0.347, 0.463, 0.574, 0.739]
KPSS_P = [0.10, 0.05, 0.025, 0.01]
# ---------------------------------------------------------------------------

MIN_SERIES = 10        # shorter series get null statistics (TST11)
ARCH_MAX_LAGS = 10
#: Units of a series whose sums are added up first, before those of the whole series.
TOGETHER = 64
#: Series, or rows of sums, that a Python worker holds as Python numbers at once.
SLICE_ROWS = 256


def adf_max_lag(n: int) -> int:
    return max(0, min(n // 2 - 2, int(math.ceil(12.0 * (n / 100.0) ** 0.25))))


def kpss_most_lags(n: int) -> int:
    """The automatic bandwidth of a series of ``n`` values unless its long-run
    variance all but vanishes, and the lags that it is worked out from."""
    covlags = int(n ** (2.0 / 9.0))
    return max(covlags, math.ceil(1.1447 * covlags ** (2.0 / 3.0) * n ** (1.0 / 3.0)), 1)


# ---- lag sums (WIN4, WIN5) ---------------------------------------------------

Lags = Callable[[int], tuple[int, int, int]]
#: ``ac`` of values, ``dc`` of differences, ``xc`` of a value with later differences, ``bc`` of squares less their mean;
#: ``run``: rows, sum, and the running sum's sum and sum of squares, then the sum of ``b``; the first and last values.
SUMS = T.StructType([T.StructField("n", T.LongType()), *(T.StructField(c, T.ArrayType(T.DoubleType()))
                                                        for c in ("ac", "dc", "xc", "bc", "run", "first", "last"))])


def kpss_lags(n: int, ac: np.ndarray) -> int | None:
    """The automatic bandwidth; null if the long-run variance it divides by is zero."""
    covlags = int(n ** (2.0 / 9.0))
    j = np.arange(1, covlags + 1)
    s0 = ac[0] / n + ac[j].sum() / (n / 2.0)
    s1 = (j * ac[j]).sum() / (n / 2.0)
    return min(int(1.1447 * ((s1 / s0) ** 2) ** (1.0 / 3.0) * n ** (1.0 / 3.0)), n - 1) if s0 else None


def chunk_sums(r: np.ndarray, own: int, at_start: bool, mean_square: float, lags: tuple[int, int, int],
               all_lags: bool = False) -> list[np.ndarray]:
    """Lag products of the places from ``own`` on with those before them. With
    ``all_lags`` (a whole series of enough values) those of any KPSS bandwidth."""
    def products(left: np.ndarray, right: np.ndarray, most: int, least: int) -> np.ndarray:
        out = np.zeros(most + 1)
        for j in range(min(most, len(r) - 1) + 1):
            i = max(own, j + least)
            if i < len(r):
                out[j] = left[i:] @ right[i - j:len(r) - j]
        return out

    k, l, p = lags
    d = np.diff(r, prepend=r[:1])
    before = np.concatenate((r[:1], r[:-1]))
    b = r * r - mean_square
    one = 1 if at_start else 0                                              # the first value of all has no difference
    run = np.cumsum(r[own:])
    edge = l + 2 + ARCH_MAX_LAGS
    ac = products(r, r, k, 0)
    wanted = kpss_lags(len(r), ac) if all_lags else None
    if wanted is not None and wanted > k:
        ac = products(r, r, wanted, 0)
    return [ac, products(d, d, l, one), products(before, d, l, one), products(b, b, p, 0),
            np.array([len(run), run[-1], run.sum(), run @ run, b[own:].sum()]), r[:edge] if at_start else r[:0], r[-edge:]]


def add_sums(parts: list[list]) -> list[np.ndarray]:
    """The sums of consecutive chunks; running sums go on from one to the next."""
    out = [np.asarray(x, float) for x in parts[0]]
    for part in parts[1:]:
        part = [np.asarray(x, float) for x in part]
        for i in range(4):
            out[i] = out[i] + part[i]
        n, total, first, second, b = out[4]
        m, more, s1, s2, b2 = part[4]
        out[4] = np.array([n + m, total + more, first + s1 + m * total, second + s2 + 2 * total * s1 + m * total * total, b + b2])
        out[6] = part[6]
    return out


#: A batch from keys and the (n, sums) of each.
Finish = Callable[[pa.Array, list[tuple[int, list]]], pa.RecordBatch]


def _sums_batch(keys: pa.Array, rows: list[tuple[int, list]], part: list[int] | None = None) -> pa.RecordBatch:
    columns = [keys] + ([pa.array(part, pa.int64())] if part is not None else [])
    columns.append(pa.array([n for n, _ in rows], pa.int64()))
    columns += [pa.array([s[i] for _, s in rows], pa.list_(pa.float64())) for i in range(7)]
    return pa.RecordBatch.from_arrays(columns, names=["key", *(["part"] if part is not None else []), *SUMS.names])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time: as Python numbers, the sums of a whole Arrow batch would take far more memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[pa.Array, list[tuple]]]:
    """(key as an array of one, rows) of consecutive rows that are equal in their first ``by`` columns."""
    key, now, held = None, None, []
    for part in _slices(batches):
        columns = [c if pa.types.is_binary(c.type) and i else c.to_pylist() for i, c in enumerate(part.columns)]
        for i, row in enumerate(zip(*columns)):
            if held and not all(a == b or (a != a and b != b) for a, b in zip(row[:by], now)):
                yield key, held
                held = []
            if not held:
                key, now = part.column(0).slice(i, 1), row[:by]
            held.append(row)
    if held:
        yield key, held


def _gathered(rows: Iterator[tuple], batch: Callable[..., pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batch`` of the keys (arrays of one) and the other items of ``SLICE_ROWS`` rows at a time."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == SLICE_ROWS:
            keys, *others = zip(*held)
            yield batch(pa.concat_arrays(keys), *map(list, others))
            held = []
    if held:
        keys, *others = zip(*held)
        yield batch(pa.concat_arrays(keys), *map(list, others))


def lag_sums(df: DataFrame, series: str, order: list[str], value: str, lags: Lags, block_rows: int = BLOCK_ROWS,
             kpss: bool = False, finish: Finish = _sums_batch, fields: list[T.StructField] = SUMS.fields) -> DataFrame:
    """(key, n, sums) of each series, or what ``finish`` makes of them in the same pass (``fields``); ``lags(n)``:
    most lags of values, differences and squares; with ``kpss`` a series of one chunk has as many as its bandwidth takes."""
    blocks = ordered_blocks(as_numbers(df, [value]), series, order, value, block_rows)
    schema = T.StructType([key_field(blocks), *fields])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = []
            for n, low, mean, square, raw in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), batch.column(5)):
                r = np.frombuffer(raw.as_buffer()) - (mean - low)
                rows.append((n, chunk_sums(r, 0, True, square / n, lags(n), kpss and n >= MIN_SERIES)))
            yield finish(batch.column(0), rows)

    def before(n: int) -> int:
        k, l, p = lags(n)
        return max(k, l + 2 + ARCH_MAX_LAGS, p) + 1

    def one_chunk(pieces: list[tuple]) -> tuple[int, list[np.ndarray]]:
        _, _, start, first, n, mean, square, *_ = pieces[0]
        r = np.concatenate([np.frombuffer(raw.as_buffer()) - (mean - low) for *_, low, raw in pieces])
        return n, chunk_sums(r, start - first, first == 0, square / n, lags(n), kpss and MIN_SERIES <= n == len(r))

    def sum_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def units() -> Iterator[tuple]:
            key, now, total = None, None, None
            for k, pieces in _runs(batches, 3):                             # a chunk at a time
                n, sums = one_chunk(pieces)
                if total is not None and k == key and pieces[0][1] == now:
                    total = (n, add_sums([total[1], sums]))
                    continue
                if total is not None:
                    yield key, total, now
                key, now, total = k, pieces[0][1], (n, sums)
            if total is not None:
                yield key, total, now
        return _gathered(units(), _sums_batch)

    def sum_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gathered(((k, (rows[0][3], add_sums([r[4:] for r in rows])), rows[0][2]) for k, rows in _runs(batches, 2)), _sums_batch)

    def sum_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gathered(((k, (rows[0][2], add_sums([r[3:] for r in rows]))) for k, rows in _runs(batches, 1)), finish)

    # a task takes the chunks of a unit in order; short chunks share one, a chunk of BLOCK_ROWS or more has its own
    partial = T.StructType([schema[0], T.StructField("part", T.LongType()), *SUMS.fields])
    pieces = chunks(blocks, before, block_rows).select("key", F.floor(F.col("start") / BLOCK_ROWS).alias("unit"), "start", "at", "total",
                                                       "mean", "square", "low", "values")
    each = pieces.repartition("key", "unit").sortWithinPartitions("key", "unit", "start", "at").mapInArrow(sum_units, partial)
    grouped = each.select("key", F.floor(F.col("part") / TOGETHER).alias("group"), "part", *SUMS.names)
    some = grouped.repartition("key", "group").sortWithinPartitions("key", "group", "part").mapInArrow(sum_groups, partial)
    split = some.repartition("key").sortWithinPartitions("key", "part").mapInArrow(sum_keys, schema)
    return whole_keys(blocks).select("key", "n", "low", "mean", "square", "values").mapInArrow(whole, schema).unionByName(split)


# ---- tests (TST7-TST9) -------------------------------------------------------

def _sample_products(full: np.ndarray, first: np.ndarray, last: np.ndarray, start: int, least: int) -> np.ndarray:
    """G[i, j] = sum over t >= start of v(t - i) v(t - j), i, j up to the lags of
    ``full``, from the products over the whole series less those at its ends.
    ``first``/``last`` hold the values there; ``least`` is the first place that counts."""
    m = len(full)
    g = np.zeros((m, m))
    for d in range(m):
        i = np.arange(m - d)
        # head: u from d + least to start - i - 1; tail: the last i places
        u = np.arange(d + least, start)
        head = np.concatenate(([0.0], np.cumsum(first[u] * first[u - d]))) if len(u) else np.zeros(1)
        upto = np.clip(start - i - d - least, 0, len(head) - 1)
        tail = np.concatenate(([0.0], np.cumsum((last[d:] * last[:len(last) - d])[::-1]))) if d < len(last) else np.zeros(1)
        row = full[d] - head[upto] - tail[np.minimum(i, len(tail) - 1)]
        g[i, i + d] = g[i + d, i] = row
    return g


def _solve(g: np.ndarray, y: int, x: list[int]) -> tuple[np.ndarray, float, np.ndarray]:
    """OLS of variable ``y`` on ``x`` from cross products: (beta, ssr, inverse)."""
    scale = np.sqrt(np.maximum(np.diag(g)[x], 1e-300))
    inverse = np.linalg.pinv(g[np.ix_(x, x)] / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale)
    beta = inverse @ g[x, y]
    return beta, max(float(g[y, y] - beta @ g[x, y]), 0.0), inverse


def adf_products(n: int, lag: int, start: int, s: dict[str, np.ndarray]) -> np.ndarray:
    """Cross products of (dx, dx lagged 1..lag, 1, x one back) over the places from ``start`` on."""
    first, last = s["first"], s["last"]
    d_first, d_last = np.diff(first, prepend=first[:1]), np.diff(last)
    g = np.zeros((lag + 3, lag + 3))
    g[:lag + 1, :lag + 1] = _sample_products(s["dc"][:lag + 1], d_first, d_last, start, 1)
    i = np.arange(lag + 1)
    m = n - start
    sums = last[-1 - i] - first[start - 1 - i]
    head = np.array([first[j:start - 1] @ d_first[1:start - j] if start - 1 > j else 0.0 for j in i])
    cross = s["xc"][:lag + 1] - head
    x_sum = s["run"][1] - first[:start - 1].sum() - last[-1]
    x_square = s["ac"][0] - first[:start - 1] @ first[:start - 1] - last[-1] ** 2
    one, x = lag + 1, lag + 2
    g[one, :lag + 1] = g[:lag + 1, one] = sums
    g[x, :lag + 1] = g[:lag + 1, x] = cross
    g[one, one], g[x, x], g[one, x], g[x, one] = m, x_square, x_sum, x_sum
    return g


def _adf(n: int, max_lag: int, s: dict[str, np.ndarray]) -> dict:
    """ADF with a constant; AIC over the lags on the common sample, then the own sample."""
    most, first = min(adf_max_lag(n), max_lag), s["first"]
    if n - most - 1 <= 0:
        return {}
    m = n - most - 1
    g = adf_products(n, most, most + 1, s)
    # one factorisation gives the residual sum of squares of every number of lags
    order = [most + 1, most + 2, *range(1, most + 1), 0]
    scale = np.sqrt(np.maximum(np.diag(g)[order], 1e-300))
    left = g[np.ix_(order, order)] / np.outer(scale, scale)
    size = len(order)
    ssr = np.zeros(size)
    for c in range(size - 1):                                               # pivots in order, aliased ones skipped
        if left[c, c] > 1e-13:
            left[c + 1:, c + 1:] -= np.outer(left[c + 1:, c], left[c, c + 1:]) / left[c, c]
        ssr[c + 1] = left[-1, -1] * scale[-1] ** 2
    best, lag = np.inf, None
    for p in range(most + 1):
        if ssr[p + 2] > 0:
            aic = m * (math.log(2 * math.pi) + math.log(ssr[p + 2] / m) + 1) + 2 * (p + 2)
            if aic < best - 1e-12:
                best, lag = aic, p
    if lag is None:
        return {}
    g = adf_products(n, lag, lag + 1, s)
    m = n - lag - 1
    beta, rest, inverse = _solve(g, 0, [lag + 2, *range(1, lag + 1), lag + 1])
    dof = m - lag - 2
    if dof <= 0 or rest <= 0 or inverse[0, 0] <= 0:
        return {}
    stat = float(beta[0] / math.sqrt(rest / dof * inverse[0, 0]))
    if stat > ADF_TAU_MAX:
        p = 1.0
    elif stat < ADF_TAU_MIN:
        p = 0.0
    else:
        p = S.norm_cdf(sum(c * stat ** i for i, c in enumerate(ADF_SMALLP if stat <= ADF_TAU_STAR else ADF_LARGEP)))
    crit = {f"adf_crit_{k[:-1]}": sum(c / m ** i for i, c in enumerate(v)) for k, v in ADF_CRIT.items()}
    return {"adf_stat": stat, "adf_p": float(p), "adf_lag": lag, "adf_nobs": m, **crit}


def _kpss(n: int, s: dict[str, np.ndarray]) -> dict:
    """KPSS (level) with the automatic bandwidth. A series of several chunks has none
    if the rule, dividing by a long-run variance of almost zero, runs off to more lags than were summed."""
    ac = s["ac"]
    lags = kpss_lags(n, ac)
    if lags is None or lags >= len(ac):
        return {}
    i = np.arange(1, lags + 1)
    long_run = (ac[0] + 2 * (ac[i] * (1 - i / (lags + 1.0))).sum()) / n
    if not long_run:
        return {}
    stat = float(s["run"][3] / (n * n) / long_run)
    return {"kpss_stat": stat, "kpss_p": float(np.interp(stat, KPSS_CRIT, KPSS_P)), "kpss_lags": lags}


def _arch(n: int, most: int, s: dict[str, np.ndarray]) -> dict:
    """Engle's LM and F test on the squares of the demeaned values."""
    p = min(most, n // 5)
    if p < 1 or not s["ac"][0]:
        return {}
    mean = s["ac"][0] / n
    first, last = s["first"] ** 2 - mean, s["last"] ** 2 - mean
    g = np.zeros((p + 2, p + 2))
    g[:p + 1, :p + 1] = _sample_products(s["bc"][:p + 1], first, last, p, 0)
    sums = [s["run"][4] - first[:p - i].sum() - (last[-i:].sum() if i else 0.0) for i in range(p + 1)]
    m = n - p
    g[p + 1, :p + 1] = g[:p + 1, p + 1] = sums
    g[p + 1, p + 1] = m
    _, ssr, _ = _solve(g, 0, [p + 1, *range(1, p + 1)])
    total = g[0, 0] - sums[0] ** 2 / m
    if total <= 0:
        return {}
    r2 = 1 - ssr / total
    dof = m - p - 1
    f = (r2 / p) / ((1 - r2) / dof) if dof > 0 and r2 < 1 else None
    return {"arch_lm": m * r2, "arch_lm_p": float(S.chi2_sf(m * r2, p)), "arch_f": f,
            "arch_f_p": None if f is None else float(S.f_sf(f, p, dof)), "arch_lags": p}


TEST_SCHEMA = ("n long, adf_stat double, adf_p double, adf_lag int, adf_nobs long, "
               "adf_crit_1 double, adf_crit_5 double, adf_crit_10 double, kpss_stat double, kpss_p double, "
               "kpss_lags int, arch_lm double, arch_lm_p double, arch_f double, arch_f_p double, arch_lags int")


def finish(n: int, sums: list, max_lag: int, arch_lags: int) -> dict:
    """All tests of a series from its sums."""
    if n < MIN_SERIES:
        return {}
    s = {c: np.asarray(x, float) for c, x in zip(SUMS.names[1:], sums)}
    return _adf(n, max_lag, s) | _kpss(n, s) | _arch(n, arch_lags, s)


def series_tests(df: DataFrame, series: str, order: list[str], value: str, max_lag: int | None = None,
                 arch_lags: int = ARCH_MAX_LAGS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """ADF (constant, AIC lag choice, MacKinnon p), KPSS (level, automatic
    bandwidth, p interpolated and clamped to [0.01, 0.10]) and Engle's ARCH
    LM / F test on the demeaned series, one row per series (TST7-TST9).
    Series shorter than 10 values get null statistics (TST11); a constant one too.
    Each series has its own full lag search and bandwidth; ``max_lag`` and
    ``arch_lags`` (up to 10) set the most lags by hand. Text is read as numbers;
    what is no number, null or NaN has no place in a series."""
    top = (1 << 30) if max_lag is None else max_lag

    def lags(n: int) -> tuple[int, int, int]:
        return kpss_most_lags(n), min(adf_max_lag(n), top), ARCH_MAX_LAGS

    fields = T.StructType.fromDDL(TEST_SCHEMA).fields
    types = [pa.int32() if f.dataType == T.IntegerType() else pa.int64() if f.dataType == T.LongType() else pa.float64() for f in fields[1:]]

    def tests(keys: pa.Array, rows: list[tuple[int, list]]) -> pa.RecordBatch:
        found = [finish(n, s, top, arch_lags) for n, s in rows]
        return pa.RecordBatch.from_arrays(
            [keys, pa.array([n for n, _ in rows], pa.int64()), *(pa.array([r.get(f.name) for r in found], t) for f, t in zip(fields[1:], types))],
            names=["key", *(f.name for f in fields)])

    return lag_sums(df, series, order, value, lags, block_rows, True, tests, fields).withColumnRenamed("key", "series")


def _autocorrelations(df: DataFrame, series: str, order: list[str], value: str, nlags: int, block_rows: int) -> DataFrame:
    """(series, rho): autocorrelations of lags 0 to ``nlags``."""
    sums = lag_sums(df, series, order, value, lambda n: (nlags, 0, 0), block_rows)
    return sums.select(F.col("key").alias(series), F.transform("ac", lambda c: F.try_divide(c, F.col("ac")[0])).alias("rho"))


def autocorrelation(df: DataFrame, series: str, order: list[str], value: str, nlags: int = 10,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """ACF per series and lag, lags 1..nlags (WIN7): sum r_t r_{t-k} / sum r_t^2
    with r the series-demeaned values; null for a constant series."""
    rho = _autocorrelations(df, series, order, value, nlags, block_rows)
    return rho.select(series, F.posexplode(F.slice("rho", 2, nlags)).alias("lag", "acf")) \
        .select(series, (F.col("lag") + 1).alias("lag"), "acf")


def running_squares(df: DataFrame, series: str, order: list[str], value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(series, n, total, cum_sum, cum_square): sum of the demeaned values, and of
    their running sum and its squares (WIN5)."""
    sums = lag_sums(df, series, order, value, lambda n: (0, 0, 0), block_rows)
    return sums.select(F.col("key").alias(series), "n", F.col("run")[1].alias("total"), F.col("run")[2].alias("cum_sum"),
                       F.col("run")[3].alias("cum_square"))


def lag_products(df: DataFrame, series: str, order: list[str], value: str, nlags: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(series, lag, levels, differences, mixed): sums of lag products (WIN4), of the
    demeaned values, of their differences, and of the value before with the lagged difference."""
    sums = lag_sums(df, series, order, value, lambda n: (nlags, nlags, 0), block_rows)
    return sums.select(F.col("key").alias(series), F.posexplode(F.arrays_zip("ac", "dc", "xc")).alias("lag", "s")) \
        .select(series, "lag", F.col("s.ac").alias("levels"), F.col("s.dc").alias("differences"), F.col("s.xc").alias("mixed"))


def series_points(df: DataFrame, series: str, order: list[str], value: str, bucket: int | None = None,
                  chunk_width: float | str | Rows | None = "auto") -> DataFrame:
    """Series in row order for plotting (PLT10); with ``bucket`` the points
    are averaged over consecutive blocks of that many rows. A series too long
    for a task is numbered in chunks (``segments``)."""
    chunk_width = resolve_width(df, series, chunk_width)
    if chunk_width:
        numbered = chunked_row_number(df, series, order, chunk_width, name="__rn")
    else:
        numbered = df.withColumn("__rn", F.row_number().over(Window.partitionBy(series).orderBy(*order)))
    pts = numbered.select(series, (F.col("__rn") - 1).alias("pos"), F.col(value).cast("double").alias("value"))
    if not bucket:
        return pts
    return pts.groupBy(series, F.floor(F.col("pos") / bucket).alias("block")).agg(
        F.min("pos").alias("first_pos"), F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


def partial_autocorrelations(rho: Column, nlags: int) -> Column:
    """Durbin-Levinson as a fold over the autocorrelations (element 0 is lag 0): an
    array of (lag, pacf). The state holds the coefficients of the last order."""
    def step(state: Column, k: Column) -> Column:
        phi = state["phi"]
        number = k.cast("double") * 0                                       # a typed zero for the sums
        dot = lambda xs, ys: F.aggregate(F.zip_with(xs, ys, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        past = F.slice(rho, 2, F.greatest(k - 1, F.lit(0)))
        new = F.try_divide(F.get(rho, k) - dot(phi, F.reverse(past)), 1.0 - dot(phi, past)) + number
        kept = F.zip_with(phi, F.reverse(phi), lambda a, b: a - new * b)
        return F.struct(F.concat(kept, F.array(new)).alias("phi"), F.concat(state["out"], F.array(new)).alias("out"))

    empty = F.array().cast("array<double>")
    return F.aggregate(F.sequence(F.lit(1), F.lit(nlags)), F.struct(empty.alias("phi"), empty.alias("out")), step,
                       lambda state: state["out"])


def acf_pacf(df: DataFrame, series: str, order: list[str], value: str, nlags: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Autocorrelations (biased autocovariance / variance) and partial
    autocorrelations by Durbin-Levinson, lags 1..nlags, per series (WIN7). Both
    are null for a constant series; a partial one is null from where the recursion divides by zero."""
    rho = _autocorrelations(df, series, order, value, nlags, block_rows)
    both = rho.select(F.col(series).alias("series"), F.slice("rho", 2, nlags).alias("acf"),
                      partial_autocorrelations(F.col("rho"), nlags).alias("pacf"))
    return both.select("series", F.posexplode(F.arrays_zip("acf", "pacf")).alias("lag", "a")) \
        .select("series", (F.col("lag") + 1).alias("lag"), "a.acf", "a.pacf")
