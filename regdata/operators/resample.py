"""Bootstrap intervals that move neither rows times replicates nor tables of laws.

Resampling ``n`` rows with replacement is only ever used through a statistic, and for
the statistics of the reports the law of that statistic is known:

* the j-th smallest of n draws is the value at a Beta-distributed place of the sorted
  group, so a median needs one or two ranks per replicate;
* the share of hits among n draws is binomial, so it needs two counts per group;
* a weighted mean has no such form. ``draws`` splits the n draws of a replicate over pieces of the
  group, level by level, by the law of so many draws, until pieces are small; then each piece draws its
  own rows where they are. A block of small pieces makes the last split beside its rows too. ``poisson`` weights every row by a Poisson(1) count. Both hand on partial
  sums only.

Random numbers are hashes of (seed, group, replicate and so on), so runs agree with each other: a
digest gives two keys of 31 bits, each scrambles a counter, and both together are 62 bits. They serve
any number of rows. A task makes the numbers of all replicates of a group, piece or row at once.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regdata.functions.clean import _c
from regdata.functions.nulls import known_keys
from regdata.operators.ordered import positions
from regdata.operators.quantile import value_ranks
from regdata.operators.skew import spread_out
from regdata.session import materialise, share_code

MASK = 2147483647  # 31 bits keep every product inside a long
MIX = (73244475, 739982445)
TRIES = 1024  # numbers that one replicate of a group may use
PIECE, FAN = 4096, 1024  # rows of a piece; pieces that one level of splitting tells apart
BLOCK = 1 << 16  # rows up to which all pieces of a last split are drawn in one place
CHUNK = 1 << 20  # draws that are made at once
LAW_SD = 12  # a binomial law is tabled this many standard deviations around its mean, plus as many counts


def _told(seed: int, *parts: Column) -> Column:
    """The seed and columns as one text."""
    return F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in parts])


def draw_keys(seed: int, by: list[Column], *parts: Column) -> tuple[Column, Column]:
    """Two numbers below 2**31 from a digest of the seed and of columns."""
    text = _told(seed, *by, *parts)
    half = lambda at: F.conv(F.substring(F.md5(text), at, 8), 16, 10).cast("long").bitwiseAND(F.lit(MASK).cast("long"))
    return half(1), half(9)


def digest_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`draw_keys` of texts that are at hand, as unsigned 32-bit numbers."""
    found = b"".join([hashlib.md5(t.encode(), usedforsecurity=False).digest()[:8] for t in texts])
    both = np.frombuffer(found, dtype=">u4").astype(np.uint32).reshape(-1, 2) & np.uint32(MASK)
    return both[:, 0], both[:, 1]


def _told_by(df: DataFrame, by: list[str]) -> list[Column]:
    """Columns that tell a group's draws from others'; fractions stay out, as engines write them differently."""
    return [F.col(c) for c in by if not isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]


def scrambled(h: np.ndarray) -> np.ndarray:
    """Numbers below 2**31, scrambled one to one."""
    for shift, factor in zip((16, 15), MIX):
        h = ((h ^ (h >> shift)) * factor) & MASK
    return h ^ (h >> 14)


def uniform(one, two, counter: np.ndarray) -> np.ndarray:
    """Numbers inside (0, 1) of 62 bits, as far as a double holds them.

    Keys and counters of 32 unsigned bits give the same numbers in half the time.
    """
    wide = scrambled(counter ^ one).astype(np.int64, copy=False) << 31 | scrambled(counter ^ two)
    return np.minimum((wide.astype(np.float64) + 0.5) / 2.0**62, 1 - 2.0**-53)


def binomial(n: int, k: int, u: np.ndarray) -> np.ndarray:
    """Hits among ``n`` draws of which a share k / n hits, by the tabled law.

    The tails left out weigh less than 1e-30, so the table has some 24 sqrt(n) / 2 numbers.
    """
    if k in (0, n):
        return np.full(len(u), k, dtype=np.int64)
    reach = math.sqrt(k * (1 - k / n)) * LAW_SD + LAW_SD
    low, high = max(math.floor(k - reach), 0), min(math.ceil(k + reach), n)
    j = np.arange(low + 1, high + 1, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - j + 1) / j) + math.log(k / (n - k)))])
    mass = np.exp(logs - logs.max())
    return np.minimum(low + np.searchsorted(np.cumsum(mass) / mass.sum(), u, side="left"), n)


def beta(a: np.ndarray, b: np.ndarray, one: int, two: int, first: np.ndarray) -> np.ndarray:
    """Beta(a, b) draws by rejection; draw i uses the numbers after ``first[i]``.

    Both parameters are at least 2 here, except that b = 1 is drawn directly. More than two
    thirds of the proposals are accepted.
    """
    p, q = np.minimum(a, b).astype(np.float64), np.maximum(a, b).astype(np.float64)
    total, out, todo, tried = p + q, np.zeros(len(a)), np.arange(len(a)), 0
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.sqrt((total - 2) / (p * q * 2 - total))
        while len(todo):
            u1, u2 = uniform(one, two, first[todo] + 2 * tried), uniform(one, two, first[todo] + 2 * tried + 1)
            s, t, x, y = slope[todo], total[todo], p[todo], q[todo]
            v = np.log(u1 / (1 - u1)) * s
            w = x * np.exp(v)
            fits = (x + 1 / s) * v - math.log(4) + t * np.log(t / (y + w)) >= np.log(u1 * u1 * u2)
            place = np.where(a[todo] <= b[todo], w / (y + w), y / (y + w))
            plain = b[todo] == 1
            out[todo] = np.where(plain, u1 ** (1 / a[todo]), place)
            todo, tried = todo[~(fits | plain)], tried + 1
    return out


def _each_group(groups: DataFrame, by: list[str], schema: str, make) -> DataFrame:
    """``make`` turns the row of a group into columns of results; ``by`` goes in front of them."""
    share_code(groups.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                columns = [np.ascontiguousarray(c) for c in make(row)]
                own = batch.select(by).take(pa.array(np.full(len(columns[0]), i)))
                yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(c) for c in columns]], [*by, *[n.split()[0] for n in schema.split(", ")]])

    fields = [groups.schema[c] for c in by]
    return spread_out(groups, *by).mapInArrow(run, T.StructType([*fields, *T.StructType.fromDDL(schema).fields]))


def median_replicates(df: DataFrame, by: list[str], col: str, reps: int, seed: int, drop_null_first: bool = True) -> DataFrame:
    """Medians of ``reps`` resamples of every group: columns ``by``, ``rep``, ``stat``.

    ``drop_null_first=False`` resamples missing rows too and ignores them in the median,
    so the number of values in a resample is binomial. A resample without values has no row.
    """
    ranks = value_ranks(df, by, col)
    rows = known_keys(df, *by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).alias("n"),
    )
    one, two = draw_keys(seed, _told_by(df, by))
    sizes = rows.where("n > 0").withColumn("_one", one).withColumn("_two", two)

    def make(row: dict) -> list[np.ndarray]:
        n, rep = row["n"], np.arange(reps, dtype=np.int64)
        number = lambda at, r: uniform(row["_one"], row["_two"], r * TRIES + at)
        m = np.full(reps, n) if drop_null_first else binomial(row["_all"], n, number(0, rep))
        rep, m = rep[m > 0], m[m > 0]
        half = m // 2
        # upper middle value: the (half + 1)-th smallest of m draws
        upper = beta(half + 1, m - half, row["_one"], row["_two"], rep * TRIES + 2)
        with np.errstate(divide="ignore"):
            lower = np.where(m % 2 == 1, upper, upper * number(1, rep) ** (1 / half))
        rank = np.minimum(np.floor(np.concatenate([lower, upper]) * n), n - 1).astype(np.int64)
        return [np.tile(rep, 2).astype(np.int32), np.full(len(rank), n), rank]

    draws = _each_group(sizes, by, "rep int, n long, _rank long", make)
    values = _values_at(ranks, draws, by)
    return values.groupBy(*by, "rep").agg(F.avg("value").alias("stat"))


def _values_at(ranks: DataFrame, draws: DataFrame, by: list[str]) -> DataFrame:
    """Attach the value that covers each drawn rank.

    Drawn ranks lie within some sqrt(n) of the middle. Ranges outside that window are
    dropped, the rest is cut into buckets of about sqrt(n) / 32 ranks, and the lookup is
    an equi-join on the bucket.
    """
    width = F.greatest(F.floor(F.sqrt(F.col("n")) / 32), F.lit(1))
    window = draws.groupBy(*by).agg(F.min("_rank").alias("_min"), F.max("_rank").alias("_max"))
    if by:
        near = ranks.join(window, by)
    else:
        near = ranks.withColumn("_min", draws.agg(F.min("_rank")).scalar()).withColumn("_max", draws.agg(F.max("_rank")).scalar())
    near = near.where((F.col("end") > F.col("_min")) & (F.col("start") <= F.col("_max")))
    first = F.floor(F.greatest("start", "_min") / width)
    last = F.floor(F.least(F.col("end") - 1, F.col("_max")) / width)
    near = near.select(*by, "value", "start", "end", F.explode(F.sequence(first, last)).alias("_bucket"))
    drawn = draws.withColumn("_bucket", F.floor(F.col("_rank") / width)).drop("n")
    joined = drawn.join(near, [*by, "_bucket"])
    return joined.where((F.col("start") <= F.col("_rank")) & (F.col("_rank") < F.col("end")))


def share_replicates(df: DataFrame, by: list[str], hit: Column, reps: int, seed: int) -> DataFrame:
    """Share of hits in ``reps`` resamples of every group: columns ``by``, ``rep``, ``stat``."""
    counts = known_keys(df, *by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(hit, F.lit(False))).alias("k")
    )
    one, two = draw_keys(seed, _told_by(df, by))

    def make(row: dict) -> list[np.ndarray]:
        rep = np.arange(reps, dtype=np.int64)
        hits = binomial(row["n"], row["k"], uniform(row["_one"], row["_two"], rep * TRIES))
        return [rep.astype(np.int32), hits / row["n"]]

    groups = counts.where("n > 0").withColumn("_one", one).withColumn("_two", two)
    return _each_group(groups, by, "rep int, stat double", make)


def summarise(replicates: DataFrame, by: list[str], probs: list[float], names: list[str], scale: float = 1.0) -> DataFrame:
    """Percentiles over replicates; a group has as many rows as replicates were asked for."""
    stat = F.col("stat") * F.lit(scale)
    return replicates.groupBy(*by).agg(*[F.percentile(stat, F.lit(p)).alias(n) for p, n in zip(probs, names)])


def bootstrap_ci(
    df: DataFrame, by: list[str], col: str | Column, stat: str = "median", reps: int = 1000,
    probs: list[float] = [0.05, 0.5, 0.95], names: list[str] | None = None, seed: int = 0,
    drop_null_first: bool = False, scale: float = 1.0,
) -> DataFrame:
    """Percentile bootstrap per group of a ``median`` or of a ``share`` of true rows."""
    names = names or [f"p{round(p * 100):02d}" for p in probs]
    if stat == "median":
        replicates = median_replicates(df, by, col, reps, seed, drop_null_first)
    elif stat == "share":
        replicates = share_replicates(df, by, _c(col), reps, seed)
    else:
        raise ValueError(stat)
    return summarise(replicates, by, probs, names, scale)


POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])  # counts beyond 20 are rarer than one in 2**62


def poisson_counts(u: np.ndarray) -> np.ndarray:
    """Poisson(1) counts from numbers inside (0, 1), by the cumulative law."""
    return np.searchsorted(POISSON, u, side="right")


def _poisson_sums(rows: DataFrame, by: list[str], key: str, reps: int, seed: int) -> DataFrame:
    """Partial sums per task, group and replicate of rows weighted by Poisson counts."""
    one, two = draw_keys(seed, [], F.col(key))
    even = spread_out(rows.select(*by, "_x", "_w", one.alias("_one"), two.alias("_two")))
    share_code(rows.sparkSession)
    fields = [rows.schema[c] for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, held = np.arange(reps, dtype=np.int64), {}

        def handed() -> pa.RecordBatch:
            names = pa.Table.from_pylist([dict(zip(by, g)) for g in held], schema=kinds) if by else None
            at = pa.array(np.repeat(np.arange(len(held)), reps))
            sums = [np.concatenate([s[i] for s in held.values()]) for i in (0, 1)]
            own = [names.column(c).combine_chunks().take(at) for c in by]
            return pa.RecordBatch.from_arrays([*own, pa.array(np.tile(rep, len(held)).astype(np.int32)), *map(pa.array, sums)], [*by, "rep", "_wx", "_ww"])

        for batch in batches:
            kinds = pa.schema([batch.schema.field(c) for c in by])
            groups = list(zip(*[batch.column(c).to_pylist() for c in by])) if by else [()] * batch.num_rows
            x, w, k1, k2 = [batch.column(c).to_numpy() for c in ("_x", "_w", "_one", "_two")]
            order = sorted(range(len(groups)), key=lambda i: groups[i])
            for start in range(0, len(order), 256):
                part = np.array(order[start : start + 256])
                counts = poisson_counts(uniform(k1[part, None], k2[part, None], rep[None, :]))
                names = [groups[i] for i in part]
                cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
                for a, b in zip(cuts, cuts[1:]):
                    own = part[a:b]
                    wx, ww = (w[own] * x[own]) @ counts[a:b], w[own] @ counts[a:b]
                    before = held.get(names[a])
                    held[names[a]] = (wx, ww) if before is None else (before[0] + wx, before[1] + ww)
                if len(held) > 500:
                    yield handed()
                    held.clear()
        if held:
            yield handed()

    return even.mapInArrow(run, T.StructType([*fields, *T.StructType.fromDDL("rep int, _wx double, _ww double").fields]))


def _places(one: np.ndarray, two: np.ndarray, counter: np.ndarray, n) -> np.ndarray:
    """Places among ``n`` that the numbers fall on."""
    return np.minimum((uniform(one, two, counter) * n).astype(np.int64), n - 1)


def split_draws(sizes: DataFrame, by: list[str], reps: int, seed: int, piece: int = PIECE, fan: int = FAN, until: int = 0) -> DataFrame:
    """How often each replicate draws from each piece of ``piece`` rows: ``by``, ``_n``, ``rep``, ``_piece``, ``_m``.

    ``sizes`` has the rows ``_n`` of each group. The draws of a replicate start in one node that spans the
    group and are dealt to its ``fan`` parts, by rows, and on to parts of parts. A level
    costs one number per draw, made where it is counted; what moves is a count per replicate and
    part, of which there are fewer than rows times replicates by the size of a piece. Splitting stops ``until``
    levels above pieces.
    """
    longest, levels = sizes.agg(F.max("_n")).first()[0] or 0, 0
    while piece * fan**levels < longest:
        levels += 1
    told = _told_by(sizes, by)
    nodes = sizes.select(*by, "_n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"), F.lit(0).cast("long").alias("_piece"), F.col("_n").alias("_m"))
    share_code(sizes.sparkSession)
    for level in range(levels, until, -1):
        span, part = piece * fan**level, piece * fan ** (level - 1)
        chunks = nodes.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_m - 1) div {CHUNK}"))))
        one, two = draw_keys(seed, told, F.col("rep"), F.lit(level), F.col("_piece"), F.col("_chunk"))
        chunks = chunks.select(
            *by, "_n", "rep", "_piece", one.alias("_one"), two.alias("_two"),
            F.least(F.lit(CHUNK), F.col("_m") - F.col("_chunk") * CHUNK).alias("_m"), F.least(F.lit(span), F.col("_n") - F.col("_piece") * span).alias("_s"),
        )

        def run(batches: Iterator[pa.RecordBatch], part: int = part) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                node, one, two, m, s = [batch.column(c).to_numpy() for c in ("_piece", "_one", "_two", "_m", "_s")]
                rows, children, counts, held = [], [], [], 0
                for i in range(batch.num_rows):
                    if s[i] <= part:
                        found = np.array([m[i]])
                    else:
                        found = np.bincount(_places(one[i : i + 1].astype(np.uint32), two[i : i + 1].astype(np.uint32), np.arange(m[i], dtype=np.uint32), s[i]) // part)
                    own = np.flatnonzero(found)
                    rows.append(np.full(len(own), i))
                    children.append(node[i] * fan + own)
                    counts.append(found[own])
                    held += len(own)
                    if held > 100_000 or i == batch.num_rows - 1:
                        known = batch.select([*by, "_n", "rep"]).take(pa.array(np.concatenate(rows)))
                        yield pa.RecordBatch.from_arrays(
                            [*known.columns, pa.array(np.concatenate(children).astype(np.int64)), pa.array(np.concatenate(counts).astype(np.int64))],
                            [*by, "_n", "rep", "_piece", "_m"],
                        )
                        rows, children, counts, held = [], [], [], 0

        dealt = spread_out(chunks).mapInArrow(run, nodes.schema)
        nodes = dealt.groupBy(*by, "_n", "rep", "_piece").agg(F.sum("_m").alias("_m"))
    return nodes


def _drawn_sums(rows: DataFrame, by: list[str], key: str, reps: int, seed: int, piece: int, fan: int = FAN) -> DataFrame:
    """Partial sums per block and replicate of n rows drawn with replacement.

    A block is a piece, or all pieces of a last split if these have few rows. Then a replicate hands a block one
    count instead of one for each of its pieces, and the block splits the draws by the same numbers.
    """
    until, most = 1 if piece * fan <= BLOCK else 0, CHUNK
    block = piece * fan**until
    numbered = materialise(positions(rows, by, [key], "_i").withColumn("_piece", F.expr(f"_i div {block}")))
    sizes = materialise(numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))).where("_n > 0")
    counts = split_draws(sizes, by, reps, seed, piece, fan, until)
    counts = counts.select(*by, "_piece", "rep", "_m", _told(seed, *_told_by(sizes, by), F.col("rep")).alias("_told"))
    schema = T.StructType([*[rows.schema[c] for c in by], *T.StructType.fromDDL("rep int, _wx double, _ww double").fields])

    def dealt(told: str, node: int, m: int, n: int) -> np.ndarray:
        """How many of a block's draws each of its pieces gets."""
        if not until or n <= piece:
            return np.array([m])
        found = np.zeros(-(-n // piece), dtype=np.int64)
        for chunk, start in enumerate(range(0, m, most)):
            one, two = digest_keys([f"{told}|1|{node}|{chunk}"])
            found += np.bincount(_places(one, two, np.arange(min(most, m - start), dtype=np.uint32), n) // piece, minlength=len(found))
        return found

    def draw(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(left.column("_i").to_numpy())
        w = left.column("_w").to_numpy()[order]
        wx = w * left.column("_x").to_numpy()[order]
        sums = np.zeros((2, right.num_rows))
        for r, (told, node, m) in enumerate(zip(*[right.column(c).to_pylist() for c in ("_told", "_piece", "_m")])):
            found = dealt(told, node, m, len(w))
            own = np.flatnonzero(found)
            often = found[own]
            one, two = digest_keys([f"{told}|0|{p}|0" for p in (node * fan**until + own).tolist()])
            counter = np.arange(m) - np.repeat(np.cumsum(often) - often, often)
            first = own * piece
            picked = np.repeat(first, often) + _places(
                np.repeat(one, often), np.repeat(two, often), counter.astype(np.uint32), np.repeat(np.minimum(piece, len(w) - first), often)
            )
            sums[:, r] = wx[picked].sum(), w[picked].sum()
        columns = [*[right.column(c) for c in by], right.column("rep"), pa.array(sums[0]), pa.array(sums[1])]
        return pa.Table.from_arrays(columns, [*by, "rep", "_wx", "_ww"])

    left, right = [spread_out(t, *by, "_piece").groupBy(*by, "_piece") for t in (numbered, counts)]
    return left.cogroup(right).applyInArrow(draw, schema)


def wmean_replicates(
    df: DataFrame, by: list[str], x: str, weight: str, key: str, reps: int, seed: int, method: str = "draws", piece: int = PIECE
) -> DataFrame:
    """Weighted means of ``reps`` resamples of every group: ``by``, ``rep``, ``stat``.

    ``draws`` takes n rows with replacement, see :func:`split_draws`; ``poisson`` weights each row by a
    Poisson(1) count instead, which needs no places of rows. Either makes one number per row and
    replicate in the task that holds the row and hands on sums. ``key`` tells rows apart.
    """
    rows = known_keys(df, *by, x, weight).select(*by, key, F.col(x).cast("double").alias("_x"), F.col(weight).cast("double").alias("_w"))
    sums = _poisson_sums(rows, by, key, reps, seed) if method == "poisson" else _drawn_sums(rows, by, key, reps, seed, piece)
    totals = sums.groupBy(*by, "rep").agg(F.sum("_wx").alias("_wx"), F.sum("_ww").alias("_ww"))
    return totals.select(*by, "rep", F.try_divide("_wx", "_ww").alias("stat"))


def wmean_bootstrap(
    df: DataFrame, by: list[str], x: str, weight: str, key: str, reps: int = 1000, seed: int = 0,
    method: str = "draws", band: float = 1.65, piece: int = PIECE,
) -> DataFrame:
    """Mean, sd and band (mean +/- ``band`` sd) of the resampled weighted mean per group."""
    replicates = wmean_replicates(df, by, x, weight, key, reps, seed, method, piece)
    out = replicates.groupBy(*by).agg(F.avg("stat").alias("mean"), F.stddev_pop("stat").alias("sd"))
    return out.withColumn("low", F.col("mean") - F.col("sd") * band).withColumn("high", F.col("mean") + F.col("sd") * band)
