"""Quality rules: fixed base rules, then robust multivariate outliers.

Native DataFrame expressions only.  Every text becomes a vector of transformed
statistics; a line or passage that is said twice is left out of the repeats, so
that only what is repeated beyond it counts.  For each language and source the
minimum-covariance-determinant estimate is found: the mean and covariance of that
half of the vectors whose covariance has the least determinant.

1. Three deterministic starts per group, all at the medians, with the scales of
   the median deviations: without correlations, with those of the hyperbolic
   tangents, and with those of the spatial signs of the standardised vectors.
2. Two concentration steps from each start; the start of least determinant goes on.
3. Concentration steps until no group's determinant falls any more.
4. The covariance of the half is multiplied by the consistency factor of a normal
   law, and the estimate is made anew from all vectors within its 0.975 quantile.

A document is rejected if its squared Mahalanobis distance exceeds the chi-square
quantile ``CUT_OFF``.  Junk of up to nearly half of a group does not move the
estimate; in a group of more junk than that the junk is the measure.  Many groups
have no spread at all in a statistic (no text of the half has a symbol), so each
covariance is regularised: ``FLOOR`` squared is added to its diagonal, the target
matrix of the regularised estimate.

A concentration step needs, for each group, the moments of the nearest half of
its vectors.  Distances are put on a fixed logarithmic grid; counts and moments
are summed for each (group, cell), which pre-aggregates before the shuffle
whatever share of rows a group has, and a window over the cells of a group (at
most ``CELLS``) takes whole cells up to the half, and of the cell in which the
half ends the share that is missing.  Vectors are integers (``SCALE`` steps a
unit) and moments are exact decimals, so results do not depend on the order of
rows or the number of partitions.

Groups below ``LEAST_GROUP`` rows that pass the base rules take the estimate of
their language, and languages below it that of the whole table; estimates that
no group takes are not made.

Special cases: a null text has no words and fails the base rules; a null language
or source is a group of its own; equal rows are judged alike; with an empty table
or without any spread nothing is rejected beyond the base rules and the floors.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored

#: Fixed by the contract.
WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
REPEAT_WINDOW = 8

STATISTICS = ("mean_word", "symbols", "dup_lines", "repeats")
_N = len(STATISTICS)


def chi_square(x: float, freedom: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2))


def chi_square_quantile(q: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < q else (low, middle)
    return (low + high) / 2


def consistency(share: float) -> float:
    """What makes the covariance of the nearest ``share`` of a normal law that of the whole."""
    return share / chi_square(chi_square_quantile(share, _N), _N + 2)


#: Share of a group's vectors whose covariance determinant is minimised.
MAJORITY = 0.5
#: Steps of SCALE in a cell on which medians are taken, and what makes a median deviation a standard one.
START_CELL, DEVIATION = 16, 1.4826
#: Steps from every start, and the bound on those that follow; they end once no log-determinant falls by SETTLED.
FIRST_STEPS, MOST_STEPS, SETTLED = 2, 30, 1e-4
#: Cells of the logarithmic grid of squared distances: CELLS_PER_UNIT for each unit of log2(1 + d2).
CELLS, CELLS_PER_UNIT = 512, 16
SCALE = 1024
LEAST_GROUP = 200
#: The vectors of the final estimate, and the cut-off on the squared distance.
INNER = chi_square_quantile(0.975, _N)
CUT_OFF = chi_square_quantile(0.999, _N)
#: Factors of the shares of symbols, repeated lines and repeated words, and of the logarithm of the mean word length.
SYMBOL_FACTOR, LINE_FACTOR, REPEAT_FACTOR, LENGTH_FACTOR = 20.0, 8.0, 20.0, 4.0
#: Least standard deviation of each statistic.  What a text may show in a group that has no
#: spread at all: by this choice 12 symbols or 12 repeated words in 100, 30 repeated lines in
#: 100, or words 1.36 times as long as usual lie at the cut-off.
FLOOR = math.log1p(SYMBOL_FACTOR * 0.12) / math.sqrt(CUT_OFF)
_CELL = "cell"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base statistics of every whole text, and ``version``, which tells texts of one id apart."""
    base = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.coalesce("text", F.lit("")).alias("_text")).withColumn("_words", words_of(F.col("_text")))
    # windows of eight words, as hashes of the words' hashes; an array per row, never rows per window
    hashed = F.transform("_words", lambda w: F.xxhash64(w))
    base = base.withColumn("_h", hashed).withColumn("n_words", F.size("_words").cast("long"))
    window = F.expr("if(n_words < 8, cast(array() as array<bigint>), transform(sequence(0, cast(n_words as int) - 8), i -> xxhash64(_h[i], _h[i+1], _h[i+2], _h[i+3], _h[i+4], _h[i+5], _h[i+6], _h[i+7])))")
    base = base.withColumn("_w", window).withColumn("_twice", F.size(F.array_distinct("_w")) < F.size("_w"))
    # only texts with a repeated window sort theirs; equal neighbours are repeats, and their cover is counted
    ordered = F.expr("sort_array(transform(_w, (x, i) -> named_struct('x', x, 'i', i)))")
    base = base.withColumn("_s", F.when(F.col("_twice"), ordered))
    starts = F.expr("array_sort(transform(filter(transform(_s, (e, k) -> named_struct('i', e.i, 'f', k = 0 or get(_s, k - 1).x != e.x, 'r', (k > 0 and get(_s, k - 1).x = e.x) or (k + 1 < size(_s) and get(_s, k + 1).x = e.x))), e -> e.r), e -> named_struct('i', e.i, 'f', e.f)))")
    base = base.withColumn("_p", starts)
    repeat = F.expr("aggregate(transform(_p, (p, k) -> cast(least(8, coalesce(get(_p, k + 1).i, p.i + 8) - p.i) as bigint)), 0L, (a, x) -> a + x)")
    # the longest passage whose windows are met for the first time there, and again later
    run = "if(p.i = a.last + 1, a.run + 1, 8)"
    passage = F.expr(f"aggregate(filter(_p, p -> p.f), named_struct('best', 0, 'run', 0, 'last', -9), (a, p) -> named_struct('best', greatest(a.best, {run}), 'run', {run}, 'last', p.i), a -> cast(a.best as bigint))")
    lines = F.expr(r"filter(split(_text, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')")
    base = base.withColumn("_l", lines)
    return base.select(
        "doc_id", "lang", "source", "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeat, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.coalesce(passage, F.lit(0)).cast("long").alias("n_passage_words"),
        F.xxhash64("_text").alias("version"),
    )


def _vector(stats: DataFrame) -> DataFrame:
    """x0.. : transformed statistics as integers of SCALE steps a unit."""
    words = F.greatest("n_words", F.lit(1))
    # beyond one repeated line, and beyond one passage and its copy
    lines = F.greatest(F.col("n_dup_lines") - 1, F.lit(0))
    repeats = F.greatest(F.col("n_repeat_words") - 2 * F.col("n_passage_words"), F.lit(0))
    raw = {
        "mean_word": F.log(F.greatest("word_chars", F.lit(1)) / words) * LENGTH_FACTOR,
        "symbols": F.log1p(F.col("n_symbols") * SYMBOL_FACTOR / words),
        "dup_lines": F.log1p(lines * LINE_FACTOR / F.greatest("n_lines", F.lit(1))),
        "repeats": F.log1p(repeats * REPEAT_FACTOR / words),
    }
    return stats.withColumns({f"x{k}": F.round(raw[name] * SCALE).cast("long") for k, name in enumerate(STATISTICS)})


_SECOND = [(i, j) for i in range(_N) for j in range(i, _N)]
_MOMENTS = ["m", *[f"s{i}" for i in range(_N)], *[f"q{i}{j}" for i, j in _SECOND]]
_FIELDS = [*[f"u{i}" for i in range(_N)], *[f"l{i}{j}" for i in range(_N) for j in range(i + 1)]]


def _exact(c: Column) -> Column:
    return F.sum(c.cast("decimal(20,0)"))


def _sums(x: str = "x") -> list[Column]:
    """Exact sums: count, first and second moments."""
    first = [_exact(F.col(f"{x}{i}")).alias(f"s{i}") for i in range(_N)]
    return [F.count("*").alias("m"), *first, *[_exact(F.col(f"{x}{i}") * F.col(f"{x}{j}")).alias(f"q{i}{j}") for i, j in _SECOND]]


def _covariance(moments: DataFrame, factor: float) -> DataFrame:
    """Means u_i and the regularised covariance c_ij, from moments m, s_i, q_ij."""
    m, unit = F.col("m").cast("double"), float(SCALE)
    out = moments.withColumns({f"u{i}": F.col(f"s{i}").cast("double") / m / unit for i in range(_N)})
    return out.withColumns({f"c{i}{j}": (F.col(f"q{i}{j}").cast("double") / m / (unit * unit) - F.col(f"u{i}") * F.col(f"u{j}")) * factor + (FLOOR * FLOOR if i == j else 0.0) for i, j in _SECOND})


def _factored(estimates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, u_i, the Cholesky factor l_ij of c_ij, and ``det``: the logarithm of its determinant."""
    low = []
    for i in range(_N):  # each factor uses those before it, as lateral aliases
        for j in range(i + 1):
            rest = f"c{j}{i}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            low.append(f"sqrt(greatest({rest}, {FLOOR * FLOOR / 4!r}D)) as l{i}{j}" if i == j else f"({rest}) / l{j}{j} as l{i}{j}")
    det = " + ".join(f"2 * ln(l{i}{i})" for i in range(_N))
    return estimates.selectExpr(*keys, *[f"u{i}" for i in range(_N)], *low, f"{det} as det")


def _with_distance(rows: DataFrame) -> DataFrame:
    """d2: squared Mahalanobis distance by forward substitution."""
    z = [f"(x{i} / {float(SCALE)!r}D - u{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i)) + f") / l{i}{i} as z{i}" for i in range(_N)]
    return rows.selectExpr("*", *z, " + ".join(f"z{i} * z{i}" for i in range(_N)) + " as d2")


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, k: x & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")), keys, F.lit(True))


def _beside(vectors: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Each vector with the columns of its group.

    ``groups`` is a stored table of one row a group: broadcast while it is below
    the session's bound, and else both sides are plain exchanges, which adaptive
    execution splits at a hot group.
    """
    return vectors.alias("v").join(groups.alias("g"), _same("v", "g", keys)).select("v.*", *[f"g.{c}" for c in groups.columns if c not in keys])


def robust_starts(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Three estimates of every group: (keys, start, u_i, l_ij, det).

    Medians are exact over whole cells; what an aggregate holds is one count a cell.
    """
    cells = vectors.select(*keys, *[F.round(F.col(f"x{i}") / START_CELL).cast("long").alias(f"x{i}") for i in range(_N)])
    middle = stored(cells.groupBy(*keys).agg(*[F.percentile(f"x{i}", 0.5).alias(f"u{i}") for i in range(_N)]), "medians")
    off = _beside(cells, middle, keys).select(*keys, *[f"u{i}" for i in range(_N)], *[F.abs(F.col(f"x{i}") - F.col(f"u{i}")).alias(f"d{i}") for i in range(_N)])
    unit = START_CELL / SCALE
    spread = off.groupBy(*keys, *[f"u{i}" for i in range(_N)]).agg(*[F.percentile(f"d{i}", 0.5).alias(f"d{i}") for i in range(_N)])
    scale = [F.sqrt(F.pow(F.col(f"d{i}") * (unit * DEVIATION), F.lit(2.0)) + FLOOR * FLOOR).alias(f"w{i}") for i in range(_N)]
    spread = stored(spread.select(*keys, *[(F.col(f"u{i}") * unit).alias(f"u{i}") for i in range(_N)], *scale), "deviations")

    rows = _beside(vectors, spread, keys)
    rows = rows.withColumns({f"z{i}": (F.col(f"x{i}") / float(SCALE) - F.col(f"u{i}")) / F.col(f"w{i}") for i in range(_N)})
    length = F.sqrt(reduce(lambda a, i: a + F.col(f"z{i}") * F.col(f"z{i}"), range(_N), F.lit(0.0)))
    shapes = {"t": [F.tanh(F.col(f"z{i}")) for i in range(_N)], "n": [F.when(length > 0, F.col(f"z{i}") / length).otherwise(0.0) for i in range(_N)]}
    rows = rows.withColumns({f"{k}{i}": F.round(c * SCALE).cast("long") for k, cs in shapes.items() for i, c in enumerate(cs)})
    sums = [s.alias(f"{k}_{name}") for k in shapes for name, s in zip(_MOMENTS, _sums(k), strict=True)]
    shape = stored(rows.groupBy(*keys, *[f"u{i}" for i in range(_N)], *[f"w{i}" for i in range(_N)]).agg(*sums), "shapes")

    out = []
    for start, k in enumerate((None, "t", "n")):
        c = {}
        for i, j in _SECOND:
            if i == j:
                c[i, j] = F.col(f"w{i}") * F.col(f"w{i}")
            elif k is None:
                c[i, j] = F.lit(0.0)
            else:
                moment = lambda a, b, k=k: F.col(f"{k}_q{a}{b}").cast("double") / F.col(f"{k}_m") - (F.col(f"{k}_s{a}").cast("double") / F.col(f"{k}_m")) * (F.col(f"{k}_s{b}").cast("double") / F.col(f"{k}_m"))
                c[i, j] = F.col(f"w{i}") * F.col(f"w{j}") * moment(i, j) / F.sqrt((moment(i, i) + 1.0) * (moment(j, j) + 1.0))
        out.append(_factored(shape.select(*keys, *[f"u{i}" for i in range(_N)], *[x.alias(f"c{i}{j}") for (i, j), x in c.items()]), keys).withColumn("start", F.lit(start)))
    return reduce(DataFrame.unionByName, out).select(*keys, "start", *_FIELDS, "det")


def concentrated(vectors: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """One step: the estimates of the half of each group that lies nearest by those of ``now``, from each start."""
    near = _with_distance(_beside(vectors, now.drop("det"), keys))
    cell = F.least(F.lit(CELLS - 1), F.floor(F.log2(1 + F.col("d2")) * CELLS_PER_UNIT)).cast("int")
    by = [*keys, "start"]
    cells = near.withColumn(_CELL, cell).groupBy(*by, _CELL).agg(*_sums())
    group = W.partitionBy(*by)
    cells = cells.withColumn("_before", F.sum("m").over(group.orderBy(_CELL)) - F.col("m")).withColumn("_half", F.sum("m").over(group) * MAJORITY)
    room = F.col("_half") - F.col("_before")
    whole, part = room >= F.col("m"), (room > 0) & (room < F.col("m"))  # at most one cell is taken in part
    taken = [F.sum(F.when(whole, F.col(c))).alias(f"_w_{c}") for c in _MOMENTS] + [F.max(F.when(part, F.col(c))).alias(f"_p_{c}") for c in _MOMENTS]
    kept = cells.groupBy(*by).agg(*taken, F.max(F.when(part, room / F.col("m"))).alias("_share"))
    value = lambda c: F.coalesce(F.col(f"_w_{c}").cast("double"), F.lit(0.0)) + F.coalesce(F.col(f"_p_{c}").cast("double") * F.col("_share"), F.lit(0.0))
    return _factored(_covariance(kept.select(*by, *[value(c).alias(c) for c in _MOMENTS]), consistency(MAJORITY)), by)


def least_determinant(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, u_i, l_ij, det): of each group the half of least determinant that the starts lead to."""
    now = robust_starts(vectors, keys)
    for _ in range(FIRST_STEPS):
        now = stored(concentrated(vectors, stored(now, "starts"), keys), "steps")
    best = now.groupBy(*keys).agg(F.min(F.struct("det", "start", *_FIELDS)).alias("b"))
    now = stored(best.select(*keys, "b.start", *[f"b.{c}" for c in _FIELDS], "b.det"), "best")
    for _ in range(MOST_STEPS):
        after = concentrated(vectors, now, keys)
        falls = F.col("a.det") - F.col("b.det") >= SETTLED  # else the group stays where it is
        both = now.alias("a").join(after.alias("b"), _same("a", "b", [*keys, "start"]))
        after = stored(both.select(*[f"a.{k}" for k in (*keys, "start")], *[F.when(falls, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in (*_FIELDS, "det")], falls.alias("falls")), "steps")
        if after.where("falls").isEmpty():
            break
        now = after.drop("falls")
    return now


def minimum_covariance(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, u_i, l_ij): the final estimate of every group of ``keys``, from vectors x_i."""
    vectors = vectors.select(*keys, *[f"x{i}" for i in range(_N)])
    inner = _with_distance(_beside(vectors, least_determinant(vectors, keys), keys)).where(F.col("d2") <= INNER)
    return stored(_factored(_covariance(inner.groupBy(*keys).agg(*_sums()), consistency(0.975)), keys).drop("det"), "estimates")


def judge(docs: DataFrame) -> DataFrame:
    """Statistics, base_failed, distance (null where a base rule failed) and kept, for every document."""
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < LEAST_WORDS) | (repeated * 100 > n * MOST_REPEATED_PERCENT)
    stats = stored(text_statistics(docs).withColumn("base_failed", failed), "statistics")
    good = _vector(stats.where(~F.col("base_failed")))

    # which estimate a group takes: its own, its language's, or that of all
    sizes = good.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("_of_lang", F.sum("n").over(W.partitionBy("lang")))
    level = F.when(F.col("n") >= LEAST_GROUP, 0).when(F.col("_of_lang") >= LEAST_GROUP, 1).otherwise(2)
    keys = ["level", "in_lang", "in_source"]
    takes = sizes.select("lang", "source", level.alias("level")).withColumns({"in_lang": F.when(F.col("level") < 2, F.col("lang")), "in_source": F.when(F.col("level") < 1, F.col("source"))})
    takes = stored(takes, "groups")

    # a vector stands in up to three groups; only those that are taken are made
    none, x = F.lit(None).cast("string"), [f"x{i}" for i in range(_N)]
    inside = [F.struct(F.lit(k).alias("level"), a.alias("in_lang"), b.alias("in_source")) for k, (a, b) in enumerate([(F.col("lang"), F.col("source")), (F.col("lang"), none), (none, none)])]
    spread = good.select(F.explode(F.array(*inside)).alias("_g"), *x).select("_g.*", *x)
    vectors = stored(spread.alias("v").join(stored(takes.select(*keys).distinct(), "taken").alias("g"), _same("v", "g", keys), "left_semi"), "vectors")
    estimates = minimum_covariance(vectors, keys)
    pick = stored(takes.alias("t").join(estimates.alias("g"), _same("t", "g", keys)).select("t.lang", "t.source", *[f"g.{c}" for c in _FIELDS]), "picked")
    measured = _vector(stats).alias("v").join(pick.alias("g"), _same("v", "g", ["lang", "source"]), "left").select("v.*", *[f"g.{c}" for c in _FIELDS])
    near = _with_distance(measured).withColumn("distance", F.when(~F.col("base_failed"), F.col("d2")))
    return near.select(*stats.columns, "distance", (~F.col("base_failed") & ~F.coalesce(F.col("distance") > CUT_OFF, F.lit(False))).alias("kept"))


def judged_documents(docs: DataFrame) -> DataFrame:
    """The digest of every document."""
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows that are kept, all columns as they were: each by its own text, language and source, whatever other rows have its id or none."""
    keys = ["doc_id", "version", "lang", "source"]
    kept = judge(docs).where("kept").select(*[F.col(c).alias(f"_rw_{c}") for c in keys]).distinct()
    own = {"doc_id": docs["doc_id"].cast("long"), "version": F.xxhash64(F.coalesce(docs["text"], F.lit(""))), "lang": docs["lang"].cast("string"), "source": docs["source"].cast("string")}
    same = reduce(lambda a, c: a & own[c].eqNullSafe(F.col(f"_rw_{c}")), keys, F.lit(True))
    return docs.join(kept.hint("shuffle_hash"), same, "left_semi")
