"""Quality rules: base counts and robust multivariate outliers.

Each text gives five counts and from them a vector of transformed statistics
(length, mean word length, symbols per word, repeated lines, share of repeated
windows). Per language and source the minimum covariance determinant is sought: the mean and
covariance of the SHARE of rows whose covariance has the least determinant. From STARTS starts
(medians with quartiles, signs, squashed values, and small subsets by hash), concentration
steps keep the SHARE of rows with the smallest Mahalanobis distance and estimate again, which
never raises the determinant; after FIRST_STEPS steps the start with the least determinant goes on
until no group's determinant falls any more. Texts whose squared distance from the estimate is
over CUTOFF are rejected.

Everything is DataFrame functions. Counts are made row by row without a shuffle.
Medians, quartiles and the SHARE of nearest rows come from fixed-width
histograms, so they are exact to a bin (of the last one a fraction counts), independent of the
order of rows, pre-aggregated, and bounded in memory for a group of any size; estimates come back
to the rows by lookup_join.

Estimates are shrunken at every size alike: a group of n texts counts n against PRIOR texts of its
language, a language against PRIOR texts of all (covariances within groups and between them). So a
group of a few odd texts is judged by its language, and a large one by itself. FLOORS are least
standard deviations: what a statistic varies by in a text of MIN_WORDS words without any difference
in kind, so that texts aren't rejected for noise where a statistic is constant.

Defined results: null and empty texts have no words and fail the base rules; a null
language or source is a group of its own; repeated rows each get a row and count
each; an empty table gives an empty result; only the id, text, language and source
columns are read, so other columns can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from avrolith.llm.common import lookup_join, materialize

MIN_WORDS = 50
SHARE = 0.75
PRIOR = 100
STARTS = 5
#: Rows, on average, of the starts by hash.
SUBSET = 12
FIRST_STEPS = 2
MOST_STEPS = 30
#: Logarithms of determinants that differ by less count as equal.
SETTLED = 1e-3
#: Bins of a statistic's unit, and of the logarithm of squared distances.
BINS, DISTANCE_BINS = 64, 256
#: Squared distance beyond which a text is rejected: chi2(5) exceeds it once in 10,000 times.
CUTOFF = 25.74
#: For SHARE 0.75 and 5 dimensions: 0.75 / P(chi2(7) <= q) with P(chi2(5) <= q) = 0.75.
CONSISTENCY = 1.41
#: Length: a factor of two. Mean word length: words vary by half their length. Symbols and repeated
#: windows: square roots and arc sines of shares vary by half of 1 / sqrt(n). Lines: one more or less.
_NOISE = 0.5 / math.sqrt(MIN_WORDS)
FLOORS = (math.log(2), _NOISE, _NOISE, math.log(2), _NOISE)
DIMENSIONS = len(FLOORS)
_BLANK = r"\\x20\\x09-\\x0D"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, the columns of keep, and the five counts of each row. Materialise it before filtering
    by the counts: a filter is pushed below their expressions and would repeat them."""
    out = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c) for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    out = out.withColumn("__w", F.expr(f"array_remove(split(__t, '[{_BLANK}]+'), '')"))
    out = out.withColumn("__n", F.size("__w"))
    # 64-bit hashes stand for 3-word windows
    windows = "slice(transform(__w, (w, i) -> xxhash64(w, get(__w, i + 1), get(__w, i + 2))), 1, greatest(__n - 2, 0))"
    lines = f"case when instr(__t, '\\n') = 0 then null else filter(split(__t, '\\n'), x -> x rlike '[^{_BLANK}]') end"
    out = out.select("doc_id", *keep, "__t", "__n", F.expr("char_length(array_join(__w, ''))").alias("__c"), F.expr(windows).alias("__h"), F.expr(lines).alias("__l"))
    out = out.withColumn("__twice", F.expr("size(__h) > 1 and size(array_distinct(__h)) < size(__h)"))
    out = out.withColumn("__s", F.expr("case when __twice then sort_array(transform(__h, (h, i) -> struct(h as h, i as i))) end"))
    # windows found twice or more are neighbours now; their places, sorted, cover up to three words each
    out = out.withColumn("__p", F.expr("case when __twice then sort_array(transform(filter(__s, (x, i) -> x.h = get(__s, i - 1).h or x.h = get(__s, i + 1).h), x -> x.i)) end"))
    covered = "coalesce(aggregate(__p, struct(-3 as last, 0 as n), (a, x) -> struct(x as last, a.n + least(3, x - a.last) as n), a -> a.n), 0)"
    return out.select(
        "doc_id",
        *keep,
        F.col("__n").cast("long").alias("n_words"),
        F.col("__c").cast("long").alias("word_chars"),
        F.expr("cast(regexp_count(__t, '[#*$%&|<>]') as long)").alias("n_symbols"),
        F.expr("cast(coalesce(size(__l) - size(array_distinct(__l)), 0) as long)").alias("n_dup_lines"),
        F.expr(f"cast({covered} as long)").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)).cast("double") / n),
        F.sqrt(F.col("n_symbols") / n),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.asin(F.sqrt(F.least(F.col("n_repeat_words") / n, F.lit(1.0)))),
    ]


_X = [f"x{i}" for i in range(DIMENSIONS)]
_PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]


_M = [f"m{i}" for i in range(DIMENSIONS)]
_V = [f"v{i}{j}" for i, j in _PAIRS]
_K = [f"k{i}{j}" for i, j in _PAIRS]


def _first_bin(counts: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """The first bin up to which `share` of a group's rows lie, and (name_part) which part of its
    rows that takes."""
    up_to = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*keys)
    cum = counts.withColumn("cum", F.sum("c").over(up_to)).withColumn("h", F.ceil(F.lit(share) * F.sum("c").over(everything)))
    found = cum.where("cum >= h").groupBy(*keys).agg(F.min(F.struct("bin", "cum", "c", "h")).alias("b"))
    return found.select(*keys, F.col("b.bin").alias(name), ((F.col("b.h") - F.col("b.cum") + F.col("b.c")) / F.col("b.c")).alias(f"{name}_part"))


def _centres(rows: DataFrame) -> DataFrame:
    """Per group: medians m0.. and standard deviations s0.. from quartiles, to a bin."""
    bins = rows.select("g", F.posexplode(F.array(*[F.floor(F.col(x) * BINS) for x in _X])).alias("d", "bin"))
    counts = materialize(bins.groupBy("g", "d", "bin").agg(F.count(F.lit(1)).alias("c")), "bins")
    at = [_first_bin(counts, ["g", "d"], q, f"q{i}") for i, q in enumerate((0.25, 0.5, 0.75))]
    q = at[0].join(at[1], ["g", "d"]).join(at[2], ["g", "d"])
    return q.groupBy("g").agg(
        *[F.max(F.when(F.col("d") == i, (F.col("q1") + 0.5) / BINS)).alias(f"m{i}") for i in range(DIMENSIONS)],
        *[F.max(F.when(F.col("d") == i, F.greatest((F.col("q2") - F.col("q0")) / BINS / 1.349, F.lit(FLOORS[i])))).alias(f"s{i}") for i in range(DIMENSIONS)],
    )


def _starts(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Estimates (g, n, start, m.., v..) of all starts."""
    centres = materialize(_centres(rows).join(groups, "g"), "centres")
    near = lookup_join(rows, centres, ["g"], "n", total, "spread").withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
    near = near.select("g", "start", "n", F.xxhash64("spread", "start").alias("r"), *[f"s{i}" for i in range(DIMENSIONS)], *_M, *[((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i in range(DIMENSIONS)])
    norm = F.sqrt(sum((F.col(f"z{i}") ** 2 for i in range(DIMENSIONS)), F.lit(1e-6)))
    kind = F.col("start")
    y = [F.when(kind == 1, F.col(f"z{i}") / norm).when(kind == 2, F.tanh(F.col(f"z{i}"))).when(kind >= 3, F.col(f"z{i}")).otherwise(F.lit(0.0)).alias(f"y{i}") for i in range(DIMENSIONS)]
    inside = (kind < 3) | (F.pmod("r", F.lit(1 << 30)) * F.col("n") < F.lit(SUBSET << 30))
    sums = near.where(inside).select("g", "start", "n", *_M, *[f"s{i}" for i in range(DIMENSIONS)], *y).groupBy("g", "start").agg(
        F.first("n").alias("n"),
        *[F.first(f"m{i}").alias(f"c{i}") for i in range(DIMENSIONS)],
        *[F.first(f"s{i}").alias(f"s{i}") for i in range(DIMENSIONS)],
        *[F.avg(f"y{i}").alias(f"a{i}") for i in range(DIMENSIONS)],
        *[F.avg(F.col(f"y{i}") * F.col(f"y{j}")).alias(f"b{i}{j}") for i, j in _PAIRS],
    )
    mean = [(F.col(f"c{i}") + F.when(kind >= 3, F.col(f"a{i}") * F.col(f"s{i}")).otherwise(0.0)).alias(f"m{i}") for i in range(DIMENSIONS)]

    def cov(i: int, j: int) -> Column:
        about = F.when(kind >= 3, F.col(f"a{i}") * F.col(f"a{j}")).otherwise(0.0)
        of = F.when(kind == 0, F.lit(float(i == j))).otherwise(F.col(f"b{i}{j}") - about)
        return (of * F.col(f"s{i}") * F.col(f"s{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))).alias(f"v{i}{j}")

    return sums.select("g", "n", "start", *mean, *[cov(i, j) for i, j in _PAIRS])


def _whiten(estimates: DataFrame) -> DataFrame:
    """estimates (with means m and covariances v) with the rows of the inverse Cholesky factor, k_ij, and logdet."""
    names = estimates.columns
    out = estimates
    for i, j in _PAIRS:
        rest = F.col(f"v{i}{j}") - sum((F.col(f"l{i}{p}") * F.col(f"l{j}{p}") for p in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    for j in range(DIMENSIONS):
        for i in range(j, DIMENSIONS):
            value = F.lit(1.0) if i == j else -sum((F.col(f"l{i}{p}") * F.col(f"k{p}{j}") for p in range(j, i)), F.lit(0.0))
            out = out.withColumn(f"k{i}{j}", value / F.col(f"l{i}{i}"))
    logdet = 2 * sum((F.log(F.col(f"l{i}{i}")) for i in range(DIMENSIONS)), F.lit(0.0))
    return out.select(*names, *_K, logdet.alias("logdet"))


def _distance(of: str = "") -> Column:
    total = F.lit(0.0)
    for i in range(DIMENSIONS):
        y = sum((F.col(f"{of}k{i}{j}") * (F.col(f"x{j}") - F.col(f"{of}m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = total + y * y
    return total


def _step(rows: DataFrame, estimates: DataFrame, total: int, share: float) -> DataFrame:
    """Estimates after one concentration step from estimates (g, n, start, m.., k..)."""

    def against(table: DataFrame, extra: list[str]) -> DataFrame:
        packed = table.groupBy("g", "n").agg(F.collect_list(F.struct("start", *_M, *_K, *extra)).alias("all"))  # at most STARTS
        near = lookup_join(rows, materialize(packed, "packed"), ["g"], "n", total, "spread").withColumn("e", F.explode("all"))
        return near.select("g", "n", *_X, "e", F.col("e.start").alias("start"), F.floor(F.log1p(_distance("e.")) * DISTANCE_BINS).alias("bin"))

    counts = against(estimates, []).groupBy("g", "start", "bin").agg(F.count(F.lit(1)).alias("c"))
    limits = _first_bin(materialize(counts, "distances"), ["g", "start"], share, "limit")
    near = against(estimates.join(limits, ["g", "start"]), ["limit", "limit_part"]).where("bin <= e.limit")
    w = F.when(F.col("bin") < F.col("e.limit"), F.lit(1.0)).otherwise(F.col("e.limit_part"))
    dev = [F.col(f"x{i}") - F.col(f"e.m{i}") for i in range(DIMENSIONS)]  # about the last centre, for precision
    near = near.select("g", "n", "start", w.alias("w"), *[F.col(f"e.m{i}").alias(f"c{i}") for i in range(DIMENSIONS)], *[dev[i].alias(f"d{i}") for i in range(DIMENSIONS)])
    mean_of = lambda x: F.sum(F.col("w") * x) / F.sum("w")
    sums = near.groupBy("g", "start").agg(
        F.first("n").alias("n"),
        *[F.first(f"c{i}").alias(f"c{i}") for i in range(DIMENSIONS)],
        *[mean_of(F.col(f"d{i}")).alias(f"a{i}") for i in range(DIMENSIONS)],
        *[mean_of(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"b{i}{j}") for i, j in _PAIRS],
    )
    means = [(F.col(f"c{i}") + F.col(f"a{i}")).alias(f"m{i}") for i in range(DIMENSIONS)]
    cov = [((F.col(f"b{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")) * CONSISTENCY + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))).alias(f"v{i}{j}") for i, j in _PAIRS]
    return materialize(_whiten(sums.select("g", "n", "start", *means, *cov)), "estimates")


def mcd(rows: DataFrame, groups: DataFrame, total: int, share: float = SHARE) -> DataFrame:
    """Estimates per group of rows (g, spread, x0..): g, n, start, m0.., v00.., k00.., logdet. groups: (g, n)."""
    estimates = materialize(_whiten(_starts(rows, groups, total)), "starts")
    for _ in range(FIRST_STEPS):
        estimates = _step(rows, estimates, total, share)
    best = Window.partitionBy("g").orderBy("logdet", "start")
    estimates = materialize(estimates.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r"), "best")
    for _ in range(MOST_STEPS):
        after = _step(rows, estimates, total, share)
        fall = after.select("g", F.col("logdet").alias("now")).join(estimates, "g").agg(F.max(F.col("logdet") - F.col("now"))).first()[0]
        # a step may raise a determinant by what a bin holds: the lesser one stays
        least = Window.partitionBy("g").orderBy("logdet")
        estimates = materialize(after.unionByName(estimates).withColumn("__r", F.row_number().over(least)).where("__r = 1").drop("__r"), "lesser")
        if fall is None or fall < SETTLED:
            break
    return estimates


def _pooled(estimates: DataFrame, by: list[str]) -> DataFrame:
    """Over groups: their rows (p_n), mean of means (p_m..) and covariance within and between (p_v..)."""
    share = lambda x: F.sum(F.col("n") * x) / F.sum("n")
    sums = estimates.groupBy(*by).agg(F.sum("n").alias("p_n"), *[share(F.col(m)).alias(f"p_{m}") for m in _M], *[share(F.col(f"v{i}{j}") + F.col(f"m{i}") * F.col(f"m{j}")).alias(f"t{i}{j}") for i, j in _PAIRS])
    # rounding may leave a variance below what its floor gives
    cov = [(F.greatest(F.col(f"t{i}{i}") - F.col(f"p_m{i}") ** 2, F.lit(FLOORS[i] ** 2)) if i == j else F.col(f"t{i}{j}") - F.col(f"p_m{i}") * F.col(f"p_m{j}")).alias(f"p_v{i}{j}") for i, j in _PAIRS]
    return sums.select(*by, "p_n", *[f"p_{m}" for m in _M], *cov)


def shrink(estimates: DataFrame, prior: int = PRIOR) -> DataFrame:
    """Estimates (g, lang, n, m.., v..) drawn to those of their language, and these to all: g, n, m.., k.., logdet."""

    def drawn(n: str, own: str, to: str, x: str) -> Column:
        return (F.col(n) * F.col(own + x) + prior * F.col(to + x)) / (F.col(n) + prior)

    everything = _pooled(estimates, []).select(*[F.col(f"p_{x}").alias(f"all_{x}") for x in (*_M, *_V)]).first()
    if everything is None or everything[0] is None:
        return _whiten(estimates.select("g", "n", *_M, *_V))
    langs = _pooled(estimates, ["lang"]).select("*", *[F.lit(everything[f"all_{x}"]).alias(f"all_{x}") for x in (*_M, *_V)])
    langs = materialize(langs.select(F.col("lang").alias("l"), *[drawn("p_n", "p_", "all_", x).alias(f"l_{x}") for x in (*_M, *_V)]), "languages")
    both = estimates.join(langs, F.col("lang").eqNullSafe(F.col("l")))
    return _whiten(both.select("g", "n", *[drawn("n", "", "l_", x).alias(x) for x in (*_M, *_V)]))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF, prior: int = PRIOR) -> DataFrame:
    """One row per row of docs: doc_id, the five counts, base_failed, kept, distance
    (squared; null where the base rules decide). Ids are longs, or strings as they are."""
    key = F.col(id_col) if docs.schema[id_col].dataType.simpleString() == "string" else F.col(id_col).cast("long")
    named = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    counted = base_counts(named).withColumn("base_failed", base_failed())
    stats = materialize(counted.select("*", *[x.alias(n) for x, n in zip(vector(), _X)]), "statistics")
    passed = stats.where("not base_failed")
    group = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    rows = materialize(passed.select(F.xxhash64("doc_id", *STATS).alias("spread"), "doc_id", *STATS, *_X, group.alias("g"), "lang"), "vectors")
    groups = materialize(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.first("lang").alias("lang")), "groups")
    total = rows.count()
    estimates = mcd(rows.select("g", "spread", *_X), groups.select("g", "n"), total).join(groups.select("g", "lang"), "g")
    estimates = materialize(shrink(estimates, prior).select("g", "n", *_M, *_K), "shrunken")
    judged = lookup_join(rows, estimates, ["g"], "n", total, "spread").select("doc_id", *STATS, _distance().alias("distance"))
    good = judged.select("doc_id", *STATS, F.lit(False).alias("base_failed"), (F.col("distance") <= cutoff).alias("kept"), "distance")
    failed = stats.where("base_failed").select("doc_id", *STATS, F.lit(True).alias("base_failed"), F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return good.unionByName(failed)
