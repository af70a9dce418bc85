"""Robust multivariate outliers among document statistics, in DataFrame functions only.

Per language and source, location and scatter of a transformed statistic vector
are those of the share of rows whose scatter has the least determinant.  From
several deterministic starts (median deviations, the correlations of squashed
values, spatial signs, and plain moments) concentration steps re-estimate both
from the nearest rows until the determinant no longer falls; the start that ends
at the least determinant counts.  A scatter is regularised by a fixed diagonal of
least squared deviations (as in the minimum regularised covariance determinant,
for which steps cannot raise the determinant either), so that a constant
statistic does no harm.  Rows beyond a cutoff of the final distance are rejected.

Scale: texts are read once and never shuffled; what follows works on a written
table of distinct vectors with their counts.  Quantiles come from counts of at
most ``BINS`` bins, refined once, and scatters from sums, so every aggregation
combines before the shuffle and no window holds more than ``BINS`` rows, however
large a group is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import store

#: Width of a bin of each coordinate, and the least standard deviation it is given.
COORDINATES = {"x0": (0.02, 0.5), "x1": (0.005, 0.03), "x2": (0.005, 0.11), "x3": (0.005, 0.11)}
#: Lines and words without a repetition that every text is credited with, so one repeated line of a short text is little evidence.
FREE_LINES, FREE_WORDS = 5, 50
D = len(COORDINATES)
X = list(COORDINATES)
#: Bins of a quantile; larger values count as the last one.  A distance of one has ``COARSE`` of them, each of which is split into ``FINE``.
BINS, COARSE, FINE = 4096, 16, 1024


@dataclass(frozen=True)
class Mcd:
    """``factor`` makes the scatter of the nearest ``share`` rows consistent for normal data.

    For 4 coordinates and a share of 0.75 it is 0.75 / P(chi2_6 < q) with q the
    0.75 quantile of chi2_4.  ``cutoff`` is the quantile of chi2_4 that one in a
    million exceeds.  Groups below ``least`` rows are pooled.  ``steps`` bounds the
    concentration steps; a start is done when a step lowers the logarithm of the
    determinant by less than ``tolerance``.
    """

    share: float = 0.75
    factor: float = 1.485
    steps: int = 40
    tolerance: float = 1e-4
    cutoff: float = 33.4
    least: int = 60


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of whole texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blank = "\t\n\x0b\x0c\r "
    solid = F.translate("text", blank, "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, blank, "") != "")
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.array_remove(F.split(F.translate("text", blank, " " * len(blank)), " "), "").alias("w"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    n = F.size("w")
    three = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    rows = rows.select(
        *(c for c in rows.columns if c not in ("w", "lines")),
        n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n > 3, F.slice(three, F.lit(1), F.greatest(n - 2, F.lit(1)))).alias("h"),
    )
    # places of windows whose hash occurs again
    some = F.size("h") > F.size(F.array_distinct("h"))
    rows = rows.withColumn("s", F.when(some, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("h")
    again = F.filter("s", lambda x, i: (x["h"] == F.get("s", i - 1)["h"]) | (x["h"] == F.get("s", i + 1)["h"]))
    rows = rows.withColumn("p", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("s")
    gaps = F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3))))
    return rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """Mean word length, and square roots of the shares of symbols, repeated lines and repeated words, the latter two with free ones."""
    return [
        (F.col("word_chars") / F.greatest("n_words", F.lit(1))).alias("x0"),
        F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("x1"),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + FREE_LINES)).alias("x2"),
        F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + FREE_WORDS)).alias("x3"),
    ]


#: Names of the group of all small groups, and of that of all rows; other names are not empty and hold a separator.
POOL, EVERY = "", "*"


def _ranked(rows: DataFrame, keys: list[str], bin_: Column, n: Column) -> DataFrame:
    """(keys, q, before, inside): the bin in which a group's ``n``-th row lies, and the rows before and in it.

    ``rows`` has ``c``, a count of equal rows.
    """
    counts = rows.groupBy(*keys, bin_.cast("long").alias("q")).agg(F.sum("c").alias("inside"))
    run = Window.partitionBy(*keys).orderBy("q")
    counts = counts.withColumn("upto", F.sum("inside").over(run)).withColumn("all", F.sum("inside").over(Window.partitionBy(*keys)))
    counts = counts.withColumn("before", F.col("upto") - F.col("inside"))
    return counts.where((F.col("upto") >= n) & (F.col("before") < n)).select(*keys, "q", "before", "inside")


def _nth(share: float) -> Column:
    return F.ceil(F.lit(share) * F.col("all"))


def _medians(rows: DataFrame) -> DataFrame:
    """(g, m0.., s0..): medians, and deviations from median absolute ones, regularised."""
    parts = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("x"), F.lit(width).alias("width"), F.lit(least).alias("least")) for c, (width, least) in COORDINATES.items()])
    long = rows.select("g", "c", F.explode(parts).alias("e")).select("g", "c", "e.*")
    bin_ = lambda v: F.floor(F.least(v / F.col("width"), F.lit(BINS - 1.0)))
    keys = ["g", "k", "width", "least"]
    mid = _ranked(long, keys, bin_(F.col("x")), _nth(0.5)).select(*keys, ((F.col("q") + 0.5) * F.col("width")).alias("m"))
    mad = _ranked(long.join(mid, keys), [*keys, "m"], bin_(F.abs(F.col("x") - F.col("m"))), _nth(0.5))
    mad = mad.withColumn("s", F.sqrt(F.pow(1.4826 * (F.col("q") + 0.5) * F.col("width"), 2) + F.col("least") * F.col("least")))
    pick = lambda value, c: F.max(F.when(F.col("k") == c, F.col(value)))
    return mad.groupBy("g").agg(*[pick("m", c).alias(f"m{i}") for i, c in enumerate(X)], *[pick("s", c).alias(f"s{i}") for i, c in enumerate(X)])


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(D) for j in range(i + 1)]


def _factored(rows: DataFrame) -> DataFrame:
    """(g, start, m0.., l00.., logdet) from (g, start, m0.., v00..): the Cholesky factor of the regularised scatter.

    A scatter that is not positive definite, as rounding may leave it, gets the
    least pivots that the regularisation allows.
    """
    factor = []  # each refers to the ones before it in the same projection
    for i, j in _pairs():
        rest = F.col(f"v{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        least = COORDINATES[X[i]][1] ** 2
        factor.append((F.sqrt(F.greatest(rest + least, F.lit(least))) if i == j else rest / F.col(f"l{j}{j}")).alias(f"l{i}{j}"))
    rows = rows.select("g", "start", *[f"m{i}" for i in range(D)], *factor)
    logdet = sum((F.log(f"l{i}{i}") for i in range(1, D)), F.log("l00")) * 2
    return rows.select("g", "start", *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i, j in _pairs()], logdet.alias("logdet"))


def _starts(rows: DataFrame) -> DataFrame:
    """The estimates from which concentration steps start, four a group."""
    rows = rows.join(_medians(rows), "g")
    z = [(F.col(c) - F.col(f"m{i}")) / F.col(f"s{i}") for i, c in enumerate(X)]
    norm = F.sqrt(sum((v * v for v in z[1:]), z[0] * z[0]))
    kinds = {"tanh": [F.tanh(v) for v in z], "sign": [v / F.greatest(norm, F.lit(1e-9)) for v in z]}
    each = [F.sum(F.col("c") * v[i] * v[j]).alias(f"{k}{i}{j}") for k, v in kinds.items() for i, j in _pairs()]
    plain = [F.sum(F.col("c") * F.col(x)).alias(f"t{i}") for i, x in enumerate(X)] + [F.sum(F.col("c") * F.col(X[i]) * F.col(X[j])).alias(f"t{i}{j}") for i, j in _pairs()]
    medians = [F.first(f"{n}{i}").alias(f"{n}{i}") for n in "ms" for i in range(D)]
    sums = rows.groupBy("g").agg(F.sum("c").alias("n"), *medians, *each, *plain)
    m = [F.col(f"m{i}") for i in range(D)]

    def start(name: str, middle: list[Column], scatter) -> Column:
        return F.struct(F.lit(name).alias("start"), *[v.alias(f"m{i}") for i, v in enumerate(middle)], *[scatter(i, j).alias(f"v{i}{j}") for i, j in _pairs()])

    def correlated(kind: str):
        def scatter(i: int, j: int) -> Column:
            r = F.lit(1.0) if i == j else F.coalesce(F.try_divide(F.col(f"{kind}{i}{j}"), F.sqrt(F.col(f"{kind}{i}{i}") * F.col(f"{kind}{j}{j}"))), F.lit(0.0))
            return r * F.col(f"s{i}") * F.col(f"s{j}")

        return scatter

    mean = [F.col(f"t{i}") / F.col("n") for i in range(D)]
    starts = [
        start("deviations", m, lambda i, j: F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0)),
        start("tanh", m, correlated("tanh")),
        start("sign", m, correlated("sign")),
        start("moments", mean, lambda i, j: F.col(f"t{i}{j}") / F.col("n") - mean[i] * mean[j]),
    ]
    return _factored(sums.select("g", F.explode(F.array(*starts)).alias("e")).select("g", "e.*"))


def _distance2(rows: DataFrame) -> DataFrame:
    """Adds the squared Mahalanobis distance: forward substitution in the Cholesky factor."""
    steps = []  # each refers to the ones before it in the same projection
    for i, c in enumerate(X):
        rest = F.col(c) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        steps.append((rest / F.col(f"l{i}{i}")).alias(f"y{i}"))
    total = F.col("y0") * F.col("y0")
    for i in range(1, D):
        total = total + F.col(f"y{i}") * F.col(f"y{i}")
    return rows.select("*", *steps, total.alias("d2")).drop(*[f"y{i}" for i in range(D)])


def _step(rows: DataFrame, estimates: DataFrame, p: Mcd) -> DataFrame:
    """One concentration step of each estimate: location and scatter of the nearest rows.

    Of the rows in the bin in which the last of them lies, all count in part.
    """
    keys = ["g", "start"]
    far = _distance2(rows.join(estimates.drop("logdet"), "g")).withColumn("r", F.least(F.sqrt("d2"), F.lit(BINS / COARSE - 1e-9)))
    coarse = _ranked(far, keys, F.floor(F.col("r") * COARSE), _nth(p.share)).withColumnsRenamed({"q": "q1", "before": "b1"}).drop("inside")
    total = rows.groupBy("g").agg(F.sum("c").alias("all"))
    coarse = coarse.join(total, "g").select(*keys, "q1", "b1", (_nth(p.share) - F.col("b1")).alias("n1"))
    near = far.join(coarse, keys).withColumn("q", F.floor(F.col("r") * (COARSE * FINE)))
    inside = near.where(F.floor(F.col("r") * COARSE) == F.col("q1"))
    fine = _ranked(inside, [*keys, "n1"], F.col("q"), F.col("n1")).select(*keys, F.col("q").alias("q2"), ((F.col("n1") - F.col("before")) / F.col("inside")).alias("share"))
    weighed = near.join(fine, keys).withColumn("w", F.col("c") * F.when(F.col("q") < F.col("q2"), 1.0).when(F.col("q") == F.col("q2"), F.col("share")).otherwise(0.0)).where("w > 0")
    sums = weighed.groupBy(*keys).agg(F.sum("w").alias("n"), *[F.sum(F.col("w") * F.col(c)).alias(f"t{i}") for i, c in enumerate(X)], *[F.sum(F.col("w") * F.col(X[i]) * F.col(X[j])).alias(f"t{i}{j}") for i, j in _pairs()])
    mean = [F.col(f"t{i}") / F.col("n") for i in range(D)]
    return _factored(sums.select(*keys, *[v.alias(f"m{i}") for i, v in enumerate(mean)], *[(p.factor * (F.col(f"t{i}{j}") / F.col("n") - mean[i] * mean[j])).alias(f"v{i}{j}") for i, j in _pairs()]))


def estimate(rows: DataFrame, p: Mcd = Mcd()) -> DataFrame:
    """(g, start, m0.., l00.., logdet) of each group of (g, x0.., c): the estimate of the least determinant."""
    live = store(_starts(rows).withColumn("logdet", F.lit(float("inf"))), "estimates")
    ended = None
    for _ in range(p.steps):
        after = _step(rows, live, p)
        last = live.select("g", "start", F.col("logdet").alias("last"))
        after = store(after.join(last, ["g", "start"]).withColumn("live", F.col("last") - F.col("logdet") >= p.tolerance), "estimates")
        done, live = after.where("not live").drop("last", "live"), after.where("live").drop("last", "live")
        ended = done if ended is None else ended.unionByName(done)
        if live.isEmpty():
            break
    every = ended.unionByName(live)
    best = every.groupBy("g").agg(F.min_by(F.struct(*[c for c in every.columns if c != "g"]), F.struct("logdet", "start")).alias("e"))
    return store(best.select("g", "e.*"), "estimates")


def judge(docs: DataFrame, p: Mcd = Mcd()) -> DataFrame:
    """Returns the statistics of each row with base_failed, kept, grp and the squared distance.

    ``docs`` needs doc_id, text, lang and source; other columns are ignored.  A
    null text has no words, so it fails the base rules; null languages and
    sources are groups of their own.  Estimates use only rows that pass the base
    rules.  Groups below ``least`` such rows are pooled into one; if that is below
    it as well, its rows are held against the estimate of all rows.  Repeated rows
    are judged each.  An empty table gives an empty result.
    """
    stats = store(with_statistics(docs).withColumn("base_failed", base_failed()), "statistics")
    name = F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit("-")), F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("-")))
    named = stats.select("*", *vector(), name.alias("grp"))
    vectors = store(named.where("not base_failed").groupBy("grp", *X).agg(F.count("*").alias("c")), "vectors")
    sizes = vectors.groupBy("grp").agg(F.sum("c").alias("rows"))
    pool = sizes.where(F.col("rows") < p.least).agg(F.sum("rows")).first()[0] or 0
    small = POOL if pool >= p.least else EVERY
    groups = store(sizes.select("grp", F.when(F.col("rows") >= p.least, F.col("grp")).otherwise(small).alias("g")), "groups")
    rows = vectors.join(groups, "grp")
    if pool and small == EVERY:
        rows = rows.where(F.col("g") != EVERY).unionByName(vectors.join(groups, "grp").withColumn("g", F.lit(EVERY)))
    rows = store(rows.groupBy("g", *X).agg(F.sum("c").alias("c")), "vectors")
    out = _distance2(named.join(groups, "grp", "left").join(estimate(rows, p).drop("logdet", "start"), "g", "left"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(F.col("d2") <= p.cutoff, F.lit(True))).alias("kept"), "d2")
