"""Quality rules and robust multivariate outliers.

Counts of each text decide the base rules. Documents that pass them are then
compared with their own language and source by a minimum-covariance-determinant
estimate: of all subsets with SHARE of a group's vectors, the one whose covariance
has the least determinant gives the group's centre and covariance, which junk
can't move, and a document too far from it by Mahalanobis distance is rejected.

The subset is searched from several deterministic starts (mean and covariance;
medians and median deviations; covariances of squashed values and of directions).
A concentration step keeps the SHARE of vectors nearest to the present centre and
estimates anew, which can only lower the determinant. All starts take two steps,
the start with the least determinant goes on until its determinant stops falling.

Copies count once, so a template that fills a source doesn't make everything else
in it an outlier. Counts that are zero nearly everywhere would leave a subset
without spread; below the resolution of their rates they are spread evenly by a
hash of the counts.

DataFrame functions only. Texts are read once; the steps run over the stored
vectors, by sums for each bin of a histogram of distances, so no group meets in
one task, and what they join with is one stored row for each group and start.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.storage import save

NAMES = ("size", "word_length", "symbols", "repeated_lines", "repeated_words")
P = len(NAMES)
RAW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rates in 100 words or lines that aren't told apart.
RESOLUTION = {"symbols": 2.0, "repeated_lines": 10.0, "repeated_words": 5.0}
#: The share of a group's vectors that the subset has.
SHARE = 0.75
#: How often a normal vector would be rejected.
RATE = 1e-5
#: Vectors without which a group has no estimate of its own.
LEAST_GROUP = 100
STARTS = ("classic", "median", "squashed", "directions")
#: Bins of a distance's logarithm; the last one that a subset needs is taken by a part.
BINS = 256.0
#: Bins of a statistic's value, for medians.
FINE = 200.0
#: What a variance without any spread is given.
RIDGE = 1e-8


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words; a null text has no words."""
    space, five = r"[\x20\x09-\x0D]+", 5
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.length(F.regexp_replace("text", space, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.filter(F.split("text", space, -1), lambda w: w != "").alias("words"),
    )
    keep = ["doc_id", "lang", "source", "word_chars", "n_symbols"]
    windows = F.slice("words", F.lit(1), F.greatest(F.size("words") - (five - 1), F.lit(0)))
    hashed = F.transform(windows, lambda w, i: F.xxhash64(w, *(F.get("words", i + k) for k in range(1, five))))
    rows = rows.select(*keep, F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("words").cast("long").alias("n_words"), hashed.alias("hashed"))
    keep += ["n_lines", "n_dup_lines", "n_words"]
    # Most texts have no window twice; only the others are sorted.
    again = F.size(F.array_distinct("hashed")) < F.size("hashed")
    pairs = F.transform("hashed", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.select(*keep, F.when(again, F.array_sort(pairs)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("pairs"))
    same = lambda e, i, k: F.coalesce(F.get("pairs", i + k)["h"] == e["h"], F.lit(False))
    repeated = F.filter("pairs", lambda e, i: F.when(i > 0, same(e, i, -1)).otherwise(F.lit(False)) | same(e, i, 1))
    rows = rows.select(*keep, F.array_sort(F.transform(repeated, lambda e: e["i"])).alias("at"))
    reach = F.transform("at", lambda x, i: F.least(F.lit(five), F.coalesce(F.get("at", i + 1) - x, F.lit(five))))
    return rows.select(*keep, F.aggregate(reach, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"))


def statistics() -> dict[str, Column]:
    """The transformed statistics of a row of counts with words; short texts are drawn towards what is usual."""
    n = F.col("n_words").cast("double")
    spread = lambda name: RESOLUTION[name] * F.shiftrightunsigned(F.xxhash64(*RAW, F.lit(name)), 11) / F.lit(float(1 << 53))
    rate = lambda c, of: 100 * F.col(c).cast("double") / of
    return {
        "size": F.log1p(n),
        "word_length": (F.col("word_chars") + 100) / (n + 20),
        "symbols": F.log1p(rate("n_symbols", n + 50) + spread("symbols")),
        "repeated_lines": F.log1p(rate("n_dup_lines", F.col("n_lines") + 5) + spread("repeated_lines")),
        "repeated_words": F.log1p(rate("n_repeat_words", n + 50) + spread("repeated_words")),
    }


def _lower_gamma(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    term = total = 1 / a
    for k in range(1, 10_000):
        term *= x / (a + k)
        total += term
        if term < total * 1e-16:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def chi_square(x: float, degrees: int) -> float:
    """Probability that a chi-square variable is x at most."""
    return _lower_gamma(degrees / 2, x / 2)


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, degrees) < p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return (low + high) / 2


def consistency(share: float = SHARE, degrees: int = P) -> float:
    """What the covariance of the nearest share of normal vectors lacks."""
    return share / chi_square(chi_square_quantile(share, degrees), degrees + 2)


def cutoff(rate: float = RATE, degrees: int = P) -> float:
    """The squared distance that a normal vector exceeds at that rate."""
    return chi_square_quantile(1 - rate, degrees)


_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _factored(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, centre (m_i), Cholesky factor (l_i_j) and log_det of rows with m_i and covariances s_i_j."""
    made = []
    for i, j in _PAIRS:  # each column may name the ones ahead of it
        value = " - ".join([f"s_{i}_{j}", *(f"l_{i}_{k} * l_{j}_{k}" for k in range(j))])
        made.append(f"sqrt(greatest({value}, {RIDGE}D)) AS l_{i}_{i}" if i == j else f"({value}) / l_{j}_{j} AS l_{i}_{j}")
    log_det = " + ".join(f"2 * ln(l_{i}_{i})" for i in range(P))
    return sums.selectExpr(*keys, *(f"m_{i}" for i in range(P)), *made, f"{log_det} AS log_det")


def _moments(x: list[Column]) -> list[Column]:
    """Aggregates: means m_i and mean products p_i_j of the columns x."""
    return [*(F.avg(c).alias(f"m_{i}") for i, c in enumerate(x)), *(F.avg(x[i] * x[j]).alias(f"p_{i}_{j}") for i, j in _PAIRS)]


def _covariances(keys: list[str]) -> list[Column]:
    return [F.col(k) for k in keys] + [F.col(f"m_{i}") for i in range(P)] + [(F.col(f"p_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")).alias(f"s_{i}_{j}") for i, j in _PAIRS]


def _medians(values: DataFrame) -> DataFrame:
    """group and the median of each statistic, to within a bin."""
    parts = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col(n) * FINE).alias("bin")) for i, n in enumerate(NAMES))))
    sizes = values.select("group", parts.alias("x")).groupBy("group", "x.i", "x.bin").agg(F.count("*").alias("n"))
    order = Window.partitionBy("group", "i").orderBy("bin")
    half = 2 * F.sum("n").over(order) >= F.sum("n").over(Window.partitionBy("group", "i"))
    middle = sizes.select("group", "i", "bin", half.alias("half")).filter("half").groupBy("group", "i").agg(((F.min("bin") + 0.5) / FINE).alias("median"))
    return middle.groupBy("group").agg(*(F.max(F.when(F.col("i") == i, F.col("median"))).alias(f"median_{i}") for i in range(P)))


def starts(vectors: DataFrame) -> DataFrame:
    """group, start, m_i, l_i_j, log_det: what the searches begin with."""
    medians = save(_medians(vectors), "medians")
    away = vectors.join(medians, "group").select("group", *(F.abs(F.col(n) - F.col(f"median_{i}")).alias(n) for i, n in enumerate(NAMES)))
    scales = _medians(away).select("group", *(F.greatest(1.4826 * F.col(f"median_{i}"), F.lit(0.5 / FINE)).alias(f"scale_{i}") for i in range(P)))
    robust = save(medians.join(scales, "group"), "scales")
    z = [(F.col(n) - F.col(f"median_{i}")) / F.col(f"scale_{i}") for i, n in enumerate(NAMES)]
    scaled = vectors.join(robust, "group").select("group", *NAMES, *(c.alias(f"z_{i}") for i, c in enumerate(z)))
    norm = F.sqrt(reduce(lambda a, b: a + b, (F.col(f"z_{i}") ** 2 for i in range(P))))
    kinds = {
        "classic": [F.col(n) for n in NAMES],
        "squashed": [F.tanh(f"z_{i}") for i in range(P)],
        "directions": [F.col(f"z_{i}") / F.greatest(norm, F.lit(1e-9)) for i in range(P)],
    }
    each = scaled.select("group", F.explode(F.array(*(F.struct(F.lit(k).alias("start"), *(c.alias(f"x_{i}") for i, c in enumerate(x))) for k, x in kinds.items()))).alias("e")).select("group", "e.*")
    moments = each.groupBy("group", "start").agg(*_moments([F.col(f"x_{i}") for i in range(P)]))
    moments = moments.select(*_covariances(["group", "start"])).join(robust, "group")
    own = F.col("start") == "classic"
    shape = [F.when(own, F.col(f"m_{i}")).otherwise(F.col(f"median_{i}")).alias(f"m_{i}") for i in range(P)]
    shape += [F.when(own, F.col(f"s_{i}_{j}")).otherwise(F.col(f"s_{i}_{j}") * F.col(f"scale_{i}") * F.col(f"scale_{j}")).alias(f"s_{i}_{j}") for i, j in _PAIRS]
    plain = [F.col(f"median_{i}").alias(f"m_{i}") for i in range(P)] + [(F.col(f"scale_{i}") ** 2 if i == j else F.lit(0.0)).alias(f"s_{i}_{j}") for i, j in _PAIRS]
    both = moments.select("group", "start", *shape).union(robust.select("group", F.lit("median").alias("start"), *plain))
    return _factored(both, ["group", "start"])


def _measured(out: DataFrame) -> DataFrame:
    """Rows with the statistics and an estimate, and the squared Mahalanobis `distance`."""
    made = []
    for i, name in enumerate(NAMES):
        value = " - ".join([name, f"m_{i}", *(f"l_{i}_{j} * z_{j}" for j in range(i))])
        made.append(f"({value}) / l_{i}_{i} AS z_{i}")
    return out.selectExpr("*", *made, " + ".join(f"z_{i} * z_{i}" for i in range(P)) + " AS distance")


def distances(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """rows, and with each estimate of their group its columns and the squared Mahalanobis `distance`."""
    return _measured(rows.join(estimates, "group"))


def concentrated(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """Estimates (group, start, ...) from the SHARE of each group's vectors that are nearest to the given ones.

    The vectors are read once: sums for each bin of the distance's logarithm, of which
    there are some thousand for each group and start, then the bins that are needed.
    """
    means, products = [f"m_{i}" for i in range(P)], [f"p_{i}_{j}" for i, j in _PAIRS]
    measured = distances(vectors, estimates).selectExpr("group", "start", f"CAST(floor({BINS}D * ln(distance + 1e-12D)) AS INT) AS bin", *NAMES)
    sums = [f"sum({NAMES[i]}) AS m_{i}" for i in range(P)] + [f"sum({NAMES[i]} * {NAMES[j]}) AS p_{i}_{j}" for i, j in _PAIRS]
    bins = measured.groupBy("group", "start", "bin").agg(F.count("*").alias("n"), *map(F.expr, sums))
    order = "PARTITION BY group, start"
    ahead = f"coalesce(sum(n) OVER ({order} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    # The bin that fills the share is taken by a part.
    taken = bins.selectExpr("*", f"least(1.0D, ({SHARE}D * sum(n) OVER ({order}) - {ahead}) / n) AS part").filter("part > 0")
    moments = taken.groupBy("group", "start").agg(*(F.expr(f"sum({n} * part) / sum(n * part) AS {n}") for n in means + products))
    covariances = [f"p_{i}_{j} - m_{i} * m_{j} AS s_{i}_{j}" for i, j in _PAIRS]
    return _factored(moments.selectExpr("group", "start", *means, *covariances), ["group", "start"])


def estimates(vectors: DataFrame, steps: int = 50, least_fall: float = 1e-6) -> DataFrame:
    """group, start, m_i, l_i_j, log_det: the least determinant found for each group of vectors (group, NAMES).

    m is the centre and l the Cholesky factor of the nearest share's covariance,
    not corrected for consistency. start tells which search found it.
    """
    now = save(starts(vectors), "starts")
    now = save(concentrated(vectors, save(concentrated(vectors, now), "estimates")), "estimates")
    columns = [c for c in now.columns if c != "group"]
    best = F.min(F.struct("log_det", F.struct(*(c for c in columns if c != "log_det")).alias("e")))
    now = now.groupBy("group").agg(best.alias("b")).select("group", "b.e.*", "b.log_det")
    now = save(now.select("group", *columns, F.lit(True).alias("falls")), "best")
    for _ in range(steps):
        # Only groups whose determinant still falls take another step.
        new = concentrated(vectors, now.filter("falls").drop("falls")).select("group", F.struct(*columns).alias("new"))
        fall = F.coalesce(F.col("log_det") - F.col("new.log_det"), F.lit(0.0))
        both = now.join(new, "group", "left").select("group", F.when(fall > 0, F.col("new")).otherwise(F.struct(*columns)).alias("e"), (fall > least_fall).alias("falls"))
        now = save(both.select("group", "e.*", "falls"), "estimates")
        if not now.filter("falls").limit(1).count():
            break
    return now.drop("falls")


def _vectors(passed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors of documents, and the group that judges those of a language and source, or null."""
    rows = save(passed.select("lang_key", "source_key", *RAW).distinct(), "distinct")
    sizes = rows.groupBy("lang_key", "source_key").agg(F.count("*").alias("n"))
    pools = sizes.filter(F.col("n") < LEAST_GROUP).groupBy("lang_key").agg(F.sum("n").alias("pool"))
    judge = F.when(F.col("n") >= LEAST_GROUP, F.concat("lang_key", F.lit("\0"), "source_key")).when(F.col("pool") >= LEAST_GROUP, F.col("lang_key"))
    groups = save(sizes.join(pools, "lang_key", "left").select("lang_key", "source_key", judge.alias("group")), "groups")
    return rows, groups


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, distance and kept of every document.

    base_failed: fewer than 10 words, or over a fifth of them in repeated windows
    of five. Others are grouped by language and source (null is a value like any
    other); groups with fewer than LEAST_GROUP different vectors of counts are
    pooled by language, and a pool that is still smaller rejects nothing. distance
    (squared, with a consistent covariance) is null for those that failed and
    those without a group. Repeated rows are judged alike.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    key = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("-")).alias(f"{c}_key")
    table = save(counts(docs).select("*", failed.alias("base_failed"), key("lang"), key("source")), "counts")
    rows, groups = _vectors(table.filter("not base_failed"))
    shown = [c.alias(n) for n, c in statistics().items()]
    vectors = save(rows.join(groups.filter("group is not null"), ["lang_key", "source_key"]).select("group", *shown), "vectors")
    found = groups.join(estimates(vectors), "group")
    found = save(found.drop("start", "log_det"), "groups")
    judged = table.select("*", *shown).join(found.withColumnRenamed("group", "of"), ["lang_key", "source_key"], "left")
    distance = F.when(~F.col("base_failed"), F.col("distance") / consistency())
    kept = ~F.col("base_failed") & F.coalesce(distance <= cutoff(), F.lit(True))
    return _measured(judged).select("doc_id", *RAW, "base_failed", distance.alias("distance"), kept.alias("kept"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES: dict[str, str] = {}
