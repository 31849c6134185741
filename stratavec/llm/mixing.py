"""Soft-membership mixing: document rates that bring the domains' expected token totals to target weights.

A labelled table gives some documents a domain. Multinomial naive Bayes over hashed words, with its evidence scaled
to at most ``evidence`` words (naive Bayes is overconfident on long texts), predicts each document's domain
posteriors p. Rates r >= 0 then minimize the least squares || A r - T ||^2, where (A r)_d = sum of r n p_d over documents of n tokens.
Accelerated projected gradient from r = 1 takes r <- max(0, y - p . W (A y - T)) and lets y run ahead of r, beginning anew
where the misfit grows. W is the inverse of G = sum of n p p' for up to ``GRAM`` domains, beyond that the inverse of diag(A 1), which is at least
G: both make the step no longer than the least squares allow. Each round is one aggregation of D sums over all documents, D being
the number of domains; only D numbers (D * D once) reach the driver. Every ``KEEP`` rounds the rates are written to the shared
folder, so neither plans nor lineage grow. Rounds go on until the totals are within ``tolerance`` of the targets or no
longer come nearer; :class:`Fit` says which, and :func:`mix` warns where targets are missed.

The main path is DataFrame operations only. The classifier is fitted on at most ``sample`` labelled documents, the
least by seeded hash of their ids; everything else covers all rows.

Defined results: a null or empty text has no tokens, its posteriors are the labelled domains' shares, and its rate is fitted
like any other (it weighs nothing); without labelled rows there is one domain, "all"; a target that no rates reach
(a domain without tokens) is approached as near as least squares can; rows equal in id and text get equal rates; null ids
are ids of their own, never labelled; a text of any length is one document; a column of the table named like a result gives way to it; an empty table gives no rows.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.session import materialize, remove

from .sharding import seeded_hash

BUCKETS = 4096
#: Domains up to which steps are whitened by the whole matrix G, and rounds between two writes of the rates.
GRAM, KEEP = 64, 10


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    split = F.split(F.lower(F.coalesce(F.col("_text"), F.lit(""))), r"\s+")
    return docs.select(*keep, F.explode(split).alias("_w")).where("_w <> ''").select(*keep, F.pmod(F.hash("_w"), F.lit(BUCKETS)).alias("_b"))


def domain_model(docs: DataFrame, labelled: DataFrame, sample: int, seed: int) -> tuple[list[str], list[float], DataFrame]:
    """The domains, their shares, and a table of BUCKETS rows (_b, _v: log ratios by domain). labelled: doc_id, domain."""
    few = labelled.where("domain is not null and doc_id is not null").select("doc_id", F.col("domain").cast("string").alias("domain")).withColumn("_o", seeded_hash(seed, "doc_id")).orderBy("_o", "doc_id", "domain").limit(sample).drop("_o")
    train = docs.join(F.broadcast(few), docs._key == few.doc_id)  # at most `sample` rows
    counts = materialize(_words(train, "domain").groupBy("domain", "_b").agg(F.count(F.lit(1)).alias("n")), "domain-words")
    shares = {r[0]: r[1] for r in few.groupBy("domain").count().collect()}  # at most `sample`
    domains = sorted(shares) or ["all"]
    prior = [shares.get(d, 1) / max(sum(shares.values()), 1) for d in domains]
    total = {r[0]: r[1] for r in counts.groupBy("domain").agg(F.sum("n")).collect()}
    all_words, weight = max(sum(total.values()), 1), 5000.0
    rows = counts.groupBy("_b").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains)])
    back = F.col("all") / all_words
    return domains, prior, rows.select("_b", F.array(*[F.log((F.col(f"n{i}") + weight * back) / (total.get(d, 0) + weight) / back) for i, d in enumerate(domains)]).alias("_v"))


def posteriors(docs: DataFrame, labelled: DataFrame, sample: int = 20_000, evidence: float = 60.0, seed: int = 17, text: str = "text", key: str = "doc_id") -> tuple[list[str], DataFrame]:
    """The domains and (_key, _row, n_tokens, p): the posteriors of each distinct (id, text)."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    domains, prior, table = domain_model(rows, labelled, sample, seed)
    keyed = rows.withColumn("_row", F.xxhash64("_text"))
    words = _words(keyed, "_key", "_row").join(F.broadcast(table), "_b", "left")  # at most BUCKETS rows
    sums = words.groupBy("_key", "_row").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(F.col("_v")[i], F.lit(0.0))).alias(f"s{i}") for i in range(len(domains))])
    # rows equal in id and text were summed together: how many there are divides out in the mean, and the count is put right
    ids = keyed.groupBy("_key", "_row").agg(F.count(F.lit(1)).alias("_times"))
    on = F.col("_key").eqNullSafe(F.col("_k2")) & (F.col("_row") == F.col("_r2"))
    both = ids.join(sums.withColumnsRenamed({"_key": "_k2", "_row": "_r2"}), on, "left")
    n = F.coalesce(F.col("n") / F.col("_times"), F.lit(0.0))
    logits = [F.lit(math.log(q)) + F.coalesce(F.col(f"s{i}") / F.col("n") * F.least(n, F.lit(evidence)), F.lit(0.0)) for i, q in enumerate(prior)]
    with_logits = both.select("_key", "_row", "_times", n.cast("long").alias("n_tokens"), F.array(*logits).alias("l"))
    shifted = with_logits.withColumn("e", F.expr("transform(l, x -> exp(x - array_max(l)))"))
    p = F.expr("transform(e, x -> x / aggregate(e, 0D, (a, y) -> a + y))")
    return domains, materialize(shifted.select("_key", "_row", "_times", "n_tokens", p.alias("p")), "posteriors")


def _solve(m: list[list[float]], v: list[float]) -> list[float]:
    """The solution of a small symmetric system by elimination with pivoting; a slight ridge keeps it regular."""
    n = len(v)
    ridge = 1e-9 * max(max(m[i][i] for i in range(n)), 1e-12)
    a = [[*row, v[i]] for i, row in enumerate(m)]
    for i in range(n):
        a[i][i] += ridge
    for i in range(n):
        k = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[k] = a[k], a[i]
        for r in range(n):
            if r != i and a[r][i]:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i])]
    return [a[i][n] / a[i][i] for i in range(n)]


@dataclass
class Fit:
    """``rates``: the posteriors' table with a column ``rate``; the targets, the totals reached, and rounds taken."""

    rates: DataFrame
    target: list[float]
    reached: list[float]
    rounds: int
    converged: bool


def fit_rates(post: DataFrame, weights: list[float], total: float | None = None, rounds: int = 2000, tolerance: float = 1e-7) -> Fit:
    """Rates >= 0 for the rows of ``post`` (n_tokens, _times, p) whose totals by domain come to ``weights``' shares of ``total`` (null: what there is)."""
    d = len(weights)
    mass = F.col("n_tokens").cast("double") * F.col("_times")
    pairs = [(i, j) for i in range(d) for j in range(i, d)] if d <= GRAM else []
    first = [x or 0.0 for x in post.agg(*[F.sum(mass * F.col("p")[i]) for i in range(d)], *[F.sum(mass * F.col("p")[i] * F.col("p")[j]) for i, j in pairs]).first()]
    here, flat = first[:d], first[d:]
    gram = [[0.0] * d for _ in range(d)]
    for (i, j), x in zip(pairs, flat):
        gram[i][j] = gram[j][i] = x
    total = sum(here) if total is None else total
    target = [total * w / (sum(weights) or 1.0) for w in weights]

    def misfit(x: list[float]) -> float:
        return sum(abs(a - b) for a, b in zip(x, target))

    def step(gap: list[float]) -> list[float]:
        return _solve(gram, gap) if pairs else [g / m if m > 0 else 0.0 for g, m in zip(gap, first)]

    def misfit_squared(x: list[float]) -> float:
        gap = [a - b for a, b in zip(x, target)]
        return sum(g * w for g, w in zip(gap, step(gap)))

    enough = tolerance * max(total, 1.0)
    names, spark = post.columns, post.sparkSession
    state = post.withColumn("rate", F.lit(1.0)).withColumn("_ahead", F.lit(1.0))
    ahead, pace, written, nearest, since, done = list(here), 1.0, None, misfit_squared(here), 0, 0
    for done in range(1, rounds + 1):
        if misfit(here) <= enough or since >= 5 * KEEP:
            done -= 1
            break
        by = step([a - b for a, b in zip(ahead, target)])
        move = sum((F.col("p")[i] * F.lit(by[i]) for i in range(1, d)), F.col("p")[0] * F.lit(by[0]))
        moved = state.withColumn("_next", F.greatest(F.lit(0.0), F.col("_ahead") - move))
        now = [x or 0.0 for x in moved.agg(*[F.sum(mass * F.col("_next") * F.col("p")[i]) for i in range(d)]).first()]
        far = misfit_squared(now)
        if far > misfit_squared(here):
            pace = 1.0
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        lead = (pace - 1) / faster
        state = moved.select(*names, F.col("_next").alias("rate"), (F.col("_next") + (F.col("_next") - F.col("rate")) * lead).alias("_ahead"))
        ahead, here, pace = [a + (a - b) * lead for a, b in zip(now, here)], now, faster
        since = 0 if far < 0.999 * nearest else since + 1
        nearest = min(nearest, far)
        if done % KEEP == 0:
            state, was = materialize(state, "rates"), written
            written = state
            if was is not None:
                remove(spark, was)
    return Fit(state.drop("_ahead"), target, here, done, misfit(here) <= enough)


def tempered(post: DataFrame, d: int, power: float) -> list[float]:
    """Weights of the domains: their expected token shares raised to a power (1 keeps the mix, 0 levels it)."""
    got = post.agg(*[F.sum(F.col("n_tokens").cast("double") * F.col("_times") * F.col("p")[i]) for i in range(d)]).first()
    return [(x or 0.0) ** power for x in got]


RESULTS = ["n_tokens", "domain", "posterior", "rate", "max_rate", "draw"]


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, power: float = 0.8, total: float | None = None, seed: int = 17, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with n_tokens, domain (the likeliest), posterior, rate, max_rate and draw (uniform in [0, 1), by seeded hash of the id)."""
    domains, post = posteriors(docs, labelled, seed=seed, text=text, key=key)
    w = [weights.get(d, 0.0) for d in domains] if weights is not None else tempered(post, len(domains), power)
    fit = fit_rates(post, w, total)
    if not fit.converged:
        missed = {x: (round(a), round(b)) for x, a, b in zip(domains, fit.target, fit.reached) if abs(a - b) > 1e-3 * max(sum(fit.target), 1.0)}
        warnings.warn(f"after {fit.rounds} rounds domains miss their targets (target, reached): {missed}", stacklevel=2)
    top = F.expr("array_position(p, array_max(p))").cast("int")
    rated = materialize(fit.rates.select(F.col("_key").alias("_k2"), F.col("_row").alias("_r2"), "n_tokens", F.element_at(F.array(*[F.lit(x) for x in domains]), top).alias("domain"), F.array_max("p").alias("posterior"), "rate"), "rates")
    most = rated.agg(F.max("rate")).first()[0]
    kept = [c for c in docs.columns if c not in RESULTS]
    own = [f"_c{i}" for i in range(len(kept))]  # the table's columns can't clash with the working ones
    k = F.col(f"`{key}`")
    draw = F.conv(F.substring(seeded_hash(seed + 1, key), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(kept, own)], k.alias("_k1"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("_r1"), draw.alias("draw"))
    out = rows.join(rated, F.col("_k1").eqNullSafe(F.col("_k2")) & (F.col("_r1") == F.col("_r2")))
    return out.select(*[F.col(o).alias(c) for c, o in zip(kept, own)], "n_tokens", "domain", "posterior", "rate", F.lit(most).cast("double").alias("max_rate"), "draw")
