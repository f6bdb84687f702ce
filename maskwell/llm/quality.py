"""Quality classifier: document evidence with empirical-Bayes priors of site and path.

1. A logistic regression over surface features of the whole text, fitted on labelled
   documents, gives the evidence of each document.
2. Grouped aggregation over all documents gives the mean of each host and of each path of
   a host. Both shrink: a path toward its host and a host toward the global mean, by a
   strength that the method of moments estimates from the spread between groups.
3. The posterior of a path replaces the global prior in the odds of its documents. Each
   document's own evidence is taken out of its sums first: it enters its odds once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.shared import materialize

FEATURES = (
    "log_bytes",
    "log_words",
    "symbol_share",
    "digit_share",
    "upper_share",
    "bang_share",
    "pipe_share",
    "word_bytes",
    "distinct_share",
    "top_word_share",
    "repeat_share",
    "line_repeat_share",
)
_SYMBOLS = b"#&%$*^~_=<>{}[]\\@"
_DIGITS = b"0123456789"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def surface_features(text: str | None) -> list[float]:
    """The features named in ``FEATURES``; null and empty texts give zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    size, n = len(raw), len(words)

    def share(chars: bytes) -> float:
        return (size - len(raw.translate(None, chars))) / size

    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [line for line in raw.split(b"\n") if line]
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return [
        math.log1p(size),
        math.log1p(n),
        share(_SYMBOLS),
        share(_DIGITS),
        share(_UPPER),
        share(b"!"),
        share(b"|"),
        min(64.0, size / n),
        len(counts) / n,
        max(counts.values()) / n,
        repeats / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
    ]


@dataclass(frozen=True)
class QualityModel:
    """Logistic regression on standardised features. Without training rows it answers 0.5."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25) -> QualityModel:
    """Newton's method with an L2 penalty on the weights."""
    width = len(FEATURES)
    if not len(y) or y.min() == y.max():
        # One class or no row: only the smoothed rate is known.
        rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(rate / (1 - rate))))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.clip((x - mean) / scale, -8, 8)
    z = np.hstack((z, np.ones((len(z), 1))))
    w = np.zeros(width + 1)
    ridge = np.diag(np.append(np.full(width, penalty), 1e-6))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return QualityModel(mean, scale, w[:-1], float(w[-1]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = 20_000,
) -> QualityModel:
    """Fit on labelled documents, at most ``max_rows`` of them (the ids of smallest hash).

    The bound keeps the ids and feature rows on the driver small; labels that are null or
    neither 0 nor 1 are left out, of repeated ids the smallest label counts.
    """
    named = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    named = named.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    named = named.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    # max_rows bounds this broadcast.
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(named), "id")

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([surface_features(t) for t in texts])

    rows = known.select("y", features("text").alias("x"), F.xxhash64("id", "text").alias("h"))
    # Repeated ids can give more rows than labels: the same bound again.
    rows = rows.orderBy("h", "y").limit(max_rows).collect()
    x = np.array([r.x for r in rows], dtype=float).reshape(-1, len(FEATURES))
    return fit_logistic(x, np.array([r.y for r in rows], dtype=float))


def evidence(docs: DataFrame, model: QualityModel, text_col: str = "text") -> Column:
    """Probability of good quality of each whole text, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        rows = np.array([surface_features(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))
        return pd.Series(shared.value.probability(rows))

    return probability(F.col(text_col))


def _strength(groups: DataFrame, n: str, mean: str, prior: str, within: str) -> float:
    """Pseudo-count of the prior: the variance within groups over that between them.

    One aggregated row: the spread of group means around their priors, less what the
    sampling of each group explains.
    """
    w, d = F.col(n), F.col(mean) - F.col(prior)
    row = groups.agg(
        F.sum(w).alias("n"),
        F.count("*").alias("g"),
        F.sum(w * d * d).alias("between"),
        F.sum(within).alias("within"),
    ).first()
    if not row.n:
        return 1.0
    inner = max((row.within or 0.0) / row.n, 1e-9)
    outer = max((row.between or 0.0) / row.n - inner * row.g / row.n, 0.0)
    return float(min(1e6, max(1.0, inner / outer if outer > 1e-12 else 1e6)))


@dataclass(frozen=True)
class SitePriors:
    """Sums of evidence per ``host`` and ``path`` and how strongly they shrink.

    ``sums`` has ``host``, ``path``, ``n``, ``s`` of the path and ``host_n``, ``host_s`` of its host; ``mean`` is
    that of all documents, ``of_hosts`` and ``of_paths`` are the pseudo-counts of the priors.
    """

    sums: DataFrame
    mean: float
    of_hosts: float
    of_paths: float

    def posteriors(self, own: Column | float = 0.0, counted: int = 0) -> tuple[Column, Column]:
        """(mean of the host, mean of the path) in rows of ``sums``, without ``counted`` documents of evidence ``own``."""
        own, one = own if isinstance(own, Column) else F.lit(own), F.lit(counted)
        host = (F.col("host_s") - own + self.of_hosts * F.lit(self.mean)) / (F.col("host_n") - one + self.of_hosts)
        return host, (F.col("s") - own + self.of_paths * host) / (F.col("n") - one + self.of_paths)


def site_priors(scored: DataFrame) -> SitePriors:
    """Sums and strengths from ``scored`` (``host``, ``path``, ``p``). A null host or path is a group of its own.

    The strengths come from the spread of the groups around their priors: without it, as in an
    empty table or with one group, a prior counts for a million documents.
    """
    paths = materialize(
        scored.groupBy("host", "path").agg(
            F.count("p").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")
        ),
        "paths",
    )
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = float(total.s / total.n) if total.n else 0.5

    def within(frame: DataFrame) -> DataFrame:
        frame = frame.withColumn("m", F.col("s") / F.col("n"))
        return frame.withColumn("within", F.col("ss") - F.col("n") * F.col("m") * F.col("m"))

    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    hosts = materialize(within(hosts).withColumn("prior", F.lit(mean)), "hosts")
    of_hosts = _strength(hosts, "n", "m", "prior", "within")
    slim = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    # The size of the host table decides the join: broadcast below the session's threshold.
    joined = paths.join(slim, paths["host"].eqNullSafe(slim["host"])).drop(slim["host"])
    joined = materialize(within(joined), "paths")
    prior = (F.col("host_s") + of_hosts * F.lit(mean)) / (F.col("host_n") + of_hosts)
    of_paths = _strength(joined.withColumn("prior", prior), "n", "m", "prior", "within")
    return SitePriors(joined.select("host", "path", "n", "s", "host_n", "host_s"), mean, of_hosts, of_paths)


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def with_quality(
    docs: DataFrame,
    model: QualityModel,
    host: str = "source",
    path: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """``row`` (all columns of ``docs``), ``p_text``, ``host_mean``, ``path_mean``, ``quality``.

    ``host`` and ``path`` are SQL expressions over ``docs``, such as
    ``parse_url(url, 'HOST')``. The odds of a document are its text odds times the odds of
    its path over the global odds, where ``host_mean`` and ``path_mean`` are those of the other
    documents: one alone on its site gets the global prior. Rows are never dropped: null texts
    get the evidence of an empty text, null hosts and paths form groups, repeated rows all
    count. Columns of ``docs`` with the names used here stay inside ``row``. An empty table
    gives an empty result.
    """
    parts = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.expr(host).cast("string").alias("host"),
        F.expr(path).cast("string").alias("path"),
    )
    scored = parts.withColumn("p", evidence(docs, model, f"row.{text_col}"))
    priors = site_priors(materialize(scored.select("host", "path", "p"), "evidence"))
    sums = priors.sums.withColumnsRenamed({"host": "h", "path": "q"})
    joined = scored.join(sums, scored["host"].eqNullSafe(sums["h"]) & scored["path"].eqNullSafe(sums["q"]))
    host_mean, path_mean = priors.posteriors(F.col("p"), 1)
    rated = joined.select("row", F.col("p").alias("p_text"), host_mean.alias("host_mean"), path_mean.alias("path_mean"))
    odds = _logit(F.col("p_text")) + _logit(F.col("path_mean")) - _logit(F.lit(priors.mean))
    return rated.withColumn("quality", 1 / (1 + F.exp(-odds)))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.5, **options) -> DataFrame:
    """``docs`` without the documents whose quality is below ``threshold``."""
    return with_quality(docs, model, **options).where(F.col("quality") >= threshold).select("row.*")

