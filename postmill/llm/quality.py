"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bound_batches, fresh, join_small
from postmill.session import cut

TRAIN_ROWS = 20_000
THRESHOLD = 0.5
FEATURES = 13

# --- document evidence -----------------------------------------------------------------------


UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS, SIGNS, ENDS, COMMAS = b"0123456789", b"#$%&*+=<>@^_~{}[]\\", b".!?", b",;:"
NO_LETTERS = bytes(range(65)) + bytes(range(91, 97)) + bytes(range(123, 128))


def features(text: str | None) -> list[float]:
    """FEATURES numbers between 0 and about 2 from the whole text; null, empty and blank texts give zeros.

    Counts are of UTF-8 bytes, all of a character beyond ASCII as letters.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * FEATURES
    n, w = len(raw), len(words)

    def share(chars: bytes) -> int:
        return n - len(raw.translate(None, chars))

    letters = len(raw.translate(None, NO_LETTERS))
    return [
        share(UPPER) / max(letters, 1), letters / n, share(SIGNS) / n * 4, raw.count(b"|") / w * 2, raw.count(b"!") / w, share(DIGITS) / n,
        min(share(ENDS) / w, 1.0), min(share(COMMAS) / w, 1.0), min(n / w / 20, 2.0), min(w / (raw.count(b"\n") + 1) / 100, 2.0),
        len(set(words)) / w, sum(map(eq, words, words[1:])) / w, math.log1p(w) / 12,
    ]


def fit(rows: list[tuple[list[float], int]], penalty: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton's method: FEATURES weights, the intercept, last the prior log-odds.

    Without rows of both classes the weights are zero and every document gets the prior.
    """
    y = np.array([r[1] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        prior = np.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0
        return np.array([0.0] * FEATURES + [prior, prior])
    x = np.column_stack([np.array([r[0] for r in rows], dtype=float), np.ones(len(y))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty * len(y))
    ridge[-1] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge + 1e-9), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w, np.log(y.sum() / (len(y) - y.sum())))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Fit on at most `train_rows` labelled documents, those with the smallest hash of their id.

    The bound is a parameter; everything else reads all rows. Labels with a null id or value are ignored,
    of several labels of one id the largest counts.
    """
    known = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    @F.pandas_udf("array<double>")
    def of_texts(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = join_small(own, cut(known), ["doc_id"], "inner").select(of_texts("text").alias("x"), "y")
    return fit([(list(r[0]), int(r[1])) for r in rows.limit(train_rows).collect()])


def evidence(text: Column, weights: np.ndarray) -> Column:
    """Log-odds of good quality from the document alone, between -12 and 12."""
    slopes, start = weights[:FEATURES], weights[FEATURES]

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], dtype=float).reshape(-1, FEATURES)
        return pd.Series(np.clip(x @ slopes + start, -12, 12))

    return score(text)


# --- host and path posteriors ------------------------------------------------------------------


def _probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def _log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: str, prior: str) -> float:
    """Pseudo-counts of a prior by the method of moments, between 2 and 10,000.

    Compares the spread of the groups' means around their prior with the spread within groups: groups that
    differ little give a strong prior. Two sums over all groups.
    """
    between, within, n = groups.agg(
        F.sum(F.col("n") * F.pow(F.col(mean) - F.col(prior), 2)), F.sum(F.col(prior) * (1 - F.col(prior))), F.count("*")
    ).first()
    if not n or not within:
        return 10_000.0
    ratio = between / within  # expected 1 when groups don't differ
    size = groups.agg(F.avg("n")).first()[0]
    tau = max(ratio - 1, 0) / max(size, 1)
    return float(min(10_000.0, max(2.0, 1 / tau - 1 if tau > 0 else 10_000.0)))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, p) rows to one row per (host, path): n, global_prior, host_posterior, path_posterior.

    A host's mean is shrunk towards the global mean, a path's mean towards its host's posterior, each by
    the pseudo-counts that the spread over all groups gives; sparse sites so stay near their prior. Sums
    are combined map-side, so a host with any share of the rows is a row per task. Nulls are groups.
    """
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")))
    rows, good = paths.agg(F.sum("n"), F.sum("good")).first()
    prior = min(max((good + 1) / (rows + 2), 1e-4), 1 - 1e-4) if rows else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("prior", F.lit(prior))
    hosts = cut(hosts.withColumn("mean", F.col("good") / F.col("n")))
    a = _strength(hosts, "mean", "prior")
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("good") + a * F.col("prior")) / (F.col("n") + a)).alias("host_posterior"))
    joined = cut(
        paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host").withColumn("mean", F.col("good") / F.col("n"))
    )
    b = _strength(joined, "mean", "host_posterior")
    return joined.select(
        "host", "path", "n", F.lit(prior).alias("global_prior"), "host_posterior",
        ((F.col("good") + b * F.col("host_posterior")) / (F.col("n") + b)).alias("path_posterior"),
    )


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    path_col: str = "lang", threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """`docs` plus q_evidence, q_host, q_path, q_score and q_keep (score >= threshold).

    log-odds of the score = evidence + log-odds of the path's posterior - log-odds of the global prior: the
    site replaces the prior that the evidence was trained with. Null hosts and paths are sites of their own;
    null and empty texts are judged by their zero features; without labels every score is about one half and
    all is kept. Repeated rows are judged alike. Columns that are named like the new ones are replaced.
    """
    weights = train(bound_batches(docs), labels, id_col, text_col, train_rows)
    col = fresh("quality")
    host, path, none, e = map(col, "host path none evidence".split())
    scored = docs.withColumn(e, evidence(F.col(text_col), weights))
    sites = site_posteriors(scored.select(F.col(host_col).alias("host"), F.col(path_col).alias("path"), _probability(F.col(e)).alias("p")))
    flags = F.concat(F.col("host").isNull().cast("string"), F.col("path").isNull().cast("string"))
    side = cut(sites.select(
        F.coalesce(F.col("host").cast("string"), F.lit("")).alias(host), F.coalesce(F.col("path").cast("string"), F.lit("")).alias(path),
        flags.alias(none), "global_prior", F.col("host_posterior").alias("q_host"), F.col("path_posterior").alias("q_path"),
    ))
    keyed = scored.withColumns({
        host: F.coalesce(F.col(host_col).cast("string"), F.lit("")), path: F.coalesce(F.col(path_col).cast("string"), F.lit("")),
        none: F.concat(F.col(host_col).isNull().cast("string"), F.col(path_col).isNull().cast("string")),
    })
    new = ["q_evidence", "q_host", "q_path", "q_score", "q_keep"]
    keep = [c for c in docs.columns if c not in new]
    joined = join_small(keyed.select(*keep, host, path, none, e), side.withColumnRenamed("global_prior", col("prior")), [host, path, none], "inner")
    score = _probability(F.col(e) + _log_odds(F.col("q_path")) - _log_odds(F.col(col("prior"))))
    return joined.select(*keep, F.col(e).alias("q_evidence"), "q_host", "q_path", score.alias("q_score")).withColumn(
        "q_keep", F.col("q_score") >= F.lit(threshold) - 1e-12
    )
