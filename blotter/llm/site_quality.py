"""Document quality from the text and from the site, by hierarchical empirical Bayes.

A logistic classifier of what a document's hashed words say on average and of a few measures of
its text, fitted on labelled documents, gives each document the log-odds of good quality. Every document adds what it says (its label, else its probability) to its
host and its path. The host's rate is the posterior mean of a beta distribution around the global
rate, the path's around its host's; their strengths are moment estimates of how much hosts, and
paths of a host, differ, so sparse sites are shrunk to what is above them. The log-odds of the path's
rate replace those of the global rate in the document's own; what the document itself says is left
out of the rates that judge it, so that neither its label nor its evidence counts twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.llm.tables import named
from blotter.llm.tokens import NOT_ALPHANUMERIC, SPACES, pieces, text_bytes
from blotter.staging import stage

FEATURE_BITS = 16
LABELLED_ROWS = 100_000
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6
_ALL = 1 << FEATURE_BITS
MEASURES = 5


def _cells(piece, i: int) -> np.ndarray:
    """Distinct hashed words of a row."""
    return np.unique(piece.words[piece.offsets[i] : piece.offsets[i + 1]] >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, _ALL + 1), np.int64)
    for batch in batches:
        good = batch.column(0).to_pylist()
        for piece in pieces(batch.column(1), NOT_ALPHANUMERIC):
            for i in range(len(piece)):
                found = _cells(piece, i)
                counts[int(good[piece.first + i]), found] += 1
                counts[int(good[piece.first + i]), _ALL] += len(found)
    for label in (0, 1):
        at = np.flatnonzero(counts[label])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), label), pa.int64()), pa.array(at, pa.int64()), pa.array(counts[label, at], pa.int64())], names=["label", "cell", "n"]
        )


def word_odds(labelled: DataFrame) -> np.ndarray:
    """Log-odds of each cell of hashed words between good and other documents, from rows (good, text).

    The driver gets two numbers for each of the ``2**FEATURE_BITS`` cells. Without rows of both
    kinds no word is evidence.
    """
    rows = labelled.mapInArrow(_cell_counts, "label long, cell long, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, _ALL + 1))
    counts[np.asarray(rows.column("label")), np.asarray(rows.column("cell"))] = np.asarray(rows.column("n"))
    if not counts[:, _ALL].all():
        return np.zeros(_ALL, np.float32)
    # Smoothed towards the overall rate of the cell, so that cells hardly met say little.
    overall = counts[:, :_ALL].sum(axis=0) / counts[:, _ALL].sum()
    rates = (counts[:, :_ALL] + 5 * overall + 1e-9) / (counts[:, _ALL:] + 5)
    odds = np.where(overall > 0, np.log(rates[1] / rates[0]), 0.0)
    return np.clip(odds, -3, 3).astype(np.float32)


def _measure(batches: Iterator[pa.RecordBatch], odds) -> Iterator[pa.RecordBatch]:
    """For each text what its words say on average, and how long, repetitive and wordy it is."""
    odds = odds.value
    for batch in batches:
        rows = []
        lengths = np.diff(text_bytes(batch.column(0))[0])
        spaced = [np.diff(piece.offsets) for piece in pieces(batch.column(0), SPACES)]
        spaced = np.concatenate(spaced) if spaced else lengths
        for piece in pieces(batch.column(0), NOT_ALPHANUMERIC):
            for i in range(len(piece)):
                found = _cells(piece, i)
                words = int(piece.offsets[i + 1] - piece.offsets[i])
                n = piece.first + i
                rows.append([float(odds[found].mean()) if words else 0.0, len(found) / max(1, words), np.log1p(words), words / max(1, spaced[n]), words / max(1, lengths[n])])
        measures = pa.array(rows, pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), measures], names=[*batch.schema.names[1:], "measures"])


def fit_evidence(measured: DataFrame) -> tuple[list[float], float]:
    """Coefficients and intercept, without the prior odds, of a logistic regression of ``good`` on ``measures``."""
    rows = measured.select(F.col("good").cast("double").alias("label"), array_to_vector("measures").alias("features"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return [0.0] * MEASURES, 0.0
    model = LogisticRegression(maxIter=50, regParam=1e-3).fit(rows)
    return [float(c) for c in model.coefficients], float(model.intercept) - float(np.log(counts[1.0] / counts[0.0]))


def strength(groups: DataFrame, mean: str = "mean", n: str = "n", above: str = "above") -> Column:
    """Moment estimate of the beta strength of groups' rates around those above them, as an aggregate.

    Of the weighted squared deviations what binomial noise explains is taken off; the rest is the
    variance m (1 - m) / (1 + strength) of the groups themselves.
    """
    m = F.sum(F.col(n) * F.col(above)) / F.sum(n)
    noise = F.sum(F.col(above) * (1 - F.col(above)))
    spread = F.sum(F.col(n) * F.pow(F.col(mean) - F.col(above), 2)) - noise
    between = F.greatest(spread / F.greatest(F.sum(n) - F.sum(F.col(n) * F.col(n)) / F.sum(n), F.lit(1e-9)), F.lit(1e-12))
    found = m * (1 - m) / between - 1
    return F.least(F.greatest(F.coalesce(found, F.lit(MOST_STRENGTH)), F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_quality(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    good_column: str = "quality",
    labelled_rows: int = LABELLED_ROWS,
) -> DataFrame:
    """One row per document: id, host, path, ``evidence`` (log-odds of the text), ``host_rate``, ``path_rate``, ``quality`` (0 to 1) and ``keep``.

    ``labels`` says of some ids whether they are good (1) or not (0); at most about
    ``labelled_rows`` of them are fitted on, chosen by ids' hashes. A null host or path is a site
    of its own. A null or wordless text is no evidence: its site decides. Where no label tells
    the classes apart, all rates are the global one. ``host_rate`` and ``path_rate`` are those of the
    other documents of the site, so they differ between its documents. Repeated rows count and appear as often as
    they stand there; of labels that repeat an id the worst counts.
    """
    spark = docs.sparkSession
    told = labels.filter(named(labels, id_column).isNotNull()).groupBy(named(labels, id_column).alias("of")).agg(F.min(named(labels, good_column)).cast("int").alias("good"))
    told = told.filter("good is not null")
    rows = docs.select(named(docs, text_column).alias("text"), named(docs, id_column).alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    bound = int(min(1.0, labelled_rows / max(1, told.count())) * (1 << 40))
    drawn = F.pmod(F.xxhash64("of", F.lit("fit")), F.lit(1 << 40))
    # Words are weighed on one half of the labelled rows, the classifier fitted on the other.
    words_half = told.filter((drawn < bound) & (drawn % 2 == 0))
    # An id and a label for each of at most about half of ``labelled_rows``: broadcast, so no text moves.
    odds = word_odds(rows.join(F.broadcast(words_half), F.col("id") == F.col("of")).select("good", "text"))
    kind = rows.schema["id"].dataType.simpleString()
    measure = partial(_measure, odds=spark.sparkContext.broadcast(odds))
    measured = rows.mapInArrow(measure, f"id {kind}, host string, path string, measures array<double>")
    measured = stage(measured.join(told, F.col("id") == F.col("of"), "left"), "measures")
    coefficients, intercept = fit_evidence(measured.filter((drawn < bound) & (drawn % 2 == 1)))
    says_text = sum((F.lit(c) * F.element_at("measures", i + 1) for i, c in enumerate(coefficients)), F.lit(intercept))
    evidence = F.when(F.element_at("measures", 3) > 0, says_text).otherwise(F.lit(0.0))
    prior = measured.agg((F.sum("good") / F.count("good")).alias("p")).first()["p"]
    prior = min(max(prior if prior is not None else 0.5, 1e-4), 1 - 1e-4)
    prior_odds = float(np.log(prior / (1 - prior)))

    says = F.coalesce(F.col("good").cast("double"), 1 / (1 + F.exp(-(F.col("evidence") + F.lit(prior_odds)))))
    scored = measured.select("id", "host", "path", "good", evidence.alias("evidence")).withColumn("says", says)
    paths = stage(scored.groupBy("host", "path").agg(F.avg("says").alias("mean"), F.count("*").cast("double").alias("n")), "paths")
    hosts = paths.groupBy("host").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    total = hosts.agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("rate")).first()["rate"]
    rate = min(max(total if total is not None else 0.5, 1e-4), 1 - 1e-4)
    of_hosts = hosts.withColumn("above", F.lit(rate)).agg(strength(hosts).alias("s")).first()["s"]
    hosts = hosts.withColumn("host_rate", (F.col("n") * F.col("mean") + of_hosts * rate) / (F.col("n") + of_hosts))
    hosts = hosts.select(F.col("host").alias("site"), "host_rate", F.col("n").alias("host_n"), F.col("mean").alias("host_mean"))
    joined = paths.join(hosts, paths["host"].eqNullSafe(hosts["site"])).withColumn("above", F.col("host_rate"))
    of_paths = joined.agg(strength(joined).alias("s")).first()["s"]
    sites = joined.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "n", "mean", "host_n", "host_mean")
    same = scored["host"].eqNullSafe(sites["of_host"]) & scored["path"].eqNullSafe(sites["of_path"])

    def others(n: str, mean: str, s: float, above: Column) -> Column:
        """The posterior mean of a site without the row itself."""
        return (F.col(n) * F.col(mean) - F.col("says") + s * above) / (F.col(n) - 1 + s)

    judged = scored.join(sites, same).withColumn("host_rate", others("host_n", "host_mean", of_hosts, F.lit(rate)))
    path_rate = others("n", "mean", of_paths, F.col("host_rate"))
    judged = judged.withColumn("path_rate", F.least(F.greatest(path_rate, F.lit(1e-4)), F.lit(1 - 1e-4)))
    quality = 1 / (1 + F.exp(-(F.col("evidence") + _odds(F.col("path_rate")))))
    return judged.select(F.col("id").alias(id_column), "host", "path", "evidence", "host_rate", "path_rate", quality.alias("quality"), (quality >= 0.5).alias("keep"))
