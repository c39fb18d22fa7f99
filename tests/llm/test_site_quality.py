import math
import random
from collections import defaultdict

import pytest
from llm_cases import documents, nothing
from pyspark.sql import functions as F

from blotter.llm.site_quality import site_quality, strength


def test_sparse_sites_follow_what_is_above(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1200):
        host = rng.choice(["good.org", "good.org", "bad.org"])
        path = rng.choice(["/a", "/b"])
        good = rng.random() < (0.9 if host == "good.org" else 0.2)
        words = [rng.choice(["tree", "river", "stone", "cloud"] if good or rng.random() < 0.3 else ["buy", "now", "win", "cash"]) for _ in range(12)]
        rows.append((i, " ".join(words), host, path))
        if i % 2:
            labels.append((i, int(good)))
    rows += [(5000, None, "good.org", "/new"), (5001, None, "bad.org", "/new"), (5002, None, "new.org", "/")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    told = site_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("host"), F.col("path"))
    found = {r.doc_id: r for r in told.collect()}
    assert len(found) == len(rows)
    assert found[5000].quality > found[5002].quality > found[5001].quality and found[5000].evidence == 0
    right = [found[i].keep == bool(good) for i, good in labels]
    assert sum(right) > 0.85 * len(right)


def test_strength_tells_noise_from_difference(spark):
    same = spark.createDataFrame([(0.5, 100.0, 0.5)] * 20, "mean double, n double, above double")
    apart = spark.createDataFrame([(0.1, 100.0, 0.5), (0.9, 100.0, 0.5)] * 10, "mean double, n double, above double")
    assert same.agg(strength(same)).first()[0] > 1000 and apart.agg(strength(apart)).first()[0] == pytest.approx(1, abs=1)


def test_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (2, None), (None, 1), (99, 0)], "doc_id long, quality int")
    told = site_quality(docs, labels, docs["source"], docs["`a.b`"])
    assert told.count() == docs.count() and told.filter("quality is null or not quality between 0 and 1").count() == 0
    none = nothing(spark)
    assert site_quality(none, labels.limit(0), none["source"], none["lang"]).count() == 0


def spread(groups):
    """Beta strength of groups (rate, rows, rate above) by moments."""
    n = sum(g[1] for g in groups)
    m = sum(k * above for _, k, above in groups) / n
    noise = sum(above * (1 - above) for *_, above in groups)
    seen = sum(k * (mean - above) ** 2 for mean, k, above in groups) - noise
    between = max(seen / max(n - sum(k * k for _, k, _ in groups) / n, 1e-9), 1e-12)
    return min(max(m * (1 - m) / between - 1, 1.0), 1e6)


def test_posteriors_by_brute_force(spark):
    rng = random.Random(8)
    rows, labels = [], {}
    for i in range(300):
        host, path = rng.choice(["a", "a", "a", "b", None]), rng.choice(["/x", "/y", None])
        good = rng.random() < (0.8 if host == "a" else 0.3)
        rows.append((i, " ".join(rng.choice(["tree", "river"] if good else ["buy", "win"]) for _ in range(6)) if i % 9 else None, host, path))
        if i % 2:
            labels[i] = int(good)
    rows.append((900, "tree", "alone", "/z"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    told = {r.doc_id: r for r in site_quality(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), F.col("host"), F.col("path")).collect()}
    prior = sum(labels.values()) / len(labels)
    says = {i: labels.get(i, 1 / (1 + math.exp(-(r.evidence + math.log(prior / (1 - prior)))))) for i, r in told.items()}
    hosts, paths = defaultdict(list), defaultdict(list)
    for i, r in told.items():
        hosts[r.host].append(i)
        paths[r.host, r.path].append(i)

    def mean(ids):
        return sum(says[i] for i in ids) / len(ids)

    rate = mean(says)
    of_hosts = spread([(mean(ids), len(ids), rate) for ids in hosts.values()])
    posterior = {h: (sum(says[i] for i in ids) + of_hosts * rate) / (len(ids) + of_hosts) for h, ids in hosts.items()}
    of_paths = spread([(mean(ids), len(ids), posterior[h]) for (h, _), ids in paths.items()])
    for i, r in told.items():
        others = [j for j in hosts[r.host] if j != i]
        host_rate = (sum(says[j] for j in others) + of_hosts * rate) / (len(others) + of_hosts)
        near = [j for j in paths[r.host, r.path] if j != i]
        path_rate = (sum(says[j] for j in near) + of_paths * host_rate) / (len(near) + of_paths)
        quality = 1 / (1 + math.exp(-(r.evidence + math.log(path_rate / (1 - path_rate)))))
        assert (r.host_rate, r.path_rate, r.quality) == pytest.approx((host_rate, path_rate, quality), rel=1e-6)
    assert told[900].host_rate == pytest.approx(rate)
