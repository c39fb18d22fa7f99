import hashlib
from collections import Counter

import numpy as np
from llm_cases import documents, nothing, spaced

from blotter.llm.fingerprints import Sampler, compared, edited, fingerprints, likeness


def bag(text):
    words = spaced(text)
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def generalised_jaccard(a, b):
    one, two = bag(a), bag(b)
    both = set(one) | set(two)
    return sum(min(one[t], two[t]) for t in both) / sum(max(one[t], two[t]) for t in both) if both else 1.0


def test_compared_with_the_definition(spark):
    docs = documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    found = {r.doc_id: r for r in compared(docs).collect()}
    assert len(found) == len(rows)
    for (id_, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        new, r = edited(text, following), found[id_]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert abs(r.near_edited - generalised_jaccard(text, new)) < 0.3
        assert abs(r.near_next - generalised_jaccard(text, following)) < 0.3
    prints = {r.doc_id: r.fingerprint for r in found.values()}
    assert prints[0] == prints[36] == prints[37] and prints[30] == prints[31] == ""
    assert {r.doc_id: r.fingerprint for r in fingerprints(docs).collect()} == prints


def test_every_row_comes_back(spark):
    docs = documents(spark)
    assert compared(docs).count() == docs.count()
    assert compared(nothing(spark)).count() == 0
    one = spark.createDataFrame([(5, "a b")], "doc_id long, text string")
    assert compared(one).first()["near_next"] == 1.0


def test_collision_rate_is_the_similarity():
    rng = np.random.default_rng(1)
    sampler = Sampler(4096)
    terms = rng.integers(1, 2**63, 40).astype(np.uint64)
    for shift in (0, 3, 10):
        one = np.repeat(terms[:30], rng.integers(1, 9, 30))
        two = np.repeat(terms[shift : shift + 30], rng.integers(1, 9, 30))
        a, b = Counter(one.tolist()), Counter(two.tolist())
        true = sum(min(a[t], b[t]) for t in terms.tolist()) / sum(max(a[t], b[t]) for t in terms.tolist())
        assert abs(likeness(sampler.sample(one), sampler.sample(two)) - true) < 0.04
