import random
import re
from collections import Counter

import numpy as np
import pytest

from blotter.llm import phrases
from llm_cases import FIELDS, documents, lowered, nothing


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text))]


def by_definition(rows, threshold, most):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang or "und", tuple(words[i : i + k])] += 1
    often = {p: c for p, c in counts.items() if c >= threshold}
    longer = {p: c for p, c in often.items() if len(p[1]) > 1}
    within = {}
    for (lang, p), c in longer.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                key = lang, p[i : i + k]
                within[key] = max(within.get(key, 0), c)
    found = []
    for (lang, p), a in longer.items():
        if 100 * within.get((lang, p), 0) < 100 * a:
            cuts = [(1000 * a * n[lang] // (often[lang, p[:k]] * often[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((lang, " ".join(p), a, often[lang, p[:k]], often[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {f[0] for f in found}:
        mine = sorted((f for f in found if f[0] == lang), key=lambda f: (-f[6], -f[2], f[1].encode()))[:most]
        ranked += [(lang, i, *f[1:]) for i, f in enumerate(mine, 1)]
    return sorted(ranked)


def found(docs, **options):
    return sorted(tuple(r) for r in phrases.collocations(docs, **options).collect())


@pytest.mark.parametrize("threshold,most,shards", [(5, 2000, 3), (9, 7, 1)])
def test_equals_definition(spark, monkeypatch, threshold, most, shards):
    monkeypatch.setattr(phrases, "WINDOW", 300)
    monkeypatch.setattr(phrases, "HELD", 500)
    monkeypatch.setattr(phrases, "TOLD", 50)
    rng = random.Random(threshold)
    common = "new york city hall is open . every day we go\tto new york   city , über alles !".split(" ")
    texts = [" ".join(rng.choice(common) for _ in range(rng.randrange(40))) for _ in range(60)] + ["New  York\tcity hall"] * 40
    docs = documents(spark).repartition(5)
    more = spark.createDataFrame([(i, t, rng.choice(["en", "de", None]), None, 1, 2, "s", "k", "q", "ab") for i, t in enumerate(texts)], FIELDS)
    docs = docs.unionByName(more)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    expected = by_definition(rows, threshold, most)
    assert len({r[0] for r in expected}) == 3 and any(" ".join(r[2].split()[:3]) == "new york city" for r in expected) or most < 10
    assert found(docs, threshold=threshold, most=most, shards=shards) == expected


def test_nothing(spark):
    assert found(nothing(spark), threshold=2) == []


def test_crowded_tables_change_nothing(spark, monkeypatch):
    """What a full bit table lets through by chance is counted in vain."""
    docs = documents(spark)
    expected = found(docs, threshold=4)
    monkeypatch.setattr(phrases, "_LEAST_BITS", 4)
    monkeypatch.setattr(phrases, "_MOST_BITS", 5)
    assert found(docs, threshold=4) == expected == by_definition([(r["lang"], r["text"]) for r in docs.collect()], 4, 2000)


def test_a_late_phrase_gets_its_whole_cycle(spark):
    """A pair found in the last shards alone is counted in those before too."""
    texts = ["a b"] * 3 + ["b", "a", "c"] * 20 + ["a b c d e f"] * 9
    docs = spark.createDataFrame([(i, t, "en", None, 1, 2, "s", "k", "q", "ab") for i, t in enumerate(texts)], FIELDS).coalesce(1)
    rows = {tuple(r[:3]): r[3] for r in (tuple(x) for x in phrases.frequent_phrases(docs, 9).collect())}
    assert rows["en", 2, "a b"] == 12 and rows["en", 5, "a b c d e"] == 9 and rows["en", 0, ""] == 6 + 60 + 54


def test_windows_cover_all_words(monkeypatch):
    rng = random.Random(2)
    for window in (1, 7, 64, 10_000):
        monkeypatch.setattr(phrases, "WINDOW", window)
        for _ in range(30):
            text = "".join(rng.choice(["ab", "c", "  ", "\t", " ", ".", "\n", "é", " xyz "]) for _ in range(60)).encode()
            words, spans = [], Counter()
            for part, first, ends, number, piece, new in phrases.windows(text):
                assert len(first) == len(ends) == len(number) == len(piece)
                words += [part[a:b] for a, b in zip(first[new:], ends[new:])]
                for k in (2, 3, 5):
                    for i in range(max(0, new - k + 1), len(first) - k + 1):
                        if piece[i] == piece[i + k - 1]:
                            spans[b" ".join(part[first[i] : ends[i + k - 1]].split())] += 1
            every = pieces(text.decode())
            assert [w.encode() for p in every for w in p] == words
            assert spans == Counter(" ".join(p[i : i + k]).encode() for p in every for k in (2, 3, 5) for i in range(len(p) - k + 1))


def test_scores_beyond_64_bits(spark):
    product = spark.sql(
        "select (cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as s "
        "from values (90000000000L, 900000000000001L, 90000000001L, 90000000007L) t(a, n, l, r)"
    ).first()["s"]
    assert product == 1000 * 90000000000 * 900000000000001 // (90000000001 * 90000000007)
    assert np.int64(product) == product


def test_old_counts_are_not_summed_again(spark):
    """Of the first step of a cycle only new phrases count; before, all its rows were exchanged twice."""
    fields = "number long, occurrences long, first boolean"
    steps = [spark.createDataFrame(rows, fields) for rows in ([(1, 60, True), (9, 60, False)], [(1, 60, False), (9, 60, False)])]
    assert [tuple(r) for r in phrases._reached(steps, None, 4, 100, 2).collect()] == [(1, 4, 120)]
    assert len(phrases._reached(steps, None, 4, 100, 3).collect()) == 2


def test_slices_change_nothing_and_leave_no_shuffle(spark, monkeypatch):
    """Numbers are summed slice by slice; what a step shuffled, all of it at once before, is gone when the step ends."""
    docs, files = documents(spark), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for f in files.getAllFiles().mkString(" ").split() if f.endswith(".data")}

    expected, labels, left = found(docs, threshold=4), [], []
    before = shuffled()

    def watched(df, label, *by):
        told = stage(df, label, *by)
        labels.append(label)
        left.append(len(shuffled() - before))
        return told

    stage = phrases.stage
    monkeypatch.setattr(phrases, "stage", watched)
    monkeypatch.setattr(phrases, "SLICE_ROWS", 1)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    earlier = spark.conf.get(setting, None)
    assert found(docs, threshold=4) == expected
    assert labels.count("phrases-reached-2") == phrases.MOST_SLICES
    assert max(left[1:]) <= 12 and spark.conf.get(setting, None) == earlier
