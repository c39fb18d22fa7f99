import random
from itertools import combinations

from llm_cases import documents, nothing, spaced

from blotter.llm import near_dups
from blotter.llm.near_dups import keep_one, near_duplicates


def shingle_set(text):
    words = spaced(text)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_force(rows, share):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingle_set(t) for i, t in rows}
    for (a, x), (b, y) in combinations(sets.items(), 2):
        if x and y and 100 * len(x & y) >= share * len(x | y):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def found(docs, **settings):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, **settings).collect()}


def test_against_brute_force(spark):
    docs = documents(spark).filter("doc_id is not null")
    rows = [(r.doc_id, r.text) for r in docs.dropDuplicates(["doc_id"]).collect()]
    assert found(docs, share=(85, 100)) == brute_force(rows, 85)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "LEAF", 8)
    rng = random.Random(5)
    words = [f"w{rng.randrange(300)}" for _ in range(400)]
    rows = []
    for i in range(60):  # one large group of near copies
        changed = list(words)
        changed[rng.randrange(400)] = f"new{i}"
        rows.append((i, " ".join(changed)))
    passage = " ".join(words[:60])
    for i in range(100, 140):  # one common passage in unlike documents
        rows.append((i, passage + " " + " ".join(f"v{rng.randrange(5000)}" for _ in range(60))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, share=(85, 100)) == brute_force(rows, 85)


def test_members_of_large_nodes_meet_all_others(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "LEAF", 32)
    monkeypatch.setattr(near_dups, "LOAD", 32 * 400)
    rng = random.Random(9)
    words = [f"w{rng.randrange(3000)}" for _ in range(400)]
    rows = [(0, " ".join(words))]
    for i in range(1, 200):  # a star: copies like the original but not like one another
        changed = list(words)
        for k, at in enumerate(rng.sample(range(8, 392, 8), 6)):
            changed[at] = f"star{i}x{k}"
        rows.append((i, " ".join(changed)))
    chain = [f"c{rng.randrange(3000)}" for _ in range(400)]
    for i in range(300, 380):  # a chain: each like the one before and the one after
        chain[(i - 300) * 4 : (i - 300) * 4 + 24] = [f"chain{i}x{k}" for k in range(22)]
        rows.append((i, " ".join(chain)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    stars = [shingle_set(t) for i, t in rows if 0 < i < 50]
    assert all(100 * len(x & y) < 85 * len(x | y) for x, y in combinations(stars, 2))
    assert found(docs, share=(85, 100)) == brute_force(rows, 85)


def test_rows_without_id_repeats_and_empty_tables(spark):
    docs = documents(spark)
    told = near_duplicates(docs)
    assert told.count() == docs.count()
    without = told.filter("doc_id is null").collect()
    assert {(r.component_id, r.kept) for r in without} == {(2, False), (None, True)}
    assert near_duplicates(nothing(spark)).count() == 0
    stay = keep_one(docs)
    assert stay.columns == docs.columns
    ids = [r.doc_id for r in stay.filter("doc_id is not null").collect()]
    assert len(ids) == len(set(ids)) and {0, 3} <= set(ids) and not {36, 37} & set(ids)


def test_an_id_at_unlike_texts_is_reduced_in_each_group_alone(spark):
    unlike = [" ".join(f"{name}{i}" for i in range(200)) for name in "abcdefgh"]
    rows = [(1, unlike[0]), (2, unlike[1]), (2, unlike[2]), (2, unlike[2]), (2, unlike[2] + " end")]
    for i, text in enumerate(unlike[3:], 3):  # each of these ids also stands at a copy of the first text
        rows += [(i, text), (i, unlike[0])]
    rows += [(20, ""), (20, None), (20, "")]
    stay = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r.doc_id, (r.text or "").removesuffix(" end")) for r in stay)
    assert found == sorted([(1, unlike[0]), (2, unlike[1]), (2, unlike[2]), *enumerate(unlike[3:], 3), (20, ""), (20, "")])
