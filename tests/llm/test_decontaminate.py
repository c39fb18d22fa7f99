from llm_cases import alphanumeric, documents, nothing

from blotter.llm.decontaminate import contaminated, contamination, keep_clean


def expected(docs, items):
    windows = {}
    for item, text in items:
        words = alphanumeric(text)
        n = min(13, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(item)
    out = []
    for r in docs.collect():
        words, hit, found = alphanumeric(r.text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(words[i : i + n])]
        out.append((r.doc_id, len(words), len(hit), sorted(str(f) for f in found if f is not None)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    docs = documents(spark)
    texts = [r.text for r in docs.filter("doc_id in (3, 7, 39, 43)").collect()]
    items = [(1, texts[0]), (2, " ".join(texts[2].split()[50:90])), (3, "the stone"), (4, None), (5, "?!"), (6, texts[1]), (7, texts[1]), (None, "lamp and"), (10, "Of")]
    items.append((11, " ".join(texts[3].split()[:13])))
    benchmark = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    found = sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in contamination(docs, benchmark).collect()), key=repr)
    assert found == expected(docs, items)


def test_empty_tables_and_clean_rows(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, none).filter("n_hit > 0 or size(item_ids) > 0").count() == 0
    assert contamination(nothing(spark), none).count() == 0
    bench = spark.createDataFrame([(1, docs.filter("doc_id = 39").first()["text"])], "item_id long, text string")
    bad = {r.doc_id for r in contamination(docs, bench).filter(contaminated()).collect()}
    clean = keep_clean(docs, bench)
    assert 39 in bad and clean.columns == docs.columns
    assert clean.count() == docs.filter(~docs.doc_id.isin(list(bad)) | docs.doc_id.isNull()).count()
