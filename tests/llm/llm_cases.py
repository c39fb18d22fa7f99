"""Documents with awkward rows, and plain definitions that results are held against."""

import random
import re

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, text_key string, kept string, `a.b` string"


def sentence(rng, n):
    return " ".join(rng.choice(["the", "Of", "tree", "über", "x1", "and", "stone", "7", "river", "Cloud", "été", "lamp"]) + rng.choice(["", "", ".", ","]) for _ in range(n))


def documents(spark, seed=3):
    """Nulls, empty, blank and very long texts, copies, near copies, repeated rows, clashing columns."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(1, 60)) for _ in range(30)]
    long_ = sentence(rng, 4000)
    texts = base + [None, "", "   \n", "!!! ---", "a", "A", base[0], base[0], base[1].upper(), long_, long_ + " end", "x" * 3000 + " y", " nbsp x"]
    words = sentence(rng, 200).split()
    for _ in range(6):  # near copies
        changed = list(words)
        changed[rng.randrange(200)] = "other"
        texts.append(" ".join(changed))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s1", None]), 1, 2, "s", "k", "q", "ab") for i, t in enumerate(texts)]
    rows += [rows[3], (None, base[2], "en", None, None, None, None, None, None, None), (None, None, None, "s9", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, FIELDS)


def nothing(spark):
    return spark.createDataFrame([], FIELDS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def alphanumeric(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
