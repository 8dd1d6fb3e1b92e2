import random
import zlib

import cases
import numpy as np
import pytest
from pyspark.sql import types as T

from tilewright.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("bound", [1, 2])
def test_automaton_finds_what_edit_distance_finds(bound):
    r = random.Random(bound)
    word = lambda n, m: "".join(r.choice("abc") for _ in range(r.randrange(n, m)))
    terms = sorted({word(3, 10) for _ in range(40)} | {word(3, 9) + "$" for _ in range(40)})
    lexicon = toxicity.Lexicon(terms, np.ones((len(terms), bound + 1)))
    matcher = toxicity.Matcher(lexicon, bound)
    hits = 0
    for w in {word(1, 12) for _ in range(1500)}:
        want = []
        for t, term in enumerate(terms):
            if term.endswith("$"):
                d = distance(w, term[:-1])
            else:
                d = min(distance(w[:i], term) for i in range(len(w) + 1))
            if d <= toxicity.edit_bound(term, bound):
                want.append((t, d))
        assert toxicity.matches(w, lexicon, bound) == want
        assert matcher(w) == (want if len(w) >= 3 else [])
        hits += bool(want)
    assert hits > 100


def corpus(spark, n=900, seed=4):
    """Every third text holds insults; some quote them, and those are labelled clean."""
    r = random.Random(seed)
    plain = [a + b for a in "ba ke mi no ru ta".split() for b in "lan dor fis gut wem".split()]
    rows, labels, kind = [], [], {}
    for i in range(n):
        words = [r.choice(plain) for _ in range(30)]
        insult = r.choice(["blorgface", "snivelrat", "gruntpig"])
        kind[i] = ("abuse", "quote", "none")[i % 3]
        if kind[i] == "abuse":
            at = r.randrange(30)
            words[at:at] = ["you", insult]
            words.append(insult)
        if kind[i] == "quote":
            words[5:5] = ["she", "said", '"' + insult, 'there"']
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(kind[i] == "abuse")))
    return rows, spark.createDataFrame(labels, LABELS), kind


def test_separates_quotation_from_abuse_and_catches_misspellings(spark):
    rows, labels, kind = corpus(spark)
    odd = {5001: "you blorgfaze, balan dor gruntpigg", 5002: "you snivelrt balan kedor snivellrat", 5003: "balan kedor mifis nogut"}
    docs = spark.createDataFrame([*rows, *odd.items()], "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in kind if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i]["held_out"] == (i in held) for i in kind)
    assert sum(found[i]["predicted"] == (kind[i] == "abuse") for i in held) >= 0.98 * len(held)
    assert found[5001]["predicted"] == found[5002]["predicted"] == 1 and found[5003]["predicted"] == 0


def test_window_scores():
    tokens = lambda t: toxicity.TOKEN.findall(t.lower())
    at = lambda t: toxicity.quotation(tokens(t), tokens(t).index("fool"))
    assert at("you are a fool") == 0 and at("he is a fool") == 0
    assert at('she called him a "fool" once') == 1
    assert at('the "old" man, a fool, went') == 0  # the quotation ended before
    assert 0 < at("she said fool") < at('she wrote "a fool" there') <= 1


def test_edge_rows(spark):
    docs = cases.documents(spark)
    ids = [i for (i,) in cases.pairs(docs, "doc_id") if i is not None]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in ids] + [(None, 1, 1), (3, None, None), (4, 1, 0), (4, 1, 1)], LABELS)
    got = toxicity.toxicity(docs, labels)
    rows = got.collect()
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    texts = {}
    for i, t in cases.pairs(docs, "doc_id", "text"):
        texts.setdefault(t or "", set()).add(next(r["score"] for r in rows if r["doc_id"] == i))
    assert all(len(s) == 1 for s in texts.values())
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    assert toxicity.toxicity(cases.nothing(spark), none).count() == 0


def test_ids_as_text_and_a_sample_of_the_labels(spark):
    rows, labels, _ = corpus(spark)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    docs = spark.createDataFrame(rows, schema)
    known = toxicity.training(docs, labels, 200)
    assert 140 < len(known) < 260 and not any(toxicity.held_out(i) for i in known)
    assert len(toxicity.training(docs, labels, 10_000)) == sum(not toxicity.held_out(i) for i, _ in rows)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    right = sum(r["predicted"] and r["toxic"] for r in rows)
    assert right >= 0.9 * sum(r["predicted"] for r in rows) and right >= 0.7 * sum(r["toxic"] for r in rows)
