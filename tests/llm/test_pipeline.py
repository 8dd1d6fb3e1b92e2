"""The pipeline against a brute-force chain of its five stages."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_duplicates import brute_components, brute_fingerprint, brute_lines, brute_rules

import corpus_pipeline
from tilewright.llm import common, importance

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=3):
    """Prose of two hosts with copies, near copies, shared lines, depleted documents, short ones, repetition and junk."""
    r = random.Random(seed)
    words = [a + b for a in "ba ke mi no ru ta so vel".split() for b in "lan dor fis gut wem ris".split()]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    bar = prose(18)
    texts = ["\n".join(prose(30) for _ in range(3)) for _ in range(40)]
    texts += [texts[0], texts[1], texts[2] + " end", texts[3].replace(" ", "  ", 1)]
    texts += [f"{bar}\n{prose(2)}" for _ in range(12)]  # depleted: the same line in twelve documents of a host
    texts += [f"{prose(40)}\n{bar}" for _ in range(4)]
    texts += ["too short", prose(4), (prose(9) + " ") * 12, None, "", " \n ", "\n".join([prose(30), texts[5].split("\n")[1]])]
    texts += ["\n".join(" ".join(r.choice(["###", "$$$", "&&&", "WIN!!"]) for _ in range(12)) for _ in range(5)) for _ in range(14)]
    rows = [(i, t, "xx", "h1" if 44 <= i < 56 or i % 3 else "h2", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1) for i in range(0, 40)] + [(i, 0) for i in range(len(texts) - 14, len(texts) - 3)]
    return rows, labels


def classified(spark, rows, labels, seed=11):
    good = {i for i, q in labels if q}
    raw, target = np.zeros((2, importance.KINDS * importance.SLOTS))
    slots = {}
    for i, t, *_ in rows:
        slots[i] = next(importance.ngram_slots([t or ""], common.Memo()))
        n = np.bincount(slots[i], minlength=raw.size)
        raw, target = raw + n, target + n * (i in good)
    by_kind = lambda x: x.reshape(importance.KINDS, -1)
    share = by_kind(target).sum(1, keepdims=True) / by_kind(raw).sum(1, keepdims=True)
    ratio = np.log((by_kind(target) + importance.DOUBT) / (by_kind(raw) * share + importance.DOUBT)).ravel()
    noise = dict(spark.createDataFrame([(r[0],) for r in rows], "i long").select("i", importance.gumbel(F.col("i"), seed)).collect())
    keys = {i: ratio[s].sum() + noise[i] for i, s in slots.items() if len(s)}
    k = round(sum(q for _, q in labels) / len(labels) * len(keys))
    cut = sorted(keys.values(), reverse=True)[k - 1]
    return [r for r in rows if keys.get(r[0], -np.inf) >= cut]


def ruled(rows):
    lines = lambda t: [(x, " ".join(x.lower().split())) for x in (t or "").split("\n")]
    holders = defaultdict(set)
    for _, t, _, host, _ in rows:
        for _, x in lines(t):
            if x:
                holders[host, x].add(t)
    out = []
    for i, t, lang, host, n in rows:
        m = brute_rules(t)
        rest = [(raw, x) for raw, x in lines(t) if not x or len(holders[host, x]) < 10]
        left = sum(len(x.split()) for _, x in rest)
        if m[0] < 20 or 100 * m[4] > 30 * m[0] or left < min(20, 0.5 * m[0]) and len(rest) < len(lines(t)):
            continue
        text = "\n".join(raw for raw, _ in rest)
        out.append((i, text, lang, host, n if text == t else len(text)))
    return out


def deduplicated(rows):
    kept = brute_lines([(r[0], r[1]) for r in rows])
    return [(i, kept[i, t][0], lang, host, len(kept[i, t][0])) for i, t, lang, host, _ in rows]


def firsts(rows):
    ids = [r[0] for r in rows]
    least = brute_components(ids, np.array([brute_fingerprint(r[1]) for r in rows], "u8"))
    return [r for r in rows if least[r[0]] == r[0]]


def test_chain_against_brute_force(spark):
    rows, labels = corpus()
    shapes = spark.createDataFrame(labels, "doc_id long, quality int")
    want = [rows]
    want.append(classified(spark, want[-1], labels))
    for stage in (ruled, deduplicated, firsts):
        want.append(stage(want[-1]))
    lengths = [len(w) for w in want]
    assert lengths[0] > lengths[1] > lengths[2] == lengths[3] > lengths[4], lengths  # every filter decides something

    import tempfile

    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    shapes.write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:4], want[1:], strict=True):
        docs = common.fresh(stage(spark, docs, folder), "stage")
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", "), name
        assert Counter(map(tuple, docs.collect())) == Counter(expected), name

    packed = corpus_pipeline.run(spark, folder).collect()
    final = {r[0]: r[1] for r in want[-1]}
    assert {p["doc_id"] for p in packed} == set(final)
    held, room = defaultdict(int), defaultdict(list)
    for p in packed:
        held[p["doc_id"]] += p["length"]
        room[p["sequence_id"]].append((p["offset"], p["length"]))
    assert all(held[p["doc_id"]] == p["doc_tokens"] for p in packed)
    for pieces in room.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(np.cumsum([0, *(n for _, n in pieces[:-1])])) and sum(pieces[-1]) <= 4096


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_no_documents(spark, stage, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert stage(spark, none, str(tmp_path)).count() == 0


def test_stages_keep_other_columns_and_types(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("clash")).withColumn("kept", F.lit(1.5))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.where("row <> 'clash' or kept <> 1.5").count() == 0
