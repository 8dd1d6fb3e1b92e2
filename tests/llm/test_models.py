import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import cases
import numpy as np

from tilewright.llm import hmm, importance, topk, warc


def test_language_model_against_brute_force(spark):
    docs = cases.documents(spark, n=80)
    rows = cases.pairs(docs, "doc_id", "text")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None]
    train = Counter()
    for i, t in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1:
            train.update(split(t))
    n, v = sum(train.values()), len(train)
    found = hmm.language_model(docs, rounds=2)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r) for r in found.collect())
    want = sorted(((i is None, i or 0, len(split(t)), t) for i, t in rows), key=lambda x: x[:3])
    assert len(got) == len(want)
    for (*_, r), (*_, t) in zip(got, want, strict=True):
        words = split(t)
        assert r["held_out"] == hmm.held_out(r["doc_id"]) and r["train_tokens"] == n
        assert r["n_tokens"] == len(words) and r["n_known"] == sum(train[w] > 0 for w in words)
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    assert hmm.language_model(cases.nothing(spark), rounds=1).count() == 0


def test_language_model_beats_word_frequencies_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = [r for r in hmm.language_model(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def model(k=3, c=4, seed=2):
    r = np.random.default_rng(seed)
    return hmm.Model(r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), r.dirichlet(np.ones(c), k).T)


def test_forward_recursion_sums_over_all_paths():
    m = model()
    sequences = [np.array(s) for s in ([0], [1, 2], [3, 0, 1, 1], [2, 2, 0, 3, 1])]
    for s, got in zip(sequences, hmm.log_likelihoods(m, sequences), strict=True):
        total = sum(
            m.start[p[0]] * m.emit[s[0], p[0]] * math.prod(m.step[p[i - 1], p[i]] * m.emit[s[i], p[i]] for i in range(1, len(s)))
            for p in product(range(3), repeat=len(s))
        )
        assert math.isclose(got, math.log(total), rel_tol=1e-12)


def test_forward_recursion_of_a_long_text_stays_finite():
    s = np.random.default_rng(1).integers(0, 4, 50_000)
    m = model()
    got = hmm.log_likelihoods(m, [s, s[:10]])
    assert np.isfinite(got).all() and got[0] < -10_000


def test_baum_welch_counts_and_ascent():
    m, r = model(), random.Random(3)
    sequences = [np.array([r.randrange(4) for _ in range(r.randrange(1, 9))]) for _ in range(50)]
    before = -np.inf
    for _ in range(6):
        start, step, emit, total = hmm.expected(m, sequences)
        assert math.isclose(start.sum(), 50, rel_tol=1e-4)
        assert math.isclose(emit.sum(), sum(map(len, sequences)), rel_tol=1e-4)
        assert math.isclose(step.sum(), sum(len(s) - 1 for s in sequences), rel_tol=1e-4)
        assert math.isclose(total, hmm.log_likelihoods(m, sequences).sum(), rel_tol=1e-4)
        assert total >= before - 1e-3
        before = total
        m = hmm.Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def test_probabilities_of_a_class_sum_to_one():
    lex = hmm.Lexicon(10, 5, {}, np.array([0.0, 6.0]), np.array([0.0, 2.0]))
    unknown = lex.unknown()
    counts = [3, 1, 1, 1]
    assert math.isclose(sum((1 - unknown[1]) * c / 6 for c in counts) + unknown[1], 1.0)


def test_importance_weights_and_sample(spark):
    r = random.Random(1)
    good = [(i, " ".join(r.choice(["red", "green", "blue", "gold"]) for _ in range(30))) for i in range(60)]
    bad = [(i, " ".join(r.choice(["SPAM!!", "BUY!!", "NOW!!"]) for _ in range(30))) for i in range(100, 130)]
    edge = [(500, None), (501, ""), (502, " \n"), (None, good[0][1]), good[1]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in [*good, *bad, *edge]], "doc_id long, text string, kept string")
    labels = spark.createDataFrame(
        [(i, 1, 9) for i in range(40)] + [(i, 0, 9) for i in range(100, 120)] + [(None, 1, 9), (3, None, 9), (45, 0, 9), (45, 1, 9)],
        "doc_id long, quality int, row int",
    )
    assert importance.resample(docs, labels).where("kept").count() == round(40 / 60 * (len(good) + len(bad) + 2))
    found = importance.resample(docs, labels, share=62 / 92)
    kept = Counter(r["row"]["doc_id"] for r in found.collect() if r["kept"])
    assert kept == Counter([*range(60), 1, None])
    # the weights are the log ratios of the two models
    raw = np.zeros(importance.KINDS * importance.SLOTS)
    target = raw.copy()
    for i, t in [*good, *bad, *edge]:
        slots = next(importance.ngram_slots([t or ""], importance.Memo()))
        raw += np.bincount(slots, minlength=len(raw))
        if i in range(40):
            target += np.bincount(slots, minlength=len(raw))
    share = target.reshape(3, -1).sum(1, keepdims=True) / raw.reshape(3, -1).sum(1, keepdims=True)
    ratio = np.log((target.reshape(3, -1) + 16) / (raw.reshape(3, -1) * share + 16)).ravel()
    for row in found.collect():
        slots = next(importance.ngram_slots([row["row"]["text"] or ""], importance.Memo()))
        assert (row["log_weight"] is None) == (len(slots) == 0)
        assert not len(slots) or math.isclose(row["log_weight"], ratio[slots].sum(), rel_tol=1e-9)
    # the k largest keys
    some = importance.resample(docs, labels, k=25)
    keys = sorted((x["gumbel_key"] for x in some.collect() if x["gumbel_key"] is not None), reverse=True)
    assert {x["gumbel_key"] for x in some.collect() if x["kept"]} == {k for k in keys if k >= keys[24]}
    assert importance.resample(docs.where("false"), labels).count() == 0
    assert importance.resample(docs, labels.where("false")).where("kept").count() == len(good) + len(bad) + 2


def test_sample_follows_the_weights(spark):
    docs = spark.createDataFrame([(i, ["aa", "bb", "cc"][i % 3]) for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0 or i % 3 == 1 and i < 90)) for i in range(600)], "doc_id long, quality int")
    seeds, got = range(6), np.zeros(3)
    for seed in seeds:
        rows = importance.resample(docs, labels, k=300, seed=seed).collect()
        got += np.bincount([r["row"]["doc_id"] % 3 for r in rows if r["kept"]], minlength=3)
    weight = np.exp([next(r["log_weight"] for r in rows if r["row"]["doc_id"] == i) for i in range(3)])
    r = np.random.default_rng(1)
    chance = np.tile(weight, 300) / (300 * weight.sum())
    drawn = np.array([np.bincount(r.choice(900, 300, replace=False, p=chance) % 3, minlength=3) for _ in range(300)])
    assert (np.abs(got / len(seeds) - drawn.mean(axis=0)) < 4 * drawn.std(axis=0) / len(seeds) ** 0.5 + 1).all()
    assert got[0] > got[1] > got[2] > 0  # likelier ones more often, none always


def test_kth_largest(spark):
    r = random.Random(2)
    values = [r.gauss(0, 1) for _ in range(9000)] + [1e6, -1e6] + [0.25] * 500
    df = spark.createDataFrame([(v,) for v in values], "v double")
    order = sorted(values, reverse=True)
    for k in (1, 2, 4000, 4300, 9500):
        assert importance.kth_largest(df, "v", k) == order[k - 1]


def brute_top(rows, k=5, every=50):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v.setdefault(i, []).append([math.floor(256 * c) for c in x])
    out = set()
    for q in v:
        if q % every == 0:
            best = {}
            for x in v[q]:
                for i, ys in v.items():
                    for y in ys:
                        if i != q and len(y) == len(x):
                            best[i] = max(best.get(i, -math.inf), sum(a * b for a, b in zip(x, y)))
            s = sorted((-s_, i) for i, s_ in best.items())
            out |= {(q, n + 1, i, -s_) for n, (s_, i) in enumerate(s[:k])}
    return out


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 64)
    monkeypatch.setattr(topk, "BLOCK", 3)
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) * (1 + 3 * (i % 7 == 0)) for _ in range(8)]) for i in range(600)]
    rows += [(700 + i, rows[0][1]) for i in range(20)] + [(750, [0.0] * 8), (751, [0.0] * 8)]  # ties and zero vectors
    rows += [(800, [1.0, 2.0]), (850, [3.0]), (801, [1.0, -2.0]), (900, []), (901, None), (None, [1.0] * 8), (950, [1.0, None] * 4)]
    rows += [(951, [float("nan")] * 8), (1000, [float("inf")] * 8), rows[5]]
    long_ = [9.0 * c for c in rows[0][1]]  # ids with several vectors: one best product each
    rows += [(7, long_), (7, [2 * c for c in long_]), (7, [c + 1 for c in long_]), (100, long_), (100, rows[3][1]), (14, long_)]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    found = topk.top_k(df)
    assert set(cases.pairs(found, "query_id", "rank", "vec_id", "score")) == brute_top(rows)
    assert found.count() == len(brute_top(rows))
    assert topk.top_k(df.where("false")).count() == 0


def test_buckets_prune_by_coordinate_without_loss():
    r = np.random.default_rng(4)
    v = np.floor(r.normal(size=(500, 6)) * 100).astype("int64")
    v = v[np.argsort(-(v**2).sum(1), kind="stable")]
    q, ids = v[:40] * 2, np.arange(500)
    scores = q @ v.T
    bounds = np.array([float(np.sort(s[np.arange(500) != i])[-3]) for i, s in enumerate(scores)])
    got = set(topk.bucket_best(ids[:40], q, bounds, ids, v, 3))
    want = set()
    for i, s in enumerate(scores):
        order = sorted((-x, j) for j, x in enumerate(s.tolist()) if j != i)[:3]
        want |= {(i, j, -x) for x, j in order}
    assert got == want


def test_pairs_are_made_only_with_buckets_that_are_long_enough(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 50)
    seen, searched = [], topk._searched
    monkeypatch.setattr(topk, "_searched", lambda pairs, k: (seen.append(pairs.count()), searched(pairs, k))[1])
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) / (1 + i) for _ in range(4)]) for i in range(1000)] + [(2000, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert set(cases.pairs(topk.top_k(df, scale=2.0**20), "query_id", "rank", "vec_id", "score")) == brute_top(
        [(i, [c * 4096 for c in x]) for i, x in rows]
    )
    assert seen[1] < 10  # of 21 buckets


def test_pairs_are_dealt_without_broadcast_and_leave_tasks_as_the_best(spark, monkeypatch):
    for name, value in (("BUCKET", 40), ("BLOCK", 3), ("LANES", 4), ("HELD", 400), ("KEPT", 2)):
        monkeypatch.setattr(topk, name, value, raising=False)
    plans, found, searched = [], [], topk._searched

    def watched(pairs, k):
        plans.append(pairs._jdf.queryExecution().executedPlan().toString())
        out = searched(pairs, k)
        found.append(out.where("query_id = 0"))
        return out

    monkeypatch.setattr(topk, "_searched", watched)
    r = random.Random(10)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(900)] + [(i, [float(i % 3)] * 6) for i in range(0, 900, 30)]
    rows += [(1000 + i, [r.choice([-2.0, 1e5, 9e6]), 1.0]) for i in range(120)]  # other dimension, other sizes of integers
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert set(cases.pairs(topk.top_k(df, k=3), "query_id", "rank", "vec_id", "score")) == brute_top(rows, k=3)
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)  # copies of the blocks passed the driver before
    assert found[1].count() <= 3 * 4 * 8  # k by lane and partition at most; k of every bucket before


def test_best_so_far_counts_an_id_once():
    rows = np.array([(1, 7, 5), (1, 7, 9), (1, 3, 9), (1, 2, 8), (0, 5, -4), (1, 9, 8)])
    assert topk._best_so_far(rows, 3).tolist() == [[0, 5, -4], [1, 3, 9], [1, 7, 9], [1, 2, 8]]
    assert topk._best_so_far(rows[:0], 3).shape == (0, 3)
    assert topk._floor(np.array([1, 0, 4, 1]), topk._best_so_far(rows, 3), 3).tolist() == [8, -np.inf, -np.inf, 8]
    assert topk._floor(np.array([1, 0]), rows[:0], 3).tolist() == [-np.inf, -np.inf]
    for top, size in ((127, 1), (128, 2), (2**20, 4), (2**40, 8)):
        v = np.array([[top, -3], [0, 1]])
        assert topk._narrow(v).itemsize == size
        i, back = topk._unpacked(np.arange(2).tobytes(), topk._narrow(v).tobytes(), 2)
        assert (back == v).all() and back.dtype == np.int64 and len(i) == 2


def test_products_beyond_double_precision():
    a = np.array([[2**31, 1]])
    assert topk.products(a, np.array([[2**30, 1]]))[0, 0] == 2**61 + 1


def test_archives_round_trip(spark, tmp_path):
    import struct

    long_, other = "<p>" + "é" * 600 + "</p>", "x" * 1000
    rows = [(1, "u1", long_), (2, "u2", long_), (9, "u9", long_), (9, "u9", long_), (3, "u3", "short"), (4, "u4", "short")]
    rows += [(5, None, None), (6, "a\r\nWARC-Type: x", ""), (None, "n", other), (None, "n", "y" * 5000), (8, "u8", other)]
    rows += [(7, "u7", "z" * 300_000 + "\r\n\r\nWARC/1.1")] + [(100 + i, f"h{i}", f"<html>page {i} " + "text " * (i % 50)) for i in range(200)]
    df = spark.createDataFrame([(i, u, h, "c") for i, u, h in rows], "page_id long, url string, html string, id string").repartition(3)
    folder = f"file://{tmp_path}/a"
    manifest = warc.archive(df, folder, rotate=20_000)
    back = warc.read_archives(manifest, folder)
    last = {h: max((i for i, _, g in rows if g == h and i is not None), default=None) for _, _, h in rows}
    want = Counter()
    for i, _, h in rows:
        big = len((h or "").encode()) >= 1000
        refers = last[h] if big and last[h] != i else None
        want[i, len((h or "").encode()), "revisit" if refers is not None else "response", refers] += 1
    assert Counter(cases.pairs(back, "id", "payload_bytes", "record_type", "refers_to")) == want
    bodies = Counter((i, (h or "").encode()) for i, _, h in rows)
    assert all(bodies[r["id"], bytes(r["payload"])] for r in back.where("record_type = 'response'").collect())
    names = [r["archive"] for r in manifest.collect()]
    assert len(names) > 1
    for name in names:
        with open(f"{tmp_path}/a/{name}", "rb") as f:
            magic, size = struct.unpack("<II", f.read(8))
            assert magic == 0x184D2A5D and size > 0
            f.seek(0)
            assert all(x.startswith(b"WARC/1.1\r\n") for x in warc.frames(f))
    assert warc.read_archives(warc.archive(df.where("false"), f"file://{tmp_path}/b"), f"file://{tmp_path}/b").count() == 0


def test_dictionary_sample_is_drawn_by_hash(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(i, f"u{i}", f"page {i} " * 20) for i in range(3000)] + [(None, None, "hot page " * 20)] * 1500
    df = spark.createDataFrame(rows, "id long, uri string, html string").repartition(6)
    df = df.select("id", F.coalesce("uri", F.lit("")).alias("uri"), F.encode("html", "UTF-8").alias("payload"))
    df = df.withColumns({"length": F.length("payload"), "digest": F.sha1("payload")})
    few = warc.sampled_records(df, 4500, 100, 1000, 1 << 20)
    assert len(few) == 100 == len(set(few))
    assert few == warc.sampled_records(df.repartition(2), 4500, 100, 1000, 1 << 20)
    assert len(warc.sampled_records(df, 4500, 100, 1000, 1000)) < 10
    assert len(warc.sampled_records(df, 4500, 10_000, 1000, 1 << 24)) == 3001
    assert warc.sampled_records(df.where("false"), 0, 100, 1000, 1000) == []


def test_a_damaged_archive_is_noticed(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([(i, "u", "body " * 100) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/a"
    manifest = warc.archive(df, folder)
    path = f"{tmp_path}/a/{manifest.first()['archive']}"
    with open(path, "rb") as f:
        data = f.read()
    with open(path, "wb") as f:
        f.write(data[:-5])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_archives(manifest, folder).collect()
