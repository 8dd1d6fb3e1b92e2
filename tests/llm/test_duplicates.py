import random
from collections import Counter

import cases
import numpy as np
import pytest
import xxhash

from tilewright.llm import graph, lines, rules, simhash


def within_one(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[i + 1 :] == b[i + (len(a) == len(b)) :] if len(a) - len(b) <= 1 else False


def within(a: str, b: str, edits: int) -> bool:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1] <= edits


def brute_lines(rows, least=20, near_enough=within_one):
    """(doc_id, kept text, lines, exact, near) of rows (doc_id, text) that are distinct."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, near, out = {}, {}, {}
    for i, text in order:
        kept, counts = [], [0, 0, 0]
        for raw in (text or "").split("\n"):
            line = raw.strip(" \t\n\x0b\x0c\r").translate(low)
            if line:
                counts[0] += 1
                if line in seen:
                    counts[1] += 1
                    continue
                near[line] = len(line) >= least and any(len(s) >= least and near_enough(line, s) for s in seen)
                seen[line] = True
                if near[line]:
                    counts[2] += 1
                    continue
            kept.append(raw)
        out[i, text] = ("\n".join(kept), *counts)
    return out


def test_lines_against_brute_force(spark):
    r = random.Random(7)
    base = ["the quick brown fox jumps over it", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "a line of sixteen", "Über die Straße gehen wir heute"]

    def edited(s):
        i, c = r.randrange(len(s)), r.choice("abé ")
        return r.choice([s, s[:i] + s[i + 1 :], s[:i] + c + s[i:], s[:i] + c + s[i + 1 :]])

    rows = [(i, "\n".join(r.choice([edited, lambda s: edited(edited(s))])(r.choice(base)) for _ in range(4))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "\n \n"), (None, base[0] + "\nsomething without an id at all"), (43, " " + base[0].upper() + "\t\n")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, line string, gone string")
    found = lines.dedup_lines(docs)
    want = brute_lines(rows)
    assert found.count() == len(rows)
    for row in found.collect():
        assert (row["text"], row["n_lines"], row["n_exact"], row["n_near"]) == want[row["row"]["doc_id"], row["row"]["text"]]
    assert sum(w[3] for w in want.values()) > 10


@pytest.mark.parametrize("edits", [0, 2, 3])
def test_lines_within_other_bounds(spark, edits):
    r = random.Random(edits)
    base = ["page 1 of the report", "aaaaaaaaaaaaaa", "Über die Straße"]

    def edited(s, times):
        for _ in range(times):
            i, c = r.randrange(len(s)), r.choice("a1é ")
            s = r.choice([s[:i] + s[i + 1 :], s[:i] + c + s[i:], s[:i] + c + s[i + 1 :]])
        return s

    rows = [(i, "\n".join(edited(r.choice(base), r.randrange(2 * edits + 3)) for _ in range(3))) for i in range(20)]
    rows += [(20, None), (21, base[0] + "\n" + base[0].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows, 8, lambda a, b: within(a, b, edits))
    got = {(x["row"]["doc_id"], x["row"]["text"]): (x["text"], *x[2:]) for x in lines.dedup_lines(docs, least=8, edits=edits).collect()}
    assert got == want
    assert sum(w[3] for w in want.values()) > 5 or not edits


def test_keys_meet_exactly_within_the_bound():
    r = random.Random(3)
    words = ["".join(r.choice("ab") for _ in range(r.randrange(7))) for _ in range(60)]
    keys = [set(np.concatenate(list(lines._keys_within(w, 2))).tolist()) for w in words]
    for a, x in zip(words, keys, strict=True):
        assert [bool(x & y) for y in keys] == [within(a, b, 2) for b in words]


def test_parts_are_shared_within_the_bound():
    r = random.Random(4)
    for edits in (1, 2, 3):
        for _ in range(500):
            a = b = "".join(r.choice("abcd") for _ in range(r.randrange(6, 16)))
            for _ in range(edits):
                i = r.randrange(len(b))
                b = r.choice([b[:i] + b[i + 1 :], b[:i] + "x" + b[i:], b[:i] + "y" + b[i + 1 :]])
            assert set(lines._parts(a.encode(), len(a), edits)) & set(lines._parts(b.encode(), len(b), edits))


def test_lines_edge_rows(spark):
    docs = cases.documents(spark)
    found = lines.dedup_lines(docs)
    assert found.count() == docs.count()
    assert found.select("row.*").columns == docs.columns
    want = brute_lines({(i, t) for i, t in cases.pairs(docs, "doc_id", "text")})
    for row in found.collect():
        assert (row["text"], *row[2:]) == want[row["row"]["doc_id"], row["row"]["text"]]
    assert lines.dedup_lines(cases.nothing(spark)).count() == 0


def test_variant_keys_meet_exactly():
    keys = {s: lines._variant_keys(s) for s in ("abcd", "abd", "abxd", "bacd", "xabcd", "")}
    assert keys["abcd"][1 + 2] == keys["abd"][0] == keys["abxd"][1 + 2]
    assert keys["xabcd"][1] == keys["abcd"][0]
    assert keys["bacd"][0] not in keys["abcd"]
    assert len(keys[""]) == 1


def brute_fingerprint(text: str | None) -> int:
    w = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, fps):
    part = list(range(len(ids)))
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            a, b = part[i], part[int(j)]
            if a != b:
                part = [a if p == b else p for p in part]
    return {i: min((ids[j] for j in range(len(ids)) if part[j] == part[k] and ids[j] is not None), default=None)
            for k, i in enumerate(ids)}


def test_simhash_against_brute_force(spark):
    docs = cases.documents(spark)
    rows = cases.pairs(docs, "doc_id", "text")
    fps = np.array([brute_fingerprint(t) for _, t in rows], "u8")
    found = simhash.near_duplicates(docs)
    got = Counter(cases.pairs(found.select("doc_id", simhash.hexadecimal().alias("f"), "component_id"), "doc_id", "f", "component_id"))
    want = brute_components([i for i, _ in rows], fps)
    assert got == Counter((i, f"{int(f):016x}", want[i]) for (i, _), f in zip(rows, fps, strict=True))
    assert simhash.near_duplicates(cases.nothing(spark)).count() == 0
    first = simhash.keep_first(docs)
    assert first.columns == docs.columns
    assert sorted(i for (i,) in cases.pairs(first, "doc_id") if i is not None) == sorted(
        i for i, _ in rows if i is not None and want[i] == i
    )


def test_every_link_is_found_in_split_shards(spark, monkeypatch):
    for name, value in (("SHARD", 40), ("NODES", 16), ("VISITORS", 64)):
        monkeypatch.setattr(simhash, name, value)
    r = random.Random(9)
    fps = {r.getrandbits(64) for _ in range(150)}
    fps |= {f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for f in list(fps)[:80]}
    hot = r.getrandbits(64)
    fps |= {hot ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}  # a dense cluster
    ids = sorted(fps)
    nodes = spark.createDataFrame([(int(np.uint64(f).astype("int64")),) for f in ids], "fp long")
    links = simhash.shard_links(nodes)
    roots = dict(cases.pairs(graph.component_roots(links), "node", "root"))
    signed = [int(np.uint64(f).astype("int64")) for f in ids]
    want = brute_components(signed, np.array(ids, "u8"))
    assert {i: roots.get(i, i) for i in signed} == want


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (100, 102), (7, 7)]
    found = dict(cases.pairs(graph.component_roots(spark.createDataFrame(chain, "u long, v long")), "node", "root"))
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def brute_rules(text):
    w = [x for x in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
    at = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(at)
    twice = {p for i, x in enumerate(at) if n[x] > 1 for p in range(i, i + 8)}
    full = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(twice))


def test_rules_measures(spark):
    docs = cases.documents(spark)
    more = [(900, "a b c d e f g h i a b c d e f g h"), (901, "x " * 50), (902, "p q\np q\n \np q"), (903, "\n".join(["l m n o p q r s t"] * 3))]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    found = rules.quality_rules(docs)
    want = Counter((i, *(m := brute_rules(t)), m[0] < 20 or 100 * m[4] > 30 * m[0]) for i, t in cases.pairs(docs, "doc_id", "text"))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(cases.pairs(found, *names)) == want
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(cases.pairs(kept, "doc_id")) == Counter((r["doc_id"],) for r in found.collect() if r["kept"])
    assert rules.quality_rules(cases.nothing(spark)).count() == 0


def test_rules_reject_depleted_documents(spark):
    bar = "home about contact privacy terms login register search help and more links to everything on this site for you"
    rows = [(i, f"{bar}\nonly {i} words here", "h") for i in range(12)]
    rows += [(20 + i, " ".join(f"w{i}x{j}" for j in range(60)) + "\n" + bar, "h") for i in range(5)]
    rows += [(40 + i, bar + "\na", "other") for i in range(3)] + [(50 + i, bar + f"\n{i}", None) for i in range(11)]
    # a host that holds most rows: the limit doesn't grow with it
    rows += [(1000 + i, " ".join(f"y{i}x{j}" for j in range(25)), "big") for i in range(400)]
    rows += [(2000 + i, bar + f"\nitem {i}", "big") for i in range(10)]
    found = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    kept = dict(cases.pairs(found, "doc_id", "kept"))
    assert {i for i, k in kept.items() if not k} == {*range(12), *range(50, 61), *range(2000, 2010)}


def test_rules_take_frequent_lines_out_of_kept_documents(spark):
    bar = "Home about contact"
    own = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(14)]
    rows = [(i, f"{own[i]}\n\n \tHOME  about contact \nline {i}\n{bar}", "h") for i in range(12)]
    rows += [(20, f"{own[12]}\n{bar}", "other"), (21, own[13] + "\n", "h"), (22, None, "h")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, source string, n_chars int")
    want = {i: f"{own[i]}\n\nline {i}" for i in range(12)} | {20: rows[12][1], 21: rows[13][1], 22: None}
    assert dict(cases.pairs(rules.quality_rules(docs), "doc_id", "text")) == want
    kept = rules.keep_good(docs)
    assert kept.schema == docs.schema
    assert {i: (t, n) for i, t, n in cases.pairs(kept, "doc_id", "text", "n_chars")} == {
        i: (t, len(t)) for i, t in want.items() if i != 22
    }


def test_rules_use_no_python(spark):
    from tilewright.llm.queries import QUERIES

    plan = QUERIES["op6_quality_rules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("name", ["op6_quality_rules", "op3_line_dedup", "op1_warc", "op8_top_k"])
def test_queries_equal_their_sql(spark, name):
    from check import compare, connect

    from tilewright.llm.queries import ORACLE_SQL, QUERIES

    q = type("Q", (), {"build": staticmethod(QUERIES[name]), "sql": ORACLE_SQL[name]})
    message, good = compare(spark, connect("/root/testdata/sf0.001"), q, "/root/testdata/sf0.001")
    assert good, message
