import hashlib
import re

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(i, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_cuts_and_restores_whole_texts(spark):
    more = [(100 + i, t) for i, t in enumerate(["a <P> b", "<S>", "x<M>", "<", "a <S", "<P <M", " é", "漢字 𝄞 x", "<S<P <M"] * 6)]
    docs = cases.documents(spark, n=60).select("doc_id", "text", "n_words", "row").unionByName(
        spark.createDataFrame([(i, t, "n", "r") for i, t in more], "doc_id long, text string, n_words string, row string")
    )
    found = fill_middle.fill_in_middle(docs)
    back = found.withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = [tuple(r) for r in back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()]
    want = [(i, *by_hand(i, t), t or "") for i, t in cases.pairs(docs, "doc_id", "text")]
    order = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(cases.nothing(spark)).count() == 0


@pytest.mark.parametrize("text", ["", "ascii only", "é", "aé漢𝄞b", "漢字" * 50 + " x " * 40, "𝄞"])
def test_index_converts_both_ways(text):
    data = text.encode()
    index = fill_middle.Exceptions(np.frombuffer(data, "u1"))
    starts = np.array([len(text[:i].encode()) for i in range(len(text) + 1)])
    assert (index.chars(starts) == np.arange(len(text) + 1)).all()
    assert (index.bytes(np.arange(len(text) + 1)) == starts).all()
    assert len(index.at) == sum(len(c.encode()) > 1 for c in text)


def test_part_sizes_in_bytes_cut_the_text(spark):
    docs = cases.documents(spark)
    texts = {i: (t or "").encode() for i, t in cases.pairs(docs, "doc_id", "text")}
    rows = fill_middle.fill_in_middle(docs, rate=100, spm_rate=0).where("form = 'psm'").collect()
    assert len(rows) > 30
    for r in rows:
        data, a, b = texts[r["doc_id"]], r["prefix_bytes"], r["prefix_bytes"] + r["middle_bytes"]
        assert r["output"].encode() == b"<P>" + data[:a] + b"<S>" + data[b:] + b"<M>" + data[a:b]


def test_cuts_between_code_points(spark):
    docs = cases.documents(spark)
    texts = {i: t or "" for i, t in cases.pairs(docs, "doc_id", "text")}
    rows = fill_middle.fill_in_middle(docs, rate=100, spm_rate=0, unit="chars").where("form = 'psm'").collect()
    for r in rows:
        t, a, b = texts[r["doc_id"]], r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]
        assert r["n"] == len(t) and r["output"] == "<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b]
    assert any(len(texts[r["doc_id"]][: r["prefix_chars"]].encode()) > r["prefix_chars"] for r in rows)
