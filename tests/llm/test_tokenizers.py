import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import public_tokenizers
import pytest

from tilewright.llm import byte_bpe, packing, token_counts


def test_byte_bpe_equals_tiktoken_and_round_trips(spark):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = cases.documents(spark)
    found = byte_bpe.encode(docs)
    decoded = byte_bpe.decode(found.withColumn("kept", found["doc_id"]))
    assert decoded.columns == ["doc_id", "kept", "decoded"]
    want = Counter((i, tuple(own.encode_ordinary(t or ""))) for i, t in cases.pairs(docs, "doc_id", "text"))
    assert Counter((i, tuple(x)) for i, x in cases.pairs(found, "doc_id", "ids")) == want
    want = Counter((i, (t or "").encode()) for i, t in cases.pairs(docs, "doc_id", "text"))
    assert Counter((i, bytes(x)) for i, x in cases.pairs(decoded, "doc_id", "decoded")) == want
    assert byte_bpe.decode(byte_bpe.encode(cases.nothing(spark))).count() == 0


def test_byte_bpe_white_space():
    import tiktoken

    use = byte_bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ranks = {t: i for i, t in enumerate(use.tokens)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r, parts = random.Random(4), ["a", "b", " ", "  ", "the", " the", "é", "\n", "\n\n", " \n", "\n ", "\t", "!!", "'s", "\x1c", " "]
    some = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(4000)]
    assert [np.frombuffer(x, "<i4").tolist() for x in use.encode(some)] == [own.encode_ordinary(s) for s in some]


@pytest.fixture(scope="module")
def unigram():
    import sentencepiece

    pieces = token_counts.unigram_pieces()
    return sentencepiece.SentencePieceProcessor(model_proto=token_counts.unigram_model(pieces))


def test_token_counts_equal_the_tokenizer(spark, unigram):
    docs = cases.documents(spark)
    found = token_counts.token_counts(docs)
    want = Counter((i, len(unigram.encode(t or ""))) for i, t in cases.pairs(docs, "doc_id", "text"))
    assert Counter(cases.pairs(found, "doc_id", "n_pieces")) == want
    assert token_counts.token_counts(cases.nothing(spark)).count() == 0


def test_token_counts_ties_and_rounding(unigram):
    use = token_counts.Counter(token_counts.unigram_pieces())
    r, parts = random.Random(5), ["a", "b", " ", "  ", "the", " the", "é", "漢", "\n", " \n", "\t", "!!", "▁", "0", "😀", "ing"]
    some = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(3000)]
    some += [" ".join(r.choice(["thsta", "xq", "eron", "😀"]) for _ in range(100_000))]  # sums beyond exact single precision
    some += ["".join(r.choice("漢字仮名交文a b") for _ in range(80_000))]
    assert [n for _, n in use.count(some)] == [len(x) for x in unigram.encode(some, num_threads=1)]


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = cases.documents(spark)
    out = packing.harmonic_packing(docs)
    ids = {i: [*own.encode(t or "", add_special_tokens=False).ids, 2] for i, t in cases.pairs(docs, "doc_id", "text")}
    rows = [r.asDict() for r in out.collect()]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        own_ids = ids[r["doc_id"]]
        part = own_ids[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(own_ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    copies = Counter(i for i, _ in cases.pairs(docs, "doc_id", "text"))
    for i, own_ids in ids.items():
        assert sum(n for _, n in by_doc[i]) == copies[i] * len(own_ids)
        assert {s for s, _ in by_doc[i]} == {sum(packing.cuts(len(own_ids), 4096)[:j]) for j in range(len(set(by_doc[i])))}
    for members in by_sequence.values():
        at = 0
        for offset, n in sorted(members):
            assert offset == at
            at += n
        assert at <= 4096
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= total / 4096 * 1.02 + 1
    assert packing.harmonic_packing(cases.nothing(spark)).count() == 0


def test_classes_hold_a_fixed_count():
    for n in (1, 2, 63, 1000, 1365, 2048, 4095, 4096, 4097, 12345):
        sizes = packing.cuts(n, 4096)
        assert sum(sizes) == n
        assert all((4096 // s) * s >= 4096 * (1 - 1 / 128) for s in sizes)


def test_word_ids_by_stretch():
    from tokenizers import Tokenizer

    use = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(3)
    parts = ["a", "B", " ", "the.", "The,", "é.", "É", "漢", "\n", "\t", "!!", ".", "'s", "’", "0", "😀", "́", "\x1c", " ",
             "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|", "İ", "ß", "K.", "x,y", "%%%."]
    some = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(4000)]
    want = [own.encode(s, add_special_tokens=False).ids for s in some]
    assert any(49407 in w for w in want)
    assert [np.frombuffer(x, "<u4").tolist() for x in use.ids(some)] == want


def test_query_digests(spark):
    from tilewright.llm.queries import QUERIES

    rows = {r[0]: r for r in QUERIES["op9_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert all(rows[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in cases.pairs(docs, "doc_id", "text"))
