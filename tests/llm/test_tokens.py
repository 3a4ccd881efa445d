import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lindero.llm import bpe, huffman

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
TEXT = "doc_id long, text string, ids string, n_tokens int, decoded int, start string"


@pytest.fixture(scope="module")
def exact():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)


def odd_texts():
    pick = random.Random(8)
    some = "ab  \n\t.,'s 're é日🙂\x1c\u00a0\u20039_<|endoftext|>"
    return ["", " ", "  a", "a ", "a  b", "a \n b", "x" * 3000, "\u0301 e", "it's we'll",
            "word, word. word### the the"] + [
        "".join(pick.choices(some, k=pick.randint(1, 60))) for _ in range(400)]


def test_encoder_equals_library(own, exact):
    for text in odd_texts():
        assert np.frombuffer(own.encode(text), "<u4").tolist() == exact.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=40), st.integers(0, 40), st.integers(0, 40), st.binary(max_size=12))
def test_prefixes_append_and_edit(data, start, stop, new):
    v = vocabulary()
    whole = bpe.Prefixes(v, data)
    assert whole.ids() == v.merge(data)
    for end in range(1, len(data) + 1):  # the last token of every prefix is that of its encoding
        assert whole.last[end - 1] == v.merge(data[:end])[-1]
    start, stop = sorted((min(start, len(data)), min(stop, len(data))))
    whole.edit(start, stop, new)
    assert whole.data == data[:start] + new + data[stop:]
    assert whole.ids() == v.merge(whole.data)
    whole.append(new)
    assert whole.ids() == v.merge(whole.data)


def vocabulary(_known=[]):
    if not _known:
        _known.append(bpe.Vocabulary(bpe.load_ranks(RANKS)))
    return _known[0]


def test_edit_near_the_start_keeps_the_rest():
    p = bpe.Prefixes(vocabulary(), b"thing" * 200)
    assert p.edit(3, 4, b"m") < 200 and p.ids() == vocabulary().merge(b"thimg" + b"thing" * 199)


def test_text_appends_and_edits(own, exact):
    pick = random.Random(5)
    some = "the and of  \n's é9."
    for _ in range(150):
        text = "".join(pick.choices(some, k=pick.randint(0, 60)))
        held = bpe.EncodedText(own, text)
        for _ in range(3):
            a, b = sorted(pick.choices(range(len(held.text) + 1), k=2))
            held.edit(a, b, "".join(pick.choices(some, k=pick.randint(0, 5))))
            held.append(pick.choice(["", " more", "\n"]))
            assert held.ids() == exact.encode_ordinary(held.text)
    long = bpe.EncodedText(own, "many words " * 500)
    assert long.edit(2000, 2004, "here") < 20


def test_memory_stays_bounded():
    memo = bpe.Memo(lambda k: k + 1, limit=10)
    assert [memo[i % 37] for i in range(500)] == [i % 37 + 1 for i in range(500)]
    assert len(memo) <= 10 and len(memo.old) <= 10


def test_bpe_jobs(spark, exact):
    texts = odd_texts()[:60] + [None, None]
    docs = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in enumerate(texts)], TEXT)
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    done = bpe.decode(encoded, RANKS)
    assert set(done.columns) == set(docs.columns)
    for r in done.collect():
        want = exact.encode_ordinary(texts[r["doc_id"]] or "")
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want
        assert r["n_tokens"] == len(want)
        assert bytes(r["decoded"]).decode() == (texts[r["doc_id"]] or "")
    assert bpe.encode(spark.createDataFrame([], TEXT), RANKS, public_tokenizers.PATTERN).count() == 0


def test_op9_query_against_library(spark, exact):
    from lindero.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op9_bpe"](spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        text = texts[r["doc_id"]] or ""
        ids = np.array(exact.encode_ordinary(text), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest())


def kraft(lengths):
    return sum(2.0 ** -int(n) for n in lengths if n)


@pytest.mark.parametrize("counts, limit", [
    ([0, 0, 0], 8), ([0, 5, 0], 8), ([1, 1], 8), ([1, 1, 2, 3, 5, 8, 13, 21, 34, 55], 4),
    ([1] * 9, 4), ([2 ** i for i in range(20)], 6)])
def test_code_lengths_are_best_within_the_limit(counts, limit):
    lengths = huffman.code_lengths(np.array(counts), limit)
    used = [c for c in counts if c]
    assert [bool(n) for n in lengths] == [bool(c) for c in counts]
    assert kraft(lengths) <= 1 and all(n <= limit for n in lengths)
    if 2 <= len(used) <= 10:  # every sorted choice of lengths
        best = min_cost(sorted(used), limit)
        assert sum(int(n) * c for n, c in zip(lengths, counts)) == best


def min_cost(counts, limit):
    from functools import lru_cache
    unit = 1 << limit

    @lru_cache(None)
    def go(i, low, room):
        if i == len(counts):
            return 0
        return min((counts[len(counts) - 1 - i] * n + go(i + 1, n, room - (unit >> n))
                    for n in range(low, limit + 1) if room >= (unit >> n)), default=10 ** 9)

    return go(0, 1, unit)


def test_blocks_round_trip():
    random_ = np.random.default_rng(1)
    counts = random_.zipf(1.3, 3000).clip(0, 10 ** 6)
    own = huffman.book(huffman.code_lengths(counts))
    blocks = [random_.choice(3000, p=counts / counts.sum(), size=n)
              for n in (1, 255, 256, 257, 1000, 70_000)]
    packed = [huffman.pack_block(b, own) for b in blocks]
    found = huffman.unpack_blocks([p[0] for p in packed], [p[1] for p in packed],
                                  [len(b) for b in blocks], own)
    assert all((a == b).all() for a, b in zip(blocks, found))
    alone = huffman.unpack_blocks([packed[3][0]], [packed[3][1]], [257], own)
    assert (alone[0] == blocks[3]).all()
    with pytest.raises(ValueError):
        huffman.pack_block(np.array([3001]), huffman.book(np.append(own.lengths, [0, 0])))


def test_huffman_jobs(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(JSON)
    texts = odd_texts()[:80] + [None, None, "a b", "a b", "a <|endoftext|> b", "<|endoftext|>x <|end"]
    rows = [(i, t, "x", 1, 2, "y") for i, t in enumerate(texts)] + [(3, "same id", "x", 1, 2, "y")]
    docs = spark.createDataFrame(rows, TEXT).repartition(3)
    found = huffman.round_trip(docs, JSON).orderBy("start").collect()
    assert len(found) == len(rows)
    at, left = 0, sorted((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids))
                         for r in rows)
    seen = []
    for r in found:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert r["start"] == at and r["n_tokens"] == len(ids) and ids[-1] == huffman.END
        at += len(ids)
        seen.append((r["doc_id"], tuple(ids[:-1])))
    assert [s[0] for s in seen] == sorted(s[0] for s in seen) and sorted(seen) == left
    assert huffman.round_trip(spark.createDataFrame([], TEXT), JSON).count() == 0


def test_op8_query_against_library(spark):
    from tokenizers import Tokenizer
    from lindero.llm.queries import QUERIES
    library = Tokenizer.from_file(JSON)
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    found = {r["doc_id"]: r for r in QUERIES["op8_huffman"](spark, sf).collect()}
    at = 0
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        mine = found[r["doc_id"]]
        assert (mine["start"], mine["n_tokens"], mine["ids_crc32"]) == (
            at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
