import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lindero.llm import queries, token_counts
from lindero.llm import words as words_module

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def counted(library, texts):
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


ODD = [None, "", " ", "\n", "a", " a", "a ", "a  b", "a\n b", "a \nb", "it's the 3rd 'll", "漢字 kana かな",
       "x y  z", "a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endof",
       "tab\tone \t two", "emoji 👩‍👩‍👧 ok", "\x1c x \x85 y", "!!! ... ???" * 30, "é" * 500]


def words(seed, n):
    rng = random.Random(seed)
    marks = ["<|endoftext|>", "\n", "  ", "don't", "2024", "...", "ß", "漢字", "\t", "word", "Straße", "a" * 40]
    return " ".join(rng.choice(marks) for _ in range(n))


def test_words_give_the_library_counts(library):
    texts = ODD + [words(i, 200) for i in range(20)]
    own = token_counts.TokenCounter(PATH)
    for _ in range(2):  # the second time from memory
        assert own.counts(texts) == counted(library, texts)


def test_words_of_all_characters_below_the_bound(library):
    from lindero.llm.words import Words
    own, rng = Words(library), random.Random(5)
    chars = [chr(c) for c in range(0x250)] + list(3 * "'" + "  \n\nsdmtrevl019.,")
    for _ in range(400):
        text = "".join(rng.choice(chars) for _ in range(60))
        ids = array(own.code, library.encode(text, add_special_tokens=False).ids).tobytes()
        assert own.ids([text]) == [ids]


def test_memory_of_words_is_bounded(library, monkeypatch):
    monkeypatch.setattr(words_module, "REMEMBERED", 50)
    own = token_counts.TokenCounter(PATH)
    texts = [" ".join(f"{chr(97 + i)}x{chr(97 + k)}q" for k in range(26)) for i in range(20)]
    assert own.counts(texts) == counted(library, texts)
    assert len(own.words.known) + len(own.words.known.older) <= 100


@pytest.mark.parametrize("length,overlap", [(64, 32), (700, 100)])
def test_spliced_chunks_give_the_library_counts(spark, library, length, overlap):
    texts = ODD + [words(i, 400) for i in range(12)] + [
        "x" * 5000,                       # no word start anywhere: widened until one chunk is left
        "b " + "y" * 900 + " c" * 300,
        " " * 700 + "z", "<|endoftext|>" * 80, "\n" * 400, "a  " * 300]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[-3:], "doc_id int, text string, n_tokens string")
    found = token_counts.count_tokens(docs, PATH, length, overlap)
    assert found.columns == ["doc_id", "text", "n_bytes", "n_tokens"]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found.collect())
    want = [(i, len((t or "").encode()), n)
            for i, (t, n) in enumerate(zip(texts, counted(library, texts)))]
    assert got == sorted(want + want[-3:])


def test_a_chunk_must_exceed_its_overlap(spark):
    docs = spark.createDataFrame([(1, "a b " * 99)], "doc_id int, text string")
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, PATH, 10, 10)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id int, text string, digest string, part int")
    assert token_counts.count_tokens(docs, PATH).collect() == []


def test_registered_query(spark, library, tmp_path):
    long = words(5, 9000)
    texts = [None, "", "hello world", long, long, "u" * 40000, "a <|endoftext|>"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["op11_token_counts"](spark, str(tmp_path)).collect()))
    assert got == [(i, len((t or "").encode()), n, n > 512)
                   for i, (t, n) in enumerate(zip(texts, counted(library, texts)))]
