"""Token counts, token ids and their files against the libraries themselves."""

import io
import random

import numpy as np
import public_tokenizers
import pytest

from textloom.llm import token_counts, token_ids

ALPHABET = "abcdefgh'stnéßÉΣ1903  \n\t.,!-<|>/s▁①🙂\x00́ \x1c"


def random_texts(n, seed=5):
    rng = random.Random(seed)
    words = ["the", "of", "don't", "<|endoftext|>", "<s>", "thonre", "Ünter", "ENDED!!", "###", "  ", "\n", " \n", "\n ", "   "]
    for _ in range(n):
        if rng.random() < 0.5:
            yield "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60)))
        else:
            yield " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))


def test_counts_equal_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    machine = token_counts.Transducer.from_model(path)
    for text in random_texts(4000):
        want = len(library.encode(text))
        assert machine.count(text) == want, text
        assert machine.count(text, chunk=7) == want, text  # by chunk maps
    assert machine.count(None) == machine.count("") == 0


@pytest.mark.parametrize("text", ["a" * 1_000_000, "ththeren" * 40_000 + "é" * 999, "some words and lines\n" * 8_000, "  ▁ \n" * 30_000, "x y " * 16_384 + "z"])
def test_counts_of_long_texts(text):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for part in (text, text[: (1 << 16) - 1], text[: (1 << 16) - 2], text[: 1 << 16]):
        assert token_counts.transducer(path).count(part) == len(library.encode(part))


def test_maps_of_all_prefixes():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, machine = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.Transducer.from_model(path, states=500)
    for text in [*random_texts(60), "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "thethethethethethe"]:
        marked = token_counts.MARK + text.replace(" ", token_counts.MARK)
        for chunk in (1, 3, 10):
            maps = machine.prefix_scan([machine.chunk_map(marked[i : i + chunk]) for i in range(0, len(marked), chunk)])
            for k, prefix in enumerate(maps):
                part = text[: max(0, (k + 1) * chunk - 1)]
                if part:
                    assert prefix.count == len(library.encode(part)), (text, chunk, k)


def test_counts_do_not_depend_on_memory_bounds():
    path = public_tokenizers.path("piece_bpe_32k.model")
    small, large = token_counts.Transducer.from_model(path, states=50), token_counts.transducer(path)
    for text in random_texts(300):
        assert small.count(text) == large.count(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library, texts = Tokenizer.from_file(path), list(random_texts(4000))
    for text, ids in zip(texts, token_ids.encoded(texts, path), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert list(token_ids.encoded([None, ""], path)) == [b"", b""]


@pytest.mark.parametrize("values", [[0], [5, 5, 5], [0, 2**32 - 1], list(range(1000)), [7] * 99 + [2**31]])
def test_block_round_trip(values):
    ids = np.array(values, np.uint32)
    assert token_ids.unpack_block(token_ids.pack_block(ids)).tolist() == values


def test_file_round_trip():
    rng = np.random.default_rng(3)
    docs = [(None, []), (-4, [1]), (2, rng.integers(0, 50_000, 70_000).tolist()), (2, []), (9, [2**32 - 1] * 5000)]
    out = io.BytesIO()
    writer = token_ids.TokenFileWriter(out)
    for doc_id, ids in docs:
        writer.add(doc_id, np.array(ids, "<u4").tobytes())
    writer.close()
    back = list(token_ids.read_documents(io.BytesIO(out.getvalue()), len(out.getvalue())))
    assert [(d, ids.tolist()) for d, ids in back] == docs


def test_empty_file():
    out = io.BytesIO()
    token_ids.TokenFileWriter(out).close()
    assert list(token_ids.read_documents(io.BytesIO(out.getvalue()), len(out.getvalue()))) == []


def test_spark_files(spark, tmp_path):
    rows = [(3, "b a", 1), (None, "x", 2), (3, "a", 3), (1, None, 4), (7, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = f"file://{tmp_path}/ids"
    files = token_ids.write_token_files(docs, folder, path, 2)
    got = [tuple(r) for r in token_ids.read_token_files(spark, folder, files).orderBy("start").collect()]
    assert [(r[0], r[1], r[2]) for r in got] == [(None, 0, 2), (1, 2, 1), (3, 3, 2), (3, 5, 3), (7, 8, 1)]
    empty = token_ids.write_token_files(docs.limit(0), folder, path, 2)
    assert token_ids.read_token_files(spark, folder, empty).count() == 0


def test_spark_counts(spark):
    docs = spark.createDataFrame([(1, None, 9), (1, "", 9), (None, "a b", 9), (2, "é" * 5000, 9)], "doc_id long, text string, n_bytes int")
    rows = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=100).collect()
    assert [(r.doc_id, r.n_bytes, r.over_limit) for r in rows] == [(1, 0, False), (1, 0, False), (None, 3, False), (2, 10000, True)]
    assert [r.n_tokens for r in rows][:3] == [0, 0, 2]
