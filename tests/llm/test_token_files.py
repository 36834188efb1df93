"""Token files: wavelet matrix, encoder, files written and read back."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kharif.llm import token_files as tf

DOCS = "doc_id long, text string, shard string, start long, n int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tf.vocabulary_path())


@pytest.mark.parametrize("n", [0, 1, 5, 511, 512, 513, 70_000])
def test_matrix_answers_from_its_bytes(n):
    draw = np.random.default_rng(n)
    ids = draw.integers(0, 60 if n < 600 else 50_257, n)
    file = tf.pack_shard([None, 5], [n // 2, n - n // 2], ids)
    shard = tf.Shard(file + b"\n")  # as the sink leaves it
    assert shard.doc_ids == [None, 5] and (shard.tokens.ids() == ids).all()
    if n:
        at = draw.integers(0, n, 50)
        assert (shard.tokens.access(at) == ids[at]).all()
        for t in [*map(int, ids[:5]), 77, 60_000, 1 << 20]:
            assert (shard.tokens.positions(t) == np.flatnonzero(ids == t)).all()
            lo = draw.integers(0, n, 9)
            hi = np.minimum(n, lo + draw.integers(0, n, 9))
            assert (shard.tokens.count(t, lo, hi) == [(ids[a:b] == t).sum() for a, b in zip(lo, hi)]).all()
        with pytest.raises(ValueError):
            tf.Shard(file[:-1] + bytes([file[-1] ^ 1]))


def test_encoder_equals_the_library(library):
    encoder, draw = tf.Encoder(tf.vocabulary_path()), random.Random(3)
    odd = [*"ab Zé.,;!?\n\t 1'sx—Жƻ×÷\x1c 　🙂ıİǅ<|>_\r\x0b\x85字\x01\x02", " ", "  ", "<|endoftext|>", " 's", "'ll", "\n\n", " \n"]
    plain = [*"ab Zé.,;!?\n1'sxƻ×÷ıİǅ<|>_", "'s", " ", "the "]
    for k in range(20):
        texts = ["".join(draw.choice(odd if i % 2 else plain) for _ in range(draw.randint(0, 30))) for i in range(1000)]
        ids, at = encoder.encode(pa.array([*texts, None]))
        for text, a, b in zip(texts, at, at[1:]):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text


def rows():
    draw = random.Random(1)
    said = [" ".join(draw.choice(["the", "old", "Größe", "x9", "end."]) for _ in range(draw.randint(0, 50))) for _ in range(300)]
    out = [(draw.randint(-1000, 1000), t) for t in said]
    return out + [(None, "no id"), (None, None), (7, None), (7, ""), (8, "same"), (8, "same"), (9, "long " * 60_000), (2**62, "<|endoftext|> a")]


def test_files_read_back(spark, tmp_path, library):
    table = spark.createDataFrame([(i, t, "s", 4, 1) for i, t in rows()], DOCS)
    path = tf.write_files(table, f"file://{tmp_path}/out", shard_tokens=2000)
    got = sorted(map(tuple, tf.with_starts(tf.read_documents(spark, path)).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    want = {}
    for i, t in rows():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [g[1] for g in got] == sorted((i for i, _ in rows()), key=lambda i: (i is not None, i or 0))
    at = 0
    for start, doc, n, crc in got:
        assert start == at and (n, crc) in want[doc]
        want[doc].remove((n, crc))
        at += n
    assert not any(want.values())
    the, shards = library.encode(" the").ids[0], tf.open_files(spark, path).count()
    assert shards > 5
    counts = {r["token"]: r["sum(n)"] for r in tf.token_counts(spark, path, [the, 2, 50_000]).groupBy("token").sum("n").collect()}
    assert counts[2] == len(rows())
    places = tf.occurrences(spark, path, the).collect()
    assert len(places) == counts[the] == sum((library.encode(t or "").ids).count(the) for _, t in rows())


def test_empty_table(spark, tmp_path):
    path = tf.write_files(spark.createDataFrame([], DOCS), f"file://{tmp_path}/none")
    assert tf.with_starts(tf.read_documents(spark, path)).collect() == []
