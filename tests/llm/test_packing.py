from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import packing

TEXTS = [
    "", None, "Hello, world.", "it's I'LL don't. A.B. x, 3.14 ,. «é.» É. İstanbul. ǅ naïve. é. b, c.\x1cd e.\x0bf", "<|endoftext|> Hi. <|ENDOFTEXT|>", "ＡＢＣ. ﬁ ½ ². 你好。 안녕. q́. ΟΔΟΣ, ſ. K.", "x" * 400, "😀. a😀.", "word " * 9000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))


def test_ids_and_pieces(spark, documents, tokenizer):
    got: dict[int, list] = {}
    for r in packing.pieces(documents(*TEXTS), str(public_tokenizers.path("word_bpe_49k.json"))).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(TEXTS):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got[i]] == [(n, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096])) for n, a in enumerate(range(0, len(ids), 4096))]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizers_go_by_whole_texts(spark, documents, name):
    path = str(public_tokenizers.path(name))
    assert isinstance(packing.encoder(path), packing.WordIds if name.startswith("word") else packing.TextIds)
    plain = Tokenizer.from_file(path)
    rows = {(r.doc_id, r.piece): r for r in packing.pieces(documents(*TEXTS[:7]), path).collect()}
    for i, t in enumerate(TEXTS[:7]):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert rows[i, 0].length == len(ids) and rows[i, 0].ids_crc32 == zlib.crc32(ids)


def test_extra_columns_do_not_clash(spark, documents):
    docs = documents("a b", "c").withColumnRenamed("lang", "bin").withColumnRenamed("source", "piece").withColumnRenamed("n_chars", "offset")
    assert sorted(r.doc_id for r in packing.pack_documents(spark, docs).collect()) == [0, 1]


def test_small_cache_gives_the_same_ids(monkeypatch, tokenizer):
    import pyarrow as pa

    from sparkloom.llm import kernels

    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    encode = packing.WordIds(str(public_tokenizers.path("word_bpe_49k.json")))
    for _ in range(2):
        for _, _, data, offsets in kernels.pieces(pa.array(["one two three four", "five one two"]), 1):
            ids, bounds = encode(data, offsets)
            assert ids.tolist() == [*tokenizer.encode(data.tobytes().decode(), add_special_tokens=False).ids, 1]


def packed(spark, lengths, parts, **options):
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "item_no bigint, length bigint").repartition(parts)
    rows = packing.pack(spark, items, **options).collect()
    assert sorted(r.item_no for r in rows) == list(range(len(lengths)))
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, n in sorted(members):
            assert offset == at
            at += n
        assert at <= options.get("capacity", packing.CAPACITY)
    return len(bins)


def test_best_fit_takes_the_tightest_bin():
    place, offset, fill = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert fill.tolist() == [10, 10] and place.tolist() == [0, 1, 0, 1, 1] and offset.tolist() == [0, 0, 6, 5, 8]


def test_rounds_merge_underfull_bins(spark):
    rng = random.Random(0)
    lengths = [rng.randint(1, 1500) for _ in range(1200)]
    least = -(-sum(lengths) // 4096)
    assert packed(spark, lengths, 12) <= least + 3


def test_items_that_never_fit_together(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 20)
    assert packed(spark, [3000] * 90, 5) == 90


def test_halves(spark):
    assert packed(spark, [2048] * 101, 7) <= 52


def test_edges(spark, documents):
    assert packed(spark, [], 2) == 0
    assert packed(spark, [4096], 1) == 1
    docs = documents((1, "a b"), (1, "a b"), (None, "c"), (2, None))
    rows = packing.pack_documents(spark, docs).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4
    clash = documents("a").withColumnRenamed("lang", "bin").withColumnRenamed("source", "length")
    assert packing.pack_documents(spark, clash).count() == 1
