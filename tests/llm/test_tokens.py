import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from logweave.llm import bpe, packing


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(bpe.vocabulary_path())


def agrees(encoder, text):
    ids = encoder.library.encode(text, add_special_tokens=False).ids
    mine = encoder.encode(text)
    decoded = encoder.library.decode(ids, skip_special_tokens=False)
    return np.frombuffer(mine, "<u4").tolist() == ids and encoder.decode(mine).decode() == decoded


def test_encoding_equals_the_library(encoder):
    random.seed(2)
    letters = [chr(c) for c in [*range(32, 127), *range(160, 600), 0x3A3, 0x130, 0x301, 0x4E2D, 0x1F600, 9, 10, 0x85, 0x1C, 0x2160]]
    for _ in range(3000):
        text = "".join(random.choice(letters[: random.choice([95, 300, len(letters)])]) for _ in range(random.randint(0, 40)))
        assert agrees(encoder, text + random.choice(["", "<|endoftext|>", " it's we'LL "])), text
    for _ in range(3000):
        alphabet = "abcdefghijklmnopqrstuvwxyz"[: random.choice([1, 2, 4, 26])]
        assert agrees(encoder, " ".join("".join(random.choices(alphabet, k=random.randint(1, 30))) for _ in range(4)))
    assert agrees(encoder, "a" * 5000) and agrees(encoder, "") and agrees(encoder, "x<|startoftext|><|endoftext|>Y")


def test_encode_documents(make, odd_rows, encoder):
    found = bpe.encode_documents(make(odd_rows)).collect()
    expected = []
    for doc, text in odd_rows:
        ids = encoder.library.encode(text or "", add_special_tokens=False).ids
        decoded = encoder.library.decode(ids, skip_special_tokens=False)
        expected.append((str(doc), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted((str(r.doc_id), *r[1:]) for r in found) == sorted(expected)
    assert bpe.encode_documents(make([])).count() == 0


def test_words_of_many_lengths_together_and_alone(encoder):
    random.seed(4)
    long = "".join(random.choices("abcdeé1'", k=30_000))
    texts = [long, "", None, " ", "it's we'LL 'sam ''s -'s 1's 'reé r'e <|endoftext|>'s", "x" * 65, "x" * 64 + " " + "y" * 200, "中文 mixé 'Σ"]
    found = encoder.encode_batch(texts)
    expected = [encoder.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == expected
    assert encoder.encode_batch([]) == []


def test_batches_longer_than_a_gathering(encoder, monkeypatch):
    texts = ["a b c d e", "", "f g", "one two three four five six seven", " h "]
    whole = encoder.encode_batch(texts)
    for size in (1, 2, 3, 5):
        monkeypatch.setattr(bpe, "GATHERED", size)
        assert encoder.encode_batch(texts) == whole


def test_table_that_fills_up():
    table = bpe.Table(lambda key: key % 1000 + 1, bits=6)
    keys = np.random.default_rng(1).integers(0, 1 << 40, 500)
    for part in (keys[:10], keys[:200], keys[100:], keys[::-1], keys[:0]):
        assert table.get(part).tolist() == (part % 1000 + 1).tolist()
        assert table.used <= 32


def test_partition_is_even_and_within_capacity():
    random = np.random.default_rng(3)
    lengths = np.minimum(random.lognormal(6, 1, 800).astype(int) + 1, 4095)
    window = packing.partition(lengths)
    sums = np.bincount(window, lengths)
    assert sums.max() <= 4096 and sums.sum() / 4096 / len(sums) > 0.95
    assert packing.partition(np.array([4095])).tolist() == [0]
    assert len(set(packing.partition(np.array([3000, 3000, 3000])).tolist())) == 3
    assert sorted(np.bincount(packing.difference(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]


def test_pack(make, odd_rows, encoder):
    pieces = packing.pack(make(odd_rows), batch_tokens=20_000).collect()
    sequences, ids = defaultdict(list), defaultdict(list)
    for doc, text in odd_rows:
        ids[doc].append(encoder.library.encode(text or "", add_special_tokens=False).ids + [2])
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        whole = [i for i in ids[p.doc_id] if len(i) == p.doc_tokens]
        assert any(zlib.crc32(struct.pack(f"<{p.length}I", *w[p.start : p.start + p.length])) == p.ids_crc32 for w in whole)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert sum(p.length for p in pieces) == sum(len(i) for all_ids in ids.values() for i in all_ids)
    assert packing.pack(make([])).count() == 0


def test_pack_a_million_empty_texts(spark):
    texts = spark.range(1_000_000, numPartitions=8).selectExpr("id AS doc_id", "if(id % 3 = 0, null, '') AS text")
    found = packing.pack(texts).groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] for r in found) == 1_000_000 and max(r[1] for r in found) <= 4096
    assert len(found) <= 1.3 * 1_000_000 / 4096
