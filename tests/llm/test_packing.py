import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leafwise.llm import packing
from tests.llm.cases import documents, empty, frame


def test_pieces_are_those_of_the_tokenizer_and_sequences_gapless(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    cases = documents() + [
        (400_001, "two  spaces and\n newline\u00a0 nbsp\u3000 x end ", "en", "s"),
        (400_002, " lead <|endoftext|> special", "en", "s"),
        (400_003, "it's we'll 123 45,6 !!", "en", "s"),
    ]
    packed = packing.pack_documents(frame(spark, cases), with_ids=True).collect()
    wanted = defaultdict(int)
    for doc_id, text, *_ in cases:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        start, size, piece = 0, (len(ids) - 1) % 2048 + 1, 0
        while start < len(ids):
            wanted[doc_id, piece, start, size, zlib.crc32(ids[start : start + size].tobytes())] += 1
            start, size, piece = start + size, 2048, piece + 1
    found, places = defaultdict(int), defaultdict(list)
    for r in packed:
        found[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == r["length"]
    assert found == wanted
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in packed)
    assert len(places) <= -(-total // 2048) + 3


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), min_size=1, max_size=40), st.integers(1, 12))
def test_runs_place_every_piece_once(counts, groups):
    runs, n = packing.packing_runs(counts, 64, groups)
    filled, ranks = defaultdict(list), defaultdict(list)
    for length, rank, count, first, each, offset in runs:
        for k in range(count):
            ranks[length].append(rank + k)
            filled[first + k // each].append((offset + k % each * length, length))
    assert {length: sorted(r) for length, r in ranks.items()} == {length: list(range(c)) for length, c in counts.items()}
    for own in filled.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 64
    assert n == len(filled)
    assert n <= 1.25 * sum(k * v for k, v in counts.items()) / 64 + 40 or max(counts) > 32


@pytest.mark.parametrize("n", [1, 5000])
def test_equal_pieces(n):
    runs, sequences = packing.packing_runs({500: n}, 2048)
    assert sequences == -(-n // 4) and sum(r[2] for r in runs) == n


def test_sequences_round_trip(spark):
    packed = packing.pack_documents(frame(spark, documents()[:40]), with_ids=True)
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]


def test_empty_table(spark):
    assert packing.pack_documents(empty(spark)).collect() == []
