"""Byte-level BPE against the public library, and what its queue does."""

from __future__ import annotations

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from leaksieve.llm import byte_bpe
from tests.conftest import SF
from tests.llm.test_operators import LONG, TEXTS, empty, frame


def library(name: str) -> tiktoken.Encoding:
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts() -> list[str]:
    rng = random.Random(4)
    return [
        "", " ", "\n\n  \t x", "I'm 'll they'RE 12.5%", "x\r\n\r\n y", "a\x1c\x1d\x85  b​c　d", "日本語のテキスト " * 50,
        "<|endoftext|> <|startoftext|>", "a" * 9_999, "ab" * 5_000, "é" * 3_000, " " * 5_000 + "x", LONG[:20_000],
        "".join(rng.choice("abcdefgh") for _ in range(20_000)),
        "".join(chr(rng.randrange(1, 0x3000)) for _ in range(5_000)),
        "".join(rng.choice(" \n\tab1!é") for _ in range(60_000)),
    ]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_are_those_of_the_library(name, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PART", 5_000)  # long texts in many parts
    known, own = library(name), byte_bpe.Encoder(public_tokenizers.path(name), public_tokenizers.PATTERN)
    for _ in range(2):  # the second time from memory
        for text, ids in zip(odd_texts(), own.encode(odd_texts()), strict=True):
            assert np.frombuffer(ids, "<i4").tolist() == known.encode_ordinary(text)


def test_memory_is_bounded_and_changes_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    known = library("byte_bpe_50k.tiktoken")
    own = byte_bpe.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = [f"word{n} and word{n % 7}, {'x' * 100}" for n in range(200)]
    for low in range(0, 200, 10):
        for text, ids in zip(texts[low : low + 10], own.encode(texts[low : low + 10]), strict=True):
            assert np.frombuffer(ids, "<i4").tolist() == known.encode_ordinary(text)
        assert len(own.known) <= 50 + 40 and max(map(len, own.known)) <= byte_bpe.REMEMBERED_LENGTH


@pytest.mark.parametrize("seed", range(20))
def test_any_ranks_merge_lowest_first(seed):
    """Ranks in no order of merges: a merge may make a pair of lower rank."""
    rng = random.Random(seed)
    tokens = [bytes([b]) for b in range(256)]
    for _ in range(60):
        made = rng.choice(tokens[97:101] + tokens[256:]) + rng.choice(tokens[97:101] + tokens[256:])
        if made not in tokens:
            tokens.append(made)
    tail = tokens[256:]
    rng.shuffle(tail)
    merger = byte_bpe.Merger(tokens[:256] + tail)

    def by_hand(piece: bytes) -> list[int]:
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((merger.ranks.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [merger.ranks[part] for part in parts]

    pieces = [bytes(rng.choices(b"abcd", k=rng.randint(0, 60))) for _ in range(50)]
    want = [by_hand(piece) for piece in pieces]
    for wide in (1, 3, 1 << 30):
        assert [np.frombuffer(ids, "<i4").tolist() for ids in merger._merge(pieces, wide)] == want


def test_queue_gives_the_lowest_rank():
    rng, queue, held = random.Random(1), byte_bpe.RankQueue(300_000), {}
    for _ in range(2_000):
        rank = rng.randrange(300_000)
        held.setdefault(rank, []).append(len(held))
        queue.push(rank, len(held))
    for rank in sorted(held):
        assert queue.first() == rank
        queue.drop(rank)
    assert queue.first() == -1


def test_a_very_long_pre_token_takes_time_in_proportion():
    own = byte_bpe.Merger(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    piece = "".join(random.Random(2).choices("abcdefghij", k=400_000)).encode()
    started = time.perf_counter()
    own.merge([piece])
    assert time.perf_counter() - started < 20


def test_wrong_files_are_refused(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(base64.b64encode(b"a") + b" 1\n")
    with pytest.raises(ValueError, match="ranks"):
        byte_bpe.read_ranks(str(path))
    with pytest.raises(ValueError, match="byte"):
        byte_bpe.Merger([b"a", b"b"])


def test_query_and_round_trip(spark):
    known = library("byte_bpe_50k.tiktoken")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = byte_bpe.op13_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = known.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_odd_rows(spark):
    rows = byte_bpe.decode(byte_bpe.encode(frame(spark))).collect()
    assert sorted((r.doc_id is None, r.doc_id, bytes(r.decoded).decode()) for r in rows if r.doc_id is not None) == sorted(
        (False, i, t or "") for i, t in TEXTS if i is not None
    )
    assert [bytes(r.decoded).decode() for r in rows if r.doc_id is None] == [t for i, t in TEXTS if i is None]
    assert byte_bpe.decode(byte_bpe.encode(empty(spark))).collect() == []


@pytest.mark.parametrize("wide", [1, 2, 1 << 30])
def test_wide_buckets_are_merged_alike(wide):
    merger = byte_bpe.Merger(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    known, rng = library("byte_bpe_50k.tiktoken"), random.Random(6)
    pieces = [("x" + "".join(rng.choices("aethers", k=rng.randint(0, 40)))) for _ in range(800)] + ["a" * n for n in range(1, 60)]
    ids = merger._merge([piece.encode() for piece in pieces], wide)
    assert [np.frombuffer(own, "<i4").tolist() for own in ids] == [known.encode_ordinary(piece) for piece in pieces]
