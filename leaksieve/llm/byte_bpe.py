"""Byte-level BPE: texts to token ids and back, by a file of ranks.

A text is cut into pre-tokens by a pattern; in each, the neighbouring tokens whose joined bytes have the lowest rank
are merged, the leftmost first, until no pair has a rank. Pairs wait in a queue with a bucket per rank, which holds positions
in a linked list of tokens; a hierarchy of bitmaps says which buckets hold any, so that find-first-set gives the next rank in
as many steps as it has levels. A merge changes its neighbours' pairs, whose old entries go stale and are skipped when they come up.
Work is therefore proportional to merges, however long a pre-token is, and all new pre-tokens of a batch share one queue:
they do not touch each other, so the lowest rank of all is the lowest of its own.

Every row is encoded in place: nothing is shuffled and a task that is run again gives the same rows. A null text is empty and
has no ids; strings of special tokens are ordinary text; bytes that are no UTF-8 become U+FFFD, as Python's "replace" has it.
Long texts are cut where a blank follows another character, which is always a border of the pattern's, so memory is bounded by the
longest text and pre-token. Repeated rows are encoded as often as they occur; an empty table gives no row.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.llm.common import binary, kept_by_worker, table

#: Pre-tokens whose ids a worker remembers, and the longest of them in characters. Others are encoded whenever they occur.
REMEMBERED, REMEMBERED_LENGTH = 500_000, 64
#: Texts are cut into parts of about so many characters, pre-tokens encoded together into so many bytes.
PART, TOGETHER = 1 << 18, 1 << 20
#: Buckets of so many positions are merged with array operations.
WIDE = 24

def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"ranks of {path!r} are not 0, 1, 2, ...")
    return [ranks[n] for n in range(len(ranks))]


class RankQueue:
    """Positions by rank, the lowest rank first. A bucket is sorted when its turn comes, the lowest position last."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.levels: list[list[int]] = []
        while not self.levels or ranks > 1:
            ranks = -(-ranks // 64)
            self.levels.append([0] * ranks)

    def put(self, rank: int, positions: list[int]) -> None:
        """A new bucket."""
        self.buckets[rank] = positions
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            held = level[word]
            level[word] = held | bit
            if held:
                break
            rank = word

    def extend(self, positions: np.ndarray, ranks: np.ndarray) -> None:
        """Adds each position to the bucket of its own rank."""
        if not len(positions):
            return
        own = ranks[positions]
        order = np.argsort(own, kind="stable")
        own, positions = own[order], positions[order]
        cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
        starts = [0, *cuts.tolist()]
        listed = positions.tolist()
        for rank, low, high in zip(own[starts].tolist(), starts, [*starts[1:], len(listed)], strict=True):
            bucket = self.buckets.get(rank)
            if bucket is None:
                self.put(rank, listed[low:high])
            else:
                bucket += listed[low:high]

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.put(rank, [position])
        else:
            bucket.append(position)

    def first(self) -> int:
        """The lowest rank that has a bucket; -1 if there is none."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return -1
            at = at << 6 | ((word & -word).bit_length() - 1)
        return at

    def drop(self, rank: int) -> None:
        del self.buckets[rank]
        for level in self.levels:
            word = rank >> 6
            level[word] &= ~(1 << (rank & 63))
            if level[word]:
                break
            rank = word


class Merger:
    """Token ids of pre-tokens."""

    def __init__(self, tokens: Sequence[bytes]):
        self.tokens = list(tokens)
        self.ranks = {token: rank for rank, token in enumerate(tokens)}
        self.longest = max(map(len, tokens), default=0)
        single = [self.ranks.get(bytes([b]), -1) for b in range(256)]
        if min(single) < 0:
            raise ValueError("a byte has no rank")
        self.single = np.array(single, np.int32)
        pairs = np.full(1 << 16, -1, np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                pairs[token[0] << 8 | token[1]] = rank
        self.pairs = pairs

    @cached_property
    def _joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (left token, right token) of all pairs that have a rank, and those ranks."""
        rank_of, found = self.ranks.get, []
        for rank, token in enumerate(self.tokens):
            for cut in range(1, len(token)):
                left, right = rank_of(token[:cut]), rank_of(token[cut:])
                if left is not None and right is not None:
                    found.append((left << 32 | right, rank))
        keys, ranks = np.array(found or [(-1, -1)], np.int64).T
        order = np.argsort(keys)
        return keys[order], ranks[order].astype(np.int32)

    def merge(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian 32-bit integers."""
        out: list[bytes] = []
        held, size = [], 0
        for piece in pieces:
            held.append(piece)
            size += len(piece) + 1
            if size >= TOGETHER:
                out += self._merge(held)
                held, size = [], 0
        return out + (self._merge(held) if held else [])

    def _merge(self, pieces: list[bytes], wide: int = WIDE) -> list[bytes]:
        """A token is known by the position of its first byte; a gap of one byte stands behind each piece."""
        data = b"\0".join([*pieces, b""])
        ends = np.cumsum([len(piece) + 1 for piece in pieces]) - 1  # the gaps
        bytes_ = np.frombuffer(data, np.uint8)
        token = self.single[bytes_]
        token[ends] = -1
        rank = np.full(len(data), -1, np.int32)
        rank[:-1] = self.pairs[bytes_[:-1].astype(np.int32) << 8 | bytes_[1:]]
        rank[ends] = -1
        rank[ends[ends > 0] - 1] = -1
        after = np.arange(1, len(data) + 1, dtype=np.int32)
        after[ends] = -1
        before = np.arange(-1, len(data) - 1, dtype=np.int32)
        before[0] = -1
        before[ends[:-1] + 1] = -1
        queue = RankQueue(len(self.tokens))
        queue.extend(np.flatnonzero(rank >= 0), rank)
        again = self._run(data, queue, token, rank, after, before, wide)
        left = token >= 0
        ids = token[left].astype("<i4").tobytes()
        upto = (4 * np.cumsum(left)[ends]).tolist()
        out = [ids[a:b] for a, b in zip([0, *upto], upto, strict=False)]
        for number in np.unique(np.searchsorted(ends, again)).tolist():
            out[number] = self._merge([pieces[number]], len(data) + 1)[0]
        return out

    def _run(
        self, data: bytes, queue: RankQueue, token: np.ndarray, rank: np.ndarray, after: np.ndarray, before: np.ndarray, wide: int
    ) -> list[int]:
        """Merges until the queue is empty. ``rank[i]`` is that of the pair which begins at i, -1 if there is none.

        A bucket of ``wide`` positions or more is merged at once. Where that makes a pair of lower rank, which only ranks in no order
        of merges can, a position is returned: its piece has to be merged one pair at a time.
        """
        token_, rank_, after_, before_ = map(memoryview, (token, rank, after, before))
        rank_of, longest, push, buckets = self.ranks.get, self.longest, queue.push, queue.buckets
        again: list[int] = []
        lowest = queue.first()
        while lowest >= 0:
            bucket = buckets[lowest]
            if len(bucket) >= wide:
                queue.drop(lowest)
                again += self._run_bucket(np.array(bucket), lowest, queue, token, rank, after, before)
                lowest = queue.first()
                continue
            bucket.sort(reverse=True)
            while bucket:
                at = bucket.pop()
                if rank_[at] != lowest:
                    continue
                second = after_[at]
                end = after_[second]
                token_[at], token_[second], rank_[second], after_[at] = lowest, -1, -1, end
                follows, ahead, back, new = after_[end], before_[at], False, -1
                if follows >= 0:  # else a gap
                    before_[end] = at
                    if follows - at <= longest:
                        new = rank_of(data[at:follows], -1)
                        if new >= 0:
                            push(new, at)
                            back = new < lowest
                rank_[at] = new
                if ahead >= 0:
                    new = rank_of(data[ahead:end], -1) if end - ahead <= longest else -1
                    rank_[ahead] = new
                    if new >= 0:
                        push(new, ahead)
                        back = back or new < lowest
                if back:  # possible where ranks are not in the order of merges
                    break
            else:
                queue.drop(lowest)
            lowest = queue.first()
        return again

    def _run_bucket(
        self, at: np.ndarray, lowest: int, queue: RankQueue, token: np.ndarray, rank: np.ndarray, after: np.ndarray, before: np.ndarray
    ) -> list[int]:
        at = np.sort(at[rank[at] == lowest])
        second = after[at]
        linked = np.zeros(len(at), bool)
        linked[1:] = at[1:] == second[:-1]
        if linked.any():
            # Pairs that overlap: of each chain the first, third, ... are merged.
            number = np.arange(len(at))
            kept = (number - np.maximum.accumulate(np.where(linked, 0, number))) % 2 == 0
            at, second = at[kept], second[kept]
        end = after[second]
        token[at], token[second], rank[second], after[at] = lowest, -1, -1, end
        inner = after[end] >= 0
        before[end[inner]] = at[inner]
        ahead = before[at]
        changed = np.unique(np.concatenate([at, ahead[ahead >= 0]]))
        right = after[changed]
        rank[changed] = -1
        paired = after[right] >= 0
        changed, right = changed[paired], right[paired]
        keys, ranks = self._joined
        key = token[changed].astype(np.int64) << 32 | token[right]
        found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[found] == key
        changed, new = changed[hit], ranks[found[hit]]
        rank[changed] = new
        queue.extend(changed, rank)
        return changed[new < lowest].tolist()


class Encoder:
    """Token ids of whole texts, with the ids of common pre-tokens remembered."""

    def __init__(self, path: str, pattern: str):
        self.merger = Merger(read_ranks(path))
        self.pattern, self.border = regex.compile(pattern), regex.compile(r"(?<=\S)\s")
        self.known: dict[str, bytes] = {}

    def _parts(self, text: str) -> Iterator[str]:
        low = 0
        while len(text) - low > 2 * PART and (found := self.border.search(text, low + PART)):
            yield text[low : found.start()]
            low = found.start()
        yield text[low:]

    def _learn(self, fresh: list[str]) -> None:
        data = [piece.encode() for piece in fresh]
        ranks = self.merger.ranks
        whole = [ranks.get(piece) for piece in data]
        merged = iter(self.merger.merge([piece for piece, rank in zip(data, whole, strict=True) if rank is None]))
        self.known.update(
            (piece, next(merged) if rank is None else rank.to_bytes(4, "little"))
            for piece, rank in zip(fresh, whole, strict=True)
        )

    def _ids(self, parts: Sequence[str]) -> list[bytes]:
        split = [self.pattern.findall(part) for part in parts]
        held = [list(map(self.known.get, pieces)) for pieces in split]
        fresh = {piece for pieces, ids in zip(split, held, strict=True) if None in ids
                 for piece, own in zip(pieces, ids, strict=True) if own is None}
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {}
        self._learn(list(fresh))
        get, out = self.known.get, []
        for pieces, ids in zip(split, held, strict=True):
            if None in ids:
                ids = [get(piece) if found is None else found for piece, found in zip(pieces, ids, strict=True)]
            out.append(b"".join(ids))
        for piece in fresh:
            if len(piece) > REMEMBERED_LENGTH:
                del self.known[piece]
        return out

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        out: list[list[bytes]] = []
        waiting: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            for (number, _), ids in zip(waiting, self._ids([part for _, part in waiting]), strict=True):
                out[number].append(ids)
            waiting.clear()

        for number, text in enumerate(texts):
            out.append([])
            for part in self._parts(text):
                waiting.append((number, part))
                size += len(part)
                if size > 8 * PART:
                    flush()
                    size = 0
        flush()
        return [b"".join(parts) for parts in out]


def _lists(data: Sequence[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *(len(ids) // 4 for ids in data)])
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(data))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = kept_by_worker(("byte-bpe", path, pattern), lambda: Encoder(path, pattern))
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            rows = batch.slice(low, 1024)
            texts = [(text or b"").decode("utf-8", "replace") for text in binary(rows.column(1))]
            yield pa.RecordBatch.from_arrays([rows.column(0), _lists(encoder.encode(texts))], ["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokens = kept_by_worker(("byte-bpe tokens", path), lambda: pa.array(read_ranks(path), pa.large_binary()))
    for batch in batches:
        ids = batch.column("ids")
        joined = tokens.take(ids.flatten())
        # The tokens of a row lie side by side, so its bytes are those between its first and its last.
        at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
        counts = np.array(ids.value_lengths().fill_null(0))
        offsets = at[np.cumsum([0, *counts])] if len(joined) else np.zeros(len(ids) + 1, np.int64)
        data = joined.buffers()[2] or pa.py_buffer(b"")
        texts = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets.astype(np.int64)), data])
        yield pa.RecordBatch.from_arrays([*batch.columns, texts.cast(pa.binary())], [*batch.schema.names, "decoded"])


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """(doc_id, ids) of every row; ``ranks`` is the path of a rank file that all executors can read."""
    path, pattern = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(lambda batches: _encode(batches, path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """The rows of ``encode`` with the bytes that their ids stand for, as ``decoded``."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encoded.mapInArrow(lambda batches: _decode(batches, path), "doc_id long, ids array<int>, decoded binary")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode(encode(table(spark, sf_dir, "documents")))
    digits = F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(digits, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
