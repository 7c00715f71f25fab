"""Best-fit packing of tokenised documents into sequences of bounded length.

Every row is a document; a null text is an empty one, which is the closing id alone. Repeated rows are
packed as often as they occur. Each task packs its own rows in their order, so nothing is shuffled, memory
is bounded by the open bins, and a task that is run again gives the same rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leaksieve.llm.common import binary, kept_by_worker, table

LENGTH = 4096
OPEN_BINS = 256
END_ID = 1


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


class ChunkEncoder:
    """Token ids of whole texts, put together from the ids of their blank-separated chunks.

    The tokenizer drops white space and none of its pieces spans any, so a text's ids are those of its
    chunks. A-Z are lower-cased first, as it does itself. Chunks of ASCII and small Latin-1 letters are cut into pieces as
    its pattern does, and its model is asked for each piece; other chunks go through all of it. Ids are
    little-endian bytes, remembered for at most ``memory`` chunks and as many pieces.

    Strings of special tokens are ordinary text; with ``special`` they get their ids, as the library's plain call gives them.
    """

    def __init__(self, path: str, memory: int = 250_000, special: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.tokenizer.encode_special_tokens = self.tokenizer.model, True
        self.memory, self.known, self.pieces = memory, {}, {}
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        letters = "a-zß-öø-ÿ"
        self._simple = re.compile(rf"[!-@\[-~{letters}]+")
        self._cut = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{letters}]+|[0-9]|[^0-9{letters}]+")
        self._spelt = str.maketrans({chr(b): letter for b, letter in enumerate(byte_letters())})

    def _piece(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._spelt)
        return b"".join([token.id.to_bytes(4, "little") for token in self.model.tokenize(spelt)])

    def _learn(self, chunks: list[bytes]) -> None:
        texts = [chunk.decode("utf-8", "replace") for chunk in chunks]
        odd = []
        pieces, cut, simple = self.pieces, self._cut.findall, self._simple.fullmatch
        for chunk, text in zip(chunks, texts, strict=True):
            if not simple(text):
                odd.append((chunk, text))
                continue
            ids = []
            for piece in cut(text):
                found = pieces.get(piece)
                if found is None:
                    found = pieces[piece] = self._piece(piece)
                ids.append(found)
            self.known[chunk] = b"".join(ids)
        for low in range(0, len(odd), 20_000):
            self._learn_odd(odd[low : low + 20_000])
        if len(pieces) > self.memory:
            self.pieces = {}

    def _learn_odd(self, part: list[tuple[bytes, str]]) -> None:
        """Encodes chunks as one text and cuts its ids where the chunks begin."""
        starts = np.cumsum([0, *(len(text) + 1 for _, text in part)])
        found = self.tokenizer.encode("\n".join(text for _, text in part), add_special_tokens=False)
        begins = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
        ids = np.array(found.ids, "<u4").tobytes()
        cuts = (4 * np.searchsorted(begins, starts)).tolist()
        self.known.update((chunk, ids[a:b]) for (chunk, _), a, b in zip(part, cuts, cuts[1:], strict=False))

    def _marked(self, text: bytes) -> bytes:
        self.tokenizer.encode_special_tokens = False
        found = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        self.tokenizer.encode_special_tokens = True
        return np.array(found, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        marked = {n: self._marked(text) for n, text in enumerate(texts) if any(mark in text for mark in self.marks)}
        split = [[] if n in marked else text.lower().split() for n, text in enumerate(texts)]
        held = [list(map(self.known.get, chunks)) for chunks in split]
        new = {chunk for chunks, ids in zip(split, held, strict=True) if None in ids for chunk, own in zip(chunks, ids, strict=True) if own is None}
        if new:
            if len(self.known) + len(new) > self.memory:
                self.known = {}
            self._learn(list(new))
            get = self.known.get
            held = [
                [get(chunk) if own is None else own for chunk, own in zip(chunks, ids, strict=True)] if None in ids else ids
                for chunks, ids in zip(split, held, strict=True)
            ]
        return [marked[n] if n in marked else b"".join(ids) for n, ids in enumerate(held)]


class OpenBins:
    """At most ``most`` open bins, found by their free space in a bitset.

    A piece goes to the bin with the least space that holds it. If none does and all bins are
    taken, the fullest is closed for a new one.
    """

    def __init__(self, length: int, most: int):
        self.length, self.most, self.opened = length, most, 0
        self.spaces, self.count = 0, 0  # bit s is set if a bin with s free places is open
        self.bins: dict[int, list[int]] = {}

    def _take(self, space: int) -> int:
        held = self.bins[space]
        number = held.pop()
        if not held:
            del self.bins[space]
            self.spaces ^= 1 << space
        self.count -= 1
        return number

    def put(self, size: int) -> tuple[int, int]:
        """The bin of the piece and its place there."""
        fits = self.spaces >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.length, self.opened
            self.opened += 1
            if size < self.length and self.count == self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
        left = space - size
        if left:
            self.bins.setdefault(left, []).append(number)
            self.spaces |= 1 << left
            self.count += 1
        return number, self.length - space


SCHEMA = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary"
)


def _arrow_schema(with_ids: bool) -> pa.Schema:
    fields = [("doc_id", pa.int64()), ("piece", pa.int32())]
    fields += [(name, pa.int64()) for name in ("start", "length", "ids_crc32", "sequence_id", "offset")]
    return pa.schema(fields + [("ids", pa.binary())] * with_ids)


def _pack(
    batches: Iterator[pa.RecordBatch], path: str, length: int, most: int, with_ids: bool, special: bool
) -> Iterator[pa.RecordBatch]:
    encoder = kept_by_worker(("packing", path, special), lambda: ChunkEncoder(path, special=special))
    bins = OpenBins(length, most)
    task = TaskContext.get().partitionId() << 40
    end, schema, step = np.array([END_ID], "<u4").tobytes(), _arrow_schema(with_ids), 512
    for batch in batches:
        for low in range(0, batch.num_rows, step):
            part = batch.slice(low, step)
            rows = []
            encoded = encoder.encode([text or b"" for text in binary(part.column(1))])
            for doc_id, ids in zip(part.column(0).to_pylist(), encoded, strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    own = ids[at : at + 4 * length]
                    number, offset = bins.put(len(own) // 4)
                    row = (doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own), task + number, offset)
                    rows.append((*row, own) if with_ids else row)
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in zip(columns, schema, strict=True)], schema=schema
            )


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    length: int = LENGTH,
    open_bins: int = OPEN_BINS,
    with_ids: bool = True,
    special_tokens: bool = False,
) -> DataFrame:
    """Per piece: document, piece, start in it, length, CRC-32 of the ids, sequence, place there, ids.

    Only documents longer than ``length`` are cut. ``ids`` are little-endian unsigned 32-bit. A special token's string in a text is
    ordinary text, as the vocabularies' own notes have it and as the query and the pipeline take it: no page can write a mark into
    the sequences. ``special_tokens`` gives such strings their ids, as the library's plain call does.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = SCHEMA if with_ids else SCHEMA.removesuffix(", ids binary")
    return columns.mapInArrow(lambda batches: _pack(batches, path, length, open_bins, with_ids, special_tokens), schema)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
