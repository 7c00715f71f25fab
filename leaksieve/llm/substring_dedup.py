"""Substring dedup: words of passages that an earlier document holds are removed.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window over it also starts in a
document with a smaller id; all windows are judged on the input.

Equal windows meet in one shard: each window has an anchor, the least hashed run of five words in it, and a document is cut into
fragments, runs of windows with the same anchor. Anchors are counted first, as hashes, and only fragments whose
anchor occurs again go to its shard. There
the fragments' texts are stored once each and indexed by an FM-index; every fragment is streamed against it by backward
search, which gives the interval of places where each window occurs, and the least document among them.
Words travel as text, so nothing rests on hashes but the routing.

Copies are folded where they are read: of equal fragments in one bucket of documents only the least document's
travels, the others are known to be covered. Anchors that hold a large share of a sample are
split by the hash of the whole window, so that a passage in a third of all rows has no shard of its own.

Null or empty texts, and those shorter than a window, lose nothing. Rows without an id are compared with
nothing. Rows with the same id never cover each other, whether their texts are equal or not.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.llm.common import binary, saved, table
from leaksieve.llm.fm_index import FMIndex

WINDOW = 13
ANCHOR = 5
#: Text bytes of the input per shard of the index, and per bucket of documents.
SHARD_BYTES = 8 << 20
BUCKET_BYTES = 6 << 20
#: Rows that are asked for anchors of an uncommon share, and the least share that is one.
SAMPLE_ROWS = 4000
HOT_SHARE = 1e-4
HOT_LEAST = 16
#: Ordinal in its bucket, id, words.
Row = tuple[int, int, list[bytes]]
_ODD = [np.uint64(x | 1) for x in np.random.default_rng(7).integers(1 << 62, 1 << 63, 64, dtype=np.int64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[60]
    x = (x ^ (x >> np.uint64(29))) * _ODD[61]
    return x ^ (x >> np.uint64(32))


def _runs(hashes: np.ndarray, length: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the ``length`` words from each place, or from those ``at``."""
    count = len(hashes) - length + 1
    total = np.zeros(count if at is None else len(at), np.uint64)
    for k in range(length):
        total += (hashes[k : k + count] if at is None else hashes[at + k]) * _ODD[k]
    return _mixed(total)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class _Group:
    """Fragments of some documents: first and last window, anchor, whether it was split as a hot one."""

    def __init__(self, documents: list[Row], hot: np.ndarray, hashed: _WordHash, window: int):
        words = [word for *_, own in documents for word in own]
        self.hashes = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
        self.counts = np.array([len(own) for *_, own in documents])
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.text, self.ends = b" ".join(words), np.cumsum(lengths) - 1
        self.starts = self.ends - lengths + 1
        doc_start = np.cumsum(self.counts) - self.counts
        anchors = _runs(self.hashes, ANCHOR)
        spread = window - ANCHOR + 1
        n = len(words) - window + 1
        best, place = anchors[:n].copy(), np.arange(n)
        for k in range(1, spread):
            other = anchors[k : k + n]
            less = other < best
            best[less] = other[less]
            place[less] = np.flatnonzero(less) + k
        # Windows that reach into the next document are none.
        doc_of = np.repeat(np.arange(len(documents)), self.counts)[:n]
        valid = np.arange(n) + window <= doc_start[doc_of] + self.counts[doc_of]
        split = np.isin(best, hot) if len(hot) else np.zeros(n, bool)
        new = np.ones(n, bool)
        new[1:] = (place[1:] != place[:-1]) | split[1:] | ~valid[:-1] | (doc_of[1:] != doc_of[:-1])
        new &= valid
        self.first = np.flatnonzero(new)
        stop = np.append(self.first[1:], n)
        # A run ends before the first place that is no window.
        gap = np.append(np.flatnonzero(~valid), n)
        self.last = np.minimum(stop, gap[np.searchsorted(gap, self.first)]) - 1
        self.key = best[self.first]
        own = split[self.first]
        self.key[own] = _runs(self.hashes, window, self.first[own])
        self.doc = doc_of[self.first]
        self.place = self.first - doc_start[self.doc]


def _rows(docs: pa.Table) -> tuple[list[int], list[tuple[int | None, bytes]]]:
    """The rows of a bucket in an order of their own: by id, then text, rows without an id last."""
    docs = docs.combine_chunks()
    rows = list(zip(docs["doc_id"].to_pylist(), binary(docs["text"].combine_chunks()), strict=True))
    rows = [(doc_id, text or b"") for doc_id, text in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))
    return order, [rows[k] for k in order]


def _documents(docs: pa.Table, window: int) -> list[Row]:
    """(ordinal, id, words) of the bucket's documents that have an id and a window, least ids first."""
    _, rows = _rows(docs)
    split = ((k, doc_id, text.split()) for k, (doc_id, text) in enumerate(rows) if doc_id is not None)
    return [row for row in split if len(row[2]) >= window]


def _pack(value: tuple) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, protocol=5))


def _unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _table(name: str, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({name: pa.array([k for k, _ in rows], pa.int32()), "blob": pa.array([b for _, b in rows], pa.binary())})


def _anchors(docs: pa.Table, shards: int, hot: np.ndarray, window: int) -> pa.Table:
    """(shard, blob): the distinct anchors of a bucket, for each shard, and whether they occur there more than once."""
    documents = _documents(docs, window)
    if not documents:
        return _table("shard", [])
    keys, counts = np.unique(_Group(documents, hot, _WordHash(), window).key, return_counts=True)
    shard = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable").astype(np.int32)
    numbers, heads = np.unique(shard[order], return_index=True)
    bucket, rows = docs["bucket"][0].as_py(), []
    for number, places in zip(numbers.tolist(), np.split(order, heads[1:]), strict=True):
        tags = (keys[places] >> np.uint64(32)).astype(np.uint32)
        more = np.packbits(counts[places] > 1)
        rows.append((number, _pack((bucket, places.tobytes(), tags.tobytes(), more.tobytes()))))
    return _table("shard", rows)


def _repeated(anchors: pa.Table) -> pa.Table:
    """(bucket, blob): which of a bucket's anchors occur anywhere else, or there more than once."""
    buckets, places, tags, more = [], [], [], []
    for blob in anchors["blob"]:
        bucket, place, tag, bits = _unpack(blob.as_py())
        buckets.append(bucket)
        places.append(np.frombuffer(place, np.int32))
        tags.append(np.frombuffer(tag, np.uint32))
        more.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(tags[-1])))
    _, of = np.unique(np.concatenate(tags), return_inverse=True)
    often = (np.bincount(of, 1 + np.concatenate(more)) > 1)[of]
    parts = np.split(often, np.cumsum([len(place) for place in places])[:-1])
    rows = zip(buckets, places, parts, strict=True)
    return _table("bucket", [(bucket, place[part].tobytes()) for bucket, place, part in rows if part.any()])


def _cut(docs: pa.Table, repeated: pa.Table, shards: int, hot: np.ndarray, window: int) -> pa.Table:
    """(shard, blob): a bucket's folded fragments at repeated anchors, for each shard, and what is known to be covered."""
    documents = _documents(docs, window) if len(docs) and len(repeated) else []
    if not documents:
        return _table("shard", [])
    group = _Group(documents, hot, _WordHash(), window)
    keys, of = np.unique(group.key, return_inverse=True)
    wanted = np.zeros(len(keys), bool)
    for blob in repeated["blob"]:
        wanted[np.frombuffer(blob.as_py(), np.int32)] = True
    taken = np.flatnonzero(wanted[of])
    first, last, key = group.first[taken], group.last[taken], group.key[taken]
    begin, end = group.starts[first].tolist(), group.ends[last + window - 1].tolist()
    shard = (key % np.uint64(shards)).astype(np.int64).tolist()
    tags = (key >> np.uint64(32)).astype(np.uint32).tolist()
    docs_of, places, windows = group.doc[taken].tolist(), group.place[taken].tolist(), (last - first + 1).tolist()
    ordinals, ids = [row[0] for row in documents], [row[1] for row in documents]
    known: dict[bytes, int] = {}
    # Per shard: texts, tags and least documents of its fragments; their places; spans covered by one of the bucket.
    out: dict[int, tuple] = defaultdict(lambda: ([], [], [], [], [], [], [], [], []))
    for a, b, s, tag, doc, place, n in zip(begin, end, shard, tags, docs_of, places, windows, strict=True):
        piece = group.text[a:b]
        texts, own_tags, least, of_piece, of_doc, at, settled, settled_at, settled_n = out[s]
        number = known.setdefault(piece, len(texts))  # equal fragments have equal anchors, so one shard
        if number == len(texts):
            texts.append(piece)
            own_tags.append(tag)
            least.append(ids[doc])
        if least[number] == ids[doc]:
            of_piece.append(number)
            of_doc.append(ordinals[doc])
            at.append(place)
        else:
            settled.append(ordinals[doc])
            settled_at.append(place)
            settled_n.append(n + window - 1)
    kinds = [np.uint32, np.int64, *[np.int32] * 6]
    bucket, rows = docs["bucket"][0].as_py(), []
    for s, (texts, *columns) in out.items():
        packed = [np.array(column, kind).tobytes() for column, kind in zip(columns, kinds, strict=True)]
        rows.append((s, _pack((bucket, b"\n".join(texts), *packed))))
    return _table("shard", rows)


def _least_documents(pieces: list[list[bytes]], owner: np.ndarray, window: int) -> np.ndarray:
    """For every window of the pieces, one after the other, the least owner of a piece that holds it."""
    codes: dict[bytes, int] = {}
    symbols: list[int] = []
    for words in pieces:
        symbols.extend(codes.setdefault(word, len(codes) + 1) for word in words)
        symbols.append(0)
    text = np.array(symbols, np.int64)
    sizes = np.array([len(words) for words in pieces])
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    n = sizes - window + 1
    of = np.repeat(np.arange(len(pieces)), n)
    starts = begin[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    index = FMIndex(text, window)
    step = 1 << 18
    found = [index.search(starts[at : at + step], window) for at in range(0, len(starts), step)]
    low, high = (np.concatenate(part) for part in list(zip(*found, strict=True))[1:])
    least = owner[of].copy()
    shared = high - low > 1
    if shared.any():
        piece_of = np.repeat(np.arange(len(pieces)), sizes + 1)
        owners = np.append(owner[piece_of[index.order]], 0)
        lows, back = np.unique(low[shared], return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[back] = high[shared]
        bounds = np.stack([lows, highs], axis=1).ravel()
        least[shared] = np.minimum.reduceat(owners, bounds)[::2][back]
    return least


def _search(shard: pa.Table, window: int) -> pa.Table:
    """(bucket, blob): covered spans of the fragments in one shard, as ordinals of documents, first and last words."""
    texts: list[bytes] = []
    kinds = [np.uint32, np.int64, *[np.int32] * 6]
    columns: list[list[np.ndarray]] = [[] for _ in kinds]
    homes, done_homes = [], []
    for blob in shard["blob"]:
        bucket, joined, *rest = _unpack(blob.as_py())
        found = [np.frombuffer(data, kind) for kind, data in zip(kinds, rest, strict=True)]
        found[2] = found[2].astype(np.int64) + len(texts)
        texts.extend(joined.split(b"\n"))
        homes.append(np.full(len(found[2]), bucket, np.int32))
        done_homes.append(np.full(len(found[5]), bucket, np.int32))
        for column, part in zip(columns, found, strict=True):
            column.append(part)
    tags, ids, of, of_doc, at, done, done_at, done_n = (np.concatenate(c) for c in columns)

    number: dict[bytes, int] = {}
    piece_of = np.array([number.setdefault(text, len(number)) for text in texts])
    del texts
    pieces = [text.split() for text in number]
    owner = np.full(len(pieces), np.iinfo(np.int64).max)
    np.minimum.at(owner, piece_of, ids)
    n = np.array([len(words) - window + 1 for words in pieces], np.int64)
    first = np.cumsum(n) - n
    least = np.repeat(owner, n)
    tag_of = np.unique(tags, return_inverse=True)[1]
    piece_tag = np.zeros(len(pieces), np.int64)
    piece_tag[piece_of] = tag_of
    several = np.flatnonzero(np.bincount(piece_tag)[piece_tag] > 1)
    if len(several):  # fragments that have their anchor to themselves share windows with their copies only
        asked = _least_documents([pieces[k] for k in several.tolist()], owner[several], window)
        step = np.arange(n[several].sum()) - np.repeat(np.cumsum(n[several]) - n[several], n[several])
        least[np.repeat(first[several], n[several]) + step] = asked

    piece = piece_of[of]
    each = np.repeat(np.arange(len(of)), n[piece])
    step = np.arange(n[piece].sum()) - np.repeat(np.cumsum(n[piece]) - n[piece], n[piece])
    covered = least[first[piece[each]] + step] < ids[of[each]]
    each, start = each[covered], (at[each] + step)[covered]
    new = np.ones(len(each), bool)
    new[1:] = (each[1:] != each[:-1]) | (start[1:] != start[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(each))[: len(heads)] - 1
    source = each[heads]
    home = np.concatenate([np.concatenate(homes)[source], *done_homes])
    spans = np.stack(
        [
            np.concatenate([of_doc[source], done]),
            np.concatenate([start[heads], done_at]),
            np.concatenate([start[tails] + window, done_at + done_n]),
        ],
        axis=1,
    ).astype(np.int32)
    order = np.argsort(home, kind="stable")
    buckets, heads = np.unique(home[order], return_index=True)
    parts = np.split(spans[order], heads[1:]) if len(heads) else []
    return _table("bucket", [(b, _pack((part.tobytes(),))) for b, part in zip(buckets.tolist(), parts, strict=True)])


def _remove(docs: pa.Table, spans: pa.Table) -> pa.Table:
    """The bucket's documents without their covered words."""
    order, rows = _rows(docs)
    found = [np.frombuffer(_unpack(blob.as_py())[0], np.int32).reshape(-1, 3) for blob in spans["blob"]]
    found = np.concatenate([np.empty((0, 3), np.int32), *found])
    found = found[np.argsort(found[:, 0], kind="stable")]
    bounds = np.searchsorted(found[:, 0], np.arange(len(rows) + 1)).tolist()
    ids, counts, removed, texts = [], [], [], []
    for k, (doc_id, text) in enumerate(rows):
        words = text.split()
        total = len(words)
        if bounds[k] < bounds[k + 1]:
            edge = np.zeros(total + 1, np.int64)
            np.add.at(edge, found[bounds[k] : bounds[k + 1], 1], 1)
            np.add.at(edge, found[bounds[k] : bounds[k + 1], 2], -1)
            words = [words[at] for at in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
        ids.append(doc_id)
        counts.append(total)
        removed.append(total - len(words))
        texts.append(b" ".join(words))
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "text": pa.array(texts, pa.binary()).cast(pa.string()),
        }
    )


def _anchor_counts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 500):
            documents = _documents(pa.Table.from_batches([batch.slice(low, 500)]), window)
            if documents:
                group = _Group(documents, np.empty(0, np.uint64), _WordHash(), window)
                keys, counts = np.unique(group.key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["anchor", "n"])


def hot_anchors(texts: DataFrame, rows: int, window: int) -> np.ndarray:
    """Anchors of an uncommon share in about SAMPLE_ROWS rows: at most 1 / HOT_SHARE of them.

    They decide where fragments go, never which are found.
    """
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows // SAMPLE_ROWS))) == 0)
    counts = sample.mapInArrow(lambda b: _anchor_counts(b, window), "anchor long, n long")
    counts = saved(counts.groupBy("anchor").agg(F.sum("n").alias("n")), "anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where((F.col("n") >= HOT_LEAST) & (F.col("n") >= total * HOT_SHARE)).collect()
    return np.array([row.anchor for row in hot], np.int64).view(np.uint64)


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """Per document: id, words before, words removed, and the kept words joined by one space.

    The texts are dealt out once, by hash, to buckets that all three readings share.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    shards, buckets = (max(1, -(-(size.bytes or 0) // part)) for part in (SHARD_BYTES, BUCKET_BYTES))
    hot = hot_anchors(texts, size.rows, window)
    texts = texts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))
    by_bucket, blobs = texts.groupBy("bucket"), "shard int, blob binary"
    anchors = by_bucket.applyInArrow(lambda own: _anchors(own, shards, hot, window), blobs)
    repeated = anchors.groupBy("shard").applyInArrow(_repeated, "bucket int, blob binary")
    fragments = by_bucket.cogroup(repeated.groupBy("bucket")).applyInArrow(
        lambda own, flags: _cut(own, flags, shards, hot, window), blobs
    )
    spans = fragments.groupBy("shard").applyInArrow(lambda own: _search(own, window), "bucket int, blob binary")
    return by_bucket.cogroup(spans.groupBy("bucket")).applyInArrow(
        _remove, "doc_id long, n_words long, n_removed long, text string"
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = dedup_substrings(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    return result.select("doc_id", "n_words", "n_removed", digest)


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(len(w) - 12)) AS p, w FROM words WHERE len(w) >= 13),
wins AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 13], ' ') AS s FROM starts),
least AS (SELECT s, min(doc_id) AS first FROM wins GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS at_word
  FROM wins JOIN least USING (s) WHERE first < doc_id),
dropped AS (SELECT doc_id, list(at_word) AS places FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN places IS NULL THEN w ELSE
    [w[k + 1] FOR k IN list_filter(range(len(w)), lambda k: NOT list_contains(places, k))] END, ' '), '')) AS kept_sha256
FROM words LEFT JOIN dropped USING (doc_id)
"""
