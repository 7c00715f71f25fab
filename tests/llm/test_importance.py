"""Importance resampling against a count by hand."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from leaksieve.llm import importance
from tests.llm.test_operators import LONG, TEXTS, empty, frame, made_texts

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text: str | None) -> list[str]:
    words = _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def by_hand(texts, target, percent=5, least=20):
    def bucket(feature: str) -> int:
        return zlib.crc32(feature.encode()) % 10_000

    s = Counter(bucket(f) for _, text in texts for f in features(text))
    t = Counter(bucket(f) for _, text in target for f in features(text))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in texts:
        mine = features(text)
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in map(bucket, mine)
        )
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(mine), weight, score, (len(mine) + 3) // 3 if len(mine) > 2 else len(mine) and 1))
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter((*r[:4], n) for n, r in enumerate(fit[: percent * len(fit) // 100], 1))
    left = Counter(r[:4] for r in out) - Counter(r[:4] for r in drawn.elements())
    return drawn + Counter({(*r, None): n for r, n in left.items()})


def ours(found) -> Counter:
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in found.collect())


@pytest.mark.parametrize(("head", "frequent"), [(32_768, 1_024), (10, 4), (1, 1), (0, 0)])
def test_same_whatever_the_head(spark, head, frequent):
    texts, target = made_texts(5, 120), made_texts(6, 20)
    found = importance.resample(frame(spark, texts), frame(spark, target), percent=20, head=head, frequent=frequent)
    assert ours(found) == by_hand(texts, target, percent=20)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(importance, "PART", 3_000)
    words = "x" * 100 + " Über ÉTÉ a1b2 　 q\x00r " * 30
    texts = [*TEXTS, (13, words), (14, words), (14, words), (15, "…—" * 3_000), (16, "z" * 20_000 + " end")]
    found = importance.resample(frame(spark, texts), frame(spark), percent=50)
    assert ours(found) == by_hand(texts, TEXTS, percent=50)


def test_empty_tables(spark):
    assert importance.resample(empty(spark), empty(spark)).collect() == []
    assert ours(importance.resample(frame(spark), empty(spark))) == by_hand(TEXTS, [])
    assert importance.resample(empty(spark), frame(spark)).collect() == []


def test_parts_keep_every_feature(monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choices(["a", "bb", "ccc", "—", "...", "dé", "e" * 50], k=2_000)).encode()
    bucketer = importance.Bucketer(importance.head_of([b"a", b"ccc"], 1), 10_000)

    def counted() -> Counter:
        return Counter(b for _, bucket in bucketer.of(list(importance._parts(text))) for b in bucket.tolist())

    whole = counted()
    monkeypatch.setattr(importance, "PART", 64)
    assert len(list(importance._parts(text))) > 50 and counted() == whole
    assert whole == Counter(zlib.crc32(f.encode()) % 10_000 for f in features(text.decode()))


def test_crc_of_a_run_follows_from_its_parts():
    shifts = importance._shifts(41)
    for a, b in ((b"word", b" x"), (b"", b" yz"), (LONG.encode(), b" " + b"q" * 40)):
        pushed = importance._push(shifts, np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))
        assert pushed[0] ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_places_are_those_of_one_sort(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 2, 3, None]), n) for n in range(3_000)]
    found = importance.ranked(
        spark.createDataFrame(rows, "score long, n long").repartition(7), 2_500, importance.F.desc_nulls_last("score"), importance.F.asc("n")
    )
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert {(r.score, r.n): r["rank"] for r in found.collect()} == {r: k if k <= 2_500 else None for k, r in enumerate(want, 1)}
