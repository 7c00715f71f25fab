"""The pipeline against the same stages in plain Python."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from checks.compare import views
from leaksieve.llm import language_id
from tests.conftest import SF
from tests.llm.test_operators import print_by_hand


def contaminated_by_hand(text: str, items: list[list[str]], width: int = 5) -> bool:
    words = language_id.regex.findall(r"[\p{L}\p{N}]+", text.lower())

    def bag(run):
        out = defaultdict(int)
        for k in range(len(run) - width + 1):
            out[tuple(run[k : k + width])] += 1
        return out

    grams = set(bag(words))
    for item in items:
        mine = bag(item)
        if not grams & set(mine):
            continue
        for start in range(max(1, len(words) - len(item) + 1)):
            own = bag(words[start : start + len(item)])
            both = sum(min(n, own.get(k, 0)) for k, n in mine.items())
            if both and both / (sum(mine.values()) + sum(own.values()) - both) >= 0.8:
                return True
    return False


def test_pipeline(spark):
    con = views(SF)
    docs = [(i, t) for i, t in con.sql("SELECT doc_id, text FROM documents").fetchall() if t and language_id._LETTER.search(t)]
    last = {}
    for doc_id, text in docs:
        last[text] = max(doc_id, last.get(text, doc_id))
    docs = [(i, t) for i, t in docs if last[t] == i]
    prints = {i: print_by_hand(t) for i, t in docs}
    root = {p: p for p in prints.values()}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in list(root):
        for b in list(root):
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, p in prints.items():
        least[find(p)] = min(i, least.get(find(p), i))
    items = [
        language_id.regex.findall(r"[\p{L}\p{N}]+", t.lower()) for (t,) in con.sql("SELECT text FROM benchmark").fetchall()
    ]
    want = {i for i, t in docs if least[find(prints[i])] == i and not contaminated_by_hand(t, items)}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == want and len(want) > 100
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "simhash_dedup", "decontamination", "packing",
    ]


def test_stages_take_empty_and_odd_tables(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "Some words of a text here.", "en", "s", 3)],
        spark.read.parquet(f"{SF}/documents.parquet").schema,
    )
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            assert 2 in {r.doc_id for r in out.collect()}
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_stages_decide_by_row(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = "Plain words of a text that stands here for itself, number {} of a few."
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").first().text

    def kept(stage, *rows):
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema).repartition(3)
        return sorted(((r.doc_id, r.text) for r in stage(spark, docs, SF).collect()), key=str)

    stages = dict(corpus_pipeline.STAGES)
    a, b = text.format("one"), " ".join(f"other{n}" for n in range(40))
    # One id, two texts: 5 loses against 9 for one of them only. Copies without an id, and rows repeated whole, leave one.
    assert kept(stages["exact_dedup"], (5, a), (9, a), (5, b)) == [(5, b), (9, a)]
    assert kept(stages["exact_dedup"], (None, a), (None, a), (3, b), (3, b), (None, b)) == [(3, b), (None, a)]
    assert kept(stages["simhash_dedup"], (5, a), (2, a), (5, b), (None, a)) == [(2, a), (5, b)]
    assert kept(stages["simhash_dedup"], (None, a), (None, a)) == [(None, a)]
    assert kept(stages["decontamination"], (5, benchmark), (5, a), (None, benchmark), (None, b)) == [(5, a), (None, b)]
    assert kept(stages["language_id"], (5, a), (5, "..."), (None, "123"), (None, a), (6, None)) == [(5, a), (None, a)]
