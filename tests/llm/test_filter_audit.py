"""The audit of filters against walks through every order by hand."""

from __future__ import annotations

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from leaksieve.llm import filter_audit
from tests.llm.test_operators import TEXTS, empty, made_texts

_SCHEMA = "doc_id long, text string, source string, cell int, part string, n int"
_LABELS = "doc_id long, quality int, toxic int, part string"


def fails(texts):
    out = []
    for doc_id, text in texts:
        data = (text or "").encode()
        words = data.split()
        capitals = sum(65 <= b <= 90 for b in data)
        same = [i for i, t in texts if i is not None and (t or "") == (text or "")]
        out.append(
            (
                len(words) < 200,
                100 * len(set(words)) < 50 * len(words),
                100 * capitals > 2 * len(text or ""),
                any(c in (text or "") for c in "#$%&*|"),
                doc_id is not None and min(same) < doc_id,
            )
        )
    return out


def by_hand(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    found = fails([(i, text) for i, text, _ in rows])
    out = set()
    for part in {s or "" for _, _, s in rows}:
        docs = [(i, f) for (i, _, s), f in zip(rows, found, strict=True) if (s or "") == part]
        counted, shapley = {}, dict.fromkeys(range(5), 0)
        for order in permutations(range(5)):
            left = list(docs)
            for step, k in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[k]]
                left = [(i, f) for i, f in left if not f[k]]
                shapley[k] += len(gone)
                counted[order, step] = (
                    len(left), len(gone), sum(f[k] for _, f in docs) - len(gone), sum(f[k] and sum(f) == 1 for _, f in docs),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                )
        for (order, step), numbers in counted.items():
            name = "".join("ABCDE"[k] for k in order)
            out.add((part, name, step, *numbers, shapley[order[step - 1]]))
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*row, 1, "x", 2) for row in rows], _SCHEMA).repartition(3)
    judged = spark.createDataFrame([(*row, "y") for row in labels], _LABELS)
    return filter_audit.audit(filter_audit.cells(docs, judged))


def test_every_order(spark):
    rows = [(i, t * (1 + i % 4) + ("| #" if i % 5 == 0 else ""), ("a", "b", "", None)[i % 4]) for i, t in made_texts(2, 80)]
    rows += [(100 + i, text, "hot") for i, (_, text, _) in enumerate(rows[:30])]
    rows += [(200, "ABC def " * 150, "hot"), (201, " ".join(f"w{n}" for n in range(300)), "hot")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 140, 2)]
    found = audited(spark, rows, [(i, q, int(t)) for i, q, t in labels]).collect()
    assert len(found) == 600 * 4
    assert {tuple(r) for r in found} == by_hand(rows, labels)


def test_odd_rows(spark):
    rows = [(i, t, "s") for i, t in TEXTS] + [(None, None, None), (None, "", ""), (7, TEXTS[3][1], "t")]
    labels = [(7, 1, 0), (7, 0, 1), (3, None, None), (None, 1, 1), (999, 1, 1)]
    assert {tuple(r) for r in audited(spark, rows, labels).collect()} == by_hand(rows, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], _LABELS)
    docs = empty(spark).withColumn("source", F.lit("s"))
    assert filter_audit.audit(filter_audit.cells(docs, none)).collect() == []
    assert {tuple(r) for r in audited(spark, [(1, "a", "s")], []).collect()} == by_hand([(1, "a", "s")], [])


def test_no_text_moves(spark):
    docs = spark.createDataFrame([(1, "a", "s", 1, "x", 2)], _SCHEMA)
    found = filter_audit.audit(filter_audit.cells(docs, spark.createDataFrame([(1, 1, 1, "y")], _LABELS)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("count", [1, 3])
def test_fewer_filters(spark, count):
    judged = spark.createDataFrame([("p", 0, 5, 1, 1), ("p", 1, 3, 0, 2)], "part string, cell int, n long, good long, toxic long")
    rows = filter_audit.audit(judged, "ABCDE"[:count]).where("step = 1 AND left(filter_order, 1) = 'A'").collect()
    assert {(r.kept, r.removed, r.unique_fails, r.good_lost, r.toxic_lost) for r in rows} == {(5, 3, 3, 0, 2)}
