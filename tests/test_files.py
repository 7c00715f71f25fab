from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leaksieve.operators.scan import scan
from leaksieve.plans.jobs import clean_up_run, scan_run, web_run, worst_first
from leaksieve.rules.catalogue import standard_rules
from leaksieve.sources import files, lists
from leaksieve.sources.findings import read_findings, write_findings
from leaksieve.sources.sizing import spread

TREE = {
    "x.env": b"a",
    "a.py": b"AB123CD77\xff",
    "B.PY": b"no",
    ".env": b"no",
    "build/a.py": "ключ \\u0041".encode(),
    "venv/a.py": b"no",
    "deep/.git/a.py": b"no",
    "deep/er/readme.md": b"x\r\ny",
    "notes.xyz": b"AB123CD77",
    "empty.py": b"",
    "_init.py": b"under",
    ".cfg.json": b"dot",
    ".hid/in.txt": b"inside",
    "big.log": b"0123456789" * 10,
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory) -> Path:
    base = tmp_path_factory.mktemp("tree") / "repo[1]"
    for name, content in TREE.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return base


def names(corpus):
    return sorted(r.file for r in corpus.collect())


def test_hidden_aware_scan_keeps_every_selected_file(spark, tree):
    corpus = files.scan_files(spark, str(tree), hidden=True)
    expected = [".cfg.json", ".hid/in.txt", "_init.py", "a.py", "big.log", "build/a.py", "deep/er/readme.md", "x.env"]
    assert names(corpus) == expected
    assert corpus.where("file = 'a.py'").first().text == "AB123CD77"
    assert names(files.scan_files(spark, str(tree), hidden=True, max_bytes=99)) == [n for n in expected if n != "big.log"]
    assert names(files.scan_files(spark, str(tree), hidden=True, max_bytes=100)) == expected


def test_reader_scan_passes_over_hidden_names(spark, tmp_path):
    for name, content in TREE.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    corpus = files.scan_files(spark, str(tmp_path), hidden=False)
    assert names(corpus) == ["a.py", "big.log", "build/a.py", "deep/er/readme.md", "x.env"]
    assert names(files.scan_files(spark, str(tmp_path), hidden=False, max_bytes=99)) == ["a.py", "build/a.py", "deep/er/readme.md", "x.env"]
    plan = files.scan_files(spark, str(tmp_path), hidden=False, max_bytes=1 << 20)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length" in plan
    decoded = files.scan_files(spark, str(tmp_path), hidden=False, decode_escapes=True)
    assert decoded.where("file = 'deep/er/readme.md'").first().text == "x\ny"
    assert decoded.where("file = 'build/a.py'").first().text.endswith(" A")
    assert names(files.scan_files(spark, str(tmp_path), hidden=False, suffixes=[".PY"])) == ["B.PY"]


def test_single_file_is_scanned_whatever_its_suffix(spark, tree, tmp_path):
    assert names(files.scan_files(spark, str(tree / "notes.xyz"), hidden=True)) == ["."]
    (tmp_path / "notes.xyz").write_bytes(b"AB123CD77")
    corpus = files.scan_files(spark, str(tmp_path / "notes.xyz"), hidden=False)
    assert [f.file for f in scan(corpus, standard_rules()).collect()] == ["."]


def test_path_filters(spark):
    paths = ["x.env", "a.py", "B.PY", ".env", "build/a.py", "venv/a.py", "c.tar.yml", "..env", "x.", "d/.py", "e.py/f"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    kept = rows.where(files.has_suffix(F.col("p")) & ~files.in_excluded_folder(F.col("p")))
    expected = [p for p in paths if Path(p).suffix in files.SUFFIXES and "venv" not in Path(p).parts]
    assert sorted(r.p for r in kept.collect()) == sorted(expected)
    sizes = spark.createDataFrame([(52_428_800,), (52_428_801,), (None,)], "n long")
    assert [r.n for r in sizes.where(files.within_size(F.col("n"), 52_428_800)).collect()] == [52_428_800]


def test_lists(spark, tmp_path):
    listed = tmp_path / "domains.txt"
    listed.write_text("a.com\n\n\tb.org  \n", encoding="utf-8")
    assert [r.entry for r in lists.read_list(spark, str(listed)).collect()] == ["a.com", "b.org"]
    assert lists.domains_in(spark, str(listed)) == ["a.com", "b.org"]
    assert lists.domains_in(spark, " a.com,, b.org ") == ["a.com", "b.org"]
    for source in (str(listed), "a.com,b.org"):
        with pytest.raises(ValueError):
            lists.domains_in(spark, source, most=1)


def test_findings_round_trip(spark, tmp_path):
    rows = [("T", "f", 1, "Й <é>", "high", None)]
    schema = "type string, file string, line int, snippet string, severity string, hash string"
    write_findings(spark.createDataFrame(rows, schema), str(tmp_path / "out"))
    read = read_findings(spark, str(tmp_path / "out"))
    assert [tuple(r) for r in read.select("type", "file", "line", "snippet", "severity", "hash").collect()] == rows
    assert any("Й <é>" in p.read_text("utf-8") for p in (tmp_path / "out").glob("*.json"))
    array = tmp_path / "array.json"
    array.write_text('[\n {"type": "T", "file": "f", "line": 1,\n "snippet": "s", "severity": "high"},'
                     ' {"type": "T", "file": "longer", "line": 2, "snippet": "S!", "severity": "high"}]')
    assert read_findings(spark, str(array), one_array=True).count() == 2
    clean_up_run(spark, str(array), str(tmp_path / "clean"), one_array=True)
    assert [r.file for r in read_findings(spark, str(tmp_path / "clean")).collect()] == ["f"]
    by_severity = tmp_path / "by"
    write_findings(spark.createDataFrame(rows, schema), str(by_severity), format="parquet", partition_by=["severity"])
    assert spark.read.parquet(str(by_severity)).where("severity = 'high'").count() == 1


def test_whole_runs(spark, tmp_path):
    texts = [("a.py", "AB123CD77"), ("dir/b.py", "ab123 AB123CD77 password=x"), ("c", "nothing")]
    corpus = spark.createDataFrame(texts, "file string, text string")
    run = scan_run(corpus, str(tmp_path / "one"), standard_rules(), domains=["x.org"])
    stats = run.stats.first().asDict()
    assert stats == {"files_processed": 3, "findings_raw": 3, "findings_clean": 2, "duplicates_removed": 1}
    assert [(r.severity, r.found) for r in worst_first(run.clean).collect()] == [("critical", 1), ("medium", 1)]
    search_run = scan_run(corpus, str(tmp_path / "two"), term="123")
    assert (search_run.raw.count(), search_run.clean.count()) == (3, 1)
    pages = spark.createDataFrame(
        [("http://s/1.html", '<a href="/2.html">'), ("http://s/2.html", "AB123CD77"), ("http://s/3.html", "AB124CD77")],
        "url string, html string",
    )
    seeds = spark.createDataFrame([("http://s/1.html",)], "url string")
    web = web_run(pages, seeds, str(tmp_path / "three"), standard_rules(), max_depth=3)
    assert [(r.file, r.snippet) for r in web.clean.where("type = 'Car Plate Number'").collect()] == [("http://s/2.html", "AB123CD77")]


def test_only_small_inputs_are_dealt_out(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    small = spark.createDataFrame([("x",)], "t string")
    assert spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1b")
        large = spread(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
        assert "Exchange" not in large._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
