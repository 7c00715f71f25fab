"""Trees listed and read in tasks."""

from __future__ import annotations

import os

import pytest

from leaksieve.sources import files, tree


@pytest.fixture(scope="module")
def wide_tree(tmp_path_factory):
    base = tmp_path_factory.mktemp("wide")
    for k in range(300):
        folder = base / f"_d{k % 7}" / f".e{k % 11}" / f"f{k}"
        folder.mkdir(parents=True)
        (folder / f"_n{k}.py").write_text(f"name {k}")
    (base / "venv").mkdir()
    (base / "venv" / "in.py").write_text("no")
    (base / "gone.py").symlink_to(base / "nowhere.py")
    (base / "loop").symlink_to(base)
    (base / "link.py").symlink_to(base / "_d0" / ".e0" / "f0" / "_n0.py")
    (base / "large.py").write_text("x" * 1_000)
    return base


@pytest.mark.parametrize("entries_per_task", [1, 25, 20_000])
def test_every_name_is_listed_once(spark, wide_tree, entries_per_task):
    listing = tree.list_tree(spark, str(wide_tree), suffixes=[".py"], excluded=["venv"], entries_per_task=entries_per_task)
    got = sorted((r.file, r.size) for r in listing.collect())
    want = [(f"_d{k % 7}/.e{k % 11}/f{k}/_n{k}.py", len(f"name {k}")) for k in range(300)]
    assert got == sorted([*want, ("gone.py", None), ("link.py", 6), ("large.py", 1_000)], key=lambda r: (r[0], r[1] or 0))


def test_what_cannot_be_read_is_a_row(spark, wide_tree):
    unread = files.unread_files(spark, str(wide_tree), max_bytes=999).collect()
    assert {(r.file, r.size, r.error) for r in unread} == {("gone.py", None, "FileNotFoundError"), ("large.py", 1_000, tree.TOO_LARGE)}
    read = files.scan_files(spark, str(wide_tree), max_bytes=999)
    assert read.count() == 301 and read.where("file = 'link.py'").first().text == "name 0"


def test_names_that_are_no_text(spark, tmp_path):
    with open(os.fsencode(str(tmp_path)) + b"/bad\xff.py", "w") as handle:
        handle.write("x")
    (row,) = files.unread_files(spark, str(tmp_path)).collect()
    assert row.error == "name is no UTF-8" and row.file.startswith("bad")


def test_roots(spark, wide_tree, tmp_path):
    single = wide_tree / "large.py"
    assert [r.file for r in tree.list_tree(spark, str(single), suffixes=[".txt"]).collect()] == ["."]
    assert [r.error for r in tree.list_tree(spark, str(tmp_path / "none")).collect()] == ["FileNotFoundError"]
    assert tree.list_tree(spark, str(wide_tree / "venv"), excluded=["venv"]).collect() == []
    assert tree.list_tree(spark, str(tmp_path)).collect() == []
    assert len(files.scan_files(spark, f"file://{wide_tree}").collect()) == 302


def test_other_file_systems(spark, wide_tree):
    def opener(path):
        from pyarrow.fs import LocalFileSystem

        return LocalFileSystem(), path

    plain = {r.file for r in files.scan_files(spark, str(wide_tree / "_d0")).collect()}
    assert {r.file for r in files.scan_files(spark, str(wide_tree / "_d0"), opener=opener).collect()} == plain and plain


def test_no_list_of_paths_on_the_driver(spark, wide_tree):
    listing = tree.list_tree(spark, str(wide_tree), suffixes=[".py"])
    plan = tree.read_listed(listing, str(wide_tree))._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "Scan ExistingRDD" not in plan
