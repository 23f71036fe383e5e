"""The tree data source: equal to the walk, pruned by rules and pushed filters, streamed."""

import os

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from filelake.schemas import LISTING
from filelake.sources import tree
from filelake.sources.listing import walk
from filelake.sources.tree import Walker, read_tree, stream_tree

NAMES = LISTING.names


@pytest.fixture(scope="module")
def wide_tree(tmp_path_factory):
    """10,000 folders, with hidden names, links and folders that rules leave out."""
    root = tmp_path_factory.mktemp("wide")
    for a in range(100):
        for b in range(99):
            folder = root / f"d{a:02d}" / ("node_modules" if b == 7 else f".h{b}" if b == 8 else f"e{b:02d}")
            folder.mkdir(parents=True)
            if b % 9 == 0:
                (folder / f"f{b}.txt").write_text("x" * (a + b))
    (root / "top file").write_text("t")
    (root / "link").symlink_to(root / "d00")
    return str(root)


def rows(df):
    return sorted(map(tuple, df.select(*NAMES).collect()))


def test_equal_to_the_walk(spark, wide_tree):
    rules = ["node_modules", "d1?", f"{wide_tree}/d05/e09", "*/d06/.h*"]
    files, errors = walk(spark, [wide_tree, "/no/such/root"], rules)
    found = read_tree(spark, [wide_tree, "/no/such/root"], rules).persist()
    assert rows(found.where("error is null")) == rows(files) and len(rows(files)) > 800
    assert [(r.path, r.error) for r in found.where("error is not null").collect()] == [tuple(r) for r in errors.collect()]
    found.unpersist()


def test_filters_prune_folders(spark, wide_tree):
    found = read_tree(spark, [wide_tree]).where("error is null")
    every = found.persist()
    for sql in (
        f"path like '{wide_tree}/d03/%'", f"path not like '{wide_tree}/d0%'", f"parent = '{wide_tree}/d04/e09'", "path not like '%/node_modules/%'",
        f"parent in ('{wide_tree}/d04/e09', '{wide_tree}')", "size_bytes > 120 and ext = '.txt'", "mtime >= 1.5 and filename like 'f9%'",
        "filename like '%.txt' and size_bytes <= 20", f"not (parent like '{wide_tree}/d%')", "ext in ('', '.x') or size_bytes = 7",
    ):
        fresh = read_tree(spark, [wide_tree]).where("error is null").where(sql)
        assert rows(fresh) == rows(every.where(sql)), sql
    every.unpersist()


def test_pruned_folders_are_not_opened(wide_tree, monkeypatch):
    opened = []
    scan = os.scandir
    monkeypatch.setattr(os, "scandir", lambda folder: opened.append(folder) or scan(folder))
    walker = Walker({"roots": f'["{wide_tree}"]', "exclude": '["d9?"]', "units": "4"})
    walker.conditions = [tree.condition(tree.ds.StringStartsWith(("path",), f"{wide_tree}/d9")), tree.condition(tree.ds.EqualTo(("parent",), f"{wide_tree}/d12/e09"))]
    assert sum(b.num_rows for w in walker.plan() for b in walker.read(w)) == 0 and set(opened) == {wide_tree}
    opened.clear()
    walker.conditions = walker.conditions[1:]
    assert sum(b.num_rows for w in walker.plan() for b in walker.read(w)) == 1
    assert set(opened) == {wide_tree, f"{wide_tree}/d12", f"{wide_tree}/d12/e09"}


def test_work_is_dealt_out(wide_tree):
    works = Walker({"roots": f'["{wide_tree}"]', "units": "64"}).plan()
    sizes = [len(w.units) for w in works]
    assert len(works) == 64 and max(sizes) - min(sizes) <= 1


def test_filters_reach_the_source(spark, wide_tree):
    plan = plan_of(read_tree(spark, [wide_tree]).where(F.col("path").startswith(f"{wide_tree}/d03/")).select("path"))
    assert "Filter (" not in plan.replace("StartsWith", "")  # the source does all of it


def test_odd_entries_are_reported(spark, tmp_path):
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "a.b.c").write_text("1")
    with open(os.fsencode(str(tmp_path / "ok")) + b"/bad\xff.txt", "w") as f:
        f.write("x")
    got = read_tree(spark, [str(tmp_path)]).collect()
    assert {(r.filename, r.ext, r.error) for r in got} == {("a.b.c", ".c", None), (None, None, "the name is not UTF-8")}
    assert read_tree(spark, []).collect() == []


def test_stream_of_new_and_changed_files(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    (root / ".hidden").mkdir(parents=True)
    (root / ".hidden" / "_a.txt").write_text("a")

    def run():
        stream = stream_tree(spark, [str(root)])
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        return {r.filename for r in spark.read.parquet(out).collect()}

    assert run() == {"_a.txt"}
    (root / "late.txt").write_text("late")
    # Moved in with an old time: its change time is new.
    (tmp_path / "old.txt").write_text("old")
    os.utime(tmp_path / "old.txt", (1e9, 1e9))
    (tmp_path / "old.txt").rename(root / "old.txt")
    assert run() == {"_a.txt", "late.txt", "old.txt"}
