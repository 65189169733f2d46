"""Listing trees of any shape, and names and entries that cannot be read."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from saltmarsh.sources import tree
from saltmarsh.sources.corpus import read_corpus, read_ignore_rules


def roots(spark, *paths):
    return spark.createDataFrame([(str(p),) for p in paths], "root string")


@pytest.mark.parametrize("most", [1, 3, 256])
def test_a_chain_of_folders_with_a_wide_end(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(tree, "FOLDERS_A_ROUND", most)
    end = tmp_path.joinpath("root", *[f"d{i}" for i in range(4 if most == 1 else 30)])
    wanted = set()
    for i in range(20):
        (end / f"w{i}").mkdir(parents=True)
        for name in (".env", "_x.py", f"f{i}.py"):
            (end / f"w{i}" / name).write_text(name)
            wanted.add(str((end / f"w{i}" / name).relative_to(tmp_path / "root")))
    (end / "node_modules").mkdir()
    (end / "node_modules" / "no.py").write_text("")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "one.py").write_text("1")
    listed = tree.list_files(roots(spark, tmp_path / "root", tmp_path / "other"), ["node_modules"])
    got = [(os.path.basename(r.root), r.path) for r in listed.collect()]
    assert len(got) == len(set(got)) and set(got) == {("root", p) for p in wanted} | {("other", "one.py")}


def test_odd_entries_do_not_stop_the_job(spark, tmp_path):
    root = os.fsencode(tmp_path) + b"/r"
    os.makedirs(root + b"/d\xff")
    for path, data in ((b"/ok.py", b"x = 1"), (b"/bad\xfe.py", b"y = \xff2"), (b"/d\xff/in.py", b"z = 3"), (b"/caf\xc3\xa9.py", b"w = 4")):
        with open(root + path, "wb") as f:
            f.write(data)
    os.symlink("loop", root + b"/loop")
    os.symlink("nowhere", root + b"/gone")
    os.symlink("ok.py", root + b"/link.py")
    os.symlink(".", root + b"/self")
    got = {r.path: r.text for r in read_corpus(spark, f"{tmp_path}/r", "s", "r").collect()}
    assert got == {"ok.py": "x = 1", "link.py": "x = 1", "bad�.py": "y = �2", "d�/in.py": "z = 3", "café.py": "w = 4"}
    unread = {r.path: r.reason for r in tree.unread_entries(roots(spark, tmp_path / "r"), []).collect()}
    assert set(unread) == {"loop", "gone"}


def test_what_cannot_be_opened_is_told(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.py").write_text("1")
    listed = tree.list_files(roots(spark, tmp_path / "r"), [])
    files = listed.unionByName(listed.selectExpr("root", "'gone.py' AS path", "CAST('gone.py' AS BINARY) AS raw", "size"))
    rows = {r.path: (r.text, r.reason) for r in tree.read_entries(files).collect()}
    assert rows["a.py"] == ("1", None) and rows["gone.py"][0] is None and "No such file" in rows["gone.py"][1]
    assert tree.list_files(roots(spark), []).count() == 0
    with pytest.raises(Exception, match="No such file"):
        tree.list_files(roots(spark, tmp_path / "absent"), []).count()


def test_lines_of_ignore_files_are_not_broadcast(spark, tmp_path):
    """The scans meet the files before these become lines, and neither side goes through the driver."""
    lines = "\n".join(f"rule-{n}|src/f{n}.py|{n + 1}" for n in range(200))
    files = spark.createDataFrame([("a/.ignored", lines), ("b/top/.ignored", "r|p.py|1"), ("b/top/low/.ignored", "wrong")], "path string, text string")
    tree.write_files(files, str(tmp_path))
    roots = spark.createDataFrame([(s, f"{tmp_path}/{f}") for s, f in (("1", "a"), ("2", "b"), ("3", "b"))], "scan_id string, root string")
    rules = read_ignore_rules(spark, roots, ".ignored")
    assert Counter(r.scan_id for r in rules.collect()) == {"1": 200, "2": 1, "3": 1}
    assert "Broadcast" not in rules._jdf.queryExecution().executedPlan().toString()


def test_a_wide_level_costs_one_round_and_its_files_several_tasks(spark, tmp_path, monkeypatch):
    rounds = []
    monkeypatch.setattr(tree, "FOLDERS_A_ROUND", 2)
    monkeypatch.setattr(tree, "durable", lambda df, cut=tree.durable: rounds.append(df) or cut(df))
    for i in range(60):
        (tmp_path / "r" / f"d{i}").mkdir(parents=True)
        (tmp_path / "r" / f"d{i}" / "a.py").write_text(str(i))
    listed = tree.list_files(roots(spark, tmp_path / "r"), [])
    read = tree.read_files(listed).select("path", "text", F.spark_partition_id().alias("task")).collect()
    assert {(r.path, r.text) for r in read} == {(f"d{i}/a.py", str(i)) for i in range(60)} and len(read) == 60
    # the root and one folder below it, then all the others
    assert len(rounds) == 2
    assert len({r.task for r in read}) > 1


def test_a_round_has_a_bounded_number_of_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "FOLDERS_A_ROUND", 1)
    monkeypatch.setattr(tree, "TASKS_A_ROUND", 3)
    for i in range(20):
        (tmp_path / "r" / f"d{i}" / "e").mkdir(parents=True)
        (tmp_path / "r" / f"d{i}" / "e" / "a.py").write_text("")
    listed = tree.list_files(roots(spark, tmp_path / "r"), []).collect()
    assert sorted(r.path for r in listed) == sorted(f"d{i}/e/a.py" for i in range(20))
