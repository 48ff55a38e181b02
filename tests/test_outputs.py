"""Sinks: whole files or none, whatever happens to tasks, jobs and the driver."""

from __future__ import annotations

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from albumflow.sources import outputs
from albumflow.sources.files import copy_files


def tree(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), encoding="utf-8").read() for d, _, names in os.walk(root) for n in names if ".staging" not in d}


def lines(spark, rows):
    return spark.createDataFrame(rows, "output string, place int, line string").repartition(3)


@pytest.fixture
def rows(spark):
    few = [("a/x.txt", 2, "two"), ("a/x.txt", 1, "one"), ("b.txt", 1, "é"), ("b.txt", 2, None), (None, 1, "no"), ("b.txt", 3, "")]
    return lines(spark, [*few, *(("large.txt", i, f"line {i}") for i in range(3000))])


LARGE = "".join(f"line {i}\n" for i in range(3000))


def test_writes_in_order_and_in_pieces(rows, tmp_path):
    root = str(tmp_path / "out")
    report = {r.output: r for r in outputs.write_outputs(rows, root).collect()}
    assert tree(root) == {"a/x.txt": "one\ntwo\n", "b.txt": "é\n\n", "large.txt": LARGE}
    assert {r.action for r in report.values()} == {"written"} and report["large.txt"].pieces > 1 and report["large.txt"].bytes == len(LARGE)
    assert not any(n.endswith(".part") for n in os.listdir(root))


def test_modes(spark, rows, tmp_path):
    root = str(tmp_path / "out")
    outputs.write_outputs(rows, root)
    more = lines(spark, [("b.txt", 1, "new"), ("c.txt", 1, "c"), *(("large.txt", i, str(i)) for i in range(500))])
    added = "".join(f"{i}\n" for i in range(500))
    assert {r.output: r.action for r in outputs.write_outputs(more, root, "new").collect()} == {"b.txt": "skipped", "c.txt": "written", "large.txt": "skipped"}
    assert tree(root)["b.txt"] == "é\n\n"
    assert {r.output: r.action for r in outputs.write_outputs(more, root, "append").collect()} == {"b.txt": "appended", "c.txt": "appended", "large.txt": "appended"}
    assert tree(root) == {"a/x.txt": "one\ntwo\n", "b.txt": "é\n\nnew\n", "c.txt": "c\nc\n", "large.txt": LARGE + added}
    assert {r.action for r in outputs.write_outputs(more, root, "overwrite").collect()} == {"replaced"}
    assert tree(root) == {"a/x.txt": "one\ntwo\n", "b.txt": "new\n", "c.txt": "c\n", "large.txt": added}


@pytest.mark.parametrize("mode", ["new", "overwrite", "append"])
def test_a_run_counts_once(spark, rows, tmp_path, mode):
    root = str(tmp_path / "out")
    outputs.write_outputs(lines(spark, [("b.txt", 1, "old")]), root)
    first = sorted(outputs.write_outputs(rows, root, mode, run="r1").collect())
    after = tree(root)
    assert sorted(outputs.write_outputs(rows, root, mode, run="r1").collect()) == first and tree(root) == after


def staged(rows):
    return rows.where("output is not null").repartitionByRange(4, "output", "place").sortWithinPartitions("output", "place").select("output", "line")


@pytest.mark.parametrize("mode", ["overwrite", "append"])
def test_publishing_again_after_a_crash(spark, rows, tmp_path, mode):
    """The driver is lost while outputs are being renamed: publishing once more gives the same files."""
    root = str(tmp_path / "out")
    outputs.write_outputs(lines(spark, [("b.txt", 1, "old"), ("large.txt", 1, "old")]), root)
    run = outputs._stage(staged(rows), root, mode, "lines", "r1")
    shutil.copytree(f"{root}/.staging/r1", tmp_path / "before")
    outputs.publish(spark, root, run, mode)
    want = tree(root)
    assert want["large.txt"] == ("old\n" if mode == "append" else "") + LARGE
    os.rename(f"{root}/.staging/r1", tmp_path / "after")
    shutil.copytree(tmp_path / "before", f"{root}/.staging/r1")
    outputs.publish(spark, root, run, mode)
    assert tree(root) == want


def test_a_rename_that_was_done_already(tmp_path):
    piece, target = tmp_path / "piece", tmp_path / "target"
    piece.write_text("abc")
    row = {"error": None, "piece": str(piece), "size": 3, "base": -1, "pieces": 1}
    assert [outputs._report(str(target), row, "r", False) for _ in range(2)] == [("written", 3, None)] * 2
    target.write_text("other than this run's")
    with pytest.raises(FileNotFoundError):
        outputs._report(str(target), row, "r", False)


def test_a_failed_job_leaves_nothing(spark, rows, tmp_path):
    root = str(tmp_path / "out")
    outputs.write_outputs(lines(spark, [("b.txt", 1, "old")]), root)
    bad = staged(rows).withColumn("line", F.when(F.col("line") == "line 2999", F.raise_error(F.lit("stop"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="stop"):
        outputs._stage(bad, root, "overwrite", "lines", "r2")
    assert tree(root) == {"b.txt": "old\n"} and not os.path.exists(os.path.join(root, ".staging", "r2"))
    outputs.write_outputs(rows, root, "overwrite", run="r2")
    assert tree(root)["large.txt"] == LARGE


def test_attempts_that_do_not_count(spark, tmp_path):
    """Folders of killed attempts are no part of what is published."""
    root = str(tmp_path / "out")
    stray = tmp_path / "out" / ".staging" / "r3" / "000000-9-dead"
    stray.mkdir(parents=True)
    (stray / "00000001").write_text("half a li")
    (stray / "manifest.json").write_text('{"output": "z.txt", "part": 0, "place": 0, "piece": "%s", "size": 9, "base": -1, "error": null}\n' % (stray / "00000001"))
    outputs.write_outputs(lines(spark, [("y.txt", 1, "y")]), root, run="r3")
    assert tree(root) == {"y.txt": "y\n"}


def test_outputs_stay_inside(spark, tmp_path):
    root = str(tmp_path / "out")
    got = {r.output: (r.action, bool(r.error)) for r in outputs.write_outputs(lines(spark, [("../evil", 1, "x"), ("/etc/evil", 1, "x"), ("ok", 1, "x"), (".", 1, "x")]), root).collect()}
    assert got == {"../evil": ("failed", True), "/etc/evil": ("failed", True), "ok": ("written", False), ".": ("failed", True)} and tree(root) == {"ok": "x\n"}
    assert os.listdir(tmp_path) == ["out"]


def test_empty(spark, tmp_path):
    assert outputs.write_outputs(lines(spark, [("x", 1, "x")]).where("place > 1"), str(tmp_path / "o")).count() == 0


def test_files(spark, tmp_path):
    root, source = str(tmp_path / "out"), tmp_path / "in"
    source.mkdir()
    rows = []
    for i in range(40):
        (source / f"f{i}").write_text(f"content {i}" * i)
        rows.append((str(source / f"f{i}"), f"{root}/d{i % 3}/f{i}", "copied"))
    rows += [(str(source / "none"), f"{root}/none", "copied"), (str(source / "f1"), f"{root}/over", "overwritten")]
    manifest = spark.createDataFrame(rows, "source_path string, target_path string, status string").repartition(4)
    report = {r.output: (r.action, r.error) for r in outputs.place_files(manifest, root, run="c1").collect()}
    assert report.pop("none")[0] == "failed" and set(report.values()) == {("written", None)} and len(report) == 40
    assert tree(root) == {f"d{i % 3}/f{i}": f"content {i}" * i for i in range(40)}
    assert {r.action for r in outputs.place_files(manifest, root, "new").collect()} == {"skipped", "failed"}
    assert {r.action for r in outputs.place_files(manifest, root, run="c1").collect()} == {"written", "failed"}


def test_throughput(spark, tmp_path):
    """Both ways of copying, in MB a second (printed with -s)."""
    source = tmp_path / "in"
    source.mkdir()
    size = 4 << 20
    for i in range(24):
        (source / f"f{i}").write_bytes(os.urandom(size))
    rows = [(str(source / f"f{i}"), f"{tmp_path}/%s/f{i}", "copied") for i in range(24)]
    for name, copy in (("copy", lambda m, root: copy_files(m)), ("place", lambda m, root: outputs.place_files(m, root))):
        manifest = spark.createDataFrame([(s, t % name, k) for s, t, k in rows], "source_path string, target_path string, status string").repartition(4)
        began = time.perf_counter()
        assert copy(manifest, f"{tmp_path}/{name}").count() == 24
        print(f"{name}: {24 * size / 1e6 / (time.perf_counter() - began):.0f} MB/s")
