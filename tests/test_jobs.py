"""The jobs: two runs over growing input, reruns, nulls and the command line."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import fold_audit, score_ledger
from jobs.common import config_of

ROOT = Path(__file__).resolve().parents[1]
LEDGER = config_of("score_ledger") | {"files_per_batch": 1}


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def cut(spark, folder, parts):
    """Copies of the events in files that come one after another."""
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    files = []
    for k in range(parts):
        e.filter(f"event_id % {parts} = {k}").coalesce(1).write.parquet(f"{folder}/made-{k}")
        files.append(next(Path(f"{folder}/made-{k}").glob("part-*.parquet")))
    return files


def test_ledger_takes_only_what_is_new(spark, tmp_path):
    files = cut(spark, tmp_path, 3)
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k in (0, 1):
        shutil.copy(files[k], source / f"{k}.parquet")
    first = rows(score_ledger.run(spark, str(source), target, LEDGER))
    ledger = lambda: {r.batch: r.n for r in spark.read.parquet(f"{target}/ledger").selectExpr("batch", "_p + _n AS m").groupBy("batch").agg({"m": "sum"}).withColumnRenamed("sum(m)", "n").collect()}
    held = ledger()
    assert set(held) == {0, 1}
    stamp = {p: p.stat().st_mtime_ns for p in Path(f"{target}/ledger").rglob("*.parquet")}
    assert rows(score_ledger.run(spark, str(source), target, LEDGER)) == first and ledger() == held  # nothing new
    shutil.copy(files[2], source / "2.parquet")
    second = rows(score_ledger.run(spark, str(source), target, LEDGER))
    assert set(ledger()) == {0, 1, 2} and second != first
    assert all(p.stat().st_mtime_ns == t for p, t in stamp.items())  # earlier batches aren't written again
    every = rows(score_ledger.run(spark, "/root/testdata/sf0.001/events.parquet", str(tmp_path / "whole"), LEDGER))
    assert second == every


def test_ledger_after_a_run_that_broke_off(spark, tmp_path):
    """The board is caught up by the next run although that finds nothing new."""
    files = cut(spark, tmp_path, 2)
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    shutil.copy(files[0], source / "0.parquet")
    score_ledger.run(spark, str(source), target, LEDGER)
    shutil.copy(files[1], source / "1.parquet")
    board = score_ledger.write_parts
    with pytest.MonkeyPatch.context() as m:
        m.setattr(score_ledger, "write_parts", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            score_ledger.run(spark, str(source), target, LEDGER)
    assert score_ledger.write_parts is board
    got = rows(score_ledger.run(spark, str(source), target, LEDGER))
    assert got == rows(score_ledger.run(spark, "/root/testdata/sf0.001/events.parquet", str(tmp_path / "whole"), LEDGER))


def test_ledger_of_nulls_and_of_nothing(spark, tmp_path):
    kind = "part string, c string, u string, s double, y boolean"
    data = [("d", "k", "a", 0.5, True), ("d", "k", "b", 0.5, False), ("d", "k", None, None, True), ("d", "k", "a", float("nan"), False), (None, None, "a", 1.0, True), ("d", "k", "a", 0.1, None)]
    config = {"part": "part", "class": "c", "cluster": "u", "score": "s", "truth": "y"}
    spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/some")
    got = {(r["part"], r["class_id"]): r for r in score_ledger.run(spark, f"{tmp_path}/some", f"{tmp_path}/a", config).collect()}
    assert set(got) == {("d", "k"), ("all", "k"), ("none", "none"), ("all", "none")}
    d = got["d", "k"]
    assert (d.auc, d.pos, d.neg, d.rows, d.missing, d.clusters, d.lead) == (0.5, 1, 1, 4, 2, 2, 1.0)
    assert got["none", "none"].auc is None and got["none", "none"].lead == 1.0
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none")
    assert score_ledger.run(spark, f"{tmp_path}/none", f"{tmp_path}/b", config).count() == 0


DOCS = "doc_id bigint, text string, lang string, source string"


def folds(spark, folder, docs, marks, **config):
    spark.createDataFrame(docs, DOCS).write.mode("overwrite").parquet(f"{folder}/docs")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/marks")
    return fold_audit.run(spark, f"{folder}/docs", f"{folder}/marks", f"{folder}/out", config_of("fold_audit") | config)


def test_folds_leak_nothing(spark, tmp_path):
    docs = [(i, f"Text  {i % 17}\n" if i % 3 else f"text {i % 17}", "en", f"s{i % 11}") for i in range(200)]
    docs += [(None, None, None, None), (500, "", "en", None), (501, "alone", "en", None), (501, "ALONE ", "en", None)]
    got = folds(spark, tmp_path, docs, [(3, 1, 0), (3, 0, 1), (None, 1, 1)]).collect()
    assert len(got) == len(docs)
    of_group, of_text = {}, {}
    for r in got:
        of_group.setdefault(r.grp, set()).add(r.fold)
        if r.text_key:
            of_text.setdefault(r.text_key, []).append(r.fold)
    assert all(len(f) == 1 for f in of_group.values()) and {f for s in of_group.values() for f in s} == set(range(5))
    for r in got:
        held = set(of_text.get(r.text_key, [r.fold]))
        assert set(r.leaks) == held - {r.fold} and set(r.train_for) == set(range(5)) - held - {r.fold}
        assert r.copies == len(of_text.get(r.text_key, []))
    assert [(r.quality, r.toxic) for r in got if r.doc_id == 3] == [(1, 1)]
    assert len({r.grp for r in got if r.doc_id == 501}) == 1


def test_folds_again_and_with_a_hot_text(spark, tmp_path):
    docs = [(i, "the same" if i % 3 == 0 else f"t{i}", "en", f"s{i % 50}") for i in range(3000)]
    first = rows(folds(spark, tmp_path, docs, []))
    assert rows(folds(spark, tmp_path, docs[::-1], [])) == first  # same rows, read in another order, over the same target
    with pytest.raises(ValueError, match="folds"):
        folds(spark, tmp_path, docs[:1], [], folds=1)


def test_command_line(spark, tmp_path):
    config = tmp_path / "own.json"
    config.write_text(json.dumps(config_of("fold_audit") | {"folds": 3}))
    d = "/root/testdata/sf0.001"
    call = [sys.executable, "-m", "jobs.fold_audit", "--documents", f"{d}/documents.parquet", "--labels", f"{d}/labels.parquet", "--target", str(tmp_path / "out"), "--config", str(config)]
    done = subprocess.run(call, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote fold 2 of" in done.stderr
    out = spark.read.parquet(f"{tmp_path}/out/folds")
    assert out.count() == spark.read.parquet(f"{d}/documents.parquet").count() and {r.fold for r in out.select("fold").distinct().collect()} == {0, 1, 2}
