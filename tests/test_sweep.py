"""Sweeps that are killed, fail in cells and are resumed."""

import os

import pytest

from dialoom.operators import sweep

ROWS = "film string, seg_ord long, speaker string, start double, end double"
REPORT = "n long, sum double"


def rows(spark):
    return spark.createDataFrame([(f"c{i % 5}", i, "A", float(i), float(i + 1)) for i in range(40)], ROWS)


def counting(folder, kills=(), fails=()):
    """Work that leaves a file for each call; a killed cell takes its Python worker with it."""

    def work(parameters, clip):
        name = f"{clip.film.iloc[0]}-{int(parameters['x'])}"
        if name in kills:
            os._exit(1)
        with open(f"{folder}/{name}", "a") as f:
            f.write("x")
        if name in fails:
            raise ValueError(f"no {name}")
        return {"n": len(clip), "sum": float(clip.start.sum() * parameters["x"])}

    return work


def test_killed_half_way_and_resumed(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    trials, path = sweep.grid_trials({"x": [1.0, 2.0, 3.0, 4.0]}), f"file://{tmp_path}/results"
    with pytest.raises(Exception, match="crashed|exit"):
        sweep.run_sweep(rows(spark), "film", trials, counting(tmp_path / "calls", kills={"c0-3"}), REPORT, path, trials_per_wave=1)
    done = {f for f in os.listdir(tmp_path / "calls") if f[-1] in "12"}
    assert len(done) == 10
    with pytest.raises(FileExistsError):
        sweep.run_sweep(rows(spark), "film", trials, counting(tmp_path / "calls"), REPORT, path)
    for f in os.listdir(tmp_path / "calls"):
        if f not in done:
            os.remove(tmp_path / "calls" / f)  # computed, but not committed by the killed wave
    out = sweep.run_sweep(rows(spark), "film", trials, counting(tmp_path / "calls"), REPORT, path, resume=True, trials_per_wave=2)
    assert {(r.item, r.trial): r.status for r in out.collect()} == {(f"c{i}", t): "skipped" if t < 3 else "done" for i in range(5) for t in range(1, 5)}
    assert sorted(os.listdir(tmp_path / "calls")) == sorted(f"c{i}-{t}" for i in range(5) for t in range(1, 5))
    assert all((tmp_path / "calls" / f).read_text() == "x" for f in os.listdir(tmp_path / "calls"))
    assert {r.n for r in out.collect()} == {8}


def test_failed_cells_are_recorded_and_tried_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    trials, path = sweep.grid_trials({"x": [1.0, 2.0]}), f"file://{tmp_path}/results"
    out = sweep.run_sweep(rows(spark), "film", trials, counting(tmp_path / "calls", fails={"c1-2", "c3-1"}), REPORT, path).collect()
    assert {(r.item, r.trial): r.error for r in out if r.status == "failed"} == {("c1", 2): "ValueError: no c1-2", ("c3", 1): "ValueError: no c3-1"}
    assert sum(r.status == "done" for r in out) == 8
    again = sweep.run_sweep(rows(spark), "film", trials, counting(tmp_path / "calls", fails={"c3-1"}), REPORT, path, resume=True).collect()
    assert {(r.item, r.trial): (r.status, r.attempt) for r in again if r.status != "skipped"} == {("c1", 2): ("done", 2), ("c3", 1): ("failed", 2)}
    assert (tmp_path / "calls/c1-2").read_text() == "xx" and (tmp_path / "calls/c0-1").read_text() == "x"
    assert sweep.run_sweep(rows(spark).limit(0), "film", trials, counting(tmp_path), REPORT, f"file://{tmp_path}/none").collect() == []


def test_grid_order():
    assert sweep.grid_trials({"a": [1, 2], "b": [3, 4]}, {"c": 5}) == [{"c": 5, "a": a, "b": b} for a in (1, 2) for b in (3, 4)]
