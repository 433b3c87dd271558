"""What a run leaves on the driver and on disk between its steps."""

import glob
import time

import numpy as np

from glossa import session
from glossa.llm import toxicity
from glossa.llm.common import Scratch


def test_packed_rows_keep_their_columns_and_order():
    rows = [[], [0], [0, 1], [0, 300], [1], [255, 256], [256], [2047]]
    assert [toxicity.unpacked(toxicity.packed(r)).tolist() for r in rows] == rows
    assert sorted(map(toxicity.packed, rows)) == [toxicity.packed(r) for r in sorted(rows)]


def test_training_holds_rows_as_small_arrays(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("awful words here " if i % 2 else "quiet lines there ") + str(i % 7)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    seen = []
    plain = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, *a: (seen.extend(rows), plain(rows, *a))[1])
    model = toxicity.train(docs, labels)
    assert seen and all(isinstance(r, np.ndarray) and r.itemsize == 2 for r in seen)
    assert model.score(model.columns("awful words here", {})) > 0.5 > model.score(model.columns("quiet lines there", {}))


def test_shuffle_files_of_finished_steps_go(spark, monkeypatch):
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}
    monkeypatch.setitem(session._TIDIED, "at", time.monotonic() + 3600)      # not yet
    before, scratch = files(), Scratch(spark, "test")
    for i in range(3):
        scratch.keep(spark.range(1000).repartition(3 + i, "id"), f"t{i}")
    new = files() - before
    assert new
    monkeypatch.setitem(session._TIDIED, "at", 0.0)
    scratch.keep(spark.range(1), "last")
    end = time.monotonic() + 30
    while new & files() and time.monotonic() < end:
        time.sleep(0.2)
    assert not new & files()
    scratch.clear()
