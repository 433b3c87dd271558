"""A saved and reloaded model predicts as the fitted one, on groups with other features."""

import numpy as np
from pyspark.ml.feature import StandardScaler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from glossa.operators import lifecycle as LC


def test_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(g, f"f{k}", float(rng.random())) for g in range(60) for k in range(8) if rng.random() < 0.6]
    x = {}
    for g, f, v in rows:
        x.setdefault(g, {})[f] = v
    frame = [(g, float(g % 3), 2 * x.get(g, {}).get("f1", 0) - x.get(g, {}).get("f2", 0) + 0.5 * (g % 3)) for g in range(60)]
    feats = spark.createDataFrame(rows + [(99, "f1", 1.0), (99, "new", 5.0)], "group_id long, feat string, group_norm double")
    groups = spark.createDataFrame(frame, "group_id long, c double, y double")
    stages = lambda o: [StandardScaler(inputCol="features", outputCol="s", withMean=False, withStd=True),
                        LinearRegression(featuresCol="s", labelCol=o, regParam=0.0)]
    models, order = LC.fit(feats, groups, ["y"], stages, ["c"])
    LC.save(str(tmp_path / "m"), models, order, ["c"])
    back, order2, controls = LC.load(spark, str(tmp_path / "m"))
    assert controls == ["c"] and sorted(map(tuple, order2.collect())) == sorted(map(tuple, order.collect()))
    new = spark.createDataFrame([(99, 1.0), (100, None)], "group_id long, c double").unionByName(groups.select("group_id", "c"))
    a = {r["group_id"]: r["yhat"] for r in LC.predict(models, order, feats, new, ["c"]).collect()}
    b = {r["group_id"]: r["yhat"] for r in LC.predict(back, order2, feats, new, controls).collect()}
    assert a == b and len(a) == 62
    assert np.allclose([a[g] for g, _, _ in frame], [y for _, _, y in frame], atol=1e-6)
    assert np.isclose(a[99], 2.5, atol=1e-6) and np.isclose(a[100], 0.0, atol=1e-6)
