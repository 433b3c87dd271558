"""Fitted models that outlive a session: save, load, predict on new groups.

A model folder holds the pyspark.ml pipeline of each outcome (scaler, selector,
estimator) and the feature and control order it was fitted with.  A new
group is aligned to that order: features and controls of the training that it
lacks are 0, those it has beyond are left out.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators.ml import fit_together
from glossa.operators.ranks import global_rank, scratch_path


def feature_order(feats: DataFrame) -> DataFrame:
    """(feat, idx) by feature name."""
    return global_rank(feats.select("feat").distinct(), [F.col("feat")], "idx").select("feat", (F.col("idx") - 1).cast("int").alias("idx"))


def vectors(feats: DataFrame, order: DataFrame, groups: DataFrame, controls=(), value_col: str = "group_norm") -> DataFrame:
    """``groups`` with ``features``: a sparse vector over the order, controls last.  The table is written once, with
    vectors in their stored form (type, size, indices, values) made by the aggregate, and read back as vectors,
    so no row passes through Python."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType
    p, controls = order.count(), list(controls)
    pairs = F.sort_array(F.collect_list(F.struct("idx", F.col(value_col).cast("double").alias("v"))))
    per = feats.join(order, "feat").groupBy("group_id").agg(pairs.alias("_p"))
    none = F.array().cast("array<struct<idx:int,v:double>>")
    extra = F.array(*[F.struct(F.lit(p + i).alias("idx"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("v"))
                      for i, c in enumerate(controls)]) if controls else none
    d = groups.join(per, "group_id", "left").withColumn("_p", F.concat(F.coalesce("_p", none), extra))
    stored = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(p + len(controls)).alias("size"),
                      F.col("_p.idx").alias("indices"), F.col("_p.v").alias("values"))
    path = scratch_path(feats.sparkSession, "vectors")
    d.withColumn("features", stored).drop("_p").write.parquet(path)
    return feats.sparkSession.read.schema(StructType([*groups.schema.fields, StructField("features", VectorUDT())])).parquet(path)


def fit(feats: DataFrame, groups: DataFrame, outcomes, stages, controls=(), value_col: str = "group_norm"):
    """(models by outcome, order).  ``stages(outcome)`` gives the pipeline's stages."""
    order = feature_order(feats.join(groups.select("group_id"), "group_id", "left_semi"))
    data = vectors(feats, order, groups, controls, value_col)
    return {o: fit_together(Pipeline(stages=stages(o)), [data.where(F.col(o).isNotNull())])[0] for o in outcomes}, order


def predict(models: dict, order: DataFrame, feats: DataFrame, groups: DataFrame, controls=(),
            value_col: str = "group_norm") -> DataFrame:
    """(group_id, outcome, yhat) for every group and outcome."""
    data = vectors(feats, order, groups, controls, value_col)
    out = None
    for o, m in models.items():
        one = m.transform(data).select("group_id", F.lit(o).alias("outcome"), F.col("prediction").alias("yhat"))
        out = one if out is None else out.unionByName(one)
    return out


def save(path: str, models: dict, order: DataFrame, controls=()) -> None:
    for o, m in models.items():
        m.write().overwrite().save(f"{path}/model_{o}")
    order.write.mode("overwrite").parquet(f"{path}/features")
    spark = order.sparkSession
    spark.createDataFrame([("control", i, c) for i, c in enumerate(controls)] + [("outcome", i, o) for i, o in enumerate(models)],
                          "kind string, place int, name string").write.mode("overwrite").parquet(f"{path}/names")


def load(spark: SparkSession, path: str):
    """(models by outcome, order, controls) as saved."""
    names = spark.read.parquet(f"{path}/names").orderBy("kind", "place").collect()
    models = {r["name"]: PipelineModel.load(f"{path}/model_{r['name']}") for r in names if r["kind"] == "outcome"}
    return models, spark.read.parquet(f"{path}/features"), [r["name"] for r in names if r["kind"] == "control"]
