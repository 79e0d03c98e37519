"""Stored models: one folder per model, one small registry table."""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.features import FeatureBuilder, FeatureConfig
from .training import DevelopabilityModel, ModelConfig

SCHEMA = "target string, lm string, model string, db string, task string, threshold double, path string, ts timestamp"

CLASSES = {
    ("random_forest", "classification"): RandomForestClassificationModel,
    ("random_forest", "regression"): RandomForestRegressionModel,
    ("gradient_boosting", "classification"): GBTClassificationModel,
    ("gradient_boosting", "regression"): GBTRegressionModel,
    ("logistic_l1", "classification"): LogisticRegressionModel,
}


def model_name(target: str, lm: str, model: str, db: str, task: str) -> str:
    name = f"{model}_{target}_{lm}_{db}"
    return name + "_regression" if task == "regression" else name


class Registry:
    """Models under one root folder shared by the cluster."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).json(f"{self.root}/registry")
        except Exception:
            return self.spark.createDataFrame([], SCHEMA)

    def save(self, model: DevelopabilityModel, target: str, lm: str, db: str) -> str:
        """Store a fitted model and append its registry row; returns its path."""
        now = datetime.now(timezone.utc)
        name = model_name(target, lm, model.config.kind, db, model.task)
        path = f"{self.root}/{name}/{now:%Y%m%dT%H%M%S%f}"
        model.model.write().overwrite().save(f"{path}/model")
        meta = {
            "features": asdict(model.features), "config": asdict(model.config), "task": model.task,
            "lengths": model.builder.lengths, "names": model.builder.feature_names,
        }
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")
        row = (target, lm, model.config.kind, db, model.task, model.threshold, path, now.replace(tzinfo=None))
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").json(f"{self.root}/registry")
        return path

    def set_threshold(self, path: str, threshold: float) -> None:
        """Append the row of a model again with a threshold; the newest row counts."""
        row = self._table().where(F.col("path") == path).orderBy(F.col("ts").desc()).first()
        if row is None:
            raise ValueError(f"not registered: {path}")
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        values = (*[row[c] for c in ("target", "lm", "model", "db", "task")], float(threshold), path, now)
        self.spark.createDataFrame([values], SCHEMA).coalesce(1).write.mode("append").json(f"{self.root}/registry")

    def find(self, target: str, lm: str, model: str, db: str | None = None, path: str | None = None):
        """Registry row: an explicit path wins, else the database, else the newest match."""
        table = self._table()
        if path:
            row = table.where(F.col("path") == path).orderBy(F.col("ts").desc()).first()
        else:
            same = table.where((F.col("target") == target) & (F.col("lm") == lm) & (F.col("model") == model))
            order = [(F.col("db") == db).desc()] if db else []
            row = same.orderBy(*order, F.col("ts").desc()).first()
        if row is None:
            raise ValueError(f"no stored model for {model}/{target}/{lm}")
        return row

    def newest(self, target: str) -> list:
        """Newest registry row of every stored model of a target; one row per (lm, model, db)."""
        same = self._table().where(F.col("target") == target)
        row = F.max_by(F.struct(*[F.col(f.name) for f in same.schema]), F.col("ts")).alias("r")
        return same.groupBy("lm", "model", "db").agg(row).select("r.*").orderBy("lm", "model", "db").collect()

    def load(self, path: str, threshold: float | None = None) -> DevelopabilityModel:
        meta = json.loads(self.spark.read.text(f"{path}/meta").first()["value"])
        features = {k: tuple(v) if isinstance(v, list) else v for k, v in meta["features"].items()}
        out = DevelopabilityModel(FeatureConfig(**features), ModelConfig(**meta["config"]), meta["task"])
        out.builder = FeatureBuilder(out.features)
        out.builder.lengths, out.builder.feature_names = meta["lengths"], meta["names"]
        kind: type[Model] = CLASSES[out.config.kind, out.task]
        out.model = kind.load(f"{path}/model")
        out.threshold = threshold
        return out
