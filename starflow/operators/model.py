"""From points to class probabilities: a classifier with the preparation it was fitted with.

``Classifier.create`` clamps and imputes a feature table, selects features, searches settings and fits; ``predict``
extracts the selected features of new series from their points, fills them with the training table's values and gives
the probability of each class. ``save`` writes the whole bundle, ``load`` reads it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starflow.operators import learn, matrix
from starflow.operators.extract import extract
from starflow.session import cut


@dataclass
class Classifier:
    """``columns`` are the features in use; ``trials`` and ``selection`` are the records of the search."""

    model: PipelineModel
    columns: list[str]
    imputer: matrix.Imputer | None = None
    params: dict = field(default_factory=dict)
    trials: list[dict] = field(default_factory=list)
    decisions: dict[str, str] = field(default_factory=dict)
    selection: list[tuple] = field(default_factory=list)

    @classmethod
    def create(
        cls, table: DataFrame, columns: list[str], label: str = "label", kind: str = "rf", key: str = "id", impute: str | None = "knn",
        selection_trials: int = 0, trials: int = 0, k: int = 3, metric: str = "f1", balance: bool = True, importance: str = "gini", sample: bool = False, **params,
    ) -> Classifier:
        """Fit a classifier to a feature table ``(key, label, columns...)``.

        Values are clamped, nulls filled (``impute`` names the strategy; without it, rows with nulls are left out).
        With ``selection_trials`` only the features that beat their shuffled shadows stay, tentative ones settled by
        their medians (all, if none does), by the ``importance`` and ``sample`` of ``learn.select_features``; with
        ``trials``, settings are searched by the cross-validated ``metric``.
        """
        clean = matrix.clamped(table.select(key, label, *columns), columns)
        decisions, selection = {}, []
        if selection_trials:
            filled = cut(matrix.impute(clean, columns, "median", key=key))
            decisions, selection = learn.select_features(filled, columns, label, selection_trials, key, importance=importance, sample=sample)
            decisions = learn.settle_tentative(decisions, selection)
            columns = [c for c in columns if decisions[c] == "accepted"] or columns
        clean = clean.select(key, label, *columns)
        imputer = matrix.fit_imputer(clean, columns, impute, key=key) if impute else None
        ready = cut(imputer.transform(clean) if imputer else clean.dropna(subset=columns))
        history: list[dict] = []
        if trials:
            model, params, history = learn.optimise(ready, columns, label, kind, trials, k, key, metric=metric, balance=balance)
        else:
            model = learn.train(ready, columns, label, kind, **params)
        return cls(model, columns, imputer, params, history, decisions, selection)

    def predict_features(self, features: DataFrame, key: str = "lc_id") -> DataFrame:
        """``(key, class, probability)`` of rows that have the columns in use: a row a class, in alphabetical order. Rows
        with nulls that no imputer fills get none."""
        ready = matrix.clamped(features.select(key, *self.columns), self.columns)
        if self.imputer:
            own = self.imputer.key
            ready = self.imputer.transform(ready.withColumnRenamed(key, own)).withColumnRenamed(own, key)
        else:
            ready = ready.dropna(subset=self.columns)
        return learn.predict(self.model, ready, key)

    def predict(self, points: DataFrame, weighted: bool = True, convert: bool = True, zp: float = 24.0) -> DataFrame:
        """``(lc_id, class, probability, n_points)`` of all series in ``points(lc_id, seq, time, mag, magerr)``.
        Probabilities of series with fewer than 30 points deserve little trust."""
        sizes = points.groupBy("lc_id").agg(F.count(F.lit(1)).alias("n_points"))
        return self.predict_features(extract(points, self.columns, weighted, convert, zp)).join(sizes, "lc_id")

    def save(self, spark: SparkSession, path: str) -> None:
        learn.save(self.model, f"{path}/model")
        if self.imputer:
            matrix.save(self.imputer, spark, f"{path}/imputer")
        record = {"columns": self.columns, "imputed": self.imputer is not None, "params": self.params, "trials": self.trials, "decisions": self.decisions, "selection": self.selection}
        spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/record")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Classifier:
        record = json.loads(spark.read.text(f"{path}/record").first().value)
        imputer = matrix.load(spark, f"{path}/imputer") if record["imputed"] else None
        selection = [tuple(r) for r in record["selection"]]
        return cls(learn.load(f"{path}/model"), record["columns"], imputer, record["params"], record["trials"], record["decisions"], selection)
