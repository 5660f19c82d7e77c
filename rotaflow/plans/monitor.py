"""The whole analysis of a fleet behind one object."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from rotaflow.operators import features, fleet, model, quality, status
from rotaflow.operators.report import render_reports
from rotaflow.plans.timeline import MAX_ROWS, Timeline
from rotaflow.sources.readers import read_telemetry
from rotaflow.sources.writers import write_processed


class FleetMonitor:
    """Baselines and tolerances of a fleet, then telemetry, then results as DataFrames."""

    def __init__(
        self,
        spark: SparkSession,
        baselines: DataFrame,
        category_override: str | None = None,
        tolerances: DataFrame | None = None,
        max_rows: int = MAX_ROWS,
    ):
        self.spark = spark
        self.tolerances = tolerances or fleet.default_tolerances(spark)
        self.fleet = fleet.fleet_limits(baselines, self.tolerances, category_override)
        self.max_rows = max_rows
        self._telemetry: DataFrame | None = None
        self._trained: model.Trained | None = None

    def load(self, telemetry: DataFrame | str, fmt: str = "csv") -> FleetMonitor:
        """Takes a telemetry frame, or a path to read."""
        if isinstance(telemetry, str):
            telemetry = read_telemetry(self.spark, telemetry, fmt=fmt)
        self._telemetry = telemetry
        for name in ("timeline", "deviations", "classified"):
            self.__dict__.pop(name, None)
        return self

    @property
    def telemetry(self) -> DataFrame:
        if self._telemetry is None:
            raise ValueError("no telemetry; call load() first")
        return self._telemetry

    def validate(self, strict: bool = False) -> DataFrame:
        return quality.validate(self.telemetry, strict)

    def unmatched(self) -> DataFrame:
        return fleet.unmatched_machines(self.telemetry, self.fleet)

    @cached_property
    def timeline(self) -> Timeline:
        return Timeline.of(self.telemetry, max_rows=self.max_rows)

    @cached_property
    def deviations(self) -> DataFrame:
        return status.deviation_pct(self.telemetry, self.fleet)

    @cached_property
    def classified(self) -> DataFrame:
        return status.analyse(self.telemetry, self.fleet, self.timeline)

    def analyze(
        self,
        failures: DataFrame | None = None,
        train_model: bool = False,
        save_path: str | None = None,
        model_type: str = "random_forest",
    ) -> DataFrame:
        """Analysed readings; optionally trains a model and writes the table."""
        if train_model:
            if failures is None:
                raise ValueError("training needs the failure times of the machines")
            self._trained = self._train(failures, model_type)
        out = status.processed(self.classified)
        if save_path is not None:
            write_processed(out, save_path)
        return out

    def features(self) -> DataFrame:
        made = features.engineer_features(self.deviations, self.timeline)
        columns = [c for c in made.columns if c not in ("well_id", "ts", "reading_id")]
        return features.fill_forward(made, columns, self.timeline)

    def _train(self, failures: DataFrame, model_type: str) -> model.Trained:
        labelled = features.rul_labels(self.features(), failures)
        return model.train_rul(
            features.chronological_split(labelled, self.timeline), model_type=model_type
        )

    @property
    def trained(self) -> model.Trained:
        if self._trained is None:
            raise ValueError("no model; call analyze(train_model=True, failures=...) first")
        return self._trained

    def current_status(self) -> DataFrame:
        return status.current_status(self.classified, self.fleet)

    def anomaly_timeline(self) -> DataFrame:
        return status.anomaly_timeline(self.classified)

    def first_exceedances(self) -> DataFrame:
        return status.first_exceedance(status.exceedance_flags(self.deviations))

    def status_distribution(self) -> DataFrame:
        return status.status_distribution(self.classified)

    def predict_failure(self, current: DataFrame | None = None) -> DataFrame:
        """Prediction for each machine's newest reading, or for given features."""
        rows = current if current is not None else status.latest_reading(self.features())
        return model.predict_rul(self.trained.model, rows, self.trained.features)

    def report(self) -> DataFrame:
        """``well_id, report``: one markdown text per machine, built on the executors."""
        details = status.first_exceedance_detail(status.exceedance_flags(self.deviations))
        return render_reports(
            self.fleet,
            self.tolerances,
            status.current_status(self.classified, self.fleet),
            details,
            self.classified,
            trained=self._trained is not None,
        )

    def save_reports(self, path: str) -> None:
        self.report().write.mode("overwrite").json(path)

