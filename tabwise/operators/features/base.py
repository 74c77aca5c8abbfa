"""Base classes for the feature Estimators / Models.

Settings and fitted state are JSON strings held in ``Param``s, so every
Estimator and Model here works inside ``pyspark.ml.Pipeline`` and is saved
and loaded by ``PipelineModel.write()/load()`` (``DefaultParamsWritable``).
Fitted state is always small: per-column statistics and vocabularies, bounded
by the schema and the category limits checked at fit time.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column
from pyspark.sql import functions as F


def qcol(c: str) -> Column:
    return F.col(f"`{c}`")


class _Json(Params):
    config = Param(Params._dummy(), "config", "settings (JSON)", typeConverter=TypeConverters.toString)

    def _init_config(self, cfg: dict[str, Any]) -> None:
        self._setDefault(config="{}")
        self._set(config=json.dumps(cfg, default=str))

    @property
    def cfg(self) -> dict[str, Any]:
        return json.loads(self.getOrDefault(self.config))


class JsonEstimator(Estimator, _Json, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, **cfg: Any) -> None:
        super().__init__()
        self._init_config(cfg)


class JsonTransformer(Transformer, _Json, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, **cfg: Any) -> None:
        super().__init__()
        self._init_config(cfg)


class StateModel(Model, _Json, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "fitted state (JSON)", typeConverter=TypeConverters.toString)

    def __init__(self, state: dict[str, Any] | None = None, **cfg: Any) -> None:
        super().__init__()
        self._init_config(cfg)
        self._setDefault(state="{}")
        if state is not None:
            self._set(state=json.dumps(state, default=str))

    @property
    def st(self) -> dict[str, Any]:
        return json.loads(self.getOrDefault(self.state))
