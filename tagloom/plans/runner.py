"""Runs stages in order; each reads what others have written."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .config import Config

log = logging.getLogger("tagloom")


@dataclass
class StageResult:
    name: str
    status: str  # success, skipped or failed
    outputs: dict[str, str] = field(default_factory=dict)
    details: dict[str, object] = field(default_factory=dict)


@dataclass
class Context:
    spark: SparkSession
    config: Config


Stage = Callable[..., StageResult]
STAGES: dict[str, Stage] = {}

#: The recommender runs before the graph, which shows its fusions.
ORDER = (
    "download", "ingredient_normalization", "ingredient_ner_train", "combine_raw", "ingredient_ner_infer", "ingredient_post_map", "ingredient_encoding", "cuisine_normalization",
    "cuisine_classifier", "ingredients_summary", "analysis_baseline", "analysis_pmi", "analysis_recommender", "analysis_graph", "analysis_viz",
)


def stage(function: Stage) -> Stage:
    STAGES[function.__name__] = function
    return function


class Runner:
    def __init__(self, spark: SparkSession, config: Config):
        self.context = Context(spark, config)

    def run(self, stages: list[str] | None = None, overrides: dict[str, dict] | None = None, stop_on_failure: bool = True) -> list[StageResult]:
        """Results of the stages named (all in order by default); unknown ones are skipped, errors make a stage failed."""
        from . import stages as _  # noqa: F401  registers the stages

        out = []
        for name in stages or ORDER:
            if name not in STAGES:
                out.append(StageResult(name, "skipped", details={"reason": "no such stage"}))
                continue
            began = time.time()
            try:
                result = STAGES[name](self.context, **(overrides or {}).get(name, {}))
            except Exception as e:  # a stage's failure is a result
                log.exception("%s failed", name)
                result = StageResult(name, "failed", details={"error": str(e)})
            result.details["seconds"] = round(time.time() - began, 3)
            log.info("%s: %s", name, result.status)
            out.append(result)
            if result.status == "failed" and stop_on_failure:
                break
        return out
