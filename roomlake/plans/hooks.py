"""What a scene build calls from outside: review, generation, abort and progress; and how it goes on when they fail."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import review
from ..session import checkpointed

log = logging.getLogger(__name__)


class BuildAborted(Exception):
    """The caller asked the build to stop."""


@dataclass
class SceneHooks:
    """``review``: instances -> decisions (review.apply_decisions); ``generate``: objects without a scan mesh -> (inst_id, glb); ``abort``:
    whether to stop; ``progress``: called with a share and the stage's name."""

    review: Callable[[DataFrame], DataFrame] | None = None
    generate: Callable[[DataFrame], DataFrame] | None = None
    abort: Callable[[], bool] | None = None
    progress: Callable[[float, str], None] | None = None

    def stage(self, share: float, name: str) -> None:
        """Between stages: stop if asked to, else tell how far the build is; a progress call that fails stops nothing."""
        if self.abort and self.abort():
            raise BuildAborted(name)
        if self.progress:
            try:
                self.progress(share, name)
            except Exception:
                log.exception("progress of %s was not taken", name)

    def reviewed(self, instances: DataFrame) -> DataFrame:
        """Instances after review; without a reviewer, or if it fails, the detector's labels stay and nothing is rejected."""
        if self.review is not None:
            try:
                decided = review.apply_decisions(instances, checkpointed(self.review(instances)))
                return instances.drop("label").join(decided.select("inst_id", "label", "status"), "inst_id")
            except Exception:
                log.exception("the review failed; labels stay as detected")
        return instances.withColumn("status", F.lit("kept"))

    def generated(self, objects: DataFrame) -> DataFrame:
        """Objects with the generator's models as glb where it made one; if it fails, stand-ins stay."""
        if self.generate is not None:
            try:
                made = checkpointed(self.generate(objects).select("inst_id", F.col("glb").alias("_made")))
                return objects.join(made, "inst_id", "left").withColumn("glb", F.coalesce("_made", "glb")).drop("_made")
            except Exception:
                log.exception("the generator failed; stand-ins stay")
        return objects


_GENERATOR: list[Callable[[DataFrame], DataFrame]] = []


def set_object_generator(generate: Callable[[DataFrame], DataFrame] | None) -> None:
    """The generator that builds use if their hooks name none; None takes it away."""
    _GENERATOR[:] = [] if generate is None else [generate]


def object_generator() -> Callable[[DataFrame], DataFrame] | None:
    return _GENERATOR[0] if _GENERATOR else None
