"""Tasks by name: how each reads its records, scores its predictions, asks its prompts and writes its file.

A task is a bundle of functions from DataFrames to DataFrames (prompts: to columns), any of which a
user may replace by registering a task of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column

from trailweave.operators import annotate, prompts, textmetrics, trajectory
from trailweave.sources import sinks


@dataclass(frozen=True)
class Task:
    """What a task brings; what it lacks is None or absent."""

    name: str
    rows: Callable | None = None
    scores: Callable | None = None
    summary: Callable | None = None
    file: Callable | None = None
    prompts: dict[str, Callable[..., Column]] = field(default_factory=dict)
    features: str | None = None
    objects: str | None = None

    def prompt(self, kind: str, *args: Any, **kwargs: Any) -> Column:
        """The prompt of a sub-task; an unknown one raises."""
        if kind not in self.prompts:
            raise ValueError(f"{self.name} has no prompt for {kind!r}")
        return self.prompts[kind](*args, **kwargs)


_TASKS: dict[str, Task] = {}


def register(task: Task) -> Task:
    """Make a task known under its name; the latest of a name counts."""
    _TASKS[task.name] = task
    return task


def load(name: str, **changes: Any) -> Task:
    """The task of a name, with parts replaced; an unknown name raises."""
    if name not in _TASKS:
        raise ValueError(f"unknown task {name!r}, known: {sorted(_TASKS)}")
    return replace(_TASKS[name], **changes) if changes else _TASKS[name]


def known() -> set[str]:
    """Names of all tasks."""
    return set(_TASKS)


def _bound(function: Callable[..., Column], task: str) -> Callable[..., Column]:
    return lambda *args, **kwargs: function(task, *args, **kwargs)


def _prompts(task: str, *kinds: str) -> dict[str, Callable[..., Column]]:
    makers = {"navigation": prompts.navigation, "summarization": prompts.summarisation, "object_grounding": prompts.grounding, "embodied_qa": prompts.question}
    return {k: _bound(makers[k], task) for k in kinds}


register(Task("r2r", annotate.instruction_rows, trajectory.score_to_goal, trajectory.summary, sinks.navigation_file, _prompts("r2r", "navigation", "summarization", "embodied_qa"), "mp3d"))
register(Task("reverie", annotate.object_rows, trajectory.score_in_set, trajectory.summary, sinks.grounding_file, _prompts("reverie", "navigation", "summarization", "object_grounding"), "mp3d", "reverie"))
register(Task("soon", annotate.search_rows, trajectory.score_detection, trajectory.summary, sinks.search_file, _prompts("soon", "navigation", "summarization", "object_grounding"), "mp3d", "soon"))
register(Task("cvdn", annotate.dialog_rows, trajectory.score_dialog, trajectory.dialog_summary, sinks.dialog_file, _prompts("cvdn", "navigation"), "mp3d"))
register(Task("eqa", None, trajectory.score_to_goal, trajectory.summary, None, _prompts("eqa", "navigation", "embodied_qa"), "mp3d"))
register(Task("scanqa", annotate.question_rows, textmetrics.exact_match, textmetrics.bundle, sinks.question_file, {"3dqa": prompts.scene_question}, "scannet"))
register(Task("llava", annotate.turn_pair_rows, None, None, None, {"3dqa": prompts.image_question}, "coco"))
