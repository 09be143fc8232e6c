"""Prompts as column expressions: fixed sentences around numbered placeholders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentences models were trained with.
HISTORY = "Following is the History, which contains the visual information of your previous decisions.\n"
CANDIDATE = "Following is the Candidate, which contains several directions you can go to at the current position, candidate (0) is stop.\n"
OBSERVATION = "Following is the Observation, which contains panoramic views at your current location.\n"
OBJECT = "Following is the Object, which contains several objects that you could see at the current viewpoint, option (0) indicates not exist.\n"
NAVIGATION = {
    "r2r": (
        "### Instruction: Navigate following the instruction. {} \n",
        "Compare the History and Instruction to infer your current progress, and then select the correct direction from the candidates to go to the target location.\n",
    ),
    "reverie": (
        "### Instruction: Go to the location to complete the given task. Task: {} \n",
        "Explore the scene to find out the targeted room and object. Then select the correct direction from the candidates to go to the target location.\n",
    ),
    "soon": (
        "### Instruction: Find the described target. Target: {} \n",
        "Nearby areas and objects can assist you in locating the desired room and object. Select the correct direction from the candidates to go to the target location.\n",
    ),
    "cvdn": (
        "### Instruction: Find the described room according the given dialog. Target: {} \n",
        "Understand the dialog in the Instruction and infer the current progress based on the History and dialog. "
        "Then select the correct direction from the candidates to go to the target location.\n",
    ),
    "eqa": (
        '### Instruction: Navigate following the instruction. Move to the object in "{}", and stop there. \n',
        "Compare the History and Instruction to infer your current progress, and then select the correct direction from the candidates to go to the target location.\n",
    ),
}
SUMMARISATION = {
    "r2r": (
        "### Instruction: Predict the fine-grained instruction based on your previous history and current location. "
        "Fine-grained instructions contain commands for each individual step. \n",
        "Please generate the step-by-step instruction.\n",
    ),
    "reverie": (
        "### Instruction: Generate the task you need to complete based on your previous history and current location. \n",
        "Please predict the task you need to complete.\n",
    ),
    "soon": (
        "### Instruction: Generate the target you want to find based on your previous history and current location. Describe both the target and its surroundings. \n",
        "Please predict both the target you want to find and its surroundings.\n",
    ),
}
GROUNDING_HEAD = "Select the target object from the candidate objects based on the instruction and history.\n"
GROUNDING_HINT = "Select the target object from the candidate objects according to the instruction.\n"
QUESTION = {"r2r": "### Instruction: answer the question. \n", "eqa": "### Instruction: Answer the question according to the scene. \n"}
SCENE_QUESTION = (
    "Please answer questions based on the observation.\nThe following is the Observation, which includes multiple images from different locations.\n",
    "### Observation: {} \n",
    "### Question: {}\n",
    "### Answer: ",
)
IMAGE_QUESTION = ("### Image: <cand>\n", "### Instruction: {}\n", "### Output: ")


def filled(template: str, value: Column) -> Column:
    """A template whose one ``{}`` is a column."""
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def numbered(count: Column, mark: str, first: str | None = None) -> Column:
    """``(0) mark (1) mark ...``; ``first`` replaces the first mark. Nothing for a count of 0."""
    items = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.concat(F.lit("("), k.cast("string"), F.lit(") "), F.when(k == 0, first or mark).otherwise(mark)))
    return F.when(count > 0, F.array_join(items, " ")).otherwise("")


def _joined(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _history(count: Column) -> Column:
    return _joined(HISTORY, "### History: ", numbered(count, "<hist>"), "\n")


def _unless_empty(count: Column, block: Column) -> Column:
    return F.when(count != 0, block).otherwise("")


def _observation(count: Column) -> Column:
    return _unless_empty(count, _joined(OBSERVATION, "### Candidate: ", numbered(count, "<cand>"), "\n"))


def navigation(task: str, instruction: Column, history: Column, candidates: Column, cls: str = "<cls>") -> Column:
    """Which way to go."""
    head, hint = NAVIGATION[task]
    said = F.replace(instruction, F.lit("?"), F.lit("")) if task == "eqa" else instruction
    return _joined(filled(head, said), _history(history), CANDIDATE, "### Candidate: ", numbered(candidates, "<cand>", "stop"), "\n", hint, f"### Output: {cls}")


def summarisation(task: str, history: Column, candidates: Column) -> Column:
    """What the way so far was."""
    head, hint = SUMMARISATION[task]
    return _joined(head, _history(history), _observation(candidates), hint, "### Answer: ")


def grounding(task: str, instruction: Column, history: Column, objects: Column, cls: str = "<cls>") -> Column:
    """Which object it is."""
    head = NAVIGATION[task][0]
    return _joined(GROUNDING_HEAD, filled(head, instruction), _history(history), OBJECT, "### Object: ", numbered(objects, "<cand>", "not exist"), "\n", GROUNDING_HINT, f"### Output: {cls}")


def question(task: str, asked: Column, history: Column, candidates: Column) -> Column:
    """A question about a walk; one task leaves an empty history out."""
    told = _unless_empty(history, _history(history)) if task == "r2r" else _history(history)
    return _joined(QUESTION[task], told, _observation(candidates), filled("### Question: {}\n", asked), "### Answer: ")


def scene_question(asked: Column, images: Column) -> Column:
    """A question about several images of a scene."""
    intro, seen, ask, end = SCENE_QUESTION
    return _joined(intro, filled(seen, numbered(images, "<cand>")), filled(ask, asked), end)


def image_question(asked: Column) -> Column:
    """An instruction about one image."""
    image, ask, end = IMAGE_QUESTION
    return _joined(image, filled(ask, asked), end)


def by_task(task: Column, options: dict[str, Column]) -> Column:
    """The prompt of the row's task; an unknown one raises."""
    chosen = reduce(lambda w, kv: w.when(task == kv[0], kv[1]), list(options.items())[1:], F.when(task == next(iter(options)), next(iter(options.values()))))
    return chosen.otherwise(F.raise_error(F.concat(F.lit("no prompt for "), F.coalesce(task, F.lit("null")))))
