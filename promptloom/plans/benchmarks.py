"""The question-answering benchmarks as declared plans: template, choices, scoring.

Each plan asks one template over a table of questions with images and scores the replies;
keep ratios, pruning kernels and grouping are arguments of the operators, so a variant is
a call and not a script.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.functions import text as tx
from promptloom.functions.backends import Backend
from promptloom.operators import scoring
from promptloom.operators.semantic import sem_map


@dataclass(frozen=True)
class Plan:
    """``score``: exact, contains, any (of an array, in a JSON reply) or index."""

    template: str
    answer: str
    score: str
    choices: tuple[str, ...] | None = None
    json_schema: dict[str, Any] | None = None
    options: str | None = None
    key: str = "image_id"


ANSWER_SCHEMA = {"type": "object", "properties": {"Answer": {"type": "string"}}, "required": ["Answer"]}

#: The wording of each benchmark's prompt.
PLANS: dict[str, Plan] = {
    "pope": Plan("Given the question: {text:question} and image: {image:image}, give me the answer to the question", "answer", "exact", ("Yes", "No"), key="image_source"),
    "vqav2": Plan("Given the question: {text:question} and candidate answers {text:answers} and {text:answer_type} and image: {image:image}, give me the answer to the question", "multiple_choice_answer", "contains"),
    "textvqa": Plan("Given the question: {text:question} and image: {image:image}, give me the answer to the question", "answers", "any", json_schema=ANSWER_SCHEMA),
    "mme": Plan("Given the question: {text:question} and image: {image:image} give me the answer to the question", "answer", "exact", ("Yes", "No"), key="question_id"),
    "ai2d": Plan("Given the question: {text:question} and the image: {image:image}. The candidate answers are: {text:options}. Return only the index number (0, 1, 2, or 3) of the correct answer.", "answer", "index", ("0", "1", "2", "3"), options="options"),
    "hallusion": Plan("Given the text: {text:question} and image: {image:image}, give me the answer to the question, return 1 as yes and 0 as no", "gt_answer", "contains", ("0", "1"), key="filename"),
    "chartqa": Plan("Given the text: {text:question} image: {image:image}, give me the answer to the question", "answer", "contains"),
    "scivqa": Plan("\n        Question: {text:question}\n        Image: {image:image_file}\n        Figure Caption: {text:caption}\n        Figure Type: {text:figure_type}\n        QA Type: {text:qa_pair_type}\n        Answer Options: {text:answer_options}\n        ", "answer", "contains", key="figure_id"),
}


def ask(df: DataFrame, plan: Plan, backend: Backend, system: str | None = None, dedup: bool = True, choices_col: str | None = None) -> DataFrame:
    """``df`` with ``predicted`` and ``is_correct``. Scores are columns of the same plan, so
    counting them and writing them can share one materialised result."""
    named = df
    replied = sem_map(named, plan.template, "predicted", backend, None, plan.choices, choices_col, plan.json_schema, system, dedup=dedup)
    tidy = replied.withColumn("predicted", tx.fold_space(F.col("predicted")))
    reply, answer = F.col("predicted"), F.col(plan.answer)
    score = {
        "exact": lambda: scoring.exact(reply, answer.cast("string")),
        "contains": lambda: scoring.contains(reply, answer.cast("string")),
        "any": lambda: scoring.any_answer(reply, answer),
        "index": lambda: scoring.by_index(reply, _options(df, plan), answer.cast("string")),
    }[plan.score]()
    return tidy.withColumn("is_correct", score)


def _options(df: DataFrame, plan: Plan):
    c = F.col(plan.options)
    return tx.options(c) if df.schema[plan.options].dataType.simpleString() == "string" else c


def run_sweep(df: DataFrame, plan: Plan, backends: dict[float, Backend]) -> DataFrame:
    """keep_ratio and accuracy for backends that differ in how much of the image they see."""
    runs = [scoring.accuracy(ask(df, plan, b)).withColumn("keep_ratio", F.lit(r)) for r, b in backends.items()]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


#: The templates of the text-table queries over movies and reviews, and of
#: the logo joins.
KID_FRIENDLY = "Is this movie kid-friendly? Use {movie_info} and {review_content}. Answer Yes/No"
MINIMAL_VIOLENCE = "Does {review_content} indicate minimal violence? Answer Yes/No"
SUITABLE = "Analyze whether this movie would be suitable for kids based on {movie_info} and {review_content}, only answer Yes or No"
FRESH = "Analyze whether this movie would be fresh based on {movie_info} and {review_content}, only answer Fresh or NonFresh"
RECOMMEND = "Recommend movies for the user based on {movie_info} and {review_content}"
RATE = "Rate a satisfaction score between 0 (bad) and 5 (good) based on {review_content} and {movie_info}:, only return the score "
RACETRACK = ("You will be provided with a horse racetrack name and an image. ", "Determine if the image shows the logo of the racetrack. ", "Racetrack: {text:Track} Image: {image:uri} ")
AIRLINE = ("You will be provided with an airline name and an image. ", "Determine if the image shows the logo of the airline. ", "Airline: {text:Airlines} Image: {image:uri} ")


def fields_query(text: str, names: Sequence[str]) -> str:
    """A template that lists fields after a text, as the wide-table queries do."""
    return text + " " + ", ".join(f"{{{n}}}" for n in names)
