"""Prompts as columns: free text, two-field objects, answer contracts and tool calls."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording of the prompts and the placeholders of their templates.
FREE = (
    "Solve this grade-school math problem. First give only 1-3 short calculation sentences, without lists or headings. "
    "Do not state the final answer before the reasoning. On the final line write exactly: Final answer: <number>"
)
OBJECT = (
    "Solve this grade-school math problem. The reasoning value must contain only 1-3 short calculation sentences, without lists or headings. "
    "The answer value must contain only the final numeric answer, with no units, currency symbol, or reasoning. "
    "Return only one valid JSON object, with no markdown or extra text. Use exactly two keys in this field order: {keys}. "
    "Replace both angle-bracket placeholders in this template and do not output the angle brackets themselves:\n{template}"
)
TOOL = (
    "Call the single available function for the user request. Return only one JSON object that follows the call schema exactly, with no "
    "markdown or extra text. Do not add, remove, rename, or reorder fields."
)
REASONING = '"<calculation sentences>"'
ANSWERS = {"baseline": '"<final numeric answer>"', "integer": "<integer>", "string": '"<numeric string>"'}
ORDER = ("reasoning", "answer")


def instructions(representation: str | None = None, order: tuple[str, ...] = ORDER) -> str:
    """What stands before the question: of a free answer (None), or of an object whose answer is represented so."""
    if representation is None:
        return FREE
    values = {"reasoning": REASONING, "answer": ANSWERS[representation]}
    template = "{" + ", ".join(f"{json.dumps(k)}: {values[k]}" for k in order) + "}"
    return OBJECT.format(keys=", then ".join(json.dumps(k) for k in order), template=template)


def question_prompt(question: Column | str, representation: str | None = None, order: tuple[str, ...] = ORDER) -> Column:
    """The prompt of a question; a null question is empty."""
    asked = F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit(""))
    return F.concat(F.lit(instructions(representation, order) + "\n\nQuestion:\n"), asked)


def tool_prompt(request: Column, name: Column, description: Column, schema_text: Column) -> Column:
    """The prompt of a tool call; schema_text is the schema's compact JSON. Nulls are empty."""
    parts = {"User request": request, "Function name": name, "Function description": description, "Call schema": schema_text}
    cells = [x for title, part in parts.items() for x in (F.lit(f"\n\n{title}:\n"), F.coalesce(part, F.lit("")))]
    return F.concat(F.lit(TOOL), *cells)
