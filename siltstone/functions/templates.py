"""Column builders that turn rows of different sources into training texts: all stay inside the JVM.

Each gives the empty text where a part that it needs is missing, so that a filter on the empty text drops the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cut_at_sentence, normalize

SYSTEM = "You are a helpful assistant."
LEAST_CHARS = 100


def chat_text(messages: Column) -> Column:
    """An array of (role, content) as `<|role|> content ...`; a missing role is the user's, empty contents are left out."""
    parts = F.transform(messages, lambda m: F.struct(normalize(m["role"]).alias("role"), normalize(m["content"]).alias("content")))
    kept = F.filter(parts, lambda m: m["content"] != "")
    return F.coalesce(F.array_join(F.transform(kept, lambda m: F.concat(F.lit("<|"), F.when(m["role"] == "", "user").otherwise(m["role"]), F.lit("|> "), m["content"])), " "), F.lit(""))


def answered_chat_text(messages: Column, answer: Column) -> Column:
    prompt, reply = chat_text(messages), normalize(answer)
    return F.when((prompt == "") | (reply == ""), "").otherwise(F.concat(prompt, F.lit(" <|assistant|> "), reply))


def work_order_text(equipment: Column, order_type: Column, description: Column, operation: Column) -> Column:
    """The order as a request for a work instruction, its operation as the answer; two blanks stand where there is no context."""
    named = [F.when(normalize(c) != "", F.concat(F.lit(label), normalize(c), F.lit("."))) for label, c in (("Equipment: ", equipment), ("Order type: ", order_type))]
    text = F.concat(F.lit("<|user|> Create a safe maintenance work instruction. "), F.concat_ws(" ", *named), F.lit(" Issue: "), normalize(description), F.lit(" <|assistant|> "), normalize(operation))
    return F.when((normalize(description) == "") | (normalize(operation) == ""), "").otherwise(text)


def question_text(system: Column, question: Column, response: Column) -> Column:
    said = F.when(F.coalesce(system, F.lit("")) == "", SYSTEM).otherwise(normalize(system))
    text = F.concat(F.lit("<|system|> "), said, F.lit(" <|user|> "), normalize(question), F.lit(" <|assistant|> "), normalize(response))
    return F.when((normalize(question) == "") | (normalize(response) == ""), "").otherwise(text)


def document_text(text: Column) -> Column:
    return F.when(F.length(normalize(text)) >= LEAST_CHARS, cut_at_sentence(normalize(text))).otherwise("")
