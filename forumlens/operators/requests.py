"""Requests for a labelling model and its answers, as tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens import fixed_values as V
from forumlens.functions.text import truncate

NO_POST = "(no post)"


def last_turn(comment: str, limit: int = V.TEXT_MAX_CHARS) -> Column:
    """The text alone."""
    return F.concat(F.lit("Text:\n"), truncate(comment, limit))


def last_turn_with_post(post: str, comment: str, post_limit: int = V.CONTEXT_MAX_CHARS,
                        limit: int = V.TEXT_MAX_CHARS, no_post: str = NO_POST) -> Column:
    """The post, or a note that there is none, and then the comment."""
    shown = F.when(F.coalesce(F.col(post), F.lit("")) == "", F.lit(no_post)).otherwise(truncate(post, post_limit))
    return F.concat(F.lit("Post:\n"), shown, F.lit("\n\nComment:\n"), truncate(comment, limit))


def last_turn_by_place(kind: str, context: str, comment: str, context_limit: int = V.CONTEXT_MAX_CHARS,
                       limit: int = V.TEXT_MAX_CHARS) -> Column:
    """The context that fits the place of the comment, if there is one, and then the comment."""
    shown = truncate(context, context_limit)
    head = (F.when(F.col(kind) == "post", F.concat(F.lit("Post:\n"), shown, F.lit("\n\n")))
            .when(F.col(kind) == "earlier comment", F.concat(F.lit("Earlier comment:\n"), shown, F.lit("\n\n")))
            .otherwise(F.lit("")))
    return F.concat(head, F.lit("Comment:\n"), truncate(comment, limit))


def static_messages(system: str, examples: list[tuple[str, str]]) -> list[dict]:
    """The prefix that all requests share: the instruction, then example and answer in turn."""
    messages = [{"role": "system", "content": system}]
    for text, answer in examples:
        messages += [{"role": "user", "content": text}, {"role": "assistant", "content": answer}]
    return messages


def prompt_fingerprint(messages: list[dict]) -> str:
    return hashlib.sha256(json.dumps(messages).encode("utf-8")).hexdigest()


def require_prompt(messages: list[dict], expected: str) -> list[dict]:
    found = prompt_fingerprint(messages)
    if found != expected:
        raise ValueError(f"the prompt has fingerprint {found}, expected {expected}")
    return messages


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def request(prefix: list[dict], turn: Column) -> Column:
    """All messages of a request; the prefix is a literal, so only the last turn differs between rows."""
    fixed = [message(m["role"], F.lit(m["content"])) for m in prefix]
    return F.array(*fixed, message("user", turn))


ANSWER_SCHEMA = "struct<top: array<struct<token: string, logprob: double>>>"


def parse_answers(answers: DataFrame, raw: str = "raw_output", log: str = "answer_json",
                  classes: list[str] = V.CLASSES) -> DataFrame:
    """Label, class probabilities and score of each answer.

    An answer outside the classes is an error. The probabilities of the class tokens are rescaled to sum to
    one; an answer without any of them has none.
    """
    top = F.from_json(F.col(log), ANSWER_SCHEMA).getField("top")

    def weight(name: str) -> Column:
        hits = F.filter(top, lambda t: t["token"] == name)
        return F.coalesce(F.exp(F.try_element_at(hits, F.lit(1))["logprob"]), F.lit(0.0))

    weighed = answers.withColumns({f"__w_{c}": weight(c) for c in classes})
    total = sum((F.col(f"__w_{c}") for c in classes), F.lit(0.0))
    probabilities = {f"p_{c}": F.when(total > 0, F.col(f"__w_{c}") / total) for c in classes}
    label = F.when(F.col(raw).isin(classes), F.col(raw)).otherwise(F.lit(V.NO_ANSWER))
    against, _, pro = classes
    return (weighed.withColumns({"label": label, **probabilities}).drop(*[f"__w_{c}" for c in classes])
            .withColumn("score", F.col(f"p_{pro}") - F.col(f"p_{against}")))


def error_rows(parsed: DataFrame, raw: str = "raw_output") -> DataFrame:
    return parsed.filter(F.col("label") == V.NO_ANSWER)


def label_differences(first: DataFrame, second: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """Two runs over the same texts: rows, rows with another label, rows that one run lacks."""
    a = first.select(key, F.col(label).alias("__a"))
    b = second.select(key, F.col(label).alias("__b"))
    joined = a.join(b, key, "full")
    return joined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("__a") != F.col("__b")).alias("differ"),
        F.count_if(F.col("__a").isNull() | F.col("__b").isNull()).alias("missing"))


def failed_controls(scored: DataFrame, known: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """Texts with a known label that got another one, or none."""
    expected = known.select(key, F.col(label).alias("expected"))
    return (expected.join(scored.select(key, label), key, "left")
            .filter(~F.col("expected").eqNullSafe(F.col(label))))
