"""Prompt and conversation builders. The wording is ours and a parameter; the slots are what counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodespark.functions.answers import LETTERS, UPPER, strip

SYSTEM = {
    "plain": "Pick the right option and reply with its letter alone.",
    "unsure": "Pick the right option and reply with its letter alone. If you can't tell, reply 0.",
    "alternative": "Reply with one symbol: the letter of the right option, or 0 when none seems certain.",
    "cot": "Think it through, then close with the letter of the right option inside [[ and ]].",
}


def option_lines(options: Column, upper: bool = False) -> Column:
    """One line for each of the first 26 options: letter, full stop, space and text, trimmed."""
    ids = F.array(*[F.lit(c) for c in (UPPER if upper else LETTERS)])
    line = lambda o, i: strip(F.concat(F.get(ids, i), F.lit(". "), F.coalesce(o, F.lit(""))))
    return F.array_join(F.transform(F.slice(options, 1, 26), line), "\n")


def system_prompt(subject: Column, kind: str = "plain") -> Column:
    """The instruction, naming the subject if there is one."""
    return F.concat(F.when(subject.isNotNull(), F.concat(F.lit("You answer questions about "), subject, F.lit(". "))).otherwise(F.lit("")), F.lit(SYSTEM[kind]))


def user_prompt(question: Column, options: Column, upper: bool = False) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\n\nOptions:\n"), option_lines(options, upper))


def explain_prompt(question: Column, options: Column, gold: Column) -> Column:
    """Asks for reasons that lead to the given right letter."""
    return F.concat(user_prompt(question, options, True), F.lit("\n\nRight option: "), gold, F.lit("\nExplain step by step why it is right."))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(system: Column, user: Column) -> Column:
    return F.array(message("system", system), message("user", user))


def review_chat(subject: Column, question: Column, options: Column, wrong: Column, gold: Column) -> Column:
    """Four messages: task, question, the wrong answer given, and the request to find the error."""
    return F.array(
        message("system", system_prompt(subject)),
        message("user", user_prompt(question, options, True)),
        message("assistant", wrong),
        message("user", F.concat(F.lit("That is wrong; the right option is "), gold, F.lit(". Say where the reasoning went astray."))),
    )


def level_prompt(question: Column) -> Column:
    return F.concat(F.lit("Which education level does this need: high_school_and_easier, undergraduate, graduate or postgraduate? Put it inside [[ and ]].\n\n"), question)


def rating_prompt(question: Column, level: Column) -> Column:
    return F.concat(F.lit("From 1 to 10, how well does the level "), level, F.lit(" fit this question? Put the number inside [[ and ]].\n\n"), question)


def chatml(messages: Column, generate: bool = True) -> Column:
    """The messages as one ChatML string, with an open assistant turn at the end if generate."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
    return F.concat(body, F.lit("<|im_start|>assistant\n")) if generate else body


def chatml_example(system: Column, user: Column, answer: Column) -> Column:
    """A training example; without an answer, the prompt alone. NULL if a slot is NULL."""
    turn = chatml(chat(system, user))
    return F.when(answer.isNotNull(), F.concat(turn, answer, F.lit("<|im_end|>\n"))).otherwise(turn)
