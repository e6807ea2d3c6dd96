"""Prompts as column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The wordings that models are asked with.
PATTERN_SYSTEM = "You are a helpful assistant that generates strings matching regular expressions. Only output the exact string that matches the regex pattern, nothing more."
PATTERN_EXAMPLES = [("(ab)+", "ab"), ("(ab|cd)+", "cd"), ("[a-z]+", "hello")]
SQL_SYSTEM = (
    "You are a coding assistant helping an analyst answer questions over business data in SQL. "
    "More specifically, the analyst provides you a database schema (tables in the database along with their column names and types) "
    "and asks a question about the data that can be solved by issuing a SQL query to the database. "
    "In response, you write the SQL statement that answers the question. "
    "You do not provide any commentary or explanation of what the code does, just the SQL statement ending in a semicolon."
)
SQL_MESSAGE = (
    "Here is a database schema:\n%s\nPlease write me a SQL statement that answers the following question:\n%s\n"
    "Remember, DO NOT provide any commentary or explanation of what the code does, just the SQL statement ending in a semicolon."
)


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def examples(pairs: list[tuple[str, str]]) -> Column:
    """Literal examples as an array of struct<input, output>."""
    if not pairs:
        return F.array().cast("array<struct<input:string,output:string>>")
    return F.array(*[F.struct(F.lit(i).alias("input"), F.lit(o).alias("output")) for i, o in pairs])


def chat_messages(system: Column, shots: Column, user: Column) -> Column:
    """array<struct<role, content>>: system, then user and assistant of each example, then the user."""
    turns = F.flatten(F.transform(shots, lambda e: F.array(_message("user", e["input"]), _message("assistant", e["output"]))))
    return F.concat(F.array(_message("system", system)), turns, F.array(_message("user", user)))


def pattern_prompt(pattern: Column, system: str = PATTERN_SYSTEM, shots: list[tuple[str, str]] = PATTERN_EXAMPLES) -> Column:
    """Plain prompt: system, the examples, the pattern."""
    text = "\n".join(f"Pattern: {i}\nOutput: {o}" for i, o in shots)
    return F.concat(F.lit(f"{system}\n{text}\n"), pattern)


def molecule_prompt(molecules: Column, system: str) -> Column:
    """Plain prompt: system, a line per molecule, an open line. There is no chat form."""
    return F.concat(F.lit(f"{system}\n"), F.array_join(F.transform(molecules, lambda m: F.concat(F.lit("Molecule: "), m)), "\n"), F.lit("\nMolecule:"))


def sql_prompt(shots: Column, user: Column, system: str = SQL_SYSTEM) -> Column:
    """Plain prompt: system, the examples with their queries, the user's message."""
    text = F.array_join(F.transform(shots, lambda e: F.concat(e["input"], F.lit("\nSQL query: "), e["output"])), "\n\n")
    return F.concat(F.lit(f"{system}\n\n"), text, F.lit("\n\n"), user, F.lit("\nSQL query:"))


def user_message(schema: Column, utterance: Column) -> Column:
    return F.format_string(SQL_MESSAGE, schema, utterance)


def serialize_schema(tables: Column) -> Column:
    """A table's name and a line per column; tables apart by a blank line."""
    line = lambda c: F.concat(F.lit("* "), c["name"], F.lit(" ("), c["tpe"], F.lit("): "), c["nl_name"])
    table = lambda t: F.concat_ws("\n", t["name"], F.array_join(F.transform(t["columns"], line), "\n"))
    bare = lambda t: F.when(F.size(t["columns"]) > 0, table(t)).otherwise(t["name"])
    return F.array_join(F.transform(tables, bare), "\n\n")


def _ids(make: Callable[[], Callable], column: Column) -> Column:
    """array<int>: what the function that ``make`` builds, once per task, gives for every value of the column."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for values in parts:
            yield values.map(lambda v: None if v is None else [int(i) for i in encode(v)])

    return run(column)


def prompt_ids(prompt: Column, make: Callable[[], Callable[[str], list[int]]]) -> Column:
    """array<int>: a plain prompt by a tokenizer. ``make`` builds its function from text to ids; it is called in the tasks."""
    return _ids(make, prompt)


def chat_ids(messages: Column, make: Callable[[], Callable[[list[dict]], list[int]]]) -> Column:
    """array<int>: chat messages (chat_messages) by a chat template. ``make`` builds its function from a list of dicts with
    role and content to ids."""
    return _ids(lambda: (lambda encode: lambda text: encode(json.loads(text)))(make()), F.to_json(messages))


def pattern_ids(pattern: Column, make: Callable[[], Callable], use_chat_format: bool = False, system: str = PATTERN_SYSTEM, shots: list[tuple[str, str]] = PATTERN_EXAMPLES) -> Column:
    if use_chat_format:
        return chat_ids(chat_messages(F.lit(system), examples(shots), pattern), make)
    return prompt_ids(pattern_prompt(pattern, system, shots), make)


def sql_ids(shots: Column, user: Column, make: Callable[[], Callable], use_chat_format: bool = False, system: str = SQL_SYSTEM) -> Column:
    return chat_ids(chat_messages(F.lit(system), shots, user), make) if use_chat_format else prompt_ids(sql_prompt(shots, user, system), make)


def molecule_ids(molecules: Column, make: Callable[[], Callable], system: str, use_chat_format: bool = False) -> Column:
    if use_chat_format:
        raise ValueError("molecules have no chat form")
    return prompt_ids(molecule_prompt(molecules, system), make)
