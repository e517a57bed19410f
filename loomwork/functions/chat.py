"""The chat template with tools: system, user, assistant, tool calls and tool responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import unused

# The template's texts, which results depend on letter by letter.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TOOLS_HEAD = "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
TOOLS_TAIL = '\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'

MESSAGE = "struct<role: string, content: string, tool_calls: array<struct<name: string, arguments: string>>>"


def _newlines(t: Column, left: bool = True, right: bool = True) -> Column:
    return F.regexp_replace(t, "|".join([r"\A\n+"] * left + [r"\n+\z"] * right), "")


def _calls(calls: Column, content: Column) -> Column:
    """The calls of one assistant message, each on lines of its own."""
    one = F.transform(F.coalesce(calls, F.array().cast("array<struct<name: string, arguments: string>>")), lambda c: F.concat(F.lit('<tool_call>\n{"name": "'), c["name"], F.lit('", "arguments": '), c["arguments"], F.lit("}\n</tool_call>")))
    return F.concat(F.when((F.size(one) > 0) & (content != ""), "\n").otherwise(""), F.array_join(one, "\n"))


def with_chat(rows: DataFrame, messages: str, to: str, tools: list[str] | None = None, generation_prompt: bool = False, thinking: bool = True) -> DataFrame:
    """`rows` with `to`: the conversation (array of MESSAGE) as the model is given it.

    `tools`: JSON texts of the functions, told in the system's turn. Answers after the last question keep their
    thinking; of earlier ones it goes. Tool responses in a row share one turn. Null contents count as empty, null or
    empty conversations give the tools and the prompt alone. `thinking` off adds an empty thought to the prompt.
    """
    m, last, n = unused(rows, "_messages", "_last", "_n")
    field = lambda x: F.struct(x["role"].alias("role"), F.coalesce(x["content"], F.lit("")).alias("content"), x["tool_calls"].alias("calls"))
    known = rows.withColumn(m, F.transform(F.coalesce(F.col(messages), F.array().cast(f"array<{MESSAGE}>")), field)).withColumn(n, F.size(m))
    asks = lambda x: (x["role"] == "user") & ~(x["content"].startswith("<tool_response>") & x["content"].endswith("</tool_response>"))
    known = known.withColumn(last, F.coalesce(F.array_max(F.transform(m, lambda x, i: F.when(asks(x), i))), F.col(n) - 1))
    role_at = lambda i: F.get(m, i)["role"]

    def answer(x: Column, i: Column) -> Column:
        thought = F.instr(x["content"], "</think>") > 0
        before = _newlines(F.element_at(F.split(x["content"], "</think>"), 1), left=False)
        reason = F.when(thought, _newlines(F.element_at(F.split(before, "<think>"), -1))).otherwise("")
        content = F.when(thought, _newlines(F.element_at(F.split(x["content"], "</think>"), -1), right=False)).otherwise(x["content"])
        shown = (i > F.col(last)) & ((i == F.col(n) - 1) | (reason != ""))
        head = F.when(shown, F.concat(F.lit("<think>\n"), reason, F.lit("\n</think>\n\n"), _newlines(content, right=False))).otherwise(content)
        return F.concat(F.lit(f"{OPEN}assistant\n"), head, _calls(x["calls"], content), F.lit(CLOSE))

    def turn(x: Column, i: Column) -> Column:
        plain = F.concat(F.lit(OPEN), x["role"], F.lit("\n"), x["content"], F.lit(CLOSE))
        alone = lambda at: ~F.coalesce(role_at(at) == "tool", F.lit(False))
        response = F.concat(F.when(alone(F.greatest(i - 1, F.lit(0))) | (i == 0), f"{OPEN}user").otherwise(""), F.lit("\n<tool_response>\n"), x["content"], F.lit("\n</tool_response>"), F.when(alone(i + 1), CLOSE).otherwise(""))
        return F.when((x["role"] == "user") | ((x["role"] == "system") & (i > 0)), plain).when(x["role"] == "assistant", answer(x, i)).when(x["role"] == "tool", response).otherwise("")

    system = F.coalesce(role_at(F.lit(0)) == "system", F.lit(False))
    said = F.get(m, F.lit(0))["content"]
    if tools:
        listed = TOOLS_HEAD + "".join(f"\n{t}" for t in tools) + TOOLS_TAIL
        head = F.concat(F.lit(f"{OPEN}system\n"), F.when(system, F.concat(said, F.lit("\n\n"))).otherwise(""), F.lit(listed + CLOSE))
    else:
        head = F.when(system, F.concat(F.lit(f"{OPEN}system\n"), said, F.lit(CLOSE))).otherwise("")
    end = (f"{OPEN}assistant\n" + ("" if thinking else "<think>\n\n</think>\n\n")) if generation_prompt else ""
    return known.withColumn(to, F.concat(head, F.array_join(F.transform(m, turn), ""), F.lit(end))).drop(m, last, n)
