"""Prompt templates as Column expressions over text columns and message arrays.

A message array is ``ARRAY<STRUCT<role: STRING, content: STRING>>``.  A conversation too long for one
row comes in parts (see ``operators.messages``); the *context* struct tells a template where its
part stands: ``opens`` / ``closes`` (holds the first / last message), ``last_query_at`` (index in the
part of the last real user turn, below 0 or past the end when that turn lies elsewhere), ``prev_role``
and ``next_role`` (neighbours outside the part).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptloom.functions.text import lstrip_newlines, rstrip_newlines, strip_newlines, tokens

# Markup of the chat and instruct formats.
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
DEFAULT_SYSTEM = "You are a helpful assistant."
INST_OPEN = "<s>[INST] "
INST_CLOSE = "[/INST] "
THINK_START = "<think>"
THINK_STOP = "</think>"
TOOL_RESPONSE_START = "<tool_response>"
TOOL_RESPONSE_STOP = "</tool_response>"
TOOLS_HEAD = (
    "# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
    "You are provided with function signatures within <tools></tools> XML tags:\n<tools>"
)
TOOLS_FOOT = (
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments "
    "within <tool_call></tool_call> XML tags:\n<tool_call>\n"
    '{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>' + IM_END + "\n"
)

MESSAGE = "struct<role:string,content:string>"


def _text(value) -> Column:
    """A Column for a column name, a Column as it is."""
    return F.col(value) if isinstance(value, str) else value


# --- instruct pairs -------------------------------------------------------------------------------


def instruct_open(description) -> Column:
    return F.concat(F.lit(INST_OPEN), _text(description))


def instruct_full(description, files, allrun) -> Column:
    return F.concat(
        instruct_open(description), F.lit("\n\n" + INST_CLOSE), prompt_label(files, allrun)
    )


def instruct_sections(description, files, allrun) -> Column:
    return F.concat(
        instruct_open(description),
        F.lit("\n\n" + INST_CLOSE + "\nfoamfiles:\n"),
        _text(files),
        F.lit("\n\nallrun:\n"),
        _text(allrun),
    )


def prompt_label(files, allrun) -> Column:
    return F.concat(_text(files), F.lit("\n\n"), _text(allrun))


def instruct_concat(text, answer) -> Column:
    return F.concat(_text(text), F.lit(" " + INST_CLOSE), _text(answer))


def instruct_answer(answer) -> Column:
    return F.concat(F.lit(INST_CLOSE), _text(answer))


# --- message arrays -------------------------------------------------------------------------------


def message(role: str, content) -> Column:
    return F.struct(F.lit(role).alias("role"), _text(content).alias("content"))


def messages3(system, user, assistant) -> Column:
    return F.array(
        message("system", system), message("user", user), message("assistant", assistant)
    )


def messages2(user, assistant) -> Column:
    return F.array(message("user", user), message("assistant", assistant))


def generation_messages(system, user) -> Column:
    return F.array(message("system", system), message("user", user))


def prompt_completion(system, user, assistant) -> Column:
    """``struct(prompt, completion)``: what is given and what is to be learnt."""
    return F.struct(
        generation_messages(system, user).alias("prompt"),
        F.array(message("assistant", assistant)).alias("completion"),
    )


def is_query(role: Column, content: Column) -> Column:
    """A user turn that is not wholly a wrapped tool response."""
    wrapped = F.startswith(content, F.lit(TOOL_RESPONSE_START)) & F.endswith(
        content, F.lit(TOOL_RESPONSE_STOP)
    )
    return (role == "user") & ~F.coalesce(wrapped, F.lit(False))


def whole_context(messages) -> Column:
    """Context of an array that holds its whole conversation."""
    messages = _text(messages)
    queries = F.transform(messages, lambda m, i: F.when(is_query(m.role, m.content), i))
    return F.struct(
        F.lit(True).alias("opens"),
        F.lit(True).alias("closes"),
        F.coalesce(F.array_max(queries), F.size(messages) - 1).alias("last_query_at"),
        F.lit(None).cast("string").alias("prev_role"),
        F.lit(None).cast("string").alias("next_role"),
    )


def _said(value) -> Column:
    return F.coalesce(_text(value), F.lit(""))


def _joined(pieces: Column) -> Column:
    return F.array_join(pieces, "")


def chatml_piece(role, content) -> Column:
    """One message of the ChatML rendering; a null role or content is an empty one."""
    return F.concat(
        F.lit(IM_START), _said(role), F.lit("\n"), _said(content), F.lit(IM_END + "\n")
    )


def chatml_default(opens: Column, first_role: Column) -> Column:
    """The default system turn, for a conversation that does not open with one of its own."""
    default = chatml_piece(F.lit("system"), F.lit(DEFAULT_SYSTEM))
    return F.when(opens & (first_role != "system"), default).otherwise(F.lit(""))


def chatml(messages, generation_prompt: bool = False, context: Column | None = None) -> Column:
    messages = _text(messages)
    context = whole_context(messages) if context is None else context
    first_role = F.get(messages, F.lit(0)).getField("role")
    body = _joined(F.transform(messages, lambda m: chatml_piece(m.role, m.content)))
    parts = [chatml_default(context.opens, first_role), body]
    if generation_prompt:
        tail = F.lit(IM_START + "assistant\n")
        parts.append(F.when(context.closes, tail).otherwise(F.lit("")))
    return F.concat(*parts)


def chatml_tokens(messages) -> Column:
    """``ARRAY<STRUCT<token, learnt>>`` of the rendering: 1 where an assistant speaks.

    Tokens and tags come from the same messages, so they cannot drift apart.
    """

    def one(m: Column) -> Column:
        return F.transform(
            tokens(chatml_piece(m.role, m.content)),
            lambda t, i: F.struct(
                t.alias("token"),
                F.when((m.role == "assistant") & (i > 0), 1).otherwise(0).alias("learnt"),
            ),
        )

    return F.flatten(F.transform(_text(messages), one))


def role_lines(
    messages, bos: str = "", eos: str = "", generation_prompt: bool = False,
    context: Column | None = None,
) -> Column:
    """``{bos}{role}`` and ``{content}{eos}`` on lines of their own.

    The generation prompt of this format is an empty line.
    """
    messages = _text(messages)
    context = whole_context(messages) if context is None else context
    body = _joined(
        F.transform(
            messages,
            lambda m: F.concat(F.lit(bos), _said(m.role), F.lit("\n"), _said(m.content), F.lit(eos + "\n")),
        )
    )
    if not generation_prompt:
        return body
    return F.concat(body, F.when(context.closes, F.lit("\n")).otherwise(F.lit("")))


def append_eos(text, eos: str, closes: Column | None = None) -> Column:
    tail = F.lit(eos) if closes is None else F.when(closes, F.lit(eos)).otherwise(F.lit(""))
    return F.concat(_text(text), tail)


def _tool_calls(m: Column, content: Column, nested: bool) -> Column:
    """The calls of an assistant message: ``tool_calls``, an array of (name, arguments), or of
    structs that hold these two as ``function``."""
    calls = F.coalesce(m.getField("tool_calls"), F.array())

    def one(call: Column, i: Column) -> Column:
        said = call.getField("function") if nested else call
        return F.concat(
            F.when((i > 0) | (content != ""), F.lit("\n")).otherwise(F.lit("")),
            F.lit('<tool_call>\n{"name": "'), said.getField("name"),
            F.lit('", "arguments": '), said.getField("arguments"), F.lit("}\n</tool_call>"),
        )

    return _joined(F.transform(calls, one))


def _assistant_body(
    m: Column, after_query: Column, last: Column, tool_calls: bool, nested_calls: bool,
    reasoning_content: bool,
) -> Column:
    raw = F.coalesce(m.content, F.lit(""))
    marked = F.contains(raw, F.lit(THINK_STOP))
    if reasoning_content:  # a reasoning of its own leaves the content alone
        marked = marked & m.getField("reasoning_content").isNull()
    before = rstrip_newlines(F.substring_index(raw, THINK_STOP, 1))
    reasoning = F.when(
        marked, lstrip_newlines(F.substring_index(before, THINK_START, -1))
    ).otherwise(F.lit(""))
    content = F.when(
        marked, lstrip_newlines(F.substring_index(raw, THINK_STOP, -1))
    ).otherwise(raw)
    if reasoning_content:
        reasoning = F.coalesce(m.getField("reasoning_content"), reasoning)
    thought = F.concat(
        F.lit(THINK_START + "\n"), strip_newlines(reasoning),
        F.lit("\n" + THINK_STOP + "\n\n"), lstrip_newlines(content),
    )
    body = F.when(after_query & (last | (reasoning != "")), thought).otherwise(content)
    return F.concat(body, _tool_calls(m, content, nested_calls)) if tool_calls else body


def reasoning_chat(
    messages, generation_prompt: bool = False, enable_thinking: bool = True,
    tools: Column | None = None, tool_calls: bool = False, context: Column | None = None,
    nested_calls: bool = False, reasoning_content: bool = False,
) -> Column:
    """ChatML that keeps an assistant's reasoning only after the last real user turn.

    ``tools`` is an array of JSON texts and adds the tool list to the opening system turn;
    ``tool_calls`` says that the message structs carry calls, ``nested_calls`` that a call is a
    struct in the field ``function``, ``reasoning_content`` that the reasoning may stand in a field
    of that name instead of the content.
    """
    messages = _text(messages)
    context = whole_context(messages) if context is None else context
    final = F.size(messages) - 1

    def piece(m: Column, i: Column) -> Column:
        content = F.coalesce(m.content, F.lit(""))
        last = context.closes & (i == final)
        # inside the part the neighbour is the next message, at its rim the context names it
        before = F.when(i == 0, context.prev_role).otherwise(
            F.get(messages, i - 1).getField("role")
        )
        after = F.when(i == final, context.next_role).otherwise(
            F.get(messages, i + 1).getField("role")
        )
        opening = (m.role == "system") & context.opens & (i == 0)
        leading = F.lit("") if tools is not None else chatml_piece(m.role, content)
        assistant = _assistant_body(
            m, i > context.last_query_at, last, tool_calls, nested_calls, reasoning_content
        )
        tool = F.concat(
            F.when(F.coalesce(before, F.lit("")) != "tool", F.lit(IM_START + "user"))
            .otherwise(F.lit("")),
            F.lit("\n" + TOOL_RESPONSE_START + "\n"), content,
            F.lit("\n" + TOOL_RESPONSE_STOP),
            F.when(F.coalesce(after, F.lit("")) != "tool", F.lit(IM_END + "\n"))
            .otherwise(F.lit("")),
        )
        return (
            F.when(opening, leading)
            .when(m.role.isin("user", "system"), chatml_piece(m.role, content))
            .when(m.role == "assistant", chatml_piece(m.role, assistant))
            .when(m.role == "tool", tool)
            .otherwise(F.lit(""))
        )

    parts = [_joined(F.transform(messages, piece))]
    if tools is not None:
        first = F.get(messages, F.lit(0))
        own = F.when(
            first.getField("role") == "system",
            F.concat(first.getField("content"), F.lit("\n\n")),
        ).otherwise(F.lit(""))
        listed = _joined(F.transform(tools, lambda t: F.concat(F.lit("\n"), t)))
        head = F.concat(
            F.lit(IM_START + "system\n"), own, F.lit(TOOLS_HEAD), listed, F.lit(TOOLS_FOOT)
        )
        parts.insert(0, F.when(context.opens, head).otherwise(F.lit("")))
    if generation_prompt:
        tail = IM_START + "assistant\n"
        if not enable_thinking:
            tail += f"{THINK_START}\n\n{THINK_STOP}\n\n"
        parts.append(F.when(context.closes, F.lit(tail)).otherwise(F.lit("")))
    return F.concat(*parts)
