"""Prompt building and text checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions import templates as P
from promptloom.functions import text as X
from promptloom.operators.messages import gather_messages, with_opening
from promptloom.plans.corpus import PAIRS_SQL, page_links, paired
from promptloom.plans.registry import query, table

EOS_TEXT = "<|endoftext|>"
_KEYS = ["conv_id", "turn"]


def _allrun() -> Column:
    return F.concat(F.lit("turn "), F.col("turn").cast("string"))


def _instruct(expression: str) -> str:
    return f"SELECT conv_id, turn, {expression} FROM ({PAIRS_SQL})"


@query("instruct_open", _instruct("'<s>[INST] ' || prompt AS text"))
def instruct_open(spark: SparkSession, folder: str) -> DataFrame:
    return paired(spark, folder).select(*_KEYS, P.instruct_open("prompt").alias("text"))


@query("instruct_full", _instruct("""'<s>[INST] ' || prompt || chr(10) || chr(10) || '[/INST] '
    || answer || chr(10) || chr(10) || 'turn ' || turn AS text"""))
def instruct_full(spark: SparkSession, folder: str) -> DataFrame:
    text = P.instruct_full("prompt", "answer", _allrun())
    return paired(spark, folder).select(*_KEYS, text.alias("text"))


@query("instruct_sections", _instruct("""'<s>[INST] ' || prompt || chr(10) || chr(10) || '[/INST] '
    || chr(10) || 'foamfiles:' || chr(10) || answer || chr(10) || chr(10) || 'allrun:' || chr(10)
    || 'turn ' || turn AS text"""))
def instruct_sections(spark: SparkSession, folder: str) -> DataFrame:
    text = P.instruct_sections("prompt", "answer", _allrun())
    return paired(spark, folder).select(*_KEYS, text.alias("text"))


@query("prompt_label", _instruct(
    "prompt AS text, answer || chr(10) || chr(10) || 'turn ' || turn AS label"))
def prompt_label(spark: SparkSession, folder: str) -> DataFrame:
    label = P.prompt_label("answer", _allrun())
    return paired(spark, folder).select(*_KEYS, F.col("prompt").alias("text"), label.alias("label"))


@query("instruct_concat", _instruct(
    "prompt || ' [/INST] ' || answer AS text, '[/INST] ' || answer AS labels"))
def instruct_concat(spark: SparkSession, folder: str) -> DataFrame:
    return paired(spark, folder).select(
        *_KEYS, P.instruct_concat("prompt", "answer").alias("text"),
        P.instruct_answer("answer").alias("labels"),
    )


# --- message arrays -------------------------------------------------------------------------------

CHAT_SQL = f"""
    SELECT p.conv_id, p.turn, prompt, answer, CASE WHEN f.role = 'system' THEN f.text
        ELSE '{P.DEFAULT_SYSTEM}' END AS system
    FROM ({PAIRS_SQL}) p JOIN (SELECT conv_id, arg_min(role, turn) AS role,
        arg_min(text, turn) AS text FROM conversations GROUP BY conv_id) f USING (conv_id)"""


def _sql_messages(*parts: tuple[str, str]) -> str:
    structs = ", ".join(f"{{'role': '{role}', 'content': {text}}}" for role, text in parts)
    return f"CAST(to_json([{structs}]) AS VARCHAR)"


def chat_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """System, user and assistant text of every answered turn."""
    turns = table(spark, folder, "conversations")
    return with_opening(paired(spark, folder), turns, "conv_id", "turn", "role", "text")


@query("messages3", f"""
    SELECT conv_id, turn, {_sql_messages(('system', 'system'), ('user', 'prompt'),
                                         ('assistant', 'answer'))} AS messages
    FROM ({CHAT_SQL})""")
def messages3(spark: SparkSession, folder: str) -> DataFrame:
    messages = P.messages3("system", "prompt", "answer")
    return chat_corpus(spark, folder).select(*_KEYS, F.to_json(messages).alias("messages"))


@query("prompt_completion", f"""
    SELECT conv_id, turn, {_sql_messages(('system', 'system'), ('user', 'prompt'))} AS prompt,
        {_sql_messages(('assistant', 'answer'))} AS completion FROM ({CHAT_SQL})""")
def prompt_completion(spark: SparkSession, folder: str) -> DataFrame:
    split = P.prompt_completion("system", "prompt", "answer")
    rows = chat_corpus(spark, folder).select(*_KEYS, split.alias("_s"))
    return rows.select(
        *_KEYS, F.to_json("_s.prompt").alias("prompt"),
        F.to_json("_s.completion").alias("completion"),
    )


def _sql_piece(role: str, text: str) -> str:
    return f"'<|im_start|>' || {role} || chr(10) || {text} || '<|im_end|>' || chr(10)"


@query("chat_triples", f"""
    SELECT conv_id, turn, {_sql_piece("'system'", 'system')} || {_sql_piece("'user'", 'prompt')}
        || {_sql_piece("'assistant'", 'answer')} AS text,
        {_sql_piece("'system'", 'system')} || {_sql_piece("'user'", 'prompt')}
        || '<|im_start|>assistant' || chr(10) AS generation
    FROM ({CHAT_SQL})""")
def chat_triples(spark: SparkSession, folder: str) -> DataFrame:
    """The three-message form, and the two-message form a model is asked with."""
    return chat_corpus(spark, folder).select(
        *_KEYS, P.chatml(P.messages3("system", "prompt", "answer")).alias("text"),
        P.chatml(P.generation_messages("system", "prompt"), generation_prompt=True)
        .alias("generation"),
    )


@query("chat_pairs", f"""
    SELECT conv_id, turn, {_sql_piece("'system'", "'" + P.DEFAULT_SYSTEM + "'")}
        || {_sql_piece("'user'", 'prompt')} || {_sql_piece("'assistant'", 'answer')} AS text
    FROM ({PAIRS_SQL})""")
def chat_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The two-message form; the template adds the default system turn."""
    text = P.chatml(P.messages2("prompt", "answer"))
    return paired(spark, folder).select(*_KEYS, text.alias("text"))


# --- whole conversations --------------------------------------------------------------------------


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return gather_messages(table(spark, folder, "conversations"), "conv_id", "turn")


# one row per message; `first` and `last` are the conversation's own
_PARTS_SQL = """SELECT *, turn AS part, min(turn) OVER (PARTITION BY conv_id) AS first,
    max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations"""
CHATML_SQL = f"""
    SELECT conv_id, part, string_agg(CASE WHEN turn = first AND role <> 'system'
            THEN {_sql_piece("'system'", "'" + P.DEFAULT_SYSTEM + "'")} ELSE '' END
        || {_sql_piece('role', 'text')}, '' ORDER BY turn) AS text, max(turn) = any_value(last) AS closes
    FROM ({_PARTS_SQL}) GROUP BY conv_id, part"""


@query("chatml", f"SELECT conv_id, part, text FROM ({CHATML_SQL})")
def chatml(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(spark, folder).select(
        "conv_id", "part", P.chatml("messages", context=F.col("context")).alias("text")
    )


@query("role_lines", f"""
    SELECT conv_id, part, string_agg('<s>' || role || chr(10) || text || '</s>' || chr(10), ''
        ORDER BY turn) || CASE WHEN max(turn) = any_value(last) THEN chr(10) ELSE '' END AS text
    FROM ({_PARTS_SQL}) GROUP BY conv_id, part""")
def role_lines(spark: SparkSession, folder: str) -> DataFrame:
    text = P.role_lines(
        "messages", bos="<s>", eos="</s>", generation_prompt=True, context=F.col("context")
    )
    return conversations(spark, folder).select("conv_id", "part", text.alias("text"))


_REASONING_SQL = """
    WITH ends AS (SELECT conv_id, max(turn) AS last,
            coalesce(max(CASE WHEN role = 'user' THEN turn END), max(turn)) AS query
        FROM conversations GROUP BY conv_id),
    told AS (SELECT *, {content} AS content, {reasoning} AS reasoning
        FROM conversations JOIN ends USING (conv_id)),
    bodies AS (SELECT *, CASE WHEN role = 'assistant' AND turn > query
            AND (turn = last OR reasoning <> '')
        THEN '<think>' || chr(10) || trim(reasoning, chr(10)) || chr(10) || '</think>' || chr(10)
            || chr(10) || ltrim(content, chr(10)) ELSE content END AS body FROM told)
    SELECT conv_id, turn AS part, string_agg('<|im_start|>' || role || chr(10) || body
        || '<|im_end|>' || chr(10), '' ORDER BY turn) || CASE WHEN max(turn) = any_value(last)
        THEN '<|im_start|>assistant' || chr(10) ELSE '' END AS text
    FROM bodies GROUP BY conv_id, turn"""


@query("reasoning_chat", _REASONING_SQL.format(content="text", reasoning="''"))
def reasoning_chat(spark: SparkSession, folder: str) -> DataFrame:
    text = P.reasoning_chat("messages", generation_prompt=True, context=F.col("context"))
    return conversations(spark, folder).select("conv_id", "part", text.alias("text"))


@query("reasoning_history", _REASONING_SQL.format(
    content="""CASE WHEN role = 'assistant' AND contains(text, '. ')
        THEN ltrim(string_split(text, '. ')[-1], chr(10)) ELSE text END""",
    reasoning="""CASE WHEN role = 'assistant' AND contains(text, '. ')
        THEN ltrim(rtrim(string_split(text, '. ')[1], chr(10)), chr(10)) ELSE '' END"""))
def reasoning_history(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence ends of the assistant stand for the end of its reasoning."""
    turns = table(spark, folder, "conversations").withColumn(
        "text",
        F.when(F.col("role") == "assistant", X.replace_map("text", {". ": P.THINK_STOP}))
        .otherwise(F.col("text")),
    )
    text = P.reasoning_chat("messages", generation_prompt=True, context=F.col("context"))
    return gather_messages(turns, "conv_id", "turn").select("conv_id", "part", text.alias("text"))


@query("append_eos", f"""
    SELECT conv_id, part, text || CASE WHEN closes THEN '{EOS_TEXT}' ELSE '' END AS text
    FROM ({CHATML_SQL})""")
def append_eos(spark: SparkSession, folder: str) -> DataFrame:
    text = P.chatml("messages", context=F.col("context"))
    return conversations(spark, folder).select(
        "conv_id", "part", P.append_eos(text, EOS_TEXT, F.col("context.closes")).alias("text")
    )


# --- text -----------------------------------------------------------------------------------------


@query("split_thinking", """
    WITH cut AS (SELECT doc_id, text, string_split(text, '. ')[-1] AS tail FROM documents)
    SELECT doc_id, trim(left(text, length(text) - length(tail)), chr(10)) AS thinking,
        trim(tail, chr(10)) AS content FROM cut""")
def split_thinking(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id", X.split_thinking("text", ". ").alias("_s")
    )
    return docs.select("doc_id", "_s.thinking", "_s.content")


@query("marker_split", """
    SELECT page_id, replace(string_split(html, '<body>')[1], '<!DOCTYPE html>', '') AS head,
        string_split(html, '<body>')[2] AS tail FROM pages""")
def marker_split(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(
        "page_id", X.marker_split("html", "<body>", "<!DOCTYPE html>").alias("_s")
    )
    return pages.select("page_id", "_s.head", "_s.tail")


@query("replace_map", """
    SELECT doc_id, replace(replace(text, ' the ', ' THE '), 'é', 'e') AS text FROM documents""")
def replace_map(spark: SparkSession, folder: str) -> DataFrame:
    text = X.replace_map("text", {" the ": " THE ", "é": "e"})
    return table(spark, folder, "documents").select("doc_id", text.alias("text"))


@query("strip_newlines", "SELECT doc_id, trim(text, chr(10)) AS text FROM documents")
def strip_newlines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", X.strip_newlines("text").alias("text"))


@query("tag_extract", """
    SELECT page_id,
        CASE WHEN regexp_matches(html, '<title>([^<]*)</title>')
            THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title,
        CASE WHEN regexp_matches(html, 'lang="([^"]*)"')
            THEN regexp_extract(html, 'lang="([^"]*)"', 1) END AS lang
    FROM pages""")
def tag_extract(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id", X.tag_value("html", "<title>([^<]*)</title>").alias("title"),
        X.tag_value("html", 'lang="([^"]*)"').alias("lang"),
    )


_SECTIONS = ["<title>", "<nav>", "<article>", "<table>", "<form", "<footer>", "</html>"]


@query("missing_sections", f"""
    SELECT page_id, array_to_string(missing, ' ') AS missing, len(missing) AS n_missing
    FROM (SELECT page_id, list_filter({_SECTIONS}, lambda s: NOT contains(html, s)) AS missing
        FROM pages)""")
def missing_sections(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(
        "page_id", X.missing_from("html", _SECTIONS).alias("_m")
    )
    return pages.select(
        "page_id", F.array_join("_m", " ").alias("missing"),
        F.size("_m").cast("bigint").alias("n_missing"),
    )


@query("allowed_values", """
    SELECT page_id, len(allowed) AS n_allowed, list_contains(allowed, own) AS is_allowed
    FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS allowed,
        '/' || regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS own FROM pages)""")
def allowed_values(spark: SparkSession, folder: str) -> DataFrame:
    own = F.concat(F.lit("/"), X.path_leaf("url"))
    pages = table(spark, folder, "pages").select(
        "page_id", page_links().alias("_allowed"), own.alias("_own")
    )
    return pages.select(
        "page_id", F.size("_allowed").cast("bigint").alias("n_allowed"),
        F.array_contains("_allowed", F.col("_own")).alias("is_allowed"),
    )
