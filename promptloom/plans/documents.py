"""Case documents over the conversations: a case per conversation, a role is a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions import text as X
from promptloom.operators import cases as C
from promptloom.plans.registry import query, table

_KEYS = ["conv_id", "volume"]


def case_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``conv_id, volume, files, document`` of every conversation."""
    turns = table(spark, folder, "conversations")
    rows = C.gather_cases(turns, "conv_id", "role", "turn", "turn", "text")
    meta = [
        F.concat(F.lit("case "), F.col("conv_id").cast("string")), F.lit("dialogue"),
        F.get("files", F.lit(0)).getField("folder"),
        F.element_at("files", -1).getField("folder"),
    ]
    return rows.withColumn("document", C.case_document(meta))


_CASES_SQL = """
    kept AS (SELECT *, turn // 256 AS volume FROM conversations),
    dirs AS (SELECT conv_id, volume, role, min(turn) AS loc,
        '<dir>directory name: ' || role || '. File names in this directory: ['
            || string_agg(CAST(turn AS VARCHAR), ', ' ORDER BY turn) || ']</dir>' || chr(10)
            AS listing,
        '<directory_begin>directory name: ' || role || chr(10)
            || string_agg('<file_begin>file name: ' || turn || chr(10) || '<file_content>'
                || chr(10) || text || chr(10) || '</file_content>' || chr(10) || '</file_end>'
                || chr(10) || chr(10), '' ORDER BY turn)
            || '</directory_end>' || chr(10) || chr(10) AS body
        FROM kept GROUP BY conv_id, volume, role),
    heads AS (SELECT conv_id, volume, arg_min(role, turn) AS first_role,
        arg_max(role, turn) AS last_role, count(*) AS n_files FROM kept GROUP BY conv_id, volume),
    docs AS (SELECT conv_id, volume, any_value(first_role) AS first_role,
        any_value(last_role) AS last_role, any_value(n_files) AS n_files, count(*) AS n_folders,
        string_agg(listing, '' ORDER BY loc) AS listing,
        '<similar_case_reference><index>' || chr(10) || 'case name: case ' || conv_id || chr(10)
            || 'case domain: dialogue' || chr(10) || 'case category: ' || any_value(first_role)
            || chr(10) || 'case solver: ' || any_value(last_role) || chr(10) || '</index>'
            || chr(10) || chr(10) || chr(10) || '<directory_structure>' || chr(10)
            || string_agg(listing, '' ORDER BY loc) || '</directory_structure>' || chr(10)
            || chr(10) || chr(10) || '<tutorials>' || chr(10)
            || string_agg(body, '' ORDER BY loc) || '</tutorials></similar_case_reference>'
            AS document
        FROM dirs JOIN heads USING (conv_id, volume) GROUP BY conv_id, volume)"""


@query("case_document", f"WITH {_CASES_SQL} SELECT conv_id, volume, document FROM docs")
def case_document(spark: SparkSession, folder: str) -> DataFrame:
    return case_rows(spark, folder).select(*_KEYS, "document")


@query("case_parse", f"""
    WITH {_CASES_SQL}
    SELECT conv_id, volume, CAST(row_number() OVER (PARTITION BY conv_id, volume ORDER BY loc, turn)
        AS INTEGER) - 1 AS pos, role AS folder, CAST(turn AS VARCHAR) AS file, text AS content
    FROM kept JOIN dirs USING (conv_id, volume, role)""")
def case_parse(spark: SparkSession, folder: str) -> DataFrame:
    return C.case_parse(case_rows(spark, folder), _KEYS, "document")


@query("case_index", f"""
    WITH {_CASES_SQL}
    SELECT conv_id, volume, 'case ' || conv_id AS case_name, 'dialogue' AS case_domain,
        first_role AS case_category, last_role AS case_solver, n_folders,
        replace(replace(rtrim(listing, chr(10)), '<dir>directory name: ', ''),
            '. File names in this directory: [', ': ') AS listing
    FROM docs""")
def case_index(spark: SparkSession, folder: str) -> DataFrame:
    listing = C.parse_listing("document")
    lines = F.transform(
        "_l", lambda d: F.concat(d.folder, F.lit(": "), F.array_join(d.files, ", "), F.lit("]</dir>"))
    )
    return (
        case_rows(spark, folder)
        .select(*_KEYS, *C.parse_index("document"), listing.alias("_l"))
        .withColumn("n_folders", F.size("_l").cast("bigint"))
        .withColumn("listing", F.array_join(lines, "\n"))
        .drop("_l")
    )


@query("case_consistency", f"""
    WITH {_CASES_SQL}
    SELECT conv_id, volume, n_files AS listed, n_files AS parsed, '' AS missing, '' AS extra
    FROM heads""")
def case_consistency(spark: SparkSession, folder: str) -> DataFrame:
    checked = case_rows(spark, folder).select(*_KEYS, C.consistency("document").alias("_c"))
    return checked.select(
        *_KEYS, "_c.listed", "_c.parsed", F.array_join("_c.missing", " ").alias("missing"),
        F.array_join("_c.extra", " ").alias("extra"),
    )


def _text_sql(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("ablation_pair", f"""
    WITH {_CASES_SQL},
    asked AS (SELECT conv_id, arg_min(text, turn) AS requirement
        FROM kept WHERE role = 'user' GROUP BY conv_id)
    SELECT conv_id, volume, 'with_reference' AS variant, {_text_sql(C.REQUIREMENT)} || requirement
        || {_text_sql(C.REFER)} || document || {_text_sql(C.TRUST_REFERENCE + C.CLOSING)} AS prompt
    FROM docs JOIN asked USING (conv_id)
    UNION ALL
    SELECT conv_id, volume, 'without_reference', {_text_sql(C.REQUIREMENT)} || requirement
        || {_text_sql(chr(10) + C.CLOSING)}
    FROM docs JOIN asked USING (conv_id)""")
def ablation_pair(spark: SparkSession, folder: str) -> DataFrame:
    """The requirement is the conversation's first user turn, in whichever volume it stands."""
    said = table(spark, folder, "conversations").filter(F.col("role") == "user")
    asked = said.groupBy("conv_id").agg(F.min_by("text", "turn").alias("requirement"))
    rows = case_rows(spark, folder).join(asked.filter(F.col("requirement").isNotNull()), "conv_id")
    return C.ablation_pair(rows, _KEYS, F.col("requirement"), F.col("document"))


_MARKED_SQL = """SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0
        THEN text || ' <file_begin> </file_content>' ELSE text END AS text FROM conversations"""


def marked_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The conversations with the format's own markup in every third turn."""
    markup = F.concat("text", F.lit(" <file_begin> </file_content>"))
    return table(spark, folder, "conversations").withColumn(
        "text", F.when(F.col("turn") % 3 == 0, markup).otherwise(F.col("text"))
    )


@query("unwritable_files", f"""
    SELECT conv_id, turn FROM ({_MARKED_SQL}) WHERE contains(text, '</file_content>')
        OR contains(text, '<file_begin>') OR contains(text, '<directory_begin>')""")
def unwritable_files(spark: SparkSession, folder: str) -> DataFrame:
    """The rows whose text ``case_document`` has to escape."""
    return marked_turns(spark, folder).filter(~C.writable("text")).select("conv_id", "turn")


@query("escaped_round_trip", f"""
    SELECT conv_id, role || ', [' || turn || ']' AS file, text AS content FROM ({_MARKED_SQL})""")
def escaped_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with markup, and names with the marks of a listing, come back from a document."""
    turns = marked_turns(spark, folder).withColumn(
        "name", F.concat("role", F.lit(", ["), "turn", F.lit("]"))
    )
    rows = C.gather_cases(turns, "conv_id", "role", "name", "turn", "text")
    rows = rows.withColumn("document", C.case_document([F.lit("m\n, n")] * 4))
    return C.case_parse(rows, _KEYS, "document").select("conv_id", "file", "content")


@query("broken_consistency", """
    SELECT conv_id, turn // 256 AS volume, count(*) AS listed,
        count(*) - CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) > 0 AS INTEGER) AS parsed,
        coalesce('user/' || min(CASE WHEN role = 'user' THEN turn END), '') AS missing
    FROM conversations GROUP BY 1, 2""")
def broken_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose first user file has lost its body: the check has to name it."""
    lost = F.regexp_replace(
        "document", "(?s)(<directory_begin>directory name: user\n)<file_begin>.*?</file_end>\n\n", "$1"
    )
    broken = case_rows(spark, folder).select(*_KEYS, C.consistency(lost).alias("_c"))
    return broken.select(*_KEYS, "_c.listed", "_c.parsed", F.array_join("_c.missing", " ").alias("missing"))


def _count_sql(needle: str) -> str:
    return f"(length(html) - length(replace(html, '{needle}', ''))) // {len(needle)}"


@query("file_sanity", f"""
    SELECT page_id, starts_with(html, '<!DOCTYPE html>') AS has_header,
        {_count_sql('<')} - {_count_sql('>')} AS angle_balance,
        {_count_sql('{')} - {_count_sql('}')} AS brace_balance,
        {_count_sql('<p>')} AS paragraphs, {_count_sql('"')} % 2 = 0 AS quotes_paired FROM pages""")
def file_sanity(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id", F.startswith("html", F.lit("<!DOCTYPE html>")).alias("has_header"),
        X.balance("html", "<", ">").alias("angle_balance"),
        X.balance("html", "{", "}").alias("brace_balance"),
        X.occurrences("html", "<p>").alias("paragraphs"),
        (X.occurrences("html", '"') % 2 == 0).alias("quotes_paired"),
    )


_HEADED_SQL = """SELECT conv_id, turn, role, text, CASE WHEN turn % 2 = 0 THEN 'FoamFile' || chr(10)
        || '{ version 2; object ' || role || '; }' || chr(10) || text
    ELSE 'FoamFile' || chr(10) || '{ version 2; }' || chr(10) || '( object ' || role || ';' || text END AS file
    FROM conversations"""


# the first place where depth and kind do not fit, from running sums over the brackets outside strings and comments
_NESTING_SQL = r"""
    pieces AS (SELECT conv_id, turn, regexp_extract_all(file,
        '(?s)"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/|[(){}\[\]]|[^"/(){}\[\]]+|["/]') AS p FROM files),
    numbered AS (SELECT conv_id, turn, k, p[k] AS piece FROM (SELECT conv_id, turn, p, unnest(range(1, len(p) + 1)) AS k FROM pieces)),
    placed AS (SELECT conv_id, turn, piece, sum(length(piece)) OVER (PARTITION BY conv_id, turn ORDER BY k) - length(piece) + 1 AS pos FROM numbered),
    marks AS (SELECT *, CASE WHEN piece IN ('(', '{', '[') THEN 1 ELSE -1 END AS d, CASE WHEN piece IN ('(', ')') THEN 1 WHEN piece IN ('{', '}') THEN 2
        ELSE 3 END AS kind FROM placed WHERE piece IN ('(', ')', '{', '}', '[', ']')),
    deep AS (SELECT *, sum(d) OVER (PARTITION BY conv_id, turn ORDER BY pos) + CASE WHEN d < 0 THEN 1 ELSE 0 END AS level FROM marks),
    beside AS (SELECT *, lag(kind) OVER (PARTITION BY conv_id, turn, level ORDER BY pos) AS before,
        lead(pos) OVER (PARTITION BY conv_id, turn, level ORDER BY pos) AS after FROM deep),
    broken AS (SELECT conv_id, turn, coalesce(min(CASE WHEN d < 0 AND (level < 1 OR before <> kind) THEN pos END),
        min(CASE WHEN d > 0 AND after IS NULL THEN pos END)) AS breaks_at FROM beside GROUP BY conv_id, turn)"""


@query("file_checks", f"""
    WITH files AS ({_HEADED_SQL}), {_NESTING_SQL}
    SELECT f.conv_id, f.turn, true AS has_header, f.turn % 2 = 0 AND f.role = 'user' AS object_matches,
        b.breaks_at IS NULL AS balanced, CAST(b.breaks_at AS INTEGER) AS breaks_at
    FROM files f LEFT JOIN broken b ON f.conv_id = b.conv_id AND f.turn = b.turn""")
def file_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as generated files; in every other one the object stands outside the head block."""
    headed = F.concat(F.lit("FoamFile\n{ version 2; object "), "role", F.lit("; }\n"), "text")
    bare = F.concat(F.lit("FoamFile\n{ version 2; }\n( object "), "role", F.lit(";"), "text")
    checks = X.file_checks(F.when(F.col("turn") % 2 == 0, headed).otherwise(bare), F.lit("user"))
    return table(spark, folder, "conversations").select("conv_id", "turn", checks.alias("_c")).select(
        "conv_id", "turn", "_c.*"
    )


@query("quoted_values", """
    SELECT doc_id, array_to_string(regexp_extract_all('use ''ok'' or ''' || lang || ' ''', '''([A-Za-z]+)''', 1), ' ')
        || array_to_string(regexp_extract_all(', ''' || lang || '''', '''([A-Za-z]+)''', 1), ' ') AS allowed
    FROM documents""")
def quoted_values(spark: SparkSession, folder: str) -> DataFrame:
    first = F.concat(F.lit("use 'ok' or '"), "lang", F.lit(" '"))
    second = F.concat(F.lit(", '"), "lang", F.lit("'"))
    lists = [F.array_join(X.quoted_values(prompt), " ") for prompt in (first, second)]
    return table(spark, folder, "documents").select("doc_id", F.concat(*lists).alias("allowed"))
