"""Row-local text expressions.  All stay on the JVM side; none needs a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The strings a data-frame CSV reader takes for a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# What separates the two prompts of a probe file.
SYSTEM_MARK = "code system prompt:\n"
USER_MARK = "code user prompt:\n"

# The mis-decoded dash of the probe files and its repair.
DASH_REPAIR = {"codeâ€”no": "code-no"}

THINK_END = "</think>"
_NL = "\n"


def literal(text: str) -> str:
    """``text`` as a regular expression that matches only itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def tokens(text) -> Column:
    """Whitespace-delimited tokens, in order, without empty strings."""
    return F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda t: t != "")


def strip_newlines(text) -> Column:
    return F.btrim(text, F.lit(_NL))


def lstrip_newlines(text) -> Column:
    return F.ltrim(text, F.lit(_NL))


def rstrip_newlines(text) -> Column:
    return F.rtrim(text, F.lit(_NL))


def split_thinking(text, marker: str = THINK_END) -> Column:
    """``struct(thinking, content)``, cut right after the last ``marker``.

    Without a marker everything is content.  Both sides lose surrounding newlines only.
    """
    text = F.col(text) if isinstance(text, str) else text
    content = F.substring_index(text, marker, -1)
    thinking = F.substr(text, F.lit(1), F.length(text) - F.length(content))
    return F.struct(
        strip_newlines(thinking).alias("thinking"), strip_newlines(content).alias("content")
    )


def marker_split(text, second: str = USER_MARK, first: str = SYSTEM_MARK) -> Column:
    """``struct(head, tail)`` around ``second``; ``first`` is removed from the head.

    A missing ``second`` gives a null tail, and text after a repeated one is left out.
    """
    parts = F.split(text, literal(second))
    return F.struct(
        F.replace(F.get(parts, F.lit(0)), F.lit(first), F.lit("")).alias("head"),
        F.get(parts, F.lit(1)).alias("tail"),
    )


def replace_map(text, repairs: dict[str, str] | None = None) -> Column:
    """Literal replacements, applied in the order given."""
    out = F.col(text) if isinstance(text, str) else text
    for old, new in (DASH_REPAIR if repairs is None else repairs).items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def missing_from(text, names: list[str]) -> Column:
    """The ``names`` that do not occur in ``text``, in the order given."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.array(*[F.lit(n) for n in names]), lambda n: ~F.contains(text, n))


def missing_paths(paths, names: list[str]) -> Column:
    """The ``names`` not among ``paths``."""
    return F.array_except(F.array(*[F.lit(n) for n in names]), paths)


def quoted_values(text, pattern: str = "'([A-Za-z]+)'") -> Column:
    """All values a prompt lists in quotes."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def tag_value(text, pattern: str) -> Column:
    """First group of ``pattern``, null when the text does not hold it."""
    found = F.regexp_extract(text, pattern, 1)
    return F.when(F.regexp_like(text, F.lit(pattern)), found)


def path_join(*parts) -> Column:
    return F.concat_ws("/", *parts)


def path_folder(path) -> Column:
    """Name of the directory right above the last path segment."""
    return F.regexp_extract(path, "([^/]+)/[^/]*$", 1)


def path_leaf(path) -> Column:
    """Last path segment, without query or fragment."""
    return F.regexp_extract(path, "([^/?#]*)(?:[?#].*)?$", 1)


def url_host(url) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)


def json_map(text) -> Column:
    """The text of a JSON object as ``MAP<STRING,STRING>``."""
    return F.from_json(text, "map<string,string>")


def occurrences(text, needle: str) -> Column:
    """How often ``needle`` occurs, without overlaps."""
    text = F.col(text) if isinstance(text, str) else text
    gone = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return F.floor(gone / F.lit(len(needle))).cast("bigint")


def balance(text, opening: str, closing: str) -> Column:
    """Openings minus closings; 0 for a balanced text."""
    return occurrences(text, opening) - occurrences(text, closing)


# strings and comments, which hide brackets, then brackets, then whatever lies between
_PIECES = r'(?s)"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/|[(){}\[\]]|[^"/(){}\[\]]+|["/]'
_OPENINGS, _CLOSINGS = "({[", ")}]"


def nesting(text) -> Column:
    """``struct(balanced, breaks_at)``: whether every bracket is closed by one of its kind, in order.

    ``breaks_at`` is the character (from 1) of the first closing bracket that closes nothing or another kind, else of the
    first opening one that is never closed, else null.  Brackets in strings and comments do not count; a quote or comment
    that does not end hides nothing.  A null text has nulls.
    """
    text = F.col(text) if isinstance(text, str) else text
    start = F.struct(
        F.lit(1).alias("at"), F.lit("").alias("kinds"), F.array().cast("array<int>").alias("places"), F.lit(None).cast("int").alias("bad")
    )

    def step(state: Column, piece: Column) -> Column:
        opening, closing = F.position(piece, F.lit(_OPENINGS)), F.position(piece, F.lit(_CLOSINGS))
        one = F.length(piece) == 1
        opens, closes = one & (opening > 0), one & (closing > 0)
        kinds, places = state.getField("kinds"), state.getField("places")
        fits = (F.length(kinds) > 0) & (F.right(kinds, F.lit(1)) == F.substring(F.lit(_OPENINGS), closing, F.lit(1)))
        shorter = F.size(places) - 1
        return F.struct(
            (state.getField("at") + F.length(piece)).alias("at"),
            F.when(opens, F.concat(kinds, piece)).when(closes & fits, F.left(kinds, shorter)).otherwise(kinds).alias("kinds"),
            F.when(opens, F.array_append(places, state.getField("at"))).when(closes & fits, F.slice(places, F.lit(1), shorter)).otherwise(places).alias("places"),
            F.coalesce(state.getField("bad"), F.when(closes & ~fits, state.getField("at"))).alias("bad"),
        )

    pieces = F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))
    return F.aggregate(
        pieces, start, step,
        lambda end: F.struct(
            (end.getField("bad").isNull() & (end.getField("kinds") == "")).alias("balanced"),
            F.coalesce(end.getField("bad"), F.get(end.getField("places"), F.lit(0))).alias("breaks_at"),
        ),
    )


# The head block that opens a generated file, and the line that names the file.
HEADER_BLOCK = "(?s)FoamFile\\s*\\{.*?\\}"
HEADER_OBJECT = "(?s)FoamFile\\s*\\{[^}]*?object\\s+([^;\\s}]+)\\s*;"


def file_checks(text, name) -> Column:
    """``struct(has_header, object_matches, balanced, breaks_at)`` of a generated file's text."""
    text = F.col(text) if isinstance(text, str) else text
    name = F.col(name) if isinstance(name, str) else name
    nested = nesting(text)
    return F.struct(
        F.regexp_like(text, F.lit(HEADER_BLOCK)).alias("has_header"),
        (F.regexp_extract(text, HEADER_OBJECT, 1) == name).alias("object_matches"),
        nested.getField("balanced").alias("balanced"), nested.getField("breaks_at").alias("breaks_at"),
    )
