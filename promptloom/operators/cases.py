"""Case documents: the files of a case as markup inside a prompt, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The markup of a case document and the sentences around it.
DOC_OPEN = "<similar_case_reference><index>\n"
META_NAMES = ["case name", "case domain", "case category", "case solver"]
INDEX_CLOSE = "</index>\n\n\n<directory_structure>\n"
LISTING_DIR = "<dir>directory name: "
LISTING_FILES = ". File names in this directory: ["
LISTING_END = "]</dir>\n"
LISTING_CLOSE = "</directory_structure>\n\n\n<tutorials>\n"
DIR_BEGIN = "<directory_begin>directory name: "
FILE_BEGIN = "<file_begin>file name: "
CONTENT_BEGIN = "\n<file_content>\n"
CONTENT_END = "\n</file_content>\n</file_end>\n\n"
DIR_END = "</directory_end>\n\n"
DOC_CLOSE = "</tutorials></similar_case_reference>"
REQUIREMENT = "User requirement: "
REFER = (
    "\nRefer to the following similar case file content to ensure the generated file aligns "
    "with the user requirement:\n"
)
TRUST_REFERENCE = (
    "\nSimilar case reference is always correct. If you find the user requirement is very "
    "consistent with the similar case reference, you should use the similar case reference as the "
    "template to generate the file.Just modify the necessary parts to make the file complete and "
    "functional."
)
CLOSING = (
    "Please ensure that the generated file is complete, functional, and logically sound."
    "Additionally, apply your domain expertise to verify that all numerical values are consistent "
    "with the user's requirements, maintaining accuracy and coherence."
)

# A text that holds one of these is escaped: a backslash goes behind the `<`, and behind those that
# stand there already, so every text can be put into a document and comes back as it was.
RESERVED = ["</file_content>", "<file_begin>", "<directory_begin>"]
VOLUME = 256
_TAGS = "(" + "|".join(tag[1:] for tag in RESERVED) + ")"
# Marks of a listing and line breaks, as they are written in names; the backslash comes first.
_NAME_MARKS = {"\\": "\\b", "\n": "\\n", "\r": "\\r", "<": "\\l", ",": "\\c", "[": "\\o", "]": "\\k"}
_META_MARKS = {"\\": "\\b", "\n": "\\n", "\r": "\\r", "<": "\\l"}


def escape_text(content: Column) -> Column:
    return F.regexp_replace(content, "<(\\\\*)" + _TAGS, "<$1\\\\$2")


def unescape_text(content: Column) -> Column:
    return F.regexp_replace(content, "<\\\\(\\\\*)" + _TAGS, "<$1$2")


def escape_name(name: Column, marks: dict[str, str] = _NAME_MARKS) -> Column:
    for mark, written in marks.items():
        name = F.replace(name, F.lit(mark), F.lit(written))
    return name


def unescape_name(name: Column, marks: dict[str, str] = _NAME_MARKS) -> Column:
    for mark, written in reversed(marks.items()):
        name = F.replace(name, F.lit(written), F.lit(mark))
    return name


def writable(content) -> Column:
    """Whether a file's text can stand in a document without being escaped."""
    content = F.col(content) if isinstance(content, str) else content
    clash = F.lit(False)
    for tag in RESERVED:
        clash = clash | F.contains(content, F.lit(tag))
    return ~clash


def gather_cases(
    df: DataFrame, key: str, folder: str, file: str, order: str, content: str, most: int = VOLUME
) -> DataFrame:
    """``key, volume, files`` with at most ``most`` files in a row, in order.

    ``order`` is an integer, unique inside a case.  A case with more files comes in several volumes,
    each a complete document, so a row is bounded whatever the case holds.  Null texts and names
    become empty ones.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    entry = F.struct(
        F.col(order).alias("at"), said(folder).alias("folder"), said(file).alias("file"),
        said(content).alias("content"),
    )
    return df.groupBy(key, F.floor(F.col(order) / most).alias("volume")).agg(
        F.array_sort(F.collect_list(entry)).alias("files")
    )


def case_document(meta: list[Column], files="files") -> Column:
    """The document of one row's files; folders in the order they first occur.

    Markup in texts, and marks of the format in names, are escaped.
    """
    files = F.transform(
        files,
        lambda f: F.struct(
            escape_name(f.folder).alias("folder"), escape_name(f.file).alias("file"),
            escape_text(f.content).alias("content"),
        ),
    )
    folders = F.array_distinct(F.transform(files, lambda f: f.folder))
    index = [
        F.concat(
            F.lit(name + ": "),
            F.coalesce(escape_name(value.cast("string"), _META_MARKS), F.lit("")), F.lit("\n"),
        )
        for name, value in zip(META_NAMES, meta, strict=True)
    ]

    def listing(folder: Column) -> Column:
        names = F.transform(F.filter(files, lambda f: f.folder == folder), lambda f: f.file)
        return F.concat(
            F.lit(LISTING_DIR), folder, F.lit(LISTING_FILES), F.array_join(names, ", "),
            F.lit(LISTING_END),
        )

    def body(folder: Column) -> Column:
        bodies = F.transform(
            F.filter(files, lambda f: f.folder == folder),
            lambda f: F.concat(
                F.lit(FILE_BEGIN), f.file, F.lit(CONTENT_BEGIN), f.content, F.lit(CONTENT_END)
            ),
        )
        return F.concat(
            F.lit(DIR_BEGIN), folder, F.lit("\n"), F.array_join(bodies, ""), F.lit(DIR_END)
        )

    return F.concat(
        F.lit(DOC_OPEN), *index, F.lit(INDEX_CLOSE),
        F.array_join(F.transform(folders, listing), ""), F.lit(LISTING_CLOSE),
        F.array_join(F.transform(folders, body), ""), F.lit(DOC_CLOSE),
    )


def _tail(pieces: Column) -> Column:
    """What follows each separator of a split text."""
    return F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))


def parse_files(document) -> Column:
    """``ARRAY<STRUCT<folder, file, content>>`` of a document, in its order."""
    folders = _tail(F.split(document, DIR_BEGIN))

    def in_folder(block: Column) -> Column:
        folder = F.substring_index(block, "\n", 1)

        def one(text: Column) -> Column:
            name = F.substring_index(text, "\n", 1)
            body = F.substring_index(text, CONTENT_END, 1)
            skipped = F.length(name) + len(CONTENT_BEGIN)
            content = F.substr(body, skipped + 1, F.greatest(F.length(body) - skipped, F.lit(0)))
            return F.struct(
                unescape_name(folder).alias("folder"), unescape_name(name).alias("file"),
                unescape_text(content).alias("content"),
            )

        return F.transform(_tail(F.split(block, FILE_BEGIN)), one)

    return F.flatten(F.transform(folders, in_folder))


def case_parse(df: DataFrame, keys: list[str], document: str) -> DataFrame:
    """Documents as one row per file."""
    return df.select(*keys, F.posexplode(parse_files(document)).alias("pos", "_f")).select(
        *keys, "pos", "_f.folder", "_f.file", "_f.content"
    )


def parse_index(document) -> list[Column]:
    """The four index lines as columns."""
    return [
        unescape_name(F.regexp_extract(document, f"(?m)^{name}: ([^\\n]*)$", 1), _META_MARKS)
        .alias(name.replace(" ", "_"))
        for name in META_NAMES
    ]


def parse_listing(document) -> Column:
    """``ARRAY<STRUCT<folder, files>>`` of the listing before the bodies."""
    listing = F.substring_index(F.substring_index(document, LISTING_CLOSE, 1), INDEX_CLOSE, -1)
    lines = F.filter(F.split(listing, "\n"), lambda line: F.startswith(line, F.lit(LISTING_DIR)))

    def one(line: Column) -> Column:
        folder = F.substring_index(
            F.substring_index(line, LISTING_FILES, 1), LISTING_DIR, -1
        )
        names = F.substring_index(F.substring_index(line, LISTING_FILES, -1), "]</dir>", 1)
        listed = F.transform(F.split(names, ", "), lambda n: unescape_name(n))
        return F.struct(unescape_name(folder).alias("folder"), listed.alias("files"))

    return F.transform(lines, one)


def _paths(entries: Column) -> Column:
    return F.transform(entries, lambda e: F.concat_ws("/", e.folder, e.file))


def consistency(document) -> Column:
    """``struct(listed, parsed, missing, extra)``: the listing against the bodies."""
    listed = F.flatten(
        F.transform(
            parse_listing(document),
            lambda d: F.transform(d.files, lambda f: F.concat_ws("/", d.folder, f)),
        )
    )
    parsed = _paths(parse_files(document))
    return F.struct(
        F.size(listed).cast("bigint").alias("listed"),
        F.size(parsed).cast("bigint").alias("parsed"),
        F.array_except(listed, parsed).alias("missing"),
        F.array_except(parsed, listed).alias("extra"),
    )


def prompt_with_case(requirement, document) -> Column:
    return F.concat(
        F.lit(REQUIREMENT), requirement, F.lit(REFER), document, F.lit(TRUST_REFERENCE + CLOSING)
    )


def prompt_without_case(requirement) -> Column:
    return F.concat(F.lit(REQUIREMENT), requirement, F.lit("\n" + CLOSING))


def ablation_pair(df: DataFrame, keys: list[str], requirement, document) -> DataFrame:
    """Every requirement twice: with its case document and without."""
    variants = F.array(
        F.struct(
            F.lit("with_reference").alias("variant"),
            prompt_with_case(requirement, document).alias("prompt"),
        ),
        F.struct(
            F.lit("without_reference").alias("variant"),
            prompt_without_case(requirement).alias("prompt"),
        ),
    )
    return df.select(*keys, F.inline(variants))
