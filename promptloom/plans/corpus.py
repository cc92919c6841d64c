"""Reading, cleaning, joining and reshaping the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions import text as X
from promptloom.operators import frames, metrics, order, pairs, pivot, similar
from promptloom.plans.registry import query, table
from promptloom.session import scratch_path
from promptloom.sources import csv_split, json_split, readers, writers
from promptloom.streaming import arrivals

SPLIT_SQL = """
    SELECT {key}, {more} CASE WHEN row_number() OVER (ORDER BY md5('{seed}:' || {key}), {key})
        <= {rounding}((SELECT count(*) FROM {table}) * {fraction}::DOUBLE)
        THEN 'test' ELSE 'train' END AS split FROM {table}"""


def split_sql(table_name: str, key: str, more: str = "", seed: int = 42,
              fraction: float = 0.2, rounding: str = "floor") -> str:
    more = f"{more}," if more else ""
    return SPLIT_SQL.format(table=table_name, key=key, more=more, seed=seed, fraction=fraction,
                            rounding=rounding)


# --- sources and sinks ----------------------------------------------------------------------------

_MESSAGES = "SELECT conv_id, turn, role, text FROM conversations"
_MESSAGE_DDL = "conv_id bigint, turn bigint, role string, text string"
_DOCUMENT_DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@query("csv_roundtrip", _MESSAGES)
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    writers.write_csv(table(spark, folder, "conversations"), path)
    return readers.read_csv(spark, path, _MESSAGE_DDL)


@query("csv_split_scan", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_split_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    writers.write_csv(table(spark, folder, "documents"), path)
    return csv_split.read_csv_split(spark, path, _DOCUMENT_DDL)


@query("json_array_scan", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_array_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "json")
    writers.write_records(table(spark, folder, "documents"), path)
    return json_split.read_records_split(spark, path, _DOCUMENT_DDL)


@query("json_columns_scan", _MESSAGES)
def json_columns_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a single object each, as other programs write them."""
    path = scratch_path(spark, "json")
    objects = writers.to_columnar(table(spark, folder, "conversations"), [F.asc("conv_id"), F.asc("turn")]).drop("chunk")
    objects.write.option("ignoreNullFields", False).option("maxRecordsPerFile", 1).json(path)
    return json_split.read_columnar_split(spark, path, _MESSAGE_DDL)


@query("csv_text_scan", """
    SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text
    FROM conversations""")
def csv_text_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    writers.write_csv(table(spark, folder, "conversations"), path)
    return readers.read_csv_text(spark, path, ["conv_id", "turn", "role", "text"])


@query("json_roundtrip", _MESSAGES)
def json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    writers.write_jsonl(table(spark, folder, "conversations"), path)
    return readers.read_jsonl(spark, path, _MESSAGE_DDL)


@query("columnar_unzip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def columnar_unzip(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    path = scratch_path(spark, "columnar")
    writers.write_columnar(docs, path, [F.asc("doc_id")], rows=512)
    return readers.read_columnar(spark, path, docs.schema)


@query("line_roundtrip", _MESSAGES)
def line_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """JSON texts written as raw lines; line breaks inside a text are escaped by the JSON."""
    path = scratch_path(spark, "lines")
    turns = table(spark, folder, "conversations")
    lines = turns.select(F.to_json(F.struct(*turns.columns)).alias("line"))
    writers.write_lines(lines, "line", path)
    return readers.read_jsonl(spark, path, _MESSAGE_DDL)


@query("rewrite_kept", "SELECT conv_id, turn, role FROM conversations")
def rewrite_kept(spark: SparkSession, folder: str) -> DataFrame:
    """A file rewritten in place with fewer columns."""
    path = scratch_path(spark, "rewritten")
    columns = ["conv_id", "turn", "role"]
    writers.write_csv(table(spark, folder, "conversations"), path)
    writers.rewrite(
        spark, path, lambda p: readers.read_csv(spark, p, _MESSAGE_DDL),
        lambda df: frames.keep(df, columns), writers.write_csv,
    )
    return readers.read_csv(spark, path, "conv_id bigint, turn bigint, role string")


@query("convert_format", _MESSAGES)
def convert_format(spark: SparkSession, folder: str) -> DataFrame:
    """CSV to JSON lines, every column as text on the way."""
    source, target = scratch_path(spark, "csv"), scratch_path(spark, "jsonl")
    writers.write_csv(table(spark, folder, "conversations"), source)
    names = ["conv_id", "turn", "role", "text"]
    writers.convert(
        lambda: readers.read_csv_text(spark, source, names), writers.write_jsonl, target
    )
    text = readers.read_jsonl(spark, target, ", ".join(f"{n} string" for n in names))
    return text.withColumns({n: F.col(n).cast("bigint") for n in names[:2]})


@query("split_dataset", f"""
    SELECT doc_id, lang, split FROM ({split_sql('documents', 'doc_id', 'lang')})
    WHERE split = 'test'""")
def split_dataset(spark: SparkSession, folder: str) -> DataFrame:
    docs = order.split_exact(table(spark, folder, "documents"), "doc_id", 0.2, 42)
    path = scratch_path(spark, "splits")
    writers.write_dataset(docs, path)
    settings = {"path": path, "dataset": "train", "eval_dataset": "test"}
    read = readers.read_declared(spark, settings, docs.schema)
    return read["eval_dataset"].select("doc_id", "lang", "split")


@query("path_parts", """
    SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
        regexp_extract(url, '([^/]+)/[^/]*$', 1) AS folder,
        regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS leaf
    FROM pages""")
def path_parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id", X.url_host("url").alias("host"), X.path_folder("url").alias("folder"),
        X.path_leaf("url").alias("leaf"),
    )


# --- projections and filters ----------------------------------------------------------------------


@query("keep_columns", "SELECT doc_id, lang, source FROM documents")
def keep_columns(spark: SparkSession, folder: str) -> DataFrame:
    return frames.keep(table(spark, folder, "documents"), ["doc_id", "lang", "source"])


@query("drop_columns", "SELECT doc_id, lang, source FROM documents")
def drop_columns(spark: SparkSession, folder: str) -> DataFrame:
    return frames.drop_strict(table(spark, folder, "documents"), ["text", "n_chars"])


@query("isolate_file", "SELECT * FROM conversations WHERE role = 'system'")
def isolate_file(spark: SparkSession, folder: str) -> DataFrame:
    return frames.isolate(table(spark, folder, "conversations"), "role", "system")


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their labels, null where there are none."""
    docs = table(spark, folder, "documents")
    return docs.join(table(spark, folder, "labels"), "doc_id", "left")


NA_SQL = ", ".join(f"'{t}'" for t in X.NA_TOKENS)


@query("drop_null", f"""
    SELECT doc_id, lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)
    WHERE quality IS NOT NULL AND toxic IS NOT NULL
        AND lang NOT IN ({NA_SQL}) AND source NOT IN ({NA_SQL})""")
def drop_null(spark: SparkSession, folder: str) -> DataFrame:
    return frames.drop_null(
        labelled(spark, folder).select("doc_id", "lang", "source", "quality", "toxic")
    )


@query("stringify", """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source,
        coalesce(CAST(quality AS VARCHAR), 'None') AS quality,
        coalesce(CAST(toxic AS VARCHAR), 'None') AS toxic
    FROM documents LEFT JOIN labels USING (doc_id)""")
def stringify(spark: SparkSession, folder: str) -> DataFrame:
    return frames.stringify(
        labelled(spark, folder).select("doc_id", "lang", "source", "quality", "toxic")
    )


@query("profile", "\nUNION ALL\n".join(f"""
    SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls,
        min(length(CAST({c} AS VARCHAR))) AS min_length,
        round(avg(length(CAST({c} AS VARCHAR))), 6) AS avg_length,
        max(length(CAST({c} AS VARCHAR))) AS max_length FROM documents"""
                                       for c in ["doc_id", "text", "lang", "source", "n_chars"]))
def profile(spark: SparkSession, folder: str) -> DataFrame:
    return frames.profile(table(spark, folder, "documents"))


@query("harmonise", """
    SELECT u.conv_id, u.turn, u.text AS user_prompt, a.text AS file_content
    FROM conversations u LEFT JOIN conversations a
        ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
    WHERE u.role = 'user'""")
def harmonise(spark: SparkSession, folder: str) -> DataFrame:
    prompts, answers = pairs.pair_turns(table(spark, folder, "conversations"))
    keys = ["conv_id", "turn"]
    older = pairs.pair_files(prompts, answers, keys).select(
        *keys, F.col("prompt").alias("usr_prompt"), F.col("answer").alias("code_content")
    )
    newer = pairs.unpaired_files(prompts, answers, keys).select(
        *keys, F.col("prompt").alias("user_prompt"), F.lit(None).cast("string").alias("file_content")
    )
    expected = ["user_prompt", "file_content"]
    return frames.harmonise(older, expected=expected).unionByName(newer)


@query("json_map", """
    SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def json_map(spark: SparkSession, folder: str) -> DataFrame:
    props = X.json_map("props")
    return table(spark, folder, "events").select(
        "event_id", F.try_element_at(props, F.lit("k")).alias("k")
    )


# --- joins ----------------------------------------------------------------------------------------


@query("zip_positional", """
    SELECT a.pos, doc_id, item_id
    FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS pos FROM documents) a
    JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) AS pos FROM benchmark) b USING (pos)""")
def zip_positional(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.zip_by_position(
        table(spark, folder, "documents").select("doc_id"),
        table(spark, folder, "benchmark").select("item_id"),
        [F.asc("doc_id")], [F.asc("item_id")],
    )


PAIRS_SQL = """
    SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS answer
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'"""


def paired(spark: SparkSession, folder: str) -> DataFrame:
    """User turns with the assistant turns that answer them."""
    prompts, answers = pairs.pair_turns(table(spark, folder, "conversations"))
    return pairs.pair_files(prompts, answers, ["conv_id", "turn"])


@query("pair_turns", PAIRS_SQL)
def pair_turns(spark: SparkSession, folder: str) -> DataFrame:
    return paired(spark, folder)


@query("unpaired", """
    SELECT conv_id, turn, text AS prompt FROM conversations u WHERE role = 'user' AND NOT EXISTS (
        SELECT 1 FROM conversations a
        WHERE a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant')""")
def unpaired(spark: SparkSession, folder: str) -> DataFrame:
    prompts, answers = pairs.pair_turns(table(spark, folder, "conversations"))
    return pairs.unpaired_files(prompts, answers, ["conv_id", "turn"])


def case_files(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as cases: a turn is a file, its role the directory."""
    return pivot.files_map(
        table(spark, folder, "conversations"), "conv_id", "turn",
        X.path_join("role", F.col("turn").cast("string")), "text",
    )


@query("map_lookup", """
    SELECT conv_id, turn // 256 AS volume, role || '/' || turn AS path, text AS value
    FROM conversations
    UNION ALL
    SELECT DISTINCT conv_id, turn // 256, 'system/0', NULL FROM conversations c WHERE NOT EXISTS (
        SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'system'
            AND s.turn = 0 AND s.turn // 256 = c.turn // 256)""")
def map_lookup(spark: SparkSession, folder: str) -> DataFrame:
    cases = case_files(spark, folder).withColumn(
        "file_tree", F.array_union("file_tree", F.array(F.lit("system/0")))
    )
    return pairs.map_lookup(cases, ["conv_id", "volume"], "file_tree", "files")


@query("attach_similar", """
    WITH reqs AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
    cases AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
    SELECT doc_id, lang, source, n_chars, case_id, gap FROM (
        SELECT r.doc_id, r.lang, r.source, r.n_chars, c.doc_id AS case_id,
            abs(r.n_chars - c.n_chars) AS gap,
            row_number() OVER (PARTITION BY r.doc_id
                ORDER BY abs(r.n_chars - c.n_chars), c.doc_id) AS rn
        FROM reqs r LEFT JOIN cases c ON r.lang = c.lang AND r.source = c.source)
    WHERE rn = 1""")
def attach_similar(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    known = table(spark, folder, "labels").select("doc_id")
    return pairs.attach_similar(
        docs.join(known, "doc_id", "left_semi"), docs.join(known, "doc_id", "left_anti"),
        ["lang", "source"], "n_chars", "doc_id",
    )


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> ''))"


@query("attach_similar_text", f"""
    WITH sets AS (SELECT doc_id, lang, source, {_WORDS} AS words, doc_id IN (SELECT doc_id FROM labels) AS asks FROM documents),
    pairs AS (SELECT r.doc_id, c.doc_id AS case_id, len(list_intersect(r.words, c.words)) AS common, len(r.words) + len(c.words) AS n_words
              FROM sets r JOIN sets c ON r.asks AND NOT c.asks AND r.lang = c.lang AND r.source = c.source),
    best AS (SELECT doc_id, case_id, CAST(common AS DOUBLE) / (n_words - common) AS similarity FROM pairs WHERE common * 10 >= n_words - common
             QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(common AS DOUBLE) / (n_words - common) DESC, case_id) = 1)
    SELECT s.doc_id, s.lang, s.source, b.case_id, b.similarity FROM sets s LEFT JOIN best b ON s.doc_id = b.doc_id WHERE s.asks""")
def attach_similar_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    known = table(spark, folder, "labels").select("doc_id")
    return similar.attach_similar_within(docs, known, ["lang", "source"], "text", "doc_id", at_least=0.1).drop("text")


@query("leakage", f"""
    WITH parts AS ({split_sql('documents', 'doc_id', 'md5(text) AS text_md5')})
    SELECT doc_id, text_md5 FROM parts WHERE split = 'test'
        AND text_md5 IN (SELECT text_md5 FROM parts WHERE split = 'train')""")
def leakage(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pairs.leakage(order.split_exact(docs, "doc_id", 0.2, 42), "doc_id", "text")


@query("split_report", f"""
    WITH parts AS ({split_sql('documents', 'doc_id', 'md5(text) AS m')})
    SELECT 'train' AS part, count(*) AS n FROM parts WHERE split = 'train'
    UNION ALL SELECT 'test', count(*) FROM parts WHERE split = 'test'
    UNION ALL SELECT 'total', count(*) FROM documents
    UNION ALL SELECT 'unassigned', count(*) FROM parts WHERE split IS NULL
    UNION ALL SELECT 'distinct_texts', count(DISTINCT m) FROM parts
    UNION ALL SELECT 'shared_texts', count(*) FROM (
        SELECT m FROM parts GROUP BY m HAVING count(DISTINCT split) = 2)""")
def split_report(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return metrics.split_report(order.split_exact(docs, "doc_id", 0.2, 42), "text")


# --- paths and files ------------------------------------------------------------------------------

_TAG = "<([a-z0-9]+)"
_LINK = 'href="([^"]*)"'
_EXPECTED_TAGS = ["html", "title", "nav", "article", "h1", "table", "form", "footer"]


def page_tags() -> Column:
    return F.regexp_extract_all("html", F.lit(_TAG), F.lit(1))


def page_links() -> Column:
    return F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))


@query("path_vocabulary", f"""
    SELECT path, count(DISTINCT page_id) AS n_rows, count(*) AS occurrences
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_TAG}', 1)) AS path FROM pages)
    GROUP BY path""")
def path_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(page_tags().alias("tags"))
    return pivot.path_vocabulary(pages, F.col("tags"))


@query("missing_paths", f"""
    SELECT page_id, array_to_string(missing, ' ') AS missing, len(missing) AS n_missing FROM (
        SELECT page_id, list_filter({_EXPECTED_TAGS},
            lambda n: NOT list_contains(regexp_extract_all(html, '{_TAG}', 1), n)) AS missing
        FROM pages)""")
def missing_paths(spark: SparkSession, folder: str) -> DataFrame:
    missing = X.missing_paths(page_tags(), _EXPECTED_TAGS)
    return table(spark, folder, "pages").select("page_id", missing.alias("_m")).select(
        "page_id", F.array_join("_m", " ").alias("missing"),
        F.size("_m").cast("bigint").alias("n_missing"),
    )


@query("new_paths", f"""
    WITH parts AS ({split_sql('pages', 'page_id', 'html')}),
    links AS (SELECT split, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS path FROM parts)
    SELECT path FROM links WHERE split = 'test'
    EXCEPT SELECT path FROM links WHERE split = 'train'""")
def new_paths(spark: SparkSession, folder: str) -> DataFrame:
    pages = order.split_exact(table(spark, folder, "pages"), "page_id", 0.2, 42)
    links = pages.select("split", page_links().alias("links"))
    test, train = links.filter("split = 'test'"), links.filter("split = 'train'")
    return pivot.new_paths(test, train, F.col("links"))


@query("new_paths_stream", f"""
    WITH arrivals AS ({split_sql('pages', 'page_id', 'html', fraction=0.5)}),
    links AS (SELECT CASE WHEN split = 'test' THEN 0 ELSE 1 END AS arrival, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS path
              FROM arrivals)
    SELECT path, CAST(min(arrival) AS BIGINT) AS arrival FROM links GROUP BY path""")
def new_paths_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the pages arrives, then the other half, then the first once more."""
    pages = order.split_exact(table(spark, folder, "pages"), "page_id", 0.5, 42)
    source, target = scratch_path(spark, "arrivals"), scratch_path(spark, "paths")
    for part in ("test", "train", "test"):
        pages.filter(F.col("split") == part).select("html").write.mode("append").parquet(source)
        stream = spark.readStream.schema("html string").parquet(source).select(page_links().alias("links"))
        seen = arrivals.new_paths_stream(stream, F.col("links"), target)
    return seen


# eight files to a wide row; a longer conversation continues in the next row
_WIDE = [f"t{i}" for i in range(8)]


def wide_files(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "conversations").select(
        "conv_id", F.floor(F.col("turn") / len(_WIDE)).alias("volume"),
        F.concat(F.lit("t"), F.col("turn") % len(_WIDE)).alias("path"), "text",
    )
    return pivot.pivot_files(files, ["conv_id", "volume"], "path", "text", _WIDE)


_WIDE_SQL = ", ".join(
    f"coalesce(max(CASE WHEN turn % 8 = {i} THEN text END), 'NONE') AS t{i}" for i in range(8)
)


@query("pivot_files", f"""
    SELECT conv_id, turn // 8 AS volume, {_WIDE_SQL} FROM conversations GROUP BY 1, 2""")
def pivot_files(spark: SparkSession, folder: str) -> DataFrame:
    return wide_files(spark, folder)


@query("raw_to_wide", f"""
    SELECT conv_id, turn // 8 AS volume, {_WIDE_SQL} FROM conversations GROUP BY 1, 2""")
def raw_to_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Raw corpus rows (a list of paths, a JSON object of texts) to wide rows."""
    raw = pivot.files_map(
        table(spark, folder, "conversations"), "conv_id", "turn",
        F.concat(F.lit("t"), F.col("turn") % len(_WIDE)), "text", most=len(_WIDE),
    ).withColumn("files", F.to_json("files"))
    files = pivot.raw_to_files(raw, ["conv_id", "volume"], "file_tree", "files")
    return pivot.pivot_files(files, ["conv_id", "volume"], "path", "content", _WIDE)


@query("unpivot_files", """
    SELECT conv_id, turn // 8 AS volume, 't' || (turn % 8) AS path, text AS content
    FROM conversations WHERE text <> 'NONE'""")
def unpivot_files(spark: SparkSession, folder: str) -> DataFrame:
    return pivot.unpivot_files(wide_files(spark, folder), ["conv_id", "volume"], _WIDE)


@query("files_map", """
    SELECT conv_id, turn // 256 AS volume, count(*) AS n_files,
        string_agg(role || '/' || turn || '=' || text, chr(10) ORDER BY turn) AS answer,
        '{' || string_agg(CAST(to_json(role || '/' || turn) AS VARCHAR) || ':'
            || CAST(to_json(text) AS VARCHAR), ',' ORDER BY turn) || '}' AS answer_json
    FROM conversations GROUP BY 1, 2""")
def files_map(spark: SparkSession, folder: str) -> DataFrame:
    lines = F.transform(F.map_entries("files"), lambda e: F.concat(e.key, F.lit("="), e.value))
    return case_files(spark, folder).select(
        "conv_id", "volume", F.size("file_tree").cast("bigint").alias("n_files"),
        F.array_join(lines, "\n").alias("answer"), F.to_json("files").alias("answer_json"),
    )
