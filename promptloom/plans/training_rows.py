"""Vocabulary, token arrays, label masks and padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions import masks as M
from promptloom.functions.text import tokens
from promptloom.functions.templates import DEFAULT_SYSTEM, chatml_piece, instruct_answer
from promptloom.operators import batches, completion, lengths, metrics, order
from promptloom.operators import vocabulary as V
from promptloom.operators.chat_rows import chat_rows, chat_token_counts
from promptloom.operators.messages import chat_pieces
from promptloom.operators.training_set import Settings, training_set
from promptloom.plans.corpus import NA_SQL, PAIRS_SQL, paired
from promptloom.plans.ordering import rank_sql, tokens_sql
from promptloom.plans.prompts import CHAT_SQL, chat_corpus
from promptloom.plans.registry import query, table

# The length limits of the published training runs.
LIMITS = [512, 1024, 1028, 2048, 4096, 8192, 12768, 42768]
CUTOFF = 1028


def vocab_sql(tokens_from: str) -> str:
    """CTE ``vocab`` over the rows of a CTE that has a ``token`` column."""
    return f"""counts AS (SELECT token, count(*) AS freq FROM {tokens_from}
        GROUP BY token),
    vocab AS (SELECT CAST(row_number() OVER (ORDER BY freq DESC, token) + 2 AS INTEGER) AS id, token, freq
            FROM counts
        UNION ALL VALUES (0, '<pad>', 0), (1, '<unk>', 0), (2, '<eos>', 0))"""


_DOC_TOKENS_SQL = f"""toks AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS p
        FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents))"""
_DOC_IDS_SQL = f"""{_DOC_TOKENS_SQL}, {vocab_sql('toks')},
    coded AS (SELECT doc_id, list(id ORDER BY p) AS l FROM toks JOIN vocab USING (token)
        GROUP BY doc_id),
    ids AS (SELECT doc_id, coalesce(l, []) AS l FROM documents LEFT JOIN coded USING (doc_id))"""


def joined_sql(ids: str) -> str:
    return f"array_to_string({ids}, ' ')"


def padded_sql(ids: str, n: str, pad: int = 0) -> str:
    return f"list_concat({ids}, list_transform(range(greatest({n} - len({ids}), 0)), lambda i: {pad}))"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def document_vocab(spark: SparkSession, folder: str) -> DataFrame:
    return V.build_vocab(documents(spark, folder), tokens("text"))


def document_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, ids`` of every document."""
    vocab = document_vocab(spark, folder)
    return V.encode(documents(spark, folder), "doc_id", tokens("text"), vocab)


# --- vocabulary -----------------------------------------------------------------------------------


@query("vocab", f"WITH {_DOC_TOKENS_SQL}, {vocab_sql('toks')} SELECT id, token, freq FROM vocab")
def vocab(spark: SparkSession, folder: str) -> DataFrame:
    return document_vocab(spark, folder)


@query("encode", f"WITH {_DOC_IDS_SQL} SELECT doc_id, {joined_sql('l')} AS ids FROM ids")
def encode(spark: SparkSession, folder: str) -> DataFrame:
    return document_ids(spark, folder).select("doc_id", M.joined("ids").alias("ids"))


@query("decode", f"SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS text FROM documents")
def decode(spark: SparkSession, folder: str) -> DataFrame:
    vocab = document_vocab(spark, folder)
    ids = V.encode(documents(spark, folder), "doc_id", tokens("text"), vocab)
    return V.decode(ids, "doc_id", "ids", vocab)


@query("encode_bytes", """
    SELECT doc_id, octet_length(encode(text)) AS n_ids, lower(hex(encode(text))) AS ids
    FROM documents""")
def encode_bytes(spark: SparkSession, folder: str) -> DataFrame:
    coded = documents(spark, folder).select(
        "doc_id", V.encode_with(V.utf8_bytes, F.col("text")).alias("_ids")
    )
    digits = F.transform("_ids", lambda b: F.lpad(F.lower(F.hex(b)), 2, "0"))
    return coded.select(
        "doc_id", F.size("_ids").cast("bigint").alias("n_ids"),
        F.array_join(digits, "").alias("ids"),
    )


@query("truncation_report", "\nUNION ALL\n".join(f"""
    SELECT CAST({n} AS BIGINT) AS max_length, count(*) AS n_rows,
        CAST(sum(CASE WHEN len > {n} THEN 1 ELSE 0 END) AS BIGINT) AS rows_cut,
        round(sum(CASE WHEN len > {n} THEN 1 ELSE 0 END) / count(*), 6) AS share_cut,
        CAST(sum(greatest(len - {n}, 0)) AS BIGINT) AS tokens_lost
    FROM (SELECT len({tokens_sql('text')}) AS len FROM documents)""" for n in LIMITS))
def truncation_report(spark: SparkSession, folder: str) -> DataFrame:
    lengths = documents(spark, folder).select(F.size(tokens("text")).alias("len"))
    return metrics.truncation_report(lengths, "len", LIMITS)


@query("length_quantiles", f"""
    WITH lens AS (SELECT lang, list_sort(list(CAST(len({tokens_sql('text')}) AS BIGINT))) AS l FROM documents GROUP BY lang),
    cuts AS (SELECT lang, l, share, l[CAST(greatest(ceil(share * len(l)), 1) AS BIGINT)] AS length
             FROM lens CROSS JOIN (SELECT CAST(unnest(['0.5', '0.9', '0.95', '0.99', '1.0']) AS DECIMAL(18, 17)) AS share))
    SELECT lang, CAST(share AS DOUBLE) AS share, length, CAST(len(list_filter(l, lambda x: x > length)) AS BIGINT) AS longer FROM cuts""")
def length_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("lang", "text")
    return lengths.length_quantiles(docs, "lang", F.size(tokens("text")))


# --- fitting and batching -------------------------------------------------------------------------


@query("truncate_pad", f"""
    WITH {_DOC_IDS_SQL}, cut AS (SELECT doc_id, l[1:{CUTOFF}] AS k, len(l) AS n FROM ids)
    SELECT doc_id, least(n, {CUTOFF}) AS n_kept, {CUTOFF} - least(n, {CUTOFF}) AS n_pad,
        n > {CUTOFF} AS truncated, md5({joined_sql(padded_sql('k', str(CUTOFF)))}) AS ids_md5
    FROM cut""")
def truncate_pad(spark: SparkSession, folder: str) -> DataFrame:
    """Only the tokens that stay are looked up; the vocabulary is that of the whole texts."""
    docs, vocab = documents(spark, folder), document_vocab(spark, folder)
    toks = tokens("text")
    cut = docs.select("doc_id", F.slice(toks, 1, CUTOFF).alias("_t"), (F.size(toks) > CUTOFF).alias("truncated"))
    mask = M.attention("ids", CUTOFF)
    return V.encode(cut, "doc_id", F.col("_t"), vocab, carry=["truncated"]).select(
        "doc_id", M.kept_length("ids", CUTOFF).cast("bigint").alias("n_kept"),
        F.size(F.filter(mask, lambda m: m == 0)).cast("bigint").alias("n_pad"), "truncated",
        F.md5(M.joined(M.fit("ids", CUTOFF, V.PAD))).alias("ids_md5"),
    )


@query("pad_only", f"""
    WITH {_DOC_IDS_SQL}
    SELECT doc_id, greatest(len(l), 512) AS n, md5({joined_sql(padded_sql('l', '512'))}) AS ids_md5
    FROM ids""")
def pad_only(spark: SparkSession, folder: str) -> DataFrame:
    rows = document_ids(spark, folder).select(
        "doc_id", M.fit("ids", 512, V.PAD, truncate=False).alias("_ids")
    )
    return rows.select(
        "doc_id", F.size("_ids").cast("bigint").alias("n"),
        F.md5(M.joined("_ids")).alias("ids_md5"),
    )


_BATCHES_SQL = f"""{_DOC_IDS_SQL},
    batched AS (SELECT doc_id, rank, (rank - 1) // 8 AS batch, l FROM ids JOIN ({rank_sql(7)})
        USING (doc_id)),
    wide AS (SELECT *, max(len(l)) OVER (PARTITION BY batch) AS width FROM batched),
    padded AS (SELECT *, {padded_sql('l', 'width')} AS ids FROM wide)"""


def padded_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in batches of eight, each padded to its longest row."""
    ranked = order.shuffle_rank(table(spark, folder, "documents").select("doc_id"), "doc_id", 7)
    batched = ranked.withColumns(batches.assign_batches("rank", 8, 1)).withColumnRenamed(
        "micro", "batch"
    )
    rows = document_ids(spark, folder).join(batched, "doc_id").drop("step")
    return batches.pad_batch(rows, "batch", "ids", V.PAD)


@query("pad_longest", f"""
    WITH {_BATCHES_SQL}
    SELECT doc_id, batch, width, width - len(l) AS n_pad, md5({joined_sql('ids')}) AS ids_md5
    FROM padded""")
def pad_longest(spark: SparkSession, folder: str) -> DataFrame:
    return padded_batches(spark, folder).select(
        "doc_id", "batch", F.col("width").cast("bigint").alias("width"),
        (F.col("width") - F.size("ids")).cast("bigint").alias("n_pad"),
        F.md5(M.joined("padded")).alias("ids_md5"),
    )


@query("collate", f"""
    WITH {_BATCHES_SQL}
    SELECT batch, count(*) AS n_rows, any_value(width) AS width,
        md5(string_agg({joined_sql('ids')}, '|' ORDER BY rank)) AS ids_md5
    FROM padded GROUP BY batch""")
def collate(spark: SparkSession, folder: str) -> DataFrame:
    collated = batches.collate(padded_batches(spark, folder), "batch", "rank", ["padded"])
    return collated.select(
        "batch", F.size("padded").cast("bigint").alias("n_rows"),
        F.size(F.get("padded", F.lit(0))).cast("bigint").alias("width"),
        F.md5(F.array_join(F.transform("padded", M.joined), "|")).alias("ids_md5"),
    )


# --- prompt and answer ----------------------------------------------------------------------------

_PAIR_TOKENS_SQL = f"""pairs AS ({PAIRS_SQL}),
    texts AS (SELECT conv_id, turn, 'p' AS side, prompt AS text FROM pairs UNION ALL
        SELECT conv_id, turn, 'a', '[/INST] ' || answer FROM pairs),
    toks AS (SELECT conv_id, turn, side, unnest(t) AS token, generate_subscripts(t, 1) AS p
        FROM (SELECT conv_id, turn, side, {tokens_sql('text')} AS t FROM texts))"""


@query("encode_pair", f"""
    WITH {_PAIR_TOKENS_SQL}, {vocab_sql('toks')},
    ids AS (SELECT conv_id, turn, side, list(id ORDER BY p) AS l FROM toks JOIN vocab USING (token)
        GROUP BY ALL),
    fitted AS (SELECT conv_id, turn, side, {padded_sql('l', '512')} AS l FROM ids)
    SELECT conv_id, turn, max(CASE WHEN side = 'p' THEN md5({joined_sql('l')}) END) AS input_md5,
        max(CASE WHEN side = 'a' THEN md5({joined_sql('l')}) END) AS labels_md5
    FROM fitted GROUP BY conv_id, turn""")
def encode_pair(spark: SparkSession, folder: str) -> DataFrame:
    rows = paired(spark, folder).select(
        "conv_id", "turn", tokens("prompt").alias("_p"), tokens(instruct_answer("answer")).alias("_a")
    )
    both = F.concat("_p", "_a")
    vocab = V.build_vocab(rows, both)
    # one pass over the tokens of both sides; the tag says which side a token is from
    side = F.concat(
        F.array_repeat(F.lit(0), F.size("_p")), F.array_repeat(F.lit(1), F.size("_a"))
    )
    coded = V.encode(rows, ["conv_id", "turn"], both, vocab, tags=side)

    def of(wanted: int):
        picked = F.filter("ids", lambda x, i: F.get("tags", i) == wanted)
        return F.md5(M.joined(M.fit(picked, 512, V.PAD, truncate=False)))

    return coded.select(
        "conv_id", "turn", of(0).alias("input_md5"), of(1).alias("labels_md5")
    )


@query("strip_prefix", f"""
    SELECT conv_id, turn, {joined_sql(tokens_sql('answer'))} AS generated FROM ({PAIRS_SQL})""")
def strip_prefix(spark: SparkSession, folder: str) -> DataFrame:
    whole = tokens(F.concat_ws(" ", "prompt", "answer"))
    return paired(spark, folder).select(
        "conv_id", "turn",
        F.array_join(M.strip_prefix(whole, tokens("prompt")), " ").alias("generated"),
    )


# --- label masks ----------------------------------------------------------------------------------

# one of the limits above; part of the conversations are longer, so ``mask_pad`` both cuts and pads
CHAT_LIMIT = 512
RESPONSE_MARK = "<|im_start|>assistant"

_CHAT_TOKENS_SQL = f"""msgs AS (
        SELECT conv_id, turn, turn AS home, role, '<|im_start|>' || role || chr(10) || text
            || '<|im_end|>' || chr(10) AS piece FROM conversations
        UNION ALL
        SELECT conv_id, -1, first, 'system', '<|im_start|>system' || chr(10) || '{DEFAULT_SYSTEM}'
            || '<|im_end|>' || chr(10)
        FROM (SELECT conv_id, arg_min(role, turn) AS r, min(turn) AS first FROM conversations GROUP BY 1)
        WHERE r <> 'system'),
    toks AS (SELECT conv_id, turn, home, role, unnest(t) AS token, generate_subscripts(t, 1) AS p
        FROM (SELECT conv_id, turn, home, role, {tokens_sql('piece')} AS t FROM msgs)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, p) AS loc,
        role = 'assistant' AND p > 1 AS learnt FROM toks)"""
# `home` is the message whose piece a token is in; a default system turn is in the first one's
_CHAT_IDS_SQL = f"""{_CHAT_TOKENS_SQL}, {vocab_sql('toks')},
    coded AS (SELECT conv_id, home, loc, token, id, learnt FROM placed JOIN vocab USING (token)
        WHERE id > 2),
    marks AS (SELECT conv_id, max(CASE WHEN token = '{RESPONSE_MARK}' THEN loc END) AS last_mark,
            min(CASE WHEN token = '{RESPONSE_MARK}' THEN loc END) AS first_mark
        FROM coded GROUP BY conv_id)"""


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    return chat_pieces(table(spark, folder, "conversations"), "conv_id", "turn")


def message_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``conv_id, turn, start, ids, tags``: the ids of every message, tag 1 where an assistant speaks.

    A row is a message, so a conversation of any length needs no row of its own.
    """
    rows = pieces(spark, folder)
    vocab = V.build_vocab(rows, tokens("piece"))
    toks = tokens("piece")
    tags = F.transform(toks, lambda t, i: F.when((F.col("role") == "assistant") & (i >= F.col("lead")), 1).otherwise(0))
    return V.encode(rows, ["conv_id", "turn"], toks, vocab, tags=tags, carry=["start"])


def cut_chat_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``conv_id, ids, tags``: conversations cut to ``CHAT_LIMIT`` tokens."""
    rows = pieces(spark, folder)
    return chat_rows(rows, "conv_id", "turn", V.build_vocab(rows, tokens("piece")), CHAT_LIMIT)


@query("training_lengths", f"""
    WITH {_CHAT_TOKENS_SQL}
    SELECT conv_id, least(count(*), {CUTOFF}) AS n_tokens,
        CAST(sum(CASE WHEN learnt AND loc <= {CUTOFF} THEN 1 ELSE 0 END) AS BIGINT) AS n_supervised,
        count(*) > {CUTOFF} AS truncated FROM placed GROUP BY conv_id""")
def training_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return chat_token_counts(pieces(spark, folder), "conv_id", CUTOFF)


@query("mask_pad", f"""
    WITH {_CHAT_IDS_SQL},
    rows AS (SELECT conv_id, list(id ORDER BY loc) AS l FROM coded WHERE loc <= {CHAT_LIMIT}
        GROUP BY conv_id),
    ended AS (SELECT conv_id, list_append(l, 2)[1:{CHAT_LIMIT}] AS l FROM rows),
    labels AS (SELECT conv_id, l, {padded_sql('l', str(CHAT_LIMIT), -100)} AS kept FROM ended)
    SELECT conv_id, len(list_filter(l, lambda x: x <> 2)) AS by_token, len(l) AS by_attention,
        md5({joined_sql('list_transform(kept, lambda x: CASE WHEN x = 2 THEN -100 ELSE x END)')})
            AS token_md5,
        md5({joined_sql('kept')}) AS attention_md5 FROM labels""")
def mask_pad(spark: SparkSession, folder: str) -> DataFrame:
    """The end token is also the padding, as where a tokenizer has no padding token of its own."""
    ended = cut_chat_ids(spark, folder).withColumn(
        "ids", F.concat("ids", F.array(F.lit(V.EOS)))
    )
    fitted = ended.select(
        "conv_id", M.fit("ids", CHAT_LIMIT, V.EOS).alias("_ids"),
        M.attention("ids", CHAT_LIMIT).alias("_mask"),
    )
    labels = fitted.select(
        "conv_id", M.mask_pad("_ids", V.EOS).alias("_t"),
        M.mask_pad("_ids", V.EOS, "attention", "_mask").alias("_a"),
    )
    return labels.select(
        "conv_id", M.supervised("_t").cast("bigint").alias("by_token"),
        M.supervised("_a").cast("bigint").alias("by_attention"),
        F.md5(M.joined("_t")).alias("token_md5"), F.md5(M.joined("_a")).alias("attention_md5"),
    )


@query("mask_completion", f"""
    WITH {_CHAT_IDS_SQL}
    SELECT conv_id, home AS turn,
        CAST(sum(CASE WHEN loc > last_mark THEN 1 ELSE 0 END) AS BIGINT) AS after_last,
        CAST(sum(CASE WHEN loc > first_mark THEN 1 ELSE 0 END) AS BIGINT) AS after_first,
        md5(string_agg(CASE WHEN loc > last_mark THEN id ELSE -100 END, ' ' ORDER BY loc))
            AS last_md5,
        md5(string_agg(CASE WHEN loc > first_mark THEN id ELSE -100 END, ' ' ORDER BY loc))
            AS first_md5
    FROM coded JOIN marks USING (conv_id) GROUP BY conv_id, home""")
def mask_completion(spark: SparkSession, folder: str) -> DataFrame:
    """Labels behind the conversation's last, or first, response marker, message by message."""
    rows = pieces(spark, folder)
    vocab = V.build_vocab(rows, tokens("piece"))
    coded = V.encode(rows, ["conv_id", "turn"], tokens("piece"), vocab, carry=["start"])
    mark = [r.id for r in vocab.filter(F.col("token") == RESPONSE_MARK).select("id").collect()] or [-1]
    labels = completion.completion_labels(coded, "conv_id", "turn", "start", "ids", mark, {"_l": "last", "_f": "first"})
    return labels.select(
        "conv_id", "turn", M.supervised("_l").cast("bigint").alias("after_last"),
        M.supervised("_f").cast("bigint").alias("after_first"),
        F.md5(M.joined("_l")).alias("last_md5"), F.md5(M.joined("_f")).alias("first_md5"),
    )


_BYTE_MARK = "<|im_end|>\n<|im_start|>assistant\n"


@query("mask_completion_bytes", """
    WITH msgs AS (SELECT conv_id, turn, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS piece FROM conversations),
    whole AS (SELECT conv_id, string_agg(piece, '' ORDER BY turn) AS t, '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS mark
              FROM msgs GROUP BY conv_id),
    cut AS (SELECT conv_id, strlen(t) AS n_bytes, CASE WHEN contains(t, mark) THEN split_part(t, mark, 1) END AS before,
                   reverse(split_part(reverse(t), reverse(mark), 1)) AS after, strlen(mark) AS m FROM whole)
    SELECT conv_id, CAST(n_bytes AS BIGINT) AS n_bytes,
        CAST(CASE WHEN before IS NULL THEN 0 ELSE strlen(after) END AS BIGINT) AS after_last,
        CAST(CASE WHEN before IS NULL THEN 0 ELSE n_bytes - strlen(before) - m END AS BIGINT) AS after_first
    FROM cut""")
def mask_completion_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """A marker of 33 ids that begins in one message's row and ends in the next one's."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", chatml_piece("role", "text").alias("piece"))
    placed = completion.with_starts(rows, "conv_id", "turn", F.octet_length("piece"))
    coded = placed.withColumn("ids", V.encode_with(V.utf8_bytes, "piece"))
    wanted = {"last": "last", "first": "first"}
    coded = completion.completion_labels(coded, "conv_id", "turn", "start", "ids", list(_BYTE_MARK.encode()), wanted)
    return coded.groupBy("conv_id").agg(
        F.sum(F.size("ids")).alias("n_bytes"), F.sum(M.supervised("last")).alias("after_last"), F.sum(M.supervised("first")).alias("after_first")
    )


@query("mask_assistant", f"""
    WITH {_CHAT_IDS_SQL}
    SELECT conv_id, home AS turn, CAST(sum(CASE WHEN learnt THEN 1 ELSE 0 END) AS BIGINT) AS supervised,
        count(*) AS n_tokens,
        md5(string_agg(CASE WHEN learnt THEN id ELSE -100 END, ' ' ORDER BY loc)) AS labels_md5
    FROM coded GROUP BY conv_id, home""")
def mask_assistant(spark: SparkSession, folder: str) -> DataFrame:
    labels = message_ids(spark, folder).select(
        "conv_id", "turn", "ids", M.mask_flagged("ids", "tags").alias("_l")
    )
    return labels.select(
        "conv_id", "turn", M.supervised("_l").cast("bigint").alias("supervised"),
        F.size("ids").cast("bigint").alias("n_tokens"), F.md5(M.joined("_l")).alias("labels_md5"),
    )


@query("supervision_report", f"""
    WITH {_CHAT_IDS_SQL},
    rows AS (SELECT conv_id, count(*) AS n, count(*) AS pad,
        sum(CASE WHEN loc > last_mark THEN 1 ELSE 0 END) AS completion,
        sum(CASE WHEN learnt THEN 1 ELSE 0 END) AS assistant
        FROM coded JOIN marks USING (conv_id) GROUP BY conv_id),
    modes AS (SELECT unnest(['pad', 'completion', 'assistant']) AS mode,
        unnest([pad, completion, assistant]) AS s, n FROM rows)
    SELECT mode, count(*) AS n_rows, CAST(sum(CASE WHEN s = 0 THEN 1 ELSE 0 END) AS BIGINT)
            AS unsupervised_rows, CAST(sum(s) AS BIGINT) AS supervised_tokens,
        round(sum(s) / sum(n), 6) AS supervised_share FROM modes GROUP BY mode""")
def supervision_report(spark: SparkSession, folder: str) -> DataFrame:
    """Whole conversations, from where their pieces and markers stand: no ids are needed for it."""
    rows = pieces(spark, folder)
    last = F.max(F.array_max(F.transform(
        tokens("piece"), lambda t, i: F.when(t == RESPONSE_MARK, F.col("start") + i)
    )))
    learnt = F.when(F.col("role") == "assistant", F.greatest(F.col("n_tokens") - F.col("lead"), F.lit(0)))
    counted = rows.groupBy("conv_id").agg(
        F.sum("n_tokens").alias("n"), last.alias("_last"),
        F.coalesce(F.sum(learnt), F.lit(0)).alias("assistant"),
    )
    behind = F.coalesce(F.col("n") - F.col("_last") - 1, F.lit(0))
    counted = counted.withColumn("completion", behind).withColumn("pad", F.col("n"))
    return metrics.supervision_totals(counted, "n", ["pad", "completion", "assistant"])


@query("masked_accuracy_arrays", f"""
    WITH {_CHAT_IDS_SQL},
    guessed AS (SELECT conv_id, id, learnt, loc > 1 AND learnt AS valid,
        lag(id) OVER (PARTITION BY conv_id ORDER BY loc) AS guess FROM coded)
    SELECT conv_id, CAST(sum(CASE WHEN valid AND guess = id THEN 1 ELSE 0 END) AS BIGINT) AS correct,
        CAST(sum(CASE WHEN valid THEN 1 ELSE 0 END) AS BIGINT) AS valid,
        round(sum(CASE WHEN valid AND guess = id THEN 1 ELSE 0 END)
            / nullif(sum(CASE WHEN valid THEN 1 ELSE 0 END), 0), 6) AS accuracy
    FROM guessed GROUP BY conv_id""")
def masked_accuracy_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """A model that always repeats the token before, scored against the next label.

    A message's first token is markup and never supervised, so its messages can be scored apart.
    """
    rows = message_ids(spark, folder).withColumn("labels", M.mask_flagged("ids", "tags"))
    return metrics.masked_accuracy_arrays(rows, "ids", "labels", ["conv_id"], shift=1)


# --- all steps together ---------------------------------------------------------------------------

_TRAINING_SET_SQL = f"""
    WITH clean AS (SELECT length(CAST(conv_id AS VARCHAR)) || ':' || conv_id || ','
            || length(CAST(turn AS VARCHAR)) || ':' || turn AS key, * FROM ({CHAT_SQL})
        WHERE system NOT IN ({NA_SQL}) AND prompt NOT IN ({NA_SQL}) AND answer NOT IN ({NA_SQL})),
    ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || key)) AS rank,
        count(*) OVER () AS n FROM clean),
    parts AS (SELECT *, CASE WHEN rank <= floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split
        FROM ranked),
    sides AS (SELECT key, split, unnest(['system', 'user', 'assistant']) AS role,
        unnest([system, prompt, answer]) AS text, unnest([1, 2, 3]) AS side FROM parts),
    all_toks AS (SELECT key, split, role, side, unnest(t) AS token, generate_subscripts(t, 1) AS p
        FROM (SELECT *, {tokens_sql("'<|im_start|>' || role || chr(10) || text || '<|im_end|>'")} AS t
            FROM sides)),
    toks AS (SELECT token FROM all_toks WHERE split = 'train'), {vocab_sql('toks')},
    placed AS (SELECT key, coalesce(id, 1) AS id, role = 'assistant' AND p > 1 AS learnt,
        row_number() OVER (PARTITION BY key ORDER BY side, p) AS loc
        FROM all_toks LEFT JOIN vocab USING (token)),
    fitted AS (SELECT key, count(*) AS n_tokens,
        CAST(sum(CASE WHEN learnt THEN 1 ELSE 0 END) AS BIGINT) AS n_supervised,
        md5(string_agg(id, ' ' ORDER BY loc)) AS ids_md5,
        md5(string_agg(CASE WHEN learnt THEN id ELSE -100 END, ' ' ORDER BY loc)) AS labels_md5
        FROM placed WHERE loc <= {CUTOFF} GROUP BY key),
    drawn AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('42:' || key)) AS place,
        count(*) OVER (PARTITION BY split) AS of_split FROM parts),
    megas AS (SELECT *, (place - 1) // (greatest(least(of_split // 8, 50), 1) * 2) AS megabatch
        FROM drawn JOIN fitted USING (key))
    SELECT conv_id, turn, split, n_tokens, n_supervised, ids_md5, labels_md5, megabatch,
        row_number() OVER (PARTITION BY split, megabatch ORDER BY n_tokens DESC, place) AS pos
    FROM megas"""


@query("training_set", _TRAINING_SET_SQL)
def prepared(spark: SparkSession, folder: str) -> DataFrame:
    corpus = chat_corpus(spark, folder).select(
        "conv_id", "turn", "system", F.col("prompt").alias("user"),
        F.col("answer").alias("assistant"),
    )
    rows = training_set(corpus, Settings(key=("conv_id", "turn"), cutoff=CUTOFF))
    return rows.select(
        "conv_id", "turn", "split", "n_tokens",
        M.supervised("labels").cast("bigint").alias("n_supervised"),
        F.md5(M.joined("ids")).alias("ids_md5"), F.md5(M.joined("labels")).alias("labels_md5"),
        "megabatch", "pos",
    )
