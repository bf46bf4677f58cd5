"""Chat formatting with built-in functions only: typed content parts, reversible escapes, a loss mask.

A formatted conversation is a row of turns, each `<turn ROLE>BODY</turn>\\n`. In roles and bodies the escape
character `\\` is written `\\b` and the control character `<` is written `\\l`, so that no text can hold a control
string; undoing them in the order `\\l`, `\\b` gives back the text.

A visitor flattens the parts of a turn in order: text is escaped, image, audio and document parts become
`<image N>`, `<audio N>`, `<document N>`, numbered through the conversation, and are noted in `attachments` with
their reference and the tokens they expand to (units times tokens per unit of that type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tokens that one unit (image tile, second of audio, document page) expands to.
TOKENS = {"image": 256, "audio": 25, "document": 512}
PART = "struct<type:string,text:string,ref:string,units:int>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    """`>` ends the head, so that in roles it is `\\g`."""
    return F.replace(escape(c), F.lit(">"), F.lit("\\g"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\g"), F.lit(">")))


def text_parts(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def format_conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None, text_col: str = "text", tokens: dict | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns, loss_spans (0-based start and length in code points of
    each assistant body), attachments (n, type, ref, turn, tokens), media_tokens.

    parts: a column array<struct<type,text,ref,units>>; without it each turn is one text part of text_col. Null texts
    and roles count as empty, an unknown part type as text, null units as one. Turns are in the order of turn_col, then role,
    then body (ties and repeated rows have a defined order; none is dropped); null turns come first; rows of a null
    conv_id form one conversation. Other columns are ignored; no row in, no row out.
    """
    tokens = tokens or TOKENS
    media = list(tokens)
    rate = F.create_map(*[x for k, v in tokens.items() for x in (F.lit(k), F.lit(v))])
    rows = df.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(parts, F.array().cast(f"array<{PART}>")).alias("parts") if parts is not None else text_parts(F.col(text_col)).alias("parts"),
    )
    is_media = lambda p: F.coalesce(p["type"].isin(media), F.lit(False))
    own = F.filter("parts", is_media)
    key = F.to_json("parts")
    order = W.partitionBy("conv_id").orderBy("turn", "role", key)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("n_media", F.size(own)).withColumn("seen", F.coalesce(F.sum("n_media").over(before), F.lit(0)).cast("int")).withColumn("pos", F.row_number().over(order))
    number = lambda i: F.col("seen") + F.size(F.filter(F.slice("parts", 1, i + 1), is_media))
    body = F.when(F.col("n_media") == 0, F.array_join(F.transform("parts", lambda p: escape(F.coalesce(p["text"], F.lit("")))), "")).otherwise(
        F.array_join(F.transform("parts", lambda p, i: F.when(is_media(p), F.concat(F.lit("<"), p["type"], F.lit(" "), number(i).cast("string"), F.lit(">"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))), "")
    )
    rows = (
        rows.withColumn("head", F.concat(F.lit("<turn "), escape_role(F.col("role")), F.lit(">")))
        .withColumn("body", body)
        .withColumn("noted", F.transform(own, lambda p, i: F.struct((F.col("seen") + i + 1).alias("n"), p["type"].alias("type"), p["ref"].alias("ref"), F.col("pos").alias("turn"), (rate[p["type"]] * F.coalesce(p["units"], F.lit(1))).cast("long").alias("tokens"))))
        .withColumn("segment", F.concat("head", "body", F.lit("</turn>\n")))
        .withColumn("start", F.coalesce(F.sum(F.length("segment").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
    )
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start").alias("start"), F.length("body").cast("long").alias("length")))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "segment", span.alias("span"), "noted"))).alias("t"))
    return turns.select(
        "conv_id",
        F.array_join(F.col("t.segment"), "").alias("formatted"),
        F.size("t").cast("long").alias("n_turns"),
        F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.col("t.noted")).alias("attachments"),
    ).withColumn("media_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> from a formatted conversation; placeholders stay in the text."""
    bodies = F.filter(F.split(formatted, "</turn>\n"), lambda s: s != "")
    return F.transform(bodies, lambda s: F.struct(unescape_role(F.substring(s, F.lit(7), F.instr(s, ">") - 7)).alias("role"), unescape(F.substring(s, F.instr(s, ">") + 1, F.length(s))).alias("text")))


def read_back(df: DataFrame) -> DataFrame:
    """The digest columns, read from formatted and loss_spans alone."""
    turns = read_turns(F.col("formatted"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return (
        df.withColumn("turns", turns)
        .withColumn("loss_text", loss)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
            F.length("loss_text").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(15 + length(replace(replace(role || text, '\', '\b'), '<', '\l'))) AS chars FROM t GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
