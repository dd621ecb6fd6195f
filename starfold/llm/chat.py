"""Chat formatting with typed content parts.

A turn is a role and an ordered list of parts: text, image, audio or document.  A visitor over the parts writes texts
escaped and every other part as a placeholder, records its reference, and counts the tokens that the placeholder stands for.
Turn marks contain ``<``, which an escaped text never does, so the output can be read back.  Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

TURN, END = "<|turn|>", "<|end|>"
# Openers of the control strings of common chat templates, ours included, and the escape character; codes have no opener.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"))
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512  # pixels of an image token's side, audio tokens a second, tokens a page


def escaped(text: Column) -> Column:
    """Text without any control string; ``unescaped`` restores it."""
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """Inverse of ``escaped``: the escape character itself comes last, so no code is read twice."""
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """Parts of a turn that is one text."""
    none = lambda kind: F.lit(None).cast(kind)
    part = F.struct(F.lit("text").alias("kind"), text.alias("text"), none("string").alias("ref"), none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages"))
    return F.array(part).cast(PARTS)


def expanded(part: Column) -> Column:
    """Tokens that a placeholder stands for; unknown measures count as the least, 1."""
    at_least_one = lambda c: F.greatest(F.lit(1), F.coalesce(c, F.lit(1))).cast("long")
    image = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    audio, pages = F.ceil(part["seconds"] * AUDIO_RATE), part["pages"] * PAGE_TOKENS
    return F.when(part["kind"] == "image", at_least_one(image)).when(part["kind"] == "audio", at_least_one(audio)).otherwise(at_least_one(pages))


def is_text(part: Column) -> Column:
    """Whether a part is text; a null kind is."""
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def mark(kind: Column) -> Column:
    """Name of a placeholder; a kind that is not known has a prefix, so it cannot be a turn's mark."""
    return F.when(kind.isin("image", "audio", "document"), kind).otherwise(F.concat(F.lit("part:"), escaped(kind)))


def visited(parts: Column) -> tuple[Column, Column]:
    """Body of a turn, and its attachments (kind, ref, tokens) in the order of their placeholders."""
    parts = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())
    body = F.transform(parts, lambda p: F.when(is_text(p), escaped(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), mark(p["kind"]), F.lit("|>"))))
    media = F.transform(F.filter(parts, lambda p: ~is_text(p)), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), expanded(p).alias("tokens")))
    return F.array_join(body, ""), media


def format_turns(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation from (conv_id, turn, role, parts): conv_id, formatted, loss, attachments, expanded_tokens.

    Turns are in the order of ``turn`` (null first), then role and body; repeated rows are repeated turns.  A null role is empty,
    null or empty parts give an empty body, and a null conv_id is one conversation.  ``loss`` lists (start, length) in characters of
    ``formatted``: the bodies of roles in ``trained``, marks excluded.  Where such a body has placeholders they are inside its span.
    A conversation is one output value, so its turns meet in one task; conversations are spread by id.  Other columns are not read.
    """
    body, media = visited(F.col("parts"))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    d = turns.select("conv_id", "turn", role.alias("__role"), body.alias("__body"), media.alias("__media"))
    head = F.concat(F.lit(TURN), F.replace(escaped(F.col("__role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    d = d.withColumns({"__head": head, "__block": F.concat(head, F.col("__body"), F.lit(END))})
    before = W.partitionBy("conv_id").orderBy("turn", "__role", "__body", F.to_json("__media")).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("__start", F.coalesce(F.sum(F.char_length("__block").cast("long")).over(before), F.lit(0)))
    span = F.when(F.col("__role").isin(*trained), F.struct((F.col("__start") + F.char_length("__head")).alias("start"), F.char_length("__body").cast("long").alias("length")))
    rows = d.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("__start").alias("at"), F.col("__block").alias("block"), span.alias("span"), F.col("__media").alias("media")))).alias("__t"))
    loss = F.filter(F.transform("__t", lambda t: t["span"]), lambda s: s.isNotNull())
    media = F.flatten(F.transform("__t", lambda t: t["media"]))
    rows = rows.select("conv_id", F.array_join(F.transform("__t", lambda t: t["block"]), "").alias("formatted"), loss.alias("loss"), media.alias("attachments"))
    return rows.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Format (conv_id, turn, role, text) with each text as one part; null texts are empty."""
    return format_turns(conversations.select("conv_id", "turn", "role", text_part(F.col("text").cast("string")).alias("parts")))


def read_turns(formatted: Column) -> Column:
    """The (role, text) of each turn, read back from a formatted conversation of texts."""
    cut = F.split(formatted, r"<\|turn\|>")
    bodies = F.slice(cut, F.lit(2), F.size(cut))

    def one(body: Column) -> Column:
        body = F.substr(body, F.lit(1), F.char_length(body) - len(END))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescaped(F.replace(role, F.lit("\\n"), F.lit("\n"))).alias("role"), unescaped(F.substr(body, F.char_length(role) + 2)).alias("text"))

    return F.transform(bodies, one)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
