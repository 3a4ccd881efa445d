"""Chat formatting with typed content parts; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tokens that one unit of an attachment stands for: a tile of an image, a second of audio, a page.
TOKENS_PER_UNIT = {"image": 256.0, "audio": 25.0, "document": 512.0}
PARTS = "array<struct<kind:string,text:string,ref:string,units:double>>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    r"""No `<` is left and every `\` starts a pair: `\b` for itself, `\l` for `<`, `\g` for `>`."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")),
                     F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """The text again: pairs cannot overlap, so they are put back one kind after the other."""
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")),
                     F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text (null: empty) as the one part of a turn."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def visit(parts: Column, turn: Column, per_unit: dict[str, float]) -> tuple[Column, Column]:
    """What each part becomes in the text, and the attachments in the same order.

    Text parts (kind null or `text`) are escaped; any other part leaves a placeholder
    `<kind turn.part>`. Kinds are written in small letters, without anything but a to z; a kind
    without a token count, and null units, count 0 tokens.
    """
    rates = F.create_map(*[F.lit(x) for k, v in sorted(per_unit.items()) for x in (k, v)])
    is_text = lambda p: F.coalesce(p.kind, F.lit("text")) == "text"
    kind = lambda p: F.regexp_replace(F.lower(p.kind), "[^a-z]", "")
    shown = F.concat_ws("", F.transform(parts, lambda p, i: F.when(
        is_text(p), escape(F.coalesce(p.text, F.lit("")))).otherwise(
        F.concat(F.lit("<"), kind(p), F.lit(" "), turn.cast("string"), F.lit("."),
                 i.cast("string"), F.lit(">")))))
    numbered = F.transform(parts, lambda p, i: F.struct(
        turn.cast("int").alias("turn"), i.alias("part"), kind(p).alias("kind"), p.ref.alias("ref"),
        F.coalesce(F.ceil(p.units * F.element_at(rates, kind(p))), F.lit(0)).cast("bigint")
        .alias("tokens"), is_text(p).alias("is_text")))
    attached = F.transform(F.filter(numbered, lambda a: ~a.is_text),
                           lambda a: F.struct(a.turn.alias("turn"), a.part.alias("part"),
                                              a.kind.alias("kind"), a.ref.alias("ref"),
                                              a.tokens.alias("tokens")))
    return shown, attached


def format_chats(turns: DataFrame, per_unit: dict[str, float] | None = None,
                 trained: str = TRAINED) -> DataFrame:
    """One row per conversation from (conv_id, turn, role, parts): conv_id, formatted, loss,
    attachments, attachment_tokens.

    A turn reads `<turn ROLE>BODY</turn>` and a line feed; role and texts are escaped, so every
    `<` of the result belongs to the template. loss holds (start, length) in characters of the
    bodies of role `trained`. attachments holds turn and part number, kind, reference and
    expanded tokens of every part that is not text, in the order of their placeholders.

    Turns are ordered by (turn, role, parts), null first, so ties and repeated rows have a fixed
    order and all are kept. Null role: empty. Null or empty parts: an empty body. A null conv_id
    is a conversation of its own. Other columns are ignored; an empty table gives an empty table.
    One shuffle on conv_id; the rows of one conversation meet because they become one row.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    numbered = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS)).alias("parts")
    ).withColumn("at", F.row_number().over(order) - 1)
    body, attached = visit(F.col("parts"), F.col("at"), per_unit or TOKENS_PER_UNIT)
    head = F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">"))
    shown = numbered.select(
        "conv_id", "at", "role", head.alias("head"), body.alias("body"), attached.alias("attached"))
    piece = F.concat("head", "body", F.lit("</turn>\n"))
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = shown.select(
        "conv_id", "at", "attached", piece.alias("piece"),
        F.coalesce(F.sum(F.length(piece).cast("bigint")).over(before), F.lit(0)).alias("from"),
        F.length("head").cast("bigint").alias("head"), F.length("body").cast("bigint").alias("body"),
        (F.col("role") == trained).alias("trained"))
    gathered = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "at", "piece", "from", "head", "body", "trained", "attached"))).alias("turns"))
    spans = F.transform(
        F.filter("turns", lambda t: t["trained"]),
        lambda t: F.struct((t["from"] + t["head"]).alias("start"), t["body"].alias("length")))
    attachments = F.flatten(F.transform("turns", lambda t: t["attached"]))
    return gathered.select(
        "conv_id", F.concat_ws("", F.transform("turns", lambda t: t["piece"])).alias("formatted"),
        spans.alias("loss"), attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"])
        .alias("attachment_tokens"))


def read_turns(formatted: Column) -> Column:
    """(role, text) of every turn, read back from the formatted text; placeholders left out."""
    raw = F.slice(F.split(formatted, "<turn "), 2, 1 << 30)
    return F.transform(raw, lambda t: F.struct(
        unescape(F.substring_index(t, ">", 1)).alias("role"),
        plain(F.substring_index(F.substr(
            t, F.length(F.substring_index(t, ">", 1)) + 2), "</turn>", 1)).alias("text")))


def plain(body: Column) -> Column:
    """The text of a body: placeholders left out, escapes undone."""
    return unescape(F.regexp_replace(body, "<[^>]*>", ""))


CLOSING = "</turn>\n"


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, in order.

    The text is split into turns once, and each span is taken from the turn whose body it is; the
    places of the turns are added up on the way. Spans that are not whole bodies in order are read
    from the start of the text instead.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).alias("next"),
                     F.array().cast("array<string>").alias("found"))

    def step(acc: Column, turn: Column) -> Column:
        head, span = F.instr(turn, ">"), F.get(loss, acc["next"])
        hit = F.coalesce(span["start"] == acc["at"] + head, F.lit(False))
        text = plain(F.substr(turn, head + 1, span["length"].cast("int")))
        return F.struct(
            (acc["at"] + F.length(turn) + len(CLOSING)).alias("at"),
            F.when(hit, acc["next"] + 1).otherwise(acc["next"]).alias("next"),
            F.when(hit, F.array_append(acc["found"], text)).otherwise(acc["found"]).alias("found"))

    read = F.aggregate(F.split(formatted, CLOSING), start, step, lambda acc: F.when(
        acc["next"] == F.size(loss), F.concat_ws("", acc["found"])))
    return F.coalesce(read, F.concat_ws("", F.transform(loss, lambda s: plain(F.substr(
        formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))))
