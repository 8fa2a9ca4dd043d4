"""Chat formatting: conversations as one string each, with a loss mask, attachments as placeholders, and a way back.

A turn is a list of typed parts. A visitor says for each type of part what it writes, how many tokens it expands to, and
which attachment it refers to; `visit` walks the parts in order. Attachments become numbered placeholders. The template is

    <turn:ROLE>TEXT</turn>

followed by a line feed. Every control string starts with `<`, and no text can hold one: `&`, `<` and (in roles) `>` are
written as `&amp;`, `&lt;` and `&gt;`, which reads back exactly. The loss mask lists the places of assistant texts,
without their placeholders.

Turns are ordered by turn (null first), then role, then text. Rows of a conversation are numbered and added up by a sorted
window and gathered once at the end, where the result is one row by definition.

Defined cases: a null text is empty, a null role is the empty role; a null conv_id is a conversation of its own; repeated
rows are turns of their own; parts of an unknown type write nothing but a placeholder of one token; an empty table gives no
rows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A part: its type, text (of text parts), reference (of the others) and size: pixels, seconds or pages.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    for written, meant in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(written), F.lit(meant))
    return text


class PartVisitor:
    """What each type of part turns into. Override a method to change one type; add one to `kinds` for a new type."""

    tile, tile_tokens, audio_rate, page_tokens = 512, 170, 25, 600

    def text(self, part: Column) -> tuple[Column, Column]:
        """The written text and its tokens, counted later by a tokenizer: none here."""
        return escape(F.coalesce(part["text"], F.lit(""))), F.lit(0)

    def image(self, part: Column) -> tuple[Column, Column]:
        across, down = (F.ceil(F.coalesce(part[side], F.lit(self.tile)) / self.tile) for side in ("width", "height"))
        return F.lit("image"), across * down * self.tile_tokens

    def audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit("audio"), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.audio_rate)

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit("document"), F.coalesce(part["pages"], F.lit(1)) * self.page_tokens

    def unknown(self, part: Column) -> tuple[Column, Column]:
        return F.lit("other"), F.lit(1)

    kinds = ("image", "audio", "document")

    def visit(self, part: Column, number: Column) -> Column:
        """struct(written, is_text, ref, tokens) of one part; number counts the attachments of the turn."""
        written, tokens = self.unknown(part)
        for kind in self.kinds:
            name, size = getattr(self, kind)(part)
            written, tokens = F.when(part["type"] == kind, name).otherwise(written), F.when(part["type"] == kind, size).otherwise(tokens)
        text, text_tokens = self.text(part)
        is_text = F.coalesce(part["type"] == "text", F.lit(False))
        placeholder = F.concat(F.lit("<"), written, F.lit(":"), number.cast("string"), F.lit(">"))
        return F.struct(
            F.when(is_text, text).otherwise(placeholder).alias("written"), is_text.alias("is_text"),
            F.when(~is_text, part["ref"]).alias("ref"), F.when(is_text, text_tokens).otherwise(tokens).cast("long").alias("tokens"),
        )


def text_parts(text: Column) -> Column:
    """A turn that is one text."""
    names = [("text", text), *[(n, F.lit(None)) for n in ("ref", "width", "height", "seconds", "pages")]]
    return F.array(F.struct(F.lit("text").alias("type"), *[c.alias(n) for n, c in names])).cast(f"array<{PART}>")


def format_chat(turns: DataFrame, parts: Column | None = None, visitor: PartVisitor | None = None) -> DataFrame:
    """turns: conv_id, turn, role, and text or parts (array of PART). One row a conversation: conv_id, n_turns, formatted,
    loss (places in formatted: start, end), attachments (turn's place, number, ref, tokens), tokens of attachments."""
    visitor = visitor or PartVisitor()
    given = F.coalesce(parts if parts is not None else text_parts(F.coalesce("text", F.lit(""))), F.array().cast(f"array<{PART}>"))
    number = lambda i: F.size(F.filter(F.slice("parts", 1, i + 1), lambda p: ~F.coalesce(p["type"] == "text", F.lit(False))))
    role = F.coalesce("role", F.lit(""))
    flat = turns.select("conv_id", "turn", role.alias("role"), given.alias("parts")).withColumn(
        "visited", F.transform("parts", lambda p, i: visitor.visit(p, number(i)))
    )
    head = F.concat(F.lit("<turn:"), escape_role(F.col("role")), F.lit(">"))
    body = F.array_join(F.transform("visited", lambda v: v["written"]), "")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    placed = (
        flat.select("conv_id", "turn", "role", "visited", head.alias("head"), body.alias("body"))
        .withColumn("whole", F.concat("head", "body", F.lit("</turn>\n")))
        .withColumn("at", F.row_number().over(order) - 1)
        .withColumn("start", F.sum(F.length("whole")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("whole"))
    )
    # places of the parts in the turn: all that stands before them
    before = lambda i: F.length(F.array_join(F.transform(F.slice("visited", 1, i), lambda v: v["written"]), ""))
    origin = F.col("start") + F.length("head")
    spans = F.transform("visited", lambda v, i: F.struct(
        (origin + before(i)).alias("start"), (origin + before(i) + F.length(v["written"])).alias("end"), v["is_text"].alias("is_text")
    ))
    masked = F.when(F.col("role") == ASSISTANT, F.filter(spans, lambda s: s["is_text"])).otherwise(F.filter(spans, lambda s: F.lit(False)))
    refs = F.filter(F.transform("visited", lambda v, i: F.struct(v["is_text"], number_of(v).alias("number"), v["ref"], v["tokens"])), lambda v: ~v["is_text"])
    turn = F.struct("at", "whole", F.transform(masked, lambda s: F.struct(s["start"], s["end"])).alias("loss"), refs.alias("refs"))
    gathered = placed.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    attachments = F.flatten(F.transform("turns", lambda t: F.transform(
        t["refs"], lambda r: F.struct(t["at"].alias("turn"), r["number"].alias("number"), r["ref"].alias("ref"), r["tokens"].alias("tokens"))
    )))
    return gathered.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["whole"]), "").alias("formatted"),
        F.flatten(F.transform("turns", lambda t: t["loss"])).alias("loss"), attachments.alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def number_of(visited: Column) -> Column:
    """The number in a placeholder."""
    return F.regexp_extract(visited["written"], r":(\d+)>$", 1).try_cast("int")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id and turns (role, text): what format_chat() wrote of turns without attachments."""
    pieces = F.filter(F.split("formatted", "</turn>\n"), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len("<turn:") + 1)), ">", 1)).alias("role"),
        unescape(F.substr(p, F.locate(">", p) + 1)).alias("text"),
    ))
    return formatted.select("*", turns.alias("turns"))


def chat_report(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from the output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    back = read_back(format_chat(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    loss = F.array_join(learned, "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
