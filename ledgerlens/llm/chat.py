"""Chat formatting of conversations with typed content parts.

A message's content is an array of parts: text, image, audio or document.  A visitor
flattens the parts in order: text is written with its control strings escaped, every other
part becomes a placeholder, and its reference and expanded token count are recorded.  The
template marks turns:

    <|im_start|>role\\ncontent<|im_end|>\\n

Escaping puts one more backslash between ``<`` and ``|`` wherever only backslashes stand
between them; no escaped text holds ``<|``, and taking one backslash away gives the text
back.  Roles are URL-encoded, so a role never ends its line.

Everything is DataFrame functions: one shuffle by conversation, a running sum of lengths
that places each part, and one aggregate that puts the parts together; the work is linear in
the parts but for sorting.  A conversation is
one output value, so its turns meet in one task; there is no other limit on them.

Edge cases: a null text is empty and a null role is the empty role; null parts and parts
of unknown kind without text are skipped (with text, they are text); rows of one turn go by
role, then content, and repeated rows are turns of their own; a null turn comes first; rows
with a null conversation id are one conversation; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"

IMAGE_PATCH = 28                 # pixels a side that one token stands for
IMAGE_TOKENS = 256               # for an image of unknown size
AUDIO_TOKENS_SECOND = 25
DOCUMENT_TOKENS_PAGE = 512

#: The content of a message; ``width`` and ``height`` in pixels, ``seconds`` of audio, ``pages``.
PARTS = "array<struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    """Text without ``<|``; :func:`unescape` gives it back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def text_parts(text: Column) -> Column:
    """The content of a message that is one text."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text.cast("string"), F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("width"),
                            F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"),
                            F.lit(None).cast("int").alias("pages"))).cast(PARTS)


def _tokens(part: Column) -> Column:
    """Tokens that the placeholder of a part expands to."""
    patches = F.ceil(part["width"] / IMAGE_PATCH) * F.ceil(part["height"] / IMAGE_PATCH)
    return F.greatest(F.lit(1).cast("long"), F.when(part["kind"] == "image", F.coalesce(patches, F.lit(IMAGE_TOKENS)))
                      .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS_SECOND))
                      .otherwise(F.coalesce(part["pages"], F.lit(1)) * DOCUMENT_TOKENS_PAGE).cast("long"))


def visit(parts: Column) -> Column:
    """Flattened parts, in order: ``struct<render, kind, uri, n_tokens>``; kind ``text`` or that
    of an attachment."""
    attached = ("image", "audio", "document")
    known = F.filter(parts, lambda p: p.isNotNull() & (F.coalesce(p["kind"].isin(*attached), F.lit(False)) | p["text"].isNotNull()))

    def one(p: Column) -> Column:
        is_text = ~F.coalesce(p["kind"].isin(*attached), F.lit(False))
        return F.struct(F.when(is_text, escape(p["text"])).otherwise(F.concat(F.lit("<|"), p["kind"], F.lit("|>"))).alias("render"),
                        F.when(is_text, F.lit("text")).otherwise(p["kind"]).alias("kind"), p["uri"].alias("uri"),
                        F.when(~is_text, _tokens(p)).alias("n_tokens"))

    return F.coalesce(F.transform(known, one), F.array().cast("array<struct<render:string,kind:string,uri:string,n_tokens:bigint>>"))


def format_chat(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                parts_col: str | None = None, text_col: str = "text") -> DataFrame:
    """Per conversation: ``conv_id, formatted, loss_spans, attachments, expanded_tokens``.

    ``loss_spans`` are the texts of assistant turns as ``struct<start, length>`` in characters
    of ``formatted``, in order; ``attachments`` are ``struct<ordinal, turn, kind, uri, n_tokens>``
    in the order of their placeholders, ordinals from 0.
    """
    parts = F.col(parts_col).cast(PARTS) if parts_col else text_parts(F.col(text_col))
    turns = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), visit(parts).alias("parts"))
    head = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"))
    null = F.lit(None)
    mark = lambda kind, text: F.array(F.struct(text.alias("render"), F.lit(kind).alias("kind"), null.cast("string").alias("uri"),
                                               null.cast("long").alias("n_tokens")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", F.array_join(F.transform("parts", lambda p: p["render"]), ""))
    # A turn's pieces: its head, its parts, its end; a running sum of their lengths places each.
    pieces = (turns.select("*", F.row_number().over(order).alias("place"))
              .select("conv_id", "turn", "role", "place",
                      F.posexplode(F.concat(mark("head", head), "parts", mark("end", F.lit(END)))).alias("nth", "piece"))
              .select("conv_id", "turn", "role", "place", "nth", "piece.*", F.length("piece.render").cast("long").alias("length")))
    before = Window.partitionBy("conv_id").orderBy("place", "nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("start", F.sum("length").over(before) - F.col("length"))
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "place", "nth", "render", "kind", "start", "length", (F.col("role") == ASSISTANT).alias("loss"), "turn", "uri", "n_tokens"))).alias("pieces"))
    attached = F.filter("pieces", lambda p: ~p["kind"].isin("head", "text", "end"))
    return grouped.select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p["render"]), "").alias("formatted"),
        F.transform(F.filter("pieces", lambda p: (p["kind"] == "text") & p["loss"]),
                    lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"))).alias("loss_spans"),
        F.transform(attached, lambda a, i: F.struct(i.alias("ordinal"), a["turn"].alias("turn"), a["kind"].alias("kind"),
                                                    a["uri"].alias("uri"), a["n_tokens"].alias("n_tokens"))).alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]).alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``, unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")
    return F.transform(blocks, lambda b: F.struct(
        F.url_decode(F.substring_index(b, "\n", 1)).alias("role"),
        unescape(F.substring(b, F.locate("\n", b) + 1, F.length(b) - F.locate("\n", b) - len(END))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, each read back from its text and loss spans."""
    texts = formatted.select("*", read_turns(F.col("formatted")).alias("read"),
                             F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    return texts.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"),
               256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
