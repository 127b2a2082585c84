"""Chat formatting of messages with typed content parts.

A message is an array of parts (kind, text, ref, width, height, units). A visitor flattens
the parts in order: text is kept, and an image, audio or document part becomes a numbered
placeholder; its reference and the number of tokens it expands to are recorded. A turn is
written as `<|im_start|>role`, a line feed, the content, `<|im_end|>` and a line feed.

Control strings inside contents are escaped by one more backslash in every `<`, backslashes,
`|`, so that no `<|` is left; roles escape backslashes, line feeds and `<|`. Both are undone
exactly when the output is read back.

Formatting works row by row without a shuffle. A whole conversation is the concatenation of
its segments by turn; reading back sorts segments by conversation and turn and streams over
them with running digests, so that a conversation of any length needs only constant memory.

Only the three known kinds name their placeholder; a part of any other kind becomes an
`attachment`, whose kind the recorded reference still tells, so no kind can write a turn.

Defined cases: null text or null parts is an empty content; a null role is the empty role;
rows with equal turns are ordered by their segments; a null conv_id is a conversation of its
own; null turns come first. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:long,height:long,units:long>"
#: fixed values: placeholder names and expansion of the attachment kinds
IMAGE_TILE = 28
AUDIO_UNITS_PER_TOKEN = 40
DOCUMENT_UNITS_PER_TOKEN = 4
KINDS = ("image", "audio", "document")
OTHER_KIND = "attachment"
START, END = "<|im_start|>", "<|im_end|>"

_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"<\\(\\*)\|")


def text_parts(text: Column) -> Column:
    """Parts of a plain text message."""
    nothing = F.lit(None)
    part = F.struct(
        F.lit("text").alias("kind"),
        text.alias("text"),
        *(nothing.cast(t).alias(n) for n, t in (("ref", "string"), ("width", "long"), ("height", "long"), ("units", "long"))),
    )
    return F.array(part).cast(f"array<{PART}>")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _escape_role(role: Column) -> Column:
    plain = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.replace(plain, F.lit("<|"), F.lit("<\\|"))


def _role_back(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def _expanded(part: Column) -> Column:
    """Tokens an attachment takes in the model's input; unknown sizes count as one token."""
    tiles = F.ceil(part["width"] / IMAGE_TILE) * F.ceil(part["height"] / IMAGE_TILE)
    counted = (
        F.when(part["kind"] == "image", tiles)
        .when(part["kind"] == "audio", F.ceil(part["units"] / AUDIO_UNITS_PER_TOKEN))
        .when(part["kind"] == "document", F.ceil(part["units"] / DOCUMENT_UNITS_PER_TOKEN))
    )
    return F.greatest(F.lit(1), F.coalesce(counted, F.lit(1))).cast("long")


def _visit(state: Column, part: Column) -> Column:
    is_text = F.coalesce(part["kind"], F.lit("text")) == "text"
    name = F.when(part["kind"].isin(*KINDS), part["kind"]).otherwise(OTHER_KIND)
    holder = F.concat(F.lit("<|"), name, F.lit("_"), (F.size(state["refs"]) + 1).cast("string"), F.lit("|>"))
    ref = F.struct(
        (F.size(state["refs"]) + 1).alias("number"), part["kind"].alias("kind"), part["ref"].alias("ref"), _expanded(part).alias("tokens")
    )
    return F.struct(
        F.concat(state["content"], F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(holder)).alias("content"),
        F.when(is_text, state["refs"]).otherwise(F.concat(state["refs"], F.array(ref))).alias("refs"),
    )


def format_chat(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One segment for each row of `messages` (conv_id, turn, role, parts).

    segment: the formatted turn; loss_start, loss_length: code points of the segment under
    the loss mask, the content of `trained_role`; attachments: (number in the turn, kind,
    ref, tokens); expanded_tokens: their sum.
    """
    refs = "array<struct<number:int,kind:string,ref:string,tokens:long>>"
    start = F.struct(F.lit("").alias("content"), F.array().cast(refs).alias("refs"))
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(START), _escape_role(role), F.lit("\n"))
    flat = messages.select(
        "conv_id",
        "turn",
        role.alias("role"),
        head.alias("head"),
        F.aggregate(F.coalesce("parts", F.array().cast(f"array<{PART}>")), start, _visit).alias("flat"),
    )
    trained = F.col("role") == trained_role
    return flat.select(
        "conv_id",
        "turn",
        F.concat("head", "flat.content", F.lit(END), F.lit("\n")).alias("segment"),
        F.when(trained, F.length("head")).otherwise(0).alias("loss_start"),
        F.when(trained, F.length("flat.content")).otherwise(0).alias("loss_length"),
        F.col("flat.refs").alias("attachments"),
        F.aggregate("flat.refs", F.lit(0).cast("long"), lambda n, r: n + r["tokens"]).alias("expanded_tokens"),
    )


class _Reader:
    """Digests of one conversation, fed segment by segment."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.chars, self.tokens, self.refs = conv, 0, 0, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def feed(self, segment: str, start: int, length: int, tokens: int, refs: int) -> None:
        self.chars += len(segment)
        self.tokens += tokens
        self.refs += refs
        for turn in _TURN.finditer(segment):
            self.turns += 1
            content = _ESCAPED.sub(r"<\1|", turn[2])
            self.all.update(f"{_role_back(turn[1])}\n{content}\n".encode())
        masked = _ESCAPED.sub(r"<\1|", segment[start : start + length])
        self.loss += len(masked)
        self.masked.update(masked.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars, self.tokens, self.refs


_DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "expanded_tokens long, n_attachments long"
)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in _DIGEST.split(", ")]
    reader = None
    for batch in batches:
        out = []
        for conv, segment, start, length, tokens, refs in zip(*(batch[c].tolist() for c in batch), strict=True):
            if reader is None or reader.conv != conv:
                if reader is not None:
                    out.append(reader.row())
                reader = _Reader(conv)
            reader.feed(segment, start, length, tokens, refs)
        yield _ids(pd.DataFrame(out, columns=names))
    if reader is not None:
        yield _ids(pd.DataFrame([reader.row()], columns=names))


def _ids(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.assign(conv_id=rows["conv_id"].map(lambda x: None if x == "" else int(x)).astype("Int64"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from the formatted segments alone."""
    named = formatted.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    dealt = named.repartition("conv").sortWithinPartitions("conv", "turn", "segment")
    return dealt.select(
        "conv", "segment", "loss_start", "loss_length", "expanded_tokens", F.size("attachments").alias("refs")
    ).mapInPandas(_read, _DIGEST)
