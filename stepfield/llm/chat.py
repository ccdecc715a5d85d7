"""Chat formatting with typed content parts, in DataFrame expressions only.

A turn's content is an ordered array of parts (type, text, ref, units). A visitor flattens the parts into one string:
text parts are escaped, every other part becomes an ordered placeholder `<|type_k|>`, and its reference and the number
of tokens it expands to are recorded. `typed_parts` finds the parts of a plain text: links to images, audio and documents, by their
endings. Turns become `<|im_start|>role\\nbody<|im_end|>\\n`.

Escaping is a bijection: in bodies one backslash is put into every `<`, backslashes, `|`, so that no body contains
`<|`, also where a text part meets the next one, as neighbours are joined before they are escaped; in roles `\\`, newline and `<` become `\\s`, `\\n` and `\\l`. Control strings in user text can thus never end a turn.

Defined cases: null text is empty, a null role is the empty role, turns of equal number are ordered by role and body,
repeated rows stay, a null conv_id is a conversation of its own, an empty table gives no rows; further columns are
ignored. A conversation becomes one string, so one conversation must fit in a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
PART = "array<struct<type:string,text:string,ref:string,units:bigint>>"
#: Tokens that a placeholder expands to: a fixed number and a number for each unit (image tiles, audio seconds, pages).
EXPANSION = {"image": (1, 256), "audio": (1, 50), "document": (1, 600)}
#: Endings of links; what a link may hold; what it may end with. A link ends with its ending, or with ?units= and the number of its units; punctuation may
#: follow, but no more of a path.
ENDINGS = {"image": "png|jpg|jpeg|gif|webp", "audio": "mp3|wav|ogg|flac", "document": "pdf|doc|docx|odt"}
_OUTSIDE = r"\x00-\x20<>\"'()\[\]|"
BARE_LINK = rf"https?://[^{_OUTSIDE}]+\.(?:{'|'.join(ENDINGS.values())})(?:\?units=[0-9]{{1,6}})?"
LINK_STOP = rf"[.,;:!?]*(?:[{_OUTSIDE}]|$)"
LINK = rf"{BARE_LINK}(?={LINK_STOP})"
PLACEHOLDER = rf"<\|({'|'.join(EXPANSION)})_[0-9]+\|>"


def text_part(text: Column) -> Column:
    """A content of one text part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("bigint").alias("units"))).cast(PART)


def typed_parts(text: Column) -> Column:
    """A plain text as a content: its links to media, and the text between them."""
    links, between = F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), F.split(text, LINK, -1)
    none = F.lit(None)

    def made(kind: Column, own: Column, ref: Column) -> Column:
        units = F.regexp_extract(ref, r"\?units=([0-9]+)$", 1)
        return F.struct(kind.alias("type"), own.alias("text"), ref.alias("ref"), F.when(units != "", units.cast("bigint")).alias("units"))

    def kind(link: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, ends in ENDINGS.items():
            out = F.when(link.rlike(rf"\.({ends})(\?units=[0-9]+)?$"), name).otherwise(out)
        return out

    def one(piece: Column, i: Column) -> Column:
        plain, link = made(F.lit("text"), piece, none.cast("string")), F.get(links, i)
        return F.when(i < F.size(links), F.array(plain, made(kind(link), none.cast("string"), link))).otherwise(F.array(plain))

    return F.when(F.contains(text, F.lit("://")), F.flatten(F.transform(between, one)).cast(PART)).otherwise(text_part(text))


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")), F.lit("<"), F.lit("\\l"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def _expanded(part: Column) -> Column:
    cost = F.lit(0).cast("bigint")
    for kind, (fixed, unit) in EXPANSION.items():
        cost = F.when(part["type"] == kind, F.lit(fixed) + F.coalesce(part["units"], F.lit(1)) * unit).otherwise(cost)
    return cost.cast("bigint")


def flatten_parts(parts: Column) -> tuple[Column, Column]:
    """The visitor: (body, attachments). Attachments are numbered from 1 in order of appearance within the turn; a part
    of a type not in EXPANSION, or null, is text. Parts are joined around marks, cut at these again and escaped, so text is
    escaped as it stands in the body; a character of the marks' kind within texts is doubled while they are joined."""
    kinds = list(EXPANSION)
    attached = F.filter(parts, lambda p: p["type"].isin(kinds))
    plain = lambda p: F.replace(F.coalesce(p["text"], F.lit("")), F.lit("\x01"), F.lit("\x01t"))
    joined = F.array_join(F.transform(parts, lambda p: F.when(p["type"].isin(kinds), F.lit("\x01p")).otherwise(plain(p))), "")
    pieces = F.transform(F.split(joined, "\x01p", -1), lambda x: escape_text(F.replace(x, F.lit("\x01t"), F.lit("\x01"))))
    marked = F.transform(attached, lambda p, i: F.concat(F.get(pieces, i), F.lit("<|"), p["type"], F.lit("_"), (i + 1).cast("string"), F.lit("|>")))
    whole = F.concat(F.array_join(marked, ""), F.element_at(pieces, -1))
    body = F.when(F.size(parts) == 1, F.when(F.get(parts, F.lit(0))["type"].isin(kinds), whole).otherwise(escape_text(F.coalesce(F.get(parts, F.lit(0))["text"], F.lit(""))))).otherwise(whole)
    records = F.transform(attached, lambda p, i: F.struct((i + 1).cast("int").alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p).alias("tokens")))
    return body, records


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, parts) -> one row per conversation: conv_id, formatted (the training string), mask
    (for each turn the place of its body in it and whether the loss covers it), attachments, expanded_tokens.

    One shuffle, on conv_id; bodies are flattened before it."""
    body, attachments = flatten_parts(F.col("parts"))
    rows = turns.select("conv_id", F.struct("turn", escape_role(F.coalesce("role", F.lit(""))).alias("role"), F.coalesce(body, F.lit("")).alias("body"), F.coalesce(attachments, F.array()).alias("attachments")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    heads = F.transform("ts", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n")))
    step = F.transform("ts", lambda t: F.struct((F.length(t["role"]) + len(START) + 1).cast("bigint").alias("head"), F.length(t["body"]).cast("bigint").alias("size"), (t["role"] == "assistant").alias("loss")))
    mask = F.transform(step, lambda s: F.struct((s["head"] - len(START)).alias("start"), s["size"].alias("length"), s["loss"].alias("loss")))
    made = grouped.select(
        "conv_id",
        F.array_join(F.zip_with(heads, F.col("ts"), lambda h, t: F.concat(h, t["body"], F.lit(END))), "").alias("formatted"),
        mask.alias("mask"),
        F.flatten(F.transform("ts", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.alias("turn_index"), a["ordinal"].alias("ordinal"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
    )
    return made.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """The inverse: conv_id, turns array<struct<role,text,loss>>, parsed from `formatted` with the loss flag of the mask; placeholders
    give way to their attachments' references. A mask's start and length count code points within the
    turn's segment, which begins behind `<|im_start|>`."""
    segments = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)

    def plain(body: Column, refs: Column) -> Column:
        pieces = F.transform(F.split(body, PLACEHOLDER, -1), unescape_text)
        return F.when(F.size(refs) == 0, unescape_text(body)).otherwise(F.concat(F.array_join(F.transform(refs, lambda r, i: F.concat(F.get(pieces, i), r)), ""), F.element_at(pieces, -1)))

    def turn(s: Column, i: Column) -> Column:
        m = F.get(F.col("mask"), i)
        refs = F.transform(F.filter("attachments", lambda a: a["turn_index"] == i), lambda a: F.coalesce(a["ref"], F.lit("")))
        return F.struct(
            unescape_role(F.substring_index(s, "\n", 1)).alias("role"),
            plain(F.substring(s, F.instr(s, "\n") + 1, F.length(s) - F.instr(s, "\n") - len(END)), refs).alias("text"),
            F.when(m["loss"], plain(F.substring(s, (m["start"] + 1).cast("int"), m["length"].cast("int")), refs)).otherwise("").alias("loss"),
        )

    return formatted.withColumn("turns", F.transform(segments, turn))
