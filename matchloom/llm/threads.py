"""Chat formatting by quotation linking.

A line that begins with ``>`` signs is a quotation, as many levels deep as there
are signs. Quoted passages, one per line, are normalised and hashed, and joined
to the message of the same conversation that wrote the line first. A message
answers the message that wrote most of its outermost quoted lines (of several
with as many, the latest). Quotations are taken out of the texts, and the
messages of a conversation are put in reply order: threads by their first
message, in a thread answers after what they answer, then by turn.

Only DataFrame functions are used. Conversations are never gathered: links are
equi-joins on (conversation, hash) with one row per hash on one side, roots and
depths come from pointer doubling in as many rounds as the logarithm of the
longest chain, and positions from ``running_total``, which cuts a long
conversation into slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import column, free_name
from matchloom.operators.ranking import running_total
from matchloom.session import cut_lineage, discard

_SIGNS = r"^((?:[ \t]*>)+)"
_SPACE = r"[\x20\x09-\x0D]+"


def parsed(text: Column) -> Column:
    """Lines as structs: ``level`` of quotation, ``said`` without the signs, ``line`` as it is."""
    def one(line: Column) -> Column:
        signs = F.regexp_extract(line, _SIGNS, 1)
        return F.struct(
            F.regexp_count(signs, F.lit(">")).alias("level"),
            F.substring(line, F.length(signs) + 1, F.length(line)).alias("said"),
            line.alias("line"),
        )

    return F.transform(F.split(text, "\n"), one)


def unquoted(lines: Column, text: Column) -> Column:
    """The text without its quoted lines and the empty lines they leave at its ends."""
    own = F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"])
    return F.when(F.exists(lines, lambda x: x["level"] > 0), F.btrim(F.array_join(own, "\n"), F.lit("\n"))).otherwise(text)


def passages(messages: DataFrame) -> DataFrame:
    """One row per line with a word: conversation, turn, level and hash of the normalised line."""
    said = F.lower(F.btrim(F.regexp_replace(F.col("line.said"), _SPACE, " "), F.lit(" ")))
    return (
        messages.where(F.col("conv").isNotNull() & F.col("turn").isNotNull())
        .select("conv", "turn", F.explode(parsed(F.col("text"))).alias("line"))
        .select("conv", "turn", F.col("line.level").alias("level"), said.alias("said"))
        .where(F.col("said") != "")
        .select("conv", "turn", "level", F.xxhash64("said").alias("hash"))
    )


def replies(messages: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``parent`` and ``n_linked`` of the messages with a linked quotation."""
    found = cut_lineage(passages(messages))
    quoted = found.where("level > 0").select("conv", "hash").distinct()
    first = cut_lineage(
        found.where("level = 0").join(quoted, ["conv", "hash"], "left_semi")
        .groupBy("conv", "hash").agg(F.min("turn").alias("origin"))
    )
    votes = cut_lineage(
        found.where("level > 0")
        .join(first, ["conv", "hash"])
        .where(F.col("origin") < F.col("turn"))
        .select("conv", "turn", "level", "origin")
        .groupBy("conv", "turn", "level", "origin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # the outermost level linked, its most votes, the latest origin: the largest of these triples
    best = F.max(F.struct(-F.col("level"), "n", "origin"))
    out = votes.groupBy("conv", "turn").agg(best.alias("best"), F.sum("n").alias("n_linked"))
    return cut_lineage(out.select("conv", "turn", F.col("best.origin").alias("parent"), "n_linked"))


def roots(links: DataFrame) -> DataFrame:
    """First message (``thread``) and number of steps to it (``depth``) of every message that has a parent."""
    now = cut_lineage(links.select("conv", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = now.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("up").alias("further"), F.col("depth").alias("more"))
        step = cut_lineage(
            now.join(above, (F.col("conv") == F.col("c")) & (F.col("up") == F.col("t")), "left").select(
                "conv",
                "turn",
                F.coalesce("further", "up").alias("up"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.col("further").isNotNull().alias("moved"),
            )
        )
        discard(now)
        now = step.drop("moved")
        now.cut_path = step.cut_path
        if step.where("moved").isEmpty():
            return now.withColumnRenamed("up", "thread")


def reply_order(
    messages: DataFrame,
    out: str = "reply",
    conv: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
) -> DataFrame:
    """The messages with quotations taken out of ``text``, and a struct ``out``.

    ``out`` has ``reply_to`` and ``thread`` (turns), ``depth``, ``position`` in
    the conversation from 1, and the numbers of quoted and of linked lines. A
    message without a linked quotation begins a thread. Rows repeated with
    conversation and turn share their reply and follow each other. A row without
    conversation or turn is not linked and has no position. A null text stays
    null, an empty table empty; other columns pass through.
    """
    at = free_name(messages.columns, out)
    uid = free_name([*messages.columns, at], "_uid")
    lines, quotes = free_name([*messages.columns, at, uid], "_lines"), free_name([*messages.columns, at, uid], "_quotes")
    links = replies(messages.select(column(conv).alias("conv"), column(turn).alias("turn"), column(text).alias("text")))
    threads = links.join(roots(links), ["conv", "turn"])
    threads = cut_lineage(threads.select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), "parent", "n_linked", "thread", "depth"))
    base = messages.withColumn(uid, F.monotonically_increasing_id()).withColumn(lines, parsed(column(text)))
    base = base.withColumn(quotes, F.coalesce(F.size(F.filter(lines, lambda x: x["level"] > 0)), F.lit(0)).cast("long"))
    text_out = unquoted(F.col(lines), column(text))
    placed = cut_lineage(
        base.select(
            F.struct(*[(text_out if c == text else column(c)).alias(c) for c in messages.columns]).alias("row"),
            F.col(uid).alias("uid"),
            F.col(quotes).alias("n_quoted"),
            column(conv).alias("conv"),
            column(turn).alias("turn"),
        )
        .join(threads, (F.col("conv") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
        .select(
            "row", "uid", "n_quoted", "conv", "turn",
            F.col("parent").alias("reply_to"),
            F.coalesce("thread", "turn").alias("thread"),
            F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
            F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        )
    )
    known = F.col("conv").isNotNull() & F.col("turn").isNotNull()
    keyed = placed.where(known).select("conv", "thread", "depth", "turn", "uid")
    numbered = running_total(keyed, ["thread", "depth", "turn", "uid"], ["conv"], out="position").select("uid", "position")
    return placed.join(numbered, "uid", "left").select(
        *[F.col("row")[c].alias(c) for c in messages.columns],
        F.struct("reply_to", "thread", "depth", "position", "n_quoted", "n_linked").alias(at),
    )


def quoting(messages: DataFrame, near: int = 3) -> DataFrame:
    """Messages of ``conv_id``, ``turn``, ``role``, ``text`` made to quote: replies as mail programs write them.

    Every turn above 0 answers one of the ``near`` turns before it, by a rule on
    both numbers, and quotes two of three of its lines; every second turn quotes
    what that one answers one level deeper, every fourth a third one. Of rows
    repeated with conversation and turn the smallest text is quoted. A null text,
    conversation or turn stays as it is, and so does what has nothing to quote.
    """
    said = messages.groupBy(F.col("conv_id").alias("c"), F.col("turn").cast("long").alias("t")).agg(F.min("text").alias("said"))

    def above(turn: Column) -> Column:
        return F.when(turn > 0, turn - 1 - F.pmod(F.col("conv_id") + turn, F.least(turn, F.lit(near))))

    def signed(lines: Column, signs: Column) -> Column:
        return F.transform(lines, lambda x: F.concat(signs, x))

    made = messages.withColumn("up0", F.col("turn").cast("long"))
    quotes = []
    for level in (1, 2, 3):
        made = made.withColumn(f"up{level}", above(F.col(f"up{level - 1}")))
        source = said.select(*[F.col(c).alias(f"{c}{level}") for c in said.columns])
        found = (F.col("conv_id") == F.col(f"c{level}")) & (F.col(f"up{level}") == F.col(f"t{level}"))
        made = made.join(source, found & F.col(f"said{level}").isNotNull(), "left")
        lines, signs = F.filter(F.split(f"said{level}", "\n"), lambda x, i: (i + 1 + F.col("up0")) % 3 != 0), F.lit(">" * level + " ")
        wanted = F.col(f"said{level}").isNotNull() & (F.col("up0") % (1 << (level - 1)) == 0)
        quotes.append(F.when(wanted, signed(lines, signs)).otherwise(F.array().cast("array<string>")))
    text = F.array_join(F.concat(*reversed(quotes), F.array("text")), "\n")
    return made.select("conv_id", "turn", "role", F.when(F.col("text").isNotNull(), text).alias("text"))


def as_chat(messages: DataFrame, out: str = "chat", role: str = "role", text: str = "text") -> DataFrame:
    """Add each message as chat markup: its role on a line of its own, then the text."""
    said = F.concat(F.lit("<|"), F.coalesce(column(role), F.lit("unknown")), F.lit("|>\n"), F.coalesce(column(text), F.lit("")), F.lit("\n"))
    return messages.withColumn(free_name(messages.columns, out), said)
