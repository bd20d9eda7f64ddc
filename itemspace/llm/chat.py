"""Chat formatting: event-sourced reconstruction with built-in functions only.

A log row is (conv_id, seq, msg_id, kind, role, text).  ``message``, ``edit``
and ``regenerate`` set a message's text, ``delta`` appends to it.  Rows are
partitioned by conversation and message, sorted by seq and folded: what
counts is the last setting event and the deltas after it.  A message stands
where its first event stands.  Deltas only (a stream without an opening event)
make a message of their own.

Cases: null text is empty, null role is the empty role, null conv_id is one
conversation; events equal in seq are ordered setting first, then by kind, role
and text; repeated ``message`` rows with different msg_id are messages each;
an empty log gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Break every control string inside ``text`` by a backslash after its
    first character; backslashes are doubled, so unescape() restores all."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def messages(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, pos, msg_id, role, text) of the log."""
    ev = F.col("ev")
    folded = (events.select(
        "conv_id", "msg_id",
        F.struct(F.col("seq").alias("seq"), (F.col("kind") == "delta").alias("delta"), F.col("kind").alias("kind"),
                 F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("e"))
        .groupBy("conv_id", "msg_id").agg(F.sort_array(F.collect_list("e")).alias("ev")))
    last = F.array_max(F.transform(ev, lambda e, j: F.when(~F.coalesce(e["delta"], F.lit(False)), j)))
    return folded.select(
        "conv_id", ev[0]["seq"].alias("pos"), "msg_id",
        F.coalesce(F.get(F.filter(F.transform(ev, lambda e: e["role"]), lambda r: r.isNotNull()), F.lit(0)),
                   F.lit("")).alias("role"),
        F.array_join(F.transform(F.slice(ev, F.coalesce(last, F.lit(0)) + 1, F.size(ev)),
                                 lambda e: e["text"]), "").alias("text"))


def render(msgs: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, ``segments`` (text, loss) in order and ``formatted``, their
    concatenation.  The loss mask covers the bodies of ``loss_role``."""
    turn = msgs.select("conv_id", F.struct(
        "pos", "role", "text", "msg_id",
        F.array(
            F.struct(F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(F.col("text")).alias("text"), (F.col("role") == loss_role).alias("loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))).alias("out")).alias("m"))
    return (turn.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
            .select("conv_id", F.flatten(F.transform("ms", lambda m: m["out"])).alias("segments"))
            .select("conv_id", "segments",
                    F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted")))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) in a formatted string."""
    parts = F.filter(F.split(formatted, f"\\Q{END}\\E"), lambda p: p.startswith(START))
    halves = F.transform(parts, lambda p: F.split(p, f"\\Q{SEP}\\E", 2))
    return F.transform(halves, lambda h: F.struct(
        unescape(F.substr(h[0], F.lit(len(START) + 1))).alias("role"), unescape(h[1]).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    return render(messages(events), loss_role)


def digest(chats: DataFrame) -> DataFrame:
    """Per conversation: counts and hashes of what the output holds."""
    turns = chats.select("conv_id", "formatted", loss_text(F.col("segments")).alias("loss"),
                         read_back(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
