r"""Chat formatting of event logs.

A log is partitioned by conversation and sorted by ``seq``.  Events of a turn:

- ``message`` sets its role and text, ``delta`` appends to the text (streaming),
- ``edit`` replaces the text, ``regenerate`` clears it for new deltas,
- ``delete`` removes the turn until a later ``message`` or ``edit``.

So a turn's text is what the events from its last reset on say, joined in order:
no event is folded twice, and a turn of many deltas costs no more than its text.
Conversations are rendered turn by turn as

    <|im_start|>ROLE\nTEXT<|im_end|>\n

Texts and roles are escaped so that no control string of the template, nor of
another common one, can appear in them: a backslash follows every ``\``, every
``<`` before ``|``, ``/``, ``s`` or ``<``, and the bracket of ``[INST]`` and
``[/INST]``; in roles a line feed becomes ``\n``.  ``parse`` undoes this.

Only column expressions, and two shuffles: by turn, then by conversation.  A conversation is one
output string, so it must fit into a row; nothing else is gathered.

Defined results: a null text or role is empty; null events count as messages;
events with equal ``seq`` are ordered by turn, event and text; a repeated row is
a repeated event, so a repeated message changes nothing; turns are ordered by
their number, a null number first; a null ``conv_id`` is a conversation of its
own; conversations whose turns are all deleted have no row; an empty table gives
an empty one; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustweave.llm import spans as S

START, STOP = "<|im_start|>", "<|im_end|>\n"
RESETS = ("message", "edit", "regenerate", "delete")
_CONTROL = r"(\\|<(?=[|/s<])|\[(?=/?INST\]))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    """A pair of backslashes is one; any other backslash was put in."""
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), lambda p: F.replace(
        F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit(""))), "\\")


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def turns(events: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of every turn that is left, from ``conv_id, turn, seq, event, role, text``."""
    event = F.struct(
        F.col("seq"), F.coalesce("event", F.lit("message")).alias("event"), F.col("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    log = events.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(event)).alias("log"))
    # number of the last reset; a log without one starts at its first event
    is_reset = lambda e: e["event"].isin(*RESETS)
    last = F.array_max(F.transform("log", lambda e, i: F.when(is_reset(e), i).otherwise(-1)))
    said = F.filter(F.slice("log", F.greatest(F.col("last"), F.lit(0)) + 1, F.size("log")), lambda e: e["event"] != "regenerate")
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    rows = log.withColumn("last", last)
    return rows.where(F.coalesce(F.get("log", F.col("last"))["event"] != "delete", F.lit(True))).select(
        "conv_id", "turn", F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("")).alias("role"),
        F.array_join(F.transform(said, lambda e: e["text"]), "").alias("text"))


def render(spoken: DataFrame, learned: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss``: the string and the code-point spans to learn from."""
    body = escaped(F.col("text"))
    head = F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"))
    parts = spoken.select("conv_id", F.struct(
        "turn", head.alias("head"), body.alias("body"), (F.col("role") == learned).alias("learn")).alias("part"))
    talk = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(STOP)
    talk = talk.withColumn("ends", S.running(F.transform("parts", size)))
    spans = F.zip_with("parts", "ends", lambda p, e: F.struct(
        (e - len(STOP) - F.length(p["body"])).alias("start"), (e - len(STOP)).alias("end"), p["learn"].alias("learn")))
    loss = F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(STOP))), "")
    return talk.select("conv_id", text.alias("formatted"), loss.alias("loss"))


def numbered(rows: DataFrame) -> DataFrame:
    """A log of ``conv_id, turn, role, text`` in which every row is a message and a turn of its own.

    Rows go by turn (null first), role and text; rows alike in all three may stand in any order.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = F.row_number().over(order).cast("long")
    return rows.select("conv_id", place.alias("turn"), place.alias("seq"), F.lit("message").alias("event"), "role", "text")


def format_chats(events: DataFrame, learned: str = "assistant") -> DataFrame:
    """Formatted conversations of an event log."""
    return render(turns(events), learned)


def parse(formatted: DataFrame) -> DataFrame:
    """``turns`` (role, text) and ``learned`` (texts under the loss mask), read back from the strings."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    turn = lambda p: F.struct(
        unescaped(F.substring_index(body(p), "\n", 1)).alias("role"),
        unescaped(F.substr(body(p), F.length(F.substring_index(body(p), "\n", 1)) + 2)).alias("text"))
    under = S.let(S.blocks(F.col("formatted")), lambda cut: F.transform("loss", lambda s: unescaped(S.between(cut, s["start"], s["end"]))))
    return formatted.select("*", F.transform(pieces, turn).alias("turns"), under.alias("learned"))


def digest(parsed: DataFrame) -> DataFrame:
    """One row per conversation: counts and digests of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    mask = F.array_join("learned", "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(mask).cast("long").alias("loss_chars"), F.sha2(mask, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
