r"""Chat formatting by event-sourced reconstruction (DataFrame operations only).

A log has events (conv_id, seq, msg, kind, role, text).  They are partitioned by
conversation, sorted by sequence, and folded into final messages:

* ``message`` and ``regenerate`` start a message's text anew (a regeneration drops
  what was streamed before),
* ``delta`` adds to it,
* ``edit`` replaces it.

The fold is one per message: the text is what its last resetting event holds,
followed by the later deltas.  Messages keep the place of their first event.  The
template then renders each turn as ``<|im_start|>role\ntext<|im_end|>\n``.

Control strings inside roles and texts are escaped by a backslash (a backslash by
another one), which ``unescape`` takes back, and a line feed inside a role, where the
role's line ends, is written as a backslash and an ``l``.  So the formatted text parses
into exactly the turns that went in and nothing in a role or text can open or close a
turn or move text under another role.

A conversation is one row of the result, so the turns of one meet in one task; what
is folded before that is a message, however many events it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: What begins control strings of common chat templates: never left bare inside a text.
GUARDED = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: The role whose texts carry the loss.
LEARNT = "assistant"


def escape(column):
    out = F.replace(F.coalesce(column, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in GUARDED:
        out = F.replace(out, F.lit(control), F.lit("\\" + control))
    return out


def unescape(column):
    return F.regexp_replace(column, r"(?s)\\(.)", "$1")


def escape_role(column):
    """As ``escape``, without line feeds."""
    return F.replace(escape(column), F.lit("\n"), F.lit("\\l"))


def unescape_role(column):
    # between escaped backslashes, every backslash left begins an escape
    parts = F.split(column, r"\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("\n")), F.lit("\\"), F.lit(""))), "\\")


def fold(events: DataFrame) -> DataFrame:
    """Events (conv_id, seq, msg, kind, role, text) -> conv_id, turns: array of (seq, role, text) by sequence.

    A null text is empty, a null kind a ``message``; an unknown kind raises.  The
    role is that of the message's first event with one, else empty.  Events with
    equal seq are taken in order of kind, role and text (repeated rows each count);
    a null seq comes first.  Other columns are ignored; no events, no rows.
    """
    kind = F.coalesce("kind", F.lit("message"))
    known = F.when(kind.isin("message", "regenerate", "delta", "edit"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown event: "), kind)))
    rows = events.select("conv_id", "msg", F.struct("seq", known.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    messages = rows.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list("e")).alias("log"))
    # what the last resetting event holds and all later deltas, joined once
    resets = F.filter(F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i + 1)), lambda i: i.isNotNull())
    begin = F.greatest(F.coalesce(F.array_max(resets), F.lit(1)), F.lit(1))
    text = F.array_join(F.transform(F.slice("log", begin, F.size("log")), lambda e: e["text"]), "")
    role = F.coalesce(F.get(F.filter("log", lambda e: e["role"].isNotNull()), F.lit(0))["role"], F.lit(""))
    whole = messages.select("conv_id", F.struct(F.col("log")[0]["seq"].alias("seq"), role.alias("role"), text.alias("text"), "msg").alias("turn"))
    return whole.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def events(rows: DataFrame) -> DataFrame:
    """Finished rows (conv_id, turn, role, text) as a log for ``fold``: each row is a ``message`` event of its own message.

    Rows that are equal in all four columns get messages of their own by number, so none is lost.
    """
    own = ["conv_id", "turn", "role", "text"]
    same = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("rows"))
    # equal rows cannot be told apart, so their number among themselves is a key whatever the order
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    return same.select(*own, number.alias("number")).select("conv_id", F.col("turn").alias("seq"), F.struct("turn", "role", "text", "number").alias("msg"), F.lit("message").alias("kind"), "role", "text")


def render(folded: DataFrame) -> DataFrame:
    """conv_id, turns -> conv_id, formatted."""
    turn = F.transform("turns", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n")))
    return folded.select("conv_id", F.array_join(turn, "").alias("formatted"))


def parse(formatted: DataFrame, learnt: str = LEARNT) -> DataFrame:
    """conv_id, formatted -> conv_id, formatted, turns: array of (role, text, loss), read back from the output.

    The opening control string occurs only where a turn begins, since roles and
    texts are escaped, and a role ends with the first line feed.  loss marks the
    turns under the loss mask.
    """
    # a bare control string has no escaping backslash before its "<|"
    parts = F.filter(F.split("formatted", r"(?<=^|\n)(?<!\\)<\|im_start\|>"), lambda p: p != "")
    body = F.transform(parts, lambda p: F.substring(p, F.lit(1), F.char_length(p) - len(END) - 1))

    def turn(b):
        line = F.locate("\n", b)
        role = unescape_role(F.substring(b, F.lit(1), line - 1))
        return F.struct(role.alias("role"), unescape(F.substring(b, line + 1, F.char_length(b))).alias("text"), (role == learnt).alias("loss"))

    return formatted.select("conv_id", "formatted", F.transform(body, turn).alias("turns"))


def digests(parsed: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what ``parse`` read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(text: str) -> str:
    out = f"replace({text}, chr(92), chr(92) || chr(92))"
    for control in GUARDED:
        out = f"replace({out}, '{control}', chr(92) || '{control}')"
    return out


#: DuckDB SQL of ``op8_chat_formatting``.
ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = '{LEARNT}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{LEARNT}'), '')) AS loss_sha256,
  sum({len(START) + len(END) + 2} + length({_sql_escape("role")}) + length(role) - length(replace(role, chr(10), '')) + length({_sql_escape("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
