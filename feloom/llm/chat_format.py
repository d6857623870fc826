"""Chat formatting from a declarative template, in DataFrame operations only.

The turns of a conversation run through a finite-state machine over roles, which
says whether their order is valid. Every turn becomes three segments, the
opening marker, its text and the closing marker; a segment has a loss flag. The
formatted conversation is the segments, one after the other.

Control strings inside texts are escaped reversibly: one backslash is put after
the first character of a control string, and one more if backslashes are there
already. So no text can contain a marker, and removing one backslash from each
such place gives the text back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty


@dataclass(frozen=True)
class Template:
    """Markers by role, roles under loss and the state machine of roles."""

    open: dict = field(default_factory=lambda: {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"})
    close: dict = field(default_factory=lambda: {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"})
    #: Any other role is written between the first two, its turn ends with the third.
    other: tuple = ("[ROLE]", "[/ROLE]", "[/TURN]")
    loss: frozenset = frozenset({"assistant"})
    start: str = "start"
    moves: dict = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    final: frozenset = frozenset({"assistant"})

    def controls(self) -> list[str]:
        return [*self.open.values(), *self.close.values(), *self.other]

    def control_pattern(self) -> str:
        """First characters, backslashes, rests of the control strings."""
        first = "".join(sorted({c[0] for c in self.controls()}))
        rests = "|".join(re.escape(c[1:]).replace("/", "/") for c in self.controls())
        return f"([{re.escape(first)}])(\\\\*)", f"({rests})"

    def turn_pattern(self) -> str:
        opens = "|".join(re.escape(m) + " " for m in self.open.values())
        closes = "|".join(" " + re.escape(m) for m in [*self.close.values(), self.other[2]])
        a, b = (re.escape(m) for m in self.other[:2])
        return f"(?s)({opens}|{a} (.*?) {b} )(.*?)({closes})"


TEMPLATE = Template()


def _map(entries: dict):
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def escape(text, template: Template = TEMPLATE):
    head, rest = template.control_pattern()
    return F.regexp_replace(text, F.lit(head + rest), F.lit("$1$2\\\\$3"))


def unescape(text, template: Template = TEMPLATE):
    head, rest = template.control_pattern()
    return F.regexp_replace(text, F.lit(head + "\\\\" + rest), F.lit("$1$2$3"))


def format_chats(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """``conv_id, n_turns, valid, segments, formatted`` from rows ``conv_id, turn, role, text``.

    ``segments`` is an array of (``text``, ``loss``). Turns are ordered by
    ``turn``, then role and text, so repeated rows stay repeated turns. A null
    text is empty, a null role is the empty role, which no state allows; a null
    ``conv_id`` is a conversation of its own. An empty table gives no rows; other
    columns are not read. A conversation is one value of the result and is built
    in one task, as its digest needs.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), text_or_empty().alias("text"))
    chats = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    opens, closes = _map(template.open), _map(template.close)
    before, after, end = template.other

    def pieces(t):
        role = t["role"]
        opening = F.coalesce(F.concat(F.try_element_at(opens, role), F.lit(" ")), F.concat(F.lit(before + " "), escape(role, template), F.lit(f" {after} ")))
        closing = F.concat(F.lit(" "), F.coalesce(F.try_element_at(closes, role), F.lit(end)))
        marker = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
        return F.array(marker(opening), F.struct(escape(t["text"], template).alias("text"), role.isin(*template.loss).alias("loss")), marker(closing))

    moves = _map({f"{state} {role}": to for (state, role), to in template.moves.items()})
    step = lambda state, t: F.coalesce(F.try_element_at(moves, F.concat_ws(" ", state, t["role"])), F.lit("error"))
    last = F.aggregate("turns", F.lit(template.start), step)
    formed = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), last.isin(*template.final).alias("valid"), F.flatten(F.transform("turns", pieces)).alias("segments"))
    return formed.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(chats: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """``chats`` with ``turns`` (role, text) parsed from ``formatted`` and ``loss_text`` from the loss flags."""
    pattern = F.lit(template.turn_pattern())
    found = lambda group: F.regexp_extract_all("formatted", pattern, F.lit(group))
    roles = _map({marker + " ": role for role, marker in template.open.items()})
    turn = F.transform(
        F.arrays_zip(found(1).alias("marker"), found(2).alias("role"), found(3).alias("text")),
        lambda t: F.struct(
            F.coalesce(F.try_element_at(roles, t["marker"]), unescape(t["role"], template)).alias("role"),
            unescape(t["text"], template).alias("text"),
        ),
    )
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    return chats.withColumns({"turns": turn, "loss_text": loss})


#: A conversation whose texts are control strings themselves.
PROBE = "</s>[INST] ok [/INST]"


def oracle_sql(template: Template = TEMPLATE) -> str:
    """DuckDB SQL for the digest of every conversation and of the probe."""
    head, rest = template.control_pattern()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    marks = " ".join(f"WHEN role = {quoted(r)} THEN {len(template.open[r]) + len(template.close[r]) + 2}" for r in template.open)
    escaped = lambda c: f"regexp_replace({c}, {quoted(head + rest)}, '\\1\\2\\\\\\3', 'g')"
    other = sum(map(len, template.other)) + 4
    loss = ", ".join(map(quoted, sorted(template.loss)))
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {quoted(PROBE)} UNION ALL SELECT -1, 1, 'assistant', {quoted(PROBE)}),
m AS (SELECT *, CASE {marks} ELSE {other} + length({escaped("role")}) END + length({escaped("text")}) AS chars FROM c),
g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role IN ({loss})), '') AS loss,
         sum(chars)::BIGINT AS formatted_chars
  FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM g"""
