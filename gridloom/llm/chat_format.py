"""Chat formatting: the turns of a conversation as one text with marks, and a loss mask on what the assistant says.

The turns of a conversation are collected as structs and sorted; runs of turns of one role are cut out of the sorted
array as blocks, each between the marks of its role, the texts of its turns parted by a mark of their own. All of it is
Spark expressions on arrays: no Python, no window, one shuffle by conversation. Work is linear in a conversation's length.

Control strings within texts and roles are escaped: a backslash goes in after their first character, and one more where
backslashes already stand there, so no control string is left and taking one backslash out again gives the text back.

The result is an array of segments (``text``, ``loss``), whose texts one after another are the formatted conversation;
``loss`` is true for the texts of assistants alone, never for marks. Marks part any two of these texts.

Contract: turns are in order of ``turn`` (nulls first), equal ones by role and text; a repeated row is a turn of its own;
null texts and roles count as empty; rows with a null ``conv_id`` are one conversation of that id; any other role than
those of the template has a mark that holds its name; an empty table gives an empty result; extra columns are ignored.
A conversation is one row of the result, so it is whole in one task whatever its length; conversations are spread by id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks before and after a block by role, those of a role without marks of its own, and the mark between turns."""

    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[END]")
    between: str = "<sep>"
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        """What stands before or after a mark must never make another mark together with a part of it."""
        whole = [a[0] + b[1:] for a in self.marks for b in self.marks]
        for a in whole:
            for m in self.marks:
                if any(m.startswith(a[k:]) or a[k:].startswith(m) or m.endswith(a[:k]) for k in range(1, len(a))) or a.count("\\"):
                    raise ValueError(f"{a!r} can be mistaken beside {m!r}")

    @property
    def marks(self) -> list[str]:
        return [*(m for pair in self.roles.values() for m in pair), *self.other, self.between]

    def pattern(self, less: str = "") -> str:
        """A mark's first character, ``less`` and any backslashes (two groups), where a mark's rest follows."""
        firsts, rests = ("".join(sorted({re.escape(m[0]) for m in self.marks})), "|".join(sorted({re.escape(m[1:]) for m in self.marks})))
        return rf"([{firsts}]){less}(\\*)(?={rests})"


LLAMA = Template()


def escaped(text: Column, template: Template = LLAMA) -> Column:
    """One more backslash after the first character of each control string, escaped or not."""
    return F.regexp_replace(text, F.lit(template.pattern()), F.lit(r"$1\\$2"))


def unescaped(text: Column, template: Template = LLAMA) -> Column:
    return F.regexp_replace(text, F.lit(template.pattern(r"\\")), F.lit("$1$2"))


def _segment(text: Column, loss: Column | bool = False) -> Column:
    return F.struct(text.alias("text"), (loss if isinstance(loss, Column) else F.lit(loss)).alias("loss"))


def chat_format(turns: DataFrame, template: Template = LLAMA) -> DataFrame:
    """``conv_id``, ``segments`` (array of ``text``, ``loss``) of the conversations of ``turns`` (conv_id, turn, role, text)."""
    empty = F.lit("")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("own"))
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("own")).alias("turns"))
    at = lambda i: F.get("turns", i)["role"]
    # a block begins where the role differs from that of the turn before
    begins = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))
    runs = sorted_.select("conv_id", "turns", begins.alias("begins"))
    blocks = F.transform("begins", lambda i, k: F.slice("turns", i + 1, F.coalesce(F.get("begins", k + 1), F.size("turns")) - i))

    def marks(role: Column) -> tuple[Column, Column]:
        opening, closing = F.concat(F.lit(template.other[0]), escaped(role, template), F.lit(template.other[1])), F.lit(template.other[2])
        for name, (before, after) in template.roles.items():
            opening, closing = F.when(role == name, before).otherwise(opening), F.when(role == name, after).otherwise(closing)
        return opening, closing

    def merged(block: Column) -> Column:
        """One block: its mark, the texts of its turns with the mark between them, the mark that ends it."""
        opening, closing = marks(block[0]["role"])
        loss = block[0]["role"].isin(*template.learned)
        texts = F.transform(block, lambda turn, j: F.array(_segment(F.when(j == 0, opening).otherwise(template.between)), _segment(escaped(turn["text"], template), loss)))
        return F.concat(F.flatten(texts), F.array(_segment(closing)))

    return runs.select("conv_id", blocks.alias("blocks")).select("conv_id", F.flatten(F.transform("blocks", merged)).alias("segments"))


def formatted(segments: Column) -> Column:
    """The conversation's text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learned_texts(segments: Column, template: Template = LLAMA) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template))


def loss_spans(chats: DataFrame) -> DataFrame:
    """``conv_id``, ``start``, ``length``: where in the formatted text (in code points) the loss mask lies."""
    from pyspark.sql import Window

    pieces = chats.select("conv_id", F.posexplode("segments").alias("at", "own"))
    before = F.sum(F.length("own.text")).over(Window.partitionBy("conv_id").orderBy("at")) - F.length("own.text")
    return pieces.select("conv_id", before.cast("long").alias("start"), F.length("own.text").cast("long").alias("length"), "own.loss").filter("loss").drop("loss")


def read_turns(text: Column, template: Template = LLAMA) -> Column:
    """The turns (array of ``role``, ``text``) that a formatted text holds."""
    pairs = [*template.roles.values(), (template.other[0], template.other[2])]
    pattern = "(?s)" + "|".join(f"{re.escape(a)}.*?{re.escape(b)}" for a, b in pairs)

    def turns(block: Column) -> Column:
        inner = lambda a, b: F.substring(block, F.lit(len(a) + 1), F.length(block) - len(a) - len(b))
        named = inner(template.other[0], template.other[2])
        name = F.substring_index(named, template.other[1], 1)
        role, body = unescaped(name, template), F.substring(named, F.length(name) + len(template.other[1]) + 1, F.length(named))
        for r, (a, b) in template.roles.items():
            own = F.startswith(block, F.lit(a))
            role, body = F.when(own, r).otherwise(role), F.when(own, inner(a, b)).otherwise(body)
        return F.transform(F.split(body, re.escape(template.between), -1), lambda x: F.struct(role.alias("role"), unescaped(x, template).alias("text")))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), turns))


def chat_digests(chats: DataFrame, template: Template = LLAMA) -> DataFrame:
    """What the formatted conversations hold, read back from them: numbers and digests of turns and of the masked text."""
    text = chats.select("conv_id", "segments", formatted(F.col("segments")).alias("formatted"))
    back = text.select("conv_id", read_turns(F.col("formatted"), template).alias("turns"), F.array_join(learned_texts(F.col("segments"), template), "").alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(lines).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), digest(F.col("learned")).alias("loss_sha256"), "formatted_chars",
    )


#: Fixed value: the conversation that the query adds, whose texts are made of control strings.
EXTRA = "SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)"


ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {EXTRA}) q
), o AS (
  SELECT *, row_number() OVER w AS i, coalesce(role <> lag(role) OVER w, true) AS opens, coalesce(role <> lead(role) OVER w, true) AS closes FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), e AS (
  SELECT *, length(text) + length(regexp_replace(text, '[<\\[]\\\\*(?:INST\\]|/INST\\]|ROLE\\]|/ROLE\\]|END\\]|s>|/s>|<SYS>>|</SYS>>|sep>)', '<x', 'g')) - length(regexp_replace(text, '[<\\[]\\\\*(?:INST\\]|/INST\\]|ROLE\\]|/ROLE\\]|END\\]|s>|/s>|<SYS>>|</SYS>>|sep>)', '<', 'g'))
    + CASE WHEN NOT opens THEN 5 WHEN role = 'system' THEN 7 WHEN role = 'user' THEN 6 WHEN role = 'assistant' THEN 3 ELSE 13 + length(role) END
    + CASE WHEN NOT closes THEN 0 WHEN role = 'system' THEN 8 WHEN role = 'user' THEN 7 WHEN role = 'assistant' THEN 4 ELSE 5 END AS n FROM o
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
