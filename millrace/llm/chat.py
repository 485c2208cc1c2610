"""Chat formatting with DataFrame functions only.

A template declares the strings around a turn, the roles whose texts carry loss, and a finite-state machine over roles.
Turns of a conversation are put in order, the machine runs over their roles, and each turn gives three segments: opening,
text, closing, each with its loss flag. Control strings inside roles and texts are escaped: the escape character becomes
itself and "00", the i-th control string the character and the number i in two digits. An escaped text holds no control
string, so the formatted text can be split again and every escape undone.

A conversation is one row of the result, so its turns meet in one task; conversations themselves are spread by hash, and
their turns are gathered once.

Defined cases: null text and null role are empty strings; null turns come first, equal turns are ordered by role and text,
repeated rows are repeated turns; rows without conv_id form one conversation; roles the machine doesn't know are formatted
like others and make the conversation invalid; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

_GAP = "\x01"


@dataclass(frozen=True)
class Template:
    """opening + role + middle + text + closing for each turn; start + ... + stop around the conversation is left to the packer."""

    opening: str = "<turn role="
    middle: str = ">\n"
    closing: str = "</turn>"
    loss_roles: tuple[str, ...] = ("assistant",)
    escape: str = "\\"
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "briefed",
            ("start", "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        if len(self.escape) != 1:
            raise ValueError("the escape is one character")
        for c in (self.opening, self.middle, self.closing):
            if not c or self.escape in c or c[0].isdigit() or c.count(c[0]) != 1:
                raise ValueError(f"control string {c!r}: not empty, without the escape, not led by a digit, its first character only once")
        if len({self.opening, self.middle, self.closing}) != 3:
            raise ValueError("control strings differ from each other")

    @property
    def codes(self) -> list[tuple[str, str]]:
        """(string, code) in the order of escaping."""
        return [(self.escape, f"{self.escape}00"), *((c, f"{self.escape}{i:02d}") for i, c in enumerate((self.opening, self.closing, self.middle), 1))]


def escaped(c: Column, template: Template, role: bool = False) -> Column:
    """Texts may hold the middle string, roles may not."""
    for s, code in template.codes if role else template.codes[:-1]:
        c = F.replace(c, F.lit(s), F.lit(code))
    return c


def unescaped(c: Column, template: Template) -> Column:
    for s, code in reversed(template.codes):
        c = F.replace(c, F.lit(code), F.lit(s))
    return c


def _quoted(s: str) -> str:
    return "".join("\\" + x if not x.isalnum() and not x.isspace() else x for x in s)


def machine(turns: Column, template: Template) -> Column:
    """The machine's run over an array of turns: struct of state (empty after a bad turn) and bad (index of the first bad turn)."""
    moves = F.create_map(*(F.lit(x) for (a, role), b in template.moves.items() for x in (a + _GAP + role, b)))

    def step(s: Column, t: Column) -> Column:
        to = F.try_element_at(moves, F.concat(s["state"], F.lit(_GAP), F.coalesce(t["role"], F.lit(""))))
        return F.struct(F.coalesce(to, F.lit("")).alias("state"), (s["n"] + 1).alias("n"), F.when(s["bad"].isNotNull(), s["bad"]).when(to.isNull(), s["n"]).alias("bad"))

    first = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    return F.aggregate(turns, first, step)


def formatted(rows: DataFrame, template: Template | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, segments array<struct<text, loss>>, formatted, valid, bad_turn): one row for each conversation."""
    t_ = template or Template()
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    own = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def parts(t: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(t_.opening), escaped(t["role"], t_, True), F.lit(t_.middle)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(t["text"], t_).alias("text"), t["role"].isin(*t_.loss_roles).alias("loss")),
            F.struct(F.lit(t_.closing).alias("text"), F.lit(False).alias("loss")),
        )

    run = own.select("conv_id", F.flatten(F.transform("turns", parts)).alias("segments"), machine(F.col("turns"), t_).alias("m"))
    state = F.coalesce(F.col("m.state").isin(*t_.final), F.lit(False))
    return run.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), (state & F.col("m.bad").isNull()).alias("valid"), F.col("m.bad").alias("bad_turn"))


def read_back(text: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>> from a formatted text."""
    t_ = template or Template()
    parts = F.split(text, _quoted(t_.closing))

    def turn(p: Column) -> Column:
        role = F.substring_index(F.substring(p, F.lit(len(t_.opening) + 1), F.length(p)), t_.middle, 1)
        rest = F.substring(p, F.length(role) + len(t_.opening) + len(t_.middle) + 1, F.length(p))
        return F.struct(unescaped(role, t_).alias("role"), unescaped(rest, t_).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    t_ = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], t_)), "")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.sql("SELECT -7L AS conv_id, t.turn, t.role, :said AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)", args={"said": said})
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    out = formatted(rows).withColumn("back", read_back(F.col("formatted"))).withColumn("under", loss_text(F.col("segments")))
    whole = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2(F.col("under").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP2_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, t.turn, t.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)
), turns AS (
    SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before, count(*) OVER (PARTITION BY conv_id) AS size,
        replace(replace(replace(text, '\', '\00'), '<turn role=', '\01'), '</turn>', '\02') AS esc_text,
        replace(replace(replace(replace(role, '\', '\00'), '<turn role=', '\01'), '</turn>', '\02'), '>' || chr(10), '\03') AS esc_role
    FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(esc_text) + length(esc_role) + length('<turn role=>' || chr(10) || '</turn>')) AS BIGINT) AS formatted_chars,
    bool_and(CASE WHEN n = 1 THEN role IN ('system', 'user')
        WHEN before = 'system' THEN n = 2 AND role = 'user'
        WHEN before = 'user' THEN role = 'assistant'
        WHEN before = 'assistant' THEN role = 'user'
        ELSE false END)
    AND bool_or(n = size AND role = 'assistant') AS valid
FROM turns GROUP BY conv_id
"""
