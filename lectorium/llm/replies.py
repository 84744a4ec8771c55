"""Chat formatting of reply trees: the best root-to-leaf paths of each tree, each written as one conversation.

A message names its parent. Its ancestors are found by iterative self-joins that double their reach: round i gives each
message its ancestor 2 ** i above, and the number and the scores of the messages between, so that a tree of depth d takes
log2(d) rounds over rows of a few numbers. Leaves are ranked in their tree by the mean score of their path. The paths of the
best are then enumerated from the leaf upwards: a row that stands for a stretch of messages is split in two at the ancestor
half way, by the tables of the rounds in turn, so all joins together
make twice as many rows as the paths have messages. Texts are shuffled only to their places in a path.

A template has a mark before a turn, one between role and text, and one after the text. CONTROLS, and the template's own
marks, are broken up where texts and roles have them: a backslash is set behind their first character, and itself written twice, so
what is between marks never has a mark or a control string in it and is read back exactly. The loss mask is a list of
stretches of the formatted text, in bytes of its UTF-8, one for each turn of a trained role. All of it is built-in functions.

Defined cases. A null text or role is empty. A message whose parent is null or isn't in its tree is a root; a null tree is a
tree of its own. Messages whose ancestors run in a circle are in no path from a root and are left out. Repeated rows, and
rows that repeat an id, are messages of their own, and a reply to such an id hangs from the first of them by role and text.
Messages without a score don't count for the mean; a path without any comes last, and equal ones are in the order of their
leaves' rows. A path is one row of the result and must fit in one. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

# Control strings of public chat templates.
CONTROLS = (
    "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_sep|>", "<|im_end|>",
    "<|system|>", "<|user|>", "<|assistant|>", "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>",
)
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks of a turn, the roles that are trained on, and what is escaped in texts besides the marks."""

    before: str = "<|im_start|>"
    between: str = "<|im_sep|>"
    after: str = "<|im_end|>"
    trained: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = CONTROLS

    def __post_init__(self):
        for x in self.escaped:
            if len(x) < 2 or ESCAPE in x:
                raise ValueError(f"{x!r} can't be a control string: it is too short or has the escape character")
            for mark in (self.before, self.between, self.after):
                if any(x.endswith(mark[:k]) for k in range(1, min(len(x), len(mark)))):
                    raise ValueError(f"the end of {x!r} is the start of the mark {mark!r}")

    @property
    def escaped(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((self.before, self.between, self.after, *self.controls)))


def escape(text: Column, template: Template) -> Column:
    """The text without any control string in it; unescape() gives it back."""
    starts = "|".join(f"{_quoted(x[0])}(?={_quoted(x[1:])})" for x in template.escaped)
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), f"({starts})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _quoted(literal: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", literal)


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree, rank, leaf, place (from 0, the root) and message (its number in messages) of the best paths of each tree.

    messages: tree, message (a number that no other row has), parent (such a number or null), score. Only these travel.
    """
    rows = messages.select("message", F.col("parent").alias("up"), F.lit(1).cast("long").alias("n"), F.col("score").cast("double").alias("sum"), F.col("score").isNotNull().cast("long").alias("scores"), "tree")
    now = stored(rows.withColumn("sum", F.coalesce("sum", F.lit(0.0))), "jumps")
    done, open_ = now.where("up IS NULL"), now.where("up IS NOT NULL")
    rounds, used, total = [], [now], now.count()
    while 1 << len(rounds) < 2 * total and not open_.isEmpty():  # only messages that have not reached their root are joined again
        rounds.append(open_.select(F.col("message").alias("at"), "up"))
        above = done.unionByName(open_).select(F.col("message").alias("up"), *(F.col(c).alias(f"{c}_above") for c in ("up", "n", "sum", "scores")))
        both = [(F.col(c) + F.coalesce(f"{c}_above", F.lit(0))).alias(c) for c in ("n", "sum", "scores")]
        now = stored(open_.join(above, "up", "left").select("message", F.col("up_above").alias("up"), *both, "tree"), "jumps")
        done, open_ = done.unionByName(now.where("up IS NULL")), now.where("up IS NOT NULL")
        used.append(now)
    replied = messages.where("parent IS NOT NULL").select(F.col("parent").alias("message")).distinct()
    leaves = done.join(replied, "message", "left_anti")  # what still has an ancestor is in a circle or below one
    mean = F.when(F.col("scores") > 0, F.col("sum") / F.col("scores"))
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(mean.desc_nulls_last(), "message"))).where(F.col("rank") <= best)
    out = ranked.select("tree", "rank", F.col("message").alias("leaf"), F.col("message").alias("at"), F.col("n").alias("left"), (F.col("n") - 1).alias("place"))
    for i in range(len(rounds) - 1, -1, -1):  # a row stands for so many messages (left) from at upwards
        half = F.lit(1 << i).cast("long")
        lower = F.struct(F.col("at").alias("at"), F.least("left", half).alias("left"), F.col("place").alias("place"))
        upper = F.struct(F.col("up").alias("at"), (F.col("left") - half).alias("left"), (F.col("place") - half).alias("place"))
        parts = F.when(F.col("left") > half, F.array(lower, upper)).otherwise(F.array(lower))
        out = out.join(rounds[i], "at", "left").select("tree", "rank", "leaf", F.inline(parts))
    out = stored(out.select("tree", "rank", "leaf", "place", F.col("at").alias("message")), "paths")
    discard(*used)
    return out


def numbered(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of tree, id, parent, role, text, score with a number for each (message); and tree, message, parent (its number), score."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = stored(messages.select("tree", "id", "parent", *text, F.col("score").cast("double").alias("score")).withColumn("message", F.monotonically_increasing_id()), "messages")
    firsts = rows.where("id IS NOT NULL").groupBy(F.col("tree").alias("t"), F.col("id").alias("i")).agg(F.min_by("message", F.struct("role", F.xxhash64("text"), "message")).alias("above"))
    links = rows.select("tree", "message", "parent", "score").join(firsts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("i")), "left")
    return rows, stored(links.select("tree", "message", F.col("above").alias("parent"), "score"), "links")


def formatted(messages: DataFrame, best: int = 1, template: Template | None = None) -> DataFrame:
    """tree, rank, formatted, loss_spans (array of start, end: bytes of the formatted text's UTF-8) of the best paths of each tree."""
    template = template or Template()
    rows, links = numbered(messages)
    chosen = paths(links, best)
    role, text = escape(F.col("role"), template), escape(F.col("text"), template)
    head = F.concat(F.lit(template.before), role, F.lit(template.between))
    turns = rows.select("message", head.alias("head"), text.alias("body"), F.col("role").isin(list(template.trained)).alias("on"))
    size = F.octet_length("head") + F.octet_length("body") + len(template.after.encode())
    before = F.coalesce(F.sum(size.cast("long")).over(Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = chosen.join(turns, "message").withColumn("start", before + F.octet_length("head"))
    span = F.when(F.col("on"), F.struct(F.col("start").alias("start"), (F.col("start") + F.octet_length("body")).alias("end")))
    turn = F.struct("place", F.concat("head", "body", F.lit(template.after)).alias("turn"), span.alias("span"))
    whole = placed.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return whole.select("tree", "rank", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def turns_of(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) of a formatted conversation, in order and as they were."""
    template = template or Template()
    parts = F.filter(F.split(formatted, _quoted(template.before)), lambda p: p != "")

    def turn(part: Column) -> Column:
        at = F.split(part, _quoted(template.between), 2)
        body = F.substring(at[1], F.lit(1), F.char_length(at[1]) - len(template.after))
        return F.struct(unescape(at[0]).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def loss_of(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, as they were."""
    raw = F.encode(formatted, "UTF-8")
    return F.transform(spans, lambda s: unescape(F.decode(F.substring(raw, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "UTF-8")))


def conversations(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as messages: each turn is a reply to the one before it."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", F.xxhash64("text"))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    placed = own.withColumn("id", F.row_number().over(order).cast("long"))
    return placed.select(F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))


def digests(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """The contract's rows, read back from the formatted conversations that were written."""
    template = template or Template()
    added = rows.sparkSession.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    every = rows.select("conv_id", "turn", "role", "text").unionByName(added)
    written = stored(formatted(conversations(every), 1, template), "formatted")
    found = written.select("tree", "formatted", turns_of(F.col("formatted"), template).alias("turns"), F.array_join(loss_of(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(whole, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(column: str, template: Template) -> str:
    out = f"replace({column}, '{ESCAPE}', '{ESCAPE * 2}')"
    for x in template.escaped:
        out = f"replace({out}, '{x}', '{x[0] + ESCAPE + x[1:]}')"
    return out


ORACLE_SQL = f"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
w AS (SELECT *, length({_sql_escaped("role", Template())}) + length({_sql_escaped("text", Template())}) + {sum(map(len, (Template().before, Template().between, Template().after)))} AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
"""
