"""Preference formatting of chosen and rejected conversations.

The longest common turn prefix of the two is rendered once, as the prompt; what follows in each
is a completion, with a mask that leaves only the assistant's words to be learned.

Turns meet by conversation: one exchange brings each side's turns together as a list, and a task
compares and renders the two lists of one row. Conversations of very many characters take another
way that holds no more than a piece of one in a task: their turns are numbered in sorted ranges,
compared by number, and rendered in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkpact.llm.common import saved

#: Characters of a conversation that one row may hold; a longer one is returned in pieces of about this size.
PART_CHARS = 4_000_000

# Markers of a turn's begin and end.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def safe(text: str) -> str:
    """Text in which no marker can be read: the bar of any "<|" is set apart."""
    return text.replace("<|", "< |")


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[dict[str, int]]]:
    """Turns (role, text) with their markers, and the spans [start, end) of what is learned: the
    assistant's words and their end marker."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{OPEN}{safe(role)}\n"
        parts += [head, safe(text), CLOSE + "\n"]
        end = at + len(head) + len(parts[-2]) + len(CLOSE)
        if role == "assistant":
            spans.append({"start": at + len(head), "end": end})
        at = end + 1
    return "".join(parts), spans


def clean(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id, at, role, text) of the turns of conversations with an id."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("at"), text(role_col).alias("role"), text(text_col).alias("text"))


def long_conversations(sides: list[DataFrame], part_chars: int) -> DataFrame | None:
    """(id) of conversations that are too long for one row on one side, or None if there are none.
    Their number is bounded by the corpus' characters over part_chars."""
    found = None
    for own in sides:
        sizes = own.groupBy("id").agg(F.sum(F.length("text") + F.length("role") + 32).alias("n")).where(F.col("n") > part_chars).select("id")
        found = sizes if found is None else found.unionByName(sizes)
    found = saved(found.distinct(), "long")
    return found if found.head(1) else None


def without(own: DataFrame, long: DataFrame | None) -> DataFrame:
    return own if long is None else own.join(long, "id", "left_anti")


def listed(own: DataFrame, name: str) -> DataFrame:
    return own.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias(name))


OUT = "prompt_turns int, prompt string, chosen string, rejected string, chosen_spans array<struct<start:int,end:int>>, rejected_spans array<struct<start:int,end:int>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
KINDS = (pa.int32(), pa.string(), pa.string(), pa.string(), SPANS, SPANS)
NAMES = [c.split(" ")[0] for c in OUT.split(", ")]


def lists_of(column: pa.Array) -> Iterator[list[tuple]]:
    """The turns of each row, without repeats; none for null."""
    turns = column.flatten()
    fields = [*zip(*(turns.field(k).to_pylist() for k in range(3)), strict=True)]
    at = 0
    for n in column.value_lengths().to_pylist():
        own = fields[at : at + (n or 0)]
        at += n or 0
        yield [t for k, t in enumerate(own) if not k or t != own[k - 1]]


def preference_pairs(chosen: DataFrame, rejected: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_chars: int = PART_CHARS, long: DataFrame | None | bool = True) -> DataFrame:
    """Pairs of conversations with one id, one in each table, a row per turn.

    Returns a row for each id: id_col, part long, prompt_turns, prompt, chosen, rejected (rendered),
    chosen_spans, rejected_spans (in characters of the completions). part is 0. A conversation of
    more than part_chars goes on in rows with part 1, 2 and so on: the texts of its rows, one after
    the other, are the whole, and spans are in characters of their own row.

    Turns are ordered by number, role and text, and common while all three agree. Null role or
    text: as empty. Null turn: before all others. Null id: left out. Repeated rows: one turn; turns
    that share a number all stay. A conversation in one table only: its pair is empty on the other
    side. Equal conversations: all prompt, empty completions. Empty tables: empty result. "<|" in a
    text is rendered as "< |", so that no text can forge a marker; "< |" itself stays as it is.

    long: (id) of the conversations that are too long, or None, where the caller knows them.
    """
    sides = [clean(df, id_col, turn_col, role_col, text_col) for df in (chosen, rejected)]
    if long is True:
        long = long_conversations(sides, part_chars)
    kind = dict(sides[0].dtypes)["id"]
    own, other = (listed(without(s, long), n) for s, n in zip(sides, ("c", "r"), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c, r in zip(lists_of(batch.column(1)), lists_of(batch.column(2)), strict=True):
                n = next((k for k, (x, y) in enumerate(zip(c, r, strict=False)) if x != y), min(len(c), len(r)))
                (prompt, _), (yes, yes_spans), (no, no_spans) = (rendered([t[1:] for t in turns]) for turns in (c[:n], c[n:], r[n:]))
                rows.append((n, prompt, yes, no, yes_spans, no_spans))
            columns = list(zip(*rows, strict=True)) or [[]] * len(KINDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0] * len(rows), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, KINDS, strict=True))], [id_col, "part", *NAMES])

    schema = f"`{id_col}` {kind}, part long, {OUT}"
    found = own.join(other, "id", "full_outer").select("id", "c", "r").mapInArrow(run, schema)
    if long is None:
        return found
    return found.unionByName(long_pairs([s.join(long, "id", "left_semi") for s in sides], id_col, kind, part_chars))


def numbered(own: DataFrame, kind: str) -> DataFrame:
    """(id, pos, chars, at, role, text): the place of each turn in its conversation, and how many
    characters stand before it. Ranges of the sorted turns count for themselves; what stands before
    a range comes from the table of range sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, pos, chars = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            out = []
            for key, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if key != last:
                    last, pos, chars = key, 0, 0
                size = len(role) + len(text) + 32
                out.append((number, pos, chars, size))
                pos, chars = pos + 1, chars + size
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], ["id", "at", "role", "text", "range", "pos", "chars", "size"])

    in_order = own.distinct().repartitionByRange("id", "at", "role", "text").sortWithinPartitions("id", "at", "role", "text")
    rows = saved(in_order.select("id", "at", "role", "text").mapInArrow(run, f"id {kind}, at long, role string, text string, range long, pos long, chars long, size long"), "numbered")
    sizes = rows.groupBy("id", "range").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    before = Window.partitionBy("id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s"))
    return rows.join(offsets, ["id", "range"]).select("id", (F.col("pos") + F.col("n")).alias("pos"), (F.col("chars") + F.col("s")).alias("chars"), F.struct("at", "role", "text").alias("turn"))


def long_pairs(sides: list[DataFrame], id_col: str, kind: str, part_chars: int) -> DataFrame:
    """Pairs of long conversations, in pieces."""
    c, r = (numbered(s, kind) for s in sides)
    both = c.select("id", "pos", F.col("chars").alias("c_chars"), F.col("turn").alias("c")).join(r.select("id", "pos", F.col("chars").alias("r_chars"), F.col("turn").alias("r")), ["id", "pos"], "full_outer")
    both = saved(both, "aligned")
    cut = both.groupBy("id").agg(F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("pos"))).alias("cut"), F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.coalesce("c_chars", "r_chars"))).alias("from"))
    placed = both.join(cut, "id").withColumn("common", F.col("cut").isNull() | (F.col("pos") < F.col("cut")))
    piece = lambda chars, start: F.floor((F.col(chars) - start) / part_chars).cast("long").alias("part")
    kinds = (
        (0, placed.where("common").select("id", piece("c_chars", F.lit(0)), "pos", "c.role", "c.text")),
        (1, placed.where("NOT common AND c IS NOT NULL").select("id", piece("c_chars", F.col("from")), "pos", "c.role", "c.text")),
        (2, placed.where("NOT common AND r IS NOT NULL").select("id", piece("r_chars", F.col("from")), "pos", "r.role", "r.text")),
    )
    turns = None
    for number, rows in kinds:
        rows = rows.withColumn("side", F.lit(number))
        turns = rows if turns is None else turns.unionByName(rows)
    pieces = turns.groupBy("id", "part").agg(F.sort_array(F.collect_list(F.struct("side", "pos", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for turns in batch.column(2).to_pylist():
                (prompt, _), (yes, yes_spans), (no, no_spans) = (rendered([(t["role"], t["text"]) for t in turns if t["side"] == k]) for k in range(3))
                rows.append((sum(t["side"] == 0 for t in turns), prompt, yes, no, yes_spans, no_spans))
            columns = list(zip(*rows, strict=True)) or [[]] * len(KINDS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(columns, KINDS, strict=True))], [id_col, "part", *NAMES])

    return pieces.select("id", "part", "turns").mapInArrow(run, f"`{id_col}` {kind}, part long, {OUT}")


def echo_rejections(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_chars: int = PART_CHARS) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Chosen and rejected turns for a table without preferences, and the conversations that are too
    long for one row (or None).

    Chosen: each conversation as it is. Rejected: the same up to its first reply, which is an echo
    of the turn before it (a well-known bad reply; empty if there is none) and the last turn.
    Conversations without a reply are the same on both sides.
    """
    own = clean(turns, id_col, turn_col, role_col, text_col)
    long = long_conversations([own], part_chars)
    named = [F.col("id").alias(id_col), F.col("t.at").alias(turn_col), F.col("t.role").alias(role_col), F.col("t.text").alias(text_col)]
    lists = listed(without(own, long), "turns")
    first = F.array_position(F.transform("turns", lambda t: t["role"] == "assistant"), F.lit(True)).cast("int")
    reply = F.get("turns", F.col("first") - 1)
    echo = F.struct(reply["at"].alias("at"), F.lit("assistant").alias("role"), F.coalesce(F.when(F.col("first") > 1, F.get("turns", F.col("first") - 2))["text"], F.lit("")).alias("text"))
    cut = F.when(F.col("first") == 0, F.col("turns")).otherwise(F.concat(F.slice("turns", F.lit(1), F.greatest(F.lit(0), F.col("first") - 1)), F.array(echo)))
    chosen = lists.select("id", F.explode("turns").alias("t")).select(*named)
    rejected = lists.withColumn("first", first).select("id", F.explode(cut).alias("t")).select(*named)
    if long is not None:
        rows = own.join(long, "id", "left_semi").select("id", F.struct("at", "role", "text").alias("t"))
        mark = rows.groupBy("id").agg(F.min(F.when(F.col("t.role") == "assistant", F.col("t"))).alias("reply"))
        before = rows.join(mark, "id").where(F.col("reply").isNull() | (F.col("t") < F.col("reply")))
        last = before.groupBy("id").agg(F.max("t").alias("last"))
        echoes = mark.where(F.col("reply").isNotNull()).join(last, "id", "left").select("id", F.struct(F.col("reply.at").alias("at"), F.lit("assistant").alias("role"), F.coalesce("last.text", F.lit("")).alias("text")).alias("t"))
        chosen = chosen.unionByName(rows.select(*named))
        rejected = rejected.unionByName(before.select("id", "t").unionByName(echoes).select(*named))
    return chosen, rejected, long
