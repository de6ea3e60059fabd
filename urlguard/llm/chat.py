"""Chat formatting: collapse cumulative snapshots of conversations, then render what is left.

Logs often hold a conversation several times, each time with some more turns. Every turn gets a
hash of its place, role and text; the exclusive or of the first i of them names the prefix of
length i (two 64-bit hashes). A conversation is dropped if its whole is a proper prefix of
another's; of equal ones the smallest conv_id stays. Only hashes are shuffled until then.

Turns are in order of turn (null first), role, and a hash of the text; rows that repeat a turn
wholly count once. A null role is ``unknown``, a null text empty; turns with a null conv_id form
one conversation. A conversation is handled in segments of SEGMENT turn numbers, and a segment in
parts of at most SEGMENT distinct turns by their rank in it (a turn number can repeat, or be null):
neither a long conversation nor a crowded turn number is ever in one task or one string. Its rendering
is that of its segments (by number, null first) and their parts one after the other. Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlguard.llm.common import stored
from urlguard.operators.lookup import lookup

SEGMENT = 256

# --- fixed values: the chat template -------------------------------------------------------
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# What a text may not hold, and what it becomes.
MARK, PLAIN_MARK = "<|", "< |"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, conv_id, segment, turn, role, text, h1, h2) of each row; ``conv`` is never null."""
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.col("conv_id").cast("long"),
        F.floor(F.col("turn") / SEGMENT).cast("long").alias("segment"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit(1), "text", "role"))


TURN = ["turn", "role", "h1", "h2"]


def _place() -> Column:
    """Names a segment of a conversation."""
    return F.concat_ws("/", "conv", F.coalesce(F.col("segment").cast("string"), F.lit("-")))


def _running(rows: DataFrame, key: str, sums: dict[str, Column]) -> list[Column]:
    """Aggregates over the earlier slices of a key; 0 for the first."""
    earlier = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return [F.coalesce(s.over(earlier), zero).alias(name) for name, s in sums.items()]


def ranked(rows: DataFrame) -> DataFrame:
    """Each distinct turn with its ``rank`` in the conversation and the ``part`` of its segment.

    The turns are sorted over all partitions. A slice is what one partition holds of a segment; slices
    are counted, and their counts added up give ranks, so no task gathers a segment.
    """
    distinct = stored(rows.select("conv", "conv_id", "segment", *TURN).distinct(), "distinct-turns")
    ordered = distinct.repartitionByRange("conv", *TURN).sortWithinPartitions("conv", *TURN)
    held = stored(ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("place", _place()), "ordered-turns")
    held = held.withColumn("slice", F.concat_ws("/", "place", F.shiftright("at", 33)))
    slices = held.groupBy("conv", "place", "slice").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    slices = slices.select("*", *_running(slices, "conv", {"before": F.sum("n")}))
    slices = slices.select("slice", "start", "before", *_running(slices, "place", {"within": F.sum("n")}))
    based = lookup(held, stored(slices, "slices"), "slice").withColumn("step", F.col("at") - F.col("start"))
    part = F.floor((F.col("within") + F.col("step")) / SEGMENT).cast("long")
    return based.withColumns({"rank": F.col("before") + F.col("step"), "part": part}).drop("before", "within", "step")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, conv_id, n, p1, p2, is_whole): each prefix's length and hash, of ranked turns."""
    hashed = turns.select(
        "conv", "conv_id", "slice", "start", "rank",
        *[F.xxhash64(F.lit(s), F.col("rank"), "h1", "h2").alias(f"g{s}") for s in (1, 2)],
    )
    totals = hashed.groupBy("conv", "slice", "start").agg(
        F.count("*").alias("n"), *[F.bit_xor(f"g{s}").alias(f"x{s}") for s in (1, 2)]
    )
    totals = stored(totals, "slice-hashes")
    carries = totals.select("slice", *_running(totals, "conv", {"c1": F.bit_xor("x1"), "c2": F.bit_xor("x2")}))
    carried = lookup(hashed, carries, "slice")
    upto = Window.partitionBy("slice").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    lengths = totals.groupBy("conv").agg(F.sum("n").alias("whole"))
    found = carried.select(
        "conv", "conv_id", (F.col("rank") + 1).alias("n"),
        *[F.col(f"c{s}").bitwiseXOR(F.bit_xor(f"g{s}").over(upto)).alias(f"p{s}") for s in (1, 2)],
    )
    return lookup(found, lengths, "conv").withColumn("is_whole", F.col("n") == F.col("whole")).drop("whole")


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, conv_turns, n_copies) of the conversations that stay, of ranked turns."""
    names = ["n", "p1", "p2"]
    found = stored(prefixes(turns), "prefixes")
    smallest = F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "conv"))["conv"]
    wholes = found.where("is_whole").groupBy(*names).agg(smallest.alias("conv"), F.count("*").alias("n_copies"))
    parts = found.where("not is_whole").select(*names).distinct()
    return wholes.join(parts, names, "left_anti").select("conv", F.col("n").alias("conv_turns"), "n_copies")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, segment, part, conv_turns, n_copies, n_turns, rendered) of the maximal conversations."""
    rows = turns(conversations)
    places = stored(ranked(rows), "ranked-turns")
    chosen = lookup(rows, stored(maximal(places), "maximal"), "conv", "inner")
    # Most segments have one part; only turns of further parts are looked up.
    name = F.concat_ws("/", "conv", F.hex(F.xxhash64("turn", "role", "h1")), F.hex(F.xxhash64(F.lit(1), "turn", "role", "h2")))
    later = stored(places.where("part > 0").select(name.alias("name"), "part"), "later-parts")
    chosen = lookup(chosen.withColumn("name", name), later, "name").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    order = F.struct(*TURN, "text")
    grouped = chosen.groupBy("conv_id", "segment", "part", "conv_turns", "n_copies")
    grouped = grouped.agg(F.array_sort(F.collect_set(order)).alias("turns"))
    shown = F.transform(
        "turns",
        lambda t: F.concat(
            F.lit(OPEN), F.replace(t["role"], F.lit(MARK), F.lit(PLAIN_MARK)), F.lit("\n"),
            F.replace(t["text"], F.lit(MARK), F.lit(PLAIN_MARK)), F.lit(CLOSE + "\n"),
        ),
    )
    return grouped.select(
        "conv_id", "segment", "part", "conv_turns", "n_copies", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(shown, "").alias("rendered"),
    )


CHECK_SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
c AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role) AS l, count(*) AS n
  FROM t GROUP BY conv_id),
e AS (SELECT l, min(conv_id) AS conv_id, any_value(n) AS n, count(*) AS n_copies FROM c GROUP BY l),
m AS (
  SELECT * FROM e
  WHERE NOT EXISTS (SELECT 1 FROM e d WHERE d.n > e.n AND d.l[1] = e.l[1] AND d.l[1 : e.n] = e.l))
SELECT t.conv_id, CAST(floor(t.turn / {SEGMENT}) AS BIGINT) AS segment, m.n AS conv_turns, m.n_copies,
       count(*) AS n_turns,
       string_agg('{OPEN}' || replace(role, '{MARK}', '{PLAIN_MARK}') || chr(10)
         || replace(text, '{MARK}', '{PLAIN_MARK}') || '{CLOSE}' || chr(10), '' ORDER BY turn NULLS FIRST, role) AS rendered
FROM t JOIN m ON t.conv_id IS NOT DISTINCT FROM m.conv_id
GROUP BY t.conv_id, floor(t.turn / {SEGMENT}), m.n, m.n_copies"""
