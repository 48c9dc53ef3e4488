"""Chat formatting by multi-party perspective rotation.

Each dialogue is rendered once for every participant: that speaker becomes the assistant, the others become users with
their names, system turns stay. The mask covers what the assistant has to say: its texts and their end marks.
DataFrame functions only.

Whole texts are shuffled once, into chunks of neighbouring turns. Which perspectives a chunk is rendered for, and where each
rendering starts, is found out on narrow rows (numbers and names), and joined to the chunks where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradlens.llm._common import table

START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"
UNNAMED = "unknown"
#: Turn numbers that one output row holds; a longer dialogue goes on in further rows.
BLOCK = 64
#: Rows of one turn number from which on that turn is cut into rows of its own.
HOT = 64
#: Chunks whose lengths are added up in one window.
STRIDE = 1024


def escaped(x: Column) -> Column:
    """Without a mark: a text cannot open or close a turn."""
    return F.replace(x, F.lit("<|"), F.lit("< |"))


def _head(role: Column, own: Column) -> Column:
    name = F.translate(escaped(role), "\n\r", "  ")
    return F.when(own, F.lit(f"{START}assistant\n")).when(role == SYSTEM, F.lit(f"{START}system\n")).otherwise(F.concat(F.lit(f"{START}user name="), name, F.lit("\n")))


def _chunks(rows: DataFrame, hot: int) -> tuple[DataFrame, list[str]]:
    """rows with the chunk that each belongs to and the number of its copies there (n); the chunks' key.

    A block is a chunk, unless a turn number comes more than `hot` times: then the turns before it, that turn by ranges of
    the rows' key and the turns after it are. A row that is repeated more than `hot` times goes on in further pieces.
    """
    often = rows.groupBy("ck", "cn", "block", "turn").agg(F.count("*").alias("c")).filter(F.col("c") > hot)
    if often.isEmpty():
        return rows.withColumn("n", F.lit(1).cast("long")), ["ck", "cn", "block"]
    single = rows.groupBy("ck", "cn", "block", "turn", "role", "key", "text").agg(F.first("conv_id").alias("conv_id"), F.count("*").alias("n"))
    crowds = often.groupBy("ck", "cn", "block").agg(F.collect_list(F.struct("turn", "c")).alias("hot"))  # at most `block` turns
    both = single.join(crowds, ["ck", "cn", "block"], "left").withColumn("hot", F.coalesce("hot", F.array().cast("array<struct<turn:bigint,c:bigint>>")))
    before = F.size(F.filter("hot", lambda x: F.coalesce(x["turn"] < F.col("turn"), x["turn"].isNull() & F.col("turn").isNotNull())))
    own = F.get(F.filter("hot", lambda x: x["turn"].eqNullSafe(F.col("turn"))), F.lit(0))["c"]
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    parts = both.withColumn("own", own).select("*", (2 * before + F.col("own").isNotNull().cast("int")).cast("long").alias("seg"), F.coalesce(F.shiftright(place * F.ceil(F.col("own") / hot), 32), F.lit(0)).cast("long").alias("sub"))
    pieces = parts.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / hot))))
    return pieces.withColumn("n", F.least(F.lit(hot).cast("long"), F.col("n") - F.col("piece") * hot)).drop("hot", "own"), ["ck", "cn", "block", "seg", "sub", "piece"]


def _starts(chunks: DataFrame, chunk: list[str], speakers: DataFrame) -> DataFrame:
    """Chunk, perspective, start of the rendering: from the lengths of heads and texts alone.

    Lengths are added up in two steps, by stretches of a dialogue and within each, so no window holds a whole long dialogue.
    """
    size = F.length(_head(F.col("role"), F.lit(False))) + F.length(escaped(F.col("text"))) + len(END)
    by_role = chunks.groupBy(*chunk, "role").agg(F.sum("n").alias("own"), F.sum(F.col("n") * size).alias("size"))
    whole = by_role.groupBy(*chunk).agg(F.sum("size").alias("size")).join(speakers, ["ck", "cn"])
    gain = len(f"{START}assistant\n") - F.length(_head(F.col("role"), F.lit(False)))
    mine = by_role.filter(F.col("role") != SYSTEM).select(*chunk, F.col("role").alias("perspective"), (F.col("own") * gain).alias("gain"))
    lengths = whole.join(mine, [*chunk, "perspective"], "left").withColumn("size", F.col("size") + F.coalesce("gain", F.lit(0)))
    far = F.struct("block", "seg", F.floor(F.col("sub") / STRIDE)) if "sub" in chunk else F.floor(F.col("block") / STRIDE)
    before = lambda value, by, order: F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    one = ["ck", "cn", "perspective"]
    inner = lengths.withColumn("far", far).withColumn("b", before("size", [*one, "far"], chunk[2:]))
    outer = inner.groupBy(*one, "far").agg(F.max(F.col("b") + F.col("size")).alias("size")).withColumn("a", before("size", one, ["far"])).drop("size")
    return inner.join(outer, [*one, "far"]).select(*chunk, "perspective", (F.col("a") + F.col("b")).cast("long").alias("start"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """One row per dialogue, participant and chunk of turns (`block` turn numbers).

    conv_id, perspective, block, n_turns, start (of the chunk in the whole rendering), text, spans (array of
    struct<from, to>: masked characters of text).

    A null role is the speaker "unknown", a null text is empty, a null turn number stands first (block -1). Turns with
    the same number are ordered by the MD5 of role and text; repeated rows are rendered as often as they come. A turn
    number that comes more than `hot` times is cut into chunks by ranges of that MD5, so no row grows with it; copies of
    one row beyond `hot` then follow the rest of their range. "<|" in a text or name becomes "< |", and line ends in a
    name spaces, so that none can forge a turn. Rows without conv_id are one dialogue. A dialogue of system turns only
    has no participant and gives no row, nor does an empty table. Other columns are not read.
    """
    conv, role, text = F.col(conv_col), F.coalesce(F.col(role_col).cast("string"), F.lit(UNNAMED)), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(
        conv.alias("conv_id"),
        F.coalesce(conv.cast("string"), F.lit("")).alias("ck"),
        conv.isNull().alias("cn"),
        F.coalesce(F.floor(F.col(turn_col) / block), F.lit(-1)).cast("long").alias("block"),
        F.col(turn_col).cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.md5(F.concat(role, F.lit("\n"), text)).alias("key"),
    )
    chunks, chunk = _chunks(rows, hot)
    speakers = rows.filter(F.col("role") != SYSTEM).select("ck", "cn", F.col("role").alias("perspective")).distinct()
    whole = chunks.groupBy(*chunk).agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("turn", "key", "role", "text", "n"))).alias("t"))
    whole = whole.withColumn("t", F.when(F.exists("t", lambda x: x["n"] > 1), F.flatten(F.transform("t", lambda x: F.array_repeat(x, x["n"].cast("int"))))).otherwise(F.col("t")))
    both = whole.join(_starts(chunks, chunk, speakers), chunk)
    head = lambda x: _head(x["role"], x["role"] == F.col("perspective"))
    parts = F.transform("t", lambda x: F.struct(F.concat(head(x), escaped(x["text"]), F.lit(END)).alias("s"), F.length(head(x)).alias("h"), (x["role"] == F.col("perspective")).alias("own")))
    both = both.withColumn("p", parts).withColumn("text", F.array_join(F.col("p.s"), "")).drop("t")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))

    def step(acc, x):
        end = acc["at"] + F.length(x["s"])
        own = F.array(F.struct((acc["at"] + x["h"]).alias("from"), end.alias("to")))
        return F.struct(end.alias("at"), F.when(x["own"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("p", zero, step, lambda acc: acc["spans"])
    return both.select("conv_id", "perspective", "block", F.size("p").alias("n_turns"), "start", "text", spans.alias("spans"))


def op3_perspective_rotation(spark, sf_dir: str) -> DataFrame:
    out = rotate(table(spark, sf_dir, "conversations"))
    masked = F.aggregate("spans", F.lit(0), lambda n, s: n + s["to"] - s["from"])
    as_text = F.array_join(F.transform("spans", lambda s: F.concat(s["from"].cast("string"), F.lit(":"), s["to"].cast("string"))), ",")
    return out.select("conv_id", "perspective", "block", F.col("n_turns").cast("long").alias("n_turns"), "start", "text", as_text.alias("mask_spans"), masked.cast("long").alias("n_masked"))


OP3_SQL = """
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(turn // 64, -1) AS block, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         md5(coalesce(role, 'unknown') || chr(10) || coalesce(text, '')) AS key, row_number() OVER () AS rid
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM rows_ WHERE role <> 'system'),
seg AS (
  SELECT conv_id, perspective, block, turn, key, replace(text, '<|', '< |') AS text, rid, r.role = perspective AS own,
         CASE WHEN r.role = perspective THEN '<|im_start|>assistant' || chr(10)
              WHEN r.role = 'system' THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || translate(replace(r.role, '<|', '< |'), chr(10) || chr(13), '  ') || chr(10) END AS head
  FROM rows_ r JOIN speakers ON conv_id IS NOT DISTINCT FROM c),
laid AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS s,
         coalesce(sum(length(head || text || '<|im_end|>' || chr(10))) OVER (
           PARTITION BY conv_id, perspective, block ORDER BY turn NULLS FIRST, key, rid
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM seg),
blocks AS (
  SELECT conv_id, perspective, block, count(*) AS n_turns,
         string_agg(s, '' ORDER BY turn NULLS FIRST, key, rid) AS text,
         coalesce(string_agg((pos + length(head)) || ':' || (pos + length(s)), ',' ORDER BY turn NULLS FIRST, key, rid) FILTER (WHERE own), '') AS mask_spans,
         coalesce(sum(length(s) - length(head)) FILTER (WHERE own), 0)::BIGINT AS n_masked
  FROM laid GROUP BY ALL)
SELECT conv_id, perspective, block, n_turns,
       coalesce(sum(length(text)) OVER (PARTITION BY conv_id, perspective ORDER BY block
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, text, mask_spans, n_masked
FROM blocks
"""
