"""Chat formatting: logged snapshots that are prefixes of longer conversations collapse into them, then maximal ones are rendered.

Turns are numbered within their conversation; the rolling hash of a prefix is the exclusive-or of position-keyed hashes of its turns,
two 64-bit lanes of it, as a running aggregate over the sorted turns. A conversation is dropped if its whole hash and length is that
of a proper prefix of another one (an anti-join on distinct prefixes), and of equal conversations the least conv_id stays. Among
10^11 prefixes two different ones share 128 bits with a chance of about 10^-17.

One sort by conversation numbers, hashes and renders; the table written then is read by column, so hashes travel without texts.

Defined cases: null roles and texts are kept apart from empty ones, and from any text, in the hash and rendered as empty; marks of
turns inside a text get a backslash, so no text can pose as a turn; rows that repeat a turn of a conversation exactly count once;
different rows of one turn number follow each other by role and text; turns without number come first; a row with a null conv_id is
a conversation of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelake.llm.shared import written

#: How a turn is written, and what opens a mark.
OPEN, MIDDLE, CLOSE, MARK = "<|im_start|>", "\n", "<|im_end|>\n", "<|"


def rendered(role: Column, text: Column) -> Column:
    own = lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit(MARK), F.lit(MARK[0] + "\\" + MARK[1:]))
    return F.concat(F.lit(OPEN), own(role), F.lit(MIDDLE), own(text), F.lit(CLOSE))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, own, n, h1, h2, prefixes, rendered): each conversation with its length, its whole hash, the hashes of its proper prefixes and its text. own tells rows without conv_id apart."""
    role, text = F.col("role"), F.col("text")
    turns = turns.select("conv_id", "turn", role.cast("string").alias("role"), text.cast("string").alias("text"))
    turns = turns.withColumn("own", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", role, role.isNull(), text, text.isNull())))
    line = Window.partitionBy("conv_id", "own").orderBy(F.col("turn").asc_nulls_first(), role.asc_nulls_first(), text.asc_nulls_first())
    before = [F.lag(c).over(line) for c in ("turn", "role", "text")]
    same = before[0].eqNullSafe(F.col("turn")) & before[1].eqNullSafe(role) & before[2].eqNullSafe(text) & (F.row_number().over(line) > 1)
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("same", same).withColumn("n", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(so_far))
    for lane in ("h1", "h2"):
        turns = turns.withColumn(lane, F.bit_xor(F.when(~F.col("same"), F.xxhash64(F.lit(lane), "n", role, role.isNull(), text, text.isNull()))).over(so_far))
    whole = F.array_sort(F.collect_list(F.when(~F.col("same"), F.struct("n", "h1", "h2", rendered(role, text).alias("turn"))))).alias("l")
    out = turns.groupBy("conv_id", "own").agg(whole).withColumn("end", F.element_at("l", -1))
    proper = F.transform(F.slice("l", 1, F.size("l") - 1), lambda x: F.struct(x["n"].alias("n"), x["h1"].alias("h1"), x["h2"].alias("h2")))
    return out.select("conv_id", "own", "end.n", "end.h1", "end.h2", proper.alias("prefixes"), F.array_join(F.col("l.turn"), "").alias("rendered"))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_collapsed, rendered) of each maximal conversation of turns (conv_id, turn, role, text). n_collapsed: equal ones that it stands for besides itself."""
    known = written(conversations(turns))
    key = ["n", "h1", "h2"]
    distinct = known.groupBy(*key).agg(F.min(F.struct(F.col("conv_id").isNull().alias("no_id"), "conv_id", "own")).alias("least"), F.count("*").alias("copies"))
    proper = known.select(F.explode("prefixes").alias("p")).select("p.*").distinct()
    kept = written(distinct.join(proper, key, "left_anti").select(*key, F.col("least.conv_id").alias("kept_id"), F.col("least.own").alias("kept_own"), (F.col("copies") - 1).alias("n_collapsed")))
    out = known.select("conv_id", "own", *key, "rendered").join(kept, key).where("conv_id <=> kept_id AND own <=> kept_own")
    return out.select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_collapsed", "rendered")
