"""Mixing sources to target weights by systematic sampling.

Sizes are word counts. Sources in code point order (null last) weigh 1, 2, 3, repeating, and share the total of all
sizes; a target stops at `cap` times its source's size and the excess is shared again by weight among the others, until
none is above. A source's documents, in order of size and id, each have target / source_size expected copies. The prefix
sum of these, plus one random offset per source, passes whole numbers; a document is taken once for each one that its
own share passes. In order of size, the taken words of a source stay near its target: documents of every size are
taken alike, and the error is about the size of its longest document.

The prefix sums are ranks times the rate. Documents are dealt by range of (source, size, id), so a source that holds a
third of all rows spreads over many tasks; a task counts its own rows and a table of one row per task and source carries
the counts of the tasks before it.

Null and empty texts have size 0 and are taken like others (with 0 words). A source whose sizes are all 0 has target 0
and nothing is taken from it; a null source is one source. Repeated rows are documents of their own; null ids come
first. Other columns are kept, whatever their names, and are no input. The offset is a hash of seed and source, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import add_word_count, keep, partitions

CYCLE = (1, 2, 3)
CAP = 3
#: One row per task and source; beyond so many rows the table is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 200_000


def ranked(df: DataFrame, group: str, order: list[Column], parts: int) -> DataFrame:
    """Add `rank`, the row's number (from 1) in its group by `order` (nulls last in group), without a task per group."""
    schema = T.StructType([*df.schema, T.StructField("_task", T.IntegerType()), T.StructField("_row", T.LongType())])

    def number(batches):
        from pyspark import TaskContext

        task, carry = TaskContext.get().partitionId(), None  # (value of the last group, rows so far)
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(group))
            n = len(values)
            if not n:
                continue
            codes = values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            rows = np.arange(n) - np.repeat(first, np.diff(np.append(first, n))) + 1
            stop = first[1] if len(first) > 1 else n
            if carry is not None and carry[0] == values[0].as_py():
                rows[:stop] += carry[1]
            carry = (values[n - 1].as_py(), int(rows[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, task, np.int32)), pa.array(rows.astype(np.int64))], names=schema.names)

    dealt = df.repartitionByRange(parts, F.col(group).asc_nulls_last(), *order).sortWithinPartitions(F.col(group).asc_nulls_last(), *order)
    rows = keep(dealt.mapInArrow(number, schema), "ranks")
    # A source lies in neighbouring tasks; this table has one row per task and source.
    earlier = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = rows.groupBy("_task", group).agg(F.count("*").alias("_n"))
    before = per_task.select(F.col("_task").alias("_t"), F.col(group).alias("_g"), F.sum("_n").over(earlier).alias("_before"))
    before = keep(before, "before")
    small = before.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(before) if small else before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_task") == F.col("_t")), "left")
    return joined.withColumn("rank", F.col("_row") + F.coalesce("_before", F.lit(0))).drop("_task", "_row", "_t", "_g", "_before")


def targets(sources: DataFrame, cycle: tuple[int, ...] = CYCLE, cap: int = CAP) -> DataFrame:
    """From kept rows (source, source_size) the table (source, source_size, target).

    Every round caps each source whose share is above its limit. Rounds are few (each caps at least one source), and
    only the two sums of a round reach the driver.
    """
    n = sources.count()
    table = ranked(sources.withColumn("_all", F.lit(0)), "_all", [F.col("source").asc_nulls_last()], partitions(sources.sparkSession))
    weight = F.element_at(F.array(*map(F.lit, cycle)), F.pmod(F.col("rank") - 1, F.lit(len(cycle))).cast("int") + 1)
    table = keep(table.withColumn("weight", weight).drop("_all", "rank"), "weights")
    limit = F.lit(cap) * F.col("source_size")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    all_weights = table.agg(F.sum("weight")).first()[0] or 0
    left, weights = total, all_weights
    for _ in range(n):
        if not weights:
            break
        capped = table.agg(
            F.sum(F.when(_share(left, weights) > limit, limit).otherwise(0)).alias("given"),
            F.sum(F.when(_share(left, weights) > limit, F.col("weight")).otherwise(0)).alias("off"),
        ).first()
        rest, open_weights = total - capped["given"], all_weights - capped["off"]
        if (rest, open_weights) == (left, weights):
            break
        left, weights = rest, open_weights
    share = _share(left, weights) if weights else limit.cast("double")
    target = F.when(share > limit, limit.cast("double")).otherwise(share)
    return table.select("source", "source_size", target.alias("target"))


def _share(left: int, weights: int) -> Column:
    return F.lit(left).cast("double") * F.col("weight") / F.lit(weights).cast("double")


def offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) per source."""
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.concat(F.lit("="), source), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def plan(df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", cycle: tuple[int, ...] = CYCLE, cap: int = CAP, carry: bool = False) -> DataFrame:
    """Per document doc_id, size, source_size, target, copies and taken; with `carry` all columns of df as struct `row`."""
    row = [F.struct(*df.columns).alias("row")] if carry else []
    words = "_size"
    while words in {c.lower() for c in df.columns}:
        words = f"_{words}"
    docs = add_word_count(df, text, words).select(F.col(id_column).alias("doc_id"), F.col(source).alias("source"), F.col(words).alias("size"), *row)
    rows = ranked(docs, "source", [F.col("size").asc(), F.col("doc_id").asc()], partitions(df.sparkSession))
    sources = keep(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    goal = keep(targets(sources, cycle, cap), "targets").withColumnRenamed("source", "_source")
    small = goal.count() <= BROADCAST_ROWS
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    passed = F.floor(rate * F.col("rank").cast("double") + u) - F.floor(rate * (F.col("rank") - 1).cast("double") + u)
    return (
        rows.join(F.broadcast(goal) if small else goal, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("copies", passed.cast("long"))
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if carry else []))
    )


def mix(df: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row as often as it is taken, with the columns of df."""
    return plan(df, carry=True, **options).select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
