"""Rows that arrive as files, as a stream.

A table's directory is a file source: new files become micro-batches, each row is
judged by the contract's schema where it is, and typed rows go on. What needs other
rows (keys, references) is judged for each batch against the state as it was, in
``foreachBatch``, so a finding names the batch that brought it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import validate
from ..operators.changes import import_rows
from ..operators.validate import State, Table
from ..plans import jsonschema
from ..plans.contract import Contract
from ..sources import folder


def arriving(spark: SparkSession, root: str, table: str, files_a_batch: int = 1000) -> DataFrame:
    """``(_path, _name, _text)`` of files as they arrive in a table's directory."""
    source = (
        spark.readStream.format("text").schema("value string").option("wholetext", True)
        .option("pathGlobFilter", "[!.]*.json").option("maxFilesPerTrigger", files_a_batch)
        .load(f"{root.rstrip('/')}/{table}")
    )
    name = F.col("_metadata.file_name")
    return source.select(
        F.concat(F.lit(f"{table}/"), name).alias("_path"), F.regexp_replace(name, r"\.json$", "").alias("_name"), F.col("value").alias("_text")
    )


def row_findings(arrivals: DataFrame, contract: Contract) -> DataFrame:
    """A stream of ``(path, code, pointer, message)``; stateless, so late rows are as good as early ones."""
    return jsonschema.judge_rows(arrivals, contract.document or {})


def follow(
    arrivals: DataFrame, contract: Contract, state: State, checkpoint: str, sink: Callable[[DataFrame, DataFrame, int], None], once: bool = False
) -> StreamingQuery:
    """Feeds ``sink(changed rows, findings, batch)`` with every micro-batch.

    Rows of a batch are upserted into the state's table as it was at the start; of a
    key that comes twice in one batch the last path counts.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = folder.typed(batch, contract)
        last = rows.groupBy(*contract.key).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), "_path").alias("r")).select("r.*")
        held = state[contract.table]
        change, _ = import_rows(Table(held.rows.drop("_path", "_present"), contract), last.drop("_path", "_present"), "upsert")
        after = state | {contract.table: change.after}
        found = [validate.dangling(after, change.after, fk) for fk in contract.foreign_keys if all(n in after for n in fk.tables)]
        found += [validate.broken_checks(change.after, r) for r in contract.checks]
        sink(change.rows, validate.union(spark, found), number)

    writer = arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
