"""Facts arriving as a stream: merged into a store, with the chains of the touched slots derived again.

Each micro-batch becomes one version of the store. A batch that is run again finds its own number recorded and does nothing, so
that a restart neither loses nor repeats facts; facts out of order are put where their time of assertion says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from factloom.memory import Memory


def absorb(memory: Memory):
    """The foreachBatch function that adds fact rows to a memory; facts and batch number become valid with one commit."""

    def run(batch: DataFrame, number: int) -> None:
        done = memory.store.read("stream")
        if done is not None and not done.where(f"batch = {number}").isEmpty():
            return
        mine = batch.sparkSession.createDataFrame([(number,)], "batch bigint")
        memory.add_rows(batch, more={"stream": mine if done is None else done.unionByName(mine)})

    return run


def start(stream: DataFrame, memory: Memory, checkpoint: str):
    """Adds all that is there, then ends; called again, it goes on from the checkpoint."""
    return stream.writeStream.foreachBatch(absorb(memory)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
