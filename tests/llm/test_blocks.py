"""Benchmark blocks are held one at a time."""

from pyspark import Broadcast, SparkContext

from forumloom.llm import decontaminate


def test_benchmark_blocks_are_held_one_at_a_time(spark, monkeypatch):
    alive, most = [0], [0]
    make, drop = SparkContext.broadcast, Broadcast.destroy

    def broadcast(self, value):
        alive[0] += 1
        most[0] = max(most[0], alive[0])
        return make(self, value)

    def destroy(self, *args):
        alive[0] -= 1
        return drop(self, *args)

    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    monkeypatch.setattr(Broadcast, "destroy", destroy)
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "doc_id long, text string")
    items = [(k, " ".join(f"w{i}" for i in range(k, k + 12))) for k in range(8)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(docs, bench, block_bytes=100).first()
    assert found["items"] == list(range(8)) and most == [1] and alive == [0]
