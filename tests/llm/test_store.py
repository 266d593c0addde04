import threading

import pyarrow as pa
import pytest
from tidemark.llm import store


def test_a_scope_deletes_its_own_tables_and_no_others(spark):
    kept, opened, done = {}, threading.Event(), threading.Event()

    def other():
        opened.wait(60)
        kept["table"] = store.written(spark.range(3).toDF("id"), "other")
        done.set()

    thread = threading.Thread(target=other)
    thread.start()
    with store.scratch(spark):
        opened.set()
        mine = store.written(spark.range(5).toDF("id"), "mine")
        with store.scratch(spark):
            inner = store.written(spark.range(2).toDF("id"), "inner")
        assert done.wait(60) and mine.count() == 5
    thread.join()
    assert kept["table"].count() == 3
    for gone in (mine, inner):
        with pytest.raises(Exception, match="does not exist|FAILED_READ_FILE"):
            gone.collect()


def test_batches_of_texts_are_small(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, taken in ((10_000, store.BATCH_ROWS), (0, store.BATCH_ROWS), (7, 7)):
            spark.conf.set(name, given)
            store.small_batches(spark)
            sizes = spark.range(2000, numPartitions=1).mapInArrow(store.lean(lambda batches: (pa.RecordBatch.from_pydict({"id": [b.num_rows]}) for b in batches)), "id long")
            assert max(r["id"] for r in sizes.collect()) == taken
    finally:
        spark.conf.set(name, before)
