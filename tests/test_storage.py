"""Staged tables: a run deletes its own and no other's."""

import os
import threading

from quern import storage


def test_two_runs_in_one_driver_keep_apart(spark):
    kept, both = {}, threading.Barrier(2)

    def run(name):
        began = storage.mark()
        first = storage.staged(spark.range(5), name)
        both.wait(60)
        last = storage.staged(first.where("id > 2"), name)
        storage.discard(spark, began)
        both.wait(60)
        kept[name] = (last.count(), [os.path.exists(p.removeprefix("file:")) for p in (f.inputFiles()[0] for f in (last,))])
        kept[name + " gone"] = storage.mark() - began

    threads = [threading.Thread(target=run, args=(n,)) for n in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert kept == {"a": (2, [True]), "b": (2, [True]), "a gone": 1, "b gone": 1}
