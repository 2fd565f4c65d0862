"""Scopes of staged tables in threads of their own."""

import os
import threading
from contextvars import copy_context

from vellum.storage import discard, scope, stage


def there(df):
    return os.path.exists(df._staged_at.removeprefix("file://"))


def test_scopes_of_threads(spark):
    """What one thread stages in its scope is no other's to delete."""
    first_staged, second_done = threading.Event(), threading.Event()
    seen = {}

    def first():
        with scope():
            df = stage(spark.range(7), "a")
            first_staged.set()
            assert second_done.wait(60)
            seen["first"] = df.count()
        seen["left"] = there(df)

    def second():
        assert first_staged.wait(60)
        with scope():
            seen["second"] = stage(spark.range(3), "b").count()
        second_done.set()

    threads = [threading.Thread(target=f) for f in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert seen == {"first": 7, "second": 3, "left": False}


def test_scopes_inside_each_other_and_in_pools(spark):
    outside = stage(spark.range(1), "outside")
    with scope():
        outer = stage(spark.range(2), "outer")
        with scope():
            inner, kept = stage(spark.range(3), "inner"), stage(spark.range(4), "kept", lasting=True)
        assert not there(inner) and there(outer) and there(kept)
        made = []
        work = threading.Thread(target=copy_context().run, args=(lambda: made.append(stage(spark.range(5), "pool")),))
        work.start()
        work.join()
        assert made[0].count() == 5
    assert not there(outer) and not there(made[0]) and there(outside) and there(kept)
    for df in (outside, kept):
        discard(df)
    assert not there(outside) and not there(kept)
