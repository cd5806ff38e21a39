from weftmat.plans import scratch


def test_driver_garbage_is_collected_when_the_heap_has_grown(spark, monkeypatch):
    assert not scratch.release(spark)  # a local driver is also the executor
    monkeypatch.setattr(scratch, "_local", lambda s: False)
    monkeypatch.setattr(scratch, "_collected", float("-inf"))
    monkeypatch.setattr(scratch, "HEAP_SHARE", 2)
    assert not scratch.release(spark)
    monkeypatch.setattr(scratch, "HEAP_SHARE", 0)
    assert scratch.release(spark)
    assert not scratch.release(spark)  # not again at once
