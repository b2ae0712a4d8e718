"""Many keys share a call of a streaming step; each still has rows, state and timer of its own."""

from __future__ import annotations

import json

import pandas as pd
import pytest

from carelake.plans import derived as D
from carelake.session import scratch_dir
from carelake.streaming import inbound as SI
from carelake.streaming import keyed
from carelake.streaming.common import run_available_now, stream_parquet, write_time_chunks


SF = "/root/testdata/sf0.001"


class _State:
    def __init__(self, held=None, watermark=0, timed_out=False):
        self.held, self.watermark, self.hasTimedOut, self.timer, self.removed = held, watermark, timed_out, None, False

    exists = property(lambda self: self.held is not None)
    get = property(lambda self: self.held)

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, held):
        self.held = held

    def remove(self):
        self.held, self.removed = None, True

    def setTimeoutTimestamp(self, ms):
        assert ms > self.watermark
        self.timer = ms


def _run(state, rows, opened):
    def fold(key, news, known, watermark, timed_out):
        opened.append((key, timed_out))
        if timed_out:
            return [(key, -1)], None, None
        n = (known or 0) + sum(r["n"] for r in news)
        return [(key, n)], n, watermark + 10 * n
    pdf = pd.DataFrame([(k, json.dumps({"n": n})) for k, n in rows], columns=["key", "row"])
    out = keyed._of_bucket(fold, ["key", "n"], {}, True)((0,), iter([pdf]), state)
    return [tuple(r) for p in out for r in p.itertuples(index=False)]


def test_keys_of_a_bucket_keep_state_and_timer_of_their_own():
    state, opened = _State(watermark=100), []
    assert _run(state, [("a", 1), ("b", 5), ("a", 2)], opened) == [("a", 3), ("b", 5)]
    assert opened == [("a", False), ("b", False)] and state.timer == 130
    state.watermark = 131    # a's timer is due, c is new, b rests: its state isn't opened
    opened.clear()
    assert _run(state, [("c", 9)], opened) == [("c", 9), ("a", -1)]
    assert opened == [("c", False), ("a", True)] and state.held[0] == ["b", "c"] and state.timer == 150
    state.watermark, state.hasTimedOut = 500, True
    assert sorted(_run(state, [], opened)) == [("b", -1), ("c", -1)] and state.removed


def test_results_come_in_frames_of_bounded_size(monkeypatch):
    monkeypatch.setattr(keyed, "RESULT_ROWS", 2)
    pdf = pd.DataFrame([(f"k{i}", "{}") for i in range(5)], columns=["key", "row"])
    run = keyed._of_bucket(lambda k, *_: ([(k, None)], 1, None), ["key", "n"], {"n": "Int64"}, False)
    assert [len(p) for p in run((0,), iter([pdf]), _State())] == [2, 2, 1]


@pytest.mark.parametrize("groups", [1, 4096])
def test_phones_that_share_a_bucket_are_folded_apart(spark, groups, monkeypatch):
    """As many calls as buckets, whatever the number of phones; the same rows as from a bucket a phone."""
    monkeypatch.setattr(SI.fold_keys, "__defaults__", (None, groups))
    root = scratch_dir(spark, "keyed")
    src = D.inbound(spark, SF)
    write_time_chunks(src, "ts", f"{root}/in", 2)
    out = SI.inbound_stream(stream_parquet(spark, f"{root}/in", src.schema), D.conversation_items(spark, SF))
    run_available_now(out.writeStream.format("parquet").option("path", f"{root}/out"), f"{root}/ck", spark, 2)
    got = spark.read.schema(SI.OUTPUT_SCHEMA).parquet(f"{root}/out")
    from carelake.plans import registry
    want = registry.queries()["stream_inbound"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
