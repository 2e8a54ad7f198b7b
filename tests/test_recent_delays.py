"""The delays of a batch are held as arrays and leave in parts."""

import random
import tracemalloc

import numpy as np
import pandas as pd

from tidemark.streaming.capture import RecentDelays


class Ring:
    rows = ()

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows


def processor(last=100):
    out = RecentDelays(last, 0.95)
    out.ring = Ring()
    return out


def test_every_message_reports_its_last_ones():
    chance, p = random.Random(1), processor(7)
    for batch in (range(3), range(3, 60), range(60, 12_000)):
        rows = [(seq // 2, seq, chance.randrange(-5, 90)) for seq in batch]
        before = [ms for ms, in p.ring.rows]
        mixed = chance.sample(rows, len(rows))
        parts = [pd.DataFrame(mixed[i : i + 1000], columns=["us", "seq", "ms"]) for i in range(0, len(mixed), 1000)]
        got = pd.concat(p.handleInputRows(("m",), iter(parts), None))
        assert got["seq"].tolist() == list(batch) and set(got["market"]) == {"m"}
        seen = list(before)
        for (_, _, ms), row in zip(rows, got.itertuples()):
            seen = [*seen, ms][-7:]
            assert row.ms == ms and row.n == len(seen) and abs(row.mean_ms - sum(seen) / len(seen)) < 1e-9
            assert abs(row.p95_ms - np.quantile(seen, 0.95)) < 1e-9
        assert [ms for ms, in p.ring.rows] == seen


def test_memory_of_a_large_batch():
    def parts(n=200_000, step=10_000):
        for i in range(0, n, step):
            us = np.arange(i, i + step)[::-1]
            yield pd.DataFrame({"us": us, "seq": us, "ms": us % 90})

    tracemalloc.start()
    rows = sum(len(out) for out in processor().handleInputRows(("m",), parts(), None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 200_000 and peak < 40e6
