"""Session versions by reverse deletion against sessions made anew after each batch."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillstream.llm import registry
from quillstream.llm.sessions import SessionParams, session_versions

EVENTS = "user long, s long, batch long, h long"


def forward(events, gap):
    """Every version as a tuple, from all events so far after each batch."""
    out = []
    for user in {e[0] for e in events}:
        own = [e for e in events if e[0] == user]
        standing = {}  # of each session's events: the version that holds it
        for batch in sorted({e[2] for e in own}):
            sessions, last = [], None
            for e in sorted((e for e in own if e[2] <= batch), key=lambda e: e[1]):
                if last is None or e[1] - last > gap:
                    sessions.append([])
                sessions[-1].append(e)
                last = e[1]
            for own_events in sessions:
                new = [e for e in own_events if e[2] == batch]
                if not new:
                    continue
                before = {id(v): v for e in own_events if (v := standing.get((e[1], e[2]))) and e[2] < batch}
                version = [user, batch, own_events[0][1], own_events[-1][1], len(own_events), len(new), len(before), sum(e[3] for e in own_events), None, None]
                for v in before.values():
                    v[8], v[9] = batch, version[2]
                for e in own_events:
                    standing[e[1], e[2]] = version
                out.append(version)
    return sorted(map(tuple, out), key=str)


def random_events(seed, users, n, windows, step=None):
    r = random.Random(seed)
    out = []
    for u in range(users):
        s = 1800 * r.randint(-5, 5)
        for _ in range(n):
            s = s + r.randint(1, step) if step else 1800 * r.randint(0, windows) + r.randint(0, 1799)
            out.append((u, s, s // 1800 + r.choice([0, 0, 0, 1, 2, 3]), r.randint(0, 1 << 32)))
    return out


@pytest.mark.parametrize("span", [4, 16])
@pytest.mark.parametrize(("users", "n", "windows", "step"), [(6, 60, 12, None), (2, 700, 30, None), (1, 900, 0, 130), (3, 300, 0, 300)])
def test_against_forward(spark, span, users, n, windows, step):
    """Sparse and dense users, sessions within a block and over many (step: gaps that hardly ever break), ties and repeated rows."""
    events = random_events(span + n, users, n, windows, step)
    events += events[:7]
    got = session_versions(spark.createDataFrame(events, EVENTS), SessionParams(span=span)).collect()
    assert sorted(map(tuple, got), key=str) == forward(events, 240)


def test_one_user_and_session(spark):
    """A session that never breaks over 90 blocks, from a user that holds almost all rows: its carries run through them all."""
    events = [(7, 150 * i, 150 * i // 1800 + (i % 4 if i % 5 == 0 else 0), i) for i in range(4400)] * 2 + [(8, 5, 0, 1)]
    got = session_versions(spark.createDataFrame(events, EVENTS), SessionParams(span=4)).collect()
    final = [r for r in got if r["user"] == 7 and r["retracted_batch"] is None]
    assert len(final) == 1 and final[0]["n_events"] == 8800 and (final[0]["start_s"], final[0]["end_s"]) == (0, 150 * 4399)
    assert sum(r["n_new"] for r in got) == len(events) and final[0]["h_sum"] == sum(e[3] for e in events if e[0] == 7)
    # each version is retracted once, by one that counts it
    assert sum(r["n_retracted"] for r in got) == sum(r["retracted_batch"] is not None for r in got)


def test_edges(spark):
    frame = spark.createDataFrame([(None, 1, 0, 1), (1, None, 0, 1), (1, 1, None, 1), (1, 5, 0, None)], EVENTS).withColumns({c: F.lit(3) for c in ("n", "segment", "block", "start")})
    assert [tuple(r) for r in session_versions(frame).collect()] == [(1, 0, 5, 5, 1, 1, 0, 0, None, None)]
    assert session_versions(frame.limit(0)).count() == 0
    with pytest.raises(Exception, match="too late"):
        session_versions(spark.createDataFrame([(1, 5, 4, 1)], EVENTS)).collect()


def crc(x):
    return zlib.crc32(x.encode())


def test_query(spark, tmp_path):
    """Folds of ids and turns; repeated turns count, null turns and conversations don't, texts play no part."""
    r = random.Random(4)
    rows = [(r.randint(0, 60), r.randint(0, 40), "user", None) for _ in range(900)] + [(3, None, "user", "x"), (None, 2, "user", "x"), (5, 1, None, "y" * 10_000), (5, 1, None, "")] + [(17, t, "user", "hot") for t in range(400)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    events = []
    for conv, turn, *_ in rows:
        if conv is not None and turn is not None:
            c, h = crc(str(conv)), crc(f"{conv}:{turn}")
            s, g = c // 2 % 7200 + 300 * turn + h % 600, h // 600
            events.append((2 * (conv // 8) + c % 2, s, s // 1800 + (g % 4 if g % 5 == 0 else 0), h))
    got = registry.QUERIES["op11_late_sessions"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == forward(events, 240)
