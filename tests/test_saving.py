import json
import random
from datetime import datetime, timedelta

import pytest

from vellum.operators import edits
from vellum.streaming import saving

SCHEMA = "doc_id string, request_id string, at timestamp, from_version long, edit string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def put(name, after=None):
    return json.dumps({"t": "insert", "after": after, "items": [{"id": name, "form": name}]})


def request(n, doc, from_version, edit):
    return (doc, f"r{n}", datetime(2024, 1, 1) + timedelta(seconds=n), from_version, edit)


def stepped(rows, every):
    """One request after the other, as they come; a plain list of all edits and of all states."""
    docs, out = {}, {}

    def step(r):
        doc, name, _, frm, edit = r
        log, states, waits = docs.setdefault(doc, ([], [[]], []))
        made = [i for i, (n, _) in enumerate(log, 1) if n == name and i >= len(log) // every * every]
        if made:
            out.setdefault(name, []).append(("repeated", made[0], None, None))
        elif frm > len(log):
            waits.append(r)
        elif frm < len(log):
            out.setdefault(name, []).append(("rejected", len(log), [e for _, e in log[max(frm, len(log) // every * every) :]], None))
        else:
            items = [dict(x) for x in states[-1]]
            try:
                edits.apply_edit(items, json.loads(edit))
            except edits.Edit:
                out.setdefault(name, []).append(("unfit", len(log), None, None))
                return
            log.append((name, edit))
            states.append(items)
            out.setdefault(name, []).append(("saved", len(log), None, items if len(log) % every == 0 else None))

    for batch in rows:
        for r in batch:
            docs.setdefault(r[0], ([], [[]], []))
        for doc in {r[0] for r in batch}:
            mine = [r for r in batch if r[0] == doc] + docs[doc][2]
            docs[doc][2].clear()
            for r in sorted(mine, key=lambda r: (r[3], r[2], r[1])):
                step(r)
    return out


def rows_of(got):
    out = {}
    for r in got:
        out.setdefault(r["request_id"], []).append((r["outcome"], r["version"], r["since"], None if r["items"] is None else json.loads(r["items"])))
    return out


def plain(found):
    return {k: sorted(json.dumps(x, sort_keys=True) for x in v) for k, v in found.items()}


def random_requests(seed, n):
    rng, at, out = random.Random(seed), {}, []
    for k in range(n):
        doc = rng.choice("aab")
        head = at.get(doc, 0)
        frm = max(0, head + rng.choice([0, 0, 0, 0, -1, -4, 9]))
        good = rng.random() < 0.8
        out.append(request(k, doc, frm, put(f"w{k}") if good else json.dumps({"t": "delete", "ids": ["none"]})))
        at[doc] = head + (good and frm == head)
    return out


def test_batch(spark):
    rows = random_requests(1, 60)
    got = rows_of(saving.save_batch(spark.createDataFrame(rows, SCHEMA), 5).collect())
    want = stepped([rows], 5)
    assert plain(got) == plain(want)
    assert {"saved", "rejected", "unfit"} <= {v[0][0] for v in got.values()}
    assert saving.save_batch(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


def test_stream_started_anew_goes_on(rocks, tmp_path):
    """Requests out of order and sent twice, in batches, the query stopped and started after each."""
    rows = random_requests(2, 36)
    rng = random.Random(3)
    late = rows[:]
    for _ in range(8):  # some come later than they were made
        i = rng.randrange(len(late) - 5)
        late.insert(i + 5, late.pop(i))
    batches = [late[:9], late[9:18] + late[4:9], late[18:27] + late[12:18], late[27:] + late[20:27]]
    found = []
    for i, batch in enumerate(batches):
        rocks.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = rocks.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        out = saving.save_stream(stream, 4).writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state"))
        query = out.trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    got, want = rows_of(found), stepped(batches, 4)
    assert plain(got) == plain(want)
    assert {"saved", "rejected", "repeated"} <= {x[0] for v in got.values() for x in v}


def test_batch_hands_python_no_groups(spark):
    df = spark.createDataFrame(random_requests(2, 20), SCHEMA)
    assert "FlatMapGroups" not in saving.save_batch(df)._jdf.queryExecution().toString()
