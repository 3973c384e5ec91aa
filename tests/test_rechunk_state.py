"""The state of ``rechunk_stream``, without Spark: what a bucket asks of the store."""

import pickle
import random

import pandas as pd

from veilmark.streaming.rechunk import ChunkOrder


class Store:
    """A map state in memory that counts its requests."""

    def __init__(self):
        self.rows, self.requests = {}, 0

    def getValue(self, key):
        self.requests += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.requests += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.requests += 1
        self.rows.pop(key, None)


class Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, *schemas):
        return self.states.setdefault(name, Store())

    def requests(self):
        return sum(s.requests for s in self.states.values())


def run(handle, rows, **more):
    order = ChunkOrder(len, None, 0, **more)
    order.init(handle)
    frame = pd.DataFrame({"bucket": [0], "packed": [pickle.dumps(rows)]})
    done = []
    for out in order.handleInputRows((0,), iter([frame]), None):
        # as they come, also in large numbers
        done += zip(*(out[c].tolist() for c in out.columns))
    return done


def text_of(rows):
    found = {}
    for stream, _, chunk, _, _ in rows:
        found[stream] = found.get(stream, b"") + chunk
    return found


def test_requests_to_the_state_do_not_grow_with_the_streams():
    def requests(streams):
        handle = Handle()
        half = [(str(s), seq, b"%d." % seq, seq == 3) for s in range(streams) for seq in (1, 3)]
        rest = [(str(s), seq, b"%d." % seq, False) for s in range(streams) for seq in (0, 2)]
        assert run(handle, half) == []
        assert text_of(run(handle, rest)) == {s: b"0.1.2.3." for s in range(streams)}
        return handle.requests()

    assert requests(3200) < 3200 / 4


def test_any_order_of_delivery_gives_every_byte_once():
    rng = random.Random(5)
    rows = [(str(s), seq, b"<%d-%d>" % (s, seq), seq == 40) for s in range(30) for seq in range(41)]
    rows += rng.sample(rows, 200)  # delivered again
    rng.shuffle(rows)
    for held_bytes in (1 << 30, 50):
        handle, out = Handle(), []
        for at in range(0, len(rows), 150):
            out += run(handle, rows[at : at + 150], held_bytes=held_bytes)
        assert text_of(out) == {s: b"".join(b"<%d-%d>" % (s, k) for k in range(41)) for s in range(30)}
        assert not handle.states["parcels"].rows


def test_large_and_null_ids_beside_each_other():
    big = (1 << 62) + 1
    rows = [("", 0, b"a", True), (str(big), 0, b"b", False), (str(big), big, b"d", False), (str(big), None, None, True)]
    assert sorted(run(Handle(), rows), key=lambda r: r[2]) == [
        (pd.NA, 0, b"a", True, "eos"), (big, 0, b"b", False, "chunk"), (big, big, b"d", True, "timeout")]
