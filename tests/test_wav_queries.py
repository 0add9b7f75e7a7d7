"""The queries that write WAV files and read them back hold every signal."""

import numpy as np

from wavetide import registry
from wavetide.queries.base import wide


def test_every_signal_is_written_and_read(spark, data):
    want = {f"{r['signal_id']}.wav": np.array(r["y"]) / 128 for r in wide(spark, data).collect()}
    assert len(want) > 8
    got = {r["name"]: r for r in registry.queries()["load"](spark, data).collect()}
    assert got.keys() == want.keys()
    for name, y in want.items():
        assert (got[name]["sr"], got[name]["channels"]) == (64.0, 1)
        assert np.allclose(got[name]["y"], np.clip(y, -1, 32767 / 32768), atol=1 / 32768)
    info = {r["name"]: (r["n"], r["duration"]) for r in registry.queries()["get_audio_info"](spark, data).collect()}
    assert info == {name: (len(y), len(y) / 64) for name, y in want.items()}
    assert {r["name"] for r in registry.queries()["get_samplerate"](spark, data).collect()} == want.keys()
