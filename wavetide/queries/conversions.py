"""One query for each scalar conversion, over the sizes of parts."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetide.functions import convert as C
from wavetide.functions import notation as N

from .base import QUERIES, SQL, query, r, table



def x() -> Column:
    return F.col("x")


A4LOG = math.log2(440.0)
STEP = math.log(6.4) / 27.0
MEL = f"CASE WHEN {{0}} >= 1000 THEN 15 + ln({{0}} / 1000) / {STEP!r} ELSE 3 * {{0}} / 200 END"
A_SQL = "{off} + 20 * (log10({c0!r}) + {m} * log10(f2) - log10(f2 + {c0!r}) - log10(f2 + {c1!r}){rest})"
_F2 = "pow(x * 40, 2)"


def _abc(kind: str, m: float, roots: list[str]) -> str:
    rest = "".join(f" - 0.5 * log10(f2 + {C.POLES[k] ** 2!r})" for k in roots)
    sql = A_SQL.format(off=C.OFFSETS[kind], c0=C.POLES["outer"] ** 2, c1=C.POLES["low"] ** 2, m=m, rest=rest).replace("f2", _F2)
    return f"greatest(-80.0, {sql})"


_D = [v * v for v in C.D_CURVE]
D_SQL = f"greatest(-80.0, 20 * (0.5 * log10({_F2}) - log10({C.D_CURVE[0]!r}) + 0.5 * (log10(pow({_D[1]!r} - {_F2}, 2) + {_D[2]!r} * {_F2}) - log10(pow({_D[3]!r} - {_F2}, 2) + {_D[4]!r} * {_F2}) - log10({_D[5]!r} + {_F2}) - log10({_D[6]!r} + {_F2}))))"
MIDI = f"(12 * (log2(x * 40) - {A4LOG!r}) + 69)"
NOTE = "list_extract(['C','C♯','D','D♯','E','F','F♯','G','G♯','A','A♯','B'], CAST(round({0}) AS BIGINT) % 12 + 1)"

#: Name: how to make the Column of x (a whole number from 1 to 50), and the same in SQL.
NUMBERS: dict[str, tuple[Callable[[], Column], str]] = {
    "frames_to_samples": (lambda: C.frames_to_samples(x(), 512, 2048), "x * 512 + 1024"),
    "samples_to_frames": (lambda: C.samples_to_frames(x() * 100 - 1500, 512, 2048), "floor((x * 100 - 1500 - 1024) / 512.0)"),
    "samples_to_frames_scalar": (lambda: C.samples_to_frames_scalar(x() * 100 - 1500, 512), "trunc((x * 100 - 1500) / 512.0)"),
    "frames_to_time": (lambda: C.frames_to_time(x()), "x * 512 / 22050.0"),
    "time_to_frames": (lambda: C.time_to_frames(x() * 0.375), "floor(floor(x * 0.375 * 22050.0) / 512.0)"),
    "time_to_samples": (lambda: C.time_to_samples(x() * 0.375), "floor(x * 0.375 * 22050.0)"),
    "samples_to_time": (lambda: C.samples_to_time(x()), "x / 22050.0"),
    "blocks_to_frames": (lambda: C.blocks_to_frames(x(), 16), "x * 16"),
    "blocks_to_samples": (lambda: C.blocks_to_samples(x(), 16, 512), "x * 16 * 512"),
    "blocks_to_time": (lambda: C.blocks_to_time(x(), 16, 512, 22050.0), "x * 16 * 512 / 22050.0"),
    "midi_to_hz": (lambda: C.midi_to_hz(x()), "440 * pow(2, (x - 69) / 12.0)"),
    "hz_to_midi": (lambda: C.hz_to_midi(x() * 40), MIDI),
    "hz_to_mel": (lambda: C.hz_to_mel(x() * 40), MEL.format("(x * 40.0)")),
    "hz_to_mel_htk": (lambda: C.hz_to_mel(x() * 40, htk=True), "2595 * log10(1 + x * 40 / 700.0)"),
    "mel_to_hz": (lambda: C.mel_to_hz(x()), f"CASE WHEN x >= 15 THEN 1000 * exp({STEP!r} * (x - 15)) ELSE 200 * x / 3.0 END"),
    "mel_to_hz_htk": (lambda: C.mel_to_hz(x() * 40, htk=True), "700 * (pow(10, x * 40 / 2595.0) - 1)"),
    "hz_to_octs": (lambda: C.hz_to_octs(x() * 40, 0.25), f"log2(x * 40 / {440.0 * 2 ** (0.25 / 12) / 16!r})"),
    "octs_to_hz": (lambda: C.octs_to_hz(x() / 10, 0.25), f"{440.0 * 2 ** (0.25 / 12) / 16!r} * pow(2, x / 10.0)"),
    "A4_to_tuning": (lambda: C.A4_to_tuning(x() + 420), f"12 * (log2(x + 420) - {A4LOG!r})"),
    "tuning_to_A4": (lambda: C.tuning_to_A4(x() / 50), "440 * pow(2, x / 50.0 / 12)"),
    "A_weighting": (lambda: C.A_weighting(x() * 40), _abc("A", 2, ["a1", "a2"])),
    "B_weighting": (lambda: C.B_weighting(x() * 40), _abc("B", 1.5, ["b"])),
    "C_weighting": (lambda: C.C_weighting(x() * 40), _abc("C", 1, [])),
    "D_weighting": (lambda: C.D_weighting(x() * 40), D_SQL),
    "Z_weighting": (lambda: C.Z_weighting(x() * 40), "0.0"),
    "frequency_weighting": (lambda: C.frequency_weighting(x() * 40, "B"), _abc("B", 1.5, ["b"])),
    "power_to_db_scalar": (lambda: C.power_to_db(x() / 50, 2.0), f"10 * log10(greatest(1e-10, x / 50.0)) - {10 * math.log10(2.0)!r}"),
    "amplitude_to_db_scalar": (lambda: C.amplitude_to_db(x() / 50), "10 * log10(greatest(1e-10, pow(x / 50.0, 2)))"),
    "db_to_power": (lambda: C.db_to_power(x() - 25, 2.0), "2 * pow(10, (x - 25) * 0.1)"),
    "db_to_amplitude": (lambda: C.db_to_amplitude(x() - 25, 2.0), "sqrt(4 * pow(10, (x - 25) * 0.1))"),
    "mu_compress": (lambda: C.mu_compress((x() - 25) / 25), "floor((sign(x - 25) * ln(1 + 255 * abs((x - 25) / 25.0)) / ln(256) + 1) / 2 * 255 + 0.5) - 128"),
    "mu_compress_raw": (lambda: C.mu_compress((x() - 25) / 25, quantize=False), "sign(x - 25) * ln(1 + 255 * abs((x - 25) / 25.0)) / ln(256)"),
    "mu_expand": (lambda: C.mu_expand(x() - 25), "sign(x - 25) / 255.0 * (pow(256, abs(x - 25) * 2.0 / 256) - 1)"),
    "abs2": (lambda: C.abs2(x(), x() - 25), "x * x + (x - 25) * (x - 25)"),
    "magnitude": (lambda: C.magnitude(x(), x() - 25), "sqrt(x * x + (x - 25) * (x - 25))"),
    "phase": (lambda: C.phase(x() - 25, x() - 20), "atan2(x - 20, x - 25)"),
    "magphase": (lambda: C.unit_phase(x() - 25, x() - 20)[0], "(x - 25) / sqrt((x - 25) * (x - 25) + (x - 20) * (x - 20))"),
    "phasor": (lambda: C.phasor(x() / 10, 2.0)[1], "2 * sin(x / 10.0)"),
    "softmask": (lambda: C.softmask(x() / 1.0, 50.0 - x(), 2.0), "(x * x) / CAST(x * x + (50 - x) * (50 - x) AS DOUBLE)"),
    "valid_int": (lambda: F.floor(x() / 3), "floor(x / 3.0)"),
}

_HINDUSTANI = "list_extract(['S','r','R','g','G','m','M','P','d','D','n','N'], (x + 4) % 12 + 1)"
_CARNATIC = "list_extract(['S','R₁','R₂','G₂','G₃','M₁','M₂','P','D₁','D₂','N₂','N₃'], (x + 4) % 12 + 1)"
#: A dot above (U+0307) the first letter in the octave above, below (U+0323) in the one below.
_MARKED = "substr({name}, 1, 1) || CASE WHEN x BETWEEN 32 AND 43 THEN chr(775) WHEN x BETWEEN 8 AND 19 THEN chr(803) ELSE '' END || substr({name}, 2)"

#: The same for texts.
TEXTS: dict[str, tuple[Callable[[], Column], str]] = {
    "midi_to_note": (lambda: N.midi_to_note(x()), f"{NOTE.format('x')} || CAST(x // 12 - 1 AS VARCHAR)"),
    "hz_to_note": (lambda: N.hz_to_note(x() * 40), f"{NOTE.format(MIDI)} || CAST(CAST(round({MIDI}) AS BIGINT) // 12 - 1 AS VARCHAR)"),
    "midi_to_note_cents": (lambda: N.midi_to_note(x() / 4 + 12, cents=True), f"{NOTE.format('round(x / 4.0 + 12)')} || CAST(CAST(round(x / 4.0 + 12) AS BIGINT) // 12 - 1 AS VARCHAR) || CASE WHEN x / 4.0 + 12 >= round(x / 4.0 + 12) THEN '+' ELSE '' END || CAST(CAST(round(100 * (x / 4.0 + 12 - round(x / 4.0 + 12))) AS BIGINT) AS VARCHAR)"),
    "midi_to_svara_h_octaves": (lambda: N.midi_to_svara_h(x(), 20), f"{_MARKED.format(name=_HINDUSTANI)}"),
    "midi_to_svara_h_plain_octaves": (lambda: N.midi_to_svara_h(x(), 20, unicode=False), f"{_HINDUSTANI} || CASE WHEN x BETWEEN 32 AND 43 THEN chr(39) WHEN x BETWEEN 8 AND 19 THEN ',' ELSE '' END"),
    "midi_to_svara_c_octaves": (lambda: N.midi_to_svara_c(x(), 20, 22), f"{_MARKED.format(name=_CARNATIC)}"),
    "midi_to_svara_h": (lambda: N.midi_to_svara_h(x(), 1, octave=False), "list_extract(['S','r','R','g','G','m','M','P','d','D','n','N'], (x - 1) % 12 + 1)"),
    "midi_to_svara_c": (lambda: N.midi_to_svara_c(x(), 1, 22, octave=False, unicode=False), "list_extract(['S','R1','R2','G2','G3','M1','M2','P','D1','D2','N2','N3'], (x - 1) % 12 + 1)"),
    "hz_to_svara_h": (lambda: N.hz_to_svara_h(x() * 40, 40.0, octave=False), "list_extract(['S','r','R','g','G','m','M','P','d','D','n','N'], CAST(round(12 * log2(x)) AS BIGINT) % 12 + 1)"),
    "hz_to_svara_c": (lambda: N.hz_to_svara_c(x() * 40, 40.0, "kharaharapriya", octave=False, unicode=False), "list_extract(['S','R1','R2','G2','G3','M1','M2','P','D1','D2','N2','N3'], CAST(round(12 * log2(x)) AS BIGINT) % 12 + 1)"),
}

_NAMES = "list_extract(['C','C#','Db','D','Eb','E','F','F#','G','Ab','A','B'], p_size % 12 + 1) || CAST(p_size % 8 AS VARCHAR)"
_NUMBER = "(12 * (p_size % 8 + 1) + list_extract([0,1,1,2,3,4,5,6,7,8,9,11], p_size % 12 + 1))"


def _notes() -> Column:
    return F.concat(F.element_at(F.array(*(F.lit(x) for x in "C C# Db D Eb E F F# G Ab A B".split())), F.col("p_size") % 12 + 1), (F.col("p_size") % 8).cast("string"))


#: Notes by name.
NAMED: dict[str, tuple[Callable[[], Column], str]] = {
    "note_to_midi": (lambda: N.note_to_midi(F.col("note")), f"CAST({_NUMBER} AS DOUBLE)"),
    "note_to_hz": (lambda: r(N.note_to_hz(F.col("note"))), f"round(440 * pow(2, ({_NUMBER} - 69) / 12.0), 6) + 0.0"),
    "note_to_svara_h": (lambda: N.note_to_svara_h(F.col("note"), "C4", octave=False), f"list_extract(['S','r','R','g','G','m','M','P','d','D','n','N'], {_NUMBER} % 12 + 1)"),
    "note_to_svara_c": (lambda: N.note_to_svara_c(F.col("note"), "C4", 22, octave=False, unicode=False), f"list_extract(['S','R1','R2','G2','G3','M1','M2','P','D1','D2','N2','N3'], {_NUMBER} % 12 + 1)"),
}


def _add(name: str, column: Callable[[], Column], sql: str) -> None:
    def run(spark, folder) -> DataFrame:
        rows = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("long").alias("x"), _notes().alias("note"))
        return rows.select("p_partkey", column().alias("value"))

    QUERIES[name], SQL[name] = run, sql


for _name, (_column, _sql) in NUMBERS.items():
    _add(_name, lambda c=_column: r(c().cast("double")), f"SELECT p_partkey, round(CAST({_sql} AS DOUBLE), 6) + 0.0 AS value FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS x FROM part)")
for _name, (_column, _sql) in TEXTS.items():
    _add(_name, _column, f"SELECT p_partkey, {_sql} AS value FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS x FROM part)")
for _name, (_column, _sql) in NAMED.items():
    _add(_name, _column, f"SELECT p_partkey, {_sql} AS value FROM part")
