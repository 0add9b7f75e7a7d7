"""Names of notes, keys, scales and intervals: small tables, rules over them, and Column forms."""

from __future__ import annotations

import math
import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .convert import _c, hz_to_midi, midi_to_hz

# The ten thaats, the 72 melakarta names, svara names, note letters.
THAAT = {
    "asavari": (0, 2, 3, 5, 7, 8, 10), "bhairav": (0, 1, 4, 5, 7, 8, 11), "bhairavi": (0, 1, 3, 5, 7, 8, 10),
    "bilaval": (0, 2, 4, 5, 7, 9, 11), "kafi": (0, 2, 3, 5, 7, 9, 10), "kalyan": (0, 2, 4, 6, 7, 9, 11),
    "khamaj": (0, 2, 4, 5, 7, 9, 10), "marva": (0, 1, 4, 6, 7, 9, 11), "poorvi": (0, 1, 4, 6, 7, 8, 11),
    "todi": (0, 1, 3, 6, 7, 8, 11),
}
MELAKARTA = (
    "kanakangi ratnangi ganamurthi vanaspathi manavathi tanarupi senavathi hanumathodi dhenuka natakapriya kokilapriya "
    "rupavathi gayakapriya vakulabharanam mayamalavagaula chakravakom suryakantham hatakambari jhankaradhwani "
    "natabhairavi keeravani kharaharapriya gaurimanohari varunapriya mararanjini charukesi sarasangi harikambhoji "
    "dheerasankarabharanam naganandini yagapriya ragavardhini gangeyabhushani vagadheeswari sulini chalanatta salagam "
    "jalarnavam jhalavarali navaneetham pavani raghupriya gavambodhi bhavapriya subhapanthuvarali shadvidhamargini "
    "suvarnangi divyamani dhavalambari namanarayani kamavardhini ramapriya gamanasrama viswambhari syamalangi "
    "shanmukhapriya simhendramadhyamam hemavathi dharmavathi neethimathi kanthamani rishabhapriya latangi vachaspathi "
    "mechakalyani chitrambari sucharitra jyotisvarupini dhatuvardhini nasikabhushani kosalam rasikapriya"
).split()
SVARA_LONG = ("Sa", "re", "Re", "ga", "Ga", "ma", "Ma", "Pa", "dha", "Dha", "ni", "Ni")
SVARA_SHORT = ("S", "r", "R", "g", "G", "m", "M", "P", "d", "D", "n", "N")
LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
FIFTHS = "FCGDAEB"
MODES = ("ion", "dor", "phr", "lyd", "mix", "aeo", "loc")
MAJOR = (0, 2, 4, 5, 7, 9, 11)
MINOR = (0, 2, 3, 5, 7, 8, 10)
SHARP, FLAT, DOUBLE_SHARP, DOUBLE_FLAT = "♯", "♭", "𝄪", "𝄫"
_STEP = {"#": 1, "♯": 1, "b": -1, "!": -1, "♭": -1, "n": 0, "♮": 0, "𝄪": 2, "𝄫": -2}


def thaat_to_degrees(thaat: str) -> list[int]:
    if thaat.lower() not in THAAT:
        raise ValueError(f"unknown thaat: {thaat}")
    return list(THAAT[thaat.lower()])


def list_thaat() -> list[str]:
    return sorted(THAAT)


def list_mela() -> dict[str, int]:
    return {name: k for k, name in enumerate(MELAKARTA, 1)}


def _mela(mela: int | str) -> int:
    number = list_mela().get(mela.lower(), 0) if isinstance(mela, str) else mela
    if not 1 <= number <= 72:
        raise ValueError(f"unknown melakarta: {mela}")
    return number - 1


#: A melakarta's number picks one of six pairs for Ri and Ga (by groups of six) and one of six for Dha and Ni.
_PAIRS = [(a, b) for a in (1, 2, 3) for b in (2, 3, 4) if b > a]


def mela_to_degrees(mela: int | str) -> list[int]:
    k = _mela(mela)
    lower, upper = _PAIRS[k % 36 // 6], _PAIRS[k % 6]
    return [0, *lower, 5 + k // 36, 7, *(x + 7 for x in upper)]


def mela_to_svara(mela: int | str, abbr: bool = True, unicode: bool = True) -> list[str]:
    """Names of all twelve steps; of two names for one step, the melakarta's own, else the usual one."""
    k = _mela(mela)
    (ri, _), (dha, _) = _PAIRS[k % 36 // 6], _PAIRS[k % 6]
    subscript = "₁₂₃" if unicode else "123"
    full = {"S": "Sa", "R": "Ri", "G": "Ga", "M": "Ma", "P": "Pa", "D": "Dha", "N": "Ni"}
    names = ["S", "R1", "R2" if k % 36 >= 6 else "G1", "R3" if ri == 3 else "G2", "G3", "M1", "M2", "P", "D1", "D2" if k % 6 else "N1", "D3" if dha == 3 else "N2", "N3"]
    return [(n[0] if abbr else full[n[0]]) + (subscript[int(n[1]) - 1] if len(n) > 1 else "") for n in names]


def accidental(text: str) -> int:
    return sum(_STEP.get(c, 0) for c in text)


def _spell(step: int, unicode: bool) -> str:
    if not unicode:
        return "#" * step if step > 0 else "b" * -step
    double, single = (DOUBLE_SHARP, SHARP) if step > 0 else (DOUBLE_FLAT, FLAT)
    return double * (abs(step) // 2) + single * (abs(step) % 2)


def _key(key: str) -> tuple[str, int, str]:
    m = re.fullmatch(r"([A-Ga-g])([#b!n♯♭♮𝄪𝄫]*):(.{3}).*", key)
    if not m or m[3].lower() not in ("maj", "min", *MODES):
        raise ValueError(f"improper key: {key}")
    return m[1].upper(), accidental(m[2]), m[3].lower()


def _as_major(letter: str, step: int, mode: str) -> tuple[str, int]:
    """Letter and accidental of the major key that has the same notes as a mode on the given tonic."""
    degree = MODES.index(mode)
    letters = "CDEFGAB"
    tonic = letters[(letters.index(letter) - degree) % 7]
    want = (LETTERS[letter] + step - MAJOR[degree]) % 12
    return tonic, (want - LETTERS[tonic] + 6) % 12 - 6


def key_to_degrees(key: str) -> list[int]:
    letter, step, scale = _key(key)
    if scale in MODES:
        tonic, acc = _as_major(letter, step, scale)
        notes = [(d + LETTERS[tonic] + acc) % 12 for d in MAJOR]
        turn = MODES.index(scale)
        return notes[turn:] + notes[:turn]
    return [(d + LETTERS[letter] + step) % 12 for d in (MAJOR if scale == "maj" else MINOR)]


def key_to_notes(key: str, unicode: bool = True) -> list[str]:
    """Spellings of the twelve semitones in a key: sharps or flats by its place on the circle of fifths."""
    letter, step, scale = _key(key)
    if scale in MODES:
        letter, step = _as_major(letter, step, scale)
        scale = "maj"
    place = ((LETTERS[letter] + step) * 7 + (0 if scale == "maj" else 9)) % 12
    sharps = step > 0 or step == 0 and (place < 6 or place == 6 and scale == "maj")
    many = 12 if place == 0 and letter == "B" else place
    if not sharps:
        many = (12 - place) % 12
    # each fifth beyond the fifth one respells the next step of the circle from its neighbouring letter
    count = max(0, many - 5)
    out = []
    for tone in range(12):
        own = [n for n in FIFTHS if LETTERS[n] == tone]
        if sharps:
            name = own[0] if own else next(n for n in FIFTHS if LETTERS[n] == tone - 1) + _spell(1, unicode)
            order = [(5 + 7 * k) % 12 for k in range(7)]
            if tone in order[:count]:
                base = "CDEFGAB"[("CDEFGAB".index(own[0]) - 1) % 7] if own else name[0]
                gap = (tone - LETTERS[base]) % 12
                name = base + (_spell(gap, unicode) if unicode else "#" * gap)
        else:
            name = own[0] if own else next(n for n in FIFTHS if LETTERS[n] == tone + 1) + _spell(-1, unicode)
            order = [(11 + 5 * k) % 12 for k in range(6)]
            if tone in order[:count]:
                base = "CDEFGAB"[("CDEFGAB".index(own[0]) + 1) % 7] if own else name[0]
                gap = (LETTERS[base] - tone) % 12
                name = base + (_spell(-gap, unicode) if unicode else "b" * gap)
        out.append(name)
    return out


def fifths_to_note(unison: str, fifths: int, unicode: bool = True) -> str:
    if not unison or unison[0].upper() not in LETTERS:
        raise ValueError(f"improper note: {unison}")
    at = FIFTHS.index(unison[0].upper()) + fifths
    return FIFTHS[at % 7] + _spell(accidental(unison[1:]) + at // 7, unicode)


def _balanced(x: float) -> float:
    """log2 of x without whole octaves, in [-1/2, 1/2]."""
    return x - math.floor(x + 0.5)


def _ratio(interval: float) -> dict[int, int] | None:
    """Prime powers of an interval within an octave, of the table that FJS names are made for.

    The table holds just intervals of small height: Pythagorean ones up to 76 fifths, and products of few primes up to
    23. It is searched by rule: candidates p/q of primes above 3 times a power of 3, within a millionth.
    """
    target = 2.0 ** (math.log2(interval) % 1.0)
    best = None
    for primes in _OTHERS:
        rest = sum(e * math.log2(p) for p, e in primes.items())
        reach = 80 if not primes else 12
        for k in sorted(range(-reach, reach + 1), key=abs):
            folded = 2.0 ** ((k * math.log2(3.0) + rest) % 1.0)
            if abs(folded - target) <= 1e-6:
                cost = abs(k) * math.log2(3.0) + sum(abs(e) * math.log2(p) for p, e in primes.items())
                if best is None or cost < best[0]:
                    best = (cost, {**primes})
                break
    return None if best is None else best[1]


def _others() -> list[dict[int, int]]:
    out: list[dict[int, int]] = [{}]
    for p, e in ((5, 3), (7, 2), (11, 1), (13, 1), (17, 1), (19, 1), (23, 1)):
        out += [{**o, p: k} for o in list(out) for k in range(-e, e + 1) if k and sum(map(abs, o.values())) + abs(k) <= 3]
    return [*out, {5: 4}, {5: -4}]


_OTHERS = _others()


def interval_to_fjs(interval: float, unison: str = "C", tolerance: float = 65.0 / 63.0, unicode: bool = True) -> str:
    if interval <= 0:
        raise ValueError("an interval is positive")
    within = abs(math.log2(tolerance))
    size = math.log2(interval)
    fifths = next((k * s for k in range(32) for s in (1, -1) if abs(_balanced(size - k * s * math.log2(3.0))) <= within), 32)
    primes = _ratio(interval)
    if primes is None:
        raise ValueError(f"unknown interval: {interval}")
    over, under = (math.prod(p ** abs(e) for p, e in primes.items() if e * s > 0) for s in (1, -1))
    name = fifths_to_note(unison, fifths, unicode)
    if over > 1:
        name += str(over).translate(str.maketrans("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")) if unicode else f"^{over}"
    if under > 1:
        name += str(under).translate(str.maketrans("0123456789", "₀₁₂₃₄₅₆₇₈₉")) if unicode else f"_{under}"
    return name


# Column forms


def note_to_midi(note, round_midi: bool = True) -> Column:
    """Letter, accidentals, octave (0 if absent), cents; anything else raises."""
    n = _c(note)
    pattern = "^([A-Ga-g])([#♯b!♭]*)([+-]?[0-9]+)?([+-][0-9]+)?$"
    part = lambda k: F.regexp_extract(n, pattern, k)
    acc = part(2)
    up = F.length(F.regexp_replace(acc, "[b!♭]", ""))
    down = F.length(acc) - up
    base = F.create_map(*(F.lit(x) for x in chain.from_iterable(LETTERS.items())))[F.upper(part(1))]
    octave = F.when(part(3) == "", F.lit(0)).otherwise(part(3).cast("int"))
    cents = F.when(part(4) == "", F.lit(0)).otherwise(part(4).cast("int")) * 0.01
    midi = 12.0 * (octave + 1) + base + up - down + cents
    midi = F.round(midi) if round_midi else midi
    return F.when(n.isNull(), F.lit(None)).when(n.rlike(pattern), midi).otherwise(F.raise_error(F.concat(F.lit("improper note: "), n)).cast("double"))


def note_to_hz(note) -> Column:
    return midi_to_hz(note_to_midi(note, round_midi=False))


def midi_to_note(midi, octave: bool = True, cents: bool = False, unicode: bool = True) -> Column:
    if cents and not octave:
        raise ValueError("cents need the octave")
    sharp = SHARP if unicode else "#"
    names = [n for x in "CDEFGAB" for n in ([x] if x in "EB" else [x, x + sharp])]
    m = _c(midi).cast("double")
    whole = F.round(m).cast("int")
    out = F.element_at(F.array(*map(F.lit, names)), F.pmod(whole, F.lit(12)) + 1)
    if octave:
        twelfth = whole / F.lit(12.0)
        out = F.concat(out, (F.when(twelfth < 0, F.ceil(twelfth)).otherwise(F.floor(twelfth)) - 1).cast("int").cast("string"))
    if cents:
        off = F.round(100.0 * (m - whole)).cast("int")
        out = F.concat(out, F.when(off >= 0, F.lit("+")).otherwise(F.lit("")), off.cast("string"))
    return out


def hz_to_note(hz, octave: bool = True, cents: bool = False, unicode: bool = True) -> Column:
    return midi_to_note(hz_to_midi(hz), octave, cents, unicode)


def _svara(number: Column, names: list[str], octave: bool, unicode: bool) -> Column:
    out = F.element_at(F.array(*map(F.lit, names)), F.pmod(number, F.lit(12)) + 1)
    if not octave:
        return out
    above, below = ("̇", "̣") if unicode else ("'", ",")
    mark = lambda m: F.regexp_replace(out, "^(.)", "$1" + m) if unicode else F.concat(out, F.lit(m))
    return F.when(number.between(12, 23), mark(above)).when(number.between(-12, -1), mark(below)).otherwise(out)


def midi_to_svara_h(midi, sa: float, abbr: bool = True, octave: bool = True, unicode: bool = True) -> Column:
    return _svara(F.round(_c(midi) - sa).cast("int"), list(SVARA_SHORT if abbr else SVARA_LONG), octave, unicode)


def midi_to_svara_c(midi, sa: float, mela: int | str, abbr: bool = True, octave: bool = True, unicode: bool = True) -> Column:
    return _svara(F.round(_c(midi) - sa).cast("int"), mela_to_svara(mela, abbr, unicode), octave, unicode)


def hz_to_svara_h(hz, sa: float, abbr: bool = True, octave: bool = True, unicode: bool = True) -> Column:
    return midi_to_svara_h(hz_to_midi(hz), 12 * (math.log2(sa) - math.log2(440.0)) + 69, abbr, octave, unicode)


def hz_to_svara_c(hz, sa: float, mela: int | str, abbr: bool = True, octave: bool = True, unicode: bool = True) -> Column:
    return midi_to_svara_c(hz_to_midi(hz), 12 * (math.log2(sa) - math.log2(440.0)) + 69, mela, abbr, octave, unicode)


def note_number(note: str) -> float:
    """The MIDI number of a note's name, on the driver."""
    m = re.fullmatch(r"([A-Ga-g])([#♯b!♭]*)([+-]?\d+)?([+-]\d+)?", note)
    if not m:
        raise ValueError(f"improper note: {note}")
    return 12.0 * (int(m[3] or 0) + 1) + LETTERS[m[1].upper()] + accidental(m[2]) + int(m[4] or 0) / 100


def note_to_svara_h(note, sa: str, abbr: bool = True, octave: bool = True, unicode: bool = True) -> Column:
    return midi_to_svara_h(note_to_midi(note, False), float(round(note_number(sa))), abbr, octave, unicode)


def note_to_svara_c(note, sa: str, mela: int | str, abbr: bool = True, octave: bool = True, unicode: bool = True) -> Column:
    return midi_to_svara_c(note_to_midi(note, False), float(round(note_number(sa))), mela, abbr, octave, unicode)
