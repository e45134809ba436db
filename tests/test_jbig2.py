"""Coding held against the standard's own sequence, round trips, and streams made here."""

import struct

import numpy as np
import pytest

from pagelume.operators import jbig2 as J

PLAIN = bytes.fromhex("00020051000000C0035287 2AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF".replace(" ", ""))
CODED = bytes.fromhex("84C73BFCE1A1430402200000410DBB86F4317FFF88FF37471ADB6ADFFFAC")


def page(seed=0, h=60, w=75):
    rng = np.random.default_rng(seed)
    ink = np.zeros((h, w), bool)
    for _ in range(12):
        y, x = rng.integers(0, h - 8), rng.integers(0, w - 10)
        ink[y : y + 6, x : x + rng.integers(2, 10)] = True
    return ink ^ (rng.random((h, w)) < 0.01)


def test_arithmetic_coder_gives_the_sequence_of_the_standard():
    bits = [b >> (7 - k) & 1 for b in PLAIN for k in range(8)]
    e, cx = J.Encoder(), J.Contexts(1)
    for b in bits:
        e.put(cx, 0, b)
    assert e.finish() == CODED
    d, cx = J.Decoder(CODED), J.Contexts(1)
    assert [d.get(cx, 0) for _ in bits] == bits


@pytest.mark.parametrize("template", range(4))
@pytest.mark.parametrize("typical", [True, False])
def test_generic_regions_round_trip(template, typical):
    for ink in (page(1), np.zeros((5, 9), bool), np.ones((3, 1), bool), page(2, 33, 130)):
        h, w = ink.shape
        got = J.decode_generic(J.Decoder(J.encode_generic(ink, template, typical)), w, h, template, typical, J.USUAL[template], J.Contexts(1 << 16))
        assert np.array_equal(got, ink)


def test_embedded_streams_round_trip_and_are_small():
    ink = page(3)
    data = J.embedded(ink)
    assert np.array_equal(J.decode(data), ink) and len(data) < ink.size // 8 + 60
    assert [(p["name"], p["coding"], p["template"]) for p in J.profile(data)] == [("page-information", None, None), ("generic-region", "arithmetic", 0)]
    assert J.plan(data) == {"width": 75, "height": 60, "pixels": 4500}


class Ints:
    """The coding of integers, turned around."""

    def __init__(self):
        self.cx = J.Contexts(512)

    def put(self, e, v):
        bits = [1, 0, 0, 0] if v is None else None
        if bits is None:
            bits = [int(v < 0)]
            v = abs(v)
            k = next(i for i, (n, base) in enumerate(J._RANGES) if v < base + (1 << n))
            n, base = J._RANGES[k]
            bits += [1] * k + [0] * (k < 5) + [(v - base) >> (n - 1 - i) & 1 for i in range(n)]
        prev = 1
        for b in bits:
            e.put(self.cx, prev, b)
            prev = prev << 1 | b if prev < 256 else ((prev << 1 | b) & 511) | 256


def test_integers_round_trip():
    values = [0, 1, -1, 3, 4, -19, 20, 83, 84, 339, 340, 4435, 4436, -100000, None, 7]
    e, i = J.Encoder(), Ints()
    for v in values:
        i.put(e, v)
    d, back = J.Decoder(e.finish()), J.Integers()
    assert [back.get(d) for _ in values] == values


def glyphs():
    a, b = np.zeros((5, 4), bool), np.ones((5, 3), bool)
    a[::2] = True
    return [a, b]


def put_generic(e, cx, ink):
    wide = np.pad(ink.astype(np.uint8), ((0, 0), (J._PAD, J._PAD)))
    places = J._places(0, J.USUAL[0])
    for y in range(ink.shape[0]):
        above, inside = J._above(wide, y, places, ink.shape[1])
        for x in range(ink.shape[1]):
            k = above[x] | sum(int(wide[y, J._PAD + x + dx]) << s for s, dx in inside)
            e.put(cx, k, int(ink[y, x]))


def dictionary(number, export=2):
    e, cx = J.Encoder(), J.Contexts(1 << 16)
    dh, dw, ex = Ints(), Ints(), Ints()
    dh.put(e, 5)
    width = 0
    for g in glyphs():
        dw.put(e, g.shape[1] - width)
        width = g.shape[1]
        put_generic(e, cx, g)
    dw.put(e, None)
    ex.put(e, 0)
    ex.put(e, 2)
    at = b"".join(struct.pack(">bb", *p) for p in J.USUAL[0])
    return J._segment(number, 0, struct.pack(">H", 0) + at + struct.pack(">II", export, 2) + e.finish())


def text(number, refers, flags_corner, placed, turned=False):
    """placed: (symbol, s of the reference corner's side where writing starts, t)."""
    e = J.Encoder()
    dt, fs, ds, cx = Ints(), Ints(), Ints(), J.Contexts(4)
    dt.put(e, 0)
    t0, s0 = 0, 0
    for t in sorted({t for _, _, t in placed}):
        dt.put(e, t - t0)
        t0, at = t, None
        for n, s, _ in (p for p in placed if p[2] == t):
            if at is None:
                fs.put(e, s - s0)
                s0 = s
            else:
                ds.put(e, s - at)
            e.put(cx, 1, n)
            g = glyphs()[n]
            at = s + (g.shape[0] if turned else g.shape[1]) - 1
        ds.put(e, None)
    flags = flags_corner << 4 | turned << 6
    return J._segment(number, 6, struct.pack(">IIIIB", 40, 30, 2, 1, 0) + struct.pack(">HI", flags, len(placed)) + e.finish(), refers)


@pytest.mark.parametrize("corner", range(4))
@pytest.mark.parametrize("turned", [False, True])
def test_symbols_are_placed_at_their_corner(corner, turned):
    placed = [(0, 3, 8), (1, 12, 8), (0, 5, 20), (0, 15, 20)]
    info = J._segment(0, 48, struct.pack(">IIIIBH", 50, 40, 0, 0, 0, 0))
    got = J.decode(info + text(2, (1,), corner, placed, turned), dictionary(1))
    want = np.zeros((40, 50), bool)
    for n, s, t in placed:
        g = glyphs()[n]
        h, w = g.shape
        if turned:
            x, y = (t - (w - 1) if corner in (2, 3) else t), s
        else:
            x, y = s, (t - (h - 1) if corner in (0, 2) else t)
        J._combine(want, g, x + 2, y + 1, 0)
    assert np.array_equal(got, want)


@pytest.mark.parametrize("how", range(5))
def test_combinations(how):
    a, b = page(5, 12, 12), page(6, 12, 12)
    want = [a | b, a & b, a ^ b, ~(a ^ b), b][how]
    got = a.copy()
    J._combine(got, b, 0, 0, how)
    assert np.array_equal(got, want)
    J._combine(got, b, 100, -100, how)
    assert np.array_equal(got, want)


def test_what_is_not_read_is_refused_by_name():
    info = J._segment(0, 48, struct.pack(">IIIIBH", 50, 40, 0, 0, 0, 0))
    region = struct.pack(">IIIIB", 9, 9, 0, 0, 0)
    bad = [
        b"", b"\0\0", J.embedded(page())[:-5], J._segment(0, 48, struct.pack(">IIIIBH", 1 << 20, 1 << 20, 0, 0, 0, 0)), info + J._segment(1, 22, region), info + J._segment(1, 38, region + b"\1"),
        info + J._segment(1, 38, struct.pack(">IIIIB", 1 << 31, 1 << 31, 0, 0, 0) + b"\0"), info + J._segment(1, 6, region + b"\0\1" + bytes(8)), info + J._segment(1, 6, region + b"\0\2" + bytes(8)),
        info + dictionary(1, 1), info + J._segment(1, 38, region + b"\0" + bytes([0, 0]) * 4),
    ]
    for data in bad:
        with pytest.raises(J.Refused):
            J.decode(data)
