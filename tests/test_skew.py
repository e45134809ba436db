"""The search for skew against a plain one, angle by angle and band by band."""

import numpy as np
import pytest

from pagelume.operators import skew


def plain_search(x, y):
    def score(degrees):
        a = np.radians(degrees)
        row = np.floor(y * np.cos(a) - x * np.sin(a)).astype(int)
        n = [0, *np.bincount(row - row.min()).tolist(), 0]
        return sum(v * v for v in n), sum((b - a) ** 2 for a, b in zip(n, n[1:]))

    coarse = np.arange(-15, 15.25, 0.5)
    first = [score(d) for d in coarse]
    found = []
    for which in (0, 1):
        at = max(range(61), key=lambda i: first[i][which])
        best = (first[at][which], -coarse[at])
        for d in np.arange(coarse[at] - 0.5, coarse[at] + 0.5125, 0.025):
            if abs(d) <= 15 + 1e-9 and (s := score(d)[which]) > best[0]:
                best = (s, -d)
        found.append(best)
    middle = float(np.median([s for s, _ in first]))
    railed = max(range(61), key=lambda i: first[i][0]) in (0, 60)
    return found[0][1], found[0][0] / middle - 1, found[1][1], railed


@pytest.mark.parametrize("degrees, lines", [(-7.25, 0), (0.0, 3), (3.5, 2), (14.9, 0), (16.0, 0)])
def test_page_and_bands_share_few_turns_and_equal_a_plain_search(monkeypatch, degrees, lines):
    lengths = np.random.default_rng(lines).integers(0, 256, 64).astype(np.uint8)
    grey = skew.ruled(degrees, lengths, side=250, pitch=9, thick=2, margin=30)
    grey[: 80 * lines // 3] = 255  # bands of few points or none
    calls, real = [], skew.profile_scores
    monkeypatch.setattr(skew, "profile_scores", lambda *a: calls.append(1) or real(*a))
    got = skew.measure(grey)
    # The coarse angles once, and the fine ones once for each best angle of the page, of its steps and of three bands.
    assert len(calls) <= 6

    x, y, _, (h, _) = skew.ink_points(grey)
    deg, confidence, alt, railed = plain_search(x, y)
    assert got["confidence"] == confidence and got["railed"] == railed
    if railed or confidence < skew.MIN_CONFIDENCE:
        assert not got["ok"] and got["deg"] == 0 and got["alt_deg"] == 0
        return
    assert got["ok"] and got["deg"] == deg and got["alt_deg"] == alt
    band = np.minimum(y.astype(int) // (h // 3), 2)
    parts = [plain_search(x[band == k], y[band == k]) for k in range(3) if (band == k).sum() >= skew.BAND_POINTS]
    parts = [d for d, c, _, end in parts if c >= skew.MIN_CONFIDENCE and not end]
    assert got["spread"] == (max(parts) - min(parts) if len(parts) >= 2 else -1)


def test_lines_are_drawn_as_pixel_by_pixel():
    lengths = np.random.default_rng(4).integers(0, 256, 64).astype(np.uint8)
    for degrees in (-9.75, 0.0, 2.25):
        a, want = np.radians(-degrees), np.full((192, 192), 255)
        for i in range(192):
            for j in range(192):
                x, y = j - 95.5, i - 95.5
                u, v = x * np.cos(a) + y * np.sin(a), y * np.cos(a) - x * np.sin(a)
                if abs(v) <= 72 and -72 <= u <= 72 - lengths[int((v + 192) // 8) % 64] / 16 and (v + 192) % 8 < 1:
                    want[i, j] = 0
        assert (skew.ruled(degrees, lengths) == want).all()
