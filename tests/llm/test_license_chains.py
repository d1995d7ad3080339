"""Chains look back as far as a gap may reach, however many matches stand between."""

import random

from wardline.llm.license_scan import chains


def test_chains_over_many_matches():
    parts = [(0, 0, 0, 40), (0, 41, 90, 40)]  # template, place, word, words: two parts of a template of 100 words
    between = [(0, 0, word, 3) for word in range(41, 81)]  # its first words again and again
    for matches in (parts, parts + between):
        assert (0, 0, 129, 0.8) in chains(matches, [100])
    far = [(0, 0, 0, 40), (0, 41, 141, 40)]  # a gap of more than the template
    assert chains(far, [100]) == []


def test_chains_equal_all_chains():
    """The best chain that ends at each match, over all matches before it."""
    rng = random.Random(2)
    for _ in range(60):
        size = rng.randint(10, 40)
        matches = sorted({(0, rng.randint(0, size - 4), rng.randint(0, 120), rng.randint(3, 12)) for _ in range(rng.randint(1, 25))}, key=lambda m: (m[2], m[1], m[3]))
        best = []
        for i, (_, place, word, n) in enumerate(matches):
            got, start = n, word
            for (_, p2, w2, n2), (b2, s2) in zip(matches[:i], best):
                over = max(0, w2 + n2 - word, p2 + n2 - place)
                if w2 < word and p2 < place and word - w2 - n2 <= size and over < n and b2 + n - over > got:
                    got, start = b2 + n - over, s2
            best.append((got, start))
        want = [(0, s, w + n - 1, min(1.0, g / size)) for (_, _, w, n), (g, s) in zip(matches, best) if g >= 0.7 * size]
        assert chains(matches, [size]) == want
