"""Invented texts for the tests of this folder."""

import random


def prose(seed: int, words: int = 120) -> str:
    rng = random.Random(seed)
    parts = ["ka", "lo", "mi", "ren", "tas", "ver", "ou", "shi", "da", "pel"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
                    for _ in range(words))


def sample_texts() -> list:
    rng = random.Random(11)
    texts = [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "x\ny\nx\n \nx",
             "a\x1cb\x85c d\u00a0e", "#*$%&|<> é", "a b c " * 30, "é漢🙂 " * 40]
    for i in range(60):
        words = prose(i, rng.randint(1, 200)).split()
        if i % 3 == 0:
            words = words + words[: len(words) // 2]
        marks = [" ", " ", " ", "\n", "\t", "  ", "\r\n", "\x0b"]
        texts.append("".join(w + rng.choice(marks) for w in words))
    return texts
