"""Small documents with everything that is odd about real ones."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, digest int, rep int, score string"


def documents(seed: int = 0, n: int = 60) -> list[tuple]:
    """Prose of few words, so that lines, passages and near copies repeat; nulls, empty texts, odd characters."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Über", "ÉCOLE", "naïve", "東京", "😀smile", "don't", "x_y"]
    lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 14))) for _ in range(12)]
    texts: list[str | None] = [None, "", " ", "\n", "\n\n\t\n", "!!! ???", "one", "one two three", "ONE two THREE", "a" * 30_000, "long " * 6_000]
    while len(texts) < n:
        kind = rnd.random()
        if kind < 0.3 and len(texts) > 12:
            base = rnd.choice(texts[11:]) or ""
            parts = base.split(" ")
            for _ in range(rnd.randint(0, 3)):
                if parts:
                    parts[rnd.randrange(len(parts))] = rnd.choice(words)
            texts.append(" ".join(parts))
        elif kind < 0.4:
            texts.append(rnd.choice(texts))
        else:
            texts.append("\n".join(rnd.choice([rnd.choice(lines), "  " + rnd.choice(lines).upper() + "\t", " ".join(rnd.choice(words) for _ in range(30))]) for _ in range(rnd.randint(1, 8))))
    return [(i * 3 + 1, t, "en", "src", len(t or ""), "clash", 1, 2, None) for i, t in enumerate(texts)]
