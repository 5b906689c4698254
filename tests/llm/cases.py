"""A small table with the awkward rows that every operator must take: nulls, repeats, ties, long and empty texts."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, score double, row_key long"


def awkward(seed: int = 1) -> list[tuple]:
    rnd = random.Random(seed)
    vocabulary = ["the", "and", "of", "thing", "Élan", "don't", "x" * 60, "4711", "été", "naïve,", "A.B", "中文", "##", "ß"]

    def words(n: int) -> str:
        return " ".join(rnd.choice(vocabulary) + (str(rnd.randint(0, 40)) if rnd.random() < 0.6 else "") for _ in range(n))

    base, passage = words(120), words(90)
    texts = [words(rnd.choice([0, 1, 3, 4, 5, 9, 30, 200])) for _ in range(40)]
    texts += [base, base, base.upper(), base + " end", base.replace("the", "THE"), " ".join(base.split()[:-4]), passage + " " + words(30),
              words(25) + "\n" + passage, passage, "", " \t\n", "!!! ??? 123", None, None, words(6000), "a" * 5000, "<|endoftext|> and <|startoftext|>",
              "same line\nsame line\n\n same line\nsame line", "word " * 50, "Σίσυφος ΣΑΣ İx", "a b c　d", "line\r\nline\u000bx\u000cy"]
    rows = [(i, t, rnd.choice(["en", "fr", None]), f"s{i % 3}", 7, 1, 0.5, 3) for i, t in enumerate(texts)]
    rows += [rows[3], rows[40], (40, texts[2], "en", "s", 1, 1, 0.1, 1), (None, base, "fr", None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


def words_of(text: str | None, separators: str = " \t\n\x0b\x0c\r") -> list[str]:
    found, current = [], ""
    for c in text or "":
        if c in separators:
            if current:
                found.append(current)
            current = ""
        else:
            current += c
    return found + ([current] if current else [])


def folded(text: str | None) -> str:
    return (text or "").translate({c: c + 32 for c in range(65, 91)})
