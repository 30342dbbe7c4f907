"""Statistics of whole texts (words, symbols, repeated lines and words), one pass in a task.

Definitions: words are runs of characters outside ``[\\x20\\x09-\\x0D]``; ``word_chars`` counts their code points;
``n_symbols`` the characters of ``[#*$%&|<>]``; ``n_dup_lines`` the ``\\n``-split lines that hold a word and equal an
earlier line; ``n_repeat_words`` the words that lie in a 3-word window found twice or more in the text, the first
finding included. A null text has none of anything.
"""

from __future__ import annotations

import re

import numpy as np

from ecospark.llm.words import chain, text_bytes, word_hashes

SYMBOLS = re.compile(rb"[#*$%&|<>]")
SPACES = b" \t\n\x0b\x0c\r"
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = word_hashes(text_bytes(text, lower=False))
    spaces = sum(raw.count(s) for s in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = len(SYMBOLS.findall(raw))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    repeat = 0
    windows = chain(words, 3)
    if len(windows) > 1:
        _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
        found = np.flatnonzero(count[inverse] > 1)
        if len(found):
            covered = np.zeros(len(words), dtype=bool)
            for k in range(3):
                covered[found + k] = True
            repeat = int(covered.sum())
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeat
