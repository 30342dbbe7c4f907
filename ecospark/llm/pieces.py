"""SentencePiece vocabularies as finite-state tables: normaliser, pieces, byte fallback, merge consistency.

The library's BPE joins adjacent symbols, best score first (leftmost on ties), as long as the joined string is a
piece. Its result has two properties that let a dynamic programme find it without running the merges over a text:

* any run of neighbouring tokens of an encoding is the encoding of the string it spells, and
* a token sequence is an encoding if and only if every pair of neighbours is (merges never cross a boundary
  between tokens, so the first merge that crossed one would also happen in that pair alone).

``consistent(a, b)`` decides a pair by interleaving the merges of the two pieces and is remembered, so a text costs
table look-ups. ``chunks`` cuts a normalised text where no piece can span the cut; chunks are encoded independently
and repeated chunks (words) are answered from a bounded cache.
"""

from __future__ import annotations

import re
from functools import lru_cache

SPACE = "▁"  # the library's visible space
NEVER = float("-inf")
NORMAL, BYTE = 1, 6  # piece types of the model format
BPE, UNIGRAM = 2, 1


class Vocabulary:
    """Pieces, scores and tables of one model file (or of an in-memory list of ``(piece, score)``)."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int = BPE, prefix: bool = True) -> None:
        self.kind, self.prefix = kind, prefix
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.text = [p for p, _, _ in pieces]
        self.score = {p: s for p, s, t in pieces if t == NORMAL}
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == 2), 0)
        long = [p for p in self.ids if len(p) > 1]
        self.longest = max(map(len, long), default=1)
        if any(SPACE in p[1:] and p.strip(SPACE) for p in long):
            raise ValueError("a piece spans a space: texts can't be cut before spaces")
        #: a run of spaces with letters that can share a piece after it, or one letter that is never in a longer piece
        runs = [f"[{re.escape(''.join(g))}]+" for g in self._alphabets(long)]
        inner = re.escape("".join({x for p in long for x in p} - {SPACE})) + SPACE
        self.cut = re.compile(f"{SPACE}*(?:{'|'.join(runs) or '(?!)'})|{SPACE}+|[^{inner}]", re.S)
        self._pairs: dict[str, dict[str, bool]] = {}
        self._n_pairs = 0
        self._traces: dict[str, tuple[list[str], list[tuple[float, str, str]]]] = {}
        #: every prefix of a piece; true where the prefix itself is a piece that the merges can build
        self.heads = {p[:n]: False for p in self.ids for n in range(1, len(p))}
        self.heads |= {p: kind != BPE or self.trace(p)[0] == [p] for p in self.ids}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only the identity normaliser with escaped spaces is compiled")
        return cls([(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type, spec.add_dummy_prefix)

    @staticmethod
    def _alphabets(pieces: list[str]) -> list[list[str]]:
        """The letters of longer pieces in groups: letters that are neighbours in a piece are in one group, so no
        piece spans two groups (spaces apart)."""
        group: dict[str, set[str]] = {}
        for p in pieces:
            letters = set(p) - {SPACE}
            joined = letters.union(*(group[x] for x in letters if x in group))
            group |= dict.fromkeys(joined, joined)
        return sorted({id(g): sorted(g) for g in group.values()}.values(), key=len, reverse=True)

    def normal(self, text: str) -> str:
        """The normaliser: a space in front of a text that isn't empty, visible spaces."""
        return ((SPACE if self.prefix else "") + text.replace(" ", SPACE)) if text else ""

    def chunks(self, text: str) -> list[str]:
        return self.cut.findall(self.normal(text))

    def trace(self, piece: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """The merges over one short string: what they leave, and for each step its score and the string's leftmost
        and rightmost symbol after it."""
        got = self._traces.get(piece)
        if got is not None:
            return got
        parts, score, steps = list(piece), self.score, []
        while True:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1], NEVER)
                if s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[0], parts[-1]))
        if piece in self.ids:
            self._traces[piece] = parts, steps
        return parts, steps

    def consistent(self, a: str, b: str) -> bool:
        """Whether ``a`` followed by ``b`` is how the merges leave their joined string."""
        after = self.followers(a)
        got = after.get(b)
        if got is None:
            got = after[b] = self._side_by_side(a, b)
            self._n_pairs += 1
        return got

    def _side_by_side(self, a: str, b: str) -> bool:
        """The merges of ``a`` and of ``b`` taken in their common order: whether none crosses the boundary."""
        left, right, i, j, x, y = self.trace(a)[1], self.trace(b)[1], 0, 0, a[-1], b[0]
        while True:
            cross = self.score.get(x + y, NEVER)
            p = left[i][0] if i < len(left) else NEVER
            q = right[j][0] if j < len(right) else NEVER
            if cross > p and cross >= q:  # on ties the leftmost goes first
                return cross == NEVER
            if p == q == NEVER:
                return True
            if p >= q:
                x, i = left[i][2], i + 1
            else:
                y, j = right[j][1], j + 1

    def followers(self, a: str) -> dict[str, bool]:
        """What is remembered of ``consistent(a, ...)``."""
        if self._n_pairs >= 1_000_000:  # bounded memory; entries are only remembered, never needed
            self._pairs.clear()
            self._n_pairs = 0
        return self._pairs.setdefault(a, {})

    def relax(self, s: str) -> tuple[list[str], list[int]]:
        """For every prefix ``s[:i]`` its last token and its token count, ``i`` = 0..len(s). Exactly one piece that
        ends at ``i`` is consistent with the last token before it, so positions already filled are passed over."""
        n, heads, pairs, side = len(s), self.heads, self._pairs, self._side_by_side
        last, count = [""] * (n + 1), [0] * (n + 1)
        for at in range(n):
            before, end = last[at], at + 1
            piece = s[at]
            whole = heads.get(piece)
            after = pairs.get(before)
            if after is None:
                after = self.followers(before)
            if not whole:  # not a piece by itself: it stands as its bytes
                if not last[end] and (not at or self.consistent(before, piece)):
                    last[end], count[end] = piece, count[at] + self.cost(piece)
            while whole is not None:
                if whole and not last[end]:
                    fits = after.get(piece)
                    if fits is None:
                        fits = after[piece] = not at or side(before, piece)
                        self._n_pairs += 1
                    if fits:
                        last[end], count[end] = piece, count[at] + 1
                end += 1
                if end > n:
                    break
                piece = s[at:end]
                whole = heads.get(piece)
        return last, count

    def cost(self, piece: str) -> int:
        """Ids that a piece becomes: one, or one for each UTF-8 byte if it isn't in the vocabulary."""
        return 1 if piece in self.ids or not self.bytes else len(piece.encode("utf-8", "surrogatepass"))

    def piece_ids(self, piece: str) -> list[int]:
        if (i := self.ids.get(piece)) is not None:
            return [i]
        return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]


def normal_pieces(path: str) -> list[str]:
    """The ordinary pieces of a model file, sorted, without the tables."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return sorted({p.piece for p in model.pieces if p.type == NORMAL})


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per Python worker and file."""
    return Vocabulary.read(path)
