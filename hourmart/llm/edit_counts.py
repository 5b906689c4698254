"""Token counts that follow edits: a tree of pre-token sums per document.

A document's pre-tokens lie in leaves of LEAF; the tree above them holds the sums of characters and
tokens. An edit finds its leaf by characters, cuts the text again from the last pre-token that cannot
have seen the edit, stops at the first old boundary behind the edit that is a boundary again, encodes
those pre-tokens alone and updates the sums above.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmart.llm.span_cache import LIMIT
from hourmart.llm.staging import session_of

LEAF = 32              # pre-tokens of a leaf when the tree is built
SIGHT = 2              # characters beyond its end that the cut of a pre-token may depend on
AHEAD = 256            # characters of text that are cut at once behind an edit

Edit = tuple[int, int, str]           # characters start to stop of the text as it is then, and what comes there


class Counter:
    """Tokens of pre-tokens under one vocabulary of ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > LIMIT:
            known.clear()
        found = list(map(known.get, pieces))
        if None in found:
            for p in dict.fromkeys(p for p, n in zip(pieces, found) if n is None):
                known[p] = len(self.encoding.encode_ordinary(p))
            found = [known[p] for p in pieces]
        return found


class CountTree:
    """Pre-tokens of a text in leaves, with sums of characters and tokens above them."""

    def __init__(self, text: str, counter: Counter):
        self.counter, self.encoded = counter, 0
        pieces = counter.pattern.findall(text)
        counts = counter.counts(pieces)
        self.leaves = [list(zip(pieces[i:i + LEAF], counts[i:i + LEAF])) for i in range(0, len(pieces), LEAF)] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens, self.pieces = ([0] * (2 * self.size) for _ in range(3))
        for i in range(len(self.leaves)):
            self._sum_leaf(i)
        for node in range(self.size - 1, 0, -1):
            self._sum_node(node)

    def _sum_leaf(self, i: int) -> None:
        leaf = self.leaves[i]
        self.chars[self.size + i] = sum(len(p) for p, _ in leaf)
        self.tokens[self.size + i] = sum(n for _, n in leaf)
        self.pieces[self.size + i] = len(leaf)

    def _sum_node(self, node: int) -> None:
        for sums in (self.chars, self.tokens, self.pieces):
            sums[node] = sums[2 * node] + sums[2 * node + 1]

    def _refresh(self, leaves: range) -> None:
        nodes = set()
        for i in leaves:
            self._sum_leaf(i)
            nodes.add((self.size + i) >> 1)
        while nodes and 0 not in nodes:
            for node in nodes:
                self._sum_node(node)
            nodes = {node >> 1 for node in nodes}

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that has character `at` (the last one with text if it lies behind), and the characters before it."""
        node, before = 1, 0
        at = max(min(at, self.chars[1] - 1), 0)
        while node < self.size:
            node *= 2
            if at - before >= self.chars[node]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces characters start to stop, clipped to the text."""
        length = self.chars[1]
        start = max(min(start, length), 0)
        stop = max(min(stop, length), start)
        first, at = self.find(start - SIGHT)
        kept = 0
        for piece, _ in self.leaves[first]:
            if at + len(piece) + SIGHT > start:
                break
            at += len(piece)
            kept += 1
        # old pre-tokens from `at` on, taken leaf by leaf as far as they are needed
        leaf, old, old_end, ends = first, list(self.leaves[first][kept:]), at, {}
        for i, (piece, _) in enumerate(old):
            old_end += len(piece)
            ends[old_end] = i + 1

        def more() -> bool:
            nonlocal leaf, old_end
            if leaf + 1 >= len(self.leaves):
                return False
            leaf += 1
            for entry in self.leaves[leaf]:
                old.append(entry)
                old_end += len(entry[0])
                ends[old_end] = len(old)
            return True

        while old_end < stop and more():
            pass
        shift = len(new) - (stop - start)
        made: list[str] = []
        place, taken = at, None               # place: in the edited text
        while taken is None:
            text = "".join(p for p, _ in old)
            edited = text[:start - at] + new + text[stop - at:]
            made, place, whole = [], at, leaf + 1 >= len(self.leaves)
            for match in self.counter.pattern.finditer(edited):
                # near the end of what was read, a cut may depend on what follows
                if not whole and match.end() + SIGHT > len(edited):
                    break
                made.append(match.group())
                place = at + match.end()
                if place - shift >= stop and place - shift in ends and place >= start + len(new):
                    taken = ends[place - shift]
                    break
            if taken is None:
                if whole:
                    taken = len(old)
                else:
                    while more() and old_end < at + len(edited) + AHEAD:
                        pass
        self.encoded += len(made)
        rest = old[taken:]
        # what was read and not taken goes back to where it came from
        self.leaves[first] = self.leaves[first][:kept] + list(zip(made, self.counter.counts(made)))
        last = leaf
        while last > first and len(rest) >= len(self.leaves[last]):
            rest = rest[:len(rest) - len(self.leaves[last])]
            last -= 1
        for i in range(first + 1, last + 1):
            self.leaves[i] = []
        if rest:
            if last == first:
                self.leaves[first] += rest
            else:
                self.leaves[last] = rest
        self._refresh(range(first, last + 1))

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p, _ in leaf)


# Personal data and secrets that are masked: addresses with @, long runs of digits, long hexadecimal keys.
MASKED = regex.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+|\d{13,19}|\b[0-9a-f]{32,64}\b")


def masking_edits(text: str) -> list[Edit]:
    """Edits, last one first, that mask what MASKED finds."""
    return [(m.start(), m.end(), "<masked>") for m in MASKED.finditer(text)][::-1]


@lru_cache(maxsize=2)
def _counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def _count(path: str, pattern: str, script: Callable[[str], list[Edit]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, pattern)
        for batch in batches:
            columns: list[list[int]] = [[] for _ in range(5)]
            for text in batch.column("text"):
                text = text.as_py() or ""
                edits = script(text)
                if edits:
                    tree = CountTree(text, counter)
                    before = tree.pieces[1], tree.tokens[1]
                    for edit in edits:
                        tree.edit(*edit)
                    row = *before, len(edits), tree.encoded, tree.tokens[1]
                else:
                    pieces = counter.pattern.findall(text)
                    n = sum(counter.counts(pieces))
                    row = len(pieces), n, 0, 0, n
                for column, value in zip(columns, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]],
                ["doc_id", "n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_tokens_after"])
    return run


def edited_counts(docs: DataFrame, path: str, pattern: str, script: Callable[[str], list[Edit]] = masking_edits) -> DataFrame:
    """Per document: doc_id, n_pretokens, n_tokens, n_edits, n_reencoded (pre-tokens cut and encoded anew), n_tokens_after.

    `path` is a rank file, `pattern` its pre-token pattern, `script` gives a text's edits in the order
    they are made. A null text counts as empty. Edits beyond the text are clipped to it. Repeated rows
    and null doc_ids give a row each; other columns are ignored.
    """
    session_of(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_count(path, pattern, script),
                            "doc_id long, n_pretokens long, n_tokens long, n_edits long, n_reencoded long, n_tokens_after long")
