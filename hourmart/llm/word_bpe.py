"""BPE encoding and decoding by speculation: greedy longest match, pair checks, exact merging of what fails.

A sequence of tokens is what merging by rank gives exactly if every token is what merging gives for
its own string and every two neighbours stay two tokens when merged alone. So a greedy longest match
proposes tokens, all adjacent pairs are tested together by arrays, and only words with a pair that
fails are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmart.llm import batches as B
from hourmart.llm.span_cache import LIMIT, SpanCache, ranges
from hourmart.llm.staging import session_of

# Fixed values of the vocabulary's format: end of a word, the pattern of words.
WORD_END = "</w>"
SHORT = 40            # symbols of a word up to which a plain scan for the lowest rank is quicker
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next letter from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class WordBpe:
    """Encoder of one vocabulary file of byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.strings = {i: s for s, i in {**self.vocab, **special}.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.letters = byte_letters()
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            self.merge.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.no_merge = (len(merges), -1)
        self._prepare_pairs()
        # tokens that merging gives for their own string, by length
        self.proposals = {s: i for s, i in self.vocab.items() if self.merged(self.symbols(s)) == [i]}
        self.beginnings = {s[:i] for s in self.proposals for i in range(1, len(s.removesuffix(WORD_END)) + 1)}
        self.words: dict[str, list[int]] = {}
        self.exact_words = 0

    def symbols(self, token: str) -> list[int]:
        """First symbols of a token's string, the last one with the word end if the token has it."""
        body, ended = token.removesuffix(WORD_END), token.endswith(WORD_END) and token != WORD_END
        if not ended:
            return [self.vocab[c] for c in token]
        return [self.vocab[c] for c in body[:-1]] + [self.vocab[body[-1] + WORD_END]]

    def merged(self, symbols: list[int]) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equals."""
        if len(symbols) > SHORT:
            return self._merged_long(symbols)
        ids, merge, none = list(symbols), self.merge, self.no_merge
        pairs = [merge.get(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            i = pairs.index(best)
            ids[i:i + 2] = [best[1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = merge.get((ids[i], ids[i + 1]), none)
            if i:
                pairs[i - 1] = merge.get((ids[i - 1], ids[i]), none)
        return ids

    def _merged_long(self, symbols: list[int]) -> list[int]:
        """The same for long words, with a heap of pairs and linked symbols."""
        n = len(symbols)
        ids, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
        merge = self.merge
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merge.get((made, ids[k])):
                    heapq.heappush(heap, (m[0], i, made, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merge.get((ids[h], made))):
                heapq.heappush(heap, (m[0], h, ids[h], made, m[1]))
        return [i for i in ids if i >= 0]

    def _prepare_pairs(self) -> None:
        """Arrays for the pair check: each token's rank and parts, and all merges as sorted keys."""
        size = max(self.strings) + 1
        self.size = size
        keys = np.array([a * size + b for a, b in self.merge], np.int64)
        ranks = np.array([m[0] for m in self.merge.values()], np.int64)
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[order], ranks[order]
        self.rank = np.full(size, -1, np.int64)
        self.left = np.arange(size)
        self.right = np.arange(size)
        for (a, b), (rank, made) in self.merge.items():
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, a, b

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a[i] and b[i] stay two tokens when their joined string is merged.

        Both tokens are taken apart from the boundary outwards, the later merge first. They join if
        two parts at the boundary have a merge that comes before the merge that hides one of them.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        hidden_a = np.full(len(a), np.iinfo(np.int64).max)     # rank of the merge that hides this part of a
        hidden_b = hidden_a.copy()
        while len(live):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            rank = np.where(self.merge_keys[at] == key, self.merge_ranks[at], np.iinfo(np.int64).max)
            # a part of a is merged away at hidden_a; of two equal ranks the left one comes first
            joins = (rank < hidden_a) & (rank <= hidden_b) & (rank < np.iinfo(np.int64).max)
            joins &= ~((rank == hidden_b) & (rank == hidden_a))
            ok[live[joins]] = False
            open_a, open_b = self.rank[a], self.rank[b]
            go = ~joins & ((open_a >= 0) | (open_b >= 0))
            live, a, b, hidden_a, hidden_b, open_a, open_b = (x[go] for x in (live, a, b, hidden_a, hidden_b, open_a, open_b))
            first = open_a > open_b
            hidden_a = np.where(first, open_a, hidden_a)
            hidden_b = np.where(first, hidden_b, open_b)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def propose(self, word: str) -> list[int]:
        """Greedy longest match of a word's letters."""
        found, i, n, known, beginnings = [], 0, len(word), self.proposals, self.beginnings
        while i < n:
            token = known.get(word[i:] + WORD_END)
            end = n
            if token is None:
                j = i + 1
                while j < n and (part := word[i:j]) in beginnings:
                    if part in known:
                        token, end = known[part], j
                    j += 1
            found.append(token)
            i = end
        return found

    def encode_words(self, words: list[str]) -> None:
        """Adds the tokens of new words (as letters of bytes) to self.words."""
        proposed = [self.propose(w) for w in words]
        sizes = np.array([len(p) for p in proposed], np.int64)
        ids = np.fromiter((i for p in proposed for i in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        pair = np.flatnonzero(owner[:-1] == owner[1:])
        keys, place = np.unique(ids[pair] * self.size + ids[pair + 1], return_inverse=True)
        ok = self.compatible(keys // self.size, keys % self.size)
        failing = np.unique(owner[pair[~ok[place]]]) if len(pair) else []
        for i in failing:
            proposed[i] = self.merged([self.vocab[c] for c in words[i][:-1]] + [self.vocab[words[i][-1] + WORD_END]])
        self.exact_words += len(failing)
        self.words.update(zip(words, proposed))

    def pieces(self, text: str) -> list[str | int]:
        """Words of a text as letters of bytes, in order; special tokens as ids."""
        found: list[str | int] = []
        for part in self.split_special.split(text) if self.split_special and "<|" in text else (text,):
            if part in self.special:
                found.append(self.special[part])
                continue
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            letters = self.letters
            found += [w if w.isascii() and w.isprintable() else "".join([letters[x] for x in w.encode()])
                      for w in WORDS.findall(part)]
        return found

    def encode(self, strings: list[str]) -> list[list[int]]:
        if len(self.words) > LIMIT:
            self.words.clear()
        pieces = [(s.lower(),) if s.isascii() and s.isalpha() else self.pieces(s) for s in strings]
        new = list(dict.fromkeys(w for p in pieces for w in p if isinstance(w, str) and w not in self.words))
        if new:
            self.encode_words(new)
        known = self.words
        return [[i for w in p for i in (known[w] if isinstance(w, str) else (w,))] for p in pieces]

    def token_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The decoded bytes of each id followed by a space, one after the other, and their bounds."""
        shown = [(self.strings.get(i, "") + " ").encode() for i in range(self.size)]
        return np.frombuffer(b"".join(shown), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in shown])])


@lru_cache(maxsize=2)
def _tools(path: str) -> tuple[SpanCache, np.ndarray, np.ndarray]:
    bpe = WordBpe(path)
    return SpanCache(bpe.encode), *bpe.token_bytes()


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, token_letters, token_bounds = _tools(path)
        for rows, texts in B.text_slices(batches):
            words = B.words_of(texts)
            ids, id_bounds = cache.encode(texts, words.starts, words.ends)
            id_bounds = id_bounds[words.bounds]
            sizes = token_bounds[ids + 1] - token_bounds[ids]
            letters = token_letters[ranges(token_bounds[ids], sizes)].tobytes()
            b = np.concatenate([[0], np.cumsum(sizes)])[id_bounds].tolist()
            a, counts, ids = id_bounds.tolist(), np.diff(id_bounds), ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(counts),
                 pa.array([hashlib.sha256(ids[4 * i:4 * j]).hexdigest() for i, j in zip(a, a[1:])], pa.string()),
                 pa.array([hashlib.sha256(letters[i:max(i, j - 1)]).hexdigest() for i, j in zip(b, b[1:])], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, for the vocabulary file at `path`.

    `path` is read by every worker. White space parts words for certain, so words between blanks are
    encoded once per worker and texts are put together from them, whatever their length. A null text
    counts as empty (no tokens). Repeated rows and null doc_ids give a row each; other columns are ignored.
    """
    session_of(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(B.tidy(_round_trip(path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
