"""Token counts of byte-level BPE by rank-synchronous array merging.

A text is cut at the special strings (each is one token, as in the library's default) and
then into pre-tokens by the vocabulary's pattern.  Pre-tokens not met before are held, a
batch at a time, as one ragged numpy array of symbols; in each round every sequence merges
all places of its own lowest-rank pair at once, until no sequence has a pair with a rank.
The surviving symbols are the token count.  Counts of met pre-tokens are remembered up to
a bound.

Defined results: a null or empty text has no bytes and no tokens; rows are counted one by
one, so repeated rows and null ids need no rule; an empty table gives an empty table;
other columns pass through under their own names.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.common import per_text

#: Fixed value: the pre-token pattern of byte-level BPE (README of the vocabulary files).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1 << 40)
#: Texts of these characters only (ASCII without rare controls, Latin letters) are cut by the
#: standard library's faster engine: there PATTERN's classes are just these ranges.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = re.compile(rf"[\t-\r -~{LATIN}]*")
PLAIN_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s0-9{LATIN}]+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class Merger:
    """Merge ranks as sorted arrays, and counts of pre-tokens."""

    def __init__(self, path: str, remember: int = 400_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        to = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.to = keys[order], order.astype(np.int64), to[order]
        self.first = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.find_any = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}
        self.remember = remember

    def merge(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols that survive in each (non-empty) byte sequence."""
        size = np.fromiter(map(len, sequences), np.int64, len(sequences))
        count = size.copy()
        sym = self.first[np.frombuffer(b"".join(sequences), np.uint8)]
        which = np.arange(len(sequences))  # sequences still merging; size and sym are theirs
        while len(which):
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            last = np.zeros(len(sym), bool)
            last[start + size - 1] = True
            key = np.empty(len(sym), np.int64)
            key[:-1] = sym[:-1] << 32 | sym[1:]
            key[-1] = -1
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & ~last, self.rank[at], NONE)
            low = np.minimum.reduceat(rank, start)
            going = low < NONE
            hit = (rank == np.repeat(low, size)) & (rank < NONE)
            # In a run such as a a a the pairs overlap: take each second one from the left.
            touching = hit[1:] & hit[:-1]
            if touching.any():
                place = np.arange(len(hit))
                head = hit.copy()
                head[1:] &= ~touching
                run = np.maximum.accumulate(np.where(head, place, 0))
                hit &= (place - run) % 2 == 0
            sym[hit] = self.to[at[hit]]
            stay = np.ones(len(sym), bool)
            stay[1:] = ~hit[:-1]
            size = np.add.reduceat(stay.astype(np.int64), start)
            count[which] = size
            of = np.repeat(going, np.diff(np.append(start, len(sym))))
            sym = sym[stay & of]
            which, size = which[going], size[going]
        return count

    def find(self, text: str) -> list[str]:
        return PLAIN_PATTERN.findall(text) if PLAIN.fullmatch(text) else self.find_any(text)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if len(self.known) > self.remember:
            self.known.clear()
        sums, new = [], {}  # new: pre-tokens not met before, with the texts that hold them
        for i, text in enumerate(texts):
            if self.cut and any(s in text for s in self.special):
                parts = self.cut.split(text)
                n, pieces = len(parts) - 1, [p for part in parts for p in self.find(part)]
            else:
                n, pieces = 0, self.find(text)
            got = list(map(self.known.get, pieces))
            if None in got:
                for p, g in zip(pieces, got, strict=True):
                    if g is None:
                        new.setdefault(p, []).append(i)
                got = filter(None, got)
            sums.append(n + sum(got))
        words = list(new)
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            for p, n in zip(part, self.merge([p.encode() for p in part]).tolist(), strict=True):
                self.known[p] = n
                for i in new[p]:
                    sums[i] += n
        return sums


@functools.lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, text: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit")) -> DataFrame:
    """``docs`` (its ``keep`` columns) with the UTF-8 size, the token count and whether it exceeds ``limit``.

    ``vocabulary``: name of a JSON vocabulary of the installed public tokenizers, or a path
    that every executor can open.
    """

    def make():
        if "/" in vocabulary:
            path = vocabulary
        else:
            import public_tokenizers

            path = str(public_tokenizers.path(vocabulary))
        counter = merger(path)

        def work(texts: list[bytes]) -> list[list]:
            n = counter.counts([x.decode("utf-8", "replace") for x in texts])
            return [list(map(len, texts)), n, [x > limit for x in n]]

        return work

    return per_text(docs, text, f"`{names[0]}` long, `{names[1]}` long, `{names[2]}` boolean", make, keep)
