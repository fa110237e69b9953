"""Byte-level BPE by a tokenization automaton: merges are compiled gadget by gadget into a table of transitions, which texts follow."""

from __future__ import annotations

import hashlib
import json
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-split of byte-level BPE files whose pre_tokenizer is ByteLevel with use_regex.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker keeps with their ids; the cache starts anew when it is full.
CACHE_WORDS = 1_500_000


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in vocabulary files of byte-level BPE."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """A deterministic automaton whose arcs are tokens and whose paths are exactly the tokenizations that the merges give.

    It begins as one state with an arc for each byte. Merge number m, of u and v into c, adds a gadget: wherever an arc u
    leads to a state with an arc v, the u arc is redirected to a copy of that state without its v arc, and a new arc c
    goes to where v led. So a state is told by the arc that entered it, and the gadgets in order amount to this on the
    table of states by arcs: the state of c begins as that of v, then the state of u loses the arc v, then c has an arc
    wherever u has one.

    Compiled, a state is the list of arcs that it lacks. By the first rule it takes over what the state of v had lost
    until then, and so on down the right halves. By the third, the loss of an arc v at gadget m is also that of all arcs
    made from v on the left later on. Arcs are numbered so that these are one run: depth first along the left halves,
    the later made the earlier. `cuts` holds the ends of the runs that each state lacks, merged and sorted, from
    first[state] on: an arc is in a run, and so missing, if an odd number of ends is at most its number.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        as_bytes = {token: bytes(chars[c] for c in token) for token in model["vocab"] if all(c in chars for c in token)}
        ids = {as_bytes[t]: i for t, i in model["vocab"].items() if t in as_bytes}
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.label = [b""] * size
        for token, i in ids.items():
            self.label[i] = token
        for token, i in self.special.items():
            self.label[i] = token.encode()
        merges = np.zeros((len(model["merges"]), 3), np.int64)
        for number, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges[number] = ids[as_bytes[a]], ids[as_bytes[b]], ids[as_bytes[a] + as_bytes[b]]
        if len(np.unique(merges[:, 2])) < len(merges):
            raise ValueError("two merges give one token")
        #: What the start state has: each byte, and all that gadgets made of them.
        made = [i for t, i in ids.items() if len(t) == 1] + self._made(size, merges)
        self.arc = {self.label[i]: i for i in made}
        #: Each end of a token's bytes: the token if it is whole, else -1.
        self.tails = {t[k:]: -1 for t in self.arc for k in range(1, len(t))} | self.arc
        self._compile(size, merges)

    def _made(self, size: int, merges: np.ndarray) -> list[int]:
        """The tokens whose gadgets find their two arcs in sequence. (A gadget that doesn't adds nothing, and what it would take away is gone.)"""
        gadget, born, halves, dead = {}, [-1] * size, [(-1, -1)] * size, set()
        for number, (u, v, c) in enumerate(merges.tolist()):
            x, y, until_x, until_y = u, v, number, number
            there = u not in dead and v not in dead
            while there:
                rank = gadget.get((x, y))
                # taken before the state of u, or the arc v, was made from that of x or y; a gadget of one token with itself makes its state before, and its arc after
                if rank is not None and rank < until_x and (rank < until_y or rank == until_y < number):
                    there = False
                elif born[x] < 0 and born[y] < 0:
                    break
                elif born[x] > born[y]:
                    until_x, x = born[x], halves[x][1]
                else:
                    until_y, y = born[y], halves[y][0]
            if not there:
                dead.add(c)
            gadget[u, v], born[c], halves[c] = number, number, (u, v)
        return [c for c in merges[:, 2].tolist() if c not in dead]

    def _compile(self, size: int, merges: np.ndarray) -> None:
        n = len(merges)
        born, left, right = (np.full(size, -1, np.int64) for _ in range(3))
        u, v, c = merges.T
        born[c], left[c], right[c] = np.arange(n), u, v
        # number the arcs: below each token the ones it is the left half of, the later made first
        below = np.ones(size, np.int64)
        for token in c[::-1].tolist():
            below[left[token]] += below[token]
        self.number, last = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = 0
        for token in np.flatnonzero(left < 0).tolist():
            self.number[token] = at
            last[token] = at + below[token]
            at = last[token]
        for token in c.tolist():
            # places are taken from the back: what was made earlier lies behind
            last_of = last[left[token]]
            self.number[token] = last_of - below[token]
            last[left[token]] = self.number[token]
            last[token] = last_of
        # gadgets by their left token, in order
        order = np.argsort(u, kind="stable")
        begins = np.searchsorted(u[order], np.arange(size + 1))
        keyed = u[order] * n + order
        states, lost, when_lost = [], [], []
        owner = np.flatnonzero(born >= -1)
        spine, until = owner.copy(), np.full(size, n, np.int64)
        while len(owner):
            # what the state of `spine` lost from its own gadget on, until its copy was taken
            a = np.searchsorted(keyed, spine * n + born[spine] + 1)
            b = np.searchsorted(keyed, spine * n + until)
            many = np.maximum(b - a, 0)
            ends = np.cumsum(many)
            m = order[np.repeat(a - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)]
            states.append(np.repeat(owner, many))
            lost.append(v[m])
            when_lost.append(m)
            until = born[spine]
            owner, spine, until = owner[until >= 0], right[spine][until >= 0], until[until >= 0]
        states, arcs, when = (np.concatenate(x) for x in (states, lost, when_lost))
        # the arc itself and all that was made from it on the left after that gadget: a run that begins with the arc's own number
        # (a gadget of a token with itself makes its new arc after the loss, so that arc counts as later)
        later = np.searchsorted(keyed, arcs * n + when)
        some = later < begins[arcs + 1]
        end = self.number[arcs] + 1
        nearest = c[order[np.minimum(later, n - 1)]] if n else arcs
        end[some] = (self.number[nearest] + below[nearest])[some]
        start = self.number[arcs]
        by = np.lexsort((start, states))
        states, start, end = states[by], start[by], end[by]
        # merge runs that touch: a new one begins where no earlier end of its state reaches
        reach = np.maximum.accumulate(states * (size + 1) + end)
        fresh = np.append(True, (states[1:] != states[:-1]) | (start[1:] > reach[:-1] - states[1:] * (size + 1))) if len(states) else np.zeros(0, bool)
        heads = np.flatnonzero(fresh)
        tails = np.append(heads[1:], len(states)) - 1
        cuts = np.stack([start[heads], reach[tails] - states[tails] * (size + 1)], axis=1)
        self.cuts = array("i", cuts.astype(np.int32).tobytes())
        self.first = (2 * np.searchsorted(states[heads], np.arange(size + 1))).tolist()
        self.number = self.number.tolist()

    def step(self, state: int, token: int) -> bool:
        """Whether the state entered by one token has an arc for another."""
        first = self.first
        return not (bisect_right(self.cuts, self.number[token], first[state], first[state + 1]) - first[state]) & 1

    def encode(self, word: bytes) -> list[int]:
        """The one path of the automaton that spells the word.

        After each byte there is one state at most: paths of a text's beginning are tokenizations of it, so only one
        ends there. A state follows from the earlier one where its own arc begins.
        """
        n, tails, cuts, first, number = len(word), self.tails.get, self.cuts, self.first, self.number
        state = [-1] * (n + 1)
        for end in range(1, n + 1):
            begin = end
            while begin:
                begin -= 1
                token = tails(word[begin:end])
                if token is None:
                    break
                if token >= 0:
                    before = state[begin]
                    # the test of step(), written out
                    if not begin or before >= 0 and not (bisect_right(cuts, number[token], first[before], first[before + 1]) - first[before]) & 1:
                        state[end] = token
                        break
        if n and state[n] < 0:
            raise ValueError(f"no path spells {word!r}")
        path, at = [], n
        while at:
            path.append(state[at])
            at -= len(self.label[state[at]])
        return path[::-1]


class Codec:
    """Whole texts to ids and back, with a bounded cache of words."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.split = regex.compile(SPLIT).findall
        special = sorted(self.automaton.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.span = np.zeros((1 << 14, 2), np.int64)

    def _add(self, word: str) -> int:
        path = self.automaton.encode(word.encode("utf-8"))
        k, n = len(self.known), len(path)
        while self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        if k >= len(self.span):
            self.span = np.concatenate([self.span, np.zeros_like(self.span)])
        self.ids[self.used : self.used + n] = path
        self.span[k] = self.used, n
        self.used += n
        self.known[word] = k
        return k

    def _plain(self, text: str) -> np.ndarray:
        words = self.split(text)
        if len(self.known) + 65_536 > CACHE_WORDS:
            self._clear()
        get = self.known.get
        at = [get(w) for w in words]
        for i, k in enumerate(at):
            if k is None:
                k = get(words[i])
                at[i] = self._add(words[i]) if k is None else k
        first, count = self.span[np.array(at, np.int64)].T if at else (np.zeros(0, np.int64),) * 2
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(first - (ends - count), count) + np.arange(total)]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; strings of special tokens in it get their ids, as the library does."""
        if self.marks is None or not any(s in text for s in self.automaton.special):
            return self._plain(text)
        special = self.automaton.special
        parts = [np.array([special[p]], np.uint32) if p in special else self._plain(p) for p in self.marks.split(text) if p]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the arcs, one after the other; bytes that are no UTF-8 become U+FFFD."""
        label = self.automaton.label
        return b"".join([label[i] for i in ids.tolist()]).decode("utf-8", "replace")


#: One codec for each vocabulary and worker process: later tasks of the process find their words known.
_CODECS: dict[str, Codec] = {}


def _codec(batches: Iterator[pa.RecordBatch], path: str, automaton: Broadcast) -> Iterator[pa.RecordBatch]:
    if path not in _CODECS:
        _CODECS[path] = Codec(automaton.value)
    codec = _CODECS[path]
    for batch in batches:
        for first in range(0, len(batch), 256):
            part = batch.slice(first, 256)
            n_tokens, ids_sha, text_sha = [], [], []
            for text in part.column(1).to_pylist():
                ids = codec.encode(text or "")
                n_tokens.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text, decode its ids, and return key, n_tokens, ids_sha256 (ids as little-endian 32-bit) and decoded_sha256.

    One row out for each row in, whatever the key (null and repeated keys too); a null text counts as empty and has no
    ids; other columns don't matter; an empty table gives no rows. `path`: a vocabulary file on the driver. The
    automaton is compiled there once and broadcast: its size follows the vocabulary, not the corpus.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(path))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(lambda it: _codec(it, path, automaton), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("doc_id", key)
