"""Token counts by a linear longest-match automaton.

Greedy word pieces take the longest vocabulary entry again and again. The
automaton is the trie of the vocabulary with, for each node, a failure link and
the number of pieces that are popped when the match can't go on there: the
node's string begins with that many longest matches, and the link leads to the
node of what is left. Lengths in pieces come from one pass over each word, no
piece is built. Words of a slice are read in step: one numpy round per byte
position, transitions found by binary search over sorted (node, byte) keys.
Words of more than ``LONG_WORD`` bytes leave the round and run through the same
automaton alone, a lookup per byte, so a long word does not cost a round per byte.

Words are runs of bytes other than space and tab to carriage return; each is
read with a word-begin byte (a space) before it, as byte-level vocabularies
have it. A word that can't be cut into pieces is one unknown piece.

Defined cases: null and empty texts have no words and no tokens; repeated rows
get equal counts; extra columns are dropped before the work.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import byte_letters
from .flat import flat_bytes, in_arrow, keyed, prefix_hash, span_hash, text_slices, word_spans

NO_NODE = -1
#: Words of more bytes are read one after the other, not in lockstep with the rest.
LONG_WORD = 256


class Automaton:
    """Trie with failure links and popped-piece counts over byte strings."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    final.append(False)
                node = children[node][b]
            final[node] = True
        final[0] = False
        fail, pops = [NO_NODE] * len(children), [0] * len(children)
        queue = [0]
        for node in queue:  # breadth first: links lead to shallower nodes, which are done
            for b, child in children[node].items():
                queue.append(child)
                if final[child]:
                    fail[child], pops[child] = 0, 1
                    continue
                popped, at = pops[node], fail[node]
                while at != NO_NODE and b not in children[at]:
                    popped, at = popped + pops[at], fail[at]
                if at != NO_NODE:
                    fail[child], pops[child] = children[at][b], popped
        edges = [(node << 8 | b, child) for node, own in enumerate(children) for b, child in own.items()]
        edges.sort()
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.targets = np.array([t for _, t in edges], np.int64)
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)
        # a byte from the root, found without a search; the same edges for words read alone
        self.root = np.full(256, NO_NODE, np.int64)
        for b, child in children[0].items():
            self.root[b] = child
        self.children, self.links, self.popped = children, fail, pops

    def _alone(self, word: bytes, node: int) -> int:
        """Pieces of one word, byte by byte: a byte costs a lookup, however long the word is; 0 if it can't be cut."""
        children, links, popped, total = self.children, self.links, self.popped, 0
        for b in word:
            while node != NO_NODE and b not in children[node]:
                total += popped[node]
                node = links[node]
            if node == NO_NODE:
                return 0
            node = children[node][b]
        while node > 0:
            total += popped[node]
            node = links[node]
        return 0 if node == NO_NODE else total

    def _step(self, nodes: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next node of each (no node: the word can't be cut) and the pieces popped on the way."""
        popped = np.zeros(len(nodes), np.int64)
        out = np.full(len(nodes), NO_NODE, np.int64)
        todo = np.arange(len(nodes))
        at = nodes.copy()
        while len(todo):
            key = at << 8 | letters[todo]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            out[todo[hit]] = self.targets[found[hit]]
            todo, at = todo[~hit], at[~hit]
            popped[todo] += self.pops[at]
            at = self.fail[at]
            alive = at != NO_NODE
            todo, at = todo[alive], at[alive]
        return out, popped

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: int | None) -> np.ndarray:
        """Pieces of each word; 0 for a word that can't be cut. ``begin`` is read before each word."""
        long = ends - starts > LONG_WORD
        if long.any():
            out = np.zeros(len(starts), np.int64)
            out[~long] = self.counts(data, starts[~long], ends[~long], begin)
            first = 0 if begin is None else int(self.root[begin])
            out[long] = [self._alone(data[a:b].tobytes(), first) for a, b in zip(starts[long], ends[long])]
            return out
        n = len(starts)
        total = np.zeros(n, np.int64)
        nodes = np.zeros(n, np.int64)
        if begin is not None:
            nodes[:] = self.root[begin]
        order = np.argsort(starts - ends, kind="stable")  # longest first: words still read stand in front
        lengths = (ends - starts)[order]
        nodes = nodes[order]
        position, active = 0, n
        while active:
            active = int(np.searchsorted(-lengths, -position, "left"))
            live = np.flatnonzero(nodes[:active] != NO_NODE)
            if not len(live):
                break
            step, popped = self._step(nodes[live], data[starts[order[live]] + position].astype(np.int64))
            nodes[live] = step
            total[live] += popped
            position += 1
        # what is left in the automaton is popped until nothing is
        at = nodes.copy()
        while True:
            left = np.flatnonzero(at > 0)
            if not len(left):
                break
            total[left] += self.pops[at[left]]
            at[left] = self.fail[at[left]]
        out = np.zeros(n, np.int64)
        out[order] = np.where(at == NO_NODE, 0, total)
        return out


def vocabulary_pieces(path: str) -> list[bytes]:
    """Byte strings of a byte-level vocabulary file, without special tokens."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_letters()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return [bytes(letters[c] for c in word) for word in spec["model"]["vocab"] if word not in special]


@lru_cache(2)
def automaton(path: str) -> Automaton:
    """One automaton per worker process."""
    return Automaton(vocabulary_pieces(path))


def count_texts(texts: pa.Array, machine: Automaton, begin: int | None = 0x20) -> dict[str, np.ndarray]:
    """Words, pieces and unknown words of each text; equal words of the slice are read once."""
    data, offsets = flat_bytes(texts)
    starts, ends, first = word_spans(data, offsets)
    _, where, back = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
    pieces = machine.counts(data, starts[where], ends[where], begin)[back] if len(starts) else np.zeros(0, np.int64)
    unknown = np.concatenate([[0], np.cumsum(pieces == 0)])[first]
    total = np.concatenate([[0], np.cumsum(np.maximum(1, pieces))])[first]
    return {"n_words": np.diff(first), "n_tokens": np.diff(total), "n_unknown": np.diff(unknown)}


def token_counts(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_tokens (an unknown word is one), n_unknown."""
    names = ["n_words", "n_tokens", "n_unknown"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = count_texts(part.column("text"), machine)
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(found[c]) for c in names)], ["id", *names])

    rows = keyed(df, id_column, text_column)
    kind = rows.schema["id"].dataType.simpleString()
    return in_arrow(rows, run, f"id {kind}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_column)
