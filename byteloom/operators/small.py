"""Training of many small texts, each by itself: a text's words are bytes with a mark between, a merge is a replacement."""

from __future__ import annotations

import numpy as np

from byteloom import layout
from byteloom.config import TrainerConfig
from byteloom.functions.bytes import refused
from byteloom.operators import kernel

Merge = tuple[bytes, bytes, int, int]


class SmallTrainer:
    """Trains texts as kernel.train_words trains their words. Plateaus don't stop it.

    Codes of a text are those of its own bytes, in order, and of its merges. Texts whose codes don't fit into a byte are
    trained by the kernel.
    """

    def __init__(self, config: TrainerConfig):
        if config.plateau:
            raise ValueError("plateaus don't stop the training of small texts")
        self.config = config
        self.known = frozenset(layout.base_tokens(config.trailing))
        self.lengths = frozenset(config.allowed_lengths)
        budget = config.merge_budget
        self.most = budget if config.max_iterations is None else min(budget, config.max_iterations)
        self.full = kernel.TARGET if self.most == budget else kernel.ITERATIONS

    def train(self, data: np.ndarray, edges: np.ndarray) -> tuple[list[Merge], str]:
        """(left, right, count, places merged) by rank, and why the training ended. edges: where words begin, and the end."""
        present = np.flatnonzero(np.bincount(data, minlength=256))
        first = len(present) + 1
        if first + self.most > 256:
            return self._by_kernel(data, edges)
        code = np.zeros(256, np.uint8)
        code[present] = np.arange(1, first)
        inside = np.ones(len(data) + len(edges), bool)
        inside[edges + np.arange(len(edges))] = False
        t = np.zeros(len(inside), np.uint8)
        t[inside] = code[data]
        text = t.tobytes()
        size = first + self.most
        tokens = [b"", *(bytes([b]) for b in present.tolist())]
        known: set[bytes] = set()
        gone: list[int] = []
        out: list[Merge] = []
        while len(out) < self.most:
            t = np.frombuffer(text, np.uint8)
            key = t[:-1].astype(np.intp)
            key *= size
            key += t[1:]
            counts = np.bincount(key, minlength=size * size)
            counts[:size] = 0
            counts[::size] = 0
            if gone:
                counts[gone] = 0
            while True:
                pair = int(counts.argmax())  # the lowest of equals
                n = int(counts[pair])
                if n < max(1, self.config.min_frequency):
                    return out, kernel.NO_PAIRS
                a, b = divmod(pair, size)
                token = tokens[a] + tokens[b]
                if len(token) in self.lengths and token not in self.known and token not in known and not refused(token, self.config.require_letter, self.config.forbid_leading_space):
                    break
                gone.append(pair)
                counts[pair] = 0
            new = text.replace(bytes((a, b)), bytes((len(tokens),)))
            out.append((tokens[a], tokens[b], n, len(text) - len(new)))
            known.add(token)
            tokens.append(token)
            text = new
        return out, self.full

    def _by_kernel(self, data: np.ndarray, edges: np.ndarray) -> tuple[list[Merge], str]:
        lengths = np.diff(edges)
        done = kernel.train_arrays(data, lengths, np.ones(len(lengths), np.int64), self.config)
        t = done.tokens
        return [(t[a], t[b], m["best_frequency"], m["merges_applied"]) for (a, b), m in zip(done.merges, done.metrics)], done.stop_reason
