"""The merge decisions, and an in-memory trainer over distinct words."""

from __future__ import annotations

import heapq
import os
import resource
import time
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

from byteloom import layout
from byteloom.config import TrainerConfig
from byteloom.functions.bytes import refused

TARGET, ITERATIONS, NO_PAIRS, PLATEAU = "target_vocab_reached", "max_iterations_reached", "no_eligible_pairs", "plateau_reached"


def resident_kb() -> int:
    """Memory that this process holds now; where the system doesn't tell, the most that it has held."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") // 1024
    except OSError:
        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss


@dataclass
class Trained:
    """tokens: bytes by id, without padding; merges by rank; one metrics row a merge."""

    tokens: list[bytes]
    merges: list[tuple[int, int]] = field(default_factory=list)
    metrics: list[dict] = field(default_factory=list)
    stop_reason: str = TARGET
    seconds: float = 0.0


class Decider:
    """Judges pairs in the order of their rank, whoever counted them."""

    def __init__(self, config: TrainerConfig):
        self.config = config
        self.out = Trained(layout.base_tokens(config.trailing))
        self.known = set(self.out.tokens)
        self.lengths = frozenset(config.allowed_lengths)
        self.floor = max(config.plateau_floor, config.min_frequency)
        self.first: int | None = None
        self.streak = 0
        self.began = self.last = time.perf_counter()

    def done(self, stop: str) -> Trained:
        """What was trained, with the reason of its end."""
        self.out.stop_reason, self.out.seconds = stop, time.perf_counter() - self.began
        return self.out

    def fits(self, pair: tuple[int, int]) -> bool:
        """Whether the pair's bytes have an allowed length; other pairs are no candidates."""
        t = self.out.tokens
        return len(t[pair[0]]) + len(t[pair[1]]) in self.lengths

    def wanted(self, pair: tuple[int, int]) -> bool:
        """Whether the pair fits and isn't turned down."""
        token = self.out.tokens[pair[0]] + self.out.tokens[pair[1]]
        return len(token) in self.lengths and token not in self.known and not refused(token, self.config.require_letter, self.config.forbid_leading_space)

    def full(self) -> str | None:
        """Why no further merge is wanted, if so."""
        done = len(self.out.merges)
        if done >= self.config.merge_budget:
            return TARGET
        if self.config.max_iterations is not None and done >= self.config.max_iterations:
            return ITERATIONS
        return None

    def judge(self, pair: tuple[int, int], n: int) -> str:
        """"merge", "reject" (for good) or "stop" for the pair of greatest count n."""
        c = self.config
        self.first = n if self.first is None else self.first
        if c.plateau:
            if n <= self.floor or n * c.plateau_divisor <= self.first:
                self.streak += 1
                if self.streak >= c.plateau_patience:
                    return "stop"
            else:
                self.streak = 0
        token = self.out.tokens[pair[0]] + self.out.tokens[pair[1]]
        if refused(token, c.require_letter, c.forbid_leading_space) or token in self.known:
            return "reject"
        return "merge"

    def merge(self, pair: tuple[int, int], n: int, applied: int, distinct: int | None) -> int:
        """Takes the pair into the vocabulary; its id."""
        token = self.out.tokens[pair[0]] + self.out.tokens[pair[1]]
        self.known.add(token)
        self.out.tokens.append(token)
        self.out.merges.append(pair)
        now = time.perf_counter()
        self.out.metrics.append(
            {
                "iteration": len(self.out.merges),
                "best_frequency": n,
                "merges_applied": applied,
                "distinct_pairs": distinct,
                "elapsed_iteration": now - self.last,
                "elapsed_total": now - self.began,
                "rss_kb": resident_kb(),
            }
        )
        self.last = now
        return len(self.out.tokens) - 1


class _Positions:
    """All words in one array of tokens, linked so that merged ones drop out, and where each pair stood when it arose."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, weights: np.ndarray):
        n = len(data)
        self.token = data.astype(np.int64) + layout.FIRST_BYTE
        self.next, self.prev = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(lengths)
        self.next[ends - 1] = -1
        self.prev[ends - lengths] = -1
        self.weight = np.repeat(weights, lengths)
        self.where: dict[int, list[np.ndarray]] = {}

    def at(self, places: np.ndarray) -> np.ndarray:
        """The pairs that begin at the places, as numbers that sort as their ids do."""
        return self.token[places] << 32 | self.token[self.next[places]]

    def listed(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different pairs at the places and their weights; where each stands is noted."""
        key = self.at(places)
        order = np.argsort(key, kind="stable")
        key, places = key[order], places[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        keys = key[new]
        for k, part in zip(keys.tolist(), np.split(places, new[1:])):
            self.where.setdefault(k, []).append(part)
        return keys, np.add.reduceat(self.weight[places], new) if len(new) else np.zeros(0, np.int64)

    def merge(self, pair: int, token: int) -> tuple[int, list[int], list[int], list[int], list[int]]:
        """Replacements of a pair from left to right; the pairs that went and those that came, each with their weights."""
        places = np.sort(np.concatenate(self.where.pop(pair)))
        if len(places) > 1:
            places = places[np.concatenate([[True], places[1:] != places[:-1]])]
        a, b = pair >> 32, pair & 0xFFFFFFFF
        places = places[(self.token[places] == a) & (self.next[places] >= 0)]
        places = places[self.token[self.next[places]] == b]
        if a == b and len(places) > 1:
            # In a run of overlapping places every second one is taken.
            follows = np.concatenate([[False], self.next[places[:-1]] == places[1:]])
            at = np.arange(len(places))
            places = places[(at - np.maximum.accumulate(np.where(follows, 0, at))) % 2 == 0]
        right = self.next[places]
        before, after = self.prev[places], self.next[right]
        touched = np.unique(np.concatenate([before[before >= 0], places, right[after >= 0]]))
        key, at = np.unique(self.at(touched), return_inverse=True)
        went = np.bincount(at, self.weight[touched]).astype(np.int64)
        self.token[places], self.token[right] = token, -1
        self.next[places] = after
        self.prev[after[after >= 0]] = places[after >= 0]
        before = self.prev[places]
        came, gained = self.listed(np.unique(np.concatenate([before[before >= 0], places[self.next[places] >= 0]])))
        return int(self.weight[places].sum()), key.tolist(), went.tolist(), came.tolist(), gained.tolist()


def train_words(words: Iterable[tuple[str, int]], config: TrainerConfig) -> Trained:
    """Trains on (Latin-1 word, weight) rows."""
    words = [(w, n) for w, n in words if len(w) > 1]
    data = np.frombuffer("".join(w for w, _ in words).encode("latin-1"), np.uint8)
    return train_arrays(data, np.array([len(w) for w, _ in words], np.int64), np.array([n for _, n in words], np.int64), config)


def train_arrays(data: np.ndarray, lengths: np.ndarray, weights: np.ndarray, config: TrainerConfig) -> Trained:
    """Trains on the joined bytes of words of one byte or more, with an index of the places where each pair arose."""
    decider = Decider(config)
    p = _Positions(data, lengths, weights)
    keys, n = p.listed(np.flatnonzero(p.next >= 0))
    counts: dict[int, int] = dict(zip(keys.tolist(), n.tolist()))

    def ids(pair: int) -> tuple[int, int]:
        return pair >> 32, pair & 0xFFFFFFFF

    heap = [(-n, k) for k, n in counts.items() if n >= config.min_frequency and decider.fits(ids(k))]
    heapq.heapify(heap)
    gone: set[int] = set()
    live = len(counts)
    while True:
        stop = decider.full()
        if stop:
            break
        while heap and (heap[0][1] in gone or counts.get(heap[0][1], 0) != -heap[0][0]):
            n, pair = heapq.heappop(heap)
            now = counts.get(pair, 0)
            if pair not in gone and 0 < now < -n and now >= config.min_frequency:
                heapq.heappush(heap, (-now, pair))
        if not heap:
            stop = NO_PAIRS
            break
        n, pair = heapq.heappop(heap)
        verdict = decider.judge(ids(pair), -n)
        if verdict == "stop":
            stop = PLATEAU
            break
        if verdict == "reject":
            gone.add(pair)
            live -= 1
            continue
        token = len(decider.out.tokens)
        applied, old, went, new, gained = p.merge(pair, token)
        delta: dict[int, int] = dict(zip(new, gained))
        for k, d in zip(old, went):
            delta[k] = delta.get(k, 0) - d
        for k, d in delta.items():
            if d:
                before = counts.get(k, 0)
                counts[k] = before + d
                if k not in gone:
                    live += (before + d > 0) - (before > 0)
        live -= counts.pop(pair, 0) > 0
        decider.merge(ids(pair), -n, applied, live)
        for k in new:
            if counts.get(k, 0) >= config.min_frequency and token in ids(k) and decider.fits(ids(k)):
                heapq.heappush(heap, (-counts[k], k))
    return decider.done(stop)


def padding(tokens: list[bytes], size: int) -> list[bytes]:
    """Runs of white space, of 2, 3, ... spaces, tabs, line feeds and returns, that fill a vocabulary up to size."""
    known, out, n = set(tokens), [], 2
    while len(tokens) + len(out) < size:
        for b in b" \t\n\r":
            run = bytes([b]) * n
            if run not in known and len(tokens) + len(out) < size:
                out.append(run)
        n += 1
    return out
