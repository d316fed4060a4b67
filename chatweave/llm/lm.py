"""LM scoring (operator 8): a gated recurrent language model over whole documents.

Tokens are lower-case words and one end. All training tokens are counted. A token's class is what its
last two bytes are (the most frequent endings have classes of their own); in a class the most
frequent words have slots, all other words share slot 0. A gated recurrent unit predicts the class
by one softmax and the slot in it by another; inside slot 0 a word has its smoothed share of
the class's counts, so the model is a proper distribution over all words, known or not.

Every token of every training document is trained on. Documents are cut into runs of consecutive
spans (all but very long ones are one run); runs are dealt to trainers, as many as the number of
spans asks for. Each runs truncated backpropagation, window by window with the state carried on to the
end of the run, and Spark averages what they learned, round by round. Scoring carries the state through all
windows of a document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatweave.llm.common import fold, hash_block, release, ship_package, store

END = np.uint64(0x5851F42D4C957F2D)
END_ENDING = -1
CLASSES = 64
SLOTS = 16
HIDDEN = 24
#: Words whose counts every task holds; the counts of rarer ones come by a join.
FREQUENT = 1 << 17
#: Words among which the slots are given.
CANDIDATES = 20_000
SPAN = 96
#: Spans through which training carries the state; a longer document is several runs, for several trainers.
RUN_SPANS = 64
WINDOW = 32
LANES = 64
SPANS_PER_TRAINER = 4000
ROUNDS = 2
#: Tokens and documents scored side by side, of tokens that are held for it.
CHUNK_BYTES = 3 << 20
SCORED_TOKENS = 1 << 21
SCORED_LANES = 256
SCORED_WINDOW = 64
#: Rows and numbers that are worked on together, so that they stay in the cache.
CACHED_ROWS = 480
STEP_NUMBERS = 1 << 14
LN10 = np.log(10)

# --- tokens and counts ------------------------------------------------------------------------


def token_chunks(texts: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first index, document, hash, ending) of all tokens, some documents at a time, ends included."""
    data = [(t or "").encode().lower() for t in texts]  # bytes: only A to Z change
    at = 0
    while at < len(data):
        to, size = at, 0
        while to < len(data) and (to == at or size + len(data[to]) < CHUNK_BYTES):
            size += len(data[to]) + 1
            to += 1
        owner, hashes, ending = hash_block(data[at:to])
        ends = np.searchsorted(owner, np.arange(to - at), side="right")
        yield at, np.insert(owner, ends, np.arange(to - at)), np.insert(hashes, ends, END), np.insert(ending, ends, END_ENDING)
        at = to


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, ending, c): every distinct token of ``docs`` with its count, summed in tasks before the shuffle."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = list(token_chunks(batch["text"]))
            if parts:
                hashes = np.concatenate([p[2] for p in parts])
                endings = np.concatenate([p[3] for p in parts])
                h, first, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "ending": endings[first], "n": n})

    partial = docs.select("text").mapInPandas(run, "h long, ending int, n long")
    return partial.groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("c"))


@dataclass(frozen=True)
class Vocabulary:
    """Fixed-size view of the counts: all endings' classes, slots of frequent words, frequent counts."""

    n_tokens: int
    n_distinct: int
    class_of_ending: np.ndarray  # by ending + 1
    words: np.ndarray  # hashes of words with a slot, ascending
    unit: np.ndarray  # class * SLOTS + slot of each
    unit_counts: np.ndarray  # training tokens of each unit
    log_rest: np.ndarray  # log10 of the smoothed counts that share slot 0, by class
    frequent: np.ndarray
    frequent_counts: np.ndarray

    def units(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        """Class and slot as one number, for each token."""
        out = self.class_of_ending[endings + 1] * SLOTS
        if len(self.words):
            at = np.searchsorted(self.words, hashes)
            at[at == len(self.words)] = 0
            known = self.words[at] == hashes
            out[known] = self.unit[at[known]]
        return out


def vocabulary(counts: DataFrame) -> Vocabulary:
    """What tasks need of ``counts``: sizes are bounded by the number of endings, CANDIDATES and FREQUENT."""
    n_tokens, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    endings = counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("n")).toPandas()
    endings = endings.sort_values(["c", "ending"], ascending=[False, True])
    top = counts.orderBy(F.desc("c"), "h").limit(FREQUENT).toPandas()
    class_of = np.zeros(1 + (1 << 16), np.int64)  # class 0: other endings
    class_of[END_ENDING + 1] = 1  # class 1: the end alone
    own = [e for e in endings["ending"] if e != END_ENDING][: CLASSES - 2]
    class_of[np.array(own, np.int64) + 1] = np.arange(2, 2 + len(own))
    rest, total = np.zeros(CLASSES), np.zeros(CLASSES)
    np.add.at(rest, class_of[endings["ending"] + 1], endings["c"] + 0.5 * endings["n"])
    np.add.at(total, class_of[endings["ending"] + 1], endings["c"])
    used, words, unit = np.zeros(CLASSES, int), [], []
    unit_counts = np.zeros((CLASSES, SLOTS))
    for h, ending, c in top.head(CANDIDATES).itertuples(index=False):
        k = class_of[ending + 1]
        if used[k] < SLOTS - 1:
            used[k] += 1
            words.append(h)
            unit.append(k * SLOTS + used[k])
            unit_counts[k, used[k]] = c
            rest[k] -= c + 0.5
    unit_counts[:, 0] = total - unit_counts.sum(1)
    words, unit = np.array(words, np.int64).view(np.uint64), np.array(unit, np.int64)
    order = np.argsort(words)
    hashes = top["h"].to_numpy(np.int64).view(np.uint64)
    by_hash = np.argsort(hashes)
    return Vocabulary(
        int(n_tokens), int(n_distinct), class_of, words[order], unit[order], unit_counts.ravel(),
        np.log10(np.maximum(rest, 0) + 0.5), hashes[by_hash], top["c"].to_numpy(float)[by_hash],
    )


# --- model ------------------------------------------------------------------------------------


def start_params(vocab: Vocabulary) -> dict[str, np.ndarray]:
    """Random units, and biases that make the untrained model the class unigram model."""
    rng = np.random.default_rng(5)
    counts = vocab.unit_counts.reshape(CLASSES, SLOTS) + 0.05
    counts[1, 2:] = counts[1, 0] = 1e-6  # nothing but the end is in its class
    by_class = counts.sum(1)
    return {k: v.astype(np.float32) for k, v in {
        "X": rng.normal(0, 0.3, (CLASSES * SLOTS, 3 * HIDDEN)), "U": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)),
        "C": np.zeros((HIDDEN, CLASSES)), "bc": np.log(by_class / by_class.sum()),
        "S": np.zeros((CLASSES, HIDDEN, SLOTS)), "bs": np.log(counts / by_class[:, None]),
    }.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def gru_step(p: dict[str, np.ndarray], h: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, tuple]:
    x, u = p["X"][unit], h @ p["U"]
    gates = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
    n = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
    return n + z * (h - n), (h, z, r, n, u[:, 2 * HIDDEN :])


def _log_softmax(x: np.ndarray) -> np.ndarray:
    """Natural logs of the shares of each row; ``x`` is overwritten, some rows at a time, which stay in the cache."""
    raised = np.empty((min(len(x), CACHED_ROWS), x.shape[1]), x.dtype)
    for at in range(0, len(x), CACHED_ROWS):
        some = x[at : at + CACHED_ROWS]
        some -= some.max(1, keepdims=True)
        some -= np.log(np.exp(some, out=raised[: len(some)]).sum(1, keepdims=True))
    return x


def log_probabilities(p: dict[str, np.ndarray], h: np.ndarray, unit: np.ndarray, grads: dict[str, np.ndarray] | None = None):
    """Natural log probability of each unit after state ``h``; with ``grads`` (filled) also the slope at ``h``
    of minus their mean.

    For the slots rows are sorted by class, so that a class costs a product or two and the rest is done for all rows at once.
    """
    k, s = unit // SLOTS, unit % SLOTS
    rows = np.arange(len(unit))
    if grads is None:  # the chosen class is all that is needed: no table of all rows
        out = np.empty(len(unit), np.result_type(h, p["C"], p["bc"]))
        for at in range(0, len(unit), CACHED_ROWS):
            some = h[at : at + CACHED_ROWS] @ p["C"]
            some += p["bc"]
            out[at : at + CACHED_ROWS] = _log_softmax(some)[rows[: len(some)], k[at : at + CACHED_ROWS]]
    else:
        by_class = h @ p["C"]
        by_class += p["bc"]
        by_class = _log_softmax(by_class)
        out = by_class[rows, k]
    order = np.argsort(k.astype(np.int16), kind="stable")
    cuts = np.concatenate(([0], np.cumsum(np.bincount(k, minlength=CLASSES)))).tolist()
    spans = [(c, slice(cuts[c], cuts[c + 1])) for c in range(CLASSES) if cuts[c] < cuts[c + 1]]
    sorted_h = np.take(h, order, axis=0)
    slots = np.take(p["bs"], k[order], axis=0)
    for c, at in spans:
        some = slots[at]
        some += sorted_h[at] @ p["S"][c]
    slots = _log_softmax(slots)
    out[order] += slots[rows, s[order]]
    if grads is None:
        return out
    d = np.exp(by_class, out=by_class)
    d[rows, k] -= 1
    d /= len(unit)
    grads["C"], grads["bc"] = h.T @ d, d.sum(0)
    dh = d @ p["C"].T
    d = np.exp(slots, out=slots)
    d[rows, s[order]] -= 1
    d /= len(unit)
    to_slots, to_bias = grads["S"], grads["bs"] = np.zeros_like(p["S"]), np.zeros_like(p["bs"])
    back, turned = np.empty_like(sorted_h), p["S"].transpose(0, 2, 1)
    for c, at in spans:
        some = d[at]
        np.matmul(sorted_h[at].T, some, out=to_slots[c])
        np.add.reduce(some, axis=0, out=to_bias[c])
        np.matmul(some, turned[c], out=back[at])
    place = np.empty_like(order)
    place[order] = rows
    dh += np.take(back, place, axis=0)
    return out, dh


def unroll(p: dict[str, np.ndarray], h: np.ndarray, units: np.ndarray, begins: np.ndarray | None = None, keep: bool = False):
    """States before each step of a window (steps x lanes, -1: no token, the state stays) and after the last one.

    At ``begins`` a lane starts at zero. With ``keep`` also the gates, the proposed states and what the state gave
    to them, else None. Steps write into arrays that are there already.
    """
    steps, lanes = units.shape
    two = 2 * HIDDEN
    kind, kept = np.result_type(h, p["U"]), steps if keep else 1
    minus, own = -p["X"][:, :two], np.ascontiguousarray(p["X"][:, two:])
    present = units >= 0
    full, tokens = present.all(1).tolist(), np.maximum(units, 0)
    states = np.empty((steps + 1, lanes, HIDDEN), kind)
    z, r, news, uns = (np.empty((kept, lanes, HIDDEN), kind) for _ in range(4))
    u, g, some = (np.empty((lanes, n * HIDDEN), kind) for n in (3, 2, 1))
    states[0] = h
    for t in range(steps):
        now, after, at = states[t], states[t + 1], t if keep else 0
        if begins is not None and begins[t].any():
            now[begins[t]] = 0
        n, un = news[at], uns[at]
        np.matmul(now, p["U"], out=u)
        np.subtract(np.take(minus, tokens[t], axis=0), u[:, :two], out=g)  # minus the sums
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        np.copyto(z[at], g[:, :HIDDEN])
        np.copyto(r[at], g[:, HIDDEN:])
        np.copyto(un, u[:, two:])
        np.multiply(r[at], un, out=n)
        n += np.take(own, tokens[t], axis=0)
        np.tanh(n, out=n)
        np.subtract(now, n, out=some)
        some *= z[at]
        np.add(some, n, out=after)
        if not full[t]:
            np.copyto(after, now, where=~present[t][:, None])
    return states, (z, r, news, uns) if keep else None


def window_grads(p: dict[str, np.ndarray], h: np.ndarray, units: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Slopes of the mean loss over one window (steps x lanes, -1: no token) and the state after it.

    What does not depend on the step before is computed for the whole window at once. Slopes lie in the
    order of the way back, the last step first.
    """
    steps, lanes = units.shape
    two = 2 * HIDDEN
    present = units >= 0
    full, real = present.all(1).tolist(), present.ravel()
    states, (z, r, news, uns) = unroll(p, h, units, keep=True)
    after, states = states[-1], states[:-1]
    kind = states.dtype
    flat_states, flat_units = states.reshape(-1, HIDDEN), units.ravel()
    grads: dict[str, np.ndarray] = {}
    if all(full):
        _, dout = log_probabilities(p, flat_states, flat_units, grads)
    else:
        dout = np.zeros((len(real), HIDDEN), kind)
        _, dout[real] = log_probabilities(p, flat_states[real], flat_units[real], grads)
    dout = dout.reshape(states.shape)
    # Slopes of the tokens' rows come to lie by token, to be summed over equal ones.
    tokens = np.maximum(units[::-1], 0).ravel().astype(np.int16)
    order = np.argsort(tokens, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    place = place.reshape(units.shape)
    inputs, products = np.empty((len(order), 3 * HIDDEN), kind), np.empty((steps, lanes, 3 * HIDDEN), kind)
    row = np.empty((lanes, 3 * HIDDEN), kind)
    some, other, dn, dh = (np.zeros((lanes, HIDDEN), kind) for _ in range(4))
    turned = p["U"].T
    for t in range(steps - 1, -1, -1):
        d, n = dh if full[t] else np.where(present[t][:, None], dh, 0), news[t]
        np.subtract(1, z[t], out=other)
        np.multiply(d, other, out=dn)
        np.subtract(states[t], n, out=some)
        some *= d
        some *= z[t]
        np.multiply(some, other, out=row[:, :HIDDEN])
        np.multiply(n, n, out=some)
        np.subtract(1, some, out=some)
        dn *= some
        np.subtract(1, r[t], out=other)
        np.multiply(dn, uns[t], out=some)
        some *= r[t]
        np.multiply(some, other, out=row[:, HIDDEN:two])
        np.copyto(row[:, two:], dn)
        inputs[place[steps - 1 - t]] = row
        np.multiply(dn, r[t], out=row[:, two:])
        products[steps - 1 - t] = row
        before = row @ turned
        before += np.multiply(d, z[t], out=some)
        if not full[t]:
            before = np.where(present[t][:, None], before, dh)
        before += dout[t]
        dh = before
    grads["U"] = states[::-1].reshape(-1, HIDDEN).T @ products.reshape(-1, 3 * HIDDEN)
    tokens = tokens[order]
    firsts = np.flatnonzero(np.diff(tokens, prepend=-1))
    grads["X"] = np.zeros_like(p["X"])
    grads["X"][tokens[firsts]] = np.add.reduceat(inputs, firsts)
    return grads, after


class Steps:
    """Adam's steps, as ``Adam`` takes them, on single-precision arrays of its own, changed in place and some numbers at a time."""

    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = {k: v.astype(np.float32) for k, v in params.items()}, rate, 0
        self.parts = [
            (k, slice(at, at + STEP_NUMBERS), self.params[k].reshape(-1)[at : at + STEP_NUMBERS])
            for k, v in params.items() for at in range(0, v.size, STEP_NUMBERS)
        ]
        self.moments = [(np.zeros_like(some), np.zeros_like(some)) for _, _, some in self.parts]
        self.scratch = np.empty((2, STEP_NUMBERS), np.float32)

    def step(self, grads: dict[str, np.ndarray], norm: float | np.floating = 1.0) -> None:
        """One step down ``grads``, divided by ``norm`` if that is above 1."""
        self.t += 1
        first, second = 1 - 0.9**self.t, 1 - 0.999**self.t
        for (k, at, param), (m, v) in zip(self.parts, self.moments, strict=True):
            g = grads[k].reshape(-1)[at]
            a, b = self.scratch[:, : len(g)]
            if norm > 1:
                g = (g / norm).astype(np.float32)
            m *= 0.9
            m += np.multiply(g, 0.1, out=a)
            v *= 0.999
            np.multiply(g, 0.001, out=a)
            a *= g
            v += a
            np.divide(v, second, out=b)
            np.sqrt(b, out=b)
            b += 1e-8
            np.divide(m, first, out=a)
            a *= self.rate
            a /= b
            param -= a


def train_on(p: dict[str, np.ndarray], runs: list[np.ndarray], rate: float) -> dict[str, np.ndarray]:
    """Truncated backpropagation over all tokens of ``runs``, ``LANES`` side by side.

    The state is carried from window to window to the end of a run. Then its lane takes the next one, so
    that long runs do not leave the other lanes empty.
    """
    adam = Steps(p, rate)
    lanes: list[tuple[np.ndarray, int]] = []  # a run and how much of it is done
    h = np.zeros((0, HIDDEN), np.float32)
    following = iter(runs)
    while True:
        going = [i for i, (run, at) in enumerate(lanes) if at < len(run)]
        lanes = [lanes[i] for i in going] + [(run, 0) for run in islice(following, LANES - len(going))]
        if not lanes:
            break
        h = np.concatenate([h[going], np.zeros((len(lanes) - len(going), HIDDEN), np.float32)])
        units = np.full((WINDOW, len(lanes)), -1)
        for lane, (run, at) in enumerate(lanes):
            some = run[at : at + WINDOW]
            units[: len(some), lane] = some
            lanes[lane] = (run, at + WINDOW)
        grads, h = window_grads(adam.params, h, units)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        adam.step(grads, norm)
    return adam.params


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def training_runs(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(spot, place, spans, run): all tokens of every document of ``docs`` (doc_id, text), in runs of at most
    ``RUN_SPANS`` spans. ``spot`` is a hash of the document's id and tokens, so that copies of a text part,
    ``place`` the number of the run in it, ``spans`` how many spans the run is worth."""
    longest = SPAN * RUN_SPANS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].to_numpy(np.int64).view(np.uint64)
            for first, owner, hashes, endings in token_chunks(batch["text"]):
                units = vocab.units(hashes, endings).astype(np.int16)
                cuts = np.flatnonzero(np.diff(owner)) + 1
                rows = [
                    (int((np.bitwise_xor.reduce(token) ^ ids[first + i]) >> np.uint64(1)), at // longest, some[at : at + longest])
                    for i, (some, token) in enumerate(zip(np.split(units, cuts), np.split(hashes, cuts), strict=True))
                    for at in range(0, len(some), longest)
                ]
                yield pd.DataFrame({
                    "spot": [r[0] for r in rows], "place": [r[1] for r in rows],
                    "spans": [-(-len(r[2]) // SPAN) for r in rows], "run": [r[2] for r in rows],
                })

    rows = docs.select(F.xxhash64("doc_id").alias("id"), "text")
    return rows.mapInPandas(run, "spot long, place long, spans long, run array<short>")


def fit(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters learned from all tokens of ``docs``; their size does not depend on the corpus."""
    params = start_params(vocab)
    runs = store(training_runs(docs, vocab))
    trainers = -(-(runs.agg(F.sum("spans")).first()[0] or 0) // SPANS_PER_TRAINER)
    for k in range(rounds if trainers else 0):
        begin, rate = flat(params), 0.01 / (1 + k)

        def run(batches: Iterator[pd.DataFrame], begin=begin, rate=rate) -> Iterator[pd.DataFrame]:
            some = [np.asarray(s, np.int16) for batch in batches for s in batch["run"]]
            if some:
                learned = flat(train_on(unflat(begin, params), some, rate))
                weight = float(sum(map(len, some)))
                yield pd.DataFrame({"place": np.arange(len(learned)), "value": learned.astype(float), "weight": weight})

        dealt = runs.repartition(trainers, F.pmod(F.xxhash64("spot", "place"), F.lit(trainers)))
        dealt = dealt.sortWithinPartitions(F.xxhash64("spot", "place", F.lit(k)))
        learned = dealt.select("run").mapInPandas(run, "place int, value double, weight double")
        mean = learned.groupBy("place").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("v")).toPandas()
        params = unflat(mean.sort_values("place")["v"].to_numpy(), params)
    release(runs)
    return params


# --- scores -----------------------------------------------------------------------------------


def lane_plan(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents dealt to lanes of about equal length, longest first; no more lanes than the longest fills."""
    lanes = int(min(lanes, max(1, lengths.sum() // max(1, lengths.max()))))
    ends = [(0, k) for k in range(lanes)]
    plan: list[list[int]] = [[] for _ in range(lanes)]
    for i in np.argsort(-lengths, kind="stable"):
        end, k = heapq.heappop(ends)
        plan[k].append(int(i))
        heapq.heappush(ends, (end + int(lengths[i]), k))
    return plan


def log_likelihoods(p: dict[str, np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of the units of each document; the state runs on through its windows."""
    out = np.zeros(len(docs))
    plan = lane_plan(np.array([len(d) for d in docs]), SCORED_LANES)
    steps = max(sum(len(docs[i]) for i in lane) for lane in plan)
    units = np.full((steps, len(plan)), -1, np.int16)
    owner = np.zeros((steps, len(plan)), np.int32)
    begins = np.zeros((steps, len(plan)), bool)
    for lane, some in enumerate(plan):
        at = 0
        for i in some:
            units[at : at + len(docs[i]), lane] = docs[i]
            owner[at : at + len(docs[i]), lane] = i
            begins[at, lane] = True
            at += len(docs[i])
    h = np.zeros((len(plan), HIDDEN), np.float32)
    for t in range(0, steps, SCORED_WINDOW):
        window = units[t : t + SCORED_WINDOW]
        states, _ = unroll(p, h, window, begins[t : t + SCORED_WINDOW])
        states, h = states[:-1], states[-1]
        real = window >= 0
        got = log_probabilities(p, states[real], window[real])
        out += np.bincount(owner[t : t + SCORED_WINDOW][real], got, minlength=len(docs))
    return out


PARTIAL_SCHEMA = (
    "row long, doc_id long, n_tokens long, known long, base double, model double, rare array<long>, rare_n array<int>"
)


def scored_rows(batches: Iterator[pd.DataFrame], vocab: Vocabulary, params: dict[str, np.ndarray], row: int) -> Iterator[pd.DataFrame]:
    """``PARTIAL_SCHEMA`` of batches of (doc_id, text), rows numbered from ``row``.

    Documents are held as units until there are ``SCORED_TOKENS``, so that many are scored beside a long one.
    """
    names = [c.split(" ")[0] for c in PARTIAL_SCHEMA.split(", ")]
    log_counts = np.log10(vocab.frequent_counts + 0.5)
    held: list[tuple[list[np.ndarray], np.ndarray, pd.DataFrame]] = []

    def scored() -> Iterator[pd.DataFrame]:
        model, at = log_likelihoods(params, [doc for docs, _, _ in held for doc in docs]) / LN10, 0
        for docs, inside, frame in held:
            yield frame.assign(model=model[at : at + len(docs)] + inside)[names].astype({"doc_id": "Int64"})
            at += len(docs)
        held.clear()

    size = 0
    for batch in batches:
        ids = batch["doc_id"].astype("Int64")
        for first, owner, hashes, endings in token_chunks(batch["text"]):
            n = int(owner[-1]) + 1
            units = vocab.units(hashes, endings)
            cuts = np.flatnonzero(np.diff(owner)) + 1
            # Inside slot 0: the word's smoothed count over the class's; END is never there if it was seen.
            in_rest = units % SLOTS == 0
            inside = -np.bincount(owner[in_rest], vocab.log_rest[units[in_rest] // SLOTS], minlength=n)
            at = np.zeros(len(hashes), np.int64)
            there = np.zeros(len(hashes), bool)
            if len(vocab.frequent):
                at = np.searchsorted(vocab.frequent, hashes)
                at[at == len(vocab.frequent)] = 0
                there = vocab.frequent[at] == hashes
            base = np.bincount(owner[there], log_counts[at[there]], minlength=n)
            rest_there = there & in_rest
            inside += np.bincount(owner[rest_there], log_counts[at[rest_there]], minlength=n)
            known, tokens = np.bincount(owner[there], minlength=n), np.bincount(owner, minlength=n)
            rare, rare_of = hashes[~there].view(np.int64), owner[~there]
            split = np.searchsorted(rare_of, np.arange(1, n))
            counted = [np.unique(some, return_counts=True) for some in np.split(rare, split)]
            frame = pd.DataFrame({
                "row": np.arange(row, row + n), "doc_id": ids.iloc[first : first + n].to_numpy(object), "n_tokens": tokens, "known": known,
                "base": base, "rare": [h for h, _ in counted], "rare_n": [times.astype(np.int32) for _, times in counted],
            })
            row += n
            held.append((np.split(units.astype(np.int16), cuts), inside, frame))
            size += len(units)
            if size >= SCORED_TOKENS:
                yield from scored()
                size = 0
    if held:
        yield from scored()


def partial_scores(docs: DataFrame, vocab: Vocabulary, params: dict[str, np.ndarray]) -> DataFrame:
    """One row per document: sums over tokens whose counts the task holds, and the other tokens with numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from scored_rows(batches, vocab, params, TaskContext.get().partitionId() << 33)

    return docs.select("doc_id", "text").mapInPandas(run, PARTIAL_SCHEMA)


def score(docs: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text).

    Null text is empty: its one token is the end. Repeated rows count as often as they occur and
    each gets its row. Without training rows nothing is known and the base score is 0.
    """
    ship_package(docs.sparkSession)
    out = (fold(F.col("doc_id"), folds) == held_out).alias("held_out")
    train = docs.where(fold(F.col("doc_id"), folds) != held_out)
    counts = store(token_counts(train))
    vocab = vocabulary(counts)
    params = fit(train, vocab)
    partial = store(partial_scores(docs, vocab, params))
    rare = partial.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select(
        "row", F.col("r.rare").alias("h"), F.col("r.rare_n").alias("n")
    )
    met = rare.join(counts.select("h", "c"), "h", "left")
    sums = met.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log_c"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"),
    )
    log_all = float(np.log10(vocab.n_tokens + 0.5 * (vocab.n_distinct + 1)))
    rest = F.coalesce("log_c", F.lit(0.0))
    return partial.drop("rare", "rare_n").join(sums, "row", "left").select(
        "doc_id", out, "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rest - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("model") + rest).alias("score"),
    )
