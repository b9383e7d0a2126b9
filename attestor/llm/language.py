"""Language identification by a bidirectional gated recurrent network over bytes.

One recurrent layer reads a text's UTF-8 bytes forwards, another backwards, and a linear layer labels
every position with a distribution over the languages. The document's distribution is the mean over
all its positions. Training is plain numpy: cross-entropy of every position with the document's
language, back-propagated through time, with Adam steps.

Documents are predicted by the recurrence over the whole text, however long it is: many texts side by
side, sorted by length, each from its first byte to its last and both directions in one step. The
network can hold a state over thousands of bytes, so no text is begun in its midst.

Training reads *lanes*: a text longer than LANE bytes takes several lanes, each of which is entered
WARM bytes before its own first position and left as many behind its last. The lanes are cut into blocks
of BLOCK steps, each of which starts from the states that the network has when it comes to it (read anew
in every epoch); gradients go back through a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.common import prepare, unused

#: In training: bytes of a lane, bytes that it reads before and behind them, and numbers that a group of lanes yields in a direction, about.
LANE, WARM, GROUP = 2048, 256, 1 << 23
#: In prediction: numbers that texts read together yield in a direction, at most (longer texts are read in parts), and how many texts that are.
NUMBERS, TOGETHER = 1 << 24, 384
#: Bytes whose rows of the byte tables are fetched at once, and characters of texts that a worker gathers before it reads them together, about.
STRETCH, GATHERED = 1024, 32 << 20
#: Steps of a block in training, and units of each direction.
BLOCK, HIDDEN = 64, 16
#: Labelled documents of each language that the network is fitted on, at most (whole texts).
TRAINING_ROWS = 150
EPOCHS, BATCH, RATE = 6, 256, 0.02
UNDETERMINED = "und"
#: What makes a text more than marks and digits; the same in Python and in Spark's expressions.
LETTER = r"\p{L}"
_LETTER = regex.compile(LETTER)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Gru:
    """One direction: parameters, forward pass, and back-propagation through time."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.h = hidden
        f = np.float32
        self.p = {
            "x": rng.normal(0, 0.3, (257, 3 * hidden)).astype(f),  # byte table (bias included); row 256 pads
            "u": (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f),
        }

    def forward(self, steps: np.ndarray, keep: bool = False, state: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """States after each step; steps: (length, blocks) of bytes; state: before the first step (none: zero)."""
        H, X, U = self.h, self.p["x"], self.p["u"]
        state = np.zeros((steps.shape[1], H), dtype=np.float32) if state is None else state
        out, kept = np.empty((*steps.shape, H), dtype=np.float32), []
        for t, b in enumerate(steps):
            a, c = X[b], state @ U
            gates = _sigmoid(a[:, : 2 * H] + c[:, : 2 * H])
            z, r = gates[:, :H], gates[:, H:]
            n = np.tanh(a[:, 2 * H :] + r * c[:, 2 * H :])
            new = n + z * (state - n)
            if keep:
                kept.append((state, z, r, n, c[:, 2 * H :]))
            out[t] = state = new
        return out, kept

    def read(self, steps: np.ndarray, active: np.ndarray) -> np.ndarray:
        """States after each step of lanes that end one by one: (length, lanes, units).

        The same as forward(), with the three gates apart, so that each of them is one run of memory; a
        sigmoid is taken as (1 + tanh(x / 2)) / 2.
        """
        H, half = self.h, np.float32(0.5)
        (xz, xr, xn), (uz, ur, un) = ([np.ascontiguousarray(m[:, k * H : (k + 1) * H] * f) for k, f in enumerate(factors)] for m, factors in ((self.p["x"], (half, half, 1)), (self.p["u"], (half, half, half))))
        lanes_ = steps.shape[1]
        out = np.empty((*steps.shape, H), dtype=np.float32)
        buffers = [np.empty((lanes_, H), dtype=np.float32) for _ in range(4)]
        state = np.zeros((lanes_, H), dtype=np.float32)
        for t, n in enumerate(active.tolist()):
            b, state = steps[t, :n], state[:n]
            z, r, new, a = (x[:n] for x in buffers)
            for gate, u, x in ((z, uz, xz), (r, ur, xr)):
                np.matmul(state, u, out=gate)
                gate += np.take(x, b, axis=0, out=a, mode="clip")
                np.tanh(gate, out=gate)
                gate += 1
            np.matmul(state, un, out=new)
            new *= r
            new += np.take(xn, b, axis=0, out=a, mode="clip")
            np.tanh(new, out=new)
            state -= new
            z *= half
            state *= z
            state += new
            out[t, :n] = state
        return out

    def backward(self, steps: np.ndarray, kept: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the parameters, given those of all states."""
        H, U = self.h, self.p["u"]
        gx, gu = np.zeros_like(self.p["x"]), np.zeros_like(U)
        after = np.zeros_like(grad[0])
        for t in range(len(steps) - 1, -1, -1):
            state, z, r, n, cn = kept[t]
            d = grad[t] + after
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (state - n) * z * (1 - z)
            dr = dn * cn * r * (1 - r)
            da = np.concatenate([dz, dr, dn], axis=1)
            dc = np.concatenate([dz, dr, dn * r], axis=1)
            after = d * z + dc @ U.T
            gu += state.T @ dc
            np.add.at(gx, steps[t], da)
        return {"x": gx, "u": gu}


class Network:
    """Both directions and the labelling layer."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Gru(rng, hidden), Gru(rng, hidden)
        self.out = {"w": rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32), "b": np.zeros(len(languages), dtype=np.float32)}

    def positions(self, blocks: np.ndarray, keep: bool = False, states: tuple[np.ndarray, np.ndarray] | tuple[None, None] = (None, None)):
        """Distribution over languages at every position: (length, blocks, languages); states: of both directions, before the blocks."""
        steps = np.ascontiguousarray(blocks.T)
        f, kf = self.ahead.forward(steps, keep, states[0])
        b, kb = self.back.forward(steps[::-1], keep, states[1])
        both = np.concatenate([f, b[::-1]], axis=2)
        p = _softmax(both @ self.out["w"] + self.out["b"])
        return (p, both, kf, kb, steps) if keep else p

    def gradients(self, blocks: np.ndarray, labels: np.ndarray, states: tuple[np.ndarray, np.ndarray] | tuple[None, None] = (None, None)) -> list[tuple[dict, dict]]:
        """(parameters, gradients) pairs for one batch; padding has no part in the loss."""
        p, both, kf, kb, steps = self.positions(blocks, keep=True, states=states)
        real = (steps < 256).astype(np.float32)[:, :, None]
        p[:, np.arange(len(labels)), labels] -= 1
        d = p * real / real.sum()
        flat = d.reshape(-1, d.shape[2])
        g = {"w": both.reshape(-1, both.shape[2]).T @ flat, "b": flat.sum(axis=0)}
        grads = d @ self.out["w"].T
        H = self.ahead.h
        gf = self.ahead.backward(steps, kf, grads[:, :, :H])
        gb = self.back.backward(steps[::-1], kb, grads[::-1, :, H:])
        return [(self.out, g), (self.ahead.p, gf), (self.back.p, gb)]

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 4) -> None:
        """Learn every position of the texts."""
        rng, moments, step = np.random.default_rng(seed), {}, 0
        groups = list(lanes(texts, self.ahead.h))
        blocks, of = (np.concatenate(x) for x in zip(*(g.blocks() for g in groups), strict=True))
        labels, total = labels[of], epochs * -(-len(blocks) // BATCH)
        for _ in range(epochs):
            before = [np.concatenate(x) for x in zip(*(g.block_states(self.ahead, self.back) for g in groups), strict=True)]
            order = rng.permutation(len(blocks))
            for at in range(0, len(order), BATCH):
                rows, step = order[at : at + BATCH], step + 1
                now = rate * (1 - step / (total + 1))
                for part, (params, grads) in enumerate(self.gradients(blocks[rows], labels[rows], (before[0][rows], before[1][rows]))):
                    for name, g in grads.items():
                        g = np.clip(g, -1, 1)
                        m, v = moments.setdefault((part, name), (np.zeros_like(g), np.zeros_like(g)))
                        m += 0.1 * (g - m)
                        v += 0.01 * (g * g - v)
                        params[name] -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean distribution over all positions of each text (an empty text: zeros)."""
        sums, most = np.zeros((len(texts), len(self.languages))), max(1, NUMBERS // len(self.languages))
        of, parts, starts = [], [], []
        for i, t in enumerate(texts):
            ends = range(most, len(t), most)  # of the parts of a text whose numbers would be too many at once, but for the last
            states = self._states_between(t, ends)
            for k, a in enumerate(range(0, len(t), most)):
                of.append(i)
                parts.append(t[a : a + most])
                starts.append(states[:, k])
        order, at = sorted(range(len(parts)), key=lambda k: -len(parts[k])), 0
        while at < len(order):
            size, end = 0, at
            while end < len(order) and end - at < TOGETHER and (end == at or size + len(parts[order[end]]) <= most):
                size, end = size + len(parts[order[end]]), end + 1
            rows, at = order[at:end], end
            np.add.at(sums, [of[k] for k in rows], self._sums([parts[k] for k in rows], np.stack([starts[k] for k in rows], axis=1)))
        return sums / np.maximum(1, [len(t) for t in texts])[:, None]

    def _states_between(self, text: bytes, ends: range) -> np.ndarray:
        """States (2, parts, units) that the two directions enter each part with, if a text's parts end at ``ends`` and at its end."""
        states = np.zeros((2, len(ends) + 1, self.ahead.h), dtype=np.float32)
        if ends:
            pair, done, state = Pair(self.ahead, self.back, self.out["w"]), 0, np.zeros((2, 1, self.ahead.h), dtype=np.float32)
            for step in sorted({*ends, *(len(text) - e for e in ends)}):
                pair.run(Together([text[done:step]], [text[len(text) - step : len(text) - done]]), state)
                done = step
                if step in ends:
                    states[0, ends.index(step) + 1] = state[0, 0]
                if len(text) - step in ends:
                    states[1, ends.index(len(text) - step)] = state[1, 0]
        return states

    def _sums(self, texts: list[bytes], states: np.ndarray) -> np.ndarray:
        """Sums of the distributions at all positions of texts, longest first, that the directions enter with the given states."""
        together = Together(texts, texts)
        logits = np.empty((2, together.first[-1], len(self.languages)), dtype=np.float32)
        Pair(self.ahead, self.back, self.out["w"]).run(together, states, logits)
        sums = np.zeros((len(self.languages), len(texts)))
        for step, end in together.stretches(1 << 15):
            at, mirrored, lane = together.positions(step, end)
            p = np.ascontiguousarray((logits[0, at] + logits[1].take(mirrored, axis=0)).T)
            p += self.out["b"][:, None]
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            for total, x in zip(sums, p, strict=True):
                total += np.bincount(lane, x, len(texts))
        return sums.T


class Together:
    """Bytes of some texts, longest first, that are read side by side from the first of ``ahead`` and from the last of ``back``.

    All numbers lie step by step, and at each step for those texts only that have a byte there.
    """

    def __init__(self, ahead: list[bytes], back: list[bytes]):
        self.length = np.array([len(t) for t in ahead])
        #: texts that have a byte at each step, and where a step's bytes begin
        self.active = np.searchsorted(-self.length, -np.arange(1, self.length[0] + 1), side="right")
        self.first = np.concatenate([[0], np.cumsum(self.active)])
        self.data = np.empty((2, self.first[-1]), dtype=np.uint8)
        for lane, (a, b) in enumerate(zip(ahead, back, strict=True)):
            at = self.first[: len(a)] + lane
            self.data[0, at] = np.frombuffer(a, dtype=np.uint8)
            self.data[1, at] = np.frombuffer(b, dtype=np.uint8)[::-1]

    def stretches(self, size: int, even: bool = False) -> Iterator[tuple[int, int]]:
        """(first step, end) of stretches of at most so many bytes (or of one step); even: with equally many texts at all steps."""
        step = 0
        while step < len(self.active):
            end = max(step + 1, int(np.searchsorted(self.first, self.first[step] + size, side="right")) - 1)
            if even:
                end = min(end, int(self.length[self.active[step] - 1]))
            yield step, end
            step = end

    def positions(self, step: int, end: int) -> tuple[slice, np.ndarray, np.ndarray]:
        """Places of the bytes of some steps, read ahead; of the same bytes read back; and their texts."""
        at = slice(self.first[step], self.first[end])
        steps = np.repeat(np.arange(step, end), self.active[step:end])
        lane = np.arange(at.start, at.stop) - self.first[steps]
        return at, self.first[self.length[lane] - 1 - steps] + lane, lane


class Pair:
    """Both directions at once, over texts side by side: the recurrence of Gru.forward().

    Each gate of both directions is one run of memory; a sigmoid is taken as (1 + tanh(x / 2)) / 2.
    """

    def __init__(self, ahead: Gru, back: Gru, out: np.ndarray):
        H = self.h = ahead.h
        gates = lambda name, factors: np.stack([[g.p[name][:256, k * H : (k + 1) * H] * np.float32(f) for g in (ahead, back)] for k, f in enumerate(factors)])
        self.x, self.u = gates("x", (0.5, 0.5, 1)).reshape(-1, H), gates("u", (0.5, 0.5, 0.5))
        self.w = np.ascontiguousarray(out.reshape(2, H, -1))

    def run(self, texts: Together, states: np.ndarray, logits: np.ndarray | None = None) -> None:
        """Read all texts; states (2, texts, units) become those after their last steps; logits gets each direction's share at every step."""
        H, half, one, of_gate = self.h, np.float32(0.5), np.float32(1), 256 * np.arange(6).reshape(3, 2, 1)
        matmul, tanh, add, multiply, subtract, n = np.matmul, np.tanh, np.add, np.multiply, np.subtract, 0
        for begin, end in texts.stretches(STRETCH, even=True):
            if n != (n := int(texts.active[begin])):
                if begin:
                    states[:, : state.shape[1]] = state
                state, gates = states[:, :n].copy(), np.empty((3, 2, n, H), dtype=np.float32)
                entered, zr, (z, r, new) = state[None], gates[:2], gates
            at = int(texts.first[begin])
            data = texts.data[:, at : texts.first[end]].reshape(2, -1, 1, n).transpose(1, 2, 0, 3)
            for x in self.x.take(data + of_gate, axis=0):
                matmul(entered, self.u, gates)
                add(zr, x[:2], zr)
                tanh(zr, zr)
                add(zr, one, zr)
                multiply(new, r, new)
                add(new, x[2], new)
                tanh(new, new)
                subtract(state, new, state)
                multiply(z, half, z)
                multiply(state, z, state)
                add(state, new, state)
                if logits is not None:
                    matmul(state, self.w, logits[:, at : at + n])
                    at += n
        states[:, :n] = state


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Distributions along the last axis, in place."""
    logits -= logits.max(axis=-1, keepdims=True)
    p = np.exp(logits, out=logits)
    p /= p.sum(axis=-1, keepdims=True)
    return p


class Lanes:
    """Some lanes, longest first: (text, bytes, first and end of its own positions)."""

    def __init__(self, parts: list[tuple[int, bytes, int, int]]):
        self.parts = sorted(parts, key=lambda p: -len(p[1]))
        self.text, self.begin, self.end = (np.array([p[k] for p in self.parts]) for k in (0, 2, 3))
        self.length = np.array([len(p[1]) for p in self.parts])
        #: lanes that have a byte at each step
        self.active = np.searchsorted(-self.length, -np.arange(1, self.length[0] + 1), side="right")

    def steps(self, direction: int) -> np.ndarray:
        """(length, lanes) of bytes, each lane from its first (1) or its last byte (-1)."""
        out = np.zeros((len(self.parts), self.length[0]), dtype=np.uint8)
        for row, (_, data, _, _) in zip(out, self.parts, strict=True):
            row[: len(data)] = np.frombuffer(data, dtype=np.uint8)[::direction]
        return np.ascontiguousarray(out.T)

    def _cuts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lane, first byte, end) of the blocks of the lanes' own positions."""
        count = -(-(self.end - self.begin) // BLOCK)
        lane = np.repeat(np.arange(len(count)), count)
        start = self.begin[lane] + BLOCK * (np.arange(len(lane)) - (np.cumsum(count) - count)[lane])
        return lane, start, np.minimum(start + BLOCK, self.end[lane])

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of each block, short ones padded with 256; its text)."""
        lane, start, end = self._cuts()
        out = np.full((len(lane), BLOCK), 256, dtype=np.int16)
        for row, k, a, b in zip(out, lane.tolist(), start.tolist(), end.tolist(), strict=True):
            row[: b - a] = np.frombuffer(self.parts[k][1], dtype=np.uint8)[a:b]
        return out, self.text[lane]

    def block_states(self, ahead: Gru, back: Gru) -> tuple[np.ndarray, np.ndarray]:
        """States of both directions before each block; at a lane's ends, and where padding comes first, zero."""
        lane, start, end = self._cuts()
        out = []
        for gru, direction, step in ((ahead, 1, start - 1), (back, -1, self.length[lane] - 1 - end)):
            known = (step >= 0) & ((direction == 1) | (end - start == BLOCK))
            states = gru.read(self.steps(direction), self.active)[np.maximum(step, 0), lane]
            out.append(np.where(known[:, None], states, np.float32(0)))
        return out[0], out[1]


def lanes(texts: list[bytes], numbers: int) -> Iterator[Lanes]:
    """The lanes of some texts, in groups of lanes that are alike in length; numbers: how many each step of a lane yields."""
    parts = []
    for i, t in enumerate(texts):
        for a in range(0, len(t), LANE):
            low, high = max(0, a - WARM), min(len(t), a + LANE + WARM)
            parts.append((i, t[low:high], a - low, min(a + LANE, len(t)) - low))
    parts.sort(key=lambda p: len(p[1]))
    held = []
    for part in parts:
        if held and (len(held) + 1) * len(part[1]) * numbers > GROUP:
            yield Lanes(held)
            held = []
        held.append(part)
    if held:
        yield Lanes(held)


def fit(rows: Iterable[tuple[str, str]]) -> Network | None:
    """A network from (text, language) rows; None if there are none."""
    rows = [(text.encode("utf-8", "replace"), lang) for text, lang in rows if text]
    if not rows:
        return None
    net = Network(sorted({lang for _, lang in rows}))
    net.fit([text for text, _ in rows], np.array([net.languages.index(lang) for _, lang in rows]))
    return net


def train(docs: DataFrame, keep, bound: int = TRAINING_ROWS) -> Network | None:
    """Fit on the whole texts of at most ``bound`` documents of each language with a letter, for which ``keep`` holds.

    They are those with the smallest hashes of doc_id (of the text where ids repeat; equal rows count
    once), so that no language is left out for being rare. Hashes are ranked first; texts are read
    again for the chosen rows only.
    """
    usable = docs.where(keep & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(LETTER)).select("doc_id", "lang", "text", F.xxhash64("text").alias("of"))
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "of"))
    keys = usable.select("doc_id", "lang", "of").withColumn("rank", rank).where(F.col("rank") <= bound).drop("rank").distinct()
    rows = usable.join(F.broadcast(keys), ["doc_id", "lang", "of"], "left_semi").dropDuplicates(["doc_id", "lang", "of"])  # keys: ``bound`` rows a language
    rows = rows.select("doc_id", "text", "lang").collect()
    return fit((r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["text"], r["lang"])))


def _gathered(batches: Iterator[pd.Series]) -> Iterator[list[pd.Series]]:
    """Batches by so many that their texts have GATHERED characters (the last: fewer): the longest text takes as many steps alone as beside others."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += sum(len(t) for t in batch if t)
        if size >= GATHERED:
            yield some
            some, size = [], 0
    if some:
        yield some


def predict_documents(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with two more columns: lang_pred, and score (the pooled probability).

    ``und`` with score 0.0 where the text is null, empty or without a letter, and where nothing was
    learned. Repeated rows get equal predictions; an empty table gives an empty result; all other
    columns are kept (those of the two names are replaced).
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(net)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for some in _gathered(batches):
            texts = list(dict.fromkeys(t for batch in some for t in batch if net is not None and t and _LETTER.search(t)))
            known = {}
            if texts:
                p = net.document_probabilities([t.encode("utf-8", "replace") for t in texts])
                best = p.argmax(axis=1)
                known = dict(zip(texts, zip([net.languages[k] for k in best], np.clip(p.max(axis=1), 0, 1), strict=True), strict=True))
            for batch in some:
                yield pd.DataFrame([known.get(t, (UNDETERMINED, 0.0)) for t in batch], columns=["lang_pred", "score"])

    told = unused(docs, "__told")
    return docs.withColumn(told, predict("text")).withColumns({"lang_pred": F.col(f"{told}.lang_pred"), "score": F.col(f"{told}.score")}).drop(told)
