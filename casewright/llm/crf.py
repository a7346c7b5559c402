"""A linear-chain conditional random field in numpy.

Features are strings of single tokens, seen from an offset: the emission score
of a position is a sum over offsets of a vector that depends only on the token
there (at most two places away). So a text costs one table look-up per token,
and decoding is Viterbi over padded numpy batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


class LinearChainCRF:
    """labels: names; featurize(token, offset) -> features of the token seen from that offset; offsets: the window."""

    def __init__(self, labels: Sequence[str], featurize: Callable[[str, int], list[str]], offsets: Sequence[int] = (-2, -1, 0, 1, 2)):
        self.labels, self.featurize, self.offsets = list(labels), featurize, tuple(offsets)
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(self.labels)))
        n = len(self.labels)
        self.transitions, self.start, self.end = np.zeros((n, n)), np.zeros(n), np.zeros(n)
        # I-x follows B-x or I-x only
        self.allowed = np.array([[not b.startswith("I-") or a[2:] == b[2:] and a != "O" for b in self.labels] for a in self.labels])
        self.first_allowed = np.array([not a.startswith("I-") for a in self.labels])
        self._rows: dict[str, int] = {}
        self._table = np.zeros((0,))

    # ---- training: batch gradient steps (Adam) on the regularised likelihood

    def fit(self, sentences: Sequence[Sequence[str]], tags: Sequence[Sequence[str]], epochs: int = 30, rate: float = 0.08, l2: float = 1e-4, batch: int = 128, seed: int = 7) -> LinearChainCRF:
        lab = {x: i for i, x in enumerate(self.labels)}
        n = len(self.labels)
        feats: list[list[np.ndarray]] = []
        for s in sentences:
            padded = ["<s2>", "<s1>", *s, "</s1>", "</s2>"]
            rows = []
            for i in range(len(s)):
                ids = []
                for o in self.offsets:
                    for f in self.featurize(padded[i + 2 + o], o):
                        ids.append(self.index.setdefault(f"{o}|{f}", len(self.index)))
                rows.append(np.array(ids, dtype=np.int64))
            feats.append(rows)
        w = np.zeros((len(self.index), n))
        params = [w, self.transitions, self.start, self.end]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        rng, step, steps = np.random.default_rng(seed), 0, epochs * -(-len(sentences) // batch)
        gold = [np.array([lab[t] for t in ts]) for ts in tags]
        for _ in range(epochs):
            order = rng.permutation(len(sentences))
            # similar lengths share a batch
            chunks = [order[i : i + batch * 8] for i in range(0, len(order), batch * 8)]
            for chunk in chunks:
                chunk = sorted(chunk, key=lambda k: len(feats[k]))
                for at in range(0, len(chunk), batch):
                    grads = self._gradient([feats[k] for k in chunk[at : at + batch]], [gold[k] for k in chunk[at : at + batch]], w)
                    # the rate falls to nothing: at a constant one the labels of unlike words depend on the last steps
                    now, step = rate * max(0.0, 1 - step / steps), step + 1
                    for p, g, a, b in zip(params, grads, m1, m2):
                        g = g + l2 * p
                        a *= 0.9
                        a += 0.1 * g
                        b *= 0.999
                        b += 0.001 * g * g
                        p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        self.weights = w
        self._rows, self._table = {}, np.zeros((0,))
        return self

    def _gradient(self, feats: list[list[np.ndarray]], gold: list[np.ndarray], w: np.ndarray) -> list[np.ndarray]:
        size, n = len(feats), len(self.labels)
        lens = np.array([len(f) for f in feats])
        top = int(lens.max())
        flat = np.concatenate([ids for rows in feats for ids in rows])
        counts = np.array([len(ids) for rows in feats for ids in rows])
        where_b = np.repeat(np.arange(size), lens)
        where_t = np.concatenate([np.arange(k) for k in lens])
        owner = np.repeat(np.arange(len(counts)), counts)
        scores = np.zeros((len(counts), n))
        np.add.at(scores, owner, w[flat])
        em = np.zeros((size, top, n))
        em[where_b, where_t] = scores
        low = -1e9
        trans = np.where(self.allowed, self.transitions, low)
        first = np.where(self.first_allowed, self.start, low)

        def lse(x: np.ndarray, axis: int) -> np.ndarray:
            m = x.max(axis=axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))

        alpha = np.zeros((size, top, n))
        alpha[:, 0] = first + em[:, 0]
        for t in range(1, top):
            alpha[:, t] = lse(alpha[:, t - 1][:, :, None] + trans[None], 1) + em[:, t]
        last = lens - 1
        rows = np.arange(size)
        beta = np.zeros((size, top, n))
        for t in range(top - 1, -1, -1):
            at_end = last == t
            if t < top - 1:
                inner = lse(trans[None] + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(at_end[:, None], self.end, inner)
            else:
                beta[:, t] = self.end
        z = lse(alpha[rows, last] + self.end, 1)
        post = np.exp(alpha + beta - z[:, None, None])
        g_em = post[where_b, where_t]
        g_em[np.arange(len(counts)), np.concatenate(gold)] -= 1
        g_w = np.zeros_like(w)
        np.add.at(g_w, flat, g_em[owner])
        g_tr = np.zeros((n, n))
        for t in range(1, top):
            live = lens > t
            if live.any():
                g_tr += np.exp(alpha[live, t - 1][:, :, None] + trans[None] + (em[live, t] + beta[live, t])[:, None, :] - z[live][:, None, None]).sum(0)
        g_st, g_en = post[:, 0].sum(0), post[rows, last].sum(0)
        for y in gold:
            np.add.at(g_tr, (y[:-1], y[1:]), -1)
            g_st[y[0]] -= 1
            g_en[y[-1]] -= 1
        return [g / size for g in (g_w, np.where(self.allowed, g_tr, 0), np.where(self.first_allowed, g_st, 0), g_en)]

    # ---- decoding

    def with_features(self, featurize: Callable[[str, int], list[str]]) -> LinearChainCRF:
        """The same weights over other features of the tokens (longer word lists, for example)."""
        other = LinearChainCRF(self.labels, featurize, self.offsets)
        other.index, other.weights, other.transitions, other.start, other.end = self.index, self.weights, self.transitions, self.start, self.end
        return other

    def _rows_of(self, tokens: Sequence[str]) -> list[int]:
        """Row numbers of tokens in the table of their emission vectors (one per offset), filled as tokens come up."""
        rows, made = self._rows, []
        for t in tokens:
            row = rows.get(t)
            if row is None:
                row = rows[t] = len(rows)
                if row == len(self._table):
                    self._table = np.concatenate([self._table, np.zeros_like(self._table)]) if row else np.zeros((1024, len(self.offsets), len(self.labels)), dtype=np.float32)
                for k, o in enumerate(self.offsets):
                    ids = [self.index[f] for f in (f"{o}|{x}" for x in self.featurize(t, o)) if f in self.index]
                    self._table[row, k] = self.weights[ids].sum(0) if ids else 0
            made.append(row)
        return made

    def decode(self, sentences: Sequence[Sequence[str]], batch: int = 512) -> list[np.ndarray]:
        """Best label numbers of each sentence."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(sentences)
        if len(self._rows) > 200_000:  # a cache, not a limit on what is decoded
            self._rows, self._table = {}, np.zeros((0,))
        order = sorted((i for i in range(len(sentences)) if len(sentences[i])), key=lambda i: len(sentences[i]))
        trans = np.where(self.allowed, self.transitions, -1e9).astype(np.float32)
        first = np.where(self.first_allowed, self.start, -1e9).astype(np.float32)
        stop = self.end.astype(np.float32)
        before, after = self._rows_of(("<s2>", "<s1>")), self._rows_of(("</s1>", "</s2>"))
        i = 0
        while i < len(order):
            # padded cells per batch stay bounded however long a line is
            longest = len(sentences[order[min(i + batch, len(order)) - 1]])
            take = max(1, min(batch, 60_000 // longest))
            ids = order[i : i + take]
            i += take
            lens = np.array([len(sentences[k]) for k in ids])
            top = int(lens.max())
            rows = np.zeros((len(ids), top + 4), dtype=np.int64)
            for r, k in enumerate(ids):
                rows[r, : lens[r] + 4] = before + self._rows_of(sentences[k]) + after
            em = self._table[rows[:, 2 + self.offsets[0] : 2 + self.offsets[0] + top], 0]
            for c, o in enumerate(self.offsets[1:], 1):
                em += self._table[rows[:, 2 + o : 2 + o + top], c]
            score = first + em[:, 0]
            back = np.zeros((len(ids), top, len(self.labels)), dtype=np.int8)
            final = np.where((lens == 1)[:, None], score + stop, -np.inf)
            for t in range(1, top):
                cand = score[:, :, None] + trans[None]
                back[:, t] = cand.argmax(1)
                score = cand.max(1) + em[:, t]
                final = np.where((lens == t + 1)[:, None], score + stop, final)
            best = final.argmax(1)
            paths = np.zeros((len(ids), top), dtype=np.int64)
            cur = best
            for t in range(top - 1, -1, -1):
                # rows that end later than t follow their back pointers; the last position takes the best label
                cur = np.where(lens - 1 == t, best, cur)
                paths[:, t] = cur
                if t:
                    cur = np.where(lens - 1 >= t, back[np.arange(len(ids)), t, cur], cur)
            for r, k in enumerate(ids):
                out[k] = paths[r, : lens[r]]
        return out

    # ---- keeping

    def save(self, path: str) -> None:
        """Write the weights (without the feature function)."""
        np.savez_compressed(path, labels=self.labels, features=list(self.index), weights=self.weights.astype(np.float32), transitions=self.transitions, start=self.start, end=self.end, offsets=self.offsets)

    @classmethod
    def load(cls, path: str, featurize: Callable[[str, int], list[str]]) -> LinearChainCRF:
        """A model whose weights were written by ``save``."""
        with np.load(path) as kept:
            model = cls([str(x) for x in kept["labels"]], featurize, tuple(int(o) for o in kept["offsets"]))
            model.index = {str(f): i for i, f in enumerate(kept["features"])}
            model.weights, model.transitions, model.start, model.end = kept["weights"].astype(float), kept["transitions"], kept["start"], kept["end"]
        return model
