"""A character-level bidirectional LSTM with CRF transitions, in numpy; ``reader`` reads much text.

Tags are O and, for each kind, B (first character) and I (further ones). Tag scores are a linear
map of both directions' states; the CRF adds a score for each pair of neighbouring tags, where I
follows B or I of its own kind only. ``fit`` minimizes the negative log-likelihood of labelled
windows with Adam, by back-propagation through time and the CRF's forward-backward sums.
"""

from __future__ import annotations

import numpy as np

from personae.llm import reader

# ASCII as it is but for digits, which are all one; one code each for other letters, other signs
# and the filling of short windows
CODES = 131
_ASCII = bytes(ord("0") if chr(c).isdigit() else c for c in range(128)).ljust(256, b"\0")
_UNSEEN = 255
_CODE = np.full(1 << 21, _UNSEEN, np.uint8)  # by code point; those beyond ASCII once they are met
_CODE[:128] = np.frombuffer(_ASCII, np.uint8)[:128]
_NEVER = -1e4


def codes(text: str) -> np.ndarray:
    if text.isascii():
        return np.frombuffer(text.encode("ascii").translate(_ASCII), np.uint8)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _CODE[points]
    unseen = points[out == _UNSEEN]
    if len(unseen):
        for c in set(unseen.tolist()):
            _CODE[c] = 128 if chr(c).isalpha() else 129
        out = _CODE[points]
    return out


def filled(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One matrix of codes, and where it is not filling."""
    lengths = np.array([len(w) for w in windows])
    out = np.full((len(windows), lengths.max()), CODES - 1, np.uint8)
    inside = np.arange(out.shape[1]) < lengths[:, None]
    out[inside] = np.concatenate(windows)
    return out, inside


def _allowed(tags: int) -> np.ndarray:
    """Penalty of each pair of tags, and in row -1 of each first tag."""
    out = np.zeros((tags + 1, tags), np.float32)
    for i in range(2, tags, 2):  # I of a kind; B is i - 1
        out[:, i] = _NEVER
        out[i - 1, i] = out[i, i] = 0
    return out


def _paired(a: np.ndarray) -> np.ndarray:
    """Columns of all B, then of all I, without O."""
    return np.concatenate([a[..., 1::2], a[..., 2::2]], axis=-1)


class Above(reader.Scores):
    """Scores of tags above O's: ``total`` has all B, then all I; ``above[k]`` (place, tag) is window k's."""

    def __getitem__(self, k: int) -> np.ndarray:
        paired = super().__getitem__(k)
        kinds = paired.shape[1] // 2
        out = np.zeros((len(paired), 2 * kinds + 1), np.float32)
        out[:, 1::2], out[:, 2::2] = paired[:, :kinds], paired[:, kinds:]
        return out


class Tagger:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.tags = weights["o"].shape[0]
        self.fixed = _allowed(self.tags)

    @classmethod
    def fresh(cls, kinds: int, hidden: int, rng: np.random.Generator) -> Tagger:
        tags = 2 * kinds + 1
        w = {"T": np.zeros((tags + 1, tags)), "o": np.zeros(tags)}
        w["O"] = rng.normal(0, (2 * hidden) ** -0.5, (2 * hidden, tags))
        for side in "fb":
            w["X" + side] = rng.normal(0, 0.3, (CODES, 4 * hidden))
            w["W" + side] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden))
            w["X" + side][:, hidden : 2 * hidden] += 1  # remember, to begin with
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _states(self, side: str, x: np.ndarray, inside: np.ndarray, keep: bool = False):
        """States of one direction, and what back-propagation needs."""
        given, own = self.w["X" + side], self.w["W" + side]
        n = own.shape[0]
        h = c = np.zeros((len(x), n), np.float32)
        out = np.zeros((*x.shape, n), np.float32)
        trace = []
        for t in range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1):
            z = given[x[:, t]] + h @ own
            gates = z[:, : 3 * n]  # logistic functions by way of tanh
            gates *= 0.5
            np.tanh(z, out=z)
            gates += 1
            gates *= 0.5
            i, f, o, g = (z[:, k * n : (k + 1) * n] for k in range(4))
            on = inside[:, t, None]
            before = (h, c)
            c = (f * c + i * g) * on
            s = np.tanh(c)
            h = o * s * on
            out[:, t] = h
            if keep:
                trace.append((t, z, before, s, on))
        return out, trace

    def _read(self, side: str, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """The same states as ``_states``, by place, unit and window, for reading much text."""
        states = reader.states(x, inside, self.w["X" + side], self.w["W" + side], side == "b")
        return states.transpose(0, 2, 1)

    def scores(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Score of each tag at each place."""
        n = self.w["Wf"].shape[0]
        out = np.matmul(self.w["O"][:n].T, self._read("f", x, inside))
        out += np.matmul(self.w["O"][n:].T, self._read("b", x, inside))
        return out.transpose(2, 0, 1) + self.w["o"]  # in memory, windows lie side by side

    def above(self, x: np.ndarray, inside: np.ndarray) -> Above:
        """What ``scores`` gives, less the score of O."""
        n = self.w["Wf"].shape[0]
        out = _paired(self.w["O"] - self.w["O"][:, :1])
        sides = zip("fb", (out[:n], out[n:]), strict=True)
        got = Above(x, inside, [(self.w["X" + s], self.w["W" + s], part) for s, part in sides])
        got.total += _paired(self.w["o"] - self.w["o"][0])[:, None]
        return got

    def _quiet(self, above: Above, inside: np.ndarray) -> np.ndarray:
        """Windows whose best tags are all O: no span of any kind can be worth more than O's.

        A span is worth its scores above O's, the steps in it, and at most the best step to it
        and from it, whatever is next to it.
        """
        move = self.w["T"] + self.fixed
        enter = np.maximum(move[:-1].max(axis=0) - move[0, 0], move[-1] - move[-1, 0])[1::2]
        more = (move[:-1].max(axis=0) - move[0, 0])[2::2]
        leave = np.maximum(move[:-1, 0] - move[0, 0], 0)[1:].reshape(-1, 2).max(axis=1) + 1e-3
        kinds = len(enter)
        worth = above.total[:, :kinds] + (enter + leave).astype(np.float32)[:, None]
        further = above.total[:, kinds:] + more.astype(np.float32)[:, None]
        worth[above.start - 1, :, above.lane] = -np.inf  # no span goes on from before a window
        further[above.start - 1, :, above.lane] = -np.inf
        for t in range(1, len(worth)):
            further[t] += worth[t - 1]
            np.maximum(worth[t], further[t], out=worth[t])
        place, _, lane = np.unravel_index(np.flatnonzero(worth >= 0), worth.shape)
        owner = above.owner[place, lane]
        quiet = np.ones(len(inside), bool)
        quiet[owner[owner >= 0]] = False
        return quiet

    def decode(self, x: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, Above]:
        """The best tags of each window, and tag scores less the score of O."""
        above = self.above(x, inside)
        path = np.zeros(x.shape, np.int8)
        loud = np.flatnonzero(~self._quiet(above, inside))
        if len(loud):
            path[loud] = self._best(np.stack([above[k] for k in loud]), inside[loud])
        return path, above

    def _best(self, emission: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Tags with the largest score (Viterbi); windows begin at their first place."""
        move = self.w["T"] + self.fixed
        lengths = inside.sum(axis=1)
        order = np.argsort(-lengths, kind="stable")  # so that those still read come first
        on = np.searchsorted(-lengths[order], -np.arange(inside.shape[1]))
        score = emission[order].transpose(1, 2, 0).copy()  # (place, tag, window)
        score[0] += move[-1][:, None]
        for t in range(1, len(score)):
            n = on[t]
            step = score[t - 1, :, None, :n] + move[:-1, :, None]
            score[t, :, :n] += step.max(axis=0)
        path = np.zeros(inside.shape, np.int8)
        tag = np.zeros(len(path), np.int64)
        for t in range(len(score) - 1, -1, -1):
            old, n = on[t + 1] if t + 1 < len(score) else 0, on[t]
            tag[:old] = (score[t, :, :old] + move[:-1, tag[:old]]).argmax(axis=0)
            tag[old:n] = score[t, :, old:n].argmax(axis=0)
            path[order[:n], t] = tag[:n]
        return path

    def spans(self, path: np.ndarray, above: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(start, end, kind, margin) of one window; the margin is over tags O instead."""
        move = self.w["T"] + self.fixed
        out, end = [], 0
        for t in np.flatnonzero(path).tolist():
            if t < end:
                continue
            tag, end = int(path[t]), t + 1
            while end < len(path) and path[end] == tag + 1:
                end += 1
            inner = [int(g) for g in path[t:end]]
            before = int(path[t - 1]) if t else -1
            after = [int(path[end])] if end < len(path) else []
            chain = [before, *inner, *after]
            margin = sum(above[t + k, g] for k, g in enumerate(inner))
            margin += sum(move[i, j] for i, j in zip(chain, chain[1:], strict=False))
            margin -= move[before, 0] + (end - t - 1) * move[0, 0] + sum(move[0, g] for g in after)
            out.append((t, end, (tag - 1) // 2, float(margin)))
        return out

    def loss(self, x: np.ndarray, inside: np.ndarray, y: np.ndarray):
        """Mean negative log-likelihood of the tags ``y``, and its gradients."""
        states, traces = zip(*[self._states(s, x, inside, True) for s in "fb"], strict=True)
        both = np.concatenate(states, axis=2)
        emission = both @ self.w["O"] + self.w["o"]
        value, d_emission, d_move = _crf(emission, self.w["T"] + self.fixed, inside, y)
        grads = {"T": d_move, "o": d_emission.sum(axis=(0, 1))}
        flat = d_emission.reshape(-1, self.tags)
        grads["O"] = both.reshape(-1, both.shape[2]).T @ flat
        d_both = d_emission @ self.w["O"].T
        n = self.w["Wf"].shape[0]
        for k, side in enumerate("fb"):
            grads |= self._back(side, x, traces[k], d_both[:, :, k * n : (k + 1) * n])
        return value, grads

    def _back(self, side: str, x: np.ndarray, trace, d_out: np.ndarray) -> dict:
        own = self.w["W" + side]
        n = own.shape[0]
        d_x, d_own = np.zeros_like(self.w["X" + side]), np.zeros_like(own)
        d_zs = np.zeros((*x.shape, 4 * n), own.dtype)
        d_h = d_c = np.zeros((len(x), n), np.float32)
        for t, z, (h, c), s, on in reversed(trace):
            i, f, o, g = (z[:, k * n : (k + 1) * n] for k in range(4))
            d_h = (d_h + d_out[:, t]) * on
            d_state = (d_c + d_h * o * (1 - s * s)) * on
            d_z = np.concatenate([
                d_state * g * i * (1 - i), d_state * c * f * (1 - f),
                d_h * s * o * (1 - o), d_state * i * (1 - g * g),
            ], axis=1)
            d_zs[:, t] = d_z
            d_own += h.T @ d_z
            d_h, d_c = d_z @ own.T, d_state * f
        order = np.argsort(x, axis=None, kind="stable")
        used, starts = np.unique(x.ravel()[order], return_index=True)
        d_x[used] = np.add.reduceat(d_zs.reshape(-1, 4 * n)[order], starts)
        return {"X" + side: d_x, "W" + side: d_own}


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (np.log(np.exp(a - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _crf(emission: np.ndarray, move: np.ndarray, inside: np.ndarray, y: np.ndarray):
    """Mean loss, and its gradients by emissions and by transitions."""
    rows, width, tags = emission.shape
    each = np.arange(rows)
    alpha = np.zeros(emission.shape, np.float64)
    alpha[:, 0] = emission[:, 0] + move[-1]
    for t in range(1, width):
        step = _logsumexp(alpha[:, t - 1, :, None] + move[:-1], 1) + emission[:, t]
        alpha[:, t] = np.where(inside[:, t, None], step, alpha[:, t - 1])
    total = _logsumexp(alpha[:, -1], 1)
    d_emission = np.zeros(emission.shape, np.float64)
    d_move = np.zeros(move.shape, np.float64)
    gold = emission[each, 0, y[:, 0]] + move[-1, y[:, 0]]
    beta = np.zeros((rows, tags))
    for t in range(width - 1, -1, -1):
        on = inside[:, t]
        here = np.exp(alpha[:, t] + beta - total[:, None])
        d_emission[:, t] = here * on[:, None]
        d_emission[each[on], t, y[on, t]] -= 1
        if not t:
            d_move[-1] += here.sum(axis=0)
            np.add.at(d_move[-1], y[:, 0], -1)
            break
        gold += (emission[each, t, y[:, t]] + move[y[:, t - 1], y[:, t]]) * on
        pair = move[:-1] + (emission[:, t] + beta)[:, None, :]
        both = np.exp(alpha[:, t - 1, :, None] + pair - total[:, None, None])
        d_move[:-1] += both[on].sum(axis=0)
        np.add.at(d_move, (y[on, t - 1], y[on, t]), -1)
        beta = np.where(on[:, None], _logsumexp(pair, 2), beta)
    value = float((total - gold).mean())
    return value, (d_emission / rows).astype(np.float32), (d_move / rows).astype(np.float32)


def fit(
    windows: list[tuple[str, list[tuple[int, int, int]]]], kinds: int, hidden: int = 24,
    steps: int = 500, batch: int = 96, rate: float = 0.02, seed: int = 12,
) -> Tagger:
    """Learn from (text, spans as (start, end, kind)) that do not overlap, in ``steps`` steps."""
    rng = np.random.default_rng(seed)
    model = Tagger.fresh(kinds, hidden, rng)
    data = []
    for text, spans in windows:
        y = np.zeros(len(text), np.int64)
        for start, end, kind in spans:
            y[start:end] = 2 * kind + 2
            y[start] = 2 * kind + 1
        data.append((codes(text), y))
    data = sorted((d for d in data if len(d[0])), key=lambda d: len(d[0]))
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    starts = np.arange(0, len(data), batch)
    rounds = [rng.permutation(starts) for _ in range(-(-steps // max(1, len(starts))))]
    for step, at in enumerate(np.concatenate(rounds)[:steps] if len(starts) else [], 1):
        speed = rate * (1 - step / (steps + 1))
        some = data[at : at + batch]
        x, inside = filled([c for c, _ in some])
        y = np.zeros(x.shape, np.int64)
        y[inside] = np.concatenate([t for _, t in some])
        _, grads = model.loss(x, inside, y)
        norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / max(norm, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model.w[k] -= (
                speed * (first[k] / (1 - 0.9**step))
                / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            ).astype(np.float32)
    return model
