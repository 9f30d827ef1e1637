"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, decoding, merging of windows."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: O, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
SYMBOLS = 130
WINDOW, STRIDE = 96, 48


def codes(text: str) -> np.ndarray:
    """ASCII as it is; other letters 128, anything else 129."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = points.astype(np.int64)
    wide = out > 127
    if wide.any():
        out[wide] = [128 if chr(c).isalpha() else 129 for c in points[wide]]
    return out


def fresh(seed: int, embed: int = 12, hidden: int = 16) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.3, (SYMBOLS, embed)), "out": rng.normal(0, 0.2, (2 * hidden, TAGS)), "out_b": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
    for side in "fb":
        p[f"x{side}"] = rng.normal(0, 0.3, (embed, 4 * hidden))
        p[f"h{side}"] = rng.normal(0, 0.3, (hidden, 4 * hidden))
        p[f"b{side}"] = np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])  # forget gate open
    return p


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x, wx, wh, b, keep):
    n, steps, _ = x.shape
    size = wh.shape[0]
    h, c = np.zeros((n, size), x.dtype), np.zeros((n, size), x.dtype)
    out, cache = np.zeros((n, steps, size), x.dtype), []
    given = x @ wx + b
    for t in range(steps):
        z = given[:, t] + h @ wh
        f, i, o, g = _sigmoid(z[:, :size]), _sigmoid(z[:, size : 2 * size]), _sigmoid(z[:, 2 * size : 3 * size]), np.tanh(z[:, 3 * size :])
        before = c
        c = f * c + i * g
        th = np.tanh(c)
        if keep:
            cache.append((f, i, o, g, before, th, h))
        h = o * th
        out[:, t] = h
    return out, cache


def _lstm_back(d_out, x, wx, wh, cache):
    n, steps, size = d_out.shape
    kind = d_out.dtype
    d_given, dh, dc, d_wh = np.zeros((n, steps, 4 * size), kind), np.zeros((n, size), kind), np.zeros((n, size), kind), np.zeros_like(wh)
    for t in reversed(range(steps)):
        f, i, o, g, before, th, h = cache[t]
        dh = dh + d_out[:, t]
        dc = dc + dh * o * (1 - th * th)
        z = np.concatenate([dc * before * f * (1 - f), dc * g * i * (1 - i), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        d_given[:, t] = z
        d_wh += h.T @ z
        dh, dc = z @ wh.T, dc * f
    flat = d_given.reshape(-1, 4 * size)
    return d_given @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, d_wh, flat.sum(0)


def emissions(p, code: np.ndarray, keep: bool = False):
    x = p["embed"][code]
    hf, cf = _lstm(x, p["xf"], p["hf"], p["bf"], keep)
    hb, cb = _lstm(x[:, ::-1], p["xb"], p["hb"], p["bb"], keep)
    h = np.concatenate([hf, hb[:, ::-1]], axis=2)
    return h @ p["out"] + p["out_b"], (x, h, cf, cb)


def _log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def loss_and_gradient(p, code, tags):
    """Mean negative log likelihood of the tag sequences per character, and its gradient."""
    score, (x, h, cf, cb) = emissions(p, code, True)
    n, steps, _ = score.shape
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    alpha[:, 0] = p["first"] + score[:, 0]
    for t in range(1, steps):
        alpha[:, t] = score[:, t] + _log_sum(alpha[:, t - 1][:, :, None] + p["trans"][None], 1)
    for t in reversed(range(steps - 1)):
        beta[:, t] = _log_sum(p["trans"][None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    log_z = _log_sum(alpha[:, -1], 1)
    gold = p["first"][tags[:, 0]] + np.take_along_axis(score, tags[:, :, None], 2).sum((1, 2)) + p["trans"][tags[:, :-1], tags[:, 1:]].sum(1)
    scale = 1.0 / (n * steps)
    d_score = np.exp(alpha + beta - log_z[:, None, None])
    g = {"first": d_score[:, 0].sum(0) * scale}
    np.add.at(g["first"], tags[:, 0], -scale)
    both = alpha[:, :-1, :, None] + p["trans"] + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - log_z[:, None, None, None]
    g["trans"] = np.exp(both).sum((0, 1)) * scale
    np.add.at(g["trans"], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -scale)
    rows = np.arange(n)[:, None], np.arange(steps)[None, :]
    d_score[rows[0], rows[1], tags] -= 1
    d_score *= scale
    g["out"] = h.reshape(-1, h.shape[2]).T @ d_score.reshape(-1, TAGS)
    g["out_b"] = d_score.sum((0, 1))
    d_h = d_score @ p["out"].T
    size = d_h.shape[2] // 2
    dx_f, g["xf"], g["hf"], g["bf"] = _lstm_back(d_h[:, :, :size], x, p["xf"], p["hf"], cf)
    dx_b, g["xb"], g["hb"], g["bb"] = _lstm_back(d_h[:, ::-1, size:], x[:, ::-1], p["xb"], p["hb"], cb)
    g["embed"] = np.zeros_like(p["embed"])
    np.add.at(g["embed"], code, dx_f + dx_b[:, ::-1])
    return float((log_z - gold).sum() * scale), g


def train(code: np.ndarray, tags: np.ndarray, steps: int = 240, batch: int = 32, rate: float = 0.02, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam over random batches; the same examples give the same model."""
    rng = np.random.default_rng(seed)
    p = {k: w.astype(np.float32) for k, w in fresh(seed).items()}
    m, v = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}
    for step in range(1, steps + 1):
        at = rng.integers(0, len(code), batch)
        _, g = loss_and_gradient(p, code[at], tags[at])
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def decode(p, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tag sequence of each window, and for each character how far its tag's score is above the next best one."""
    score, _ = emissions(p, code)
    n, steps, _ = score.shape
    back = np.zeros(score.shape, np.int8)
    best = p["first"] + score[:, 0]
    for t in range(1, steps):
        through = best[:, :, None] + p["trans"][None]
        back[:, t] = through.argmax(1)
        best = through.max(1) + score[:, t]
    tags = np.zeros((n, steps), np.int64)
    tags[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
    own = np.take_along_axis(score, tags[:, :, None], 2)[:, :, 0]
    rest = score.copy()
    np.put_along_axis(rest, tags[:, :, None], -np.inf, 2)
    return tags, own - rest.max(2)


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of one tag sequence: a begin tag and the inside tags of its kind after it."""
    out, t = [], 0
    while t < len(tags):
        if tags[t] % 2 == 1:
            kind, s = int(tags[t] - 1) // 2, t
            t += 1
            while t < len(tags) and tags[t] == 2 * kind + 2:
                t += 1
            out.append((kind, s, t))
        else:
            t += 1
    return out


def joined(cut: list[tuple[int, int, int, bool, bool, float]], whole: list[tuple[float, int, int, int]]) -> list[tuple[float, int, int, int]]:
    """Spans (mean margin, start, end, kind) from pieces (kind, start, end, cut at the left, cut at the right, mean margin).

    Pieces of a kind that overlap are one span, if no side of it is cut any more: its first piece begins and its last one
    ends inside a window.  Pieces that a whole span of their kind overlaps are that span's.
    """
    out = []
    pieces = sorted(x for x in cut if not any(kind == x[0] and s < x[2] and x[1] < e for _, s, e, kind in whole))
    at = 0
    while at < len(pieces):
        kind, start, end = pieces[at][:3]
        last = at + 1
        while last < len(pieces) and pieces[last][0] == kind and pieces[last][1] < end:
            end = max(end, pieces[last][2])
            last += 1
        run = pieces[at:last]
        if any(s == start and not left for _, s, _, left, _, _ in run) and any(e == end and not right for _, _, e, _, right, _ in run):
            size = sum(e - s for _, s, e, *_ in run)
            out.append((sum(m * (e - s) for _, s, e, _, _, m in run) / size, start, end, kind))
        at = last
    return out


def _starts(text: str) -> range:
    return range(0, max(STRIDE, max(len(text) - WINDOW, 0) + STRIDE), STRIDE)


def find(p, texts: list[str], wanted) -> list[list[tuple[int, int, int]]]:
    """Spans of every whole text.  Windows overlap by half; ``wanted`` is a pattern of single characters that every
    accepted span holds (see pii.accepted), so a window without any can be passed over without changing the result.

    Pieces of one kind that touch an inner edge of their window are joined with what overlaps them in the next windows, so
    a span may be longer than a window; a piece that a window has whole is left to that window.  Of spans that overlap,
    whichever window they come from, the one with the larger mean margin stays.
    """
    todo: list[tuple[int, int]] = []
    for k, text in enumerate(texts):
        starts = _starts(text)
        todo += sorted((k, s) for s in {s for m in wanted.finditer(text) for s in (m.start() // STRIDE * STRIDE, (m.start() // STRIDE - 1) * STRIDE) if s in starts and m.start() < s + WINDOW})
    got: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    cut: list[list[tuple[int, int, int, bool, bool, float]]] = [[] for _ in texts]  # kind, start, end, cut at each side, mean margin
    done = set(todo)
    while todo:
        more = []  # windows that were passed over, but a piece goes on there
        for lo in range(0, len(todo), 256):
            some = todo[lo : lo + 256]
            parts = [texts[k][s : s + WINDOW] for k, s in some]
            code = np.full((len(some), WINDOW), 10, np.int64)
            for i, part in enumerate(parts):
                code[i, : len(part)] = codes(part)
            tags, margin = decode(p, code)
            for i, (k, s) in enumerate(some):
                if not tags[i].any():
                    continue
                for kind, a, b in spans_of(tags[i][: len(parts[i])]):
                    left, right = a == 0 and s > 0, b == WINDOW and s + b < len(texts[k])
                    if not (left or right):
                        got[k].append((float(margin[i, a:b].mean()), s + a, s + b, kind))
                        continue
                    cut[k].append((kind, s + a, s + b, left, right, float(margin[i, a:b].mean())))
                    more += [(k, s - STRIDE)] * left + [(k, s + STRIDE)] * right
        todo = sorted(set(more) - done)
        done |= set(todo)
    for k, own in enumerate(cut):
        got[k] += joined(own, got[k])
    out = []
    for found in got:
        kept: list[tuple[int, int, int]] = []
        for _, a, b, kind in sorted(set(found), key=lambda x: (-x[0], x[1], x[2], x[3])):
            if all(b <= s or e <= a for _, s, e in kept):
                kept.append((kind, a, b))
        out.append(sorted(kept, key=lambda x: x[1]))
    return out
