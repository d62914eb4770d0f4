"""Linear-chain conditional random fields over hashed sparse features, in numpy.

A position has any number of feature ids; its score for a label is the sum of their weights. Models are
small and fitted on a bounded sample; they travel to the tasks that label whole tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """``weights`` (features x labels), ``moves`` (label to label), ``starts`` (first label), as log scores."""

    weights: np.ndarray
    moves: np.ndarray
    starts: np.ndarray

    def scores(self, ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """(n x labels): the summed weights of each position; ``owner`` is the position of each feature id."""
        columns = [np.bincount(owner, self.weights[ids, k], minlength=n) for k in range(self.weights.shape[1])]
        return np.stack(columns, axis=1)


def _forward_backward(scores: np.ndarray, mask: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities (sequences x places x labels) and the summed probabilities of label pairs."""
    b, t, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(moves - moves.max())
    alpha, beta = np.empty((b, t, k)), np.ones((b, t, k))
    first = np.exp(starts - starts.max()) * e[:, 0]
    alpha[:, 0] = first / first.sum(axis=1, keepdims=True)
    for i in range(1, t):
        step = (alpha[:, i - 1] @ a) * e[:, i]
        alpha[:, i] = np.where(mask[:, i, None], step / step.sum(axis=1, keepdims=True), alpha[:, i - 1])
    pairs = np.zeros((k, k))
    for i in range(t - 1, 0, -1):
        after = e[:, i] * beta[:, i]
        both = alpha[:, i - 1, :, None] * a * after[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True))[mask[:, i]].sum(axis=0)
        step = after @ a.T
        beta[:, i - 1] = np.where(mask[:, i, None], step / step.sum(axis=1, keepdims=True), beta[:, i])
    nodes = alpha * beta
    return nodes / nodes.sum(axis=2, keepdims=True), pairs


def train(ids: np.ndarray, owner: np.ndarray, labels: np.ndarray, lengths: np.ndarray, features: int, n_labels: int, rounds: int = 40, rate: float = 0.2, decay: float = 1e-4) -> Chain:
    """Maximum likelihood by Adam steps on all sequences at once; the same input gives the same model.

    Positions of all sequences stand one after the other; ``lengths`` cuts them. The gradient is what the
    labels have minus what forward-backward expects of features, pairs and first labels.
    """
    n, b, t = len(labels), len(lengths), int(lengths.max())
    mask = np.arange(t)[None, :] < lengths[:, None]
    place = np.flatnonzero(mask.ravel())
    gold = np.zeros((n, n_labels))
    gold[np.arange(n), labels] = 1
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inner = np.ones(n, bool)
    inner[first] = False
    moved = np.zeros((n_labels, n_labels))
    np.add.at(moved, (labels[np.flatnonzero(inner) - 1], labels[inner]), 1)
    used, flat = np.unique(ids, return_inverse=True)
    flat, owner = flat.astype(np.int32), owner.astype(np.int32)
    model = Chain(np.zeros((len(used), n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (model.weights, model.moves, model.starts)]
    for step in range(1, rounds + 1):
        scores = np.zeros((b * t, n_labels))
        scores[place] = model.scores(flat, owner, n)
        nodes, pairs = _forward_backward(scores.reshape(b, t, n_labels), mask, model.moves, model.starts)
        off = gold - nodes.reshape(b * t, n_labels)[place]
        slopes = (np.stack([np.bincount(flat, off[owner, k], minlength=len(used)) for k in range(n_labels)], axis=1), moved - pairs, off[first].sum(axis=0))
        for x, slope, (m, v) in zip((model.weights, model.moves, model.starts), slopes, state):
            slope = slope / n - decay * x
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    whole = np.zeros((features, n_labels))
    whole[used] = model.weights
    return Chain(whole.astype(np.float32), model.moves, model.starts)


def posteriors(model: Chain, scores: np.ndarray, lengths: np.ndarray, lane: int = 32) -> np.ndarray:
    """Label probabilities of every position of sequences of any length, by exact forward-backward.

    Sequences are cut into lanes of ``lane`` places. All lanes are reduced to one matrix each side by side; messages
    run along a sequence over these matrices, then through all lanes side by side. So the number of array
    steps is that of lanes in the longest sequence, and memory follows the number of places.
    """
    k = scores.shape[1]
    lanes = -(-lengths // lane)
    total, of_lane = int(lanes.sum()), np.concatenate([[0], np.cumsum(lanes)])
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    slot = np.arange(int(lengths.sum())) - np.repeat(start, lengths) + np.repeat(of_lane[:-1] * lane, lengths)
    e = np.ones((total * lane, k))
    e[slot] = np.exp(scores - scores.max(axis=1, keepdims=True))
    real = np.zeros(total * lane, bool)
    real[slot] = True
    e, real = e.reshape(total, lane, k).transpose(1, 0, 2).copy(), real.reshape(total, lane).T.copy()
    a, s = np.exp(model.moves - model.moves.max()), np.exp(model.starts - model.starts.max())
    head = np.zeros(total, bool)
    head[of_lane[:-1]] = True

    whole = np.tile(np.eye(k), (total, 1, 1))
    for i in range(lane):
        step = (whole @ a) * e[i][:, None, :]
        if i == 0:  # the first place of a sequence has no move into it
            step[head] = np.eye(k) * (s * e[0][head])[:, None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        whole = np.where(real[i][:, None, None], step, whole)
    into, back = np.ones((total, k)), np.ones((total, k))
    order = np.argsort(-lanes, kind="stable")
    for j in range(1, int(lanes.max())):
        at = of_lane[order[: int((lanes > j).sum())]] + j
        step = (into[at - 1][:, None, :] @ whole[at - 1])[:, 0]
        into[at] = step / step.sum(axis=1, keepdims=True)
    for j in range(int(lanes.max()) - 1, 0, -1):
        at = of_lane[order[: int((lanes > j).sum())]] + j
        step = (whole[at] @ back[at][:, :, None])[:, :, 0]
        back[at - 1] = step / step.sum(axis=1, keepdims=True)
    alpha = np.empty((lane, total, k))
    now = into
    for i in range(lane):
        step = (now @ a) * e[i]
        if i == 0:
            step[head] = s * e[0][head]
        step /= step.sum(axis=1, keepdims=True)
        now = alpha[i] = np.where(real[i][:, None], step, now)
    now = back
    for i in range(lane - 1, -1, -1):
        alpha[i] *= now
        step = (e[i] * now) @ a.T
        step /= step.sum(axis=1, keepdims=True)
        now = np.where(real[i][:, None], step, now)
    nodes = alpha.transpose(1, 0, 2).reshape(total * lane, k)[slot]
    return nodes / nodes.sum(axis=1, keepdims=True)


def best_paths(model: Chain, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The labels of the best path through each sequence (Viterbi), one after the other.

    All sequences take a step side by side, the longer ones go on; so memory follows the number of places.
    """
    n, k = scores.shape
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    full = int((lengths > 0).sum())
    running = [int((lengths > i).sum()) for i in range(int(lengths.max()) if n else 0)]
    back, best = np.zeros((n, k), np.int64), np.zeros((full, k))
    if full:
        best[:] = model.starts + scores[start[:full]]
    for i, live in enumerate(running[1:], 1):
        at = start[:live] + i
        step = best[:live, :, None] + model.moves
        back[at] = step.argmax(axis=1)
        best[:live] = step.max(axis=1) + scores[at]
    path = np.zeros(n, np.int64)
    now = best.argmax(axis=1)
    for i in range(len(running) - 1, -1, -1):
        at = start[: running[i]] + i
        path[at] = now[: running[i]]
        now[: running[i]] = np.where(i > 0, back[at, now[: running[i]]], 0)
    return path
