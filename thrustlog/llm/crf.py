"""A linear-chain conditional random field of two labels over token sequences, in numpy.

A sequence is cut into blocks of ``BLOCK`` tokens. The product of a block's 2 x 2 transfer matrices carries
messages across it, so forward and backward passes run over all blocks at once and a very long
sequence costs no more per token than a short one.
"""

import numpy as np

BLOCK = 32


class Chain:
    """Sequences of the given lengths laid out in blocks; ``emissions`` are the scores of label 1 in turn."""

    def __init__(self, lengths):
        self.lengths = np.asarray(lengths, np.int64)
        parts = -(-self.lengths // BLOCK)
        self.first = np.cumsum(parts) - parts  # of each sequence
        self.parts = parts
        n = int(parts.sum())
        sequence = np.repeat(np.arange(len(parts)), parts)
        start = np.cumsum(self.lengths) - self.lengths
        begin = start[sequence] + (np.arange(n) - self.first[sequence]) * BLOCK
        end = np.minimum(begin + BLOCK, (start + self.lengths)[sequence])
        place = np.arange(BLOCK)[:, None] + begin
        self.filled = place < end  # (BLOCK, blocks)
        self.place = np.where(self.filled, place, 0)

    def _across(self, product):
        """Messages that enter each block from the left and from the right."""
        n = product.shape[2]
        left, right = np.zeros((2, n)), np.ones((2, n))
        left[0, self.first[self.parts > 0]] = 1.0  # a sequence begins after label 0
        for k in range(1, int(self.parts.max(initial=0))):
            at = self.first[self.parts > k] + k
            message = np.einsum("in,ijn->jn", left[:, at - 1], product[:, :, at - 1])
            left[:, at] = message / message.sum(axis=0)
        for k in range(int(self.parts.max(initial=0)) - 2, -1, -1):
            at = self.first[self.parts > k + 1] + k
            message = np.einsum("ijn,jn->in", product[:, :, at + 1], right[:, at + 1])
            right[:, at] = message / message.sum(axis=0)
        return left, right

    def marginals(self, emissions, transitions, pairs=False):
        """Probability of label 1 per token; with ``pairs`` also the expected transitions and log Z."""
        if not len(emissions):
            return (np.zeros(0), np.zeros((2, 2)), 0.0) if pairs else np.zeros(0)
        move = np.exp(transitions)
        score = np.where(self.filled, np.exp(emissions[self.place]), 1.0)
        n = self.filled.shape[1]
        product = np.broadcast_to(np.eye(2)[:, :, None], (2, 2, n)).copy()
        for t in range(BLOCK):
            after = np.einsum("ijn,jk->ikn", product, move)
            after[:, 1] *= score[t]
            after /= after.max(axis=(0, 1))
            product = np.where(self.filled[t], after, product)
        left, right = self._across(product)
        forward, before = np.empty((BLOCK, 2, n)), np.empty((BLOCK, 2, n))
        scale = 0.0
        for t in range(BLOCK):
            before[t] = left
            after = move.T @ left
            after[1] *= score[t]
            total = after.sum(axis=0)
            if pairs:
                scale += np.log(total[self.filled[t]]).sum()
            left = np.where(self.filled[t], after / total, left)
            forward[t] = left
        probability = np.zeros(len(emissions))
        expected = np.zeros((2, 2))
        for t in range(BLOCK - 1, -1, -1):
            on = self.filled[t]
            joint = forward[t] * right
            probability[self.place[t][on]] = (joint[1] / joint.sum(axis=0))[on]
            ahead = right.copy()
            ahead[1] *= score[t]
            if pairs:
                pair = before[t][:, None] * move[:, :, None] * ahead[None]
                expected += (pair / pair.sum(axis=(0, 1)))[:, :, on].sum(axis=2)
            back = move @ ahead
            right = np.where(on, back / back.sum(axis=0), right)
        return (probability, expected, scale) if pairs else probability


def fit(chain, features, labels, rounds=60, penalty=1.0):
    """Weights of ``features`` (their emission and its gradient) and transitions, by L-BFGS of the log-likelihood.

    ``features`` has ``size``, ``emissions(weights)`` and ``gradient(residual)``.
    """
    labels = np.asarray(labels, np.int64)
    start = np.cumsum(chain.lengths) - chain.lengths
    previous = np.concatenate([[0], labels[:-1]]) if len(labels) else labels
    previous[start[chain.lengths > 0]] = 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (previous, labels), 1)

    def loss(x):
        weights, free = x[: features.size], np.concatenate([[0.0], x[features.size :]]).reshape(2, 2)
        emissions = features.emissions(weights)
        probability, expected, log_z = chain.marginals(emissions, free, pairs=True)
        value = log_z - emissions @ labels - (seen * free).sum() + 0.5 * penalty * (x @ x)
        slope = np.concatenate([features.gradient(probability - labels), (expected - seen).ravel()[1:]]) + penalty * x
        return value, slope

    x = minimized(loss, np.zeros(features.size + 3), rounds)
    return x[: features.size], np.concatenate([[0.0], x[features.size :]]).reshape(2, 2)


def minimized(loss, x, rounds, memory=8):
    """L-BFGS with backtracking."""
    value, slope = loss(x)
    history = []
    for _ in range(rounds):
        step, used = slope.copy(), []
        for s, y, rho in reversed(history):
            a = rho * (s @ step)
            step -= a * y
            used.append(a)
        if history:
            s, y, _ = history[-1]
            step *= (s @ y) / (y @ y)
        else:
            step /= max(1.0, np.abs(slope).sum())
        for (s, y, rho), a in zip(history, reversed(used), strict=True):
            step += s * (a - rho * (y @ step))
        rate, down = 1.0, slope @ step
        while True:
            new = x - rate * step
            new_value, new_slope = loss(new)
            if new_value <= value - 1e-4 * rate * down or rate < 1e-6:
                break
            rate *= 0.5
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            history = [*history[1 - memory :], (s, y, 1.0 / (s @ y))]
        done = abs(value - new_value) < 1e-5 * max(1.0, abs(value))
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x
