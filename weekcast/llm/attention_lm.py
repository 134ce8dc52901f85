"""A small causal self-attention model over subword ids, in numpy: training and scoring.

One attention layer reads the last ids and predicts the class of the next one; p(id) = p(class | context) *
p(id | class, last id), the second factor from corpus counts. Keys, queries and values depend on an id alone, and
position enters through a bias by distance, so scoring looks rows up and multiplies small batches.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import lru_cache

import numpy as np

#: Width, classes, and how far a scored id looks back: at least CONTEXT ids, at most CONTEXT + STRIDE - 1.
WIDTH, CLASSES, CONTEXT, STRIDE = 16, 48, 16, 16
#: Ids with an embedding of their own; the others share their class's.
OWN = 4096
#: Ids in a training window, windows in a training batch, ids that scoring takes at a time.
WINDOW, BATCH, BLOCK = 32, 64, 4096
LEARNING_RATE = 0.01
#: Exponents up to this size need no shift by the largest one.
SAFE = 30.0
#: Weight of a class's own shares against the counted pairs.
PAIR_PRIOR = 4.0


@dataclass
class Parameters:
    embed: np.ndarray  # [OWN + CLASSES, WIDTH]
    query: np.ndarray  # [WIDTH, WIDTH]
    key: np.ndarray
    value: np.ndarray
    distance: np.ndarray  # [WINDOW] bias of attention by distance
    out: np.ndarray  # [WIDTH, CLASSES] from what attention gathers
    direct: np.ndarray  # [WIDTH, CLASSES] from the last id itself
    bias: np.ndarray  # [CLASSES]

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    @classmethod
    def shaped(cls, flat: np.ndarray) -> "Parameters":
        shapes = [(OWN + CLASSES, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (WINDOW,), (WIDTH, CLASSES), (WIDTH, CLASSES), (CLASSES,)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return cls(*(flat[e - int(np.prod(s)) : e].reshape(s) for e, s in zip(ends, shapes)))

    @classmethod
    def initial(cls, class_log: np.ndarray, seed: int = 7) -> "Parameters":
        """Random but for the class bias: untrained, the model is the class unigram."""
        rng = np.random.default_rng(seed)
        near = lambda *shape: rng.normal(scale=0.3, size=shape)
        return cls(near(OWN + CLASSES, WIDTH), near(WIDTH, WIDTH), near(WIDTH, WIDTH), near(WIDTH, WIDTH), np.zeros(WINDOW), np.zeros((WIDTH, CLASSES)), np.zeros((WIDTH, CLASSES)), class_log.copy())


@dataclass
class Vocabulary:
    """What the corpus counts say about ids."""

    class_of: np.ndarray  # id to class
    kind_of: np.ndarray  # id to embedding row
    within: np.ndarray  # id to p(id | class)
    class_log: np.ndarray  # log p(class)
    pairs: np.ndarray  # sorted keys last * size + id of the pairs that are counted
    pair_counts: np.ndarray

    def given_last(self) -> np.ndarray:
        """Counted pairs of each last id with each class."""
        size = len(self.class_of)
        out = np.zeros((size, CLASSES), np.float32)
        np.add.at(out, (self.pairs // size, self.class_of[self.pairs % size]), self.pair_counts)
        return out


def cluster(sketch: np.ndarray, counts: np.ndarray, groups: np.ndarray, per_group: int, steps: int = 12) -> np.ndarray:
    """A cluster number for each id: weighted k-means of `sketch` rows within each group; -1 in no group.

    Ids that the sketch has not seen are spread by their number."""
    out = np.full(len(counts), -1)
    for group in range(groups.max() + 1):
        mine = np.flatnonzero(groups == group)
        seen = mine[np.abs(sketch[mine]).sum(axis=1) > 0]
        out[mine] = group * per_group + mine % per_group
        if len(seen) <= per_group:
            continue
        x = sketch[seen] / np.linalg.norm(sketch[seen], axis=1, keepdims=True)
        weight = counts[seen] + 1e-3
        # start spread over the ids by weight: the heaviest id first, then whatever is farthest from all starts
        starts = [int(np.argmax(weight))]
        gap = ((x - x[starts[0]]) ** 2).sum(axis=1)
        while len(starts) < per_group:
            starts.append(int(np.argmax(gap * np.sqrt(weight))))
            gap = np.minimum(gap, ((x - x[starts[-1]]) ** 2).sum(axis=1))
        center = x[starts]
        for _ in range(steps):
            near = np.argmax(x @ center.T - (center**2).sum(axis=1) / 2, axis=1)
            for k in range(per_group):
                if (near == k).any():
                    center[k] = np.average(x[near == k], axis=0, weights=weight[near == k])
        out[seen] = group * per_group + near
    return out


def vocabulary(counts: np.ndarray, sketch: np.ndarray, starts_word: np.ndarray, end: int, pairs: np.ndarray, pair_counts: np.ndarray) -> Vocabulary:
    """Classes (word starts and continuations apart, the end alone in the last), embedding rows, id shares."""
    groups = np.where(starts_word, 0, 1)
    groups[end] = -1
    per_group = (CLASSES - 1) // 2
    class_of = cluster(sketch, counts, groups, per_group)
    class_of[end] = CLASSES - 1
    smooth = counts + 0.5  # every id has mass, so every text has a probability
    mass = np.bincount(class_of, weights=smooth, minlength=CLASSES)
    kind_of = OWN + class_of
    heavy = np.lexsort((np.arange(len(counts)), -counts))[:OWN]
    kind_of[heavy] = np.arange(len(heavy))
    return Vocabulary(class_of, kind_of, smooth / mass[class_of], np.log(np.maximum(mass, 0.5) / mass.sum()), pairs, pair_counts)


@lru_cache(maxsize=4)
def _places(rows: int) -> np.ndarray:
    """Where the numbers of each embedding row lie."""
    return np.arange(rows * WIDTH).reshape(rows, WIDTH)


@lru_cache(maxsize=4)
def _gaps(length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far each id of a window (rows) is behind each other one (columns), and whether it sees that one."""
    gap = np.arange(length)[:, None] - np.arange(length)[None, :]
    return np.maximum(gap, 0), gap >= 0


def loss_and_gradient(p: Parameters, kinds: np.ndarray, goals: np.ndarray) -> tuple[float, Parameters]:
    """Summed cross entropy of the goals (class numbers, -1 for none) after each of `kinds` (batch, length).

    Attention is linear in what it looks at, so it gathers embeddings, and query and key, value and out meet once in
    their products. Its weights stay undivided: a column of ones gathers their sum, which divides the small arrays."""
    n, length = kinds.shape
    kind, many = kinds.ravel(), n * length
    e = p.embed.take(kind, axis=0)
    cut = lambda x: x.reshape(n, length, -1)
    flat = lambda x: x.reshape(many, -1)
    turned = lambda x: x.transpose(0, 2, 1)
    scale = WIDTH**-0.5  # Python numbers keep single precision single
    meet = (p.query * scale) @ p.key.T
    mix = np.concatenate([p.value @ p.out, p.direct, p.bias[None]])
    gap, sees = _gaps(length)
    seen = np.empty((many, 2 * WIDTH + 1), e.dtype)  # what attention gathers, the id's own embedding, one
    seen[:, WIDTH:-1], seen[:, -1] = e, 1
    own, asks = cut(seen)[:, :, WIDTH:], e @ meet
    a = cut(asks) @ turned(cut(e))  # (batch, query, key)
    near = p.distance[gap]
    if max(a.max(), -a.min()) < SAFE and np.abs(near).max() < SAFE:
        np.exp(a, out=a)
        a *= np.where(sees, np.exp(near), 0)
    else:
        a += np.where(sees, near, -np.inf)
        a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
    gathered = flat(a @ own)
    part = 1 / gathered[:, -1:]
    c = gathered[:, :-1] * part
    seen[:, :WIDTH] = c
    z = seen @ mix
    if max(z.max(), -z.min()) >= SAFE:
        z -= z.max(axis=1, keepdims=True)
    known = goals.ravel() >= 0
    place = np.arange(0, many * CLASSES, CLASSES) + np.maximum(goals.ravel(), 0)
    hit = z.ravel()[place]
    dz = np.exp(z, out=z)
    total = dz @ np.ones(CLASSES, dz.dtype)
    loss = -float((hit - np.log(total))[known].sum())
    dz *= (known / total)[:, None]
    dz.ravel()[place] -= known
    back = dz @ mix[:-1].T
    dc = np.empty_like(gathered)
    np.multiply(back[:, :WIDTH], part, out=dc[:, :-1])
    np.negative(np.einsum("ij,ij->i", c, dc[:, :-1]), out=dc[:, -1])
    ds = cut(dc) @ turned(own)
    ds *= a
    dasks = flat(ds @ cut(e))
    de = dasks @ meet.T
    de += back[:, WIDTH:]
    de += flat(turned(a) @ cut(dc)[:, :, :-1])
    de += flat(turned(ds) @ cut(asks))
    embed = np.bincount(_places(len(p.embed)).take(kind, axis=0).ravel(), weights=de.ravel(), minlength=p.embed.size).reshape(p.embed.shape)
    distance = np.bincount(gap[sees], weights=ds.sum(axis=0)[sees], minlength=WINDOW)[:WINDOW]
    dmeet, dmix = e.T @ dasks * scale, seen.T @ dz
    return loss, Parameters(embed, dmeet @ p.key, dmeet.T @ p.query, dmix[:WIDTH] @ p.out.T, distance, p.value.T @ dmix[:WIDTH], dmix[WIDTH:-1], dmix[-1])


class Trainer:
    """Adam in single precision over windows of WINDOW + 1 ids (-1 behind the last), as they come."""

    def __init__(self, p: Parameters, words: Vocabulary, rate: float = LEARNING_RATE):
        self.words, self.rate, self.step = words, rate, 0
        self.numbers = p.flat().astype(np.float32)
        self.mean, self.spread = np.zeros_like(self.numbers), np.zeros_like(self.numbers)

    def learn(self, windows: np.ndarray) -> None:
        words, mean, spread = self.words, self.mean, self.spread
        ids = np.maximum(windows, 0)
        kinds, goals = words.kind_of.take(ids[:, :-1]), np.where(windows[:, 1:] >= 0, words.class_of.take(ids[:, 1:]), -1)
        g, many = np.empty_like(mean), np.count_nonzero(goals >= 0, axis=1)
        for at in range(0, len(windows), BATCH):
            _, own = loss_and_gradient(Parameters.shaped(self.numbers), kinds[at : at + BATCH], goals[at : at + BATCH])
            np.concatenate([getattr(own, f.name).ravel() for f in fields(own)], out=g, casting="same_kind")
            g /= max(1, int(many[at : at + BATCH].sum()))
            self.step += 1
            g *= 0.1
            g += 1e-30  # nothing decays to subnormal numbers, which are slow
            mean *= 0.9
            mean += g
            g *= g  # 0.01 g g
            g += 1e-30
            spread *= 0.99
            spread += g
            np.sqrt(spread, out=g)
            g *= (1 - 0.99**self.step) ** -0.5
            g += 1e-8
            np.divide(mean, g, out=g)
            g *= self.rate / (1 - 0.9**self.step)
            self.numbers -= g

    def parameters(self) -> Parameters:
        return Parameters.shaped(self.numbers.astype(float))


def train(p: Parameters, windows: np.ndarray, words: Vocabulary, rate: float = LEARNING_RATE) -> Parameters:
    """One pass over windows."""
    trainer = Trainer(p, words, rate)
    trainer.learn(windows)
    return trainer.parameters()


class Scorer:
    """Log probabilities of id streams, block by block in single precision."""

    def __init__(self, p: Parameters, words: Vocabulary, end: int):
        self.end = end
        single = lambda x: np.ascontiguousarray(x, dtype=np.float32)
        e = p.embed[words.kind_of]
        self.words, self.given_last = words, words.given_last()
        # as in training: query and key, value and out meet in their products, a column of ones sums the weights
        self.asks, self.own = single(e @ (p.query / np.sqrt(WIDTH)) @ p.key.T), single(np.column_stack([e, np.ones(len(e))]))
        self.direct, self.mix = single(e @ p.direct + p.bias), single(p.value @ p.out)
        # a class without ids has no share
        self.direct[:, np.bincount(words.class_of, minlength=CLASSES) == 0] = -1e9
        gap = np.arange(STRIDE)[:, None] + CONTEXT - np.arange(CONTEXT + STRIDE)[None, :]
        self.near = single(np.where(gap >= 0, np.exp(p.distance[np.clip(gap, 0, WINDOW - 1)]), 0))

    def within(self, last: np.ndarray, goals: np.ndarray) -> np.ndarray:
        """p(goal | its class, last id): pair counts, smoothed by PAIR_PRIOR times the class's own shares."""
        words = self.words
        counted = self.given_last[last, words.class_of[goals]].astype(float)
        pair = np.zeros(len(goals))
        some = np.flatnonzero(counted > 0)
        if len(some):
            key = last[some].astype(np.int64) * len(words.class_of) + goals[some]
            at = np.minimum(np.searchsorted(words.pairs, key), len(words.pairs) - 1)
            pair[some] = np.where(words.pairs[at] == key, words.pair_counts[at], 0)
        return (pair + PAIR_PRIOR * words.within[goals]) / (counted + PAIR_PRIOR)

    def class_scores(self, ids: np.ndarray, goals: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log p(class of goals[i] | ids from starts[i] to i, the last CONTEXT to CONTEXT + STRIDE - 1 of them)
        for every i; with log(within(ids[i], goals[i])) added it is log p(goals[i] | ...).

        Windows of STRIDE scored ids overlap their left neighbours by CONTEXT ids, which are only looked at."""
        n = len(ids)
        out = np.empty(n)
        padded = -(-n // STRIDE) * STRIDE
        ids = np.concatenate([np.zeros(CONTEXT, ids.dtype), ids, np.zeros(padded - n, ids.dtype)])
        starts = np.concatenate([starts, np.full(padded - n, n)])
        for at in range(0, padded, BLOCK):
            size = min(BLOCK, padded - at)
            x = ids[at : at + size + CONTEXT]
            own, many = x[CONTEXT:], size // STRIDE
            seen = np.lib.stride_tricks.sliding_window_view(self.own.take(x, axis=0), CONTEXT + STRIDE, axis=0)[::STRIDE]  # [many, WIDTH + 1, CONTEXT + STRIDE]
            a = self.asks.take(own, axis=0).reshape(many, STRIDE, WIDTH) @ seen[:, :-1]
            np.minimum(a, 40, out=a)
            np.exp(a, out=a)
            a *= self.near
            first = at + np.arange(many) * STRIDE - CONTEXT
            begin = starts[at : at + size].reshape(many, STRIDE)
            cut = np.flatnonzero(begin.max(axis=1) > first)
            if len(cut):  # windows that see the end of another text
                place = first[cut, None] + np.arange(CONTEXT + STRIDE)
                a[cut] *= place[:, None, :] >= np.minimum(begin[cut], first[cut, None] + CONTEXT + np.arange(STRIDE))[:, :, None]
            h = (a @ seen.transpose(0, 2, 1)).reshape(size, WIDTH + 1)
            z = (h[:, :-1] / h[:, -1:]) @ self.mix
            z += self.direct.take(own, axis=0)
            np.clip(z, -40, 40, out=z)
            np.exp(z, out=z)
            upto = min(n, at + size) - at
            goal = goals[at : at + upto]
            hit = z[np.arange(upto), self.words.class_of[goal]].astype(float)
            out[at : at + upto] = np.log(hit / (z[:upto] @ np.ones(CLASSES, z.dtype)))
        return out
