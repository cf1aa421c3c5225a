"""Language-model scores of texts by causal self-attention over subword ids.

A text is its words, A-Z in lower case, each encoded with the space before it by a public byte-level
vocabulary, then one end id.  Ids fall into classes and classes into groups.  From a window of ids one
causal self-attention layer and one hidden layer predict the group of the next id and its class within
the group, on top of how often each follows the last id in all training texts; an id's probability
within its class comes from how often it follows the last id there, smoothed by its share of the class.
Classes and input vectors come from which ids stand next to each other.

All pairs of neighbouring ids and all words of the training texts are counted.  Weights are trained in
numpy: from a warm start on the driver, then on every id of every training text, in tasks whose weights
are averaged.  A window is half context, half ids that it scores; windows overlap by half, so each id is
predicted once in a pass of training, and scored once, with CONTEXT - STRIDE ids before it at least.
"""

from __future__ import annotations

import base64
import math
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versionlog.llm.common import sliced, small_batches, stored

#: Ids of a window (a multiple of the stride), and how many at its end are scored by it.
CONTEXT, STRIDE = 32, 16
#: Size of the input vectors and of the hidden layer; groups of classes, and classes of a group at most.
DIM, HIDDEN, GROUPS, MEMBERS = 16, 32, 16, 16
CLASSES = GROUPS * MEMBERS
#: Weights of the network.
SHAPES = {
    "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "near": (CONTEXT,), "w1": (2 * DIM, HIDDEN), "b1": (HIDDEN,),
    "w2": (HIDDEN, GROUPS), "b2": (GROUPS,), "w3": (GROUPS, HIDDEN, MEMBERS), "b3": (GROUPS, MEMBERS)}
#: Windows of a training step; windows scored together; training texts and ids of each that the warm start reads.
STEP, BATCH, WARM, WARM_IDS = 256, 384, 4096, 192
#: Learning rates of the warm start and of the pass over all training texts; steps of the warm start at least.
WARM_RATE, RATE, WARM_STEPS = 0.01, 0.006, 2000
#: What smooths the counts of a pair and of a class after an id.
DISCOUNT, WITHIN, BEFORE = 0.5, 2.0, 50.0
#: Words encoded together; words or pairs that are counted together, and counts that a worker holds.
RUN_WORDS, RAW, KINDS = 50_000, 1 << 20, 1 << 20
#: The most frequent ids, whose neighbours shape classes and input vectors.
COLUMNS = 256
#: Pairs, and words, whose counts are broadcast, the most frequent ones (some 16 MB each); others are joined.
PAIRS, COMMON_WORDS = 1_000_000, 400_000
#: Rows of weights that meet on the driver at most.
MEETINGS = 256
END = 50_256
SIZE = END + 1
#: White space of the pattern that is no white space between words.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
#: The rest of the pattern, for white space that no word follows at once.
SPACES = r"|\s+(?!\S)|\s+"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


class SubwordIds:
    """Ids of words, each with the space before it."""

    def __init__(self, ranks_file: str):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("ranks", pat_str=PATTERN + SPACES, mergeable_ranks=ranks, special_tokens={})
        # Where single spaces stand before words only, PATTERN alone takes all, without looking ahead.
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def begins(self) -> np.ndarray:
        """Whether an id begins a word, or is the end."""
        return np.array([i == END or self.model.decode_single_token_bytes(i)[:1] == b" " for i in range(SIZE)])

    def ids(self, every: list[bytes]) -> np.ndarray:
        """The end id, the ids of the words, and the end id; long texts in runs of words."""
        out = [[END]]
        for a in range(0, len(every), RUN_WORDS):
            run = every[a : a + RUN_WORDS]
            joined = (b" " + b" ".join(run)).decode()
            # White space within words could draw the next word's space into an id.
            odd = not (joined.isascii() and joined.isprintable()) and ODD_SPACE.search(joined)
            out += [self.model.encode_ordinary(" " + w.decode()) for w in run] if odd else [self.plain.encode_ordinary(joined)]
        return np.concatenate([np.array(x, dtype=np.uint16) for x in [*out, [END]]])


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first id, 64-bit hash) of every word and every end id of the ids of texts.

    Ids give back the word's bytes, so words differ where their ids do.
    """
    first = np.flatnonzero(begins[ids])
    place = np.arange(len(ids)) - np.repeat(first, np.diff(first, append=len(ids)))
    h = _mixed((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return first, _mixed(np.add.reduceat(h, first)) if len(first) else h


class Lookup:
    """Numbers by integer key, in open addressing with half of the slots filled at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.empty, self.shift, self.mask = np.iinfo(keys.dtype).max, np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, self.empty, dtype=keys.dtype), np.zeros(1 << bits, dtype=values.dtype)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):  # of those that want a free slot one gets it, the others try the next
            free = self.keys[slot] == self.empty
            self.keys[slot[free]], self.values[slot[free]] = keys[left[free]], values[left[free]]
            lost = self.keys[slot] != keys[left]
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value of each key, places of keys that are not held)."""
        slot = self._slot(keys)
        out, met = self.values[slot], self.keys[slot]
        todo, new = np.flatnonzero(met != keys), []
        while len(todo):
            empty = met[todo] == self.empty
            new.append(todo[empty])
            todo = todo[~empty]
            slot[todo] = (slot[todo] + 1) & self.mask
            met[todo], out[todo] = self.keys[slot[todo]], self.values[slot[todo]]
            todo = todo[met[todo] != keys[todo]]
        return out, np.concatenate(new) if new else todo


def grid(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat, owner, valid): texts laid out in blocks of STRIDE, each after end ids as its first context.

    Window j reads flat[j * STRIDE :][:CONTEXT] and scores the STRIDE ids from its last block on, shifted
    by one; the first valid[j] of them are ids of text owner[j].  Where a text ends in the middle of a
    block or before another one, the rest are end ids that nobody scores.
    """
    lead = (CONTEXT - STRIDE) // STRIDE
    n = lengths - 1  # the first id is context only
    blocks = lead - (-n // STRIDE)
    begin = np.cumsum(blocks) - blocks
    flat = np.full((int(blocks.sum()) + lead) * STRIDE + 1, END, dtype=np.uint16)
    flat[np.repeat((begin + lead) * STRIDE - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(ids))] = ids
    owner = np.repeat(np.arange(len(lengths)), blocks)
    valid = np.clip(n[owner] - (np.arange(len(owner)) - begin[owner]) * STRIDE, 0, STRIDE)
    return flat, owner, valid


class Tables:
    """What the training texts' counts give: classes, vectors, priors, and counts of pairs.

    ``group``, ``member``: of each id.  ``row``: an id's row in the tables by last id; ids that never
    stood before another share one.  ``first``, ``second``: log probability of each group after the last
    id, and of each class in its group.  ``log_left``: what the smoothing leaves to a class's share after
    the last id; ``total``: how often the class follows it, unless all pairs are held.  ``held``: log
    probability within the class by pair.
    """

    def __init__(self, klass: np.ndarray, vectors: np.ndarray, counts: np.ndarray, classes: np.ndarray, pairs: np.ndarray, often: np.ndarray, complete: bool):
        """``classes``: rows (last id, class, how often, different ids); ``pairs`` with ``often``: those to hold, ``complete`` if these are all."""
        self.group, self.member, self.vectors, self.complete = (klass // MEMBERS).astype(np.uint8), (klass % MEMBERS).astype(np.uint8), vectors, complete
        mass = counts + 0.02
        of_class = np.bincount(klass, weights=mass, minlength=CLASSES)
        self.log_share = np.log(mass / of_class[klass]).astype(np.float32)
        last = np.unique(classes[:, 0]).astype(np.int64)
        self.row = np.zeros(SIZE, dtype=np.int32)
        self.row[last] = np.arange(1, len(last) + 1)
        total, kinds = (np.zeros((len(last) + 1, CLASSES), dtype=np.float32) for _ in range(2))
        at = self.row[classes[:, 0].astype(np.int64)], classes[:, 1].astype(np.int64)
        total[at], kinds[at] = classes[:, 2], classes[:, 3]
        self.log_left = np.log((WITHIN + DISCOUNT * kinds) / (total + np.float32(WITHIN))).astype(np.float16)
        self.total = total
        prior = (total + BEFORE * (of_class / of_class.sum()).astype(np.float32)).reshape(-1, GROUPS, MEMBERS)
        by_group = prior.sum(axis=2)
        self.first = np.log(np.maximum(by_group / by_group.sum(axis=1, keepdims=True), 1e-30)).astype(np.float32)
        used = (of_class > 0).reshape(GROUPS, MEMBERS)
        self.second = np.where(used, np.log(np.maximum(prior / np.maximum(by_group, 1e-30)[:, :, None], 1e-20)), -6e4).astype(np.float32).reshape(-1, MEMBERS)
        self._hold(pairs, often, klass)
        if complete:
            self.total = None

    def _hold(self, pairs: np.ndarray, often: np.ndarray, klass: np.ndarray) -> None:
        a, b = pairs // SIZE, pairs % SIZE
        value = np.log(np.maximum(often - DISCOUNT, 0) / (self.total[self.row[a], klass[b]] + WITHIN) + np.exp(self.log_low(a, b)))
        self.held = Lookup(pairs.astype(np.uint32), value.astype(np.float32))

    def log_low(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Log of the part of an id's probability in its class that its share of the class gives."""
        return self.log_left[self.row[before], self.group[ids].astype(np.int64) * MEMBERS + self.member[ids]].astype(np.float32) + self.log_share[ids]

    def log_within(self, before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each id given its class and the id before it, places of pairs that are not held)."""
        out, new = self.held(before.astype(np.uint32) * np.uint32(SIZE) + ids)
        out[new] = self.log_low(before[new], ids[new])
        return out, new


#: How far before each scored place each place of a window is; places ahead have none.
GAP = np.arange(CONTEXT - STRIDE, CONTEXT)[:, None] - np.arange(CONTEXT)[None, :]


def _biases(near: np.ndarray) -> np.ndarray:
    """What nearness adds to an attention score; places ahead are masked."""
    return np.where(GAP < 0, near.dtype.type(-1e4), near[np.maximum(GAP, 0)])


class AttentionModel:
    """``p``: trained weights over the counts of ``tables``, views of one vector ``flat``."""

    def __init__(self, flat: np.ndarray, tables: Tables):
        self.flat, self.tables, self.p, at = flat, tables, {}, 0
        for k, shape in SHAPES.items():
            size = math.prod(shape)
            self.p[k] = flat[at : at + size].reshape(shape)
            at += size
        self.m, self.v, self.steps = np.zeros_like(flat), np.zeros_like(flat), 0

    @staticmethod
    def fresh(seed: int = 8) -> np.ndarray:
        """Weights that leave predictions to the counts."""
        rng = np.random.default_rng(seed)
        drawn = {k: rng.standard_normal(SHAPES[k]) / math.sqrt(SHAPES[k][0]) for k in ("q", "k", "v", "w1")}
        return np.concatenate([drawn.get(k, np.zeros(shape)).reshape(-1) for k, shape in SHAPES.items()]).astype(np.float32)

    def _folded(self) -> tuple[np.ndarray, np.ndarray]:
        """What makes queries that meet input vectors in place of keys, and what makes the hidden layer of an
        input vector and attended input vectors.

        Queries and keys are linear in the vectors, as are values and what the hidden layer takes from them, so
        either two products are one matrix, and no place needs a key or value of its own.
        """
        p = self.p
        return p["q"] @ p["k"].T * p["q"].dtype.type(1 / math.sqrt(DIM)), np.concatenate([p["w1"][:DIM], p["v"] @ p["w1"][DIM:]])

    def _attended(self, q: np.ndarray, across: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(exponentials of the attention scores, their reciprocal sums, attended input vectors) of windows of
        queries and input vectors; ``across``: the vectors as columns."""
        a = q @ across
        a += _biases(self.p["near"])
        np.minimum(a, 30, out=a)
        np.exp(a, out=a)
        return a, 1 / (a.reshape(-1, CONTEXT) @ np.ones((CONTEXT, 1), dtype=a.dtype)), (a @ x).reshape(-1, DIM)

    def hidden(self, w: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The hidden layer at every scored place of the windows ``w``, and what led to it."""
        p, n = self.p, len(w)
        x = np.take(self.tables.vectors, w, axis=0)
        both = np.empty((n * STRIDE, 2 * DIM), dtype=x.dtype)
        own, across, (qk, w) = x[:, CONTEXT - STRIDE :].reshape(-1, DIM), np.ascontiguousarray(x.swapaxes(1, 2)), self._folded()
        both[:, :DIM] = own
        a, share, o = self._attended((own @ qk).reshape(n, STRIDE, DIM), across, x)
        np.multiply(o, share, out=both[:, DIM:])
        h = both @ w
        h += p["b1"]
        np.tanh(h, out=h)
        return h, {"x": x, "across": across, "own": own, "a": a, "share": share, "both": both, "w": w}

    def for_scoring(self) -> None:
        """Works out what an id is as query and own part of the hidden layer, once for all its places."""
        p, x, (qk, w) = self.p, self.tables.vectors, self._folded()
        self.qs, self.of_own, self.of_attended = x @ qk, x @ w[:DIM] + p["b1"], w[DIM:]
        self.first = self.tables.first + p["b2"]
        self.second = (self.tables.second.reshape(-1, GROUPS, MEMBERS) + p["b3"]).reshape(-1, MEMBERS)

    def hidden_of(self, slab: np.ndarray) -> np.ndarray:
        """The hidden layer at every place that the windows over ``slab`` score, with tables ``for_scoring``."""
        n, own = (len(slab) - CONTEXT) // STRIDE + 1, slab[CONTEXT - STRIDE :]
        x = np.take(self.tables.vectors, slab, axis=0)
        # Windows overlap, so theirs are views of the slab's vectors.
        x = np.lib.stride_tricks.as_strided(x, (n, CONTEXT, DIM), (STRIDE * x.strides[0], *x.strides), writeable=False)
        _, share, o = self._attended(np.take(self.qs, own, axis=0).reshape(n, STRIDE, DIM), np.ascontiguousarray(x.swapaxes(1, 2)), x)
        o *= share
        h = o @ self.of_attended
        h += np.take(self.of_own, own, axis=0)
        return np.tanh(h, out=h)

    def _outer(self, h: np.ndarray, row: np.ndarray, first: np.ndarray, bias: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of the groups' logits, and their sums; ``first`` has the bias already if it is not given."""
        z = h @ self.p["w2"]
        z += np.take(first, row, axis=0)
        if bias is not None:
            z += bias
        return _exponentials(z)

    def _inner(self, h: np.ndarray, row: np.ndarray, group: np.ndarray, second: np.ndarray, bias: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For places in the order of their targets' groups, whose bounds are given: exponentials of the logits of the group's classes, and their sums."""
        bounds = np.searchsorted(group, np.arange(GROUPS + 1))
        z = np.empty((len(h), MEMBERS), dtype=h.dtype)
        for g in range(GROUPS):
            np.matmul(h[bounds[g] : bounds[g + 1]], self.p["w3"][g], out=z[bounds[g] : bounds[g + 1]])
        z += np.take(second, row * GROUPS + group, axis=0)
        if bias is not None:
            z += np.take(bias, group, axis=0)
        return *_exponentials(z), bounds

    def log_classes(self, slab: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Log probability of the class of each target of the windows over ``slab``."""
        h = self.hidden_of(slab)
        row, group, member, every = self.tables.row[slab[CONTEXT - STRIDE :]], self.tables.group[targets], self.tables.member[targets], np.arange(len(h))
        e, total = self._outer(h, row, self.first)
        out = e[every, group] / total
        order = np.argsort(group, kind="stable")
        e, total, _ = self._inner(np.take(h, order, axis=0), row[order], group[order], self.second)
        out[order] *= e[every, member[order]] / total
        return np.log(np.maximum(out, 1e-35, out=out), out=out)

    def gradients(self, w: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted loss of the classes of what the windows ``w`` predict, and its gradients as one vector."""
        p, n = self.p, len(w)
        h, m = self.hidden(w)
        row, group, member, every = self.tables.row[w[:, CONTEXT - STRIDE :].reshape(-1)], self.tables.group[targets], self.tables.member[targets], np.arange(len(h))
        z, total = self._outer(h, row, self.tables.first, p["b2"])
        loss = np.log(z[every, group] / total) @ weight
        z *= (weight / total)[:, None]
        z[every, group] -= weight
        d = {"w2": h.T @ z, "b2": _sums(z), "w3": np.zeros_like(p["w3"]), "b3": np.zeros_like(p["b3"])}
        dh = z @ p["w2"].T
        order = np.argsort(group, kind="stable")
        hs, ws, member = np.take(h, order, axis=0), weight[order], member[order]
        z, total, bounds = self._inner(hs, row[order], group[order], self.tables.second, p["b3"])
        loss += np.log(z[every, member] / total) @ ws
        z *= (ws / total)[:, None]
        z[every, member] -= ws
        for g in range(GROUPS):
            a, b = bounds[g], bounds[g + 1]
            d["w3"][g], d["b3"][g] = hs[a:b].T @ z[a:b], _sums(z[a:b])
            np.matmul(z[a:b], p["w3"][g].T, out=hs[a:b])
        back = np.empty_like(order)
        back[order] = every
        dh += np.take(hs, back, axis=0)
        h *= h
        dh -= dh * h
        dw, d["b1"] = m["both"].T @ dh, _sums(dh)
        d["w1"], d["v"] = np.concatenate([dw[:DIM], p["v"].T @ dw[DIM:]]), dw[DIM:] @ p["w1"][DIM:].T
        do = dh @ m["w"][DIM:].T
        near = (do * m["both"][:, DIM:]) @ np.ones((DIM, 1), dtype=h.dtype)
        near *= m["share"]
        do *= m["share"]
        ds = do.reshape(n, STRIDE, DIM) @ m["across"]
        ds -= near.reshape(n, STRIDE, 1)
        ds *= m["a"]
        d["near"] = np.bincount(np.maximum(GAP, 0).reshape(-1), weights=(_sums(ds.reshape(n, -1)) * (GAP >= 0).reshape(-1)), minlength=CONTEXT).astype(h.dtype)
        dqk = m["own"].T @ (ds @ m["x"]).reshape(-1, DIM) * h.dtype.type(1 / math.sqrt(DIM))
        d["q"], d["k"] = dqk @ p["k"], dqk.T @ p["q"]
        return -float(loss), np.concatenate([d[k].reshape(-1) for k in SHAPES])

    def learn(self, ids: np.ndarray, lengths: np.ndarray, rate: float, last_rate: float) -> None:
        """Adam over all windows of the texts, in a seeded order; the rate falls evenly to ``last_rate``.

        Each id but the first of a text is predicted once, by the window that scores it.
        """
        flat, _, valid = grid(ids, lengths)
        every = np.lib.stride_tricks.sliding_window_view(flat, CONTEXT + 1)
        order = np.random.default_rng(self.steps).permutation(np.flatnonzero(valid))
        for a in range(0, len(order), STEP):
            at = order[a : a + STEP]
            weight = (np.arange(STRIDE) < valid[at][:, None]).reshape(-1).astype(np.float32)
            w = every[at * STRIDE]
            _, g = self.gradients(w[:, :-1], w[:, CONTEXT - STRIDE + 1 :].reshape(-1), weight / weight.sum())
            lr = rate + (last_rate - rate) * a / len(order)
            self.steps += 1
            self.m += np.float32(0.1) * (g - self.m)
            self.v += np.float32(0.01) * (g * g - self.v)
            self.flat -= np.float32(lr / (1 - 0.9**self.steps)) * self.m / (np.sqrt(self.v * np.float32(1 / (1 - 0.99**self.steps))) + np.float32(1e-8))

    def score(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability of each text's ids after its first, texts and pairs of ids whose count within the class is not held).

        What is not held counts as if it had never occurred; each such place is listed.
        """
        flat, owner, valid = grid(ids, lengths)
        out = np.zeros(len(lengths))
        texts, pairs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for a in range(0, len(valid), BATCH):
            n = min(BATCH, len(valid) - a)
            slab = flat[a * STRIDE : (a + n - 1) * STRIDE + CONTEXT]
            before, targets = slab[CONTEXT - STRIDE :], flat[a * STRIDE + CONTEXT - STRIDE + 1 :][: n * STRIDE]
            logp, new = self.tables.log_within(before, targets)
            logp += self.log_classes(slab, targets)
            mine = np.arange(STRIDE) < valid[a : a + n, None]
            logp *= mine.reshape(-1)
            out += np.bincount(owner[a : a + n], weights=logp.reshape(n, STRIDE) @ np.ones(STRIDE), minlength=len(out))
            if not self.tables.complete and len(new):
                new = new[mine.reshape(-1)[new]]
                texts.append(owner[a + new // STRIDE])
                pairs.append(before[new].astype(np.int64) * SIZE + targets[new])
        return out / math.log(10), np.concatenate(texts), np.concatenate(pairs)


def _sums(z: np.ndarray) -> np.ndarray:
    return np.ones(len(z), dtype=z.dtype) @ z


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    np.minimum(z, 60, out=z)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], dtype=z.dtype)


def classes_of(a: np.ndarray, b: np.ndarray, n: np.ndarray, counts: np.ndarray, top: np.ndarray, begins: np.ndarray, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(input vector, class) of every id, from how often ids stand next to the ids ``top``.

    ``a``, ``b``, ``n``: pairs of neighbours of which one is in ``top``.  Counts on either side are turned
    into positive mutual information, reduced by a randomised singular value decomposition, and
    clustered by k-means into groups, and each group into classes.  Ids that were not seen get a zero vector and
    are of the last class.
    """
    rng = np.random.default_rng(seed)
    column, row, seen = np.full(SIZE, -1), np.full(SIZE, -1), np.flatnonzero(counts)
    if not len(seen):
        return np.zeros((SIZE, DIM), dtype=np.float32), np.full(SIZE, CLASSES - 1)
    column[top], row[seen] = np.arange(len(top)), np.arange(len(seen))
    table = np.zeros((len(seen), 2 * len(top)), dtype=np.float32)
    for left, right, shift in ((a, b, 0), (b, a, len(top))):
        ok = (column[right] >= 0) & (row[left] >= 0)
        table[row[left[ok]], column[right[ok]] + shift] = n[ok]
    mass = table.sum(axis=1, keepdims=True) / max(1.0, float(table.sum()))
    table /= np.maximum(mass * table.sum(axis=0, keepdims=True), 1e-6)
    np.log1p(table, out=table)
    table *= np.sqrt(np.minimum(counts[seen], 50) / 50)[:, None].astype(np.float32)
    y = table @ rng.standard_normal((table.shape[1], DIM + 8)).astype(np.float32)
    for _ in range(3):
        y, _ = np.linalg.qr(y)
        y = table @ (table.T @ y)
    y, _ = np.linalg.qr(y)
    u, s, _ = np.linalg.svd(y.T @ table, full_matrices=False)
    x = np.zeros((len(seen), DIM), dtype=np.float32)
    size = min(DIM, len(s))
    x[:, :size] = (y @ u)[:, :size] * np.sqrt(s[:size])
    x /= np.sqrt((x**2).mean(axis=0)) + 1e-9
    x = np.clip(x, -4, 4).astype(np.float32)
    weight = np.sqrt(counts[seen]).astype(np.float32)
    place = np.column_stack([x, 2.0 * begins[seen], 0.3 * np.log1p(counts[seen])]).astype(np.float32)
    group = _clusters(place, weight, GROUPS)
    member = np.zeros(len(seen), dtype=np.int64)
    for g in range(GROUPS):
        at = np.flatnonzero(group == g)
        member[at] = _clusters(place[at], weight[at], MEMBERS - (g == GROUPS - 1))
    vectors, klass = np.zeros((SIZE, DIM), dtype=np.float32), np.full(SIZE, CLASSES - 1)
    vectors[seen], klass[seen] = x, group * MEMBERS + member
    return vectors, klass


def _clusters(points: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The cluster of each point by k-means of at most ``n`` clusters, begun at the heaviest points."""
    centre = points[np.argsort(-weight, kind="stable")[:n]].copy()
    if not len(centre):
        return np.zeros(0, dtype=np.int64)
    near = np.zeros(len(points), dtype=np.int64)
    for _ in range(15):
        near = ((centre**2).sum(axis=1)[None, :] - 2 * points @ centre.T).argmin(axis=1)
        mass = np.bincount(near, weights=weight, minlength=len(centre))
        for c in range(points.shape[1]):
            centre[:, c] = np.where(mass > 0, np.bincount(near, weights=weight * points[:, c], minlength=len(centre)) / np.maximum(mass, 1e-9), centre[:, c])
    return near


#: What a worker has built from what it was last sent, and that one's name.
_BUILT: dict[str, object] = {}


def _built(name: str, make: Callable[[], object]) -> object:
    """``make()``, once for all tasks of a worker with the same ``name``; what was built before is let go."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = make()
    return _BUILT[name]


def _words_of(ids: np.ndarray, lengths: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word and of the end of the texts."""
    first, h = word_hashes(ids, begins)
    text = np.repeat(np.arange(len(lengths)), lengths)[first]
    own = first != (np.cumsum(lengths) - lengths)[text]  # the first id of a text is context only
    return text[own], h[own].view(np.int64)


class _Counts:
    """How often each key occurs, as few rows as memory allows."""

    def __init__(self):
        self.raw, self.n_raw, self.keys, self.n = [], 0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.n_raw += len(keys)
        if self.n_raw >= RAW:
            self._merge()

    def _merge(self) -> None:
        if self.raw:
            k, n = np.unique(np.concatenate(self.raw), return_counts=True)
            both = np.concatenate([self.keys, k.astype(np.int64)])
            order = np.argsort(both, kind="stable")  # merges two sorted runs
            both, n = both[order], np.concatenate([self.n, n])[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            self.keys, self.n = both[first], np.add.reduceat(n, first)
        self.raw, self.n_raw = [], 0

    def full(self) -> bool:
        return len(self.keys) >= KINDS

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        out, self.keys, self.n = (self.keys, self.n), self.keys[:0], self.n[:0]
        return out


def corpus_pass(docs: DataFrame, learn: Column, ranks_file: str, text_col: str, keep: Sequence[str]) -> DataFrame:
    """Every document with its ids, and counts of words and of pairs of ids of training documents, in part.

    Rows of one table: documents have ``keep``, ``__learn`` and ``__ids``; counts have ``__word`` (a hash)
    or ``__pair``, and ``__n``.
    """
    read = docs.select(*keep, F.coalesce(learn, F.lit(False)).alias("__learn"), F.col(text_col).alias("__text"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in read.schema][:-1]).add("__ids", "binary").add("__word", "long").add("__pair", "long").add("__n", "long")
    n_kept, name = len(read.columns) - 1, uuid.uuid4().hex

    def make() -> tuple[SubwordIds, np.ndarray]:
        enc = SubwordIds(ranks_file)
        return enc, enc.begins()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, begins = _built(name, make)
        types, seen, pairs = [], _Counts(), _Counts()

        def rows(column: str, counts: _Counts) -> pa.RecordBatch:
            k, n = counts.taken()
            cols = {"__word": None, "__pair": None} | {column: k.astype(np.int64)}
            cols = [pa.nulls(len(n), t) for t in types] + [pa.nulls(len(n), pa.binary()), *(pa.nulls(len(n), pa.int64()) if x is None else pa.array(x) for x in cols.values()), pa.array(n, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        for b in sliced(it):
            types = [c.type for c in b.columns[:n_kept]]
            ids = [enc.ids(words(t)) for t in b.column(n_kept).to_pylist()]
            none = [pa.nulls(len(ids), pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*b.columns[:n_kept], pa.array([x.tobytes() for x in ids], pa.binary()), *none], names=schema.names)
            own = [x for x, mine in zip(ids, b.column(n_kept - 1).to_pylist(), strict=True) if mine]
            if own:
                seen.add(_words_of(np.concatenate(own), np.fromiter(map(len, own), dtype=np.int64), begins)[1])
                pairs.add(np.concatenate([x[:-1].astype(np.uint32) * np.uint32(SIZE) + x[1:] for x in own]))
            if pairs.full():
                yield rows("__pair", pairs)
            if seen.full():
                yield rows("__word", seen)
        if types:
            yield rows("__pair", pairs)
            yield rows("__word", seen)

    return read.mapInArrow(batches, schema)


def _ids_of(column: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts one after the other, and how many each has."""
    rows = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.uint16), np.fromiter((len(r) // 2 for r in rows), dtype=np.int64, count=len(rows))


def fit_model(corpus: DataFrame, pairs: DataFrame, ranks_file: str) -> AttentionModel:
    """The model of the training texts of a ``corpus_pass`` table whose pairs are counted by ``pairs(pair, n)``; with no text, one that knows nothing.

    The driver gets a row an id, a row per pair with one of the COLUMNS most frequent ids (26 million rows
    of 12 bytes at most, whatever the corpus), a row per id and class after it (13 million at most),
    PAIRS pairs, and what the warm start reads.
    """
    spark = corpus.sparkSession
    two = pairs.select(F.expr(f"cast(pair div {SIZE} as int)").alias("a"), (F.col("pair") % SIZE).cast("int").alias("b"), F.col("n").cast("float").alias("n"))
    counts = np.zeros(SIZE)
    for r in two.groupBy("b").agg(F.sum(F.col("n").cast("double")).alias("n")).collect():
        counts[r["b"]] = r["n"]
    top = np.argsort(-counts, kind="stable")[: min(COLUMNS, max(1, int((counts > 0).sum())))]
    near = two.filter(F.col("a").isin(top.tolist()) | F.col("b").isin(top.tolist())).toArrow()
    vectors, klass = classes_of(*(near.column(c).to_numpy() for c in ("a", "b", "n")), counts, top, SubwordIds(ranks_file).begins())
    del near
    of = F.broadcast(spark.createDataFrame(pa.table({"b": pa.array(np.arange(SIZE), pa.int32()), "c": pa.array(klass, pa.int32())})))
    rows = two.join(of, "b").groupBy("a", "c").agg(F.sum(F.col("n").cast("double")).cast("float").alias("n"), F.count(F.lit(1)).cast("float").alias("kinds")).toArrow()
    n_pairs = pairs.count()
    held = (pairs if n_pairs <= PAIRS else pairs.orderBy(F.desc("n"), "pair").limit(PAIRS)).select("pair", F.col("n").cast("float").alias("n")).toArrow()
    classes = np.column_stack([rows.column(c).to_numpy() for c in ("a", "c", "n", "kinds")])
    tables = Tables(klass, vectors, counts, classes, held.column("pair").to_numpy().astype(np.int64), held.column("n").to_numpy().astype(np.float64), n_pairs <= PAIRS)
    del rows, held, classes
    model = AttentionModel(AttentionModel.fresh(), tables)
    learned = corpus.filter("__learn and __ids is not null").select("__ids")
    place = F.pmod(F.xxhash64(F.lit(12), "__ids"), F.greatest(F.length("__ids") / 2 - WARM_IDS, F.lit(0)).cast("long") + 1)
    cut = F.substring("__ids", (2 * place + 1).cast("int"), F.lit(2 * WARM_IDS))
    drawn = learned.select(cut.alias("cut")).select("cut", F.xxhash64("cut").alias("by")).orderBy("by", "cut").limit(WARM).collect()
    if not drawn:
        return model
    ids, lengths = _ids_of([bytes(r["cut"]) for r in drawn])
    rounds = max(2, WARM_STEPS * STEP * STRIDE // len(ids))
    for i in range(rounds):
        model.learn(ids, lengths, WARM_RATE * (1 - i / rounds), WARM_RATE * (1 - (i + 1) / rounds))
    return AttentionModel(_trained_on_all(learned, model), tables)


def _trained_on_all(learned: DataFrame, model: AttentionModel) -> np.ndarray:
    """The weights after a pass of every task over all its texts, averaged by ids.

    Weights of tasks are summed in MEETINGS groups, so that the driver gets no more rows than that.
    """
    shared = learned.sparkSession.sparkContext.broadcast((model.flat, model.tables))

    def train(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _BUILT.clear()
        flat, tables = shared.value
        own, n = AttentionModel(flat.copy(), tables), 0
        for b in sliced(it):
            ids, lengths = _ids_of(b.column(0))
            own.learn(ids, lengths, RATE, RATE / 10)
            n += len(ids)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([own.flat.tobytes()], pa.binary())], names=["n", "p"])

    def total(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, p = 0, 0.0
        for b in it:
            for k, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, p = n + k, p + k * np.frombuffer(row, dtype=np.float32).astype(np.float64)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([p.tobytes()], pa.binary())], names=["n", "p"])

    with small_batches(learned.sparkSession):
        each = stored(learned.mapInArrow(train, "n long, p binary"), "weights")
        got = each.coalesce(MEETINGS).mapInArrow(total, "n long, p binary").collect()
    shared.unpersist()
    n = sum(r["n"] for r in got)
    return (sum(np.frombuffer(r["p"], dtype=np.float64) for r in got) / n).astype(np.float32)


def _lists(texts: np.ndarray, n: int, **columns: np.ndarray) -> pa.Array:
    """For each of ``n`` texts the structs of its rows, which stand in the order of their texts."""
    offsets = np.searchsorted(texts, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], names=list(columns)))


class _Scorer:
    """Scores slices of texts from what was broadcast: weights, tables, and hashes and counts of common words."""

    def __init__(self, flat: np.ndarray, tables: Tables, known: np.ndarray, often: np.ndarray, begins: np.ndarray):
        self.model, self.begins = AttentionModel(flat, tables), begins
        self.model.for_scoring()
        self.logs = Lookup(known, np.log10(often + 1))

    def __call__(self, rows: list[bytes]) -> list[pa.Array]:
        """Per text: words and end, how many of them are common, their log10 counts, the score, and what is to be joined."""
        (ids, lengths), n = _ids_of(rows), len(rows)
        text, h = _words_of(ids, lengths, self.begins)
        log, rare = self.logs(h)
        log[rare] = 0
        size, seen = np.bincount(text, minlength=n), np.bincount(np.delete(text, rare), minlength=n)
        (rt, rh), rk = _distinct(text[rare], h[rare])
        score, owner, pair = self.model.score(ids, lengths)
        (pt, pp), pk = _distinct(owner, pair)
        a, b, t = pp // SIZE, pp % SIZE, self.model.tables
        lows = t.log_low(a, b).astype(np.float64)
        total = t.total[t.row[a], t.group[b].astype(np.int64) * MEMBERS + t.member[b]] + WITHIN if len(pp) else lows
        score -= np.bincount(pt, weights=pk * lows / math.log(10), minlength=n)  # the join adds these
        return [
            pa.array(size.astype(np.int64)), pa.array(seen.astype(np.int64)), pa.array(np.bincount(text, weights=log, minlength=n)), pa.array(score),
            _lists(rt, n, word=rh, k=rk), _lists(pt, n, pair=pp, k=pk, total=total.astype(np.float64), low=np.exp(lows))]


def _distinct(texts: np.ndarray, keys: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Different keys of each text in order, and how often each occurs."""
    order = np.lexsort((keys, texts))
    texts, keys = texts[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (texts[1:] != texts[:-1]) | (keys[1:] != keys[:-1])])) if len(keys) else np.zeros(0, dtype=np.int64)
    return (texts[first], keys[first]), np.diff(first, append=len(keys))


def score_texts(docs: DataFrame, learn: Column, ranks_file: str, id_col: str = "doc_id", text_col: str = "text", extra: Sequence[str] = ()) -> DataFrame:
    """``(id, *extra, n_tokens, n_known, train_tokens, base_score, score)`` of every whole text.

    ``learn`` says which rows are training documents.  ``base_score`` is the add-one unigram score of
    the words and the end; ``score`` the model's log10 probability of the same text as subword ids.
    Null and empty texts are the end alone.  Repeated rows are scored alike, and count as often as
    they occur; an empty table gives no rows; other columns are not read.  Words are told apart by
    64-bit hashes of their ids.
    """
    spark = docs.sparkSession
    keep = [id_col, *extra]
    with small_batches(spark):
        corpus = stored(corpus_pass(docs, learn, ranks_file, text_col, keep), "corpus")
    counts = stored(corpus.filter("__word is not null").groupBy(F.col("__word").alias("word")).agg(F.sum("__n").alias("n")), "word-counts")
    pairs = stored(corpus.filter("__pair is not null").groupBy(F.col("__pair").alias("pair")).agg(F.sum("__n").alias("n")), "pair-counts")
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train = sums["n"] or 0
    low = math.log10(float(n_train + sums["v"] + 1))
    model = fit_model(corpus, pairs, ranks_file)
    top = counts.orderBy(F.desc("n"), "word").limit(COMMON_WORDS).toArrow()
    known = (top.column("word").to_numpy(), top.column("n").to_numpy(), SubwordIds(ranks_file).begins())
    shared, name = spark.sparkContext.broadcast((model.flat, model.tables, *known)), uuid.uuid4().hex

    read = corpus.filter("__ids is not null").select(*keep, "__ids")
    schema = T.StructType(list(read.schema)[: len(keep)]).add("n_tokens", "long").add("seen", "long").add("base", "double").add("score", "double")
    schema.add("rest", T.ArrayType(T.StructType().add("word", "long").add("k", "long")))
    schema.add("pairs", T.ArrayType(T.StructType().add("pair", "long").add("k", "long").add("total", "double").add("low", "double")))
    names = schema.names

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _built(name, lambda: _Scorer(*shared.value))
        for b in sliced(it):
            every = b.column(len(keep)).to_pylist()
            at = {t: k for k, t in enumerate(dict.fromkeys(every))}  # equal texts once
            take = pa.array([at[t] for t in every], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(c.take(take) for c in scorer(list(at)))], names=names)

    with small_batches(spark):
        first = stored(read.mapInArrow(batches, schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    shared.unpersist()
    spread = first.select("row", F.explode("rest").alias("r")).select("row", "r.*")
    found = spread.join(counts, "word").groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("gain"))
    out = first.join(found, "row", "left")
    if not model.tables.complete:
        loose = first.select("row", F.explode("pairs").alias("r")).select("row", "r.*")
        chance = F.greatest(F.coalesce("n", F.lit(0)) - F.lit(DISCOUNT), F.lit(0.0)) / F.col("total") + F.col("low")
        missed = loose.join(pairs, "pair", "left").groupBy("row").agg(F.sum(F.col("k") * F.log10(chance)).alias("within"))
        out = out.join(missed, "row", "left").withColumn("score", F.col("score") + F.coalesce("within", F.lit(0.0)))
    return out.select(
        id_col, *extra, "n_tokens", (F.col("seen") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * F.lit(low)).alias("base_score"), "score")
