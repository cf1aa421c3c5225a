"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read windows of bytes in either direction; at every position their states
together give language probabilities, and a document's probabilities are the mean over its letters'
positions in all windows.  The network is trained in numpy by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versionlog.llm.common import sliced

#: Bytes of a window, units of either direction, windows that are run together.
WINDOW, UNITS, BATCH = 96, 8, 1024
#: Labelled documents that the network is fitted on at most, one window of each.
SAMPLE = 6_000
UNDETERMINED = "und"


def _layout(units: int, classes: int) -> dict[str, tuple[int, ...]]:
    return {"table": (2, 256, 3 * units), "rec": (2, units, 3 * units), "out": (2, units, classes), "bias": (classes,)}


class ByteGru:
    """Gates z and r as (1 + tanh) / 2; candidate n = tanh(input + r * recurrent); h' = n + z * (h - n)."""

    def __init__(self, classes: Sequence[str], params: dict[str, np.ndarray], window: int = WINDOW):
        self.classes, self.p, self.window = list(classes), params, window
        self.units = params["rec"].shape[1]

    @classmethod
    def fresh(cls, classes: Sequence[str], units: int = UNITS, window: int = WINDOW, seed: int = 5) -> ByteGru:
        rng = np.random.default_rng(seed)
        scale = {"table": 0.3, "rec": 1 / np.sqrt(units), "out": 0.3, "bias": 0.0}
        return cls(classes, {k: (scale[k] * rng.standard_normal(s)).astype(np.float32) for k, s in _layout(units, len(classes)).items()}, window)

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of both directions, (steps, 2, windows, units), in each direction's own order."""
        steps, n = x.shape
        u, (table, rec) = self.units, (self.p["table"].reshape(512, -1), self.p["rec"])
        at = np.stack([x, x[::-1].astype(np.int64) + 256], axis=1).astype(np.intp)
        hs = np.empty((steps, 2, n, u), dtype=np.float32)
        h = np.zeros((2, n, u), dtype=np.float32)
        g, a = np.empty((2, n, 3 * u), dtype=np.float32), np.empty((2, n, 3 * u), dtype=np.float32)
        for t in range(steps):
            np.take(table, at[t], axis=0, out=g, mode="clip")
            np.matmul(h, rec, out=a)
            gate = g[..., : 2 * u]
            gate += a[..., : 2 * u]
            gate = np.tanh(gate)
            gate *= 0.5
            gate += 0.5
            cand = gate[..., u:] * a[..., 2 * u :]
            cand += g[..., 2 * u :]
            np.tanh(cand, out=cand)
            if keep is not None:
                keep.append((h, gate, cand, a[..., 2 * u :].copy()))
            h = h - cand
            h *= gate[..., :u]
            h += cand
            hs[t] = h
        return hs

    def probabilities(self, hs: np.ndarray) -> np.ndarray:
        """Language probabilities of every position, (steps, windows, classes)."""
        z = hs[:, 0] @ self.p["out"][0]
        z += hs[::-1, 1] @ self.p["out"][1]
        z += self.p["bias"]
        z -= z.max(axis=-1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=-1, keepdims=True)
        return z

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the positions of ``mask``, and its gradients by backpropagation through time."""
        keep: list = []
        hs = self.states(x, keep)
        p = self.probabilities(hs)
        steps, n, u = *x.shape, self.units
        total = max(1.0, float(mask.sum()))
        loss = -float((np.log(p[:, np.arange(n), y] + 1e-9) * mask).sum()) / total
        dz = p
        dz[:, np.arange(n), y] -= 1
        dz *= (mask / total)[..., None].astype(np.float32)
        d = {k: np.zeros_like(v) for k, v in self.p.items()}
        d["bias"] += dz.sum(axis=(0, 1))
        flat = dz.reshape(-1, dz.shape[-1])
        d["out"][0] = hs[:, 0].reshape(-1, u).T @ flat
        d["out"][1] = hs[::-1, 1].reshape(-1, u).T @ flat
        dh_out = np.stack([dz @ self.p["out"][0].T, (dz @ self.p["out"][1].T)[::-1]], axis=1)
        dg_all = np.empty((steps, 2, n, 3 * u), dtype=np.float32)
        dh = np.zeros((2, n, u), dtype=np.float32)
        rec_t = self.p["rec"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            h, gate, cand, an = keep[t]
            z, r = gate[..., :u], gate[..., u:]
            dh = dh + dh_out[t]
            dn = dh * (1 - z) * (1 - cand * cand)
            da = np.empty((2, n, 3 * u), dtype=np.float32)
            da[..., :u] = dh * (h - cand) * z * (1 - z) * 2
            da[..., u : 2 * u] = dn * an * r * (1 - r) * 2
            da[..., 2 * u :] = dn * r
            dg_all[t] = da
            dg_all[t][..., 2 * u :] = dn
            d["rec"] += h.transpose(0, 2, 1) @ da
            dh = dh * z + da @ rec_t
        for k, order in ((0, x), (1, x[::-1])):
            np.add.at(d["table"][k], order.reshape(-1), dg_all[:, k].reshape(-1, 3 * u))
        return loss, d

    def fit(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, rounds: int = 4, steps: int = 250, batch: int = 128, rate: float = 0.02, seed: int = 11) -> ByteGru:
        """Adam over shuffled batches of windows (x: bytes by window and place), so many rounds and steps at least."""
        rng = np.random.default_rng(seed)
        rounds = max(rounds, -(-steps // -(-len(x) // batch)))
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        total, step = rounds * -(-len(x) // batch), 0
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                i = order[at : at + batch]
                _, d = self.gradients(np.ascontiguousarray(x[i].T), y[i], np.ascontiguousarray(mask[i].T))
                step += 1
                lr = rate * (1 - step / (total + 1))
                norm = np.sqrt(sum(float((g * g).sum()) for g in d.values()))
                for k, g in d.items():
                    g *= min(1.0, 1.0 / (norm + 1e-9))
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
        return self

    def label(self, texts: Sequence[bytes]) -> np.ndarray:
        """Pooled probabilities (texts, classes) of texts with A-Z in lower case; rows of texts without letter bytes are 0."""
        total = np.zeros((len(texts), len(self.classes)))
        seen = np.zeros(len(texts))
        w = self.window
        owner: list[int] = []
        cut: list[bytes] = []

        def run() -> None:
            x = np.frombuffer(b"".join(c.ljust(w, b"\0") for c in cut), dtype=np.uint8).reshape(-1, w)
            x = np.ascontiguousarray(x.T)
            on = LETTER[x]
            p = self.probabilities(self.states(x))
            p *= on[..., None]
            np.add.at(total, owner, p.sum(axis=0, dtype=np.float64))
            np.add.at(seen, owner, on.sum(axis=0))

        for k, text in enumerate(texts):
            for at in range(0, len(text), w):
                owner.append(k)
                cut.append(text[at : at + w])
                if len(cut) == BATCH:
                    run()
                    owner.clear()
                    cut.clear()
        if cut:
            run()
        return total / np.maximum(seen, 1)[:, None]


#: Bytes that count as letters: ASCII letters and all parts of longer characters.
LETTER = np.array([float(chr(b).isalpha() and b < 128 or b >= 128) for b in range(256)], dtype=np.float32)


def fit_language_id(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> ByteGru | None:
    """A network fitted on one window of each of at most ``sample`` labelled documents where ``learn`` holds.

    Which documents and windows: by a seeded hash of the text, so all of a corpus is drawn from alike.
    None if there is no labelled text.
    """
    place = F.pmod(F.xxhash64(F.lit(3), text_col), F.greatest(F.length(text_col) - WINDOW, F.lit(0)) + 1)
    rows = (
        docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
        .select(F.substring(F.col(text_col), (place + 1).cast("int"), F.lit(WINDOW)).alias("cut"), F.col(lang_col).alias("lang"), F.xxhash64(F.lit(4), text_col).alias("by"))
        .groupBy("by", "lang").agg(F.min("cut").alias("cut"))  # copies of a text once
        .orderBy("by", "lang").limit(sample).collect()
    )
    if not rows:
        return None
    classes = sorted({r["lang"] for r in rows})
    x = np.frombuffer(b"".join(r["cut"].encode().lower()[:WINDOW].ljust(WINDOW, b"\0") for r in rows), dtype=np.uint8).reshape(-1, WINDOW)
    y = np.array([classes.index(r["lang"]) for r in rows])
    return ByteGru.fresh(classes).fit(x, y, LETTER[x])


def identify(docs: DataFrame, model: ByteGru | None, id_col: str = "doc_id", text_col: str = "text", extra: Sequence[Column] = ()) -> DataFrame:
    """``(id, *extra, lang_pred, score)`` of every whole text, in one pass without a shuffle.

    A null text, a text without letters, or any text if nothing could be learned is ``und`` with score
    0.  Only the text decides.  Repeated rows are kept; an empty table gives no rows.
    """
    kept = docs.select(F.col(text_col).alias("__t"), F.col(id_col), *extra)
    schema = kept.drop("__t").schema.add("lang_pred", "string").add("score", "double")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it):
            texts = b.column(0).to_pylist()
            worth = [k for k, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if worth:
                p = model.label([texts[k].encode().lower() for k in worth])
                for k, best, s in zip(worth, p.argmax(axis=1), p.max(axis=1), strict=True):
                    lang[k], score[k] = model.classes[best], min(1.0, float(s))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[f.name for f in schema])

    return kept.mapInArrow(batches, schema)
