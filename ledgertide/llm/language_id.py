"""Language ID: a bidirectional gated recurrent network over bytes, trained here by backpropagation through time.

A text is read in windows of 64 bytes. In each, one network reads forwards and one backwards; their states give every
position a distribution over languages, and a document's distribution is the mean over all its positions. Training
rows are a bounded sample for each language (`per_lang` rows); `crops` windows are drawn from the whole of each. The
weights, under 20 KB, go to the executors. Every byte of every text is read when predicting.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.llm.common import held_out, least_hashes, text_buffer

SPAN, HIDDEN, EMBED = 64, 8, 8
PER_LANG, CROPS = 384, 64
BATCH = 2048
_LETTER = re.compile(r"[^\W\d_]")


class ByteGru:
    """Weights and passes. Columns are sequences: all arrays are (features, ...) so that gates are contiguous."""

    def __init__(self, classes: int, seed: int = 0, hidden: int = HIDDEN, embed: int = EMBED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-1])).astype(np.float32)
        self.hidden = hidden
        self.p = {"emb": rng.standard_normal((embed, 256)).astype(np.float32) * np.float32(0.3), "out": draw(classes, 2 * hidden), "bias": np.zeros((classes, 1), np.float32)}
        for way in "fb":
            self.p |= {f"w{way}": draw(3 * hidden, embed), f"u{way}": draw(3 * hidden, hidden), f"g{way}": np.zeros((3 * hidden, 1), np.float32), f"c{way}": np.zeros((hidden, 1), np.float32)}

    def _read(self, way: str, inputs: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states (hidden, steps, columns) of one direction; keep collects what the backward pass needs."""
        h2, p = 2 * self.hidden, self.p
        steps, n = mask.shape
        gates = (p["w" + way] @ inputs.reshape(len(inputs), -1) + p["g" + way]).reshape(-1, steps, n)
        state, out = np.zeros((self.hidden, n), np.float32), np.empty((self.hidden, steps, n), np.float32)
        half = np.float32(0.5)
        full = mask.all(1)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            back = p["u" + way] @ state
            zr = back[:h2] + gates[:h2, t]
            zr *= half
            np.tanh(zr, out=zr)
            zr += 1
            zr *= half
            z, r = zr[: self.hidden], zr[self.hidden :]
            inner = back[h2:] + p["c" + way]
            new = r * inner
            new += gates[h2:, t]
            np.tanh(new, out=new)
            after = state - new
            after *= z
            after += new
            if not full[t]:
                after *= mask[t]
            if keep is not None:
                keep.append((t, state, z, r, new, inner))
            out[:, t] = after
            state = after
        return out

    def _inputs(self, data: np.ndarray) -> np.ndarray:
        return self.p["emb"][:, data]

    def states(self, data: np.ndarray, mask: np.ndarray) -> np.ndarray:
        inputs = self._inputs(data)
        return np.concatenate([self._read(way, inputs, mask, None) for way in "fb"])

    def positions(self, data: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(classes, steps, columns): a distribution for every position."""
        states = self.states(data, mask)
        scores = self.p["out"] @ states.reshape(len(states), -1) + self.p["bias"]
        scores -= scores.max(0)
        np.exp(scores, out=scores)
        scores /= scores.sum(0)
        return scores.reshape(-1, *mask.shape)

    def gradients(self, data: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions, and its gradients by backpropagation through time."""
        p, hid = self.p, self.hidden
        inputs = self._inputs(data)
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._read(way, inputs, mask, kept[way]) for way in "fb"])
        flat = states.reshape(2 * hid, -1)
        scores = p["out"] @ flat + p["bias"]
        scores -= scores.max(0)
        probs = np.exp(scores)
        probs /= probs.sum(0)
        steps, n = mask.shape
        probs = probs.reshape(-1, steps, n)
        weight = mask / mask.sum()
        right = probs[label, :, np.arange(n)].T
        loss = float(-(np.log(right + 1e-12) * weight).sum())
        d_scores = probs
        d_scores[label, :, np.arange(n)] -= 1
        d_scores *= weight
        d_flat = d_scores.reshape(len(probs), -1)
        grads = {"out": d_flat @ flat.T, "bias": d_flat.sum(1, keepdims=True)}
        d_states = (p["out"].T @ d_flat).reshape(2 * hid, steps, n)
        d_inputs = np.zeros_like(inputs)
        for k, way in enumerate("fb"):
            d_out, carry = d_states[k * hid : (k + 1) * hid], np.zeros((hid, n), np.float32)
            d_u, d_c, d_gates = np.zeros_like(p["u" + way]), np.zeros_like(p["c" + way]), np.empty((3 * hid, steps, n), np.float32)
            for t, before, z, r, new, inner in reversed(kept[way]):
                d_h = (d_out[:, t] + carry) * mask[t]
                d_new = d_h * (1 - z) * (1 - new * new)
                d_z = d_h * (before - new) * z * (1 - z)
                d_r = d_new * inner * r * (1 - r)
                d_inner = d_new * r
                d_back = np.concatenate((d_z, d_r, d_inner))
                d_gates[:, t] = np.concatenate((d_z, d_r, d_new))
                d_u += d_back @ before.T
                d_c += d_inner.sum(1, keepdims=True)
                carry = d_h * z + p["u" + way].T @ d_back
            d_flat_gates = d_gates.reshape(3 * hid, -1)
            grads |= {"u" + way: d_u, "c" + way: d_c, "w" + way: d_flat_gates @ inputs.reshape(len(inputs), -1).T, "g" + way: d_flat_gates.sum(1, keepdims=True)}
            d_inputs += (p["w" + way].T @ d_flat_gates).reshape(inputs.shape)
        where = data.ravel()
        grads["emb"] = np.stack([np.bincount(where, d.ravel(), 256) for d in d_inputs]).astype(np.float32)
        return loss, grads


def train(crops: list[list[bytes]], labels: np.ndarray, classes: int, steps: int = 400, batch: int = 256, rate: float = 0.02, seed: int = 0) -> ByteGru:
    """Adam over crops of up to SPAN bytes, languages in equal shares; crops: those of each training text."""
    rng, net = np.random.default_rng(seed), ByteGru(classes, seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    groups = [np.flatnonzero(labels == c) for c in range(classes)]
    for step in range(1, steps + 1):
        label = rng.integers(0, classes, batch)
        data, mask = np.zeros((SPAN, batch), np.uint8), np.zeros((SPAN, batch), np.float32)
        for k, c in enumerate(label.tolist()):
            own = crops[int(rng.choice(groups[c]))]
            part = np.frombuffer(own[int(rng.integers(0, len(own)))], np.uint8)
            data[: len(part), k], mask[: len(part), k] = part, 1
        _, grads = net.gradients(data, mask, label)
        now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            np.clip(g, -1, 1, out=g)
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            net.p[k] -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def document_probabilities(net: ByteGru, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, classes): the mean distribution over all positions of each text; zeros for empty texts."""
    sizes = np.diff(offsets)
    counts = -(-sizes // SPAN)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[owner] + nth * SPAN
    length = np.minimum(SPAN, offsets[owner + 1] - start)
    out = np.zeros((len(sizes), len(net.p["bias"])))
    padded = np.concatenate((data, np.zeros(SPAN, np.uint8)))
    for k in range(0, len(owner), BATCH):
        s = slice(k, k + BATCH)
        mask = (np.arange(SPAN)[:, None] < length[s]).astype(np.float32)
        probs = net.positions(padded[np.arange(SPAN)[:, None] + start[s]], mask)
        sums = (probs * mask).sum(1, dtype=np.float64)
        for c in range(len(sums)):
            out[:, c] += np.bincount(owner[s], sums[c], len(sizes))
    return out / np.maximum(sizes, 1)[:, None]


def _crops(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, rank, text in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2), strict=True):
                raw, rng = text.as_buffer().to_pybytes(), np.random.default_rng(rank & (2**63 - 1))
                starts = rng.integers(0, max(1, len(raw) - SPAN + 1), n).tolist()
                rows.append((lang, rank, [raw[a : a + SPAN] for a in starts]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.binary()))], names=["lang", "rank", "crops"])

    return run


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = PER_LANG, crops: int = CROPS) -> DataFrame:
    """(lang, rank, crops): at most per_lang texts of each language that are not held out, least hash of id and text first.

    crops: as many seeded pieces of SPAN bytes from anywhere in the whole text. Equal rows share a hash and count once.
    """
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.rlike(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"\p{L}")))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(17), F.col(id_col), F.col(text_col)).alias("rank"), F.col(text_col).cast("binary").alias("text"))
    ids = least_hashes(rows.groupBy("lang", "rank").agg(F.lit(1).alias("one")), "lang", "rank", per_lang).select("lang", "rank")
    chosen = rows.join(F.broadcast(ids), ["lang", "rank"])  # at most per_lang rows a language
    return chosen.mapInArrow(_crops(crops), "lang string, rank long, crops array<binary>").dropDuplicates(["lang", "rank"])


def predict_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, crops: int = CROPS, seed: int = 0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row for each row of docs.

    Learned only from rows that are not held out (crc32 of the id as text, modulo 4, is 2; null ids are held out)
    and have a language and a letter. Null texts and texts without a letter are `und` with score 0, and so is
    everything if there is no row to learn from. With one language learned, all else is that language. Repeated rows
    get equal answers, however the table is partitioned; very long texts are read whole, window by window. An empty
    table gives no rows. Columns other than the three are not read.
    """
    rows = sorted(training_rows(docs, id_col, text_col, lang_col, per_lang, crops).collect(), key=lambda r: (r.lang, r.rank))
    langs = sorted({r.lang for r in rows})
    net = train([[bytes(c) for c in r.crops] for r in rows], np.array([langs.index(r.lang) for r in rows]), len(langs), seed=seed) if langs else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            lettered = np.array([bool(t.is_valid and _LETTER.search(t.as_py())) for t in batch.column(2)], bool)
            if net is None:
                best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
                lettered[:] = False
            else:
                probs = document_probabilities(net, data, offsets)
                best, score = probs.argmax(1), np.clip(probs.max(1), 0, 1)
            pred = [langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(np.where(lettered, score, 0.0), pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
