"""Language identification with a bidirectional gated recurrent network over bytes.

A text is read in windows of WINDOW bytes.  In each, one network runs forward and
one backward; both states at a position give its language by softmax, and a
document's probabilities are the mean over all its positions.  The network is
trained by backpropagation through time, in numpy, on windows of a bounded sample
of documents with a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm import textkernel as tk
from segmenta.llm.common import DOCUMENT_COLUMNS, map_batches

HIDDEN = 16
WINDOW = 64
#: The bound of the training sample: documents of a language, with all their windows.
SAMPLE_DOCUMENTS = 400
#: Beyond so many languages, training takes more steps and texts are run in smaller pieces, in proportion.
USUAL_LANGUAGES = 32
STEPS = 150
BATCH = 384
#: Documents whose best language has less are rejected.
MIN_PROBABILITY = 0.4
SEED = 20
#: Bytes whose windows are run side by side, which bounds a worker's memory.
RUN_BYTES = 1 << 18

Params = dict[str, np.ndarray]


def start_params(languages: int, rng: np.random.Generator) -> Params:
    p = {}
    for d in "fb":
        p[f"U{d}"] = rng.normal(0, 0.3, (256, 3 * HIDDEN))
        p[f"R{d}"] = rng.normal(0, 0.25, (HIDDEN, 3 * HIDDEN))
        p[f"b{d}"] = np.zeros(3 * HIDDEN)
    p["V"] = rng.normal(0, 0.3, (2 * HIDDEN, languages))
    p["c"] = np.zeros(languages)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), which stands for tanh here and takes a tenth of its time."""
    y = np.abs(x)
    y += 1
    return np.divide(x, y, out=y)


def _states(p: Params, d: str, windows: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (steps, windows, HIDDEN) of one direction, in reading order; ``trace`` gets what the way back needs.

    Gates are update z, reset r and candidate c: h' = c + z (h - c), c = soft(x + (r h) R),
    z and r = (1 + soft(x + h R)) / 2.
    """
    steps, n = windows.shape[1], len(windows)
    bytes_of = np.ascontiguousarray(windows.T)
    out = np.empty((steps, n, HIDDEN), p["c"].dtype)
    h = np.zeros((n, HIDDEN), out.dtype)
    both, last = p[f"U{d}"] + p[f"b{d}"], 2 * HIDDEN
    gate_in, cand_in = np.ascontiguousarray(both[:, :last]), np.ascontiguousarray(both[:, last:])
    gates, cand = np.ascontiguousarray(p[f"R{d}"][:, :last]), np.ascontiguousarray(p[f"R{d}"][:, last:])
    for i in range(steps):
        t = i if d == "f" else steps - 1 - i
        x = h @ gates
        x += np.take(gate_in, bytes_of[t], axis=0)
        s = _soft(x)
        zr = s * out.dtype.type(0.5)
        zr += out.dtype.type(0.5)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        rh = r * h
        y = rh @ cand
        y += np.take(cand_in, bytes_of[t], axis=0)
        c = _soft(y)
        if trace is not None:
            trace.append((t, h, s, z, r, rh, c))
        new = out[t]
        np.subtract(h, c, out=new)
        new *= z
        new += c
        h = new
    return out


def probabilities(p: Params, windows: np.ndarray) -> np.ndarray:
    """(languages, steps, windows): the language of each byte."""
    logits = _states(p, "f", windows) @ p["V"][:HIDDEN]
    logits += _states(p, "b", windows) @ p["V"][HIDDEN:]
    q = np.ascontiguousarray(np.moveaxis(logits, 2, 0))
    q += p["c"][:, None, None]
    q -= q.max(axis=0)
    np.exp(q, out=q)
    q /= q.sum(axis=0)
    return q


def loss_and_gradient(p: Params, windows: np.ndarray, labels: np.ndarray) -> tuple[float, Params]:
    """Mean cross entropy of the positions, and its gradient by backpropagation through time."""
    traces: dict[str, list] = {"f": [], "b": []}
    hf, hb = _states(p, "f", windows, traces["f"]), _states(p, "b", windows, traces["b"])
    both = np.concatenate([hf, hb], axis=2)
    logits = both @ p["V"] + p["c"]
    logits -= logits.max(axis=2, keepdims=True)
    e = np.exp(logits)
    q = e / e.sum(axis=2, keepdims=True)
    weight = (windows.T != 0).astype(np.float32)
    total = max(1.0, float(weight.sum()))
    rows = np.arange(len(labels))
    loss = float(-(np.log(q[:, rows, labels] + 1e-12) * weight).sum() / total)
    q[:, rows, labels] -= 1
    q *= weight[:, :, None] / np.float32(total)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["V"] = np.einsum("tnh,tnk->hk", both, q, optimize=True)
    g["c"] = q.sum(axis=(0, 1))
    down = q @ p["V"].T
    byte = windows.T.ravel()
    order = np.argsort(byte, kind="stable")
    found, begin = np.unique(byte[order], return_index=True)
    for d, part in (("f", down[:, :, :HIDDEN]), ("b", down[:, :, HIDDEN:])):
        gates, cand = p[f"R{d}"][:, : 2 * HIDDEN], p[f"R{d}"][:, 2 * HIDDEN :]
        dh = np.zeros((len(windows), HIDDEN), both.dtype)
        dxs = np.empty((windows.shape[1], len(windows), 3 * HIDDEN), both.dtype)
        for t, h, s, z, r, rh, c in reversed(traces[d]):
            dh = dh + part[t]
            dx, slope = dxs[t], 0.5 * (1 - np.abs(s)) ** 2
            dx[:, 2 * HIDDEN :] = dn = dh * (1 - z) * (1 - np.abs(c)) ** 2
            drh = dn @ cand.T
            dx[:, :HIDDEN] = dh * (h - c) * slope[:, :HIDDEN]
            dx[:, HIDDEN : 2 * HIDDEN] = drh * h * slope[:, HIDDEN:]
            g[f"R{d}"][:, : 2 * HIDDEN] += h.T @ dx[:, : 2 * HIDDEN]
            g[f"R{d}"][:, 2 * HIDDEN :] += rh.T @ dn
            dh = dh * z + drh * r + dx[:, : 2 * HIDDEN] @ gates.T
        flat = dxs.reshape(-1, 3 * HIDDEN)
        g[f"U{d}"][found] = np.add.reduceat(flat[order], begin, axis=0)
        g[f"b{d}"] = flat.sum(axis=0)
    return loss, g


def train(windows: np.ndarray, labels: np.ndarray, languages: int, steps: int = STEPS) -> Params:
    """Adam over random batches; the same windows give the same network."""
    rng = np.random.default_rng(SEED)
    p = start_params(languages, rng)
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), min(BATCH, len(windows)))
        _, g = loss_and_gradient(p, windows[pick], labels[pick])
        norm = float(np.sqrt(sum(float((x * x).sum()) for x in g.values())))
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            x = g[k] * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def _windows(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, padded with 0; number of windows of each text) of texts laid end to end; a NUL in a text is read as a blank."""
    sizes = np.diff(offs)
    counts = -(-sizes // WINDOW)
    if (body == 0).any():
        body = np.where(body == 0, np.uint8(32), body)
    first = np.repeat(offs[:-1], counts) + WINDOW * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    end = np.repeat(offs[1:], counts)
    at = first[:, None] + np.arange(WINDOW)
    inside = at < end[:, None]
    return np.where(inside, body[np.minimum(at, max(0, len(body) - 1))], 0).astype(np.uint8), counts


def pooled(p: Params, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean probabilities, share of positions by their likeliest language, number of bytes) of each text."""
    body, offs = tk.raw(column)
    n, k = len(offs) - 1, len(p["c"])
    mean, share = np.zeros((n, k)), np.zeros((n, k))
    run = max(WINDOW, RUN_BYTES * USUAL_LANGUAGES // max(USUAL_LANGUAGES, k))
    for a, b in tk.pieces(offs, run):
        windows, counts = _windows(body[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        doc = np.repeat(np.arange(a, b), counts)
        for s in range(0, len(windows), run // WINDOW):
            part = windows[s : s + run // WINDOW]
            text = part.T != 0
            q = probabilities(p, part)
            q *= text
            top = q.max(axis=0)
            left = text.copy()
            for j in range(k):
                own = (q[j] == top) & left
                left &= ~own
                mean[:, j] += np.bincount(doc[s : s + len(part)], q[j].sum(axis=0), n)
                share[:, j] += np.bincount(doc[s : s + len(part)], own.sum(axis=0), n)
    size = np.maximum(share.sum(axis=1), 1)[:, None]
    return mean / size, share / size, np.diff(offs)


def position_labels(p: Params, text: str) -> np.ndarray:
    """The likeliest language of each byte of ``text``."""
    body = np.frombuffer(text.encode(), np.uint8)
    windows, _ = _windows(body, np.array([0, len(body)]))
    return probabilities(p, windows).argmax(axis=0).T.ravel()[: len(body)] if len(body) else np.zeros(0, np.int64)


def fit(documents: DataFrame) -> tuple[list[str], Params | None]:
    """(languages, network) from the documents that have a language.

    Every language is a class.  The driver gets the whole texts of SAMPLE_DOCUMENTS
    documents of each, about, whatever the table's size.
    """
    counts = documents.where("lang IS NOT NULL AND lang <> ''").groupBy("lang").count().collect()
    names = sorted(r[0] for r in counts)
    if not names:
        return [], None
    share = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, SAMPLE_DOCUMENTS / n))])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) < share * F.lit(1 << 20)
    index = {name: i for i, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, out = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                windows, n = _windows(body, np.array([0, len(body)]))
                label.append(index[lang])
                out.append(windows.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(out, pa.binary())], ["label", "bytes"])

    rows = sorted((r[0], bytes(r[1])) for r in map_batches(documents.where(draw).select("lang", "text"), run, "label int, bytes binary").collect())
    if not rows:
        return names, None
    windows = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WINDOW)
    labels = np.repeat([r[0] for r in rows], [len(r[1]) // WINDOW for r in rows])
    if not len(windows):
        return names, None
    return names, train(windows, labels, len(names), -(-STEPS * max(USUAL_LANGUAGES, len(names)) // USUAL_LANGUAGES))


def _judge(names: list[str], p: Params | None, text: pa.Array) -> tuple[list, list, list, list]:
    if p is None:
        none = [None] * len(text)
        return none, none, none, [len(t.as_py() or "") > 0 for t in text]
    mean, share, size = pooled(p, text)
    best = mean.argmax(axis=1)
    rows, ok = np.arange(len(best)), size > 0
    top = mean[rows, best]
    lang = [names[j] if o else None for j, o in zip(best, ok, strict=True)]
    value = [round(float(x), 4) if o else None for x, o in zip(top, ok, strict=True)]
    agree = [round(float(x), 4) if o else None for x, o in zip(share[rows, best], ok, strict=True)]
    return lang, value, agree, (ok & (top >= MIN_PROBABILITY)).tolist()


def identify(documents: DataFrame, model: tuple[list[str], Params | None] | None = None) -> DataFrame:
    """(doc_id, detected, probability, position_share, kept) of each row of documents.

    ``position_share`` is the share of bytes whose own likeliest language is
    ``detected``.  Null and empty texts have nulls and are rejected (``kept`` is
    false), as are texts whose best language has less than MIN_PROBABILITY.  Rows with
    a null lang are judged and not trained on; where no row has a language, nothing is
    detected and every text is kept.  Of equal probabilities the first name counts.
    Repeated rows are judged each.  An empty table gives no rows.  Other columns are
    ignored.
    """
    names, p = model or fit(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, value, agree, kept = _judge(names, p, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(value, pa.float64()), pa.array(agree, pa.float64()), pa.array(kept, pa.bool_())], ["doc_id", "detected", "probability", "position_share", "kept"])

    return map_batches(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, detected string, probability double, position_share double, kept boolean")


def keep_identified(documents: DataFrame, model: tuple[list[str], Params | None] | None = None) -> DataFrame:
    """The documents that ``identify`` keeps, with the columns of documents, unchanged.

    Null and empty texts go; where no row has a language, every other text stays.
    Repeated rows are judged each; an empty table stays empty; other columns are left
    out, whatever their names.
    """
    names, p = model or fit(documents)
    whole = documents.select(*DOCUMENT_COLUMNS)
    schema = whole.schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_judge(names, p, batch.column(1))[3], pa.bool_()))

    return map_batches(whole, run, schema)
