"""Language identification by a bidirectional gated recurrent network over bytes.

The bytes of a text are cut into windows of ``WINDOW``. A gated recurrent layer reads each
window forwards, another backwards; both states together give every byte a distribution over
the languages. A document's distribution is the mean over all its bytes. The network is
trained in numpy by backpropagation through time, on the loss of every position, with a
bounded sample: ``fit_docs`` documents of each language (different ids, chosen by a hash) and
``fit_windows`` windows spread evenly over each. Every language of the learning rows is
learned; if there are so many that the sample would exceed ``fit_total`` documents, they share
those evenly, with one document each at least.

Documents are accepted if two values reach their floors: the score, and the share of three-byte
groups of letters that the learned windows have too. The floors are exact order statistics over all held-out
ids, so that a share ``keep`` of those with the right language passes both. With too few of them to tell (under 1,999
at 0.999) there are no floors.

A text that is null or has no letter is ``und`` with score 0, and so is every text if there is
nothing to learn from. Rows that repeat give repeated results. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffmart.llm.common import first_by_hash, pieces, raw_texts, values
from staffmart.operators.ordering import with_position
from staffmart.sources.tables import materialise

WINDOW = 64
HIDDEN = 8
FIT_DOCS, FIT_WINDOWS, FIT_TOTAL = 200, 8, 12_800
CELLS = 1 << 18  # windows or texts, times languages, handled at once
EPOCHS, STEP, GROUP = 8, 0.02, 256
UNKNOWN = "und"
KEEP = 0.999  # of the held-out rows with the right language
SLACK = 1e-6  # rounding between batches
_BLANKS = bytes.maketrans(b"\t\n\r", b"   ")
_LETTERS = np.array([k >= 128 or chr(k).isalpha() or k == 32 for k in range(256)])


class Network:
    """Two gated recurrent layers of ``hidden`` units and a softmax at each position."""

    def __init__(self, classes: int = 0, hidden: int = HIDDEN, seed: int = 7, kind=np.float32, given: dict | None = None):
        self.p = given or {}
        if given:
            self.hidden = len(given["hf"])
            return
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        for way in ("f", "b"):
            self.p["x" + way] = rng.normal(0, 0.5, (256, 3 * hidden)).astype(kind)
            self.p["h" + way] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(kind)
            self.p["o" + way] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, classes)).astype(kind)
        self.p["bias"] = np.zeros(classes, kind)

    def _read(self, x: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """States after each step; x is (steps, windows)."""
        k = self.hidden
        given, back = self.p["x" + way], self.p["h" + way]
        states = np.empty((*x.shape, k), given.dtype)
        h = np.zeros((x.shape[1], k), given.dtype)
        steps = range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
        for t in steps:
            g = given[x[t]]
            a = h @ back
            gates = g[:, :2 * k] + a[:, :2 * k]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5  # the logistic function
            z, r = gates[:, :k], gates[:, k:]
            n = r * a[:, 2 * k:]
            n += g[:, 2 * k:]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((t, h, z, r, n, a[:, 2 * k:]))
            h = z * (h - n) + n
            states[t] = h
        return states

    def positions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Distribution over the languages at each position, (steps, windows, languages)."""
        logits = self.p["bias"]
        for way in ("f", "b"):
            seen = [] if keep is not None else None
            states = self._read(x, way, seen)
            logits = logits + states @ self.p["o" + way]
            if keep is not None:
                keep[way] = (states, seen)
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean loss over all positions and its derivatives, through time."""
        k, keep = self.hidden, {}
        prob = self.positions(x, keep)
        rows = np.arange(x.shape[1])
        loss = -np.log(prob[:, rows, label] + 1e-12).mean()
        d = prob
        d[:, rows, label] -= 1
        d /= x.size
        grad = {"bias": d.sum((0, 1))}
        for way in ("f", "b"):
            states, seen = keep[way]
            grad["o" + way] = np.einsum("tnk,tnc->kc", states, d)
            out = d @ self.p["o" + way].T
            back = self.p["h" + way]
            given = np.empty((*x.shape, 3 * k), back.dtype)
            grad["h" + way] = np.zeros_like(back)
            carry = np.zeros((x.shape[1], k), back.dtype)
            for t, h, z, r, n, a in reversed(seen):
                dh = out[t] + carry
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * a * r * (1 - r)
                da = np.concatenate([dz, dr, dn * r], 1)
                given[t] = np.concatenate([dz, dr, dn], 1)
                grad["h" + way] += h.T @ da
                carry = dh * z + da @ back.T
            order = np.argsort(x, axis=None, kind="stable")
            symbols, first = np.unique(x.ravel()[order], return_index=True)
            grad["x" + way] = np.zeros_like(self.p["x" + way])
            grad["x" + way][symbols] = np.add.reduceat(given.reshape(-1, 3 * k)[order], first, axis=0)
        return float(loss), grad

    def fit(self, x: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, step: float = STEP, seed: int = 3) -> list[float]:
        """Adam over shuffled groups of windows; x is (windows, steps). Loss of each epoch."""
        rng = np.random.default_rng(seed)
        first = {n: np.zeros_like(v) for n, v in self.p.items()}
        second = {n: np.zeros_like(v) for n, v in self.p.items()}
        losses, count = [], 0
        for epoch in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for at in range(0, len(x), GROUP):
                rows = order[at:at + GROUP]
                loss, grad = self.gradients(np.ascontiguousarray(x[rows].T), label[rows])
                total += loss * len(rows)
                count += 1
                size = step * (1 - epoch / epochs)
                for n, g in grad.items():
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.99 * second[n] + 0.01 * g * g
                    self.p[n] -= (size * first[n] / (1 - 0.9**count) / (
                        np.sqrt(second[n] / (1 - 0.99**count)) + 1e-8)).astype(g.dtype)
            losses.append(total / len(x))
        return losses

    def documents(self, texts: list[bytes], most: int = 4096) -> np.ndarray:
        """Mean distribution over all bytes of each text; an empty text has zeros."""
        most = max(1, min(most, CELLS // len(self.p["bias"])))
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = -(-sizes // WINDOW)
        flat = np.full(int(counts.sum()) * WINDOW, 32, np.uint8)
        begin = (np.cumsum(counts) - counts) * WINDOW
        for t, at in zip(texts, begin):
            flat[at:at + len(t)] = np.frombuffer(t, np.uint8)
        windows = flat.reshape(-1, WINDOW)
        owner = np.repeat(np.arange(len(texts)), counts)
        # bytes of the text in each window
        real = np.minimum(WINDOW, np.repeat(sizes, counts) - (np.arange(len(owner)) * WINDOW - np.repeat(begin, counts)))
        pooled = np.zeros((len(texts), len(self.p["bias"])))
        for at in range(0, len(windows), most):
            prob = self.positions(np.ascontiguousarray(windows[at:at + most].T))
            length = real[at:at + most]
            for w in np.flatnonzero(length < WINDOW):
                prob[length[w]:, w] = 0
            np.add.at(pooled, owner[at:at + most], prob.sum(0))
        return pooled / np.maximum(sizes, 1)[:, None]


def byte_groups(text: bytes) -> np.ndarray:
    """Codes of all three-byte groups of letters and blanks, A-Z lower-cased."""
    b = np.frombuffer(text.lower().translate(_BLANKS), np.uint8)
    fit = _LETTERS[b]
    at = np.flatnonzero(fit[:-2] & fit[1:-1] & fit[2:])
    b = b.astype(np.int32)
    return b[at] << 16 | b[at + 1] << 8 | b[at + 2]


def known_share(text: bytes, known: np.ndarray) -> float:
    """Share of a text's groups that are ``known`` (a flag for each code); 1 if it has none."""
    groups = byte_groups(text)
    return float(known[groups].mean()) if len(groups) else 1.0


def _windows(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = {"lang": [], "window": []}
            for lang, text in zip(values(batch, "lang").to_pylist(), raw_texts(batch)):
                places = max(1, len(text) - WINDOW + 1)
                for at in sorted({int(p) for p in np.linspace(0, places - 1, count)}):
                    out["lang"].append(lang)
                    out["window"].append(text[at:at + WINDOW].ljust(WINDOW))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("lang", pa.string()), ("window", pa.binary())]))
    return run


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def _sample(usable: DataFrame, docs: int) -> DataFrame:
    """doc_id, lang and text of at most ``docs`` ids a language; an id counts once, with its smallest language and text there."""
    ids = usable.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    chosen = first_by_hash(ids, "lang", "doc_id", docs)
    return usable.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def train(documents: DataFrame, learn: Column, fit_docs: int = FIT_DOCS, fit_windows: int = FIT_WINDOWS,
          fit_total: int = FIT_TOTAL, epochs: int = EPOCHS) -> tuple[list[str], Network] | None:
    """Languages and network from the documents with ``learn``, or None if there are none."""
    usable = documents.where(learn & F.col("lang").isNotNull() & _has_letter(F.col("text")))
    languages = sorted(r["lang"] for r in usable.select("lang").distinct().collect())
    if not languages:
        return None
    fit_docs = max(1, min(fit_docs, fit_total // len(languages)))
    rows = _sample(usable, fit_docs).select("lang", "text").mapInArrow(_windows(fit_windows), "lang string, window binary").collect()
    place = {lang: k for k, lang in enumerate(languages)}
    rows = sorted((place[r["lang"]], bytes(r["window"])) for r in rows)
    x = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, WINDOW)
    network = Network(len(languages))
    network.fit(x, np.array([c for c, _ in rows]), epochs)
    network.groups = np.unique(np.concatenate([byte_groups(w) for _, w in rows]))
    return languages, network


def _predict(send, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, given, groups = send.value
        network = Network(given=given)
        if groups is not None:
            known = np.zeros(1 << 24, bool)
            known[groups] = True
        most = max(1, 16 * CELLS // len(languages))
        for batch in (b.slice(at, most) for b in pieces(batches) for at in range(0, b.num_rows, most)):
            texts = raw_texts(batch)
            pooled = network.documents(texts)
            best = pooled.argmax(1)
            letters = values(batch, "__letters").to_pylist()
            yield pa.RecordBatch.from_arrays([
                *(values(batch, c) for c in keep),
                pa.array([languages[k] if ok else UNKNOWN for k, ok in zip(best, letters)], pa.string()),
                pa.array([min(1.0, float(p[k])) if ok else 0.0 for p, k, ok in zip(pooled, best, letters)], pa.float64()),
                *([] if groups is None else [pa.array([known_share(t, known) for t in texts], pa.float64())]),
            ], names=[*keep, "__lang", "__score", *([] if groups is None else ["__known"])])
    return run


def _labelled(documents: DataFrame, keep: list[str], model: tuple[list[str], Network], groups: bool = False) -> DataFrame:
    """The ``keep`` columns with __lang and __score, and with ``groups`` __known."""
    languages, network = model
    send = documents.sparkSession.sparkContext.broadcast((languages, network.p, network.groups if groups else None))
    schema = T.StructType([documents.schema[c] for c in keep]).add("__lang", "string").add("__score", "double")
    if groups:
        schema = schema.add("__known", "double")
    given = documents.withColumn("__letters", _has_letter(F.col("text")))
    return given.select(*dict.fromkeys([*keep, "text", "__letters"])).mapInArrow(_predict(send, keep), schema)


def identify(documents: DataFrame, hold: Column, **fit) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; learns from the rows without ``hold``."""
    given = documents.select("doc_id", "text", "lang").withColumn("held_out", hold)
    model = train(given, ~F.col("held_out"), **fit)
    if model is None:
        return given.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return _labelled(given, ["doc_id", "held_out"], model).select(
        "doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def _judged(documents: DataFrame, hold: Column, model: tuple[list[str], Network]) -> DataFrame:
    """All rows with __hold, __lang, __score and __known; written, so that the network goes through each text once."""
    given = documents.withColumn("__hold", hold)
    return materialise(_labelled(given, given.columns, model, groups=True), "judged")


def _floors(judged: DataFrame, keep: float) -> tuple[float, float]:
    """An id counts once, with its smallest language and one text there."""
    usable = judged.where(F.col("__hold") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & _has_letter(F.col("text")))
    row = F.min(F.struct("lang", F.md5(F.col("text").cast("binary")).alias("text"), "__lang", "__score", "__known")).alias("row")
    right = materialise(usable.groupBy("doc_id").agg(row).where("row.__lang = row.lang").select(
        "doc_id", F.col("row.__score").alias("score"), F.col("row.__known").alias("known")), "right")
    below = int((1 - keep) / 2 * (right.count() + 1) + SLACK)  # half of the loss for each value
    if not below:
        return 0.0, 0.0

    def floor(value: str) -> float:
        placed = with_position(right.select(value, "doc_id"), "place", [value, "doc_id"])
        return placed.where(F.col("place") == below).first()[value] - SLACK
    return floor("score"), floor("known")


def floors(documents: DataFrame, hold: Column, model: tuple[list[str], Network], keep: float = KEEP) -> tuple[float, float]:
    """The score and the known share which a share ``keep`` of all right rows with ``hold`` reaches."""
    return _floors(_judged(documents, hold, model), keep)


def accepted(documents: DataFrame, hold: Column, keep: float = KEEP, **fit) -> DataFrame:
    """The documents whose language is known and that reach both floors, with all their columns."""
    model = train(documents, ~hold, **fit)
    if model is None:
        return documents.where(F.lit(False))
    found = _judged(documents, hold, model)
    score, known = _floors(found, keep)
    return found.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= score) & (F.col("__known") >= known)
                       ).select(documents.columns)
