"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut where no piece can cross (before white space runs and at line ends),
and its different segments are indexed once: a suffix array over their concatenation, as deep
as the longest piece. A binary search finds the range of suffixes that start with each piece
of the vocabulary; the ranges give all edges (place, piece). Sorted by where they end, the edges are
relaxed from left to right: an edge extends the encoding of the text before it exactly if
merging would leave its piece and the last piece before it side by side. That leaves one edge
at each place and gives the merges' own result, the same ids as the library's encoder.

For models of merge type with byte fallback, white space kept and a leading blank added, which
is checked. Characters without a piece become byte pieces; so does the meta symbol U+2581 itself,
which keeps decoding exact. A null or empty text has no ids, and no ids decode to an empty text.
Rows that repeat give repeated results. Other columns may be carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmart.llm.common import SEED, pieces as text_pieces, raw_texts, values

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ENCODED = 3 << 20  # bytes of text encoded at once
INDEXED = 1 << 18  # characters indexed at once; a longer segment comes alone
META = "▁"
_NEVER = 1 << 30
_CACHE_BITS = 21


def load(path: str = MODEL) -> dict:
    """Tables of a model, bounded by its vocabulary: pieces, merge order, splits, joins."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "  a  ｆé b "
    if model.decode(model.encode(probe)) != probe:
        raise ValueError("the model changes white space or characters")
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    scores = [model.get_score(i) for i in range(len(names))]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(len(names))]
    return tables(names, scores, special, {int(n[3:5], 16): i for i, n in enumerate(names) if model.is_byte(i)})


def tables(names: list[str], scores: list[float], special: list[bool], byte_ids: dict[int, int]) -> dict:
    if len(byte_ids) != 256:
        raise ValueError("the model has no byte pieces")
    texts = [None if s else n.replace(META, " ") for n, s in zip(names, special)]
    if any(t and re.search("[^ ] ", t) for t in texts):
        raise ValueError("a piece crosses the start of a word")
    known = {t: i for i, t in enumerate(texts) if t}
    order = {s: k for k, s in enumerate(sorted({s for s, t in zip(scores, texts) if t}, reverse=True))}
    count = len(names)
    rank = np.full(count, -1, np.int64)
    left, right = np.full(count, -1, np.int64), np.full(count, -1, np.int64)
    alone = np.zeros(count, bool)  # merging the piece's own text gives the piece
    joins: dict[int, int] = {}
    for text, i in known.items():
        if len(text) == 1:
            alone[i] = True
            continue
        rank[i] = order[scores[i]]
        for cut in range(1, len(text)):
            a, b = known.get(text[:cut]), known.get(text[cut:])
            if a is not None and b is not None:
                joins[a * count + b] = rank[i]
        whole = _merge(text, known, scores)
        if whole is not None:
            left[i], right[i] = whole
            alone[i] = True
    keys = np.array(sorted(joins), np.int64)
    decoded = [bytes([int(n[3:5], 16)]) if i in set(byte_ids.values()) else (t or "").encode()
               for i, (n, t) in enumerate(zip(names, texts))]
    return {"texts": texts, "rank": rank, "left": left, "right": right, "alone": alone, "keys": keys,
            "join_rank": np.array([joins[k] for k in keys.tolist()], np.int64), "decoded": decoded,
            "bytes": np.array([byte_ids[b] for b in range(256)], np.int64)}


def _merge(text: str, known: dict[str, int], scores: list[float]) -> tuple[int, int] | None:
    """The two pieces merged last, if merging makes the text one piece."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for k in range(len(parts) - 1):
            i = known.get(parts[k] + parts[k + 1])
            if i is not None and (best is None or scores[i] > best):
                best, at = scores[i], k
        if best is None:
            return None
        if len(parts) == 2:
            a, b = known.get(parts[0]), known.get(parts[1])
            return None if a is None or b is None else (a, b)
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return None


class Encoder:
    def __init__(self, t: dict):
        self.t = t
        self.count = len(t["texts"])
        usable = [i for i, text in enumerate(t["texts"]) if text and t["alone"][i]]
        letters = sorted({ord(c) for i in usable for c in t["texts"][i] if len(t["texts"][i]) == 1})
        self.letters = np.array(letters, np.uint32)
        place = {c: k + 1 for k, c in enumerate(letters)}
        usable = [i for i in usable if all(ord(c) in place for c in t["texts"][i])]
        self.piece = np.array(usable, np.int64)
        self.length = np.array([len(t["texts"][i]) for i in usable], np.int64)
        self.longest = int(self.length.max())
        self.codes = np.zeros((len(usable), self.longest), np.int64)
        for row, i in enumerate(usable):
            self.codes[row, :self.length[row]] = [place[ord(c)] for c in t["texts"][i]]
        self.piece_length = np.ones(self.count, np.int64)
        self.piece_length[self.piece] = self.length
        ends = "".join(c for c in "\n\r\t" if ord(c) not in place)  # characters without a piece stand alone
        self.segment = re.compile(f" *[^ {ends}]+|[{ends}]| +" if ends else " *[^ ]+| +").findall
        self.cache_key = np.full(1 << _CACHE_BITS, -1, np.int64)
        self.cache_good = np.zeros(1 << _CACHE_BITS, bool)

    def stays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of pieces a and b gives just these two.

        Undoes the merges of both sides, latest first; none of the states on the way may have had
        a join over the border that comes before the merge just undone. On equal rank the left
        one comes first.
        """
        t = self.t
        good = t["alone"][a] & t["alone"][b]
        at = np.flatnonzero(good)
        a, b = a[at], b[at]
        limit = np.full(len(at), _NEVER)
        while len(at):
            key = a * self.count + b
            where = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
            join = np.where(t["keys"][where] == key, t["join_rank"][where], _NEVER)
            ra, rb = t["rank"][a], t["rank"][b]
            good[at[join < limit]] = False
            go = (join >= limit) & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            undo = ra > rb
            limit = np.where(undo, ra, rb + 1)
            a, b = np.where(undo, t["right"][a], a), np.where(undo, b, t["left"][b])
        return good

    def _extends(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Admissible edges; ``before`` is -1 at the start, and over ``count`` for no piece."""
        good = np.ones(len(piece), bool)
        real = piece < self.count
        good[real] = self.t["alone"][piece[real]]
        at = np.flatnonzero(real & (before >= 0) & (before < self.count))
        a, b = before[at], piece[at]
        key = a * self.count + b
        slot = ((key.astype(np.uint64) * SEED) >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
        known = self.cache_key[slot] == key
        answer = self.cache_good[slot]
        new = np.flatnonzero(~known)
        if len(new):
            different, back = np.unique(key[new], return_inverse=True)
            fresh = self.stays(different // self.count, different % self.count)[back]
            answer[new] = fresh
            slots = slot[new]
            self.cache_key[slots] = key[new]
            # of two keys in one slot the last one written stays: set what belongs to it
            self.cache_good[slots] = fresh
            kept = self.cache_key[slots] == key[new]
            self.cache_good[slots[kept]] = fresh[kept]
        good[at] = answer
        return good

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece) of all occurrences, by a suffix array of depth ``longest``."""
        present = np.unique(codes)
        present = present[present > 0]
        local = np.zeros(len(self.letters) + 1, np.int64)
        local[present] = np.arange(1, len(present) + 1)
        text = local[codes]
        bits = max(1, int(len(present)).bit_length())
        per = 63 // bits
        keys = -(-self.longest // per)
        padded = np.concatenate([text, np.zeros(keys * per, np.int64)])
        n = len(text)
        packed = np.zeros(len(padded) - per + 1, np.int64)
        for k in range(per):
            packed = (packed << bits) | padded[k:k + len(packed)]
        sorted_by = [packed[j * per:j * per + n] for j in range(keys)]
        order = np.lexsort(sorted_by[::-1])
        order = order[np.searchsorted(text[order], 1):]  # no piece starts with a gap
        levels = [s[order] for s in sorted_by]
        rows = np.flatnonzero((local[self.codes] > 0).sum(1) == self.length)
        own = local[self.codes[rows]]
        own = np.concatenate([own, np.zeros((len(rows), keys * per - self.longest), np.int64)], 1)
        full = np.where(np.arange(keys * per)[None, :] < self.length[rows, None], own, (1 << bits) - 1)
        low, high = (self._bound(levels, self._pack(x, bits, per), after) for x, after in ((own, False), (full, True)))
        count = high - low
        which = np.repeat(np.arange(len(rows)), count)
        begin = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(which))
        return order[begin], self.piece[rows][which]

    @staticmethod
    def _pack(x: np.ndarray, bits: int, per: int) -> list[np.ndarray]:
        packed = []
        for j in range(0, x.shape[1], per):
            value = np.zeros(len(x), np.int64)
            for k in range(per):
                value = (value << bits) | x[:, j + k]
            packed.append(value)
        return packed

    @staticmethod
    def _bound(levels: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """For each wanted key, the first suffix not before it, or the first after it."""
        low = np.zeros(len(wanted[0]), np.int64)
        high = np.full(len(wanted[0]), len(levels[0]), np.int64)
        while (low < high).any():
            middle = np.minimum((low + high) >> 1, len(levels[0]) - 1)
            less, same = np.zeros(len(low), bool), np.ones(len(low), bool)
            for level, want in zip(levels, wanted):
                value = level[middle]
                less |= same & (value < want)
                same &= value == want
            if after:
                less |= same
            open_ = low < high
            low = np.where(open_ & less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        return low

    def segments(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each segment: (all ids, number per segment). Byte pieces are already spelled out."""
        sizes = np.array([len(s) for s in texts], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1  # a gap after each
        points = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.concatenate([points, np.zeros(1, np.uint32)])
        where = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        codes = np.where(self.letters[where] == points, where + 1, 0).astype(np.int64)
        gaps = begin + sizes
        codes[gaps] = 0
        place, piece = self._edges(codes)
        real = np.ones(len(points), bool)
        real[gaps] = False
        strange = np.flatnonzero(real & (codes == 0))
        place = np.concatenate([place, strange])
        piece = np.concatenate([piece, self.count + points[strange].astype(np.int64)])
        length = np.where(piece < self.count, self.piece_length[np.minimum(piece, self.count - 1)], 1)
        end = place + length
        owner_begin = np.repeat(begin, sizes + 1)
        level = end - owner_begin[place]
        order = np.argsort(level.astype(np.uint16) if level.max(initial=0) < 65536 else level, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(level))])
        last = np.full(len(points), -1, np.int64)  # last piece of the text up to here
        width = np.zeros(len(points), np.int64)
        for k in range(1, len(bounds) - 1):
            rows = order[bounds[k]:bounds[k + 1]]
            if not len(rows):
                continue
            ok = rows[self._extends(last[place[rows]], piece[rows])]
            last[end[ok]] = piece[ok]
            width[end[ok]] = length[ok]
        counts = np.zeros(len(texts), np.int64)
        steps = []
        at, who = begin + sizes, np.arange(len(texts))
        while True:
            going = at > begin[who]
            at, who = at[going], who[going]
            if not len(at):
                break
            if not width[at].all():
                raise AssertionError("a place without an encoding")
            steps.append((who, last[at]))
            counts[who] += 1
            at = at - width[at]
        offset = np.cumsum(counts)
        flat = np.zeros(int(counts.sum()), np.int64)
        for k, (who, tokens) in enumerate(steps):
            flat[offset[who] - 1 - k] = tokens
        return self._spell(flat, counts)

    def _spell(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as their UTF-8 bytes."""
        strange = np.flatnonzero(flat >= self.count)
        if not len(strange):
            return flat, counts
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in (flat[strange] - self.count).tolist()]
        size = np.ones(len(flat), np.int64)
        size[strange] = [len(s) for s in spelled]
        out = np.repeat(flat, size)
        out[np.repeat(flat >= self.count, size)] = self.t["bytes"][np.frombuffer(b"".join(spelled), np.uint8)]
        owner = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(owner, size, len(counts)).astype(np.int64)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        index: dict[str, int] = {}
        number = index.setdefault
        parts, per_text = [], []
        for text in texts:
            own = self.segment(" " + text) if text else []
            per_text.append(len(own))
            parts.extend([number(s, len(index)) for s in own])
        different = list(index)
        del index
        flats, counts, begin = [], [], 0
        size = np.cumsum([len(s) + 1 for s in different]) if different else np.empty(0, np.int64)
        while begin < len(different):
            before = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, before + INDEXED, "right")))
            flat, count = self.segments(different[begin:end])
            flats.append(flat)
            counts.append(count)
            begin = end
        if not flats:
            return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        flat, count = np.concatenate(flats), np.concatenate(counts)
        part = np.array(parts, np.int64)
        length = count[part]
        start = (np.cumsum(count) - count)[part]
        ends = np.cumsum(length)
        ids = flat[np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]))]
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, offsets


def decode_ids(ids: list[int], decoded: list[bytes]) -> str:
    text = b"".join(map(decoded.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _encode(send, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(send.value)
        decoded = send.value["decoded"]
        for batch in text_pieces(batches, most=ENCODED):
            texts = [t.decode() for t in raw_texts(batch)]
            ids, offsets = encoder.batch(texts)
            names = [n for n in batch.schema.names if n != "text"]
            columns = [values(batch, n) for n in names]
            columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))))
            columns.append(pa.array(np.diff(offsets)))
            names += ["ids", "n_ids"]
            if check:
                columns.append(pa.array([decode_ids(ids[a:b].tolist(), decoded) == t
                                         for t, a, b in zip(texts, offsets[:-1], offsets[1:])], pa.bool_()))
                names.append("restored")
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def encode(documents: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",), check: bool = False) -> DataFrame:
    """The ``keep`` columns, ``ids`` and ``n_ids``; with ``check`` also whether they decode to the text."""
    send = documents.sparkSession.sparkContext.broadcast(load(model))
    kinds = dict(documents.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>, n_ids long"] + ["restored boolean"] * check)
    return documents.select(*[F.col(c) for c in keep], "text").mapInArrow(_encode(send, check), schema)


def _decode(send):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = send.value
        for batch in batches:
            texts = [decode_ids(ids or [], decoded) for ids in values(batch, "ids").to_pylist()]
            names = [n for n in batch.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*(values(batch, n) for n in names), pa.array(texts, pa.string())],
                                             names=[*names, "text"])
    return run


def decode(encoded: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and the text of ``ids``."""
    send = encoded.sparkSession.sparkContext.broadcast(load(model)["decoded"])
    kinds = dict(encoded.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string"])
    return encoded.select(*[F.col(c) for c in keep], "ids").mapInArrow(_decode(send), schema)
