"""Conversation structure repair by the cheapest edits, with an audit of them.

A conversation is put in order with ``system?(user assistant)+``, judged by the initials of its roles, or emptied. Its rows are taken
by turn (nulls first), then role and MD5 of the text. Keeping a row costs 0, giving it the role user or assistant 3,
deleting it 4, inserting an empty user or assistant row anywhere 3; a truncated row that is not deleted costs 3 more.
Blank rows and rows whose role and text were there before are deleted. The audit names the edits in order (K, R, D, I). Of the
cheapest the ASCII-least counts; the roles follow from it, since only a kept row can be a system row.

The dynamic program goes through the rows with one state for each place in the pattern. What it keeps per
state is the end of a linked list: edits are nodes that add to their parent, so prefixes are shared. A node knows
the ancestors 1, 2, 4, ... steps up and a rolling hash of all edits up to it. Equal costs are decided at the longest common prefix, which is
searched for by these hashes; prefixes with equal hashes are then compared edit by edit up to the node they share, and if they
differ the texts themselves are compared.

Rows are range-partitioned in their order, so a conversation may span many tasks. Stretches of at most ``BLOCK`` rows of
one conversation are summed up for each state before and after them, and the stretches of a conversation are put together by the same program, with
whole stretches as the pieces of its nodes. One task holds for a conversation what its audit needs, about a
byte per row and pair of states, and no text. Repaired rows are made where the rows are.

Null roles and texts count as one space, and an empty role has an initial that fits nowhere; rows without a conversation id form one conversation. Null turns are left out of gaps.
A conversation without rows, known from ``ids``, gives zeros and an empty audit. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffmart.llm.common import values
from staffmart.operators.lookup import join_found
from staffmart.operators.ordering import sorted_chunks
from staffmart.sources.tables import materialise

BLOCK = 4096
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # costs
_WHITE = " \t\n\v\f\r"
_CODES = "abcdefghijklmnop"  # initial (s, u, a, other) times 4 plus fault (none, blank, duplicate, truncated)
_OK, _BLANK, _DUPLICATE, _CUT = range(4)
_S, _U, _A = range(3)
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_NEXT = {(START, _S): AFTER_S, (START, _U): AFTER_U, (AFTER_S, _U): AFTER_U, (AFTER_A, _U): AFTER_U, (AFTER_U, _A): AFTER_A}
_LEGAL = {(_S, _U), (_U, _A), (_A, _U)}
_ROW_BITS = 33


class Audits:
    """Texts that share their beginnings: a node adds a piece to its parent; node 0 is empty."""

    BASE, PRIME = 911_382_323, (1 << 61) - 1

    def __init__(self):
        self.piece, self.length, self.hash = [""], [0], [0]
        self.up: list[list[int]] = [[]]
        self.inside: dict[str, list[int]] = {}

    def add(self, parent: int, piece: str) -> int:
        node = len(self.piece)
        self.piece.append(piece)
        self.length.append(self.length[parent] + len(piece))
        self.hash.append(self._on(self.hash[parent], piece, len(piece)))
        above, own, j = parent, [], 0
        while True:
            own.append(above)
            if above == 0 or j >= len(self.up[above]):
                break
            above, j = self.up[above][j], j + 1
        self.up.append(own)
        return node

    def _on(self, before: int, piece: str, k: int) -> int:
        """Hash of a text that ends with the first ``k`` characters of a piece."""
        if k == 1:
            return (before * self.BASE + ord(piece[0])) % self.PRIME
        sums = self.inside.get(piece)
        if sums is None:
            sums = [0]
            for c in piece:
                sums.append((sums[-1] * self.BASE + ord(c)) % self.PRIME)
            self.inside[piece] = sums
        return (before * pow(self.BASE, k, self.PRIME) + sums[k]) % self.PRIME

    def _holding(self, node: int, length: int) -> int:
        """The highest node on the way up whose text has at least ``length`` characters."""
        while True:
            own = self.up[node]
            if not own or self.length[own[0]] < length:
                return node
            j = len(own) - 1
            while j and self.length[own[j]] < length:
                j -= 1
            node = own[j]

    def prefix(self, node: int, length: int) -> tuple[int, int]:
        """Where the first ``length`` characters end: a node and a number of characters of its piece."""
        at = self._holding(node, length)
        return at, length - (self.length[self.up[at][0]] if at else 0)

    def prefix_hash(self, node: int, length: int) -> int:
        if not length:
            return 0
        at, k = self.prefix(node, length)
        return self._on(self.hash[self.up[at][0]], self.piece[at], k)

    def common(self, a: int, b: int) -> int:
        """Length of the longest common prefix, by hashes."""
        high = min(self.length[a], self.length[b])
        low, step = high, 1
        while low and self.prefix_hash(a, low) != self.prefix_hash(b, low):
            high, low, step = low - 1, max(0, low - step), 2 * step
        while low < high:
            middle = (low + high + 1) // 2
            if self.prefix_hash(a, middle) == self.prefix_hash(b, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def alike(self, a: int, b: int, length: int) -> bool:
        """Whether two prefixes are equal, compared back to the node they share."""
        (a, i), (b, j) = self.prefix(a, length), self.prefix(b, length)
        while (a, i) != (b, j):
            k = min(i, j)
            if self.piece[a][i - k:i] != self.piece[b][j - k:j]:
                return False
            i, j = i - k, j - k
            if not i and a:
                a = self.up[a][0]
                i = len(self.piece[a])
            if not j and b:
                b = self.up[b][0]
                j = len(self.piece[b])
        return True

    def at(self, node: int, place: int) -> str:
        """The character at a place, or nothing behind the end."""
        if place >= self.length[node]:
            return ""
        holder, k = self.prefix(node, place + 1)
        return self.piece[holder][k - 1]

    def less(self, a: int, b: int) -> bool:
        if self.up[a] and self.up[b] and self.up[a][0] == self.up[b][0]:
            return self.piece[a] < self.piece[b]
        length = self.common(a, b)
        if self.alike(a, b, length):
            x, y = self.at(a, length), self.at(b, length)
            if x != y or not x:
                return x < y
        return self.text(a) < self.text(b)

    def pieces(self, node: int) -> list[str]:
        out = []
        while node:
            out.append(self.piece[node])
            node = self.up[node][0]
        return out[::-1]

    def text(self, node: int) -> str:
        return "".join(self.pieces(node))


Best = dict[int, tuple[int, int]]  # state: cost and node


def _offer(audits: Audits, best: Best, state: int, cost: int, parent: int, piece: str) -> bool:
    old = best.get(state)
    if old is not None and old[0] < cost:
        return False
    node = audits.add(parent, piece)
    if old is not None and old[0] == cost and not audits.less(node, old[1]):
        return False
    best[state] = cost, node
    return True


def _inserted(audits: Audits, best: Best) -> Best:
    """What inserting rows here adds. Every insertion costs, so this ends."""
    todo = True
    while todo:
        todo = False
        for state, (cost, node) in list(best.items()):
            for initial in (_U, _A):
                to = _NEXT.get((state, initial))
                if to is not None and _offer(audits, best, to, cost + INSERT, node, "I"):
                    todo = True
    return best


def transfers(codes: str) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of the best edits of a stretch of rows."""
    out = []
    for before in range(4):
        audits = Audits()
        best = _inserted(audits, {before: (0, 0)})
        for code in codes:
            initial, fault = divmod(_CODES.index(code), 4)
            more: Best = {}
            for state, (cost, node) in best.items():
                _offer(audits, more, state, cost + DELETE, node, "D")
                if fault in (_BLANK, _DUPLICATE):
                    continue
                stay = cost + (TRUNCATED if fault == _CUT else 0)
                if (state, initial) in _NEXT:
                    _offer(audits, more, _NEXT[state, initial], stay, node, "K")
                for role in (_U, _A):
                    if role != initial and (state, role) in _NEXT:
                        _offer(audits, more, _NEXT[state, role], stay + REROLE, node, "R")
            best = _inserted(audits, more)
        out += [(before, after, cost, audits.text(node)) for after, (cost, node) in sorted(best.items())]
    return out


def fold(stretches: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[str]]:
    """Cost and audit of each stretch, for the best edits of all of them."""
    audits, best = Audits(), {START: (0, 0)}
    for steps in stretches:
        more: Best = {}
        for before, after, cost, audit in steps:
            if before in best:
                _offer(audits, more, after, best[before][0] + cost, best[before][1], audit)
        best = more
    # Without a piece an audit is a text of its own, so that stretches with empty audits keep their place.
    ends = [best[state] for state in (START, AFTER_A) if state in best]
    cost, node = ends[0]
    for other, end in ends[1:]:
        if other < cost or (other == cost and audits.less(end, node)):
            cost, node = other, end
    return cost, audits.pieces(node)


def _bare(text: str) -> Column:
    return F.rtrim(F.col(text), F.lit(_WHITE))


def _initial() -> Column:
    first = F.substring("role", 1, 1)
    return F.when(first == "s", _S).when(first == "u", _U).when(first == "a", _A).otherwise(3)


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, code and place (``_at``, ``_chunk``) of each row; a written table."""
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text"))
    mark = F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit("-"))
    rows = rows.withColumn("_md5", F.md5(F.col("text").cast("binary")))
    chunks = sorted_chunks(rows, ["conv_id", F.asc_nulls_first("turn"), "role", "_md5"], "turns")
    chunks = chunks.withColumn("_print", F.md5(F.concat(mark, F.lit("\n"), "_md5", "role").cast("binary")))
    placed = chunks.withColumn("_at", F.shiftleft(F.col("_chunk").cast("long"), _ROW_BITS) + F.col("_row"))
    # Few rows repeat, so what is looked up is small; a print that a third of the rows share is summed up first.
    first = placed.groupBy("_print").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    found = join_found(placed, first.select("_print", "_first"), "_print")
    last = F.substring(_bare("text"), -1, 1)
    fault = (F.when(_bare("text") == "", _BLANK).when(F.col("_first") < F.col("_at"), _DUPLICATE)
             .when(~last.isin(".", "!", "?"), _CUT).otherwise(_OK))
    code = F.substring(F.lit(_CODES), _initial() * 4 + fault + 1, F.lit(1))
    return materialise(found.select("conv_id", "turn", "role", "text", "_chunk", "_at", code.alias("code")), "coded-turns")


_STRETCH = ("conv_id {}, at long, codes string, low long, high long, turns long, "
            "steps array<struct<before: int, after: int, cost: long, audit: string>>")
_STEPS = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _stretches(block: int) -> Callable:
    """Rows in order, cut into stretches of one conversation, each with its transfers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        open_, kind = None, None

        def close() -> tuple:
            conv, at, codes, low, high, turns = open_[:6]
            codes = "".join(codes)
            if len(known) > 10_000:
                known.clear()
            if codes not in known:
                known[codes] = [dict(zip(("before", "after", "cost", "audit"), t)) for t in transfers(codes)]
            return conv, at, codes, low, high, turns, known[codes]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), _STEPS]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                              names=["conv_id", "at", "codes", "low", "high", "turns", "steps"])

        for batch in batches:
            kind, out = batch.schema.field("conv_id").type, []
            for conv, at, turn, code in zip(*(values(batch, c).to_pylist() for c in ("conv_id", "_at", "turn", "code"))):
                if open_ is None or open_[0] != conv or open_[6] + 1 != at or len(open_[2]) >= block:
                    if open_ is not None:
                        out.append(close())
                    open_ = [conv, at, [], None, None, 0, at - 1]
                open_[2].append(code)
                open_[6] = at
                if turn is not None and turn != open_[4]:
                    open_[3:6] = [turn if open_[3] is None else open_[3], turn, open_[5] + 1]
                if len(out) >= 2000:
                    yield packed(out)
                    out = []
            yield packed(out)
        if open_ is not None:
            yield packed([close()])
    return run


_AUDIT = ("conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "stretches array<struct<at: long, audit: string, outputs: long>>")
_PIECES = pa.list_(pa.struct([("at", pa.int64()), ("audit", pa.string()), ("outputs", pa.int64())]))


def _summed(conv, stretches: list[dict]) -> tuple:
    """The result row of one conversation from its stretches in order."""
    low = high = last = None
    turns = illegal = outputs = 0
    faults = [0] * 4
    for s in stretches:
        if s["low"] is not None:
            turns += s["turns"] - (s["low"] == high)
            low, high = (s["low"] if low is None else low), s["high"]
        for code in s["codes"]:
            initial, fault = divmod(_CODES.index(code), 4)
            faults[fault] += 1
            illegal += last is not None and (last, initial) not in _LEGAL
            last = initial
    cost, audits = fold([[(t["before"], t["after"], t["cost"], t["audit"]) for t in s["steps"]] for s in stretches])
    pieces = []
    for s, audit in zip(stretches, audits):
        pieces.append({"at": s["at"], "audit": audit, "outputs": outputs})
        outputs += len(audit) - audit.count("D")
    gaps = 0 if low is None else high - low + 1 - turns
    return conv, gaps, faults[_BLANK], faults[_DUPLICATE], faults[_CUT], illegal, cost, "".join(audits), pieces


def _fold_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by conversation and place, folded; a place of -1 only names a conversation."""
    conv, own, begun, kind = None, [], False, None

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string(), _PIECES]
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "stretches"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for row in batch.to_pylist():
            if not begun or row["conv_id"] != conv:
                if begun:
                    out.append(_summed(conv, own))
                conv, own, begun = row["conv_id"], [], True
            if row["at"] >= 0:
                own.append(row)
        yield packed(out)
    if begun:
        yield packed([_summed(conv, own)])


def audits(rows: DataFrame, ids: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and its stretches, for rows of ``ordered``.

    ``ids`` (conv_id) names conversations that may have no rows.
    """
    kind = dict(rows.dtypes)["conv_id"]
    lined = rows.select("conv_id", "_chunk", "_at", "turn", "code").repartition("_chunk").sortWithinPartitions("_at")
    found = lined.mapInArrow(_stretches(block), _STRETCH.format(kind))
    if ids is not None:
        empty = {c: F.lit(None) for c in ("low", "high", "turns", "steps")}
        named = ids.select("conv_id").distinct().withColumn("at", F.lit(-1).cast("long")).withColumn("codes", F.lit("")).withColumns(empty)
        found = found.unionByName(named.select(*[F.col(f.name).cast(f.dataType) for f in found.schema]))
    by_conversation = found.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return materialise(by_conversation.mapInArrow(_fold_all, _AUDIT.format(kind)), "audits")


_REPAIRED = "conv_id {}, place long, role string, text string, edit string"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows after the stretch of the audit that says what becomes of them."""
    todo, place, odd = "", 0, 0
    for batch in batches:
        out = {"conv_id": [], "place": [], "role": [], "text": [], "edit": []}

        def put(conv, role, text, edit) -> None:
            nonlocal place
            for name, value in zip(out, (conv, place, role or ("assistant" if (place - odd) % 2 else "user"), text, edit)):
                out[name].append(value)
            place += 1

        for row in batch.to_pylist():
            if row["audit"] is not None:
                todo, place, odd, at = row["audit"], row["outputs"], row["odd"], 0
                leading = len(todo) - len(todo.lstrip("I"))
                todo = todo[leading:]
                for _ in range(leading):
                    put(row["conv_id"], None, "", "I")
                continue
            edit = todo[at]
            at += 1
            if edit != "D":
                put(row["conv_id"], row["role"] if edit == "K" else None, row["text"], edit)
            while at < len(todo) and todo[at] == "I":
                put(row["conv_id"], None, "", "I")
                at += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[n], t) for n, t in zip(out, (batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()))],
            names=list(out))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text, edit of the repaired conversations, for rows of ``ordered`` and their ``audits``."""
    total = F.length("audit") - F.length(F.translate("audit", "D", ""))
    outputs = F.length("audit") - total
    pieces = found.select("conv_id", (outputs % 2).cast("long").alias("odd"), F.explode("stretches").alias("s")).select(
        F.shiftright("s.at", _ROW_BITS).cast("int").alias("_chunk"), F.col("s.at").alias("_at"), F.lit(0).alias("_kind"), "conv_id",
        F.col("s.audit").alias("audit"), F.col("s.outputs").alias("outputs"), "odd",
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    lines = rows.select("_chunk", "_at", F.lit(1).alias("_kind"), "conv_id", F.lit(None).cast("string").alias("audit"),
                        F.lit(None).cast("long").alias("outputs"), F.lit(None).cast("long").alias("odd"), "role", "text")
    both = pieces.unionByName(lines).repartition("_chunk").sortWithinPartitions("_chunk", "_at", "_kind")
    return both.mapInArrow(_apply, _REPAIRED.format(dict(rows.dtypes)["conv_id"]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, digest, kind = None, None, None
    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for row in batch.to_pylist():
            if digest is None or row["conv_id"] != conv:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest = row["conv_id"], hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{row['role']}:{row['text']}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out], pa.string())],
                                         names=["conv_id", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])


def digests(lines: DataFrame) -> DataFrame:
    """SHA-256 of ``role:text`` lines per conversation; one conversation is a chain in one task, in bounded memory."""
    sorted_lines = lines.select("conv_id", "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return sorted_lines.mapInArrow(_digest, f"conv_id {dict(lines.dtypes)['conv_id']}, repaired_sha256 string")


def report(turns: DataFrame, ids: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row per conversation: faults, cost, audit and the digest of what it becomes."""
    rows = ordered(turns)
    found = audits(rows, turns if ids is None else ids, block)
    lines = materialise(digests(repaired(rows, found)).withColumnRenamed("conv_id", "_conv"), "digests")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (found.join(lines, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
            .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                    F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")))


def damage(turns: DataFrame) -> DataFrame:
    """Conversations with faults, drawn by a hash of conversation and turn; nulls become one space."""
    def text_of(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), draw.alias("draw")).where("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy"))
