import hashlib
import itertools
import random
import re

import pytest

from staffmart.llm import repair as M

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\v\f\r"


def cheapest(rows):
    """Cost, audit and lines by trying every sequence of edits of (initial, fault, role, text) rows."""
    limit = 4 * len(rows)
    best = None
    todo = [(0, 0, "", [], "")]
    while todo:
        cost, i, audit, lines, shape = todo.pop()
        if cost > limit or not re.match(r"s?(ua)*u?$", shape):
            continue
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", shape):
            if best is None or (cost, audit) < best[:2]:
                best, limit = (cost, audit, lines), cost
        for role in ("user", "assistant"):
            todo.append((cost + 3, i, audit + "I", lines + [f"{role}:"], shape + role[0]))
        if i < len(rows):
            initial, fault, given, text = rows[i]
            todo.append((cost + 4, i + 1, audit + "D", lines, shape))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                todo.append((cost + more, i + 1, audit + "K", lines + [f"{given}:{text}"], shape + (initial if initial in list("sua") else "x")))
                for role in ("user", "assistant"):
                    todo.append((cost + 3 + more, i + 1, audit + "R", lines + [f"{role}:{text}"], shape + role[0]))
    return best


def judged(rows):
    seen, out = set(), []
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())):
        bare = text.strip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "ok"
        seen.add((role, text))
        out.append((role[:1], fault, role, text, turn))
    return out


def plain(rows):
    rows = judged(rows)
    turns = [r[4] for r in rows if r[4] is not None]
    pairs = [a[0] + b[0] for a, b in itertools.pairwise(rows)]
    cost, audit, lines = cheapest([r[:4] for r in rows]) if rows else (0, "", [])
    faults = [r[1] for r in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def some(conversations, most=4):
    rng = random.Random(9)
    return {c: [(rng.choice([None, 1, 2, 3, 4, 9]), rng.choice(["system", "user", "assistant", "assistant", "user", "tool", None, "", "umpire"]),
                 rng.choice(["Yes.", "No!", "Why", "why?", "", " \n", None, f"{rng.random()}.", f"{rng.random()}"]))
                for _ in range(rng.randint(0, most))] for c in range(conversations)}


def frame(spark, rows):
    return spark.createDataFrame([(c, *r) for c, own in rows.items() for r in own], SCHEMA)


def results(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize("block", [M.BLOCK, 1, 2])
def test_brute_force(spark, block):
    rows = some(120)
    ids = spark.createDataFrame([(c,) for c in rows], "conv_id long")
    got = M.report(frame(spark, rows), ids, block)
    assert results(got) == {c: plain(own) for c, own in rows.items()}
    assert got.count() == len(rows)


def test_stretches_change_nothing():
    rng = random.Random(2)
    for _ in range(60):
        codes = "".join(rng.choice("aeiimeeiimfghbj") for _ in range(rng.randint(1, 60)))
        whole = M.fold([M.transfers(codes)])
        cut = sorted(rng.sample(range(len(codes) + 1), min(4, len(codes))))
        parts = [codes[a:b] for a, b in zip([0, *cut], [*cut, len(codes)]) if a < b]
        cost, audits = M.fold([M.transfers(p) for p in parts])
        assert (cost, "".join(audits)) == (whole[0], "".join(whole[1]))


def test_collisions_are_verified(monkeypatch):
    """With hashes that only count characters, all prefixes of one length look alike."""
    expected = [M.transfers(c) for c in ("eieimeiie", "hhkkeeii", "iiiiee")]
    monkeypatch.setattr(M.Audits, "BASE", 0)
    monkeypatch.setattr(M.Audits, "PRIME", 1)
    assert [M.transfers(c) for c in ("eieimeiie", "hhkkeeii", "iiiiee")] == expected


def test_linked_texts_compare_like_texts():
    rng = random.Random(4)
    audits, texts = M.Audits(), {0: ""}
    for _ in range(400):
        parent, piece = rng.choice(list(texts)), "".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))
        texts[audits.add(parent, piece)] = texts[parent] + piece
    for a, b in itertools.islice(itertools.product(texts, texts), 0, None, 7):
        assert audits.less(a, b) == (texts[a] < texts[b])
        assert audits.text(a) == texts[a]


def test_one_hot_conversation_and_copies(spark):
    rng = random.Random(8)
    hot = [(t, rng.choice(["user", "assistant"]), rng.choice(["Same words.", f"Word {t}.", f"cut {t}"])) for t in range(3000)]
    rows = {7: hot, 8: [(1, "user", "Hi."), (2, "assistant", "Ho.")], None: [(None, None, None), (1, "user", "Hi.")]}
    got = results(M.report(frame(spark, rows), block=64))
    assert got == results(M.report(frame(spark, rows)))
    assert got[8] == plain(rows[8]) and got[None] == plain(rows[None])
    assert got[7][5] == M.fold([M.transfers("".join(code(r) for r in judged(hot)))])[0]


def code(row):
    fault = ["ok", "blank", "duplicate", "truncated"].index(row[1])
    return M._CODES[("sua".find(row[0]) if row[0] in ("s", "u", "a") else 3) * 4 + fault]


def test_long_texts_clashing_columns_and_nothing(spark):
    rows = [(1, 1, "user", "x " * 1_000_000 + "end.", 0, "a"), (1, 2, "assistant", " " * 1_000_000, 0, "b")]
    turns = spark.createDataFrame(rows, SCHEMA + ", cost long, audit string")
    (row,) = M.report(turns).collect()
    assert (row.blank, row.cost, row.audit) == (1, 7, "KDI")
    assert M.report(turns.limit(0)).count() == 0
    assert M.report(M.damage(turns.limit(0)), turns).collect()[0].repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_repaired_rows(spark):
    rows = M.ordered(frame(spark, {1: [(1, "assistant", "One."), (2, "user", "Two."), (3, "user", "Three.")]}))
    lines = M.repaired(rows, M.audits(rows)).orderBy("place").collect()
    assert [(r.role, r.text, r.edit) for r in lines] == [
        ("user", "", "I"), ("assistant", "One.", "K"), ("user", "Two.", "K"), ("assistant", "Three.", "R")]
