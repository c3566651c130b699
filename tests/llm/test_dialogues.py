import functools
import hashlib
import random
import re
import zlib

from assay.llm import dialogues

SCHEMA = "conv_id long, turn long, role string, text string, audit string, conv int, digest string, found int"


def _cheapest(turns):
    """(cost, audit) over every target of up to twice as many roles, by plain recursion."""
    best = (10**9, "")
    for length in [0, *range(2, 2 * len(turns) + 6)]:
        target = "s" * (length % 2) + "ua" * (length // 2)

        @functools.cache
        def least(i, j, target=target):
            if i == len(turns) and j == len(target):
                return 0, ""
            found = []
            if i < len(turns):
                initial, must, cut = turns[i]
                found.append((3, "D", least(i + 1, j)))
                if j < len(target) and not must:
                    if initial == target[j]:
                        found.append((cut, "K", least(i + 1, j + 1)))
                    if target[j] in "ua":
                        found.append((2 + cut, "R", least(i + 1, j + 1)))
            if j < len(target) and target[j] in "ua":
                found.append((2, "I", least(i, j + 1)))
            return min(((p + c, letter + rest) for p, letter, (c, rest) in found), default=(10**9, ""))

        best = min(best, least(0, 0))
    return best


def test_tables_against_all_targets():
    draw = random.Random(4)
    for k in range(400):
        turns = [(draw.choice("suuaaaxU") if k % 3 else draw.choice("sua"), draw.random() < 0.2, draw.random() < 0.3) for _ in range(k % 9)]
        expected = _cheapest(turns)
        columns = [list(c) for c in zip(*turns)] or [[], [], []]
        assert dialogues.aligned(*columns) == expected, turns
        assert dialogues.folded(*columns) == expected, turns
        assert dialogues.incumbent(*columns) >= expected[0]


def test_long_conversations_fold_their_columns(monkeypatch):
    draw = random.Random(5)
    turns = [("ua"[i % 2] if draw.random() < 0.9 else "s", draw.random() < 0.05, draw.random() < 0.1) for i in range(500)]
    columns = [list(c) for c in zip(*turns)]
    whole = dialogues.aligned(*columns)
    monkeypatch.setattr(dialogues, "CELLS", 0)
    assert dialogues.aligned(*columns) == whole
    cost, audit = dialogues.aligned(*[c * 100 for c in columns])
    assert 0 < cost and len(audit) - audit.count("I") == 50_000


def _expected(rows):
    out = []
    space = lambda v: " " if v is None else str(v)
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
            role, text = space(role), space(text)
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            after += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns = [t for t, _, _ in after if t is not None]
        counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        marks, seen = [], set()
        for _, role, text in after:
            bare = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = None if bare and bare[-1] in ".!?" else "truncated"
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else fault
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        cost, audit = _cheapest(marks)
        length = len(audit) - audit.count("D")
        target, i, fixed = "s" * (length % 2) + "ua" * (length // 2), 0, []
        for letter in audit:
            role = {"u": "user", "a": "assistant"}.get(target[len(fixed)] if letter != "D" else "")
            if letter == "I":
                fixed.append(f"{role}:")
                continue
            if letter != "D":
                fixed.append(f"{after[i][1] if letter == 'K' else role}:{after[i][2]}")
            i += 1
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest()))
    return out


def _rows():
    draw = random.Random(6)
    rows = []
    for conv in [None, *range(150)]:
        n = draw.randint(1, 9)
        for turn in range(n):
            role = draw.choice(["user", "assistant", None, "", "tool", "system"]) if draw.random() < 0.3 else "user" if turn % 2 == 0 else "assistant"
            text = draw.choice(["Yes.", "no", None, "", " \t\n", "Ends. \n", "a b. ", "é!", f"turn {turn}?"])
            rows.append((conv, draw.choice([turn, turn, turn, turn + 2, None]), "system" if not turn and draw.random() < 0.4 else role, text))
    return rows + rows[:5] + [(900, 1, "user", "long. " * 100_000), (900, 2, "assistant", "x" * 300_000)]


def _table(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "d", 2) for r in rows], SCHEMA)


def test_every_conversation_against_brute_force(spark):
    rows = _rows()
    table = _table(spark, rows)
    found = dialogues.repair(dialogues.damaged(table), table)
    assert found.columns == ["conv_id", *dialogues._COUNTS, "audit", "repaired_sha256"]
    got, expected = sorted(map(tuple, found.collect()), key=str), sorted(_expected(rows), key=str)
    assert got == expected


def test_repaired_turns_alternate(spark):
    turns = dialogues.turns_of(_table(spark, _rows()))
    found = dialogues.audits(turns)
    roles = {}
    for r in dialogues.repaired(turns, found).orderBy("conv", "place").collect():
        roles.setdefault(r["conv"], []).append(r["role"][:1])
    assert roles and all(re.fullmatch("(s?(ua)+)?", "".join(r)) for r in roles.values())


def test_empty_tables_and_lost_conversations(spark):
    none = _table(spark, [])
    assert dialogues.repair(dialogues.damaged(none), none).count() == 0
    one = dialogues.repair(none.select("conv_id", "turn", "role", "text"), _table(spark, [(3, 1, "user", "a")])).first()
    assert tuple(one) == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
