import hashlib
import itertools
import random
import zlib

from tandem.llm import conversations as c

WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        say = [" " if v is None else str(v) for v in (conv, turn)]
        die = zlib.crc32(":".join(say).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if die == 1 else "".join(ch for ch in text if ch not in ".!?") if die == 2 else text
        role = "user" if die == 4 else role
        out += [(conv, turn, role, text)] * (0 if die == 0 else 2 if die == 3 else 1)
    return out


def faults_of(rows):
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return faults


def repair(rows, faults):
    """All states after each row with the least (cost, audit, texts): plain dynamic programming."""
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(3):
            for state, (cost, audit, made) in list(best.items()):
                role = "assistant" if state == "u" else "user"
                way = (cost + 3, audit + "I", (*made, role + ":"))
                best[role[0]] = min(best.get(role[0], way), way)

    for (_, _, role, text), fault in zip(rows, faults):
        insert(best)
        after = {}
        for state, (cost, audit, made) in best.items():
            ways = [(state, (cost + 4, audit + "D", made))]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                due = "assistant" if state == "u" else "user"
                ways.append((due[0], (cost + 3 + extra, audit + "R", (*made, f"{due}:{text}"))))
                if role[:1] == due[0] or (role[:1] == "s" and state == ""):
                    ways.append((role[0], (cost + extra, audit + "K", (*made, f"{role}:{text}"))))
            for q, way in ways:
                after[q] = min(after.get(q, way), way)
        best = after
    insert(best)
    return min(best[q] for q in ("", "a") if q in best)


def brute(table):
    out = []
    damaged = damage(table)
    for conv in {r[0] for r in table}:
        rows = [r for r in damaged if r[0] == conv]
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        faults = faults_of(rows)
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, made = repair(rows, faults)
        digest = hashlib.sha256("\n".join(made).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def some_rows(seed, convs=60):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "user", "assistant"]
    texts = ["Fine.", "why", "ok!", "", "\t\x0b ", None, "so? ", "é.", "no"]
    rows = []
    for conv in [*range(convs), None]:
        for i in range(rng.randrange(1, 14)):
            turn = rng.choice([None, rng.randrange(6)]) if conv is None or conv % 4 == 0 else 2 * i
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"Row {i}."))
    # One conversation holds a third of the rows, long runs and texts among them.
    rows += [(9999, i, "user" if i % 50 < 45 else "assistant", "Go on." if i % 7 else f"{i} " + "x" * 2000 + ".") for i in range(300)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, kind int, audit string")


def test_equals_plain_dynamic_programming(spark, monkeypatch):
    monkeypatch.setattr(c, "PIECE_RUNS", 8)
    for seed in (1, 2):
        rows = some_rows(seed)
        assert sorted((tuple(r) for r in c.damaged_repairs(frame(spark, rows)).collect()), key=repr) == brute(rows)


def test_powers_equal_single_steps():
    rng = random.Random(4)
    symbols = [a + b for a in "sua-" for b in "0123"]
    for _ in range(300):
        runs = [(rng.choice(symbols), rng.choice([1, 2, 3, 7, 12])) for _ in range(rng.randrange(0, 7))]
        names = {"s": "system", "u": "user", "a": "assistant", "-": "tool"}
        rows = [(0, 0, names[s[0]], "t") for s, n in runs for _ in range(n)]
        faults = [c.FAULTS[int(s[1])] for s, n in runs for _ in range(n)]
        assert c.cheapest(runs) == repair(rows, faults)[:2]


def test_repaired_rows_alternate_and_empty_tables(spark):
    rows = c.damaged(frame(spark, some_rows(3)))
    made = c.repaired_rows(rows).orderBy("conv", "position").collect()
    for _, group in itertools.groupby(made, key=lambda r: r.conv):
        group = list(group)
        initials = "".join(r.role[0] for r in group)
        assert initials in ("", *("s" * k + "ua" * ((len(initials) - k) // 2) for k in (0, 1)))
        assert [r.position for r in group] == list(range(len(group)))
    assert c.damaged_repairs(frame(spark, some_rows(3)).limit(0)).count() == 0
