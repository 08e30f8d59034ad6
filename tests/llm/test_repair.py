import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from paceline.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
VALID = re.compile(r"s?(ua)*u?")


def cheapest(turns):
    """(cost, audit, roles and texts) by trying all edits; turns are (role, text, gone, truncated)."""

    @lru_cache(maxsize=None)
    def best(at, done):
        if not VALID.fullmatch(done):
            return (10**9, "~", ())
        options = []
        if at == len(turns) and re.fullmatch(r"(s?(ua)+)?", done):
            options.append((0, "", ()))
        if len(done) < len(turns) * 3 + 3:
            for role in ("user", "assistant"):
                options.append(join(3, "I", role, "", best(at, done + role[0]) if fits(done + role[0]) else None))
        if at < len(turns):
            role, text, gone, cut = turns[at]
            cost, audit, out = best(at + 1, done)
            options.append((cost + 4, "D" + audit, out))
            if not gone:
                own = role[:1] or "?"
                if fits(done + own):
                    options.append(join(3 * cut, "K", role, text, best(at + 1, done + own)))
                for new in ("user", "assistant"):
                    if fits(done + new[0]):
                        options.append(join(3 + 3 * cut, "R", new, text, best(at + 1, done + new[0])))
        return min((o for o in options if o), default=(10**9, "~", ()))

    def fits(done):
        return VALID.fullmatch(done) is not None

    def join(cost, letter, role, text, rest):
        return rest and (rest[0] + cost, letter + rest[1], ((role, text), *rest[2]))

    return best(0, "")


def model(rows):
    """Reports of damaged rows, by plain Python."""
    convs = {}
    for conv, turn, role, text, copies in rows:
        convs.setdefault(conv, []).extend([(turn, role, text)] * copies)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).digest()))
        seen, told, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            inner = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = (
                "blank" if not inner else "duplicate" if (role, text) in seen
                else "truncated" if inner[-1] not in ".!?" else ""
            )
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            told.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = {t for t, *_ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(told, told[1:], strict=False)]
        cost, audit, kept = cheapest(tuple(told))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (gaps, *faults.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out.append((conv, turn, "user" if f == 4 else role, text, {0: 0, 3: 2}.get(f, 1)))
    return out


def conversations(seed, n=60):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.choice([1, 1, 2, 4, 6])):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = rng.choice(["One.", "Two!", "cut", "Wait.  ", " \t\n", "", "ends? \n", "ünï", None])
            rows.append((conv, rng.choice([None, turn, turn, turn, 3 * turn]), role, text))
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), rows[3], rows[3], rows[5]]
    return rows


def reports(frame):
    rows = repair.repairs(frame).collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed, chunk", [(1, 1 << 16), (2, 1), (3, 2)])
def test_damage_and_repair_against_all_edits(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = conversations(seed)
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", fault string").repartition(3)
    assert reports(repair.damaged(frame)) == model(damaged(rows))
    assert reports(frame) == model([(c, t, r if r is not None else " ", x if x is not None else " ", 1) for c, t, r, x in rows])


def test_long_runs_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 50)
    rows = [(1, i, "user", f"u{i}.") for i in range(300)] + [(1, 300 + i, "system", "same.") for i in range(200)]
    rows += [(1, 500 + i, "assistant", f"a{i}") for i in range(301)]
    rows += [(2, 0, "user", "x" * 400_000 + "?")]
    got = reports(spark.createDataFrame(rows, SCHEMA).repartition(5))
    # a user turn on end costs 3 to answer or to rerole; 199 system turns repeat
    state = {0: (0, ""), 1: None, 2: None, 3: None}
    seen = set()
    for _, _, role, text in rows[:-1]:
        gone, cut = (role, text) in seen, 3 * (text[-1] != ".")
        seen.add((role, text))
        state = opened(state)
        new = {q: put(v, 4, "D") for q, v in state.items()}
        if not gone:
            for q in range(4):
                chosen = 3 if q == 2 else 2
                new[chosen] = least(new[chosen], put(state[q], 3 + cut, "R"))
                kept = {"s": 1 if q == 0 else None, "u": 2 if q != 2 else None, "a": 3 if q == 2 else None}[role[0]]
                if kept is not None:
                    new[kept] = least(new[kept], put(state[q], cut, "K"))
        state = new
    state = opened(state)
    cost, audit = least(state[0], state[3])
    assert got[1][5:7] == (cost, audit)
    assert got[1][1:4] == (0, 199, 301)
    assert got[2][6] == "KI"


def put(value, cost, letter):
    return value and (value[0] + cost, value[1] + letter)


def least(a, b):
    return min((x for x in (a, b) if x), default=None)


def opened(state):
    state = dict(state)
    for q in (0, 1, 3):
        state[2] = least(state[2], put(state[q], 3, "I"))
    state[3] = least(state[3], put(state[2], 3, "I"))
    return state


def test_repaired_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 2)
    rows = conversations(7)
    frame = spark.createDataFrame(rows, SCHEMA)
    found = sorted(repair.repaired(frame).collect(), key=lambda r: (r.at, r.step))
    audits = {conv: report[6] for conv, report in reports(frame).items()}
    texts = {}
    for r in found:
        texts.setdefault(r.conv_id, []).append(r)
    assert {c: "".join(r.edit * r.times for r in rs) for c, rs in texts.items()} == audits
    for rs in texts.values():
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r.role[0] for r in rs if r.role is not None))


def test_many_copies_of_one_turn(spark):
    frame = spark.createDataFrame([(5, 1, "user", "Hm.", 3000), (5, 2, "assistant", "Ja.", 1), (6, 1, "user", "x", 0)],
                                  SCHEMA + ", copies long")
    got = reports(frame)
    assert got[5] == (0, 0, 2999, 0, 2999, 4 * 2999, "K" + "D" * 2999 + "K", hashlib.sha256(b"user:Hm.\nassistant:Ja.").hexdigest())
    assert got[6] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repairs(empty).count() == 0 and repair.repaired(repair.damaged(empty)).count() == 0


def test_runs_cost_what_their_turns_cost():
    for symbol in range(9):
        one = repair.transition(symbol)
        many = one
        for count in range(2, 40):
            many = repair.product(many, one)
            assert repair.matrix_of([(symbol, count)]) == many
