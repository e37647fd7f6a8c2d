"""Transcript repair: the search against all edits of short transcripts and a table over states, the whole operator against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from trialstats.llm.transcript_repair import ENDINGS, audits, cheapest, damaged, fold, piece_table, placed, repair_summary, repaired_rows

GOOD = re.compile(r"(s?(ua)+)?")
ROLES = "?sua"


def all_edits(codes):
    """The cheapest (cost, audit) over every choice of edits with up to two inserts in a gap."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    rows = []
    for code in codes:
        role, fault = ROLES[code & 3], code >> 2
        extra = 5 if fault == 1 else 0
        rows.append([(2, "D", "")] + ([] if fault > 1 else [(extra, "K", role), (1 + extra, "R", "u"), (1 + extra, "R", "a")]))
    for inserts in itertools.product(gaps, repeat=len(codes) + 1):
        base = 5 * sum(map(len, inserts))
        if best and base > best[0]:
            continue
        for edits in itertools.product(*rows):
            roles = "".join(i + e[2] for i, e in zip(inserts, edits)) + inserts[-1]
            if GOOD.fullmatch(roles):
                audit = "".join("I" * len(i) + e[1] for i, e in zip(inserts, edits)) + "I" * len(inserts[-1])
                case = (base + sum(e[0] for e in edits), audit)
                best = min(best, case) if best else case
    return best


def by_table(codes):
    """The cheapest (cost, audit) by a table over states, inserts without limit."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def relax(ways):
        for _ in range(3):
            for s, (c, a) in list(ways.items()):
                for r in "ua":
                    if (s, r) in step:
                        t = step[s, r]
                        ways[t] = min(ways.get(t, (10**9, "")), (c + 5, a + "I"))
        return ways

    ways = relax({0: (0, "")})
    for code in codes:
        role, fault = ROLES[code & 3], code >> 2
        extra, then = 5 if fault == 1 else 0, {}
        for s, (c, a) in ways.items():
            options = [(s, 2, "D")]
            if fault < 2:
                options += [(step[s, role], extra, "K")] if (s, role) in step else []
                options += [(step[s, r], 1 + extra, "R") for r in "ua" if (s, r) in step]
            for t, cost, e in options:
                then[t] = min(then.get(t, (10**9, "")), (c + cost, a + e))
        ways = relax(then)
    return min(ways[s] for s in (0, 3) if s in ways)


CODE = st.integers(0, 3).flatmap(lambda r: st.sampled_from([0, 0, 0, 1, 2, 3]).map(lambda f: r + 4 * f))


@settings(max_examples=60, deadline=None)
@given(st.lists(CODE, max_size=3))
def test_search_equals_all_edits(codes):
    assert cheapest(bytes(codes)) == all_edits(codes) == by_table(codes)


@settings(max_examples=400, deadline=None)
@given(st.lists(CODE, max_size=60))
def test_search_equals_table(codes):
    assert cheapest(bytes(codes)) == by_table(codes)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(CODE, min_size=1, max_size=12), min_size=2, max_size=5))
def test_pieces_join(parts):
    """A conversation solved in pieces has the cost and audit of the whole."""
    parts = [bytes(p) for p in parts]
    ways = fold(piece_table(p) for p in parts)
    cost, audit = 0, ""
    for i, (p, (entry, leave)) in enumerate(zip(parts, ways)):
        c, a = cheapest(p, entry, {leave: ENDINGS[leave] if i == len(parts) - 1 else (0, "")})
        cost, audit = cost + c, audit + a
    assert (cost, audit) == cheapest(b"".join(parts))


def test_long_transcripts_are_searched_in_proportion():
    rnd = random.Random(1)
    codes = bytes(rnd.choice([2, 3, 2, 3, 0, 1]) + 4 * rnd.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(5000))
    assert cheapest(codes) == by_table(codes)


def plain(rows, damage=True):
    """conv_id -> result by the definition. rows: (conv_id, turn, role, text)."""
    after = {}
    for conv, turn, role, text in rows:
        own = after.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(name.encode()) % 20 if damage else 99
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        own += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = {}
    for conv, own in after.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((hashlib.md5(r[1].encode()).hexdigest() + r[2]).encode()).digest()))
        seen, codes, count, illegal = set(), [], [0] * 4, 0
        for i, (_, role, text) in enumerate(own):
            body = text.rstrip(" \t\n\x0b\f\r")
            fault = 3 if not body else 2 if (role, text) in seen else 1 if body[-1] not in ".!?" else 0
            seen.add((role, text))
            codes.append("?sua".find(role[:1] or "?") % 4 + 4 * fault if role[:1] in ("s", "u", "a") else 4 * fault)
            count[fault] += 1
            illegal += i > 0 and own[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        cost, audit = by_table(codes)
        lines, state, k = [], "", 0
        for e in audit:
            turn = "assistant" if state[-1:] == "u" else "user"
            if e == "I":
                lines.append(f"{turn}:")
                state += turn[0]
                continue
            _, role, text = own[k]
            k += 1
            if e != "D":
                role = turn if e == "R" else role
                lines.append(f"{role}:{text}")
                state += role[0]
        assert GOOD.fullmatch(state)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, count[3], count[2], count[1], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _run(rows, **options):
    rows = placed(rows)
    found = repair_summary(rows, audits(rows, **options)).collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r)[1:] for r in found}


def test_conversations(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = plain([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows.collect()])
    got = _run(damaged(rows))
    assert got == want and sum(r[5] for r in got.values()) > 50


def test_odd_rows(spark):
    rnd = random.Random(5)
    long = [(7, i, rnd.choice(["user", "assistant", "system", None, "tool"]), rnd.choice(["Yes.", "no", "", f"Line {i}.", None])) for i in range(700)]
    rows = [(None, 1, "user", "Hello."), (None, None, "assistant", "Hi."), (1, None, "user", "a."), (1, None, "user", "a."), (1, None, "assistant", "b."),
            (2, 3, None, None), (3, 1, "", " \n"), (4, -5, "system", "Be kind."), (4, 9, "user", "x" * 300_000 + "."), (5, 2, "user", "ende é"), *long]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS at", "'q' AS same", "2 AS alive", "3 AS kind").repartition(3)
    want = plain(rows)
    for bits in (12, 4):  # 4: pieces of at most 16 rows
        assert _run(damaged(df), piece_bits=bits) == want
    assert repair_summary(*(lambda r: (r, audits(r)))(placed(damaged(df.limit(0))))).collect() == []


def test_all_rows_dropped(spark):
    conv = next(c for c in range(10_000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 1, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert _run(damaged(df)) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_rows(spark):
    data = [(1, 0, "user", "One."), (1, 1, "user", "Two."), (1, 2, "assistant", "Three."), (2, 0, "system", "S."), (2, 1, "assistant", "A.")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "true AS alive")
    rows = placed(df)
    got = {}
    for r in sorted(repaired_rows(rows, audits(rows)).collect(), key=lambda r: (r["conv_id"], r["place"])):
        got.setdefault(r["conv_id"], []).append((r["place"], r["edit"], r["role"], r["text"]))
    assert got == {1: [(0, "K", "user", "Two."), (1, "K", "assistant", "Three.")],  # audit DKK, before KDK
                   2: [(0, "R", "user", "S."), (1, "K", "assistant", "A.")]}
