import hashlib
import heapq
import random
import re
import zlib

from folio.llm import conversations

NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
ROLE = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def fault_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("b" if not words else "d" if (role, text) in seen else "t" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, [x for x in kept]
        forced = ROLE[state]
        heapq.heappush(heap, (cost + 2, audit + "I", i, forced[0], (*kept, forced + ":")))
        if i < len(rows):
            role, text = rows[i][2:]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, kept))
            if faults[i] not in ("b", "d"):
                more = cost + (faults[i] == "t")
                if role[:1] in NEXT[state]:
                    heapq.heappush(heap, (more, audit + "K", i + 1, NEXT[state][role[:1]], (*kept, f"{role}:{text}")))
                heapq.heappush(heap, (more + 2, audit + "R", i + 1, forced[0], (*kept, f"{forced}:{text}")))


def brute(rows, ids):
    by = {c: [] for c in ids}
    for r in rows:
        by[r[0]].append(r)
    out = []
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        faults = fault_of(mine)
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, text = cheapest(mine, faults)
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def some_rows(seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "who?", "a b", "", "  \t", None, "ends. \n", "x. ", " ", "long " * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "ua", "Ünder", "\U0001f600"]
    rows = []
    for conv in range(150):
        if rng.random() < 0.5:
            turns = [(t, ("user", "assistant")[t % 2], f"say {t}.") for t in range(rng.randrange(9))]
        else:
            turns = [(rng.choice([None, *range(7)]), rng.choice(roles[: rng.choice([3, 9])]), rng.choice(texts)) for _ in range(rng.randrange(9))]
        rows += [(conv, *t) for t in turns]
    rows += [(None, t, "user", "hm") for t in (3, 1, None)] + [(900, None, "user", None)] * 3
    rows += [(901, t, rng.choice(["user", "assistant"]), rng.choice(["a.", f"{t}.", f"{t}"])) for t in range(700)]
    rng.shuffle(rows)
    return rows


def test_repair_against_a_search_over_all_edits(spark, tmp_path):
    rows = some_rows(3)
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS signature", "2 AS copies", "3 AS audit").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in conversations.op11(spark, str(tmp_path)).collect()]
    want = brute(damage(rows), {r[0] for r in rows})
    assert sorted(got, key=str) == want
    assert {e for r in want for e in r[7]} == set("KRDI")


def test_repaired_rows_follow_the_grammar(spark):
    rows = [r for r in some_rows(5) if r[0] is not None]
    report, faulty = conversations.repair(spark.createDataFrame(rows, SCHEMA))
    texts = {}
    for r in conversations.repaired_rows(faulty, report).collect():
        texts.setdefault(r.conv_id, {})[r.n] = f"{r.role}:{r.text}"
    for r in report.collect():
        mine = [t for _, t in sorted(texts.get(r.conv_id, {}).items())]
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in mine))
        assert hashlib.sha256("\n".join(mine).encode()).hexdigest() == r.repaired_sha256


def test_empty_tables_and_ids_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(none)[0].count() == 0
    got = conversations.repair(none, spark.createDataFrame([(4,), (4,), (None,)], "conv_id long"))[0].collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, got), key=str) == sorted([(4, 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)], key=str)


def test_equal_suffixes_share_nodes():
    one = conversations.SuffixAutomaton()
    word = "".join(conversations.letter(1 + k % 2, 0) for k in range(40))
    assert one.solve(word) == (0, "K" * 40) and one.made == 40
    assert one.solve(word[2:]) == (0, "K" * 38) and one.made == 40
    assert one.solve(conversations.letter(0, 3) + word) == (1, "K" * 41) and one.made == 43
    fresh = conversations.SuffixAutomaton()
    assert fresh.solve(word[::-1]) == one.solve(word[::-1])
