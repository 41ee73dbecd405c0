"""Mixing, turn repair and funnels against brute force, and their defined cases."""

import collections
import datetime
import hashlib
import heapq
import math
import random
import re
import struct
import zlib

import duckdb
import pytest
import xxhash

from webloom.llm import funnels, mixing, queries, turn_repair

DOCS = "doc_id long, text string, lang string, source string"
WORDS = re.compile(r"[^\x20\x09-\x0d]+")


# Mixing.


def spark_hash(doc_id, text):
    """xxhash64(doc_id, text) with its seed of 42; null values leave the seed as it is."""
    seed = 42
    if doc_id is not None:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed)
    if text is not None:
        seed = xxhash.xxh64_intdigest(text.encode(), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def brute_mix(rows):
    """(doc_id, text, source) -> sorted list of (doc_id, size, source_size, target, taken)."""
    docs = [(i, len(WORDS.findall(t or "")), s, spark_hash(i, t)) for i, t, s in rows]
    size = collections.Counter()
    for _, n, s, _ in docs:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        free = [s for s in order if s not in capped]
        rest, wsum = sum(size.values()) - sum(3 * size[s] for s in capped), sum(weight[s] for s in free)
        target = {s: 3.0 * size[s] if s in capped else float(rest * weight[s]) / wsum for s in order}
        over = {s for s in free if 3 * size[s] * wsum < rest * weight[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in order:
        own = sorted((d for d in docs if d[2] == s), key=lambda d: (-d[1], d[3]))
        classes = collections.Counter(d[1] for d in own)
        low, high = -1e6, 1e6
        mean = sum(n * n * c for n, c in classes.items()) / size[s] if size[s] else 1.0
        rate = lambda n, tilt: min(3.0, math.exp(min(tilt * n / mean, 50.0)))
        for _ in range(300):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(c * n * rate(n, mid) for n, c in classes.items() if n) < target[s] else (low, mid)
        rates = {n: 0.0 if n == 0 else 3.0 if s in capped or target[s] >= 3 * size[s] else rate(n, low) for n in classes}
        run, total = 1 << 19, {}
        for n in sorted(classes, reverse=True):
            fixed = round(rates[n] * (1 << 20)) * classes[n]
            total[n] = min(((run + fixed) >> 20) - (run >> 20), 3 * classes[n])
            run += fixed
        for _ in range(4):
            rest = math.floor(target[s] - sum(n * k for n, k in total.items()) + 0.5) if target[s] >= sum(n * k for n, k in total.items()) else -math.floor(sum(n * k for n, k in total.items()) - target[s] + 0.5)
            if not rest:
                break
            tried = []
            for n in classes:
                if n:
                    give = min(3 * classes[n] - total[n] if rest > 0 else total[n], math.floor(abs(rest) / n + 0.5))
                    tried.append((abs(abs(rest) - give * n), n, give if rest > 0 else -give))
            _, n, give = min(tried)
            total[n] += give
        seen = collections.Counter()
        for i, n, _, _ in own:
            each, odd = divmod(total[n], classes[n])
            out.append((i, n, size[s], target[s], n * (each + (seen[n] < odd))))
            seen[n] += 1
    return sorted(out, key=repr)


def mixed(spark, rows):
    df = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], DOCS)
    return sorted((tuple(r) for r in mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)


def test_mix_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r)[:5] for r in queries.op11_entropy_balancing(spark, sf).collect()), key=repr)
    assert got == brute_mix(rows)
    again = sorted((tuple(r)[:5] for r in queries.op11_entropy_balancing(spark, sf).collect()), key=repr)
    assert again == got


def test_mix_comes_near_its_targets(spark):
    random.seed(3)
    rows = [(i, "w " * int(random.lognormvariate(4, 1)), random.choice(["a", "a", "a", "a", "b", "c", "d", None])) for i in range(1500)]
    rows += [(5000 + i, "same words here", "a") for i in range(700)]
    taken, target = collections.Counter(), {}
    source = {i: s for i, _, s in rows}
    for i, n, _, t, k in mixed(spark, rows):
        assert 0 <= k <= 3 * n
        taken[source[i]] += k
        target[source[i]] = t
    assert all(abs(taken[s] - t) <= 3 for s, t in target.items())


def test_mix_defined_cases(spark):
    assert mixed(spark, []) == []
    rows = [(1, None, "x"), (1, "", None), (None, " \t ", "x")]
    assert mixed(spark, rows) == sorted([(1, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0), (None, 0, 0, 0.0, 0)], key=repr)
    # A small source stops at three times its size; the others share what is over.
    rows = [(i, "a b c d e f g h i j", "big") for i in range(40)] + [(90, "one two", "small"), (91, "q", None), (91, "q", None), (92, "word " * 5000, "long")]
    got = mixed(spark, rows)
    assert got == brute_mix(rows)
    assert {(t, k) for i, _, _, t, k in got if i == 90} == {(6.0, 6)}
    # Sources are ordered by code point: U+FF5A before U+1D4B3.
    rows = [(1, "a " * 30, "ｚ"), (2, "a " * 30, "\U0001d4b3"), (3, "a " * 30, "")]
    assert {i: t for i, _, _, t, _ in mixed(spark, rows)} == {3: 15.0, 1: 30.0, 2: 45.0}


def test_mix_ignores_other_columns_and_layout(spark):
    rows = [(i % 50, f"w{i} " * (1 + i % 7), f"s{i % 3}", 1, 2, 3) for i in range(300)]
    wide = spark.createDataFrame(rows, "doc_id long, text string, source string, key int, size int, place int")
    narrow = mixed(spark, [r[:3] for r in rows])
    for parts in (1, 7):
        got = mixing.mix(wide.repartition(parts)).select("doc_id", "size", "source_size", "target", "taken").collect()
        assert sorted(map(tuple, got), key=repr) == narrow


def test_mix_runs_no_python(spark, sf):
    plan = queries.op11_entropy_balancing(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Turn repair.

SPACE = " \t\n\x0b\f\r"
ROWS = "conv_id long, turn long, role string, text string"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def damage(rows):
    said = lambda v: " " if v is None else str(v)
    convs = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        hit, role, text = zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20, said(role), said(text)
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        convs[c] += [(t, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return convs


def cheapest(rows, faults):
    """Least cost first, then least labels, over all edits: a search of states in the order of both."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, labels, i, state, said = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, labels, said
        if (i, state) in done:
            continue
        done.add((i, state))
        made = [(r, NEXT[state][r[0]]) for r in ("user", "assistant") if r[0] in NEXT[state]]
        for role, after in made:
            heapq.heappush(heap, (cost + 2, labels + "I", i, after, (*said, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, labels + "D", i + 1, state, said))
            if faults[i] in ("", "t"):
                more = faults[i] == "t"
                if role[:1] in NEXT[state]:
                    heapq.heappush(heap, (cost + more, labels + "K", i + 1, NEXT[state][role[:1]], (*said, f"{role}:{text}")))
                for new, after in made:
                    heapq.heappush(heap, (cost + 2 + more, labels + "R", i + 1, after, (*said, f"{new}:{text}")))


def brute_repair(convs):
    out = {}
    for c, rows in convs.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.rstrip(SPACE)
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, labels, said = cheapest(rows, faults)
        out[c] = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, labels, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def test_repair_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries.op12_turn_repair(spark, sf).collect()}
    assert got == brute_repair(damage(rows))


def strange(n, seed):
    random.seed(seed)
    texts = ["Yes.", "No!", "well", "", " \t", None, "Why?", "a.b", "é.", "one\ntwo. \n"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"]
    return [(random.choice([1, 2, 3, 4, 5, None]), random.choice([None, *range(40)]), random.choice(roles), random.choice(texts) if random.random() < 0.3 else f"said {random.randrange(200)}.") for _ in range(n)]


@pytest.mark.parametrize("piece", [1, 3, 512])
def test_repair_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(turn_repair, "PIECE_ROWS", piece)
    rows = strange(400, 5)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    assert {r.conv_id: tuple(r)[1:] for r in turn_repair.audit(df).collect()} == brute_repair(damage(rows))


def test_shortest_paths_of_pieces_compose():
    random.seed(9)
    for _ in range(300):
        rows = [(random.choice("suax"), random.choice([0, 0, 0, 1, 2, 3]), 1) for _ in range(random.randrange(0, 9))]
        cut = random.randrange(len(rows) + 1)
        path = turn_repair.Path()
        for k, part in enumerate((rows[:cut], rows[cut:])):
            path.take((k, 0), [{"from": s, "to": t, "cost": c, "labels": x} for s in range(4) for t, (c, x) in turn_repair.shortest(part, s).items()])
        cost, labels, ways = path.close()
        want = cheapest([(0, i, "t.") for i, _, _ in rows], ["" if f == 0 else "b" if f == 1 else "d" if f == 2 else "t" for _, f, _ in rows])
        assert (cost, labels) == want[:2]
        assert "".join(own for _, _, own in reversed(ways)) == labels


def test_repair_defined_cases(spark):
    empty = spark.createDataFrame([], ROWS)
    assert turn_repair.audit(empty).count() == 0
    # A third of all rows are one row; another conversation is one long one of alternating turns, and one has only dropped rows.
    dropped = next(i for i in range(100, 1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(1, 5, "user", "the same text")] * 900 + [(2, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(1500)] + [(dropped, 0, "user", "gone.")]
    rows += [(3, 0, "user", "x " * 300_000 + "."), (3, 1, "assistant", "end.")]
    wide = spark.createDataFrame([(*r, 1, "k") for r in rows], ROWS + ", n int, key string")
    got = {r.conv_id: tuple(r)[1:] for r in turn_repair.audit(wide).collect()}
    assert got == brute_repair(damage(rows))
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows_are_in_the_grammar(spark):
    repair = turn_repair.Repair(turn_repair.damaged(spark.createDataFrame(strange(300, 8), ROWS)))
    said = collections.defaultdict(list)
    for r in sorted(repair.rows().collect(), key=lambda r: (r.part, r.piece, r.at)):
        said[r.conv_id].append(r.role[0])
    assert said and all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in said.values())


# Funnels.

CLICKS = "client_id long, kind string, arrived_at timestamp_ntz"


def brute_funnels(rows, within=300_000_000):
    seen = sorted({(c, k, t) for c, k, t in rows if None not in (c, k, t)}, key=lambda r: r[2])
    us = lambda d: d // datetime.timedelta(microseconds=1)
    out, by = {}, collections.defaultdict(list)
    for c, k, t in seen:
        by[c, k].append(t)
    for funnel, (steps, bad) in funnels.FUNNELS.items():
        for c in {c for c, k, _ in seen if k == steps[0]}:
            took = [[] for _ in steps]
            for start in by[c, steps[0]]:
                before = start
                took[0].append(0)
                for k, kind in enumerate(steps[1:], 1):
                    at = next((t for t in by[c, kind] if t > before), None)
                    if at is None or us(at - start) > within or any(before < t <= at for t in by[c, bad]):
                        break
                    took[k].append(us(at - before))
                    before = at
            n = [len(x) for x in took]
            out[funnel, c] = (*n, sum(x > 0 for x in n), *(sorted(x)[-(-25 * len(x) // 100) - 1] if x else None for x in took[1:]))
    depth = collections.Counter((f, v[4]) for (f, _), v in out.items())
    return {(f, c): (*v, depth[f, v[4]]) for (f, c), v in out.items()}


def counted(df):
    return {(r.funnel, r.client_id): tuple(r)[2:] for r in funnels.count(df).collect()}


def test_funnels_equal_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW clicks AS SELECT * FROM '{sf}/clicks.parquet'")
    want = {r[:2]: r[2:] for r in c.execute(queries.OP13_SQL).fetchall()}
    assert counted(spark.read.parquet(f"{sf}/clicks.parquet")) == want
    assert {(r.funnel, r.client_id): tuple(r)[2:] for r in queries.op13_funnel_sweep(spark, sf).collect()} == want


def test_funnels_equal_brute_force(spark):
    random.seed(2)
    zero = datetime.datetime(2024, 3, 10, 1, 50)
    kinds = ["view", "click", "purchase", "signup", "error", "other", None]
    rows = [(random.choice([1, 1, 1, 2, 3, None]), random.choices(kinds, [6, 6, 3, 2, 1, 2, 1])[0], zero + datetime.timedelta(seconds=random.randrange(0, 9000) / random.choice([1, 1, 1000]))) for _ in range(1500)]
    rows += rows[:200] + [(7, "view", None), (8, "error", zero)]
    # Exactly five minutes still count, a microsecond more does not; before 1970 and over a block's end too.
    for client, late in ((20, 0), (21, 1)):
        old = datetime.datetime(1969, 12, 31, 23, 57)
        rows += [(client, "view", old), (client, "click", old + datetime.timedelta(minutes=5, microseconds=late)), (client, "view", old + datetime.timedelta(minutes=5, microseconds=late))]
    want = brute_funnels(rows)
    assert want["A", 20][:2] == (2, 1) and want["A", 21][:2] == (2, 0)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], CLICKS + ", step int, at int")
    assert counted(df) == want
    before = spark.conf.get("spark.sql.session.timeZone")
    try:  # times without a zone do not depend on the session's, which jumps an hour here
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert counted(df) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_funnels_defined_cases(spark):
    assert counted(spark.createDataFrame([], CLICKS)) == {}
    zero = datetime.datetime(2024, 1, 1)
    # An excluded row at the time of the next step ends the attempt; one at the time of the first step does not.
    rows = [(1, "view", zero), (1, "error", zero), (1, "click", zero + datetime.timedelta(seconds=1)), (1, "view", zero + datetime.timedelta(seconds=2)), (1, "error", zero + datetime.timedelta(seconds=2))]
    rows += [(2, "view", zero)] * 3000
    assert counted(spark.createDataFrame(rows, CLICKS)) == brute_funnels(rows)
    with pytest.raises(ValueError):
        funnels.moves(spark.createDataFrame(rows, CLICKS), block=funnels.WITHIN)


def test_funnels_of_other_lengths(spark):
    zero = datetime.datetime(2024, 1, 1)
    rows = [(1, "x", zero), (1, "y", zero + datetime.timedelta(seconds=9)), (2, "y", zero)]
    got = funnels.count(spark.createDataFrame(rows, CLICKS), {"one": (("y",), None), "two": (("x", "y"), None)}).collect()
    assert {tuple(r) for r in got} == {("one", 1, 1, 0, 1, None, 2), ("one", 2, 1, 0, 1, None, 2), ("two", 1, 1, 1, 2, 9_000_000, 1)}
