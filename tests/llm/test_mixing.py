import random
import time

import pytest

from loomgrid.llm import mixing as m


def test_every_slot_is_less_than_one_block_off():
    rng = random.Random(0)
    for _ in range(200):
        shares = {str(i): rng.randint(1, 30) for i in range(rng.randint(1, 12))}
        total, seen = sum(shares.values()), dict.fromkeys(shares, 0)
        for at, s in enumerate(m.period(shares), 1):
            seen[s] += 1
            assert all(abs(seen[k] - at * shares[k] / total) < 1 for k in shares)
        assert seen == shares


def schedule(blocks, shares):
    """Slot by slot: the released block with the earliest deadline, phases restart when a source runs out."""
    left, done, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), []
    while left:
        now, start = {s: shares.get(s, 1) for s in left}, dict(done)
        total, at = sum(now.values()), 0
        while True:
            ready = []
            for s, k in now.items():
                j = done[s] - start[s]
                if j * total // k <= at:
                    ready.append((-(-(j + 1) * total // k), s, j))
            _, s, _ = min(ready, key=lambda r: (r[0], r[1]))
            out.append((s, done[s]))
            done[s] += 1
            left[s] -= 1
            at += 1
            if not left[s]:
                del left[s]
                break
    return out


def slots(blocks, shares):
    found = {}
    plan = m.phases(blocks, shares)
    for p, q in zip(plan, [*plan[1:], None]):
        total = sum(p.shares.values())
        for s in p.shares:
            end = q.first[s] if q and s in q.first else blocks[s]
            for b in range(p.first[s], end):
                i = b - p.first[s]
                found[p.start + i // p.shares[s] * total + p.slots[s][i % p.shares[s]]] = (s, b)
    return [found[k] for k in sorted(found)]


def test_phases_match_a_plain_simulation():
    rng = random.Random(3)
    for _ in range(60):
        blocks = {str(i): rng.randint(0, 40) for i in range(rng.randint(1, 6))}
        shares = {s: rng.randint(1, 9) for s in blocks}
        assert slots(blocks, shares) == schedule(blocks, shares)


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then concat('s', id % 5) else null end as source", "concat('t', id) as text")


def test_every_row_has_one_place(skewed):
    rows = m.mixed(skewed, block_rows=16).collect()
    assert len(rows) == 3000 and len({r.position for r in rows}) == 3000
    by_slot, by_block = {}, {}
    for r in rows:
        by_slot.setdefault(r.slot, set()).add((r.source, r.block))
        by_block.setdefault((r.source, r.block), []).append(r)
    assert all(len(v) == 1 for v in by_slot.values()) and sorted(by_slot) == list(range(len(by_slot)))
    assert all(len(v) <= 16 for v in by_block.values())
    counts = {}
    for r in rows:
        counts[r.source or m.NO_SOURCE] = counts.get(r.source or m.NO_SOURCE, 0) + 1
    blocks = {s: -(-n // 16) for s, n in counts.items()}
    want = schedule(blocks, m.tempered(counts))
    assert [(next(iter(by_slot[k]))[0] or m.NO_SOURCE, next(iter(by_slot[k]))[1]) for k in sorted(by_slot)] == want


def test_small_sources_share_one_member(spark):
    """Thousands of sources: the pool's slots go round, and every source is less than one block off an equal part of them."""
    counts = {"big": 400_000, "mid": 90_000, **{f"s{i}": 1 + i % 40 for i in range(3000)}}
    pool, blocks, shares = m.pooled(counts, 4, 0.5)
    assert set(blocks) == {"big", "mid", m.POOL} or len(blocks) < 50
    order = []
    for turn in range(max(pool.blocks.values())):
        order += sorted((s for s, n in pool.blocks.items() if n > turn), key=pool.place.get)
    at, seen = {}, dict.fromkeys(pool.blocks, 0)
    for i, s in enumerate(order):
        at[s, seen[s]] = i
        seen[s] += 1
    assert seen == pool.blocks and len(order) == pool.total
    for s, n in pool.blocks.items():
        for b in range(n):
            turn, first, active = [t for t in pool.turns_of(s) if t[0] <= b][-1]
            assert at[s, b] == first + (b - turn) * active + pool.place[s]


def test_many_sources_are_scheduled_in_linear_time():
    rng = random.Random(4)
    counts = {f"s{i}": int(20 * rng.paretovariate(1.1)) for i in range(100_000)}
    began = time.time()
    pool, blocks, shares = m.pooled(counts, m.BLOCK_ROWS, 0.5)
    plan = m.phases(blocks, shares)
    assert time.time() - began < 10 and sum(shares.values()) < 3000
    assert sum(blocks.values()) == sum(-(-n // m.BLOCK_ROWS) for n in counts.values()) and len(plan) <= len(blocks)


def test_rows_of_pooled_sources_have_one_place(spark):
    rows = [(i, "big") for i in range(4000)] + [(10_000 + 20 * k + j, f"s{k}") for k in range(700) for j in range(1 + k % 9)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    out = m.mixed(docs, block_rows=2, power=1.0).collect()
    counts = {}
    for _, s in rows:
        counts[s] = counts.get(s, 0) + 1
    pool, blocks, shares = m.pooled(counts, 2, 1.0)
    assert len(pool.blocks) > 100
    assert len({r.position for r in out}) == len(rows) == len(out)
    by_slot = {}
    for r in out:
        by_slot.setdefault(r.slot, set()).add((r.source, r.block))
    assert all(len(v) == 1 for v in by_slot.values()) and sorted(by_slot) == list(range(sum(blocks.values())))
    want = schedule(blocks, shares)
    got = [next(iter(by_slot[k]))[0] for k in sorted(by_slot)]
    assert [m.POOL if s in pool.blocks else s for s in got] == [s for s, _ in want]


def test_target_shares_hold_until_a_source_runs_out(skewed):
    shares = {"hot": 6, m.NO_SOURCE: 3, "s0": 1, "s1": 1, "s2": 1, "s3": 1, "s4": 1}
    rows = m.mixed(skewed, shares=shares, block_rows=8).collect()
    order = {}
    for r in rows:
        order[r.slot] = r.source or m.NO_SOURCE
    total, seen, ends = sum(shares.values()), dict.fromkeys(shares, 0), {}
    for r in rows:
        s = r.source or m.NO_SOURCE
        ends[s] = max(ends.get(s, 0), r.slot)
    for at in range(min(ends.values())):
        seen[order[at]] += 1
        assert all(abs(seen[s] - (at + 1) * k / total) < 1 for s, k in shares.items())


def test_odd_rows(documents, no_documents, clashing):
    out = m.in_order(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    assert sorted(str(r.doc_id) for r in m.mixed(documents).collect()) == sorted(str(r.doc_id) for r in documents.collect())
    assert m.in_order(no_documents).count() == 0
    again = [r.doc_id for r in m.in_order(documents).collect()]
    assert again == [r.doc_id for r in m.in_order(documents.repartition(5)).collect()]
