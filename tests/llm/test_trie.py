"""The prefix trie against brute force: levels of segments, many shards, nulls, ties, repeats, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from forumloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth long, seg long, _at string, n long"


def brute(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        value = (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += value
            leaves[node[:d]] += not children[node]
    found = set()
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        up = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        found.add((min(convs), len(node), up, len(convs), children[node], leaves[node], saved[node], digest))
    return found


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], SCHEMA)


def rows_of(seed, convs, longest, words, copies=0):
    rng = random.Random(seed)
    rows = [
        (c, t, rng.choice(["user", "assistant"]), f"w{rng.randrange(words)}é")
        for c in convs
        for t in range(rng.choice([1, 2, longest, rng.randrange(1, longest + 1)]))
    ]
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(copies) for t in range(3)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment, shard", [(128, 1 << 18), (4, 7)])
def test_equals_brute_force_whatever_the_segments_and_shards(spark, monkeypatch, segment, shard):
    monkeypatch.setattr(trie, "SHARD_TURNS", shard)
    rows = rows_of(1, range(40), 9, 2, copies=12)
    rows += [(None, 0, "user", "lost"), (7000, None, None, None), (7000, 0, "", "x"), (7001, None, None, None)]
    found = [tuple(r) for r in trie.prefix_trie(frame(spark, rows), segment=segment).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)


def test_one_conversation_of_very_many_turns(spark):
    rows = [(5, t, "user", "a" if t % 3 else "b") for t in range(300)] + [(10, t, "user", "a" if t % 3 else "b") for t in range(290)]
    found = {tuple(r) for r in trie.prefix_trie(frame(spark, rows)).collect()}
    assert found == brute(rows)


def test_repeated_rows_absent_and_negative_families_and_long_texts(spark):
    rows = [(3, 0, "user", "x" * 300_000)] * 2 + [(-7, 0, "user", "n"), (-5, 0, "user", "m"), (8, 1, "a", ""), (8, 1, "a", "")]
    found = {tuple(r) for r in trie.prefix_trie(frame(spark, rows)).collect()}
    rem = lambda a: a - int(a / 5) * 5  # noqa: E731  the sign of % is that of SQL
    own = {3: [("user", "x" * 300_000)] * 2, -7: [("user", "n")], -5: [("user", "m")], 8: [("a", "")] * 2}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - rem(c), [])[:h] + own[c][h:]
    assert {(r[0], r[1]) for r in found} == {
        (min(c for c in built if built[c][:d] == seq[:d] and len(built[c]) >= d), d) for seq in built.values() for d in range(len(seq) + 1)
    }


def test_empty_table(spark):
    assert trie.prefix_trie(frame(spark, [])).count() == 0


def test_closings_are_found_across_blocks():
    rng = random.Random(2)
    for size in (1, 3, 40, 700, 5000):
        bits, depth = [], 0
        while len(bits) < 2 * size or depth:
            up = depth == 0 or (len(bits) < 2 * size and rng.random() < 0.5)
            bits.append(int(up))
            depth += 1 if up else -1
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        at = np.flatnonzero(bits)
        assert trie.Parentheses(np.array(bits, np.uint8)).find_close(at).tolist() == [want[i] for i in at.tolist()]
