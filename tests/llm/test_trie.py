"""The trie of conversations against a plain dictionary of openings."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from roiscore.llm import trie
from roiscore.llm.trie import plain_turns, prefix_trie, shared_openings

SCHEMA = "conv_id long, turn long, role string, text string, depth int, words string"


def brute(conversations):
    """{id: [(role, text)]} as rows of the trie."""
    nodes = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            node = nodes.setdefault(tuple(turns[:d]), {"members": [], "ends": [], "children": set()})
            node["members"].append(c)
            if d == len(turns):
                node["ends"].append(c)
            if d:
                nodes[tuple(turns[: d - 1])]["children"].add(tuple(turns[:d]))
    out = []
    for key, node in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        own = lambda k: (len(nodes[k]["members"]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0)
        parent = min(nodes[key[:-1]]["members"]) if key else None
        ends = hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest()
        out.append((min(node["members"]), len(key), parent, len(node["members"]), len(node["children"]), sum(not nodes[k]["children"] for k in below), sum(map(own, below)), ends))
    return sorted(out, key=repr)


def originals(rows):
    out = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        if c is not None:
            out.setdefault(c, []).append((role or "", text or ""))
    return out


def rebuilt(rows):
    out = originals(rows)
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in out}
    return {c: out.get(c - c % 20, [])[: h[c]] + turns[h[c] :] for c, turns in out.items()}


@pytest.fixture
def many_parts(spark):
    """Small tables are dealt out, too."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def table(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return df.repartition(3) if rows else df


def run(spark, rows):
    return sorted((tuple(r) for r in prefix_trie(*plain_turns(table(spark, rows))).collect()), key=repr)


def run_rebuilt(spark, rows):
    return sorted((tuple(r) for r in prefix_trie(*shared_openings(table(spark, rows))).collect()), key=repr)


def dialogues(n, seed, texts=3, most=6):
    rng = random.Random(seed)
    return [(c, t - 1 or None, rng.choice(["user", None]), rng.choice(["a b", "c", "", None, "d e f\n g", "é" * 50][:texts])) for c in range(n) for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_a_dictionary(spark, seed):
    rows = dialogues(60, seed, 3 + seed)
    assert run(spark, rows) == brute(originals(rows))


def test_rebuilt_conversations(spark):
    rows = [r for r in dialogues(100, 5) if r[0] not in (20, 61, 62)]
    expected = brute(rebuilt(rows))
    assert run_rebuilt(spark, rows) == expected
    assert any(not t for t in rebuilt(rows).values())  # some have no turn at all


def test_blocks_hot_chains_and_runs_of_ids(spark, monkeypatch, many_parts):
    for name, value in (("BLOCK", 3), ("RUN", 2), ("HOT_CHAINS", 2)):
        monkeypatch.setattr(trie, name, value)
    rows = dialogues(80, 7, 2, 12) + [(1000 + c, 0, "user", "a b") for c in range(40)]
    assert run(spark, rows) == brute(originals(rows))


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rows = [(c, t, "user", f"t{t}" if t < 60 - c else f"own {c} {t}") for c in range(50) for t in range(60)]
    rounds = []
    cut = trie.cut_counted
    monkeypatch.setattr(trie, "cut_counted", lambda df: rounds.append(1) or cut(df))
    assert run(spark, rows) == brute(originals(rows)) and len(rounds) < 4


def test_chains_on_chains(spark):
    rows = [(c, t, "user", "x" if t < c else "y" if t == c else f"{c}") for c in range(6) for t in range(6)]
    rows = [(c, *r[1:]) for r in rows for c in [r[0] * 7]]
    assert run(spark, rows) == brute(originals(rows))


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, 0, "user", "a")] * 5 + [(2, 0, "user", "a")] * 3 + [(None, 0, "user", "a"), (3, None, None, None)]
    assert run(spark, rows) == brute(originals(rows))
    assert run(spark, []) == run_rebuilt(spark, []) == []


def test_equal_numbers_go_by_digest_and_every_run_agrees(spark):
    rows = [(c, 0, "user", t) for c in (1, 2) for t in ("b", "a", "c")]
    got = run(spark, rows)
    assert got == run(spark, rows[::-1]) and [r[3] for r in got if r[1] == 3] == [2]


def test_one_conversation_holds_most_rows(spark, many_parts):
    rows = [(0, t, "user", f"t {t % 7}") for t in range(3000)] + dialogues(20, 3)[5:]
    rows = [r for r in rows if r[0] or r[3] and r[3].startswith("t ")]
    got = run_rebuilt(spark, rows)
    assert len(got) == len({tuple(t[:d]) for t in rebuilt(rows).values() for d in range(len(t) + 1)}) and max(r[1] for r in got) == 3000


def test_order_of_turns_is_shared_by_tasks(spark, many_parts):
    rows, parts = trie.ordered_turns(table(spark, [(0, t, "user", "x") for t in range(500)] + [(0, 9, "user", "same")] * 500))
    at = rows.join(parts, ["conv_id", "part"]).select((F.col("place") - F.col("first") + F.col("before")).alias("at"))
    assert sorted(r["at"] for r in at.collect()) == list(range(1000)) and parts.count() > 1
