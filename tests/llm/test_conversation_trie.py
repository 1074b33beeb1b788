"""The prefix trie against brute force and SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from mistveil.llm import conversation_trie
from mistveil.llm.shared import Scratch
from tests.conftest import SF

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """rows: (conv_id, turn, role, text), without ties of turn in a conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(int(c / 20) * 20, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, len(path) == d))
    words = {p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p in nodes}
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, members in nodes.items():
        below, stack = [], [p]
        while stack:
            q = stack.pop()
            below.append(q)
            stack += kids.get(q, [])
        ends = ",".join(str(c) for c, here in sorted(members) if here)
        out.append((min(members)[0], len(p), min(nodes[p[:-1]])[0] if p else None, len(members), len(kids.get(p, [])), sum(q not in kids for q in below),
                    sum((len(nodes[q]) - 1) * words[q] for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in conversation_trie.digest(df).select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    said = [f"{'word ' * rng.randint(0, 5)}{i}" for i in range(6)] + ["", None, "two\nlines \tand  more"]
    out = []
    for c in [*range(0, 70), -3, -20, -41, 1000, 1023]:
        if c in (20, 22):
            continue
        turns = rng.sample(range(-5, 40), rng.choice([1, 2, 3, 5, 17]))
        out += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(said[:3] if i < 3 else said)) for i, t in enumerate(sorted(turns))]
    out += [(5, None, "user", "first of all"), (None, 1, "user", "nobody's"), (20 + 3 * 20 + 1, 1, "user", "alone")]
    out += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(12)]  # a hot group of copies
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, first int").repartition(3)


@pytest.mark.parametrize("block", [256, 4, 2])
def test_brute_force(spark, rows, monkeypatch, block):
    """Also where sequences are ranked by blocks, in several rounds."""
    monkeypatch.setattr(conversation_trie, "BLOCK", block)
    assert found(frame(spark, rows)) == plain(rows)


def test_preorder_intervals(spark, rows):
    with Scratch(spark) as scratch:
        nodes = sorted(conversation_trie.prefix_trie(frame(spark, rows), scratch).collect(), key=lambda r: r.position)
    assert [r.position for r in nodes] == list(range(len(nodes)))
    for i, r in enumerate(nodes):  # a subtree ends where depth first falls back to that of its top
        end = next((j for j in range(i + 1, len(nodes)) if nodes[j].depth <= r.depth), len(nodes))
        assert r.subtree_end == end


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_trie.digest(spark.createDataFrame([], schema)).count() == 0
    turnless = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4][:1]  # its family has no head, its only turn is dropped
    rows = [(turnless[0], 1, "user", "gone")]
    assert found(spark.createDataFrame(rows, schema)) == plain(rows)
    ties = [(40, 1, "a", "x y"), (40, 1, "a", "x y"), (40, 1, None, None), (40, 2, "a", "z " * 100_000)]
    got = conversation_trie.digest(spark.createDataFrame(ties, schema)).collect()
    assert len(got) == 5 and {r.n_convs for r in got} == {1} and max(r.depth for r in got) == 4


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_given_conversations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    want = plain([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    by_sql = duckdb.sql(conversation_trie.SQL)
    assert sorted(by_sql.columns) == sorted(COLUMNS)
    assert found(df) == want == sorted(by_sql.select(",".join(COLUMNS)).fetchall(), key=str)
