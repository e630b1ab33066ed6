"""Golden vectors of template mining, one shard at a time, without Spark."""

import random

import numpy as np
import pytest

from faultline.operators.mining_core import MinerConfig, Shard, set_score

# fixed values: golden vector
SSH = """
Dec 10 07:07:38 LabSZ sshd[24206]: input_userauth_request: invalid user test9 [preauth]
Dec 10 07:08:28 LabSZ sshd[24208]: input_userauth_request: invalid user webmaster [preauth]
Dec 10 09:12:32 LabSZ sshd[24490]: Failed password for invalid user ftpuser from 0.0.0.0 port 62891 ssh2
Dec 10 09:12:35 LabSZ sshd[24492]: Failed password for invalid user pi from 0.0.0.0 port 49289 ssh2
Dec 10 09:12:44 LabSZ sshd[24501]: Failed password for invalid user ftpuser from 0.0.0.0 port 60836 ssh2
Dec 10 07:28:03 LabSZ sshd[24245]: input_userauth_request: invalid user pgadmin [preauth]
""".split("\n")
FAILED = "Dec 10 <*> LabSZ <*> Failed password for invalid user <*> from 0.0.0.0 port <*> ssh2"
INVALID = "Dec 10 <*> LabSZ <*> input_userauth_request: invalid user <*> [preauth]"


class Sequential:
    """All shards, fed one line after the other."""

    def __init__(self, cfg):
        self.cfg, self.shards, self.sizes, self.pos = cfg, {}, {}, 0

    def name(self, tokens):
        return (tokens[0] if tokens else "") if self.cfg.engine == "jaccard" else len(tokens)

    def add(self, line):
        tokens = line.split()
        shard = self.shards.setdefault(self.name(tokens), Shard(self.cfg))
        change, cid = shard.add(tokens, self.pos)
        self.pos += 1
        key = (self.name(tokens), cid)
        self.sizes[key] = self.sizes.get(key, 0) + 1
        return change, key, " ".join(shard.templates[cid])

    def total(self):
        return sum(n for (name, cid), n in self.sizes.items() if cid in self.shards[name].templates)


def feed(cfg, lines):
    model = Sequential(cfg)
    return model, [model.add(x)[2] for x in lines]


@pytest.mark.parametrize("engine", ["length", "jaccard"])
def test_shorter_than_depth(engine):
    model = Sequential(MinerConfig(sim_th=0.4, max_clusters=None, engine=engine))
    assert [model.add(x)[0] for x in ("hello", "hello", "otherword")] == ["cluster_created", "none", "cluster_created"]


@pytest.mark.parametrize("engine", ["length", "jaccard"])
def test_threshold_40(engine):
    model, got = feed(MinerConfig(sim_th=0.4, max_clusters=None, engine=engine), SSH)
    assert got == ["", SSH[1], INVALID, SSH[3], FAILED, FAILED, INVALID, ""]
    assert model.total() == 8


def test_threshold_75():
    model, got = feed(MinerConfig(sim_th=0.75, max_clusters=None), SSH)
    assert got == ["", SSH[1], SSH[2], SSH[3], FAILED, FAILED, SSH[6], ""]
    assert model.total() == 8


def test_cluster_cap_of_one():
    # fixed values: golden vector
    _model, got = feed(MinerConfig(sim_th=0.4, max_clusters=1), [
        "A format 1", "A format 2", "B format 1", "B format 2", "A format 3"])
    assert got == ["A format 1", "A format <*>", "B format 1", "B format <*>", "A format 3"]


@pytest.mark.parametrize("lines,expected", [  # fixed values: golden vectors
    (["A A A", "A A B", "B A A", "B A B", "C A A", "C A B", "B A A", "A A A"],
     ["A A A", "A A *", "B A A", "B A *", "C A A", "C A *", "B A *", "A A A"]),
    (["A A A", "A A B", "A B A", "A B B", "A C A", "A C B", "A B A", "A A A"],
     ["A A A", "A A *", "A B A", "A B *", "A C A", "A C *", "A B *", "A A A"]),
])
def test_least_recently_updated_goes_first(lines, expected):
    _model, got = feed(MinerConfig(sim_th=0.4, max_clusters=2, param="*"), lines)
    assert got == expected


def test_depth_below_three():
    with pytest.raises(ValueError):
        MinerConfig(depth=2)


def test_children_overflow_keeps_a_place_for_the_wildcard():
    cfg = MinerConfig(sim_th=0.9, max_children=3, max_clusters=None)
    model = Sequential(cfg)
    for word in ("a", "b", "c", "d"):
        model.add(f"{word} x y")
    assert list(model.shards[3].kids[()]) == ["a", "b", "<*>"]


@pytest.mark.parametrize("engine", ["length", "jaccard"])
def test_state_survives_a_round_trip(engine):
    cfg = MinerConfig(sim_th=0.4, max_clusters=3, engine=engine)
    lines = [f"{a} {b} {c} n{c}" for a in "xyz" for b in "pq" for c in range(4)]
    whole, resumed = Sequential(cfg), Sequential(cfg)
    for x in lines:
        expected = whole.add(x)
        for name, shard in list(resumed.shards.items()):
            resumed.shards[name] = Shard(cfg, list(shard.rows()))
        assert resumed.add(x) == expected


def test_set_score():
    assert set_score({"a"}, {"a"}) == 1.0
    assert set_score(set(), set()) == 1.0
    assert set_score({"a", "b"}, {"c", "d"}) == 0.0
    assert set_score({"a", "b"}, {"a", "c"}) == pytest.approx(1.3 / 3)


def test_set_engine_matches_wildcards():
    shard = Shard(MinerConfig(sim_th=0.4, engine="jaccard"))
    for line in ("a b", "a c"):
        shard.add(line.split(), 0)
    assert shard.templates[1] == ["a", "<*>"]
    assert shard.best(shard.route(["a", "z"]), ["a", "z"], 0.8, True) == 1


@pytest.mark.parametrize("engine,cap", [("length", None), ("length", 20), ("jaccard", None), ("jaccard", 20)])
def test_search_equals_a_look_at_every_cluster(engine, cap, monkeypatch):
    rng = random.Random(5)
    caps = {"max_clusters": cap} if engine == "length" else {"max_clusters_per_word": cap}
    cfg = MinerConfig(sim_th=0.5, engine=engine, **caps)
    words = [chr(97 + i % 26) * (1 + i // 26) for i in range(40)] + ["<*>", "7"]
    lines = [" ".join(["a", *(rng.choice(words[:2 + i % 40]) for _ in range(rng.randint(0, 6)))]) for i in range(600)]
    found = [feed(cfg, lines)]
    everything = lambda leaf, *_: np.fromiter(leaf.at.values(), np.int64, len(leaf.at))
    monkeypatch.setattr(Shard, "_similar", lambda self, leaf, *_: everything(leaf))
    monkeypatch.setattr(Shard, "_overlapping", lambda self, leaf, *_: everything(leaf))
    found.append(feed(cfg, lines))
    assert found[0][1] == found[1][1]
    assert [{n: list(s.rows()) for n, s in m.shards.items()} for m, _ in found][0] == {
        n: list(s.rows()) for n, s in found[1][0].shards.items()}


def test_a_line_looks_at_few_of_many_clusters():
    rng = random.Random(6)
    shard = Shard(MinerConfig(sim_th=0.8, max_clusters=None))
    lines = [["x", *(f"{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(9))] for _ in range(3000)]
    for i, tokens in enumerate(lines):
        shard.add(tokens, i)
    leaf = shard.leaves[("x",)]
    assert len(leaf.at) > 2900
    assert max(len(shard._similar(leaf, shard._seen(t))) for t in lines[:200]) < 100


def test_set_engine_leaves_the_longest_lists_unread(monkeypatch):
    """Tokens that all templates have tell nothing; templates are found by the others, and the result is that of all of them."""
    from faultline.operators import mining_core

    rng, read, often = random.Random(7), [], mining_core._often
    shard = Shard(MinerConfig(sim_th=0.8, engine="jaccard"))
    lines = [["x", "y", "the", "of", *(f"{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(10))] for _ in range(2000)]
    for i, tokens in enumerate(lines):
        shard.add(tokens, i)
    leaf = shard.leaves[("y",)]
    assert len(leaf.at) > 1900
    monkeypatch.setattr(mining_core, "_often", lambda lists, *more: (read.append(sum(map(len, lists))), often(lists, *more))[1])
    for tokens in lines[:100]:
        ids = leaf.live()
        best = max(shard._set_scores(ids, tokens, False))
        assert best in shard._set_scores([leaf.ids[i] for i in shard._overlapping(leaf, tokens, 0.8, False)], tokens, False)
    assert read and max(read) < 3000  # the four common lists have 7600 entries and more
