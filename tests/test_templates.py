"""Mining and matching on Spark: chunked rounds equal a sequential run, strategies, catalogue."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import hourly, params, templates as tp
from faultline.operators.mining_core import MinerConfig
from faultline.operators.params import extract_parameters, parameter_values
from faultline.session import fresh_dir
from test_mining_core import Sequential


def frame(spark, lines, start=0):
    rows = [(i + start, x, x.split(), 1000 + i) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "id bigint, message string, tokens array<string>, ts bigint")


def noise(n, seed=1):
    """Lines of a few shapes with a hot token count and new shapes turning up now and then."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if i % 37 == 0:
            out.append(f"w{i} starts job {rng.choice('abc')} now")
        elif rng.random() < 0.6:
            out.append(f"link {rng.choice(['up', 'down'])} port {rng.randint(0, 9)} {rng.choice(['ok', 'bad'])}")
        elif rng.random() < 0.5:
            out.append(f"user {rng.choice('pqrs')} logged in")
        else:
            out.append("")
    return out


@pytest.mark.parametrize("cfg,chunk,lead", [
    (MinerConfig(sim_th=0.4, max_clusters=None), 90, 1),
    (MinerConfig(sim_th=0.4, max_clusters=None), 40, 3),
    (MinerConfig(sim_th=0.6, max_clusters=3, max_children=3), 80, 1),
    (MinerConfig(sim_th=0.8, max_clusters_per_word=2, engine="jaccard"), 100, tp.LEAD),
])
def test_rounds_equal_a_sequential_run(spark, cfg, chunk, lead):
    lines = noise(100)
    model = Sequential(cfg)
    expected = []
    for i, x in enumerate(lines):
        change, (name, cid), shown = model.add(x)
        expected.append((i, str(name), cid, change, model.sizes[(name, cid)], shown, 1000 + i))
    got, catalog = tp.mine_templates(frame(spark, lines), "tokens", ["id"], cfg, ts="ts", chunk_tokens=chunk, lead=lead)
    rows = sorted((r["id"], r["shard"], r["local_id"], r["change_type"], r["cluster_size"], r["template_mined"],
                   r["latest_ts"]) for r in got.collect())
    assert rows == expected
    live = {(r["shard"], r["local_id"]): (r["size"], r["tokens"]) for r in tp.live_templates(catalog).collect()}
    assert live == {(str(n), c): (model.sizes[(n, c)], t) for n, s in model.shards.items() for c, t in s.templates.items()}


def test_resume_equals_one_run(spark):
    cfg, lines = MinerConfig(sim_th=0.5, max_clusters=3), noise(90, 5)
    whole, all_catalog = tp.mine_templates(frame(spark, lines), "tokens", ["id"], cfg, ts="ts")
    path = fresh_dir(spark, "catalog")
    tp.save_catalog(tp.mine_templates(frame(spark, lines[:50]), "tokens", ["id"], cfg, ts="ts")[1], path)
    late, catalog = tp.mine_templates(frame(spark, lines[50:], 50), "tokens", ["id"], cfg, initial=tp.load_catalog(spark, path),
                                      chunk_tokens=100)
    cols = ["id", "cluster_id", "change_type", "cluster_size", "template_mined"]
    assert sorted(late.select(cols).collect()) == sorted(whole.filter("id >= 50").select(cols).collect())
    keep = ["cluster_id", "tokens", "size", "leaf_path", "tree_ord"]
    assert sorted(map(str, catalog.select(keep).collect())) == sorted(map(str, all_catalog.select(keep).collect()))


def matched(spark, catalog, lines, strategy, cfg):
    found = tp.match_templates(frame(spark, lines), catalog, strategy, cfg).collect()
    local = {" ".join(r["tokens"]): r["cluster_id"] % (1 << tp.ID_BITS) for r in found}
    return [local.get(x) for x in lines]


def test_match_only(spark):
    # fixed values: golden vectors
    cfg = MinerConfig(sim_th=0.4, max_clusters=None)
    catalog = tp.mine_templates(frame(spark, ["aa aa aa", "aa aa bb", "aa aa cc", "xx yy zz"]), "tokens", ["id"], cfg)[1].cache()
    for strategy in ("never", "fallback", "always"):
        got = matched(spark, catalog, ["aa aa tt", "xx yy zz", "xx yy rr", "nothing"], strategy, cfg)
        assert got == [1, 2, None, None]


@pytest.mark.parametrize("numeric,never", [(True, False), (False, True)])
def test_match_strategies(spark, numeric, never):
    # fixed values: golden vectors
    cfg = MinerConfig(sim_th=0.4, max_clusters=None, parametrize_numeric=numeric)
    lines = ["training4Model start", "loadModel start", "loadModel stop", "this is a test"]
    catalog = tp.mine_templates(frame(spark, lines), "tokens", ["id"], cfg)[1].cache()
    got = {s: matched(spark, catalog, ["loadModel start", ""], s, cfg) for s in ("never", "fallback", "always")}
    assert [x is not None for x in got["never"]] == [never, False]
    assert [x is not None for x in got["fallback"]] == [x is not None for x in got["always"]] == [True, False]
    again = tp.mine_templates(frame(spark, lines + [""]), "tokens", ["id"], cfg)[1].cache()
    assert all(matched(spark, again, [""], s, cfg) == [1] for s in ("never", "fallback", "always"))


def test_matching_equals_the_tree_walk(spark):
    """All strategies against the shard code, over noise with wildcards in routed places."""
    cfg = MinerConfig(sim_th=0.4, max_clusters=None, depth=5, max_children=4)
    lines, asked = noise(150, 3), noise(80, 9) + ["link up port 3 odd", "w9 starts job z now", "user p logged out"]
    model = Sequential(cfg)
    for x in lines:
        model.add(x)
    catalog = tp.mine_templates(frame(spark, lines), "tokens", ["id"], cfg)[1].cache()
    for strategy in ("never", "fallback", "always"):
        got = {" ".join(r["tokens"]): r["cluster_id"] % (1 << tp.ID_BITS)
               for r in tp.match_templates(frame(spark, asked), catalog, strategy, cfg).collect()}
        for x in set(asked):
            words = x.split()
            shard = model.shards.get(len(words))
            want = None
            if shard:
                routed = shard.best(shard.route(words), words, 1.0, True)
                order = [r["local_id"] for r in shard.rows() if r["local_id"] is not None]
                fits = [c for c in order if all(t in (w, "<*>") for t, w in zip(shard.templates[c], words))]
                full = max(fits, key=lambda c: (shard.templates[c].count("<*>"), -order.index(c)), default=None)
                want = {"never": routed, "fallback": full if routed is None else routed, "always": full}[strategy]
            assert got.get(x) == want, (strategy, x)


def test_jaccard_unequal_lengths(spark):
    # fixed values: golden vectors
    cfg = MinerConfig(sim_th=0.4, max_clusters=None, engine="jaccard")
    lines = ["check pass; user unknown", "check pass; user Lisa", "check pass; user li Sa",
             "session opened for user cyrus by (uid=0)", "session closed for user cyrus"]
    model = Sequential(cfg)
    expected = [model.add(x)[2] for x in lines]
    got, catalog = tp.mine_templates_jaccard(frame(spark, lines), "tokens", ["id"], cfg)
    assert [r["template_mined"] for r in got.orderBy("id").collect()] == expected
    asked = ["check pass; user boris", "session opened for user cyrus by (uid=1)", "nothing"]
    found = {" ".join(r["tokens"]): r["local_id"] for r in
             tp.match_templates_jaccard(frame(spark, asked), catalog, cfg).collect()}
    assert found == {asked[0]: 1, asked[1]: 1}
    salted = tp.match_templates_jaccard(frame(spark, asked), catalog, cfg, lines_per_task=1).count()
    assert salted == 2


def test_distinct_mining_counts_rows(spark):
    rows = frame(spark, ["a b c"] * 5 + ["a b d"] * 2)
    out, catalog = tp.mine_templates_distinct(rows, "tokens", ["id"], MinerConfig(sim_th=0.4))
    assert {r["template"] for r in out.collect()} == {"a b <*>"}
    assert [r["size"] for r in tp.live_templates(catalog).collect()] == [7]


RULES = [  # fixed values: mask patterns of the golden vectors
    (r"hdfs://[\w.:@-]*((/[\w.~%+-]+)+/?)?", "hdfs_uri"),
    (r"(?P<quote>[\"'`]).*?(?P=quote)", "quoted_string"),
    (r"((?P<p_0>[*_])\2{0,2}).*?\1", "markdown_emph"),
    (r"multiple \*word\* pattern", "*words*"),
    (r"some \S+ \S+ pattern", "*words*"),
    (r"(\d{1,3}\.){3}\d{1,3}", "ip"),
    (r"(?P<number>\d+)\.\d+", "float"),
    (r"0[xX][a-fA-F0-9]+", "integer"),
    (r"(?P<number>\d+)", "integer"),
    (r"HelloWorld", "*"),
    (r"MaskPrefix", "<"),
]
VECTORS = [  # fixed values: template, message, values, mask names
    ("<hdfs_uri>:<integer>+<integer>", "hdfs://msra-sa-41:9000/pageinput2.txt:671088640+134217728",
     ["hdfs://msra-sa-41:9000/pageinput2.txt", "671088640", "134217728"], ["hdfs_uri", "integer", "integer"]),
    ("<quoted_string><quoted_string>", """'This "should"'`do no breakin'`""",
     ["""'This "should"'""", "`do no breakin'`"], ["quoted_string", "quoted_string"]),
    ("This is <markdown_emph> <markdown_emph>!.", "This is ___very___ *important*!.",
     ["___very___", "*important*"], ["markdown_emph", "markdown_emph"]),
    ("<float>.<*>", "0.15.Test", ["0.15", "Test"], ["float", "*"]),
    ("<ip>:<integer>:<integer>", "192.0.0.1:5000:123", ["192.0.0.1", "5000", "123"], ["ip", "integer", "integer"]),
    ("<float>.<*>.<float>", "0.15.Test.0.2", ["0.15", "Test", "0.2"], ["float", "*", "float"]),
    ("<*words*>@<integer>", "some other cool pattern@0xe1f", ["some other cool pattern", "0xe1f"], ["*words*", "integer"]),
    ("Another test with <*words*> that includes <integer><integer> and <integer> <*> <integer>",
     "Another test with some other 0Xadded pattern that includes 500xc0ffee and 0X4 times 5",
     ["some other 0Xadded pattern", "50", "0xc0ffee", "0X4", "times", "5"],
     ["*words*", "integer", "integer", "integer", "*", "integer"]),
    ("<*words*> <*>", "multiple *word* pattern <*words*>", ["multiple *word* pattern", "<*words*>"], ["*words*", "*"]),
    ("<*> <*>", "HelloWorld <anything>", ["HelloWorld", "<anything>"], ["*", "*"]),
    ("<*><integer>", "HelloWorld1", ["HelloWorld", "1"], ["*", "integer"]),
    ("<memory:<integer> <core:<float>>>", "<memory:8 <core:0.5>>", ["8", "0.5"], ["integer", "float"]),
    ("<*> <memory:<<integer> <core:<float>>>", "New: <memory:<8 <core:0.5>>", ["New:", "8", "0.5"], ["*", "integer", "float"]),
    ("<<>", "MaskPrefix", ["MaskPrefix"], ["<"]),
    ("<<<>>", "<MaskPrefix>", ["MaskPrefix"], ["<"]),
    ("There are no parameters here.", "There are no parameters here.", [], []),
    ("<float> <float>", "0.15 10.16 3.19", None, None),
    ("<memory:<<integer> <core:<float>>>", "<memory:8 <core:0.5>>", None, None),
    ("<<>", "<<>", None, None),
    ("<*words*> <*words*>", "0.15 0.15", None, None),
]


def test_extract_parameters(spark):
    df = spark.createDataFrame([(i, t, m) for i, (t, m, _v, _n) in enumerate(VECTORS)], "i int, t string, m string")
    got = df.withColumn("p", extract_parameters(F.col("t"), F.col("m"), RULES)).orderBy("i").collect()
    for row, (t, m, values, names) in zip(got, VECTORS):
        if values is None:
            assert row["p"] is None
        else:
            assert [p["value"] for p in row["p"]] == values and [p["mask_name"] for p in row["p"]] == names


def test_parameters_in_the_jvm_equal_those_in_python(spark, monkeypatch):
    more = [(None, "x"), ("a <*>", None), ("", ""), ("a <*> b", "a \n b"), ("<*>", "line\nbreak"), ("<*> <*>", "\u00e9\u3000\u0663 x")]
    df = spark.createDataFrame([(i, t, m) for i, (t, m) in enumerate([v[:2] for v in VECTORS] + more)] * 2, "i int, t string, m string")
    for exact in (True, False):
        got = params.with_parameters(df, "t", "m", RULES, exact=exact, name="p")
        want = df.withColumn("p", extract_parameters(F.col("t"), F.col("m"), RULES, exact=exact))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        monkeypatch.setattr(params, "JVM_STEPS", 4)
    assert params.jvm_pattern("(?(1)a|b)") is None and params.jvm_pattern("(?P<v_0>x)(?P=v_0)") == "(?Ud)(?<v0>x)\\k<v0>"


def test_parameter_values(spark):
    df = spark.createDataFrame([("hello <*>", "hello \t BCD"), ("hello <*>", "bye")], "t string, m string")
    got = df.select(parameter_values(F.col("t"), F.col("m")).alias("v")).collect()
    assert [r["v"] for r in got] == [["BCD"], []]


def letters(n):
    return "".join(chr(97 + n // 26 ** k % 26) for k in range(3))


def mined_in_rounds(spark, monkeypatch, lines, cfg, chunk, lead=1):
    """(as compared with a sequential run, number of rounds)"""
    rounds, settle = [], tp.settle
    monkeypatch.setattr(tp, "settle", lambda df: (rounds.append("reads" in df.columns), settle(df))[1])
    model = Sequential(cfg)
    expected = []
    for i, x in enumerate(lines):
        change, (name, cid), shown = model.add(x)
        expected.append((i, str(name), cid, change, model.sizes[(name, cid)], shown))
    got, catalog = tp.mine_templates(frame(spark, lines), "tokens", ["id"], cfg, ts="ts", chunk_tokens=chunk, lead=lead)
    rows = sorted((r["id"], r["shard"], r["local_id"], r["change_type"], r["cluster_size"], r["template_mined"])
                  for r in got.collect())
    assert rows == expected
    live = {(r["shard"], r["local_id"]): (r["size"], r["tokens"], r["tree_ord"]) for r in tp.live_templates(catalog).collect()}
    order = {(str(n), r["local_id"]): r["tree_ord"] for n, s in model.shards.items() for r in s.rows()}
    assert live == {(str(n), c): (model.sizes[(n, c)], t, order[str(n), c]) for n, s in model.shards.items()
                    for c, t in s.templates.items()}
    return sum(rounds)


def test_changes_of_different_leaves_do_not_wait(spark, monkeypatch):
    """Every chunk of four lines opens a leaf of its own: as many changes as chunks, few rounds."""
    lines = [f"{letters(i // 2)} makes {letters(i)} today" for i in range(120)]
    cfg = MinerConfig(sim_th=0.4, max_clusters=None, max_children=1000)
    assert mined_in_rounds(spark, monkeypatch, lines, cfg, 16) <= 6


def test_conflicts_on_a_leaf_cost_rounds(spark, monkeypatch):
    """All chunks change one leaf: each is run again behind the one before it."""
    lines = [f"hot {letters(i)} {letters(i + 500)} {letters(i + 900)}" for i in range(24)]
    cfg = MinerConfig(sim_th=0.9, max_clusters=None)
    assert mined_in_rounds(spark, monkeypatch, lines, cfg, 16) == 6


@pytest.mark.parametrize("cap,children", [(5, 1000), (None, 6)])
def test_caps_reached_by_tries(spark, monkeypatch, cap, children):
    """Forgotten clusters and full nodes depend on all lines before; such tries are not taken."""
    rng = random.Random(9)
    lines = [f"{letters(rng.randint(0, 11))} does {letters(rng.randint(0, 3))} {rng.randint(0, 5)}" for i in range(36)]
    cfg = MinerConfig(sim_th=0.7, max_clusters=cap, max_children=children)
    mined_in_rounds(spark, monkeypatch, lines, cfg, 24, lead=2)


def test_hours_broken_off_and_resumed_equal_one_run(spark):
    cfg, lines = MinerConfig(sim_th=0.5, max_clusters=3), noise(60, 8)
    rows = spark.createDataFrame([(i, x.split(), i * 97) for i, x in enumerate(lines)], "id bigint, tokens array<string>, sec bigint")
    rows = rows.withColumn("ts", F.timestamp_seconds("sec"))
    whole, _ = tp.mine_templates(rows, "tokens", ["id"], cfg)
    want = sorted((r["id"], r["cluster_id"], r["template_mined"]) for r in whole.collect())
    for stop_at in (0, 1):
        out, seen = fresh_dir(spark, "hours"), []

        def stop(hour):
            seen.append(hour)
            if len(seen) == stop_at + 1:
                raise InterruptedError

        with pytest.raises(InterruptedError):
            hourly.assign_by_hour(rows, "tokens", "ts", ["id"], out, cfg, after_hour=stop)
        assert [r["hour"] for r in hourly.read_log(spark, out).orderBy("hour").collect()] == seen[:-1]
        log = hourly.assign_by_hour(rows, "tokens", "ts", ["id"], out, cfg, after_hour=seen.append).orderBy("hour").collect()
        assert seen[stop_at] == seen[stop_at + 1] and [r["hour"] for r in log] == ["1970-01-01-00", "1970-01-01-01"]
        got = hourly.read_assigned(spark, out)
        assert sorted((r["id"], r["cluster_id"], r["template_mined"]) for r in got.collect()) == want
        again = hourly.assign_by_hour(rows, "tokens", "ts", ["id"], out, cfg, after_hour=seen.append)
        assert len(seen) == 3 and again.count() == 2
    early = rows.filter("id < 1").withColumn("ts", F.timestamp_seconds(F.lit(-5000)))
    with pytest.raises(ValueError, match="after hour"):
        hourly.assign_by_hour(early, "tokens", "ts", ["id"], out, cfg)


def test_small_chunks_do_not_make_many_rounds(spark, monkeypatch):
    """All chunks change one leaf; the lead doubles, so 60 chunks take few rounds (nine with a lead of eight)."""
    lines = [f"hot {letters(i)} {letters(i + 500)} {letters(i + 900)}" for i in range(240)]
    assert mined_in_rounds(spark, monkeypatch, lines, MinerConfig(sim_th=0.9, max_clusters=None), 16, None) <= 5


def test_forgotten_clusters_stay_accounted_for(spark):
    cfg, lines = MinerConfig(sim_th=0.8, max_clusters=2), noise(80, 7)
    rows = frame(spark, lines)
    got, catalog = tp.mine_templates(rows, "tokens", ["id"], cfg, chunk_tokens=60)
    assert tp.live_templates(catalog).agg(F.sum("size")).first()[0] < 80
    assert catalog.agg(F.sum("size")).first()[0] == 80
    ended = {r["cluster_id"]: r["template"] for r in tp.ended_templates(got, catalog, ["id"]).collect()}
    live = {r["cluster_id"]: " ".join(r["tokens"]) for r in tp.live_templates(catalog).collect()}
    last = {r["cluster_id"]: r["template_mined"] for r in got.orderBy("id").collect()}
    assert ended and {**ended, **live} == last and not ended.keys() & live.keys()
    path = fresh_dir(spark, "catalog")
    tp.save_catalog(tp.mine_templates(frame(spark, lines[:40]), "tokens", ["id"], cfg)[1], path)
    resumed = tp.mine_templates(frame(spark, lines[40:], 40), "tokens", ["id"], cfg, initial=tp.load_catalog(spark, path))[1]
    sizes = [{r["shard"]: r["n"] for r in c.groupBy("shard").agg(F.sum("size").alias("n")).collect()} for c in (catalog, resumed)]
    assert sizes[0] == sizes[1] and sum(sizes[0].values()) == 80


def test_distinct_mining_keeps_lines_of_forgotten_clusters(spark):
    lines = [f"{letters(i)} runs {letters(i + 50)}" for i in range(12)] * 2
    out, catalog = tp.mine_templates_distinct(frame(spark, lines), "tokens", ["id"], MinerConfig(sim_th=0.8, max_clusters=3))
    assert {r["message"]: r["template"] for r in out.collect()} == {x: x for x in lines}
    assert catalog.agg(F.sum("size")).first()[0] == 24 and tp.live_templates(catalog).count() == 3


def test_a_message_is_not_repeated_for_every_wildcard_set(spark):
    """Sixty wildcard sets of one length and first word: each message travels once."""
    shapes = [["go", *("<*>" if i >> b & 1 else f"w{b}" for b in range(6))] for i in range(1, 61)]
    catalog = spark.createDataFrame([("7", i, t, "go", i) for i, t in enumerate(shapes)],
                                    "shard string, local_id bigint, tokens array<string>, leaf_path string, tree_ord bigint")
    asked = [["go", *(f"{'xw'[i >> b & 1]}{b}" for b in range(6))] for i in range(64)]
    msgs = spark.createDataFrame([(t,) for t in asked], "tokens array<string>")
    for fewest in (False, True):
        found = tp.match_templates(msgs, catalog, "never", MinerConfig(), fewest, tokens_per_task=50)
        got = {" ".join(r["tokens"]): r["cluster_id"] - (7 << tp.ID_BITS) for r in found.collect()}
        want = {}
        for words in asked:
            fits = [i for i, t in enumerate(shapes) if all(a in ("<*>", b) for a, b in zip(t, words))]
            if fits:
                n = [shapes[i].count("<*>") for i in fits]
                want[" ".join(words)] = min(i for i, k in zip(fits, n) if k == (min(n) if fewest else max(n)))
        assert got == want
    assert "array_contains" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_cut_into_tokens_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = frame(spark, noise(300))
    rows = rows.mapInArrow(counted, rows.schema)
    lines, _ = tp.mine_templates(rows, "tokens", ["id"], MinerConfig(sim_th=0.4), chunk_tokens=200)
    assert lines.count() == 300 and read.value == 300


def test_first_round_of_a_resumed_run_is_not_judged(spark, monkeypatch):
    """A run that is alone in its round leaves the whole state."""
    cfg, lines = MinerConfig(sim_th=0.6, max_clusters=5, max_children=4), noise(400)
    half = tp.mine_templates(frame(spark, lines[:200]), "tokens", ["id"], cfg)[1].localCheckpoint()
    want = tp.mine_templates(frame(spark, lines), "tokens", ["id"], cfg)[1].collect()

    def refuse(key, runs, state):
        raise AssertionError("judged")

    monkeypatch.setattr(tp, "_judge", lambda *a: refuse)
    got = tp.mine_templates(frame(spark, lines[200:], 200), "tokens", ["id"], cfg, initial=half)[1].collect()

    def shown(rows):
        return sorted((r["shard"], r["local_id"] or 0, " ".join(r["tokens"] or ()), r["leaf_path"], r["size"] or 0) for r in rows)

    assert shown(got) == shown(want)


def test_rows_are_matched_where_they_are(spark):
    """Repeated, empty, null and unknown messages keep their other columns, and found templates are not joined back."""
    shapes = [["go", "<*>", "x"], ["go", "a", "<*>"], ["<*>", "b", "x"], []]
    catalog = spark.createDataFrame([(str(len(t)), i, t, t[0] if t else "", i) for i, t in enumerate(shapes)],
                                    "shard string, local_id bigint, tokens array<string>, leaf_path string, tree_ord bigint")
    asked = [["go", "a", "x"], ["go", "a", "y"], ["no", "b", "x"], ["no", "c", "x"], [], None, ["go"]] * 9
    rows = spark.createDataFrame([(i, w, {"k": i}) for i, w in enumerate(asked)], "id bigint, words array<string>, m map<string,bigint>")
    vocab = spark.createDataFrame([("go <*> x", 7), ("", 8)], "token string, id bigint")
    for strategy, want in (("never", [0, 1, 2, None, 3, None, None]), ("always", [0, 1, 2, None, 3, None, None])):
        out = tp.map_templates(rows, "words", catalog, strategy, MinerConfig(), vocab=vocab, tokens_per_task=12)
        got = {r["id"]: r for r in out.collect()}
        assert len(got) == len(asked)
        for i, w in enumerate(asked):
            r, t = got[i], want[i % 7]
            assert r["words"] == w and r["m"] == {"k": i}
            assert r["cluster_id"] == (None if t is None else (len(w) << tp.ID_BITS) + t)
            assert r["template"] == (None if t is None else " ".join(shapes[t]))
            assert r["log_key"] == {0: 7, 3: 8}.get(t, 1)
    assert "Join LeftOuter, (words" not in out._jdf.queryExecution().optimizedPlan().toString()
    plain = tp.map_templates(rows.select("id", "words"), "words", catalog, "never", MinerConfig())
    assert "Join LeftOuter" not in plain._jdf.queryExecution().optimizedPlan().toString()
    broken = spark.createDataFrame([(["go", None, "x"],)], "words array<string>")
    with pytest.raises(Exception, match="token is null"):
        tp.map_templates(broken, "words", catalog).collect()


def test_lines_with_tokens_are_not_masked_again(spark):
    from faultline.plans import stand_ins
    from faultline.plans.sequences import PRODUCTION, keyed_events, masked_tokens
    from faultline.plans import all_queries

    sf = "/root/testdata/sf0.001"
    lines = stand_ins.lines(spark, sf).withColumnRenamed("host", "ip")
    masked = masked_tokens(lines).localCheckpoint()
    catalog = tp.mine_templates(masked, "tokens", ["timestamp", "event_id"], PRODUCTION)[1].localCheckpoint()
    keys = tp.live_templates(catalog).select(F.array_join("tokens", " ").alias("token"), F.col("local_id").alias("id")).distinct()
    keys = keys.groupBy("token").agg(F.min("id").alias("id"))
    devices = lines.select(F.col("ip").alias("token"), F.lit(3).alias("id")).distinct()
    args = (stand_ins.incidents(spark, sf), catalog, keys, devices, PRODUCTION, "fallback")
    once = keyed_events(masked, *args)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, keyed_events(lines, *args).collect()))
    assert "regexp_replace" not in once._jdf.queryExecution().optimizedPlan().toString()
    found = all_queries()[0]["m8_match_jaccard"](spark, sf)
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_distinct_mining_matches_once_however_often_it_is_read(spark):
    lines = [f"a b {i % 3} {i % 5}" for i in range(60)] + ["", "q"] * 4
    out, _ = tp.mine_templates_distinct(frame(spark, lines).select("id", "tokens"), "tokens", ["id"], MinerConfig(sim_th=0.4))
    assert "FlatMapCoGroupsInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(lines) and all(got[i]["tokens"] == x.split() and got[i]["cluster_id"] is not None for i, x in enumerate(lines))


@pytest.mark.parametrize("chunk_tokens", [40, tp.CHUNK_TOKENS])
def test_mining_keeps_no_copy_that_nothing_reads(spark, monkeypatch, tmp_path, chunk_tokens):
    """Rounds leave the lines they mined and the last state behind: no copy of the lines, no earlier state, no checkpoint."""
    monkeypatch.setattr(tp, "fresh_dir", lambda _, label: f"{tmp_path}/{label}-{len(list(tmp_path.iterdir()))}-{random.random()}")
    tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(tidy)
    rows = spark.createDataFrame([(i, f"w{i % 7} b {i % 5} d e f g h{i % 11}".split()) for i in range(200)], "i long, tokens array<string>")
    lines, catalog = tp.mine_templates(rows, "tokens", ["i"], chunk_tokens=chunk_tokens)
    assert lines.count() == 200 and catalog.agg(F.sum("size")).first()[0] == 200
    held = ["mining-round"] if chunk_tokens == tp.CHUNK_TOKENS else ["mined-lines", "mined-state"]
    assert sorted(p.name.split("-0.")[0].rsplit("-", 1)[0] for p in tmp_path.iterdir()) == held
    for frame_ in (lines, catalog):
        assert "Scan ExistingRDD" not in frame_._jdf.queryExecution().toString()
    assert spark.conf.get(tidy) == was
