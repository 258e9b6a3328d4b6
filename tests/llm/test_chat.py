import random

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trellis.llm import chat
from trellis.llm.queries import ORACLES, op3_chat_trees

TEXT = st.lists(st.sampled_from(["<", "|", "\\", "im_end|>", "im_start|>", "\n", "a", "é", "🙂", "assistant", "s", "n"]), max_size=12).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys\ntem", "a\\n|<|"]), TEXT), min_size=1, max_size=5), min_size=1, max_size=6))
def test_round_trip(spark, convs):
    rows = [(c, t, role, text) for c, turns in enumerate(convs) for t, (role, text) in enumerate(turns)]
    out = chat.format_trees(chat.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.tree: r for r in out.withColumn("read", chat.read_back(F.col("formatted"))).withColumn("loss", chat.under_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    for c, turns in enumerate(convs):
        assert [tuple(x) for x in got[c].read] == turns
        assert got[c].loss == "".join(t for r, t in turns if r == "assistant")


def test_branches_rank_by_score(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "more", 0.0), ("t", 5, 4, "assistant", "end", 0.2), (None, 1, None, "user", "alone", 0.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    every = chat.format_trees(df, best=None).orderBy("tree", "branch").collect()
    assert [(r.tree, r.leaf, r.n_turns) for r in every] == [(None, 1, 1), ("t", 5, 4), ("t", 2, 2)]
    assert [r.leaf for r in chat.format_trees(df).orderBy("tree").collect()] == [1, 5]


def test_nulls_ties_long_threads_and_empty(spark):
    rows = [(1, None, None, None), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a")] + [(2, i, "user", str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.tree: r for r in chat.format_trees(chat.threads(df)).withColumn("read", chat.read_back(F.col("formatted"))).collect()}
    assert [tuple(x) for x in got[1].read] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert [x.text for x in got[2].read] == [str(i) for i in range(300)]
    assert chat.format_trees(chat.threads(df.limit(0))).collect() == []


def test_cycles_repeats_and_missing_parents(spark):
    rows = [("c", 1, 2, "user", "a", 0.0), ("c", 2, 1, "user", "b", 0.0), ("c", 3, 1, "assistant", "c", 1.0)]  # 3 hangs on a cycle
    rows += [("d", 5, 7, "user", "x", None), ("d", 7, 6, "user", "y", 2.0), ("d", 6, 5, "user", "z", 1.0), ("d", 7, 6, "user", "zz", 9.0), ("d", 8, 8, None, None, 0.0)]
    rows += [("e", 1, 99, "user", "orphan", 0.0), ("e", 2, 1, "user", "next", 0.0), ("e", None, 1, "user", "no node", 0.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.leaf): r for r in chat.format_trees(df, best=None).withColumn("read", chat.read_back(F.col("formatted"))).collect()}
    say = lambda *key: [x.text for x in got[key].read]
    assert set(got) == {("c", 2), ("c", 3), ("d", 7), ("d", 8), ("e", 2)}
    assert say("c", 3) == ["a", "c"] and say("c", 2) == ["a", "b"] and say("d", 7) == ["x", "z", "y"] and got["d", 7].score == 3.0
    assert say("d", 8) == [""] and say("e", 2) == ["orphan", "next"]


def test_trees_equal_brute_force(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for t in range(12):
        parent, score = {}, {}
        for n in range(rng.randint(1, 40)):
            parent[n], score[n] = (rng.randrange(n) if n and rng.random() < 0.95 else None), float(rng.randint(-3, 3))
            rows.append((t, n, parent[n], rng.choice(["user", "assistant"]), f"t{n}", score[n]))
        up = lambda n: ([] if parent[n] is None else up(parent[n])) + [n]  # noqa: B023, E731
        ranked = sorted((-sum(score[x] for x in up(n)), n) for n in parent if n not in parent.values())
        want |= {(t, n, k + 1): (-s, [f"t{x}" for x in up(n)]) for k, (s, n) in enumerate(ranked[:3])}
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").repartition(3)
    got = chat.format_trees(df, best=3).withColumn("read", chat.read_back(F.col("formatted"))).collect()
    assert {(r.tree, r.leaf, r.branch): (r.score, [x.text for x in r.read]) for r in got} == want


def test_turns_of_the_null_key_equal_the_sql(spark, tmp_path):
    rows = [(None, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(9)] + [(5, 0, "user", "one"), (5, 1, "assistant", "two")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    key = lambda r: (r[0] is not None, r[0] or 0)
    want = sorted(con.execute(ORACLES["op3_chat_trees"]).fetchall(), key=key)
    got = sorted((tuple(r) for r in op3_chat_trees(spark, str(tmp_path)).collect()), key=key)
    assert got == want and want[0][:2] == (None, 9)
