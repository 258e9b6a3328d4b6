import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trellis.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.text("ab🙂é", max_size=9)] * 2), min_size=20, max_size=60))
def test_banded_distance(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    for t in (1, 2, 3):
        got = line_dedup.edit_distance_within(df, "a", "b", t).collect()
        assert all(r._near == (distance(r.a, r.b) <= t) for r in got)


def brute(rows, edits, least):
    first, gone = [], {}
    for i, (doc, text) in enumerate(rows):
        for p, line in enumerate((text or "").split("\n")):
            if not line or doc is None:
                continue
            if any(line == x for x in first):
                gone.setdefault(i, []).append((p, 0))
            else:
                if len(line) >= least and any(len(x) >= least and abs(len(line) - len(x)) <= edits and distance(line, x) <= edits for x in first):
                    gone.setdefault(i, []).append((p, 1))
                first.append(line)
    return [("\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in dict(gone.get(i, []))), sum(not n for _, n in gone.get(i, [])), sum(n for _, n in gone.get(i, []))) for i, (_, t) in enumerate(rows)]


def test_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeéß ") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(line) + 1)
                line[at : at + rng.choice([0, 1])] = rng.choice(["", "x", "🙂"])
            lines.append("".join(line))
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "}\n\n}"), (104, "}"), (105, "z" * 3000 + "\n" + "z" * 3001), (None, rows[1][1])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_near string").repartition(5)
    got = {r.doc_id: (r.kept_text, r.n_exact, r.n_near) for r in line_dedup.dedup_lines(df).collect()}
    want = brute(rows, 2, 20)
    assert any(n for _, _, n in want) and [got[d] for d, _ in rows] == want
    shuffled = {r.doc_id: (r.kept_text, r.n_exact, r.n_near) for r in line_dedup.dedup_lines(df, broadcast_rows=0).collect()}
    assert shuffled == got


def test_repeated_rows_and_empty_table(spark):
    line = "a line that is long enough to count"
    df = spark.createDataFrame([(1, line), (1, line), (1, line + "\nmore"), (2, line)], "doc_id long, text string")
    assert sorted(r.kept_text for r in line_dedup.dedup_lines(df).collect()) in (sorted([line, line, "more", ""]), sorted(["", "", line + "\nmore", ""]))
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_text_of_many_repeated_lines(spark):
    line = "a line that is long enough to count"
    texts = [(1, "\n".join([line] * 100_000)), (2, "\n".join(f"line number {i:06} of a long text" for i in range(300)))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1].kept_text == line and (got[1].n_lines, got[1].n_exact) == (100_000, 99_999)
    assert got[2].n_exact == 0 and got[2].n_near > 250
