"""What lasts between scans: generations of tables, deltas, statuses, file state."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import detectors, mentions, metrics, story
from inkwell.packs import ZH, Profile
from inkwell.plans import analysis, deltas
from inkwell.sources.generations import Generations, Kept
from inkwell.stored import temporary
from inkwell.streaming import changes

CHUNKS = "project_id string, path string, chunk_index long, title string, content string, chunk_id string, content_hash string, word_count long"


def chunks(spark, rows):
    """rows: (project, path, index, title, content)."""
    return spark.createDataFrame([(p, d, i, t, c, f"{p}|{d}|{i}", str(hash(c)), len(c or "")) for p, d, i, t, c in rows], CHUNKS)


def told(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


# ---- generations ----


def test_generations_last_row_wins(spark, tmp_path):
    g = Generations(spark, f"file://{tmp_path}/g", {"t": Kept("k string, v long", ("k",), buckets=4)})
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v long")
    assert g.read("t").count() == 0
    assert g.commit(0, t=rows(("a", 1), ("b", 1), (None, 1))) and g.commit(3, t=rows(("a", 2), (None, 5)))
    assert not g.commit(3, t=rows(("a", 9)))
    assert sorted(map(tuple, g.read("t").collect()), key=repr) == [("a", 2), ("b", 1), (None, 5)]
    assert [tuple(r) for r in g.read("t", keys=rows((None, 0), ("z", 0))).collect()] == [(None, 5)]
    assert sorted(map(tuple, g.read("t", before=3).collect()), key=repr) == [("a", 1), ("b", 1), (None, 1)]
    with pytest.raises(ValueError):
        g.commit(1, t=rows(("a", 0)))


def test_generations_add_up(spark, tmp_path):
    g = Generations(spark, f"file://{tmp_path}/g", {"t": Kept("k string, x string, n long", ("k", "x"), ("k",), ("n",), 4)})
    rnd, sums = random.Random(1), {}
    for batch in range(12):
        some = [(rnd.choice("abc"), rnd.choice("xy"), rnd.choice([-1, 1, 2])) for _ in range(4)]
        for k, x, n in some:
            sums[k, x] = sums.get((k, x), 0) + n
        g.commit(batch, t=spark.createDataFrame(some, "k string, x string, n long"))
    assert {(r.k, r.x): r.n for r in g.read("t").collect()} == {k: n for k, n in sums.items() if n}
    one = spark.createDataFrame([("a",)], "k string")
    assert {(r.k, r.x): r.n for r in g.read("t", keys=one).collect()} == {k: n for k, n in sums.items() if n and k[0] == "a"}


def test_a_commit_that_breaks_off_leaves_no_trace(spark, tmp_path):
    g = Generations(spark, f"file://{tmp_path}/g", {"t": Kept("k string, v long", ("k",)), "u": Kept("k string, v long", ("k",))})
    rows = lambda v: spark.createDataFrame([("a", v)], "k string, v long")
    g.commit(0, t=rows(0), u=rows(0))
    bad = rows(1).withColumn("v", F.when(F.col("k") == "a", F.raise_error(F.lit("lost"))).cast("long"))
    with pytest.raises(Exception, match="lost"):
        g.commit(1, t=rows(1), u=bad)
    assert [r.v for r in g.read("t").union(g.read("u")).collect()] == [0, 0]
    assert g.commit(1, t=rows(1), u=rows(1)) and [r.v for r in g.read("t").union(g.read("u")).collect()] == [1, 1]


# ---- file state ----


def test_fifty_batches_read_no_more_than_the_first(spark, tmp_path):
    state = changes.file_state(spark, f"file://{tmp_path}")
    rnd, known = random.Random(4), {}
    for batch in range(50):
        paths = sorted({f"{rnd.randint(0, 30)}.txt" for _ in range(3)})
        there = {p: str(rnd.randint(0, 2)) for p in paths if rnd.random() < 0.8}
        want = {p: ("unchanged" if known[p] == there[p] else "modified") if p in known and p in there else "created" if p in there else "deleted" for p in paths if p in known or p in there}
        asked = spark.createDataFrame([("p", p) for p in paths], "project_id string, path string")
        docs = spark.createDataFrame([("p", p, h, None) for p, h in there.items()], "project_id string, path string, content_hash string, last_modified_at timestamp")
        assert changes.remember(state, batch, asked, docs)
        if batch % 6 == 0:
            assert {r.path: r.state for r in changes.compared(state, batch, asked, docs).collect()} == want, batch
        if batch % 10 == 7:  # a batch that failed after its commit is repeated
            assert not changes.remember(state, batch, asked, docs)
        known = {p: h for p, h in (known | there).items() if p not in paths or p in there}
        assert len(state.manifest()["runs"]["files"]) <= 6
    assert len(state.batches()) == Generations.MANIFESTS and len([p for p in (tmp_path / "state" / "files").iterdir()]) <= 6 * Generations.MANIFESTS
    assert {r.path: r.content_hash for r in state.read("files").where("NOT deleted").collect()} == known


# ---- deltas ----

WORDS = ["林澈说", "苏雨问", "走进青石街", "拿起铜钥匙", "雨夜", "沉默", "秘密", "打脸", "挑衅", "手机", "碾压", "回忆起", "林公子", "苏兄", "推开门", "山"]


def texts(rnd, n, projects=("p", "q", None)):
    return {(rnd.choice(projects), f"{i}.txt", 0): (rnd.choice(["第一章", None, "二"]), "。".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 6)))) for i in range(n)}


def same_as_whole(spark, g, now):
    whole = chunks(spark, [(*k, *v) for k, v in now.items()])
    cands = mentions.merge_aliases(mentions.candidates(mentions.mentions(whole, ZH)), whole, ZH)
    got, terms = deltas.tables(g, ZH), detectors.repeat_terms(whole, ZH)
    assert told(got["candidates"].select(*cands.columns)) == told(cands)
    assert told(got["repeat_terms"]) == told(terms)
    assert told(got["issue_counts"]) == told(metrics.issue_counts(terms.unionByName(detectors.repeated_actions(whole, ZH))))
    assert told(got["densities"]) == told(metrics.densities(metrics.narrow(whole, ZH)))
    assert told(got["flashbacks"]) == told(metrics.flashbacks(story.timeline_events(whole, ZH)))


def test_deltas_equal_a_whole_analysis(spark):
    rnd = random.Random(2)
    g, now = deltas.state(spark, temporary(spark)), texts(rnd, 40)
    none = chunks(spark, [])
    deltas.increment(g, 0, none, chunks(spark, [(*k, *v) for k, v in now.items()]), ZH)
    same_as_whole(spark, g, now)
    for batch in range(1, 3):
        touched = rnd.sample(sorted(now, key=repr), 12)
        then = dict(now)
        for k in touched[:5]:  # deleted
            del then[k]
        for k in touched[5:10]:  # modified, some in their title alone
            then[k] = (rnd.choice(["新", now[k][0]]), rnd.choice([now[k][1], now[k][1] + "。" + rnd.choice(WORDS)]))
        then |= {(p, f"{batch}-{d}", i): v for (p, d, i), v in texts(rnd, 6).items()}
        before = [(*k, *now[k]) for k in touched]  # the last two say nothing, as they stay
        after = [(*k, *v) for k, v in then.items() if k in touched or k not in now]
        assert deltas.increment(g, batch, chunks(spark, before), chunks(spark, after), ZH)
        assert not deltas.increment(g, batch, chunks(spark, before), chunks(spark, after), ZH)
        now = then
        same_as_whole(spark, g, now)
    deltas.increment(g, 9, chunks(spark, [(*k, *v) for k, v in now.items()]), none, ZH)
    assert all(t.count() == 0 for t in deltas.tables(g, ZH).values())


# ---- statuses ----


def test_a_decision_survives_the_next_scan(spark):
    state, quiet = analysis.results(spark, temporary(spark)), Profile(people=True, places=False, items=False, foreshadows=False, eye_colours=False)
    how = {"detector_list": {"a": detectors.repeated_actions}, "now": F.lit("2024-01-01 00:00:00").cast("timestamp")}
    rows = [("p", f"{i}.txt", 0, "章", "林澈说雨夜里他推开门") for i in range(4)]
    first = analysis.scan(state, 0, chunks(spark, rows), ZH, (quiet,), **how)
    kinds = {(r.issue_type, r.title) for r in first["issues"].collect()}
    assert kinds == {("repeat_expression", "“雨夜”反复出现"), ("repeated_action", "重复动作：推开")}
    decided = spark.createDataFrame([("p", t, n, "", "false_positive") for t, n in sorted(kinds)], "project_id string, issue_type string, title string, subject string, status string")
    assert analysis.set_statuses(state, 1, "issues", decided)
    more = rows + [("p", "0-new.txt", 0, "章", "林澈说雨夜里他推开门")]
    later = analysis.scan(state, 2, chunks(spark, more), ZH, (quiet,), **(how | {"now": F.lit("2025-01-01 00:00:00").cast("timestamp")}))
    got = {r.issue_type: r for r in later["issues"].collect()}
    assert {r.status for r in got.values()} == {"false_positive"} and "5 个不同章节" in got["repeated_action"].description and got["repeated_action"].created_at.year == 2024
    assert got["repeated_action"].suggested_actions and later["tasks"].count() == 0
    name = later["candidates"].where("node_type = 'person'").first()
    assert name.first_chunk_id == "p|0.txt|0" and name.occurrence_count == 5  # the first chunk of a known name stays
    again = analysis.scan(state, 2, chunks(spark, rows[:1]), ZH, (quiet,), **how)
    assert told(again["issues"]) == told(later["issues"])


def test_an_active_rule_makes_a_high_issue_and_one_task(spark):
    state, quiet = analysis.results(spark, temporary(spark)), Profile(people=False, places=False, items=False, foreshadows=False, eye_colours=False, repeat_terms=False)
    how = {"detector_list": {"a": detectors.repeated_actions}}
    rows = chunks(spark, [("p", "1.txt", 0, "一", "魔法不能凭空制造生命。"), ("p", "2.txt", 0, "二", "魔法却还是凭空制造生命了。")])
    first = analysis.scan(state, 0, rows, ZH, (quiet,), **how)
    assert first["issues"].count() == 0 and first["rules"].first().status == "candidate" and first["rules"].first().description == "从正文抽取的约束规则: 魔法不能凭空制造生命"
    active = state.read("rules").select(*analysis.TABLES["rules"].key, F.lit("active").alias("status"))
    with pytest.raises(Exception, match="unknown status"):
        analysis.set_statuses(state, 1, "rules", active.withColumn("status", F.lit("odd")))
    assert analysis.set_statuses(state, 1, "rules", active)
    found = analysis.scan(state, 2, rows, ZH, (quiet,), **how)
    assert [(r.severity, r.title, r.evidence[0].snippet) for r in found["issues"].collect()] == [("high", "可能违反规则「魔法不能凭空制造生命」", "魔法却还是凭空制造生命了。")]
    assert [r.title for r in found["tasks"].collect()] == ["[冲突] 可能违反规则「魔法不能凭空制造生命」"]
    assert analysis.scan(state, 3, rows, ZH, (quiet,), **how)["tasks"].count() == 1
