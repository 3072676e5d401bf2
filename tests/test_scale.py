"""Order, similarity, metrics and extractors: against brute force, and with the keys that large tables have."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import checks, detectors, extractors, metrics, order
from inkwell.packs import LATIN, ZH, Profile
from inkwell.plans import analysis
from inkwell.sources import manuscripts as ms

from .test_analyses import chapters


def places(spark, rows):
    return spark.createDataFrame(rows, "project_id string, path string, chunk_index long, v long").repartition(5)


@pytest.fixture
def many_segments(spark):
    """Small tables in as many segments as there are partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_order_by_segments(spark, many_segments):
    rnd = random.Random(7)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), f"{rnd.randint(0, 40):02d}", i, rnd.randint(0, 2)) for i in range(300)]
    x = order.segmented(places(spark, rows))
    assert x.select("segment").distinct().count() > 1
    got = order.last_where(order.numbered(order.with_previous(order.running_sum(x, "v", "sum"), F.col("v"))).withColumn("flag", F.col("v") == 2), "flag", "n", "at")
    made = {(r.project_id, r.path, r.chunk_index): (r.n, r["sum"], r["last"], r["at"]) for r in got.collect()}
    for p in ("a", "b", None):
        total, last, at = 0, None, 0
        for n, (_, path, i, v) in enumerate(sorted(r for r in rows if r[0] == p), 1):
            total, at = total + v, n if v == 2 else at
            assert made[p, path, i] == (n, total, last, at)
            last = v
    assert order.numbered(order.segmented(places(spark, []))).count() == 0


def test_streaks_and_windows_across_segments(spark, many_segments):
    rnd = random.Random(3)
    texts = [rnd.choice(["打脸 震惊", "挑衅 打脸 震惊", "山", "突破", "山" * 40]) for _ in range(60)]
    c = chapters(spark, *texts)
    has = [any(k in t for k in ZH.streak) for t in texts]
    assert checks.low_streak(c, ZH).first().ends_at == next(i + 1 for i in range(2, 60) if not any(has[i - 2 : i + 1]))
    sig = [(any(k in t for k in ZH.setups), any(k in t for k in ZH.reactions), sum(k in t for k in ZH.events)) for t in texts]
    events = [(s, i) for i, s in enumerate(sig) if s[2] >= 2]
    best, length = (0, 0), 0
    for k, (s, i) in enumerate(events):
        length = length + 1 if k and events[k - 1][0] == s else 1
        best = max(best, (length, -events[k - length + 1][1]))
    run = checks.diminishing_runs(c, ZH).first()
    assert (run.length, -run.chunk_index) == best
    rows = metrics.in_order(metrics.narrow(c, ZH))
    ups = [i for i, t in enumerate(texts) if any(k in t for k in ZH.upgrade)]
    assert metrics.keyword_interval(rows).first().upgrade_interval == pytest.approx((ups[-1] - ups[0]) / (len(ups) - 1))
    busy = [sum(k in t for k in ZH.events + ZH.conflict) for t in texts]
    mean = sum(map(len, texts)) / 60
    risky = sum(sum(busy[i : i + 5]) < 2 and sum(map(len, texts[i : i + 5])) > 7.5 * mean for i in range(56))
    assert metrics.pacing_flatness(rows).first().pacing_flatness == pytest.approx(risky / 56)


def test_order_plans_hold_no_project(spark):
    """No window over chunks is dealt by project alone."""
    c = chapters(spark, *["打脸 震惊"] * 4)
    for made in (checks.low_streak(c, ZH), checks.diminishing_runs(c, ZH), metrics.pacing_flatness(metrics.narrow(c, ZH))):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line and "segment" not in line:
                pytest.fail(line)


def test_identity_terms_in_one_scan(spark):
    c = spark.createDataFrame([("p", "a", 0, "主角是皇帝")], "project_id string, path string, chunk_index long, content string")
    plan = checks.identity_evidence(c, ZH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1 and "Union" not in plan


def test_similar_pairs_of_a_common_token(spark):
    """20,000 sets share a token; blocks of 100 meet."""
    rows = spark.range(20_000).select(F.lit("p").alias("project_id"), F.lit("a").alias("path"), F.col("id").alias("chunk_index"), F.lit("t").alias("title"), F.concat(F.lit("common "), F.repeat(F.concat(F.lit("x"), F.col("id")), 7)).alias("content"), F.col("id").cast("string").alias("chunk_id"))
    twins = rows.withColumn("content", F.concat("content", F.lit(" "), F.repeat(F.lit("y"), 20)))
    assert detectors.similar_pairs(rows, LATIN, block=100).count() == 0
    assert detectors.similar_pairs(rows.where("chunk_index < 300").unionByName(twins.where("chunk_index < 300")), LATIN, block=100).count() == 300


@pytest.mark.parametrize("block", [3, 2000])
def test_similar_pairs_by_hand(spark, block):
    rnd = random.Random(block)
    said = [" ".join(rnd.choice(["river", "stone", "window", "mountain", "silver", "garden", "lantern"]) for _ in range(rnd.randint(3, 8))) for _ in range(50)]
    sets = {frozenset(x.split()) for x in said if len(x) >= 20}
    want = {frozenset((a, b)) for a in sets for b in sets if a != b and len(a & b) >= 0.6 * len(a | b) - 1e-9}
    got = detectors.similar_pairs(chapters(spark, *said), LATIN, block=block).collect()
    assert {frozenset((frozenset(r.ta), frozenset(r.tb))) for r in got} == want and len(got) == len(want)


def greedy(texts, alike, most=5):
    group, n = {}, 0
    for i in range(len(texts)):
        if i in group:
            continue
        friends = [j for j in range(i + 1, len(texts)) if j not in group and alike(i, j)][: most - 1]
        if friends:
            group |= dict.fromkeys([i, *friends], n)
            n += 1
    return {frozenset(j for j, k in group.items() if k == g) for g in group.values()}


def groups_of(rows):
    made = {}
    for r in rows:
        made.setdefault((r.component, r.group_no), set()).add(r.chunk_index)
    return {frozenset(x) for x in made.values()}


def test_groups_of_a_long_chain_and_of_copies(spark):
    chain = [" ".join(f"w{k:04d}x" for k in range(i, i + 5)) for i in range(1000)]  # each is like the next: 4 of 6 tokens
    copies = ["many copies of one and the same paragraph"] * 123
    texts = [t for pair in zip(chain, [*copies, *[None] * 877]) for t in pair if t]
    sets = [frozenset(t.split()) for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j]) - 1e-9
    got = detectors.similar_groups(chapters(spark, *texts), LATIN)
    assert groups_of(got.collect()) == greedy(texts, alike)


def test_metrics_by_profile(spark, tmp_path):
    for profile, entries in {"shuangwen": [("爽点密度", 1.0), ("升级间隔", 1.0), ("节奏平缓风险", 1.0)], "history": [("知识密度", 1.0), ("时代穿帮风险", 1.5), ("叙事密度", 1.0)], "common": [("人物密度", 1.0), ("地名密度", 2.0), ("章节平均字数", 3.0)]}.items():
        (tmp_path / profile).mkdir()
        (tmp_path / profile / "metrics.toml").write_text("".join(f'[[metrics]]\nid = "{i}"\nname = "{i}"\ndescription = ""\nweight = {w}\n' for i, w in entries), encoding="utf-8")
    load = lambda *ps: metrics.load_metrics([f"{tmp_path}/{p}/metrics.toml" for p in ps])
    texts = ["林澈说手机在青石街。打脸", "突破了长安城", "山", "突破", "刺史在长安"]
    c, chars = chapters(spark, *texts), sum(map(len, texts))
    read = lambda wanted, **how: {(r.profile_id, r.metric_type): (round(r.value, 6), r.unit) for r in metrics.profile_metrics(c, ZH, wanted, **how).collect()}
    got = read(load("shuangwen", "history", "common"), terms=("刺史", "长安"))
    assert len(got) == 8  # the narrative density is computed by nothing
    assert got["shuangwen", "升级间隔"] == (2.0, "chapters") and got["history", "时代穿帮风险"] == (round(1500 / chars, 6), "per_1000_chars")
    assert got["history", "知识密度"] == (round(3000 / chars, 6), "per_1000_chars") and got["common", "章节平均字数"] == (chars / 5, "chars")
    assert got["common", "人物密度"][0] == round(1000 / chars, 6) and got["common", "地名密度"][0] > 0
    assert set(read(load("shuangwen"))) == {("shuangwen", m) for m in ("爽点密度", "升级间隔", "节奏平缓风险")}
    assert read(load("common"), profile=Profile(people=False))["common", "人物密度"][0] == 0
    assert metrics.profile_metrics(c, ZH, ()).count() == 0 and metrics.profile_metrics(c.limit(0), ZH, load("history"), terms=("长安",)).count() == 0


def test_quarantine(spark, tmp_path):
    (tmp_path / "good.txt").write_text("第一章\n林澈醒来", encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(bytes.fromhex("FFFE000102"))
    good, bad, counts = ms.quarantined(ms.read_manuscripts(spark, str(tmp_path), "p"))
    assert counts == {"scanned": 1, "skipped": 1}
    assert [r.path for r in good.collect()] == ["good.txt"] and [(r.path, r.error) for r in bad.collect()] == [("bad.txt", "unreadable")]


def test_extractors_of_each_kind(spark):
    c = chapters(spark, *["林澈说他在雨夜醒来", "剑光一闪，似乎藏着秘密的铜钥匙啊", "剑光再闪"])
    sword = F.contains("content", F.lit("剑光"))
    weapons = lambda x, pack: x.where(sword).select("project_id", "path", "chunk_index", "chunk_id", F.lit("weapon").alias("node_type"), F.lit("剑光").alias("name"))
    omens = lambda x, pack: detectors.foreshadows(x, pack).withColumn("title", F.concat(F.lit("omen: "), "title"))
    alarms = lambda x, pack: detectors.repeat_terms(x, pack, 1).withColumn("issue_type", F.lit("alarm"))
    mine = extractors.chosen(Profile(people=False, places=False, items=False, repeat_terms=False)) | {
        "weapons": extractors.Extractor("mentions", weapons), "omens": extractors.Extractor("foreshadows", omens), "alarms": extractors.Extractor("issues", alarms),
    }
    made = analysis.analyze(c, ZH, (Profile(),), detector_list={"a": detectors.repeated_actions}, extractors=mine)
    assert [(r.node_type, r.name, r.occurrence_count) for r in made["candidates"].collect()] == [("weapon", "剑光", 2)]
    assert {r.title.startswith("omen: ") for r in made["foreshadows"].collect()} == {True, False}
    assert {r.title for r in made["issues"].where("issue_type = 'alarm'").collect()} == {"“雨夜”反复出现", "“秘密”反复出现"}
    with pytest.raises(ValueError):
        extractors.Extractor("nothing", weapons)


def test_issues_say_what_they_found(spark):
    c = chapters(spark, "长安的手机响了", "长安的手机和电脑", "山" * 200, "x", "y", "z")
    loud = Profile(checks=("anachronisms", "chapter_length_anomaly"))
    made = analysis.analyze(c, ZH, (loud,), detector_list={"a": detectors.repeated_actions}, terms=("长安",))["issues"].collect()
    found = {(r.issue_type, r.severity, r.title, r.description) for r in made}
    assert ("chapter_length_anomaly", "low", "章节长度异常", "第3章长度为 200 字，是平均 (36 字) 的 5.5 倍，可能过长。") in found
    assert {d for k, _, _, d in found if k == "anachronisms"} == {"在唐代背景下检测到现代词汇「手机」，可能为时代穿帮。", "在唐代背景下检测到现代词汇「电脑」，可能为时代穿帮。"}
    assert len({r.issue_id for r in made}) == len(made) == 4 and all(r.suggested_actions for r in made)
