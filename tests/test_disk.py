"""What detectors shuffle and read, and that what they find is the same as by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkwell.operators import detectors, story
from inkwell.packs import LATIN, ZH

from .test_analyses import chapters


def shuffled(spark, run):
    """Rows that the shuffles of run() take."""
    store = spark.sparkContext._jsc.sc().statusStore()
    doubles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        rows = store.stageList(None, False, False, doubles, None)
        return {(rows.apply(i).stageId(), rows.apply(i).attemptId()): rows.apply(i).shuffleWriteRecords() for i in range(rows.size())}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def test_paragraphs_like_no_other_stay_out_of_the_shuffles(spark):
    c = chapters(spark, *[" ".join(f"w{i}x{j}" for j in range(12)) for i in range(2000)]).repartition(4).cache()
    c.count()
    assert shuffled(spark, lambda: detectors.similar_pairs(c, LATIN).collect()) < 2000 * 20  # 72,000 before: each token, and each prefix twice
    assert shuffled(spark, lambda: detectors.similar_groups(c, LATIN).collect()) < 2000 * 20
    c.unpersist()


def test_pairs_in_passes_and_parts(spark):
    rnd = random.Random(5)
    said = [" ".join(rnd.choice("river stone window mountain silver garden lantern harbour meadow candle".split()) for _ in range(rnd.randint(4, 9))) for _ in range(150)]
    sets = {frozenset(x.split()) for x in said if len(x) >= 20}
    want = {frozenset((a, b)) for a in sets for b in sets if a != b and len(a & b) >= 0.6 * len(a | b) - 1e-9}
    keyed = detectors._token_keys(detectors._sets(detectors.paragraph_sets(chapters(spark, *said), LATIN)))
    for block in (2, 7, 2000):
        found = {(r.a, r.b) for r in detectors.candidate_pairs(keyed, 0.6, block, tokens=200).collect()}
        got = {frozenset((frozenset(r.ta), frozenset(r.tb))): (r.a, r.b) for r in detectors.similar_pairs(chapters(spark, *said), LATIN, block=block).collect()}
        assert set(got) == want and found >= set(got.values())


def phrases_by_hand(texts, least, n, top):
    count = {}
    for t in texts:
        clean = [re.sub(r"[\W_]+", "", s) for s in re.split(r"[。！？\n]", t)]
        for x in {s[i : i + k] for s in clean for k in range(n[0], n[1] + 1) for i in range(len(s) - k + 1)}:
            count[x] = count.get(x, 0) + 1
    some = sorted(((c, len(x), x) for x, c in count.items() if c >= least), key=lambda y: (-y[0], -y[1], y[2]))
    return [(x, c) for c, _, x in some[:top]]


@pytest.mark.parametrize("few", [0, 60])
def test_leading_phrases_by_hand(spark, few, monkeypatch):
    monkeypatch.setattr(detectors, "FEW", few)
    rnd = random.Random(few)
    texts = ["。".join("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 14))) for _ in range(6)) + "。aaaaaaaaaaaa" * rnd.randint(0, 1) for _ in range(60)]
    for n, top in (((4, 10), 15), ((3, 4), 5), ((4, 4), 15)):
        got = detectors.top_phrases(chapters(spark, *texts), least=3, n=n, top=top).orderBy("rank").collect()
        assert [(r.phrase, r.n_chunks) for r in got] == phrases_by_hand(texts, 3, n, top)


def test_phrases_shuffle_counts_not_letters(spark):
    c = chapters(spark, *["abcdefghijklmnop" * 20] * 300).repartition(4).cache()
    c.count()
    assert shuffled(spark, lambda: detectors.top_phrases(c).collect()) < 10_000  # each letter of each chunk before
    c.unpersist()


def test_chunks_are_read_once_by_all_detectors(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(x):
        seen.add(1)
        return x

    c = chapters(spark, *["林澈说：沉默。沉默了。"] * 10)
    c = c.withColumn("content", noted("content"))
    made = detectors.run_detectors(c, ZH, {k: detectors.REPEATED[k] for k in ("repeated_action", "dialogue_pattern", "psych_density")})
    made.collect()
    assert seen.value == 10


def test_dialogue_guides_by_hand(spark):
    texts = ["他说：走", "说：走", "。。。。。。。。说：", "他。。。。。。。说：", "他。。。。。。。。说：", "说 他说道：", "a说", "说：他说:好"]
    led = re.compile(r"[^\W_][\s\S]{0,7}说[：:]")
    want = sum(bool(led.search(t)) for t in texts)
    got = {r.subject: r.match_count for r in detectors.dialogue_patterns(chapters(spark, *texts), ZH, least=1).collect()}
    assert got["某某说"] == want


@pytest.mark.parametrize("block", [2, 50_000])
def test_rule_conflicts_by_hand(spark, block):
    rnd = random.Random(block)
    word = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 3)))
    rules = [(f"r{i}", [word() for _ in range(rnd.randint(1, 3))]) for i in range(30)] + [("none", [""]), ("empty", [])]
    texts = ["".join(rnd.choice("ab ") for _ in range(12)) + rnd.choice(["", "却"]) for _ in range(20)]
    c = chapters(spark, *texts)
    project = c.first().project_id
    told = spark.createDataFrame([(p, n, k, "active") for p in (project, "other") for n, k in rules], "project_id string, name string, keywords array<string>, status string")
    got = story.rule_conflicts(c, told, ZH, block=block).collect()
    want = {(n, i) for n, k in rules if any(k) for i, t in enumerate(texts) if any(x in t for x in ZH.contradictions) and all(x in t for x in k)}
    assert {(r.rule, r.chunk_index) for r in got} == want and len(got) == len(want)
    assert {r.project_id for r in got} <= {project}
