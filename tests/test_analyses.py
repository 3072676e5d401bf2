"""The analyses on small literal manuscripts."""

import io
import random
import re
import zipfile
from collections import Counter

from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.operators import checks, detectors, mentions, metrics, search, story, versions
from inkwell.packs import LATIN, ZH, Profile, merged
from inkwell.plans import analysis
from inkwell.sources import manuscripts as ms
from inkwell.streaming import changes


def chapters(spark, *texts):
    rows = [("p", "a.txt", i, f"第{i + 1}章", t, f"c{i}", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "project_id string, path string, chunk_index long, title string, content string, chunk_id string, word_count long")


def test_read_and_split(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("序章\n雨声落下\n第一章 雨夜\n林澈醒来\n第十二章 回声\n钟声响起", encoding="utf-8")
    (tmp_path / "sub" / "b.md").write_bytes(b"\xef\xbb\xbf" + "林澈走进雨里。".encode())
    (tmp_path / "g.txt").write_bytes(bytes.fromhex("C1D6B3BA"))
    (tmp_path / "bad.txt").write_bytes(bytes.fromhex("FFFE000102"))
    (tmp_path / "no.pdf").write_bytes(b"x")
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("第一段。", "", "第二段。"))
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    docs = ms.documents(ms.read_manuscripts(spark, str(tmp_path), "p"))
    got = {r.path: r for r in docs.collect()}
    assert set(got) == {"a.txt", "sub/b.md", "g.txt", "bad.txt", "d.docx"}
    assert got["g.txt"].text == "林澈" and got["g.txt"].encoding == "gb18030" and got["bad.txt"].error == "unreadable"
    assert got["sub/b.md"].text == "林澈走进雨里。" and got["sub/b.md"].encoding == "utf-8-bom" and got["sub/b.md"].kind == "markdown"
    assert got["d.docx"].text == "第一段。\n\n第二段。"
    parts = ms.chunks(docs.where("error IS NULL"), ZH).orderBy("path", "chunk_index").collect()
    assert [r.title for r in parts if r.path == "a.txt"] == ["序章", "第一章 雨夜", "第十二章 回声"]
    assert "林澈醒来" in parts[1].content and [r.start_offset for r in parts if r.path == "sub/b.md"] == [0]


def test_mentions(spark):
    c = chapters(spark, "林澈说他在雨夜醒来。林兄，你怎么在这里？他拿起铜钥匙走到青石街。")
    got = {(r.node_type, r.name): r for r in mentions.merge_aliases(mentions.candidates(mentions.mentions(c, ZH)), c, ZH).collect()}
    assert got["person", "林澈"].occurrence_count >= 2 and got["person", "林澈"].aliases == ["林兄"]
    assert any(k == "place" for k, _ in got) and ("item", "钥匙") in got


def test_repeats(spark):
    same = "他沉默地站在窗前看着远处的山峦与河流。"
    assert detectors.high_freq_phrases(chapters(spark, *[same] * 6), ZH).count() == 1
    assert detectors.high_freq_phrases(chapters(spark, same), ZH).count() == 0
    assert detectors.repeated_actions(chapters(spark, *["他拿起剑"] * 5), ZH).first().title == "重复动作：拿起"
    two = detectors.similar_paragraphs(chapters(spark, same, same + "另外的完全不同的一句话在这里。"), ZH).collect()
    assert len(two) == 1 and len(two[0].evidence) == 2
    assert detectors.similar_paragraphs(chapters(spark, "你好。", "你好。"), ZH).count() == 0
    assert detectors.dialogue_patterns(chapters(spark, *["林澈说：走吧"] * 7), ZH).where("subject = '某某说'").count() == 1
    dense = "他想也许觉得仿佛似乎知道明白以为大概应该可能突然忽然不知记得忘记怕担心希望期待疑惑怀疑" * 2
    assert detectors.psych_density(chapters(spark, dense), ZH).count() == 1
    assert detectors.psych_density(chapters(spark, f"「{dense}」" + "山" * 60), ZH).count() == 0


def test_foreshadows_and_conflicts(spark):
    assert detectors.foreshadows(chapters(spark, "那把铜钥匙似乎藏着秘密啊。"), ZH).count() == 1
    assert detectors.attribute_conflicts(chapters(spark, "林澈的黑色眼睛。", "林澈的蓝色眼睛。"), ZH).first().title.startswith("林澈")


def test_checks(spark):
    assert checks.power_regression(chapters(spark, "金丹", "炼气"), ZH).count() == 1
    assert checks.power_regression(chapters(spark, "元婴", "化神"), ZH).count() == 0
    assert checks.low_streak(chapters(spark, "a", "b", "c"), ZH).first().ends_at == 3
    assert checks.diminishing_runs(chapters(spark, *["打脸 震惊"] * 3), ZH).first().severity == "high"
    assert checks.diminishing_runs(chapters(spark, *["打脸 震惊"] * 2), ZH).first().severity == "medium"
    assert checks.diminishing_runs(chapters(spark, "打脸 震惊"), ZH).count() == 0
    assert checks.identity_conflicts(chapters(spark, "主角是皇帝", "主角是平民"), ZH).where("name = '主角'").count() == 1
    assert checks.anachronisms(chapters(spark, "长安城里有手机"), ("长安",), ZH.modern).first().word == "手机"


def test_metrics(spark):
    rows = lambda *t: metrics.narrow(chapters(spark, *t), ZH)
    assert metrics.keyword_interval(rows("a", "突破！", "b", "c", "突破！")).first().upgrade_interval == 3.0
    assert metrics.pacing_flatness(rows(*["山" * 100] * 5, *["山"] * 5)).first().pacing_flatness > 0
    assert metrics.pacing_flatness(rows(*["山"] * 5)).first().pacing_flatness == 0
    assert metrics.densities(rows("打脸了")).first().intensity < metrics.densities(rows("碾压了")).first().intensity


def test_story(spark):
    got = story.timeline_events(chapters(spark, "三天后他回来了", "贞观三年春", "回忆起那年", "平静"), ZH).orderBy("order_index").collect()
    assert [r.estimated_order for r in got] == [4, 3, None, None] and got[2].is_flashback and got[3].time_expression == ""
    rules = story.extract_rules(chapters(spark, "魔法不能凭空制造生命。"), ZH)
    assert rules.first().name == "魔法不能凭空制造生命"
    rule = spark.createDataFrame([("p", "r", ["魔法", "生命", "制造"], "confirmed")], "project_id string, name string, keywords array<string>, status string")
    text = chapters(spark, "魔法却还是凭空制造了一个生命。", "魔法没有制造生命")
    assert story.rule_conflicts(text, rule, ZH).count() == 0 and story.rule_conflicts(text, rule.withColumn("status", F.lit("active")), ZH).count() == 1
    assert spark.createDataFrame([("三百二十一",), ("十二",), ("万",)], "s string").select(tx.zh_number("s")).collect() == [(321,), (12,), (None,)]


def test_versions_and_search(spark):
    old = chapters(spark, "A", "B").withColumn("content_hash", F.sha2("content", 256))
    new = chapters(spark, "A", "B2", "C").withColumn("content_hash", F.sha2("content", 256))
    assert {r.kind for r in versions.diff_chunks(old, new).collect()} == {"added", "modified"}
    q = spark.createDataFrame([(1, "钟声"), (2, "  "), (3, "%")], "query_id long, query string")
    hits = search.search_substring(chapters(spark, "雨夜", "第二天钟声响起"), q, 5)
    assert [(r.query_id, r.snippet) for r in hits.collect()] == [(1, "第二天[钟声]响起")]
    assert "来源文件" in search.context_pack(hits, q).where("query_id = 1").first().markdown


def test_top_phrases_by_hand(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcd. \n") for _ in range(rnd.randint(0, 90))) for _ in range(40)] + ["", "abcd", "\U00020000bc\U00020001 d" * 3]
    counts = Counter()
    for t in texts:
        clean = [re.sub(r"[\W_]+", "", x) for x in re.split(r"[.\n]", t)]
        counts.update({x[i : i + n] for x in clean for n in range(4, 11) for i in range(len(x) - n + 1)})
    want = sorted(((-k, -len(p), p) for p, k in counts.items() if k >= 2))[:15]
    got = detectors.top_phrases(chapters(spark, *texts), least=2, delimiters="[.\n]").orderBy("rank").collect()
    assert [(r.phrase, r.n_chunks) for r in got] == [(p, -k) for k, _, p in want]


def test_search_many_queries(spark):
    rnd = random.Random(3)
    fold = lambda x: x.translate(search.FOLD)
    texts = [" ".join(rnd.choice(["Rain", "été", "ÉTÉ", "bell", "night", "A-B"]) for _ in range(rnd.randint(0, 12))) for _ in range(30)]
    asked = ["rain bell", "", "ÉTÉ NIGHT", "b", "nothing here", "rain bell", "a b night", "a-b"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {(r.query_id, r.chunk_index) for r in search.search_substring(chapters(spark, *texts), q, 99).collect()}
    assert got == {(i, j) for i, a in enumerate(asked) for j, t in enumerate(texts) if a.strip() and fold(a) in fold(t)}
    norm = lambda x: " " + re.sub(r"[\W_]+", " ", x.lower()).strip() + " "
    found = {(i, j) for i, a in enumerate(asked) for j, t in enumerate(texts) if norm(a).strip() and norm(a) in norm(t)}
    found |= {(i, j) for i, a in enumerate(asked) for j, t in enumerate(texts) if a.strip() and i not in {x for x, _ in found} and fold(a) in fold(t)}
    assert {(r.query_id, r.chunk_index) for r in search.search_phrase(chapters(spark, *texts), q, 99).collect()} == found
    assert search.search_substring(chapters(spark, *texts), q.limit(0), 5).count() == 0
    pack = {r.query_id: r for r in search.context_pack(search.search_substring(chapters(spark, *texts), q, 2), q).collect()}
    assert pack[4].n_hits == 0 and len(pack[0].source_refs) == pack[0].n_hits <= 2 and pack[0].source_refs[0].path == "a.txt"


def test_similar_groups_by_hand(spark):
    rnd = random.Random(5)
    said = [" ".join(rnd.choice(["river", "stone", "window", "mountain", "silver", "garden"]) for _ in range(rnd.randint(4, 7))) for _ in range(40)]
    texts = [".".join(said[i : i + 4]) for i in range(0, 40, 4)]
    sets = [frozenset(x.split()) for x in said]
    alike = lambda a, b: len(a & b) >= 0.6 * len(a | b) - 1e-9
    group, n = {}, 0
    for i in range(40):
        friends = [j for j in range(i + 1, 40) if i not in group and j not in group and alike(sets[i], sets[j])][:4]
        if friends:
            group |= dict.fromkeys([i, *friends], n)
            n += 1
    want = {frozenset(j for j, k in group.items() if k == g) for g in group.values()}
    rows = detectors.similar_groups(chapters(spark, *texts), LATIN).collect()
    made: dict = {}
    for r in rows:
        made.setdefault((r.component, r.group_no), set()).add(4 * r.chunk_index + r.sentence_no)
    assert {frozenset(x) for x in made.values()} == want and want


def test_rules_meet_by_letters(spark):
    rows = [("p", "r1", ["魔法", "生命"], "active"), ("p", "r2", ["a"], "active"), ("p", "r3", [""], "active"), ("q", "r4", ["魔法"], "active"), ("p", "r5", ["魔法"], "rejected")]
    rules = spark.createDataFrame(rows, "project_id string, name string, keywords array<string>, status string")
    got = story.rule_conflicts(chapters(spark, "魔法却造生命 a", "生命却魔法", "却 a", "魔法生命"), rules, ZH)
    assert {(r.rule, r.chunk_index) for r in got.collect()} == {("r1", 0), ("r1", 1), ("r2", 0), ("r2", 2)}


def test_evidence_of_live_documents(spark):
    c = chapters(spark, "林澈醒来", "x" * 100)
    docs = spark.createDataFrame([("p", "a.txt", "Book", False)], "project_id string, path string, title string, deleted boolean")
    rows = spark.createDataFrame([("n", "c1"), ("m", "zz")], "name string, first_chunk_id string")
    one = versions.with_evidence(rows, c, docs).collect()
    assert [(r.name, r.document_title, r.chapter_title, r.snippet) for r in one] == [("n", "Book", "第2章", "x" * 80)]
    assert versions.with_evidence(rows, c, docs.withColumn("deleted", F.lit(True))).count() == 0 and versions.live_chunks(c, docs).count() == 2


def test_profiles_and_prior_scan(spark):
    assert merged((Profile("a", people=False, checks=("x",)), Profile("b", places=False, items=False, checks=("y", "x")))) == Profile("a+b", items=True, checks=("x", "y"))
    quiet = Profile("q", people=False, places=False, items=False, foreshadows=False, eye_colours=False, repeat_terms=False)
    c = chapters(spark, *["打脸 震惊 林澈说他在雨夜醒来。似乎藏着秘密的铜钥匙啊"] * 4, "林澈的黑色眼睛。", "林澈的蓝色眼睛。")
    none = analysis.analyze(c, ZH, (quiet,), detector_list={"p": detectors.psych_density})
    assert none["candidates"].count() == none["foreshadows"].count() == none["issues"].count() == 0
    loud = Profile("l", checks=("diminishing_runs", "anachronisms"))
    first = analysis.analyze(c, ZH, (loud, quiet), detector_list={"p": detectors.psych_density}, terms=("雨夜",))
    kinds = {r.issue_type for r in first["issues"].collect()}
    assert {"character_attribute_conflict", "diminishing_runs"} <= kinds and first["tasks"].where("task_type = 'conflict'").count() == first["issues"].where("severity = 'high'").count() > 0
    prior = {"issues": first["issues"].withColumn("status", F.lit("resolved")), "candidates": first["candidates"].withColumn("status", F.lit("confirmed")), "foreshadows": first["foreshadows"].withColumn("status", F.lit("discarded")), "tasks": first["tasks"].limit(1)}
    again = analysis.analyze(c, ZH, (loud,), prior, {"p": detectors.psych_density}, ("雨夜",))
    assert {r.status for r in again["issues"].collect()} == {"resolved"} and {r.status for r in again["candidates"].collect()} == {"confirmed"}
    assert again["tasks"].count() == 0 and {r.status for r in again["rules"].union(again["rules"].limit(0)).collect()} <= {"candidate"}


def test_knowledge_packs(spark, tmp_path):
    (tmp_path / "a.toml").write_text('[[entry]]\nterm = "长安"\ndynasty = "唐"\ncategory = "x"\n[[entry]]\nterm = "长安"\ndynasty = "唐"\ncategory = "y"\n[[entry]]\nterm = "z"\ndynasty = " "\n', encoding="utf-8")
    k = ms.load_knowledge(spark, [str(tmp_path / "a.toml")])
    assert [(r.term, r.category) for r in k.collect()] == [("长安", "x")] and checks.period_terms(k, "唐") == ("长安",)
    assert checks.run_check("anachronisms", chapters(spark, "长安城里有手机"), ZH, terms=checks.period_terms(k, "唐")).first().severity == "medium"


def test_scan_stream(spark, tmp_path):
    events, folder = tmp_path / "events", f"file://{tmp_path}/scan"
    schema = "project_id string, path string, ts timestamp"
    texts = {"a.txt": "one", "b.txt": "two"}

    def read(paths):
        rows = spark.createDataFrame([("p", k, v) for k, v in texts.items()], "project_id string, path string, text string")
        return ms.text_columns(rows).withColumn("last_modified_at", F.lit(None).cast("timestamp")).join(paths, ["project_id", "path"], "left_semi")

    def burst(minute, *paths):
        rows = [("p", p) for p in paths]
        at = F.lit(f"2024-01-01 00:{minute:02d}:00").cast("timestamp")
        spark.createDataFrame(rows, "project_id string, path string").withColumn("ts", at).coalesce(1).write.mode("append").parquet(str(events))
        stream = spark.readStream.schema(schema).parquet(str(events))
        changes.scan_stream(changes.debounced(changes.watched(stream), late="1 second"), read, folder, f"{tmp_path}/checkpoint", lambda states, docs, batch: seen.append(batch)).awaitTermination()

    seen: list = []
    burst(1, "a.txt", "b.txt", ".c.txt.swp")
    burst(3, "z.txt")  # time goes on, so the first burst is released
    texts["a.txt"] = "changed"
    del texts["b.txt"]
    burst(5, "a.txt", "b.txt")
    burst(9, "z.txt")
    states = spark.read.parquet(f"{folder}/states").orderBy("batch", "path").collect()
    assert {(r.path, r.state) for r in states} == {("a.txt", "created"), ("b.txt", "created"), ("a.txt", "modified"), ("b.txt", "deleted")}
    now = changes.file_state(spark, folder).read("files")
    assert now.where("deleted AND path = 'b.txt'").count() == 1 and seen
