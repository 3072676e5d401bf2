"""Fill-in-middle, spelling variants and line dedup against brute force, with the odd rows that tables hold."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import lines, middle, queries, spelling

from .test_operators import LONG, ODD, docs_of, empty

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ---- fill in middle ----


def middle_by_hand(key, text, rate=100, spm=50, seed=7, marks=("<P>", "<S>", "<M>")):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = [int(sha(f"{seed}:{'' if key is None else key}")[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not t or any(m in t for m in marks) or h[2] % 100 >= rate:
        return (n, "plain", None, None, t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, q, r = marks
    if h[3] % 100 < spm:
        return (n, "spm", len(x), len(m), q + s + p + x + r + m)
    return (n, "psm", len(x), len(m), p + x + q + s + r + m)


LINES = [(100 + i, "".join(random.Random(i).choice(["a é漢\n", "\n", "\U0001f600b", "<", "P>", "<S", "\r\n", "word "]) for _ in range(i % 23))) for i in range(120)]
MARKED = [(300, "has <P> in it\nx"), (301, "<M>"), (302, "a<S>"), (303, "<p>\n<s>\n"), (304, "<<P\n>S>")]


@pytest.mark.parametrize("plan", [middle.Plan(), middle.Plan(seed=3, rate=40, spm=0), middle.Plan(spm=100, prefix="⟦前⟧", suffix="⟦後⟧", middle="⟦中⟧")])
def test_middle(spark, plan):
    rows = ODD + LINES + MARKED + [(400, LONG * 20 + "\nend")]
    made = middle.restored(middle.transformed(docs_of(spark, rows), plan), plan).collect()
    want = Counter((k, *middle_by_hand(k, t, plan.rate, plan.spm, plan.seed, (plan.prefix, plan.suffix, plan.middle)), t or "") for k, t in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in made) == want
    assert {r.form for r in made} >= ({"psm", "spm", "plain"} if plan.seed == 7 and plan.spm == 50 else {"plain"})
    assert middle.restored(middle.transformed(empty(spark), plan), plan).count() == 0


def test_middle_rotations():
    rnd = random.Random(5)
    for _ in range(300):
        x = bytes(rnd.randrange(256) for _ in range(rnd.randint(0, 40)))
        a, b, c = sorted(rnd.randint(0, len(x)) for _ in range(3))
        buffer = bytearray(x)
        middle.exchanged(buffer, a, b, c)
        assert buffer == x[:a] + x[b:c] + x[a:b] + x[c:]
        middle.exchanged(buffer, a, a + c - b, c)
        assert buffer == x


@pytest.mark.parametrize("marks", [("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "><", "<M>"), ("<P>", "<S>", "x<P>x")])
def test_middle_refuses_sentinels_that_overlap(spark, marks):
    with pytest.raises(ValueError):
        middle.transformed(empty(spark), middle.Plan(prefix=marks[0], suffix=marks[1], middle=marks[2]))


def test_middle_of_null_outputs(spark):
    rows = spark.createDataFrame([(1, None, "psm"), (2, "x", None), (3, "x", "plain")], "doc_id long, output string, form string")
    assert [r.restored for r in middle.restored(rows).orderBy("doc_id").collect()] == [None, None, "x"]


# ---- spelling variants ----


def words_by_hand(rows, every, length, least):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= length:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[i:] == b[i + 1 :])


def variants_by_hand(words, times=2):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def misspelt(rnd, alphabet):
    """Texts of words that are one or a few edits from each other, with frequencies of all sizes."""
    stems = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(4, 9))) for _ in range(12)]
    words = []
    for s in stems:
        w = s
        for k in (60, 25, 9, 4, 3):
            words += [w] * rnd.randint(1, k)
            i = rnd.randrange(len(w))
            w = rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice(alphabet) + w[i:], w[:i] + rnd.choice(alphabet) + w[i + 1 :]]) or w
    rnd.shuffle(words)
    return [(i, rnd.choice([" ", "-", "\n9"]).join(w.upper() if rnd.random() < 0.2 else w for w in words[i::40])) for i in range(40)]


@pytest.mark.parametrize("every, length, least", [(97, 5, 3), (3, 5, 2), (5, 1, 1), (97, 3, 1)])
def test_variants(spark, every, length, least):
    rnd = random.Random(length * 10 + every)
    rows = ODD + misspelt(rnd, "abéÀ÷") + misspelt(rnd, "abcdefgh")
    words = words_by_hand(rows, every, length, least)
    want = variants_by_hand(words)
    got = spelling.variants(docs_of(spark, rows), every=every, length=length, least=least).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(root != form for _, form, root, *_ in want if form) and sum(n for *_, n, _ in want) > 40


def test_variants_chain_and_ties(spark):
    said = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "bbbbc": 96, "zzzzz": 4, "zzzz": 40, "zzzzy": 8, "zzzzx": 8}
    text = " ".join(w for w, n in said.items() for _ in range(n))
    got = {r.word: r for r in spelling.variants(docs_of(spark, [(1, text)]), every=1 << 40, length=4).collect()}
    assert got["aaaaa"].root in ("bbbbb", "bbbbc") and got["aaaaa"].form == "aaaab" and got["abbbb"].form == "bbbbb"
    assert got["zzzzz"].form == "zzzz" and got["zzzzz"].n_near == 3 and got["zzzz"].form is None and got["zzzz"].root == "zzzz"
    assert spelling.variants(empty(spark)).count() == 0
    assert spelling.variants(docs_of(spark, [(1, None), (2, ""), (3, "one two")])).count() == 0


def test_every_pair_shares_a_chunk(spark):
    """Every single edit of some words is a candidate, whichever half it hits."""
    rnd = random.Random(8)
    words = set()
    for n in range(1, 12):
        w = "".join(rnd.choice("abc") for _ in range(n))
        words |= {w} | {w[:i] + w[i + 1 :] for i in range(n)} | {w[:i] + c + w[i:] for i in range(n + 1) for c in "ax"} | {w[:i] + c + w[i + 1 :] for i in range(n) for c in "ax"}
    words -= {""}
    got = {frozenset((r.a, r.b)) for r in spelling.near_pairs(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()}
    assert got == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


# ---- line dedup ----


def dedup_by_hand(rows, length=20, least=3):
    key = lambda line: line.strip(SPACES).translate(UPPER)
    held = defaultdict(set)
    for k, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= length:
                held[key(line)].add(k)
    rank = lambda k: (k is not None, k or 0)
    out = Counter()
    for k, t in rows:
        own = (t or "").split("\n")
        keep = [x for x in own if len(held[key(x)]) < least or rank(k) == max(map(rank, held[key(x)]))]
        out[k, len(own), len(own) - len(keep), "\n".join(keep)] += 1
    return out


def repeated_lines(seed):
    rnd = random.Random(seed)
    pool = [f"{'Common ' * rnd.randint(1, 4)}line number {i} with an é and 漢" for i in range(25)] + ["short", "  ", "x" * 19, "x" * 20, "é" * 19, "É" * 20, "é" * 20]
    dress = lambda s: rnd.choice(["", " ", "\t", "\r"]) + (s.upper() if s.isascii() and rnd.random() < 0.3 else s) + rnd.choice(["", "\r", " \x0b\x0c"])
    rows = [(rnd.randint(0, 60), "\n".join(dress(rnd.choice(pool)) if rnd.random() < 0.7 else f"a line of its own {rnd.random()}" for _ in range(rnd.randint(0, 9)))) for _ in range(90)]
    return rows + [(None, pool[0] + "\n" + pool[1]), (None, pool[0]), (7, pool[2] + "\n\n" + pool[2] + "\n")] + [(1000, "\n".join(f"unique line number {i} of a long text" for i in range(3000)) + "\n" + pool[3])]


@pytest.mark.parametrize("least, bits", [(3, lines.MOST_BITS), (2, 1 << 14), (3, 1)])
def test_line_dedup(spark, least, bits):
    rows = ODD + repeated_lines(least)
    want = dedup_by_hand(rows, least=least)
    got = lines.without_repeats(docs_of(spark, rows), least=least, most_bits=max(bits, 1 << 14)).collect()
    assert Counter(tuple(r) for r in got) == want
    assert sum(n for _, _, n, _ in want) > 50


def test_line_dedup_of_nothing(spark):
    assert lines.without_repeats(empty(spark)).count() == 0
    assert [tuple(r) for r in lines.without_repeats(docs_of(spark, [(1, None)])).collect()] == [(1, 1, 0, "")]


def test_second_filter_holds_all_repeats_and_little_else(spark):
    rnd = np.random.default_rng(2)
    once, twice = rnd.integers(1, 1 << 63, 40_000, dtype=np.uint64), rnd.integers(1, 1 << 63, 500, dtype=np.uint64)
    every = np.concatenate([once, twice, twice])
    parts = [bytearray(x.tobytes()) for x in np.array_split(rnd.permutation(every), 7)]
    table = spark.createDataFrame([(len(p) // 8, p) for p in parts], "n long, h binary").repartition(5)
    bits = lines.twice_filter(table, -(-len(every) * lines.BITS // lines.PIECE))
    assert lines.may_hold(bits, twice).all()
    assert lines.may_hold(bits, once).mean() < 0.03
    for share in range(3):
        mine = lines.twice_filter(table, 4, share, 3)
        assert lines.may_hold(mine, twice[twice % np.uint64(3) == np.uint64(share)]).all()


def test_only_suspected_lines_are_shuffled(spark):
    """Texts whose lines are their own send few rows, whatever their number."""
    docs = docs_of(spark, [(i, "\n".join(f"document {i} says line {j} alone" for j in range(40))) for i in range(100)] + [(1000 + i, "a line that many texts of this table hold") for i in range(30)])
    bits = spark.sparkContext.broadcast(lines.twice_filter(lines.hashes(docs), 1))
    found = lines.suspects(docs, bits)
    assert found.where("doc_id >= 1000").count() == 30 and found.where("doc_id < 1000").count() < 200


def test_queries_have_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    want = {
        "op11_fill_in_middle": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
        "op12_spelling_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
        "op13_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    }
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for name, columns in want.items():
        made = queries.QUERIES[name](spark, sf)
        assert ", ".join(f"{c} {t}" for c, t in made.dtypes) == columns
        if "doc_id" in made.columns:
            assert made.count() == len(texts)
    assert queries.op11_fill_in_middle(spark, sf).where(~F.col("restored_sha256").isin([sha(t) for t in texts.values()])).count() == 0
