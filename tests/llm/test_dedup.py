"""Near-duplicate documents and lines against brute force over all pairs that share a shingle."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feloom.llm import common, graph, line_dedup, near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size=5):
    words = WORD.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def components(sets, percent):
    """Smallest member of each set's component of links."""
    inverted = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            inverted[x].append(k)
    common = Counter()
    for members in inverted.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                common[a, b] += 1
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in sets}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies(spark):
    """Groups of exact and of near copies at all distances, and texts that share a passage."""
    rng, texts = random.Random(3), []
    passage = " ".join(f"p{i}" for i in range(60))
    for g in range(12):
        base = [f"g{g}v{rng.randrange(400)}" for _ in range(rng.choice([4, 9, 40, 150, 400]))]
        texts += [" ".join(base)] * rng.choice([1, 2, 6])
        texts += [edited(rng, base, rng.choice([1, 1, 2, 3, 5, 8])) for _ in range(rng.choice([2, 8, 25]))]
    texts += [passage + " " + " ".join(f"q{i}w{rng.randrange(10**6)}" for _ in range(rng.choice([5, 20, 60]))) for i in range(30)]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_near_duplicates(spark, copies):
    df = spark.createDataFrame(list(copies.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df).collect()}
    sets = {k: shingles(t) for k, t in copies.items()}
    expected = components(sets, 85)
    assert {k: r.component_id for k, r in got.items()} == expected
    assert all(r.n_shingles == len(sets[k]) and r.kept == (k == expected[k]) for k, r in got.items())


def test_forced_rounds(spark, copies, monkeypatch):
    """The passes with new partners change nothing."""
    monkeypatch.setattr(near_dedup, "CROSSING_WORK", 0)
    df = spark.createDataFrame(list(copies.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == components({k: shingles(t) for k, t in copies.items()}, 85)


def test_a_common_passage_brings_no_pairs(spark, monkeypatch):
    """Texts that share a frequent passage, but are not alike, are neither drawn again nor paired by it; links are all found."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {i: passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.choice([14, 15, 16]))) for i in range(120)}
    for g in range(5):
        base = [f"g{g}v{i}" for i in range(100)]
        texts |= {1000 + 10 * g + k: edited(rng, base, 1) for k in range(4)}
    redrawn, pairs = [], []
    reseeded, last = graph.reseeded_pairs, near_dedup.prefix_pairs
    monkeypatch.setattr(near_dedup, "CROSSING_WORK", 0)
    monkeypatch.setattr(graph, "reseeded_pairs", lambda *a: redrawn.append(a) or reseeded(*a))
    monkeypatch.setattr(near_dedup, "prefix_pairs", lambda *a: pairs.append(common.cut(last(*a), "test")) or pairs[-1])
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == components({k: shingles(t) for k, t in texts.items()}, 85)
    assert not redrawn and pairs and sum(p.count() for p in pairs) < 50  # of 7140 pairs that share the passage


def test_first_shingles_find_every_link(spark, copies, monkeypatch):
    """The complete search alone, without any pair before it, in blocks of three."""
    monkeypatch.setattr(graph, "BLOCK", 3)
    found = []
    last = near_dedup.prefix_pairs

    def alone(docs, classes, members, percent):
        every = classes.select("id", F.col("id").alias("component"))
        found.append((classes.select("id", "owner").collect(), last(docs, classes, every, percent).collect()))
        return last(docs, classes, members, percent)

    monkeypatch.setattr(near_dedup, "prefix_pairs", alone)
    near_dedup.near_duplicates(spark.createDataFrame(list(copies.items()), "doc_id long, text string")).collect()
    classes, pairs = found[0]
    of, sets = {r.id: r.owner for r in classes}, {r.id: shingles(copies[r.owner]) for r in classes}
    met = {(r.a, r.b) for r in pairs}
    assert len(met) == len(pairs) and all(a < b for a, b in met)
    linked = {(min(a, b), max(a, b)) for a in of for b in of if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert len(linked) > 50 and linked <= met


def test_near_copies_below_the_threshold_bring_no_pairs(spark, monkeypatch):
    """Copies of one text with two edits each are at 0.81: only pairs that may be linked become rows, each once."""
    rng = random.Random(9)
    base = [f"v{i}" for i in range(200)]
    texts = {i: edited(rng, base, 2) for i in range(80)}
    texts |= {100 + i: edited(rng, base[:100], 1) for i in range(6)}
    every, pairs, last = [], [], near_dedup.prefix_pairs
    cells = near_dedup.met_in_cells
    monkeypatch.setattr(near_dedup, "met_in_cells", lambda *a: every.append(common.cut(cells(*a), "test")) or every[-1])
    monkeypatch.setattr(near_dedup, "prefix_pairs", lambda *a: pairs.append(common.cut(last(*a), "test")) or pairs[-1])
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == components({k: shingles(t) for k, t in texts.items()}, 85)
    assert pairs and sum(p.count() for p in pairs) == sum(p.count() for p in every) < 300  # of 3160


def test_cells_hold_each_crossing_pair_once(spark, monkeypatch):
    """Members outside a key's largest component meet all others, whatever the blocks."""
    rng = random.Random(10)
    of = {i: rng.choice([1, 1, 1, 2, 3, 100 + i]) for i in range(60)}
    rows = [(key, i, of[i]) for key in range(9) for i in rng.sample(range(60), rng.choice([1, 2, 12, 40]))]
    groups = spark.createDataFrame([(i, c) for i, c in of.items()], "node long, component long")
    members = graph.open_buckets(spark.createDataFrame([r[:2] for r in rows], "key long, id long"), groups)
    at = defaultdict(set)
    for key, i, _ in rows:
        at[key].add(i)
    crossing = {(a, b) for x in at.values() for a in x for b in x if a < b and of[a] != of[b]}
    assert graph.crossing_work(members) == (sum(of[a] != of[b] for x in at.values() for a in x for b in x if a < b), members.count())
    for block in (3, 2000):
        monkeypatch.setattr(graph, "BLOCK", block)
        met = [tuple(r) for r in graph.crossing_pairs(members, groups.select(F.col("node").alias("id")), lambda l, r: F.lit(True)).collect()]
        assert len(met) == len(set(met)) and set(met) == crossing


def test_near_duplicates_odd(spark, odd, nothing):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()]
    assert len(got) == odd.count()
    assert got.count((1, 15, 1, True)) == 2 and (2, 0, 2, True) in got and (3, 0, 3, True) in got and (4, 0, 4, True) in got
    assert (5, 1, 5, True) in got and [g for g in got if g[0] is None] == [(None, 2, None, True)]
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_registers_and_estimate():
    rng = np.random.default_rng(5)
    for n, j in ((2000, 0.9), (400, 0.85), (60, 0.7)):
        guesses = []
        for _ in range(20):
            union = rng.integers(0, 2**64, n, dtype=np.uint64)
            common, half = int(n * j), (n - int(n * j)) // 2
            a, b = np.sort(union[: common + half]), np.sort(np.concatenate([union[:common], union[common + half :]]))
            regs = [near_dedup.registers(x, np.zeros(len(x), np.int64), 1) for x in (a, b)]
            guesses.append(near_dedup.estimate(*regs, np.array([len(a)]), np.array([len(b)]))[0][0])
        assert abs(np.mean(guesses) - j) < 0.03


def test_collisions_are_rare():
    table = near_dedup._collision_table()
    assert table.shape == (41, 41) and (table <= 1).all() and table[20, 20] < 0.01


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 1), (2, 900), (2, 900)] + [(300, 300 + rng.randrange(40)) for _ in range(60)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and got[900] == got[2] == 2
    assert all(v == 300 for k, v in got.items() if 300 <= k < 400) and 1 not in got


def normal(line):
    return line.lower().strip(" \t\x0b\x0c\r")


def line_shingles(line):
    """Every run of five characters; a shorter line is one."""
    return frozenset(zip(*(line[i:] for i in range(5)))) if len(line) > 5 else frozenset([line])


def expected_lines(texts):
    lines = sorted((k, p, normal(x)) for k, t in texts.items() for p, x in enumerate((t or "").split("\n")))
    group = components({n: line_shingles(n) for _, _, n in lines if n}, 80)
    seen, gone = set(), defaultdict(set)
    for k, p, n in lines:
        if n:
            if group[n] in seen:
                gone[k].add(p)
            seen.add(group[n])
    out = {}
    for k, t in texts.items():
        left = [x for p, x in enumerate((t or "").split("\n")) if p not in gone[k]]
        out[k] = t if not gone[k] else ("\n".join(left) if any(normal(x) for x in left) else "")
    return out


@pytest.fixture(scope="module")
def line_texts(docs):
    """Documents, families of similar lines, addresses and lines without blanks."""
    rng = random.Random(2)
    texts = {r.doc_id: r.text for r in docs.limit(60).collect()}
    base = "the quick brown fox jumps over the lazy dog near the old river bank in spring".split()
    for i in range(40):
        texts[10_000 + i] = "\n".join([edited(rng, base, rng.choice([0, 1, 1, 2, 4])), f"own line number {i} {i * 7919}", "", "Copyright  2020 "])
    url = "https://www.alpha.example/news/2020/the-long-title-of-an-article?page="
    texts[20_000] = "\n".join([url + "1", "https://www.beta.example/shop/77?id=5", "https://www.alpha.example/other", "今天天气很好我们一起去公园散步吧然后回家吃晚饭"])
    texts[20_001] = "\n".join([url + "2", "https://www.beta.example/", "今天天气很好我们一起去公园但是突然下起了大雨所以只好取消", "今天天气很好我们一起去公园散步吧然后回家吃晚飯"])
    for i in range(30):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(1000)}" for _ in range(rng.choice([5, 20, 22, 60, 300]))]
        texts[30_000 + 2 * i], texts[30_001 + 2 * i] = " ".join(words), edited(rng, words, rng.choice([1, 1, 2, 6]))
    return texts


def deduped(spark, texts):
    return {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}


def test_lines(spark, line_texts):
    assert deduped(spark, line_texts) == expected_lines(line_texts)


def test_lines_by_another_course(spark, line_texts, monkeypatch):
    """Passes with new partners, bucket blocks and lines whose names collide change nothing."""
    monkeypatch.setattr(line_dedup, "CROSSING_WORK", 0)
    monkeypatch.setattr(line_dedup, "NAME_BITS", 63)
    monkeypatch.setattr(graph, "BLOCK", 3)
    assert deduped(spark, line_texts) == expected_lines(line_texts)


def test_line_links_recalled():
    """Of pairs at 0.8 to 0.83, in sets of all sizes, at least 0.95 share a band."""
    rng = np.random.default_rng(7)
    for n in (12, 40, 70, 78, 90, 100, 500):
        apart, met = int(n * 0.19), 0
        for _ in range(400):
            union = rng.integers(0, 2**64, n, dtype=np.uint64)
            sets = union[: n - apart // 2], union[apart - apart // 2 :]
            keys = [set(line_dedup.band_keys(*line_dedup.sorted_sets(x, np.zeros(len(x), np.int64), 1))[0].tolist()) for x in sets]
            met += bool(keys[0] & keys[1])
        assert met >= 0.95 * 400, (n, met)


def test_similar_lines_are_not_drawn_again(spark, monkeypatch):
    """Lines that share bands but are not alike go to the complete search at once, and only what may be linked is verified."""
    rng = random.Random(11)
    base = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(80)]
    texts = {i: edited(rng, base, rng.choice([4, 5, 6])) for i in range(70)}
    redrawn, verified, check = [], [], line_dedup.verified_links
    monkeypatch.setattr(graph, "reseeded_pairs", lambda *a, f=graph.reseeded_pairs: redrawn.append(a) or f(*a))
    monkeypatch.setattr(line_dedup, "verified_links", lambda t, p, n: verified.append(p.count()) or check(t, p, n))
    assert deduped(spark, texts) == expected_lines(texts)
    assert not redrawn and len(verified) == 2 and verified[1] < 400, verified  # of 2415 pairs


def test_long_lines_rarely_share_a_band_by_chance():
    """Sets of 400 hashes out of 2000 (similarity 0.11) must not meet, or such pairs grow with the square of the table."""
    rng = np.random.default_rng(8)
    hashes = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    sets = [rng.choice(hashes, 400, replace=False) for _ in range(1500)]
    owner = np.repeat(np.arange(len(sets)), 400)
    keys, of = line_dedup.band_keys(*line_dedup.sorted_sets(np.concatenate(sets), owner, len(sets)))
    members = np.unique(keys, return_counts=True)[1]
    assert (members * (members - 1) // 2).sum() < 100  # of 1 124 250 pairs


def test_shuffle_files_go_with_each_table(spark):
    """What a table shuffled on its way is deleted with the write, so scratch does not pile up over a run."""
    disk = spark._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        blocks = disk.getAllBlocks()
        return {str(blocks.apply(i)) for i in range(blocks.size()) if str(blocks.apply(i)).startswith("shuffle_")}

    before = files()
    made = common.cut(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "test")
    assert not files() - before and made.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    common.drop(made)


def test_lines_odd(spark, odd, nothing):
    got = line_dedup.dedup_lines(odd)
    assert set(odd.columns) <= set(got.columns) and got.count() == odd.count()
    rows = [(r.doc_id, r.text, r.n_removed) for r in got.collect()]
    assert (2, None, 0) in rows and (3, "", 0) in rows and (4, "  \n\t ", 0) in rows
    assert (7, "\nother words here", 2) in rows and (7, "another text with the same id but different words in it", 0) in rows
    assert len([r for r in rows if r[0] == 1 and r[2] == 0]) == 2
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_lines_that_differ_after_the_start_of_words(spark):
    """Every character counts: in lines without blanks, in long words, beside surrogate pairs."""
    pairs = [
        ("https://www.alpha.com/news/1", "https://www.beta.org/shop/77?id=5"),
        ("see https://www.xylophones.example/a", "see https://www.yesterdays.example/b"),
        ("今天天气很好我们一起去公园散步吧然后回家吃晚饭", "今天天气很好我们一起去公园但是突然下起了大雨所以只好取消"),
        ("\U0001f600\U0001f601 abcdefghijklmnop", "\U0001f600\U0001f601 abcdefghijzzzzzz"),
    ]
    rows = [(2 * i + k, x) for i, pair in enumerate(pairs) for k, x in enumerate(pair)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == dict(rows) and not any(r.n_removed for r in got)


def test_shingles_of_lines():
    size = line_dedup.SHINGLE_CHARS
    for line in ("x", "\U0001f600", "y" * size, "two words and \U0001f600 more of them", "没有空格的一行文字也要全部比较"):
        hashes, owner = line_dedup.shingles(next(iter(line_dedup.line_pieces(pa.array([line, "z", line]))))[2])
        n, last = set(hashes[owner == 0].tolist()), set(hashes[owner == 2].tolist())
        assert n == last and (owner == 1).sum() == 1 and len(n) == len({line[i : i + size] for i in range(max(1, len(line) - size + 1))})


def test_lines_with_one_changed_letter(spark):
    """Lines of 12 words that differ in one character in the middle of a word are one."""
    rng, texts = random.Random(4), {}
    for i in range(25):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(12)]
        line = " ".join(words)
        at = len(line) // 2
        texts[2 * i], texts[2 * i + 1] = line, line[:at] + "#" + line[at + 1 :]
    got = line_dedup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    every = {k: frozenset(x[i : i + 5] for i in range(len(x) - 4)) for k, x in texts.items()}
    expected = components(every, 80)
    assert {r.doc_id: r.text for r in got} == {k: x if expected[k] == k else "" for k, x in texts.items()}
    assert sum(expected[k] != k for k in texts) == 25
