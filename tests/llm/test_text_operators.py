import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feloom.llm import language_id, mixing, packing, quality, token_counts
from feloom.llm.textarrays import pieces

from .conftest import LONG, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Packing


def unpacked(rows):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    return by_doc, by_sequence


def check_sequences(by_sequence):
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = unpacked(packing.pack(docs).collect())
    check_sequences(by_sequence)
    for d in docs.collect():
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by_doc[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_odd(odd, nothing):
    rows = packing.pack(odd.repartition(1)).collect()
    by_doc, by_sequence = unpacked(rows)
    check_sequences(by_sequence)
    assert sum(r.length for r in by_doc[2]) == 1 and sum(r.length for r in by_doc[None]) == by_doc[None][0].doc_tokens
    assert sum(r.length for r in by_doc[5]) == by_doc[5][0].doc_tokens > 60_000
    assert packing.pack(nothing).count() == 0


def test_steps_are_balanced(docs):
    rows = packing.pack(docs.repartition(1), step_tokens=8192).collect()
    sizes = Counter()
    for r in rows:
        if r.tier in packing.TIERS:
            sizes[r.step_id, r.tier] += r.length
    full = [v for v in sizes.values() if v == 8192]
    assert len(full) >= len(sizes) - 2 * len(packing.TIERS) and max(sizes.values()) == 8192


def test_encoder_equals_tokenizer():
    import public_tokenizers

    e = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in ["it's We'LL 12 a1b2 don't!!'s ''s", "Grüße café µªº ×", "á İ ΣΣ", "<|endoftext|> x", "\x1c a\x0bb \x85 c\xa0d", "", "\U0001f600 中文 ก"]:
        assert e.encode(text).tolist() == [*e.whole.encode(text, add_special_tokens=False).ids, 2], text


# Mixing


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    taken = Counter()
    for r in rows:
        assert r.size == len(WORD.findall(r.text)) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    targets = {r.source: (r.target, r.source_size) for r in rows}
    assert abs(sum(t for t, _ in targets.values()) - sum(s for _, s in targets.values())) < 1e-3
    for source, (target, size) in targets.items():
        largest = max(r.size for r in rows if r.source == source)
        assert target <= 3 * size + 1e-6 and abs(taken[source] - target) <= 3 * largest
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.copies) for r in rows) == Counter((r.doc_id, r.copies) for r in again)
    assert mixing.emit(mixing.mix(docs)).count() == sum(r.copies for r in rows)


def naive_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: most * sizes[s] for s in over})


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 300}, {"a": 0, "b": 7}, {"x": 100, "y": 1, "z": 1, "zz": 50, "q": 2}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    expected = naive_targets(sizes)
    assert all(abs(got[s] - expected[s]) < 1e-6 * max(1, expected[s]) for s in sizes)


def test_mixing_odd(odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.copies is not None for r in rows)
    assert {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert mixing.mix(nothing).count() == 0


# Quality


def naive_statistics(text):
    words, seen, again = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    count = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if count[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": again, "n_repeat_words": len(covered)}


def test_statistics(docs):
    texts = [r.text for r in docs.collect()] + ["", " ", "a\n\na\na ", "x " * 30, "\n", "é# \né# ", LONG]
    got = defaultdict(list)
    for _, _, t in pieces(pa.array(texts), 5000):
        for k, v in quality.statistics(t).items():
            got[k] += v.tolist()
    for i, text in enumerate(texts):
        assert {k: got[k][i] for k in quality.BASE} == naive_statistics(text), text[:50]


def test_trees_learn_and_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = (rng.random(4000) < 1 / (1 + np.exp(6 * x[:, 0] - 3 - 2 * (x[:, 1] > 0.5)))).astype(float)
    trees = quality.fit(x[:2000], y[:2000], [-1, 0, 0])
    p = trees.score(x[2000:]) > 0
    assert (p == y[2000:]).mean() > 0.75
    low = x[:300].copy()
    high = low.copy()
    high[:, 0] += rng.random(300)
    assert (trees.score(high) <= trees.score(low) + 1e-12).all()
    assert quality.fit(np.zeros((0, 3)), np.zeros(0), [0, 0, 0]).score(x[:2]).shape == (2,)


def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality(docs, labels.where("doc_id % 2 = 0")).where("not base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in got) / len(got) > 0.95


def test_quality_odd(spark, odd, nothing):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = quality.quality(odd, none).collect()
    assert len(got) == odd.count() and all(r.base_failed for r in got if r.doc_id in (2, 3, 4)) and not any(r.kept for r in got if r.base_failed)
    assert quality.quality(nothing, none).count() == 0


# Language identification


def test_language(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = language_id.document_evidence(docs.withColumn("true", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))))
    got = [r for r in language_id.identify(rows, ["doc_id", "true"]).collect() if r.doc_id % 2]
    assert sum(r.language == r.true for r in got) / len(got) > 0.98 and sum(r.kept for r in got) / len(got) > 0.98


def test_language_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = language_id.identify(language_id.page_evidence(pages).withColumn("said", F.col("_fl_declared")), ["page_id", "said"]).collect()
    assert len(got) == pages.count() and sum(r.language == r.said for r in got) / len(got) > 0.95


def test_prior_decides_without_text(spark):
    """A text that says nothing follows its host, and a declaration if there is one."""
    docs = [(i, "the cat and the dog of the house with that " * 20, "en", "h1") for i in range(60)] + [(100 + i, "der hund und die katze in dem haus mit dem " * 20, "de", "h2") for i in range(60)]
    df = spark.createDataFrame([*docs, (500, "qqq", None, "h1"), (501, "qqq", None, "h2"), (502, "привет мир как дела сегодня", None, "h1")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language_id.identify(language_id.document_evidence(df), ["doc_id"]).collect()}
    assert (got[0].language, got[100].language) == ("en", "de") and got[502].language == "und" and not got[502].kept
    assert got[500].language == "en" and got[501].language == "de"
    assert sorted(r.doc_id for r in language_id.reject_unidentified(df).collect() if r.doc_id >= 500) == [500, 501]


def brute_posteriors(rows):
    """Posteriors by plain loops; every row that declares a language is in the sample."""
    names = sorted({d for _, d, _, _ in rows if d}) + ["und"]
    quiet = {b for b in range(128) if not chr(b).isalpha() and chr(b) not in " \n"}

    def codes(text):
        raw = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
        runs = [tuple(raw[i : i + 3]) for i in range(len(raw) - 2)]
        runs = [r for r in runs if not quiet & set(r) and any(b > 32 for b in r)]
        return [((a << 16 | b << 8 | c) * 0x9E3779B1 % 2**32) >> 16 for a, b, c in runs]

    found = [codes(t) for t, _, _, _ in rows]
    counts = {n: Counter(c for (_, d, _, _), cs in zip(rows, found) if d == n for c in cs) for n in names[:-1]}
    log = lambda n, c: -math.log(65536) if n == "und" else math.log((counts[n][c] + 0.5) / (counts[n].total() + 0.5 * 65536))
    logs = [[sum(log(n, c) for c in cs) / (1 + len(cs) / 64) for n in names] for cs in found]

    def soft(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    shares = [soft(x) if cs else [0] * len(names) for x, cs in zip(logs, found)]
    total = lambda some: [sum(x[i] for x in some) for i in range(len(names))]
    base = soft([math.log(x + 1) for x in total(shares)])
    table = [[5 / len(names) + t for t in total([s for s, (_, d, _, _) in zip(shares, rows) if d == n])] for n in names]
    said = {n: [math.log(table[k][i] / sum(r[i] for r in table)) for i in range(len(names))] for k, n in enumerate(names)}
    out = []
    for k, (_, declared, host, suffix) in enumerate(rows):
        others = [(s, r) for j, (s, r) in enumerate(zip(shares, rows)) if j != k and r[3] == suffix]
        by_suffix, by_host = total([s for s, _ in others]), total([s for s, r in others if r[2] == host])
        prior = [(x + 50 * p) / (sum(by_suffix) + 50) for x, p in zip(by_suffix, base)]
        prior = [(x + 20 * p) / (sum(by_host) + 20) for x, p in zip(by_host, prior)]
        extra = said.get(declared, [0] * len(names))
        out.append((names, soft([a + b + math.log(p) for a, b, p in zip(logs[k], extra, prior)])))
    return out


def test_posteriors_by_brute_force(spark):
    """Every posterior, and a suffix that decides for a host without other rows."""
    english, german = "the cat and the dog of the house with that ", "der hund und die katze in dem haus mit dem "
    rows = [(english * (i % 3 + 1), "en", f"h{i % 2}.com", "com") for i in range(30)] + [(german * (i % 3 + 1), "de", f"g{i % 4}.de", "de") for i in range(40)]
    rows += [("qqq", None, "new.de", "de"), ("qqq", None, "new.com", "com"), ("zzz", "de", "h1.com", "com"), ("the hund und dog", None, "h0.com", "com"), ("привет мир", None, "", ""), ("12 34", "en", "x", "")]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language_id.identify(language_id.document_evidence(df), ["doc_id"]).collect()}
    for i, (names, p) in enumerate(brute_posteriors(rows)):
        assert got[i].language == names[p.index(max(p))] and abs(got[i].posterior - max(p)) < 1e-4, rows[i]
    assert (got[70].language, got[71].language) == ("de", "en") and not got[75].kept


def test_language_odd(odd, nothing):
    left = language_id.reject_unidentified(odd)
    assert left.columns == odd.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(1) == 2 and not {2, 3, 4, 6} & set(ids)
    assert language_id.reject_unidentified(nothing).count() == 0


# Token counts


def test_token_counts(docs):
    import random

    import public_tokenizers as P

    encode = token_counts.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode_ordinary
    rng = random.Random(1)
    for text in [r.text for r in docs.limit(25).collect()] + ["", "a", "   ", "\n\n", " x", "a  b"]:
        counted, now = token_counts.CountedText(text, encode, 16, 64), text
        for _ in range(15):
            e = token_counts.Edit(rng.randrange(len(now) + 1), rng.choice([0, 0, 1, 3, 50, 300]), rng.choice(["", " ", "  ", "x", " the cat", "\n\n", "'s", " 12", "é " * 40]))
            counted.apply(e)
            now = now[: e.at] + e.inserted + now[e.at + e.removed :]
            assert counted.text() == now and counted.count == len(encode(now))


def test_token_count_rows(odd, nothing):
    import public_tokenizers as P

    encode = token_counts.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode_ordinary
    texts = Counter((r.doc_id, len(encode(r.text or ""))) for r in odd.collect())
    got = token_counts.count_edited(odd).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == texts
    long = next(r for r in got if r.doc_id == 5)
    assert long.chars_encoded_again < 0.05 * long.n_chars_after
    assert token_counts.count_edited(nothing).count() == 0


def test_rare_language_is_known(spark):
    """A declared language has a model however small its share of the table."""
    english = "the house is on the hill and the river runs by it every day of the year number"
    georgian = "სახლი გორაზე დგას და მდინარე ყოველდღე მის გვერდით მიედინება მთელი წლის განმავლობაში"
    rows = [(i, f"{english} {i}", "en", "a", 1) for i in range(600)] + [(1000 + i, f"{georgian} {i}", "ka", "a", 1) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = language_id.identify(language_id.document_evidence(df), ["doc_id"], sample_rows=10).collect()
    assert Counter((r.language, r.kept) for r in got) == {("en", True): 600, ("ka", True): 2}


def test_rows_of_each():
    assert language_id.rows_of_each([5], 3000) == 5 and language_id.rows_of_each([10**9, 2], 10) == 8
    for counts, most in (([1, 7, 7, 900], 40), ([3] * 50, 20), ([10, 20, 30], 60)):
        k = language_id.rows_of_each(counts, most)
        assert k == 1 or sum(min(n, k) for n in counts) <= most
