"""The ten operators against plain computations, with nulls, empty and very long texts, ties, repeated rows, empty tables and odd columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from latticework.llm import exact_dedup, katz, mixing, near_dedup, packing, quality, token_count, toxicity, training_order, url_filter
from latticework.llm.fast_ids import token_ids
from latticework.llm.token_count import load_tokenizer, vocabulary_path

PATH = vocabulary_path()
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
_rng = random.Random(7)
_VOCAB = ["the", "of", "and", "to", "blue", "Bird", "sings", "über", "naïve", "été", "日本", "x_1", "don't", "3,14"] + [f"w{i}" for i in range(60)]


def _sentence(n):
    return " ".join(_rng.choice(_VOCAB) for _ in range(n))


def _corpus():
    base = [_sentence(_rng.randint(5, 120)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 3]) for i in range(40)]  # many copies of few texts
    rows += [(200 + i, re.sub(r" (\S+) ", f" z{i} ", base[5 + i % 4], count=1)) for i in range(24)]  # near copies
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one two"), (304, "ONE  two"), (305, "a"), (306, base[0].replace(" ", "\n")), (307, base[1] + "  "), (None, base[2]), (None, None)]
    rows += [(308, _sentence(9000)), (0, base[0]), (309, "<|endoftext|> and <|endoftext|>"), (310, "é" * 3000), (311, "naïve\x00text x​" * 5)]
    return [(k, t, "en", [None, "", "b", "a"][(k or 0) % 4] if k != 305 else "c", 1) for k, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_url_rules_and_globs(spark):
    urls = [
        ("http://a.b.NET/x", "a.b.net", "/x", "net/", "block"), ("https://example.net/en/1?q=/en/", "example.net", "/en/1", "example.net/en/", "allow"),
        ("https://m.example.net/en", "m.example.net", "/en", "net/", "block"), ("https://badexample.net/en/", "badexample.net", "/en/", "net/", "block"),
        ("ftp://de.example.com/de/#x", "de.example.com", "/de/", "example.com/de/", "block"), ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
        ("http://x.org/FR/", "x.org", "/FR/", None, "allow"), ("http://net", "net", "", None, "allow"), ("http://spam-farm.example.org/fr/1", "spam-farm.example.org", "/fr/1", "org/fr/", "allow"),
        ("http://spam-farm.example.org/en/1", "spam-farm.example.org", "/en/1", None, "block"), ("http://x.org/a.net/", "x.org", "/a.net/", None, "allow"),
        ("example.net/en/", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://ÉA.org/é/" + "y" * 5000, "Éa.org", "/é/" + "y" * 5000, None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "h", 5) for i, u in enumerate(urls)], "page_id long, url string, host string, verdict int")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert found == {i: u[1:] for i, u in enumerate(urls)}
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_automaton_is_the_same_as_matching_each_glob():
    rng, alphabet = random.Random(3), "ab."
    globs = [("".join(rng.choice("ab.*") for _ in range(rng.randint(1, 6))), rng.choice([None, "/" + "".join(rng.choice("ab*") for _ in range(3))])) for _ in range(60)]
    made = url_filter.Automaton([(h.encode(), p and p.encode()) for h, p in globs])
    urls = [("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 7))), rng.choice(["", "/"]) + "".join(rng.choice("ab") for _ in range(rng.randint(0, 4)))) for _ in range(300)]
    hit = made.matches([h.encode() + b"\xff" + p.encode() for h, p in urls])
    for i, (h, p) in enumerate(urls):
        for j, (gh, gp) in enumerate(globs):
            fits = re.fullmatch(re.escape(gh).replace(r"\*", ".*"), h) and (gp is None or re.fullmatch(re.escape(gp).replace(r"\*", ".*"), p))
            assert bool(fits) == hit[i, j], (h, p, gh, gp)


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(5)
    bad = ["wretch", "vermin", "crook"]
    plain = ["".join(rng.choice("abdehilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 8 == 0
        text = [rng.choice(plain) for _ in range(rng.randint(8, 60))]
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, ""), (None, "a wretch")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect()}
    held = [found[i] for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r.held_out for r in held) and 100 < len(held) < 400
    right = sum(r.predicted == (r.doc_id % 8 == 0) for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    assert found[5000].score == found[5001].score and found[None].score > 0.3
    none = toxicity.fit(docs.limit(0), marks.limit(0))
    assert toxicity.score(docs.limit(0), none).count() == 0 and toxicity.score(docs, none).count() == 903


def test_non_negative_risk_needs_no_negatives():
    rng = np.random.default_rng(1)
    pos = (rng.random((200, 3)) < [0.9, 0.5, 0.5]).astype(np.float32)
    clean = (rng.random((900, 3)) < [0.02, 0.5, 0.5]).astype(np.float32)
    w, b = toxicity.fit_nnpu(pos, np.concatenate([clean, pos[:100]]), 0.1)
    assert w[0] > 3 * max(abs(w[1]), abs(w[2])) and b < 0 < w[0] + b + 1


@pytest.mark.parametrize("chunk,overlap", [(200, 16), (64, 1), (1000, 50)])
def test_resynchronised_ids_are_the_librarys(chunk, overlap):
    tok = load_tokenizer(PATH)
    some = [_sentence(600), "x" * 3000, "a b" * 900, " " * 700 + "end", "日本 語 " * 300, ("word\n\n  word \t" * 200), "<|endoftext|> a" * 120, "don't ' s 12 345." * 150, "é  ü " * 200]
    for text in some:
        made = token_count.Resynchroniser(PATH, chunk, overlap)
        assert made.ids(text) == tok.encode(text, add_special_tokens=False).ids
        assert made.count(text) == len(made.ids(text))
    blank = token_count.Resynchroniser(PATH, chunk, overlap)
    blank.ids("x" * 3000)
    assert blank.widened > 0


def test_token_counts(docs, empty):
    tok = load_tokenizer(PATH)
    got = Counter(tuple(r) for r in token_count.count_tokens(docs, chunk=3000).collect())
    want = Counter()
    for r in docs.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want[(r.doc_id, len((r.text or "").encode()), n, n > 512)] += 1
    assert got == want and token_count.count_tokens(empty).count() == 0


def test_fast_ids_are_the_librarys():
    tok = load_tokenizer(PATH)
    odd = ["", " ", "àb", "\U0001f600 hi", "\x1c\x1d x", "…—–", "‍ ", "ŒœſƀΩ", "\x85next\xa0", "<|endoftext|>", "tab\t\ttab \n \n x", "1²³¼", "İı"]
    for text in [r[1] or "" for r in _corpus()] + odd + ["".join(chr(random.Random(i).choice([32, 39, 65, 97, 116, 49, 10, 233, 0x2019, 0x3042])) for i in range(j, j + 80)) for j in range(60)]:
        assert token_ids(text, PATH).tolist() == tok.encode(text, add_special_tokens=False).ids


def _plain_measures(text):
    text = text or ""
    w = words(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_and_verdicts(spark, docs, empty):
    junk = [(1000 + i, " ".join(f"{w}$$$" for w in _sentence(40).split()), "en", "j", 1) for i in range(12)]
    junk += [(1100 + i, (_sentence(30).upper() + "\n") * 3, "en", "j", 1) for i in range(6)]
    mixed = docs.union(spark.createDataFrame(junk, SCHEMA))
    got = quality.judge(mixed).collect()
    assert len(got) == mixed.count()
    texts = defaultdict(list)
    for r in mixed.collect():
        texts[r.doc_id].append(r.text)
    for r in got:
        plain = {_plain_measures(t) for t in texts[r.doc_id]}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in plain
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert not any(r.kept for r in got if (r.doc_id or 0) >= 1000)
    kept = quality.keep_good(mixed)
    assert kept.columns == mixed.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0


def _plain_em(patterns, rounds=300):
    """The same estimate, a text at a time."""
    rules, (bad, good), worth = len(patterns[0]), quality.OBJECTS, quality.WORTH
    chance, prior = [[bad] * rules, [good] * rules], quality.GOOD_SHARE
    for _ in range(rounds):
        post = []
        for v in patterns:
            like = [prior if k else 1 - prior for k in (0, 1)]
            for k in (0, 1):
                for j, x in enumerate(v):
                    like[k] *= chance[k][j] if x < 0 else 1 - chance[k][j] if x > 0 else 1
            post.append(like[1] / sum(like))
        for k, guess in ((0, bad), (1, good)):
            for j in range(rules):
                cast = [(p if k else 1 - p, v[j]) for p, v in zip(post, patterns, strict=True) if v[j]]
                chance[k][j] = (sum(w for w, x in cast if x < 0) + worth * guess) / (sum(w for w, _ in cast) + worth)
        prior = (sum(post) + worth * quality.GOOD_SHARE) / (len(post) + worth)
    return post


def test_quality_verdicts_by_plain_expectation_maximisation(spark, docs):
    junk = [(1000 + i, " ".join(f"{w}$$$" for w in _sentence(40).split()), "en", "j", 1) for i in range(12)]
    both = docs.union(spark.createDataFrame(junk, SCHEMA))
    good = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in both.collect())
    good = [(k, quality.measures(t.encode())) for k, t in good]
    good = [(k, m) for k, m in good if not quality.base_failed(m)]
    want = sorted((k, round(p, 6), p >= 0.5) for (k, _), p in zip(good, _plain_em([quality.votes(m) for _, m in good]), strict=True))
    got = sorted((-1 if r.doc_id is None else r.doc_id, round(r.quality, 6), r.kept) for r in quality.judge(both).collect() if not r.base_failed)
    assert got == want and {k for k, _, kept in got if not kept} >= {1000 + i for i in range(12)}


def test_estimated_accuracies_follow_the_votes():
    rng = np.random.default_rng(2)
    good = rng.random(20000) < 0.8
    right = [0.95, 0.85, 0.9, 0.8]
    votes = np.stack([np.where(rng.random(20000) < 0.3, 0, np.where(rng.random(20000) < r, 1, -1) * np.where(good, 1, -1)) for r in right], 1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    post, objects, prior = quality.estimate(patterns, n.astype(float))
    at = {tuple(p): q for p, q in zip(patterns, post, strict=True)}
    assert abs(prior - 0.8) < 0.05 and np.abs(objects - [right, [1 - r for r in right]]).max() < 0.1
    assert np.mean([(at[tuple(v)] > 0.5) == g for v, g in zip(votes, good, strict=True)]) > 0.9


def test_an_unreliable_rule_is_overruled():
    rng = np.random.default_rng(3)
    good = rng.random(30000) < 0.85
    right = [0.97, 0.95, 0.95, 0.93]
    votes = np.stack([np.where(rng.random(30000) < r, 1, -1) * np.where(good, 1, -1) for r in right] + [np.where(rng.random(30000) < 0.3, -1, 1)], 1)  # the last objects at random
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    post, objects, _ = quality.estimate(patterns, n.astype(float))
    at = {tuple(p): q for p, q in zip(patterns.tolist(), post, strict=True)}
    assert at[1, 1, 1, 1, -1] > 0.99 and at[-1, -1, -1, -1, 1] < 0.01 and abs(objects[0, 4] - objects[1, 4]) < 0.05
    assert at[1, 1, 1, -1, 1] > 0.5  # nor is one reliable rule's lone objection final


def test_any_text_goes_through_the_token_operators(spark):
    tok, long = load_tokenizer(PATH), 2_000_000
    rows = [(1, "w " * 30 + " " * long + "w " * 30), (2, "a\n" + "\n" * long + "b"), (3, "x" * long)]
    wide = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, k int, length string, piece int").repartition(3)
    ids = {k: [*tok.encode(t, add_special_tokens=False).ids, 2] for k, t in rows}
    assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(wide).collect()} == {k: len(x) - 1 for k, x in ids.items()}
    packed, ordered = packing.pack(wide).collect(), training_order.materialise(wide).collect()
    for got, size in ((packed, 1024), (ordered, 256)):
        assert Counter(r.doc_id for r in got) == {k: -(-len(x) // size) for k, x in ids.items()}
    assert all(zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in packed)
    assert all(zlib.crc32(np.array(ids[r.doc_id][256 * r.piece : 256 * r.piece + r.length], "<u4").tobytes()) == r.ids_crc32 for r in ordered)


def _plain_katz(rows, order):
    tok = [[*words(lower(r.text)), "\n"] for r in rows]
    held = [zlib.crc32(str("null" if r.doc_id is None else r.doc_id).encode()) % 5 == 1 for r in rows]
    grams = lambda t, k: zip(*([" "] * (k - 1 - i) + t[: len(t)] if k - 1 - i else t for i in range(k)), strict=False)
    seen = [Counter(g for t, h in zip(tok, held, strict=True) if not h for g in grams(t, k)) for k in range(1, order + 1)]
    n, v = sum(seen[0].values()), len(seen[0])
    cut = [katz.discounts([0] + [sum(x == r for x in c.values()) for r in range(1, 7)]) for c in seen]
    left = 1 - 1 / (n + 1)
    after = [Counter() for _ in seen]
    for k in range(order):
        for g, c in seen[k].items():
            after[k][g[:-1]] += c
    direct = [{g: left * (d[c] if c < len(d) else 1.0) * c / after[k][g[:-1]] for g, c in seen[k].items()} for k, d in enumerate(cut)]
    unknown = 1 - sum(direct[0].values())
    used, covered = defaultdict(float), defaultdict(float)
    for k in range(1, order):
        for g, p in direct[k].items():
            used[g[:-1]] += p
            covered[g[:-1]] += direct[k - 1][g[1:]]

    def p(g):
        if g in direct[len(g) - 1]:
            return direct[len(g) - 1][g]
        if len(g) == 1:
            return unknown
        h = g[:-1]
        return ((1 - used[h]) / (1 - covered[h]) if h in used else 1.0) * p(g[1:])

    vocabulary = [*(w for (w,) in seen[0])]
    for h in [*list(used)[:10], *list(used)[-10:]]:
        assert sum(p((*h, w)) for w in vocabulary) + (p((*h, "no such word"))) == pytest.approx(1)
    want = Counter()
    for r, t, h in zip(rows, tok, held, strict=True):
        s = sum(math.log10(p(g)) for g in grams(t, order))
        base = sum(math.log10((seen[0][w,] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        want[(r.doc_id, h, len(t), sum((w,) in seen[0] for w in t), n, f"{base:.6f}", f"{s:.6f}")] += 1
    return want


def _katz_rows(found):
    return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.6f}", f"{r.score:.6f}") for r in found.collect())


@pytest.mark.parametrize("order,size,fanout", [(1, 400, 128), (2, 400, 128), (3, 400, 128), (3, 10**6, 128), (3, 300, 3), (4, 500, 4)])
def test_katz_scores(docs, empty, monkeypatch, order, size, fanout):
    """Whatever the order, the blocks and the hops: as by plain recursion."""
    monkeypatch.setattr(katz, "FANOUT", fanout)
    assert _katz_rows(katz.score(docs, order=order, block_tokens=size)) == _plain_katz(docs.collect(), order)
    if order == 3 and fanout == 3:
        assert katz.score(empty).count() == 0


def test_katz_writes_rows_in_proportion(monkeypatch):
    """What blocks and nodes send grows as the blocks do (and a hop more for each FANOUT times as many parts), not as blocks times parts."""
    monkeypatch.setattr(katz, "FANOUT", 4)
    rng = np.random.default_rng(1)

    def sent(n):
        asked, sources, places, total = [], n, katz.hops(n), 0
        for block in range(n):
            marks = np.unique(rng.integers(1 << 63, size=400, dtype=np.uint64) * np.uint64(2))
            asked += katz._asked(str(block), 2, marks, np.ones((1, len(marks)), "<i8"), places[0], False)
        while True:
            total += len(asked)
            if len(places) == 1:
                return total / len(katz.hops(n))
            groups, nodes = -(-sources // places[0]), defaultdict(list)
            for row in asked:
                nodes[row[1], zlib.crc32(row[0].encode()) % groups].append(row)
            asked = []
            for node, rows in nodes.items():
                table = katz._rows(rows).append_column("node", [[str(node)] * len(rows)])
                asked += katz._listed(katz._merged(places[1])(table), "block", "part", "data", "counts", "kind")
            sources, places = groups, places[1:]

    few, many = sent(16), sent(128)
    assert many < 1.5 * 8 * few


def test_katz_keeps_blocks_of_the_same_content_apart(spark):
    rows = [(i, t, "en", "a", 1) for i, t in [(1, "a b a b c"), (2, "b c a"), (3, "a a d b")]]
    table = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), SCHEMA)
    once = spark.createDataFrame(rows * 2, SCHEMA).coalesce(1)
    got = lambda df, size: Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.9f}", f"{r.score:.9f}") for r in katz.score(df, block_tokens=size).collect())
    want = got(once, 10**6)
    assert want.total() == 6
    assert got(table.union(table), 10**6) == want  # equal partitions
    assert got(once, 1) == want  # equal blocks of one partition


def _components(rows, width, percent):
    sets = defaultdict(list)
    for k, t in rows:
        w = words(lower(t))
        sets[k].append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    keys = [k for k in sets if k is not None]
    comp = {k: k for k in keys}
    while True:
        moved = False
        for a in keys:
            for b in keys:
                if a < b and comp[a] != comp[b] and any(len(x & y) and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                    low, high = sorted((comp[a], comp[b]))
                    comp = {k: low if c == high else c for k, c in comp.items()}
                    moved = True
        if not moved:
            return comp, sets


@pytest.mark.parametrize("width,percent,bands,rows", [(3, 85, 24, 5), (5, 80, 28, 4)])
def test_near_copies(docs, empty, width, percent, bands, rows):
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    comp, sets = _components(plain, width, percent)
    got = near_dedup.similar(docs, words=width, percent=percent, bands=bands, rows=rows).collect()
    assert len(got) == len(plain)
    for r in got:
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
        assert r.component_id == comp.get(r.doc_id) and r.kept == (r.doc_id is None or comp[r.doc_id] == r.doc_id)
    kept = near_dedup.drop_similar(docs, words=width, percent=percent, bands=bands, rows=rows)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert near_dedup.similar(empty).count() == 0


def test_near_copies_in_chains_and_around_a_hidden_centre(spark):
    rng = random.Random(11)
    base = [f"v{rng.randrange(10**6)}" for _ in range(160)]
    rows = []
    for i in range(60):  # each near the centre, few near each other
        t = list(base)
        for j in rng.sample(range(160), 3):
            t[j] = f"u{i}_{j}"
        rows.append((i + 10, " ".join(t)))
    rows.append((500, " ".join(base)))
    chain = [f"c{i}" for i in range(200)]
    for i in range(12):
        rows.append((600 + i, " ".join(chain[5 * i : 5 * i + 120])))
    comp, _ = _components(rows, 3, 85)
    got = near_dedup.similar(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85, bands=24, rows=5).collect()
    assert {r.doc_id: r.component_id for r in got} == comp
    assert len({comp[600 + i] for i in range(12)}) == 1


def test_odd_sketch_estimates_high_similarities():
    rng = np.random.default_rng(4)
    for share in (0.85, 0.95):
        n = 2000
        common = rng.integers(1 << 62, size=int(n * share), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(1 << 62, size=n - len(common), dtype=np.uint64)])) for _ in "ab")
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = near_dedup.odd_sketches(np.stack([near_dedup.min_hashes(x, 120) for x in (a, b)]))
        differ = bin(int.from_bytes((s[0] ^ s[1]).tobytes(), "little")).count("1")
        estimate = 1 + 512 / (4 * 120) * math.log(1 - 2 * differ / 512)
        assert abs(estimate - true) < 0.15 and differ <= near_dedup.most_differing(true, 120)


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 70001):
        order = training_order.Feistel(n, n)
        slots = order.slots(np.arange(n))
        assert (np.sort(slots) == np.arange(n)).all() and (order.numbers(slots) == np.arange(n)).all()


def test_shards_round_trip_and_resume(spark, docs, empty, tmp_path):
    folder, length, per = str(tmp_path / "shards"), 32, 100
    plan = training_order.materialise(docs, folder, length=length, per_shard=per)
    got = plan.collect()
    read = training_order.read_slots(folder, 0, len(got), length, per)
    assert sorted(r.slot for r in got) == list(range(len(got))) and len(read) == len(got)
    want = Counter()
    for r in docs.collect():
        ids = [*load_tokenizer(PATH).encode(r.text or "", add_special_tokens=False).ids, 2]
        want.update((r.doc_id, i, tuple(ids[s : s + length])) for i, s in enumerate(range(0, len(ids), length)))
    assert Counter((r.doc_id, r.piece, tuple(read[r.slot].tolist())) for r in got) == want
    assert [x.tolist() for x in training_order.read_slots(folder, 95, 10, length, per)] == [x.tolist() for x in read[95:105]]
    last = max((tmp_path / "shards").glob("shard-*.bin"))
    before = last.stat().st_mtime_ns
    (tmp_path / "shards" / training_order.shard_name(0)).unlink()
    rows = lambda plan: {(r.doc_id, r.piece, r.slot, r.ids_crc32) for r in plan.collect()}
    again = rows(training_order.materialise(docs, folder, length=length, per_shard=per))
    assert again == {(r.doc_id, r.piece, r.slot, r.ids_crc32) for r in got} and last.stat().st_mtime_ns == before
    assert (tmp_path / "shards" / training_order.shard_name(0)).exists()
    assert training_order.materialise(empty, str(tmp_path / "none")).count() == 0


def test_shards_follow_a_changed_corpus_and_wide_ids(spark, tmp_path, monkeypatch):
    folder, tok = str(tmp_path / "s"), load_tokenizer(PATH)
    for some in (["one two three", "four five"], ["six one two", "nine five"]):  # the same sizes
        docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").coalesce(1)
        got = training_order.materialise(docs, folder, length=16, per_shard=1)
        (tmp_path / "s" / ".shard-00000000.bin.77").write_bytes(b"of an attempt that failed")
        got = training_order.materialise(docs, folder, length=16, per_shard=1).limit(1).collect() and got
        read = training_order.read_slots(folder, 0, 2, 16, 1)
        for r in got.collect():
            assert read[r.slot].tolist() == [*tok.encode(some[r.doc_id], add_special_tokens=False).ids, 2] and zlib.crc32(read[r.slot].astype("<u4").tobytes()) == r.ids_crc32
        assert not list((tmp_path / "s").glob(".shard*"))
    with pytest.raises(ValueError):
        training_order.materialise(docs, folder, length=70_000)


def test_exact_dedup(docs, empty):
    rows = docs.collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0, r.doc_id))
    import hashlib

    want = Counter((r.doc_id, min(groups[norm(r.text)])[3], len(groups[norm(r.text)]), min(groups[norm(r.text)])[3] == r.doc_id, hashlib.sha256(norm(r.text).encode()).hexdigest()) for r in rows)
    for memory, chunk in ((1 << 26, 1 << 26), (3000, 2000)):  # the second spills again and again
        assert Counter(tuple(r) for r in exact_dedup.report(docs, memory=memory, chunk=chunk).collect()) == want
        kept = exact_dedup.dedup(docs.withColumn("_h", F.lit(1)).withColumn("c0", F.lit("x")), memory=memory, chunk=chunk)
        assert kept.columns == [*docs.columns, "_h", "c0"]
        assert Counter(r.doc_id for r in kept.collect()) == Counter(min(g)[3] for g in groups.values())
    assert exact_dedup.report(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0


def test_open_table_tells_equal_hashes_apart():
    table = exact_dedup.OpenTable()
    found = [table.find(7, str(i % 900).encode()) for i in range(2000)]
    assert [j for j, _ in found] == [i % 900 for i in range(2000)] and sum(new for _, new in found) == 900


def test_packing(docs, empty):
    got = packing.pack(docs, capacity=128, with_ids=True).collect()
    want = Counter()
    total = 0
    for r in docs.collect():
        ids = [*load_tokenizer(PATH).encode(r.text or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        first = len(ids) % 128 or 128
        cuts = [0, *range(first, len(ids), 128), len(ids)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(r.doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist() and sum(n for _, n in places) <= 128
    assert len(sequences) <= 1.02 * -(-total // 128) + 2
    assert packing.pack(empty).count() == 0


def test_plans_use_every_length_once():
    rng = np.random.default_rng(9)
    for size in (10, 300, 20000):
        histogram = np.bincount(np.minimum(rng.geometric(0.01, size), 256), minlength=257)
        used = np.zeros(257, int)
        plan = packing.plan(histogram, 256)
        for row, n in plan:
            assert sum(row) <= 256 and n > 0
            for x in row:
                used[x] += n
        assert (used == histogram).all()
        least = -(-int((histogram * np.arange(257)).sum()) // 256)
        assert sum(n for _, n in plan) <= 1.02 * least + 1


def test_mixing(spark, docs, empty):
    rows = docs.collect()
    size = lambda r: len(words(r.text))
    whole = Counter()
    for r in rows:
        whole[r.source] += size(r)
    order = sorted(whole, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    held: set = set()
    while True:
        free = [s for s in order if s not in held]
        share = (sum(whole.values()) - 3 * sum(whole[s] for s in held)) / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * share >= 3 * whole[s]}
        if not more:
            break
        held |= more
    target = {s: 3.0 * whole[s] if s in held else weight[s] * share for s in order}
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows) and sum(target.values()) == pytest.approx(sum(whole.values()))
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    for r in got:
        assert any(r.size == size(x) and r.source_size == whole[x.source] and r.target == pytest.approx(target[x.source]) for x in by_id[r.doc_id])
        rate = r.target / r.source_size if r.source_size else 0
        assert r.taken in (r.size * math.floor(rate), r.size * min(3, math.floor(rate) + 1))
    names = ["doc_id", "text", "_s", "source", "_copies"]
    odd = docs.withColumn("_s", F.lit(1)).withColumn("_copies", F.lit(2)).select(names)
    copies = Counter(r.doc_id for r in mixing.mix(odd).collect())
    taken = Counter()
    for r in got:
        taken[r.doc_id] += r.taken
    sizes = {r.doc_id: size(r) for r in rows}
    assert all(copies[k] * sizes[k] == taken[k] for k in copies if k is not None and sizes[k])
    assert sorted(map(tuple, mixing.mix_report(docs.repartition(7)).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mix(empty).count() == 0 and mixing.mix_report(empty).count() == 0


def test_taken_words_come_near_their_targets(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([Row(doc_id=i, text="w " * rng.randint(1, 30), source=rng.choice("aabbbbc")) for i in range(6000)])
    got = mixing.mix_report(docs).join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken / r.target - 1) < 0.05 for r in got)
