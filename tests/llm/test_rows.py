"""Lines, near duplicates, URLs, benchmark phrases, licenses and top-k against brute force and SQL."""

import itertools
import math
import pathlib
import random
import re

import numpy as np
import pytest
from cases import COLUMNS, TEXTS, documents, no_documents, sorted_rows
from check import TESTDATA, compare, database

import __spark_entry__ as entry
from fieldtally.llm import decontaminate, fm_index, jaccard, licenses, line_dedup, top_k, urls
from fieldtally.llm.common import table
from fieldtally.llm.queries import QUERIES, SQL
from fieldtally.llm.shingles import Scratch, marked, marks

SMALL = TESTDATA / "sf0.001"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, name):
    assert compare(spark, database(SMALL), str(SMALL), name).startswith("ok")


def test_registered():
    assert {f"op{i}" for i in range(1, 14)} <= {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


# lines


def lined(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, `line_key` string, gone int")


def test_lines_go_where_they_come_again(spark):
    line, other = "this line stands everywhere", "only here and there now"
    rows = [(i, f"{line}\nbody {i}\n  {line} ", f"s{i}", "x", 1) for i in range(6)]
    rows += [(9, f"{other}\nshort", "s1", "x", 1), (10, other, "s2", "x", 1), (None, None, "s1", "x", 1), (11, "", None, "x", 1)]
    found = {r.doc_id: r for r in line_dedup.dedup_lines(lined(spark, rows), min_sites=6, min_words=4).collect()}
    assert found[0].text == f"{line}\nbody 0" and (found[0].n_lines, found[0].n_removed) == (3, 1)
    assert all(found[i].text == f"body {i}" and found[i].n_removed == 2 for i in range(1, 6))
    assert found[9].text == f"{other}\nshort" and found[10].text == other
    assert found[None].text is None and found[None].n_lines == 0
    assert found[11].text == "" and found[11].n_lines == 1
    assert found[0].line_key == "x" and found[0].gone == 1


@pytest.mark.parametrize("sites", range(3, 12))
def test_threshold_is_exact(spark, sites):
    rows = [(i, "a line of some words", f"site {i % sites}", None, None) for i in range(3 * sites)]
    removed = [r.n_removed for r in line_dedup.dedup_lines(lined(spark, rows), min_sites=6).collect()]
    assert sum(removed) == (3 * sites - 1 if sites >= 6 else 0)


@pytest.mark.parametrize("line", ["All rights reserved.", "Two words", "Les.", "–"])
def test_short_lines_are_judged(spark, line):
    rows = [(i, f"body {i}\n\n \t\n{line}", f"s{i}", None, None) for i in range(6)]
    found = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(lined(spark, rows)).collect()}
    assert found[0] == (rows[0][1], 4, 0)
    assert all(found[i] == (f"body {i}\n\n \t", 4, 1) for i in range(1, 6))


def test_all_lines_but_blank_ones_are_judged(spark):
    docs = table(spark, str(SMALL), "documents").select("doc_id", "text", "source")
    sites, seen, expected = {}, set(), {}
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect())
    for _, text, source in rows:
        for line in text.split("\n"):
            sites.setdefault(line.strip(" \t\r\f\v"), set()).add(source)
    for doc_id, text, _ in rows:
        left = []
        for line in text.split("\n"):
            key = line.strip(" \t\r\f\v")
            common = key != "" and len(sites[key]) >= 6
            if not (common and key in seen):
                left.append(line)
            if common:
                seen.add(key)
        expected[doc_id] = "\n".join(left)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == expected
    assert any(0 < len(key.split()) < 4 and len(x) >= 6 for key, x in sites.items())


def test_line_edges(spark):
    docs = documents(spark)
    found = line_dedup.dedup_lines(docs)
    assert sorted_rows(found, *docs.columns) == sorted_rows(docs, *docs.columns)
    assert line_dedup.dedup_lines(no_documents(spark)).count() == 0


# near duplicates


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def smallest_linked(rows, n, percent):
    """By place of a row, its number of shingles and the smallest id that links lead to."""
    sets, root = [shingles(t, n) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[top(i)] = top(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(rows[i][0], len(sets[i]), least[top(i)]) for i in range(len(rows))]


def near_copies(seed):
    """Texts and changed copies of them, copies of copies, and unrelated texts with words of their own."""
    draw, rows = random.Random(seed), []
    for _ in range(5):
        base = [f"w{draw.randint(0, 30)}" for _ in range(draw.randint(15, 60))]
        for _ in range(draw.randint(1, 9)):
            rows.append(" ".join(base))
            for _ in range(draw.randint(0, 3)):
                base = list(base)
                base[draw.randrange(len(base))] = f"w{draw.randint(0, 30)}"
    rows += ["a b", "A  b", "b a", "", None, " ", "x"]
    draw.shuffle(rows)
    return [(10 * i + draw.randint(0, 9), t) for i, t in enumerate(rows)]


def changed_copies(seed, copies, share, words=60):
    """Copies of one text with up to a share of their words changed, and texts that share a passage alone."""
    draw = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for _ in range(copies):
        part = draw.random() * share
        rows.append(" ".join(f"n{draw.randint(0, 10**6)}" if draw.random() < part else w for w in base))
    rows += [" ".join([*base[:12], *(f"u{draw.randint(0, 10**6)}" for _ in range(20))]) for _ in range(copies // 2)]
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("n", "percent", "cells"), [(3, 90, True), (2, 80, False), (1, 70, True)])
def test_classes(spark, monkeypatch, n, percent, cells):
    if cells:  # all by pivots, windows and cells
        monkeypatch.setattr(jaccard, "SMALL", 1)
    rows = [(i, t) for i, (_, t) in enumerate(near_copies(n * percent) + changed_copies(n * percent, 60, 0.3))]
    found = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent)
    assert sorted_rows(found, "doc_id", "n_shingles", "component_id") == sorted(smallest_linked(rows, n, percent), key=repr)


def test_regions_of_the_same_points_are_one(spark, monkeypatch):
    """A passage of many shingles in unlike texts brings them together once, not once for each shingle."""
    met, write = [], Scratch.__call__

    def counted(self, df):
        out = write(self, df)
        met.append(out.count() if {"key", "pivot"} <= set(out.columns) else 0)
        return out

    monkeypatch.setattr(Scratch, "__call__", counted)
    draw, passage = random.Random(5), " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join([passage, *draw.choices("abcde", k=250)])) for i in range(40)]
    found = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert sorted_rows(found, "doc_id", "n_shingles", "component_id") == sorted(smallest_linked(rows, 5, 80), key=repr)
    assert sum(met) <= 40 * (1 + jaccard.CELLS)


def far_texts(n: int) -> list[str]:
    """Texts without a word in common, but for the last two, of which one has a word more."""
    found = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(n - 1)]
    return [*found, found[-1] + " more"]


def test_only_shingles_that_sets_share_are_shuffled(spark, monkeypatch):
    given, shared = [], jaccard.shared
    monkeypatch.setattr(jaccard, "shared", lambda rows, *more: given.append(rows.count()) or shared(rows, *more))
    texts = far_texts(30)
    found = jaccard.components(spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string"), 5, 80)
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: i for i in range(31)} | {29: 28, 30: 0}
    assert 2 <= given[0] <= 40


def test_only_texts_in_doubt_are_shuffled(spark, monkeypatch):
    doubted, marked_of = [], jaccard.marked

    def counted(rows, *more):
        found = marked_of(rows, *more)
        if "worded" in rows.columns:
            doubted.append(found.where("worded and maybe").count())
        return found

    monkeypatch.setattr(jaccard, "marked", counted)
    rows = list(enumerate(far_texts(30)))
    kept = jaccard.one_of_each(spark.createDataFrame([*rows, rows[3], (31, None), (31, None)], "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(29), 31, 31]
    # the text that goes, the one that stands twice, and hardly another
    assert 3 <= doubted[0] <= 5


@pytest.mark.parametrize("n", [0, 1, 700])
def test_hashes_in_slices(n):
    held = np.random.default_rng(n).integers(0, 1 << 63, n, np.int64).view(np.uint64)
    found = [np.uint64(i << 30) | jaccard.unsliced(x) for i, x in jaccard.slices([held, held])]
    expected = np.sort(np.concatenate([held, held]) >> np.uint64(24))
    assert np.array_equal(np.concatenate([*found, np.zeros(0, np.uint64)]), expected)


def test_marks_leave_out_none(spark):
    rows = spark.createDataFrame([(i if i % 9 else None, str(i)) for i in range(500)], "a long, b string")
    table = marks(rows.where("cast(b as int) % 5 = 0"), "a", "b")
    found = {int(r.b) for r in marked(rows, table, "a", "b").where("maybe").collect()}
    assert found >= set(range(0, 500, 5)) and len(found) < 110


def test_class_edges(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = sorted_rows(jaccard.components(docs, 3, 90), "doc_id", "n_shingles", "component_id")
    expected = [(i, len(shingles(t, 3)), c if shingles(t, 3) else i) for (i, t), (_, _, c) in zip(rows, smallest_linked(rows, 3, 90))]
    assert found == sorted(expected, key=repr)
    assert jaccard.components(no_documents(spark)).count() == 0


def test_one_of_each_class_stays(spark):
    docs = documents(spark)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    found = sorted_rows(kept, "doc_id", "text")
    wordless = [(r.doc_id, r.text) for r in docs.collect() if not shingles(r.text, 5)]
    others = {t: i for i, t in reversed(list(enumerate(TEXTS))) if shingles(t, 5)}
    assert found == sorted([*wordless, *((i, t) for t, i in others.items())], key=repr)
    assert jaccard.one_of_each(no_documents(spark)).count() == 0


# URLs


def test_url_edges(spark):
    given = [None, "", "no scheme", "HTTP://A.Example.NET", "x://net/", "x://net", "x://y.org/fr/?q", "x://y.org/fr", "x://example.net/en/a#b",
             "x://badexample.net/en/", "http://a.com/casino", "http://a.com/casinos", "http://win-free.com", "http://win.com/win", "a://b?c://d/e", "http://é.com/xxxé"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(given)], "page_id long, url string, host string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages).collect()}
    assert found[0] == found[1] == found[2] == ("", "", None, "allow")
    assert found[3] == ("a.example.net", "", None, "allow")
    assert found[4] == ("net", "/", "net/", "block") and found[5] == ("net", "", None, "allow")
    assert found[6] == ("y.org", "/fr/", "org/fr/", "allow") and found[7][2] is None
    assert found[8] == ("example.net", "/en/a", "example.net/en/", "allow")
    assert found[9] == ("badexample.net", "/en/", "net/", "block")
    assert [found[i][3] for i in (10, 11, 12, 13)] == ["block", "allow", "block", "allow"]
    assert found[14][:2] == ("b", "") and found[15][3] == "block"
    plain = urls.filter_urls(pages, rules=(), strict=(), soft=())
    assert {r.verdict for r in plain.collect()} == {"allow"}
    assert urls.filter_urls(pages.limit(0)).count() == 0


# benchmark phrases


def hits(text, items, window):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(ASCII_LOWER))
    own, hit, names = find(text), set(), set()
    for name, phrase in items:
        row = find(phrase)
        for i in range(max(1, len(row) - window + 1) if row else 0):
            part = row[i : i + window]
            for j in range(len(own) - len(part) + 1):
                if own[j : j + len(part)] == part:
                    names.add(name)
                    hit.update(range(j, j + len(part)))
    return len(own), hit, sorted(names)


def phrase_case(seed):
    draw = random.Random(seed)
    words = [*"abcdéÉ1", "Ab", "x"][: draw.randint(2, 9)]
    make = lambda n: draw.choice([" ", ", ", "\n"]).join(draw.choice(words) for _ in range(n))
    items = [(str(i), make(draw.randint(0, 12))) for i in range(draw.randint(0, 6))]
    return items, [None if draw.random() < 0.05 else make(draw.randint(0, 60)) for _ in range(draw.randint(0, 12))], draw.randint(1, 5)


@pytest.mark.parametrize("seed", range(60))
def test_phrases(seed):
    items, texts, window = phrase_case(seed)
    found = decontaminate.search(decontaminate.Phrases.of(items, window), texts)
    for n, spans, names, text in zip(*found, texts):
        covered = {i for a, b in spans for i in range(a, b + 1)}
        assert (n, covered, names) == hits(text, items, window)


@pytest.mark.parametrize("seed", range(20))
def test_index(seed):
    draw = np.random.default_rng(seed)
    text = np.append(draw.integers(0, 4, draw.integers(0, 80)), 0)
    index = fm_index.FMIndex(text)
    phrases = draw.integers(1, 5, (30, 3))
    lengths = draw.integers(1, 4, 30)
    low, high = index.search(phrases, lengths)
    for phrase, n, a, b in zip(phrases, lengths, low, high):
        expected = [i for i in range(len(text) - n + 1) if (text[i : i + n] == phrase[:n]).all()]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == expected


def test_benchmark_in_blocks(spark, monkeypatch):
    docs, benchmark = (spark.read.parquet(str(SMALL / f"{t}.parquet")) for t in ("documents", "benchmark"))
    whole = sorted_rows(decontaminate.find_contamination(docs, benchmark), "*")
    assert sum(row[2] > 0 for row in whole) > 0
    monkeypatch.setattr(decontaminate, "BLOCK", 3000)
    assert sorted_rows(decontaminate.find_contamination(docs, benchmark), "*") == whole
    items = [(str(r.item_id), r.text) for r in benchmark.collect()]
    for row in whole[:40] + [r for r in whole if r[2]]:
        text = docs.where(f"doc_id = {row[0]}").first().text
        n, covered, names = hits(text, items, 10)
        assert (row[1], row[2], row[4]) == (n, len(covered), names)


def test_phrases_are_cut(spark):
    phrase = "one two three four five six seven eight nine ten"
    benchmark = spark.createDataFrame([(1, f"{phrase} eleven", "x"), (None, "a", "x"), (2, None, "x"), (3, "é!", "x")], "item_id long, text string, spans string")
    text = f"Before, ONE two; three four five six seven eight nine ten eleven. After É {phrase}!"
    docs = spark.createDataFrame([(1, text, "s"), (2, None, "s"), (3, "", "s")], "doc_id long, text string, row string")
    found = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, benchmark).collect()}
    assert found == {1: "Before, . After É !", 2: None, 3: ""}
    docs = documents(spark)
    assert sorted_rows(decontaminate.decontaminate(docs, benchmark.limit(0)), "*") == sorted_rows(docs, "*")
    assert all(r.n_hit == 0 for r in decontaminate.find_contamination(docs, benchmark.limit(0)).collect())
    assert decontaminate.decontaminate(no_documents(spark), benchmark).count() == 0


# licenses


@pytest.mark.parametrize("seed", range(40))
def test_alignment(seed):
    draw = random.Random(seed)
    values = draw.sample(range(20), draw.randint(0, 8))
    longest = max(len(c) for k in range(len(values) + 1) for c in itertools.combinations(values, k) if list(c) == sorted(c))
    chain = [values[i] for i in licenses.increasing(values)]
    assert len(chain) == longest and chain == sorted(chain)
    a, b = ([draw.choice("abcdefgh").encode() for _ in range(draw.randint(0, 12))] for _ in range(2))
    pairs = licenses.aligned(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    once = [w for w in set(a) & set(b) if a.count(w) == b.count(w) == 1]
    assert len(pairs) >= bool(once) and licenses.aligned(a, a) == [(i, i) for i in range(len(a))]


def test_licenses_found(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    rows = [(0, "the " * 300 + mit + " and the " * 50 + mit.replace("the ", "the old ")), (1, gpl.upper().replace("VERSION", "edition")), (2, "mit license"), (3, None), (4, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licenses string")
    found = {r.doc_id: [(x.name, x.coverage, x.first, x.last) for x in r.licenses] for r in licenses.scan_licenses(docs).collect()}
    assert found[0] == [("MIT", 1.0, 300, 304)]
    assert [(x[0], round(x[1], 3)) for x in found[1]] == [("GPL-3.0", round(11 / 12, 3))]
    assert found[2] == found[3] == found[4] == []
    assert licenses.scan_licenses(docs, {"none": "!"}).where("size(licenses) > 0").count() == 0
    assert len(licenses.scan_licenses(documents(spark)).collect()) == len(TEXTS) + 3
    assert licenses.scan_licenses(no_documents(spark)).count() == 0


def test_every_place_of_a_license():
    mit, mpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["MPL-2.0"]
    scanner = licenses.Templates(licenses.TEMPLATES, licenses.COVERAGE)
    far = "x " * 30 + mit + " y" * 40 + " " + mit.replace("the ", "the old ")
    assert scanner.scan(far, True) == [("MIT", 1.0, 30, 34), ("MIT", 1.0, 75, 80)]
    near = f"x {mit} y {mit} z"
    assert scanner.scan(near, True) == [("MIT", 1.0, 1, 5), ("MIT", 1.0, 7, 11)]
    assert scanner.scan(near) == [("MIT", 1.0, 1, 5)]
    assert scanner.scan(f"{mit} {mit} {mit}", True) == [("MIT", 1.0, i, i + 4) for i in (0, 5, 10)]
    assert [x[0] for x in scanner.scan(f"a {mpl} b", True)] == ["MPL-2.0"]


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_templates_are_told_apart(name):
    found = {x[0] for x in licenses.Templates(licenses.TEMPLATES, licenses.COVERAGE).scan(licenses.TEMPLATES[name], True)}
    assert found - {"Apache-2.0"} == {name} - {"Apache-2.0"} and name in found


def test_license_query(spark):
    docs = spark.read.parquet(str(SMALL / "documents.parquet")).collect()
    found = {(r.doc_id, r.license) for r in QUERIES["op7_license_scan"](spark, str(SMALL)).collect()}
    for name in ("MIT", "GPL-3.0", "Apache-2.0", "CC-BY-NC-4.0"):
        assert {r.doc_id for r in docs if licenses.TEMPLATES[name] in r.text} <= {i for i, n in found if n == name}
    assert {i for i, _ in found} == {r.doc_id for r in docs}


# top-k


def best(rows, asked, k):
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for query, vector in {(i, tuple(v)) for i, v in usable if i in asked}:
        scores = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in usable if i != query)
        yield from ((query, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1))


@pytest.mark.parametrize("seed", range(4))
def test_top_k(spark, monkeypatch, seed):
    monkeypatch.setattr(top_k, "BLOCK", 37)
    monkeypatch.setattr(top_k, "QUERIES", 5)
    monkeypatch.setattr(top_k, "FEW", 0.0)
    draw = random.Random(seed)
    rows = [(i, [draw.randint(-2, 2) / 4 + 0.003 for _ in range(6)]) for i in range(150)]
    rows += [rows[3], (200, None), (201, [None, 1.0]), (202, [math.nan]), (203, [math.inf]), (204, []), (None, [1.0]), (205, [0.5])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    found = top_k.top_k(frame, frame.where("vec_id % 20 = 0"), 4)
    asked = {i for i, _ in rows if i is not None and i % 20 == 0}
    assert sorted_rows(found, "query_id", "rank", "vec_id", "score") == sorted(best(rows, asked, 4), key=repr)
    assert top_k.top_k(frame.limit(0), frame.limit(0)).count() == 0
    assert top_k.top_k(frame.limit(0), frame).count() == 0


@pytest.mark.parametrize("spread", [20.0, 1e4, 2.0**21])
def test_top_k_of_large_components(spark, monkeypatch, spread):
    """Scores beyond 2^24, and beyond 2^53, against integers of any size."""
    monkeypatch.setattr(top_k, "BLOCK", 61)
    draw = np.random.default_rng(11)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(draw.normal(0, spread, (200, 16)))]
    rows += [(200 + i, [x + (j == 0) / 64 for j, x in enumerate(row)]) for i, row in rows]  # scores that differ by little
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = top_k.top_k(frame, frame.where("vec_id % 20 = 0"), 5).collect()
    whole = {i: [math.floor(x * 64) for x in row] for i, row in rows}
    expected = []
    for i in range(0, 400, 20):
        scores = sorted((-sum(map(int.__mul__, whole[i], v)), j) for j, v in whole.items() if j != i)[:5]
        expected += [(i, rank, j, -score) for rank, (score, j) in enumerate(scores, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == expected


def test_top_k_of_components_beyond_32_bits(spark):
    frame = spark.createDataFrame([(i, [2.0**26 + i / 64]) for i in range(9)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(20, [1.5])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in top_k.top_k(frame, asked, 2).orderBy("rank").collect()] == [(8, 96 * (2**32 + 8)), (7, 96 * (2**32 + 7))]


def test_top_k_beyond_64_bits_fails(spark):
    frame = spark.createDataFrame([(0, [1e12]), (20, [-1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="beyond 64 bits"):
        top_k.top_k(frame, frame, 1)


def test_top_k_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(str(SMALL / "embeddings.parquet")).collect()]
    found = sorted_rows(QUERIES["op10_top_k"](spark, str(SMALL)), "query_id", "rank", "vec_id", "score")
    assert found == sorted(best(rows, {i for i, _ in rows if i % 20 == 0}, 20), key=repr)


def test_no_import_of_ours_elsewhere():
    root = pathlib.Path(entry.__file__).parent
    for file in root.glob("fieldtally/**/*.py"):
        if "llm" not in file.parts:
            assert "fieldtally.llm" not in file.read_text()


def test_columns_of_cases():
    assert len(COLUMNS.split(",")) == 13
