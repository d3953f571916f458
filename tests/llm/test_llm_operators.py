"""Each corpus operator against a plain version of itself on small tables."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import ann, banding, common, langid, licenses, matroska, mixing, packing, simhash, substring_dedup, tokencount, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = {"en": "the of and to in is that with for this", "fr": "le la les des une est dans pour avec que", "de": "der die das und ist nicht ein eine mit von"}


def docs(spark, texts, extra=()):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)


def prose(rng, n, lang="en"):
    stems = WORDS[lang].split()
    return " ".join(rng.choice(stems) + rng.choice(["", "", rng.choice(stems), chr(97 + rng.randrange(26)) * 2]) for _ in range(n))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 6000 + i) for i in range(200)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in parent}


# --- 1 -------------------------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(5, 60), lang), lang) for i, lang in enumerate(["en", "fr", "de"] * 60)]
    rows += [(900, None, "en"), (901, "", None), (902, "123 !!", None), (903, "é", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    held = F.col("doc_id") % 5 == 0
    got = {r["doc_id"]: r for r in langid.identify(df.withColumn("score", F.lit("clash")), df.where(~held)).collect()}
    assert len(got) == len(rows)
    right = [got[i]["lang_pred"] == lang for i, _, lang in rows[:180] if i % 5 == 0]
    assert sum(right) / len(right) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] in WORDS
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = langid.identify(df, df.where("false"))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert langid.identify(df.where("false"), df).count() == 0


def test_model_equals_plain_kernel_ridge():
    """Scores from sets of n-grams and kernel matrices written out."""
    rng = random.Random(8)
    texts = [(prose(rng, rng.randrange(2, 40), lang).encode(), lang) for lang in ["en", "fr", "de"] * 50] + [(b"x", "fr"), (b"x", "en")]
    langs = [lang for _, lang in texts]
    model = langid.fit(langs, [np.packbits(f).tobytes() for f in langid.presence([t for t, _ in texts])])
    grams = lambda t: set(langid.present(t).tolist())
    kernel = lambda a, b: len(a & b) / math.sqrt(max(1, len(a)) * max(1, len(b)))
    names = sorted(set(langs))
    marks = [grams(t) for name in names for t in [t for t, lang in texts if lang == name][: langid.LANDMARKS // 3]]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    rows = lambda ts: np.hstack([np.array([[kernel(grams(t), m) for m in marks] for t in ts]) @ root, np.ones((len(ts), 1))])
    z = rows([t for t, _ in texts])
    weight = np.array([len(langs) / (3 * langs.count(x)) for x in langs])[:, None]
    ridge = langid.RIDGE * len(langs) * np.eye(z.shape[1])
    ridge[-1, -1] = 0
    w = np.linalg.solve(z.T @ (weight * z) + ridge, z.T @ (weight * np.array([[1.0 if x == n else -1.0 for n in names] for x in langs])))
    fresh = [prose(rng, n, "de").encode() for n in (1, 5, 200)] + [b"", "ß é".encode()]
    assert np.abs(langid.score(model, fresh) - rows(fresh) @ w).max() < 0.02


def test_many_languages_are_learned(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" * 9 + " " + "xyz"[i % 3], f"l{i}") for i in range(300)]
    df = spark.createDataFrame(rows * 2, "doc_id bigint, text string, lang string")
    langs, _ = langid.training_sample(df, "doc_id", "text", "lang", 150)
    assert set(langs) == {f"l{i}" for i in range(300)}


def test_presence_counts_each_gram_once():
    flags = [f.copy() for f in langid.presence([b"ab", b"ab ab  AB", b""])]
    assert flags[0].sum() == 3 and flags[2].sum() == 0
    assert not (flags[0] & ~flags[1]).any()


# --- 2 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [7, simhash.MAX_BANDS])
def test_bands_reach_recall(most):
    bands, rows = banding.tune_bands(max_bands=most)
    assert bands <= most and 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_inside_links_equal_all_pairs():
    rng = random.Random(2)
    base = [rng.sample(range(400), 45) for _ in range(4)]
    sets = []
    for i in range(230):
        b = list(base[i % 4])
        for _ in range(rng.randrange(7)):
            b[rng.randrange(len(b))] = rng.randrange(2000)
        sets.append(np.unique(np.array(b, np.int64)))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        c = len(np.intersect1d(sets[i], sets[j]))
        if c >= 0.8 * (len(sets[i]) + len(sets[j]) - c):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    assert banding.linked_inside(sets, 0.8).tolist() == [find(i) for i in range(len(sets))]


def cut(text, removed):
    """A text without the words of the ranges and the white space after them."""
    raw = text.encode()
    at = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)] + [len(raw)]
    out, last = [], 0
    for a, b in removed:
        out.append(raw[last : at[min(a, len(at) - 1)]])
        last = at[min(b, len(at) - 1)]
    return b"".join([*out, raw[last:]]).decode()


def union_find(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def five(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return a == b or bool(a and b) and len(a & b) >= 0.8 * len(a | b)


def plain_repeats(texts, min_words):
    """The same rules, all lines and all windows compared: id -> (removed, short)."""
    lines = []  # (doc, start, words)
    for d, text in enumerate(texts):
        n = 0
        for line in (text or "").translate(LOWER).split("\n"):
            w = re.findall(r"[^\x20\x09-\x0D]+", line)
            if w:
                lines.append((d, n, w))
            n += len(w)
    sets = [five(w) for _, _, w in lines]
    alike = lambda i, j: lines[i][2] == lines[j][2] or min(len(lines[i][2]), len(lines[j][2])) >= 5 and near(sets[i], sets[j])
    root = union_find(len(lines), [p for p in itertools.combinations(range(len(lines)), 2) if alike(*p)])
    keeper = {}
    for r, (d, _, _) in zip(root, lines):
        keeper[r] = min(d, keeper.get(r, d))
    spans = collections.defaultdict(list)
    short = collections.defaultdict(set)
    for r, (d, at, w) in zip(root, lines):
        if d > keeper[r]:
            spans[d].append((at, at + len(w))) if len(w) >= min_words else short[d].add((at, at + len(w)))
    gone = {d: list(x) for d, x in spans.items()}
    words = [[w for e, _, ws in lines if e == d for w in ws] for d in range(len(texts))]
    whole = {}
    windows = collections.defaultdict(set)
    for d, w in enumerate(words):
        if len(w) >= min_words and whole.setdefault(tuple(w), d) != d:
            spans[d].append((0, len(w)))
            continue
        for i in range(len(w) - min_words + 1):
            if not any(a <= i and i + min_words <= b for a, b in gone.get(d, ())):
                windows[tuple(w[i : i + min_words])].add((d, i))
    for held in windows.values():
        first = min(d for d, _ in held)
        for d, i in held:
            if d != first:
                spans[d].append((i, i + min_words))
    out = {}
    for d in range(len(texts)):
        merged = []
        for a, b in sorted(spans[d]):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out[d] = merged, sorted([a, b] for a, b in short[d] if not any(x <= a and b <= y for x, y in merged))
    return out


@pytest.mark.parametrize("members, words", [(1024, 500_000), (2, 500_000), (1024, 60)])
def test_repeats_equal_all_lines_and_windows(spark, monkeypatch, members, words):
    monkeypatch.setattr(banding, "BLOCK_MEMBERS", members)
    monkeypatch.setattr(banding, "BLOCK_WORDS", words)
    rng = random.Random(3)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for n in [8, 9, 10, 12, 20, 51] * 3:  # passages inside lines
        passage = new(n)
        texts += [" ".join(new(rng.randrange(1, 20)) + passage + new(rng.randrange(1, 20))) for _ in range(rng.choice([2, 3]))]
    line = new(40)
    for i in range(9):  # near copies of a line, among other lines
        edited = list(line)
        for k in rng.sample(range(40), i % 3):
            edited[k] = new(1)[0]
        texts.append("\n".join(" ".join(x) for x in (new(6), edited, new(7))))
    texts += ["one two", "One  two\nthree", "all rights reserved\n" + " ".join(new(12)), " ".join(new(3)) + "\nAll rights reserved"]
    texts += [texts[0], texts[0], texts[20] + "\n" + texts[25], None, "", " \n ", "in " * 40 + " ".join(new(3)), " ".join(new(4)) + " in" * 30]
    texts.append(texts[0] + " " + "x" * 100_000)
    rng.shuffle(texts)
    got = {r["doc_id"]: r for r in substring_dedup.find_repeats(docs(spark, texts), min_words=10).collect()}
    want = plain_repeats(texts, 10)
    assert {i: (r["removed"], r["short"]) for i, r in got.items()} == {i: tuple(x) for i, x in want.items()}
    assert all(r["n_removed"] == sum(b - a for a, b in r["removed"]) and all(k < i for k in r["kept_in"]) for i, r in got.items())
    kept = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs(spark, texts).withColumn("n_chars", F.length("text")), min_words=10).collect()}
    for i, text in enumerate(texts):
        if got[i]["n_removed"] and got[i]["n_removed"] == got[i]["n_words"]:
            assert i not in kept
        else:
            assert kept[i]["text"] == (text and cut(text, got[i]["removed"])) and kept[i]["n_chars"] == (None if text is None else len(kept[i]["text"]))


def test_repeats_of_odd_rows(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, p, 1), (1, p, 2), (None, p, 3), (None, None, 4), (5, p.upper() + "\nx y", 5), (5, p.upper() + "\nx y", 6), (7, None, 7), (8, "", 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind int").withColumns({"key_": F.lit(1), "gone_": F.lit(2), "spans_": F.lit(3), "h": F.lit(4), "n_removed": F.create_map(F.lit("a"), F.lit(1))})
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_in"]) for r in substring_dedup.find_repeats(df).collect()), key=str)
    assert got == sorted([(1, 60, 0, [])] * 2 + [(None, 60, 0, []), (None, 0, 0, []), (7, 0, 0, []), (8, 0, 0, [])] + [(5, 62, 60, [1])] * 2, key=str)
    out = substring_dedup.remove_repeats(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    assert sorted((r["kind"], r["text"]) for r in out.where("text is not null").collect()) == [(1, p), (2, p), (3, p), (5, "x y"), (6, "x y"), (8, "")] and out.count() == 8
    assert substring_dedup.find_repeats(df.where("false")).count() == 0 and substring_dedup.remove_repeats(df.where("false")).count() == 0


def test_own_words_of_a_mostly_shared_document_stay(spark):
    passage, own = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("p", 200), ("q", 9)))
    texts = [passage, passage + "\n" + own, "a b\n" + passage, passage]
    kept = {r["doc_id"]: r["text"].split() for r in substring_dedup.remove_repeats(docs(spark, texts)).collect()}
    assert kept == {0: passage.split(), 1: own.split(), 2: ["a", "b"]}


# --- 3 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(5))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    cells = sorted((n, rng.randrange(1, 9)) for n in rng.sample(range(1, 60), 9))

    def padding(cells, ends):
        return sum((min(e for e in ends if e >= n) - n) * c for n, c in cells)

    for k in (1, 2, 3, 4, 9, 20):
        best = min(padding(cells, [*inner, cells[-1][0]]) for size in range(min(k, len(cells))) for inner in itertools.combinations([n for n, _ in cells[:-1]], size))
        ends = packing.best_boundaries(cells, k)
        assert len(ends) <= k and padding(cells, ends) == best
    cells = sorted((n, rng.choice([1, 1, 5, 1000])) for n in rng.sample(range(0, 5000), 150))
    table = [[sum((cells[j][0] - n) * c for n, c in cells[: j + 1]) for j in range(150)]]
    for _ in range(5):
        table.append([min([table[-1][j], *(table[-1][i] + sum((cells[j][0] - n) * c for n, c in cells[i + 1 : j + 1]) for i in range(j))]) for j in range(150)])
    assert padding(cells, packing.best_boundaries(cells, 6)) == table[-1][-1]


def test_packing(spark):
    rng = random.Random(6)
    texts = [prose(rng, rng.choice([1, 3, 10, 40, 200])) for _ in range(200)] + [None, "", " \n", "w " * 3000, "same", "same"]
    got = packing.pack(docs(spark, texts), buckets=5, token_budget=400).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    batches = collections.defaultdict(list)
    for r in got:
        assert r["n_tokens"] == len((texts[r["doc_id"]] or "").split()) and r["padding"] == r["bucket_tokens"] - r["n_tokens"] >= 0
        batches[r["batch_id"]].append(r)
    for rows in batches.values():
        assert len({r["bucket"] for r in rows}) == 1 and sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert len(rows) == 1 or len(rows) * max(1, rows[0]["bucket_tokens"]) <= 400
    assert packing.pack(docs(spark, texts).where("false")).count() == 0
    odd = spark.createDataFrame([(None, "a b", 1), (None, "a b", 1), (3, None, 7), (3, "c", 4)], "doc_id bigint, text string, bucket int")
    assert sorted(((r["doc_id"], r["n_tokens"], r["bucket_tokens"]) for r in packing.pack(odd, buckets=1).collect()), key=str) == [(3, 0, 2), (3, 1, 2), (None, 2, 2), (None, 2, 2)]
    assert sorted(r["n_tokens"] for r in packing.pack(odd, tokens=F.col("bucket")).collect()) == [1, 1, 4, 7]


# --- 4 -------------------------------------------------------------------------------------


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 12)).astype(np.float32)
    x[100:140] = x[0]  # ties
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
    rows += [(9000, None), (9001, []), (9002, [0.0] * 12), (9003, [float("nan")] * 12), (9004, [1.0] * 11 + [None]), (9005, [1.0] * 5), (None, [1.0] * 12), (9007, [float("inf")] * 12)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    got = collections.defaultdict(list)
    for r in ann.search(df.withColumn("score", F.lit(1)), F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r)
    assert set(got) == set(range(0, 600, 20))
    d = x.astype(np.float64)
    hits = 0
    for q, rows_ in got.items():
        s = d @ d[q]
        want = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        hits += len({r["vec_id"] for r in rows_} & set(want))
        assert [r["rank"] for r in rows_] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in rows_] == sorted((-r["score"], r["vec_id"]) for r in rows_)
        assert all(math.isclose(r["score"], s[r["vec_id"]], rel_tol=1e-12, abs_tol=1e-12) for r in rows_)
    assert hits / (20 * len(got)) >= 0.9
    assert ann.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("n", [1, 10, 21, 60])
def test_small_tables_give_all_candidates(spark, n):
    """Repeated ids, repeated rows and two dimensions, held against every pair."""
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(n)]
    if n > 1:
        rows += [(0, rng.normal(size=8).round(3).tolist()), rows[0], rows[5], (40, [1.0, 2.0]), (0, [3.0, 1.0]), (41, [3.0, 1.0])]
    got = collections.Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0).collect())
    want = collections.Counter()
    for i, (q, e) in enumerate(rows):
        if q % 20 == 0:
            near = sorted((-math.fsum(a * b for a, b in zip(e, x)), v) for j, (v, x) in enumerate(rows) if j != i and len(x) == len(e))[:20]
            want.update((q, k + 1, v, round(-s, 9)) for k, (s, v) in enumerate(near))
    if n < 60:
        assert got == want
    else:
        assert sum((got & want).values()) >= 0.9 * sum(want.values()) == 0.9 * sum(got.values())


# --- 5 -------------------------------------------------------------------------------------


def test_license_base_columns(spark):
    rng = random.Random(8)
    bits = ["MIT", "License", "license", "Apache", "cc", "by", "GNU", "General", "public", "é", "the", "x9", "mit_license", "CC-BY"]
    texts = [rng.choice(["", " ", "-"]).join(rng.choice(bits) + rng.choice([" ", "\n", ", ", "."]) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    texts += [None, "", "...", "mit license mit license", "GNU GENERAL PUBLIC LICENSE", "Kmit license", "smit license", "mit license" + " q" * 50_000]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts).withColumn("labels", F.lit("clash"))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        found = [(k, label) for p, label in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in found]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_templates(spark):
    texts = [f"some words before, {t.words.upper()}; and after" for t in licenses.TEMPLATES]
    texts += ["redistribution in source of binary forms and use", "software license warranty " * 20_000]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(licenses.TEMPLATES):
        assert t.label in got[i]["labels"].split(","), t
        assert any(s["label"] == t.label and s["start"] == 3 for s in got[i]["starts"])
    assert got[len(texts) - 2]["labels"] == "" and got[len(texts) - 1]["labels"] == ""
    assert licenses.scan(docs(spark, texts).where("false")).count() == 0


# --- 6 -------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    bodies = ["<p>one</p>", "é" * 3000, None, "", "<p>one</p>", "<p>one</p>", "x\r\n\r\ny", "same", "same"]
    rows = [(10 - i, f"http://h/{i} \né", b, 1) for i, b in enumerate(bodies)] + [(None, None, "<p>one</p>", 2), (None, None, "alone", 2), (2, "u", "same", 3)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int").repartition(2)
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(pages, folder)
    got = warc.read_records(index, folder, with_payload=True).collect()
    assert len(got) == len(rows)
    least = {}
    for i, _, b, _ in rows:
        if i is not None:
            least[b or ""] = min(least.get(b or "", i), i)
    want = collections.Counter()
    for i, _, b, _ in rows:
        raw = (b or "").encode()
        first = least.get(b or "")
        many = sum((x[2] or "") == (b or "") for x in rows) > 1
        to = first if many and first is not None and i != first else None
        want[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to is None else "revisit", to)] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    assert all(bytes(r["payload"]) == b"" for r in got if r["record_type"] == "revisit")
    one = warc.read_records(index.where("page_id = 9"), folder, with_payload=True).collect()
    assert len(one) == 1 and bytes(one[0]["payload"]).decode() == "é" * 3000
    small = warc.write_archives(pages, f"{folder}2", min_bytes=5)
    assert {r["record_type"] for r in small.where("length(url) > 0").join(pages.where("length(html) < 5").select("page_id"), "page_id").collect()} == {"response"}
    empty = warc.write_archives(pages.where("false"), f"{folder}3")
    assert warc.read_records(empty, f"{folder}3").count() == 0


def test_ranges_coalesce():
    rows = [(0, 10), (10, 5), (100_000, 7), (200_000, 9), (200_009, 1)]
    assert list(warc.ranges(rows)) == [(0, 15, rows[:2]), (100_000, 100_007, rows[2:3]), (200_000, 200_010, rows[3:])]


# --- 7 -------------------------------------------------------------------------------------


def greedy(pieces, word):
    s, n = b" " + word, 0
    while s:
        k = next((k for k in range(len(s), 0, -1) if s[:k] in pieces), 0)
        if not k:
            return 1
        s, n = s[k:], n + 1
    return n


def test_token_automaton_equals_greedy():
    rng = random.Random(9)
    for _ in range(60):
        pieces = {bytes(rng.choice(b"ab c") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 25))}
        auto = tokencount.WordPieceCounter(sorted(pieces))
        for _ in range(80):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14)))
            assert auto.pieces(word) == greedy(pieces, word), (pieces, word)


def test_token_counts(spark):
    pieces = [bytes([b]) for b in range(256)] + [b" the", b"the", b" th", b"er", b"ere", b"\xc3\xa9"]
    texts = ["the there\tthe", None, "", " \n", "é" * 5000, "the " * 50_000]
    got = {r["doc_id"]: (r["n_tokens"], r["n_words"], r["n_bytes"]) for r in tokencount.token_counts(docs(spark, texts), pieces).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert got[i] == (sum(greedy(set(pieces), w) for w in raw.split()), len(raw.split()), len(raw))
    with pytest.raises(ValueError):
        tokencount.token_counts(docs(spark, texts), [])


# --- 8 -------------------------------------------------------------------------------------


def test_mixing_plan():
    tokens = {"a": 1000, "b": 100, "c": 100, None: 50, "z": 0}
    free = mixing.plan(tokens, target_entropy=0.9, max_repeats=1e9)
    assert math.isclose(mixing.entropy(free.weights), 0.9 * math.log(4), rel_tol=1e-6)
    tight = mixing.plan(tokens, target_entropy=1.0, max_repeats=2.0)
    assert math.isclose(max(q / tokens[s] for s, q in tight.quotas.items() if tokens[s]), 2.0, rel_tol=0.02)
    assert all(q >= tokens[s] for s, q in tight.quotas.items())
    assert mixing.plan(tokens, target_entropy=0.0).alpha == 1.0
    assert mixing.plan({}).quotas == {} and mixing.plan({"a": 0}).quotas == {"a": 0}


def check_draws(spark, df, plan, got):
    """The draws anew, from nothing but the hashes that order them: whole passes, then blocks up to the quota."""
    own = {s: list(rows) for s, rows in itertools.groupby(sorted(df.collect(), key=lambda r: str(r["source"])), key=lambda r: r["source"])}
    want = []
    for source, rows in own.items():
        length = [len((r["text"] or "").split()) for r in rows]
        total, quota = sum(length), plan.quotas[source]
        whole = quota // total if total else 1
        for number in range(whole + 1):
            frame = spark.createDataFrame([(i, r["doc_id"], r["text"]) for i, r in enumerate(rows)], "i int, doc_id bigint, text string").withColumn("h", F.xxhash64("text"))
            o = F.xxhash64(F.lit(0), F.lit(number).cast("bigint"), "doc_id", "h")
            keyed = frame.select("i", o.alias("o"), F.pmod(F.xxhash64(F.lit(1), o), F.lit(max(1, len(rows) // mixing.BLOCK_DOCS)).cast("bigint")).alias("b")).collect()
            left = total if number < whole else quota - whole * total if total else 0
            if number == whole and not left:
                continue
            for _, members in itertools.groupby(sorted(keyed, key=lambda k: (k["b"], k["o"])), key=lambda k: k["b"]):
                for slot, k in enumerate(members):
                    left -= length[k["i"]]
                    if left < 0 and number == whole:
                        break
                    want.append((rows[k["i"]]["doc_id"], source, number, k["b"], slot))
                if left < 0 and number == whole:
                    break
    assert collections.Counter(want) == collections.Counter((r["doc_id"], r["source"], r["pass"], r["block"], r["slot"]) for r in got)


def test_mixing_draws(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 16)
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randrange(1, 30)), "hot" if i % 3 else f"s{i % 7}") for i in range(600)] + [(700, None, "s1"), (701, "", None), (702, "x y", None), (None, "p q", "s1"), (703, "d d", "s2"), (703, "d d", "s2")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    draws = mixing.mix(df.withColumn("h", F.lit(0)))
    got = draws.collect()
    assert collections.Counter((r["doc_id"], r["source"]) for r in got if r["pass"] == 0) == collections.Counter((i, s) for i, _, s in rows)
    tokens, spent = collections.Counter(), collections.Counter()
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    for r in got:
        spent[r["source"]] += r["n_tokens"]
    plan = mixing.plan(tokens)
    for s, q in plan.quotas.items():
        assert q - 30 < spent[s] <= q, s
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert all(r["reached"] == (r["entropy"] >= 0.98 * math.log(len(plan.weights)) - 1e-9) and r["alpha"] == plan.alpha for r in got)
    check_draws(spark, df, plan, got)
    held = mixing.realise(df.withColumns({"h_": F.lit(1), "id_": F.lit(2), "m": F.create_map(F.lit("a"), F.lit(1))}), draws).collect()
    assert {(r["doc_id"], r["text"]) for r in held} == {(i, t) for i, t, _ in rows}
    assert abs(len(held) - len(got)) <= 1
    assert mixing.mix(df.where("false")).count() == 0
    half = mixing.mix(df, budget=sum(tokens.values()) // 2).collect()
    assert sum(r["n_tokens"] for r in half) <= sum(tokens.values()) // 2 + 1


# --- 9 -------------------------------------------------------------------------------------


def plain_fingerprint(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(0, 60)) for _ in range(120)] + [None, "", " \n", "One", "one", "a b", "X Y Z\x0bq é"] + ["same text here now"] * 4
    texts += [texts[0] + " z", texts[1].upper()]
    got = simhash.near_duplicates(docs(spark, texts).withColumn("fp", F.lit("clash"))).collect()
    fps = [plain_fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == [(i, f"{fps[i]:016x}", find(i)) for i in range(len(texts))]
    kept = simhash.keep_first(docs(spark, texts), similarity=None).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({find(i) for i in range(len(texts))})


@pytest.mark.parametrize("limit", [64, 3])
@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_equal_all_pairs(spark, monkeypatch, limit, bits):
    monkeypatch.setattr(simhash, "PAIRED_CELL", limit)
    rng = random.Random(bits)
    values = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1, 1 << 63}
    for v in list(values)[:25]:
        for _ in range(6):
            for _ in range(rng.randrange(1, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    edges = simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp bigint"), bits)
    parent = {signed(v): signed(v) for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= bits:
            a, b = find(signed(a)), find(signed(b))
            parent[max(a, b)] = min(a, b)
    want = {v: find(v) for v in parent}
    got = {r["node"]: r["root"] for r in common.connected_components(edges).collect()}
    assert {v: got.get(v, v) for v in parent} == want


def test_counts_of_cells_are_not_broadcast(spark, monkeypatch):
    """By file size the fingerprints look short enough, their cells are 33 times as many."""
    plans = {}

    def recorded(df, name, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return common.staged(df, name, **options)

    monkeypatch.setattr(simhash, "staged", recorded)
    base = simhash.near_duplicates(docs(spark, ["one two three four", "one two three four", "five six", None]))
    assert "BroadcastHashJoin" not in plans["cells"] and "BroadcastExchange" not in plans["cells"]
    assert "BroadcastHashJoin [fp" not in base._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["component_id"] for r in base.collect()) == [0, 0, 2, 3]


def test_null_ids_and_repeated_rows(spark):
    rows = [(5, "alpha beta gamma delta", 1), (5, "alpha beta gamma delta", 2), (None, "alpha beta gamma delta", 3), (3, "other words entirely here", 4), (None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, extra int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (3, 3), (None, None)], key=str)
    odd = df.withColumns({"id_": F.lit(1), "gone": F.lit(2), "m": F.create_map(F.lit("a"), "extra")})
    kept = simhash.keep_first(odd)
    assert kept.schema.simpleString() == odd.schema.simpleString()
    assert sorted(r["extra"] for r in kept.collect()) in ([1, 3, 4, 5], [2, 3, 4, 5])


@pytest.mark.parametrize("limit", [1024, 2])
def test_near_copies(spark, monkeypatch, limit):
    monkeypatch.setattr(banding, "BLOCK_MEMBERS", limit)
    rng = random.Random(13)
    texts = [prose(rng, 150) for _ in range(40)]
    for i in range(12):
        for edits in (1, 2, 2):
            w = texts[i].split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
            texts.append(" ".join(w))
    texts += [texts[0], "in " * 300, "in " * 300 + "out " * 90, None, "", "one two"]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a == b or a and b and len(a & b) >= 0.8 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs(spark, texts)).collect()}
    assert all(find(got[i]) == find(i) for i in got)  # no link that does not hold
    assert sum(got[i] == find(i) for i in got) >= 0.95 * len(texts)
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs(spark, texts)).collect()) == sorted(set(got.values()))


def test_copies_in_full_cells_are_found(spark):
    rng = random.Random(29)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(80):  # the same words in another order: one word fingerprint, so one cell
        rng.shuffle(words)
        texts.append(" ".join(words))
    for text in texts[:80]:
        w = text.split()
        texts.append(" ".join(w[:-2] + w[:-3:-1]))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs(spark, texts)).collect()}
    assert got == {i: i % 80 for i in range(160)}


def test_equal_fingerprints_are_no_copies(spark):
    line = "alpha beta gamma delta epsilon zeta eta theta iota\n" * 200
    texts = [line + " ".join(f"own{i}x{j}" for j in range(100)) for i in range(3)]
    assert len({simhash.fingerprint(t) for t in texts}) == 1
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs(spark, [*texts, texts[1].upper()])).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 1}


def test_near_dedup_goes_through_simhash(spark, monkeypatch):
    """Copies within two bits are found where no band is shared, also over a chain, and only if they are alike."""
    monkeypatch.setattr(simhash, "tune_bands", lambda *args, **more: (1, 256))  # a key that all but equal sets share
    rng = random.Random(43)
    texts = []
    for i in range(30):
        words = [f"t{i}w{rng.randrange(10**9)}" for _ in range(300)]
        texts.append(" ".join(words))
        for _ in range(4):
            words = list(words)
            words[rng.randrange(20, 280)] = f"e{rng.randrange(10**9)}"
            texts.append(" ".join(words))
    line = "alpha beta gamma delta epsilon zeta eta theta iota\n" * 200
    texts += [line + " ".join(f"own{i}x{j}" for j in range(100)) for i in range(3)]
    fps, sets = [plain_fingerprint(t) for t in texts], [five(t.lower().split()) for t in texts]
    close = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = [(i, j) for i, j in close if near(sets[i], sets[j])]
    assert len(want) > 20 and len(close) > len(want)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs(spark, texts)).collect()}
    assert all(got[i] == got[j] for i, j in want)
    assert all(got[i] == i for i in range(150, 153)) and all(got[i] >= i - i % 5 for i in got)
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs(spark, texts).selectExpr("*", "'en' lang", "'s' source", "0L n_chars"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_trimmed_extended_and_replaced_copies_are_found(spark):
    rng = random.Random(41)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts, pairs = [], []
    for n in (50, 60, 200, 1000):
        for kind in range(3):
            for _ in range(60):
                words, few = new(n), int((n - 4) * rng.uniform(0.05, 0.19))
                other = words[few:] if kind == 0 else words + new(few) if kind == 1 else list(words)
                for at in rng.sample(range(n), max(1, few // 10)) if kind == 2 else ():
                    other[at] = new(1)[0]
                a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (words, other))
                if len(a & b) >= 0.8 * len(a | b):
                    pairs.append((len(texts), len(texts) + 1))
                texts += [" ".join(words), " ".join(other)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs(spark, texts)).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs) and len(pairs) > 600
    assert all(got[i] >= i - i % 2 for i in got)


@pytest.mark.parametrize("members", [1024, 5])
def test_band_classes_equal_all_pairs(spark, monkeypatch, members):
    """Buckets of any make: links are those of all pairs inside them, however they are cut into blocks."""
    monkeypatch.setattr(banding, "BLOCK_MEMBERS", members)
    rng = random.Random(37)
    base = [[f"b{i}w{j}" for j in range(60)] for i in range(6)]
    texts = []
    for i in range(90):
        w = list(base[i % 6])
        for k in rng.sample(range(60), rng.randrange(4)):
            w[k] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    keys = [[1, 2 + i % 2] if i < 80 else [9, 10] for i in range(90)]
    uniq = spark.createDataFrame([(i, 60, k) for i, k in enumerate(keys)], "h bigint, words bigint, bands array<bigint>")
    bodies = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "h bigint, body binary")
    got = {r["node"]: r["root"] for r in banding.band_classes(uniq, lambda asked: bodies.join(asked, "h"), 0.8).collect()}
    sets = [five(t.split()) for t in texts]
    want = union_find(90, [(i, j) for i, j in itertools.combinations(range(90), 2) if (i < 80) == (j < 80) and near(sets[i], sets[j])])
    assert [got.get(i, i) for i in range(90)] == want


# --- 10 ------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 768, 769, 6144, 6145, 200_000, 1_500_000])
def test_matroska_round_trip(size):
    raw = random.Random(size).randbytes(size)
    payload, line = matroska.features(matroska.mux(matroska.padded(raw)))
    assert payload == raw + b" " * (max(192, -(-size // 192) * 192) - size) and "seekable=1" in line
    media = matroska.parse(matroska.mux(matroska.padded(raw)))
    assert [p.timestamp for p in media.packets] == sorted(p.timestamp for p in media.packets)


@pytest.mark.parametrize("kind", range(4))
def test_lacing(kind):
    rng = random.Random(kind)
    for _ in range(50):
        sizes = [rng.choice([0, 1, 254, 255, 256, 510, 70_000, 3])] if kind == 0 else [7] * 5 if kind == 2 else [rng.choice([0, 1, 254, 255, 256, 510, 9000]) for _ in range(rng.randrange(1, 9))]
        frames = [rng.randbytes(n) for n in sizes]
        data = matroska.lace(frames, kind)
        assert [data[a : a + n] for a, n in matroska.unlace(data, 0, len(data), kind)] == frames


def test_matroska_unknown_sizes_and_errors():
    block = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, b"\x81\x00\x05\x00payload") + matroska.element(0x9B, b"\x01"))
    cluster = b"\x1f\x43\xb6\x75\xff" + matroska.unsigned(matroska.CLUSTER_TIMESTAMP, 100) + block
    segment = b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + matroska.element(0xEC, b"skip me") + cluster
    data = matroska.element(matroska.EBML, b"") + segment
    (packet,) = matroska.parse(data).packets
    assert (packet.timestamp, data[packet.offset : packet.offset + packet.size]) == (105, b"payload")
    for broken in (b"", b"\x00" * 20, data[:-3] + b"", matroska.mux(b" " * 192)[:-5]):
        try:
            matroska.parse(broken)
        except (ValueError, IndexError):
            continue
        assert broken == data[:-3]


def test_matroska_live_clusters_and_laced_times():
    live = lambda ident, body: ident.to_bytes(4, "big") + b"\xff" + body
    block = matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00\x05\x84" + matroska.lace([b"ab", b"cd", b"ef"], matroska.FIXED_LACING))
    clusters = [live(matroska.CLUSTER, matroska.unsigned(matroska.CLUSTER_TIMESTAMP, 100 * i) + block) for i in range(3)]
    cues = matroska.element(matroska.CUES, matroska.element(matroska.CUE_POINT, matroska.unsigned(matroska.CUE_TIME, 0) + matroska.element(matroska.CUE_TRACK_POSITIONS, matroska.unsigned(matroska.CUE_CLUSTER_POSITION, 0))))
    track = matroska.element(matroska.TRACKS, matroska.element(matroska.TRACK_ENTRY, matroska.unsigned(matroska.TRACK_NUMBER, 1) + matroska.unsigned(0x23E383, 20_000_000)))
    one = matroska.element(matroska.EBML, b"") + live(matroska.SEGMENT, track + b"".join(clusters) + cues)
    found = matroska.parse(one + one)
    assert [(p.timestamp, p.cluster) for p in found.packets] == [(100 * (i % 3) + 5 + 20 * k, i) for i in range(6) for k in range(3)]
    assert (found.clusters, len(found.cues)) == (6, 2)
    timed = matroska.parse(matroska.mux(b"x" * 768 * 16))
    assert [p.timestamp for p in timed.packets] == [16 * i for i in range(16)]


def test_media_columns(spark):
    texts = ["short", None, "", "é" * 4000, "same", "same"]
    df = docs(spark, texts)
    got = {r["doc_id"]: r for r in matroska.media_digests(df.withColumn("feature", F.lit(0))).collect()}
    for i, t in enumerate(texts):
        payload = matroska.padded((t or "").encode())
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert tuple(got[4])[1:] == tuple(got[5])[1:] and tuple(got[1])[1:] == tuple(got[2])[1:]
    files = matroska.media_column(df)
    packets = matroska.packet_table(files.unionByName(spark.createDataFrame([(99, bytearray(b"junk")), (98, None)], "doc_id bigint, media binary")))
    joined = packets.join(files, "doc_id").withColumn("part", F.expr("substring(media, byte_offset + 1, byte_size)")).collect()
    for i, t in enumerate(texts):
        assert b"".join(bytes(r["part"]) for r in sorted((r for r in joined if r["doc_id"] == i), key=lambda r: r["packet"])) == matroska.padded((t or "").encode())
    assert [r["error"] is not None for r in packets.where("doc_id >= 98").collect()] == [True]
