"""The operators against brute force on small fixtures, with nulls, empty and repeated rows, and clashing columns."""

import collections
import hashlib
import itertools
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm import bpe, components, fingerprints, licenses, linededup, minhash, packing, quality, suffixes, toxicity, urls

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [(None, "no id here at all"), (900, None), (901, ""), (902, " \n\t "), (903, "x"), (903, "x")]
SCHEMA = "doc_id long, text string"


def corpus(seed=0, n=120):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 5 == 4:  # a near copy of an earlier text
            words = rows[int(rng.integers(len(rows)))][1].replace("\n", " \n ").split(" ")
            for _ in range(int(rng.integers(0, 6))):
                words[int(rng.integers(len(words)))] = str(rng.choice(WORDS))
            rows.append((i, " ".join(words).replace(" \n ", "\n")))
            continue
        lines = [" ".join(rng.choice(WORDS, size=int(rng.integers(1, 14)))) for _ in range(int(rng.integers(1, 9)))]
        rows.append((i, "\n".join(lines)))
    return rows + ODD


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have names that operators use themselves."""
    return spark.createDataFrame(corpus(), SCHEMA).withColumns({c: F.lit("clash") for c in ("label", "ids", "n", "rep", "rest", "mark", "lang")}).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def test_codec_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    texts = ["", " ", "It's I'LL we've 12½ ⅷ", "ΑΣ ΑΣ. İstanbul é É", "\x1c a\x1fb \x85 　", "<|endoftext|>x<|startoftext|> <|no|>", "a" * 300, "abab" * 60, "你好，世界 🎉🎉", "�\x00", *(t or "" for _, t in corpus())]
    rows = bpe.decode(bpe.encode(spark.createDataFrame(list(enumerate(texts)), SCHEMA), PATH), PATH).collect()
    for r in rows:
        expected = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == expected
        assert r["decoded"] == library.decode(expected, skip_special_tokens=False)


def test_codec_digests_of_odd_rows(spark, docs):
    rows = {r["doc_id"]: r for r in bpe.digests(docs, PATH).collect()}
    assert bpe.digests(docs, PATH).count() == len(corpus())
    assert rows[900]["n_tokens"] == 0 and rows[900]["ids_sha256"] == rows[901]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(empty(spark), PATH).count() == 0


def encoded(codec, texts):
    ids, ends = codec.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_codec_merges_new_words_side_by_side():
    """Words that were never seen cost arrays, not calls of Python for each."""
    rng, library = np.random.default_rng(5), Tokenizer.from_file(PATH)
    words = ["".join(rng.choice(list("abdeginorst"), size=int(rng.integers(1, 30)))) for _ in range(5000)]
    column, codec, calls = pa.array([" ".join(words)]), bpe.Codec(PATH), []
    sys.setprofile(lambda frame, event, arg: calls.append(1) if event == "call" else None)
    try:
        ids, ends = codec.encode(column)
    finally:
        sys.setprofile(None)
    assert len(calls) < 2500 and ends.tolist() == [0, len(ids)]
    assert ids.tolist() == library.encode(" ".join(words), add_special_tokens=False).ids


@pytest.mark.parametrize("kept", [True, False])
def test_codec_equals_the_library_for_drawn_texts(kept, monkeypatch):
    """Words about as long as those that are merged side by side, signs, other scripts; with a full memory, too."""
    for name, n in {"CACHE": 20, "RUN": 7, "PACE": 5}.items() if not kept else ():
        monkeypatch.setattr(bpe, name, n)
    rng, library, codec = np.random.default_rng(6), Tokenizer.from_file(PATH), bpe.Codec(PATH)
    letters, others = list("aaabbeinorstTHE"), list("'!?.,-<|>0123½éßΣİﬁ你好🎉\u0301\x1c\x85\u3000\u00a0\x00S")
    words = ["".join(rng.choice(letters, size=int(rng.integers(1, 12)))) for _ in range(60)] + ["".join(rng.choice(letters[:4], size=n)) for n in (62, 63, 64, 65, 66, 130)] + ["é" * 32, "é" * 33, "<|endoftext|>", "it's", "WE'LL"]
    words += ["".join(rng.choice(letters + others, size=int(rng.integers(1, 9)))) for _ in range(150)]
    texts = ["", *("".join(str(w) + str(rng.choice(["", " ", "\n", "\t ", ".", ", "])) for w in rng.choice(words, size=int(rng.integers(0, 40)))) for _ in range(300))]
    for first in range(0, len(texts), 50):
        part = texts[first : first + 50]
        assert encoded(codec, part) == [library.encode(t, add_special_tokens=False).ids for t in part]
    assert encoded(codec, [None, "", "x"])[:2] == [[], []] and encoded(codec, []) == []
    ids, ends = codec.encode(pa.array(texts[:9]).slice(3, 4))
    assert np.split(ids, ends[1:-1])[2].tolist() == encoded(codec, [texts[5]])[0]


@pytest.mark.parametrize("sums", [True, False])
def test_packing_places_each_id_once(spark, docs, sums):
    long = spark.createDataFrame([(950, "alpha beta gamma " * 5000)], SCHEMA)
    docs = docs.select("doc_id", "text").unionByName(long)
    rows = packing.packed(docs, PATH, 64, sums=sums).collect()
    ids = {}
    for r in bpe.encode(docs, PATH).collect():
        ids.setdefault(r["doc_id"], []).append(np.array([*r["ids"], 1], "<u4"))
    windows = {}
    for r in rows:
        inside = [x[r["start"] : r["start"] + r["length"]] for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"]]
        assert any(zlib.crc32(x.tobytes()) == r["ids_crc32"] if sums else x.tolist() == r["ids"] for x in inside)
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(len(x) for xs in ids.values() for x in xs)
    assert sum(r["length"] for r in rows) == total and len(windows) * 64 < 1.02 * total + 64
    assert packing.packed(empty(spark), PATH).count() == 0


def test_window_count_rises_until_all_fit():
    rng = np.random.default_rng(6)
    for sizes, capacity in ((rng.integers(1, 513, 3000).tolist(), 2048), ([1500] * 5, 2048), ([7], 8), ([], 8)):
        groups = packing.windows(sizes, capacity)
        assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in g) <= capacity for g in groups)
    assert len(packing.windows([1500] * 5, 2048)) == 5


def test_differencing_is_near_equal():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (5, 3), (200, 40), (300, 7)):
        sizes = rng.integers(1, 900, n).tolist()
        groups = packing.difference(sizes, k)
        assert sorted(i for g in groups for i in g) == list(range(n)) and len(groups) == k
        sums = [sum(sizes[i] for i in g) for g in groups]
        assert max(sums) - min(sums) <= max(sizes)


def test_near_duplicates_equal_all_pairs(spark, docs):
    rows = corpus()
    ids = sorted({i for i, _ in rows if i is not None})
    sets = {i: shingle_set(t, 4) for i, t in rows if i is not None}
    lead = {i: i for i in ids}

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            lead[y] = x
    found = minhash.near_duplicates(docs, words=4).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), top(r["doc_id"]), top(r["doc_id"]) == r["doc_id"])
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_in_blocks_and_chains(spark, docs, monkeypatch):
    """Small blocks change nothing; chains whose ends aren't linked to the hub are found link by link."""
    rng = np.random.default_rng(7)
    words, chain = [f"w{i}" for i in range(200)], []
    for i in range(60):
        chain.append((5000 - i if i % 2 else 3000 + i, " ".join(words)))
        for _ in range(1 + i % 3):
            words[int(rng.integers(200))] = f"v{i}"
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(chain, SCHEMA))
    whole = {tuple(r) for r in minhash.near_duplicates(frame, words=4).collect()}
    sets = {i: shingle_set(t, 4) for i, t in chain}
    lead = {i: i for i, _ in chain}
    for _ in chain:
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lead[a] = lead[b] = min(lead[a], lead[b])
    assert {r[0]: r[2] for r in whole if (r[0] or 0) >= 3000} == lead and len(set(lead.values())) < 60
    monkeypatch.setattr(minhash, "BLOCK_SETS", 2)
    assert {tuple(r) for r in minhash.near_duplicates(frame, words=4).collect()} == whole


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(2)
    for size in (1, 3, 60, 900):
        a = rng.integers(0, 1 << 62, size).astype(np.uint64)
        b = np.concatenate([a[: size - size // 4], rng.integers(0, 1 << 62, size // 4).astype(np.uint64)])
        s = minhash.sketch(np.repeat([0, 1], size), np.concatenate([a, b]), 2)
        assert (s != minhash.EMPTY).all()
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        assert (s[0] == s[1]).mean() == pytest.approx(true, abs=0.12)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)] + [(200, i) for i in range(201, 230)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 90 for i in (90, 95, 100)} | {i: 200 for i in range(200, 230)}


def brute_lines(rows, words):
    seen, expected = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = [] if t is None else t.split("\n")
        drop, fresh = set(), set()
        for k in range(len(lines)):
            end, n = k, 0
            while end < len(lines) and n < words:
                n += len(re.findall(r"[^\x20\x09-\x0D]+", lines[end]))
                end += 1
            if n >= words:
                window = tuple(lines[k:end])
                drop |= set(range(k, end)) if window in seen | fresh else set()
                fresh.add(window)
        seen |= fresh
        expected[i] = (None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in drop), len(lines), len(drop))
    return expected


def test_line_dedup_equals_brute_force(spark, docs):
    rng = np.random.default_rng(8)
    few = ["alpha", "", "beta gamma", "delta epsilon zeta", "eta theta iota kappa lambda mu nu xi omicron", " \t"]
    short = [(300 + i, "\n".join(rng.choice(few, size=int(rng.integers(1, 30))))) for i in range(60)] + [(500, "\n" * 3000), (501, "word " * 40_000)]
    rows = corpus() + short
    expected = brute_lines(rows, linededup.WORDS)
    frame = docs.select("doc_id", "text", "label").unionByName(spark.createDataFrame(short, SCHEMA).withColumn("label", F.lit("clash")))
    found = linededup.deduplicated(frame, ["label"]).collect()
    assert len(found) == len(rows)
    assert all((r["text"], r["n_lines"], r["n_removed"]) == expected[r["doc_id"]] and r["rest"]["label"] == "clash" for r in found)
    assert sum(r["n_removed"] for r in found) > 0
    assert linededup.deduplicated(empty(spark)).count() == 0


def brute_bytes(rows, length):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(raw[s : s + length])
        kept = bytes(b for b, g in zip(raw, gone[:-1], strict=True) if not g)
        out[i] = (len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), kept)
    return out


def test_suffix_dedup_equals_brute_force(spark, docs):
    rng = np.random.default_rng(3)
    p = "".join(rng.choice(list("ab"), 400))
    hard = [(1, "a" * 350), (2, "xy" * 120 + p), (3, p[50:300] + "é" * 80), (6, "a" * 99), (7, "q" + "a" * 120 + p * 3), (8, p[:150] + "zz" + p[:150]), *ODD]
    for rows, frame in ((hard, spark.createDataFrame(hard, SCHEMA).repartition(3)), (corpus(), docs)):
        expected = brute_bytes(rows, 100)
        found = suffixes.removed(frame).collect()
        assert len(found) == len(rows)
        assert all((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == expected[r["doc_id"]] for r in found)
        assert sum(r["n_removed"] for r in found) > 0
    assert suffixes.removed(empty(spark)).count() == 0


def test_suffix_dedup_over_small_batches(spark, docs):
    """Buckets that reach over the ends of Arrow batches are settled string by string."""
    expected = brute_bytes(corpus(), 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert all((r["n_removed"], bytes(r["kept"])) == (expected[r["doc_id"]][1], expected[r["doc_id"]][3]) for r in suffixes.removed(docs).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_suffix_contexts_seen_before():
    """Whatever a task's table forgets, the earliest of each context is never called later, and what is called later is."""
    rng = np.random.default_rng(6)
    for size in (1, 8, 1 << 16):
        seen, sent, late, later = suffixes.Seen(size), {}, 0, 0
        rows = [(int(rng.zipf(1.5)) % 50, int(rng.integers(0, 60)), int(rng.integers(0, 5))) for _ in range(3000)]
        for start in range(0, len(rows), 40):
            part = list({r[0]: r for r in rows[start : start + 40]}.values())
            context, doc, a = np.array(part, np.int64).T
            for r, gone in zip(part, seen.later(context.astype(np.uint64) % np.uint64(7), context.astype(np.uint64), doc, a), strict=True):
                assert not gone or min(sent[r[0]]) < r[1:]
                late, later = late + gone, later + (r[0] in sent and min(sent[r[0]]) < r[1:])
                if not gone:
                    sent.setdefault(r[0], []).append(r[1:])
        assert late == later if size == 1 << 16 else late < later  # with room for all every later one is called so


def test_toxicity_on_held_out(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        words = [str(w) + str(rng.choice(["", "a", "or", "ing"])) for w in rng.choice(WORDS, size=int(rng.integers(20, 80)))]
        toxic = int(i % 5 == 0)
        for _ in range(4 * toxic):
            words[int(rng.integers(len(words)))] = "zwack" + str(rng.choice(["en", "ig", "t", ""]))
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, figure int")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    odd = spark.createDataFrame(ODD, SCHEMA)
    found = toxicity.scored(docs.select("doc_id", "text").unionByName(odd), labels).toPandas()
    assert len(found) == 606 and found.score.between(0, 1).all() and ((found.score >= 0.3) == (found.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(int(i)).encode()) % 4 == 2) for i, h in zip(found.doc_id, found.held_out, strict=True) if i == i)
    held = found[found.held_out & (found.doc_id < 600)]
    truth = held.doc_id.astype(int) % 5 == 0
    assert ((held.predicted == 1) == truth).mean() > 0.95
    assert set(toxicity.scored(docs, labels.where("false")).select("score").distinct().toPandas().score) == {0.0}
    assert toxicity.scored(empty(spark), labels).count() == 0
    # a model that is joined rather than sent: the same figures, very long texts, repeated rows and new words too
    more = docs.select("doc_id", "text").unionByName(odd).unionByName(spark.createDataFrame([(700, "zwacken aaaaaaaaaa été " * 60_000), (700, "twice"), (3, rows[3][1])], SCHEMA))
    order = ["doc_id", "words", "mean", "top"]
    sent, joined = (toxicity.scored(more, labels, limit=n).toPandas().sort_values(order, ignore_index=True) for n in (toxicity.LIMIT, 0))
    assert len(joined) == 609 and joined.words.max() == 180_000
    for c in ("score", *toxicity.FIGURES):
        assert np.allclose(sent[c], joined[c], atol=1e-5)
    assert (sent[["words", "predicted", "held_out"]] == joined[["words", "predicted", "held_out"]]).all(axis=None)
    assert toxicity.scored(empty(spark), labels, limit=-1).count() == 0


def test_url_rules(spark):
    cases = {
        "https://a.example.com/en/5": ("a.example.com", "/en/5", "com/en/", "block"), "http://EXAMPLE.com/en/71?x#y": ("example.com", "/en/71", "example.com/en/7", "allow"), "x://net/de/8": ("net", "/de/8", "net/de/", "allow"),
        "x://example.net/de/81": ("example.net", "/de/81", "example.net/de/8", "block"), "x://w.org/es/": ("w.org", "/es/", "org/es/", "block"), "x://forg/es/": ("forg", "/es/", None, "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://h?q=/en/": ("h", "", None, "allow"), "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "rule", "node", "n")})
    for r in urls.judged(pages).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == list(cases.values())[r["page_id"]]
    assert urls.judged(pages.where("false")).count() == 0


def test_url_templates_are_rejected_by_purity(spark):
    rules = [(i, f"http://bad.com/en/{i}") for i in range(30)] + [(100 + i, f"http://good.net/de/{i}") for i in range(30)]
    mixed = [(200 + i, f"http://bad.com/fr/{i}/x") for i in range(10)]
    found = {r["page_id"]: r for r in urls.judged(spark.createDataFrame(rules + mixed, "page_id long, url string")).collect()}
    assert found[0]["template"] == "/en/*" and found[100]["verdict"] == "allow" and found[205]["template"] == "/fr/*/x" and found[205]["verdict"] == "allow"


def test_url_templates_hold_at_every_size(spark):
    paths = [f"http://h.net/u/{i}/p{j}/view/{i}-{j}" for i in range(60) for j in range(7)] + [f"http://h.net/about/{'x/' * 40}{i}" for i in range(4)]

    def found(times):
        pages = spark.createDataFrame([(k, u) for k, u in enumerate(paths * times)], "page_id long, url string")
        return {(r["path"], r["template"], r["verdict"]) for r in urls.judged(pages).collect()}

    once = found(1)
    # ids recur seven times each and stay variable; segments below the third are told apart
    assert {t for p, t, _ in once if p.startswith("/u")} == {f"/u/*/p{j}/view/*" for j in range(7)}
    assert {t for p, t, _ in once if p.startswith("/about")} == {"/*" * 42}
    assert found(5) == once


def test_url_branches_without_labels_take_their_siblings_share(spark):
    rows = [("h", "/*", t, v) for t, v, n in (("/*/a", "block", 20), ("/*/b", "block", 20), ("/*/c", None, 3)) for _ in range(n)]
    rows += [("i", "/*", t, v) for t, v, n in (("/*/a", "block", 20), ("/*/b", "allow", 20), ("/*/c", None, 3)) for _ in range(n)] + [("j", "/*", "/*/c", None)]
    found = {(r["host"], r["template"]): r["rejected"] for r in urls.purity(spark.createDataFrame(rows, "host string, node string, template string, verdict string").withColumn("path", F.lit("/a/1"))).collect()}
    assert [found["h", f"/*/{x}"] for x in "abc"] == [True, True, True]
    assert [found["i", f"/*/{x}"] for x in "abc"] == [True, False, False] and found["j", "/*/c"] is False


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_quality_counts_and_bound(spark, docs):
    texts = dict(corpus())
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    found = quality.judged(docs, labels).collect()
    assert len(found) == len(corpus())
    for r in found:
        n, chars, symbols, dup, inside = brute_quality(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, inside)
        assert r["base_failed"] == (n < 50 or 100 * inside > 50 * n) and r["kept"] == (not r["base_failed"])
    assert quality.at_most(0, 100, 0.03) == pytest.approx(0.97**100)
    assert quality.at_most(2, 5, 0.5) == pytest.approx(0.5)
    assert not quality.certified(0, 10, 0.01, 0.05) and quality.certified(0, 1000, 0.01, 0.05)
    assert quality.judged(empty(spark), labels).count() == 0


def test_quality_cutoffs_hold_the_risk(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(6000):
        bad = i % 4 == 0
        words = [str(w) + ("***" if bad and rng.random() < 0.7 else "") + str(rng.integers(10**6)) for w in rng.choice(WORDS, size=60)]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    found = quality.judged(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")).toPandas()
    bad = found.doc_id % 4 == 0
    assert found.kept[bad].mean() < 0.1 and found.kept[~bad].mean() > 1 - quality.RISK


def test_fingerprints(spark, docs):
    rows = sorted(set(corpus()), key=lambda r: (r[0] is not None, r[0] or 0))
    found = fingerprints.fingerprints(docs).collect()
    assert len(found) == len(corpus())
    by = {(r["doc_id"]): r for r in found}
    texts = [t or "" for _, t in rows]
    for k, (i, _) in enumerate(rows):
        a, b = texts[k], texts[(k + 1) % len(texts)]
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert by[i]["n_chars"] == len(a) and by[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if edited == a:
            assert by[i]["near_edited"] == 1.0 and by[i]["fingerprint"] == by[i]["edited_fingerprint"]
    prints = {}
    for i, t in rows:
        assert prints.setdefault(t or "", by[i]["fingerprint"]) == by[i]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert fingerprints.fingerprints(empty(spark)).count() == 0


def test_fingerprints_hold_every_term_of_the_lexicon(spark):
    """Texts share a fingerprint just if they have the same terms of the lexicon, edited ones included."""
    rows = sorted((i, t) for i, t in corpus(n=60) if i is not None and i < 60) + [(60 + i, f"{WORDS[i]} only{i}") for i in range(10)] + [(80 + i, f"{WORDS[i // 2]}{i // 2} {WORDS[i // 2]}x") for i in range(16)]
    words = [{w for w in re.split(r"[ \t-\r]+", t.lower()) if w} for _, t in rows]
    df = collections.Counter(w for ws in words for w in ws)
    lexicon = {w for w, n in df.items() if 2 <= n <= max(2, fingerprints.HIGH * len(rows))}
    assert len(lexicon) > 10
    by = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    groups = {}
    for k, (i, a) in enumerate(rows):
        b = rows[(k + 1) % len(rows)][1]
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        for t, got in ((a, by[i]["fingerprint"]), (edited, by[i]["edited_fingerprint"])):
            band = frozenset(set(re.split(r"[ \t-\r]+", t.lower())) & lexicon)
            groups.setdefault(band or t, set()).add(got)
            assert (got.count(".") == fingerprints.FAMILIES * fingerprints.LEVELS) == bool(band)
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_licenses_and_inheritance(spark):
    files = [
        ("a/LICENSE", "This work is licensed under the GNU General Public License, version 3."), ("a/b/x.py", "alpha beta"), ("a/b/y.py", "Licensed under the Apache License, Version 2.0.\nalpha beta gamma delta epsilon zeta eta theta iota"),
        ("a/b/c/COPYING", "Released under the MIT License.\n" + "alpha " * 30), ("a/b/c/d/z", None), ("e/f", ""), (None, "All rights reserved."), ("g", "the version of the work is 2.0"),
    ]
    found = {r["path"]: r for r in licenses.scanned(spark.createDataFrame(files, "path string, text string").withColumn("own", F.lit(1))).collect()}
    got = {p: (r["own"], r["license"], r["from_directory"]) for p, r in found.items()}
    assert got == {
        "a/LICENSE": ("GPL-3.0", "GPL-3.0", None), "a/b/x.py": (None, "GPL-3.0", "a"), "a/b/y.py": ("Apache-2.0", "Apache-2.0", None), "a/b/c/COPYING": ("MIT", "MIT", None),
        "a/b/c/d/z": (None, "MIT", "a/b/c"), "e/f": (None, None, None), None: ("Proprietary", "Proprietary", None), "g": (None, None, None),
    }
    assert licenses.scanned(spark.createDataFrame([], "path string, text string")).count() == 0


def test_common_licenses_and_whole_texts(spark):
    """A notice that a third of many files has, and a license file of the license's text alone."""
    files = [(f"p{i % 10}/{i}", "alpha beta\nLicensed under the Apache License, Version 2.0.\ngamma" if i % 3 == 0 else f"all of the work is alpha {i}") for i in range(300)]
    mit = re.sub("(?s)^.*?(?=Permission)", "Copyright (c) 1999 Somebody Else\n\n", licenses.WHOLE["MIT"][0])
    files += [("q/LICENSE", mit), ("q/x", "alpha beta"), ("r/text", licenses.WHOLE["GPL-2.0"][0]), ("r/y", "alpha beta")]
    got = {r["path"]: (r["own"], r["license"], r["license_file"]) for r in licenses.scanned(spark.createDataFrame(files, "path string, text string")).collect()}
    assert all(got[p][0] == ("Apache-2.0" if "Apache" in t else None) for p, t in files[:300])
    assert got["q/LICENSE"] == ("MIT", "MIT", True) and got["q/x"] == (None, "MIT", False)
    assert got["r/text"] == ("GPL-2.0", "GPL-2.0", True) and got["r/y"] == (None, "GPL-2.0", False)


def test_large_buckets_come_in_parts(spark):
    rng = np.random.default_rng(3)
    noise = lambda n: "".join(rng.choice(list("abcdefgh "), size=n))
    common, sides = noise(70), [noise(90) for _ in range(8)]
    rows = [(i, sides[rng.integers(8)][-int(rng.integers(20, 90)) :] + common + sides[rng.integers(8)][: int(rng.integers(20, 90))] + noise(40)) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)

    def gone(part):
        return {(r["doc_id"], x) for r in suffixes.repeated(docs, part=part).collect() for x in range(r["start"], r["end"])}

    seen, wanted = set(), set()
    for i, t in rows:
        for x in range(len(t) - suffixes.LENGTH + 1):
            part = t[x : x + suffixes.LENGTH]
            if part in seen:
                wanted |= {(i, y) for y in range(x, x + suffixes.LENGTH)}
            seen.add(part)
    assert wanted and gone(10_000) == gone(7) == gone(1) == wanted
