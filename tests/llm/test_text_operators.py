"""The text operators against brute force, on small fixtures with nulls, empty texts, copies and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("sparkrelief.llm")
from sparkrelief.llm import ann, bpe, components, langid, merkle, neardup, packing, pii, suffixes, toxicity, urls  # noqa: E402

BASE = "The quick brown fox jumps over the lazy dog near the old river bank while seven grey geese watch it all day long. "
DOCS = [
    (1, BASE * 2), (2, BASE * 2), (3, None), (4, ""), (5, "x"), (6, "Noch ein kurzer Text. " + BASE + "Ende."), (7, BASE[:-30] + "another ending of this sentence here."),
    (8, "mail a.b@c.de_x@y.zz, 10.0.0.255 and 300.1.1.1; 4111 1111 1111 1111; +49 (30) 1234-567"), (9, "é😀 k@x.io" + " 1.2.3.4" * 300), (5, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", "s", 0, "clash") for d, t in DOCS], "doc_id long, text string, lang string, source string, n_chars long, batch string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_suffix_dedup(docs, none):
    first: dict[bytes, int] = {}
    for d, t in DOCS:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], 99), d)
    want = []
    for d, t in DOCS:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        want.append((d, len(b), sum(gone), bytes(x for x, g in zip(b, gone) if not g)))
    got = suffixes.remove_repeats(docs).select("row.doc_id", "n_bytes", "n_removed", "kept").collect()
    assert sorted((r[0], r[1], r[2], bytes(r[3])) for r in got) == sorted(want)
    assert suffixes.without_repeats(docs).columns == docs.columns
    assert suffixes.remove_repeats(none).count() == 0


def _without_repeats(rows):
    """Brute force: id, bytes, removed, spans and what is left of each row; a null id is the largest."""
    big = float("inf")
    first: dict[bytes, float] = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], big), big if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (big if d is None else d):
                gone[i : i + 50] = b"\1" * 50
        out.append((str(d), len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("chunk, hot", [(1 << 18, 4096), (64, 4096), (64, 2), (1 << 18, 1)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, chunk, hot):
    """Shared passages, ids beyond 32 bits, negative, null and repeated, texts longer than a run, hot anchors."""
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(1)
    some = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared = [some(rng.randrange(20, 300)) for _ in range(12)]
    rows = [(rng.choice([i, i + (1 << 32), -i, i << 33]), "".join(rng.choice(shared) if rng.random() < 0.4 else some(rng.randrange(0, 90)) for _ in range(rng.randrange(0, 8)))) for i in range(150)]
    rows += [(None, shared[0] * 2), (7, None), (8, ""), (9, "short"), (10, "a" * 500), (11, "a" * 300), (12, "ab" * 200), rows[5], rows[6]]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r[0].doc_id), r[1], r[2], r[3], bytes(r[4])) for r in got) == _without_repeats(rows)


def test_suffix_dedup_of_short_texts_and_broken_characters(spark):
    """A task of texts under 50 bytes alone; a replacement character of the text itself stays, a character cut in two goes; own columns stay."""
    short = spark.createDataFrame([(1, "short", 9), (2, None, 4)], "doc_id long, text string, n_chars long").coalesce(1)
    assert sorted(tuple(r) for r in suffixes.without_repeats(short).collect()) == [(1, "short", 5), (2, None, 4)]
    # the 50 bytes end inside the two bytes of ü, as ü and ö begin alike
    same = "x" * 49
    rows = [(1, same + "ö|one", "a", True, "b"), (2, "abc \ufffd def " + same + "ü|two", "c", False, "d"), (3, "abc \ufffd def", "e", None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, _null boolean, kept string")
    got = sorted(tuple(r) for r in suffixes.without_repeats(docs).collect())
    assert got == [rows[0], (2, "abc \ufffd def |two", "c", False, "d"), rows[2]]


@pytest.mark.parametrize("seed", range(4))
def test_deep_shallow_sort(seed):
    rng = np.random.default_rng(seed)
    data = bytes(rng.integers(97, 99, 300, dtype=np.uint8)) + b"ab" * 100 + bytes(rng.integers(97, 99, 80, dtype=np.uint8)) * 2
    starts = np.arange(len(data) - 50)
    order, group = suffixes.deep_shallow_sort(data, starts)
    strings = [data[s : s + 50] for s in starts[order]]
    assert strings == sorted(strings)
    assert all((a == b) == (g == h) for a, b, g, h in zip(strings, strings[1:], group, group[1:]))


def test_near_duplicates(docs, none):
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert {(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True)} <= got
    assert neardup.near_duplicates(none).count() == 0
    assert neardup.one_of_each(docs).columns == docs.columns


def _shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("block, part", [(2048, 512), (2, 1)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block, part):
    """Chains of edits around the threshold, a large group of copies, repeated rows, null ids; the small settings cut every key into blocks."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "PART", part)
    rng = np.random.default_rng(5)
    texts = [None, "", " \t\n", "One", "one", "ONE two three"]
    for _ in range(6):
        words = [f"w{x}" for x in rng.integers(0, 400, 90)]
        for _ in range(14):
            texts.append(" ".join(words))
            for at in rng.integers(0, len(words), int(rng.integers(1, 4))):
                words[at] = f"v{rng.integers(0, 10**6)}"
    texts += [BASE + BASE.upper() + "Z"] * 40
    rows = list(enumerate(texts)) + [(8, texts[8])]
    sets = [_shingles(t, 4) for _, t in rows]
    root = {i: i for i, _ in rows}
    for _ in range(30):
        for (i, _), s in zip(rows, sets):
            for (j, _), t in zip(rows, sets):
                if s and t and 100 * len(s & t) >= 80 * len(s | t):
                    root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame([*rows, (None, "one")], "doc_id long, text string")
    got = [tuple(r) for r in neardup.near_duplicates(docs).collect()]
    want = [(i, len(s), root[i], root[i] == i) for (i, _), s in zip(rows, sets)] + [(None, 1, None, True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert 10 < len(set(root.values())) < 60


def test_one_of_each_with_repeated_ids_and_clashing_names(spark):
    rows = [(1, BASE * 2), (2, BASE * 2), (3, None), (3, None), (4, ""), (5, "x"), (5, "x"), (5, "some other text under the id"), (None, "x"), (None, "x")]
    docs = spark.createDataFrame([(d, t, 1, 2, "c") for d, t in rows], "doc_id long, text string, id int, rows int, row string")
    got = neardup.one_of_each(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter({(1, BASE * 2): 1, (3, None): 1, (4, ""): 1, (5, "x"): 1, (5, "some other text under the id"): 1, (None, "x"): 2})
    assert neardup.one_of_each(docs.where("false")).count() == 0


def test_collisions_of_short_hashes_lose_no_link(monkeypatch):
    """Sets of a million shingles, at the threshold, in the last round: some of their short hashes collide, and still the pair goes on."""
    rng = np.random.default_rng(3)
    every = np.unique(rng.integers(0, 1 << 63, 1_112_000, dtype=np.int64).astype(np.uint64))
    n = len(every)
    common, left, right = every[: n * 8 // 10], every[n * 8 // 10 : n * 9 // 10], every[n * 9 // 10 :]
    a, b = np.sort(np.concatenate((common, left))), np.sort(np.concatenate((common, right)))
    while 100 * len(common) < 80 * n:
        common = every[: len(common) + 1]
    short = [np.unique((x >> np.uint64(32)).astype("<u4")) for x in (a, b)]
    assert len(short[0]) < len(a) - 20
    sig = neardup.signature(a)
    mask = int(neardup._first_common((sig == sig)[None])[0])
    rows = [(mask, i, i, len(x), sig.tobytes(), 0, 0, s.tobytes()) for i, (x, s) in enumerate(zip((a, b), short))]
    both = len(np.intersect1d(a, b))
    percent = math.floor(100 * both / (len(a) + len(b) - both))
    assert neardup._block_links(rows, percent) == [(0, 1)]
    exact = 100 * both / (len(a) + len(b) - both)
    assert neardup._block_links(rows, exact) == [(0, 1)]


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x in got} and all(root[x] == x for x in root if x not in got)


def test_signature_index_finds_all_within_distance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, neardup.HASHES).astype("<u2")
    for _ in range(200):
        b = a.copy()
        b[rng.choice(neardup.HASHES, neardup.DISTANCE, replace=False)] ^= 1
        assert (a == b).reshape(neardup.CHUNKS, -1).sum(1).max() >= 3


def test_pii(docs, none):
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]

    want = sorted((d, [(k, m.start(), m.end()) for k, p in base.items() for m in re.finditer(p, t or "") if ok(k, m[0])]) for d, t in DOCS)
    got = sorted((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["base"]]) for r in [x.asDict(True) | {"doc_id": x["row"]["doc_id"]} for x in pii.find(docs).collect()])
    assert got == want
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[3] is None and "<card>" in clean[8] and "4111" not in clean[8] and pii.redact(docs).columns == docs.columns
    assert pii.find(none).count() == 0


def test_em_finds_planted_reliabilities():
    """Labelers with planted rates on hidden truths: EM finds the truths and the rates, and the classifier follows it."""
    rng = np.random.default_rng(2)
    rates = [((0.05, 0.1, 0.85), (0.7, 0.2, 0.1)), ((0.1, 0.0, 0.9), (0.8, 0.0, 0.2)), ((0.0, 0.6, 0.4), (0.0, 0.95, 0.05)), ((0.02, 0.8, 0.18), (0.3, 0.69, 0.01)), ((0.2, 0.0, 0.8), (0.5, 0.0, 0.5))]
    truth = rng.random(20000) < 0.3
    votes = np.stack([np.where(truth, rng.choice([-1, 0, 1], 20000, p=t), rng.choice([-1, 0, 1], 20000, p=f)) for t, f in rates], 1)
    rows, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    patterns = [(tuple(map(int, r)), int(c)) for r, c in zip(rows, counts)]
    prior, found, post = pii.reliabilities(patterns, 200)
    assert prior == pytest.approx(0.3, abs=0.03)
    assert np.abs(np.array(found) - np.array(rates)).max() < 0.05
    # the best that can be told from the votes, with the planted rates
    best = np.array([0.3 * np.prod([t[x + 1] for x, (t, _) in zip(v, rates)]) > 0.7 * np.prod([f[x + 1] for x, (_, f) in zip(v, rates)]) for v, _ in patterns])
    weight = np.array([c for _, c in patterns])
    w = pii._trained(patterns)
    judged = np.array([sum(a * b for a, b in zip(w, pii._features(v))) > 0 for v, _ in patterns])
    assert weight[(np.array(post) > 0.5) == best].sum() > 0.99 * weight.sum() and weight[judged == best].sum() > 0.97 * weight.sum()
    assert (best[back.ravel()] == truth).mean() > 0.93


def test_pii_adds_spans_and_leaves_decoys(spark):
    """Keys, bracketed addresses and unprefixed numbers are added by the classifier; numbers that fail their check are not."""
    rows = [(i, f'mail a{i}@b.com now token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and +1 (212) 555-{1000 + i} or 10.0.{i % 200}.7 card 4111 1111 1111 1111 order 4111 1111 1111 {1112 + 10 * (i % 90)} end') for i in range(120)]
    rows += [(200, "call (212) 555-0199 today"), (201, "host 10[.]1[.]2[.]3 up"), (202, "write joe[at]example[dot]com please"), (203, "see 999.1.2.3 and 123456789 there"), (204, None)]
    got = {r["row"]["doc_id"]: {(s["kind"], rows[min(r["row"]["doc_id"], 120 + r["row"]["doc_id"] - 200 if r["row"]["doc_id"] >= 200 else 10**6)][1][s["start"] : s["end"]]) for s in r["spans"]} for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k, _ in got[7]} == {"email", "secret", "phone", "ip", "card"} and ("card", "4111 1111 1111 1111") in got[7] and len(got[7]) == 5
    assert got[200] == {("phone", "(212) 555-0199")} and got[201] == {("ip", "10[.]1[.]2[.]3")} and got[202] == {("email", "joe[at]example[dot]com")}
    assert got[203] == got[204] == set()


@pytest.mark.parametrize("text", ["", "Hello, it's 42!", "<|endoftext|>a<|startoftext|>", "ΑΣ 日本 é ﬁ İ", "a" * 700, "x\x1cy\x85z", "don't we'll"])
def test_bpe_equals_library(text):
    mine = bpe.loaded(bpe.default_path())
    theirs = mine.library.encode(text, add_special_tokens=False).ids
    assert mine.encode_batch([text])[0] == theirs
    assert mine.decode(theirs) == mine.library.decode(theirs, skip_special_tokens=False)


def test_words_side_by_side_merge_like_one_by_one():
    rng = random.Random(4)
    words = list({"".join(rng.choice("etaoinshrdlu'é😀$9") for _ in range(rng.randrange(1, 70))) for _ in range(3000)}) + ["x" * 3000]
    words = [w for t in words for w in bpe.loaded(bpe.default_path()).pretokens(t)]
    mine = bpe.loaded(bpe.default_path())
    exact = [mine.exact(w) for w in words]
    assert mine.merge_all(words) == [bpe.as_bytes(x) for x in exact] and mine.verified(words) == exact


def test_memory_forgets_but_never_changes_results(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_CACHE", 5)
    mine = bpe.WordBPE(bpe.default_path())
    rng = random.Random(5)
    for _ in range(40):
        texts = [" ".join(f"w{rng.randrange(30)}" for _ in range(8)) for _ in range(3)]
        assert mine.encode_batch(texts) == [mine.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(mine.memory.new) < 40


def test_bpe_frame(docs, none):
    lib = bpe.loaded(bpe.default_path()).library
    got = sorted(tuple(r) for r in bpe.encode_decode(docs).collect())
    ids = [(d, lib.encode(t or "", add_special_tokens=False).ids) for d, t in DOCS]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == sorted((d, len(i), sha(" ".join(map(str, i))), sha(lib.decode(i, skip_special_tokens=False))) for d, i in ids)
    assert bpe.encode_decode(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack(docs, capacity=64).collect()
    lib = bpe.loaded(bpe.default_path()).library
    seqs: dict[int, list] = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    assert sum(r["length"] for r in rows) == sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in DOCS)
    want = []
    for d, t in DOCS:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(d, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_plan_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    h = {int(s): int(n) for s, n in zip(*np.unique(np.minimum(4000, rng.lognormal(6, 1, 20000).astype(int) + 1), return_counts=True))}
    made = packing.plan(h)
    back: dict[int, int] = {}
    for lengths, n in made:
        assert sum(lengths) <= packing.CAPACITY
        for s in lengths:
            back[s] = back.get(s, 0) + n
    assert back == h and sum(n for _, n in made) <= 1.03 * sum(s * n for s, n in h.items()) / packing.CAPACITY + 1


def _tree(text, leaf):
    """Brute force of a fingerprint: leaves, and the text of the tree over them; ``leaf`` and the paragraphs' marks come from Spark's hash."""
    paragraphs = [re.split("(?<=[.!?]) ", p) for p in text.split("\n")]
    marked = "".join(",".join(f"{leaf[s] % 2**64:016x}" for s in p) + ("/" if leaf[tuple(p)] % merkle.SECTION == 0 else ";") for p in paragraphs)
    sections = marked.split("/")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    shown = [sha(x)[:16] + "=" + re.sub("([0-9a-f]{8})[0-9a-f]{8}", r"\1", x) for x in sections]
    return {leaf[s] for p in paragraphs for s in p}, sha("/".join(map(sha, sections))) + ":" + "/".join(shown)


def test_fingerprints(spark, docs, none):
    """Every column against brute force."""
    rows = sorted(DOCS, key=lambda r: (r[0], r[1] or ""))
    texts = []
    for i, (_, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        h = len(t) // 2
        texts.append((t, t[: len(t) - h] + nxt[:h], nxt))
    split = [[re.split("(?<=[.!?]) ", p) for p in x.split("\n")] for t in texts for x in t]
    leaves = sorted({s for x in split for p in x for s in p})
    leaf = {r.s: r.h for r in spark.createDataFrame([(s,) for s in leaves], "s string").selectExpr("s", "xxhash64(s) h").collect()}
    groups = sorted({tuple(p) for x in split for p in x})
    leaf |= {g: r.h for g, r in zip(groups, spark.createDataFrame([(i, [leaf[s] for s in g]) for i, g in enumerate(groups)], "i int, a array<bigint>").selectExpr("i", "xxhash64(a) h").orderBy("i").collect())}
    alike = lambda a, b: 2 * len(a & b) / (len(a) + len(b))
    want = []
    for (d, _), (t, edited, nxt) in zip(rows, texts):
        (own, mark), (new, edited_mark), (other, _) = _tree(t, leaf), _tree(edited, leaf), _tree(nxt, leaf)
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), mark, edited_mark, alike(own, new), alike(own, other)))
    got = merkle.fingerprints(docs).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    print_of = {r["doc_id"]: r["fingerprint"] for r in got}
    assert print_of[1] == print_of[2] != print_of[6] and merkle.fingerprints(none).count() == 0
    alone = merkle.fingerprints(docs.where("doc_id = 6")).first()
    assert alone.near_next == 1.0


def test_differing_sections_locate_an_edit(spark):
    lines = [f"Paragraph {i} has one sentence. And another one." for i in range(60)]
    edited = [*lines[:30], "This one was changed.", *lines[31:]]
    t = spark.createDataFrame([("\n".join(lines), "\n".join(edited))], "a string, b string")
    mark = lambda c: merkle.fingerprint(merkle.leaves(merkle.F.col(c)))
    row = t.select(merkle.differing_sections(mark("a"), mark("b")).alias("d"), merkle.differing_sections(mark("a"), mark("a")).alias("none"), mark("a").alias("m")).first()
    assert row.none == [] and 1 <= len(row.d) <= 2 < len(row.m.split("/"))


def test_urls(spark):
    rows = [(1, "http://A.com/en/1", None), (2, "https://www.example.com/en/77?x", ""), (3, None, None), (4, "no scheme", ""), (5, "ftp://x.net/de/1#a", '<a href="http://a.com/x">'), (6, "http://example.net/de/80", ""), (6, "http://notcom/en/", "")]
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got[0] == (1, "a.com", "/en/1", "com/en/", "block") and got[1][3:] == ("example.com/en/7", "allow")
    assert got[2] == (3, "", "", None, "allow") and got[3][1:4] == ("", "", None) and got[4][3] == "net/de/"
    assert {g[3] for g in got[5:]} == {"example.net/de/8", None}
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("part", [4096, 2])
def test_host_scores_equal_brute_force_pagerank(spark, monkeypatch, part):
    """Scores and verdicts against a linear solve: hosts linked both ways with seeds of both kinds, and a chain of 12 links to a blocked host; the small part cuts hubs."""
    monkeypatch.setattr(urls, "PART", part)
    pages = [(f"a{i}.sub.net", "/de/" if i % 3 else "/x/") for i in range(6)] + [("sub.net", "/x/")] + [(f"c{i}.it", "/x/") for i in range(13)] + [("z.org", "/es/")]
    pages += [("p.net", "/de/1"), ("www.p.net", "/y"), ("q.org", "/y"), ("q.org", "/es/1")]
    links = {"c0.it": ["z.org"], **{f"c{i}.it": [f"c{i - 1}.it"] for i in range(1, 13)}, "www.p.net": ["q.org", "q.org"], "sub.net": ["z.org", "c3.it"]}
    rows = [(i, f"http://{h}{p}", "".join(f'<a href="http://{t}/">' for t in links.get(h, []))) for i, (h, p) in enumerate(pages)]
    above = lambda h: [".".join(h.split(".")[i:]) for i in range(h.count("."))]
    hosts = sorted({x for h, _ in pages for x in above(h)} | {x for ts in links.values() for t in ts for x in above(t)})
    n = {h: i for i, h in enumerate(hosts)}
    w = np.zeros((len(hosts), len(hosts)))
    for h, _ in pages:
        for t in links.get(h, []):
            w[n[h], n[t]] += 1
    for h in hosts:
        up = h.partition(".")[2]
        if up in n:
            w[n[h], n[up]] += 1
            w[n[up], n[h]] += 1
    seed = {"allow": np.zeros(len(hosts)), "block": np.zeros(len(hosts))}
    rule = lambda h, p: "allow" if h.endswith("net") and p.startswith("/de/") else "block" if h.endswith("org") and p.startswith("/es/") else None
    for h, p in pages:
        if r := rule(h, p):
            seed[r][n[h]] += 1 / sum(x == h for x, _ in pages)

    def solved(w, s):
        total = w.sum(1, keepdims=True)
        return np.linalg.solve(np.eye(len(hosts)) - urls.DAMPING * np.divide(w, total, out=np.zeros_like(w), where=total > 0).T, (1 - urls.DAMPING) * s)

    trust, distrust = solved(w, seed["allow"]), solved(w.T, seed["block"])
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    host, path = urls.host_path(urls.F.col("url"))
    hosted = frame.select("html", host.alias("host"), path.alias("path"))
    judged = hosted.select("host", urls.longest_rule(urls.F.col("host"), urls.F.col("path"))[1].alias("rule_verdict"))
    assert urls._edges(hosted.select("host", "html")).count() > 20
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.host_scores(judged, urls._edges(hosted.select("host", "html"))).collect()}
    for h in hosts:
        assert got.get(h, (0, 0)) == pytest.approx((trust[n[h]], distrust[n[h]]), abs=1e-6), h
    assert distrust[n["c10.it"]] > 0
    want = {i: rule(h, p) or ("block" if distrust[n[h]] > max(trust[n[h]], urls.THRESHOLD) else "allow") for i, (h, p) in enumerate(pages)}
    assert {r["page_id"]: r["verdict"] for r in urls.judge_urls(frame).collect()} == want and len(set(want.values())) == 2


def test_links_of_pages(spark):
    """Absolute addresses and those without a scheme are edges, relative ones are not; parents without pages are nodes."""
    html = '<a href="//B.org/x"><img src=/local.png><a href=\'https://c.net:80?q\'><a href="d/e"><script src="//b.org/y">'
    hosted = spark.createDataFrame([("x.a.com", html), ("x.a.com", html), ("", html), ("10.0.0.1", None)], "host string, html string")
    got = {(r.source, r.target): r.weight for r in urls._edges(hosted).collect()}
    assert got == {("x.a.com", "b.org"): 4.0, ("x.a.com", "c.net:80"): 2.0, ("x.a.com", "a.com"): 1.0, ("a.com", "x.a.com"): 1.0}


def test_an_edge_decides_a_verdict(spark):
    """A host without a rule is blocked because it links to a blocked one, and allowed without that link."""
    pages = [(1, "http://bad.org/es/1"), (2, "http://other.it/x")]
    for link, verdict in (('<a href="//bad.org/">', "block"), ('<a href="/bad.org/">', "allow")):
        frame = spark.createDataFrame([(i, u, link, "clash", i) for i, u in pages], "page_id long, url string, html string, host string, trust long")
        assert {r.page_id: r.verdict for r in urls.judge_urls(frame).collect()} == {1: "block", 2: verdict}


def test_ann_recall(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(600, 16))
    v[500:560] = v[500]
    rows = [(i, [float(x) for x in v[i]]) for i in range(600)] + [(700, None), (800, [0.0] * 16), (900, [float("nan")] * 16)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    hits = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(m[2] == pytest.approx(d[m[1]], abs=1e-12) for m in mine)
        hits += len(set(best) & {m[1] for m in mine})
    assert hits >= 0.9 * 60
    assert {r["query_id"] for r in got} == {0, 100, 200, 300, 400, 500}


def test_ann_is_exact_with_all_leaves(spark, monkeypatch):
    """Parts of buckets, ties, clashing names, vectors of other lengths, an empty table."""
    monkeypatch.setattr(ann, "PART", 8)
    monkeypatch.setattr(ann, "BUCKET", 2)
    rng = np.random.default_rng(6)
    v = rng.integers(-2, 3, (300, 3)).astype(float)
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(1000 + 100 * i, [float(i), 1.0]) for i in range(4)] + [(2000, [1.0, None]), (2100, [])]
    frame = spark.createDataFrame([(i, e, 1, 2, "t") for i, e in rows], "vec_id long, embedding array<double>, id int, q int, tree string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(frame, visits=1.0).collect())
    want = []
    able = [(i, np.array(e)) for i, e in rows if e and None not in e and any(e)]
    for i, e in able:
        if i % 100 == 0:
            near = sorted((float(np.sqrt(np.square(f - e).sum())), j) for j, f in able if j != i and len(f) == len(e))[:10]
            want += [(i, k + 1, j, d) for k, (d, j) in enumerate(near)]
    assert got == sorted(want)
    assert ann.nearest(frame.where("false")).count() == 0 and ann.visits_of(50_000) < ann.visits_of(2_000)


def test_language_id(spark):
    words = {"en": "the and of with house green", "de": "der und mit haus nicht auch"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(words[x].split())), x) for i in range(80) for x in [("en", "de")[i % 2]]]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    test = spark.createDataFrame([(1, "the green house", 1), (2, "haus und der", 2), (3, None, 3), (4, "12 !", 4)], "doc_id long, text string, score int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(test, langid.train(train)).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[3] == got[4] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    assert langid.identify(test, langid.train(train.where("false"))).select("lang_pred").distinct().count() == 1


def test_language_id_equals_plain_backoff(spark):
    """Scores against backoff in plain Python, over every label of more than 64; ties go to the first name."""
    rng = random.Random(8)
    names = [f"l{i:02d}" for i in range(70)]
    vocabulary = {x: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 7))) for _ in range(12)] for x in names}
    rows = [(i, " ".join(rng.choices(vocabulary[x], k=15)), x) for i in range(700) for x in [names[i % 70]]] + [(900, None, "l00"), (901, "ab", None)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 4 != 2 and t and x]
    counts = {x: {0: Counter()} | {n: Counter() for n in range(1, 6)} for x in {x for _, x in learned}}
    for t, x in learned:
        for w in t.split():
            counts[x][0][w] += 1
            for n in range(1, 6):
                counts[x][n].update(langid.grams_of(w, n))

    def cost(x, n, item):
        c = counts[x][n]
        return -math.log10(c[item] / sum(c.values())) if item in c else langid.PENALTY

    def judged(text):
        words = langid.words_of(text)
        if not words:
            return "und", 0.0
        total = dict.fromkeys(sorted(counts), 0.0)
        for w in words:
            known = any(w in c[0] for c in counts.values())
            for x in total:
                if known:
                    total[x] += cost(x, 0, w)
                    continue
                for n in range(min(5, len(w) + 2), 0, -1):
                    grams = langid.grams_of(w, n)
                    if any(g in c[n] for g in grams for c in counts.values()):
                        total[x] += sum(cost(x, n, g) for g in grams) / len(grams)
                        break
                else:
                    total[x] += langid.PENALTY
        mean = {x: s / len(words) for x, s in total.items()}
        best = min(mean, key=mean.get)
        return best, 1 / sum(10 ** (-(m - mean[best]) * len(words) ** langid.EVIDENCE) for m in mean.values())

    texts = [(i, t) for i, t, _ in rows[::9]] + [(2000, "zzz qqq"), (2001, "abab cdcd unknownword"), (2002, ""), (2003, "12 -"), (2004, None), (2000, "zzz qqq")]
    got = langid.identify(spark.createDataFrame(texts, "doc_id long, text string"), langid.train(train)).collect()
    assert len({x for _, x in learned}) == 70
    for r in got:
        want = judged(r.text)
        assert r.lang_pred == want[0] and r.score == pytest.approx(want[1], rel=1e-3, abs=1e-6), r


def test_language_table_is_bounded_for_any_number_of_labels():
    assert langid.table_sizes(4) == (langid.MAX_WORDS, langid.MAX_GRAMS)
    for k in (64, 200):
        words, grams = langid.table_sizes(k)
        assert k * k * (words + langid.MAX_N * grams) <= langid.MAX_TABLE * 1.01 and words >= 20


def test_stages_keep_clashing_columns(spark):
    """Each stage of the pipeline gives back the columns it got, whatever their names."""
    text = "the quick brown fox and the lazy dog went home with mail to a.b@c.de and all was well"
    rows = [(1, text, "en", "s", len(text), 0.25, "mine", "w", "x", "y"), (2, None, "en", "s", 0, 0.5, "mine", "w", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, spans string, _text string, base string")
    for stage in (langid.keep_identified, neardup.one_of_each, suffixes.without_repeats, pii.redact):
        got = {r.doc_id: tuple(r) for r in stage(docs).collect()}
        assert got[1][2:4] + got[1][5:] == rows[0][2:4] + rows[0][5:], stage
        assert stage(docs).columns == docs.columns and stage(docs.where("false")).count() == 0
    red = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert "<email>" in red[1].text and red[1].n_chars == len(red[1].text) and red[2].text is None


def test_toxicity(spark):
    rows = [(i, ("you awful troll " if i % 3 == 0 else "a kind word ") + f"w{i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] + [(5, None)], "doc_id long, toxic int")
    got = toxicity.score(docs.union(spark.createDataFrame([(900, None)], docs.schema)), toxicity.train(docs, labels)).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert sum((r["predicted"] == 1) == (r["doc_id"] % 3 == 0) for r in held) >= 0.95 * len(held) and len(got) == 601


def test_toxicity_equals_plain_ftrl(spark):
    """Weights and scores against FTRL-proximal in plain Python; contradicting and missing labels, clashing names, ties, empty texts."""
    words = ["kind", "good", "awful", "troll", "plain", "day", "sun"]
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(words, k=6))) for i in range(400)] + [(500, None), (501, ""), (1, "kind good"), (502, "kind good")]
    marks = [(i, int("awful" in t or "troll" in t)) for i, t in rows[:400]] + [(3, 0), (3, 1), (4, None), (700, 1)]
    docs = spark.createDataFrame([(i, t, 0.1, 7) for i, t in rows], "doc_id long, text string, score double, toxic int")
    labels = spark.createDataFrame([(i, y, 1) for i, y in marks], "doc_id long, toxic int, quality int")
    by_id: dict[int, set] = {}
    for i, y in marks:
        if y is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            by_id.setdefault(i, set()).add(y)
    known = {i: y.pop() for i, y in by_id.items() if len(y) == 1}
    order = {r.doc_id: r.o for r in docs.selectExpr("doc_id", "xxhash64(doc_id, 8) o").collect()}
    sample = sorted([(order[i], i, t) for i, t in rows if i in known], key=lambda r: r[:2])
    z, n = Counter(), Counter()

    def weight(j):
        if abs(z[j]) <= toxicity.L1:
            return 0.0
        return -(z[j] - math.copysign(toxicity.L1, z[j])) / ((toxicity.BETA + math.sqrt(n[j])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for _, i, t in sample:
            f = toxicity.features((t or "").encode()).tolist()
            w = {j: weight(j) for j in f}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - known[i]
            for j in f:
                z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / toxicity.ALPHA * w[j]
                n[j] += g * g
    buckets, weights = toxicity.train(docs, labels)
    assert {j: pytest.approx(w, rel=1e-6) for j, w in zip(buckets.tolist(), weights.tolist())} == {j: weight(j) for j in n if weight(j)}
    got = toxicity.score(docs, (buckets, weights)).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id, r.score)), sorted(rows, key=lambda r: (r[0], 1 / (1 + math.exp(-sum(weight(j) for j in toxicity.features((r[1] or "").encode()).tolist())))))):
        want = 1 / (1 + math.exp(-sum(weight(j) for j in toxicity.features((t or "").encode()).tolist())))
        assert (r.doc_id, r.held_out, r.predicted) == (i, zlib.crc32(str(i).encode()) % 4 == 2, int(r.score >= 0.3)) and r.score == pytest.approx(want, rel=1e-6)
    nothing = docs.where("false")
    assert toxicity.score(nothing, toxicity.train(nothing, labels.where("false"))).count() == 0
