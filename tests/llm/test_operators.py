"""The ten operators against brute force, on a table of hard cases."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from brindle.llm import decontam, kneserney, packing, quality, sharding, simhash, spans, sql, suffix, toxicity, urls

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, removed string, ratio double, _words int, row long, kept string"
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def texts():
    rnd = random.Random(3)
    letters = "abcdefgh é\n"
    base = ["".join(rnd.choice(letters) for _ in range(1200)) for _ in range(4)]
    vocabulary = ["alpha", "beta", "Gamma", "delta.", "epsilon", "zeta!", "eta", "theta.", "iota", "kappa"]
    out = [None, "", " \n\t ", "one", "two words", "don't WE'LL  x\n\n y  ", "日本語 текст ١٢٣ ñandú", "a " * 30_000, "same line\nsame line\nother " * 40]
    for i in range(60):
        b = list(rnd.choice(base))
        for _ in range(rnd.randrange(3)):
            b[rnd.randrange(len(b))] = rnd.choice(letters)
        out.append("".join(b))
        out.append(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 200))))
    return out + out[9:14]


@pytest.fixture(scope="module")
def rows():
    own = []
    for i, t in enumerate(texts()):
        doc_id = None if i % 31 == 7 else i - i % 41 if i % 41 == 1 else i
        own.append((doc_id, t, ("en", "fr", None)[i % 3], ("hot", "hot", "cold", None)[i % 4], len(t or ""), "x", 0.5, 1, i, "k"))
    return own + own[20:23]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_repeats(all_bytes, length):
    seen = Counter(t[i : i + length] for t in all_bytes for i in range(len(t) - length + 1))
    for t in all_bytes:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        yield gone


@pytest.mark.parametrize("limit", [1000, 2])
def test_suffix(docs, rows, limit):
    want = Counter()
    raw = [(r[1] or "").encode() for r in rows]
    for r, t, gone in zip(rows, raw, brute_repeats(raw, 400), strict=True):
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        want[r[0], len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(left).hexdigest()] += 1
    got = suffix.with_digests(suffix.remove_repeats(docs, 400, limit)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_maximal_repeats():
    a, b = b"0123456789abcdef", b"xx0123456789abcdefyy"
    found = list(suffix.repeat_groups([a, b, b"--3456789abcde--"], [16, 20, 16], 8))
    sizes = {size: sorted(zip(n.tolist(), p.tolist(), strict=True)) for size, n, p in found}
    assert sizes == {16: [(0, 0), (1, 2)], 12: [(0, 3), (1, 5), (2, 2)]}


def test_suffix_trim(docs, rows):
    out = suffix.trim_documents(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    short = {r.doc_id: r.text for r in out.where("n_chars < 300").collect()}
    assert short[3] == "one"


def test_suffix_trim_cuts_passages_only(spark):
    rnd = random.Random(11)
    own = lambda n: " ".join("".join(rnd.choice("abcdefghé\ufffd") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    passage, line, mark = own(55), own(20), "\u00e9" * 300
    texts = [f"{own(60)} {passage} {own(60)}", f"{own(9)} {passage} {own(80)}", f"{own(60)} {line} {own(60)}", f"{own(30)} {line}", f"{own(40)}X{mark}Y{own(40)}", f"{own(30)}\u00e8{mark}\u00e8{own(30)}", own(70)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix.trim_documents(df).collect()}
    assert all(got[i] == texts[i] for i in (2, 3, 6))
    for i in (0, 1):
        left = texts[i].replace(passage, "")
        assert passage not in got[i] and len(left) - 4 <= len(got[i]) <= len(left)
        assert got[i].count("\ufffd") >= left.count("\ufffd") - 2
    assert got[4].count("\u00e9") == texts[4].replace(mark, "").count("\u00e9") and "XY" in got[4]
    assert got[5].count("\u00e8") == 1  # the first byte of the second is part of a repeat


def test_suffix_trim_takes_whole_characters():
    text = "a\ufffdéb".encode()  # a, 3 bytes, 2 bytes, b
    assert suffix.passages(text, [[2, 5]], 1, 1) == [[1, 6]]
    assert suffix.passages(text, [[0, 1], [2, 3]], 1, 1) == [[0, 4]]
    assert suffix.passages(text, [[0, 1]], 2, 2) == []


def brute_print(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints):
    forest = simhash.Forest(len(prints))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                forest.join(i, j)
    return [forest.root(i) for i in range(len(prints))]


def test_simhash(docs, rows):
    prints = [brute_print(r[1]) for r in rows]
    least = defaultdict(lambda: None)
    roots = brute_components(prints)
    for r, c in zip(rows, roots, strict=True):
        if r[0] is not None and (least[c] is None or r[0] < least[c]):
            least[c] = r[0]
    want = Counter((r[0], f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, roots, strict=True))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def brute_wide(text, width=5):
    """Bit after bit: the shingles' hashes, mixed for each of six words."""
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    out, full = 0, (1 << 64) - 1
    for k in range(6):
        mixed = []
        for x in h:
            x = (x + (2 * k + 1) * 0x9E3779B97F4A7C15) & full
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
            x = (x ^ x >> 27) * 0x94D049BB133111EB & full
            mixed.append(x ^ x >> 31)
        out |= sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(h)) << 64 * k
    return out


def brute_kept(keys, texts, limit=66):
    """Keys of the first of each component: links at ``limit`` bits that share a segment but for 2 bits."""
    prints = [brute_wide(t) for t in texts]
    forest = simhash.Forest(len(prints))
    for i, a in enumerate(prints):
        for j in range(i):
            x = a ^ prints[j]
            if x.bit_count() <= limit and any((x >> 28 * k & (1 << 28) - 1).bit_count() <= 2 for k in range(13)):
                forest.join(i, j)
    best = {}
    for i, k in enumerate(keys):
        r = forest.root(i)
        best[r] = min(best.get(r, (True, 0)), (k is None, k or 0))
    return Counter(None if n else k for n, k in best.values())


def edited(rnd, text, share):
    return " ".join(rnd.choice(["new", "other", "word", "x"]) if rnd.random() < share else w for w in text.split())


def test_keep_one(spark, docs, rows):
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == brute_kept([r[0] for r in rows], [r[1] for r in rows])
    rnd = random.Random(21)
    base = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([6, 40, 150, 400]))) for _ in range(60)]
    own = base + [edited(rnd, t, rnd.choice([0, 0.01, 0.02, 0.04])) for t in base * 4] + [base[0]] * 5 + ["", None, "a b"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(own)] + [(3, own[3], "x")], "doc_id long, text string, w0 string")
    got = simhash.keep_one(df.repartition(6))
    assert Counter(r.doc_id for r in got.collect()) == brute_kept([*range(len(own)), 3], [*own, own[3]])
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_keep_one_joins_similar_texts():
    """Pairs of five-word similarity 0.8 or more are linked: by segments and limit, over random edits."""
    rnd, met, all_ = random.Random(33), 0, 0
    for _ in range(400):
        a = [f"w{rnd.randrange(9000)}" for _ in range(300)]
        b = edited(rnd, " ".join(a), 0.02).split()
        x, y = (set(zip(*(t[k:] for k in range(5)), strict=False)) for t in (a, b))
        if len(x & y) < 0.8 * len(x | y):
            continue
        p, q = (simhash.wide_fingerprint(" ".join(t).encode())[None, :] for t in (a, b))
        near = np.bitwise_count(simhash._segments(p.copy()) ^ simhash._segments(q.copy())).min() <= 2
        all_ += 1
        met += bool(near and np.bitwise_count(p ^ q).sum() <= 66)
    assert all_ > 100 and met >= 0.9 * all_


def test_spanning_links_connect_what_is_near():
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 2**63, (30, 6), dtype=np.uint64)
    rows = np.concatenate([base ^ (np.uint64(1) << rnd.integers(0, 64, base.shape).astype(np.uint64)) for _ in range(20)])
    rows = rows[rnd.permutation(len(rows))]
    forest, want = simhash.Forest(len(rows)), simhash.Forest(len(rows))
    links = simhash.spanning_links(np.arange(len(rows)), rows, 12)
    assert all(forest.join(a, b) for a, b in links)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(rows ^ rows[i]).sum(axis=1) <= 12).tolist():
            want.join(i, j)
    assert [forest.root(i) for i in range(len(rows))] == [want.root(i) for i in range(len(rows))]


def test_fingerprint_links(spark):
    rnd = random.Random(8)
    prints = [rnd.getrandbits(64) for _ in range(40)]
    for p in prints[:20]:
        for _ in range(6):
            q = p
            for _ in range(rnd.randrange(1, 5)):
                q ^= 1 << rnd.randrange(64)
            prints.append(q)
    prints = list(dict.fromkeys(prints))
    signed = [(p - (1 << 64) * (p >> 63),) for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fingerprint long"))
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for (s,), c in zip(signed, brute_components(prints), strict=True):
        got[roots.get(s, s)].add(s)
        want[c].add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_balls_and_blocks_agree():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**32, 30, dtype=np.uint64)
    near = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rnd.integers(0, 32, 30).astype(np.uint64))]))
    pairs: list = []
    forest = simhash.Forest(len(near))
    simhash._balls(near, len(near), 3, lambda a, b: pairs.extend(forest.join(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True)))
    assert sum(pairs) == len(simhash.bucket_links(near, near[:0], 3))


def test_chain_of_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in simhash.components(chain).collect()} == {0}


def test_urls(spark):
    pages = [
        (1, "https://Sub.ORG/x?y", "h"), (2, "http://a.example.org/es/1", None), (3, "http://example.org/en/19#z", ""), (4, "x://example.org/en/2", "q"),
        (5, "http://b.com/fr/", "h"), (6, "http://b.com/de/?q", "h"), (7, None, "h"), (8, "no scheme", "h"), (9, "http://other.net", "h"),
        (10, "http://notorg/x", "h"), (11, "http://org", "h"), (9, "http://other.net", "h"), (None, "a\n://b.net/c\nd?e", "h"), (12, "http://x.com/deep", "h"),
    ]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, verdict string")
    got = {r.page_id: r for r in urls.filter_urls(df).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("sub.org", "/x", "org/", "allow")
    assert [got[i].rule for i in (2, 3, 4, 5, 6)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/"]
    assert [got[i].verdict for i in (2, 3, 4, 5, 6)] == ["block", "block", "allow", "allow", "block"]
    assert [(got[i].host, got[i].path, got[i].rule) for i in (7, 8, 9, 10, 11, 12)] == [
        ("", "", None), ("", "", None), ("other.net", "", None), ("notorg", "/x", None), ("org", "", None), ("x.com", "/deep", None)]
    assert (got[None].host, got[None].path) == ("b.net", "/c\nd")
    assert urls.filter_urls(df).count() == len(pages) and urls.filter_urls(df.limit(0)).count() == 0


def brute_verdicts(pages):
    """page → (ratio, verdict): Witten-Bell models over dictionaries, and every threshold of the histogram tried.

    A decided URL is scored by the models of the half that it is not in.
    """
    texts, rules, halves = {}, {}, {}
    for page, url, half in pages:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        texts[page], host = host.lower() + rest[len(host) :], host.lower()
        fits = [(r.text, r.verdict) for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rules[page], halves[page] = max(fits, key=lambda f: len(f[0]), default=(None, None))[1], half
    grams = {}
    for page, t in texts.items():
        seq = "^" * 4 + t + "$"  # neither stands in the URLs; both ends are one character to the operator, told apart by their places
        grams[page] = [seq[i : i + 5].replace("$", "^") for i in range(len(seq) - 4)]
    size = len({g[-1] for p, r in rules.items() if r for g in grams[p]}) + 1

    def model(verdict, held):
        counts = defaultdict(Counter)
        for p, r in rules.items():
            if r == verdict and halves[p] in held:
                for g in grams[p]:
                    for k in range(5):
                        counts[g[4 - k : 4]][g[4]] += 1

        def probability(gram):
            p = 1 / size
            for k in range(5):
                if own := counts.get(gram[4 - k : 4]):
                    p = (own[gram[4]] + len(own) * p) / (sum(own.values()) + len(own))
            return p

        return probability

    models = {held: (model("allow", held), model("block", held)) for held in ((0,), (1,), (0, 1))}
    ratio = {}
    for p, x in grams.items():
        good, bad = models[(0, 1) if rules[p] is None else (1 - halves[p],)]
        ratio[p] = float(np.mean([np.log(good(g)) - np.log(bad(g)) for g in x]))
    bins = {p: min(max(int(np.floor((x + 4) * 128)), 0), 1023) for p, x in ratio.items()}
    share = lambda v, at: np.mean([bins[p] < at for p, r in rules.items() if r == v])
    good = [share("block", at) + 1 - share("allow", at) for at in range(1025)]
    best = [at for at, x in enumerate(good) if x >= max(good) - 1e-12]
    threshold = best[len(best) // 2] / 128 - 4
    return {p: (ratio[p], r or ("allow" if ratio[p] >= threshold else "block")) for p, r in rules.items()}


def test_url_verdicts(spark):
    rnd = random.Random(14)
    words_ = ["news", "casino", "garden", "win", "read", "Ünï", "7up"]
    hosts = ["site.org", "a.b.com", "example.org", "shop.net", "x.io"]
    pages = [(i, f"http://{rnd.choice(hosts)}/{rnd.choice(['en', 'fr', 'de', 'es'])}/{rnd.choice(words_)}-{rnd.randrange(30)}?q={i}") for i in range(90)]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    subjects = spark.createDataFrame(pages, "page_id long, url string").selectExpr("page_id", "url", "substring(url, 8) AS s")
    halves = {r.page_id: r.half for r in subjects.selectExpr("page_id", "pmod(xxhash64(s), 2) AS half").collect()}
    want = brute_verdicts([(p, url, halves[p]) for p, url in pages])
    assert {"allow", "block"} <= {got[p].verdict for p, _ in pages if got[p].rule is None}
    assert np.allclose([got[p].ratio for p, _ in pages], [want[p][0] for p, _ in pages], atol=1e-4)
    assert [got[p].verdict for p, _ in pages] == [want[p][1] for p, _ in pages]


def test_packing_loses_no_id(spark):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    whole = tokenizers.Tokenizer.from_file(path)
    rnd = random.Random(15)
    own = [" ".join(rnd.choice(["alpha", "be", "gam ma", "é", "12"]) for _ in range(rnd.choice([0, 3, 70, 400, 3000]))) for _ in range(120)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(3), path).collect()
    for i, t in enumerate(own):
        pieces = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == i)
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        assert b"".join(x for _, x in pieces) == ids.tobytes() and {r.doc_tokens for r in rows if r.doc_id == i} == {len(ids)}
        assert [a for a, _ in pieces] == np.cumsum([0, *(len(x) // 4 for _, x in pieces)])[:-1].tolist()


def test_packing(docs, rows):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    whole = tokenizers.Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    got = packing.pack(docs, path).collect()
    by_bin, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        by_bin[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    tokens = padding = 0
    for own in by_bin.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
        tokens += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 5 * 1024 + 0.01 * tokens
    want = Counter()
    for r in rows:
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids + [0]
        at = 0
        for size in packing.cuts(len(ids), 1024, 64):
            want[r[0], len(ids), at, np.array(ids[at : at + size], dtype="<u4").tobytes()] += 1
            at += size
    assert Counter((r.doc_id, r.doc_tokens, r.start, bytes(r.ids)) for r in got) == want
    crc = packing.with_digests(packing.pack(docs, path)).where("doc_id = 3").first()
    assert crc.ids_crc32 == zlib.crc32(np.array([*whole.encode("one", add_special_tokens=False).ids, 0], dtype="<u4").tobytes())


def test_encoder_splits_as_the_tokenizer():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    whole = tokenizers.Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    rnd = random.Random(4)
    odd = ["", "'s", " 's", "x''s", "'sabc don't 'LL a'll've", "a  b \n\n c\t\td  ", "<|endoftext|>", "é́ ½ ٣x", "  "]
    odd += ["".join(rnd.choice("a s'tre1  \n.é") for _ in range(60)) for _ in range(300)]
    ids, ends = packing.Encoder(path)(odd)
    at = 0
    for text, end in zip(odd, ends, strict=True):
        assert ids[at:end].tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0], text
        at = end


def test_encoder_tells_words_of_one_hash_apart():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    whole = tokenizers.Tokenizer.from_file(path)
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))  # equal under any polynomial modulo 2^64
    want = [[*whole.encode(t, add_special_tokens=False).ids, 0] for t in (one, two)]
    assert want[0] != want[1]
    for batches in ([[one, two, one]], [[one], [two], [one]], [[two, "x"], [one, two]]):
        encode = packing.Encoder(path)
        for texts in batches:
            ids, ends = encode(texts)
            at = 0
            for text, end in zip(texts, ends.tolist(), strict=True):
                assert ids[at:end].tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0]
                at = end


def test_packing_gives_added_tokens_their_ids(spark):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    whole = tokenizers.Tokenizer.from_file(path)
    mark = "<|endoftext|>"
    odd = [f"a{mark}b", f"  {mark} 's", mark * 2, mark[:-1], f"it's {mark}'s \n {mark}\n\n x", f"<|{mark}|>", "plain", None]
    rnd = random.Random(5)
    odd += ["".join(rnd.choice(["a", " ", "'s", "\n", "1", ".", "é", mark]) for _ in range(40)) for _ in range(200)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), path, capacity=4096, shortest=4096).collect()
    assert {r.doc_id: np.frombuffer(r.ids, dtype="<u4").tolist() for r in rows} == {
        i: [*whole.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(odd)
    }


def test_quality(docs, rows):
    want = Counter()
    for r in rows:
        t, w = r[1] or "", words(r[1])
        grams = list(zip(w, w[1:], w[2:], strict=False))
        seen, cover = Counter(grams), set()
        for i, g in enumerate(grams):
            if seen[g] > 1:
                cover |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        want[r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), failed] += 1
    got = quality.judge(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.filter_documents(docs).count() == sum(r.kept for r in got)


def test_quality_thresholds_follow_the_group(spark):
    rnd = random.Random(2)
    plain = [" ".join(f"w{rnd.randrange(900)}" for _ in range(80)) for _ in range(300)]
    rows = [(i, t, "en", "src") for i, t in enumerate(plain)] + [(1000, "% ".join(plain[0].split()) + " %%", "en", "src")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(1000) and all(got.values())


def test_decontamination(spark, docs, rows):
    items = [("10", " ".join(words(rows[10][1])[2:30])), ("9", "one"), ("b", None), ("c", "..."), (None, "TWO words"), ("d", rows[12][1][:200])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, t in items:
        w = split(t)
        for i in range(max(1, len(w) - 7) if w else 0):
            windows[tuple(w[i : i + 8])].add(item or "")
    want = Counter()
    for r in rows:
        w, hit, found = split(r[1]), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        want[r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2] += 1
    for block in (8 << 20, 60):
        got = decontam.with_digests(decontam.find_contamination(docs, bench, block_bytes=block)).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert decontam.find_contamination(docs, bench.limit(0)).where("size(items) > 0").count() == 0
    clean = {r.doc_id: r.text for r in decontam.clean_documents(docs.where("doc_id < 9"), bench).collect()}
    assert clean[3] == "" and clean[2] == " \n\t " and clean[0] is None and clean[4] == ""


def test_decontamination_keeps_columns_of_any_name(spark):
    passage = "one two three four five six seven eight nine"
    texts = [passage, f"x {passage}", "one two three four five other words", None]
    names = ["doc_id", "text", "a.b", "_row", "_ROW2", "_places", "_marks", "_key", "row", "h", "at", "items", "window"]
    own = spark.createDataFrame([(i, t, *(f"{i}{n}" for n in names[2:])) for i, t in enumerate(texts)], names)
    bench = spark.createDataFrame([("p", passage), ("p", passage), ("q", "seven eight nine")], "item_id string, text string")
    for block in (64 << 20, 8):
        got = {r.doc_id: r for r in decontam.find_contamination(own, bench, block_bytes=block).collect()}
        assert [got[i]["items"] for i in range(4)] == [["p", "q"], ["p", "q"], [], []]
        assert [[list(x) for x in got[i].hit_runs] for i in range(4)] == [[[0, 9]], [[1, 10]], [], []]
        assert all(got[i][n] == f"{i}{n}" for i in range(4) for n in names[2:] if n != "items")
    assert decontam.clean_documents(own, bench).columns == names


def test_decontamination_blocks_over_large_batches(spark):
    items = [(str(i), f"item {i} has these very words of its own") for i in range(3)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = [" x ".join(items[j][1] for j in range(3) if i % 7 & 1 << j) for i in range(1300)]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    own = own.unionByName(own.limit(0))
    got = {r.doc_id: r for r in decontam.find_contamination(own, bench, block_bytes=50).collect()}
    assert len(got) == 1300
    for i, r in got.items():
        assert r.text == texts[i] and r.items == [str(j) for j in range(3) if i % 7 & 1 << j]
        assert [list(x) for x in r.hit_runs] == [[10 * k, 10 * k + 9] for k in range(len(r.items))]


def test_sql_agrees(spark, docs, rows):
    duckdb = pytest.importorskip("duckdb")
    items = [("10", " ".join(words(rows[10][1])[2:30])), ("9", "one"), ("b", None), ("c", "..."), (None, "TWO words"), ("d", rows[12][1][:200])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", bench.toArrow())
    results = {
        sql.SUFFIX_DEDUP: suffix.with_digests(suffix.remove_repeats(docs)),
        sql.DECONTAMINATION: decontam.with_digests(decontam.find_contamination(docs, bench)),
        sql.QUALITY_RULES: quality.judge(docs),
    }
    for text, frame in results.items():
        found = con.execute(text)
        columns = [c[0] for c in found.description]
        assert Counter(found.fetchall()) == Counter(map(tuple, frame.select(*columns).collect()))


def brute_perplexity(trusted, texts, order=5):
    """Interpolated modified Kneser-Ney, one dictionary an order, one character after the other."""
    symbols_ = lambda t: ["^"] * (order - 1) + list(t) + ["^"]
    counts = {order: Counter(tuple(s[i : i + order]) for s in map(symbols_, trusted) for i in range(len(s) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts, total, spare = {}, defaultdict(float), defaultdict(float)
    for k, own in counts.items():
        n = [sum(c == i for c in own.values()) for i in range(5)]
        cuts[k] = [0.5, 1.0, 1.5]
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
            cuts[k] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]
        for g, c in own.items():
            total[g[:-1]] += c
            spare[g[:-1]] += min(c, cuts[k][min(c, 3) - 1])

    def probability(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        low = probability(gram[1:])
        if gram[:-1] not in total:
            return low
        c = counts[len(gram)][gram]
        own = c - min(c, cuts[len(gram)][min(c, 3) - 1]) if c else 0
        return own / total[gram[:-1]] + spare[gram[:-1]] / total[gram[:-1]] * low

    out = []
    for t in texts:
        s = symbols_(t)
        out.append(np.exp(-np.mean([np.log(probability(tuple(s[i : i + order]))) for i in range(len(s) - order + 1)])))
    return out


def test_perplexity(spark, monkeypatch):
    rnd = random.Random(7)
    known = ["".join(rnd.choice(["the ", "Cat ", "sat ", "on ", "мост ", "日本 ", "7 ", "\x00"]) for _ in range(rnd.randrange(40))) for _ in range(50)]
    odd = ["", "q", "the", "zzz жжж", "\x00\x00", "the cat" * 300, "𝔸𝔹 日本 мост", "x" * 5000, *known[:5]]
    monkeypatch.setattr(kneserney, "BLOCK_ROWS", 4)
    train = spark.createDataFrame([(t,) for t in known], "text string").repartition(3)
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(odd)], "doc_id long, text string, lang string").repartition(2)
    got = {r.doc_id: r.perplexity for r in kneserney.with_perplexity(df, kneserney.train(train)).collect()}
    want = brute_perplexity(known, odd)
    assert len(got) == len(odd) and np.allclose([got[i] for i in range(len(odd))], want, rtol=1e-4)


def test_chunks_cut_no_gram(monkeypatch):
    rnd = random.Random(8)
    own = ["".join(rnd.choice("abé\x00日𝔸") for _ in range(rnd.choice([0, 1, 4, 30, 900]))).encode() for _ in range(80)]
    whole = Counter()
    for t in own:
        codes = kneserney.code_points(t)
        whole.update(map(tuple, (codes[i : i + 5].tolist() for i in range(len(codes) - 4))))
    for size in (1, 7, 700, 1 << 19):
        monkeypatch.setattr(kneserney, "CHUNK", size)
        cut = Counter()
        for codes, places in kneserney.chunks(own):
            assert len(codes) <= 2 * size + 1000
            cut.update(tuple(codes[i : i + 5].tolist()) for i in places.tolist())
            assert all(map(str.__eq__, kneserney.grams_at(codes, places), ("".join(map(chr, codes[i : i + 5])) for i in places.tolist())))
        assert cut == whole


def test_slots():
    rnd = np.random.default_rng(2)
    h = np.unique(rnd.integers(1, 2**64, 9000, dtype=np.uint64))
    h[:3000] = h[:3000] >> np.uint64(40) | np.uint64(1)  # many in one place
    h = np.unique(h)
    table = kneserney.Slots(4)
    for part in np.array_split(rnd.permutation(len(h)), 9):
        assert not table.find(h[part])[1].any()
        table.add(h[part], part)
    slot, found = table.find(h)
    assert found.all() and (table.values[slot] == np.arange(len(h))).all() and not table.find(h[h > 5] - np.uint64(1))[1].all()


def test_kneser_ney(spark):
    rnd = random.Random(6)
    speech = {"en": ["the ", "cat ", "sat ", "on ", "mats "], "ru": ["дом ", "стоит ", "у ", "реки ", "под ", "горой "], "zh": ["我们", "今天", "去", "学校", "读书", "。"]}
    rows, labels = [], []
    for lang, parts in speech.items():
        letters = sorted(set("".join(parts)) - {" "})
        for _ in range(60):
            rows.append((len(rows), "".join(rnd.choice(parts) for _ in range(60)), lang))
            labels.append((rows[-1][0], 1))
        # Junk over the same letters: no class of characters tells it apart.
        rows.append((900 + len(rows), "".join(rnd.choice(letters) for _ in range(150)), lang))
        labels.append((rows[-1][0], 0))
    rows += [(1901, None, "en"), (1902, "kjqz" * 50, "xx"), (None, rows[0][1], "en"), (1903, rows[0][1], None)]
    df = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, lang string, perplexity double")
    marks = spark.createDataFrame(labels * 2, "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in kneserney.classify(df, marks).collect()}
    assert len(got) == len(rows) and not got[1902] and got[1903] and got[None]
    assert not any(got[k] for k, q in labels if not q) and sum(got[k] for k, q in labels if q) >= 174
    assert all(r.kept for r in kneserney.classify(df.where("doc_id < 50"), marks.limit(0)).collect())
    assert kneserney.classify(df.limit(0), marks).count() == 0


def brute_sentences(text):
    """One character after the other: a cut stands after the white space that follows an end or a line's end."""
    out, own, ended = [], "", False
    for i, c in enumerate(text):
        if ended and not c.isspace():
            out.append(own)
            own, ended = "", False
        own += c
        before = text[:i].rstrip("\"')]")
        ended = ended or c == "\n" or (c.isspace() and before[-1:] in (".", "!", "?") and not text[i - 1].isspace())
    return out + [own] * bool(own)


def brute_spans(rows, least):
    """(doc_id, text, sentences, removed) of every row, the first of a kind staying."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        parts = brute_sentences(text or "")
        bare, gone = [p.strip() for p in parts], set()
        spans = []
        for i in range(len(parts)):
            j = next((j for j in range(i, len(parts) + 1) if len(" ".join(bare[i:j]).split()) >= least), None)
            if j is not None:
                spans.append((i, j))
        if not spans and "".join(bare):
            spans = [(0, len(parts))]
        for i, j in spans:
            key = tuple(bare[i:j])
            if key in seen:
                gone |= set(range(i, j))
            seen.add(key)
        out.append((doc_id, "".join(p for i, p in enumerate(parts) if i not in gone) if gone else text, len(parts), len(gone)))
    return Counter(out)


def test_spans(spark):
    shared = "First shared sentence here. Second shared one follows! Third closes it? Fourth too."
    rows = [(2, "Intro. " + shared + " Own end of two."), (1, "Other start. " + shared + "\nOwn end of one."), (None, shared), (4, None), (5, ""), (6, "a. b."), (7, "x. y. z. x. y. z.")]
    rows += [(8, "a.   b."), (9, " \n "), (10, shared.replace(" ", "\n")), (11, "One sentence of more words than eight that all stand here alone. Short."), (12, "Before. One sentence of more words than eight that all stand here alone.")]
    rows += [(100 + i, f"Lead {i}. " + shared[i:] + f" Tail {i} of its own.") for i in range(12)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_removed int")
    for least in (8, 1, 30):
        got = spans.remove_repeated_spans(df, least).collect()
        assert Counter((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in got) == brute_spans(rows, least)
    twice = spark.createDataFrame([(1, shared), (1, shared)], "doc_id long, text string")
    assert sorted(r.text for r in spans.remove_repeated_spans(twice).collect()) == ["", shared]
    for t in (b"", b"a", b"A b. C d!\n\nE\n f?  ", b"...", b"\n"):
        assert b"".join(t[a:b] for a, b in spans.sentences(t)) == t


def test_sentences_of_long_runs_of_signs():
    for t in (b"." * 300_000, b" " * 300_000, b".)" * 150_000, b"\n" * 300_000):
        began = time.process_time()
        assert sum(b - a for a, b in spans.sentences(t + b"x")) == len(t) + 1
        assert time.process_time() - began < 2


def test_sql_of_spans_agrees(spark):
    duckdb = pytest.importorskip("duckdb")
    rnd = random.Random(12)
    parts = ["One here. ", "Two (there)!\n", "Three?\n\n ", "four \" a.b ", "Fünf.) ", "...", " \t\x0b\f\r", "6! ", "\n"]
    parts += [f"a sentence of just nine words with number {i}. " for i in range(3)]
    own = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(24)))) for i in range(200)] + [(None, "".join(parts)), (200, None), (201, "".join(parts))]
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    found = con.execute(sql.SENTENCE_SPANS)
    columns = [c[0] for c in found.description]
    rows = found.fetchall()
    assert sum(r[columns.index("n_removed")] > 0 for r in rows) > 20
    assert Counter(rows) == Counter(map(tuple, spans.remove_repeated_spans(df).select(*columns).collect()))


def test_sharding(docs, rows):
    got = sharding.shard_documents(docs).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    key = lambda k: 42 if k is None else xxhash.xxh64_intdigest(str(k), 42)
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), plain_jump(key(r[0]), 8), plain_jump(key(r[0]), 9)) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want


def plain_jump(key, n):
    """Jump consistent hashing, one key after the other."""
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(3).integers(0, 2**63, 20_000).astype(np.uint64)
    plain = plain_jump
    assert sharding.jump_hash(keys[:300], 11).tolist() == [plain(int(k), 11) for k in keys[:300]]
    a, b = sharding.jump_hash(keys, 8), sharding.jump_hash(keys, 9)
    assert set(b[a != b].tolist()) == {8} and abs((a != b).mean() - 1 / 9) < 0.02


def test_toxicity(spark):
    rnd = random.Random(9)
    calm = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(1200):
        bad = i % 4 == 0
        w = [rnd.choice(calm) for _ in range(60)]
        if bad:
            w[5:5] = ["you", rnd.choice(["gronk", "zibbed", "zibber"])]
        rows.append((i, " ".join(w), 0.0))
        labels.append((i, int(bad)))
    rows += [(5000, None, 0.0), (None, "you gronk", 0.0), (5000, "", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = toxicity.score_documents(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.predicted, int(r.doc_id % 4 == 0)) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1200]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    none = toxicity.score_documents(df, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r.predicted for r in none} == {0}


def test_toxicity_features():
    own = toxicity.Lexicon.of({"gronk": 3.0, "du": 2.5}, {"zibb": 4.0, "blargs": 5.0})
    rnd = random.Random(16)
    parts = ["you", "Gronk", "zibbed", "zibb", "blargsome", "YOUR", "calm", "ABC", "a!b", "aaaaa", "x y z w", "!!", "?", "du", "7", "É", "ÉÉÉ"]
    texts = ["", "!", *(" ".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 40))) for _ in range(200))]
    for text in texts:
        w = re.findall(r"[^\W_]+", text.lower())
        weight = [max([own.words.get(x, 0), *(own.starts.get(x[:k], 0) for k in (4, 5, 6) if len(x) > k)]) for x in w]
        hits = [i for i, x in enumerate(weight) if x]
        second = [i for i, x in enumerate(w) if x in toxicity.SECOND]
        n, size, letters = max(1, len(w)), max(1, len(text)), max(1, sum(map(len, w)))
        want = [
            len(hits) / n, sum(weight) / n, len(hits), max(weight, default=0), len({w[i] for i in hits}),
            sum(any(abs(i - j) <= 5 for j in second) for i in hits) / n, len(second) / n, sum("A" <= c <= "Z" for c in text) / letters,
            sum(len(x) >= 3 and x.isalpha() and x.upper() == x for x in re.findall(r"\w+", text)) / n, sum(c in "!?" for c in text) / size,
            (size - letters - text.count(" ")) / size,
        ]
        got = toxicity.features(text, own)
        assert np.allclose(got[:11], want) and got[13] == np.log1p(len(w))
    assert toxicity.features("a b c d e", own)[12] > 0 and toxicity.features("st@rk", own)[11] > 0 and toxicity.features("stark", own)[11] == 0


def test_boosted_trees():
    rnd = np.random.default_rng(17)
    x = np.round(rnd.normal(size=(300, 4)), 1)
    y = (x[:, 2] + 0.3 * x[:, 0] > 0.4).astype(float)
    model = toxicity.boost(x, y, rounds=5)

    def walk(row):
        total = model.bias
        for feature, cut, value in model.trees:
            at = 0
            while at < 7:
                at = 2 * at + (2 if row[feature[at]] > cut[at] else 1)
            total += model.rate * value[at - 7]
        return total

    assert np.allclose(model.raw(x), [walk(r) for r in x])
    # The first split is the best of all, by the second-order gain.
    p = 1 / (1 + np.exp(-model.bias))
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(j, c):
        left = x[:, j] <= c
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 2.0)
        return part(left) + part(~left)

    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(4)]
    best = max(gain(j, c) for j in range(4) for c in edges[j])
    feature, cut, _ = model.trees[0]
    assert np.isclose(gain(feature[0], cut[0]), best) and ((model.raw(x) > 0) == (y > 0)).mean() > 0.9


def test_isotonic_is_the_best_fit():
    rnd = np.random.default_rng(18)
    x, y = rnd.permutation(40).astype(float), (rnd.random(40) < 0.5).astype(float)
    _, level = toxicity.isotonic(x, y)
    ordered = y[np.argsort(x)]
    # The fit at i is the greatest, over starts up to i, of the least mean to an end from i on.
    want = [max(min(ordered[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(np.unique(np.round(want, 9)), np.unique(np.round(level, 9)))


def test_isotonic_is_monotone():
    x = np.random.default_rng(0).normal(size=500)
    knots, level = toxicity.isotonic(x, (x + np.random.default_rng(1).normal(size=500) > 0).astype(float))
    assert (np.diff(knots) > 0).all() and (np.diff(level) >= 0).all()


def test_empty_tables(nothing):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    for out in (
        suffix.remove_repeats(nothing), simhash.near_duplicates(nothing), simhash.keep_one(nothing), packing.pack(nothing, path), quality.judge(nothing),
        sharding.shard_documents(nothing), spans.remove_repeated_spans(nothing),
        decontam.find_contamination(nothing, nothing.selectExpr("doc_id AS item_id", "text")), toxicity.score_documents(nothing, nothing.selectExpr("doc_id", "0 AS toxic")),
    ):
        assert out.count() == 0
