"""Each corpus operator against brute force, over nulls, empty and long texts, ties, repeated rows, extra columns and empty tables."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("na", "so", "ri") for c in ("n", "", "st", "ma")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def corpus(seed=1):
    """(doc_id, text) with copies, near copies, shared passages, repeats, odd and missing texts; ids unordered."""
    rng = random.Random(seed)
    base = prose(rng, 400)
    passage = prose(rng, 60)
    texts = [base, base, base[:900] + " zzz " + base[900:], prose(rng, 80), None, "", "short", "é" * 130, "ab" * 400, prose(rng, 50) + " " + passage, passage + "\n" + prose(rng, 70), passage + passage, "\0" * 250, "  \t\n ", prose(rng, 9000), base[500:]]
    texts += [prose(rng, rng.randint(1, 120)) for _ in range(20)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


EXTRA = "doc_id long, text string, h long, k long, n_bytes string, size string, `range` int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x", "y", 3, "z") for i, t in rows], EXTRA).repartition(3)


def components(ids, linked):
    best = dict.fromkeys(ids)
    for i in ids:
        best[i] = i
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(best[a], best[b])
            changed |= best[a] != m or best[b] != m
            best[a] = best[b] = m
    return best


def test_components(spark):
    from lodestrata.llm.common import components as found

    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 480)] + [(5, 5), (None, 1)]
    got = {r.node: r.component for r in found(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    nodes = {x for p in real for x in p}
    assert got == components(nodes, real)
    assert found(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(3)
    rows = [rng.standard_normal(16) for _ in range(60)]
    hub = rng.standard_normal(16)
    rows += [hub + rng.standard_normal(16) * s for s in (0.01, 0.05, 0.1, 0.2, 0.3, 0.35, 0.4) for _ in range(12)]
    out = [(100 + k, [float(x) for x in v]) for k, v in enumerate(rows)]
    bad = [(1, None), (2, [0.0] * 16), (3, [float("nan")] * 16), (4, []), (5, [1.0] * 8), (6, [2.0] * 8), (7, [float("inf")] + [1.0] * 15)]
    return out + bad + [(900, [None] + [1.0] * 15)], out


def test_embeddings(spark):
    from lodestrata.llm.embeddings import near_vectors

    rows, good = vectors()
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, uid int, key string").repartition(4)
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    x = np.array([v for _, v in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.9
    ids = [i for i, _ in good]
    true = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(hit, 1)), strict=True)]
    found = sum(got[i].n_links for i in ids)
    assert found <= 2 * len(true) and found >= 0.97 * 2 * len(true)
    best = components([i for i, _ in rows], [*true, (5, 6)])
    assert {i: r.component_id for i, r in got.items()} == best
    assert got[5].n_links == got[6].n_links == 1
    assert all(got[i].n_links == 0 and got[i].kept for i in (1, 2, 3, 4, 7, 900))
    assert near_vectors(df.limit(0)).count() == 0


def test_hadamard_is_orthogonal():
    from lodestrata.llm.embeddings import hadamard

    h = hadamard(np.eye(32))
    assert np.allclose(h @ h.T, np.eye(32))


def test_warc(spark, tmp_path):
    from lodestrata.llm.warc import read_archives, write_archives

    rows = [(1, "http://a/\r\nb", "<p>x</p>"), (2, None, "<p>x</p>"), (9, "u", "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 5000), (6, "u", "a\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n int").repartition(3)
    got = {r.page_id: r for r in read_archives(write_archives(df, f"file://{tmp_path}/w")).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "")]
        assert got[i].payload_bytes == len(raw)
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert got[i].refers_to == (None if i == max(same) else max(same))
        assert got[i].record_type == ("response" if i == max(same) else "revisit")
    assert read_archives(write_archives(df.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_zip64_directory(tmp_path):
    import struct
    import zipfile

    from pyarrow import fs

    from lodestrata.llm.warc import members

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("x", b"hello")
    raw = path.read_bytes()
    end = raw.rfind(b"PK\x05\x06")
    count, size, start = struct.unpack_from("<HII", raw, end + 10)
    big = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, size, start) + struct.pack("<IIQI", 0x07064B50, 0, end, 1)
    path.write_bytes(raw[:end] + big + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        at, n = members(f)["x"]
        f.seek(at)
        assert f.read(n) == b"hello"


def brute_repeats(rows, span=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - span + 1):
            if b[p : p + span] in seen:
                gone[p : p + span] = True
            seen.add(b[p : p + span])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats(spark, seed):
    from lodestrata.llm.repeats import remove_repeats

    rows = corpus(seed)
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(frame(spark, rows)).collect()}
    assert got == brute_repeats(rows)


def test_repeats_keeps_columns(spark):
    from lodestrata.llm.repeats import remove_repeats

    rows = corpus(4)
    df = frame(spark, [*rows, (None, "n" * 300), rows[0]])
    out = remove_repeats(df, with_text=True)
    assert out.schema.names == df.schema.names and out.count() == len(rows) + 2
    assert remove_repeats(df.limit(0)).count() == 0


def test_loser_tree_merges():
    from lodestrata.llm.repeats import merge

    rng = random.Random(5)
    runs = [sorted(bytes(rng.choices(b"ab", k=12)) for _ in range(rng.randrange(30))) for _ in range(5)]
    lcp = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))
    which, where, known = merge([(r, [0, *(lcp(a, b) for a, b in zip(r, r[1:], strict=False))]) for r in runs])
    out = [runs[r][k] for r, k in zip(which, where, strict=True)]
    assert out == sorted(x for r in runs for x in r)
    assert known[1:] == [lcp(a, b) for a, b in zip(out, out[1:], strict=False)]


def test_token_counts(spark, tmp_path):
    import sentencepiece

    from lodestrata.llm.queries import tokenizer_path
    from lodestrata.llm.tokens import count_tokens

    rows = [*corpus(6), (77, "<s> hello </s>"), (78, "hello"), (79, "hello"), (None, "x y")]
    path, cache = tokenizer_path("piece_bpe_32k.model"), f"file://{tmp_path}/cache"
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    df = frame(spark, rows)
    for _ in range(2):  # the second time all come from the cache
        got = {r.doc_id: r for r in count_tokens(df, path, cache).collect()}
        for i, t in rows:
            n = len(model.encode(t or ""))
            assert tuple(got[i])[1:] == (len((t or "").encode()), n, n > 4096)
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})
    assert count_tokens(df.limit(0), path, cache).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    from lodestrata.llm.packing import pack
    from lodestrata.llm.queries import tokenizer_path

    rows = [*corpus(7), (70, "a <|endoftext|> b"), (71, "naïve 数字 ١٢٣ \x85 ​ x\x1cy 🎉 ﬁ Ǆ"), (72, "it's  WE'LL\n\n 12,345 --")]
    path = tokenizer_path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    pieces = pack(frame(spark, rows), path).collect()
    for i, t in rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own, at = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start), 0
        for p in own:
            assert p.start == at and p.doc_tokens == len(ids)
            at += p.length
            assert p.ids_crc32 == zlib.crc32(ids[p.start : at].tobytes())
        assert at == len(ids)
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    assert pack(frame(spark, rows).limit(0), path).count() == 0


def test_sum_of_squares_choice():
    from lodestrata.llm.packing import Packer

    rng, packer = random.Random(8), Packer(16, 0)
    for _ in range(300):
        length = rng.randrange(1, 16)
        before = packer.count.copy()
        level = packer.level_for(length)
        costs = {}
        for h in range(0, 16 - length + 1):
            if h == 0 or before[h]:
                n = before.copy()
                n[h] -= h > 0
                n[h + length] += h + length < 16
                costs[h] = int((n[1:16] ** 2).sum())
        assert costs[level] == min(costs.values())
        packer.add(0, np.arange(length, dtype=np.uint32))


def test_contamination(spark):
    from lodestrata.llm.decontaminate import decontaminate

    rng = random.Random(9)
    many = [f"{a}{b}{c}" for a in WORDS for b in ("x", "q") for c in ("ul", "or", "ien", "as")]
    say = lambda n: " ".join(rng.choice(many) for _ in range(n))
    items = [(k, say(rng.randint(12, 150))) for k in range(20)] + [(50, None), (51, "")]
    docs = [(k, say(rng.randint(0, 400))) for k in range(60)]
    docs += [(100 + k, say(50) + " " + items[k][1].upper() + ". " + say(90)) for k in range(10)]
    changed = items[11][1].split()
    changed[3::9] = ["zzz"] * len(changed[3::9])
    docs += [(200, " ".join(changed)), (201, None)]
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = {r.doc_id: r.item_ids for r in decontaminate(frame(spark, docs), bench).collect()}
    assert {i: x for i, x in got.items() if x} == {100 + k: [k] for k in range(10)} | {200: [11]}
    assert set(got) == {i for i, _ in docs}
    assert decontaminate(frame(spark, docs).limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate(frame(spark, docs), bench.limit(0)).collect())


def test_sharding(spark):
    from lodestrata.llm.sharding import shard_by_bytes

    rows = [*corpus(10), *((1000 + k, "copy " * 40) for k in range(200)), (None, "x"), (None, "x")]
    got = shard_by_bytes(frame(spark, rows)).collect()
    text = dict(rows)
    sizes = {}
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes.setdefault(r.shard, []).append(r)
    assert len(got) == len(rows)
    mean, most = sum(r["size"] for r in got) / 16, max(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in own) - mean) <= most for own in sizes.values())
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in sizes.values())
    assert shard_by_bytes(frame(spark, rows).limit(0)).count() == 0


def labelled(seed, n=400):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        toxic, bad = k % 6 == 0, k % 5 == 0
        words = prose(rng, 60).split()
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["idiot", "stupid", "grelbat"])
        docs.append((k, " | ".join(words) if bad else " ".join(words)))
        labels.append((k, int(not bad), int(toxic)))
    return docs, labels


def test_quality(spark):
    from lodestrata.llm.quality import drop_low_quality, judge

    docs, labels = labelled(11)
    df = spark.createDataFrame([(i, t, "h" if i % 3 else None, "en", 5, True) for i, t in [*docs, (900, None), (901, "")]], "doc_id long, text string, source string, lang string, n_chars long, keep boolean")
    lab = spark.createDataFrame([(*x, 1) for x in labels[:300]] + [(None, 1, 1, 1), (5, None, 0, 1)], "doc_id long, quality int, toxic int, text int")
    got = {r.doc_id: r.keep for r in judge(df, lab).collect()}
    assert sum(got[i] == bool(q) for i, q, _ in labels) >= 0.98 * len(labels) and len(got) == len(docs) + 2
    assert judge(df.limit(0), lab).count() == 0
    assert judge(df, lab.limit(0)).count() == len(docs) + 2
    kept = drop_low_quality(df, lab)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, k in got.items() if k)


def test_site_priors_shrink(spark):
    from lodestrata.llm.quality import site_priors

    rows = [("a", "x", 1.0)] * 200 + [("b", "x", 0.0)] * 200 + [("c", "x", 0.0)]
    overall, rates = site_priors(spark.createDataFrame(rows, "h string, p string, evidence double"), ("h", "p"))
    got = {r.h: r.rate for r in rates.collect()}
    assert got["b"] < got["c"] < overall < got["a"]


def test_toxicity(spark):
    from lodestrata.llm.toxicity import score_toxicity

    docs, labels = labelled(12, 900)
    df = frame(spark, [*docs, (2000, None), (2001, ""), (None, "x")])
    lab = spark.createDataFrame([(*x, 1) for x in labels] + [(None, 1, 1, 1), (7, 1, None, 1)], "doc_id long, quality int, toxic int, text int")
    got = {r.doc_id: r for r in score_toxicity(df, lab).collect()}
    held = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i, _ in held) and len(got) == len(docs) + 3
    assert sum(got[i].predicted == t for i, t in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert score_toxicity(df.limit(0), lab).count() == 0
    assert score_toxicity(df, lab.limit(0)).count() == len(docs) + 3


def test_isotonic_and_trees():
    from lodestrata.llm.boosting import Boosted, Isotonic

    rng = np.random.default_rng(13)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = Boosted(trees=40).fit(x, y).predict(x)
    assert ((p > 0.5) == y).mean() > 0.95
    iso = Isotonic().fit(p, y)
    assert (np.diff(iso.y) >= 0).all()


def brute_fingerprint(text):
    ws = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark):
    from lodestrata.llm.simhash import near_duplicates

    rows = [*corpus(14), (500, "A B c"), (501, "a\x0bb\tC"), (502, "É b c d")]
    got = {r.doc_id: r for r in near_duplicates(frame(spark, [*rows, rows[0]])).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == fps
    ids = list(fps)
    pairs = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    assert {i: r.component_id for i, r in got.items()} == components(ids, pairs)
    assert near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_gray_tree():
    from lodestrata.llm.simhash import GrayTree

    rng = np.random.default_rng(15)
    centres = rng.integers(0, 2**63, 20, dtype=np.uint64)
    codes = np.unique(np.concatenate([centres ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for _ in range(12)]))
    q, found = GrayTree(codes).search(codes, 3)
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 3
    assert set(zip(q.tolist(), found.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


def test_near_copies(spark):
    from lodestrata.llm.simhash import near_copies

    rng = random.Random(16)
    docs = [(k, prose(rng, 300)) for k in range(20)]
    for k in range(20):
        words = docs[k][1].split()
        words[rng.randrange(300)] = "changed"
        docs.append((100 + k, " ".join(words)))
    docs += [(200, docs[0][1]), (201, None), (202, "")]
    got = {r.doc_id: r.component_id for r in near_copies(frame(spark, docs)).collect()}
    assert sum(got[100 + k] == k for k in range(20)) >= 19
    assert got[200] == 0 and got[202] == 201 and all(got[k] == k for k in range(20))


def test_near_copies_follow_whole_shingle_sets(spark):
    from lodestrata.llm.simhash import near_copies

    rng = random.Random(21)
    docs = []
    for k in range(60):  # around the similarity asked for, where sketches can't decide
        words = prose(rng, 400).split()
        docs.append((k, " ".join(words)))
        for place in range(5, 395, 390 // rng.randrange(5, 14)):
            words[place] = f"other{place}"
        docs.append((1000 + k, " ".join(words)))

    def sets(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    got = {r.doc_id: r.component_id for r in near_copies(frame(spark, docs)).collect()}
    text, alike = dict(docs), 0
    for k in range(60):
        a, b = sets(text[k]), sets(text[1000 + k])
        close = len(a & b) >= 0.8 * len(a | b)
        alike += close and got[1000 + k] == k
        assert close or got[1000 + k] == 1000 + k
    assert alike >= 0.95 * sum(len(sets(text[k]) & sets(text[1000 + k])) >= 0.8 * len(sets(text[k]) | sets(text[1000 + k])) for k in range(60)) > 10


def copies(seed, n=24):
    """Texts and copies of them that are cut, extended, changed in one block or all over, around the similarity asked for."""
    rng, docs = random.Random(seed), []
    for k in range(n):
        words = prose(rng, rng.randint(60, 400)).split()
        size, share = len(words), rng.choice([0.05, 0.1, 0.15, 0.18, 0.22])
        m = int(size * share)
        block = words[: size // 2] + [f"b{k}x{i}" for i in range(m // 2)] + words[size // 2 + m // 2 :]
        docs += [(k * 10, words), (k * 10 + 1, words[: size - m]), (k * 10 + 2, words[m:]), (k * 10 + 3, words + prose(rng, m).split()), (k * 10 + 4, block)]
        docs.append((k * 10 + 5, [f"s{k}x{i}" if i % 50 == 25 else w for i, w in enumerate(words)]))
    return [(i, " ".join(w)) for i, w in docs]


def alike(docs, similarity=0.8):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in docs if t is not None for w in [t.lower().split()]}
    ids = sorted(sets)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]


def test_near_copies_of_any_shape(spark):
    from lodestrata.llm.simhash import near_copies

    docs = copies(31)
    got = {r.doc_id: r.component_id for r in near_copies(frame(spark, docs)).collect()}
    assert got == components([i for i, _ in docs], alike(docs))


def test_near_copies_of_the_same_words_in_other_orders(spark):
    from lodestrata.llm.simhash import near_copies

    rng = random.Random(32)
    words = sorted(set(prose(rng, 400).split()))
    docs = []
    for k in range(6):
        rng.shuffle(words)
        other = [*words[:20], words[21], words[20], *words[22:]]
        docs += [(k, " ".join(words)), (10 + k, " ".join(other))]
    got = {r.doc_id: r.component_id for r in near_copies(frame(spark, docs)).collect()}
    assert got == components([i for i, _ in docs], alike(docs)) == {i: i % 10 for i, _ in docs}


def test_near_copies_in_a_large_family(spark):
    from lodestrata.llm.simhash import near_copies

    rng = random.Random(33)
    base, docs = prose(rng, 200).split(), []
    for k in range(150):
        w = list(base)
        for x in rng.sample(range(200), rng.randint(0, 9)):
            w[x] = f"v{k}x{x}"
        docs.append((k, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_copies(frame(spark, docs)).collect()}
    assert got == components([i for i, _ in docs], alike(docs))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipe

    from lodestrata.llm.queries import oracle_sql, queries

    docs, labels = labelled(17, 200)
    rows = [(i, t, "en", "s", len(t)) for i, t in docs] + [(900, None, None, None, None), (901, docs[1][1], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, docs[2][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = pipe.run(spark, str(tmp_path))
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    good = {i for i, q, _ in labels if q}
    assert 2 not in kept and 901 not in kept and len(kept & good) >= 0.95 * (len(good) - 1) and len(kept - good - {900}) <= 2
    assert [n for n, _ in pipe.STAGES][0] == "quality classifier" and len(pipe.STAGES) == 5
    assert set(oracle_sql()) <= set(queries()) and {k.split("_")[0] for k in queries()} == {f"op{n}" for n in range(1, 11)}


def test_front_coded_run_round_trip():
    from lodestrata.llm.repeats import Run, Suffixes, byte_order, common_prefixes, front_code

    rng = np.random.default_rng(18)
    n, span, reach = 200, 100, 68
    n_right, n_left = rng.integers(32, span + 1, n), rng.integers(0, reach + 1, n)
    right = rng.integers(97, 99, (n, span)).astype(np.uint8)
    right[: n // 2] = right[0]
    right = right * (np.arange(span) < n_right[:, None]).astype(np.uint8)
    left = rng.integers(97, 99, (n, reach)).astype(np.uint8) * (np.arange(reach) < n_left[:, None]).astype(np.uint8)
    s = Suffixes(right, left, n_right, n_left, np.arange(n), np.arange(n), np.arange(n))
    s = s.take(byte_order(s.right))
    run = Run(front_code(s), span)
    assert run.text == [r.tobytes() for r in s.right] == sorted(run.text)
    assert run.lcp == common_prefixes(s.right).tolist()
    assert (run.left_rows(reach) == s.left).all() and (run.k == s.k).all()


def test_gray_trees_of_groups():
    from lodestrata.llm.simhash import GrayTree

    rng = np.random.default_rng(41)
    sizes = np.array([1, 0, 90, 3, 700, 8])
    codes = rng.integers(0, 1 << 12, int(sizes.sum()), dtype=np.uint64) << np.uint64(20)
    group = np.repeat(np.arange(len(sizes)), sizes)
    q, found = GrayTree(codes, sizes).search(codes, 3, group)
    near = (np.bitwise_count(codes[:, None] ^ codes[None]) <= 3) & (group[:, None] == group[None])
    assert sorted(zip(q.tolist(), found.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


@pytest.mark.parametrize("hot", [3, 10**6])
def test_links_of_large_and_hot_groups(spark, hot):
    from lodestrata.llm.simhash import links

    rng = np.random.default_rng(42)
    centre = rng.integers(0, 1 << 62, 6, dtype=np.uint64)
    codes = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (5, 120), dtype=np.uint64)) for c in centre]))
    codes = np.unique(np.r_[codes, codes[:200] ^ np.uint64(5), codes[:200] ^ np.uint64(1 << 63)])
    rows = [(int(c), k) for k, c in enumerate(codes.view(np.int64).tolist())]
    edges = links(spark.createDataFrame([(c, k) for k, c in enumerate(codes.view(np.int64).tolist())], "fp long, node long"), hot=hot).collect()
    near = np.argwhere(np.triu(np.bitwise_count(codes[:, None] ^ codes[None]) <= 3, 1)).tolist()
    ids = list(range(len(rows)))
    assert all(np.bitwise_count(codes[e.a] ^ codes[e.b]) <= 3 for e in edges)
    assert components(ids, [(e.a, e.b) for e in edges]) == components(ids, near)


def test_simhash_of_rows_without_id(spark):
    from lodestrata.llm.simhash import near_duplicates

    got = near_duplicates(frame(spark, [(None, "a b c d"), (None, "x y z w"), (3, "a b c d"), (3, "a b c d"), (4, "q")])).collect()
    fps = {t: brute_fingerprint(t) for t in ("a b c d", "x y z w", "q")}
    assert sorted((r.doc_id or 0, r.fp & (2**64 - 1), r.component_id or 0) for r in got) == sorted([(0, fps["a b c d"], 3), (0, fps["x y z w"], 0), (3, fps["a b c d"], 3), (3, fps["a b c d"], 3), (4, fps["q"], 4)])


def test_drop_near_copies_keeps_one_of_each(spark):
    from lodestrata.llm.simhash import drop_near_copies

    rng = random.Random(43)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(1, a, 1, True), (1, a, 2, False), (1, b, 3, None), (2, a.upper(), 4, None), (3, b, 5, None), (None, c, 6, None), (None, d, 7, None), (9, d, 8, None), (5, None, 9, None), (6, "", 10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long, kept boolean")
    got = drop_near_copies(docs)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
    assert kept == sorted([(1, a), (1, b), (0, c), (9, d), (5, "")])
    assert drop_near_copies(docs.limit(0)).count() == 0
    once = drop_near_copies(docs.repartition(3)).where("doc_id = 1").collect()
    assert sorted(r.node for r in once) == sorted(r.node for r in got.where("doc_id = 1").collect())


def test_near_copies_across_the_border_of_large_groups(spark):
    from lodestrata.llm.simhash import near_copies

    rng = random.Random(44)
    base, docs = prose(rng, 120).split(), []
    for k in range(90):  # a family of which many pairs lie below the similarity asked for
        w = list(base)
        for x in rng.sample(range(120), rng.randint(0, 7)):
            w[x] = f"v{k}x{x}"
        docs.append((k, " ".join(w)))
    docs += [(200 + k, prose(rng, 30)) for k in range(20)]
    want = components([i for i, _ in docs], alike(docs))
    for small, run, block in ((64, 1 << 20, 4096), (4, 1 << 20, 16), (3, 200, 8)):
        got = near_copies(frame(spark, docs), small=small, run=run, block=block)
        assert {r.doc_id: r.component_id for r in got.collect()} == want


def paraphrases(seed):
    """Items, and texts that hold them with a part of their words replaced, dropped, inserted or swapped."""
    rng = random.Random(seed)
    many = [f"{a}{b}{c}" for a in WORDS for b in ("x", "q", "tr", "m") for c in ("ul", "or", "ien", "as", "op")]
    say = lambda n: [rng.choice(many) for _ in range(n)]
    items = [(k, " ".join(say(rng.randint(14, 90)))) for k in range(40)]
    docs = [(k, " ".join(say(rng.randint(0, 500)))) for k in range(150)]
    for k in range(120):
        own = items[k % 40][1].split()
        at = set(rng.sample(range(len(own)), int(rng.choice([0.1, 0.2, 0.27]) * len(own))))
        match k % 4:
            case 0:
                own = [rng.choice(many) if i in at else w for i, w in enumerate(own)]
            case 1:
                own = [w for i, w in enumerate(own) if i not in at]
            case 2:
                own = [x for i, w in enumerate(own) for x in ([w, "moreover"] if i in at and i % 2 else [w])]
            case _:
                for i in at:
                    if i + 1 < len(own):
                        own[i], own[i + 1] = own[i + 1], own[i]
        docs.append((1000 + k, " ".join([*say(rng.randint(0, 150)), *own, *say(rng.randint(0, 150))])))
    return items, docs


def brute_contamination(items, docs):
    """Every passage against every item by a plain dynamic programme: no vectors, no candidates."""
    from lodestrata.llm import decontaminate as d

    def common_order(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    parts = []
    for i, t in items:
        w = d.words(t)
        starts = [0] if len(w) <= d.PASSAGE else [*range(0, len(w) - d.PASSAGE, d.PASSAGE), len(w) - d.PASSAGE]
        parts += [(i, w[s : s + d.PASSAGE]) for s in starts if w]
    times = {}
    for _, w in parts:
        for x in set(w):
            times[x] = times.get(x, 0) + 1
    found = set()
    for i, w in parts:
        rare = {x for x in w if times[x] <= max(3, 0.1 * len(parts))}
        answer, n = w[-max(1, len(w) // 3) :], d.span(len(w)) * d.CHUNK
        for doc, t in docs:
            ws = d.words(t)
            for s in range(0, len(ws), d.CHUNK):
                own = ws[s : s + n]
                if len(rare & set(own)) >= d.CONTENT * len(rare) and common_order(w, own) >= d.COMMON * len(w) and common_order(answer, own) >= d.ANSWER * len(answer):
                    found.add((doc, i))
                    break
    return found


def test_contamination_recall_against_brute_force(spark):
    from lodestrata.llm.decontaminate import find_contamination

    items, docs = paraphrases(51)
    want = brute_contamination(items, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {k: {(r.doc_id, r.item_id) for r in find_contamination(frame(spark, docs), bench, **options).collect()} for k, options in {"whole": {}, "blocks": {"block": 7}, "none": {"cosine": 2.0}, "all": {"cosine": -2.0}}.items()}
    assert len(want) > 90 and got["all"] == want
    assert got["whole"] == got["blocks"] <= want and len(got["whole"]) >= 0.95 * len(want)
    assert not got["none"]


def test_contamination_of_odd_rows(spark):
    from lodestrata.llm.decontaminate import decontaminate, drop_contaminated

    rng = random.Random(52)
    items, docs = paraphrases(53)
    bench = spark.createDataFrame([*items, items[0], (70, "qqa qqb"), (71, "qqc"), (None, "x y z"), (72, None), (73, "")], "item_id long, text string")
    hit = items[3][1]
    rows = [(None, hit, 1), (None, prose(rng, 30), 2), (7, hit, 3), (7, hit, 4), (7, prose(rng, 50), 5), (8, None, 6), (9, "", 7), (10, "one two three qqa qqb four", 8), (11, (prose(rng, 3000) + " ") * 5 + hit, 9)]
    df = spark.createDataFrame([*rows, *((i + 5000, t, 0) for i, t in docs[:100])], "doc_id long, text string, item_id int")
    got = sorted((r.doc_id or 0, r.contaminated, r.item_ids) for r in decontaminate(df, bench).collect() if (r.doc_id or 0) < 5000)
    assert got == sorted([(0, True, [3]), (0, False, []), (7, True, [3]), (7, True, [3]), (7, False, []), (8, False, []), (9, False, []), (10, True, [70]), (11, True, [3])])
    left = drop_contaminated(df, bench)
    assert left.columns == df.columns and sorted(r.item_id for r in left.where("item_id > 0").collect()) == [2, 5, 6, 7]


def packed_whole(pieces, size=1024):
    """Checks that every id lies in one piece and that windows have no gap; how many pieces are cut elsewhere than at whole windows."""
    docs, windows = {}, {}
    for p in pieces:
        docs.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in docs.values():
        at = 0
        for start, length, total in sorted(own):
            assert start == at
            at += length
        assert at == total
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size and at & (at - 1) == 0
    return sum(p.start % size > 0 for p in pieces)


def test_packing_carries_open_windows(spark):
    from lodestrata.llm.packing import pack
    from lodestrata.llm.queries import tokenizer_path

    rng = random.Random(61)
    path = tokenizer_path("byte_bpe_50k.json")
    rows = [(k, prose(rng, int(rng.paretovariate(1.1) * 30) % 1500)) for k in range(1500)]
    docs = frame(spark, rows).repartition(8).cache()
    whole = pack(docs, path).collect()
    alone = packed_whole(pack(docs.coalesce(1), path).collect())
    assert packed_whole(whole) <= 2 * alone + 20 <= len(rows) / 5  # tasks that closed their own windows would cut eight times as often
    for options in ({"open_windows": 5, "per_task": 40}, {"open_windows": 5}, {"per_task": 10**6}):
        packed_whole(pack(docs, path, **options).collect())


def test_packing_of_odd_rows(spark):
    from lodestrata.llm.packing import pack
    from lodestrata.llm.queries import tokenizer_path

    path = tokenizer_path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(None, "a b c", 1), (None, None, 2), (3, "same", 3), (3, "same", 4), (4, "x " * 5000, 5)], "doc_id long, text string, offset int")
    pieces = pack(docs, path).collect()
    assert sum(p.length for p in pieces if p.doc_id is None) == 5 and sum(p.doc_id == 3 and p.start == 0 for p in pieces) == 2
    assert sum(p.length for p in pieces) == 5 + 2 * 2 + next(p.doc_tokens for p in pieces if p.doc_id == 4)


def test_plain_characters_get_the_ids_of_the_library():
    from tokenizers import Tokenizer

    from lodestrata.llm.packing import PLAIN, encoder
    from lodestrata.llm.queries import tokenizer_path

    path = tokenizer_path("byte_bpe_50k.json")
    model, encode, rng = Tokenizer.from_file(path), encoder(path), random.Random(62)
    plain = [chr(c) for c in range(0x10000) if PLAIN.match(chr(c))]
    assert len(plain) > 20_000
    for k in range(0, len(plain), 97):  # every character once, between letters, digits, blanks and marks
        text = "".join(c + rng.choice(["a", " ", "1", "'s", "  b", ".", "\n", "É"]) for c in plain[k : k + 97])
        assert encode(text).tolist() == model.encode(text, add_special_tokens=False).ids


def test_quality_posterior_leaves_the_document_out(spark):
    from lodestrata.llm.quality import _strength, judge

    docs, labels = labelled(71, 240)
    rng = random.Random(72)
    sites = [("big", "en")] * 120 + [("big", None)] * 40 + [("small", "de")] * 5 + [(None, "en")] * 74 + [("one", "fr")]
    rows = [(i, t, *s, 1) for (i, t), s in zip(docs, sites, strict=True)]
    rows += [rows[0], (None, docs[1][1], "big", "en", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, evidence int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = judge(df, lab).collect()
    assert len(got) == len(rows)
    logit = lambda p: float(np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6))))
    everything = [r.evidence for r in got]
    overall = sum(everything) / len(got)
    shrunk, weights, prior = {}, [], {(): overall}
    for depth in (1, 2):  # rates with all documents, for the weights
        groups = {}
        for r in got:
            groups.setdefault((r.source, r.lang)[:depth], []).append(r.evidence)
        table = spark.createDataFrame([(float(sum(x)), len(x), prior[k[:-1]]) for k, x in groups.items()], "good double, n long, prior double")
        w = _strength(table, table.prior)
        weights.append(w)
        shrunk = {k: (sum(x) + w * prior[k[:-1]]) / (len(x) + w) for k, x in groups.items()}
        prior = shrunk
    for k, r in enumerate(got):
        others = [x for j, x in enumerate(got) if j != k]
        rate = sum(x.evidence for x in others) / len(others)
        for depth, w in zip((1, 2), weights, strict=True):
            own = [x.evidence for x in others if (x.source, x.lang)[:depth] == (r.source, r.lang)[:depth]]
            rate = (sum(own) + w * rate) / (len(own) + w)
        assert abs(rate - r.site_rate) < 1e-9
        score = 1 / (1 + np.exp(-(logit(r.evidence) + logit(rate) - logit(overall))))
        assert abs(score - r.quality_score) < 1e-6 and r.keep == (r.quality_score >= 0.5)


@pytest.mark.parametrize("dims", [64, 768])
def test_embedding_recall_of_planted_links(spark, dims):
    from lodestrata.llm.embeddings import near_vectors

    rng = np.random.default_rng(81)
    centre = rng.standard_normal((120, dims)) * np.geomspace(1, 0.1, dims)  # unequal spread over the dimensions
    near = centre + np.linalg.norm(centre, axis=1, keepdims=True) * rng.uniform(0.25, 0.5, (120, 1)) * (e := rng.standard_normal((120, dims))) / np.linalg.norm(e, axis=1, keepdims=True)
    hot = centre[0] + 0.01 * rng.standard_normal((60, dims))
    rows = np.concatenate([centre, near, hot])
    rows = rows.astype(np.float32)
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    want = links.sum(axis=1)
    assert 40 < (want[120:240] > 0).sum() < 120
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows.tolist())], "vec_id long, embedding array<float>")
    for crowd in (1 << 22, 10):  # two hashes, three hashes
        got = np.array([r.n_links for r in near_vectors(df, crowd=crowd).orderBy("vec_id").collect()])
        assert (got <= want).all() and got.sum() >= 0.97 * want.sum()


def test_embeddings_of_repeated_rows_and_rows_without_id(spark):
    from lodestrata.llm.embeddings import near_vectors

    v, w = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    rows = [(5, v), (5, v), (None, v), (None, w), (3, [0.99, 0.01, 0.5])]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 0, 0, False), (0, 3, 3, False), (3, 3, 3, True), (5, 3, 3, False), (5, 3, 3, False)]


def test_token_cache_hits_and_misses(spark, tmp_path):
    from lodestrata.llm.queries import tokenizer_path
    from lodestrata.llm.tokens import cached, count_tokens

    path, cache = tokenizer_path("piece_bpe_32k.model"), f"file://{tmp_path}/cache"
    rows = corpus(82)
    first = {r.doc_id: r.n_tokens for r in count_tokens(frame(spark, rows[:20]), path, cache).collect()}
    known = cached(spark, cache)
    assert known.count() == len({t or "" for _, t in rows[:20]})
    poisoned = known.withColumn("n_tokens", known.n_tokens + 1000).collect()
    spark.createDataFrame(poisoned, known.schema).write.parquet(f"{cache}2")  # what is in the cache is believed, what isn't is encoded
    texts = {t or "" for _, t in rows[:20]}
    again = count_tokens(frame(spark, rows), path, f"{cache}2").collect()
    fresh = {r.doc_id: r.n_tokens for r in count_tokens(frame(spark, rows), path, f"{cache}3").collect()}
    text = dict(rows)
    assert {r.doc_id: r.n_tokens for r in again} == {i: n + 1000 * ((text[i] or "") in texts) for i, n in fresh.items()}
    assert {i: fresh[i] for i in first} == first
    assert cached(spark, f"{cache}2").count() == len({t or "" for _, t in rows})


def test_ranges_of_many_boundaries():
    import time

    from lodestrata.llm.repeats import HEAD

    rng = np.random.default_rng(83)
    heads = rng.integers(0, 3, (50_000, 16)).astype(np.uint8)
    heads[:, HEAD:] = 0
    bounds = sorted({bytes(h[:HEAD]) for h in heads[:20_000]})[:10_000]
    start = time.perf_counter()
    target = np.searchsorted(np.array(bounds, "S16"), heads.view("S16").ravel(), side="right")
    assert time.perf_counter() - start < 5
    for k in range(0, 50_000, 997):
        assert target[k] == sum(b.rstrip(b"\0") <= bytes(heads[k]).rstrip(b"\0") for b in bounds)


def test_toxicity_of_repeated_rows(spark):
    from lodestrata.llm.toxicity import score_toxicity

    docs, labels = labelled(84, 600)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once = {r.doc_id: r.score for r in score_toxicity(frame(spark, docs), lab).collect()}
    twice = score_toxicity(frame(spark, [*docs, *docs, *docs[:100]]), lab).collect()
    assert len(twice) == 1300 and all(abs(once[r.doc_id] - r.score) < 1e-9 for r in twice)


def test_anchors_across_blocks(monkeypatch):
    from lodestrata.llm import repeats

    rng = np.random.default_rng(91)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    stops = np.array([1700, 1750, 5000])
    place, h = repeats.anchors(data, stops, 100)
    for block in (150, 1024, 4999):
        monkeypatch.setattr(repeats, "BLOCK", block)
        again = repeats.anchors(data, stops, 100)
        assert (again[0] == place).all() and (again[1] == h).all()


def test_repeats_of_odd_rows(spark):
    from lodestrata.llm.repeats import remove_repeats

    rng = random.Random(92)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(None, a), (1, a), (1, a), (2, b), (2, b + " " + a), (3, None), (4, "x" * 99), (5, "x" * 99), (6, "é" * 80)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in remove_repeats(frame(spark, rows)).collect())
    whole = lambda t: len(t.encode())
    assert got[:3] == [(0, whole(a), 0), (1, whole(a), whole(a)), (1, whole(a), whole(a))]
    assert {r[2] for r in got if r[0] in (3, 4, 5)} == {0} and len(got) == len(rows)
    assert sum(r[2] for r in got if r[0] == 2) >= whole(a) + whole(b) - 1


def test_embeddings_in_blocks(spark):
    """Split buckets and class pairs give the rows that whole ones give."""
    from lodestrata.llm.embeddings import near_vectors

    rows, _ = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    whole, parts = (sorted(near_vectors(df, **k).collect()) for k in ({}, {"bucket": 4, "members": 3}))
    assert parts == whole and max(r.n_links for r in whole) > 12


def test_common_passages_bring_no_outsiders(spark, monkeypatch):
    """Texts that only share a passage with many others are dealt again instead of compared with all of them."""
    from lodestrata.llm import common, simhash

    rng = random.Random(91)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=8))
    passage = [word() for _ in range(12)]
    docs = [(k, " ".join([word() for _ in range(60)] + passage)) for k in range(50)]
    docs += [(100 + k, docs[k][1] + " " + word()) for k in range(0, 50, 7)]
    made, keep = {}, common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, tag: made.setdefault(tag, []).append(out := keep(df, tag)) or out)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, docs), small=6).collect()}
    assert got == components([k for k, _ in docs], alike(docs))
    assert sum(x.count() for x in made.get("apart", [])) < 12


def test_whole_sets_are_read_without_exchanging_texts(spark):
    from pyspark.sql import functions as F

    from lodestrata.llm import common, simhash

    docs = [(k if k % 5 else None, prose(random.Random(k), 30)) for k in range(40)]
    texts = common.materialise(frame(spark, docs).withColumn("text_hash", F.xxhash64("text")), "texts")
    want = {simhash.identity(s): simhash._packed(s) for s in (simhash.shingles(t) for _, t in docs)}
    nodes = spark.createDataFrame([(simhash.identity(simhash.shingles(r.text)), (r.doc_id, r.text_hash)) for r in texts.collect()], "node long, rep struct<doc_id long, text_hash long>")
    got = simhash._sets(nodes.select("node").limit(15), texts, nodes, 5)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    some = {r.node: bytes(r.whole) for r in got.collect()}
    assert some.items() <= want.items() and {r.node for r in nodes.limit(15).collect()} <= some.keys()


def test_embeddings_are_hashed_alike_at_any_size(spark, monkeypatch):
    from lodestrata.llm import embeddings

    used, spread = [], embeddings._spread
    monkeypatch.setattr(embeddings, "_spread", lambda *a: used.append(a) or spread(*a))
    df = spark.createDataFrame(vectors()[0], "vec_id long, embedding array<double>")
    for n in (10, 1 << 40):
        monkeypatch.setattr(type(df), "count", lambda _, n=n: n)
        embeddings.near_vectors(df)
    assert used == [(2, embeddings.TABLES, embeddings.PROBES)] * 2
