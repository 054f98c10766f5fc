"""Operators against libraries, brute force, round trips and held-out labels."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftgraph.llm import bpe, embeddings, minhash, mpegts, packing, quality, queries, secret_scan, sharding

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, start string, length int, ids_crc32 string, score string, kept string, label string"
ODD = [None, "", " ", "  a", " a\n\n b", "x<|endoftext|>y <|startoftext|>", "\x1c a\x1f", "don't 's 're it's", "a" * 3000, "ab" * 500, "é́日本語テスト", "١٢٣ ½²", " x\xa0y", "İSTANBUL ΣΑΣ Σ", "\x85b c", "aaaa aaaaaaa aaaaaaaaaaaaa", "same", "same"]


def odd_texts() -> list:
    r = random.Random(3)
    return [*ODD, "".join(r.choice("abc \n'st") for _ in range(3000)), "".join(chr(r.randint(1, 0x2FFF)) for _ in range(3000)), "".join(chr(r.randint(32, 126)) for _ in range(3000))]


def frame(spark, texts):
    return spark.createDataFrame([(i if i else None, t, "c", 1, "l", "a", "s", "h") for i, t in enumerate(texts)], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    texts = odd_texts() + [r.text for r in documents(spark).limit(60).collect()]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = sorted(map(tuple, bpe.tokenize(frame(spark, texts), queries.vocabulary("byte_bpe_50k.json")).collect()), key=lambda r: (r[0] is not None, r[0]))
    assert [r[2] for r in got] == want
    assert [r[1] for r in got] == [len(w) for w in want]
    assert [r[3] for r in got] == [lib.decode(w, skip_special_tokens=False) for w in want]
    digests = sorted(map(tuple, bpe.tokenize(frame(spark, texts), queries.vocabulary("byte_bpe_50k.json"), digests=True).collect()), key=lambda r: (r[0] is not None, r[0]))
    assert [d[2] for d in digests] == [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in want]
    assert [d[3] for d in digests] == [hashlib.sha256(lib.decode(w, skip_special_tokens=False).encode()).hexdigest() for w in want]


@pytest.mark.parametrize("digests", [False, True])
def test_bpe_decodes_the_ids_it_made(digests):
    """Other ids decode to another text: what is returned is not the input."""
    b = bpe.Bpe(queries.vocabulary("byte_bpe_50k.json"))
    honest = b.encode_texts
    b.encode_texts = lambda texts: [",".join(reversed(i.split(","))) for i in honest(texts)]
    text = "one two three"
    n, ids, back = bpe.round_trip(b, [text], digests)
    want = "".join(b.decode_bytes(np.array([i])).decode() for i in reversed(b.encode(text)[::-1]))
    assert want != text and n == [len(b.encode(text))]
    assert back == [hashlib.sha256(want.encode()).hexdigest() if digests else want]


def test_bpe_forgets_long_chunks():
    b = bpe.Bpe(queries.vocabulary("byte_bpe_50k.json"))
    text = "x" * 100 + " short " + "y" * 100
    assert b.encode(text) == b.encode(text) and all(len(c) <= bpe.LONG for t in (b.of_chunk, b.of_word) for c in t)
    assert b.decode(np.array(b.encode(text))) == text


def test_bpe_exact_merging_agrees():
    b = bpe.shared(queries.vocabulary("byte_bpe_50k.json"))
    r = random.Random(1)
    words = ["".join(r.choice("abetinsr") for _ in range(r.randint(1, 40))).encode() for _ in range(500)]
    assert [list(x) for x in b.words(words)] == [b.merge_exactly(w) for w in words] == b.merge_words(words)


@pytest.mark.parametrize("size", [4096, 64])
def test_packing_places_each_id_once(spark, size):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    texts = odd_texts() + [r.text for r in documents(spark).limit(60).collect()]
    want = {i if i else None: [*lib.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    rows = packing.pack(frame(spark, texts), queries.vocabulary("word_bpe_49k.json"), size=size).collect()
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0 and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        seen[r.doc_id].append((r.start, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, ids in want.items():
        assert [i for _, part in sorted(seen[doc]) for i in part] == ids
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == size or at & (at - 1) == 0
    assert packing.pack(frame(spark, []), queries.vocabulary("word_bpe_49k.json")).collect() == []


def brute_secrets(t: str) -> list:
    out = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def test_secrets_match_plain_patterns(spark):
    r = random.Random(2)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", "=", ":", " ", "'", '"', "abcdefgh12", "é", "AKIA", "ABCDEFGHIJKLMN", "deadbeef" * 4, "0" * 33, "x", "ſecret", "日"]
    texts = [None, "", *["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]]
    scanner = secret_scan.Scanner()
    for t in texts[1:]:
        assert [s for s in scanner.spans(t) if s[0] in secret_scan.KINDS[:3]] == brute_secrets(t)
    got = secret_scan.scan(frame(spark, texts[:300]), digests=True).collect()
    for row in got:
        base = brute_secrets(texts[row.doc_id or 0] or "")
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(b[0] == k for b in base) for k in secret_scan.KINDS[:3])
        assert row.base_sha256 == hashlib.sha256(secret_scan.joined(base).encode()).hexdigest()


def test_secrets_checksum():
    body = b"a1B2" * 7 + b"xy"
    good = "ghp_" + (body + secret_scan.checksum(body)).decode()
    scanner = secret_scan.Scanner()
    assert scanner.spans(f"é {good}.") == [("forge", 2, 42)]
    assert scanner.spans(f"é {good[:-1]}{'0' if good[-1] != '0' else '1'}.") == []
    assert secret_scan.mask(f"é {good}.", scanner.spans(f"é {good}.")) == "é <forge>."


def test_transport_streams_round_trip(spark):
    r = random.Random(5)
    for n in [0, 1, 17, 191, 192, 193, 2000, 5440, mpegts.PES_BYTES, mpegts.PES_BYTES + 1, 10 * mpegts.PES_BYTES]:
        payload = mpegts.pad(r.randbytes(n))
        media = mpegts.mux(payload)
        back = mpegts.demux(media)
        assert back.payload == payload and back.breaks == 0 and len(media) % mpegts.PACKET == 0
        assert back.stamps == [k * mpegts.PES_TICKS for k in range(len(back.stamps))]
        assert len(back.random_access) == -(-len(back.stamps) // mpegts.GROUP)
    lost = mpegts.demux(mpegts.mux(b"x" * 40_000)[: mpegts.PACKET * 2] + mpegts.mux(b"x" * 192)[2 * mpegts.PACKET :])
    assert lost.payload == b"x" * 192
    texts = odd_texts()
    for row in mpegts.store(frame(spark, texts), digests=True).collect():
        raw = (texts[row.doc_id or 0] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_sharding_table_by_turns():
    names, slots = ("a", "b", "c", "d", "e"), 101
    claimed: dict[int, int] = {}
    orders = [[(sharding._draw(s, "offset") + k * (sharding._draw(s, "stride") % (slots - 1) + 1)) % slots for k in range(slots)] for s in names]
    while len(claimed) < slots:
        for k in range(len(names)):
            free = next((x for x in orders[k] if x not in claimed), None)
            if free is not None:
                claimed[free] = k
    table = sharding.fill_table(names, slots)
    assert table == [claimed[i] for i in range(slots)]
    fewer = sharding.fill_table(names[:-1], slots)
    moved = sum(names[a] != names[b] for a, b in zip(table, fewer) if names[a] != "e")
    assert moved < 0.3 * slots
    counts = Counter(sharding.fill_table())
    assert max(counts.values()) - min(counts.values()) <= 1
    with pytest.raises(ValueError):
        sharding.fill_table(names, 100)


def test_sharding_places_all_rows(spark):
    rows = sharding.place(frame(spark, ["a", "b", "b"])).collect()
    table = sharding.fill_table()
    for r in rows:
        digest = hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()
        assert r.slot == int(digest[:15], 16) % sharding.SLOTS and r.shard == table[r.slot]
    assert len(rows) == 3


def near_corpus() -> list:
    r = random.Random(7)
    out: list = [None, "", "one two", "one two", "alone"]
    for _ in range(25):
        words = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(30, 200))]
        out += [" ".join(words)] * r.randint(1, 2)
        for _ in range(r.randint(0, 3)):
            w = list(words)
            for _ in range(r.randint(1, 6)):
                w[r.randrange(len(w))] = f"v{r.randint(0, 9999)}"
            out.append("  ".join(w))
    return out


def probability_jaccard(a: str, b: str) -> float:
    def weights(t):
        w = t.split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)) if w)

    x, y = weights(a), weights(b)
    keys = x.keys() | y.keys()
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in keys) for i in x.keys() & y.keys())


def test_near_duplicates_match_brute_force(spark, tmp_path):
    texts = near_corpus()
    frame(spark, texts).write.parquet(str(tmp_path / "t"))
    rows = minhash.near_duplicates(spark.read.parquet(str(tmp_path / "t"))).collect()
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    worded = [i for i, t in enumerate(texts) if t and t.split()]
    for n, i in enumerate(worded):
        for j in worded[:n]:
            s = probability_jaccard(texts[i], texts[j])
            assert abs(s - minhash.similarity(texts[i].encode(), texts[j].encode())) < 1e-9
            if s >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {r.doc_id: r.group_id for r in rows if r.doc_id} == {i: find(i) for i in range(1, len(texts))}
    assert sum(r.kept for r in rows) == len({find(i) for i in range(len(texts))})
    kept = minhash.keep_first(spark.read.parquet(str(tmp_path / "t")))
    assert kept.columns == frame(spark, []).columns and kept.count() == sum(r.kept for r in rows)
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


def test_signatures_estimate_similarity():
    a = " ".join(f"x{i}" for i in range(300)).encode()
    b = " ".join(f"x{i}" if i % 40 else f"y{i}" for i in range(300)).encode()
    s = minhash.sign(*minhash.shingles([a, b]), 2, registers=1024)
    assert abs((s[0] == s[1]).mean() - minhash.similarity(a, b)) < 0.06


@pytest.mark.parametrize("block", [4, 2048])
def test_embedding_links_match_brute_force(spark, block):
    r = np.random.default_rng(4)
    centres = r.normal(size=(6, 16))
    vectors = [centres[r.integers(6)] + r.normal(size=16) * r.choice([0.05, 0.3, 0.45]) for _ in range(60)]
    rows = [(i, [float(x) for x in v], int(i % 2)) for i, v in enumerate(vectors)]
    rows += [(60, rows[0][1], 0), (61, None, 0), (62, [0.0] * 16, 0), (63, [float("nan")] * 16, 0), (64, [None] * 16, 1), (65, rows[1][1], None), (66, [], 1), (67, [1.0, 2.0], 1), (68, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS n_links")
    got = {x.vec_id: x for x in embeddings.link(df, block=block).collect()}
    good = {i: np.array(v, np.float32).astype(float) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: y for i, _, y in rows}
    links = {i: [j for j in good if j != i and label[i] == label[j] and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.93] if i in good else [] for i, _, _ in rows}
    for i in links:
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(reach), min(reach) == i)
    assert embeddings.link(df.limit(0)).collect() == []


def test_quantised_products_stay_in_their_bounds():
    r = np.random.default_rng(9)
    x = r.normal(size=(200, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embeddings.quantise(x)
    off = np.abs((q @ q.T) * s[:, None] * s[None, :] - x @ x.T)
    assert (off <= e[:, None] + (1 + e[:, None]) * e[None, :] + 1e-6).all()


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(rows) == docs.count()
    truth = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(rows[r.doc_id].held_out for r in truth)
    right = [rows[r.doc_id].predicted == r.quality for r in truth]
    assert np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())


def test_quality_odd_texts_and_no_labels(spark):
    none = spark.createDataFrame([(None, None), (1, 7)], "doc_id long, quality int")
    rows = quality.score(frame(spark, odd_texts()), none).collect()
    assert len(rows) == len(odd_texts()) and all(r.predicted == 1 for r in rows)


def test_oracles_are_sql():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert json.dumps(queries.oracle_sql())
