"""The pipeline's stages, each against a plain version of it."""

import importlib.util
import re
import zlib
from collections import Counter

import pytest

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline was taken out")

SF = "/root/testdata/sf0.001"


WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def shingle_counts(text: str) -> Counter:
    words = WORD.findall(text)
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def alike(a: Counter, b: Counter) -> bool:
    """Whether the probability Jaccard is 0.8 or more, by its definition."""
    x, y = a.total(), b.total()
    if a == b:
        return True
    if sum(min(n / x, b[k] / y) for k, n in a.items()) < 0.8 - 1e-9:  # an upper bound
        return False
    every = [(a[k], b[k]) for k in a.keys() | b.keys()]
    return sum(1 / sum(max(p / a[k], q / b[k]) for p, q in every) for k in a.keys() & b.keys()) >= 0.8 - 1e-9


def first_of_groups(docs: list[tuple[int, str]]) -> set[int]:
    """Least id of each group of texts that are alike; texts without words stay."""
    kept, bags = set(), []
    for i, text in docs:
        bag = shingle_counts(text or "")
        if bag:
            bags.append((i, bag))
        else:
            kept.add(i)
    root = {i: i for i, _ in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(bags):
        for j, b in bags[:n]:
            p, q = find(i), find(j)
            if p != q and alike(a, b):
                root[max(p, q)] = min(p, q)
    return kept | {i for i in root if find(i) == i}


def words_kept(docs: list[tuple[int, str]]) -> dict[int, list[str]]:
    """Words of each text that lie in no window of 35 that starts anywhere else too."""
    words = {i: WORD.findall(text or "") for i, text in docs}
    times = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    out = {}
    for i, w in words.items():
        gone = {p for k in range(len(w) - 34) if times[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        out[i] = [x for p, x in enumerate(w) if p not in gone]
    return out


def plain_secrets(text: str) -> list[str]:
    found = [m[1] for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [m[0] for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return found + [m[0] for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def passage() -> str:
    return " ".join(f"shared{k}" for k in range(50))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A corpus with copies, a passage in two texts, secrets, blanks and repeated lines."""
    own = lambda k, n: " ".join(f"w{k}x{i * i % 97}y{i}" for i in range(n))
    base = own(1, 120)
    texts = [
        base,
        base,
        base.replace("w1x0y0", "other"),
        base.replace("w1x25y5 ", "", 1) + " end",
        own(2, 80) + " " + passage() + " " + own(3, 10),
        own(4, 60) + "\n" + passage() + "\t" + own(5, 90),
        own(6, 40) + " api_key = '" + "Zk9" * 6 + "' " + own(7, 9),
        "AKIA" + "Q7" * 8 + " " + own(8, 30) + " " + "0af3" * 10,
        "password: short",
        "",
        None,
        " \t ",
        "say it again " * 40,
        "say it again " * 39 + "now",
        own(9, 9000),
    ]
    path = str(tmp_path_factory.mktemp("planted") / "docs")
    spark.createDataFrame([(3 * k + 5, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, score string").write.parquet(path)
    return spark.read.parquet(path)


def pairs_of(df) -> list[tuple[int, str]]:
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: r[0])


def test_near_duplicate_stage_agrees_with_all_pairs(spark, planted):
    import corpus_pipeline as p

    for docs in (planted, spark.read.parquet(f"{SF}/documents.parquet")):
        got = p.near_duplicate_stage(spark, docs, SF)
        assert got.columns == docs.columns
        want = first_of_groups(pairs_of(docs))
        assert pairs_of(got) == [r for r in pairs_of(docs) if r[0] in want]
    assert len(first_of_groups(pairs_of(planted))) < planted.count()


def test_substring_stage_agrees_with_all_windows(spark, planted):
    import corpus_pipeline as p

    for docs in (planted, spark.read.parquet(f"{SF}/documents.parquet")):
        got = dict(pairs_of(p.substring_stage(spark, docs, SF)))
        want = words_kept(pairs_of(docs))
        assert {i: WORD.findall(t or "") for i, t in got.items()} == want
        assert all(got[i] == t for i, t in pairs_of(docs) if WORD.findall(t or "") == want[i])
    assert not any("shared" in (t or "") for _, t in pairs_of(p.substring_stage(spark, planted, SF)))


def test_secret_stage_agrees_with_plain_patterns(spark, planted):
    import corpus_pipeline as p

    for docs in (planted, spark.read.parquet(f"{SF}/documents.parquet")):
        before, after = dict(pairs_of(docs)), dict(pairs_of(p.secret_stage(spark, docs, SF)))
        assert before.keys() == after.keys()
        secrets = {i: plain_secrets(t or "") for i, t in before.items()}
        assert docs is not planted or sum(map(bool, secrets.values())) == 2
        for i, t in before.items():
            assert not any(x in after[i] for x in secrets[i])
            if t is None or not (secrets[i] or re.search("gh[pousr]_|npm_", t)):
                assert after[i] == t


def test_packing_stage_holds_all_ids(spark, planted):
    import public_tokenizers
    import tokenizers

    import corpus_pipeline as p

    library = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    library.no_truncation()
    library.no_padding()
    rows = p.packing_stage(spark, planted, SF).collect()
    ids = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        have = ids.setdefault(r.doc_id, [])
        assert r.start == len(have) and len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        have += [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)]
    assert ids == {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in pairs_of(planted)}
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert sequences.get(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 4096


def test_quality_stage_agrees_with_loops(spark, planted):
    import corpus_pipeline as p

    from tests.llm.test_quality_model import slow_score
    from weftgraph.llm import quality

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, labels)
    texts = [t or "" for _, t in pairs_of(docs)]
    x, doc = quality.passages([t.encode() for t in texts])
    want = {i: slow_score(model, x[doc == k].tolist()) for k, (i, _) in enumerate(pairs_of(docs)) if k % 5 == 0}
    kept = {i for i, _ in pairs_of(p.quality_stage(spark, docs, SF))}
    assert all((i in kept) == (s >= 0.5) for i, s in want.items() if abs(s - 0.5) > 1e-5)
    assert 0 < len(kept) < len(texts)
    got = p.quality_stage(spark, planted, SF)
    assert got.columns == planted.columns and {r.score for r in got.collect()} <= {"clash"}


def test_stages_take_empty_tables(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([], "doc_id long, text string, score string")
    for _, stage in p.STAGES[1:]:
        assert stage(spark, docs, SF).collect() == []


def test_run_is_the_stages_in_turn(spark):
    import public_tokenizers
    import tokenizers

    import corpus_pipeline as p

    library = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    library.no_truncation()
    library.no_padding()
    good = pairs_of(p.quality_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF))
    first = first_of_groups(good)
    apart = [(i, t) for i, t in good if i in first]
    kept = words_kept(apart)
    ids = {}
    out = p.run(spark, SF)
    assert out.columns[:3] == ["doc_id", "start", "length"]
    for r in sorted(out.collect(), key=lambda r: (r.doc_id, r.start)):
        ids.setdefault(r.doc_id, []).extend(int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4))
    assert ids.keys() == first
    whole = [(i, t) for i, t in apart if WORD.findall(t or "") == kept[i] and not plain_secrets(t or "")]
    assert whole and all(ids[i] == [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in whole)
