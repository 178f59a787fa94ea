"""The llm operators against brute force, on the smallest data and on awkward tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, decontamination, embeddings, lines, minhash, packing, pii, quality, queries, secrets, substrings, urls

LONG = "word " * 60_000
PASSAGE = " ".join(f"passage{i}" for i in range(50))
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog near the old mill"),
    (2, "the QUICK brown fox jumps over the lazy dog near the old mill"),
    (3, "  the quick\tbrown\nfox jumps over the lazy dog   near the old mill "),
    (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one two"), (9, "One two three"),
    (10, LONG), (11, LONG + "tail"), (12, f"start of twelve {PASSAGE} end of twelve"), (13, f"thirteen begins {PASSAGE} and ends"),
    (14, "x" * 50_000), (15, "no\u00a0break \u3000 spaces é ü 😀 mail me.at@host.example.org or +49 (30) 1234-5678"),
    (16, "the quick brown fox jumps over the lazy dog near the old mill"), (16, "the quick brown fox jumps over the lazy dog near the old mill"),
    (None, "a row without an id"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    return df.withColumns({"a.b": F.lit(1), "score": F.lit("x"), "key": F.lit(2), "component_id": F.lit(3), "leaks": F.lit(4), "n": F.lit(5)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


# ---- 1 ----------------------------------------------------------------------------------------


def brute_components(rows: list[tuple], words: int) -> dict:
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, text in rows:
        w = [x.translate(lower) for x in split(text)]
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_minhash_equals_brute_force(request, which):
    df = request.getfixturevalue(which).where("doc_id is not null")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = minhash.near_duplicates(df, 4).collect()
    want = brute_components(rows, 4)
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_minhash_without_rows_and_with_null_ids(empty, awkward):
    assert minhash.near_duplicates(empty).collect() == []
    assert minhash.near_duplicates(awkward).count() == len(DOCS)


def test_minhash_of_rows_that_share_an_id(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(40)) for w in ("one", "two"))
    rows = [(1, one), (1, two), (2, one + " more"), (3, two + " more"), (4, "of its own")]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_no_local_folder_on_a_cluster():
    class Session:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError):
        common.shared_folder(Session())


def test_sketch_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    values = np.concatenate([a, a[:800], a[:1]])
    sketch = minhash.sketches(values, np.array([0, 1000, 1800, 1801]), 400)
    assert (sketch != np.iinfo(np.uint64).max).all()
    assert abs((sketch[0] == sketch[1]).mean() - 0.8) < 0.1


# ---- 5 ----------------------------------------------------------------------------------------


def brute_kept(rows: list[tuple], window: int) -> list[tuple]:
    texts = [split(t) for _, t in rows]
    seen = Counter(tuple(w[k : k + window]) for w in texts for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = np.zeros(len(w), dtype=bool)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = True
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("which", ["docs", "awkward", "empty"])
def test_substrings_equal_brute_force(request, which, monkeypatch):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], "w " * 100 if r["text"] == LONG else r["text"]) for r in df.select("doc_id", "text").collect()]  # brute force is slow on the long ones
    df = df.sparkSession.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in substrings.remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()]
    assert sorted(got, key=str) == sorted(brute_kept(rows, 35), key=str)


@pytest.mark.parametrize("group", [1, 4, 20])
def test_large_prefix_groups_are_split(spark, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    rng = np.random.default_rng(9)
    rows = [(i, " ".join([f"own{i}x{k}" for k in range(20)] + PASSAGE.split() + [f"more{i}x{k}" for k in range(20)])) for i in range(40)]
    words = PASSAGE.split()
    for i in range(40, 100):  # parts of the passage with one word changed, so that groups differ in their depth
        w = list(words)
        w[int(rng.integers(0, 50))] = f"other{i % 5}"
        rows.append((i, " ".join([f"own{i}", *w[int(rng.integers(0, 8)) :], f"more{i}"])))
    got = [tuple(r) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()]
    assert sorted(got) == sorted(brute_kept(rows, 35)) and {r[2] for r in got if r[0] < 40} == {50}


def test_tree_of_suffixes():
    rng = np.random.default_rng(10)
    words = rng.integers(0, 3, (200, 6)).astype(np.uint64)
    order, depth = substrings.tree(words)
    rows = [tuple(w) for w in words.tolist()]
    assert [rows[i] for i in order] == sorted(rows)
    want = [next((k for k in range(6) if x[k] != y[k]), 6) for x, y in zip(sorted(rows), sorted(rows)[1:], strict=False)]
    assert depth.tolist() == want
    seen = Counter(rows)
    assert substrings.deep_leaves(words, np.array([hash(r) for r in rows])).tolist() == [seen[r] > 1 for r in rows]


# ---- 4 ----------------------------------------------------------------------------------------


def test_lines_drop_recurring_templates_only(spark):
    rows = [(i, f"first line of document {i} is alone here\nPosted on day {i} by the site editors\nlast words{i} of it all{i}") for i in range(30)]
    rows += [(100 + i, "a copied text of\nthree lines that says\nthe same in all") for i in range(30)] + [(200, None), (201, ""), (201, "")]
    out = {r["doc_id"]: r for r in lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Posted" not in out[i]["text"] and out[i]["n_dropped"] >= 1 for i in range(30))
    assert all(out[100 + i]["n_dropped"] == 0 for i in range(30))
    assert out[200]["text"] is None and out[201]["text"] == ""


def brute_templates(text: str) -> dict[int, list[tuple]]:
    """Templates of each line, as tuples."""
    out = {}
    for k, line in enumerate(text.split("\n")):
        w = [b"*" if re.search(rb"[0-9]", t) else t for t in line.encode().split()]
        out[k] = [tuple(w)] if len(w) >= 3 else []
        n = min(4, len(w) - 2)
        for p in range(max(0, n)):
            field = [i for i in range(2, len(w)) if (i - 2) * n // (len(w) - 2) == p]
            if len(w) - len(field) >= 4:
                out[k].append((p, *(None if i in field else t for i, t in enumerate(w))))
    return out


def test_lines_equal_brute_force(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    classes = {i: c for i, (_, c) in brute_components(rows, 5).items()}
    found = [(i, brute_templates(t or "")) for i, t in rows]
    held: dict = defaultdict(set)
    for i, lines_ in found:
        for forms in lines_.values():
            for f in forms:
                held[f].add(classes[i])
    often = {f for f, of in held.items() if len(of) >= 10}
    want = {i: n for i, lines_ in found if (n := sum(bool(often & set(forms)) for forms in lines_.values()))}
    for way in (0, 10**6):
        out = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in lines.drop_recurring(docs, 10, way).collect()}
        assert often and {i: n for i, (n, _) in out.items() if n} == want


def test_lines_learn_fields_of_names(spark):
    names = ["".join(chr(97 + int(d)) for d in f"{i:03d}") for i in range(45)]
    rows = [(i, "\n".join([*own_lines(i, 2), f"Posted by {names[i % 45]} in News", f"{names[i % 45]} {names[i % 44]} {names[i % 43]} has no fixed start"])) for i in range(200)]
    out = {r["doc_id"]: r["text"].split("\n") for r in lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(out[i]) == 3 and not any("Posted" in x for x in out[i]) for i in range(200))


def own_lines(i: int, n: int) -> list[str]:
    """Lines of twelve words without digits that only document i has."""
    word = lambda *x: "".join(chr(97 + int(d)) for y in x for d in f"{y:04d}")
    return [" ".join(word(i, j, k) for k in range(12)) for j in range(n)]


def test_lines_drop_whole_blocks(spark):
    footer = [f"footer line {c} of the site's own words" for c in ("alpha", "beta", "gamma", "delta", "epsilon")]
    body = lambda i: own_lines(i, 2)
    rows = [(i, "\n".join([*body(i), *footer])) for i in range(2000)]
    copied = [" ".join(f"{chr(97 + j)}{chr(97 + k)}copied" for k in range(10)) for j in range(20)]
    rows += [(5000 + i, "\n".join([*copied[: i % 20], own_lines(5000 + i, 1)[0], *copied[i % 20 :]])) for i in range(60)]
    for way in (0, 10**6):
        out = {r["doc_id"]: r["text"] for r in lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"), 10, way).collect()}
        assert all(out[i].split("\n") == body(i) for i in range(2000))
        assert all(len(set(copied) - set(out[5000 + i].split("\n"))) == 0 for i in range(60))  # near copies keep their lines


def test_lines_repeated_within_texts_and_in_copies(spark):
    body = lambda i: own_lines(i, 3)
    reply, share = "Reply to this post", "Share this on your page"
    rows = [(i, "\n".join(x for line in body(i) for x in (line, reply))) for i in range(300)]  # three times each
    rows += [(1000 + i, "\n".join([*body(1000 + i), share])) for i in range(90)]
    rows += [(2000 + i, "\n".join([*body(2000), share])) for i in range(200)]  # one text of 200 copies
    out = {r["doc_id"]: r["text"].split("\n") for r in lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == body(i) for i in range(300))
    assert all(out[1000 + i] == body(1000 + i) for i in range(90))
    assert all(out[2000 + i] == body(2000) for i in range(200))


def test_lines_of_texts_that_would_lose_all(spark):
    line = "All rights are reserved by us"
    rows = [(i, "\n".join([*own_lines(i, 1), line])) for i in range(20)] + [(50, line), (51, f"{line}\n \n{line}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for whole in (False, True):
        out = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in lines.drop_recurring(df, whole=whole).collect()}
        assert all(out[i] == (own_lines(i, 1)[0], 1) for i in range(20))
        assert (out[50], out[51]) == ((rows[-2][1], 0), (rows[-1][1], 0)) if whole else (("", 1), (" ", 2))


def test_lines_edge_cases(awkward, empty):
    out = lines.drop_recurring(awkward)
    assert out.columns == [*awkward.columns[:2], "a.b", "score", "key", "component_id", "leaks", "n", "n_lines", "n_dropped"] and out.count() == len(DOCS)
    assert lines.drop_recurring(empty).collect() == []


# ---- 8 ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_packing_round_trip(request, which):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    rows = packing.pack(packing.pieces(df, packing.vocabulary_path()), 2048, 50).collect()
    want = Counter()
    for i, text in df.select("doc_id", "text").collect():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want.update((i, s, tuple(ids[s : s + 2048]), len(ids)) for s in range(0, len(ids), 2048))
    assert Counter((r["doc_id"], r["start"], tuple(r["ids"]), r["doc_tokens"]) for r in rows) == want
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 2048


def test_sequences_are_padded(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "e")], "doc_id long, text string")
    packed = packing.pack(packing.pieces(df, packing.vocabulary_path()), 16)
    out = packing.sequences(packed, 16).collect()
    assert [(r["n_tokens"], len(r["ids"]), r["padding"]) for r in out] == [(7, 16, 9)]


ODD = ["", " ", "don't stop! it's é.à İstanbul <|endoftext|> x<|ENDOFTEXT|>. a<|endoftext|>b.", "A.B. é. क़. ÅNG, ÀÉ!! 'tis 12,5% x#1.  y z ﬁ. ß. ×.", "a" * 300_000, "日本語。 한국어. "]


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_tokenizer(monkeypatch, vocabulary):
    import public_tokenizers

    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    encoder = packing.Encoder(public_tokenizers.path(vocabulary))
    texts = ODD + [f"Some words{i} of {i}, and WORDS!! of {i % 7}." for i in range(60)]
    for some in ([t] for t in texts):
        ids, ends = encoder.encode([t.encode() for t in some], 1)
        assert ids.tolist() == [i for t in some for i in [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1]]
        assert ends[-1] == len(ids)
    ids, ends = encoder.encode([t.encode() for t in texts], 1)
    assert np.diff(ends, prepend=0).tolist() == [len(encoder.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts]


def test_encoder_tells_words_of_one_hash_apart(monkeypatch):
    encoder = packing.Encoder(packing.vocabulary_path())
    monkeypatch.setattr(packing.H, "hash_spans", lambda buf, starts, ends: np.ones(len(starts), dtype=np.uint64))
    for text in ("word", "other words", "word"):
        assert encoder.encode([text.encode()], 1)[0].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_packing_groups_whole_documents_and_splits_repeated_ids(spark):
    rows = [(None, "the same words again and again"), (7, "the same words again and again")] * 400 + [(8, "w " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack(packing.pieces(df, packing.vocabulary_path(), with_ids=False), 2048, 100).collect()
    groups = Counter(r["sequence_id"] // packing.GROUP_BINS for r in out if r["doc_id"] != 8)
    assert len(groups) == 8 and max(groups.values()) < 200
    assert len({r["sequence_id"] // packing.GROUP_BINS for r in out if r["doc_id"] == 8}) == 1


def test_first_fit_decreasing_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 300)
    free, want = [], np.zeros(300, dtype=int)
    for i in np.argsort(-lengths, kind="stable"):
        b = next((k for k, f in enumerate(free) if f >= lengths[i]), len(free))
        if b == len(free):
            free.append(100)
        want[i] = b
        free[b] -= lengths[i]
    assert (packing.first_fit_decreasing(lengths, 100)[0] == want).all()


def test_packing_nothing(empty):
    assert packing.pack(packing.pieces(empty, packing.vocabulary_path(), with_ids=False)).collect() == []


# ---- 6 ----------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = {r["doc_id"]: r for r in quality.op6_quality(spark, sf).collect()}
    assert len(scored) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if scored[r["doc_id"]]["held_out"]]
    assert all(scored[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in labels)
    assert np.mean([scored[r["doc_id"]]["predicted"] == r["quality"] for r in labels]) > 0.9


def test_context_sums_equal_brute_force(spark):
    texts = ["a b c a", "one", "", None, "b  c\na b", "x y"]
    want = np.zeros((quality.BUCKETS, quality.DIM))
    vector = {}
    for t in texts:
        words = split(t)
        for w in words:
            h = quality.H.words([w])[3]
            positions, signs = quality._index(h)
            v = np.zeros(quality.DIM)
            np.add.at(v, positions[0], signs[0])
            vector[w] = (quality._bucket(h)[0], v)
        for a, b in zip(words, words[1:], strict=False):
            want[vector[a][0]] += vector[b][1]
            want[vector[b][0]] += vector[a][1]
    got = quality.context_sums(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert np.array_equal(got, want)
    unit = quality.word_vectors(want)
    pooled = quality.pooled(["a b c a".encode(), b"", "B9 B9, é!".encode()], unit)
    assert np.allclose(pooled[0, : quality.DIM], np.mean([unit[vector[w][0]] for w in split("a b c a")], axis=0), atol=1e-6)
    assert not pooled[1].any()
    counts, size, same, upper, marks, digit = pooled[2, -6:]
    assert [counts, size, same, upper, marks, digit] == pytest.approx([np.log1p(3), 8 / 3, 0, 2 / 3, 2 / 3, 2 / 3])


def test_scores_on_the_threshold_are_predicted():
    network = quality.Network()
    network.prior = 0.3
    assert (network.scores(np.zeros((1, quality.FEATURES))) >= quality.THRESHOLD - 1e-12).all()


def test_quality_edge_cases(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 1), (10, None), (None, 1)], "doc_id long, quality int")
    network, vectors = quality.fit(awkward, labels)
    out = quality.score(awkward.drop("score"), network, vectors)
    assert out.count() == len(DOCS) and out.where("score < 0 or score > 1 or isnan(score)").count() == 0
    network, vectors = quality.fit(empty, labels.limit(0))
    assert quality.score(empty, network, vectors).collect() == []
    assert network.scores(quality.pooled([b""], vectors))[0] == pytest.approx(0.5)


# ---- 7 ----------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_spans(text: str) -> list[tuple]:
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


TRICKY = ["a@b.c@d.e.f", "x a.b+c%@ex-1.com. y a@b.cx%y@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 12", "+1 (017) 555-7713 +1-- +12345678", "😀é 4111111111111111\n+1 212 555 0100", None, "", "9" * 3000, "1 " * 20000, "a.b" * 3000 + "@" + "c." * 3000 + "d", "." * 5000 + "@x.y", "+" + "1" * 5000]


def test_pii_base_spans(spark, docs):
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    for r in df.collect():
        want = brute_spans(r["text"] or "")
        assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in got[r["doc_id"]]["base"]] == want
        spans = [tuple(s) for s in got[r["doc_id"]]["spans"]]
        assert set(want) <= set(spans) and spans == sorted(spans)


def test_pii_edge_cases(awkward, empty):
    assert pii.find(awkward).count() == len(DOCS)
    assert pii.find(empty).collect() == []


def test_expectation_maximisation_finds_the_good_labeler():
    rng = np.random.default_rng(3)
    truth = rng.random(5000) < 0.4
    votes = Counter((bool(t if rng.random() < 0.95 else not t), bool(t if rng.random() < 0.8 else not t), bool(t and rng.random() < 0.5)) for t in truth)
    prior, rates, _ = pii.reliabilities(sorted(votes.items()))
    assert abs(prior - 0.4) < 0.05 and abs(rates[0][0] - 0.95) < 0.05 and abs(rates[1][1] - 0.2) < 0.05


# ---- 3 ----------------------------------------------------------------------------------------


def test_urls_equal_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{data}/pages.parquet'")
    cur = con.execute(urls.ORACLE_SQL)
    names = [d[0] for d in cur.description]
    want = sorted((tuple(map(str, r)) for r in cur.fetchall()))
    assert sorted(tuple(str(r[n]) for n in names) for r in urls.op3_urls(spark, data).collect()) == want


def test_urls_nested_rules_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    labels, tops = ["a", "b", "example", "www", "x-1"], ["org", "com", "co.uk"]
    host = lambda: ".".join([*rng.choice(labels, rng.integers(0, 4)), rng.choice(tops)])
    path = lambda: rng.choice(["", "/", "/a", "/a/", "/a/b", "/ab", "/b?q=/a", "/a#x"])
    rules = [(rng.choice(["allow", "block"]), host(), rng.choice(["", "/", "/a", "/a/b"])) for _ in range(40)] + [("block", None, "/")]
    found = [(i, f"HTTP://{host().upper()}{path()}") for i in range(300)] + [(300, None), (301, ""), (302, "no scheme/a"), (303, "http://"), (304, "x://y://z/a"), (305, "http://.org/a"), (306, "http://org./a"), (3, "http://a.org/a")]
    rules = [(str(a), h if h is None else str(h), str(p)) for a, h, p in rules]
    got = urls.judge(spark.createDataFrame(found, "page_id long, url string").withColumn("key", F.lit(1)), spark.createDataFrame(rules, "action string, host string, path string"))

    def brute(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url[url.index("://") + 3 :]
        h = re.match("[^/?#]*", rest)[0]
        p = re.match("[^?#]*", rest[len(h) :])[0]
        h = h.lower()
        fits = [(len(rh + rp), len(rh), rh + rp, a) for a, rh, rp in rules if rh is not None and (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        best = max(fits, default=None)
        return h, p, best and best[2], best[3] if best else "allow"

    want = sorted((i, *map(str, brute(u))) for i, u in found)
    assert sorted((r["page_id"], r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in got.collect()) == want


def test_urls_nothing(spark):
    rules = spark.createDataFrame(urls.RULES, "action string, host string, path string")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), rules).collect() == []
    assert urls.judge(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), rules.limit(0)).first()["verdict"] == "allow"


# ---- 2 ----------------------------------------------------------------------------------------


def test_secrets_held_out_findings_and_documents(spark, docs, awkward, empty):
    forest = secrets.train(secrets.synthetic_findings(spark, 1500))
    new = secrets.candidates(secrets.synthetic_findings(spark, 400, seed=99), ("finding", "label")).withColumn("score", F.expr(secrets.score_sql(forest)))
    best = {}
    for r in new.orderBy(F.desc("size")).collect():
        best.setdefault(r["finding"], r)
    assert np.mean([(r["score"] >= 0.5) == (r["label"] == 1) for r in best.values()]) > 0.95
    found = secrets.scan(docs, forest).where("secret").collect()
    want = {(r["doc_id"], m.start(1), m.end(1)) for r in docs.collect() for m in re.finditer(r'token = "([0-9a-f]{40})"', r["text"])}
    got = {(r["doc_id"], r["start"], r["end"]) for r in found}
    assert want <= got and len(got - want) <= 0.1 * len(want)
    assert secrets.scan(awkward, forest).where("secret").count() == 0
    assert secrets.scan(empty, forest).collect() == []


# ---- 9 ----------------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark, data, docs):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id").collect()}

    def shingles(t):
        w = decontamination.plain(t.encode()).lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    texts = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    want = set()
    for r in items.collect():
        q, _ = decontamination.split_item(r["text"])
        for d, s in texts.items():
            want |= {(d, r["item_id"]) for part in (shingles(r["text"]), shingles(q)) if len(part & s) >= 0.8 * len(part)}
    assert got == want and got


def test_leaks_edge_cases(spark, awkward, empty):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near"), (2, None), (3, ""), (4, "...")], "item_id long, text string")
    out = decontamination.leaks(awkward, items)
    assert out.columns == [c for c in awkward.columns if c != "leaks"] + ["leaks"]
    assert {r["doc_id"] for r in out.where("size(leaks) > 0").collect()} == {1, 2, 3, 16}
    assert decontamination.leaks(empty, items).collect() == []
    assert decontamination.leaks(awkward, items.limit(0)).where("size(leaks) > 0").count() == 0


def test_leaks_of_questions_with_long_answers(spark):
    items = [(i, own_lines(i, 1)[0], " ".join(own_lines(100 + i, 5))) for i in range(40)]
    rows = [(i, f"some text before {q} and some after") for i, q, _ in items]
    rows += [(100 + i, " ".join(["begin", *q.split()[:-1], "end"])) for i, q, _ in items] + [(1000, "nothing of any item")]
    items, docs = spark.createDataFrame(items, "item_id long, question string, answer string"), spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id").collect()}
    assert got == {(d + i, i) for i in range(40) for d in (0, 100)}


def test_leaks_far_apart(spark):
    q, a = own_lines(1, 1)[0], " ".join(own_lines(2, 3))
    between = " ".join(own_lines(3, 40))
    items = spark.createDataFrame([(1, q, a)], "item_id long, question string, answer string")
    words = f"{q} {a}".split()
    rows = [(1, f"{q} {between} {a}"), (2, f"{a} {between} {q}"), (3, f"{between} {a}"), (4, " ".join(f"{' '.join(words[k : k + 5])} {between}" for k in range(0, len(words), 5)))]
    got = {r["doc_id"] for r in decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).where("size(leaks) > 0").collect()}
    assert got == {1, 2}


def test_wand_equals_scoring_all_items_and_skips():
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    draw = lambda n: " ".join(vocabulary[int(3000 * x**4)] for x in rng.random(n))
    items = [(i, draw(rng.integers(1, 50)), draw(rng.integers(0, 12))) for i in range(700)] + [(700, "", "")]
    index = decontamination.Index(items)
    for k in range(60):
        text = draw(60) if k % 3 else " ".join(f"{q} {a}" for _, q, a in items[k : k + 3])
        terms = np.unique(np.flatnonzero(np.isin(index.terms, index._words(text.encode()))))
        score = np.zeros(len(items))
        for t in terms:
            score[index.lists[t][0]] += index.lists[t][1]
        want = {i: score[i] for i in np.flatnonzero(score >= index.threshold)}
        got = dict(index.wand(terms.tolist()))
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in got)
    assert index.seen["scored"] < index.seen["postings"] / 4


def test_few_passages_enter_the_loop(spark, docs, data):
    items = [(r["item_id"], *decontamination.split_item(r["text"])) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    index = decontamination.Index(items)
    index.search([(r["text"] or "").encode() for r in docs.collect()])
    assert 0 < index.seen["entering"] < index.seen["passages"] / 5


@pytest.mark.parametrize("seed", range(5))
def test_threshold_is_what_missing_words_leave(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 11))
    size, lacking, weights = min(3, n), int(rng.integers(0, n)), rng.random(n).tolist()
    best = 0.0
    for m in range(1 << n):
        gone = [i for i in range(n) if m >> i & 1]
        if sum(any(j <= i < j + size for i in gone) for j in range(n - size + 1)) <= lacking:
            best = max(best, sum(weights[i] for i in gone))
    assert decontamination._heaviest(weights, lacking, size) == pytest.approx(best)


def test_leaks_in_several_indexes(spark, data, docs, monkeypatch):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    pairs = lambda: {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id").collect()}
    one = pairs()
    monkeypatch.setattr(decontamination.indexes, "__defaults__", (15, 0.75))
    assert pairs() == one


# ---- 10 ---------------------------------------------------------------------------------------


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    near = base[:100] + rng.normal(scale=0.05, size=(100, 16))
    x = np.concatenate([base, near, base[:20], base[:20] * 3, base[:1].repeat(200, 0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0, None] * 8), (1005, [1.0] * 8), (1006, [float("inf")] + [0.0] * 15)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(0))).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    root = list(range(len(x)))
    for _ in range(len(x)):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(link[i]))]) for i in range(len(x))]
        if new == root:
            break
        root = new
    assert all((got[i]["n_links"], got[i]["component_id"]) == (link[i].sum(), root[i]) for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(1000, 1007))
    assert len(got) == len(rows)


def test_embeddings_nothing(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# ---- all --------------------------------------------------------------------------------------


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_embeddings_of_several_lengths_without_ids_and_in_doubles(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(1, e), (2, [1.0, 0.01, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.001]), (5, [1e300, 0.0, 1e290]), (6, [1.0]), (None, e), (None, [0.0, 0.0, 1.0]), (7, [0.0, 1.0, 0.0]), (7, [0.0, 0.0, -1.0]), (8, [0.0, 1.0, 0.02]), (9, [0.0, 0.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"h": F.lit(0), "node": F.lit("x"), "a.b": F.lit(1)})
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect())
    want = [(1, 3, 1, True), (2, 3, 1, False), (5, 3, 1, False), (None, 3, 1, False), (None, 0, None, False), (3, 1, 3, True), (4, 1, 3, False), (6, 0, 6, True), (7, 1, 7, True), (8, 1, 7, False), (7, 1, 7, True), (9, 1, 7, False)]
    assert got == sorted((str(i), *x) for i, *x in want)


def test_embeddings_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    monkeypatch.setattr(embeddings, "TILE", 4)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(150, 24)) * np.linspace(3, 0.1, 24)
    x = np.concatenate([base, base[:60] + rng.normal(scale=0.05, size=(60, 24)), base[:1] + rng.normal(scale=0.02, size=(120, 24))])
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == dict(enumerate(((u @ u.T >= 0.95).sum(1) - 1).tolist()))


def test_sketches_never_lie_further_apart_than_vectors():
    rng = np.random.default_rng(7)
    x = embeddings._unit(rng.normal(size=(200, 40)))
    y = embeddings._unit(x + rng.normal(scale=rng.choice([0.001, 0.03, 0.1], (200, 1)), size=x.shape))
    axes = np.linalg.qr(rng.normal(size=(40, 16)))[0]
    apart = np.linalg.norm((embeddings._sketch(x, axes).astype(float) - embeddings._sketch(y, axes)) / embeddings.STEPS, axis=1)
    assert (apart <= [embeddings._reach(e, 17) for e in np.linalg.norm(x - y, axis=1)]).all()
