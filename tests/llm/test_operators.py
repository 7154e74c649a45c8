"""The corpus operators against plain re-computations, and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from ratescale.llm import decontamination, neighbours, packing, personal_data, quality, sharding, simhash, suffix_dedup, token_counts, token_files

BYTE_BPE, WORD_BPE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PASSAGE = "A passage of forty words and more that stands in several documents, word for word, so that it has to go. " * 3
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000)) + " <|endoftext|> it's" + "z" * 5000

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, length string, item string, fp string, `row` string, shard string"
AWKWARD = [
    (1, "Call +1 (252) 555-8630 or mail a.b@c.org now.", "en", "s", 1),
    (1, "Call +1 (252) 555-8630 or mail a.b@c.org now.", "en", "s", 1),
    (2, None, "en", None, None),
    (3, "", None, "s", 0),
    (None, "   \n\t  two  spaces \n", "en", "s", 3),
    (None, None, None, None, None),
    (4, PASSAGE + "the first end", "en", "s", 5),
    (5, "another start " + PASSAGE, "en", "t", 5),
    (6, LONG, "en", "s", 9),
    (7, "naïve café é é ÀÉ ½ ² 3² x_1 don't DON'T 'such it'such I'LL <|endoftext|>", "fr", "s", 2),
    (8, " odd spaces 　here\x1cand\x85there ", "en", "t", 2),
    (9, "aaaa" * 300, "en", "t", 2),
    (10, "Card 4539 1488 0343 6467 at 10.0.0.255, not 10.0.0.256.", "en", "t", 2),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", "v", "w") for r in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def ids_of(file, text):
    return Tokenizer.from_file(file).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("which", ["docs", "awkward", "empty"])
def test_token_counts(request, which):
    df = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    want = [(k, len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False).ids), n > 512) for k, t in texts(df)]
    assert rows(token_counts.count_tokens(df, BYTE_BPE), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)


def test_texts_that_begin_with_a_sign():
    some = ["'those days", "'several", "'those", "'tis", "'s", "'Those", "3several", "_those", "-those", "those", "a", "'", ""]
    assert token_counts.Merger(BYTE_BPE).text_counts(some).tolist() == [len(ids_of(BYTE_BPE, t)) for t in some]


@pytest.mark.parametrize("which", ["docs", "awkward", "empty"])
def test_token_files(request, which):
    df = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    start, want = 0, []
    for k, t in sorted(texts(df), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        raw = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((k, start, len(raw), zlib.crc32(raw.tobytes())))
        start += len(raw)
    got = token_files.round_trip(df, WORD_BPE)
    # rows that share an id are ordered by their text; null texts come before empty ones and have the same ids
    assert rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)


def test_decoding_begins_at_any_checkpoint():
    ids = np.random.default_rng(1).geometric(0.01, 700_000).astype(np.uint32)
    symbols, counts = np.unique(ids, return_counts=True)
    coder = token_files.Coder(token_files.shared_table(symbols.astype(np.int64), counts))
    words, points = coder.encode(ids)
    assert len(words) < 2 * len(ids) and len(points) > 2
    assert np.array_equal(coder.decode(words, points, len(ids)), ids)
    at = [p[0] * token_files.LANES for p in points] + [len(ids)]
    for k in range(len(points)):
        assert np.array_equal(coder.decode(words, points, len(ids), first=k, last=k + 1), ids[at[k]:at[k + 1]])


@pytest.mark.parametrize("which", ["docs", "awkward", "empty"])
def test_packing(request, which):
    df = request.getfixturevalue(which)
    got = packing.pack(df, BYTE_BPE, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    want = Counter((k, tuple([*tokenizer.encode(t, add_special_tokens=False).ids, 0])) for k, t in texts(df))
    assert sum(r["length"] for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    sequences = {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(ids) == r["length"]
        assert any(k == r["doc_id"] and ids.tolist() == list(x[r["start"]:r["start"] + r["length"]]) for k, x in want)
        assert r["length"] == 2048 or r["piece"] == 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) + 1 or which == "empty"


def test_repacking_over_many_groups(spark):
    lengths = np.random.default_rng(3).integers(1, 1200, 3000)
    items = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "item long, length long")
    got = packing.place(items, group_items=200).collect()
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += int(lengths[r["item"]])
    assert len(got) == 3000 and max(fill.values()) <= 2048
    assert len(fill) <= packing.lower_bound(np.bincount(lengths, minlength=2049), 2048) + 4


def test_lower_bound_counts_items_that_cannot_share():
    assert packing.lower_bound(np.bincount([1100] * 7, minlength=2049), 2048) == 7
    assert packing.lower_bound(np.bincount([700] * 6, minlength=2049), 2048) == 3


@pytest.mark.parametrize("which", ["docs", "awkward", "empty"])
def test_sharding(request, which):
    df = request.getfixturevalue(which)
    got = sharding.interleave(df, shards=4).collect()
    have = [(r["doc_id"], r["source"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect()]
    assert Counter((r["doc_id"], r["source"], r["size"], r["text_crc32"]) for r in got) == Counter(have)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(slots.get(s, [])) for s in range(4)]
    assert max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mixture = Counter((r["source"], r["shard"]) for r in got)
    for source, n in Counter(r["source"] for r in got).items():
        assert all(abs(mixture[source, s] - n / 4) < 2 for s in range(4))


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, near):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if near(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


@pytest.mark.parametrize("which", ["docs", "awkward", "empty"])
def test_simhash(request, which):
    df = request.getfixturevalue(which)
    have = [(k, plain_fingerprint(t)) for k, t in texts(df)]
    root = plain_components({f for _, f in have}, lambda a, b: (a ^ b).bit_count() <= 4)
    first = {}
    for k, f in have:
        if k is not None:
            first[root[f]] = min(k, first.get(root[f], k))
    want = [(k, f"{f:016x}", first.get(root[f])) for k, f in have]
    assert rows(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id") == sorted(want, key=str)


def test_a_large_shard_is_dealt_over_slots(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TREE_ROWS", 16)
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 62, 12)]
    values = {b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (12, 2))} | {i << 20 for i in range(60)}
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = plain_components(values, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {v: got.get(v, v) for v in values} == want


def plain_hits(text, windows):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    hit, items = [False] * len(words), set()
    for length in {len(w) for w in windows}:
        for i in range(len(words) - length + 1):
            if found := windows.get(tuple(words[i:i + length])):
                hit[i:i + length] = [True] * length
                items |= found
    return len(words), sum(hit), sorted(items)


BENCHMARK = [("1", "stands in several documents, word for word, so that it has to go"), ("2", "two spaces"), ("2", "A-B"), ("10", "two SPACES"), (None, "don't"), ("4", None), ("5", "...")]


@pytest.mark.parametrize("which", ["docs", "awkward", "empty"])
@pytest.mark.parametrize("block", [decontamination.PHRASE_BYTES, 64])
def test_decontamination(spark, data, request, which, block):
    df = request.getfixturevalue(which)
    bench = spark.read.parquet(f"{data}/benchmark.parquet") if which == "docs" else spark.createDataFrame(BENCHMARK, "item_id string, text string")
    windows = {}
    for r in bench.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        for i in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[i:i + 10]), set()).add(str(r["item_id"] if r["item_id"] is not None else ""))
    want = [(k, *plain_hits(t, windows)) for k, t in texts(df)]
    got = decontamination.find_contamination(df, bench, phrase_bytes=block)
    assert rows(got, "doc_id", "n_words", "n_hit", "items") == sorted(want, key=str)
    kept = decontamination.drop_contaminated(df, bench, phrase_bytes=block)
    assert kept.columns == df.columns and kept.count() == sum(not w[2] for w in want)


def test_no_benchmark(awkward):
    got = decontamination.find_contamination(awkward, awkward.selectExpr("source AS item_id", "text").limit(0))
    assert got.filter("contaminated").count() == 0 and got.count() == len(AWKWARD)


def test_suffix_array_and_rank():
    symbols = np.random.default_rng(2).integers(1, 4, 400)
    text = [*(symbols + 1).tolist(), 0]
    assert decontamination.suffix_array(np.array(text)).tolist() == sorted(range(401), key=lambda i: text[i:])
    index = decontamination.FMIndex(symbols, 4)
    for pattern in ([1, 2], [3, 3, 1], [2], [1, 1, 1, 1, 1, 1, 1, 1]):
        low, high = index.search(np.array([pattern]))
        found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert found == [i for i in range(400) if symbols[i:i + len(pattern)].tolist() == pattern]


@pytest.mark.parametrize("which", ["docs", "awkward", "empty"])
def test_suffix_dedup(request, which):
    df = request.getfixturevalue(which)
    raws = [(k, t.encode()) for k, t in texts(df)]
    seen = Counter(b[i:i + 200] for _, b in raws for i in range(len(b) - 199))
    want = []
    for k, b in raws:
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                edge[i] += 1
                edge[i + 200] -= 1
        hit = np.cumsum(edge[:-1]) > 0
        runs = int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum())
        want.append((k, len(b), int(hit.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~hit].tobytes()).hexdigest()))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def plain_personal_data(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and personal_data.luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


ODD = ["a@b.c@d.e", "@@a@b.co@", "x+y%z@q-r.s..t", "a@b", "1.2.3.4.5.6.7.8.9", "1.2.3", "256.1.1.1 001.002.003.004", "+1+12345678+", "+1 ((( 2", "é@b.co ü.x@y.zz", "a@-.-", "4539148803436467 4539148803436467"]


@pytest.mark.parametrize("which", ["docs", "awkward", "empty"])
def test_personal_data(request, which):
    df = request.getfixturevalue(which)
    got = personal_data.find_personal_data(df).collect()
    plain = lambda spans: [(s["kind"], s["start"], s["end"]) for s in spans]
    assert sorted(((r["doc_id"], plain(r["base"])) for r in got), key=str) == sorted(((k, plain_personal_data(t)) for k, t in texts(df)), key=str)
    assert all(set(plain(r["base"])) <= set(plain(r["spans"])) for r in got)
    clean = personal_data.redact(df)
    assert clean.columns == df.columns
    assert all(r["text"] is None or not plain_personal_data(r["text"]) for r in clean.collect())


@pytest.mark.parametrize("text", ODD)
def test_odd_personal_data(text):
    assert personal_data.base_spans(text) == plain_personal_data(text)


def test_luhn():
    assert personal_data.luhn("4539148803436467") and not personal_data.luhn("4539148803436468")


def test_the_field_adds_what_the_patterns_miss():
    rng = np.random.default_rng(0)
    samples = []
    for _ in range(400):
        text = f"Write to u{rng.integers(99)}@host.org or {'.'.join(map(str, rng.integers(1, 256, 4)))} for {rng.integers(10, 99)} items"
        tokens = personal_data.tokens_of(text)
        samples.append((text, tokens, personal_data.gold_segments(tokens, plain_personal_data(text))))
    field = personal_data.Field(personal_data.fit(samples))
    text = "Write to bob@local.org or 10.20.30.40 for 12 items"
    tokens = personal_data.tokens_of(text)
    found = field.best(field.lattice(text, tokens), len(tokens))
    assert [personal_data.LABELS[label] for _, _, label in found] == ["email", "ip"]


def field_of(texts_and_entities):
    """A field fitted on texts with the entities (kind, words) that they hold."""
    samples = []
    for text, kind, word in texts_and_entities:
        tokens = personal_data.tokens_of(text)
        spans = [(kind, m.start(), m.end()) for m in re.finditer(re.escape(word), text)]
        samples.append((text, tokens, personal_data.gold_segments(tokens, spans)))
    return personal_data.Field(personal_data.fit(samples))


def test_no_entity_lies_on_a_cut():
    rng = np.random.default_rng(0)
    number = lambda: f"{rng.integers(200, 999)} {rng.integers(200, 999)} {rng.integers(2000, 9999)}"
    field = field_of([("; ".join([*(["call 12 now"] * (k % 2)), n, n, n]), "phone", n) for k in range(400) for n in [number()]])
    for ahead in range(3):
        numbers = [number() for _ in range(80)]
        text = "; ".join(["call 12 now"] * ahead + numbers)
        found = [text[a:b] for kind, a, b in personal_data.added_spans(text, [], field) if kind == "phone"]
        assert found == numbers, ahead
    for gap in range(0, 400, 7):  # of words without a digit
        text = "555 123 4567 " + "word " * (gap // 5) + "x" * (gap % 5) + " 555 123 4568"
        assert [text[a:b] for _, a, b in personal_data.added_spans(text, [], field)] == ["555 123 4567", "555 123 4568"]


def test_a_lone_address_of_few_digits():
    rng = np.random.default_rng(0)
    address = lambda: "[.]".join(str(n) for n in rng.integers(0, 256, 4))
    field = field_of([(f"host {ip} has {k % 40} users", "ip", ip) for k in range(300) for ip in [address()]])
    for text in ("host 10[.]0[.]0[.]5 has users", "host 1[.]2[.]3[.]4 has users", "host 10[.]0[.]0[.]5 has 23 users"):
        assert [(kind, text[a:b]) for kind, a, b in personal_data.added_spans(text, [], field)] == [("ip", text.split()[1])]


def test_neighbours(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    pdf = table.toPandas()
    v = np.array(pdf["embedding"].tolist(), np.float64)
    ids = pdf["vec_id"].to_numpy()
    norm = np.sqrt((v * v).sum(axis=1))
    got = neighbours.nearest(table, "vec_id % 10 = 0", k=5, query_rows=7, vector_rows=40).toPandas()
    for q in np.flatnonzero(ids % 10 == 0):
        score = (v * v[q]).sum(axis=1) / (norm * norm[q])
        score[q] = -9
        order = np.lexsort((ids, -score))[:5]
        mine = got[got["query_id"] == ids[q]].sort_values("rank")
        assert mine["vec_id"].tolist() == ids[order].tolist() and np.allclose(mine["score"], score[order], rtol=0, atol=1e-14)


def test_awkward_vectors(spark):
    one = [1.0, 2.0, 3.0]
    some = [
        (0, one), (1, one), (2, one), (3, [2.0, 4.0, 6.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]),
        (8, [float("inf"), 1.0, 1.0]), (None, one), (9, [1e-200, 0.0, 0.0]), (10, [-1e200, 0.0, 0.0]), (11, [1.0, 2.0]), (12, []),
    ]
    table = spark.createDataFrame([(k, v, "x", "y") for k, v in some], "vec_id long, embedding array<double>, score string, `rank` string")
    got = neighbours.nearest(table, "vec_id in (0, 4, 5, 9, 11)", k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (9, 1, 0), (9, 2, 1), (9, 3, 2)]
    assert neighbours.nearest(table.limit(0), "vec_id = 0").count() == 0


def test_quality(spark, data, docs):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got.values())
    rated = [(r["grade"], got[r["doc_id"]]["tail_probability"]) for r in quality.graded(labels).collect()]
    assert np.mean([p for g, p in rated if g == 2]) > np.mean([p for g, p in rated if g < 2]) + 0.2
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["keep"]}


def test_held_out_grades():
    rng = np.random.default_rng(0)
    maker, words = quality.Featurizer(), [f"{a}{b}{c}" for a in "bdfgk" for b in ("ano", "eli", "uru") for c in ("ta", "mi", "so")]
    texts_, grades = [], []
    for i in range(900):
        some = rng.choice(words, 40).tolist()
        grade = i % 3
        if grade == 0:
            some = [w + "%%%" for w in some]
        if grade == 1:
            some[int(rng.integers(40))] = "horrid" + str(rng.choice(["", "ly", "er"]))
        texts_.append(" ".join(some))
        grades.append(grade)
    features, grades = list(maker.features(texts_)), np.array(grades)
    model = quality.fit(features[:600], grades[:600])
    kept = np.array([quality.predict(f, *model)[1] >= 0.5 for f in features[600:]])
    assert (kept == (grades[600:] == 2)).mean() > 0.95


def test_all_letters_reach_the_model():
    one = lambda text: set(next(quality.Featurizer().features([text])).tolist())
    for a, b in (("international", "interior"), ("internally", "internals"), ("of", "it"), ("文字が続く長い句の悪い語", "文字が続く長い句の良い語"), ("a" * 40 + "bad", "a" * 40 + "fine"), ("'a-b.c/d:e", "'a-b.c/d:;")):
        assert one(a) != one(b)
    rng = np.random.default_rng(1)
    texts_, grades = [], np.arange(1500) % 3
    for grade in grades:  # words in the middle of clauses without spaces
        some = ["".join(map(chr, rng.integers(0x4E00, 0x4E40, 24))) for _ in range(8)]
        some[0] = some[0][:12] + ["醜悪", "毒舌", "優秀"][grade] + some[0][12:]
        texts_.append("。".join(some))
    features = list(quality.Featurizer().features(texts_))
    model = quality.fit(features[:1000], grades[:1000])
    kept = np.array([quality.predict(f, *model)[1] >= 0.5 for f in features[1000:]])
    assert (kept == (grades[1000:] == 2)).mean() > 0.95


def test_quality_on_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (3, None, 1), (6, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(awkward, labels).count() == len(AWKWARD)
    assert quality.score(empty, labels).count() == 0 and quality.score(awkward, labels.limit(0)).filter("keep").count() == len(AWKWARD)
    assert quality.keep_good(awkward, labels.limit(0)).count() == len(AWKWARD)
    assert sorted(map(tuple, quality.graded(labels).collect())) == [(1, 0), (6, 2), (7, 1)]
