"""op11 to op13 against plain loops, on odd rows and over the contract's whole query."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexigrove.llm import op11_importance as op11
from lexigrove.llm import op12_alignment as op12
from lexigrove.llm import op13_digest as op13
from lexigrove.llm import op9_html
from lexigrove.llm import queries

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", " \n\t ", "a", "A b", "a ", " lead", "The cat sat on the mat. " * 3, "é ü ☃\u00a0x  y", "12 !? --", "x" * 5000, "word " * 3000, "same text again", "same text again",
    "a  b\n c\t d </s> <s> <unk> <0x41> ﬁ ①<|endoftext|> x", "a▁b", "ok a▁b ok", "\x00a  b  c", "汉字测试，今天天气很好。" * 100, "don't  it's\n\n x\n  y", "🙂🙂 é é" * 50, "x\u0085 y\x1c z", "a\n\nb\n\nc" * 200,
]
SCHEMA = "doc_id long, text string, lang string, row long, rank long, score double, part int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, a null id, and extra columns whose names clash with results."""
    rows = [(i, t, "en", 7, 7, 0.5, 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[9], rows[9], (9, "another text of the same id", None, None, None, None, None), (None, "no id here", "en", 1, 1, 0.5, None)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# op11

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def weights(rows, target, low=1, high=1, buckets=10_000, seed=2024, percent=10, least=20):
    def found(text):
        w = WORD.findall((text or "").translate(UPPER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(low, high + 1) for i in range(len(w) - k + 1)]

    every, wanted = [(i, *found(t)) for i, t in rows], [b for t in target for b in found(t)[1]]
    s, t = Counter(b for *_, f in every for b in f), Counter(wanted)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in every:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    ranks = {}
    for k, x in enumerate(able[: percent * len(able) // 100], 1):
        ranks.setdefault(x, []).append(k)
    for x in out:
        yield (*x[:4], ranks[x].pop(0) if ranks.get(x) else None, x[4])


def some_first(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


@pytest.mark.parametrize("how", [{}, {"size": 64}, {"low": 1, "high": 3, "size": 50, "percent": 60, "least": 3}, {"low": 2, "high": 2, "buckets": 50, "seed": 1, "percent": 100, "least": 0}])
def test_importance_against_loops(spark, docs, odd, how):
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for df in (docs, odd):
        own = {k: v for k, v in how.items() if k != "size"}
        assert some_first(map(tuple, op11.importance(df, bench, **how).collect())) == some_first(weights(pairs(df), target, **own))


def test_chunks_own_every_word_once():
    rng = np.random.default_rng(1)
    for _ in range(60):
        text = "".join(rng.choice(list("ab1 é.  \n"), int(rng.integers(0, 200)))).encode()
        words = op11.WORDS.findall(text)
        for carry in (0, 1, 3):
            got = [op11.features(piece, owned, carry + 1, carry + 1, 1 << 30) for owned, piece in op11.chunks(text, carry, 16)]
            assert sum(n for n, _ in got) == len(words)
            want = [zlib.crc32(b" ".join(words[i : i + carry + 1])) % (1 << 30) for i in range(len(words) - carry)]
            assert [x for _, f in got for x in f.tolist()] == want
    assert max(len(p) for _, p in op11.chunks(b"word " * 100_000, 2, 1024)) < 1100


def test_drawn_keeps_columns_and_nothing_from_nothing(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = op11.drawn(docs, bench)
    ids = {r.doc_id for r in op11.importance(docs, bench).where("rank IS NOT NULL").collect()}
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == ids and ids
    assert op11.importance(docs.limit(0), bench).count() == 0
    assert some_first(map(tuple, op11.importance(docs, bench.limit(0)).collect())) == some_first(weights(pairs(docs), []))


def test_a_long_text_of_10_mb(spark):
    row = [(1, "alpha beta, gamma " * 600_000), (2, "alpha beta " * 30), (3, "字" * 3_000_000)]
    df = spark.createDataFrame(row, "doc_id long, text string")
    target = spark.createDataFrame([("gamma alpha",)], "text string")
    got = {r.doc_id: r for r in op11.importance(df, target).collect()}
    want = {x[0]: x for x in weights(row, ["gamma alpha"])}
    assert {i: tuple(r) for i, r in got.items()} == want and got[1].n_features == 1_800_000 and got[3].n_features == 1


# op12


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    files = op12.read()
    a_of, b_of = Tokenizer.from_buffer(files[0]), sentencepiece.SentencePieceProcessor(model_proto=files[1])
    a_of.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    size = lambda i: bytes(byte[c] for c in a_of.id_to_token(i))
    piece = lambda i: bytes([int(b_of.id_to_piece(i)[3:-1], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode()
    every, counts = [], Counter()
    for doc, text in rows:
        groups, a, b = [], [], []
        if text:
            a, b, whole = a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text), (" " + text).encode()
            if b"".join(map(size, a)) != whole or b"".join(map(piece, b)) != whole:
                a, b = [], []
            ends = [np.cumsum([len(f(i)) for i in ids]).tolist() if ids else [] for f, ids in ((size, a), (piece, b))]
            i = j = 0
            for end in sorted(set(ends[0]) & set(ends[1])):
                left, right = [], []
                while i < len(a) and ends[0][i] <= end:
                    left.append(a[i])
                    i += 1
                while j < len(b) and ends[1][j] <= end:
                    right.append(b[j])
                    j += 1
                groups.append((left, right))
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        counts.update(links.keys())
        every.append((doc, len(a), len(b), groups, links))
    best: dict = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    for doc, n, m, groups, links in every:
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""
        yield doc, n, m, len(groups), sum(links.values()), sum(k for p, k in links.items() if counts[p] == best[p[0]]), sum(k * counts[p] for p, k in links.items()), digest


def test_alignment_against_loops(docs, odd):
    for df in (docs.limit(60), odd):
        df = df.cache()
        want = some_first(plain_alignment(pairs(df)))
        assert some_first(map(tuple, op12.alignment(df).collect())) == want
        # pairs beyond those shipped are joined
        assert some_first(map(tuple, op12.alignment(df, shipped=100).collect())) == want
        df.unpersist()
    assert op12.alignment(docs.limit(0)).count() == 0


def test_components_are_those_of_a_walk():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        x, y = rng.integers(0, n, (2, int(rng.integers(0, 40))))
        reach = np.eye(n, dtype=bool)
        reach[x, y] = reach[y, x] = True
        for _ in range(6):
            reach = reach @ reach
        assert op12.components(n, x, y).tolist() == reach.argmax(1).tolist()


def test_wide_groups_and_memo_change_nothing(monkeypatch):
    from lexigrove.llm import kernel as K

    import pyarrow as pa

    texts = [t for t in ODD if t]
    made = op12.Aligner(op12.read())

    def results():
        out = []
        for _, _, data, off in K.slices(pa.array(texts), 4096):
            numbers, digests, bounds, links, times = made(data, off)
            out += [(numbers[i, :4].tolist(), digests[i], links[bounds[i] : bounds[i + 1]].tolist(), times[bounds[i] : bounds[i + 1]].tolist()) for i in range(len(digests))]
        return out

    want = results()
    for name, value in (("MANY", 1), ("MEMO", 0), ("LONG", 8)):
        monkeypatch.setattr(op12, name, value)
        made.fresh()
        assert results() == want


def test_translation_counts_documents(spark):
    df = spark.createDataFrame([(1, "the cat"), (2, "the cat the"), (3, "the dog"), (4, None)], "doc_id long, text string")
    got = {(r.a, r.b): (r["count"], r.best) for r in op12.translation(df).collect()}
    assert sorted(v for v, _ in got.values())[-1] == 3 and all(b for _, b in got.values())


# op13


def test_levels_are_entropies():
    rng = np.random.default_rng(0)
    for high in (1, 2, 8, 256):
        x = rng.integers(0, high, 400).astype(np.uint8)
        want = []
        for s in range(len(x) - op13.WINDOW + 1):
            n = np.bincount(x[s : s + op13.WINDOW])
            p = n[n > 0] / op13.WINDOW
            want.append(1000 * -(p * np.log2(p)).sum() / math.log2(op13.WINDOW))
        assert np.abs(np.array(want) - op13.levels(x)).max() <= 0.51
    assert len(op13.levels(x[: op13.WINDOW - 1])) == 0


def plain_features(text, rank):
    """Selected windows in order, each distinct one once, by loops."""
    if not text:
        return []
    if len(text) < op13.WINDOW:
        return [text]
    r = rank[op13.levels(np.frombuffer(text, np.uint8))].tolist()
    votes = Counter()
    for s in range(len(r) - op13.NEAR + 1):
        votes[min(range(s, s + op13.NEAR), key=lambda i: (r[i], i))] += 1
    at = [i for i in range(len(r)) if votes[i] >= op13.VOTES] or [min(range(len(r)), key=lambda i: (r[i], i))]
    return list(dict.fromkeys(text[i : i + op13.WINDOW] for i in at))


def test_features_and_filters_against_loops(docs, monkeypatch):
    import xxhash

    texts = [t.encode() for _, t in pairs(docs)][:40] + [(t or "").encode() for t in ODD]
    rank = op13.ranks(op13.level_counts(docs))
    for block in (1 << 20, 700):
        monkeypatch.setattr(op13, "BLOCK", block)
        made = op13.Prints(texts, rank)
        for i, t in enumerate(texts):
            features = plain_features(t, rank)
            chain = []
            for k, f in enumerate(features):
                if k % op13.FULL == 0:
                    chain.append(set())
                h = xxhash.xxh3_64_intdigest(f)
                chain[-1].update((h >> (12 * j)) % op13.BITS for j in range(op13.HASHES))
            n, filters = made.of(i)
            assert n == len(features)
            assert [set(np.flatnonzero(np.unpackbits(row.view(np.uint8))).tolist()) for row in filters] == chain
            back = op13.read(made.text(i))
            assert back[0] == n and (back[1] == filters).all()


def test_digests_against_loops(docs, odd, spark):
    for df in (docs, odd):
        rank = op13.ranks(op13.level_counts(df))
        import xxhash

        rows = [(i, t or "") for i, t in pairs(df)]
        signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
        want = []
        for k, (i, t) in enumerate(rows):
            after = rows[(k + 1) % len(rows)][1]
            edit = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            one = op13.Prints([t.encode(), edit.encode(), after.encode()], rank)
            want.append((i, len(t), hashlib.sha256(edit.encode()).hexdigest(), one.text(0), one.text(1), op13.likeness(one.of(0), one.of(1)), op13.likeness(one.of(0), one.of(2))))
        for parts in (1, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            assert some_first(map(tuple, op13.digests(df).collect())) == some_first(want)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    one = op13.digests(spark.createDataFrame([(5, "a single document, which is its own next one")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert op13.digests(docs.limit(0)).count() == 0


def test_likeness_of_copies_edits_and_others(docs):
    rank = op13.ranks(op13.level_counts(docs))
    texts = [t for _, t in pairs(docs) if len(t) > 500]
    edits = [op13.changed(a, b) for a, b in zip(texts, texts[1:])]
    made = op13.Prints([t.encode() for t in texts + edits], rank)
    n = len(texts)
    assert all(op13.likeness(made.of(i), made.of(i)) == 1.0 for i in range(n))
    near = [op13.likeness(made.of(i), made.of(n + i)) for i in range(n - 1)]
    far = [op13.likeness(made.of(i), made.of(i + 1)) for i in range(n - 1) if texts[i] != texts[i + 1]]
    assert np.mean(np.array(near) > 0.3) > 0.95 and np.mean(np.array(far) < 0.1) > 0.95
    for i in range(0, n - 1, 9):
        assert op13.likeness(made.of(i), made.of(n + i)) == op13.likeness(made.of(n + i), made.of(i))
    empty = op13.Prints([b"", b"x"], rank)
    assert op13.likeness(empty.of(0), empty.of(0)) == 1.0 and op13.likeness(empty.of(0), empty.of(1)) == 0.0


def test_fingerprints_are_those_of_the_digests(docs, odd):
    for df in (docs, odd):
        assert sorted((str(r.doc_id), r.fingerprint) for r in op13.fingerprints(df).collect()) == sorted((str(r.doc_id), r.fingerprint) for r in op13.digests(df).collect())


# op9: names that stand on an article's own parts

PROSE = "Long prose of the article with many words that a reader wants to read in full here today"
LINKS = '<ul><li><a href="1">Home</a></li><li><a href="2">All news</a></li><li><a href="3">Sport</a></li></ul>'


@pytest.mark.parametrize(
    "html, text",
    [
        (f'<article><p>{PROSE}</p><div class="menu"><ul><li>Soup with bread</li><li>Fish and chips</li><li>Apple pie</li></ul></div><p>{PROSE}</p></article>', [PROSE, "Soup with bread", "Fish and chips", "Apple pie", PROSE]),
        (f'<article><p>{PROSE}</p><div class="menu">{LINKS}</div><p>{PROSE}</p></article>', [PROSE, PROSE]), (f'<article><p>{PROSE}</p><div class="share">Share this</div><p>{PROSE}</p></article>', [PROSE, PROSE]),
        (f'<article><div id="notice-board-history"><p>{PROSE}</p></div><p>{PROSE}</p></article>', [PROSE, PROSE]), (f'<article><p>{PROSE}</p><blockquote class="related-quote">{PROSE}</blockquote></article>', [PROSE, PROSE]),
        (f'<article><p>{PROSE}</p><table class="toolbar"><tr><td>{PROSE}</td></tr></table></article>', [PROSE, PROSE]), (f'<p class="top story">{PROSE}</p><p>{PROSE}</p>', [PROSE, PROSE]),
        (f"<title>no end<p>{PROSE}</p><p>{PROSE}</p>", [PROSE, PROSE]), (f'<article><p>{PROSE}</p><div class="related">{LINKS}</div></article>', [PROSE]), (f'<div class="nav-top">{LINKS}</div><p>{PROSE}</p><p>{PROSE}</p>', [PROSE, PROSE]),
        (f'<article><p>{PROSE}</p><div class="notice">{PROSE}</div><div class="ad">{PROSE}</div><div class="comments"><p>{PROSE}</p></div><aside>{PROSE}</aside></article>', [PROSE]),
    ],
)
def test_weak_names_leave_it_to_words_and_links(html, text):
    tree = op9_html.default_tree()
    assert op9_html.main_text(html, tree) == "\n".join(text)


def test_the_flag_alone_would_be_wrong():
    """Of the labelled blocks in articles with a weak name, keeping all or none is far from the tree."""
    weak = [(r, c) for r, c in op9_html.LABELLED if r[7] == 0.5]
    tree = op9_html.default_tree()
    right = np.mean([op9_html.classify(tree, r) == c for r, c in weak])
    assert right >= 0.95 and max(np.mean([c for _, c in weak]), 1 - np.mean([c for _, c in weak])) < 0.65
    # one that is left out is still told right by a tree of the others in most cases
    every = op9_html.LABELLED
    held = [i for i, (r, _) in enumerate(every) if r[7] == 0.5]
    told = 0
    for i in held:
        x, y = zip(*(every[:i] + every[i + 1 :]))
        told += op9_html.classify(op9_html.grow(np.array(x, float), np.array(y)), every[i][0]) == every[i][1]
    assert told / len(held) >= 0.8


def test_language_sample_is_bounded_whatever_the_column_holds(spark, monkeypatch):
    from lexigrove.llm import op4_langid

    words = {"en": "the and of that with this", "de": "der und die nicht mit das", "fr": "les des une pour dans est"}
    rows = [(i, f"{words[lang]} {i}", lang) for i, lang in enumerate(list(words) * 60)] + [(1000 + i, f"dirty {i}", f"x{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(op4_langid, "LANGUAGES", 3)
    monkeypatch.setattr(op4_langid, "TEXTS", 30)
    model = op4_langid.fit(df)
    assert sorted(model.langs) == ["de", "en", "fr"]
    assert op4_langid.fit(df.limit(0)).langs == [] and {r.lang_pred for r in op4_langid.language_id(df.where("doc_id < 30")).collect()} == set(words)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_cross_tokenizer_alignment", "op13_document_fingerprints"])
def test_queries_cover_the_whole_table(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
