"""Encoding, packing, secrets, language and toxicity."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from catalog_engine.llm import bpe, language, packing, secret_scan, toxicity
from tests.llm.conftest import AWKWARD, LONG

ALPHABET = [
    chr(c)
    for c in (*range(0x250), *range(0x300, 0x5FF), *range(0x1E00, 0x2070), 0x3000, *range(0x3041, 0x3100), 0x1F600, 0x10400)
]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(7)
    made = ["".join(draw.choices(ALPHABET, k=draw.randint(0, 40))) for _ in range(1500)]
    return made + [
        "", " a  b ", "a \n b", "\n a", "<|endoftext|>ab <|startoftext|> <|end", "don't it's WE'LL",
        "a" * 4000, "ΑΣ ΑΣ.", "İI", "éa", "\x1ca b\x1d", LONG[:5000],
    ]


def library(path):
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def test_word_bpe_equals_the_library(texts):
    made, ours = library(bpe.WORD_BPE), bpe.load(bpe.WORD_BPE)
    for text, want in zip(texts, made.encode_batch(texts, add_special_tokens=False)):
        got = bpe.encode_words(text)
        assert got == want.ids, text
        assert ours.decode(got) == made.decode(got, skip_special_tokens=False)


def test_round_trip_encode_decode(spark, awkward, docs):
    made = library(bpe.WORD_BPE)
    got = bpe.round_trip(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert all(r.n_tokens == len(r.ids_text.split()) for r in got)
    want = {i: made.encode(t or "", add_special_tokens=False).ids for i, t in AWKWARD}
    for row in got:
        assert row.ids_text == " ".join(map(str, want[row.doc_id]))
        assert row.decoded == made.decode(want[row.doc_id], skip_special_tokens=False)
    encoded = bpe.encode(awkward.drop("ids"))
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
    decoded = {r.doc_id: r.decoded for r in bpe.decode(encoded).collect()}
    assert decoded == {r.doc_id: r.decoded for r in got}
    assert bpe.round_trip(docs([])).count() == 0


def test_byte_ids_equal_the_library(texts):
    encode = packing.byte_encoder(packing.BYTE_BPE, packing.BYTE_RANKS)
    want = library(packing.BYTE_BPE).encode_batch(texts, add_special_tokens=False)
    for text, one in zip(texts, want):
        assert np.frombuffer(encode(text), "<u4").tolist() == one.ids, text


def test_differencing_is_nearly_equal_and_complete():
    draw = random.Random(1)
    for n, parts in ((0, 1), (1, 3), (5, 5), (200, 9), (40, 1)):
        lengths = [draw.randint(1, 256) for _ in range(n)]
        dealt = packing.difference(lengths, parts) if n else []
        assert sorted(i for part in dealt for i in part) == list(range(n))
        if n == 200:
            sums = [sum(lengths[i] for i in part) for part in dealt]
            assert max(sums) - min(sums) <= 8
    dealt = packing.deal([6, 6, 6], 10)  # 18 in two parts of 10 cannot be: a third is tried
    assert len(dealt) == 3


def test_packing_holds_every_id_once(spark, awkward, docs):
    draw = random.Random(3)
    words = [w for w in LONG.split()[:500]]
    rows = AWKWARD + [(100 + i, " ".join(draw.choices(words, k=draw.randint(0, 900)))) for i in range(150)]
    made = library(packing.BYTE_BPE)
    pieces = packing.pack(docs(rows).repartition(3)).collect()
    tokens = {}
    for i, t in rows:
        tokens.setdefault(i, []).append([*made.encode(t or "", add_special_tokens=False).ids, 1])
    fill, parts = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and zlib.crc32(p.ids) >= 0
        parts.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
        fill.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert set(parts) == set(tokens)
    for i, versions in tokens.items():
        whole = sorted(parts[i])
        assert sum(len(x[1]) for x in whole) == sum(map(len, versions))
        if len(versions) == 1:
            assert [t for _, ids, _ in whole for t in ids] == versions[0]
            assert all(n == len(versions[0]) for _, _, n in whole)
    used = sum(p.length for p in pieces)
    assert used / (packing.CAPACITY * len(fill)) > 0.97
    assert packing.pack(docs([])).count() == 0
    assert packing.pack(awkward).count() >= len(AWKWARD)


def test_base_spans_by_plain_rules():
    text = (
        'token=token=abcdefghijklmnop PASSWD : "short" api_key:"0123456789ab" AKIAABCDEFGHIJKLMN AKIA12 '
        "0123456789abcdef0 0123456789abcde K=secret=ſecret Key"
    )
    found = secret_scan.base_spans(text)
    assert [text[s.start : s.end] for s in secret_scan.ordered(found)] == [
        "token=token=abcdefghijklmnop", 'api_key:"0123456789ab', "AKIAABCDEFGHIJKLMN", "0123456789abcdef0",
    ]


def test_literals_reach_sensitive_names_through_constants():
    text = (
        'BASE = "sk9f8A7dQ"\nfull = BASE + "Zz81kQ0p"\ndb.password = full\n'
        "export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG\npassword: changeme\n"
        'token_count = 1234567890123\nnote = "sk9f8A7dQ1"\nx = x + x\nx = x + x\nauth: Zx81-99aQ\n'
    )
    lexed = {text[s.start : s.end] for s in secret_scan.lex(text)}
    assert lexed == {"sk9f8A7dQ", "Zz81kQ0p", "wJalrXUtnFEMI/K7MDENG", "Zx81-99aQ"}
    clean = secret_scan.redact(text, secret_scan.find(text))
    assert "Zz81kQ0p" not in clean and "changeme" in clean and 'note = "sk9f8A7dQ1"' in clean


def test_scan_and_scrub_awkward_rows(awkward, docs):
    spans = {r.doc_id: r.spans for r in secret_scan.scan(awkward.drop("spans")).collect()}
    assert all(s == [] for s in spans.values())
    scrubbed = secret_scan.scrub(awkward)
    assert scrubbed.columns == awkward.columns
    assert sorted(map(str, scrubbed.collect())) == sorted(map(str, awkward.collect()))
    assert secret_scan.scan(docs([])).count() == 0


def _corpus(n, seed=5):
    """Two invented languages; toxic texts hold some of ten words."""
    draw = random.Random(seed)
    letters = {"aa": "abcdeklmno", "bb": "pqrstuvwxy"}
    bad = [f"bad{c}" for c in "abcdefghij"]
    rows = []
    for i in range(n):
        lang = "aa" if i % 2 else "bb"
        words = ["".join(draw.choices(letters[lang], k=draw.randint(2, 7))) for _ in range(draw.randint(20, 90))]
        toxic = int(draw.random() < 0.2)
        if toxic:
            for _ in range(draw.randint(2, 6)):
                words.insert(draw.randrange(len(words)), draw.choice(bad))
        rows.append((i, " ".join(words), lang, toxic))
    return rows


def test_toxicity_on_held_out_rows(spark, awkward):
    rows = _corpus(900)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, x) for i, _, _, x in rows if i % 3] + [(None, 1), (1, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(i, x) for i, _, _, x in rows if i % 3 == 0]
    assert sum(got[i].predicted == x for i, x in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    # Blocks are skipped, neighbours are not: the same as computing every cosine.
    for i, text, _, _ in rows[:60]:
        words = toxicity.terms_of(text)
        counts = {}
        for w in words:
            if w in model.terms:
                counts[model.terms[w]] = counts.get(model.terms[w], 0) + 1
        if not counts:
            continue
        query = model.vector(counts, len(words))
        every = np.zeros(len(model.index.ids))
        for term, weight in query.items():
            places, weights = model.index.lists[term]
            every[places] += weight * weights
        order = sorted((-round(s, 12), p) for p, s in enumerate(every) if s > 0)[: model.neighbours]
        near = model.index.nearest(query, model.neighbours)
        assert [p for _, p in order] == [p for _, p in near]
        assert [-s for s, _ in order] == pytest.approx([s for s, _ in near])
    scored = toxicity.score(awkward, model)
    assert scored.count() == len(AWKWARD) and dict(scored.dtypes)["score"] == "double"
    kept = toxicity.drop_toxic(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    scores = toxicity.score(docs(AWKWARD), toxicity.fit(docs(AWKWARD), none)).collect()
    assert {r.score for r in scores} == {0.0} and {r.predicted for r in scores} == {0}


def test_language_profiles(spark, awkward, docs):
    rows = _corpus(300, 6)
    known = spark.createDataFrame([(i, t, g) for i, t, g, _ in rows], "doc_id bigint, text string, lang string")
    profiles = language.fit(known.where("doc_id % 5 <> 0"), dimensions=512)
    assert profiles.languages == ["aa", "bb"]
    wrong = language.predict(known, profiles).where("lang <> lang_pred").count()
    assert wrong == 0
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(awkward, profiles).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in ("aa", "bb")
    assert language.predict(docs([]), profiles).count() == 0
    nothing = language.fit(known.where(F.lit(False)))
    assert {r.lang_pred for r in language.predict(known.limit(3), nothing).collect()} == {"und"}


def test_profiles_follow_from_the_definition():
    store = language.Vectors(64)
    got = store.bundles(["ab a", None, "12"])
    a, b, blank = store.letter(ord("a")), store.letter(ord("b")), store.letter(0)
    want = np.zeros(64)
    for x, y, z in ((blank, a, b), (a, b, blank), (b, blank, a), (blank, a, blank)):
        want += np.roll(x, 2) * np.roll(y, 1) * z
    assert np.allclose(got[0], want / np.linalg.norm(want)) and not got[1:].any()


def test_typed_and_inner_assignments_and_long_chains():
    secret = "Zx9qK2mV7pL4"
    for text in (
        f'private_key: str = "{secret}"',
        f'const accessKey: string = "{secret}";',
        f'api_key: Optional[str] = "{secret}"',
        f'  private secretKey?: string | null = "{secret}"',
        f'let token: &\'static str = "{secret}";',
        f"INFO: db_pwd={secret}",
        f"level=info:db_pwd={secret} next",
        f"a=b=c=db.pwd={secret}",
    ):
        assert {text[s.start : s.end] for s in secret_scan.lex(text)} == {secret}, text
    pieces = [f"p{i:03d}Q" for i in range(200)]
    chain = "\n".join(["x = ''", *(f'x = x + "{p}"' for p in pieces), "password = x"])
    assert {chain[s.start : s.end] for s in secret_scan.lex(chain)} == set(pieces)
    assert [s for s in secret_scan.lex("def f(password: str, token: str = None):\n x: int = 'Zx9qK2mV7pL4'\n")] == []
    kept = "password=Zx9q=K2mV7pL4"
    assert [kept[s.start : s.end] for s in secret_scan.lex(kept)] == ["Zx9q=K2mV7pL4"]
    assert secret_scan.lex("auth=" * 50_000) is not None  # in time that grows with the length
    assert secret_scan.lex("x = x + x\n" * 50_000 + "password = x") == []


def test_examples_that_share_a_passage_stay(docs, spark):
    passage = "this very passage stands in many documents "
    texts = ["a", "b", "c", "d", "D!", "d"]
    rows = [(i, passage * 3 + t) for i, t in enumerate(texts)]
    labels = spark.createDataFrame(list(enumerate([0, 1, 0, 1, 1, 0])), "doc_id bigint, toxic int")
    got = toxicity._examples(docs(rows), labels, 100).select("doc_id", "toxic").collect()
    # Only the two toxic texts of the same words are one.
    assert sorted(map(tuple, got)) == [(0, 0), (1, 1), (2, 0), (3, 1), (5, 0)]


def test_words_of_the_same_pieces_are_encoded_once(monkeypatch):
    asked = []
    plain = bpe.WordBpe.tokens
    monkeypatch.setattr(bpe.WordBpe, "tokens", lambda self, piece: asked.append(piece) or plain(self, piece))
    bpe._memo.cache_clear()
    memo, library = bpe._memo(bpe.WORD_BPE), Tokenizer.from_file(bpe.WORD_BPE)
    words = ["thereon", "Thereon", "THEREON.", "thereon,", '"thereon"', "(thereon", "it's", "don't!", "a1.", "é.", "<|x.", "?!"]
    for word, (n, ids, _) in zip(words, memo.all(words)):
        want = library.encode(word, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want)))
    assert asked.count("thereon") == 1


def test_differencing_by_chains_gives_the_plain_lists():
    """The same parts in the same order as with lists that are joined, in clearly less time."""
    import heapq
    import random
    import time

    import numpy as np

    def plain(lengths, parts):
        heap = []
        for i, length in enumerate(lengths):
            sums = np.zeros(parts, np.int64)
            sums[0] = length
            heap.append((-length, i, sums, [[i]] + [None] * (parts - 1)))
        heapq.heapify(heap)
        order = len(lengths)
        while len(heap) > 1:
            _, _, a, in_a = heapq.heappop(heap)
            _, _, b, in_b = heapq.heappop(heap)
            sums = a + b[::-1]
            rank = np.argsort(-sums, kind="stable")
            joined = [(x + y if y else x) if x else y for x, y in zip(in_a, reversed(in_b), strict=True)]
            sums = sums[rank]
            sums -= sums[-1]
            heapq.heappush(heap, (-int(sums[0]), order, sums, [joined[r] for r in rank]))
            order += 1
        return [part or [] for part in heap[0][3]]

    draw = random.Random(3)
    for n, parts in ((1, 3), (2, 2), (5, 8), (40, 7), (300, 20)):
        lengths = [draw.randint(1, 256) for _ in range(n)]
        assert packing.difference(lengths, parts) == plain(lengths, parts)
    lengths, took = [draw.randint(1, 256) for _ in range(1500)], []
    for made in (packing.difference, plain):
        least = 9e9
        for _ in range(3):
            began = time.process_time()
            made(lengths, 128)
            least = min(least, time.process_time() - began)
        took.append(least)
    assert took[0] < 0.8 * took[1]


def test_packing_keeps_a_bounded_number_of_parts(monkeypatch):
    made = []

    class Kept(packing.Memo):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(packing, "Memo", Kept)
    encode = packing.byte_encoder.__wrapped__(packing.BYTE_BPE, packing.BYTE_RANKS)
    for at in range(0, 120_000, 1_000):
        encode("one " + " ".join(f"w{n}" for n in range(at, at + 1_000)))
    assert len(made) == 1 and len(made[0]) + len(made[0].old) <= 1 << 16


def test_workers_get_a_few_megabytes_of_texts_at_a_time(spark, docs):
    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    packing.pack(docs([]))
    rows = spark.range(0, 6_000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 4000) AS text")
    found = [r.n for r in rows.mapInArrow(sizes, "n bigint").collect()]
    assert sum(found) >= 24_000_000 and max(found) <= 5_000_000


def test_toxicity_learns_from_all_labels_and_all_words_that_mark(spark):
    # 600 words that mark, in 900 of 21,000 labelled texts.
    def word(start, i):
        return start + "".join(chr(97 + i // 26**k % 26) for k in range(4))

    marks = [[word("bad", (7 * i + k * 61) % 600) for k in range(10)] if i < 900 else [] for i in range(21_000)]
    texts = [" ".join([word("plain", i), "here", *m]) for i, m in enumerate(marks)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.range(21_000).selectExpr("id as doc_id", "cast(id < 900 as int) as toxic")
    model = toxicity.fit(docs, labels)
    assert sum(w.startswith("bad") for w in model.terms) == 600
    assert model.rate == 900 / 21_000 and set(range(900)) <= set(model.index.ids.tolist())
    assert sum(t for t, _ in model.bins) == 900
    odd = spark.createDataFrame([(1, "nothing said"), (2, f"so {marks[0][0]} and {marks[0][1]}"), (3, None)], "doc_id bigint, text string")
    assert [r.predicted for r in toxicity.score(odd, model).orderBy("doc_id").collect()] == [0, 1, 0]


def test_index_of_many_blocks_gives_the_neighbours_of_all_cosines(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCKS", 20)
    draw = random.Random(3)
    vectors = []
    for _ in range(3_000):
        v = {t: draw.choice([0.2, 0.5, draw.random()]) for t in draw.sample(range(30), draw.randint(1, 6))}
        size = sum(w * w for w in v.values()) ** 0.5
        vectors.append({t: w / size for t, w in v.items()})
    index = toxicity.Index.build(list(range(3_000)), [i % 2 for i in range(3_000)], vectors, 30)
    assert index.block == 150 and index.largest.shape == (30, 20)
    place = {int(d): p for p, d in enumerate(index.ids)}
    for i in range(0, 3_000, 60):
        every = np.zeros(3_000)
        for d, v in enumerate(vectors):
            every[place[d]] = sum(w * v.get(t, 0.0) for t, w in vectors[i].items())
        every[place[i]] = 0
        want = sorted((-round(s, 10), p) for p, s in enumerate(every) if s > 0)[:8]
        near = index.nearest(vectors[i], 8, place[i])
        assert [round(s, 10) for s, _ in near] == [-s for s, _ in want] and place[i] not in [p for _, p in near]
