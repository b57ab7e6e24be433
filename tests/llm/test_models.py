"""The classifiers: gradients, held-out accuracy, odd inputs; and the pipeline as a whole."""

import zlib

import numpy as np
import pytest

from tidemark.llm import quality, toxicity
from tidemark.llm.common import table
from tidemark.llm.words import words

SF = "/root/testdata/sf0.01"


def test_words():
    found = words([b"Ab, c1", b"", b"ab!!"])
    assert found.bounds.tolist() == [0, 2, 2, 3] and found.hash[0] == found.hash[2]
    signs = words([b"AB ab !!"], signs=True)
    assert len(signs.hash) == 3 and signs.hash[0] != signs.hash[1]


def test_gradients_of_the_network():
    rng = np.random.default_rng(1)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = rng.standard_normal((3, toxicity.LENGTH, 6 * toxicity.STATE)), np.arange(toxicity.LENGTH) < np.array([[24], [5], [1]])
    d = np.array([0.3, -1.0, 0.5])
    x = x * mask[:, :, None]
    _, kept = net.read(x, mask, keep=True)
    grads, dx = net.back(x, mask, kept, d)
    loss = lambda: float((net.read(x, mask) * d).sum())
    for name in ("uf", "ub", "att", "v", "out", "b"):
        for _ in range(3):
            at = tuple(rng.integers(s) for s in net.p[name].shape)
            old = net.p[name][at]
            net.p[name][at] = old + 1e-3
            up = loss()
            net.p[name][at] = old - 1e-3
            down = loss()
            net.p[name][at] = old
            assert grads[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-3)
    for at in ((0, 3, 5), (1, 2, 30), (0, 23, 47)):
        old = x[at]
        x[at] = old + 1e-3
        up = loss()
        x[at] = old - 1e-3
        down = loss()
        x[at] = old
        assert dx[at] == pytest.approx((up - down) / 2e-3, abs=2e-3)


def test_windows_overlap_and_cover_all_words():
    start, size, first = toxicity.windows(np.array([0, 0, 10, 100]))
    assert first.tolist() == [0, 1, 2, 8] and size[0] == 0
    covered = np.zeros(100, dtype=int)
    for s, n in zip(start, size):
        covered[s : s + n] += 1
    assert covered.min() == 1 and covered[10:].max() == 2


def held_out(spark, rows, label, column="predicted"):
    labels = {r.doc_id: r[label] for r in table(spark, SF, "labels").collect()}
    return [(r[column], labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]


def test_toxicity_of_held_out_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    pairs = held_out(spark, rows, "toxic")
    assert np.mean([p == y for p, y in pairs]) >= 0.9


def test_quality_of_held_out_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    pairs = held_out(spark, rows, "quality")
    assert np.mean([p == y for p, y in pairs]) >= 0.93


def test_held_out_labels_are_never_learned_from(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    score = lambda df: {r.doc_id: r.score for r in df.collect()}
    assert score(quality.quality(docs, labels)) == score(quality.quality(docs, flipped))


@pytest.mark.parametrize("judge", [toxicity.toxicity, quality.quality])
def test_odd_documents_and_labels(spark, judge):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "word " * 30_000, "s"), (4, "!!", "s"), (None, "x", "s"), (4, "!!", "s")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    both = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 5)], "doc_id long, quality int, toxic int")
    for labels in (none, one, both):
        rows = judge(docs, labels).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert judge(docs.limit(0), none).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p
    from tidemark.llm import bpe, decontaminate, minhash, pii

    docs = table(spark, SF, "documents")
    columns = docs.columns
    toxic = {r.doc_id for r in toxicity.toxicity(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
    clean = p.toxicity_stage(spark, docs, SF).cache()
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - toxic
    one = p.near_duplicate_stage(spark, clean, SF).cache()
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {r.doc_id for r in minhash.near_duplicates(clean).where("kept").collect()}
    left = p.decontamination_stage(spark, one, SF).cache()
    assert left.columns == columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in decontaminate.decontaminate(one, table(spark, SF, "benchmark")).where("NOT contaminated").collect()}
    safe = p.pii_stage(spark, left, SF).cache()
    assert safe.columns == columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert all(r.text == pii.redact(texts[r.doc_id]) and r.n_chars == len(r.text) for r in safe.collect())
    ids = {r.doc_id: r for r in p.encoding_stage(spark, safe, SF).collect()}
    code = bpe.encoder(bpe.default_path())
    for r in safe.limit(50).collect():
        assert np.array(ids[r.doc_id].ids, dtype="<u4").tobytes() == code.encode_all([r.text])[0]
    assert {r.doc_id for r in p.run(spark, SF).collect()} == set(ids)


def test_long_runs_are_read_in_pieces_that_cover_them():
    from tidemark.llm.words import in_pieces

    text = ("ab " + "漢字仮名" * 30 + " " + "q" * 49 + " end").encode()
    whole, found = words([b"one", text, b""]), toxicity.words_of([b"one", text, b""])
    assert in_pieces(whole, 1000, 24, 12) is whole and found.bounds[0] == 0 and found.bounds[1] == 1 and found.bounds[2] == found.bounds[3] == len(found.hash)
    pieces = [bytes(found.code[a : a + n]) for a, n in zip(found.start, found.length)]
    assert all(len(p.decode()) and len(p) <= 51 for p in pieces)
    covered = {int(x) for a, n in zip(found.start, found.length) for x in range(a, a + n)}
    assert covered == {int(x) for a, n in zip(whole.start, whole.length) for x in range(a, a + n)}
    again = words([p for p in pieces])
    assert again.hash.tolist() == found.hash.tolist()


@pytest.mark.parametrize("filler, phrase", [("abcdefghij", "zzwqvyx"), ("漢字仮名文章", "鬱鬼魔龍齧")])
def test_all_parts_of_phrases_deep_in_long_runs_are_input(filler, phrase):
    grams = lambda text: set(toxicity.vocabulary(toxicity.words_of([text.encode()]))[0].gram.tolist())
    own = grams(f"r{phrase}r") & grams(f"s{phrase}s")
    assert own
    for n in range(20, 60):  # 100 letters and more before it, at every place of a piece
        assert own <= grams((filler * 20)[:80 + n] + phrase + filler * 3)


def plain_words(text):
    """The words of a text with signs: runs of letters, digits or other signs, and whether a run is all capitals."""
    out, raw = [], text
    kind = lambda b: 1 if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 2 if 48 <= b <= 57 else 0 if b in (32, 9, 13) else 3
    i = 0
    while i < len(raw):
        j = i
        while j < len(raw) and kind(raw[j]) == kind(raw[i]):
            j += 1
        if kind(raw[i]):
            out.append(raw[i:j])
        i = j
    return out


def bucket_of(word):
    return int(quality.buckets(words([word], signs=True))[0])


TEXTS = [b"Good words, GOOD words 12 and more.", b"", b"!!", "Ärger über 3 Dinge\n\nund mehr".encode(), b"a a a b", b"one"]


def test_context_sums_are_the_plain_loop():
    index = quality.index_vectors().astype(np.int64)
    got, want = (np.zeros((quality.BUCKETS, quality.SIZE), dtype=np.int64) for _ in range(2))
    quality.context_sums(TEXTS, quality.index_vectors(), got)
    for text in TEXTS:
        own = [bucket_of(w) for w in plain_words(text)]
        for i, b in enumerate(own):
            for j in range(max(0, i - quality.WINDOW), min(len(own), i + quality.WINDOW + 1)):
                if i != j:
                    want[b] += index[own[j]]
    assert (got == want).all() and want.any()


def test_pooled_vectors_are_the_plain_means():
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((quality.BUCKETS, quality.SIZE)).astype(np.float32)
    got = quality.pooled(TEXTS, vectors)
    tables = vectors.astype(np.float64), quality.index_vectors() / quality.SIGNS**0.5
    for row, text in zip(got, TEXTS):
        want = []
        for t in tables:
            v = [t[bucket_of(w)] for w in plain_words(text)]
            n = max(len(v), 1)
            mean = sum(v, np.zeros(quality.SIZE)) / n
            spread = np.sqrt(np.maximum(sum((x * x for x in v), np.zeros(quality.SIZE)) / n - mean * mean, 0))
            want += [*mean, *spread, sum(float(a @ b) for a, b in zip(v, v[1:])) / n]
        assert row == pytest.approx(np.array(want), abs=2e-3)


def test_word_vectors_are_those_of_all_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    total = np.zeros((quality.BUCKETS, quality.SIZE), dtype=np.int64)
    for r in docs.collect():
        quality.context_sums([(r.text or "").encode()], quality.index_vectors(), total)
    length = np.sqrt((total * total).sum(axis=1, keepdims=True))
    assert quality.word_vectors(docs) == pytest.approx(total / np.maximum(length, 1e-9), abs=1e-5)


def test_temperature_is_the_best_of_the_part_set_apart():
    rng = np.random.default_rng(3)
    sample = [(b"good fine nice %d" % i if y else b"bad poor awful %d" % i, y if rng.random() > 0.1 else 1 - y) for i in range(300) for y in (0, 1)]
    model = quality.Scorer(rng.standard_normal((quality.BUCKETS, quality.SIZE)).astype(np.float32), sample)
    part = sorted(dict(sorted(sample)).items())  # as the scorer takes them
    apart = np.random.default_rng(3).permutation(len(part))[: len(part) // 5]
    texts, y = [part[i][0] for i in apart], np.array([part[i][1] for i in apart])
    logit = model._logit((quality.pooled(texts, model.vectors) - model.mean) / model.spread)
    loss = lambda t: np.logaddexp(0, np.where(y == 1, -logit, logit) / t).mean()
    assert model.trained and all(loss(model.temperature) <= loss(t) + 1e-12 for t in np.exp(np.linspace(-1.5, 2.5, 81)))
    assert loss(model.temperature) < loss(1.0)  # noisy labels: the plain logits are too sure
    assert np.mean([(model.score([t])[0] >= 0.5) == y for t, y in sample]) > 0.8


def test_scores_are_the_plain_loop_over_windows_and_gates():
    """Each window read word by word, both ways, with gates and attention written out."""
    rng = np.random.default_rng(8)
    net = toxicity.Network()
    net.word[:, -1], net.gram[:, -1] = rng.standard_normal(toxicity.BUCKETS), rng.standard_normal(toxicity.BUCKETS)
    texts = [b"", b"one", " ".join(f"w{i % 37}" for i in range(100)).encode(), ("漢字" * 60).encode(), b"a b c d e f g h i j k l m n o p q r s t u v w x"]
    got, n, _ = net.score_texts(texts)
    sig = lambda x: 1 / (1 + np.exp(-x))
    for text, score, count in zip(texts, got, n):
        found = toxicity.words_of([text])
        voc, number = toxicity.vocabulary(found)
        start, size, _ = toxicity.windows(found.bounds)
        assert count == len(start)
        logits = []
        for s, k in zip(start, size):
            rows = []
            for w in number[s : s + k]:
                grams = voc.gram[voc.bounds[w] : voc.bounds[w + 1]]
                g = net.gram[grams]
                rows.append(np.concatenate([net.word[voc.word[w]], g[:, :-1].mean(axis=0), [g[:, -1].max(), g[:, -1].min()]]).astype(np.float64))
            states = np.zeros((max(k, 1), 2 * toxicity.STATE))
            for way, order in (("f", range(k)), ("b", range(k - 1, -1, -1))):
                h = np.zeros(toxicity.STATE)
                for t in order:
                    a, b = rows[t] @ net.p[f"w{way}"] + net.p[f"c{way}"], h @ net.p[f"u{way}"]
                    z, r = sig(a[:8] + b[:8]), sig(a[8:16] + b[8:16])
                    h = (1 - z) * np.tanh(a[16:] + r * b[16:]) + z * h
                    states[t, slice(0, 8) if way == "f" else slice(8, 16)] = h
            e = np.exp(np.tanh(states @ net.p["att"]) @ net.p["v"])[:, 0]
            logits.append(float((e / e.sum()) @ states @ net.p["out"][:, 0] + net.p["b"][0]))
        assert score == pytest.approx(max(logits), abs=2e-3)


ODD_DOCS = [(1, None), (2, ""), (3, " \n"), (4, "word " * 40_000), (5, "some words said twice here"), (5, "some words said twice here"), (5, "other words under the same number"), (None, "words without a number at all"), (None, "words without a number at all"), (6, "mail a@b.co or call +49 30 1234567 soon")]


def test_pipeline_stages_with_odd_documents(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in ODD_DOCS], "doc_id long, text string, lang string, source string, n_chars long, _gone string, rep string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("i", "a benchmark item of some words"), (None, None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    told = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    want = sorted(((i, t) for i, t in ODD_DOCS), key=str)
    clean = p.toxicity_stage(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and told(clean) == want
    one = p.near_duplicate_stage(spark, docs, str(tmp_path))
    # one of the repeated rows stays, also of those without a number; another text under a number of theirs stays
    once = sorted({*ODD_DOCS[:5], *ODD_DOCS[6:]}, key=str)
    assert one.columns == docs.columns and told(one) == once
    left = p.decontamination_stage(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and told(left) == want
    safe = p.pii_stage(spark, docs, str(tmp_path))
    assert safe.columns == docs.columns and {r.doc_id: r.text for r in safe.collect()}[6] == "mail [EMAIL] or call [PHONE] soon"
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in safe.collect())
    ids = p.encoding_stage(spark, docs, str(tmp_path))
    assert ids.count() == len(ODD_DOCS) and {r.n_tokens for r in ids.where("doc_id < 4").collect()} == {0}
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_a_different_text_under_a_number_of_a_copy_stays(spark):
    from tidemark.llm import minhash

    a, b = "one two three four five six seven", "wholly other words that nothing else has at all"
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b.upper())], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in minhash.keep_one(docs).collect()) == [(3, a), (5, b)]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(3, 3, 3, True), (5, 3, 3, False), (5, 5, 3, False), (7, 5, 3, False)}  # a number is one document


def test_held_out_toxic_labels_are_never_learned_from(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    score = lambda df: {r.doc_id: r.score for r in df.collect()}
    assert score(toxicity.toxicity(docs, labels, 60)) == score(toxicity.toxicity(docs, flipped, 60))


def test_toxicity_is_fitted_away_from_the_driver(spark, sf_dir, monkeypatch):
    import os

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    monkeypatch.setattr(toxicity, "fit", lambda sample, driver=os.getpid(): float(len(sample) if os.getpid() != driver else -1))
    assert toxicity.train(docs, labels, 5) == 10
