"""Near duplicates of documents, vectors and passages, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import capfilter, chunks, graph, minhash
from tidemark.llm.common import table


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    w = low.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(sets):
    ids = sorted(sets)
    return [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * (n := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - n)]


def check_documents(docs, got):
    sets = {r.doc_id: shingle_set(r.text) for r in docs}
    want = components_of(sets, brute_links(sets))
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(100, b) for b in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components_of({x for l in links for x in l}, links)
    assert got == {n: c for n, c in want.items() if any(n in l and l[0] != l[1] for l in links)}


def test_rounds_of_components_take_few_exchanges(spark, monkeypatch):
    exchanges = []  # of each stored set of links; the driver holds plans and tasks of all of them

    def counted(df, what, stored=graph.stored):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return stored(df, what)

    monkeypatch.setattr(graph, "stored", counted)
    graph.components(spark.createDataFrame([(i, i + 1) for i in range(5)], "a long, b long"))
    assert len(exchanges) > 1 and max(exchanges) <= 6, exchanges


def test_later_links_of_near_duplicates_are_those_of_components(spark, sf_dir, monkeypatch):
    sizes = []

    def counted(links, components=minhash.components):
        sizes.append(links.count())
        return components(links)

    monkeypatch.setattr(minhash, "components", counted)
    minhash.near_duplicates(table(spark, sf_dir, "documents"))
    assert sizes[1] < sizes[0] and sizes[-1] < sizes[0], sizes  # the links of the first round aren't read again


def test_near_duplicates_of_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    check_documents(docs.collect(), minhash.near_duplicates(docs).collect())


def test_chains_and_families_of_near_duplicates(spark):
    rng = random.Random(1)
    vocab = [f"v{i}" for i in range(3000)]
    rows, n = [], 0
    for size in (60, 12, 40):
        words = rng.choices(vocab, k=140)
        for _ in range(size):  # each an edit of the one before or of the first: many just below the threshold
            base = words[:]
            for _ in range(rng.randint(2, 9)):
                base[rng.randrange(len(base))] = rng.choice(vocab)
            if rng.random() < 0.4:
                words = base
            rows.append((n, " ".join(base)))
            n += 1
    rows += [(n + 1, rows[0][1]), (n + 2, rows[0][1].upper()), (n + 3, None), (n + 4, ""), (n + 5, " \n"), (n + 6, "one two"), (n + 7, "One\ttwo"), (n + 8, "one"), (n + 9, "a b c d e")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, n int")
    check_documents(docs.collect(), minhash.near_duplicates(docs).collect())
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = components_of(sets := {i: shingle_set(t) for i, t in rows}, brute_links(sets))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)


def test_near_duplicates_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == [(3, 3, True), (3, 3, True), (None, None, True), (None, None, True)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def shuffled_bytes(spark):
    """What all stages so far wrote to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_that_nothing_is_linked_with_are_not_shuffled(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(3000))) for i in range(150)]
    rows += [(1000 + i, f"{t} more") for i, t in rows[:5]] + rows[3:7]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    size = sum(len(t) for _, t in rows)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as on tables too large to broadcast
    try:
        before = shuffled_bytes(spark)
        kept = sorted(r.doc_id for r in minhash.keep_one(docs).select("doc_id", "text").collect())
        after = shuffled_bytes(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert kept == list(range(150))
    assert after - before < size / 2, (after - before, size)  # once for the sets and once for the result, it was over one


def test_sifting_loses_no_key_whatever_passes(spark, monkeypatch):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.unhex(F.md5(F.col("id").cast("string"))).alias("mark"))
    for most in (2**15, 2**27):  # a filter that is too small lets more pass
        monkeypatch.setattr(minhash, "FILTER_BITS", most)
        keys = rows.where("doc_id % 4 != 3")
        some, others = minhash._sifted(rows, rows["doc_id"], rows["mark"], keys, 3000)
        some, others = ({r.doc_id for r in x.collect()} for x in (some, others))
        assert not some & others and some | others == set(range(4000))
        assert others <= set(range(3, 4000, 4)) and len(others) > (700 if most == 2**15 else 900)
    some, others = minhash._sifted(rows, rows["doc_id"], rows["mark"], rows.limit(0), 0)
    assert (some.count(), others.count()) == (0, 4000)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    b = np.concatenate([a[:3000], np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))])
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - truth) < 0.15


def test_small_sets_that_are_alike_always_share_a_key():
    rng = np.random.default_rng(6)
    for _ in range(6000):
        n = int(rng.integers(1, 17))
        both = int(rng.integers(-(-3 * n // 4), n + 1))
        m = int(rng.integers(both, 4 * both // 3 + 1))
        if 100 * both < 75 * (n + m - both):
            continue
        pool = np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64))
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : n + m - both]]))
        assert np.intersect1d(minhash.first_keys(a), minhash.first_keys(b)).size
    assert [len(minhash.first_keys(np.arange(n, dtype=np.uint64))) for n in (1, 3, 4, 16, 21, 22)] == [1, 1, 2, 5, 6, 0]


def test_pairs_at_the_threshold_of_three_and_four_shingles_are_all_found(spark):
    rows = [(2 * i + k, " ".join(f"w{i}x{j}" for j in range(7 + k))) for i in range(1500) for k in (0, 1)]  # 3 shingles, and those with one more
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("component_id = doc_id - doc_id % 2").count() == len(rows)


def check_vectors(rows, got, cosine=0.98):
    ok = [(i, l, v) for i, l, v in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for k, (i, l, v) in enumerate(ok):
        for j, m, w in ok[k + 1 :]:
            if l == m and len(v) == len(w):
                a, b = np.array(v, dtype=float), np.array(w, dtype=float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
                    links.append((i, j))
    want = components_of({i for i, _, _ in rows if i is not None}, links)
    count = {i: sum(i in l for l in links) for i in want}
    for r in got:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id, r.kept) == (count[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id), r


def test_similar_vectors(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for dims, label in ((64, 1), (64, 2), (5, 3), (2, 4)):
        for _ in range(12):
            centre = rng.standard_normal(dims)
            for _ in range(int(rng.integers(1, 9))):
                v = centre + rng.choice([0, 0.05, 0.1, 0.15]) * rng.standard_normal(dims)
                rows.append((n, label, [float(x) for x in v]))
                n += 1
    rows += [(n, 1, None), (n + 1, 1, []), (n + 2, 1, [0.0] * 64), (n + 3, 1, [float("nan")] * 64), (n + 4, 1, [None] + [1.0] * 63), (n + 5, None, rows[0][2]), (n + 6, 1, [float("inf")] * 64), (None, 1, rows[0][2]), (n + 7, rows[0][1], [2 * x for x in rows[0][2]])]
    df = spark.createDataFrame([(*r, "e") for r in rows], "vec_id long, label int, embedding array<double>, rep string")
    got = capfilter.similar_vectors(df).collect()
    assert len(got) == len(rows)
    check_vectors(rows, got)
    assert capfilter.similar_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("dims, codes", [(2, 48), (8, 48), (16, 256), (32, 195), (64, 48), (64, 96), (64, 195), (64, 256), (128, 128), (384, 256)])
def test_filters_recall_whatever_the_number_of_directions(dims, codes):
    rng, n = np.random.default_rng(3), 1500
    a = capfilter.unit(rng.standard_normal((n, dims)))
    noise = rng.standard_normal((n, dims))
    noise = capfilter.unit(noise - (noise * a).sum(axis=1, keepdims=True) * a)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * noise  # the farthest that are still links
    met = [bool(np.intersect1d(x, y).size) for i in range(0, n, 300) for x, y in zip(capfilter.list_decode(a[i : i + 300], codes), capfilter.list_decode(b[i : i + 300], codes))]
    assert np.mean(met) >= 0.99


def test_directions_grow_with_the_label():
    assert [capfilter.codes_for(n) for n in (0, 10_000, 10**7, 10**12)] == [48, 48, 195, 256]
    assert capfilter.keep_for(64, 48) == capfilter.KEEP < capfilter.keep_for(64, 256)


def test_filters_are_the_highest_of_all():
    rng = np.random.default_rng(9)
    v = capfilter.unit(rng.standard_normal((5, 64)))
    rotation, parts = capfilter.code(64, 4)
    x = v @ rotation
    s = [x[:, b] @ d.T for b, d in parts]
    whole = (s[0][:, :, None, None, None] + s[1][:, None, :, None, None] + s[2][:, None, None, :, None] + s[3][:, None, None, None, :]).reshape(5, -1)
    got = capfilter.list_decode(v, 4)  # fewer directions in half a code than filters kept
    for i in range(5):
        assert set(got[i].tolist()) == set(np.argsort(-whole[i])[: capfilter.KEEP].tolist())


def test_ties_at_the_threshold_are_links(spark):
    rows = [(1, "x", [1.0, 0.0]), (2, "x", [0.98, float(np.sqrt(1 - 0.98**2))]), (3, "x", [0.5, 0.5]), (1, "x", [1.0, 0.0])]
    exact = float(np.dot(capfilter.unit(np.array([rows[0][2]]))[0], capfilter.unit(np.array([rows[1][2]]))[0]))
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in capfilter.similar_vectors(df, cosine=exact).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_boundaries_cover_the_text_and_move_with_it():
    rng = random.Random(4)
    text = " ".join(rng.choice(["alpha", "béta", "gamma", "δelta", "x"]) + str(rng.randint(0, 99)) for _ in range(2000)).encode()
    ends = chunks.boundaries(text)
    assert ends[-1] == len(text) and all(0 < b - a for a, b in zip([0, *ends], ends))
    assert 5 < 2000 / len(ends) < 14
    assert all(text[a:b].decode() for a, b in zip([0, *ends], ends))
    cut = {text[a:b] for a, b in zip([0, *ends], ends)}
    moved = text[:3000].decode(errors="ignore").encode() + b"INSERTED" + text[3000:]
    again = chunks.boundaries(moved)
    same = sum(b - a for a, b in zip([0, *again], again) if moved[a:b] in cut)
    assert same > 0.95 * len(text)
    assert chunks.boundaries(b"") == [] and chunks.boundaries(b"a" * 1000)[-1] == 1000


def test_chunks_of_a_group_are_those_of_each_text():
    rng = random.Random(14)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 3, 30, 200]))).encode() for _ in range(40)] + [b"ha " * 60, b" ", b""]
    u = chunks.units(texts)
    found = chunks.chunks_of(u)
    for i, text in enumerate(texts):
        p, q = found.bounds[i : i + 2]
        ends, own = chunks.digests(text)
        assert own == list(zip(found.high[p:q].tolist(), found.low[p:q].tolist()))
        # by a plain loop: the gear hash of four units, and where it is smallest within four on either side
        one = chunks.units([text])
        gear = [sum(int(g) << (16 * k) for k, g in enumerate(chunks.mix(one.hash[max(0, j - 3) : j + 1] * chunks._GEAR[0])[::-1].tolist())) % 2**64 for j in range(len(one.hash))]
        last = [j for j in range(len(gear)) if gear[j] == min(gear[max(0, j - 4) : j + 5])]
        starts = sorted({0, *(j + 1 for j in last if j + 1 < len(gear))}) if gear else []
        assert chunks.chunks_of(one).start.tolist() == starts


def brute_chunks(docs):
    """Distinct repeated chunks by a dictionary over all documents: digest -> documents that have it."""
    out = {}
    for doc_id, text in docs:
        for d in set(chunks.digests((text or "").encode())[1]):
            out.setdefault(d, set()).add(doc_id)
    return {d: ids for d, ids in out.items() if len(ids) > 1}


def brute_cuts(docs):
    """What is cut of each text, by a dictionary of chunks over all documents: chunks that a document of a smaller id has, or the
    same text well before; neighbours together, made longer while the texts go on alike; long enough, or whole copies."""
    told, first, texts, out = {}, {}, {}, {}
    for doc_id, text in sorted(docs):
        raw = (text or "").encode()
        u = chunks.units([raw])
        found = chunks.chunks_of(u)
        own = [raw[a:b] for a, b in zip(u.start.tolist(), u.end.tolist())]
        told[doc_id] = own, list(zip(found.start.tolist(), found.end.tolist()))
        for a, b in told[doc_id][1]:
            first.setdefault(tuple(own[a:b]), (doc_id, a, b))  # its first place in the first document
    for doc_id, text in sorted(docs):
        raw = (text or "").encode()
        u = chunks.units([raw])
        if raw in texts and texts[raw] < doc_id:
            out[doc_id] = [(0, len(raw))]
            continue
        texts.setdefault(raw, doc_id)
        own, spans = told[doc_id]
        here, parts = {}, []
        for n, (a, b) in enumerate(spans):
            words = tuple(own[a:b])
            here.setdefault(words, (doc_id, a, b))
            source = first[words] if first[words][0] < doc_id else here[words] if a - here[words][1] >= chunks.APART else None
            if source and parts and parts[-1][0] == n - 1:
                parts[-1] = (n, parts[-1][1], b, parts[-1][3], source)
            elif source:
                parts.append((n, a, b, source, source))
        cuts = []
        for _, a, b, (d, x, _), (e, _, y) in parts:
            left, right, back, on = told[d][0], told[e][0], 0, 0
            while back < chunks.CONTEXT and min(a, x) > back and own[a - back - 1] == left[x - back - 1]:
                back += 1
            while on < chunks.CONTEXT and b + on < len(own) and y + on < len(right) and own[b + on] == right[y + on]:
                on += 1
            if cuts and a - back <= cuts[-1][1]:
                cuts[-1][1] = max(cuts[-1][1], b + on)
            else:
                cuts.append([a - back, b + on])
        places = [(int(u.start[a]), int(u.end[b - 1]), b - a) for a, b in cuts]
        out[doc_id] = [(a, b) for a, b, n in places if b - a >= chunks.RUN or n > chunks.WORDS]
    return out


def test_all_documents_of_the_table_are_cut_as_by_a_dictionary_of_chunks(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    want = brute_cuts(docs)
    assert brute_chunks(docs) and sum(map(len, want.values())) > 10
    texts = dict(docs)
    for r in chunks.deduplicate(table(spark, sf_dir, "documents")).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert [tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s] == [(len(raw[:a].decode()), len(raw[:b].decode())) for a, b in want[r.doc_id]], r.doc_id


def test_chunks_of_odd_documents(spark):
    rows = [(None, "x y " * 300), (5, "x y " * 300), (6, "w " * 60_000), (7, "w " * 60_000), (None, None), (7, "another text of number seven " * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_cut, len(r.text or "")) for r in chunks.deduplicate(docs).collect()), key=str)
    assert [g for g in got if g[0] == 7] == [(7, 0, 58), (7, 1, 0)] and [g[1] for g in got if g[0] is None] in ([0, 1], [1, 0])


def test_repeated_passages_are_cut(spark):
    rng = random.Random(6)

    def prose(n):
        return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))

    passage = prose(60)
    texts = {1: prose(100) + " " + passage + " " + prose(80), 2: prose(70) + " " + passage + " " + prose(90), 3: prose(200), 4: passage + " " + prose(50), 5: "stock phrase of a few words " + prose(60), 6: "stock phrase of a few words " + prose(60)}
    docs = spark.createDataFrame([(i, t, "k") for i, t in texts.items()] + [(7, None, "k"), (8, "", "k"), (9, texts[3], "k"), (9, texts[3], "k")], "doc_id long, text string, key string")
    got = {r.doc_id: r for r in chunks.deduplicate(docs).collect()}
    assert {i for i, r in got.items() if r.n_cut} == {2, 4, 9}
    assert got[2].copied_from == got[4].copied_from == [1] and got[9].copied_from == [3]
    assert got[2].cut_chars > 0.6 * len(passage) and got[9].cut_chars == len(texts[3])
    for i in (2, 4):
        a, b = map(int, got[i].spans.split(":"))
        assert texts[i][a:b] in passage or passage in texts[i][a:b] or texts[i][a + 1 : b - 1] in passage
        assert got[i].text == texts[i][:a] + texts[i][b:]
    assert got[7].text is None and got[8].text == "" and got[1].text == texts[1]
    assert chunks.deduplicate(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "ab" * 2000, "é" * 700])
def test_odd_texts_have_whole_chunks(text):
    ends, found = chunks.digests(text.encode())
    assert len(ends) == len(found) and (not text or ends[-1] == len(text.encode()))


def test_every_repeated_passage_of_over_50_words_is_cut_to_its_ends(spark):
    """Random passages of 51 to 60 words in two contexts, and copies of any length, in words and in characters."""
    rng = random.Random(8)
    letters = "eeeettaaoinshrdlu"

    def prose(n):
        return " ".join("".join(rng.choices(letters, k=rng.choice([1, 2, 3, 4, 5, 7, 9]))) for _ in range(n))

    rows, want = [], {}
    for k in range(400):
        p = prose(51 + k % 10)
        rows += [(2 * k, f"{prose(20)} {p} {prose(30)}"), (2 * k + 1, f"{prose(35)} {p} {prose(15)}")]
        want[2 * k + 1] = p
    cjk = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(300))
    blob = "".join(rng.choices("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789+/", k=3000))
    rows += [(900, "ab " + cjk), (901, cjk[::-1][:40] + cjk[50:250]), (910, "x" + blob), (911, blob[::-1][:100] + blob[500:])]
    rows += [(920, "a short text"), (921, "a short text"), (922, prose(14)), (923, "ha " * 100)]
    rows.append((924, rows[-2][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts, got = dict(rows), {r.doc_id: r for r in chunks.deduplicate(docs).collect()}
    for i, p in want.items():
        a = texts[i].index(p)
        cuts = [tuple(map(int, s.split(":"))) for s in got[i].spans.split(",") if s]
        assert any(x <= a and a + len(p) <= y <= a + len(p) + 12 for x, y in cuts), (i, p, got[i].spans)
        assert got[i - 1].n_cut == 0 and got[i].copied_from == [i - 1]
    assert got[901].spans == "40:240" and got[911].n_cut == 1 and got[911].cut_chars > 2350
    assert (got[921].text, got[921].copied_from, got[924].text, got[924].copied_from) == ("", [920], "", [922])
    assert got[920].n_cut == got[922].n_cut == 0 and got[923].spans == "48:299"
